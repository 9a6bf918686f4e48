"""Phrase collocation mining by Rabin-Karp fingerprints.

A word's fingerprint is a polynomial of its bytes, a phrase's one of its words; prefix
sums in numpy give those of all n-grams of a block of texts at once. Tasks add up equal
fingerprints before they shuffle counts, level by level: a phrase can only be frequent
if the shorter ones in it are, so pairs are counted where both words were found
frequent, and longer phrases where all their pairs were. What was found frequent is
handed to the tasks as a bit table, whose size follows the number of fingerprints up to
a fixed bound; what it lets through by chance is counted, but never kept.

Fingerprints only select. In the last pass each task points from every selected n-gram
to its first occurrence, compares the words at both places byte by byte, splits off what
differs, and materialises a phrase once for all its occurrences in a block. The shuffle adds up
(lang, phrase) with a pointer (document, byte) to an occurrence in the first document, so counts are those of texts
and no collision can change them; only phrases that pass the limit are left.

Scores are decimals of 38 digits. The ranking of a language is cut in as many parts as
there are hashes (``PARTS``) before the rest of each meets in one task.

Defined results: a null text counts as an empty one, a null language as ``und``. Repeated
rows count each. A piece of text between separators is held whole in a task; longer
texts are cut at them. Null ids give null pointers. An empty table gives an empty result.
Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from guardedlake.llm.wordhash import U, Hasher, mix
from guardedlake.session import materialise

# Fixed values of the contract: what separates pieces and words, phrase lengths, limits and the scale of scores.
SEPARATORS = b".,;:!?\n\x0b\x0c\r"
BLANKS = b" \t"
LONGEST = 4
MIN_COUNT = 30
COVERED_PERCENT = 80
SCALE = 2_000_000
TOP = 2_000
UNKNOWN = "und"

BLOCK = VERIFIED = 1 << 21
HELD = 1 << 21
SPELLED = 1 << 15  # phrases that are written out at a time
BITS_EACH = 32
LEAST_BITS, MOST_BITS = 16, 28
PARTS = 64

STEP = 0x9FB21C651E98DF25
BACK = pow(STEP, -1, 1 << 64)
FINGERPRINTS = "lang string, fingerprint bigint, n bigint"


class Block(NamedTuple):
    """Some texts in one buffer, A to Z folded, each ended by a separator."""

    data: np.ndarray
    ends: np.ndarray
    rows: np.ndarray
    base: int


class Grams(NamedTuple):
    """The words of a block, and the n-grams that pass the tables given: for each length where they start and their fingerprints."""

    starts: np.ndarray
    ends: np.ndarray
    text: np.ndarray
    hashes: np.ndarray
    found: list[tuple[np.ndarray, np.ndarray]]


def _powers(base: int, size: int) -> np.ndarray:
    out = np.full(size, base, dtype=U)
    out[:1] = 1
    return np.multiply.accumulate(out)


def held(fingerprints: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Which fingerprints have both their bits set in a table."""
    last = U(len(table) * 8 - 1)
    out = np.ones(len(fingerprints), dtype=bool)
    for slot in (fingerprints & last, fingerprints >> U(32) & last):
        out &= (table[(slot >> U(3)).astype(np.int64)] >> (slot & U(7)).astype(np.uint8) & 1).astype(bool)
    return out


class Reader:
    """Blocks of an Arrow batch of texts, and the n-grams in them."""

    def __init__(self):
        self.words = Hasher()
        self.fold = np.arange(256, dtype=np.uint8)
        self.fold[65:91] += 32
        self.separator = np.zeros(256, dtype=bool)
        self.separator[list(SEPARATORS)] = True
        self.words.blank = self.separator.copy()
        self.words.blank[list(BLANKS)] = True

    def blocks(self, column: pa.Array, most: int) -> Iterator[Block]:
        """Texts of ``most`` bytes together; a longer one is cut at separators."""
        column = column.cast(pa.large_binary())
        ends = np.concatenate(([0], np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 1)))
        first = 0
        while first < len(column):
            last = max(first + 1, int(np.searchsorted(ends, ends[first] + most, "right")) - 1)
            # Only the texts of a block are copied, as a batch can be many times larger.
            ended = pc.binary_join_element_wise(pc.fill_null(column.slice(first, last - first), b""), pa.scalar(b"", pa.large_binary()), pa.scalar(b"\n", pa.large_binary()))
            data = np.frombuffer(ended.buffers()[2], dtype=np.uint8, count=int(ends[last] - ends[first]))
            if last > first + 1 or len(data) <= most:
                yield Block(self.fold[data], ends[first + 1:last + 1] - ends[first], np.arange(first, last), 0)
            else:
                at, stop = 0, len(data)
                while at < stop:
                    end = self._cut(data, at, stop, most)
                    yield Block(self.fold[data[at:end]], np.array([end - at]), np.array([first]), at)
                    at = end
            first = last

    def _cut(self, data: np.ndarray, at: int, stop: int, most: int) -> int:
        if at + most >= stop:
            return stop
        cuts = np.flatnonzero(self.separator[data[at:at + most]])
        if len(cuts):
            return at + int(cuts[-1]) + 1
        end = at + most
        while not len(cuts):
            cuts = np.flatnonzero(self.separator[data[end:end + most]])
            end += int(cuts[0]) + 1 if len(cuts) else most
        return end

    def grams(self, block: Block, langs: np.ndarray, tables: list[np.ndarray], longest: int, joint: int) -> Grams:
        """N-grams up to ``longest``; those of up to ``len(tables)`` words pass their table, longer ones follow from runs of ``joint`` words that did.

        ``langs``: a seed for each text of the batch, so that languages have fingerprints of their own.
        """
        starts, ends, hashes = self.words.words(block.data)
        text = np.searchsorted(block.ends, starts, "right")
        pieces = np.searchsorted(np.flatnonzero(self.separator[block.data]), starts)
        size = len(hashes)
        up, down = _powers(STEP, size), _powers(BACK, size)
        sums = np.concatenate((np.zeros(1, dtype=U), np.cumsum(hashes * up)))
        seeds = langs[block.rows[text]]
        found: list[tuple[np.ndarray, np.ndarray]] = []
        good = np.ones(size, dtype=bool)
        for n in range(1, longest + 1):
            room = max(size - n + 1, 0)
            if n == 1:
                at = np.arange(size)
            elif n <= joint + 1 or n <= len(tables):  # both shorter runs have passed
                at = np.flatnonzero(good[:room] & good[1:room + 1] & (pieces[:room] == pieces[n - 1:n - 1 + room]))
            else:
                at = found[n - 2][0]
                at = at[(at < room)]
                at = at[good[at + n - joint]]
            prints = mix((sums[at + n] - sums[at]) * down[at] + U(n * 0xD1342543DE82EF95 % (1 << 64)) + seeds[at])
            if n <= len(tables):
                pass_ = held(prints, tables[n - 1])
                at, prints = at[pass_], prints[pass_]
            if n <= max(joint, len(tables)):
                good = np.zeros(size + 1, dtype=bool)
                good[at] = True
            found.append((at, prints))
        return Grams(starts, ends, text, hashes, found)


def _lang_seeds(langs: list[str]) -> np.ndarray:
    known = {x: xxhash.xxh3_64_intdigest(x.encode()) for x in set(langs)}
    return np.array([known[x] for x in langs], dtype=U)


def _counted(lengths: tuple[int, ...], tables: list[np.ndarray]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Counts of the fingerprints of some lengths, added up as far as memory goes."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, parts, kept = Reader(), {}, 0
        for batch in batches:
            langs = pc.fill_null(batch.column(1), UNKNOWN).to_pylist()
            seeds = _lang_seeds(langs)
            names = np.array(langs, dtype=object)
            for block in reader.blocks(batch.column(2), BLOCK):
                grams = reader.grams(block, seeds, tables, max(lengths), len(tables))
                of_text = names[block.rows]
                for n in lengths:
                    at, prints = grams.found[n - 1]
                    for lang in set(of_text.tolist()):
                        here = prints[(of_text == lang)[grams.text[at]]]
                        parts.setdefault(lang, []).append(np.unique(here, return_counts=True))
                        kept += len(parts[lang][-1][0])
                if kept > HELD:
                    yield from (_added(lang, x) for lang, x in parts.items())
                    parts, kept = {}, 0
        yield from (_added(lang, x) for lang, x in parts.items())

    return run


def _added(lang: str, parts: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    prints, place = np.unique(np.concatenate([p for p, _ in parts]), return_inverse=True)
    counts = np.zeros(len(prints), dtype=np.int64)
    np.add.at(counts, place, np.concatenate([c for _, c in parts]))
    return pa.RecordBatch.from_arrays([pa.array([lang] * len(prints), pa.string()), pa.array(prints.view(np.int64)), pa.array(counts)], ["lang", "fingerprint", "n"])


def bit_table(fingerprints: DataFrame) -> np.ndarray:
    """Two bits for each fingerprint, in a table that grows with their number up to a fixed size."""
    size = 1 << min(max((fingerprints.count() * BITS_EACH).bit_length(), LEAST_BITS), MOST_BITS)
    slots = F.array(F.col("fingerprint").bitwiseAND(size - 1), F.shiftrightunsigned("fingerprint", 32).bitwiseAND(size - 1))
    numbered = fingerprints.select(F.explode(slots).alias("slot")).select((F.col("slot") + 1).alias("slot"))  # Spark's bitmaps count from 1
    parts = numbered.groupBy(F.bitmap_bucket_number("slot").alias("part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("slot")).alias("bits"))
    table = np.zeros(size // 8, dtype=np.uint8)
    for r in parts.toLocalIterator():
        table[(r["part"] - 1) * 4096:r["part"] * 4096] = np.frombuffer(r["bits"], dtype=np.uint8)
    return table


def _same_words(grams: Grams, data: np.ndarray) -> np.ndarray:
    """A number for each word of a block, equal for equal words only: hashes, held against the bytes."""
    _, first, code = np.unique(grams.hashes, return_index=True, return_inverse=True)
    size, other = grams.ends - grams.starts, first[code]
    same = size == size[other]
    padded = np.concatenate((data, np.zeros(8, dtype=np.uint8)))
    eights = np.ndarray((len(data) + 1,), dtype="<u8", buffer=padded, strides=(1,))
    left = np.flatnonzero(same & (other != np.arange(len(other))))
    for off in range(0, int(size.max(initial=0)), 8):
        left = left[size[left] > off]
        if not len(left):
            break
        unlike = eights[grams.starts[left] + off] ^ eights[grams.starts[other[left]] + off]
        tail = np.minimum(size[left] - off, 8).astype(U)
        equal = unlike & (U((1 << 64) - 1) >> (U(64) - tail * U(8))) == 0
        same[left[~equal]] = False
        left = left[equal]
    if not same.all():
        odd = {}
        for i in np.flatnonzero(~same).tolist():
            code[i] = odd.setdefault(data[grams.starts[i]:grams.ends[i]].tobytes(), len(first) + len(odd))
    return code


def _texts(grams: Grams, data: np.ndarray, at: np.ndarray, n: int) -> pa.Array:
    """The phrases of ``n`` words that start at the words ``at``, one blank between words."""
    words = (at[:, None] + np.arange(n)).reshape(-1)
    last = np.arange(len(words)) % n == n - 1
    sizes = grams.ends[words] - grams.starts[words] + ~last
    ends = np.cumsum(sizes)
    body = data[np.arange(sizes.sum()) + np.repeat(grams.starts[words] - ends + sizes, sizes)]
    body[ends[~last] - 1] = 0x20
    offsets = np.concatenate(([0], ends[last])).astype(np.int32)
    return pa.Array.from_buffers(pa.string(), len(at), [None, pa.py_buffer(offsets), pa.py_buffer(body)])


def _phrases(tables: list[np.ndarray]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The selected n-grams as text, with their numbers in a block and a pointer to the first of them."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader()
        for batch in batches:
            langs = pc.fill_null(batch.column(1), UNKNOWN)
            seeds = _lang_seeds(langs.to_pylist())
            lang_of = pc.dictionary_encode(langs).indices.to_numpy()
            for block in reader.blocks(batch.column(2), VERIFIED):
                grams = reader.grams(block, seeds, tables, LONGEST, LONGEST)
                codes = _same_words(grams, block.data)
                begins = block.base - np.concatenate(([0], block.ends[:-1]))
                for n, (at, prints) in enumerate(grams.found, 1):
                    if not len(at):
                        continue
                    _, first, group = np.unique(prints, return_index=True, return_inverse=True)
                    pointer = at[first][group]
                    same = lang_of[block.rows[grams.text[at]]] == lang_of[block.rows[grams.text[pointer]]]
                    for k in range(n):
                        same &= codes[at + k] == codes[pointer + k]
                    out = np.concatenate((at[first], at[~same]))
                    counts = np.concatenate((np.bincount(group, weights=same).astype(np.int64), np.ones(len(out) - len(first), dtype=np.int64)))
                    for low in range(0, len(out), SPELLED):
                        some = out[low:low + SPELLED]
                        texts = grams.text[some]
                        rows = pa.array(block.rows[texts])
                        columns = [langs.take(rows), _texts(grams, block.data, some, n), pa.array(counts[low:low + SPELLED]), batch.column(0).take(rows), pa.array(begins[texts] + grams.starts[some])]
                        yield pa.RecordBatch.from_arrays(columns, ["lang", "phrase", "n", "first_doc", "first_byte"])

    return run


def frequent_phrases(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> tuple[DataFrame, DataFrame]:
    """lang, phrase, words, n, first_doc, first_byte of all phrases of up to four words that occur often enough; and (lang, total) of all words."""
    column = lambda c, t: F.col(f"`{c}`").cast(t)
    source = docs.select(column(doc_id, "bigint").alias("doc_id"), column(lang, "string").alias("lang"), column(text, "string").alias("text"))
    summed = lambda lengths, tables: source.mapInArrow(_counted(lengths, _sent(source.sparkSession, tables)), FINGERPRINTS).groupBy("lang", "fingerprint").agg(F.sum("n").alias("n"))
    words = materialise(summed((1,), []), "phrase-words")
    totals = words.groupBy("lang").agg(F.sum("n").alias("total"))
    tables = [bit_table(words.where(F.col("n") >= MIN_COUNT))]
    pairs = materialise(summed((2,), tables).where(F.col("n") >= MIN_COUNT), "phrase-pairs")
    tables.append(bit_table(pairs))
    longer = materialise(summed((3, 4), tables).where(F.col("n") >= MIN_COUNT), "phrase-longer")
    tables += [bit_table(longer)] * 2
    found = source.mapInArrow(_phrases(_sent(source.sparkSession, tables)), "lang string, phrase string, n bigint, first_doc bigint, first_byte bigint")
    counted = found.groupBy("lang", "phrase").agg(F.sum("n").alias("n"), F.min("first_doc").alias("first_doc"), F.min_by("first_byte", "first_doc").alias("first_byte")).where(F.col("n") >= MIN_COUNT)
    return materialise(counted.select("lang", "phrase", F.size(F.split("phrase", " ")).alias("words"), "n", "first_doc", "first_byte"), "phrases"), totals


def _sent(spark: SparkSession, tables: list[np.ndarray]):
    """Tables as tasks get them: once per executor, not once per task."""
    return Shared(spark.sparkContext.broadcast(tables))


class Shared:
    """A list whose items come out of a broadcast."""

    def __init__(self, sent):
        self.sent = sent

    def __getitem__(self, i):
        return self.sent.value[i]

    def __len__(self):
        return len(self.sent.value)


def _part(first: Column, count: Column) -> Column:
    """``count`` words of a phrase from the one numbered ``first`` (from 1)."""
    return F.array_join(F.slice(F.split("phrase", " "), first, count), " ")


def scored(phrases: DataFrame) -> DataFrame:
    """Candidates with their lowest-scoring cut: lang, phrase, words, a, l, r, score, first_doc, first_byte."""
    long = phrases.where("words > 1")
    cuts = long.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("words") - 1)))
    cuts = cuts.select("lang", "phrase", "words", F.col("n").alias("a"), "first_doc", "first_byte", "k", _part(F.lit(1), F.col("k")).alias("head"), _part(F.col("k") + 1, F.col("words") - F.col("k")).alias("rest"))
    of = lambda name, n: phrases.select("lang", F.col("phrase").alias(name), F.col("n").alias(n))
    both = cuts.join(of("head", "l"), ["lang", "head"]).join(of("rest", "r"), ["lang", "rest"])
    score = F.expr(f"CAST({SCALE} AS DECIMAL(18, 0)) * CAST(a AS DECIMAL(19, 0)) DIV (CAST(l AS DECIMAL(20, 0)) + CAST(r AS DECIMAL(20, 0)))")
    lowest = F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("cut")
    return both.groupBy("lang", "phrase", "words", "a", "first_doc", "first_byte").agg(lowest).select("lang", "phrase", "words", "a", "cut.l", "cut.r", "cut.score", "first_doc", "first_byte")


def uncovered(candidates: DataFrame) -> DataFrame:
    """``candidates`` without those that nearly always stand inside one longer candidate."""
    inside = candidates.where("words > 2").withColumn("size", F.explode(F.sequence(F.lit(2), F.col("words") - 1)))
    inside = inside.withColumn("at", F.explode(F.sequence(F.lit(1), F.col("words") - F.col("size") + 1)))
    most = inside.select("lang", _part(F.col("at"), F.col("size")).alias("phrase"), F.col("a").alias("_a")).groupBy("lang", "phrase").agg(F.max("_a").alias("_most"))
    share = lambda n, percent: F.col(n).cast("decimal(19,0)") * percent
    kept = F.col("_most").isNull() | (share("_most", 100) < share("a", COVERED_PERCENT))
    return candidates.join(most, ["lang", "phrase"], "left").where(kept).drop("_most")


def collocations(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", top: int = TOP) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score, first_doc, first_byte: the first ``top`` phrases of each language."""
    phrases, totals = frequent_phrases(docs, doc_id, text, lang)
    kept = uncovered(materialise(scored(phrases), "collocations"))
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    part = F.pmod(F.hash("phrase"), F.lit(PARTS))
    heads = kept.withColumn("_rank", F.row_number().over(Window.partitionBy("lang", part).orderBy(*order))).where(F.col("_rank") <= top)
    ranked = heads.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("bigint")).where(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", F.col("total").alias("n"), "score", "first_doc", "first_byte")
