"""Spelling variants by permuterm rotations.

Words are counted per task and then overall. A frequent word with an end mark is
rotated to every place. Two words that differ by one replaced letter have rotations that
are the same but for their last letter, the replaced one; and the rotation of a word
without its last letter is a whole rotation of the word without that letter. So each
word gives its whole rotations and its rotations without the last letter; they are
sorted into groups of equal keys, and what stands in a group are neighbours:

* A group of shortened rotations holds words that differ in the skipped letter alone, so
  it has no more members than the alphabet has letters (90), whatever the corpus.
* A whole rotation belongs to one word, and it is a neighbour of all in its group. Of a
  run of equal letters only the first is skipped for this, so a pair is met once.

A group hands each member the number of its neighbours and the best of them, not pairs,
so the work is linear in the number of rotations. Roots are found by pointer doubling:
counts at least double along a chain of forms, so chains are short and never closed.

Defined results: null and empty texts have no words. A null id counts as an empty text
where the id is part of a hash. Repeated rows count each. Very long texts are read piece
by piece; a word of L letters makes 2 L + 1 rows of about 2 L letters. Ties go to the
smallest word in code-point order. An empty table gives an empty result. Other columns
are not read.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from guardedlake.llm.texts import let
from guardedlake.session import materialise

# Fixed values of the contract: letters, the share of occurrences that lose one, and what counts as a word and a form.
LETTERS = r"[A-Za-zÀ-ÿ]+"
LOSES_ONE = 97
MIN_LETTERS, MIN_COUNT = 5, 3
TIMES = 2

END = "$"
PIECE = 1 << 20
REMEMBERED = 200_000


def _runs(text: str, run: re.Pattern[str]) -> Iterator[list[str]]:
    """The runs of letters of a text, some at a time; no run is cut."""
    at = 0
    while at < len(text):
        end = at + PIECE
        if end < len(text) and (more := run.match(text, end)):
            end = more.end()
        yield run.findall(text, at, end)
        at = end


def _word_counts(letters: str, loses_one: int, least: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def batch_of(counts: Counter[str]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(counts.keys()), pa.string()), pa.array(list(counts.values()), pa.int64())], ["word", "n"])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run, total = re.compile(letters), Counter()
        for batch in batches:
            texts = pc.ascii_lower(pc.fill_null(batch.column(1), ""))
            for doc, text in zip(batch.column(0).to_pylist(), texts, strict=True):
                start = zlib.crc32(f"{'' if doc is None else doc}:".encode())
                for words in _runs(text.as_py(), run):
                    for word, n in Counter(words).items():
                        h = zlib.crc32(word.encode(), start)
                        if h % loses_one == 0:
                            at = h % len(word)
                            word = word[:at] + word[at + 1:]
                        if len(word) >= least:
                            total[word] += n
                    if len(total) > REMEMBERED:
                        yield batch_of(total)
                        total = Counter()
        yield batch_of(total)

    return task


def word_counts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """word, n: the words of at least five letters that occur at least three times."""
    source = docs.select(F.col(f"`{doc_id}`").cast("string").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))
    counted = source.mapInArrow(_word_counts(LETTERS, LOSES_ONE, MIN_LETTERS), "word string, n bigint")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= MIN_COUNT)


def rotations(words: DataFrame) -> DataFrame:
    """word, n, key, whole, lead: the rotations of each marked word, whole and without the last letter.

    The one without its last letter is ``lead`` if that letter is the first of its run.
    """
    at, word = F.col("at"), F.col("word")
    size = F.length(word)
    turned = words.withColumn("at", F.explode(F.sequence(F.lit(0), size)))
    letter = F.substring(word, at + 1, F.lit(1))
    head = F.substring(word, F.lit(1), at)
    both = F.array(
        F.struct(F.concat(F.substring(word, at + 1, size), F.lit(END), head).alias("key"), F.lit(True).alias("whole"), F.lit(False).alias("lead")),
        F.when(at < size, F.struct(F.concat(F.substring(word, at + 2, size), F.lit(END), head).alias("key"), F.lit(False).alias("whole"),
                                   ((at == 0) | (letter != F.substring(word, at, F.lit(1)))).alias("lead"))))
    return turned.select("word", "n", F.inline(F.filter(both, lambda r: r.isNotNull())))


def _met(members: Column) -> Column:
    """What each member of a sorted group meets: how many neighbours, and the best of them."""
    best = lambda r: F.struct(r["less"].alias("less"), r["word"].alias("word"))
    nobody = F.lit(None).cast("struct<less:bigint,word:string>")

    def seen(whole: Column, cut: Column, leads: Column) -> Column:
        first, second, short = F.get(cut, F.lit(0)), F.get(cut, F.lit(1)), F.get(whole, F.lit(0))
        of_cut = F.transform(cut, lambda r: F.struct(
            r["word"].alias("word"), (F.size(cut) - 1 + F.when(r["lead"], F.size(whole)).otherwise(0)).alias("n_near"),
            F.least(F.when(first["word"] != r["word"], best(first)).otherwise(F.when(second.isNotNull(), best(second))), F.when(r["lead"] & short.isNotNull(), best(short))).alias("best")))
        of_whole = F.transform(whole, lambda r: F.struct(r["word"].alias("word"), F.size(leads).alias("n_near"), F.when(F.size(leads) > 0, best(F.get(leads, F.lit(0)))).otherwise(nobody).alias("best")))
        return F.concat(of_cut, of_whole)

    return let(F.filter(members, lambda r: r["whole"]), lambda whole: let(F.filter(members, lambda r: ~r["whole"]), lambda cut: let(F.filter(cut, lambda r: r["lead"]), lambda leads: seen(whole, cut, leads))))


def neighbours(words: DataFrame) -> DataFrame:
    """word, n_near, best (less, word): for each word with neighbours their number and the most frequent of them."""
    member = F.struct((-F.col("n")).alias("less"), "word", "whole", "lead")
    groups = rotations(words).groupBy("key").agg(F.array_sort(F.collect_list(member)).alias("members")).where(F.size("members") > 1)
    met = groups.select(F.inline(_met(F.col("members")))).where("n_near > 0")
    return met.groupBy("word").agg(F.sum("n_near").cast("bigint").alias("n_near"), F.min("best").alias("best"))


def roots(forms: DataFrame) -> DataFrame:
    """word, root: where the chain that starts at each (word, form) ends."""
    at = materialise(forms.select("word", F.col("form").alias("root"), F.lit(True).alias("moved")), "roots")
    while not at.where("moved").isEmpty():
        further = at.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        at = materialise(at.join(further, "root", "left").select("word", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("moved")), "roots")
    return at.select("word", "root")


def variants(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per word: word, n, n_near, form, form_n, root."""
    words = materialise(word_counts(docs, doc_id, text), "spelling-words")
    placed = words.join(neighbours(words), "word", "left")
    formed = F.when(-F.col("best.less") >= TIMES * F.col("n"), F.col("best"))
    named = materialise(placed.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"), formed["word"].alias("form"), (-formed["less"]).alias("form_n")), "spelling-forms")
    last = roots(named.where("form IS NOT NULL"))
    return named.join(last, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
