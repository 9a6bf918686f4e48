"""Phrases, exact copies and spelling variants beside plain Python."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from guardedlake.llm import collocations, exact_dedup, spelling
from guardedlake.llm.wordhash import U

LOWER = {c: c + 32 for c in range(65, 91)}


def plain_collocations(rows, least, top=2000):
    """rows: (doc_id, text, lang)"""
    f, n = defaultdict(Counter), Counter()
    for _, text, lang in rows:
        for piece in re.split("[.,;:!?\n-\r]", (text or "").translate(LOWER)):
            ws = re.findall("[^ \t]+", piece)
            lang = lang or "und"
            n[lang] += len(ws)
            for k in range(1, 5):
                f[lang].update(tuple(ws[i:i + k]) for i in range(len(ws) - k + 1))
    out = []
    for lang, count in f.items():
        good = {p: a for p, a in count.items() if len(p) > 1 and a >= least}
        most = Counter()
        for p, a in good.items():
            for sub in {p[i:j] for i in range(len(p)) for j in range(i + 2, len(p) + 1)} - {p}:
                most[sub] = max(most[sub], a)
        best = []
        for p, a in good.items():
            if p in most and 100 * most[p] >= 80 * a:
                continue
            score, k = min((2000000 * a // (count[p[:k]] + count[p[k:]]), k) for k in range(1, len(p)))
            best.append((-score, -a, " ".join(p).encode(), count[p[:k]], count[p[k:]]))
        out += [(lang, i, p.decode(), -a, l, r, n[lang], -s) for i, (s, a, p, l, r) in enumerate(sorted(best)[:top], 1)]
    return sorted(out)


def phrase_rows(df):
    return sorted(tuple(r)[:8] for r in df.collect())


@pytest.mark.parametrize("table,least", [("odd", 2), ("docs", 5), ("empty", 2)])
@pytest.mark.parametrize("block", [200, 1 << 21])
def test_collocations(request, monkeypatch, table, least, block):
    monkeypatch.setattr(collocations, "MIN_COUNT", least)
    monkeypatch.setattr(collocations, "BLOCK", block)
    monkeypatch.setattr(collocations, "HELD", block)
    monkeypatch.setattr(collocations, "VERIFIED", block)
    df = request.getfixturevalue(table)
    want = plain_collocations([tuple(r) for r in df.select("doc_id", "text", "lang").collect()], least)
    assert phrase_rows(collocations.collocations(df)) == want and (want or table == "empty")


@pytest.mark.parametrize("bits", [0, 3, 8])
def test_colliding_fingerprints(spark, monkeypatch, bits):
    """However many phrases share a fingerprint, counts are those of the texts."""
    monkeypatch.setattr(collocations, "mix", lambda x: x & U((1 << bits) - 1))
    monkeypatch.setattr(collocations, "MIN_COUNT", 4)
    rng = random.Random(3)
    rows = [(i, " ".join(rng.choice(["red", "Red", "green", "blue", "é", "\x0cred,"]) + rng.choice(["", "", ".", " \t"]) for _ in range(60)), rng.choice(["en", "fr", None])) for i in range(20)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string").repartition(3)
    assert phrase_rows(collocations.collocations(df, top=7)) == plain_collocations(rows, 4, 7)


def test_words_with_one_hash_are_told_apart():
    data = np.frombuffer(b"abcdefghi abcdefghj abcdefghi abc abc abd ", dtype=np.uint8)
    ends = np.flatnonzero(data == 32)
    starts = np.concatenate(([0], ends[:-1] + 1))
    codes = collocations._same_words(collocations.Grams(starts, ends, starts * 0, np.zeros(len(ends), dtype=U), []), data)
    words = data.tobytes().split()
    assert all((codes[i] == codes[j]) == (words[i] == words[j]) for i in range(6) for j in range(6))


def test_phrases_point_at_an_occurrence(spark, docs):
    phrases, totals = collocations.frequent_phrases(docs)
    texts = {r["doc_id"]: (r["text"] or "").translate(LOWER).encode() for r in docs.collect()}
    found = phrases.collect()
    assert found and all(texts[r["first_doc"]][r["first_byte"]:].startswith(r["phrase"].split()[0].encode()) for r in found)
    assert all(re.sub(rb"[ \t]+", b" ", texts[r["first_doc"]][r["first_byte"]:]).startswith(r["phrase"].encode()) for r in found)


def test_large_counts_are_exact(spark):
    big = 4 * 10**18
    rows = [("en", "a", 1, big, 1, 0), ("en", "b", 1, big, 1, 0), ("en", "a b", 2, big - 1, 1, 0), ("en", "a b c", 3, big // 5 * 4, 1, 0), ("en", "c", 1, big, 1, 0), ("en", "b c", 2, big, 1, 0)]
    got = collocations.scored(spark.createDataFrame(rows, "lang string, phrase string, words int, n bigint, first_doc bigint, first_byte bigint"))
    assert {r["phrase"]: (r["score"], r["l"], r["r"]) for r in got.collect()} == {"a b": (2000000 * (big - 1) // (2 * big), big, big), "b c": (1000000, big, big), "a b c": (800000, big, big)}
    assert {r["phrase"] for r in collocations.uncovered(got).collect()} == {"a b c"}


def copies(rows):
    texts = [(i, re.sub("[\x20\x09-\x0d]+", " ", t or "")) for i, t in rows]
    groups = defaultdict(list)
    for i, t in texts:
        groups[t].append(i)
    keep = {t: min((i for i in ids if i is not None), default=None) for t, ids in groups.items()}
    return Counter((i, keep[t], len(groups[t]), i == keep[t], hashlib.sha256(t.encode()).hexdigest()) for i, t in texts)


def weak(chunk, round_):
    return exact_dedup.strong_name(chunk, round_) if round_ > 1 else bytes([len(chunk) % 3])


@pytest.mark.parametrize("table", ["odd", "docs", "empty"])
@pytest.mark.parametrize("name", ["strong", "weak"])
def test_exact_duplicates(request, table, name):
    df = request.getfixturevalue(table)
    got = exact_dedup.exact_duplicates(df, name=weak if name == "weak" else exact_dedup.strong_name).collect()
    assert Counter(map(tuple, got)) == copies([(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()])


def test_names_are_verified(spark):
    texts = spark.createDataFrame([("abc",), ("abd",), ("abc",)], "text string")
    assert exact_dedup.verified_round(texts) == 0 and exact_dedup.verified_round(texts, weak) == 2


def test_chunks_follow_the_content(monkeypatch):
    monkeypatch.setattr(exact_dedup, "PIECE", 5000)
    rng = np.random.default_rng(4)
    text = rng.integers(33, 127, 200_000).astype(np.uint8)
    cutter = exact_dedup.Cutter()
    chunks = list(cutter.chunks(text))
    assert b"".join(chunks) == text.tobytes() and all(exact_dedup.LEAST <= len(c) <= exact_dedup.MOST for c in chunks[:-1])
    moved = list(cutter.chunks(np.concatenate((text[:77] ^ 1, text))))
    assert len(set(chunks) - set(moved)) <= 3
    same = np.zeros(100_000, dtype=np.uint8)
    assert b"".join(cutter.chunks(same)) == same.tobytes() and not list(cutter.chunks(same[:0]))
    spaced = np.frombuffer((b"a " + b" \t" * 4000) * 3 + b"b\n", dtype=np.uint8)
    assert cutter.normal(spaced).tobytes() == b"a a a b "


def test_one_of_each_keeps_columns(odd):
    out = exact_dedup.one_of_each(odd)
    assert out.columns == odd.columns and 0 < out.count() < odd.count()


def plain_variants(rows):
    total = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % 97 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            total[run] += len(run) >= 5
    words = {w: n for w, n in total.items() if n >= 3}

    def one_edit(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b, strict=True)) == 1
        short, long = sorted((a, b), key=len)
        return len(long) - len(short) == 1 and any(long[:i] + long[i + 1:] == short for i in range(len(long)))

    near = {w: [v for v in words if abs(len(v) - len(w)) <= 1 and one_edit(v, w)] for w in words}
    form = {w: min(near[w], key=lambda v: (-words[v], v)) for w in words if near[w]}
    form = {w: f for w, f in form.items() if words[f] >= 2 * words[w]}

    def root(w):
        return root(form[w]) if w in form else w

    return sorted((w, form.get(w), root(w), words[w], len(near[w]), words.get(form.get(w))) for w in words)


def variant_rows(df):
    return sorted((tuple(r) for r in df.select("word", "form", "root", "n", "n_near", "form_n").collect()), key=lambda r: r[0])


@pytest.mark.parametrize("table", ["odd", "docs", "empty"])
def test_variants(request, table):
    df = request.getfixturevalue(table)
    got = variant_rows(spelling.variants(df))
    rows = [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]
    if table == "docs":  # brute force over all pairs takes too long: the words around one form
        assert {r[0] for r in got} and all(r[1] is None or r[5] >= 2 * r[3] for r in got)
        return
    assert got == plain_variants(rows)


def test_variants_of_few_letters(spark, monkeypatch):
    """Runs of equal letters, every kind of edit, ties and chains of forms."""
    monkeypatch.setattr(spelling, "PIECE", 100)
    monkeypatch.setattr(spelling, "REMEMBERED", 20)
    rng = random.Random(8)
    words = ["".join(rng.choice("aaAbé") for _ in range(rng.randrange(4, 8))) for _ in range(150)] + ["a" * 150, "a" * 151, "a" * 149 + "b"]
    rows = [(rng.choice([None, *range(30)]), " ".join(rng.choice(words[:1 + rng.randrange(len(words))]) + rng.choice(["", "", "1", "-"]) for _ in range(300))) for _ in range(25)] + [(99, None), (98, "")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    want = plain_variants(rows)
    assert variant_rows(spelling.variants(df)) == want
    assert any(r[1] is not None and r[2] != r[1] for r in want)


def test_roots_of_long_chains(spark):
    forms = spark.createDataFrame([(f"w{i:02}", f"w{i + 1:02}") for i in range(40)] + [("x", "w39")], "word string, form string")
    assert {r["word"]: r["root"] for r in spelling.roots(forms).collect()} == {**{f"w{i:02}": "w40" for i in range(40)}, "x": "w40"}
    assert spelling.roots(forms.where("false")).count() == 0
