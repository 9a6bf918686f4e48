"""Near duplicates, repeated substrings and test items beside brute force."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest

from guardedlake.llm import components, decontaminate, suffix_dedup, superminhash


def shingle_set(text, size):
    ws = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(tuple(ws[i:i + size]) for i in range(len(ws) - size + 1)) if len(ws) >= size else frozenset([tuple(ws)] if ws else [])


def grouped(rows, size):
    """Component by id; rows that share an id are one node."""
    parent = {i: i for i, _ in rows if i is not None}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    sets = sorted(((shingle_set(t, size), i) for i, t in rows if i is not None), key=lambda x: len(x[0]))
    for k, (a, i) in enumerate(sets):
        for b, j in sets[k + 1:]:
            if not a or len(a) < 0.8 * len(b):
                continue
            common = len(a & b)
            if 100 * common >= 80 * (len(a) + len(b) - common):
                x, y = root(i), root(j)
                parent[max(x, y)] = min(x, y)
    return {i: root(i) for i in parent}


@pytest.mark.parametrize("table,size", [("odd", 2), ("docs", 2), ("docs", 5), ("empty", 2)])
def test_near_duplicates(request, table, size):
    df = request.getfixturevalue(table)
    rows = [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]
    want = grouped(rows, size)
    got = superminhash.near_duplicates(df, size).collect()
    assert Counter((r["doc_id"], r["n_shingles"]) for r in got) == Counter((i, len(shingle_set(t, size))) for i, t in rows)
    for r in got:
        assert r["component_id"] == (want[r["doc_id"]] if r["doc_id"] is not None else None)
        assert r["kept"] == (r["doc_id"] is None or r["component_id"] == r["doc_id"])


def test_chains_and_unlinked_members(spark):
    """Edits of edits: links that do not touch a bucket's smallest document are found too."""
    rng = random.Random(5)
    base = [f"w{rng.randrange(5000)}" for _ in range(400)]
    rows, texts = [], [base]
    for i in range(60):
        words = list(rng.choice(texts[-12:]))
        for _ in range(rng.randrange(5, 40)):
            words[rng.randrange(len(words))] = f"n{rng.randrange(10**6)}"
        texts.append(words)
    rows = [(i, " ".join(w)) for i, w in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    want = grouped(rows, 2)
    assert {r["doc_id"]: r["component_id"] for r in superminhash.near_duplicates(df, 2).collect()} == want
    assert len(set(want.values())) > 1


def test_ids_of_64_bits(spark):
    text = " ".join(f"w{i}" for i in range(100))
    rows = [(8 * 10**18 + i, text + f" end{i}") for i in range(6)] + [(-9 * 10**18, "another text altogether"), (9 * 10**18, text)]
    got = superminhash.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string"), 2).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == grouped(rows, 2)


def test_many_near_copies_below_the_limit(spark):
    """Copies of one text, each with a fifth or so of its words changed: few are linked, and none to the smallest."""
    rng = random.Random(6)
    base = [f"w{rng.randrange(900)}" for _ in range(120)]
    rows = []
    for i in range(400):
        words = list(base)
        for k in rng.sample(range(120), rng.choice([6, 9, 11, 13])):
            words[k] = f"n{rng.randrange(10**6)}"
        rows.append((i, " ".join(words)))
    rows += [(1000 + i, rows[i][1] + " more") for i in range(0, 400, 7)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    assert {r["doc_id"]: r["component_id"] for r in superminhash.near_duplicates(df, 2).collect()} == grouped(rows, 2)


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(2)
    a = rng.integers(0, 1 << 63, 400, dtype=np.uint64)
    for share in (0.5, 0.8, 0.95):
        n = int(400 * 2 * share / (1 + share))
        b = np.concatenate((a[:n], rng.integers(0, 1 << 63, 400 - n, dtype=np.uint64)))
        s = superminhash.signatures([np.sort(a), np.sort(b), np.sort(a)])
        assert (s[0] == s[2]).all() and abs((s[0] == s[1]).mean() - share) < 0.15
    assert len(np.unique(np.floor(superminhash.signatures([a[:3]])))) >= 2


def test_components(spark):
    edges = [(i, i + 1) for i in range(50)] + [(100, 200), (200, 150), (7, 7)] + [(1000, 1001 + i) for i in range(300)]
    df = spark.createDataFrame(edges, "a bigint, b bigint").repartition(5)
    got = {r["node"]: r["component"] for r in components.components(spark, df).collect()}
    assert all(got[i] == 0 for i in range(51)) and got[150] == got[200] == 100 and all(got[1000 + i] == 1000 for i in range(301))
    assert components.components(spark, df.where("false")).count() == 0


def removed(rows):
    first = {}
    for i, t in sorted(((i, (t or "").encode()) for i, t in rows if i is not None), key=lambda x: x[0]):
        for j in range(len(t) - 49):
            first.setdefault(t[j:j + 50], i)
    out = Counter()
    for i, t in rows:
        b = (t or "").encode()
        gone = np.zeros(len(b), dtype=bool)
        for j in range(len(b) - 49) if i is not None else ():
            if first[b[j:j + 50]] < i:
                gone[j:j + 50] = True
        runs = int((np.diff(np.concatenate(([0], gone.astype(int)))) == 1).sum())
        out[i, len(b), int(gone.sum()), runs, hashlib.sha256(bytes(np.frombuffer(b, np.uint8)[~gone])).hexdigest()] += 1
    return out


@pytest.mark.parametrize("table,block", [("odd", 2_000), ("odd", 1 << 23), ("docs", 100_000), ("empty", 1 << 23)])
def test_repeated_substrings(request, monkeypatch, table, block):
    monkeypatch.setattr(suffix_dedup, "BLOCK_BYTES", block)
    df = request.getfixturevalue(table)
    rows = [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]
    assert Counter(map(tuple, suffix_dedup.remove_repeats(df).collect())) == removed(rows)


@pytest.mark.parametrize("kind", [np.int32, np.int64])
@pytest.mark.parametrize("n", [0, 1, 1000])
def test_closed_lists_open_again(kind, n):
    numbers = np.random.default_rng(n).integers(np.iinfo(kind).min, np.iinfo(kind).max, n, dtype=kind, endpoint=True)
    for x in (numbers, np.sort(numbers)):
        assert np.array_equal(suffix_dedup._open(suffix_dedup._close(x)), x)


def test_sampled_positions_cover_every_string():
    names = suffix_dedup.Names()
    data = np.frombuffer(np.random.default_rng(1).bytes(5000), dtype=np.uint8) % 4
    at = set(names.sampled(data)[0].tolist())
    alone = {i: {p + i for p in names.sampled(data[i:i + 50])[0].tolist()} for i in range(0, 4900, 37)}
    assert all(found and found <= at for found in alone.values())


def plain_words(text):
    return re.findall(r"[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def aligned(item, words):
    best, row = 0, [0] * (len(words) + 1)
    for a in item:
        new = [0]
        for j, b in enumerate(words):
            new.append(max(0, row[j] + (2 if a == b else -1), row[j + 1] - 1, new[-1] - 1))
        best, row = max(best, *new), new
    return best


def aligned_rows(item, words):
    """``aligned`` on whole rows, for long texts."""
    code = {w: k for k, w in enumerate({*item, *words})}
    held, at = np.array([code[w] for w in words], dtype=int), np.arange(len(words) + 1)
    best, row = 0, np.zeros(len(words) + 1, dtype=int)
    for a in item:
        new = np.maximum(np.maximum(row - 1, 0), np.concatenate(([0], row[:-1] + np.where(held == code[a], 2, -1))))
        row = np.maximum.accumulate(new + at) - at
        best = max(best, int(row.max()))
    return best


def test_both_alignments_agree():
    rng = random.Random(8)
    for _ in range(60):
        item, words = ([rng.choice("abcdefgh") for _ in range(n)] for n in (rng.randrange(1, 12), rng.randrange(0, 40)))
        assert aligned_rows(item, words) == aligned(item, words)


def test_survivors_bound_every_copy():
    """No edit of a section leaves fewer of its 3-grams than the bound says, however it is edited."""
    rng = random.Random(9)
    for _ in range(3000):
        n = rng.randrange(3, 40)
        item = [f"w{k}" for k in range(n)]
        copy = []
        change, more = rng.random() * 0.4, rng.random() * 0.9
        for w in item[rng.randrange(1 + n // 4):]:
            if rng.random() >= change:
                copy.append(w)
            elif rng.random() < 0.5:
                copy.append("x")
            copy += ["y"] * (rng.choice((1, 1, 2)) if rng.random() < more else 0)
        if aligned(item, copy) < 2 * n * decontaminate.LEAKED:
            continue
        held = {tuple(copy[i + k] for k in p) for p in decontaminate.PATTERNS for i in range(len(copy) - p[-1])}
        assert len(held & set(zip(item, item[1:], item[2:]))) >= decontaminate.survivors(n)


def edits(item, rng):
    """Copies by kind of edit and step, from those that touch each second word to those that touch few."""
    for step in range(2, 9):
        yield "put in", step, [x for k, w in enumerate(item) for x in ([w, f"in{k}"] if k % step == step - 1 else [w])]
        yield "two put in", step, [x for k, w in enumerate(item) for x in ([w, f"in{k}", "and"] if k % step == step - 1 else [w])]
        yield "changed", step, [f"x{k}" if k % step == step - 1 else w for k, w in enumerate(item)]
        yield "missing", step, [w for k, w in enumerate(item) if k % step != step - 1]
        yield "swapped", step, [item[k + 1] if k % step == 0 and k + 1 < len(item) else item[k - 1] if k % step == 1 and k else w for k, w in enumerate(item)]
        yield "mixed", step, [x for k, w in enumerate(item) if rng.random() > 1 / (3 * step) for x in ([w, "in"] if rng.random() < 1 / step else [f"x{k}"] if rng.random() < 1 / (3 * step) else [w])]


def test_recall_by_kind_of_edit(spark):
    """Every copy that an alignment of all pairs finds is found, whatever the edit; half of each item's grams are common ones."""
    rng = random.Random(10)
    usual = [f"u{k}" for k in range(6)]
    items = {i: [w for k in range(n // 6) for w in (f"i{i}a{k}", f"i{i}b{k}", *usual[:4])] for i, n in enumerate((12, 18, 30, 60, 126))}
    texts, kinds = {}, {}
    for i, item in items.items():
        for kind, step, copy in edits(item, rng):
            kinds[len(texts)] = kind, step
            texts[len(texts)] = ["before", *copy, "after"]
    texts |= {10**4 + k: usual[:4] * 3 + [f"n{k}"] + usual * 20 for k in range(50)}
    df = spark.createDataFrame([(d, " ".join(ws)) for d, ws in texts.items()], "doc_id bigint, text string")
    benchmark = spark.createDataFrame([(i, " ".join(ws)) for i, ws in items.items()], "item_id bigint, text string")
    got = {(r["_id"], r["item_id"]): r["score"] for r in decontaminate.contaminated(df, benchmark).collect()}
    want = {(d, i): round(s, 6) for d, ws in texts.items() for i, item in items.items() if (s := aligned_rows(item, ws) / (2 * len(item))) >= decontaminate.LEAKED}
    by_kind = Counter(kinds[d] for d, _ in want if d in kinds)
    missed = Counter(kinds[d] for d, i in set(want) - set(got) if d in kinds)
    assert {("put in", 2), ("two put in", 3), ("changed", 4), ("missing", 4), ("mixed", 4)} <= set(by_kind)
    assert not missed and got == want


def test_commonest_grams_are_no_seeds(spark):
    """The bound leaves out what most documents hold, and the places of a copy that are left still join it."""
    item = [f"w{k}" for k in range(24)] + ["one", "of", "the", "many"]
    texts = [(1, " ".join(item))] + [(k, "so one of the many things") for k in range(2, 40)]
    df = spark.createDataFrame(texts, "doc_id bigint, text string")
    sections = spark.createDataFrame([(1, 0, 0, list(range(28)))], decontaminate.SECTIONS)
    grams = spark.createDataFrame([(1, 0, 0, k, k, 1, k) for k in range(26)], decontaminate.SEEDS)
    hits = spark.createDataFrame([(24,)] * 40 + [(25,)] * 30 + [(3,)], "gram bigint")
    needs = sections.selectExpr("item_id", "copy", "section", "2 AS need", "2 AS spare")
    assert {r["gram"] for r in decontaminate.rare(grams, hits, needs).collect()} == set(range(24))
    benchmark = spark.createDataFrame([(1, " ".join(item))], "item_id bigint, text string")
    assert [(r["_id"], r["score"]) for r in decontaminate.contaminated(df, benchmark).collect()] == [(1, 1.0)]


def test_contamination(spark, docs, data):
    benchmark = spark.read.parquet(f"{data}/benchmark.parquet")
    items = {r["item_id"]: plain_words(r["text"]) for r in benchmark.collect()}
    pick = max(items, key=lambda i: len(items[i]))
    edited = list(items[pick])
    for k in range(4, len(edited), 7):
        edited[k] = "changed"
    words = "some other words stand before and after what was taken from the test".split()
    extra = [(10**6, " ".join(words + edited[:-2] + words)), (10**6 + 1, " ".join(items[pick][:8] + words)), (10**6 + 2, None), (10**6 + 3, ""), (10**6, " ".join(words + edited[:-2] + words)), (None, " ".join(items[pick]))]
    some = docs.select("doc_id", "text").limit(60).unionByName(spark.createDataFrame(extra, "doc_id bigint, text string"))
    got = {(r["_id"], r["item_id"]): r["score"] for r in decontaminate.contaminated(some, benchmark).collect()}
    want = {}
    for r in some.collect():
        ws = plain_words(r["text"])
        for i, item in items.items():
            if (score := aligned_rows(item, ws) / (2 * len(item))) >= decontaminate.LEAKED:
                want[r["doc_id"], i] = round(score, 6)
    assert got == want and (10**6, pick) in got and (None, pick) in got and (10**6 + 1, pick) not in got


@pytest.mark.parametrize("step", [4, 5])
@pytest.mark.parametrize("copies", [0, 1, 5])
def test_edited_copies_are_found_whatever_else_is_held(spark, step, copies):
    """Most grams of the copy are gone; exact copies elsewhere make those that are left the more common ones."""
    item = [f"w{k}" for k in range(30)]
    edited = [f"x{k}" if k % step == step - 1 else w for k, w in enumerate(item)]
    texts = {1: edited, 2: ["before", *edited, "after"], 3: item[:3] + ["other"] * 9, 4: ["a", "b", "c"], 5: "k a b c k".split()}
    texts |= {10 + c: ["so", *edited[:26], *item] for c in range(copies)} | {20 + c: item for c in range(copies)}
    items = {1: item, 2: ["a", "b", "c"]}
    df = spark.createDataFrame([(i, " ".join(ws)) for i, ws in texts.items()], "doc_id bigint, text string")
    benchmark = spark.createDataFrame([(i, " ".join(ws)) for i, ws in items.items()], "item_id bigint, text string")
    got = {(r["_id"], r["item_id"]): r["score"] for r in decontaminate.contaminated(df, benchmark).collect()}
    want = {(d, i): round(s, 6) for d, ws in texts.items() for i, it in items.items() if (s := aligned(it, ws) / (2 * len(it))) >= decontaminate.LEAKED}
    assert got == want and {(1, 1), (2, 1), (4, 2), (5, 2)} <= set(got)


def test_clean_keeps_columns(spark, odd, data):
    benchmark = spark.read.parquet(f"{data}/benchmark.parquet")
    out = decontaminate.clean(odd, benchmark)
    assert out.columns == odd.columns and out.count() == odd.count()
    assert decontaminate.contaminated(odd.where("false"), benchmark).count() == 0 == decontaminate.contaminated(odd, benchmark.where("false")).count()
