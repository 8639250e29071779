"""Similarity join, substring dedup and neighbours against brute force, and their edge cases."""

import hashlib
import random
import re

import numpy as np
import pytest

from keytide.llm import ann, jaccard, substrings
from keytide.llm.components import components

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def near_copies(seed, groups=2, each=14):
    rnd = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(300)]
    rows = []
    for _ in range(groups):
        base = [rnd.choice(vocabulary) for _ in range(rnd.choice([30, 70]))]
        for _ in range(each):
            w = list(base)
            for _ in range(rnd.randrange(0, 6)):
                j = rnd.randrange(len(w))
                w[j : j + rnd.randrange(2)] = [rnd.choice(vocabulary[:20])]
            rows.append((len(rows), " ".join(w)))
    rows += [(1000 + i, " ".join(rnd.choice(vocabulary) for _ in range(rnd.randrange(0, 50)))) for i in range(15)]
    return rows + [(2000, None), (2001, ""), (2002, "Same TEXT"), (2003, "same\ttext"), (2004, "one"), (2004, "one"), (None, rows[0][1])]


def brute_components(rows, k, num, den):
    sets = {}
    for i, t in rows:
        w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()
    label = {i: i for i in sets if i is not None}
    ids = sorted(label)
    changed = True
    pairs = [(a, b) for a in ids for b in ids if a < b and sets[a] and sets[b] and den * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b])]
    while changed:
        changed = False
        for a, b in pairs:
            low = min(label[a], label[b])
            if label[a] != low or label[b] != low:
                label[a] = label[b] = low
                changed = True
    return {i: (len(s), label.get(i)) for i, s in sets.items()}


@pytest.mark.parametrize(("k", "num", "den", "hot"), [(3, 9, 10, 128), (5, 4, 5, 10)])
def test_jaccard_components(spark, docs, monkeypatch, k, num, den, hot):
    monkeypatch.setattr(jaccard, "HOT", hot)
    rows = near_copies(k)
    out = jaccard.joined(docs(rows), k=k, num=num, den=den).collect()
    assert len(out) == len(rows)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in out} == brute_components(rows, k, num, den)


def edited(seed, n, words, edits):
    """n copies of one text, each with a few words of its own in random places, none of them the text itself."""
    rnd = random.Random(seed)
    base = [f"b{i}" for i in range(words)]
    out = []
    for i in range(n):
        w = list(base)
        for j in rnd.sample(range(words), rnd.randrange(1, edits)):
            w[j] = f"x{i}_{j}" if rnd.random() < 0.7 else f"y{j}"
        out.append(" ".join(w))
    return out


@pytest.mark.parametrize(("k", "num", "den"), [(3, 9, 10), (5, 4, 5)])
def test_jaccard_of_large_groups(spark, docs, monkeypatch, k, num, den):
    """A group above HOT without pairing it out, and small sets beside it; both halves of the join get sets."""
    texts = edited(3, jaccard.HOT + 40, 120, 12) + [t for s in range(12) for t in edited(s + 50, 4, 14 + s, 2)]
    rows = [(i, t) for i, t in enumerate(texts)]
    seen = {}
    boundary, subsets, pairs = jaccard.boundary_by_cost, jaccard.subset_keys, jaccard.verified
    monkeypatch.setattr(jaccard, "boundary_by_cost", lambda lists, shared: seen.setdefault("boundary", boundary(lists, shared)))
    monkeypatch.setattr(jaccard, "subset_keys", lambda small, size: [out := subsets(small, size), seen.update(subsets=out.count())][0])
    monkeypatch.setattr(jaccard, "verified", lambda p, *a, **b: seen.setdefault("pairs", []).append(p.count()) or pairs(p, *a, **b))
    out = jaccard.joined(docs(rows), k=k, num=num, den=den).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in out} == brute_components(rows, k, num, den)
    assert seen["boundary"] > 0 and seen["subsets"] > 0
    assert sum(seen["pairs"]) < (jaccard.HOT + 40) ** 2 / 2 + 400


def test_subsets_of_fixed_size(spark):
    keys = [{"key": x, "core": x != 7} for x in (9, 7, 5, 3)]
    small = spark.createDataFrame([(0, 1, 10, 4, k["key"], k["core"]) for k in keys] + [(0, 2, 10, 4, x, True) for x in (3, 5, 9, 11)] + [(0, 3, 10, 2, x, True) for x in (3, 5)], "band int, id long, n long, q int, key long, core boolean")
    got = {}
    for r in jaccard.subset_keys(small, 3).collect():
        got.setdefault(r["id"], {})[r["key"]] = r["core"]
    assert len(got[1]) == len(got[2]) == 4 and 3 not in got
    assert sorted(got[1].values()) == [False] * 3 + [True] and len(got[1].keys() & got[2].keys()) == 1


def test_jaccard_of_empty_table(spark, docs):
    assert jaccard.joined(docs([])).count() == 0


def test_components_of_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 130)] + [(7, 7), (None, 3), (5, 4), (5, 4)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {i: 100 for i in range(100, 130)}


def brute_windows(rows, window):
    first = {}
    split = [(i, WORD.findall(t or "")) for i, t in rows]
    for i, w in split:
        for j in range(len(w) - window + 1):
            key = tuple(w[j : j + window])
            first[key] = min(first.get(key, np.inf), np.inf if i is None else i)
    for i, w in split:
        out = [False] * len(w)
        for j in range(len(w) - window + 1):
            if first[tuple(w[j : j + window])] < (np.inf if i is None else i):
                out[j : j + window] = [True] * window
        yield i, len(w), sum(out), " ".join(x for x, o in zip(w, out) if not o)


@pytest.mark.parametrize("fan_in", [1, 128])
def test_substring_dedup(spark, docs, monkeypatch, fan_in):
    monkeypatch.setattr(substrings, "FAN_IN", fan_in)
    rnd = random.Random(4)
    say = lambda n: [rnd.choice("abcdefghij") for _ in range(n)]
    passage, long = say(60), say(400)
    rows = [(9, " ".join(say(20) + passage + say(30))), (3, " ".join(passage)), (5, " ".join(say(5) + passage[3:55] + say(5))), (4, "\n".join(passage)), (7, " ".join(long)), (8, " ".join(long[100:300])), (6, "x " * 500), (2, "x " * 120)]
    rows += [(20, None), (21, ""), (22, " ".join(passage[:49])), (23, " ".join(passage)), (23, " ".join(passage)), (None, " ".join(passage)), (None, " ".join(long)), (30, "é中 " * 70), (29, "é中 " * 50)]
    out = substrings.deduplicated(docs(rows)).collect()
    have = sorted(map(repr, ((r["doc_id"], r["n_words"], r["n_removed"], r["kept"]) for r in out)))
    assert have == sorted(map(repr, brute_windows(rows, 50)))
    for r in out:
        assert r["n_removed"] == sum(s["last"] - s["first"] + 1 for s in r["spans"])
    whole = {r["doc_id"]: r for r in substrings.deduplicated(docs(rows), whole_rows=True).collect()}
    assert 4 not in whole and whole[3]["text"] == rows[1][1] and whole[20]["text"] is None and whole[9]["key"] == "x"
    assert substrings.deduplicated(docs([])).count() == 0
    assert hashlib.sha256(b"").hexdigest()  # the digest of a text of which nothing is left is that of no bytes


def test_columns_may_have_any_name(spark, docs):
    """Columns of the tables that the operators make for themselves, as columns of the documents."""
    passage = " ".join(f"p{i}" for i in range(60))
    for name in ("_bit", "_ID", "_th", "_runs", "_gid", "id", "th", "key", "row"):
        got = substrings.deduplicated(docs([(1, passage), (2, "a b " + passage)], extra=f"`{name}`"), whole_rows=True)
        assert name in got.columns and {(r["doc_id"], r["text"], r[name]) for r in got.collect()} == {(1, passage, "x"), (2, "a b", "x")}


def test_a_full_sketch_loses_nothing(spark, docs, monkeypatch):
    monkeypatch.setattr(substrings, "MOST_CELLS", 64)
    monkeypatch.setattr(substrings, "LEAST_CELLS", 64)
    rnd = random.Random(5)
    rows = [(i, " ".join(rnd.choice("abcdefgh") for _ in range(90))) for i in range(20)]
    rows += [(100 + i, rows[i][1] + " end") for i in range(5)]
    have = sorted((r["doc_id"], r["n_words"], r["n_removed"], r["kept"]) for r in substrings.deduplicated(docs(rows)).collect())
    assert have == sorted(brute_windows(rows, 50))


def test_sliding_minimum():
    x = np.random.default_rng(1).integers(0, 99, 500).astype(np.uint64)
    for k in (1, 2, 43, 500, 501):
        assert substrings.sliding_min(x, k).tolist() == [int(x[i : i + k].min()) for i in range(len(x) - k + 1)]


def test_queries_get_every_list_within_the_ratio(spark, monkeypatch):
    monkeypatch.setattr(ann, "LIST_SIZE", 2)
    asked = []
    listed = ann.listed
    monkeypatch.setattr(ann, "listed", lambda df, graph, beam, ratio, most: asked.append((graph, ratio, most, out := listed(df, graph, beam, ratio, most))) or out)
    rows = np.random.default_rng(6).normal(size=(1500, 400))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rows)], "vec_id long, embedding array<double>")
    queries = np.random.default_rng(7).normal(size=(15, 400))
    ann.neighbours(df, spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(queries)], df.schema))
    graph, ratio, most, out = asked[-1]
    assert most is None and len(graph.c) == 750
    got = {}
    for r in out.collect():
        got.setdefault(r["qid"], set()).add(r["list"])
    assert set(got) == set(range(15)) and max(map(len, got.values())) > 256
    for q, have in got.items():
        d = np.sqrt(((graph.c - queries[q]) ** 2).sum(axis=1))
        assert have == set(np.flatnonzero(d <= d.min() * ratio + 1e-12).tolist())


def test_neighbours(spark):
    rng = np.random.default_rng(2)
    base = rng.normal(size=(900, 8)).astype(np.float32)
    base[200:500] = base[0]  # one very common vector
    rows = [(i, v.tolist(), "x") for i, v in enumerate(base)]
    rows += [(1000, None, "x"), (1001, [], "x"), (1002, [0.0] * 8, "x"), (1003, [1.0, None] * 4, "x"), (1004, [float("nan")] * 8, "x"), (1005, [1.0, 2.0], "x"), (1006, [float("inf")] * 8, "x"), rows[5]]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, list string")
    got = {}
    for r in ann.neighbours(df, df.where("vec_id % 100 = 0")).collect():
        got.setdefault(r["query_id"], {})[r["rank"]] = (r["score"], r["vec_id"])
    hit = total = 0
    for q in range(0, 900, 100):
        d = np.sqrt(((base.astype(float) - base[q].astype(float)) ** 2).sum(axis=1))
        want = sorted((x, i) for i, x in enumerate(d) if i != q)[:10]
        assert sorted(got[q]) == list(range(1, 11))
        assert [got[q][r] for r in range(1, 11)] == sorted(got[q].values())
        assert all(abs(d[i] - x) < 1e-12 for x, i in got[q].values())
        hit += len({i for _, i in want} & {i for _, i in got[q].values()})
        total += 10
    assert set(got) == set(range(0, 900, 100)) and hit / total >= 0.9
    assert [got[300][r][1] for r in range(1, 11)] == [0, *range(200, 209)]  # ties: the smaller ids
    few = df.where("vec_id < 3")
    assert ann.neighbours(few, few).count() == 6
    assert ann.neighbours(df.limit(0), df.limit(0)).count() == 0
    assert ann.neighbours(df.where("vec_id = 1002"), df).count() == 0
