"""The join against all pairs by brute force, in packs, blocks and buckets; recall of the banding; components of graphs."""

import collections
import random
import re

import numpy as np
import pytest

from quarry.llm import ngram_join as J
from quarry.llm.graph import components


def brute(rows, threshold=0.8, n=5):
    sets = []
    for _, text in rows:
        w = re.findall(r"[0-9a-z\x80-\U0010ffff]+", (text or "").lower())
        sets.append({tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else {("no words", text or "")})
    links, up = collections.Counter(), list(range(len(rows)))

    def top(a):
        while up[a] != a:
            a = up[a]
        return a

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if both and both >= threshold * (len(a) + len(sets[j]) - both) - 1e-9:
                links[i] += 1
                links[j] += 1
                up[top(i)] = top(j)
    groups = collections.defaultdict(list)
    for i in range(len(rows)):
        groups[top(i)].append(rows[i][0])
    return sorted((rows[i][0], min(groups[top(i)]), links[i]) for i in range(len(rows)))


def corpus():
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    rows = []
    for g in range(12):
        base = [word() for _ in range(rng.randint(30, 120))]
        for _ in range(rng.choice([1, 1, 2, 3, 9, 25])):
            w = list(base)
            for _ in range(rng.randint(0, 3)):
                w[rng.randrange(len(w))] = word()
            rows.append(" ".join(w))
    rows += ["one two three", "One, two -- three!", "", "", "!!", "a b c d e", "x " * 3000, "x " * 2999, "é è ê ë ē", "É È Ê Ë Ē"]
    return [(i, t) for i, t in enumerate(rows)]


@pytest.mark.parametrize("classes,component", [(1024, 32_768), (7, 32_768), (5, 6)])
def test_join_equals_brute_force(spark, monkeypatch, classes, component):
    monkeypatch.setattr(J, "BLOCK_CLASSES", classes)
    monkeypatch.setattr(J, "COMPONENT_CLASSES", component)
    rows = corpus()
    docs = spark.createDataFrame([(i, t, 0, "x") for i, t in rows], "doc_id int, text string, keep int, class_id string")
    found = J.similar(docs).collect()
    assert sorted((r["_doc"], r["class_id"], r["n_links"]) for r in found) == brute(rows)
    alike = collections.defaultdict(list)
    for i, t in rows:
        w = re.findall(r"[0-9a-z\x80-\U0010ffff]+", t.lower())
        alike[frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else t].append(i)
    assert {r["_doc"]: r["copy_of"] for r in found} == {i: min(own) for own in alike.values() for i in own}


def test_one_of_each_group_stays(spark):
    rows = corpus()
    docs = spark.createDataFrame([(i, t, 0) for i, t in rows] + [(0, rows[0][1], 0)], "doc_id int, text string, _hash int")
    kept = J.keep_one(docs)
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == sorted({c for _, c, _ in brute(rows)})
    nulls = spark.createDataFrame([(None, "a b"), (None, "A b"), (1, None), (2, ""), (None, None)], "doc_id int, text string")
    assert J.keep_one(nulls).count() == 2 and J.similar(nulls).count() == 5
    assert J.similar(docs.limit(0)).count() == 0 and J.keep_one(docs.limit(0)).count() == 0


def test_ties_are_decided_by_the_rows_alone(spark):
    rows = [(1, "a b c", 5, "x"), (1, "a b c", 3, "y"), (1, "a b c", 3, "z"), (2, "A b c", 1, "w"), (7, "other words", 1, "w"), (7, "other words", 1, "w")]
    kinds = "doc_id int, text string, keep int, `dotted.name` string"
    kept = [sorted(map(str, J.keep_one(spark.createDataFrame(given, kinds).repartition(n)).collect())) for n, given in ((1, rows), (4, rows[::-1]))]
    assert kept[0] == kept[1] and len(kept[0]) == 2 and "keep=3" in kept[0][0] and "'y'" in kept[0][0]


def test_recall_on_the_tables(spark, duck):
    """Links of every document against all others."""
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()]
    sets = {i: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} for i, t in rows if (w := re.findall(r"[0-9a-z\x80-\U0010ffff]+", (t or "").lower()))}
    near = lambda a, b: min(len(a), len(b)) >= 0.8 * max(len(a), len(b)) - 1e-9 and len(a & b) >= 0.8 * len(a | b) - 1e-9
    want = {i: sum(j != i and near(s, sets[j]) for j in sets) for i, s in sets.items()}
    got = {r["_doc"]: r["n_links"] for r in J.similar(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).collect()}
    assert sum(want.values()) > 150 and {i: got[i] for i in want} == want


def test_bands_reach_their_recall():
    bands, rows = J.plan_bands(0.8, 0.9999)
    assert bands * rows <= J.PERMUTATIONS and 1 - (1 - 0.8**rows) ** bands >= 0.9999
    rng = np.random.default_rng(1)
    hasher = J.MinHasher(bands, rows)
    missed = 0
    for _ in range(300):
        common, a, b = (rng.integers(0, 1 << 63, k, dtype=np.uint64) for k in (160, 20, 20))  # a similarity of 0.8
        x, y = hasher.signature(np.concatenate([common, a])), hasher.signature(np.concatenate([common, b]))
        missed += not (x == y).any()
    assert missed <= 1


def test_sets_do_not_depend_on_neighbours():
    texts = ["a b c d e f", None, "", "A  b,c d e\nf", "short one", "x" * 5000 + " b c d e"]
    together = J.gram_sets(texts)
    for t, s in zip(texts, together, strict=True):
        assert (J.gram_sets([t])[0] == s).all()
    assert (together[0] == together[3]).all() and len(together[0]) == 2 and len(together[4]) == 1 and len(together[1]) == 0


def test_dense_and_sparse_counts_agree():
    rng = np.random.default_rng(3)
    sets = [np.unique(rng.integers(0, 400, 150).astype(np.uint64)) for _ in range(40)]
    i, j = np.triu_indices(40, 1)
    want = [len(np.intersect1d(sets[a], sets[b])) for a, b in zip(i, j, strict=True)]
    assert J.common_grams(sets, i, j).tolist() == want and J.common_grams(sets, i[:2], j[:2]).tolist() == want[:2]


def test_components(spark):
    rng = random.Random(9)
    edges = [(i, i + 1) for i in range(100, 140)] + [(500, k) for k in range(501, 520)] + [(rng.randrange(50), rng.randrange(50)) for _ in range(30)] + [(7, 7), (None, 3)]
    up = {}

    def top(a):
        up.setdefault(a, a)
        while up[a] != a:
            a = up[a]
        return a

    for a, b in edges:
        if a is not None and a != b:
            x, y = sorted((top(a), top(b)))
            up[y] = x
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a int, b int")).collect()}
    assert got == {a: top(a) for a in up}
    assert components(spark.createDataFrame([], "a int, b int")).count() == 0
