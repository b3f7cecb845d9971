import random
from collections import Counter

import numpy as np

from tidemark.llm import graph, near
from tidemark.llm import words as W


def brute(spark, docs, least):
    """Components over all pairs, by the definition."""
    idf = near.idf_table(spark.createDataFrame(docs, "doc_id long, text string"))
    sets = []
    for _, t in docs:
        data = (t or "").encode()
        row, s, w = near.shingles(W.split(np.frombuffer(data, np.uint8), np.array([0, len(data)])), idf)
        sets.append(dict(zip(s.tolist(), w.astype(float).tolist(), strict=True)))
    label = list(range(len(docs)))

    def top(x):
        while label[x] != x:
            x = label[x]
        return x

    for i in range(len(docs)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if a and b:
                inter = sum(min(a[k], b[k]) for k in a.keys() & b.keys())
                union = sum(max(a.get(k, 0), b.get(k, 0)) for k in a.keys() | b.keys())
                if inter / union >= least:
                    label[top(i)] = top(j)
    least_key = {}
    for i, (k, _) in enumerate(docs):
        least_key[top(i)] = min(least_key.get(top(i), k), k)
    return [(k, least_key[top(i)]) for i, (k, _) in enumerate(docs)]


def test_against_brute_force(spark):
    rng = random.Random(11)
    words = [f"w{k}" for k in range(400)]
    docs = []
    for _ in range(40):
        base = [rng.choice(words) for _ in range(rng.choice([3, 5, 30, 150]))]
        docs.append(" ".join(base))
        for _ in range(rng.choice([0, 0, 1, 3, 25])):
            own = list(base)
            for _ in range(max(1, len(own) // 60)):
                own[rng.randrange(len(own))] = rng.choice(words)
            docs.append(rng.choice([" ", "  ", "\n"]).join(own))
    docs = list(enumerate(docs))
    rng.shuffle(docs)
    want = brute(spark, docs, 0.8)
    got = near.classes(spark.createDataFrame(docs, "doc_id long, text string").repartition(5)).collect()
    same = sum((r.doc_id, r.class_id) in set(want) for r in got)
    assert same >= 0.99 * len(docs)  # sampled bands may miss a pair right at the threshold
    assert all(r.kept == (r.doc_id == r.class_id) for r in got)
    assert len({c for _, c in want}) >= 0.99 * sum(r.kept for r in got)


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, "!!"), (4, "a b"), (5, "A, b."), (6, "a c"), (None, "a b"), (None, "x y z"), (None, None), (7, "q " * 50_000), (8, "q " * 50_001), (9, "one two three four five six"), (9, "one two three four five six"), (9, "other words entirely in this one")]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, print string, key int")
    got = Counter((r.doc_id, r.class_id) for r in near.classes(df).collect())
    assert got == Counter({(1, 1): 1, (2, 2): 1, (3, 3): 1, (4, 4): 1, (5, 4): 1, (6, 6): 1, (None, 4): 1, (None, None): 2, (7, 7): 1, (8, 7): 1, (9, 9): 3})
    assert near.classes(df.limit(0)).count() == 0


def test_components(spark):
    links = [(1, 2), (2, 3), (5, 4), (6, 6)] + [(100 + k, 101 + k) for k in range(40)]
    df = spark.createDataFrame(links, "a long, b long")
    nodes = spark.createDataFrame([(x,) for p in links for x in p] + [(9,)], "node long")
    got = dict(map(tuple, graph.components(nodes, df).collect()))
    assert got == {1: 1, 2: 1, 3: 1, 4: 4, 5: 4, 6: 6, 9: 9} | {k: 100 for k in range(100, 141)}


def families(count: int, of: int) -> list[tuple[int, str]]:
    """Families that share a template, so that all meet in the same buckets though only members of one are alike."""
    rng = random.Random(5)
    words = [f"w{k}" for k in range(3_000)]
    template = [rng.choice(words) for _ in range(200)]
    docs = []
    for _ in range(count):
        base = template + [rng.choice(words) for _ in range(45)]
        for _ in range(of):
            own = list(base)
            for _ in range(2):
                own[rng.randrange(len(own))] = rng.choice(words)
            docs.append(" ".join(own))
    return list(enumerate(docs))


def test_families_of_one_template(spark, monkeypatch):
    monkeypatch.setattr(near, "TURNS", 1)  # hubs settle one family a bucket, the rest is left to the last turn
    docs = families(60, 3)
    want = brute(spark, docs, 0.8)
    assert len({c for _, c in want}) == 60
    got = near.classes(spark.createDataFrame(docs, "doc_id long, text string").repartition(5)).collect()
    assert sorted((r.doc_id, r.class_id) for r in got) == sorted(want)
