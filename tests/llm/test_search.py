import random

import numpy as np
import pytest

from tests.oracle import compare
from tidemark.llm import catalog, decontaminate, topk


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_oracle(spark, con, name):
    assert compare(spark, con, name) == ""


def _brute(rows, k, every):
    out = set()
    for q, v in rows:
        if q % every == 0:
            near = sorted((-int(np.dot(v, w)), i) for i, w in rows if i != q)[:k]
            out |= {(q, r + 1, i, -s) for r, (s, i) in enumerate(near)}
    return out


@pytest.mark.parametrize("big", [1, 10**9])
def test_topk_against_brute_force(spark, monkeypatch, big):
    monkeypatch.setattr(topk, "SHARD_ROWS", 7)
    monkeypatch.setattr(topk, "BLOCK_ROWS", 3)
    monkeypatch.setattr(topk, "TILE_VECTORS", 4)
    rng = random.Random(5)
    rows = [(i, [rng.randrange(-2, 3) * big for _ in range(3)]) for i in range(150)]
    df = spark.createDataFrame([(i, [float(x) for x in v], "z") for i, v in rows], "vec_id long, embedding array<double>, score string")
    got = {tuple(r) for r in topk.nearest(df.union(df.limit(40)), 5, scale=1.0, every=10).collect()}
    assert got == _brute(rows, 5, 10)


def test_topk_odd_rows(spark):
    nan = float("nan")
    rows = [(0, [1.0, 2.0]), (20, None), (40, [1.0, None]), (60, [nan, 0.0]), (80, [1.0]), (1, [0.5, 0.5]), (None, [1.0, 1.0]), (2, [-0.5, 0.01])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    assert sorted(map(tuple, topk.nearest(df).collect())) == [(0, 1, 1, 64 * 32 + 128 * 32), (0, 2, 2, 64 * -32 + 0)]
    assert topk.nearest(df.limit(0)).count() == 0


def test_wu_manber_against_brute_force(spark):
    rng = random.Random(3)
    words = ["a", "b", "c", "dé", "E9"]
    text = lambda n: "".join(rng.choice(words) + rng.choice([" ", "--", "\n"]) for _ in range(n))
    items = [(i, text(rng.choice([0, 1, 3, 4, 6]))) for i in range(12)] + [(3, "a b c a b"), (None, "c c c c c"), (99, None)]
    docs = [(i, text(rng.randrange(60))) for i in range(80)] + [(7, None), (None, "a b"), (7, "x y z")]

    def split(t):
        out, cur = [], ""
        for ch in (t or "").translate({c: c + 32 for c in range(65, 91)}) + " ":
            if ch.isdigit() or "a" <= ch <= "z" or ch > "\x7f":
                cur += ch
            elif cur:
                out.append(cur)
                cur = ""
        return out

    want = []
    for i, t in docs:
        w, hit, named = split(t), set(), set()
        for item, it in items:
            iw = split(it)
            n = min(4, len(iw))
            for k in range(len(iw) - n + 1 if iw else 0):
                for a in range(len(w) - n + 1):
                    if w[a : a + n] == iw[k : k + n]:
                        hit |= set(range(a, a + n))
                        named |= {str(item)} if item is not None else set()
        want.append((i, len(w), len(hit), tuple(sorted(named)), bool(hit)))
    d = spark.createDataFrame([(i, t, "q") for i, t in docs], "doc_id long, text string, items string")
    b = spark.createDataFrame(items, "item_id long, text string")
    for block in (1 << 24, 300):
        got = decontaminate.contamination(d, b, 4, block_bytes=block).collect()
        key = lambda r: repr(r)
        assert sorted(((r.doc_id, r.n_words, r.n_hit, tuple(r["items"]), r.contaminated) for r in got), key=key) == sorted(want, key=key)
    assert decontaminate.contamination(d.limit(0), b).count() == 0
    assert not any(r.contaminated for r in decontaminate.contamination(d, b.limit(0)).collect())
