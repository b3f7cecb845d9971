import hashlib
import random
from collections import Counter

import pytest

from tidemark.llm import catalog, repeats

SF = "/root/testdata/sf0.01"


def brute(texts, depth=200):
    raw = [(t or "").encode() for t in texts]
    seen = Counter(hash(b[k : k + depth]) for b in raw for k in range(len(b) - depth + 1))
    out = []
    for b in raw:
        gone = bytearray(len(b))
        for k in range(len(b) - depth + 1):
            if seen[hash(b[k : k + depth])] > 1:
                gone[k : k + depth] = b"\1" * depth
        spans = sum(1 for k in range(len(b)) if gone[k] and (k == 0 or not gone[k - 1]))
        out.append((len(b), sum(gone), spans, hashlib.sha256(bytes(x for x, g in zip(b, gone, strict=True) if not g)).hexdigest()))
    return out


def test_whole_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    want = {(r.doc_id, *x) for r, x in zip(docs, brute([r.text for r in docs]), strict=True)}
    assert {tuple(r) for r in catalog.op2_repeats(spark, SF).collect()} == want


@pytest.mark.parametrize(("most", "segment", "chunk"), [(3_000, 2 << 20, 3 << 19), (3, 700, 2_000)])
def test_against_brute_force(spark, monkeypatch, most, segment, chunk):
    monkeypatch.setattr(repeats, "MOST_SPANS", most)
    monkeypatch.setattr(repeats, "SEGMENT", segment)
    monkeypatch.setattr(repeats, "CHUNK", chunk)
    rng = random.Random(2)
    word = lambda n: "".join(rng.choice("abcdé ") for _ in range(n))
    shared = [word(k) for k in (190, 199, 200, 201, 260, 500, 900)]
    texts = [None, "", "x" * 199, "x" * 200, "y" * 450, word(50), word(3000)]
    for _ in range(60):
        texts.append("".join(word(rng.randrange(90)) + rng.choice(shared) for _ in range(rng.randrange(1, 4))))
    texts += [texts[8], texts[9], texts[9], shared[5] + "tail", "head" + shared[6][100:800], shared[6][:450] + "#" + shared[6][451:]]
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)] + [(None, "z" * 300, 1)], "doc_id long, text string, h int").repartition(6)
    want = Counter((i, *x) for i, x in zip([*range(len(texts)), None], brute([*texts, "z" * 300]), strict=True))
    got = repeats.removed(df).collect()
    assert Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == want
    assert all(sum(r.removed[1::2]) - sum(r.removed[::2]) == r.n_removed for r in got)
    assert repeats.removed(df.limit(0)).count() == 0


def test_suffix_sort_alone():
    rng = random.Random(4)
    spans = [bytes(rng.choice(b"ab") for _ in range(rng.randrange(150, 420))) for _ in range(30)]
    spans += [spans[0][10:290], b"q" * 600, spans[1][:230] + b"z", bytes(7)]
    spans += [pad + long + bytes([k]) for k, (pad, long) in enumerate((b"-" * i, rng.randbytes(200)) for i in range(3)) for _ in (0,)]
    spans += [b"=" * i + s[-201:-1] + b"?" for s in spans[-3:] for i in range(3)]
    twice = [k == 5 for k in range(len(spans))]
    seen = Counter()
    for s, t in zip(spans, twice, strict=True):
        for k in range(len(s) - 199):
            seen[s[k : k + 200]] += 2 if t else 1
    got = repeats.repeated_windows(spans, twice)
    assert [g.tolist() for g in got] == [[seen[s[k : k + 200]] > 1 for k in range(len(s) - 199)] for s in spans]
