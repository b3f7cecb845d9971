import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from tidemark.llm import catalog, lengths, packing, tokens

SF = "/root/testdata/sf0.01"
ODD = ["", None, "a  b", "a \n b\n\n c ", "\n", "  ", "é\xa0x  12 3", "ABC İx", "it's 'fine", "<|endoftext|> x", "日本 x", "tab\tx \t y", "x" * 50, "ÀÉ  !!?? 12a3", " \n\n\n z", "\x85a\x1cb"]


@pytest.mark.parametrize("name", [tokens.BYTE_BPE, tokens.WORD_BPE])
def test_ids_are_the_librarys(name, monkeypatch):
    monkeypatch.setattr(tokens, "MOST_HELD", 300)
    monkeypatch.setattr(tokens, "PIECE_CHARS", 500)
    rng = random.Random(1)
    coder = tokens.Encoder(tokens.public_tokenizers.path(name), "words" if name == tokens.WORD_BPE else "bytes")
    texts = ODD + ["".join(rng.choice("ab AZ1 2.!\n\té'ñ\xa0") for _ in range(rng.randrange(60))) for _ in range(600)]
    want = [e.ids for e in coder.library.encode_batch_fast([t or "" for t in texts], add_special_tokens=False)]
    assert [x.tolist() for x in coder.ids(texts)] == want
    assert coder.lengths(texts).tolist() == [len(x) for x in want]


def test_frequent_pre_tokens_stay_when_others_are_forgotten(monkeypatch):
    monkeypatch.setattr(tokens, "MOST_HELD", 200)
    monkeypatch.setattr(tokens, "PIECE_CHARS", 300)
    coder = tokens.Encoder(tokens.public_tokenizers.path(tokens.BYTE_BPE), "bytes")
    asked, encoded = [], coder._encoded
    monkeypatch.setattr(coder, "_encoded", lambda texts: asked.extend(texts) or encoded(texts))
    texts = [f"often met words, \n\nx{chr(97 + k % 26)}{chr(97 + k // 26)} q{k}.{k}!" for k in range(400)]
    want = [e.ids for e in coder.library.encode_batch_fast(texts, add_special_tokens=False)]
    assert [x.tolist() for x in coder.ids(texts)] == want
    assert coder.held <= 200 and len(set(asked)) > 600
    assert asked.count("often") == asked.count(" met") == asked.count(" words") == 1


def _docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def test_new_pre_tokens_are_not_cut_again_by_the_library():
    """They go to the model one by one, whatever their characters; the library's own cutting sees none of them."""
    coder = tokens.Encoder(tokens.public_tokenizers.path(tokens.BYTE_BPE), "bytes")
    plain = [chr(k) for k in range(33, tokens._SIMPLE) if k != 39 and not chr(k).isspace()]
    texts = [f"{a} {b}{a}{a} {a}" for a, b in zip(plain, plain[1:] + plain[:1], strict=True)] + [" ".join(plain), "".join(plain), "\x00\x01 \x7f"]
    want = [coder.library.encode(t, add_special_tokens=False).ids for t in texts]

    class Refused:
        def __getattr__(self, name):
            raise AssertionError(f"{name} was asked")

    coder.library = Refused()
    assert [ids.tolist() for ids in coder.ids(texts)] == want


def test_length_histogram_against_brute_force(spark):
    texts = [r.text for r in _docs(spark).select("text").collect()]
    n = sorted(len(e.ids) for e in tokens.encoder(tokens.BYTE_BPE).library.encode_batch_fast(texts, add_special_tokens=False))
    got = {r.n_tokens: r for r in catalog.op8_token_counts(spark, SF).collect()}
    assert {k: r.n_docs for k, r in got.items()} == Counter(n)
    for k, r in got.items():
        assert (r.docs_at_least, r.tokens_at_least) == (sum(x >= k for x in n), sum(x for x in n if x >= k))
        assert (r.truncated_tokens, r.total_docs, r.total_tokens) == (sum(min(x, k) for x in n), len(n), sum(n))
        assert abs(r.quantile - sum(x <= k for x in n) / len(n)) < 1e-12
    histogram = lengths.lengths(_docs(spark))
    for r in lengths.at_limits(histogram, [0, 100, 777, 10**6]).collect():
        k = r.context_limit
        assert (r.docs_over, r.truncated_tokens, r.lost_tokens) == (sum(x > k for x in n), sum(min(x, k) for x in n), sum(max(x - k, 0) for x in n))
    for r in lengths.quantiles(histogram, [0.5, 0.9, 1.0]).collect():
        assert r.n_tokens == n[int(np.ceil(r.share * len(n))) - 1]


def test_lengths_of_odd_rows(spark):
    df = spark.createDataFrame([(None,), ("",), ("a b",), ("a b",)], "text string")
    assert sorted(map(tuple, lengths.lengths(df, end_ids=1).collect())) == [(1, 2), (3, 2)]
    assert lengths.suffix_sums(lengths.lengths(df.limit(0))).count() == 0


def check_pieces(rows, ids, window):
    """Every id once, no gaps, lengths of sequences; ids: by position in the list of documents' (key, ids)."""
    sequences = defaultdict(list)
    for r in rows:
        sequences[r.sequence_id].append((r.offset, r.length))
    for parts in sequences.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at and n > 0
            at += n
        assert at == window or at & (at - 1) == 0 and at < window
    pieces = defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append(r)
    want = Counter()
    for key, x in ids:
        want[key] += len(x)
    assert {k: sum(r.length for r in p) for k, p in pieces.items()} == want
    return pieces


def test_packing_keeps_every_id(spark):
    texts = {r.doc_id: r.text for r in _docs(spark).collect()}
    library = tokens.encoder(tokens.WORD_BPE).library
    ids = {k: np.array([*library.encode(t, add_special_tokens=False).ids, 1], "<u4") for k, t in texts.items()}
    rows = catalog.op9_packing(spark, SF).collect()
    for key, parts in check_pieces(rows, ids.items(), 2048).items():
        at = 0
        for r in sorted(parts, key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids[key])
            assert r.ids_crc32 == zlib.crc32(ids[key][at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids[key])


def test_packing_odd_rows_and_neighbours(spark, monkeypatch):
    df = spark.createDataFrame([(1, None), (2, ""), (2, "a b"), (None, "c"), (3, "w " * 100)], "doc_id long, text string").coalesce(1)
    rows = packing.pack(df, window=16, with_ids=True).collect()
    check_pieces(rows, [(1, [0]), (2, [0]), (2, [0] * 3), (None, [0] * 2), (3, [0] * 101)], 16)
    assert sum(len(r.ids) for r in rows) == 1 + 1 + 3 + 2 + 101
    assert packing.pack(df.limit(0)).count() == 0
    # the seed's window is filled with what shares its rare terms
    docs = [np.array([10 + k % 2, 100 + k % 2, 5, 1], "<u4") for k in range(8)]
    by = defaultdict(set)
    for d, _, _, sequence, _ in packing.layout(docs, 16):
        by[sequence].add(d % 2)
    assert sorted(map(tuple, by.values())) == [(0,), (1,)]
