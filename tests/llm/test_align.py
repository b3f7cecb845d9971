import hashlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tidemark.llm import align, catalog

SF = "/root/testdata/sf0.001"
FIELDS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups", "n_overlaps")


def brute(texts):
    """The contract over whole texts, with sets and loops only."""
    a = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [x for x in range(256) if x not in shown]
    letter = {chr(x): x for x in shown} | {chr(256 + k): x for k, x in enumerate(hidden)}

    def piece(i):
        p = b.id_to_piece(i)
        return bytes.fromhex(p[3:5]) if p.startswith("<0x") and len(p) == 6 else p.replace("▁", " ").encode()

    out, held = [], defaultdict(set)
    for n, text in enumerate(texts):
        if not text:
            out.append(None)
            continue
        ids_a, ids_b = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
        raw_a, raw_b = [bytes(letter[c] for c in a.id_to_token(i)) for i in ids_a], [piece(i) for i in ids_b]
        if b"".join(raw_a) != (" " + text).encode() or b"".join(raw_b) != (" " + text).encode():
            out.append(None)
            continue
        ends_a, ends_b = ([sum(map(len, raw[: k + 1])) for k in range(len(raw))] if len(raw) < 3000 else np.cumsum([*map(len, raw)]).tolist() for raw in (raw_a, raw_b))
        common = sorted(set(ends_a) & set(ends_b))
        groups, i, j = [], 0, 0
        overlaps = 0
        for end in common:
            i2, j2 = ends_a.index(end, i) + 1, ends_b.index(end, j) + 1
            groups.append((ids_a[i:i2], ids_b[j:j2]))
            for x in range(i, i2):
                for y in range(j, j2):
                    overlaps += ends_a[x] - len(raw_a[x]) < ends_b[y] and ends_b[y] - len(raw_b[y]) < ends_a[x]
            i, j = i2, j2
        links = Counter((x, y) for ga, gb in groups for x in ga for y in gb)
        for pair in links:
            held[pair].add(n)
        out.append((len(ids_a), len(ids_b), groups, links, overlaps))
    highest = Counter()
    for (x, _), docs in held.items():
        highest[x] = max(highest[x], len(docs))
    rows = []
    for found in out:
        if found is None:
            rows.append((0, 0, 0, 0, 0, 0, "", 0))
            continue
        n_a, n_b, groups, links, overlaps = found
        best = sum(n for p, n in links.items() if len(held[p]) == highest[p[0]])
        text = ";".join(f"{','.join(map(str, x))}|{','.join(map(str, y))}" for x, y in groups)
        rows.append((n_a, n_b, len(groups), sum(links.values()), best, sum(n * len(held[p]) for p, n in links.items()), text, overlaps))
    return rows, held


def test_whole_table_equals_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    want, _ = brute([r.text for r in docs])
    got = {r.doc_id: r for r in catalog.op12_alignment(spark, SF).collect()}
    assert len(got) == len(docs)
    for r, w in zip(docs, want, strict=True):
        g = got[r.doc_id]
        assert (g.n_a, g.n_b, g.n_groups, g.n_links, g.n_best, g.count_sum, g.n_overlaps) == (*w[:6], w[7])
        assert g.groups_sha256 == (hashlib.sha256(w[6].encode()).hexdigest() if w[0] else "")


def test_odd_texts_and_blocks(spark, monkeypatch):
    monkeypatch.setattr(align, "BLOCK_PAIRS", 40)
    monkeypatch.setattr(align, "PIECE_CHARS", 50)
    monkeypatch.setattr(align, "SLICE", 7)
    monkeypatch.setattr(align, "HELD_BYTES", 3_000)
    texts = [
        None, "", " ", "  ", "a", " a", "a ", "a  b   c", "\n x\ty \n\n  z", "x y 　 z", "a▁b plain", "▁", "<s> </s> <0x41> <|endoftext|> <unk>", "a\x00b \x1c c",
        "naïve Ａ ｂ éé ﬁ", "日本語 のテキスト 中文", "\U0001f600 \U0001f468‍\U0001f469 ok", "it's we're I'LL", "word " * 200, "same text", "same text", "x" * 300, "     lots     of   spaces    ",
        "한국어 텍스트" * 20, "1234567 89,000.5 -- !!! ??", "tab\t\t  two \r\n end",
    ]
    want, held = brute(texts)
    docs = spark.createDataFrame([(i if i != 19 else None, t) for i, t in enumerate(texts)], "id long, body string").repartition(3)
    docs = docs.withColumn("block", F.lit("clash")).withColumn("key", F.lit("clash"))
    got = {r.id: r for r in align.aligned(docs, key="id", text="body").collect()}
    assert len(got) == len(texts)
    for i, w in enumerate(want):
        g = got[i if i != 19 else None]
        assert tuple(g[f] for f in FIELDS) == w, texts[i]
        assert g.groups_sha256 == (hashlib.sha256(w[6].encode()).hexdigest() if w[0] else "")
    table = {(r.a_id, r.b_id): (r.n_docs, r.best) for r in align.links(docs, key="id", text="body").collect()}
    assert {p: n for p, (n, _) in table.items()} == {p: len(d) for p, d in held.items()}
    highest = Counter()
    for (x, _), d in held.items():
        highest[x] = max(highest[x], len(d))
    assert all(best == (n == highest[x]) for (x, _), (n, best) in table.items())


def test_empty_table(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert align.aligned(empty).count() == 0 and align.links(empty).count() == 0


@pytest.mark.parametrize("most", [1, 5, 10_000])
def test_row_products_equal_dense(most):
    rng = np.random.default_rng(3)
    left, right = rng.integers(0, 2, (12, 9)), rng.integers(0, 2, (9, 7))

    def rows(m):
        return align.Rows(np.concatenate([[0], np.cumsum(m.sum(axis=1))]), np.concatenate([np.flatnonzero(r) for r in m]))

    out = np.zeros((12, 7), int)
    for row, column, value in align.row_products(rows(left), rows(right), most):
        out[row, column] += value
    assert (out == left @ right).all()
