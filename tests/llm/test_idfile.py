import io
import random
import time
import zlib

import numpy as np
import pytest

from tidemark.llm import catalog, idfile, store, tokens

SF = "/root/testdata/sf0.01"


def test_codes_round_trip():
    rng = np.random.default_rng(3)
    blocks = [rng.integers(0, 65536, 700), rng.integers(0, 5, 3000), np.zeros(4096, np.int64), np.array([7]), np.arange(2500) % 11 + 50_000, rng.zipf(1.3, 2000) % 65536, np.full(1, 65535)]
    blocks = [b.astype(np.uint32) for b in blocks]
    data = idfile.encode(blocks)
    for a, b in zip(idfile.decode(data, [len(b) for b in blocks]), blocks, strict=True):
        assert np.array_equal(a, b)
    assert [idfile.decode([d], [len(b)])[0].tolist() == b.tolist() for d, b in zip(data, blocks, strict=True)] == [True] * len(blocks)  # alone as well
    assert len(data[2]) < 60 and len(data[4]) < 600 and len(data[0]) < 2 * 700 * 1.4
    with pytest.raises(ValueError):
        idfile.encode([np.array([65_536], np.uint32)])


def test_files_hold_cut_documents_and_show_damage():
    docs = [(5, np.arange(9000, dtype=np.uint32)), (None, np.array([2], np.uint32)), (-3, np.arange(100, dtype=np.uint32))]
    whole = idfile.MAGIC + b"".join(idfile.packed_blocks(docs))
    got = list(idfile.unpacked(io.BytesIO(whole)))
    assert [t for t, _ in got] == [[(5, 4096, 1)], [(5, 4096, 0)], [(5, 808, 2), (None, 1, 7), (-3, 100, 3)]]
    assert np.concatenate([x for _, x in got]).tolist() == np.concatenate([x for _, x in docs]).tolist()
    for k in (3, 20, len(whole) // 2, len(whole) - 1):
        broken = bytearray(whole)
        broken[k] ^= 64
        with pytest.raises(ValueError):
            list(idfile.unpacked(io.BytesIO(bytes(broken))))
    with pytest.raises(ValueError):
        list(idfile.unpacked(io.BytesIO(whole[:-5])))


def test_whole_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()
    library = tokens.encoder(tokens.BYTE_BPE).library
    start, want = 0, set()
    for r in docs:
        ids = np.array([*library.encode(r.text, add_special_tokens=False).ids, 2], "<u4")
        want.add((r.doc_id, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert {tuple(r) for r in catalog.op6_token_ids(spark, SF).select("doc_id", "start", "n_tokens", "ids_crc32").collect()} == want


def test_odd_rows(spark):
    df = spark.createDataFrame([(3, "a"), (None, None), (1, ""), (1, "b b"), (1, "b b"), (-7, "x" * 40_000)], "doc_id long, text string").withColumnRenamed("x", "key")
    out = idfile.read(idfile.write(df, store.new_folder(spark, "t")), with_ids=True).orderBy("start").collect()
    assert [r.key for r in out] == [None, -7, 1, 1, 1, 3]
    at = 0
    for r in out:
        assert r.start == at and r.n_tokens == len(r.ids) and r.ids[-1] == 2
        at += r.n_tokens
    assert idfile.read(idfile.write(df.limit(0), store.new_folder(spark, "t"))).count() == 0


def test_lanes_of_any_length_round_trip():
    rng = np.random.default_rng(5)
    lengths = sorted({max(0, a + d) for a in (*idfile._LEARNED, idfile.BLOCK_IDS) for d in (-1, 0, 1)} - {idfile.BLOCK_IDS + 1})
    blocks = []
    for k, n in enumerate(lengths * 3):  # many, few or repeated ids
        ids = rng.zipf(1.2, n) % 50_257 if k % 3 == 0 else rng.integers(0, 40, n) if k % 3 == 1 else np.tile(rng.integers(0, 65_536, 50), n // 50 + 1)[:n]
        blocks.append(ids.astype(np.uint32))
    data = idfile.encode(blocks)
    for a, b in zip(idfile.decode(data, [len(b) for b in blocks]), blocks, strict=True):
        assert np.array_equal(a, b)
    assert idfile.encode(blocks[5:9]) == data[5:9]  # whatever is coded beside it
    assert idfile.decode([], []) == [] and idfile.encode([]) == []
    with pytest.raises(ValueError):
        idfile.encode([np.zeros(idfile.BLOCK_IDS + 1, np.uint32)])


def test_coding_both_ways_costs_less_than_the_library(spark):
    texts = [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").select("text").collect()]
    library = tokens.encoder(tokens.BYTE_BPE).library
    start = time.process_time()
    ids = np.concatenate([np.array(e.ids, np.uint32) for e in library.encode_batch_fast(texts, add_special_tokens=False)])
    library_s = (time.process_time() - start) / len(ids)
    blocks = [ids[k : k + idfile.BLOCK_IDS] for k in range(0, len(ids) - idfile.BLOCK_IDS, idfile.BLOCK_IDS)]
    blocks = (blocks * (1_600 // len(blocks) + 1))[:1_600]
    start = time.process_time()
    data = idfile.encode(blocks)
    back = idfile.decode(data, [len(b) for b in blocks])
    assert (time.process_time() - start) / sum(map(len, blocks)) < library_s
    assert all(np.array_equal(a, b) for a, b in zip(back, blocks, strict=True))
    assert sum(map(len, data)) < 1.1 * sum(map(len, blocks))


@pytest.mark.parametrize("lanes", [3, 100])
def test_files_of_a_task_are_read_in_lockstep(monkeypatch, lanes):
    rng = np.random.default_rng(8)
    files = [[(10 * f + d, rng.integers(0, 900, size).astype(np.uint32)) for d, size in enumerate((5000, 1, 9000))] for f in range(3)] + [[]]
    streams = [io.BytesIO(idfile.MAGIC + b"".join(idfile.packed_blocks(docs))) for docs in files]
    monkeypatch.setattr(idfile, "READ_LANES", lanes)
    calls, real = [], idfile.decode
    monkeypatch.setattr(idfile, "decode", lambda payloads, sizes: calls.append(len(sizes)) or real(payloads, sizes))
    found = {}
    for number, table, ids in idfile._together(streams):
        at = 0
        for key, n, _ in table:
            found.setdefault((number, key), []).extend(ids[at : at + n].tolist())
            at += n
    assert found == {(f, key): ids.tolist() for f, docs in enumerate(files) for key, ids in docs}
    assert calls == ([3] * 4 if lanes == 3 else [12])
