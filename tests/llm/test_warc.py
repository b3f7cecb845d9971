import base64
import hashlib
import io

import pytest

from tidemark.llm import store, warc


def test_round_trip(spark, monkeypatch):
    monkeypatch.setattr(warc, "READ_BYTES", 97)
    big = "é<b>x</b>" * 60_000
    rows = [(1, "http://a/ b\r\nX: y", "same"), (2, None, "same"), (3, "u", None), (4, "u", ""), (5, "u", big), (6, "u", "\r\n\r\nWARC/1.1\r\n"), (2, "u", "same"), (1, "u", "same"), (None, "u", "same"), (None, "u", "own")]
    df = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, digest string").repartition(4)
    got = warc.read(warc.write(df, store.new_folder(spark, "t"))).collect()
    assert all(r.valid for r in got) and len(got) == len(rows)
    assert sorted((r.page_id or 0, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got) == sorted(
        (p or 0, len((h or "").encode()), base64.b32encode(hashlib.sha1((h or "").encode()).digest()).decode(), *x)
        for (p, _, h), x in zip(rows, [("response", None), ("revisit", 1), ("response", None), ("revisit", 3), ("response", None), ("response", None), ("revisit", 1), ("response", None), ("revisit", 1), ("response", None)], strict=True)
    )
    assert {r.payload.decode() for r in got if r.record_type == "response"} == {"same", "", big, "\r\n\r\nWARC/1.1\r\n", "own"}
    assert warc.read(warc.write(df.limit(0), store.new_folder(spark, "t"))).count() == 0


def test_archive_sizes_and_least_bytes(spark, monkeypatch):
    df = spark.createDataFrame([(i, "u", "ab") for i in range(5)], "page_id long, url string, html string")
    got = warc.read(warc.write(df, store.new_folder(spark, "t"), least_bytes=3)).collect()
    assert {r.record_type for r in got} == {"response"} and len(got) == 5


def test_damage_is_seen():
    whole = warc.record(7, "u", b"payload", None, False)
    assert list(warc.records(io.BytesIO(whole * 2), True))[1][0] == 7
    for broken in (whole[:-9], whole[: len(whole) // 2]):
        with pytest.raises(ValueError):
            list(warc.records(io.BytesIO(broken), True))
