import zlib

from pyspark.sql import functions as F

from tidemark.llm import catalog, language

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang", F.length("text").alias("n"))
    got = catalog.op4_language(spark, SF).join(docs, "doc_id").collect()
    assert len(got) == 1000
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got)
    held = [r for r in got if r.held_out]
    assert sum(r.lang == r.lang_pred for r in held) / len(held) > 0.97
    longer = [r for r in held if r.n >= 100]
    assert sum(r.accepted for r in longer) / len(longer) > 0.98
    assert all(0 <= r.score <= 1 for r in got)


def test_odd_rows(spark):
    samples = {"a": b"la le li lo lu " * 50, "b": b"ka ke ki ko ku " * 50}
    texts = [None, "", "123 !!", "la le li lo lu la le", "KA KE!! KI KO ku ka", "ka ke ki " * 30_000]
    rows = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)] + [(None, "la le li lo", "x")] * 2, "doc_id long, text string, lang_pred string")
    got = language.identify(rows, samples, keep=["lang_pred"]).toDF("doc_id", "old", "lang_pred", "score", "accepted").orderBy("doc_id").collect()
    assert [r.lang_pred for r in got] == ["a", "a", "und", "und", "und", "a", "b", "b"]
    assert [r.accepted for r in got] == [True, True, False, False, False, True, True, True]
    assert {r.old for r in got} == {"x"}
    assert language.identify(rows.limit(0), samples).count() == 0
    assert {r.lang_pred for r in language.identify(rows, {}).collect()} == {"und"}


def test_dictionaries_need_labels_and_letters(spark):
    rows = spark.createDataFrame([("a b c", "x"), (None, "x"), ("d e f", None), ("123", "y")], "text string, lang string")
    assert language.dictionaries(rows) == {"x": b"a b c"}
