import re
from collections import defaultdict

import numpy as np
import pytest

import corpus_pipeline as pipeline
from tests.llm.test_near import brute
from tests.llm.test_pii import KINDS
from tests.llm.test_tokens import check_pieces
from tidemark.llm import language, near, tokens

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def results(spark):
    out = [spark.read.parquet(f"{SF}/documents.parquet")]
    for _, stage in pipeline.STAGES:
        out.append(stage(spark, out[-1], SF).cache())
    yield out
    for df in out:
        df.unpersist()


def by_id(df):
    return {r.doc_id: r for r in df.collect()}


def test_columns_and_language(spark, results):
    for df in results[1:5]:
        assert df.columns == results[0].columns
    before, after = by_id(results[0]), by_id(results[1])
    want = {r.doc_id for r in language.identify(results[0], language.dictionaries(results[0])).where("accepted").collect()}
    assert set(after) == want and all(after[k] == before[k] for k in after)
    assert len(after) > 0.97 * len(before)


def test_near_duplicates_against_brute_force(spark, results):
    before, after = by_id(results[1]), by_id(results[2])
    short = [(k, r.text) for k, r in before.items()]
    # all pairs with a common shingle, on the whole table
    idf = near.idf_table(results[1])
    owners, sets = defaultdict(list), {}
    for k, t in short:
        data = t.encode()
        _, s, w = near.shingles(near.W.split(np.frombuffer(data, np.uint8), np.array([0, len(data)])), idf)
        sets[k] = s, w
        for x in s.tolist():
            owners[x].append(k)
    pairs = {(a, b) for ks in owners.values() if len(ks) > 1 for i, a in enumerate(ks) for b in ks[:i]}
    top = {k: k for k in before}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for a, b in pairs:
        if near.similarity(*sets[a], *sets[b]) >= 0.8:
            x, y = sorted((find(a), find(b)))
            top[y] = x
    want = {k for k in before if find(k) == k}
    assert len(want ^ set(after)) <= 2  # a pair at the threshold may miss all bands
    assert all(after[k] == before[k] for k in after)


def test_decontamination(spark, results):
    before, after = by_id(results[2]), by_id(results[3])
    split = lambda t: re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), t))
    windows = set()
    for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect():
        w = split(r.text)
        windows |= {tuple(w[k : k + 10]) for k in range(max(1, len(w) - 9))} if w else set()
    assert all(len(w) == 10 for w in windows)
    for k, r in before.items():
        w = split(r.text)
        assert (k not in after) == any(tuple(w[i : i + 10]) in windows for i in range(len(w) - 9))


def test_personal_data_and_packing(spark, results):
    before, after = by_id(results[3]), by_id(results[4])
    assert set(before) == set(after)
    for p in KINDS:
        old = {x for r in before.values() for x in re.findall(p, r.text)}
        assert not old & {x for r in after.values() for x in re.findall(p, r.text)}
    assert all(r.n_chars == len(r.text) and (r.lang, r.source) == (before[k].lang, before[k].source) for k, r in after.items())
    library = tokens.encoder(tokens.WORD_BPE).library
    ids = {k: [*library.encode(r.text, add_special_tokens=False).ids, 1] for k, r in after.items()}
    rows = results[5].collect()
    for key, parts in check_pieces(rows, ids.items(), 2048).items():
        assert [x for r in sorted(parts, key=lambda r: r.start) for x in r.ids] == ids[key]


def test_odd_rows(spark, tmp_path):
    text = "the quick brown fox jumps over the lazy dog and runs far away from here "
    rows = [(1, text * 3, "en", "s", 9), (2, None, "en", None, None), (3, "", None, "s", 0), (1, text * 3, "en", "s", 9), (None, text * 2, "en", "s", 1), (4, "der hund läuft über die wiese und der fuchs schläft im wald " * 4, "de", "s", 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    spark.createDataFrame([(1, "nothing of that kind occurs in any of the rows at all")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    out = pipeline.run(spark, str(tmp_path))
    assert {r.doc_id for r in out.collect()} == {1, 4, None}
    empty = docs.limit(0)
    for _, stage in pipeline.STAGES:
        empty = stage(spark, empty, str(tmp_path))
    assert empty.count() == 0
    assert len(brute(spark, [(1, "a b c"), (2, "a b c")], 0.8)) == 2


def test_rows_without_ids_of_their_own(spark):
    texts = ["the first text speaks of rivers and of the boats on them", "a second one tells how bread is made in old ovens", "here a third is about stars that nobody has counted"]
    rows = [(None, t) for t in texts] + [(7, "seven words that no other row holds"), (7, "but the same number on quite another page")] + [(9, texts[0]), (None, texts[1])]
    docs = spark.createDataFrame([(k, t, "en", "s", len(t)) for k, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = pipeline.near_duplicates(spark, docs, SF)
    assert got.columns == docs.columns
    want = [(9, texts[0]), (None, texts[1]), (None, texts[2]), *rows[3:5]]
    assert sorted(map(repr, ((r.doc_id, r.text) for r in got.collect()))) == sorted(map(repr, want))
