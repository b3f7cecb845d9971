"""Preparation, assembly and sampling operators bound to the driver tables, with DuckDB oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import columns as col
from tidemark.operators import assemble, prepare, sample, temporal
from tidemark.plans.data import load, orders_history, rounded
from tidemark.sources import tables

QUERIES = {}
ORACLES = {}


def query(name, sql=None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register




SPLIT_1998 = "o_orderdate < timestamp_ntz'1998-01-01 00:00:00'"


def train_val(spark, sf):
    o = load(spark, sf, "orders")
    return o.where(SPLIT_1998), o.where(f"not ({SPLIT_1998})")


BUNDLE = {
    "region": "r_regionkey,r_name",
    "nation": "n_nationkey,n_name,n_regionkey",
    "customer": "c_custkey,c_name,c_nationkey,c_acctbal,c_mktsegment",
    "supplier": "s_suppkey,s_name,s_nationkey,s_acctbal",
    "part": "p_partkey,p_name,p_brand,p_type,p_size,p_retailprice",
    "orders": "o_orderkey,o_custkey,o_orderstatus,o_totalprice,o_orderdate,o_orderpriority",
    "lineitem": "l_orderkey,l_partkey,l_suppkey,l_linenumber,l_quantity,l_extendedprice,l_discount,l_tax,l_returnflag,l_linestatus,l_shipdate",
    "events": "event_id,ts,user_id,event_type,value,props",
    "documents": "doc_id,text,lang,source,n_chars",
    "embeddings": "vec_id,embedding,label",
    "pages": "page_id,url,html",
    "benchmark": "item_id,text",
    "labels": "doc_id,quality,toxic",
    "conversations": "conv_id,turn,role,text",
}


@query("bundle_profile", " UNION ALL ".join(
    f"SELECT '{t}' AS table_name, count(*) AS n_rows, {n} AS n_columns, '{cols}' AS column_names FROM {t}"
    for t, cols in BUNDLE.items() for n in [cols.count(",") + 1]
))
def bundle_profile(spark, sf):
    return tables.bundle_profile({t: load(spark, sf, t) for t in BUNDLE})


@query("history_view", """
SELECT l_orderkey AS order_id, coalesce(l_partkey, -1) AS part_id, l_shipdate AS history_time, l_quantity AS quantity_history_value,
  l_quantity AS qty, 0 AS quantity_history_value__is_missing FROM lineitem WHERE l_orderkey IS NOT NULL AND l_shipdate IS NOT NULL""")
def history_view(spark, sf):
    """Null-key filter, renames, sentinel key, alias and missing flag over the whole line table."""
    view = load(spark, sf, "lineitem").where("l_orderkey is not null and l_shipdate is not null").select(
        F.col("l_orderkey").alias("order_id"), col.null_key_to("l_partkey").alias("part_id"),
        F.col("l_shipdate").alias("history_time"), col.number("l_quantity").alias("quantity_history_value"),
    )
    return col.with_indicators(assemble.add_aliases(view, {"qty": "quantity_history_value"}), ["quantity_history_value"])


ARRAY_SIZE = 64


@query("array_expand", "SELECT vec_id, label, " + ", ".join(f"embedding[{i + 1}] AS embedding__{i}" for i in range(ARRAY_SIZE)) + " FROM embeddings")
def array_expand(spark, sf):
    return prepare.expand_array(load(spark, sf, "embeddings"), "embedding")


@query("array_symbol", """
SELECT vec_id, array_to_string(list_transform(embedding, lambda x: CAST(CAST(x * 1000 AS INT) AS VARCHAR)), '|') AS symbol FROM embeddings""")
def array_symbol(spark, sf):
    e = load(spark, sf, "embeddings").select("vec_id", F.transform("embedding", lambda x: F.rint(x.cast("float") * F.lit(1000).cast("float")).cast("int")).alias("a"))
    return e.select("vec_id", col.symbol(e, "a").alias("symbol"))


@query("json_props", """
SELECT event_id, TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) AS k,
  (json_extract_string(props, '$.k') IS NULL)::INT AS k__is_missing FROM events""")
def json_props(spark, sf):
    e = load(spark, sf, "events").select("event_id", F.from_json("props", "k bigint")["k"].alias("k"))
    return col.with_indicators(e, ["k"])


@query("text_flags", """
SELECT doc_id, length(text)::BIGINT AS text__len, (text IS NOT NULL)::INT AS text__present,
  length(lang)::BIGINT AS lang__len, (lang IS NOT NULL)::INT AS lang__present FROM documents""")
def text_flags(spark, sf):
    return load(spark, sf, "documents").select("doc_id", *col.text_flags("text"), *col.text_flags("lang"))


@query("calendar", """
SELECT o_orderkey, year(o_orderdate)::INT AS o_orderdate__year, month(o_orderdate)::INT AS o_orderdate__month,
  day(o_orderdate)::INT AS o_orderdate__day, (isodow(o_orderdate) - 1)::INT AS o_orderdate__dow,
  epoch(o_orderdate) AS epoch_seconds FROM orders""")
def calendar(spark, sf):
    o = load(spark, sf, "orders").select("o_orderkey", "o_orderdate", col.epoch_seconds(F.col("o_orderdate")).alias("epoch_seconds"))
    return col.calendar_parts(o, "o_orderdate")


@query("label_threshold", """
SELECT l_orderkey, l_linenumber, l_partkey, l_quantity, (coalesce(l_quantity, 0) > 25)::INT AS above_25, (coalesce(l_tax, 0) >= 0.04)::INT AS tax_at_least FROM lineitem""")
def label_threshold(spark, sf):
    return load(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_quantity", col.at_least("l_quantity", 25, strict=True).alias("above_25"),
        col.at_least("l_tax", 0.04).alias("tax_at_least"),
    )


@query("log1p_label", "SELECT o_orderkey, round(ln(1 + o_totalprice), 9) AS log_price FROM orders")
def log1p_label(spark, sf):
    return rounded(load(spark, sf, "orders").select("o_orderkey", col.log1p_label("o_totalprice").alias("log_price")), 9)


@query("binary_text_label", """
SELECT doc_id, quality AS from_number, (quality = 1)::INT AS from_text, toxic AS from_word FROM labels""")
def binary_text_label(spark, sf):
    word = F.when(F.col("toxic") == 1, " Yes").otherwise("F ")
    return load(spark, sf, "labels").select(
        "doc_id", col.binary_label("quality").alias("from_number"),
        col.binary_label((F.col("quality") == 1).cast("string")).alias("from_text"), col.binary_label(word).alias("from_word"),
    )


@query("class_label", """
SELECT p_partkey, CAST(p_size AS VARCHAR) AS from_int, CAST(p_size AS VARCHAR) AS from_double, p_brand AS from_text FROM part""")
def class_label(spark, sf):
    return load(spark, sf, "part").select(
        "p_partkey", col.canonical_class("p_size").alias("from_int"),
        col.canonical_class(F.col("p_size").cast("double")).alias("from_double"), col.canonical_class("p_brand").alias("from_text"),
    )


@query("seen_classes", """
WITH tr AS (SELECT DISTINCT o_custkey FROM orders WHERE o_orderdate < TIMESTAMP '1998-01-01')
SELECT o.* FROM orders o WHERE o_orderdate >= TIMESTAMP '1998-01-01' AND o_custkey IN (SELECT o_custkey FROM tr)""")
def seen_classes(spark, sf):
    train, val = train_val(spark, sf)
    return prepare.keep_seen_classes(train, val, "o_custkey")


@query("seen_class_report", """
WITH tr AS (SELECT DISTINCT o_custkey FROM orders WHERE o_orderdate < TIMESTAMP '1998-01-01'),
v AS (SELECT o_custkey IN (SELECT o_custkey FROM tr) k FROM orders WHERE o_orderdate >= TIMESTAMP '1998-01-01')
SELECT count(*) AS rows, count(*) FILTER (k) AS kept, count(*) FILTER (NOT k) AS dropped FROM v""")
def seen_class_report(spark, sf):
    train, val = train_val(spark, sf)
    return prepare.unseen_class_report(train, val, "o_custkey")


VARIATION = ["l_orderkey", "l_returnflag", "constant", "l_tax", "gap", "none"]


@query("constant_columns", """
WITH l AS (SELECT l_orderkey, l_returnflag, 7 AS constant, l_tax, CASE WHEN l_linenumber > 1 THEN 1 END gap, NULL::INT AS none FROM lineitem)
""" + " UNION ALL ".join(
    f"""SELECT '{c}' AS "column", count(*) AS n_rows, count({c}) AS n_present,
    count(DISTINCT {c}) + (count({c}) < count(*))::INT > 1 AS varies FROM l""" for c in VARIATION))
def constant_columns(spark, sf):
    rows = load(spark, sf, "lineitem").select(
        "l_orderkey", "l_returnflag", F.lit(7).alias("constant"), "l_tax",
        F.when(F.col("l_linenumber") > 1, 1).alias("gap"), F.lit(None).cast("int").alias("none"),
    )
    return prepare.column_variation(rows, VARIATION)


LOOK = ["ord_past_count", "ord_count_30d", "ord_count_90d", "ord_days_since_last"]


@query("stable_features", """
WITH j AS (
  SELECT t.o_orderkey, any_value(t.o_orderdate) tt, max(c.o_orderdate) lt, count(c.o_orderdate) n,
    count(*) FILTER (c.o_orderdate > t.o_orderdate - INTERVAL 90 DAY) n90
  FROM orders t LEFT JOIN orders c ON c.o_custkey = t.o_custkey AND c.o_orderdate < t.o_orderdate GROUP BY 1),
f AS (SELECT CASE WHEN tt < TIMESTAMP '1998-01-01' THEN 'train' WHEN tt < TIMESTAMP '2000-01-01' THEN 'val' ELSE 'test' END s,
   (lt IS NULL)::INT d, (n90 = 0)::INT r FROM j),
g AS (SELECT 'ord_days_since_last' AS "column", s, d v FROM f UNION ALL SELECT 'recent_flag', s, r FROM f)
SELECT "column", round(avg(v) FILTER (s = 'train'), 6) AS null_rate_train, round(avg(v) FILTER (s = 'val'), 6) AS null_rate_val,
  round(avg(v) FILTER (s = 'test'), 6) AS null_rate_test,
  greatest(avg(v) FILTER (s = 'train'), avg(v) FILTER (s = 'val'), avg(v) FILTER (s = 'test')) <= 0.3 AS kept
FROM g GROUP BY "column" """)
def stable_features(spark, sf):
    o = orders_history(spark, sf)
    block = temporal.lookback_counts(
        o, o, row_key=["o_orderkey"], keys=["o_custkey"], target_time="o_orderdate", child_keys=["o_custkey"],
        child_time="o_orderdate", prefix="ord", windows_days=(90,),
    ).withColumn("recent_flag", F.when(F.col("ord_count_90d") > 0, F.lit(1)))
    rows = block.join(o.select("o_orderkey", "o_orderdate"), "o_orderkey")
    cut = {
        "train": "o_orderdate < timestamp_ntz'1998-01-01 00:00:00'",
        "val": "o_orderdate >= timestamp_ntz'1998-01-01 00:00:00' and o_orderdate < timestamp_ntz'2000-01-01 00:00:00'",
        "test": "o_orderdate >= timestamp_ntz'2000-01-01 00:00:00'",
    }
    return rounded(prepare.stable_features({k: rows.where(v) for k, v in cut.items()}, ["ord_days_since_last", "recent_flag"], 0.3))


def _gappy(df):
    return df.select(
        "o_orderkey", F.when(F.col("o_orderkey") % 5 != 0, F.col("o_totalprice")).alias("price"),
        F.when(F.col("o_orderkey") % 7 != 0, F.col("o_orderpriority")).alias("priority"),
    )


GAPPY_SQL = """g AS (SELECT o_orderkey, o_orderdate < TIMESTAMP '1998-01-01' tr, CASE WHEN o_orderkey % 5 != 0 THEN o_totalprice END price,
  CASE WHEN o_orderkey % 7 != 0 THEN o_orderpriority END priority FROM orders)"""


@query("impute_fit", f"""WITH {GAPPY_SQL}
SELECT 'price' AS "column", round(median(price), 6) AS number, NULL AS word FROM g WHERE tr
UNION ALL SELECT 'priority', NULL, (SELECT priority FROM g WHERE tr AND priority IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)""")
def impute_fit(spark, sf):
    return rounded(prepare.fit_fill_values(_gappy(train_val(spark, sf)[0]), ["price"], ["priority"]))


@query("impute_encode", f"""WITH {GAPPY_SQL},
m AS (SELECT median(price) FILTER (tr) md FROM g),
w AS (SELECT priority pw FROM g WHERE tr AND priority IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1),
codes AS (SELECT v, row_number() OVER (ORDER BY v) - 1 code FROM (SELECT DISTINCT coalesce(priority, pw) v FROM g, w))
SELECT o_orderkey, round(coalesce(price, md), 6) AS price, code AS priority FROM g, m, w, codes WHERE NOT tr AND v = coalesce(priority, pw)""")
def impute_encode(spark, sf):
    train, val = (_gappy(d) for d in train_val(spark, sf))
    a, b = prepare.impute(train, [train, val], ["price"], ["priority"])
    a, b = prepare.encode_jointly([a, b], ["priority"])
    return rounded(prepare.align_columns(b, a))


@query("ordinal_codes", """
SELECT o_custkey, (row_number() OVER (ORDER BY o_custkey) - 1)::BIGINT AS code FROM (SELECT DISTINCT CAST(o_custkey AS VARCHAR) o_custkey FROM orders)""")
def ordinal_codes(spark, sf):
    return prepare.ordinal_codes(list(train_val(spark, sf)), "o_custkey")


HASH_SAMPLE = """
SELECT o_orderkey, o_custkey FROM (SELECT *, row_number() OVER (ORDER BY md5(o_orderkey::VARCHAR || '~41'), o_orderkey) r FROM orders) WHERE r <= {n}"""


@query("hash_sample", HASH_SAMPLE.format(n=1000))
def hash_sample(spark, sf):
    return sample.hash_sample(load(spark, sf, "orders").select("o_orderkey", "o_custkey"), 1000, ["o_orderkey"], 41)


@query("hash_sample_by_prefix", HASH_SAMPLE.format(n=3333))
def hash_sample_by_prefix(spark, sf):
    quota = spark.range(1).select(F.lit(3333).cast("bigint").alias("quota"))
    return sample.hash_quota(load(spark, sf, "orders").select("o_orderkey", "o_custkey"), ["o_orderkey"], 41, [], quota)


@query("stratified_sample", """
WITH c AS (SELECT o_orderpriority p, greatest(1, round_even(700.0 * count(*) / (SELECT count(*) FROM orders), 0))::BIGINT q FROM orders GROUP BY 1),
r AS (SELECT o_orderkey, o_orderpriority, row_number() OVER (PARTITION BY o_orderpriority ORDER BY md5(o_orderkey::VARCHAR || '~42')) r FROM orders),
s AS (SELECT r.* FROM r JOIN c ON p = o_orderpriority WHERE r.r <= q)
SELECT o_orderkey, o_orderpriority FROM (SELECT *, row_number() OVER (ORDER BY md5(o_orderkey::VARCHAR || '~42')) k FROM s) WHERE k <= 700""")
def stratified_sample(spark, sf):
    return sample.stratified_sample(load(spark, sf, "orders").select("o_orderkey", "o_orderpriority"), 700, "o_orderpriority", ["o_orderkey"], 42)


@query("group_split", """
SELECT o_orderkey, o_custkey, ((('0x' || substr(md5(o_custkey::VARCHAR || '~7'), 1, 8))::BIGINT % 100) < 25)::INT AS is_test FROM orders""")
def group_split(spark, sf):
    return sample.group_split(load(spark, sf, "orders").select("o_orderkey", "o_custkey"), ["o_custkey"], 25, 7)


def _u(j, tag):
    return f"((('0x' || substr(md5(c_custkey::VARCHAR || '~41~train~{j}~{tag}'), 1, 8))::BIGINT + 0.5) / 4294967296.0)"


@query("random_features", "SELECT c_custkey, " + ", ".join(
    f"round(sqrt(-2 * ln({_u(j, 'u')})) * cos(6.283185307179586 * {_u(j, 'v')}), 6) AS random_{j}" for j in range(3)) + " FROM customer")
def random_features(spark, sf):
    return rounded(sample.random_features(load(spark, sf, "customer").select("c_custkey"), 3, ["c_custkey"], 41))


@query("row_ids", """
SELECT conv_id, turn, role, row_number() OVER (ORDER BY conv_id, turn, role, md5(text)) AS row_id FROM conversations""")
def row_ids(spark, sf):
    c = load(spark, sf, "conversations").withColumn("h", F.md5("text"))
    return sample.with_row_id(c, ["conv_id", "turn", "role", "h"]).select("conv_id", "turn", "role", "row_id")


@query("occurrence_join", """
WITH a AS (SELECT l_orderkey, l_linenumber, l_partkey, md5(concat_ws('~', l_partkey, l_suppkey, l_quantity::INT, l_shipdate::DATE)) h FROM lineitem),
n AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, h) - 1 AS occurrence FROM a)
SELECT l_orderkey, l_linenumber, l_partkey, h, occurrence, l_partkey AS again FROM n""")
def occurrence_join(spark, sf):
    lines = load(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey",
        F.md5(F.concat_ws("~", "l_partkey", "l_suppkey", F.col("l_quantity").cast("int"), F.col("l_shipdate").cast("date"))).alias("h"),
    )
    right = lines.select("l_orderkey", "l_linenumber", F.col("l_partkey").alias("again"), F.col("h").alias("h2"))
    return assemble.occurrence_join(lines, right, ["l_orderkey", "l_linenumber"], ["l_partkey", "h"], ["again", "h2"]).drop("h2")


@query("candidate_pairs", """
WITH pos AS (SELECT o_custkey k, list(DISTINCT l_partkey) ps FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1),
u AS (SELECT p_partkey c, row_number() OVER (ORDER BY md5(p_partkey::VARCHAR || '~41'), p_partkey) - 1 i FROM part),
n AS (SELECT count(*) n FROM part),
st AS (SELECT k, ps, n, ('0x' || substr(md5(k::VARCHAR || '~41'), 1, 15))::BIGINT s, greatest(1, len(ps)) w,
  1000000000000 + [39, 61, 63, 91, 121, 163, 169, 177][('0x' || substr(md5(k::VARCHAR || '~41'), 16, 1))::BIGINT % 8 + 1] p FROM pos, n),
dr AS (SELECT k, w, j, c FROM (SELECT *, unnest(range(0, least(len(ps) + w, n)::BIGINT)) j FROM st) d JOIN u ON u.i = (s % n + j * (p % n)) % n WHERE NOT list_contains(ps, c)),
ng AS (SELECT k, c FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY j) r FROM dr) WHERE r <= w)
SELECT k AS o_custkey, c AS candidate, 0 AS label FROM ng UNION ALL SELECT k, unnest(ps), 1 FROM pos""")
def candidate_pairs(spark, sf):
    lines = load(spark, sf, "lineitem").join(load(spark, sf, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    bought = lines.groupBy("o_custkey").agg(F.collect_set("l_partkey").alias("parts"))
    return sample.candidate_pairs(bought, load(spark, sf, "part"), row_key=["o_custkey"], items="parts", universe_item="p_partkey", seed=41)


@query("pull_up", """
SELECT o_orderkey, o_custkey, o_totalprice, c_mktsegment, c_acctbal, n_name FROM orders LEFT JOIN customer ON c_custkey = o_custkey
LEFT JOIN nation ON n_nationkey = c_nationkey""")
def pull_up(spark, sf):
    o = load(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    one = assemble.pull_up(o, load(spark, sf, "customer"), key="o_custkey", parent_key="c_custkey", columns=["c_mktsegment", "c_acctbal", "c_nationkey"])
    return assemble.pull_up(one, load(spark, sf, "nation"), key="c_nationkey", parent_key="n_nationkey", columns=["n_name"], drop=["c_nationkey"])


@query("key_enrich_check", """
SELECT count(*) AS n_rows, count(*) FILTER (o_custkey IS NULL) AS unmatched,
  count(*) FILTER (l_shipdate IS DISTINCT FROM o_orderdate) AS differs_l_shipdate FROM lineitem LEFT JOIN orders ON o_orderkey = l_orderkey""")
def key_enrich_check(spark, sf):
    lines = load(spark, sf, "lineitem").select("l_orderkey", "l_shipdate")
    joined = assemble.enrich_key(lines, load(spark, sf, "orders"), key="l_orderkey", source_pk="o_orderkey", columns=["o_custkey", "o_orderdate"])
    return assemble.enrich_check(joined, [("l_shipdate", "o_orderdate")], "o_custkey")


def _blocks(spark, sf):
    o = orders_history(spark, sf)
    args = dict(row_key=["o_orderkey"], keys=["o_custkey"], target_time="o_orderdate", child_keys=["o_custkey"], child_time="o_orderdate")
    counts = temporal.lookback_counts(o, o, prefix="ord", windows_days=(90,), **args)
    last = temporal.latest_value(o, o, prefix="price", value="o_totalprice", cutoff="strict", **args)
    return o, counts, last


BLOCK_SQL = """
WITH d AS (SELECT o_custkey k, o_orderdate t, avg(o_totalprice) v FROM orders GROUP BY 1, 2),
l AS (SELECT o_orderkey, d.v, date_diff('day', d.t, o_orderdate)::BIGINT dd FROM orders ASOF LEFT JOIN d ON o_custkey = d.k AND o_orderdate > d.t),
c AS (SELECT t.o_orderkey, count(c.o_orderdate) n, count(*) FILTER (c.o_orderdate > t.o_orderdate - INTERVAL 90 DAY) n90
  FROM orders t LEFT JOIN orders c ON c.o_custkey = t.o_custkey AND c.o_orderdate < t.o_orderdate GROUP BY 1)"""


@query("assemble_blocks", BLOCK_SQL + """
SELECT o.o_orderkey, o.o_custkey, n AS ord_past_count, n90 AS ord_count_90d, dd AS ord_days_since_last, round(v, 4) AS price_latest,
  dd AS price_days_since_latest FROM orders o LEFT JOIN c USING (o_orderkey) LEFT JOIN l USING (o_orderkey)""")
def assemble_blocks(spark, sf):
    o, counts, last = _blocks(spark, sf)
    return rounded(assemble.assemble_blocks(o.select("o_orderkey", "o_custkey"), [counts, last], ["o_orderkey"]), 4)


@query("assemble_written", ORACLES["assemble_blocks"])
def assemble_written(spark, sf):
    """The same blocks, each written once by row key and joined without an exchange."""
    o, counts, last = _blocks(spark, sf)
    written = [assemble.write_block(b, ["o_orderkey"], name) for name, b in (("base", o.select("o_orderkey", "o_custkey")), ("counts", counts), ("last", last))]
    return rounded(assemble.assemble_written(written[0], written[1:], ["o_orderkey"]), 4)


@query("merge_disjoint", """
WITH a AS (SELECT l_orderkey k, count(*) n_lines FROM lineitem GROUP BY 1), b AS (SELECT o_custkey k, count(*) n_orders FROM orders GROUP BY 1)
SELECT coalesce(a.k, b.k) AS k, n_lines, n_orders FROM a FULL OUTER JOIN b ON a.k = b.k""")
def merge_disjoint(spark, sf):
    a = load(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(F.count("*").alias("n_lines"))
    b = load(spark, sf, "orders").groupBy(F.col("o_custkey").alias("k")).agg(F.count("*").alias("n_orders"))
    return assemble.merge_disjoint([a, b], ["k"])


@query("append_columns", """
SELECT o_orderkey, o_custkey, o_totalprice, o_totalprice AS o_totalprice__dmax2, o_orderstatus FROM orders""")
def append_columns(spark, sf):
    o = load(spark, sf, "orders")
    return assemble.append_new_columns(
        o.select("o_orderkey", "o_custkey", "o_totalprice"), o.select("o_orderkey", "o_totalprice", "o_orderstatus"), ["o_orderkey"], only_new=False
    )


@query("block_row_keys", """
SELECT 'orders' AS block, count(*) AS block_rows, 0 AS repeated_keys, 0 AS unknown_keys FROM orders
UNION ALL SELECT 'lines', (SELECT count(*) FROM lineitem), (SELECT count(*) FROM (SELECT 1 FROM lineitem GROUP BY l_orderkey HAVING count(*) > 1)),
 (SELECT count(DISTINCT l_orderkey) FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders))""")
def block_row_keys(spark, sf):
    o = load(spark, sf, "orders")
    lines = load(spark, sf, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"))
    return assemble.row_key_report(o, {"orders": o, "lines": lines}, ["o_orderkey"])


@query("matrix_compare", """
WITH b AS (SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN o_totalprice + 1 ELSE o_totalprice END p, o_custkey c FROM orders WHERE o_orderkey % 11 != 0)
SELECT '<rows only left>' AS "column", count(*) FILTER (o_orderkey % 11 = 0) AS differing_rows FROM orders
UNION ALL SELECT '<rows only right>', 0
UNION ALL SELECT 'o_custkey', count(*) FILTER (o.o_custkey IS DISTINCT FROM b.c) FROM orders o JOIN b USING (o_orderkey)
UNION ALL SELECT 'o_totalprice', count(*) FILTER (o.o_totalprice IS DISTINCT FROM b.p) FROM orders o JOIN b USING (o_orderkey)""")
def matrix_compare(spark, sf):
    o = load(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    b = o.where("o_orderkey % 11 != 0").withColumn(
        "o_totalprice", F.when(F.col("o_orderkey") % 3 == 0, F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice"))
    )
    return assemble.compare_matrices(o, b, ["o_orderkey"])


@query("column_blocks", BLOCK_SQL + """
SELECT o.o_orderkey, dd AS ord_days_since_last, round(v, 4) AS price_latest, dd AS price_days_since_latest
FROM orders o LEFT JOIN l USING (o_orderkey)""")
def column_blocks(spark, sf):
    """Recency and last-value columns of the assembled matrix."""
    full = assemble_blocks(spark, sf)
    keep = ["o_orderkey"]
    names = set(assemble.columns_of_block(full.columns, "last_only", keep)) | set(assemble.columns_of_block(full.columns, "recency_only", keep))
    return full.select(*[c for c in full.columns if c in names])


@query("residual_split", "SELECT o_orderkey, o_custkey FROM orders")
def residual_split(spark, sf):
    """Baseline side of one combined matrix."""
    o = load(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    return assemble.split_residual(o, ["o_totalprice"])[0]


@query("indicator_fill", """
SELECT o_orderkey, CASE WHEN o_totalprice > 200000 THEN -999.0 ELSE o_totalprice END AS price, (o_totalprice > 200000)::INT AS price__is_missing FROM orders""")
def indicator_fill(spark, sf):
    o = load(spark, sf, "orders").select("o_orderkey", F.when(~(F.col("o_totalprice") > 200000), F.col("o_totalprice")).alias("price"))
    return col.with_indicators(o, ["price"], fill=-999.0)


@query("finite_fill", "SELECT o_orderkey, CASE WHEN o_custkey % 3 = 2 THEN o_totalprice ELSE 0.0 END AS price FROM orders")
def finite_fill(spark, sf):
    v = F.when(F.col("o_custkey") % 3 == 2, F.col("o_totalprice")).when(F.col("o_custkey") % 3 == 1, F.lit(float("inf")))
    return col.fill_numbers(load(spark, sf, "orders").select("o_orderkey", v.alias("price")), ["price"])


LINE_NUMBERS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_suppkey"]


@query("random_columns", f"SELECT l_orderkey, l_linenumber, {', '.join(assemble.random_columns(LINE_NUMBERS, 3, 41))} FROM lineitem")
def random_columns(spark, sf):
    return load(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", *assemble.random_columns(LINE_NUMBERS, 3, 41))
