"""Metric and ranking operators bound to the driver tables, with DuckDB oracles."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tidemark.operators import dependency as dep
from tidemark.operators import metrics, rank, temporal
from tidemark.plans.data import customer_geo, load, orders_history, round_to, rounded
from tidemark.plans.dependency_queries import GEO_COLS, GEO_STATS
from tidemark.session import ensure_checkpoint_dir

QUERIES = {}
ORACLES = {}


def query(name, sql=None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


DOC_FEATURES = ["n_chars", "n_words", "digit_share", "n_lines", "amb_flat"]


def doc_features(spark, sf):
    """Numeric features of the whole text of every document."""
    text = F.col("text")
    return load(spark, sf, "documents").select(
        "doc_id", "n_chars", F.size(F.split(text, " ", -1)).cast("bigint").alias("n_words"),
        (F.length(F.regexp_replace(text, "[^0-9]", "")) / F.greatest(F.length(text), F.lit(1))).alias("digit_share"),
        F.when(F.col("doc_id") % 13 != 0, F.length(F.regexp_replace(text, "[^\n]", "")).cast("bigint") + 1).alias("n_lines"),
        F.lit(1).alias("amb_flat"),
    )


DOC_SQL = """doc AS (SELECT doc_id, n_chars, len(string_split(text, ' ')) n_words,
  length(regexp_replace(text, '[^0-9]', '', 'g'))::DOUBLE / greatest(length(text), 1) digit_share,
  CASE WHEN doc_id % 13 != 0 THEN length(regexp_replace(text, '[^\n]', '', 'g')) + 1 END n_lines, 1 AS amb_flat FROM documents)"""


def labelled(spark, sf):
    return doc_features(spark, sf).join(load(spark, sf, "labels"), "doc_id")


def labelled_once(spark, sf):
    """The same rows, written to the shared folder: several models read numbers, the texts are read once."""
    folder, d = f"{ensure_checkpoint_dir(spark).rstrip('/')}/labelled-{uuid.uuid4().hex}", labelled(spark, sf)
    d.write.parquet(folder)
    return spark.read.schema(d.schema).parquet(folder)


SCORED_SQL = f"""{DOC_SQL},
sc AS (SELECT doc_id, quality y, 1 / (1 + exp(-(digit_share * 20 - 1))) s, toxic g FROM doc JOIN labels USING (doc_id))"""


def scored(spark, sf):
    return labelled(spark, sf).select(
        "doc_id", F.col("quality").alias("y"), (1 / (1 + F.exp(-(F.col("digit_share") * 20.0 - 1.0)))).alias("s"), F.col("toxic").alias("g")
    )


BINARY_SQL = """
pairs AS (SELECT {by} sum(CASE WHEN p.s > n.s THEN 1.0 WHEN p.s = n.s THEN 0.5 ELSE 0 END) / count(*) auc
  FROM sc p JOIN sc n ON p.y = 1 AND n.y = 0 {on} {gb}),
ap0 AS (SELECT a.doc_id, any_value(a.g) g, count(*) FILTER (b.y = 1) / count(*)::DOUBLE pr FROM sc a JOIN sc b ON b.s >= a.s {onab} WHERE a.y = 1 GROUP BY a.doc_id)"""


@query("metrics_binary", f"""WITH {SCORED_SQL}, {BINARY_SQL.format(by='', on='', gb='', onab='')}
SELECT count(*) AS n_rows, round(avg(((s >= 0.5) = (y = 1))::INT), 6) AS accuracy, round((SELECT auc FROM pairs), 6) AS roc_auc,
  round((SELECT avg(pr) FROM ap0), 6) AS average_precision,
  round(avg(-(y * ln(s) + (1 - y) * ln(1 - s))), 6) AS log_loss FROM sc""")
def metrics_binary(spark, sf):
    return rounded(metrics.binary_metrics(scored(spark, sf), "y", "s"))


@query("metrics_binary_grouped", f"""WITH {SCORED_SQL},
{BINARY_SQL.format(by='p.g,', on='AND p.g = n.g', gb='GROUP BY p.g', onab='AND a.g = b.g')},
m AS (SELECT g, avg(pr) ap FROM ap0 GROUP BY g)
SELECT sc.g, count(*) AS n_rows, round(avg(((s >= 0.5) = (y = 1))::INT), 6) AS accuracy, round(any_value(auc), 6) AS roc_auc,
  round(any_value(ap), 6) AS average_precision, round(avg(-(y * ln(s) + (1 - y) * ln(1 - s))), 6) AS log_loss
FROM sc LEFT JOIN pairs ON pairs.g = sc.g LEFT JOIN m ON m.g = sc.g GROUP BY sc.g""")
def metrics_binary_grouped(spark, sf):
    return rounded(metrics.binary_metrics(scored(spark, sf), "y", "s", ["g"]))


@query("metrics_binary_orders", """
WITH d AS (SELECT o_orderkey, (o_totalprice > 250000)::INT y, o_custkey::DOUBLE % 97 / 97 s FROM orders),
c AS (SELECT s, count(*) FILTER (y = 1) p, count(*) FILTER (y = 0) n FROM d GROUP BY s),
w AS (SELECT *, sum(p) OVER (ORDER BY s DESC)::DOUBLE gp, sum(n) OVER (ORDER BY s DESC)::DOUBLE gn, sum(p) OVER ()::DOUBLE tp, sum(n) OVER ()::DOUBLE tn FROM c)
SELECT sum(p + n)::BIGINT AS n_rows, round(sum(CASE WHEN s >= 0.5 THEN p ELSE n END)::DOUBLE / sum(p + n), 6) AS accuracy,
  round(sum(p * (tn - gn + n / 2.0)) / any_value(tp * tn), 6) AS roc_auc, round(sum(p * gp / (gp + gn)) / any_value(tp), 6) AS average_precision,
  round(-sum(p * ln(least(greatest(s, 1e-15), 1 - 1e-15)) + n * ln(1 - least(greatest(s, 1e-15), 1 - 1e-15))) / sum(p + n), 6) AS log_loss FROM w""")
def metrics_binary_orders(spark, sf):
    o = load(spark, sf, "orders").select(
        (F.col("o_totalprice") > 250000).cast("int").alias("y"), (F.col("o_custkey").cast("double") % 97.0 / 97.0).alias("s")
    )
    return rounded(metrics.binary_metrics(o, "y", "s"))


@query("metrics_multiclass", """
WITH d AS (SELECT p_brand t, CASE WHEN p_partkey % 3 = 0 THEN 'Brand#' || (p_size % 5 + 1) || (p_size % 4 + 1) ELSE p_brand END p FROM part),
c AS (SELECT t c FROM d UNION SELECT p FROM d),
k AS (SELECT c, (SELECT count(*) FROM d WHERE t = c) tr, (SELECT count(*) FROM d WHERE p = c) sd, (SELECT count(*) FROM d WHERE p = c AND t = c) h FROM c),
f AS (SELECT *, CASE WHEN h > 0 THEN 2.0 * h / (tr + sd) ELSE 0 END f1 FROM k)
SELECT sum(tr)::BIGINT AS n_rows, round(sum(h)::DOUBLE / sum(tr), 6) AS accuracy, round(sum(h)::DOUBLE / sum(tr), 6) AS f1_micro,
  round(avg(f1), 6) AS f1_macro, round(sum(f1 * tr) / sum(tr), 6) AS f1_weighted FROM f""")
def metrics_multiclass(spark, sf):
    p = F.when(
        F.col("p_partkey") % 3 == 0,
        F.concat(F.lit("Brand#"), (F.col("p_size") % 5 + 1).cast("string"), (F.col("p_size") % 4 + 1).cast("string")),
    ).otherwise(F.col("p_brand"))
    return rounded(metrics.multiclass_metrics(load(spark, sf, "part").select("p_brand", p.alias("p")), "p_brand", "p"))


@query("metrics_probability", """
WITH e AS (SELECT vec_id, label, [exp(embedding[i + 1]::DOUBLE) FOR i IN range(10)] x FROM embeddings),
p AS (SELECT label, [v / list_sum(x) FOR v IN x] p FROM e)
SELECT count(*) AS n_rows, round(avg(-ln(greatest(p[label + 1], 1e-15))), 6) AS log_loss,
  round(avg(1.0 / (1 + len([q FOR q IN p IF q > p[label + 1]]))), 6) AS mrr FROM p""")
def metrics_probability(spark, sf):
    """Softmax over the first ten coordinates as probabilities of the ten classes."""
    e = load(spark, sf, "embeddings").select(
        "label", F.transform(F.slice("embedding", 1, 10), lambda x: F.exp(x.cast("double"))).alias("x")
    )
    total = F.aggregate("x", F.lit(0.0), lambda a, b: a + b)
    e = e.withColumn("t", total).select("label", F.transform("x", lambda v: v / F.col("t")).alias("p"))
    return rounded(metrics.probability_metrics(e, "label", "p"))


FORECAST_SQL = """d AS (SELECT o_custkey k, o_orderdate t, avg(o_totalprice) v FROM orders GROUP BY 1, 2),
f AS (SELECT o_orderkey, o_totalprice y, d.v p, o_orderpriority g FROM orders ASOF LEFT JOIN d ON o_custkey = d.k AND o_orderdate > d.t)"""


def forecast(spark, sf):
    """Price of each order predicted by the customer's previous price."""
    o = orders_history(spark, sf)
    last = temporal.latest_value(
        o, o, row_key=["o_orderkey"], keys=["o_custkey"], target_time="o_orderdate", child_keys=["o_custkey"],
        child_time="o_orderdate", value="o_totalprice", prefix="price", cutoff="strict",
    )
    return o.join(last.select("o_orderkey", "price_latest"), "o_orderkey")


@query("metrics_regression", f"""WITH {FORECAST_SQL}
SELECT count(*) AS n_rows, round(sqrt(avg((y - p) ** 2)), 3) AS rmse, round(avg(abs(y - p)), 3) AS mae,
  round(1 - avg((y - p) ** 2) / var_pop(y), 3) AS r2 FROM f WHERE p IS NOT NULL""")
def metrics_regression(spark, sf):
    return rounded(metrics.regression_metrics(forecast(spark, sf), "o_totalprice", "price_latest"), 3)


@query("metrics_regression_log", f"""WITH {FORECAST_SQL}, l AS (SELECT ln(1 + y) a, ln(1 + p) b, abs(y - p) e FROM f WHERE p IS NOT NULL)
SELECT round(sqrt(avg((a - b) ** 2)), 6) AS log_rmse, round(avg(abs(a - b)), 6) AS log_mae, round(1 - avg((a - b) ** 2) / var_pop(a), 6) AS log_r2,
  round(median(e), 6) AS median_abs_error FROM l""")
def metrics_regression_log(spark, sf):
    return rounded(metrics.log_regression_metrics(forecast(spark, sf), "o_totalprice", "price_latest"))


@query("baselines_constant", """
WITH d AS (SELECT o_orderdate < TIMESTAMP '1998-01-01' tr, (o_orderstatus = 'O')::INT b, o_totalprice v FROM orders),
t AS (SELECT avg(b) FILTER (tr) p, median(v) FILTER (tr) m FROM d)
SELECT round(any_value(p), 6) AS prevalence, round(avg(-(b * ln(p) + (1 - b) * ln(1 - p))), 6) AS log_loss, round(any_value(m), 3) AS train_median,
  round(avg(abs(v - m)), 3) AS mae, round(sqrt(avg((v - m) ** 2)), 3) AS rmse FROM d, t WHERE NOT tr""")
def baselines_constant(spark, sf):
    rows = load(spark, sf, "orders").select("o_orderdate", (F.col("o_orderstatus") == "O").cast("int").alias("b"), "o_totalprice")
    cut = "o_orderdate < timestamp_ntz'1998-01-01 00:00:00'"
    out = metrics.constant_baselines(rows.where(cut), rows.where(f"not ({cut})"), binary="b", numeric="o_totalprice")
    return _two_scales(out)


def _two_scales(out):
    digits = {"prevalence": 6, "log_loss": 6, "train_median": 3, "mae": 3, "rmse": 3}
    return out.select(*[round_to(c, d).alias(c) for c, d in digits.items()])


@query("subgroup_metrics", f"""WITH {FORECAST_SQL},
h AS (SELECT y > 250000 t, coalesce(p, 0) > 250000 n, FALSE b, CASE WHEN p IS NULL THEN 'cold' ELSE 'warm' END subgroup FROM f)
SELECT subgroup, count(*) AS n_rows, round(avg((t = b)::INT), 6) AS base_accuracy, round(avg((t = n)::INT), 6) AS new_accuracy,
  round(avg((t = n)::INT) - avg((t = b)::INT), 6) AS gain FROM h GROUP BY subgroup""")
def subgroup_metrics(spark, sf):
    f = forecast(spark, sf).select(
        (F.col("o_totalprice") > 250000).alias("y"), F.lit(False).alias("b"),
        (F.coalesce("price_latest", F.lit(0.0)) > 250000).alias("n"), F.col("price_latest").isNull().alias("cold"),
    )
    return rounded(metrics.subgroup_gains(f, "y", "b", "n", F.when(F.col("cold"), "cold").otherwise("warm")))


@query("prediction_rows", f"""WITH {FORECAST_SQL}
SELECT o_orderkey, o_custkey, o_orderdate, y AS y_true, p AS y_score FROM f JOIN orders USING (o_orderkey)""")
def prediction_rows(spark, sf):
    pred = forecast(spark, sf).select("o_orderkey", F.col("o_totalprice").alias("y_true"), F.col("price_latest").alias("y_score"))
    return metrics.prediction_rows(load(spark, sf, "orders"), pred, ["o_orderkey"], ["o_custkey", "o_orderdate"])


@query("leakage_delta", """
WITH j AS (
  SELECT t.o_orderkey, any_value(t.o_totalprice) > 250000 y, count(c.o_orderkey) FILTER (c.o_orderdate < t.o_orderdate) safe, count(c.o_orderkey) leaky,
    count(*) FILTER (date_diff('day', c.o_orderdate, t.o_orderdate) < 0) early
  FROM orders t JOIN orders c ON c.o_custkey = t.o_custkey GROUP BY 1)
SELECT count(*) AS n_rows, sum(safe)::BIGINT AS safe_rows, sum(leaky)::BIGINT AS leaky_rows, sum(early)::BIGINT AS rows_after_cutoff,
  0 AS negative_gaps, round(corr(y::INT, safe), 6) AS safe_corr, round(corr(y::INT, leaky), 6) AS leaky_corr,
  round(corr(y::INT, leaky) - corr(y::INT, safe), 6) AS corr_delta FROM j""")
def leakage_delta(spark, sf):
    """The same history count with and without the cutoff, and proof that no safe gap is negative."""
    o = orders_history(spark, sf)
    safe = temporal.lookback_counts(
        o, o, row_key=["o_orderkey"], keys=["o_custkey"], target_time="o_orderdate", child_keys=["o_custkey"],
        child_time="o_orderdate", prefix="safe", windows_days=(),
    )
    last = o.groupBy("o_custkey").agg(F.count("*").alias("leaky"))
    late = temporal.as_of_state(
        o, o, row_key=["o_orderkey"], keys=["o_custkey"], at=F.date_trunc("day", "o_orderdate").cast("timestamp_ntz") + F.expr("interval 1 day"),
        child_keys=["o_custkey"], child_at=F.col("o_orderdate") + F.expr("interval 1 microsecond"), adds={"today": F.lit(1).cast("bigint")},
    ).select("o_orderkey", "today")
    y = (F.col("o_totalprice") > 250000).cast("int")
    rows = o.join(last, "o_custkey").join(safe, "o_orderkey").join(late, "o_orderkey")
    a, b = F.corr(y, F.col("safe_past_count")), F.corr(y, F.col("leaky"))
    return rounded(
        rows.agg(
            F.count("*").alias("n_rows"), F.sum("safe_past_count").alias("safe_rows"), F.sum("leaky").alias("leaky_rows"),
            F.sum(F.col("leaky") - F.coalesce("today", F.lit(0))).alias("rows_after_cutoff"),
            F.count_if(F.col("safe_days_since_last") < 0).cast("int").alias("negative_gaps"),
            a.alias("safe_corr"), b.alias("leaky_corr"), (b - a).alias("corr_delta"),
        )
    )


PROFILE_SQL = " UNION ALL ".join(
    f"""SELECT '{c}' AS feature, count(*) AS n_rows, count({c})::DOUBLE / count(*) nonnull_rate, stddev_samp({c}) std,
  avg(abs({c})) mean_abs, count(DISTINCT {c}) n_distinct, count(DISTINCT {c})::DOUBLE / count(*) distinct_ratio FROM doc"""
    for c in DOC_FEATURES
)
PROFILE_OUT = """feature, n_rows, round(nonnull_rate, 6) AS nonnull_rate, round(std, 4) AS std, round(mean_abs, 4) AS mean_abs,
  n_distinct, round(distinct_ratio, 6) AS distinct_ratio"""


def _profile(spark, sf):
    return rank.feature_profile(doc_features(spark, sf), DOC_FEATURES)


def _round_profile(df):
    return df.select(*[round_to(c, 4 if c in ("std", "mean_abs") else 6).alias(c) if k == "double" else F.col(c) for c, k in df.dtypes])


@query("feature_profile", f"WITH {DOC_SQL}, pr AS ({PROFILE_SQL}) SELECT {PROFILE_OUT} FROM pr")
def feature_profile(spark, sf):
    return _round_profile(_profile(spark, sf))


@query("topk_unsupervised", f"""WITH {DOC_SQL}, pr AS ({PROFILE_SQL}),
s AS (SELECT *, nonnull_rate + 0.1 * ln(1 + n_distinct) - CASE WHEN n_distinct <= 1 THEN 0.5 ELSE 0 END a,
  nonnull_rate + 0.25 * ln(1 + n_distinct) / ln(1 + greatest(n_rows, 2)) - CASE WHEN feature = 'n_chars' THEN 0.5 ELSE 0 END - CASE WHEN n_distinct <= 1 THEN 0.5 ELSE 0 END b FROM pr)
SELECT {PROFILE_OUT}, round(a, 6) AS score_log, round(b, 6) AS score_share, row_number() OVER (ORDER BY a DESC, feature)::INT AS rank,
  row_number() OVER (ORDER BY a DESC, feature) <= 2 AS selected FROM s""")
def topk_unsupervised(spark, sf):
    s = rank.unsupervised_scores(_profile(spark, sf), id_like=["n_chars"])
    return _round_profile(rank.ranked(s, [F.desc("score_log"), F.col("feature")], 2))


HEUR_COLS = ["n_chars", "digit_share", "f_doc_count", "f_doc_mean", "f_doc_days_since_last", "f_doc_mean__is_missing", "f_amb__a_to_b__entropy", "f_amb__a_to_b__majconf__is_missing"]


def _heur_rows(spark, sf):
    d = doc_features(spark, sf)
    return d.select(
        "n_chars", "digit_share", F.col("n_words").alias("f_doc_count"), F.col("n_lines").cast("double").alias("f_doc_mean"),
        F.col("n_lines").alias("f_doc_days_since_last"), F.col("n_lines").isNull().cast("int").alias("f_doc_mean__is_missing"),
        F.col("digit_share").alias("f_amb__a_to_b__entropy"), F.col("amb_flat").alias("f_amb__a_to_b__majconf__is_missing"),
    )


@query("heuristic_rank", f"""WITH {DOC_SQL}, nn AS (SELECT count(n_lines)::DOUBLE / count(*) r FROM doc),
f(feature, block, aggregator, cov, rel, bonus, uniq, path, cost, red) AS (
  SELECT 'n_chars', 'target_original', 'unknown', 1.0, 0.8, 0.0, 0.0, 0, 0.10, 0.0 UNION ALL
  SELECT 'digit_share', 'target_original', 'unknown', 1.0, 0.8, 0.0, 0.0, 0, 0.10, 0.0 UNION ALL
  SELECT 'f_doc_count', 'aggregation', 'count', 1.0, 1.0, 0.0, 0.0, 1, 0.20, 0.0 UNION ALL
  SELECT 'f_doc_mean', 'aggregation', 'mean', r, 1.0, 0.0, 0.0, 1, 0.30, 0.0 FROM nn UNION ALL
  SELECT 'f_doc_days_since_last', 'temporal_aggregation', 'last_delta', r, 1.0, 0.0, 0.0, 1, 0.50, 0.0 FROM nn UNION ALL
  SELECT 'f_doc_mean__is_missing', 'aggregation', 'missing_indicator', 1.0, 1.0, 0.0, 0.0, 1, 0.05, 0.15 UNION ALL
  SELECT 'f_amb__a_to_b__entropy', 'ambiguity', 'entropy', 1.0, 0.9, 0.5, 0.14, 1, 0.20, 0.0 UNION ALL
  SELECT 'f_amb__a_to_b__majconf__is_missing', 'ambiguity', 'missing_indicator', 1.0, 0.9, 0.1, 0.14, 1, 0.05, 0.15),
s AS (SELECT *, 1.5 * rel + 0.8 * ln(1 + cov) + bonus - uniq - 0.2 * path - 0.3 * cost - red AS sc FROM f)
SELECT feature, block, aggregator, round(cov, 6) AS nonnull_rate, round(rel, 6) AS reliability, round(uniq, 6) AS uniqueness_penalty,
  round(cost, 6) AS cost, round(sc, 6) AS heuristic_score, row_number() OVER (ORDER BY round(sc, 9) DESC, feature)::INT AS rank,
  row_number() OVER (ORDER BY round(sc, 9) DESC, feature) <= 3 AS selected FROM s""")
def heuristic_rank(spark, sf):
    edges = spark.createDataFrame([("f_amb__a_to_b", 0.9, 0.2)], "feature_stem string, edge_weight double, lhs_uniqueness double")
    s = rank.heuristic_scores(rank.feature_profile(_heur_rows(spark, sf), HEUR_COLS), "f_doc_", edges)
    return rounded(rank.ranked(s, [F.desc(F.round("heuristic_score", 9)), F.col("feature")], 3))


# Name-pattern weights of the label-free ranker.
LABEL_FREE_RULES = [
    ("count_distinct", 2.0), ("nunique", 1.8), ("__count|_count$", 1.2), ("__mean", 0.8), ("__max|__min", 0.5), ("body", 0.6),
    ("title", 0.5), ("tags", 0.5), ("id_payload|row_id", -2.0),
]


@query("label_free_rank", f"""WITH {DOC_SQL}, pr AS ({' UNION ALL '.join(
    f"SELECT '{c}' feature, count({s})::DOUBLE / count(*) nn, count(DISTINCT {s}) nd, {w} w FROM doc" for c, s, w in [
        ('n_chars', 'n_chars', 0.0), ('digit_share', 'digit_share', 0.0), ('f_doc_count', 'n_words', 1.2), ('f_doc_mean', 'n_lines', 0.0),
        ('f_doc_days_since_last', 'n_lines', 0.0)])}),
s AS (SELECT *, w + nn + CASE WHEN nd <= 1 THEN -2.0 WHEN nd <= 500 THEN 0.7 WHEN nd <= 5000 THEN 0.2 ELSE -0.5 END - 0.02 * len(string_split(feature, '_')) sc FROM pr)
SELECT feature, round(nn, 6) AS nonnull_rate, nd AS n_distinct, round(sc, 6) AS label_free_score,
  row_number() OVER (ORDER BY round(sc, 9) DESC, nn DESC, nd DESC, feature)::INT AS rank,
  row_number() OVER (ORDER BY round(sc, 9) DESC, nn DESC, nd DESC, feature) <= 2 AS selected FROM s""")
def label_free_rank(spark, sf):
    cols = ["n_chars", "digit_share", "f_doc_count", "f_doc_mean", "f_doc_days_since_last"]
    s = rank.label_free_scores(rank.feature_profile(_heur_rows(spark, sf), cols), LABEL_FREE_RULES)
    return rounded(rank.ranked(s, [F.desc(F.round("label_free_score", 9)), F.desc("nonnull_rate"), F.desc("n_distinct"), F.col("feature")], 2))


def _supervised_sql():
    parts = []
    for c in DOC_FEATURES:
        parts.append(f"""SELECT '{c}' feature, doc_id, coalesce({c}, 0)::DOUBLE v, quality y FROM doc JOIN labels USING (doc_id)""")
    return f"""WITH {DOC_SQL}, l AS ({' UNION ALL '.join(parts)}),
auc AS (SELECT p.feature, sum(CASE WHEN p.v > n.v THEN 1.0 WHEN p.v = n.v THEN 0.5 ELSE 0 END) / count(*) auc
  FROM l p JOIN l n ON p.feature = n.feature AND p.y = 1 AND n.y = 0 GROUP BY 1),
ap AS (SELECT feature, avg(pr) ap FROM (
  SELECT a.feature, a.doc_id, count(*) FILTER (b.y = 1) / count(*)::DOUBLE pr FROM l a JOIN l b ON a.feature = b.feature AND b.v >= a.v WHERE a.y = 1 GROUP BY 1, 2) GROUP BY 1),
bins AS (SELECT feature, doc_id, y, v, floor((rank() OVER (PARTITION BY feature ORDER BY v DESC) - 1) * 10.0 / count(*) OVER (PARTITION BY feature)) b FROM l),
j AS (SELECT feature, b, y, count(*)::DOUBLE n FROM bins GROUP BY ALL),
mi AS (SELECT feature, sum(n / t * ln(n * t / (nb * ny))) mi FROM (
  SELECT *, sum(n) OVER (PARTITION BY feature) t, sum(n) OVER (PARTITION BY feature, b) nb, sum(n) OVER (PARTITION BY feature, y) ny FROM j) GROUP BY 1),
near AS (SELECT a.feature, a.doc_id, a.v, least(3, count(*)) k, count(*) + 1 n_c, list_sort(list(abs(a.v - b.v)))[least(3, count(*))] r
  FROM l a JOIN l b ON a.feature = b.feature AND a.y = b.y AND a.doc_id <> b.doc_id GROUP BY 1, 2, 3),
inner_rows AS (SELECT n.feature, n.doc_id, any_value(n.k) k, any_value(n.n_c) n_c, count(*) m FROM near n JOIN near o
  ON n.feature = o.feature AND CASE WHEN n.r > 0 THEN abs(n.v - o.v) < n.r * (1 - 1e-9) ELSE n.v = o.v END GROUP BY 1, 2),
psi AS (SELECT x, -0.5772156649015329 + coalesce(list_sum(list_transform(range(1, x), lambda t: 1.0 / t)), 0) p FROM (SELECT unnest(range(1, (SELECT count(*) + 1 FROM doc))) x)),
knn AS (SELECT feature, greatest(0, any_value(t.p) + avg(a.p) - avg(b.p) - avg(c.p)) mi FROM inner_rows i JOIN psi a ON a.x = i.k JOIN psi b ON b.x = i.n_c JOIN psi c ON c.x = i.m
  JOIN (SELECT feature, count(*) n FROM near GROUP BY 1) z USING (feature) JOIN psi t ON t.x = z.n GROUP BY 1),
u AS (SELECT feature, count(DISTINCT v) nunique FROM l GROUP BY 1),
s AS (SELECT feature, nunique, CASE WHEN nunique > 1 THEN auc END roc_auc, CASE WHEN nunique > 1 THEN greatest(auc, 1 - auc) END roc_auc_oriented,
  CASE WHEN nunique > 1 THEN ap END average_precision, CASE WHEN nunique > 1 THEN knn.mi END mi, CASE WHEN nunique > 1 THEN mi.mi END mi_binned,
  CASE WHEN nunique > 1 THEN 2 * abs(auc - 0.5) ELSE -1 END score_auc, CASE WHEN nunique > 1 THEN ap ELSE -1 END score_ap,
  CASE WHEN nunique > 1 THEN knn.mi ELSE -1 END score_mi FROM u JOIN auc USING (feature) JOIN ap USING (feature) JOIN mi USING (feature) JOIN knn USING (feature))
SELECT feature, nunique, """ + ", ".join(
        f"round({c}, 6) AS {c}" for c in ["roc_auc", "roc_auc_oriented", "average_precision", "mi", "mi_binned", "score_auc", "score_ap", "score_mi"]
    ) + ", row_number() OVER (ORDER BY score_ap DESC, roc_auc_oriented DESC)::INT AS rank, row_number() OVER (ORDER BY score_ap DESC, roc_auc_oriented DESC) <= 3 AS selected FROM s"


@query("supervised_rank_quality", _supervised_sql())
def supervised_rank_quality(spark, sf):
    s = rank.supervised_scores(labelled(spark, sf), DOC_FEATURES, "quality")
    return rounded(rank.rank_supervised(s, "ap", 3))


TRUE_EDGES = [("n_name", "r_name"), ("n_name", "n_regionkey"), ("n_regionkey", "r_name"), ("r_name", "n_regionkey")]


def _edge_rows(spark, sf):
    stats = dep.penalised_scores(dep.pair_statistics(customer_geo(spark, sf), GEO_COLS))
    truth = F.lit(False)
    for a, b in TRUE_EDGES:
        truth = truth | ((F.col("lhs") == a) & (F.col("rhs") == b))
    kind = F.when(F.col("is_id_like"), "surrogate").otherwise("ordinary")
    return stats.select("lhs", "rhs", "score", "score_penalised", truth.cast("int").alias("truth"), kind.alias("kind"))


def edge_precision_at_k(spark, sf):
    rows = _edge_rows(spark, sf)
    long = rows.select("lhs", "rhs", "truth", "kind", F.lit("plain").alias("method"), "score").unionByName(
        rows.select("lhs", "rhs", "truth", "kind", F.lit("penalised").alias("method"), F.col("score_penalised").alias("score"))
    )
    long = long.withColumn("score", F.round("score", 9))
    return rounded(rank.edge_quality(long, "score", "truth", "kind", [3, 5], ["method"]))


QUERIES["edge_precision_at_k"] = edge_precision_at_k
_TRUTH = " OR ".join(f"(lhs = '{a}' AND rhs = '{b}')" for a, b in TRUE_EDGES)
ORACLES["edge_precision_at_k"] = f"""{GEO_STATS},
q AS (SELECT lhs, rhs, ({_TRUTH})::INT truth, lhs_uniqueness > 0.95 sur, 3 * r_del + 0.2 * ln(1 + 100 * lhs_support_repeated) a, lhs_uniqueness u FROM stats),
l AS (SELECT lhs, rhs, truth, sur, 'plain' AS method, round(a, 9) s FROM q UNION ALL SELECT lhs, rhs, truth, sur, 'penalised', round(a - 4 * u, 9) FROM q),
auc AS (SELECT p.method, sum(CASE WHEN p.s > n.s THEN 1.0 WHEN p.s = n.s THEN 0.5 ELSE 0 END) / count(*) auc FROM l p JOIN l n ON p.method = n.method AND p.truth = 1 AND n.truth = 0 GROUP BY 1),
ap AS (SELECT method, avg(pr) ap FROM (SELECT a.method, a.lhs, a.rhs, count(*) FILTER (b.truth = 1) / count(*)::DOUBLE pr FROM l a JOIN l b ON a.method = b.method AND b.s >= a.s WHERE a.truth = 1 GROUP BY ALL) GROUP BY 1),
k AS (SELECT *, row_number() OVER (PARTITION BY method ORDER BY s DESC, lhs, rhs) r FROM l)
SELECT k.method, round(any_value(auc), 6) AS roc_auc, round(any_value(ap), 6) AS average_precision, """ + ", ".join(
    f"""count(*) FILTER (r <= {n} AND truth = 1) AS tp_at_{n}, round(count(*) FILTER (r <= {n} AND truth = 1) / {n}.0, 6) AS precision_at_{n},
  round(count(*) FILTER (r <= {n} AND truth = 1) / {len(TRUE_EDGES)}.0, 6) AS recall_at_{n}, round(count(*) FILTER (r <= {n} AND sur) / {n}.0, 6) AS surrogate_rate_at_{n},
  round(0.0, 6) AS constant_rate_at_{n}""" for n in (3, 5)
) + " FROM k JOIN auc USING (method) JOIN ap USING (method) GROUP BY k.method"


def program_recall(spark, sf):
    rows = _edge_rows(spark, sf).select(F.concat_ws("->", "lhs", "rhs").alias("feature"), "truth", "score", "score_penalised")
    long = rows.select("feature", "truth", F.lit("plain").alias("method"), F.round("score", 9).alias("s")).unionByName(
        rows.select("feature", "truth", F.lit("penalised").alias("method"), F.round("score_penalised", 9).alias("s"))
    )
    ranking = rank.ranked(long, [F.desc("s"), F.col("feature")], groups=["method"])
    truth = long.where("truth = 1").select("method", "feature")
    return rounded(rank.program_recall(ranking, truth, [2, 4, 8], ["method"]))


QUERIES["program_recall"] = program_recall
ORACLES["program_recall"] = f"""{GEO_STATS},
q AS (SELECT lhs || '->' || rhs feature, ({_TRUTH}) truth, 3 * r_del + 0.2 * ln(1 + 100 * lhs_support_repeated) a, lhs_uniqueness u FROM stats),
l AS (SELECT feature, truth, 'plain' AS method, round(a, 9) s FROM q UNION ALL SELECT feature, truth, 'penalised', round(a - 4 * u, 9) FROM q),
k AS (SELECT *, row_number() OVER (PARTITION BY method ORDER BY s DESC, feature) r FROM l)
SELECT method, n::INT AS k, coalesce(string_agg(feature, ',' ORDER BY feature) FILTER (r <= n), '') AS recovered,
  coalesce(string_agg(feature, ',' ORDER BY feature) FILTER (r > n), '') AS missing, round(count(*) FILTER (r <= n)::DOUBLE / count(*), 6) AS recall
FROM k, (VALUES (2), (4), (8)) t(n) WHERE truth GROUP BY method, n"""
