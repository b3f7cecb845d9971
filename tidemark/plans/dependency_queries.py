"""Dependency operators bound to the driver tables, with DuckDB oracles."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from tidemark.operators import dependency as dep
from tidemark.operators import paths
from tidemark.plans.data import CUSTOMER_GEO_SQL, customer_geo, load, rounded

QUERIES = {}
ORACLES = {}


def pair_sql(source: str, total: str, columns: list[str]) -> str:
    """Brute-force pair statistics: every ordered pair on its own, entropies from probabilities."""
    blocks = []
    for x in columns:
        for a in columns:
            if x == a:
                continue
            blocks.append(f"""
SELECT '{x}' lhs, '{a}' rhs, x, a, count(*)::DOUBLE n FROM (
  SELECT CAST({x} AS VARCHAR) x, CAST({a} AS VARCHAR) a FROM {source}) WHERE x IS NOT NULL AND a IS NOT NULL GROUP BY x, a""")
    return f"""cells AS ({' UNION ALL '.join(blocks)}),
vx AS (SELECT lhs, rhs, x, sum(n) nx, max(n) top, count(*) na, sum(n * (n - 1) / 2) same FROM cells GROUP BY ALL),
va AS (SELECT lhs, rhs, a, sum(n) n FROM cells GROUP BY ALL),
tot AS (SELECT lhs, rhs, sum(n) n FROM cells GROUP BY ALL),
ha AS (SELECT lhs, rhs, -sum((va.n / tot.n) * ln(va.n / tot.n)) h, count(*) nr FROM va JOIN tot USING (lhs, rhs) GROUP BY ALL),
hx AS (SELECT lhs, rhs, sum(nx / tot.n * hv) hc FROM (
    SELECT lhs, rhs, x, any_value(nx) nx, -sum((c.n / nx) * ln(c.n / nx)) hv FROM cells c JOIN vx USING (lhs, rhs, x) GROUP BY lhs, rhs, x)
  JOIN tot USING (lhs, rhs) GROUP BY ALL),
st AS (
  SELECT lhs, rhs, any_value(tot.n) n, sum(top) kept, sum(CASE WHEN na > 1 THEN nx ELSE 0 END) viol, sum(nx * (nx - 1) / 2) lp,
    sum(same) sp, count(*) nl, sum(CASE WHEN nx >= 2 THEN nx ELSE 0 END) rep
  FROM vx JOIN tot USING (lhs, rhs) GROUP BY lhs, rhs),
stats AS (
  SELECT lhs, rhs, ({total})::BIGINT n_total, n::BIGINT n_valid, n / ({total}) coverage, kept / n r_del,
    CASE WHEN h > 1e-12 THEN 1 - hc / h ELSE 1.0 END r_ent, CASE WHEN lp > 0 THEN 1 - (lp - sp) / lp END r_pair,
    1 - (lp - sp) / (n * (n - 1) / 2) r_pair_all, 1 - viol / n r_tuple, nl / n lhs_uniqueness, lp / (n * (n - 1) / 2) lhs_collision,
    rep / n lhs_support_repeated, h rhs_entropy, nl n_lhs_values, nr n_rhs_values, abs(kept / n - 1) <= 1e-12 exact_fd
  FROM st JOIN ha USING (lhs, rhs) JOIN hx USING (lhs, rhs)),
scored AS (SELECT *, 1.2 * r_del + 0.8 * r_ent + 0.5 * lhs_support_repeated + 0.3 * coverage - 0.9 * lhs_uniqueness heuristic_score FROM stats)"""


STAT_COLS = ["coverage", "r_del", "r_ent", "r_pair", "r_pair_all", "r_tuple", "lhs_uniqueness", "lhs_collision", "lhs_support_repeated", "rhs_entropy", "heuristic_score"]
STAT_SELECT = (
    "SELECT lhs, rhs, n_total, n_valid, n_lhs_values, n_rhs_values, exact_fd, "
    + ", ".join(f"round({c}, 6) AS {c}" for c in STAT_COLS)
)
PART_COLS = ["p_brand", "p_type", "p_size", "p_name", "p_partkey", "p_retailprice"]
GEO_COLS = ["c_custkey", "c_mktsegment", "n_name", "r_name", "n_regionkey"]
TEXT_GEO = ["c_mktsegment", "n_name", "r_name"]

QUERIES["fd_pair_stats_part"] = lambda spark, sf: rounded(dep.pair_statistics(load(spark, sf, "part"), PART_COLS))
ORACLES["fd_pair_stats_part"] = f"WITH {pair_sql('part', 'SELECT count(*) FROM part', PART_COLS)} {STAT_SELECT} FROM scored"

QUERIES["fd_pair_stats_geo"] = lambda spark, sf: rounded(dep.pair_statistics(customer_geo(spark, sf), GEO_COLS))
GEO_STATS = f"WITH {CUSTOMER_GEO_SQL}, {pair_sql('customer_geo', 'SELECT count(*) FROM customer_geo', GEO_COLS)}"
ORACLES["fd_pair_stats_geo"] = f"{GEO_STATS} {STAT_SELECT} FROM scored"

LINE_COLS = [
    "l_returnflag", "l_linestatus", "l_linenumber", "l_discount", "l_tax", "l_quantity", "l_orderkey", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate",
]
QUERIES["fd_pair_stats_lineitem"] = lambda spark, sf: rounded(dep.pair_statistics(load(spark, sf, "lineitem"), LINE_COLS))
ORACLES["fd_pair_stats_lineitem"] = (
    f"WITH {pair_sql('lineitem', 'SELECT count(*) FROM lineitem', LINE_COLS)} {STAT_SELECT} FROM scored"
)

TEXT_STATS = f"WITH {CUSTOMER_GEO_SQL}, {pair_sql('customer_geo', 'SELECT count(*) FROM customer_geo', TEXT_GEO)}"
EDGES_SQL = """, weighted AS (
  SELECT lhs, rhs, r_del, r_ent, lhs || '->' || rhs AS edge_name, 'afd' AS edge_type,
    1 / (1 + exp(-(1.5 * r_del + r_ent + 0.5 * lhs_support_repeated + 0.3 * coverage - lhs_uniqueness - 1))) edge_weight
  FROM scored WHERE r_del >= {r} AND coverage >= 0.5 AND lhs_support_repeated >= 0.05 AND lhs_uniqueness < 0.98),
edges AS (SELECT * FROM weighted ORDER BY edge_weight DESC, r_del DESC, r_ent DESC, lhs, rhs LIMIT {k})"""


def _edges(spark, sf, k, r):
    stats = dep.pair_statistics(customer_geo(spark, sf), TEXT_GEO)
    e = dep.select_edges(stats, id_columns=["c_custkey"], k=k, min_r_del=r)
    return rounded(e.select("lhs", "rhs", "edge_name", "edge_type", "r_del", "edge_weight"))


for _k, _r in ((1, 0.6), (3, 0.2)):
    QUERIES[f"fd_edges_geo_top{_k}"] = lambda spark, sf, k=_k, r=_r: _edges(spark, sf, k, r)
    ORACLES[f"fd_edges_geo_top{_k}"] = (
        TEXT_STATS + EDGES_SQL.format(k=_k, r=_r)
        + " SELECT lhs, rhs, edge_name, edge_type, round(r_del, 6) AS r_del, round(edge_weight, 6) AS edge_weight FROM edges"
    )

AMB_SQL = """
amb AS (
  SELECT lhs_value, max(n)::DOUBLE / sum(n) mc, abs(-sum(n / tot * ln(n / tot))) en, count(*) cc, sum(n)::BIGINT sc FROM (
    SELECT n_name lhs_value, r_name a, count(*) n, sum(count(*)) OVER (PARTITION BY n_name)::DOUBLE tot FROM fit GROUP BY n_name, r_name)
  GROUP BY lhs_value)"""

QUERIES["ambiguity_map_geo"] = lambda spark, sf: rounded(dep.ambiguity_map(customer_geo(spark, sf), "n_name", "r_name"))
ORACLES["ambiguity_map_geo"] = (
    f"WITH {CUSTOMER_GEO_SQL}, fit AS (SELECT * FROM customer_geo), {AMB_SQL} "
    "SELECT lhs_value, round(mc, 6) AS majconf, round(en, 6) AS entropy, cc AS conflict_count, sc AS support_count FROM amb"
)


def ambiguity_features_orders(spark, sf):
    """Fit on customers with an order before 1998, apply to every order."""
    orders = load(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    geo = customer_geo(spark, sf)
    train = orders.where(F.col("o_orderdate") < F.expr("timestamp_ntz'1998-01-01 00:00:00'"))
    fit = dep.train_visible_rows(geo, train, entity_key="c_custkey", target_key="o_custkey")
    return rounded(
        dep.ambiguity_features(
            orders, geo, fit, [("n_name", "r_name")], row_key=["o_orderkey"], target_key="o_custkey",
            entity_key="c_custkey", entity_order=["n_name"],
        )
    )


QUERIES["ambiguity_features_orders"] = ambiguity_features_orders
ORACLES["ambiguity_features_orders"] = f"""WITH {CUSTOMER_GEO_SQL}, fit AS (
  SELECT * FROM customer_geo WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderdate < TIMESTAMP '1998-01-01')), {AMB_SQL}
SELECT o_orderkey, round(mc, 6) AS f_amb__n_name_to_r_name__majconf, round(en, 6) AS f_amb__n_name_to_r_name__entropy,
  cc AS f_amb__n_name_to_r_name__conflict_count, sc AS f_amb__n_name_to_r_name__support_count,
  (mc IS NULL)::INT AS f_amb__n_name_to_r_name__majconf__is_missing, (en IS NULL)::INT AS f_amb__n_name_to_r_name__entropy__is_missing,
  (cc IS NULL)::INT AS f_amb__n_name_to_r_name__conflict_count__is_missing,
  (sc IS NULL)::INT AS f_amb__n_name_to_r_name__support_count__is_missing
FROM orders LEFT JOIN customer_geo ON c_custkey = o_custkey LEFT JOIN amb ON lhs_value = n_name"""

QUERIES["majority_impute_geo"] = lambda spark, sf: dep.majority_imputation(customer_geo(spark, sf), "n_name", "r_name")
ORACLES["majority_impute_geo"] = f"""WITH {CUSTOMER_GEO_SQL},
c AS (SELECT n_name, r_name, count(*) n FROM customer_geo GROUP BY ALL)
SELECT n_name, first(r_name ORDER BY n DESC, r_name) AS fd_majority, count(*) AS fd_conflict FROM c GROUP BY n_name"""


def _train_and_events(spark, sf):
    e = load(spark, sf, "events").select("event_id", "user_id", "ts", "event_type", "value")
    train = e.where("event_type = 'click' and ts < timestamp_ntz'2024-01-20 00:00:00'").select("user_id", F.col("ts").alias("cutoff"))
    return e, train


def fit_rows_train(spark, sf):
    e, train = _train_and_events(spark, sf)
    return dep.train_visible_rows(e, train, entity_key="user_id", target_key="user_id", entity_time="ts", target_time="cutoff")


def fit_manifest_train(spark, sf):
    e, train = _train_and_events(spark, sf)
    fit = dep.train_visible_rows(e, train, entity_key="user_id", target_key="user_id", entity_time="ts", target_time="cutoff")
    return dep.fit_manifest(e, train, fit, entity_key="user_id", target_key="user_id", entity_time="ts")


TRAIN_SQL = "train AS (SELECT user_id, max(ts) cut FROM events WHERE event_type = 'click' AND ts < TIMESTAMP '2024-01-20' GROUP BY 1)"
QUERIES["fit_rows_train"] = fit_rows_train
ORACLES["fit_rows_train"] = f"""WITH {TRAIN_SQL}
SELECT event_id, user_id, ts, event_type, value FROM events JOIN train USING (user_id) WHERE ts <= cut"""
QUERIES["fit_manifest_train"] = fit_manifest_train
ORACLES["fit_manifest_train"] = f"""WITH {TRAIN_SQL}, fit AS (SELECT e.* FROM events e JOIN train USING (user_id) WHERE ts <= cut)
SELECT (SELECT count(*) FROM events) AS source_rows, (SELECT count(*) FROM train) AS train_entities, count(*) AS fit_rows,
  count(DISTINCT user_id) AS fit_entities, max(ts) AS fit_max_time FROM fit"""

QUERIES["fd_calibration_stats"] = lambda spark, sf: rounded(
    dep.calibration_statistics(customer_geo(spark, sf), GEO_COLS, row_key=["c_custkey"], replicates=8)
)
CAL_BASE = """
SELECT lhs, rhs, round(r_pair_all, 6) AS r_pair, round(r_tuple, 6) AS r_tuple, round(r_del, 6) AS r_del,
  round(CASE WHEN rhs_entropy <= 1e-12 THEN 0.0 ELSE r_ent END, 6) AS r_ent, round(lhs_collision, 6) AS lhs_collision_rate,
  round(lhs_uniqueness, 6) AS lhs_uniqueness, round(lhs_support_repeated, 6) AS lhs_support_repeated, round(coverage, 6) AS coverage,
  round(CASE WHEN n_rhs_values > 1 THEN rhs_entropy / ln(n_rhs_values) ELSE 0.0 END, 6) AS rhs_entropy, 1 AS lhs_arity,
  round(stable, 6) AS bootstrap_stability FROM scored JOIN boot USING (lhs, rhs)"""


def _boot_sql(columns, replicates, seed):
    steps = [0.36787944117144233, 0.7357588823428847, 0.9196986029286058, 0.9810118431238462, 0.9963401531726563,
             0.9994058151824183, 0.999916758850712, 0.9999897508033253, 0.9999988747974021]
    w = " + ".join(f"(h >= {int(s * 4294967296)})::INT" for s in steps)
    pairs = [(x, a) for x in columns for a in columns if x != a]
    cells = " UNION ALL ".join(
        f"SELECT '{x}' lhs, '{a}' rhs, b, CAST({x} AS VARCHAR) x, CAST({a} AS VARCHAR) a, w FROM rw WHERE {x} IS NOT NULL AND {a} IS NOT NULL"
        for x, a in pairs
    )
    return f"""
rh AS (SELECT g.*, b, ('0x' || substr(md5(c_custkey::VARCHAR || '~{seed}~' || b::VARCHAR), 1, 8))::BIGINT h FROM customer_geo g, range({replicates}) t(b)),
rw AS (SELECT *, {w} AS w FROM rh),
bc AS (SELECT lhs, rhs, b, x, a, sum(w) w FROM ({cells}) GROUP BY ALL),
bx AS (SELECT lhs, rhs, b, x, sum(w) w, max(w) top FROM bc GROUP BY ALL),
bb AS (SELECT lhs, rhs, b, sum(w) n, sum(top) kept, sum(CASE WHEN w >= 2 THEN w ELSE 0 END) rep, count(*) FILTER (w >= 1) uni FROM bx GROUP BY ALL),
boot AS (SELECT lhs, rhs, avg((n > 0 AND kept >= 0.8 * n AND rep >= 0.1 * n AND uni <= 0.98 * n)::INT) stable FROM bb GROUP BY ALL)"""


ORACLES["fd_calibration_stats"] = f"{GEO_STATS}, {_boot_sql(GEO_COLS, 8, 41)} {CAL_BASE}"

QUERIES["fd_uniqueness_penalty"] = lambda spark, sf: rounded(
    dep.penalised_scores(dep.pair_statistics(customer_geo(spark, sf), GEO_COLS)).drop("is_id_like").join(
        dep.top_edges(
            dep.penalised_scores(dep.pair_statistics(customer_geo(spark, sf), GEO_COLS)),
            {"plain": "score", "penalised": "score_penalised"}, 8,
        ).select("lhs", "rhs", "variant", "rank", "is_id_like"),
        ["lhs", "rhs"],
    )
)
ORACLES["fd_uniqueness_penalty"] = f"""{GEO_STATS},
p AS (SELECT lhs, rhs, lhs_uniqueness, r_del confidence, r_del * (1 - lhs_uniqueness) ** 2 confidence_penalised,
  3 * r_del + 0.2 * ln(1 + 100 * lhs_support_repeated) score, lhs_uniqueness > 0.95 is_id_like FROM stats),
q AS (SELECT *, score - 4 * lhs_uniqueness score_penalised FROM p),
l AS (SELECT lhs, rhs, is_id_like, 'plain' AS variant, score v FROM q UNION ALL SELECT lhs, rhs, is_id_like, 'penalised', score_penalised FROM q),
k AS (SELECT lhs, rhs, is_id_like, variant, row_number() OVER (PARTITION BY variant ORDER BY round(v, 9) DESC, lhs, rhs)::INT AS rank FROM l)
SELECT q.lhs, q.rhs, round(lhs_uniqueness, 6) AS lhs_uniqueness, round(confidence, 6) AS confidence,
  round(confidence_penalised, 6) AS confidence_penalised, round(score, 6) AS score, round(score_penalised, 6) AS score_penalised,
  k.variant, k.rank, k.is_id_like
FROM q JOIN k ON k.lhs = q.lhs AND k.rhs = q.rhs WHERE rank <= 8"""

PROFILE_TABLES = {
    "orders": ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"],
    "part": ["p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice"],
    "customer": ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"],
}


def key_profile(spark, sf):
    parts = [
        dep.key_profile(load(spark, sf, t), cols).withColumn("table_name", F.lit(t)) for t, cols in PROFILE_TABLES.items()
    ]
    return rounded(reduce(lambda a, b: a.unionByName(b), parts))


QUERIES["key_profile"] = key_profile
ORACLES["key_profile"] = " UNION ALL ".join(
    f"""SELECT '{t}' AS table_name, '{c}' AS "column", count(*) AS n_rows, count(*) - count({c}) AS n_null,
  count(DISTINCT {c}) AS n_distinct, round(count(DISTINCT {c})::DOUBLE / count(*), 6) AS distinct_ratio,
  round((count(*) - count({c}))::DOUBLE / count(*), 6) AS null_rate, count(DISTINCT {c})::DOUBLE / count(*) > 0.95 AS id_like FROM {t}"""
    for t, cols in PROFILE_TABLES.items() for c in cols
)

FKS = [("orders", "o_custkey", "customer"), ("customer", "c_nationkey", "nation"), ("nation", "n_regionkey", "region")]
PKS = {"orders": "o_orderkey", "customer": "c_custkey", "nation": "n_nationkey", "region": "r_regionkey"}


def join_containment(spark, sf):
    t = {n: load(spark, sf, n) for n in PKS}
    t["lineitem"] = load(spark, sf, "lineitem")
    checks = [*FKS, ("lineitem", "l_orderkey", "orders"), ("orders", "o_orderkey", "customer")]
    out = None
    for child, col, parent in checks:
        one = paths.join_containment(t[child], col, t[parent], PKS[parent], f"{child}.{col}->{parent}.{PKS[parent]}")
        out = one if out is None else out.unionByName(one)
    return out


QUERIES["join_containment"] = join_containment
ORACLES["join_containment"] = " UNION ALL ".join(
    f"""SELECT '{c}.{k}->{p}.{PKS[p]}' AS path, count(*) AS child_values,
  count(*) FILTER (v NOT IN (SELECT {PKS[p]} FROM {p})) AS orphans, any_value(u) AS parent_unique,
  count(*) FILTER (v NOT IN (SELECT {PKS[p]} FROM {p})) = 0 AND any_value(u) AS valid
FROM (SELECT DISTINCT {k} v FROM {c} WHERE {k} IS NOT NULL), (SELECT count(*) = count(DISTINCT {PKS[p]}) u FROM {p})"""
    for c, k, p in [*FKS, ("lineitem", "l_orderkey", "orders"), ("orders", "o_orderkey", "customer")]
)


def two_hop_paths(spark, sf):
    tables = {n: load(spark, sf, n) for n in ("orders", "lineitem", "part", "supplier")}
    pks = {"orders": "o_orderkey", "part": "p_partkey", "supplier": "s_suppkey", "lineitem": "l_linenumber"}
    return paths.discover_two_hops(
        tables, pks, target_table="orders",
        foreign_keys=[("lineitem", "l_orderkey", "orders"), ("lineitem", "l_partkey", "part"), ("lineitem", "l_suppkey", "supplier")],
        skip_columns=["s_nationkey"],
    )


QUERIES["two_hop_paths"] = two_hop_paths
ORACLES["two_hop_paths"] = """
SELECT 'orders<-lineitem.l_orderkey|lineitem.l_partkey->part' AS path, count(*) AS child_values,
  count(*) FILTER (v NOT IN (SELECT p_partkey FROM part)) AS orphans,
  (SELECT count(*) = count(DISTINCT p_partkey) FROM part) AS parent_unique,
  count(*) FILTER (v NOT IN (SELECT p_partkey FROM part)) = 0 AND (SELECT count(*) = count(DISTINCT p_partkey) FROM part) AS valid,
  'p_name,p_brand,p_type,p_size,p_retailprice' AS usable_columns FROM (SELECT DISTINCT l_partkey v FROM lineitem)
UNION ALL
SELECT 'orders<-lineitem.l_orderkey|lineitem.l_suppkey->supplier', count(*),
  count(*) FILTER (v NOT IN (SELECT s_suppkey FROM supplier)),
  (SELECT count(*) = count(DISTINCT s_suppkey) FROM supplier),
  count(*) FILTER (v NOT IN (SELECT s_suppkey FROM supplier)) = 0 AND (SELECT count(*) = count(DISTINCT s_suppkey) FROM supplier),
  's_name,s_acctbal' FROM (SELECT DISTINCT l_suppkey v FROM lineitem)"""


def dependency_edges(spark, sf):
    geo = customer_geo(spark, sf)
    tables = {"customer_geo": geo, "orders": load(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")}
    edges = dep.select_edges(dep.pair_statistics(geo, TEXT_GEO), k=1)
    return rounded(
        dep.dependency_edges(
            tables, {"customer_geo": "c_custkey", "orders": "o_orderkey"}, [("orders", "o_custkey", "customer_geo")],
            {"customer_geo": edges},
        )
    )


QUERIES["dependency_edges"] = dependency_edges
ORACLES["dependency_edges"] = (
    TEXT_STATS + EDGES_SQL.format(k=1, r=0.6) + """
SELECT 'customer_geo.' || lhs AS src, 'customer_geo.' || rhs AS dst, 'afd' AS edge_type, round(edge_weight, 6) AS weight, round(r_del, 6) AS r_del FROM edges
UNION ALL SELECT 'customer_geo.c_custkey', 'customer_geo.' || c, 'schema_fd', round(1.0, 6), NULL
  FROM (VALUES ('c_mktsegment'), ('n_name'), ('r_name'), ('n_regionkey')) v(c)
UNION ALL SELECT 'orders.o_orderkey', 'orders.' || c, 'schema_fd', round(1.0, 6), NULL FROM (VALUES ('o_custkey'), ('o_orderstatus')) v(c)
UNION ALL SELECT 'orders.o_custkey', 'customer_geo.c_custkey', 'fk_ind', round(1.0, 6), NULL
UNION ALL SELECT 'customer_geo.c_custkey', 'orders.o_custkey', 'inverse_fk', round(1.0, 6), NULL"""
)

PRINTED = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority"]
QUERIES["table_fingerprint"] = lambda spark, sf: dep.fingerprint(
    load(spark, sf, "orders").withColumn("o_totalprice", F.col("o_totalprice").cast("decimal(18,2)")), PRINTED
)
ORACLES["table_fingerprint"] = f"""
WITH h AS (SELECT ('0x' || substr(md5(concat_ws(chr(31), {', '.join(f"coalesce({'o_totalprice::DECIMAL(18,2)' if c == 'o_totalprice' else c}::VARCHAR, chr(8709))" for c in PRINTED)})), 1, 15))::BIGINT h FROM orders)
SELECT count(*) AS row_count, bit_xor(h) AS hash_xor, sum(h % 1000003)::BIGINT AS hash_sum FROM h"""


def ambiguity_features_dated(spark, sf):
    """Events as dated versions of their user: each event reads the version its user had before it."""
    e = load(spark, sf, "events").select("event_id", "user_id", "ts", "event_type", F.hour("ts").cast("string").alias("hour"))
    target = e.select("event_id", F.col("user_id").alias("who"), F.col("ts").alias("asked"))
    return rounded(
        dep.ambiguity_features(
            target, e, e, [("hour", "event_type")], row_key=["event_id"], target_key="who", entity_key="user_id", entity_order=["hour"],
            entity_time="ts", target_time="asked", cutoff="strict",
        )
    )


QUERIES["ambiguity_features_dated"] = ambiguity_features_dated
ORACLES["ambiguity_features_dated"] = """
WITH v AS (SELECT event_id, user_id, ts, event_type, hour(ts)::VARCHAR h FROM events),
cells AS (SELECT h, event_type, count(*) n FROM v GROUP BY ALL),
amb AS (SELECT h, max(n)::DOUBLE / sum(n) mc, greatest(ln(sum(n)) - sum(n * ln(n)) / sum(n), 0) en, count(*) cc, sum(n)::BIGINT sc FROM cells GROUP BY h),
seen AS (SELECT event_id, lag(h) OVER (PARTITION BY user_id ORDER BY ts) h FROM v)
SELECT event_id, round(mc, 6) AS f_amb__hour_to_event_type__majconf, round(en, 6) AS f_amb__hour_to_event_type__entropy,
  cc AS f_amb__hour_to_event_type__conflict_count, sc AS f_amb__hour_to_event_type__support_count,
  (mc IS NULL)::INT AS f_amb__hour_to_event_type__majconf__is_missing, (mc IS NULL)::INT AS f_amb__hour_to_event_type__entropy__is_missing,
  (mc IS NULL)::INT AS f_amb__hour_to_event_type__conflict_count__is_missing, (mc IS NULL)::INT AS f_amb__hour_to_event_type__support_count__is_missing
FROM seen LEFT JOIN amb USING (h)"""
