"""Temporal, history and path operators bound to the driver tables, with DuckDB oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import history, paths, temporal
from tidemark.operators.scan import BY_SIZE, ROWS_PER_TASK, deal_shuffles, measure_groups
from tidemark.plans.data import load, order_lines, orders_history, round_to, rounded
from tidemark.sources.tables import written_once

QUERIES = {}
ORACLES = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


@query(
    "pit_order_history",
    """
WITH daily AS (
  SELECT o_custkey k, o_orderdate t, count(*) n, sum(o_totalprice) s, max(o_totalprice) mx,
         sum((o_totalprice - 250000.0) * (o_totalprice - 250000.0)) q, sum(o_totalprice - 250000.0) d
  FROM orders WHERE o_totalprice IS NOT NULL GROUP BY 1, 2),
cum AS (
  SELECT k, t, sum(n) OVER w n, sum(s) OVER w s, max(mx) OVER w mx, sum(q) OVER w q, sum(d) OVER w d
  FROM daily WINDOW w AS (PARTITION BY k ORDER BY t ROWS UNBOUNDED PRECEDING)),
j AS (
  SELECT o_orderkey, o_orderdate, c.* FROM orders o
  ASOF LEFT JOIN cum c ON o.o_custkey = c.k AND o.o_orderdate > c.t),
f AS (
  SELECT o_orderkey, coalesce(n, 0)::BIGINT AS hist_count, round(s / n, 4) AS hist_mean,
    CASE WHEN n IS NULL THEN NULL ELSE round(sqrt(greatest(q / n - (d / n) * (d / n), 0)), 3) END AS hist_std,
    mx AS hist_max, date_diff('day', t, o_orderdate)::BIGINT AS hist_days_since_last
  FROM j)
SELECT *, 0 AS hist_count__is_missing, (hist_mean IS NULL)::INT AS hist_mean__is_missing,
  (hist_std IS NULL)::INT AS hist_std__is_missing, (hist_max IS NULL)::INT AS hist_max__is_missing,
  (hist_days_since_last IS NULL)::INT AS hist_days_since_last__is_missing
FROM f""",
)
def pit_order_history(spark, sf):
    o = orders_history(spark, sf)
    out = temporal.point_in_time_features(
        o, o, row_key=["o_orderkey"], keys=["o_custkey"], target_time="o_orderdate", child_keys=["o_custkey"],
        child_time="o_orderdate", value="o_totalprice", prefix="hist", cutoff="strict",
    )
    return out.withColumn("hist_mean", round_to("hist_mean", 4)).withColumn("hist_std", round_to("hist_std", 3))


PIT_EVENTS = """
WITH daily AS (
  SELECT user_id k, ts t, count(*) n, sum(value) s, max(value) mx
  FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL AND value IS NOT NULL GROUP BY 1, 2),
cum AS (
  SELECT k, t, sum(n) OVER w n, sum(s) OVER w s, max(mx) OVER w mx
  FROM daily WINDOW w AS (PARTITION BY k ORDER BY t ROWS UNBOUNDED PRECEDING)),
sd AS (
  SELECT event_id, user_id, ts,
    stddev_pop(value) OVER (PARTITION BY user_id ORDER BY ts RANGE UNBOUNDED PRECEDING) std FROM events)
SELECT e.event_id, coalesce(c.n, 0)::BIGINT AS ev_count, round(c.s / c.n, 6) AS ev_mean, round(sd.std, 6) AS ev_std,
  c.mx AS ev_max, date_diff('day', c.t, e.ts)::BIGINT AS ev_days_since_last,
  0 AS ev_count__is_missing, (c.n IS NULL)::INT AS ev_mean__is_missing, (sd.std IS NULL)::INT AS ev_std__is_missing,
  (c.mx IS NULL)::INT AS ev_max__is_missing, (c.t IS NULL)::INT AS ev_days_since_last__is_missing
FROM events e ASOF LEFT JOIN cum c ON e.user_id = c.k AND e.ts >= c.t
LEFT JOIN sd ON sd.event_id = e.event_id"""


def _pit_events(spark, sf, splits=None):
    e = load(spark, sf, "events").select("event_id", "user_id", "ts", "value")
    return rounded(
        temporal.point_in_time_features(
            e, e, row_key=["event_id"], keys=["user_id"], target_time="ts", child_keys=["user_id"],
            child_time="ts", value="value", prefix="ev", splits=splits,
        )
    )


QUERIES["pit_event_value"] = _pit_events
ORACLES["pit_event_value"] = PIT_EVENTS
QUERIES["pit_event_value_sliced"] = lambda spark, sf: _pit_events(spark, sf, splits=8)
ORACLES["pit_event_value_sliced"] = PIT_EVENTS


@query(
    "latest_value_events",
    """
WITH d AS (SELECT user_id k, ts t, avg(value) v FROM events WHERE value IS NOT NULL GROUP BY 1, 2)
SELECT event_id, d.v AS ev_latest, date_diff('day', d.t, e.ts)::BIGINT AS ev_days_since_latest
FROM events e ASOF LEFT JOIN d ON e.user_id = d.k AND e.ts > d.t""",
)
def latest_value_events(spark, sf):
    e = load(spark, sf, "events").select("event_id", "user_id", "ts", "value")
    return temporal.latest_value(
        e, e, row_key=["event_id"], keys=["user_id"], target_time="ts", child_keys=["user_id"],
        child_time="ts", value="value", prefix="ev", cutoff="strict",
    )


@query(
    "lookback_events_1_7d",
    """
WITH j AS (
  SELECT t.event_id, t.ts tt, c.event_id cid, c.ts ct, c.value v
  FROM events t LEFT JOIN events c ON c.user_id = t.user_id AND c.ts < t.ts),
a AS (
  SELECT event_id, count(v) n, avg(v) m, stddev_samp(v) sd, arg_max(v, ct) lv, max(ct) lt, max(tt) tt,
    count(v) FILTER (ct > tt - INTERVAL 1 DAY) n1, avg(v) FILTER (ct > tt - INTERVAL 1 DAY) m1,
    count(v) FILTER (ct > tt - INTERVAL 7 DAY) n7, avg(v) FILTER (ct > tt - INTERVAL 7 DAY) m7
  FROM j GROUP BY event_id)
SELECT event_id, n AS lb_all_past_count, round(m, 6) AS lb_all_past_mean, round(sd, 6) AS lb_all_past_std,
  round(lv, 6) AS lb_last_value, round((epoch_us(tt) - epoch_us(lt)) / 86400000000.0, 6) AS lb_time_since_last_days,
  n1 AS lb_recent_1d_count, round(m1, 6) AS lb_recent_1d_mean, round(m1 - m, 6) AS lb_trend_recent1_minus_all,
  n7 AS lb_recent_7d_count, round(m7, 6) AS lb_recent_7d_mean, round(m7 - m, 6) AS lb_trend_recent7_minus_all,
  round(lv - m, 6) AS lb_trend_last_minus_mean
FROM a""",
)
def lookback_events(spark, sf):
    e = load(spark, sf, "events").select("event_id", "user_id", "ts", "value")
    return rounded(
        temporal.lookback_features(
            e, e, row_key=["event_id"], keys=["user_id"], target_time="ts", child_keys=["user_id"], child_time="ts",
            value="value", prefix="lb", windows_days=(1, 7), cutoff="strict", tiebreak=["event_id"],
        )
    )


@query(
    "lookback_orders_30_90_365",
    """
WITH j AS (
  SELECT t.o_orderkey, t.o_orderdate tt, c.o_orderdate ct
  FROM orders t LEFT JOIN orders c ON c.o_custkey = t.o_custkey AND c.o_orderdate < t.o_orderdate)
SELECT o_orderkey, count(ct) AS ord_past_count,
  count(*) FILTER (ct > tt - INTERVAL 30 DAY) AS ord_count_30d,
  count(*) FILTER (ct > tt - INTERVAL 90 DAY) AS ord_count_90d,
  count(*) FILTER (ct > tt - INTERVAL 365 DAY) AS ord_count_365d,
  date_diff('day', max(ct), max(tt))::BIGINT AS ord_days_since_last
FROM j GROUP BY o_orderkey""",
)
def lookback_orders(spark, sf):
    o = orders_history(spark, sf)
    return temporal.lookback_counts(
        o, o, row_key=["o_orderkey"], keys=["o_custkey"], target_time="o_orderdate", child_keys=["o_custkey"],
        child_time="o_orderdate", prefix="ord",
    )


@query(
    "customer_cutoff_counts",
    """
WITH t AS (SELECT o_orderkey, o_custkey k, o_orderdate tt FROM orders),
h AS (
  SELECT o_custkey k, o_orderdate ct, l_partkey, l_suppkey, o_orderpriority
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey)
SELECT t.o_orderkey, count(DISTINCT l_partkey) AS part_distinct, count(DISTINCT l_suppkey) AS supp_distinct,
  count(DISTINCT o_orderpriority) AS prio_distinct,
  count(DISTINCT CASE WHEN ct >= tt - INTERVAL 30 DAY THEN l_suppkey END) AS supp_distinct_30d,
  count(DISTINCT CASE WHEN ct >= tt - INTERVAL 90 DAY THEN l_suppkey END) AS supp_distinct_90d,
  count(DISTINCT CASE WHEN ct >= tt - INTERVAL 365 DAY THEN l_suppkey END) AS supp_distinct_365d,
  date_diff('day', max(ct), max(tt))::BIGINT AS days_since_last
FROM t LEFT JOIN h ON h.k = t.k AND h.ct < t.tt GROUP BY t.o_orderkey""",
)
def customer_cutoff_counts(spark, sf):
    o = orders_history(spark, sf)
    return history.distinct_history(
        o, order_lines(spark, sf), row_key=["o_orderkey"], keys=["o_custkey"], target_time="o_orderdate",
        child_keys=["o_custkey"], child_time="o_orderdate",
        items={"part": "l_partkey", "supp": "l_suppkey", "prio": "o_orderpriority"}, window_item="supp",
    )


@query(
    "category_state_events",
    """
WITH j AS (
  SELECT t.event_id, c.event_type c, c.ts ct FROM events t JOIN events c ON c.user_id = t.user_id AND c.ts < t.ts
  WHERE c.event_type IS NOT NULL),
n AS (SELECT event_id, c, count(*) n FROM j GROUP BY 1, 2),
s AS (
  SELECT event_id, max(n)::DOUBLE / sum(n) mc, -sum((n / tot) * ln(n / tot)) en
  FROM (SELECT *, sum(n) OVER (PARTITION BY event_id)::DOUBLE tot FROM n) GROUP BY event_id),
l AS (SELECT event_id, arg_max(c, ct) lc FROM j GROUP BY event_id)
SELECT e.event_id, round(coalesce(mc, 0.0), 6) AS category_majority_confidence,
  round(coalesce(abs(en), 0.0), 6) AS category_entropy, lc AS category_latest
FROM events e LEFT JOIN s USING (event_id) LEFT JOIN l USING (event_id)""",
)
def category_state_events(spark, sf):
    e = load(spark, sf, "events").select("event_id", "user_id", "ts", "event_type")
    return rounded(
        history.category_state(
            e, e, row_key=["event_id"], keys=["user_id"], target_time="ts", child_keys=["user_id"], child_time="ts",
            category="event_type", tiebreak=["event_id"],
        )
    )


def _splits_of_lines(spark, sf):
    """One split if no customer can have more lines than a task holds; both tables are counted, never joined for it."""
    orders, lines = load(spark, sf, "orders"), load(spark, sf, "lineitem")
    deal_shuffles(spark, 2 * (orders.count() + lines.count()))  # before the first shuffle, which would grow with the tables
    some = lines.select(F.pmod(F.xxhash64("l_orderkey"), F.lit(65_536)).alias("orders"))  # few groups to count; each bounds its orders
    _, most = measure_groups((orders, ["o_custkey"], "customer"), (some, ["orders"], "order"))
    return 1 if most["customer"] * (1 + most["order"]) <= ROWS_PER_TASK else BY_SIZE


@query(
    "category_state_brands",
    """
WITH u AS (
  SELECT DISTINCT o_custkey k, o_orderkey ord, o_orderdate ct, p_brand b
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey),
j AS (SELECT t.o_orderkey, u.* FROM orders t JOIN u ON u.k = t.o_custkey AND u.ct < t.o_orderdate),
n AS (SELECT o_orderkey, b, count(DISTINCT ord) n FROM j GROUP BY 1, 2),
s AS (
  SELECT o_orderkey, max(n)::DOUBLE / sum(n) mc, -sum((n / tot) * ln(n / tot)) en
  FROM (SELECT *, sum(n) OVER (PARTITION BY o_orderkey)::DOUBLE tot FROM n) GROUP BY 1),
l AS (SELECT o_orderkey, b FROM j QUALIFY row_number() OVER (PARTITION BY o_orderkey ORDER BY ct DESC, ord DESC, b DESC) = 1)
SELECT o.o_orderkey, round(coalesce(mc, 0.0), 6) AS brand_majority_confidence,
  round(coalesce(abs(en), 0.0), 6) AS brand_entropy, l.b AS brand_latest
FROM orders o LEFT JOIN s USING (o_orderkey) LEFT JOIN l USING (o_orderkey)""",
)
def category_state_brands(spark, sf):
    o = orders_history(spark, sf)
    lines = order_lines(spark, sf).select("o_custkey", "o_orderkey", "o_orderdate", "l_partkey")
    parts = load(spark, sf, "part").select("p_partkey", "p_brand")
    child = lines.join(parts, lines.l_partkey == parts.p_partkey)
    return rounded(
        history.category_state(
            o, child, row_key=["o_orderkey"], keys=["o_custkey"], target_time="o_orderdate", child_keys=["o_custkey"],
            child_time="o_orderdate", category="p_brand", item="o_orderkey", tiebreak=["o_orderkey"], prefix="brand",
            splits=_splits_of_lines(spark, sf),
        )
    )


COOC = """
WITH lk AS (SELECT DISTINCT l_partkey p, l_orderkey g, o_orderdate d FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
t AS (SELECT p_partkey, TIMESTAMP '1998-06-01' + to_days((p_partkey % 900)::INT) cut FROM part),
h AS (SELECT t.p_partkey, t.cut, lk.g FROM t JOIN lk ON lk.p = t.p_partkey AND lk.d < t.cut),
co AS (SELECT h.p_partkey, h.g, b.p other FROM h JOIN lk b ON b.g = h.g AND b.d < h.cut),
sz AS (SELECT p_partkey, g, count(DISTINCT other) n FROM co GROUP BY 1, 2),
st AS (SELECT co.p_partkey, count(DISTINCT other) partners, avg(n) m, max(n) mx
       FROM co JOIN sz ON sz.p_partkey = co.p_partkey AND sz.g = co.g GROUP BY 1)
SELECT t.p_partkey, coalesce(partners, 0) AS partners, round(coalesce(m, 0.0), 6) AS mean_group_size,
  coalesce(mx, 0) AS max_group_size FROM t LEFT JOIN st USING (p_partkey)"""


def _cooccurrence(spark, sf, hot_pairs):
    cut = F.expr("timestamp_ntz'1998-06-01 00:00:00' + make_dt_interval(cast(p_partkey % 900 as int))")
    target = load(spark, sf, "part").select("p_partkey", cut.alias("cut"))
    links = order_lines(spark, sf).select("l_partkey", "l_orderkey", "o_orderdate")
    return rounded(
        history.co_occurrence(
            target, links, row_key=["p_partkey"], key="p_partkey", target_time="cut", member="l_partkey",
            group="l_orderkey", time="o_orderdate", hot_pairs=hot_pairs,
        )
    )


def _shipped_together(spark, sf, hot_pairs):
    """Parts of one order, each from its own shipping time."""
    cut = F.expr("timestamp_ntz'1998-06-01 00:00:00' + make_dt_interval(cast(p_partkey % 900 as int))")
    target = load(spark, sf, "part").select("p_partkey", cut.alias("cut"))
    return rounded(
        history.co_occurrence(
            target, load(spark, sf, "lineitem").select("l_partkey", "l_orderkey", "l_shipdate"), row_key=["p_partkey"], key="p_partkey",
            target_time="cut", member="l_partkey", group="l_orderkey", time="l_shipdate", hot_pairs=hot_pairs,
        )
    )


SHIPPED = COOC.replace("SELECT DISTINCT l_partkey p, l_orderkey g, o_orderdate d FROM lineitem JOIN orders ON l_orderkey = o_orderkey", "SELECT l_partkey p, l_orderkey g, min(l_shipdate) d FROM lineitem GROUP BY 1, 2")
QUERIES["part_shipped_together"] = lambda spark, sf: _shipped_together(spark, sf, 250_000)
ORACLES["part_shipped_together"] = SHIPPED
QUERIES["part_shipped_together_hot_groups"] = lambda spark, sf: _shipped_together(spark, sf, 12)
ORACLES["part_shipped_together_hot_groups"] = SHIPPED
QUERIES["part_cooccurrence"] = lambda spark, sf: _cooccurrence(spark, sf, 250_000)
ORACLES["part_cooccurrence"] = COOC
QUERIES["part_cooccurrence_hot_groups"] = lambda spark, sf: _cooccurrence(spark, sf, 30)
ORACLES["part_cooccurrence_hot_groups"] = COOC


@query(
    "link_counts_order_supplier",
    """
WITH j AS (
  SELECT o.o_orderkey, o.o_orderdate tt, l.l_suppkey s, l.l_shipdate ct, l.l_returnflag f
  FROM orders o LEFT JOIN lineitem l ON l.l_orderkey = o.o_orderkey AND l.l_shipdate <= o.o_orderdate)
SELECT o_orderkey, count(DISTINCT s) AS link_count,
  round(greatest(coalesce((epoch_us(max(tt)) - epoch_us(max(ct))) / 86400000000.0, 0), 0), 6) AS link_days_since_last,
  (max(ct) IS NULL)::INT AS link_days_since_last__is_missing, count(DISTINCT f) AS link_l_returnflag_nunique
FROM j GROUP BY o_orderkey""",
)
def link_counts_order_supplier(spark, sf):
    return rounded(
        paths.link_counts(
            orders_history(spark, sf), load(spark, sf, "lineitem"), row_key=["o_orderkey"], keys=["o_orderkey"],
            target_time="o_orderdate", link_keys=["l_orderkey"], link_time="l_shipdate", second_key="l_suppkey",
            attributes=["l_returnflag"],
        )
    )


@query(
    "two_hop_customer_part",
    """
WITH b AS (SELECT o_custkey k, o_orderdate ct, l_partkey p FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
j AS (
  SELECT t.o_orderkey, b.p, part.* FROM orders t
  LEFT JOIN b ON b.k = t.o_custkey AND (b.ct IS NULL OR t.o_orderdate IS NULL OR b.ct <= t.o_orderdate)
  LEFT JOIN part ON part.p_partkey = b.p)
SELECT o_orderkey, count(DISTINCT p) AS hop2_count_distinct,
  round(coalesce(avg(p_retailprice), 0), 4) AS hop2_p_retailprice_mean,
  round(coalesce(stddev_samp(p_retailprice), 0), 4) AS hop2_p_retailprice_std,
  coalesce(min(p_retailprice), 0) AS hop2_p_retailprice_min, coalesce(max(p_retailprice), 0) AS hop2_p_retailprice_max,
  round(coalesce(avg(p_size), 0), 4) AS hop2_p_size_mean, round(coalesce(stddev_samp(p_size), 0), 4) AS hop2_p_size_std,
  coalesce(min(p_size), 0)::DOUBLE AS hop2_p_size_min, coalesce(max(p_size), 0)::DOUBLE AS hop2_p_size_max,
  count(DISTINCT p_brand) AS hop2_p_brand_nunique
FROM j GROUP BY o_orderkey""",
)
def two_hop_customer_part(spark, sf):
    bridge = order_lines(spark, sf).select("o_custkey", "o_orderdate", "l_partkey")
    return rounded(
        paths.two_hop_features(
            orders_history(spark, sf), bridge, load(spark, sf, "part"), row_key=["o_orderkey"], key="o_custkey",
            target_time="o_orderdate", bridge_key="o_custkey", bridge_time="o_orderdate", second_key="l_partkey",
            second_pk="p_partkey", numeric=["p_retailprice", "p_size"], categorical=["p_brand"],
        ),
        4,
    )


@query(
    "pivot_history_part_customer",
    """
WITH l AS (SELECT o_custkey c, o_orderdate ct, l_partkey p, l_quantity q FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
t AS (SELECT p_partkey, TIMESTAMP '1998-06-01' + to_days((p_partkey % 7 * 100)::INT) cut FROM part),
pv AS (SELECT DISTINCT t.p_partkey, t.cut, l.c FROM t JOIN l ON l.p = t.p_partkey AND l.ct < t.cut),
s AS (SELECT pv.p_partkey, pv.cut, pv.c, l.q, l.ct FROM pv LEFT JOIN l ON l.c = pv.c AND l.ct < pv.cut),
a AS (
  SELECT p_partkey, count(DISTINCT c) pn, count(q) n, avg(q) m, stddev_samp(q) sd, max(q) mx, count(DISTINCT q) nq,
    max(ct) last, max(cut) cut FROM s GROUP BY 1)
SELECT p_partkey, coalesce(pn, 0) AS pivot_pivot_nunique, coalesce(n, 0) AS pivot_count, round(m, 6) AS pivot_mean,
  round(CASE WHEN last IS NOT NULL THEN coalesce(sd, 0) END, 6) AS pivot_std, mx AS pivot_max, coalesce(nq, 0) AS pivot_nunique,
  round((epoch_us(cut) - epoch_us(last)) / 86400000000.0, 6) AS pivot_days_since_last
FROM part LEFT JOIN a USING (p_partkey)""",
)
def pivot_history_part_customer(spark, sf):
    cut = F.expr("timestamp_ntz'1998-06-01 00:00:00' + make_dt_interval(cast(p_partkey % 7 * 100 as int))")
    target = load(spark, sf, "part").select("p_partkey", cut.alias("cut"))
    lines = written_once(order_lines(spark, sf).select("o_custkey", "o_orderdate", "l_partkey", "l_quantity"), "lines")
    return rounded(
        paths.pivot_history(
            target, lines, lines, row_key=["p_partkey"], key="p_partkey", target_time="cut", base_key="l_partkey",
            base_time="o_orderdate", pivot="o_custkey", second_key="o_custkey", second_time="o_orderdate", value="l_quantity",
        )
    )


@query(
    "incoming_links_customer",
    """
WITH own AS (SELECT DISTINCT o_custkey k, l_partkey p, min(o_orderdate) f
             FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2),
refs AS (SELECT l_partkey p, o_custkey src, l_shipdate d FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
t AS (SELECT c_custkey, TIMESTAMP '1998-01-01' + to_days((c_custkey % 5 * 200)::INT) cut FROM customer),
j AS (SELECT t.c_custkey, t.cut, r.src, r.d FROM t JOIN own ON own.k = t.c_custkey AND own.f < t.cut
      LEFT JOIN refs r ON r.p = own.p AND r.d < t.cut),
a AS (SELECT c_custkey, count(d) n, count(DISTINCT src) s, count(*) FILTER (d >= cut - INTERVAL 365 DAY) w FROM j GROUP BY 1)
SELECT c_custkey, coalesce(n, 0) AS incoming_count, coalesce(s, 0) AS incoming_sources, coalesce(w, 0) AS incoming_count_365d
FROM customer LEFT JOIN a USING (c_custkey)""",
)
def incoming_links_customer(spark, sf):
    cut = F.expr("timestamp_ntz'1998-01-01 00:00:00' + make_dt_interval(cast(c_custkey % 5 * 200 as int))")
    target = load(spark, sf, "customer").select("c_custkey", cut.alias("cut"))
    lines = written_once(order_lines(spark, sf).select("o_custkey", "o_orderdate", "l_partkey", "l_shipdate"), "lines")
    return paths.incoming_link_counts(
        target, lines, lines, row_key=["c_custkey"], key="c_custkey", target_time="cut", own_key="o_custkey",
        own_item="l_partkey", own_time="o_orderdate", incoming_item="l_partkey", incoming_source="o_custkey",
        incoming_time="l_shipdate",
    )
