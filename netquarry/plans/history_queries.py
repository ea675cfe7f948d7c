"""Snapshot differences and change matrices over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from netquarry.operators import history as H
from netquarry.plans import bindings as B
from netquarry.plans.registry import query

CHANGES = f"WITH {B.CHANGES_SQL}"
COLS = ["click", "error", "purchase", "signup", "view"]
PERIODS_SQL = "periods AS (SELECT DISTINCT strftime(ts, '%Y-%m-%d %H') AS period FROM events)"
MATRIX_SQL = f"{CHANGES}, {PERIODS_SQL}, cols AS (SELECT DISTINCT col FROM changes), matrix AS (SELECT p.period AS period, c.col AS col, (x.col IS NOT NULL)::INT AS changed FROM periods p CROSS JOIN cols c LEFT JOIN changes x ON x.period = p.period AND x.col = c.col)"
DIFF_SQL = f"""WITH {B.SNAPSHOTS_SQL}, b AS (SELECT * FROM state WHERE early), a AS (SELECT * FROM state WHERE NOT early),
j AS (SELECT coalesce(a.device, b.device) AS device, coalesce(a.stanza, b.stanza) AS stanza, coalesce(a.element, b.element) AS element, coalesce(a.attr, b.attr) AS attr, b.val AS old, a.val AS new, b.device IS NOT NULL AS was, a.device IS NOT NULL AS now
  FROM b FULL JOIN a ON a.device = b.device AND a.stanza = b.stanza AND a.element = b.element AND a.attr = b.attr),
w AS (SELECT *, bool_or(was) OVER (PARTITION BY device, stanza, element) AS had, bool_or(now) OVER (PARTITION BY device, stanza, element) AS has, bool_or(now) OVER (PARTITION BY device, stanza) AS stays FROM j),
diffs AS (SELECT DISTINCT device, stanza, element, CASE WHEN NOT was THEN 'Addition' WHEN NOT now THEN 'Deletion' ELSE 'Modification' END AS change,
  CASE WHEN had AND has THEN attr END AS attr, CASE WHEN had AND has THEN old END AS old, CASE WHEN had AND has THEN new END AS new FROM w WHERE stays AND (NOT was OR NOT now OR old IS DISTINCT FROM new))"""


def periods(spark, d):
    return B.table(spark, d, "events").select(F.date_format("ts", "yyyy-MM-dd HH").alias("period")).distinct()


@query("g20_snapshot_diff", f"{DIFF_SQL} SELECT * FROM diffs")
def g20(spark, d):
    return H.snapshot_diff(*B.snapshots(spark, d))


@query(
    "g21_diff_kinds",
    f"""WITH {B.SNAPSHOTS_SQL}, s AS (SELECT device, stanza, early, count(*) AS n, string_agg(attr || val, '|' ORDER BY attr) AS x FROM state GROUP BY ALL),
k AS (SELECT coalesce(a.device, b.device) AS device, coalesce(a.stanza, b.stanza) AS stanza, CASE WHEN b.n IS NULL THEN 'Newly Added' WHEN a.n IS NULL THEN 'Deleted' WHEN a.n > b.n THEN 'Addition' WHEN a.n < b.n THEN 'Deletion' WHEN a.x <> b.x THEN 'Modification' END AS kind
  FROM (SELECT * FROM s WHERE early) b FULL JOIN (SELECT * FROM s WHERE NOT early) a ON a.device = b.device AND a.stanza = b.stanza)
SELECT * FROM k WHERE kind IS NOT NULL""",
)
def g21(spark, d):
    return H.diff_kinds(*B.snapshots(spark, d))


SERIES_SQL = """day AS (SELECT ts::DATE AS date, user_id AS device, event_type AS stanza, 'last' AS element, 'value' AS attr, (round(arg_max(value, event_id))::BIGINT // 10)::VARCHAR AS val FROM events GROUP BY ALL),
dates AS (SELECT date, lead(date) OVER (ORDER BY date) AS next FROM (SELECT DISTINCT date FROM day)),
b AS (SELECT next, device, stanza, val FROM day JOIN dates USING (date) WHERE next IS NOT NULL),
a AS (SELECT date AS next, device, stanza, val FROM day WHERE date IN (SELECT next FROM dates)),
j AS (SELECT coalesce(a.next, b.next) AS next, coalesce(a.device, b.device) AS device, coalesce(a.stanza, b.stanza) AS stanza, b.val AS old, a.val AS new, b.device IS NOT NULL AS was, a.device IS NOT NULL AS now
  FROM b FULL JOIN a ON a.next = b.next AND a.device = b.device AND a.stanza = b.stanza)"""


def series(spark, d):
    e = B.table(spark, d, "events")
    last = e.groupBy(F.to_date("ts").alias("date"), F.col("user_id").alias("device"), F.col("event_type").alias("stanza")).agg(F.max_by("value", "event_id").alias("v"))
    return last.select("date", "device", "stanza", F.lit("last").alias("element"), F.lit("value").alias("attr"), F.expr("cast(cast(round(v) as bigint) div 10 as string)").alias("val"))


@query("p01_diff_series", f"WITH {SERIES_SQL} SELECT next, device, stanza, CASE WHEN NOT was THEN 'Addition' ELSE 'Modification' END AS change, CASE WHEN was THEN old END AS old, CASE WHEN was THEN new END AS new FROM j WHERE now AND (NOT was OR old <> new)")
def p01(spark, d):
    return H.diff_series(series(spark, d)).select("next", "device", "stanza", "change", "old", "new")


@query("a22_change_matrix", f"{MATRIX_SQL} SELECT * FROM matrix")
def a22(spark, d):
    return H.change_matrix(B.changes(spark, d), periods(spark, d))


@query("a22_wide_matrix", f"{MATRIX_SQL} SELECT period, " + ", ".join(f"max(CASE WHEN col = '{c}' THEN changed END) AS {c}" for c in COLS) + " FROM matrix GROUP BY period")
def a22_wide(spark, d):
    return H.wide_matrix(B.changes(spark, d), periods(spark, d), COLS)


@query("a22_attribute_matrix", f"{DIFF_SQL} SELECT DISTINCT 'p' || (device % 7) AS period, CASE WHEN attr IS NULL THEN stanza ELSE stanza || ':' || attr END AS col FROM diffs")
def a22_attribute(spark, d):
    diffs = H.snapshot_diff(*B.snapshots(spark, d)).withColumn("period", F.concat(F.lit("p"), F.col("device") % 7))
    return H.change_columns(diffs, "attribute")


@query("a22_device_matrix", f"{DIFF_SQL} SELECT DISTINCT change AS period, device::VARCHAR AS col FROM diffs")
def a22_device(spark, d):
    return H.change_columns(H.snapshot_diff(*B.snapshots(spark, d)).withColumn("period", F.col("change")), "device")


@query("a23_change_frequency", f"{CHANGES} SELECT col, count(*) AS periods FROM changes GROUP BY col")
def a23(spark, d):
    return H.change_frequency(B.changes(spark, d))


PAIRS_SQL = f"{MATRIX_SQL}, p AS (SELECT x.col AS a, y.col AS b, x.changed AS u, y.changed AS v FROM matrix x JOIN matrix y ON x.period = y.period)"


@query("a24_co_changes", f"{PAIRS_SQL} SELECT a, b, count(*) FILTER (u = 1 AND v = 1) AS together, count(*) FILTER (u <> v) AS apart FROM p WHERE a <= b GROUP BY ALL")
def a24(spark, d):
    return H.co_changes(B.changes(spark, d))


@query("a26_point_frequencies", f"{PAIRS_SQL} SELECT a, b, count(*) FILTER (u = 0 AND v = 0) AS n00, count(*) FILTER (u = 0 AND v = 1) AS n01, count(*) FILTER (u = 1 AND v = 1) AS n11, count(*) FILTER (u = 1 AND v = 0) AS n10 FROM p WHERE a < b GROUP BY ALL")
def a26(spark, d):
    return H.point_frequencies(B.changes(spark, d), periods(spark, d))


@query(
    "a25_rank_correlation",
    """WITH v AS (SELECT strftime(ts, '%Y-%m-%d') AS r, event_type AS c, count(*) AS n FROM events GROUP BY ALL),
k AS (SELECT r, c, rank() OVER (PARTITION BY c ORDER BY n) + (count(*) OVER (PARTITION BY c, n) - 1) / 2.0 AS k FROM v)
SELECT x.c AS a, y.c AS b, round(corr(x.k, y.k), 6) AS rho FROM k x JOIN k y ON x.r = y.r AND x.c < y.c GROUP BY ALL""",
)
def a25(spark, d):
    v = B.table(spark, d, "events").groupBy(F.date_format("ts", "yyyy-MM-dd").alias("r"), F.col("event_type").alias("c")).agg(F.count("*").alias("n"))
    return H.rank_correlation(v, "r", "c", "n").withColumn("rho", F.round("rho", 6))


@query("s22_regressions", f"{PAIRS_SQL} SELECT a, b, round(regr_slope(u, v), 6) AS slope, round(regr_intercept(u, v), 6) AS intercept, round(regr_r2(u, v), 6) AS r2, sum(u * v)::BIGINT AS together FROM p WHERE a <> b GROUP BY ALL")
def s22(spark, d):
    r = H.regressions(H.change_matrix(B.changes(spark, d), periods(spark, d)))
    return r.select("a", "b", *[F.round(c, 6).alias(c) for c in ("slope", "intercept", "r2")], "together")


@query(
    "a27_lifetimes",
    """WITH f AS (SELECT DISTINCT user_id || event_type AS thing, least(3, (day(ts) - 1) // 8) AS p FROM events),
v AS (SELECT thing, bool_or(p = 0) AS a, bool_or(p = 1) AS b, bool_or(p = 2) AS c, bool_or(p = 3) AS d FROM f GROUP BY thing)
SELECT CASE WHEN a AND NOT b AND NOT c AND NOT d THEN 'fixed 1' WHEN a AND b AND NOT c AND NOT d THEN 'fixed 2' WHEN a AND b AND c AND NOT d THEN 'fixed 3' WHEN a AND b AND c AND d THEN 'not fixed' ELSE 'other' END AS class, count(*) AS n FROM v GROUP BY 1""",
)
def a27(spark, d):
    found = B.table(spark, d, "events").select(F.concat("user_id", "event_type").alias("thing"), F.least(F.lit(3), F.expr("(day(ts) - 1) div 8")).alias("period"))
    return H.lifetimes(found, [0, 1, 2, 3])


@query("s21_parse_matrix", "SELECT 'T' || (dense_rank() OVER (PARTITION BY c_nationkey ORDER BY c_custkey)) AS row, k AS col, CASE k WHEN 0 THEN c_custkey WHEN 1 THEN c_nationkey ELSE length(c_mktsegment) END::BIGINT AS value, c_nationkey::BIGINT AS matrix FROM customer, (SELECT unnest([0, 1, 2])::BIGINT AS k)")
def s21(spark, d):
    """The customers of each nation, a row each, written as text of a matrix and parsed back."""
    c = B.table(spark, d, "customer").select(F.col("c_nationkey").cast("long").alias("matrix"), "c_custkey", F.array(F.col("c_custkey").cast("int"), F.col("c_nationkey").cast("int"), F.length("c_mktsegment")).alias("xs"))
    text = c.groupBy("matrix").agg(F.to_json(F.transform(F.array_sort(F.collect_list(F.struct("c_custkey", "xs"))), lambda x: x["xs"])).alias("text"))
    return H.parse_matrix(text, "matrix").select("matrix", "row", F.col("col").cast("long").alias("col"), F.col("value").cast("long").alias("value"))


@query("k17_unordered_pairs", "SELECT DISTINCT least(l_returnflag, l_linestatus) AS a, greatest(l_returnflag, l_linestatus) AS b FROM lineitem")
def k17(spark, d):
    line = B.table(spark, d, "lineitem")
    return H.unordered_pairs(line.select(F.col("l_returnflag").alias("a"), F.col("l_linestatus").alias("b")).union(line.select("l_linestatus", "l_returnflag")))


def state_documents(state):
    """A JSON document for each device: stanza / element / attr."""
    element = state.groupBy("device", "stanza", "element").agg(F.map_from_entries(F.collect_list(F.struct("attr", "val"))).alias("attrs"))
    stanza = element.groupBy("device", "stanza").agg(F.map_from_entries(F.collect_list(F.struct("element", "attrs"))).alias("elements"))
    whole = stanza.groupBy("device").agg(F.map_from_entries(F.collect_list(F.struct("stanza", "elements"))).alias("stanzas"))
    return whole.select(F.col("device").cast("string").alias("doc"), F.to_json("stanzas").alias("json"))


@query("k13_diff_documents", f"{DIFF_SQL} SELECT device::VARCHAR AS device, stanza, element, change, attr, old, new FROM diffs")
def k13(spark, d):
    from netquarry.operators.infer import flatten_json

    before, after = (H.snapshot_of(flatten_json(state_documents(s))) for s in B.snapshots(spark, d))
    return H.snapshot_diff(before, after)
