"""Contrast sets over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from netquarry.operators import contrast as C
from netquarry.plans import bindings as B
from netquarry.plans.registry import query

FEATURES = ["priority", "kind", "flag", "status", "p_size"]
BIN_SQL = """sized AS (SELECT p_size, ntile(3) OVER (ORDER BY p_size) AS t FROM (SELECT DISTINCT p_size FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem))),
bins AS (SELECT p_size, '(' || min(p_size) OVER (PARTITION BY t) || ', ' || max(p_size) OVER (PARTITION BY t) || ')' AS label FROM sized)"""
FRAME_SQL = f"WITH {B.FRAME_SQL}, {BIN_SQL}, binned AS (SELECT grp, priority, kind, flag, status, label AS p_size FROM frame JOIN bins USING (p_size))"
ITEMS = {f: f"'{f}=>' || {f}" for f in FEATURES}
LEARN_PARTS = [f"SELECT {ITEMS[f]} AS rule, grp, count(*) AS a, 1 AS size FROM binned GROUP BY ALL" for f in FEATURES]
LEARN_PARTS += [f"SELECT {ITEMS[f]} || '|' || {ITEMS[g]}, grp, count(*), 2 FROM binned GROUP BY ALL" for i, f in enumerate(FEATURES) for g in FEATURES[i + 1 :]]
LEARN_SQL = f"{FRAME_SQL}, learned AS ({' UNION ALL '.join(LEARN_PARTS)})"


def _not_sql() -> str:
    parts = []
    for f in FEATURES:
        parts.append(f"SELECT rule, grp, sum(CASE WHEN {f} <> v THEN n ELSE 0 END)::BIGINT AS c FROM (SELECT DISTINCT {ITEMS[f]} AS rule, {f} AS v FROM counted) r, counted GROUP BY rule, grp")
    for i, f in enumerate(FEATURES):
        for g in FEATURES[i + 1 :]:
            parts.append(f"SELECT rule, grp, sum(CASE WHEN {f} <> v AND {g} <> w THEN n ELSE 0 END)::BIGINT FROM (SELECT DISTINCT {ITEMS[f]} || '|' || {ITEMS[g]} AS rule, {f} AS v, {g} AS w FROM counted) r, counted GROUP BY rule, grp")
    return f"counted AS (SELECT grp, {', '.join(FEATURES)}, count(*) AS n FROM binned GROUP BY ALL), nots AS ({' UNION ALL '.join(parts)})"


SCORE_SQL = f"""{LEARN_SQL}, {_not_sql()},
four AS (SELECT n.rule AS rule, n.grp AS grp, coalesce(l.a, 0) AS a, n.c AS c FROM nots n LEFT JOIN learned l ON n.rule = l.rule AND n.grp = l.grp),
tabled AS (SELECT *, sum(a) OVER (PARTITION BY rule) - a AS b, sum(c) OVER (PARTITION BY rule) - c AS d FROM four),
scored AS (SELECT rule, grp, a / (a + b + c + d) AS support, a * (a + b + c + d) / ((a + b) * (a + c)) AS lift, greatest(a / (a + b), a / (a + c)) AS confidence, a / (a + b) AS precision, a / (a + c) AS recall, a::BIGINT AS frequency
  FROM tabled WHERE abs(a - b) > 2 AND a > 10),
passed AS (SELECT * FROM scored WHERE support > 0.001 AND lift > 0.9 AND confidence > 0.3)"""


def _depth_sql(depth: int) -> str:
    """learned and nots of rules of up to so many items, counted row by row."""
    from itertools import combinations

    learned, nots = [], []
    for n in range(1, depth + 1):
        for c in combinations(FEATURES, n):
            rule = " || '|' || ".join(ITEMS[f] for f in c)
            learned.append(f"SELECT {rule} AS rule, grp, sum(n)::BIGINT AS a FROM counted GROUP BY ALL")
            apart = " AND ".join(f"{f} <> v{f}" for f in c)
            values = ", ".join(f"{f} AS v{f}" for f in c)
            nots.append(f"SELECT rule, grp, sum(CASE WHEN {apart} THEN n ELSE 0 END)::BIGINT AS c FROM (SELECT DISTINCT {rule} AS rule, {values} FROM counted) r, counted GROUP BY rule, grp")
    return f"{FRAME_SQL}, counted AS (SELECT grp, {', '.join(FEATURES)}, count(*) AS n FROM binned GROUP BY ALL), learned AS ({' UNION ALL '.join(learned)}), nots AS ({' UNION ALL '.join(nots)})"


def counts(spark, d):
    return C.item_counts(C.discretize(B.frame(spark, d), "p_size"), FEATURES, "grp")


def scored(spark, d):
    c = counts(spark, d)
    learned = C.learn(c, FEATURES, 2)
    return C.score(learned, C.not_rules(learned, c), 0.001, 10, 2, 0.9, 0.3)


def _text(df):
    return df.withColumn("rule", F.array_join("rule", "|"))


@query("a09_discretize", f"{FRAME_SQL} SELECT grp, priority, kind, flag, status, p_size, count(*) AS count FROM binned GROUP BY ALL")
def a09(spark, d):
    return counts(spark, d)


@query("a10_learn", f"{LEARN_SQL} SELECT rule, grp, a FROM learned")
def a10(spark, d):
    return _text(C.learn(counts(spark, d), FEATURES, 2))


@query("a11_not_rules", f"{LEARN_SQL}, {_not_sql()} SELECT rule, grp, c FROM nots")
def a11(spark, d):
    c = counts(spark, d)
    return _text(C.not_rules(C.learn(c, FEATURES, 2), c))


@query("a11_not_rules_of_three_items", f"{_depth_sql(3)} SELECT rule, grp, c FROM nots")
def a11_three(spark, d):
    c = counts(spark, d)
    return _text(C.not_rules(C.learn(c, FEATURES, 3), c))


@query(
    "a12_score_of_three_items",
    f"""{_depth_sql(3)}, four AS (SELECT n.rule AS rule, n.grp AS grp, coalesce(l.a, 0) AS a, n.c AS c FROM nots n LEFT JOIN learned l ON n.rule = l.rule AND n.grp = l.grp),
tabled AS (SELECT *, sum(a) OVER (PARTITION BY rule) - a AS b, sum(c) OVER (PARTITION BY rule) - c AS d FROM four)
SELECT rule, grp, a::BIGINT AS frequency, round(a / (a + b), 9) AS precision, round(a / (a + c), 9) AS recall FROM tabled
WHERE abs(a - b) > 2 AND a > 10 AND a / (a + b + c + d) > 0.001 AND a * (a + b + c + d) / ((a + b) * (a + c)) > 0.9 AND greatest(a / (a + b), a / (a + c)) > 0.3""",
)
def a12_three(spark, d):
    c = counts(spark, d)
    learned = C.learn(c, FEATURES, 3)
    s = _text(C.score(learned, C.not_rules(learned, c), 0.001, 10, 2, 0.9, 0.3))
    return s.select("rule", "grp", "frequency", *[F.round(x, 9).alias(x) for x in ("precision", "recall")])


@query("a12_score", f"{SCORE_SQL} SELECT rule, grp, round(support, 9) AS support, round(lift, 9) AS lift, round(confidence, 9) AS confidence, round(precision, 9) AS precision, round(recall, 9) AS recall, frequency FROM passed")
def a12(spark, d):
    s = _text(scored(spark, d))
    return s.select("rule", "grp", *[F.round(c, 9).alias(c) for c in ("support", "lift", "confidence", "precision", "recall")], "frequency")


@query("a14_chosen_rules", f"{SCORE_SQL} SELECT rule, grp, frequency FROM passed WHERE precision > 0.335 AND grp = 'F'")
def a14(spark, d):
    return _text(C.chosen_rules(scored(spark, d), 0.335, "F")).select("rule", "grp", "frequency")


@query("o04_top_rules", f"{SCORE_SQL} SELECT rule, grp, frequency FROM passed ORDER BY precision DESC, frequency DESC, rule, grp LIMIT 9")
def o04(spark, d):
    return _text(C.top_rules(scored(spark, d))).select("rule", "grp", "frequency")


@query("a32_threshold_collector", f"{SCORE_SQL} SELECT grp, count(*) AS rules, min(frequency) AS least FROM passed WHERE precision >= 0.33 GROUP BY grp")
def a32(spark, d):
    return scored(spark, d).where("precision >= 0.33").groupBy("grp").agg(F.count("*").alias("rules"), F.min("frequency").alias("least"))


RULE_FRAME_SQL = """f AS (SELECT o_orderkey AS row_id, o_orderstatus AS grp, substr(o_orderpriority, 1, 1) AS priority, c_mktsegment AS segment, c_nationkey::VARCHAR AS nation FROM orders JOIN customer ON o_custkey = c_custkey),
rules AS (SELECT row_number() OVER (ORDER BY segment, priority) AS rule_id, segment, priority, grp FROM (SELECT segment, priority, max(grp) AS grp FROM f GROUP BY ALL)),
matched AS (SELECT rule_id, row_id, rules.grp AS grp, f.grp AS row_group FROM rules JOIN f USING (segment, priority))"""
ROW_FEATURES = ["segment", "priority", "nation"]


def rule_frame(spark, d):
    o, c = B.table(spark, d, "orders"), B.table(spark, d, "customer")
    return o.join(c, o["o_custkey"] == c["c_custkey"]).select(F.col("o_orderkey").alias("row_id"), F.col("o_orderstatus").alias("grp"), F.substring("o_orderpriority", 1, 1).alias("priority"), F.col("c_mktsegment").alias("segment"), F.col("c_nationkey").cast("string").alias("nation"))


def rule_classes(frame):
    """Rows of the frame with the same items and group as one, numbered and counted."""
    return C.classes(frame, ROW_FEATURES, "grp")


def fixed_rules(frame):
    from pyspark.sql import Window

    base = frame.groupBy("segment", "priority").agg(F.max("grp").alias("grp"))
    ids = F.row_number().over(Window.orderBy("segment", "priority")).cast("long")
    return base.select(ids.alias("rule_id"), F.array(C.item("segment"), C.item("priority")).alias("rule"), "grp")


@query("a13_coverage", f"WITH {RULE_FRAME_SQL} SELECT rule_id, count(*) AS matched, count(*) FILTER (grp = row_group) AS covered FROM matched GROUP BY rule_id")
def a13(spark, d):
    f = rule_frame(spark, d)
    return C.coverage(fixed_rules(f), f, ROW_FEATURES, "grp")


@query("a13_uncovered_rows", f"WITH {RULE_FRAME_SQL} SELECT row_id FROM f WHERE row_id NOT IN (SELECT row_id FROM matched WHERE grp = row_group)")
def a13_uncovered(spark, d):
    f = rule_frame(spark, d)
    return C.uncovered_rows(fixed_rules(f), f, ROW_FEATURES, "grp")


@query("g15_violations", f"WITH {RULE_FRAME_SQL} SELECT row_id, rule_id FROM matched WHERE grp <> row_group")
def g15(spark, d):
    f = rule_frame(spark, d)
    return C.violations(fixed_rules(f), f, ROW_FEATURES, "grp")


@query("j16_p06_violation_rows", f"WITH {RULE_FRAME_SQL} SELECT row_id, segment, priority, nation, count(*) AS broken FROM matched JOIN f USING (row_id) WHERE matched.grp <> row_group GROUP BY ALL".replace("segment, priority, nation, count", "f.segment AS segment, f.priority AS priority, f.nation AS nation, count"))
def j16(spark, d):
    f = rule_frame(spark, d)
    broken = C.violations(fixed_rules(f), f, ROW_FEATURES, "grp").groupBy("row_id").agg(F.count("*").alias("broken"))
    return broken.join(f, "row_id").select("row_id", "segment", "priority", "nation", "broken")


@query("g15_condense_violations", f"WITH {RULE_FRAME_SQL} SELECT row_id, string_agg(rule_id::VARCHAR, ',' ORDER BY rule_id) AS centers FROM matched WHERE grp <> row_group GROUP BY row_id")
def g15_condense(spark, d):
    f = rule_frame(spark, d)
    kinds = rule_classes(f)
    found = C.condensed(fixed_rules(kinds), f, ROW_FEATURES, "grp", kinds)
    return found.select("row_id", F.array_join(F.col("centers").cast("array<string>"), ",").alias("centers"))


# Every row has one segment and priority, so rules cover disjoint rows and are picked by size until one gains too little.
@query(
    "g13_g14_spanning_rules",
    f"""WITH {RULE_FRAME_SQL}, m AS (SELECT rule_id, count(*) AS n FROM matched GROUP BY rule_id),
o AS (SELECT rule_id, n, row_number() OVER w - 1 AS place, coalesce(sum(n) OVER (ORDER BY n DESC, rule_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM m WINDOW w AS (ORDER BY n DESC, rule_id)),
s AS (SELECT *, n / 2.0 < 0.0005 * ((SELECT sum(n) FROM m) - 0.5 * before) AS small FROM o)
SELECT place::INT AS place, rule_id FROM s WHERE place <= coalesce((SELECT min(place) FROM s WHERE small), 1000000)""",
)
def g13(spark, d):
    from netquarry.session import stored

    kinds = rule_classes(rule_frame(spark, d))
    rows = stored(C.rule_rows(fixed_rules(kinds), C.long_items(kinds, ROW_FEATURES)), "rows")
    picked = C.spanning_rules(rows, drop_picked=True, sizes=kinds)
    return spark.createDataFrame([(k, r) for k, r in enumerate(picked)], "place int, rule_id long")


HOT = ["MACHINERY", "BUILDING", "AUTOMOBILE", "HOUSEHOLD", "FURNITURE"]


@query("a16_one_hot", "SELECT n_nationkey AS nation, " + ", ".join(f"coalesce(max(CASE WHEN c_mktsegment = '{x}' THEN 1 END), 0) AS {x}" for x in HOT) + " FROM nation JOIN customer ON n_nationkey = c_nationkey GROUP BY n_nationkey")
def a16(spark, d):
    c = B.table(spark, d, "customer")
    return C.one_hot(c.select(F.col("c_nationkey").alias("nation"), "c_mktsegment"), "nation", "c_mktsegment", HOT)


@query("a15_prune_columns", "SELECT c_custkey AS k, (c_acctbal > 0)::INT AS rich FROM customer")
def a15(spark, d):
    c = B.table(spark, d, "customer").select(F.col("c_custkey").alias("k"), (F.col("c_acctbal") > 0).cast("int").alias("rich"), (F.col("c_custkey") < 0).cast("int").alias("never"), F.lit(1).alias("always"))
    return C.prune_columns(c, ["rich", "never", "always"])


@query("a17_o03_top_keywords", f"WITH {B.IFACE_KEYWORDS_SQL} SELECT word, count(*) AS count FROM iface_keywords GROUP BY word ORDER BY 2 DESC, 1 LIMIT 14")
def a17(spark, d):
    return C.top_keywords(B.iface_keywords(spark, d))


@query("k09_k10_filter_rules", f"{LEARN_SQL} SELECT rule, grp, a FROM learned WHERE grp = 'O' AND NOT contains(rule, 'status=>')")
def k09(spark, d):
    learned = C.learn(counts(spark, d), FEATURES, 2)
    return _text(learned.where((F.col("grp") == "O") & ~F.exists("rule", lambda x: F.startswith(x, F.lit("status=>")))))


SWEEP = ["kind", "flag", "status"]


def _sweep_sql() -> str:
    parts = []
    for g in SWEEP:
        for f in (x for x in SWEEP if x != g):
            parts.append(f"SELECT '{g}' AS grouped_by, '{f}=>' || {f} AS rule, {g} AS grp, count(*) AS a FROM frame GROUP BY {f}, {g}")
    return f"""WITH {B.FRAME_SQL}, l AS ({" UNION ALL ".join(parts)}),
t AS (SELECT *, sum(a) OVER (PARTITION BY grouped_by, rule) AS r FROM l)
SELECT grouped_by, rule, grp, a AS frequency, round(a / r, 9) AS precision FROM t WHERE abs(a - (r - a)) > 2 AND a > 10 AND a / r >= 0.3"""


@query("p02_sweep", _sweep_sql())
def p02(spark, d):
    s = C.sweep(B.frame(spark, d), SWEEP, 1, min_support=0, min_count=10, min_difference=2, min_lift=0, min_confidence=0)
    return _text(C.anomalies(s, 0.3)).select("grouped_by", "rule", "grp", "frequency", F.round("precision", 9).alias("precision"))


def overlapping_rules(kinds):
    """Rules of one item and of two, from classes of rows: each row matches several, and most of them share items."""
    from functools import reduce
    from itertools import combinations

    parts = []
    for n in (1, 2):
        for c in combinations(ROW_FEATURES, n):
            parts.append(kinds.groupBy(F.array(*map(C.item, c)).alias("rule")).agg(F.max("grp").alias("grp"), F.sum("n").alias("n")).where("n >= 3").select("rule", "grp"))
    from pyspark.sql import Window

    rules = reduce(lambda a, b: a.unionByName(b), parts)
    # As many rules as pairs of values of three features.
    return rules.withColumn("rule_id", F.row_number().over(Window.orderBy("rule")).cast("long"))


@query("g13_overlapping_spanning_rules")
def g13_overlapping(spark, d):
    """Rules that overlap, so weights are halved again and again: greedy, beyond SQL; the test counts every rule in every round."""
    from netquarry.session import stored

    kinds = rule_classes(rule_frame(spark, d))
    rules = stored(overlapping_rules(kinds), "rules")
    rows = stored(C.rule_rows(rules, C.long_items(kinds, ROW_FEATURES)), "rows")
    return spark.createDataFrame([(k, r) for k, r in enumerate(C.spanning_rules(rows, sizes=kinds))], "place int, rule_id long")


@query("g15_condense_overlapping_violations")
def g15_overlapping(spark, d):
    """Rows that break several rules which share items: greedy star covers, held against brute force in the tests."""
    from netquarry.session import stored

    f = rule_frame(spark, d)
    kinds = rule_classes(f)
    rules = stored(overlapping_rules(kinds), "rules")
    found = C.condensed(rules, f, ROW_FEATURES, "grp", kinds)
    return found.select("row_id", F.array_join(F.col("centers").cast("array<string>"), ",").alias("centers"))


@query("p05_batch_of_features", f"""WITH {RULE_FRAME_SQL.split(",\nrules AS")[0]}, n AS (SELECT row_id, 'segment' AS feature, 'priority' AS f, segment AS g, priority AS v FROM f UNION ALL SELECT row_id, 'segment', 'grp', segment, grp FROM f
  UNION ALL SELECT row_id, 'priority', 'segment', priority, segment FROM f UNION ALL SELECT row_id, 'priority', 'grp', priority, grp FROM f UNION ALL SELECT row_id, 'grp', 'segment', grp, segment FROM f UNION ALL SELECT row_id, 'grp', 'priority', grp, priority FROM f),
l AS (SELECT feature AS grouped_by, f || '=>' || v AS rule, g AS grp, count(*) AS a FROM n GROUP BY ALL), t AS (SELECT *, sum(a) OVER (PARTITION BY grouped_by, rule) AS r FROM l)
SELECT grouped_by, grp, count(*) AS rules, arg_min(rule, (-a / r, rule)) AS best FROM t WHERE abs(a - (r - a)) > 2 AND a > 10 GROUP BY ALL""")
def p05(spark, d):
    """For each feature as the group and each of its values: how many rules there are and the most precise one, from one sweep."""
    s = _text(C.sweep(rule_frame(spark, d), ["segment", "priority", "grp"], 1, min_support=0, min_count=10, min_difference=2, min_lift=0, min_confidence=0))
    return s.groupBy("grouped_by", "grp").agg(F.count("*").alias("rules"), F.min_by("rule", F.struct(-F.col("precision"), F.col("rule"))).alias("best"))


@query("o05_greedy_pick", f"WITH {RULE_FRAME_SQL} SELECT rule_id, count(*)::DOUBLE AS gain FROM matched GROUP BY rule_id ORDER BY count(*) DESC, rule_id LIMIT 1")
def o05(spark, d):
    """The first pick of the greedy cover: the rule with most rows, of equals the smallest."""
    from netquarry.session import stored

    kinds = rule_classes(rule_frame(spark, d))
    rows = stored(C.rule_rows(fixed_rules(kinds), C.long_items(kinds, ROW_FEATURES)), "rows")
    weights = kinds.select("row_id", F.col("n").cast("double").alias("weight"))
    rule, gain, _ = C.best_rule(rows, weights, rows.join(weights, "row_id").groupBy("rule_id").agg(F.sum("weight").alias("gain")))
    return spark.createDataFrame([(rule, gain)] if rule is not None else [], "rule_id long, gain double")
