"""Feature frames over the driver's tables: interfaces are customers, VLANs nations and ACLs market segments."""

from __future__ import annotations

from pyspark.sql import functions as F

from netquarry.operators import features as X
from netquarry.plans import bindings as B
from netquarry.plans.registry import query
from netquarry.session import stored

WORDS_SQL = f"""{B.INTERFACES_SQL}, {B.IFACE_KEYWORDS_SQL},
vocabulary AS (SELECT word, count(*) AS n FROM iface_keywords GROUP BY word ORDER BY count(*) DESC, min({{'d': device, 'i': iface, 'w': word}}), word LIMIT 14),
ladder AS (SELECT iface AS row, 'subnet_/' || p AS feature, CASE WHEN ip IS NULL THEN 'n' ELSE {B.DOTTED_SQL.format("((ip >> (32 - p)) << (32 - p))")} || '/' || p END AS value
  FROM interfaces, (SELECT unnest(range(20, 32)) AS p)),
ones AS (SELECT iface AS row, word AS feature FROM iface_keywords WHERE word IN (SELECT word FROM vocabulary)),
groups AS (SELECT iface AS row, coalesce(in_acl, 'none') AS grp FROM interfaces),
frame AS (
  SELECT iface AS row, 'vlan_' || device AS feature, '1' AS value FROM interfaces
  UNION ALL SELECT iface, 'has_vlans', '1' FROM interfaces
  UNION ALL SELECT row, feature, '1' FROM ones
  UNION ALL SELECT row, feature, value FROM ladder WHERE feature IN (
    SELECT arg_min(feature, feature) FROM (SELECT feature, count(DISTINCT value) AS n FROM ladder GROUP BY feature) GROUP BY n)
  UNION ALL SELECT iface, 'out_acl', coalesce(out_acl, 'none') FROM interfaces)"""


def words(spark, d):
    k = B.iface_keywords(spark, d)
    return k.select(F.col("iface").alias("row"), "word", F.struct("device", "iface").alias("seq"))


def groups(spark, d):
    return B.interfaces(spark, d).select(F.col("iface").alias("row"), F.coalesce("in_acl", F.lit("none")).alias("grp"))


def interface_frame(spark, d):
    i = B.interfaces(spark, d).withColumn("row", F.col("iface"))
    vlans = i.select(F.col("row").alias("id"), F.lit("interface").alias("type"), F.col("device").cast("string").alias("nbr"), F.lit("vlan").alias("nbr_type"))
    w = stored(words(spark, d), "words")
    return X.frame(
        X.neighbor_features(vlans, "interface", "vlan", flags=True),
        X.word_features(w, X.vocabulary(w)),
        X.drop_equal_prefixes(X.prefix_features(i.select("row", "ip"))),
        X.attribute_features(i, "out_acl"),
    )


@query("a16_interface_frame", f"WITH {WORDS_SQL} SELECT row, feature, value FROM frame")
def a16(spark, d):
    return interface_frame(spark, d)


@query("a16_prefix_ladder", f"WITH {WORDS_SQL} SELECT row, feature, value FROM ladder")
def a16_ladder(spark, d):
    return X.prefix_features(B.interfaces(spark, d).select(F.col("iface").alias("row"), "ip"))


@query("a17_vocabulary", f"WITH {WORDS_SQL} SELECT word, n AS count FROM vocabulary")
def a17_words(spark, d):
    return X.vocabulary(words(spark, d))


@query("a17_first_octets", f"WITH {B.ACL_LINES_SQL} SELECT DISTINCT acl AS row, 'octet_' || (slo >> 24) AS feature, '1' AS value FROM acl_lines")
def a17_octets(spark, d):
    from netquarry.functions import ip as ipf

    return X.octet_features(B.acl_lines(spark, d).select(F.col("acl").alias("row"), ipf.address_of(F.col("src")).alias("ip")))


@query(
    "a10_learn_interface_frame",
    f"""WITH {WORDS_SQL}, i AS (SELECT row, grp, feature || '=>' || value AS item FROM frame JOIN groups USING (row)),
often AS (SELECT item FROM i GROUP BY item HAVING count(*) >= 20), k AS (SELECT * FROM i WHERE item IN (SELECT item FROM often)),
pairs AS (SELECT x.item || '|' || y.item AS rule, x.grp AS grp, count(*) AS a FROM k x JOIN k y ON x.row = y.row AND x.item < y.item GROUP BY ALL)
SELECT item AS rule, grp, count(*) AS a FROM k GROUP BY ALL
UNION ALL SELECT rule, grp, a FROM pairs WHERE rule IN (SELECT rule FROM pairs GROUP BY rule HAVING sum(a) >= 20)""",
)
def a10(spark, d):
    """Rules of one and two items of the whole frame, from its long form."""
    learned = X.learn_items(X.items(interface_frame(spark, d)), groups(spark, d), 2, 20)
    return learned.withColumn("rule", F.array_join("rule", "|"))


@query(
    "a10_learn_one_hot",
    f"""WITH {WORDS_SQL}, dense AS (SELECT g.row AS row, grp, word AS f, (o.row IS NOT NULL)::INT AS v FROM groups g CROSS JOIN vocabulary LEFT JOIN ones o ON o.row = g.row AND o.feature = word)
SELECT f || '=>' || v AS rule, grp, count(*) AS a FROM dense GROUP BY ALL
UNION ALL SELECT x.f || '=>' || x.v || '|' || y.f || '=>' || y.v, x.grp, count(*) FROM dense x JOIN dense y ON x.row = y.row AND x.f < y.f GROUP BY ALL""",
)
def a10_one_hot(spark, d):
    """Rules with the zeros of one-hot words, which the frame does not store."""
    w = stored(words(spark, d), "words")
    known = stored(X.vocabulary(w), "vocabulary")
    learned = X.learn_one_hot(X.word_features(w, known), groups(spark, d), known.select(F.col("word").alias("feature")))
    return learned.withColumn("rule", F.array_join("rule", "|"))


@query(
    "k07_extended_frame",
    f"""WITH {WORDS_SQL}, placed AS (SELECT word, row_number() OVER (ORDER BY n DESC, (SELECT min({{'d': device, 'i': iface, 'w': word}}) FROM iface_keywords k WHERE k.word = vocabulary.word), word) AS k FROM vocabulary)
SELECT iface AS row, device AS filename, coalesce(in_acl, 'none') AS in_acl, {", ".join(f"max(CASE WHEN feature = 'subnet_/{p}' THEN value END) AS p{p}" for p in range(20, 32))},
  {", ".join(f"coalesce((SELECT max(1) FROM ones o WHERE o.row = iface AND o.feature = (SELECT word FROM placed WHERE k = {k})), 0)::VARCHAR AS word{k}" for k in range(1, 15))}
FROM interfaces JOIN ladder ON ladder.row = iface GROUP BY iface, device, in_acl""",
)
def k07(spark, d):
    """The wide frame of an interface table and its words, as it is exported: addresses, ACL, prefixes, the most frequent words."""
    i, w = B.interfaces(spark, d).withColumn("row", F.col("iface")), stored(words(spark, d), "words")
    top = [r["word"] for r in X.vocabulary(w).collect()]
    # As many rows as the vocabulary has.
    known = spark.createDataFrame([(t,) for t in top], "word string")
    ladder = X.prefix_features(i.select("row", "ip"))
    prefixes = [f"subnet_/{p}" for p in range(X.LADDER[0], X.LADDER[1] + 1)]
    whole = X.wide(X.frame(X.attribute_features(i, "in_acl"), ladder, X.word_features(w, known)), ["in_acl", *prefixes, *top])
    named = whole.join(i.select("row", F.col("device").alias("filename")), "row")
    return named.select("row", "filename", "in_acl", *[F.col(f"`{p}`").alias(p.replace("subnet_/", "p")) for p in prefixes], *[F.col(f"`{t}`").alias(f"word{k}") for k, t in enumerate(top, 1)])
