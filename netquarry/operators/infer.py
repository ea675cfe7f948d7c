"""Schema inference: kinds of keys, symbols, their types, aliases and relationships, out of documents without a schema.

Documents are flattened to a table of keys (doc, parent, key, container, leaf): parent is the path of the enclosing
object as an array. All inference is on that table; levels are walked from the root, a join and an aggregation each.
"""

from __future__ import annotations

import json
from itertools import islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from netquarry.functions import ip as ipf
from netquarry.functions.text import keywords, longest_shared
from netquarry.session import parts_for, stored

KEYS = "doc string, parent array<string>, key string, container string, leaf string"
#: Keys that a Python worker gathers before it hands them on.
KEYS_AT_ONCE = 10_000
#: Types kept however few names they have, and types of free text.
PRESERVED, DESCRIPTIONS = ("_address", "_description"), ("description", "comment", "remark")


def flatten_json(documents: DataFrame) -> DataFrame:
    """Keys of (doc, json) rows: container is dict, list or null; list elements are keys of their list. Broken JSON gives no rows."""

    columns = ["doc", "parent", "key", "container", "leaf"]
    kinds = [pa.string(), pa.list_(pa.string()), pa.string(), pa.string(), pa.string()]

    def keys_of(doc, text):
        try:
            root = json.loads(text) if text else None
        except ValueError:
            return
        todo = [((), root)]
        while todo:
            path, value = todo.pop()
            pairs = value.items() if isinstance(value, dict) else ((str(x), None) for x in value if not isinstance(x, dict | list)) if isinstance(value, list) else ()
            for k, v in pairs:
                kind = "dict" if isinstance(v, dict) else "list" if isinstance(v, list) else None
                yield doc, path, k, kind, None if kind or v is None or isinstance(v, bool) else str(v)
                if kind:
                    todo.append(((*path, k), v))

    def run(batches):
        # A worker holds one document and KEYS_AT_ONCE keys, however many documents a batch has.
        for batch in batches:
            found = (row for k in range(batch.num_rows) for row in keys_of(batch.column(0)[k].as_py(), batch.column(1)[k].as_py()))
            while some := list(islice(found, KEYS_AT_ONCE)):
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*some, strict=True), kinds, strict=True)], columns)

    return documents.select(F.col("doc").cast("string"), F.col("json").cast("string")).mapInArrow(run, KEYS)


def _plain(key: Column) -> Column:
    """Key without the mark of inactive parts."""
    return F.regexp_replace(key, "^inactive: ", "")


def keykinds(keys: DataFrame) -> DataFrame:
    """signature, kind of a table (signature, instance, key): pair, mixed, name, type or unknown.

    pair: every distinct key has exactly one space; mixed: some key has a space; name: distinct keys are over 0.2 of all,
    or over 25; type otherwise.
    """
    k = keys.withColumn("key", _plain(F.col("key")))
    spaces = F.length("key") - F.length(F.replace("key", F.lit(" "), F.lit("")))
    distinct = k.groupBy("signature", "key").agg(F.count("*").alias("n"), F.first(spaces).alias("spaces"))
    counts = distinct.groupBy("signature").agg(F.sum("n").alias("total"), F.count("key").alias("unique"), F.count_if(F.col("spaces") == 1).alias("single"), F.count_if(F.col("spaces") > 0).alias("spaced"))
    kind = F.when(F.col("unique") == 0, "unknown").when(F.col("single") == F.col("unique"), "pair").when(F.col("spaced") > 0, "mixed").when((F.col("unique") > 0.2 * F.col("total")) | (F.col("unique") > 25), "name").otherwise("type")
    return counts.select("signature", "total", "unique", kind.alias("kind"))


def single_keykinds(keys: DataFrame) -> DataFrame:
    """signature, kind of signatures with one instance, from the keys below its keys: a table (signature, key, container, sub)."""
    spaces = F.length("key") - F.length(F.replace("key", F.lit(" "), F.lit("")))
    per_key = keys.groupBy("signature", "key").agg(F.first("container").alias("container"), F.first(spaces).alias("spaces"))
    shape = per_key.groupBy("signature").agg(F.count("*").alias("keys"), F.count_if(F.col("container").isNotNull()).alias("nested"), F.count_if(F.col("spaces") == 1).alias("pairs"))
    subs = keys.where("sub is not null").groupBy("signature", "container").agg(F.count("*").alias("total"), F.count_distinct("sub").alias("unique")).groupBy("signature").agg(F.sum(F.when(F.col("container") == "dict", F.col("total"))).alias("dt"), F.sum(F.when(F.col("container") == "dict", F.col("unique"))).alias("du"), F.sum(F.when(F.col("container") == "list", F.col("total"))).alias("lt"), F.sum(F.when(F.col("container") == "list", F.col("unique"))).alias("lu"))
    repeated = F.coalesce(F.col("du") <= 0.75 * F.col("dt"), F.lit(False)) | F.coalesce(F.col("lu") <= 0.75 * F.col("lt"), F.lit(False))
    named = F.when(F.col("pairs") == F.col("keys"), "pair").when(F.col("pairs") == 0, "name").otherwise("mixed")
    kind = F.when(F.col("dt").isNull() & F.col("lt").isNull(), "type").when(F.col("keys") - F.col("nested") > F.col("nested"), "type").when(repeated, named).otherwise("type")
    return shape.join(subs, "signature", "left").select("signature", kind.alias("kind"))


def mixed_parts(keys: DataFrame) -> DataFrame:
    """signature, part, share: how often each word of mixed keys occurs, against the most frequent one."""
    parts = keys.select("signature", F.explode(F.split("key", " ")).alias("part")).groupBy("signature", "part").agg(F.count("*").alias("n"))
    return parts.select("signature", "part", (F.col("n") / F.max("n").over(Window.partitionBy("signature"))).alias("share"))


def extract_symbols(keys: DataFrame, max_depth: int = 1000) -> DataFrame:
    """doc, path, type, name of every symbol: names under name kinds, pairs "type name", and leaf values by their key.

    Levels are walked until one is empty; documents that are nested deeper than max_depth raise. Keys meet in parts that do not grow with
    the table; what is told of signatures is written, so that the optimizer knows how small it is and does not gather a signature's keys.
    """
    keys = stored(keys, "keys")
    parts = parts_for(keys.count(), keys.sparkSession)
    level = keys.where(F.size("parent") == 0).select("doc", "parent", F.lit("").alias("signature"), F.lit("root").alias("last"), "key", "container", "leaf")
    found = None
    for _ in range(max_depth):
        level = stored(level)
        if level.isEmpty():
            return found.repartition(parts, "doc", "path").distinct() if found is not None else _no_symbols(keys)
        instances = stored(level.groupBy("signature").agg(F.count_distinct(F.struct("doc", "parent")).alias("instances")), "instances")
        below = keys.select(F.col("doc").alias("d"), F.col("parent").alias("p"), F.col("key").alias("sub"))
        single = level.join(instances.where("instances = 1"), "signature", "left_semi")
        seen = single.join(below, (F.col("doc") == F.col("d")) & (F.concat("parent", F.array("key")) == F.col("p")), "left")
        one = single_keykinds(seen.select("signature", "key", "container", "sub")).withColumnRenamed("kind", "one")
        kinds = keykinds(level.select("signature", F.struct("doc", "parent").alias("instance"), "key")).select("signature", "kind").join(one, "signature", "left").select("signature", F.coalesce("one", "kind").alias("kind"))
        marked = level.join(stored(kinds, "kinds"), "signature")
        words = F.split("key", " ", 2)
        paired = F.col("kind").isin("pair", "mixed") & (F.size(words) == 2)
        named = F.col("kind") == "name"
        path = F.concat("parent", F.array("key"))
        symbols = marked.where(named | paired).select("doc", path.alias("path"), F.when(named, F.col("last")).otherwise(words[0]).alias("type"), F.when(named, F.col("key")).otherwise(words[1]).alias("name"))
        leaves = marked.where((F.col("kind") == "type") & F.col("leaf").isNotNull()).select("doc", path.alias("path"), F.col("key").alias("type"), F.col("leaf").alias("name"))
        # A level's symbols are written, so that the plan does not grow with the depth.
        own = stored(symbols.unionByName(leaves))
        found = own if found is None else found.unionByName(own)
        step = F.when(named, F.lit("*")).when(paired, F.concat(words[0], F.lit(" *"))).otherwise(F.col("key"))
        children = marked.where("container is not null").select(F.col("doc").alias("d"), path.alias("p"), F.concat_ws("/", "signature", step).alias("signature"), F.when(named, F.col("last")).when(paired, words[0]).otherwise(F.col("key")).alias("last"))
        level = keys.repartition(parts, "doc", "parent").join(children, (F.col("doc") == F.col("d")) & (F.col("parent") == F.col("p"))).select("doc", "parent", "signature", "last", "key", "container", "leaf")
    raise RuntimeError(f"documents are nested deeper than {max_depth} levels")


def _no_symbols(keys: DataFrame) -> DataFrame:
    return keys.where(F.lit(False)).select("doc", F.col("parent").alias("path"), F.col("key").alias("type"), F.col("key").alias("name"))


def typescope(instances: DataFrame) -> DataFrame:
    """type, scope of a table (type, outer, inner, body): unique, replicated or unknown, by how inner bodies repeat over outer names."""
    inner = instances.groupBy("type", "inner").agg(F.count("*").alias("n"), F.count_distinct("body").alias("bodies"))
    outer = instances.groupBy("type").agg(F.greatest(0.05 * F.count_distinct("outer"), F.lit(3.0)).alias("few"))
    n, bodies, few = F.col("n"), F.col("bodies"), F.col("few")
    case = F.when(n == 1, "singleton").when(bodies == n, "unique").when(bodies == 1, "replicated").when(n < few, "few").when(bodies <= few, "replicated").otherwise("unique")
    counts = inner.join(outer, "type").select("type", case.alias("case")).groupBy("type").agg(*[F.count_if(F.col("case") == c).alias(c) for c in ("unique", "replicated", "few")])
    scope = F.when((F.col("unique") == 0) & (F.col("replicated") == 0), F.when(F.col("few") == 0, "unique").otherwise("unknown")).when(F.col("unique") == 0, "replicated").when(F.col("unique") >= F.col("replicated"), "unique").when(F.col("unique") < 0.15 * F.col("replicated"), "replicated").otherwise("unique")
    return counts.select("type", scope.alias("scope"))


def invert(symbols: DataFrame) -> DataFrame:
    """type, names (in order) of (type, name)."""
    return symbols.select("type", "name").distinct().groupBy("type").agg(F.array_sort(F.collect_list("name")).alias("names"))


def remove_small_types(symbols: DataFrame, threshold: int = 4) -> DataFrame:
    """(type, name) without types of fewer distinct names."""
    large = symbols.groupBy("type").agg(F.count_distinct("name").alias("n")).where((F.col("n") >= threshold) | F.col("type").isin(*PRESERVED)).select("type")
    return symbols.join(large, "type", "left_semi")


def type_overlaps(symbols: DataFrame) -> DataFrame:
    """a, b, common, na, nb for pairs of types with names in common (both orders)."""
    s = symbols.select("type", "name").distinct()
    sizes = s.groupBy("type").agg(F.count("*").alias("n"))
    met = s.select("name", F.col("type").alias("a")).join(s.select("name", F.col("type").alias("b")), "name").where("a <> b").groupBy("a", "b").agg(F.count("*").alias("common"))
    return met.join(sizes.select(F.col("type").alias("a"), F.col("n").alias("na")), "a").join(sizes.select(F.col("type").alias("b"), F.col("n").alias("nb")), "b").select("a", "b", "common", "na", "nb")


def type_subsets(symbols: DataFrame) -> DataFrame:
    """type, root: types whose names all belong to another type; of several, the one with most names (ties: first in order). Equal sets root in the first."""
    inside = type_overlaps(symbols).where((F.col("common") == F.col("na")) & ((F.col("na") < F.col("nb")) | (F.col("b") < F.col("a"))))
    return inside.groupBy(F.col("a").alias("type")).agg(F.min(F.struct((-F.col("nb")).alias("n"), "b")).alias("x")).select("type", F.col("x.b").alias("root"))


def type_aliases(symbols: DataFrame, letters: int = 5) -> DataFrame:
    """type, alias: types with a name in common of which one name contains the other, or that share a run of letters; the shorter (then first) is kept."""
    pairs = type_overlaps(symbols).where((F.length("a") < F.length("b")) | ((F.length("a") == F.length("b")) & (F.col("a") < F.col("b"))))
    alike = F.contains(F.col("b"), F.col("a")) | (F.length(longest_shared(F.col("a"), F.col("b"))) >= letters)
    return pairs.where(alike).select(F.col("a").alias("type"), F.col("b").alias("alias"))


def merge_aliases(symbols: DataFrame, aliases: DataFrame) -> DataFrame:
    """Symbols with each alias under its first kept type."""
    chosen = aliases.groupBy("alias").agg(F.min(F.struct(F.length("type").alias("n"), "type")).alias("x")).select(F.col("alias").alias("type"), F.col("x.type").alias("primary"))
    return symbols.join(chosen, "type", "left").withColumn("type", F.coalesce("primary", "type")).drop("primary").distinct()


def special_types(symbols: DataFrame) -> DataFrame:
    """Types whose names are all addresses become _address, those of free text _description."""
    addresses = symbols.groupBy("type").agg(F.bool_and(ipf.is_address(F.regexp_replace("name", "^inactive: ", ""))).alias("all")).where("all").select("type", F.lit("_address").alias("special"))
    texts = symbols.where(F.col("type").isin(*DESCRIPTIONS)).select("type", F.lit("_description").alias("special")).distinct()
    special = addresses.join(texts, "type", "left_anti").unionByName(texts)
    return symbols.join(special, "type", "left").withColumn("type", F.coalesce("special", "type")).drop("special").distinct()


def relationships(symbols: DataFrame) -> DataFrame:
    """src_type, src_name, dst_type, dst_name, docs: each symbol with the nearest symbol that encloses it."""
    inner = symbols.select("doc", "path", "type", "name").distinct().withColumn("id", F.monotonically_increasing_id())
    inner = stored(inner)
    parts = parts_for(inner.count(), inner.sparkSession)
    ancestors = inner.where(F.size("path") > 1).select("id", "doc", F.explode(F.transform(F.sequence(F.lit(1), F.size("path") - 1), lambda n: F.slice("path", F.lit(1), n))).alias("path"))
    outer = inner.select("doc", "path", F.col("type").alias("dst_type"), F.col("name").alias("dst_name"))
    met = ancestors.repartition(parts, "doc", "path").join(outer, ["doc", "path"]).repartition(parts, "id").groupBy("id").agg(F.max(F.struct(F.size("path").alias("n"), "dst_type", "dst_name")).alias("x"))
    pairs = met.join(inner.select("id", "doc", "type", "name"), "id").select("doc", F.col("type").alias("src_type"), F.col("name").alias("src_name"), F.col("x.dst_type").alias("dst_type"), F.col("x.dst_name").alias("dst_name"))
    return pairs.repartition(parts, "src_name", "dst_name").groupBy("src_type", "src_name", "dst_type", "dst_name").agg(F.count_distinct("doc").alias("docs"))


def relationship_graph(related: DataFrame) -> DataFrame:
    """Edges of relationships; addresses become their networks, descriptions their keywords."""
    def node(side: str) -> Column:
        name, kind = F.col(f"{side}_name"), F.col(f"{side}_type")
        return F.when(kind == "_address", F.array(ipf.generalize_address(name))).when(kind == "_description", keywords(name)).otherwise(F.array(name))

    def label(side: str) -> Column:
        kind = F.col(f"{side}_type")
        return F.when(kind == "_address", "subnet").when(kind == "_description", "keyword").otherwise(kind)

    ends = related.select(F.explode(node("src")).alias("src"), label("src").alias("src_type"), node("dst").alias("dst"), label("dst").alias("dst_type"))
    return ends.select("src", "src_type", F.explode("dst").alias("dst"), "dst_type").where("src <> dst").distinct()


def shared_keywords(words: DataFrame, least: int = 3) -> DataFrame:
    """a, b, shared: pairs of distinct words with a run of letters in common. Words meet by their three-letter pieces."""
    w = words.select("word").distinct()
    n = F.length("word") - (least - 1)
    pieces = w.where(n > 0).select("word", F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), n), lambda i: F.substr(F.col("word"), i, F.lit(least))))).alias("piece"))
    met = pieces.select("piece", F.col("word").alias("a")).join(pieces.select("piece", F.col("word").alias("b")), "piece").where("a < b").select("a", "b").distinct()
    return met.withColumn("shared", longest_shared(F.col("a"), F.col("b")))


def shared_remainders(pairs: DataFrame) -> DataFrame:
    """word, shared, rest: what is left of each word of a pair around the letters it shares."""
    of = lambda c: pairs.select(F.col(c).alias("word"), "shared", F.filter(F.array(F.substr(F.col(c), F.lit(1), F.instr(F.col(c), F.col("shared")) - 1), F.substr(F.col(c), F.instr(F.col(c), F.col("shared")) + F.length("shared"))), lambda x: x != "").alias("rest"))
    return of("a").unionByName(of("b")).distinct()


def syntax_template(kinds: list[tuple[str, str]]) -> dict:
    """Nested template of (signature, kind) rows, names as NAME; the rows are as few as the grammar's levels."""
    out: dict = {}
    for signature, kind in sorted(kinds):
        at = out
        for part in [p for p in signature.split("/") if p]:
            at = at.setdefault("NAME" if part == "*" else part.replace("*", "NAME"), {})
        if kind == "name":
            at.setdefault("NAME", {})
    return out


def template_paths(kinds: DataFrame) -> DataFrame:
    """path, depth: the nodes of the syntax template of (signature, kind), names as NAME. Prefixes of all signatures are merged where they
    lie: equal ones are one row before the shuffle."""
    parts = F.transform(F.filter(F.split("signature", "/"), lambda x: x != ""), lambda x: F.replace(x, F.lit("*"), F.lit("NAME")))
    whole = F.when(F.col("kind") == "name", F.concat(parts, F.array(F.lit("NAME")))).otherwise(parts)
    nodes = kinds.select(whole.alias("p")).where(F.size("p") > 0).select(F.explode(F.transform(F.sequence(F.lit(1), F.size("p")), lambda n: F.slice("p", F.lit(1), n))).alias("p"))
    return nodes.select(F.array_join("p", "/").alias("path"), F.size("p").alias("depth")).distinct()


def infer_graph(documents: DataFrame) -> dict[str, DataFrame]:
    """The whole chain over (doc, json): keys, symbols, cleaned symbols (special types, aliases merged, small types dropped),
    relationships and graph. Each step is a written table, so a later one does not run the earlier ones again."""
    keys = stored(flatten_json(documents), "keys")
    symbols = stored(extract_symbols(keys), "symbols")
    special = stored(special_types(symbols), "special")
    merged = stored(merge_aliases(special, type_aliases(special.select("type", "name").distinct())), "merged")
    cleaned = stored(remove_small_types(merged), "cleaned")
    related = stored(relationships(cleaned), "related")
    return {"keys": keys, "symbols": symbols, "cleaned": cleaned, "relationships": related, "graph": relationship_graph(related)}
