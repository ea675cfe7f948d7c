"""Words of phrases, shared substrings, and compact names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Common function words that carry no meaning in descriptions (own short list; several languages).
STOPWORDS = ("a", "an", "and", "are", "as", "at", "be", "by", "de", "der", "des", "die", "du", "el", "en", "et", "for", "from", "in", "is", "it", "la", "le", "les", "not", "of", "on", "or", "que", "the", "to", "und", "was", "with")
# Abbreviations spelled out.
ABBREVIATIONS = {"bldg": "building", "mgmt": "management", "pub": "public"}
# Starts under which longer keywords are folded.
COMMON_STARTS = ("student", "ems", "bg", "voip")


def keywords(phrase: Column, delimiters: str = " ") -> Column:
    """Distinct lower-case words of a phrase, without stop words and single letters, abbreviations spelled out."""
    words = F.transform(F.split(phrase, delimiters), lambda w: F.lower(w))
    kept = F.filter(words, lambda w: (F.length(w) > 1) & ~w.isin(*STOPWORDS))

    def spell(w: Column) -> Column:
        out = w
        for short, long in ABBREVIATIONS.items():
            out = F.when(w == short, F.lit(long)).otherwise(out)
        return out

    return F.array_distinct(F.transform(kept, spell))


def longest_shared(a: Column, b: Column, whole: bool = True) -> Column:
    """Longest substring of a that is in b, the leftmost of equals; whole=False leaves out a's last character.

    If a run of some length is shared, shorter ones are: the length is found by halving, each time with the hashes of all runs of
    one length of both; the run itself is then looked for by its letters.
    """
    size = F.length(a) if whole else F.length(a) - 1
    runs = lambda x, most, n: F.transform(F.sequence(F.lit(1), most - n + 1), lambda i: F.xxhash64(F.substr(x, i, n)))
    most = F.least(size, F.length(b))

    def halve(state: Column, _: Column) -> Column:
        mid = F.floor((state["lo"] + state["hi"] + 1) / 2).cast("int")
        shared = F.arrays_overlap(runs(a, size, mid), runs(b, F.length(b), mid))
        return F.when(state["lo"] == state["hi"], state).when(shared, F.struct(mid.alias("lo"), state["hi"].alias("hi"))).otherwise(F.struct(state["lo"].alias("lo"), (mid - 1).alias("hi")))

    start = F.struct(F.lit(0).alias("lo"), most.cast("int").alias("hi"))
    found = F.aggregate(F.sequence(F.lit(1), F.ceil(F.log2(most + 1)).cast("int")), start, halve)["lo"]

    def first(n: Column) -> Column:
        at = F.filter(F.sequence(F.lit(1), size - n + 1), lambda i: F.contains(b, F.substr(a, i, n)))
        return F.when(n > 0, F.substr(a, F.get(at, F.lit(0)), n)).otherwise(F.lit(""))

    # The length is bound, so that it is found once.
    return F.when(a.isNotNull() & b.isNotNull(), F.when(most > 0, F.get(F.transform(F.array(found), first), F.lit(0))).otherwise(F.lit("")))


def common_starts(word: Column, starts: tuple[str, ...] = COMMON_STARTS) -> Column:
    """The starts that a keyword contains, or the keyword itself."""
    found = F.filter(F.array(*[F.lit(s) for s in starts]), lambda s: F.contains(word, s))
    return F.when(F.size(found) > 0, found).otherwise(F.array(word))


def strip_digits(word: Column) -> Column:
    """Digits cut, unless there is nothing else."""
    return F.when(word.rlike(r"^\d+$"), word).otherwise(F.regexp_replace(word, r"\d", ""))


def expand_ranges(text: Column) -> Column:
    """[1, 2, 3, 7] of "1-3,7"; null of an empty or null text."""
    parts = F.split(F.regexp_replace(text, r"\s", ""), ",")
    numbers = F.flatten(F.transform(parts, lambda x: F.sequence(F.substring_index(x, "-", 1).cast("int"), F.substring_index(x, "-", -1).cast("int"))))
    return F.when(F.length(F.trim(text)) > 0, numbers)


def ranges(numbers: Column) -> Column:
    """"1-3,7" of a set of numbers."""
    ordered = F.array_sort(F.array_distinct(numbers))
    start = F.array().cast("array<struct<lo:bigint,hi:bigint>>")

    def add(acc: Column, n: Column) -> Column:
        last = F.try_element_at(acc, F.lit(-1))
        island = lambda lo, hi: F.array(F.named_struct(F.lit("lo"), lo, F.lit("hi"), hi))
        one, grown = island(n.cast("long"), n.cast("long")), island(last["lo"], n.cast("long"))
        return F.when(F.coalesce(last["hi"] == n - 1, F.lit(False)), F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), grown)).otherwise(F.concat(acc, one))

    islands = F.aggregate(ordered, start, add)
    return F.array_join(F.transform(islands, lambda x: F.when(x["lo"] == x["hi"], x["lo"].cast("string")).otherwise(F.concat_ws("-", x["lo"].cast("string"), x["hi"].cast("string")))), ",")


def group_name(kind: Column, members: Column) -> Column:
    """Name of coalesced nodes: Vlan{100,200-201} for VLANs, dev_{a,b} for interfaces of one device, else a comma list."""
    ordered = F.array_sort(members)
    vlan = F.concat(F.lit("Vlan{"), ranges(F.transform(members, lambda m: F.regexp_extract(m, r"(\d+)$", 1).cast("long"))), F.lit("}"))
    device = F.substring_index(F.get(ordered, F.lit(0)), "_", 1)
    same = F.forall(ordered, lambda m: F.startswith(m, F.concat(device, F.lit("_"))))
    inside = F.array_join(F.transform(ordered, lambda m: F.substr(m, F.length(device) + 2)), ",")
    return F.when(kind == "vlan", vlan).when((kind == "interface") & same, F.concat(device, F.lit("_{"), inside, F.lit("}"))).otherwise(F.array_join(ordered, ","))


def hamming(a: Column, b: Column) -> Column:
    """Share of places where two arrays differ."""
    return F.size(F.filter(F.zip_with(a, b, lambda x, y: x != y), lambda d: d)) / F.size(a)
