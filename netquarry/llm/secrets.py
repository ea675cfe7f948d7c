"""Secret scans in built-in functions only: three base patterns, and sliding-window Shannon entropy.

Candidates are runs of 20 or more of [A-Za-z0-9+/_-] that hold a letter. Each belongs to a character class (hex digits
only; letters only; letters and digits; base64, with one of the four signs as well); a window of 20 characters slides over
it, its counts kept incrementally (one character in, one out), and the candidate is a span of kind "entropy" if the
window's entropy reaches the class's threshold anywhere, unless the allow-list suppresses it or it meets a base span.
The allow-list tells whole candidates: UUIDs, ordered runs, marked examples, and paths, names and times whose parts between signs
are words, capitals and numbers, as long as their letters go together like those of words (plausible pairs); letters alone are a
candidate only where they do not. Entropies are sums of scaled integers, so the result does not depend on the order of additions.
Offsets are prefix sums, so that texts full of matches take time in proportion (times a logarithm).

Edge cases: null text is empty and has no spans; offsets are code points, end exclusive; equal rows give equal rows;
extra columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netquarry.llm.arrays import bound, running, running_sum

# Fixed patterns of the base kinds.
ASSIGN = r"""(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"
CANDIDATE = r"[A-Za-z0-9+/_-]{20,}"
#: Words, capitals and numbers in a row, with one letter behind (or one letter with a number): what stands between the signs of paths and names.
_SHORT = "By|Id|Of|In|On|To|Is|At|As|Or|No|Up|My|Be|Do|Go|Ok|Db|Ui|Js|Py"
_PART = rf"(?:(?=[^/_+-]*[a-z]{{2}})(?:[A-Z]?[a-z]{{2,}}+|{_SHORT}|[A-Z]{{1,6}}+|[0-9]{{1,4}}+)++[a-z]?|[A-Z]++[0-9]{{0,4}}|[a-z][0-9]{{0,4}}|[0-9]++(?:T[0-9]++)?Z?)?"
NAME = rf"^{_PART}(?:[/_+-]++{_PART})*+$"
#: Whole candidates that are no secrets.
ALLOWED = "|".join(
    [
        r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$",
        r"^(?:0123456789|1234567890|(?i:abcdefghijklmnopqrstuvwxyz|abcdefghij|abcdef)|[/_+-])++[0-9]{0,3}$",
        r"^(?i:example|placeholder|changeme|your|dummy)[/_+-]|(?i:example|placeholder)(?i:key)?$|^(.)\1{5,}",
    ]
)
#: Pairs of letters that words are made of: a vowel and a consonant, vowels and consonants that often stand together, and few with rare letters.
_VOWELS, _CONSONANTS, _RARE = "aeiouy", "bcdfghklmnprstvw", ("qu", "ex", "xt", "ze", "iz", "jo", "ja", "ju", "ob", "je")
_TOGETHER = "ee oo ea ou ai ie io ia ue ei au oa th st nd ng nt tr pr pl cl cr br bl gr gl fr fl dr sh ch ck ll ss tt ff pp rr mm nn sp sc sk sm sn sw tw wh ct pt ft lt rt rd rk rm rn rs ld lf lk lm ls mp mb nk nc ns ts ds ks ps gh dd cc gg bb ry ly ty my by".split()
PLAUSIBLE = frozenset([*[x for v in _VOWELS for c in _CONSONANTS for x in (v + c, c + v)], *_TOGETHER, *_RARE])
#: Letters of which fewer pairs than this percentage are plausible are no words, if there are at least so many pairs.
WORDS_PERCENT, LEAST_PAIRS = 65, 8
WINDOW = 20
#: Least entropy in bits a character, by class.
HEX_BITS, MIXED_BITS, BASE64_BITS, LETTER_BITS = 2.9, 3.4, 3.6, 3.6
KINDS = ("assign", "access", "hex", "entropy")
_SCALE = 1 << 24
_NLOGN = [round(n * math.log2(n) * _SCALE) if n else 0 for n in range(WINDOW + 1)]
_SPANS = "array<struct<start:int,end:int,what:string>>"


def located(text: Column, pattern: str, group: int = 0) -> Column:
    """Matches as (start, end, what): the pieces between matches and the matches give all offsets. what is the group's text."""
    pieces = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("hit"), F.regexp_extract_all(text, F.lit(pattern), F.lit(group)).alias("what"))

    def placed(p: Column) -> Column:
        ends = running_sum(F.transform(p, lambda x: (F.length(x["gap"]) + F.coalesce(F.length(x["hit"]), F.lit(0))).cast("long")))
        spans = F.zip_with(p, ends, lambda x, end: F.struct((end - F.length(x["hit"])).cast("int").alias("start"), end.cast("int").alias("end"), x["what"].alias("what")))
        return F.filter(spans, lambda x: x["start"].isNotNull())

    return F.when(text.rlike(pattern), bound(pieces, placed)).otherwise(F.array().cast(_SPANS))


def _apart(candidates: Column, base: Column) -> Column:
    """The candidates that meet no base span: in the order of starts, the furthest end before and the next start after tell."""
    mark = lambda spans, own: F.transform(spans, lambda x: F.struct(x["start"].alias("start"), F.lit(own).alias("own"), x["end"].alias("end"), x["what"].alias("what")))

    def kept(every: Column) -> Column:
        ends = running(F.transform(every, lambda x: F.when(x["own"], F.lit(-1)).otherwise(x["end"])), lambda a, b: F.greatest(a, b), F.lit(-1))
        starts = F.reverse(running(F.reverse(F.transform(every, lambda x: F.when(x["own"], F.lit(2**31 - 1)).otherwise(x["start"]))), lambda a, b: F.least(a, b), F.lit(2**31 - 1)))
        told = F.zip_with(every, F.arrays_zip(ends.alias("before"), starts.alias("after")), lambda x, y: F.when(x["own"] & (y["before"] <= x["start"]) & (y["after"] >= x["end"]), F.struct(x["start"], x["end"], x["what"])))
        return F.filter(told, lambda x: x.isNotNull())

    # Of equal starts the base span comes first, so that it is before.
    both = bound(F.array_sort(F.concat(mark(base, False), mark(candidates, True))), kept)
    return F.when((F.size(base) > 0) & (F.size(candidates) > 0), both).otherwise(candidates).cast(_SPANS)


def _put(counts: Column, k: Column, by: int) -> Column:
    return F.concat(F.slice(counts, F.lit(1), k), F.array(F.get(counts, k) + by), F.slice(counts, k + 2, F.lit(128)))


def window_entropy(candidate: Column, window: int = WINDOW) -> Column:
    """Largest entropy of a sliding window, in scaled bits times the window: window * log2(window) - sum of n log2 n."""
    codes = F.transform(F.split(candidate, ""), lambda c: F.ascii(c))
    leaving = F.concat(F.array_repeat(F.lit(-1), window), codes)
    moves = F.slice(F.zip_with(codes, leaving, lambda a, b: F.struct(a.alias("come"), b.alias("go"))), F.lit(1), F.length(candidate))
    table = F.array(*[F.lit(x).cast("long") for x in _NLOGN])
    start = F.struct(F.array_repeat(F.lit(0), 128).alias("counts"), F.lit(0).cast("long").alias("sum"), F.lit(0).alias("size"), F.lit(2**62).alias("least"))

    def leave(acc: Column, x: Column) -> Column:
        n = F.get(acc["counts"], x["go"])
        less = F.struct(_put(acc["counts"], x["go"], -1).alias("counts"), (acc["sum"] - F.get(table, n) + F.get(table, n - 1)).alias("sum"), (acc["size"] - 1).alias("size"), acc["least"].alias("least"))
        return F.when(x["go"] >= 0, less).otherwise(acc)

    def come(acc: Column, code: Column) -> Column:
        n = F.get(acc["counts"], code)
        total = acc["sum"] - F.get(table, n) + F.get(table, n + 1)
        size = acc["size"] + 1
        return F.struct(_put(acc["counts"], code, 1).alias("counts"), total.alias("sum"), size.alias("size"), F.when(size == window, F.least(acc["least"], total)).otherwise(acc["least"]).alias("least"))

    # One step takes the leaving character out, the next puts the coming one in: each state is bound once.
    steps = F.flatten(F.transform(moves, lambda m: F.array(F.struct(F.lit(None).cast("int").alias("come"), m["go"].alias("go")), F.struct(m["come"].alias("come"), F.lit(-1).alias("go")))))
    least = F.aggregate(steps, start, lambda acc, x: F.when(x["come"].isNull(), leave(acc, x)).otherwise(come(acc, x["come"])), lambda acc: acc["least"])
    return F.lit(round(window * math.log2(window) * _SCALE)) - least


def random_letters(x: Column) -> Column:
    """Whether the pairs of neighbouring letters are too seldom those of words."""
    pairs = F.filter(F.transform(F.sequence(F.lit(1), F.length(x) - 1), lambda i: F.lower(F.substr(x, i, F.lit(2)))), lambda p: p.rlike("^[a-z]{2}$"))
    known = F.lit(" " + " ".join(sorted(PLAUSIBLE)))
    words = lambda p: F.size(F.filter(p, lambda x: F.contains(known, F.concat(F.lit(" "), x)))) * 100 < F.size(p) * WORDS_PERCENT
    return bound(pairs, lambda p: (F.size(p) >= LEAST_PAIRS) & words(p))


def _suspicious(x: Column) -> Column:
    what = x["what"]
    digit = what.rlike("[0-9]")
    bits = F.when(what.rlike("^[0-9a-fA-F]+$") & digit, HEX_BITS).when(~digit, LETTER_BITS).when(what.rlike("[+/_-]"), BASE64_BITS).otherwise(MIXED_BITS)
    told = F.when(digit, ~what.rlike(NAME) | random_letters(what)).otherwise(random_letters(what))
    return what.rlike("[A-Za-z]") & ~what.rlike(ALLOWED) & told & (window_entropy(what) >= F.round(bits * (WINDOW * _SCALE)).cast("long"))


def scan_secrets(docs: DataFrame) -> DataFrame:
    """doc_id and assign, access, hex, entropy: arrays of (start, end, what)."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    t = F.col("text")
    found = rows.select("doc_id", F.filter(located(t, ASSIGN, 1), lambda x: F.length(x["what"]) >= 8).alias("assign"), located(t, ACCESS).alias("access"), located(t, HEX).alias("hex"), located(t, CANDIDATE).alias("candidates"))
    based = found.withColumn("base", F.concat("assign", "access", "hex"))
    return based.select("doc_id", "assign", "access", "hex", F.filter(_apart(F.col("candidates"), F.col("base")), _suspicious).alias("entropy"))


def _ranked(kind: str) -> Column:
    rank = F.lit(KINDS.index(kind)).alias("rank")
    return F.transform(kind, lambda x: F.struct(x["start"].alias("start"), rank, x["end"].alias("end")))


def _joined(*kinds: str) -> Column:
    ranked = F.array_sort(F.concat(*map(_ranked, kinds)))
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(ranked, lambda x: F.concat_ws(":", F.get(names, x["rank"]), x["start"].cast("string"), x["end"].cast("string"))), ",")


def secret_digests(found: DataFrame) -> DataFrame:
    return found.select(
        "doc_id",
        *[F.size(k).cast("long").alias(f"n_{k}") for k in KINDS[:3]],
        F.sha2(_joined(*KINDS[:3]).cast("binary"), 256).alias("base_sha256"),
        _joined(*KINDS).alias("spans"),
        F.size("entropy").cast("long").alias("n_entropy"),
    )
