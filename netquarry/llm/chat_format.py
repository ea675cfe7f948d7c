"""Chat formatting with a grammar round trip, in built-in functions only.

    conversation := turn*          turn := "[INST]" role "[/INST]" text "</s>"

The grammar is strict: a control string at any other place is an error. A turn is rendered as it is and read back
by the parser, which always unescapes; where role or text does not come back identical, the turn is rendered escaped
("&", "[" and "<" become character references), which always comes back identical. The loss mask covers the texts of
assistant turns.

Edge cases: null role or text is empty; null turns sort first; ties sort by role, then text, and repeated rows stay
repeated turns; rows with a null conv_id form one conversation; no rows give no conversations; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netquarry.llm.arrays import bound, running_sum

OPEN, BODY, CLOSE = "[INST]", "[/INST]", "</s>"
TRAINED = "assistant"


def _replace(c: Column, old: str, new: str) -> Column:
    return F.replace(c, F.lit(old), F.lit(new))


def escape(c: Column) -> Column:
    return _replace(_replace(_replace(c, "&", "&amp;"), "[", "&#91;"), "<", "&lt;")


def unescape(c: Column) -> Column:
    return _replace(_replace(_replace(c, "&lt;", "<"), "&#91;", "["), "&amp;", "&")


def _has_control(c: Column) -> Column:
    return F.contains(c, F.lit(OPEN)) | F.contains(c, F.lit(BODY)) | F.contains(c, F.lit(CLOSE))


def render(role: Column, text: Column) -> Column:
    return F.concat(F.lit(OPEN), role, F.lit(BODY), text, F.lit(CLOSE))


def parse_turn(segment: Column) -> Column:
    """struct(role, raw, text) of a turn without its closing string; null where it breaks the grammar."""
    inner = F.substr(segment, F.lit(len(OPEN) + 1))
    parts = F.split(inner, r"\[/INST\]", -1)
    role, raw = F.get(parts, F.lit(0)), F.get(parts, F.lit(1))
    fits = F.startswith(segment, F.lit(OPEN)) & (F.size(parts) == 2) & ~_has_control(role) & ~_has_control(raw)
    return F.when(fits, F.struct(unescape(role).alias("role"), raw.alias("raw"), unescape(raw).alias("text")))


def parse(formatted: Column) -> Column:
    """Turns of a formatted conversation; a null element is a breach of the grammar."""
    segments = F.split(formatted, CLOSE, -1)
    return F.transform(F.slice(segments, 1, F.size(segments) - 1), parse_turn)


def _safe_turn(role: Column, text: Column) -> Column:
    alone = F.split(render(role, text), CLOSE, -1)
    back = parse_turn(F.get(alone, F.lit(0)))
    same = (F.size(alone) == 2) & (back["role"] == role) & (back["text"] == text)
    return F.when(F.coalesce(same, F.lit(False)), render(role, text)).otherwise(render(escape(role), escape(text)))


def format_chats(conversations: DataFrame) -> DataFrame:
    """conv_id, formatted, turns (parsed back), loss_spans (start, end in code points of formatted), round_trip."""
    rows = conversations.select("conv_id", "turn", F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumn("rendered", _safe_turn(F.col("role"), F.col("text")))
    grouped = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text", "rendered"))).alias("source"))
    whole = grouped.select("conv_id", F.transform("source", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("source"), F.array_join(F.transform("source", lambda t: t["rendered"]), "").alias("formatted"))
    parsed = whole.withColumn("turns", parse(F.col("formatted")))
    segments = F.split("formatted", CLOSE, -1)
    sizes = F.transform(F.slice(segments, 1, F.size(segments) - 1), lambda x: (F.length(x) + len(CLOSE)).cast("long"))
    # Where a turn's segment ends, its closing string included, is a prefix sum.
    ends = F.transform(running_sum(sizes), lambda x: x - len(CLOSE))
    placed = F.zip_with("turns", ends, lambda t, end: F.when(t["role"] == TRAINED, F.struct((end - F.length(t["raw"])).cast("long").alias("start"), end.alias("end"))))
    spans = F.filter(placed, lambda x: x.isNotNull())
    same = F.transform("turns", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))) == F.col("source")
    return parsed.select("conv_id", "formatted", "turns", spans.alias("loss_spans"), F.coalesce(same, F.lit(False)).alias("round_trip"))


def chat_digests(formatted: DataFrame) -> DataFrame:
    """The digest columns, all read back from the formatted text: turns by the parser, the loss by its spans."""
    turns = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    # What the loss mask covers is cut from the formatted text by its spans, one character an element.
    masked = bound(F.split("formatted", ""), lambda chars: F.transform("loss_spans", lambda x: F.array_join(F.slice(chars, (x["start"] + 1).cast("int"), (x["end"] - x["start"]).cast("int")), "")))
    loss = F.array_join(F.transform(masked, unescape), "")
    return formatted.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(turns.cast("binary"), 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss.cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        F.size("loss_spans").cast("long").alias("n_loss_spans"),
        "round_trip",
    )
