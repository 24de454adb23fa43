"""Chat formatting checked by a grammar round trip (operator 4). DataFrame functions only.

The grammar, with one control string for each token:

    conversation = turn*
    turn         = "<s>" level name "[INST]" text "[/INST]" "</s>"
    level        = "0" | "1" | "2"

name and text hold no control string as they stand. Level 0 is plain. At level 1 each control string
is broken by a backslash after its first character. At level 2 backslashes are doubled first. The
parser splits at the control strings and undoes what the level says, so it is deterministic. Each turn is
rendered at level 0, reparsed and compared with its source; what differs is escaped one level
further until the two are identical. Level 2 always is: it leaves no control string, and undoing
it reads each backslash with the character after it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

#: The template's control strings.
CONTROL = ("<s>", "</s>", "[INST]", "[/INST]")


def escape(text: Column, level: int) -> Column:
    if level == 2:
        text = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    if level >= 1:
        for x in CONTROL:
            text = F.replace(text, F.lit(x), F.lit(x[0] + "\\" + x[1:]))
    return text


def unescape(text: Column, level: Column) -> Column:
    """What the parser makes of a text at a level that it has read."""
    plain = text
    broken = text
    for x in CONTROL:
        broken = F.replace(broken, F.lit(x[0] + "\\" + x[1:]), F.lit(x))
    # one pass from the left: a backslash stands for what follows it
    full = F.regexp_replace(text, r"(?s)\\(.)", "$1")
    return F.when(level == "2", full).when(level == "1", broken).otherwise(plain)


def render(role: Column, text: Column, level: int | Column) -> Column:
    if isinstance(level, int):
        return F.concat(F.lit(f"<s>{level}"), escape(role, level), F.lit("[INST]"), escape(text, level), F.lit("[/INST]</s>"))
    return F.when(level == 0, render(role, text, 0)).when(level == 1, render(role, text, 1)).otherwise(render(role, text, 2))


def parse(formatted: Column) -> Column:
    """Formatted conversation to its turns, an array of struct<role, text>; text that isn't of the
    grammar gives turns that differ from any source."""
    pieces = F.split(formatted, "</s>", -1)

    def turn(piece: Column) -> Column:
        body = F.substring(piece, 5, 2**31 - 1)
        level = F.substring(piece, 4, 1)
        parts = F.split(body, r"\[INST\]", -1)
        good = piece.startswith("<s>") & piece.endswith("[/INST]") & (F.size(parts) == 2) & ~body.contains("<s>")
        text = F.regexp_replace(F.element_at(parts, 2), r"\[/INST\]$", "")
        good = good & ~text.contains("[/INST]") & ~F.element_at(parts, 1).contains("[/INST]")
        return F.when(good, F.struct(unescape(F.element_at(parts, 1), level).alias("role"), unescape(text, level).alias("text")))

    # every turn ends in </s>, so the last piece is empty
    return F.transform(F.slice(pieces, 1, F.greatest(F.size(pieces) - 1, F.lit(0))), turn)


def _survives(role: Column, text: Column, level: int) -> Column:
    """The turn alone, rendered at this level, is parsed as itself and nothing more."""
    back = parse(render(role, text, level))
    return F.coalesce((F.size(back) == 1) & (back[0]["role"] == role) & (back[0]["text"] == text), F.lit(False))


def format_conversations(turns: DataFrame, learned: str = "assistant") -> DataFrame:
    """turns (conv_id, turn, role, text) to one row per conv_id: conv_id, formatted, loss (the spans [start, end) of formatted, in characters, that
    are texts of the role `learned`, with the level they are escaped at), recovered (the turns that the parser reads back
    from formatted) and identical (they equal the source).

    Turns go by `turn`; equal numbers by role and text. Null text, or role: empty. Null turn: first. Null conv_id: all such rows are one conversation
    of their own. Repeated rows: turns of their own. Other columns are ignored. An empty table gives
    an empty result. A conversation is one output row, so its turns, very long ones too, meet in one task.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    source = turns.select("conv_id", F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"))
    level = F.when(_survives(F.col("role"), F.col("text"), 0), 0).when(_survives(F.col("role"), F.col("text"), 1), 1).otherwise(2)
    source = source.withColumn("level", level)
    source = source.withColumn("rendered", render(F.col("role"), F.col("text"), F.col("level")))
    # where the text of a turn ends: before the [/INST]</s> that closes it
    so_far = Window.partitionBy("conv_id").orderBy("turn", "role", "text").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    source = source.withColumn("end", F.sum(F.char_length("rendered")).over(so_far) - len(CONTROL[3] + CONTROL[1]))
    escaped = F.when(F.col("level") == 0, F.col("text")).when(F.col("level") == 1, escape(F.col("text"), 1)).otherwise(escape(F.col("text"), 2))
    source = source.withColumn("start", F.col("end") - F.char_length(escaped))
    whole = source.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text", "end", "start", "level", "rendered"))).alias("turns"))
    # control strings can't arise across turns: each begins and ends with a whole one; read back all the same
    whole = whole.withColumn("formatted", F.concat_ws("", F.col("turns.rendered")))
    loss = F.transform(F.filter("turns", lambda t: t["role"] == learned), lambda t: F.struct(t["start"].alias("start"), t["end"].alias("end"), t["level"].alias("level")))
    whole = whole.select("conv_id", "formatted", loss.alias("loss"), parse(F.col("formatted")).alias("recovered"), "turns")
    same = F.coalesce(F.col("recovered") == F.transform("turns", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))), F.lit(False))
    return whole.select("conv_id", "formatted", "loss", "recovered", same.alias("identical"))


def under_loss(formatted: Column, loss: Column) -> Column:
    """The texts under the loss spans, cut from formatted and unescaped, one after the other."""
    return F.concat_ws("", F.transform(loss, lambda s: unescape(F.substring(formatted, (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int")), s["level"].cast("string"))))


def with_conflicts(turns: DataFrame) -> DataFrame:
    """turns and conversation -1, whose texts are made of control strings."""
    said = "</s>[INST] ok [/INST]"
    kinds = {f.name: f.dataType for f in turns.schema.fields}
    rows = turns.sparkSession.range(2).select(F.lit(-1).cast(kinds["conv_id"]).alias("conv_id"), F.col("id").cast(kinds["turn"]).alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    return turns.select("conv_id", "turn", "role", "text").unionByName(rows)


def digest(formatted: DataFrame) -> DataFrame:
    """The columns of the query, all read back from the formatted text."""
    told = F.concat_ws("", F.transform("recovered", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))))
    loss = under_loss(F.col("formatted"), F.col("loss"))
    return formatted.select(
        "conv_id",
        F.size("recovered").cast("long").alias("n_turns"),
        F.sha2(told.cast("binary"), 256).alias("turns_sha256"),
        F.char_length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss.cast("binary"), 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
    )
