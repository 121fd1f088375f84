r"""Chat formatting with a grammar round trip, in built-in functions only.

A turn renders as ``<s>[INST]`` role ``[/INST]`` text ``</s>``.  The control
strings are those four.  A role or text is first taken as it is; if the
deterministic parser would not give it back, it is escaped: each control string
in it, with any backslashes after its first character, gets one more backslash
there (``<s>`` becomes ``<\s>``, ``<\s>`` becomes ``<\\s>``).  The parser cuts at
``</s>``, then at the first ``[/INST]``, and takes one such backslash away, so
escaping once always gives identity; the recovered turns are compared with the
source once more for the whole conversation (``round_trip``).

The loss mask is a run-length list, one entry for each turn: characters to skip,
then characters to learn (the text of assistant turns), then to skip.

Turns are ordered by turn, then role, then text; nulls first.  A null role or
text counts as empty, a null conversation id as a conversation of its own;
repeated rows are repeated turns; an empty table gives no rows; texts of any
length are kept whole; other columns are not read, whatever their names.  One row
holds a whole conversation, since its digest and its rendered text are single
values.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPEN, MIDDLE, CLOSE = "<s>[INST]", "[/INST]", "</s>"
LEARNED_ROLE = "assistant"
_CONTROL = r"([<\[])(\\*)(/?(?:s>|INST\]))"
_ESCAPED = r"([<\[])\\(\\*)(/?(?:s>|INST\]))"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, _CONTROL, r"$1\\$2$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, _ESCAPED, "$1$2$3")


def render(role: Column, text: Column) -> Column:
    return F.concat(F.lit(OPEN), role, F.lit(MIDDLE), text, F.lit(CLOSE))


def fitted(text: Column) -> Column:
    """The text itself where the parser gives it back unchanged, else its escaped form."""
    plain = (F.locate("<", text) == 0) & (F.locate("[", text) == 0)  # most texts: no pattern is tried
    conflicts = text.rlike(r"</?s>|\[/?INST\]") | (unescape(text) != text)
    return F.when(plain, text).when(conflicts, escape(text)).otherwise(text)


def parse(formatted: Column) -> Column:
    """Turns read back from rendered text, with the lengths of their parts."""
    pieces = F.split(formatted, CLOSE, -1)

    def turn(piece: Column) -> Column:
        body = F.substring(piece, len(OPEN) + 1, 2147483647)
        cut = F.locate(MIDDLE, body)
        role, text = body.substr(F.lit(1), cut - 1), body.substr(cut + len(MIDDLE), F.char_length(body))
        return F.struct(unescape(role).alias("role"), unescape(text).alias("text"), (cut - 1 + len(OPEN + MIDDLE)).alias("head"), F.char_length(text).alias("body"))

    return F.transform(F.slice(pieces, 1, F.size(pieces) - 1), turn)


def format_conversations(turns: DataFrame, *, id_col="conv_id", turn_col="turn", role_col="role", text_col="text") -> DataFrame:
    """One row per conversation: rendered text, turns read back from it, loss mask, round-trip check."""
    rows = turns.select(
        F.col(id_col).alias("conv_id"),
        F.struct(F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col).cast("string"), F.lit("")).alias("role"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")).alias("t"),
    )
    source = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("source"))
    shown = source.withColumn("formatted", F.array_join(F.transform("source", lambda t: render(fitted(t["role"]), fitted(t["text"]))), ""))
    parsed = shown.withColumn("parsed", parse(F.col("formatted")))
    learned = lambda t: t["role"] == LEARNED_ROLE
    return parsed.select(
        "conv_id",
        "formatted",
        F.transform("parsed", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("turns"),
        F.transform("parsed", lambda t: F.struct((t["head"] + F.when(learned(t), 0).otherwise(t["body"])).alias("skip"), F.when(learned(t), t["body"]).otherwise(0).alias("learn"), F.lit(len(CLOSE)).alias("skip_after"))).alias("loss_mask"),
        (F.transform("parsed", lambda t: F.struct(t["role"], t["text"])) == F.transform("source", lambda t: F.struct(t["role"], t["text"]))).alias("round_trip"),
    )


def turns_text(turns: str) -> Column:
    """Role, newline, text, newline for each turn."""
    return F.array_join(F.transform(turns, lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")


def learned_text(formatted: str, loss_mask: str) -> Column:
    """All text under the loss mask, unescaped: cut out of the rendered text by the mask's counts.

    Each entry covers the characters up to and with its closing string; a mask
    that covers more or fewer is an error.
    """
    pieces = F.split(formatted, CLOSE, -1)
    size = F.col(loss_mask)["skip"], F.col(loss_mask)["learn"], F.col(loss_mask)["skip_after"]
    covered = F.aggregate(F.zip_with(F.zip_with(size[0], size[1], lambda a, b: a + b), size[2], lambda a, b: a + b), F.lit(0), lambda a, b: a + b)
    rows = F.zip_with(F.slice(pieces, 1, F.size(pieces) - 1), loss_mask, lambda piece, m: F.when(F.char_length(piece) + len(CLOSE) == m["skip"] + m["learn"] + m["skip_after"], unescape(F.substring(piece, m["skip"] + 1, m["learn"]))))
    wrong = F.raise_error(F.lit("the loss mask does not cover the rendered text")).cast("string")
    return F.when((covered == F.char_length(formatted)) & ~F.exists(rows, lambda x: x.isNull()), F.array_join(rows, "")).otherwise(wrong)
