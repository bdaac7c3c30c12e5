r"""Chat formatting by a grammar round trip [native].

    conversation = turn*
    turn         = "[INST]" role "\n" text "[/INST]"     every role but assistant
                 | "<s>" text "</s>"                     assistant

Texts hold no control strings. One that does, or that the grammar would misread, has a backslash put behind the first
character of each control string, and of each control string already escaped,
so removing one backslash from each gives the text back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CONTROL = r"/?INST\]|/?s>"
TURN = r"\[INST\][^\n]*\n(?s:.*?)\[/INST\]|<s>(?s:.*?)</s>"
SPLIT_CASE = -7
RUN = 1024


def escape(text: Column) -> Column:
    return F.regexp_replace(text, rf"([\[<])(\\*(?:{CONTROL}))", r"$1\\$2")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, rf"([\[<])\\(\\*(?:{CONTROL}))", "$1$2")


def escape_role(role: Column) -> Column:
    return escape(F.replace(F.replace(role, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n")))


def unescape_role(role: Column) -> Column:
    # a doubled backslash is a backslash, any other marks a newline: cut at the doubled ones first
    parts = F.split(unescape(role), r"\\\\", -1)
    return F.array_join(F.transform(parts, lambda p: F.replace(p, F.lit("\\n"), F.lit("\n"))), "\\")


def render(turns: Column, escaped: bool) -> Column:
    """The formatted text of an array of `struct<role, text>`."""

    def one(t: Column) -> Column:
        text = escape(t["text"]) if escaped else t["text"]
        other = F.concat(F.lit("[INST]"), escape_role(t["role"]), F.lit("\n"), text, F.lit("[/INST]"))
        return F.when(t["role"] == "assistant", F.concat(F.lit("<s>"), text, F.lit("</s>"))).otherwise(other)

    return F.array_join(F.transform(turns, one), "")


def parse(formatted: Column) -> Column:
    """Turns read back by the grammar; null when text is outside any turn or a control string inside one."""

    def one(m: Column) -> Column:
        cut = F.instr(m, F.lit("\n"))
        role = F.when(F.startswith(m, F.lit("<s>")), F.lit("assistant")).otherwise(
            unescape_role(F.substring(m, F.lit(7), cut - 7))
        )
        text = F.when(F.startswith(m, F.lit("<s>")), F.substring(m, F.lit(4), F.char_length(m) - 7)).otherwise(
            F.substring(m, cut + 1, F.char_length(m) - cut - 7)
        )
        return F.struct(role.alias("role"), unescape(text).alias("text"))

    found = F.regexp_extract_all(formatted, F.lit(TURN), F.lit(0))
    whole = F.char_length(F.array_join(found, "")) == F.char_length(formatted)
    marks = F.regexp_count(formatted, F.lit(r"\[/?INST\]|</?s>")) == 2 * F.size(found)
    return F.when(whole & marks, F.transform(found, one))


def _starts(lengths: Column) -> Column:
    """Sum of the lengths before each. Sums gather in short runs, so that appending stays cheap for many turns."""
    empty = F.struct(
        F.array().cast("array<array<bigint>>").alias("runs"), F.array().cast("array<bigint>").alias("run"), F.lit(0).cast("bigint").alias("sum")
    )

    def step(s: Column, n: Column) -> Column:
        full = F.size(s["run"]) >= RUN
        at = F.array(s["sum"])
        return F.struct(
            F.when(full, F.concat(s["runs"], F.array(s["run"]))).otherwise(s["runs"]).alias("runs"),
            F.when(full, at).otherwise(F.concat(s["run"], at)).alias("run"),
            (s["sum"] + n).alias("sum"),
        )

    return F.aggregate(lengths, empty, step, lambda s: F.flatten(F.concat(s["runs"], F.array(s["run"]))))


def loss_mask(formatted: Column) -> Column:
    """Spans `struct<start, length>` of `formatted` that a model learns, one per assistant turn, in bytes of its UTF-8 form.

    The marks around a turn are outside; escapes inside it are under the mask, as the model sees them.
    """
    found = F.regexp_extract_all(formatted, F.lit(TURN), F.lit(0))
    sizes = F.transform(found, lambda m: F.octet_length(m).cast("bigint"))

    def span(m: Column, at: Column) -> Column:
        return F.when(F.startswith(m, F.lit("<s>")), F.struct((at + 3).alias("start"), (F.octet_length(m) - 7).cast("bigint").alias("length")))

    return F.filter(F.zip_with(found, _starts(sizes), span), lambda s: s.isNotNull())


def under_mask(formatted: Column, mask: Column) -> Column:
    """The texts under each span of a mask, escapes removed."""
    # the bytes are taken once and each span copies only its own
    whole = F.array_repeat(formatted.cast("binary"), F.size(mask))
    return F.zip_with(
        mask, whole, lambda s, b: unescape(F.substring(b, (s["start"] + 1).cast("int"), s["length"].cast("int")).cast("string"))
    )


def format_chats(rows: DataFrame) -> DataFrame:
    """`(conv_id, formatted, turns, escaped, mask)`: one text per conversation that parses back to its turns.

    Turns are ordered by `turn` (null first), then role and text, so ties and
    repeated rows have one result. Null texts and roles are empty; a null
    conv_id is a conversation of its own. Extra columns are ignored; an empty
    table gives an empty table. A conversation is one row of the result, so
    its rows meet in one task.

    The plain rendering is parsed and compared with the source; where they
    differ the conflicting texts are escaped and the result is parsed again.
    A conversation that still differed would raise an error. `turns` are those
    read back; `mask` is the `loss_mask` of `formatted`.
    """
    turn = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    gathered = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("_rows"))
    source = F.transform("_rows", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text")))
    plain = gathered.select("conv_id", source.alias("_source")).withColumn("_plain", render(F.col("_source"), False))
    same = F.coalesce(parse(F.col("_plain")) == F.col("_source"), F.lit(False))
    chosen = plain.withColumn("escaped", ~same).withColumn(
        "formatted", F.when(F.col("escaped"), render(F.col("_source"), True)).otherwise(F.col("_plain"))
    )
    read = chosen.withColumn("turns", parse(F.col("formatted")))
    proven = F.when(F.col("turns").eqNullSafe(F.col("_source")), F.col("turns")).otherwise(
        F.raise_error(F.lit("a conversation does not survive its round trip"))
    )
    return read.select("conv_id", "formatted", proven.alias("turns"), "escaped", loss_mask(F.col("formatted")).alias("mask"))
