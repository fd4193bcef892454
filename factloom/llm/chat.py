"""Chat formatting with Spark expressions only.

A conversation becomes one string of turns::

    ### role: text<part/>text</turn>\\n

Adjacent turns of one role are merged into one marked turn whose parts stay apart by ``<part/>``, so
the rows can be read back.  Inside texts a backslash becomes two, and the first character of a control
string (``### ``, ``</turn>``, ``<part/>``) becomes a letter code, so no control string is left in a
text.  The loss mask is a run-length list over the code points of the output.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPEN, CLOSE, PART = "### ", "</turn>\n", "<part/>"


def escape(text: Column) -> Column:
    doubled = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    hashes = F.regexp_replace(doubled, "#(?=## )", "\\\\h")
    return F.regexp_replace(hashes, "<(?=/turn>|part/>)", "\\\\l")


def unescape(text: Column) -> Column:
    """Inverse of :func:`escape` and of the colon code in roles; one pass decides each backslash.

    Doubled backslashes are split off first, so that a code is never read across them.
    """
    pieces = F.split(text, "\\\\\\\\", -1)
    plain = F.transform(
        pieces,
        lambda p: F.replace(
            F.replace(F.replace(p, F.lit("\\h"), F.lit("#")), F.lit("\\l"), F.lit("<")), F.lit("\\c"), F.lit(":")
        ),
    )
    return F.array_join(plain, "\\")


def format_chat(
    turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
    loss_role: str = "assistant",
) -> DataFrame:
    """One row per conversation: ``conv``, ``formatted``, ``loss_mask``.

    ``loss_mask`` is array<struct<chars int, loss boolean>>: runs that add up to the code points of
    ``formatted``.  Null text or role count as empty; rows with equal turn numbers are ordered by role and
    text and all kept; a null conversation id is a conversation of its own; an empty table gives no
    rows; other columns are ignored.
    """
    src = turns.select(
        F.col(conv).alias("_conv"),
        F.struct(
            F.col(turn).alias("t"),
            F.coalesce(F.col(role), F.lit("")).alias("r"),
            F.coalesce(F.col(text), F.lit("")).alias("x"),
        ).alias("_turn"),
    )
    rows = src.groupBy("_conv").agg(F.sort_array(F.collect_list("_turn")).alias("_turns"))

    def marks(t: Column, i: Column) -> Column:
        before = F.get(F.col("_turns"), i - 1)["r"]
        head = F.concat(F.lit(OPEN), F.replace(escape(t["r"]), F.lit(":"), F.lit("\\c")), F.lit(": "))
        mark = (
            F.when(i == 0, head).when(before == t["r"], F.lit(PART)).otherwise(F.concat(F.lit(CLOSE), head))
        )
        return F.struct(mark.alias("mark"), escape(t["x"]).alias("body"), (t["r"] == loss_role).alias("loss"))

    segs = rows.select("_conv", F.transform("_turns", marks).alias("_segs"))
    return segs.select(
        F.col("_conv").alias(conv),
        F.concat(
            F.array_join(F.transform("_segs", lambda s: F.concat(s["mark"], s["body"])), ""), F.lit(CLOSE)
        ).alias("formatted"),
        F.concat(
            F.flatten(
                F.transform(
                    "_segs",
                    lambda s: F.array(
                        F.struct(F.char_length(s["mark"]).alias("chars"), F.lit(False).alias("loss")),
                        F.struct(F.char_length(s["body"]).alias("chars"), s["loss"].alias("loss")),
                    ),
                )
            ),
            F.array(F.struct(F.lit(len(CLOSE)).alias("chars"), F.lit(False).alias("loss"))),
        ).alias("loss_mask"),
    )


def read_chat(formatted: DataFrame, conv: str = "conv_id", column: str = "formatted") -> DataFrame:
    """Read the rows back from the formatted strings: ``conv``, ``turns`` array<struct<role, text>>."""
    closed = F.transform(
        F.filter(F.split(F.col(column), CLOSE, -1), lambda t: t != ""),
        lambda t: F.struct(
            F.substring_index(F.substr(t, F.lit(len(OPEN) + 1)), ": ", 1).alias("r"),
            F.substr(t, F.instr(t, ": ") + 2).alias("b"),
        ),
    )
    turns = F.flatten(
        F.transform(
            closed,
            lambda t: F.transform(
                F.split(t["b"], PART, -1), lambda p: F.struct(unescape(t["r"]).alias("role"), unescape(p).alias("text"))
            ),
        )
    )
    return formatted.select(F.col(conv), turns.alias("turns"))


def loss_text(formatted: str = "formatted", loss_mask: str = "loss_mask") -> Column:
    """What lies under the mask: its runs with loss are cut out of the formatted string by running offsets, unescaped and joined."""
    none = F.array().cast("array<struct<at:int,chars:int>>")
    runs = F.aggregate(
        loss_mask,
        F.struct(F.lit(0).alias("at"), none.alias("runs")),
        lambda a, m: F.struct(
            (a["at"] + m["chars"]).alias("at"),
            F.when(m["loss"], F.concat(a["runs"], F.array(F.struct(a["at"].alias("at"), m["chars"].alias("chars")))))
            .otherwise(a["runs"]).alias("runs"),
        ),
        lambda a: a["runs"],
    )
    return F.array_join(F.transform(runs, lambda r: unescape(F.substr(F.col(formatted), r["at"] + 1, r["chars"]))), "")
