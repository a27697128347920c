"""Chat formatting with Spark expressions only.

Each conversation's turns are collected as structs, sorted, cut into runs of
one role, and concatenated. The template is

    <s>  then per run   [INST] body [/INST]            for role ``user``
                        [ROLE] role [/ROLE] body </s>  for any other role

(without the blanks), where the body joins the turns of the run by ``[TURN]``.
So adjacent turns of one role share one block, and the parse still gives every
turn back.

Escaping: a control string is a first character (``<`` or ``[``) and a rest.
Inside texts and role names, first + k backslashes + rest becomes first + (k+1)
backslashes + rest; reading back takes one away. An unescaped control string can
therefore never come from a text, and no rest contains a first character, so
nothing forms across a border.

Defined results: null text or role is the empty string; null ``turn`` sorts
first; turns of equal number are ordered by role, then text; repeated rows are
repeated turns; null ``conv_id`` is a conversation of its own; an empty table
gives no row; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BEGIN, END, TURN = "<s>", "</s>", "[TURN]"
USER_OPEN, USER_CLOSE, ROLE_OPEN, ROLE_CLOSE = "[INST]", "[/INST]", "[ROLE]", "[/ROLE]"
#: Code points that are looked through for the start of a span.
_CHUNK = 1024
_RESTS = r"(/?s>|/?INST\]|/?ROLE\]|TURN\])"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"([<\[])(\\*)" + _RESTS, r"$1$2\\$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"([<\[])\\(\\*)" + _RESTS, "$1$2$3")


def _runs(turns: Column) -> Column:
    """Adjacent turns of one role as struct(role, texts)."""
    size = F.size(turns)
    starts = F.filter(
        F.sequence(F.lit(0), size - 1),
        lambda i: (i == 0) | (F.get(turns, i)["role"] != F.get(turns, i - 1)["role"]),
    )
    ends = F.concat(F.slice(starts, F.lit(2), F.size(starts)), F.array(size))
    return F.transform(
        F.arrays_zip(starts.alias("start"), ends.alias("end")),
        lambda r: F.struct(
            F.get(turns, r["start"])["role"].alias("role"),
            F.transform(F.slice(turns, r["start"] + 1, r["end"] - r["start"]), lambda t: t["text"]).alias("texts"),
        ),
    )


def _pieces(run: Column) -> Column:
    """The texts of a run as they are written, each with what stands before and after it."""
    user = run["role"] == "user"
    opening = F.when(user, USER_OPEN).otherwise(F.concat(F.lit(ROLE_OPEN), escape(run["role"]), F.lit(ROLE_CLOSE)))
    closing = F.when(user, USER_CLOSE).otherwise(END)

    def piece(text: Column, i: Column) -> Column:
        lead, tail = F.when(i == 0, opening).otherwise(TURN), F.when(i == F.size(run["texts"]) - 1, closing).otherwise("")
        return F.struct(run["role"].alias("role"), lead.alias("lead"), escape(text).alias("text"), tail.alias("tail"))

    return F.transform(run["texts"], piece)


def format_conversations(turns: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """One row per conversation: ``conv_id``, ``formatted`` and ``loss_mask``
    (spans, in code points, of the texts that a trainer takes the loss on).

    A conversation is one output row, so its turns meet in one row by the
    nature of the result; conversations are spread by ``conv_id``. Where each text stands is a running sum of
    lengths, over the turns that are apart for that and are put together again on the same machine; all steps grow with the turns in proportion.
    """
    one = F.struct(
        F.col("turn").alias("turn"),
        F.coalesce(F.col("role"), F.lit("")).alias("role"),
        F.coalesce(F.col("text"), F.lit("")).alias("text"),
    )
    runs = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(one)).alias("turns"))
    pieces = runs.select("conv_id", F.posexplode(F.flatten(F.transform(_runs(F.col("turns")), _pieces))).alias("n", "piece"))
    length = F.length(F.concat("piece.lead", "piece.text", "piece.tail")).cast("long")
    before = Window.partitionBy("conv_id").orderBy("n").rowsBetween(Window.unboundedPreceding, -1)
    pieces = pieces.withColumn("at", F.coalesce(F.sum(length).over(before), F.lit(0)) + len(BEGIN) + F.length("piece.lead"))
    whole = pieces.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("n", "piece", "at"))).alias("rows"))
    mine = F.filter("rows", lambda r: r["piece"]["role"] == loss_role)
    return whole.select(
        "conv_id",
        F.concat(F.lit(BEGIN), F.array_join(F.transform("rows", lambda r: F.concat(r["piece"]["lead"], r["piece"]["text"], r["piece"]["tail"])), "")).alias("formatted"),
        F.transform(mine, lambda r: F.struct(r["at"].cast("long").alias("start"), F.length(r["piece"]["text"]).cast("long").alias("length"))).alias("loss_mask"),
    )


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), 0)


def parse_formatted(formatted: Column) -> Column:
    """The turns of a formatted text, as an array of struct(role, text)."""
    blocks = F.regexp_extract_all(
        F.substring(formatted, len(BEGIN) + 1, 2**31 - 1),
        F.lit(r"(?s)\[INST\].*?\[/INST\]|\[ROLE\].*?</s>"),
        F.lit(0),
    )

    def turns(block: Column) -> Column:
        user = F.startswith(block, F.lit(USER_OPEN))
        end = F.when(user, F.lit(len(USER_OPEN))).otherwise(F.locate(ROLE_CLOSE, block) + len(ROLE_CLOSE) - 1)
        closing = F.when(user, F.lit(len(USER_CLOSE))).otherwise(len(END))

        def cut(at: Column) -> Column:
            """The role and the body of a block whose body begins after ``at`` code points."""
            role = F.when(user, F.lit("user")).otherwise(unescape(F.substring(block, F.lit(len(ROLE_OPEN) + 1), at - len(ROLE_OPEN + ROLE_CLOSE))))
            return F.struct(role.alias("role"), F.split(F.substring(block, at + 1, F.length(block) - at - closing), r"\[TURN\]", -1).alias("texts"))

        return _let(_let(end, cut), lambda x: F.transform(x["texts"], lambda t: F.struct(x["role"].alias("role"), unescape(t).alias("text"))))

    return F.flatten(F.transform(blocks, turns))


def loss_texts(formatted: Column, mask: Column) -> Column:
    """The unescaped texts under the loss mask, in order. The text is cut into chunks first, as a place in a long one takes a walk from its start."""

    def read(chunks: Column) -> Column:
        def text(s: Column) -> Column:
            end = s["start"] + s["length"]

            def part(c: Column) -> Column:
                low, high = F.greatest(s["start"], c * _CHUNK), F.least(end, (c + 1) * _CHUNK)
                return F.substring(F.get(chunks, c.cast("int")), (low - c * _CHUNK + 1).cast("int"), (high - low).cast("int"))

            held = F.sequence(F.floor(s["start"] / _CHUNK), F.floor((end - 1) / _CHUNK))
            return F.when(s["length"] == 0, "").otherwise(unescape(F.array_join(F.transform(held, part), "")))

        return F.transform(mask, text)

    return _let(F.regexp_extract_all(formatted, F.lit(f"(?s).{{1,{_CHUNK}}}"), F.lit(0)), read)
