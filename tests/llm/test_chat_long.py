"""Long conversations: whole round trips, spans across chunks, and work that follows the turns."""

from __future__ import annotations

import time

import pytest
from pyspark.sql import functions as F

from trustloom.llm.chat_format import format_conversations, loss_texts, parse_formatted


def conversation(spark, n: int, alternate: bool):
    role = F.when((F.col("id") % 2 == 0) & F.lit(alternate), "user").otherwise("assistant")
    text = F.concat(F.repeat(F.lit("é[INST] 😀 "), (F.col("id") % 7).cast("int")), F.when(F.col("id") % 50 == 0, F.repeat(F.lit("long "), 900)).otherwise(F.col("id").cast("string")))
    return spark.range(n).select(F.lit(None).cast("long").alias("conv_id"), F.col("id").alias("turn"), role.alias("role"), F.when(F.col("id") % 11 != 3, text).alias("text"))


@pytest.mark.parametrize("alternate", [True, False])
def test_long_conversation_round_trip(spark, alternate):
    turns = conversation(spark, 3000, alternate)
    done = format_conversations(turns)
    back = done.select(parse_formatted(F.col("formatted")).alias("turns"), loss_texts(F.col("formatted"), F.col("loss_mask")).alias("loss")).first()
    due = [(r["role"], r["text"] or "") for r in turns.orderBy("turn").collect()]
    assert [(t["role"], t["text"]) for t in back["turns"]] == due
    assert back["loss"] == [t for r, t in due if r == "assistant"]


def test_work_follows_the_turns(spark):
    """Eight times the turns take far less than 64 times as long, as they would if the work were quadratic."""

    def seconds(n: int) -> float:
        start = time.perf_counter()
        done = format_conversations(conversation(spark, n, True))
        done.select(F.size(parse_formatted(F.col("formatted"))), F.xxhash64(loss_texts(F.col("formatted"), F.col("loss_mask")))).collect()
        return time.perf_counter() - start

    seconds(1000)
    assert seconds(40_000) < 20 * seconds(5_000)
