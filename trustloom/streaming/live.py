"""Replay detection as a live stream with state of its own: each nonce's last use, forgotten by an event-time timer.

Unlike dropping repeats, this gives every replay with the time since the use before it, as the batch check does. The state is a time for each
nonce of the last ``hours`` hours. Nonces are held in buckets, by hash, as a call for each nonce costs more than all else: a bucket's state is read and written once
in a micro-batch, without the nonces whose horizon the watermark has passed, and a timer clears it when that of its newest use has. A micro-batch may bring its rows in any order.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from trustloom.operators.provenance import HORIZON_HOURS, NONCE

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def rocksdb(spark: SparkSession):
    """Streams started inside keep their state in RocksDB, which timers need."""
    before = spark.conf.get(_PROVIDER)
    spark.conf.set(_PROVIDER, _ROCKSDB)
    try:
        yield
    finally:
        spark.conf.set(_PROVIDER, before)


class LastUses(StatefulProcessor):
    """Of each nonce of a bucket the time of its last use, in microseconds."""

    def __init__(self, hours: int):
        self.horizon = hours * 3600

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "nonces array<string>, at array<bigint>, due bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        uses = pd.concat(list(rows))  # a bucket's rows of one micro-batch
        nonces, at, due = self.last.get() if self.last.exists() else ([], [], None)
        before = pd.DataFrame({"nonce": nonces, "at": at}, dtype=object).astype({"at": "int64"}).assign(event_id=-1, user_id=-1, new=False)
        both = pd.concat([before, uses[["nonce", "at", "event_id", "user_id"]].assign(new=True)], ignore_index=True)
        both["nonce"], names = pd.factorize(both["nonce"])
        both = both.sort_values(["nonce", "at", "new", "event_id"], kind="stable")
        same = both["nonce"].eq(both["nonce"].shift())
        seconds = (both["at"] - both["at"].shift(fill_value=0)) // 1_000_000
        found = both.assign(seconds=seconds)[both["new"] & same & (seconds < self.horizon)]
        # what no later event can replay goes
        kept = both[both["nonce"].ne(both["nonce"].shift(-1))]
        kept = kept[kept["at"] // 1000 + self.horizon * 1000 >= timerValues.getCurrentWatermarkInMs()]
        if len(kept):
            until = int(kept["at"].max()) // 1000 + self.horizon * 1000 + 1
            if until != due:
                if due is not None:
                    self.handle.deleteTimer(due)
                self.handle.registerTimer(until)
            self.last.update((names[kept["nonce"]].tolist(), kept["at"].tolist(), until))
        elif due is not None:
            self.handle.deleteTimer(due)
            self.last.clear()
        if len(found):
            yield found[["event_id", "user_id", "seconds"]].astype("int64")

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.last.clear()
        yield from ()

    def close(self) -> None:
        pass


def live_replays(events: DataFrame, hours: int = HORIZON_HOURS, buckets: int = 1024) -> DataFrame:
    """``event_id``, ``user_id`` and ``seconds`` since the use before of each event whose nonce was used within ``hours`` before it.

    ``events`` is a stream with a timestamp ``ts``. Its watermark lags by ``hours``; what comes later than that is not looked at.
    """
    spark = events.sparkSession
    rows = events.withWatermark("ts", f"{hours} hours").withColumn("at", F.unix_micros("ts"))
    # null parts of a nonce are equal to each other, as in the batch check
    bucket = F.pmod(F.xxhash64(*NONCE), F.lit(buckets)).cast("int").alias("bucket")
    keyed = rows.select("event_id", "user_id", "ts", "at", bucket, F.to_json(F.struct(*NONCE)).alias("nonce"))
    with rocksdb(spark):
        return keyed.groupBy("bucket").transformWithStateInPandas(LastUses(hours), "event_id bigint, user_id bigint, seconds bigint", "Append", "EventTime")
