"""Winning changes of a stream: Spark's own keyed state remembers the last change of each key.

A change wins if its order lies above that of every change of its key so far, in whatever batch
those came. The state of a key is its last winner, so a record that comes late neither overwrites a
newer one nor brings a deleted key back. It is a streaming aggregate, so no row passes through
Python. What wins is appended to plain files: the last winner of a key, unless it is a delete, is
the key's row.
"""

from __future__ import annotations

import threading
from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lakework.operators.changes import DELETED, ORDER_COLUMNS, latest_per_key
from lakework.streaming.jobs import trigger_of

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_QUERY, _BATCH = "_query", "_batch"  # folders of the files


def winning_changes(stream: DataFrame, key: Sequence[str], order: Sequence[str] = ORDER_COLUMNS) -> DataFrame:
    """The changes of a stream that win, with their own columns; NULL counts as a key, a change with a NULL order never wins.

    A change with an order that was there before does not win, so replayed records come out once, and of
    a batch each key has one winner at most. The result is written in ``update`` mode. The state holds the
    last winner of every key that was ever seen, deleted ones among them. Whether it came with this batch
    is told by the time of its batch, which the checkpoint keeps; the driver's clock may not go back.
    """
    rest = [c for c in stream.columns if c not in key]
    now = F.unix_millis(F.current_timestamp())  # one value a batch, the same when it is replayed
    whole = reduce(and_, [F.col(c).isNotNull() for c in order])
    # Of equal orders the one of the earlier batch stays.
    last = F.max_by(F.struct(*rest, "_at"), F.struct(*order, -F.col("_at")))
    held = stream.where(whole).withColumn("_at", now).groupBy(*key).agg(last.alias("_held"))
    won = held.where(F.col("_held._at") == now)
    return won.select(*key, *[F.col("_held")[c].alias(c) for c in rest]).select(*stream.columns)


def append_winners(
    stream: DataFrame, path: str, checkpoint: str, key: Sequence[str], order: Sequence[str] = ORDER_COLUMNS, interval: str | None = None,
) -> StreamingQuery:
    """Append the winning changes of a stream to parquet files; the state lives beside the stream's positions.

    Every batch writes a folder of its own, told by the query, whose id is new with every checkpoint, and
    its number; a replayed batch writes its folder again.
    """
    spark = stream.sparkSession
    started, query_id = threading.Event(), []

    def write(batch: DataFrame, batch_id: int) -> None:
        started.wait()
        batch.write.mode("overwrite").parquet(f"{path.rstrip('/')}/{_QUERY}={query_id[0]}/{_BATCH}={batch_id}")

    before = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, _ROCKS)  # a query keeps what holds at its start
    try:
        query = (
            winning_changes(stream, key, order).writeStream.foreachBatch(write).outputMode("update")
            .option("checkpointLocation", checkpoint).trigger(**trigger_of(interval)).start()
        )
    finally:
        spark.conf.set(_PROVIDER, before) if before else spark.conf.unset(_PROVIDER)
    query_id.append(str(query.id))
    started.set()
    return query


def current_rows(spark: SparkSession, path: str, key: Sequence[str], order: Sequence[str] = ORDER_COLUMNS, deleted: str = DELETED) -> DataFrame:
    """The rows that appended winners leave: of each key the last one, unless it is a delete."""
    winners = spark.read.parquet(path).drop(_QUERY, _BATCH)
    return latest_per_key(winners, key, order).where(~F.col(deleted)).drop(*order, deleted)
