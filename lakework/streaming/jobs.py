"""Small checkpointed streaming jobs."""

from __future__ import annotations

import json
from collections.abc import Callable, Mapping

from pyspark.errors import StreamingQueryException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from lakework.operators.relational import cast_kv

# How sources word a position that is gone.
_OUT_OF_RANGE = ("offset out of range", "offsetoutofrange", "offsets out of range", "cannot fetch offset")


def starting_offsets(topic: str, offset: str | int | Mapping[int, int] | None, partitions: int = 1) -> str:
    """Start of a subscription: earliest, latest, a number for all of ``partitions``, or one for each.

    A topic wants a position for every partition it has.
    """
    if isinstance(offset, Mapping):
        return json.dumps({topic: {str(p): int(n) for p, n in sorted(offset.items())}})
    if offset is None:
        return "latest"
    text = str(offset).strip()
    if text in ("earliest", "latest"):
        return text
    if not text.lstrip("-").isdigit():
        raise ValueError(f"offset must be earliest, latest or a number, not {offset!r}")
    return json.dumps({topic: {str(p): int(text) for p in range(partitions)}})


def read_stream(
    spark: SparkSession, fmt: str, path: str | None = None, schema: T.StructType | str | None = None, **options: str
) -> DataFrame:
    """A streaming source of any format with its options."""
    reader = spark.readStream.format(fmt).options(**options)
    if schema is not None:
        reader = reader.schema(schema)
    return reader.load(path) if path else reader.load()


def subscribe(
    spark: SparkSession,
    servers: str,
    topic: str,
    offset: str | int | Mapping[int, int] | None = None,
    max_per_trigger: int | None = None,
    partitions: int = 1,
) -> DataFrame:
    """A topic as a stream; needs the Kafka connector on the classpath.

    Without ``max_per_trigger`` a batch takes all that has come, so that no lag builds up.
    """
    limit = {} if max_per_trigger is None else {"maxOffsetsPerTrigger": str(max_per_trigger)}
    return read_stream(
        spark,
        "kafka",
        **{
            "kafka.bootstrap.servers": servers,
            "subscribe": topic,
            "startingOffsets": starting_offsets(topic, offset, partitions),
            **limit,
        },
    )


def kv_stream(source: DataFrame) -> DataFrame:
    """Key and value of a stream as text."""
    return cast_kv(source).select("key", "value")


def trigger_of(interval: str | None) -> Mapping[str, object]:
    """A fixed interval such as ``60 seconds``, or None to read what is there and stop."""
    return {"processingTime": interval} if interval else {"availableNow": True}


def append_to(
    stream: DataFrame, fmt: str, checkpoint: str | None, path: str | None = None, interval: str | None = None, **options
) -> StreamingQuery:
    """Append a stream to a sink: console, a file format, memory."""
    writer = stream.writeStream.format(fmt).outputMode("append").options(**options).trigger(**trigger_of(interval))
    if checkpoint:
        writer = writer.option("checkpointLocation", checkpoint)
    return writer.start(path) if path else writer.start()


def per_batch(
    stream: DataFrame,
    summarize: Callable[[DataFrame], DataFrame],
    sink: str,
    checkpoint: str,
    interval: str | None = None,
) -> StreamingQuery:
    """Write one summary per micro-batch to ``sink/batch_id=N``.

    A replayed batch writes its own folder again, and the position is committed only
    after the write, so each batch counts once whatever fails in between.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        summarize(batch).write.mode("overwrite").parquet(f"{sink}/batch_id={batch_id}")

    return (
        stream.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(**trigger_of(interval))
        .start()
    )


def batch_counts(stream: DataFrame, sink: str, checkpoint: str, interval: str | None = None) -> StreamingQuery:
    """Number of records of each micro-batch."""
    return per_batch(stream, lambda batch: batch.agg(F.count("*").alias("n")), sink, checkpoint, interval)


def batch_distinct_lengths(
    stream: DataFrame, value: str, sink: str, checkpoint: str, interval: str | None = None
) -> StreamingQuery:
    """Number of distinct text lengths in each micro-batch."""
    lengths = F.count_distinct(F.length(F.col(value))).alias("n_lengths")
    return per_batch(stream, lambda batch: batch.agg(lengths), sink, checkpoint, interval)


def run_with_recovery(start: Callable[[str | None], StreamingQuery], restarts: int = 10) -> StreamingQuery:
    """Run a stream to its end; when its position is gone, start again from the earliest.

    ``start`` gets None for the configured position, then ``earliest``. Any other
    failure ends the job.
    """
    offset = None
    for _ in range(restarts + 1):
        query = start(offset)
        try:
            query.awaitTermination()
            return query
        except StreamingQueryException as error:
            text = str(error).lower()
            if not any(words in text for words in _OUT_OF_RANGE):
                raise
            offset = "earliest"
    raise RuntimeError(f"the position was lost {restarts + 1} times")
