"""The change-feed job: a stream of envelopes into upserted tables."""

from __future__ import annotations

import logging
import threading
import time
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark import StorageLevel, inheritable_thread_target
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from lakework.operators.changes import (
    ORDER_COLUMNS,
    TableShape,
    TypeOptions,
    decode_envelope,
    parse_decimal_defs,
    prepare,
    table_shapes,
    typed_rows,
)
from lakework.operators.upsert import COPY_ON_WRITE, drop_old_versions, sync_table, table_path, upsert_table
from lakework.session import drop_scratch, scratch_dir
from lakework.streaming.jobs import trigger_of

log = logging.getLogger(__name__)

REPORT_DDL = (
    "batch_id long, db string, table string, upserts long, deletes long, skipped boolean, compacted boolean, millis long"
)


@dataclass(frozen=True)
class CdcConfig:
    """Settings of the change-feed job."""

    base_path: str
    table_type: str = COPY_ON_WRITE
    compact_inline: bool = True
    max_delta_commits: int = 10
    ordering: str | None = None
    buckets: int = 16
    all_to_string: bool = False
    decimal_to_string: bool = False
    decimals: str = ""
    trigger: str | None = "60 seconds"
    drop_old_versions: bool = False  # only where no reader stays on an older version
    catalog_sync: bool = False
    catalog_db: str | None = None
    parallel_tables: int = 4
    report_path: str | None = None

    @property
    def types(self) -> TypeOptions:
        return TypeOptions(self.all_to_string, self.decimal_to_string, parse_decimal_defs(self.decimals))

    @classmethod
    def from_properties(cls, properties: dict[str, str]) -> CdcConfig:
        """Settings from text values; names are those of the fields."""
        casts = {"bool": lambda v: v.strip().lower() == "true", "int": int}
        given = {}
        for name, f in cls.__dataclass_fields__.items():
            if name in properties:
                given[name] = casts.get(str(f.type), str)(properties[name])
        return cls(**given)


_PART = "_part"
_TABLES_IN_MEMORY = 3  # so many tables filter the cached batch faster than it is written apart


def _part_of(db: Column, table: Column) -> Column:
    """A folder name for a table, whatever its name holds."""
    return F.sha1(F.concat(F.length(db).cast("string"), F.lit("/"), db, table))


def apply_batch(
    batch: DataFrame, batch_id: int, config: CdcConfig, value_col: str = "value", writer: str = "batches"
) -> DataFrame:
    """Write one batch of envelopes to its tables; gives a report row per table.

    The batch stays distributed: only the names and schemas of its tables reach the
    driver. Where it holds several tables, one pass parts it by table, and every table then
    reads its own rows alone.
    Tables are independent of each other, so several are written at a time.
    A failed write fails the batch. Records without a primary key are counted under
    the empty table name. ``writer`` names the sequence that the batch numbers belong to.
    """
    spark = batch.sparkSession
    decoded, parted = decode_envelope(batch, value_col).persist(StorageLevel.MEMORY_AND_DISK), None
    try:
        states, rejected = prepare(decoded)
        shapes = table_shapes(states, config.types)
        parted = scratch_dir(spark, "batch") if len(shapes) > _TABLES_IN_MEMORY else None
        if parted:
            states.withColumn(_PART, _part_of(F.col("db_name"), F.col("table_name"))).write.partitionBy(_PART).parquet(parted)
            by_table = spark.read.schema(T.StructType([*states.schema.fields, T.StructField(_PART, T.StringType())])).parquet(parted)

        def own(shape: TableShape) -> DataFrame:
            return by_table.where(F.col(_PART) == _part_of(F.lit(shape.db), F.lit(shape.table))) if parted else states

        def write(shape: TableShape) -> tuple:
            start = time.time()
            path = table_path(config.base_path, shape.db, shape.table)
            report = upsert_table(
                typed_rows(own(shape), shape, config.types), path, shape.pk, ORDER_COLUMNS,
                table_type=config.table_type, ordering=config.ordering, buckets=config.buckets,
                compact_inline=config.compact_inline, max_delta_commits=config.max_delta_commits,
                writer=writer, batch_id=batch_id,
            )
            if config.drop_old_versions:
                drop_old_versions(spark, path)
            if config.catalog_sync:
                try:
                    sync_table(spark, config.catalog_db or shape.db, shape.table, path)
                except Exception:  # noqa: BLE001 - the table is written; the catalog can follow later
                    log.exception("catalog sync of %s.%s failed", shape.db, shape.table)
            millis = int((time.time() - start) * 1000)
            return (batch_id, shape.db, shape.table, report.upserts, report.deletes, report.skipped, report.compacted, millis)

        with ThreadPoolExecutor(max_workers=config.parallel_tables) as pool:
            # The threads keep the job group of the stream, so stopping it stops their jobs.
            rows = list(pool.map(inheritable_thread_target(spark)(write), shapes))
        dropped = rejected.count()
    finally:
        decoded.unpersist()
        if parted:
            drop_scratch(spark, parted)
    if dropped:
        log.warning("batch %s: %s records without a primary key", batch_id, dropped)
        rows.append((batch_id, "", "", dropped, 0, True, False, 0))
    return spark.createDataFrame(rows, REPORT_DDL)


def run_cdc(
    source: DataFrame,
    config: CdcConfig,
    checkpoint: str,
    on_report: Callable[[DataFrame], None] | None = None,
) -> StreamingQuery:
    """Start the job on a stream with a ``value`` column of envelopes.

    Batches are numbered by the query, whose id is new with every checkpoint, so a second
    feed or a lost checkpoint starts a sequence of its own and loses nothing.
    """
    started, query_id = threading.Event(), []

    def handle(batch: DataFrame, batch_id: int) -> None:
        started.wait()
        report = apply_batch(batch, batch_id, config, writer=query_id[0])
        if config.report_path:
            report.write.mode("overwrite").parquet(f"{config.report_path}/query={query_id[0]}/batch={batch_id}")
        if on_report:
            on_report(report)

    query = (
        source.writeStream.foreachBatch(handle)
        .option("checkpointLocation", checkpoint)
        .trigger(**trigger_of(config.trigger))
        .start()
    )
    query_id.append(str(query.id))
    started.set()
    return query
