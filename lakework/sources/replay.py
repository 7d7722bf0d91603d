"""A replayable log as a Spark data source: numbered records in partitions, read by offsets.

A log is a folder: per partition a run of segments, parquet files of ``segment_records`` records each,
named by partition and segment, and ``_log.json`` beside them. Old segments may be removed, which
moves the earliest offset. The stream reader hands Spark partitions and offsets, so positions,
replays and recovery are Spark's; it begins at a start position, plans at most so many records a
trigger, and refuses offsets that are gone. Segments are read where the tasks run, through Arrow's
file systems.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from lakework.sources import hadoop

SCHEMA = "key binary, value binary, partition int, offset bigint, timestamp timestamp"
_COLUMNS = ["key", "value", "partition", "offset", "timestamp"]


def write_log(records: DataFrame, path: str, partition: Column, order: Column, segment_records: int = 10_000) -> None:
    """Number records per partition in an order, and store them as segments.

    ``records`` has ``key``, ``value`` (both as bytes) and ``timestamp``. The partitions are the
    units of order and of parallelism, as those of a topic.
    """
    placed = records.select("key", "value", "timestamp", partition.cast("int").alias("partition"), order.alias("_order"))
    numbered = placed.withColumn("offset", F.row_number().over(Window.partitionBy("partition").orderBy("_order")).cast("long") - 1)
    segments = numbered.drop("_order").withColumn("segment", F.floor(F.col("offset") / segment_records).cast("long"))
    dealt = segments.repartition("partition", "segment").sortWithinPartitions("partition", "segment", "offset")
    dealt.write.partitionBy("partition", "segment").parquet(path)
    hadoop.write_text_once(records.sparkSession, f"{path}/_log.json", json.dumps({"segment_records": segment_records}))


def drop_segments(spark: SparkSession, path: str, partition: int, before: int) -> int:
    """Remove the segments of a partition that lie wholly before an offset; gives their number."""
    size = json.loads(hadoop.read_text(spark, f"{path}/_log.json"))["segment_records"]
    place = f"{path}/partition={partition}"
    gone = [name for name in hadoop.list_names(spark, place) if name.startswith("segment=") and (int(name.split("=")[1]) + 1) * size <= before]
    for name in gone:
        hadoop.remove(spark, f"{place}/{name}")
    return len(gone)


class Log:
    """The segments of a log, as they are now."""

    def __init__(self, path: str) -> None:
        self.files, root = fs.FileSystem.from_uri(path) if ":" in path else (fs.LocalFileSystem(), path)
        self.root = root.rstrip("/")
        with self.files.open_input_stream(f"{self.root}/_log.json") as stream:
            self.segment_records = json.loads(stream.readall())["segment_records"]
        self.segments: dict[int, dict[int, list[str]]] = {}
        for info in self.files.get_file_info(fs.FileSelector(self.root, recursive=True)):
            parts = info.path[len(self.root) :].strip("/").split("/")
            if len(parts) == 3 and parts[2].endswith(".parquet"):
                partition, segment = (int(p.split("=")[1]) for p in parts[:2])
                self.segments.setdefault(partition, {}).setdefault(segment, []).append(info.path)

    def earliest(self) -> dict[str, int]:
        return {str(p): min(s) * self.segment_records for p, s in sorted(self.segments.items())}

    def end(self) -> dict[str, int]:
        """The offset behind the last record of every partition; of the last segment the footer is read."""
        found = {}
        for p, segments in sorted(self.segments.items()):
            last = max(segments)
            rows = sum(pq.ParquetFile(self.files.open_input_file(f)).metadata.num_rows for f in segments[last])
            found[str(p)] = last * self.segment_records + rows
        return found

    def ranges(self, start: dict[str, int], end: dict[str, int]) -> list[Segment]:
        """What to read from ``start`` up to, but not including, ``end``; offsets that are gone raise."""
        earliest, wanted = self.earliest(), []
        for p, upto in sorted(end.items()):
            first = start.get(p, earliest.get(p, 0))
            if first < upto and first < earliest.get(p, upto):
                raise ValueError(f"Offset out of range: partition {p} begins at {earliest.get(p)}, asked for {first}")
            while first < upto:
                segment = first // self.segment_records
                stop = min(upto, (segment + 1) * self.segment_records)
                wanted.append(Segment(int(p), first, stop, tuple(self.segments[int(p)][segment])))
                first = stop
        return wanted


class Segment(InputPartition):
    """Records of one segment of a partition, from ``first`` to before ``stop``."""

    def __init__(self, partition: int, first: int, stop: int, files: tuple[str, ...]) -> None:
        super().__init__((partition, first, stop))
        self.partition, self.first, self.stop, self.files = partition, first, stop, files


def _read(path: str, segment: Segment) -> Iterator[pa.RecordBatch]:
    files = fs.FileSystem.from_uri(path)[0] if ":" in path else fs.LocalFileSystem()
    for name in segment.files:
        with files.open_input_file(name) as source:
            for batch in pq.ParquetFile(source).iter_batches(columns=["key", "value", "offset", "timestamp"]):
                offsets = batch.column(batch.schema.get_field_index("offset")).to_numpy()
                kept = batch.filter(pa.array((offsets >= segment.first) & (offsets < segment.stop)))
                if kept.num_rows:
                    get = lambda c, b=kept: b.column(b.schema.get_field_index(c))
                    stamps = get("timestamp").cast(pa.timestamp("us", tz="UTC"))
                    columns = [get("key").cast(pa.binary()), get("value").cast(pa.binary()), pa.array([segment.partition] * kept.num_rows, pa.int32()), get("offset"), stamps]
                    yield pa.RecordBatch.from_arrays(columns, _COLUMNS)


class ReplayLog(DataSource):
    """``spark.readStream.format("replay_log").option("path", ...)``, or ``spark.read`` for all that is there.

    ``startingOffsets`` is ``earliest``, ``latest`` or JSON, an offset by partition; partitions it leaves
    out begin at their earliest. ``maxRecordsPerTrigger`` bounds what one trigger plans, dealt over
    the partitions; ``progress`` names a file in which the last planned position is kept, without
    which the first trigger after a restart is not bounded, because Spark does not tell where it stands.
    """

    @classmethod
    def name(cls) -> str:
        return "replay_log"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _WholeLog(self.options)

    def streamReader(self, schema) -> DataSourceStreamReader:  # noqa: N802 - Spark's name
        return _LogStream(self.options)


class _WholeLog(DataSourceReader):
    def __init__(self, options) -> None:
        self.path = options["path"]

    def partitions(self) -> list[Segment]:
        log = Log(self.path)
        return log.ranges(log.earliest(), log.end())

    def read(self, partition: Segment) -> Iterator[pa.RecordBatch]:
        return _read(self.path, partition)


class _LogStream(DataSourceStreamReader):
    def __init__(self, options) -> None:
        self.path = options["path"]
        self.start = options.get("startingOffsets", "earliest")
        self.most = int(options["maxRecordsPerTrigger"]) if "maxRecordsPerTrigger" in options else None
        self.progress = options.get("progress")
        self.at = self._kept()

    def _kept(self) -> dict[str, int] | None:
        if self.progress is None:
            return None
        files, name = fs.FileSystem.from_uri(self.progress) if ":" in self.progress else (fs.LocalFileSystem(), self.progress)
        if files.get_file_info(name).type == fs.FileType.NotFound:
            return None
        with files.open_input_stream(name) as stream:
            return json.loads(stream.readall())

    def _keep(self, at: dict[str, int]) -> None:
        self.at = at
        if self.progress is not None:
            files, name = fs.FileSystem.from_uri(self.progress) if ":" in self.progress else (fs.LocalFileSystem(), self.progress)
            with files.open_output_stream(f"{name}.part") as stream:
                stream.write(json.dumps(at).encode())
            files.move(f"{name}.part", name)

    def _first(self, log: Log) -> dict[str, int]:
        """The start position that was asked for."""
        if self.start == "latest":
            return log.end()
        asked = {} if self.start == "earliest" else json.loads(self.start)
        return log.earliest() | {str(p): int(o) for p, o in asked.items()}

    def initialOffset(self) -> dict:  # noqa: N802
        return self._first(Log(self.path))

    def latestOffset(self) -> dict:  # noqa: N802 - Spark asks for it before the initial one
        log = Log(self.path)
        end = log.end()
        if self.at is None and self.progress is not None:
            self.at = self._first(log)  # nothing was planned yet
        if self.most is None or self.at is None or not end:
            return end
        each, earliest = max(1, self.most // len(end)), log.earliest()
        # Never behind what was planned, also where the log has lost its end.
        return {p: max(self.at.get(p, 0), min(upto, self.at.get(p, earliest[p]) + each)) for p, upto in end.items()}

    def partitions(self, start: dict, end: dict) -> list[Segment]:
        wanted = Log(self.path).ranges(start, end)
        self._keep(end)
        return wanted

    def read(self, partition: Segment) -> Iterator[pa.RecordBatch]:
        return _read(self.path, partition)

    def commit(self, end: dict) -> None:
        pass

    def stop(self) -> None:
        pass


def read_log(spark: SparkSession, path: str, **options: str) -> DataFrame:
    """A log as a stream."""
    spark.dataSource.register(ReplayLog)
    return spark.readStream.format(ReplayLog.name()).option("path", path).options(**options).load()
