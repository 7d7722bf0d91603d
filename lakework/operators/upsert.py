"""Keyed tables on plain parquet: upserts, deletes, versions, deltas and compaction.

A table is a folder of immutable parquet files and a list of commits. Rows are
spread over key buckets; a write adds files for the buckets it touches and then
commits a small JSON file that names the current files of every bucket. Readers
follow the newest commit, so they never see half a write. One writer per table.
"""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import asdict, dataclass, field

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakework.operators.changes import DELETED, latest_per_key, merge_schemas
from lakework.sources import hadoop

COPY_ON_WRITE = "copy_on_write"
MERGE_ON_READ = "merge_on_read"
ARRIVAL = "arrival"
EVENT_TIME = "event_time"
BUCKET = "_bucket"
VERSION = "_version"


@dataclass
class Commit:
    """The state of a table after a write."""

    version: int
    table_type: str
    key: list[str]
    order: list[str]
    buckets: int
    ordering: str
    schema: str
    base: dict[str, int] = field(default_factory=dict)  # bucket -> version of its files
    deltas: list[dict] = field(default_factory=list)  # {"version": n, "buckets": [...]}
    writers: dict[str, int] = field(default_factory=dict)  # writer -> its last batch

    @property
    def stored(self) -> T.StructType:
        return T.StructType.fromJson(json.loads(self.schema))


@dataclass(frozen=True)
class WriteReport:
    """What one write did."""

    version: int
    upserts: int
    deletes: int
    skipped: bool = False
    compacted: bool = False


def table_path(base: str, db: str, table: str) -> str:
    return f"{base.rstrip('/')}/{db}/{table}"


def current_commit(spark: SparkSession, path: str) -> Commit | None:
    """The newest commit, or None where there is no table."""
    names = [n for n in hadoop.list_names(spark, f"{path}/_commits") if n.endswith(".json")]
    return Commit(**json.loads(hadoop.read_text(spark, f"{path}/_commits/{names[-1]}"))) if names else None


def _save(spark: SparkSession, path: str, commit: Commit) -> None:
    hadoop.write_text_once(spark, f"{path}/_commits/{commit.version:020d}.json", json.dumps(asdict(commit)))


def _bucket_of(key: Sequence[str], buckets: int) -> Column:
    """Bucket of a key, from its text, so that a key of a widened type stays in its bucket."""
    return F.pmod(F.xxhash64(*[F.col(k).cast("string") for k in key]), F.lit(buckets)).cast("int")


def _files(path: str, folder: str, places: list[tuple[int, int]]) -> list[str]:
    return [f"{path}/{folder}/{VERSION}={v}/{BUCKET}={b}" for b, v in places]


def _read(spark: SparkSession, path: str, folder: str, places: list[tuple[int, int]], schema: T.StructType) -> DataFrame:
    """Rows of some buckets of some versions, with the bucket and version they come from."""
    full = T.StructType(
        [*schema.fields, T.StructField(VERSION, T.LongType()), T.StructField(BUCKET, T.IntegerType())]
    )
    if not places:
        return spark.createDataFrame([], full)
    return spark.read.schema(full).option("basePath", f"{path}/{folder}").parquet(*_files(path, folder, places))


def _same_key(left: str, right: str, key: Sequence[str]) -> Column:
    match = F.col(f"{left}.{BUCKET}") == F.col(f"{right}.{BUCKET}")
    for k in key:
        match = match & F.col(f"{left}.{k}").eqNullSafe(F.col(f"{right}.{k}"))
    return match


def _base_schema(commit: Commit, schema: T.StructType) -> T.StructType:
    """What base files hold: in an event-time table deleted keys stay, with their order and a flag."""
    flag = [T.StructField(DELETED, T.BooleanType())] if commit.ordering == EVENT_TIME else []
    return T.StructType([*schema.fields, *flag])


def _merge(old: DataFrame, new: DataFrame, commit: Commit, columns: Sequence[str]) -> DataFrame:
    """Base rows after ``new`` (one row per key, with the delete flag) comes over ``old``.

    By event time a deleted key stays as a flagged row, so that an older record that
    arrives later finds its order, however often the table was compacted in between.
    """
    names = [*columns, BUCKET]
    if commit.ordering == EVENT_TIME:
        both = old.select(*names, DELETED, F.lit(0).alias("_late")).unionByName(
            new.select(*names, DELETED, F.lit(1).alias("_late"))
        )
        return latest_per_key(both, commit.key, [*commit.order, "_late"]).select(*names, DELETED)
    survivors = old.alias("o").join(new.alias("n"), _same_key("o", "n", commit.key), "left_anti")
    return survivors.select(*names).unionByName(new.where(~F.col(DELETED)).select(*names))


def _snapshot(
    spark: SparkSession, path: str, commit: Commit, only: set[int] | None = None, flagged: bool = False
) -> DataFrame:
    """Rows of a version, or of some of its buckets, with the bucket column.

    ``flagged`` keeps what base files keep, deleted keys of an event-time table too.
    """
    rows = _stored_rows(spark, path, commit, only)
    if commit.ordering != EVENT_TIME:
        return rows
    rows = rows.withColumn(DELETED, F.coalesce(DELETED, F.lit(False)))
    return rows if flagged else rows.where(~F.col(DELETED)).drop(DELETED)


def _stored_rows(spark: SparkSession, path: str, commit: Commit, only: set[int] | None) -> DataFrame:
    schema = commit.stored
    held = _base_schema(commit, schema)
    wanted = lambda b: only is None or b in only
    base = [(int(b), v) for b, v in commit.base.items() if wanted(int(b))]
    deltas = [(b, d["version"]) for d in commit.deltas for b in d["buckets"] if wanted(b)]
    if not deltas:
        return _read(spark, path, "base", base, held).drop(VERSION)
    fresh = {b for b, _ in deltas}
    quiet = [p for p in base if p[0] not in fresh]
    old = _read(spark, path, "base", [p for p in base if p[0] in fresh], held).drop(VERSION)
    if commit.ordering == EVENT_TIME:
        old = old.withColumn(DELETED, F.coalesce(DELETED, F.lit(False)))
    changes = _read(spark, path, "delta", deltas, T.StructType([*schema.fields, T.StructField(DELETED, T.BooleanType())]))
    order = [*commit.order, VERSION] if commit.ordering == EVENT_TIME else [VERSION]
    new = latest_per_key(changes, [*commit.key, BUCKET], order)
    merged = _merge(old, new, commit, schema.names)
    return merged.unionByName(_read(spark, path, "base", quiet, held).drop(VERSION)) if quiet else merged


def read_upsert_table(
    spark: SparkSession, path: str, merge_schema: bool = False, with_order: bool = False
) -> DataFrame:
    """Current rows of an upsert table. A trailing ``/*`` is allowed.

    A folder without commits is read as plain parquet; ``merge_schema`` then unites
    the schemas of its files. Tables with commits always have the united schema.
    """
    path = path.rstrip("/*")
    commit = current_commit(spark, path)
    if commit is None:
        return spark.read.option("mergeSchema", str(merge_schema).lower()).parquet(path)
    hidden = () if with_order else tuple(c for c in commit.order if c.startswith("_order_"))
    return _snapshot(spark, path, commit).drop(BUCKET, *hidden)


def _write(rows: DataFrame, path: str, folder: str, version: int) -> list[int]:
    """Write rows by bucket and name the buckets that got files.

    The rebalance hint lets adaptive execution split a large bucket over several
    tasks and put small ones together.
    """
    target = f"{path}/{folder}/{VERSION}={version}"
    rows.hint("rebalance", F.col(BUCKET)).write.mode("overwrite").partitionBy(BUCKET).parquet(target)
    names = hadoop.list_names(rows.sparkSession, target)
    return sorted(int(n.split("=")[1]) for n in names if n.startswith(f"{BUCKET}="))


def upsert_table(
    df: DataFrame,
    path: str,
    key: Sequence[str],
    precombine: str | Sequence[str],
    mode: str = "append",
    table_type: str = COPY_ON_WRITE,
    ordering: str | None = None,
    buckets: int = 16,
    compact_inline: bool = True,
    max_delta_commits: int = 10,
    writer: str = "batch",
    batch_id: int | None = None,
) -> WriteReport:
    """Write rows over a table by key: the last of each key wins, deleted keys go.

    ``precombine`` orders the rows of a key inside the batch. With ``arrival``, the default
    of a new table, a later batch always wins; with ``event_time`` the stored order decides
    as well, also that of deleted keys. A table keeps the ordering it was made with; naming
    another one is an error. A column ``_is_deleted`` marks deletes. ``batch_id`` makes replays
    of a writer's batch do nothing; a writer is one sequence of rising batch numbers.
    ``mode`` is append, overwrite, errorifexists or ignore.
    """
    spark = df.sparkSession
    stored = current_commit(spark, path)
    if stored is not None and mode == "errorifexists":
        raise FileExistsError(path)
    if stored is not None and mode == "ignore":
        return WriteReport(stored.version, 0, 0, skipped=True)
    if mode not in ("append", "overwrite", "errorifexists", "ignore"):
        raise ValueError(f"unknown mode {mode!r}")
    if stored and batch_id is not None and batch_id <= stored.writers.get(writer, -1):
        return WriteReport(stored.version, 0, 0, skipped=True)
    order = [precombine] if isinstance(precombine, str) else list(precombine)
    fields = [f for f in df.schema.fields if f.name != DELETED]
    known = stored.stored if stored and mode != "overwrite" else None
    schema = merge_schemas(known, fields)
    if known is not None and ordering not in (None, stored.ordering):
        raise ValueError(f"the table is ordered by {stored.ordering}, not {ordering}")
    commit = Commit(
        version=stored.version + 1 if stored else 1,
        table_type=stored.table_type if known is not None else table_type,
        key=stored.key if known is not None else list(key),
        order=stored.order if known is not None else order,
        buckets=stored.buckets if known is not None else buckets,
        ordering=stored.ordering if known is not None else ordering or ARRIVAL,
        schema=schema.json(),
        base=dict(stored.base) if known is not None else {},
        deltas=list(stored.deltas) if known is not None else [],
        writers=dict(stored.writers) if stored else {},
    )
    if commit.key != list(key):
        raise ValueError(f"the table is keyed by {commit.key}, not {list(key)}")
    if batch_id is not None:
        commit.writers[writer] = batch_id

    incoming = _conform(df, schema)
    latest = latest_per_key(incoming, commit.key, order)
    latest = latest.withColumn(BUCKET, _bucket_of(commit.key, commit.buckets))
    latest = latest.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        # One row per bucket.
        counts = latest.groupBy(BUCKET).agg(
            F.count("*").alias("n"), F.sum(F.col(DELETED).cast("long")).alias("gone")
        ).collect()
        touched = {r[BUCKET] for r in counts}
        deletes = sum(r.gone for r in counts)
        upserts = sum(r.n for r in counts) - deletes
        retyped = known is not None and any(schema[f.name].dataType != f.dataType for f in known)
        if retyped:
            # Files of another type cannot be read with the new schema: rewrite them all.
            touched = set(range(commit.buckets))
        if commit.table_type == MERGE_ON_READ and not retyped:
            if touched:
                written = _write(latest, path, "delta", commit.version)
                commit.deltas.append({"version": commit.version, "buckets": written})
        elif touched:
            old = _snapshot(spark, path, stored, touched, flagged=True) if known is not None else None
            if old is not None:
                keep = [BUCKET, DELETED] if commit.ordering == EVENT_TIME else [BUCKET]
                live = _merge(_conform(old, schema, keep=keep), latest, commit, schema.names)
            elif commit.ordering == EVENT_TIME:
                live = latest
            else:
                live = latest.where(~F.col(DELETED)).drop(DELETED)
            written = _write(live, path, "base", commit.version)
            kept = {b: v for b, v in commit.base.items() if int(b) not in touched}
            commit.base = {**kept, **{str(b): commit.version for b in written}}
            commit.deltas = _without(commit.deltas, touched)
        _save(spark, path, commit)
    finally:
        latest.unpersist()
    compacted = False
    if compact_inline and len(commit.deltas) >= max_delta_commits:
        compact(spark, path)
        compacted = True
    return WriteReport(commit.version, upserts, deletes, compacted=compacted)


def _conform(df: DataFrame, schema: T.StructType, keep: Sequence[str] = ()) -> DataFrame:
    """Columns of the schema by name and type; what the frame lacks is NULL."""
    columns = [
        (F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema
    ]
    extra = [F.col(c) for c in keep]
    if not keep:
        flag = F.coalesce(F.col(DELETED), F.lit(False)) if DELETED in df.columns else F.lit(False)
        extra = [flag.alias(DELETED)]
    return df.select(*columns, *extra)


def _without(deltas: list[dict], buckets: set[int]) -> list[dict]:
    left = [{**d, "buckets": [b for b in d["buckets"] if b not in buckets]} for d in deltas]
    return [d for d in left if d["buckets"]]


def compact(spark: SparkSession, path: str) -> int:
    """Fold the deltas into new base files of the buckets they touch; gives the version."""
    commit = current_commit(spark, path)
    if commit is None:
        raise FileNotFoundError(path)
    touched = {b for d in commit.deltas for b in d["buckets"]}
    if not touched:
        return commit.version
    rows = _snapshot(spark, path, commit, touched, flagged=True)
    commit.version += 1
    written = _write(rows, path, "base", commit.version)
    kept = {b: v for b, v in commit.base.items() if int(b) not in touched}
    commit.base = {**kept, **{str(b): commit.version for b in written}}
    commit.deltas = []
    _save(spark, path, commit)
    return commit.version


def drop_old_versions(spark: SparkSession, path: str) -> int:
    """Delete data and commits that the current commit replaces; no reader may be on an older version.

    Readers and writers list the commits that are left, so their number stays small.
    """
    commit = current_commit(spark, path)
    if commit is None:
        return 0
    live = {
        "base": {v for v in commit.base.values()},
        "delta": {d["version"] for d in commit.deltas},
    }
    dropped = 0
    for folder, versions in live.items():
        for name in hadoop.list_names(spark, f"{path}/{folder}"):
            version = int(name.split("=")[1]) if name.startswith(f"{VERSION}=") else None
            if version is not None and version <= commit.version and version not in versions:
                hadoop.remove(spark, f"{path}/{folder}/{name}")
                dropped += 1
    for name in hadoop.list_names(spark, f"{path}/_commits"):
        if name.endswith(".json") and int(name.removesuffix(".json")) < commit.version:
            hadoop.remove(spark, f"{path}/_commits/{name}")
    return dropped


_SHOWN = "shown_versions"


def sync_table(spark: SparkSession, db: str, table: str, path: str) -> str:
    """Register the current rows in the catalog as an external table, one partition per bucket.

    Deltas are folded in first, so the catalog never shows half a table. A table that is
    there with the same columns keeps its name throughout: only the locations of its
    partitions move. Files of an event-time table also hold deleted keys, so its name is a
    view over the table ``<name>_rows`` that leaves them out.
    """
    if current_commit(spark, path) is None:
        raise FileNotFoundError(path)
    compact(spark, path)
    commit = current_commit(spark, path)
    held = _base_schema(commit, commit.stored)
    timed = commit.ordering == EVENT_TIME
    stored_as = f"{table}_rows" if timed else table
    name = f"`{db}`.`{stored_as}`"
    spark.sql(f"CREATE DATABASE IF NOT EXISTS `{db}`")
    want = [(f.name.lower(), f.dataType.simpleString()) for f in held] + [(BUCKET, "int")]
    have = []
    if spark.catalog.tableExists(f"{db}.{stored_as}"):
        have = [(f.name.lower(), f.dataType.simpleString()) for f in spark.table(name).schema]
    if have != want:
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in held)
        spark.sql(f"DROP TABLE IF EXISTS {name}")
        spark.sql(
            f"CREATE TABLE {name} ({columns}, `{BUCKET}` INT) USING parquet PARTITIONED BY (`{BUCKET}`) LOCATION '{path}/base'"
        )
    known = {int(r[0].split("=")[1]) for r in spark.sql(f"SHOW PARTITIONS {name}").collect()}  # one row per bucket
    places = {int(b): f"{path}/base/{VERSION}={v}/{BUCKET}={b}" for b, v in commit.base.items()}
    # The table remembers the version of each bucket that it shows; only those that changed are moved.
    shown_versions = json.loads({r[0]: r[1] for r in spark.sql(f"SHOW TBLPROPERTIES {name}").collect()}.get(_SHOWN, "{}"))
    for b in sorted(b for b in known & set(places) if shown_versions.get(str(b)) != commit.base[str(b)]):
        spark.sql(f"ALTER TABLE {name} PARTITION (`{BUCKET}`={b}) SET LOCATION '{places[b]}'")
    if fresh := sorted(set(places) - known):
        parts = " ".join(f"PARTITION (`{BUCKET}`={b}) LOCATION '{places[b]}'" for b in fresh)
        spark.sql(f"ALTER TABLE {name} ADD IF NOT EXISTS {parts}")
    if gone := sorted(known - set(places)):
        spark.sql(f"ALTER TABLE {name} DROP IF EXISTS " + ", ".join(f"PARTITION (`{BUCKET}`={b})" for b in gone))
    if shown_versions != commit.base:
        spark.sql(f"ALTER TABLE {name} SET TBLPROPERTIES ('{_SHOWN}' = '{json.dumps(commit.base)}')")
    spark.catalog.refreshTable(f"{db}.{stored_as}")
    if timed:
        shown = ", ".join(f"`{f.name}`" for f in commit.stored)
        spark.sql(f"CREATE OR REPLACE VIEW `{db}`.`{table}` AS SELECT {shown}, `{BUCKET}` FROM {name} WHERE NOT coalesce(`{DELETED}`, false)")
    return f"`{db}`.`{table}`"
