"""Change records of a database feed: envelope, images, types and typed rows."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

ENVELOPE = T.StructType(
    [
        T.StructField("op", T.StringType()),
        T.StructField("source_ts", T.LongType()),
        T.StructField("seq", T.LongType()),
        T.StructField("object_name", T.StringType()),
        T.StructField("pk", T.ArrayType(T.StringType())),
        T.StructField(
            "fields",
            T.ArrayType(
                T.StructType(
                    [
                        T.StructField("name", T.StringType()),
                        T.StructField("type", T.IntegerType()),
                        T.StructField("precision", T.IntegerType()),
                        T.StructField("scale", T.IntegerType()),
                    ]
                )
            ),
        ),
        T.StructField("before", T.MapType(T.StringType(), T.StringType())),
        T.StructField("after", T.MapType(T.StringType(), T.StringType())),
    ]
)

# The operations that change rows.
ROW_OPERATIONS = ("INSERT", "UPDATE", "DELETE")

# Database type ids of the feed, by the kind of column they become.
DECIMAL_IDS = (0, 246)
INT_IDS = (1, 2, 3, 9)
FLOAT_IDS = (4,)
DOUBLE_IDS = (5,)
LONG_IDS = (8,)
EPOCH_IDS = (7, 17)
DATE_IDS = (10, 14)
TIME_IDS = (11, 19)
DATETIME_IDS = (12, 18)
YEAR_IDS = (13,)
BIT_IDS = (16,)
STRING_IDS = (6, 15, 245, 247, 248, 249, 250, 251, 252, 253, 254, 255)

DEFAULT_DECIMAL = (10, 0)
MAX_PRECISION = 38

ORDER_COLUMNS = ("_order_ts", "_order_seq")
DELETED = "_is_deleted"

DecimalDefs = Mapping[str, Mapping[str, tuple[int, int]]]


@dataclass(frozen=True)
class TypeOptions:
    """How database types become column types."""

    all_to_string: bool = False
    decimal_to_string: bool = False
    decimals: DecimalDefs = field(default_factory=dict)


# -- envelope -----------------------------------------------------------------------


def decode_envelope(df: DataFrame, value_col: str = "value") -> DataFrame:
    """Parse JSON envelopes, as bytes or text; text that is not one fails the job.

    The parsed struct comes out of a generator, below which Catalyst pushes no filter:
    a filter on a plain projection would be moved down and parse the text once more
    for each field it reads.
    """
    parsed = F.from_json(F.col(value_col).cast("string"), ENVELOPE, {"mode": "FAILFAST"})
    return df.select(F.inline(F.array(parsed)))


def encode_envelope(df: DataFrame, alias: str = "value") -> DataFrame:
    """Envelope columns as JSON bytes."""
    return df.select(F.to_json(F.struct(*ENVELOPE.names)).cast("binary").alias(alias))


def row_changes(df: DataFrame) -> DataFrame:
    """Keep inserts, updates and deletes."""
    return df.where(F.col("op").isin(*ROW_OPERATIONS))


def require_pk(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Split records into those whose table has a primary key and those without."""
    keyed = F.coalesce(F.size("pk") > 0, F.lit(False))
    return df.where(keyed), df.where(~keyed)


def split_object_name(name: Column | str) -> tuple[Column, Column]:
    """Database and table of ``db``, ``db.table`` or ``db.schema.table``."""
    parts = F.split(F.col(name) if isinstance(name, str) else name, r"\.")
    n = F.size(parts)
    db = F.when(n.between(1, 3), F.get(parts, F.lit(0))).otherwise("")
    table = F.when(n.between(2, 3), F.get(parts, n - 1)).otherwise("")
    return db, table


def with_meta(df: DataFrame) -> DataFrame:
    """Add time in milliseconds, operation, database, table, key names and the delete flag."""
    db, table = split_object_name("object_name")
    return df.withColumns(
        {
            "source_timestamp": F.col("source_ts") * 1000,
            "operation": F.col("op"),
            "db_name": db,
            "table_name": table,
            "tbl_pks": F.array_join("pk", ","),
            DELETED: F.col("op") == "DELETE",
        }
    )


def row_image(df: DataFrame) -> DataFrame:
    """Add the image that states the row: before a delete, after anything else."""
    return df.withColumn("image", F.when(F.col("op") == "DELETE", F.col("before")).otherwise(F.col("after")))


def expand_key_changes(df: DataFrame) -> DataFrame:
    """An update of the primary key becomes a delete of the old key and an upsert of the new one."""
    told = F.forall("pk", lambda k: F.map_contains_key(F.col("before"), k))
    moved = F.exists("pk", lambda k: ~F.try_element_at("before", k).eqNullSafe(F.try_element_at("after", k)))
    changed = F.coalesce((F.col("op") == "UPDATE") & told & moved, F.lit(False))
    as_is = F.struct(F.col("image").alias("image"), F.col(DELETED).alias("gone"))
    old = F.struct(F.col("before").alias("image"), F.lit(True).alias("gone"))
    states = F.when(changed, F.array(old, as_is)).otherwise(F.array(as_is))
    rest = [c for c in df.columns if c not in ("image", DELETED)]
    return df.select(*rest, F.explode(states).alias("_s")).select(
        *rest, F.col("_s.image").alias("image"), F.col("_s.gone").alias(DELETED)
    )


# -- types --------------------------------------------------------------------------


def parse_decimal_defs(text: str | None) -> dict[str, dict[str, tuple[int, int]]]:
    """``t1:a,10,2;b,5,2#t2:c,6,1`` as table -> column -> (precision, scale)."""
    out: dict[str, dict[str, tuple[int, int]]] = {}
    for part in filter(None, (text or "").split("#")):
        table, _, columns = part.partition(":")
        for column in filter(None, columns.split(";")):
            name, precision, scale = column.split(",")
            out.setdefault(table, {})[name] = (int(precision), int(scale))
    return out


def safe_precision(digits: int) -> int:
    """The next multiple of ten strictly above, at most 38."""
    return min(MAX_PRECISION, (digits // 10 + 1) * 10)


def spark_type_for(
    type_id: int, decimal: tuple[int, int] | None = None, options: TypeOptions = TypeOptions()
) -> T.DataType:
    """Column type of a database type id."""
    by_ids = [
        (INT_IDS + YEAR_IDS + BIT_IDS, T.IntegerType()),
        (FLOAT_IDS, T.FloatType()),
        (DOUBLE_IDS, T.DoubleType()),
        (LONG_IDS, T.LongType()),
        (EPOCH_IDS + TIME_IDS + DATETIME_IDS, T.TimestampType()),
        (DATE_IDS, T.DateType()),
        (STRING_IDS, T.StringType()),
    ]
    if type_id in DECIMAL_IDS:
        known = T.StringType() if options.decimal_to_string else T.DecimalType(*(decimal or DEFAULT_DECIMAL))
    else:
        known = next((t for ids, t in by_ids if type_id in ids), None)
    if known is None:
        raise ValueError(f"not supported type {type_id}")
    return T.StringType() if options.all_to_string else known


def widen(a: T.DataType, b: T.DataType) -> T.DataType:
    """The type that holds both: int, long, decimal, string in this order; anything else fails."""
    if a == b:
        return a
    if isinstance(a, T.DecimalType) and isinstance(b, T.DecimalType):
        scale = max(a.scale, b.scale)
        return T.DecimalType(min(MAX_PRECISION, max(a.precision - a.scale, b.precision - b.scale) + scale), scale)
    chain = [T.IntegerType, T.LongType, T.DecimalType, T.StringType]
    ranks = [next((i for i, t in enumerate(chain) if isinstance(x, t)), None) for x in (a, b)]
    if None in ranks:
        if {type(a), type(b)} == {T.FloatType, T.DoubleType}:
            return T.DoubleType()
        raise TypeError(f"cannot hold {a.simpleString()} and {b.simpleString()} in one column")
    high, low = (a, b) if ranks[0] > ranks[1] else (b, a)
    if isinstance(high, T.DecimalType):
        digits = 10 if isinstance(low, T.IntegerType) else 19
        whole = max(high.precision - high.scale, digits)
        return T.DecimalType(min(MAX_PRECISION, whole + high.scale), high.scale)
    return high


@dataclass(frozen=True)
class TableShape:
    """What a batch says about one table."""

    db: str
    table: str
    pk: tuple[str, ...]
    columns: tuple[tuple[str, int, T.DataType], ...]  # name, type id, column type

    @property
    def schema(self) -> T.StructType:
        return T.StructType([T.StructField(name, kind) for name, _, kind in self.columns])


def field_list(df: DataFrame) -> DataFrame:
    """One row per database, table and column: key, the type ids seen, decimal digits and position."""
    order = F.struct("source_ts", "seq").alias("order")
    fields = df.select("db_name", "table_name", "image", "pk", order, F.posexplode("fields").alias("pos", "f"))
    has_value = F.try_element_at("image", F.col("f.name")).isNotNull()
    return fields.groupBy("db_name", "table_name", F.col("f.name").alias("name")).agg(
        F.max_by("pk", "order").alias("pk"),
        F.max("order").alias("order"),
        F.min("pos").alias("pos"),
        F.sort_array(F.collect_set("f.type")).alias("types"),
        F.max(F.when(has_value, F.col("f.precision") - F.col("f.scale"))).alias("whole"),
        F.max(F.when(has_value, F.col("f.scale"))).alias("scale"),
    )


def table_shapes(df: DataFrame, options: TypeOptions = TypeOptions()) -> list[TableShape]:
    """Schema of every table in a batch: the union of its records' fields, by name.

    Only names, type ids and digit counts reach the driver; their number is that of
    the columns in the source databases.
    """
    listed = field_list(df).collect()
    keys = {(r.db_name, r.table_name): tuple(r.pk) for r in sorted(listed, key=lambda r: r.order)}
    columns: dict[tuple[str, str], list] = {}
    for r in sorted(listed, key=lambda r: (r.pos, r.name)):
        decimal = _decimal_for(r, options)
        kinds = [spark_type_for(i, decimal, options) for i in r.types]
        kind = kinds[0]
        for other in kinds[1:]:
            kind = widen(kind, other)
        columns.setdefault((r.db_name, r.table_name), []).append((r.name, r.types[-1], kind))
    return [TableShape(db, table, keys[db, table], tuple(cols)) for (db, table), cols in sorted(columns.items())]


def _decimal_for(row, options: TypeOptions) -> tuple[int, int]:
    for table in (f"{row.db_name}.{row.table_name}", row.table_name):
        if row.name in options.decimals.get(table, {}):
            return options.decimals[table][row.name]
    if row.scale is None:
        return DEFAULT_DECIMAL
    return safe_precision(row.whole + row.scale), row.scale


# -- values -------------------------------------------------------------------------

_DATE = r"^\d{1,4}-\d{1,2}-\d{1,2}$"
_DATETIME = r"^\d{1,4}-\d{1,2}-\d{1,2}[ T]\d{1,2}:\d{1,2}:\d{1,2}(\.\d+)?$"
_TIME = r"^(-?)(\d{1,3}):(\d{1,2}):(\d{1,2}(?:\.\d+)?)$"
# Parts may be missing, as in 2020-01 or 2020-01-; anything else that is no date or time is an error.
_PARTIAL = r"^[-:. T0-9]*$"
_ZERO = r"^[-:. T0]*$"


def _instant(text: Column, type_id: int) -> Column:
    """Date and time text as a timestamp in milliseconds; missing parts and zero dates give NULL.

    A time is a span with a sign and up to three digits of hours, counted from 1970-01-01.
    """
    if type_id in TIME_IDS:
        hours, minutes = (F.regexp_extract(text, _TIME, g).cast("long") for g in (2, 3))
        seconds = F.regexp_extract(text, _TIME, 4).cast("decimal(20,6)")
        millis = F.floor(((hours * 60 + minutes) * 60 + seconds) * 1000)
        signed = F.when(F.regexp_extract(text, _TIME, 1) == "-", -millis).otherwise(millis).cast("long")
        return _checked(text, text.rlike(_TIME), F.timestamp_millis(signed))
    pattern = _DATE if type_id in DATE_IDS else _DATETIME
    return _checked(text, text.rlike(pattern), F.timestamp_millis(F.unix_millis(text.try_cast("timestamp"))))


def _checked(text: Column, matches: Column, value: Column) -> Column:
    """The value of a whole text, NULL for one with missing parts; other text fails, as numbers do."""
    wrong = F.raise_error(F.concat(F.lit("not a date or time: "), text)).cast("timestamp")
    partial = F.when(text.isNull() | text.rlike(_PARTIAL), F.lit(None).cast("timestamp")).otherwise(wrong)
    return F.when(matches & (value.isNotNull() | text.rlike(_ZERO)), value).when(matches, wrong).otherwise(partial)


def convert_value(text: Column, type_id: int, kind: T.DataType, all_to_string: bool = False) -> Column:
    """Text of a field in its column type."""
    if all_to_string:
        if type_id in FLOAT_IDS:
            return text.cast("float").cast("string")
        if type_id in DOUBLE_IDS:
            return text.cast("double").cast("string")
        if type_id in DATE_IDS + TIME_IDS + DATETIME_IDS:
            return F.unix_millis(_instant(text, type_id)).cast("string")
        return text
    if isinstance(kind, T.StringType):
        return text
    if type_id in EPOCH_IDS:
        return F.timestamp_millis(text.cast("long"))
    if type_id in DATE_IDS:
        return _instant(text, type_id).cast("date")
    if type_id in TIME_IDS + DATETIME_IDS:
        return _instant(text, type_id)
    return text.cast(kind)


def typed_rows(df: DataFrame, shape: TableShape, options: TypeOptions = TypeOptions()) -> DataFrame:
    """The rows of one table by name: its columns, the order columns and the delete flag.

    A field that a record lacks is NULL.
    """
    mine = df.where((F.col("db_name") == shape.db) & (F.col("table_name") == shape.table))
    return mine.select(
        *[
            convert_value(F.try_element_at("image", F.lit(name)), type_id, kind, options.all_to_string).alias(name)
            for name, type_id, kind in shape.columns
        ],
        F.col("source_timestamp").alias(ORDER_COLUMNS[0]),
        F.col("seq").alias(ORDER_COLUMNS[1]),
        F.col(DELETED),
    )


def record_key(pk: Sequence[str]) -> Column:
    """Key values joined by a comma, for display. Identity is decided on the typed columns."""
    return F.concat_ws(",", *[F.coalesce(F.col(c).cast("string"), F.lit("null")) for c in pk])


def latest_per_key(df: DataFrame, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The last row of each key.

    An aggregate instead of a window: each task keeps one row per key before the
    shuffle, so a key with a third of all rows costs no more than any other.
    """
    rest = [c for c in df.columns if c not in key]
    newest = F.max_by(F.struct(*rest), F.struct(*order)).alias("_row")
    return df.groupBy(*key).agg(newest).select(*key, *[F.col("_row")[c].alias(c) for c in rest]).select(*df.columns)


def prepare(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Decoded records to keyed row states, and the records that have no primary key."""
    kept, rejected = require_pk(row_changes(df))
    return expand_key_changes(row_image(with_meta(kept))), rejected


def merge_schemas(stored: T.StructType | None, incoming: Iterable[T.StructField]) -> T.StructType:
    """Stored and incoming columns by name, each in the wider type; the order is kept."""
    merged = {f.name: f.dataType for f in (stored or T.StructType([]))}
    for f in incoming:
        merged[f.name] = widen(merged[f.name], f.dataType) if f.name in merged else f.dataType
    return T.StructType([T.StructField(n, t) for n, t in merged.items()])
