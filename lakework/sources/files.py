"""CSV, text, JSON and properties files, generic formats and managed tables."""

from __future__ import annotations

import re
from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakework.sources import hadoop


def read_csv(spark: SparkSession, path: str, header: bool = False, names: Sequence[str] | None = None) -> DataFrame:
    """CSV with all columns as text; ``names`` renames them by position."""
    df = spark.read.option("header", header).csv(path)
    return df.toDF(*names) if names else df


def write_csv(df: DataFrame, path: str, mode: str = "errorifexists", header: bool = False) -> None:
    df.write.mode(mode).option("header", header).csv(path)


def read_text(spark: SparkSession, path: str) -> DataFrame:
    """One row per line, in ``value``."""
    return spark.read.text(path)


def write_text(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Write the single text column of a frame, one line per row."""
    df.write.mode(mode).text(path)


def read_source(spark: SparkSession, fmt: str, options: Mapping[str, str], path: str | None = None) -> DataFrame:
    """Any data source by its name and options."""
    reader = spark.read.format(fmt).options(**options)
    return reader.load(path) if path else reader.load()


def write_source(
    df: DataFrame, fmt: str, options: Mapping[str, str], mode: str = "append", path: str | None = None
) -> None:
    """Append to or overwrite any data source by its name and options."""
    writer = df.write.format(fmt).options(**options).mode(mode)
    writer.save(path) if path else writer.save()


def overwrite_and_verify(df: DataFrame, path: str, key: str) -> DataFrame:
    """Overwrite a parquet folder, read it back, and report counts and key differences in one row.

    Both sides are counted per key in one shuffle; every key, NULL too, must come back as often.
    """
    df.write.mode("overwrite").parquet(path)
    back = df.sparkSession.read.parquet(path)
    both = df.select(key, F.lit(1).alias("_in"), F.lit(0).alias("_out")).unionAll(back.select(key, F.lit(0), F.lit(1)))
    per_key = both.groupBy(key).agg(F.sum("_in").alias("_in"), F.sum("_out").alias("_out"))
    report = per_key.agg(
        F.coalesce(F.sum("_in"), F.lit(0)).alias("written"),
        F.coalesce(F.sum("_out"), F.lit(0)).alias("read"),
        F.count_if((F.col("_in") > 0) & (F.col("_out") == 0)).alias("missing_keys"),
        F.count_if((F.col("_in") == 0) & (F.col("_out") > 0)).alias("extra_keys"),
        F.count_if(F.col("_in") != F.col("_out")).alias("_differ"),
    )
    return report.select("written", "read", "missing_keys", "extra_keys", (F.col("_differ") == 0).alias("ok"))


def save_table(df: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """Overwrite a catalog table and read it through SQL; ``path`` makes it external."""
    writer = df.write.mode("overwrite")
    if path:
        writer = writer.option("path", path)
    writer.saveAsTable(name)
    return df.sparkSession.sql(f"SELECT * FROM {name}")


def rows_to_df(spark: SparkSession, rows: Iterable, schema: T.StructType | str | Sequence[str] | None = None) -> DataFrame:
    """Rows in memory as a frame, with a schema, column names only, or neither."""
    return spark.createDataFrame(rows, schema)


# Quoted names, plain names (before a colon) and the two types that a struct does not know.
_VARIANT_SCHEMA = re.compile(r"`(?:[^`]|``)*`|([^\s`<>,:()]+)(?=: )|\bOBJECT(?=<)|\bVARIANT\b")


def _struct_of(found: str | None) -> str | None:
    """The schema of variant objects as that of a struct; None if no object has a field."""
    if not found or not found.startswith("OBJECT<") or found == "OBJECT<>":
        return None
    types = {"OBJECT": "STRUCT", "VARIANT": "STRING"}
    return _VARIANT_SCHEMA.sub(lambda m: f"`{m[1]}`" if m[1] else types.get(m[0], m[0]), found)


def json_rows_to_df(texts: DataFrame) -> DataFrame:
    """A frame of JSON texts, one column, as a frame with the schema that all objects need.

    One aggregate finds the schema over every object, then the texts are parsed where they
    are. Every text gives a row; NULL and texts that are no JSON objects give rows of NULL, in
    a column ``_corrupt_record`` where no object has a field.
    """
    text = F.col(f"`{texts.columns[0]}`")
    value = F.try_parse_json(text)
    objects = F.when(F.schema_of_variant(value).startswith("OBJECT<"), value)
    fields = _struct_of(texts.agg(F.schema_of_variant_agg(objects).alias("s")).first().s)
    if fields is None:
        return texts.select(F.lit(None).cast("string").alias("_corrupt_record"))
    # from_json takes the first object of an array, so what does not begin as an object is left out here.
    whole = F.when(text.rlike(r"^\s*\{"), text)
    return texts.select(F.from_json(whole, fields).alias("_row")).select("_row.*")


def load_properties(spark: SparkSession, path: str, defaults: Mapping[str, str] | None = None) -> dict[str, str]:
    """``key=value`` lines of a settings file over the defaults; a missing file gives the defaults."""
    out = dict(defaults or {})
    if not hadoop.exists(spark, path):
        return out
    for line in hadoop.read_text(spark, path).splitlines():
        text = line.strip()
        if text and text[0] not in "#!" and "=" in text:
            key, value = text.split("=", 1)
            out[key.strip()] = value.strip()
    return out
