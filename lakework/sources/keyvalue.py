"""Wide-column cells and declared columns through JSON catalogs."""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Catalog type names that Spark spells differently.
_TYPE_NAMES = {"integer": "int", "long": "bigint", "bool": "boolean", "short": "smallint", "byte": "tinyint"}
_ROWKEY = "rowkey"


@dataclass(frozen=True)
class CatalogColumn:
    """One column of a catalog: its name in Spark, family, source column and type."""

    name: str
    family: str
    source: str
    kind: str


def parse_catalog(catalog_json: str) -> list[CatalogColumn]:
    """Columns of a JSON catalog, in order."""
    columns = json.loads(catalog_json)["columns"]
    out = []
    for name, c in columns.items():
        kind = c.get("type", "string").lower()
        out.append(CatalogColumn(name, c.get("cf", ""), c.get("col", name), _TYPE_NAMES.get(kind, kind)))
    return out


def kv_read(cells: DataFrame, catalog_json: str) -> DataFrame:
    """Cells ``rowkey, cf, col, value[, ts]`` as one typed row per row key.

    Each column is its own filtered aggregate, so partial rows form before the shuffle.
    Of several versions of a cell the newest stays. Cells outside the catalog are
    skipped before grouping.
    """
    columns = parse_catalog(catalog_json)
    stored = [c for c in columns if c.family != _ROWKEY]
    wanted = F.lit(False)
    for c in stored:
        wanted = wanted | ((F.col("cf") == c.family) & (F.col("col") == c.source))
    aggregates = []
    for c in stored:
        value = F.when((F.col("cf") == c.family) & (F.col("col") == c.source), F.col("value"))
        newest = F.max_by(value, F.when(value.isNotNull(), F.col("ts"))) if "ts" in cells.columns else F.max(value)
        aggregates.append(newest.cast(c.kind).alias(c.name))
    grouped = cells.where(wanted).groupBy("rowkey").agg(*aggregates)
    return grouped.select(
        *[F.col("rowkey").cast(c.kind).alias(c.name) if c.family == _ROWKEY else F.col(c.name) for c in columns]
    )


def kv_write(df: DataFrame, catalog_json: str, num_regions: int | None = None) -> DataFrame:
    """A typed frame as cells, ranged over regions by row key and sorted in them. NULL makes no cell.

    Without ``num_regions`` adaptive execution sizes the regions by their bytes.
    """
    columns = parse_catalog(catalog_json)
    key = next(c for c in columns if c.family == _ROWKEY)
    items = F.array(
        *[
            F.struct(
                F.lit(c.family).alias("cf"), F.lit(c.source).alias("col"), F.col(c.name).cast("string").alias("value")
            )
            for c in columns
            if c.family != _ROWKEY
        ]
    )
    cells = df.select(F.col(key.name).cast("string").alias("rowkey"), F.explode(items).alias("_c"))
    plain = cells.select("rowkey", "_c.cf", "_c.col", "_c.value").where("value IS NOT NULL")
    regions = () if num_regions is None else (num_regions,)
    return plain.repartitionByRange(*regions, "rowkey", "cf", "col").sortWithinPartitions("rowkey", "cf", "col")


def apply_catalog(
    df: DataFrame, catalog_json: str, push_down_range_long: bool = True, push_down_range_string: bool = True
) -> DataFrame:
    """Select, type and name the columns of a catalog.

    Filters on the result reach the source as ranges. The switches keep those on long
    or string columns out of it, for stores where such ranges are slower than a scan.
    """
    out = []
    for c in parse_catalog(catalog_json):
        column = F.col(c.source).cast(c.kind)
        # An expression over the column is opaque to the source, so its filters stay in Spark.
        if c.kind == "bigint" and not push_down_range_long:
            column = F.bitwise_not(F.bitwise_not(column))
        if c.kind == "string" and not push_down_range_string:
            column = F.concat(column, F.lit(""))
        out.append(column.alias(c.name))
    return df.select(*out)
