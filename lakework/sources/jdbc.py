"""JDBC tables: whole, by subquery, by key ranges, and as external SQL tables.

Spark's JDBC source does the work; the driver class of the database has to be on the
classpath of the cluster.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession


def jdbc_options(url: str, table: str | None = None, query: str | None = None, **opts: object) -> dict[str, str]:
    """Reader options; a query becomes a derived table."""
    if (table is None) == (query is None):
        raise ValueError("give either a table or a query")
    target = table if table is not None else f"({query}) temp"
    return {"url": url, "dbtable": target, **{k: str(v) for k, v in opts.items()}}


def read_jdbc(
    spark: SparkSession, url: str, table: str | None = None, query: str | None = None, fetchsize: int = 1000, **opts: object
) -> DataFrame:
    """A table or the result of a query. Filters and columns are pushed down by Spark."""
    options = jdbc_options(url, table, query, fetchsize=fetchsize, **opts)
    return spark.read.format("jdbc").options(**options).load()


def range_predicates(split_field: str, start: int, stop: int, batch: int = 100_000) -> list[str]:
    """Half-open ranges of ``batch`` keys from ``start`` to ``stop``, one predicate each.

    Together they take every row once: the first range also takes smaller keys and NULL,
    the last also larger ones.
    """
    if batch <= 0:
        raise ValueError("batch must be positive")
    cuts = list(range(start + batch, stop, batch))
    if not cuts:
        return ["1 = 1"]
    first = f"{split_field} < {cuts[0]} OR {split_field} IS NULL"
    inner = [f"{split_field} >= {low} AND {split_field} < {high}" for low, high in zip(cuts, cuts[1:])]
    return [first, *inner, f"{split_field} >= {cuts[-1]}"]


def read_jdbc_chunked(
    spark: SparkSession,
    url: str,
    table: str,
    split_field: str,
    start: int | None = None,
    stop: int | None = None,
    batch: int = 100_000,
    properties: Mapping[str, str] | None = None,
) -> DataFrame:
    """Bulk read by key ranges, one partition per range; every row is read.

    Bounds that are not given are asked of the database. They only say where to cut.
    """
    if start is None or stop is None:
        asked = f"SELECT min({split_field}) AS low, max({split_field}) AS high FROM {table}"
        bounds = read_jdbc(spark, url, query=asked, **dict(properties or {})).first()
        start = int(bounds[0] or 0) if start is None else start
        stop = int(bounds[1] or 0) + 1 if stop is None else stop
    predicates = range_predicates(split_field, start, stop, batch)
    return spark.read.jdbc(url, table, predicates=predicates, properties=dict(properties or {}))


def write_jdbc(
    df: DataFrame,
    url: str,
    table: str,
    mode: str = "append",
    batchsize: int = 100_000,
    num_partitions: int = 8,
    column_types: str | None = None,
    **opts: object,
) -> None:
    """Append to or overwrite a table; Spark creates it when it is missing.

    ``num_partitions`` bounds the number of connections; ``column_types`` such as
    ``name VARCHAR(64), age INT`` sets the types of a new table.
    """
    options = {"batchsize": str(batchsize), "numPartitions": str(num_partitions), **{k: str(v) for k, v in opts.items()}}
    if column_types:
        options["createTableColumnTypes"] = column_types
    df.write.format("jdbc").options(url=url, dbtable=table, **options).mode(mode).save()


def create_external_table(spark: SparkSession, name: str, provider: str, options: Mapping[str, str]) -> DataFrame:
    """Replace a table over a data source and give it as a frame."""
    quoted = ", ".join(f"`{k}` {_literal(v)}" for k, v in options.items())
    spark.sql(f"DROP TABLE IF EXISTS {name}")
    spark.sql(f"CREATE TABLE {name} USING {provider} OPTIONS ({quoted})")
    return spark.table(name)


def _literal(value: str) -> str:
    escaped = value.replace("\\", "\\\\").replace("'", "\\'")
    return f"'{escaped}'"
