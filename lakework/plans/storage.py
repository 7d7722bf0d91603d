"""Source and sink queries: each writes a given table, reads it back and returns it."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from lakework.plans.registry import query, table
from lakework.session import scratch_dir
from lakework.sources import files, jdbc, keyvalue


@query(
    "csv_round_trip",
    "SELECT CAST(c_custkey AS VARCHAR) AS id, c_name AS name, c_mktsegment AS segment FROM customer",
)
def _(spark, sf_dir):
    path = scratch_dir(spark, "csv")
    files.write_csv(table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment"), path, header=True)
    return files.read_csv(spark, path, header=True, names=["id", "name", "segment"])


@query("text_round_trip", "SELECT p_name || ' ' || p_brand || ' ' || p_type AS value FROM part")
def _(spark, sf_dir):
    path = scratch_dir(spark, "text")
    files.write_text(table(spark, sf_dir, "part").select(F.concat_ws(" ", "p_name", "p_brand", "p_type")), path)
    return files.read_text(spark, path)


@query(
    "generic_format_append",
    "SELECT s_suppkey, s_name, s_acctbal FROM supplier UNION ALL SELECT s_suppkey, s_name, s_acctbal FROM supplier",
)
def _(spark, sf_dir):
    path = scratch_dir(spark, "orc")
    suppliers = table(spark, sf_dir, "supplier").select("s_suppkey", "s_name", "s_acctbal")
    files.write_source(suppliers, "orc", {"path": path, "compression": "zlib"}, mode="overwrite")
    files.write_source(suppliers, "orc", {"path": path}, mode="append")
    return files.read_source(spark, "orc", {"path": path})


@query(
    "overwrite_and_verify",
    "SELECT count(*) AS written, count(*) AS read, 0::BIGINT AS missing_keys, 0::BIGINT AS extra_keys, true AS ok FROM orders",
)
def _(spark, sf_dir):
    return files.overwrite_and_verify(table(spark, sf_dir, "orders"), scratch_dir(spark, "verified"), "o_orderkey")


@query("managed_table", "SELECT p_brand, count(*) AS n, round(sum(p_retailprice), 2) AS total FROM part GROUP BY p_brand")
def _(spark, sf_dir):
    saved = files.save_table(table(spark, sf_dir, "part"), "lakework_part")
    return saved.groupBy("p_brand").agg(F.count("*").alias("n"), F.round(F.sum("p_retailprice"), 2).alias("total"))


@query("external_table", "SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY o_orderstatus")
def _(spark, sf_dir):
    orders = jdbc.create_external_table(spark, "lakework_orders", "parquet", {"path": f"{sf_dir}/orders.parquet"})
    return orders.groupBy("o_orderstatus").agg(F.count("*").alias("n"))


@query("json_rows", "SELECT CAST(json_extract(props, '$.k') AS BIGINT) AS k, count(*) AS n FROM events GROUP BY ALL")
def _(spark, sf_dir):
    props = files.json_rows_to_df(table(spark, sf_dir, "events").select("props"))
    return props.groupBy("k").agg(F.count("*").alias("n"))


@query(
    "key_range_predicates",
    """
WITH k AS (SELECT CASE WHEN o_orderkey % 7 = 0 THEN NULL WHEN o_orderkey % 5 = 0 THEN -o_orderkey ELSE o_orderkey END AS o_orderkey FROM orders),
b AS (SELECT max(o_orderkey) // 2 + 1 AS stop, (max(o_orderkey) // 2 + 100) // 100 AS batch FROM k)
SELECT CAST(CASE WHEN o_orderkey IS NULL OR o_orderkey < 0 THEN 0 ELSE least(o_orderkey // batch, (stop - 1) // batch) END AS INTEGER) AS part,
       count(*) AS n, CAST(sum(o_orderkey) AS BIGINT) AS keys FROM k, b GROUP BY ALL
""",
)
def _(spark, sf_dir):
    """The predicates of a chunked bulk read: each row in one range, also NULL, negative and larger keys."""
    key = F.col("o_orderkey")
    kept = F.when(key % 7 == 0, F.lit(None)).when(key % 5 == 0, -key).otherwise(key)
    orders = table(spark, sf_dir, "orders").select(kept.alias("o_orderkey"))
    stop = orders.agg(F.max("o_orderkey").alias("last")).first()["last"] // 2 + 1
    predicates = jdbc.range_predicates("o_orderkey", 0, stop, (stop + 99) // 100)
    part = F.when(F.expr(predicates[0]), F.lit(0))
    for i, predicate in enumerate(predicates[1:], start=1):
        part = part.when(F.expr(predicate), F.lit(i))
    keyed = orders.select("o_orderkey", part.alias("part"))
    return keyed.groupBy("part").agg(F.count("*").alias("n"), F.sum("o_orderkey").alias("keys"))


_CELL_CATALOG = json.dumps(
    {
        "table": {"namespace": "shop", "name": "buyers"},
        "rowkey": "rowkey",
        "columns": {
            "id": {"cf": "rowkey", "col": "rowkey", "type": "bigint"},
            "name": {"cf": "who", "col": "full", "type": "String"},
            "balance": {"cf": "money", "col": "bal", "type": "double"},
            "nation": {"cf": "geo", "col": "n", "type": "integer"},
        },
    }
)
_CUSTOMERS = "SELECT c_custkey AS id, c_name AS name, CASE WHEN c_acctbal >= 0 THEN c_acctbal END AS balance, c_nationkey AS nation FROM customer"


@query("wide_column_round_trip", _CUSTOMERS)
def _(spark, sf_dir):
    path = scratch_dir(spark, "cells")
    balance = F.when(F.col("c_acctbal") >= 0, F.col("c_acctbal"))
    rows = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), balance.alias("balance"), F.col("c_nationkey").alias("nation")
    )
    keyvalue.kv_write(rows, _CELL_CATALOG).write.parquet(path)
    return keyvalue.kv_read(spark.read.parquet(path), _CELL_CATALOG)


@query(
    "wide_column_cells",
    f"""
SELECT CAST(id AS VARCHAR) AS rowkey, 'who' AS cf, 'full' AS col, name AS value FROM ({_CUSTOMERS})
UNION ALL SELECT CAST(id AS VARCHAR), 'geo', 'n', CAST(nation AS VARCHAR) FROM ({_CUSTOMERS})
""",
)
def _(spark, sf_dir):
    catalog = json.loads(_CELL_CATALOG)
    del catalog["columns"]["balance"]
    rows = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_nationkey").alias("nation")
    )
    return keyvalue.kv_write(rows, json.dumps(catalog))


_TABLE_CATALOG = json.dumps(
    {
        "columns": {
            "id": {"col": "s_suppkey", "type": "long"},
            "firm": {"col": "s_name", "type": "string"},
            "nation": {"col": "s_nationkey", "type": "integer"},
        }
    }
)
_SUPPLIERS = "SELECT s_suppkey AS id, s_name AS firm, s_nationkey AS nation FROM supplier"


@query("declared_columns", _SUPPLIERS)
def _(spark, sf_dir):
    return keyvalue.apply_catalog(table(spark, sf_dir, "supplier"), _TABLE_CATALOG)


@query("declared_columns_range", f"SELECT * FROM ({_SUPPLIERS}) WHERE id > 10 AND firm < 'Supplier#000000090'")
def _(spark, sf_dir):
    declared = keyvalue.apply_catalog(table(spark, sf_dir, "supplier"), _TABLE_CATALOG, push_down_range_string=False)
    return declared.where("id > 10 AND firm < 'Supplier#000000090'")
