"""Relational queries: the helpers of the jobs, and SQL scripts."""

from __future__ import annotations

import base64

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakework.operators import quantiles, relational
from lakework.plans.registry import query, table
from lakework.session import scratch_dir


def _views(spark: SparkSession, sf_dir: str, *names: str) -> None:
    for name in names:
        table(spark, sf_dir, name).createOrReplaceTempView(name)


@query(
    "filter_project_rename",
    "SELECT o_orderkey AS order_id, o_totalprice * 1.1::DOUBLE AS gross FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 100000",
)
def _(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").where("o_orderstatus = 'F' AND o_totalprice > 100000")
    return orders.select(
        F.col("o_orderkey").alias("order_id"), (F.col("o_totalprice") * F.lit(1.1)).alias("gross")
    )


@query("limit_of_ordered", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 100")
def _(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice").orderBy(
        F.desc("o_totalprice"), "o_orderkey"
    ).limit(100)


@query(
    "union_all",
    "SELECT n_nationkey AS key, n_name AS name FROM nation UNION ALL SELECT r_regionkey, r_name FROM region"
    " UNION ALL SELECT n_nationkey, n_name FROM nation",
)
def _(spark, sf_dir):
    nations = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("key"), F.col("n_name").alias("name"))
    regions = table(spark, sf_dir, "region").select("r_regionkey", "r_name")
    return relational.union_all([nations, regions, nations])


@query("count_by_value", "SELECT event_type AS class, count(*) AS count FROM events GROUP BY event_type")
def _(spark, sf_dir):
    return relational.count_by(table(spark, sf_dir, "events"), "event_type", "class")


@query(
    "group_by_several_keys",
    "SELECT l_returnflag, l_linestatus, count(*) AS n, CAST(sum(CAST(l_extendedprice * (1 - l_discount) AS DECIMAL(18, 4))) AS DOUBLE) AS revenue,"
    " max(l_shipdate) AS last_shipped FROM lineitem GROUP BY ALL",
)
def _(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(
        F.count("*").alias("n"),
        F.sum((F.col("l_extendedprice") * (1 - F.col("l_discount"))).cast("decimal(18,4)")).cast("double").alias("revenue"),
        F.max("l_shipdate").alias("last_shipped"),
    )


@query("count_distinct_groups", "SELECT count(DISTINCT strlen(props)) AS n_groups FROM events")
def _(spark, sf_dir):
    return relational.count_groups(table(spark, sf_dir, "events"), "length(props)")


@query("cached_reuse", "SELECT lang, count(*) AS n, max(n_chars) AS longest FROM documents GROUP BY lang")
def _(spark, sf_dir):
    documents = table(spark, sf_dir, "documents").select("lang", "n_chars").cache()
    try:
        counts = documents.groupBy("lang").agg(F.count("*").alias("n"))
        joined = counts.join(documents.groupBy("lang").agg(F.max("n_chars").alias("longest")), on="lang")
        path = scratch_dir(spark, "reused")
        joined.write.parquet(path)
        return spark.read.schema(joined.schema).parquet(path)
    finally:
        documents.unpersist()


@query(
    "cast_key_value",
    "SELECT CAST(event_id AS VARCHAR) AS key, props AS value FROM events",
)
def _(spark, sf_dir):
    raw = table(spark, sf_dir, "events").select(
        F.col("event_id").cast("string").cast("binary").alias("key"), F.col("props").cast("binary").alias("value")
    )
    return relational.cast_kv(raw)


@query(
    "records_to_json",
    "SELECT '{\"event_id\":' || event_id || ',\"user_id\":' || user_id || ',\"event_type\":\"' || event_type || '\"}' AS value FROM events",
)
def _(spark, sf_dir):
    return relational.records_to_json(table(spark, sf_dir, "events").select("event_id", "user_id", "event_type"))


@query(
    "view_and_sql_text",
    "SELECT r_name, count(*) AS nations FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY r_name",
)
def _(spark, sf_dir):
    _views(spark, sf_dir, "nation", "region")
    return spark.sql("SELECT r_name, count(*) AS nations FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY r_name")


# Statements that Spark and the oracle both understand, by name.
_SCRIPTS = {
    "script_pricing_summary": (
        ["lineitem"],
        """
        SELECT l_returnflag, l_linestatus, sum(l_quantity) AS sum_qty, round(sum(l_extendedprice), 2) AS sum_base,
               CAST(sum(CAST(l_extendedprice * (1 - l_discount) AS DECIMAL(18, 4))) AS DOUBLE) AS sum_disc,
               CAST(sum(CAST(l_extendedprice * (1 - l_discount) * (1 + l_tax) AS DECIMAL(18, 6))) AS DOUBLE) AS sum_charge,
               avg(l_quantity) AS avg_qty, CAST(sum(CAST(l_discount AS DECIMAL(10, 2))) AS DOUBLE) / count(*) AS avg_disc, count(*) AS n
        FROM lineitem WHERE l_shipdate <= DATE '2000-09-02' GROUP BY l_returnflag, l_linestatus""",
    ),
    "script_shipping_priority": (
        ["customer", "orders", "lineitem"],
        """
        SELECT l_orderkey, CAST(sum(CAST(l_extendedprice * (1 - l_discount) AS DECIMAL(18, 4))) AS DOUBLE) AS revenue, o_orderdate
        FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey
        WHERE c_mktsegment = 'BUILDING' AND o_orderdate < TIMESTAMP '1998-03-15 00:00:00' GROUP BY l_orderkey, o_orderdate""",
    ),
    "script_local_supplier_volume": (
        ["customer", "orders", "lineitem", "supplier", "nation", "region"],
        """
        SELECT n_name, CAST(sum(CAST(l_extendedprice * (1 - l_discount) AS DECIMAL(18, 4))) AS DOUBLE) AS revenue
        FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey
             JOIN supplier ON l_suppkey = s_suppkey AND c_nationkey = s_nationkey
             JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
        WHERE r_name = 'ASIA' GROUP BY n_name""",
    ),
    "script_discounted_revenue": (
        ["lineitem"],
        """
        SELECT CAST(sum(CAST(l_extendedprice * l_discount AS DECIMAL(18, 4))) AS DOUBLE) AS revenue FROM lineitem
        WHERE l_discount BETWEEN 0.05 AND 0.07 AND l_quantity < 24""",
    ),
    "script_large_orders": (
        ["orders", "lineitem", "customer"],
        """
        SELECT c_name, o_orderkey, o_totalprice, sum(l_quantity) AS quantity
        FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON o_orderkey = l_orderkey
        WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem GROUP BY l_orderkey HAVING sum(l_quantity) > 150)
        GROUP BY c_name, o_orderkey, o_totalprice""",
    ),
    "script_ranked_customers": (
        ["customer", "nation"],
        """
        SELECT n_name, c_custkey, c_acctbal, place FROM (
            SELECT n_name, c_custkey, c_acctbal,
                   CAST(row_number() OVER (PARTITION BY n_name ORDER BY c_acctbal DESC, c_custkey) AS INT) AS place
            FROM customer JOIN nation ON c_nationkey = n_nationkey) ranked
        WHERE place <= 5""",
    ),
    "script_cube_of_flags": (
        ["lineitem"],
        """
        SELECT l_returnflag, l_linestatus, count(*) AS n, sum(l_quantity) AS quantity
        FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)""",
    ),
    "script_customers_without_urgent_orders": (
        ["customer", "orders"],
        """
        SELECT c_mktsegment, count(*) AS n FROM customer
        WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT') GROUP BY c_mktsegment""",
    ),
}


def _register(name: str, tables: list[str], sql: str, how: int) -> None:
    """Run the script in one of the three forms: plain text, base64 text, file."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        _views(spark, sf_dir, *tables)
        script = f"-- prepared; the result is last\nCREATE OR REPLACE TEMPORARY VIEW script_note AS SELECT 'a;b' AS note;\n{sql};\n"
        if how == 0:
            return relational.run_statements(spark, [script])
        if how == 1:
            return relational.run_statements(spark, [base64.b64encode(script.encode()).decode()], base64=True)
        path = f"{scratch_dir(spark, 'script')}.sql"
        from lakework.sources.hadoop import write_text_once

        write_text_once(spark, path, script)
        return relational.run_statements(spark, path=path)

    query(name, sql)(run)


for _i, (_name, (_tables, _sql)) in enumerate(_SCRIPTS.items()):
    _register(_name, _tables, _sql, _i % 3)


@query(
    "script_with_blocks",
    """
WITH steps AS (SELECT 250.0 * k AS least FROM range(0, 1000) t(k)),
chosen AS (SELECT min(least) AS least FROM steps WHERE (SELECT count(*) FROM customer WHERE c_acctbal > steps.least) <= (SELECT count(*) FROM customer) / 10)
SELECT c_mktsegment, count(*) AS n, max(c_acctbal) AS highest, CAST(count(*) > 0 AS BOOLEAN) AS filled FROM customer, chosen WHERE c_acctbal > least GROUP BY c_mktsegment
""",
)
def _(spark, sf_dir):
    """A compound block: variables, a loop until a tenth of the customers are left, a branch, a handler."""
    _views(spark, sf_dir, "customer")
    script = """
-- the block is one statement; its inner semicolons do not cut it
CREATE OR REPLACE TEMPORARY VIEW customer_view AS SELECT *, 'a;b' AS note FROM customer;
BEGIN
  DECLARE least DOUBLE DEFAULT 0;
  DECLARE wanted, found BIGINT;
  DECLARE EXIT HANDLER FOR SQLEXCEPTION BEGIN SELECT 'failed; ' AS c_mktsegment, 0L AS n, 0D AS highest, false AS filled; END;
  SET wanted = (SELECT count(*) DIV 10 FROM customer_view);
  SET found = (SELECT count(*) FROM customer_view WHERE c_acctbal > least);
  again: WHILE found > wanted DO
    SET least = least + 250;
    SET found = (SELECT count(CASE WHEN c_acctbal > least THEN 1 END) FROM customer_view);
  END WHILE again;
  IF found < 0 THEN SELECT 'none' AS c_mktsegment, 0L AS n, 0D AS highest, false AS filled;
  ELSE
    SELECT c_mktsegment, count(*) AS n, max(c_acctbal) AS highest, if(count(*) > 0, true, false) AS filled FROM customer_view WHERE c_acctbal > least GROUP BY c_mktsegment;
  END IF;
END;
"""
    return relational.run_statements(spark, [script])


_SHARES = (0.1, 0.5, 0.9)


@query(
    "quantile_sketches_by_day",
    """
WITH e AS (SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS day, value FROM events)
SELECT day, count(value) AS n, TRUE AS holds FROM e GROUP BY day UNION ALL SELECT 'all', count(value), TRUE FROM events
""",
)
def _(spark, sf_dir):
    """Sketches are kept by day and merged to one of all days; every quantile is held against exact ranks, within 0.02."""
    root = scratch_dir(spark, "sketches")
    events = table(spark, sf_dir, "events").select(F.date_format("ts", "yyyy-MM-dd").alias("day"), "value")
    quantiles.quantile_sketches(events, "value", ["day"]).write.parquet(root)
    by_day = spark.read.parquet(root)
    told = by_day.unionByName(quantiles.merge_sketches(by_day).withColumn("day", F.lit("all")))
    told = told.select("day", F.kll_sketch_get_n_double("sketch").alias("n"), quantiles.sketch_quantiles(_SHARES).alias("q"))
    values = events.unionAll(events.withColumn("day", F.lit("all")))
    ranks = values.join(told, "day").groupBy("day", "n").agg(
        *[F.avg((F.col("value") < F.col("q")[i]).cast("int")).alias(f"below_{i}") for i in range(len(_SHARES))],
        *[F.avg((F.col("value") <= F.col("q")[i]).cast("int")).alias(f"upto_{i}") for i in range(len(_SHARES))],
    )
    holds = F.lit(True)
    for i, p in enumerate(_SHARES):
        holds = holds & (F.col(f"below_{i}") <= p + 0.02) & (F.col(f"upto_{i}") >= p - 0.02)
    return ranks.select("day", "n", holds.alias("holds"))
