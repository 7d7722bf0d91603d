"""Change-feed queries: a feed made of orders, customers, nations and regions, and the tables it leaves."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakework.operators import changes, upsert
from lakework.operators.changes import ORDER_COLUMNS, TypeOptions
from lakework.operators.relational import union_all
from lakework.plans.registry import query, table
from lakework.session import scratch_dir
from lakework.streaming import feed, jobs, winners

_T0 = 1_700_000_000

_ORDER_FIELDS = [
    ("o_orderkey", 8), ("o_custkey", 3), ("o_orderstatus", 253), ("o_totalprice", 246), ("o_orderdate", 12), ("o_orderpriority", 254),
]
_CUSTOMER_FIELDS = [
    ("c_custkey", 8), ("c_name", 15), ("c_nationkey", 3), ("c_acctbal", 5), ("c_mktsegment", 247),
]


def _fields(fields: list[tuple[str, int]], decimal_text: str | None = None):
    """The field list of an envelope; decimals state the digits of their own text."""
    whole = F.length(F.regexp_replace(decimal_text, "[^0-9]", "")).cast("int") if decimal_text else None
    items = []
    for name, kind in fields:
        digits = whole if kind == 246 else F.lit(None).cast("int")
        scale = F.lit(2) if kind == 246 else F.lit(None).cast("int")
        items.append(
            F.struct(F.lit(name).alias("name"), F.lit(kind).alias("type"), digits.alias("precision"), scale.alias("scale"))
        )
    return F.array(*items)


def _image(**values):
    pairs = [part for name, value in values.items() for part in (F.lit(name), value.cast("string"))]
    return F.create_map(*pairs)


def _record(op: str, step: int, name: str, key, pk: list[str], fields, before, after):
    nothing = F.lit(None).cast("map<string,string>")
    return [
        F.lit(op).alias("op"),
        F.lit(_T0 + step).cast("long").alias("source_ts"),
        (key.cast("long") * 8 + step).alias("seq"),
        F.lit(name).alias("object_name"),
        (F.array(*[F.lit(k) for k in pk]) if pk else F.array().cast("array<string>")).alias("pk"),
        fields.alias("fields"),
        (nothing if before is None else before).alias("before"),
        (nothing if after is None else after).alias("after"),
    ]


def change_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Envelope rows.

    Every order is inserted. Finished orders get one added to their price, urgent
    pending ones move to a negative key, and low-priority ones are deleted. Customers
    in debt are set to zero. Nations come without a primary key, regions as commits.
    """
    orders = table(spark, sf_dir, "orders").withColumns(
        {
            "price": F.format_string("%.2f", "o_totalprice"),
            "raised": F.format_string("%.2f", F.col("o_totalprice") + 1),
            "day": F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss"),
        }
    )

    def order(key, price):
        return _image(
            o_orderkey=key, o_custkey=F.col("o_custkey"), o_orderstatus=F.col("o_orderstatus"), o_totalprice=F.col(price),
            o_orderdate=F.col("day"), o_orderpriority=F.col("o_orderpriority"),
        )

    key = F.col("o_orderkey")
    moved_key = -key - 1
    fields, raised = _fields(_ORDER_FIELDS, "price"), _fields(_ORDER_FIELDS, "raised")
    first, second, moved = order(key, "price"), order(key, "raised"), order(moved_key, "price")
    low, finished = F.col("o_orderpriority") == "5-LOW", F.col("o_orderstatus") == "F"
    urgent = (F.col("o_orderpriority") == "1-URGENT") & (F.col("o_orderstatus") == "P")
    name, pk = "shop.orders", ["o_orderkey"]
    customers = table(spark, sf_dir, "customer")

    def customer(balance):
        return _image(
            c_custkey=F.col("c_custkey"), c_name=F.col("c_name"), c_nationkey=F.col("c_nationkey"), c_acctbal=balance,
            c_mktsegment=F.col("c_mktsegment"),
        )

    c_key, c_fields, c_pk = F.col("c_custkey"), _fields(_CUSTOMER_FIELDS), ["c_custkey"]
    held = customer(F.col("c_acctbal"))
    nation = _image(n_nationkey=F.col("n_nationkey"), n_name=F.col("n_name"))
    n_fields = _fields([("n_nationkey", 3), ("n_name", 253)])
    region = _image(r_regionkey=F.col("r_regionkey"))
    return union_all(
        [
            orders.select(*_record("INSERT", 1, name, key, pk, fields, None, first)),
            orders.where(finished).select(*_record("UPDATE", 2, name, key, pk, raised, first, second)),
            orders.where(urgent).select(*_record("UPDATE", 3, name, key, pk, fields, first, moved)),
            orders.where(low & ~finished).select(*_record("DELETE", 4, name, key, pk, fields, first, None)),
            orders.where(low & finished).select(*_record("DELETE", 4, name, key, pk, raised, second, None)),
            customers.select(*_record("INSERT", 1, "crm.eu.customer", c_key, c_pk, c_fields, None, held)),
            customers.where("c_acctbal < 0").select(
                *_record("UPDATE", 2, "crm.eu.customer", c_key, c_pk, c_fields, held, customer(F.lit(0.0)))
            ),
            table(spark, sf_dir, "nation").select(
                *_record("INSERT", 1, "crm.nation", F.col("n_nationkey"), [], n_fields, None, nation)
            ),
            table(spark, sf_dir, "region").select(
                *_record("COMMIT", 1, "crm.region", F.col("r_regionkey"), ["r_regionkey"], n_fields, None, region)
            ),
        ]
    )


def change_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The records as JSON bytes, spread by position as over the partitions of a topic."""
    return changes.encode_envelope(_spread(change_records(spark, sf_dir)))


def _spread(records: DataFrame) -> DataFrame:
    return records.repartition(records.sparkSession.sparkContext.defaultParallelism, "seq")


def _states(spark: SparkSession, sf_dir: str) -> DataFrame:
    return changes.prepare(changes.decode_envelope(change_feed(spark, sf_dir)))[0]


# The same records in SQL: operation, step, key, name, key column, price or balance.
_RECORDS = f"""
SELECT 'INSERT' AS op, 1 AS step, o_orderkey AS k, 'shop.orders' AS object_name, 'o_orderkey' AS pk, o_orderkey AS id, o_totalprice AS amount FROM orders
UNION ALL SELECT 'UPDATE', 2, o_orderkey, 'shop.orders', 'o_orderkey', o_orderkey, o_totalprice + 1 FROM orders WHERE o_orderstatus = 'F'
UNION ALL SELECT 'UPDATE', 3, o_orderkey, 'shop.orders', 'o_orderkey', -o_orderkey - 1, o_totalprice FROM orders WHERE o_orderpriority = '1-URGENT' AND o_orderstatus = 'P'
UNION ALL SELECT 'DELETE', 4, o_orderkey, 'shop.orders', 'o_orderkey', o_orderkey, CASE WHEN o_orderstatus = 'F' THEN o_totalprice + 1 ELSE o_totalprice END FROM orders WHERE o_orderpriority = '5-LOW'
UNION ALL SELECT 'INSERT', 1, c_custkey, 'crm.eu.customer', 'c_custkey', c_custkey, c_acctbal FROM customer
UNION ALL SELECT 'UPDATE', 2, c_custkey, 'crm.eu.customer', 'c_custkey', c_custkey, 0.0 FROM customer WHERE c_acctbal < 0
UNION ALL SELECT 'INSERT', 1, n_nationkey, 'crm.nation', '', n_nationkey, NULL FROM nation
UNION ALL SELECT 'COMMIT', 1, r_regionkey, 'crm.region', 'r_regionkey', r_regionkey, NULL FROM region
"""

_FINAL_ORDERS = """
SELECT CASE WHEN o_orderpriority = '1-URGENT' AND o_orderstatus = 'P' THEN -o_orderkey - 1 ELSE o_orderkey END AS o_orderkey,
       CAST(o_custkey AS INTEGER) AS o_custkey, o_orderstatus,
       round(CASE WHEN o_orderstatus = 'F' THEN o_totalprice + 1 ELSE o_totalprice END, 2) AS o_totalprice,
       strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS o_orderdate, o_orderpriority
FROM orders WHERE o_orderpriority <> '5-LOW'
"""

_FINAL_CUSTOMERS = """
SELECT c_custkey, c_name, c_nationkey, greatest(c_acctbal, 0.0) AS c_acctbal, c_mktsegment FROM customer
"""


def _plain_orders(df: DataFrame) -> DataFrame:
    return df.select(
        "o_orderkey", "o_custkey", "o_orderstatus", F.round(F.col("o_totalprice").cast("double"), 2).alias("o_totalprice"),
        F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss").alias("o_orderdate"), "o_orderpriority",
    )


@query(
    "feed_decode_envelope",
    f"SELECT op, CAST({_T0} + step AS BIGINT) AS source_ts, k * 8 + step AS seq, object_name, pk FROM ({_RECORDS})",
)
def _(spark, sf_dir):
    decoded = changes.decode_envelope(change_feed(spark, sf_dir))
    return decoded.select("op", "source_ts", "seq", "object_name", F.array_join("pk", ",").alias("pk"))


@query(
    "feed_row_changes",
    f"SELECT op, object_name, count(*) AS n FROM ({_RECORDS}) WHERE op IN ('INSERT', 'UPDATE', 'DELETE') GROUP BY ALL",
)
def _(spark, sf_dir):
    kept = changes.row_changes(changes.decode_envelope(change_feed(spark, sf_dir)))
    return kept.groupBy("op", "object_name").agg(F.count("*").alias("n"))


@query(
    "feed_without_key",
    f"SELECT object_name, k * 8 + step AS seq FROM ({_RECORDS}) WHERE op IN ('INSERT', 'UPDATE', 'DELETE') AND pk = ''",
)
def _(spark, sf_dir):
    _, rejected = changes.prepare(changes.decode_envelope(change_feed(spark, sf_dir)))
    return rejected.select("object_name", "seq")


@query(
    "feed_meta_columns",
    f"""
SELECT CAST(({_T0} + step) * 1000::BIGINT AS BIGINT) AS source_timestamp, op AS operation, split_part(object_name, '.', 1) AS db_name,
       split_part(object_name, '.', -1) AS table_name, pk AS tbl_pks, op = 'DELETE' AS _is_deleted, k * 8 + step AS seq
FROM ({_RECORDS}) WHERE op IN ('INSERT', 'UPDATE', 'DELETE') AND pk <> ''
""",
)
def _(spark, sf_dir):
    kept, _ = changes.require_pk(changes.row_changes(changes.decode_envelope(change_feed(spark, sf_dir))))
    return changes.with_meta(kept).select(
        "source_timestamp", "operation", "db_name", "table_name", "tbl_pks", "_is_deleted", "seq"
    )


@query(
    "feed_row_image",
    f"""
SELECT seq, id, _is_deleted FROM (
  SELECT k * 8 + step AS seq, id, op = 'DELETE' AS _is_deleted FROM ({_RECORDS}) WHERE object_name = 'shop.orders'
  UNION ALL SELECT k * 8 + step, k, true FROM ({_RECORDS}) WHERE object_name = 'shop.orders' AND step = 3)
""",
)
def _(spark, sf_dir):
    orders = _states(spark, sf_dir).where("table_name = 'orders'")
    return orders.select("seq", F.expr("image['o_orderkey']").cast("long").alias("id"), "_is_deleted")


_SIX = "strlen(replace(printf('%.2f', o_totalprice + CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END), '.', ''))"


@query(
    "feed_table_types",
    f"""
WITH d AS (SELECT max(greatest(strlen(replace(printf('%.2f', o_totalprice), '.', '')), {_SIX})) AS digits FROM orders)
SELECT 'shop.orders' AS name, c AS column_name, t AS column_type FROM d, (VALUES ('o_orderkey', 'bigint'), ('o_custkey', 'int'),
  ('o_orderstatus', 'string'), ('o_totalprice', NULL), ('o_orderdate', 'timestamp'), ('o_orderpriority', 'string')) v(c, t) WHERE t IS NOT NULL
UNION ALL SELECT 'shop.orders', 'o_totalprice', 'decimal(' || ((digits // 10 + 1) * 10) || ',2)' FROM d
UNION ALL SELECT 'crm.customer', c, t FROM (SELECT count(*) AS n FROM customer) s, (VALUES ('c_custkey', 'bigint'), ('c_name', 'string'),
  ('c_nationkey', 'int'), ('c_acctbal', 'double'), ('c_mktsegment', 'string')) v(c, t) WHERE s.n > 0
""",
)
def _(spark, sf_dir):
    shapes = changes.table_shapes(_states(spark, sf_dir))
    rows = [(f"{s.db}.{s.table}", name, kind.simpleString()) for s in shapes for name, _, kind in s.columns]
    return spark.createDataFrame(rows, "name string, column_name string, column_type string")


def _typed(spark: SparkSession, sf_dir: str, options: TypeOptions) -> DataFrame:
    states = _states(spark, sf_dir)
    shape = next(s for s in changes.table_shapes(states, options) if s.table == "orders")
    return changes.typed_rows(states, shape, options)


_STATES = f"""
SELECT k, op, step, id, amount FROM ({_RECORDS}) WHERE object_name = 'shop.orders'
UNION ALL SELECT k, 'DELETE', step, k, amount FROM ({_RECORDS}) WHERE object_name = 'shop.orders' AND step = 3
"""


@query(
    "feed_typed_rows",
    f"""
SELECT id AS o_orderkey, CAST(o_custkey AS INTEGER) AS o_custkey, round(amount, 2) AS o_totalprice, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS o_orderdate,
       k * 8 + step AS _order_seq, op = 'DELETE' AS _is_deleted FROM ({_STATES}) JOIN orders ON k = orders.o_orderkey
""",
)
def _(spark, sf_dir):
    return _typed(spark, sf_dir, TypeOptions()).select(
        "o_orderkey", "o_custkey", F.round(F.col("o_totalprice").cast("double"), 2).alias("o_totalprice"),
        F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss").alias("o_orderdate"), "_order_seq", "_is_deleted",
    )


@query(
    "feed_all_to_string",
    f"""
SELECT CAST(id AS VARCHAR) AS o_orderkey, printf('%.2f', amount) AS o_totalprice, CAST(epoch_ms(o_orderdate) AS VARCHAR) AS o_orderdate,
       o_orderpriority, k * 8 + step AS _order_seq FROM ({_STATES}) JOIN orders ON k = orders.o_orderkey
""",
)
def _(spark, sf_dir):
    rows = _typed(spark, sf_dir, TypeOptions(all_to_string=True))
    return rows.select("o_orderkey", "o_totalprice", "o_orderdate", "o_orderpriority", "_order_seq")


@query(
    "feed_decimal_to_string",
    f"SELECT id AS o_orderkey, printf('%.2f', amount) AS o_totalprice, k * 8 + step AS _order_seq FROM ({_STATES})",
)
def _(spark, sf_dir):
    rows = _typed(spark, sf_dir, TypeOptions(decimal_to_string=True))
    return rows.select("o_orderkey", "o_totalprice", "_order_seq")


@query(
    "feed_latest_per_key",
    f"""
SELECT id AS o_orderkey, op = 'DELETE' AS _is_deleted, k * 8 + step AS _order_seq, round(amount, 2) AS o_totalprice FROM ({_STATES})
QUALIFY row_number() OVER (PARTITION BY id ORDER BY step DESC) = 1
""",
)
def _(spark, sf_dir):
    latest = changes.latest_per_key(_typed(spark, sf_dir, TypeOptions()), ["o_orderkey"], ORDER_COLUMNS)
    return latest.select(
        "o_orderkey", "_is_deleted", "_order_seq", F.round(F.col("o_totalprice").cast("double"), 2).alias("o_totalprice")
    )


@query(
    "feed_record_key",
    "SELECT l_orderkey, l_linenumber, l_orderkey || ',' || l_linenumber AS record_key, count(*) AS n FROM lineitem GROUP BY ALL",
)
def _(spark, sf_dir):
    items = table(spark, sf_dir, "lineitem")
    return (
        items.withColumn("record_key", changes.record_key(["l_orderkey", "l_linenumber"]))
        .groupBy("l_orderkey", "l_linenumber", "record_key")
        .agg(F.count("*").alias("n"))
    )


def _in_batches(spark: SparkSession, sf_dir: str, **settings) -> DataFrame:
    """Apply the feed in three batches, by step, and read the orders back."""
    root = scratch_dir(spark, "tables")
    config = feed.CdcConfig(base_path=root, **settings)
    records = change_records(spark, sf_dir)
    steps = [F.col("source_ts") == _T0 + 1, F.col("source_ts").between(_T0 + 2, _T0 + 3), F.col("source_ts") > _T0 + 3]
    for batch_id, step in enumerate(steps):
        feed.apply_batch(changes.encode_envelope(_spread(records.where(step))), batch_id, config)
    return _plain_orders(upsert.read_upsert_table(spark, f"{root}/shop/orders"))


@query("feed_upsert_copy_on_write", _FINAL_ORDERS)
def _(spark, sf_dir):
    return _in_batches(spark, sf_dir, table_type=upsert.COPY_ON_WRITE)


@query("feed_upsert_merge_on_read", _FINAL_ORDERS)
def _(spark, sf_dir):
    return _in_batches(spark, sf_dir, table_type=upsert.MERGE_ON_READ)


@query("feed_upsert_compacted", _FINAL_ORDERS)
def _(spark, sf_dir):
    return _in_batches(spark, sf_dir, table_type=upsert.MERGE_ON_READ, max_delta_commits=2)


@query(
    "feed_upsert_event_time",
    """
SELECT o_orderkey, round(CASE WHEN o_orderstatus = 'F' THEN o_totalprice + 1 ELSE o_totalprice END, 2) AS o_totalprice FROM orders
""",
)
def _(spark, sf_dir):
    """The later state arrives first; the older batch must not undo it."""
    path = f"{scratch_dir(spark, 'tables')}/shop/orders"
    orders = table(spark, sf_dir, "orders")
    older = orders.select("o_orderkey", "o_totalprice", F.lit(1).cast("long").alias("_order_ts"))
    newer = orders.where("o_orderstatus = 'F'").select(
        "o_orderkey", (F.col("o_totalprice") + 1).alias("o_totalprice"), F.lit(2).cast("long").alias("_order_ts")
    )
    for batch in (newer, older):
        upsert.upsert_table(batch, path, ["o_orderkey"], "_order_ts", ordering="event_time")
    return upsert.read_upsert_table(spark, path).withColumn("o_totalprice", F.round("o_totalprice", 2))


@query("feed_stream_job", _FINAL_CUSTOMERS)
def _(spark, sf_dir):
    root = scratch_dir(spark, "job")
    change_feed(spark, sf_dir).write.parquet(f"{root}/feed")
    source = jobs.read_stream(spark, "parquet", f"{root}/feed", "value binary", maxFilesPerTrigger="4")
    config = feed.CdcConfig(base_path=f"{root}/tables", trigger=None, ordering="event_time", max_delta_commits=2)
    feed.run_cdc(source, config, f"{root}/checkpoint").awaitTermination()
    return upsert.read_upsert_table(spark, f"{root}/tables/crm/customer").select(
        "c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"
    )


@query("feed_catalog_sync", "SELECT c_mktsegment, count(*) AS n, round(sum(c_acctbal), 2) AS total FROM customer GROUP BY c_mktsegment")
def _(spark, sf_dir):
    path = f"{scratch_dir(spark, 'tables')}/crm/customer"
    customers = table(spark, sf_dir, "customer").withColumn("_order_ts", F.lit(1).cast("long"))
    upsert.upsert_table(customers, path, ["c_custkey"], "_order_ts")
    name = upsert.sync_table(spark, "lakework_sync", "customer", path)
    return spark.sql(f"SELECT c_mktsegment, count(*) AS n, round(sum(c_acctbal), 2) AS total FROM {name} GROUP BY c_mktsegment")


@query(
    "upsert_table_save_modes",
    "SELECT s_suppkey, s_name, s_nationkey, s_acctbal FROM supplier WHERE s_acctbal >= 0",
)
def _(spark, sf_dir):
    """Saved, written over by itself with the debtors deleted, and read by path pattern."""
    path = f"{scratch_dir(spark, 'tables')}/supplier"
    suppliers = table(spark, sf_dir, "supplier").withColumn("_order_ts", F.lit(1).cast("long"))
    upsert.upsert_table(suppliers, path, ["s_suppkey"], "_order_ts", mode="overwrite")
    flagged = suppliers.withColumn("_is_deleted", F.col("s_acctbal") < 0)
    upsert.upsert_table(flagged, path, ["s_suppkey"], "_order_ts", mode="append")
    upsert.upsert_table(suppliers, path, ["s_suppkey"], "_order_ts", mode="ignore")
    return upsert.read_upsert_table(spark, f"{path}/*", merge_schema=True)


_LATE = """
SELECT o_orderkey, round(o_totalprice, 2) AS o_totalprice FROM orders WHERE o_orderkey % 3 <> 0
UNION ALL SELECT o_orderkey, round(o_totalprice + 7, 2) FROM orders WHERE o_orderkey % 9 = 0
"""


@query("feed_upsert_late_records", f"SELECT h.how, l.* FROM ({_LATE}) l, (VALUES ('one batch'), ('copy on write'), ('compacted')) h(how)")
def _(spark, sf_dir):
    """A third of the orders is deleted before its older inserts arrive; a ninth comes back later.

    One batch, copy on write and a compaction after every two deltas leave the same rows.
    """
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")

    def step(rows: DataFrame, at: int, gone: bool = False) -> DataFrame:
        return rows.withColumns({"_order_ts": F.lit(at).cast("long"), "_is_deleted": F.lit(gone)})

    third, ninth = orders.where("o_orderkey % 3 = 0"), orders.where("o_orderkey % 9 = 0")
    batches = [
        step(third, 5, gone=True), step(orders, 3), step(third, 1),
        step(ninth.withColumn("o_totalprice", F.col("o_totalprice") + 7), 8), step(third, 4),
    ]
    ways = {
        "one batch": ([union_all(batches)], {}),
        "copy on write": (batches, {}),
        "compacted": (batches, {"table_type": upsert.MERGE_ON_READ, "max_delta_commits": 2}),
    }
    out = []
    for how, (parts, settings) in ways.items():
        path = f"{scratch_dir(spark, 'tables')}/shop/orders"
        for part in parts:
            upsert.upsert_table(part, path, ["o_orderkey"], "_order_ts", ordering=upsert.EVENT_TIME, **settings)
        rows = upsert.read_upsert_table(spark, path)
        out.append(rows.select(F.lit(how).alias("how"), "o_orderkey", F.round("o_totalprice", 2).alias("o_totalprice")))
    return union_all(out)


@query("feed_two_checkpoints", _FINAL_CUSTOMERS)
def _(spark, sf_dir):
    """Two feeds into one table, each with its own checkpoint and so with its own batch numbers from zero."""
    root = scratch_dir(spark, "job")
    records = change_records(spark, sf_dir).where("object_name = 'crm.eu.customer'")
    config = feed.CdcConfig(base_path=f"{root}/tables", trigger=None)
    even = F.expr("cast(coalesce(after, before)['c_custkey'] AS bigint) % 2 = 0")
    for name, part in (("even", records.where(even)), ("odd", records.where(~even))):
        changes.encode_envelope(part).write.parquet(f"{root}/{name}")
        source = jobs.read_stream(spark, "parquet", f"{root}/{name}", "value binary")
        feed.run_cdc(source, config, f"{root}/checkpoint-{name}").awaitTermination()
    return upsert.read_upsert_table(spark, f"{root}/tables/crm/customer").select(
        "c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"
    )


# One column per type id of the feed: its text from the supplier's key ``k``, and the value in SQL.
_MATRIX: list[tuple[int, str, str]] = [
    *((i, "cast(k as string)", "CAST(k AS VARCHAR)") for i in (1, 2, 3, 9, 13, 16, 8)),
    (4, "concat(k, '.5')", "CAST(CAST(k + 0.5 AS DOUBLE) AS VARCHAR)"), (5, "concat(k, '.25')", "CAST(CAST(k + 0.25 AS DOUBLE) AS VARCHAR)"),
    *((i, "concat(k, '.75')", "printf('%.2f', k + 0.75)") for i in (0, 246)),
    *((i, "cast(k * 1000 + 7 as string)", "CAST(k * 1000 + 7 AS VARCHAR)") for i in (7, 17)),
    *((i, "format_string('20%02d-%02d-%02d', k % 100, k % 12 + 1, k % 28 + 1)", "CAST(epoch_ms(make_date(2000 + k % 100, k % 12 + 1, k % 28 + 1)) AS VARCHAR)") for i in (10, 14)),
    *((i, "concat(if(k % 2 = 0, '-', ''), k % 400, ':', format_string('%02d', k % 60), ':07.5')",
       "CAST((CASE WHEN k % 2 = 0 THEN -1 ELSE 1 END) * (((k % 400) * 60 + k % 60) * 60000 + 7500) AS VARCHAR)") for i in (11, 19)),
    *((i, "format_string('2001-%02d-%02d %02d:30:00.25', k % 12 + 1, k % 28 + 1, k % 24)",
       "CAST(epoch_ms(make_timestamp(2001, k % 12 + 1, k % 28 + 1, k % 24, 30, 0.25)) AS VARCHAR)") for i in (12, 18)),
    *((i, "concat('t', k)", "'t' || k") for i in (6, 15, 245, 247, 248, 249, 250, 251, 252, 253, 254, 255)),
]


@query(
    "feed_type_matrix",
    "WITH s AS (SELECT CAST(s_suppkey AS BIGINT) AS k FROM supplier)\n"
    + "\nUNION ALL ".join(f"SELECT {i}::INTEGER AS type_id, k, CASE WHEN k % 10 <> 0 THEN {want} END AS value FROM s" for i, _, want in _MATRIX),
)
def _(spark, sf_dir):
    """Every type id of the feed as a column; each tenth row has no value. Instants are shown in milliseconds."""
    source = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("long").alias("k"))
    names = ["k", *(f"c{i}" for i, _, _ in _MATRIX)]
    texts = [F.expr("cast(k as string)"), *(F.expr(f"if(k % 10 = 0, NULL, {text})") for _, text, _ in _MATRIX)]
    image = F.map_from_arrays(F.array(*[F.lit(n) for n in names]), F.array(*texts))
    fields = F.array(
        *[
            F.struct(
                F.lit(n).alias("name"), F.lit(i).alias("type"),
                F.lit(12 if i in (0, 246) else None).cast("int").alias("precision"), F.lit(2 if i in (0, 246) else None).cast("int").alias("scale"),
            )
            for n, i in zip(names, [8, *(i for i, _, _ in _MATRIX)])
        ]
    )
    records = source.select(*_record("INSERT", 1, "shop.matrix", F.col("k"), ["k"], fields, None, image))
    states = changes.prepare(changes.decode_envelope(changes.encode_envelope(records)))[0]
    (shape,) = changes.table_shapes(states)
    rows = changes.typed_rows(states, shape)
    kinds = dict(rows.dtypes)

    def shown(name: str):
        value = F.col(name).cast("timestamp") if kinds[name] in ("date", "timestamp") else F.col(name)
        return (F.unix_millis(value) if kinds[name] in ("date", "timestamp") else value.cast("double") if kinds[name] == "float" else value).cast("string")

    pairs = F.array(*[F.struct(F.lit(i).alias("type_id"), shown(f"c{i}").alias("value")) for i, _, _ in _MATRIX])
    return rows.select("k", F.inline(pairs)).select("type_id", "k", "value")


_URGENT = "o_orderpriority = '1-URGENT' AND o_orderstatus = 'P'"


def _deliver_orders(spark, sf_dir, root):
    """The orders' records in three runs of one stream and in the wrong order: deletes, then updates, then inserts."""
    records = change_records(spark, sf_dir).where("object_name = 'shop.orders'")
    steps = [F.col("source_ts") > _T0 + 3, F.col("source_ts").between(_T0 + 2, _T0 + 3), F.col("source_ts") == _T0 + 1]
    shape = next(s for s in changes.table_shapes(changes.prepare(changes.decode_envelope(changes.encode_envelope(records)))[0]) if s.table == "orders")
    for step in steps:
        part = changes.encode_envelope(records.where(step))
        part.write.mode("append").parquet(f"{root}/topic")
        stream = jobs.read_stream(spark, "parquet", f"{root}/topic", part.schema)
        rows = changes.typed_rows(changes.prepare(changes.decode_envelope(stream))[0], shape)
        winners.append_winners(rows, f"{root}/out", f"{root}/checkpoint", ["o_orderkey"]).awaitTermination()


@query(
    "feed_winning_changes",
    f"""
SELECT o_orderkey, o_orderpriority = '5-LOW' OR {_URGENT} AS deleted,
       CASE WHEN o_orderpriority <> '5-LOW' AND NOT ({_URGENT}) THEN round(CASE WHEN o_orderstatus = 'F' THEN o_totalprice + 1 ELSE o_totalprice END, 2) END AS price FROM orders
UNION ALL SELECT -o_orderkey - 1, FALSE, o_totalprice FROM orders WHERE {_URGENT}
""",
)
def _(spark, sf_dir):
    """Every record comes before the older ones it replaces, so each key has one winner and no late record wins."""
    root = scratch_dir(spark, "winners")
    _deliver_orders(spark, sf_dir, root)
    price = F.when(~F.col(changes.DELETED), F.round(F.col("o_totalprice").cast("double"), 2))
    return spark.read.parquet(f"{root}/out").select("o_orderkey", F.col(changes.DELETED).alias("deleted"), price.alias("price"))


@query("feed_current_rows", _FINAL_ORDERS)
def _(spark, sf_dir):
    """The table that the winners leave, without a table format."""
    root = scratch_dir(spark, "winners")
    _deliver_orders(spark, sf_dir, root)
    return _plain_orders(winners.current_rows(spark, f"{root}/out", ["o_orderkey"]))


@query(
    "feed_batch_reports",
    f"""
SELECT 0::BIGINT AS batch_id, 'shop' AS db, 'orders' AS "table", count(*) AS upserts, 0::BIGINT AS deletes FROM orders
UNION ALL SELECT 0, 'crm', 'customer', count(*), 0 FROM customer
UNION ALL SELECT 0, '', '', count(*), 0 FROM nation
UNION ALL SELECT 1, 'shop', 'orders', count_if(o_orderstatus = 'F') + count_if({_URGENT}), count_if({_URGENT}) FROM orders
UNION ALL SELECT 1, 'crm', 'customer', count(*), 0 FROM customer WHERE c_acctbal < 0
UNION ALL SELECT 2, 'shop', 'orders', 0, count(*) FROM orders WHERE o_orderpriority = '5-LOW'
""",
)
def _(spark, sf_dir):
    """What every batch reports of every table; records without a key are counted under no name."""
    config = feed.CdcConfig(base_path=scratch_dir(spark, "tables"))
    records = change_records(spark, sf_dir)
    steps = [F.col("source_ts") == _T0 + 1, F.col("source_ts").between(_T0 + 2, _T0 + 3), F.col("source_ts") > _T0 + 3]
    reports = [feed.apply_batch(changes.encode_envelope(_spread(records.where(step))), i, config) for i, step in enumerate(steps)]
    return union_all(reports).select("batch_id", "db", "table", "upserts", "deletes")


@query(
    "feed_decimal_definitions",
    "SELECT 'decimal(14,3)' AS kind, count(*) AS records, CAST(sum(CAST(o_totalprice AS DECIMAL(14, 3))) AS DOUBLE) AS total FROM orders",
)
def _(spark, sf_dir):
    """The digits of a column as the user defines them, in place of those that the records state."""
    inserts = change_records(spark, sf_dir).where(f"source_ts = {_T0 + 1}")
    states = changes.prepare(changes.decode_envelope(changes.encode_envelope(_spread(inserts))))[0]
    options = TypeOptions(decimals=changes.parse_decimal_defs("shop.orders:o_totalprice,14,3;o_other,5,2#customer:c_acctbal,9,1"))
    shape = next(s for s in changes.table_shapes(states, options) if s.table == "orders")
    rows = changes.typed_rows(states, shape, options)
    return rows.groupBy(F.typeof("o_totalprice").alias("kind")).agg(F.count("*").alias("records"), F.sum("o_totalprice").cast("double").alias("total"))
