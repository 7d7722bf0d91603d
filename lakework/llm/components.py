"""Connected components by alternating stars, each round a pair of joins and aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakework.session import drop_scratch, scratch_dir


def _least(edges: DataFrame) -> DataFrame:
    # The exchange between aggregate and join lets Spark split the join where one node has most edges.
    return edges.groupBy("u").agg(F.min("v").alias("m")).hint("rebalance")


def _mark(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return tuple(row)


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) of every node of an edge that is not a loop; the component is its least node.

    Large stars tie every larger neighbour of a node to the least one around it, small stars every
    smaller one; the edges become stars around the least nodes. Every round is a written
    table, and what a round has replaced is removed.
    """
    spark, places = edges.sparkSession, []

    def written(df: DataFrame) -> DataFrame:
        places.append(scratch_dir(spark, "edges"))
        df.write.parquet(places[-1])
        return spark.read.schema(df.schema).parquet(places[-1])

    u, v = F.col(a), F.col(b)
    now = written(edges.where(u != v).select(F.greatest(u, v).alias("u"), F.least(u, v).alias("v")).distinct())
    mark = _mark(now)
    while mark[0]:
        both = now.unionAll(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = (
            both.join(_least(both), "u").where(F.col("v") > F.col("u"))
            .select(F.col("v").alias("u"), F.least("u", "m").alias("v")).distinct()
        )
        large = written(large)
        least = _least(large)
        small = large.join(least, "u").where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = written(small.unionAll(least.select("u", F.col("m").alias("v"))).distinct())
        for place in places[:-1]:
            drop_scratch(spark, place)
        del places[:-1]
        before, mark = mark, _mark(now)
        if mark == before:
            break
    members = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return members.unionAll(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


class Forest:
    """Union-find over small local numbers."""

    def __init__(self, n: int) -> None:
        self.parent = list(range(n))

    def find(self, x: int) -> int:
        while self.parent[x] != x:
            self.parent[x] = self.parent[self.parent[x]]
            x = self.parent[x]
        return x

    def union(self, a: int, b: int) -> bool:
        a, b = self.find(a), self.find(b)
        if a == b:
            return False
        self.parent[max(a, b)] = min(a, b)
        return True
