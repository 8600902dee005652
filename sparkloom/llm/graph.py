"""Connected components by alternating large-star and small-star steps.

Every step is a group-by (with partial aggregation) and a join on node keys, so no
component is ever gathered in one task; the number of rounds is logarithmic. A node with
many neighbours is dealt to SALTS keys: the least of each is found, then the least of
these, which is joined back by node and salt.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .textkernel import checkpoint, sweep


#: Keys that the rows of one node or group are dealt to.
SALTS = 64


def salted(df: DataFrame, key: str, by: str, **totals: tuple) -> DataFrame:
    """df with totals of key added: aggregates of aggregates, given as column: (partial, merge) pairs.

    The rows of a key are dealt to SALTS keys by the hash of column by; no task needs all rows of a key.
    Rows are shuffled once; for each key and salt one row goes to the key and back.
    """
    dealt = df.withColumn("__salt", F.pmod(F.xxhash64(by), F.lit(SALTS)).cast("int")).repartition(key, "__salt")
    parts = dealt.groupBy(key, "__salt").agg(*(partial.alias(name) for name, (partial, _) in totals.items()))
    whole = Window.partitionBy(key)  # SALTS rows at most
    merged = parts.select(F.col(key).alias("__key"), F.col("__salt").alias("__part"), *(merge(F.col(name)).over(whole).alias(name) for name, (_, merge) in totals.items()))
    return dealt.join(merged, (F.col(key) == F.col("__key")) & (F.col("__salt") == F.col("__part"))).drop("__salt", "__key", "__part")


def components(edges: DataFrame) -> DataFrame:
    """(node, comp) for every node of edges (columns a, b): comp is the smallest node it reaches.

    Null ends, loops and repeated edges are ignored; no edges give no rows.
    """
    edges = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = salted(both, "u", "v", m=(F.min("v"), F.min)).withColumn("m", F.least("u", "m"))
        large = large.where("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("m"))  # a node with many lesser neighbours is rare after the step before
        small = large.join(least, F.col("u") == F.col("node"))
        edges = checkpoint(small.select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*").where("u <> v").distinct())
        ends = edges.select(F.explode(F.array(F.struct(F.col("u").alias("node"), F.lit(1).alias("child")), F.struct(F.col("v").alias("node"), F.lit(0).alias("child")))).alias("e")).select("e.*")
        # done when every node is a root or the child of one root
        apart = ends.groupBy("node").agg(F.sum("child").alias("n"), F.min("child").alias("root")).where("n > 1 OR (n = 1 AND root = 0)").isEmpty()
        both = large = least = small = ends = None
        sweep(edges.sparkSession)
        if apart:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("comp")).union(edges.select(F.col("v").alias("node"), F.col("v").alias("comp")).distinct())
