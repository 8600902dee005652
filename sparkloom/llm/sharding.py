"""Sharding by extendible hashing, with DataFrame functions only.

A directory is indexed by leading bits of a hash of the row's key. A bucket whose bytes
exceed the limit splits on its next bit, others stay: a bucket is a shard when it fits and
its parent did not. Bytes are summed once per directory entry (partial aggregation), so
rows are never gathered; texts are not shuffled, only their sizes are. The directory has one
row for each value of its bits, which names the shard: a row finds its shard by one join.

The directory has depth bits, chosen from the total so that entries are about 1/16 of the
limit; entries that still exceed it have a directory of further bits of their own, in another
round. Rows of equal hash (rows of one id) that exceed the limit are dealt to pages: runs of
at most PAGE_ROWS rows, as they lie in the scan, are cut by themselves.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .textkernel import checkpoint

#: Bits of the hash that can be used; rows of equal hash that are cut in pages together.
MOST_BITS, PAGE_ROWS = 60, 4096


def key_hash(*columns: Column) -> Column:
    """60 bits of the MD5 of the columns' text, null as the empty text."""
    return F.conv(F.substring(F.md5(F.concat_ws("\x1f", *(F.coalesce(c.cast("string"), F.lit("")) for c in columns))), 1, 15), 16, 10).cast("long")


def bits_at(h: Column, depth: Column | int) -> Column:
    """The leading depth bits as a number."""
    shift = (F.lit(MOST_BITS) - depth).cast("int")
    return F.call_function("shiftright", h, shift)


def split_round(sizes: DataFrame, limit: int, low: int, high: int) -> DataFrame:
    """Leaves (depth, prefix, bytes, n_rows) among depths low..high of sizes (h: the leading high bits, bytes, n_rows).

    Rows at depth high that exceed the limit are left over for the next round.
    """
    levels = sizes.withColumn("depth", F.explode(F.sequence(F.lit(low), F.lit(high)))).withColumn("prefix", F.call_function("shiftright", F.col("h"), (F.lit(high) - F.col("depth")).cast("int")))
    nodes = levels.groupBy("depth", "prefix").agg(F.sum("bytes").alias("bytes"), F.sum("n_rows").alias("n_rows"))
    fits = F.col("bytes") <= limit
    parents = nodes.where(~fits).select((F.col("depth") + 1).alias("depth"), F.col("prefix").alias("parent"))
    leaves = nodes.where(fits | (F.col("depth") == high)).withColumn("parent", F.call_function("shiftright", F.col("prefix"), F.lit(1)))
    names = ("depth", "prefix", "bytes", "n_rows")
    found = leaves.join(parents, ["depth", "parent"], "left_semi").select(*names)
    return found.union(leaves.where(F.col("depth") == 0).select(*names)) if low == 0 else found


def directory(leaves: DataFrame, high: int) -> DataFrame:
    """One row for each value of the leading high bits that leaves cover: entry, depth, prefix, shard_bytes."""
    wide = (F.lit(high) - F.col("depth")).cast("int")
    first = F.call_function("shiftleft", F.col("prefix"), wide)
    last = first + F.call_function("shiftleft", F.lit(1).cast("long"), wide) - 1
    return leaves.select(F.explode(F.sequence(first, last)).alias("entry"), "depth", "prefix", F.col("bytes").alias("shard_bytes"))


def shard(docs: DataFrame, limit: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: doc_id, bytes, shard (depth:prefix, with :run:page where rows of one hash overflow), shard_bytes.

    A document's size is its text's UTF-8 length plus 64 bytes; null text has length 0. A document larger
    than the limit is alone with those whose hashes equal its own. Repeated rows have equal hashes:
    where they exceed the limit together they are dealt to pages that do not; a single row
    above the limit is in a page above it. Null ids hash as the empty text. An empty table gives no rows.
    """
    sized = checkpoint(
        docs.select(F.col(f"`{id_col}`").alias("doc_id"), (F.coalesce(F.octet_length(F.col(f"`{text_col}`")), F.lit(0)) + 64).cast("long").alias("bytes"), key_hash(F.col(f"`{id_col}`")).alias("h"), F.monotonically_increasing_id().alias("row"))
    )
    total = sized.agg(F.sum("bytes")).first()[0] or 0
    low, high = 0, min(MOST_BITS, max(4, math.ceil(math.log2(max(1, total / limit))) + 4))
    name = F.concat_ws(":", F.col("depth").cast("string"), F.col("prefix").cast("string"))
    out, over = None, F.col("shard_bytes") > limit
    while True:
        sizes = sized.groupBy(bits_at(F.col("h"), high).alias("h")).agg(F.sum("bytes").alias("bytes"), F.count("*").alias("n_rows"))
        leaves = checkpoint(split_round(sizes, limit, low, high))
        found = sized.join(directory(leaves, high), bits_at(F.col("h"), high) == F.col("entry"))
        fit = found.where(~over).select("doc_id", "bytes", name.alias("shard"), "shard_bytes")
        out = fit if out is None else out.union(fit)
        if leaves.where(F.col("bytes") > limit).isEmpty():
            return out
        if high == MOST_BITS:
            break
        sized = checkpoint(found.where(over).select("doc_id", "bytes", "h", "row"))
        low, high = high, min(MOST_BITS, high + 12)
    run = found.where(over).withColumn("run", F.floor(F.col("row") / PAGE_ROWS))
    own = Window.partitionBy("prefix", "run")
    rows = F.greatest(F.floor(F.lit(limit) / F.max("bytes").over(own)), F.lit(1))
    paged = run.withColumn("page", F.floor((F.row_number().over(own.orderBy("row")) - 1) / rows))
    paged = paged.withColumn("shard_bytes", F.sum("bytes").over(Window.partitionBy("prefix", "run", "page")))
    return out.union(paged.select("doc_id", "bytes", F.concat_ws(":", name, F.col("run").cast("string"), F.col("page").cast("string")).alias("shard"), "shard_bytes"))


def write_shards(docs: DataFrame, limit: int, path: str, id_col: str = "doc_id", text_col: str = "text") -> str:
    """Write docs as Parquet under path, a folder for each shard; returns the name of the folders' column.

    It is shard, with underscores before it where docs has such a column. All rows of an id go to one
    folder, the first of its shards by name, so only where an id repeats may a folder exceed the limit.
    """
    column = "shard"
    while column in {c.lower() for c in docs.columns}:
        column = f"_{column}"
    places = shard(docs, limit, id_col, text_col).groupBy(F.col("doc_id").alias("__id")).agg(F.min("shard").alias("__shard"))
    named = docs.join(places, F.col(f"`{id_col}`").eqNullSafe(F.col("__id"))).drop("__id").withColumnRenamed("__shard", column)
    named.repartition(column).write.partitionBy(column).parquet(path)
    return column
