"""Greedy packing of records into chunks within a budget of tokens, without going through a group record by record.

Where a chunk that begins at a record ends depends on that record alone, so every record gets a link to the record that
would begin the next chunk. Prefix sums give the links: sums of blocks of records first, then within the blocks. The
link of a record is the first one whose prefix sum is beyond the record's own start by more than the budget; it is looked
for in buckets of the token line, each bucket a window of its own, else it is the first record of the next bucket that
has any. The chunks are what is reached from the first record over links, found by doubling the links: a round for each
power of two, so a group of a million chunks takes twenty rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.session import written

#: Records of a block of prefix sums.
BLOCK = 4096


def budget(most: int, header: int = 0, footer: int = 0) -> int:
    """What is left for records: a header and a footer cost their tokens and two each."""
    return most - sum(n + 2 for n in (header, footer) if n)


def prefix_sums(records: DataFrame, block: int = BLOCK) -> DataFrame:
    """records (k, place, cost) with start and end: the costs before the record, and up to it; places count from 0."""
    r = records.withColumn("block", F.floor(F.col("place") / block))
    before = F.coalesce(F.sum("s").over(Window.partitionBy("k").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    blocks = r.groupBy("k", "block").agg(F.sum("cost").alias("s")).select("k", "block", before.alias("before"))
    r = r.withColumn("inside", F.sum("cost").over(Window.partitionBy("k", "block").orderBy("place"))).join(blocks, ["k", "block"])
    end = F.col("before") + F.col("inside")
    return r.select("k", "place", "cost", (end - F.col("cost")).alias("start"), end.alias("end"))


def _links(p: DataFrame, most: int) -> DataFrame:
    """(k, place, to): the first record whose end is beyond a record's start by more than `most`; none at a group's end."""
    width = max(1, most)
    ends = p.select("k", F.floor(F.col("end") / width).alias("bucket"), F.col("end").alias("at"), F.lit(1).alias("kind"), "place", F.lit(None).cast("long").alias("of"))
    asks = p.select("k", F.floor((F.col("start") + most) / width).alias("bucket"), (F.col("start") + most).alias("at"), F.lit(0).alias("kind"), F.lit(None).cast("long").alias("place"), F.col("place").alias("of"))
    # from the largest down: the last end before a question is the smallest beyond it, of equal ones the first record's
    down = Window.partitionBy("k", "bucket").orderBy(F.desc("at"), "kind", F.desc("place")).rowsBetween(Window.unboundedPreceding, -1)
    near = written(ends.unionByName(asks).withColumn("to", F.last("place", ignorenulls=True).over(down)).where("kind = 0").select("k", F.col("of").alias("place"), "bucket", "to"))
    firsts = ends.groupBy("k", "bucket").agg(F.min("place").alias("first")).withColumn("kind", F.lit(1))
    open_ = near.where("to is null").select("k", "bucket").distinct().select("k", "bucket", F.lit(None).cast("long").alias("first"), F.lit(0).alias("kind"))
    behind = Window.partitionBy("k").orderBy(F.desc("bucket"), "kind").rowsBetween(Window.unboundedPreceding, -1)
    far = firsts.unionByName(open_).withColumn("next", F.last("first", ignorenulls=True).over(behind)).where("kind = 0").select("k", "bucket", "next")
    return near.join(far, ["k", "bucket"], "left").select("k", "place", F.coalesce("to", "next").alias("to"))


def pack(records: DataFrame, key: str, most: int, block: int = BLOCK) -> DataFrame:
    """(key, place, chunk): the chunk of each record, named by the place of its first record.

    records: (key, place, cost), places 0, 1, ... within a key, each once, cost the tokens of a record with what joins it
    to the next. A chunk takes records as long as their costs are at most `most`; a record that costs more on its own is in
    no chunk, and the chunk before it ends there. A null cost is 0, a null key is a key; an empty table has no chunks."""
    kind = records.schema[key].dataType
    k = F.when(F.col(key).isNull(), F.lit("-")).otherwise(F.concat(F.lit("+"), F.col(key).cast("string")))
    p = written(prefix_sums(records.select(k.alias("k"), F.col("place").cast("long").alias("place"), F.coalesce(F.col("cost").cast("long"), F.lit(0)).alias("cost")), block))
    over = p.select("k", "place", (F.col("cost") > most).alias("over"))
    links = written(_links(p, most).join(over, ["k", "place"]).withColumn("to", F.when(F.col("over"), F.col("place") + 1).otherwise(F.col("to"))))
    found = written(p.groupBy("k").agg(F.min("place").alias("place")))
    jump = links.where("to is not null").select("k", "place", "to")
    while not jump.isEmpty():
        found = written(found.unionByName(found.join(jump, ["k", "place"]).select("k", F.col("to").alias("place"))).distinct())
        jump = written(jump.join(jump.select("k", F.col("place").alias("to"), F.col("to").alias("far")), ["k", "to"]).select("k", "place", F.col("far").alias("to")))
    last = p.groupBy("k").agg(F.max("place").alias("last"))
    chunks = found.join(links.where("not over"), ["k", "place"]).join(last, "k").select("k", F.col("place").alias("chunk"), F.explode(F.sequence("place", F.coalesce(F.col("to") - 1, F.col("last")))).alias("place"))
    return chunks.select(F.when(F.col("k") != "-", F.substring("k", 2, 2**31 - 1)).cast(kind).alias(key), "place", "chunk")
