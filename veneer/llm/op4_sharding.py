"""Shards by a consistent-hash ring with virtual nodes and bounded loads.

A key goes to the shard of the next virtual node clockwise. Shards are full at their exact share of all rows; the
keys of an arc that its shard can't take go on clockwise to shards with room, so counts differ by one at most and only
the overflow moves. The ring is counted, not walked: rows shrink to a count per arc (shards x nodes rows, whatever the
corpus), where the overflow is placed, and come back to rows as ranges of ranks within the arc. Columns only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from veneer.llm.common import cut_lineage, table

SHARDS, NODES = 40, 128
#: The ring has so many places; all keys of a place share their arc.
PLACES = 1 << 16
ROWS_PER_RANKING = 50_000


def _place(*cols: Column) -> Column:
    return F.shiftrightunsigned(F.xxhash64(*cols), 48).cast("int")


def ring(spark: SparkSession, shards: int, nodes: int) -> DataFrame:
    """arc, shard, place of its node: one row per virtual node in ring order. Its size is shards x nodes."""
    all_nodes = spark.range(shards * nodes).select((F.col("id") % shards).cast("int").alias("shard"), F.expr(f"id div {shards}").alias("replica"))
    placed = all_nodes.select("shard", "replica", _place(F.lit("node"), F.col("shard"), F.col("replica")).alias("place"))
    order = Window.orderBy("place", "shard", "replica")
    return placed.select((F.row_number().over(order) - 1).cast("int").alias("arc"), "shard", "place")


def _places(arcs: DataFrame) -> DataFrame:
    """place, arc for all PLACES places: the first node at or after the place, around the ring."""
    spark = arcs.sparkSession
    marks = arcs.select("place", F.lit(0).alias("kind"), "arc").unionByName(
        spark.range(PLACES).select(F.col("id").cast("int").alias("place"), F.lit(1).alias("kind"), F.lit(None).cast("int").alias("arc")))
    after = Window.orderBy(F.col("place").desc(), "kind", F.col("arc").desc()).rowsBetween(Window.unboundedPreceding, 0)
    return (marks.withColumn("next", F.last("arc", True).over(after)).filter("kind = 1")
            .select("place", F.coalesce("next", F.lit(0)).alias("arc")))


def _segments(counts: DataFrame, arcs: DataFrame, shards: int) -> DataFrame:
    """arc, low, high (ranks within the arc, half open), shard, base (slot of the first)."""
    full = arcs.join(counts, "arc", "left").select("arc", "shard", F.coalesce("n", F.lit(0)).cast("long").alias("n"))
    full = full.withColumn("total", F.sum("n").over(Window.partitionBy()))
    room = F.expr(f"total div {shards}") + F.when(F.col("shard") < F.col("total") % shards, 1).otherwise(0)
    own = Window.partitionBy("shard").orderBy("arc")
    home = full.withColumn("room", room).withColumn("before", F.sum("n").over(own) - F.col("n"))
    home = home.withColumn("taken", F.greatest(F.lit(0), F.least(F.col("n"), F.col("room") - F.col("before"))).cast("long"))
    # shards x nodes entries in one row: the overflow is placed arc by arc, clockwise
    rest = home.agg(F.array_sort(F.collect_list(F.struct("arc", "shard", "taken", (F.col("n") - F.col("taken")).alias("left")))).alias("ring"),
                    F.max("total").alias("total"))
    state = rest.select("ring", F.expr(f"""transform(sequence(0, {shards - 1}), s -> aggregate(filter(ring, x -> x.shard = s),
        total div {shards} + if(s < total % {shards}, 1L, 0L), (t, x) -> t - x.taken))""").alias("free"))
    placed = state.select(F.expr("""
        aggregate(filter(ring, a -> a.left > 0),
          named_struct('free', free, 'out', cast(array() as array<struct<arc:int,low:bigint,high:bigint,shard:int>>)),
          (acc, a) -> aggregate(
            array_distinct(transform(concat(slice(ring, a.arc + 1, size(ring)), slice(ring, 1, a.arc)), x -> x.shard)),
            named_struct('free', acc.free, 'out', acc.out, 'low', a.taken, 'left', a.left),
            (s, shard) -> if(s.left <= 0 or s.free[shard] <= 0, s, named_struct(
              'free', transform(s.free, (f, i) -> if(i = shard, f - least(s.left, s.free[shard]), f)),
              'out', concat(s.out, array(named_struct('arc', a.arc, 'low', s.low, 'high', s.low + least(s.left, s.free[shard]), 'shard', shard))),
              'low', s.low + least(s.left, s.free[shard]), 'left', s.left - least(s.left, s.free[shard]))),
            s -> named_struct('free', s.free, 'out', s.out))).out""").alias("out"))
    over = placed.select(F.inline("out"))
    kept = home.filter("taken > 0").select("arc", F.lit(0).cast("long").alias("low"), F.col("taken").alias("high"), "shard")
    both = kept.unionByName(over)
    size = F.col("high") - F.col("low")
    return both.withColumn("base", F.sum(size).over(Window.partitionBy("shard").orderBy("arc", "low")) - size)


def shard(df: DataFrame, shards: int = SHARDS, nodes: int = NODES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard; one row per row.

    The law is `rows`: counts of shards differ by one at most, slots run from 0 without gaps. The key is the id (a null
    id is a key like others), so rows of equal text may part. A null text has no bytes: size 16, checksum 0. Rows given
    twice are counted before they are dealt and get slots of their own. Extra columns are ignored; no rows give no rows.
    """
    spark = df.sparkSession
    rows = df.select(F.col(id_col).alias("doc_id"), (F.octet_length(F.coalesce(F.col(text_col), F.lit(""))) + 16).cast("long").alias("size"),
                     F.crc32(F.coalesce(F.col(text_col), F.lit("")).cast("binary")).alias("text_crc32"))
    groups = cut_lineage(rows.groupBy("doc_id", "size", "text_crc32").agg(F.count(F.lit(1)).alias("copies")))
    arcs = cut_lineage(ring(spark, shards, nodes))
    keyed = groups.withColumn("place", _place(F.col("doc_id").cast("string"))).join(F.broadcast(_places(arcs)), "place")
    total = groups.agg(F.sum("copies")).first()[0] or 0
    pieces = 1 + total // (shards * nodes * ROWS_PER_RANKING)
    # ranks within an arc follow a second hash; pieces of that hash's range keep each ranking small
    second = F.xxhash64(F.col("doc_id").cast("string"), "size", "text_crc32")
    keyed = keyed.withColumn("order", second).withColumn("piece", F.expr(f"shiftrightunsigned(`order`, 32) * {pieces} div 4294967296"))
    counts = cut_lineage(keyed.groupBy("arc", "piece").agg(F.sum("copies").alias("n")))
    starts = counts.withColumn("start", F.sum("n").over(Window.partitionBy("arc").orderBy("piece")) - F.col("n")).drop("n")
    segments = cut_lineage(_segments(counts.groupBy("arc").agg(F.sum("n").alias("n")), arcs, shards))
    within = Window.partitionBy("arc", "piece").orderBy("order", "doc_id", "size", "text_crc32")
    ranked = keyed.join(starts, ["arc", "piece"]).withColumn("rank", F.col("start") + F.sum("copies").over(within) - F.col("copies"))
    single = ranked.select("doc_id", "size", "text_crc32", "arc", F.explode(F.expr("sequence(rank, rank + copies - 1)")).alias("rank"))
    # segments number 2 x shards x nodes + shards at most
    dealt = single.alias("r").join(F.broadcast(segments).alias("s"), F.expr("r.arc = s.arc AND r.rank >= s.low AND r.rank < s.high"))
    return dealt.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "s.shard",
                        (F.col("base") + F.col("rank") - F.col("low")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def query(spark: SparkSession, sf: str) -> DataFrame:
    return shard(table(spark, sf, "documents"))


QUERIES = {"op4_sharding": query}
ORACLES: dict[str, str] = {}
