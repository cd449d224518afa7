"""Mixing sources to target weights by Sainte-Laguë apportionment.

1. Targets: the sources share ``share`` times all words by weight; a target stops at ``most`` times its source's size
   and the excess is shared anew by weight (``targets``: one pass over the sources, ordered by where they fill up).
2. Each source is cut into shards of about ``shard_rows`` rows by a seeded hash, so that no task needs all rows of a
   hot source. A source's target is a number of equal blocks of ``block`` words; the blocks go to its shards by the
   highest quotients size / (2k + 1). No quotient list is built: all quotients above a common divisor are counted
   by rounding, and only the few blocks that this leaves over or lacks are settled by rank.
3. In a shard the rows are laid end to end in seeded order and cut into blocks; the quota takes every block as often
   as it fits, and the rest as a run of blocks that starts at a seeded place and wraps around. So a row's taken words
   follow from its place alone.

Columns: doc_id, size, source_size, target, taken, then shard, quota (blocks of the shard). Defined cases: a null
text has size 0 and takes 0; a null source is a source, last in order; rows with the same id are rows of their own;
empty tables give empty results; equal hashes are ordered by id, size and text hash, and rows alike in all these are interchangeable.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanwise.llm.common import n_words

WEIGHTS = (5, 2, 1)
SHARE, MOST = 1.5, 2
BLOCK, SHARD_ROWS, SEED = 32, 2048, 7
#: Of a source; larger sources get larger shards, so that a source's shards can be ranked in one task.
MAX_SHARDS = 4096


def seeded(*cols: Column, seed: int = SEED) -> Column:
    """A whole number below 2**52 from md5, which other SQL engines have too."""
    text = F.concat_ws("|", F.lit(str(seed)), *(F.coalesce(c.cast("string"), F.lit("")) for c in cols))
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """sizes (source, source_size, n_rows) with target. A row for each source: far fewer rows than documents."""
    order, full = Window.orderBy(F.col("source").asc_nulls_last()), Window.orderBy("at", F.col("source").asc_nulls_last())
    everything = Window.partitionBy()
    rest = full.rowsBetween(Window.unboundedPreceding, -1)
    known = sizes.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))).cast("int") + 1).cast("double"))
    known = known.withColumn("at", most * F.col("source_size") / F.col("weight"))
    # Sources fill up in the order of ``at``; the level is what a unit of weight gets if all before are full.
    # It falls from the first source that it does not fill, so that one has the largest of those.
    known = known.withColumn("level", (share * F.sum("source_size").over(everything) - most * F.coalesce(F.sum("source_size").over(rest), F.lit(0))) / (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(rest), F.lit(0.0))))
    stop = F.max(F.when(F.col("level") <= F.col("at"), F.col("level"))).over(everything)
    target = F.least(most * F.col("source_size").cast("double"), F.coalesce(stop, F.lit(float("inf"))) * F.col("weight"))
    return known.withColumn("target", target).select("source", "source_size", "n_rows", "target")


def apportion(cells: DataFrame, blocks: Column, size: Column) -> DataFrame:
    """Add quota to cells (source, shard): a source's ``blocks`` seats go to the highest quotients size / (2k + 1), ties to lower shards.

    floor(size / divisor + 1/2) counts a cell's quotients above 1 / (2 * divisor). With the divisor total / seats the
    counts of n cells miss the seats by n / 2 at most. What is missing comes from the next quotients, what is too much
    goes from the last ones, by rank. The divisor moves by less than n / seats of itself, so no cell moves by more
    than n times its share of the seats and one: about 3n quotients are ranked, however many blocks there are.
    """
    group = Window.partitionBy("source")
    cells = cells.withColumn("_size", size.cast("double")).withColumn("_seats", blocks)
    cells = cells.withColumn("_fair", F.col("_size") * F.col("_seats") / F.nullif(F.sum("_size").over(group), F.lit(0.0)))
    cells = cells.withColumn("_got", F.coalesce(F.floor(F.col("_fair") + 0.5), F.lit(0)).cast("long"))
    cells = cells.withColumn("_miss", F.col("_seats") - F.sum("_got").over(group)).withColumn("_n", F.count("*").over(group))
    sign = F.signum("_miss").cast("long")
    steps = F.sequence(F.lit(0).cast("long"), F.ceil(F.col("_n") * F.col("_fair") / F.col("_seats")).cast("long") + 2)
    moves = cells.where((F.col("_miss") != 0) & (F.col("_size") > 0)).select("source", "shard", "_miss", sign.alias("_sign"), "_size", "_got", F.explode(steps).alias("_k"))
    moves = moves.withColumn("_seat", F.when(F.col("_sign") > 0, F.col("_got") + F.col("_k") + 1).otherwise(F.col("_got") - F.col("_k"))).where("_seat > 0")
    moves = moves.withColumn("_q", F.col("_size") / (2 * F.col("_seat") - 1))
    moves = moves.withColumn("_rank", F.row_number().over(group.orderBy(-F.col("_sign") * F.col("_q"), F.col("_sign") * F.col("shard"), "_k"))).where(F.col("_rank") <= F.abs("_miss"))
    moves = moves.groupBy(F.col("source").alias("_s"), F.col("shard").alias("_c")).agg(F.sum("_sign").alias("_move"))
    cells = cells.join(moves, cells["source"].eqNullSafe(moves["_s"]) & (cells["shard"] == moves["_c"]), "left")
    return cells.withColumn("quota", F.col("_got") + F.coalesce("_move", F.lit(0))).drop("_size", "_seats", "_fair", "_got", "_miss", "_n", "_s", "_c", "_move")


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: float = MOST, block: int = BLOCK, shard_rows: int = SHARD_ROWS, seed: int = SEED) -> DataFrame:
    """The columns named above for every row of docs (doc_id, text, source)."""
    rows = docs.select("doc_id", "source", n_words(F.col("text")).alias("size"), F.md5(F.coalesce("text", F.lit(""))).alias("_text"))
    rows = rows.withColumn("_at", seeded(F.col("doc_id"), F.col("_text"), seed=seed))
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_rows"))
    plan = targets(sizes, weights, share, most).withColumn("_shards", F.least(F.ceil(F.col("n_rows") / shard_rows), F.lit(MAX_SHARDS)).cast("long"))
    same = rows["source"].eqNullSafe(plan["source"])
    rows = rows.join(plan, same).drop(plan["source"])
    rows = rows.withColumn("shard", F.col("_at") % F.col("_shards"))
    cells = rows.groupBy("source", "shard").agg(F.sum("size").alias("_cell"), F.first("target").alias("target"))
    cells = apportion(cells, F.floor(F.col("target") / block + 0.5).cast("long"), F.col("_cell"))
    cells = cells.select("source", "shard", "_cell", "quota").withColumnRenamed("source", "_s").withColumnRenamed("shard", "_k")
    rows = rows.join(cells, rows["source"].eqNullSafe(cells["_s"]) & (rows["shard"] == cells["_k"])).drop("_s", "_k")
    lane = Window.partitionBy("source", "shard").orderBy("_at", "doc_id", "size", "_text").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("_to", F.sum("size").over(lane)).withColumn("_from", F.col("_to") - F.col("size"))
    n = F.greatest(F.ceil(F.col("_cell") / block), F.lit(1)).cast("long")
    rows = rows.withColumn("_n", n).withColumn("_full", F.least(F.floor(F.col("quota") / F.col("_n")), F.lit(int(most))).cast("long"))
    rows = rows.withColumn("_more", F.when(F.col("_full") >= most, 0).otherwise(F.col("quota") % F.col("_n")).cast("long"))
    rows = rows.withColumn("_start", seeded(F.col("source"), F.col("shard"), seed=seed + 1) % F.col("_n"))
    first, end = F.col("_start") * block, (F.col("_start") + F.col("_more")) * block
    wrapped = F.greatest(F.col("_start") + F.col("_more") - F.col("_n"), F.lit(0)) * block

    def overlap(a: Column, b: Column) -> Column:
        return F.greatest(F.least(F.col("_to"), b) - F.greatest(F.col("_from"), a), F.lit(0))

    taken = F.col("_full") * F.col("size") + overlap(first, end) + overlap(F.lit(0), wrapped)
    return rows.select("doc_id", "size", "source_size", "target", taken.cast("long").alias("taken"), "shard", "quota", "source")
