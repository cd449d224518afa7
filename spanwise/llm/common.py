"""What several of the text operators share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of anything but the six ASCII white-space characters; bytes.split() cuts at the same six.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words(text: str | None) -> list[bytes]:
    """The words of a text as UTF-8; none for null."""
    return text.encode().split() if text else []


def n_words(text: Column) -> Column:
    """Number of words of a text column, 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def fold(doc_id: Column, k: int) -> Column:
    """crc32 of the id as text, modulo k; null ids count as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % k


def some_of(df: DataFrame, key: str, n: int, total: int) -> DataFrame:
    """At most n rows of df, which has ``total``, in the hash order of a key column.

    Rows are first thinned by hash to about 2 n, so a task doesn't send its own first n rows to the driver.
    """
    h = F.xxhash64(F.col(key), F.lit(11))
    share = min(1.0, 2 * n / max(1, total))
    thin = df if share == 1.0 else df.where(F.pmod(h, F.lit(1 << 20)) < int(share * (1 << 20)) + 1)
    return thin.orderBy(h, key).limit(n)


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share. It is set here only where the session has none and runs on one machine, as in tests."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not at:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spanwise-"))
        at = spark.sparkContext.getCheckpointDir()
    return at


#: Spark's setting for shuffle files that go when their query ends, not when the driver happens to collect its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stored(df: DataFrame, what: str) -> DataFrame:
    """Write df to the shared folder and read it back: the lineage ends there, and a lost executor takes nothing along.

    What the write shuffled goes with its end; the session's own setting for that holds again afterwards.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/spanwise-{what}-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def pair_components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Connected components of undirected links (a, b): rows (node, class_id), class_id the least node of its component.

    Alternating large-star and small-star rounds: the number of rounds grows with the logarithm of a component's
    size, not with its diameter, and each round shuffles edges only. Nodes without links don't appear. Each round
    is written to the shared folder. A hub holds its star as one row per neighbour, never as one list.
    """
    edges = stored(
        links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "edges"
    )
    before = None
    for _ in range(max_rounds):
        # Large star: every neighbour above u is tied to the least of u and its neighbours.
        both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # Small star: u and its lower neighbours are tied to the least of them.
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(low, "u")
            .select(F.explode(F.array(F.struct(F.col("u").alias("a"), F.col("m").alias("b")), F.struct(F.col("v").alias("a"), F.col("m").alias("b")))).alias("e"))
            .select(F.col("e.a").alias("u"), F.col("e.b").alias("v"))
            .where("u <> v")
            .distinct()
        )
        edges = stored(small, "edges")
        state = edges.agg(F.count("*"), F.expr("bit_xor(xxhash64(u, v))")).first()
        if state == before:
            break
        before = state
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    node = edges.select(F.col("u").alias("node"), F.col("v").alias("class_id"))
    return node.union(edges.select(F.col("v").alias("node"), F.col("v").alias("class_id"))).distinct()
