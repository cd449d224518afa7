"""Readers of annotations, variants, samples and STEP files."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spanwise.operators.relational import cut
from spanwise.schema import SAMPLES
from spanwise.sources.sections import read_texts


@F.pandas_udf(T.StringType())
def yaml_to_json(texts: pd.Series) -> pd.Series:
    """YAML text as JSON; null where it can't be read."""
    import yaml

    def one(t):
        try:
            return json.dumps(yaml.safe_load(t), ensure_ascii=False, default=str) if t else None
        except yaml.YAMLError:
            return None

    return pd.Series([one(t) for t in texts], dtype=object)


_REGION = "struct<name: string, function: string, notes: string, bbox: map<string, string>>"
_META = f"struct<id: string, shape: struct<primary: string, topology: string>, regions: array<{_REGION}>, metadata: struct<version: string>>"


def annotations(texts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(meta, regions) of YAML texts (section_id, text): family, topology and version, and regions in order with their boxes as maps."""
    body = texts.select("section_id", yaml_to_json("text").alias("meta")).where("meta is not null")
    parsed = body.withColumn("y", F.from_json("meta", _META))
    meta = parsed.select("section_id", F.coalesce("y.shape.primary", F.lit("")).alias("family"), F.coalesce("y.shape.topology", F.lit("")).alias("topology"), F.col("y.metadata.version").alias("version"), "meta")
    regions = parsed.select("section_id", F.posexplode("y.regions").alias("ord", "r")).select("section_id", "ord", "r.name", "r.function", "r.notes", "r.bbox")
    return meta, regions


def read_annotations(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return annotations(read_texts(spark, path, ".yaml"))


def read_samples(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SAMPLES).json(path)


#: A record of a STEP file's data: #id = body.
RECORD = r"(?s)#(\d+)\s*=\s*((?:''|'[^']*'|[^';])*)"


def step_entities(texts: DataFrame) -> DataFrame:
    """texts (section_id, text) of whole STEP files to entities (section_id, id, type, args); records may span lines and hold quoted semicolons.

    A record of several types has a null type and all of them in args.
    """
    return _entities(texts.select("section_id", F.explode(F.expr(f"regexp_extract_all(text, r\"{RECORD};\", 0)")).alias("r")))


def _entities(found: DataFrame) -> DataFrame:
    """(section_id, id, type, args) of records (section_id, r)."""
    body = F.regexp_replace(F.regexp_extract("r", RECORD, 2), r"\s*\n\s*", "")
    simple = r"(?s)^\s*([A-Z0-9_]+)\s*\((.*)\)\s*$"
    out = found.select("section_id", F.regexp_extract("r", RECORD, 1).cast("long").alias("id"), body.alias("body"))
    type_ = F.regexp_extract("body", simple, 1)
    return out.select("section_id", "id", F.nullif(type_, F.lit("")).alias("type"), F.when(type_ != "", F.regexp_extract("body", simple, 2)).otherwise(F.trim("body")).alias("args"))


def read_step(spark: SparkSession, path: str) -> DataFrame:
    """The entities of STEP files below a path; section_id is the file's name without its ending. A file of any size is read by as many tasks as it has blocks.

    Files are read in pieces that end in a semicolon, so Spark cuts them at any byte and finds the next piece itself. A piece ends a record if the quotes
    up to its end are even in number. That number is a running count within the block, after the sum of the blocks before, of which
    there are few rows; in the same way records are numbered, and the pieces of one are joined.
    """
    at = F.col("_metadata")
    reader = spark.read.option("lineSep", ";").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{step,stp,STEP,STP}")
    pieces = reader.text(path).select(at["file_path"].alias("file"), at["file_block_start"].alias("block"), F.monotonically_increasing_id().alias("seq"), "value")
    pieces = cut(pieces.withColumn("quotes", F.length("value") - F.length(F.replace("value", F.lit("'")))))

    def running(df: DataFrame, count: Column, name: str, through: bool) -> DataFrame:
        """df with a count over its file's rows before this one, and through it."""
        own = Window.partitionBy("file", "block").orderBy("seq")
        blocks = df.groupBy("file", "block").agg(F.sum(count).alias("_s"))
        before = blocks.select("file", "block", F.coalesce(F.sum("_s").over(Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_b"))
        here = F.coalesce(F.sum(count).over(own.rowsBetween(Window.unboundedPreceding, 0 if through else -1)), F.lit(0))
        return df.withColumn(name, here).join(before, ["file", "block"]).withColumn(name, F.col(name) + F.col("_b")).drop("_b")

    ends = running(pieces, F.col("quotes"), "upto", True).withColumn("ends", (F.col("upto") % 2 == 0).cast("long"))
    numbered = running(ends, F.col("ends"), "record", False)
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "seq", "value"))), lambda x: x["value"]), ";")
    alone = (F.col("ends") == 1) & ((F.col("upto") - F.col("quotes")) % 2 == 0)
    rows = numbered.where(alone).select("file", F.col("value").alias("r")).unionByName(numbered.where(~alone).groupBy("file", "record").agg(whole.alias("r"), F.max("ends").alias("_e")).where("_e = 1").select("file", "r"))
    name = F.regexp_extract("file", r"([^/]+?)\.[A-Za-z]+$", 1)
    return _entities(rows.where(F.col("r").rlike(r"^\s*#\d+\s*=")).select(name.alias("section_id"), "r"))


def step_assemblies(entities: DataFrame) -> DataFrame:
    """(section_id, parent, child) of NEXT_ASSEMBLY_USAGE_OCCURRENCE entities: one row for each time that a product is built into another."""
    refs = F.expr("regexp_extract_all(regexp_replace(args, \"'(?:''|[^'])*'\", ''), r'#(\\d+)', 1)")
    return entities.where("type = 'NEXT_ASSEMBLY_USAGE_OCCURRENCE'").select("section_id", refs.alias("r")).where("size(r) >= 2").select("section_id", F.col("r")[0].cast("long").alias("parent"), F.col("r")[1].cast("long").alias("child"))


def step_references(entities: DataFrame) -> DataFrame:
    """(section_id, id, type, ref): what each entity refers to, in order of mention."""
    refs = entities.select("section_id", "id", "type", F.posexplode(F.expr("regexp_extract_all(args, r'#(\\d+)', 1)")).alias("ord", "ref"))
    return refs.select("section_id", "id", "type", "ord", F.col("ref").cast("long").alias("ref"))
