"""Sinks: JSON lines, nested bundles and short markdown reports of small aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_lines(df: DataFrame, path: str) -> None:
    """JSON lines, nested values and all."""
    df.write.mode("overwrite").json(path)


def markdown(df: DataFrame, title: str) -> DataFrame:
    """(ord, value): the lines of a table, whole. Rows keep the order of df; cells are made by Spark."""
    cells = F.concat_ws(" | ", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in df.columns))
    head = f"# {title}\n\n| {' | '.join(df.columns)} |\n|{'---|' * len(df.columns)}"
    lines = df.select(F.monotonically_increasing_id().alias("ord"), F.concat(F.lit("| "), cells, F.lit(" |")).alias("value"))
    return df.sparkSession.createDataFrame([(-1, head)], "ord long, value string").unionByName(lines)


def write_report(parts: dict[str, DataFrame], path: str) -> None:
    """Several aggregates as markdown, one after the other, written by Spark as text in one file."""
    out = None
    for k, (title, df) in enumerate(parts.items()):
        lines = markdown(df, title).withColumn("part", F.lit(k))
        out = lines if out is None else out.unionByName(lines)
    out.coalesce(1).sortWithinPartitions("part", "ord").select("value").write.mode("overwrite").text(path)


def bundle(sections: DataFrame, points: DataFrame, curves: DataFrame, graph: DataFrame, targets: DataFrame | None = None) -> DataFrame:
    """One nested row per section for a viewer: points, curves, faces and targets as arrays, coordinates to two decimals."""
    from spanwise.operators.topology import part

    near = lambda poly: F.transform(poly, lambda p: F.array(F.round(p["u"], 2), F.round(p["v"], 2)))
    lists = lambda df, name, *cols: df.groupBy("section_id").agg(F.array_sort(F.collect_list(F.struct(*cols))).alias(name))
    out = sections.select("section_id", "section_name", "plane", F.round("width", 2).alias("width"), F.round("height", 2).alias("height"))
    out = out.join(lists(points, "points", "ord", "name", F.round("u", 2).alias("u"), F.round("v", 2).alias("v")), "section_id", "left")
    out = out.join(lists(curves, "curves", "ord", "name", "start", "end", near("polyline").alias("polyline")), "section_id", "left")
    out = out.join(lists(part(graph, "face"), "faces", "ord", "face_id", F.round("area", 2).alias("area"), near("polygon").alias("polygon")), "section_id", "left")
    if targets is not None:
        out = out.join(lists(targets, "targets", "ord", "region_name", "label_id", "curve_names", "face_ids", "point_names"), "section_id", "left")
    return out
