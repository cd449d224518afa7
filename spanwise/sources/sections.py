"""Section drawings as two tables, points and curves, from macro text or XML.

Order is carried in ``ord``: a variable defined twice keeps its first place and its last value.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spanwise.functions.scalar import number
from spanwise.operators.relational import cut

#: A call of the macro format, and an argument of one.
CALL = r'(?:([A-Za-z_]\w*)\s*=\s*)?theModel\.(\w+)\(((?:"[^"]*"|[^")])*)\)'
ARGUMENT = r'(\w+)\s*=\s*("[^"]*"|[^",\s]+)'


def read_texts(spark: SparkSession, path: str, suffix: str) -> DataFrame:
    """(path, section_id, text, sha256) of all files with a suffix; section_id is the folder's name. Bad bytes are replaced."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", f"*{suffix}").option("recursiveFileLookup", "true").load(path)
    return files.select("path", F.regexp_extract("path", r"([^/]+)/[^/]+$", 1).alias("section_id"), F.decode("content", "UTF-8").alias("text"), F.sha2("content", 256).alias("sha256"))


def statements(texts: DataFrame) -> DataFrame:
    """(section_id, ord, var, call, args) of every call in macro texts, whatever it is named; args are (key, value) pairs without quotes.

    A table of its own, so that each file is read and cut once.
    """
    all_ = lambda c, pattern: F.regexp_extract_all(c, F.lit(pattern), F.lit(0))
    found = texts.select("section_id", F.posexplode(all_(F.col("text"), CALL)).alias("ord", "m"))
    group = lambda k: F.regexp_extract("m", CALL, k)
    pair = lambda x: F.struct(F.regexp_extract(x, ARGUMENT, 1).alias("key"), F.regexp_replace(F.regexp_extract(x, ARGUMENT, 2), '"', "").alias("value"))
    return cut(found.select("section_id", "ord", F.nullif(group(1), F.lit("")).alias("var"), group(2).alias("call"), F.transform(all_(group(3), ARGUMENT), pair).alias("args")))


def argument(name: str) -> Column:
    """The value of a call's argument, null if it has none."""
    return F.get(F.filter("args", lambda a: a["key"] == name), F.lit(0))["value"]


def last_value(df: DataFrame, key: list[str], values: list[str]) -> DataFrame:
    """One row per key: the first ord, the last values."""
    last = F.max_by(F.struct(*values), "ord")
    return df.groupBy(*key).agg(F.min("ord").alias("ord"), last.alias("_v")).select(*key, "ord", "_v.*")


def most_curves(points: DataFrame, curves: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of a file with several sections, the one with most curves, the first of equals."""
    size = curves.groupBy("section_id", "section_name").agg(F.count("*").alias("n"), F.min("ord").alias("o"))
    rank = F.row_number().over(Window.partitionBy("section_id").orderBy(F.desc("n"), "o", "section_name"))
    best = size.withColumn("r", rank).where("r = 1").select("section_id", "section_name")
    on = ["section_id", "section_name"]
    return points.join(best, on, "left_semi"), curves.join(best, on, "left_semi")


def macro_tables(texts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Points and curves (schema.POINTS, schema.CURVES) of macro texts; rows of unknown sections are dropped."""
    calls = statements(texts)
    of = lambda call, **named: calls.where(F.col("call") == call).select("section_id", "ord", "var", *(argument(a).alias(n) for n, a in named.items()))
    sects = last_value(of("createSect", section_name="sectionName").where("var is not null"), ["section_id", "var"], ["section_name"]).drop("ord")
    nodes = of("createSecNode", x="x", y="y", z="z", sect="theSect").withColumnsRenamed({"var": "name", "sect": "var"}).where("name is not null")
    nodes = nodes.withColumns({c: number(F.col(c)) for c in "xyz"}).where("x is not null and y is not null and z is not null").join(sects, ["section_id", "var"])
    key = ["section_id", "section_name", "name"]
    points = last_value(nodes, key, ["x", "y", "z"]).select("section_id", "section_name", F.lit("py").alias("source"), "name", "ord", "x", "y", "z")
    lines = of("createSecCurve", start="start", end="end", sect="theSect").withColumnsRenamed({"var": "name", "sect": "var"}).where("name is not null and start is not null and end is not null").join(sects, ["section_id", "var"])
    no_control = F.lit(None).cast("struct<x: double, y: double, z: double>")
    curves = last_value(lines, key, ["start", "end"]).select("section_id", "section_name", F.lit("py").alias("source"), "name", "ord", "start", "end", no_control.alias("c1"), no_control.alias("c2"))
    return points, curves


def vector(node: str, items_first: bool = True) -> Column:
    """A point of an XML element: three <item> or <X>, <Y>, <Z>; which is tried first differs between readers."""
    item = F.when(F.size(f"{node}.item") == 3, F.struct(*(number(F.col(f"{node}.item")[i].cast("string")).alias(c) for i, c in enumerate("xyz"))))
    axes = [number(F.col(f"{node}.{c}").cast("string")) for c in "XYZ"]
    xyz = F.when(axes[0].isNotNull() & axes[1].isNotNull() & axes[2].isNotNull(), F.struct(*(a.alias(c) for a, c in zip(axes, "xyz", strict=True))))
    return F.coalesce(item, xyz) if items_first else F.coalesce(xyz, item)


_VEC = "struct<item: array<string>, X: string, Y: string, Z: string>"
_POINT = f"ID string, Name string, Type string, sectionName string, gCoord {_VEC}, sCoord {_VEC}"
_CURVE = (
    f"ID string, Name string, Type string, sectionName string, startPointID string, startPointName string,"
    f" endPointID string, endPointName string, controlPoint_1_gCoord {_VEC}, controlPoint_2_gCoord {_VEC}"
)


def elements(texts: DataFrame, tag: str, schema: str) -> DataFrame:
    """Elements of a tag anywhere in the XML, in order: cut from the text, each parsed by from_xml."""
    found = texts.select("section_id", F.posexplode(F.expr(rf"regexp_extract_all(text, r'(?s)<{tag}(?:\s[^>]*)?>.*?</{tag}>', 0)")).alias("ord", "xml"))
    return found.select("section_id", "ord", F.from_xml("xml", schema, {"rowTag": tag}).alias("e"))


def xml_tables(texts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Points and curves of XML texts: contour points (type 2) that aren't named like their section, curves with both ends."""
    p = elements(texts, "Point", _POINT).select("section_id", "ord", "e.*")
    p = p.where("Type = '2' and Name <> '' and not (Name <=> sectionName)").withColumn("g", vector("gCoord")).where("g is not null")
    name = F.coalesce("sectionName", F.lit("")).alias("section_name")
    raw = p.select("section_id", name, F.col("Name").alias("name"), "ord", "g.*")
    points = last_value(raw, ["section_id", "section_name", "name"], ["x", "y", "z"]).select("section_id", "section_name", F.lit("xml").alias("source"), "name", "ord", "x", "y", "z")
    c = elements(texts, "Curve", _CURVE).select("section_id", "ord", "e.*").where("Name <> '' and startPointName <> '' and endPointName <> ''")
    raw = c.select("section_id", name, F.col("Name").alias("name"), "ord", F.col("startPointName").alias("start"), F.col("endPointName").alias("end"), vector("controlPoint_1_gCoord").alias("c1"), vector("controlPoint_2_gCoord").alias("c2"))
    curves = last_value(raw, ["section_id", "section_name", "name"], ["start", "end", "c1", "c2"]).select("section_id", "section_name", F.lit("xml").alias("source"), "name", "ord", "start", "end", "c1", "c2")
    return points, curves


def read_sections(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """All sections below a folder: the macro of each folder, else its XML; of a file the section with most curves."""
    mp, mc = most_curves(*macro_tables(read_texts(spark, path, ".py")))
    xp, xc = most_curves(*xml_tables(read_texts(spark, path, ".xml")))
    have = mc.select("section_id").distinct()
    return mp.unionByName(xp.join(have, "section_id", "left_anti")), mc.unionByName(xc.join(have, "section_id", "left_anti"))


def localised(points: DataFrame, curves: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(sections, points, curves) in local coordinates.

    The plane's normal is the axis with the least range over points that curves use, the first of equals: YZ gives
    (y, z), XZ gives (x, z), XY gives (y, -x). Origin marks at (0, 0, 0) that no curve uses go, as do curves with an
    unknown end. Curves with both control points are sampled at nine parameters.
    """
    ends = curves.select("section_id", F.explode(F.array("start", "end")).alias("name")).distinct().withColumn("used", F.lit(True))
    marked = points.join(ends, ["section_id", "name"], "left").withColumn("used", F.coalesce("used", F.lit(False)))
    zero = (F.abs("x") < 1e-6) & (F.abs("y") < 1e-6) & (F.abs("z") < 1e-6)
    span = lambda c: F.max(F.when(F.col("used") | ~F.col("any"), F.col(c))) - F.min(F.when(F.col("used") | ~F.col("any"), F.col(c)))
    marked = marked.withColumn("any", F.max("used").over(Window.partitionBy("section_id")))
    planes = marked.groupBy("section_id").agg(*(span(c).alias(f"r{c}") for c in "xyz"))
    plane = F.when((F.col("rx") <= F.col("ry")) & (F.col("rx") <= F.col("rz")), "YZ").when(F.col("ry") <= F.col("rz"), "XZ").otherwise("XY")
    planes = planes.select("section_id", plane.alias("plane"))
    real = marked.where(F.col("used") | ~zero).join(planes, "section_id")
    u = F.when(F.col("plane") == "XZ", F.col("x")).otherwise(F.col("y"))
    v = F.when(F.col("plane") == "XY", -F.col("x")).otherwise(F.col("z"))
    real = real.withColumns({"gu": u, "gv": v})
    sections = real.groupBy("section_id", "plane").agg(F.first("section_name").alias("section_name"), F.first("source").alias("source"), F.min("gu").alias("u_min"), F.min("gv").alias("v_min"), (F.max("gu") - F.min("gu")).alias("width"), (F.max("gv") - F.min("gv")).alias("height"))
    frame = sections.select("section_id", "plane", "u_min", "v_min")
    local = real.drop("plane").join(frame, "section_id").select("section_id", "name", "ord", "used", (F.col("gu") - F.col("u_min")).alias("u"), (F.col("gv") - F.col("v_min")).alias("v"))
    at = local.select("section_id", "name", F.struct("u", "v").alias("uv"))
    both = curves.join(at.toDF("section_id", "start", "p0"), ["section_id", "start"]).join(at.toDF("section_id", "end", "p1"), ["section_id", "end"]).join(frame, "section_id")

    def control(c: str) -> Column:
        cu = F.when(F.col("plane") == "XZ", F.col(f"{c}.x")).otherwise(F.col(f"{c}.y"))
        cv = F.when(F.col("plane") == "XY", -F.col(f"{c}.x")).otherwise(F.col(f"{c}.z"))
        return F.when(F.col(c).isNotNull(), F.struct((cu - F.col("u_min")).alias("u"), (cv - F.col("v_min")).alias("v")))

    from spanwise.functions.geometry import bezier, polyline_length

    both = both.withColumns({"q1": control("c1"), "q2": control("c2")})
    bent = F.col("q1").isNotNull() & F.col("q2").isNotNull()
    poly = F.when(bent, bezier("p0", "q1", "q2", "p1", 8)).otherwise(F.array("p0", "p1"))
    out = both.withColumn("polyline", poly).select("section_id", "name", "ord", "start", "end", F.when(bent, F.array("q1", "q2")).alias("control"), "polyline", polyline_length("polyline").alias("length"), F.hypot(F.col("p1.u") - F.col("p0.u"), F.col("p1.v") - F.col("p0.v")).alias("chord"))
    return sections, local, out
