"""Annotations, STEP records and the corpus job on a small folder."""

from spanwise.operators import relational
from spanwise.plans import corpus, reports
from spanwise.sources import files
from tests.fixtures import FIXTURES, macro

YAML = """
id: {0}
shape: {{primary: fam-{1}, topology: closed}}
metadata: {{version: '1.0', date: 2020-01-01}}
regions:
- {{name: chamber_1, function: enclosed, bbox: {{x: 0, y: 80, width: 40, height: 40}}}}
- {{name: stiffener_a, function: stiffener, bbox: {{x: -1, y: 79, width: 42, height: 2}}}}
"""


def test_yaml_and_step(spark):
    meta, regions = files.annotations(spark.createDataFrame([("a", YAML.format("a", "x")), ("b", "{"), ("c", None)], "section_id string, text string"))
    assert [(r.section_id, r.family, r.version) for r in meta.collect()] == [("a", "fam-x", "1.0")]
    assert [(r.ord, r.name, r.bbox["width"]) for r in regions.orderBy("ord").collect()] == [(0, "chamber_1", "40"), (1, "stiffener_a", "42")]
    text = "HEADER;\n#1 = POINT('a;b',\n  (0.,1.));\n#2=( A(1) B(#1) );\n#30 = EDGE(#1,#2,.T.);\nENDSEC;"
    e = files.step_entities(spark.createDataFrame([("f", text)], "section_id string, text string"))
    got = {r.id: (r.type, r.args) for r in e.collect()}
    assert got[1] == ("POINT", "'a;b',(0.,1.)") and got[2][0] is None and got[30] == ("EDGE", "#1,#2,.T.")
    assert {(r.id, r.ref) for r in files.step_references(e).collect()} == {(2, 1), (30, 1), (30, 2)}


STEP = """ISO-10303-21;
HEADER;
FILE_NAME('a;b''c','2020');
ENDSEC;
DATA;
#1 = POINT('a;b',
  (0.,1.));
#2=( A(1) B(#1) );
#30 = EDGE(';;''#9=X();',#1,#2,.T.);
#31=NEXT_ASSEMBLY_USAGE_OCCURRENCE('1','#7;','',#40,#41,$);
#32=NEXT_ASSEMBLY_USAGE_OCCURRENCE('2','x','',#40,#41,$);
#33=NEXT_ASSEMBLY_USAGE_OCCURRENCE('3','x','',#41,#42,$);
#34=NEXT_ASSEMBLY_USAGE_OCCURRENCE('4','x','',#43,#43,$);
ENDSEC;
END-ISO-10303-21;
"""


def test_step_files_cut_anywhere(spark, tmp_path):
    """A file read in blocks of any size gives the entities of its whole text."""
    (tmp_path / "one.step").write_text(STEP)
    (tmp_path / "two.stp").write_text(STEP.replace("#30", "#35").replace("\n", "\r\n"))
    texts = spark.createDataFrame([("one", STEP), ("two", (tmp_path / "two.stp").read_bytes().decode())], "section_id string, text string")
    want = sorted(map(tuple, files.step_entities(texts).collect()))
    assert len(want) == 14
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    before = [spark.conf.get(n) for n in names]
    try:
        for size in (1, 5, 64, 10_000):
            spark.conf.set(names[0], size)
            spark.conf.set(names[1], 0)
            got = files.read_step(spark, str(tmp_path))
            assert sorted(map(tuple, got.collect())) == want, size
    finally:
        for n, v in zip(names, before, strict=True):
            spark.conf.set(n, v)


def test_step_assemblies(spark):
    """Two uses of one part, a level below, and a product that holds itself."""
    edges = files.step_assemblies(files.step_entities(spark.createDataFrame([("one", STEP)], "section_id string, text string")))
    assert sorted((r.parent, r.child) for r in edges.collect()) == [(40, 41), (40, 41), (41, 42), (43, 43)]
    roots = spark.createDataFrame([("one", 40), ("one", 43), ("one", 99)], "section_id string, root long")
    found, open_ = relational.descend(edges, roots, "parent", "child", ["section_id"], max_depth=4)
    assert sorted((r.root, r.node, r.level, r.n_paths) for r in found.where("root <> 43").collect()) == [(40, 40, 0, 1), (40, 41, 1, 2), (40, 42, 2, 2), (99, 99, 0, 1)]
    assert found.where("root = 43").count() == 5 and [(r.root, r.node) for r in open_.collect()] == [(43, 43)]


def test_corpus_job(spark, tmp_path):
    for k, name in enumerate(("ladder", "t_rung")):
        d = tmp_path / "in" / name
        d.mkdir(parents=True)
        (d / f"{name}.py").write_text(macro(name, *FIXTURES[name]))
        (d / f"{name}.yaml").write_text(YAML.format(name, k))
    (tmp_path / "in" / "bare").mkdir()
    (tmp_path / "in" / "bare" / "bare.py").write_text(macro("bare", *FIXTURES["ladder"]))
    c = corpus.build(spark, str(tmp_path / "in"))
    assert {r.section_id for r in c["sections"].collect()} == {"ladder", "t_rung"}  # one without annotations is none
    assert {(r.section_id, r.region_name, tuple(r.curve_names)) for r in c["targets"].where("function = 'stiffener'").collect()} == {(n, "stiffener_a", ("R2",)) for n in ("ladder", "t_rung")}
    reports.write_lines(c["samples"], str(tmp_path / "samples"))
    assert files.read_samples(spark, str(tmp_path / "samples")).count() == c["samples"].count() > 0
    nested = reports.bundle(c["sections"], c["points"], c["curves"], c["graph"], c["targets"])
    assert {len(r.faces) for r in nested.collect()} == {3}
    reports.write_report({"Silver": c["targets"].groupBy("function").count(), "Many": spark.range(300)}, str(tmp_path / "r"))
    lines = [r.value for r in spark.read.text(str(tmp_path / "r")).collect()]
    assert any("| function |" in x for x in lines) and sum(x.strip("| ").isdigit() for x in lines) == 300
