"""The graph queries over whole tables, against a union-find and plain counts on a small fixture."""

import random
from collections import Counter, defaultdict

import pytest

from spanwise.contract.queries import QUERIES
from spanwise.operators import relational as R

SUPPLIERS = list(range(1, 31))
ORDERS = [(k, 1 + k % 7, "OFP"[k % 3]) for k in range(1, 25)]
LINES = [(k, n, 1 + (k * n) % 11) for k, _, _ in ORDERS for n in range(1, 1 + k % 4)]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame([(x,) for x in SUPPLIERS], "s_suppkey long").write.parquet(f"{at}/supplier.parquet")
    spark.createDataFrame(ORDERS, "o_orderkey long, o_custkey long, o_orderstatus string").write.parquet(f"{at}/orders.parquet")
    spark.createDataFrame(LINES, "l_orderkey long, l_linenumber int, l_suppkey long").write.parquet(f"{at}/lineitem.parquet")
    return at


def test_components(spark, folder):
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a in SUPPLIERS:
        x, y = sorted((find(a), find((a * 7 + 3) % 1000)))
        root[y] = x
    got = {r.node: r.component for r in QUERIES["components"](spark, folder).collect()}
    assert got == {x: find(x) for x in list(root)}


def test_degree_roles(spark, folder):
    cust = {k: c for k, c, _ in ORDERS}
    degree = Counter(n for a, b in {(f"c{cust[k]}", f"s{s}") for k, _, s in LINES} for n in (a, b))
    role = lambda d: "branch" if d > 2 else "junction" if d == 2 else "endpoint"
    assert {(r.node, r.degree, r.role) for r in QUERIES["degree_roles"](spark, folder).collect()} == {(n, d, role(d)) for n, d in degree.items()}


def test_topology_class(spark, folder):
    cust = {k: c for k, c, _ in ORDERS}
    degree, edges = defaultdict(Counter), Counter()
    for k, _, s in LINES:
        g = cust[k] % 40
        edges[g] += 1
        degree[g].update([cust[k], -1 - s])
    want = {(g, edges[g], sum(x > 2 for x in d.values()), sum(x == 1 for x in d.values())) for g, d in degree.items()}
    got = QUERIES["topology_class"](spark, folder).collect()
    assert {(r.g, r.n_edges, r.n_branch, r.n_end) for r in got} == want
    assert all(r["class"] == ("branched" if r.n_branch else "open" if r.n_end else "closed") for r in got)


def test_components_of_small_and_large_keys(spark):
    """Folded, in rounds or both: the same components; keys with a null end or key go the way of rounds."""
    rng = random.Random(9)
    rows = [(f"g{k % 5 if k % 3 else 0}", f"n{rng.randrange(40)}", f"n{rng.randrange(40)}") for k in range(160)] + [("g8", "x", None), (None, "x", "y"), ("g9", "x", "x")]
    df = spark.createDataFrame(rows, "g string, a string, b string")
    ways = [sorted(map(str, R.graph_components(df, "a", "b", ["g"], few=few).collect())) for few in (0, 25, 1000)]
    assert ways[0] == ways[1] == ways[2] and len(ways[0]) > 100
