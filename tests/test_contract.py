"""Every contract query against its SQL, where the benchmark tables are there."""

import math
import os

import pytest

from spanwise.contract import drawings, shapes  # noqa: F401  (register their queries)
from spanwise.contract.queries import QUERIES, SQL

SF = os.environ.get("CONTRACT_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")


@pytest.fixture(scope="module")
def duck():
    con = pytest.importorskip("duckdb").connect()
    for n in TABLES:
        con.execute(f"create view {n} as select * from '{SF}/{n}.parquet'")
    return con


def normal(v):
    if v is None or isinstance(v, (bool, str)):
        return v
    try:
        return None if math.isnan(float(v)) else float(f"{float(v):.9g}")
    except TypeError:
        return v


def rows(records):
    return sorted((tuple(map(normal, r)) for r in records), key=str)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    got = rows(df.select(*cols).collect())
    if name not in SQL:
        assert got
        return
    quoted = ", ".join(f'"{c}"' for c in cols)
    assert got == rows(duck.execute(f"select {quoted} from ({SQL[name]})").fetchall())
