"""The integrity audit reports damaged texts."""

from spanwise.contract.queries import QUERIES


def test_damaged_texts(spark, tmp_path):
    spark.createDataFrame([(1,), (2,)], "o_orderkey long").write.parquet(f"{tmp_path}/orders.parquet")
    spark.createDataFrame([(1, 1), (2, 1)], "l_orderkey long, l_linenumber int").write.parquet(f"{tmp_path}/lineitem.parquet")
    rows = [(1, "whole", 5), (2, "cut", 9), (3, None, 4), (4, "日本", 2), (5, None, None)]
    spark.createDataFrame(rows, "doc_id long, text string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.check_name: r.n for r in QUERIES["integrity_audit"](spark, str(tmp_path)).collect()}
    assert got == {"orphan_lines": 0, "duplicate_line_keys": 0, "orders_without_lines": 0, "length_mismatches": 2}
