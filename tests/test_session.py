"""Scratch scopes: tables are deleted together, but not while something reads them."""
import os

from spendwise import session as SE


def test_scope_is_released_once_nothing_reads_it(spark):
    with SE.scratch_scope("one"):
        a = SE.scratch_table(spark, spark.range(5), "scope-a")
        b = SE.scratch_table(spark, a.selectExpr("id + 1 AS id"), "scope-b")
    after = SE.scratch_table(spark, b, "scope-after")
    folder = [f.removeprefix("file:") for f in SE.read_folders(b.where("id > 1"))]
    assert len(folder) == 1 and os.path.isdir(folder[0])
    assert not SE.release(spark, "one", b.selectExpr("id * 2 AS x").distinct()) and b.count() == 5
    assert SE.release(spark, "one", after) and not os.path.exists(folder[0])
    assert after.count() == 5 and SE.release(spark, "one", after)
