"""The step that most plans share: facts staged once, sums made without storing the long
table, generated methods short enough to be compiled, dates parsed by their own layouts."""
import re

import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL
from spendwise.functions import normalize as N
from spendwise.plans.workspace import Workspace
from spendwise.session import read_folders
from spendwise.sources import exports as E
from spendwise.sources import fixtures as X


def test_base_is_summed_from_staged_facts_without_storing_rows(spark):
    ws = Workspace(spark, SF_SMALL)
    assert ws.base.count() > 0 and "long" not in ws.__dict__ and not ws.rows.is_cached
    folders = read_folders(ws.rows)  # every export reads the staged facts and no driver table
    assert folders and all(SF_SMALL not in f for f in folders)
    assert ws.facts.count() == X.ads_base(spark, SF_SMALL).count()


@pytest.mark.parametrize("shape", [X.export_google, X.export_microsoft, X.export_meta])
def test_no_generated_method_is_too_long_to_be_compiled(spark, shape):
    plan = E.to_long(shape(Workspace(spark, SF_SMALL).facts))._jdf.queryExecution().executedPlan()
    code = spark._jvm.org.apache.spark.sql.execution.debug.package.codegenString(plan)
    sizes = [int(n) for n in re.findall(r"maxMethodCodeSize:(\d+)", code)]
    assert sizes and max(sizes) < 8000  # HotSpot interprets methods of 8,000 bytes and more


def test_layouts_tried_by_shape_read_what_the_plain_chain_reads(spark):
    cells = ["2025-01-02", "2025-1-2", "2025-02-30", "0000-01-01", "0001-01-01", "+12025-01-02", "12025-01-02", "2025-13-01", "2025-01-02T10:00",
             " 2025-01-02 10:00 ", "2025-01-02\n", "2025/1/2", "1/2/2025", "13/2/2025", "2/13/25", "13/2/25", "2.1.2025", "1-2-2025", "31-12-2025",
             "12-31-+12025", "20250102", "+120250102", "2025010", "202501021", "2025", "1/2/3", "-2025-01-02", "1-2--2025", "-2025/1/2", "1/2/-2025", "-20250102", "1.2.-2025", "2025--1-02", "not a date", "", None,
             "Jan 2, 2025", "JANUARY 2, 2025", "2 jan 2025", "2 January 2025", "2-Jan-2025", "Foo 2, 2025", "٢٠٢٥-٠١-٠٢"]

    def plain(c):
        whole = F.trim(c)
        head = F.substring_index(F.substring_index(whole, " ", 1), "T", 1)
        named = F.when(whole.rlike("[A-Za-z]{3}"), F.coalesce(*[F.try_to_timestamp(F.initcap(whole), F.lit(f)) for f in N.TEXT_DATE_FORMATS]))
        return F.coalesce(*[F.try_to_timestamp(head, F.lit(f)) for f, _ in N.DATE_FORMATS], named).cast("date")

    df = spark.createDataFrame([(c,) for c in cells], "c string")
    got = df.select("c", N.to_date(F.col("c")).cast("string").alias("now"), plain(F.col("c")).cast("string").alias("plain")).collect()
    assert [(r.c, r.now) for r in got] == [(r.c, r.plain) for r in got]
    assert sum(r.now is not None for r in got) > 15


def test_type_rules_keep_their_order(spark):
    keys = ["smart_search", "audience_video", "pmax", "hotel", "nothing", "", None, "dynamicsearchads"]
    df = spark.createDataFrame([(k,) for k in keys], "k string")
    assert [r[0] for r in df.select(N._type_from_map(F.col("k"))).collect()] == [
        "Search", "Video", "PerformanceMax", "Other", None, None, None, "Search"]


def test_cells_put_in_order_for_a_cast_read_what_their_layouts_read(spark):
    cells = ["2025/1-2", "1/2-2025", "0/0/2025", "2/30/2024", "29/2/2024", "2/29/2023", "29-2-2024", "31.4.2025", "30.4.2025", "2.13.2025", "99991231",
             "20240230", "20241301", "+20240101", "1000/01/01", "9999-1-1", "0999/1/1", "001/2/2025", "1/002/2025", "2025-001-02", "12/31/2025 10:00",
             "12/31/2025T10", "1.2/2025", "1/2/2025\n", "20250102 Jan 2024", "5 Jan 2024", "20250102x", "25-JAN-2024", "1/2/02025", " 7/8/2025"]
    df = spark.createDataFrame([(c,) for c in cells], "c string")
    head = F.substring_index(F.substring_index(F.trim("c"), " ", 1), "T", 1)
    named = [F.try_to_timestamp(F.initcap(F.trim("c")), F.lit(f)) for f in N.TEXT_DATE_FORMATS]
    plain = F.coalesce(*[F.try_to_timestamp(head, F.lit(f)) for f, _ in N.DATE_FORMATS], *named).cast("date")
    got = df.select("c", N.to_date(F.col("c")).cast("string").alias("now"), plain.cast("string").alias("plain")).collect()
    assert [(r.c, r.now) for r in got] == [(r.c, r.plain) for r in got]
    assert sum(r.now is not None for r in got) > 10
