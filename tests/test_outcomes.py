"""What becomes of every file and cell of an export directory."""
import gzip
import os
import tempfile

import pytest

from spendwise.plans import batch
from spendwise.sources import exports as E

HEADER = "segments_date,campaign_name,metrics_clicks,metrics_cost_micros,metrics_conversions_value\n"


def _dir(files):
    d = tempfile.mkdtemp(prefix="sw-outcomes-")
    for name, text in files.items():
        with open(os.path.join(d, name), "wb") as f:
            f.write(text if isinstance(text, bytes) else text.encode())
    return d


def _outcomes(spark, d):
    files = E.scan_files(spark, d)
    parsed = E.load_long(spark, d, with_file=True, rejects=True, files=files)
    name = lambda path: E.F.regexp_extract(path, "[^/]*$", 0)
    return ({r.source_file: r for r in E.file_outcomes(spark, files, parsed, name).collect()},
            sorted((r.source_file, r.column, r.reason, r.cells) for r in E.rejected_cells(parsed, name).collect()))


def test_every_outcome(spark):
    d = _dir({
        "google_a.csv": HEADER + "2024-01-05,x,3,2000000,9\nbad,x,1,1,1\n2024-01-07,y,-1,n/a,\n",
        "google_undated.csv": HEADER + ",x,1,1,1\n-,x,1,1,1\n",
        "google_header_only.csv": HEADER,
        "notes.csv": "some,words\nno,date\n",
        "empty.csv": "",
    })
    got, cells = _outcomes(spark, d)
    assert {k: (r.status, r.raw_rows, r.parsed_rows, r.dropped_rows) for k, r in got.items()} == {
        "google_a.csv": ("read", 3, 2, 1), "google_undated.csv": ("zero_rows", 2, 0, 2),
        "google_header_only.csv": ("skipped", 0, 0, 0), "notes.csv": ("zero_rows", 1, 0, 1), "empty.csv": ("skipped", 0, 0, 0)}
    a = got["google_a.csv"]
    assert (str(a.date_min), str(a.date_max), a.campaigns, float(a.spend), float(a.revenue), a.zeroed_cells) == (
        "2024-01-05", "2024-01-07", 2, 2.0, 9.0, 3)
    assert cells == [
        ("google_a.csv", "clicks", "negative", 1), ("google_a.csv", "date", "not_a_date", 1), ("google_a.csv", "revenue", "blank", 1),
        ("google_a.csv", "spend", "not_a_number", 1), ("google_undated.csv", "date", "blank", 1),
        ("google_undated.csv", "date", "not_a_date", 1), ("notes.csv", "date", "absent", 1)]


def test_unreadable_file_is_reported(spark):
    whole = gzip.compress((HEADER + "2024-01-05,x,3,2000000,9\n").encode())
    d = _dir({"google_a.csv.gz": whole, "google_b.csv.gz": b"no gzip at all"})
    got, _ = _outcomes(spark, d)
    assert (got["google_a.csv.gz"].status, got["google_b.csv.gz"].status) == ("read", "failed")


def test_first_lines_of_large_files(spark):
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    row = "2024-01-05,x,3,2000000,9\n"
    d = _dir({f"google %d{i}+.csv": HEADER + row * n for i, n in enumerate((400_000, 1, 30_000))})
    assert [f.header[0] for f in E.scan_files(spark, d)] == ["segments_date"] * 3
    assert spark.conf.get("spark.sql.files.maxPartitionBytes") == before
    assert E.load_long(spark, d).count() == 430_001
    got, _ = _outcomes(spark, d)
    assert {k: r.raw_rows for k, r in got.items()} == {"google %d0+.csv": 400_000, "google %d1+.csv": 1, "google %d2+.csv": 30_000}


def test_strict_run_stops_on_a_recognised_file_without_rows(spark):
    good = HEADER + "2024-01-05,x,3,2000000,9\n"
    with pytest.raises(ValueError, match="bing_stats.csv"):
        batch.ingest(spark, _dir({"google_a.csv": good, "bing_stats.csv": "TimePeriod,Spend\nn/a,1\n"}))
    report = tempfile.mkdtemp(prefix="sw-report-")
    # a file of no known platform is reported and does not stop the run
    long = batch.ingest(spark, _dir({"google_a.csv": good, "notes.csv": "some,words\nno,date\n"}), report_dir=report)
    assert long.count() == 1 and "rejects" not in long.columns
    assert sorted(r.status for r in spark.read.json(report + "/file_outcomes").collect()) == ["read", "zero_rows"]


def test_headers_are_read_without_the_rest_of_the_file(spark):
    d = _dir({f"google_{i}+.csv": HEADER + "2024-01-05,x,3,2000000,9\n" * 400_000 for i in range(2)})
    paths = [path for path, _ in E.list_csv_files(spark, d)]

    def bytes_read():
        return sum(s.getBytesRead() for s in spark._jvm.org.apache.hadoop.fs.FileSystem.getAllStatistics())

    before = bytes_read()
    lines = E._first_lines(spark, paths)
    assert lines == {path: HEADER.strip() for path in paths}
    assert bytes_read() - before < sum(os.path.getsize(os.path.join(d, f)) for f in os.listdir(d)) / 10


def test_rejects_are_parsed_once_a_row_and_counted_by_name(spark):
    d = _dir({"a+b.csv": HEADER + "2024-01-05,x,-0,1e40,9\nbad,x,-1,,n/a\n", "c d.csv": HEADER + "01/25/2024,x,1,1,-2\nbad,x,,1,1\n"})
    parsed = E.load_long(spark, d, with_file=True, rejects=True)
    cells = E.rejected_cells(parsed, lambda path: E.F.lit("all"))
    filters = [line for line in cells._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Filter" in line]
    assert filters and not any("gettimestamp" in line for line in filters)
    assert sorted((r.column, r.reason, r.cells) for r in cells.collect()) == [
        ("clicks", "blank", 1), ("clicks", "negative", 1), ("date", "not_a_date", 2), ("revenue", "negative", 1), ("revenue", "not_a_number", 1),
        ("spend", "blank", 1), ("spend", "not_a_number", 1)]
    assert sorted({r.source_file.rsplit("/", 1)[-1] for r in E.rejected_cells(parsed).collect()}) == ["a+b.csv", "c d.csv"]


def test_outcomes_read_the_files_once(spark):
    row = "2024-01-05,x,3,2000000,9\n"
    d = _dir({"google_a.csv": HEADER + row * 200_000, "bing_b.csv": HEADER + ",x,1,1,1\n" * 200_000})
    size = sum(os.path.getsize(os.path.join(d, f)) for f in os.listdir(d))
    files = E.scan_files(spark, d)

    def bytes_read():
        return sum(s.getBytesRead() for s in spark._jvm.org.apache.hadoop.fs.FileSystem.getAllStatistics())

    before = bytes_read()
    out = E.file_outcomes(spark, files, E.load_long(spark, d, with_file=True, rejects=True, files=files))
    stop = E.broken_files(out).select(E.FILE_COL, E.F.lit(1).alias("stops"))
    got = {(r.status, r.raw_rows, r.stops) for r in out.join(stop, E.FILE_COL, "left").collect()}
    assert got == {("read", 200_000, None), ("zero_rows", 200_000, 1)}
    assert bytes_read() - before < 1.5 * size


def test_dates_and_rejects_of_a_row_parse_its_cell_once(spark):
    d = _dir({"google_a.csv": HEADER + "2024-01-05,x,3,2000000,9\nbad,x,1,1,1\n"})
    parsed = E.load_long(spark, d, with_file=True, rejects=True)

    def parsers(df):
        return df._jdf.queryExecution().optimizedPlan().toString().count("substring_index(")

    assert parsers(parsed.select("date", E.REJECTS)) == parsers(parsed.select("date")) > 0


def test_outcomes_of_files_of_one_name_are_pooled(spark):
    d = _dir({
        "google_a.csv": HEADER + "2024-01-05,x,3,2000000,9\nbad,z,n/a,1,1\n2024-01-07,y,-1,n/a,\n",
        "google_b.csv": HEADER + "2024-01-09,x,1,1000000,2\n2024-01-01,w,,3000000,4\n",
        "notes.csv": "some,words\nno,date\n",
    })
    files = E.scan_files(spark, d)
    parsed = E.load_long(spark, d, with_file=True, rejects=True, files=files)
    got = {r.source_file: r for r in E.file_outcomes(spark, files, parsed, lambda path: E.F.regexp_extract(path, "(google|notes)[^/]*$", 1)).collect()}
    a = got["google"]
    assert (a.status, a.files, a.raw_rows, a.parsed_rows, a.dropped_rows, a.campaigns, float(a.spend), float(a.revenue), a.zeroed_cells) == (
        "read", 2, 5, 4, 1, 3, 6.0, 15.0, 5)
    assert (str(a.date_min), str(a.date_max)) == ("2024-01-01", "2024-01-09")
    assert (got["notes"].status, got["notes"].raw_rows, got["notes"].zeroed_cells) == ("zero_rows", 1, 0)
