"""Advertising exports → one long table.

Exports differ in their headers.  One ``csv()`` call over files with different
headers would apply one header positionally to every file, so files are grouped
by header signature and each group becomes one scan with an explicit,
positional all-string schema.  Each group is normalised by a single projection
(:func:`to_long`) and the groups are unioned by name.

Headers are read by tasks (one per file, stopped after its first line), and every
file has an outcome: read, skipped, failed or zero_rows (:func:`file_outcomes`).
"""
from __future__ import annotations

import re
from collections import OrderedDict
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager
from dataclasses import dataclass
from urllib.parse import unquote

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schema as S
from ..functions import normalize as N
from ..session import cut_lineage

FILE_COL = "source_file"
REJECTS = "rejects"
REJECT_TYPE = "array<struct<column: string, reason: string>>"
#: the column in which a cell's date is parsed where a plan may read both it and the rejects
PARSED_DATE = "_parsed_date"
#: a reader that packs files by size gives each file (up to 4 TB of it) its own task
ONE_FILE_A_TASK = {"spark.sql.files.maxPartitionBytes": str(1 << 42), "spark.sql.files.openCostInBytes": str(1 << 42),
                   "spark.sql.files.maxPartitionNum": None}
#: files whose headers are read at the same time
HEADER_JOBS = 16


def to_long(
    df: DataFrame,
    channel_hint: str | None = None,
    columns: list[str] | None = None,
    hint_col: Column | None = None,
    keep: list[str] = (),
    rejects: bool = False,
) -> DataFrame:
    """Map one export (any header layout) to ``LONG_SCHEMA``.

    ``columns`` gives the *original* header names when ``df`` carries
    positional names (duplicate headers); ``hint_col`` is a per-row channel
    hint (from the file name) that beats the header signature but loses to a
    per-row channel column.  Never raises on unknown input; rows without a
    parseable date are dropped.

    ``rejects`` is the side output of the parser: undated rows stay (null date) and a
    column ``rejects`` lists the cells of the row that were not taken as they are, as
    (column, reason): a date that is ``absent`` (no such column), ``blank`` or
    ``not_a_date``, a metric that counts as 0 for being ``blank``, ``not_a_number`` or
    ``negative``.  A metric without a column is 0 and no reject.
    """
    cols = list(columns) if columns is not None else list(df.columns)
    phys = df.columns

    def col_of(field: str) -> Column | None:
        i = N.resolve(cols, field)
        return None if i is None else F.col(f"`{phys[i]}`")

    ch = col_of("channel")
    if ch is not None:
        channel = N.normalize_channel(ch)
    else:
        channel = F.lit(N.header_channel(cols)) if channel_hint is None else N.normalize_channel(F.lit(channel_hint))
        if hint_col is not None and channel_hint is None:
            channel = F.coalesce(hint_col, channel)

    def text_or(c: Column | None, default: str) -> Column:
        # missing column → default; null cell → 'nan' (text rendering of a null)
        return F.lit(default) if c is None else F.coalesce(c.cast("string"), F.lit("nan"))

    date_c = col_of("date")
    date = N.to_date(date_c) if date_c is not None else F.lit(None).cast("date")
    if rejects and date_c is not None:
        # parsed in a column of its own: in one projection the date and the rejects parse every cell twice
        df = df.withColumn(PARSED_DATE, date)
        date = F.col(PARSED_DATE)
    campaign = text_or(col_of("campaign"), "unknown_campaign")
    adset = F.lit("") if col_of("adset") is None else text_or(col_of("adset"), "")
    raw_type = F.lit("") if col_of("campaign_type") is None else text_or(col_of("campaign_type"), "")

    metrics = {}
    for m in S.METRICS:
        i = N.resolve(cols, m)
        if i is None:
            metrics[m] = F.lit(0).cast(S.MONEY)
        else:
            micros = m == "spend" and S.MICROS_TOKEN in N.norm_name(cols[i])
            metrics[m] = N.to_metric(F.col(f"`{phys[i]}`"), divide_micros=micros)
    bad = []
    if rejects:
        # literal arrays and native conditions: a filter of one array takes the whole parser out of generated code
        none = F.array().cast(REJECT_TYPE)

        def found(column, reason):
            return F.array(F.struct(F.lit(column).alias("column"), F.lit(reason).alias("reason"))).cast(REJECT_TYPE)

        def blank(column, cell):
            return F.when(cell.isNull() | (F.trim(cell.cast("string")) == ""), found(column, "blank"))

        bad.append(found("date", "absent") if date_c is None else
                   blank("date", date_c).when(date.isNull(), found("date", "not_a_date")).otherwise(none))
        for m in S.METRICS:
            cell = col_of(m)
            if cell is not None:
                number = cell.try_cast(S.MONEY)
                bad.append(blank(m, cell).when(F.coalesce(number >= 0, F.lit(False)), none)
                           .when(number.isNull(), found(m, "not_a_number")).otherwise(found(m, "negative")))
    bud = col_of("budget")
    budget = F.lit(0).cast(S.MONEY) if bud is None else N.to_metric(bud)

    # Staged projections: the normalised keys are computed once as columns and
    # the rule chains reference them, which keeps each generated projection
    # small enough for whole-stage codegen.
    out = df.select(
        date.alias("date"),
        channel.alias("channel"),
        campaign.alias("campaign"),
        N.match_key(raw_type).alias("_t"),
        N.match_key(F.concat_ws(" ", campaign, adset)).alias("_nb"),
        *[v.alias(k) for k, v in metrics.items()],
        budget.alias("daily_budget"),
        *[F.col(k) for k in keep],
        *([F.concat(*bad).alias(REJECTS)] if rejects else []),
    )
    if not rejects:
        out = out.where(F.col("date").isNotNull())
    out = out.withColumn("campaign_type", N.campaign_type_from_keys(F.col("channel"), F.col("_t"), F.col("_nb")))
    out = out.withColumn("is_brand", N.is_brand_from_key(F.col("campaign_type"), F.col("_nb")))
    return out.select(*S.LONG_COLUMNS, *keep, *([REJECTS] if rejects else []))


def empty_long(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], S.LONG_SCHEMA)


def union_long(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def combine(spark: SparkSession, sources: list[tuple[DataFrame, str | None]]) -> DataFrame:
    """Several exports, each with an optional explicit channel hint."""
    if not sources:
        return empty_long(spark)
    return union_long([to_long(df, hint) for df, hint in sources])


# ---------------------------------------------------------------------------
# CSV directory scan
# ---------------------------------------------------------------------------


@dataclass(frozen=True)
class ExportFile:
    """A listed file; ``header`` is None when no first line could be read."""

    path: str
    bytes: int
    header: tuple[str, ...] | None

    @property
    def channel_hint(self) -> str | None:
        return N.channel_from_filename(self.path)


@contextmanager
def _settings(spark: SparkSession, values: dict[str, str | None]):
    """Session settings for one scan (None: not set)."""
    before = {k: spark.conf.get(k, None) for k in values}

    def put(settings):
        for k, v in settings.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)

    put(values)
    try:
        yield
    finally:
        put(before)


def list_csv_files(spark: SparkSession, data_dir: str) -> list[tuple[str, int]]:
    """Recursive listing of (path, bytes): ``*.csv`` first, then ``*.csv*`` (compressed)."""
    for pattern in ("*.csv", "*.csv*"):
        listing = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern)
        try:
            found = listing.load(data_dir).select("path", "length")
            files = {f.path: f.length for f in found.collect()}  # file metadata only (one row per file)
            # the reader yields no row for a file without bytes, but lists it
            files = {re.sub("^file:/+", "file:/", unquote(path)): 0 for path in found.inputFiles()} | files
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            files = {}
        if files:
            return sorted(files.items())
    raise FileNotFoundError(f"No CSV files found under {data_dir!r}")


def _first_lines(spark: SparkSession, paths: list[str]) -> dict[str, str]:
    """The first line of every file that has a readable one.  Each file is a job of its own,
    some at a time, whose one task stops after a line, whatever the size of the file (after a
    Python function that returns early Spark still reads the file to its end); the driver
    gets one line per file."""
    def first(path):
        return [r.value for r in spark.read.option("ignoreCorruptFiles", "true").text(path).take(1)]

    with _settings(spark, ONE_FILE_A_TASK), ThreadPoolExecutor(HEADER_JOBS) as pool:
        return {path: line for path, lines in zip(paths, pool.map(first, paths)) for line in lines}


def _split_header(line: str) -> tuple[str, ...]:
    import csv
    import io

    row = next(csv.reader(io.StringIO(line.lstrip("\ufeff"))), [])
    return tuple(c.strip() for c in row)


def scan_files(spark: SparkSession, data_dir: str) -> list[ExportFile]:
    """Every listed file with its header (one small record per file)."""
    listed = list_csv_files(spark, data_dir)
    full = [path for path, size in listed if size > 0]
    lines = _first_lines(spark, full) if full else {}
    return [ExportFile(path, size, _split_header(lines[path]) if lines.get(path) else None) for path, size in listed]


def group_by_signature(files: list[ExportFile]) -> "OrderedDict[tuple, list[str]]":
    groups: OrderedDict[tuple, list[str]] = OrderedDict()
    for f in files:
        if f.header is not None:
            groups.setdefault(f.header, []).append(f.path)
    return groups


def read_signature_group(spark: SparkSession, header: tuple, paths: list[str]) -> DataFrame:
    """One scan per header signature with an explicit positional schema, so
    duplicate / case-colliding headers keep their own positions."""
    schema = T.StructType([T.StructField(f"c{i}", T.StringType()) for i in range(len(header))])
    path = F.col("_metadata.file_path")
    return (
        spark.read.schema(schema)
        .option("header", "true")
        .option("mode", "PERMISSIVE")
        .option("multiLine", "false")
        .csv(paths)
        # the path is given percent-encoded (most hold nothing to decode); url_decode would take a plus for a blank
        .withColumn(FILE_COL, F.when(path.contains("%"), F.url_decode(F.replace(path, F.lit("+"), F.lit("%2B")))).otherwise(path))
    )


def load_long(spark: SparkSession, data_dir: str, with_file: bool = False, rejects: bool = False,
              files: list[ExportFile] | None = None) -> DataFrame:
    """Every CSV under ``data_dir`` → one long frame.

    The channel hint comes from each row's file name (per row, so one scan
    covers all files of one signature).  ``with_file`` keeps the source path
    for per-file reports, ``rejects`` the parser's side output (see
    :func:`to_long`); ``files`` is an earlier :func:`scan_files`."""
    files = scan_files(spark, data_dir) if files is None else files
    frames = []
    for header, group in group_by_signature(files).items():
        raw = read_signature_group(spark, header, group)
        frames.append(
            to_long(
                raw,
                columns=list(header) + [FILE_COL],
                hint_col=N.channel_from_path(F.col(FILE_COL)),
                keep=[FILE_COL] if with_file else [],
                rejects=rejects,
            )
        )
    if not frames:
        out = empty_long(spark)
        out = out.withColumn(FILE_COL, F.lit(None).cast("string")) if with_file else out
        return out.withColumn(REJECTS, F.array().cast(REJECT_TYPE)) if rejects else out
    return union_long(frames)


def file_outcomes(spark: SparkSession, files: list[ExportFile], parsed: DataFrame,
                  name: Callable[[Column], Column] = lambda path: path) -> DataFrame:
    """One row per file, or per ``name`` of its path (files of one name are
    pooled), with what became of it:

    ``failed``     bytes, but no first line could be read;
    ``skipped``    no bytes, or a header without rows;
    ``zero_rows``  rows, but none with a date;
    ``read``       the rest.

    ``parsed`` is :func:`load_long` of the same files with ``with_file`` and ``rejects``;
    it is read once, by this call, into sums per file and campaign and then per name; those
    (a row per file at most) are cut from their lineage, so that a plan that reads the outcomes
    again parses nothing again.  Names are made of sums, not of rows, and no filter on a name
    gets down to the rows."""
    listed = spark.createDataFrame(
        [(f.path, f.bytes, f.channel_hint, f.header is not None, f.header is not None and N.has_revenue_column(f.header)) for f in files],
        f"{FILE_COL} string, bytes long, channel_hint string, has_header boolean, has_revenue boolean")
    listed = listed.groupBy(name(F.col(FILE_COL)).alias(FILE_COL)).agg(
        F.count("*").alias("files"), F.sum("bytes").alias("bytes"), F.min("channel_hint").alias("channel_hint"),
        F.count_if(~F.col("has_header") & (F.col("bytes") > 0)).alias("unreadable"), F.max("has_revenue").alias("has_revenue"))
    dated = F.col("date").isNotNull()
    sums = parsed.groupBy(FILE_COL, F.when(dated, F.col("campaign")).alias("campaign")).agg(
        F.count("*").alias("raw_rows"), F.count("date").alias("parsed_rows"),
        F.min("date").alias("date_min"), F.max("date").alias("date_max"),
        F.sum(F.when(dated, F.col("spend"))).alias("spend"), F.sum(F.when(dated, F.col("revenue"))).alias("revenue"),
        # native: a filter by a lambda would take the aggregate out of generated code
        F.sum(F.size(F.array_remove(F.col(REJECTS)["column"], "date"))).alias("zeroed_cells"),
    )
    rows = cut_lineage(sums.groupBy(name(F.col(FILE_COL)).alias(FILE_COL)).agg(
        *[F.sum(c).alias(c) for c in ("raw_rows", "parsed_rows")], F.min("date_min").alias("date_min"), F.max("date_max").alias("date_max"),
        F.count_distinct("campaign").alias("campaigns"), *[F.sum(c).alias(c) for c in ("spend", "revenue", "zeroed_cells")]))
    none = F.lit(0).cast("long")
    x = listed.join(rows, FILE_COL, "left").select(
        *listed.columns, *[F.coalesce(c, none).alias(c) for c in ("raw_rows", "parsed_rows", "campaigns", "zeroed_cells")],
        "date_min", "date_max", *[F.coalesce(c, F.lit(0).cast(S.MONEY)).alias(c) for c in ("spend", "revenue")])
    status = (F.when(F.col("parsed_rows") > 0, "read").when(F.col("raw_rows") > 0, "zero_rows")
              .when(F.col("unreadable") > 0, "failed").otherwise("skipped"))
    return x.withColumn("status", status).withColumn("dropped_rows", F.col("raw_rows") - F.col("parsed_rows"))


def rejected_cells(parsed: DataFrame, name: Callable[[Column], Column] = lambda path: path) -> DataFrame:
    """Q4: cells that were not taken as they are, counted by (file, column, reason).  The outer
    explode makes the parser run once a row: the optimizer copies the array that an inner one
    or a filter reads into a filter below.  Names are made of counts, not of cells."""
    cells = parsed.select(FILE_COL, F.explode_outer(REJECTS).alias("r")).where(F.col("r").isNotNull())
    counts = cells.groupBy(FILE_COL, F.col("r.column").alias("column"), F.col("r.reason").alias("reason")).agg(F.count("*").alias("cells"))
    return counts.groupBy(name(F.col(FILE_COL)).alias(FILE_COL), "column", "reason").agg(F.sum("cells").alias("cells"))


def broken_files(outcomes: DataFrame) -> DataFrame:
    """Q1: files that must stop a strict run: of a recognised platform, with rows, none
    of them parsed."""
    return outcomes.where((F.col("status") == "zero_rows") & F.col("channel_hint").isNotNull())
