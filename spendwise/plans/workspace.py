"""Shared stages of the registered plans, materialised once per (session,
data dir).

The joined driver tables are staged, the long table is persisted where a plan reads its
rows, and everything else reads the staged sums.  Derived stages
that several plans reuse (seasonal index, curves, feature tables, the baseline
forecast) are cut with a reliable ``checkpoint()`` into the cluster's
``spark.checkpoint.dir``: later plans start from a short lineage, survive
executor loss, and their analysis stays cheap.
"""
from __future__ import annotations

from functools import cached_property

from pyspark import StorageLevel
from pyspark.sql import SparkSession

from .. import schema as S
from ..operators import base as B
from ..operators import calendar as C
from ..operators import curves as CV
from ..operators import features as FE
from ..operators import guard as G
from ..operators import rollup as R
from ..session import cut_lineage, scratch_table
from ..sources import fixtures as X

_MEMO: dict = {}


class Workspace:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir

    @cached_property
    def facts(self):
        """The joined driver tables, staged: every export is rendered from them, and in a
        stage of its own (in one stage with the joins the generated method is too long for
        the JVM to compile, and each row took tens of microseconds)."""
        return scratch_table(self.spark, X.ads_base(self.spark, self.sf_dir), "facts")

    @cached_property
    def rows(self):
        return X.ads_long(self.spark, self.sf_dir, self.facts)

    @cached_property
    def long(self):
        return self.rows.persist(StorageLevel.MEMORY_AND_DISK)

    @cached_property
    def base(self):
        """The fact summed by (campaign, channel, type, date): what most plans read.  The
        long table is not stored for it (a plan that has stored it reads that)."""
        return B.staged(self.rows)

    @cached_property
    def season(self):
        return cut_lineage(C.seasonal_index(self.base))

    @cached_property
    def curves(self):
        return cut_lineage(CV.channel_curves(self.base))

    @cached_property
    def prediction_table(self):
        return cut_lineage(FE.prediction_table(self.base, S.WINDOWS, self.season))

    @cached_property
    def training_table(self):
        return cut_lineage(FE.training_table(self.base, S.WINDOWS, S.TRAIN_CUT_STEP, self.season))

    @cached_property
    def baseline_campaign(self):
        """Campaign rows with G8 baseline quantiles as the revenue forecast."""
        return cut_lineage(G.with_baseline_quantiles(self.prediction_table, 1.0, prefix=""))

    @cached_property
    def forecast(self):
        return cut_lineage(R.reconcile(self.baseline_campaign))


def workspace(spark: SparkSession, sf_dir: str) -> Workspace:
    key = sf_dir
    ws = _MEMO.get(key)
    if ws is None or ws.spark is not spark or spark.sparkContext._jsc is None:
        ws = Workspace(spark, sf_dir)
        _MEMO[key] = ws
    return ws
