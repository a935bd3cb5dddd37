"""Quantile regression forest.

MLlib has no pinball-loss booster, so the quantile learner is a quantile
regression forest: an MLlib ``RandomForestRegressor`` on log1p(revenue) whose
leaf assignments (``leafCol``) index per-(tree, leaf) quantile sketches of the
training targets.  A small table of trees given by the caller can take the
place of the learned splits; its leaves are plain CASE expressions.

Fitting explodes rows x trees once and aggregates at once into sketches of
bounded size.  Predicting is a projection: the sketches of all leaves are one
row of nested arrays, indexed by tree and leaf, and each row reads its leaves'
sketches, sorts them in place and takes the percentiles.  That row is broadcast
while its counted size fits ``SKETCH_BYTES``; a larger forest falls back to a join
on (tree, leaf).
"""
from __future__ import annotations

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import RandomForestRegressionModel, RandomForestRegressor
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schema as S
from ..session import cut_lineage
from .guard import finite

SKETCH_PROBS = [round((i + 0.5) / 25, 4) for i in range(25)]  # 25 evenly spaced
QUANTILES = (0.1, 0.5, 0.9)
#: ranks of a sketch's quantiles are exact for leaves of up to about half as many rows
SKETCH_ACCURACY = 10_000
#: the broadcast row of all sketches holds at most this many bytes
SKETCH_BYTES = 64 << 20
FOREST = dict(numTrees=30, maxDepth=9, minInstancesPerNode=20, featureSubsetStrategy="all",
              subsamplingRate=0.7, seed=42, maxMemoryInMB=1024, cacheNodeIds=True)


def design(df: DataFrame) -> DataFrame:
    """Numeric features + fixed one-hot (channel, type) + is_brand as a
    vector.  Fixed vocabularies → identical layout for train and predict;
    non-finite or missing → 0."""
    cols = []
    for n in S.NUMERIC_FEATURES:
        v = F.col(n).cast("double") if n in df.columns else F.lit(0.0)
        cols.append(F.when(finite(v), v).otherwise(F.lit(0.0)).alias(n))
    cols += [(F.col("channel") == c).cast("double").alias(f"ch_{c}") for c in S.CHANNELS]
    cols += [(F.col("campaign_type") == t).cast("double").alias(f"ct_{t}") for t in S.CAMPAIGN_TYPES]
    cols.append(F.coalesce(F.col("is_brand").cast("double"), F.lit(0.0)).alias("x_is_brand"))
    names = list(S.NUMERIC_FEATURES) + [f"ch_{c}" for c in S.CHANNELS] + [f"ct_{t}" for t in S.CAMPAIGN_TYPES] + ["x_is_brand"]
    x = df.select(*[c for c in df.columns if c not in names], *cols)
    return VectorAssembler(inputCols=names, outputCol="features", handleInvalid="keep").transform(x)


def _leaf_of(tree, first: int = 0) -> tuple[Column, int]:
    """Leaf number (in order, left before right) of a tree of (feature, threshold,
    left, right) tuples, with None for a leaf; left is feature <= threshold."""
    if tree is None:
        return F.lit(first), first + 1
    feature, threshold, left, right = tree
    on_left, middle = _leaf_of(left, first)
    on_right, end = _leaf_of(right, middle)
    return F.when(F.col(feature) <= F.lit(float(threshold)), on_left).otherwise(on_right), end


def _splits(tree) -> list[str]:
    return [] if tree is None else [tree[0], *_splits(tree[2]), *_splits(tree[3])]


class QuantileForest:
    """``trees``: fixed splits in place of learned ones (see :func:`_leaf_of`)."""

    def __init__(self, trees=None, accuracy: int = SKETCH_ACCURACY, **params):
        self.trees = trees
        self.accuracy = accuracy
        self.params = {**FOREST, **params}
        self.model = None
        self.sketches = None
        self.fallback_roas = 1.0  # for campaigns without any trailing ROAS

    def _leaves(self, x: DataFrame) -> DataFrame:
        """``x`` (a design) with the array ``leaf``: leaf number by tree."""
        if self.trees is not None:
            return x.withColumn("leaf", F.array(*[_leaf_of(t)[0] for t in self.trees]))
        return self.model.transform(x).withColumn("leaf", F.transform(vector_to_array("leaf"), lambda v: v.cast("int")))

    def fit(self, train: DataFrame, target: str = "target_revenue") -> "QuantileForest":
        x = design(train).withColumn("label", F.log1p(F.greatest(F.col(target).cast("double"), F.lit(0.0))))
        if self.trees is None:
            rf = RandomForestRegressor(featuresCol="features", labelCol="label", leafCol="leaf", **self.params)
            self.model = rf.fit(x)
        leaves = self._leaves(x).select("label", F.posexplode("leaf").alias("tree", "leaf"))
        # one bounded sketch per (tree, leaf); cut so every prediction reuses it
        self.sketches = cut_lineage(leaves.groupBy("tree", "leaf").agg(
            F.percentile_approx("label", F.array(*[F.lit(p) for p in SKETCH_PROBS]), self.accuracy).alias("sketch")
        ))
        return self

    def _by_leaf(self) -> DataFrame:
        """One row: the sketches as arrays by tree, by leaf."""
        by_tree = self.sketches.groupBy("tree").agg(
            F.max("leaf").alias("top"), F.map_from_entries(F.collect_list(F.struct("leaf", "sketch"))).alias("of"))
        by_tree = by_tree.select("tree", F.transform(F.sequence(F.lit(0), F.col("top")), lambda leaf: F.element_at("of", leaf)).alias("sketches"))
        return by_tree.agg(F.transform(F.array_sort(F.collect_list(F.struct("tree", "sketches"))), lambda t: t["sketches"]).alias("_sketches"))

    def predict(self, table: DataFrame, key=("campaign", "window_days")) -> DataFrame:
        """Adds q10/q50/q90 (revenue scale) to ``table``.  ``key`` identifies a row; only
        a forest too large to broadcast needs it."""
        x = self._leaves(design(table.withColumn("_row", F.struct(*table.columns))))
        if self.sketches.count() * (len(SKETCH_PROBS) * 8 + 64) > SKETCH_BYTES:
            return self._predict_by_join(table, x, key)
        x = x.select("_row", "leaf").crossJoin(F.broadcast(self._by_leaf()))
        own = F.transform("leaf", lambda leaf, tree: F.coalesce(F.get(F.get("_sketches", tree), leaf), F.array().cast("array<double>")))
        x = x.select("_row", F.sort_array(F.flatten(own)).alias("_v"))

        def percentile(p: float) -> Column:  # linear between the neighbours of p * (n - 1)
            at = F.lit(p) * (F.size("_v") - 1)
            low = F.floor(at).cast("int")
            a = F.get("_v", low)
            return F.expm1(a + (at - low) * (F.coalesce(F.get("_v", low + 1), a) - a))

        return x.select("_row.*", *[percentile(p).alias(f"q{int(p * 100)}") for p in QUANTILES])

    def _predict_by_join(self, table: DataFrame, x: DataFrame, key) -> DataFrame:
        lv = x.select(*[F.col(f"_row.{k}").alias(k) for k in key], F.posexplode("leaf").alias("tree", "leaf"))
        vals = lv.join(self.sketches, ["tree", "leaf"]).select(*key, F.explode("sketch").alias("v"))
        q = vals.groupBy(*key).agg(F.percentile("v", F.array(*[F.lit(p) for p in QUANTILES])).alias("q"))
        q = q.select(*key, *[F.expm1(F.col("q")[i]).alias(f"q{int(p * 100)}") for i, p in enumerate(QUANTILES)])
        return table.join(q, list(key), "left")

    def drivers(self, spark, top: int = 8) -> DataFrame:
        """T5: feature importances normalised to shares, top k (fixed trees: shares of
        the splits)."""
        names = list(S.NUMERIC_FEATURES) + [f"ch_{c}" for c in S.CHANNELS] + [f"ct_{t}" for t in S.CAMPAIGN_TYPES] + ["is_brand"]
        if self.trees is not None:
            used = [f.replace("x_is_brand", "is_brand") for t in self.trees for f in _splits(t)]
            imp = [float(used.count(n)) for n in names]
        else:
            imp = self.model.featureImportances.toArray().tolist()
        tot = sum(imp) or 1.0
        df = spark.createDataFrame([(n, float(v) / tot) for n, v in zip(names, imp)], "feature string, importance double")
        return df.orderBy(F.col("importance").desc(), "feature").limit(top)

    def save(self, path: str) -> None:
        """MLlib writer for the learned splits, Parquet for the sketches."""
        if self.trees is None:
            self.model.write().overwrite().save(f"{path}/forest")
        self.sketches.write.mode("overwrite").parquet(f"{path}/sketches")

    @classmethod
    def load(cls, spark: SparkSession, path: str, trees=None) -> "QuantileForest":
        out = cls(trees)
        if trees is None:
            out.model = RandomForestRegressionModel.load(f"{path}/forest")
        out.sketches = spark.read.parquet(f"{path}/sketches")
        return out
