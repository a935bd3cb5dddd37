"""Versioned model bundles (S6, S7): everything that a later forecast needs.

``<path>/v000001/`` holds the learner (MLlib writer or fixed splits, with its leaf
sketches), the calibration, the seasonal index, the response curves, the training
profile as a JSON side-car, and a manifest.  The manifest is written last, so a
version without one is an unfinished save and is passed over; a new save takes the
next number and leaves readers of earlier versions alone.
"""
from __future__ import annotations

import json
import re

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

from .. import schema as S

FORMAT = 1
#: small tables of a bundle, each a Parquet folder
TABLES = ("calibration", "season", "curves")


def _children(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder of any Hadoop file system; none if it does not exist."""
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return [x.getPath().getName() for x in fs.listStatus(folder)] if fs.exists(folder) else []


def versions(spark: SparkSession, path: str, finished: bool = True) -> list[int]:
    """Version numbers under ``path``, ascending; ``finished``: those with a manifest."""
    found = sorted(int(n[1:]) for n in _children(spark, path) if re.fullmatch(r"v\d{6,}", n))
    return [v for v in found if not finished or "_SUCCESS" in _children(spark, f"{_folder(path, v)}/manifest")]


def _folder(path: str, version: int) -> str:
    return f"{path.rstrip('/')}/v{version:06d}"


def save(spark: SparkSession, path: str, forest, tables: dict[str, DataFrame], profile: DataFrame | None,
         fallback_roas: float, windows) -> int:
    """Writes the next version and returns its number."""
    version = max(versions(spark, path, finished=False), default=0) + 1
    folder = _folder(path, version)
    forest.save(folder)
    for name in TABLES:
        tables[name].coalesce(1).write.parquet(f"{folder}/{name}")  # a few rows each
    if profile is not None:
        profile.coalesce(1).write.json(f"{folder}/training_profile")
    manifest = {"format": FORMAT, "version": version, "features": list(S.DESIGN_COLUMNS), "windows": list(windows),
                "fallback_roas": fallback_roas, "trees": forest.trees, "accuracy": forest.accuracy, "profile": profile is not None}
    spark.createDataFrame([(json.dumps(manifest),)], "value string").coalesce(1).write.text(f"{folder}/manifest")
    return version


def read_manifest(spark: SparkSession, path: str, version: int | None = None) -> dict:
    """The manifest of ``version``, or of the newest finished one."""
    known = versions(spark, path)
    if not known or version is not None and version not in known:
        raise FileNotFoundError(f"no finished model {'' if version is None else f'version {version} '}under {path!r}")
    version = version or known[-1]
    manifest = json.loads(spark.read.text(f"{_folder(path, version)}/manifest").first().value)
    if manifest["format"] != FORMAT:
        raise ValueError(f"model format {manifest['format']} under {path!r}; this library reads {FORMAT}")
    if manifest["features"] != list(S.DESIGN_COLUMNS):
        raise ValueError(f"the model under {path!r} was fitted on other features")
    return manifest


def load(spark: SparkSession, path: str, version: int | None = None) -> dict:
    """Manifest entries plus ``forest``, the small tables and ``training_profile`` (None if
    it is lost or cannot be read)."""
    from ..operators.forest import QuantileForest
    from ..operators.guard import load_profile

    out = read_manifest(spark, path, version)
    folder = _folder(path, out["version"])
    out["forest"] = QuantileForest.load(spark, folder, out["trees"])
    for name in TABLES:
        try:
            out[name] = spark.read.parquet(f"{folder}/{name}")
        except AnalysisException as e:
            raise FileNotFoundError(f"the model under {folder!r} lacks {name}") from e
    out["training_profile"] = load_profile(spark, f"{folder}/training_profile") if out["profile"] else None
    return out
