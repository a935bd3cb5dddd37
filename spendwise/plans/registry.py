"""Query registry used by ``__spark_entry__``.

Each entry is a callable ``(spark, sf_dir) -> DataFrame`` over the driver's
tables (shaped into ad exports by :mod:`spendwise.sources.fixtures`) plus an
output spec.  The spec fixes column names and value kinds for comparison with
the SQL oracle: numbers are rounded to 4 decimals in double, dates rendered as
``yyyy-MM-dd`` text, integers widened to bigint.
"""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Spec = list[tuple[str, str]]  # (column, kind) with kind in str|num|dollars|int|date
_REGISTRY: dict[str, tuple[Callable[[SparkSession, str], DataFrame], Spec]] = {}


def register(name: str, spec: Spec):
    def deco(fn):
        _REGISTRY[name] = (fn, spec)
        return fn

    return deco


# Numbers are quantised to 4 decimals below 1e4 and to 8 significant digits
# above (bands by magnitude): far coarser than double summation-order noise at
# any magnitude, and computed by the same IEEE operations in both engines.
_BANDS = [(10.0 ** (4 + i), 4 - i) for i in range(12)]


def _quantise(c):
    a = F.abs(c)
    out = None
    for bound, digits in _BANDS:
        scale = 10.0 ** digits
        v = (F.round(c * scale, 0) / scale) if digits >= 0 else (F.round(c / (10.0 ** -digits), 0) * (10.0 ** -digits))
        out = F.when(a < bound, v) if out is None else out.when(a < bound, v)
    return out.otherwise(c)


def _quantise_sql(q: str) -> str:
    parts = []
    for bound, digits in _BANDS:
        scale = 10.0 ** digits
        v = f"ROUND({q} * {scale!r}) / {scale!r}" if digits >= 0 else f"ROUND({q} / {10.0 ** -digits!r}) * {10.0 ** -digits!r}"
        parts.append(f"WHEN abs({q}) < {bound!r} THEN {v}")
    return f"(CASE {' '.join(parts)} ELSE {q} END)"


def present(df: DataFrame, spec: Spec) -> DataFrame:
    cols = []
    for name, kind in spec:
        c = F.col(name)
        if kind == "num":
            # scale → round half away from zero → unscale: bit-identical in
            # Spark and DuckDB for the same input double (no decimal-expansion
            # tie differences)
            c = _quantise(c.cast("double"))
        elif kind == "dollars":
            c = F.round(c.cast("double"), 0)
        elif kind == "int":
            c = c.cast("bigint")
        elif kind == "date":
            c = F.date_format(c, "yyyy-MM-dd")
        else:
            c = c.cast("string")
        cols.append(c.alias(name))
    return df.select(*cols)


def present_sql(body: str, spec: Spec) -> str:
    cols = []
    for name, kind in spec:
        q = f'q."{name}"'
        if kind == "num":
            e = _quantise_sql(f"CAST({q} AS DOUBLE)")
        elif kind == "dollars":
            e = f"ROUND(CAST({q} AS DOUBLE))"
        elif kind == "int":
            e = f"CAST({q} AS BIGINT)"
        elif kind == "date":
            e = f"strftime(CAST({q} AS DATE), '%Y-%m-%d')"
        else:
            e = f"CAST({q} AS VARCHAR)"
        cols.append(f'{e} AS "{name}"')
    return f"SELECT {', '.join(cols)} FROM (\n{body}\n) q"


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    from . import queries as _q  # noqa: F401  (registers)

    out = {}
    for name, (fn, spec) in _REGISTRY.items():
        out[name] = (lambda f, s: (lambda spark, sf_dir: present(f(spark, sf_dir), s)))(fn, spec)
    return out


def specs() -> dict[str, Spec]:
    from . import queries as _q  # noqa: F401

    return {k: v[1] for k, v in _REGISTRY.items()}


def oracle_sql() -> dict[str, str]:
    from . import oracle as O
    from . import queries as _q  # noqa: F401

    out = {}
    for name, (_, spec) in _REGISTRY.items():
        body = O.SQL.get(name)
        if body is not None:
            wrap = O.with_train_fixtures if name in O.TRAIN_FIXTURE_QUERIES else O.WRAPPERS.get(name, O.with_fixtures)
            out[name] = present_sql(wrap(body), spec)
    return out
