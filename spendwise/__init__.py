"""spendwise — marketing-performance forecasting on Spark.

Every operator is a ``DataFrame -> DataFrame`` transformation built from
native Spark SQL expressions (plus MLlib for the quantile learner).  The
subpackages are:

* ``sources``    exports → long table (signature-grouped CSV reader), sinks
* ``functions``  column-expression builders (normalisation, guards, ratios)
* ``operators``  daily series, trailing features, calendar, curves, learner,
                 calibration, guard, roll-up, backtest, quality, insights
* ``plans``      end-to-end plans (forecast, train, backtest) and the query
                 registry used by ``__spark_entry__``
"""

__all__ = ["session", "schema"]
