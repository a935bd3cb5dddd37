"""Quantile regression forest: ordered non-negative quantiles for every
prediction row, bounded sketches, and a calibrated end-to-end forecast that
honours the output contract."""
from pyspark.sql import functions as F

from conftest import SF_SMALL
from spendwise import schema as S
from spendwise.operators import forest as QF
from spendwise.operators import quality as QA
from spendwise.plans import forecast as P
from spendwise.plans.workspace import workspace


def test_forest_quantiles(spark):
    ws = workspace(spark, SF_SMALL)
    tt = ws.training_table
    assert tt.count() > 0
    m = QF.QuantileForest(numTrees=5, maxDepth=5).fit(tt)
    assert m.sketches.agg(F.max(F.size("sketch"))).first()[0] == len(QF.SKETCH_PROBS)
    pred = m.predict(ws.prediction_table).select("campaign", "window_days", "q10", "q50", "q90").collect()
    assert len(pred) == ws.prediction_table.count()
    for r in pred:
        assert r.q10 is not None and 0 <= r.q10 <= r.q50 <= r.q90


def test_forest_forecast_contract(spark):
    ws = workspace(spark, SF_SMALL)
    out, camp, params, model = P.forest_forecast(ws.training_table, ws.prediction_table, None, numTrees=5, maxDepth=5)
    c = QA.output_contract(out).first()
    assert c.valid
    assert set(r.window_days for r in params.collect()) <= {0, *S.WINDOWS}
    assert model.drivers(spark, 8).count() == 8
