"""Train once, predict many: what is loaded forecasts exactly what was in memory, a
lost profile only turns the guard off, unfinished versions are passed over."""
import os
import shutil
import tempfile

import pytest

from conftest import SF_SMALL
from spendwise import schema as S
from spendwise.operators import forest as QF
from spendwise.plans import batch
from spendwise.plans.model import ForecastModel, train
from spendwise.plans.queries import SMALL
from spendwise.plans.workspace import workspace
from spendwise.sources import bundle
from spendwise.sources import fixtures as X
from spendwise.sources import sinks as SK

KEY = ["campaign", "window_days"]


@pytest.fixture(scope="module")
def fitted(spark):
    ws = workspace(spark, SF_SMALL)
    return ws, train(ws.long, season=ws.season, training_table=ws.training_table, numTrees=4, maxDepth=5)


def rows(df, *order):
    return df.orderBy(*order).collect()


def test_loaded_model_forecasts_as_the_one_in_memory(spark, fitted):
    ws, model = fitted
    path = tempfile.mkdtemp(prefix="sw-model-")
    assert model.save(path) == 1 and model.save(path) == 2
    loaded = ForecastModel.load(spark, path)
    assert loaded.version == 2 and ForecastModel.load(spark, path, 1).version == 1
    assert loaded.fallback_roas == model.fallback_roas and loaded.windows == tuple(S.WINDOWS)
    for name in ("calibration", "season", "curves", "profile"):
        a, b = getattr(model, name), getattr(loaded, name)
        assert sorted(map(str, a.collect())) == sorted(map(str, b.select(*a.columns).collect()))
    table = ws.prediction_table
    out, camp, guard = model.predict(table)
    out2, camp2, guard2 = loaded.predict(loaded.prediction_table(ws.long))
    order = ["level", "channel", "campaign_type", "campaign", "window_days"]
    assert rows(out, *order) == rows(out2, *order)
    assert rows(camp.select(*KEY, *S.REVENUE_Q), *KEY) == rows(camp2.select(*KEY, *S.REVENUE_Q), *KEY)
    assert guard.first() == guard2.first()


def test_lost_or_broken_profile_only_turns_the_guard_off(spark, fitted):
    ws, model = fitted
    path = tempfile.mkdtemp(prefix="sw-model-")
    model.save(path)
    profile = os.path.join(path, "v000001", "training_profile")
    with_guard = model.predict(ws.prediction_table)
    for name in os.listdir(profile):
        if name.endswith(".json"):
            open(os.path.join(profile, name), "w").write("{broken")
            crc = os.path.join(profile, f".{name}.crc")
            if os.path.exists(crc):
                os.remove(crc)
    broken = ForecastModel.load(spark, path)
    assert broken.profile is None
    shutil.rmtree(profile)
    loaded = ForecastModel.load(spark, path)
    out, camp, guard = loaded.predict(ws.prediction_table)
    assert loaded.profile is None and guard is None
    assert camp.count() == with_guard[1].count() and out.count() == with_guard[0].count()


def test_unfinished_missing_and_foreign_versions(spark, fitted):
    _, model = fitted
    path = tempfile.mkdtemp(prefix="sw-model-")
    with pytest.raises(FileNotFoundError):
        ForecastModel.load(spark, f"{path}/nowhere")
    model.save(path)
    model.save(path)
    shutil.rmtree(os.path.join(path, "v000002", "manifest"))  # a save that never ended
    assert bundle.versions(spark, path) == [1] and ForecastModel.load(spark, path).version == 1
    assert model.save(path) == 3  # its number is not used again
    with pytest.raises(FileNotFoundError):
        ForecastModel.load(spark, path, 2)
    shutil.rmtree(os.path.join(path, "v000003", "curves"))
    with pytest.raises(FileNotFoundError, match="curves"):
        ForecastModel.load(spark, path)
    manifest = os.path.join(path, "v000001", "manifest")
    part = next(f for f in os.listdir(manifest) if f.startswith("part-"))
    text = open(os.path.join(manifest, part)).read()
    for f in os.listdir(manifest):
        if f.endswith(".crc"):
            os.remove(os.path.join(manifest, f))
    open(os.path.join(manifest, part), "w").write(text.replace('"format": 1', '"format": 99'))
    with pytest.raises(ValueError, match="format 99"):
        ForecastModel.load(spark, path, 1)


def test_predictions_agree_with_and_without_broadcast(spark, fitted, monkeypatch):
    ws, model = fitted
    for forest in (model.forest, QF.QuantileForest(**SMALL).fit(ws.training_table)):
        q = ["q10", "q50", "q90"]
        wide = rows(forest.predict(ws.prediction_table).select(*KEY, *q), *KEY)
        monkeypatch.setattr(QF, "SKETCH_BYTES", 0)
        joined = rows(forest.predict(ws.prediction_table).select(*KEY, *q), *KEY)
        monkeypatch.undo()
        for a, b in zip(wide, joined):
            assert a[:2] == b[:2] and all(abs(x - y) <= 1e-9 * max(1, abs(y)) for x, y in zip(a[2:], b[2:]))


def test_prediction_is_a_projection(spark, fitted):
    """No shuffle of the predicted rows: one broadcast of the sketches' row."""
    ws, model = fitted
    plan = model.forest.predict(ws.prediction_table)._jdf.queryExecution().executedPlan().toString()
    assert "posexplode" not in plan and "SortMergeJoin" not in plan and "BroadcastNestedLoopJoin" in plan


def test_batch_train_then_predict(spark):
    d = tempfile.mkdtemp(prefix="sw-batch-")
    data = os.path.join(d, "data")
    for name, df in zip(("google_ads_campaign_stats", "bing_campaign_stats", "meta_ads_campaign_stats"), X.exports(spark, SF_SMALL)):
        SK.write_csv(df, os.path.join(data, name))
    model_dir = os.path.join(d, "model")
    model = batch.train(spark, data, model_dir, cut_step=28, numTrees=3, maxDepth=4)
    assert model.version == 1
    first = batch.predict(spark, data, model_dir, os.path.join(d, "one"))
    second = batch.predict(spark, data, model_dir, os.path.join(d, "two"), version=1)
    assert first == second and first["confidence"] == "High" and first["version"] == 1
    a, b = (SK.read_predictions(spark, os.path.join(d, x, "predictions")) for x in ("one", "two"))
    assert a.exceptAll(b).count() == 0 and a.count() == first["rows"]
    assert not os.path.exists(os.path.join(d, "one", "model"))
