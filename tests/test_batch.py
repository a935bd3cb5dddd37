"""End-to-end batch job over CSV exports written from the driver tables:
files are produced fresh (overwrite), re-read with blanks kept (S10) and pass
the validator."""
import os
import tempfile

from conftest import SF_SMALL
from spendwise import schema as S
from spendwise.operators import quality as QA
from spendwise.plans import batch
from spendwise.sources import fixtures as X
from spendwise.sources import sinks as SK


def test_batch_end_to_end(spark):
    d = tempfile.mkdtemp(prefix="sw-batch-")
    data = os.path.join(d, "data")
    for name, df in zip(("google_ads_campaign_stats", "bing_campaign_stats", "meta_ads_campaign_stats"),
                        X.exports(spark, SF_SMALL)):
        SK.write_csv(df, os.path.join(data, name))
    out = os.path.join(d, "out")
    info = batch.run(spark, data, out, cut_step=28, numTrees=5, maxDepth=5)
    pred = SK.read_predictions(spark, os.path.join(out, "predictions"))
    copy = os.path.join(d, "copy")
    for _ in range(2):  # a rerun overwrites, never appends
        SK.write_csv(pred, copy, single_file=True)
    assert SK.read_predictions(spark, copy).count() == info["rows"]
    assert pred.count() == info["rows"]
    assert pred.columns == S.OUTPUT_COLUMNS
    assert pred.where("level = 'blended' AND channel = ''").count() == 3  # blanks survive the round trip
    req = pred.where("level = 'channel'").select("channel").distinct()
    assert all(r.ok for r in QA.validate_output(pred, req).collect())
    assert os.path.isdir(os.path.join(out, "model"))
