"""The plan report's parser on a real plan."""

from tickflow import catalog
from tickflow.plans.inspect import plan_text
from tickflow.plans.report import features
from conftest import SF_SMALL


def test_features_of_candles_and_latest(spark):
    f = features(plan_text(catalog.QUERIES["candles_1h"](spark, SF_SMALL)))
    assert f["nodes"]["HashAggregate"] == 2 and f["nodes"]["Exchange"] == 1
    assert f["nodes"]["SortAggregate"] == 0 and f["nodes"]["Generate"] == 1
    f = features(plan_text(catalog.QUERIES["latest_trades"](spark, SF_SMALL)))
    # the days' running count and two ranks, with a plan that doesn't hang on Spark's cut at small n
    assert f["nodes"]["WindowGroupLimit"] == 0 and f["nodes"]["Window"] >= 3
