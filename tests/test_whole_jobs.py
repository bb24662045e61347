"""Queries run with the parameters of the reference, not smaller ones."""

import os

import pytest
from pyspark.sql import functions as F

from tidemark.operators import aggs, ridge
from tidemark.plans import registry

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data here")


def test_ten_hazards_agree_with_the_first_three(spark):
    ten = registry.QUERIES["l02_hazards_10"](spark, SF)
    assert ten.columns == ["event_id", *[f"haz_{k}" for k in range(10)]]
    three = registry.QUERIES["l02_hazards"](spark, SF).toDF("event_id", "first", "third")
    both = ten.join(three, "event_id")
    assert both.count() == three.count()
    assert both.where("haz_0 != first or haz_2 != third").count() == 0


def test_ten_checkpoints(spark):
    out = registry.QUERIES["l04_l08_trajectory_10"](spark, SF)
    assert out.count() and out.where("final != traj_10").count() == 0


def test_bootstrap_and_ridge_parameters(spark, monkeypatch):
    seen = {}
    monkeypatch.setattr(aggs, "cluster_bootstrap", lambda df, c, v, draws: seen.update(draws=draws))
    monkeypatch.setattr(ridge, "rolling_ridge", lambda *a, every=5, **k: seen.update(every=every))
    registry.QUERIES["a21_bootstrap"](spark, SF)
    registry.QUERIES["a26_rolling_ridge"](spark, SF)
    assert seen == {"draws": 10_000, "every": 5}
