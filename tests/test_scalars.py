from datetime import datetime

import pytest
from pyspark.sql import functions as F

from fluxmill.functions import scalars as fs
from fluxmill.functions import vertical as fv


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


@pytest.mark.parametrize(("p", "want"), [(1.0, 15.6605), (10.0, 12.4147)])
def test_superobs_error(spark, p, want):
    assert one(spark, fs.superobs_error(F.lit(15.0), F.lit(p)))[0] == pytest.approx(want, abs=1e-4)


def test_observation_variance(spark):
    assert one(spark, fs.observation_variance(F.lit(15.0), F.lit(10.0)))[0] == pytest.approx(141.399, abs=1e-3)
    assert one(spark, fs.observation_variance(F.lit(0.0), F.lit(3.0)))[0] == 1.0


@pytest.mark.parametrize(("t", "want"), [("2024-01-01 00:30:00", "20240101_00"), ("2024-01-01 01:30:00", "20240101_02"), ("2024-01-01 23:40:00", "20240101_23")])
def test_hour_key_rounds_half_to_even_and_stays_below_the_threshold(spark, t, want):
    assert one(spark, fs.hour_key(F.lit(datetime.fromisoformat(t)), "20240102_00"))[0] == want


def test_vertical_weights_with_a_layer_across_the_surface(spark):
    sat, model, x = (F.array(*map(F.lit, v)) for v in ((1000.0, 800.0), (950.0, 900.0, 800.0), (1.0, 2.0)))
    a, b = one(spark, fv.weighted_levels(fv.overlap_weights(sat, model), x)[0], fv.remap_extended(sat, model, x)[0])
    assert a == pytest.approx(5 / 3)
    assert b == pytest.approx(1.5)


def test_layer_below_the_surface_takes_the_lowest_model_layer(spark):
    sat, model = F.array(F.lit(1000.0), F.lit(960.0), F.lit(800.0)), F.array(F.lit(950.0), F.lit(900.0), F.lit(800.0))
    rows = one(spark, fv.overlap_weights(sat, model))[0]
    assert rows[0] == [1.0, 0.0]
    assert sum(rows[1]) == pytest.approx(1.0)


def test_perturbation_bounds(spark):
    got = one(spark, *(fs.perturbation_factor(F.lit(a), F.lit(b)) for a, b in ((1.0, 0.0), (0.0, 0.0), (1.0, 1e-9), (3.0, 2.0))))
    assert list(got) == [1.5e7, 1.0, 1.5e7, 1.5]


def test_nearest_index_ties_and_tolerance(spark):
    got = one(spark, *(fs.nearest_index(F.lit(x), 0.0, 1.0, 4, 0.6) for x in (0.5, 1.51, 3.7, -0.2)))
    assert list(got) == [0, 2, None, 0]


def test_element_classes(spark):
    got = one(spark, *(fs.is_bc_element(F.lit(e), 10, True, True, True) for e in (5, 6, 9, 10)), fs.is_oh_element(F.lit(10), 10, True, True))
    assert list(got) == [False, True, True, False, True]
    assert one(spark, fs.element_run(F.lit(6), 8, 5), fs.element_run(F.lit(9), 8, 5))[:] == (2, 3)
