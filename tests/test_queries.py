"""Every registered query with comparison SQL, on the smallest tables."""

import pytest

import __spark_entry__ as entry
from check import connect, differences
from cohortlens.operators import evaluation, profile, quantiles

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_matches_sql(spark, duck, name):
    got = entry.queries()[name](spark, SF).toPandas()
    assert differences(got, duck.execute(entry.oracle_sql()[name]).fetchdf()) is None


@pytest.mark.parametrize("name", [
    "discrimination", "encounter_sequence", "event_transitions", "fold_leaks", "fsm_transitions", "mann_whitney_family", "spearman_matrix",
    "top_fraction_table"])
def test_matches_sql_with_several_ranges_per_key(spark, duck, monkeypatch, name):
    monkeypatch.setattr("cohortlens.operators.ordered.RANGES", 7)
    got = entry.queries()[name](spark, SF).toPandas()
    assert differences(got, duck.execute(entry.oracle_sql()[name]).fetchdf()) is None


@pytest.mark.parametrize("name", ["exact_quantiles", "numeric_profile", "rate_by_quantile_bin", "reliability_bins", "encoding_spread"])
def test_matches_sql_with_narrow_brackets(spark, duck, monkeypatch, name):
    monkeypatch.setattr("cohortlens.operators.quantiles.ACCURACY", 20)
    monkeypatch.setattr("cohortlens.operators.quantiles.GRID", 4)
    for f in (quantiles.exact_quantiles, profile.numeric_profile, profile.quantile_bin_rates, profile.encoding_spread, evaluation.reliability_bins):
        monkeypatch.setattr(f, "__defaults__", tuple(3 if d == quantiles.LIMIT else d for d in f.__defaults__))
    got = entry.queries()[name](spark, SF).toPandas()
    assert differences(got, duck.execute(entry.oracle_sql()[name]).fetchdf()) is None


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["diag_1_group", "n", "events", "rate", "ci_low", "ci_high"] and df.count() > 0


def test_every_comparison_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
