"""Profiles of kept intersections read cells that were computed once."""

from stridewise.plans import registry


def test_no_profile_computes_the_cells_again(spark):
    found = registry.queries()["profiles_of_kept_intersections"](spark, "/root/testdata/sf0.001")
    assert "MapInArrow" not in found._jdf.queryExecution().executedPlan().toString()
    assert found.count() > 0
