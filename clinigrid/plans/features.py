"""Model tables and the four transmission scenarios."""

from __future__ import annotations

from pyspark.sql import DataFrame

from clinigrid.functions import apply_across, columns_matching, drop_all_missing, missing_to_zero
from clinigrid.operators.joins import natural_join
from clinigrid.session import materialise


def feature_table_v1(
    fatality: DataFrame, capita: DataFrame, shares: DataFrame, tests: DataFrame, coverage: DataFrame
) -> DataFrame:
    """Fatality per area and wave with resources per affiliate, age, tests and coverage."""
    table = fatality
    for part in (capita, shares, tests, coverage):
        table = natural_join(table, part)
    return table


def feature_table_v2(
    fatality: DataFrame, shares: DataFrame, contributions: DataFrame, tests: DataFrame
) -> DataFrame:
    """Fatality per area and wave with age, own and neighbouring resources, and tests.

    Columns without any value leave; a missing own share counts as 0. Which columns those
    are depends on the data, so the joined table is written before it is looked at.
    """
    table = fatality
    for part in (shares, contributions, tests):
        table = natural_join(table, part)
    table = drop_all_missing(materialise(table, "features"))
    return apply_across(table, columns_matching(table, contains="contrib"), missing_to_zero)


def in_scenarios(table: DataFrame, scenarios: DataFrame) -> DataFrame:
    """Rows of the waves that belong to a scenario, with its name."""
    return natural_join(table, scenarios, "inner")
