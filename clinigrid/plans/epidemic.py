"""Case fatality and testing per area and epidemic wave."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date, timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clinigrid.dims import WAVE_ANCHOR, Wave
from clinigrid.functions import (
    count_where, epi_week, epi_year_week, geo_key, percent, ratio, to_day, wave_days,
    wave_label, week_ordinal,
)
from clinigrid.operators.grouping import ordinal_code, share_in_small_groups
from clinigrid.operators.joins import complete, natural_join
from clinigrid.session import materialise

# Final classifications of confirmed cases and of laboratory tests; the day
# after which a recorded date counts as a death.
CONFIRMED = (1, 2, 3)
LABORATORY = (3, 7)
DEATH_AFTER = date(2020, 1, 1)


def cases_in_waves(
    cases: DataFrame, classes: Sequence[int], waves: Sequence[Wave], anchor: date
) -> DataFrame:
    """Cases of the given classes up to the last wave, with area key and wave.

    The end of the last wave is a plain bound on the symptom date, so the scan can skip
    files and row groups behind it.
    """
    end = anchor + timedelta(weeks=max(w.stop for w in waves) - 1)
    return (
        cases.where(F.col("CLASIFICACION_FINAL").isin(*classes))
        .where(F.col("FECHA_SINTOMAS") < F.lit(end))
        .withColumn("CVEGEO", geo_key("ENTIDAD_RES", "MUNICIPIO_RES"))
        .withColumn("ola", wave_label(week_ordinal("FECHA_SINTOMAS", anchor), waves))
    )


def case_counts(
    cases: DataFrame, waves: Sequence[Wave], anchor: date = WAVE_ANCHOR,
    classes: Sequence[int] = CONFIRMED, laboratory: Sequence[int] = LABORATORY,
    death_after: date = DEATH_AFTER,
) -> DataFrame:
    """Confirmed cases, deaths and laboratory tests per area and wave, from one pass over the cases."""
    confirmed = F.col("CLASIFICACION_FINAL").isin(*classes)
    dead = to_day("FECHA_DEF") > F.lit(death_after)
    return (
        cases_in_waves(cases, sorted({*classes, *laboratory}), waves, anchor)
        .groupBy("CVEGEO", "ola")
        .agg(
            count_where(confirmed & dead).alias("defunciones"),
            count_where(confirmed).alias("casos_totales"),
            count_where(F.col("CLASIFICACION_FINAL").isin(*laboratory)).alias("n"),
        )
    )


def fatality_of(counts: DataFrame, waves: Sequence[Wave]) -> DataFrame:
    """``case_fatality`` from ``case_counts``."""
    grid = complete(
        counts.where("casos_totales > 0").select("CVEGEO", "ola", "defunciones", "casos_totales"),
        ["CVEGEO"], {"ola": [w.ola for w in waves]}, {"defunciones": 0, "casos_totales": 0},
    )
    return grid.withColumn("cfr", percent("defunciones", "casos_totales"))


def tests_of(counts: DataFrame, waves: Sequence[Wave]) -> DataFrame:
    """``tests_per_day`` from ``case_counts``."""
    return (
        counts.where("n > 0").select("CVEGEO", "ola", "n")
        .withColumn("dias_ola", wave_days("ola", waves))
        .withColumn("pruebas_dia_promedio", ratio("n", "dias_ola"))
    )


def case_fatality(
    cases: DataFrame, waves: Sequence[Wave], anchor: date = WAVE_ANCHOR,
    classes: Sequence[int] = CONFIRMED, death_after: date = DEATH_AFTER,
) -> DataFrame:
    """Deaths, cases and case fatality (%) for every area with cases, in every wave.

    Counting combines inside the scan stage, so what is shuffled is areas x waves, however
    large one area is. Areas without cases in a wave get 0 and a missing rate.
    """
    dead = to_day("FECHA_DEF") > F.lit(death_after)
    counts = (
        cases_in_waves(cases, classes, waves, anchor)
        .groupBy("CVEGEO", "ola")
        .agg(count_where(dead).alias("defunciones"), F.count(F.lit(1)).alias("casos_totales"))
    )
    return fatality_of(counts, waves)


def outcome_shares(
    cases: DataFrame, waves: Sequence[Wave], anchor: date = WAVE_ANCHOR,
    classes: Sequence[int] = CONFIRMED, death_after: date = DEATH_AFTER,
) -> DataFrame:
    """Both outcomes with their share of all cases, per area and wave (the long form)."""
    dead = F.coalesce(to_day("FECHA_DEF") > F.lit(death_after), F.lit(False))
    counts = (
        cases_in_waves(cases, classes, waves, anchor)
        .groupBy("CVEGEO", "ola", dead.alias("DEFUNCION"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    grid = complete(
        counts, ["CVEGEO"],
        {"ola": [w.ola for w in waves], "DEFUNCION": [False, True]}, {"n": 0},
    )
    return share_in_small_groups(grid, ["CVEGEO", "ola"], "n", "casos_totales", "pc")


def tests_per_day(
    cases: DataFrame, waves: Sequence[Wave], anchor: date = WAVE_ANCHOR,
    classes: Sequence[int] = LABORATORY,
) -> DataFrame:
    """Laboratory tests and their daily mean per area and wave."""
    counts = cases_in_waves(cases, classes, waves, anchor).groupBy("CVEGEO", "ola").agg(
        F.count(F.lit(1)).alias("n")
    )
    return tests_of(counts, waves)


def tests_per_capita(tests: DataFrame, population: DataFrame) -> DataFrame:
    """Daily tests per inhabitant. ``population``: CVEGEO, POBTOT."""
    return natural_join(tests, population.select("CVEGEO", "POBTOT")).select(
        "CVEGEO", "ola", ratio("pruebas_dia_promedio", "POBTOT").alias("pruebas_dia_capita")
    )


def weekly_cases(cases: DataFrame) -> DataFrame:
    """Cases per epidemiological week, with the week's ordinal among the weeks seen.

    The weekly counts are written before they are numbered: the cases are read once.
    """
    weeks = (
        cases.groupBy(epi_year_week("FECHA_SINTOMAS").alias("semana"))
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.min(epi_week("FECHA_SINTOMAS")).alias("semana_epi"),
            F.min("FECHA_SINTOMAS").alias("primer_dia"),
        )
        .withColumn("annum", F.year("primer_dia"))
    )
    return ordinal_code(materialise(weeks, "weeks"), "semana", "codigo")
