from datetime import date

import pytest
from pyspark.sql import functions as F

from clinigrid import dims
from clinigrid import functions as fn


def one(spark, expr, **values):
    ddl = ", ".join(f"{k} {t}" for k, (t, _) in values.items()) or "_ int"
    row = tuple(v for _, v in values.values()) or (0,)
    return spark.createDataFrame([row], ddl).select(expr.alias("r")).first()["r"]


def test_sums_differ_in_missing_values(spark, rows):
    df = spark.createDataFrame(
        [("a", 1.0), ("a", 2.0), ("b", 1.0), ("b", None), ("c", None)], "k string, v double"
    )
    got = df.groupBy("k").agg(fn.sum_strict("v"), fn.sum_or_zero("v"), fn.max_strict("v"))
    assert rows(got) == [("a", 3.0, 3.0, 2.0), ("b", None, 1.0, None), ("c", None, 0.0, None)]


@pytest.mark.parametrize("text, width, want", [
    ("7", 2, "07"), ("12345", 3, "12345"), ("", 2, "00"), (None, 2, None),
])
def test_pad_never_cuts(spark, text, width, want):
    assert one(spark, fn.pad_left("s", width), s=("string", text)) == want


def test_geo_key_joins_both_dialects(spark):
    assert one(spark, fn.geo_key("s", "m"), s=("string", "1"), m=("string", "1")) == "01001"
    assert one(spark, fn.geo_key("c"), c=("int", 1001)) == "01001"
    assert one(spark, fn.geo_key("c"), c=("string", "31001")) == "31001"
    assert one(spark, fn.geo_key("s", "m"), s=("string", None), m=("string", "1")) is None


@pytest.mark.parametrize("text, want", [("12", 12.0), ("*", None), (" 3 ", 3.0), (None, None)])
def test_to_number(spark, text, want):
    assert one(spark, fn.to_number("s"), s=("string", text)) == want


def test_to_day(spark):
    assert one(spark, fn.to_day("s"), s=("string", "2020-03-01")) == date(2020, 3, 1)
    assert one(spark, fn.to_day("s"), s=("string", "9999-99-99")) is None


def test_rates_are_missing_over_zero(spark):
    assert one(spark, fn.ratio("a", "b"), a=("int", 1), b=("int", 0)) is None
    assert one(spark, fn.percent("a", "b"), a=("int", 1), b=("int", 8)) == 12.5
    assert one(spark, fn.per(100_000, "a", "b"), a=("int", 1), b=("int", 8)) == 12500.0


@pytest.mark.parametrize("value, want", [(None, 0.0), (float("nan"), 0.0), (2.5, 2.5)])
def test_missing_to_zero(spark, value, want):
    assert one(spark, fn.missing_to_zero("v"), v=("double", value)) == want


@pytest.mark.parametrize("day, week, label", [
    (date(2020, 12, 31), 53, "2020-53"), (date(2021, 1, 1), 53, "2020-53"),
    (date(2021, 1, 2), 53, "2020-53"), (date(2021, 1, 3), 1, "2021-01"),
    (date(2022, 1, 1), 52, "2021-52"), (date(2022, 1, 2), 1, "2022-01"),
])
def test_epidemiological_weeks(spark, day, week, label):
    assert one(spark, fn.epi_week("d"), d=("date", day)) == week
    assert one(spark, fn.epi_year_week("d"), d=("date", day)) == label


@pytest.mark.parametrize("label, ordinal", [
    ("2020-32", 24), ("2020-43", 35), ("2021-12", 57), ("2021-23", 68), ("2021-41", 86),
    ("2021-49", 94), ("2022-14", 111),
])
def test_wave_boundaries_match_their_weeks(spark, label, ordinal):
    """Boundary weeks and their ordinals, as recorded with the wave definitions."""
    days = spark.sql("SELECT explode(sequence(DATE'2020-02-23', DATE'2022-12-31')) AS d").select(
        fn.epi_year_week("d").alias("label"), fn.week_ordinal("d").alias("o")
    )
    assert [r["o"] for r in days.where(F.col("label") == label).distinct().collect()] == [ordinal]


def test_wave_table(spark):
    table = {r["ola"]: r for r in dims.wave_table(spark, dims.default_waves()).collect()}
    assert [table[o]["dias_ola"] for o in dims.WAVE_LABELS] == [105, 77, 154, 77, 126, 56, 119]
    assert table["01_ola_1"]["first_day"] == date(2020, 2, 23)
    assert table["01_ola_1"]["last_day"] == date(2020, 8, 1)
    assert table["05_ola_3"]["first_day"] == date(2021, 6, 6)
    assert table["07_ola_4"]["last_day"] == date(2022, 4, 2)


@pytest.mark.parametrize("ordinal, want", [
    (-3, "01_ola_1"), (23, "01_ola_1"), (24, "02_interola_1"), (110, "07_ola_4"), (111, None),
])
def test_wave_label(spark, ordinal, want):
    got = one(spark, fn.wave_label("o", dims.default_waves()), o=("int", ordinal))
    assert got == want


def test_dictionaries(spark, rows):
    table = dims.institution_dictionary(spark)
    assert table.count() == 17
    kinds = rows(table.groupBy("variable").count())
    assert kinds == [
        ("PAFIL_IPRIV", 1), ("PAFIL_OTRAI", 9), ("PAFIL_PDOM", 3), ("PDER_IMSS", 1),
        ("PDER_IMSSB", 1), ("PDER_ISTE", 1), ("PDER_SEGP", 1),
    ]
    assert dims.variable_dictionary(spark).count() == 11
    assert dims.scenario_table(spark).count() == 5


def test_matching_folds_accents(spark):
    assert one(spark, fn.matches("s", "personal|médico"), s=("string", "MÉDICOS GENERALES"))
    assert not one(spark, fn.matches("s", "personal|médico"), s=("string", "CAMAS"))


def test_not_in_keeps_missing(spark, rows):
    df = spark.createDataFrame([("a",), ("b",), (None,)], "k string")
    assert rows(df.where(fn.not_in("k", ["a"]))) == [("b",), (None,)]


@pytest.mark.parametrize("value, want", [
    (10001, "mas_diez"), (10000, "mas_cinco"), (3000, "menos_tres"), (None, "menos_tres"),
])
def test_bucket_label(spark, value, want):
    expr = fn.bucket_label("v", dims.BED_SIZE_CLASSES, dims.BED_SIZE_DEFAULT)
    assert one(spark, expr, v=("int", value)) == want


def test_labels(spark):
    kind = fn.first_match_label("s", dims.RESOURCE_TYPES, dims.RESOURCE_TYPE_DEFAULT)
    assert one(spark, kind, s=("string", "Camas del personal")) == "camas"
    assert one(spark, kind, s=("string", "Otros")) == "otro"
    assert one(spark, fn.capitalise("s"), s=("string", "camas UCI")) == "Camas UCI"
    assert one(spark, fn.label_lookup("s", {"a": "A"}), s=("string", "x")) is None


def test_column_helpers(spark):
    df = spark.createDataFrame([(1, None, "x", 2.0)], "POB int, empty string, pName string, n double")
    assert fn.front(df, "n").columns == ["n", "POB", "empty", "pName"]
    assert fn.columns_matching(df, prefix="p") == ["POB", "pName"]
    assert fn.columns_matching(df, contains="NAM") == ["pName"]
    assert fn.numeric_columns(df, exclude=["n"]) == ["POB"]
    assert fn.drop_all_missing(df).columns == ["POB", "pName", "n"]


def test_clean_names(spark):
    df = spark.createDataFrame([(1, 2, 3, 4)], "`Establishment Type` int, `Año` int, `CLUES ID` int, `clues-id` int")
    assert fn.clean_names(df).columns == ["establishment_type", "ano", "clues_id", "clues_id_2"]
    assert [fn.clean_name(n) for n in ("2021 total", "% beds", "# of units", "")] == [
        "x2021_total", "percent_beds", "number_of_units", "x"]


def test_week_of_a_missing_day_is_missing(spark):
    df = spark.createDataFrame([("2021-01-05",), (None,)], "d string").selectExpr("cast(d AS date) AS d")
    assert [r[0] for r in df.select(fn.epi_year_week("d")).collect()] == ["2021-01", None]


def test_literal_survives_quotes(spark):
    for value in ("it's", "back\\slash", "ñ", 3, 2.5, None, True):
        assert spark.range(1).selectExpr(f"{fn.literal(value)} AS v").first()["v"] == value
