"""Beds, clinics, staff and affiliates per area and institution."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clinigrid import dims
from clinigrid.functions import (
    apply_across, bucket_label, capitalise, columns_matching, first_match_label, front, geo_key,
    label_lookup, matches, missing_to_zero, not_in, numeric_columns, per, percent, ratio,
    sum_or_zero, sum_strict, to_number,
)
from clinigrid.operators.grouping import binscatter, quantiles, sizes
from clinigrid.operators.joins import natural_join
from clinigrid.operators.reshape import to_long, to_wide

AREA = ("municipality_id", "municipality")
MEASURES = ("camas", "clinicas", "personal")


def known_facilities(facilities: DataFrame) -> DataFrame:
    return facilities.where(F.col("municipality") != dims.MUNICIPALITY_UNKNOWN)


def facility_staff(
    resources: DataFrame, year: int = 2021, pattern: str = dims.STAFF_PATTERN
) -> DataFrame:
    """Staff per facility in one year."""
    return (
        resources.where((F.col("year") == year) & matches("resources_categories", pattern))
        .groupBy("clues").agg(sum_strict("total").alias("personal"))
    )


def resources_by_institution(facilities: DataFrame, staff: DataFrame) -> DataFrame:
    """Beds, clinics and staff per area and institution.

    Staff comes in reduced to one row per facility, so the join cannot fan out.
    """
    return (
        known_facilities(facilities).join(staff, "clues", "left")
        .groupBy(*AREA, "institution")
        .agg(
            sum_or_zero("beds").alias("camas"),
            sum_or_zero("clinics").alias("clinicas"),
            sum_or_zero("personal").alias("personal"),
        )
    )


def harmonise_institutions(by_institution: DataFrame, dictionary: DataFrame) -> DataFrame:
    """Provider codes to census variables: "other" leaves, providers of one variable add up."""
    named = by_institution.join(dictionary, "institution").drop(
        "nombre_institucion", "institution"
    )
    keys = [c for c in named.columns if c not in MEASURES]
    return (
        named.where(F.col("variable") != dims.OTHER_VARIABLE)
        .groupBy(*keys).agg(*[sum_strict(m).alias(m) for m in MEASURES])
    )


def affiliation_long(census: DataFrame, dictionary: DataFrame) -> DataFrame:
    """Census affiliation counts, one row per area and variable."""
    wide = front(
        census.where(F.col("NOM_LOC") == dims.MUNICIPALITY_TOTAL)
        .withColumn("state_id", to_number("ENTIDAD").cast("int").cast("string"))
        .withColumn("municipality_id", F.concat("state_id", "MUN"))
        .withColumnsRenamed({"NOM_ENT": "state", "NOM_MUN": "municipality"})
        .drop("LOC", "NOM_LOC", "ENTIDAD", "MUN"),
        "state_id", "state", "municipality_id", "municipality",
    )
    long = to_long(
        wide, wide.columns[:4], columns_matching(wide, prefix="P"), "variable", "valor", "double"
    )
    named = natural_join(long, dictionary, "inner")
    return named.withColumn("state", short_state_name("state_id", "state"))


def short_state_name(state_id: Column | str, state: Column | str) -> Column:
    """The name in use, for states whose official name is longer."""
    full = F.col(state) if isinstance(state, str) else state
    return F.coalesce(label_lookup(state_id, dims.SHORT_STATE_NAMES), full)


def affiliates_by_variable(population: DataFrame) -> DataFrame:
    """Affiliates per area and institution variable, "other" left out."""
    state_scheme = F.col("variable") == dims.STATE_ISSSTE_VARIABLE
    other_name = dims.VARIABLE_NAMES[dims.OTHER_VARIABLE]
    rows = (
        population.where(not_in("variable", dims.AFFILIATION_TOTALS))
        # The name is set first: its condition reads the variable that changes next.
        .withColumn("nombre", F.when(state_scheme, F.lit(other_name)).otherwise(F.col("nombre")))
        .withColumn(
            "variable",
            F.when(state_scheme, F.lit(dims.OTHER_VARIABLE)).otherwise(F.col("variable")),
        )
    )
    keys = [c for c in rows.columns if c != "valor"]
    return (
        rows.where(F.col("variable") != dims.OTHER_VARIABLE)
        .groupBy(*keys).agg(sum_strict("valor").alias("poblacion"))
    )


def institution_names(dictionary: DataFrame) -> DataFrame:
    """Full institution name per variable, merged providers under one name."""
    merged = F.col("variable") == dims.MERGED_VARIABLE
    return (
        dictionary.where(F.col("variable") != dims.OTHER_VARIABLE)
        .withColumn(
            "nombre_institucion",
            F.when(merged, F.lit(dims.MERGED_NAME)).otherwise(F.col("nombre_institucion")),
        )
        .select("variable", "nombre_institucion").distinct()
    )


def resources_population(
    population: DataFrame, harmonised: DataFrame, dictionary: DataFrame
) -> DataFrame:
    """Affiliates with the beds, clinics and staff of their institution; missing is 0."""
    joined = (
        affiliates_by_variable(population)
        .join(harmonised, ["municipality", "municipality_id", "variable"], "left")
        .join(institution_names(dictionary), "variable", "left")
        .select(
            "state_id", "state", "municipality_id", "municipality",
            F.col("variable").alias("institucion_inegi"), F.col("nombre").alias("institucion"),
            "nombre_institucion", "poblacion", *MEASURES,
        )
    )
    return apply_across(joined, numeric_columns(joined), missing_to_zero)


def unmatched_resources(population: DataFrame, harmonised: DataFrame) -> DataFrame:
    """Resource rows whose area name, id or variable no population row carries."""
    return harmonised.join(
        affiliates_by_variable(population), ["municipality", "municipality_id", "variable"],
        "left_anti",
    )


def with_area_key(df: DataFrame) -> DataFrame:
    return df.withColumn("CVEGEO", geo_key("municipality_id"))


def census_population(demography: DataFrame) -> DataFrame:
    """Inhabitants per area: CVEGEO, POBTOT."""
    return demography.select(
        geo_key("ENTIDAD", "MUN").alias("CVEGEO"), to_number("POBTOT").alias("POBTOT")
    )


def demographic_shares(demography: DataFrame) -> DataFrame:
    """Women and age bands in percent of all inhabitants."""
    bands = ["POBFEM", "POB0_14", "POB15_64", "POB65_MAS"]
    rows = demography.select(
        geo_key("ENTIDAD", "MUN").alias("CVEGEO"),
        *[to_number(c).alias(c) for c in ["POBTOT", *bands]],
    )
    return apply_across(rows, bands, lambda c: percent(c, "POBTOT")).drop("POBTOT")


def per_affiliate_wide(table: DataFrame, variables: Sequence[str] = dims.KEPT_VARIABLES) -> DataFrame:
    """Beds and clinics per affiliate, one column per institution variable."""
    rows = with_area_key(table).select(
        "CVEGEO", "institucion_inegi", ratio("camas", "poblacion").alias("camas_capita"),
        ratio("clinicas", "poblacion").alias("clinicas_capita"),
    )
    return to_wide(
        rows, ["CVEGEO"], "institucion_inegi", variables, ["camas_capita", "clinicas_capita"]
    )


def coverage_wide(
    table: DataFrame, population: DataFrame, variables: Sequence[str] = dims.KEPT_VARIABLES
) -> DataFrame:
    """Affiliates in percent of inhabitants, one column per institution variable."""
    rows = natural_join(
        with_area_key(table).select("CVEGEO", "institucion_inegi", "poblacion"), population
    ).withColumn("cobertura", percent("poblacion", "POBTOT"))
    return to_wide(
        rows, ["CVEGEO"], "institucion_inegi", variables, ["cobertura"], prefix="cobertura_pc_"
    )


def beds_per_100k(facilities: DataFrame, population: DataFrame) -> DataFrame:
    """Beds per 100,000 inhabitants; areas without a bed count or inhabitants leave."""
    beds = (
        facilities.groupBy(geo_key("municipality_id").alias("CVEGEO"))
        .agg(sum_or_zero("beds").alias("beds"))
    )
    return (
        natural_join(population, beds)
        .withColumn("beds_per_100khab", per(100_000, "beds", "POBTOT"))
        .dropna("any")
    )


def map_layer(areas: DataFrame, values: DataFrame) -> DataFrame:
    """Values next to every area of a map layer; areas without a value stay."""
    return natural_join(areas, values)


def units_by_state(facilities: DataFrame, min_units: int = 100) -> DataFrame:
    """Facilities per state and institution, for institutions with more than ``min_units``.

    Facilities are counted once; the institution totals come from those counts, so the
    raw rows of a large institution are never joined.
    """
    cells = facilities.groupBy("state", "institution").agg(F.count(F.lit(1)).alias("n"))
    large = cells.groupBy("institution").agg(F.sum("n").alias("_all")).where(
        F.col("_all") > min_units
    )
    return cells.join(large, "institution", "left_semi")


def state_beds_by_size(
    facilities: DataFrame, bounds=dims.BED_SIZE_CLASSES, default: str = dims.BED_SIZE_DEFAULT
) -> DataFrame:
    """Beds per state and institution beside the state's total and its size class."""
    cells = (
        facilities.where(F.col("beds") > 0)
        .groupBy("state", "institution").agg(F.sum("beds").alias("beds"))
    )
    states = cells.groupBy("state").agg(F.sum("beds").alias("total_beds")).withColumn(
        "category", bucket_label("total_beds", bounds, default)
    )
    return cells.join(states, "state").withColumns({
        "title": label_lookup("category", dims.BED_SIZE_TITLES),
        "facet": F.concat_ws("\n", "state", F.col("total_beds").cast("string")),
    })


def state_totals(facilities: DataFrame, demography: DataFrame) -> DataFrame:
    """Beds and clinics per state and institution, with the state's inhabitants.

    The census names states in full, facilities by their short names.
    """
    code = to_number("ENTIDAD").cast("int").cast("string")
    named = demography.withColumn("state", short_state_name(code, F.col("NOM_ENT")))
    people = named.groupBy("state").agg(
        sum_strict(to_number("POBTOT")).alias("pobtotal")
    )
    return (
        facilities.groupBy("state", "institution")
        .agg(sum_strict("beds").alias("camas"), sum_strict("clinics").alias("clinicas"))
        .join(people, "state", "left")
    )


def resource_trend(
    resources: DataFrame, types=dims.RESOURCE_TYPES, bounds=dims.RESOURCE_SIZE_CLASSES,
) -> DataFrame:
    """Resources per state, category and year, with resource type and the state's size class."""
    cells = (
        resources.groupBy("state", "resources_categories", "year")
        .agg(sum_strict("total").alias("total"))
        .withColumn(
            "resource_type",
            first_match_label("resources_categories", types, dims.RESOURCE_TYPE_DEFAULT),
        )
    )
    largest = (
        cells.groupBy("state", "resource_type").agg(F.max("total").alias("_max"))
        .withColumn("category", bucket_label("_max", bounds, dims.RESOURCE_SIZE_DEFAULT))
        .drop("_max")
    )
    return cells.join(largest, ["state", "resource_type"])


def resource_type_crosstab(trend: DataFrame) -> DataFrame:
    """States per size class and resource type."""
    return (
        trend.select("state", "resource_type", "category").distinct()
        .groupBy("category", "resource_type").agg(F.count(F.lit(1)).alias("n"))
    )


def resource_type_labels(resources: DataFrame, types=dims.RESOURCE_TYPES) -> DataFrame:
    """Distinct categories with their type and its capitalised display name."""
    kind = first_match_label("resources_categories", types, dims.RESOURCE_TYPE_DEFAULT)
    return (
        resources.select("resources_categories").distinct()
        .withColumn("resource_type", kind)
        .withColumn("label", capitalise("resource_type"))
    )


def area_facilities(population: DataFrame, facilities: DataFrame) -> DataFrame:
    """Inhabitants, beds and clinics per area; areas without facilities get 0."""
    people = population.where(F.col("variable") == "POBTOT").select(
        "municipality_id", F.col("valor").alias("poblacion")
    )
    totals = known_facilities(facilities).groupBy(*AREA).agg(
        sum_strict("clinics").alias("clinics"), sum_strict("beds").alias("beds")
    )
    joined = people.join(totals, "municipality_id", "left")
    return apply_across(joined, numeric_columns(joined), missing_to_zero)


def population_quantiles(areas: DataFrame, value: str = "poblacion") -> DataFrame:
    return quantiles(areas, value, (0.0, 0.25, 0.5, 0.75, 1.0))


def bins_of_resources(
    table: DataFrame, people: str, resource: str, nbins: int = 20, by: str | None = None,
    x_range: tuple[float, float] | None = None,
) -> DataFrame:
    """Binned scatter of a resource over people; by institution only where there is some."""
    rows = table.where(F.col(resource) > 0) if by else table
    return binscatter(rows, people, resource, nbins, by, x_range)


def institution_sizes(facilities: DataFrame) -> DataFrame:
    return sizes(facilities, "institution")
