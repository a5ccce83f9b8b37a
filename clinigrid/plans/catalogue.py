"""Every registered query, over the whole benchmark tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clinigrid import dims
from clinigrid.functions import (
    columns_matching, drop_all_missing, front, geo_key, not_in, sum_or_zero, to_number,
)
from clinigrid.operators import forest, forest_growth, graph, linear_cv, stats
from clinigrid.operators.grouping import cube_slice, quantiles, top_with_ties, with_group_stats
from clinigrid.operators.joins import interval_join, natural_join
from clinigrid.operators.reshape import stack_named
from clinigrid.plans import bindings as b
from clinigrid.plans import communities, epidemic, features, neighbourhood, resources
from clinigrid.session import literal_table, materialise, new_path
from clinigrid.sources import json_splits, landing, results
from clinigrid.sources.files import (
    parse_json_records, read_delimited, read_delimited_folder, read_polygon_features, read_table, write_delimited,
    write_sliced,
)

WAVES = dims.default_waves()
Query = Callable[[SparkSession, str], DataFrame]


def rounded(df: DataFrame, digits: int = 4) -> DataFrame:
    """Double columns rounded, so that results compare across engines."""
    return df.selectExpr(*[
        f"round(`{f.name}`, {digits}) AS `{f.name}`"
        if isinstance(f.dataType, T.DoubleType) else f"`{f.name}`"
        for f in df.schema
    ])


# --- epidemic -----------------------------------------------------------------------

def fatality(spark, sf):
    return epidemic.case_fatality(b.cases(spark, sf), WAVES, b.ANCHOR, death_after=b.DEATH_AFTER)


def cfr_by_wave(spark, sf):
    return rounded(fatality(spark, sf))


def outcome_shares(spark, sf):
    shares = epidemic.outcome_shares(
        b.cases(spark, sf), WAVES, b.ANCHOR, death_after=b.DEATH_AFTER
    )
    return rounded(shares)


def tests(spark, sf):
    return epidemic.tests_per_day(b.cases(spark, sf), WAVES, b.ANCHOR, b.LABORATORY)


def tests_per_day_by_wave(spark, sf):
    return rounded(tests(spark, sf))


def population(spark, sf):
    return resources.census_population(b.demography(spark, sf))


def capita_tests(spark, sf):
    return epidemic.tests_per_capita(tests(spark, sf), population(spark, sf))


def tests_per_capita(spark, sf):
    return rounded(capita_tests(spark, sf), 6)


def epi_week_labels(spark, sf):
    days = b.table(spark, sf, "orders").select(F.col("o_orderdate").cast("date").alias("FECHA_SINTOMAS"))
    return epidemic.weekly_cases(days)


def scenario_waves(spark, sf):
    rows = features.in_scenarios(fatality(spark, sf), dims.scenario_table(spark))
    return rows.groupBy("scenario", "ola").agg(
        F.sum("casos_totales").alias("casos"), F.sum("defunciones").alias("defunciones"),
        F.count(F.lit(1)).alias("areas"),
    )


# --- resources ----------------------------------------------------------------------

def facility_staff(spark, sf):
    recent = b.resources(spark, sf, years=(b.LATEST_YEAR,), with_area=False)
    return resources.facility_staff(recent, b.LATEST_YEAR, b.STAFF_PATTERN)


def resources_by_area_institution(spark, sf):
    return resources.resources_by_institution(b.facilities(spark, sf), facility_staff(spark, sf))


def institution_harmonised(spark, sf):
    return resources.harmonise_institutions(
        resources_by_area_institution(spark, sf), dims.institution_dictionary(spark)
    )


def affiliation_long(spark, sf):
    return resources.affiliation_long(b.census(spark, sf), dims.variable_dictionary(spark))


def resources_population(spark, sf):
    return resources.resources_population(
        affiliation_long(spark, sf), institution_harmonised(spark, sf),
        dims.institution_dictionary(spark),
    )


def demographic_shares(spark, sf):
    return rounded(resources.demographic_shares(b.demography(spark, sf)))


def capita_wide(spark, sf):
    return rounded(resources.per_affiliate_wide(resources_population(spark, sf)), 6)


def coverage_wide(spark, sf):
    return rounded(resources.coverage_wide(resources_population(spark, sf), population(spark, sf)))


def beds_per_100k(spark, sf):
    beds = resources.beds_per_100k(b.facilities(spark, sf), population(spark, sf))
    layer = b.areas(spark, sf).select("CVEGEO", "municipality")
    return rounded(resources.map_layer(layer, beds))


def units_by_state_institution(spark, sf):
    return resources.units_by_state(b.facilities(spark, sf), min_units=5)


def institution_sizes(spark, sf):
    return resources.institution_sizes(b.facilities(spark, sf))


def state_bed_category(spark, sf):
    bounds = ((1000, "mas_diez"), (900, "mas_cinco"), (800, "mas_tres"))
    return resources.state_beds_by_size(b.facilities(spark, sf), bounds)


def state_totals_population(spark, sf):
    short = resources.short_state_name(F.col("state_id").cast("string"), "state")
    return resources.state_totals(b.facilities(spark, sf).withColumn("state", short), b.demography(spark, sf))


def _trend(spark, sf):
    bounds = ((9500, "mas_cinco"), (9000, "mas_tres"), (8500, "mas_mil"))
    return resources.resource_trend(b.resources(spark, sf), b.RESOURCE_TYPES, bounds)


def resource_trend(spark, sf):
    return _trend(spark, sf)


def resource_type_crosstab(spark, sf):
    return resources.resource_type_crosstab(_trend(spark, sf))


def capitalised_labels(spark, sf):
    parts = b.table(spark, sf, "part").select(F.col("p_type").alias("resources_categories"))
    return resources.resource_type_labels(parts, b.RESOURCE_TYPES)


def population_quantiles(spark, sf):
    areas = resources.area_facilities(affiliation_long(spark, sf), b.facilities(spark, sf))
    return rounded(resources.population_quantiles(areas))


def _catchments(spark, sf):
    return materialise(b.catchments(spark, sf), "catchments")


def binscatter_beds(spark, sf):
    return rounded(resources.bins_of_resources(_catchments(spark, sf), "poblacion", "beds", 5))


def binscatter_by_institution(spark, sf):
    return rounded(
        resources.bins_of_resources(_catchments(spark, sf), "poblacion", "beds", 3, by="institution")
    )


def binscatter_clinics_areas(spark, sf):
    """Clinics per area in bins of areas by their people."""
    supply = b.facilities(spark, sf).groupBy("CVEGEO").agg(sum_or_zero("clinics").alias("clinics"))
    areas = natural_join(population(spark, sf).select("CVEGEO", F.col("POBTOT").alias("poblacion")), supply, "inner")
    return rounded(resources.bins_of_resources(materialise(areas, "areas"), "poblacion", "clinics", 4))


def nonempty_batches(spark, sf):
    """Orders by year batch; a batch without rows is not carried on."""
    orders = materialise(b.table(spark, sf, "orders").select(F.year("o_orderdate").alias("year"), "o_orderkey"), "orders")
    batches = {str(y): orders.where(F.col("year") == y) for y in range(1993, 2004)}
    found = {name: batch for name, batch in batches.items() if not batch.isEmpty()}
    return stack_named(found, "batch").groupBy("batch").agg(F.count(F.lit(1)).alias("n"), F.max("o_orderkey").alias("last"))


# --- neighbourhood ------------------------------------------------------------------

def contiguity_queen(spark, sf):
    return graph.contiguity(b.customer_squares(spark, sf))


def contiguity_rook(spark, sf):
    return graph.contiguity(b.customer_squares(spark, sf), rule="rook")


def simple_graph(spark, sf):
    return graph.simple_graph(b.supply_edges(spark, sf))


def _nation_edges(spark, sf):
    return materialise(graph.contiguity(b.nation_squares(spark, sf)), "edges")


def neighbourhood_totals(spark, sf):
    return neighbourhood.neighbourhood_totals(
        _nation_edges(spark, sf), resources_population(spark, sf), population(spark, sf)
    )


def _contributions(spark, sf):
    table = materialise(resources_population(spark, sf), "resources")
    return neighbourhood.own_and_neighbours_wide(_nation_edges(spark, sf), table)


def own_vs_neighbour(spark, sf):
    return rounded(_contributions(spark, sf))


# --- communities --------------------------------------------------------------------

def _vector_edges(spark, sf):
    return materialise(graph.contiguity(b.vector_squares(spark, sf)), "edges")


def cosine_edges(spark, sf):
    return rounded(
        graph.cosine_edges(
            _vector_edges(spark, sf), b.vectors(spark, sf), "vec_id", "embedding", b.VECTOR_WIDTH
        ), 6,
    )


def area_similarity(spark, sf):
    """Neighbouring areas compared by fatality, tests, age and affiliates of all waves."""
    vectors = materialise(communities.area_vectors(_features_v2(spark, sf)), "vectors")
    return rounded(
        graph.cosine_edges(_nation_edges(spark, sf), vectors, "CVEGEO", "vector",
                           communities.VECTOR_WIDTH), 6,
    )


def _vector_graph(spark, sf):
    found = communities.similarity_graph(
        _vector_edges(spark, sf), b.vectors(spark, sf), "vec_id", "embedding", b.VECTOR_WIDTH
    )
    return materialise(found, "graph")


def communities_two_rounds(spark, sf):
    return graph.propagate_labels_fixed(_vector_graph(spark, sf), 2)


def community_search(spark, sf):
    return graph.communities(_vector_graph(spark, sf))


def communities_audit(spark, sf):
    """What must hold of any finished search: settled, numbered without gaps, sizes right."""
    edges = _vector_graph(spark, sf)
    found = materialise(graph.communities(edges), "found")
    groups = found.groupBy("community").agg(F.count(F.lit(1)).alias("members"), F.max("n").alias("n"))
    restless = graph.unsettled(edges, found.select("id", F.col("community").alias("label")))
    totals = groups.agg(
        F.sum("members").alias("vertices"),
        (F.max("community") - F.count(F.lit(1))).alias("gaps"),
        F.count_if(F.col("members") != F.col("n")).alias("wrong_sizes"),
    )
    return stack_named({
        "vertices": totals.select(F.col("vertices").alias("n")),
        "gaps": totals.select(F.col("gaps").alias("n")),
        "wrong_sizes": totals.select(F.col("wrong_sizes").alias("n")),
        "unsettled": restless.agg(F.count(F.lit(1)).alias("n")),
    }, "what")


def partition_quality(spark, sf):
    membership = b.table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), "label")
    return rounded(graph.partition_quality(_vector_graph(spark, sf), membership), 6)


def top_institution_per_community(spark, sf):
    table = materialise(resources_population(spark, sf), "resources")
    membership = b.membership(spark, sf)
    return stack_named(
        {
            "afiliados": communities.top_institution(membership, table, "poblacion")
            .withColumnRenamed("poblacion", "valor"),
            "camas": communities.top_institution(membership, table, "camas")
            .withColumnRenamed("camas", "valor"),
        },
        "medida",
    )


def contribution_label(spark, sf):
    table = materialise(resources_population(spark, sf), "resources")
    return communities.contribution_label(b.membership(spark, sf), table)


def bed_zscore(spark, sf):
    return rounded(communities.bed_zscore(
        b.membership(spark, sf), resources_population(spark, sf), population(spark, sf)
    ))


# --- statistics and models ----------------------------------------------------------

def _rates_and_beds(spark, sf):
    beds = resources.beds_per_100k(b.facilities(spark, sf), population(spark, sf))
    return natural_join(fatality(spark, sf), beds)


def loglog_regression_by_wave(spark, sf):
    rows = _rates_and_beds(spark, sf).where(F.col("casos_totales") > 5)
    return rounded(stats.loglog_regression(rows, "beds_per_100khab", "cfr", "ola"))


def glm_coefficients(spark, sf):
    rows = _rates_and_beds(spark, sf)
    return rounded(stats.glm_coefficients(rows, "cfr ~ beds_per_100khab + ola"), 6)


def glm_estimates(spark, sf):
    """The coefficient table without p-values, which SQL can check."""
    return glm_coefficients(spark, sf).drop("p_value")


def cv_metrics_linear(spark, sf):
    """Fatality by beds and tests, all waves together: ridge models over folds and on the test rows."""
    rates, tests = _rates_and_tests(spark, sf, population(spark, sf))
    beds = resources.beds_per_100k(b.facilities(spark, sf), population(spark, sf))
    rows = natural_join(natural_join(rates, tests, "inner"), beds, "inner").withColumn("olas", F.lit("todas"))
    return rounded(linear_cv.cv_metrics_linear(
        rows, "cfr", ["beds_per_100khab", "pruebas_dia_capita"], ["CVEGEO", "ola"], "olas"
    ), 6)


def _rates_and_tests(spark, sf, people):
    """Fatality and tests per inhabitant, from one pass over the cases."""
    counts = materialise(epidemic.case_counts(
        b.cases(spark, sf), WAVES, b.ANCHOR, laboratory=b.LABORATORY, death_after=b.DEATH_AFTER
    ), "counts")
    tests = epidemic.tests_per_capita(epidemic.tests_of(counts, WAVES), people)
    return epidemic.fatality_of(counts, WAVES), tests


def _features_v1(spark, sf):
    table = materialise(resources_population(spark, sf), "resources")
    people = population(spark, sf)
    rates, tests = _rates_and_tests(spark, sf, people)
    return features.feature_table_v1(
        rates, resources.per_affiliate_wide(table),
        resources.demographic_shares(b.demography(spark, sf)), tests,
        resources.coverage_wide(table, people),
    )


def feature_table_v1(spark, sf):
    return rounded(_features_v1(spark, sf))


def _features_v2(spark, sf):
    rates, tests = _rates_and_tests(spark, sf, population(spark, sf))
    return features.feature_table_v2(
        rates, resources.demographic_shares(b.demography(spark, sf)), _contributions(spark, sf), tests,
    )


def feature_table_v2(spark, sf):
    return rounded(_features_v2(spark, sf))


def _scenario_run(spark, sf, features_of, name):
    """All forests of the scenarios at the operator's defaults: read where they have been grown from these rows."""
    table, settings = materialise(features_of(spark, sf), "features"), forest.ForestSettings()
    path = results.run_path(table, settings, name)
    if not results.is_kept(spark, path):
        results.keep_run(forest_growth.grow_scenarios(table, dims.SCENARIOS, settings), settings, path)
    return results.read_run(spark, path)


def scenario_forest_metrics(spark, sf):
    return _scenario_run(spark, sf, _features_v1, "v1").metrics


def scenario_forest_importance(spark, sf):
    return _scenario_run(spark, sf, _features_v1, "v1").importance


def scenario_forest_metrics_v2(spark, sf):
    return _scenario_run(spark, sf, _features_v2, "v2").metrics


def scenario_forest_importance_v2(spark, sf):
    return _scenario_run(spark, sf, _features_v2, "v2").importance


def scenario_models(spark, sf):
    """The forests of a kept run by scenario, with the settings that its manifest tells."""
    run = _scenario_run(spark, sf, _features_v1, "v1")
    counted = run.models.groupBy("scenario").agg(F.count(F.lit(1)).alias("models"))
    trees = run.nodes.select("model", "tree").distinct().join(run.models, "model").groupBy("scenario").agg(
        F.count(F.lit(1)).alias("trees_grown")
    )
    told = run.manifest.select("trees", "folds", "settings").first()
    return counted.join(trees, "scenario").withColumns({c: F.lit(told[c]) for c in told.asDict()})


def hash_split_folds(spark, sf):
    keys = ["o_orderkey"]
    return b.table(spark, sf, "orders").groupBy(
        forest.split_flag(keys).alias("train"), forest.fold_number(keys).alias("fold")
    ).agg(F.count(F.lit(1)).alias("n"))


# --- sources and small operators ----------------------------------------------------

def cube_slice_union(spark, sf):
    def batch(first, last):
        years = range(first, last + 1)
        facts = b.resources(spark, sf, years)
        return cube_slice(
            facts, ["state", "resources_categories", "year"], ["total"], {"year": list(years)}
        ).where(F.col("total") > 0)

    return batch(1998, 2001).unionByName(batch(1995, 1997))


def json_records_scan(spark, sf):
    events = b.table(spark, sf, "events")
    extra = F.from_json("props", "k int").getField("k").cast("double")
    records = F.array(*[
        F.struct("event_type", F.lit(n).alias("measure"), c.alias("amount"))
        for n, c in (("value", F.col("value")), ("k", extra))
    ])
    documents = events.select(F.to_json(F.struct(records.alias("data"))).alias("document"))
    rows = parse_json_records(documents, "document", "event_type string, measure string, amount double")
    exact = F.sum(F.col("amount").cast("decimal(18,2)")).cast("double")
    return rows.groupBy("event_type", "measure").agg(
        F.count(F.lit(1)).alias("n"), exact.alias("total")
    )


def tsv_round_trip(spark, sf):
    rows = front(b.facilities(spark, sf), "CVEGEO").withColumn("areas", F.lit(None).cast("string"))
    path = new_path(spark, "tsv")
    write_delimited(rows, path)
    back = drop_all_missing(read_delimited_folder(spark, f"{path}/*.csv", rows.schema))
    return back.drop(*columns_matching(back, prefix="FILE"))


def cube_slice_landed(spark, sf):
    """The cube's batches from landed years: the items are read once, and a batch opens its own years only."""
    facts = b.resources(spark, sf, range(1995, 2002)).select("state", "resources_categories", "year", "total")
    path = new_path(spark, "landed")
    landing.land_years(facts, path)

    def batch(first, last):
        years = list(range(first, last + 1))
        rows = landing.read_years(spark, path, facts.schema, years)
        return cube_slice(rows, ["state", "resources_categories", "year"], ["total"]).where(F.col("total") > 0)

    return batch(1998, 2001).unionByName(batch(1995, 1997))


def json_splits_scan(spark, sf):
    """Event measures through JSON documents that are read in splits, with names that need cleaning."""
    events = b.table(spark, sf, "events")
    extra = F.from_json("props", "k int").getField("k").cast("double")
    records = F.array(*[
        F.struct(F.col("event_type").alias("Event Type"), F.lit(n).alias("Measure"), c.alias("Amount (total)"))
        for n, c in (("value", F.col("value")), ("k", extra))
    ])
    # A document holds the records of a thousand events at most.
    documents = events.groupBy(F.floor(F.col("event_id") / 1000).alias("part")).agg(
        F.flatten(F.collect_list(records)).alias("data")
    )
    path = new_path(spark, "json")
    source = F.array(F.struct(F.lit("events").alias("name")))
    documents.select(F.to_json(F.struct("data", source.alias("source")))).write.text(path)
    rows = json_splits.read_json_records_split(
        spark, path, "`Event Type` string, Measure string, `Amount (total)` double"
    )
    exact = F.sum(F.col("amount_total").cast("decimal(18,2)")).cast("double")
    return rows.groupBy("event_type", "measure").agg(F.count(F.lit(1)).alias("n"), exact.alias("total"))


def contiguity_features(spark, sf):
    """Both rules of contiguity over polygons that were written as GeoJSON lines and read again."""
    corners = b.customer_squares(spark, sf).groupBy("geo_id", "part", "ring").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("seq", "x", "y"))), lambda p: F.array(p["x"], p["y"])).alias("line")
    )
    path = new_path(spark, "geojson")
    corners.select(F.to_json(F.struct(
        F.lit("Feature").alias("type"), F.struct(F.col("geo_id").cast("string").alias("CVEGEO")).alias("properties"),
        F.struct(F.lit("Polygon").alias("type"), F.array("line").alias("coordinates")).alias("geometry"),
    ))).write.text(path)
    vertices = materialise(read_polygon_features(spark, path, "CVEGEO"), "vertices")
    return stack_named({rule: graph.contiguity(vertices, rule) for rule in ("queen", "rook")}, "rule")


# Overlapping and open periods of days.
PERIODS = [
    ("antes", None, "1996-06-30"), ("primera", "1995-03-01", "1997-02-28"), ("larga", "1996-01-01", "2000-12-31"),
    ("dia", "1998-07-04", "1998-07-04"), ("vacia", "1990-01-01", "1990-12-31"), ("al revés", "1999-01-01", "1998-01-01"),
    ("desde", "2001-01-01", None), ("todo", None, None),
]


def orders_by_period(spark, sf):
    orders = b.table(spark, sf, "orders").select("o_orderdate", "o_orderpriority", "o_totalprice")
    known = literal_table(spark, PERIODS, "period string, first string, last string").select(
        "period", F.to_date("first").alias("first"), F.to_date("last").alias("last")
    )
    exact = F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double")
    return interval_join(orders, known, "o_orderdate", "first", "last").groupBy("period", "o_orderpriority").agg(
        F.count(F.lit(1)).alias("n"), exact.alias("total")
    )


def not_in_keep_null(spark, sf):
    flag = F.when(F.col("l_linenumber") != 7, F.col("l_returnflag"))
    rows = b.table(spark, sf, "lineitem").select(flag.alias("flag"), "l_quantity")
    return rows.where(not_in("flag", ["A", "N"])).groupBy("flag").agg(
        F.count(F.lit(1)).alias("n"), sum_or_zero("l_quantity").alias("total")
    )


def sorted_distinct(spark, sf):
    return b.table(spark, sf, "part").select("p_brand", "p_type").dropna().distinct().orderBy(
        "p_brand", "p_type"
    )


def sorted_limit(spark, sf):
    """The ten largest orders: a sort and a limit that run as one top-k."""
    orders = b.table(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    return orders.orderBy(F.desc("o_totalprice"), "o_orderkey").limit(10)


def column_subset_scan(spark, sf):
    """Two columns of a delimited file with many."""
    path = new_path(spark, "tsv")
    rows = b.facilities(spark, sf)
    write_delimited(rows, path)
    return read_delimited(spark, path, rows.schema, columns=["clues", "beds"])


def sliced_write(spark, sf):
    """Output per slice, and a read of one slice that opens no other."""
    path = new_path(spark, "sliced")
    orders = b.table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", "o_custkey")
    write_sliced(orders, path, ["o_orderstatus"])
    back = spark.read.parquet(path).where(F.col("o_orderstatus") == "F")
    return back.groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"), F.sum("o_custkey").alias("keys"))


def catalog_table(spark, sf):
    """A table read by its name in the session's catalogue."""
    b.table(spark, sf, "supplier").createOrReplaceTempView("clinigrid_suppliers")
    return read_table(spark, "clinigrid_suppliers").groupBy("s_nationkey").agg(F.count(F.lit(1)).alias("n"))


def contiguity_tolerance(spark, sf):
    """Corners within a tolerance meet; on unit squares these are the exact corners."""
    return graph.contiguity(b.nation_squares(spark, sf), tolerance=0.1)


def binscatter_beds_range(spark, sf):
    """The bins of the beds within a shown range only."""
    return rounded(resources.bins_of_resources(
        _catchments(spark, sf), "poblacion", "beds", 5, x_range=(14_800.0, 16_500.0)
    ))


def _thirds_missing(spark, sf):
    """Line items whose flag is missing on every third order."""
    flag = F.when(F.col("l_orderkey") % 3 != 0, F.col("l_returnflag"))
    return b.table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", flag.alias("flag"), "l_quantity", F.col("l_extendedprice").alias("price")
    )


def top_missing_key(spark, sf):
    return top_with_ties(_thirds_missing(spark, sf), ["flag"], "l_quantity").groupBy("flag", "l_quantity").agg(
        F.count(F.lit(1)).alias("n")
    )


def group_stats_missing_key(spark, sf):
    rows = with_group_stats(
        _thirds_missing(spark, sf), ["flag"], {"largest": F.max("l_quantity"), "rows": F.count(F.lit(1))},
        salt_on=["l_orderkey", "l_linenumber"],
    )
    return rows.groupBy("flag", "largest", "rows").agg(F.sum("l_quantity").alias("quantity"))


def _quantiles_missing_key(spark, sf, limit):
    return rounded(quantiles(_thirds_missing(spark, sf), "price", (0.1, 0.5, 0.9), ["flag"], percentile_rows=limit))


def quantiles_missing_key(spark, sf):
    return _quantiles_missing_key(spark, sf, 10**9)


def quantiles_missing_key_ranked(spark, sf):
    """The same through the distributed rank selection."""
    return _quantiles_missing_key(spark, sf, 0)


def weeks_missing_date(spark, sf):
    day = F.when(F.col("o_orderkey") % 4 != 0, F.col("o_orderdate").cast("date"))
    return epidemic.weekly_cases(b.table(spark, sf, "orders").select(day.alias("FECHA_SINTOMAS")))


def area_keys(spark, sf):
    """Both key dialects, numbers as text included, end up as one padded key."""
    places = b.areas(spark, sf)
    joined = geo_key(to_number("municipality_id").cast("int"))
    customers = b.table(spark, sf, "customer").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(
        F.count(F.lit(1)).alias("n")
    )
    return natural_join(places, customers, "inner").select(
        joined.alias("from_code"), geo_key("state_id", "MUN").alias("from_parts"), "n"
    )


QUERIES: dict[str, Query] = {
    f.__name__: f for f in (
        cfr_by_wave, outcome_shares, tests_per_day_by_wave, tests_per_capita, epi_week_labels,
        facility_staff, resources_by_area_institution, institution_harmonised,
        resources_population, affiliation_long, demographic_shares, capita_wide, coverage_wide,
        contiguity_queen, contiguity_rook, simple_graph, neighbourhood_totals, own_vs_neighbour,
        cosine_edges, area_similarity, communities_two_rounds, communities_audit, partition_quality, top_institution_per_community,
        contribution_label, bed_zscore, beds_per_100k, loglog_regression_by_wave,
        glm_coefficients, glm_estimates, cv_metrics_linear, units_by_state_institution, institution_sizes, state_bed_category,
        state_totals_population, resource_trend, resource_type_crosstab, population_quantiles,
        binscatter_beds, binscatter_by_institution, cube_slice_union, json_records_scan,
        sorted_limit, column_subset_scan, sliced_write, catalog_table, contiguity_tolerance,
        binscatter_beds_range, top_missing_key, group_stats_missing_key, quantiles_missing_key,
        quantiles_missing_key_ranked, weeks_missing_date,
        tsv_round_trip, not_in_keep_null, sorted_distinct, area_keys, capitalised_labels,
        scenario_waves, hash_split_folds, feature_table_v1, feature_table_v2,
        scenario_forest_metrics, scenario_forest_importance, scenario_forest_metrics_v2, scenario_forest_importance_v2,
        scenario_models, binscatter_clinics_areas, nonempty_batches, cube_slice_landed, json_splits_scan, contiguity_features, orders_by_period,
    )
} | {"communities": community_search}
