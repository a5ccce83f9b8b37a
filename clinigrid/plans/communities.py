"""Service communities of areas: how they form and who carries them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clinigrid import dims
from clinigrid.dims import WAVE_LABELS
from clinigrid.functions import mean_strict, ratio, sum_strict
from clinigrid.operators.graph import communities, cosine_edges, simple_graph
from clinigrid.operators.grouping import top_with_ties, with_group_stats
from clinigrid.operators.joins import natural_join, suffixed_join
from clinigrid.operators.reshape import to_wide
from clinigrid.plans.resources import with_area_key

# Columns that vary by wave, and columns that are the same in every wave.
BY_WAVE = ("cfr", "pruebas_dia_capita")
CONSTANT = ("mun_derechohabientes_PDER_IMSS", "POB65_MAS", "POBFEM")
VECTOR_WIDTH = len(BY_WAVE) * len(WAVE_LABELS) + len(CONSTANT)


def area_vectors(features: DataFrame, waves=WAVE_LABELS) -> DataFrame:
    """One array per area: rates of every wave, then the columns that do not change."""
    wide = to_wide(features, ["CVEGEO"], "ola", list(waves), [*BY_WAVE, *CONSTANT])
    names = [f"{v}_{w}" for v in BY_WAVE for w in waves]
    names += [f"{v}_{waves[0]}" for v in CONSTANT]
    return wide.select("CVEGEO", F.array(*[F.col(n).cast("double") for n in names]).alias("vector"))


def similarity_graph(
    edges: DataFrame, vectors: DataFrame, key: str, features: str, width: int | None = None,
    weight: str = "distance",
) -> DataFrame:
    """Simple graph of neighbouring areas, weighted by cosine distance or similarity."""
    pairs = cosine_edges(edges, vectors, key, features, width)
    value = F.col("cosine_distance") if weight == "distance" else 1 - F.col("cosine_distance")
    return simple_graph(pairs.withColumn("weight", value))


def service_communities(
    edges: DataFrame, vectors: DataFrame, key: str, features: str, width: int | None = None,
    weight: str = "distance", trials: int = 4, max_iter: int | None = None, seed: int = 725,
) -> DataFrame:
    """Community of every area: (key, community, n)."""
    graph = similarity_graph(edges, vectors, key, features, width, weight)
    found = communities(graph, trials, max_iter, seed)
    return found.withColumnRenamed("id", key)


def top_institution(membership: DataFrame, table: DataFrame, value: str) -> DataFrame:
    """Institution with the largest sum of ``value`` in each community, ties kept.

    ``membership``: CVEGEO, community.
    """
    rows = with_area_key(table).select("CVEGEO", "institucion", value)
    sums = (
        natural_join(membership, rows)
        .groupBy("community", "institucion").agg(sum_strict(value).alias(value))
    )
    return top_with_ties(sums, ["community"], value)


def contribution_label(membership: DataFrame, table: DataFrame) -> DataFrame:
    """Does the institution with most affiliates also provide most beds?"""
    beds = top_institution(membership, table, "camas")
    people = top_institution(membership, table, "poblacion")
    largest = F.col("institucion_y")
    same = F.coalesce(F.col("institucion_x") == largest, F.lit(False))
    text = F.when(same, F.concat(largest, F.lit(dims.MOST_BEDS_LABEL))).otherwise(
        F.concat(largest, F.lit(dims.MORE_BEDS_LABEL))
    )
    return suffixed_join(beds, people, ["community"]).select("community", text.alias("grupo"))


def bed_zscore(membership: DataFrame, table: DataFrame, population: DataFrame) -> DataFrame:
    """Beds of each area against the mean of its community, in standard deviations.

    A community may hold a large part of all areas, so its statistics are aggregated and
    joined back rather than computed in a window.
    """
    rows = with_area_key(table).select("CVEGEO", "camas")
    areas = (
        natural_join(natural_join(membership, population), rows)
        .groupBy("CVEGEO", "community", "POBTOT").agg(sum_strict("camas").alias("camas"))
    )
    stats = {
        "camas_comm_sum": sum_strict("camas"),
        "camas_comm_avg": mean_strict("camas"),
        "camas_comm_sd": F.when(F.count("camas") == F.count(F.lit(1)), F.stddev_samp("camas")),
    }
    return with_group_stats(areas, ["community"], stats, salt_on=["CVEGEO"]).withColumn(
        "z_score", ratio(F.col("camas") - F.col("camas_comm_avg"), "camas_comm_sd")
    )
