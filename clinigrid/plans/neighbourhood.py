"""Own resources against those of neighbouring areas."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clinigrid import dims
from clinigrid.functions import percent
from clinigrid.operators.graph import neighbour_sums
from clinigrid.operators.joins import natural_join
from clinigrid.operators.reshape import to_long, to_wide
from clinigrid.plans.resources import with_area_key

VALUES = ("camas", "clinicas", "personal", "derechohabientes")


def area_resources(table: DataFrame) -> DataFrame:
    """Affiliates, beds, clinics and staff per area and institution variable."""
    return with_area_key(table).select(
        "CVEGEO", "institucion_inegi", F.col("poblacion").alias("derechohabientes"),
        "camas", "clinicas", "personal",
    )


def neighbourhood_totals(
    edges: DataFrame, table: DataFrame, population: DataFrame,
    variables: Sequence[str] = dims.KEPT_VARIABLES,
) -> DataFrame:
    """Sums over the neighbours of each area, one column per value and institution."""
    wide = to_wide(area_resources(table), ["CVEGEO"], "institucion_inegi", variables, VALUES)
    return neighbour_sums(edges, natural_join(wide, population), "CVEGEO")


def own_and_neighbours(edges: DataFrame, table: DataFrame) -> DataFrame:
    """Long form: own value, neighbours' value, both together and the own share in percent."""
    own = area_resources(table)
    around = neighbour_sums(edges, own, "CVEGEO", ["institucion_inegi"])
    keys = ["CVEGEO", "institucion_inegi"]
    return (
        natural_join(
            to_long(own, keys, VALUES, "variable", "mun", "double"),
            to_long(around, keys, VALUES, "variable", "vecino", "double"),
        )
        .withColumn("full", F.col("mun") + F.col("vecino"))
        .withColumn("mun_contrib", percent("mun", "full"))
    )


def own_and_neighbours_wide(
    edges: DataFrame, table: DataFrame, variables: Sequence[str] = dims.KEPT_VARIABLES
) -> DataFrame:
    """Wide form: ``{mun,vecino,full,mun_contrib}_{value}_{variable}``."""
    rows = own_and_neighbours(edges, table).select(
        "CVEGEO", F.concat_ws("_", "variable", "institucion_inegi").alias("_cell"),
        "mun", "vecino", "full", "mun_contrib",
    )
    cells = [f"{value}_{variable}" for value in VALUES for variable in variables]
    return to_wide(rows, ["CVEGEO"], "_cell", cells, ["mun", "vecino", "full", "mun_contrib"])
