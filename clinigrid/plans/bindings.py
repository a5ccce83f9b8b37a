"""The domain tables, read off the benchmark star schema.

An area is a nation and a state its region; cases are orders, facilities suppliers,
resources line items by part type, inhabitants customers. Polygon layers are unit squares.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from clinigrid import dims
from clinigrid.functions import pad_left
from clinigrid.operators.joins import natural_join

# Sunday that opens week 1 of the order dates, and a day before the first of them.
ANCHOR = date(1995, 1, 1)
DEATH_AFTER = date(1994, 12, 31)
LABORATORY = (3, 5)
LATEST_YEAR = 2001
STAFF_PATTERN = "promo|standard"
RESOURCE_TYPES = (("large|small", "camas"), ("promo|standard", "personal"))
NATION_GRID, VECTOR_GRID, CUSTOMER_GRID = 5, 25, 100
VECTOR_WIDTH = 64

SCHEMAS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": (
        "c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string"
    ),
    "supplier": "s_suppkey long, s_name string, s_nationkey int, s_acctbal double",
    "part": (
        "p_partkey long, p_name string, p_brand string, p_type string, p_size int, "
        "p_retailprice double"
    ),
    "orders": (
        "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, "
        "o_orderdate timestamp_ntz, o_orderpriority string"
    ),
    "lineitem": (
        "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, "
        "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, "
        "l_linestatus string, l_shipdate timestamp_ntz"
    ),
    "events": (
        "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, "
        "props string"
    ),
    "embeddings": "vec_id long, embedding array<float>, label int",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(SCHEMAS[name]).parquet(f"{sf_dir}/{name}.parquet")


def areas(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    state = (F.col("n_regionkey") + 1).cast("string")
    code = pad_left(F.col("n_nationkey") + 1, 3)
    return nation.join(region, nation.n_regionkey == region.r_regionkey).select(
        "n_nationkey", state.alias("state_id"), F.col("r_name").alias("state"),
        F.concat(state, code).alias("municipality_id"), F.col("n_name").alias("municipality"),
        code.alias("MUN"), F.concat(pad_left(state, 2), code).alias("CVEGEO"),
        F.col("n_regionkey").alias("community"),
    )


def membership(spark: SparkSession, sf_dir: str) -> DataFrame:
    return areas(spark, sf_dir).select("CVEGEO", "community")


def cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Case line list. Both joins are plain scans, so adaptive execution may split a
    customer that holds a large part of all orders."""
    orders = table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("c_custkey"),
        F.col("o_orderdate").cast("date").alias("FECHA_SINTOMAS"),
        F.when(F.col("o_orderstatus") == "F", F.col("o_orderdate").cast("date")).alias("FECHA_DEF"),
        F.substring("o_orderpriority", 1, 1).cast("int").alias("CLASIFICACION_FINAL"),
    )
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    area = table(spark, sf_dir, "nation").select(
        F.col("n_nationkey").alias("c_nationkey"),
        (F.col("n_regionkey") + 1).cast("string").alias("ENTIDAD_RES"),
        (F.col("n_nationkey") + 1).cast("string").alias("MUNICIPIO_RES"),
    )
    return natural_join(natural_join(orders, customer, "inner"), area, "inner").drop(
        "c_custkey", "c_nationkey"
    )


def facilities(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes = F.array(*[F.lit(c) for c in sorted(dims.INSTITUTIONS)])
    place = F.pmod("s_suppkey", F.lit(len(dims.INSTITUTIONS))).cast("int")
    supplier = table(spark, sf_dir, "supplier").select(
        F.col("s_nationkey").alias("n_nationkey"), F.col("s_suppkey").alias("clues"),
        F.get(codes, place).alias("institution"),
        F.when(F.col("s_acctbal") > 0, F.floor(F.col("s_acctbal") / 100)).cast("long").alias("beds"),
        F.lit(1).cast("long").alias("clinics"),
    )
    return supplier.join(areas(spark, sf_dir), "n_nationkey").drop("MUN", "community", "n_nationkey")


def resources(
    spark: SparkSession, sf_dir: str, years: Sequence[int] | None = None, with_area: bool = True
) -> DataFrame:
    """Resources per facility, category and year.

    Line items are reduced to this grain before they meet facilities and areas, so a
    facility with very many items crosses those joins as a few rows.
    """
    items = table(spark, sf_dir, "lineitem").select(
        F.col("l_partkey").alias("p_partkey"), F.col("l_suppkey").alias("clues"), "l_shipdate",
        F.col("l_quantity").alias("total"),
    )
    if years:
        low, high = date(min(years), 1, 1), date(max(years) + 1, 1, 1)
        items = items.where((F.col("l_shipdate") >= F.lit(low)) & (F.col("l_shipdate") < F.lit(high)))
    part = table(spark, sf_dir, "part").select(
        "p_partkey", F.col("p_type").alias("resources_categories")
    )
    cube = (
        natural_join(items, part, "inner")
        .groupBy("clues", "resources_categories", F.year("l_shipdate").alias("year"))
        .agg(F.sum("total").alias("total"))
    )
    if not with_area:
        return cube
    places = facilities(spark, sf_dir).select(
        "clues", "institution", "state_id", "state", "municipality_id", "municipality"
    )
    return natural_join(cube, places, "inner")


def census(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw census table: counts as text, ``*`` where a count is withheld (here: 0)."""
    segment, key, balance = F.col("c_mktsegment"), F.col("c_custkey"), F.col("c_acctbal")
    conditions: dict[str, Column] = {
        "POBTOT": F.lit(True),
        "PSINDER": balance < 0,
        "PDER_SS": balance >= 0,
        "PDER_IMSS": segment == "AUTOMOBILE",
        "PDER_ISTE": segment == "BUILDING",
        "PDER_ISTEE": (segment == "MACHINERY") & (key % 2 == 0),
        "PAFIL_PDOM": (segment == "FURNITURE") & (key % 2 == 0),
        "PDER_SEGP": segment == "HOUSEHOLD",
        "PDER_IMSSB": (segment == "FURNITURE") & (key % 2 == 1),
        "PAFIL_IPRIV": (segment == "MACHINERY") & (key % 4 == 1),
        "PAFIL_OTRAI": (segment == "MACHINERY") & (key % 4 == 3),
    }
    return _census_rows(spark, sf_dir, conditions, withheld=True)


def demography(spark: SparkSession, sf_dir: str) -> DataFrame:
    balance = F.col("c_acctbal")
    return _census_rows(spark, sf_dir, {
        "POBTOT": F.lit(True),
        "POBFEM": F.col("c_custkey") % 2 == 0,
        "POB0_14": balance < 0,
        "POB15_64": balance.between(0, 5000),
        "POB65_MAS": balance > 5000,
    })


def _census_rows(spark, sf_dir, conditions: dict[str, Column], withheld: bool = False) -> DataFrame:
    counts = table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(
        *[F.count_if(c).alias(n) for n, c in conditions.items()]
    )
    if withheld:
        counts = counts.withColumns({
            n: F.when(F.col(n) == 0, F.lit("*")).otherwise(F.col(n).cast("string"))
            for n in conditions
        })
    places = areas(spark, sf_dir).select(
        "n_nationkey", pad_left("state_id", 2).alias("ENTIDAD"), F.col("state").alias("NOM_ENT"),
        "MUN", F.col("municipality").alias("NOM_MUN"), F.lit("0000").alias("LOC"),
        F.lit(dims.MUNICIPALITY_TOTAL).alias("NOM_LOC"),
    )
    return natural_join(places, counts, "inner").drop("n_nationkey")


def squares(df: DataFrame, area: Column, number: Column, width: int) -> DataFrame:
    """One unit square per row, laid out row by row in a grid ``width`` squares wide."""
    corners = F.array(*[
        F.struct(F.lit(float(x)).alias("dx"), F.lit(float(y)).alias("dy"))
        for x, y in ((0, 0), (1, 0), (1, 1), (0, 1))
    ])
    column, row = F.pmod(number, F.lit(width)), F.floor(number / width)
    return (
        df.select(area.alias("geo_id"), column.alias("_c"), row.alias("_r"))
        .select("geo_id", "_c", "_r", F.posexplode(corners).alias("seq", "_p"))
        .select("geo_id", F.lit(0).alias("part"), F.lit(0).alias("ring"), "seq",
                (F.col("_c") + F.col("_p.dx")).alias("x"), (F.col("_r") + F.col("_p.dy")).alias("y"))
    )


def nation_squares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return squares(areas(spark, sf_dir), F.col("CVEGEO"), F.col("n_nationkey"), NATION_GRID)


def customer_squares(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "customer")
    return squares(df, F.col("c_custkey"), F.col("c_custkey"), CUSTOMER_GRID)


def vector_squares(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "embeddings")
    return squares(df, F.col("vec_id"), F.col("vec_id"), VECTOR_GRID)


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(
        "vec_id", F.col("embedding").cast("array<double>").alias("embedding"), "label"
    )


def supply_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw weighted pairs with repeats: suppliers, with even numbers, and their parts, with odd ones."""
    return table(spark, sf_dir, "lineitem").select(
        (2 * F.col("l_suppkey")).alias("V1"), (2 * F.col("l_partkey") + 1).alias("V2"),
        F.col("l_quantity").alias("weight"),
    )


def catchments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """People served and beds per facility: line items shipped, and the supplier's beds."""
    served = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("clues")).agg(
        F.sum("l_quantity").alias("poblacion")
    )
    places = facilities(spark, sf_dir).select(
        "clues", "institution", F.coalesce("beds", F.lit(0)).cast("long").alias("beds")
    )
    return natural_join(places, served, "inner")
