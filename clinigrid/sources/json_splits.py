"""Large JSON documents of records, read in splits.

A document is cut at closing braces, which Spark's text reader can do in parallel whatever
the document's size. Whether a cut lies in a string, how deep it is nested and which record
it belongs to depend on all that stands before: prefix sums of quote parity and depth, first
within a split of the file and then over splits, tell it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clinigrid.functions import clean_names
from clinigrid.session import materialise

# A record's own brace is the third opened: the document's, the array's, its own.
RECORD_DEPTH = 3
FILE, SPLIT = ["file"], ["file", "split"]
# Up to the first brace behind a comma or an opened array; strings are passed over whole.
LEAD = r'^(?:[^"\[,]++|"(?:[^"\\]++|\\.)*+"|[\[,](?!\s*+\{))*+[\[,]\s*+'
# The last array that is opened there.
ARRAY_NAME = r'(?s)^.*"((?:[^"\\]|\\.)*)"\s*:\s*\['


def fragments(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(file, split, at, value): what stands before each closing brace, in the file's order by split and at."""
    return spark.read.option("lineSep", "}").text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"),
        F.monotonically_increasing_id().alias("at"), "value",
    )


def running(rows: DataFrame, how, column: str, name: str) -> DataFrame:
    """``rows`` with ``name``: ``how`` over all earlier rows of the file, by splits first.

    A split is bounded by the reader; the second scan sees one row a split.
    """
    before = (Window.unboundedPreceding, -1)
    inside = Window.partitionBy(*SPLIT).orderBy("at").rowsBetween(*before)
    over = Window.partitionBy(*FILE).orderBy("split").rowsBetween(*before)
    last = F.row_number().over(Window.partitionBy(*SPLIT).orderBy(F.desc("at"))) == 1
    near = rows.withColumn("_near", how(column).over(inside))
    total = how(column).over(Window.partitionBy(*SPLIT).orderBy("at").rowsBetween(Window.unboundedPreceding, 0))
    splits = rows.select(*SPLIT, total.alias("_total"), last.alias("_last")).where("_last").select(
        *SPLIT, how("_total").over(over).alias("_far")
    )
    return near.join(splits, SPLIT).withColumn(name, _joined(how, "_far", "_near")).drop("_near", "_far")


def _joined(how, far: str, near: str) -> Column:
    if how is _latest:
        return F.coalesce(near, far)
    zero = F.lit(0).cast("bigint")
    return F.coalesce(far, zero) + F.coalesce(near, zero)


def _latest(column: str) -> Column:
    return F.last(column, ignorenulls=True)


def _count(text: Column, sign: str) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(sign), F.lit("")))


def record_texts(spark: SparkSession, path: str | list[str], field: str = "data") -> DataFrame:
    """(file, record, text) of the objects in the top-level array ``field`` of each document.

    A document is one object; other fields, before or after, may hold anything that is not
    nested like records, or arrays of objects of their own, which are left out. Line breaks,
    braces and escaped quotes in strings are text.
    """
    # Escaped signs are taken out first: none is a quote or a brace of the document.
    plain = F.regexp_replace("value", r"\\.", "")
    rows = materialise(
        fragments(spark, path).withColumn("quotes", _count(plain, '"').cast("bigint")), "json-fragments"
    )
    rows = running(rows, F.sum, "quotes", "quotes_before")
    opened = F.col("quotes_before") % 2 == 1
    closed_in_string = (F.col("quotes_before") + F.col("quotes")) % 2 == 1
    # What stands outside strings: an open string's end goes, whole strings go, the start of one goes.
    bare = F.when(opened, F.regexp_replace(plain, r'^[^"]*("|$)', "")).otherwise(plain)
    bare = F.regexp_replace(bare, r'"[^"]*("|$)', "")
    depth = _count(bare, "{") + _count(bare, "[") - _count(bare, "]")
    rows = rows.select(
        *SPLIT, "at", "value", closed_in_string.alias("inside"),
        (depth - F.when(closed_in_string, 0).otherwise(1)).cast("bigint").alias("change"),
    )
    rows = running(materialise(rows, "json-fragments"), F.sum, "change", "depth_before")
    ends = ~F.col("inside") & (F.col("depth_before") + F.col("change") == RECORD_DEPTH - 1)
    rows = materialise(rows.withColumn("ends", ends.cast("bigint")), "json-fragments")
    rows = materialise(running(rows, F.sum, "ends", "record"), "json-fragments")
    # Fragments of a record, and of what stands between it and the one before.
    whole = rows.groupBy(*FILE, "record").agg(
        F.min("split").alias("split"), F.min("at").alias("at"), F.max("ends").alias("ended"),
        F.concat_ws("}", F.transform(
            F.array_sort(F.collect_list(F.struct("split", "at", "value"))), lambda s: s["value"]
        )).alias("text"),
    ).where("ended = 1").drop("ended")
    # Before a record stand a comma or all that the document has before it, the name of its array included.
    simple = F.regexp_extract("text", r"^\s*,\s*(?=\{)", 0)
    lead = F.when(simple != "", simple).otherwise(F.regexp_extract("text", LEAD, 0))
    named = F.regexp_extract(lead, ARRAY_NAME, 1)
    whole = whole.withColumns({
        "array": F.when(named != "", named),
        "text": F.concat(F.substring("text", F.length(lead) + 1, F.length("text")), F.lit("}")),
    })
    kept = running(materialise(whole, "json-records"), _latest, "array", "array_before")
    return kept.where(F.coalesce("array", "array_before") == field).select("file", "record", "text")


def read_json_records_split(
    spark: SparkSession, path: str | list[str], record: str | T.StructType, field: str = "data", clean: bool = True
) -> DataFrame:
    """Rows of the ``field`` array of JSON documents, whose size is bounded by nothing but their records'."""
    fields = T.StructType.fromDDL(record) if isinstance(record, str) else record
    rows = record_texts(spark, path, field).select(F.from_json("text", fields).alias("r")).select("r.*")
    return clean_names(rows) if clean else rows
