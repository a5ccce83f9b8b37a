"""Session helpers: local sessions for tests, and durable cut-points for long plans."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator, Sequence
from contextlib import contextmanager
from contextvars import ContextVar
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType


def local_session(cpus: int | str = 8, **conf: str) -> SparkSession:
    """A session for tests and benches; on a cluster the caller brings their own."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("clinigrid")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        # Plans here have many generated columns; call sites of each cost driver time.
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """Folder every executor can reach, for tables that cut lineage.

    The cluster names it in ``spark.checkpoint.dir``. Only a local-mode session
    that names none gets a temporary folder; on a cluster that would put the
    files on one machine, so it is refused.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder all executors can reach")
    return _local_folder(spark.sparkContext.applicationId)


@cache
def _local_folder(application: str) -> str:
    folder = tempfile.mkdtemp(prefix=f"{application}-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    return folder


def new_path(spark: SparkSession, name: str) -> str:
    """A path that nothing else uses; ``scratch`` blocks delete it at their end."""
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    for held in _scratch.get():
        held.append(path)
    return path


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once and read it back: the plan restarts at files.

    Unlike a cached or locally checkpointed frame the rows outlive executors, and
    unlike an RDD checkpoint the plan runs once and the file sizes are known to the
    optimizer.
    """
    return write_stage(df, name)[0]


def write_stage(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """The written table and its path, for loops that drop a stage once the next is written."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


# What open ``scratch`` blocks have written so far; every thread has blocks of its own.
_scratch: ContextVar[tuple[list[str], ...]] = ContextVar("scratch", default=())


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Deletes at its end all tables and files that functions of this library stored inside the block.

    Results are lazy and may read those tables: collect or write them inside.
    """
    held: list[str] = []
    token = _scratch.set((*_scratch.get(), held))
    try:
        yield
    finally:
        _scratch.reset(token)
        for path in held:
            drop_stage(spark, path)


def drop_stage(spark: SparkSession, path: str | None) -> None:
    """Delete a table written by ``write_stage`` that no plan reads any more."""
    if path is not None:
        target = spark._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def path_exists(spark: SparkSession, path: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


def literal_table(spark: SparkSession, rows: Sequence[tuple], ddl: str) -> DataFrame:
    """A small table held in the plan itself, so that its size is known to the optimizer."""
    schema = StructType.fromDDL(ddl)
    columns = zip(*rows) if rows else [[] for _ in schema]
    arrow = to_arrow_schema(schema)
    arrays = [pa.array(list(c), f.type) for c, f in zip(columns, arrow)]
    return spark.createDataFrame(pa.Table.from_arrays(arrays, schema=arrow), schema)


def estimated_bytes(df: DataFrame) -> int:
    """The optimizer's size estimate; exact for tables read from files without a filter."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def row_count_within(df: DataFrame, limit: int) -> bool:
    """True when ``df`` has at most ``limit`` rows; never counts further than that."""
    return df.limit(limit + 1).count() <= limit


def fits(df: DataFrame, rows: int, size: int) -> bool:
    """True when ``df`` has at most ``rows`` rows of ``size`` bytes as text; looks no further than that."""
    text = F.octet_length(F.to_json(F.struct(*[df[f"`{c}`"] for c in df.columns])))
    found = df.select(text.alias("n")).limit(rows + 1).agg(F.count(F.lit(1)), F.sum("n")).first()
    return found[0] <= rows and (found[1] or 0) <= size
