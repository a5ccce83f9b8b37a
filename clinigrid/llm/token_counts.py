"""Token counts of flat token files by a separator scan.

A flat file holds token ids of a fixed width, documents one after the other, each ended
by an end-of-document id, and no index. Blocks of a file are searched on their own;
a prefix scan over the blocks' counts and last separators stitches the documents that
cross them.
"""

from __future__ import annotations

import base64
import os

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from clinigrid.llm.common import append, documents, emit, ship
from clinigrid.llm.pieces import model_bytes
from clinigrid.session import materialise, new_path

RANKS_PATH = os.environ.get("TOKENIZER_PATH", "/opt/tokenizers") + "/byte_bpe_50k.tiktoken"
# How the tokenizer parts a text, and its end-of-document id.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
END_OF_DOCUMENT = 50256
WIDTH = 2
BLOCK_TOKENS = 1 << 20
# Files hold at most this many documents, so that one file fits a task.
FILE_DOCUMENTS = 20_000
# Blocks whose summaries are scanned together before the scan over such groups.
GROUP_BLOCKS = 1024


def write_flat(docs: DataFrame, path: str, ranks_path: str = RANKS_PATH) -> None:
    """Tokenise ``text`` and write flat files of 16-bit ids, every document ended by its separator.

    The text sink writes a record's bytes as they are and the separator behind them.
    Missing and empty texts become documents of no tokens.
    """
    ranks = docs.sparkSession.sparkContext.broadcast(model_bytes(ranks_path))

    def start():
        import tiktoken

        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.value.splitlines())}
        encoding = tiktoken.Encoding("flat", pat_str=SPLIT, mergeable_ranks=table, special_tokens={})

        def step(batch):
            return [[
                np.array(encoding.encode_ordinary(t or ""), dtype=f"<u{WIDTH}").tobytes()
                for t in batch.column("text").to_pylist()
            ]]

        return step

    separator = END_OF_DOCUMENT.to_bytes(WIDTH, "little").decode("latin-1")
    packed = append(docs.select(F.col("text").cast("string").alias("text")), start, "ids binary")
    packed.select(F.col("ids").cast("string").alias("value")).write.options(
        lineSep=separator, encoding="ISO-8859-1", maxRecordsPerFile=FILE_DOCUMENTS
    ).text(path)


def scan_blocks(
    spark: SparkSession, path: str, separator: int = END_OF_DOCUMENT, width: int = WIDTH,
    block_tokens: int = BLOCK_TOKENS,
) -> DataFrame:
    """(file, block, n_tokens, ends): where separators stand in every block of the flat files."""
    def start():
        def step(batch):
            out = [], [], [], []
            for i, file in enumerate(batch.column("path").to_pylist()):
                content = batch.column("content")[i].as_buffer()
                # A last token that is cut off is none.
                tokens = np.frombuffer(content, dtype=f"<u{width}", count=len(content) // width)
                for block, at in enumerate(range(0, len(tokens), block_tokens)):
                    part = tokens[at:at + block_tokens]
                    for column, value in zip(out, (
                        file.rsplit("/", 1)[-1], block, len(part), np.flatnonzero(part == separator).astype(np.int32)
                    )):
                        column.append(value)
            return out

        return step

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return emit(files, start, "file string, block bigint, n_tokens bigint, ends array<int>")


def documents_of(blocks: DataFrame, block_tokens: int = BLOCK_TOKENS, group_blocks: int = GROUP_BLOCKS) -> DataFrame:
    """(file, doc_no, start_token, n_tokens, ended) of every document in scanned blocks.

    Counts and last separators are scanned within groups of blocks, then over groups, so
    that no task holds all blocks of a large file. Tokens behind a file's last separator
    are a document that is not ``ended``. A file without tokens has no documents.
    """
    known = blocks.select(
        "file", "block", "n_tokens", "ends", F.floor(F.col("block") / group_blocks).alias("part"),
        F.size("ends").alias("n"), (F.col("block") * block_tokens).alias("offset"),
    ).withColumn("last", F.when(F.col("n") > 0, F.col("offset") + F.element_at("ends", -1)))
    parts = known.groupBy("file", "part").agg(
        F.sum("n").alias("n"), F.max("last").alias("last"), F.max(F.col("offset") + F.col("n_tokens")).alias("end")
    )
    over = Window.partitionBy("file").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    carried = parts.select(
        "file", "part", F.coalesce(F.sum("n").over(over), F.lit(0)).alias("docs_before"),
        F.coalesce(F.max("last").over(over), F.lit(-1)).alias("last_before"),
    )
    within = Window.partitionBy("file", "part").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    stitched = known.withColumns({
        "n_before": F.coalesce(F.sum("n").over(within), F.lit(0)), "last_within": F.max("last").over(within),
    }).join(carried, ["file", "part"])
    before = F.coalesce("last_within", "last_before")
    ended = stitched.where("n > 0").select(
        "file", "offset", before.alias("previous"), (F.col("docs_before") + F.col("n_before")).alias("first"), "ends",
        F.posexplode("ends").alias("i", "end"),
    ).select(
        "file", (F.col("first") + F.col("i")).cast("bigint").alias("doc_no"),
        (F.when(F.col("i") == 0, F.col("previous")).otherwise(
            F.col("offset") + F.get("ends", F.col("i") - 1)) + 1).alias("start_token"),
        (F.col("offset") + F.col("end")).alias("stop"), F.lit(True).alias("ended"),
    )
    tails = parts.groupBy("file").agg(
        F.sum("n").cast("bigint").alias("doc_no"), (F.coalesce(F.max("last"), F.lit(-1)) + 1).alias("start_token"),
        F.max("end").alias("stop"),
    ).where("stop > start_token").withColumn("ended", F.lit(False))
    return ended.unionByName(tails).select(
        "file", "doc_no", "start_token", (F.col("stop") - F.col("start_token")).alias("n_tokens"), "ended"
    )


def op1_token_counts(spark, sf_dir: str) -> DataFrame:
    path = new_path(spark, "flat-tokens")
    write_flat(documents(spark, sf_dir, "text"), path)
    blocks = materialise(scan_blocks(spark, path), "blocks")
    found = documents_of(blocks)
    return found.select(
        F.regexp_extract("file", r"part-(\d+)", 1).cast("bigint").alias("shard"),
        F.regexp_extract("file", r"-c(\d+)", 1).cast("bigint").alias("part"),
        "doc_no", "start_token", "n_tokens", "ended",
    )


ship(__name__)
