"""Token counts from flat, unindexed token files by a separator scan.

A token file is nothing but 16-bit token ids, documents one after another, each closed by an
end-of-document id. It is read in blocks of a fixed size, wherever these fall. In each block a
vectorised search finds the separators; what is cut by block borders is stitched by a prefix scan
over the blocks' summaries: how many separators came before, and how many tokens have been open
since the last. The scan has two levels - chunks of blocks, then the chunks' sums - so that a file
of any length is spread over tasks.

``write_token_blocks`` makes such files from texts, kept as a table of blocks (file, block, tokens)
that any store Spark writes to can hold; ``read_token_files`` cuts raw ``.bin`` files into the same
blocks. Null and empty texts are documents of zero tokens. Rows that repeat an id are documents of
their own. Texts are encoded whole, however long; an empty table has no files and no rows. Other
columns are not read. In which file a document lies depends on how rows are dealt to tasks; its
tokens don't.
"""

from __future__ import annotations

import base64
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import staged

#: Vocabulary as lines of "base64 rank", and the pattern that cuts texts before merging.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"""
END_OF_DOCUMENT = 50256
BLOCK_TOKENS = 1 << 16
#: Blocks of a chunk, the first level of the prefix scan.
CHUNK_BLOCKS = 1024


@lru_cache(maxsize=2)
def _encoding(path: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    return tiktoken.Encoding("vocabulary", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def ship_vocabulary(spark: SparkSession, path: str) -> str:
    """Give every executor the vocabulary file; returns the name to open it by."""
    spark.sparkContext.addFile(path)
    return path.rsplit("/", 1)[-1]


def write_token_blocks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """(file, block, tokens, ids): one token file for each task that encodes.

    ``tokens`` is a block of the flat file. ``ids`` lists the documents that end in the block, in
    order: the sidecar that names documents and that the scan does not read.
    """
    name = ship_vocabulary(docs.sparkSession, vocabulary)

    def run(batches):
        from pyspark import TaskContext

        encode = _encoding(SparkFiles.get(name)).encode_ordinary
        file, block = TaskContext.get().partitionId(), 0
        held, size, ids = [], 0, []
        end = np.array([END_OF_DOCUMENT], dtype=np.uint16)

        def rows(final: bool):
            nonlocal held, size, ids, block
            flat = np.concatenate(held) if held else np.zeros(0, dtype=np.uint16)
            cuts = [*range(0, len(flat) if final else len(flat) - len(flat) % BLOCK_TOKENS, BLOCK_TOKENS)]
            stop = len(flat) if final else len(cuts) * BLOCK_TOKENS
            out = [[], [], [], []]
            for s in cuts:
                part = flat[s : min(s + BLOCK_TOKENS, stop)]
                n = int((part == END_OF_DOCUMENT).sum())
                for column, value in zip(out, (file, block, part.tobytes(), ids[:n]), strict=True):
                    column.append(value)
                ids, block = ids[n:], block + 1
            held, size = [flat[stop:]], len(flat) - stop
            return pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.binary()), pa.array(out[3], pa.list_(pa.int64()))], names=["file", "block", "tokens", "ids"])

        for b in batches:
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if text:
                    tokens = np.array(encode(text), dtype=np.uint16)
                    held.append(tokens)
                    size += len(tokens)
                held.append(end)
                ids.append(doc)
                size += 1
                if size >= 32 * BLOCK_TOKENS:
                    yield rows(final=False)
        yield rows(final=True)

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "file long, block long, tokens binary, ids array<bigint>")


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """(file, block, tokens) of raw token files, through Spark's reader. A file is held whole by one task while it is cut."""

    def run(batches):
        for b in batches:
            for name, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                size = 2 * BLOCK_TOKENS
                parts = [content[s : s + size] for s in range(0, len(content) - len(content) % 2, size)]
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(parts), pa.string()), pa.array(range(len(parts)), pa.int64()), pa.array(parts, pa.binary())], names=["file", "block", "tokens"])

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(run, "file string, block long, tokens binary")


def scan_blocks(blocks: DataFrame, separator: int = END_OF_DOCUMENT) -> DataFrame:
    """(file, block, tokens, ends, tail, at): what the search finds in each block.

    ``tokens`` counts all ids, separators too; ``at`` holds the places of the ``ends`` separators;
    ``tail`` counts the tokens behind the last (all, if there is none).
    """
    file_type = dict(blocks.dtypes)["file"]

    def run(batches):
        for b in batches:
            sizes, places = [], []
            for data in b.column(2).to_pylist():
                flat = np.frombuffer(data, dtype="<u2")
                sizes.append(len(flat))
                places.append(np.flatnonzero(flat == separator))
            yield pa.RecordBatch.from_arrays(
                [
                    b.column(0), b.column(1), pa.array(sizes, pa.int64()), pa.array([len(x) for x in places], pa.int64()),
                    pa.array([n - int(x[-1]) - 1 if len(x) else n for n, x in zip(sizes, places, strict=True)], pa.int64()),
                    pa.array(places, pa.list_(pa.int64())),
                ],
                names=["file", "block", "tokens", "ends", "tail", "at"],
            )

    return blocks.select("file", "block", "tokens").mapInArrow(run, f"file {file_type}, block long, tokens long, ends long, tail long, at array<bigint>")


def _prefixed(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """``rows`` with what came before each in its key: documents ended, tokens, and tokens left open."""
    before = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    # Open tokens: all so far less those up to the last separator.
    closed = F.when(F.col("ends") > 0, F.col("_total") + F.col("tokens") - F.col("tail"))
    return (
        rows.withColumn("_ended", F.coalesce(F.sum("ends").over(before), F.lit(0)))
        .withColumn("_total", F.coalesce(F.sum("tokens").over(before), F.lit(0)))
        .withColumn("_closed", closed)
        .withColumn("_open_from", F.last("_closed", ignorenulls=True).over(before))
        .drop("_closed")
    )


def document_lengths(scanned: DataFrame) -> DataFrame:
    """(file, doc_index, start, n_tokens) of every document that ends in a file, stitched across blocks.

    Tokens behind a file's last separator are no document.
    """
    scanned = scanned.withColumn("chunk", F.floor(F.col("block") / CHUNK_BLOCKS))
    within = _prefixed(scanned, ["file", "chunk"], "block")
    sums = scanned.groupBy("file", "chunk").agg(
        F.sum("ends").alias("ends"), F.sum("tokens").alias("tokens"), F.max_by("block", F.when(F.col("ends") > 0, F.col("block"))).alias("_last"),
        F.max_by("tail", F.when(F.col("ends") > 0, F.col("block"))).alias("_tail"),
    )
    after = scanned.select("file", "chunk", "block", "tokens").join(sums.select("file", "chunk", "_last"), ["file", "chunk"]).where(F.col("block") > F.col("_last")).groupBy("file", "chunk").agg(F.sum("tokens").alias("_after"))
    sums = sums.join(after, ["file", "chunk"], "left").withColumn("tail", F.coalesce("_tail", "tokens") + F.coalesce("_after", F.lit(0)))
    across = _prefixed(sums.select("file", "chunk", "ends", "tokens", "tail"), ["file"], "chunk").select(
        "file", "chunk", F.col("_ended").alias("e"), F.col("_total").alias("t"), F.coalesce("_open_from", F.lit(0)).alias("o")
    )
    placed = within.join(across, ["file", "chunk"]).where("ends > 0").select(
        "file", "at",
        (F.col("_ended") + F.col("e")).alias("first"),
        (F.col("_total") + F.col("t")).alias("begin"),
        F.coalesce(F.col("_open_from") + F.col("t"), F.col("o")).alias("opened"),
    )
    # The first document of a block began behind the last separator before it, the others behind the one before theirs.
    starts = F.expr("concat(array(opened), transform(slice(at, 1, size(at) - 1), x -> begin + x + 1))")
    each = placed.select("file", "first", "begin", F.posexplode(F.arrays_zip(starts.alias("start"), F.col("at").alias("end"))).alias("k", "d"))
    return each.select("file", (F.col("first") + F.col("k")).alias("doc_index"), F.col("d.start").alias("start"), (F.col("begin") + F.col("d.end") - F.col("d.start")).alias("n_tokens"))


def token_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """(id, file, doc_index, start, n_tokens) for every row of ``docs``, by writing and scanning token files."""
    blocks = staged(write_token_blocks(docs, id_col, text_col, vocabulary), "token-blocks")
    counted = document_lengths(staged(scan_blocks(blocks), "scanned"))
    before = Window.partitionBy("file", "chunk").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    sidecar = blocks.select("file", "block", F.floor(F.col("block") / CHUNK_BLOCKS).alias("chunk"), "ids")
    chunks = sidecar.groupBy("file", "chunk").agg(F.sum(F.size("ids")).alias("n"))
    offsets = chunks.withColumn("e", F.coalesce(F.sum("n").over(Window.partitionBy("file").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    named = (
        sidecar.withColumn("first", F.coalesce(F.sum(F.size("ids")).over(before), F.lit(0)))
        .join(offsets.select("file", "chunk", "e"), ["file", "chunk"])
        .select("file", (F.col("first") + F.col("e")).alias("first"), F.posexplode("ids").alias("k", "id"))
        .select("file", (F.col("first") + F.col("k")).alias("doc_index"), "id")
    )
    return counted.join(named, ["file", "doc_index"]).select("id", "file", "doc_index", "start", "n_tokens")
