"""Best-fit packing of documents into token sequences, in bulk-synchronous rounds.

Documents are encoded, closed by an end id and cut into pieces of at most ``capacity`` tokens. Full
pieces are sequences of their own. The others are placed by best fit, large before small: in a round,
pieces and the sequences' gaps are dealt to tasks by ranges of size, and each task sweeps its range
from large to small. A piece takes its successor, the smallest gap passed that nothing has taken yet;
pieces that would share a gap are told apart by their rank in the sweep. What a task leaves open - pieces without a
gap in its range, gaps without a piece - is matched between tasks from two counts a task, and then gap by
gap in a join on ranks. Gaps shrink by what they took, and the rounds go on until no piece fits.
Only then new sequences are opened, as many as the remaining pieces need at least.

Null and empty texts are the end id alone. Repeated rows and ids, and null ids, are documents each;
equal sizes, also very many, are split over tasks by the pieces' keys. Texts are encoded whole, however long. An empty
table gives an empty result. Other columns of the table are not read.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import partitions, slices, staged
from .token_files import VOCABULARY, _encoding, ship_vocabulary

CAPACITY = 1024
END = 2
#: The vocabulary's text for its one special token, whose id follows the ranks.
SPECIAL = "<|endoftext|>"
#: Pieces over capacity / 2 are placed first, then those over capacity / 3, and so on.
CLASSES = (2, 3, 4, 8)
#: Pieces and gaps that one task sweeps, about.
SWEEP_ROWS = 200_000


def encoder(path: str):
    """A function from a text to its ids (numpy), special tokens in the text being what they are to the vocabulary."""
    encoding, special = _encoding(path), _encoding(path).n_vocab

    def encode(text: str) -> np.ndarray:
        if SPECIAL not in text:
            return np.array(encoding.encode_ordinary(text), dtype=np.uint32)
        ids: list[int] = []
        for k, part in enumerate(text.split(SPECIAL)):
            ids += [special] * bool(k) + encoding.encode_ordinary(part)
        return np.array(ids, dtype=np.uint32)

    return encode


def cut_pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end: int = END, vocabulary: str = VOCABULARY, keep_ids: bool = True) -> DataFrame:
    """(key, id, piece, start, length, ids_crc32, ids): the pieces of every document, the first being the shorter one.

    ``key`` names a piece within one evaluation: write the result before it is used twice. ``ids`` is left out on demand.
    """
    name = ship_vocabulary(docs.sparkSession, vocabulary)
    id_type = dict(docs.dtypes)[id_col]
    columns = f"key long, id {id_type}, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * keep_ids

    def run(batches):
        from pyspark import TaskContext

        encode, key = encoder(SparkFiles.get(name)), TaskContext.get().partitionId() << 33
        close = np.array([end], dtype=np.uint32)
        for b in batches:
            for first in range(0, b.num_rows, 256):
                part = b.slice(first, 256)
                rows: list[list] = [[] for _ in range(6 + keep_ids)]
                for at, text in enumerate(slices(part.column(1))):
                    ids = np.concatenate([encode(text or ""), close]).astype("<u4")
                    start, length = 0, (len(ids) - 1) % capacity + 1
                    for piece in range(-(-len(ids) // capacity)):
                        cut = ids[start : start + length]
                        values = (key, at, piece, start, length, zlib.crc32(cut.tobytes())) + (cut.astype(np.int32),) * keep_ids
                        for column, value in zip(rows, values, strict=True):
                            column.append(value)
                        key, start, length = key + 1, start + length, capacity
                kinds = [pa.int64(), None, pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32())]
                arrays = [part.column(0).take(pa.array(c, pa.int64())) if t is None else pa.array(c, t) for c, t in zip(rows, kinds, strict=False)]
                yield pa.RecordBatch.from_arrays(arrays, names=["key", "id", "piece", "start", "length", "ids_crc32", "ids"][: len(arrays)])

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, columns)


def sweep(is_piece: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Match pieces with gaps over rows that fall in size, a gap before the pieces of its size.

    Each piece takes the last gap before it that is still open. Returns the places of matched gaps and,
    in the same order, of their pieces, then those of the pieces and gaps left.
    """
    depth = np.cumsum(np.where(is_piece, -1, 1))
    low = np.minimum.accumulate(np.minimum(depth, 0))
    lost = is_piece & (low < np.r_[0, low[:-1]])
    kept = np.flatnonzero(~lost)
    # A piece closes the gap that stands last before it at its own depth.
    level = np.cumsum(np.where(is_piece[kept], -1, 1)) + is_piece[kept]
    order = kept[np.argsort(level, kind="stable")]
    level = np.sort(level)
    pair = np.flatnonzero(~is_piece[order[:-1]] & is_piece[order[1:]] & (level[:-1] == level[1:]))
    open_gap = ~is_piece
    open_gap[order[pair]] = False
    return order[pair], order[pair + 1], np.flatnonzero(lost), np.flatnonzero(open_gap)


def _swept(events: DataFrame, tasks: int) -> DataFrame:
    """(part, kind, rank, key, size, seq): matched pieces (kind 1) have ``seq``; pieces and slots of gaps (0) left have their rank in the task, else -1.

    A task sums itself up: how many pieces of each size it leaves (kind 2, as rank), and (3) how many slots it leaves, as rank, pieces it matched, as key,
    and gaps it has, as size. Its gaps come back less what they took (4: key, size).
    """

    def run(batches):
        from pyspark import TaskContext

        rows = pa.Table.from_batches(list(batches)) if (batches := [b for b in batches if b.num_rows]) else None
        if rows is None:
            return
        slots, kind, key, size, free = (rows.column(c).to_numpy() for c in ("slots", "kind", "key", "size", "free"))
        row = np.repeat(np.arange(len(slots)), slots)
        gap, piece, lost, left = sweep(kind[row] == 1)
        out = np.concatenate([piece, lost, left])
        rank = np.concatenate([np.full(len(piece), -1), np.arange(len(lost)), np.arange(len(left))])
        seq = np.concatenate([key[row][gap], np.zeros(len(lost) + len(left), np.int64)])
        rest = free - np.bincount(row[gap], weights=size[row][piece], minlength=len(slots)).astype(np.int64)
        kept = np.flatnonzero((kind == 0) & (rest > 0))
        sizes, counts = np.unique(size[row][lost], return_counts=True)
        none, whole = np.zeros(len(sizes), np.int64), np.zeros(len(kept), np.int64)
        parts = [
            (kind[row][out], rank, key[row][out], size[row][out], seq, np.arange(len(out)) < len(piece)),
            (none + 2, counts, none, sizes, none, none > 0),
            (np.array([3]), np.array([len(left)]), np.array([len(piece)]), np.array([len(kept)]), np.array([0]), np.array([False])),
            (whole + 4, whole - 1, key[kept], rest[kept], whole, whole > 0),
        ]
        kinds, ranks, keys, lengths, seqs, known = (np.concatenate(c) for c in zip(*parts, strict=True))
        part = np.full(len(kinds), TaskContext.get().partitionId(), np.int32)
        arrays = [pa.array(part), pa.array(kinds.astype(np.int32)), pa.array(ranks.astype(np.int64)), pa.array(keys.astype(np.int64)), pa.array(lengths.astype(np.int64)), pa.array(seqs.astype(np.int64), mask=~known)]
        yield from pa.Table.from_arrays(arrays, names=["part", "kind", "rank", "key", "size", "seq"]).to_batches(1 << 16)

    order = [F.col("size").desc(), "kind", "key"]
    # What one task can sweep needs no dealing.
    dealt = events.coalesce(1) if tasks == 1 else events.repartitionByRange(tasks, *order)
    return dealt.sortWithinPartitions(*order).select("kind", "key", "size", "slots", "free").mapInArrow(run, "part int, kind int, rank long, key long, size long, seq long")


def between_tasks(counts: list[tuple[int, int, int]]) -> list[tuple[int, int, int, int, int]]:
    """(part, first, last, gap_part, total): a task's pieces of these ranks take the gaps of rank total - rank in gap_part.

    ``counts`` has (part, pieces left, gaps left) of each task, by falling size; the last gap left is taken first.
    """
    stack: list[list[int]] = []
    found = []
    for part, pieces, gaps in sorted(counts):
        rank = 0
        while rank < pieces and stack:
            gap_part, count = stack[-1]
            taken = min(pieces - rank, count)
            found.append((part, rank, rank + taken - 1, gap_part, rank + count - 1))
            rank += taken
            stack[-1][1] -= taken
            if not stack[-1][1]:
                stack.pop()
        if gaps:
            stack.append([part, gaps])
    return found


def still_left(left_in: dict[int, dict[int, int]], ranges: list[tuple[int, int, int, int, int]]) -> dict[int, int]:
    """How many pieces of each size are left when those in ``ranges`` are placed; a task's pieces rank by falling size."""
    placed: dict[int, int] = {}
    for part, first, last, _, _ in ranges:
        placed[part] = placed.get(part, 0) + last - first + 1
    total: dict[int, int] = {}
    for part, sizes in left_in.items():
        for size, n in sorted(sizes.items(), reverse=True):
            gone = min(n, placed.get(part, 0))
            placed[part] = placed.get(part, 0) - gone
            if n > gone:
                total[size] = total.get(size, 0) + n - gone
    return total


def least_sequences(sizes: dict[int, int], capacity: int) -> int:
    """No packing of so many pieces of these sizes uses fewer sequences: by tokens, and by pieces too large for more to share."""
    bound = -(-sum(size * n for size, n in sizes.items()) // capacity)
    for k in range(1, capacity // min(sizes) + 1):
        bound = max(bound, -(-sum(n for size, n in sizes.items() if size > capacity // (k + 1)) // k))
    return bound


def place(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """(key, seq, offset) for every row of ``pieces`` (key, length), lengths from 1 to ``capacity``; keys differ.

    Sequences have no holes. A histogram of lengths (``capacity`` rows) and, each round, counts for each task and each size in it are all that the driver sees.
    """
    spark = pieces.sparkSession
    items = pieces.select("key", F.col("length").cast("long").alias("size"))
    sizes = {r["size"]: r["count"] for r in items.where(F.col("size") < capacity).groupBy("size").count().collect()}
    gaps = spark.createDataFrame([], "seq long, free long")
    n_gaps, opened, done = 0, 0, []
    bounds = [capacity - 1, *(capacity // k for k in CLASSES), 0]
    for upper, lower in zip(bounds, bounds[1:], strict=False):
        left = {s: n for s, n in sizes.items() if lower < s <= upper}
        rest = items.where(F.col("size").between(lower + 1, upper))
        # Gaps under the smallest piece to come are done.
        least = min([*left, *(s for s in sizes if s <= lower)], default=capacity)
        while left:
            largest = max(left)
            slots = F.greatest(F.lit(1), F.floor(F.col("free") / largest)).cast("long")
            events = rest.select("size", F.lit(1).alias("kind"), "key", F.lit(1).cast("long").alias("slots"), F.lit(0).cast("long").alias("free")).unionByName(
                gaps.where(F.col("free") >= least).select(F.floor(F.col("free") / slots).alias("size"), F.lit(0).alias("kind"), F.col("seq").alias("key"), slots.alias("slots"), "free")
            )
            swept, matched = None, 0
            if n_gaps:
                swept = staged(_swept(events, max(1, min(partitions(spark), -(-(sum(left.values()) + n_gaps) // SWEEP_ROWS)))), "swept")
                left_in, ended, n_left = {}, [], 0
                # A row a task, and one for each size in it: tasks hold ranges of sizes.
                for r in swept.where("kind in (2, 3)").select("part", "kind", "rank", "key", "size").collect():
                    if r["kind"] == 2:
                        left_in.setdefault(r["part"], {})[r["size"]] = r["rank"]
                    else:
                        ended.append((r["part"], r["rank"]))
                        matched += r["key"]
                        n_left += r["size"]
                ranges = between_tasks([(part, sum(left_in.get(part, {}).values()), n_open) for part, n_open in ended])
                matched += sum(last - first + 1 for _, first, last, _, _ in ranges)
            if not matched:
                more = least_sequences(left, capacity)
                gaps = gaps.unionByName(spark.range(opened, opened + more).select(F.col("id").alias("seq"), F.lit(capacity).cast("long").alias("free")))
                opened, n_gaps = opened + more, n_gaps + more
                continue
            tried = swept.where("kind = 1").select("key", "size", "seq")
            gaps, n_gaps = swept.where("kind = 4").select(F.col("key").alias("seq"), F.col("size").alias("free")), n_left
            if ranges:
                between = staged(_stitched(swept, ranges), "between")
                tried = swept.where("kind = 1 and rank < 0").select("key", "size", "seq").unionByName(between)
                took = between.where("seq is not null").select("seq", (-F.col("size")).alias("free"))
                gaps = staged(gaps.unionByName(took).groupBy("seq").agg(F.sum("free").alias("free")).where("free > 0"), "gaps")
            done.append(tried.where("seq is not null"))
            rest = tried.where("seq is null").select("key", "size")
            left = still_left(left_in, ranges)
    full = items.where(F.col("size") == capacity).select("key", (-1 - F.col("key")).alias("seq"), F.lit(0).cast("long").alias("offset"))
    if not done:
        return full
    placed = done[0]
    for taken in done[1:]:
        placed = placed.unionByName(taken)
    before = Window.partitionBy("seq").orderBy("key").rowsBetween(Window.unboundedPreceding, -1)
    return full.unionByName(placed.select("key", "seq", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("offset")))


def _stitched(swept: DataFrame, ranges: list[tuple[int, int, int, int, int]]) -> DataFrame:
    """(key, size, seq) of the pieces that ``swept`` left; those matched between tasks have ``seq``."""
    spark = swept.sparkSession
    # Fewer than two ranges for each task.
    table = F.broadcast(spark.createDataFrame(ranges, "part int, first long, last long, gap_part int, total long"))
    pieces = swept.where("kind = 1 and rank >= 0").join(table, "part").where(F.col("rank").between(F.col("first"), F.col("last")))
    gaps = swept.where("kind = 0").select(F.col("part").alias("gap_part"), F.col("rank").alias("gap_rank"), F.col("key").alias("seq"))
    met = pieces.select("key", "size", "gap_part", (F.col("total") - F.col("rank")).alias("gap_rank")).join(gaps, ["gap_part", "gap_rank"]).select("key", "size", "seq")
    # A task's ranges follow one another from rank 0.
    covered = F.broadcast(table.groupBy("part").agg(F.max("last").alias("covered")))
    alone = swept.where("kind = 1 and rank >= 0").join(covered, "part", "left").where("covered is null or rank > covered")
    return met.unionByName(alone.select("key", "size", "seq"))


def pack_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end: int = END, vocabulary: str = VOCABULARY, keep_ids: bool = True) -> DataFrame:
    """(id, piece, start, length, ids_crc32, ids, sequence_id, offset): every piece and its place."""
    pieces = staged(cut_pieces(docs, id_col, text_col, capacity, end, vocabulary, keep_ids), "pieces")
    placed = place(pieces, capacity).withColumnRenamed("seq", "sequence_id")
    return pieces.join(placed, "key").drop("key")


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, ids, starts): the packed sequences, with the offsets at which their pieces begin."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(parts.alias("parts")).select("sequence_id", F.flatten("parts.ids").alias("ids"), F.col("parts.offset").alias("starts"))
