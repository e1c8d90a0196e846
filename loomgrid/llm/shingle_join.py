"""Classes of texts whose word shingles have a Jaccard similarity of 0.8 or more, exactly.

No number of differing SimHash bits bounds this similarity, so candidates come from a prefix filter:
with all shingles in one order, two sets that are alike share a shingle among the first
``n - ceil(0.8 n) + 1`` of each. Any order finds all pairs; here shingles that a sample shows to be
frequent come last, which keeps the runs of one shingle short. Every candidate is verified on the
whole sets. Sets are named by 64-bit hashes, as shingles are.

Sets that share only a passage also share shingles, so a candidate must hold against both sets' sketches
as well: a sketch counts the shingles in buckets of the hash, and the counts of two sets differ by no more
in all than the sets do. No similar pair is lost by it.

Candidates join up to families. A family's sets are compared through an inverted index in one task,
or, where they take more than BLOCK_BYTES, in one task for each two of its blocks. Sets are computed
again where they are needed, as they are as large as the texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import simhash
from .common import byte_texts, connected_components, partitions, runs_of_key, staged

WORDS = 5
#: The least similarity, as a fraction.
ABOVE, BELOW = 4, 5
SEED = 42
#: One in so many sets tells which shingles are frequent, and at most so many are moved back. Neither changes a result.
SAMPLED, MOVED = 16, 500_000
#: Rows of an Arrow batch that are worked on at once.
SLICE_ROWS = 128
#: Places of the inverted index that are read at once.
POSTINGS = 200_000
#: A sketch has at least one bucket for 4 shingles and at most one for 2; those of larger sets stay at the most.
BUCKETS_FROM, BUCKETS_TO = 16, 2048
#: Bytes of a family's sets in one block; any two blocks meet in one task.
BLOCK_BYTES = 16 << 20


def shingle_set(text: bytes, words_per_shingle: int = WORDS) -> np.ndarray:
    """The different shingles' XXH64, ascending; a text of fewer words is one shingle, none without words."""
    words = text.lower().split()
    if len(words) < words_per_shingle:
        shingles = [b" ".join(words)] if words else []
    else:
        shingles = list(map(b" ".join, zip(*(words[k:] for k in range(words_per_shingle)), strict=False)))
    return np.unique(np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(SEED)), dtype="<u8", count=len(shingles)))


def _alike(common: np.ndarray | int, sizes: np.ndarray | int) -> np.ndarray | bool:
    """Whether sets of so many shingles together, so many of them common, are similar."""
    return common * (ABOVE + BELOW) >= sizes * ABOVE


def _sets_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, np.ndarray, list[np.ndarray | None]]]:
    """(ids, fps, sets) of some rows at a time; a set is None where the task has given the same before."""
    given: set[int] = set()
    for b in batches:
        for start in range(0, b.num_rows, SLICE_ROWS):
            part = b.slice(start, SLICE_ROWS)
            fps, sets = [], []
            for t in byte_texts(part.column(1)):
                h = shingle_set(t)
                fp = xxhash.xxh3_64_intdigest(h.tobytes())
                fps.append(fp)
                sets.append(None if fp in given else h)
                given.add(fp)
            yield part.column(0), np.array(fps, dtype=np.uint64).view(np.int64), sets


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))


def sketch(h: np.ndarray) -> bytes:
    """How many shingles fall in each bucket, modulo 16, two counts a byte; the buckets are a power of two."""
    k = min(max(1 << max(len(h) // 2, 1).bit_length() - 1, BUCKETS_FROM), BUCKETS_TO)
    counts = np.bincount((h & np.uint64(k - 1)).astype(np.int64), minlength=k).astype(np.uint8) & 15
    return (counts[::2] | counts[1::2] << 4).tobytes()


def _counts(packed: np.ndarray) -> np.ndarray:
    """The buckets' counts of sketches, one for each row."""
    return np.stack([packed & 15, packed >> 4], axis=-1).reshape(len(packed), -1)


def _names(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, fp, size, sketch) of every row; ``fp`` names its set, of which a task gives size and sketch once."""

    def run(batches):
        for ids, fps, sets in _sets_of(batches):
            sizes = pa.array([None if h is None else len(h) for h in sets], pa.int32())
            sketches = pa.array([None if h is None else sketch(h) for h in sets], pa.binary())
            yield pa.RecordBatch.from_arrays([ids, pa.array(fps), sizes, sketches], names=["id", "fp", "size", "sketch"])

    return _rows(docs, id_col, text_col).mapInArrow(run, "id long, fp long, size int, sketch binary")


def _sets(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(fp, shingles): each different set of a task."""

    def run(batches):
        for _, fps, sets in _sets_of(batches):
            new = [k for k, h in enumerate(sets) if h is not None]
            yield pa.RecordBatch.from_arrays([pa.array(fps[new]), pa.array([sets[k].tobytes() for k in new], pa.binary())], names=["fp", "shingles"])

    return _rows(docs, id_col, text_col).mapInArrow(run, "fp long, shingles binary")


def _arrays(column: pa.ChunkedArray) -> list[np.ndarray]:
    """The sets of a binary column, as views of its memory."""
    out = []
    for chunk in column.chunks:
        _, offsets, data = chunk.buffers()
        bounds = np.frombuffer(offsets, dtype=np.int32)[chunk.offset : chunk.offset + len(chunk) + 1].tolist()
        whole = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
        out.extend(whole[x:y].view("<u8") for x, y in zip(bounds[:-1], bounds[1:], strict=True))
    return out


def _frequent(docs: DataFrame, id_col: str, text_col: str) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that the sets of a sample hold more than twice, ascending, and how often."""

    def run(batches):
        for _, _, sets in _sets_of(batches):
            h, n = np.unique(np.concatenate([np.zeros(0, dtype="<u8"), *(x for x in sets if x is not None)]), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n.astype(np.int64))], names=["h", "n"])

    sample = docs.where(F.pmod(F.xxhash64(F.col(text_col).cast("string")), F.lit(SAMPLED)) == 0)
    counted = _rows(sample, id_col, text_col).mapInArrow(run, "h long, n long")
    found = counted.groupBy("h").agg(F.sum("n").alias("n")).where("n > 2").orderBy(F.desc("n"), "h").limit(MOVED).toArrow()
    h = found.column("h").to_numpy().view(np.uint64)
    order = np.argsort(h)
    return h[order], found.column("n").to_numpy()[order]


def _prefixes(docs: DataFrame, id_col: str, text_col: str, frequent: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """(key, fp, n, at): the first shingles of every set, its size and the place in its order."""
    shared = docs.sparkSession.sparkContext.broadcast(frequent)

    def run(batches):
        hot, often = shared.value
        for _, fps, sets in _sets_of(batches):
            keys, sizes, places, owners = [np.zeros(0, dtype=np.uint64)], [], [], []
            for fp, h in zip(fps.tolist(), sets, strict=True):
                if h is None:
                    continue
                n = len(h)
                p = n - (ABOVE * n + BELOW - 1) // BELOW + 1 if n else 0
                if len(hot) and n:
                    at = np.minimum(np.searchsorted(hot, h), len(hot) - 1)
                    h = h[np.argsort(np.where(hot[at] == h, often[at], 0), kind="stable")]
                keys.append(h[:p])
                sizes.append(n)
                places.append(p)
                owners.append(fp)
            n, p = np.array(sizes, dtype=np.int32), np.array(places, dtype=np.int64)
            at = np.arange(p.sum()) - np.repeat(np.cumsum(p) - p, p)
            columns = [np.concatenate(keys).view(np.int64), np.repeat(np.array(owners, dtype=np.int64), p), np.repeat(n, p), at.astype(np.int32)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["key", "fp", "n", "at"])

    return _rows(docs, id_col, text_col).mapInArrow(run, "key long, fp long, n int, at int")


def _possible(n: np.ndarray, at: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Whether i and j can be similar if this is their first common shingle."""
    small, large = np.minimum(n[i], n[j]), np.maximum(n[i], n[j])
    return (small * BELOW >= large * ABOVE) & _alike(np.minimum(n[i] - at[i], n[j] - at[j]), small + large)


def _join_up(label: np.ndarray, i: int, others: np.ndarray) -> None:
    """Put ``i`` and ``others`` in one class; a class is labelled by its first member."""
    joined = np.unique(np.append(label[others], label[i]))
    if len(joined) > 1:
        label[np.isin(label, joined)] = joined[0]


def _stars(label: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first member, member) of each class, for all but the first."""
    moved = np.flatnonzero(label != np.arange(len(label)))
    return label[moved], moved


def _differences(own: np.ndarray, others: np.ndarray) -> np.ndarray:
    """At most as many shingles as are in only one set, for counts against rows of the same or more buckets."""
    # A larger set's further buckets are folded onto those of the smaller.
    folded = others.reshape(len(others), -1, len(own)).sum(axis=1, dtype=np.uint8)
    d = (folded - own) & 15
    # Counts are known modulo 16, so a difference is at least the way to the nearer multiple.
    return np.minimum(d, 16 - d).sum(axis=1, dtype=np.int64)


class Sketches:
    """The sketches of a run's rows, which come by ascending size."""

    def __init__(self, rows: list[bytes]):
        width = np.array([len(r) for r in rows])
        self.starts = np.flatnonzero(np.r_[True, width[1:] != width[:-1]])
        self.levels = [
            _counts(np.frombuffer(b"".join(rows[s:e]), dtype=np.uint8).reshape(e - s, -1))
            for s, e in zip(self.starts, np.r_[self.starts[1:], len(rows)], strict=True)
        ]
        self.level = np.searchsorted(self.starts, np.arange(len(rows)), side="right") - 1

    def differences(self, i: int, j: np.ndarray) -> np.ndarray:
        """At most as many shingles as are in only one of the sets i and j, for each of the later rows j."""
        at = self.level[i]
        own = self.levels[at][i - self.starts[at]]
        out = np.empty(len(j), dtype=np.int64)
        for k in np.unique(self.level[j]):
            here = self.level[j] == k
            out[here] = _differences(own, self.levels[k][j[here] - self.starts[k]])
        return out


def run_links(n: np.ndarray, at: np.ndarray, sketches: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Links that join up one run's rows, which come by ascending size, wherever pairs of them are possible.

    Rows that are joined already are not looked at again, and no list of pairs is kept.
    """
    label = np.arange(len(n))
    stops = np.searchsorted(n, n * BELOW // ABOVE, side="right")
    counts = Sketches(sketches)
    for i in range(len(n) - 1):
        j = i + 1 + np.flatnonzero(label[i + 1 : stops[i]] != label[i])
        if len(j):
            j = j[_possible(n, at, i, j)]
        if len(j):
            both = n[i] + n[j]
            j = j[_alike(both - counts.differences(i, j), 2 * both)]
        if len(j):
            _join_up(label, i, j)
    return _stars(label)


def _partnered(rows: DataFrame) -> DataFrame:
    """The rows (key, fp, n, at) of sets that meet another one of a possible size under their key, each once."""

    def run(batches):
        for t in runs_of_key(batches, "key"):
            key, fp, n = (t.column(c).to_numpy() for c in ("key", "fp", "n"))
            new = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]) | (fp[1:] != fp[:-1])])
            key, n = key[new], n[new].astype(np.int64)
            near = (key[1:] == key[:-1]) & (n[:-1] * BELOW >= n[1:] * ABOVE)
            kept = new[np.r_[near, False] | np.r_[False, near]]
            if len(kept):
                yield from t.take(pa.array(kept)).combine_chunks().to_batches()

    dealt = rows.repartition(partitions(rows.sparkSession), "key").sortWithinPartitions("key", "n", "fp")
    return dealt.mapInArrow(run, "key long, fp long, n int, at int")


def _families(rows: DataFrame, sketches: DataFrame) -> DataFrame:
    """(a, b): links that join up all sets that some candidate pair connects."""

    def run(batches):
        for t in runs_of_key(batches, "key"):
            key, fp = t.column("key").to_numpy(), t.column("fp").to_numpy()
            n, at = (t.column(c).to_numpy().astype(np.int64) for c in ("n", "at"))
            starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
            ends = np.r_[starts[1:], len(key)]
            # Most runs are of two rows, which are looked at together as far as sizes and places go.
            two = starts[ends - starts == 2]
            two = two[_possible(n, at, two, two + 1)]
            alike = np.zeros(len(two), dtype=bool)
            for k, s in enumerate(two.tolist()):
                a, b = (_counts(np.frombuffer(x, dtype=np.uint8)[None]) for x in t.column("sketch").slice(s, 2).to_pylist())
                both = n[s] + n[s + 1]
                alike[k] = _alike(both - _differences(a[0], b)[0], 2 * both)
            us, vs = [fp[two[alike]]], [fp[two[alike] + 1]]
            for s, e in zip(starts[ends - starts > 2], ends[ends - starts > 2], strict=True):
                i, j = run_links(n[s:e], at[s:e], t.column("sketch").slice(s, e - s).to_pylist())
                us.append(fp[s + i])
                vs.append(fp[s + j])
            u, v = np.concatenate(us), np.concatenate(vs)
            if len(u):
                yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["a", "b"])

    met = _partnered(rows).join(sketches, "fp").select("key", "fp", "n", "at", "sketch")
    dealt = met.repartition(partitions(rows.sparkSession), "key").sortWithinPartitions("key", "n", "fp")
    return dealt.mapInArrow(run, "a long, b long")


def family_links(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(first, other) of each class of similar sets: each set against all later ones, unless all are of its class."""
    size = np.array([len(h) for h in sets])
    every = np.concatenate(sets)
    order = np.argsort(every, kind="stable")
    every = every[order]
    number = np.cumsum(np.r_[False, every[1:] != every[:-1]], dtype=np.int32) if len(every) else np.zeros(0, dtype=np.int32)
    del every
    token = np.empty(len(number), dtype=np.int32)
    token[order] = number
    df = np.bincount(number)
    # The sets that hold a token stand together, in order.
    posting = np.repeat(np.arange(len(sets), dtype=np.int32), size)[order]
    del order, number
    first, start = np.cumsum(df) - df, np.cumsum(size) - size
    label = np.arange(len(sets))
    for i in range(len(sets) - 1):
        if (label[i + 1 :] == label[i]).all():
            continue
        own = token[start[i] : start[i] + size[i]]
        length = df[own]
        upto = np.cumsum(length)
        common = np.zeros(len(sets), dtype=np.int64)
        at = 0
        while at < len(own):  # some postings at a time, as a token may stand in every set
            stop = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + POSTINGS, side="right")))
            n = length[at:stop]
            places = np.repeat(first[own[at:stop]] - np.cumsum(n) + n, n) + np.arange(n.sum())
            common += np.bincount(posting[places], minlength=len(sets))
            at = stop
        j = np.flatnonzero(_alike(common, size + size[i]))
        _join_up(label, i, j[j > i])
    return _stars(label)


def _blocks(families: DataFrame, sizes: DataFrame) -> DataFrame:
    """(fp, block, blocks, root): the block of its family that a set is in, by hash, and how many there are."""
    found = families.withColumnRenamed("node", "fp").join(sizes.select("fp", "size"), "fp")
    many = found.groupBy("root").agg(F.ceil(F.sum("size") * 8 / BLOCK_BYTES).cast("int").alias("blocks"))
    return found.join(many, "root").select("fp", F.pmod(F.xxhash64("fp"), F.greatest("blocks", F.lit(1))).cast("int").alias("block"), "blocks", "root")


def _links(sets: DataFrame, blocks: DataFrame) -> DataFrame:
    """(a, b): links that join up the similar ones of the sets (fp, shingles) of each family."""

    def run(batches):
        for t in runs_of_key(batches, "meeting"):
            meeting, fp = t.column("meeting").to_numpy(), t.column("fp").to_numpy()
            new = np.flatnonzero(np.r_[True, (fp[1:] != fp[:-1]) | (meeting[1:] != meeting[:-1])])
            meeting, fp = meeting[new], fp[new]
            sets = _arrays(t.column("shingles"))
            starts = np.flatnonzero(np.r_[True, meeting[1:] != meeting[:-1]])
            for s, e in zip(starts, np.r_[starts[1:], len(meeting)], strict=True):
                if e - s == 1:
                    continue
                # One meeting at a time, as its inverted index is the largest part of a task's memory.
                i, j = family_links([sets[k] for k in new[s:e].tolist()])
                if len(i):
                    yield pa.RecordBatch.from_arrays([pa.array(fp[s + i]), pa.array(fp[s + j])], names=["a", "b"])
            del t, sets
            pa.default_memory_pool().release_unused()

    other = F.expr("filter(sequence(0, greatest(blocks, 1) - 1), x -> x <> block or blocks <= 1)")
    met = sets.join(blocks, "fp").withColumn("other", F.explode(other))
    met = met.select(F.xxhash64("root", F.least("block", "other"), F.greatest("block", "other")).alias("meeting"), "fp", "shingles")
    dealt = met.repartition(partitions(sets.sparkSession), "meeting").sortWithinPartitions("meeting", "fp")
    return dealt.mapInArrow(run, "a long, b long")


def similar_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp, component_id) for every row of ``docs``; ``fp`` names its set of shingles.

    ``component_id`` is the smallest id reachable over links of similar sets. Texts without a word
    are one class. Null ids, repeated rows and empty tables are treated as in
    ``simhash.near_duplicate_classes``.
    """
    marked = staged(_names(docs, id_col, text_col), "shingle-sets")
    rows = _prefixes(docs, id_col, text_col, _frequent(docs, id_col, text_col))
    known = marked.where("sketch is not null").select("fp", "size", "sketch").dropDuplicates(["fp"])
    families = connected_components(_families(rows, known.select("fp", "sketch")))
    blocks = staged(_blocks(families, known), "families")
    links = _links(_sets(docs, id_col, text_col), blocks)
    roots = connected_components(links).withColumnRenamed("node", "fp")
    classes = marked.groupBy("fp").agg(F.min("id").alias("low")).join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    classes = staged(classes, "classes")
    low = classes.groupBy("root").agg(F.min("low").alias("component_id"))
    by_fp = classes.select("fp", "root").join(low, "root").select("fp", "component_id")
    return marked.join(by_fp, "fp").select("id", "fp", "component_id")


def near_copy_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp, component_id) of every row of ``docs``: classes by SimHash, joined up where their texts are similar.

    A link is two fingerprints at two or fewer differing bits (``simhash.near_duplicate_classes``), or
    two sets of shingles that are similar (``similar_classes``), which fingerprints that lie further
    apart don't show. ``fp`` is the fingerprint, ``component_id`` the smallest id reachable over links
    of both kinds. Ids name rows, so none may be null or repeated; an empty table gives an empty result.
    """
    marked = staged(simhash.near_duplicate_classes(docs, id_col, text_col), "simhash-classes")
    similar = similar_classes(docs, id_col, text_col).select("id", F.col("component_id").alias("similar_id"))
    # Classes are named by documents, so a document of two of them links their names.
    links = marked.join(similar, "id").where("component_id <> similar_id").select(F.col("component_id").alias("a"), F.col("similar_id").alias("b"))
    roots = connected_components(links).withColumnRenamed("node", "component_id")
    joined = marked.join(roots, "component_id", "left")
    return joined.select("id", "fp", F.coalesce("root", "component_id").alias("component_id"))
