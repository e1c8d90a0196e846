"""SimHash near-duplicate classes by deletion-variant signatures.

A 64-bit fingerprint is cut into as few segments as leave one with at most one differing bit: for
two bits in all, two halves. Each half is indexed under its 32 one-wildcard variants (one bit left
out), so two fingerprints that belong together meet under an equal key; the pair is then verified
on all 64 bits. Equal fingerprints are one class from the start, so copies are never paired.
"""

from __future__ import annotations

from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import byte_texts, connected_components, local_components, partitions, runs_of_key, staged

#: Runs of one key up to this many fingerprints are compared pair by pair; longer ones by probing.
PAIRWISE = 48
SEED = 42


def text_fingerprint(text: bytes, words_per_shingle: int = 3) -> int:
    """SimHash of a text: majority of the bits of its shingles' XXH64, zero without words."""
    words = text.lower().split()
    if not words:
        return 0
    if len(words) < words_per_shingle:
        shingles = [b" ".join(words)]
    else:
        shingles = list(map(b" ".join, zip(*(words[k:] for k in range(words_per_shingle)), strict=False)))
    h = np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(SEED)), dtype="<u8", count=len(shingles))
    return _majority(h)


def _majority(h: np.ndarray) -> int:
    counts = np.zeros(64, dtype=np.int64)
    for k in range(0, len(h), 1 << 16):
        bits = np.unpackbits(h[k : k + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int32)
    return int(np.packbits(counts * 2 > len(h), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words_per_shingle: int = 3) -> DataFrame:
    """(id, fp): the fingerprint of every whole text as a signed 64-bit number; null text counts as empty."""

    def run(batches):
        for b in batches:
            fp = [text_fingerprint(t, words_per_shingle) for t in byte_texts(b.column(1))]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(np.array(fp, dtype=np.uint64).view(np.int64))], names=["id", "fp"]
            )

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "id long, fp long")


def _flip_masks(half: int, bit: int) -> np.ndarray:
    """XOR masks of the links that key (half, bit) answers for.

    A pair whose segment differs in the left-out bit belongs to that bit's key; one whose segment is
    equal belongs to the key of bit 0. So each link is found once for each half that qualifies.
    """
    other = [1 << (32 * (1 - half) + k) for k in range(32)]
    own = 1 << (32 * half + bit)
    masks = [own, *(own | x for x in other)]
    if bit == 0:
        masks += other + [x | y for k, x in enumerate(other) for y in other[:k]]
    return np.array(masks, dtype=np.uint64)


def _links_of_run(key: int, fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Star links among the distinct fingerprints of one long run: each probes its possible neighbours.

    The work grows with the length of the run, not with its square.
    """
    fp = np.unique(fp)
    us, vs = [], []
    for mask in _flip_masks((key >> 37) & 1, (key >> 32) & 31):
        want = fp ^ mask
        at = np.minimum(np.searchsorted(fp, want), len(fp) - 1)
        hit = np.flatnonzero((fp[at] == want) & (at > np.arange(len(fp))))
        us.append(hit)
        vs.append(at[hit])
    root = local_components(len(fp), np.concatenate(us), np.concatenate(vs))
    moved = np.flatnonzero(root != np.arange(len(fp)))
    return fp[root[moved]], fp[moved]


def _links(keys: np.ndarray, fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    sizes = np.diff(np.r_[starts, len(keys)])
    out_u, out_v = [], []
    for s, n in zip(starts[sizes > PAIRWISE], sizes[sizes > PAIRWISE], strict=True):
        u, v = _links_of_run(int(keys[s]), fp[s : s + n])
        out_u.append(u)
        out_v.append(v)
    short = np.repeat((sizes > 1) & (sizes <= PAIRWISE), sizes)
    keys, fp = keys[short], fp[short]
    for shift in range(1, PAIRWISE):
        same = np.flatnonzero(keys[shift:] == keys[:-shift]) if shift < len(keys) else ()
        if not len(same):
            break
        u, v, k = fp[same], fp[same + shift], keys[same]
        x = u ^ v
        half = ((k >> 37) & 1).astype(np.uint64)
        bit = ((k >> 32) & 31).astype(np.uint64)
        seg = (x >> (half * np.uint64(32))) & np.uint64(0xFFFFFFFF)
        ok = (np.bitwise_count(x) <= 2) & ((seg != 0) | (bit == 0))
        out_u.append(u[ok])
        out_v.append(v[ok])
    empty = np.zeros(0, dtype=np.uint64)
    return np.concatenate([empty, *out_u]), np.concatenate([empty, *out_v])


def near_links(distinct_fps: DataFrame) -> DataFrame:
    """(a, b): links between fingerprints at two or fewer differing bits, enough to join up every class.

    Sent to a task by its key, a fingerprint meets only those that agree with it in 31 bits of a half.
    """
    spark = distinct_fps.sparkSession

    def run(batches):
        for t in runs_of_key(batches, "key"):
            u, v = _links(t.column("key").to_numpy(), t.column("fp").to_numpy().view(np.uint64))
            if len(u):
                yield pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(v.view(np.int64))], names=["a", "b"])

    variants = F.expr(
        """flatten(transform(sequence(0, 1), s -> transform(sequence(0, 31), i ->
             shiftleft(cast(s * 32 + i as bigint), 32)
             | (shiftrightunsigned(fp, s * 32) & 4294967295L & ~shiftleft(1L, i)))))"""
    )
    return (
        distinct_fps.select("fp", F.explode(variants).alias("key"))
        .repartition(partitions(spark), "key")
        .sortWithinPartitions("key")
        .mapInArrow(run, "a long, b long")
    )


def near_duplicate_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp, component_id) for every row of ``docs``.

    ``component_id`` is the smallest id reachable over links of two or fewer differing bits, the
    row's own id included. Texts without a word, null ones too, have fingerprint zero and link like
    any other. Rows with a null id get their class's smallest id and lend none. Repeated rows stay.
    Other columns of ``docs`` are not read. An empty table gives an empty result.
    """
    marked = staged(fingerprints(docs, id_col, text_col), "fingerprints")
    classes = marked.groupBy("fp").agg(F.min("id").alias("low"))
    classes = staged(classes, "fingerprint-classes")
    comps = staged(connected_components(near_links(classes.select("fp"))), "components")
    rooted = classes.join(comps.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    low = rooted.groupBy("root").agg(F.min("low").alias("component_id"))
    by_fp = rooted.select("fp", "root").join(low, "root").select("fp", "component_id")
    return marked.join(by_fp, "fp").select("id", "fp", "component_id")


def keep_one_per_class(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", classes_of=near_duplicate_classes) -> DataFrame:
    """``docs`` without near-duplicates: of each class of ``classes_of`` the rows with the smallest id stay.

    Of rows that repeat an id and its text one stays; rows that share an id but are of different
    classes are judged each by its own. Rows with a null id cannot
    be told apart and all stay.
    """
    mark = F.xxhash64(F.col(text_col).cast("string"))
    named = docs.where(F.col(id_col).isNotNull())
    repeated = named.groupBy(F.col(id_col).cast("long").alias("id")).count().where("count > 1").select("id")
    if repeated.limit(1).count():
        # Every different row gets a number of its own in the order of ids, and its class by that.
        packed = named.select(F.struct(*[F.col(c) for c in docs.columns]).alias("row"), F.struct(F.col(id_col).cast("long").alias("id"), mark.alias("mark")).alias("name"), F.col(text_col).alias("text"))
        names = packed.select("name.id", "name.mark").distinct().orderBy("id", "mark")
        numbered = staged(names.rdd.zipWithIndex().map(lambda x: (x[0][0], x[0][1], x[1])).toDF("id long, mark long, number long"), "row-names")
        numbered = numbered.select(F.struct("id", "mark").alias("name"), "number")
        once = packed.join(numbered, "name").dropDuplicates(["number"])
        classes = classes_of(once.select("number", "text"), "number", "text")
        first = classes.where("id = component_id").select(F.col("id").alias("number"))
        kept = once.join(first, "number", "left_semi").select("row.*")
    else:
        classes = classes_of(named, id_col, text_col)
        first = classes.where("id = component_id").select("id").distinct()
        kept = named.join(first, named[id_col].cast("long") == first["id"], "left_semi")
    return kept.unionByName(docs.where(F.col(id_col).isNull())).select(docs.columns)


def fingerprint_hex(fp: str = "fp") -> F.Column:
    """16 lower-case hexadecimal digits."""
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
