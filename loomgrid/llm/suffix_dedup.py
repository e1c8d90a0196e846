"""Exact removal of repeated passages, by sorting suffixes of the texts that can repeat.

A string of ``WINDOW`` bytes that also starts earlier is removed wherever it recurs. Sorting every
suffix of the corpus would write it many times over, so only suffixes that can have a twin are
sorted:

1. Every window has one anchor, the smallest hash among its ``CORE``-byte strings. Equal windows
   have equal anchors at equal places, so a window whose anchor occurs nowhere else cannot repeat.
   The stretch of all windows that share an anchor is that anchor's context.
2. Anchors are dealt to buckets by their hash. Of equal contexts all but the first are removed
   there; anchors met in several different contexts are kept for sorting.
3. The contexts of those anchors are cut from the texts and dealt to shards. In a shard the suffixes
   are sorted by induction (``suffix_sort``), and neighbours are tested for a common prefix of
   ``WINDOW`` bytes; all but the first of each group are removed.
4. An anchor with very many different contexts (the rim of a passage that a third of all documents
   share) would fill one shard. Its windows are named singly instead and dealt by their own hash.

Each text's removed runs are then merged, and what is left is handed on.

Order of places: smaller id first, then earlier start. Rows that repeat an id and its text are one
document; rows that share an id but differ in text are different documents, ordered by a hash of
their texts. Rows with a null id stand before all others. Null texts count as empty. Texts shorter
than a window stay whole. Other columns are handed on, whatever their names; an empty table gives an
empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import byte_texts, partitions, staged
from .suffix_sort import same_prefix, suffix_array

WINDOW = 100
CORE = 32
#: Text bytes that a bucket of anchors stands for, and context bytes that a shard sorts at once.
BUCKET_BYTES = 8 << 20
SHARD_BYTES = 2 << 20
#: An anchor with more different contexts than this has its windows named singly.
CROWDED = 2000

#: One anchor: its hash, the hash of its context, document, start of the context, windows in it less one.
ANCHOR = np.dtype([("h", "<u8"), ("s", "<u8"), ("doc", "<i8"), ("at", "<i4"), ("more", "u1")])
SPAN = np.dtype([("start", "<i4"), ("end", "<i4")])


def _anchors_of(text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, first window, last window) of each anchor of a text of at least ``WINDOW`` bytes."""
    h = np.frombuffer(text, dtype=np.uint8).astype(np.uint64) + np.uint64(1)
    base, m = 0x9E3779B97F4A7C15, 1
    while m < CORE:
        h = h[:-m] * np.uint64(pow(base, m, 1 << 64)) + h[m:]
        m *= 2
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    # The position in the low bits breaks ties towards the left, alike in all copies.
    low = np.uint64((1 << len(text).bit_length()) - 1)
    key = (h & ~low) | np.arange(len(h), dtype=np.uint64)
    width, size = WINDOW - CORE + 1, 1
    while 2 * size <= width:
        key = np.minimum(key[:-size], key[size:])
        size *= 2
    key = np.minimum(key[: len(key) - (width - size)], key[width - size :])
    owner = (key & low).astype(np.int64)
    first = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
    return h[owner[first]], first, np.r_[first[1:], len(owner)] - 1


def _runs(*columns: np.ndarray) -> np.ndarray:
    """True where any of the columns differs from the row before."""
    fresh = np.zeros(len(columns[0]), dtype=bool)
    fresh[:1] = True
    for c in columns:
        fresh[1:] |= c[1:] != c[:-1]
    return fresh


def _first_of_equal(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Anchors ordered by (h, s, doc, at); True for the first of each context."""
    a = a[np.lexsort((a["at"], a["doc"], a["s"], a["h"]))]
    same = ~_runs(a["h"], a["s"], a["doc"], a["at"])
    a = a[~same]  # rows repeated with their id are one place
    return a, _runs(a["h"], a["s"])


def _merged(spans: np.ndarray) -> np.ndarray:
    """Union of spans that are sorted by start, touching ones joined."""
    if not len(spans):
        return spans
    reach = np.maximum.accumulate(spans["end"])
    fresh = np.r_[True, spans["start"][1:] > reach[:-1]]
    out = np.empty(int(fresh.sum()), dtype=SPAN)
    out["start"] = spans["start"][fresh]
    out["end"] = reach[np.r_[np.flatnonzero(fresh)[1:] - 1, len(spans) - 1]]
    return out


def _span_rows(doc: np.ndarray, start: np.ndarray, end: np.ndarray) -> list[tuple[int, bytes]]:
    """(doc, packed spans), one row for each document."""
    order = np.lexsort((start, doc))
    doc = doc[order]
    spans = np.empty(len(doc), dtype=SPAN)
    spans["start"], spans["end"] = start[order], end[order]
    cuts = np.flatnonzero(_runs(doc)) if len(doc) else np.zeros(0, dtype=int)
    return [(int(doc[s]), _merged(spans[s:e]).tobytes()) for s, e in zip(cuts, np.r_[cuts[1:], len(doc)], strict=False)]


OUT = pa.schema([("kind", pa.int8()), ("key", pa.int64()), ("data", pa.binary())])
OUT_DDL = "kind tinyint, key long, data binary"
#: Kinds of rows: anchors for a bucket, removed spans of a document, places to sort, places to name singly.
ANCHORS, SPANS, SORT, NAME = 0, 1, 2, 3


def _batch(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    kind, key, data = zip(*rows, strict=True) if rows else ((), (), ())
    return pa.RecordBatch.from_arrays([pa.array(kind, pa.int8()), pa.array(key, pa.int64()), pa.array(data, pa.binary())], schema=OUT)


def _dealt(a: np.ndarray, buckets: int) -> list[tuple[int, int, bytes]]:
    """Anchors of one task: equal contexts but the first become spans, the rest is packed by bucket."""
    if not len(a):
        return []
    a, first = _first_of_equal(a)
    rest = a[~first]
    rows = [(SPANS, d, x) for d, x in _span_rows(rest["doc"], rest["at"], rest["at"] + rest["more"] + WINDOW)]
    a = a[first]
    bucket = (a["h"] % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    a, bucket = a[order], bucket[order]
    cuts = np.flatnonzero(_runs(bucket))
    return rows + [(ANCHORS, int(bucket[s]), a[s:e].tobytes()) for s, e in zip(cuts, np.r_[cuts[1:], len(a)], strict=True)]


def _find_anchors(buckets: int):
    def run(batches):
        for b in batches:
            found = []
            for doc, text in zip(b.column(0).to_pylist(), byte_texts(b.column(1)), strict=True):
                if len(text) < WINDOW:
                    continue
                h, lo, hi = _anchors_of(text)
                a = np.empty(len(h), dtype=ANCHOR)
                view = memoryview(text)
                ends = hi + WINDOW
                a["s"] = np.fromiter((xxhash.xxh3_64_intdigest(view[s:e]) for s, e in zip(lo.tolist(), ends.tolist(), strict=True)), np.uint64, len(h))
                a["h"], a["doc"], a["at"], a["more"] = h, doc, lo, hi - lo
                found.append(a)
            yield _batch(_dealt(np.concatenate(found) if found else np.zeros(0, ANCHOR), buckets))

    return run


def _settle(batches):
    """One task's buckets: spans of repeated contexts, and the places whose anchors need sorting."""
    held: dict[int, list[bytes]] = {}
    for b in batches:
        done = []
        for kind, key, data in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if kind == ANCHORS:
                held.setdefault(key, []).append(data)
            elif kind == SPANS:
                done.append((kind, key, data))
        yield _batch(done)
    for parts in held.values():
        a, first = _first_of_equal(np.frombuffer(b"".join(parts), dtype=ANCHOR))
        rest, a = a[~first], a[first]
        rows = [(SPANS, d, x) for d, x in _span_rows(rest["doc"], rest["at"], rest["at"] + rest["more"] + WINDOW)]
        starts = np.flatnonzero(_runs(a["h"]))
        contexts = np.repeat(*(lambda n: (n, n))(np.diff(np.r_[starts, len(a)])))
        for kind, mask in ((SORT, (contexts > 1) & (contexts <= CROWDED)), (NAME, contexts > CROWDED)):
            some = a[mask]
            some = some[np.argsort(some["doc"], kind="stable")]
            cuts = np.flatnonzero(_runs(some["doc"])) if len(some) else ()
            rows += [(kind, int(some["doc"][s]), some[s:e].tobytes()) for s, e in zip(cuts, np.r_[cuts[1:], len(some)].astype(int) if len(some) else (), strict=True)]
        yield _batch(rows)


def _cut_contexts(shards: int, name_buckets: int):
    """From texts and their places: contexts for the shards, and singly named windows for buckets of their own."""

    def run(batches):
        for b in batches:
            keys, datas, named = [], [], []
            for doc, text, kinds, places in zip(*(b.column(k).to_pylist() for k in range(4)), strict=True):
                for kind, data in zip(kinds, places, strict=True):
                    a = np.frombuffer(data, dtype=ANCHOR)
                    if kind == SORT:
                        for h, at, more in zip(a["h"].tolist(), a["at"].tolist(), a["more"].tolist(), strict=True):
                            keys.append(h % shards)
                            datas.append(doc.to_bytes(8, "little", signed=True) + at.to_bytes(4, "little") + text[at : at + more + WINDOW])
                    else:
                        at = np.concatenate([np.arange(x, x + m + 1) for x, m in zip(a["at"].tolist(), a["more"].tolist(), strict=True)])
                        w = np.empty(len(at), dtype=ANCHOR)
                        windows = [text[x : x + WINDOW] for x in at.tolist()]
                        w["h"] = np.fromiter(map(xxhash.xxh3_64_intdigest, windows), np.uint64, len(at))
                        w["s"] = np.fromiter((xxhash.xxh64_intdigest(x) for x in windows), np.uint64, len(at))
                        w["doc"], w["at"], w["more"] = doc, at, 0
                        named.append(w)
            rows = [(SORT, k, d) for k, d in zip(keys, datas, strict=True)]
            yield _batch(rows + _dealt(np.concatenate(named) if named else np.zeros(0, ANCHOR), name_buckets))

    return run


def repeats_in_shard(contexts: list[tuple[int, int, bytes]]) -> list[tuple[int, bytes]]:
    """Packed spans to remove, given (doc, start, bytes) contexts: windows that also start earlier in the list's places."""
    sizes = np.array([len(c) for _, _, c in contexts])
    # Bytes are moved up by one; zero ends each context.
    text = np.concatenate([np.r_[np.frombuffer(c, dtype=np.uint8).astype(np.uint16) + 1, 0] for _, _, c in contexts]).astype(np.uint16)
    starts = np.r_[0, np.cumsum(sizes + 1)[:-1]]
    owner = np.repeat(np.arange(len(contexts)), sizes + 1)
    offset = np.arange(len(text)) - starts[owner]
    order = suffix_array(text)
    order = order[offset[order] <= sizes[owner[order]] - WINDOW]
    raw = np.zeros(len(text), dtype=np.uint8)
    raw[text > 0] = (text[text > 0] - 1).astype(np.uint8)
    joined = same_prefix(raw, order[:-1], order[1:], WINDOW)
    group = np.cumsum(np.r_[0, ~joined])
    doc = np.array([d for d, _, _ in contexts])[owner[order]]
    at = np.array([s for _, s, _ in contexts])[owner[order]] + offset[order]
    by = np.lexsort((at, doc, group))
    g = group[by]
    later = by[~_runs(g)] if len(by) else by
    return _span_rows(doc[later], at[later], at[later] + WINDOW)


def _sort_shards(batches):
    """Sorts each shard of a task. A shard's contexts are bounded by how many shards there are."""
    held: dict[int, list[bytes]] = {}
    for b in batches:
        for kind, key, data in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if kind == SORT:
                held.setdefault(key, []).append(data)
    for parts in held.values():
        contexts = [(int.from_bytes(x[:8], "little", signed=True), int.from_bytes(x[8:12], "little"), x[12:]) for x in parts]
        yield _batch([(SPANS, d, x) for d, x in repeats_in_shard(contexts)])


def _numbered(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, bool]:
    """``docs`` with ``_doc``, a number for each document that keeps the order of places; whether rows repeat it.

    It is the id itself unless an id is null or repeats; then documents are numbered by a
    distributed sort of (id, hash of text).
    """
    ids = docs.select(F.col(id_col).cast("long").alias("id"))
    n, known, different = ids.agg(F.count("*"), F.count("id"), F.countDistinct("id")).first()
    if n == known == different:
        return docs.withColumn("_doc", F.col(id_col).cast("long")), False
    mark = F.xxhash64(F.coalesce(F.col(text_col).cast("string"), F.lit("")))
    names = docs.select(F.col(id_col).cast("long").alias("_id"), mark.alias("_mark")).distinct().orderBy(F.asc_nulls_first("_id"), "_mark")
    numbered = staged(names.rdd.zipWithIndex().map(lambda x: (x[0][0], x[0][1], x[1])).toDF("_id long, _mark long, _doc long"), "documents")
    on = F.col(id_col).cast("long").eqNullSafe(F.col("_id")) & (mark == F.col("_mark"))
    return docs.join(numbered, on).drop("_id", "_mark"), True


def _tasks(spark, groups: int) -> int:
    """As many tasks as Spark shuffles to, but no more than there are groups and no fewer than a 16th."""
    return max(1, min(groups, partitions(spark)), groups // 16)


def removed_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with ``_spans``, the byte ranges to remove as packed pairs of int32 in order (null: none)."""
    spark = docs.sparkSession
    docs, repeats = _numbered(docs, id_col, text_col)
    texts = docs.select("_doc", F.col(text_col).cast("string").alias("_text"))
    total = docs.agg(F.sum(F.octet_length(F.col(text_col).cast("string")))).first()[0] or 0
    buckets = max(1, -(-total // BUCKET_BYTES))
    found = texts.mapInArrow(_find_anchors(buckets), OUT_DDL)
    settled = staged(found.repartition(_tasks(spark, buckets), "key").mapInArrow(_settle, OUT_DDL), "settled")
    # A place stands for its context of WINDOW to 2 * WINDOW - CORE bytes.
    places = settled.where(f"kind = {SORT}").agg(F.sum(F.octet_length("data"))).first()[0] or 0
    shards = max(1, -(-(places // ANCHOR.itemsize * (2 * WINDOW - CORE)) // SHARD_BYTES))
    m = _tasks(spark, shards)
    # Singly named windows come from few anchors; they are spread over as many buckets as there are tasks.
    n = max(m, partitions(spark))

    wanted = (
        settled.where(F.col("kind").isin(SORT, NAME))
        .groupBy(F.col("key").alias("_doc"))
        .agg(F.collect_list("kind").alias("kinds"), F.collect_list("data").alias("places"))
    )
    cut = staged(
        (texts.dropDuplicates(["_doc"]) if repeats else texts).join(wanted, "_doc").select("_doc", F.col("_text").cast("binary"), "kinds", "places").mapInArrow(_cut_contexts(shards, n), OUT_DDL),
        "contexts",
    )
    from_shards = cut.where(f"kind = {SORT}").repartition(m, "key").mapInArrow(_sort_shards, OUT_DDL)
    from_names = cut.where(f"kind = {ANCHORS}").repartition(n, "key").mapInArrow(_settle, OUT_DDL)
    spans = settled.unionByName(cut).unionByName(from_shards).unionByName(from_names).where(f"kind = {SPANS}")
    by_doc = spans.groupBy(F.col("key").alias("_doc")).agg(F.collect_list("data").alias("_parts"))

    def join_up(batches):
        for b in batches:
            out = []
            for parts in b.column("_parts").to_pylist():
                x = np.frombuffer(b"".join(parts), dtype=SPAN)
                out.append(_merged(x[np.argsort(x["start"], kind="stable")]).tobytes())
            yield pa.RecordBatch.from_arrays([b.column("_doc"), pa.array(out, pa.binary())], names=["_doc", "_spans"])

    joined = by_doc.mapInArrow(join_up, "_doc long, _spans binary")
    return docs.join(joined, "_doc", "left").drop("_doc")


def _pieces(text: bytes, spans: bytes | None) -> tuple[bytes, int, int]:
    """(what is kept, bytes removed, runs removed)."""
    x = np.frombuffer(spans or b"", dtype=SPAN)
    kept, at = [], 0
    for s, e in zip(x["start"].tolist(), x["end"].tolist(), strict=True):
        kept.append(text[at:s])
        at = e
    kept = b"".join([*kept, text[at:]])
    return kept, len(text) - len(kept), len(x)


def removal_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, n_bytes, n_removed, n_spans, kept_sha256 (of the bytes left)."""

    def run(batches):
        for b in batches:
            rows = [(len(t), *_pieces(t, s)) for t, s in zip(byte_texts(b.column(1)), b.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [
                    b.column(0),
                    pa.array([r[0] for r in rows], pa.int64()),
                    pa.array([r[2] for r in rows], pa.int64()),
                    pa.array([r[3] for r in rows], pa.int64()),
                    pa.array([hashlib.sha256(r[1]).hexdigest() for r in rows], pa.string()),
                ],
                names=["id", "n_bytes", "n_removed", "n_spans", "kept_sha256"],
            )

    marked = removed_spans(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")), "id", "text")
    return marked.select("id", "text", "_spans").mapInArrow(run, "id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with repeated passages cut out of the texts; all rows and other columns stay.

    A cut can split a character at either end; bytes that form none any more are left out. Null
    texts stay null.
    """
    named = docs.select(F.struct(*[F.col(c) for c in docs.columns if c != text_col]).alias("_row"), F.col(id_col).cast("long").alias("row_id"), F.col(text_col).cast("string").alias("row_text"))
    packed = removed_spans(named, "row_id", "row_text").select("_row", F.col("row_text").alias("_text"), "_spans")

    def run(batches):
        for b in batches:
            texts = b.column(b.schema.get_field_index("_text")).to_pylist()
            spans = b.column(b.schema.get_field_index("_spans")).to_pylist()
            out = [None if t is None else (_pieces(t.encode(), s)[0].decode("utf-8", "ignore") if s else t) for t, s in zip(texts, spans, strict=True)]
            keep = [k for k, f in enumerate(b.schema.names) if f not in ("_text", "_spans")]
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in keep), pa.array(out, pa.string())], names=[*(b.schema.names[k] for k in keep), "_text"])

    schema = packed.select("_row", "_text").schema
    out = packed.mapInArrow(run, schema)
    return out.select(*[F.col("_text").alias(text_col) if c == text_col else F.col("_row").getField(c).alias(c) for c in docs.columns])
