"""Ranked lexical search with hashed sketches of maxima: exact top lists from upper bounds.

A document's impact of a term grows with the term's occurrences and falls with the document's length. Its
sketch has ``SLOTS`` coordinates; each term's occurrences fold into the coordinate of its hash by their maximum.
As one document's impacts rise and fall together with these, the sketch gives its largest impact in
a coordinate once the corpus' counts are known, and a batch of sketches looked up at a query's coordinates gives
upper bounds of the documents' scores: a term's impact is at most that of its coordinate.

The search goes down the bounds. The documents with the largest bounds for each query are scored from their whole texts; the
score of the last one of the list is the threshold, and every other document whose bound reaches it
is scored as well. What lies under it cannot enter the list, so the lists are exact.

Queries are worked on in blocks of ``BLOCK_QUERIES`` and, within them, a bounded vocabulary travels to the tasks. Null
and empty texts have no terms: as documents they are not counted and not found, as queries they find
nothing. Rows that share an id are documents each, and rows alike in id and text too. Null ids are searched
and stand behind others of equal score. Texts are read whole, however long; a saturated
coordinate counts as unbounded occurrences. Other columns are not read. Empty tables give an empty result.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import partitions, slices, staged

#: Coordinates of a sketch; a coordinate is two bytes.
SLOTS = 1 << 16
#: Occurrences from here on are not told apart by a sketch.
SATURATED = 255
TOP = 10
BLOCK_QUERIES = 1024
#: Bytes of terms of one block's queries; a block whose terms are larger is halved.
BLOCK_BYTES = 4 << 20
#: Digits and letters, those outside ASCII too; capitals of ASCII become small.
WORDS = bytes.maketrans(bytes(range(256)), bytes(c if c > 127 or chr(c).isalnum() and not 65 <= c <= 90 else c + 32 if 65 <= c <= 90 else 32 for c in range(256)))


def terms(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(WORDS).split()


class Coordinates(dict):
    """Coordinate of each term; forgets itself before it grows large."""

    def __init__(self, size: int):
        self.size = size

    def __missing__(self, term: bytes) -> int:
        if len(self) > 500_000:
            self.clear()
        slot = self[term] = zlib.crc32(term) % self.size
        return slot


def sketches(docs: DataFrame, vocabulary: list[bytes], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, mark, n, slots, most, held): a row for each document with a term, and one a task of counts.

    ``slots`` are coordinates in rising order as 16-bit numbers, ``most`` the occurrences of their most frequent term as
    bytes; ``mark`` is a hash of the text, ``n`` its number of terms. A task's last row has in ``held`` how many of its documents hold
    each term of ``vocabulary``, in ``n`` its documents and in ``mark`` their terms.
    """

    size = SLOTS

    def run(batches):
        place, slot_of = {t: k for k, t in enumerate(vocabulary)}, Coordinates(size)
        known = frozenset(place)
        held, n_docs, n_terms = np.zeros(len(vocabulary), dtype=np.int64), 0, 0
        names = ["id", "mark", "n", "slots", "most", "held"]
        for b in batches:
            for first in range(0, b.num_rows, 512):
                part = b.slice(first, 512)
                rows, n, at, most = [], [], [], []
                for row, text in enumerate(slices(part.column(2))):
                    counts = Counter(terms(text))
                    if not counts:
                        continue
                    for t in known & counts.keys():
                        held[place[t]] += 1
                    total = counts.total()
                    n_docs, n_terms = n_docs + 1, n_terms + total
                    slots = np.fromiter(map(slot_of.__getitem__, counts), dtype=np.int64, count=len(counts))
                    tf = np.minimum(np.fromiter(counts.values(), dtype=np.int64, count=len(counts)), SATURATED)
                    # Sorted by coordinate, then occurrences: the last of a coordinate is its maximum.
                    code = np.sort(slots << 8 | tf)
                    code = code[np.r_[code[1:] >> 8 != code[:-1] >> 8, True]]
                    rows.append(row)
                    n.append(total)
                    at.append((code >> 8).astype("<u2").tobytes())
                    most.append((code & 255).astype(np.uint8).tobytes())
                picked = part.take(pa.array(rows, pa.int64()))
                yield pa.RecordBatch.from_arrays(
                    [picked.column(0), picked.column(1), pa.array(n, pa.int64()), pa.array(at, pa.binary()), pa.array(most, pa.binary()), pa.nulls(len(rows), pa.list_(pa.int64()))], names=names
                )
        yield pa.RecordBatch.from_arrays(
            [pa.nulls(1, pa.int64()), pa.array([n_terms], pa.int64()), pa.array([n_docs], pa.int64()), pa.nulls(1, pa.binary()), pa.nulls(1, pa.binary()), pa.array([held], pa.list_(pa.int64()))], names=names
        )

    return _marked(docs, id_col, text_col).mapInArrow(run, "id long, mark long, n long, slots binary, most binary, held array<bigint>")


def _marked(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.col(text_col).cast("string")
    return docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text).alias("mark"), text.alias("text"))


class Corpus:
    """The corpus' counts, and the impact of occurrences in a document of n terms by them."""

    def __init__(self, documents: int, terms: int):
        self.documents, self.terms = documents, terms

    def weight(self, held: int) -> int:
        return math.floor(1000 * math.log((2 * self.documents + 2) / (2 * held + 1)))

    def norm(self, n):
        return 10 + 90 * n * self.documents // max(1, self.terms)

    @staticmethod
    def impact(tf, norm):
        return 1_000_000_000 * tf // (1000 * tf + 8 * norm)


def bounds(sketched: DataFrame, corpus: Corpus, queries: list[list[tuple[bytes, int]]], top: int, reached: list[tuple[int, int | None] | None] | None = None) -> DataFrame:
    """(query, id, mark, bound): pairs of a query's number and a document.

    ``queries`` are lists of (term, weight). Without ``reached`` these are each task's ``top`` documents of each query by
    bound, ties to smaller ids; with it all whose bound reaches the query's (threshold, id): above it, or equal with an id that isn't larger.
    """
    by_slot: dict[int, Counter] = {}
    for q, listed in enumerate(queries):
        for term, weight in listed:
            by_slot.setdefault(zlib.crc32(term) % SLOTS, Counter())[q] += max(0, weight)
    starts = np.zeros(SLOTS + 1, dtype=np.int64)
    for slot, c in by_slot.items():
        starts[slot + 1] = len(c)
    starts = np.cumsum(starts)
    ordered = [x for slot in sorted(by_slot) for x in by_slot[slot].items()]
    to = np.array([q for q, _ in ordered], dtype=np.int64)
    weight = np.array([w for _, w in ordered], dtype=np.float64)
    n_queries = len(queries)

    def best(query, ids, marks, bound):
        """The ``top`` largest bounds of each query, of these rows."""
        order = np.lexsort((ids, -bound, query))
        query = query[order]
        rank = np.arange(len(query)) - np.searchsorted(query, query, side="left")
        kept = order[rank < top]
        return kept

    def batch(query, ids, marks, bound):
        known = ids != np.iinfo(np.int64).max
        return pa.RecordBatch.from_arrays([pa.array(query), pa.array(ids, mask=~known), pa.array(marks), pa.array(bound.astype(np.int64))], names=["query", "id", "mark", "bound"])

    def run(batches):
        kept = [np.zeros(0, np.int64)] * 3 + [np.zeros(0)]
        least = np.full(n_queries, 1.0)
        if reached is not None:
            floor = np.array([max(1.0, r[0]) if r else 1.0 for r in reached])
            tie = np.array([np.iinfo(np.int64).max if r is None or r[1] is None else r[1] for r in reached], dtype=np.int64)
        for b in batches:
            for first in range(0, b.num_rows, 2048):
                part = b.slice(first, 2048)
                n = part.column(2).to_numpy(zero_copy_only=False)
                slots, most = part.column(3).to_pylist(), part.column(4).to_pylist()
                sizes = np.fromiter(map(len, most), dtype=np.int64, count=len(most))
                at = np.frombuffer(b"".join(slots), dtype="<u2").astype(np.int64)
                fan = starts[at + 1] - starts[at]
                hit = np.flatnonzero(fan)
                row = np.repeat(np.arange(len(sizes)), sizes)[hit]
                at, fan = at[hit], fan[hit]
                tf = np.frombuffer(b"".join(most), dtype=np.uint8).astype(np.int64)[hit]
                impact = np.where(tf == SATURATED, 1_000_000, corpus.impact(tf, corpus.norm(n)[row]))
                # Each coordinate met goes to the queries that look at it. Whole numbers under 2^53 are exact in doubles.
                take = np.repeat(starts[at] - np.r_[0, np.cumsum(fan)[:-1]], fan) + np.arange(fan.sum())
                cell = np.repeat(row, fan) * n_queries + to[take]
                bound = np.bincount(cell, weights=np.repeat(impact, fan) * weight[take], minlength=len(sizes) * n_queries).reshape(len(sizes), n_queries)
                ids = part.column(0).fill_null(np.iinfo(np.int64).max).to_numpy()
                marks = part.column(1).to_numpy(zero_copy_only=False)
                if reached is not None:
                    r, q = np.nonzero((bound > floor) | ((bound == floor) & (ids[:, None] <= tie[None, :])))
                    if len(r):
                        yield batch(q, ids[r], marks[r], bound[r, q])
                    continue
                r, q = np.nonzero(bound >= least)
                rows = [np.concatenate([a, x]) for a, x in zip(kept, (q, ids[r], marks[r], bound[r, q]), strict=True)]
                kept = [x[best(*rows)] for x in rows] if len(r) else kept
                full = np.flatnonzero(np.bincount(kept[0], minlength=n_queries) >= top)
                lows = np.full(n_queries, np.inf)
                np.minimum.at(lows, kept[0], kept[3])
                least[full] = lows[full]
        if reached is None and len(kept[0]):
            yield batch(*kept)

    return sketched.where("held is null").select("id", "mark", "n", "slots", "most").mapInArrow(run, "query long, id long, mark long, bound long")


def scores(pairs: DataFrame, docs: DataFrame, corpus: Corpus, queries: list[list[tuple[bytes, int]]], id_col: str, text_col: str) -> DataFrame:
    """(query, id, score) of (query, id, mark) pairs, by the documents' whole texts."""
    wanted = pairs.groupBy("id", "mark").agg(F.sort_array(F.collect_set("query")).alias("queries"))
    names = wanted.select(F.col("id").alias("_id"), F.col("mark").alias("_mark"), "queries")
    rows = _marked(docs, id_col, text_col)
    met = rows.join(names, rows["id"].eqNullSafe(F.col("_id")) & (rows["mark"] == F.col("_mark"))).select("id", "text", "queries")

    def run(batches):
        for b in batches:
            ids, out_q, out_s = [], [], []
            for row, (text, asked) in enumerate(zip(slices(b.column(1)), slices(b.column(2)), strict=True)):
                counts = Counter(terms(text))
                norm = corpus.norm(counts.total())
                for q in asked:
                    ids.append(row)
                    out_q.append(q)
                    out_s.append(sum(w * corpus.impact(counts[t], norm) for t, w in queries[q] if t in counts))
            yield pa.RecordBatch.from_arrays([pa.array(out_q, pa.int64()), b.column(0).take(pa.array(ids, pa.int64())), pa.array(out_s, pa.int64())], names=["query", "id", "score"])

    return met.mapInArrow(run, "query long, id long, score long")


def _listed(rows: DataFrame, column: str, top: int, *more: str) -> DataFrame:
    """The ``top`` rows of each query by ``column``, with their ``rank``; ties to smaller ids."""
    order = Window.partitionBy("query").orderBy(F.col(column).desc(), F.col("id").asc_nulls_last(), *more)
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)


def search_block(docs: DataFrame, items: list[list[bytes]], top: int = TOP, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(query, rank, id, score): the best documents for each list of terms, by its number in ``items``."""
    spark = docs.sparkSession
    vocabulary = sorted({t for listed in items for t in listed})
    sketched = staged(sketches(docs, vocabulary, id_col, text_col), "sketches")
    # One row a task, summed by term before they are gathered: as many rows as the block has terms.
    counts = sketched.where("held is not null")
    total = counts.agg(F.sum("n"), F.sum("mark")).first()
    held = dict(map(tuple, counts.select(F.posexplode("held").alias("term", "n")).groupBy("term").agg(F.sum("n")).collect()))
    corpus = Corpus(total[0] or 0, total[1] or 0)
    weight = {t: corpus.weight(held.get(k, 0)) for k, t in enumerate(vocabulary)}
    queries = [[(t, weight[t]) for t in dict.fromkeys(listed)] for listed in items]
    first = _listed(bounds(sketched, corpus, queries, top), "bound", top, "mark").select("query", "id", "mark")
    leaders = staged(scores(staged(first, "leaders"), docs, corpus, queries, id_col, text_col), "leaders-scored")
    reached: list[tuple[int, int | None] | None] = [None] * len(queries)
    # At most ``top`` rows a query.
    for r in _listed(leaders, "score", top).where(F.col("rank") == top).select("query", "score", "id").collect():
        reached[r["query"]] = (r["score"], r["id"])
    others = staged(bounds(sketched, corpus, queries, top, reached), "reaching")
    found = scores(others, docs, corpus, queries, id_col, text_col).where("score > 0")
    return _listed(found, "score", top).select("query", "rank", "id", "score")


def ranked_search(docs: DataFrame, queries: DataFrame, query_id: str = "item_id", query_text: str = "text", top: int = TOP, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK_QUERIES) -> DataFrame:
    """(query_id, rank, id, score): for each row of ``queries`` its ``top`` documents with a score above 0, best first.

    Equal scores go by rising id. Rows of ``queries`` that share an id are searched each.
    """
    spark = docs.sparkSession
    asked = queries.select(F.col(query_id).alias("query_id"), F.col(query_text).cast("string").alias("text"))
    kind = dict(asked.dtypes)["query_id"]
    # Dealt to blocks, whose rows alone reach the driver at a time.
    blocks = max(1, -(-asked.count() // block))
    dealt = staged(asked.withColumn("_block", F.pmod(F.xxhash64("query_id", "text"), F.lit(blocks))), "queries") if blocks > 1 else asked.withColumn("_block", F.lit(0))
    out = None
    for k in range(blocks):
        waiting = [[(r["query_id"], list(dict.fromkeys(terms(r["text"])))) for r in dealt.where(F.col("_block") == k).collect()]]
        while waiting:
            rows = waiting.pop()
            if len(rows) > 1 and sum(len(t) for _, listed in rows for t in listed) > BLOCK_BYTES:
                waiting += [rows[: len(rows) // 2], rows[len(rows) // 2 :]]
                continue
            if not rows:
                continue
            names = F.broadcast(spark.createDataFrame([(n, q) for n, (q, _) in enumerate(rows)], f"query long, query_id {kind}"))
            found = search_block(docs, [listed for _, listed in rows], top, id_col, text_col)
            found = found.join(names, "query").select("query_id", F.col("rank").cast("int").alias("rank"), "id", "score")
            out = found if out is None else out.unionByName(found)
    return out if out is not None else spark.createDataFrame([], f"query_id {kind}, rank int, id long, score long")
