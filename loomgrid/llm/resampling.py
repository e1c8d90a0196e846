"""Importance resampling towards a target distribution, by hashed n-grams in Arrow kernels.

A document's words, in lower case, form n-grams of one to three words, each in one of ``buckets`` by its CRC-32.
A bucket gains the logarithm of how much more common it is in the target than in the documents, a
document weighs the sum of its n-grams' gains, and the weight plus Gumbel noise that follows from the id
ranks the documents for a draw without replacement.

Texts are worked on in slices of about ``SLICE_BYTES``: ``ascii_lower``, ``split_pattern_regex``, ``list_flatten`` and
``dictionary_encode`` make word indices; shifted against each other these are codes of n-grams, of which the
distinct ones get their CRC from those of their words, and ``take`` brings buckets and gains back to the places
where they occur. Sums by document are segment sums. A text longer than a slice is cut between words, each
part but the first beginning with the two words before it.

Null and empty texts have no words: no features, weight 0, no rank. Rows that repeat an id are documents
each and of the same noise; of equal scores and ids the ranks are in any order. A null id has no noise and so no score and no
rank, though its words count. Without documents or target all counts are 0. Other columns are not read.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import partitions, staged

BUCKETS = 10_000
SEED = 42
LEAST_WORDS = 20
PERCENT = 5
NGRAMS = 3
#: Everything in ASCII but digits and lower-case letters parts words.
APART = "[\\x00-/:-`{-\\x7f]+"
SLICE_BYTES = 4 << 20


def _text_slices(texts: pa.Array, most: int) -> Iterator[tuple[int, int, pa.Array]]:
    """(first row, carried words, lower-case texts): rows of about ``most`` bytes together; of a longer text one part at a time."""
    texts = pc.fill_null(pc.ascii_lower(texts), "")
    sizes = pc.binary_length(texts).to_numpy(zero_copy_only=False)
    first, total = 0, 0
    for row, size in enumerate(sizes):
        if total and total + size > most:
            yield first, 0, texts.slice(first, row - first)
            first, total = row, 0
        total += size
        if size > most:
            for carried, part in _parts(texts[row].as_py(), most // 2):
                yield row, carried, pa.array([part])
            first, total = row + 1, 0
    if first < len(texts):
        yield first, 0, texts.slice(first)


def _parts(text: str, most: int) -> Iterator[tuple[int, str]]:
    """A long text in parts cut between words, with the number of words at a part's start that the part before has counted."""
    start, carried = 0, []
    apart = frozenset(chr(c) for c in range(128) if not (48 <= c < 58 or 97 <= c < 123))
    while start < len(text):
        stop = min(len(text), start + most)
        while stop < len(text) and text[stop] not in apart:
            stop += 1
        part = " ".join([*carried, text[start:stop]])
        yield len(carried), part
        words = [w for w in pc.split_pattern_regex(pa.scalar(part), pattern=APART).as_py() if w]
        start, carried = stop, words[max(0, len(words) - NGRAMS + 1) :]


@lru_cache(maxsize=4096)
def _shift(length: int) -> np.ndarray:
    """Tables (4 x 256) of what the CRC of a text becomes, before the final mix, when so many bytes follow it."""
    zeros = bytes(length)
    base = zlib.crc32(zeros)
    bits = np.array([zlib.crc32(zeros, 1 << k) ^ base for k in range(32)], dtype=np.uint32)
    table = np.zeros((4, 256), dtype=np.uint32)
    for byte in range(4):
        for k in range(8):
            table[byte, np.arange(256) >> k & 1 == 1] ^= bits[8 * byte + k]
    return table


def crc_joined(left: np.ndarray, right: np.ndarray, tables: np.ndarray, which: np.ndarray) -> np.ndarray:
    """CRC-32 of joined texts from those of their left and right parts; ``tables[which]`` are of the right parts' lengths."""
    moved = np.zeros(len(left), dtype=np.uint32)
    for byte in range(4):
        moved ^= tables[which, byte, left >> (8 * byte) & 255]
    return moved ^ right


def _distinct(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct codes, and for each place the number of its code."""
    encoded = pc.dictionary_encode(pa.array(codes))
    return encoded.dictionary.to_numpy(), encoded.indices.to_numpy()


def ngram_buckets(texts: pa.Array, carried: int, buckets: int) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """Words of each text (without those carried), and of the 1-, 2- and 3-grams their buckets and texts' numbers."""
    split = pc.split_pattern_regex(texts, pattern=APART)
    flat, of = pc.list_flatten(split), pc.list_parent_indices(split)
    full = pc.not_equal(flat, "")
    flat, of = flat.filter(full), of.filter(full).to_numpy()
    words = pc.dictionary_encode(flat)
    index = words.indices.to_numpy().astype(np.int64)
    names = words.dictionary.cast(pa.binary()).to_pylist()
    n = max(1, len(names))
    crc = np.fromiter(map(zlib.crc32, names), dtype=np.uint32, count=len(names))
    spaced = np.fromiter((zlib.crc32(b" " + w) for w in names), dtype=np.uint32, count=len(names))
    lengths, length = np.unique(np.fromiter(map(len, names), dtype=np.int64, count=len(names)) + 1, return_inverse=True)
    tables = np.stack([_shift(int(x)) for x in lengths]) if names else np.zeros((0, 4, 256), np.uint32)
    found = [((crc % buckets)[index][carried:], of[carried:])]
    # A code names an n-gram: the number of its shorter one among the distinct, and its last word.
    shorter, shorter_crc = index, crc
    for k in range(2, NGRAMS + 1):
        if len(of) < k:
            found.append((np.zeros(0, np.int64), np.zeros(0, np.int64)))
            shorter, of = shorter[:0], of[:0]
            continue
        codes, at = _distinct(shorter[:-1] * n + index[k - 1 :])
        shorter_crc = crc_joined(shorter_crc[codes // n], spaced[codes % n], tables, length[codes % n])
        shorter = at.astype(np.int64)
        # n-grams across two texts are numbered like the others, and left out.
        inside = of[: len(of) - k + 1] == of[k - 1 :]
        last = np.arange(len(inside)) + k - 1 >= carried
        use = inside & last
        found.append(((shorter_crc % buckets)[at][use], of[k - 1 :][use]))
    counts = np.bincount(found[0][1], minlength=len(texts))
    return counts, found


def bucket_counts(docs: DataFrame, text_col: str = "text", buckets: int = BUCKETS) -> DataFrame:
    """(bucket, n): n-grams of all texts by bucket, summed in each task and then across tasks."""

    most = SLICE_BYTES

    def run(batches):
        total = np.zeros(buckets, dtype=np.int64)
        for b in batches:
            for _, carried, texts in _text_slices(b.column(0), most):
                for bucket, _ in ngram_buckets(texts, carried, buckets)[1]:
                    total += np.bincount(bucket, minlength=buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int64)), pa.array(total[at])], names=["bucket", "n"])

    counted = docs.select(F.col(text_col).cast("string").alias("text")).mapInArrow(run, "bucket long, n long")
    return counted.groupBy("bucket").agg(F.sum("n").alias("n"))


def bucket_gains(docs_counts: DataFrame, target_counts: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """floor(1000 ln((t + 1)(S + buckets) / ((s + 1)(T + buckets)))) of every bucket: one number for each of ``buckets``."""
    s, t = (dict(map(tuple, x.select("bucket", "n").collect())) for x in (docs_counts, target_counts))
    all_s, all_t = sum(s.values()), sum(t.values())
    return np.array([math.floor(1000 * math.log((t.get(k, 0) + 1) * (all_s + buckets) / ((s.get(k, 0) + 1) * (all_t + buckets)))) for k in range(buckets)], dtype=np.int64)


def weights(docs: DataFrame, gains: np.ndarray, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_words, n_features, weight) of every row: the gains of its n-grams, repeats too, summed up."""

    most = SLICE_BYTES

    def run(batches):
        for b in batches:
            sums = np.zeros((3, b.num_rows), dtype=np.int64)
            for first, carried, texts in _text_slices(b.column(1), most):
                counts, found = ngram_buckets(texts, carried, len(gains))
                here = sums[:, first : first + len(texts)]
                here[0] += counts
                for bucket, of in found:
                    here[1] += np.bincount(of, minlength=len(texts))
                    # Sums of whole numbers under 2^53 are exact in doubles.
                    here[2] += np.bincount(of, weights=gains[bucket], minlength=len(texts)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), *map(pa.array, sums)], names=["id", "n_words", "n_features", "weight"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "id long, n_words long, n_features long, weight long")


def with_noise(weighted: DataFrame, seed: int = SEED) -> DataFrame:
    """``weighted`` with ``score``: the weight plus thousandths of a Gumbel variable that follows from the id."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256), 1, 8), 16, 10).cast("long")
    noise = F.floor(-1000 * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0)))).cast("long")
    return weighted.withColumn("score", F.col("weight") + noise)


def drawn(scored: DataFrame, least_words: int = LEAST_WORDS, percent: int = PERCENT) -> DataFrame:
    """``scored`` with ``rank`` for the share of documents drawn, 1 the highest score, equal scores by id; null for the rest.

    ``scored`` should be written, as it is read several times. Ranks are counted in ranges of scores: each
    task numbers its own rows, after the sums of the ranges before it.
    """
    spark = scored.sparkSession
    known = F.col("n_words") >= least_words
    known &= F.col("score").isNotNull()
    share = scored.where(known).count() * percent // 100
    order = [F.col("score").desc(), "id"]
    dealt = scored.where(known).repartitionByRange(partitions(spark), *order).sortWithinPartitions(*order)
    ranged = staged(dealt.withColumn("_at", F.monotonically_increasing_id()), "ranged")
    # An id's upper bits are the range, the lower 33 the row's place in it.
    sizes = ranged.groupBy(F.shiftright("_at", 33).alias("_range")).agg(F.count("*").alias("n")).collect()
    before, ranges = 0, []
    for r, n in sorted(map(tuple, sizes)):
        ranges.append((r, before))
        before += n
    offsets = F.broadcast(spark.createDataFrame(ranges, "_range long, _before long"))
    rank = F.col("_before") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)) + 1
    ranked = ranged.withColumn("_range", F.shiftright("_at", 33)).join(offsets, "_range").withColumn("rank", F.when(rank <= share, rank)).drop("_range", "_before", "_at")
    return ranked.unionByName(scored.where(~F.coalesce(known, F.lit(False))).withColumn("rank", F.lit(None).cast("long")))


def resample(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_text_col: str = "text", buckets: int = BUCKETS, seed: int = SEED, least_words: int = LEAST_WORDS, percent: int = PERCENT) -> DataFrame:
    """(id, n_words, n_features, weight, score, rank) of every row of ``docs``, drawn towards the texts of ``target``."""
    gains = bucket_gains(bucket_counts(docs, text_col, buckets), bucket_counts(target, target_text_col, buckets), buckets)
    scored = staged(with_noise(weights(docs, gains, id_col, text_col), seed), "scored")
    return drawn(scored, least_words, percent)
