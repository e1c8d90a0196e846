"""Quality classifier: random-indexing word vectors, pooled per document, and a two-layer network.

Every word has a sparse ternary index vector that follows from its hash. A word's context vector is
the sum of the index vectors of its neighbours over the whole corpus; it is summed up in each task
and then across tasks, one row for each block of words. Words share ``1 << WORD_BITS`` hashed slots,
so the table of vectors has one fixed size for any corpus. A document is the mean and the spread of
its words' unit vectors. A network of two layers, trained with numpy on labelled documents, gives
the chance of quality 1; a temperature fitted on labelled rows kept out of training calibrates it.

Null and empty texts are documents without words: a zero vector, scored like any other. Without
labelled rows every score is 0.5. Repeated rows give repeated results. Whole texts are pooled, however
long; the ids' and texts' columns alone are read. An empty table gives an empty result.

Two features stand beside the pooled vectors: the length of their mean and the share of words that
follow themselves.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import partitions, slices, staged

WORD_BITS = 14
DIMS = 32
NONZERO = 4
REACH = 2
#: Labelled documents learned from, at most about so many; drawn by a hash of their id.
LABELLED = 20_000
HIDDEN = 32
#: Rows of the table of word vectors that travel in one record.
BLOCK = 1024

WORD = re.compile(r"\w+|[^\w\s]+")


class Words(dict):
    """Hashed slot of each word; slot 0 is the end of a text. Forgets itself before it grows large."""

    def __missing__(self, word: str) -> int:
        if len(self) > 200_000:
            self.clear()
        slot = self[word] = 1 + xxhash.xxh32_intdigest(word) % ((1 << WORD_BITS) - 1)
        return slot

    def slots(self, text: str) -> list[int]:
        return [self[w] for w in WORD.findall(text)]


def index_vectors() -> tuple[np.ndarray, np.ndarray]:
    """(places, signs), each slots x NONZERO: the sparse ternary vector of each slot; none for slot 0."""
    n = 1 << WORD_BITS
    k = np.arange(n * NONZERO, dtype=np.uint64)
    h = k * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(31)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(29)
    places = (h % np.uint64(DIMS)).astype(np.int64).reshape(n, NONZERO)
    signs = np.where((h >> np.uint64(40)) & np.uint64(1), 1.0, -1.0).reshape(n, NONZERO)
    signs[0] = 0.0
    return places, signs


def _add_contexts(table: np.ndarray, slots: np.ndarray, places: np.ndarray, signs: np.ndarray) -> None:
    """Add the index vectors of the words within REACH of each word of a batch of texts."""
    size = table.size
    for step in range(1, REACH + 1):
        for a, b in ((slots[:-step], slots[step:]), (slots[step:], slots[:-step])):
            inside = (a != 0) & (b != 0)
            for between in range(1, step):  # no neighbour across the end of a text
                inside &= slots[between : len(slots) - step + between] != 0
            a, b = a[inside], b[inside]
            for k in range(NONZERO):
                table += np.bincount(a * DIMS + places[b, k], weights=signs[b, k], minlength=size)


def _batch_slots(texts: Iterable[str | None], words: Words) -> Iterator[np.ndarray]:
    """Slots of the texts, each closed by 0, some 400,000 at a time."""
    held: list[int] = []
    for t in texts:
        if t:
            held.extend(words.slots(t))
            held.append(0)
            if len(held) > 400_000:
                yield np.array(held, dtype=np.int64)
                held = []
    if held:
        yield np.array(held, dtype=np.int64)


def word_vectors(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """Unit context vectors, slots x DIMS, from all texts of ``docs``.

    The result has one fixed size (2 MB) whatever the corpus; only it reaches the driver.
    """

    def count(batches):
        table = np.zeros((1 << WORD_BITS) * DIMS)
        places, signs = index_vectors()
        words = Words()
        for b in batches:
            for slots in _batch_slots(slices(b.column(0)), words):
                _add_contexts(table, slots, places, signs)
        rows = table.reshape(-1, BLOCK * DIMS).astype(np.float32)
        some = [k for k in range(len(rows)) if rows[k].any()]
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array([rows[k].tobytes() for k in some], pa.binary())], names=["block", "sums"])

    def add(batches):
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for block, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                sums.setdefault(block, np.zeros(BLOCK * DIMS))
                sums[block] += np.frombuffer(x, dtype=np.float32)
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([x.tobytes() for x in sums.values()], pa.binary())], names=["block", "sums"])

    shape = "block int, sums binary"
    parts = docs.select(F.col(text_col).cast("string").alias("text")).mapInArrow(count, shape)
    n = max(1, min((1 << WORD_BITS) // BLOCK, partitions(docs.sparkSession)))
    table = np.zeros(((1 << WORD_BITS) // BLOCK, BLOCK * DIMS))
    for block, sums in parts.repartition(n, "block").mapInArrow(add, shape).collect():
        table[block] = np.frombuffer(sums)
    table = table.reshape(-1, DIMS)
    return (table / np.maximum(1e-9, np.linalg.norm(table, axis=1, keepdims=True))).astype(np.float32)


def pooled(docs: DataFrame, vectors: np.ndarray, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns ``keep`` with ``x``, packed as float32: the words' vectors pooled.

    These are their mean and mean square, the length of the mean (long if few different words make
    up a text) and the share of words that follow themselves.
    """
    shared = docs.sparkSession.sparkContext.broadcast(vectors)

    def run(batches):
        table, words = shared.value, Words()
        for b in batches:
            out = []
            for t in slices(b.column(1)):
                slots = np.array(words.slots(t) if t else [], dtype=np.int64)
                counts = np.bincount(slots)
                some = np.flatnonzero(counts)
                v, c = table[some], (counts[some] / max(1, len(slots))).astype(np.float32)
                mean = c @ v
                again = float((slots[1:] == slots[:-1]).mean()) if len(slots) > 1 else 0.0
                out.append(np.concatenate([mean, c @ (v * v), [np.linalg.norm(mean), again]]).astype(np.float32).tobytes())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.binary())], names=["_row", "x"])

    packed = docs.select(F.struct(*keep).alias("_row"), F.col(text_col).cast("string").alias("_text"))
    schema = packed.select("_row", F.lit(b"").alias("x")).schema
    return packed.mapInArrow(run, schema).select("_row.*", "x")


class Network:
    """Two layers (tanh, logistic), trained by Adam; probabilities divided by a fitted temperature."""

    def __init__(self, x: np.ndarray, y: np.ndarray, seed: int = 7, steps: int = 600):
        rng = np.random.default_rng(seed)
        self.mean, self.scale = x.mean(0), x.std(0) + 1e-6
        order = rng.permutation(len(x))
        held, used = order[: len(x) // 5], order[len(x) // 5 :]
        self.p = [rng.normal(0, 1 / np.sqrt(x.shape[1]), (x.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, 1 / np.sqrt(HIDDEN), HIDDEN), np.zeros(1)]
        z, t = (x[used] - self.mean) / self.scale, y[used]
        m, v = [np.zeros_like(p) for p in self.p], [np.zeros_like(p) for p in self.p]
        for k in range(1, steps + 1):
            some = rng.integers(0, len(z), min(len(z), 512))
            zs, ts = z[some], t[some]
            h = np.tanh(zs @ self.p[0] + self.p[1])
            d = (1 / (1 + np.exp(-(h @ self.p[2] + self.p[3]))) - ts) / len(ts)
            dh = np.outer(d, self.p[2]) * (1 - h * h)
            grads = [zs.T @ dh + 1e-4 * self.p[0], dh.sum(0), h.T @ d + 1e-4 * self.p[2], np.array([d.sum()])]
            for i, g in enumerate(grads):
                m[i] = 0.9 * m[i] + 0.1 * g
                v[i] = 0.999 * v[i] + 0.001 * g * g
                self.p[i] = self.p[i] - 0.01 * (m[i] / (1 - 0.9**k)) / (np.sqrt(v[i] / (1 - 0.999**k)) + 1e-8)
        self.temperature = 1.0
        if len(held):
            logits, ts = self.logits(x[held]), y[held]
            grid = np.exp(np.linspace(np.log(0.25), np.log(8), 61))
            loss = [np.mean(np.logaddexp(0, -logits / s * (2 * ts - 1))) for s in grid]
            self.temperature = float(grid[int(np.argmin(loss))])

    def logits(self, x: np.ndarray) -> np.ndarray:
        z = (x - self.mean) / self.scale
        return np.tanh(z @ self.p[0] + self.p[1]) @ self.p[2] + self.p[3][0]

    def chance(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -60, 60)))


def train(labelled: DataFrame, id_col: str = "doc_id", label_col: str = "quality") -> Network | None:
    """A network from rows with ``x`` and a label (null labels are left out); None if there are none."""
    rows = labelled.where(F.col(label_col).isin(0, 1))
    n = rows.count()
    if not n:
        return None
    share = int(min(1.0, LABELLED / n) * (1 << 20))
    got = rows.where(F.pmod(F.xxhash64(F.col(id_col)), F.lit(1 << 20)) < share).select(F.col(id_col).alias("id"), "x", F.col(label_col).cast("int").alias("y")).collect()
    got.sort(key=lambda r: (r.id is None, r.id, bytes(r.x)))
    if not got:
        return None
    return Network(np.array([np.frombuffer(r.x, dtype=np.float32) for r in got], dtype=np.float64), np.array([r.y for r in got], dtype=np.float64))


def score(features: DataFrame, model: Network | None) -> DataFrame:
    """``features`` with ``score`` in place of ``x``."""
    shared = features.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        model = shared.value
        for b in batches:
            x = np.array([np.frombuffer(v, dtype=np.float32) for v in b.column(1).to_pylist()], dtype=np.float64).reshape(b.num_rows, -1)
            chance = model.chance(x) if model and b.num_rows else np.full(b.num_rows, 0.5)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(chance, pa.float64())], names=["_row", "score"])

    packed = features.select(F.struct(*[c for c in features.columns if c != "x"]).alias("_row"), "x")
    schema = packed.select("_row", F.lit(0.0).alias("score")).schema
    return packed.mapInArrow(run, schema).select("_row.*", "score")


def quality_scores(docs: DataFrame, labels: DataFrame, learn_from: str = "true", id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """(id, score) for every row of ``docs``; labels of ids for which ``learn_from`` holds are learned.

    ``learn_from`` is a SQL condition on the id column. Of labels that repeat an id the least counts.
    """
    features = staged(pooled(docs.withColumn(id_col, F.col(id_col).cast("long")), word_vectors(docs, text_col), text_col, (id_col,)), "pooled")
    said = labels.where(F.expr(learn_from)).groupBy(id_col).agg(F.min(label_col).alias("_label"))
    # One row for each id: repeated ids are one labelled document.
    known = features.where(F.expr(learn_from)).join(said, id_col).groupBy(id_col).agg(F.min("x").alias("x"), F.min("_label").alias("_label"))
    return score(features, train(known, id_col, "_label"))


def keep_good(docs: DataFrame, labels: DataFrame, least: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` whose score is at least ``least``; rows with a null id stay, as no score names them."""
    bad = quality_scores(docs, labels, "true", id_col, text_col).where((F.col("score") < least) & F.col(id_col).isNotNull()).select(id_col).distinct()
    return docs.join(bad, id_col, "left_anti").select(docs.columns)
