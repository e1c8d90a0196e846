"""Language identification in two steps: the family first, then the language within it.

Texts are profiles of hashed byte trigrams. Linear support vector machines, each for a pair, vote:
first those between families, then those between the languages of the family that won.

Null texts and texts without a letter are "und" with score 0; so are all texts if nothing labelled
was given. Rows without a language are not learned from. Whole texts are judged, however long;
repeated rows give repeated results. Ties of votes go to the larger margin and then to the later name.
Of the other columns only those in ``keep`` are handed on. An empty table gives an empty result.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import byte_texts

BITS = 11
#: Texts learned from, at most about so many of each language; drawn by a hash of their id.
PER_LANGUAGE = 800

# Families of languages by ISO 639-1 code. Others are families of their own.
FAMILIES = {
    "germanic": "en de nl sv da no nb nn is af fy lb yi",
    "romance": "fr es pt it ro ca gl oc la",
    "slavic": "ru uk be pl cs sk bg sr hr sl mk bs",
    "baltic": "lt lv",
    "uralic": "fi et hu",
    "turkic": "tr az kk uz ky tt tk",
    "indo-aryan": "hi ur bn pa gu mr ne si",
    "dravidian": "ta te kn ml",
    "semitic": "ar he mt am",
    "celtic": "ga cy gd br",
}
FAMILY_OF = {code: family for family, codes in FAMILIES.items() for code in codes.split()}

#: ASCII other than letters becomes a space; what is left is compared in lower case.
LETTERS_ONLY = bytes(c if c >= 128 or chr(c).isalpha() else 32 for c in range(256))


def profile(text: bytes) -> np.ndarray:
    """Unit vector of the square roots of a whole text's hashed trigram counts."""
    words = b" ".join(text.translate(LETTERS_ONLY).lower().split())
    c = np.frombuffer(b" " + words + b" ", dtype=np.uint8).astype(np.uint32)
    if len(c) < 3:
        return np.zeros(1 << BITS, dtype=np.float32)
    h = ((c[:-2] * np.uint32(0x9E3779B1) + c[1:-1]) * np.uint32(0x85EBCA77) + c[2:]) * np.uint32(0xC2B2AE3D)
    x = np.sqrt(np.bincount(h >> np.uint32(32 - BITS), minlength=1 << BITS).astype(np.float32))
    return x / np.linalg.norm(x)


def train_svm(x: np.ndarray, y: np.ndarray, c: float = 10.0, steps: int = 150) -> tuple[np.ndarray, float]:
    """Linear SVM (squared hinge) for y in {-1, 1} by accelerated gradient steps; classes weigh alike."""
    x = np.hstack([x, np.ones((len(x), 1), dtype=x.dtype)])
    weight = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum()))
    w = v = np.zeros(x.shape[1])
    rate = 1 / (1 / c + 2 * 2.0)
    for k in range(steps):
        slack = np.maximum(0, 1 - y * (x @ v))
        new = v - rate * (v / c - 2 * x.T @ (weight * y * slack))
        v, w = new + k / (k + 3) * (new - w), new
    return w[:-1], float(w[-1])


class Pairwise:
    """One-versus-one machines between classes; the class with the most votes wins, then the margin."""

    def __init__(self, x: np.ndarray, labels: np.ndarray):
        self.names = sorted(set(labels.tolist()))
        self.pairs = list(combinations(range(len(self.names)), 2))
        at = np.array([self.names.index(k) for k in labels.tolist()])
        machines = []
        for a, b in self.pairs:
            some = (at == a) | (at == b)
            machines.append(train_svm(x[some], np.where(at[some] == a, 1.0, -1.0)))
        self.w = np.array([m[0] for m in machines]) if machines else np.zeros((0, x.shape[1]))
        self.b = np.array([m[1] for m in machines])

    def decide(self, x: np.ndarray) -> tuple[list[str], np.ndarray]:
        """Names and scores of rows: the winner's chance against its closest rival."""
        margins = x @ self.w.T + self.b
        votes = np.zeros((len(x), len(self.names)))
        worst = np.full((len(x), len(self.names)), np.inf)
        for k, (a, b) in enumerate(self.pairs):
            m = margins[:, k]
            votes[:, a] += m >= 0
            votes[:, b] += m < 0
            worst[:, a] = np.minimum(worst[:, a], m)
            worst[:, b] = np.minimum(worst[:, b], -m)
        best = np.lexsort((worst.T, votes.T), axis=0)[-1] if len(self.names) else np.zeros(len(x), dtype=int)
        score = 1 / (1 + np.exp(-4 * np.clip(worst[np.arange(len(x)), best], -50, 50)))
        return [self.names[k] for k in best], score


class Hierarchy:
    def __init__(self, x: np.ndarray, langs: np.ndarray):
        families = np.array([FAMILY_OF.get(k, k) for k in langs.tolist()])
        self.families = Pairwise(x, families)
        self.within = {f: Pairwise(x[families == f], langs[families == f]) for f in self.families.names}

    def predict(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        names, score = self.families.decide(x)
        names, out = np.array(names, dtype=object), np.empty(len(x), dtype=object)
        for f in set(names.tolist()):
            rows = np.flatnonzero(names == f)
            lang, s = self.within[f].decide(x[rows])
            out[rows] = lang
            score[rows] *= s
        return out, score


def train(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Hierarchy | None:
    """Learn from the rows of ``labelled`` that have a language; None if there are none."""
    rows = labelled.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    counts = {r[0]: r[1] for r in rows.groupBy(lang_col).count().collect()}
    if not counts:
        return None
    share = F.lit(0.0)
    for lang, n in counts.items():
        share = F.when(F.col(lang_col) == lang, min(1.0, PER_LANGUAGE / n)).otherwise(share)
    drawn = rows.where(F.pmod(F.xxhash64(F.col(id_col)), F.lit(1 << 20)) < share * (1 << 20))

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([profile(t).astype(np.float16).tobytes() for t in byte_texts(b.column(1))], pa.binary())], names=["lang", "x"])

    got = drawn.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text")).mapInArrow(run, "lang string, x binary").collect()
    got.sort()  # whatever order tasks end in, the same machines result
    if not got:
        return None
    x = np.array([np.frombuffer(r.x, dtype=np.float16) for r in got]).astype(np.float64)
    return Hierarchy(x, np.array([r.lang for r in got], dtype=object))


def predict(docs: DataFrame, model: Hierarchy | None, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns ``keep`` with lang_pred and score, from whole texts."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        model = shared.value
        for b in batches:
            texts = b.column(1).to_pylist()
            known = [k for k, t in enumerate(texts) if model and t and any(map(str.isalpha, t))]
            lang, score = np.full(len(texts), "und", dtype=object), np.zeros(len(texts))
            for s in range(0, len(known), 1024):
                rows = known[s : s + 1024]
                lang[rows], score[rows] = model.predict(np.array([profile(texts[k].encode()) for k in rows]))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(lang.tolist(), pa.string()), pa.array(score)], names=["_row", "lang_pred", "score"])

    packed = docs.select(F.struct(*keep).alias("_row"), F.col(text_col).cast("string").alias("_text"))
    schema = packed.select("_row", F.lit("").alias("lang_pred"), F.lit(0.0).alias("score")).schema
    return packed.mapInArrow(run, schema).select("_row.*", "lang_pred", "score")
