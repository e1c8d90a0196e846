import zlib
from collections import defaultdict

import numpy as np
import pytest

from loomgrid.llm import packing

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.json"


def best_fit_decreasing(lengths, capacity):
    free = []
    for n in sorted(lengths, reverse=True):
        fits = [k for k, f in enumerate(free) if f >= n]
        k = min(fits, key=lambda k: free[k], default=None)
        if k is None:
            free.append(capacity - n)
        else:
            free[k] -= n
    return len(free)


def placed_right(spark, lengths, capacity=1024, rows=packing.SWEEP_ROWS):
    pieces = spark.createDataFrame([(k, n) for k, n in enumerate(lengths)], "key long, length long")
    got = packing.place(pieces, capacity).collect()
    assert sorted(r.key for r in got) == list(range(len(lengths)))
    by_seq = defaultdict(list)
    for r in got:
        by_seq[r.seq].append((r.offset, lengths[r.key]))
    for parts in by_seq.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= capacity
    return len(by_seq)


@pytest.mark.parametrize("rows", [packing.SWEEP_ROWS, 150])
@pytest.mark.parametrize("kind", ["mixed", "equal", "tiny", "full"])
def test_as_few_sequences_as_best_fit_decreasing(spark, monkeypatch, kind, rows):
    monkeypatch.setattr(packing, "SWEEP_ROWS", rows)
    rng = np.random.default_rng(3)
    lengths = {
        "mixed": np.r_[rng.integers(1, 1025, 500), rng.integers(1, 200, 300)], "equal": np.r_[np.full(300, 300), rng.integers(1, 1000, 50)],
        "tiny": rng.integers(1, 9, 700), "full": np.full(20, 1024),
    }[kind].tolist()
    used = placed_right(spark, lengths)
    assert used <= 1.01 * best_fit_decreasing(lengths, 1024) + 1
    if kind in ("tiny", "full"):
        assert used == -(-sum(lengths) // 1024)


def test_other_capacities_and_no_pieces(spark):
    assert placed_right(spark, [3, 3, 3, 1, 1, 1, 4], 4) == 4
    assert placed_right(spark, [1, 1], 1) == 2
    assert placed_right(spark, []) == 0


def test_sweep_against_a_stack():
    rng = np.random.default_rng(5)
    for _ in range(200):
        kinds = rng.random(rng.integers(0, 30)) < rng.random()
        stack, want, lost = [], set(), []
        for k, piece in enumerate(kinds):
            if not piece:
                stack.append(k)
            elif stack:
                want.add((stack.pop(), k))
            else:
                lost.append(k)
        gap, piece, left, open_gap = packing.sweep(kinds)
        assert set(zip(gap.tolist(), piece.tolist(), strict=True)) == want
        assert left.tolist() == lost and open_gap.tolist() == stack


def test_least_sequences():
    assert packing.least_sequences({300: 9}, 1024) == 3
    assert packing.least_sequences({600: 5, 10: 3}, 1024) == 5
    assert packing.least_sequences({1: 2048}, 1024) == 2


@pytest.fixture(scope="module")
def tokenizer():
    return pytest.importorskip("tokenizers").Tokenizer.from_file(TOKENIZER)


TEXTS = ["Hello there, world", "", None, "a <|endoftext|> b<|endoftext|>", "été naïve 12345　\n\n  x", "word " * 3000, "x" * 5000, "Hello there, world", " ", "\x00"]


def test_pieces_against_the_tokenizer(spark, tokenizer):
    rows = [(k % 8 or None, t, "other") for k, t in enumerate(TEXTS)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, key string").repartition(3)
    got = packing.cut_pieces(docs).collect()
    assert len({r.key for r in got}) == len(got)
    want = []
    for doc, text, _ in rows:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 2]
        start, length, piece = 0, (len(ids) - 1) % 1024 + 1, 0
        while start < len(ids):
            cut = ids[start : start + length]
            want.append((doc, piece, start, len(cut), zlib.crc32(np.array(cut, "<u4").tobytes()), cut))
            start, length, piece = start + len(cut), 1024, piece + 1
    assert sorted(((r.id, r.piece, r.start, r.length, r.ids_crc32, r.ids) for r in got), key=str) == sorted(want, key=str)


def test_all_given_documents_against_the_tokenizer(spark, tokenizer):
    encode = packing.encoder(packing.VOCABULARY)
    for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect():
        assert encode(r.text or "").tolist() == tokenizer.encode(r.text or "", add_special_tokens=False).ids


def test_sequences_hold_all_ids(spark):
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(TEXTS)], "doc_id long, text string")
    packed = packing.staged(packing.pack_documents(docs), "packed")
    found = {r.sequence_id: (r.ids, r.starts) for r in packing.sequences(packed).collect()}
    for r in packed.collect():
        ids, starts = found[r.sequence_id]
        assert r.offset in starts and ids[r.offset : r.offset + r.length] == r.ids
    assert sum(len(ids) for ids, _ in found.values()) == packed.agg({"length": "sum"}).first()[0]
    assert packing.pack_documents(docs.limit(0)).count() == 0
