import numpy as np
import pytest

from loomgrid.llm import token_files


@pytest.mark.parametrize(("block", "chunk"), [(4, 2), (7, 3), (1 << 16, 1024)])
def test_counts_of_texts(spark, monkeypatch, block, chunk):
    monkeypatch.setattr(token_files, "BLOCK_TOKENS", block)
    monkeypatch.setattr(token_files, "CHUNK_BLOCKS", chunk)
    rows = [(1, "Hello there, world"), (2, ""), (3, None), (4, "word " * 300), (4, "again"), (None, "no id"), (5, "été naïve <|endoftext|> 12345")]
    rows += [(k, "x y z " * (k % 9)) for k in range(10, 60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    encode = token_files._encoding(token_files.VOCABULARY).encode_ordinary
    got = token_files.token_counts(docs).collect()
    want = sorted(((i, len(encode(t or ""))) for i, t in rows), key=str)
    assert sorted(((r.id, r.n_tokens) for r in got), key=str) == want
    by_file = {}
    for r in got:
        by_file.setdefault(r.file, []).append((r.doc_index, r.start, r.n_tokens))
    for docs_of_file in by_file.values():
        at = 0
        for k, (index, start, n) in enumerate(sorted(docs_of_file)):
            assert (index, start) == (k, at)
            at += n + 1


def test_raw_files(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(token_files, "BLOCK_TOKENS", 5)
    monkeypatch.setattr(token_files, "CHUNK_BLOCKS", 2)
    end = token_files.END_OF_DOCUMENT
    rng = np.random.default_rng(1)
    want = {}
    for name in ("a.bin", "b.bin"):
        sizes = rng.integers(0, 23, 30).tolist()
        flat = np.concatenate([np.r_[np.arange(n), end] for n in sizes] + [np.arange(8)]).astype("<u2")
        (tmp_path / name).write_bytes(flat.tobytes())
        want[name] = sizes
    scanned = token_files.scan_blocks(token_files.read_token_files(spark, str(tmp_path)))
    got = {}
    for r in token_files.document_lengths(scanned).orderBy("file", "doc_index").collect():
        got.setdefault(r.file.rsplit("/", 1)[-1], []).append(r.n_tokens)
    assert got == want


def test_empty_table(spark):
    assert token_files.token_counts(spark.createDataFrame([], "doc_id long, text string")).count() == 0
