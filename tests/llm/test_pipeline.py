"""The pipeline, stage by stage, against brute force on a small corpus."""

import random

import numpy as np

import corpus_pipeline
from loomgrid.llm import decontaminate, sentencepiece_sampling, simhash
from loomgrid.llm.common import staged

from .test_simhash import brute_classes


def make_tables(spark, folder):
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("aeioutnsrlm") for _ in range(rng.randint(2, 8)))
    text = lambda n: " ".join(word() for _ in range(n))
    items = [(k, text(20)) for k in range(3)]
    shared = text(70)
    rows = []
    for k in range(150):
        if k % 10 == 0:
            rows.append((k, " ".join(w + "###" for w in text(60).split())))
        elif k % 10 == 1:
            rows.append((k, f"{text(30)} {shared} {text(30)}"))
        elif k % 25 == 7:
            rows.append((k, f"{text(30)} {items[k % 3][1]} {text(10)}"))
        else:
            rows.append((k, text(rng.randint(20, 80))))
    rows += [(200, rows[2][1]), (201, rows[3][1]), (202, rows[3][1])]
    docs = spark.createDataFrame([(k, t, "en", "s", len(t)) for k, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(k, int(k % 10 != 0), 0) for k in range(150)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return dict(rows), [t for _, t in items]


def cut(rows):
    """Texts without bytes of 100-byte strings that also start earlier."""
    seen, out = set(), {}
    for k, t in sorted(rows.items()):
        b = t.encode()
        gone = np.zeros(len(b), dtype=bool)
        for i in range(len(b) - 99):
            if b[i : i + 100] in seen:
                gone[i : i + 100] = True
            seen.add(b[i : i + 100])
        out[k] = bytes(c for c, g in zip(b, gone, strict=True) if not g).decode()
    return out


def test_stages_against_brute_force(spark, tmp_path):
    folder = str(tmp_path)
    rows, items = make_tables(spark, folder)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, results = docs.columns, []
    for name, stage in corpus_pipeline.STAGES:
        docs = staged(stage(spark, docs, folder), "test-stage")
        results.append(docs)
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == columns
    got = [{r.doc_id: r.text for r in d.collect()} for d in results[:4]]
    assert set(got[0]) == {k for k in rows if k % 10 != 0 or k >= 200}
    classes = brute_classes([(k, simhash.text_fingerprint(t.encode())) for k, t in got[0].items()])
    assert set(got[1]) == {k for k, _, c in classes if k == c} and not {200, 201, 202} & set(got[1])
    assert got[2] == cut(got[1]) and got[2] != got[1]
    leaky = {k for k, t in got[2].items() if any(i in t for i in items)}
    assert set(got[3]) == set(got[2]) - leaky and leaky
    v = sentencepiece_sampling.Vocabulary(sentencepiece_sampling.VOCABULARY)
    last = results[4].collect()
    assert {r.doc_id for r in last} == set(got[3])
    assert all(sentencepiece_sampling.decode(np.array(r.ids), v) == got[3][r.doc_id] for r in last)
    whole = corpus_pipeline.run(spark, folder).collect()
    key = lambda r: (r.doc_id, r.draw, tuple(r.ids))
    assert sorted(map(key, whole)) == sorted(map(key, last))
    assert decontaminate.WORDS == 5


def test_odd_rows(spark, tmp_path):
    folder = str(tmp_path)
    make_tables(spark, folder)
    good = "a plain text of some words that nobody else has written down here or anywhere at all"
    rows = [
        (1, None, "en", "s", None, 1), (2, "", None, None, 0, 2), (None, good, "en", "s", 5, 3), (4, good + " four", "en", "s", 5, 4), (4, good + " four", "en", "s", 5, 4),
        (5, " ".join(f"w{k}" for k in range(60_000)), "en", "s", 5, 6), (6, " ".join(f"v{k}" for k in range(90)), "en", "s", 5, 7), (6, " ".join(f"u{k}" for k in range(90)), "en", "s", 5, 8),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, _doc long")
    for _, stage in corpus_pipeline.STAGES[:4]:
        assert stage(spark, docs.where("false"), folder).count() == 0
    # The columns clash with names that stages use inside.
    near = corpus_pipeline.drop_near_duplicates(spark, docs, folder).collect()
    assert sorted(r._doc for r in near) == [1, 3, 4, 6, 7, 8]
    cut = corpus_pipeline.cut_repeated_passages(spark, docs, folder)
    assert cut.columns == docs.columns and cut.count() == len(rows)
    clean = corpus_pipeline.drop_benchmark_leaks(spark, docs, folder)
    assert clean.columns == docs.columns and clean.count() == len(rows)
    assert corpus_pipeline.keep_good_documents(spark, docs, folder).columns == docs.columns
    drawn = corpus_pipeline.encode_pieces(spark, docs, folder).collect()
    assert {r.doc_id for r in drawn} == {2, None, 4, 5, 6} and corpus_pipeline.encode_pieces(spark, docs.where("false"), folder).count() == 0
