import numpy as np

from loomgrid.llm import ann


def brute(rows, queries, k):
    out = []
    for q, v in sorted(set(queries)):
        near = {}
        for i, w in rows:
            if i != q and len(w) == len(v):
                d = float(np.sqrt(((np.array(v) - np.array(w)) ** 2).sum()))
                near[i] = min(d, near.get(i, d))
        out += [(q, r + 1, i) for r, (d, i) in enumerate(sorted((d, i) for i, d in near.items())[:k])]
    return out


def test_recall_over_several_shards(spark, monkeypatch):
    monkeypatch.setattr(ann, "SHARD_ROWS", 300)
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(12, 16))
    x = (centres[rng.integers(0, 12, 1500)] + 0.4 * rng.normal(size=(1500, 16))).round(3)
    rows = [(k, v) for k, v in enumerate(x.tolist())]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {(r.query_id, r.id) for r in ann.nearest(df, df.where("vec_id % 50 = 0")).collect()}
    want = {(q, i) for q, _, i in brute(rows, [(k, tuple(v)) for k, v in rows if k % 50 == 0], 10)}
    assert len(got) == len(want) and len(got & want) >= 0.9 * len(want)


def test_odd_rows_and_ties(spark):
    same = [1.0, 2.0]
    rows = [(k, same) for k in range(0, 40)] + [(50, [1.0, 3.0]), (51, [1.0, None]), (52, None), (53, [0.0, 0.0]), (54, [float("nan"), 1.0]), (55, [float("inf"), 1.0]), (56, [1.0]), (None, same), (50, [1.0, 3.0]), (57, [-0.0, 5.0]), (58, [0.0, 5.0])]
    df = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<double>, rank int")
    got = sorted((r.query_id, r["rank"], r.id) for r in ann.nearest(df, df.where("vec_id in (0, 5, 50, 53, 56)")).collect())
    fine = [(i, v) for i, v in rows if i is not None and v and not any(c is None or not np.isfinite(c) for c in v) and any(v)]
    assert got == sorted(brute(fine, [(i, tuple(v)) for i, v in fine if i in (0, 5, 50, 53, 56)], 10))
    assert ann.nearest(df.where("false"), df.where("false")).count() == 0
