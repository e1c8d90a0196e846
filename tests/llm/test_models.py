"""Classifiers: quality, language, URL rules."""

import random

from loomgrid.llm import language_id, quality, url_filter
from loomgrid.llm.common import stable_fold


def test_quality_on_held_out_rows(spark):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("aeioutnsr") for _ in range(rng.randint(2, 7)))
    rows = []
    for k in range(400):
        words = [word() for _ in range(rng.randint(15, 60))]
        junk = [lambda w: w + "###", lambda w: w.upper() + "!!", lambda w: words[0]][k % 3] if k % 4 == 0 else None
        rows.append((k, " ".join(map(junk, words)) if junk else " ".join(words)))
    docs = spark.createDataFrame([*((*r, "s") for r in rows), (900, None, "s"), (901, "", "s"), (None, "a b", "s"), (5, rows[5][1], "s")], "doc_id long, text string, x string")
    labels = spark.createDataFrame([(k, int(k % 4 != 0), 0) for k in range(400)] + [(3, None, 1), (None, 0, 0)], "doc_id long, quality int, toxic int")
    got = quality.quality_scores(docs, labels, "pmod(crc32(cast(doc_id as string)), 3) <> 1").collect()
    assert len(got) == 404 and all(0 <= r.score <= 1 for r in got)
    held = docs.where(stable_fold("doc_id", 3) == 1).select("doc_id").distinct().collect()
    score = {r.doc_id: r.score for r in got}
    right = [(score[r.doc_id] >= 0.5) == (r.doc_id % 4 != 0) for r in held if r.doc_id < 400]
    assert sum(right) >= 0.95 * len(right)
    kept = quality.keep_good(docs, labels)
    assert kept.columns == docs.columns and kept.where("doc_id is null").count() == 1
    nothing = labels.where("false")
    assert {r.score for r in quality.quality_scores(docs, nothing).collect()} == {0.5}
    assert quality.quality_scores(docs.where("false"), labels).count() == 0


def test_languages(spark):
    rng = random.Random(8)
    parts = {"en": "the and ing tion er".split(), "de": "der und ung ich sch".split(), "fr": "le et eau que oi".split(), "es": "el y ción ez ll".split(), "xx": "qqw zzk vvp".split()}
    rows = [(k, " ".join("".join(rng.choice(parts[lang]) for _ in range(2)) for _ in range(rng.randint(3, 30))), lang) for k, lang in ((k, list(parts)[k % 5]) for k in range(400))]
    odd = [(1000, None, "en"), (1001, "", "en"), (1002, "123 !!", "de"), (1003, rows[0][1] * 2000, None), (None, rows[1][1], None)]
    docs = spark.createDataFrame([(*r, 0.5) for r in rows + odd], "doc_id long, text string, lang string, score double")
    fold = stable_fold("doc_id", 4)
    model = language_id.train(docs.where(fold != 2))
    got = {r.doc_id: r for r in language_id.predict(docs, model).collect()}
    held = [r.doc_id for r in docs.where((fold == 2) & (docs.doc_id < 400)).collect()]
    assert sum(got[k].lang_pred == rows[k][2] for k in held) >= 0.95 * len(held)
    assert all(got[k].lang_pred == "und" and got[k].score == 0 for k in (1000, 1001, 1002))
    assert got[1003].lang_pred == rows[0][2] and got[None].lang_pred == rows[1][2]
    assert all(0 <= r.score <= 1 for r in got.values())
    assert {r.lang_pred for r in language_id.predict(docs, language_id.train(docs.where("false"))).collect()} == {"und"}


RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/")]


def test_given_url_rules(spark):
    rows = [
        (1, "http://A.Example.COM/en/1?q=/x", "a.example.com", "/en/1", "example.com/en/", "block"),
        (2, "http://www.example.com/en/1#t", "www.example.com", "/en/1", "www.example.com/en/", "allow"),
        (3, "https://myexample.com/en/", "myexample.com", "/en/", "com/", "allow"),
        (4, "x://net/es/a", "net", "/es/a", "net/es/", "block"),
        (5, "http://a.com", "a.com", "", None, "allow"),
        (6, "no host here", "", "", None, "allow"),
        (7, None, "", "", None, "allow"),
        (8, "http://h.org?u=http://b.com/", "h.org", "", None, "allow"),
        (8, "http://h.org?u=http://b.com/", "h.org", "", None, "allow"),
    ]
    df = spark.createDataFrame([(*r[:2], "v") for r in rows], "page_id long, url string, verdict string")
    mined = url_filter.mine_rules(df, spark.createDataFrame([], "doc_id long, quality int"), "page_id", "doc_id")
    got = url_filter.judge_urls(df, mined, RULES).select("page_id", "url", "host", "path", "rule", "verdict").collect()
    assert sorted(map(tuple, got)) == sorted(rows, key=lambda r: r[0])
    assert url_filter.judge_urls(df.where("false"), mined, []).count() == 0


def test_mined_url_rules(spark):
    rows = [(k, f"http://{'spam' if k % 5 == 0 else 'good'}.org/{'a' if k % 2 else 'b'}/{k}?ref=x") for k in range(300)]
    df = spark.createDataFrame(rows, "page_id long, url string")
    labels = spark.createDataFrame([(k, int(k % 5 != 0)) for k in range(0, 300, 2)] + [(7, None)], "doc_id long, quality int")
    mined = url_filter.mine_rules(df, labels, "page_id", "doc_id")
    got = {r.page_id: r.verdict for r in url_filter.judge_urls(df, mined, []).collect()}
    assert got == {k: "block" if k % 5 == 0 else "allow" for k in range(300)}


def test_rules_of_both_kinds_are_weighed(spark):
    """A hot host is bad but for one folder; labels are learned on two folds and hold on the third."""
    rng = random.Random(2)
    rows = []
    for k in range(1500):
        host, folder = rng.choice(["hot.net"] * 4 + ["a.org", "b.org", "c.com"]), rng.choice("news shop docs".split())
        bad = rng.random() < (0.0 if host != "hot.net" else 0.02 if folder == "docs" else 0.7)
        rows.append((k, f"https://{host}/{folder}/{k}", int(not bad), "m"))
    df = spark.createDataFrame(rows, "page_id long, url string, quality int, mined string")
    labels = df.selectExpr("page_id AS doc_id", "quality")
    mined = url_filter.mine_rules(df, labels.where("doc_id % 3 <> 0"), "page_id", "doc_id")
    assert {r.verdict for r in mined.collect()} == {"block", "allow"}
    got = url_filter.judge_urls(df, mined, [])
    assert got.columns == ["page_id", "url", "quality", "mined", "host", "path", "rule", "verdict"]
    for r in got.where("page_id % 3 = 0").collect():
        assert r.verdict == ("block" if r.host == "hot.net" and not r.path.startswith("/docs") else "allow") and r.mined == "m"


def test_mined_verdicts_against_brute_force(spark):
    """Every rule against every URL's tokens, on the given pages."""
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").select("page_id", "url")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    rules = [r for r in url_filter.mine_rules(pages, labels, "page_id", "doc_id").collect()]
    own = {r.url: set(r.t) for r in pages.select("url", url_filter.url_tokens(pages.url).alias("t")).collect()}
    want = {}
    for url, tokens in own.items():
        fits = [r for r in rules if set(r.tokens) <= tokens]
        if fits:
            want[url] = max(fits, key=lambda r: (abs(r["shift"]), r.support, len(r.tokens), -r.rule_id)).verdict
    mined = spark.createDataFrame(rules, url_filter.RULES)
    assert {r.url: r.mined for r in url_filter.mined_verdicts(pages, mined).collect()} == want
