"""URL filtering by association rules, in DataFrame functions only.

Every URL is a set of tokens. Spark's FP-growth mines the combinations that go with a verdict in
labelled URLs. A combination is a rule if it shifts the odds of a bad label: its confidence, smoothed
towards the share of bad labels in all, must at least double these odds (a "block" rule) or halve
them ("allow"), and its count must be ``LEAST_DEVIATIONS`` away from what chance gives. Both kinds stay, and of the rules that fit a URL the one that shifts the odds most
decides, so that a narrow rule can free what a broad one blocks. A rule is indexed under its rarest
token: a URL looks up few rules and checks each against its own tokens. Rules given by hand (host and
path) come first; the longest that fits decides.

A null URL or one without ``://`` has an empty host and path and no tokens. URLs that no rule fits
are allowed; so are all without labelled rows. Repeated rows give repeated results, whatever their
length URLs are read whole, and other columns are handed on untouched, even under names used here.
"""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import partitions, staged

#: A combination must stand in this share of the labelled URLs, at every size.
MIN_SUPPORT = 0.002
#: Labelled URLs of the average kind that each combination is smoothed with.
SMOOTHING = 10
#: Rules shift the odds of a bad label by this factor at least, up or down.
LEAST_SHIFT = 2.0
#: Bad labels under a rule differ from the expected number by so many standard deviations at least.
LEAST_DEVIATIONS = 3.0
BLOCK, ALLOW = "block", "allow"
#: Mined rules up to this many (about 300 bytes each) are broadcast.
BROADCAST_RULES = 50_000

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def url_tokens(url: Column) -> Column:
    """Typed tokens of a URL: parts of the host, of the path (numbers as one kind), query keys, fragment, scheme.

    None follows from another, as combinations are what is mined.
    """
    host, path = host_of(url), path_of(url)
    query = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^?#]*\?([^#]*)", 1)
    keys = F.transform(F.split(query, "&"), lambda x: F.concat(F.lit("query:"), F.substring_index(x, "=", 1)))
    parts = F.transform(F.split(path, "/"), lambda x: F.concat(F.lit("path:"), F.regexp_replace(F.lower(x), r"\d+", "0")))
    labels = F.transform(F.split(host, r"\."), lambda x: F.concat(F.lit("part:"), x))
    scheme = F.array(F.concat(F.lit("scheme:"), F.lower(F.substring_index(url, "://", 1))))
    fragment = F.when(url.contains("#"), F.array(F.lit("fragment"))).otherwise(F.array().cast("array<string>"))
    kept = F.filter(F.concat(labels, parts, keys, scheme, fragment), lambda x: ~x.isin("part:", "path:", "query:", "scheme:"))
    return F.when(F.instr(url, "://") > 0, F.array_distinct(kept)).otherwise(F.array().cast("array<string>"))


RULES = "rule_id long, tokens array<string>, verdict string, confidence double, support double, shift double"


def mine_rules(urls: DataFrame, labels: DataFrame, url_key: str, label_key: str, url_col: str = "url", bad: str = "quality = 0") -> DataFrame:
    """(rule_id, tokens, verdict, confidence, support, shift): pruned association rules with a verdict.

    ``labels`` are joined to ``urls`` by key; ``bad`` says which of them speak for blocking. All
    labelled rows are mined. ``shift`` is the log of the factor by which a rule shifts the odds of a
    bad label, ``confidence`` the smoothed share of labels that agree with the verdict.
    """
    spark = urls.sparkSession
    said = labels.where(F.col(label_key).isNotNull() & F.expr(bad).isNotNull()).select(
        F.col(label_key).alias("key"), F.when(F.expr(bad), F.lit("=" + BLOCK)).otherwise("=" + ALLOW).alias("said")
    )
    named = urls.select(F.col(url_key).alias("key"), url_tokens(F.col(url_col)).alias("tokens")).where(F.size("tokens") > 0)
    baskets = staged(named.join(said, "key").select("tokens", "said"), "labelled-urls")
    n, n_bad = baskets.agg(F.count("*"), F.count(F.when(F.col("said") == "=" + BLOCK, 1))).first()
    if not n or n_bad in (0, n):
        return spark.createDataFrame([], RULES)
    # A token of every URL is in no combination that its absence would change.
    everywhere = baskets.select(F.explode("tokens").alias("token")).groupBy("token").count().where(F.col("count") == n).select("token")
    plain = [r.token for r in everywhere.collect()]  # no more than one URL has
    items = F.concat(F.array_except("tokens", F.array(*map(F.lit, plain)).cast("array<string>")), F.array("said"))
    model = FPGrowth(itemsCol="items", minSupport=MIN_SUPPORT, minConfidence=1.0, numPartitions=partitions(spark)).fit(baskets.select(items.alias("items")))
    sets = staged(model.freqItemsets.select(F.array_sort("items").alias("items"), F.col("freq").alias("n")), "itemsets")
    # Labels are the items that sort first, as "=" stands before all letters.
    labelled = sets.where(F.startswith(F.col("items")[0], F.lit("=")) & (F.size("items") > 1))
    by_label = labelled.select(F.expr("slice(items, 2, size(items) - 1)").alias("tokens"), F.when(F.col("items")[0] == "=" + BLOCK, F.col("n")).alias("n_bad"), F.when(F.col("items")[0] == "=" + ALLOW, F.col("n")).alias("n_good"))
    known = by_label.groupBy("tokens").agg(F.max("n_bad").alias("n_bad"), F.max("n_good").alias("n_good"))
    counted = sets.where(~F.startswith(F.col("items")[0], F.lit("="))).withColumnRenamed("items", "tokens").join(known, "tokens")
    # Of the two counts, one may be too small to be mined; the other and the sum give it.
    counted = counted.withColumn("bad", F.coalesce("n_bad", F.col("n") - F.col("n_good")))
    base = n_bad / n
    deviations = F.abs(F.col("bad") - F.col("n") * base) / F.sqrt(F.col("n") * (base * (1 - base)))
    share = (F.col("bad") + SMOOTHING * base) / (F.col("n") + SMOOTHING)
    shift = F.log(share / (1 - share)) - F.log(F.lit(n_bad / (n - n_bad)))
    rules = counted.where(deviations >= LEAST_DEVIATIONS).select(
        F.xxhash64("tokens").alias("rule_id"), "tokens", F.when(shift > 0, BLOCK).otherwise(ALLOW).alias("verdict"),
        F.when(shift > 0, share).otherwise(1 - share).alias("confidence"), (F.col("n") / n).alias("support"), shift.alias("shift"),
    )
    return staged(rules.where(F.abs("shift") >= F.log(F.lit(LEAST_SHIFT))), "url-rules")


def mined_verdicts(urls: DataFrame, rules: DataFrame, url_col: str = "url") -> DataFrame:
    """(url, mined): the verdict of the strongest rule for each different URL that some rule fits.

    The rule that shifts the odds most decides; ties go to the larger support, then to more tokens
    and then to the smaller rule id.
    """
    few = rules.count() <= BROADCAST_RULES
    tokens = rules.select("rule_id", F.explode("tokens").alias("token"))
    rarity = tokens.groupBy("token").count()
    # The inverted index: each rule stands under the token that fewest rules share.
    under = tokens.join(rarity, "token").groupBy("rule_id").agg(F.min_by("token", F.struct("count", "token")).alias("token"))
    index = under.join(rules, "rule_id")
    index = F.broadcast(index) if few else index
    distinct = urls.select(F.col(url_col).alias("url")).where("url is not null").distinct().withColumn("own", url_tokens(F.col("url")))
    fits = distinct.select("url", "own", F.explode("own").alias("token")).join(index, "token").where(F.size(F.array_except("tokens", "own")) == 0)
    best = F.max_by("verdict", F.struct(F.abs("shift"), "support", F.size("tokens"), -F.col("rule_id")))
    return fits.groupBy("url").agg(best.alias("mined"))


def _fitting_rule(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> Column:
    """Struct (rule, verdict) of the longest rule that fits, or null."""
    listed = F.array(*[F.struct(F.lit(len(h + p)).alias("size"), F.lit(h + p).alias("rule"), F.lit(v).alias("verdict"), F.lit(h).alias("host"), F.lit(p).alias("path")) for v, h, p in rules])
    fits = F.filter(listed, lambda r: ((host == r["host"]) | F.endswith(host, F.concat(F.lit("."), r["host"]))) & F.startswith(path, r["path"]))
    return F.array_max(fits)


def judge_urls(urls: DataFrame, mined: DataFrame, given: list[tuple[str, str, str]], url_col: str = "url") -> DataFrame:
    """``urls`` with host, path, rule (of those given, or null) and verdict, in place of columns of these names.

    ``given`` holds (verdict, host, path); a rule fits its host and all its subdomains.
    """
    found = mined_verdicts(urls, mined, url_col)
    packed = urls.select(F.struct(*[F.col(c) for c in urls.columns]).alias("row"), F.col(url_col).alias("url"))
    named = packed.withColumns({"host": host_of(F.col("url")), "path": path_of(F.col("url"))})
    rule = _fitting_rule(F.col("host"), F.col("path"), given) if given else F.lit(None).cast("struct<size:int,rule:string,verdict:string>")
    joined = named.withColumn("given", rule).join(found, "url", "left")
    others = [F.col("row").getField(c).alias(c) for c in urls.columns if c not in ("host", "path", "rule", "verdict")]
    return joined.select(*others, "host", "path", F.col("given.rule").alias("rule"), F.coalesce("given.verdict", "mined", F.lit(ALLOW)).alias("verdict"))
