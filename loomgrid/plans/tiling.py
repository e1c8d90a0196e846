"""Alignment blocks laid over the intervals, tiled and threaded; with the same result in SQL by position."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import alignments as Al
from .registry import query
from .views import Views

#: Windows of the reference that are tiled, and how many of them.
WIDTH, WINDOWS = 700, 12


def _blocks(v: Views) -> DataFrame:
    """Orders' intervals as blocks on a reference: a gap of two columns before the eleventh letter; every third block lacks the third species."""
    a = v.iv_a()
    size = (F.col("end") - F.col("start")).cast("int")
    ref = F.concat(F.lit("ACGTACGTAC--"), F.substring(F.repeat(F.lit("GATTACA"), 100), F.lit(1), size - 10))
    other = F.concat(F.repeat(F.lit("T"), (F.col("id") % 7).cast("int")), F.lit("-"), F.substring(F.repeat(F.lit("CCGT"), 200), F.lit(1), size + 1 - (F.col("id") % 7).cast("int")))
    third = F.substring(F.repeat(F.lit("A-G"), 300), F.lit(1), size + 2)

    def component(src, text):
        return F.struct(src.alias("src"), F.col("start").alias("start"), size.cast("long").alias("size"), F.lit("+").alias("strand"), F.lit(30_000_000).cast("long").alias("src_size"), text.alias("text"))

    one, two, three = (component(F.concat(F.lit(f"{s}."), "chr"), t) for s, t in (("one", ref), ("two", other), ("three", third)))
    return a.select("id", (F.col("id") % 11).cast("double").alias("score"), F.when(F.col("id") % 3 == 0, F.array(one, two)).otherwise(F.array(one, two, three)).alias("components"))


def _windows(v: Views) -> DataFrame:
    """The first stretches behind each chromosome's first block, at even distances."""
    first = v.iv_a().groupBy("chr").agg(F.min("start").alias("_s"))
    return first.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(WINDOWS - 1)))).select(F.concat_ws(":", "chr", "k").alias("id"), "chr", (F.col("_s") - 50 + F.col("k") * 20 * WIDTH).alias("start"), (F.col("_s") - 50 + F.col("k") * 20 * WIDTH + WIDTH).alias("end"))


_SIZE = 'CAST("end" - start AS INTEGER)'
_TEXTS = f"""bl AS MATERIALIZED (SELECT id, CAST(id % 11 AS DOUBLE) AS score, chr, start, "end", 'ACGTACGTAC--' || substr(repeat('GATTACA', 100), 1, {_SIZE} - 10) AS one,
    repeat('T', CAST(id % 7 AS INTEGER)) || '-' || substr(repeat('CCGT', 200), 1, {_SIZE} + 1 - CAST(id % 7 AS INTEGER)) AS two, CASE WHEN id % 3 <> 0 THEN substr(repeat('A-G', 300), 1, {_SIZE} + 2) END AS three FROM iv_a)"""


@query()
def tiled_alignment(v: Views) -> DataFrame:
    got = Al.tile_blocks(_blocks(v), _windows(v), ["one", "two", "three"], tile=1000)
    return got.select("id", *[F.col("texts")[k].alias(s) for k, s in enumerate(("one", "two", "three"))])


@query()
def threaded_alignment(v: Views) -> DataFrame:
    got = Al.thread_blocks(_blocks(v), ["two", "three"])
    return got.select("id", F.col("components")[0]["text"].alias("two"), F.col("components")[1]["text"].alias("three"))


def _columns(text: str) -> str:
    """A text's columns of the letter with number x of the reference: one, or with the gap before it three."""
    return f"CASE WHEN x < 10 THEN substr({text}, x + 1, 1) WHEN x = 10 THEN substr({text}, 11, 3) ELSE substr({text}, x + 3, 1) END"


def _register() -> None:
    from .registry import ORACLE_SQL
    from .views import sql

    windows = f"wn AS MATERIALIZED (SELECT chr || ':' || k AS id, chr, s - 50 + k * {20 * WIDTH} AS start, s - 50 + k * {20 * WIDTH} + {WIDTH} AS stop FROM (SELECT chr, min(start) AS s FROM iv_a GROUP BY 1), (SELECT unnest(range({WINDOWS})) AS k))"
    # Columns that all species have a gap in go with nobody: the reference has letters everywhere but in columns 11 and 12.
    one, two, three = (_columns(f"coalesce({t}, repeat('-', length(one)))") for t in ("one", "two", "three"))
    kept = "CASE WHEN x = 10 THEN list_filter([1, 2, 3], lambda i: i = 3 OR substr(b, i, 1) <> '-' OR substr(c, i, 1) <> '-') ELSE [1] END"
    pick = lambda t: f"list_aggregate(list_transform(keep, lambda i: substr({t}, i, 1)), 'string_agg', '')"
    ORACLE_SQL["tiled_alignment"] = sql("iv_a", "") + f""", {_TEXTS}, {windows}, po AS MATERIALIZED (SELECT wn.id, wn.chr, unnest(range(wn.start, wn.stop)) AS p FROM wn),
        hi AS MATERIALIZED (SELECT po.id, po.p, max({{'score': score, 'block': bl.id}}).block AS block FROM po LEFT JOIN bl ON po.chr = bl.chr AND po.p >= bl.start AND po.p < bl."end" GROUP BY 1, 2),
        co AS (SELECT hi.id, p, block, x, {one} AS a, {two} AS b, {three} AS c FROM (SELECT hi.*, p - bl.start AS x, one, two, three FROM hi LEFT JOIN bl ON hi.block = bl.id) hi),
        kp AS (SELECT *, {kept} AS keep FROM co)
        SELECT id, string_agg(CASE WHEN block IS NULL THEN 'N' ELSE {pick('a')} END, '' ORDER BY p) AS one, string_agg(CASE WHEN block IS NULL THEN '-' ELSE {pick('b')} END, '' ORDER BY p) AS two, string_agg(CASE WHEN block IS NULL THEN '-' ELSE {pick('c')} END, '' ORDER BY p) AS three FROM kp GROUP BY 1"""
    ORACLE_SQL["threaded_alignment"] = sql("iv_a", "") + f""", {_TEXTS}, ch AS (SELECT id, i, substr(two, i, 1) AS b, substr(three, i, 1) AS c FROM (SELECT *, unnest(generate_series(1, length(two))) AS i FROM bl WHERE three IS NOT NULL))
        SELECT id, string_agg(b, '' ORDER BY i) AS two, string_agg(c, '' ORDER BY i) AS three FROM ch WHERE b <> '-' OR c <> '-' GROUP BY 1"""


_register()
