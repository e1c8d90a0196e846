"""Matrices at many resolutions bound to tables, with the same result in SQL that lists the possible pairs of each cell."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import models as Mo
from ..operators import multires as R
from ..session import written
from .possible import _CURVE, _CUTS, _LINES, _POSSIBLE, _SEEN, _curve
from .registry import ORACLE_SQL, query
from .views import BIN, FINE, Views, sql
from .windows import _POINTS, _WEIGHTS, _contacts

LEVELS, LEAST = 5, 4
SIZES = [FINE << k for k in range(LEVELS)]

_TREE = "tr AS MATERIALIZED (" + " UNION ALL ".join(f"SELECT {LEVELS - 1 - k} AS level, CAST({size} AS BIGINT) AS size, chr1, p1 // {size} AS bin1, chr2, p2 // {size} AS bin2, CAST(sum(n) AS BIGINT) AS observed FROM en GROUP BY 3, 4, 5, 6 HAVING sum(n) >= {LEAST}" for k, size in enumerate(SIZES)) + ")"
_LINE_VIEWS = ", ".join([_CUTS, _POSSIBLE, _SEEN, "ls AS MATERIALIZED (" + _LINES.format(curve=_CURVE.format(pairs="pp", n="n")) + ")"])


def _expected(value: str, join: str = "") -> str:
    parts = " UNION ALL ".join(f"SELECT CAST({s} AS BIGINT) AS size, a.chr AS chr1, a.pos // {s} AS bin1, b.chr AS chr2, b.pos // {s} AS bin2, sum({value}) AS e FROM pw a JOIN pw b ON a.chr = b.chr AND a.pos < b.pos {join} GROUP BY 2, 3, 4, 5" for s in SIZES)
    return f"ex AS MATERIALIZED ({parts})"


_BETWEEN = ", ".join(["sm AS MATERIALIZED (" + " UNION ALL ".join(f"SELECT CAST({s} AS BIGINT) AS size, chr, pos // {s} AS bin, sum(w) AS v FROM pw GROUP BY 2, 3" for s in SIZES) + ")"])
_SCORED = """sc AS MATERIALIZED (SELECT tr.*, coalesce(e, 0) AS expected FROM tr LEFT JOIN ex USING (size, chr1, bin1, chr2, bin2) WHERE chr1 = chr2
    UNION ALL SELECT tr.*, a.v * b.v AS expected FROM tr JOIN sm a ON tr.size = a.size AND tr.chr1 = a.chr AND tr.bin1 = a.bin JOIN sm b ON tr.size = b.size AND tr.chr2 = b.chr AND tr.bin2 = b.bin WHERE chr1 <> chr2)"""
_HEAD = sql("elements be lc", "") + ", " + ", ".join([_POINTS, _WEIGHTS, _TREE])
_FEND = ", ".join([_HEAD, _expected("a.w * b.w"), _BETWEEN, _SCORED])
_DISTANCE = ", ".join([_HEAD, _LINE_VIEWS, _expected("exp(slope * ln(b.pos - a.pos) + icept)", "JOIN ls ON ln(b.pos - a.pos) > lo AND ln(b.pos - a.pos) <= hi"), _BETWEEN, _SCORED])
_CELLS = "SELECT level, size, chr1, bin1, chr2, bin2, observed, round(expected, 4) AS expected, CASE WHEN expected > 0 THEN round(log2(observed / expected), 4) END AS score FROM sc"


def _tree(v: Views, cis: bool = False) -> DataFrame:
    contacts = _contacts(v)
    return written(R.cell_tree(contacts.where("chr1 = chr2") if cis else contacts, FINE, LEVELS, LEAST), "tree")


def _weighted(v: Views) -> DataFrame:
    return v.weighted_elements().select("chr", "pos", F.col("c").alias("w"))


def _rounded(rows: DataFrame) -> DataFrame:
    return rows.withColumns({"expected": F.round("expected", 4), "score": F.round("score", 4)})


@query()
def multires_tree(v: Views) -> DataFrame:
    """All cells, within and between chromosomes, with expectations by factors."""
    return _rounded(R.with_expected(_tree(v), _weighted(v)))


ORACLE_SQL["multires_tree"] = f"{_FEND} {_CELLS}"


@query()
def multires_tree_distance(v: Views) -> DataFrame:
    """Cells within chromosomes, with expectations by the distance curve."""
    e = _weighted(v).withColumn("w", F.lit(1.0))
    return _rounded(R.with_expected(_tree(v, cis=True), e, Mo.segments(_curve(v))))


ORACLE_SQL["multires_tree_distance"] = f"{_DISTANCE} {_CELLS} WHERE chr1 = chr2"


@query()
def multires_children(v: Views) -> DataFrame:
    return R.with_children(_tree(v)).select("level", *R.KEYS, "children")


ORACLE_SQL["multires_children"] = f"""{_HEAD} SELECT p.level, p.chr1, p.bin1, p.chr2, p.bin2, CAST(coalesce(sum(CASE WHEN c.level IS NOT NULL THEN 1 << CAST(c.bin1 % 2 * 2 + c.bin2 % 2 AS INTEGER) END), 0) AS INTEGER) AS children
    FROM tr p LEFT JOIN tr c ON c.level = p.level + 1 AND c.chr1 = p.chr1 AND c.chr2 = p.chr2 AND c.bin1 // 2 = p.bin1 AND c.bin2 // 2 = p.bin2 GROUP BY ALL"""


@query()
def multires_region(v: Views) -> DataFrame:
    """A rectangle of one chromosome, by cells of 50 kb to 200 kb where the tree has them."""
    scored = R.with_expected(_tree(v, cis=True), _weighted(v))
    found = R.fetch_region(scored, "Brand#11", 0, 150 * BIN, "Brand#11", 0, 150 * BIN, 2 * FINE, 8 * FINE)
    return found.withColumns({"score": F.round("score", 4), "colour": F.round("colour", 4)})


ORACLE_SQL["multires_region"] = f"""{_FEND}, rg AS (SELECT *, CASE WHEN expected > 0 THEN log2(observed / expected) END AS score FROM sc WHERE chr1 = chr2)
    SELECT bin1 * size AS start1, (bin1 + 1) * size AS stop1, bin2 * size AS start2, (bin2 + 1) * size AS stop2, round(score, 4) AS score, round((score - lo) / (hi - lo) * 2 - 1, 4) AS colour FROM rg x, (SELECT min(score) AS lo, max(score) AS hi FROM rg)
    WHERE chr1 = 'Brand#11' AND size BETWEEN {2 * FINE} AND {8 * FINE} AND bin1 * size <= {150 * BIN} AND bin2 * size <= {150 * BIN}
    AND (SELECT count(*) FROM rg y WHERE y.chr1 = x.chr1 AND y.size = x.size // 2 AND y.size >= {2 * FINE} AND y.bin1 // 2 = x.bin1 AND y.bin2 // 2 = x.bin2) < CASE WHEN bin1 = bin2 THEN 3 ELSE 4 END"""
