"""Matrices at many resolutions: a tree of cells, each split in four where its parts have been seen often enough.

Level 0 has the largest bins, each level halves them. Counts are rolled up from the finest level, so contacts
are read once; a cell with enough contacts has a parent with enough, and the tree is the set of such cells. Expectations are
made for these cells alone. The diagonal belongs to the tree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .pair_sums import expected_cells

KEYS = ("chr1", "bin1", "chr2", "bin2")


def cell_tree(contacts: DataFrame, finest: int, levels: int, least: float) -> DataFrame:
    """(level, size, chr1, bin1, chr2, bin2, observed): all cells of so many levels with ``least`` contacts or more.

    ``contacts`` are (chr1, pos1, chr2, pos2, n) with the smaller name, and within a chromosome the smaller position, first.
    """
    rows = contacts.groupBy("chr1", F.floor(F.col("pos1") / finest).alias("bin1"), "chr2", F.floor(F.col("pos2") / finest).alias("bin2")).agg(F.sum("n").alias("observed"))
    out = None
    for level in range(levels - 1, -1, -1):
        kept = rows.where(F.col("observed") >= least).select(F.lit(level).alias("level"), F.lit(finest << (levels - 1 - level)).cast("long").alias("size"), *KEYS, "observed")
        out = kept if out is None else out.unionByName(kept)
        rows = rows.groupBy("chr1", F.shiftright("bin1", 1).alias("bin1"), "chr2", F.shiftright("bin2", 1).alias("bin2")).agg(F.sum("observed").alias("observed"))
    return out


def with_expected(tree: DataFrame, elements: DataFrame, lines: DataFrame | None = None, means: DataFrame | None = None, halvings: int = 3, trans_mean: float = 1.0) -> DataFrame:
    """``tree`` with ``expected``, the sum over the possible pairs of elements (chr, pos, w) in a cell, and ``score``, log2 of observed over it.

    ``lines`` and ``means`` are those of ``pair_sums.expected_cells``; between chromosomes a pair counts w1 * w2 * ``trans_mean``.
    ``tree`` is read once for each level and best written before.
    """
    sizes = sorted(r["size"] for r in tree.select("size").distinct().collect())
    out = None
    for size in sizes:
        rows = tree.where(F.col("size") == size)
        cis, trans = rows.where("chr1 = chr2"), rows.where("chr1 <> chr2")
        found = expected_cells(elements, size, lines, means, halvings=halvings, cells=cis.select(F.col("chr1").alias("chr"), "bin1", "bin2"))
        inside = cis.join(found.select(F.col("chr").alias("chr1"), "bin1", "bin2", "expected"), ["chr1", "bin1", "bin2"]).select(*tree.columns, "expected")
        sums = elements.groupBy("chr", F.floor(F.col("pos") / size).alias("bin")).agg(F.sum("w").alias("v"))
        side = lambda k: sums.select(F.col("chr").alias(f"chr{k}"), F.col("bin").alias(f"bin{k}"), F.col("v").alias(f"v{k}"))  # noqa: B023, E731
        between = trans.join(side(1), ["chr1", "bin1"]).join(side(2), ["chr2", "bin2"]).select(*tree.columns, (F.col("v1") * F.col("v2") * trans_mean).alias("expected"))
        part = inside.unionByName(between)
        out = part if out is None else out.unionByName(part)
    if out is None:
        out = tree.withColumn("expected", F.lit(0.0))
    return out.withColumn("score", F.when(F.col("expected") > 0, F.log2(F.col("observed") / F.col("expected"))))


def with_children(tree: DataFrame) -> DataFrame:
    """``tree`` with ``children``: the parts of a cell that are in the tree, as bits 1, 2, 4, 8 for (0, 0), (0, 1), (1, 0), (1, 1)."""
    bit = F.pow(F.lit(2), F.pmod("bin1", F.lit(2)) * 2 + F.pmod("bin2", F.lit(2))).cast("int")
    below = tree.where("level > 0").groupBy((F.col("level") - 1).alias("level"), "chr1", F.shiftright("bin1", 1).alias("bin1"), "chr2", F.shiftright("bin2", 1).alias("bin2")).agg(F.sum(bit).cast("int").alias("children"))
    return tree.join(below, ["level", *KEYS], "left").withColumn("children", F.coalesce("children", F.lit(0)))


def fetch_region(tree: DataFrame, chr1: str, start1: int, stop1: int, chr2: str, start2: int, stop2: int, finest: int, coarsest: int) -> DataFrame:
    """(start1, stop1, start2, stop2, score, colour): of each place of a rectangle the finest cells of sizes from ``finest`` to ``coarsest``.

    A cell is left out where all of its parts are there: four, or three on the diagonal. Parts
    outside of the rectangle count as there if the tree has them. ``colour`` is the score from -1, the tree's lowest, to 1, its highest.
    """
    extremes = tree.agg(F.min("score").alias("_low"), F.max("score").alias("_high"))
    here = tree.where((F.col("chr1") == chr1) & (F.col("chr2") == chr2) & F.col("size").between(finest, coarsest))

    def touches(k: str, start: int, stop: int) -> Column:
        return (F.col(f"bin{k}") * F.col("size") <= stop) & ((F.col(f"bin{k}") + 1) * F.col("size") >= start)

    parts = tree.where((F.col("chr1") == chr1) & (F.col("chr2") == chr2) & (F.col("size") >= finest) & (F.col("level") > 0))
    full = parts.groupBy((F.col("level") - 1).alias("level"), F.shiftright("bin1", 1).alias("bin1"), F.shiftright("bin2", 1).alias("bin2")).agg(F.count("*").alias("_parts"))
    needed = F.when(F.lit(chr1 == chr2) & (F.col("bin1") == F.col("bin2")), 3).otherwise(4)
    open_cells = here.where(touches("1", start1, stop1) & touches("2", start2, stop2)).join(full, ["level", "bin1", "bin2"], "left").where(F.coalesce("_parts", F.lit(0)) < needed)
    low = lambda k: F.col(f"bin{k}") * F.col("size")
    width = F.col("_high") - F.col("_low")
    colour = F.when(width > 0, (F.col("score") - F.col("_low")) / width * 2 - 1).otherwise(0.0)
    return open_cells.join(F.broadcast(extremes)).select(
        low("1").alias("start1"), (low("1") + F.col("size")).alias("stop1"), low("2").alias("start2"), (low("2") + F.col("size")).alias("stop2"), "score", colour.alias("colour")
    )


def level_for(sizes: list[int], wanted: int) -> int | None:
    """The largest of the tree's bin sizes that is not over the wanted one; None if all are."""
    return max((s for s in sizes if s <= wanted), default=None)
