"""Positions on elements: range joins, nearest neighbours and bins.

A position meets elements in tiles of its chromosome, an equi join that any chromosome's share of the
rows can spread over; nothing is ordered along a whole chromosome.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import written
from .ranking import exact_percentiles, running_counts

TILE = 1 << 16


def cut_sites_to_halves(sites: DataFrame) -> DataFrame:
    """n sites (chr, cut) of a chromosome to 2(n - 1) half-fragments (chr, start, stop, mid, half), split at midpoints."""
    pairs = sites.withColumn("next", F.lead("cut").over(Window.partitionBy("chr").orderBy("cut"))).where("next is not null")
    middle = F.floor((F.col("cut") + F.col("next")) / 2)
    halves = F.array(F.struct(F.lit(0).alias("half"), F.col("cut").alias("start"), middle.alias("stop")), F.struct(F.lit(1).alias("half"), middle.alias("start"), F.col("next").alias("stop")))
    out = pairs.select("chr", F.explode(halves).alias("h")).select("chr", "h.start", "h.stop", "h.half")
    return out.withColumn("mid", F.floor((F.col("start") + F.col("stop")) / 2))


def locate(points: DataFrame, elements: DataFrame, tile: int = TILE) -> DataFrame:
    """``points`` (chr, pos, ...) with the ``id`` of the element whose [start, stop) holds them; others drop out."""
    e = elements.select(F.col("chr").alias("_c"), "start", "stop", "id", F.explode(F.sequence(F.floor(F.col("start") / tile), F.floor((F.col("stop") - 1) / tile))).alias("_tile"))
    p = points.withColumn("_t", F.floor(F.col("pos") / tile))
    met = p.join(e, (p.chr == e._c) & (p._t == e._tile)).where("pos >= start and pos < stop")
    return met.select(*points.columns, "id")


def asof(points: DataFrame, targets: DataFrame, direction: str = "backward", tile: int = TILE, key: str = "rid") -> DataFrame:
    """Each point (key, chr, pos) with ``id`` and ``at`` of the last target at or before it (forward: the first at or after).

    Targets are (chr, at, id); of several at one place the smallest id counts. Inside a tile the
    answer is carried along by a window; where a tile has none before the point, the nearest tile's
    outermost target stands in. Points without a target keep null.
    """
    back = direction == "backward"
    t = targets.groupBy("chr", "at").agg(F.min("id").alias("id"))
    hits = F.struct(F.col("at").alias("at"), F.col("id").alias("id"))
    marks = t.select("chr", F.floor(F.col("at") / tile).alias("_tile"), F.col("at").alias("pos"), F.lit(0 if back else 1).alias("_kind"), F.lit(None).cast("long").alias("_key"), hits.alias("_hit"))
    asks = points.select("chr", F.floor(F.col("pos") / tile).alias("_tile"), "pos", F.lit(1 if back else 0).alias("_kind"), F.col(key).cast("long").alias("_key"), F.lit(None).cast("struct<at:bigint,id:bigint>").alias("_hit"))
    every = marks.withColumn("_hit", F.col("_hit").cast("struct<at:bigint,id:bigint>")).unionByName(asks)
    w = Window.partitionBy("chr", "_tile").orderBy("pos", "_kind")
    if back:
        found = F.last("_hit", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    else:
        found = F.first("_hit", ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing))
    inside = every.withColumn("_found", found).where("_key is not null")
    # One outermost target for each tile, then the nearest tile that has one: rows by tile, not by target.
    edge = t.groupBy("chr", F.floor(F.col("at") / tile).alias("_tile")).agg((F.max(hits) if back else F.min(hits)).alias("_edge"))
    tiles = inside.select("chr", "_tile").distinct().join(edge, ["chr", "_tile"], "full_outer")
    wt = Window.partitionBy("chr").orderBy("_tile")
    near = F.last("_edge", ignorenulls=True).over(wt.rowsBetween(Window.unboundedPreceding, -1)) if back else F.first("_edge", ignorenulls=True).over(wt.rowsBetween(1, Window.unboundedFollowing))
    carried = tiles.withColumn("_near", near).select("chr", "_tile", "_near")
    out = inside.join(carried, ["chr", "_tile"], "left").withColumn("_r", F.coalesce("_found", F.col("_near").cast("struct<at:bigint,id:bigint>")))
    return out.select(F.col("_key").alias(key), "chr", "pos", F.col("_r.at").alias("at"), F.col("_r.id").alias("id"))


def fixed_bin(position: str | Column, size: int, start: int | Column = 0) -> Column:
    p = F.col(position) if isinstance(position, str) else position
    return F.floor((p - start) / size)


def bin_start(elements: DataFrame, size: int) -> DataFrame:
    """(chr, origin): where bins of a size begin - the first mid, rounded down."""
    return elements.groupBy("chr").agg((F.floor(F.min("mid") / size) * size).alias("origin"))


def fixed_bins(elements: DataFrame, size: int) -> DataFrame:
    """``elements`` with ``bin`` counted from their chromosome's first."""
    return elements.join(F.broadcast(bin_start(elements, size)), "chr").withColumn("bin", fixed_bin("mid", size, F.col("origin"))).drop("origin")


def user_bins(elements: DataFrame, bins: DataFrame, tile: int = TILE) -> DataFrame:
    """``elements`` with ``bin``, the user's bin (chr, start, stop, bin) that holds their mid; gaps drop elements."""
    b = bins.select(F.col("chr").alias("_c"), F.col("start").alias("_start"), F.col("stop").alias("_stop"), "bin", F.explode(F.sequence(F.floor(F.col("start") / tile), F.floor((F.col("stop") - 1) / tile))).alias("_tile"))
    e = elements.withColumn("_t", F.floor(F.col("mid") / tile))
    return e.join(b, (e.chr == b._c) & (e._t == b._tile)).where("mid >= _start and mid < _stop").select(*elements.columns, "bin")


def proportional_bins(elements: DataFrame, size: int) -> DataFrame:
    """(id, chr, bin, share): the parts of each element's [start, stop) in bins, in units of the bin size."""
    spread = elements.select("id", "chr", "start", "stop", F.explode(F.sequence(F.floor(F.col("start") / size), F.floor((F.col("stop") - 1) / size))).alias("bin"))
    inside = F.least("stop", (F.col("bin") + 1) * size) - F.greatest("start", F.col("bin") * size)
    return spread.select("id", "chr", "bin", (inside / F.lit(size)).alias("share"))


def equal_count_bins(elements: DataFrame, feature: str, bins: int, key: str = "id") -> DataFrame:
    """``elements`` with ``fbin``: bins of as nearly equal counts as ties allow.

    The break behind bin i is the value of rank round(i * N / bins). Values are counted before they
    are ordered, so the order runs over different values only.
    """
    counts = written(running_counts(elements, feature), "ranks")
    total = counts.agg(F.max("upto").alias("_n"))
    ranked = counts.join(F.broadcast(total))
    breaks = ranked.select(F.col(feature).alias("_v"), (F.col("upto") - F.col("count")).alias("_from"), F.col("upto").alias("_to"), "_n").withColumn("_i", F.explode(F.sequence(F.lit(1), F.lit(bins - 1))))
    cut = F.round(F.col("_i") * F.col("_n") / bins)
    values = breaks.where((cut > F.col("_from")) & (cut <= F.col("_to"))).agg(F.array_sort(F.collect_list("_v")).alias("_breaks"))
    above = F.size(F.filter("_breaks", lambda x: x < F.col(feature)))
    return elements.join(F.broadcast(values)).withColumn("fbin", above).drop("_breaks")


def value_break_bins(elements: DataFrame, feature: str, breaks: list[float]) -> DataFrame:
    """``elements`` with ``fbin``, the number of breaks at or below the value."""
    edges = F.array(*[F.lit(float(b)) for b in breaks])
    return elements.withColumn("fbin", F.size(F.filter(edges, lambda x: x <= F.col(feature))))


def equal_width_bins(elements: DataFrame, feature: str, bins: int) -> DataFrame:
    """``elements`` with ``fbin`` of equal width between the feature's extremes; the largest value is in the last."""
    span = elements.agg(F.min(feature).alias("_low"), F.max(feature).alias("_high"))
    width = (F.col("_high") - F.col("_low")) / bins
    k = F.when(F.col("_high") > F.col("_low"), F.least(F.floor((F.col(feature) - F.col("_low")) / width), F.lit(bins - 1))).otherwise(F.lit(0))
    return elements.join(F.broadcast(span)).withColumn("fbin", k).drop("_low", "_high")


def triangular_pair(b1: Column, b2: Column, n: int) -> Column:
    """Index of an unordered pair of ``n`` bins, the diagonal included."""
    low, high = F.least(b1, b2), F.greatest(b1, b2)
    return low * (n - 1) - F.floor(low * (low - 1) / 2) + high


def regions(elements: DataFrame, spacing: int, tile: int = TILE) -> DataFrame:
    """``elements`` with ``region``: a new one opens where neighbouring mids are ``spacing`` or more apart.

    Regions are numbered within tiles of positions, and on from what the tiles before have: one row a tile.
    """
    tiled = elements.withColumn("_tile", F.floor(F.col("mid") / tile))
    w = Window.partitionBy("chr", "_tile").orderBy("mid", "id")
    gap = F.col("mid") - F.lag("mid").over(w)
    marked = tiled.withColumn("_new", F.when(gap >= spacing, 1).otherwise(0))
    ends = marked.groupBy("chr", "_tile").agg(F.min("mid").alias("_first"), F.max("mid").alias("_last"), F.sum("_new").alias("_n"))
    order = Window.partitionBy("chr").orderBy("_tile")
    opens = F.when(F.col("_first") - F.lag("_last").over(order) < spacing, 0).otherwise(1)
    starts = ends.withColumn("_opens", opens).withColumn("_from", F.sum("_opens").over(order) + F.coalesce(F.sum("_n").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) - 1)
    numbered = marked.withColumn("_in", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.join(starts.select("chr", "_tile", "_from"), ["chr", "_tile"]).select(*elements.columns, (F.col("_from") + F.col("_in")).alias("region"))


def quantile_break_bins(elements: DataFrame, column: str, breaks: list[float]) -> DataFrame:
    """``elements`` with ``fbin``: how many of the value's quantiles at the given fractions lie below it."""
    cuts = exact_percentiles(elements, column, breaks)
    return elements.join(F.broadcast(cuts)).withColumn("fbin", F.size(F.filter("cuts", lambda c: c < F.col(column)))).drop("cuts")


def bin_features(elements: DataFrame, sums: list[str], means: list[str], least: int = 5) -> DataFrame:
    """Features of each bin (chr, bin): sums, means and the count; bins with a zero drop out, and chromosomes of fewer than ``least`` bins."""
    found = elements.groupBy("chr", "bin").agg(*[F.sum(c).alias(f"sum_{c}") for c in sums], *[F.avg(c).alias(f"mean_{c}") for c in means], F.count("*").alias("n"))
    for c in found.columns[2:]:
        found = found.where(F.col(c) != 0)
    enough = found.groupBy("chr").agg(F.count("*").alias("k")).where(F.col("k") >= least).select("chr")
    return found.join(enough, "chr", "left_semi")
