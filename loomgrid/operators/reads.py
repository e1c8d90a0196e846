"""Raw reads on restriction fragments: locating ends, insert sizes, read filters, contacts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .contacts import dedupe, valid_pairs

TILE = 1 << 16


def fragments(sites: DataFrame) -> DataFrame:
    """(chr, lo, hi, frag, first): fragments between neighbouring cut sites (chr, cut), numbered across chromosomes.

    ``first`` is the id of a chromosome's first half-fragment; a fragment has two.
    """
    w = Window.partitionBy("chr").orderBy("cut")
    pairs = sites.select("chr", F.col("cut").alias("lo"), F.lead("cut").over(w).alias("hi"), (F.row_number().over(w) - 1).alias("frag")).where("hi is not null")
    sizes = pairs.groupBy("chr").agg(F.count("*").alias("_k"))
    # One row for each chromosome.
    firsts = sizes.select("chr", (2 * F.coalesce(F.sum("_k").over(Window.orderBy("chr").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).alias("first"))
    return pairs.join(F.broadcast(firsts), "chr")


def _placed(reads: DataFrame, frags: DataFrame, k: str, tile: int) -> DataFrame:
    """One end of each read on its fragment: half-fragment id and distance to the cut site that it faces."""
    f = frags.select(F.col("chr").alias(f"c{k}"), "lo", "hi", "frag", "first", F.explode(F.sequence(F.floor((F.col("lo") + 1) / tile), F.floor(F.col("hi") / tile))).alias("_tile"))
    met = reads.withColumn("_tile", F.floor(F.col(f"p{k}") / tile)).join(f, [f"c{k}", "_tile"]).where(f"p{k} > lo and p{k} <= hi")
    forward = F.col(f"s{k}") == 1
    out = met.withColumns({f"half{k}": F.col("first") + 2 * F.col("frag") + F.when(forward, 1).otherwise(0), f"dist{k}": F.when(forward, F.col("hi") - F.col(f"p{k}")).otherwise(F.col(f"p{k}") - F.col("lo"))})
    return out.drop("_tile", "lo", "hi", "frag", "first")


def locate_ends(reads: DataFrame, sites: DataFrame, tile: int = TILE) -> DataFrame:
    """Reads with half1, dist1, half2, dist2; those with an end outside all fragments drop out."""
    frags = fragments(sites)
    return _placed(_placed(reads, frags, "1", tile), frags, "2", tile)


def reads_to_contacts(reads: DataFrame, sites: DataFrame, max_insert: int, tile: int = TILE) -> DataFrame:
    """Contacts (id1, id2, n) of half-fragments: reads deduplicated, located, short enough and valid."""
    located = locate_ends(dedupe(reads), sites, tile).where(F.col("dist1") + F.col("dist2") <= max_insert)
    pairs = located.select(F.least("half1", "half2").alias("id1"), F.greatest("half1", "half2").alias("id2"))
    return valid_pairs(pairs).groupBy("id1", "id2").agg(F.count("*").alias("n"))


def nearest_site_by_strand(reads: DataFrame, sites: DataFrame, tile: int = TILE) -> DataFrame:
    """Reads (rid, chr, pos, strand) with the first site at or above on '+', at or below on '-' (null if none)."""
    from .locate import asof

    targets = sites.select("chr", F.col("cut").alias("at"), F.col("cut").alias("id"))
    up = asof(reads.where("strand = 1").select("rid", "chr", "pos"), targets, "forward", tile)
    down = asof(reads.where("strand <> 1").select("rid", "chr", "pos"), targets, "backward", tile)
    return up.unionByName(down).select("rid", "chr", "pos", F.col("at").alias("site"))


def same_fragment_metrics(located: DataFrame) -> DataFrame:
    """(kind, n) of located reads by what their fragments tell: self circles, dangling ends, re-ligated neighbours, mapped."""
    f1, f2 = F.floor(F.col("half1") / 2), F.floor(F.col("half2") / 2)
    outward = ((F.col("p1") < F.col("p2")) & (F.col("s1") == 0)) | ((F.col("p1") > F.col("p2")) & (F.col("s1") == 1))
    kind = (
        F.when((f1 == f2) & (F.col("s1") == F.col("s2")), "same_strand").when((f1 == f2) & outward, "self_circle").when(f1 == f2, "dangling_end")
        .when((F.col("c1") == F.col("c2")) & (F.abs(f1 - f2) == 1), "neighbour").otherwise("mapped")
    )
    return located.groupBy(kind.alias("kind")).agg(F.count("*").alias("n"))


def near_site_filter(located: DataFrame, least: int) -> DataFrame:
    """Located reads both of whose ends lie at least ``least`` from the site they face."""
    return located.where((F.col("dist1") >= least) & (F.col("dist2") >= least))
