"""Sums over all possible pairs of a chromosome's elements, seen or not, without listing the pairs.

Elements lie in bins of a base size, of twice, four times that, and so on. Two bins that are ``NEAR`` or more
apart, and whose distances all lie between the same two cutoffs, are summed in closed form: with both elements' places
in their bins, u and v, the distance is size * (offset + v - u), a function of it is a short series in
v - u, and its sum over all pairs is made of products of the bins' moments. Other pairs of bins are
taken apart into halves; what is left at the base size is summed pair by pair. Which offsets are summed at
which size follows from the cutoffs alone, so it is a small table that travels to the tasks, and the work grows with the
elements times the cutoffs and not with the pairs.

Elements (chr, pos, w) have non-negative positions and a weight. Pairs at the same position are no pairs.
"""

from __future__ import annotations

import math
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

#: Bins from so many sizes on are summed by series with moments up to ORDER: the rest of a series is under (1 / NEAR) ** ORDER of its sum.
NEAR, ORDER = 8, 10
#: Bins are halved while they hold more than so many elements, as a mean over their elements; pairs of smaller ones are fewer than moments.
FEW = 8
#: Bins of a side of a block of cells, and offsets from which pairs of bins meet in blocks.
BLOCK, MANY = 1024, 64


def summing_plan(offsets: Iterable[int], levels: int, base: int, cutoffs: list[float], series: Callable[[int, int, int], list[float]]) -> list[tuple]:
    """(level, odd, offset, dbin, series): what is summed between bin b and b + offset of each size, by b being odd or not.

    ``offsets`` are those of the largest bins, base * 2 ** levels. ``series`` gives the coefficients for an
    offset, a size and the number of cutoffs below. Rows of level 0 without a series are summed pair by pair.
    """
    rows: list[tuple] = []
    above: set[int] | None = None
    here = sorted(set(offsets))
    for level in range(levels, -1, -1):
        size = base << level
        if above is not None:
            here = sorted({o for u in above for o in (2 * u - 1, 2 * u, 2 * u + 1) if o >= 0})
        apart = {o for o in here if o < NEAR or bisect_right(cutoffs, (o - 1) * size) < bisect_left(cutoffs, (o + 1) * size)}
        for o in here:
            for odd in (0, 1):
                # Bins whose parents have been summed are done.
                if above is not None and (o + odd) >> 1 not in above:
                    continue
                if o not in apart:
                    dbin = bisect_right(cutoffs, (o - 1) * size)
                    rows.append((level, odd, o, dbin, series(o, size, dbin)))
                elif level == 0:
                    rows.append((level, odd, o, None, None))
        above = apart
    return rows


def _cutoffs_under(distance: Column, cutoffs: list[float]) -> Column:
    """How many of the cutoffs lie under a distance."""
    return sum(((F.lit(float(c)) < distance).cast("int") for c in cutoffs), F.lit(0))


def log_series(offset: int, size: int, _: int) -> list[float]:
    """ln(size * (offset + t)) in powers of t."""
    return [math.log(size * offset), *((-1) ** (k + 1) / (k * offset**k) for k in range(1, ORDER + 1))]


def power_series(lines: list[tuple[float, float]]) -> Callable[[int, int, int], list[float]]:
    """exp(slope * ln d + intercept) of the line for each distance bin, in powers of t."""

    def series(offset: int, size: int, dbin: int) -> list[float]:
        slope, intercept = lines[dbin]
        out = [math.exp(slope * math.log(size * offset) + intercept)]
        for k in range(1, ORDER + 1):
            out.append(out[-1] * (slope - k + 1) / (k * offset))
        return out

    return series


def moments(elements: DataFrame, base: int, levels: int) -> DataFrame:
    """(level, chr, bin, m): sums of weight * u ** k over the elements of each bin of each size, u from -1/2 to 1/2."""
    size = F.expr(f"shiftleft({base}L, level)")
    placed = elements.withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(levels)))).withColumn("bin", F.floor(F.col("pos") / size))
    u = F.col("pos") / size - F.col("bin") - 0.5
    power, sums = F.lit(1.0), []
    for k in range(ORDER + 1):
        sums.append(F.sum(F.col("w") * F.col(f"_u{k}")).alias(f"_m{k}"))
        placed = placed.withColumn(f"_u{k}", power)
        power = F.col(f"_u{k}") * u
    return placed.groupBy("level", "chr", "bin").agg(*sums).select("level", "chr", "bin", F.array(*[f"_m{k}" for k in range(ORDER + 1)]).alias("m"))


def _halvings(elements: DataFrame, base: int, levels: int) -> int:
    """By how many of its levels the largest size is halved: not below a size whose bins hold FEW elements, as a mean over the elements."""
    if not levels:
        return 0
    at = elements.select("chr", "pos", F.explode(F.sequence(F.lit(0), F.lit(levels))).alias("level"))
    filled = at.groupBy("level", "chr", F.floor(F.col("pos") / F.expr(f"shiftleft({base}L, level)")).alias("bin")).agg(F.count("*").alias("n"))
    sparse = filled.groupBy("level").agg((F.sum(F.col("n").cast("double") * F.col("n")) / F.sum("n")).alias("mean")).where(F.col("mean") <= FEW)
    return levels - (sparse.agg(F.max("level")).first()[0] or 0)


def _closed(met: DataFrame, *keep: str) -> DataFrame:
    """``keep``, weight and value of rows with both bins' moments m1 and m2 and a series g: its sum over all pairs, (v - u) ** k by the binomial theorem."""
    schema = StructType([met.schema[c] for c in keep] + [StructField("weight", DoubleType()), StructField("value", DoubleType())])

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            m1, m2, g = (np.ascontiguousarray(batch.column(c).flatten().to_numpy(zero_copy_only=False).reshape(-1, ORDER + 1).T) for c in ("m1", "m2", "g"))
            value = np.zeros(batch.num_rows)
            for p in range(ORDER + 1):
                value += m1[p] * sum(g[p + q] * ((-1) ** p * math.comb(p + q, p)) * m2[q] for q in range(ORDER + 1 - p))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(m1[0] * m2[0]), pa.array(value)], names=[*keep, "weight", "value"])

    return met.select(*keep, "m1", "m2", "g").mapInArrow(summed, schema)


def _closed_value() -> Column:
    """The same value as an expression, for rows that are added up right behind it."""
    parts = []
    for p in range(ORDER + 1):
        inner = " + ".join(f"g[{p + q}] * {(-1) ** p * math.comb(p + q, p)}D * m2[{q}]" for q in range(ORDER + 1 - p))
        parts.append(f"m1[{p}] * ({inner})")
    return F.expr(" + ".join(parts))


def pairs_of_bins(bins: DataFrame, keep: str, reach: int | None = None, seen: DataFrame | None = None, block: int = BLOCK) -> DataFrame:
    """(chr, bin1, bin2, ``keep`` with 1 and 2): all pairs bin1 < bin2 of a chromosome's ``bins`` (chr, bin, keep), not further apart than ``reach``.

    Pairs are made in square blocks of cells: what is shuffled grows with the bins times the blocks beside them and not with the pairs, and no chromosome is one task's load.
    With ``seen`` (chr, bin1, bin2, obs), each pair once, ``obs`` comes along, null where there is none; it travels with the rows of a block.
    """
    side = lambda c: F.floor(F.col(c) / block)
    ends = bins.groupBy("chr").agg(F.min(side("bin")).alias("_low"), F.max(side("bin")).alias("_high"))
    placed = bins.join(ends, "chr")
    right, left = F.col("_high"), F.col("_low")
    if reach is not None:
        right, left = F.least(right, F.floor((F.col("bin") + reach) / block)), F.greatest(left, F.floor((F.col("bin") - reach) / block))
    a = placed.select("chr", side("bin").alias("_g1"), F.explode(F.sequence(side("bin"), right)).alias("_g2"), F.col("bin").alias("bin1"), F.col(keep).alias(f"{keep}1"))
    b = placed.select("chr", F.explode(F.sequence(left, side("bin"))).alias("_g1"), side("bin").alias("_g2"), F.col("bin").alias("bin2"), F.col(keep).alias(f"{keep}2"))
    if seen is not None:
        lists = seen.groupBy("chr", "bin1", side("bin2").alias("_g2")).agg(F.map_from_entries(F.collect_list(F.struct("bin2", "obs"))).alias("_seen"))
        a = a.join(lists, ["chr", "bin1", "_g2"], "left")
    met = a.join(b, ["chr", "_g1", "_g2"]).where("bin1 < bin2")
    if reach is not None:
        met = met.where(F.col("bin2") - F.col("bin1") <= reach)
    out = ["chr", "bin1", "bin2", f"{keep}1", f"{keep}2"]
    return met.select(*out) if seen is None else met.select(*out, F.try_element_at("_seen", F.col("bin2")).alias("obs"))


def pair_sums(elements: DataFrame, offsets: range, levels: int, base: int, cutoffs: list[float], series: Callable[[int, int, int], list[float]], of_pair: Callable[[Column, Column], Column], cells: DataFrame | None = None) -> DataFrame:
    """(chr, bin1, bin2, dbin, weight, value): sums of w1 * w2 and of w1 * w2 * f(d) over all pairs at positions pos1 < pos2.

    Bins are of size base * 2 ** levels, ``offsets`` (a range without steps) apart. A row is a part of such a pair of bins, so that rows still are to be
    added up. f is given by its ``series`` and, for a pair, by ``of_pair`` of ln d and the distance bin.
    ``dbin`` counts the cutoffs under the distance. With ``cells`` (chr, bin1, bin2) only these pairs of bins are summed.
    """
    whole, parts = _whole_and_parts(elements, offsets, levels, base, cutoffs, series, of_pair, cells)
    return parts if whole is None else parts.unionByName(whole)


def _whole_and_parts(elements: DataFrame, offsets: range, levels: int, base: int, cutoffs: list[float], series: Callable[[int, int, int], list[float]], of_pair: Callable[[Column, Column], Column], cells: DataFrame | None, seen: DataFrame | None = None) -> tuple[DataFrame | None, DataFrame]:
    """Rows of ``pair_sums``: pairs of bins that are one row each, by far the most where the offsets are many (else None), with ``obs`` of ``seen``; and the other rows."""
    spark = elements.sparkSession
    halvings = _halvings(elements, base, levels)
    levels, base = halvings, base << (levels - halvings)
    rows = summing_plan(offsets, levels, base, cutoffs, series)
    kind = "level int, odd int, offset long, dbin int, g array<double>"
    # As many rows as levels times cutoffs, and the offsets asked for.
    far = F.broadcast(spark.createDataFrame([r for r in rows if r[4] is not None], kind))
    near = F.broadcast(spark.createDataFrame([r for r in rows if r[4] is None], kind).select("odd", "offset"))
    e = elements.select("chr", F.col("pos").cast("long").alias("pos"), F.col("w").cast("double").alias("w"))
    m = moments(e, base, levels)
    # Parts of pairs of large bins that were not asked for have come along where only the sizes between tell them apart.
    lowest, highest = min(offsets, default=0), max(offsets, default=-1)

    def asked(rows: DataFrame) -> DataFrame:
        rows = rows.where((F.col("bin2") - F.col("bin1")).between(lowest, highest))
        return rows if cells is None else rows.join(cells.select("chr", "bin1", "bin2"), ["chr", "bin1", "bin2"], "left_semi")

    up = lambda b: F.expr(f"shiftright({b}, {levels} - level)")
    blocks = cells is None and len(offsets) > MANY
    left = (m.where(F.col("level") < levels) if blocks else m).withColumn("odd", F.pmod("bin", F.lit(2)).cast("int")).join(far.select("level", "odd", "offset"), ["level", "odd"]).select("level", "odd", "offset", "chr", F.col("bin").alias("b1"), (F.col("bin") + F.col("offset")).alias("b2"), F.col("m").alias("m1"))
    left = left.withColumns({"bin1": up("b1"), "bin2": up("b2")})
    if cells is None:
        left = asked(left)
    else:
        # Of the largest bins those asked for are looked up, and not all that lie so far apart.
        named = cells.select(F.lit(levels).alias("level"), "chr", "bin1", "bin2", F.col("bin1").alias("bin"), (F.col("bin2") - F.col("bin1")).alias("offset"), F.pmod("bin1", F.lit(2)).cast("int").alias("odd"))
        whole = named.join(far.select("level", "odd", "offset"), ["level", "odd", "offset"]).join(m, ["level", "chr", "bin"])
        whole = whole.select("level", "odd", "offset", "chr", F.col("bin").alias("b1"), F.col("bin2").alias("b2"), F.col("m").alias("m1"), "bin1", "bin2")
        left = whole.unionByName(asked(left.where(F.col("level") < levels)))
    met = left.join(m.select("level", "chr", F.col("bin").alias("b2"), F.col("m").alias("m2")), ["level", "chr", "b2"])
    # Coefficients come in behind the shuffle.
    closed = met.join(far, ["level", "odd", "offset"]).select("chr", "bin1", "bin2", "dbin", (F.col("m1")[0] * F.col("m2")[0]).alias("weight"), _closed_value().alias("value"))
    b = e.withColumn("b", F.floor(F.col("pos") / base))
    one = b.withColumn("odd", F.pmod("b", F.lit(2)).cast("int")).join(near, "odd").select("chr", F.col("b").alias("b1"), (F.col("b") + F.col("offset")).alias("b2"), F.col("pos").alias("pos1"), F.col("w").alias("w1"))
    one = asked(one.withColumns({"bin1": F.shiftright("b1", levels), "bin2": F.shiftright("b2", levels)}))
    two = b.select("chr", F.col("b").alias("b2"), F.col("pos").alias("pos2"), F.col("w").alias("w2"))
    pairs = one.join(two, ["chr", "b2"]).where("pos2 > pos1").withColumn("_d", (F.col("pos2") - F.col("pos1")).cast("double"))
    each = pairs.withColumn("dbin", _cutoffs_under(F.col("_d"), cutoffs)).withColumn("weight", F.col("w1") * F.col("w2"))
    listed = each.select("chr", "bin1", "bin2", "dbin", "weight", (F.col("weight") * of_pair(F.log("_d"), F.col("dbin"))).alias("value"))
    whole = None
    if blocks:
        largest = pairs_of_bins(m.where(F.col("level") == levels).select("chr", "bin", "m"), "m", highest, seen)
        known = largest.withColumns({"offset": F.col("bin2") - F.col("bin1"), "odd": F.pmod("bin1", F.lit(2)).cast("int")}).join(far.where(F.col("level") == levels), ["odd", "offset"])
        whole = _closed(known, "chr", "bin1", "bin2", "dbin", *(["obs"] if seen is not None else []))
    return whole, closed.unionByName(listed)


def pairs_within(elements: DataFrame, reach: int, keep: tuple[str, ...] = ("id", "pos")) -> DataFrame:
    """(chr, and ``keep`` with 1 and 2): pairs of elements at positions pos1 < pos2 <= pos1 + reach, met in tiles of ``reach``."""
    e = elements.withColumn("_tile", F.floor(F.col("pos") / reach))
    one = e.select("chr", F.explode(F.array(F.col("_tile"), F.col("_tile") + 1)).alias("_tile"), *[F.col(c).alias(f"{c}1") for c in keep])
    two = e.select("chr", "_tile", *[F.col(c).alias(f"{c}2") for c in keep])
    return one.join(two, ["chr", "_tile"]).where((F.col("pos2") > F.col("pos1")) & (F.col("pos2") <= F.col("pos1") + reach)).drop("_tile")


def _levels_of(elements: DataFrame, base: int) -> tuple[int, int]:
    """Levels by which the widest chromosome has few of the largest bins, and its last bin at the base size."""
    last = elements.agg(F.max(F.floor(F.col("pos") / base))).first()[0] or 0
    return max(0, int(last).bit_length() - 4), int(last)


def distance_curve(contacts: DataFrame, elements: DataFrame, cutoffs: list[float], base: int, excluded: DataFrame | None = None) -> DataFrame:
    """(dbin, total, seen, pairs, sum_log): cis contacts, and all pairs of elements that could be seen, by distance.

    ``contacts`` have chr1, pos1, chr2, pos2 and n, a count or a corrected one; ``elements`` chr and pos.
    Bin k holds distances over cutoff k - 1 and up to cutoff k. ``pairs`` counts the possible pairs and ``sum_log`` adds up their
    ln d; ``excluded`` (pos1, pos2) are pairs that cannot be seen. Bins without a possible pair are left out. ``base`` is best a size
    that holds a few elements.
    """
    levels, last = _levels_of(elements, base)
    found = pair_sums(elements.select("chr", "pos", F.lit(1.0).alias("w")), range((last >> levels) + 1), levels, base, cutoffs, log_series, lambda ln, _: ln)
    parts = found.select("dbin", F.col("weight").alias("pairs"), F.col("value").alias("sum_log"), F.lit(0.0).alias("total"), F.lit(0).cast("long").alias("seen"))

    def at(rows: DataFrame) -> DataFrame:
        d = F.abs(F.col("pos2") - F.col("pos1")).cast("double")
        return rows.withColumn("_d", d).where("_d > 0").withColumn("dbin", _cutoffs_under(F.col("_d"), cutoffs))

    cis = at(contacts.where("chr1 = chr2"))
    none = F.lit(0.0)
    parts = parts.unionByName(cis.select("dbin", none.alias("pairs"), none.alias("sum_log"), F.col("n").cast("double").alias("total"), F.lit(1).cast("long").alias("seen")))
    if excluded is not None:
        parts = parts.unionByName(at(excluded).select("dbin", F.lit(-1.0).alias("pairs"), (-F.log("_d")).alias("sum_log"), none.alias("total"), F.lit(0).cast("long").alias("seen")))
    sums = parts.groupBy("dbin").agg(F.sum("total").alias("total"), F.sum("seen").alias("seen"), F.round(F.sum("pairs")).cast("long").alias("pairs"), F.sum("sum_log").alias("sum_log"))
    return sums.where("pairs > 0")


def known_lines(lines: DataFrame) -> tuple[list[float], list[tuple[float, float]]]:
    """(cutoffs, [(slope, intercept)]) of the rows of ``models.segments``: one for each distance bin, a number that the caller has set."""
    rows = lines.select("dbin", "slope", "intercept", "upto").orderBy("dbin").collect()
    return [math.exp(r["upto"]) for r in rows if r["upto"] is not None], [(r["slope"], r["intercept"]) for r in rows]


def expected_cells(elements: DataFrame, size: int, lines: DataFrame | None = None, means: DataFrame | None = None, reach: int | None = None, halvings: int = 4, excluded: DataFrame | None = None, cells: DataFrame | None = None, seen: DataFrame | None = None) -> DataFrame:
    """(chr, bin1, bin2, expected): for all pairs of different bins the sum over possible pairs of w1 * w2 * exp(slope * ln d + intercept + mean).

    ``elements`` are (chr, pos, w), bins floor(pos / size); ``size`` is a multiple of 2 ** ``halvings``, the times that it is halved for pairs of bins
    that are near or lie across the end of a line. Without ``lines`` distance has no part. ``means`` (chr, mean) adds a
    chromosome's logarithm; ``reach`` leaves out bins that are further apart, ``excluded`` (chr, pos1, pos2, w1, w2) pairs that cannot be seen.
    Bins without an element have no row. With ``cells`` (chr, bin1, bin2) it is these that are summed, bin1 = bin2 too, and all of them have a row.
    With ``seen`` (chr, bin1, bin2, obs), each once, ``obs`` comes along, null for bins that it lacks.
    """
    if means is not None:
        # With the elements, as there may be as many cells as pairs of bins.
        factor = F.exp(F.coalesce("_mean", F.lit(0.0)))
        known = means.select("chr", F.col("mean").alias("_mean"))
        elements = elements.join(known, "chr", "left").withColumn("w", F.col("w") * F.sqrt(factor)).drop("_mean")
        if excluded is not None:
            excluded = excluded.join(known, "chr", "left").withColumn("w1", F.col("w1") * factor).drop("_mean")
    whole = None
    if lines is not None and size % (1 << halvings):
        raise ValueError(f"bins of {size} cannot be halved {halvings} times")
    bins = elements.select("chr", F.floor(F.col("pos") / size).alias("bin"), "w")
    if lines is None:
        sums = bins.groupBy("chr", "bin").agg(F.sum("w").alias("v"), F.sum(F.col("w") * F.col("w")).alias("q"))
        if cells is None:
            whole = pairs_of_bins(sums.select("chr", "bin", "v"), "v", reach, seen).select("chr", "bin1", "bin2", (F.col("v1") * F.col("v2")).alias("value"), *(["obs"] if seen is not None else []))
            parts = None
        else:
            near = cells.join(sums.select("chr", F.col("bin").alias("bin1"), F.col("v").alias("v1"), "q"), ["chr", "bin1"])
            product = F.when(F.col("bin1") == F.col("bin2"), (F.col("v1") * F.col("v2") - F.col("q")) / 2).otherwise(F.col("v1") * F.col("v2"))
            parts = near.join(sums.select("chr", F.col("bin").alias("bin2"), F.col("v").alias("v2")), ["chr", "bin2"]).select("chr", "bin1", "bin2", product.alias("value"))
        of = lambda rows: F.lit(1.0)
    else:
        cutoffs, fitted = known_lines(lines)
        last = bins.agg(F.max("bin")).first()[0] or 0
        slopes, intercepts = (F.array(*[F.lit(float(x[k])) for x in fitted]) for k in (0, 1))

        def value(ln: Column, dbin: Column) -> Column:
            return F.exp(F.get(slopes, dbin) * ln + F.get(intercepts, dbin))

        apart = range(1 if cells is None else 0, int(min(last, reach if reach is not None else last)) + 1)
        whole, parts = _whole_and_parts(elements, apart, halvings, size >> halvings, cutoffs, power_series(fitted), value, cells, seen)
        parts = parts.select("chr", "bin1", "bin2", "value")
        whole = None if whole is None else whole.drop("dbin", "weight")

        def of(rows: DataFrame) -> Column:
            d = F.abs(F.col("pos2") - F.col("pos1")).cast("double")
            return value(F.log(d), _cutoffs_under(d, cutoffs))

    if excluded is not None:
        low, high = F.least("pos1", "pos2"), F.greatest("pos1", "pos2")
        gone = excluded.select("chr", F.floor(low / size).alias("bin1"), F.floor(high / size).alias("bin2"), (-F.col("w1") * F.col("w2") * of(excluded)).alias("value"))
        gone = gone.where(("bin1 < bin2" if cells is None else "true") + (f" and bin2 - bin1 <= {reach}" if reach is not None else ""))
        parts = gone if parts is None else parts.unionByName(gone)
        if whole is not None:
            # Offsets of bins, few as such pairs are near; those cells are added up with the other parts.
            apart_by = F.col("bin2") - F.col("bin1")
            mixed = apart_by.isin([r[0] for r in gone.where(apart_by >= (1 if lines is None else NEAR)).select(apart_by).distinct().collect()])
            parts, whole = parts.unionByName(whole.where(mixed).select("chr", "bin1", "bin2", "value")), whole.where(~mixed)
    found = None if parts is None else parts.groupBy("chr", "bin1", "bin2").agg(F.sum("value").alias("expected"))
    if cells is not None:
        found = cells.select("chr", "bin1", "bin2").join(found, ["chr", "bin1", "bin2"], "left").withColumn("expected", F.coalesce("expected", F.lit(0.0)))
    if found is not None and seen is not None:
        found = found.join(seen.select("chr", "bin1", "bin2", "obs"), ["chr", "bin1", "bin2"], "left")
    if whole is None:
        return found
    whole = whole.withColumnRenamed("value", "expected")
    return whole if found is None else found.unionByName(whole)


def recentred_pairwise(elements: DataFrame) -> DataFrame:
    """``elements`` (chr, c, ...) with ``c`` divided by the square root of the mean of c1 * c2 over their chromosome's pairs, and ``mean``, its logarithm.

    Of a chromosome with one element c becomes one.
    """
    s, q, n = F.sum("c"), F.sum(F.col("c") * F.col("c")), F.count("*")
    product = F.when(n > 1, (s * s - q) / (n * (n - 1))).otherwise(F.first("c") * F.first("c"))
    sums = elements.groupBy("chr").agg(product.alias("_product"))
    return elements.join(sums, "chr").withColumn("c", F.col("c") / F.sqrt("_product")).withColumn("mean", F.log("_product")).drop("_product")
