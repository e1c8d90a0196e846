"""Expectation models of contacts: distance dependence, element biases, feature bins.

A model's state is one number for each element or bin; a pass over the contacts is a join with that
state and a grouped sum. Fixed numbers of passes unroll into one lazy plan; runs to convergence write
the state to the shared folder after each pass.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from .contacts import both_ends, checkpointed


def log_cutoffs(minsize: float, maxsize: float, bins: int) -> list[float]:
    """Upper ends, as distances, of log-spaced bins; the first ends at ``minsize``, the last lies past ``maxsize``."""
    a, b = math.log(minsize), math.log(maxsize)
    cuts = [a + (b - a) * k / (bins - 1) for k in range(bins)]
    return [math.exp(c) for c in cuts[:-1]] + [maxsize + 1]


def distance_bin(distance: Column, cutoffs: list[float]) -> Column:
    """Number of the first cutoff above the distance."""
    return F.size(F.filter(F.array(*[F.lit(float(c)) for c in cutoffs]), lambda c: c <= distance))


def distance_bins(contacts: DataFrame, cutoffs: list[float]) -> DataFrame:
    """(dbin, total, pairs, sum_log): cis contacts (with chr1, mid1, chr2, mid2) summed up by distance."""
    d = F.abs(F.col("mid2") - F.col("mid1"))
    cis = contacts.where("chr1 = chr2").withColumn("d", d).where("d > 0")
    return cis.groupBy(distance_bin(F.col("d"), cutoffs).alias("dbin")).agg(
        F.sum("n").alias("total"), F.count("*").alias("pairs"), F.sum(F.log("d")).alias("sum_log")
    )


def segments(bins: DataFrame) -> DataFrame:
    """(dbin, slope, intercept, upto): lines through the means of neighbouring bins, in logarithms.

    ``upto`` is the log-distance where a line ends; the last has none. One row for each distance bin,
    a number set by the caller.
    """
    w = Window.orderBy("dbin")
    points = bins.where("total > 0").select("dbin", (F.col("sum_log") / F.col("pairs")).alias("x"), F.log(F.col("total") / F.col("pairs")).alias("y"))
    near = points.withColumns({"x2": F.lead("x").over(w), "y2": F.lead("y").over(w), "last": F.lead("x", 2).over(w).isNull()}).where("x2 is not null")
    slope = (F.col("y2") - F.col("y")) / (F.col("x2") - F.col("x"))
    return near.select("dbin", slope.alias("slope"), (F.col("y") - slope * F.col("x")).alias("intercept"), F.when(~F.col("last"), F.col("x2")).alias("upto"))


def expected_by_distance(contacts: DataFrame, lines: DataFrame) -> DataFrame:
    """Cis contacts with ``expected`` = exp(slope * ln d + intercept) of the line for their distance."""
    listed = lines.agg(F.array_sort(F.collect_list(F.struct(F.coalesce("upto", F.lit(float("inf"))).alias("upto"), "slope", "intercept"))).alias("_lines"))
    ln = F.log(F.abs(F.col("mid2") - F.col("mid1")).cast("double"))
    cis = contacts.where("chr1 = chr2 and mid1 <> mid2").join(F.broadcast(listed))
    line = F.filter("_lines", lambda s: ln < s["upto"])[0]
    return cis.withColumn("_l", line).withColumn("expected", F.exp(F.col("_l.slope") * ln + F.col("_l.intercept"))).drop("_l", "_lines")


def distance_regression(contacts: DataFrame) -> DataFrame:
    """(slope, intercept, sigma, pairs) of ln n on ln d over cis contacts, without collecting any."""
    xy = contacts.where("chr1 = chr2 and mid1 <> mid2").select(F.log(F.abs(F.col("mid2") - F.col("mid1"))).alias("x"), F.log("n").alias("y"))
    fit = xy.agg(
        F.regr_slope("y", "x").alias("slope"), F.regr_intercept("y", "x").alias("intercept"), F.count("*").alias("pairs"),
        F.regr_syy("y", "x").alias("syy"), F.regr_sxy("y", "x").alias("sxy"),
    )
    # The residual's population variance is (Syy - slope * Sxy) / n.
    sigma = F.sqrt(F.greatest(F.lit(0.0), (F.col("syy") - F.col("slope") * F.col("sxy")) / F.col("pairs")))
    return fit.select("slope", "intercept", sigma.alias("sigma"), "pairs")


def _beside(elements: DataFrame, reach: int) -> tuple[DataFrame, WindowSpec]:
    """Elements in tiles of ``reach`` with those of both tiles beside, and a window over a tile; ``_own`` marks a tile's own."""
    home = F.floor(F.col("mid") / reach)
    tiled = elements.withColumn("_home", home).withColumn("_tile", F.explode(F.array(home - 1, home, home + 1)))
    return tiled.withColumn("_own", F.col("_tile") == F.col("_home")), Window.partitionBy("chr", "_tile").orderBy("mid")


def possible_partners(elements: DataFrame, mindistance: int, maxdistance: int) -> DataFrame:
    """(id, possible): elements of the same chromosome at mindistance <= d < maxdistance, either side."""
    tiled, w = _beside(elements, maxdistance)
    if mindistance:
        right = F.count("*").over(w.rangeBetween(mindistance, maxdistance - 1))
        possible = right + F.count("*").over(w.rangeBetween(-(maxdistance - 1), -mindistance))
    else:
        possible = F.count("*").over(w.rangeBetween(-(maxdistance - 1), maxdistance - 1)) - 1
    return tiled.withColumn("possible", possible).where("_own").select("id", "possible")


def weighted_range_sum(elements: DataFrame, weight: str, reach: int) -> DataFrame:
    """(id, weight_sum): the weights of elements of the chromosome within ``reach``."""
    tiled, w = _beside(elements, reach)
    return tiled.withColumn("weight_sum", F.sum(weight).over(w.rangeBetween(-reach, reach))).where("_own").select("id", "weight_sum")


def bin_sums(elements: DataFrame, value: str = "c") -> DataFrame:
    """(chr, bin, value, square): sums of the elements' values, and of their squares, by bin."""
    return elements.groupBy("chr", "bin").agg(F.sum(value).alias("value"), F.sum(F.col(value) * F.col(value)).alias("square"))


def expected_closed_form(sums: DataFrame, reach: int | None = None) -> DataFrame:
    """(chr, bin1, bin2, expected): products of bin sums over all pairs of bins of a chromosome, bin1 < bin2.

    This is the sum over every possible pair of elements, seen or not, without listing pairs of
    elements. ``reach`` bounds the distance in bins; then bins meet over an exploded offset.
    """
    a = sums.select("chr", F.col("bin").alias("bin1"), F.col("value").alias("v1"))
    b = sums.select("chr", F.col("bin").alias("bin2"), F.col("value").alias("v2"))
    if reach is None:
        met = a.join(b, "chr").where("bin1 < bin2")
    else:
        met = a.withColumn("bin2", F.explode(F.sequence(F.col("bin1") + 1, F.col("bin1") + reach))).join(b, ["chr", "bin2"])
    return met.select("chr", "bin1", "bin2", (F.col("v1") * F.col("v2")).alias("expected"))


def observed_over_expected(cells: DataFrame, sums: DataFrame) -> DataFrame:
    """Observed cells (chr, bin1, bin2, obs) with ``expected``, the product of their bins' sums; no pair of bins is listed that was not seen."""
    for k in ("1", "2"):
        cells = cells.join(sums.select("chr", F.col("bin").alias(f"bin{k}"), F.col("value").alias(f"v{k}")), ["chr", f"bin{k}"])
    return cells.select("chr", "bin1", "bin2", "obs", (F.col("v1") * F.col("v2")).alias("expected"))


def trans_means(contacts: DataFrame, elements: DataFrame) -> DataFrame:
    """(chr1, chr2, mean): contacts between two chromosomes per possible pair of their elements."""
    sizes = elements.groupBy("chr").agg(F.count("*").alias("k"))
    a = F.when(F.col("chr1") < F.col("chr2"), F.col("chr1")).otherwise(F.col("chr2"))
    b = F.when(F.col("chr1") < F.col("chr2"), F.col("chr2")).otherwise(F.col("chr1"))
    total = contacts.where("chr1 <> chr2").groupBy(a.alias("chr1"), b.alias("chr2")).agg(F.sum("n").alias("n"))
    return (
        total.join(sizes.select(F.col("chr").alias("chr1"), F.col("k").alias("k1")), "chr1")
        .join(sizes.select(F.col("chr").alias("chr2"), F.col("k").alias("k2")), "chr2")
        .select("chr1", "chr2", (F.col("n") / F.greatest(F.lit(1), F.col("k1") * F.col("k2"))).alias("mean"))
    )


def express_pass(ends: DataFrame, state: DataFrame) -> DataFrame:
    """One pass: t = mean over partners of value / (c * c_partner); c becomes c * sqrt(t).

    ``ends`` is (id, other, value), ``state`` (id, c).
    """
    met = ends.join(state, "id").join(state.select(F.col("id").alias("other"), F.col("c").alias("c_other")), "other")
    t = met.groupBy("id").agg((F.sum(F.col("value") / (F.col("c") * F.col("c_other"))) / F.count("*")).alias("t"), F.first("c").alias("c"))
    return t.select("id", (F.col("c") * F.sqrt("t")).alias("c"))


def express(contacts: DataFrame, passes: int | None = None, least_change: float = 5e-6, most_passes: int = 1000) -> DataFrame:
    """(id, c): element corrections by mean enrichment; for a number of passes or until they settle."""
    ends = checkpointed(both_ends(contacts))
    state = checkpointed(ends.select("id").distinct().withColumn("c", F.lit(1.0)))
    if passes is not None:
        for _ in range(passes):
            state = checkpointed(express_pass(ends, state))
        return state
    for _ in range(most_passes):
        new = checkpointed(express_pass(ends, state))
        change = new.join(state.withColumnRenamed("c", "old"), "id").agg(F.max(F.abs(F.col("c") / F.col("old") - 1))).first()[0]
        state = new
        if change is None or change < least_change:
            break
    return state


def express_log(contacts: DataFrame, expected: DataFrame, passes: int) -> DataFrame:
    """(id, c): additive corrections in logarithms; each pass adds half the mean residual ln n - expected - c1 - c2.

    ``expected`` is (id1, id2, e), the logarithm expected from distance.
    """
    residuals = contacts.join(expected, ["id1", "id2"]).withColumn("r", F.log("n") - F.col("e"))
    ends = both_ends(residuals, "r")
    state = ends.select("id").distinct().withColumn("c", F.lit(0.0))
    for _ in range(passes):
        met = ends.join(state, "id").join(state.select(F.col("id").alias("other"), F.col("c").alias("c_other")), "other")
        mean = F.sum(F.col("value") - F.col("c") - F.col("c_other")) / F.count("*")
        state = met.groupBy("id").agg(mean.alias("m"), F.first("c").alias("c")).select("id", (F.col("c") + 0.5 * F.col("m")).alias("c"))
    return state


def ice(matrix: DataFrame, passes: int) -> DataFrame:
    """(id, bias) by iterative correction of a symmetric matrix (id1, id2, n): rows divided by their sums, repeatedly."""
    ends = checkpointed(both_ends(matrix))
    state = ends.select("id").distinct().withColumn("bias", F.lit(1.0))
    for _ in range(passes):
        other = state.select(F.col("id").alias("other"), F.col("bias").alias("bias_other"))
        met = ends.join(state, "id").join(other, "other")
        sums = met.groupBy("id").agg(F.sum(F.col("value") / (F.col("bias") * F.col("bias_other"))).alias("s"), F.first("bias").alias("bias"))
        sums = checkpointed(sums)
        mean = sums.agg(F.avg("s").alias("mean"))
        state = checkpointed(sums.join(F.broadcast(mean)).select("id", (F.col("bias") * F.col("s") / F.col("mean")).alias("bias")))
    return state


def knight_ruiz(matrix: DataFrame, tolerance: float = 1e-6, most_outer: int = 30, most_inner: int = 20) -> DataFrame:
    """(id, x): scaling with x_i * sum_j A_ij x_j = 1, by inexact Newton steps with conjugate gradients.

    The matrix (id1, id2, n, each unordered pair once, id1 = id2 allowed) stays in Spark; each product
    with a vector is a join and a grouped sum, and of the vectors only inner products reach the driver.
    """
    off = both_ends(matrix.where("id1 <> id2"))
    ends = checkpointed(off.unionByName(matrix.where("id1 = id2").select(F.col("id1").alias("id"), F.col("id1").alias("other"), F.col("n").alias("value"))))

    def times(vector: DataFrame, column: str) -> DataFrame:
        v = vector.select(F.col("id").alias("other"), F.col(column).alias("_v"))
        return ends.join(v, "other").groupBy("id").agg(F.sum(F.col("value") * F.col("_v")).alias("_av"))

    # Rows near sum one from the start: the residuals are then of one scale with their preconditioned form.
    sums = ends.groupBy("id").agg(F.sum("value").alias("s"))
    state = sums.join(F.broadcast(sums.agg(F.avg("s").alias("mean")))).select("id", (1 / F.sqrt("mean")).alias("x"))
    state = checkpointed(state.join(times(state, "x"), "id").select("id", "x", (F.col("x") * F.col("_av")).alias("v")))
    for _ in range(most_outer):
        rho = state.agg(F.sum((1 - F.col("v")) ** 2)).first()[0]
        if rho is None or rho <= tolerance**2:
            break
        stop, old = max(1e-2 * rho, tolerance**2), None
        # y = 1 is the current point in relative terms; Z preconditions by v.
        inner = checkpointed(state.select("id", "x", "v", F.lit(1.0).alias("y"), (1 - F.col("v")).alias("r"), F.lit(0.0).alias("p")))
        for k in range(most_inner):
            z = F.col("r") / F.col("v")
            now = inner.agg(F.sum(F.col("r") * z)).first()[0]
            if k and now <= stop:
                break
            beta = 0.0 if k == 0 else now / old
            old = now
            inner = inner.withColumn("p", z + beta * F.col("p"))
            xp = inner.withColumn("_xp", F.col("x") * F.col("p"))
            w = inner.join(times(xp, "_xp"), "id").withColumn("w", F.col("x") * F.col("_av") + F.col("v") * F.col("p")).drop("_av")
            inner = checkpointed(w)
            alpha = now / inner.agg(F.sum(F.col("p") * F.col("w"))).first()[0]
            # Steps stay within the cone where all factors are positive.
            low = inner.agg(F.min(F.col("y") + alpha * F.col("p")), F.max(F.col("y") + alpha * F.col("p"))).first()
            if low[0] <= 0.1 or low[1] >= 3.0:
                bound = F.when(F.col("p") < 0, (0.1 - F.col("y")) / F.col("p")).when(F.col("p") > 0, (3.0 - F.col("y")) / F.col("p"))
                alpha = min(alpha, inner.agg(F.min(bound)).first()[0])
                inner = inner.withColumn("y", F.col("y") + alpha * F.col("p"))
                break
            inner = inner.withColumn("y", F.col("y") + alpha * F.col("p")).withColumn("r", F.col("r") - alpha * F.col("w"))
        state = checkpointed(inner.select("id", (F.col("x") * F.col("y")).alias("x")))
        state = checkpointed(state.join(times(state, "x"), "id").select("id", "x", (F.col("x") * F.col("_av")).alias("v")))
    return state.select("id", "x")


def probability(contacts: DataFrame, possible: DataFrame, mean: float, passes: int = 20, rate: float = 0.5, least_change: float = 5e-4, kind: str = "poisson") -> DataFrame:
    """(id, c): element factors of largest likelihood for counts with expectation mean * c1 * c2.

    ``possible`` (id1, id2) lists every pair that could be seen, contacts those that were. Gradients
    are grouped sums over pairs; a step that worsens the likelihood is halved, factors stay in
    [0.01, 100]. ``kind`` is "poisson" on counts or "binomial" on seen / not seen.
    """
    pairs = checkpointed(possible.join(contacts.select("id1", "id2", "n"), ["id1", "id2"], "left").select("id1", "id2", F.coalesce("n", F.lit(0)).cast("double").alias("n")))
    ends = pairs.select(F.col("id1").alias("id"), "n").unionByName(pairs.select(F.col("id2").alias("id"), "n"))
    state = checkpointed(ends.groupBy("id").agg(F.greatest(F.lit(0.1), F.sqrt(F.sum("n") / (F.count("*") * mean))).alias("c"), F.count("*").alias("k")))

    def with_state(s: DataFrame) -> DataFrame:
        a = s.select(F.col("id").alias("id1"), F.col("c").alias("c1"))
        b = s.select(F.col("id").alias("id2"), F.col("c").alias("c2"))
        return pairs.join(a, "id1").join(b, "id2").withColumn("m", F.lit(mean) * F.col("c1") * F.col("c2"))

    seen = F.col("n") > 0
    rest = F.greatest(F.lit(1e-7), 1 - F.col("m"))
    cost = F.col("m") - F.col("n") * F.log("m") if kind == "poisson" else F.when(seen, -F.log("m")).otherwise(-F.log(rest))
    slope = (F.col("m") - F.col("n")) if kind == "poisson" else F.when(seen, -1.0).otherwise(F.col("m") / rest)
    best = with_state(state).agg(F.sum(cost)).first()[0]
    for _ in range(passes):
        if best is None:
            break
        met = with_state(state).withColumn("g", slope)
        g = met.select(F.col("id1").alias("id"), "g").unionByName(met.select(F.col("id2").alias("id"), "g")).groupBy("id").agg(F.sum("g").alias("g"))
        moved = checkpointed(state.join(g, "id").withColumn("g", F.col("g") / (F.col("c") * F.col("k"))))
        step, settled = rate, True
        for _ in range(10):
            new = moved.select("id", F.greatest(F.lit(0.01), F.least(F.lit(100.0), F.col("c") - step * F.col("g"))).alias("c"), "k")
            now = with_state(new).agg(F.sum(cost)).first()[0]
            if now < best:
                settled = False
                break
            step /= 2
        if settled:
            break
        change = moved.agg(F.max(F.abs(F.col("g") * step))).first()[0]
        state, best = checkpointed(new), now
        if change < least_change:
            break
    return state.select("id", "c")


def feature_pair_counts(contacts: DataFrame, bins: int) -> DataFrame:
    """(pbin, total, pairs): contacts (with fbin1, fbin2) by the unordered pair of their elements' feature bins."""
    from .locate import triangular_pair

    return contacts.groupBy(triangular_pair(F.col("fbin1"), F.col("fbin2"), bins).alias("pbin")).agg(F.sum("n").alias("total"), F.count("*").alias("pairs"))


def possible_feature_pairs(elements: DataFrame) -> DataFrame:
    """(fbin1, fbin2, possible): pairs of different elements by feature bins, from the bins' counts alone."""
    k = elements.groupBy("fbin").agg(F.count("*").alias("k"))
    a, b = k.select(F.col("fbin").alias("fbin1"), F.col("k").alias("k1")), k.select(F.col("fbin").alias("fbin2"), F.col("k").alias("k2"))
    same = F.col("k1") * (F.col("k1") - 1) / 2
    # One row for each bin: a number set by the caller.
    return a.join(F.broadcast(b), F.col("fbin1") <= F.col("fbin2")).select("fbin1", "fbin2", F.when(F.col("fbin1") == F.col("fbin2"), same).otherwise(F.col("k1") * F.col("k2")).cast("long").alias("possible"))


def seeds(counts: DataFrame, dimensions: list[str]) -> DataFrame:
    """Marginals of a count table (dimensions, observed, possible): one row for each value of each dimension."""
    every = F.explode(F.array(*[F.struct(F.lit(d).alias("dimension"), F.col(d).cast("long").alias("value")) for d in dimensions]))
    return counts.select("observed", "possible", every.alias("d")).groupBy("d.dimension", "d.value").agg(
        F.sum("observed").alias("observed"), F.sum("possible").alias("possible"), (F.sum("observed") / F.sum("possible")).alias("ratio")
    )


def fit_feature_bins(counts: DataFrame, dimensions: list[str], passes: int) -> DataFrame:
    """(dimension, value, correction): multiplicative corrections of feature bins.

    ``counts`` (dimensions, observed, possible) is one row for each combination of bins. The
    expectation is the overall rate times the possible count times the corrections; each pass sets one
    dimension after the other to observed over expected, the maximum of the Poisson likelihood with
    the others held.
    """
    counts = checkpointed(counts)
    rate = counts.agg((F.sum("observed") / F.sum("possible")).alias("_rate"))
    base = counts.join(F.broadcast(rate)).withColumn("_e", F.col("possible") * F.col("_rate"))
    state = {d: base.select(d).distinct().withColumn(f"_c_{d}", F.lit(1.0)) for d in dimensions}
    for _ in range(passes):
        for d in dimensions:
            met, factor = base, F.lit(1.0)
            for k, s in state.items():
                met = met.join(s, k)
                factor = factor * F.col(f"_c_{k}")
            sums = met.groupBy(d).agg(F.sum("observed").alias("_o"), F.sum(F.col("_e") * factor).alias("_x"), F.first(f"_c_{d}").alias("_c"))
            state[d] = sums.select(d, F.when(F.col("_x") > 0, F.col("_c") * F.col("_o") / F.col("_x")).otherwise(F.col("_c")).alias(f"_c_{d}"))
    out = None
    for d, s in state.items():
        part = s.select(F.lit(d).alias("dimension"), F.col(d).cast("long").alias("value"), F.col(f"_c_{d}").alias("correction"))
        out = part if out is None else out.unionByName(part)
    return out


def apply_feature_bins(pairs: DataFrame, corrections: DataFrame, dimensions: list[str], column: str = "expected") -> DataFrame:
    """``pairs`` with ``column`` multiplied by the correction of each dimension's bin (one without counts as 1)."""
    for d in dimensions:
        c = corrections.where(F.col("dimension") == d).select(F.col("value").alias(d), F.col("correction").alias("_c"))
        pairs = pairs.join(F.broadcast(c), d, "left").withColumn(column, F.col(column) * F.coalesce("_c", F.lit(1.0))).drop("_c")
    return pairs


def recentred(values: DataFrame, group: str, column: str) -> DataFrame:
    """``values`` with ``column`` divided by its mean within ``group``."""
    means = values.groupBy(group).agg(F.avg(column).alias("_mean"))
    return values.join(means, group).withColumn(column, F.col(column) / F.col("_mean")).drop("_mean")


def poisson_regression(rows: DataFrame, count: str, features: list[str]) -> DataFrame:
    """``rows`` with ``expected`` counts by a Poisson model with a log link, fitted by Spark ML."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import GeneralizedLinearRegression

    x = VectorAssembler(inputCols=features, outputCol="_x").transform(rows)
    model = GeneralizedLinearRegression(family="poisson", link="log", featuresCol="_x", labelCol=count, predictionCol="expected", maxIter=25).fit(x)
    return model.transform(x).drop("_x")


def ice_by_trans(contacts: DataFrame, passes: int) -> DataFrame:
    """(id1, id2, n, corrected): all contacts (with chr1, chr2) divided by biases that their trans part is balanced with.

    Elements without trans contacts keep a bias of 1.
    """
    bias = ice(contacts.where("chr1 <> chr2").select("id1", "id2", "n"), passes)
    out = contacts.select("id1", "id2", "n")
    for k in ("1", "2"):
        out = out.join(bias.select(F.col("id").alias(f"id{k}"), F.col("bias").alias(f"b{k}")), f"id{k}", "left")
    size = F.coalesce("b1", F.lit(1.0)) * F.coalesce("b2", F.lit(1.0))
    return out.select("id1", "id2", "n", (F.col("n") / size).alias("corrected"))


def ice_damped(contacts: DataFrame, passes: int, damping: float = 0.6) -> DataFrame:
    """(id, bias) after so many passes: marginals over their mean, less one, times ``damping``, plus one."""
    ends = checkpointed(both_ends(contacts))
    state = ends.select("id").distinct().withColumn("bias", F.lit(1.0))
    for _ in range(passes):
        other = state.select(F.col("id").alias("other"), F.col("bias").alias("b2"))
        sums = ends.join(state, "id").join(other, "other").groupBy("id", "bias").agg(F.sum(F.col("value") / (F.col("bias") * F.col("b2"))).alias("s"))
        mean = sums.agg(F.avg("s").alias("mean"))
        step = 1 + damping * (F.col("s") / F.col("mean") - 1)
        state = checkpointed(sums.join(F.broadcast(mean)).select("id", (F.col("bias") * step).alias("bias")))
    return state


def trans_mean(contacts: DataFrame, elements: DataFrame) -> DataFrame:
    """One row: trans counts (contacts with chr1, chr2) over the possible trans pairs between strands of elements (chr, strand)."""
    sizes = elements.groupBy("chr").agg(F.count_if(F.col("strand") == "+").alias("plus"), F.count_if(F.col("strand") != "+").alias("minus"))
    # Pairs of different strands on different chromosomes: all of them less those within a chromosome.
    possible = sizes.agg((F.sum("plus") * F.sum("minus") - F.sum(F.col("plus") * F.col("minus"))).alias("possible"))
    total = contacts.where("chr1 <> chr2").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total"))
    return total.join(possible).select("total", "possible", (F.col("total") / F.col("possible")).alias("mean"))


def log_normal_fit(contacts: DataFrame, passes: int, rate: float = 0.5) -> DataFrame:
    """(id, c): corrections under a log-normal model of counts: gradient steps on the squared residuals of
    ln n - distance line - c1 - c2, each element's step being ``rate`` times its mean residual.

    ``contacts`` are cis pairs with mid1 and mid2; the line is the regression of ln n on ln distance.
    """
    rows = contacts.where("mid1 <> mid2").withColumns({"x": F.log(F.abs(F.col("mid2") - F.col("mid1"))), "y": F.log("n")})
    line = rows.agg(F.regr_slope("y", "x").alias("slope"), F.regr_intercept("y", "x").alias("intercept"))
    left = rows.join(F.broadcast(line)).select("id1", "id2", (F.col("y") - F.col("slope") * F.col("x") - F.col("intercept")).alias("n"))
    ends = checkpointed(both_ends(left))
    state = ends.select("id").distinct().withColumn("c", F.lit(0.0))
    for _ in range(passes):
        other = state.select(F.col("id").alias("other"), F.col("c").alias("c2"))
        residual = F.col("value") - F.col("c") - F.col("c2")
        state = checkpointed(ends.join(state, "id").join(other, "other").groupBy("id", "c").agg(F.avg(residual).alias("r")).select("id", (F.col("c") + rate * F.col("r")).alias("c")))
    return state


def log_normal_likelihood(contacts: DataFrame, state: DataFrame) -> DataFrame:
    """One row: pairs and the sum of squared residuals that ``log_normal_fit`` lowers."""
    rows = contacts.where("mid1 <> mid2").withColumns({"x": F.log(F.abs(F.col("mid2") - F.col("mid1"))), "y": F.log("n")})
    line = rows.agg(F.regr_slope("y", "x").alias("slope"), F.regr_intercept("y", "x").alias("intercept"))
    for k in ("1", "2"):
        rows = rows.join(state.select(F.col("id").alias(f"id{k}"), F.col("c").alias(f"c{k}")), f"id{k}")
    residual = F.col("y") - F.col("slope") * F.col("x") - F.col("intercept") - F.col("c1") - F.col("c2")
    return rows.join(F.broadcast(line)).agg(F.count("*").alias("pairs"), F.sum(residual * residual).alias("squares"))
