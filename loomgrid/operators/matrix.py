"""Binned matrices as rows (chr1, bin1, chr2, bin2, obs): every cell that is not zero, each unordered pair once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ranking import exact_percentiles


def binned_cis(contacts: DataFrame) -> DataFrame:
    """(chr, bin1, bin2, obs): contacts (chr1, bin1, chr2, bin2, n) of one chromosome and different bins."""
    low, high = F.least("bin1", "bin2"), F.greatest("bin1", "bin2")
    cis = contacts.where("chr1 = chr2 and bin1 <> bin2")
    return cis.groupBy(F.col("chr1").alias("chr"), low.alias("bin1"), high.alias("bin2")).agg(F.sum("n").alias("obs"))


def binned_trans(contacts: DataFrame) -> DataFrame:
    """(chr1, bin1, chr2, bin2, obs) of contacts between chromosomes, the smaller name first."""
    a, b = (F.struct(F.col(f"chr{k}").alias("chr"), F.col(f"bin{k}").alias("bin")) for k in (1, 2))
    low, high = F.least(a, b), F.greatest(a, b)
    trans = contacts.where("chr1 <> chr2").select(low.alias("a"), high.alias("b"), "n")
    return trans.groupBy("a", "b").agg(F.sum("n").alias("obs")).select(F.col("a.chr").alias("chr1"), F.col("a.bin").alias("bin1"), F.col("b.chr").alias("chr2"), F.col("b.bin").alias("bin2"), "obs")


def rebin(cells: DataFrame, factor: int, keys: tuple[str, ...] = ("chr",), values: tuple[str, ...] = ("obs",)) -> DataFrame:
    """Cells of ``factor`` times the bin size; those that fall on the diagonal are left out for cis keys."""
    b1, b2 = F.floor(F.col("bin1") / factor), F.floor(F.col("bin2") / factor)
    out = cells.groupBy(*keys, b1.alias("bin1"), b2.alias("bin2")).agg(*[F.sum(v).alias(v) for v in values])
    return out.where("bin1 <> bin2") if "chr" in keys else out


def mirrored(cells: DataFrame) -> DataFrame:
    """Cis cells with both (bin1, bin2) and (bin2, bin1)."""
    flipped = {"bin1": F.col("bin2"), "bin2": F.col("bin1")}
    return cells.unionByName(cells.where("bin1 <> bin2").select([flipped.get(c, F.col(c)).alias(c) for c in cells.columns]))


def marginals(cells: DataFrame, value: str = "obs") -> DataFrame:
    """(chr, bin, total, cells): sums over rows of the symmetric cis matrix."""
    return mirrored(cells).groupBy("chr", F.col("bin1").alias("bin")).agg(F.sum(value).alias("total"), F.count("*").alias("cells"))


def remove_diagonal(cells: DataFrame, m: int) -> DataFrame:
    return cells.where(F.abs(F.col("bin1") - F.col("bin2")) > m)


def poor_bins(cells: DataFrame, cutoff: float) -> DataFrame:
    """(chr, bin): bins whose total lies below the exact percentile ``cutoff`` of all totals."""
    sums = marginals(cells)
    return sums.join(F.broadcast(exact_percentiles(sums, "total", [cutoff]))).where(F.col("total") < F.col("cuts")[0]).select("chr", "bin")


def without_bins(cells: DataFrame, bins: DataFrame) -> DataFrame:
    """Cells of which neither side is among ``bins`` (chr, bin)."""
    for side in ("bin1", "bin2"):
        cells = cells.join(bins.select("chr", F.col("bin").alias(side)), ["chr", side], "left_anti")
    return cells


def standalone_bins(cells: DataFrame, offset: int) -> DataFrame:
    """(chr, bin): bins in runs of at most ``offset`` neighbouring bins with any cell."""
    bins = marginals(cells).select("chr", "bin")
    w = Window.partitionBy("chr").orderBy("bin")
    runs = bins.withColumn("_run", F.col("bin") - F.row_number().over(w))
    size = runs.groupBy("chr", "_run").agg(F.count("*").alias("_n"))
    return runs.join(size, ["chr", "_run"]).where(F.col("_n") <= offset).select("chr", "bin")


def truncate_trans(cells: DataFrame, high: float) -> DataFrame:
    """Trans cells with ``obs`` above the exact percentile 1 - ``high`` brought down to it."""
    cut = exact_percentiles(cells, "obs", [1 - high])
    return cells.join(F.broadcast(cut)).withColumn("obs", F.least(F.col("obs").cast("double"), F.col("cuts")[0])).drop("cuts")


def block_average(cells: DataFrame) -> DataFrame:
    """Cells (chr1, chr2) divided by the mean of their block's cells."""
    means = cells.groupBy("chr1", "chr2").agg(F.avg("obs").alias("_mean"))
    return cells.join(means, ["chr1", "chr2"]).withColumn("ratio", F.col("obs") / F.col("_mean")).drop("_mean")


def chromosome_pair_means(cells: DataFrame) -> DataFrame:
    return cells.groupBy("chr1", "chr2").agg(F.sum("obs").alias("total"), F.count("*").alias("cells"), F.avg("obs").alias("mean"))


def cis_to_total_per_bin(contacts: DataFrame) -> DataFrame:
    """(chr, bin, cis, total, ratio) from contacts (chr1, bin1, chr2, bin2, n)."""
    cis = F.when(F.col("chr1") == F.col("chr2"), F.col("n")).otherwise(0)
    marked = contacts.withColumn("_cis", cis)
    ends = marked.select(F.col("chr1").alias("chr"), F.col("bin1").alias("bin"), "n", "_cis").unionByName(marked.select(F.col("chr2").alias("chr"), F.col("bin2").alias("bin"), "n", "_cis"))
    sums = ends.groupBy("chr", "bin").agg(F.sum("_cis").alias("cis"), F.sum("n").alias("total"))
    return sums.withColumn("ratio", F.col("cis") / F.col("total"))


def matvec(contacts: DataFrame, vector: DataFrame) -> DataFrame:
    """(id, y): product of the symmetric matrix (id1, id2, n) with ``vector`` (id, x)."""
    a = contacts.join(vector.select(F.col("id").alias("id2"), "x"), "id2").select(F.col("id1").alias("id"), (F.col("n") * F.col("x")).alias("v"))
    b = contacts.where("id1 <> id2").join(vector.select(F.col("id").alias("id1"), "x"), "id1").select(F.col("id2").alias("id"), (F.col("n") * F.col("x")).alias("v"))
    return a.unionByName(b).groupBy("id").agg(F.sum("v").alias("y"))


def smooth(cells: DataFrame, width: int, normalise: bool = True) -> DataFrame:
    """(chr, bin1, bin2, smoothed): 2-D average over cells that exist, weight 1 - L1 distance / (width + 1)."""
    offsets = F.expr(f"explode(flatten(transform(sequence(-{width}, {width}), i -> transform(sequence(abs(i) - {width}, {width} - abs(i)), j -> named_struct('i', i, 'j', j)))))")
    full = mirrored(cells)
    spread = full.select("chr", "bin1", "bin2", "obs", offsets.alias("o"))
    weight = 1 - (F.abs(F.col("o.i")) + F.abs(F.col("o.j"))) / F.lit(width + 1)
    to = spread.select("chr", (F.col("bin1") + F.col("o.i")).alias("bin1"), (F.col("bin2") + F.col("o.j")).alias("bin2"), (F.col("obs") * weight).alias("v"), weight.alias("w"))
    sums = to.groupBy("chr", "bin1", "bin2").agg(F.sum("v").alias("v"), F.sum("w").alias("w"))
    value = F.col("v") / F.col("w") if normalise else F.col("v")
    return sums.join(cells.select("chr", "bin1", "bin2"), ["chr", "bin1", "bin2"]).select("chr", "bin1", "bin2", value.alias("smoothed"))


def correlation_by_distance(a: DataFrame, b: DataFrame, bin_of: Column) -> DataFrame:
    """(dbin, n, r): Pearson correlation of the logs of two matrices' common cells by distance bin; not a number where all cells of one have the same value."""
    met = a.withColumnRenamed("obs", "x").join(b.withColumnRenamed("obs", "y"), ["chr", "bin1", "bin2"]).where("x > 0 and y > 0")
    x, y = F.log("x"), F.log("y")
    r = F.coalesce(F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y)), F.lit(float("nan")))
    return met.groupBy(bin_of.alias("dbin")).agg(F.count("*").alias("n"), r.alias("r"))


def scaling_curve(contacts: DataFrame, ratio: float) -> DataFrame:
    """(dbin, total, pairs): contacts (with mids) by logarithmic distance bins of a ratio."""
    d = F.abs(F.col("mid2") - F.col("mid1"))
    cis = contacts.where("chr1 = chr2").withColumn("d", d).where("d > 0")
    return cis.groupBy(F.floor(F.log("d") / F.log(F.lit(ratio))).alias("dbin")).agg(F.sum("n").alias("total"), F.count("*").alias("pairs"))


def multi_resolution(cells: DataFrame, levels: int, least: int = 1) -> DataFrame:
    """(level, chr, bin1, bin2, obs): each level halves the resolution of the one below; cells below ``least`` are left out."""
    rows, out = cells, cells.withColumn("level", F.lit(0))
    for level in range(1, levels):
        rows = rows.groupBy("chr", F.floor(F.col("bin1") / 2).alias("bin1"), F.floor(F.col("bin2") / 2).alias("bin2")).agg(F.sum("obs").alias("obs"))
        out = out.unionByName(rows.withColumn("level", F.lit(level)))
    return out.where(F.col("obs") >= least)


def fetch_finest(levels: DataFrame, chrom: str, low: int, high: int) -> DataFrame:
    """Of a rectangle (in bins of level 0) the finest level that has each of its cells: (level, bin1, bin2, obs).

    A cell stands if none of the four below it does.
    """
    scale = F.pow(F.lit(2), F.col("level")).cast("long")
    inside = levels.where((F.col("chr") == chrom) & ((F.col("bin1") + 1) * scale > low) & (F.col("bin1") * scale < high) & ((F.col("bin2") + 1) * scale > low) & (F.col("bin2") * scale < high))
    below = inside.select((F.col("level") + 1).alias("level"), F.floor(F.col("bin1") / 2).alias("bin1"), F.floor(F.col("bin2") / 2).alias("bin2")).distinct()
    return inside.join(below, ["level", "bin1", "bin2"], "left_anti").select("level", "bin1", "bin2", "obs")


def upper_index(cells: DataFrame, bins: DataFrame) -> DataFrame:
    """(chr, at, obs): cells at their place in the flat upper triangle without diagonal; ``bins`` is (chr, n)."""
    n = F.col("n")
    at = F.col("bin1") * (n - 1) - F.floor(F.col("bin1") * (F.col("bin1") + 1) / 2) + F.col("bin2") - 1
    return cells.join(F.broadcast(bins), "chr").select("chr", at.cast("long").alias("at"), "obs")


def principal_component(contacts: DataFrame, steps: int = 30) -> DataFrame:
    """(id, x): leading eigenvector of the symmetric matrix by power iteration, unit length, positive sum."""
    from .contacts import both_ends, checkpointed

    contacts = checkpointed(contacts)
    state = checkpointed(both_ends(contacts).select("id").distinct().withColumn("x", F.lit(1.0)))
    for _ in range(steps):
        product = matvec(contacts, state)
        norm = product.agg(F.sqrt(F.sum(F.col("y") ** 2)).alias("_n"))
        state = checkpointed(product.join(F.broadcast(norm)).select("id", (F.col("y") / F.col("_n")).alias("x")))
    return state


def overlap_heatmap(contacts: DataFrame, shares: DataFrame, most_bins: int = 50) -> DataFrame:
    """(chr, bin1, bin2, obs): cis contacts spread over the bins that both elements overlap, in proportion.

    ``shares`` is (id, chr, bin, share); an element over more than ``most_bins`` bins takes no part.
    """
    wide = shares.groupBy("id").agg(F.count("*").alias("_k")).where(F.col("_k") <= most_bins).select("id")
    s = shares.join(wide, "id", "left_semi")
    side = lambda k: s.select(F.col("id").alias(f"id{k}"), F.col("chr").alias(f"c{k}"), F.col("bin").alias(f"b{k}"), F.col("share").alias(f"s{k}"))
    met = contacts.join(side(1), "id1").join(side(2), "id2").where("c1 = c2")
    return met.groupBy(F.col("c1").alias("chr"), F.least("b1", "b2").alias("bin1"), F.greatest("b1", "b2").alias("bin2")).agg(F.sum(F.col("n") * F.col("s1") * F.col("s2")).alias("obs"))


def coordinate_counts(contacts: DataFrame) -> DataFrame:
    """(chr1, bin1, chr2, bin2, total, pairs): counts and different pairs of elements by unordered coordinate bins."""
    a, b = (F.struct(F.col(f"chr{k}").alias("chr"), F.col(f"bin{k}").alias("bin")) for k in (1, 2))
    rows = contacts.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b"), "n")
    sums = rows.groupBy("a", "b").agg(F.sum("n").alias("total"), F.count("*").alias("pairs"))
    return sums.select(F.col("a.chr").alias("chr1"), F.col("a.bin").alias("bin1"), F.col("b.chr").alias("chr2"), F.col("b.bin").alias("bin2"), "total", "pairs")


def expected_integral(elements: DataFrame, factors: DataFrame, prior: float, reach: int) -> DataFrame:
    """(chr, bin1, bin2, expected): prior times the sum of f(fbin1, fbin2) over all pairs of elements of two bins.

    ``elements`` have chr, bin and fbin, ``factors`` fbin1, fbin2, f in both orders. Bins meet as
    histograms of their feature bins, up to ``reach`` bins apart, never as elements.
    """
    h = elements.groupBy("chr", "bin", "fbin").agg(F.count("*").alias("k"))
    a = h.select("chr", F.col("bin").alias("bin1"), F.col("fbin").alias("fbin1"), F.col("k").alias("k1"))
    b = h.select("chr", F.col("bin").alias("bin2"), F.col("fbin").alias("fbin2"), F.col("k").alias("k2"))
    met = a.withColumn("bin2", F.explode(F.sequence(F.col("bin1") + 1, F.col("bin1") + reach))).join(b, ["chr", "bin2"])
    return met.join(F.broadcast(factors), ["fbin1", "fbin2"]).groupBy("chr", "bin1", "bin2").agg((F.sum(F.col("k1") * F.col("k2") * F.col("f")) * prior).alias("expected"))


def corrected(contacts: DataFrame, bias: DataFrame, undo: bool = False) -> DataFrame:
    """Contacts with ``value``, n divided by both elements' biases (id, bias); ``undo`` multiplies them back."""
    met = contacts.join(bias.select(F.col("id").alias("id1"), F.col("bias").alias("_b1")), "id1").join(bias.select(F.col("id").alias("id2"), F.col("bias").alias("_b2")), "id2")
    factor = F.col("_b1") * F.col("_b2")
    return met.withColumn("value", F.col("n") * factor if undo else F.col("n") / factor).drop("_b1", "_b2")


def fragment_weights(contacts: DataFrame, weights: DataFrame) -> DataFrame:
    """(id, total): sums of 1 / (w1 * w2) over each element's contacts, counted n times."""
    v = corrected(contacts, weights.select("id", F.col("w").alias("bias")))
    ends = v.select(F.col("id1").alias("id"), "value").unionByName(v.select(F.col("id2").alias("id"), "value"))
    return ends.groupBy("id").agg(F.sum("value").alias("total"))


def without_chromosomes(cells: DataFrame, names: list[str]) -> DataFrame:
    """Cells without any of the chromosomes."""
    keep = F.lit(True)
    for c in ("chr", "chr1", "chr2"):
        if c in cells.columns:
            keep = keep & ~F.col(c).isin(names)
    return cells.where(keep)


def without_cis(cells: DataFrame) -> DataFrame:
    return cells.where("chr1 <> chr2")


def unsequenced_bins(bases: DataFrame, resolution: int, least_share: float) -> DataFrame:
    """Bins (with ``bases`` mapped in them) whose mapped share of the resolution is below ``least_share``."""
    return bases.where(F.col("bases") < least_share * resolution)


def possible_by_offset(bins: DataFrame, reach: int) -> DataFrame:
    """(offset, possible): pairs of elements by the offset of their bins (chr, bin), up to ``reach``.

    From the bins' sizes; pairs within a bin count once.
    """
    sizes = bins.groupBy("chr", "bin").agg(F.count("*").alias("k"))
    ahead = sizes.select("chr", F.col("bin").alias("bin0"), "k", F.explode(F.sequence(F.lit(0), F.lit(reach))).alias("offset"))
    met = ahead.withColumn("bin", F.col("bin0") + F.col("offset")).join(sizes.withColumnRenamed("k", "k2"), ["chr", "bin"])
    pairs = F.when(F.col("offset") == 0, F.expr("k * (k - 1) div 2")).otherwise(F.col("k") * F.col("k2"))
    return met.groupBy(F.col("offset").cast("long").alias("offset")).agg(F.sum(pairs).alias("possible"))


def decay_over_possible(contacts: DataFrame, bins: DataFrame, reach: int) -> DataFrame:
    """(offset, observed, possible, share): contacts over possible pairs by the offset of their bins."""
    offset = F.abs(F.col("bin2") - F.col("bin1")).cast("long")
    seen = contacts.where("chr1 = chr2").groupBy(offset.alias("offset")).agg(F.sum("n").alias("observed")).where(F.col("offset") <= reach)
    joined = possible_by_offset(bins, reach).join(seen, "offset", "left").withColumn("observed", F.coalesce("observed", F.lit(0)))
    return joined.where("possible > 0").select("offset", "observed", "possible", (F.col("observed") / F.col("possible")).alias("share"))


def projected(cells: DataFrame, vector: DataFrame) -> DataFrame:
    """One row: the product of a vector (id, value) with the matrix (id1, id2, n) and again with the vector, over its squared length."""
    left = cells.join(vector.select(F.col("id").alias("id1"), F.col("value").alias("a")), "id1").join(vector.select(F.col("id").alias("id2"), F.col("value").alias("b")), "id2")
    product = left.agg((2 * F.sum(F.col("n") * F.col("a") * F.col("b"))).alias("p"))
    return product.join(vector.agg(F.sum(F.col("value") * F.col("value")).alias("s"))).select((F.col("p") / F.col("s")).alias("share"))
