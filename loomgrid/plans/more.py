"""Further operators bound to tables, with the same result in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import expressions as X
from ..functions import sequences as S
from ..operators import contacts as C
from ..operators import locate as L
from ..operators import matrix as M
from ..operators import models as Mo
from ..operators import tables as T
from .registry import ORACLE_SQL, query
from .views import Views, sql

LEAST, NEAR, FAR = 2, 20_000, 400_000
_NEAR_ROUND = "k{k} AS MATERIALIZED (WITH d AS (SELECT * FROM {t} WHERE chr1 = chr2 AND abs(mid2 - mid1) >= {near} AND abs(mid2 - mid1) < {far}), g AS (SELECT id FROM (SELECT id1 AS id FROM d UNION ALL SELECT id2 FROM d) GROUP BY id HAVING count(*) >= {least}) SELECT * FROM {t} WHERE id1 IN (FROM g) AND id2 IN (FROM g))"


@query()
def kcore_by_distance(v: Views) -> DataFrame:
    return C.core(v.located(), LEAST, 3, NEAR, FAR)


ORACLE_SQL["kcore_by_distance"] = sql("lc", "") + ", " + ", ".join(_NEAR_ROUND.format(k=k, t=f"k{k - 1}" if k else "lc", near=NEAR, far=FAR, least=LEAST) for k in range(3)) + " SELECT id1, id2, n FROM k2"


@query("lc", """SELECT 'trans' AS kind, count(*) AS pairs, CAST(sum(n) AS BIGINT) AS total FROM lc WHERE chr1 <> chr2 UNION ALL SELECT 'far_cis', count(*), CAST(sum(n) AS BIGINT) FROM lc WHERE chr1 = chr2 AND abs(mid1 - mid2) >= 100000
    UNION ALL SELECT 'close_cis', count(*), CAST(sum(n) AS BIGINT) FROM lc WHERE chr1 = chr2 AND abs(mid1 - mid2) <= 100000 UNION ALL SELECT 'both', count(*), CAST(sum(n) AS BIGINT) FROM lc""")
def contact_classes(v: Views) -> DataFrame:
    located, out = v.located(), None
    for kind in ("trans", "far_cis", "close_cis", "both"):
        got = C.contact_class(located, kind, 100_000).agg(F.lit(kind).alias("kind"), F.count("*").alias("pairs"), F.sum("n").alias("total"))
        out = got if out is None else out.unionByName(got)
    return out


@query("elements", "SELECT id, chr FROM elements WHERE len % 3 = 1")
def valid_elements(v: Views) -> DataFrame:
    return C.valid_elements(v.elements().withColumn("valid", F.col("len") % 3)).select("id", "chr")


@query("reads", """SELECT CASE WHEN f1 = f2 AND ((p1 <= p2 AND s1 = 1 AND s2 = 0) OR (p1 > p2 AND s2 = 1 AND s1 = 0)) THEN 'no_ligation' WHEN f1 = f2 THEN 'self_ligation' WHEN abs(f1 - f2) = 1 THEN 're_ligation' ELSE 'mapped' END AS kind, count(*) AS n
    FROM (SELECT *, p1 // 20 AS f1, p2 // 20 AS f2 FROM reads) GROUP BY 1""")
def read_kinds(v: Views) -> DataFrame:
    reads = v.reads()
    return C.read_kinds(reads.withColumns({"f1": F.floor(F.col("p1") / 20), "f2": F.floor(F.col("p2") / 20)}))


@query("elements", "SELECT e.id, CAST((e.gc > q[1])::INT + (e.gc > q[2])::INT + (e.gc > q[3])::INT AS BIGINT) AS fbin FROM elements e, (SELECT quantile_cont(gc, [0.1, 0.5, 0.9]) AS q FROM elements)")
def bins_quantile_breaks(v: Views) -> DataFrame:
    return L.quantile_break_bins(v.elements(), "gc", [0.1, 0.5, 0.9]).select("id", F.col("fbin").cast("long").alias("fbin"))


@query("be", "SELECT chr, bin, CAST(sum(len) AS BIGINT) AS sum_len, round(avg(gc), 6) AS mean_gc, count(*) AS n FROM be GROUP BY 1, 2 QUALIFY count(*) OVER (PARTITION BY chr) >= 2")
def bin_features(v: Views) -> DataFrame:
    return L.bin_features(v.binned_elements(), ["len"], ["gc"], least=2).withColumn("mean_gc", F.round("mean_gc", 6))


@query("cis", "SELECT * FROM cis WHERE chr NOT IN ('Brand#11', 'Brand#22')")
def remove_chromosomes(v: Views) -> DataFrame:
    return M.without_chromosomes(M.binned_cis(v.located()), ["Brand#11", "Brand#22"])


@query("lc", "SELECT id1, id2, n FROM lc WHERE chr1 <> chr2")
def remove_cis(v: Views) -> DataFrame:
    return M.without_cis(v.located()).select("id1", "id2", "n")


@query("be", "SELECT chr, bin, bases FROM (SELECT chr, bin, CAST(sum(stop - start) AS BIGINT) AS bases FROM be GROUP BY 1, 2) WHERE bases < 5000")
def unsequenced_bins(v: Views) -> DataFrame:
    bases = v.binned_elements().groupBy("chr", "bin").agg(F.sum(F.col("stop") - F.col("start")).alias("bases"))
    return M.unsequenced_bins(bases, 100_000, 0.05).select("chr", "bin", "bases")


@query("be lc", """SELECT p.d AS "offset", CAST(coalesce(o.n, 0) AS BIGINT) AS observed, CAST(p.k AS BIGINT) AS possible, round(coalesce(o.n, 0) / p.k, 9) AS share FROM (SELECT b.bin - a.bin AS d, count(*) AS k FROM be a JOIN be b ON a.chr = b.chr AND (a.bin < b.bin OR (a.bin = b.bin AND a.id < b.id)) AND b.bin - a.bin <= 6 GROUP BY 1) p
    LEFT JOIN (SELECT abs(bin1 - bin2) AS d, sum(n) AS n FROM lc WHERE chr1 = chr2 GROUP BY 1) o ON p.d = o.d""")
def decay_over_possible(v: Views) -> DataFrame:
    return M.decay_over_possible(v.located(), v.binned_elements(), 6).withColumn("share", F.round("share", 9))


@query("contacts elements", """SELECT round(2 * sum(n * a.gc * b.gc) / any_value(s), 4) AS share FROM contacts JOIN elements a ON id1 = a.id JOIN elements b ON id2 = b.id, (SELECT sum(gc * gc) AS s FROM elements)""")
def vector_projection(v: Views) -> DataFrame:
    vector = v.elements().select("id", F.col("gc").alias("value"))
    return M.projected(v.contacts(), vector).withColumn("share", F.round("share", 4))


def _ice(first: str, step: str, passes: int, last: str) -> str:
    parts = [f"s0 AS MATERIALIZED ({first})"] + [f"s{k + 1} AS MATERIALIZED ({step.format(s=f's{k}')})" for k in range(passes)]
    return ", " + ", ".join(parts) + " " + last.format(s=f"s{passes}")


_SUMS = "SELECT e.id, a.c, sum(value / (a.c * b.c)) AS s FROM {e} e JOIN {{s}} a ON e.id = a.id JOIN {{s}} b ON e.other = b.id GROUP BY e.id, a.c"


@query()
def ice_trans_only(v: Views) -> DataFrame:
    return Mo.ice_by_trans(v.located(), 2).withColumn("corrected", F.round("corrected", 6))


ORACLE_SQL["ice_trans_only"] = sql("lc", "") + ", te AS MATERIALIZED (SELECT id1 AS id, id2 AS other, n AS value FROM lc WHERE chr1 <> chr2 UNION ALL SELECT id2, id1, n FROM lc WHERE chr1 <> chr2)" + _ice(
    "SELECT DISTINCT id, CAST(1 AS DOUBLE) AS c FROM te", f"SELECT id, c * s / avg(s) OVER () AS c FROM ({_SUMS.format(e='te')})", 2,
    "SELECT id1, id2, n, round(n / (coalesce(a.c, 1) * coalesce(b.c, 1)), 6) AS corrected FROM lc LEFT JOIN {s} a ON id1 = a.id LEFT JOIN {s} b ON id2 = b.id",
)


@query()
def ice_damped_k(v: Views) -> DataFrame:
    return Mo.ice_damped(v.contacts(), 3).withColumn("bias", F.round("bias", 6))


ORACLE_SQL["ice_damped_k"] = sql("ends", "") + _ice(
    "SELECT DISTINCT id, CAST(1 AS DOUBLE) AS c FROM ends", f"SELECT id, c * (1 + 0.6 * (s / avg(s) OVER () - 1)) AS c FROM ({_SUMS.format(e='ends')})", 3, "SELECT id, round(c, 6) AS bias FROM {s}"
)


@query("lc elements", """SELECT CAST(t AS BIGINT) AS total, CAST(p AS BIGINT) AS possible, round(t / p, 9) AS mean FROM (SELECT sum(n) AS t FROM lc WHERE chr1 <> chr2), (SELECT count(*) AS p FROM elements a JOIN elements b ON a.chr <> b.chr AND a.len % 2 = 0 AND b.len % 2 = 1)""")
def trans_mean_by_strand(v: Views) -> DataFrame:
    e = v.elements().withColumn("strand", F.when(F.col("len") % 2 == 0, "+").otherwise("-"))
    return Mo.trans_mean(v.located(), e).select(F.col("total").cast("long").alias("total"), F.col("possible").cast("long").alias("possible"), F.round("mean", 9).alias("mean"))


_LINE = "ll AS MATERIALIZED (SELECT id1, id2, ln(n) AS y, ln(abs(mid2 - mid1)) AS x FROM lc WHERE chr1 = chr2 AND mid1 <> mid2), lr AS MATERIALIZED (SELECT id1, id2, y - slope * x - icept AS r FROM ll, (SELECT regr_slope(y, x) AS slope, regr_intercept(y, x) AS icept FROM ll)), le AS MATERIALIZED (SELECT id1 AS id, id2 AS other, r AS value FROM lr UNION ALL SELECT id2, id1, r FROM lr)"
_RESIDUAL = "SELECT e.id, a.c + 0.5 * avg(value - a.c - b.c) AS c FROM le e JOIN {s} a ON e.id = a.id JOIN {s} b ON e.other = b.id GROUP BY e.id, a.c"


@query()
def log_normal_fit(v: Views) -> DataFrame:
    return Mo.log_normal_fit(v.located().where("chr1 = chr2"), 3).withColumn("c", F.round("c", 6))


ORACLE_SQL["log_normal_fit"] = sql("lc", "") + ", " + _LINE + _ice("SELECT DISTINCT id, CAST(0 AS DOUBLE) AS c FROM le", _RESIDUAL, 3, "SELECT id, round(c, 6) AS c FROM {s}")


@query()
def log_normal_likelihood(v: Views) -> DataFrame:
    cis = v.located().where("chr1 = chr2")
    return Mo.log_normal_likelihood(cis, Mo.log_normal_fit(cis, 2)).withColumn("squares", F.round("squares", 4))


ORACLE_SQL["log_normal_likelihood"] = sql("lc", "") + ", " + _LINE + _ice(
    "SELECT DISTINCT id, CAST(0 AS DOUBLE) AS c FROM le", _RESIDUAL, 2,
    "SELECT count(*) AS pairs, round(sum((r - a.c - b.c) * (r - a.c - b.c)), 4) AS squares FROM lr JOIN {s} a ON id1 = a.id JOIN {s} b ON id2 = b.id",
)


@query("", "SELECT c_custkey, 'region ' || n_regionkey AS nation FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_nationkey < 20")
def relabelled(v: Views) -> DataFrame:
    codes = v.table("nation").where("n_nationkey < 20").select(F.col("n_nationkey").cast("string").alias("old"), F.concat(F.lit("region "), "n_regionkey").alias("new"))
    return T.relabelled(v.table("customer").select("c_custkey", F.col("c_nationkey").cast("string").alias("nation")), codes, "nation")


@query("", "SELECT doc_id, lang FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)")
def select_by_marks(v: Views) -> DataFrame:
    marks = v.table("labels").select("doc_id", F.col("quality").alias("mark"))
    return T.selected_lines(v.table("documents").select("doc_id", "lang"), marks, "doc_id")


@query("", "SELECT p_partkey, p_partkey IN (SELECT l_suppkey FROM lineitem) AS is_member FROM part")
def array_membership(v: Views) -> DataFrame:
    return T.marked_members(v.table("part").select("p_partkey"), "p_partkey", v.table("lineitem").select("l_suppkey"))


@query("", "SELECT l_partkey AS k FROM lineitem INTERSECT SELECT l_suppkey FROM lineitem INTERSECT SELECT o_custkey FROM orders")
def values_in_all(v: Views) -> DataFrame:
    items = v.table("lineitem")
    return T.common_values("k", items.select(F.col("l_partkey").alias("k")), items.select(F.col("l_suppkey").alias("k")), v.table("orders").select(F.col("o_custkey").alias("k")))


@query("", "SELECT l_returnflag, max(l_linenumber) AS l_linenumber, CAST(sum(l_suppkey) AS BIGINT) AS l_suppkey FROM lineitem GROUP BY 1")
def mapping_statistics(v: Views) -> DataFrame:
    return T.combined_reports(v.table("lineitem"), "l_returnflag", ["l_linenumber"], ["l_suppkey"])


@query("lc be", """SELECT o.bin1, o.bin2, o.n AS "count", p.n AS total FROM (SELECT least(bin1, bin2) AS bin1, greatest(bin1, bin2) AS bin2, count(*) AS n FROM lc GROUP BY 1, 2) o
    JOIN (SELECT a.bin AS bin1, b.bin AS bin2, CAST(a.k * b.k AS BIGINT) AS n FROM (SELECT bin, count(*) AS k FROM be GROUP BY 1) a JOIN (SELECT bin, count(*) AS k FROM be GROUP BY 1) b ON a.bin <= b.bin) p ON o.bin1 = p.bin1 AND o.bin2 = p.bin2""")
def counts_beside_possible(v: Views) -> DataFrame:
    seen = v.located().groupBy(F.least("bin1", "bin2").alias("bin1"), F.greatest("bin1", "bin2").alias("bin2")).agg(F.count("*").alias("n"))
    sizes = v.binned_elements().groupBy("bin").agg(F.count("*").alias("k"))
    sides = [sizes.select(F.col("bin").alias(f"bin{k}"), F.col("k").alias(f"k{k}")) for k in (1, 2)]
    # Only the pairs that are observed are looked up.
    possible = seen.select("bin1", "bin2").join(sides[0], "bin1").join(sides[1], "bin2").select("bin1", "bin2", (F.col("k1") * F.col("k2")).alias("n"))
    return T.observed_beside_possible(seen, possible, ["bin1", "bin2"])


@query("", """SELECT l_orderkey, l_linenumber, CASE WHEN l_orderkey - 500 < 0 THEN -((500 - l_orderkey) // 7) ELSE (l_orderkey - 500) // 7 END AS a, (l_orderkey - 500) % 7 AS b, l_orderkey / 2.0::DOUBLE AS c, power(sqrt(l_quantity), 2) AS d, CAST(2 + 512 * 0 + 3 * 4 AS INTEGER) AS e FROM lineitem""")
def expr_division(v: Views) -> DataFrame:
    items = v.table("lineitem")
    parts = {"a": "(l_orderkey - 500) / 7", "b": "(l_orderkey - 500) % 7", "c": "l_orderkey / 2.0", "d": "sqrt(l_quantity) ** 2", "e": "2 + 2 ** 3 ** 2 * 0 + 3 * 4"}
    return items.select("l_orderkey", "l_linenumber", *[X.evaluate(t, items).alias(n) for n, t in parts.items()])


@query("", """SELECT l_orderkey, l_linenumber, l_partkey & l_suppkey AS a, l_partkey | 5 AS b, xor(l_partkey, l_suppkey) AS c, ~l_partkey AS d, (l_quantity > 9) <> (l_tax > 0.02) AS e, (l_quantity > 9 OR l_tax > 0.05) AND NOT (l_discount > 0.03) AS f FROM lineitem""")
def expr_bitwise(v: Views) -> DataFrame:
    items = v.table("lineitem")
    parts = {"a": "l_partkey & l_suppkey", "b": "l_partkey | 5", "c": "l_partkey ^ l_suppkey", "d": "~l_partkey", "e": "(l_quantity > 9) ^ (l_tax > 0.02)", "f": "((l_quantity > 9) | (l_tax > 0.05)) & ~(l_discount > 0.03)"}
    return items.select("l_orderkey", "l_linenumber", *[X.evaluate(t, items).alias(n) for n, t in parts.items()])


@query("", """SELECT l_orderkey, l_linenumber, CAST(l_quantity > 25 AS INTEGER) + l_linenumber AS a, CAST(l_quantity > 25 AS BIGINT) + l_orderkey AS b, CAST(l_linenumber AS DOUBLE) + l_tax AS c, CAST(l_linenumber AS DOUBLE) AS re, CAST(0 AS DOUBLE) AS im, 1 AS ones FROM lineitem""")
def expr_cast_chain(v: Views) -> DataFrame:
    items = v.table("lineitem")
    e = lambda t: X.evaluate(t, items)
    wide = X.widened(F.col("l_linenumber"), "complex")
    return items.select("l_orderkey", "l_linenumber", e("(l_quantity > 25) + l_linenumber").alias("a"), e("(l_quantity > 25) + l_orderkey").alias("b"), e("l_linenumber + l_tax").alias("c"), wide["re"].alias("re"), wide["im"].alias("im"), e("ones_like(l_linenumber)").alias("ones"))


@query("", """SELECT l_orderkey, l_linenumber, round(cosh(l_tax), 8) AS a, round(tanh(l_tax), 8) AS b, round(asinh(l_quantity), 8) AS c, round(acosh(l_quantity + 1), 8) AS d, round(tan(l_tax), 8) AS e, round(acos(l_tax), 8) AS f, round(atan(l_quantity), 8) AS g FROM lineitem""")
def expr_hyperbolic(v: Views) -> DataFrame:
    items = v.table("lineitem")
    parts = ("cosh(l_tax)", "tanh(l_tax)", "arcsinh(l_quantity)", "arccosh(l_quantity + 1)", "tan(l_tax)", "arccos(l_tax)", "arctan(l_quantity)")
    return items.select("l_orderkey", "l_linenumber", *[F.round(X.evaluate(t, items), 8).alias(n) for t, n in zip(parts, "abcdefg", strict=True)])


_Z = "SELECT l_orderkey, l_linenumber, 1 + l_tax AS x, 0.5 + l_discount AS y FROM lineitem"


@query("", f"""SELECT l_orderkey, l_linenumber, round(sin(x) * cosh(y), 6) AS sin_re, round(cos(x) * sinh(y), 6) AS sin_im, round(cos(x) * cosh(y), 6) AS cos_re, round(-sin(x) * sinh(y), 6) AS cos_im, round(sinh(x) * cos(y), 6) AS sinh_re, round(cosh(x) * sin(y), 6) AS sinh_im,
    round(exp(x) * cos(y) - 1, 6) AS expm1_re, round(exp(x) * sin(y), 6) AS expm1_im, round(ln(sqrt(x * x + y * y)) / ln(10), 6) AS log10_re, round(x * x - y * y, 6) AS square_re, round(2 * x * y, 6) AS square_im, round(sin(2 * x) / (cos(2 * x) + cosh(2 * y)), 6) AS tan_re, round(sinh(2 * x) / (cosh(2 * x) + cos(2 * y)), 6) AS tanh_re FROM ({_Z})""")
def expr_complex_functions(v: Views) -> DataFrame:
    z = X.complex_of(1 + F.col("l_tax"), 0.5 + F.col("l_discount"))
    two = X.complex_of(F.lit(2.0), F.lit(0.0))
    both = {"sin": X.complex_sin(z), "cos": X.complex_cos(z), "sinh": X.complex_sinh(z), "expm1": X.complex_expm1(z), "square": X.complex_power(z, two)}
    real = {"log10": X.complex_log10(z), "tan": X.complex_tan(z), "tanh": X.complex_tanh(z)}
    parts = [F.round(c[p], 6).alias(f"{n}_{p}") for n, c in both.items() for p in ("re", "im")] + [F.round(c["re"], 6).alias(f"{n}_re") for n, c in real.items()]
    return v.table("lineitem").select("l_orderkey", "l_linenumber", *parts)


@query("", "SELECT event_id, round(exp(-x * x / 2) / 2.5066282746310002, 8) AS pdf FROM (SELECT event_id, value / 100 AS x FROM events)")
def normal_density(v: Views) -> DataFrame:
    return v.table("events").select("event_id", F.round(X.normal_pdf(F.col("value") / 100), 8).alias("pdf"))


@query("", "SELECT c_custkey, split_part(s, '.', 1) AS species, split_part(s, '.', 2) AS chrom FROM (SELECT c_custkey, c_mktsegment || '.c' || c_nationkey AS s FROM customer)")
def source_names(v: Views) -> DataFrame:
    parts = S.source_parts(F.concat("c_mktsegment", F.lit(".c"), "c_nationkey"))
    return v.table("customer").select("c_custkey", parts["species"].alias("species"), parts["chrom"].alias("chrom"))
