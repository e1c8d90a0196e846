"""Every operator of the library, bound to tables and named; with the same result in SQL."""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import alignments as Al
from ..functions import expressions as X
from ..functions import sequences as S
from ..operators import contacts as C
from ..operators import intervals as I
from ..operators import locate as L
from ..operators import matrix as M
from ..operators import models as Mo
from ..operators import random as Ra
from ..operators import reads as Re
from ..operators import signal as Si
from ..operators import tables as T
from .views import BIN, FINE, Views, sql

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(uses: str = "", oracle: str | None = None):
    """Register a function of ``Views`` under its name, with SQL over the views it uses."""

    def register(f: Callable[[Views], DataFrame]):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(Views(spark, sf_dir))
        if oracle:
            ORACLE_SQL[f.__name__] = sql(uses, oracle)
        return f

    return register


def r6(c: str | Column) -> Column:
    return F.round(c, 6)


# Contacts --------------------------------------------------------------------------------------


@query("contacts", "SELECT id1, id2, n FROM contacts")
def contact_pairs(v: Views) -> DataFrame:
    return v.contacts()


@query("cis", "SELECT * FROM cis")
def contact_binned_cis(v: Views) -> DataFrame:
    return M.binned_cis(v.located())


@query("trans", "SELECT * FROM trans")
def contact_binned_trans(v: Views) -> DataFrame:
    return M.binned_trans(v.located())


@query("creads", "SELECT * FROM creads")
def reads_canonical(v: Views) -> DataFrame:
    return C.canonical(v.reads())


@query("creads", "SELECT DISTINCT * FROM creads")
def reads_dedupe(v: Views) -> DataFrame:
    return C.dedupe(v.reads())


@query("reads", "SELECT c1 = c2 AS is_cis, count(*) AS n FROM reads GROUP BY 1")
def cis_trans_split(v: Views) -> DataFrame:
    return C.cis_trans(v.reads()).groupBy("is_cis").agg(F.count("*").alias("n"))


@query("contacts", "SELECT * FROM contacts WHERE NOT (id1 = id2 OR (id1 % 2 = 0 AND id2 IN (id1 + 1, id1 + 3)) OR (id1 % 2 = 1 AND id2 = id1 + 1))")
def pair_validity_filter(v: Views) -> DataFrame:
    return C.valid_pairs(v.contacts())


@query("ends", "SELECT id, count(*) AS degree, CAST(sum(value) AS BIGINT) AS total FROM ends GROUP BY id")
def degree_coverage(v: Views) -> DataFrame:
    return C.degree(v.contacts())


#: Partners that leave part of the elements at each size of the tables.
CORE = 66
_ROUND = "SELECT * FROM {t} WHERE id1 IN (SELECT id FROM d{k}) AND id2 IN (SELECT id FROM d{k})"
_DEGREE = f"SELECT id FROM (SELECT id1 AS id FROM {{t}} UNION ALL SELECT id2 FROM {{t}}) GROUP BY id HAVING count(*) >= {CORE}"


def _core_sql(rounds: int) -> str:
    parts, t = [], "contacts"
    for k in range(rounds):
        parts += [f"d{k} AS ({_DEGREE.format(t=t)})", f"k{k} AS ({_ROUND.format(t=t, k=k)})"]
        t = f"k{k}"
    return sql("contacts", "") + ", " + ", ".join(parts) + f" SELECT id1, id2, n FROM {t}"


@query()
def kcore_filter(v: Views) -> DataFrame:
    return C.core(v.contacts(), CORE, rounds=3)


ORACLE_SQL["kcore_filter"] = _core_sql(3)


@query()
def kcore_fixpoint(v: Views) -> DataFrame:
    return C.core(v.contacts(), CORE)


@query("elements contacts", "SELECT c.* FROM contacts c WHERE id1 IN (SELECT id FROM elements WHERE len > 10) AND id2 IN (SELECT id FROM elements WHERE len > 10)")
def fragment_keep_semi(v: Views) -> DataFrame:
    return C.keep_elements(v.contacts(), v.elements().where("len > 10"))


@query("lc", """SELECT id, round(sum(CASE WHEN cis THEN n ELSE 0 END) / sum(n), 6) AS ratio FROM (SELECT id1 AS id, n, chr1 = chr2 AS cis FROM lc UNION ALL SELECT id2, n, chr1 = chr2 FROM lc) GROUP BY id""")
def cis_to_total(v: Views) -> DataFrame:
    return C.cis_to_total(v.located()).withColumn("ratio", r6("ratio"))


_RATIO = "SELECT id, sum(CASE WHEN cis THEN n ELSE 0 END) / sum(n) AS ratio FROM (SELECT id1 AS id, n, chr1 = chr2 AS cis FROM lc UNION ALL SELECT id2, n, chr1 = chr2 FROM lc) GROUP BY id"


@query("lc", f"""SELECT id FROM ({_RATIO}), (SELECT quantile_cont(ratio, 0.05) AS a, quantile_cont(ratio, 0.95) AS b FROM ({_RATIO}) WHERE ratio <> 0) WHERE ratio BETWEEN a AND b""")
def cis_to_total_filter(v: Views) -> DataFrame:
    return C.between_percentiles(C.cis_to_total(v.located()), "ratio", 0.05, 0.95).select("id")


@query("ends", """SELECT id, total FROM (SELECT id, CAST(sum(value) AS BIGINT) AS total FROM ends GROUP BY id),
    (SELECT quantile_cont(t, 0.02) AS a, quantile_cont(t, 0.98) AS b FROM (SELECT sum(value)::BIGINT AS t FROM ends GROUP BY id)) WHERE total BETWEEN a AND b""")
def extreme_percentile_filter(v: Views) -> DataFrame:
    return C.between_percentiles(C.degree(v.contacts()), "total", 0.02, 0.98).select("id", "total")


@query("elements contacts", "SELECT c.* FROM contacts c WHERE id1 IN (SELECT id FROM elements WHERE len < 45 AND len > 5) AND id2 IN (SELECT id FROM elements WHERE len < 45 AND len > 5)")
def length_filter(v: Views) -> DataFrame:
    return C.keep_elements(v.contacts(), C.length_filter(v.elements(), 45, 5))


@query("reads", "SELECT * FROM reads WHERE c1 <> c2 OR abs(p1 - p2) >= 50")
def too_close_filter(v: Views) -> DataFrame:
    return C.too_close(v.reads(), 50)


@query("reads", "SELECT * FROM reads WHERE s1 <> s2")
def orientation_filter(v: Views) -> DataFrame:
    return C.orientation(v.reads())


@query("reads", """SELECT * FROM reads WHERE NOT (c1 = c2 AND s1 <> s2 AND CASE WHEN s1 = 1 THEN p2 - p1 ELSE p1 - p2 END BETWEEN 0 AND 300)""")
def dangling_end_filter(v: Views) -> DataFrame:
    return C.dangling_ends(v.reads(), 300)


@query("reads", """SELECT CASE WHEN c1 <> c2 THEN 'trans' WHEN p1 = p2 THEN 'self' WHEN s1 = s2 THEN 'same_strand' WHEN (p1 < p2) = (s1 = 1) THEN 'facing' ELSE 'apart' END AS kind, count(*) AS n FROM reads GROUP BY 1""")
def pair_classification(v: Views) -> DataFrame:
    return C.pair_classes(v.reads())


@query("reads", """SELECT count(*) AS total, count(*) FILTER (c1 = c2) AS cis, count(*) FILTER (c1 <> c2) AS trans, count(*) FILTER (c1 = c2 AND s1 = s2) AS cis_same_strand,
    count(*) FILTER (c1 = c2 AND p1 = p2) AS cis_same_place FROM reads""")
def read_metrics(v: Views) -> DataFrame:
    return C.read_metrics(v.reads())


@query("", """SELECT id1, id2, CAST(sum(n) AS BIGINT) AS n FROM (
    SELECT least(l_partkey, l_suppkey) AS id1, greatest(l_partkey, l_suppkey) AS id2, count(*) AS n FROM lineitem GROUP BY 1, 2
    UNION ALL SELECT least(l_partkey, l_suppkey), greatest(l_partkey, l_suppkey), count(*) FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1, 2) GROUP BY 1, 2""")
def combine_replicates(v: Views) -> DataFrame:
    def part(rows: DataFrame) -> DataFrame:
        return rows.groupBy(F.least("l_partkey", "l_suppkey").alias("id1"), F.greatest("l_partkey", "l_suppkey").alias("id2")).agg(F.count("*").alias("n"))

    items = v.table("lineitem")
    return C.combine(part(items), part(items.where("l_returnflag = 'R'")))


@query("reads", "SELECT *, 1 AS store FROM reads UNION ALL SELECT *, 2 FROM reads WHERE c1 = c2")
def merge_stores(v: Views) -> DataFrame:
    return I.concat(v.reads().withColumn("store", F.lit(1)), v.reads().where("c1 = c2").withColumn("store", F.lit(2)))


# Locating and bins -----------------------------------------------------------------------------


def _points(v: Views) -> DataFrame:
    """Line items as positions near the parts' elements, on the part's chromosome."""
    items = v.table("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    e = v.elements().select(F.col("id").alias("l_partkey"), "chr", "mid")
    pos = F.col("mid") + (F.col("l_suppkey") * 37 + F.col("l_orderkey")) % 8000 - 4000
    return items.join(e, "l_partkey").select("chr", pos.alias("pos"), (F.col("l_orderkey") * 100 + F.col("l_linenumber")).alias("rid"))


_POINTS = "(SELECT chr, mid + (l_suppkey * 37 + l_orderkey) % 8000 - 4000 AS pos, l_orderkey * 100 + l_linenumber AS rid FROM lineitem JOIN elements ON l_partkey = id)"


@query("elements", f"SELECT p.chr, p.pos, p.rid, e.id FROM {_POINTS} p JOIN elements e ON p.chr = e.chr AND pos >= start AND pos < stop")
def locate_range(v: Views) -> DataFrame:
    return L.locate(_points(v), v.elements())


def _asof_sql(back: bool) -> str:
    side, order = ("<=", "DESC") if back else (">=", "ASC")
    pick = "max" if back else "min"
    return f"""SELECT d.rid, d.chr, d.pos, x.at, (SELECT min(id) FROM elements e WHERE e.chr = d.chr AND e.mid = x.at) AS id
        FROM (SELECT DISTINCT * FROM {_POINTS}) d LEFT JOIN (SELECT q.chr, q.pos, {pick}(t.mid) AS at FROM (SELECT DISTINCT chr, pos FROM {_POINTS}) q
        JOIN elements t ON t.chr = q.chr AND t.mid {side} q.pos GROUP BY 1, 2) x ON d.chr = x.chr AND d.pos = x.pos"""


def _asof(v: Views, direction: str) -> DataFrame:
    return L.asof(_points(v).distinct(), v.elements().select("chr", F.col("mid").alias("at"), "id"), direction)


@query("elements", _asof_sql(True))
def asof_backward(v: Views) -> DataFrame:
    return _asof(v, "backward")


@query("elements", _asof_sql(False))
def asof_forward(v: Views) -> DataFrame:
    return _asof(v, "forward")


@query("be", "SELECT id, chr, bin FROM be")
def bins_fixed(v: Views) -> DataFrame:
    return v.binned_elements().select("id", "chr", "bin")


@query("elements", """SELECT e.id, b.bin FROM elements e JOIN (SELECT chr, k AS bin, k * 300000 AS start, k * 300000 + 200000 AS stop FROM (SELECT DISTINCT chr FROM elements),
    (SELECT unnest(generate_series(0, (SELECT max(mid) // 300000 FROM elements))) AS k)) b ON e.chr = b.chr AND mid >= b.start AND mid < b.stop""")
def bins_user(v: Views) -> DataFrame:
    e = v.elements()
    top = e.agg(F.floor(F.max("mid") / 300000).alias("top"))
    bins = e.select("chr").distinct().join(F.broadcast(top)).select("chr", F.explode(F.sequence(F.lit(0), F.col("top"))).alias("bin"))
    bins = bins.select("chr", (F.col("bin") * 300000).alias("start"), (F.col("bin") * 300000 + 200000).alias("stop"), "bin")
    return L.user_bins(e, bins).select("id", "bin")


@query("elements", """SELECT id, chr, bin, round((least(stop, (bin + 1) * 1000) - greatest(start, bin * 1000)) / 1000.0, 6)::DOUBLE AS share FROM (SELECT *, unnest(generate_series(start // 1000 - CASE WHEN start < 0 AND start % 1000 <> 0 THEN 1 ELSE 0 END, (stop - 1) // 1000)) AS bin FROM elements)""")
def bins_proportional(v: Views) -> DataFrame:
    return L.proportional_bins(v.elements(), 1000).withColumn("share", r6("share"))


@query("elements", """SELECT e.id, (SELECT count(*) FROM (SELECT quantile_v FROM (SELECT k, (SELECT gc FROM (SELECT gc, row_number() OVER (ORDER BY gc) AS r FROM elements) WHERE r = CAST(round(k * (SELECT count(*) FROM elements) / 7.0) AS BIGINT)) AS quantile_v
    FROM (SELECT unnest(generate_series(1, 6)) AS k))) WHERE quantile_v < e.gc) AS fbin FROM elements e""")
def bins_quantile(v: Views) -> DataFrame:
    return L.equal_count_bins(v.elements(), "gc", 7).select("id", F.col("fbin").cast("long").alias("fbin"))


@query("elements", "SELECT id, CAST(CASE WHEN gc < 1000 THEN 0 WHEN gc < 1300 THEN 1 WHEN gc < 1700 THEN 2 ELSE 3 END AS BIGINT) AS fbin FROM elements")
def bins_value_breaks(v: Views) -> DataFrame:
    return L.value_break_bins(v.elements(), "gc", [1000, 1300, 1700]).select("id", F.col("fbin").cast("long").alias("fbin"))


@query("elements", "SELECT id, CAST(least(floor((len - lo) / ((hi - lo) / 10.0)), 9) AS BIGINT) AS fbin FROM elements, (SELECT min(len) AS lo, max(len) AS hi FROM elements)")
def bins_equal_width(v: Views) -> DataFrame:
    return L.equal_width_bins(v.elements(), "len", 10).select("id", F.col("fbin").cast("long").alias("fbin"))


@query("fine_cis", "SELECT chr, bin1 // 4 AS bin1, bin2 // 4 AS bin2, CAST(sum(obs) AS BIGINT) AS obs FROM fine_cis WHERE bin1 // 4 <> bin2 // 4 GROUP BY 1, 2, 3")
def rebin(v: Views) -> DataFrame:
    return M.rebin(M.binned_cis(v.located(FINE)), 4)


@query("elements", """SELECT id, CAST(sum(f) OVER (PARTITION BY chr ORDER BY mid, id ROWS UNBOUNDED PRECEDING) - 1 AS BIGINT) AS region FROM
    (SELECT *, CASE WHEN mid - lag(mid) OVER (PARTITION BY chr ORDER BY mid, id) < 30000 THEN 0 ELSE 1 END AS f FROM elements)""")
def region_islands(v: Views) -> DataFrame:
    return L.regions(v.elements(), 30000).select("id", "region")


@query("elements", """SELECT chr, CASE WHEN h = 0 THEN cut ELSE m END AS start, CASE WHEN h = 0 THEN m ELSE nxt END AS stop, CAST(h AS INTEGER) AS half, (CASE WHEN h = 0 THEN cut + m ELSE m + nxt END) // 2 AS mid
    FROM (SELECT chr, mid AS cut, lead(mid) OVER w AS nxt, (mid + lead(mid) OVER w) // 2 AS m FROM elements WINDOW w AS (PARTITION BY chr ORDER BY mid)), (SELECT unnest([0, 1]) AS h) WHERE nxt IS NOT NULL""")
def cut_sites_to_halves(v: Views) -> DataFrame:
    return L.cut_sites_to_halves(v.elements().select("chr", F.col("mid").alias("cut")))


# Intervals -------------------------------------------------------------------------------------


@query("ma", "SELECT * FROM ma")
def iv_merge(v: Views) -> DataFrame:
    return I.merge(v.iv_a())


@query("ma", """SELECT * FROM (SELECT chr, coalesce(lag("end") OVER (PARTITION BY chr ORDER BY start), 0) AS start, start AS "end" FROM ma UNION ALL SELECT chr, max("end"), 30000000 FROM ma GROUP BY chr) WHERE "end" > start""")
def iv_complement(v: Views) -> DataFrame:
    return I.complement(v.iv_a(), v.lengths())


@query("iv_a mb", """SELECT a.chr, greatest(a.start, mb.start) AS start, least(a."end", mb."end") AS "end", a.id, a.strand FROM iv_a a JOIN mb ON a.chr = mb.chr AND a.start < mb."end" AND mb.start < a."end" WHERE least(a."end", mb."end") - greatest(a.start, mb.start) >= 20""")
def iv_intersect_pieces(v: Views) -> DataFrame:
    return I.intersect(v.iv_a(), v.iv_b(), mincols=20)


@query("cov", 'SELECT chr, start, "end", id, strand FROM cov WHERE bases >= 50')
def iv_intersect_whole(v: Views) -> DataFrame:
    return I.intersect(v.iv_a(), v.iv_b(), mincols=50, pieces=False)


@query("cov mb", """SELECT chr, start, "end", id, strand FROM cov WHERE bases < 30 UNION ALL
    SELECT chr, f AS start, t AS "end", id, strand FROM (
      SELECT c.chr, c.id, c.strand, coalesce(lag(mb."end") OVER (PARTITION BY c.id ORDER BY mb.start), c.start) AS f, mb.start AS t FROM cov c JOIN mb ON c.chr = mb.chr AND c.start < mb."end" AND mb.start < c."end" WHERE bases >= 30
      UNION ALL SELECT c.chr, c.id, c.strand, max(mb."end"), c."end" FROM cov c JOIN mb ON c.chr = mb.chr AND c.start < mb."end" AND mb.start < c."end" WHERE bases >= 30 GROUP BY c.chr, c.id, c.strand, c."end") WHERE t > f""")
def iv_subtract(v: Views) -> DataFrame:
    return I.subtract(v.iv_a(), v.iv_b(), mincols=30)


@query("pairs", "SELECT * FROM pairs WHERE overlap >= 10")
def iv_join_inner(v: Views) -> DataFrame:
    return I.overlap_join(v.iv_a(), v.iv_b(), 10)


_LEFT = """SELECT chr, start, "end", id, strand, NULL, NULL, NULL, NULL, NULL FROM iv_a WHERE id NOT IN (SELECT id FROM pairs WHERE overlap >= 10)"""
_RIGHT = """SELECT NULL, NULL, NULL, NULL, NULL, chr, start, "end", id, NULL FROM iv_b WHERE id NOT IN (SELECT id2 FROM pairs WHERE overlap >= 10)"""


@query("pairs", f"SELECT * FROM pairs WHERE overlap >= 10 UNION ALL {_LEFT}")
def iv_join_left(v: Views) -> DataFrame:
    return I.outer_join(v.iv_a(), v.iv_b(), 10, keep_right=False)


@query("pairs", f"SELECT * FROM pairs WHERE overlap >= 10 UNION ALL {_RIGHT}")
def iv_join_right(v: Views) -> DataFrame:
    return I.outer_join(v.iv_a(), v.iv_b(), 10, keep_left=False)


@query("pairs", f"SELECT * FROM pairs WHERE overlap >= 10 UNION ALL {_LEFT} UNION ALL {_RIGHT}")
def iv_join_full(v: Views) -> DataFrame:
    return I.outer_join(v.iv_a(), v.iv_b(), 10)


@query("cov", 'SELECT chr, start, "end", id, strand FROM cov WHERE bases >= 100')
def iv_semi(v: Views) -> DataFrame:
    return I.semi_join(v.iv_a(), v.iv_b(), 100)


@query("cov", 'SELECT chr, start, "end", id, strand FROM cov WHERE bases < 100')
def iv_anti(v: Views) -> DataFrame:
    return I.anti_join(v.iv_a(), v.iv_b(), 100)


@query("iv_a pairs", "SELECT a.id, count(p.id2) AS n FROM iv_a a LEFT JOIN pairs p ON a.id = p.id GROUP BY a.id")
def iv_count_overlaps(v: Views) -> DataFrame:
    return I.count_overlaps(v.iv_a(), v.iv_b()).select("id", "n")


@query("cov", """SELECT id, bases, round(CASE WHEN "end" > start THEN bases / ("end" - start) ELSE 0 END, 6) AS fraction FROM cov""")
def iv_coverage(v: Views) -> DataFrame:
    return I.coverage(v.iv_a(), v.iv_b()).select("id", "bases", r6("fraction").alias("fraction"))


@query("ma", 'SELECT chr, CAST(sum("end" - start) AS BIGINT) AS bases FROM ma GROUP BY chr')
def iv_base_coverage(v: Views) -> DataFrame:
    return I.base_coverage(v.iv_a())


@query("ma mb", """SELECT chr, coalesce(o, 0) AS both, a - coalesce(o, 0) AS only_left, b - coalesce(o, 0) AS only_right FROM (SELECT chr, CAST(sum("end" - start) AS BIGINT) AS a FROM ma GROUP BY chr) JOIN (SELECT chr, CAST(sum("end" - start) AS BIGINT) AS b FROM mb GROUP BY chr) USING (chr)
    LEFT JOIN (SELECT ma.chr, CAST(sum(least(ma."end", mb."end") - greatest(ma.start, mb.start)) AS BIGINT) AS o FROM ma JOIN mb ON ma.chr = mb.chr AND ma.start < mb."end" AND mb.start < ma."end" GROUP BY 1) USING (chr)""")
def iv_diff_summary(v: Views) -> DataFrame:
    return I.difference_summary(v.iv_a(), v.iv_b())


@query("iv_a", """SELECT chr, min(start) AS start, max("end") AS "end", count(*) AS n, CAST(sum(id) AS BIGINT) AS id_sum, min(id) AS first_id FROM (SELECT *, sum(f) OVER (PARTITION BY chr ORDER BY start, "end" ROWS UNBOUNDED PRECEDING) AS g FROM
    (SELECT *, CASE WHEN start <= max("end") OVER (PARTITION BY chr ORDER BY start, "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 40 THEN 0 ELSE 1 END AS f FROM iv_a)) GROUP BY chr, g HAVING count(*) >= 3""")
def iv_cluster(v: Views) -> DataFrame:
    found = I.cluster(v.iv_a(), 40, 3)
    return found.select("chr", "start", "end", "n", F.aggregate("ids", F.lit(0).cast("long"), lambda a, x: a + x).alias("id_sum"), F.col("ids")[0].alias("first_id"))


def _nearest_sql(before: bool) -> str:
    dist = 'a.start - b."end"' if before else 'b.start - a."end"'
    return f"""SELECT id, CAST(rank AS INTEGER) AS rank, id2, start2, end2, dist FROM (SELECT a.id, b.id AS id2, b.start AS start2, b."end" AS end2, {dist} AS dist, row_number() OVER (PARTITION BY a.id ORDER BY {dist}, b.id) AS rank
        FROM iv_a a JOIN iv_b b ON a.chr = b.chr AND {dist} BETWEEN 0 AND 500) WHERE rank <= 2"""


@query("iv_a iv_b", _nearest_sql(True))
def iv_nearest_before(v: Views) -> DataFrame:
    return I.nearest(v.iv_a(), v.iv_b(), 2, 500, "before")


@query("iv_a iv_b", _nearest_sql(False))
def iv_nearest_after(v: Views) -> DataFrame:
    return I.nearest(v.iv_a(), v.iv_b(), 2, 500, "after")


@query("iv_a iv_b", """SELECT id, CAST(rank AS INTEGER) AS rank, id2, start2, end2, dist FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY dist, id2) AS rank FROM (
    SELECT a.id, b.id AS id2, b.start AS start2, b."end" AS end2, CASE WHEN a.strand = '+' THEN a.start - b."end" ELSE b.start - a."end" END AS dist FROM iv_a a JOIN iv_b b ON a.chr = b.chr
    AND CASE WHEN a.strand = '+' THEN a.start - b."end" ELSE b.start - a."end" END BETWEEN 0 AND 500)) WHERE rank = 1""")
def iv_upstream(v: Views) -> DataFrame:
    return I.upstream(v.iv_a(), v.iv_b(), 1, 500)


@query("iv_a iv_b", 'SELECT chr, start, "end" FROM iv_a UNION ALL SELECT chr, start, "end" FROM iv_b')
def iv_concat(v: Views) -> DataFrame:
    return I.concat(v.iv_a().select("chr", "start", "end"), v.iv_b())


@query("iv_a", """SELECT chr, greatest(CASE WHEN "end" - start < 350 AND strand = '-' THEN "end" - 350 ELSE start END, 0) AS start, least(CASE WHEN "end" - start < 350 AND strand <> '-' THEN start + 350 ELSE "end" END, 30000000) AS "end", id, strand FROM iv_a""")
def iv_extend(v: Views) -> DataFrame:
    return I.extend(v.iv_a(), 350, v.lengths())


@query("iv_a", """SELECT chr, greatest(start - CASE WHEN strand = '-' THEN 10 ELSE 25 END, 0) AS start, "end" + CASE WHEN strand = '-' THEN 25 ELSE 10 END AS "end", id, strand FROM iv_a""")
def iv_flank(v: Views) -> DataFrame:
    return I.flank(v.iv_a(), 25, 10)


@query("iv_a", """SELECT chr, s AS start, s + 150 AS "end", id, strand FROM (SELECT *, unnest(generate_series(start, "end" - 150, 100)) AS s FROM iv_a WHERE "end" - start >= 150)""")
def iv_windows(v: Views) -> DataFrame:
    return I.windows(v.iv_a(), 150, 100)


@query("iv_a", """SELECT chr, s AS start, s + 150 AS "end", id, strand FROM (SELECT chr, id, strand, start + i * 150 + (("end" - start) - ("end" - start) // 150 * 150) * (i + 1) // (("end" - start) // 150 + 1) AS s
    FROM (SELECT *, unnest(generate_series(0, ("end" - start) // 150 - 1)) AS i FROM iv_a WHERE "end" - start >= 150))""")
def iv_spread_windows(v: Views) -> DataFrame:
    return I.spread_windows(v.iv_a(), 150)


@query("iv_a", """SELECT chr, s AS start, least(s + 130, "end") AS "end", id, strand FROM (SELECT *, unnest(generate_series(start, "end" - 1, 130)) AS s FROM iv_a)""")
def iv_chunk(v: Views) -> DataFrame:
    return I.chunk(v.iv_a(), 130)


def _event_spans(v: Views) -> DataFrame:
    """An hour from each event, on its type's axis."""
    t = v.track()
    return t.select("id", "chr", F.col("pos").alias("start"), (F.col("pos") + 3600).alias("end"))


@query("track", """SELECT a.id, count(b.val) AS n, round(avg(b.val), 6) AS avg_val, round(min(b.val), 6) AS min_val, round(max(b.val), 6) AS max_val FROM track a LEFT JOIN track b ON a.chr = b.chr AND b.pos >= a.pos AND b.pos < a.pos + 3600 GROUP BY a.id""")
def scores_in_intervals(v: Views) -> DataFrame:
    got = I.points_in_intervals(_event_spans(v), v.track().drop("id"), tile=7200)
    return got.select("id", "n", *[r6(c).alias(c) for c in ("avg_val", "min_val", "max_val")])


@query("track", """SELECT (b.pos - a.pos + 36000) // 600 - 60 AS "offset", count(*) AS n, round(avg(b.val), 6) AS avg_val FROM track a JOIN track b ON a.chr = b.chr AND b.pos BETWEEN a.pos - 1800 AND a.pos + 1800 GROUP BY 1""")
def profile_around(v: Views) -> DataFrame:
    return I.profile(v.track().select("chr", "pos"), v.track(), 1800, 600, tile=7200).select("offset", "n", r6("avg_val").alias("avg_val"))


@query("track", """SELECT chr, pos // 21600 AS bin, count(*) AS n, round(min(val), 6) AS min_val, round(max(val), 6) AS max_val, round(sum(val), 4) AS sum_val, round(sum(val * val), 4) AS sum_sq, round(avg(val), 6) AS mean_val, round(stddev_samp(val), 6) AS std_dev FROM track GROUP BY 1, 2""")
def track_summary(v: Views) -> DataFrame:
    got = I.track_summary(v.track(), 21600)
    return got.select("chr", "bin", "n", r6("min_val").alias("min_val"), r6("max_val").alias("max_val"), F.round("sum_val", 4).alias("sum_val"), F.round("sum_sq", 4).alias("sum_sq"), r6("mean_val").alias("mean_val"), r6("std_dev").alias("std_dev"))


@query("track", " UNION ALL ".join(f"SELECT {k} AS level, chr, pos // {3600 * 4**k} AS bin, count(*) AS n, round(min(val), 6) AS min_val, round(max(val), 6) AS max_val, round(sum(val), 4) AS sum_val FROM track GROUP BY 2, 3" for k in range(4)))
def track_zoom(v: Views) -> DataFrame:
    got = I.track_zoom(v.track(), 3600, 4, 4)
    return got.select("level", "chr", "bin", "n", r6("min_val").alias("min_val"), r6("max_val").alias("max_val"), F.round("sum_val", 4).alias("sum_val"))


# Models ----------------------------------------------------------------------------------------

CUTS = Mo.log_cutoffs(2000.0, 2_000_000.0, 24)
_DBIN = "(" + " + ".join(f"CASE WHEN {c!r} <= abs(mid2 - mid1) THEN 1 ELSE 0 END" for c in CUTS) + ")"
_DISTANCE = f"SELECT {_DBIN} AS dbin, CAST(sum(n) AS BIGINT) AS total, count(*) AS pairs, sum(ln(abs(mid2 - mid1))) AS sum_log FROM lc WHERE chr1 = chr2 AND mid1 <> mid2 GROUP BY 1"
_SEGMENTS = f"""SELECT dbin, (y2 - y) / (x2 - x) AS slope, y - (y2 - y) / (x2 - x) * x AS intercept, CASE WHEN x3 IS NOT NULL THEN x2 END AS upto FROM (SELECT dbin, x, y, lead(x) OVER w AS x2, lead(y) OVER w AS y2, lead(x, 2) OVER w AS x3
    FROM (SELECT dbin, sum_log / pairs AS x, ln(total / pairs) AS y FROM ({_DISTANCE}) WHERE total > 0) WINDOW w AS (ORDER BY dbin)) WHERE x2 IS NOT NULL"""


@query("lc", f"SELECT dbin, total, pairs, round(sum_log, 4) AS sum_log FROM ({_DISTANCE})")
def distance_bins(v: Views) -> DataFrame:
    return Mo.distance_bins(v.located(), CUTS).withColumn("sum_log", F.round("sum_log", 4))


@query("lc", f"SELECT dbin, round(slope, 6) AS slope, round(intercept, 6) AS intercept, round(upto, 6) AS upto FROM ({_SEGMENTS})")
def distance_segments(v: Views) -> DataFrame:
    return Mo.segments(Mo.distance_bins(v.located(), CUTS)).select("dbin", *[r6(c).alias(c) for c in ("slope", "intercept", "upto")])


@query("lc", f"""SELECT id1, id2, round(exp(slope * ln(d) + intercept), 6) AS expected FROM (SELECT id1, id2, abs(mid2 - mid1) AS d FROM lc WHERE chr1 = chr2 AND mid1 <> mid2)
    JOIN (SELECT *, coalesce(lag(upto) OVER (ORDER BY dbin), -1) AS lo, coalesce(upto, 1e300) AS hi FROM ({_SEGMENTS})) ON ln(d) >= lo AND ln(d) < hi""")
def distance_expected(v: Views) -> DataFrame:
    located = v.located()
    got = Mo.expected_by_distance(located, Mo.segments(Mo.distance_bins(located, CUTS)))
    return got.select("id1", "id2", r6("expected").alias("expected"))


@query("lc", """SELECT round(regr_slope(y, x), 8) AS slope, round(regr_intercept(y, x), 8) AS intercept, round(sqrt((regr_syy(y, x) - regr_slope(y, x) * regr_sxy(y, x)) / count(*)), 6) AS sigma, count(*) AS pairs
    FROM (SELECT ln(abs(mid2 - mid1)) AS x, ln(n) AS y FROM lc WHERE chr1 = chr2 AND mid1 <> mid2)""")
def distance_regression(v: Views) -> DataFrame:
    return Mo.distance_regression(v.located()).select(F.round("slope", 8).alias("slope"), F.round("intercept", 8).alias("intercept"), r6("sigma").alias("sigma"), "pairs")


@query("elements", "SELECT a.id, count(b.id) AS possible FROM elements a LEFT JOIN elements b ON a.chr = b.chr AND abs(a.mid - b.mid) >= 10000 AND abs(a.mid - b.mid) < 200000 GROUP BY a.id")
def possible_counts(v: Views) -> DataFrame:
    return Mo.possible_partners(v.elements(), 10000, 200000)


@query("elements", "SELECT a.id, round(sum(b.gc), 4) AS weight_sum FROM elements a JOIN elements b ON a.chr = b.chr AND abs(a.mid - b.mid) <= 100000 GROUP BY a.id")
def weighted_range_sum(v: Views) -> DataFrame:
    return Mo.weighted_range_sum(v.elements(), "gc", 100000).select("id", F.round("weight_sum", 4).alias("weight_sum"))


@query("be", """SELECT a.chr, a.bin AS bin1, b.bin AS bin2, round(a.s * b.s / 997003.7, 4) AS expected FROM (SELECT chr, bin, sum(gc) AS s FROM be GROUP BY 1, 2) a JOIN (SELECT chr, bin, sum(gc) AS s FROM be GROUP BY 1, 2) b ON a.chr = b.chr AND a.bin < b.bin""")
def expected_closed_form(v: Views) -> DataFrame:
    got = Mo.expected_closed_form(Mo.bin_sums(v.binned_elements(), "gc"))
    return got.withColumn("expected", F.round(F.col("expected") / 997003.7, 4))


@query("be", "SELECT a.chr, a.bin AS bin1, b.bin AS bin2, count(*) AS expected FROM be a JOIN be b ON a.chr = b.chr AND a.bin < b.bin AND b.bin - a.bin <= 3 GROUP BY 1, 2, 3")
def expected_pairwise(v: Views) -> DataFrame:
    sums = Mo.bin_sums(v.binned_elements().withColumn("one", F.lit(1).cast("long")), "one")
    return Mo.expected_closed_form(sums, reach=3)


@query("cis be", """SELECT c.chr, c.bin1, c.bin2, c.obs, round(c.obs / (a.k * b.k), 8) AS enrichment FROM cis c JOIN (SELECT chr, bin, count(*) AS k FROM be GROUP BY 1, 2) a ON c.chr = a.chr AND c.bin1 = a.bin JOIN (SELECT chr, bin, count(*) AS k FROM be GROUP BY 1, 2) b ON c.chr = b.chr AND c.bin2 = b.bin""")
def enrichment_cis(v: Views) -> DataFrame:
    sums = Mo.bin_sums(v.binned_elements().withColumn("one", F.lit(1).cast("long")), "one")
    return Mo.observed_over_expected(M.binned_cis(v.located()), sums).select("chr", "bin1", "bin2", "obs", F.round(F.col("obs") / F.col("expected"), 8).alias("enrichment"))


@query("lc elements", """SELECT c1 AS chr1, c2 AS chr2, round(s / greatest(1, a.k * b.k), 8) AS mean FROM (SELECT least(chr1, chr2) AS c1, greatest(chr1, chr2) AS c2, sum(n) AS s FROM lc WHERE chr1 <> chr2 GROUP BY 1, 2)
    JOIN (SELECT chr, count(*) AS k FROM elements GROUP BY 1) a ON c1 = a.chr JOIN (SELECT chr, count(*) AS k FROM elements GROUP BY 1) b ON c2 = b.chr""")
def trans_means(v: Views) -> DataFrame:
    return Mo.trans_means(v.located(), v.elements()).withColumn("mean", F.round("mean", 8))


def _passes(first: str, step: str, k: int, last: str) -> str:
    parts = [f"s0 AS MATERIALIZED ({first})"] + [f"s{i + 1} AS MATERIALIZED ({step.format(s=f's{i}')})" for i in range(k)]
    return sql("ends", "") + ", " + ", ".join(parts) + " " + last.format(s=f"s{k}")


@query()
def express_k(v: Views) -> DataFrame:
    return Mo.express(v.contacts(), passes=3).withColumn("c", r6("c"))


ORACLE_SQL["express_k"] = _passes(
    "SELECT DISTINCT id, CAST(1 AS DOUBLE) AS c FROM ends",
    "SELECT e.id, a.c * sqrt(sum(value / (a.c * b.c)) / count(*)) AS c FROM ends e JOIN {s} a ON e.id = a.id JOIN {s} b ON e.other = b.id GROUP BY e.id, a.c",
    3, "SELECT id, round(c, 6) AS c FROM {s}",
)


@query()
def ice_k(v: Views) -> DataFrame:
    return Mo.ice(v.contacts(), 2).withColumn("bias", r6("bias"))


ORACLE_SQL["ice_k"] = _passes(
    "SELECT DISTINCT id, CAST(1 AS DOUBLE) AS c FROM ends",
    "SELECT id, c * s / avg(s) OVER () AS c FROM (SELECT e.id, a.c, sum(value / (a.c * b.c)) AS s FROM ends e JOIN {s} a ON e.id = a.id JOIN {s} b ON e.other = b.id GROUP BY e.id, a.c)",
    2, "SELECT id, round(c, 6) AS bias FROM {s}",
)


def _feature_contacts(v: Views) -> DataFrame:
    e = L.equal_width_bins(v.elements(), "len", 10)
    return C.with_elements(v.contacts(), e, ("fbin",))


_F10 = "CAST(least(floor((len - lo) / ((hi - lo) / 10.0)), 9) AS BIGINT)"
_FE = f"(SELECT id, {_F10} AS f FROM elements, (SELECT min(len) AS lo, max(len) AS hi FROM elements))"


@query("contacts elements", f"""SELECT CAST(l * 9 - l * (l - 1) // 2 + h AS BIGINT) AS pbin, CAST(sum(n) AS BIGINT) AS total, count(*) AS pairs FROM (SELECT n, least(a.f, b.f) AS l, greatest(a.f, b.f) AS h FROM contacts JOIN {_FE} a ON id1 = a.id JOIN {_FE} b ON id2 = b.id) GROUP BY 1""")
def binning_counts(v: Views) -> DataFrame:
    return Mo.feature_pair_counts(_feature_contacts(v), 10).withColumn("pbin", F.col("pbin").cast("long"))


@query("elements", f"""SELECT a.f AS fbin1, b.f AS fbin2, CAST(CASE WHEN a.f = b.f THEN a.k * (a.k - 1) // 2 ELSE a.k * b.k END AS BIGINT) AS possible FROM (SELECT f, count(*) AS k FROM {_FE} GROUP BY 1) a JOIN (SELECT f, count(*) AS k FROM {_FE} GROUP BY 1) b ON a.f <= b.f""")
def binning_possible(v: Views) -> DataFrame:
    got = Mo.possible_feature_pairs(L.equal_width_bins(v.elements(), "len", 10))
    return got.withColumns({c: F.col(c).cast("long") for c in ("fbin1", "fbin2")})


@query("lc", """SELECT dimension, value, CAST(sum(observed) AS BIGINT) AS observed, CAST(sum(possible) AS BIGINT) AS possible, round(sum(observed) / sum(possible), 8) AS ratio FROM (SELECT 'bin1' AS dimension, bin1 AS value, obs AS observed, cells AS possible FROM (SELECT bin1, bin2, sum(n) AS obs, count(*) AS cells FROM lc GROUP BY 1, 2)
    UNION ALL SELECT 'bin2', bin2, obs, cells FROM (SELECT bin1, bin2, sum(n) AS obs, count(*) AS cells FROM lc GROUP BY 1, 2)) GROUP BY 1, 2""")
def binning_seeds(v: Views) -> DataFrame:
    counts = v.located().groupBy("bin1", "bin2").agg(F.sum("n").alias("observed"), F.count("*").alias("possible"))
    return Mo.seeds(counts, ["bin1", "bin2"]).withColumn("ratio", F.round("ratio", 8))


@query("elements", "SELECT id, round(gc / avg(gc) OVER (PARTITION BY chr), 6) AS gc FROM elements")
def recentre_means(v: Views) -> DataFrame:
    return Mo.recentred(v.elements(), "chr", "gc").select("id", r6("gc").alias("gc"))


@query()
def kr_balance(v: Views) -> DataFrame:
    """Scaling factors of the binned cis matrix, its bins named chr:bin, with a diagonal so that one exists."""
    cells = M.binned_cis(v.located())
    name = lambda b: F.concat_ws(":", "chr", b)
    pairs = cells.select(name("bin1").alias("id1"), name("bin2").alias("id2"), F.col("obs").alias("n"))
    own = M.marginals(cells).select(name("bin").alias("id1"), name("bin").alias("id2"), F.col("total").alias("n"))
    return Mo.knight_ruiz(pairs.unionByName(own))


def _valid_pairs(v: Views) -> DataFrame:
    """Every pair of elements of a chromosome less than a bin apart."""
    e = v.elements()
    a = e.select(F.col("id").alias("id1"), "chr", F.col("mid").alias("m1"), F.explode(F.array(F.floor(F.col("mid") / BIN), F.floor(F.col("mid") / BIN) + 1)).alias("tile"))
    b = e.select(F.col("id").alias("id2"), "chr", F.col("mid").alias("m2"), F.floor(F.col("mid") / BIN).alias("tile"))
    return a.join(b, ["chr", "tile"]).where(f"m2 > m1 and m2 - m1 < {BIN}").select("id1", "id2")


@query()
def prob_poisson(v: Views) -> DataFrame:
    return Mo.probability(v.contacts(), _valid_pairs(v), 0.06, passes=4)


@query()
def prob_binomial(v: Views) -> DataFrame:
    return Mo.probability(v.contacts(), _valid_pairs(v), 0.06, passes=4, kind="binomial")


@query()
def glm_poisson(v: Views) -> DataFrame:
    """Counts of binned cis cells by their bins' summed lengths, mean prices and distance."""
    e = v.binned_elements().groupBy("chr", "bin").agg(F.sum("len").alias("len"), F.avg("gc").alias("gc"))
    side = lambda k: e.select("chr", F.col("bin").alias(f"bin{k}"), F.log(F.col("len") + 1.0).alias(f"len{k}"), F.log("gc").alias(f"gc{k}"))
    cells = M.binned_cis(v.located()).join(side(1), ["chr", "bin1"]).join(side(2), ["chr", "bin2"])
    rows = cells.withColumns({"len_term": F.col("len1") * F.col("len2"), "gc_term": F.col("gc1") * F.col("gc2"), "distance": F.log(F.col("bin2") - F.col("bin1"))})
    return Mo.poisson_regression(rows, "obs", ["len_term", "gc_term", "distance"]).select("chr", "bin1", "bin2", "obs", r6("expected").alias("expected"))


# Matrices --------------------------------------------------------------------------------------


@query("marg", "SELECT * FROM marg")
def marginals(v: Views) -> DataFrame:
    return M.marginals(M.binned_cis(v.located()))


@query("cis", "SELECT * FROM cis WHERE bin2 - bin1 > 2")
def remove_diagonal(v: Views) -> DataFrame:
    return M.remove_diagonal(M.binned_cis(v.located()), 2)


_POOR = "(SELECT chr, bin FROM marg, (SELECT quantile_cont(total, 0.1) AS cut FROM marg) WHERE total < cut)"


@query("cis marg", f"SELECT c.* FROM cis c WHERE NOT EXISTS (SELECT 1 FROM {_POOR} p WHERE p.chr = c.chr AND p.bin IN (c.bin1, c.bin2))")
def poor_bins(v: Views) -> DataFrame:
    cells = M.binned_cis(v.located())
    return M.without_bins(cells, M.poor_bins(cells, 0.1)).select("chr", "bin1", "bin2", "obs")


_FINE_MARG = "(SELECT chr, bin1 AS bin FROM fine_cis UNION SELECT chr, bin2 FROM fine_cis)"


@query("fine_cis", f"""SELECT chr, bin FROM (SELECT chr, bin, count(*) OVER (PARTITION BY chr, r) AS k FROM (SELECT chr, bin, bin - row_number() OVER (PARTITION BY chr ORDER BY bin) AS r FROM {_FINE_MARG})) WHERE k <= 3""")
def standalone_bins(v: Views) -> DataFrame:
    return M.standalone_bins(M.binned_cis(v.located(FINE)), 3)


@query("trans", "SELECT chr1, bin1, chr2, bin2, least(CAST(obs AS DOUBLE), cut) AS obs FROM trans, (SELECT quantile_cont(obs, 0.99) AS cut FROM trans)")
def trunc_trans(v: Views) -> DataFrame:
    return M.truncate_trans(M.binned_trans(v.located()), 0.01)


@query("trans", "SELECT chr1, bin1, chr2, bin2, obs, round(obs / avg(obs) OVER (PARTITION BY chr1, chr2), 6) AS ratio FROM trans")
def block_average(v: Views) -> DataFrame:
    return M.block_average(M.binned_trans(v.located())).select("chr1", "bin1", "chr2", "bin2", "obs", r6("ratio").alias("ratio"))


@query("trans", "SELECT chr1, chr2, CAST(sum(obs) AS BIGINT) AS total, count(*) AS cells, round(avg(obs), 6) AS mean FROM trans GROUP BY 1, 2")
def chr_pair_means(v: Views) -> DataFrame:
    return M.chromosome_pair_means(M.binned_trans(v.located())).withColumn("mean", r6("mean"))


@query("lc", """SELECT chr, bin, CAST(sum(CASE WHEN cis THEN n ELSE 0 END) AS BIGINT) AS cis, CAST(sum(n) AS BIGINT) AS total, round(sum(CASE WHEN cis THEN n ELSE 0 END) / sum(n), 6) AS ratio FROM (SELECT chr1 AS chr, bin1 AS bin, n, chr1 = chr2 AS cis FROM lc UNION ALL SELECT chr2, bin2, n, chr1 = chr2 FROM lc) GROUP BY 1, 2""")
def cis_to_total_per_bin(v: Views) -> DataFrame:
    return M.cis_to_total_per_bin(v.located()).withColumn("ratio", r6("ratio"))


@query("ends elements", "SELECT e.id, CAST(sum(value * len) AS BIGINT) AS y FROM ends e JOIN elements x ON e.other = x.id GROUP BY e.id")
def matvec(v: Views) -> DataFrame:
    return M.matvec(v.contacts(), v.elements().select("id", F.col("len").alias("x")))


@query("cis", """SELECT c.chr, c.bin1, c.bin2, round(sum(o.obs * (1 - (abs(c.bin1 - o.bin1) + abs(c.bin2 - o.bin2)) / 3.0)) / sum(1 - (abs(c.bin1 - o.bin1) + abs(c.bin2 - o.bin2)) / 3.0), 6) AS smoothed
    FROM cis c JOIN (SELECT * FROM cis UNION ALL SELECT chr, bin2, bin1, obs FROM cis) o ON c.chr = o.chr AND abs(c.bin1 - o.bin1) + abs(c.bin2 - o.bin2) <= 2 GROUP BY 1, 2, 3""")
def smooth_l1(v: Views) -> DataFrame:
    return M.smooth(M.binned_cis(v.located()), 2).withColumn("smoothed", r6("smoothed"))


@query("lc", """SELECT dbin, count(*) AS n, round(corr(ln(x), ln(y)), 6) AS r FROM (SELECT bin2 - bin1 AS dbin, x, y FROM (SELECT chr1 AS chr, least(bin1, bin2) AS bin1, greatest(bin1, bin2) AS bin2, sum(n) AS x, count(*) AS y FROM lc WHERE chr1 = chr2 AND bin1 <> bin2 GROUP BY 1, 2, 3)) GROUP BY 1 HAVING corr(ln(x), ln(y)) IS NOT NULL AND count(*) > 20""")
def corr_by_distance(v: Views) -> DataFrame:
    located = v.located()
    ones = M.binned_cis(located.withColumn("n", F.lit(1).cast("long")))
    got = M.correlation_by_distance(M.binned_cis(located), ones, F.col("bin2") - F.col("bin1"))
    return got.where("r is not null and n > 20").withColumn("r", r6("r"))


@query("lc", "SELECT CAST(floor(ln(abs(mid2 - mid1)) / ln(1.5)) AS BIGINT) AS dbin, CAST(sum(n) AS BIGINT) AS total, count(*) AS pairs FROM lc WHERE chr1 = chr2 AND mid1 <> mid2 GROUP BY 1")
def scaling_curve(v: Views) -> DataFrame:
    return M.scaling_curve(v.located(), 1.5)


_LEVELS = " UNION ALL ".join(f"SELECT {k} AS level, chr, bin1 // {2**k} AS bin1, bin2 // {2**k} AS bin2, CAST(sum(obs) AS BIGINT) AS obs FROM fine_cis GROUP BY 2, 3, 4 HAVING sum(obs) >= 3" for k in range(4))


def _levels(v: Views) -> DataFrame:
    return M.multi_resolution(M.binned_cis(v.located(FINE)), 4, 3)


@query("fine_cis", _LEVELS)
def multires_levels(v: Views) -> DataFrame:
    return _levels(v)


@query("fine_cis", f"""SELECT level, bin1, bin2, obs FROM (SELECT *, CAST(power(2, level) AS BIGINT) AS f FROM ({_LEVELS})) x WHERE chr = 'Brand#11' AND (bin1 + 1) * f > 10 AND bin1 * f < 60 AND (bin2 + 1) * f > 10 AND bin2 * f < 60
    AND NOT EXISTS (SELECT 1 FROM ({_LEVELS}) y WHERE y.chr = x.chr AND y.level = x.level - 1 AND y.bin1 // 2 = x.bin1 AND y.bin2 // 2 = x.bin2
    AND (y.bin1 + 1) * x.f / 2 > 10 AND y.bin1 * x.f / 2 < 60 AND (y.bin2 + 1) * x.f / 2 > 10 AND y.bin2 * x.f / 2 < 60)""")
def multires_fetch(v: Views) -> DataFrame:
    return M.fetch_finest(_levels(v), "Brand#11", 10, 60)


@query("cis be", "SELECT c.chr, CAST(bin1 * (k - 1) - bin1 * (bin1 + 1) // 2 + bin2 - 1 AS BIGINT) AS at, obs FROM cis c JOIN (SELECT chr, max(bin) + 1 AS k FROM be GROUP BY 1) USING (chr)")
def upper_layout(v: Views) -> DataFrame:
    n = v.binned_elements().groupBy("chr").agg((F.max("bin") + 1).alias("n"))
    return M.upper_index(M.binned_cis(v.located()), n)


@query()
def pca_eig(v: Views) -> DataFrame:
    return M.principal_component(v.contacts(), 8).withColumn("x", r6("x"))


# Expressions and texts -------------------------------------------------------------------------


@query("", """SELECT l_orderkey, l_linenumber, round(l_extendedprice * (1 - l_discount) - 4.1 * l_tax, 4) AS a, (l_orderkey + 3 * l_partkey) % 7 AS b, l_orderkey // 3 AS c, round(power(l_quantity, 2), 4) AS d, -l_suppkey AS e, l_partkey << 2 AS f, l_partkey >> 1 AS g FROM lineitem""")
def expr_arith(v: Views) -> DataFrame:
    items = v.table("lineitem")
    e = partial(X.evaluate, rows=items)
    return items.select(
        "l_orderkey", "l_linenumber", F.round(e("l_extendedprice * (1 - l_discount) - 4.1 * l_tax"), 4).alias("a"), e("(l_orderkey + 3 * l_partkey) % 7").alias("b"),
        e("l_orderkey / 3").alias("c"), F.round(e("l_quantity ** 2"), 4).alias("d"), e("-l_suppkey").alias("e"), e("l_partkey << 2").alias("f"), e("l_partkey >> 1").alias("g"),
    )


@query("", "SELECT l_orderkey, l_linenumber, l_quantity < 10 AS a, l_returnflag >= 'N' AS b, (l_quantity > 5) AND (l_tax <= 0.04) AS c, NOT (l_linestatus = 'O') AS d FROM lineitem")
def expr_compare(v: Views) -> DataFrame:
    e = X.evaluate
    return v.table("lineitem").select("l_orderkey", "l_linenumber", e("l_quantity < 10").alias("a"), e("l_returnflag >= 'N'").alias("b"), e("(l_quantity > 5) & (l_tax <= 0.04)").alias("c"), e("~(l_linestatus == 'O')").alias("d"))


@query("", "SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity > 25 THEN l_extendedprice ELSE l_tax END AS a FROM lineitem")
def expr_where(v: Views) -> DataFrame:
    return v.table("lineitem").select("l_orderkey", "l_linenumber", X.evaluate("where(l_quantity > 25, l_extendedprice, l_tax)").alias("a"))


@query("", """SELECT l_orderkey, l_linenumber, round(sin(l_quantity), 8) AS a, round(cos(l_quantity), 8) AS b, round(atan2(l_tax, l_discount + 1), 8) AS c, round(asin(l_tax), 8) AS d, round(sinh(l_tax), 8) AS e, round(atanh(l_tax), 8) AS f FROM lineitem""")
def expr_trig(v: Views) -> DataFrame:
    e = X.evaluate
    parts = ("sin(l_quantity)", "cos(l_quantity)", "arctan2(l_tax, l_discount + 1)", "arcsin(l_tax)", "sinh(l_tax)", "arctanh(l_tax)")
    return v.table("lineitem").select("l_orderkey", "l_linenumber", *[F.round(e(p), 8).alias(n) for p, n in zip(parts, "abcdef", strict=True)])


@query("", """SELECT l_orderkey, l_linenumber, round(ln(l_quantity), 8) AS a, round(ln(1 + l_tax), 8) AS b, round(log10(l_extendedprice), 8) AS c, round(exp(l_tax), 8) AS d, round(exp(l_discount) - 1, 8) AS e, round(sqrt(l_extendedprice), 6) AS f, abs(l_tax - 0.04) AS g, fmod(l_extendedprice, 7) AS h FROM lineitem""")
def expr_log_exp(v: Views) -> DataFrame:
    e = X.evaluate
    parts = (("log(l_quantity)", 8), ("log1p(l_tax)", 8), ("log10(l_extendedprice)", 8), ("exp(l_tax)", 8), ("expm1(l_discount)", 8), ("sqrt(l_extendedprice)", 6))
    rows = [F.round(e(p), k).alias(n) for (p, k), n in zip(parts, "abcdef", strict=True)]
    return v.table("lineitem").select("l_orderkey", "l_linenumber", *rows, e("abs(l_tax - 0.04)").alias("g"), e("fmod(l_extendedprice, 7.0)").alias("h"))


@query("", "SELECT p_partkey, contains(p_name, 'a') AS a, p_type = p_name AS b, p_type > p_brand AS c FROM part")
def expr_contains(v: Views) -> DataFrame:
    e = X.evaluate
    return v.table("part").select("p_partkey", e("contains(p_name, 'a')").alias("a"), e("p_type == p_name").alias("b"), e("p_type > p_brand").alias("c"))


@query("", "SELECT l_returnflag, round(sum(l_quantity * l_tax), 2) AS total, round(sum(ln(1 + l_tax / 1000)), 6) AS log_product FROM lineitem GROUP BY 1")
def expr_sum_prod(v: Views) -> DataFrame:
    return v.table("lineitem").groupBy("l_returnflag").agg(F.round(F.sum(X.evaluate("l_quantity * l_tax")), 2).alias("total"), F.round(F.sum(X.evaluate("log(1 + l_tax / 1000)")), 6).alias("log_product"))


@query("", """SELECT l_orderkey, l_linenumber, round(a * c - b * d, 6) AS re, round(a * d + b * c, 6) AS im, round(sqrt(a * a + b * b), 6) AS size FROM (SELECT l_orderkey, l_linenumber, l_quantity AS a, l_tax AS b, l_discount AS c, l_suppkey AS d FROM lineitem)""")
def expr_complex(v: Views) -> DataFrame:
    a, b = X.complex_of(F.col("l_quantity"), F.col("l_tax")), X.complex_of(F.col("l_discount"), F.col("l_suppkey"))
    product = X.complex_multiply(a, b)
    return v.table("lineitem").select("l_orderkey", "l_linenumber", r6(product["re"]).alias("re"), r6(product["im"]).alias("im"), r6(X.complex_abs(a)).alias("size"))


@query("", "SELECT p_partkey, reverse(translate(p_name, 'ACGTacgt', 'TGCAtgca')) AS rc FROM part")
def seq_revcomp(v: Views) -> DataFrame:
    return v.table("part").select("p_partkey", S.reverse_complement(F.col("p_name")).alias("rc"))


@query("", "SELECT p_partkey, round(CASE WHEN length(p_name) > 0 THEN (length(p_name) - length(translate(p_name, 'GCgc', ''))) / length(p_name) ELSE 0 END, 6) AS gc FROM part")
def seq_gc(v: Views) -> DataFrame:
    return v.table("part").select("p_partkey", r6(S.gc_fraction(F.col("p_name"))).alias("gc"))


@query("", """SELECT gram, count(*) AS n FROM (SELECT substr(t, i, 2) AS gram FROM (SELECT t, unnest(generate_series(1, length(t) - 1)) AS i FROM (SELECT regexp_replace(lower(p_name || p_type), '[^a-z]', '', 'g') AS t FROM part) WHERE length(t) >= 2)) GROUP BY 1""")
def ngram_counts(v: Views) -> DataFrame:
    return S.ngram_counts(v.table("part").select(F.concat("p_name", "p_type").alias("t")), "t", 2, "a-z")


MOTIF = S.motif_weights([{"A": 8.0, "E": 2.0}, {"R": 6.0, "N": 4.0}], {k: 0.125 for k in "AEIRNTSO"})
_PWM = " + ".join("CASE substr(g, {k}, 1) ".format(k=k + 1) + " ".join(f"WHEN '{a}' THEN {w!r}" for a, w in c.items()) + " END" for k, c in enumerate(MOTIF))


@query("", f"""SELECT p_partkey, CAST(i - 1 AS INTEGER) AS at, round(CAST(s AS DOUBLE), 6) AS score FROM (SELECT p_partkey, i, {_PWM} AS s FROM (SELECT p_partkey, i, substr(upper(p_type), i, 2) AS g FROM (SELECT p_partkey, p_type, unnest(generate_series(1, length(p_type) - 1)) AS i FROM part))) WHERE s IS NOT NULL""")
def pwm_score(v: Views) -> DataFrame:
    return S.motif_scores(v.table("part"), "p_partkey", "p_type", MOTIF).withColumn("score", r6("score"))


# Reads on fragments, signals, samples -----------------------------------------------------------


def _site_reads(v: Views) -> DataFrame:
    """Pairs of line items of an order as reads near their parts' places."""
    e = v.elements().select(F.col("id").alias("l_partkey"), "chr", "mid")
    items = v.table("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").join(e, "l_partkey")
    end = lambda k: items.select(F.col("l_orderkey").alias("o"), F.col("l_linenumber").alias(f"l{k}"), F.col("chr").alias(f"c{k}"), (F.col("mid") + F.col("l_suppkey") % 900 - 450).alias(f"p{k}"), (F.col("l_suppkey") % 2).cast("int").alias(f"s{k}"))
    return end(1).join(end(2), "o").where("l1 < l2").drop("o", "l1", "l2")


def _sites(v: Views) -> DataFrame:
    return v.elements().select("chr", F.col("mid").alias("cut"))


_SITE_READS = """reads2 AS (SELECT a.chr AS c1, a.mid + a.l_suppkey % 900 - 450 AS p1, a.l_suppkey % 2 AS s1, b.chr AS c2, b.mid + b.l_suppkey % 900 - 450 AS p2, b.l_suppkey % 2 AS s2
    FROM (SELECT * FROM lineitem JOIN elements ON l_partkey = id) a JOIN (SELECT * FROM lineitem JOIN elements ON l_partkey = id) b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber < b.l_linenumber),
  frags AS (SELECT f.*, first FROM (SELECT chr, mid AS lo, lead(mid) OVER (PARTITION BY chr ORDER BY mid) AS hi, row_number() OVER (PARTITION BY chr ORDER BY mid) - 1 AS frag FROM elements) f
    JOIN (SELECT chr, coalesce(2 * sum(count(*) - 1) OVER (ORDER BY chr ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS first FROM elements GROUP BY chr) USING (chr) WHERE hi IS NOT NULL),
  placed AS (SELECT r.*, CAST(x.first + 2 * x.frag + CASE WHEN s1 = 1 THEN 1 ELSE 0 END AS BIGINT) AS half1, CASE WHEN s1 = 1 THEN x.hi - p1 ELSE p1 - x.lo END AS dist1, CAST(y.first + 2 * y.frag + CASE WHEN s2 = 1 THEN 1 ELSE 0 END AS BIGINT) AS half2,
    CASE WHEN s2 = 1 THEN y.hi - p2 ELSE p2 - y.lo END AS dist2 FROM {reads} r JOIN frags x ON c1 = x.chr AND p1 > x.lo AND p1 <= x.hi JOIN frags y ON c2 = y.chr AND p2 > y.lo AND p2 <= y.hi)"""
_DEDUPED = """(SELECT DISTINCT CASE WHEN f THEN c1 ELSE c2 END AS c1, CASE WHEN f THEN p1 ELSE p2 END AS p1, CASE WHEN f THEN s1 ELSE s2 END AS s1, CASE WHEN f THEN c2 ELSE c1 END AS c2, CASE WHEN f THEN p2 ELSE p1 END AS p2,
    CASE WHEN f THEN s2 ELSE s1 END AS s2 FROM (SELECT *, c1 < c2 OR (c1 = c2 AND (p1 < p2 OR (p1 = p2 AND s1 <= s2))) AS f FROM reads2))"""


@query()
def reads_to_contacts(v: Views) -> DataFrame:
    return Re.reads_to_contacts(_site_reads(v), _sites(v), 30000)


ORACLE_SQL["reads_to_contacts"] = sql("elements", "") + ", " + _SITE_READS.format(reads=_DEDUPED) + """ SELECT id1, id2, count(*) AS n FROM (SELECT least(half1, half2) AS id1, greatest(half1, half2) AS id2 FROM placed WHERE dist1 + dist2 <= 30000)
    WHERE NOT (id1 = id2 OR (id1 % 2 = 0 AND id2 IN (id1 + 1, id1 + 3)) OR (id1 % 2 = 1 AND id2 = id1 + 1)) GROUP BY 1, 2"""


@query()
def same_fragment_metrics(v: Views) -> DataFrame:
    return Re.same_fragment_metrics(Re.locate_ends(_site_reads(v), _sites(v)))


ORACLE_SQL["same_fragment_metrics"] = sql("elements", "") + ", " + _SITE_READS.format(reads="reads2") + """ SELECT CASE WHEN half1 // 2 = half2 // 2 AND s1 = s2 THEN 'same_strand' WHEN half1 // 2 = half2 // 2 AND ((p1 < p2 AND s1 = 0) OR (p1 > p2 AND s1 = 1)) THEN 'self_circle'
    WHEN half1 // 2 = half2 // 2 THEN 'dangling_end' WHEN c1 = c2 AND abs(half1 // 2 - half2 // 2) = 1 THEN 'neighbour' ELSE 'mapped' END AS kind, count(*) AS n FROM placed GROUP BY 1"""


@query()
def near_site_filter(v: Views) -> DataFrame:
    return Re.near_site_filter(Re.locate_ends(_site_reads(v), _sites(v)), 400).groupBy("c1", "c2").agg(F.count("*").alias("n"))


ORACLE_SQL["near_site_filter"] = sql("elements", "") + ", " + _SITE_READS.format(reads="reads2") + " SELECT c1, c2, count(*) AS n FROM placed WHERE dist1 >= 400 AND dist2 >= 400 GROUP BY 1, 2"



_EXPECTED = """SELECT a.chr, a.bin AS bin1, b.bin AS bin2, a.s * b.s AS e FROM (SELECT chr, bin, sum({w}) AS s FROM be GROUP BY 1, 2) a JOIN (SELECT chr, bin, sum({w}) AS s FROM be GROUP BY 1, 2) b ON a.chr = b.chr AND a.bin < b.bin"""


def _signal_sql(weight: str) -> str:
    return f"""SELECT chr, bin1, bin2, o AS observed, round(e, 6) AS expected FROM (SELECT x.*, coalesce(CAST(obs AS DOUBLE), 0) AS o FROM ({_EXPECTED.format(w=weight)}) x LEFT JOIN cis USING (chr, bin1, bin2))"""


@query("cis be", _signal_sql("CAST(1 AS DOUBLE)"))
def signal_raw(v: Views) -> DataFrame:
    return Si.cis_signal(v.located(), v.weighted_elements(), BIN, "raw").withColumn("expected", r6("expected"))


@query("cis be", _signal_sql("gc / 997.13"))
def signal_fend(v: Views) -> DataFrame:
    return Si.cis_signal(v.located(), v.weighted_elements(), BIN, "fend").withColumn("expected", r6("expected"))


@query("trans be", """SELECT t.chr1, t.bin1, t.chr2, t.bin2, CAST(obs AS DOUBLE) AS observed, round(m * a.s * b.s, 6) AS expected FROM trans t JOIN (SELECT chr, bin, sum(gc / 997.13) AS s FROM be GROUP BY 1, 2) a ON t.chr1 = a.chr AND t.bin1 = a.bin
    JOIN (SELECT chr, bin, sum(gc / 997.13) AS s FROM be GROUP BY 1, 2) b ON t.chr2 = b.chr AND t.bin2 = b.bin JOIN (SELECT chr1, chr2, o / (x.t * y.t) AS m FROM (SELECT chr1, chr2, sum(obs) AS o FROM trans GROUP BY 1, 2)
    JOIN (SELECT chr, sum(gc / 997.13) AS t FROM be GROUP BY 1) x ON chr1 = x.chr JOIN (SELECT chr, sum(gc / 997.13) AS t FROM be GROUP BY 1) y ON chr2 = y.chr) q ON t.chr1 = q.chr1 AND t.chr2 = q.chr2""")
def signal_trans(v: Views) -> DataFrame:
    return Si.trans_signal(v.located(), v.weighted_elements()).withColumn("expected", r6("expected"))


@query()
def random_placement(v: Views) -> DataFrame:
    """Orders' intervals thrown into the free positions between line items' intervals, twice."""
    sizes = v.iv_a().select("id", (F.col("end") - F.col("start")).alias("size"))
    return Ra.place(v.lengths(), v.iv_b(), sizes, 2, 11)


@query()
def overlap_permutation(v: Views) -> DataFrame:
    return Ra.overlap_z_score(v.iv_a(), v.iv_b(), v.lengths(), v.iv_b().where("false"), 5, 7)


# Feature-bin models, tables --------------------------------------------------------------------


def _feature_counts(v: Views) -> DataFrame:
    return v.located().groupBy("bin1", "bin2").agg(F.sum("n").alias("observed"), F.count("*").alias("possible"))


@query()
def binning_fit(v: Views) -> DataFrame:
    return Mo.fit_feature_bins(_feature_counts(v), ["bin1", "bin2"], 2).withColumn("correction", r6("correction"))


def _fit_sql(passes: int) -> str:
    counts = "counts AS MATERIALIZED (SELECT bin1, bin2, sum(n) AS observed, count(*) AS possible FROM lc GROUP BY 1, 2)"
    base = "base AS MATERIALIZED (SELECT *, possible * (SELECT sum(observed) / sum(possible) FROM counts) AS e FROM counts)"
    parts = [counts, base] + [f"{d}_0 AS (SELECT DISTINCT {d}, CAST(1 AS DOUBLE) AS c FROM base)" for d in ("bin1", "bin2")]
    at = {"bin1": "bin1_0", "bin2": "bin2_0"}
    for k in range(passes):
        for d in ("bin1", "bin2"):
            parts.append(f"{d}_{k + 1} AS MATERIALIZED (SELECT base.{d}, x.c * sum(observed) / sum(e * x.c * y.c) AS c FROM base JOIN {at[d]} x ON base.{d} = x.{d} JOIN {at['bin2' if d == 'bin1' else 'bin1']} y ON base.{'bin2' if d == 'bin1' else 'bin1'} = y.{'bin2' if d == 'bin1' else 'bin1'} GROUP BY base.{d}, x.c)")
            at[d] = f"{d}_{k + 1}"
    last = " UNION ALL ".join(f"SELECT '{d}' AS dimension, {d} AS value, round(c, 6) AS correction FROM {at[d]}" for d in at)
    return sql("lc", "") + ", " + ", ".join(parts) + " " + last


ORACLE_SQL["binning_fit"] = _fit_sql(2)


@query("contacts", """SELECT c.id1, c.id2, c.n, coalesce(k, 0) AS k FROM contacts c LEFT JOIN (SELECT least(l_partkey, l_suppkey) AS a, greatest(l_partkey, l_suppkey) AS b, count(*) AS k FROM lineitem GROUP BY 1, 2) ON a = least(id1, id2) AND b = greatest(id1, id2)""")
def symmetric_left_join(v: Views) -> DataFrame:
    counts = v.table("lineitem").groupBy(F.least("l_partkey", "l_suppkey").alias("id1"), F.greatest("l_partkey", "l_suppkey").alias("id2")).agg(F.count("*").alias("k"))
    return T.symmetric_join_default(v.contacts(), counts, "id1", "id2", "k", 0)


@query("elements ends", "SELECT e.id, coalesce(t, 0) AS total FROM elements e LEFT JOIN (SELECT id, CAST(sum(value) AS BIGINT) AS t FROM ends GROUP BY id) d ON e.id = d.id")
def restore_zero_bins(v: Views) -> DataFrame:
    return T.fill_missing(C.degree(v.contacts()), v.elements(), ["id"], "total", 0)


@query("elements", "SELECT id, chr, CAST(coalesce(sum(len) OVER (PARTITION BY chr ORDER BY mid, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS upto FROM elements")
def prefix_offsets(v: Views) -> DataFrame:
    return T.running_sum(v.elements(), "chr", ["mid", "id"], "len").select("id", "chr", "upto")


@query("elements", "SELECT id, chr FROM (SELECT *, coalesce(sum(len) OVER (PARTITION BY chr ORDER BY mid, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS upto FROM elements) WHERE upto < 500")
def truncate_after_total(v: Views) -> DataFrame:
    return T.truncate_after(v.elements(), "chr", ["mid", "id"], "len", 500).select("id", "chr")


@query("elements", "SELECT id, chr, CAST(dense_rank() OVER (PARTITION BY chr ORDER BY len) - 1 AS INTEGER) AS dense FROM elements")
def dense_rank_ids(v: Views) -> DataFrame:
    return T.dense_ids(v.elements(), ["chr", "len"]).select("id", "chr", "dense")


@query("", """SELECT count(*) AS n, round(corr(a, b), 6) AS rho FROM (SELECT rank() OVER (ORDER BY l_extendedprice) + (count(*) OVER (PARTITION BY l_extendedprice) - 1) / 2.0 AS a, rank() OVER (ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_quantity) - 1) / 2.0 AS b FROM lineitem)""")
def spearman_correlation(v: Views) -> DataFrame:
    return T.spearman(v.table("lineitem"), "l_extendedprice", "l_quantity").withColumn("rho", r6("rho"))


@query("", "SELECT p_partkey, CAST(i - 1 AS INTEGER) AS at FROM (SELECT p_partkey, upper(p_name) AS t, unnest(generate_series(1, length(p_name) - 1)) AS i FROM part) WHERE regexp_matches(substr(t, i, 2), '^[AG][ACGT]$')")
def consensus_places(v: Views) -> DataFrame:
    return Al.consensus_places(v.table("part"), "p_partkey", "p_name", "RN")


# More of matrices and models --------------------------------------------------------------------


@query("elements contacts", """SELECT x.chr, least(x.bin, y.bin) AS bin1, greatest(x.bin, y.bin) AS bin2, round(sum(n * x.share * y.share), 6) AS obs FROM contacts
    JOIN (SELECT id, chr, bin, (least(stop, (bin + 1) * 5000) - greatest(start, bin * 5000)) / 5000.0::DOUBLE AS share FROM (SELECT *, unnest(generate_series(CAST(floor(start / 5000) AS BIGINT), (stop - 1) // 5000)) AS bin FROM elements WHERE start >= 0)) x ON id1 = x.id
    JOIN (SELECT id, chr, bin, (least(stop, (bin + 1) * 5000) - greatest(start, bin * 5000)) / 5000.0::DOUBLE AS share FROM (SELECT *, unnest(generate_series(CAST(floor(start / 5000) AS BIGINT), (stop - 1) // 5000)) AS bin FROM elements WHERE start >= 0)) y ON id2 = y.id
    WHERE x.chr = y.chr GROUP BY 1, 2, 3""")
def overlap_heatmap(v: Views) -> DataFrame:
    shares = L.proportional_bins(v.elements().where("start >= 0"), 5000)
    return M.overlap_heatmap(v.contacts(), shares).withColumn("obs", r6("obs"))


@query("lc", """SELECT CASE WHEN f THEN chr1 ELSE chr2 END AS chr1, CASE WHEN f THEN bin1 ELSE bin2 END AS bin1, CASE WHEN f THEN chr2 ELSE chr1 END AS chr2, CASE WHEN f THEN bin2 ELSE bin1 END AS bin2, CAST(sum(n) AS BIGINT) AS total, count(*) AS pairs
    FROM (SELECT *, chr1 < chr2 OR (chr1 = chr2 AND bin1 <= bin2) AS f FROM lc) GROUP BY 1, 2, 3, 4""")
def coordinate_bin_counts(v: Views) -> DataFrame:
    return M.coordinate_counts(v.located())


_LEN10 = "CAST(least(floor((len - lo) / ((hi - lo) / 4.0)), 3) AS BIGINT)"


@query("be", f"""SELECT a.chr, a.bin AS bin1, b.bin AS bin2, round(0.01 * sum(1 + 0.5 * a.f * b.f), 6)::DOUBLE AS expected FROM (SELECT *, {_LEN10} AS f FROM be, (SELECT min(len) AS lo, max(len) AS hi FROM be)) a JOIN (SELECT *, {_LEN10} AS f FROM be, (SELECT min(len) AS lo, max(len) AS hi FROM be)) b
    ON a.chr = b.chr AND b.bin - a.bin BETWEEN 1 AND 4 GROUP BY 1, 2, 3""")
def expected_integral(v: Views) -> DataFrame:
    e = L.equal_width_bins(v.binned_elements(), "len", 4)
    k = v.spark.range(4)
    factors = k.select(F.col("id").alias("fbin1")).crossJoin(F.broadcast(k.select(F.col("id").alias("fbin2")))).withColumn("f", 1 + 0.5 * F.col("fbin1") * F.col("fbin2"))
    return M.expected_integral(e, factors, 0.01, 4).withColumn("expected", r6("expected"))


@query("contacts elements", "SELECT id1, id2, n, round(n / ((x.gc / 997.13) * (y.gc / 997.13)), 6) AS value FROM contacts JOIN elements x ON id1 = x.id JOIN elements y ON id2 = y.id")
def corrected_contacts(v: Views) -> DataFrame:
    return M.corrected(v.contacts(), v.elements().select("id", (F.col("gc") / 997.13).alias("bias"))).withColumn("value", r6("value"))


@query("ends elements", "SELECT e.id, round(sum(value / (x.gc * y.gc)) * 1e6, 4) AS total FROM ends e JOIN elements x ON e.id = x.id JOIN elements y ON e.other = y.id GROUP BY e.id")
def fragment_weight_sums(v: Views) -> DataFrame:
    got = M.fragment_weights(v.contacts(), v.elements().select("id", F.col("gc").alias("w")))
    return got.withColumn("total", F.round(F.col("total") * 1e6, 4))


@query()
def express_log_k(v: Views) -> DataFrame:
    located = v.located().where("chr1 = chr2 and mid1 <> mid2")
    expected = located.select("id1", "id2", (-F.log(F.abs(F.col("mid2") - F.col("mid1"))) / 10).alias("e"))
    return Mo.express_log(located.select("id1", "id2", "n"), expected, 2).withColumn("c", r6("c"))


ORACLE_SQL["express_log_k"] = sql("lc", "") + """, r AS MATERIALIZED (SELECT id1, id2, ln(n) + ln(abs(mid2 - mid1)) / 10 AS r FROM lc WHERE chr1 = chr2 AND mid1 <> mid2), e AS MATERIALIZED (SELECT id1 AS id, id2 AS other, r FROM r UNION ALL SELECT id2, id1, r FROM r),
    s0 AS MATERIALIZED (SELECT DISTINCT id, CAST(0 AS DOUBLE) AS c FROM e), s1 AS MATERIALIZED (SELECT e.id, a.c + 0.5 * sum(r - a.c - b.c) / count(*) AS c FROM e JOIN s0 a ON e.id = a.id JOIN s0 b ON e.other = b.id GROUP BY e.id, a.c),
    s2 AS MATERIALIZED (SELECT e.id, a.c + 0.5 * sum(r - a.c - b.c) / count(*) AS c FROM e JOIN s1 a ON e.id = a.id JOIN s1 b ON e.other = b.id GROUP BY e.id, a.c) SELECT id, round(c, 6) AS c FROM s2"""


@query("elements", f"""SELECT DISTINCT q.rid, q.chr, q.pos, CASE WHEN q.rid % 2 = 1 THEN (SELECT min(mid) FROM elements t WHERE t.chr = q.chr AND t.mid >= q.pos) ELSE (SELECT max(mid) FROM elements t WHERE t.chr = q.chr AND t.mid <= q.pos) END AS site FROM {_POINTS} q""")
def nearest_site_by_strand(v: Views) -> DataFrame:
    reads = _points(v).distinct().withColumn("strand", F.col("rid") % 2)
    return Re.nearest_site_by_strand(reads, _sites(v))


@query("iv_a", """SELECT a.id, CAST(sum(least(a."end", b."end") - greatest(a.start, b.start)) AS BIGINT) AS shared, count(*) AS n FROM iv_a a JOIN iv_a b ON a.chr = b.chr AND a.id <> b.id AND a.start < b."end" AND b.start < a."end" GROUP BY a.id""")
def iv_self_overlap(v: Views) -> DataFrame:
    return I.overlap_join(v.iv_a(), v.iv_a()).where("id <> id2").groupBy("id").agg(F.sum("overlap").alias("shared"), F.count("*").alias("n"))
