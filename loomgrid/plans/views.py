"""How the star-schema tables play elements, contacts, reads, intervals and tracks; in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import contacts as C
from ..operators import locate as L

#: Bin size over the elements' positions, and the finer one that rebinning starts from.
BIN = 100_000
FINE = 25_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _seconds(c: str) -> Column:
    """Seconds since 1970 by the clock that the timestamp shows, whatever the session's time zone."""
    days = F.datediff(F.to_date(c), F.lit("1970-01-01").cast("date")).cast("long")
    return days * 86400 + F.hour(c) * 3600 + F.minute(c) * 60 + F.second(c)


class Views:
    """The views over one folder of tables, each a lazy DataFrame."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return table(self.spark, self.dir, name)

    def elements(self) -> DataFrame:
        mid = (F.col("p_partkey") * 1000 + F.col("p_size") * 10).cast("long")
        return self.table("part").select(
            F.col("p_partkey").alias("id"), F.col("p_brand").alias("chr"), mid.alias("mid"), (mid - 100 * F.col("p_size")).alias("start"),
            (mid + 100 * F.col("p_size")).alias("stop"), F.col("p_size").cast("long").alias("len"), F.col("p_retailprice").alias("gc"),
        )

    def contacts(self) -> DataFrame:
        return C.pair_counts(self.table("lineitem"), "l_orderkey", "l_partkey")

    def binned_elements(self, size: int = BIN) -> DataFrame:
        return L.fixed_bins(self.elements(), size)

    def weighted_elements(self) -> DataFrame:
        """Binned elements with a factor ``c`` and ``pos``, their place from the start of the first bin."""
        e = self.elements()
        return self.binned_elements().join(L.bin_start(e, BIN), "chr").withColumn("pos", F.col("mid") - F.col("origin")).withColumn("c", F.col("gc") / 997.13).drop("origin")

    def located(self, size: int = BIN) -> DataFrame:
        """Contacts with chr, mid, bin and len of both elements."""
        return C.with_elements(self.contacts(), self.binned_elements(size), ("chr", "mid", "bin", "len"))

    def reads(self) -> DataFrame:
        k = F.col("l_suppkey") % 3
        return self.table("lineitem").select(
            F.col("l_returnflag").alias("c1"), F.col("l_partkey").alias("p1"), (F.col("l_linenumber") % 2).cast("int").alias("s1"),
            F.when(k == 0, "A").when(k == 1, "N").otherwise("R").alias("c2"), F.col("l_suppkey").alias("p2"), (F.floor("l_quantity") % 2).cast("int").alias("s2"),
        )

    def iv_a(self) -> DataFrame:
        start = F.floor(_seconds("o_orderdate") / 86400) * 1000 + F.col("o_orderkey") % 997
        return self.table("orders").select(
            F.col("o_orderpriority").alias("chr"), start.alias("start"), (start + 200 * (1 + F.col("o_orderkey") % 3)).alias("end"), F.col("o_orderkey").alias("id"),
            F.when(F.col("o_custkey") % 2 == 0, "+").otherwise("-").alias("strand"),
        )

    def iv_b(self) -> DataFrame:
        """Different intervals of the line items, named by their place."""
        start = F.floor(_seconds("l_shipdate") / 86400) * 1000 + F.col("l_partkey") % 997
        items = self.table("lineitem").select("l_orderkey", start.alias("start"), (start + 100 * (1 + F.floor("l_quantity") % 7)).alias("end"))
        keyed = items.join(self.table("orders").select("o_orderkey", F.col("o_orderpriority").alias("chr")), items.l_orderkey == F.col("o_orderkey"))
        return keyed.select("chr", "start", "end").distinct().withColumn("id", F.concat_ws(":", "chr", "start", "end"))

    def lengths(self) -> DataFrame:
        """(chr, length): one length for all chromosomes that intervals lie on, past the last end."""
        return self.table("orders").select(F.col("o_orderpriority").alias("chr")).distinct().withColumn("length", F.lit(30_000_000).cast("long"))

    def track(self) -> DataFrame:
        return self.table("events").select(F.col("event_type").alias("chr"), _seconds("ts").alias("pos"), F.col("value").alias("val"), F.col("event_id").alias("id"))


SQL = {
    "elements": """SELECT p_partkey AS id, p_brand AS chr, CAST(p_partkey*1000+p_size*10 AS BIGINT) AS mid, CAST(p_partkey*1000+p_size*10-100*p_size AS BIGINT) AS start,
        CAST(p_partkey*1000+p_size*10+100*p_size AS BIGINT) AS stop, CAST(p_size AS BIGINT) AS len, p_retailprice AS gc FROM part""",
    "contacts": """SELECT a.e AS id1, b.e AS id2, count(*) AS n FROM (SELECT DISTINCT l_orderkey AS g, l_partkey AS e FROM lineitem) a
        JOIN (SELECT DISTINCT l_orderkey AS g, l_partkey AS e FROM lineitem) b ON a.g = b.g AND a.e < b.e GROUP BY 1, 2""",
    "origins": f"SELECT chr, min(mid) // {BIN} * {BIN} AS origin, min(mid) // {FINE} * {FINE} AS fine_origin FROM elements GROUP BY chr",
    "be": f"SELECT e.*, (mid - origin) // {BIN} AS bin, (mid - fine_origin) // {FINE} AS fbin FROM elements e JOIN origins USING (chr)",
    "lc": """SELECT id1, id2, n, x.chr AS chr1, x.mid AS mid1, x.bin AS bin1, x.fbin AS fbin1, x.len AS len1, y.chr AS chr2, y.mid AS mid2, y.bin AS bin2, y.fbin AS fbin2, y.len AS len2
        FROM contacts JOIN be x ON id1 = x.id JOIN be y ON id2 = y.id""",
    "ends": "SELECT id1 AS id, id2 AS other, n AS value FROM contacts UNION ALL SELECT id2, id1, n FROM contacts",
    "cis": "SELECT chr1 AS chr, least(bin1, bin2) AS bin1, greatest(bin1, bin2) AS bin2, CAST(sum(n) AS BIGINT) AS obs FROM lc WHERE chr1 = chr2 AND bin1 <> bin2 GROUP BY 1, 2, 3",
    "fine_cis": "SELECT chr1 AS chr, least(fbin1, fbin2) AS bin1, greatest(fbin1, fbin2) AS bin2, CAST(sum(n) AS BIGINT) AS obs FROM lc WHERE chr1 = chr2 AND fbin1 <> fbin2 GROUP BY 1, 2, 3",
    "trans": """SELECT CASE WHEN chr1 < chr2 THEN chr1 ELSE chr2 END AS chr1, CASE WHEN chr1 < chr2 THEN bin1 ELSE bin2 END AS bin1, CASE WHEN chr1 < chr2 THEN chr2 ELSE chr1 END AS chr2,
        CASE WHEN chr1 < chr2 THEN bin2 ELSE bin1 END AS bin2, CAST(sum(n) AS BIGINT) AS obs FROM lc WHERE chr1 <> chr2 GROUP BY 1, 2, 3, 4""",
    "marg": "SELECT chr, bin, CAST(sum(obs) AS BIGINT) AS total, count(*) AS cells FROM (SELECT chr, bin1 AS bin, obs FROM cis UNION ALL SELECT chr, bin2, obs FROM cis) GROUP BY 1, 2",
    "reads": """SELECT l_returnflag AS c1, l_partkey AS p1, CAST(l_linenumber % 2 AS INTEGER) AS s1, CASE l_suppkey % 3 WHEN 0 THEN 'A' WHEN 1 THEN 'N' ELSE 'R' END AS c2, l_suppkey AS p2,
        CAST(CAST(floor(l_quantity) AS BIGINT) % 2 AS INTEGER) AS s2 FROM lineitem""",
    "creads": """SELECT CASE WHEN f THEN c1 ELSE c2 END AS c1, CASE WHEN f THEN p1 ELSE p2 END AS p1, CASE WHEN f THEN s1 ELSE s2 END AS s1, CASE WHEN f THEN c2 ELSE c1 END AS c2,
        CASE WHEN f THEN p2 ELSE p1 END AS p2, CASE WHEN f THEN s2 ELSE s1 END AS s2
        FROM (SELECT *, c1 < c2 OR (c1 = c2 AND (p1 < p2 OR (p1 = p2 AND s1 <= s2))) AS f FROM reads)""",
    "iv_a": """SELECT o_orderpriority AS chr, s AS start, s + 200 * (1 + o_orderkey % 3) AS "end", o_orderkey AS id, CASE WHEN o_custkey % 2 = 0 THEN '+' ELSE '-' END AS strand
        FROM (SELECT *, CAST(floor(epoch(o_orderdate) / 86400) AS BIGINT) * 1000 + o_orderkey % 997 AS s FROM orders)""",
    "iv_b": """SELECT chr, start, "end", chr || ':' || start || ':' || "end" AS id FROM (SELECT DISTINCT o_orderpriority AS chr, s AS start, s + 100 * (1 + CAST(floor(l_quantity) AS BIGINT) % 7) AS "end"
        FROM (SELECT *, CAST(floor(epoch(l_shipdate) / 86400) AS BIGINT) * 1000 + l_partkey % 997 AS s FROM lineitem) JOIN orders ON l_orderkey = o_orderkey)""",
    "track": "SELECT event_type AS chr, CAST(floor(epoch(ts)) AS BIGINT) AS pos, value AS val, event_id AS id FROM events",
    "ma": """SELECT chr, min(start) AS start, max("end") AS "end" FROM (SELECT *, sum(f) OVER (PARTITION BY chr ORDER BY start, "end" ROWS UNBOUNDED PRECEDING) AS g FROM (SELECT chr, start, "end",
        CASE WHEN start <= max("end") OVER (PARTITION BY chr ORDER BY start, "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS f FROM iv_a)) GROUP BY chr, g""",
    "mb": """SELECT chr, min(start) AS start, max("end") AS "end" FROM (SELECT *, sum(f) OVER (PARTITION BY chr ORDER BY start, "end" ROWS UNBOUNDED PRECEDING) AS g FROM (SELECT chr, start, "end",
        CASE WHEN start <= max("end") OVER (PARTITION BY chr ORDER BY start, "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS f FROM iv_b)) GROUP BY chr, g""",
    "cov": """SELECT a.chr, a.start, a."end", a.id, a.strand, CAST(coalesce(sum(CASE WHEN mb.start IS NOT NULL THEN least(a."end", mb."end") - greatest(a.start, mb.start) END), 0) AS BIGINT) AS bases
        FROM iv_a a LEFT JOIN mb ON a.chr = mb.chr AND a.start < mb."end" AND mb.start < a."end" GROUP BY ALL""",
    "pairs": """SELECT a.chr, a.start, a."end", a.id, a.strand, b.chr AS chr2, b.start AS start2, b."end" AS end2, b.id AS id2, least(a."end", b."end") - greatest(a.start, b.start) AS overlap
        FROM iv_a a JOIN iv_b b ON a.chr = b.chr AND a.start < b."end" AND b.start < a."end" """,
}
NEEDS = {
    "origins": "elements", "be": "elements origins", "lc": "contacts be", "ends": "contacts", "cis": "lc", "fine_cis": "lc", "trans": "lc", "marg": "cis",
    "creads": "reads", "ma": "iv_a", "mb": "iv_b", "cov": "iv_a mb", "pairs": "iv_a iv_b",
}


def sql(uses: str, body: str) -> str:
    """``body`` with the views that it uses, and those that they use, before it."""
    found: dict[str, str] = {}

    def add(name: str) -> None:
        for other in NEEDS.get(name, "").split():
            add(other)
        found.setdefault(name, SQL[name])

    for name in uses.split():
        add(name)
    if not found:
        return body
    heads = ", ".join(f"{k} AS MATERIALIZED ({v})" for k, v in found.items())
    return f"WITH {heads} {body}"
