"""Sources and sinks in queries: the tables written in a text format, read back, and the same rows in SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import alignments as Al
from ..functions import sequences as S
from ..operators import contacts as C
from ..operators import matrix as M
from ..operators import tables as T
from ..session import shared_path
from ..sources import sinks, text
from .registry import query
from .views import Views


def lines(v: Views, rows: DataFrame, *columns: str | Column, sep: str = "\t") -> str:
    """The path of text files with the columns of each row in a line."""
    path = shared_path(v.spark, "text")
    rows.select(F.concat_ws(sep, *[F.col(c).cast("string") if isinstance(c, str) else c.cast("string") for c in columns]).alias("value")).write.text(path)
    return path


_HALVES = """(SELECT chr, CASE WHEN h = 0 THEN cut ELSE m END AS start, CASE WHEN h = 0 THEN m ELSE nxt END AS stop, (CASE WHEN h = 0 THEN cut + m ELSE m + nxt END) // 2 AS mid
    FROM (SELECT chr, mid AS cut, lead(mid) OVER w AS nxt, (mid + lead(mid) OVER w) // 2 AS m FROM elements WINDOW w AS (PARTITION BY chr ORDER BY mid)), (SELECT unnest([0, 1]) AS h) WHERE nxt IS NOT NULL)"""


@query("elements", f"SELECT row_number() OVER (ORDER BY chr, start, stop) - 1 AS id, chr, start, stop, mid FROM {_HALVES}")
def scan_cut_sites(v: Views) -> DataFrame:
    e = v.elements()
    return text.half_fragments_from_bed(v.spark, lines(v, e, "chr", F.col("mid") - 3, F.col("mid") + 3, "id", F.lit(0), F.lit("+")))


@query("elements", """SELECT row_number() OVER (ORDER BY chr, start, stop) - 1 AS id, chr, start, stop, CAST(floor((start + stop) / 2.0) AS BIGINT) AS mid FROM (SELECT chr, CASE WHEN h = 0 THEN start ELSE m END AS start, CASE WHEN h = 0 THEN m ELSE stop END AS stop
    FROM (SELECT *, CAST(floor((start + stop) / 2.0) AS BIGINT) AS m FROM elements), (SELECT unnest([0, 1]) AS h))""")
def scan_fragments(v: Views) -> DataFrame:
    return text.half_fragments_from_bed(v.spark, lines(v, v.elements(), "chr", "start", "stop", "id", F.lit(0), F.lit("+")))


@query("elements", """SELECT id, chr, CASE WHEN id % 2 = 0 THEN mid ELSE mid + 1 - len + len // 2 END AS start, CASE WHEN id % 2 = 0 THEN mid + len // 2 ELSE mid + 1 END AS stop,
    ((CASE WHEN id % 2 = 0 THEN mid ELSE mid + 1 - len + len // 2 END) + (CASE WHEN id % 2 = 0 THEN mid + len // 2 ELSE mid + 1 END)) // 2 AS mid, gc FROM elements""")
def scan_fend_table(v: Views) -> DataFrame:
    path = shared_path(v.spark, "fends")
    e = v.elements()
    e.select((F.col("id") + 1).alias("fend"), F.col("id").alias("frag"), "chr", F.col("mid").alias("coord"), F.lit(1).alias("valid"), F.col("len").alias("frag_len"), "gc").write.csv(path, sep="\t", header=True)
    return text.fend_table(v.spark, path)


@query("elements", """SELECT id, chr, start, stop, mid, name, strand, CAST(sum(opens) OVER (PARTITION BY chr ORDER BY mid, id ROWS UNBOUNDED PRECEDING) - 1 AS BIGINT) AS region FROM (SELECT *, CASE WHEN mid - lag(mid) OVER (PARTITION BY chr ORDER BY mid, id) < 60000 THEN 0 ELSE 1 END AS opens
    FROM (SELECT row_number() OVER (ORDER BY chr, start, stop, id) - 1 AS id, chr, start, stop, CAST(floor((start + stop) / 2.0) AS BIGINT) AS mid, 'f' || id AS name, CASE WHEN len % 3 = 0 THEN '-' ELSE '+' END AS strand FROM elements WHERE len % 5 <> 0))""")
def scan_primers(v: Views) -> DataFrame:
    """Every fifth line has no strand, and is left out."""
    strand = F.when(F.col("len") % 5 == 0, ".").when(F.col("len") % 3 == 0, "-").otherwise("+")
    return text.primers_from_bed(v.spark, lines(v, v.elements(), "chr", "start", "stop", F.concat(F.lit("f"), "id"), F.lit(0), strand), 60_000)


@query("reads", "SELECT c1, p1, s1, c2, p2, s2, count(*) AS n FROM reads GROUP BY ALL")
def scan_raw_pairs(v: Views) -> DataFrame:
    sign = lambda c: F.when(F.col(c) == 1, "+").otherwise("-")
    got = text.raw_pairs(v.spark, lines(v, v.reads(), "c1", "p1", sign("s1"), "c2", "p2", sign("s2")))
    return got.groupBy("c1", "p1", "s1", "c2", "p2", "s2").agg(F.count("*").alias("n"))


def _sam(v: Views, k: int) -> str:
    """Alignments of one end of each order, every seventh unmapped, every fifth marked as one of several."""
    o = v.table("orders")
    place, chrom = (F.col("o_custkey"), F.col("o_orderstatus")) if k == 1 else (F.col("o_orderkey"), F.col("o_orderpriority"))
    flag = F.when(F.col("o_orderkey") % 7 == 0, 4).when((F.col("o_custkey") + k) % 2 == 0, 16).otherwise(0)
    tag = F.when(F.col("o_orderkey") % 5 == 0, "XS:i:3").otherwise("NM:i:0")
    letters = F.expr("repeat('A', cast(o_custkey % 9 as int) + 10)")
    return lines(v, o, "o_orderkey", flag, chrom, place, F.lit(30), F.lit("*"), F.lit("="), F.lit(0), F.lit(0), letters, F.lit("*"), tag)


_END = "CASE WHEN (o_custkey + {k}) % 2 = 0 THEN {p} + o_custkey % 9 + 10 ELSE {p} END AS p{k}, CASE WHEN (o_custkey + {k}) % 2 = 0 THEN 0 ELSE 1 END AS s{k}"


@query("", """SELECT CAST(o_orderkey AS VARCHAR) AS name, o_orderstatus AS chr, o_custkey - 1 AS start, o_custkey + o_custkey % 9 + 9 AS "end", CASE WHEN (o_custkey + 1) % 2 = 0 THEN '-' ELSE '+' END AS strand FROM orders WHERE o_orderkey % 7 <> 0 AND o_orderkey % 5 <> 0""")
def scan_sam_to_bed(v: Views) -> DataFrame:
    return text.sam_to_bed(text.sam(v.spark, _sam(v, 1), unique_only=True)).select("name", "chr", "start", "end", "strand")


@query("", f"SELECT o_orderstatus AS c1, o_orderpriority AS c2, {_END.format(k=1, p='o_custkey')}, {_END.format(k=2, p='o_orderkey')} FROM orders WHERE o_orderkey % 7 <> 0")
def scan_sam_pairs(v: Views) -> DataFrame:
    got = text.paired_sam(text.sam(v.spark, _sam(v, 1)), text.sam(v.spark, _sam(v, 2)))
    return got.select("c1", "c2", "p1", F.col("s1").cast("int").alias("s1"), "p2", F.col("s2").cast("int").alias("s2"))


@query("contacts", "SELECT id1, id2, n FROM contacts")
def scan_mat_triples(v: Views) -> DataFrame:
    path = shared_path(v.spark, "mat")
    sinks.mat(v.contacts(), path)
    return text.mat_triples(v.spark, path)


@query("", """SELECT least(x.p_partkey, y.p_partkey) AS id1, greatest(x.p_partkey, y.p_partkey) AS id2, CAST(sum(l_linenumber) AS BIGINT) AS n FROM lineitem JOIN part x ON l_partkey = x.p_partkey JOIN part y ON l_suppkey = y.p_partkey
    WHERE x.p_partkey <> y.p_partkey AND (x.p_size % 2 = 0) <> (y.p_size % 2 = 0) GROUP BY 1, 2""")
def counts_by_name(v: Views) -> DataFrame:
    items = v.table("lineitem")
    name = lambda c: F.concat(F.lit("f"), F.col(c).cast("string"))
    path = lines(v, items, name("l_partkey"), name("l_suppkey"), "l_linenumber")
    fragments = v.table("part").select(F.col("p_partkey").alias("id"), name("p_partkey").alias("name"), F.when(F.col("p_size") % 2 == 0, "+").otherwise("-").alias("strand"))
    return C.named_counts(text.counts_table(v.spark, path), fragments)


def _bad_bed(v: Views) -> str:
    start = F.when(F.col("id") % 10 == 0, "x").otherwise(F.col("start").cast("string"))
    return lines(v, v.iv_a(), "chr", start, F.when(F.col("id") % 11 == 0, F.col("start") - 5).otherwise(F.col("end")), "id", F.lit(0), "strand")


@query("iv_a", """SELECT chr, start, "end", strand, CAST(id AS VARCHAR) AS id FROM iv_a WHERE id % 10 <> 0 AND id % 11 <> 0""")
def scan_intervals_tolerant(v: Views) -> DataFrame:
    got = text.intervals(v.spark, _bad_bed(v), tolerant=True)
    return got.select("chr", "start", "end", "strand", F.col("fields")[3].alias("id"))


@query("iv_a", "SELECT count(*) FILTER (id % 10 = 0 OR id % 11 = 0) AS skipped, count(*) AS lines FROM iv_a")
def scan_bad_lines(v: Views) -> DataFrame:
    return text.bad_lines(v.spark, _bad_bed(v))


@query("", "SELECT o_orderkey AS key, o_orderstatus AS status, o_totalprice AS price FROM orders")
def scan_table(v: Views) -> DataFrame:
    path = lines(v, v.table("orders"), "o_orderkey", "o_orderstatus", "o_totalprice", sep=";")
    return text.tsv(v.spark, path, "key long, status string, price double", sep=";")


@query("track", """SELECT chr, pos AS start, pos + 5 AS "end", round(val, 3) AS val, count(*) AS n FROM track WHERE id % 2 = 0 GROUP BY ALL UNION ALL SELECT chr, pos, pos + 7, round(val, 3), count(*) FROM track WHERE id % 2 = 1 GROUP BY ALL""")
def scan_wiggle(v: Views) -> DataFrame:
    t = v.track().withColumn("val", F.round("val", 3))
    step = F.concat(F.lit("variableStep chrom="), "chr", F.lit(" span=5\n"), F.col("pos") + 1, F.lit(" "), "val")
    span = F.concat_ws(" ", "chr", "pos", F.col("pos") + 7, "val")
    path = lines(v, t, F.when(F.col("id") % 2 == 0, step).otherwise(span))
    got = text.wiggle(v.spark, path).select("chr", "start", "end", F.col("val").cast("double").alias("val"))
    return got.groupBy("chr", "start", "end", "val").agg(F.count("*").alias("n"))


@query("", "SELECT DISTINCT o_orderpriority AS chr, CAST(30000000 AS BIGINT) AS length FROM orders")
def scan_lengths(v: Views) -> DataFrame:
    got = text.chromosome_lengths(v.spark, lines(v, v.lengths(), F.regexp_replace("chr", " ", "_"), "length", sep=" "))
    return got.withColumn("chr", F.regexp_replace("chr", "_", " "))


_GENE = "SELECT {kind} AS kind, CAST(id AS VARCHAR) AS gene, chr, {a} AS start, {b} AS \"end\" FROM elements WHERE {b} > {a}"
_GENES = " UNION ALL ".join(
    _GENE.format(kind=f"'{kind}'", a=a, b=b)
    for kind, a, b in (
        ("exon", "mid", "mid + 40"), ("exon", "mid + 60", "mid + 60 + len"), ("intron", "mid + 40", "mid + 60"),
        ("cds", "greatest(mid, mid + 20)", "least(mid + 40, mid + 90)"), ("cds", "greatest(mid + 60, mid + 20)", "least(mid + 60 + len, mid + 90)"),
    )
)


@query("elements", _GENES)
def scan_genes(v: Views) -> DataFrame:
    m = F.col("mid")
    last = m + 60 + F.col("len")
    path = lines(v, v.elements(), "id", "chr", F.lit("+"), m, last, m + 20, m + 90, F.lit(2), F.concat(m, F.lit(","), m + 60, F.lit(",")), F.concat(m + 40, F.lit(","), last, F.lit(",")))
    out = None
    for kind in ("exon", "intron", "cds"):
        got = text.gene_features(v.spark, path, kind).select(F.lit(kind).alias("kind"), "gene", "chr", "start", "end")
        out = got if out is None else out.unionByName(got)
    return out


@query("iv_a", """SELECT chr, start, "end", strand, 'exon' AS feature, 'g' || id AS gene FROM iv_a WHERE id % 3 = 0""")
def scan_gff(v: Views) -> DataFrame:
    kind = F.when(F.col("id") % 3 == 0, "exon").otherwise("gene")
    about = F.when(F.col("id") % 2 == 0, F.concat(F.lit('gene_id "g'), "id", F.lit('"; x "y"'))).otherwise(F.concat(F.lit("ID=g"), "id"))
    return text.gff(v.spark, lines(v, v.iv_a(), "chr", F.lit("s"), kind, F.col("start") + 1, "end", F.lit("."), "strand", F.lit("."), about), "exon")


def _sequences(v: Views) -> DataFrame:
    letters = F.regexp_replace(F.lower("text"), "[^acgt]", "")
    return v.table("documents").select(F.concat(F.lit("s"), "doc_id").alias("name"), letters.alias("sequence")).where("length(sequence) >= 4")


def _fasta(v: Views) -> DataFrame:
    path = shared_path(v.spark, "fasta")
    sinks.fasta(_sequences(v), path, 50)
    return text.fasta(v.spark, path)


_SEQUENCES = "(SELECT 's' || doc_id AS name, s AS sequence FROM (SELECT doc_id, regexp_replace(lower(text), '[^acgt]', '', 'g') AS s FROM documents) WHERE length(s) >= 4)"


@query("", f"SELECT * FROM {_SEQUENCES}")
def scan_fasta(v: Views) -> DataFrame:
    return _fasta(v)


@query("", f"SELECT name AS chr, CAST(0 AS BIGINT) AS start, CAST(length(sequence) AS BIGINT) AS \"end\" FROM {_SEQUENCES}")
def fasta_to_bed(v: Views) -> DataFrame:
    return text.fasta_to_bed(_fasta(v))


@query("", f"SELECT 'doc' || substr(name, 2) AS name, sequence FROM {_SEQUENCES} WHERE CAST(substr(name, 2) AS BIGINT) IN (SELECT doc_id FROM labels)")
def fasta_renamed(v: Views) -> DataFrame:
    names = v.table("labels").select(F.concat(F.lit("s"), "doc_id").alias("old"), F.concat(F.lit("doc"), "doc_id").alias("new")).distinct()
    return text.renamed_sequences(_fasta(v), names)


@query("", f"""SELECT name AS id, CASE WHEN length(sequence) % 2 = 0 THEN reverse(translate(substr(sequence, 2, 3), 'acgt', 'tgca')) ELSE substr(sequence, 2, 3) END AS sequence FROM {_SEQUENCES}""")
def extract_sequences(v: Views) -> DataFrame:
    s = _sequences(v)
    wanted = s.select(F.col("name").alias("chr"), F.lit(1).cast("long").alias("start"), F.lit(4).cast("long").alias("end"), F.col("name").alias("id"), F.when(F.length("sequence") % 2 == 0, "-").otherwise("+").alias("strand"))
    return Al.extract(s, wanted)


def _pairs_of_texts(v: Views) -> DataFrame:
    """Two rows of letters of each sequence: as it is without its third letter, and with other letters for c."""
    s = _sequences(v)
    a = F.concat(F.substring("sequence", 1, 2), F.lit("-"), F.expr("substr(sequence, 4)"))
    return s.select("name", a.alias("a"), F.translate("sequence", "c", "g").alias("b"))


_PAIRS = f"(SELECT name, substr(sequence, 1, 2) || '-' || substr(sequence, 4) AS a, replace(sequence, 'c', 'g') AS b FROM {_SEQUENCES})"


def _maf(v: Views) -> DataFrame:
    row = lambda src, x: F.concat(F.lit(f"s {src}."), "name", F.lit(" 5 "), F.length(F.regexp_replace(x, "-", "")), F.lit(" + 999999999 "), F.col(x))
    p = _pairs_of_texts(v)
    return text.maf(v.spark, lines(v, p, F.concat(F.lit("a score="), F.length("b"), F.lit("\n"), row("one", "a"), F.lit("\n"), row("two", "b"), F.lit("\n"))))


@query("", f"""SELECT 'one.' || name AS src1, CAST(5 AS BIGINT) AS start1, CAST(length(replace(a, '-', '')) AS BIGINT) AS size1, a AS text1, 'two.' || name AS src2, b AS text2, CAST(length(b) AS DOUBLE) AS score FROM {_PAIRS}""")
def scan_maf(v: Views) -> DataFrame:
    c = F.col("components")
    return _maf(v).select(c[0]["src"].alias("src1"), c[0]["start"].alias("start1"), c[0]["size"].alias("size1"), c[0]["text"].alias("text1"), c[1]["src"].alias("src2"), c[1]["text"].alias("text2"), "score")


@query("", f"""SELECT name, count(*) AS columns, count(*) FILTER (x <> '-') AS ungapped, count(*) FILTER (x = y) AS identical, count(*) FILTER (x = '-') AS gaps
    FROM (SELECT name, substr(a, i, 1) AS x, substr(b, i, 1) AS y FROM (SELECT *, unnest(generate_series(1, length(a))) AS i FROM {_PAIRS})) GROUP BY name""")
def alignment_statistics(v: Views) -> DataFrame:
    p = _pairs_of_texts(v).select(F.col("name").alias("id"), F.array("a", "b").alias("texts"))
    got = S.column_statistics(p)
    return got.select(F.col("id").alias("name"), "columns", "ungapped", "identical", "gaps")


@query("", f"SELECT 'one.' || name AS src FROM {_PAIRS} WHERE length(a) >= 100")
def alignment_filter(v: Views) -> DataFrame:
    return S.filter_blocks(_maf(v), 2, 100, ["one", "two"]).select(F.col("components")[0]["src"].alias("src"))


@query("", f"""SELECT 'one.' || name AS src, substr(a, 2, 4) AS text1, CAST(6 AS BIGINT) AS start1, CAST(length(replace(substr(a, 2, 4), '-', '')) AS BIGINT) AS size1, substr(b, 2, 4) AS text2 FROM {_PAIRS}""")
def alignment_slice(v: Views) -> DataFrame:
    c = F.col("components")
    return Al.slice_columns(_maf(v), 1, 5).select(c[0]["src"].alias("src"), c[0]["text"].alias("text1"), c[0]["start"].alias("start1"), c[0]["size"].alias("size1"), c[1]["text"].alias("text2"))


@query("", f"""SELECT name, round(sum(CASE WHEN x = '-' THEN -4.5 WHEN x = y THEN 1.0 ELSE -1.0 END), 4)::DOUBLE AS score FROM (SELECT name, substr(a, i, 1) AS x, substr(b, i, 1) AS y FROM (SELECT *, unnest(generate_series(1, length(a))) AS i FROM {_PAIRS})) GROUP BY name""")
def alignment_score(v: Views) -> DataFrame:
    return _pairs_of_texts(v).select("name", F.round(Al.pair_score(F.col("a"), F.col("b")), 4).alias("score"))


@query("iv_a", """SELECT id AS number, chr, start, "end", start * 2 AS start2, strand AS strand2, CAST(id % 50 AS DOUBLE) AS score, 'AC-GT' AS text, 'ACGGT' AS text2 FROM iv_a""")
def scan_axt(v: Views) -> DataFrame:
    head = F.concat_ws(" ", "id", F.regexp_replace("chr", " ", "_"), F.col("start") + 1, "end", F.lit("q"), F.col("start") * 2 + 1, F.col("end") * 2, "strand", F.col("id") % 50)
    got = text.axt(v.spark, lines(v, v.iv_a(), F.concat(head, F.lit("\nAC-GT\nACGGT\n"))))
    return got.select("number", F.regexp_replace("chr", "_", " ").alias("chr"), "start", "end", "start2", "strand2", "score", "text", "text2")


@query("", """SELECT p_brand AS motif, x AS letter, CAST(i - 1 AS INTEGER) AS "at", CAST(count(*) FILTER (substr(lower(p_name), i, 1) = x) AS DOUBLE) AS n FROM (SELECT *, unnest([1, 2, 3]) AS i FROM part), (SELECT unnest(['a', 'e', 'i', 'o']) AS x) GROUP BY 1, 2, i""")
def scan_motif_counts(v: Views) -> DataFrame:
    each = v.table("part").select("p_brand", F.lower("p_name").alias("name"), F.explode(F.array(*map(F.lit, "aeio"))).alias("letter"))
    found = each.groupBy("p_brand", "letter").agg(*[F.count_if(F.substring("name", k, 1) == F.col("letter")).alias(f"n{k}") for k in (1, 2, 3)])
    return text.motif_counts(v.spark, lines(v, found, F.regexp_replace("p_brand", " ", "_"), "letter", "n1", "n2", "n3", sep=" ")).withColumn("motif", F.regexp_replace("motif", "_", " "))


@query("", "SELECT 'hoxd_' || n_nationkey AS name, n_name || ' x' AS value FROM nation WHERE n_nationkey % 2 = 0")
def scan_settings(v: Views) -> DataFrame:
    key = F.concat(F.when(F.col("n_nationkey") % 2 == 0, "hoxd_").otherwise("other_"), "n_nationkey")
    return text.score_settings(v.spark, lines(v, v.table("nation"), key, "n_name", F.lit("x"), sep=" "), ["hoxd"])


@query("cis", "SELECT * FROM cis")
def save_heatmap(v: Views) -> DataFrame:
    path = shared_path(v.spark, "heatmap")
    sinks.heatmap(M.binned_cis(v.located()), path)
    return v.spark.read.parquet(path).select("chr", "bin1", "bin2", "obs")


@query("creads", "SELECT * FROM creads WHERE c1 = 'A'")
def save_by_key(v: Views) -> DataFrame:
    path = shared_path(v.spark, "store")
    sinks.save(C.canonical(v.reads()), path, ["c1"])
    return v.spark.read.parquet(path).where("c1 = 'A'").select("c1", "p1", "s1", "c2", "p2", "s2")


@query("cis", """SELECT chr AS chr1, bin1 * 100000 AS start1, (bin1 + 1) * 100000 AS stop1, chr AS chr2, bin2 * 100000 AS start2, (bin2 + 1) * 100000 AS stop2, round(log2(obs / 2.0), 6) AS score FROM cis""")
def interval_export(v: Views) -> DataFrame:
    cells = M.binned_cis(v.located()).withColumn("expected", F.lit(2.0))
    for k in ("1", "2"):
        cells = cells.withColumns({f"chr{k}": F.col("chr"), f"start{k}": F.col(f"bin{k}") * 100000, f"stop{k}": (F.col(f"bin{k}") + 1) * 100000})
    path = shared_path(v.spark, "intervals")
    sinks.scored_intervals(cells, path)
    got = text.tsv(v.spark, path, "chr1 string, start1 long, stop1 long, chr2 string, start2 long, stop2 long, score double")
    return got.withColumn("score", F.round("score", 6))


@query("iv_a", 'SELECT chr, start, "end" FROM iv_a')
def save_bed(v: Views) -> DataFrame:
    path = shared_path(v.spark, "bed")
    sinks.bed(v.iv_a(), path)
    return text.intervals(v.spark, path).select("chr", "start", "end")


@query("", """SELECT 'x_' || f AS field, count(*) AS n FROM (SELECT unnest([CAST(o_orderkey AS VARCHAR), o_orderstatus, o_orderpriority]) AS f FROM orders) GROUP BY 1""")
def fields_to_lines(v: Views) -> DataFrame:
    path = lines(v, v.table("orders"), "o_orderkey", "o_orderstatus", "o_orderpriority")
    return T.fields_to_lines(v.spark.read.text(path), prefix="x_").groupBy("field").agg(F.count("*").alias("n"))
