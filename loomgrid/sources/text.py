"""Readers of the text formats: every one a Spark source with a schema, none on the driver.

Lines keep their order only where a format needs it (wiggle); there a line's place is (file, offset)
as Spark's reader gives it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def tsv(spark: SparkSession, path: str, schema: str, header: bool = False, sep: str = "\t") -> DataFrame:
    return spark.read.csv(path, schema=schema, header=header, sep=sep, comment="#", mode="PERMISSIVE")


def intervals(spark: SparkSession, path: str, chrom: int = 0, start: int = 1, end: int = 2, strand: int | None = 5, default_strand: str = "+", tolerant: bool = False) -> DataFrame:
    """(chr, start, end, strand, fields) from tab-separated lines; columns by position.

    ``tolerant`` leaves out lines whose coordinates are no numbers or are reversed; otherwise they
    come out with null coordinates.
    """
    f = F.split("value", "\t")
    lines = spark.read.text(path).where("length(trim(value)) > 0").where(~F.col("value").rlike(r"^(#|track\s|browser\s)"))
    s = F.coalesce(F.get(f, F.lit(strand)), F.lit(default_strand)) if strand is not None else F.lit(default_strand)
    number = lambda k: F.expr(f"try_cast(get(split(value, '\t'), {k}) as bigint)")
    out = lines.select(F.get(f, F.lit(chrom)).alias("chr"), number(start).alias("start"), number(end).alias("end"), F.when(s.isin("+", "-"), s).otherwise(default_strand).alias("strand"), f.alias("fields"))
    return out.where("start <= end") if tolerant else out


def bad_lines(spark: SparkSession, path: str, start: int = 1, end: int = 2) -> DataFrame:
    """One row: how many interval lines a tolerant read leaves out."""
    rows = intervals(spark, path, start=start, end=end)
    return rows.agg(F.count_if(F.col("start").isNull() | F.col("end").isNull() | (F.col("start") > F.col("end"))).alias("skipped"), F.count("*").alias("lines"))


def half_fragments_from_bed(spark: SparkSession, path: str) -> DataFrame:
    """(id, chr, start, stop, mid) of half-fragments from a BED file of cut sites (rows narrower than 10 on average) or fragments."""
    from ..operators.locate import cut_sites_to_halves

    rows = intervals(spark, path, tolerant=True)
    if (rows.agg(F.avg(F.col("end") - F.col("start"))).first()[0] or 0) < 10:
        halves = cut_sites_to_halves(rows.select("chr", F.floor((F.col("start") + F.col("end")) / 2).alias("cut")))
    else:
        middle = F.floor((F.col("start") + F.col("end")) / 2)
        pair = F.array(F.struct(F.col("start").alias("start"), middle.alias("stop")), F.struct(middle.alias("start"), F.col("end").alias("stop")))
        halves = rows.select("chr", F.explode(pair).alias("h")).select("chr", "h.start", "h.stop", F.floor((F.col("h.start") + F.col("h.stop")) / 2).alias("mid"))
    # Numbered chromosome by chromosome: a count for each, then places within it.
    sizes = halves.groupBy("chr").agg(F.count("*").alias("k"))
    first = sizes.withColumn("first", F.coalesce(F.sum("k").over(Window.orderBy("chr").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    place = F.row_number().over(Window.partitionBy("chr").orderBy("start", "stop")) - 1
    return halves.withColumn("_p", place).join(F.broadcast(first), "chr").select((F.col("first") + F.col("_p")).alias("id"), "chr", "start", "stop", "mid")


def primers_from_bed(spark: SparkSession, path: str, spacing: int = 1_000_000) -> DataFrame:
    """(id, chr, start, stop, mid, name, strand, region) of primer fragments from a BED file; a region ends where mids are ``spacing`` or more apart.

    Lines with another strand than + or -, or without numbers, are left out. Fragments are numbered by chromosome and place.
    """
    from ..operators.locate import regions

    rows = tsv(spark, path, "chr string, start string, stop string, name string, score string, strand string")
    known = rows.select("chr", F.expr("try_cast(start as bigint)").alias("start"), F.expr("try_cast(stop as bigint)").alias("stop"), "name", "strand").where("start is not null and stop is not null and strand in ('+', '-')")
    sizes = known.groupBy("chr").agg(F.count("*").alias("k"))
    # One row a chromosome.
    first = sizes.withColumn("first", F.coalesce(F.sum("k").over(Window.orderBy("chr").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    place = F.row_number().over(Window.partitionBy("chr").orderBy("start", "stop", "name")) - 1
    placed = known.withColumn("_p", place).join(first, "chr").select((F.col("first") + F.col("_p")).alias("id"), "chr", "start", "stop", F.floor((F.col("start") + F.col("stop")) / 2).alias("mid"), "name", "strand")
    return regions(placed, spacing)


def fend_table(spark: SparkSession, path: str) -> DataFrame:
    """(id, chr, start, stop, mid, features...) from a headed table fend, frag, chr, coord, valid, frag_len, features."""
    rows = spark.read.csv(path, header=True, sep="\t")
    features = [c for c in rows.columns if c not in ("fend", "frag", "chr", "coord", "valid", "frag_len")]
    number = rows.select(
        (F.col("fend").cast("long") - 1).alias("id"), "chr", F.col("coord").cast("long").alias("coord"), F.col("frag_len").cast("long").alias("len"), *[F.col(c).cast("double").alias(c) for c in features]
    )
    even, half = F.col("id") % 2 == 0, F.floor(F.col("len") / 2)
    start = F.when(even, F.col("coord")).otherwise(F.col("coord") + 1 - F.col("len") + half)
    stop = F.when(even, F.col("coord") + half).otherwise(F.col("coord") + 1)
    return number.select("id", "chr", start.alias("start"), stop.alias("stop"), F.floor((start + stop) / 2).alias("mid"), *features)


def raw_pairs(spark: SparkSession, path: str) -> DataFrame:
    """Reads (c1, p1, s1, c2, p2, s2) from chr1, pos1, strand1, chr2, pos2, strand2; strands are 1 for '+', 0 for '-'."""
    rows = tsv(spark, path, "c1 string, p1 long, s1 string, c2 string, p2 long, s2 string")
    return rows.withColumns({s: F.when(F.col(s) == "+", 1).otherwise(0) for s in ("s1", "s2")})


def counts_table(spark: SparkSession, path: str) -> DataFrame:
    """(name1, name2, n)."""
    return tsv(spark, path, "name1 string, name2 string, n long")


def mat_triples(spark: SparkSession, path: str) -> DataFrame:
    """Contacts (id1, id2, n) from 1-based triples; a header and other lines without numbers are left out."""
    rows = tsv(spark, path, "a string, b string, c string").select(*[F.expr(f"try_cast({x} as bigint)").alias(x) for x in "abc"]).where("a is not null and b is not null and c is not null")
    return rows.select((F.least("a", "b") - 1).alias("id1"), (F.greatest("a", "b") - 1).alias("id2"), F.col("c").alias("n"))


def sam(spark: SparkSession, path: str, unique_only: bool = False) -> DataFrame:
    """(name, flag, chr, pos, length, strand) of mapped alignments in SAM text; ``unique_only`` drops those tagged XS."""
    f = F.split("value", "\t")
    lines = spark.read.text(path).where(~F.startswith("value", F.lit("@")) & (F.size(f) >= 11))
    if unique_only:
        lines = lines.where(~F.col("value").contains("\tXS:"))
    flag = F.get(f, F.lit(1)).cast("int")
    out = lines.select(F.get(f, F.lit(0)).alias("name"), flag.alias("flag"), F.get(f, F.lit(2)).alias("chr"), F.get(f, F.lit(3)).cast("long").alias("pos"), F.length(F.get(f, F.lit(9))).alias("length"), F.when(flag.bitwiseAND(16) == 0, 1).otherwise(0).alias("strand"))
    return out.where(F.col("flag").bitwiseAND(4) == 0)


def paired_sam(first: DataFrame, second: DataFrame) -> DataFrame:
    """Reads from the alignments of both ends, joined by read name; the reverse strand's place is its far end."""
    place = F.when(F.col("strand") == 1, F.col("pos")).otherwise(F.col("pos") + F.col("length"))
    ends = [x.groupBy("name").agg(F.max_by(F.struct("chr", place.alias("pos"), "strand"), F.struct("chr", "pos")).alias(f"e{k}")) for k, x in ((1, first), (2, second))]
    return ends[0].join(ends[1], "name").select(
        F.col("e1.chr").alias("c1"), F.col("e1.pos").alias("p1"), F.col("e1.strand").alias("s1"), F.col("e2.chr").alias("c2"), F.col("e2.pos").alias("p2"), F.col("e2.strand").alias("s2")
    )


def chromosome_lengths(spark: SparkSession, path: str) -> DataFrame:
    f = F.split(F.trim("value"), r"\s+")
    return spark.read.text(path).where("length(trim(value)) > 0").select(F.get(f, F.lit(0)).alias("chr"), F.get(f, F.lit(1)).cast("long").alias("length"))


def _setting(name: str) -> Column:
    return F.nullif(F.regexp_extract("value", rf"\b{name}=(\S+)", 1), F.lit(""))


def wiggle(spark: SparkSession, path: str) -> DataFrame:
    """(chr, start, end, val) from wiggle text: bed, variableStep and fixedStep lines, each file read as one text.

    A file's declarations hold for the lines below them; they are carried along by a window over the
    file's lines.
    """
    whole = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.posexplode(F.split("value", "\n")).alias("at", "value"))
    lines = whole.where("length(trim(value)) > 0").where(~F.col("value").rlike("^(#|track|browser)"))
    declared = F.col("value").rlike("^(variable|fixed)Step")
    head = F.when(declared, F.struct(F.substring("value", 1, 1).alias("kind"), _setting("chrom").alias("chrom"), _setting("start").cast("long").alias("start"), F.coalesce(_setting("step"), F.lit("1")).cast("long").alias("step"), F.coalesce(_setting("span"), F.lit("1")).cast("long").alias("span"), F.col("at").alias("at")))
    w = Window.partitionBy("file").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    held = lines.withColumn("h", F.last(head, ignorenulls=True).over(w)).where(~declared).withColumn("f", F.split(F.trim("value"), r"\s+"))
    place = F.row_number().over(Window.partitionBy("file", "h.at").orderBy("at")) - 1
    n = F.size("f")
    number = lambda k: F.get("f", F.lit(k)).cast("long")
    start = F.when(n >= 4, number(1)).when(n == 2, number(0) - 1).otherwise(F.col("h.start") - 1 + place * F.col("h.step"))
    out = held.select(F.when(n >= 4, F.get("f", F.lit(0))).otherwise(F.col("h.chrom")).alias("chr"), start.alias("start"), F.when(n >= 4, number(2)).otherwise(start + F.col("h.span")).alias("end"), F.element_at("f", -1).cast("double").alias("val"))
    return out


def gene_features(spark: SparkSession, path: str, feature: str = "exon") -> DataFrame:
    """(chr, start, end, strand, gene) of exons, CDS or introns from a gene prediction table (name, chrom, strand, txStart, txEnd, cdsStart, cdsEnd, exonCount, exonStarts, exonEnds)."""
    t = tsv(spark, path, "name string, chrom string, strand string, tx_start long, tx_end long, cds_start long, cds_end long, n int, starts string, ends string")
    numbers = lambda c: F.transform(F.filter(F.split(c, ","), lambda x: x != ""), lambda x: x.cast("long"))
    genes = t.select("name", "chrom", "strand", "cds_start", "cds_end", numbers("starts").alias("s"), numbers("ends").alias("e"))
    if feature == "intron":
        pairs = F.arrays_zip(F.expr("slice(e, 1, size(e) - 1)").alias("start"), F.expr("slice(s, 2, size(s))").alias("end"))
    else:
        pairs = F.arrays_zip(F.col("s").alias("start"), F.col("e").alias("end"))
    rows = genes.select("chrom", "strand", "name", "cds_start", "cds_end", F.explode(pairs).alias("x"))
    start, end = F.col("x.start"), F.col("x.end")
    if feature == "cds":
        start, end = F.greatest(start, "cds_start"), F.least(end, "cds_end")
    return rows.select(F.col("chrom").alias("chr"), start.alias("start"), end.alias("end"), "strand", F.col("name").alias("gene")).where("end > start")


def fasta(spark: SparkSession, path: str) -> DataFrame:
    """(name, sequence) of FASTA records; a record is one row."""
    records = spark.read.text(path, lineSep=">").where("length(trim(value)) > 0")
    name = F.trim(F.substring_index(F.substring_index("value", "\n", 1), " ", 1))
    return records.select(name.alias("name"), F.regexp_replace(F.regexp_replace("value", r"^[^\n]*\n?", ""), r"\s", "").alias("sequence"))


def maf(spark: SparkSession, path: str) -> DataFrame:
    """(id, score, components) of multiple alignment blocks: lines 'a score=', then 's src start size strand srcSize text'."""
    blocks = spark.read.text(path, lineSep="\n\n").where(F.col("value").rlike(r"(?m)^s\s"))
    rows = F.filter(F.split("value", "\n"), lambda x: x.rlike(r"^s\s"))
    part = lambda x: F.split(x, r"\s+")
    component = F.transform(rows, lambda x: F.struct(
        F.get(part(x), F.lit(1)).alias("src"), F.get(part(x), F.lit(2)).cast("long").alias("start"), F.get(part(x), F.lit(3)).cast("long").alias("size"),
        F.get(part(x), F.lit(4)).alias("strand"), F.get(part(x), F.lit(5)).cast("long").alias("src_size"), F.get(part(x), F.lit(6)).alias("text"),
    ))
    score = F.nullif(F.regexp_extract("value", r"(?m)^a.*score=(\S+)", 1), F.lit("")).cast("double")
    return blocks.select(F.xxhash64("value").alias("id"), score.alias("score"), component.alias("components"))


def score_settings(spark: SparkSession, path: str, names: list[str]) -> DataFrame:
    """(name, value) of the lines whose key contains one of the names: 'key value...'."""
    key = F.substring_index(F.trim("value"), " ", 1)
    keep = F.lit(False)
    for n in names:
        keep = keep | key.contains(n)
    return spark.read.text(path).where(keep).select(key.alias("name"), F.trim(F.regexp_replace(F.trim("value"), r"^\S+\s*", "")).alias("value"))


def gff(spark: SparkSession, path: str, feature: str | None = None) -> DataFrame:
    """(chr, start, end, strand, feature, gene) from GFF or GTF lines, start counted from 0; ``gene`` is the attribute gene_id, gene or ID."""
    t = tsv(spark, path, "chr string, source string, feature string, start long, end long, score string, strand string, frame string, attributes string")
    name = F.regexp_extract("attributes", r'(?:gene_id|gene|ID)[ =]"?([^";]+)', 1)
    out = t.select("chr", (F.col("start") - 1).alias("start"), "end", "strand", "feature", name.alias("gene")).where("start IS NOT NULL AND end IS NOT NULL")
    return out.where(F.col("feature") == feature) if feature else out


def axt(spark: SparkSession, path: str) -> DataFrame:
    """(number, chr, start, end, chr2, start2, end2, strand2, score, text, text2) of pairwise blocks: a line of fields and two of letters; starts counted from 0."""
    blocks = spark.read.text(path, lineSep="\n\n").select(F.split(F.trim("value"), "\n").alias("l")).where(F.size("l") >= 3)
    f = F.split(F.col("l")[0], r"\s+")
    number = lambda k: F.get(f, F.lit(k)).cast("long")
    return blocks.select(
        number(0).alias("number"), F.get(f, F.lit(1)).alias("chr"), (number(2) - 1).alias("start"), number(3).alias("end"), F.get(f, F.lit(4)).alias("chr2"), (number(5) - 1).alias("start2"),
        number(6).alias("end2"), F.get(f, F.lit(7)).alias("strand2"), F.get(f, F.lit(8)).cast("double").alias("score"), F.col("l")[1].alias("text"), F.col("l")[2].alias("text2"),
    )


def motif_counts(spark: SparkSession, path: str) -> DataFrame:
    """(motif, letter, at, n) from lines "motif letter n n n ...", one count for each position."""
    f = F.split(F.trim("value"), r"\s+")
    lines = spark.read.text(path).where(~F.startswith("value", F.lit("#")) & (F.size(f) > 2))
    return lines.select(F.get(f, F.lit(0)).alias("motif"), F.get(f, F.lit(1)).alias("letter"), F.posexplode(F.slice(f, F.lit(3), F.size(f) - 2)).alias("at", "n")).withColumn("n", F.col("n").cast("double"))


def fasta_to_bed(sequences: DataFrame) -> DataFrame:
    """(chr, start, end) that cover whole sequences (name, sequence)."""
    return sequences.select(F.col("name").alias("chr"), F.lit(0).cast("long").alias("start"), F.length("sequence").cast("long").alias("end"))


def sam_to_bed(alignments: DataFrame) -> DataFrame:
    """(chr, start, end, name, strand) of alignments as ``sam`` reads them; starts counted from 0."""
    strand = F.when(F.col("strand") == 1, "+").otherwise("-")
    return alignments.select("chr", (F.col("pos") - 1).alias("start"), (F.col("pos") - 1 + F.col("length")).alias("end"), "name", strand.alias("strand"))


def renamed_sequences(sequences: DataFrame, names: DataFrame) -> DataFrame:
    """Sequences under new names (old, new); those without one drop out."""
    return sequences.join(names.select(F.col("old").alias("name"), "new"), "name").select(F.col("new").alias("name"), "sequence")
