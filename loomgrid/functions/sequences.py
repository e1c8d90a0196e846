"""Functions on sequences, alignments and motifs."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def reverse_complement(s: Column) -> Column:
    return F.reverse(F.translate(s, "ACGTacgt", "TGCAtgca"))


def gc_fraction(s: Column) -> Column:
    """Share of G and C among the letters of a sequence, 0 for an empty one."""
    n = F.length(s)
    return F.when(n > 0, (n - F.length(F.translate(s, "GCgc", ""))) / n).otherwise(0.0)


def letters(s: Column) -> Column:
    """The characters of a string in order, as an array."""
    return F.when(F.length(s) > 0, F.split(s, "(?!^)(?!$)", -1)).otherwise(F.array().cast("array<string>"))


def ngrams(s: Column, n: int) -> Column:
    """All substrings of length n, in order."""
    return F.when(F.length(s) >= n, F.transform(F.sequence(F.lit(1), F.length(s) - (n - 1)), lambda i: F.substring(s, i, F.lit(n)))).otherwise(F.array().cast("array<string>"))


def ngram_counts(rows: DataFrame, text: str, n: int, alphabet: str) -> DataFrame:
    """(gram, n): how often each word of length n over the alphabet occurs; other characters are left out first."""
    kept = F.regexp_replace(F.lower(F.col(text)), f"[^{alphabet}]", "")
    return rows.select(F.explode(ngrams(kept, n)).alias("gram")).groupBy("gram").agg(F.count("*").alias("n"))


def source_parts(name: Column) -> Column:
    """Struct (species, chrom, contig) of a dotted source name; missing parts are null."""
    parts = F.split(name, r"\.")
    return F.struct(F.get(parts, F.lit(0)).alias("species"), F.get(parts, F.lit(1)).alias("chrom"), F.get(parts, F.lit(2)).alias("contig"))


def motif_weights(counts: list[dict[str, float]], background: dict[str, float], pseudo: float = 1.0) -> list[dict[str, float]]:
    """Log2 odds of each letter at each position against a background."""
    out = []
    for column in counts:
        total = sum(column.values()) + pseudo * len(background)
        out.append({k: math.log2((column.get(k, 0.0) + pseudo) / total / p) for k, p in background.items()})
    return out


def motif_scores(rows: DataFrame, key: str, text: str, weights: list[dict[str, float]]) -> DataFrame:
    """(key, at, score): a motif's score at each place of each sequence where all letters are known."""
    size = len(weights)
    grams = rows.select(key, F.posexplode(ngrams(F.upper(F.col(text)), size)).alias("at", "gram"))
    score = F.lit(0.0)
    for k, column in enumerate(weights):
        letter = F.substring("gram", k + 1, 1)
        value = F.lit(None).cast("double")
        for name, w in column.items():
            value = F.when(letter == name, F.lit(w)).otherwise(value)
        score = score + value
    return grams.select(key, "at", score.alias("score")).where("score is not null")


def column_statistics(blocks: DataFrame) -> DataFrame:
    """Per alignment block (id, texts: array of equally long gapped rows): columns, ungapped columns, identical columns, gaps."""
    column = F.posexplode(F.transform(F.sequence(F.lit(1), F.length(F.col("texts")[0])), lambda i: F.transform("texts", lambda t: F.upper(F.substring(t, i, F.lit(1))))))
    each = blocks.where("size(texts) > 0 and length(texts[0]) > 0").select("id", column.alias("at", "letters"))
    gaps = F.size(F.filter("letters", lambda c: c == "-"))
    same = F.size(F.array_distinct("letters")) == 1
    return each.groupBy("id").agg(
        F.count("*").alias("columns"), F.count_if(gaps == 0).alias("ungapped"), F.count_if((gaps == 0) & same).alias("identical"), F.sum(gaps).alias("gaps")
    )


def filter_blocks(blocks: DataFrame, min_rows: int = 0, min_columns: int = 0, species: list[str] | None = None) -> DataFrame:
    """Alignment blocks (components: array of struct<src, start, size, strand, src_size, text>) that are large enough and name all species."""
    keep = (F.size("components") >= min_rows) & (F.length(F.coalesce(F.col("components")[0]["text"], F.lit(""))) >= min_columns)
    if species:
        named = F.transform("components", lambda c: F.substring_index(c["src"], ".", 1))
        keep = keep & (F.size(F.array_except(F.array(*map(F.lit, species)), named)) == 0)
    return blocks.where(keep)


def slice_blocks(blocks: DataFrame, intervals: DataFrame) -> DataFrame:
    """Parts of alignment blocks whose first component overlaps intervals (chr, start, end, id): block id, interval id, texts cut to the columns."""
    from ..operators.intervals import overlap_join

    first = F.col("components")[0]
    spans = blocks.select(F.col("id"), F.element_at(F.split(first["src"], r"\."), -1).alias("chr"), first["start"].alias("start"), (first["start"] + first["size"]).alias("end"), "components")
    met = overlap_join(intervals.select("chr", "start", "end", "id"), spans)
    # Columns of the block by the first row's ungapped offset.
    text = F.col("components2")[0]["text"]
    places = F.filter(F.sequence(F.lit(1), F.length(text)), lambda i: F.substring(text, i, F.lit(1)) != "-")
    a = F.greatest("start", "start2") - F.col("start2")
    b = F.least("end", "end2") - F.col("start2")
    cut = met.withColumns({"_from": F.get(places, a.cast("int")), "_to": F.get(places, (b - 1).cast("int"))})
    return cut.select(F.col("id2").alias("block"), F.col("id").alias("interval"), F.transform("components2", lambda c: F.substring(c["text"], F.col("_from"), F.col("_to") - F.col("_from") + 1)).alias("texts"))
