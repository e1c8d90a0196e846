"""Alignment blocks: rows (id, score, components), components an array of struct<src, start, size, strand, src_size, text>."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from .sequences import letters, reverse_complement

# IUPAC codes and the bases that each stands for.
IUPAC = {
    "A": "A", "C": "C", "G": "G", "T": "T", "R": "AG", "Y": "CT", "S": "CG", "W": "AT", "K": "GT", "M": "AC",
    "B": "CGT", "D": "AGT", "H": "ACT", "V": "ACG", "N": "ACGT",
}


def consensus_pattern(consensus: str) -> str:
    """Regular expression of a consensus in IUPAC codes."""
    return "".join(f"[{IUPAC[c]}]" for c in consensus.upper())


def consensus_places(rows: DataFrame, key: str, text: str, consensus: str) -> DataFrame:
    """(key, at): places, overlapping ones too, where the consensus stands on the forward strand."""
    n = len(consensus)
    s = F.upper(F.col(text))
    places = F.filter(F.sequence(F.lit(1), F.length(s) - (n - 1)), lambda i: F.substring(s, i, F.lit(n)).rlike(f"^{consensus_pattern(consensus)}$"))
    return rows.where(F.length(text) >= n).select(key, F.explode(places).alias("at")).select(key, (F.col("at") - 1).alias("at"))


def column_of(text: Column, offset: Column) -> Column:
    """Column (from 0) of the offset-th letter of a gapped row; null past its end."""
    places = F.filter(F.transform(letters(text), lambda c, i: F.when(c != "-", i)), lambda i: i.isNotNull())
    return F.get(places, offset.cast("int"))


def offset_of(text: Column, column: Column) -> Column:
    """How many letters stand before a column of a gapped row."""
    return F.length(F.regexp_replace(F.substring(text, F.lit(1), column.cast("int")), "-", ""))


def restrict_species(blocks: DataFrame, species: list[str]) -> DataFrame:
    """Blocks with the components of the species only, without columns that are then all gaps."""
    kept = blocks.withColumn("components", F.filter("components", lambda c: F.substring_index(c["src"], ".", 1).isin(species))).where("size(components) > 0")
    return without_gap_columns(kept)


def without_gap_columns(blocks: DataFrame) -> DataFrame:
    """Blocks without the columns in which every row has a gap."""
    texts = F.transform("components", lambda c: letters(c["text"]))
    n = F.length(F.col("components")[0]["text"])
    used = F.filter(F.sequence(F.lit(0), n - 1), lambda i: F.exists(texts, lambda t: F.get(t, i) != "-"))
    thin = F.transform("components", lambda c: c.withField("text", F.array_join(F.transform(used, lambda i: F.substring(c["text"], i + 1, F.lit(1))), "")))
    return blocks.withColumn("components", F.when(n > 0, thin).otherwise(F.col("components")))


def reverse_blocks(blocks: DataFrame) -> DataFrame:
    """Blocks read on the other strand."""

    def flip(c: Column) -> Column:
        return (
            c.withField("start", c["src_size"] - c["start"] - c["size"])
            .withField("strand", F.when(c["strand"] == "+", "-").otherwise("+"))
            .withField("text", reverse_complement(c["text"]))
        )

    return blocks.withColumn("components", F.transform("components", flip))


def slice_columns(blocks: DataFrame, start: int, end: int) -> DataFrame:
    """Columns [start, end) of blocks, with the components' starts and sizes to match."""

    def cut(c: Column) -> Column:
        text = F.substring(c["text"], start + 1, end - start)
        return (
            c.withField("start", c["start"] + offset_of(c["text"], F.lit(start)))
            .withField("size", F.length(F.regexp_replace(text, "-", "")).cast("long"))
            .withField("text", text)
        )

    return blocks.withColumn("components", F.transform("components", cut))


def pair_score(a: Column, b: Column, match: float = 1.0, mismatch: float = -1.0, gap_open: float = 4.0, gap_extend: float = 0.5) -> Column:
    """Score of two rows of an alignment: columns by equality, gaps affine; columns with two gaps count nothing."""
    pairs = F.filter(F.arrays_zip(letters(F.upper(a)).alias("a"), letters(F.upper(b)).alias("b")), lambda p: (p["a"] != "-") | (p["b"] != "-"))
    start = F.struct(F.lit(0.0).alias("s"), F.lit(0).alias("gap"))

    def step(acc: Column, p: Column) -> Column:
        side = F.when(p["a"] == "-", 1).when(p["b"] == "-", 2).otherwise(0)
        gap = F.when(acc["gap"] == side, -gap_extend).otherwise(-(gap_open + gap_extend))
        score = F.when(side == 0, F.when(p["a"] == p["b"], match).otherwise(mismatch)).otherwise(gap)
        return F.struct((acc["s"] + score).alias("s"), side.alias("gap"))

    return F.aggregate(pairs, start, step, lambda acc: acc["s"])


def fuse_blocks(blocks: DataFrame) -> DataFrame:
    """Neighbouring blocks joined up where every component goes on where it stopped: same sources, strands and end = start."""
    first = F.col("components")[0]
    shape = F.concat_ws("|", F.transform("components", lambda c: F.concat(c["src"], c["strand"])))
    w = Window.partitionBy("_src", "_shape").orderBy("_start")
    starts = F.transform("components", lambda c: c["start"])
    ends = F.transform("components", lambda c: c["start"] + c["size"])
    marked = blocks.withColumns({"_src": first["src"], "_shape": shape, "_start": first["start"]})
    marked = marked.withColumn("_new", F.when(F.lag(ends).over(w) == starts, 0).otherwise(1))
    grouped = marked.withColumn("_g", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    rows = grouped.groupBy("_src", "_shape", "_g").agg(F.array_sort(F.collect_list(F.struct("_start", "components", "id", "score"))).alias("b"))
    joined = F.transform(
        F.col("b")[0]["components"],
        lambda c, i: c.withField("size", F.aggregate("b", F.lit(0).cast("long"), lambda a, x: a + x["components"][i]["size"])).withField("text", F.array_join(F.transform("b", lambda x: x["components"][i]["text"]), "")),
    )
    return rows.select(F.col("b")[0]["id"].alias("id"), F.aggregate("b", F.lit(0.0), lambda a, x: a + F.coalesce(x["score"], F.lit(0.0))).alias("score"), joined.alias("components"))


def extract(sequences: DataFrame, intervals: DataFrame) -> DataFrame:
    """(id, sequence) of intervals (chr, start, end, id, strand) from (name, sequence); '-' is read backwards."""
    met = intervals.join(sequences, intervals.chr == sequences.name)
    part = F.substring("sequence", F.col("start").cast("int") + 1, (F.col("end") - F.col("start")).cast("int"))
    return met.select("id", F.when(F.col("strand") == "-", reverse_complement(part)).otherwise(part).alias("sequence"))


def _first_of(species: str) -> Column:
    """A block's first component of a species, or null."""
    return F.get(F.filter("components", lambda c: F.startswith(c["src"], F.lit(species + "."))), F.lit(0))


def tile_blocks(blocks: DataFrame, intervals: DataFrame, species: list[str], sequences: DataFrame | None = None, tile: int = 100_000) -> DataFrame:
    """(id, texts): intervals (id, chr, start, end) of the reference, each covered from end to end by the best block at every position.

    ``blocks`` are (id, score, components); the reference is the component of the first of ``species`` whose source is "species.chr", on its forward strand. At a
    position the highest score wins, of equal ones the larger block id. ``texts`` has one row for each of ``species``; one that a block lacks is gaps.
    Where no block lies the reference shows ``sequences`` (name: chr, sequence), or N, and the others gaps. Columns that are gaps in all of ``species``
    are left out. Blocks and intervals meet in tiles of the reference, and a tile's stretches between block ends are
    settled there, so that deep or long places are many tasks' work.
    """
    ref = _first_of(species[0])
    based = blocks.select(F.col("id").alias("block"), F.coalesce("score", F.lit(0.0)).alias("score"), "components", ref.alias("ref")).where("ref is not null")
    spans = based.select("block", "score", F.substring_index("ref.src", ".", -1).alias("chr"), F.col("ref.start").alias("from"), (F.col("ref.start") + F.col("ref.size")).alias("to"))
    tiles = lambda low, high: F.explode(F.sequence(F.floor(F.col(low) / tile), F.floor((F.col(high) - 1) / tile))).alias("_tile")
    wanted = intervals.where("end > start").select(F.col("id").alias("interval"), "chr", "start", "end", tiles("start", "end"))
    wanted = wanted.withColumns({"low": F.greatest("start", F.col("_tile") * tile), "high": F.least("end", (F.col("_tile") + 1) * tile)})
    met = wanted.join(spans.where("to > from").select("block", "score", "chr", "from", "to", tiles("from", "to")), ["chr", "_tile"]).where(F.expr("`from` < high and to > low"))
    pieces = met.select("interval", "_tile", "block", "score", F.greatest("from", "low").alias("from"), F.least("to", "high").alias("to"))
    # The stretches between neighbouring ends of blocks in a tile of an interval.
    edges = wanted.select("interval", "_tile", F.explode(F.array("low", "high")).alias("at")).unionByName(pieces.select("interval", "_tile", F.explode(F.array("from", "to")).alias("at"))).distinct()
    w = Window.partitionBy("interval", "_tile").orderBy("at")
    stretches = edges.withColumn("stop", F.lead("at").over(w)).where("stop is not null")
    best = stretches.join(pieces, ["interval", "_tile"], "left").where(F.expr("block is null or (`from` <= at and to >= stop)"))
    won = best.groupBy("interval", "_tile", "at", "stop").agg(F.max(F.struct("score", "block")).alias("b")).select("interval", "_tile", "at", "stop", F.col("b.block").alias("block"))
    every = stretches.join(won, ["interval", "_tile", "at", "stop"], "left")
    # Neighbouring stretches of one block are one slice.
    v = Window.partitionBy("interval").orderBy("at")
    runs = every.withColumn("_new", F.when(F.col("block").eqNullSafe(F.lag("block").over(v)) & F.lag("at").over(v).isNotNull(), 0).otherwise(1)).withColumn("_run", F.sum("_new").over(v.rowsBetween(Window.unboundedPreceding, 0)))
    slices = runs.groupBy("interval", "_run").agg(F.min("at").alias("at"), F.max("stop").alias("stop"), F.first("block").alias("block"))
    cut = slices.join(based.select("block", "components", "ref"), "block", "left")
    letter_at = F.filter(F.sequence(F.lit(1), F.length("ref.text")), lambda i: F.substring(F.col("ref.text"), i, F.lit(1)) != "-")
    placed = cut.withColumn("_letters", F.when(F.col("block").isNotNull(), letter_at))
    # Column behind so many letters; gaps before a letter go with it.
    behind = lambda n: F.when(n <= 0, 0).otherwise(F.get("_letters", (n - 1).cast("int")))
    low, high = behind(F.col("at") - F.col("ref.start")), behind(F.col("stop") - F.col("ref.start"))
    placed = placed.withColumns({"_low": low, "_high": high})

    def text_of(name: str) -> Column:
        own = _first_of(name)["text"]
        return F.coalesce(F.substring(own, F.col("_low") + 1, F.col("_high") - F.col("_low")), F.repeat(F.lit("-"), F.col("_high") - F.col("_low")))

    placed = placed.withColumn("_texts", F.array(*[text_of(s) for s in species]))
    full = F.filter(F.sequence(F.lit(1), F.col("_high") - F.col("_low")), lambda i: F.exists("_texts", lambda t: F.substring(t, i, F.lit(1)) != "-"))
    dense = F.transform("_texts", lambda t: F.array_join(F.transform("_full", lambda i: F.substring(t, i, F.lit(1))), ""))
    covered = placed.where("block is not null").withColumn("_full", full).select("interval", "at", dense.alias("texts"))
    bare = placed.where("block is null").select("interval", "at", "stop")
    length = (F.col("stop") - F.col("at")).cast("int")
    if sequences is None:
        shown = bare.withColumn("_ref", F.repeat(F.lit("N"), length))
    else:
        shown = bare.join(intervals.select(F.col("id").alias("interval"), "chr"), "interval").join(sequences.select(F.col("name").alias("chr"), "sequence"), "chr", "left")
        shown = shown.withColumn("_ref", F.coalesce(F.substring(F.col("sequence"), F.col("at").cast("int") + 1, length), F.repeat(F.lit("N"), length)))
    uncovered = shown.select("interval", "at", F.array(F.col("_ref"), *[F.repeat(F.lit("-"), length) for _ in species[1:]]).alias("texts"))
    parts = covered.unionByName(uncovered).groupBy("interval").agg(F.array_sort(F.collect_list(F.struct("at", "texts"))).alias("p"))
    return parts.select(F.col("interval").alias("id"), F.array(*[F.array_join(F.transform("p", lambda x: x["texts"][k]), "") for k in range(len(species))]).alias("texts"))  # noqa: B023


def thread_blocks(blocks: DataFrame, species: list[str]) -> DataFrame:
    """``blocks`` cut down to those that have all of ``species``: their first components in that order, without columns that then are all gaps."""
    found = [_first_of(s) for s in species]
    kept = blocks.withColumn("_c", F.array(*found)).where(F.forall("_c", lambda c: c.isNotNull()))
    dense = F.transform("_c", lambda c, i: c.withField("text", F.get("_texts", i)))
    return kept.withColumn("_texts", _used_columns(F.transform("_c", lambda c: c["text"]))).withColumn("components", dense).drop("_c", "_texts")


@F.pandas_udf(ArrayType(StringType()))
def _used_columns(rows: pd.Series) -> pd.Series:
    """Texts of the same columns without those in which all have a gap. As wide as the first, all null if that is; another null has gaps only, and stays null."""
    sizes = np.array([len(texts[0] or "") for texts in rows], dtype=np.int64)
    bounds = np.concatenate([[0], np.cumsum(sizes)])
    species = len(rows.iloc[0]) if len(rows) else 0
    # Letters of all rows laid end to end, one array for each species; nothing stands for what a shorter text lacks.
    every = [np.frombuffer("".join("-" * n if t[k] is None else t[k][:n].ljust(n, "\0") for t, n in zip(rows, sizes, strict=True)).encode("utf-32-le"), dtype="<u4") for k in range(species)]
    used = np.zeros(bounds[-1], dtype=bool)
    for letters_ in every:
        used |= letters_ != ord("-")
    ends = np.concatenate([[0], np.cumsum(used)])[bounds]
    thin = [letters_[used].tobytes().decode("utf-32-le") for letters_ in every]
    out = [[None if t[0] is None or t[k] is None else thin[k][a:b].replace("\0", "") for k in range(species)] for t, a, b in zip(rows, ends[:-1], ends[1:], strict=True)]
    return pd.Series(out, index=rows.index, dtype=object)
