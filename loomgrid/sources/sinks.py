"""Writers: tables as Parquet, and the text formats that other tools read."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def save(df: DataFrame, path: str, by: list[str] | None = None, mode: str = "overwrite") -> None:
    """A table, in folders by the values of ``by``."""
    writer = df.write.mode(mode)
    (writer.partitionBy(*by) if by else writer).parquet(path)


def heatmap(cells: DataFrame, path: str) -> None:
    """All blocks of a binned matrix, in folders by chromosome (pair)."""
    save(cells, path, [c for c in ("chr", "chr1", "chr2") if c in cells.columns])


def multi_resolution(levels: DataFrame, path: str) -> None:
    """Cells of all resolutions, so that a reader prunes to a level and a chromosome and skips by bin."""
    save(levels.repartitionByRange("level", "chr", "bin1").sortWithinPartitions("level", "chr", "bin1", "bin2"), path, ["level", "chr"])


def mat(contacts: DataFrame, path: str, header: bool = True) -> None:
    """1-based triples fend1, fend2, count."""
    rows = contacts.select((F.col("id1") + 1).alias("fend1"), (F.col("id2") + 1).alias("fend2"), F.col("n").alias("count"))
    rows.write.mode("overwrite").csv(path, sep="\t", header=header)


def scored_intervals(cells: DataFrame, path: str) -> None:
    """chr1 start1 stop1 chr2 start2 stop2 log2(observed / expected), where both are positive."""
    rows = cells.where("obs > 0 and expected > 0").select("chr1", "start1", "stop1", "chr2", "start2", "stop2", F.log2(F.col("obs") / F.col("expected")).alias("score"))
    rows.write.mode("overwrite").csv(path, sep="\t")


def bed(rows: DataFrame, path: str) -> None:
    rows.select("chr", "start", "end").write.mode("overwrite").csv(path, sep="\t")


def fasta(rows: DataFrame, path: str, width: int = 60) -> None:
    """Records of (name, sequence), lines of ``width`` letters."""
    lines = F.regexp_replace("sequence", f"(.{{{width}}})(?=.)", "$1\n")
    rows.select(F.concat(F.lit(">"), "name", F.lit("\n"), lines).alias("value")).write.mode("overwrite").text(path)
