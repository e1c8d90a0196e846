"""From paired reads to contacts: clean, pair, count, filter, combine.

Reads are rows (c1, p1, s1, c2, p2, s2): chromosome, position and strand of both ends. Contacts are
rows (id1, id2, n) with id1 < id2 over elements (id, chr, mid, ...).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import written as checkpointed
from .ranking import exact_percentiles


def canonical(reads: DataFrame) -> DataFrame:
    """The two ends of each read in a fixed order: by chromosome, position, strand."""
    ends = [F.struct(F.col(f"c{k}").alias("c"), F.col(f"p{k}").cast("long").alias("p"), F.col(f"s{k}").cast("int").alias("s")) for k in (1, 2)]
    in_order = ends[0] <= ends[1]
    out = {}
    for x in "cps":
        out[f"{x}1"] = F.when(in_order, F.col(f"{x}1")).otherwise(F.col(f"{x}2"))
        out[f"{x}2"] = F.when(in_order, F.col(f"{x}2")).otherwise(F.col(f"{x}1"))
    return reads.select([out.get(c, F.col(c)).alias(c) for c in reads.columns])


def dedupe(reads: DataFrame) -> DataFrame:
    """One read for each unordered pair of (chromosome, position, strand)."""
    return canonical(reads).dropDuplicates(["c1", "p1", "s1", "c2", "p2", "s2"])


def cis_trans(reads: DataFrame) -> DataFrame:
    return reads.withColumn("is_cis", F.col("c1") == F.col("c2"))


def pair_counts(events: DataFrame, group: str, element: str) -> DataFrame:
    """Contacts between elements that occur in the same group: distinct, joined with themselves, counted."""
    seen = events.select(F.col(group).alias("g"), F.col(element).alias("e")).where("e is not null").distinct()
    a, b = seen.withColumnRenamed("e", "id1"), seen.withColumnRenamed("e", "id2")
    return a.join(b, "g").where("id1 < id2").groupBy("id1", "id2").agg(F.count("*").alias("n"))


def invalid_pair(id1: Column, id2: Column) -> Column:
    """Halves of one fragment, or facing halves of neighbours: never a contact of its own (id1 < id2)."""
    even = id1 % 2 == 0
    return (id1 == id2) | (even & ((id2 == id1 + 1) | (id2 == id1 + 3))) | (~even & (id2 == id1 + 1))


def valid_pairs(contacts: DataFrame) -> DataFrame:
    return contacts.where(~invalid_pair(F.col("id1"), F.col("id2")))


def both_ends(contacts: DataFrame, value: str = "n") -> DataFrame:
    """(id, other, value): each contact seen from either end."""
    a = contacts.select(F.col("id1").alias("id"), F.col("id2").alias("other"), F.col(value).alias("value"))
    return a.unionByName(contacts.select(F.col("id2").alias("id"), F.col("id1").alias("other"), F.col(value).alias("value")))


def degree(contacts: DataFrame) -> DataFrame:
    """(id, degree, total): distinct partners of each element and the counts over them."""
    return both_ends(contacts).groupBy("id").agg(F.count("*").alias("degree"), F.sum("value").alias("total"))


def with_elements(contacts: DataFrame, elements: DataFrame, columns: tuple[str, ...] = ("chr", "mid")) -> DataFrame:
    """Contacts with the given columns of both elements, numbered 1 and 2. Pairs of unknown elements drop out."""
    for k in ("1", "2"):
        side = elements.select(F.col("id").alias(f"id{k}"), *[F.col(c).alias(f"{c}{k}") for c in columns])
        contacts = contacts.join(side, f"id{k}")
    return contacts


def in_range(contacts: DataFrame, mindistance: int = 0, maxdistance: int = 0, inclusive: bool = False) -> DataFrame:
    """Cis contacts (with chr1, mid1, chr2, mid2) whose distance is at least ``mindistance`` and, unless 0, below ``maxdistance``."""
    d = F.abs(F.col("mid2") - F.col("mid1"))
    keep = (F.col("chr1") == F.col("chr2")) & (d >= mindistance)
    if maxdistance:
        keep = keep & (d <= maxdistance if inclusive else d < maxdistance)
    return contacts.where(keep)


def core_round(contacts: DataFrame, least: int, mindistance: int = 0, maxdistance: int = 0) -> DataFrame:
    """Contacts both of whose elements have at least ``least`` partners, counted within the distances where these are given."""
    counted = in_range(contacts, mindistance, maxdistance) if mindistance or maxdistance else contacts
    keep = degree(counted).where(F.col("degree") >= least).select("id")
    return contacts.join(keep.withColumnRenamed("id", "id1"), "id1", "left_semi").join(keep.withColumnRenamed("id", "id2"), "id2", "left_semi")


def core(contacts: DataFrame, least: int, rounds: int | None = None, mindistance: int = 0, maxdistance: int = 0) -> DataFrame:
    """Iterative degree filter, until nothing drops out or for a fixed number of rounds.

    With distances (0 for none), ``contacts`` have chr1, mid1, chr2 and mid2, and partners on one
    chromosome at a distance from ``mindistance`` up to ``maxdistance`` count; all contacts of the
    elements that stay are kept. Each round is written, as it is used several times in the next.
    """
    if rounds is not None:
        for _ in range(rounds):
            contacts = core_round(checkpointed(contacts), least, mindistance, maxdistance)
        return contacts.select("id1", "id2", "n")
    contacts = checkpointed(contacts)
    before = contacts.count()
    while before:
        contacts = checkpointed(core_round(contacts, least, mindistance, maxdistance))
        now = contacts.count()
        if now == before:
            break
        before = now
    return contacts.select("id1", "id2", "n")


def keep_elements(contacts: DataFrame, elements: DataFrame) -> DataFrame:
    """Contacts with both ends among ``elements`` (id)."""
    ids = elements.select("id")
    return contacts.join(ids.withColumnRenamed("id", "id1"), "id1", "left_semi").join(ids.withColumnRenamed("id", "id2"), "id2", "left_semi").select("id1", "id2", "n")


def cis_to_total(contacts: DataFrame) -> DataFrame:
    """(id, ratio): share of each element's contacts (with chr1, chr2) that are cis."""
    cis = F.when(F.col("chr1") == F.col("chr2"), F.col("n")).otherwise(0)
    marked = contacts.withColumn("_cis", cis)
    a = marked.select(F.col("id1").alias("id"), "n", "_cis")
    return a.unionByName(marked.select(F.col("id2").alias("id"), "n", "_cis")).groupBy("id").agg((F.sum("_cis") / F.sum("n")).alias("ratio"))


def between_percentiles(values: DataFrame, column: str, low: float, high: float) -> DataFrame:
    """Rows whose value lies between two exact percentiles (linear interpolation) of all non-zero ones."""
    cuts = exact_percentiles(values.where(F.col(column) != 0), column, [low, high])
    return values.join(F.broadcast(cuts)).where((F.col(column) >= F.col("cuts")[0]) & (F.col(column) <= F.col("cuts")[1])).select(values.columns)


def length_filter(elements: DataFrame, shorter_than: int, longer_than: int) -> DataFrame:
    return elements.where((F.col("len") < shorter_than) & (F.col("len") > longer_than))


def too_close(reads: DataFrame, least: int) -> DataFrame:
    """Reads without those of one chromosome whose ends are fewer than ``least`` apart."""
    return reads.where((F.col("c1") != F.col("c2")) | (F.abs(F.col("p1") - F.col("p2")) >= least))


def orientation(reads: DataFrame) -> DataFrame:
    """Reads whose ends lie on different strands."""
    return reads.where("s1 <> s2")


def dangling_ends(reads: DataFrame, longest_molecule: int) -> DataFrame:
    """Reads without facing ends of one chromosome no further apart than a molecule."""
    facing = F.when(F.col("s1") == 1, F.col("p2") - F.col("p1")).otherwise(F.col("p1") - F.col("p2"))
    bad = (F.col("c1") == F.col("c2")) & (F.col("s1") != F.col("s2")) & (facing >= 0) & (facing <= longest_molecule)
    return reads.where(~bad)


def pair_classes(reads: DataFrame) -> DataFrame:
    """(kind, n): reads by what their ends tell: trans, self (one place), same strand, facing, apart."""
    kind = (
        F.when(F.col("c1") != F.col("c2"), "trans").when(F.col("p1") == F.col("p2"), "self").when(F.col("s1") == F.col("s2"), "same_strand")
        .when((F.col("p1") < F.col("p2")) == (F.col("s1") == 1), "facing").otherwise("apart")
    )
    return reads.groupBy(kind.alias("kind")).agg(F.count("*").alias("n"))


def combine(*replicates: DataFrame) -> DataFrame:
    """Contacts of several data sets: counts add up."""
    out = replicates[0]
    for r in replicates[1:]:
        out = out.unionByName(r)
    return out.groupBy("id1", "id2").agg(F.sum("n").alias("n"))


def read_metrics(reads: DataFrame) -> DataFrame:
    """One row of counters over reads."""
    cis = F.col("c1") == F.col("c2")
    return reads.agg(
        F.count("*").alias("total"), F.count_if(cis).alias("cis"), F.count_if(~cis).alias("trans"),
        F.count_if(cis & (F.col("s1") == F.col("s2"))).alias("cis_same_strand"), F.count_if(cis & (F.col("p1") == F.col("p2"))).alias("cis_same_place"),
    )


def contact_class(contacts: DataFrame, kind: str, threshold: int) -> DataFrame:
    """Contacts (with chr1, mid1, chr2, mid2) of a class: trans, far_cis (at ``threshold`` or beyond), close_cis (up to it) or both."""
    cis, d = F.col("chr1") == F.col("chr2"), F.abs(F.col("mid2") - F.col("mid1"))
    keep = {"trans": ~cis, "far_cis": cis & (d >= threshold), "close_cis": cis & (d <= threshold), "both": F.lit(True)}
    return contacts.where(keep[kind])


def valid_elements(elements: DataFrame, flag: str = "valid") -> DataFrame:
    """Elements whose flag is 1."""
    return elements.where(F.col(flag) == 1)


def read_kinds(reads: DataFrame, fragment_of: tuple[str, str] = ("f1", "f2")) -> DataFrame:
    """(kind, n) of reads with the fragment of each end: re-ligation of neighbours, self-ligation and no ligation within one fragment, else mapped.

    Ends that face each other within a fragment were never cut; ends that face outwards closed a circle.
    """
    a, b = (F.col(c) for c in fragment_of)
    inward = F.when(F.col("p1") <= F.col("p2"), (F.col("s1") == 1) & (F.col("s2") == 0)).otherwise((F.col("s2") == 1) & (F.col("s1") == 0))
    kind = F.when((a == b) & inward, "no_ligation").when(a == b, "self_ligation").when(F.abs(a - b) == 1, "re_ligation").otherwise("mapped")
    return reads.groupBy(kind.alias("kind")).agg(F.count("*").alias("n"))


def named_counts(counts: DataFrame, fragments: DataFrame) -> DataFrame:
    """Contacts (id1, id2, n) from (name1, name2, n) and fragments (id, name, strand).

    Pairs with an unknown name, of one fragment or of one strand drop out; repeated pairs add up.
    """
    for k in ("1", "2"):
        side = fragments.select(F.col("name").alias(f"name{k}"), F.col("id").alias(f"i{k}"), F.col("strand").alias(f"t{k}"))
        counts = counts.join(side, f"name{k}")
    kept = counts.where("i1 <> i2 AND t1 <> t2")
    return kept.groupBy(F.least("i1", "i2").alias("id1"), F.greatest("i1", "i2").alias("id2")).agg(F.sum("n").alias("n"))
