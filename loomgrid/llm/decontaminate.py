"""Benchmark decontamination by template windows, in DataFrame functions only.

Texts are brought to templates: numbers, names and units become typed placeholders. Windows of
``WORDS`` words of the benchmark's templates are hash-joined with those of the documents (an item of
fewer words is one window). A match lays item and document side by side; every stretch of at least a
window whose words agree is a run. Slots - the words behind placeholders - must be consistent over
all runs that are put together for an item: one value of the item's stands for one of the document's,
and the other way round. A document leaks an item if one run, or consistent runs together, cover
``COVERAGE`` of its words. A question with other numbers or names is found like a literal copy.

A window with fewer than ``LITERAL_WORDS`` literal words names nothing in particular by its template;
its own words are its key.

Nulls: a null text has no words and leaks nothing; rows with a null id are judged like any other.
Texts are read whole, however long. Repeated rows give repeated results, and rows that share an id
but not the text are judged each. An empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import staged

WORDS = 5
COVERAGE = 0.8
LITERAL_WORDS = 2
#: Benchmark windows up to this many (about 100 bytes each) are broadcast; more are joined by shuffle.
BROADCAST_WINDOWS = 100_000
#: Documents that leak, named by 16 bytes each, are broadcast up to this many.
BROADCAST_ROWS = 200_000

# Units of measure.
UNITS = (
    "mm cm dm m km in ft yd mi mg g kg t lb oz ml cl l ms s sec secs min mins h hr hrs kb mb gb tb hz khz mhz ghz w kw mwh kwh v a "
    "second seconds minute minutes hour hours day days week weeks month months year years "
    "meter meters metre metres kilometer kilometers kilometre kilometres mile miles foot feet inch inches "
    "gram grams kilogram kilograms pound pounds ounce ounces liter liters litre litres "
    "dollar dollars cent cents euro euros percent degree degrees"
).split()
NUMBER, NAME, UNIT = "0", "1", "2"
#: A number with its separators (a unit written on to it stands apart), or a word.
TOKEN = rf"\d+(?:[.,]\d+)*(?:(?=(?i:{'|'.join(UNITS)})\b)|[\p{{L}}\p{{N}}]*)|[\p{{L}}\p{{N}}]+"


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(text.cast("string"), F.lit("")), F.lit(TOKEN), F.lit(0))


def _own(x: Column) -> Column:
    """A token's word as it stands, in lower case; numbers without separators."""
    return F.lower(F.translate(x, ".,", ""))


def _typed(text: Column, found: Column, number: Column, name: Column, unit: Column, literal: Callable[[Column], Column]) -> Column:
    """Each of the tokens ``found`` of a text as one of four kinds.

    A name is a capitalised word, one that opens a sentence too; words all in capitals are words like any
    other. A unit stands behind a number. Most words are in lower case, and most texts without
    figures; these take the short way.
    """

    def capital(x: Column) -> Column:
        first, second = F.substring(x, 1, 1), F.substring(x, 2, 1)
        is_name = (first != F.lower(first)) & (second != F.upper(second))
        return F.when(first.between("0", "9"), number).when(is_name, name).otherwise(literal(_own(x)))

    def with_figures(x: Column, i: Column) -> Column:
        behind = F.get(found, i - 1)
        is_unit = F.lower(x).isin(*UNITS) & (i > 0) & F.substring(behind, 1, 1).between("0", "9")
        low = F.when(F.substring(x, 1, 1).between("0", "9"), number).when(is_unit, unit).otherwise(literal(x))
        return F.when(x == F.lower(x), low).when(is_unit, unit).otherwise(capital(x))

    plain = F.transform(found, lambda x: F.when(x == F.lower(x), literal(x)).otherwise(capital(x)))
    return F.when(text.rlike(r"\d"), F.transform(found, with_figures)).otherwise(plain)


def template_words(text: Column, found: Column) -> Column:
    """Array of structs (own, template): each token's word and what stands for it in the template."""
    own = F.transform(found, _own)
    template = _typed(text, found, F.lit(NUMBER), F.lit(NAME), F.lit(UNIT), lambda x: x)
    return F.arrays_zip(own.alias("own"), template.alias("template"))


def _codes(text: Column, found: Column) -> Column:
    """Numbers in place of template words: 0, 1, 2 for placeholders, else a hash."""
    zero, one, two = (F.lit(k).cast("long") for k in range(3))
    return _typed(text, found, zero, one, two, F.xxhash64)


def _windows(width: int) -> str:
    """The keys of the windows of ``codes``, which stands for ``own`` where few words are literal."""
    at = lambda name: f"xxhash64({', '.join(f'get({name}, i + {k})' for k in range(width))})"
    literal = " + ".join(f"if(get(codes, i + {k}) between 0 and 2, 0, 1)" for k in range(width))
    each = f"transform(sequence(0, size(codes) - {width}), i -> %s)"
    either = f"if({literal} < {LITERAL_WORDS}, {at('own')}, {at('codes')})"
    return f"case when size(codes) < {width} then array() when size(own) = 0 then {each % at('codes')} else {each % either} end"


def window_keys(docs: DataFrame, width: int) -> DataFrame:
    """``docs`` with (place, hash) for each window of ``width`` words of ``found``, the tokens of ``text``."""
    coded = docs.withColumn("codes", _codes(F.col("text"), F.col("found")))
    # Only with so many placeholders a window can have too few literal words.
    crowded = F.size(F.filter("codes", lambda c: c.between(0, 2))) > width - LITERAL_WORDS
    coded = coded.withColumn("own", F.when(crowded, F.transform("found", lambda x: F.xxhash64(_own(x)))).otherwise(F.array().cast("array<bigint>")))
    return coded.select(*[c for c in docs.columns if c != "text"], F.posexplode(F.expr(_windows(width))).alias("place", "hash"))


def benchmark_items(benchmark: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(item, n, width, words): the items' words with their templates, and the size of their windows."""
    named = benchmark.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("item"), F.col(text_col).cast("string").alias("text"), tokens(F.col(text_col)).alias("found"))
    sized = named.select("item", F.size("found").alias("n"), F.least(F.lit(WORDS), F.size("found")).alias("width"), template_words(F.col("text"), F.col("found")).alias("words"))
    return sized.where("n > 0")


def item_keys(items: DataFrame) -> DataFrame:
    """(item, n, width, at, hash): all windows have their own words as a key, and those with enough literal words their template too.

    A word that opens a sentence on one side only is a name there and a literal word on the other. So a template is also keyed with each one of
    its names taken as a word, and each one of its words as a name.
    """
    placed = items.select("*", F.explode(F.expr("sequence(0, n - width)")).alias("at")).withColumn("w", F.expr("slice(words, at + 1, width)"))
    literal = F.size(F.filter("w", lambda x: ~x["template"].isin(NUMBER, NAME, UNIT)))

    def key(width: int, part: str, turned: int | None) -> Column:
        def code(k: int) -> Column:
            x = F.get("w", F.lit(k))
            t, own = x["template"], F.xxhash64(x["own"])
            if part == "own":
                return own
            if k == turned:
                return F.when(t == NAME, own).when(t.isin(NUMBER, UNIT), t.cast("long")).otherwise(F.lit(NAME).cast("long"))
            return F.when(t.isin(NUMBER, NAME, UNIT), t.cast("long")).otherwise(own)

        return F.xxhash64(*map(code, range(width)))

    def by_width(part: str, turned: int | None = None) -> Column:
        found = F.lit(None).cast("long")
        for width in range(1, WORDS + 1):
            found = F.when(F.col("width") == width, key(width, part, turned)).otherwise(found)
        return found

    forms = [by_width("own"), by_width("template"), *(by_width("template", k) for k in range(WORDS))]
    both = F.when(literal >= LITERAL_WORDS, F.array_distinct(F.array(*forms))).otherwise(F.array(by_width("own")))
    return placed.select("item", "n", "width", "at", F.explode(both).alias("hash"))


def _marked(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, mark, text, found): rows by their id and a hash of their text, with tokens."""
    text = F.col(text_col).cast("string")
    return docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text).alias("mark"), text.alias("text"), tokens(text).alias("found"))


#: The tokens beside an item, with the one before them, which tells of units.
BESIDE = "slice(found, greatest(shift - 1, 0) + 1, n + if(shift > 0, 1, shift))"


def _met(docs: DataFrame, keys: DataFrame, widths: list[int], id_col: str, text_col: str) -> DataFrame:
    """(id, mark, item, shift, beside): items beside the tokens of documents that share a key with them."""
    rows = _marked(docs, id_col, text_col)
    few = keys.count() <= BROADCAST_WINDOWS
    found = None
    for width in widths:
        windows = window_keys(rows, width) if few else window_keys(rows, width).drop("found")
        index = keys.where(F.col("width") == width).drop("width")
        met = windows.join(F.broadcast(index) if few else index, "hash").withColumn("shift", F.col("place") - F.col("at"))
        met = met.select("id", "mark", "item", "shift", F.expr(BESIDE).alias("beside")) if few else met.select("id", "mark", "item", "shift", "n")
        found = met if found is None else found.unionByName(met)
    if few:
        return found.groupBy("id", "mark", "item", "shift").agg(F.first("beside").alias("beside"))
    # Many items: places are joined without texts, and the documents that have any are looked at again.
    places = staged(found.distinct(), "met-places").withColumnsRenamed({"id": "id2", "mark": "mark2"})
    again = rows.drop("text").join(places, F.col("id").eqNullSafe(F.col("id2")) & (F.col("mark") == F.col("mark2")))
    return again.select("id", "mark", "item", "shift", F.expr(BESIDE).alias("beside")).dropDuplicates(["id", "mark", "item", "shift"])


def _runs(met: DataFrame, items: DataFrame) -> DataFrame:
    """(id, mark, item, n, start, end, pairs): stretches of agreeing words with their slots, those consistent in themselves."""
    typed = met.join(items, "item").withColumn("typed", template_words(F.array_join("beside", " "), F.col("beside")))
    typed = typed.withColumn("typed", F.expr("if(shift > 0, slice(typed, 2, n), typed)"))
    # The document's word beside word k of the item stands at k + least(shift, 0); outside it is null.
    beside = "get(typed, k + least(shift, 0))"
    same = typed.withColumn("same", F.expr(f"transform(sequence(0, n - 1), k -> coalesce({beside}.template = words[k].template or {beside}.own = words[k].own, false))"))
    starts = "filter(sequence(0, n - 1), k -> same[k] and not coalesce(get(same, k - 1), false))"
    ends = "transform(%s, k -> struct(k as start, int(coalesce(nullif(array_position(slice(same, k + 1, n), false), 0) - 1 + k, n)) as end))"
    runs = same.select("*", F.explode(F.expr(f"filter({ends % starts}, r -> r.end - r.start >= width)")).alias("run"))
    slots = f"filter(sequence(run.start, run.end - 1), k -> words[k].template in ('{NUMBER}', '{NAME}', '{UNIT}'))"
    pairs = F.expr(f"array_sort(array_distinct(transform({slots}, k -> struct(words[k].own as item, {beside}.own as doc))))")
    found = runs.select("id", "mark", "item", "n", "run.start", "run.end", pairs.alias("pairs")).where(_consistent("pairs"))
    return found.distinct()


def _consistent(pairs: str) -> str:
    """Whether different pairs differ on both sides."""
    return f"size(array_distinct({pairs}.item)) = size({pairs}) and size(array_distinct({pairs}.doc)) = size({pairs})"


def leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """(id, mark, item, coverage): the items that each document leaks, with the share of their words found.

    ``mark`` is a hash of the text. Where no run is long enough by itself, runs are put together,
    longest first, as long as their slots stay consistent; each run is tried as the first.
    """
    items = staged(benchmark_items(benchmark, item_col, item_text_col), "benchmark-items")
    keys = item_keys(items)
    widths = sorted(r.width for r in items.select("width").distinct().collect())  # 1 to WORDS
    small = items.count() <= BROADCAST_WINDOWS // WORDS
    if not widths:
        widths = [WORDS]
    met = _met(docs, keys, widths, id_col, text_col)
    runs = _runs(met, F.broadcast(items) if small else items)
    by_item = runs.groupBy("id", "mark", "item", "n").agg(F.max(F.col("end") - F.col("start")).alias("longest"), F.sort_array(F.collect_list(F.expr("struct(end - start as size, start, end, pairs)")), False).alias("runs"))
    joined = f"array_distinct(concat(acc.pairs, r.pairs))"  # noqa: F541
    step = f"if({_consistent(joined)}, struct({joined} as pairs, array_union(acc.words, sequence(r.start, r.end - 1)) as words), acc)"
    together = f"array_max(transform(runs, f -> aggregate(runs, struct(f.pairs as pairs, sequence(f.start, f.end - 1) as words), (acc, r) -> {step}, acc -> size(acc.words))))"
    covered = F.expr(f"case when longest >= {COVERAGE} * n then longest when size(runs) = 1 then longest else {together} end")
    return by_item.select("id", "mark", "item", (covered / F.col("n")).alias("coverage")).where(F.col("coverage") >= COVERAGE)


def leak_report(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: id, the number of items leaked, their ids in order, and the best coverage."""
    found = leaks(docs, benchmark, id_col, text_col)
    by_doc = staged(found.groupBy("id", "mark").agg(F.array_sort(F.collect_list("item")).alias("item_ids"), F.max("coverage").alias("coverage")), "leaks")
    by_doc = by_doc.withColumnsRenamed({"id": "id2", "mark": "mark2"})
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(F.col(text_col).cast("string")).alias("mark"))
    by_doc = F.broadcast(by_doc) if by_doc.count() <= BROADCAST_ROWS else by_doc
    return rows.join(by_doc, F.col("id").eqNullSafe(F.col("id2")) & (F.col("mark") == F.col("mark2")), "left").select(
        "id", F.coalesce(F.size("item_ids"), F.lit(0)).cast("long").alias("n_items"), F.coalesce("item_ids", F.array().cast("array<bigint>")).alias("item_ids"), F.coalesce("coverage", F.lit(0.0)).alias("coverage")
    )


def without_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without documents that leak an item; of rows that share an id only those whose own text leaks go."""
    bad = staged(leaks(docs, benchmark, id_col, text_col).select("id", "mark").distinct(), "leaky").withColumnsRenamed({"id": "id2", "mark": "mark2"})
    bad = F.broadcast(bad) if bad.count() <= BROADCAST_ROWS else bad
    # Columns of the two sides, not names, which ``docs`` may have too.
    on = docs[id_col].cast("long").eqNullSafe(bad["id2"]) & (F.xxhash64(docs[text_col].cast("string")) == bad["mark2"])
    return docs.join(bad, on, "left_anti")
