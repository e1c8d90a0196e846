from loomgrid.llm import decontaminate

ITEMS = [
    (1, "If a train leaves Boston at 60 km an hour and Alice waits for 3 hours, how far does Alice travel in the end?"),
    (2, "the quick brown fox jumps over the lazy dog and runs home to sleep"),
    (3, "tiny one"),
    (4, None),
    (None, "nobody knows which item this one is at all today"),
]
FILLER = "some other text goes before, and more of it stands here"


def found(spark, rows):
    docs = spark.createDataFrame([(*r, 5) for r in rows], "doc_id long, text string, item int")
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    return {r.id: (r.n_items, r.item_ids) for r in decontaminate.leak_report(docs, items).collect()}


def test_copies_parameters_and_slots(spark):
    literal = ITEMS[0][1]
    other = literal.replace("60", "75.5").replace("Alice", "Bob").replace("Boston", "Paris").replace("3 hours", "9 hours")
    mixed = literal.replace("60 km", "75 kg").replace("and Alice", "and Bob").replace("does Alice", "does Carol").replace("Boston", "Paris")
    rows = [
        (1, f"{FILLER} {literal} {FILLER}"), (2, f"{FILLER} {other}"), (3, f"{FILLER} {mixed}"), (4, FILLER), (5, None), (6, ""),
        (7, ITEMS[1][1].upper()), (8, "the quick brown fox jumps over the lazy dog"), (9, f"{ITEMS[1][1]} {literal} " * 300), (10, "tiny one"),
    ]
    got = found(spark, rows)
    assert got == {1: (1, [1]), 2: (1, [1]), 3: (0, []), 4: (0, []), 5: (0, []), 6: (0, []), 7: (1, [2]), 8: (0, []), 9: (2, [1, 2]), 10: (1, [3])}


def test_against_brute_force(spark):
    import random

    rng = random.Random(9)
    word = lambda: rng.choice("abcdefgh") + rng.choice("aeiou") + rng.choice("xyz")
    item = [word() for _ in range(30)]
    rows = []
    for k in range(60):
        w = list(item)
        for at in rng.sample(range(30), rng.randint(0, 4)):
            w[at] = "zzz" + word()
        rows.append((k, " ".join([word() for _ in range(5)] + w)))
    windows = {tuple(item[k : k + 5]): k for k in range(26)}
    want = set()
    for k, t in rows:
        w, covered = t.split(), set()
        for s in range(len(w) - 4):
            at = windows.get(tuple(w[s : s + 5]))
            if at is not None:
                covered |= set(range(at, at + 5))
        if len(covered) >= 0.8 * 30:
            want.add(k)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    items = spark.createDataFrame([(1, " ".join(item))], "item_id long, text string")
    got = {r.id for r in decontaminate.leak_report(docs, items).where("n_items > 0").collect()}
    assert got == want and 0 < len(want) < 60


def test_filter_keeps_the_rest(spark):
    docs = spark.createDataFrame([(1, ITEMS[1][1], "en"), (2, FILLER, None), (None, ITEMS[1][1], "de"), (2, FILLER, None)], "doc_id long, text string, lang string")
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    kept = decontaminate.without_leaks(docs, items)
    assert kept.columns == docs.columns and sorted((r.doc_id or 0) for r in kept.collect()) == [2, 2]
    none = spark.createDataFrame([], items.schema)
    assert decontaminate.without_leaks(docs, none).count() == 4


def test_items_of_figures_and_names(spark):
    figures = "Compute 12 17 45 23 9 31 88 64 5 70 and give the sum of all these figures"
    names = "Alice Bob Carol Dave Erin Frank Grace Heidi"
    items = spark.createDataFrame([(1, figures), (2, names), (3, "12 17 45 23 9 31 88")], "item_id long, text string")
    other = "Compute 13 18 46 24 8 32 87 65 6 71 and give the sum of all these figures"
    rows = [
        (1, f"{FILLER} {figures} {FILLER}"), (2, f"{FILLER} {names} {FILLER}"), (3, f"{FILLER} {other}"), (4, names.lower()),
        (5, "Ivan Judy Karl Liam Mona Nina Olga Paul"), (6, "1 2 3 4 5 6 7 8 9"), (7, "and give the sum of all these figures"), (8, "17 45 23 9 31 88 64 5 70"),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.id: r.item_ids for r in decontaminate.leak_report(docs, items).collect()}
    assert got == {1: [1, 3], 2: [2], 3: [1], 4: [2], 5: [], 6: [], 7: [], 8: [3]}


STORY = "Yesterday Tom gave 12 apples to Mary and later Mary sold 12 of them to Tom for a fair price while nobody watched"


def retold(text, **names):
    for old, new in names.items():
        text = text.replace(old.replace("n", "") if old.startswith("n1") else old, new)
    return text


def test_slots_over_alignments_and_both_ways(spark):
    halves = STORY.split(" and later ")
    first = retold(halves[0], Tom="Bob", Mary="Ann", n12="7")
    rows = [
        (1, retold(STORY, Tom="Bob", Mary="Ann", n12="7")),
        (2, f"{first} and then later {retold(halves[1], Tom='Bob', Mary='Ann', n12='7')}"),
        (3, f"{first} and then later {retold(halves[1], Tom='Carl', Mary='Sue', n12='31')}"),
        (4, retold(STORY, Tom="Zed", Mary="Zed", n12="7")),
        (5, f"{retold(STORY, Tom='Bob', Mary='Ann', n12='7')}. {retold(STORY, Tom='Carl', Mary='Sue', n12='31')}"),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    items = spark.createDataFrame([(1, STORY), (2, "He said Alice has 3 apples"), (3, "so Alice has 3")], "item_id long, text string")
    assert {r.id: r.n_items for r in decontaminate.leak_report(docs, items).collect()} == {1: 1, 2: 1, 3: 0, 4: 0, 5: 1}
    more = spark.createDataFrame([(1, "and so Bob has 7, too"), (2, "he said Bob has 7 apples"), (3, "so bob has seven")], "doc_id long, text string")
    assert {r.id: r.item_ids for r in decontaminate.leak_report(more, items).collect()} == {1: [3], 2: [2], 3: []}


def meets(doc, item):
    """Whether two windows share a key: their own words, their templates, or templates but for one word that is a name on one side."""
    if [w for w, _ in doc] == [w for w, _ in item]:
        return True
    if min(sum(t not in "012" for _, t in x) for x in (doc, item)) < 2:
        return False
    unlike = [(d, i) for (_, d), (w, t) in zip(doc, item, strict=True) if d != t for i in [(w, t)]]
    if not unlike:
        return True
    d, (w, t) = unlike[0]
    return len(unlike) == 1 and (d == w if t == "1" else t not in "02" and d == "1")


def brute_leaks(doc, item):
    """Every alignment's runs, put together from each as the first, longest first; on (own, template) word lists."""
    n, width = len(item), min(5, len(item))
    runs = set()
    for shift in range(-n, len(doc)):
        same = [0 <= k + shift < len(doc) and (doc[k + shift][1] == item[k][1] or doc[k + shift][0] == item[k][0]) for k in range(n)]
        keyed = {k for k in range(n - width + 1) if all(same[k : k + width]) and meets(doc[k + shift : k + shift + width], item[k : k + width])}
        k = 0
        while keyed and k < n:
            e = k
            while e < n and same[e]:
                e += 1
            if e - k >= width:
                pairs = frozenset((item[j][0], doc[j + shift][0]) for j in range(k, e) if item[j][1] in "012")
                runs.add((e - k, k, e, tuple(sorted(pairs))))
            k = e + 1

    def fine(pairs):
        return len({a for a, _ in pairs}) == len(pairs) == len({b for _, b in pairs})

    best = 0
    runs = sorted((r for r in runs if fine(set(r[3]))), reverse=True)
    for first in runs:
        pairs, words = set(first[3]), set(range(first[1], first[2]))
        for r in runs:
            if fine(pairs | set(r[3])):
                pairs, words = pairs | set(r[3]), words | set(range(r[1], r[2]))
        best = max(best, len(words))
    return best >= 0.8 * n


def test_templates_against_brute_force(spark, monkeypatch):
    import random

    rng = random.Random(5)
    plain, names = "red blue green round small heavy old new fast dark".split(), "Ann Bob Carl Dora Emil".split()

    def word():
        return rng.choice([rng.choice(plain)] * 3 + [rng.choice(names), str(rng.randint(1, 9))])

    items = [(k, "so " + " ".join(word() for _ in range(rng.randint(2, 24)))) for k in range(6)]
    rows = []
    for k in range(60):
        words = rng.choice(items)[1].split()
        swap = {x: rng.choice(names if x in names else [str(rng.randint(1, 9))]) for x in set(words) if x in names or x.isdigit()}
        words = [swap.get(w, w) if rng.random() < 0.97 else word() for w in words]
        if rng.random() < 0.5:
            words.insert(rng.randrange(len(words)), word())
        words = [w.swapcase() if len(w) > 1 and rng.random() < 0.02 else w.capitalize() if rng.random() < 0.04 else w for w in words]
        rows.append((k, " ".join(["so"] + [word() for _ in range(3)] + words + [word() for _ in range(3)])))
    docs, bench = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")

    def words_of(df, name):
        got = df.select(name, decontaminate.template_words(df.text, decontaminate.tokens(df.text)).alias("w")).collect()
        return {r[0]: [(x.own, x.template) for x in r.w] for r in got}

    d, b = words_of(docs, "doc_id"), words_of(bench, "item_id")
    want = {(k, j) for k in d for j in b if brute_leaks(d[k], b[j])}
    assert {(r.id, r.item) for r in decontaminate.leaks(docs, bench).collect()} == want and 10 < len(want) < 300
    monkeypatch.setattr(decontaminate, "BROADCAST_WINDOWS", 0)
    monkeypatch.setattr(decontaminate, "BROADCAST_ROWS", 0)
    assert {(r.id, r.item) for r in decontaminate.leaks(docs, bench).collect()} == want
    leaky = {k for k, _ in want}
    assert {r.doc_id for r in decontaminate.without_leaks(docs, bench).collect()} == set(d) - leaky


def test_odd_rows(spark):
    docs = spark.createDataFrame([(1, ITEMS[1][1], 1), (1, FILLER, 2), (None, ITEMS[1][1], 3), (2, "word " * 200_000 + ITEMS[1][1], 4), (3, None, 5), (1, ITEMS[1][1], 1)], "doc_id long, text string, found int")
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    kept = decontaminate.without_leaks(docs, items)
    assert kept.columns == docs.columns and sorted(r.found for r in kept.collect()) == [2, 5]
    assert decontaminate.leak_report(docs.where("false"), items).count() == 0


SUMS = "Tom has 12 apples. Mary has 5 apples. How many apples do Tom and Mary have together"


def test_names_that_open_sentences(spark):
    rows = [
        (1, f"{FILLER}. {SUMS.replace('Tom', 'Bob').replace('Mary', 'Ann').replace('12', '7').replace('5', '9')}"), (2, "Bob has 7 apples"), (3, SUMS.replace("Tom", "Zed").replace("Mary", "Zed")),
        (4, "Mary said the quick brown fox jumps over the lazy dog"), (5, "The quick brown fox jumps over the lazy dog"), (6, "one quick brown fox jumps over a lazy dog"),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    items = spark.createDataFrame([(1, SUMS), (2, "Alice has 3 apples"), (3, "the quick brown fox jumps over the lazy dog"), (4, "The quick brown fox jumps over the lazy dog")], "item_id long, text string")
    got = {r.id: r.item_ids for r in decontaminate.leak_report(docs, items).collect()}
    assert got == {1: [1, 2], 2: [2], 3: [2], 4: [3, 4], 5: [3, 4], 6: []}


def test_clashing_names(spark):
    names = ["id", "mark", "id2", "mark2", "found", "item", "place", "hash", "n", "codes", "own", "shift", "width"]
    docs = spark.createDataFrame([(1, ITEMS[1][1], *names), (2, FILLER, *names)], ["doc_id", "text", *names])
    items = spark.createDataFrame([(*i, *names[2:]) for i in ITEMS], "item_id long, text string, " + ", ".join(f"{n} string" for n in names[2:]))
    kept = decontaminate.without_leaks(docs, items)
    assert kept.columns == docs.columns and [r.doc_id for r in kept.collect()] == [2]
    assert {r.id: r.n_items for r in decontaminate.leak_report(docs, items).collect()} == {1: 1, 2: 0}
