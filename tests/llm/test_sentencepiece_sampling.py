from collections import Counter

import numpy as np
import pytest

from loomgrid.llm import sentencepiece_sampling as sp


@pytest.fixture(scope="module")
def vocabulary():
    return sp.Vocabulary(sp.VOCABULARY)


def all_paths(lat, word=0):
    """{edges in walking order: log-probability} of a word."""
    out, open_ = {}, [((), int(lat.last_node[word]), 0.0)]
    while open_:
        edges, node, log_p = open_.pop()
        if lat.is_first[node]:
            out[edges] = log_p
            continue
        a = int(lat.first_edge[node])
        while True:
            open_.append(((*edges, a), int(lat.src[a]), log_p + float(lat.log_p[a])))
            if lat.upto[a] == 2.0:
                break
            a += 1
    return out


def test_lattice_probabilities(vocabulary):
    for word in ("▁there", "▁é%\n", "x" * 6, "▁" + "ab" * 60):
        lat = sp.Lattices([word.encode()], vocabulary)
        if len(word) < 20:
            paths = all_paths(lat)
            assert abs(sum(np.exp(list(paths.values()))) - 1) < 1e-9
            weight = lambda e: sum(vocabulary.log_weight[lat.piece[k]] if lat.piece[k] >= 0 else lat.length[k] * vocabulary.log_byte for k in e)
            gaps = {round(p - weight(e), 6) for e, p in paths.items()}
            assert len(gaps) == 1
        else:
            short = sp.SHORT_WORD
            sp.SHORT_WORD = 1000
            try:
                assert np.allclose(sp.Lattices([word.encode()], vocabulary).log_p, lat.log_p)
            finally:
                sp.SHORT_WORD = short


def test_draws_without_replacement(vocabulary):
    text = "there"
    lat = sp.Lattices(["▁there".encode()], vocabulary)
    chance = {tuple(lat.ids(np.array(e[::-1]), vocabulary).tolist()): float(np.exp(p)) for e, p in all_paths(lat).items()}
    n, k = 3000, 2
    draws = [sp.draw_batch([text], [key], vocabulary, k)[0] for key in range(n)]
    first = Counter(tuple(d[0][0].tolist()) for d in draws)
    second = Counter(tuple(d[1][0].tolist()) for d in draws)
    assert all(len({tuple(x[0].tolist()) for x in d}) == k for d in draws)
    for ids, p in sorted(chance.items(), key=lambda x: -x[1])[:4]:
        assert abs(first[ids] / n - p) < 4 * np.sqrt(p * (1 - p) / n) + 1e-3
        want = sum(q * p / (1 - q) for other, q in chance.items() if other != ids)
        assert abs(second[ids] / n - want) < 4 * np.sqrt(want * (1 - want) / n) + 1e-3
    # Draws weighted by probability / inclusion estimate sums without bias: here, one.
    total = [sum(np.exp(p - inc) for _, p, inc in d) for d in draws]
    assert abs(np.mean(total) - 1) < 4 * np.std(total) / np.sqrt(n) + 1e-3


def test_round_trip_and_odd_rows(spark, vocabulary):
    rows = [(1, "The quick brown fox"), (2, ""), (3, None), (4, "  two  spaces \n\tand é①​ "), (5, "x" * 5000), (6, "word " * 20000), (None, "no key"), (1, "The quick brown fox"), (7, "日本語" * 50), (8, "a")]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, draw int").repartition(3)
    encoded = sp.encode_samples(docs, samples=3)
    got = encoded.collect()
    back = sp.decode_ids(encoded).collect()
    texts = dict(rows)
    assert {r.id for r in got} == {1, 2, 4, 5, 6, 7, 8, None}
    assert all(r.text == texts[r.id] for r in back)
    by_id = {}
    for r in got:
        by_id.setdefault(r.id, []).append(r)
    assert len(by_id[2]) == 1 and by_id[2][0].ids == [] and len(by_id[5]) == 3
    assert sorted(tuple(r.ids) for r in by_id[1]) == sorted(2 * sorted({tuple(r.ids) for r in by_id[1]})) and len(by_id[1]) == 6
    assert all(r.log_inclusion <= 0 and r.log_prob <= 0 for r in got)
    again = {(r.id, r.draw, tuple(r.ids)) for r in sp.encode_samples(docs.repartition(1), samples=3).collect()}
    assert again == {(r.id, r.draw, tuple(r.ids)) for r in got}
    assert sp.encode_samples(docs.where("false")).count() == 0


def test_words_held_over_texts_change_no_draw(vocabulary, monkeypatch):
    monkeypatch.setattr(sp, "HELD_WORDS", 12)
    texts = ["the quick brown fox", "", "the slow fox é①​ 日本語", "  two  ▁spaces \n", "one brown fox over one fence and on", "日本語 \U0001f680\U0001f600z the quick fox"]
    seen, built = sp.Words(vocabulary), []
    lattices = sp.Lattices
    monkeypatch.setattr(sp, "Lattices", lambda words, v: built.extend(words) or lattices(words, v))
    got = [sp.draw_batch([t], [k], vocabulary, 3, seen)[0] for k, t in enumerate(texts)]
    # Words of earlier texts are not looked up again until too many are held.
    assert built.count("▁fox".encode()) == 2 and len(seen.index) < 12
    for k, t in enumerate(texts):
        alone = sp.draw_batch([t], [k], vocabulary, 3)[0]
        assert len(got[k]) == len(alone)
        for (a, p, x), (b, q, y) in zip(got[k], alone, strict=True):
            assert a.tolist() == b.tolist() and np.allclose([p, x], [q, y]) and sp.decode(a, vocabulary) == t.replace("▁", " ")


def test_chance_is_uniform_of_one_number():
    seeds = [0, 1, 2**64 - 1, *(sp._seed(k) for k in range(50))]
    assert [sp._chance(s) for s in seeds] == sp.uniform(np.array(seeds, dtype=np.uint64)).tolist()


def test_trie_is_small_and_holds_the_pieces_alone(vocabulary):
    # As many numbers as states and a little more, where 256 for each state took 54 MB in every worker.
    assert sum(x.nbytes for x in vars(vocabulary).values() if isinstance(x, np.ndarray)) < 4 << 20
    spelt = {}
    for state in range(len(vocabulary.parent)):
        path, at = [], state
        while vocabulary.parent[at] >= 0:
            path.append(at - int(vocabulary.base[vocabulary.parent[at]]))
            at = int(vocabulary.parent[at])
        if at == 0 and vocabulary.ends[state] >= 0:
            spelt[bytes(path[::-1])] = int(vocabulary.ends[state])
    want = {x.replace(b" ", sp.SPACE.encode()): k for k, x in enumerate(vocabulary.bytes) if x}
    bytewise = {k for k in vocabulary.byte_id.tolist() if k}
    assert spelt == {x: k for x, k in want.items() if k not in bytewise}


def test_words_made_in_slices_are_those_made_at_once(vocabulary, monkeypatch):
    monkeypatch.setattr(sp, "NEW_WORDS", 2)
    seen = sp.Words(vocabulary)
    text = "the quick brown fox é①​ 日本語 the fence and on"
    seen.of_texts([text])
    seen.of_texts(["a few more words"])
    whole = sp.Lattices(seen.index.spelt(), vocabulary)
    for name in ("text", "first_node", "last_node", "place", "length", "piece", "src", "first_edge", "is_first"):
        assert getattr(seen.lat, name).tolist() == getattr(whole, name).tolist(), name
    assert np.allclose(seen.lat.log_p, whole.log_p) and np.allclose(seen.lat.upto, whole.upto, atol=1e-6) and np.allclose(seen.lat.other, whole.other, atol=1e-6)
