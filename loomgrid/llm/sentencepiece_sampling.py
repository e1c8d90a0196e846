"""SentencePiece encoding and decoding: distinct segmentations drawn without replacement.

A text's pieces form a lattice: every way to cut it into pieces of the vocabulary is a path, with
probability in proportion to the product of its pieces' weights. Pieces never reach over the start
of a word, so the lattice of a text is that of its words in a row; each different word is looked up
in a byte trie and summed up once for many texts.

The ``k`` paths of largest Gumbel-perturbed log-probability are ``k`` distinct draws without
replacement. They are found by a best-first (A*) search: the set of paths not drawn yet is split into
"agrees with a drawn path up to here and leaves it now"; each part has a known total probability, so
the largest perturbed value in it is a Gumbel truncated at its parent's. The part with the largest
value is opened next and its best path completed at random. The value of the next part, not drawn,
is the threshold that turns a path's probability into its chance of being included.

Random numbers are hashes of the row's key, the draw, the place and the step, so results don't
depend on how rows are dealt to tasks. The vocabulary file is merges in order of rank; weights follow
the rank as 1 / (rank + 2), raised to ``SHARPNESS``.

Null texts have no draws and give no rows; empty texts have one segmentation, of no pieces. Rows that
repeat a key and its text get equal draws. A null key counts as 0 for the random numbers. An empty
table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import re
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
SAMPLES = 2
SHARPNESS = 1.0
SEED = 20
#: Characters of the texts that are worked on at once, beyond which a longer text stands alone.
BATCH_CHARS = 600_000
#: Rows of an Arrow batch that are turned into Python's strings at once.
SLICE_ROWS = 128
#: A task's lattices are kept for its next texts until they are of so many words.
HELD_WORDS = 100_000
#: New words whose lattices are made at once.
NEW_WORDS = 8192
#: Places of the trie's table that are tried at once for a state.
LAID_AT_ONCE = 1024
#: Words up to so many bytes are summed up in plain floats, several at once; longer ones in logarithms.
SHORT_WORD = 64

SPACE = "▁"
WORD = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")
TINY = 1e-300


class Vocabulary:
    """Byte trie, weights and bytes of the pieces of a SentencePiece model."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        rank = np.full(n, float(n))
        self.bytes: list[bytes] = [b""] * n
        pieces: list[tuple[int, bytes]] = []
        self.byte_id = np.zeros(256, dtype=np.int32)
        for k in range(n):
            piece = model.id_to_piece(k)
            if model.is_byte(k):
                self.bytes[k] = bytes([int(piece[3:5], 16)])
                self.byte_id[int(piece[3:5], 16)] = k
            elif not (model.is_control(k) or model.is_unknown(k)):
                self.bytes[k] = piece.replace(SPACE, " ").encode()
                pieces.append((k, piece.encode()))
                rank[k] = min(n, max(0.0, -model.get_score(k)))
        #: The pieces' bytes in a row, where each begins, and how many they are.
        self.spelling = np.frombuffer(b"".join(self.bytes), dtype=np.uint8)
        self.spelt = np.array([len(x) for x in self.bytes], dtype=np.int32)
        self.begin = (np.cumsum(self.spelt) - self.spelt).astype(np.int32)
        self.log_weight = -SHARPNESS * np.log(rank + 2)
        self.log_byte = -SHARPNESS * float(np.log(n + 2))
        children: list[dict[int, int]] = [{}]
        ends: list[int] = [-1]
        for k, piece in pieces:
            at = 0
            for c in piece:
                if c not in children[at]:
                    children[at][c] = len(children)
                    children.append({})
                    ends.append(-1)
                at = children[at][c]
            ends[at] = k
        self._lay(children, np.array(ends, dtype=np.int32))

    def _lay(self, children: list[dict[int, int]], ends: np.ndarray) -> None:
        """The trie's states with their 256 places each laid over one another, so that they take little more room than there are states.

        State ``s`` goes on by byte ``c`` to state ``base[s] + c``, if the ``parent`` of that is ``s``. Piece ``ends[s]`` ends in it, -1: none.
        """
        states = len(children)
        begin, place = np.zeros(states, dtype=np.int32), np.zeros(states, dtype=np.int32)
        # The root has place 0, all others places from 256 on.
        free = np.ones(states + 256 + LAID_AT_ONCE, dtype=bool)
        free[:256] = False
        start = 256
        for at in sorted((k for k in range(states) if len(children[k]) > 1), key=lambda k: -len(children[k])):
            taken = np.fromiter(children[at], dtype=np.int64)
            least = int(taken.min())
            while True:
                if start + 256 + LAID_AT_ONCE > len(free):
                    free = np.r_[free, np.ones(len(free), dtype=bool)]
                fits = np.logical_and.reduce([free[start + c - least : start + c - least + LAID_AT_ONCE] for c in taken.tolist()])
                if fits.any():
                    break
                start += LAID_AT_ONCE
            begin[at] = start + int(fits.argmax()) - least
            free[begin[at] + taken] = False
            place[list(children[at].values())] = begin[at] + taken
        # States with one child fill the gaps.
        ones = [(at, *x) for at, some in enumerate(children) if len(some) == 1 for x in some.items()]
        at, c, to = np.array(ones, dtype=np.int64).reshape(-1, 3).T
        place[to] = np.flatnonzero(np.r_[free, np.ones(len(ones), dtype=bool)])[: len(ones)]
        begin[at] = place[to] - c
        size = int(begin.max()) + 256
        self.base, self.parent = np.zeros(size, dtype=np.int32), np.full(size, -1, dtype=np.int32)
        self.ends = np.full(size, -1, dtype=np.int32)
        self.base[place], self.ends[place] = begin, ends
        for at, some in enumerate(children):
            self.parent[place[list(some.values())]] = place[at]


@lru_cache(maxsize=2)
def _vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


class Lattices:
    """The lattices of different words: nodes between bytes, edges that are pieces.

    Edges are stored by the node they end in. ``piece`` is -1 for a character outside the vocabulary,
    which is spelt in bytes.
    """

    def __init__(self, words: list[bytes], v: Vocabulary):
        size = np.array([len(w) for w in words], dtype=np.int32)
        self.text = np.frombuffer(b"".join(words), dtype=np.uint8)
        begin = (np.cumsum(size) - size).astype(np.int32)
        word = np.repeat(np.arange(len(words), dtype=np.int32), size)
        stop = (begin + size)[word]
        # Node of the place before byte p of word w: p + w. Each word has one node more than bytes.
        self.first_node = begin + np.arange(len(words), dtype=np.int32)
        self.last_node = self.first_node + size
        place, length, piece = self._edges(v, stop)
        src = place + word[place]
        dst = src + length
        # Edges come by ascending length, and by place within one: from the end, few runs are merged and longer edges come first.
        order = (len(dst) - 1 - np.argsort(dst[::-1], kind="stable")).astype(np.int32)
        self.place, self.length, self.piece, self.src = place[order], length[order], piece[order], src[order]
        dst = dst[order]
        del place, length, piece, src, order, stop
        nodes = len(self.text) + len(words)
        count = np.bincount(dst, minlength=nodes)
        self.first_edge = (np.cumsum(count) - count).astype(np.int32)
        w = np.where(self.piece >= 0, v.log_weight[np.maximum(self.piece, 0)], self.length * v.log_byte)
        self.is_first = np.zeros(nodes + 1, dtype=bool)
        self.is_first[self.first_node] = True
        self.log_p = self._conditional(w, dst, word, size, nodes)
        del w
        #: The chance to leave an edge's end by another edge.
        self.other = np.where((count == 1)[dst], 0.0, -np.expm1(self.log_p)).astype(np.float32)
        run = np.cumsum(np.exp(self.log_p))
        begins = self.first_edge[dst]
        self.upto = (run - np.where(begins > 0, run[begins - 1], 0.0)).astype(np.float32)
        self.upto[np.r_[dst[1:] != dst[:-1], True] if len(dst) else []] = 2.0
        #: Arrays with room for more words, of which those above are the parts in use.
        self.room: dict[str, np.ndarray] = {}

    def _edges(self, v: Vocabulary, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(place, length in bytes, piece) of every piece that stands somewhere in the words, by ascending length."""
        starts = np.flatnonzero((self.text & 0xC0) != 0x80).astype(np.int32)
        at, state, depth = starts, np.zeros(len(starts), dtype=np.int32), 0
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        while len(at):
            to = v.base.take(state) + self.text.take(at + depth)
            live = np.flatnonzero(v.parent.take(to) == state)
            at, state = at.take(live), to.take(live)
            depth += 1
            end = v.ends.take(state)
            hit = np.flatnonzero(end >= 0)
            found.append((at.take(hit), np.full(len(hit), depth, dtype=np.int32), end.take(hit)))
            more = np.flatnonzero(at + depth < stop.take(at))
            at, state = at.take(more), state.take(more)
        lead = self.text[starts]
        width = np.minimum(1 + (lead >= 0xC0).astype(np.int32) + (lead >= 0xE0) + (lead >= 0xF0), stop[starts] - starts)
        known = np.zeros(len(self.text), dtype=bool)
        spans = np.zeros(len(self.text), dtype=np.int32)
        spans[starts] = width
        for a, n, _ in found:
            if len(a):
                known[a[spans[a] == n]] = True
        rare = starts[~known[starts]]
        for n in range(1, 5):
            some = rare[spans[rare] == n]
            found.append((some, np.full(len(some), n, dtype=np.int32), np.full(len(some), -1, dtype=np.int32)))
        found.sort(key=lambda f: f[1][0] if len(f[1]) else 0)
        return tuple(np.concatenate([f[k] for f in found]) for k in range(3))

    def _conditional(self, w: np.ndarray, dst: np.ndarray, word: np.ndarray, size: np.ndarray, nodes: int) -> np.ndarray:
        """Log-probability of each edge given the node it ends in, from the sums over all paths to each node."""
        owner = word[self.place]
        depth = dst - self.first_node[owner]
        total = np.zeros(nodes)
        total[self.first_node] = 1.0
        # Each path of a word covers its bytes once: a factor for each byte keeps sums near 1 and cancels out.
        factor = np.exp(w + 2.0 * self.length)
        short = np.flatnonzero(size[owner] <= SHORT_WORD)
        order = short[np.argsort(depth[short].astype(np.uint16), kind="stable")]
        cuts = np.flatnonzero(np.r_[True, depth[order][1:] != depth[order][:-1]]) if len(order) else np.zeros(0, dtype=int)
        # Edges into one node stand together, so that each node's sum is one segment.
        src, factor, node = self.src[order], factor[order], dst[order]
        new = np.r_[True, node[1:] != node[:-1]]
        for s, e in zip(cuts, np.r_[cuts[1:], len(order)], strict=False):
            starts = np.flatnonzero(new[s:e])
            total[node[s:e][starts]] = np.add.reduceat(total[src[s:e]] * factor[s:e], starts)
        log_total = np.log(np.maximum(total, TINY))
        extra = 2.0 * self.length
        # Longer words may leave the range of floats: all of them go forward in step, node by node, in logarithms.
        long = np.flatnonzero(size[owner] > SHORT_WORD)
        if len(long):
            log_total[np.repeat(size > SHORT_WORD, size + 1)] = -np.inf
            log_total[self.first_node[size > SHORT_WORD]] = 0.0
            order = long[np.lexsort((dst[long], depth[long]))]
            step, node = depth[order], dst[order]
            new = np.r_[True, node[1:] != node[:-1]]
            group = np.flatnonzero(new)
            cuts = np.searchsorted(step[group], np.unique(step))
            for s, e in zip(cuts, np.r_[cuts[1:], len(group)], strict=True):
                first = group[s]
                g = order[first : group[e] if e < len(group) else len(order)]
                x = log_total[self.src[g]] + w[g] + extra[g]
                starts = group[s:e] - first
                most = np.maximum.reduceat(x, starts)
                times = np.diff(np.r_[starts, len(x)])
                log_total[node[group[s:e]]] = most + np.log(np.add.reduceat(np.exp(x - np.repeat(most, times)), starts))
        return np.minimum(0.0, log_total[self.src] + w + extra - log_total[dst])

    def append(self, more: Lattices) -> None:
        """Put the words of ``more`` behind these."""
        shift = {"first_node": len(self.is_first) - 1, "last_node": len(self.is_first) - 1, "src": len(self.is_first) - 1, "place": len(self.text), "first_edge": len(self.piece)}
        self.is_first = self.is_first[:-1]
        for name in ("text", "first_node", "last_node", "place", "length", "piece", "src", "first_edge", "is_first", "log_p", "other", "upto"):
            old, new = getattr(self, name), getattr(more, name)
            n = len(old) + len(new)
            if len(self.room.get(name, ())) < n:
                # Doubled, so that few arrays are left behind on the way.
                self.room[name] = np.empty(max(n, 2 * len(old)), dtype=old.dtype)
                self.room[name][: len(old)] = old
            np.add(new, new.dtype.type(shift.get(name, 0)), out=self.room[name][len(old) : n])
            setattr(self, name, self.room[name][:n])

    def walk(self, nodes: np.ndarray, seeds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(edges, offsets) of random paths back from the nodes to their words' starts, one for each seed."""
        chain = np.flatnonzero(~self.is_first[nodes])
        at, got, step = nodes[chain], [], 0
        lengths = np.zeros(len(nodes), dtype=np.int64)
        while len(chain):
            r = uniform(seeds[chain] + np.uint64(step * 0xD1342543DE82EF95 % (1 << 64)))
            edge = self.first_edge.take(at)
            wait = np.flatnonzero(self.upto.take(edge) <= r)
            while len(wait):
                edge[wait] += 1
                wait = wait[self.upto.take(edge[wait]) <= r[wait]]
            got.append((chain, edge))
            lengths[chain] += 1
            at = self.src.take(edge)
            on = np.flatnonzero(~self.is_first.take(at))
            chain, at, step = chain.take(on), at.take(on), step + 1
        offsets = np.cumsum(lengths) - lengths
        out = np.zeros(int(lengths.sum()), dtype=np.int32)
        for k, (chain, edge) in enumerate(got):
            out[offsets[chain] + k] = edge
        return out, np.r_[offsets, len(out)]

    def ids(self, edges: np.ndarray, v: Vocabulary) -> np.ndarray:
        """Piece ids along an edge list; spelt characters become their bytes' ids.

        A walk lists a word's edges from its end, so callers pass them in reading order.
        """
        piece = self.piece.take(edges)
        spelt = np.flatnonzero(piece < 0)
        if not len(spelt):
            return piece
        place, times = self.place[edges[spelt]], self.length[edges[spelt]]
        more = np.cumsum(times - 1)
        if more[-1]:
            each = np.ones(len(piece), dtype=np.int64)
            each[spelt] = times
            piece = np.repeat(piece, each)
            within = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
            spelt = np.repeat(spelt + more - (times - 1), times) + within
            place = np.repeat(place, times) + within
        piece[spelt] = v.byte_id[self.text[place]]
        return piece


def uniform(h: np.ndarray) -> np.ndarray:
    """Numbers in (0, 1) from 64-bit counters."""
    h = h * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(30)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return ((h >> np.uint64(12)).astype(np.float64) + 0.5) * 2.0**-52


def _seed(*parts: int) -> int:
    h = SEED
    for p in parts:
        h = ((h ^ (p & 0xFFFFFFFFFFFFFFFF)) * 0x9E3779B97F4A7C15 + 0x7F4A7C15) & 0xFFFFFFFFFFFFFFFF
        h ^= h >> 29
    return h


def _truncated(mass: float, bound: float, u: float) -> float:
    """Largest perturbed value among paths of total log-probability ``mass``, known to be at most ``bound``."""
    return min(bound, mass - float(np.log(np.exp(min(700.0, mass - bound)) - np.log(u))))


def _chance(seed: int) -> float:
    """``uniform`` of one number."""
    h = seed * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF
    h = (h ^ h >> 30) * 0xBF58476D1CE4E5B9 & 0xFFFFFFFFFFFFFFFF
    h = (h ^ h >> 27) * 0x94D049BB133111EB & 0xFFFFFFFFFFFFFFFF
    return ((h ^ h >> 31) >> 12) * 2.0**-52 + 2.0**-53


class Drawn:
    """One drawn path and the parts of the path space that leave it from ``start`` on.

    ``value`` is the largest perturbed value in all its parts: a Gumbel of their total probability,
    truncated at ``bound``. Which part holds it does not depend on the value and is drawn when the
    part is opened, each with its share of the total.
    """

    def __init__(self, lat: Lattices, edges: np.ndarray, word_of: np.ndarray, start: int, bound: float, seed: int):
        self.edges, self.word_of, self.start = edges, word_of, start
        log_p = lat.log_p.take(edges)
        upto = np.cumsum(log_p)
        self.log_prob = float(upto[-1])
        self.before = upto - log_p
        self.mass = np.exp(self.before[start:]) * lat.other.take(edges[start:]).astype(np.float64)
        self.value = self._largest(bound, seed)
        #: For parts opened before: the edges that are excluded there.
        self.excluded: dict[int, list[int]] = {}

    def _largest(self, bound: float, seed: int) -> float:
        total = float(self.mass.sum())
        if total <= 0:
            return -np.inf
        return _truncated(float(np.log(total)), bound, _chance(seed))

    def part(self, u: float) -> int:
        """The place of the part that holds the largest value."""
        upto = np.cumsum(self.mass)
        return self.start + min(int(np.searchsorted(upto, u * upto[-1], side="right")), int(np.flatnonzero(self.mass)[-1]))

    def shrink(self, at: int, mass: float, bound: float, seed: int) -> None:
        """A part gives up what was opened; what is left lies below the opened value."""
        self.mass[at - self.start] = mass
        self.value = self._largest(bound, seed)

    def in_reading_order(self) -> np.ndarray:
        """The edges with each word's turned around, as walks begin at a word's end."""
        n = len(self.edges)
        inner = np.flatnonzero(self.word_of[1:] != self.word_of[:-1]) + 1
        bounds = np.concatenate(([0], inner, [n]))
        return self.edges[np.repeat(bounds[:-1] + bounds[1:] - 1, np.diff(bounds)) - np.arange(n)]


def _open_part(lat: Lattices, paths: list[Drawn], key: int) -> tuple[Drawn, int, int, float] | None:
    """(path, place, edge, value): where the part with the largest perturbed value leaves a drawn path, and by which edge."""
    p = max(paths, key=lambda x: x.value)
    value, draw = p.value, len(paths)
    if np.isneginf(value):
        return None
    at = p.part(_chance(_seed(key, draw, 3)))
    gone = p.excluded.setdefault(at, [int(p.edges[at])])
    old = int(p.edges[at])
    a = int(lat.first_edge[lat.src[old] + lat.length[old]])
    others = []
    while True:  # the edges of a node stand together, the last closed by 2.0
        if a not in gone:
            others.append(a)
        if lat.upto[a] == 2.0:
            break
        a += 1
    chances = np.exp(lat.log_p[others])
    r = _chance(_seed(key, draw, 4)) * chances.sum()
    k = min(len(others) - 1, int(np.searchsorted(np.cumsum(chances), r)))
    edge = others[k]
    gone.append(edge)
    left = float(np.delete(chances, k).sum())
    p.shrink(at, float(np.exp(p.before[at])) * left, value, _seed(key, draw, 5))
    return p, at, edge, value


STRIDE = np.uint64(0xA0761D6478BD642F)


def _draw_more(lat: Lattices, every: list[list[Drawn]], ends: list[np.ndarray], keys: list[int], samples: int) -> None:
    """Give each text its next draws; the rests of all texts' new paths are walked at once."""
    for draw in range(1, samples):
        opened, nodes, seeds = [], [], []
        for t, paths in enumerate(every):
            if len(paths) != draw or (part := _open_part(lat, paths, keys[t])) is None:
                continue
            # The rest of the word from where the new edge begins, and all words after it, are drawn afresh.
            w = int(part[0].word_of[part[1]])
            opened.append((t, w, part))
            nodes.append(np.r_[lat.src[part[2]], ends[t][w + 1 :]])
            seeds.append(np.uint64(_seed(keys[t], draw)) + np.arange(w, len(ends[t]), dtype=np.uint64) * STRIDE)
        if not opened:
            return
        fresh, offsets = lat.walk(np.concatenate(nodes), np.concatenate(seeds))
        sizes = np.diff(offsets)
        first = 0
        for t, w, (p, at, edge, value) in opened:
            n = len(ends[t]) - w
            edges = np.concatenate([p.edges[:at], np.array([edge], dtype=np.int32), fresh[offsets[first] : offsets[first + n]]])
            word_of = np.concatenate([p.word_of[:at], np.array([w], dtype=np.int32), np.repeat(np.arange(w, len(ends[t]), dtype=np.int32), sizes[first : first + n])])
            every[t].append(Drawn(lat, edges, word_of, at + 1, value, _seed(keys[t], draw, 2)))
            first += n


class Numbered(dict):
    """Numbers of the different words of some texts, in order of first sight.

    A word after one space is kept without it; other words are kept with all their spaces, as U+2581.
    """

    def __missing__(self, word: str) -> int:
        n = self[word] = len(self)
        return n

    def of_text(self, text: str) -> list[int]:
        if not text:
            return []
        parts = text.split(" ")
        if "" in parts or SPACE in text:
            parts = WORD.findall(SPACE + text.replace(" ", SPACE))
        return list(map(self.__getitem__, parts))

    def spelt(self, start: int = 0, stop: int | None = None) -> list[bytes]:
        one = SPACE.encode()
        # No word holds a space, so all are encoded at once.
        return [w if w.startswith(one) else one + w for w in " ".join(islice(self, start, stop)).encode().split(b" ")]


class Words:
    """The different words of the texts so far, and their lattices."""

    def __init__(self, v: Vocabulary):
        self.v, self.index = v, Numbered()
        self.lat: Lattices | None = None

    def of_texts(self, texts: list[str]) -> list[list[int]]:
        if len(self.index) > HELD_WORDS:
            self.index, self.lat = Numbered(), None
        known = len(self.index)
        words = [self.index.of_text(t) for t in texts]
        for start in range(known, len(self.index), NEW_WORDS):
            new = Lattices(self.index.spelt(start, start + NEW_WORDS), self.v)
            if self.lat is None:
                self.lat = new
            else:
                self.lat.append(new)
        return words


def draw_batch(texts: list[str], keys: list[int], v: Vocabulary, samples: int = SAMPLES, seen: Words | None = None) -> list[list[tuple[np.ndarray, float, float]]]:
    """For each text its draws in order: (piece ids, log-probability, log of the chance of inclusion).

    ``seen`` hands on the lattices of earlier texts' words; it changes no draw.
    """
    seen = seen or Words(v)
    words = seen.of_texts(texts)
    if not any(words):
        return [[(np.zeros(0, dtype=np.int32), 0.0, 0.0)] for _ in texts]
    lat = seen.lat
    flat = lat.last_node[np.array([w for some in words for w in some], dtype=np.int64)]
    counts = np.array([len(some) for some in words])
    first = np.cumsum(counts) - counts
    base = np.array([_seed(k, 0) for k in keys], dtype=np.uint64)
    within = np.arange(len(flat), dtype=np.uint64) - np.repeat(first, counts).astype(np.uint64)
    edges, offsets = lat.walk(flat, np.repeat(base, counts) + within * STRIDE)
    word_of = np.repeat(within.astype(np.int32), np.diff(offsets))
    every: list[list[Drawn]] = []
    ends = [flat[s : s + n] for s, n in zip(first.tolist(), counts.tolist(), strict=True)]
    for key, s, n in zip(keys, first.tolist(), counts.tolist(), strict=True):
        a, b = offsets[s], offsets[s + n]
        value = float(-np.log(-np.log(_chance(_seed(key, 9)))))
        every.append([Drawn(lat, edges[a:b], word_of[a:b], 0, value, _seed(key, 0, 2))] if n else [])
    _draw_more(lat, every, ends, keys, samples)
    out = []
    for paths in every:
        if not paths:
            out.append([(np.zeros(0, dtype=np.int32), 0.0, 0.0)])
            continue
        threshold = max(p.value for p in paths)
        draws = []
        for p in paths:
            x = p.log_prob - threshold
            chance = x if x < -30 else float(np.log(-np.expm1(-np.exp(min(x, 700.0)))))
            draws.append((lat.ids(p.in_reading_order(), v), p.log_prob, chance))
        out.append(draws)
    return out


def decode_all(ids: np.ndarray, counts: np.ndarray, v: Vocabulary) -> list[str]:
    """The texts of piece ids, ``counts`` of them for each: the pieces' bytes, without the space put before the first word."""
    sizes = v.spelt[ids]
    ends = np.cumsum(sizes, dtype=np.int64)
    at = np.repeat(v.begin[ids] - (ends - sizes), sizes)
    at += np.arange(len(at))
    raw = v.spelling[at].tobytes()
    bounds = np.r_[0, ends][np.r_[0, np.cumsum(counts)]].tolist()
    parts = [raw[s:e] for s, e in zip(bounds[:-1], bounds[1:], strict=True)]
    return [(x[1:] if x[:1] == b" " else x).decode("utf-8", "replace") for x in parts]


def decode(ids: np.ndarray, v: Vocabulary) -> str:
    """The text of one text's piece ids."""
    return decode_all(ids, np.array([len(ids)]), v)[0]


def encode_samples(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", samples: int = SAMPLES, vocabulary: str = VOCABULARY) -> DataFrame:
    """(id, draw, ids, log_prob, log_inclusion): ``samples`` distinct segmentations of every whole text.

    Texts with fewer segmentations give all they have.
    """
    docs.sparkSession.sparkContext.addFile(vocabulary)
    name = vocabulary.rsplit("/", 1)[-1]

    def drawn(rows: list[tuple[int | None, str]], seen: Words) -> pa.RecordBatch:
        every = draw_batch([t for _, t in rows], [k or 0 for k, _ in rows], seen.v, samples, seen)
        flat = [(k, d + 1, *x) for (k, _), draws in zip(rows, every, strict=True) for d, x in enumerate(draws)]
        types = (pa.int64(), pa.int32(), pa.list_(pa.int32()), pa.float64(), pa.float64())
        return pa.RecordBatch.from_arrays([pa.array([r[c] for r in flat], t) for c, t in enumerate(types)], names=["id", "draw", "ids", "log_prob", "log_inclusion"])

    def run(batches):
        seen = Words(_vocabulary(SparkFiles.get(name)))
        for b in batches:
            held: list[tuple[int | None, str]] = []
            size = 0
            for start in range(0, b.num_rows, SLICE_ROWS):
                part = b.slice(start, SLICE_ROWS)
                for key, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    if text is None:
                        continue
                    if held and size + len(text) > BATCH_CHARS:
                        yield drawn(held, seen)
                        held, size = [], 0
                    held.append((key, text))
                    size += len(text)
            if held:
                yield drawn(held, seen)

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "id long, draw int, ids array<int>, log_prob double, log_inclusion double")


def decode_ids(encoded: DataFrame, ids_col: str = "ids", vocabulary: str = VOCABULARY, keep: tuple[str, ...] = ("id", "draw")) -> DataFrame:
    """The columns ``keep`` with ``text``, decoded from piece ids; null ids give null text."""
    encoded.sparkSession.sparkContext.addFile(vocabulary)
    name = vocabulary.rsplit("/", 1)[-1]

    def run(batches):
        v = _vocabulary(SparkFiles.get(name))
        for b in batches:
            for start in range(0, b.num_rows, SLICE_ROWS // 4):
                part = b.slice(start, SLICE_ROWS // 4)
                ids = part.column(1)
                texts = pa.array(decode_all(ids.flatten().to_numpy(), ids.value_lengths().fill_null(0).to_numpy(), v), pa.string())
                texts = pa.compute.if_else(ids.is_valid(), texts, None)
                yield pa.RecordBatch.from_arrays([part.column(0), texts], names=["_row", "text"])

    packed = encoded.select(F.struct(*keep).alias("_row"), F.col(ids_col).alias("_ids"))
    return packed.mapInArrow(run, packed.select("_row", F.lit("").alias("text")).schema).select("_row.*", "text")
