"""Suffix sorting of one shard by bulk induction, with common-prefix tests between neighbours.

Suffixes are split into those smaller than their right neighbour (S), those larger (L) and the
leftmost S of each run (LMS). The LMS suffixes are put in order first, and from them all others are
induced: buckets are visited in character order, each bucket's queue hands over its suffixes in
bulk, and their left neighbours are appended to the queues of their own first characters. The queues
are first-in first-out per character, which is all that induction asks of a priority queue.
"""

from __future__ import annotations

import numpy as np


def suffix_types(text: np.ndarray) -> np.ndarray:
    """True where the suffix is S-type; the last one counts as S."""
    n = len(text)
    step = np.zeros(n, dtype=np.int8)
    step[:-1] = np.sign(text[1:].astype(np.int32) - text[:-1].astype(np.int32))
    step[-1] = 1
    # Runs of equal characters take the type of the first difference after them.
    at = np.where(step != 0, np.arange(n), n)
    following = np.minimum.accumulate(at[::-1])[::-1]
    return step[np.minimum(following, n - 1)] > 0


class Queues:
    """A queue of suffix positions for each first character."""

    def __init__(self, characters: int):
        self.waiting: list[list[np.ndarray]] = [[] for _ in range(characters)]

    def push(self, characters: np.ndarray, positions: np.ndarray) -> None:
        """Append positions to the queues of their characters, keeping their order."""
        order = np.argsort(characters, kind="stable")
        characters, positions = characters[order], positions[order]
        cuts = np.flatnonzero(np.r_[True, characters[1:] != characters[:-1]])
        for s, e in zip(cuts, np.r_[cuts[1:], len(characters)], strict=True):
            self.waiting[characters[s]].append(positions[s:e])

    def take(self, character: int) -> np.ndarray | None:
        held, self.waiting[character] = self.waiting[character], []
        return np.concatenate(held) if held else None


def _induce(text: np.ndarray, small: np.ndarray, seeds: np.ndarray, characters: int, downwards: bool) -> np.ndarray:
    """Positions of one type in order, induced from ``seeds``, the sorted suffixes of the other.

    Upwards L-type suffixes are induced from LMS ones; downwards, S-type ones from L-type ones, in
    descending order.
    """
    queues, out = Queues(characters), []
    first = text[seeds]
    order = np.argsort(first, kind="stable")
    seeds, first = seeds[order], first[order]
    starts = np.searchsorted(first, np.arange(characters + 1))
    steps = range(characters - 1, -1, -1) if downwards else range(characters)

    def hand_on(positions: np.ndarray, own: int) -> None:
        before = positions[positions > 0] - 1
        before = before[small[before] == downwards]
        c = text[before]
        later = before[c != own]
        if len(later):
            queues.push(text[later], later)
        here = before[c == own]
        if len(here):
            queues.waiting[own].append(here)

    for c in steps:
        while (now := queues.take(c)) is not None:
            out.append(now)
            hand_on(now, c)
        if starts[c] < starts[c + 1]:
            block = seeds[starts[c] : starts[c + 1]]
            before = block[block > 0] - 1
            before = before[small[before] == downwards]
            if len(before):
                queues.push(text[before], before)
    return np.concatenate(out) if out else np.zeros(0, dtype=np.int64)


def _sorted_from_lms(text: np.ndarray, small: np.ndarray, lms: np.ndarray, characters: int) -> np.ndarray:
    """All suffixes in order, given LMS suffixes in order (or, in the first pass, by first character)."""
    large = _induce(text, small, lms, characters, downwards=False)
    s_type = _induce(text, small, large[::-1], characters, downwards=True)[::-1]
    # The last suffix has no L-type successor to induce it and stands alone in front.
    last = len(text) - 1
    s_type = np.r_[last, s_type[s_type != last]]
    merged = np.r_[large, s_type]
    # Within a character L-type suffixes stand before S-type ones; both lists are in order already.
    return merged[np.argsort(2 * text[merged] + small[merged], kind="stable")]


def _names_of_lms(text: np.ndarray, small: np.ndarray, is_lms: np.ndarray, lms_in_order: np.ndarray) -> np.ndarray:
    """Rank of each LMS substring (up to and with the next LMS position), equal ones alike."""
    n = len(text)
    lms = np.flatnonzero(is_lms)
    following = np.full(n, n - 1)
    following[lms[:-1]] = lms[1:]
    length = following[lms_in_order] - lms_in_order
    fresh = np.r_[True, length[1:] != length[:-1]]
    asked = np.flatnonzero(~fresh)
    k = 0
    while len(asked):
        a, b = lms_in_order[asked - 1], lms_in_order[asked]
        differ = (text[a + k] != text[b + k]) | (small[a + k] != small[b + k])
        fresh[asked[differ]] = True
        asked = asked[~differ]
        asked = asked[length[asked] > k]
        k += 1
    names = np.zeros(n, dtype=np.int64)
    names[lms_in_order] = np.cumsum(fresh) - 1
    return names[lms]


def _order_of_names(names: np.ndarray) -> np.ndarray:
    """Order of the suffixes of the reduced text: recursive induction, or ranks where names are many."""
    kinds = int(names.max()) + 1
    if kinds == len(names):
        order = np.empty(len(names), dtype=np.int64)
        order[names] = np.arange(len(names))
        return order
    if kinds <= 1024 and len(names) > 64 * kinds:
        return suffix_array(names)
    rank, step = names.copy(), 1
    while True:
        ahead = np.zeros(len(rank), dtype=np.int64)
        ahead[:-step] = rank[step:] + 1
        key = rank * (int(rank.max()) + 2) + ahead
        order = np.argsort(key, kind="stable")
        new = np.empty_like(rank)
        new[order] = np.cumsum(np.r_[0, key[order][1:] != key[order][:-1]])
        rank, step = new, 2 * step
        if rank.max() == len(rank) - 1 or step >= len(rank):
            return np.argsort(rank, kind="stable")


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Suffix array of small non-negative integers; a shorter suffix sorts before its extensions."""
    # A terminator below all others, as induction asks for; it is taken off again.
    text = np.r_[text.astype(np.uint16) + 1, 0].astype(np.uint16)
    n, characters = len(text), int(text.max()) + 1
    if n <= 2:
        return np.arange(n - 1)
    small = suffix_types(text)
    is_lms = small & np.r_[False, ~small[:-1]]
    lms = np.flatnonzero(is_lms)
    rough = _sorted_from_lms(text, small, lms, characters)
    names = _names_of_lms(text, small, is_lms, rough[is_lms[rough]])
    exact = lms[_order_of_names(names)]
    return _sorted_from_lms(text, small, exact, characters)[1:]


def same_prefix(text: np.ndarray, a: np.ndarray, b: np.ndarray, length: int) -> np.ndarray:
    """Whether the ``length`` bytes from a and from b agree, eight at a time, mismatches dropping out."""
    padded = np.r_[text.astype(np.uint8), np.zeros(8, dtype=np.uint8)]
    words = np.lib.stride_tricks.as_strided(padded.view(np.uint8), (len(text), 8), (1, 1))
    words = np.ascontiguousarray(words).view("<u8").ravel()
    same = np.zeros(len(a), dtype=bool)
    left = np.arange(len(a))
    for k in sorted({*range(0, length - 7, 8), length - 8}):
        left = left[words[a[left] + k] == words[b[left] + k]]
    same[left] = True
    return same
