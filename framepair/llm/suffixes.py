"""Suffix order of a block of text by a difference cover, in numpy.

A set D is a difference cover modulo v if for any two positions i, j there is a
d < v such that i + d and j + d are both cover positions (residues in D). So
once the cover positions (here 8 of every 57) have ranks, any two suffixes that
agree in their first v bytes are compared by two ranks, however long their tie
is. ``cover_ranks`` sorts the cover positions by 64 bytes and then doubles, which
stays inside the cover because v apart is the same residue; ``sort_suffixes``
sorts the wanted suffixes by 64 bytes and resolves what still ties by ranks, with a
quicksort that runs over all tied groups at once.

Segments of the text are apart: no suffix reaches past its segment's end.
"""

from __future__ import annotations

import numpy as np

COVER, V = (0, 1, 3, 13, 32, 36, 43, 52), 57  # a perfect difference set
DEPTH = 8  # words of 8 bytes sorted directly; 8 * 8 >= V
PAD = 64

# MEET[a, b]: least d with a + d and b + d in the cover.
IN_COVER = np.zeros(V, bool)
IN_COVER[list(COVER)] = True
_d = np.arange(V)
MEET = np.array([[int(np.argmax(IN_COVER[(a + _d) % V] & IN_COVER[(b + _d) % V])) for b in range(V)] for a in range(V)])


def laid_out(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Segments one behind the other, zeros between: the bytes, starts and ends."""
    sizes = np.array([len(p) for p in parts], np.int64)
    starts = np.cumsum(sizes + PAD) - (sizes + PAD)
    gap = bytes(PAD)
    data = np.frombuffer(b"".join(x for p in parts for x in (p, gap)), np.uint8)
    return data, starts, starts + sizes


def leading_words(data: np.ndarray) -> np.ndarray:
    """The 8 bytes from every position on as one big-endian number."""
    w = np.concatenate([data, np.zeros(PAD + 8, np.uint8)]).astype(np.uint64)
    for step, shift in ((1, 8), (2, 16), (4, 32)):
        w[:-step] = (w[:-step] << np.uint64(shift)) | w[step:]
    return w


def refine(rank: np.ndarray, active: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Splits groups of equal rank by ``key`` in place; returns the elements that still tie.

    A rank is the place of a group's first element in the order so far.
    """
    if not len(active):
        return active
    order = np.lexsort((key, rank[active]))
    at, ky = active[order], key[order]
    rk = rank[at]
    i = np.arange(len(at))
    group = np.ones(len(at), bool)
    group[1:] = rk[1:] != rk[:-1]
    part = group.copy()
    part[1:] |= ky[1:] != ky[:-1]
    inside = i - np.maximum.accumulate(np.where(group, i, 0))
    first = np.maximum.accumulate(np.where(part, i, 0))
    rank[at] = rk + inside[first]
    alone = part.copy()
    alone[:-1] &= part[1:]
    return at[~alone]


def by_prefix(words: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ranks of the positions ``at`` by their first 64 bytes, and which still tie."""
    rank, active = np.zeros(len(at), np.int64), np.arange(len(at))
    for j in range(DEPTH):
        active = refine(rank, active, words[at[active] + 8 * j])
    return rank, active


def cover_ranks(words: np.ndarray, starts: np.ndarray, ends: np.ndarray, least: int) -> np.ndarray:
    """For every position its rank among the cover positions (-1: not in the cover).

    Equal ranks mean that at least ``least`` bytes agree, or all up to the ends.
    """
    total = int(ends[-1]) if len(ends) else 0
    position = np.arange(total)
    segment = np.searchsorted(starts, position, "right") - 1
    at = position[(position < ends[segment]) & IN_COVER[position % V]]
    end = ends[segment[at]]
    rank, active = by_prefix(words, at)
    where = np.full(total + V, -1, np.int64)
    where[at] = np.arange(len(at))
    reach, step = 8 * DEPTH, V
    while reach < least and len(active):
        ahead = at[active] + step
        key = np.where(ahead < end[active], rank[where[np.minimum(ahead, total - 1)]] + 1, 0)
        active = refine(rank, active, key)
        reach, step = reach + step, 2 * step
    out = np.full(total, -1, np.int64)
    out[at] = rank
    return out


def sort_suffixes(words: np.ndarray, ranks: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Order of the suffixes ``at``; each needs at least V bytes of its segment."""
    rank, active = by_prefix(words, at)
    rng = np.random.default_rng(1)
    while len(active):
        # One pivot for each tied group, all groups in one step.
        group = rank[active]
        order = np.lexsort((rng.random(len(active)), group))
        head = np.ones(len(active), bool)
        head[1:] = group[order][1:] != group[order][:-1]
        pivot = at[active[order][head]][np.cumsum(head) - 1]
        active = active[order]
        here = at[active]
        d = MEET[here % V, pivot % V]
        sign = np.sign(ranks[here + d] - ranks[pivot + d])
        refine(rank, active, sign)
        # What equals its pivot is in place; the others go on where they still tie.
        active = active[sign != 0]
        if len(active):
            _, which, times = np.unique(rank[active], return_inverse=True, return_counts=True)
            active = active[times[which] > 1]
    return np.argsort(rank, kind="stable")
