"""Part-enumeration signatures for set similarity joins.

Two sets of a and b members with Jaccard similarity of at least P/100 differ in
at most (100 - P) (a + b) / (100 + P) members. Set sizes fall into bands; each
band divides the domain of members (64-bit hashes) into ``parts`` ranges. A
member in which two sets differ spoils one range at most, so similar sets agree
in all but that many ranges. Of the subsets of one range each, a set of size s
enumerates as signatures the d + 1 that come first in one order common to all
sets, where d is the most in which it can differ from a partner: by counting,
two similar sets then share a signature. The order puts ranges with many members first,
so signatures are rare and empty ranges come last.

A set at the low end of its band also signs for the band below, where smaller
partners are.
"""

from __future__ import annotations

import numpy as np

from farelake.llm.shingles import scramble

BAND_GROWTH = 2.5
FIRST_BAND = 8


def band_tops(largest: int) -> list[int]:
    """Largest sizes of the bands up to the one that holds ``largest``."""
    tops = [FIRST_BAND]
    while tops[-1] < largest:
        tops.append(int(tops[-1] * BAND_GROWTH))
    return tops


def parts_of(top: int) -> int:
    return max(int(0.4 * top), top // 3) + 3


def signatures(members: np.ndarray, percent: int = 75) -> np.ndarray:
    """Signatures of a set given as sorted distinct 64-bit hashes; none where only equal sets can be similar."""
    s = len(members)
    if s == 0:
        return members
    largest_partner = 100 * s // percent
    tops = band_tops(s)
    out = []
    own = len(tops) - 1
    for band in (own, own - 1):
        if band < 0:
            break
        top = tops[band]
        if band < own and -(-percent * s // 100) > top:
            break
        partner = largest_partner if band == own else top
        differ = (100 - percent) * (s + partner) // (100 + percent)
        if differ == 0:
            continue
        parts = np.uint64(parts_of(top))
        part = ((members >> np.uint64(32)) * parts) >> np.uint64(32)
        first = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
        count = np.diff(np.concatenate([first, [s]]))
        content = np.add.reduceat(scramble(members + np.uint64(band)), first)
        sign = scramble(content + scramble(part[first] + np.uint64(band << 40)))
        wanted = differ + 1
        if len(first) < wanted:
            empty = np.setdiff1d(np.arange(int(parts), dtype=np.uint64), part[first])
            blank = np.sort(scramble(scramble(empty + np.uint64((band << 40) | (1 << 39)))))
            out.append(np.concatenate([sign, blank[:wanted - len(first)]]))
        else:
            order = np.lexsort((sign, -count))
            out.append(sign[order[:wanted]])
    return np.concatenate(out) if out else members[:0]
