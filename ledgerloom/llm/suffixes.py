"""Suffix arrays by linear grouping, for many short texts at once."""

from __future__ import annotations

import numpy as np


def _ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """All numbers of the ranges, one range after the other."""
    total = int(lengths.sum())
    return np.repeat(starts - (np.cumsum(lengths) - lengths), lengths) + np.arange(total)


def suffix_arrays(text: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Sorted suffixes of texts that lie one after the other: places in `text`, text by text.

    `starts` has the first place of each text; the last character of each is smaller than all its others. Suffixes
    are grouped by their longest Lyndon prefix: first by one character; then, from the highest group down, the suffix
    that precedes a group's member in a lower group (its previous smaller one) is moved up, to a new group right
    above its old one, the more members it precedes the higher. Each group is handled once. In the end the groups
    are in order, and one walk over the result from its smallest suffix on fills every group from the front. The
    texts are independent: each step handles one group, or one suffix, of every text.
    """
    size = len(text)
    ends = np.append(starts[1:], size)
    lane = np.repeat(np.arange(len(starts)), ends - starts)
    sa = np.lexsort((np.arange(size), text, lane))
    isa = np.empty(size, np.int64)
    isa[sa] = np.arange(size)
    fresh = np.ones(size, bool)
    fresh[1:] = (text[sa][1:] != text[sa][:-1]) | (lane[sa][1:] != lane[sa][:-1])
    heads = np.nonzero(fresh)[0]
    head_size = np.zeros(size, np.int64)
    head_size[heads] = np.diff(np.append(heads, size))
    group = np.empty(size, np.int64)
    group[sa] = np.repeat(heads, head_size[heads])
    previous = np.arange(size) - 1
    previous[starts] = -1
    moving = np.zeros(size, bool)
    top = ends.copy()
    floor = starts + 1
    while True:
        # The smallest suffix of a text is alone in its group, and nothing is below it.
        open_lanes = np.nonzero(top > floor)[0]
        if not len(open_lanes):
            break
        high = group[sa[top[open_lanes] - 1]]
        members = sa[_ranges(high, top[open_lanes] - high)]
        top[open_lanes] = high
        # Previous smaller suffixes: pointers of higher groups are final, those of the same group shorten meanwhile.
        waiting = members
        at = previous[waiting]
        while True:
            far = (at >= 0) & (group[at] >= group[waiting])
            if not far.any():
                break
            waiting, at = waiting[far], at[far]
            at = previous[at]
            previous[waiting] = at
        found = previous[members]
        found = found[found >= 0]
        if not len(found):
            continue
        chosen, times = np.unique(found, return_counts=True)
        old = group[chosen]
        order = np.lexsort((times, old))
        chosen, times, old = chosen[order], times[order], old[order]
        first = np.ones(len(old), bool)
        first[1:] = old[1:] != old[:-1]
        at_first = np.nonzero(first)[0]
        homes, counts = old[at_first], np.diff(np.append(at_first, len(old)))
        tails = homes + head_size[homes] - counts
        slots = _ranges(tails, counts)
        moving[chosen] = True
        sitting = sa[slots]
        displaced = sitting[~moving[sitting]]
        vacated = isa[chosen]
        vacated = vacated[vacated < np.repeat(tails, counts)]
        moving[chosen] = False
        sa[vacated] = displaced
        isa[displaced] = vacated
        sa[slots] = chosen
        isa[chosen] = slots
        first[1:] |= times[1:] != times[:-1]
        at_first = np.nonzero(first)[0]
        head_size[homes] -= counts
        new_sizes = np.diff(np.append(at_first, len(old)))
        head_size[slots[at_first]] = new_sizes
        group[chosen] = np.repeat(slots[at_first], new_sizes)
    # Second part: each group's order.
    out = np.full(size, -1, np.int64)
    filled = np.zeros(size, np.int64)
    placed = np.zeros(size, bool)
    last = ends - 1
    out[starts] = last
    placed[last] = True
    by_length = np.argsort(starts - ends, kind="stable")
    lengths = (ends - starts)[by_length]
    begin = starts[by_length]
    left = len(begin)
    for step in range(int(lengths[0]) if len(lengths) else 0):
        while left and lengths[left - 1] <= step:
            left -= 1
        now = out[begin[:left] + step]
        at = now - 1
        at = at[now > begin[:left]]
        while len(at):
            at = at[~placed[at]]
            home = group[at]
            out[home + filled[home]] = at
            filled[home] += 1
            placed[at] = True
            at = previous[at]
            at = at[at >= 0]
    return out
