"""Matching a misspelt name against a list of known names, for one name at a time.

`operators.resolve` does the same for a whole column of names.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterable
from dataclasses import dataclass
from difflib import SequenceMatcher

import numpy as np

# Least similarity of a close match, and how many close matches are looked at.
SIMILARITY = 0.75
CLOSE_MATCHES = 3

_CHARACTER_SLOTS = 64


class NoMatch(ValueError):
    """No candidate resembles the name."""


class AmbiguousMatch(ValueError):
    """Several candidates resemble the name."""


@dataclass(frozen=True)
class NameMatch:
    match: str | None
    method: str
    n_candidates: int


# Blanks and commas do not count when names are compared.
_UNCOUNTED = str.maketrans("", "", " ,")


def fold(name: str) -> str:
    return name.translate(_UNCOUNTED).lower()


class KnownNames:
    """Candidates by folded name, in order, so that all with one beginning lie next to each other."""

    def __init__(self, candidates: Iterable[str]):
        self.original = {fold(candidate): candidate for candidate in candidates}
        self.folded = sorted(self.original)

    def beginning(self, query: str) -> list[str]:
        """Up to two folded names that begin with the query: more than one is as good as many."""
        place = bisect.bisect_left(self.folded, query)
        return [name for name in self.folded[place : place + 2] if name.startswith(query)]


def _letters(text: str) -> np.ndarray:
    return np.bincount([ord(c) % _CHARACTER_SLOTS for c in text] or [0], minlength=_CHARACTER_SLOTS)[
        :_CHARACTER_SLOTS
    ] * bool(text)


def close_among(query: str, candidates: Iterable[str]) -> list[str]:
    """The first CLOSE_MATCHES candidates whose similarity to the query reaches the threshold."""
    matcher = SequenceMatcher()
    matcher.set_seq2(query)
    close = []
    for candidate in candidates:
        matcher.set_seq1(candidate)
        if matcher.ratio() >= SIMILARITY:
            close.append(candidate)
            if len(close) == CLOSE_MATCHES:
                break
    return close


class CloseNames:
    """Similarity and substring search over folded candidate names.

    Names with the same letters in another order have the same bound, so it is computed once for each set of letters.
    """

    def __init__(self, folded: list[str]):
        self.folded = folded
        by_letters: dict[bytes, list[str]] = {}
        for name in folded:
            by_letters.setdefault(_letters(name).astype(np.int32).tobytes(), []).append(name)
        groups = sorted(by_letters.items(), key=lambda group: len(group[1][0]))
        self._groups = [names for _, names in groups]
        self._lengths = np.array([len(names[0]) for names in self._groups], dtype=np.int64)
        self._letters = np.frombuffer(b"".join(letters for letters, _ in groups), np.int32).reshape(
            len(groups), _CHARACTER_SLOTS
        )

    def similar(self, query: str) -> list[str]:
        """Candidates whose similarity to the query reaches the threshold.

        Stops at CLOSE_MATCHES: from the second on, the name is ambiguous whatever else there is.
        """
        # Of two similar names, the shorter one has three fifths of the longer one's length at least.
        start = np.searchsorted(self._lengths, -(-3 * len(query) // 5))
        end = np.searchsorted(self._lengths, 5 * len(query) // 3, "right")
        total = self._lengths[start:end] + len(query)
        # Shared letters bound the ratio from above, so nothing that qualifies is lost here.
        shared = np.minimum(self._letters[start:end], _letters(query)).sum(axis=1)
        bound = 2.0 * shared / np.maximum(total, 1)
        possible = np.flatnonzero(bound >= SIMILARITY - 1e-9)
        possible = possible[np.argsort(-bound[possible], kind="stable")] + start
        return close_among(query, (name for at in possible for name in self._groups[at]))

    def containing(self, query: str) -> list[str]:
        return [name for name in self.folded if query in name]


def match_name(query: str, candidates: Iterable[str]) -> NameMatch:
    """Exact, then unique prefix, then one close match, then one substring match."""
    known, wanted = KnownNames(candidates), fold(query)
    begun = known.beginning(wanted)
    if begun and begun[0] == wanted:  # the shortest of all that begin so
        method, count, pick = "exact", 1, wanted
    elif len(begun) == 1:
        method, count, pick = "prefix", 1, begun[0]
    else:
        index = CloseNames(list(known.original))
        close, held = index.similar(wanted), index.containing(wanted)
        method, count, pick = settle(len(close), len(held), close, held)
    return NameMatch(known.original.get(pick), method, count)


def settle(
    n_close: int, n_held: int, close: list[str], held: list[str]
) -> tuple[str, int, str | None]:
    """Decide between close and substring matches: (method, candidates, folded name).

    Close matches speak first; names that hold the query are asked only if nothing is close.
    """
    method, count, found = ("similar", min(n_close, CLOSE_MATCHES), close) if n_close else ("substring", n_held, held)
    if count == 0:
        return "none", 0, None
    return (method, 1, found[0]) if count == 1 else ("ambiguous", count, None)


def resolve_name(query: str, candidates: Iterable[str]) -> str:
    """The one candidate meant by `query`; raises when there is none or more than one."""
    candidates = list(candidates)
    found = match_name(query, candidates)
    if found.match is not None:
        return found.match
    listed = ", ".join(candidates)
    if found.method == "none":
        raise NoMatch(f"Nothing resembles {query!r} among: {listed}")
    raise AmbiguousMatch(f"{query!r} could be {found.n_candidates} of: {listed}")
