"""A weighted similarity of short strings, 0 to 100, as a small vectorised helper."""

from __future__ import annotations

from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pandas as pd


def _common(a: str, b: str) -> int:
    """Length of the longest common subsequence, with one bit per letter of ``a``."""
    places: dict[str, int] = {}
    for i, c in enumerate(a):
        places[c] = places.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    rows = full
    for c in b:
        met = rows & places.get(c, 0)
        rows = ((rows + met) | (rows - met)) & full
    return len(a) - rows.bit_count()


def ratio(a: str, b: str) -> float:
    """Twice the common subsequence over both lengths, in percent."""
    return 200.0 * _common(a, b) / (len(a) + len(b)) if a and b else 0.0


def partial_ratio(a: str, b: str) -> float:
    """The best ratio of the shorter string to a stretch of the longer that is at most as long."""
    short, long = sorted((a, b), key=len)
    n, best = len(short), 0.0
    for i in range(1 - n, len(long)):
        best = max(best, ratio(short, long[max(i, 0) : i + n]))
        if best == 100.0:
            break
    return best


def _split(a: str, b: str) -> tuple[str, str, str]:
    x, y = set(a.split()), set(b.split())
    return tuple(" ".join(sorted(z)) for z in (x & y, x - y, y - x))


def _sorted(s: str) -> str:
    return " ".join(sorted(s.split()))


def token_ratio(a: str, b: str) -> float:
    """The better of the ratio of sorted words and of the ratio that sets common words apart."""
    both, only_a, only_b = _split(a, b)
    if both and not (only_a and only_b):
        return 100.0
    with_a, with_b = f"{both} {only_a}".strip(), f"{both} {only_b}".strip()
    apart = max(ratio(with_a, with_b), ratio(both, with_a), ratio(both, with_b))
    return max(apart, ratio(_sorted(a), _sorted(b)))


def partial_token_ratio(a: str, b: str) -> float:
    """As ``token_ratio`` on stretches; a common word makes it 100."""
    both, only_a, only_b = _split(a, b)
    return 100.0 if both else max(partial_ratio(_sorted(a), _sorted(b)), partial_ratio(only_a, only_b))


def weighted_ratio(a: str, b: str) -> float:
    """The best of the ratios, those on stretches and words at a discount that depends on the lengths."""
    if not a or not b:
        return 0.0
    gap = max(len(a), len(b)) / min(len(a), len(b))
    if gap < 1.5:
        return max(ratio(a, b), 0.95 * token_ratio(a, b))
    scale = 0.9 if gap <= 8 else 0.6
    return max(ratio(a, b), scale * partial_ratio(a, b), 0.95 * scale * partial_token_ratio(a, b))


#: Letters of a name up to which it is found by what is left without one of them.
LEAVE_ONE = 100


class Names:
    """Names in their order with what bounds their scores: how often each has each letter, and which have which words."""

    def __init__(self, names: list[tuple[int, str, str]]):
        self.names = sorted(names)
        self.column = {c: k for k, c in enumerate(sorted(set("".join(n for _, n, _ in self.names))))}
        self.letters = np.zeros((len(self.names), len(self.column)), np.int16)
        self.sizes = np.array([len(n) for _, n, _ in self.names], np.int32)
        self.repeats = np.zeros(len(self.names), bool)
        self.with_word: dict[str, list[int]] = {}
        for i, (_, norm, _) in enumerate(self.names):
            np.add.at(self.letters[i], [self.column[c] for c in norm], 1)
            words = norm.split()
            self.repeats[i] = len(set(words)) < len(words)
            for w in set(words):
                self.with_word.setdefault(w, []).append(i)
        self.several = any(" " in n for _, n, _ in self.names)
        self.places = {n: i for i, (_, n, _) in enumerate(self.names)}

    def _letters(self, slot: str) -> np.ndarray:
        """How often a slot has each letter of the names."""
        own = np.zeros(len(self.column), np.int16)
        np.add.at(own, [self.column[c] for c in slot if c in self.column], 1)
        return own

    def bounds(self, slot: str) -> np.ndarray:
        """For each name a score that ``weighted_ratio`` cannot exceed: a common subsequence has common letters only.

        A common word, or a word that a string repeats, may lift the score to 100.
        """
        own, words = self._letters(slot), slot.split()
        common = np.minimum(self.letters, own).sum(axis=1)
        short, long = np.minimum(self.sizes, len(slot)), np.maximum(self.sizes, len(slot))
        gap = long / np.maximum(short, 1)
        out = 200 * common / np.maximum(self.sizes + len(slot), 1)
        part = np.where(gap <= 8, 0.9, 0.6) * 200 * common / np.maximum(short + common, 1)
        out = np.where(gap < 1.5, out, np.maximum(out, part))
        if len(set(words)) < len(words):
            out[:] = 100
        for w in set(words):
            out[self.with_word.get(w, [])] = 100
        out[self.repeats] = 100
        return out + 1e-9

    def best(self, slot: str, least: float = 0.0, most_gap: int | None = None) -> tuple[float, int, str, str]:
        """The name of the highest score that is at least ``least``, the first of equals; score 0 and blanks if there is none.

        With ``most_gap`` there is none either if the lengths of slot and name differ by more. Then names of such lengths are tried first, as
        without one of them there is nothing to find among the others.
        """
        none = (0.0, -1, "", "")
        if most_gap is None:
            return self._best(slot, least, self.bounds(slot), none)
        fit = np.abs(self.sizes - len(slot)) <= most_gap
        if not fit.any():
            return none
        bounds = self.bounds(slot)
        found = self._best(slot, least, np.where(fit, bounds, -1.0), none)
        if found[0]:
            found = self._best(slot, least, np.where(fit, -1.0, bounds), found)
        return found if abs(len(found[2]) - len(slot)) <= most_gap else none

    def _best(self, slot: str, least: float, bounds: np.ndarray, found: tuple[float, int, str, str]) -> tuple[float, int, str, str]:
        """``found``, or a better one of the names that have a bound."""
        for i in np.argsort(-bounds, kind="stable"):
            if bounds[i] < max(found[0], least):
                break
            order, norm, name = self.names[i]
            score = weighted_ratio(slot, norm)
            if score >= least and score > 0 and (score, -order) > (found[0], -found[1]):
                found = (score, order, norm, name)
        return found


    @cached_property
    def _left(self) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of what is left of each name of up to ``LEAVE_ONE`` letters without one of them, sorted, and whose they are."""
        own = [i for i, (_, n, _) in enumerate(self.names) if len(n) <= LEAVE_ONE]
        of = np.repeat(np.array(own, np.int32), self.sizes[own])
        keys = np.fromiter((hash(n[:k] + n[k + 1 :]) for n in (self.names[i][1] for i in own) for k in range(len(n))), np.int64, len(of))
        order = np.argsort(keys, kind="stable")
        return keys[order], of[order]

    def _without_one(self, kept: set[str]) -> set[int]:
        keys, of = self._left
        wanted = np.fromiter(map(hash, kept), np.int64, len(kept))
        ends = zip(np.searchsorted(keys, wanted), np.searchsorted(keys, wanted, "right"), strict=True)
        return {int(i) for a, b in ends for i in of[a:b]}

    def closest(self, slot: str) -> tuple[float, int, str, str] | None:
        """The best name, if one letter left out of the slot, of the name or of each makes them equal and no other name can be as good; else None.

        Its ratio is over 90, which stretches do not reach, and over 95 if there are names of several words, as these may score 95 in another order.
        """
        a, out = len(slot), None
        if not 2 < a < LEAVE_ONE or " " in slot:
            return None
        kept = {slot[:k] + slot[k + 1 :] for k in range(a)}
        found = {self.places[x] for x in (slot, *kept) if x in self.places} | {i for i in self._without_one({slot}) if self.sizes[i] == a + 1}
        others = 200.0 * a / (2 * a + 2)
        if not found:
            own, longer = self._letters(slot), np.flatnonzero(self.sizes == a + 2)
            if (np.minimum(self.letters[longer], own).sum(axis=1) >= a).any():
                return None  # a name that has all letters and two more would be better
            found, others = self._without_one(kept), max(200.0 * (a - 2) / (2 * a - 2), 200.0 * a / (2 * a + 3))
        if found:
            score, order, i = min((-ratio(slot, self.names[i][1]), self.names[i][0], i) for i in found)
            if -score > max(others, 95.0 if self.several else 90.0):
                out = (-score, order, *self.names[i][1:])
        return out


def best_matches(names: list[tuple[int, str, str]], least: float = 0.0, most_gap: int | None = None):
    """A function for ``mapInPandas``: each ``slot`` with its best of ``names`` (order, normal form, name)."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = Names(names)
        for frame in frames:
            rows = [known.best(s, least, most_gap) for s in frame["slot"]]
            yield pd.DataFrame(rows, columns=["score", "name_order", "city_norm", "city"]).assign(slot=frame["slot"].to_numpy())

    return run
