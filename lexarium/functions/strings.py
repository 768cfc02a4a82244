"""What the operators that finish within a row compute in Python: ranks, rounding and likeness."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator, Sequence
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import regex

_CLUSTER = regex.compile(r"\X")
_CAPITALISED = regex.compile(r"(?s)\p{Uppercase}(?:\p{M}*|.*\p{Lowercase}.*)")
_NUMBER = regex.compile(r"[+-]?(?:inf|infinity|nan|(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:e[+-]?[0-9]+)?)", regex.I | regex.A)


def graphemes(text: str) -> Sequence[str]:
    """The characters that a reader sees."""
    return text if text.isascii() else _CLUSTER.findall(text)


def is_number(word: str) -> bool:
    """Whether the word reads as a decimal literal, inf or nan."""
    return _NUMBER.fullmatch(word) is not None


def is_upper(word: str) -> bool:
    return word.upper() == word and len(graphemes(word)) > 1


def is_capitalised(word: str) -> bool:
    return _CAPITALISED.fullmatch(word) is not None


def rounded(values: np.ndarray, digits: int = 6) -> np.ndarray:
    """Half away from zero by the shortest decimal form, as Spark's round()."""
    scale = 10.0**digits
    scaled = values * scale
    out = np.rint(scaled) / scale
    part = np.abs(scaled - np.trunc(scaled))
    for k in np.flatnonzero(np.abs(part - 0.5) < 1e-3):
        if np.isfinite(values[k]):
            out[k] = float(Decimal(repr(float(values[k]))).quantize(Decimal(1).scaleb(-digits), ROUND_HALF_UP))
    return out


def in_order(keys: list[str], scores: np.ndarray) -> Iterator[int]:
    """Places by score, downwards, then by key; equal scores are sorted only when they are reached."""
    order = np.argsort(-scores, kind="stable")
    ends = np.append(np.flatnonzero(np.diff(scores[order])) + 1, len(order))
    at = 0
    for end in ends.tolist():
        yield from sorted(order[at:end].tolist(), key=keys.__getitem__)
        at = end


def distance_within(a: Sequence[str], b: Sequence[str], most: int) -> int | None:
    """The edit distance of two sequences, or None where it is above ``most``; only the band that can matter is filled."""
    while a and b and a[0] == b[0]:
        a, b = a[1:], b[1:]
    while a and b and a[-1] == b[-1]:
        a, b = a[:-1], b[:-1]
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > most:
        return None
    if not a:
        return len(b)
    spare = sum((Counter(b) - Counter(a)).values())  # each edit brings in one of b's characters at most
    if spare > most:
        return None
    far = most + 1
    row = [k if k <= most else far for k in range(len(b) + 1)]
    for i, x in enumerate(a, 1):
        low, high = max(1, i - most), min(len(b), i + most)
        before, row[low - 1] = row[low - 1], i if low == 1 else far
        for j in range(low, high + 1):
            above = row[j] if j < i + most else far
            row[j], before = min(before + (x != b[j - 1]), above + 1, row[j - 1] + 1), above
        if high < len(b):
            row[high + 1] = far
        if min(row[low - 1 : high + 1]) > most:
            return None
    return row[len(b)] if row[len(b)] <= most else None


def alike(a: Sequence[str], b: Sequence[str], threshold: float) -> bool:
    """Whether 1 - distance / length of the longer one reaches the threshold; two empty strings are not alike."""
    longest = max(len(a), len(b))
    if not longest:
        return False
    most = min(longest, int((1 - threshold) * longest) + 1)
    while most >= 0 and 1 - most / longest < threshold:
        most -= 1
    return most >= 0 and distance_within(a, b, most) is not None


def best(keys: list[str], scores: np.ndarray, n: int, digits: int = 6) -> tuple[list[str], list[float], Iterable[int]]:
    """The n best keys by rounded score, then by key; their scores and ranks from 1."""
    if n < 0:
        raise ValueError("n must be 0 or more")
    values = rounded(scores, digits)
    taken = [k for k, _ in zip(in_order(keys, values), range(n))]
    return [keys[k] for k in taken], values[taken].tolist(), range(1, len(taken) + 1)
