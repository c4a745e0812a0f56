"""Predicates over the tokens around a token, as higher-order Column functions.

Positions count from 0.  A window of radius ``r`` around ``i`` holds the tokens
``i - r`` to ``i + r``, ``i`` itself included, as far as there are any.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is computed once however often ``body`` uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def starts_with_any(token: Column, prefixes: Iterable[str]) -> Column:
    prefixes = list(prefixes)
    return token.startswith(prefixes[0]) if len(prefixes) == 1 else token.rlike("^(?:" + "|".join(map(re.escape, prefixes)) + ")")


def window(tokens: Column, i: Column, r: int) -> Column:
    first = F.greatest(i - r, F.lit(0))
    return F.slice(tokens, first + 1, i + r + 1 - first)


def places(tokens: Column, test) -> Column:
    """Positions of the tokens that meet ``test``."""
    marked = F.transform(tokens, lambda t, i: F.when(test(t), i))
    return F.array_compact(marked)


def prefix_places(tokens: Column, prefixes: Iterable[str]) -> Column:
    prefixes = tuple(prefixes)
    return places(tokens, lambda t: starts_with_any(t, prefixes))


def exact_places(tokens: Column, words: Iterable[str]) -> Column:
    words = list(words)
    return places(tokens, lambda t: t.isin(words))


def pair_places(tokens: Column, first: Iterable[str], second: Iterable[str], gap: int = 2) -> Column:
    """Positions of a token of ``first`` followed within ``gap`` tokens by one of ``second`` (prefixes)."""
    first, second = tuple(first), tuple(second)
    marked = F.transform(tokens, lambda t, i: F.when(starts_with_any(t, first) & F.exists(F.slice(tokens, i + 2, F.lit(gap)), lambda u: starts_with_any(u, second)), i))
    return F.array_compact(marked)


def near_prefix(tokens: Column, i: Column, r: int, prefixes: Iterable[str]) -> Column:
    prefixes = tuple(prefixes)
    return F.exists(window(tokens, i, r), lambda t: starts_with_any(t, prefixes))


def near_exact(tokens: Column, i: Column, r: int, words: Iterable[str]) -> Column:
    return F.arrays_overlap(window(tokens, i, r), F.array(*map(F.lit, words)))


def close(a: Column, b: Column, most: int) -> Column:
    """Whether some position of ``a`` and some of ``b`` are at most ``most`` apart."""
    return F.exists(a, lambda i: F.exists(b, lambda j: F.abs(i - j) <= most))


def labels_near(tokens: Column, positions: Column, r: int, labels: dict[str, str], skip: Iterable[str] = ()) -> Column:
    """Sorted distinct labels of all tokens within ``r`` of any of the positions; tokens that begin with one of ``skip`` have none."""
    skip = tuple(skip)

    def label(t: Column) -> Column:
        name = label_of(t, labels)
        return F.when(~starts_with_any(t, skip), name) if skip else name

    found = F.flatten(F.transform(positions, lambda i: F.transform(window(tokens, i, r), label)))
    return F.array_sort(F.array_distinct(F.array_compact(found)))


def label_of(token: Column, labels: dict[str, str]) -> Column:
    """The label of the first key the token begins with, in the dictionary's order; null if there is none."""
    out = None
    for prefix, name in labels.items():
        out = F.when(token.startswith(prefix), name) if out is None else out.when(token.startswith(prefix), name)
    return out


def first_label(tokens: Column, i: Column, r: int, labels: dict[str, str]) -> Column:
    """The label of the first token in the window that begins with a key of ``labels``; null if none does.

    For a token with several keys the first of the dictionary's order counts.
    """

    def label(t: Column) -> Column:
        return label_of(t, labels)

    return F.get(F.array_compact(F.transform(window(tokens, i, r), label)), F.lit(0))
