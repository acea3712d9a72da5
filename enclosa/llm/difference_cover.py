"""Suffix arrays by the difference cover modulo 3 (Karkkainen and Sanders, 2003), vectorised."""

from __future__ import annotations

import numpy as np

#: Three symbols or ranks are packed into one 64-bit key.
BITS = 21
LONGEST = (1 << BITS) - 2


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Starts of the suffixes of ``text`` (values 1 to LONGEST, length up to LONGEST) in lexicographic order."""
    n = len(text)
    if n > LONGEST:
        raise ValueError(f"a text of {n} symbols is longer than {LONGEST}")
    if n < 4:
        return np.array(sorted(range(n), key=lambda i: text[i:].tolist()), np.int64)
    t = np.zeros(n + 3, np.int64)
    t[:n] = text
    pair = (t[:-1] << BITS) | t[1:]

    # The sample: suffixes that start at 1 and 2 modulo 3.  Where the first class would
    # end at the end of the text, the empty suffix closes it.
    ones = np.arange(1, n + (n % 3 == 1), 3)
    twos = np.arange(2, n, 3)
    sample = np.concatenate([ones, twos])
    triples = (pair[sample] << BITS) | np.append(t, 0)[sample + 2]
    order = np.argsort(triples)
    fresh = np.ones(len(order), bool)
    fresh[1:] = triples[order[1:]] != triples[order[:-1]]
    names = np.empty(len(order), np.int64)
    names[order] = np.cumsum(fresh)
    if not fresh.all():
        order = suffix_array(names)
    rank = np.zeros(n + 3, np.int64)
    rank[sample[order]] = np.arange(1, len(order) + 1)

    # The rest, by first symbol and the rank behind it.
    rest = np.arange(0, n, 3)
    rest = rest[np.argsort((t[rest] << BITS) | rank[rest + 1])]

    # Merge: a rest suffix is compared with 1 mod 3 over one symbol and with 2 mod 3 over two.
    sample = sample[order]
    sample = sample[sample < n]
    first, second = sample[sample % 3 == 1], sample[sample % 3 == 2]
    before = np.searchsorted((t[first] << BITS) | rank[first + 1], (t[rest] << BITS) | rank[rest + 1])
    before += np.searchsorted((pair[second] << BITS) | rank[second + 2], (pair[rest] << BITS) | rank[np.minimum(rest + 2, n + 2)])
    place = before + np.arange(len(rest))
    out = np.empty(n, np.int64)
    free = np.ones(n, bool)
    free[place] = False
    out[place] = rest
    out[free] = sample
    return out


def equal_prefixes(text: np.ndarray, starts: np.ndarray, length: int) -> np.ndarray:
    """For each start, a number that equals another's where ``length`` symbols from them are the same.

    Neighbours in the suffix array are compared over their prefixes.  ``text``
    holds bytes; a start must leave ``length`` of them.
    """
    at = np.full(len(text), -1, np.int64)
    at[starts] = np.arange(len(starts))
    order = at[suffix_array(text.astype(np.int64) + 1)]
    order = order[order >= 0]
    seen = np.lib.stride_tricks.sliding_window_view(text, length)
    fresh = np.ones(len(order), bool)
    for lo in range(1, len(order), 65536):
        some = seen[starts[order[lo - 1 : lo + 65536]]]
        fresh[lo : lo + len(some) - 1] = (some[1:] != some[:-1]).any(1)
    out = np.empty(len(starts), np.int64)
    out[order] = np.cumsum(fresh)
    return out
