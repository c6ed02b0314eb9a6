"""Suffix arrays by induced sorting, and permuted common prefixes, of one shard of byte strings."""

import numpy as np

#: Below so many symbols of the alphabet, whole buckets are induced at once.
SMALL = 512


def _types(t: np.ndarray) -> np.ndarray:
    """True where a suffix is smaller than the next (S), False where larger (L). t ends with its only, least symbol."""
    n = len(t)
    step = np.sign(np.diff(t.astype(np.int64)))
    at = np.where(step != 0, np.arange(n - 1), n - 1)
    follows = np.minimum.accumulate(at[::-1])[::-1]
    return np.append(np.append(step, 1)[follows] > 0, True)


def _names(t: np.ndarray, s: np.ndarray, lms: np.ndarray) -> tuple[np.ndarray, int]:
    """The rank of each leftmost-smaller substring, and how many differ. Symbols are compared with their types, which
    makes the substrings free of prefixes; some symbols of all of them at a time, then of those that are still equal."""
    symbol = t.astype(np.int64) * 2 + s
    bits = int(symbol.max()).bit_length() + 1
    per = max(1, 62 // bits)
    symbol = np.append(symbol + 1, np.zeros(per, np.int64)) if bits < 62 else symbol
    ends = np.append(lms[1:], len(t) - 1)
    rank, live, at = np.zeros(len(lms), np.int64), np.arange(len(lms)), lms.copy()
    while len(live):
        key = np.zeros(len(live), np.int64)
        for k in range(per):
            key = key << bits | np.where(at + k <= ends[live], symbol[np.minimum(at + k, len(symbol) - 1)], 0)
        order = np.lexsort((key, rank[live]))
        r, k = rank[live][order], key[order]
        group = np.append(True, r[1:] != r[:-1])
        new = group | np.append(True, k[1:] != k[:-1])
        place = np.arange(len(r))
        rank[live[order]] = r + np.maximum.accumulate(np.where(new, place, 0)) - np.maximum.accumulate(np.where(group, place, 0))
        twin = np.zeros(len(r), bool)
        twin[1:] = ~new[1:]
        twin[:-1] |= ~new[1:]
        more = np.zeros(len(live), bool)
        more[order] = twin
        more &= at + per <= ends[live]
        live, at = live[more], at[more] + per
    kinds, out = np.unique(rank, return_inverse=True)
    return out, len(kinds)


def _induce_buckets(t: np.ndarray, s: np.ndarray, sorted_lms: np.ndarray) -> np.ndarray:
    """Linear: each suffix is placed once by its successor, a bucket of equal first symbols at a time."""
    n, size = len(t), int(t.max()) + 1
    count = np.bincount(t, minlength=size)
    large = np.bincount(t[~s], minlength=size)
    head = np.cumsum(count) - count
    sa = np.empty(n, np.int64)
    seeds = np.split(sorted_lms, np.cumsum(np.bincount(t[sorted_lms], minlength=size))[:-1])

    def place(found: np.ndarray, to: np.ndarray, back: bool) -> None:
        symbols = t[found]
        order = np.argsort(symbols, kind="stable")
        got = np.bincount(symbols, minlength=size)
        within = np.arange(len(found)) - np.repeat(np.cumsum(got) - got, got)
        at = to[symbols[order]]
        sa[at - within if back else at + within] = found[order]
        to += -got if back else got

    to = head.copy()
    for c in range(size):
        done = head[c]
        while done < to[c]:
            wave, done = sa[done : to[c]] - 1, to[c]
            place(wave[(wave >= 0) & ~s[wave]], to, False)
        wave = seeds[c] - 1
        place(wave[(wave >= 0) & ~s[wave]], to, False)
    to = head + count - 1
    for c in range(size - 1, -1, -1):
        done = head[c] + count[c] - 1
        while done > to[c]:
            wave, done = sa[to[c] + 1 : done + 1][::-1] - 1, to[c]
            place(wave[(wave >= 0) & s[wave]], to, True)
        if large[c]:
            wave = sa[head[c] : head[c] + large[c]][::-1] - 1
            place(wave[(wave >= 0) & s[wave]], to, True)
        if c == 0:
            sa[0] = n - 1
    return sa


def _induce_each(t: np.ndarray, s: np.ndarray, sorted_lms: np.ndarray) -> np.ndarray:
    """The same for a large alphabet, suffix by suffix."""
    n, count = len(t), np.bincount(t)
    first = np.cumsum(count) - count
    last = (first + count - 1).tolist()
    sa = [-1] * n
    symbol = t.tolist()
    to = last.copy()
    for i in sorted_lms[::-1].tolist():
        c = symbol[i]
        sa[to[c]] = i
        to[c] -= 1
    # for each suffix the symbol before it if that begins a larger (then: a smaller) one, else -1; so too for no suffix, -1
    leads = np.append(np.append(-1, np.where(s[:-1], -1, t[:-1])), -1).tolist()
    to = first.tolist()
    for i in sa:
        c = leads[i]
        if c >= 0:
            sa[to[c]] = i - 1
            to[c] += 1
    leads = np.append(np.append(-1, np.where(s[:-1], t[:-1], -1)), -1).tolist()
    to = last
    for i in reversed(sa):
        c = leads[i]
        if c >= 0:
            sa[to[c]] = i - 1
            to[c] -= 1
    sa[0] = n - 1
    return np.array(sa)


def suffix_array(t: np.ndarray) -> np.ndarray:
    """t: integers from 0, of which the last is 0 and no other is."""
    if len(t) < 3:
        return np.arange(len(t))[::-1].copy()
    s = _types(t)
    lms = np.flatnonzero(s[1:] & ~s[:-1]) + 1
    names, kinds = _names(t, s, lms)
    ranked = np.argsort(names) if kinds == len(lms) else suffix_array(names)
    return (_induce_buckets if int(t.max()) < SMALL else _induce_each)(t, s, lms[ranked])


def common_prefixes(t: np.ndarray, sa: np.ndarray, fresh: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """For each position of t (bytes) the suffix before it in sa, and their common prefix, in order of position.

    Where the symbols before both are equal, the prefix is that of the position before less one; elsewhere, and at
    fresh positions, it is compared, up to most. It is exact up to most less the distance from the last fresh position.
    """
    n = len(t)
    before = np.empty(n, np.int64)
    before[sa[1:]], before[sa[0]] = sa[:-1], -1
    at = np.arange(n)
    derived = (before > 0) & (at > 0) & ~fresh
    derived &= t[at - 1] == t[before - 1]
    derived[1:] &= before[1:] == before[:-1] + 1
    own = np.flatnonzero(~derived)
    value = np.zeros(n, np.int64)
    padded = np.append(t, np.zeros(16, np.uint8))
    words = np.zeros(n + 8, np.uint64)
    for k in range(8):
        words |= padded[k : k + n + 8].astype(np.uint64) << np.uint64(8 * k)
    live = own[before[own] >= 0]
    done = 0
    while len(live) and done < most:
        x = words[np.minimum(live + done, n + 7)] ^ words[np.minimum(before[live] + done, n + 7)]
        same = x == 0
        end = live[~same]
        low = x[~same] & (~x[~same] + np.uint64(1))
        value[end] = done + (np.log2(low.astype(np.float64)).astype(np.int64) >> 3)
        live = live[same]
        done += 8
    value[live] = done
    last = np.maximum.accumulate(np.where(derived, 0, at))
    return before, value[last] - (at - last)
