"""Grammars by Re-Pair: of many sequences at once, with numpy (runs inside tasks).

Pairs of neighbouring symbols that occur twice or more become rules. A round replaces every pair that is more frequent
than the pairs it overlaps, so that sequences of any number and length are done in rounds over whole arrays.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Grammar:
    """Rules by number from `terminals` on: the pair each stands for; where it stands first (start, middle, end, as
    places in all sequences' symbols); rule and start of all its places in the derivations. What is left of each
    sequence: symbols, start and end of each, and the sequence it belongs to."""

    terminals: int
    left: np.ndarray
    right: np.ndarray
    first: np.ndarray
    rule: np.ndarray
    at: np.ndarray
    symbols: np.ndarray
    start: np.ndarray
    end: np.ndarray
    owner: np.ndarray


def repair(symbols: np.ndarray, owner: np.ndarray, terminals: int, shared: bool) -> Grammar:
    """The grammar of sequences that stand one after another: symbols from 0 to terminals - 1, and the sequence that
    each belongs to, ascending. Pairs are counted over all sequences together if they share rules, else in each."""
    n = len(symbols)
    s, owner, start, end = symbols.astype(np.int64), owner.astype(np.int64), np.arange(n), np.arange(1, n + 1)
    spread = 1 if shared else int(owner[-1]) + 1 if n else 1
    next_id = terminals
    rules, places, left_over = [], [], []
    while len(s):
        inside = np.flatnonzero(owner[:-1] == owner[1:])
        key = s[inside] * next_id + s[inside + 1]
        if not shared:
            key = key * spread + owner[inside]
        kinds, kind, count = np.unique(key, return_inverse=True, return_counts=True)
        rank = np.zeros(len(s) + 1, np.int64)  # of the pair that begins at i, at i + 1; more frequent pairs rank higher
        rank[inside + 1] = np.where(count[kind] > 1, count[kind] * len(kinds) + kind + 1, 0)
        before, own, after = rank[:-2], rank[1:-1], np.r_[rank[2:-1], 0]
        place = np.arange(len(own))
        again = (own == before) & (own > 0)  # a pair of equal symbols, met once more one place on
        since = place - np.maximum.accumulate(np.where(again, 0, place))
        chosen = np.flatnonzero((own > 0) & (since % 2 == 0) & (again | (own > before)) & (own >= after))
        busy = np.zeros(spread if not shared else int(owner[-1]) + 1, bool)
        busy[owner[:-1][own > 0]] = True
        idle = ~busy[owner]
        if idle.any():
            left_over.append((s[idle], start[idle], end[idle], owner[idle]))
        if not len(chosen):
            break
        kind_at = np.full(len(s), -1)
        kind_at[inside] = kind
        made, which = np.unique(kind_at[chosen], return_inverse=True)
        first = chosen[np.unique(which, return_index=True)[1]]
        rules.append((s[first], s[first + 1], np.stack([start[first], start[first + 1], end[first + 1]], axis=1)))
        places.append((next_id - terminals + which, start[chosen]))
        s[chosen], end[chosen] = next_id + which, end[chosen + 1]
        keep = ~idle
        keep[chosen + 1] = False
        s, start, end, owner, next_id = s[keep], start[keep], end[keep], owner[keep], next_id + len(made)
    none = np.zeros(0, np.int64)
    join = lambda parts, k, empty=none: np.concatenate([empty, *[p[k] for p in parts]])
    rest = [join(left_over, k) for k in range(4)]
    order = np.argsort(rest[1], kind="stable")
    return Grammar(terminals, join(rules, 0), join(rules, 1), join(rules, 2, np.zeros((0, 3), np.int64)), join(places, 0), join(places, 1), *[x[order] for x in rest])


def balanced(grammar: Grammar) -> np.ndarray:
    """start, middle, end of nodes that join what is left of each sequence, neighbours by neighbours."""
    start, end, owner, out = grammar.start, grammar.end, grammar.owner, [np.zeros((0, 3), np.int64)]
    while len(start):
        place = np.arange(len(start))
        since = place - np.maximum.accumulate(np.where(np.r_[True, owner[1:] != owner[:-1]], place, 0))
        a = np.flatnonzero((since[:-1] % 2 == 0) & (owner[:-1] == owner[1:]))
        if not len(a):
            break
        out.append(np.stack([start[a], start[a + 1], end[a + 1]], axis=1))
        end = end.copy()
        end[a] = end[a + 1]
        keep = np.ones(len(start), bool)
        keep[a + 1] = False
        start, end, owner = start[keep], end[keep], owner[keep]
    return np.concatenate(out)
