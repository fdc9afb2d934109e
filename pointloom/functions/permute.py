"""A keyed permutation of 0..n-1 by formula: a shuffle without sorting, in both directions.

A number is a pair (left, right) below (a, b), a and b about the square root of n. Rounds add a keyed hash of one half to the
other, so each can be undone; a result of n or more is permuted again until it is below n (cycle walking). a * b exceeds n by
less than a, so few numbers walk. Keys are a seed and a number of each row, such as its epoch.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.pandas.functions import pandas_udf

ROUNDS = 4
MASK = (1 << 31) - 1


def _mixed(x: np.ndarray, key: np.ndarray) -> np.ndarray:
    """A hash below 2 ** 31; products stay below 2 ** 62."""
    x = (x + key) & MASK
    x = x * 1103515245 + 12345 & MASK
    x ^= x >> 15
    x = x * 1664525 + 1013904223 & MASK
    return x ^ x >> 13


def halves(n: int) -> tuple[int, int]:
    a = max(1, math.isqrt(n - 1) + 1) if n > 0 else 1
    return a, max(1, (n + a - 1) // a)


def _once(x: np.ndarray, key: np.ndarray, a: int, b: int, back: bool) -> np.ndarray:
    left, right = x // b, x % b
    for k in reversed(range(ROUNDS)) if back else range(ROUNDS):
        here = key + 7919 * k
        if back:
            right = (right - _mixed(left, here + 1)) % b
            left = (left - _mixed(right, here)) % a
        else:
            left = (left + _mixed(right, here)) % a
            right = (right + _mixed(left, here + 1)) % b
    return left * b + right


def permuted(x: np.ndarray, key: np.ndarray, n: int, back: bool = False) -> np.ndarray:
    """Where each x of 0..n-1 goes under its key; back: where it comes from."""
    a, b = halves(n)
    x, key = np.array(x, np.int64), np.asarray(key, np.int64)
    if len(x) and (x.min() < 0 or x.max() >= n):
        raise ValueError(f"not all numbers are in 0..{n - 1}")
    todo = np.arange(len(x))
    while len(todo):
        x[todo] = _once(x[todo], key[todo], a, b, back)
        todo = todo[x[todo] >= n]
    return x


def place(slot: Column, epoch: Column, n: int, seed: int = 0, back: bool = False) -> Column:
    """The view in a slot of an epoch, 0..n-1; back: the slot of a view. NULL for NULL."""

    @pandas_udf("long")
    def run(x: pd.Series, e: pd.Series) -> pd.Series:
        known = x.notna() & e.notna()
        out = pd.Series(pd.NA, x.index, "Int64")
        out[known] = permuted(x[known].to_numpy(np.int64), key_of(e[known].to_numpy(np.int64), seed), n, back)
        return out

    return run(slot.cast("long"), epoch.cast("long"))


def key_of(epoch: np.ndarray, seed: int) -> np.ndarray:
    return (epoch * 104729 + seed * 15485863) & MASK


def sql(n: str, epochs: str, seed: int) -> str:
    """DuckDB CTEs (of WITH RECURSIVE) that give perm(epoch, slot, view); n: a query for the number, epochs: one for epoch."""

    def mixed(x: str, key: str) -> str:
        first = f"((({x}) + ({key})) & {MASK}) * 1103515245 + 12345 & {MASK}"
        second = f"xor(({first}), ({first}) >> 15) * 1664525 + 1013904223 & {MASK}"
        return f"xor(({second}), ({second}) >> 13)"

    steps, columns = [], "epoch, slot, key, a, b, n"
    for k in range(ROUNDS):
        steps.append(f"l{k} AS (SELECT {columns}, (l + {mixed('r', f'key + {7919 * k}')}) % a AS l, r FROM {f'r{k - 1}' if k else 'dom'})")
        steps.append(f"r{k} AS (SELECT {columns}, l, (r + {mixed('l', f'key + {7919 * k + 1}')}) % b AS r FROM l{k})")
    return f"""size AS (SELECT n::BIGINT AS n, ceil(sqrt(n))::BIGINT AS a FROM ({n}) t(n)),
dom AS (SELECT epoch, u.x AS slot, (epoch * 104729 + {seed * 15485863}) & {MASK} AS key, a, (n + a - 1) // a AS b, n, u.x // ((n + a - 1) // a) AS l, u.x % ((n + a - 1) // a) AS r
  FROM (SELECT *, unnest(range(a * ((n + a - 1) // a))) AS x FROM size) u, ({epochs}) e(epoch)),
{", ".join(steps)},
once AS (SELECT epoch, slot, l * b + r AS view, n FROM r{ROUNDS - 1}),
walk AS (SELECT epoch, slot, view, n FROM once WHERE slot < n UNION ALL SELECT w.epoch, w.slot, o.view, w.n FROM walk w JOIN once o ON o.epoch = w.epoch AND o.slot = w.view WHERE w.view >= w.n),
perm AS (SELECT epoch, slot, view FROM walk WHERE view < n)"""
