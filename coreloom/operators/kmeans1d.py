"""Exact k-means in one dimension by dynamic programming over sorted values.

With prefix sums the cost of an interval is O(1); row j of the table is the minimum over
split points of row j-1 plus an interval cost, a matrix whose rows' minima move right, so
each row is filled by divide and conquer in O(n log n)."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame


def solve(values: np.ndarray, k: int) -> tuple[float, np.ndarray]:
    """(cost, label of each value, from 0 for the smallest)."""
    order = np.argsort(values, kind="stable")
    x = np.asarray(values, np.float64)[order]
    n = len(x)
    if not n:
        return 0.0, np.zeros(0, np.int64)
    k = min(k, n)
    shift = x - x.mean()
    s, q = np.concatenate([[0.0], np.cumsum(shift)]), np.concatenate([[0.0], np.cumsum(shift * shift)])

    def cost(i, j):  # of values i..j-1
        d = s[j] - s[i]
        return np.maximum(0.0, q[j] - q[i] - d * d / (j - i))

    best = np.array([0.0, *cost(0, np.arange(1, n + 1))])
    splits = []
    for level in range(2, k + 1):
        row, arg = np.full(n + 1, np.inf), np.zeros(n + 1, np.int64)
        todo = [(level, n, level - 1, n - 1)]
        while todo:
            a, b, low, high = todo.pop()
            if a > b:
                continue
            mid = (a + b) // 2
            i = np.arange(low, min(mid - 1, high) + 1)
            c = best[i] + cost(i, mid)
            j = int(c.argmin())
            row[mid], arg[mid] = c[j], i[j]
            todo += [(a, mid - 1, low, int(i[j])), (mid + 1, b, int(i[j]), high)]
        splits.append(arg)
        best = row
    label, end = np.zeros(n, np.int64), n
    for level in range(k - 1, 0, -1):
        start = int(splits[level - 1][end])
        label[start:end] = level
        end = start
    out = np.empty(n, np.int64)
    out[order] = label
    return float(best[n]), out


def kmeans_1d(rows: DataFrame, keys: list[str], value: str, k: str, item: str = "id") -> DataFrame:
    """keys..., item, value, label, cost: exact 1-D k-means in each group; ``k`` is a column
    with the group's number of clusters. A group is one ray's points."""
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    schema = ", ".join(f"{c} {kinds[c]}" for c in [*keys, item, value]) + ", label long, cost double"

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        cost, label = solve(pdf[value].to_numpy(), int(pdf[k].iloc[0]))
        return pdf[[*keys, item, value]].assign(label=label, cost=cost)

    return rows.select(*keys, item, value, k).groupBy(*keys).applyInPandas(run, schema)
