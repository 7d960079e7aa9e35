"""Kernels for what a window cannot express: penalised smoothing and crop-cycle detection, in numpy, one parcel a group."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame


def solve_banded(bands: list[np.ndarray], rhs: np.ndarray) -> np.ndarray:
    """x of A x = rhs for a symmetric positive matrix with A[i, i - k] = bands[k][i]: by its square-root-free Cholesky
    factors, in time in proportion to the length."""
    n, width = len(rhs), len(bands) - 1
    low, d, x = np.zeros((n, width + 1)), np.zeros(n), np.asarray(rhs, float).copy()
    for i in range(n):
        for k in range(min(width, i), 0, -1):
            j = i - k
            part = sum(low[i, i - t] * d[t] * low[j, j - t] for t in range(max(0, i - width), j))
            low[i, k] = (bands[k][i] - part) / d[j]
        d[i] = bands[0][i] - sum(low[i, k] ** 2 * d[i - k] for k in range(1, min(width, i) + 1))
        x[i] -= sum(low[i, k] * x[i - k] for k in range(1, min(width, i) + 1))
    x /= d
    for i in range(n - 1, -1, -1):
        x[i] -= sum(low[i + k, k] * x[i + k] for k in range(1, min(width, n - 1 - i) + 1))
    return x


def _penalty(n: int, order: int) -> list[np.ndarray]:
    """The bands of D'D, D being the differences of the order."""
    row = np.array([1.0])
    for _ in range(order):
        row = np.convolve(row, [-1.0, 1.0])
    bands = [np.zeros(n) for _ in range(order + 1)]
    for start in range(n - order):
        for k in range(order + 1):
            bands[k][start + k : start + order + 1] += row[k:] * row[: order + 1 - k]
    return bands


def whittaker(y: np.ndarray, weight: np.ndarray, smooth: float = 8.0, order: int = 2) -> np.ndarray:
    """Penalised least squares on differences of the order; values of no weight are filled. With fewer values than the
    order, or too short a series, their mean; with none zeros."""
    y, weight = np.nan_to_num(np.asarray(y, float)), np.asarray(weight, float)
    n = len(y)
    if not (weight > 0).any():
        return np.zeros(n)
    if n <= order + 1 or (weight > 0).sum() < order:
        return np.full(n, np.average(y, weights=weight))
    bands = [smooth * b for b in _penalty(n, order)]
    bands[0] = bands[0] + weight
    return solve_banded(bands, weight * y)


def upper_envelope(y: np.ndarray, weight: np.ndarray, smooth: float = 8.0, passes: int = 2, below: float = 0.35) -> np.ndarray:
    """Smoothed again with what lies under the curve weighing less; null where fewer than three values have weight."""
    weight = np.asarray(weight, float)
    if (weight > 0).sum() < 3:
        return np.full(len(y), np.nan)
    curve = whittaker(y, weight, smooth)
    for _ in range(passes):
        curve = whittaker(y, np.where(np.nan_to_num(np.asarray(y, float)) < curve, weight * below, weight), smooth)
    return curve


def find_cycles(curve: np.ndarray, floor: float = 0.3, rise: float = 0.1, least: int = 3) -> list[tuple[int, int, int]]:
    """(start, peak, end) of the humps of a curve: peaks over the floor, each between its valleys, that rise enough and
    last long enough. Of two peaks with no valley of that depth between them the higher stays."""
    n = len(curve)
    tops = [i for i in range(n) if curve[i] >= floor and (i == 0 or curve[i] >= curve[i - 1]) and (i == n - 1 or curve[i] > curve[i + 1])]
    kept: list[int] = []
    for i in tops:
        if kept and min(curve[kept[-1]], curve[i]) - curve[kept[-1] : i + 1].min() < rise:
            if curve[i] > curve[kept[-1]]:
                kept[-1] = i
        else:
            kept.append(i)
    out = []
    for k, i in enumerate(kept):
        low = kept[k - 1] if k else 0
        high = kept[k + 1] if k + 1 < len(kept) else n - 1
        start, end = low + int(np.argmin(curve[low : i + 1])), i + int(np.argmin(curve[i : high + 1]))
        if curve[i] - min(curve[start], curve[end]) >= rise and end - start >= least:
            out.append((start, i, end))
    return out


def smoothed(df: DataFrame, keys: Sequence[str], order: str, value: str, smooth: float = 8.0, envelope: bool = False) -> DataFrame:
    """keys, order, value and `smoothed` of every row. A group is one parcel's series."""
    kinds = dict(df.dtypes)
    fields = ", ".join(f"{c} {kinds[c]}" for c in [*keys, order, value])

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(order)
        y = group[value].to_numpy(float)
        weight = np.isfinite(y).astype(float)
        return group.assign(smoothed=(upper_envelope if envelope else whittaker)(y, weight, smooth))

    return df.select(*keys, order, value).groupBy(*keys).applyInPandas(run, f"{fields}, smoothed double")


def cycles(df: DataFrame, keys: Sequence[str], order: str, value: str, smooth: float = 1.0) -> DataFrame:
    """A row a detected cycle: keys, number, places of start, peak and end in the order, and the peak's smoothed value."""
    kinds = dict(df.dtypes)
    fields = ", ".join(f"{c} {kinds[c]}" for c in keys)
    columns = [*keys, "cycle", "start", "peak", "end", "peak_value"]

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(order)
        y = group[value].to_numpy(float)
        curve = whittaker(y, np.isfinite(y).astype(float), smooth)
        at = group[order].to_numpy()
        own = [group[k].iloc[0] for k in keys]
        rows = [[*own, k, int(at[a]), int(at[b]), int(at[c]), float(curve[b])] for k, (a, b, c) in enumerate(find_cycles(curve))]
        return pd.DataFrame(rows, columns=columns)

    return df.select(*keys, order, value).groupBy(*keys).applyInPandas(run, f"{fields}, cycle int, start int, peak int, end int, peak_value double")
