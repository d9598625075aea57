"""Jaro-Winkler similarity over Arrow batches; Spark has no built-in for it."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

PREFIX_WEIGHT = 0.1
PREFIX_LENGTH = 4


def _codes(values: pd.Series) -> tuple[np.ndarray, np.ndarray]:
    lengths = values.str.len().to_numpy(dtype=np.int64)
    width = max(int(lengths.max(initial=0)), 1)
    table = np.zeros((len(values), width), dtype=np.int32)
    for row, text in enumerate(values):
        table[row, : len(text)] = [ord(char) for char in text]
    return table, lengths


def similarity(left: pd.Series, right: pd.Series) -> np.ndarray:
    """Similarity of aligned texts, computed position by position for a whole batch."""
    a, len_a = _codes(left)
    b, len_b = _codes(right)
    rows = np.arange(len(a))
    reach = np.maximum(np.maximum(len_a, len_b) // 2 - 1, 0)
    spots = np.arange(b.shape[1])
    used_a = np.zeros(a.shape, dtype=bool)
    used_b = spots[None, :] >= len_b[:, None]
    padding = used_b.copy()
    for i in range(a.shape[1]):
        open_spots = (b == a[:, i : i + 1]) & ~used_b & (i < len_a)[:, None]
        open_spots &= np.abs(spots[None, :] - i) <= reach[:, None]
        hit = open_spots.any(axis=1)
        used_b[rows[hit], open_spots.argmax(axis=1)[hit]] = True
        used_a[hit, i] = True
    used_b &= ~padding
    common = used_a.sum(axis=1)
    width = min(a.shape[1], b.shape[1])
    in_a = np.take_along_axis(a, np.argsort(~used_a, axis=1, kind="stable"), axis=1)[:, :width]
    in_b = np.take_along_axis(b, np.argsort(~used_b, axis=1, kind="stable"), axis=1)[:, :width]
    swaps = ((in_a != in_b) & (np.arange(width)[None, :] < common[:, None])).sum(axis=1) // 2
    some = np.maximum(common, 1)
    jaro = (common / np.maximum(len_a, 1) + common / np.maximum(len_b, 1) + (common - swaps) / some) / 3
    jaro = np.where(common > 0, jaro, 0.0)
    head = min(PREFIX_LENGTH, width)
    alike = (a[:, :head] == b[:, :head]) & (a[:, :head] != 0)
    prefix = np.cumprod(alike, axis=1).sum(axis=1) if head else 0
    return np.where(jaro > 0.7, jaro + PREFIX_WEIGHT * prefix * (1 - jaro), jaro)


def _batch(left: pd.Series, right: pd.Series) -> pd.Series:
    if len(left) == 0:
        return pd.Series([], dtype="float64")
    return pd.Series(similarity(left, right))


def jaro_winkler(left: Column | str, right: Column | str) -> Column:
    """Similarity of two text columns.

    The function is made anew on each call: one that was used holds a handle of
    the driver, and no module that names it could travel with tasks.
    """
    return F.pandas_udf(_batch, T.DoubleType())(left, right)
