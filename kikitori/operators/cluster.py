"""Clustering of embeddings: exact average linkage of all vectors, or of each block, in linear memory."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kikitori.functions.arrays import l2_normalize

def usable(df: DataFrame, vector: str) -> DataFrame:
    """Unit vectors; those with NaN, infinities or zero norm are dropped."""
    return df.withColumn(vector, l2_normalize(F.col(vector))).where(F.col(vector).isNotNull())


def average_linkage(x: np.ndarray, threshold: float | None = None, count: int | None = None) -> np.ndarray:
    """Flat labels 0..k-1, by first member, of UPGMA over cosine distance, cut at ``threshold`` or at ``count`` clusters.

    Nearest pairs are merged until the smallest average distance exceeds the threshold: heights never fall, so that is the
    cut of the whole tree. Rows are re-averaged by the Lance-Williams rule; O(n^2) memory."""
    n = len(x)
    d = 1.0 - x @ x.T
    np.fill_diagonal(d, np.inf)
    size, label = np.ones(n), np.arange(n)
    live = n
    while live > max(1, count or 1):
        i, j = np.unravel_index(np.argmin(d), d.shape)
        if threshold is not None and d[i, j] > threshold:
            break
        i, j = min(i, j), max(i, j)
        row = (d[i] * size[i] + d[j] * size[j]) / (size[i] + size[j])
        d[i], d[:, i] = row, row
        d[i, i] = np.inf
        d[j], d[:, j] = np.inf, np.inf
        size[i] += size[j]
        label[label == j] = i
        live -= 1
    _, first = np.unique(label, return_index=True)
    order = {label[k]: rank for rank, k in enumerate(sorted(first))}
    return np.array([order[v] for v in label], dtype=np.int32)


def linkage_below(x: np.ndarray, threshold: float) -> np.ndarray:
    """The labels of ``average_linkage`` at ``threshold`` in linear memory: the mean cosine distance of two clusters of unit
    vectors is 1 - dot(sum_a, sum_b) / (n_a * n_b), so a cluster is a sum and a count. Chains of nearest neighbours end in
    pairs nearest to each other. Merging never brings clusters closer to a third one, so such pairs may merge in any order,
    and a pair above the threshold takes part in no merge below it: both are final."""
    n = len(x)
    total, size, label = x.astype(np.float64), np.ones(n), np.arange(n)
    live = np.arange(n)  # rows of total that are still open clusters
    where = np.arange(n)  # cluster to its place in live
    dense, count = total.copy(), size.copy()  # of live, in its order
    m, chain = n, []

    def close(c: int) -> None:
        nonlocal m
        at, last = where[c], m - 1
        live[at], dense[at], count[at] = live[last], dense[last], count[last]
        where[live[at]] = at
        m = last

    while m:
        if not chain:
            chain.append(int(live[0]))
        a = chain[-1]
        if m == 1:
            break
        at = where[a]
        near = (dense[:m] @ total[a]) / (count[:m] * size[a])
        near[at] = -np.inf
        best = int(np.argmax(near))
        if len(chain) > 1 and near[where[chain[-2]]] >= near[best] - 1e-12:  # ties go back, so every chain ends
            best = int(where[chain[-2]])
        b = int(live[best])
        if len(chain) < 2 or b != chain[-2]:
            chain.append(b)
            continue
        del chain[-2:]
        if 1.0 - near[best] > threshold:
            close(a), close(b)
            continue
        a, b = min(a, b), max(a, b)
        total[a] += total[b]
        size[a] += size[b]
        label[b] = a
        close(b)
        dense[where[a]], count[where[a]] = total[a], size[a]
    for i in range(n):  # a cluster has the number of its first member, which comes before
        label[i] = label[label[i]]
    _, label = np.unique(label, return_inverse=True)
    return label.astype(np.int32)


def cluster_blocks(df: DataFrame, block: str, key: str, vector: str, threshold: float) -> DataFrame:
    """block, key, cluster: each block is clustered by itself, in one task."""
    kinds = dict(df.dtypes)

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(key)
        return pd.DataFrame({block: pdf[block], key: pdf[key], "cluster": linkage_below(np.stack(pdf[vector].to_list()), threshold)})

    return df.select(block, key, vector).groupBy(block).applyInPandas(one, f"{block} {kinds[block]}, {key} {kinds[key]}, cluster int")


def cluster_all(df: DataFrame, keep: str, key: str, vector: str, threshold: float) -> DataFrame:
    """keep, key, cluster: all vectors in one tree, whatever ``keep`` is; the tree is built in one task."""
    kinds = dict(df.dtypes)

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(key)
        return pd.DataFrame({keep: pdf[keep], key: pdf[key], "cluster": linkage_below(np.stack(pdf[vector].to_list()), threshold)})

    return df.select(keep, key, vector).groupBy().applyInPandas(one, f"{keep} {kinds[keep]}, {key} {kinds[key]}, cluster int")
