"""Token and frame selection: top-k with anchors, quotas, diversity, index plans."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def keep_count(rate: float, n: Column | int) -> Column:
    """Tokens kept of ``n`` at a rate: its floor, at least 1, at most ``n``."""
    c = F.lit(n) if isinstance(n, int) else n
    return F.greatest(F.lit(1), F.least(c, F.floor(c * F.lit(float(rate))))).cast("int")


def top_k(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: Column | int, name: str = "keep") -> DataFrame:
    """Marks the first ``k`` rows of each group; 0 keeps none, more than the group keeps all.

    The order has to be total for a defined result: end it with an index,
    ascending where the lower index wins a tie, descending where the higher does.
    """
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn(name, rank <= (F.lit(k) if isinstance(k, int) else k))


def farthest_first(df: DataFrame, keys: Sequence[str], index: str, feature: str, k: int) -> DataFrame:
    """``keys, index, pick``: greedy max-min selection from the greatest L1 norm on.

    Each pick is the row farthest (squared Euclidean) from those picked; the
    lower index wins ties.  The choice depends on all earlier ones, so a group
    (the tokens of one frame) is one pandas call.
    """
    src = df.select(*keys, index, feature)
    ddl = ", ".join([*(f"`{c}` {src.schema[c].dataType.simpleString()}" for c in (*keys, index)), "pick int"])

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(index)
        x = np.stack(pdf[feature].to_numpy()).astype(float)
        chosen = [int(np.abs(x).sum(axis=1).argmax())] if k > 0 else []
        dist = ((x - x[chosen[0]]) ** 2).sum(axis=1) if chosen else None
        while chosen and len(chosen) < min(k, len(x)):
            d = dist.copy()
            d[chosen] = -1
            chosen.append(int(d.argmax()))
            dist = np.minimum(dist, ((x - x[chosen[-1]]) ** 2).sum(axis=1))
        out = pdf.iloc[chosen][[*keys, index]].copy()
        out["pick"] = range(1, len(chosen) + 1)
        return out

    return src.groupBy(*keys).applyInPandas(run, ddl)


def uniform_indices(n: Column, k: int) -> Column:
    """``k`` indices spread over 0..n-1, ends included; all of them where n <= k."""
    if k < 1:
        raise ValueError("k must be positive")
    if k == 1:
        return F.array(F.lit(0))
    spread = F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.floor(i * (n - 1) / F.lit(k - 1)).cast("int"))
    return F.when(n <= 0, F.array().cast("array<int>")).when(n <= k, F.sequence(F.lit(0), (n - 1).cast("int"))).otherwise(spread)


def greedy_spacing(df: DataFrame, keys: Sequence[str], time: str, gap: float, anchors: Sequence[float] = (), anchor_gap: float = 1.0) -> DataFrame:
    """``keys, time, anchor``: events at least ``gap`` after the last one *chosen*.

    ``time`` is in seconds.  Then each anchor (a share of the group's time span)
    joins, in order, if it is farther than ``anchor_gap`` from all chosen.
    """
    src = df.select(*keys, time).filter(F.col(time).isNotNull())
    ddl = ", ".join([*(f"`{c}` {src.schema[c].dataType.simpleString()}" for c in keys), f"`{time}` double, anchor boolean"])

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        ts = np.sort(pdf[time].to_numpy(dtype=float))
        chosen: list[float] = []
        for x in ts:
            if not chosen or x - chosen[-1] >= gap:
                chosen.append(float(x))
        flags = [False] * len(chosen)
        for a in anchors:
            x = float(ts[0] + a * (ts[-1] - ts[0]))
            if all(abs(x - c) > anchor_gap for c in chosen):
                chosen.append(x)
                flags.append(True)
        out = pd.DataFrame({time: chosen, "anchor": flags})
        for c in keys:
            out[c] = pdf[c].iloc[0]
        return out[[*keys, time, "anchor"]].sort_values(time)

    return src.groupBy(*keys).applyInPandas(run, ddl)
