"""Model scoring: a logistic Column, the same model and forests of trees over Arrow batches, and the pluggable protocol."""

from __future__ import annotations

import json
import math
from collections.abc import Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType


class Scorer(Protocol):
    """Any batch model: takes the feature columns, gives one probability a row."""

    def __call__(self, features: pd.DataFrame) -> pd.Series: ...


def logistic(weights: dict[str, float], bias: float) -> Column:
    z = F.lit(float(bias))
    for name in sorted(weights):
        z = z + F.col(name).cast("double") * F.lit(float(weights[name]))
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-z))


class LogisticScorer:
    def __init__(self, weights: dict[str, float], bias: float):
        self.weights, self.bias = dict(weights), float(bias)

    def __call__(self, features: pd.DataFrame) -> pd.Series:
        z = self.bias
        for name in sorted(self.weights):
            z = z + features[name].astype(float) * self.weights[name]
        return z.map(lambda v: 1.0 / (1.0 + math.exp(-v)))


def scored(df: DataFrame, scorer: Scorer, keys: list[str], features: list[str]) -> DataFrame:
    """keys and probability, batch by batch; an exception in the model ends the query."""
    fields = {f.name: f.dataType.simpleString() for f in df.schema}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf[keys].assign(probability=scorer(pdf[features]).astype(float) if len(pdf) else pd.Series(dtype=float))

    return df.select(*keys, *features).mapInPandas(run, ", ".join(f"{k} {fields[k]}" for k in keys) + ", probability double")


class Forest:
    """Decision trees as flat arrays, which a whole batch goes down level by level, all trees at once.

    A tree is a dict of lists of equal length, one entry a node: `feature` (a
    name, or null for a leaf), `threshold`, `left` and `right` (nodes of the same
    tree; left holds values up to the threshold), `value` (of a leaf), and
    optionally `missing` (true where a null goes left, else it goes right).
    `average` takes the mean of the trees, as forests do, in place of their sum,
    as boosted trees do; `logistic` turns bias and sum into a probability.
    """

    def __init__(self, trees: list[dict], bias: float = 0.0, average: bool = False, logistic: bool = True):
        if not trees:
            raise ValueError("a forest needs a tree")
        self.bias, self.average, self.logistic = float(bias), bool(average), bool(logistic)
        self.features = sorted({f for t in trees for f in t["feature"] if f is not None})
        number = {f: i for i, f in enumerate(self.features)}
        feature, threshold, left, right, value, missing, self.roots, self.depth = [], [], [], [], [], [], [], 0
        for t in trees:
            at, n = len(feature), len(t["feature"])
            if any(len(t[c]) != n for c in ("threshold", "left", "right", "value")):
                raise ValueError("the lists of a tree differ in length")
            depth = [0] * n
            for i in range(n):  # children come after their node, so that there is no circle
                if t["feature"][i] is not None:
                    for child in (t["left"][i], t["right"][i]):
                        if not i < child < n:
                            raise ValueError(f"node {i} of a tree has the child {child}")
                        depth[child] = depth[i] + 1
            self.depth = max(self.depth, *depth)
            self.roots.append(at)
            is_leaf = [f is None for f in t["feature"]]
            feature += [-1 if x else number[f] for f, x in zip(t["feature"], is_leaf, strict=True)]
            threshold += [0.0 if x else float(v) for v, x in zip(t["threshold"], is_leaf, strict=True)]
            left += [at + i if x else at + v for i, (v, x) in enumerate(zip(t["left"], is_leaf, strict=True))]
            right += [at + i if x else at + v for i, (v, x) in enumerate(zip(t["right"], is_leaf, strict=True))]
            value += [float(v) if x else 0.0 for v, x in zip(t["value"], is_leaf, strict=True)]
            missing += [bool(m) for m in t.get("missing", [False] * n)]
        self.feature, self.left, self.right = (np.array(x, np.int64) for x in (feature, left, right))
        self.threshold, self.value, self.missing = np.array(threshold), np.array(value), np.array(missing)

    def __call__(self, features: pd.DataFrame) -> pd.Series:
        x = features[self.features].to_numpy(float, na_value=np.nan) if self.features else np.zeros((len(features), 1))
        node = np.tile(np.array(self.roots), (len(features), 1))
        row = np.arange(len(features))[:, None]
        for _ in range(self.depth):
            seen = x[row, np.maximum(self.feature[node], 0)]
            node = np.where(np.where(np.isnan(seen), self.missing[node], seen <= self.threshold[node]), self.left[node], self.right[node])
        leaves = self.value[node]
        total = np.full(len(features), 0.0)
        for k in range(len(self.roots)):  # in the order of the trees, as sums of doubles have one
            total = total + leaves[:, k]
        total = self.bias + (total / len(self.roots) if self.average else total)
        return pd.Series(1.0 / (1.0 + np.exp(-total)) if self.logistic else total, index=features.index)


def load(path: str) -> LogisticScorer | Forest:
    """A model from a JSON file, read by the driver and sent along with the plan: `weights` by feature and `bias`, or `trees` with what Forest takes."""
    with open(path, encoding="utf-8") as f:
        raw = json.load(f)
    if "trees" in raw:
        return Forest(raw["trees"], raw.get("bias", 0.0), raw.get("average", False), raw.get("logistic", True))
    return LogisticScorer({str(k): float(v) for k, v in raw["weights"].items()}, float(raw["bias"]))


def gated(df: DataFrame, high: Column | Scorer, low: Column | Scorer, clt_type: str = "clt_type", te_frac: str = "te_aligned_frac", blacklisted: str = "is_in_blacklist", keys: list[str] | None = None) -> DataFrame:
    """Two models, one for clusters of several reads and one for the rest; what no gate lets through scores 0.

    A batch model gets its own clusters with all numeric columns, and its
    probabilities are joined by `keys`.
    """
    ok = (F.col(te_frac) >= 0.8) & ~F.col(blacklisted)
    gates = {"_high": (ok & (F.col(clt_type) == 0), high), "_low": (ok & (F.col(clt_type) > 0), low)}
    features = [f.name for f in df.schema if isinstance(f.dataType, NumericType) and f.name not in (keys or ())]
    out, columns = df, []
    for name, (gate, model) in gates.items():
        if isinstance(model, Column):
            columns.append(F.when(gate, model))
        else:
            found = scored(df.where(gate), model, keys, features).withColumnRenamed("probability", name)
            out = out.join(found, keys, "left")
            columns.append(F.col(name))
    return out.withColumn("probability", F.coalesce(*columns, F.lit(0.0))).drop(*gates)
