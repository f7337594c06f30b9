"""Layered networks as expressions, and what is read off their outputs."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Weights of each layer (to x from) and thresholds.
Layers = list[tuple[np.ndarray, np.ndarray]]


def synthetic(sizes: tuple[int, ...] = (48, 8, 8, 10)) -> Layers:
    """Fixed weights ((7 i + 13 j + 5 l) mod 21 - 10) / 10 and thresholds ((3 j + l) mod 11 - 5) / 10."""
    out = []
    for layer, (n, m) in enumerate(zip(sizes, sizes[1:], strict=False), 1):
        i, j = np.arange(n)[None, :], np.arange(m)[:, None]
        out.append((((i * 7 + j * 13 + layer * 5) % 21 - 10) / 10.0, ((np.arange(m) * 3 + layer) % 11 - 5) / 10.0))
    return out


def _layer(nodes: Column, values: Column) -> Column:
    def output(node: Column) -> Column:
        total = F.aggregate(F.zip_with(node["w"], values, lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
        return 1 / (1 + F.exp(node["t"] - total))

    return F.transform(nodes, output)


def _bound(nodes: Column) -> Callable[[Column], Column]:
    return lambda values: _layer(nodes, values)


def forward(inputs: Column, layers: Layers) -> Column:
    """Outputs of the network for an array of doubles: sigmoid(sum of weight * input - threshold), layer by layer."""
    values = inputs
    for weights, thresholds in layers:
        nodes = F.array(*[F.struct(F.array(*[F.lit(float(x)) for x in row]).alias("w"), F.lit(float(t)).alias("t")) for row, t in zip(weights, thresholds, strict=True)])
        # bound to a variable, a layer is worked out once and not again for each node of the next one
        values = F.transform(F.array(values), _bound(nodes))[0]
    return values


def forward_numpy(x: np.ndarray, layers: Layers) -> np.ndarray:
    for weights, thresholds in layers:
        x = 1 / (1 + np.exp(thresholds - x @ weights.T))
    return x


def forward_udf(layers: Layers):
    """The same as a vectorised function, for wide networks."""

    @F.pandas_udf("array<double>")
    def run(x: pd.Series) -> pd.Series:
        return pd.Series(list(forward_numpy(np.stack(x.to_list()), layers))) if len(x) else pd.Series([], dtype=object)

    return run


def ranked(outputs: DataFrame, key: str, column: str = "outputs", least: float = 0.01, top: int = 4) -> DataFrame:
    """key, rank, label, prob: the ``top`` outputs over ``least``, the highest first, of equals the lower label."""
    each = outputs.select(key, F.posexplode(column).alias("label", "prob")).where(F.col("prob") > least)
    w = Window.partitionBy(key).orderBy(F.desc("prob"), "label")
    return each.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top)


def ranked_as_inserted(outputs: Column, least: float = 0.01, gate: int = 4) -> Column:
    """The results as a list that takes each output whose place is before ``gate`` when it arrives and never gets shorter."""
    arrivals = F.filter(F.transform(outputs, lambda p, i: F.struct(p.alias("prob"), i.alias("label"))), lambda s: s["prob"] > least)
    start = F.array().cast("array<struct<prob:double,label:int>>")

    def insert(found: Column, x: Column) -> Column:
        before = F.filter(found, lambda y: y["prob"] >= x["prob"])
        return F.when(F.size(before) < gate, F.concat(before, F.array(x), F.filter(found, lambda y: y["prob"] < x["prob"]))).otherwise(found)

    return F.aggregate(arrivals, start, insert)


def could_be_connected(results: DataFrame, key: str, connected: int, least: float = 0.2) -> DataFrame:
    """key, connected: the best result is below ``least`` or any result has the label of touching glyphs."""
    return results.groupBy(key).agg(((F.max("prob") < least) | F.bool_or(F.col("label") == connected)).alias("connected"))


def success(outputs: DataFrame, column: str = "outputs", label: str = "label", tolerance: float = 0.2) -> DataFrame:
    """total, good, percent: rows all of whose outputs are within ``tolerance`` of their label's one-hot vector."""
    good = F.forall(F.transform(column, lambda p, i: F.abs(p - (i == F.col(label)).cast("double")) <= tolerance), lambda ok: ok)
    return outputs.agg(F.count(F.lit(1)).alias("total"), F.count_if(good).alias("good")).select("total", "good", F.floor(100 * F.col("good") / F.col("total")).cast("long").alias("percent"))


def input_max(inputs: DataFrame, column: str = "f") -> DataFrame:
    """feature, most: the largest value of each input, 1 at least."""
    each = inputs.select(F.posexplode(column).alias("feature", "v"))
    return each.groupBy("feature").agg(F.greatest(F.lit(1.0), F.max("v")).alias("most"))


def misclassified(outputs: DataFrame, key: str, column: str = "outputs", label: str = "label") -> DataFrame:
    """key, label, predicted where the strongest output, of equals the first, is not the label."""
    best = F.array_position(F.col(column), F.array_max(column)) - 1
    return outputs.select(key, label, best.cast("int").alias("predicted")).where(F.col(label) != F.col("predicted"))


def confusion_matrix(outputs: DataFrame, column: str = "outputs", label: str = "label") -> DataFrame:
    best = F.array_position(F.col(column), F.array_max(column)) - 1
    return outputs.groupBy(label, best.cast("int").alias("predicted")).agg(F.count(F.lit(1)).alias("n"))


def sample_per_label(examples: DataFrame, key: str, label: str, n: int) -> DataFrame:
    """key, label of up to ``n`` examples of each label, in the order of (key * 7919 mod 10007, key): the same in any run."""
    w = Window.partitionBy(label).orderBy((F.col(key) * 7919) % 10007, key)
    return examples.select(key, label, F.row_number().over(w).alias("rn")).where(F.col("rn") <= n).drop("rn")


def one_hot(examples: DataFrame, key: str, label: str = "label", labels: int = 10) -> DataFrame:
    """key, node, target: 1 for the output of an example's label, 0 for the others."""
    hot = F.transform(F.sequence(F.lit(0), F.lit(labels - 1)), lambda i: (i == F.col(label)).cast("int"))
    return examples.select(key, F.posexplode(hot).alias("node", "target"))


def split_scores(parts: DataFrame, glyph: str, part: str, label: str = "label", prob: str = "prob") -> DataFrame:
    """glyph, score (the mean probability of its parts) and text (their labels in the order of ``part``)."""
    text = F.transform(F.sort_array(F.collect_list(F.struct(part, label))), lambda p: p[label])
    return parts.groupBy(glyph).agg(F.round(F.avg(prob), 6).alias("score"), F.array_join(text, "").alias("text"))


def train(x: np.ndarray, target: np.ndarray, hidden: tuple[int, ...] = (20, 20), repetitions: int = 50, rate: float = 0.5, seed: int = 1, layers: Layers | None = None, quirk: bool = False, after: Callable[[int, Layers], bool | None] | None = None) -> Layers:
    """Online back-propagation: each repetition draws as many examples as there are, with replacement.

    Weights start uniform in (-0.5, 0.5] in steps of 0.001; ``layers`` goes on from earlier ones. ``quirk``: the last example
    is never drawn. ``after`` gets the number of each repetition and the layers, to keep them or tell of them, and ends the
    training by returning True.
    """
    rng = np.random.default_rng(seed)
    sizes = (x.shape[1], *hidden, target.shape[1])
    if layers is None:
        layers = [((rng.integers(0, 1000, (m, n)) - 499) / 1000, (rng.integers(0, 1000, m) - 499) / 1000) for n, m in zip(sizes, sizes[1:], strict=False)]
    layers = [(w.copy(), t.copy()) for w, t in layers]
    for done in range(repetitions):
        for k in rng.integers(0, max(1, len(x) - quirk), len(x)):
            values = [x[k]]
            for w, t in layers:
                values.append(1 / (1 + np.exp(t - w @ values[-1])))
            delta = (target[k] - values[-1]) * values[-1] * (1 - values[-1])
            for i in range(len(layers) - 1, -1, -1):
                w, t = layers[i]
                back = (w.T @ delta) * values[i] * (1 - values[i])
                w += rate * np.outer(delta, values[i])
                t -= rate * delta
                delta = back
        if after is not None and after(done, layers):
            break
    return layers
