"""Dense networks whose weights are rows of a table.

``values`` holds one row a number: ``layer`` (from 0), ``part``, ``row`` (output unit), ``col``
(input unit, 0 for vectors) and ``value``.  Parts are ``weight`` and ``bias``, and for batch
normalisation ``gamma, beta, mean, var``.  ``layout`` holds one row a layer: ``layer, inputs,
outputs, activation, slope``.  The tables are checked against each other before any
number is used; a network is then a list of layers that ``anomaly.reconstruct`` runs by
Arrow batch.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.anomaly import ACTIVATIONS, Layer, batch_norm
from tidemark.operators.matrix import PcaProjection

VALUES = "layer int, part string, row int, col int, value double"
LAYOUT = "layer int, inputs int, outputs int, activation string, slope double"
MAX_VALUES = 20_000_000  # numbers of a network that travels to the tasks
BATCH_NORM = ("gamma", "beta", "mean", "var")


def faults(values: DataFrame, layout: Sequence) -> list[str]:
    """What is wrong with the tables; one aggregate over ``values``."""
    out = []
    numbers = [r["layer"] for r in layout]
    if not numbers or numbers != list(range(len(numbers))):
        return [f"layers are {numbers}, not 0, 1, ..."]
    for a, b in zip(layout, layout[1:]):
        if a["outputs"] != b["inputs"]:
            out.append(f"layer {b['layer']} takes {b['inputs']} inputs, layer {a['layer']} gives {a['outputs']}")
    out += [f"layer {r['layer']} has the unknown activation {r['activation']}" for r in layout if r["activation"] not in ACTIVATIONS]
    sound = F.col("value").isNotNull() & ~F.isnan("value") & (F.abs("value") < float("inf"))
    found = values.groupBy("layer", "part").agg(
        F.count("*").alias("n"), F.countDistinct("row", "col").alias("places"), F.min("row").alias("r0"), F.max("row").alias("r1"),
        F.min("col").alias("c0"), F.max("col").alias("c1"), F.sum((~sound).cast("int")).alias("unsound"),
    )
    held = {(r["layer"], r["part"]): r for r in found.collect()}
    for r in layout:
        i, rows, cols = r["layer"], r["outputs"], r["inputs"]
        norm = [p for p in BATCH_NORM if (i, p) in held]
        for part in ("weight", "bias", *(BATCH_NORM if norm else ())):
            width, have = cols if part == "weight" else 1, held.pop((i, part), None)
            if have is None:
                out.append(f"layer {i} has no {part}")
            elif (have["n"], have["places"], have["r0"], have["r1"], have["c0"], have["c1"]) != (rows * width, rows * width, 0, rows - 1, 0, width - 1):
                out.append(f"{part} of layer {i} isn't {rows} x {width}: {have['n']} numbers, rows {have['r0']} to {have['r1']}, columns {have['c0']} to {have['c1']}")
            elif have["unsound"]:
                out.append(f"{part} of layer {i} holds numbers that aren't finite")
    return out + [f"unknown part {p} of layer {i}" for i, p in sorted(held, key=str)]


def load_network(values: DataFrame, layout: DataFrame) -> list[Layer]:
    """Layers of a network given as tables; ValueError with all faults if they don't fit."""
    rows = sorted(layout.collect(), key=lambda r: r["layer"])
    size = sum((r["inputs"] + 5) * r["outputs"] for r in rows)
    if size > MAX_VALUES:
        raise ValueError(f"a network of {size} numbers is larger than {MAX_VALUES}")
    wrong = faults(values, rows)
    if wrong:
        raise ValueError("; ".join(wrong))
    table = values.select("layer", "part", "row", "col", "value").toPandas()
    parts: dict[tuple[int, str], np.ndarray] = {}
    for (i, part), group in table.groupby(["layer", "part"]):
        array = np.zeros((group["row"].max() + 1, group["col"].max() + 1))
        array[group["row"], group["col"]] = group["value"]
        parts[i, part] = array if part == "weight" else array[:, 0]
    out = []
    for r in rows:
        i = r["layer"]
        norm = batch_norm(*[parts[i, p] for p in BATCH_NORM]) if (i, "gamma") in parts else (None, None)
        slope = r["slope"] if r["slope"] is not None else ACTIVATIONS[r["activation"]]
        out.append(Layer(parts[i, "weight"], parts[i, "bias"], *norm, slope, r["activation"]))
    return out


def network_tables(spark: SparkSession, layers: Sequence[tuple[np.ndarray, np.ndarray, str, float | None]]) -> tuple[DataFrame, DataFrame]:
    """(values, layout) of given (weight, bias, activation, slope)."""
    values, layout = [], []
    for i, (weight, bias, activation, slope) in enumerate(layers):
        layout.append((i, weight.shape[1], weight.shape[0], activation, slope))
        values += [(i, "weight", r, c, float(v)) for (r, c), v in np.ndenumerate(weight)]
        values += [(i, "bias", r, 0, float(v)) for r, v in enumerate(bias)]
    return spark.createDataFrame(values, VALUES), spark.createDataFrame(layout, LAYOUT)


def coder_of(pca: PcaProjection, slope: float = 0.1) -> list[tuple[np.ndarray, np.ndarray, str, float | None]]:
    """A coder and decoder with leaky activations that projects on fitted components and
    back: each component enters once with either sign, and f(z) - f(-z) = (1 + slope) z."""
    c, both = pca.components.T, np.vstack([np.eye(pca.components.shape[1]), -np.eye(pca.components.shape[1])])
    joined = both.T / (1 + slope)
    none = np.zeros
    return [
        (both @ c, -(both @ c) @ pca.mean, "leaky_relu", slope),
        (joined, none(len(c)), "linear", None),
        (both, none(2 * len(c)), "leaky_relu", slope),
        (c.T @ joined, pca.mean, "linear", None),
    ]
