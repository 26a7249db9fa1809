"""What the tasks of training and scoring do: NumPy on Arrow batches, and no Spark job of its own."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext

from mediaflow.operators import network

PIECE = 4096
SUMS = ["n", "loss", "hits", "val_n", "val_loss", "val_hits"]


def matrix(values: pa.Array, width: int, dtype: str) -> np.ndarray:
    """Arrow list column to a (rows, width) matrix; every list must have that width."""
    widths = pc.min_max(pc.list_value_length(values))
    if len(values) and (widths["min"].as_py(), widths["max"].as_py()) != (width, width):
        raise ValueError(f"arrays of {widths['min']} to {widths['max']} values, not of {width}")
    flat = values.flatten().to_numpy(zero_copy_only=False)
    return flat.astype(dtype, copy=False).reshape(len(values), width)


def _mini_batches(
    batches: Iterator[tuple[np.ndarray, np.ndarray]], size: int, draw: np.random.Generator
) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Cut a stream of Arrow batches, shuffled within each, into mini-batches; the last may be short."""
    held: tuple[np.ndarray, np.ndarray] | None = None
    for x, y in batches:
        order = draw.permutation(len(y))
        x, y = x[order], y[order]
        if held is not None:
            x, y = np.concatenate([held[0], x]), np.concatenate([held[1], y])
        whole = len(y) // size * size
        for start in range(0, whole, size):
            yield x[start : start + size], y[start : start + size]
        held = x[whole:], y[whole:]
    if held is not None and len(held[1]):
        yield held


class EpochTask:
    """What one partition does in one epoch. Reads (features, label, held_out) rows once."""

    def __init__(self, plan, weights, settings: dict, epoch: int) -> None:
        self.plan = plan
        self.weights = weights
        self.settings = settings
        self.epoch = epoch

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s, made = self.settings, self.plan
        dtype = "float32" if s["precision"] == "single" else "float64"
        start = self.weights.value.astype(dtype)
        flat = start.copy()
        draw = np.random.default_rng([s["seed"], self.epoch, TaskContext.get().partitionId()])
        step = network.update_rule(s["optimizer"], s["optimizer_settings"])
        sums = {"n": 0, "loss": 0.0, "hits": 0, "val_n": 0, "val_loss": 0.0, "val_hits": 0}

        def note(prefix: str, outputs: np.ndarray, y: np.ndarray) -> None:
            sums[prefix + "n"] += len(y)
            sums[prefix + "loss"] += float(network.losses(made, outputs, y).sum())
            sums[prefix + "hits"] += int((network.classes_of(outputs) == y).sum())

        def training_rows() -> Iterator[tuple[np.ndarray, np.ndarray]]:
            for batch in batches:
                x = matrix(batch.column(0), made.inputs, dtype)
                y = batch.column(1).to_numpy(zero_copy_only=False)
                out = batch.column(2).to_numpy(zero_copy_only=False).astype(bool)
                if out.any():
                    # Held-out rows measure the weights this epoch starts from.
                    score("val_", x[out], y[out])
                if not out.all():
                    yield x[~out], y[~out]

        def score(prefix: str, x: np.ndarray, y: np.ndarray) -> None:
            for part in network.slices(made, len(y)):
                note(prefix, network.forward(made, start, x[part])[0], y[part])

        def gradient(x: np.ndarray, y: np.ndarray) -> np.ndarray:
            """Summed over the rows, in slices that bound the memory of the layers."""
            total = np.zeros_like(flat)
            for part in network.slices(made, len(y)):
                outputs, kept = network.forward(made, flat, x[part], draw)
                note("", outputs, y[part])
                total += network.backward(made, flat, outputs, y[part], kept)
            return total

        if not s["train"]:
            for x, y in training_rows():
                score("", x, y)
        elif s["batch_size"] > 0:
            for x, y in _mini_batches(training_rows(), s["batch_size"], draw):
                flat = step(flat, gradient(x, y) / len(y))
        else:
            total = np.zeros_like(flat)
            for x, y in training_rows():
                total += gradient(x, y)
            if sums["n"]:
                flat = step(flat, total / sums["n"])
        if sums["n"] or sums["val_n"]:
            yield self._pieces(flat, sums)

    def _pieces(self, flat: np.ndarray, sums: dict) -> pa.RecordBatch:
        flat = flat.astype(np.float64) if self.settings["train"] else flat[:1].astype(np.float64)
        cuts = [flat[at : at + PIECE] for at in range(0, len(flat), PIECE)]
        rest = len(cuts) - 1
        columns = [
            pa.array(range(len(cuts)), pa.int32()),
            pa.array(cuts, pa.list_(pa.float64())),
            pa.array([sums["n"]] * len(cuts), pa.int64()),
            pa.array([sums["loss"]] + [0.0] * rest, pa.float64()),
            pa.array([sums["hits"]] + [0] * rest, pa.int64()),
            pa.array([sums["val_n"]] + [0] * rest, pa.int64()),
            pa.array([sums["val_loss"]] + [0.0] * rest, pa.float64()),
            pa.array([sums["val_hits"]] + [0] * rest, pa.int64()),
        ]
        return pa.RecordBatch.from_arrays(columns, names=["piece", "weights", *SUMS])


def scored(made, flat: np.ndarray, values: pa.Array, dtype: str, with_scores: bool = True) -> pa.Array:
    """Class per row, and its outputs if asked for; NULL features give NULL for both."""
    present = values.is_valid().to_numpy(zero_copy_only=False)
    prediction = np.full(len(values), np.nan)
    outputs = np.zeros((len(values), made.outputs))
    if present.any():
        x = matrix(values.filter(pa.array(present)), made.inputs, dtype)
        found = [network.forward(made, flat, x[part])[0] for part in network.slices(made, len(x))]
        outputs[present] = np.concatenate(found)
        prediction[present] = network.classes_of(outputs[present])
    classes = pa.array(prediction, mask=~present)
    if not with_scores:
        return pa.StructArray.from_arrays([classes], names=["prediction"])
    scores = [row if ok else None for row, ok in zip(outputs, present)]
    return pa.StructArray.from_arrays(
        [classes, pa.array(scores, pa.list_(pa.float64()))],
        names=["prediction", "scores"],
    )
