"""The few network layers the trainer runs on mini-batches inside its tasks.

A network is described by a plain dictionary, which is also its stored form:

``{"input": [h, w, c] or [n], "layers": [{"kind": "conv", "filters": 32, "size": 3}, ...],
"loss": "categorical" or "binary"}``

All weights live in one flat array, so that the Spark side can cut, average and store them without
knowing the layers.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

import numpy as np

Spec = dict
Array = np.ndarray

PROBABILITY_FLOOR = 1e-7
WIDEST_SLICE = 2**24


def dense_spec(
    inputs: int, classes: int, hidden: Sequence[int] = (512, 512, 512), dropout: float = 0.5
) -> Spec:
    """Hidden layers of ReLU units with dropout, then a softmax over the classes."""
    layers: list[dict] = []
    for units in hidden:
        layers += [{"kind": "dense", "units": units}, {"kind": "relu"}]
        if dropout:
            layers.append({"kind": "dropout", "rate": dropout})
    layers += [{"kind": "dense", "units": classes}, {"kind": "softmax"}]
    return {"input": [inputs], "layers": layers, "loss": "categorical"}


def conv_spec(
    height: int,
    width: int,
    outputs: int = 2,
    channels: int = 3,
    filters: Sequence[int] = (32, 32, 64),
    units: int = 64,
    dropout: float = 0.5,
    activation: str = "sigmoid",
) -> Spec:
    """Blocks of 3x3 convolution, ReLU and 2x2 pooling, then a dense layer and the output layer."""
    layers: list[dict] = []
    for n in filters:
        layers += [
            {"kind": "conv", "filters": n, "size": 3},
            {"kind": "relu"},
            {"kind": "pool", "size": 2},
        ]
    layers += [{"kind": "flatten"}, {"kind": "dense", "units": units}, {"kind": "relu"}]
    if dropout:
        layers.append({"kind": "dropout", "rate": dropout})
    layers += [{"kind": "dense", "units": outputs}, {"kind": activation}]
    loss = "binary" if outputs == 1 else "categorical"
    return {"input": [height, width, channels], "layers": layers, "loss": loss}


class SpecError(ValueError):
    """A network description does not fit together, or does not fit the data."""


@dataclass
class Plan:
    """A checked description: shapes of every layer and the place of its weights."""

    spec: Spec
    shapes: list[tuple[int, ...]] = field(default_factory=list)
    slots: list[tuple[int, tuple[int, ...], int]] = field(default_factory=list)
    size: int = 0
    widest: int = 1

    @property
    def inputs(self) -> int:
        return math.prod(self.spec["input"])

    @property
    def outputs(self) -> int:
        return self.shapes[-1][0]


def plan(spec: Spec) -> Plan:
    """Follow the shapes through the layers and lay out the weights."""
    made = Plan(spec)
    shape = tuple(int(n) for n in spec["input"])
    for layer in spec["layers"]:
        kind = layer["kind"]
        weights: tuple[int, ...] = ()
        if kind == "conv":
            k = layer["size"]
            if len(shape) != 3 or min(shape[:2]) < k:
                raise SpecError(f"convolution of size {k} does not fit the shape {shape}")
            weights = (k * k * shape[2], layer["filters"])
            shape = (shape[0] - k + 1, shape[1] - k + 1, layer["filters"])
            made.widest = max(made.widest, shape[0] * shape[1] * weights[0])
        elif kind == "pool":
            k = layer["size"]
            if len(shape) != 3 or min(shape[:2]) < k:
                raise SpecError(f"pooling of size {k} does not fit the shape {shape}")
            shape = (shape[0] // k, shape[1] // k, shape[2])
        elif kind == "flatten":
            shape = (math.prod(shape),)
        elif kind == "dense":
            if len(shape) != 1:
                raise SpecError(f"a dense layer needs a flat input, not {shape}")
            weights = (shape[0], layer["units"])
            shape = (layer["units"],)
        elif kind not in ("relu", "sigmoid", "softmax", "dropout"):
            raise SpecError(f"unknown layer kind {kind!r}")
        made.slots.append((made.size, weights, made.size + math.prod(weights) if weights else 0))
        if weights:
            made.size += math.prod(weights) + weights[1]
        made.shapes.append(shape)
        made.widest = max(made.widest, math.prod(shape))
    if len(shape) != 1:
        raise SpecError(f"the output must be flat, not {shape}")
    if spec["loss"] == "binary" and shape != (1,):
        raise SpecError("the binary loss needs one output")
    if spec["loss"] == "categorical" and shape[0] < 2:
        raise SpecError("the categorical loss needs one output per class")
    last = spec["layers"][-1]["kind"]
    if last not in ("sigmoid", "softmax") or (spec["loss"] == "binary" and last == "softmax"):
        raise SpecError("the last layer must be sigmoid, or softmax over several classes")
    return made


def slices(made: Plan, rows: int) -> list[slice]:
    """Cut a batch so that no layer holds more than some sixteen million values at once."""
    step = min(max(WIDEST_SLICE // made.widest, 1), 256)
    return [slice(at, at + step) for at in range(0, rows, step)]


def initial_weights(made: Plan, seed: int) -> Array:
    """Uniform weights scaled by the fan-in and fan-out of each layer; zero biases."""
    draw = np.random.default_rng(seed)
    flat = np.zeros(made.size)
    for layer, (start, shape, bias) in zip(made.spec["layers"], made.slots):
        if shape:
            fan_out = shape[1] * (layer["size"] ** 2 if layer["kind"] == "conv" else 1)
            bound = math.sqrt(6.0 / (shape[0] + fan_out))
            flat[start:bias] = draw.uniform(-bound, bound, math.prod(shape))
    return flat


def _patches(x: Array, k: int) -> Array:
    """(rows, h, w, k * k * c): the input under the kernel at every place."""
    windows = np.lib.stride_tricks.sliding_window_view(x, (k, k), axis=(1, 2))
    ordered = windows.transpose(0, 1, 2, 4, 5, 3)
    return ordered.reshape(*ordered.shape[:3], -1)


def _blocks(x: Array, k: int) -> Array:
    """(rows, h, w, c, k * k): values of every pooling block; the odd edge is left out."""
    rows, h, w, c = x.shape
    cut = x[:, : h // k * k, : w // k * k]
    split = cut.reshape(rows, h // k, k, w // k, k, c)
    return split.transpose(0, 1, 3, 5, 2, 4).reshape(rows, h // k, w // k, c, k * k)


def forward(
    made: Plan, flat: Array, rows: Array, draw: np.random.Generator | None = None
) -> tuple[Array, list]:
    """Outputs for a batch, and what ``backward`` needs. Dropout acts only with a generator."""
    x = rows.reshape(-1, *made.spec["input"])
    kept: list = []
    for layer, (start, shape, bias) in zip(made.spec["layers"], made.slots):
        kind = layer["kind"]
        if shape:
            w = flat[start:bias].reshape(shape)
            b = flat[bias : bias + shape[1]]
            if kind == "conv":
                columns = _patches(x, layer["size"])
                kept.append((columns, x.shape))
                x = columns @ w + b
            else:
                kept.append(x)
                x = x @ w + b
        elif kind == "relu":
            kept.append(x > 0)
            x = np.maximum(x, 0)
        elif kind == "pool":
            blocks = _blocks(x, layer["size"])
            top = blocks.argmax(axis=-1)
            kept.append((top, x.shape))
            x = np.take_along_axis(blocks, top[..., None], axis=-1)[..., 0]
        elif kind == "flatten":
            kept.append(x.shape)
            x = x.reshape(x.shape[0], -1)
        elif kind == "dropout":
            mask = None
            if draw is not None:
                stay = 1.0 - layer["rate"]
                mask = ((draw.random(x.shape) < stay) / stay).astype(x.dtype)
                x = x * mask
            kept.append(mask)
        else:
            if kind == "sigmoid":
                x = 1.0 / (1.0 + np.exp(-np.clip(x, -500, 500)))
            else:
                x = np.exp(x - x.max(axis=1, keepdims=True))
                x = x / x.sum(axis=1, keepdims=True)
            kept.append(x)
    return x, kept


def losses(made: Plan, outputs: Array, labels: Array) -> Array:
    """Cross-entropy per row. Outputs that do not sum to one are normalised first."""
    if made.spec["loss"] == "binary":
        p = np.where(labels == 1, outputs[:, 0], 1.0 - outputs[:, 0])
    else:
        p = outputs[np.arange(len(labels)), labels] / outputs.sum(axis=1)
    return -np.log(np.maximum(p, PROBABILITY_FLOOR))


def backward(made: Plan, flat: Array, outputs: Array, labels: Array, kept: list) -> Array:
    """Gradient of the summed loss for the flat weights."""
    at = np.arange(len(labels))
    last = made.spec["layers"][-1]["kind"]
    if made.spec["loss"] == "binary":
        g = outputs - labels[:, None]
    elif last == "softmax":
        g = outputs.copy()
        g[at, labels] -= 1.0
    else:
        # Normalised sigmoids: d loss / d output, times the slope of the sigmoid.
        g = np.repeat(1.0 / np.maximum(outputs.sum(axis=1, keepdims=True), 1e-30), outputs.shape[1], 1)
        g[at, labels] -= 1.0 / np.maximum(outputs[at, labels], 1e-30)
        g = g * outputs * (1.0 - outputs)
    gradient = np.zeros_like(flat)
    stack = list(zip(made.spec["layers"], made.slots, kept))[:-1]
    for layer, (start, shape, bias), saved in reversed(stack):
        kind = layer["kind"]
        if kind == "dense":
            gradient[start:bias] = (saved.T @ g).ravel()
            gradient[bias : bias + shape[1]] = g.sum(axis=0)
            g = g @ flat[start:bias].reshape(shape).T
        elif kind == "conv":
            columns, in_shape = saved
            n, k = shape[1], layer["size"]
            gradient[start:bias] = (columns.reshape(-1, shape[0]).T @ g.reshape(-1, n)).ravel()
            gradient[bias : bias + n] = g.reshape(-1, n).sum(axis=0)
            if start:
                spread = (g @ flat[start:bias].reshape(shape).T).reshape(*g.shape[:3], k, k, -1)
                g_in = np.zeros(in_shape, g.dtype)
                h, w = g.shape[1:3]
                for dy in range(k):
                    for dx in range(k):
                        g_in[:, dy : dy + h, dx : dx + w] += spread[:, :, :, dy, dx]
                g = g_in
        elif kind == "relu":
            g = g * saved
        elif kind == "pool":
            top, in_shape = saved
            k = layer["size"]
            rows, h, w, c = g.shape
            blocks = np.zeros((rows, h, w, c, k * k), g.dtype)
            np.put_along_axis(blocks, top[..., None], g[..., None], axis=-1)
            placed = blocks.reshape(rows, h, w, c, k, k).transpose(0, 1, 4, 2, 5, 3)
            g_in = np.zeros(in_shape, g.dtype)
            g_in[:, : h * k, : w * k] = placed.reshape(rows, h * k, w * k, c)
            g = g_in
        elif kind == "flatten":
            g = g.reshape(saved)
        elif kind == "dropout":
            g = g if saved is None else g * saved
        elif kind == "sigmoid":
            g = g * saved * (1.0 - saved)
        else:
            g = saved * (g - (g * saved).sum(axis=1, keepdims=True))
    return gradient


def classes_of(outputs: Array) -> Array:
    if outputs.shape[1] == 1:
        return (outputs[:, 0] > 0.5).astype(np.int64)
    return outputs.argmax(axis=1)


# Customary defaults of the update rules.
RULE_DEFAULTS = {
    "sgd": {"rate": 0.01},
    "adagrad": {"rate": 0.01, "epsilon": 1e-7},
    "rmsprop": {"rate": 0.001, "decay": 0.9, "epsilon": 1e-7},
    "adam": {"rate": 0.001, "decay": 0.9, "decay_square": 0.999, "epsilon": 1e-7},
    "adadelta": {"rate": 1.0, "decay": 0.95, "epsilon": 1e-7},
}


def update_rule(name: str, settings: dict | None = None) -> Callable[[Array, Array], Array]:
    """A stateful step: (weights, gradient) to new weights."""
    if name not in RULE_DEFAULTS:
        raise SpecError(f"unknown update rule {name!r}; known are {sorted(RULE_DEFAULTS)}")
    unknown = set(settings or {}) - set(RULE_DEFAULTS[name])
    if unknown:
        raise SpecError(f"unknown settings {sorted(unknown)} for {name}")
    s = {**RULE_DEFAULTS[name], **(settings or {})}
    state: dict[str, Array | int] = {}

    def held(key: str, like: Array) -> Array:
        return state.setdefault(key, np.zeros_like(like))

    def sgd(w: Array, g: Array) -> Array:
        return w - s["rate"] * g

    def adagrad(w: Array, g: Array) -> Array:
        square = held("square", g)
        square += g * g
        return w - s["rate"] * g / (np.sqrt(square) + s["epsilon"])

    def rmsprop(w: Array, g: Array) -> Array:
        square = held("square", g)
        square += (1 - s["decay"]) * (g * g - square)
        return w - s["rate"] * g / (np.sqrt(square) + s["epsilon"])

    def adam(w: Array, g: Array) -> Array:
        state["steps"] = t = int(state.get("steps", 0)) + 1
        mean, square = held("mean", g), held("square", g)
        mean += (1 - s["decay"]) * (g - mean)
        square += (1 - s["decay_square"]) * (g * g - square)
        level = math.sqrt(1 - s["decay_square"] ** t) / (1 - s["decay"] ** t)
        return w - s["rate"] * level * mean / (np.sqrt(square) + s["epsilon"])

    def adadelta(w: Array, g: Array) -> Array:
        square, moved = held("square", g), held("moved", g)
        square += (1 - s["decay"]) * (g * g - square)
        step = g * np.sqrt(moved + s["epsilon"]) / np.sqrt(square + s["epsilon"])
        moved += (1 - s["decay"]) * (step * step - moved)
        return w - s["rate"] * step

    return {
        "sgd": sgd, "adagrad": adagrad, "rmsprop": rmsprop, "adam": adam, "adadelta": adadelta
    }[name]
