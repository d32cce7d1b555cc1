"""A small masked-language-model encoder in NumPy: forward, loss, gradients and AdamW.

Inside tasks whole batches are matrices; the loss is projected to the vocabulary
at labelled places only.  Gradients are written out by hand, as no automatic
differentiation is at hand, and are tested against finite differences.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np

IGNORE = -100
EPSILON = 1e-5
_C = math.sqrt(2.0 / math.pi)
Parameters = dict[str, np.ndarray]


@dataclass(frozen=True)
class Shape:
    vocab_size: int
    max_positions: int = 128
    hidden_size: int = 384
    num_heads: int = 6
    intermediate_size: int = 1536
    num_layers: int = 6

    def __post_init__(self) -> None:
        for name, value in self.__dict__.items():
            if type(value) is not int or value < 1:
                raise ValueError(f"{name} must be a positive integer")
        if self.hidden_size % self.num_heads:
            raise ValueError("hidden_size must be divisible by num_heads")


def init(shape: Shape, seed: int = 42, dtype: type = np.float32) -> Parameters:
    """Normal weights of variance 1 / input size, zero biases, unit norms."""
    rng = np.random.default_rng(seed)
    h, i = shape.hidden_size, shape.intermediate_size
    p: Parameters = {}

    def weight(name: str, out: int, size: int, scale: float) -> None:
        p[name] = (rng.standard_normal((out, size)) / math.sqrt(scale)).astype(dtype)

    def norm(name: str) -> None:
        p[f"{name}.scale"], p[f"{name}.shift"] = np.ones(h, dtype), np.zeros(h, dtype)

    def dense(name: str, out: int, size: int) -> None:
        weight(f"{name}.w", out, size, size)
        p[f"{name}.b"] = np.zeros(out, dtype)

    weight("token", shape.vocab_size, h, h)
    weight("position", shape.max_positions, h, h)
    norm("embed")
    for n in range(shape.num_layers):
        for part in "qkvo":
            dense(f"{n}.{part}", h, h)
        norm(f"{n}.after")
        dense(f"{n}.up", i, h)
        dense(f"{n}.down", h, i)
        norm(f"{n}.end")
    dense("head", h, h)
    norm("head.norm")
    p["head.bias"] = np.zeros(shape.vocab_size, dtype)
    return p


def check_inputs(shape: Shape, ids: np.ndarray, mask: np.ndarray) -> None:
    if ids.ndim != 2 or mask.ndim != 2:
        raise ValueError("input_ids and attention_mask must be [batch, sequence]")
    if ids.dtype != np.int64 or mask.dtype != np.int64:
        raise TypeError("input_ids and attention_mask must be int64")
    if ids.shape != mask.shape:
        raise ValueError("attention_mask must have the shape of input_ids")
    if ids.shape[1] > shape.max_positions:
        raise ValueError("sequences are longer than max_positions")
    if (ids < 0).any() or (ids >= shape.vocab_size).any():
        raise ValueError("input_ids are outside the vocabulary")


def gelu(x: np.ndarray) -> np.ndarray:
    return 0.5 * x * (1 + np.tanh(_C * (x + 0.044715 * x**3)))


def _gelu_slope(x: np.ndarray) -> np.ndarray:
    t = np.tanh(_C * (x + 0.044715 * x**3))
    return 0.5 * (1 + t) + 0.5 * x * (1 - t * t) * _C * (1 + 3 * 0.044715 * x * x)


class _Run:
    """One pass: every step leaves what its gradient needs on a tape."""

    def __init__(self, p: Parameters, shape: Shape) -> None:
        self.p, self.shape = p, shape
        self.tape: list = []
        self.grad: Parameters = {}

    def _note(self, name: str, g: np.ndarray) -> None:
        self.grad[name] = self.grad[name] + g if name in self.grad else g

    def dense(self, name: str, x: np.ndarray) -> np.ndarray:
        w = self.p[f"{name}.w"]

        def back(g: np.ndarray) -> np.ndarray:
            flat = g.reshape(-1, g.shape[-1])
            self._note(f"{name}.w", flat.T @ x.reshape(-1, x.shape[-1]))
            self._note(f"{name}.b", flat.sum(0))
            return g @ w

        self.tape.append(back)
        return x @ w.T + self.p[f"{name}.b"]

    def norm(self, name: str, x: np.ndarray) -> np.ndarray:
        centred = x - x.mean(-1, keepdims=True)
        inverse = 1 / np.sqrt((centred * centred).mean(-1, keepdims=True) + x.dtype.type(EPSILON))
        unit = centred * inverse
        scale = self.p[f"{name}.scale"]

        def back(g: np.ndarray) -> np.ndarray:
            self._note(f"{name}.scale", (g * unit).reshape(-1, g.shape[-1]).sum(0))
            self._note(f"{name}.shift", g.reshape(-1, g.shape[-1]).sum(0))
            g = g * scale
            return inverse * (g - g.mean(-1, keepdims=True) - unit * (g * unit).mean(-1, keepdims=True))

        self.tape.append(back)
        return scale * unit + self.p[f"{name}.shift"]

    def gelu(self, x: np.ndarray) -> np.ndarray:
        self.tape.append(lambda g: g * _gelu_slope(x))
        return gelu(x)

    def masked(self, x: np.ndarray, keep: np.ndarray) -> np.ndarray:
        self.tape.append(lambda g: g * keep)
        return x * keep

    def attention(self, n: int, x: np.ndarray, mask: np.ndarray) -> np.ndarray:
        b, length, h = x.shape
        heads, d = self.shape.num_heads, h // self.shape.num_heads
        split = lambda y: y.reshape(b, length, heads, d).transpose(0, 2, 1, 3)
        flat = lambda y: y.transpose(0, 2, 1, 3).reshape(b, length, h)
        start = len(self.tape)
        q, k, v = (split(self.dense(f"{n}.{part}", x)) for part in "qkv")
        steps = self.tape[start:]
        del self.tape[start:]
        scores = q @ k.transpose(0, 1, 3, 2) / math.sqrt(d)
        scores = np.where(mask[:, None, None, :] == 1, scores, np.finfo(scores.dtype).min)
        weight = np.exp(scores - scores.max(-1, keepdims=True))
        weight /= weight.sum(-1, keepdims=True)

        def back(g: np.ndarray) -> np.ndarray:
            g = split(g)
            gv = weight.transpose(0, 1, 3, 2) @ g
            gw = g @ v.transpose(0, 1, 3, 2)
            gs = weight * (gw - (gw * weight).sum(-1, keepdims=True))
            gs = np.where(mask[:, None, None, :] == 1, gs, 0) / math.sqrt(d)
            parts = (gs @ k, gs.transpose(0, 1, 3, 2) @ q, gv)
            return sum(step(flat(part)) for step, part in zip(steps, parts))

        self.tape.append(back)
        out = self.dense(f"{n}.o", flat(weight @ v))
        return self.masked(out, mask[..., None].astype(x.dtype))

    def residual(self, x: np.ndarray, inner) -> np.ndarray:
        """x + inner(x), recorded as one step."""
        start = len(self.tape)
        out = x + inner(x)
        steps = self.tape[start:]
        del self.tape[start:]

        def back(g: np.ndarray) -> np.ndarray:
            inside = g
            for step in reversed(steps):
                inside = step(inside)
            return g + inside

        self.tape.append(back)
        return out

    def hidden(self, ids: np.ndarray, mask: np.ndarray) -> np.ndarray:
        """States before the vocabulary projection, [batch, sequence, hidden]."""
        check_inputs(self.shape, ids, mask)
        length = ids.shape[1]

        def back(g: np.ndarray) -> np.ndarray:
            table = np.zeros_like(self.p["token"])
            np.add.at(table, ids.ravel(), g.reshape(-1, g.shape[-1]))
            self._note("token", table)
            places = np.zeros_like(self.p["position"])
            places[:length] = g.sum(0)
            self._note("position", places)
            return g

        self.tape.append(back)
        x = self.norm("embed", self.p["token"][ids] + self.p["position"][:length])
        keep = mask[..., None].astype(x.dtype)
        for n in range(self.shape.num_layers):
            x = self.masked(self.norm(f"{n}.after", self.residual(x, lambda y, n=n: self.attention(n, y, mask))), keep)
            feed = lambda y, n=n: self.dense(f"{n}.down", self.gelu(self.dense(f"{n}.up", y)))
            x = self.masked(self.norm(f"{n}.end", self.residual(x, feed)), keep)
        return self.norm("head.norm", self.gelu(self.dense("head", x)))


def encode(p: Parameters, shape: Shape, ids: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """States after the prediction head's transform, [batch, sequence, hidden]."""
    return _Run(p, shape).hidden(ids, mask)


def logits(p: Parameters, shape: Shape, ids: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """[batch, sequence, vocabulary]; the projection shares the token embedding."""
    return encode(p, shape, ids, mask) @ p["token"].T + p["head.bias"]


def _checked_labels(shape: Shape, labels: np.ndarray, like: np.ndarray) -> np.ndarray:
    if labels.shape != like.shape:
        raise ValueError("labels must have the shape of input_ids")
    if labels.dtype != np.int64:
        raise TypeError("labels must be int64")
    valid = labels != IGNORE
    if not valid.any():
        raise ValueError("no place has a label")
    if (labels[valid] < 0).any() or (labels[valid] >= shape.vocab_size).any():
        raise ValueError("labels are outside the vocabulary")
    return valid


def loss(p: Parameters, shape: Shape, ids: np.ndarray, mask: np.ndarray, labels: np.ndarray) -> tuple[float, int]:
    """(mean loss, labelled places)."""
    value, count, _ = _loss(p, shape, ids, mask, labels, False)
    return value, count


def loss_and_gradients(p: Parameters, shape: Shape, ids: np.ndarray, mask: np.ndarray, labels: np.ndarray) -> tuple[float, int, Parameters]:
    return _loss(p, shape, ids, mask, labels, True)


def _loss(p: Parameters, shape: Shape, ids: np.ndarray, mask: np.ndarray, labels: np.ndarray, learn: bool) -> tuple[float, int, Parameters]:
    valid = _checked_labels(shape, labels, ids)
    run = _Run(p, shape)
    states = run.hidden(ids, mask)
    own, target = states[valid], labels[valid]
    scores = own @ p["token"].T + p["head.bias"]
    top = scores.max(-1, keepdims=True)
    weight = np.exp(scores - top)
    total = weight.sum(-1, keepdims=True)
    n = len(target)
    value = float((np.log(total[:, 0]) + top[:, 0] - scores[np.arange(n), target]).mean())
    if not learn:
        return value, n, {}
    g = weight / total
    g[np.arange(n), target] -= 1
    g /= n
    run._note("token", g.T @ own)
    run._note("head.bias", g.sum(0))
    back = np.zeros_like(states)
    back[valid] = g @ p["token"]
    for step in reversed(run.tape):
        back = step(back)
    return value, n, run.grad


@dataclass
class AdamW:
    """Adam with decoupled weight decay, in place on the parameters."""

    rate: float = 1e-4
    beta1: float = 0.9
    beta2: float = 0.999
    epsilon: float = 1e-8
    decay: float = 0.01

    def __post_init__(self) -> None:
        self.step_count = 0
        self.first: Parameters = {}
        self.second: Parameters = {}

    def step(self, p: Parameters, grad: Parameters) -> None:
        self.step_count += 1
        for name, g in grad.items():
            m = self.first.setdefault(name, np.zeros_like(g))
            v = self.second.setdefault(name, np.zeros_like(g))
            m += (1 - self.beta1) * (g - m)
            v += (1 - self.beta2) * (g * g - v)
            unbiased = m / (1 - self.beta1**self.step_count)
            spread = np.sqrt(v / (1 - self.beta2**self.step_count)) + self.epsilon
            p[name] *= 1 - self.rate * self.decay
            p[name] -= (self.rate * unbiased / spread).astype(p[name].dtype)

    def state(self) -> dict:
        return {"step_count": self.step_count, "first": self.first, "second": self.second}

    def load(self, state: dict) -> None:
        self.step_count, self.first, self.second = state["step_count"], state["first"], state["second"]
