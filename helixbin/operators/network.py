"""The siamese network in numpy: composition, coverage and merged models, their gradients, and training.

Trunk: composition h = relu(W1 x + b1); coverage h = relu(W1 flatten(relu(conv1d(x))) + b1). Head on two latents:
s(a, b) = relu(W2 [a; b] + b2), m = max(s(a, b), s(b, a)), p = sigmoid(W3 m + b3), so p is symmetric. The merged model adds
p = sigmoid(W5 relu(W4 [m_composition; m_coverage] + b4) + b5).
"""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -60, 60)))


def _layer(rng: np.random.Generator, n_in: int, n_out: int) -> tuple[np.ndarray, np.ndarray]:
    bound = 1 / np.sqrt(n_in)
    return rng.uniform(-bound, bound, (n_out, n_in)), rng.uniform(-bound, bound, n_out)


@dataclass
class Branch:
    """One feature's trunk and head. shape: (k-mers,) or (windows, samples)."""

    shape: tuple[int, ...]
    neurons: tuple[int, int] = (64, 32)
    filters: int = 16
    kernel: int = 4
    stride: int = 2
    seed: int = 0
    w: dict[str, np.ndarray] = field(default_factory=dict)

    def __post_init__(self) -> None:
        rng = np.random.default_rng(self.seed)
        width = self.shape[0]
        if self.convolves:
            n, samples = self.shape
            bound = 1 / np.sqrt(samples * self.kernel)
            self.w["wc"], self.w["bc"] = rng.uniform(-bound, bound, (self.filters, samples, self.kernel)), rng.uniform(-bound, bound, self.filters)
            width = self.filters * ((n - self.kernel) // self.stride + 1)
        for name, n_in, n_out in (("1", width, self.neurons[0]), ("2", 2 * self.neurons[0], self.neurons[1]), ("3", self.neurons[1], 1)):
            self.w["w" + name], self.w["b" + name] = _layer(rng, n_in, n_out)

    @property
    def convolves(self) -> bool:
        return len(self.shape) == 2

    def _windows(self, x: np.ndarray) -> np.ndarray:
        """(rows, positions, samples, kernel) of x (rows, samples, windows)."""
        return np.lib.stride_tricks.sliding_window_view(x, self.kernel, axis=2)[:, :, :: self.stride].transpose(0, 2, 1, 3)

    def trunk(self, x: np.ndarray) -> tuple[np.ndarray, tuple]:
        flat, saved = x, None
        if self.convolves:
            win = self._windows(x)
            conv = np.maximum(np.einsum("npsk,fsk->nfp", win, self.w["wc"]) + self.w["bc"][None, :, None], 0)
            flat, saved = conv.reshape(len(x), -1), (win, conv)
        h = np.maximum(flat @ self.w["w1"].T + self.w["b1"], 0)
        return h, (flat, h, saved)

    def trunk_back(self, g: np.ndarray, saved: tuple, grads: dict[str, np.ndarray]) -> None:
        flat, h, conv = saved
        g = g * (h > 0)
        grads["w1"] += g.T @ flat
        grads["b1"] += g.sum(0)
        if conv is not None:
            win, out = conv
            gc = (g @ self.w["w1"]).reshape(out.shape) * (out > 0)
            grads["wc"] += np.einsum("nfp,npsk->fsk", gc, win)
            grads["bc"] += gc.sum((0, 2))

    def merged(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, tuple]:
        """m = max(s(a, b), s(b, a))."""
        ab, ba = np.concatenate([a, b], 1), np.concatenate([b, a], 1)
        s1 = np.maximum(ab @ self.w["w2"].T + self.w["b2"], 0)
        s2 = np.maximum(ba @ self.w["w2"].T + self.w["b2"], 0)
        return np.maximum(s1, s2), (ab, ba, s1, s2)

    def merged_back(self, g: np.ndarray, saved: tuple, grads: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        ab, ba, s1, s2 = saved
        one = s1 >= s2
        g1, g2 = g * one * (s1 > 0), g * ~one * (s2 > 0)
        grads["w2"] += g1.T @ ab + g2.T @ ba
        grads["b2"] += g1.sum(0) + g2.sum(0)
        n = self.neurons[0]
        d1, d2 = g1 @ self.w["w2"], g2 @ self.w["w2"]
        return d1[:, :n] + d2[:, n:], d1[:, n:] + d2[:, :n]

    def probability(self, m: np.ndarray) -> np.ndarray:
        return _sigmoid(m @ self.w["w3"].T + self.w["b3"])[:, 0]


@dataclass
class Model:
    """A composition branch, a coverage branch, or both with a merging head."""

    branches: dict[str, Branch]
    merge_neurons: int = 32
    seed: int = 0
    w: dict[str, np.ndarray] = field(default_factory=dict)

    def __post_init__(self) -> None:
        if len(self.branches) > 1:
            rng = np.random.default_rng(self.seed + 1000)
            total = sum(b.neurons[1] for b in self.branches.values())
            self.w["w4"], self.w["b4"] = _layer(rng, total, self.merge_neurons)
            self.w["w5"], self.w["b5"] = _layer(rng, self.merge_neurons, 1)

    def latent(self, feature: str, x: np.ndarray) -> np.ndarray:
        return self.branches[feature].trunk(x)[0]

    def combine(self, lefts: list[np.ndarray], rights: list[np.ndarray]) -> np.ndarray:
        """Probability of each row from latents; one feature alone uses its own probability head."""
        ms = [b.merged(x, y)[0] for b, x, y in zip(self.branches.values(), lefts, rights)]
        if len(ms) == 1:
            return next(iter(self.branches.values())).probability(ms[0])
        h = np.maximum(np.concatenate(ms, 1) @ self.w["w4"].T + self.w["b4"], 0)
        return _sigmoid(h @ self.w["w5"].T + self.w["b5"])[:, 0]

    def forward(self, a: dict[str, np.ndarray], b: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
        out, lefts, rights = {}, [], []
        for name, branch in self.branches.items():
            x, y = branch.trunk(a[name])[0], branch.trunk(b[name])[0]
            lefts.append(x)
            rights.append(y)
            out[name] = branch.probability(branch.merged(x, y)[0])
        if len(self.branches) > 1:
            out["combined"] = self.combine(lefts, rights)
        return out

    def loss(self, p: dict[str, np.ndarray], y: np.ndarray) -> float:
        """Mean binary cross-entropy; with two features their sum plus twice the combined one."""
        return sum((2.0 if k == "combined" else 1.0) * bce(v, y) for k, v in p.items())

    def gradients(self, a: dict[str, np.ndarray], b: dict[str, np.ndarray], y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        n = len(y)
        grads = {k: np.zeros_like(v) for k, v in self.parameters().items()}
        own = {name: {k: grads[f"{name}.{k}"] for k in branch.w} for name, branch in self.branches.items()}
        saved, probs, ms = {}, {}, {}
        for name, branch in self.branches.items():
            ha, sa = branch.trunk(a[name])
            hb, sb = branch.trunk(b[name])
            m, sm = branch.merged(ha, hb)
            saved[name], ms[name], probs[name] = (sa, sb, sm), m, branch.probability(m)
        gm = {}
        for name, branch in self.branches.items():
            e = ((probs[name] - y) / n)[:, None]
            own[name]["w3"] += e.T @ ms[name]
            own[name]["b3"] += e.sum(0)
            gm[name] = e @ branch.w["w3"]
        if len(self.branches) > 1:
            joined = np.concatenate(list(ms.values()), 1)
            h = np.maximum(joined @ self.w["w4"].T + self.w["b4"], 0)
            probs["combined"] = _sigmoid(h @ self.w["w5"].T + self.w["b5"])[:, 0]
            e = (2 * (probs["combined"] - y) / n)[:, None]
            grads["w5"] += e.T @ h
            grads["b5"] += e.sum(0)
            gh = (e @ self.w["w5"]) * (h > 0)
            grads["w4"] += gh.T @ joined
            grads["b4"] += gh.sum(0)
            back, at = gh @ self.w["w4"], 0
            for name, branch in self.branches.items():
                gm[name] = gm[name] + back[:, at : at + branch.neurons[1]]
                at += branch.neurons[1]
        for name, branch in self.branches.items():
            sa, sb, sm = saved[name]
            ga, gb = branch.merged_back(gm[name], sm, own[name])
            branch.trunk_back(ga, sa, own[name])
            branch.trunk_back(gb, sb, own[name])
        return self.loss(probs, y), grads

    def parameters(self) -> dict[str, np.ndarray]:
        return {**{f"{n}.{k}": v for n, b in self.branches.items() for k, v in b.w.items()}, **self.w}

    def save(self, path: str) -> None:
        np.savez(path, **self.parameters())

    def load(self, path: str) -> None:
        with np.load(path) as found:
            own = self.parameters()
            if set(found.files) != set(own) or any(found[k].shape != v.shape for k, v in own.items()):
                raise RuntimeError("the checkpoint belongs to another architecture")
            for k, v in own.items():
                v[...] = found[k]


def bce(p: np.ndarray, y: np.ndarray) -> float:
    with np.errstate(divide="ignore"):
        return float(-np.mean(y * np.maximum(np.log(p), -100) + (1 - y) * np.maximum(np.log(1 - p), -100)))


def scores(p: dict[str, np.ndarray], y: np.ndarray) -> dict[str, dict[str, float]]:
    """Accuracy and shares of false positives and negatives of each head, by prediction over 0.5."""
    out = {}
    for k, v in p.items():
        hit = v > 0.5
        out[k] = {"acc": float(np.mean(hit == (y == 1))), "fp": float(np.mean(hit & (y == 0))), "fn": float(np.mean(~hit & (y == 1)))}
    return out


Batch = tuple[dict[str, np.ndarray], dict[str, np.ndarray], np.ndarray]


def train(model: Model, batches: Callable[[], Iterator[Batch]], test: Batch | Callable[[], float], learning_rate: float = 1e-3, test_batch: int = 400, patience: int = 5, n_batches: int | None = None) -> list[float]:
    """One epoch of Adam. The test is a batch, or what gives its loss. Every test_batch batches, and after the last, the test loss is taken: the best weights are kept,
    and training stops when the oldest of the last patience losses is the least. Returns the losses."""
    m1 = {k: np.zeros_like(v) for k, v in model.parameters().items()}
    m2 = {k: np.zeros_like(v) for k, v in model.parameters().items()}
    last: deque[float] = deque(maxlen=patience)
    losses: list[float] = []
    best: dict[str, np.ndarray] | None = None
    for t, (a, b, y) in enumerate(batches(), 1):
        _, grads = model.gradients(a, b, y)
        for k, v in model.parameters().items():
            m1[k] = 0.9 * m1[k] + 0.1 * grads[k]
            m2[k] = 0.999 * m2[k] + 0.001 * grads[k] ** 2
            v -= learning_rate * (m1[k] / (1 - 0.9**t)) / (np.sqrt(m2[k] / (1 - 0.999**t)) + 1e-8)
        if t % test_batch == 0 or t == n_batches:
            if callable(test):
                loss = test()
            else:
                p = model.forward(test[0], test[1])
                loss = bce(p["combined"] if "combined" in p else next(iter(p.values())), test[2])
            if not losses or loss <= min(losses):
                best = {k: v.copy() for k, v in model.parameters().items()}
            losses.append(loss)
            last.append(loss)
            if len(last) == patience and last[0] == min(last):
                break
    if best:
        for k, v in model.parameters().items():
            v[...] = best[k]
    return losses
