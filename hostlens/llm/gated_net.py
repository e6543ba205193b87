"""A small gated recurrent network with a class-factored softmax, in numpy.

A symbol's probability is that of its class's group, times that of the class within the group, times that within the
class, all from the state. Documents lie one after another on parallel lanes; a lane's state is carried from window to
window and cleared where a document begins, so a document's log-likelihood is complete however long it is. Training
goes back through one window. Where few lanes go on (one document may be as long as many), windows are longer, so that
each holds about as many tokens.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

import numpy as np

UNITS = 16
LANES, WINDOW = 256, 32
#: Tokens that a window holds at least, if lanes go on, when documents are scored; training takes half a full window.
TOKENS = 1 << 15
#: Terms of a softmax, and parameters of a step, at a time: they stay in the processor's cache.
CELLS, STRIDE = 1 << 16, 1 << 15


@dataclass
class Layout:
    """Symbols 0..n-1 with their classes, which do not fall; symbol n stands for the begin of a document."""

    class_of: np.ndarray
    classes: int

    def __post_init__(self) -> None:
        groups = max(1, round(self.classes**0.5))
        self.group_of = np.arange(self.classes) * groups // self.classes
        # Where the symbols of each class begin, and the classes of each group; behind the last, the end.
        self.bounds = np.searchsorted(self.class_of, np.arange(self.classes + 1))
        self.members = np.split(np.arange(len(self.class_of)), self.bounds[1:-1])
        self.parts = np.searchsorted(self.group_of, np.arange(groups + 1))

    @property
    def shapes(self) -> dict[str, tuple[int, ...]]:
        """Of wg, wc and ww, weights of the groups, classes and symbols, the last column is the bias."""
        n, u = len(self.class_of), UNITS
        return {
            "emb": (n + 1, u), "wx": (u, 3 * u), "wh": (u, 3 * u), "b": (3 * u,),
            "wg": (len(self.parts) - 1, u + 1), "wc": (self.classes, u + 1), "ww": (n, u + 1),
        }

    @property
    def size(self) -> int:
        return sum(int(np.prod(s)) for s in self.shapes.values())

    def views(self, flat: np.ndarray) -> dict[str, np.ndarray]:
        out, at = {}, 0
        for name, shape in self.shapes.items():
            n = int(np.prod(shape))
            out[name], at = flat[at : at + n].reshape(shape), at + n
        return out

    def start(self, counts: np.ndarray) -> np.ndarray:
        """Parameters to begin with: small random ones, and the symbols' shares as biases."""
        flat = np.random.default_rng(7).normal(0, 0.15, self.size).astype(np.float32)
        p = self.views(flat)
        held = np.bincount(self.class_of, counts + 1.0, self.classes)
        p["ww"][:, UNITS] = np.log(counts + 1.0) - np.log(held[self.class_of])
        group = np.bincount(self.group_of, held)
        p["wc"][:, UNITS] = np.where(held > 0, np.log(np.maximum(held, 1.0)) - np.log(np.maximum(group, 1.0))[self.group_of], -30.0)
        p["wg"][:, UNITS] = np.where(group > 0, np.log(np.maximum(group, 1.0)) - np.log(group.sum()), -30.0)
        p["b"][:] = 0
        return flat


def lanes(documents: list[np.ndarray], count: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """targets, document numbers and begins, each steps x lanes; -1 where a lane has ended."""
    load = [(0, k) for k in range(count)]
    held: list[list[int]] = [[] for _ in range(count)]
    for i in sorted(range(len(documents)), key=lambda i: -len(documents[i])):
        size, lane = heapq.heappop(load)
        held[lane].append(i)
        heapq.heappush(load, (size + len(documents[i]), lane))
    held = [held[k] for _, k in sorted(load, reverse=True)]  # the longest lane first
    steps = max(size for size, _ in load)
    target, owner = np.full((count, steps), -1, np.int32), np.full((count, steps), -1, np.int32)
    begin = np.zeros((count, steps), bool)
    for lane, own in enumerate(held):
        at = 0
        for i in own:
            n = len(documents[i])
            target[lane, at : at + n], owner[lane, at : at + n], begin[lane, at] = documents[i], i, True
            at += n
    return target.T, owner.T, begin.T


def _sigmoid(x: np.ndarray) -> np.ndarray:
    np.negative(x, out=x)
    np.exp(np.minimum(x, 30, out=x), out=x)
    x += 1
    return np.reciprocal(x, out=x)


class Net:
    def __init__(self, layout: Layout, flat: np.ndarray):
        self.layout, self.flat = layout, flat
        self.p = layout.views(flat)

    def _forward(self, h: np.ndarray, inputs: np.ndarray, keep: np.ndarray):
        p, u = self.p, UNITS
        x = p["emb"][inputs]
        xg = (x.reshape(-1, u) @ p["wx"] + p["b"]).reshape(*inputs.shape, 3 * u)
        begins = (keep == 0).any(axis=1)
        states, before, new, hn = (np.empty((*inputs.shape, u), np.float32) for _ in range(4))
        rz = np.empty((*inputs.shape, 2 * u), np.float32)
        for t in range(len(inputs)):
            if begins[t]:
                h = h * keep[t][:, None]
            before[t] = h
            hg = h @ p["wh"]
            gates = _sigmoid(np.add(xg[t, :, : 2 * u], hg[:, : 2 * u], out=rz[t]))
            hn[t] = hg[:, 2 * u :]
            n = np.multiply(gates[:, :u], hn[t], out=new[t])
            n += xg[t, :, 2 * u :]
            np.tanh(n, out=n)
            h = np.subtract(h, n, out=states[t])
            h *= gates[:, u:]
            h += n
        return h, states, x, (begins, before, rz, new, hn)

    def _level(self, name: str, rows: np.ndarray, at: np.ndarray, bounds: np.ndarray, log_p: np.ndarray, back: np.ndarray, gradients=None):
        """Adds to each row's log-probability that of ``at`` (which does not fall) among the weights of its part, and
        to ``back`` the gradients of the states; a part is what lies between two bounds."""
        ends = np.searchsorted(at, bounds)
        place = at - np.repeat(bounds[:-1], np.diff(ends))
        # A part of one symbol has nothing to choose.
        for k in np.flatnonzero((np.diff(ends) > 0) & (np.diff(bounds) > 1)):
            part = slice(bounds[k], bounds[k + 1])
            w = self.p[name][part]
            ones, most = np.ones(len(w), np.float32), max(64, CELLS // len(w))
            for begin in range(ends[k], ends[k + 1], most):
                cut = slice(begin, min(begin + most, ends[k + 1]))
                h = rows[cut]
                e = h @ w.T
                e.clip(-50, 50, out=e)
                chosen = np.arange(0, e.size, len(w)) + place[cut]
                cells = e.reshape(-1)
                log_p[cut] += cells[chosen]
                np.exp(e, out=e)
                sums = e @ ones  # faster than a sum by rows
                log_p[cut] -= np.log(sums)
                if gradients is not None:
                    e *= (1 / sums)[:, None]
                    cells[chosen] -= 1
                    back[cut] += e @ w[:, :UNITS]
                    gradients[name][part] += e.T @ h

    def _output(self, h: np.ndarray, target: np.ndarray, gradients: dict[str, np.ndarray] | None = None):
        """Natural log-probability of each target; with gradients, adds to them and returns the states' too."""
        layout = self.layout
        # Rows by symbol, so that those of a class lie side by side.
        order = np.argsort(target.astype(np.min_scalar_type(len(layout.class_of))), kind="stable")
        rows = np.empty((len(h), UNITS + 1), np.float32)
        rows[:, :UNITS], rows[:, UNITS] = h[order], 1
        symbol = target[order].astype(np.int64)
        cls = layout.class_of[symbol]
        found, back = np.zeros(len(h), np.float32), np.zeros((len(h), UNITS), np.float32)
        every = np.array([0, len(layout.parts) - 1])
        for name, at, bounds in (("wg", layout.group_of[cls], every), ("wc", cls, layout.parts), ("ww", symbol, layout.bounds)):
            self._level(name, rows, at, bounds, found, back, gradients)
        log_p, dh = np.empty_like(found), np.empty_like(back)
        log_p[order], dh[order] = found, back
        return log_p, dh

    def _windows(self, documents: list[np.ndarray], count: int, width: int, tokens: int = 1):
        target, owner, begin = lanes(documents, count)
        start = len(self.layout.class_of)
        at = end = 0
        while end < len(target):
            at = end
            live = int((target[at] >= 0).sum())  # lanes that go on, which are the first ones
            end = at + max(width, tokens // live)
            t = target[at:end, :live]
            inputs = np.full(t.shape, start, np.int64)
            if at:
                inputs[0] = target[at - 1, :live]
            inputs[1:] = np.where(t[:-1] < 0, start, t[:-1])
            b = begin[at:end, :live]
            inputs[b] = start
            yield t, owner[at:end, :live], inputs, (~b).astype(np.float32)

    def score(self, documents: list[np.ndarray]) -> np.ndarray:
        """Natural log-likelihood of each sequence of symbols."""
        out = np.zeros(len(documents))
        count = min(LANES, max(1, len(documents)))
        h = np.zeros((count, UNITS), np.float32)
        for target, owner, inputs, keep in self._windows(documents, count, 2 * WINDOW, TOKENS):
            h, states, _, _ = self._forward(h[: target.shape[1]], inputs, keep)
            valid = target >= 0
            log_p, _ = self._output(states[valid], target[valid])
            out += np.bincount(owner[valid], log_p, len(documents))
        return out

    def _gradient(self, h, target, inputs, keep):
        p, u = self.p, UNITS
        flat = np.zeros(self.layout.size, np.float32)
        g = self.layout.views(flat)
        last, states, x, trace = self._forward(h, inputs, keep)
        valid = target >= 0
        log_p, d = self._output(states[valid], target[valid], g)
        ds = np.zeros_like(states)
        ds[valid] = d
        begins, before, rz, new, hn = trace
        r, z = rz[..., :u], rz[..., u:]
        # What a state's gradient is multiplied by, for all steps at once; only the sum over time runs step by step.
        by_new = (1 - z) * (1 - new * new)
        by_r, by_z = by_new * hn * r * (1 - r), (before - new) * z * (1 - z)
        factors = np.concatenate([by_r, by_z, by_new * r], axis=2).reshape(*target.shape, 3, u)
        dhg, dhs = np.empty((*target.shape, 3, u), np.float32), np.empty_like(states)
        back, wh = np.zeros_like(h), np.ascontiguousarray(p["wh"].T)
        for t in range(len(target) - 1, -1, -1):
            dh = np.add(ds[t], back, out=dhs[t])
            g_t = np.multiply(dh[:, None, :], factors[t], out=dhg[t])
            back = g_t.reshape(-1, 3 * u) @ wh
            back += dh * z[t]
            if begins[t]:
                back *= keep[t][:, None]
        g["wh"] += before.reshape(-1, u).T @ dhg.reshape(-1, 3 * u)
        dhg[:, :, 2] = dhs * by_new
        flat_dx = dhg.reshape(-1, 3 * u)
        g["wx"] += x.reshape(-1, u).T @ flat_dx
        g["b"] += flat_dx.sum(axis=0)
        ids = inputs.ravel().astype(np.min_scalar_type(len(g["emb"])))
        order = np.argsort(ids, kind="stable")
        ids = ids[order]
        first = np.flatnonzero(np.diff(ids, prepend=ids[:1] + 1))
        g["emb"][ids[first]] = np.add.reduceat((flat_dx @ p["wx"].T)[order], first, axis=0)
        return last, flat, log_p

    def learn(self, documents: list[np.ndarray], memory: dict, rate: float) -> None:
        """One pass over the documents, by Adam; memory carries its averages between calls. Of the embeddings, most
        of which a window does not meet, only the rows that it meets are moved."""
        count = min(2 * LANES, max(1, len(documents)))
        h = np.zeros((count, UNITS), np.float32)
        m = memory.setdefault("m", np.zeros_like(self.flat))
        v = memory.setdefault("v", np.zeros_like(self.flat))
        rows = self.p["emb"].size
        tables = [a[:rows].reshape(-1, UNITS) for a in (self.flat, m, v)]
        for target, _, inputs, keep in self._windows(documents, count, WINDOW, count * WINDOW // 2):
            n = int((target >= 0).sum())
            h, g, _ = self._gradient(h[: target.shape[1]], target, inputs, keep)
            memory["t"] = step = memory.get("t", 0) + 1
            # A window with few tokens moves the parameters little.
            size = rate * min(1.0, n / (0.5 * count * WINDOW))
            met = np.zeros(len(tables[0]), bool)
            met[inputs.ravel()] = True
            met = np.flatnonzero(met)
            own = [a[met] for a in tables]
            _adam(*own, g[:rows].reshape(-1, UNITS)[met], n, size, step)
            for a, part in zip(tables, own, strict=True):
                a[met] = part
            for at in range(rows, len(g), STRIDE):
                _adam(*(a[at : at + STRIDE] for a in (self.flat, m, v, g)), n, size, step)


def _adam(flat: np.ndarray, m: np.ndarray, v: np.ndarray, g: np.ndarray, tokens: int, size: float, step: int) -> None:
    g *= np.float32(1 / max(tokens, 1))
    m *= np.float32(0.9)
    m += np.float32(0.1) * g
    g *= g
    g *= np.float32(0.001)
    v *= np.float32(0.999)
    v += g
    np.multiply(v, np.float32(1 / (1 - 0.999**step)), out=g)
    np.sqrt(g, out=g)
    g += np.float32(1e-8)
    np.divide(m, g, out=g)
    g *= np.float32(size / (1 - 0.9**step))
    flat -= g
