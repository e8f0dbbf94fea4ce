"""A gated recurrent language model in numpy with a class-factored softmax, trained by truncated backpropagation through time."""

from __future__ import annotations

import numpy as np


def _softmax(x: np.ndarray) -> np.ndarray:
    """In place; row by row."""
    np.exp(np.minimum(x, 60, out=x), out=x)
    x /= x @ np.ones((x.shape[1], 1), x.dtype)
    return x


class Recurrent:
    """Tokens 0 to classes * width - 1; class c has tokens c * width to (c + 1) * width - 1. Inputs: the token before, `start` at first.

    P(token | h) = P(class | h) P(token | class, h); h is a gated recurrent unit's state. Columns of `x` and `b` are those of the reset gate, the
    update gate and the new state; columns of `u` those of the new state, the reset gate and the update gate."""

    def __init__(self, classes: int, width: int, hidden: int, counts: np.ndarray, seed: int = 1):
        rng = np.random.default_rng(seed)
        self.classes, self.width, self.hidden = classes, width, hidden
        n = classes * width
        self.start = n
        scale = lambda *s: rng.standard_normal(s) * 0.1
        share = np.log((counts + 0.5) / (counts.sum() + 0.5 * n)).reshape(classes, width)
        top = np.log(np.exp(share).sum(1))
        made = {
            "x": scale(n + 1, 3 * hidden), "u": scale(hidden, 3 * hidden), "b": np.zeros(3 * hidden),
            "wc": scale(hidden, classes), "bc": top, "wt": scale(classes, hidden, width), "bt": share - top[:, None],
        }
        self.shapes = {k: v.shape for k, v in made.items()}
        self.put(np.concatenate([v.ravel() for v in made.values()]))
        self.restart()

    def put(self, flat: np.ndarray, kind: type = np.float32) -> None:
        """Takes all weights from one row."""
        self.flat = flat.astype(kind)
        self.p = self._views(self.flat)

    def _views(self, flat: np.ndarray) -> dict[str, np.ndarray]:
        out, at = {}, 0
        for k, shape in self.shapes.items():
            size = int(np.prod(shape))
            out[k] = flat[at : at + size].reshape(shape)
            at += size
        return out

    def __getstate__(self) -> dict:
        """Weights alone; moments are those of a course of training."""
        return {k: v for k, v in self.__dict__.items() if k not in ("p", "moments")}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        self.put(self.flat, self.flat.dtype.type)
        self.restart()

    def restart(self) -> None:
        """Forgets the moments of the updates so far."""
        self.moments, self.steps = (np.zeros_like(self.flat), np.zeros_like(self.flat)), 0

    def _halved(self) -> tuple[np.ndarray, np.ndarray]:
        """`x` with `b`, and `u` by columns; both with the gates' parts halved, since a gate is (1 + tanh(a / 2)) / 2."""
        k = self.hidden
        x, u = self.p["x"] + self.p["b"], np.ascontiguousarray(self.p["u"].T)
        x[:, : 2 * k] *= 0.5
        u[k:] *= 0.5
        return x, u

    def step(self, a: np.ndarray, h: np.ndarray, un: np.ndarray, out: np.ndarray) -> None:
        """Puts into `out` the state after inputs whose rows of `_halved` are the columns of `a`, from the states `h`, where un is u h. Lanes are
        columns, so that each gate is one stretch of memory. `a` becomes the gates and the new state; `out` is used on the way."""
        k = self.hidden
        gates, new = a[: 2 * k], a[2 * k :]
        gates += un[k:]
        np.tanh(gates, out=gates)
        gates *= 0.5
        gates += 0.5
        np.multiply(gates[:k], un[:k], out=out)
        new += out
        np.tanh(new, out=new)
        np.subtract(h, new, out=out)
        out *= gates[k:]
        out += new

    def _by_class(self, tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Classes, the order that brings tokens of a class together, and where each class begins in it."""
        cls = (tokens // self.width).astype(np.uint8 if self.classes < 256 else np.int64)
        order = np.argsort(cls, kind="stable")
        return cls, order, np.searchsorted(cls[order], np.arange(self.classes + 1))

    def log_p(self, h: np.ndarray, token: np.ndarray) -> np.ndarray:
        """Natural log of P(token | h), row by row; tokens of a class are taken together."""
        out = np.empty(len(token), np.float64)
        for a in range(0, len(token), 16_384):
            out[a : a + 16_384] = self._log_p(h[a : a + 16_384], token[a : a + 16_384])
        return out

    def _log_p(self, h: np.ndarray, token: np.ndarray) -> np.ndarray:
        p = self.p
        cls, order, cuts = self._by_class(token)
        hs, cls, y, rows = h[order], cls[order], token[order], np.arange(len(h))
        low = np.empty((len(h), self.width), hs.dtype)
        for c in range(self.classes):
            if cuts[c] < cuts[c + 1]:
                np.matmul(hs[cuts[c] : cuts[c + 1]], p["wt"][c], out=low[cuts[c] : cuts[c + 1]])
        low += p["bt"][cls]
        top = hs @ p["wc"]
        top += p["bc"]
        found = np.ones(len(h))
        for x, at in ((top, cls), (low, y - cls.astype(y.dtype) * self.width)):
            np.exp(np.minimum(x, 60, out=x), out=x)
            found *= x[rows, at] / (x @ np.ones(x.shape[1], x.dtype))
        out = np.empty(len(token), np.float64)
        out[order] = np.log(np.maximum(found, 1e-300))
        return out

    def gradients(self, tokens: np.ndarray, before: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The gradient by all weights in a row of the loss a token of tokens (time, lane) after `before` (the inputs) from states h (a lane is
        a column), and the states at the end. Where the input is the start, the state before it is dropped, as in scoring."""
        p, k, kind = self.p, self.hidden, self.flat.dtype
        t, b = tokens.shape
        n = t * b
        x, u = self._halved()
        a = np.ascontiguousarray(x[before].transpose(0, 2, 1))  # becomes the reset gate, the update gate and the new state
        live = before != self.start
        goes_on = live.all(1)
        un = np.empty((t, 3 * k, b), kind)
        ins, outs = np.empty((t, k, b), kind), np.empty((t, k, b), kind)
        for i in range(t):
            np.copyto(ins[i], outs[i - 1] if i else h)
            if not goes_on[i]:
                ins[i] *= live[i]
            np.matmul(u, ins[i], out=un[i])
            self.step(a[i], ins[i], un[i], outs[i])
        flat = np.zeros_like(self.flat)
        g = self._views(flat)
        # Tokens of a class are taken together, in the order of classes.
        y = tokens.reshape(-1)
        cls, order, cuts = self._by_class(y)
        hs, y, cls = outs.transpose(0, 2, 1).reshape(n, k)[order], y[order], cls[order]
        rows = np.arange(n)
        top = hs @ p["wc"]
        top += p["bc"]
        _softmax(top)
        top[rows, cls] -= 1
        top /= n
        g["wc"][:], g["bc"][:] = hs.T @ top, top.sum(0)
        dhs = top @ p["wc"].T
        low = np.empty((n, self.width), kind)
        some = [(c, slice(cuts[c], cuts[c + 1])) for c in range(self.classes) if cuts[c] < cuts[c + 1]]
        for c, at in some:
            np.matmul(hs[at], p["wt"][c], out=low[at])
        low += p["bt"][cls]
        _softmax(low)
        low[rows, y - cls.astype(y.dtype) * self.width] -= 1
        low /= n
        back, add = np.empty_like(dhs), np.ones((1, n), kind)
        for c, at in some:
            np.matmul(hs[at].T, low[at], out=g["wt"][c])
            np.matmul(add[:, at], low[at], out=g["bt"][c : c + 1])
            np.matmul(low[at], p["wt"][c].T, out=back[at])
        dhs += back
        dall = np.empty_like(dhs)
        dall[order] = dhs
        dall = np.ascontiguousarray(dall.reshape(t, b, k).transpose(0, 2, 1))
        r, z, new = a[:, :k], a[:, k : 2 * k], a[:, 2 * k :]
        keep = 1 - z
        by_z = ins - new
        by_z *= z
        by_z *= keep
        by_new = new * new
        np.subtract(1, by_new, out=by_new)
        by_new *= keep
        by_r = 1 - r
        by_r *= r
        by_r *= un[:, :k]
        d = np.empty((t, 4 * k, b), kind)  # by the new state's part of u h, by the gates, by the new state
        dh, tmp = np.zeros((k, b), kind), np.empty((k, b), kind)
        for i in range(t - 1, -1, -1):
            dh += dall[i]
            di = d[i]
            dn = di[3 * k :]
            np.multiply(dh, by_new[i], out=dn)
            np.multiply(dn, r[i], out=di[:k])
            np.multiply(dn, by_r[i], out=di[k : 2 * k])
            np.multiply(dh, by_z[i], out=di[2 * k : 3 * k])
            dh *= z[i]
            np.matmul(p["u"], di[: 3 * k], out=tmp)
            dh += tmp
            if not goes_on[i]:
                dh *= live[i]
        by_u, by_x = (x.transpose(0, 2, 1).reshape(n, 3 * k) for x in (d[:, : 3 * k], d[:, k:]))
        inputs = before.reshape(-1).astype(np.uint16 if self.start < 65_536 else np.int64)
        by = np.argsort(inputs, kind="stable")
        met = np.flatnonzero(np.diff(inputs[by], prepend=-1))
        sums = np.add.reduceat(by_x.take(by, 0), met, 0)
        g["x"][inputs[by[met]]] = sums
        g["b"][:] = sums.sum(0)
        g["u"][:] = ins.transpose(0, 2, 1).reshape(n, k).T @ by_u
        return flat, outs[-1]

    def window(self, tokens: np.ndarray, before: np.ndarray, h: np.ndarray, rate: float) -> np.ndarray:
        """One update, by moments of gradients that are clipped to norm 1; the states at the end."""
        g, h = self.gradients(tokens, before, h)
        g *= min(1.0, 1.0 / (float(np.sqrt(g @ g)) + 1e-9))
        self.steps += 1
        m, s = self.moments
        m *= 0.9
        g *= 0.1
        m += g
        g *= g
        s *= 0.99
        s += g  # a hundredth of the square
        np.sqrt(s, out=g)
        g *= 1 / np.sqrt(1 - 0.99**self.steps)
        g += 1e-8
        np.divide(m, g, out=g)
        g *= rate / (1 - 0.9**self.steps)
        self.flat -= g
        return h

    def follow(self, docs: list[np.ndarray], rates: tuple[float, float], lanes: int = 128, length: int = 24) -> None:
        """Goes once over all documents, at a rate that falls from the first to the second. They are laid one after the other and cut into lanes
        of one length; fewer tokens than there are lanes are met twice."""
        docs = [d for d in docs if len(d)]
        if not docs:
            return
        tokens = np.concatenate(docs).astype(np.int64)
        before = np.concatenate([[self.start], tokens[:-1]])
        before[np.cumsum([0, *map(len, docs[:-1])])] = self.start
        lanes = min(lanes, -(-len(tokens) // length))
        each = -(-len(tokens) // lanes)
        tokens, before = (np.ascontiguousarray(np.resize(x, lanes * each).reshape(lanes, each).T) for x in (tokens, before))
        h = np.zeros((self.hidden, lanes), self.flat.dtype)
        for i in range(0, each, length):
            h = self.window(tokens[i : i + length], before[i : i + length], h, rates[0] + (rates[1] - rates[0]) * i / each)

    def fit(self, docs: list[np.ndarray], least: int, rates: tuple[float, float], lanes: int = 64) -> None:
        """Goes over all documents as often as it takes to meet `least` tokens, at a rate that falls from the first to the second."""
        n = sum(map(len, docs))
        times = -(-least // n) if n else 0
        for i in range(times):
            at = [rates[0] + (rates[1] - rates[0]) * j / times for j in (i, i + 1)]
            self.follow(docs, (at[0], at[1]), lanes)

    def score(self, docs: list[np.ndarray], cells: int = 65_536) -> list[np.ndarray]:
        """ln P of every token of each document, whole documents; states are carried across windows of about `cells` tokens. Documents run side by
        side, longest first; a window's lanes are the documents that reach into it, and what lies beyond a document's end is not looked at."""
        order = sorted(range(len(docs)), key=lambda i: -len(docs[i]))
        out = [np.zeros(len(d)) for d in docs]
        k, kind = self.hidden, self.flat.dtype
        x, u = self._halved()
        for lo in range(0, len(order), 4096):
            group = order[lo : lo + 4096]
            sizes = np.array([len(docs[i]) for i in group])
            ends = np.cumsum(sizes)
            flat = np.concatenate([docs[i] for i in group]).astype(np.int64)
            starts = ends - sizes
            result = np.zeros(len(flat))
            h, t = np.zeros((k, len(group)), kind), 0
            while len(group) and t < sizes[0]:
                live = int(np.searchsorted(-sizes, -t, "left"))  # documents longer than t come first
                steps = min(max(1, cells // live), 512 if live <= 16 else 48, int(sizes[0]) - t)
                at = starts[:live] + np.arange(t, t + steps)[:, None]
                inside = at < ends[:live]
                before = flat[np.clip(at - 1, 0, len(flat) - 1)]
                if t == 0:
                    before[0] = self.start
                a = np.ascontiguousarray(x[before].transpose(0, 2, 1))
                un, outs, past = np.empty((3 * k, live), kind), np.empty((steps, k, live), kind), np.ascontiguousarray(h[:, :live])
                for i in range(steps):
                    np.matmul(u, past, out=un)
                    self.step(a[i], past, un, outs[i])
                    past = outs[i]
                at = at[inside]
                result[at] = self.log_p(outs.transpose(0, 2, 1)[inside], flat[at])
                h, t = past, t + steps
            for i, a, b in zip(group, starts, ends, strict=True):
                out[i] = result[a:b]
        return out
