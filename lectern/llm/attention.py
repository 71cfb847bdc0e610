"""A small causal self-attention model over subword numbers, in numpy: scores, gradients, training.

One layer: token and place embeddings, masked attention, a hidden layer, both with residuals, a
root-mean-square norm, and a softmax in two steps, over groups of tokens and over the tokens of
the target's group, so that a position costs two short rows instead of one over all tokens.
"""

from __future__ import annotations

import math

import numpy as np

#: Positions of one step of training or scoring, so that arrays stay in a core's cache.
POSITIONS = 6144
_EPS = np.float32(1e-5)


class Shape:
    """Sizes of a model: tokens (groups * members), width, hidden width, window."""

    def __init__(self, groups: int = 32, members: int = 32, width: int = 24, hidden: int = 48, window: int = 32):
        self.groups, self.members, self.width, self.hidden, self.window = groups, members, width, hidden, window
        self.tokens = groups * members
        d = width
        self.parts = {
            "emb": (self.tokens, d), "pos": (window, d), "qkv": (d, 3 * d), "out": (d, d), "w1": (d, hidden), "b1": (hidden,), "w2": (hidden, d), "b2": (d,),
            "gain": (d,), "wg": (d, groups), "bg": (groups,), "wm": (groups, d, members), "bm": (groups, members),
        }
        self.size = sum(map(math.prod, self.parts.values()))

    def views(self, flat: np.ndarray) -> dict[str, np.ndarray]:
        out, lo = {}, 0
        for name, shape in self.parts.items():
            n = math.prod(shape)
            out[name] = flat[lo : lo + n].reshape(shape)
            lo += n
        return out


def start(shape: Shape, counts: np.ndarray, seed: int = 5) -> np.ndarray:
    """First weights: small random ones, with the tokens' frequencies as output biases."""
    rng, flat = np.random.Generator(np.random.PCG64(seed)), np.zeros(shape.size, np.float32)
    w, d = shape.views(flat), shape.width
    for name, scale in (("emb", 0.3), ("pos", 0.1), ("qkv", d**-0.5), ("out", 0.3 * d**-0.5), ("w1", d**-0.5), ("w2", 0.3 * shape.hidden**-0.5), ("wg", 0.1), ("wm", 0.1)):
        w[name][:] = rng.normal(0, scale, w[name].shape)
    w["gain"][:] = 1
    c = (counts + 1.0).reshape(shape.groups, shape.members)
    w["bg"][:] = np.log(c.sum(axis=1) / c.sum())
    w["bm"][:] = np.log(c / c.sum(axis=1, keepdims=True))
    return flat


def keep_memory() -> None:
    """Let the C library keep what arrays free: one large free raises its limit, and steps don't fault pages in again."""
    np.empty(31 << 20, np.uint8)


def _rows(x: np.ndarray, at: np.ndarray) -> np.ndarray:
    """x[at], faster."""
    return np.take(x, at, axis=0, mode="clip")


class Model:
    def __init__(self, shape: Shape, flat: np.ndarray):
        self.shape, self.flat, self.w = shape, flat, shape.views(flat)
        n = shape.window
        self.mask = np.where(np.tri(n, dtype=bool), np.float32(0), np.float32(-1e9))
        self.tables: tuple[np.ndarray, np.ndarray] | None = None

    def freeze(self) -> Model:
        """Look up what tokens and places give to queries, keys and values, as weights don't change any more."""
        w = self.w
        self.tables = tuple(np.concatenate((x, x @ w["qkv"]), axis=1) for x in (w["emb"], w["pos"]))
        return self

    def _body(self, tokens: np.ndarray) -> tuple:
        """Everything up to the norm; attention comes as exponentials and their sums."""
        w, (b, n), d = self.w, tokens.shape, self.shape.width
        tokens = tokens.astype(np.intp, copy=False)
        if self.tables:
            both = _rows(self.tables[0], tokens)
            both += self.tables[1][:n]
            h0, qkv = both[:, :, :d], both.reshape(b * n, 4 * d)[:, d:]
        else:
            h0 = _rows(w["emb"], tokens)
            h0 += w["pos"][:n]
            qkv = h0.reshape(b * n, d) @ w["qkv"]
        q, k, v = (qkv[:, i * d : (i + 1) * d].reshape(b, n, d) for i in range(3))
        a = (q * np.float32(d**-0.5)) @ k.transpose(0, 2, 1)
        small = not a.size or max(float(a.max()), -float(a.min())) < 60  # no exponential is too large
        a += self.mask[:n, :n]
        if not small:
            a -= a.max(axis=-1, keepdims=True)
        np.exp(a, out=a)
        both = a @ np.concatenate((v, np.ones((b, n, 1), np.float32)), axis=2)  # weighted sums and the sum of weights
        total = both[:, :, d:]
        o = (both[:, :, :d] / total).reshape(b * n, d)
        h1 = h0.reshape(b * n, d) + o @ w["out"]
        f = h1 @ w["w1"]
        f += w["b1"]
        np.maximum(f, 0, out=f)
        h2 = h1 + f @ w["w2"]
        h2 += w["b2"]
        r = 1 / np.sqrt(np.einsum("ij,ij->i", h2, h2) / d + _EPS)
        return h0, q, k, v, a, total, o, h1, f, r, h2 * r[:, None]

    def _heads(self, z: np.ndarray, target: np.ndarray) -> tuple:
        """Logarithms of the targets' probabilities; positions sorted by group, with both exponentials and their sums."""
        w, m, d = self.w, self.shape.members, self.shape.width
        group = target // m
        order = np.argsort(group.astype(np.int16), kind="stable")  # by radix
        group, member = group[order], (target % m)[order]
        one = np.ones((len(z), d + 1), np.float32)  # the last column carries the biases
        one[:, :d] = _rows(z, order) if len(z) else 0
        lg = one @ np.concatenate((w["wg"], w["bg"][None, :]))
        wm = np.concatenate((w["wm"], w["bm"][:, None, :]), axis=1)
        lm = np.empty((len(z), m), np.float32)
        bounds = np.searchsorted(group, np.arange(self.shape.groups + 1))
        for g in np.flatnonzero(np.diff(bounds)):
            np.matmul(one[bounds[g] : bounds[g + 1]], wm[g], out=lm[bounds[g] : bounds[g + 1]])
        at = np.arange(len(z))
        hit = lg[at, group] + lm[at, member]
        sums, ones = [], np.ones(max(m, lg.shape[1]), np.float32)
        # No product is larger than those of the longest vectors, so small ones need no look at each.
        reach = float(np.sqrt(np.einsum("ij,ij->i", one, one).max(initial=0)))
        for x, weights in ((lg, np.concatenate((w["wg"], w["bg"][None, :]))[None]), (lm, wm)):
            if reach * float(np.sqrt((weights * weights).sum(axis=1).max())) > 60 and x.size and max(float(x.max()), -float(x.min())) > 60:
                top = x.max(axis=1)
                x -= top[:, None]
                hit -= top
            np.exp(x, out=x)
            sums.append(x @ ones[: x.shape[1]])
        logp = np.empty(len(z), np.float32)
        logp[order] = hit - np.log(sums[0]) - np.log(sums[1])
        return logp, order, one, group, member, lg, sums[0], lm, sums[1], bounds

    def score(self, tokens: np.ndarray, target: np.ndarray, wanted: np.ndarray) -> np.ndarray:
        """Natural logarithms of p(target | tokens up to it) where wanted, row by row."""
        x = _rows(self._body(tokens)[-1], np.flatnonzero(wanted))
        x *= self.w["gain"]
        return self._heads(x, target[wanted])[0]

    def gradient(self, tokens: np.ndarray, target: np.ndarray, wanted: np.ndarray) -> tuple[float, np.ndarray]:
        """Mean negative logarithm of the wanted targets' probabilities, and its gradient."""
        w, s, (b, n), d = self.w, self.shape, tokens.shape, self.shape.width
        h0, q, k, v, a, total, o, h1, f, r, x = self._body(tokens)
        a /= total
        at, ones = np.flatnonzero(wanted), np.ones(b * n, np.float32)
        flat = np.zeros(s.size, self.flat.dtype if self.flat.dtype == np.float64 else np.float32)
        g = s.views(flat)
        logp, order, z, group, member, pg, total_g, pm, total_m, bounds = self._heads(_rows(x, at) * w["gain"], target[wanted])
        each = np.float32(1 / max(len(at), 1))
        pg *= (each / total_g)[:, None]
        pm *= (each / total_m)[:, None]
        i = np.arange(len(z))
        pg[i, group] -= each
        pm[i, member] -= each
        both = z.T @ pg  # the last row is that of the biases
        g["wg"][:], g["bg"][:] = both[:d], both[d]
        dz = pg @ w["wg"].T
        for j in np.flatnonzero(np.diff(bounds)):
            p = slice(bounds[j], bounds[j + 1])
            both = z[p].T @ pm[p]
            g["wm"][j], g["bm"][j] = both[:d], both[d]
            dz[p] += pm[p] @ w["wm"][j].T
        dx = np.zeros((b * n, d), np.float32)
        dx[at[order]] = dz
        g["gain"][:] = ones @ (dx * x)
        dx *= w["gain"]
        dh = x * (np.einsum("ij,ij->i", dx, x) / -np.float32(d))[:, None]
        dh += dx
        dh *= r[:, None]
        g["w2"][:], g["b2"][:] = f.T @ dh, ones @ dh
        df = dh @ w["w2"].T
        df *= np.sign(f)  # f isn't negative
        g["w1"][:], g["b1"][:] = h1.T @ df, ones @ df
        dh += df @ w["w1"].T
        g["out"][:] = o.T @ dh
        do = dh @ w["out"].T
        da = do.reshape(b, n, d) @ v.transpose(0, 2, 1)
        da -= np.einsum("ij,ij->i", do, o).reshape(b, n, 1)  # the sums of the rows of da * a
        da *= a
        da *= np.float32(d**-0.5)
        dqkv = np.concatenate([da @ k, da.transpose(0, 2, 1) @ q, a.transpose(0, 2, 1) @ do.reshape(b, n, d)], axis=2).reshape(b * n, 3 * d)
        g["qkv"][:] = h0.reshape(b * n, d).T @ dqkv
        dh += dqkv @ w["qkv"].T
        g["pos"][:n] = (ones[:b] @ dh.reshape(b, n * d)).reshape(n, d)
        # Sums of the rows of each token, by sorting.
        t = tokens.ravel()
        by = np.argsort(t, kind="stable")
        t = t[by]
        first = np.flatnonzero(np.concatenate(([True], t[1:] != t[:-1])))
        g["emb"][t[first]] = np.add.reduceat(np.ascontiguousarray(_rows(dh, by).T), first, axis=1).T
        return -float(logp.mean()) if len(at) else 0.0, flat


class Trainer:
    """Adam over batches of windows."""

    def __init__(self, model: Model, rate: float):
        self.model, self.rate, self.steps = model, rate, 0
        self.m, self.v = np.zeros_like(model.flat), np.zeros_like(model.flat)

    def step(self, tokens: np.ndarray, target: np.ndarray, wanted: np.ndarray, rate: float = 1.0) -> float:
        if not wanted.any():
            return 0.0
        loss, g = self.model.gradient(tokens, target, wanted)
        self.steps += 1
        self.m *= 0.9
        self.m += 0.1 * g
        g *= g
        g *= 0.02
        self.v *= 0.98
        self.v += g
        np.sqrt(self.v, out=g)
        g *= (1 - 0.98**self.steps) ** -0.5
        g += 1e-8
        np.divide(self.m, g, out=g)
        g *= self.rate * rate / (1 - 0.9**self.steps)
        self.model.flat -= g
        return loss


def windows(bounds: np.ndarray, window: int, stride: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First place and owner of each overlapping window, and how many leading places are context only.

    bounds: where the sequences of a flat array begin and end. Every place of a sequence is
    scored by exactly one window, after at least window - stride places of context or its start.
    """
    n = np.diff(bounds)
    count = np.where(n > 0, 1 + np.maximum(0, -(-(n - window) // stride)), 0)
    owner = np.repeat(np.arange(len(n)), count)
    k = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
    return bounds[:-1][owner] + k * stride, owner, np.where(k > 0, window - stride, 0)


def cut(source: np.ndarray, target: np.ndarray, bounds: np.ndarray, first: np.ndarray, owner: np.ndarray, context: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Tokens, targets and wanted places of windows, as rows of equal length."""
    at = first[:, None] + np.arange(window)
    end = bounds[1:][owner][:, None]
    wanted = (at < end) & (np.arange(window) >= context[:, None])
    at = np.minimum(at, end - 1)
    return source[at], target[at], wanted
