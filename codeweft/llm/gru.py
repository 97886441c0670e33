"""A gated recurrent language model with a class-factored softmax, in numpy.

Words are numbered by frequency. Runs of consecutive words form classes, small ones of frequent words and large ones of
rare words (see class_cuts()); the end of a text and the unknown word are classes of their own.
P(word) = P(class | state) P(word | class, state)."""

from __future__ import annotations

import heapq

import numpy as np

F32 = np.float32
#: Rows of a softmax at a time: what stays in a core's cache.
ROWS = 2048
#: Logits below it need no shift before exp().
SAFE = 60.0


def sigmoid(x: np.ndarray) -> np.ndarray:
    return F32(0.5) * (np.tanh(F32(0.5) * x) + F32(1))


def class_cuts(counts: np.ndarray, total: float) -> np.ndarray:
    """Where classes of words begin, and the number of words. counts: of the words, falling; total: of all tokens.

    A token costs a term of the softmax for each class and each word of its own class. A class of s words of frequency
    p costs 1 + p s s, so for each word 1 / s + p s, which is least at s = 1 / sqrt(p)."""
    cuts = [0]
    while cuts[-1] < len(counts):
        p = max(float(counts[cuts[-1]]), 0.5) / max(total, 1.0)
        cuts.append(min(len(counts), cuts[-1] + max(1, round(p**-0.5))))
    return np.array(cuts, np.int64)


def _exp(e: np.ndarray, bound: float) -> np.ndarray:
    """exp in place; returns what was subtracted from each row."""
    shift = np.zeros((len(e), 1), F32) if bound < SAFE else e.max(1, keepdims=True)
    if bound >= SAFE:
        e -= shift
    np.exp(e, e)
    return shift[:, 0]


class Gru:
    """Words, then END and OOV. params: E (input to gates), U (state to gates), Wc, bc (classes), Wk, bk (words)."""

    def __init__(self, cuts: np.ndarray, hidden: int, params: dict[str, np.ndarray] | None = None, counts: np.ndarray | None = None, seed: int = 3):
        self.cuts, self.n_words, self.hidden = cuts, int(cuts[-1]), hidden
        self.classes = len(cuts) - 1
        self.end, self.oov = self.n_words, self.n_words + 1
        size = np.diff(cuts)
        self.class_of = np.r_[np.repeat(np.arange(self.classes), size), self.classes, self.classes + 1].astype(np.int64)
        self.within = np.r_[np.arange(self.n_words) - np.repeat(cuts[:-1], size), 0, 0].astype(np.int64)
        self.params = params if params is not None else self._start(np.asarray(counts, float), seed)

    def _start(self, counts: np.ndarray, seed: int) -> dict[str, np.ndarray]:
        """Small random weights; biases at the words' frequencies, so that training starts from the unigram model."""
        rng, h, c, n = np.random.default_rng(seed), self.hidden, self.classes, self.n_words
        counts = counts + 0.5
        mass = np.bincount(self.class_of, counts, minlength=c + 2)
        p = {
            "E": rng.normal(0, 0.15, (n + 2, 3 * h)), "U": rng.normal(0, 1 / np.sqrt(h), (h, 3 * h)), "Wc": rng.normal(0, 0.05, (h, c + 2)), "bc": np.log(mass / mass.sum()),
            "Wk": rng.normal(0, 0.05, (n, h)), "bk": np.log(counts[:n] / mass[self.class_of[:n]]),
        }
        return {k: v.astype(F32) for k, v in p.items()}

    # packing, for broadcast and averaging
    def flat(self) -> np.ndarray:
        return np.concatenate([self.params[n].ravel() for n in sorted(self.params)])

    def with_flat(self, v: np.ndarray) -> Gru:
        h, c, n = self.hidden, self.classes, self.n_words
        shapes = {"E": (n + 2, 3 * h), "U": (h, 3 * h), "Wc": (h, c + 2), "bc": (c + 2,), "Wk": (n, h), "bk": (n,)}
        out, at = {}, 0
        for k in sorted(shapes):
            size = int(np.prod(shapes[k]))
            out[k] = v[at : at + size].astype(F32).reshape(shapes[k])
            at += size
        return Gru(self.cuts, h, out)

    def _step(self, a: np.ndarray, h: np.ndarray):
        n = self.hidden
        g = h @ self.params["U"]
        zr = sigmoid(a[:, : 2 * n] + g[:, : 2 * n])
        z, r = zr[:, :n], zr[:, n:]
        gn = g[:, 2 * n :]
        c = np.tanh(a[:, 2 * n :] + r * gn)
        return c + z * (h - c), z, r, c, gn

    def _bounds(self) -> tuple[float, np.ndarray]:
        """The most that a logit can be, for classes and for the words of each class: states lie within -1 and 1."""
        p = self.params
        word = np.abs(p["Wk"]).sum(1) + np.abs(p["bk"])
        return float((np.abs(p["Wc"]).sum(0) + np.abs(p["bc"])).max()), np.maximum.reduceat(word, self.cuts[:-1]) if self.n_words else np.zeros(0)

    def _output(self, s: np.ndarray, ids: np.ndarray, grads: dict | None, bounds: tuple | None = None):
        """Natural log probability of each id after its state; with grads, adds gradients and returns those of the states."""
        p, of_class, of_word = self.params, *(bounds or self._bounds())
        cls = self.class_of[ids]
        order = np.argsort(cls.astype(np.uint16), kind="stable")
        s, cls, within = s[order], cls[order], self.within[ids[order]]
        cut = np.searchsorted(cls, np.arange(self.classes + 1))
        out = np.empty(len(s))
        ds = None if grads is None else np.empty_like(s)
        ones = np.ones(max(self.classes + 2, int(np.diff(self.cuts).max(initial=0))), F32)
        at = np.arange(ROWS)
        for a in range(0, len(s), ROWS):
            x, y = s[a : a + ROWS], cls[a : a + ROWS]
            e = x @ p["Wc"]
            e += p["bc"]
            own = e[at[: len(x)], y]
            own -= _exp(e, of_class)
            total = e @ ones[: e.shape[1]]
            out[a : a + ROWS] = own - np.log(total)
            if grads is not None:
                e *= (1 / total)[:, None]
                e[at[: len(x)], y] -= 1
                ds[a : a + ROWS] = e @ p["Wc"].T
                grads["Wc"] += x.T @ e
                grads["bc"] += e.sum(0)
        for c in range(self.classes):
            lo, hi = int(self.cuts[c]), int(self.cuts[c + 1])
            if cut[c] == cut[c + 1] or hi - lo == 1:
                continue
            w, b = p["Wk"][lo:hi], p["bk"][lo:hi]
            for a in range(cut[c], cut[c + 1], ROWS):
                to = min(a + ROWS, cut[c + 1])
                x, y = s[a:to], within[a:to]
                e = x @ w.T
                e += b
                own = e[at[: len(x)], y]
                own -= _exp(e, of_word[c])
                total = e @ ones[: hi - lo]
                out[a:to] += own - np.log(total)
                if grads is not None:
                    e *= (1 / total)[:, None]
                    e[at[: len(x)], y] -= 1
                    ds[a:to] += e @ w
                    grads["Wk"][lo:hi] += e.T @ x
                    grads["bk"][lo:hi] += e.sum(0)
        back = np.empty(len(order), np.int64)
        back[order] = np.arange(len(order))
        return out[back], None if ds is None else ds[back]

    def score(self, texts: list[np.ndarray], lanes: int = 512, window: int = 32) -> np.ndarray:
        """Natural log probability of each text (its ids, the end not included, is scored too). Texts follow each other
        in lanes of about equal length; the state starts anew with each text and is carried to its end."""
        size = np.array([len(t) + 1 for t in texts])
        out = np.zeros(len(texts))
        if not len(texts):
            return out
        lanes = int(max(1, min(lanes, len(texts), -(-size.sum() // max(size.max(), window)))))
        heap, mine = [(0, k) for k in range(lanes)], [[] for _ in range(lanes)]
        for i in np.argsort(-size, kind="stable"):
            length, k = heap[0]
            heapq.heapreplace(heap, (length + int(size[i]), k))
            mine[k].append(i)
        mine.sort(key=lambda k: -sum(int(size[i]) for i in k))
        length = np.array([sum(int(size[i]) for i in k) for k in mine])
        y = np.full((int(length[0]), lanes), self.end, np.int32)
        owner = np.zeros(y.shape, np.int32)
        x = np.full(y.shape, self.end, np.int32)
        for k, some in enumerate(mine):
            at = 0
            for i in some:
                t = texts[i]
                y[at : at + len(t), k] = t
                x[at + 1 : at + len(t) + 1, k] = t
                owner[at : at + len(t) + 1, k] = i
                at += len(t) + 1
        keep = x != self.end
        bounds, h = self._bounds(), np.zeros((lanes, self.hidden), F32)
        for at in range(0, len(y), window):
            on = np.searchsorted(-length, -np.arange(at, min(at + window, len(y))), "left")  # lanes still going
            states = []
            for t, n in enumerate(on, at):
                h = self._step(self.params["E"][x[t, :n]], h[:n] * keep[t, :n, None])[0]
                states.append(h)
            some = range(at, at + len(on))
            p, _ = self._output(np.concatenate(states), np.concatenate([y[t, :n] for t, n in zip(some, on)]), None, bounds)
            out += np.bincount(np.concatenate([owner[t, :n] for t, n in zip(some, on)]), p, minlength=len(out))
        return out

    def train(self, texts: list[np.ndarray], lanes: int = 64, window: int = 20, rate: float = 0.08) -> int:
        """One pass of truncated backpropagation with AdaGrad. Texts follow each other in lanes; the state is carried
        between windows and starts anew with each text. The first tokens fill up the last lane. Returns the number of
        tokens."""
        if not texts:
            return 0
        stream = np.concatenate([np.r_[t, self.end] for t in texts]).astype(np.int32)
        lanes = int(min(lanes, max(1, len(stream) // window)))
        length = -(-len(stream) // lanes)
        full = np.resize(stream, lanes * length)
        y = full.reshape(lanes, length).T
        x = np.r_[np.int32(self.end), full[:-1]].reshape(lanes, length).T
        keep = (x != self.end).astype(F32)[:, :, None]
        if not hasattr(self, "acc"):
            self.acc = {n: np.full(v.shape, 1e-8, F32) for n, v in self.params.items()}
        p, n = self.params, self.hidden
        h = np.zeros((lanes, n), F32)
        for at in range(0, length, window):
            xs, ys, ks = x[at : at + window], y[at : at + window], keep[at : at + window]
            saved, states = [], []
            for t in range(len(xs)):
                before = h * ks[t]
                h, z, r, c, gn = self._step(p["E"][xs[t]], before)
                saved.append((before, z, r, c, gn))
                states.append(h)
            g = {k: np.zeros_like(v) for k, v in p.items() if k != "E"}
            _, ds = self._output(np.concatenate(states), ys.ravel(), g)
            ds = ds.reshape(len(xs), lanes, n)
            da = np.empty((len(xs), lanes, 3 * n), F32)
            dg = np.empty((lanes, 3 * n), F32)
            dh = np.zeros((lanes, n), F32)
            for t in range(len(xs) - 1, -1, -1):
                before, z, r, c, gn = saved[t]
                dh += ds[t]
                dc = dh * (1 - z) * (1 - c * c)
                da[t, :, :n] = dh * (before - c) * z * (1 - z)
                da[t, :, n : 2 * n] = dc * gn * r * (1 - r)
                da[t, :, 2 * n :] = dc
                dg[:, : 2 * n] = da[t, :, : 2 * n]
                dg[:, 2 * n :] = dc * r
                g["U"] += before.T @ dg
                dh = (dh * z + dg @ p["U"].T) * ks[t]
            scale = F32(1 / ys.size)
            ids = xs.ravel()
            order = np.argsort(ids, kind="stable")
            begin = np.flatnonzero(np.r_[True, ids[order][1:] != ids[order][:-1]])
            rows = ids[order][begin]
            ge = np.add.reduceat(da.reshape(-1, 3 * n)[order], begin, 0) * scale
            self.acc["E"][rows] += ge * ge
            p["E"][rows] -= F32(rate) * ge / np.sqrt(self.acc["E"][rows])
            for k, v in g.items():
                v *= scale
                self.acc[k] += v * v
                p[k] -= F32(rate) * v / np.sqrt(self.acc[k])
        return len(stream)
