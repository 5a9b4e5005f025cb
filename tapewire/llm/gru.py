"""A gated recurrent language model in numpy with a class-factored softmax.

P(word | state) = P(class | state) * P(word | class, state).  The frequent words are cut into classes of about equal
frequency; one more class holds all other words and the unknown one, with their corpus counts inside.
Documents are packed into parallel streams; the state is carried from window to window and reset where a
document begins.
"""

from __future__ import annotations

import heapq

import numpy as np

from tapewire.llm.batches import spans

HIDDEN = 16
CLASSES = 24
WINDOW = 24  # steps of truncated backpropagation
TRAIN_STREAMS = 256
SCORE_STREAMS = 512
PIECE = 40 * WINDOW  # training starts afresh in a document after so many tokens
RATE = 0.08
F32 = np.float32


def classes_of(counts: np.ndarray, n: int) -> np.ndarray:
    """First word of each class (and the end) for counts in descending order: about equal shares of all occurrences."""
    if not len(counts):
        return np.zeros(1, np.int64)
    share = np.cumsum(counts) / counts.sum()
    label = np.minimum((share * n - 1e-9).astype(np.int64), n - 1)
    first = np.flatnonzero(np.concatenate([[True], label[1:] != label[:-1]]))
    return np.append(first, len(counts))


def sigmoid(x: np.ndarray) -> np.ndarray:
    np.negative(x, out=x)
    np.exp(x, out=x)
    x += 1
    return np.reciprocal(x, out=x)


def softmax(x: np.ndarray) -> np.ndarray:
    x -= x.max(axis=1, keepdims=True)
    np.exp(x, out=x)
    x /= x.sum(axis=1, keepdims=True)
    return x


class Gru:
    """``weights`` is one flat vector; all parameters are views of it.

    Word ids 0..K-1 are the frequent words in descending order of their counts; inputs above that are
    buckets of other words.  A target of K stands for any other word.
    """

    def __init__(self, counts: np.ndarray, other: float, inputs: int, weights: np.ndarray | None = None) -> None:
        self.k, h = len(counts), HIDDEN
        self.first = classes_of(counts, CLASSES)
        self.n = len(self.first)  # classes, the last one for all other words
        self.of_word = np.append(np.repeat(np.arange(self.n - 1), np.diff(self.first)), self.n - 1)
        shapes = {"E": (inputs, 3 * h), "U": (h, 3 * h), "Wc": (h, self.n), "bc": (self.n,), "Ww": (self.k, h), "bw": (self.k,)}
        size = sum(int(np.prod(s)) for s in shapes.values())
        fresh = weights is None
        self.flat = np.zeros(size, F32) if fresh else weights.astype(F32)
        at = 0
        for name, shape in shapes.items():
            setattr(self, name, self.flat[at : at + int(np.prod(shape))].reshape(shape))
            at += int(np.prod(shape))
        if fresh:
            rng = np.random.default_rng(7)
            self.E[:] = rng.normal(0, 0.1, self.E.shape)
            self.U[:] = rng.normal(0, 0.5 / np.sqrt(h), self.U.shape)
            self.E[:, :h] += 1.0  # keep the state at first
            mass = np.array([*(counts[a:b].sum() for a, b in zip(self.first[:-1], self.first[1:])), other])
            self.bc[:] = np.log(mass / mass.sum())
            self.bw[:] = np.log(counts)

    def _states(self, x: np.ndarray, fresh: np.ndarray, h: np.ndarray, keep: bool):
        """Hidden states of a window (steps, streams, H) and what backpropagation needs."""
        d = HIDDEN
        gates = self.E[x]
        out = np.empty((len(x), x.shape[1], d), F32)
        saved = []
        for t in range(len(x)):
            h = h * fresh[t]
            hu = h @ self.U
            g = gates[t]
            zr = sigmoid(g[:, : 2 * d] + hu[:, : 2 * d])
            z, r = zr[:, :d], zr[:, d:]
            n = np.tanh(g[:, 2 * d :] + r * hu[:, 2 * d :])
            if keep:
                saved.append((h, hu[:, 2 * d :], z, r, n))
            h = n + z * (h - n)
            out[t] = h
        return out, h, saved

    def log_likelihood(self, x: np.ndarray, y: np.ndarray, fresh: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(natural log of P(y), next state) of one window; of another word its class's probability alone."""
        hs, h, _ = self._states(x, fresh, h, False)
        hs, y = hs.reshape(-1, HIDDEN), y.ravel()
        c = self.of_word[y]
        logits = hs @ self.Wc
        logits += self.bc
        logits -= logits.max(axis=1, keepdims=True)
        out = logits[np.arange(len(y)), c].astype(np.float64)
        out -= np.log(np.exp(logits, out=logits).sum(axis=1))
        for i, rows in self._by_class(c):
            a, b = self.first[i], self.first[i + 1]
            if b - a > 1:
                logits = hs[rows] @ self.Ww[a:b].T
                logits += self.bw[a:b]
                logits -= logits.max(axis=1, keepdims=True)
                own = logits[np.arange(len(rows)), y[rows] - a]
                out[rows] += own - np.log(np.exp(logits, out=logits).sum(axis=1))
        return out.reshape(x.shape), h

    def _by_class(self, c: np.ndarray):
        order = np.argsort(c.astype(np.int8), kind="stable")
        ends = np.searchsorted(c[order], np.arange(self.n))
        for i in range(self.n - 1):
            if ends[i + 1] > ends[i]:
                yield i, order[ends[i] : ends[i + 1]]

    def step(self, x: np.ndarray, y: np.ndarray, fresh: np.ndarray, real: np.ndarray, h: np.ndarray, seen: np.ndarray) -> np.ndarray:
        """One window of truncated backpropagation with Adagrad; ``seen`` holds the sums of squared gradients."""
        d = HIDDEN
        grad = Gru.__new__(Gru)
        grad.flat = np.zeros_like(self.flat)
        at = 0
        for name in ("E", "U", "Wc", "bc", "Ww", "bw"):
            own = getattr(self, name)
            setattr(grad, name, grad.flat[at : at + own.size].reshape(own.shape))
            at += own.size
        states, last, saved = self._states(x, fresh, h, True)
        hs, y, weight = states.reshape(-1, d), y.ravel(), (real.ravel() / max(1.0, real.sum())).astype(F32)
        c = self.of_word[y]
        p = softmax(hs @ self.Wc + self.bc)
        p[np.arange(len(y)), c] -= 1
        p *= weight[:, None]
        grad.Wc[:] = hs.T @ p
        grad.bc[:] = p.sum(axis=0)
        dh = p @ self.Wc.T
        for i, rows in self._by_class(c):
            a, b = self.first[i], self.first[i + 1]
            if b - a > 1:
                own = hs[rows]
                q = softmax(own @ self.Ww[a:b].T + self.bw[a:b])
                q[np.arange(len(rows)), y[rows] - a] -= 1
                q *= weight[rows][:, None]
                grad.Ww[a:b] = q.T @ own
                grad.bw[a:b] = q.sum(axis=0)
                dh[rows] += q @ self.Ww[a:b]
        dh = dh.reshape(states.shape)
        dgates = np.empty((*x.shape, 3 * d), F32)
        dhu = np.empty((x.shape[1], 3 * d), F32)
        carried = np.zeros_like(last)
        for t in range(len(x) - 1, -1, -1):
            before, un, z, r, n = saved[t]
            g = dh[t] + carried
            dn = g * (1 - z) * (1 - n * n)
            dz = g * (before - n) * z * (1 - z)
            dr = dn * un * r * (1 - r)
            dgates[t, :, :d], dgates[t, :, d : 2 * d], dgates[t, :, 2 * d :] = dz, dr, dn
            dhu[:, : 2 * d] = dgates[t, :, : 2 * d]
            dhu[:, 2 * d :] = dn * r
            grad.U += before.T @ dhu
            carried = (g * z + dhu @ self.U.T) * fresh[t]
        ids = x.ravel()
        order = np.argsort(ids.astype(np.int16), kind="stable")
        heads = np.flatnonzero(np.concatenate([[True], ids[order][1:] != ids[order][:-1]]))
        grad.E[ids[order][heads]] = np.add.reduceat(dgates.reshape(-1, 3 * d)[order], heads, axis=0)
        np.clip(grad.flat, -0.5, 0.5, out=grad.flat)
        seen += grad.flat * grad.flat
        self.flat -= RATE * grad.flat / (np.sqrt(seen) + F32(1e-6))
        return last


def dealt(lengths: np.ndarray, n: int) -> list[list[int]]:
    """Documents dealt to ``n`` streams, the longest first to the shortest stream; a document stays whole.  The longest stream comes first."""
    heap = [(0, i) for i in range(n)]
    out: list[list[int]] = [[] for _ in range(n)]
    for doc in np.argsort(-lengths, kind="stable").tolist():
        size, i = heap[0]
        out[i].append(doc)
        heapq.heapreplace(heap, (size + int(lengths[doc]), i))
    return sorted(out, key=lambda docs: -int(lengths[docs].sum()))


def inputs_of(targets_as_inputs: np.ndarray, at: np.ndarray, end: int) -> np.ndarray:
    """Each token's predecessor; the end mark stands before a document."""
    x = np.empty_like(targets_as_inputs)
    x[1:] = targets_as_inputs[:-1]
    x[at[:-1]] = end
    return x


def windows(at: np.ndarray, n: int, window: int):
    """(places of the tokens, which are there, 0 where a document begins) per window; shape (steps, streams).

    Streams that have ended drop out, so later windows are narrower.
    """
    lengths = np.diff(at)
    streams = [np.array(docs, dtype=np.int64) for docs in dealt(lengths, n) if docs]
    sizes = np.array([int(lengths[docs].sum()) for docs in streams])
    order = np.concatenate(streams)
    place = np.repeat(at[:-1][order], lengths[order]) + spans(lengths[order])
    fresh = np.ones(len(place), dtype=F32)
    fresh[np.cumsum(lengths[order]) - lengths[order]] = 0
    first = np.cumsum(sizes) - sizes
    for t in range(0, int(sizes.max()), window):
        width = int(np.searchsorted(-sizes, -t, "left"))
        steps = t + np.arange(min(window, int(sizes[0]) - t))[:, None]
        live = steps < sizes[:width]
        flat = np.where(live, first[:width] + steps, 0)
        yield place[flat], live, np.where(live, fresh[flat], F32(1))[:, :, None]


def train(model: Gru, x: np.ndarray, y: np.ndarray, at: np.ndarray, seen: np.ndarray) -> None:
    """One pass over the documents, long ones in pieces; fewer streams for little text, so that it still makes a hundred steps."""
    at = np.unique(np.concatenate([at, *[np.arange(a, b, PIECE) for a, b in zip(at[:-1], at[1:]) if b - a > PIECE]]))
    n = int(np.clip(len(x) // (WINDOW * 100), 8, TRAIN_STREAMS))
    h = np.zeros((n, HIDDEN), F32)
    for place, live, goes_on in windows(at, n, WINDOW):
        h = model.step(x[place], y[place], goes_on, live.astype(F32), h[: place.shape[1]], seen)


def score(model: Gru, x: np.ndarray, y: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Natural log-likelihood of every token, the state carried through whole documents.

    As many streams as keep the longest document from outlasting the others.
    """
    n = int(np.clip(len(x) // max(1, int(np.diff(at).max())), 1, SCORE_STREAMS))
    h = np.zeros((max(n, min(32, len(at) - 1)), HIDDEN), F32)
    out = np.zeros(len(x))
    for place, live, goes_on in windows(at, len(h), WINDOW):
        ll, h = model.log_likelihood(x[place], y[place], goes_on, h[: place.shape[1]])
        out[place[live]] = ll[live]
    return out
