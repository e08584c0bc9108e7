"""A small gated recurrent language model in numpy.

The output softmax is factored: a class, then a word within its class. Words beyond the
model's own vocabulary form one class whose words are told apart by their corpus counts
(outside this module). Documents run through parallel streams; the state is carried from
window to window until the document ends, for training (truncated backpropagation) and
scoring alike.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np

#: State size, words per class, and steps of a window.
HIDDEN, CLASS_WORDS, WINDOW = 16, 32, 32

#: Windows that are cut from the streams at once.
BLOCK_WINDOWS = 8

RATE, LEAST_TOKENS = 0.01, 2048


class Gru:
    """Ids: 0 .. words-1 for own words, then the end of a text, then any other word."""

    def __init__(self, words: int, arrays: dict[str, np.ndarray]):
        self.words, self.end, self.other = words, words, words + 1
        self.a = arrays
        ids = np.arange(words + 2)
        full = -(-words // CLASS_WORDS)
        self.word_classes = full
        self.class_of = np.where(ids < words, ids // CLASS_WORDS, full + ids - words).astype(np.int64)
        self.slot_of = (ids % CLASS_WORDS).astype(np.int64)

    @classmethod
    def fresh(cls, counts: np.ndarray, seed: int = 7, hidden: int = HIDDEN) -> Gru:
        """Small random weights; the output biases are the unigram model of the counts."""
        words = len(counts) - 2
        full = -(-words // CLASS_WORDS)
        rng = np.random.default_rng(seed)
        mass = np.full((full + 2, CLASS_WORDS), 1e-6)
        mass[:full].flat[:words] = counts[:words] + 1.0
        by_class = mass.sum(axis=1)
        by_class[full:] = counts[words:] + 1.0

        def small(*shape):
            return rng.normal(0, 0.1, shape).astype(np.float32)

        arrays = {
            "inputs": small(words + 2, 3 * hidden),
            "state": small(hidden, 3 * hidden),
            "classes": small(hidden, full + 2),
            "class_bias": np.log(by_class / by_class.sum()).astype(np.float32),
            "slots": small(full, hidden, CLASS_WORDS),
            "slot_bias": np.log(mass[:full] / by_class[:full, None]).astype(np.float32),
        }
        return cls(words, arrays)

    def flat(self) -> np.ndarray:
        return np.concatenate([x.ravel() for x in self.a.values()])

    def with_flat(self, flat: np.ndarray) -> Gru:
        arrays, at = {}, 0
        for name, x in self.a.items():
            arrays[name] = flat[at : at + x.size].reshape(x.shape).astype(np.float32)
            at += x.size
        return Gru(self.words, arrays)

    def run(self, ids: np.ndarray, keep: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, tuple]:
        """States after each step of a window (steps, streams, hidden).

        Inside, units are rows and streams columns, so that parts of a gate lie together in
        memory.
        """
        size, (steps, streams) = h.shape[1], ids.shape
        gates = np.ascontiguousarray(self.a["inputs"][ids].transpose(0, 2, 1))
        keep = keep[..., 0]
        turned = np.ascontiguousarray(self.a["state"].T)
        states = np.empty((steps, size, streams), np.float32)
        before = np.empty_like(states)
        zr_all = np.empty((steps, 2 * size, streams), np.float32)
        recurrent, candidate = np.empty_like(states), np.empty_like(states)
        a = np.empty((3 * size, streams), np.float32)
        h = h.T
        for t in range(steps):
            np.multiply(h, keep[t], out=before[t])
            np.matmul(turned, before[t], out=a)
            zr = zr_all[t]
            np.add(gates[t, : 2 * size], a[: 2 * size], out=zr)
            zr *= 0.5
            np.tanh(zr, out=zr)
            zr += 1
            zr *= 0.5
            recurrent[t] = a[2 * size :]
            n = candidate[t]
            np.multiply(zr[size:], recurrent[t], out=n)
            n += gates[t, 2 * size :]
            np.tanh(n, out=n)
            h = states[t]
            np.subtract(before[t], n, out=h)
            h *= zr[:size]
            h += n
        return states.transpose(0, 2, 1), (before, zr_all, recurrent, candidate)

    def log_probs(self, h: np.ndarray, y: np.ndarray, grads: dict | None = None):
        """Natural log probability of each target id; with ``grads`` also d(loss)/dh.

        Outputs are rows and tokens columns, so that maxima and sums run along the memory.
        """
        cls = self.class_of[y]
        out, e = _softmax(self.a["classes"].T @ h.T + self.a["class_bias"][:, None], cls, grads is not None)
        dh = None
        if grads is not None:
            grads["classes"] += (e @ h).T
            grads["class_bias"] += e.sum(axis=1)
            dh = e.T @ self.a["classes"].T
        order = np.argsort(cls.astype(np.int16), kind="stable")
        starts = np.searchsorted(cls[order], np.arange(self.word_classes + 1))
        for c in range(self.word_classes):
            at = order[starts[c] : starts[c + 1]]
            if not len(at):
                continue
            hc = h[at]
            inner = self.a["slots"][c].T @ hc.T + self.a["slot_bias"][c][:, None]
            own, e = _softmax(inner, self.slot_of[y[at]], grads is not None)
            out[at] += own
            if grads is not None:
                grads["slots"][c] += (e @ hc).T
                grads["slot_bias"][c] += e.sum(axis=1)
                dh[at] += e.T @ self.a["slots"][c].T
        return out, dh

    def back(self, ids, keep, kept, dstates, grads) -> None:
        """Backpropagation through the steps of one window.

        What does not depend on later steps is worked out for all of them at once; the loop
        only carries the gradient of the state.
        """
        before, zr, recurrent, candidate = kept
        steps, size, streams = before.shape
        z, r = zr[:, :size], zr[:, size:]
        to_n = (1 - z) * (1 - candidate * candidate)
        to_z = (before - candidate) * z * (1 - z)
        to_r = recurrent * r * (1 - r)
        keep, dstates = keep[..., 0], dstates.transpose(0, 2, 1)
        da = np.empty((steps, 3 * size, streams), np.float32)
        dgates = np.empty_like(da)
        dh = np.zeros((size, streams), np.float32)
        for t in range(steps - 1, -1, -1):
            dh += dstates[t]
            dn = np.multiply(dh, to_n[t], out=dgates[t, 2 * size :])
            np.multiply(dh, to_z[t], out=da[t, :size])
            np.multiply(dn, to_r[t], out=da[t, size : 2 * size])
            np.multiply(dn, r[t], out=da[t, 2 * size :])
            dh *= z[t]
            dh += self.a["state"] @ da[t]
            dh *= keep[t]
        dgates[:, : 2 * size] = da[:, : 2 * size]
        by_unit = lambda x: x.transpose(1, 0, 2).reshape(x.shape[1], -1)
        grads["state"] += by_unit(before) @ by_unit(da).T
        flat, g = ids.ravel(), dgates.transpose(0, 2, 1).reshape(-1, 3 * size)
        order = np.argsort(flat.astype(np.int32), kind="stable")
        seen, starts = np.unique(flat[order], return_index=True)
        grads["inputs"][seen] = np.add.reduceat(g[order], starts, axis=0)


def _softmax(logits: np.ndarray, target: np.ndarray, gradient: bool) -> tuple[np.ndarray, np.ndarray]:
    """Log probability of the target row of each column, and the gradient of its loss."""
    columns = np.arange(logits.shape[1])
    logits -= logits.max(axis=0)
    own = logits[target, columns]
    e = np.exp(logits, out=logits)
    z = e.sum(axis=0)
    if gradient:
        e /= z
        e[target, columns] -= 1
    return own - np.log(z), e


def packed(lengths: np.ndarray, streams: int, in_order: bool = False) -> list[list[int]]:
    """Documents dealt to the shortest stream each, longest first; longest stream first.

    Training deals them in the order given: it would otherwise end on short texts only.
    """
    order = np.arange(len(lengths)) if in_order else np.argsort(-lengths, kind="stable")
    heap = [(0, s) for s in range(min(streams, len(lengths)))]
    dealt: list[list[int]] = [[] for _ in heap]
    total = np.zeros(len(heap), np.int64)
    for d in order.tolist():
        n, s = heapq.heappop(heap)
        dealt[s].append(d)
        total[s] = n + int(lengths[d])
        heapq.heappush(heap, (int(total[s]), s))
    return [dealt[s] for s in np.argsort(-total, kind="stable")]


def windows(
    model: Gru, texts: list[np.ndarray], dealt: list[list[int]], steps: int
) -> Iterator[tuple]:
    """Inputs, targets, keep mask, and mask of real tokens, window by window.

    Targets of a text are its ids and the end; inputs are the end and its ids. Streams that
    have ended leave, so the first ones are active throughout.
    """
    ends = np.array([model.end], np.int32)
    targets = [np.concatenate([x for d in s for x in (texts[d], ends)]) for s in dealt]
    begins = []
    for s in dealt:
        marks = np.cumsum([0, *(len(texts[d]) + 1 for d in s[:-1])])
        begins.append(marks)
    lengths = np.array([len(x) for x in targets])
    inputs = [np.concatenate((ends, y[:-1])) for y in targets]
    for y, x, marks in zip(targets, inputs, begins):
        x[marks] = model.end
    longest = int(lengths[0]) if len(lengths) else 0
    for block in range(0, longest, steps * BLOCK_WINDOWS):
        active = int((lengths > block).sum())
        n = min(steps * BLOCK_WINDOWS, longest - block)
        x = np.full((active, n), model.end)
        y = np.full((active, n), model.end)
        keep = np.ones((active, n), np.float32)
        left = np.minimum(lengths[:active] - block, n)
        for s in range(active):
            m = left[s]
            x[s, :m], y[s, :m] = inputs[s][block : block + m], targets[s][block : block + m]
            first, last = np.searchsorted(begins[s], (block, block + m))
            keep[s, begins[s][first:last] - block] = 0
        x, y, keep = x.T.copy(), y.T.copy(), keep.T.copy()
        real = np.arange(n)[:, None] < left
        for t in range(0, n, steps):
            some = int((left > t).sum())
            part = slice(t, t + steps), slice(0, some)
            yield x[part], y[part], keep[part][:, :, None], real[part]


def score(model: Gru, texts: list[np.ndarray], streams: int = 768) -> np.ndarray:
    """Natural log probability of every text and its end, by the ids alone."""
    lengths = np.array([len(t) + 1 for t in texts], np.int64)
    dealt = packed(lengths, streams)
    h = np.zeros((len(dealt), model.a["state"].shape[0]), np.float32)
    parts: list[list[np.ndarray]] = [[] for _ in dealt]
    for x, y, keep, real in windows(model, texts, dealt, WINDOW):
        states, _ = model.run(x, keep, h[: x.shape[1]])
        got = np.zeros(x.shape, np.float32)
        got[real] = model.log_probs(states[real], y[real])[0]
        for s, n in enumerate(real.sum(axis=0).tolist()):
            parts[s].append(got[:n, s])
        h = states[-1]
    out = np.zeros(len(texts))
    for s, own in enumerate(dealt):
        cuts = np.cumsum([0, *(lengths[d] for d in own[:-1])])
        out[own] = np.add.reduceat(np.concatenate(parts[s]).astype(np.float64), cuts)
    return out


class Trainer:
    """Adam over windows; the weights move in place."""

    def __init__(self, model: Gru, rate: float = RATE):
        self.model, self.rate, self.steps = model, rate, 0
        self.first = {k: np.zeros_like(x) for k, x in model.a.items()}
        self.second = {k: np.zeros_like(x) for k, x in model.a.items()}

    def learn(self, texts: list[np.ndarray], streams: int = 256) -> int:
        """One pass; returns the tokens learned from."""
        model, tokens = self.model, 0
        dealt = packed(np.array([len(t) + 1 for t in texts], np.int64), streams, in_order=True)
        h = np.zeros((len(dealt), model.a["state"].shape[0]), np.float32)
        for x, y, keep, real in windows(model, texts, dealt, WINDOW):
            states, kept = model.run(x, keep, h[: x.shape[1]])
            grads = {k: np.zeros_like(v) for k, v in model.a.items()}
            _, dh = model.log_probs(states[real], y[real], grads)
            dstates = np.zeros_like(states)
            dstates[real] = dh
            model.back(x, keep, kept, dstates, grads)
            self._step(grads, len(dh))
            tokens += len(dh)
            h = states[-1]
        return tokens

    def _step(self, grads: dict, tokens: int) -> None:
        self.steps += 1
        # Few tokens, as where the last texts run out, move the weights little.
        rate = self.rate * min(1.0, tokens / LEAST_TOKENS) * (1 - 0.99**self.steps) ** 0.5 / (1 - 0.9**self.steps)
        for name, g in grads.items():
            g /= max(1, tokens)
            first, second = self.first[name], self.second[name]
            first += 0.1 * (g - first)
            second += 0.01 * (g * g - second)
            self.model.a[name] -= rate * first / (np.sqrt(second) + 1e-6)
