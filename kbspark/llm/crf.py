"""A linear-chain conditional random field over sparse features, in numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Feature numbers, and labels of padded sequences, that a batch holds at once.
_FEATURES, _CELLS = 2_000_000, 400_000


class Batch:
    """Sequences of items of like length: the feature numbers of all items in one row, and which item stands where."""

    def __init__(self, sequences: list[list[list[int]]]) -> None:
        self.lengths = np.array([len(s) for s in sequences])
        items = [f for s in sequences for f in s]
        sizes = np.array([len(f) for f in items])
        self.features = np.fromiter((x for f in items for x in f), np.int32, int(sizes.sum()))
        self.begins = np.cumsum(sizes) - sizes
        self.item_of = np.repeat(np.arange(len(items)), sizes)
        self.row = np.repeat(np.arange(len(sequences)), self.lengths)
        self.place = np.arange(len(items)) - np.repeat(np.cumsum(self.lengths) - self.lengths, self.lengths)
        self.mask = np.arange(self.lengths.max()) < self.lengths[:, None]

    def scores(self, emit: np.ndarray) -> np.ndarray:
        """Per sequence, place and label the sum of the weights."""
        out = np.zeros((*self.mask.shape, emit.shape[1]), np.float32)
        out[self.row, self.place] = np.add.reduceat(emit[self.features], self.begins)
        return out


def batches(sequences: list[list[list[int]]], size: int) -> Iterator[np.ndarray]:
    """Numbers of sequences of like length: at most `size` together, and no more features or labels than fit, but for a longer sequence."""
    order = np.array(sorted((i for i, s in enumerate(sequences) if s), key=lambda i: len(sequences[i])), int)
    begin, held = 0, 0
    for k, i in enumerate(order):
        own = sum(map(len, sequences[i]))
        if k > begin and (k - begin == size or held + own > _FEATURES or (k - begin + 1) * len(sequences[i]) > _CELLS):
            yield order[begin:k]
            begin, held = k, 0
        held += own
    if begin < len(order):
        yield order[begin:]


class CRF:
    """Labels sequences of items, each item a list of feature numbers, none empty."""

    def __init__(self, features: int, labels: int) -> None:
        self.emit = np.zeros((features, labels), np.float32)
        self.step = np.zeros((labels, labels), np.float32)

    def fit(self, sequences: list[list[list[int]]], labels: list[list[int]], epochs: int = 12, size: int = 128, rate: float = 0.3, decay: float = 3e-3, seed: int = 1) -> CRF:
        """Maximum likelihood by adaptive gradient steps; sequences of like length share a batch."""
        groups = []
        for own in batches(sequences, size):
            b = Batch([sequences[i] for i in own])
            y = np.zeros(b.mask.shape, np.int64)
            y[b.row, b.place] = np.fromiter((n for i in own for n in labels[i]), np.int64, len(b.row))
            order = np.argsort(b.features, kind="stable")
            rows, begins = np.unique(b.features[order], return_index=True)
            groups.append((b, y, rows, b.item_of[order], begins))
        coins = np.random.default_rng(seed)
        seen_emit, seen_step = np.full_like(self.emit, 1e-6), np.full_like(self.step, 1e-6)
        for _ in range(epochs):
            for g in coins.permutation(len(groups)):
                b, y, rows, items, begins = groups[g]
                n, t = b.mask.shape
                node, edge = self._marginals(b.scores(self.emit), b.mask)
                node[np.arange(n)[:, None], np.arange(t), y] -= 1
                for j in range(1, t):
                    edge[np.arange(n), j - 1, y[:, j - 1], y[:, j]] -= 1
                pull = (edge * b.mask[:, 1:, None, None]).sum((0, 1)) / n
                # Only the features that the batch has are touched.
                grad = np.add.reduceat(node[b.row, b.place][items], begins) / n + decay * self.emit[rows]
                seen_emit[rows] += grad**2
                seen_step += pull**2
                self.emit[rows] -= rate * grad / np.sqrt(seen_emit[rows])
                self.step -= rate * pull / np.sqrt(seen_step)
        return self

    def _marginals(self, scores: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        b, t, n = scores.shape
        ahead, behind = np.zeros((b, t, n)), np.zeros((b, t, n))
        ahead[:, 0] = scores[:, 0]
        for j in range(1, t):
            new = scores[:, j] + _log_sum(ahead[:, j - 1][:, :, None] + self.step, 1)
            ahead[:, j] = np.where(mask[:, j, None], new, ahead[:, j - 1])
        for j in range(t - 2, -1, -1):
            new = _log_sum(self.step + (scores[:, j + 1] + behind[:, j + 1])[:, None, :], 2)
            behind[:, j] = np.where(mask[:, j + 1, None], new, 0)
        whole = _log_sum(ahead[:, -1], 1)[:, None]
        node = np.exp(ahead + behind - whole[:, :, None])
        edge = np.exp(ahead[:, :-1, :, None] + self.step + (scores[:, 1:] + behind[:, 1:])[:, :, None, :] - whole[:, :, None, None])
        return node, edge

    def decode(self, sequences: list[list[list[int]]], size: int = 4096) -> list[list[int]]:
        """The best labels of every sequence."""
        out: list[list[int]] = [[] for _ in sequences]
        for own in batches(sequences, size):
            b = Batch([sequences[i] for i in own])
            scores = b.scores(self.emit)
            best, back = scores[:, 0], np.zeros(scores.shape, np.int8)
            for j in range(1, scores.shape[1]):
                total = best[:, :, None] + self.step
                on = b.mask[:, j, None]
                back[:, j] = np.where(on, total.argmax(1), np.arange(scores.shape[2]))
                best = np.where(on, total.max(1) + scores[:, j], best)
            path = np.zeros(b.mask.shape, np.int8)
            path[:, -1] = best.argmax(1)
            for j in range(scores.shape[1] - 1, 0, -1):
                path[:, j - 1] = back[np.arange(len(own)), j, path[:, j]]
            for k, i in enumerate(own):
                out[i] = path[k, : b.lengths[k]].tolist()
        return out


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis=axis))
