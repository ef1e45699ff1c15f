"""A recurrent labeller of block sequences in numpy: features, bidirectional LSTM, training.

Every block of a page is a vector: the sum of embeddings of the hashed tokens on its
tag path, the mean embedding of its hashed words, and a few statistics. A forward
and a backward LSTM read the page's vectors in order; a logistic unit over both
states and the vector itself labels each block, so its label depends on the whole page.
Pages of any length are read in stretches whose states are carried over.
"""

from __future__ import annotations

import zlib
from collections.abc import Sequence

import numpy as np

from farelake.llm.html_blocks import Block
from farelake.llm.shingles import PUNCTUATION, word_hashes

PATHS, WORDS = 1024, 2048  # hash ranges of path tokens and words
PATH_DIM, WORD_DIM, STATS, HIDDEN = 20, 12, 10, 24
WIDTH = PATH_DIM + WORD_DIM + STATS
STRETCH = 4096  # blocks of a page read at a time
CELLS = 1 << 15  # padded blocks read together


_MARK = np.zeros(256, bool)
_MARK[[ord(c) for c in ".!?,;"]] = True
_known: dict[tuple, list[int]] = {}  # hashed paths, up to so many


def _path_ids(block: Block) -> list[int]:
    key = (block.path, block.own)
    ids = _known.get(key)
    if ids is None:
        ids = [zlib.crc32(t.encode("utf-8", "replace")) % PATHS for t in (*block.path, "own " + block.own)]
        if len(_known) < 1 << 14:
            _known[key] = ids
    return ids


class Inputs:
    """Hashed tokens, words and statistics of some blocks, flat with bounds."""

    def __init__(self, blocks: Sequence[Block], first: int, total: int):
        ids = [_path_ids(b) for b in blocks]
        self.path = np.array([i for own in ids for i in own], np.int64)
        self.path_bounds = np.concatenate([[0], np.cumsum([len(i) for i in ids])]).astype(np.int64)
        encoded = [b.text.encode("utf-8", "replace") for b in blocks]
        sizes = np.array([len(e) for e in encoded], np.int64)
        offsets = np.concatenate([[0], np.cumsum(sizes)])
        data = np.frombuffer(b"".join(encoded), np.uint8)
        hashes, self.word_bounds = word_hashes(data, offsets, PUNCTUATION)
        self.words = (hashes % np.uint64(WORDS)).astype(np.int64)
        n_words = np.diff(self.word_bounds)
        chars = np.array([len(b.text) for b in blocks], float)
        sums = [np.concatenate([[0], np.cumsum(mask)]) for mask in (
            (data >= 48) & (data < 58), (data >= 65) & (data < 91), _MARK[data])]
        digits, upper, marks = (s[offsets[1:]] - s[offsets[:-1]] for s in sums)
        at = np.arange(first, first + len(blocks))
        self.stats = np.stack([
            np.log1p(n_words) / 5, np.log1p(chars) / 8, np.array([b.linked for b in blocks]) / np.maximum(chars, 1),
            np.array([b.text[-1:] in ".!?…»”\"" for b in blocks], float), digits / np.maximum(chars, 1), upper / np.maximum(chars, 1),
            np.minimum(marks / np.maximum(n_words, 1), 1), at / max(total - 1, 1), at == 0, at == total - 1],
            axis=1).astype(np.float32)

    def __len__(self) -> int:
        return len(self.stats)


def _sums(table: np.ndarray, ids: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sum of the embeddings of each stretch of ids; zeros for an empty one."""
    out = np.zeros((len(bounds) - 1, table.shape[1]), table.dtype)
    some = np.flatnonzero(np.diff(bounds))
    if len(some):
        out[some] = np.add.reduceat(table[ids], bounds[:-1][some], axis=0)
    return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


class Labeller:
    """The network; ``weights`` maps names to arrays."""

    def __init__(self, seed: int = 0):
        r = np.random.default_rng(seed)

        def draw(*shape, scale):
            return (r.standard_normal(shape) * scale).astype(np.float32)

        self.weights = {"path": draw(PATHS, PATH_DIM, scale=0.2), "words": draw(WORDS, WORD_DIM, scale=0.3),
                        "out": draw(2 * HIDDEN + WIDTH, scale=0.1), "bias": np.zeros(1, np.float32)}
        for way in ("f", "b"):
            self.weights["x" + way] = draw(WIDTH, 4 * HIDDEN, scale=WIDTH ** -0.5)
            self.weights["h" + way] = draw(HIDDEN, 4 * HIDDEN, scale=HIDDEN ** -0.5)
            start = np.zeros(4 * HIDDEN, np.float32)
            start[HIDDEN:2 * HIDDEN] = 1  # remember at first
            self.weights["c" + way] = start

    def vectors(self, inputs: Inputs) -> np.ndarray:
        w = self.weights
        n_words = np.maximum(np.diff(inputs.word_bounds), 1)[:, None]
        return np.concatenate([_sums(w["path"], inputs.path, inputs.path_bounds),
                               _sums(w["words"], inputs.words, inputs.word_bounds) / n_words, inputs.stats],
                              axis=1).astype(w["path"].dtype)

    def read(self, way: str, x: np.ndarray, state=None, trace: list | None = None):
        """States (steps, rows, HIDDEN) of one LSTM over x (steps, rows, WIDTH), and the last (h, c)."""
        w, k = self.weights, HIDDEN
        h, c = state if state is not None else (np.zeros((x.shape[1], k), x.dtype), np.zeros((x.shape[1], k), x.dtype))
        into = x @ w["x" + way] + w["c" + way]
        out = np.empty((*x.shape[:2], k), x.dtype)
        for t in range(len(x)):
            z = into[t] + h @ w["h" + way]
            gates = _sigmoid(z[:, :3 * k])
            g = np.tanh(z[:, 3 * k:])
            i, f, o = gates[:, :k], gates[:, k:2 * k], gates[:, 2 * k:]
            before, c = c, f * c + i * g
            th = np.tanh(c)
            if trace is not None:
                trace.append((h, before, gates, g, th))
            h = o * th
            out[t] = h
        return out, (h, c)

    def page(self, blocks: Sequence[Block]) -> np.ndarray:
        """Probability of being content for each block of a page of any length."""
        n, starts = len(blocks), range(0, len(blocks), STRETCH)
        back, state = np.empty((n, HIDDEN), np.float32), None
        for s in reversed(starts):
            x = self.vectors(Inputs(blocks[s:s + STRETCH], s, n))[::-1, None]
            states, state = self.read("b", x, state)
            back[s:s + STRETCH] = states[::-1, 0]
        out, state = np.empty(n), None
        for s in starts:
            x = self.vectors(Inputs(blocks[s:s + STRETCH], s, n))
            states, state = self.read("f", x[:, None], state)
            out[s:s + STRETCH] = self._label(np.concatenate([states[:, 0], back[s:s + STRETCH], x], axis=1))
        return out

    def _label(self, joined: np.ndarray) -> np.ndarray:
        return _sigmoid((joined @ self.weights["out"] + self.weights["bias"][0]).astype(float))

    def pages(self, pages: Sequence[Sequence[Block]]) -> list[np.ndarray]:
        """``page`` of each page; short ones are read together."""
        out: list[np.ndarray] = [np.zeros(0)] * len(pages)
        order = sorted((len(p), k) for k, p in enumerate(pages) if len(p))
        while order and order[-1][0] > STRETCH:
            k = order.pop()[1]
            out[k] = self.page(pages[k])
        while order:
            size = order[-1][0]
            group = [k for _, k in order[-max(1, CELLS // size):]]
            del order[-len(group):]
            inputs = [Inputs(pages[k], 0, len(pages[k])) for k in group]
            x, _, where = _pad([self.vectors(i) for i in inputs])
            scores = self._label(np.concatenate([self.read("f", x)[0], _turn(self.read("b", _turn(x, where))[0], where), x], axis=2))
            for j, k in enumerate(group):
                out[k] = scores[:len(pages[k]), j]
        return out


def _pad(rows: list[np.ndarray]):
    """Sequences side by side (steps, rows, width), the mask of real steps, and the reversed steps of each."""
    sizes = np.array([len(r) for r in rows])
    x = np.zeros((sizes.max(), len(rows), rows[0].shape[1]), rows[0].dtype)
    for j, r in enumerate(rows):
        x[:len(r), j] = r
    steps = np.arange(len(x))[:, None]
    where = np.where(steps < sizes, sizes - 1 - steps, steps)
    return x, steps < sizes, where


def _turn(x: np.ndarray, where: np.ndarray) -> np.ndarray:
    """Each sequence in reverse order, its padding left in place."""
    return np.take_along_axis(x, where[:, :, None], axis=0)


def gradients(net: Labeller, pages: list[Inputs], labels: list[np.ndarray]) -> tuple[float, dict[str, np.ndarray]]:
    """Mean log loss over all blocks, and its gradient by every weight (backpropagation through time)."""
    w, k = net.weights, HIDDEN
    rows = [net.vectors(p) for p in pages]
    x, mask, where = _pad(rows)
    y = np.zeros(mask.shape, x.dtype)
    for j, own in enumerate(labels):
        y[:len(own), j] = own
    traces: dict[str, list] = {"f": [], "b": []}
    xb = _turn(x, where)
    hf = net.read("f", x, trace=traces["f"])[0]
    hb = net.read("b", xb, trace=traces["b"])[0]
    joined = np.concatenate([hf, _turn(hb, where), x], axis=2)
    p = net._label(joined)
    n = mask.sum()
    loss = -float(((np.log(p + 1e-12) * y + np.log(1 - p + 1e-12) * (1 - y)) * mask).sum() / n)
    d = ((p - y) * mask / n).astype(x.dtype)
    out = {"out": np.einsum("tb,tbw->w", d, joined), "bias": np.array([d.sum()], x.dtype)}
    back = d[:, :, None] * w["out"]
    dx = back[:, :, 2 * k:].copy()
    for way, part, source in (("f", back[:, :, :k], x), ("b", _turn(back[:, :, k:2 * k], where), xb)):
        dz = np.empty((*x.shape[:2], 4 * k), x.dtype)
        dh, dc = np.zeros_like(hf[0]), np.zeros_like(hf[0])
        dwh = np.zeros_like(w["h" + way])
        for t in range(len(x) - 1, -1, -1):
            h0, c0, gates, g, th = traces[way][t]
            i, f, o = gates[:, :k], gates[:, k:2 * k], gates[:, 2 * k:]
            dh = dh + part[t]
            dc = dc + dh * o * (1 - th * th)
            z = dz[t]
            z[:, :k] = dc * g
            z[:, k:2 * k] = dc * c0
            z[:, 2 * k:3 * k] = dh * th
            z[:, :3 * k] *= gates * (1 - gates)
            z[:, 3 * k:] = dc * i * (1 - g * g)
            dwh += h0.T @ z
            dh, dc = z @ w["h" + way].T, dc * f
        out["h" + way] = dwh
        out["x" + way] = np.einsum("tbw,tbz->wz", source, dz, optimize=True)
        out["c" + way] = dz.sum(axis=(0, 1))
        more = dz @ w["x" + way].T
        dx += more if way == "f" else _turn(more, where)
    flat = np.concatenate([dx[:len(r), j] for j, r in enumerate(rows)])
    for name, low, high, ids, bounds in (("path", 0, PATH_DIM, "path", "path_bounds"),
                                         ("words", PATH_DIM, PATH_DIM + WORD_DIM, "words", "word_bounds")):
        sizes = np.concatenate([np.diff(getattr(p, bounds)) for p in pages])
        each = flat[:, low:high] if name == "path" else flat[:, low:high] / np.maximum(sizes, 1)[:, None].astype(x.dtype)
        out[name] = np.zeros_like(w[name])
        np.add.at(out[name], np.concatenate([getattr(p, ids) for p in pages]), np.repeat(each, sizes, axis=0))
    return loss, out


def train(pages: list[tuple[list[Block], np.ndarray]], epochs: int = 7, batch: int = 24, rate: float = 0.01,
          forget: float = 0.05, seed: int = 0) -> Labeller:
    """A labeller fitted by Adam; in training a share ``forget`` of path tokens and words is unseen."""
    net, r = Labeller(seed), np.random.default_rng(seed + 1)
    data = [(Inputs(blocks, 0, len(blocks)), labels) for blocks, labels in pages if blocks]
    first = {name: np.zeros_like(v) for name, v in net.weights.items()}
    second = {name: np.zeros_like(v) for name, v in net.weights.items()}
    step, steps = 0, epochs * -(-len(data) // batch)
    for _ in range(epochs):
        order = r.permutation(len(data))
        for s in range(0, len(order), batch):
            chosen = [data[k] for k in order[s:s + batch]]
            _, grads = gradients(net, [_thinned(i, forget, r) for i, _ in chosen], [y for _, y in chosen])
            step += 1
            size = np.sqrt(sum(float((g * g).sum()) for g in grads.values()))
            pace = rate * (1 - 0.98 * step / steps) * np.sqrt(1 - 0.999 ** step) / (1 - 0.9 ** step)
            for name, g in grads.items():
                g = g * min(1.0, 5 / (size + 1e-12))
                first[name] += 0.1 * (g - first[name])
                second[name] += 0.001 * (g * g - second[name])
                net.weights[name] -= (pace * first[name] / (np.sqrt(second[name]) + 1e-7)).astype(np.float32)
    return net


def _thinned(inputs: Inputs, forget: float, r: np.random.Generator) -> Inputs:
    out = object.__new__(Inputs)
    out.stats = inputs.stats
    for ids, bounds in (("path", "path_bounds"), ("words", "word_bounds")):
        keep = r.random(len(getattr(inputs, ids))) >= forget
        setattr(out, ids, getattr(inputs, ids)[keep])
        setattr(out, bounds, np.concatenate([[0], np.cumsum(keep)])[getattr(inputs, bounds)])
    return out
