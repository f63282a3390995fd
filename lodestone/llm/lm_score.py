"""Language-model scoring by a causal self-attention model trained in numpy.

Tokens are the words of the text (A-Z lowered, split at white space), then one
end. The model reads subword ids: a word's byte-level BPE pieces, its last piece
told apart from the others, so that no word's ids begin another's and word
probabilities add up to at most 1. The ``CLASSES * MEMBERS - 2`` commonest ids of
all training texts have a symbol each; the others share one and cost their
smoothed share of it.

Model. One layer: embeddings, single-head causal self-attention with learned
biases by distance, a residual and a ReLU layer, and a two-level softmax (class,
then member). Contexts are overlapping windows: blocks of ``BLOCK`` positions
attend to themselves, masked causally, and to the whole block before, so every
symbol is scored once with BLOCK to 2 * BLOCK - 1 symbols of context where the
text has them. Queries, keys and values of one layer depend on ids only, so they
are tables when scoring. Training has two parts. The driver finds a start by Adam
on about ``SAMPLE_DOCS`` whole texts, chosen by a hash. From that start every task goes
once over all blocks of all its training texts, in runs of ``RUN`` neighbours, and the network is the mean of
the tasks' weights along the way, each weighed by its blocks; so what is learned
from grows with the corpus and no text or part of one is left out.

Corpus counts. Every training text is counted; a word's probability is the
mixture of the attention model's and of the add-one unigram's over the whole
training corpus. Its weight is fitted to all training words: the tasks' pass notes each one's log probability by
the network before it learns from it, a join brings the counts, less the word itself, and a histogram of the differences is
what the driver gets. Tasks share the
counts of the commonest words, at most ``FREQUENT``; every other word's log probability
by the network is carried to its exact count by a join on 64-bit word hashes, so
score, base_score and n_known use exact counts for all words.

Defined results: an empty table gives an empty result; a null or empty text is one end. Without training rows N and V
are 0, base_score is 0 and the model is uniform. Rows are scored one by one,
repeated or not; texts of any length are scored whole. Extra columns stay out of
the result but for the id.

Scale: the corpus meets in two shuffles of (word hash, count) rows aggregated on
the map side; texts aren't shuffled. Words too common to be rare never enter the
join, so no key is hot.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow, bounded_batches, drop_stored, holding, read, remainder, sampled, stored
from .textkit import LOWER, NOT_SPACE, mix64, slices, span_hashes, utf8, words
from .tokens import VOCABULARY, encoder

CLASSES, MEMBERS, DIM, HIDDEN, BLOCK = 32, 32, 16, 32, 16
SAMPLE_DOCS, STEPS, BATCH, RATE, TASK_RATE = 1500, 1000, 256, 1.5e-2, 2e-3
FREQUENT = 65_535
#: Neighbouring blocks that stay together in a batch of the tasks' pass, so that most are read once and not again as what stands before.
RUN = 8
#: Greatest logarithm whose exponential float32 takes as it is.
STEEP = 60
CHUNK, STRIDE = 1024, 128
COUNTED_AT_ONCE = 4_000_000
ENCODED_AT_ONCE = 100_000
MERGED_BY = 16
#: Steps of the histogram in a nat.
FINE = 64
END = np.uint64(0x454E4421)
_LOWER = LOWER.tobytes()
_CACHE = 300_000


def pieces(path: str, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Ids of the words, a word's last one moved up, and each word's bounds. Words hold no line feed, so one call does for all."""
    encoding, size = encoder(path)[0], len(encoder(path)[1])
    feed = encoding.encode_ordinary("\n")[0]
    ids = encoding.encode_to_numpy(b"\n".join([*words, b""]).decode("utf-8", "replace"), disallowed_special=()).astype(np.int64)
    stops = np.flatnonzero(ids == feed)
    ids[stops - 1] += size
    bounds = np.concatenate(([0], stops - np.arange(len(stops))))
    return np.delete(ids, stops), bounds


class Symbols:
    """Subword ids to symbols; 0 is shared by all ids without one of their own, 1 is the end."""

    def __init__(self, path: str, counts: np.ndarray):
        """``counts``: of all ids in the training texts."""
        self.path = path
        self.size = 2 * len(encoder(path)[1])
        self.of = np.zeros(self.size, np.uint16)
        ranked = np.lexsort((np.arange(self.size), -counts))
        own = ranked[: CLASSES * MEMBERS - 2][counts[ranked[: CLASSES * MEMBERS - 2]] > 0]
        self.of[own] = np.arange(2, len(own) + 2)
        rest = counts.sum() - counts[own].sum()
        self.cost = np.log((counts + 0.5) / (rest + 0.5 * self.size))
        self.cost[own] = 0.0

    def encode(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Symbols of the words, by word the log probability of its ids among those that share symbol 0, and bounds."""
        ids, bounds = pieces(self.path, words)
        return self.of[ids], np.add.reduceat(self.cost[ids], bounds[:-1]), bounds


def _range(s: np.ndarray) -> None:
    """Rows of logits less each one's greatest, in place, only where an exponential could leave float32's range; softmaxes stay the same."""
    if s.size and not max(s.max(), -s.min()) <= STEEP:
        s -= s.max(axis=-1, keepdims=True)


class Attention:
    """The network, its training and its scoring; log probabilities are natural."""

    def __init__(self, seed: int = 7):
        r = np.random.default_rng(seed)
        g = lambda *s: (r.standard_normal(s) * 0.1).astype(np.float32)
        n = CLASSES * MEMBERS
        self.p = {
            "e": g(n + 1, DIM), "q": g(DIM, DIM), "k": g(DIM, DIM), "v": g(DIM, DIM), "o": g(DIM, DIM), "d": np.zeros(2 * BLOCK, np.float32),
            "w": g(DIM, HIDDEN) * 3, "b": np.zeros(HIDDEN, np.float32), "c": g(HIDDEN, CLASSES), "cb": np.zeros(CLASSES, np.float32), "m": g(CLASSES, HIDDEN, MEMBERS), "mb": np.zeros((CLASSES, MEMBERS), np.float32),
        }
        i, j = np.arange(BLOCK)[:, None], np.arange(2 * BLOCK)[None, :]
        self.distance = np.clip(i + BLOCK - j, 0, 2 * BLOCK - 1)
        self.future = j > i + BLOCK

    def layout(self, symbols: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Rows cut into blocks: input ids (blocks + 1, BLOCK), the block before each, and each symbol's place.

        The last block is empty and stands before every first one. Inputs are the targets moved by one.
        """
        n = np.diff(bounds)
        blocks = -(-n // BLOCK)
        first = np.concatenate(([0], np.cumsum(blocks)))
        place = np.arange(len(symbols)) + np.repeat(first[:-1] * BLOCK - bounds[:-1], n)
        start = CLASSES * MEMBERS
        ids = np.full((first[-1] + 1) * BLOCK, -1, np.int32)
        ids[place] = np.concatenate(([start], symbols[:-1])) if len(symbols) else symbols
        ids[first[:-1][n > 0] * BLOCK] = start
        before = np.arange(first[-1]) - 1
        before[first[:-1][n > 0]] = first[-1]
        return ids.reshape(-1, BLOCK), before, place

    def mask(self, ids: np.ndarray) -> np.ndarray:
        """-1e9 where a query may not look (the future, padding, no block before)."""
        return np.where(self.future[None] | (ids < 0)[:, None, :], np.float32(-1e9), np.float32(0))

    def score(self, symbols: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Log probability of each symbol given those before it in its row."""
        out = np.empty(len(symbols), np.float32)
        if not len(symbols):
            return out
        p = self.p
        queries, keys = p["e"] @ p["q"] / np.float32(math.sqrt(DIM)), p["e"] @ p["k"]
        values, own = p["e"] @ p["v"] @ p["o"] @ p["w"], p["e"] @ p["w"] + p["b"]
        ids, before, place = self.layout(symbols, bounds)
        first = before == len(before)
        # a block's predecessor lies just before it, and only a row's last block is padded, behind all real queries
        bias = p["d"][self.distance]
        earlier, mine = bias[:, :BLOCK], bias[:, BLOCK:] + np.where(self.future[:, BLOCK:], np.float32(-1e9), np.float32(0))
        ones = np.ones((BLOCK, 1), np.float32)
        for x in range(0, len(before), CHUNK):
            y = min(x + CHUNK, len(before))
            hidden = np.empty(((y - x) * BLOCK, HIDDEN), np.float32)
            for a in range(x, y, STRIDE):
                b = min(a + STRIDE, y)
                lead = max(a - 1, 0)
                skip = a - lead
                k = np.ascontiguousarray(keys[ids[lead:b]].transpose(0, 2, 1))
                v, q = values[ids[lead:b]], queries[ids[a:b]]
                s = np.matmul(q, k[skip:])
                s += mine
                e = np.matmul(q[1 - skip :], k[:-1])
                e += earlier
                e[first[a + 1 - skip : b]] = -1e9
                # a query always sees its own key, so the least of these bounds the sums from below
                if not max(s.max(), e.max(initial=-1e9), -np.einsum("bii->bi", s).min()) <= STEEP:
                    top = s.max(axis=-1, keepdims=True)
                    np.maximum(top[1 - skip :], e.max(axis=-1, keepdims=True), out=top[1 - skip :])
                    s -= top
                    e -= top[1 - skip :]
                np.exp(s, out=s)
                np.exp(e, out=e)
                h = np.matmul(s, v[skip:])
                total = s @ ones
                h[1 - skip :] += np.matmul(e, v[:-1])
                total[1 - skip :] += e @ ones
                h /= total
                h += own[ids[a:b]]
                np.maximum(h, 0, out=hidden[(a - x) * BLOCK : (b - x) * BLOCK].reshape(h.shape))
            low, high = np.searchsorted(place, [x * BLOCK, y * BLOCK])
            out[low:high] = self._softmax(hidden, place[low:high] - x * BLOCK, symbols[low:high])
        return out

    def _softmax(self, hidden: np.ndarray, place: np.ndarray, target: np.ndarray) -> np.ndarray:
        """Log probabilities of the targets, whose hidden rows are at ``place``; rows are grouped by class."""
        p, ones = self.p, np.ones((MEMBERS, 1), np.float32)
        cls = target // MEMBERS
        order = np.argsort(cls.astype(np.uint8), kind="stable")
        cuts = np.searchsorted(cls[order], np.arange(CLASSES + 1))
        h, member = hidden[place[order]], (target % MEMBERS)[order]
        logits = h @ p["c"]
        logits += p["cb"]
        _range(logits)
        picked, mass = np.empty(len(h), np.float32), np.empty((len(h), 1), np.float32)
        for c in range(CLASSES):
            s = slice(cuts[c], cuts[c + 1])
            n = s.stop - s.start
            if n:
                x = h[s] @ p["m"][c]
                x += p["mb"][c]
                _range(x)
                picked[s] = logits[s, c] + x.ravel()[np.arange(n) * MEMBERS + member[s]]
                np.exp(x, out=x)
                np.matmul(x, ones, out=mass[s])
        np.exp(logits, out=logits)
        out = np.empty(len(h), np.float32)
        out[order] = picked - np.log(logits @ np.ones(CLASSES, np.float32)) - np.log(mass[:, 0])
        return out

    def step(self, mine: np.ndarray, both: np.ndarray, target: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean loss and gradients of a batch of blocks, each given with the one before it; targets under 0 don't count."""
        own = np.where(both[:, BLOCK:] < 0, -1, mine)
        return self.gradient(np.concatenate((own, both[:, :BLOCK])), np.arange(len(own), 2 * len(own)), target)

    def gradient(self, rows: np.ndarray, before: np.ndarray, target: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """The same for the first blocks of ``rows``, as many as have targets; ``before``: the row of the block before each, none named twice. So a block that another follows is read once."""
        p, scale, blocks = self.p, np.float32(1 / math.sqrt(DIM)), len(target)
        flat = lambda m: m.reshape(-1, m.shape[-1])
        kind, n = p["e"].dtype, blocks * BLOCK
        wide = np.concatenate((p["q"] * scale, p["k"], p["v"]), axis=1)
        x = np.take(p["e"], rows.ravel(), axis=0, mode="wrap")  # padding, -1, is the last row
        qkv = (x @ wide).reshape(-1, BLOCK, 3 * DIM)
        q, kv = qkv[:blocks, :, :DIM], np.empty((blocks, 2 * BLOCK, 2 * DIM), kind)
        kv[:, :BLOCK], kv[:, BLOCK:] = qkv[before, :, DIM:], qkv[:blocks, :, DIM:]
        k, v = kv[:, :, :DIM], kv[:, :, DIM:]
        a = q @ k.transpose(0, 2, 1)
        a += p["d"][self.distance]
        padded = np.concatenate((rows[before] < 0, rows[:blocks] < 0), axis=1)
        some = np.flatnonzero(padded.any(axis=1))
        self._exp(a, (slice(None), self.future), (some, padded[some][:, None, :]))
        z = a @ v
        r = flat(z) @ p["o"]
        r += x[:n]
        h = r @ p["w"]
        h += p["b"]
        np.maximum(h, 0, out=h)
        # rows with a target, grouped by its class
        t = target.ravel()
        real = np.flatnonzero(t >= 0)
        order = np.argsort((t[real] // MEMBERS).astype(np.uint8), kind="stable")
        at = real[order]
        t, m = t[at], len(at)
        cls, one = t // MEMBERS, np.ones(m, kind)
        cuts = np.concatenate(([0], np.cumsum(np.bincount(cls, minlength=CLASSES)))).tolist()
        runs = [(c, slice(i, j)) for c, (i, j) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)) if i < j]
        hs = np.take(h, at, axis=0)
        pc = hs @ p["c"]
        pc += p["cb"]
        self._exp(pc)
        pm = np.empty((m, MEMBERS), kind)
        for c, s in runs:
            np.matmul(hs[s], p["m"][c], out=pm[s])
        pm += np.take(p["mb"], cls, axis=0)
        self._exp(pm)
        lp = np.zeros(m, kind)
        for y, of in ((pc, cls), (pm, t - cls * MEMBERS)):
            place, y = np.arange(0, y.size, y.shape[1]) + of, y.ravel()
            hit = y[place]
            lp += np.log(hit + 1e-30)
            y[place] = hit - 1
            y *= np.float32(1 / max(m, 1))
        self.last = np.empty(m, kind)
        self.last[order] = lp
        grad = {"c": hs.T @ pc, "cb": one @ pc, "m": np.zeros_like(p["m"]), "mb": np.zeros_like(p["mb"])}
        dh, more = np.empty((m + 1, HIDDEN), kind), np.empty((m, HIDDEN), kind)
        for c, s in runs:
            np.matmul(hs[s].T, pm[s], out=grad["m"][c])
            np.matmul(one[s], pm[s], out=grad["mb"][c])
            np.matmul(pm[s], p["m"][c].T, out=more[s])
        np.matmul(pc, p["c"].T, out=dh[:m])
        dh[:m] += more
        dh[:m] *= hs > 0
        dh[m] = 0  # rows without a target
        place = np.full(n, m)
        place[at] = np.arange(m)
        full = np.take(dh, place, axis=0)
        grad["w"], grad["b"] = r.T @ full, one @ dh[:m]
        dr = full @ p["w"].T
        grad["o"] = flat(z).T @ dr
        dz = (dr @ p["o"].T).reshape(z.shape)
        ds = dz @ v.transpose(0, 2, 1)
        ds -= np.einsum("bij,bij->bi", dz, z)[:, :, None]
        ds *= a
        grad["d"] = np.bincount(self.distance.ravel(), ds.sum(axis=0).ravel(), 2 * BLOCK).astype(np.float32)
        back, dkv = np.zeros_like(qkv), np.empty_like(kv)
        np.matmul(ds.transpose(0, 2, 1), q, out=dkv[:, :, :DIM])
        np.matmul(a.transpose(0, 2, 1), dz, out=dkv[:, :, DIM:])
        np.matmul(ds, k, out=back[:blocks, :, :DIM])
        back[:blocks, :, DIM:] = dkv[:, BLOCK:]
        back[before, :, DIM:] += dkv[:, :BLOCK]
        of = x.T @ flat(back)
        grad["q"], grad["k"], grad["v"] = of[:, :DIM] * scale, of[:, DIM : 2 * DIM], of[:, 2 * DIM :]
        dx = flat(back) @ wide.T
        dx[:n] += dr
        at = rows.ravel() % len(p["e"])  # padding, -1, has no gradient
        order = np.argsort(at.astype(np.uint16), kind="stable")
        at = at[order]
        first = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
        grad["e"] = np.zeros_like(p["e"])
        grad["e"][at[first]] = np.add.reduceat(np.take(dx, order, axis=0), first, axis=0)
        return float(-lp.sum() / max(m, 1)), grad

    def _exp(self, s: np.ndarray, *hidden: tuple) -> None:
        """Rows of ``s`` to their softmax, in place; ``hidden``: some blocks of it, and where they may not look. Only where an exponential could leave float32's range is a row's greatest subtracted."""
        if s.size and not max(s.max(), -s.min()) <= STEEP:
            for at, where in hidden:
                s[at] += np.where(where, np.float32(-1e9), np.float32(0))
            s -= s.max(axis=-1, keepdims=True)
        np.exp(s, out=s)
        for at, where in hidden:
            s[at] *= np.where(where, np.float32(0), np.float32(1))
        s /= (s.reshape(-1, s.shape[-1]) @ np.ones((s.shape[-1], 1), s.dtype)).reshape(*s.shape[:-1], 1)

    def train(self, symbols: np.ndarray, bounds: np.ndarray, steps: int = STEPS, seed: int = 7) -> list[float]:
        """Adam on random blocks; returns the losses."""
        blocks = Blocks(self, symbols, bounds)
        r, adam, losses = np.random.default_rng(seed), Adam(self), []
        for t in range(1, steps + 1):
            pick = r.integers(0, len(blocks), min(BATCH, len(blocks)))
            losses.append(adam.update(blocks, pick, RATE * min(1.0, t / 20) * (0.05 + 0.95 * 0.5 * (1 + math.cos(math.pi * t / steps)))))
        return losses


class Blocks:
    """Rows of symbols laid out for training."""

    def __init__(self, net: Attention, symbols: np.ndarray, bounds: np.ndarray):
        self.ids, self.before, place = net.layout(symbols, bounds)
        target = np.full(self.ids.size, -1, np.int32)
        target[place] = symbols
        self.target, self.place = target.reshape(-1, BLOCK), place

    def __len__(self) -> int:
        return len(self.before)


def picks(blocks: int, r: np.random.Generator) -> list[np.ndarray]:
    """All blocks once in batches of about BATCH, by runs of RUN neighbours in random order."""
    runs = np.array_split(r.permutation(-(-blocks // RUN)), max(1, -(-blocks // BATCH)))
    return [x[x < blocks] for x in ((run[:, None] * RUN + np.arange(RUN)).ravel() for run in runs) if len(x)]


class Adam:
    """Steps on all weights as one vector; the network's are views of it."""

    def __init__(self, net: Attention):
        self.net, self.t, self.all = net, 0, _flat(net.p)
        self.first, self.second = np.zeros_like(self.all), np.zeros_like(self.all)
        net.p = _shaped(self.all, net.p)

    def update(self, blocks: Blocks, pick: np.ndarray, rate: float) -> float:
        """One step on the picked blocks; returns their loss."""
        before, n = blocks.before[pick], len(pick)
        apart = np.concatenate(([True], before[1:] != pick[:-1]))[:n]  # the block before isn't the one picked before
        at = np.arange(-1, n - 1)
        at[apart] = np.arange(n, n + apart.sum())
        loss, grad = self.net.gradient(blocks.ids[np.concatenate((pick, before[apart]))], at, blocks.target[pick])
        self.t += 1
        rate, root = np.float32(rate / (1 - 0.9**self.t)), np.float32(1 / math.sqrt(1 - 0.99**self.t))
        g, m, v = _flat(grad), self.first, self.second
        m *= np.float32(0.9)
        m += np.float32(0.1) * g
        v *= np.float32(0.99)
        g *= g
        g *= np.float32(0.01)
        v += g
        by = np.sqrt(v)
        by *= root
        by += np.float32(1e-8)
        np.divide(m, by, out=by)
        by *= rate
        self.all -= by
        return loss


def _flat(p: dict[str, np.ndarray]) -> np.ndarray:
    return np.concatenate([p[k].ravel() for k in sorted(p)])


def _shaped(flat: np.ndarray, like: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """Views of what ``_flat`` made."""
    stops = np.cumsum([like[k].size for k in sorted(like)])
    return {k: flat[i - like[k].size : i].reshape(like[k].shape) for k, i in zip(sorted(like), stops.tolist(), strict=True)}


class Scorer:
    """What the tasks share: symbols, network, frequent words and the mixture's weight."""

    def __init__(self, symbols: Symbols, net: Attention, frequent: np.ndarray, counts: np.ndarray, total: int, kinds: int, end_count: int):
        order = np.argsort(frequent)
        self.symbols, self.net = symbols, net
        self.frequent = frequent[order]
        self.counts = np.concatenate(([0], counts[order])).astype(np.float64)  # by rank; rank 0: any other word
        self.total, self.kinds, self.end_count = total, kinds, end_count
        self.share = 0.5
        self.forget()

    def forget(self) -> None:
        """Empty the words' cache: each one's number in order of learning, and by number its rank, shared cost, hash, symbols and their bounds."""
        self.cache: dict[bytes, int] = {}
        self.rank, self.cost, self.hash = np.zeros(0, np.int32), np.zeros(0, np.float32), np.zeros(0, np.uint64)
        self.pool, self.bounds = np.zeros(0, np.uint16), np.zeros(1, np.int64)

    def __getstate__(self):
        kept = self.__dict__.copy()
        for k in ("cache", "rank", "cost", "hash", "pool", "bounds"):
            kept.pop(k)
        return kept

    def __setstate__(self, kept):
        self.__dict__.update(kept)
        self.forget()

    def trim(self) -> None:
        """Of a full cache, only frequent words are kept."""
        if len(self.cache) > _CACHE:
            keep, size = self.rank > 0, np.diff(self.bounds)
            self.pool, self.bounds = self.pool[np.repeat(keep, size)], np.concatenate(([0], np.cumsum(size[keep])))
            self.cache = {w: i for i, w in enumerate(itertools.compress(self.cache, keep.tolist()))}
            self.rank, self.cost, self.hash = self.rank[keep], self.cost[keep], self.hash[keep]

    def learn(self, missing: list[bytes]) -> None:
        """Take new words into the cache."""
        at = np.concatenate(([0], np.cumsum([len(w) for w in missing]))).astype(np.int64)
        h = span_hashes(np.frombuffer(b"".join(missing), np.uint8), at[:-1], at[1:])
        where = np.minimum(np.searchsorted(self.frequent, h), max(0, len(self.frequent) - 1))
        rank = np.where(self.frequent[where] == h, where + 1, 0) if len(self.frequent) else np.zeros(len(h), np.int64)
        symbols, costs, bounds = self.symbols.encode(missing)
        self.cache.update(zip(missing, range(len(self.cache), len(self.cache) + len(missing)), strict=True))
        self.rank, self.cost, self.hash = np.append(self.rank, rank.astype(np.int32)), np.append(self.cost, costs.astype(np.float32)), np.append(self.hash, h)
        self.pool, self.bounds = np.append(self.pool, symbols), np.append(self.bounds, bounds[1:] + self.bounds[-1])

    def read(self, texts: list[str], score: Callable[[np.ndarray, np.ndarray], np.ndarray] | None = None) -> tuple[np.ndarray, ...]:
        """Words by text and each word's rank; by word or end in order: its text, network log probability and count; the rare words' places there and hashes."""
        split = [t.encode("utf-8", "replace").translate(_LOWER).split() for t in texts]
        everything = list(itertools.chain.from_iterable(split))
        self.trim()
        word = np.fromiter(map(self.cache.get, everything, itertools.repeat(-1)), np.int64, len(everything))
        new = np.flatnonzero(word < 0)
        if len(new):
            spelled = [everything[i] for i in new.tolist()]
            self.learn(list(dict.fromkeys(spelled)))
            word[new] = np.fromiter(map(self.cache.__getitem__, spelled), np.int64, len(spelled))
        n = np.array([len(x) for x in split], np.int64)
        rank, size = self.rank[word].astype(np.int64), self.bounds[word + 1] - self.bounds[word]
        # words and ends in order: each text's words, then symbol 1
        word_row, row = np.repeat(np.arange(len(n)), n), np.repeat(np.arange(len(n)), n + 1)
        real = np.ones(len(row), bool)
        real[np.cumsum(n + 1) - 1] = False
        wide = np.ones(len(row), np.int64)
        wide[real] = size
        starts = np.cumsum(wide) - wide
        ends = starts[~real]
        bounds = np.concatenate(([0], ends + 1))
        symbols = np.ones(int(wide.sum()), np.int64)
        spelt = np.ones(len(symbols), bool)
        spelt[ends] = False
        symbols[spelt] = self.pool[np.repeat(self.bounds[word] - np.cumsum(size) + size, size) + np.arange(len(symbols) - len(ends))]
        lp = (score or self.net.score)(symbols, bounds).astype(np.float64)
        by_word = np.add.reduceat(lp, starts) if len(starts) else lp
        by_word[real] += self.cost[word]
        count = np.empty(len(starts))
        count[~real], count[real] = self.end_count, self.counts[rank]
        rare = np.flatnonzero(rank == 0)
        return n, word_row, rank, row, by_word, count, np.flatnonzero(real)[rare], self.hash[word[rare]]

    def unigram(self, count: np.ndarray) -> np.ndarray:
        return np.log(count + 1) - math.log(self.total + self.kinds + 1)

    def texts(self, texts: list[str]) -> tuple[tuple[np.ndarray, ...], tuple[np.ndarray, ...]]:
        """By text: tokens, frequent tokens known, their sum of log10(c + 1), and the mixture's log10 probability without the rare words; by rare word: its text, hash and network log probability."""
        n, word_row, rank, row, by_word, count, rare, hashes = self.read(texts)
        mixed = np.logaddexp(by_word + math.log(self.share), self.unigram(count) + math.log1p(-self.share)) / math.log(10)
        mixed[rare] = 0
        known = np.bincount(word_row, rank > 0, len(n)).astype(np.int64)
        logs = np.bincount(word_row, np.log10(self.counts[rank] + 1), len(n)).astype(np.float64)
        return (n + 1, known, logs, np.bincount(row, mixed, len(n)).astype(np.float64)), (row[rare], hashes, by_word[rare])

    def fit_share(self, ahead: np.ndarray, n: np.ndarray) -> None:
        """Expectation maximisation of the mixture's weight, held to 0.02..0.98; ``n`` words have a log probability by the network that is ``ahead`` of the unigram's."""
        for _ in range(50 if len(n) else 0):
            x, y = ahead + math.log(self.share), math.log1p(-self.share)
            self.share = float(np.clip(np.average(np.exp(x - np.logaddexp(x, y)), weights=n), 0.02, 0.98))


def _holding(f: Callable) -> Callable:
    """``f`` with the memory it frees held until its task ends."""

    def task(batches):
        with holding():
            yield from f(batches)

    return task


def _distinct(held: list[tuple[np.ndarray, ...]], path: str, ids: np.ndarray) -> pa.RecordBatch:
    """The held words' counts; the counts of their ids are added to ``ids``."""
    h, at, c = np.unique(np.concatenate([np.zeros(0, np.uint64), *(x[0] for x in held)]), return_index=True, return_counts=True)
    cuts = np.concatenate(([0], np.cumsum([len(x[0]) for x in held]))).astype(np.int64)
    which = np.searchsorted(cuts, at, "right") - 1
    order = np.argsort(which, kind="stable")
    for x in range(0, len(order), ENCODED_AT_ONCE):
        part, spelled = order[x : x + ENCODED_AT_ONCE], []
        for k in np.unique(which[part]):
            _, low, starts, ends = held[k]
            mine, raw = at[part[which[part] == k]] - cuts[k], low.tobytes()
            spelled += [raw[a:b] for a, b in zip(starts[mine].tolist(), ends[mine].tolist(), strict=True)]
        found, bounds = pieces(path, spelled)
        ids += np.bincount(found, np.repeat(c[part], np.diff(bounds)), len(ids)).astype(np.int64)
    return _counted(False, h.view(np.int64), c)


def _counted(piece: bool, h: np.ndarray, c: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(h), piece)), pa.array(h.astype(np.int64)), pa.array(c.astype(np.int64))], names=["piece", "h", "c"])


def word_counts(train: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """piece, h, c: of every word of the training texts (column text) by its hash, and where ``piece`` of every subword id."""

    def partial(batches):
        held, size, ids = [], 0, np.zeros(2 * len(encoder(vocabulary)[1]), np.int64)
        for b in batches:
            buf, offsets = utf8(b.column("text"))
            for _, _, part, at in slices(buf, offsets):
                low = LOWER[part]
                starts, ends, _ = words(low, at, NOT_SPACE)
                held.append((span_hashes(low, starts, ends), low, starts, ends))
                size += len(starts)
                if size > COUNTED_AT_ONCE:
                    yield _distinct(held, vocabulary, ids)
                    held, size = [], 0
        yield _distinct(held, vocabulary, ids)
        yield _counted(True, np.flatnonzero(ids), ids[ids > 0])

    return train.select("text").transform(arrow, _holding(partial), "piece:boolean,h:bigint,c:bigint").groupBy("piece", "h").agg(F.sum("c").alias("c"))


class Rows:
    """Texts as rows of symbols, each with its end."""

    def __init__(self, symbols: Symbols):
        self.symbols, self.cache = symbols, {}

    def __call__(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        split = [t.encode("utf-8", "replace").translate(_LOWER).split() for t in texts]
        if len(self.cache) > _CACHE:
            self.cache = {}
        missing = list({w for s in split for w in s}.difference(self.cache))
        if missing:
            found, _, bounds = self.symbols.encode(missing)
            raw, cuts = found.tobytes(), (2 * bounds).tolist()
            self.cache.update(zip(missing, map(raw.__getitem__, map(slice, cuts[:-1], cuts[1:])), strict=True))
        end = np.uint16(1).tobytes()
        rows = [b"".join([*map(self.cache.__getitem__, s), end]) for s in split]
        return np.frombuffer(b"".join(rows), np.uint16).astype(np.int64), np.concatenate(([0], np.cumsum([len(r) // 2 for r in rows]))).astype(np.int64)


def learned(train: DataFrame, scorer: Scorer, counts: DataFrame) -> None:
    """Moves the network by one pass of every task over all of its training texts (column text), and fits the mixture's weight to what it finds.

    ``counts``: h, c of all training words.
    """
    net = scorer.net
    shared = train.sparkSession.sparkContext.broadcast(scorer)

    def result(n, total):
        return pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([total.tobytes()], pa.binary())], names=["n", "total"])

    def found(n, h, step):
        return pa.RecordBatch.from_arrays([pa.array(n.astype(np.int64)), pa.nulls(len(n), pa.binary()), h, pa.array(step)], names=["n", "total", "h", "step"])

    def learn(batches):
        own, mine = Attention(), shared.value
        own.p = {k: v.copy() for k, v in mine.net.p.items()}
        adam, r = Adam(own), np.random.default_rng(7)
        n, total = 0, np.zeros(len(_flat(own.p)))

        def train_on(symbols, bounds):
            """Learns from the rows block by block; log probabilities of the symbols as they were before their own step."""
            nonlocal n, total
            blocks = Blocks(own, symbols, bounds)
            lp = np.zeros(blocks.target.shape, np.float32)
            for pick in picks(len(blocks), r):
                adam.update(blocks, pick, TASK_RATE * min(1.0, (adam.t + 1) / 50))
                part = lp[pick]
                part[blocks.target[pick] >= 0] = own.last
                lp[pick] = part
                n += len(pick)
                total += np.float64(len(pick)) * adam.all
            return lp.ravel()[blocks.place]

        for b in batches:
            texts = b.column("text").to_pylist()
            size = np.cumsum([len(t) for t in texts])
            cut = np.searchsorted(size, np.arange(1, 1 + (size[-1] >> 19 if len(size) else 0)) << 19) + 1
            for x, y in zip([0, *cut.tolist()], [*cut.tolist(), len(texts)], strict=True):
                if x >= y:
                    continue
                *_, by_word, count, rare, hashes = mine.read(texts[x:y], train_on)
                common = np.ones(len(by_word), bool)
                common[rare] = False
                step, times = np.unique(np.floor((by_word - mine.unigram(np.maximum(count - 1, 0)))[common] * FINE).astype(np.int64), return_counts=True)
                yield found(times, pa.nulls(len(step), pa.int64()), step)
                yield found(np.ones(len(rare)), pa.array(hashes.view(np.int64)), np.floor(by_word[rare] * FINE).astype(np.int64))
        if n:
            more = [pa.nulls(1, pa.int64())] * 2
            yield pa.RecordBatch.from_arrays([*result(n, total).columns, *more], names=["n", "total", "h", "step"])

    def merge(batches):
        n, total = 0, 0.0
        for b in batches:
            n += sum(b.column("n").to_pylist())
            total = sum((np.frombuffer(x, np.float64) for x in b.column("total").to_pylist()), total)
        if n:
            yield result(n, total)

    schema = "n:bigint,total:binary"
    passed = stored(train.select("text").transform(arrow, _holding(learn), f"{schema},h:bigint,step:bigint"), "learned")
    parts = passed.where("total is not null").select("n", "total").repartition(MERGED_BY).transform(arrow, merge, schema).collect()
    if parts:
        mean = sum(np.frombuffer(x.total, np.float64) for x in parts) / sum(x.n for x in parts)
        net.p = _shaped(mean.astype(np.float32), net.p)
    # a rare word's count is exact and leaves out the word itself, as a common one's does
    rare = passed.where("h is not null").select("h", "step", "n").join(counts, "h")
    less = F.log(F.col("c").cast("double")) - math.log(scorer.total + scorer.kinds + 1)
    steps = rare.select(F.floor(F.col("step") - less * FINE).alias("step"), "n").unionByName(passed.where("h is null and total is null").select("step", "n"))
    ahead = steps.groupBy("step").agg(F.sum("n").alias("n")).orderBy("step").toArrow()
    scorer.fit_share((ahead.column("step").to_numpy() + 0.5) / FINE, ahead.column("n").to_numpy().astype(np.float64))
    drop_stored(passed)


def _commonest(counts: DataFrame, most: int) -> list:
    """Rows (h, c) of the greatest counts, at most ``most``: a histogram of the counts' logarithms gives the cut, so no task sends more."""
    level = F.floor(F.log2(F.col("c")) * 32)
    cut, n = None, 0
    for r in sorted(counts.groupBy(level.alias("k")).agg(F.count("*").alias("n")).collect(), key=lambda r: -r.k):
        n += r.n
        if n > most:
            break
        cut = r.k
    return [] if cut is None else counts.where(level >= cut).collect()


def fitted(train: DataFrame, vocabulary: str = VOCABULARY) -> tuple[Scorer, DataFrame]:
    """The scorer, and the stored counts of all training words; ``train``: id, text (not null)."""
    everything = stored(word_counts(train, vocabulary), "counts")
    counts = everything.where("not piece").select("h", "c")
    totals = counts.agg(F.count("*").alias("v"), F.sum("c").alias("n")).first()
    ends = train.count()
    top = _commonest(counts, FREQUENT)
    sample = sampled(train.select(F.xxhash64("id", "text").alias("r"), F.col("text").alias("t")), F.col("r"), SAMPLE_DOCS).groupBy("r").agg(F.min("t").alias("t")).collect()
    texts = [r.t for r in sorted(sample, key=lambda r: (r.r, r.t))][: 2 * SAMPLE_DOCS]
    found = everything.where("piece").select("h", "c").toArrow()
    of_ids = np.zeros(2 * len(encoder(vocabulary)[1]), np.int64)
    of_ids[found.column("h").to_numpy()] = found.column("c").to_numpy()
    symbols, net = Symbols(vocabulary, of_ids), Attention()
    if texts:
        with holding():
            net.train(*Rows(symbols)(texts))
    scorer = Scorer(symbols, net, np.array([r.h for r in top], np.int64).view(np.uint64), np.array([r.c for r in top], np.int64), (totals.n or 0) + ends, totals.v + (ends > 0), ends)
    learned(train, scorer, counts)
    return scorer, counts


def scored(docs: DataFrame, held_out: Column, *, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row; rows not held out are learned from."""
    spark = docs.sparkSession
    bounded_batches(spark)
    base = docs.select(F.col(id_col).cast("bigint").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"), F.coalesce(held_out, F.lit(False)).alias("held_out")).withColumn("key", F.xxhash64("text"))
    scorer, counts = fitted(base.where(~F.col("held_out")).select("id", "text"), vocabulary)
    shared = spark.sparkContext.broadcast(scorer)

    def score(batches):
        """A row for each document row (n_tokens over 0, an h of its own) and one for each rare word in it (its h and network log probability)."""
        own = shared.value
        for b in batches:
            texts = b.column("text").to_pylist()
            size = np.cumsum([len(t) for t in texts])
            cut = np.searchsorted(size, np.arange(1, 1 + (size[-1] >> 19 if len(size) else 0)) << 19) + 1
            for x, y in zip([0, *cut.tolist()], [*cut.tolist(), len(texts)], strict=True):
                if x >= y:
                    continue
                (n, known, logs, mixed), (row, hashes, lp) = own.texts(texts[x:y])
                alone = mix64(b.column("key").slice(x, y - x).to_numpy().view(np.uint64) + np.arange(x, y, dtype=np.uint64) ^ mix64(b.column("id").slice(x, y - x).fill_null(0).to_numpy().view(np.uint64)))
                at, none = pa.array(np.concatenate((np.arange(y - x), row)) + x), np.zeros(len(row))
                cols = [np.concatenate((alone, hashes)).view(np.int64), np.concatenate((n, none.astype(np.int64))), np.concatenate((known, none.astype(np.int64))), np.concatenate((logs, none)), np.concatenate((mixed, lp))]
                yield pa.RecordBatch.from_arrays([*(b.column(c).take(at) for c in ("id", "key", "held_out")), *map(pa.array, cols)], names=["id", "key", "held_out", "h", "n_tokens", "known", "logs", "score"])

    each = base.transform(arrow, _holding(score), "id:bigint,key:bigint,held_out:boolean,h:bigint,n_tokens:bigint,known:bigint,logs:double,score:double").join(counts, "h", "left")
    c, is_rare = F.coalesce(F.col("c"), F.lit(0)), F.col("n_tokens") == 0
    mixed = F.log10(F.exp("score") * scorer.share + (c + 1) * ((1 - scorer.share) / (scorer.total + scorer.kinds + 1)))
    each = each.withColumns({"known": F.when(is_rare, (c > 0).cast("bigint")).otherwise(F.col("known")), "logs": F.when(is_rare, F.log10(c + 1)).otherwise(F.col("logs")), "score": F.when(is_rare, mixed).otherwise(F.col("score"))})
    sums = each.groupBy("id", "key", "held_out").agg(F.sum((~is_rare).cast("bigint")).alias("m"), *(F.sum(x).alias(x) for x in ("n_tokens", "known", "logs", "score")))
    # equal rows were summed together; each gets its share
    rows = sums.select("*", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("m"))))
    ends = scorer.end_count
    n_tokens, known = F.expr("n_tokens div m"), F.expr("known div m") + (1 if ends else 0)
    logs = F.col("logs") / F.col("m") + math.log10(ends + 1)
    norm = math.log10(scorer.total + scorer.kinds + 1)
    return rows.select(F.col("id").alias(id_col), "held_out", n_tokens.alias("n_tokens"), known.cast("bigint").alias("n_known"), F.lit(scorer.total).cast("bigint").alias("train_tokens"), (logs - n_tokens * norm).alias("base_score"), (F.col("score") / F.col("m")).alias("score"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return scored(docs, remainder(F.col("doc_id"), 7) == 2)
