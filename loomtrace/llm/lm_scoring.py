"""Language-model scores of texts (operator 2).

A text is its words, lower-cased A-Z, and one end. Each word is spelled, with a blank before it, in
the subword ids of a public byte-level vocabulary. Its ids give back its bytes, and only a word's
first id starts with a blank, so ids and words determine each other and the probabilities of all
texts sum to one at most.

Every id is predicted by causal self-attention from the ids before it. Windows of ``context`` inputs
overlap: ``stride`` targets of each window are scored, the other places are context, so each id is
scored once. All windows of a step go through one batched product under a causal mask. The next id is
given as a class of ids, then as one of its members:

* classes: softmax over what the attention adds to the log-share of each class after the last id, in
  two steps: groups of 16 classes that follow alike ids, then the classes of the group. All classes
  have their share, so nothing is sampled, but a target costs 8 + 16 of them instead of 128. What is
  attended to, the last id and their products enter both steps;
* members: the share of an id in its class after ids of the last id's class.

What is learned from the training documents: counts of neighbouring ids over all of them, summed in
Spark, which give the id vectors at the start (leading directions of hashed neighbour counts), the
classes (k-means over the same) and both tables of shares; and the weights and id vectors of the
attention, in numpy with Adam. These are fitted to every window of every training document where
it lies, in random order within about 4 MB of ids; what the tasks end with is averaged in Spark by a
tree, in chunks. All tasks begin at the same point, which the driver finds by ``warm_steps`` steps on
about ``warm_ids`` ids. So counts and steps grow with the input, while tables depend on the vocabulary
and ``classes`` alone. The driver sends no model: it is a file in the shared folder. As windows are fitted where they lie, scores
depend on how rows are dealt to tasks; counts and the base score don't.

The base score needs the count of every word: those of the ``hot`` most frequent words are looked up
where the text is, the rest goes through a shuffled join with all counts and is summed per document.

Cases: a null text counts as empty (the end alone); without training documents all counts are 0.
Repeated rows are scored one by one. A null id has the remainder of no id: it is in training.
An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import base64
import io
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .storage import filesystem, materialise, new_folder, read_bytes, write_bytes
from .texts import as_bytes, caches, numbered, pieces, working
from .token_output import WordIds


@dataclass(frozen=True)
class ModelSettings:
    """``warm_ids`` bounds the first fit, which only finds where to begin; ``share`` is the part of all
    training windows that the second one takes: every one of them, unless a trial asks for less."""

    hot: int = 200_000
    classes: int = 128
    width: int = 16
    context: int = 32
    stride: int = 16
    warm_ids: int = 2_000_000
    warm_steps: int = 500
    share: float = 1.0
    batch: int = 192
    rate: float = 0.01
    bins: int = 64
    seed: int = 5


# ---- subword ids -----------------------------------------------------------------------------


class Speller(WordIds):
    """Words to ids by a file of ranks of the tiktoken library; ``end`` ends a text."""

    def __init__(self, path: str, pattern: str, most_words: int = 300_000, most_bytes: int = 8 << 20):
        import tiktoken

        with open(path, "rb") as source:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, source)}
        self.encoding = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.end = max(ranks.values()) + 1
        self.size = self.end + 1
        self.first = np.zeros(self.size, bool)
        self.first[[i for x, i in ranks.items() if x[:1] == b" "]] = True
        super().__init__(most_words, most_bytes)

    def folded(self, text: bytes) -> bytes:
        return text.lower()

    def forget(self) -> None:
        super().forget()
        self.counts, self.counts_of = np.zeros(0, np.int64), ""

    def _shrink(self) -> None:
        super()._shrink()
        self.counts = self.counts[:0]

    def hot_counts(self, names: np.ndarray, place: np.ndarray, path: str) -> np.ndarray:
        """Of words that are numbered already: their counts in the table of hot words, or 0. Each is
        looked up once while it stays."""
        if self.counts_of != path:
            self.counts, self.counts_of = self.counts[:0], path
        self.counts = np.concatenate([self.counts, np.full(len(self.number) - len(self.counts), -1, np.int64)])
        new = np.flatnonzero(self.counts[place] < 0)
        self.counts[place[new]] = np.fromiter(map(hot_words(path).get, names[new].tolist(), repeat(0)), np.int64, len(new))
        return self.counts[place]

    def words(self, words: list[bytes]) -> list[bytes]:
        """Words without white space of other kinds are cut alike alone and in a row, where only
        their first ids start with a blank; so many go into one call."""
        encode, out = self.encoding.encode_ordinary, []
        for i in range(0, len(words), 4000):
            part = [" " + w.decode() for w in words[i : i + 4000]]
            row = "".join(part)
            if len(row.split()) == len(part):
                ids = np.array(encode(row), "<u4")
                starts = 4 * np.flatnonzero(self.first[ids])
                if len(starts) == len(part):
                    raw, cuts = ids.tobytes(), [*starts.tolist(), 4 * len(ids)]
                    out += [raw[a:b] for a, b in zip(cuts, cuts[1:])]
                    continue
            out += [np.array(encode(w), "<u4").tobytes() for w in part]
        return out


_SPELLERS: dict[tuple[str, str], Speller] = {}


def speller(path: str, pattern: str) -> Speller:
    if (path, pattern) not in _SPELLERS:
        _SPELLERS[path, pattern] = Speller(path, pattern)
    return _SPELLERS[path, pattern]


# ---- attention -------------------------------------------------------------------------------


def windows(lengths: np.ndarray, s: ModelSettings) -> tuple[np.ndarray, np.ndarray]:
    """Of texts laid end to end: for each window the places of its ``context`` inputs (-1: before
    the text) and of its ``stride`` targets (-1: after it). Input k is the id before target k."""
    count = -(-lengths // s.stride)
    first = np.repeat(np.cumsum(lengths) - lengths, count)
    last = np.repeat(np.cumsum(lengths), count)
    nth = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    begin = first + nth * s.stride
    targets = begin[:, None] + np.arange(s.stride)
    targets = np.where(targets < last[:, None], targets, -1)
    inputs = begin[:, None] + np.arange(s.stride - s.context, s.stride) - 1
    return np.where((inputs >= first[:, None]) & (inputs < last[:, None] - 1), inputs, -1), targets


def exponentials(m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """exp along the last axis and its sums, up to a factor of each row: maxima are taken off only
    where the sums leave the range of the numbers without it."""
    ones = np.ones(m.shape[-1], m.dtype)
    with np.errstate(over="ignore", invalid="ignore"):
        e = np.exp(m)
        total = e @ ones
    if not (total.min() > 1e-25 and total.max() < 1e25):
        e = np.exp(m - m.max(axis=-1, keepdims=True))
        total = e @ ones
    return e, total


#: Classes of a group; a class is chosen among the groups, then in its own.
GROUP = 16


class Attention:
    """Single-head causal self-attention over id vectors, which predicts a class: first its group of
    ``GROUP`` classes that follow each other, by one softmax, then the class in its group, by another.
    Before a text stands its vocabulary's end."""

    def __init__(self, prior: np.ndarray, classes: np.ndarray, member: np.ndarray, vectors: np.ndarray, s: ModelSettings):
        """prior: natural log-share of each class after each id; classes: of each id; member: log10
        share of each id in its class, after each class; vectors: of each id."""
        random = np.random.default_rng(s.seed)
        d, groups = s.width, -(-s.classes // GROUP)
        self.s, self.prior, self.classes, self.member, self.end, self.groups = s, prior, classes, member, len(classes) - 1, groups
        self.group_of, self.within = (classes // GROUP).astype(np.uint16), classes % GROUP
        small = lambda *shape: (random.standard_normal(shape) / np.sqrt(shape[0])).astype(np.float32)
        none = lambda *shape: np.zeros(shape, np.float32)
        self.w = {"q": small(d, d), "k": small(d, d), "v": small(d, d), "o": none(d, s.classes), "e": none(d, s.classes), "i": none(d, s.classes), "b": none(s.classes), "go": none(d, groups), "ge": none(d, groups), "gi": none(d, groups), "gb": none(groups), "p": none(s.stride, s.context), "x": vectors.astype(np.float32)}
        key, query = np.arange(s.context), np.arange(s.context - s.stride, s.context)
        self.mask = np.where(key[None, :] <= query[:, None], 0, -1e9).astype(np.float32)
        self.step = 0
        self.mean = self.square = None
        self.moved = np.full(len(vectors), 1e-8, np.float32)
        self.table = None

    def shares(self) -> None:
        """The prior as a table by id and group: log-shares of the groups after the id, then of the
        group's classes, up to what cancels in their softmax. A short last group is filled up."""
        size, groups = len(self.prior), self.groups
        inner = np.full((size, groups * GROUP), -1e4, np.float32)
        inner[:, : self.s.classes] = self.prior
        inner = inner.reshape(size, groups, GROUP)
        self.table = np.empty((size, groups, groups + GROUP), np.float32)
        self.table[:, :, groups:] = inner
        self.table[:, :, :groups] = np.log(np.exp(inner).sum(axis=2))[:, None, :]
        self.table = self.table.reshape(-1, groups + GROUP)
        self.ends = np.zeros((groups + GROUP, 2), np.float32)
        self.ends[:groups, 0] = self.ends[groups:, 1] = 1

    def columns(self, outer: np.ndarray, inner: np.ndarray) -> list[np.ndarray]:
        """For each group, the columns of all groups and those of its classes."""
        out = np.zeros((self.groups, len(outer), self.groups + GROUP), np.float32)
        out[:, :, : self.groups] = outer
        for g in range(self.groups):
            own = inner[:, GROUP * g : GROUP * (g + 1)]
            out[g, :, self.groups : self.groups + own.shape[1]] = own
        return list(out)

    def by_group(self, after: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[tuple[int, int, int]]]:
        """Of targets: an order in which groups stand together; in it the groups and the places of the
        classes in their group; where each group that occurs begins and ends."""
        group = np.take(self.group_of, after)
        order = np.argsort(group, kind="stable")
        group = np.take(group, order).astype(np.int64)
        cuts = np.searchsorted(group, np.arange(self.groups + 1)).tolist()
        return order, group, np.take(self.within, np.take(after, order)), [(g, i, j) for g, (i, j) in enumerate(zip(cuts, cuts[1:])) if i < j]

    def gradients(self, before: np.ndarray, after: np.ndarray, real: np.ndarray) -> tuple[float, dict[str, np.ndarray], np.ndarray]:
        """before: input ids of each window. Mean loss of the targets' classes, its gradients, and that
        of each input's vector. Classes are chosen in order of their groups, a group's in one product."""
        s, w, d, groups = self.s, self.w, self.s.width, self.groups
        if self.table is None:
            self.shares()
        many, scale = len(before), np.float32(1 / np.sqrt(d))
        last = before[:, s.context - s.stride :].reshape(-1)
        x, own = np.take(w["x"], before.reshape(-1), axis=0), np.take(w["x"], last, axis=0)
        pairs, query = np.concatenate([w["k"], w["v"]], axis=1), w["q"] * scale
        both = (x @ pairs).reshape(many, s.context, 2 * d)
        q, k, v = (own @ query).reshape(many, s.stride, d), both[:, :, :d], both[:, :, d:]
        a = np.matmul(q, k.transpose(0, 2, 1))
        a += w["p"] + self.mask
        a, total = exponentials(a)
        a /= total[:, :, None]
        h = np.matmul(a, v)
        # A target's features: what it attends to, its last id, their products and 1, for the bias.
        given = np.ones((len(last), 3 * d + 1), np.float32)
        given[:, :d], given[:, d : 2 * d] = h.reshape(-1, d), own
        np.multiply(given[:, :d], own, out=given[:, 2 * d : 3 * d])
        order, group, within, parts = self.by_group(after.reshape(-1))
        given = np.take(given, order, axis=0)
        out = self.columns(np.concatenate([w["go"], w["ge"], w["gi"], w["gb"][None, :]]), np.concatenate([w["o"], w["e"], w["i"], w["b"][None, :]]))
        z = np.take(self.table, np.take(last, order) * groups + group, axis=0)
        for g, i, j in parts:
            z[i:j] += given[i:j] @ out[g]
        share = np.take(real.reshape(-1), order).astype(np.float32) / np.float32(max(1, real.sum()))
        with np.errstate(over="ignore", invalid="ignore"):
            e = np.exp(z)
            totals = e @ self.ends
        if not (totals.min() > 1e-15 and totals.max() < 1e15):
            for part in (z[:, :groups], z[:, groups:]):
                part -= part.max(axis=1, keepdims=True)
            e = np.exp(z)
            totals = e @ self.ends
        e *= (1 / totals) @ self.ends.T
        start = np.arange(0, e.size, e.shape[1])
        flat, one, two = e.reshape(-1), start + group, start + groups + within
        loss = -float(np.log(np.maximum(np.take(flat, one) * np.take(flat, two), 1e-37)) @ share)
        flat[one] -= 1
        flat[two] -= 1
        e *= share[:, None]
        of_inner, of_outer = np.zeros((3 * d + 1, groups * GROUP), np.float32), np.zeros((3 * d + 1, groups), np.float32)
        back = np.empty((len(order), 3 * d), np.float32)
        for g, i, j in parts:
            slope = given[i:j].T @ e[i:j]
            of_outer += slope[:, :groups]
            of_inner[:, GROUP * g : GROUP * (g + 1)] = slope[:, groups:]
            np.matmul(e[i:j], out[g][: 3 * d].T, out=back[i:j])
        of_inner = of_inner[:, : s.classes]
        found = {"o": of_inner[:d], "e": of_inner[d : 2 * d], "i": of_inner[2 * d : 3 * d], "b": of_inner[3 * d], "go": of_outer[:d], "ge": of_outer[d : 2 * d], "gi": of_outer[2 * d : 3 * d], "gb": of_outer[3 * d]}
        place = np.empty_like(order)
        place[order] = np.arange(len(order))
        back = np.take(back, place, axis=0)
        of_products = back[:, 2 * d :]
        dh = (back[:, :d] + of_products * own).reshape(h.shape)
        down = back[:, d : 2 * d] + of_products * h.reshape(-1, d)
        da = np.matmul(dh, v.transpose(0, 2, 1))
        da -= np.einsum("bsd,bsd->bs", dh, h)[:, :, None]  # what the weights' sum of 1 takes off
        ds = np.multiply(a, da, out=da)
        dq = np.matmul(ds, k).reshape(-1, d)
        dboth = np.empty_like(both)
        np.matmul(ds.transpose(0, 2, 1), q, out=dboth[:, :, :d])
        np.matmul(a.transpose(0, 2, 1), dh, out=dboth[:, :, d:])
        dboth = dboth.reshape(-1, 2 * d)
        of_keys, of_values = np.split(x.T @ dboth, 2, axis=1)
        found |= {"p": ds.sum(0), "q": own.T @ dq * scale, "k": of_keys, "v": of_values}
        dx = dboth @ pairs.T
        dx.reshape(many, s.context, d)[:, s.context - s.stride :] += (dq @ query.T + down).reshape(h.shape)
        return loss, found, dx

    def learn(self, before: np.ndarray, after: np.ndarray, real: np.ndarray) -> float:
        """One step of Adam on these windows; returns the mean loss of their classes."""
        s, w = self.s, self.w
        loss, found, dx = self.gradients(before, after, real)
        self.step += 1
        t = self.step
        rate = s.rate / (1 + t / 2000)
        # The weights' steps in one piece.
        g = np.concatenate([m.reshape(-1) for m in found.values()])
        if self.mean is None:
            self.mean, self.square = np.zeros_like(g), np.zeros_like(g)
        self.mean += np.float32(0.1) * (g - self.mean)
        self.square += np.float32(0.01) * (g * g - self.square)
        g, at = np.float32(rate / (1 - 0.9**t)) * self.mean / (np.sqrt(self.square * np.float32(1 / (1 - 0.99**t))) + np.float32(1e-8)), 0
        for n, m in found.items():
            w[n] -= g[at : at + m.size].reshape(m.shape)
            at += m.size
        # Vectors of the ids that occur, each by its own history.
        ids = before.reshape(-1).astype(_width(len(self.classes)))  # short ones sort faster
        order = np.argsort(ids, kind="stable")
        ids = np.take(ids, order)
        at = np.append(0, np.flatnonzero(ids[1:] != ids[:-1]) + 1)
        seen, g = ids[at], np.add.reduceat(np.take(dx, order, axis=0), at, axis=0)
        moved = self.moved[seen] + np.einsum("nd,nd->n", g, g) / np.float32(s.width)
        self.moved[seen] = moved
        g *= (np.float32(-rate) / np.sqrt(moved))[:, None]
        w["x"][seen] += g
        return loss

    def fit(self, ids: np.ndarray, lengths: np.ndarray, random: np.random.Generator, steps: int | None = None, share: float | None = None) -> list[float]:
        """So many steps on random windows of the texts, or on a share of their windows."""
        inputs, targets = windows(lengths, self.s)
        if not len(inputs):
            return []
        if steps is None:
            chosen = random.permutation(len(inputs))
            chosen = chosen if share >= 1 else chosen[random.random(len(inputs)) < share]
            picks = np.array_split(chosen, max(1, len(chosen) // self.s.batch)) if len(chosen) else []
        else:
            picks = (random.integers(0, len(inputs), self.s.batch) for _ in range(steps))
        ended = np.append(ids, self.end)  # place -1 holds the end
        return [self.learn(np.take(ended, inputs[p]), np.take(ended, targets[p]), targets[p] >= 0) for p in picks]

    def before(self, ids: np.ndarray, inputs: np.ndarray) -> np.ndarray:
        return np.where(inputs >= 0, ids[inputs], self.end)

    def ready(self) -> None:
        """Products of every id's vector, once, for scoring. What is the same for all keys, groups or
        classes of a place cancels out, so maxima need be taken off only where norms allow large
        exponents."""
        w, d, groups = self.w, self.s.width, self.groups
        norm = lambda m, axis: float(np.sqrt((m * m).sum(axis=axis)).max())
        self.queries = w["x"] @ w["q"] * np.float32(1 / np.sqrt(d))
        self.pairs = np.concatenate([w["x"] @ w["k"], w["x"] @ w["v"]], axis=1)
        self.bias = w["p"] + self.mask
        if self.table is None:
            self.shares()
        self.out = self.columns(np.concatenate([w["go"], w["gi"]]), np.concatenate([w["o"], w["i"]]))
        table = self.table.reshape(-1, groups, groups + GROUP)
        for g, (m, bias) in enumerate(zip(self.columns(w["ge"], w["e"]), self.columns(w["gb"][None, :], w["b"][None, :]))):
            table[:, g] += w["x"] @ m + bias
        for part in (self.table[:, :groups], self.table[:, groups:]):
            part -= part.max(axis=1, keepdims=True)
        self.large_mix = norm(self.queries, 1) * norm(self.pairs[:, :d], 1) + np.abs(w["p"]).max() > 80
        self.large_sum = norm(self.pairs[:, d:], 1) * max(norm(m, 0) for m in self.out) * max(1, np.abs(w["x"]).max()) > 80
        self.prior = None

    def scores(self, ids: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """log10 probability of every id, each once."""
        s, d, groups = self.s, self.s.width, self.groups
        inputs, targets = windows(lengths, s)
        out = np.zeros(len(ids), np.float64)
        ended, ones, member = np.append(ids, self.end), np.ones(s.context, np.float32), self.member.reshape(-1)
        for n in range(0, len(inputs), 256):
            before, at = np.take(ended, inputs[n : n + 256]), targets[n : n + 256].reshape(-1)
            last = before[:, s.context - s.stride :]
            both = np.take(self.pairs, before, axis=0)
            a = np.matmul(np.take(self.queries, last, axis=0), both[:, :, :d].transpose(0, 2, 1))
            a += self.bias
            if self.large_mix:
                a -= a.max(axis=2, keepdims=True)
            np.exp(a, out=a)
            h = np.matmul(a, both[:, :, d:])
            h /= (a @ ones)[:, :, None]
            want = np.take(ended, at)
            order, group, within, parts = self.by_group(want)
            h, last, want, at = np.take(h.reshape(-1, d), order, axis=0), np.take(last.reshape(-1), order), np.take(want, order), np.take(at, order)
            h = np.concatenate([h, h * np.take(self.w["x"], last, axis=0)], axis=1)
            z = np.take(self.table, last * groups + group, axis=0)
            for g, i, j in parts:
                z[i:j] += h[i:j] @ self.out[g]
            if self.large_sum:
                for part in (z[:, :groups], z[:, groups:]):
                    part -= part.max(axis=1, keepdims=True)
            start = np.arange(0, z.size, z.shape[1])
            chosen = np.take(z, start + group) + np.take(z, start + groups + within)
            total = np.log(np.exp(z, out=z) @ self.ends)
            found = (chosen - total[:, 0] - total[:, 1]) / np.log(10) + np.take(member, np.take(self.classes, last) * len(self.classes) + want)
            real = at >= 0
            out[at[real]] = found[real]
        return out


# ---- counts to tables ------------------------------------------------------------------------


def hashed_bin(ids: np.ndarray, bins: int) -> np.ndarray:
    return (ids.astype(np.int64) * 2654435761 >> 7) % bins


def alike(centres: np.ndarray) -> np.ndarray:
    """The centres' numbers in an order where ``GROUP`` that follow each other are alike: halves along
    the leading direction, again and again, each half a number of whole groups."""

    def halves(rows: np.ndarray) -> list[np.ndarray]:
        if len(rows) <= GROUP:
            return [rows]
        centred = centres[rows] - centres[rows].mean(axis=0)
        rows = rows[np.argsort(centred @ np.linalg.svd(centred, full_matrices=False)[2][0], kind="stable")]
        half = -(-len(rows) // (2 * GROUP)) * GROUP
        return halves(rows[:half]) + halves(rows[half:])

    return np.concatenate(halves(np.arange(len(centres))))


def classes_and_vectors(rows: pa.Table, size: int, s: ModelSettings) -> tuple[np.ndarray, np.ndarray]:
    """rows: side (0: what follows, 1: what precedes), id, bin, n. Classes by k-means, vectors by the
    leading directions of the neighbour counts. Ids without a count have class id mod ``classes``."""
    side, ids, bins, n = (rows.column(c).to_numpy() for c in ("side", "id", "bin", "n"))
    live = np.unique(ids)
    points = np.zeros((len(live), 2 * s.bins), np.float32)
    points[np.searchsorted(live, ids), side * s.bins + bins] = np.sqrt(n)
    freq = np.maximum(1, (points[:, s.bins :] ** 2).sum(axis=1))
    points /= np.linalg.norm(points, axis=1, keepdims=True) + 1e-9
    classes, vectors = np.arange(size) % s.classes, np.zeros((size, s.width), np.float32)
    if not len(live):
        return classes, vectors
    random, weight = np.random.default_rng(s.seed), np.sqrt(freq)
    centres = points[random.choice(len(points), min(s.classes, len(points)), replace=False, p=weight / weight.sum())]
    for _ in range(10):
        own = np.concatenate([((centres**2).sum(1) - 2 * points[i : i + 8192] @ centres.T).argmin(1) for i in range(0, len(points), 8192)])
        for c in range(len(centres)):
            if (own == c).any():
                centres[c] = np.average(points[own == c], axis=0, weights=weight[own == c])
    classes[live] = np.argsort(alike(centres[:, s.bins :]))[own]  # by what precedes
    centred = points - (points * weight[:, None]).sum(0) / weight.sum()
    scaled = centred * np.sqrt(weight)[:, None]
    found = centred @ np.linalg.eigh(scaled.T @ scaled)[1][:, ::-1][:, : s.width]
    vectors[live, : found.shape[1]] = found / (found.std(axis=0) + 1e-6)
    return classes, vectors


def tables(rows: pa.Table, classes: np.ndarray, unigram: np.ndarray, s: ModelSettings) -> tuple[np.ndarray, np.ndarray]:
    """rows: side (0: id then class, 1: class then id), id, class, n. The prior and member tables."""
    size, c = len(classes), s.classes
    side, ids, other, n = (rows.column(x).to_numpy() for x in ("side", "id", "bin", "n"))
    follows = np.zeros((size, c), np.float32)
    follows[ids[side == 0], other[side == 0]] = n[side == 0]
    share = follows.sum(axis=0) + 0.5
    share /= share.sum()
    follows += 8 * share
    follows /= follows.sum(axis=1, keepdims=True)
    prior = np.log(follows, out=follows).astype(np.float16)
    del follows
    member = np.zeros((c, size), np.float32)
    member[other[side == 1], ids[side == 1]] = n[side == 1]
    own = (unigram + 0.1) / np.bincount(classes, weights=unigram + 0.1, minlength=c)[classes]
    for k in range(c):
        total = np.bincount(classes, weights=member[k], minlength=c)[classes]
        member[k] = np.log10((member[k] + 20 * own) / (total + 20))
    return prior, member


# ---- the model as a file ---------------------------------------------------------------------

_MODELS: dict[str, tuple[Attention, ModelSettings]] = {}


def save_model(path: str, model: Attention) -> None:
    out = io.BytesIO()
    np.savez(out, prior=model.prior, classes=model.classes, member=model.member, **{"w_" + n: m for n, m in model.w.items()})
    write_bytes(path, out.getbuffer())


def load_model(path: str, s: ModelSettings) -> Attention:
    held = np.load(io.BytesIO(read_bytes(path)))
    model = Attention(held["prior"], held["classes"], held["member"], held["w_x"], s)
    model.w = {n: held["w_" + n].copy() for n in model.w}
    return model


def scorer(path: str, s: ModelSettings) -> Attention:
    """The model of this file, one per Python worker."""
    if path not in _MODELS:
        _MODELS.clear()
        model = load_model(path, s)
        model.ready()
        _MODELS[path] = (model, s)
    return _MODELS[path][0]


_HOT: dict[str, dict[bytes, int]] = {}


def hot_words(path: str) -> dict[bytes, int]:
    """The counts of the most frequent words, from their table in the shared folder."""
    if path not in _HOT:
        _HOT.clear()
        system, name = filesystem(path)
        held = pq.read_table(name, filesystem=system, columns=["word", "n"])
        _HOT[path] = dict(zip(held.column("word").to_pylist(), held.column("n").to_pylist()))
    return _HOT[path]


def _clear() -> None:
    for held in (_SPELLERS, _MODELS, _HOT):
        held.clear()


caches("lm", _clear)


# ---- Spark -----------------------------------------------------------------------------------


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 7 == 2, F.lit(False))


def word_counts(training: DataFrame) -> DataFrame:
    """word (binary), n. Words are counted where they are read, then summed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[bytes, int] = {}

        def flush() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array(found.keys(), pa.binary()), pa.array(found.values(), pa.int64())], names=["word", "n"])
            found.clear()
            return batch

        for batch in batches:
            for part in pieces(batch, "text"):
                names, index, _ = numbered([x.lower() for x in as_bytes(part.column("text"))])
                for w, n in zip(names.tolist(), np.bincount(index, minlength=len(names)).tolist()):
                    found[w] = found.get(w, 0) + n
                if len(found) > 300_000:
                    yield flush()
        if found:
            yield flush()

    return training.select("text").mapInArrow(working("lm", run), "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def most_frequent(table: DataFrame, most: int) -> DataFrame:
    """The rows of the highest ``n``, at most ``most``; of one count all or none."""
    levels = table.groupBy("n").count().toPandas().sort_values("n", ascending=False)
    kept = levels["n"][levels["count"].cumsum() <= most]
    return table.where(F.col("n") >= int(kept.min())) if len(kept) else table.where("false")


SPELLED = "n_tokens long, known long, base double, cold array<struct<word:binary,k:long>>, n_ids long, ids binary"


def spell_documents(source: DataFrame, hot: str, vocabulary: str, pattern: str) -> DataFrame:
    """row, doc_id, held_out, the subword ids of the text and its end (16 or 32 bits each), how many
    words are hot, the sum of their log10(count + 1), and the other words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = speller(vocabulary, pattern)
        for batch in batches:
            for part in pieces(batch, "text", 1 << 20):
                texts = as_bytes(part.column("text"))
                names, index, counts = numbered([own.folded(x) for x in texts])
                place = own.places(names)
                n = own.hot_counts(names, place, hot)[index]
                doc = np.repeat(np.arange(len(texts)), counts)
                known = np.bincount(doc[n > 0], minlength=len(texts))
                base = np.bincount(doc, weights=np.log10(n + 1), minlength=len(texts))
                cold = n == 0
                key, times = np.unique(doc[cold] * len(names) + index[cold], return_counts=True)
                offsets = np.searchsorted(key, np.arange(len(texts) + 1) * len(names)).astype(np.int32)
                words = pa.StructArray.from_arrays([pa.array(names[key % max(1, len(names))], pa.binary()), pa.array(times.astype(np.int64))], names=["word", "k"])
                ids, sizes = own.gather(place, index, counts)
                every = np.full(len(ids) + len(texts), own.end, _width(own.size))
                every[np.arange(len(ids)) + np.repeat(np.arange(len(texts)), sizes)] = ids
                raw, ends = every.tobytes(), np.append(0, np.cumsum(sizes + 1)) * every.itemsize
                spelled = pa.array([raw[a:b] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())], pa.binary())
                yield pa.RecordBatch.from_arrays([part.column("row"), part.column("doc_id"), part.column("held_out"), pa.array(counts + 1), pa.array(known.astype(np.int64)), pa.array(base), pa.ListArray.from_arrays(pa.array(offsets), words), pa.array(sizes + 1), spelled], names=["row", "doc_id", "held_out", "n_tokens", "known", "base", "cold", "n_ids", "ids"])

    kind = source.schema["doc_id"].dataType.simpleString()
    numbered_rows = source.select(F.monotonically_increasing_id().alias("row"), "doc_id", "held_out", "text")
    return numbered_rows.mapInArrow(working("lm", run), f"row long, doc_id {kind}, held_out boolean, {SPELLED}")


def _width(size: int) -> str:
    return "<u2" if size <= 1 << 16 else "<u4"


def _ids(part: pa.RecordBatch, width: str) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(b"".join(part.column("ids").to_pylist()), width).astype(np.int32), part.column("n_ids").to_numpy()


def neighbour_counts(spelled: DataFrame, size: int, end: int) -> DataFrame:
    """a, b, n: how often id b follows id a; the end stands before each text."""
    width = _width(size)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for batch in batches:
            for part in pieces(batch, "ids", 4 << 20):
                ids, lengths = _ids(part, width)
                before = np.append(end, ids[:-1]).astype(np.int64)
                before[np.cumsum(lengths) - lengths] = end
                new, n = np.unique(before * size + ids, return_counts=True)
                both, place = np.unique(np.concatenate([keys, new]), return_inverse=True)
                keys, counts = both, np.bincount(place, weights=np.concatenate([counts, n]), minlength=len(both)).astype(np.int64)
                if len(keys) > 2_000_000:
                    yield pa.RecordBatch.from_arrays([pa.array(keys // size), pa.array(keys % size), pa.array(counts)], names=["a", "b", "n"])
                    keys, counts = keys[:0], counts[:0]
        yield pa.RecordBatch.from_arrays([pa.array(keys // size), pa.array(keys % size), pa.array(counts)], names=["a", "b", "n"])

    return spelled.select("n_ids", "ids").mapInArrow(working("lm", run), "a long, b long, n long").groupBy("a", "b").agg(F.sum("n").alias("n"))


def _by_side(pairs: DataFrame, bin_of: Callable[[np.ndarray], np.ndarray]) -> pa.Table:
    """Both ids of each pair with the bin of the other: side, id, bin, n. At most two rows per id and bin."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, n = (batch.column(x).to_numpy() for x in ("a", "b", "n"))
            for side, own, other in ((0, a, b), (1, b, a)):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own), side, np.int64)), pa.array(own), pa.array(bin_of(other).astype(np.int64)), pa.array(n)], names=["side", "id", "bin", "n"])

    return pairs.mapInArrow(working("lm", run), "side long, id long, bin long, n long").groupBy("side", "id", "bin").agg(F.sum("n").alias("n")).toArrow()


def train(training: DataFrame, vocabulary: str, pattern: str, s: ModelSettings, folder: str) -> str:
    """training: row, n_ids, ids. The path of the model's file."""
    own = Speller(vocabulary, pattern)
    size, end, width = own.size, own.end, _width(own.size)
    del own
    pairs = materialise(neighbour_counts(training, size, end), "lm-pairs")
    classes, vectors = classes_and_vectors(_by_side(pairs, lambda x: hashed_bin(x, s.bins)), size, s)
    rows = _by_side(pairs, lambda x: classes[x])
    side, ids, n = (rows.column(c).to_numpy() for c in ("side", "id", "n"))
    unigram = np.bincount(ids[side == 1], weights=n[side == 1], minlength=size)
    prior, member = tables(rows, classes, unigram, s)
    model = Attention(prior, classes, member, vectors, s)
    # A first fit to the documents with the least hashes.
    total = unigram.sum()
    bound = min(1.0, s.warm_ids / max(1.0, total))
    least = F.pmod(F.xxhash64("row", F.lit(s.seed)), F.lit(1 << 30)) < int(bound * (1 << 30))
    sample = training.where(least).select("n_ids", "ids").toArrow().combine_chunks()
    random = np.random.default_rng(s.seed + 1)
    if sample.num_rows:
        found, lengths = _ids(sample.to_batches()[0], width)
        model.fit(found, lengths, random, steps=s.warm_steps)
    path = f"{folder}/first.npz"
    save_model(path, model)
    _average(training, path, width, s, model)
    path = f"{folder}/model.npz"
    save_model(path, model)
    return path


#: Weights of one row of the average, and rows that one task sums at a time.
CHUNK, FAN = 1 << 14, 64


def _summed(table: pa.Table) -> pa.Table:
    """Rows of one chunk and one branch: their weights as a mean by the documents seen."""
    total, seen = 0.0, 0
    for n, raw in sorted(zip(table.column("seen").to_pylist(), table.column("weights").to_pylist())):
        total, seen = total + n * np.frombuffer(raw, "<f4").astype(np.float64), seen + n
    return pa.table({"branch": table.column("branch").slice(0, 1), "chunk": table.column("chunk").slice(0, 1), "seen": pa.array([seen]), "weights": pa.array([(total / seen).astype("<f4").tobytes()], pa.binary())})


def mean_weights(fitted: DataFrame, branches: int, fan: int = FAN) -> DataFrame:
    """fitted: branch (a task's number, below ``branches``), chunk, seen, weights. One row per chunk,
    by a tree of groups of ``fan`` rows at most, however many tasks there are."""
    kind = "branch long, chunk long, seen long, weights binary"
    while True:
        fitted = fitted.withColumn("branch", F.floor(F.col("branch") / fan).cast("long")).groupBy("chunk", "branch").applyInArrow(_summed, kind)
        branches = -(-branches // fan)
        if branches <= 1:
            return fitted.select("chunk", "weights")


def _average(training: DataFrame, path: str, width: str, s: ModelSettings, model: Attention) -> None:
    """Fit the windows of all training documents where they are (``share`` is 1 by default), and average
    the weights of all tasks."""
    names = sorted(model.w)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        _clear()
        task = TaskContext.get().partitionId()
        own, random, seen = load_model(path, s), np.random.default_rng([s.seed, task]), 0
        own.shares()  # once, not for each target
        own.prior = own.member = None
        own.step = s.warm_steps
        for batch in batches:
            for part in pieces(batch, "ids", 4 << 20):
                seen += part.num_rows
                own.fit(*_ids(part, width), random, share=s.share)
        if seen:
            flat = np.concatenate([own.w[n].ravel() for n in names])
            cut = [flat[i : i + CHUNK] for i in range(0, len(flat), CHUNK)]
            same = lambda x: pa.array(np.full(len(cut), x, np.int64))
            yield pa.RecordBatch.from_arrays([same(task), pa.array(np.arange(len(cut))), same(seen), pa.array([x.tobytes() for x in cut], pa.binary())], names=["branch", "chunk", "seen", "weights"])

    source = training.select("n_ids", "ids")
    fitted = source.mapInArrow(working("lm", run), "branch long, chunk long, seen long, weights binary")
    parts = {r.chunk: r.weights for r in mean_weights(fitted, source.rdd.getNumPartitions()).toLocalIterator()}
    if not parts:
        return
    flat, at = np.frombuffer(b"".join(bytes(parts[i]) for i in range(len(parts))), "<f4"), 0
    for n in names:
        shape, size = model.w[n].shape, model.w[n].size
        model.w[n] = flat[at : at + size].reshape(shape).copy()
        at += size


def score_documents(docs: DataFrame, vocabulary: str, pattern: str, *, id_col: str = "doc_id", text_col: str = "text", settings: ModelSettings = ModelSettings()) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score. ``vocabulary``: a file of
    ranks; ``pattern``: how its texts are cut."""
    spark, s = docs.sparkSession, settings
    source = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"), held_out(docs[id_col]).alias("held_out"))
    counts = materialise(word_counts(source.where("not held_out")), "lm-words")
    hot = new_folder(spark, "lm-hot")
    most_frequent(counts, s.hot).coalesce(8).write.parquet(hot)
    spelled = materialise(spell_documents(source, hot, vocabulary, pattern), "lm-spelled")
    train_docs = spelled.where("not held_out").count()
    words, distinct = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    n, v = words + train_docs, distinct + (1 if train_docs else 0)
    folder = new_folder(spark, "lm-model")
    path = train(spelled.where("not held_out"), vocabulary, pattern, s, folder)
    size = Speller(vocabulary, pattern).size
    width = _width(size)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "ids", 1 << 20):
                ids, lengths = _ids(part, width)
                found = scorer(path, s).scores(ids, lengths)
                yield pa.RecordBatch.from_arrays([part.column("row"), pa.array(np.add.reduceat(found, np.cumsum(lengths) - lengths))], names=["scored", "score"])

    scored = spelled.select("row", "n_ids", "ids").mapInArrow(working("lm", run), "scored long, score double")
    rare = spelled.select("row", F.explode("cold").alias("c")).select("row", "c.word", "c.k")
    k = F.col("k")
    per = rare.join(counts, "word", "left").groupBy("row").agg(F.sum(k * F.log10(F.coalesce("n", F.lit(0)) + 1)).alias("rare_base"), F.sum(F.when(F.col("n").isNotNull(), k)).alias("rare_known"))
    joined = spelled.drop("cold", "ids", "n_ids").join(materialise(scored, "lm-scored"), F.col("row") == F.col("scored")).join(per, "row", "left")
    end_known, end_base = (1 if train_docs else 0), float(np.log10(train_docs + 1))
    base = F.col("base") + F.coalesce("rare_base", F.lit(0.0)) + end_base - F.col("n_tokens") * float(np.log10(n + v + 1))
    return joined.select(F.col("doc_id").alias(id_col), "held_out", "n_tokens", (F.col("known") + F.coalesce("rare_known", F.lit(0)) + end_known).alias("n_known"), F.lit(n).cast("long").alias("train_tokens"), base.alias("base_score"), "score")
