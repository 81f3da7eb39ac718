"""Document scores by masked pseudo-likelihood of a bidirectional window network (operator 2).

Every token is predicted from two tokens on each side: its class by a small network (an embedding per place, a tanh
layer, a softmax), then the word within its class by corpus counts. The nearest neighbours enter by their class, the
second ones by a group of classes. The most frequent words are classes of their own; the other words of the vocabulary
share classes learned from the company they keep (:func:`clustered`); words outside the vocabulary are one class. The
vocabulary, which every task holds, grows with the square root of the words counted and the classes with the sixth root
of the tokens; the counts of all other words stay a table, to which their occurrences are joined, so each has its own
probability.

What is learned comes from all documents: word counts, beside which words each word of the vocabulary stands, and how
often each class stands in each window. These counts are all that the network needs to be trained on every token of the
corpus, so training in numpy on the driver takes time by the classes only (the square root of the corpus), and its result
doesn't depend on how the rows are dealt out.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kontolith.llm.common import cut, drop_cut, map_batches, most_frequent
from kontolith.llm.words import WordHasher

#: Tokens up to which the classes are as many as asked for.
LEAST_TOKENS = 1 << 24
#: Logarithms of counts are summed as integers of this unit, so that sums don't depend on their order.
UNIT = float(1 << 32)
#: Rows whose words are held as arrays at once: an Arrow batch may have ten thousand, and each word needs some ten numbers.
PART_ROWS = 512
#: Counts that a task holds while it tallies; cells that get in each other's way are handed on early.
SLOTS = 1 << 22
#: Cells that are gathered at once, and contexts that the network sees at once.
GATHERED, SEEN = 1 << 24, 1 << 14


@dataclass
class Network:
    """An embedding per place of the window, a tanh layer and a softmax over ``n_classes``."""

    places: tuple[int, ...]  # how many things each place can hold
    n_classes: int
    p: dict

    def inner(self, context: np.ndarray) -> np.ndarray:
        return np.tanh(sum(self.p[i][x] for i, x in enumerate(np.unravel_index(context, self.places))) + self.p["b"])

    def outer(self, inner: np.ndarray) -> np.ndarray:
        z = inner @ self.p["w"] + self.p["c"]
        z -= z.max(1, keepdims=True)
        return z - np.log(np.exp(z).sum(1, keepdims=True))

    def logs(self, context: np.ndarray) -> np.ndarray:
        """Log probabilities ``[context, class]`` in whole multiples of 1 / :data:`UNIT`, so that they don't depend on what is asked together."""
        exact = Network(self.places, self.n_classes, {a: x.astype(float) for a, x in self.p.items()})
        return np.round(exact.outer(exact.inner(context)) * UNIT) / UNIT

    def log_of(self, context: np.ndarray, c: np.ndarray) -> np.ndarray:
        """The log probability of each ``c`` in its ``context``, worked out once for each different context."""
        out = np.empty(len(c))
        seen, at = np.unique(context, return_inverse=True)
        order = np.argsort(at, kind="stable")
        ends = np.searchsorted(at[order], np.arange(0, len(seen) + SEEN, SEEN))
        for i in range(len(ends) - 1):
            here = order[ends[i] : ends[i + 1]]
            out[here] = self.logs(seen[i * SEEN : (i + 1) * SEEN])[at[here] - i * SEEN, c[here]]
        return out


@dataclass
class WindowModel:
    words: np.ndarray  # sorted word hashes of the vocabulary
    classes: np.ndarray  # their classes
    within: np.ndarray  # log probability of each within its class
    outside: float  # log probability of a word counted once of the last class, which holds what is not in the vocabulary
    network: Network  # places: left, right, group of the second left, of the second right; the edge of a text is the last of each
    groups: np.ndarray  # the group of each class and of the edge
    n_classes: int
    perplexity: float
    rare: DataFrame  # (word, n) of the last class, counted more than once

    @property
    def log_p(self) -> np.ndarray:
        """All of the network's answers: [left, right, group of the second left, of the second right, class]."""
        return self.network.logs(np.arange(int(np.prod(self.network.places)))).reshape(*self.network.places, self.n_classes)


def word_counts(docs: DataFrame) -> DataFrame:
    """``(word, n)``: counts of all word hashes over all documents, counted within each batch first."""

    def make():
        hasher = WordHasher(lower=True)

        def step(batch: pa.RecordBatch):
            h = np.sort(hasher(batch.column(0))[0])
            if not len(h):
                return None
            at = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1])))
            return pa.RecordBatch.from_arrays([pa.array(h[at].view(np.int64)), pa.array(np.diff(np.append(at, len(h))).astype(np.int64))], ["word", "n"])

        return step

    return map_batches(docs.select(F.col("text").cast("string")), make, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _classes_of(h: np.ndarray, words: np.ndarray, classes: np.ndarray, n_classes: int) -> tuple[np.ndarray, np.ndarray]:
    """Class and vocabulary position (-1: none) of each hash."""
    if not len(words):
        return np.full(len(h), n_classes - 1), np.full(len(h), -1)
    at = np.minimum(np.searchsorted(words, h), len(words) - 1)
    known = words[at] == h
    return np.where(known, classes[at], n_classes - 1), np.where(known, at, -1)


def _neighbours(c: np.ndarray, counts: np.ndarray, edge: int, apart: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """What stands ``apart`` tokens to the left and to the right of each token; ``edge`` beyond the ends of a text."""
    left, right = np.full_like(c, edge), np.full_like(c, edge)
    if len(c) > apart:
        row = np.repeat(np.arange(len(counts)), counts)
        same = row[apart:] == row[:-apart]
        left[apart:] = np.where(same, c[:-apart], edge)
        right[:-apart] = np.where(same, c[apart:], edge)
    return left, right


def _contexts(c: np.ndarray, counts: np.ndarray, n_classes: int, groups: np.ndarray) -> np.ndarray:
    """The number of each token's window: ``((left * side + right) * n_groups + group of second left) * n_groups + of second right``."""
    side, n_groups = n_classes + 1, int(groups.max()) + 1
    left, right = _neighbours(c, counts, n_classes)
    second, other = _neighbours(c, counts, n_classes, 2)
    return ((left * side + right) * n_groups + groups[second]) * n_groups + groups[other]


def _parts(batch: pa.RecordBatch):
    """The batch in parts of :data:`PART_ROWS` rows."""
    for i in range(0, batch.num_rows, PART_ROWS):
        yield batch.slice(i, PART_ROWS)


class Tally:
    """Counts of at most :data:`SLOTS` cells: a cell's place is its number modulo that; what must make room is handed on."""

    def __init__(self, size: int):
        self.n = np.zeros(min(max(1, size), SLOTS), np.int64)
        self.page = np.zeros(len(self.n), np.int32)  # which of the cells of a place it is that is held

    def add(self, cells: np.ndarray, k: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Add the counts ``k`` of different ``cells``; the cells and counts that are handed on."""
        page, at = np.divmod(cells, len(self.n))
        first = np.zeros(len(at), bool)
        first[np.unique(at, return_index=True)[1]] = True
        late, page, at, own = (cells[~first], k[~first]), page[first], at[first], k[first]
        out = at[(self.page[at] != page) & (self.n[at] > 0)]
        gone = (self.page[out].astype(np.int64) * len(self.n) + out, self.n[out])
        self.n[out] = 0
        self.page[at] = page
        self.n[at] += own
        return np.concatenate((late[0], gone[0])), np.concatenate((late[1], gone[1]))

    def rest(self) -> tuple[np.ndarray, np.ndarray]:
        at = np.flatnonzero(self.n)
        return self.page[at].astype(np.int64) * len(self.n) + at, self.n[at]


def _tallies(docs: DataFrame, size: int, cells_of) -> DataFrame:
    """``(cell, n)`` over all documents, cells being below ``size``; a task's memory doesn't grow with it (:class:`Tally`)."""

    def run(batches):
        hasher, tally = WordHasher(lower=True), Tally(size)

        def handed(cells, n):
            for i in range(0, len(cells), 1 << 16):
                some = slice(i, i + (1 << 16))
                yield pa.RecordBatch.from_arrays([pa.array(cells[some]), pa.array(n[some])], ["cell", "n"])

        for part in (p for batch in batches for p in _parts(batch)):
            h, counts = hasher(part.column(0))
            if len(h):
                yield from handed(*tally.add(*np.unique(cells_of(h, counts), return_counts=True)))
        yield from handed(*tally.rest())

    return docs.select(F.col("text").cast("string")).mapInArrow(run, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n"))


def _gathered(tallies: DataFrame, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The cells below ``size`` that were counted, in order, and their counts, on the driver: :data:`GATHERED` cells at a time."""
    held, cells, n = cut(tallies, "tallies"), [], []
    for low in range(0, size, GATHERED):
        got = held.where((F.col("cell") >= low) & (F.col("cell") < low + GATHERED)).toArrow()
        some = (got.column("cell").to_numpy() - low).astype(np.int32)
        order = np.argsort(some)
        cells.append(some[order].astype(np.int64) + low)
        n.append(got.column("n").to_numpy()[order])
        del got, some, order
        pa.default_memory_pool().release_unused()
    drop_cut(held)
    return np.concatenate(cells), np.concatenate(n)


def window_counts(docs: DataFrame, words: np.ndarray, classes: np.ndarray, n_classes: int, groups: np.ndarray | None = None) -> DataFrame:
    """``(cell, n)`` over all documents; cell = number of the window (:func:`_contexts`) * n_classes + class. Without ``groups`` second neighbours count as equal."""
    groups = np.zeros(n_classes + 1, int) if groups is None else groups

    def cells_of(h, counts):
        c, _ = _classes_of(h, words, classes, n_classes)
        return _contexts(c, counts, n_classes, groups) * n_classes + c

    return _tallies(docs, ((n_classes + 1) * (int(groups.max()) + 1)) ** 2 * n_classes, cells_of)


def company(docs: DataFrame, words: np.ndarray, classes: np.ndarray, n_classes: int) -> np.ndarray:
    """``[word, neighbour]`` counts over all documents: of which class the left and the right neighbours of each word are.

    The last row is for all words outside the vocabulary; the edge of a text counts as a class.
    """
    side, n_words = n_classes + 1, len(words)

    def cells_of(h, counts):
        c, at = _classes_of(h, words, classes, n_classes)
        left, right = _neighbours(c, counts, n_classes)
        row = np.where(at >= 0, at, n_words) * 2 * side
        return np.concatenate((row + left, row + side + right))

    size = (n_words + 1) * 2 * side  # the vocabulary's, which grows with the root of the types
    out = np.zeros(size, np.int64)
    cells, n = _gathered(_tallies(docs, size, cells_of), size)
    out[cells] = n
    return out.reshape(n_words + 1, 2 * side)


def clustered(n: np.ndarray, k: int, rounds: int = 20) -> np.ndarray:
    """A cluster of 0 .. k-1 for each row of the counts ``n``: rows of like proportions together.

    Likeliest assignment to ``k`` multinomials in turns with their re-estimate; a row begins with the column that is most
    above its expected share. Nothing is drawn at random.
    """
    share = (n.sum(0) / max(1.0, n.sum())).astype(np.float32)
    n = n.astype(np.float32)
    wanted = n.sum(1, keepdims=True) * share
    above = n - wanted
    above /= np.sqrt(wanted + 1e-9)
    first = above.argmax(1)
    # the k columns that most of the counts begin with have a cluster of their own, rows of the others the best of these
    heads = np.argsort(-np.bincount(first, n.sum(1), n.shape[1]), kind="stable")[:k]
    at = above[:, heads].argmax(1)
    del wanted, above
    for _ in range(rounds):
        total = np.zeros((k, n.shape[1]))
        np.add.at(total, at, n)
        logs = np.log(total + 10 * share + 1e-9) - np.log(total.sum(1, keepdims=True) + 10)
        new = (n @ logs.T.astype(np.float32)).argmax(1)
        if (new == at).all():
            break
        at = new
    return at


def trained(cells: np.ndarray, n: np.ndarray, places: tuple[int, ...], k: int, width: int = 32, rounds: int = 150, rate: float = 0.05, seed: int = 5) -> tuple[Network, float]:
    """The network for ``k`` classes in windows of ``places``, and its perplexity on what it is trained on.

    ``cells`` (in order, context * k + class) were counted ``n`` times. Contexts that don't occur add nothing to the
    gradient; the others pass by :data:`SEEN` at a time, so beside the counts little is held.
    """
    at, row = np.unique(cells // k, return_inverse=True)
    row, c, n = row.astype(np.int32), (cells % k).astype(np.int16 if k < 1 << 15 else np.int32), n.astype(np.float32)
    starts = np.searchsorted(row, np.arange(0, len(at) + SEEN, SEEN))
    seen = np.bincount(row, n, len(at)).astype(np.float32)[:, None]
    total = float(n.sum(dtype=float))
    rng = np.random.default_rng(seed)
    p = {i: rng.normal(0, 0.1, (size, width)) for i, size in enumerate(places)}
    p |= {"b": np.zeros(width), "w": rng.normal(0, 0.1, (width, k)), "c": np.log((np.bincount(c, n, k) + 1) / (total + k))}
    p = {a: x.astype(np.float32) for a, x in p.items()}
    m, v = {a: np.zeros_like(x) for a, x in p.items()}, {a: np.zeros_like(x) for a, x in p.items()}
    net = Network(places, k, p)

    def passes():
        """The contexts, their counts' place, and the inner and outer layers, some contexts at a time."""
        for i in range(0, len(at), SEEN):
            here = slice(starts[i // SEEN], starts[i // SEEN + 1])
            context = at[i : i + SEEN]
            h = net.inner(context)
            yield context, i, (row[here] - i, c[here]), n[here], h, net.outer(h)

    for t in range(1, rounds + 1 if total else 1):
        grad = {a: np.zeros_like(x) for a, x in p.items()}
        for context, i, counted, times, h, logs in passes():
            d = np.exp(logs) * seen[i : i + SEEN]
            d[counted] -= times
            d /= np.float32(total)
            dh = (d @ p["w"].T) * (1 - h * h)
            grad["w"] += h.T @ d
            grad["c"] += d.sum(0)
            grad["b"] += dh.sum(0)
            for place, x in enumerate(np.unravel_index(context, places)):
                grad[place] += np.equal.outer(np.arange(places[place]), x).astype(np.float32) @ dh
        for a in p:
            m[a] = 0.9 * m[a] + 0.1 * grad[a]
            v[a] = 0.999 * v[a] + 0.001 * grad[a] ** 2
            p[a] = p[a] - rate * (m[a] / (1 - 0.9**t)) / (np.sqrt(v[a] / (1 - 0.999**t)) + 1e-9)
            p[a] = p[a].astype(np.float32)
    lost = -sum(float((times * logs[counted]).sum(dtype=float)) for _, _, counted, times, _, logs in passes())
    return net, float(np.exp(lost / total)) if total else 1.0


def train_network(counts: np.ndarray, **how) -> tuple[np.ndarray, float]:
    """Log probabilities of the class (last axis) for what stands in each place of the window (the other axes).

    The network is trained on ``counts`` of that shape (:func:`trained`); its perplexity on them comes second.
    """
    *places, k = counts.shape
    cells = np.flatnonzero(counts)
    net, perplexity = trained(cells, counts.reshape(-1)[cells], tuple(places), k, **how)
    return net.logs(np.arange(int(np.prod(places)))).reshape(counts.shape), perplexity


def grown(n_classes: int, own: int, tokens: int) -> tuple[int, int]:
    """Classes and words of their own for so many tokens: their windows grow with the square root of the tokens."""
    times = max(1.0, tokens / LEAST_TOKENS) ** (1 / 6)
    return int(n_classes * times), int(own * times)


def by_rank(n_words: int, own: int, n_classes: int, most: int) -> np.ndarray:
    """Classes of words in order of frequency: ``own`` alone, the others of ``most`` in bins of equal ratio; the last class is left out."""
    rank, shared = np.arange(n_words), n_classes - 1 - own
    ratio = np.log(max(2.0, most / own)) / shared
    return np.where(rank < own, rank, own + np.minimum((np.log(np.maximum(rank, own) / own) / ratio).astype(int), shared - 1))


def fit(docs: DataFrame, vocabulary: int = 50_000, n_classes: int = 64, own: int = 24, growth: int = 64, features: int = 32, n_groups: int = 3) -> WindowModel:
    """Count, form classes and train.

    The vocabulary is the most frequent words of all documents, at most ``vocabulary`` or ``growth`` times the root of
    all words if that is more. ``n_classes`` and ``own`` hold for small tables (see :func:`grown`). A word's company is
    told by ``features`` classes of frequency; second neighbours by ``n_groups`` groups and the edge.
    """
    counted = cut(word_counts(docs), "word-counts")
    tokens, types = counted.agg(F.sum("n"), F.count("*")).first()
    tokens = tokens or 0
    n_classes, own = grown(n_classes, own, tokens)
    vocabulary = max(vocabulary, growth * isqrt(types))
    often = most_frequent(counted, "word", "n", vocabulary)
    top = counted.where(often).toArrow()
    h, n = top.column("word").to_numpy(), top.column("n").to_numpy()
    order = np.lexsort((h, -n))
    h, n = np.ascontiguousarray(h[order]).view(np.uint64), n[order]
    rare = counted.where(~often & (F.col("n") > 1))
    by_hash = np.argsort(h)
    words = h[by_hash]
    outside = -float(np.log(max(1, tokens - int(n.sum()))))

    alone = max(1, min(own, features // 2))
    beside = company(docs, words, by_rank(len(h), alone, features, vocabulary)[by_hash], features)
    rank = np.empty(len(h), int)
    rank[by_hash] = np.arange(len(h))  # the place of the i-th most frequent word among the hashes
    classes = np.arange(len(h))
    classes[own:] = own + clustered(beside[rank[own:]], n_classes - 1 - own) if len(h) > own else 0
    of_class = np.zeros((n_classes, beside.shape[1]), np.int64)
    np.add.at(of_class, classes, beside[rank])
    of_class[n_classes - 1] += beside[len(h)]
    groups = np.append(clustered(of_class, n_groups), n_groups)
    del beside

    class_sum = np.bincount(classes, n, n_classes) if len(h) else np.zeros(n_classes)
    within = np.log(n / class_sum[classes]) if len(h) else np.empty(0)
    classes, within = classes[by_hash], within[by_hash]
    side = n_classes + 1
    places = (side, side, n_groups + 1, n_groups + 1)
    cells, times = _gathered(window_counts(docs, words, classes, n_classes, groups), int(np.prod(places)) * n_classes)
    network, perplexity = trained(cells, times, places, n_classes)
    return WindowModel(words, classes, within, outside, network, groups, n_classes, perplexity, rare)


def score(docs: DataFrame, model: WindowModel) -> DataFrame:
    """``(doc_id, n_tokens, n_outside, log_prob, mean_log_prob)`` per row; no tokens: 0 and a null mean.

    A word outside the vocabulary has its count over all tokens outside; one that was never counted is taken as counted once.
    """
    words, classes, within, outside, groups, n_classes = model.words, model.classes, model.within, model.outside, model.groups, model.n_classes
    network = model.network

    def make():
        hasher = WordHasher(lower=True)

        def one(batch: pa.RecordBatch):
            h, counts = hasher(batch.column(2))
            c, at = _classes_of(h, words, classes, n_classes)
            own = np.where(at >= 0, within[at] if len(within) else 0.0, outside)
            logs = network.log_of(_contexts(c, counts, n_classes, groups), c) + own
            row = np.repeat(np.arange(len(counts)), counts)
            total = np.bincount(row, logs, len(counts))
            missing = np.bincount(row, at < 0, len(counts)).astype(np.int64)
            ends = np.concatenate(([0], np.cumsum(missing))).astype(np.int32)
            rare = pa.ListArray.from_arrays(pa.array(ends), pa.array(h[at < 0].view(np.int64)))
            return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(counts), pa.array(missing), pa.array(total), rare], ["rid", "doc_id", "n_tokens", "n_outside", "log_prob", "rare"])

        return lambda batch: map(one, _parts(batch))

    rows = docs.select(F.monotonically_increasing_id().alias("rid"), F.col("doc_id").cast("long"), F.col("text").cast("string"))
    held = cut(map_batches(rows, make, "rid long, doc_id long, n_tokens long, n_outside long, log_prob double, rare array<long>"), "window-scores")
    counted = held.select("rid", F.explode("rare").alias("word")).join(model.rare, "word")
    more = counted.groupBy("rid").agg(F.sum(F.round(F.log(F.col("n").cast("double")) * UNIT).cast("long")).alias("more"))
    total = F.col("log_prob") + F.coalesce(F.col("more"), F.lit(0)) / F.lit(UNIT)
    out = held.drop("rare").join(more, "rid", "left").withColumn("log_prob", total)
    return out.select("doc_id", "n_tokens", "n_outside", "log_prob", F.when(F.col("n_tokens") > 0, F.col("log_prob") / F.col("n_tokens")).alias("mean_log_prob"))


def pseudo_likelihood(docs: DataFrame, **how) -> DataFrame:
    """Fit on all ``docs`` (``doc_id, text``; other columns are ignored) and score each. Null texts have no tokens; an empty table gives no rows."""
    return score(docs, fit(docs, **how))
