"""Toxicity scores by non-negative positive-unlabelled learning (operator 4).

Confirmed toxic texts are the positives; unlabelled texts, some of them toxic, are the rest. The classifier is linear over
the presence of words and word beginnings anywhere in the whole text, trained in numpy on the risk estimate
``prior * R_p(+) + max(0, R_u(-) - prior * R_p(-))`` with logistic loss: the negative class's risk is the unlabelled
texts' minus the positives' share, and may not fall below zero.

Bounded, documented parameters: at most about ``max_positive`` and ``max_unlabelled`` texts train the model, chosen by
a hash of the id; scoring covers every text.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from kontolith.llm.common import BoundedCache, cut, each_text, drop_cut, fold_id, map_batches, struct_field

#: Characters stripped from a word's ends, lengths of the word beginnings.
EDGES = ".,;:!?\"'()[]{}<>*#$%&|_-+=~/\\"
STARTS = (4, 5, 6)
#: Characters of a text that are looked at at once; so no text, however long, is held as words as a whole.
BLOCK = 1 << 18
SPACE = re.compile(r"\s")


def word_features(word: str) -> tuple[int, ...]:
    """Hashes of a word and its beginnings; nothing for what has no letters."""
    w = word.strip(EDGES)
    if len(w) < 3:
        return ()
    return tuple({zlib.crc32(f"{n}:{w[:n]}".encode()) for n in STARTS if len(w) >= n} | {zlib.crc32(f"w:{w}".encode())})


def block_features(text: str | None, cache: dict) -> Iterator[set[int]]:
    """The features of each block of a text; blocks end at white space."""
    at, n = 0, len(text or "")
    while at < n:
        gap = SPACE.search(text, at + BLOCK) if n - at > BLOCK else None
        to = gap.start() if gap else n
        found: set[int] = set()
        for f in map(cache.__getitem__, set(text[at:to].lower().split())):
            found.update(f)
        yield found
        at = to


def text_features(text: str | None, cache: dict) -> set[int]:
    found: set[int] = set()
    for f in block_features(text, cache):
        found |= f
    return found


def feature_array(text: str | None, cache: dict) -> np.ndarray:
    """The features in order, in 8 bytes each: of long texts with many words too many for a set of Python's numbers."""
    parts = [np.fromiter(f, np.int64, len(f)) for f in block_features(text, cache)]
    return np.unique(np.concatenate(parts)) if parts else np.empty(0, np.int64)


def numbers_of(features: pa.ListArray, wanted: np.ndarray) -> pa.ListArray:
    """Each row's places in ``wanted`` (in order) of those of its features that it holds; null rows have none."""
    flat = features.flatten().to_numpy(zero_copy_only=False).astype(np.int64, copy=False)
    row = np.repeat(np.arange(len(features), dtype=np.int32), pc.list_value_length(features).fill_null(0).to_numpy(zero_copy_only=False))
    at = np.searchsorted(wanted, flat)
    held = np.zeros(len(flat), bool)
    inside = at < len(wanted)
    held[inside] = wanted[at[inside]] == flat[inside]
    ends = np.cumsum(np.bincount(row[held], minlength=len(features)))
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], ends)), pa.int32()), pa.array(at[held], pa.int64()))


@dataclass
class ToxicityModel:
    weights: dict[int, float]
    bias: float
    prior: float
    n_positive: int
    n_unlabelled: int


def nn_pu_fit(x_p: list[np.ndarray], x_u: list[np.ndarray], dim: int, prior: float, rounds: int = 400, rate: float = 0.05, decay: float = 1e-4) -> tuple[np.ndarray, float]:
    """Weights and bias of a linear scorer by full-batch Adam on the non-negative risk; ``x`` holds each text's feature numbers."""

    def csr(x):
        return np.repeat(np.arange(len(x)), [len(f) for f in x]), np.concatenate(x) if x else np.empty(0, np.int64), len(x)

    (rp, cp, n_p), (ru, cu, n_u) = csr(x_p), csr(x_u)
    w, m, v = np.zeros(dim + 1), np.zeros(dim + 1), np.zeros(dim + 1)
    w[dim] = np.log(prior / (1 - prior))
    sums = lambda at, values, n: np.bincount(at, values, n).astype(float)  # noqa: E731 - of no rows at all, bincount gives integers
    sigmoid = lambda z: 0.5 * (1 + np.tanh(z / 2))
    for t in range(1, rounds + 1):
        g_p = sums(rp, w[cp], n_p) + w[dim]
        g_u = sums(ru, w[cu], n_u) + w[dim]
        negative = np.logaddexp(0, g_u).mean() - prior * np.logaddexp(0, g_p).mean()
        s_p, s_u = sigmoid(g_p), sigmoid(g_u)
        d_p, d_u = prior * (s_p - 1) / n_p, np.zeros(n_u)
        if negative >= 0:
            d_u, d_p = s_u / n_u, d_p - prior * s_p / n_p
        else:  # step back until the negative risk is no longer below zero
            d_u, d_p = -s_u / n_u, prior * s_p / n_p
        grad = sums(cp, d_p[rp], dim + 1) + sums(cu, d_u[ru], dim + 1)
        grad[dim] += d_p.sum() + d_u.sum()
        grad[:dim] += decay * w[:dim]
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        w -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w[:dim], float(w[dim])


def fit(docs: DataFrame, labels: DataFrame, max_positive: int = 6000, max_unlabelled: int = 12000, least_z: float = 5.0) -> ToxicityModel:
    """Learn from ``labels`` (``doc_id, toxic``) and unlabelled ``docs``, both only where crc32(doc_id) modulo 3 is not 1.

    The class prior is the share of toxic rows among the labelled ones used. Features kept: those that positives have
    significantly more often than unlabelled texts (``least_z``); each is in four positives at least, so the sample bounds
    their number. Without positives every score is 0.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where((fold_id() != 1) & F.col("toxic").isin(0, 1))
    n_known, n_toxic = known.agg(F.count("*"), F.sum("toxic")).first()
    if not n_toxic:
        return ToxicityModel({}, -20.0, 0.0, 0, 0)
    prior = min(max(n_toxic / n_known, 0.001), 0.5)
    part = lambda share, salt: F.pmod(F.xxhash64(F.col("doc_id"), F.lit(salt)), F.lit(1_000_000)) < int(1_000_000 * min(1.0, share)) + 1
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where(F.col("doc_id").isNotNull() & (fold_id() != 1))
    # at most about max_positive ids by the filter: small enough to send to every task
    positives = known.where("toxic = 1").where(part(max_positive / n_toxic, 1)).select("doc_id", F.lit(1).alias("p")).dropDuplicates(["doc_id"])
    n_texts = texts.select("doc_id").count()
    chosen = texts.join(F.broadcast(positives), "doc_id", "left").select("text", F.coalesce("p", F.lit(0)).alias("p"), part(max_unlabelled / max(1, n_texts), 2).cast("int").alias("u")).where("p = 1 or u = 1")

    def make():
        cache = BoundedCache(word_features, 60_000)

        def step(whole: pa.RecordBatch):
            for at in range(0, whole.num_rows, 200):
                yield one(whole.slice(at, 200))

        def one(batch: pa.RecordBatch):
            found = [feature_array(t, cache) for t in each_text(batch.column(0))]
            return pa.RecordBatch.from_arrays([batch.column(1), batch.column(2), pa.array(found, pa.list_(pa.int64()))], ["p", "u", "features"])

        return step

    sample = cut(map_batches(chosen, make, "p int, u int, features array<long>"), "toxic-sample", 500)
    n_p, n_u = sample.agg(F.sum("p"), F.sum("u")).first()
    if not n_p or not n_u:
        return ToxicityModel({}, -20.0, prior, n_p or 0, n_u or 0)
    share_p, share_u = F.col("p") / n_p, F.col("u") / n_u
    both = (F.col("p") + F.col("u")) / (n_p + n_u)
    z = (share_p - share_u) / F.sqrt(both * (1 - both) * (1 / n_p + 1 / n_u) + 1e-12)
    counted = sample.select("p", "u", F.explode("features").alias("f")).groupBy("f").agg(F.sum("p").alias("p"), F.sum("u").alias("u"))
    strong = counted.where((z >= least_z) & (F.col("p") >= 4) & (share_p >= 2.0 * share_u)).select("f")
    picked = sorted(r.f for r in strong.collect())
    at = {f: i for i, f in enumerate(picked)}
    wanted = np.array(picked, np.int64)

    def narrow():
        def step(whole: pa.RecordBatch):
            for at in range(0, whole.num_rows, 200):
                batch = whole.slice(at, 200)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), numbers_of(batch.column(2), wanted)], ["p", "u", "features"])

        return step

    rows = map_batches(sample, narrow, "p int, u int, features array<long>").collect()
    drop_cut(sample)
    x_p = [np.array(r.features, np.int64) for r in rows if r.p]
    x_u = [np.array(r.features, np.int64) for r in rows if r.u]
    w, bias = nn_pu_fit(x_p, x_u, len(picked), prior)
    return ToxicityModel({f: float(w[i]) for f, i in at.items() if w[i]}, bias, prior, len(x_p), len(x_u))


def text_scores(docs: DataFrame, model: ToxicityModel, keep: list[str]) -> DataFrame:
    """The ``keep`` columns and ``score`` per row of ``docs``, from the whole ``_text``, or from the field ``text`` of ``_row``."""
    weights, bias = model.weights, model.bias

    def make():
        cache = BoundedCache(lambda w: tuple(f for f in word_features(w) if f in weights), 250_000)

        def step(whole: pa.RecordBatch):
            for at in range(0, whole.num_rows, 500):
                yield one(whole.slice(at, 500))

        def one(batch: pa.RecordBatch):
            texts = struct_field(batch.column(0), "text") if keep == ["_row"] else batch.column(len(keep))
            risks = np.array([bias + sum(weights[f] for f in sorted(text_features(t, cache))) for t in each_text(texts)], float)
            return pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(0.5 * (1 + np.tanh(risks / 2)))], [*keep, "score"])

        return step

    schema = StructType([*docs.select(*keep).schema, StructField("score", DoubleType())])
    return map_batches(docs.select("_row") if keep == ["_row"] else docs.select(*keep, "_text"), make, schema)


def score(docs: DataFrame, model: ToxicityModel, threshold: float = 0.7) -> DataFrame:
    """``(doc_id, held_out, score, predicted)`` per row; null and empty texts get the score of a text without any feature.

    ``held_out`` of a null id is false.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("_text"))
    out = text_scores(rows.withColumn("held_out", F.coalesce(fold_id() == 1, F.lit(False))), model, ["doc_id", "held_out"])
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def toxicity_scores(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, **bounds) -> DataFrame:
    """Fit and score. ``docs``: ``doc_id, text``; ``labels``: ``doc_id, toxic``; other columns never enter. Empty tables give no rows."""
    return score(docs, fit(docs, labels, **bounds), threshold)


def keep_clean(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, fit_on: DataFrame | None = None, **bounds) -> DataFrame:
    """``docs`` (all columns) without the texts predicted toxic.

    The model learns from ``fit_on`` (default ``docs``): a stage that follows others passes the unfiltered table, of which
    the labels speak, so that a filter before it takes no confirmed example away. Null and empty texts, repeated rows and
    rows with a null id are judged by their text like any other; an empty table gives no rows; columns of any name stay.
    """
    flat = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row"))
    scored = text_scores(flat, fit(docs if fit_on is None else fit_on, labels, **bounds), ["_row"])
    return scored.where(F.col("score") < threshold).select(*(F.col(f"_row.`{c}`").alias(c) for c in docs.columns))
