"""SentencePiece encoding and decoding over a relational lattice (operator 1).

A text, with its spaces as meta symbols and one in front, falls into units that no piece crosses: a run of meta symbols
with what follows it, and line breaks. For the most frequent units the lattice is a table: substrings up to the longest
piece's length are exploded, equi-joined to the piece table, the edges of a unit grouped and folded by a higher-order
``aggregate``. Unigram models fold by Viterbi. A model of type BPE has merge ranks in place of probabilities, for which
Viterbi gives other pieces than the library; there the fold runs the merges over the same edges. The folded units, at
most ``vocabulary`` of them, go to all tasks; a unit outside runs the same lattice and fold within its task and is kept
in a bounded cache. So every text is encoded whole, without a shuffle of texts or of word occurrences.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections import Counter
from dataclasses import dataclass
from functools import lru_cache
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kontolith.llm.common import BoundedCache, cut, map_batches, most_frequent

#: Rarer units that a Python worker keeps; about 250 bytes each.
KEPT_UNITS = 700_000
META = "▁"
_LETTERS = "A-Za-zÀ-ÖØ-öø-ÿ"
BPE, UNIGRAM = 2, 1


@dataclass(frozen=True)
class Pieces:
    ids: dict[str, int]  # ordinary pieces
    scores: dict[str, float]
    byte_ids: tuple[int, ...]  # by byte; empty without byte fallback
    unknown: int
    texts: tuple[str, ...]  # by id
    longest: int
    kind: int
    unit: re.Pattern  # what a text falls into; no piece crosses from one unit to the next


def unit_pattern(pieces: list[str]) -> re.Pattern:
    """Meta symbols with what follows, and line breaks; letters end a unit before punctuation that no piece joins to a letter."""
    joined = {b for x in pieces for a, b in zip(x, x[1:], strict=False) if re.match(f"[{_LETTERS}]", a)}
    alone = re.escape("".join(c for c in ",.;:!?*#$%&" if c not in joined))
    words = f"{META}*[{_LETTERS}]+(?=[{META}\n{alone}]|\\Z)|"
    return re.compile(words + f"{META}*[^{META}\n]+|{META}+|\n+")


@lru_cache(maxsize=4)
def load_pieces(model_path: str, kind: int = BPE) -> Pieces:
    """A model file's piece table; models with a dummy prefix, escaped spaces and no other normalisation are read."""
    from sentencepiece import SentencePieceProcessor

    sp = SentencePieceProcessor(model_file=model_path)
    n = sp.get_piece_size()
    texts = tuple(sp.id_to_piece(i) for i in range(n))
    plain = [i for i in range(n) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
    byte_ids = tuple(i for i in range(n) if sp.is_byte(i))
    ids = {texts[i]: i for i in plain}
    return Pieces(ids, {texts[i]: sp.get_score(i) for i in plain}, byte_ids, sp.unk_id(), texts, max(map(len, ids)), kind, unit_pattern(list(ids)))


def escape(text: str | None) -> str:
    return META + text.replace(" ", META) if text else ""


def units_of(text: str | None, p: Pieces) -> list[str]:
    return p.unit.findall(escape(text))


def _symbol_ids(symbol: str, p: Pieces) -> list[int]:
    at = p.ids.get(symbol)
    if at is not None:
        return [at]
    return [p.byte_ids[b] for b in symbol.encode("utf-8", "replace")] if p.byte_ids else [p.unknown]


def merge_fold(unit: str, p: Pieces) -> list[str]:
    """Join neighbouring symbols while some pair's text is a piece: the highest score first, then the leftmost."""
    return _merge_short(unit, p) if len(unit) <= 48 else _merge_long(unit, p)


def _merge_short(unit: str, p: Pieces) -> list[str]:
    """By a list of the pairs' scores; the least work for usual words."""
    none, score = float("-inf"), p.scores.get
    symbols = list(unit)
    pairs = [score(a + b, none) for a, b in zip(symbols, symbols[1:], strict=False)]
    while pairs:
        best = max(pairs)
        if best == none:
            break
        i = pairs.index(best)
        symbols[i : i + 2] = [joined := symbols[i] + symbols[i + 1]]
        del pairs[i]
        if i:
            pairs[i - 1] = score(symbols[i - 1] + joined, none)
        if i < len(pairs):
            pairs[i] = score(joined + symbols[i + 1], none)
    return symbols


def _merge_long(unit: str, p: Pieces) -> list[str]:
    """By a heap, in the length's order times its logarithm."""
    n = len(unit)
    after, before, size = list(range(1, n + 1)), list(range(-1, n - 1)), [1] * n
    scores, longest = p.scores, p.longest

    def pair(i: int):
        j = after[i]
        if j < n and size[i] + size[j] <= longest and (s := scores.get(unit[i : j + size[j]])) is not None:
            return (-s, i, size[i], size[j])
        return None

    heap = [x for x in map(pair, range(n)) if x]
    heapify(heap)
    while heap:
        _, i, a, b = heappop(heap)
        j = after[i] if size[i] == a else n
        if size[i] != a or j >= n or size[j] != b:
            continue
        size[i] += b
        size[j] = 0
        after[i] = after[j]
        if after[j] < n:
            before[after[j]] = i
        for k in (before[i], i):
            if k >= 0 and (x := pair(k)):
                heappush(heap, x)
    return [unit[i : i + size[i]] for i in range(n) if size[i]]


def viterbi_fold(unit: str, p: Pieces) -> list[str]:
    """The segmentation of the largest score sum; a character without a piece costs ten more than the worst piece."""
    low = min(p.scores.values(), default=0.0) - 10.0
    best, back = [0.0] + [-np.inf] * len(unit), [0] * (len(unit) + 1)
    for end in range(1, len(unit) + 1):
        for start in range(max(0, end - p.longest), end):
            s = p.scores.get(unit[start:end], low if end - start == 1 else None)
            if s is not None and best[start] + s > best[end]:
                best[end], back[end] = best[start] + s, start
    out, end = [], len(unit)
    while end:
        out.append(unit[back[end] : end])
        end = back[end]
    return out[::-1]


def encode_unit(unit: str, p: Pieces) -> bytes:
    """A unit's ids as little-endian uint32 bytes, by the lattice within the task."""
    if unit[0] == "\n":
        symbols = list(unit)
    else:
        symbols = merge_fold(unit, p) if p.kind == BPE else viterbi_fold(unit, p)
    try:
        ids = [p.ids[s] for s in symbols]
    except KeyError:
        ids = [i for s in symbols for i in _symbol_ids(s, p)]
    return struct.pack(f"<{len(ids)}I", *ids)


def decode(ids: list[int], p: Pieces) -> str:
    """Text of an id sequence: byte pieces as UTF-8 (wrong bytes become replacement characters), meta symbols as spaces, the first dropped."""
    of_byte = {i: b for b, i in enumerate(p.byte_ids)}
    out, held = [], bytearray()
    for i in ids:
        if i in of_byte:
            held.append(of_byte[i])
            continue
        if held:
            out.append(held.decode("utf-8", "replace"))
            held = bytearray()
        out.append(p.texts[i])
    if held:
        out.append(held.decode("utf-8", "replace"))
    text = "".join(out).replace(META, " ")
    return text[1:] if text.startswith(" ") else text


def frequent_units(docs: DataFrame, vocabulary: int, model_path: str, kind: int) -> DataFrame:
    """At most ``vocabulary`` units, the most frequent by what 500 rows have at least three times; only speed depends on the choice."""

    def make():
        def step(whole: pa.RecordBatch):
            for at in range(0, whole.num_rows, 500):  # few units are held at once
                yield one(whole.slice(at, 500))

        def one(batch: pa.RecordBatch):
            seen, p = Counter(), load_pieces(model_path, kind)
            for t in batch.column(0).to_pylist():
                seen.update(units_of(t, p))
            got = [(u, n) for u, n in seen.items() if n >= 3 and len(u) <= 64]
            return pa.RecordBatch.from_arrays([pa.array([u for u, _ in got], pa.string()), pa.array([n for _, n in got], pa.int64())], ["unit", "n"])

        return step

    counted = map_batches(docs.select(F.col("text").cast("string")), make, "unit string, n long").groupBy("unit").agg(F.sum("n").alias("n"))
    counted = cut(counted, "units")
    return counted.where(most_frequent(counted, "unit", "n", vocabulary)).select("unit")


def lattice_edges(units: DataFrame, pieces: DataFrame, longest: int) -> DataFrame:
    """``unit, n, edges``: per unit its length and the array of ``(start, end, id, score)`` of substrings that are pieces."""
    n = F.length("unit")
    starts = units.select("unit", n.alias("n"), F.explode(F.sequence(F.lit(0), n - 1)).alias("start"))
    spans = starts.select("unit", "n", "start", F.explode(F.sequence(F.col("start") + 1, F.least(F.col("n"), F.col("start") + longest))).alias("end"))
    pieces_of = spans.withColumn("piece", F.col("unit").substr(F.col("start") + 1, F.col("end") - F.col("start")))
    # the piece table is a model's, of fixed size
    return pieces_of.join(F.broadcast(pieces), "piece").groupBy("unit", "n").agg(F.array_sort(F.collect_list(F.struct("start", "end", "id", "score"))).alias("edges"))


_KEY = 1 << 16


def fold_merges(edges: DataFrame) -> DataFrame:
    """``(unit, ids)`` by running the merges over the edges; an id is null where a character is not among the pieces.

    The folded state holds the symbol bounds and the edges by span; a step drops the inner bound whose removal joins
    the best pair. The state carries the maps along, so that they are built once a unit.
    """
    spans = lambda value: F.map_from_entries(F.transform("edges", lambda e: F.struct((e["start"] * _KEY + e["end"]).alias("k"), value(e).alias("v"))))
    state = lambda bounds, s, ids: F.struct(bounds.alias("bounds"), s.alias("scores"), ids.alias("ids"))

    def step(acc, _):
        bounds = acc["bounds"]
        inner = F.filter(F.transform(bounds, lambda b, i: i), lambda i: (i > 0) & (i < F.size(bounds) - 1))
        key = lambda i: F.get(bounds, i - 1) * _KEY + F.get(bounds, i + 1)
        pairs = F.transform(inner, lambda i: F.struct((-F.try_element_at(acc["scores"], key(i))).alias("s"), i.alias("i")))
        best = F.array_min(F.filter(pairs, lambda x: x["s"].isNotNull()))
        left = F.transform(F.array(best["i"]), lambda drop: F.filter(bounds, lambda x, i: drop.isNull() | (i != drop)))
        return state(F.get(left, F.lit(0)), acc["scores"], acc["ids"])

    def finish(acc):
        starts = F.slice(acc["bounds"], 1, F.size(acc["bounds"]) - 1)
        return F.transform(starts, lambda b, k: F.try_element_at(acc["ids"], b * _KEY + F.get(acc["bounds"], k + 1)))

    init = state(F.sequence(F.lit(0), F.col("n")), spans(lambda e: e["score"]), spans(lambda e: e["id"]))
    return edges.select("unit", F.aggregate(F.sequence(F.lit(2), F.greatest(F.lit(2), F.col("n"))), init, step, finish).alias("ids"))


def fold_viterbi(edges: DataFrame) -> DataFrame:
    """``(unit, ids)`` of the largest score sum by folding the edges in order of their start; null where no path leads through."""
    state = "array<struct<s:double,ids:array<int>>>"
    init = F.transform(F.sequence(F.lit(0), F.col("n")), lambda i: F.struct(F.when(i == 0, F.lit(0.0)).alias("s"), F.array().cast("array<int>").alias("ids"))).cast(state)

    def step(acc, e):
        base = F.get(acc, e["start"])
        better = F.struct((base["s"] + e["score"]).alias("s"), F.concat(base["ids"], F.array(e["id"].cast("int"))).alias("ids"))
        return F.transform(acc, lambda x, i: F.when((i == e["end"]) & better["s"].isNotNull() & (x["s"].isNull() | (better["s"] > x["s"])), better).otherwise(x)).cast(state)

    def finish(acc):
        last = F.get(acc, F.size(acc) - 1)
        return F.when(last["s"].isNotNull(), last["ids"])

    return edges.select("unit", F.aggregate("edges", init, step, finish).alias("ids"))


def encode_units(units: DataFrame, pieces: Pieces) -> DataFrame:
    """``(unit, ids)`` of a table of units by the relational lattice."""
    spark = units.sparkSession
    table = spark.createDataFrame(pa.table({"piece": list(pieces.ids), "id": pa.array(list(pieces.ids.values()), pa.int32()), "score": pa.array([pieces.scores[x] for x in pieces.ids], pa.float64())}))
    edges = lattice_edges(units.where(F.length("unit") > 0), table, pieces.longest)
    return fold_merges(edges) if pieces.kind == BPE else fold_viterbi(edges)


def encode_documents(docs: DataFrame, model_path: str, kind: int = BPE, vocabulary: int = 20_000, with_ids: bool = True) -> DataFrame:
    """``(doc_id, n_ids, ids_crc32, round_trip[, ids])`` per row of ``docs`` (``doc_id, text``; other columns are ignored).

    ``round_trip``: decoding the ids gives the text back, its own meta symbols read as spaces. Null and empty texts have
    no ids; an empty table gives no rows.
    """
    pieces = load_pieces(model_path, kind)
    spark: SparkSession = docs.sparkSession
    folded = encode_units(frequent_units(docs, vocabulary, model_path, kind), pieces).collect()  # at most vocabulary short units
    known = spark.sparkContext.broadcast({r.unit: np.array(r.ids, "<u4").tobytes() for r in folded if r.ids is not None and None not in r.ids})

    def make():
        p = load_pieces(model_path, kind)
        table = known.value
        rare = _rare(model_path, kind)

        def ids_of(text: str | None) -> bytes:
            return b"".join([table.get(u) or rare[u] for u in units_of(text, p)])

        def step(batch: pa.RecordBatch):
            for at in range(0, batch.num_rows, 200):
                part = batch.slice(at, 200)
                rows = []
                for text in part.column(1).to_pylist():
                    ids = ids_of(text)
                    back = decode_bytes(ids, p)
                    rows.append((len(ids) // 4, zlib.crc32(ids), back == (text or "").replace(META, " "), ids if with_ids else None))
                n, crc, same, ids = zip(*rows, strict=True)
                cols = [part.column(0), pa.array(n, pa.int64()), pa.array(crc, pa.int64()), pa.array(same, pa.bool_())]
                names = ["doc_id", "n_ids", "ids_crc32", "round_trip"]
                if with_ids:
                    cols.append(pa.array(ids, pa.binary()))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(cols, names)

        return step

    schema = "doc_id long, n_ids long, ids_crc32 long, round_trip boolean" + ", ids binary" * with_ids
    return map_batches(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), make, schema)


@lru_cache(maxsize=4)
def _rare(model_path: str, kind: int) -> BoundedCache:
    p = load_pieces(model_path, kind)
    return BoundedCache(lambda u: encode_unit(u, p), KEPT_UNITS)


@lru_cache(maxsize=4)
def _texts_array(p_key: tuple) -> list[bytes]:
    texts, byte_ids = p_key
    out = [t.replace(META, " ").encode() for t in texts]
    for b, i in enumerate(byte_ids):
        out[i] = bytes([b])
    return out


def decode_bytes(ids: bytes, p: Pieces) -> str:
    """Like ``decode`` for ids as little-endian uint32 bytes."""
    table = _texts_array((p.texts, p.byte_ids))
    text = b"".join(map(table.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")
    return text[1:] if text.startswith(" ") else text
