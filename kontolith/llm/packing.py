"""Vector best-fit packing of tokenised documents into sequences (operator 5).

A bin has residual capacities in tokens, documents and attention cost (the sum of squared piece lengths). Pieces come in
descending weighted size; each goes to the feasible bin that the rule prefers: ``norm`` takes the smallest weighted norm
of what would be left, ``dot`` the largest weighted dot product of the piece with what is left.

Pieces are dealt by hash to groups of bounded size, so any number of machines packs them. Bins that come out less full
than ``full_enough`` are opened and their pieces dealt again to fewer groups, until one group holds what is left; so the
last, half-empty bins of all groups end up together.
"""

from __future__ import annotations

import re
import zlib
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kontolith.llm.common import as_texts, cut, drop_cut, map_batches

#: Pieces that one task packs at most, on average.
GROUP_PIECES = 3000


#: Chunks whose ids a Python worker keeps in each of two generations; about 200 bytes each.
KEPT_CHUNKS = 450_000
#: Lower-case Latin words with closing ASCII marks (no apostrophes): the tokenizer parts one from the other.
_PLAIN = re.compile("([a-zß-öø-ÿ]+)([!-&(-/:-@[-`{-~]*)")


class ChunkIds:
    """Little-endian uint32 ids of texts by their white-space-free chunks, which are kept for the life of a Python worker.

    The tokenizer splits at white space before merging, so a text's ids are its chunks' ids in order. A plain word with
    closing marks is the word's ids and the marks'; new words are encoded together and told apart by the tokens that end
    a word; other chunks are encoded alone.
    """

    def __init__(self, tokenizer_path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(tokenizer_path)
        self.known: dict[str, bytes] = {"": b""}
        self.older: dict[str, bytes] = {}  # the generation before; what is used again moves on
        vocabulary = self.tokenizer.get_vocab()
        self.ends_word = np.zeros(max(vocabulary.values(), default=0) + 1, bool)
        self.ends_word[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True

    def _ids(self, text: str) -> np.ndarray:
        return np.asarray(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")  # without offsets

    def learn(self, chunks: set[str]) -> None:
        known, marked = self.known, []
        words: set[str] = set()
        for c in chunks:
            m = _PLAIN.fullmatch(c)
            if m is None:
                known[c] = self._ids(c).tobytes()
                continue
            word, marks = m.groups()
            if marks:
                marked.append((c, word, marks))
                if marks not in known:
                    known[marks] = self._ids(marks).tobytes()
            if word not in known:
                if word in self.older:
                    known[word] = self.older[word]
                else:
                    words.add(word)
        plain = list(words)
        for at in range(0, len(plain), 1000):
            some = plain[at : at + 1000]
            ids = self._ids(" ".join(some))
            ends = np.flatnonzero(self.ends_word[ids]) + 1
            if len(ends) == len(some) and ends[-1] == len(ids):
                data, bounds = ids.tobytes(), [0, *(4 * ends).tolist()]
                known.update(zip(some, map(data.__getitem__, map(slice, bounds, bounds[1:])), strict=False))
            else:  # the vocabulary has no such word ends
                known.update((c, self._ids(c).tobytes()) for c in some)
        known.update((c, known[word] + known[marks]) for c, word, marks in marked)

    def of_texts(self, texts: list[str | None]) -> list[bytes]:
        if len(self.known) > KEPT_CHUNKS:
            self.known, self.older = {"": b""}, self.known
        split = [(t if "Σ" in t else t.lower()).replace("\n", " ").split(" ") if t else [] for t in texts]
        found = [list(map(self.known.get, chunks)) for chunks in split]
        new = {c for chunks, ids in zip(split, found, strict=True) if None in ids for c, i in zip(chunks, ids, strict=True) if i is None}
        again = new & self.older.keys()
        self.known.update((c, self.older[c]) for c in again)
        self.learn(new - again)
        known = self.known
        return [b"".join([known[c] if i is None else i for c, i in zip(chunks, ids, strict=True)] if None in ids else ids) for chunks, ids in zip(split, found, strict=True)]


@lru_cache(maxsize=2)
def chunk_ids(tokenizer_path: str) -> ChunkIds:
    return ChunkIds(tokenizer_path)


def token_pieces(docs: DataFrame, tokenizer_path: str, end_id: int = 1, size: int = 4096, with_ids: bool = False) -> DataFrame:
    """``(doc_id, piece, start, length, ids_crc32, salt[, ids])``: each row's ids and ``end_id``, cut at ``size`` ids."""
    tail, step_bytes = np.asarray([end_id], "<u4").tobytes(), 4 * size

    def make():
        salt = 0

        def step(whole: pa.RecordBatch):
            for at in range(0, whole.num_rows, 200):
                yield one(whole.slice(at, 200))

        def one(batch: pa.RecordBatch):
            nonlocal salt
            rows = []
            for doc, own_ids in zip(batch.column(0).to_pylist(), chunk_ids(tokenizer_path).of_texts(as_texts(batch.column(1))), strict=True):
                ids = own_ids + tail
                for piece, at in enumerate(range(0, len(ids), step_bytes)):
                    own = ids[at : at + step_bytes]
                    salt += 1
                    rows.append((doc, piece, at // 4, len(own) // 4, zlib.crc32(own), salt, own if with_ids else None))
            cols = list(zip(*rows, strict=True)) or [()] * 7
            types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            n = 7 if with_ids else 6
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols[:n], types[:n], strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32", "salt", "ids"][:n])

        return step

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, salt long" + ", ids binary" * with_ids
    return map_batches(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), make, schema)


def best_fit(lengths: np.ndarray, capacity: int, max_docs: int, max_cost: float, weights: tuple[float, float, float] = (1.0, 0.01, 0.01), rule: str = "norm") -> tuple[np.ndarray, np.ndarray]:
    """Bin number and offset of each piece. A piece that alone breaks the cost limit still gets a bin of its own."""
    n = len(lengths)
    caps = np.array([capacity, max_docs, max_cost], float)
    w = np.asarray(weights, float)
    need = np.stack([lengths / caps[0], np.full(n, 1 / caps[1]), lengths.astype(float) ** 2 / caps[2]], axis=1)
    order = np.lexsort((np.arange(n), -(need @ w)))
    left = np.empty((max(n, 1), 3))
    ids = np.empty(max(n, 1), np.int64)  # numbers of the open bins, in step with left
    bins, offsets, used = np.empty(n, np.int64), np.empty(n, np.int64), np.zeros(max(n, 1), np.int64)
    open_, made, smallest = 0, 0, need.min(axis=0) if n else None
    slack = 1e-12
    for i in order:
        d = need[i]
        view = left[:open_]
        fits = (view >= d - slack).all(axis=1)
        at = -1
        if fits.any():
            where = np.flatnonzero(fits)
            rest = view[where]
            score = ((rest - d) ** 2) @ w if rule == "norm" else -(rest @ (w * d))
            at = int(where[np.argmin(score)])
        else:
            at = open_
            left[at], ids[at] = 1.0, made
            made, open_ = made + 1, open_ + 1
        b = ids[at]
        bins[i], offsets[i] = b, used[b]
        used[b] += lengths[i]
        left[at] -= d
        if (left[at] < smallest - slack).any():  # no piece fits any more
            open_ -= 1
            left[at], ids[at] = left[open_], ids[open_]
    return bins, offsets


def pack(pieces: DataFrame, capacity: int = 4096, max_docs: int = 4096, max_cost: float | None = None, rule: str = "norm", group_pieces: int = GROUP_PIECES, full_enough: float = 0.995) -> DataFrame:
    """``pieces`` (``doc_id, piece, start, length, ids_crc32, salt``, one table that can be read again) with ``sequence_id`` and ``offset``.

    ``max_cost`` None: the square of ``capacity``, which no bin within the token limit breaks. Pieces longer than
    ``capacity`` are an error of the caller.
    """
    max_cost = float(capacity) ** 2 if max_cost is None else float(max_cost)
    columns = ["doc_id", "piece", "start", "length", "ids_crc32"]
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, salt long, sequence_id long, offset long, fill double"
    done, todo, n, round_ = None, pieces, pieces.count(), 0
    while True:
        groups, first_id = max(1, -(-n // group_pieces)), round_ << 56

        def one(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values(["length", "doc_id", "piece", "salt"], ascending=[False, True, True, True], ignore_index=True)
            lengths = pdf["length"].to_numpy()
            bins, offsets = best_fit(lengths, capacity, max_docs, max_cost, rule=rule)
            filled = np.bincount(bins, weights=lengths) if len(bins) else np.empty(0)
            return pdf.drop(columns="g").assign(sequence_id=first_id + (int(key[0]) << 20) + bins, offset=offsets, fill=filled[bins] / capacity)

        dealt = todo.withColumn("g", F.pmod(F.xxhash64("doc_id", "piece", "salt", F.lit(round_)), F.lit(groups)))
        packed = cut(dealt.groupBy("g").applyInPandas(one, schema), "packed")
        if groups == 1:
            last = packed
        else:
            rest = packed.where(F.col("fill") < full_enough).select(*columns, "salt")
            left = rest.count()
            last = packed if left > 0.7 * n else packed.where(F.col("fill") >= full_enough)
        last = last.select(*columns, "sequence_id", "offset")
        done = last if done is None else done.union(last)
        if groups == 1 or left > 0.7 * n or not left:
            return done
        todo, n, round_ = rest, left, round_ + 1


def pack_documents(docs: DataFrame, tokenizer_path: str, end_id: int = 1, size: int = 4096, **limits) -> DataFrame:
    """Tokenise ``docs`` (``doc_id``, ``text``; other columns are ignored), cut and pack them.

    One row per piece: ``doc_id, piece, start, length, ids_crc32, sequence_id, offset``. Null and empty texts are one
    piece of ``end_id`` alone; repeated rows are packed each; an empty table gives no rows.
    """
    pieces = cut(token_pieces(docs, tokenizer_path, end_id, size), "pieces", 1000)
    out = pack(pieces, size, **limits)
    drop_cut(pieces)
    return out
