"""Exact Jaccard self-join of word-shingle sets by PartEnum signatures (operator 8).

Sizes fall into bands whose ends differ by the similarity threshold, so linked sets lie in one band or in neighbours.
For a pair of neighbouring bands the symmetric difference of a linked pair is at most ``k``. The 64-bit shingle domain is
split into ``n1`` partitions, each of ``n2`` parts: if at most ``k`` elements differ, then some partition holds at most one
of them and ``n2 - 1`` of its parts are the same in both sets. Enumerating the subsets that leave one part out gives
signatures, and linked sets share at least one. Two parts give the fewest signatures; for lower thresholds, where a part
holds few elements, three make them more telling. Where ``k`` is 1, every element is a part: a set signs its whole content
and its content less each element, and only a whole content meets a lessened one. Where ``k`` is 0, linked sets are equal.

A signature without elements would be common to many unrelated sets, so none is ever made. ``e`` spare partitions allow
that: a linked pair has at least ``1 + e`` good partitions, so while at most ``e`` partitions of one of its sets have such
a signature, a good partition without one remains. A set with more of them signs again under another hashing of the
domain, until one fits; a linked pair then shares a telling signature under the hashing at which the first of the two ends.

Candidates are checked on the exact sets. Within a signature's bucket every set is first compared with the smallest one;
after uniting, members of what is still in different components are compared block against block, so that a bucket of n
near copies costs n comparisons, no task holds more than two blocks, and no pair is lost: a skipped pair already shares
its component. Before their texts are read, pairs whose sizes or parity bits already rule a link out are left; both tests
hold for every linked pair.
"""

from __future__ import annotations

from bisect import bisect_left
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from kontolith.llm.common import BoundedCache, cut, drop_cut, hot_join, map_batches, mix64, split_by_keys
from kontolith.llm.components import connected_components
from kontolith.llm.words import WordHasher

_MULT = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], dtype=np.uint64)

_ALL = (1 << 64) - 1


def shingle_sets(column: pa.Array, width: int, hasher: WordHasher) -> list[np.ndarray]:
    """Per row the sorted distinct 64-bit hashes of its ``width``-word shingles; the whole sequence if it has fewer words.

    Words are runs without ASCII white space, A-Z lower-cased. Null or wordless texts give an empty set.
    """
    w, counts = hasher(column)
    h = np.zeros(len(w), np.uint64)
    for i in range(min(width, len(w))):
        h[: len(w) - i] += w[i:] * _MULT[i]
    h = mix64(h)
    out, at = [], 0
    for n in counts.tolist():
        if n >= width:
            s = np.sort(h[at : at + n - width + 1])
            out.append(s[np.concatenate(([True], s[1:] != s[:-1]))])
        elif n:
            short = w[at : at + n] * _MULT[:n]
            out.append(mix64(np.array([(int(short.sum(dtype=np.uint64)) + n * int(_MULT[7])) & _ALL], np.uint64)))
        else:
            out.append(np.empty(0, np.uint64))
        at += n
    return out


def _parts(batch: pa.RecordBatch, rows: int = 500):
    """A batch in slices, so that few sets are held at once."""
    for at in range(0, batch.num_rows, rows):
        yield batch.slice(at, rows)


@lru_cache(maxsize=16)
def band_ends(percent: int, upto: int = 1 << 40) -> tuple[int, ...]:
    """Upper ends of the size bands: r[0] = floor(100 / percent), then floor((r + 1) * 100 / percent)."""
    ends, low = [], 1
    while low <= upto:
        ends.append(low * 100 // percent)
        low = ends[-1] + 1
    return tuple(ends)


@lru_cache(maxsize=4096)
def _instance(band: int, percent: int) -> tuple[int, int, int, np.ndarray, np.ndarray]:
    """The symmetric difference of linked sets at most, parts a partition, spare partitions, the inner limits of all parts and a tag for each signature, for sets of ``band`` and ``band + 1``."""
    ends = band_ends(percent)
    k = (ends[band] + ends[band + 1]) * (100 - percent) // (100 + percent)
    spare = 1 + k // 40
    parts = 2 if percent >= 85 else 3
    n = parts * (k // 2 + 1 + spare)
    if (ends[band - 1] if band else 0) + 1 < 2 * n // parts:
        spare = -1  # a threshold so low that the smallest sets have hardly an element a partition
    limits = np.array([(j << 64) // n for j in range(1, n)], dtype=np.uint64)
    return k, parts, spare, limits, mix64(np.arange(1, n + 1, dtype=np.uint64) * _MULT[4] + np.uint64((band + 1) * int(_MULT[5]) & _ALL))


def signatures(s: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """The PartEnum signatures of a sorted set as int64, and which of them are lessened contents; empty for an empty set.

    Two sets are candidates if they share a signature that is not lessened in both.
    """
    n = len(s)
    if not n:
        return np.empty(0, np.int64), np.empty(0, bool)
    band = bisect_left(band_ends(percent), n)
    out, less = [], []
    for instance in (band - 1, band) if band else (band,):
        k, parts, spare, limits, tags = _instance(instance, percent)
        if k == 0:
            continue
        if spare < 0:  # linked sets share an element
            out.append(s * _MULT[6] + tags[0])
            less.append(np.zeros(n, bool))
            continue
        if k == 1:
            whole = s.sum(dtype=np.uint64)
            out.append(np.concatenate(([whole], whole - s)) * _MULT[6] + tags[0])
            less.append(np.arange(n + 1) > 0)
            continue
        hashing, e = 0, s
        while True:
            run = np.empty(n + 1, np.uint64)
            run[0] = 0
            np.cumsum(e, out=run[1:])
            at = np.empty(len(limits) + 2, np.int64)
            at[0], at[1:-1], at[-1] = 0, np.searchsorted(e, limits), n
            bounds, sums = at[::parts], run[at]
            whole, held = np.repeat(sums[::parts][1:] - sums[::parts][:-1], parts), np.repeat(bounds[1:] - bounds[:-1], parts)
            sig = (whole - (sums[1:] - sums[:-1])) * _MULT[6] + tags
            bare = held == at[1:] - at[:-1]
            out.append(sig[~bare])
            less.append(np.zeros(len(out[-1]), bool))
            if np.count_nonzero(bare.reshape(-1, parts).any(axis=1)) <= spare:
                break
            hashing += 1
            e = np.sort(mix64(s + np.uint64(hashing * int(_MULT[7]) & _ALL)))
            tags = mix64(tags)
    if not out:
        return np.empty(0, np.int64), np.empty(0, bool)
    return np.concatenate(out).view(np.int64), np.concatenate(less)


def _parity(s: np.ndarray, bits: int = 512) -> list[int]:
    """Parities of the set's element counts in hash buckets, as longs: two sets differ in no more bits than elements."""
    odd = (np.bincount((s & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1).astype(np.uint8)
    return np.packbits(odd).view(np.int64).tolist()


def set_keys(docs: DataFrame, width: int = 4) -> DataFrame:
    """``(doc_id, n_shingles, key_a, key_b, parity, wide)`` per row: the set's size, a 128-bit key of its content, its parities.

    ``parity`` has 512 bits; ``wide``, for sets over 256 elements, at least two bits an element.
    """

    def make():
        words = WordHasher(lower=True)

        def step(whole: pa.RecordBatch):
            for batch in _parts(whole):
                yield one(batch)

        def one(batch: pa.RecordBatch):
            sets = shingle_sets(batch.column(1), width, words)
            n = [len(s) for s in sets]
            a = [int(s.sum(dtype=np.uint64).astype(np.int64)) for s in sets]
            b = [int(mix64(s ^ _MULT[5]).sum(dtype=np.uint64).astype(np.int64)) for s in sets]
            wide = [_parity(s, 1 << (2 * len(s) - 1).bit_length()) if len(s) > 256 else None for s in sets]
            longs = pa.list_(pa.int64())
            cols = [batch.column(0), *(pa.array(x, pa.int64()) for x in (n, a, b)), pa.array(map(_parity, sets), longs), pa.array(wide, longs)]
            return pa.RecordBatch.from_arrays(cols, ["doc_id", "n_shingles", "key_a", "key_b", "parity", "wide"])

        return step

    schema = "doc_id long, n_shingles long, key_a long, key_b long, parity array<long>, wide array<long>"
    return map_batches(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), make, schema)


def _folded(x: np.ndarray, longs: int) -> np.ndarray:
    """Parities of fewer buckets: bucket numbers modulo the smaller size."""
    return np.bitwise_xor.reduce(x.reshape(-1, longs), axis=0)


def _narrowed(pairs: DataFrame, slim: DataFrame, percent: int) -> DataFrame:
    """``pairs`` without those that the wide parities rule out."""
    of = lambda c: slim.where("wide is not null").select(F.col("doc_id").alias(c), F.struct("n_shingles", "wide").alias(f"w{c}"))
    both = pairs.join(of("a"), "a", "left").join(of("b"), "b", "left").select("a", "b", "wa", "wb")

    def make():
        def step(batch: pa.RecordBatch):
            keep = []
            for k in range(batch.num_rows):
                wa, wb = batch.column(2)[k], batch.column(3)[k]
                if not wa.is_valid or not wb.is_valid:
                    keep.append(True)
                    continue
                x, y = (w["wide"].values.to_numpy() for w in (wa, wb))
                size = min(len(x), len(y))
                apart = int(np.bitwise_count((_folded(x, size) ^ _folded(y, size)).view(np.uint64)).sum())
                keep.append(apart * (100 + percent) <= (wa["n_shingles"].as_py() + wb["n_shingles"].as_py()) * (100 - percent))
            return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

        return step

    return map_batches(both, make, "a long, b long").distinct()


def _may_link(f: str, g: str, percent: int):
    """What every linked pair fulfils: sizes within the threshold's ratio, and no more odd bits apart than elements."""
    n, m = F.col(f"{f}.n"), F.col(f"{g}.n")
    apart = sum((F.bit_count(F.col(f"{f}.s{i}").bitwiseXOR(F.col(f"{g}.s{i}"))) for i in range(8)), F.lit(0))
    return (100 * F.least(n, m) >= percent * F.greatest(n, m)) & (apart * (100 + percent) <= (n + m) * (100 - percent))


def _signature_rows(docs: DataFrame, width: int, percent: int) -> DataFrame:
    """``(doc, sigs, less)``: all signatures, of one row per content key and task (the others of that content are copies)."""

    def make():
        words, seen = WordHasher(lower=True), BoundedCache(lambda _: True, 1_000_000)

        def step(whole: pa.RecordBatch):
            for batch in _parts(whole):
                sigs, less, ids = [], [], []
                for doc, s in zip(batch.column(0).to_pylist(), shingle_sets(batch.column(1), width, words), strict=True):
                    if doc is None or not len(s):
                        continue
                    key = (len(s), int(s.sum(dtype=np.uint64)), int(mix64(s ^ _MULT[5]).sum(dtype=np.uint64)))
                    if key in seen:
                        continue
                    seen[key]
                    own, lessened = signatures(s, percent)
                    if len(own):
                        sigs.append(own)
                        less.append(lessened)
                        ids.append(np.full(len(own), doc, np.int64))
                if sigs:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (sigs, ids, less)], ["sig", "doc", "less"])

        return step

    return map_batches(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), make, "sig long, doc long, less boolean")


#: Rows of an Arrow batch: texts, and pairs of exact sets.
TEXT_ROWS, PAIR_ROWS = 1000, 250
#: Members of a bucket that are compared with each other in one task at most, by blocks of this size.
BLOCK_MEMBERS = 512
#: Documents, chosen by a hash, whose signatures tell which buckets are large; only the dealing of rows depends on them.
HEAT_SAMPLE, HEAT_LEAST = 2000, 8


def bucket_members(docs: DataFrame, width: int, percent: int) -> DataFrame:
    """``(sig, doc, less, a)``: members of buckets that hold a candidate pair, ``a`` being the smallest whole member; a table.

    Buckets that ``HEAT_LEAST`` of some ``HEAT_SAMPLE`` documents share are dealt to many tasks; their smallest members
    then meet by an aggregation. Such signatures are as few as the sample has, however large the table is.
    """
    share = int(1_000_000 * min(1.0, HEAT_SAMPLE / max(1, docs.count()))) + 1
    some = docs.where(F.pmod(F.xxhash64("doc_id", F.lit(9)), F.lit(1_000_000)) < share)
    hot = cut(_signature_rows(some, width, percent).groupBy("sig").agg(F.countDistinct("doc").alias("n")).where(F.col("n") >= HEAT_LEAST).select("sig", F.lit(True).alias("hot")), "hot-buckets")
    salted = _signature_rows(docs, width, percent).join(F.broadcast(hot), "sig", "left").withColumn("salt", F.when(F.col("hot"), F.pmod(F.xxhash64("doc"), F.lit(256)).cast("int")).otherwise(-1))
    bucket = Window.partitionBy("sig", "salt")
    whole = F.when(~F.col("less"), F.col("doc"))
    rows = salted.withColumn("a", F.min(whole).over(bucket)).withColumn("low", F.min("doc").over(bucket)).withColumn("high", F.max("doc").over(bucket))
    found = cut(rows.where("hot or (a is not null and low <> high)").select("sig", "doc", "less", "a", "hot"), "members", TEXT_ROWS)
    least = found.where("hot").groupBy("sig").agg(F.min("a").alias("least"))  # a row per hot signature
    return found.join(F.broadcast(least), "sig", "left").select("sig", "doc", "less", F.coalesce("least", "a").alias("a")).where("a is not null")


def _sets_of(ids: DataFrame, docs: DataFrame, width: int) -> DataFrame:
    """``(id, s)``: the exact sets of the documents ``ids``, as a table."""
    ids = cut(ids.distinct(), "ids")
    texts = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("t"))

    def make():
        words = WordHasher(lower=True)

        def step(whole: pa.RecordBatch):
            for batch in _parts(whole):
                sets = shingle_sets(batch.column(1), width, words)
                ends = np.cumsum([0, *map(len, sets)]).astype(np.int32)
                values = np.concatenate(sets).view(np.int64) if sets else np.empty(0, np.int64)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(ends), pa.array(values))], ["id", "s"])

        return step

    wanted = split_by_keys(texts, ids, ["id"])[0].join(ids.hint("merge"), "id", "left_semi")
    out = cut(map_batches(wanted, make, "id long, s array<long>"), "exact-sets", TEXT_ROWS)
    drop_cut(ids)
    return out


def verified(pairs: DataFrame, docs: DataFrame, slim: DataFrame, width: int, percent: int) -> DataFrame:
    """Of the pairs ``(a, b)`` those whose exact sets reach the threshold: 100 * intersection >= percent * union; a table."""
    pairs = cut(_narrowed(pairs, slim, percent), "pairs", 8 * PAIR_ROWS)
    sets = _sets_of(pairs.select(F.col("a").alias("id")).union(pairs.select("b")), docs, width)
    with_b = pairs.join(sets.select(F.col("id").alias("b"), F.col("s").alias("set_b")), "b")
    with_both = with_b.join(sets.select(F.col("id").alias("a"), F.col("s").alias("set_a")), "a")

    def make():
        def step(batch: pa.RecordBatch):
            keep = []
            for k in range(batch.num_rows):
                sa, sb = (batch.column(i)[k].values.to_numpy().view(np.uint64) for i in (2, 3))
                if len(sa) > len(sb):
                    sa, sb = sb, sa
                common = 0
                if len(sa):
                    at = np.searchsorted(sb, sa)
                    common = int((sb[np.minimum(at, len(sb) - 1)] == sa).sum())
                keep.append(bool(common) and 100 * common >= percent * (len(sa) + len(sb) - common))
            return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

        return step

    out = cut(map_batches(with_both.select("a", "b", "set_a", "set_b"), make, "a long, b long"), "links", PAIR_ROWS)
    drop_cut(sets)
    drop_cut(pairs)
    return out


def jaccard_classes(docs: DataFrame, width: int = 4, percent: int = 85) -> DataFrame:
    """``(doc_id, n_shingles, component_id)`` per row of ``docs`` (columns ``doc_id``, ``text``; others are ignored).

    Two documents link when their shingle sets' Jaccard similarity is at least ``percent`` / 100; ``component_id`` is the
    smallest id that links reach. Documents without words link with nothing. Rows that share a ``doc_id`` are one node:
    it links if any of its texts does, each row has its own ``n_shingles``. A row with a null id links with nothing and
    has a null component. An empty table
    gives an empty result.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    slim = cut(set_keys(docs, width), "sets", TEXT_ROWS)
    real = slim.where("n_shingles > 0 and doc_id is not null")
    content = ["n_shingles", "key_a", "key_b"]
    copies = cut(real.groupBy(*content).agg(F.min("doc_id").alias("rep"), F.count("*").alias("n")).where("n > 1"), "copied-contents")
    by_rep = cut(hot_join(real.select("doc_id", *content), copies, content, "n", ["rep"]).where("doc_id <> rep").groupBy("doc_id").agg(F.collect_set("rep").alias("reps"), F.count("*").alias("n")), "copies")
    same = by_rep.select("doc_id", F.explode("reps").alias("rep"))
    # documents of which every row copies another need no signatures
    idle = cut(by_rep.join(real.groupBy("doc_id").agg(F.count("*").alias("all")), "doc_id").where("n = all").select("doc_id"), "idle")
    maybe, first = split_by_keys(docs, idle, ["doc_id"])
    members = cut(bucket_members(first.union(maybe.join(idle.hint("merge"), "doc_id", "left_anti")), width, percent), "bucket-members", TEXT_ROWS)
    parity = F.struct(F.col("n_shingles").alias("n"), *(F.col("parity")[i].alias(f"s{i}") for i in range(8)))
    marks = real.select(F.col("doc_id").alias("doc"), parity.alias("f"))
    firsts = cut(members.where("doc <> a").select("a", F.col("doc").alias("b")).distinct(), "firsts")
    pivots = cut(marks.join(firsts.groupBy(F.col("a").alias("doc")).agg(F.count("*").alias("n")), "doc").groupBy(F.col("doc").alias("a")).agg(F.max("n").alias("n"), F.collect_set("f").alias("gs")), "pivots")
    marked = hot_join(firsts.join(marks.select(F.col("doc").alias("b"), "f"), "b"), pivots, ["a"], "n", ["gs"])
    star = cut(marked.select("a", "b", "f", F.explode("gs").alias("g")).where(_may_link("f", "g", percent)).select("a", "b"), "star")
    links = verified(star, docs, slim, width, percent)
    known = links.select(F.col("a").alias("u"), F.col("b").alias("v")).union(same)
    labels = connected_components(known)
    lab = cut(members.join(labels.withColumnRenamed("node", "doc"), "doc", "left").select("sig", "doc", F.coalesce("component", "doc").alias("c")), "labelled")
    sizes = lab.groupBy("sig", "c").agg(F.count("*").alias("n")).groupBy("sig").agg(F.max_by("c", F.struct("n", "c")).alias("most"), F.sum("n").alias("n"), F.count("*").alias("parts"))
    apart = cut(sizes.where("parts > 1").select("sig", "most", "n", F.ceil(F.col("n") / BLOCK_MEMBERS).cast("int").alias("blocks")), "open-buckets")
    opened = cut(hot_join(lab, apart, ["sig"], "n", ["most", "blocks"]).join(marks, "doc").withColumn("block", F.pmod(F.xxhash64("doc"), F.col("blocks")).cast("int")), "open")
    for done in (members, lab, firsts, pivots, idle):
        drop_cut(done)
    every = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    small = opened.where("c <> most").select("sig", F.col("block").alias("i"), every.alias("j"), F.col("doc").alias("x"), F.col("c").alias("cx"), "f")
    large = opened.select("sig", every.alias("i"), F.col("block").alias("j"), F.col("doc").alias("y"), F.col("c").alias("cy"), F.col("f").alias("g"))
    cross = small.join(large, ["sig", "i", "j"]).where((F.col("cx") != F.col("cy")) & _may_link("f", "g", percent))
    rest = cross.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct().join(star, ["a", "b"], "left_anti")
    more = verified(rest, docs, slim, width, percent)
    final = connected_components(known.union(more.select("a", "b"))) if more.limit(1).count() else labels
    out = slim.join(final.withColumnRenamed("node", "doc_id"), "doc_id", "left")
    drop_cut(opened)
    return out.select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))


def keep_one_each(docs: DataFrame, width: int = 4, percent: int = 85) -> DataFrame:
    """``docs`` with one row of each group of linked documents, that of the smallest id; all columns stay.

    Rows without words (null and empty texts) and rows with a null id are in no group and stay. Rows that repeat an id
    are one node: of those that repeat its text too one stays, other texts of the id all do. An empty table gives no
    rows; columns of any name stay.
    """
    classes = cut(jaccard_classes(docs, width, percent), "classes")
    gone = cut(classes.where("doc_id <> component_id").select(F.col("doc_id").alias("_id")).distinct(), "gone")
    again = cut(classes.where("n_shingles > 0 and doc_id = component_id").groupBy(F.col("doc_id").alias("_id")).count().where("count > 1").select("_id"), "repeated-ids")
    flat = docs.select(F.col("doc_id").cast("long").alias("_id"), F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row"))
    maybe, sure = split_by_keys(flat, gone.union(again), ["_id"])
    left = maybe.join(gone.hint("merge"), "_id", "left_anti").join(again.withColumn("_again", F.lit(True)).hint("merge"), "_id", "left")
    once = left.where("_again").groupBy("_id", F.sha2(F.col("_row.text").cast("string"), 256)).agg(F.first("_row").alias("_row")).select("_id", "_row")
    kept = sure.union(left.where("_again is null").select("_id", "_row")).union(once)
    drop_cut(classes)
    return kept.select(*(F.col(f"_row.`{c}`").alias(c) for c in docs.columns))
