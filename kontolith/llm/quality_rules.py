"""Quality rules as a learned decision list (operator 7).

Text statistics are one pass over the whole texts. Sequential covering on labelled statistics grows a conjunction of
threshold tests by information gain on two thirds of the sample, prunes its last tests on the other third, removes what
it covers and goes on. The rules become one ordered Spark ``CASE`` expression over the statistics.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from kontolith.llm.common import as_bytes, cut, map_batches, mix64, struct_field
from kontolith.llm.words import WordHasher

#: ASCII white space between words, and the characters counted as symbols.
SPACE, SYMBOLS = b" \t\n\x0b\x0c\r", b"#*$%&|<>"
STATS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lines long, n_upper long, n_marks long, n_distinct long"
_MULT = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)]
_UPPER = bytes(range(65, 91))


def repeated_words(words: np.ndarray, width: int = 5) -> int:
    """Words that lie in a ``width``-word window found at least twice; ``words`` are 64-bit hashes."""
    n = len(words) - width + 1
    if n < 2:
        return 0
    h = words[:n] * _MULT[0]
    for i in range(1, width):
        h = h + words[i : n + i] * _MULT[i]
    h = mix64(h)
    s = np.sort(h)
    if not (s[1:] == s[:-1]).any():
        return 0
    order = np.argsort(h, kind="stable")
    s = h[order]
    same = s[1:] == s[:-1]
    twice = np.zeros(n, bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    edge = np.zeros(len(words) + 1, np.int64)
    at = np.flatnonzero(twice)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + width, -1)
    return int((np.cumsum(edge[:-1]) > 0).sum())


def statistics_of(text: bytes | None, code_points: int, w: np.ndarray) -> tuple[int, ...]:
    """The columns of ``STATS`` for one text in UTF-8, whose words hash to ``w``."""
    if not text:
        return (0,) * 9
    bare = text.translate(None, SPACE)
    seen, doubles, lines = set(), 0, 0
    for line in text.split(b"\n"):
        if line and not line.isspace():
            lines += 1
            doubles += line in seen
            seen.add(line)
    s = np.sort(w)
    return (
        len(w),
        code_points - (len(text) - len(bare)),
        len(bare) - len(bare.translate(None, SYMBOLS)),
        doubles,
        repeated_words(w),
        lines,
        len(bare) - len(bare.translate(None, _UPPER)),
        bare.count(b"!"),
        int(len(s) > 0) + int((s[1:] != s[:-1]).sum()),
    )


def text_statistics(docs: DataFrame, packed: str | None = None) -> DataFrame:
    """``doc_id`` and ``STATS`` per row; a null text counts as empty. With ``packed``, a struct column of which ``text``
    is a field, that column in place of ``doc_id``; the text is then sent once."""
    import pyarrow.compute as pc

    keep = [packed or "doc_id"]
    names = [x.split()[0] for x in STATS.split(", ")]

    def make():
        hasher = WordHasher()

        def step(whole: pa.RecordBatch):
            for at in range(0, whole.num_rows, 500):
                yield one(whole.slice(at, 500))

        def one(batch: pa.RecordBatch):
            text = struct_field(batch.column(0), "text") if packed else batch.column(1)
            hashes, counts = hasher(text)
            ends = np.concatenate(([0], np.cumsum(counts)))
            rows = [statistics_of(t, n or 0, hashes[ends[k] : ends[k + 1]]) for k, (t, n) in enumerate(zip(as_bytes(text), pc.utf8_length(text).to_pylist(), strict=True))]
            cols = list(zip(*rows, strict=True)) or [()] * len(names)
            return pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(keep))), *(pa.array(c, pa.int64()) for c in cols)], [*keep, *names])

        return step

    src = docs.select(*keep) if packed else docs.select(*keep, F.col("text").cast("string").alias("_text"))
    schema = StructType([*docs.select(*keep).schema, *(StructField(n, LongType()) for n in names)])
    return map_batches(src, make, schema)


def base_failed() -> Column:
    """Fewer than 10 words, or over a fifth of the words in repeated 5-word windows."""
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def ratio(top: str, bottom: str) -> Column:
    return F.when(F.col(bottom) > 0, F.col(top) / F.col(bottom)).otherwise(F.lit(0.0))


def features() -> dict[str, Column]:
    """What the rules test, as Spark expressions over the statistics."""
    return {
        "n_words": F.col("n_words").cast("double"),
        "word_length": ratio("word_chars", "n_words"),
        "symbol_share": ratio("n_symbols", "word_chars"),
        "dup_line_share": ratio("n_dup_lines", "n_lines"),
        "repeat_share": ratio("n_repeat_words", "n_words"),
        "upper_share": ratio("n_upper", "word_chars"),
        "mark_share": ratio("n_marks", "n_words"),
        "distinct_share": ratio("n_distinct", "n_words"),
    }


@dataclass(frozen=True)
class Test:
    feature: str
    at_least: bool
    limit: float

    def holds(self, x: np.ndarray, names: list[str]) -> np.ndarray:
        col = x[:, names.index(self.feature)]
        return col >= self.limit if self.at_least else col < self.limit

    def column(self) -> Column:
        col = features()[self.feature]
        return col >= self.limit if self.at_least else col < self.limit


@dataclass(frozen=True)
class Rule:
    tests: tuple[Test, ...]
    covered_bad: int
    covered_good: int

    def __str__(self) -> str:
        return " and ".join(f"{t.feature} {'>=' if t.at_least else '<'} {t.limit:.6g}" for t in self.tests)


def _covers(tests, x, names) -> np.ndarray:
    out = np.ones(len(x), bool)
    for t in tests:
        out &= t.holds(x, names)
    return out


def learn_rules(x: np.ndarray, bad: np.ndarray, names: list[str], max_rules: int = 12, max_tests: int = 4, cuts: int = 48, least_precision: float = 0.8, least_covered: int = 8) -> list[Rule]:
    """Ordered rules for the bad class by sequential covering; deterministic in the order of the rows."""
    part = np.arange(len(x)) % 3 == 2
    rules: list[Rule] = []
    alive = np.ones(len(x), bool)
    while len(rules) < max_rules:
        grow, prune = alive & ~part, alive & part
        if bad[grow].sum() < least_covered:
            break
        tests: list[Test] = []
        inside = grow.copy()
        while len(tests) < max_tests and (~bad & inside).any():
            p0, n0 = (bad & inside).sum(), inside.sum()
            best, gain = None, 0.0
            for j, name in enumerate(names):
                col = x[inside, j]
                values = np.unique(col)
                if len(values) < 2:
                    continue
                mids = (values[1:] + values[:-1]) / 2
                if len(mids) > cuts:
                    b = np.unique(x[inside & bad, j])
                    near = np.quantile(b, np.linspace(0, 1, cuts // 2)) if len(b) else []
                    mids = np.unique(np.concatenate((np.quantile(mids, np.linspace(0, 1, cuts)), near)))
                order = np.argsort(col, kind="stable")
                s, cum = col[order], np.concatenate(([0], np.cumsum(bad[inside][order])))
                below = np.searchsorted(s, mids, side="left")
                for at_least in (True, False):
                    n1 = len(s) - below if at_least else below
                    p1 = cum[-1] - cum[below] if at_least else cum[below]
                    ok = p1 > 0
                    g = np.where(ok, p1 * (np.log2(np.where(ok, p1 / np.maximum(n1, 1), 1)) - math.log2(p0 / n0)), -1)
                    k = int(np.argmax(g))
                    if g[k] > gain + 1e-9:
                        best, gain = Test(name, at_least, float(mids[k])), float(g[k])
            if best is None:
                break
            tests.append(best)
            inside &= best.holds(x, names)
        if not tests:
            break

        def worth(ts):
            got = _covers(ts, x, names) & prune
            p, n = (bad & got).sum(), (~bad & got).sum()
            return (p - n) / (p + n) if p + n else -1.0

        while len(tests) > 1 and worth(tests[:-1]) >= worth(tests):
            tests.pop()
        got = _covers(tests, x, names) & alive
        p, n = int((bad & got).sum()), int((~bad & got).sum())
        if p < least_covered or p / (p + n) < least_precision or worth(tests) < 2 * least_precision - 1 and (got & prune).any():
            break
        rules.append(Rule(tuple(tests), p, n))
        alive &= ~got
    return rules


def rules_expression(rules: list[Rule]) -> Column:
    """The number of the first rule (from 1) that holds, else 0."""
    out = None
    for i, rule in enumerate(rules, 1):
        cond = rule.tests[0].column()
        for t in rule.tests[1:]:
            cond = cond & t.column()
        out = F.when(cond, F.lit(i)) if out is None else out.when(cond, F.lit(i))
    return F.lit(0) if out is None else out.otherwise(F.lit(0))


def labelled_sample(labels: DataFrame, max_rows: int) -> DataFrame:
    """``doc_id, quality`` of at most about ``max_rows`` labelled rows, chosen by a hash of the id."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull())
    return known.where(F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(1_000_000)) < int(1_000_000 * min(1.0, max_rows / max(1, known.count()))) + 1)


def fit(stats: DataFrame, labels: DataFrame, max_rows: int = 40_000, **how) -> list[Rule]:
    """Learn from at most about ``max_rows`` labelled rows; rows that fail the base rules teach nothing."""
    cols = features()
    some = F.broadcast(labelled_sample(labels, max_rows))  # bounded by max_rows
    rows = stats.withColumn("doc_id", F.col("doc_id").cast("long")).join(some, "doc_id").where(~base_failed()).select("doc_id", "quality", *(c.alias(k) for k, c in cols.items())).toPandas()
    if rows.empty:
        return []
    rows["h"] = [xxhash.xxh3_64_intdigest(str(i)) for i in rows["doc_id"]]
    rows = rows.sort_values(["h", *cols], ignore_index=True)
    return learn_rules(rows[list(cols)].to_numpy(float), rows["quality"].to_numpy() == 0, list(cols), **how)


def verdicts(stats: DataFrame, rules: list[Rule]) -> DataFrame:
    """``base_failed, rule, kept`` beside the statistics; ``rule`` is the rejecting rule's number or 0."""
    return stats.withColumn("base_failed", base_failed()).withColumn("rule", rules_expression(rules)).withColumn("kept", ~F.col("base_failed") & (F.col("rule") == 0))


def quality_verdicts(docs: DataFrame, labels: DataFrame, **how) -> DataFrame:
    """Statistics, rules learned from ``labels`` (``doc_id, quality``; 0 is bad) and verdict per row of ``docs`` (``doc_id, text``).

    Null texts are empty and fail the base rules; rows with a null id are judged but teach nothing; without labels only
    the base rules reject; an empty table gives no rows; other columns are ignored.
    """
    stats = cut(text_statistics(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")), "quality", 1000)
    return verdicts(stats, fit(stats, labels, **how))


def keep_good(docs: DataFrame, labels: DataFrame, max_rows: int = 40_000, **how) -> DataFrame:
    """``docs`` (all columns) without what the base rules or the learned rules reject.

    Null and empty texts fail the base rules and go; repeated rows and rows with a null id are judged each by their own
    text; ties don't occur, as no order enters; an empty table gives no rows; columns of any name stay.
    """
    some = labelled_sample(labels, max_rows)
    taught = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(some.select("doc_id").distinct()), "doc_id", "left_semi")
    rules = fit(text_statistics(taught), labels, max_rows, **how)
    flat = text_statistics(docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row")), "_row")
    return verdicts(flat, rules).where("kept").select(*(F.col(f"_row.`{c}`").alias(c) for c in docs.columns))
