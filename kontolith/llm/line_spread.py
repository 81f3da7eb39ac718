"""Cross-site line removal by distinct-site spread (operator 9), in DataFrame functions only.

Each line's hash gathers a HyperLogLog sketch of the sites it occurs on; sketches of map tasks merge in the aggregation.
Lines whose estimate is clear of the threshold are decided by it, those near the threshold get an exact distinct count.
Of a line found on enough sites the first occurrence stays (smallest doc_id, then earliest line), the others go.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kontolith.llm.common import cut, drop_cut, hot_join, split_by_keys

#: Tasks over which the rows of one line are spread at most.
SALTS = 64
_NO_ID = -(1 << 63)


def _row_key(id_col: str) -> list[Column]:
    return [F.coalesce(F.col(id_col).cast("long"), F.lit(_NO_ID)).alias("did"), F.xxhash64(F.col(id_col).cast("long"), F.col("text")).alias("rid")]


def document_lines(docs: DataFrame, site: str, min_words: int) -> DataFrame:
    """``did, rid, site, pos, k1, k2`` per line of at least ``min_words`` words; the keys hash the line without outer blanks."""
    lines = docs.select(*_row_key("doc_id"), F.col(f"`{site}`").cast("string").alias("site"), F.posexplode(F.split(F.col("text").cast("string"), "\n")).alias("pos", "line"))
    trimmed = lines.withColumn("line", F.trim(F.translate("line", "\t\r\x0b\x0c", "    "))).where(F.col("line").rlike(f"^(?:[^ ]+ +){{{min_words - 1}}}[^ ]") if min_words > 1 else F.col("line") != "")
    return trimmed.select("did", "rid", "site", "pos", F.xxhash64("line").alias("k1"), F.xxhash64(F.lit(1), "line").alias("k2"))


def spread_lines(lines: DataFrame, min_sites: int, lg_k: int = 12) -> DataFrame:
    """The occurrences (rows of ``lines``) of lines found on at least ``min_sites`` distinct sites, as a table; rows without a site count for none."""
    margin = max(1, round(min_sites * 4 * 1.04 / (1 << lg_k) ** 0.5))
    rough = lines.groupBy("k1", "k2").agg(F.hll_sketch_estimate(F.hll_sketch_agg("site", lg_k)).alias("about"), F.count("site").alias("sited"), F.count("*").alias("n"))
    maybe = cut(rough.where((F.col("sited") >= min_sites) & (F.col("about") >= min_sites - margin)).select("k1", "k2", "n", (F.col("about") <= min_sites + margin).alias("near")), "spread")
    found = cut(hot_join(lines, maybe, ["k1", "k2"], "n", ["near"]), "found-lines")
    exact = found.where("near and site is not null").select("k1", "k2", "site").distinct().groupBy("k1", "k2").agg(F.count("*").alias("sites"))
    few = cut(exact.where(F.col("sites") < min_sites).select("k1", "k2").join(maybe, ["k1", "k2"]).select("k1", "k2", "n"), "few-sites")
    out = found.where("not near").union(_without(found.where("near"), few))
    drop_cut(maybe)
    return out.drop("near")


def _without(found: DataFrame, keys: DataFrame) -> DataFrame:
    """``found`` without the rows of ``keys`` (``k1, k2, n``, each of them in ``found`` ``n`` times), none of which meet in one task."""
    maybe, sure = split_by_keys(found, keys, ["k1", "k2"])
    spread = maybe.withColumn("_salt", F.pmod(F.xxhash64("rid", "pos"), F.lit(SALTS)).cast("int"))
    each = keys.select("k1", "k2", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_salt"))
    return sure.union(spread.join(each.hint("merge"), ["k1", "k2", "_salt"], "left_anti").drop("_salt"))


def remove_spread_lines(docs: DataFrame, site: str = "source", min_sites: int = 8, min_words: int = 1, keep_first: bool = True, counts: tuple[str, str] = ("n_lines", "n_removed")) -> DataFrame:
    """``docs`` with ``text`` cleaned, and two longs beside its columns, named ``counts``: a text's lines, and those removed.

    Null texts stay null with 0 lines; empty texts have one line; blank lines and those of fewer than ``min_words``
    words are never removed. Without ``keep_first`` every occurrence goes. Rows that repeat id and text are treated
    alike; a null id comes first in no order but its own; an empty table gives no rows. Columns of ``docs`` of the names
    ``counts`` are replaced.
    """
    found = spread_lines(document_lines(docs, site, min_words), min_sites)
    marked = found.select("did", "rid", "pos", F.lit(False).alias("first"))
    if keep_first:
        order = F.struct((F.col("did") == _NO_ID).alias("last"), "did", "rid", "pos")
        firsts = found.groupBy("k1", "k2").agg(F.min(order).alias("f")).select("f.did", "f.rid", "f.pos", F.lit(True).alias("first"))
        marked = marked.union(firsts)
    # of a text's found lines those go that are no line's first occurrence
    gone = F.array_except(F.collect_set("pos"), F.collect_set(F.when(F.col("first"), F.col("pos"))))
    drops = cut(marked.groupBy("did", "rid").agg(gone.alias("_drops")).where(F.size("_drops") > 0), "line-drops")
    names = [c for c in docs.columns if c not in counts]
    flat = docs.select(*_row_key("doc_id"), F.struct(*(F.col(f"`{c}`") for c in names)).alias("_row"))
    maybe, whole = split_by_keys(flat, drops.select("did", "rid"), ["did", "rid"])
    lines = F.split(F.col("_row.text").cast("string"), "\n")
    n_lines = F.when(F.col("_row.text").isNull(), F.lit(0)).otherwise(F.size(lines)).cast("long").alias(counts[0])
    kept = F.array_join(F.filter(lines, lambda x, i: ~F.array_contains("_drops", i)), "\n")
    text = F.when(F.col("_drops").isNull(), F.col("_row.text")).otherwise(kept)
    cut_texts = maybe.join(drops.hint("merge"), ["did", "rid"], "left").select(
        *((text.alias("text") if c == "text" else F.col(f"_row.`{c}`").alias(c)) for c in names), n_lines, F.when(F.col("_drops").isNull(), F.lit(0)).otherwise(F.size("_drops")).cast("long").alias(counts[1])
    )
    return cut_texts.union(whole.select(*(F.col(f"_row.`{c}`").alias(c) for c in names), n_lines, F.lit(0).cast("long").alias(counts[1])))


def dedup_lines(docs: DataFrame, **how) -> DataFrame:
    """``docs`` with cleaned texts (``n_chars`` follows if present); rows of which nothing but blanks is left go.

    Null texts and texts without a removed line stay as they are, empty ones too; repeated rows and rows with a null id
    are treated as by :func:`remove_spread_lines`; an empty table gives no rows; columns of any name stay with their values.
    """
    removed = "_removed"
    while removed in docs.columns:
        removed += "_"
    out = remove_spread_lines(docs, counts=("_lines" + removed, removed), **how).where((F.col(removed) == 0) | (F.trim(F.translate("text", "\n\t\r\x0b\x0c", "     ")) != ""))
    if "n_chars" in docs.columns:
        kind = dict(docs.dtypes)["n_chars"]
        out = out.withColumn("n_chars", F.when(F.col(removed) > 0, F.length("text").cast(kind)).otherwise(F.col("n_chars")))
    return out.select(*(F.col(f"`{c}`") for c in docs.columns))


def spread_oracle(min_sites: int = 8, min_words: int = 1) -> str:
    """DuckDB SQL for ``doc_id, n_lines, n_removed, n_kept_chars, text_md5`` by exact distinct counts."""
    trimmed = "trim(translate(line, chr(9) || chr(13) || chr(11) || chr(12), '    '), ' ')"
    return f"""
    WITH d AS (SELECT row_number() OVER () AS r, doc_id, source, text, string_split(text, chr(10)) AS ls FROM documents),
    raw AS (SELECT r, doc_id, source, unnest(ls) AS line, generate_subscripts(ls, 1) AS pos FROM d),
    l AS (SELECT r, doc_id, source, pos, {trimmed} AS t FROM raw),
    w AS (SELECT * FROM l WHERE t <> '' AND len(regexp_split_to_array(t, ' +')) >= {min_words}),
    b AS (SELECT t FROM w GROUP BY t HAVING count(DISTINCT source) >= {min_sites}),
    f AS (SELECT w.*, row_number() OVER (PARTITION BY w.t ORDER BY doc_id, pos) AS nth FROM w JOIN b ON w.t = b.t),
    x AS (SELECT r, list(pos) AS gone FROM f WHERE nth > 1 GROUP BY r),
    o AS (SELECT d.doc_id, len(d.ls) AS n, coalesce(len(x.gone), 0) AS m,
                 CASE WHEN x.gone IS NULL THEN d.text
                      ELSE array_to_string([d.ls[i] FOR i IN range(1, len(d.ls) + 1) IF NOT list_contains(x.gone, i)], chr(10)) END AS kept
          FROM d LEFT JOIN x ON d.r = x.r)
    SELECT doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_lines, CAST(m AS BIGINT) AS n_removed,
           CAST(length(kept) AS BIGINT) AS n_kept_chars, md5(kept) AS text_md5 FROM o
    """
