"""Main text of web pages by nearest-URL page differencing and structure (operator 10).

Every page becomes a sequence of text lines, one per block element, each with its place in the page's structure. Pages of
a host are ordered by URL path; each is paired with its nearest neighbours, those that share most leading path segments,
and their line sequences (as hashes) are aligned by longest common subsequence, on every page. A line that is shared with two
neighbours (with one, if there is but one) is template text and is deleted; neighbours that are copies tell nothing.
The main text of a page, its largest recognised article or main part, is kept, shared or not: copies and quotations must
stay whole. Of other articles or main parts of the page, those go of which every line is template (teasers, for one).
Menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles and comments go by their elements and names.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter

import numpy as np

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kontolith.llm.common import cut, map_batches, split_by_keys

#: HTML element names by their role here.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul".split())
GONE = frozenset("head nav aside form footer script style noscript template button select textarea iframe svg canvas object dialog search menu title".split())
CLOSES_P = BLOCK - frozenset("body html head option optgroup".split())
#: Words in class, id and role names that mark what is not the article.
GONE_NAMES = frozenset(
    "ad ads adbox adslot advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices popup modal overlay newsletter subscribe subscription "
    "sidebar sidebars sidenav menu menus nav navbar navigation breadcrumb breadcrumbs footer masthead comment comments commentlist disqus reply replies respond discussion related recommended recommendations share sharing social "
    "pagination pager widget widgets toolbar copyright login signup search alert contentinfo complementary dialog".split()
)
#: Of these, what goes inside a recognised article too; a name may be joined with words that only tell its place.
INSIDE_NAMES = frozenset(
    "ad ads adbox adslot advert adverts advertisement advertising sponsor sponsored cookie cookies consent gdpr notice notices popup modal overlay newsletter subscribe subscription "
    "sidebar sidebars sidenav menu menus nav navbar navigation breadcrumb breadcrumbs footer comment comments commentlist disqus reply replies respond pagination pager login signup complementary".split()
)
PLACE_WORDS = frozenset("list section box area wrapper container block item thread body inner bar slot unit row top bottom left right".split())
HEADER_NAMES = frozenset("header topbar".split())
ARTICLE_NAMES = frozenset("articlebody article post entry story maincontent main-content main_content".split())

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|[^<]+|<", re.S)
_ATTR = re.compile(r"(class|id|role|itemprop|hidden|aria-hidden|style)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)
_PART = re.compile(r"[a-z]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")


def _goes_inside(name: str) -> bool:
    parts = set(_PART.findall(name))
    return bool(parts & INSIDE_NAMES) and parts <= INSIDE_NAMES | PLACE_WORDS


def _attributes(text: str) -> tuple[frozenset[str], bool, str]:
    """Words of class, id, role and itemprop, and their whole names; whether the element is hidden; the role."""
    words, hidden, role = [], False, ""
    for m in _ATTR.finditer(text):
        name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if name == "hidden" or name == "aria-hidden" and value.lower() == "true" or name == "style" and re.search(r"display\s*:\s*none", value, re.I):
            hidden = True
        elif name in ("class", "id", "role", "itemprop"):
            words += _PART.findall(_CAMEL.sub(" ", value).lower()) + value.lower().split()
            role = value.lower() if name == "role" else role
    return frozenset(words), hidden, role


def page_lines(html: str | None) -> list[tuple[str, int, bool, int]]:
    """``(line, zone, gone, part)`` per non-empty block: zone 2 inside an article, 1 inside a main part, 0 elsewhere; the
    number of that article or main part on the page, from 1, else 0."""
    out: list[tuple[str, int, bool, int]] = []
    stack: list[tuple[str, int, bool, int]] = []  # name, zone, gone, part
    held: list[str] = []
    zone, gone, part, parts = 0, False, 0, 0

    def flush():
        if held:
            line = " ".join(entities.unescape("".join(held)).split())
            held.clear()
            if line:
                out.append((line, zone, gone, part))

    text = html or ""
    pos, n = 0, len(text)
    while pos < n:
        m = _TOKEN.match(text, pos)
        pos = m.end()
        name = m[2]
        if name is None:
            if m[0][0] != "<" or len(m[0]) == 1:
                held.append(m[0])
            continue
        name = name.lower()
        if m[1]:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == name:
                    if any(x[0] in BLOCK for x in stack[k:]) or name in GONE:
                        flush()
                    del stack[k:]
                    zone, gone, part = stack[-1][1:] if stack else (0, False, 0)
                    break
                if name not in BLOCK and stack[k][0] in BLOCK and stack[k][0] != "p":
                    break  # an inline end tag doesn't close a block
            continue
        if name in RAW:
            end = re.compile(rf"</{re.escape(name)}(?=[\s/>])", re.I).search(text, pos)
            stop = text.find(">", end.end()) if end else -1
            pos = stop + 1 if stop >= 0 else n
            continue
        if name == "br":
            held.append(" ")
            continue
        if name in BLOCK:
            flush()
            if name in CLOSES_P:
                for k in range(len(stack) - 1, -1, -1):
                    if stack[k][0] == "p" or name == stack[k][0] == "li":
                        del stack[k:]
                        zone, gone, part = stack[-1][1:] if stack else (0, False, 0)
                        break
                    if stack[k][0] in BLOCK:
                        break
        if name in VOID or m[3].endswith("/"):
            continue
        words, hidden, role = _attributes(m[3]) if m[3] else (frozenset(), False, "")
        z, g = zone, gone
        if name not in ("html", "body"):
            named = any(map(_goes_inside, words)) if zone else bool(words & GONE_NAMES)
            g = g or name in GONE or hidden or named and name not in ("article", "main") or name == "article" and bool(words & {"comment", "comments", "reply", "ad", "advert", "sponsored", "related", "promo"})
            if not zone and (name == "header" or words & HEADER_NAMES or role == "banner"):
                g = True
            if not g:
                if name == "article" or "articlebody" in words:
                    z = 2
                elif name == "main" or role == "main" or name in ("div", "section") and words & ARTICLE_NAMES and not words & {"list", "meta", "info"}:
                    z = max(z, 1)
        if g and not gone:
            flush()
        if z > zone:
            parts += 1
            part = parts
        stack.append((name, z, g, part))
        zone, gone = z, g
    flush()
    return out


def _prefix_lengths(a: list, b: list) -> np.ndarray:
    """Lengths of the longest common subsequences of ``a`` and every beginning of ``b``, by one wide integer a row."""
    n = len(b)
    where: dict = {}
    for j, x in enumerate(b):
        where.setdefault(x, []).append(j)
    often = {x: sum(1 << j for j in at) for x, at in where.items() if len(at) >= 64}  # so n / 64 integers of n bits at most
    full = (1 << n) - 1
    row = full
    for x in a:
        at = where.get(x)
        if at is None:
            continue
        match = often.get(x) or sum(1 << j for j in at)
        up = row & match
        row = ((row + up) | (row - up)) & full
    bits = np.unpackbits(np.frombuffer(row.to_bytes(n // 8 + 1, "little"), np.uint8), bitorder="little")[:n]
    return np.concatenate(([0], np.cumsum(1 - bits.astype(np.int64))))


def _aligned(a: list, b: list, i: int, j: int, out: list[tuple[int, int]]) -> None:
    """Append pairs of positions (from ``i`` and ``j``) of a longest common subsequence, by halving ``a``; memory is linear."""
    if not a or not b:
        return
    if len(a) == 1:
        if a[0] in b:
            out.append((i, j + b.index(a[0])))
        return
    mid = len(a) // 2
    both = _prefix_lengths(a[:mid], b) + _prefix_lengths(a[mid:][::-1], b[::-1])[::-1]
    at = int(np.argmax(both))
    _aligned(a[:mid], b[:at], i, j, out)
    _aligned(a[mid:], b[at:], i + mid, j + at, out)


def common_lines(a: list[int], b: list[int]) -> tuple[list[int], list[int]]:
    """Positions of a longest common subsequence of two hash sequences.

    Memory is linear in the lines, time their product over the word size; lines that only one page has cost nothing.
    """
    a, b = list(a), list(b)
    lead = 0
    while lead < min(len(a), len(b)) and a[lead] == b[lead]:
        lead += 1
    tail = 0
    while tail < min(len(a), len(b)) - lead and a[-1 - tail] == b[-1 - tail]:
        tail += 1
    both = set(a[lead : len(a) - tail]) & set(b[lead : len(b) - tail])
    at_a = [i for i in range(lead, len(a) - tail) if a[i] in both]
    at_b = [j for j in range(lead, len(b) - tail) if b[j] in both]
    mid: list[tuple[int, int]] = []
    _aligned([a[i] for i in at_a], [b[j] for j in at_b], 0, 0, mid)
    pairs = [(i, i) for i in range(lead)] + [(at_a[i], at_b[j]) for i, j in mid] + [(len(a) - t, len(b) - t) for t in range(tail, 0, -1)]
    return [i for i, _ in pairs], [j for _, j in pairs]


def candidates(lines: list[tuple[str, int, bool, int]]) -> tuple[list[str], list[int], list[int], list[int]]:
    """What structure leaves of a page: its articles' lines, without one its main parts', without both all that isn't gone.

    The lines' texts, positions and parts; and the positions that make up the main text (the part of most characters, of
    equal ones the first), without a part none.
    """
    best = max((z for _, z, gone, _ in lines if not gone), default=0)
    texts, places, parts, size = [], [], [], Counter()
    for k, (text, zone, gone, part) in enumerate(lines):
        if not gone and zone >= best:
            texts.append(text)
            places.append(k)
            parts.append(part)
            size[part] += len(text)
    core = max(size, key=lambda p: (size[p], -p)) if best else None
    return texts, places, parts, [k for k, p in zip(places, parts, strict=True) if p == core]


def _parsed(pages: DataFrame) -> DataFrame:
    """Per page the hashes of all its lines, and its :func:`candidates`."""

    def make():
        def step(batch: pa.RecordBatch):
            hashes, found = [], []
            for html in batch.column(5).to_pylist():
                own = page_lines(html)
                hashes.append([xxhash.xxh3_64_intdigest(x[0]) - (1 << 63) for x in own])
                found.append(candidates(own))
            texts, *numbers = zip(*found, strict=True) if found else [()] * 4
            cols = [*batch.columns[:5], pa.array(hashes, pa.list_(pa.int64())), pa.array(texts, pa.list_(pa.string())), *(pa.array(x, pa.list_(pa.int32())) for x in numbers)]
            return pa.RecordBatch.from_arrays(cols, ["page_id", "url", "rid", "host", "path", "hashes", "lines", "places", "parts", "core"])

        return step

    schema = "page_id long, url string, rid long, host string, path string, hashes array<long>, lines array<string>, places array<int>, parts array<int>, core array<int>"
    return map_batches(pages.select("page_id", "url", "rid", "host", "path", "html"), make, schema)


def neighbours(slim: DataFrame, most: int = 3) -> DataFrame:
    """``(rid, mates)``: of the two pages before and the two after a page in its host's path order, the ``most`` that
    share most leading path segments (ties: the closer, then the earlier).

    Places in the order are numbered by ranges of (host, path, rid), and pages meet by those numbers, so a host of any
    size spreads over tasks.
    """
    ranked = slim.select("host", "path", "rid").where("host is not null").distinct().orderBy("host", "path", "rid")
    ordered = cut(ranked.select("*", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("seq")), "page-order")
    ends = ordered.groupBy("part").agg(F.count("*").alias("n"), F.min("seq").alias("from"))  # a row per range
    before = ends.select("part", "from", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    placed = ordered.join(F.broadcast(before), "part").select("host", "path", "rid", (F.col("before") + F.col("seq") - F.col("from")).alias("at"))
    others = placed.select(F.col("host").alias("host_"), F.col("path").alias("path_"), F.col("rid").alias("mate"), F.col("at").alias("there"))
    near = placed.withColumn("step", F.explode(F.array(*map(F.lit, (-2, -1, 1, 2))))).withColumn("there", F.col("at") + F.col("step")).join(others, "there").where("host = host_")
    mine, yours = F.split("path", "/"), F.split("path_", "/")
    size = F.least(F.size(mine), F.size(yours))
    same = F.zip_with(F.slice(mine, 1, size), F.slice(yours, 1, size), lambda x, y: (x == y).cast("int"))
    run = F.aggregate(same, F.struct(F.lit(0).alias("n"), F.lit(1).alias("on")), lambda acc, x: F.struct((acc["n"] + acc["on"] * x).alias("n"), (acc["on"] * x).alias("on")))
    order = F.struct((-run["n"]).alias("score"), F.abs("step").alias("far"), "step", "mate")
    return near.groupBy("rid").agg(F.transform(F.slice(F.sort_array(F.collect_list(order)), 1, most), lambda x: x["mate"]).alias("mates"))


def template_lines(own: list[int], others: list[list[int]], core: list[int] | None = None) -> list[int]:
    """Positions of ``own``'s lines that longest common subsequences share with two of ``others``, or with the only one.

    Others that share all lines of ``own`` are copies and tell nothing. If the main text's positions ``core`` are known,
    others that share all of these are copies, and the only one that tells is not enough.
    """
    votes, telling = Counter(), 0
    for other in others:
        shared = common_lines(own, other)[0]
        if not set(shared).issuperset(core or range(len(own))):
            telling += 1
            votes.update(shared)
    return sorted(k for k, n in votes.items() if n >= (2 if core else min(2, telling)))


def shared_positions(slim: DataFrame, mates: DataFrame) -> DataFrame:
    """``(rid, shared)``: positions of a page's template lines by its mates, for every page that has such lines."""
    lines = slim.select("rid", "hashes", "core").dropDuplicates(["rid"])
    pairs = mates.select("rid", F.explode("mates").alias("mate")).join(lines.select(F.col("rid").alias("mate"), F.col("hashes").alias("other")), "mate")
    groups = pairs.groupBy("rid").agg(F.sort_array(F.collect_list("other")).alias("others")).join(lines, "rid")  # three others at most

    def make():
        def step(batch: pa.RecordBatch):
            found = [template_lines(*x) for x in zip(*(c.to_pylist() for c in batch.columns[1:]), strict=True)]
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.int32()))], ["rid", "shared"])

        return step

    return map_batches(groups.select("rid", "hashes", "others", "core"), make, "rid long, shared array<int>").where(F.size("shared") > 0)


def kept_lines(places: list[int], parts: list[int], core: list[int], shared: set[int]) -> list[int]:
    """Which candidates are the page's text: those that aren't template lines; with a main text, it and each other part of which a line isn't."""
    if not core:
        return [k for k, at in enumerate(places) if at not in shared]
    own = {p for at, p in zip(places, parts, strict=True) if at not in shared or at == core[0]}
    return [k for k, p in enumerate(parts) if p in own]


def choose_lines(lines: list[tuple[str, int, bool, int]], shared: set[int]) -> str:
    """A page's text: its candidates by structure less what its template lines ``shared`` take away."""
    texts, *numbers = candidates(lines)
    return "\n".join(texts[k] for k in kept_lines(*numbers, shared))


def _less_template(pages: DataFrame) -> DataFrame:
    """``page_id, url, text`` of pages with their template lines ``shared``, and how many these are."""

    def make():
        def step(batch: pa.RecordBatch):
            texts, places, parts, cores, shared = (c.to_pylist() for c in batch.columns[2:])
            left = ["\n".join(t[k] for k in kept_lines(*numbers, set(gone))) for t, *numbers, gone in zip(texts, places, parts, cores, shared, strict=True)]
            return pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(left, pa.string()), pa.array([not x for x in cores], pa.bool_()), pa.array(map(len, shared), pa.int64())], ["page_id", "url", "text", "open", "n_template"])

        return step

    whole = pages.select("page_id", "url", "lines", "places", "parts", "core", F.coalesce("shared", F.array().cast("array<int>")))
    return map_batches(whole, make, "page_id long, url string, text string, open boolean, n_template long")


def extract_text(pages: DataFrame) -> DataFrame:
    """``page_id, url, text, n_chars, n_shared, n_template`` per row of ``pages`` (``page_id, url, html``; other columns are ignored).

    Every page is aligned with its neighbours; structure says where the template lines that this finds are text all the
    same. Null html is empty and gives an empty text. Pages without a host (null or odd urls) have no mates and keep all
    lines that structure leaves. Rows that repeat are extracted each; very long pages are parsed and aligned whole; an
    empty table gives no rows. ``n_template`` counts a page's template lines, wherever they are; ``n_shared`` too, but it
    is null for pages with a main text, in which they stay.
    """
    host = F.lower(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1))
    path = F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    keyed = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    keyed = keyed.withColumn("rid", F.xxhash64("page_id", "url", "html")).withColumn("host", F.when(host != "", host)).withColumn("path", path)
    parsed = cut(_parsed(keyed), "page-lines", 500)  # each page is parsed once
    marks = cut(shared_positions(parsed, neighbours(parsed)), "shared-lines", 500)
    maybe, clean = split_by_keys(parsed, marks, ["rid"])  # only pages with template lines are shuffled
    marked = _less_template(maybe.join(marks.hint("merge"), "rid", "left"))
    whole = clean.select("page_id", "url", F.array_join("lines", "\n").alias("text"), (F.size("core") == 0).alias("open"), F.lit(0).cast("long").alias("n_template"))
    return marked.union(whole).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"), F.when(F.col("open"), F.col("n_template")).alias("n_shared"), "n_template")
