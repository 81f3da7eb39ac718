"""The training-data operators on small tables: brute force, held-out accuracy, round trips, edge cases.

Every operator gets nulls, empty and long texts, repeated rows, an empty table and extra columns with clashing names.
"""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

pytest.importorskip("kontolith.llm")
public_tokenizers = pytest.importorskip("public_tokenizers")

from kontolith.llm import embedding_forest, line_spread, packing, page_diff, partenum, pseudo_likelihood, quality_rules, sentencepiece_lattice, toxicity, warc, words  # noqa: E402
from kontolith.llm.common import BoundedCache  # noqa: E402
from kontolith.llm.components import connected_components  # noqa: E402

WORD_BPE, PIECES = str(public_tokenizers.path("word_bpe_49k.json")), str(public_tokenizers.path("piece_bpe_32k.model"))
#: Extra columns whose names operators use inside.
CLASH = "sig long, rep long, n long, component string, _row string, rid long, did long, pos int, label int, kept string, score string, text_a string"


def documents(spark, texts, ids=None, sources=None):
    """A documents table with clashing extra columns."""
    rows = [(i if ids is None else ids[i], t, "s%d" % (i % 12) if sources is None else sources[i]) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    for col in CLASH.split(", "):
        name, kind = col.split()
        df = df.withColumn(name, F.lit(None).cast(kind))
    return df.withColumn("lang", F.lit("x")).withColumn("n_chars", F.length("text").cast("long"))


def prose(rng, n, vocabulary=400):
    return " ".join(f"w{x}" for x in rng.integers(0, vocabulary, n))


EDGES = [None, "", " \n\t ", "one", "a b c", "x" * 5000, "same words here again now", "same words here again now", "Ä ö\x0bü é́ 日本 🎉", "a b c d e f g " * 900]


# --- components ----------------------------------------------------------------------------------------------------


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (102, 101), (7, 7), (None, 3), (200, 150), (200, 150)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100, 102: 100, 150: 150, 200: 150}
    assert connected_components(spark.createDataFrame([], "u long, v long")).count() == 0


# --- words ---------------------------------------------------------------------------------------------------------


def test_word_hashes_in_small_blocks(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(words, "BLOCK", 64)
    rng = np.random.default_rng(1)
    rows = [*EDGES, *("".join(rng.choice(list("ab \n\tÄ"), rng.integers(0, 150))) for _ in range(150))]
    hashes, counts = words.WordHasher(lower=True)(pa.array(rows, pa.string()))
    seen, at = {}, 0
    for text, n in zip(rows, counts, strict=True):
        own = (text or "").encode().lower().split()
        assert len(own) == n
        for w, h in zip(own, hashes[at : at + n], strict=True):
            assert seen.setdefault(w, h) == h
        at += n
    assert len(set(seen.values())) == len(seen)


# --- 1 SentencePiece -----------------------------------------------------------------------------------------------


def test_sentencepiece_equals_library(spark):
    from sentencepiece import SentencePieceProcessor

    sp = SentencePieceProcessor(model_file=PIECES)
    texts = [*EDGES, "Hello  world\n x ", " ▁ y", *["The quick brown fox jumps over lazy dogs"] * 4]
    got = {r.doc_id: r for r in sentencepiece_lattice.encode_documents(documents(spark, texts), PIECES).collect()}
    for i, t in enumerate(texts):
        ids = np.frombuffer(bytes(got[i].ids), "<u4").tolist()
        assert ids == sp.encode(t or "") and got[i].n_ids == len(ids) and got[i].round_trip
        assert sentencepiece_lattice.decode(ids, sentencepiece_lattice.load_pieces(PIECES)) == sp.decode(ids)
    assert sentencepiece_lattice.encode_documents(documents(spark, ["x"]).where("false"), PIECES).count() == 0


def test_lattice_folds(spark):
    p = sentencepiece_lattice.load_pieces(PIECES)
    units = ["▁the", "▁international", "ing.", "▁▁▁x", "▁Straßenbahn"]
    df = spark.createDataFrame([(u,) for u in units], "unit string")
    for kind, fold in ((sentencepiece_lattice.BPE, sentencepiece_lattice.merge_fold), (sentencepiece_lattice.UNIGRAM, sentencepiece_lattice.viterbi_fold)):
        q = sentencepiece_lattice.load_pieces(PIECES, kind)
        got = {r.unit: list(r.ids) for r in sentencepiece_lattice.encode_units(df, q).collect()}
        for u in units:
            want = fold(u, p)
            if kind == sentencepiece_lattice.UNIGRAM:  # several segmentations may have the best score
                assert sum(p.scores[p.texts[i]] for i in got[u]) == pytest.approx(sum(p.scores[s] for s in want))
                assert "".join(p.texts[i] for i in got[u]) == u
            else:
                assert got[u] == [p.ids[s] for s in want]


# --- 2 LM scoring --------------------------------------------------------------------------------------------------


def test_pseudo_likelihood_prefers_the_corpus(spark):
    rng = np.random.default_rng(2)
    chain = lambda n: " ".join(f"t{(k * 7) % 30}" for k in range(int(rng.integers(0, 30)), int(rng.integers(40, 60)) + n))
    texts = [chain(30) for _ in range(200)] + [" ".join(rng.permutation(chain(60).split())) for _ in range(10)] + EDGES
    got = {r.doc_id: r for r in pseudo_likelihood.pseudo_likelihood(documents(spark, texts), n_classes=40, own=35).collect()}
    good, bad = [got[i].mean_log_prob for i in range(200)], [got[i].mean_log_prob for i in range(200, 210)]
    assert min(good) > max(bad)
    assert got[210].n_tokens == got[211].n_tokens == got[212].n_tokens == 0 and got[210].log_prob == 0 and got[210].mean_log_prob is None
    assert got[216].log_prob == got[217].log_prob and got[219].n_tokens == 6300
    assert pseudo_likelihood.pseudo_likelihood(documents(spark, ["x"]).where("false")).count() == 0


def test_window_counts_are_all_windows(spark):
    docs = documents(spark, ["a b a", "b", None, "a a"])
    counts = {r.word: r.n for r in pseudo_likelihood.word_counts(docs).collect()}
    assert sorted(counts.values()) == [2, 4]
    w = np.sort(np.array(list(counts), np.int64).view(np.uint64))
    got = {r.cell: r.n for r in pseudo_likelihood.window_counts(docs, w, np.array([0, 1]), 3).collect()}
    assert sum(got.values()) == 6 and len(got) == 6


def test_network_learns_counts():
    n = np.zeros((4, 4, 3))
    n[0, 1, 2], n[0, 2, 1], n[3, 3, 0], n[1, 0, 0] = 50, 40, 30, 20
    log_p, perplexity = pseudo_likelihood.train_network(n)
    assert perplexity < 1.1 and np.allclose(np.exp(log_p).sum(-1), 1)
    assert pseudo_likelihood.train_network(np.zeros((3, 3, 2)))[1] == 1.0


def test_rare_words_have_their_own_probability(spark):
    """Beyond the vocabulary too, a word is scored by its count."""
    texts = ["a b a b a b a b"] * 20 + ["b often a", "b seldom a"] + ["often"] * 6 + ["seldom"]
    docs = documents(spark, texts)
    model = pseudo_likelihood.fit(docs, vocabulary=2, n_classes=4, own=2, growth=0)
    got = {r.doc_id: r for r in pseudo_likelihood.score(docs, model).collect()}
    assert got[20].n_outside == got[21].n_outside == 1 and len(model.words) == 2
    assert abs(got[20].log_prob - got[21].log_prob - np.log(7 / 2)) < 1e-6
    c = model.n_classes - 1
    assert abs(got[22].log_prob - model.log_p[c + 1, c + 1, -1, -1, c] - np.log(7 / 9)) < 1e-6
    new = pseudo_likelihood.score(documents(spark, ["never"]), model).first()
    assert abs(new.log_prob - model.log_p[c + 1, c + 1, -1, -1, c] - np.log(1 / 9)) < 1e-6


def test_scores_equal_brute_force(spark):
    """Each token's window of two words a side, its class and its word, walked in plain Python."""
    from kontolith.llm.words import WordHasher

    rng = np.random.default_rng(4)
    texts = [" ".join(f"w{int(x)}" for x in rng.zipf(1.5, int(n)) if x < 300) for n in rng.integers(0, 40, 120)] + ["A b", "solo", None, ""]
    docs = documents(spark, texts)
    model = pseudo_likelihood.fit(docs, vocabulary=30, n_classes=12, own=6, growth=0)
    seen = [WordHasher(lower=True)(pa.array([x], pa.string()))[0].tolist() for x in texts]
    n = Counter(x for ws in seen for x in ws)
    place = {int(x): i for i, x in enumerate(model.words)}
    edge, last = model.n_classes, model.n_classes - 1
    of = lambda x: int(model.classes[place[x]]) if x in place else last
    outside = sum(k for x, k in n.items() if x not in place)
    of_class = Counter()
    for x, k in n.items():
        of_class[of(x)] += k
    assert outside and of_class[last] == outside
    windows = Counter()
    for r in pseudo_likelihood.score(docs, model).collect():
        c = [edge, edge] + [of(x) for x in seen[r.doc_id]] + [edge, edge]
        want = 0.0
        for i, x in enumerate(seen[r.doc_id], 2):
            at = c[i - 1], c[i + 1], int(model.groups[c[i - 2]]), int(model.groups[c[i + 2]]), c[i]
            windows[at] += 1
            want += float(model.log_p[at]) + np.log(n[x] / of_class[c[i]])
        assert abs(r.log_prob - want) < 1e-4 and r.n_tokens == len(seen[r.doc_id])
    shape = model.log_p.shape
    got = {np.unravel_index(r.cell, shape): r.n for r in pseudo_likelihood.window_counts(docs, model.words, model.classes, model.n_classes, model.groups).collect()}
    assert got == dict(windows) and np.allclose(np.exp(model.log_p).sum(-1), 1, atol=1e-4)


def test_company_and_clusters(spark):
    docs = documents(spark, ["a b a", "b c", None, ""])
    hashes = pseudo_likelihood.WordHasher(lower=True)(pa.array(["a b"]))[0]
    words = np.sort(hashes)
    a, b = (int(np.searchsorted(words, x)) for x in hashes)
    n = pseudo_likelihood.company(docs, words, np.array([0, 1]) if a == 0 else np.array([1, 0]), 3)  # a: class 0, b: 1, c: 2, edge: 3
    assert n[a].tolist() == [0, 1, 0, 1, 0, 1, 0, 1] and n[b].tolist() == [1, 0, 0, 1, 1, 0, 1, 0] and n[2].tolist() == [0, 1, 0, 0, 0, 0, 0, 1]
    rows = np.array([[9, 0, 0], [0, 8, 1], [90, 3, 0], [1, 70, 0], [0, 0, 50]])
    at = pseudo_likelihood.clustered(rows, 3)
    assert at[0] == at[2] and at[1] == at[3] and len(set(at)) == 3
    assert pseudo_likelihood.clustered(np.zeros((4, 3), int), 2).max() < 2


def test_both_sides_tell_more_than_one(spark):
    """Held-out documents: likelier than by word counts; the trained windows less perplexed than by their left sides alone."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1
    model = pseudo_likelihood.fit(docs.where(~held))
    total = pseudo_likelihood.score(docs.where(held), model).agg(F.sum("log_prob"), F.sum("n_tokens")).first()
    seen = pseudo_likelihood.word_counts(docs.where(~held))
    tokens = seen.agg(F.sum("n")).first()[0]
    new = pseudo_likelihood.word_counts(docs.where(held)).withColumnRenamed("n", "k").join(seen, "word", "left")
    by_count = new.agg(F.sum(F.col("k") * F.log(F.coalesce("n", F.lit(1)) / F.lit(tokens)))).first()[0]
    assert total[0] / total[1] > by_count / total[1] + 0.3
    cells = np.zeros(model.log_p.size, np.int64)
    for r in pseudo_likelihood.window_counts(docs.where(~held), model.words, model.classes, model.n_classes, model.groups).collect():
        cells[r.cell] = r.n
    left = cells.reshape(model.log_p.shape).sum((1, 3))
    assert model.perplexity < 0.95 * pseudo_likelihood.train_network(left)[1]


def test_tallies_in_bounded_memory(spark, monkeypatch):
    """Few slots and small rounds give the same counts, whatever must make room for what."""
    monkeypatch.setattr(pseudo_likelihood, "SLOTS", 32)
    rng, tally, want, got = np.random.default_rng(3), pseudo_likelihood.Tally(500), Counter(), Counter()
    for size in (0, 1, 300, 700, 50):
        x = rng.integers(0, 500, size)
        want.update(x.tolist())
        for cell, n in zip(*tally.add(*np.unique(x, return_counts=True))):
            got[int(cell)] += int(n)
    for cell, n in zip(*tally.rest()):
        got[int(cell)] += int(n)
    assert got == want and len(tally.n) == 32
    monkeypatch.setattr(pseudo_likelihood, "GATHERED", 64)
    table = spark.createDataFrame([(int(a), int(b)) for a, b in want.items()], "cell long, n long")
    cells, n = pseudo_likelihood._gathered(table, 500)
    assert cells.tolist() == sorted(want) and dict(zip(cells.tolist(), n.tolist())) == want
    assert [len(x) for x in pseudo_likelihood._gathered(table.where("false"), 500)] == [0, 0]


def test_network_answers_by_context(monkeypatch):
    rng = np.random.default_rng(4)
    n = rng.poisson(0.5, (5, 6, 3))
    whole, perplexity = pseudo_likelihood.train_network(n, rounds=5)
    monkeypatch.setattr(pseudo_likelihood, "SEEN", 7)
    parts, again = pseudo_likelihood.train_network(n, rounds=5)
    assert np.allclose(whole, parts, atol=1e-4) and abs(perplexity - again) < 1e-4
    cells = np.flatnonzero(n)
    net, _ = pseudo_likelihood.trained(cells, n.reshape(-1)[cells], (5, 6), 3, rounds=5)
    context, c = rng.integers(0, 30, 400), rng.integers(0, 3, 400)
    assert np.array_equal(net.log_of(context, c), parts.reshape(30, 3)[context, c]) and len(net.log_of(context[:0], c[:0])) == 0


def test_classes_and_vocabulary_grow(spark):
    assert pseudo_likelihood.grown(64, 40, 1000) == (64, 40) and pseudo_likelihood.grown(64, 40, 1 << 30) == (128, 80)
    docs = documents(spark, [" ".join(f"w{x} w{x}" for x in range(400))])
    assert len(pseudo_likelihood.fit(docs, vocabulary=10, n_classes=8, own=4).words) == 400


# --- 3 WARC --------------------------------------------------------------------------------------------------------


def test_archives_round_trip(spark):
    big, other = "<p>ü" + "x" * 1000, "y" * 1000
    rows = [(1, "http://a/1", big), (2, "http://a/2", big), (9, None, big), (3, "http://a\r\nb", "small"), (4, "u", "small"), (5, "u", None), (6, "u", ""), (7, "u", other), (7, "u", other), (None, "u", big), (8, "u", "z" * 400_000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit(1)).withColumn("first", F.lit("x")).withColumn("refers_to", F.lit(5))
    got = Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.archive_round_trip(pages).collect())
    want = Counter()
    for page, _, html in rows:
        body = (html or "").encode()
        first = {big: 9, other: 7}.get(html)
        refers = None if first is None or first == page else first
        want[(page, len(body), hashlib.sha1(body).hexdigest(), "response" if refers is None else "revisit", refers)] += 1
    assert got == want
    assert warc.archive_round_trip(pages.where("false")).count() == 0


def test_reader_finds_damage():
    good = warc.page_record(1, "http://a", b"body" * 400, None, "1970-01-01T00:00:00Z") + warc.page_record(2, None, b"", None, "1970-01-01T00:00:00Z")
    chunks = lambda data, n=7: (data[i : i + n] for i in range(0, len(data), n))
    records = list(warc.read_records(chunks(good)))
    assert [r.headers["warc-type"] for r in records] == ["response", "response"] and not any(r.problem for r in records)
    assert warc.http_parts(records[0].block)[1] == b"body" * 400
    with pytest.raises(EOFError):
        list(warc.read_records(chunks(good[:-9])))
    with pytest.raises(ValueError):
        list(warc.read_records(chunks(zlib.compress(b"WARC/1.1\r\nContent-Length: 9\r\n\r\nabc\r\n\r\n", wbits=31))))
    wrong = b"WARC/1.1\r\nWARC-Block-Digest: sha1:AAAA\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    assert next(warc.read_records(chunks(zlib.compress(wrong, wbits=31)))).problem


# --- 4 toxicity ----------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def toxic_tables(spark):
    rng = np.random.default_rng(4)
    texts, marks = [], []
    for i in range(1500):
        own = prose(rng, int(rng.integers(5, 120)), 900).split()
        bad = i % 8 == 0
        if bad:
            for _ in range(3):
                own.insert(int(rng.integers(0, len(own))), "Grubl" + rng.choice(["an", "heit", "ung", "o!"]))
        texts.append(" ".join(own))
        marks.append(int(bad))
    n = len(texts)
    docs = documents(spark, texts + EDGES)
    labels = spark.createDataFrame([(i, 1, m) for i, m in enumerate(marks) if i % 2 == 0] + [(None, 1, 1), (3, 1, None)], "doc_id long, quality int, toxic int")
    return docs, labels, marks, n


def test_toxicity_held_out(spark, toxic_tables):
    docs, labels, marks, n = toxic_tables
    got = {r.doc_id: r for r in toxicity.toxicity_scores(docs, labels).collect()}
    assert len(got) == n + len(EDGES)
    held = [i for i in range(n) if zlib.crc32(str(i).encode()) % 3 == 1]
    assert all(got[i].held_out == (i in set(held)) for i in range(n))
    bad, good = [got[i].score for i in held if marks[i]], [got[i].score for i in held if not marks[i]]
    assert np.mean(np.array(bad) >= 0.7) > 0.95 and np.mean(np.array(good) >= 0.7) < 0.02
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in got.values()) and got[n].score == got[n + 1].score


def test_toxicity_stage_and_no_labels(spark, toxic_tables):
    docs, labels, marks, n = toxic_tables
    kept = toxicity.keep_clean(docs, labels)
    assert kept.columns == docs.columns
    ids = {r.doc_id for r in kept.select("doc_id").collect()}
    assert sum(marks[i] for i in range(n) if i in ids) <= 10 and sum(1 - marks[i] for i in range(n) if i not in ids) <= 10
    assert {r.predicted for r in toxicity.toxicity_scores(docs, labels.where("toxic = 0")).collect()} == {0}
    assert toxicity.toxicity_scores(docs.where("false"), labels).count() == 0


def test_risk_stays_non_negative():
    x_p, x_u = [np.array([0])] * 50, [np.array([0])] * 10 + [np.array([1])] * 90
    w, b = toxicity.nn_pu_fit(x_p, x_u, 2, 0.1)
    assert w[0] + b > 1 and w[1] + b < -1


# --- 5 packing -----------------------------------------------------------------------------------------------------


def test_packing_places_every_piece(spark):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(WORD_BPE)
    rng = np.random.default_rng(5)
    texts = [*EDGES, *(prose(rng, int(n)) for n in rng.integers(1, 900, 60)), "don't STOP <|endoftext|> İstanbul ΣΑΣ", "word " * 6000]
    rows = packing.pack_documents(documents(spark, texts), WORD_BPE, group_pieces=20).collect()
    want = {}
    for i, x in enumerate(texts):
        ids = np.array([*t.encode(x or "", add_special_tokens=False).ids, 1], "<u4")
        for k, at in enumerate(range(0, len(ids), 4096)):
            want[i, k] = (at, len(ids[at : at + 4096]), zlib.crc32(ids[at : at + 4096].tobytes()))
    assert {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in rows} == want and len(rows) == len(want)
    bins = defaultdict(list)
    for r in rows:
        bins[r.sequence_id].append((r.offset, r.length))
    for places in bins.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 4096
    whole = packing.pack_documents(documents(spark, texts), WORD_BPE).agg(F.countDistinct("sequence_id"), F.sum("length")).first()
    assert whole[0] <= -(-whole[1] // 4096) + 1 and len(bins) <= whole[0] + 2
    assert packing.pack_documents(documents(spark, ["x"]).where("false"), WORD_BPE).count() == 0


@pytest.mark.parametrize("rule", ["norm", "dot"])
def test_every_constraint_holds(rule):
    rng = np.random.default_rng(6)
    lengths = rng.integers(1, 300, 400)
    bins, offsets = packing.best_fit(lengths, 512, 5, 60_000.0, rule=rule)
    for b in np.unique(bins):
        own = lengths[bins == b]
        assert own.sum() <= 512 and len(own) <= 5 and ((own**2).sum() <= 60_000 or len(own) == 1)
        assert sorted(offsets[bins == b]) == sorted(np.concatenate(([0], np.cumsum(own[np.argsort(offsets[bins == b])])[:-1])))
    assert len(packing.best_fit(np.empty(0, np.int64), 512, 5, 1.0)[0]) == 0


# --- 6 embeddings --------------------------------------------------------------------------------------------------


def test_embedding_links(spark):
    rng = np.random.default_rng(7)
    base = rng.normal(size=(300, 16))
    near = np.repeat(base[:30], 4, axis=0) + rng.normal(scale=0.12, size=(120, 16))
    x = np.concatenate([base, near, base[:3]])
    rows = [(i, v.astype(float).tolist()) for i, v in enumerate(x)] + [(900, None), (901, [0.0] * 16), (902, [float("nan")] * 16), (903, [None] * 16), (904, [1.0, 2.0]), (None, base[0].tolist()), (0, base[0].tolist())]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("label", F.lit(1)).withColumn("id", F.lit("z")).withColumn("v", F.lit(2)).withColumn("cell", F.lit(2))
    got = embedding_forest.embedding_classes(table, leaf=40, block=16)
    assert got.count() == len(rows)
    by = {r.vec_id: r for r in got.collect()}
    u = x / np.linalg.norm(x, axis=1)[:, None]
    near_ = u @ u.T >= 0.9
    np.fill_diagonal(near_, False)
    found, true = sum(by[i].n_links for i in range(len(x))), near_.sum()
    assert 0.95 * true <= found <= true and all(by[i].n_links <= near_[i].sum() for i in range(len(x)))
    assert all(by[i].n_links == 0 and by[i].kept for i in (900, 901, 902, 903, 904)) and by[None].component_id is None and not by[None].kept
    assert by[420].component_id == 0 and not by[420].kept
    assert embedding_forest.embedding_classes(table.where("false")).count() == 0


def test_embedding_links_of_all_lengths(spark):
    rows = [(i, [1.0, 2.0]) for i in range(3)] + [(i, [1.0, 2.0, float(i % 2)]) for i in range(10, 16)] + [(20, [2.0, 4.1]), (21, [9.0])]
    got = {r.vec_id: (r.n_links, r.component_id) for r in embedding_forest.embedding_classes(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert [got[i] for i in (0, 1, 2, 20, 21)] == [(3, 0), (3, 0), (3, 0), (3, 0), (0, 21)]
    assert all(got[i] == (5, 10) for i in range(10, 16))  # 5 / sqrt(5 * 6) is over 0.9


def test_dense_group_hands_on_no_pairs(spark):
    rng = np.random.default_rng(13)
    x = np.ones(24) + rng.normal(scale=0.1, size=(900, 24))
    df = spark.createDataFrame([(i, v.tolist(), 1) for i, v in enumerate(x)], "id long, v array<double>, n long")
    near = embedding_forest.near_counts(df, 0.9, 8, 64, 0.08, 300, 200, 3)
    u = x / np.linalg.norm(x, axis=1)[:, None]
    want = (u @ u.T >= 0.9).sum(1) - 1
    got = {r.id: r.links for r in near.groupBy("id").agg(F.sum("links").alias("links")).collect()}
    assert all(got[i] == want[i] for i in range(900)) and near.count() < 900 * 60


# --- 7 quality rules -----------------------------------------------------------------------------------------------


def brute_statistics(t):
    t = t or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    places = defaultdict(list)
    for k in range(len(w) - 4):
        places[tuple(w[k : k + 5])].append(k)
    covered = {k + i for v in places.values() if len(v) > 1 for k in v for i in range(5)}
    seen, doubles = set(), 0
    for line in t.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            doubles += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), doubles, len(covered)


def quality_tables(spark):
    rng = np.random.default_rng(8)
    texts = [prose(rng, 60) if i % 5 else " ".join(w + "%#" for w in prose(rng, 60).split()) for i in range(600)] + EDGES + ["a b\na b\n c\n c \n\n", "q w e r t y " * 3]
    labels = spark.createDataFrame([(i, int(i % 5 != 0), 0) for i in range(0, 600, 2)] + [(None, 0, 0), (2, None, 0)], "doc_id long, quality int, toxic int")
    return texts, documents(spark, texts), labels


def test_quality_statistics_and_rules(spark):
    texts, docs, labels = quality_tables(spark)
    got = {r.doc_id: r for r in quality_rules.quality_verdicts(docs, labels).collect()}
    for i, t in enumerate(texts):
        r, b = got[i], brute_statistics(t)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == b
        assert r.base_failed == (b[0] < 10 or 100 * b[4] > 20 * b[0]) and not (r.kept and r.base_failed)
    assert all(got[i].kept == (i % 5 != 0) for i in range(600))
    assert all(r.kept != r.base_failed for r in quality_rules.quality_verdicts(docs, labels.where("false")).collect())
    assert quality_rules.quality_verdicts(docs.where("false"), labels).count() == 0


def test_quality_stage(spark):
    texts, docs, labels = quality_tables(spark)
    kept = quality_rules.keep_good(docs, labels)
    verdict = {r.doc_id for r in quality_rules.quality_verdicts(docs, labels).where("kept").collect()}
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == verdict


# --- 8 Jaccard join ------------------------------------------------------------------------------------------------


def brute_classes(ids, texts, width, percent):
    sets = {}
    for i, t in zip(ids, texts, strict=True):
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[i] = {tuple(w[k : k + width]) for k in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set())
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    keys = list(sets)
    for k, a in enumerate(keys):
        for b in keys[k + 1 :]:
            common = len(sets[a] & sets[b])
            if common and 100 * common >= percent * (len(sets[a]) + len(sets[b]) - common):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return {i: (len(s), root(i)) for i, s in sets.items()}


@pytest.mark.parametrize(("width", "percent"), [(4, 85), (5, 80)])
def test_jaccard_classes_equal_brute_force(spark, width, percent):
    rng = np.random.default_rng(9)
    texts = list(EDGES)
    for n in (3, 6, 9, 14, 25, 60, 150, 400):
        for _ in range(4):
            base = prose(rng, n, 300).split()
            texts.append(" ".join(base))
            for edits in (0, 1, 2, max(1, n // 60), max(1, n // 30), max(1, n // 15)):
                own = list(base)
                for _ in range(edits):
                    own[int(rng.integers(0, n))] = f"e{rng.integers(0, 10**6)}"
                texts.append(" ".join(own).upper() if edits == 1 else "  ".join(own))
    order = rng.permutation(len(texts)).tolist()
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in partenum.jaccard_classes(documents(spark, texts, ids=order), width, percent).collect()}
    assert got == brute_classes(order, texts, width, percent)


@pytest.mark.parametrize("width", range(1, 7))
def test_sets_of_few_words(width):
    import pyarrow as pa

    for texts in ([], [None], [""], ["a"], ["a b"], ["a", None, "b"], ["a b c"], ["a b", "c d e f g h i j"], [" ".join("abcdefghij"[:n]) for n in range(11)]):
        sets = partenum.shingle_sets(pa.array(texts, pa.string()), width, words.WordHasher(lower=True))
        assert [len(s) for s in sets] == [max(min(1, n), n - width + 1) for n in (len((t or "").split()) for t in texts)]


@pytest.mark.parametrize("percent", [30, 50, 80, 85, 95])
def test_linked_sets_share_a_signature(percent):
    """Any pair that reaches the threshold is a candidate, at every size and in every hashing; unrelated small sets are not."""
    rng = np.random.default_rng(percent)
    for n in [*range(1, 40), 60, 150]:
        for _ in range(60):
            a = np.unique(rng.integers(0, 1 << 64, n, np.uint64) >> np.uint64(rng.integers(0, 60) if n < 12 else 0))
            m = int(rng.integers(0, len(a) * (100 - percent) // 100 + 2))
            b = np.unique(np.concatenate((a[rng.permutation(len(a))[min(m // 2, len(a) - 1) :]], rng.integers(0, 1 << 64, m - m // 2, np.uint64))))
            common = len(np.intersect1d(a, b))
            if common and 100 * common >= percent * (len(a) + len(b) - common) and not np.array_equal(a, b):
                (x, less_x), (y, less_y) = partenum.signatures(a, percent), partenum.signatures(b, percent)
                assert set(x[~less_x]) & set(y) or set(y[~less_y]) & set(x)
    seen = Counter(sig for _ in range(2000) for sig in set(partenum.signatures(np.sort(rng.integers(0, 1 << 64, int(rng.integers(1, 25)), np.uint64)), percent)[0].tolist()))
    assert max(seen.values(), default=0) <= 1


def test_short_documents_share_no_bucket(spark):
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.concat_ws(" ", *(F.hash("id", F.lit(k)) for k in range(5))).alias("text"))
    assert partenum.bucket_members(docs, 4, 85).count() == 0
    got = partenum.jaccard_classes(docs)
    assert got.where("doc_id = component_id and n_shingles = 2").count() == 4000


def test_jaccard_stage_repeats(spark):
    text = " ".join(f"u{i}" for i in range(40))
    docs = spark.createDataFrame([(4, text, "a"), (4, text, "b"), (4, "quite another text of it", "c"), (9, text + " more", "d"), (None, text, "e"), (7, None, "f"), (7, None, "g")], "doc_id long, text string, `a.b` string")
    kept = partenum.keep_one_each(docs, width=5, percent=80)
    assert kept.columns == docs.columns
    rows = sorted((r[0] or 0, r[1] or "") for r in kept.collect())
    assert rows == sorted([(4, text), (4, "quite another text of it"), (0, text), (7, ""), (7, "")])
    assert partenum.keep_one_each(docs.where("false")).count() == 0


def test_jaccard_odd_rows(spark):
    docs = documents(spark, ["a b c d e", "a b c d e", "p q r s t", "a b c d e", "p q r s t", None], ids=[5, 5, 5, None, 2, 2])
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in partenum.jaccard_classes(docs).collect()), key=str)
    assert got == sorted([(5, 2, 2), (5, 2, 2), (5, 2, 2), (None, 2, None), (2, 2, 2), (2, 0, 2)], key=str)
    assert partenum.jaccard_classes(docs.where("false")).count() == 0
    kept = partenum.keep_one_each(docs)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {2, None}


# --- 9 line dedup --------------------------------------------------------------------------------------------------


def line_docs(spark):
    boiler, rare = "this line stands on many sites", "this line stands on seven sites"
    texts = [f"own words of text number {i}\n{boiler}\n{boiler}  \nshort one" + (f"\n{rare}" if i < 7 else "") for i in range(24)]
    return [*texts, boiler, *EDGES], [f"s{i % 12}" for i in range(24)] + [None] + ["s0"] * len(EDGES)


def test_lines_equal_sql(spark):
    import duckdb

    texts, sources = line_docs(spark)
    docs = documents(spark, texts, sources=sources)
    out = line_spread.remove_spread_lines(docs)
    got = out.select("doc_id", "n_lines", "n_removed", F.length("text").cast("long").alias("n_kept_chars"), F.md5("text").alias("text_md5")).toPandas().sort_values("doc_id", ignore_index=True)
    documents_ = docs.select("doc_id", "text", "source").toPandas()
    c = duckdb.connect()
    c.register("documents", documents_)
    want = c.sql(line_spread.spread_oracle()).df().sort_values("doc_id", ignore_index=True)[got.columns]
    assert got.astype(object).where(got.notna(), None).values.tolist() == want.astype(object).where(want.notna(), None).values.tolist()
    assert got.n_removed.sum() == 48 + 23  # 24 * 2 + 1 occurrences and 24 of a short line, of which the first stays
    assert line_spread.remove_spread_lines(docs.where("false")).count() == 0


def test_line_plan_is_native(spark):
    texts, sources = line_docs(spark)
    plan = line_spread.remove_spread_lines(documents(spark, texts, sources=sources))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_line_stage(spark):
    texts, sources = line_docs(spark)
    docs = documents(spark, texts, sources=sources)
    kept = {r.doc_id: r for r in line_spread.dedup_lines(docs).collect()}
    assert 24 not in kept and kept[0].text.startswith("own words of text number 0\nthis line stands on many sites\nshort one") and kept[3].n_chars == len(kept[3].text)
    assert line_spread.dedup_lines(docs).columns == docs.columns and kept[25].text is None and kept[26].text == ""


def test_line_stage_takes_short_lines(spark):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    texts = [f"own text {i}\n\nAll rights reserved.\n Les.\t\nhere {i % 7}" for i in range(20)] + ["Les.", None, ""]
    docs = documents(spark, texts, sources=[f"s{i % 10}" for i in range(23)])
    kept = {r.doc_id: r.text for r in corpus_pipeline.lines(spark, docs, "").collect()}
    assert kept[0] == texts[0] and 20 not in kept and kept[21] is None and kept[22] == ""
    assert all(kept[i] == f"own text {i}\n\nhere {i % 7}" for i in range(1, 20))  # blank lines and lines on few sites stay


# --- 10 pages ------------------------------------------------------------------------------------------------------

PAGE = (
    "<!DOCTYPE html><html><head><title>T</title><script>var a='</p><p>';</script></head><body><nav><ul><li>Menu</li></ul></nav><header>Top</header><div class='ad'>Buy</div>"
    "<article><header><h1>Head &amp; more</h1></header><p>First\n  <b>bold</b> text<br>next<p>Second&nbsp;&lt;one&gt;<div class=\"cookie-notice\"><p>We use</p></div><form><label>Mail</label></form>"
    "<section id=comments><p>I like it</p></section><aside>Side</aside><!-- <p>no</p> --></article><footer>&copy; X</footer></body></html>"
)


def test_page_structure():
    assert page_diff.choose_lines(page_diff.page_lines(PAGE), set()) == "Head & more\nFirst bold text next\nSecond <one>"
    for odd in (None, "", "plain < text", "<p", "<script>never closed", "</div></p>", "<p>a</b>b</p>", "<article>" * 300 + "deep"):
        page_diff.page_lines(odd)
    assert page_diff.choose_lines(page_diff.page_lines("plain < text &amp; so"), set()) == "plain < text & so"


def test_common_lines_are_a_longest_common_subsequence():
    rng = np.random.default_rng(10)
    for _ in range(200):
        a, b = rng.integers(0, 5, rng.integers(0, 12)), rng.integers(0, 5, rng.integers(0, 12))
        i, j = page_diff.common_lines(a, b)
        assert (a[i] == b[j]).all() if i else True
        assert i == sorted(set(i)) and j == sorted(set(j))
        best = np.zeros((len(a) + 1, len(b) + 1), int)
        for x in range(len(a)):
            for y in range(len(b)):
                best[x + 1, y + 1] = best[x, y] + 1 if a[x] == b[y] else max(best[x, y + 1], best[x + 1, y])
        assert len(i) == best[-1, -1]


def test_differencing_removes_templates(spark):
    page = lambda body: f"<body><div>Home page of us</div><p>{body}</p><div>Call us now</div></body>"
    rows = [(1, "http://h/a/1", page("text one")), (2, "http://h/a/2", page("text two")), (3, "http://h/b/9", page("text three")), (4, "http://other/a", page("alone")), (5, None, page("no url")), (6, "http://h/c", None), (7, "http://x/1", PAGE), (8, "http://x/2", PAGE), (8, "http://x/2", PAGE), (None, "http://x/3", "")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("rid", F.lit(1)).withColumn("host", F.lit("q")).withColumn("lines", F.lit(1))
    got = [(r.page_id, r.text, r.n_chars) for r in page_diff.extract_text(pages).collect()]
    by = {k: t for k, t, _ in got}
    assert len(got) == len(rows) and all(n == len(t) for _, t, n in got)
    assert (by[1], by[2], by[3]) == ("text one", "text two", "text three")
    assert by[4] == "Home page of us\nalone\nCall us now" and by[6] == "" and by[None] == ""
    assert by[7] == by[8] == "Head & more\nFirst bold text next\nSecond <one>"  # copies of an article stay whole
    assert page_diff.extract_text(pages.where("false")).count() == 0


@pytest.mark.parametrize("tag", ["main", "div role=main", "div class=post", "section class='entry wide'", "div class='story'", "div id=main-content", "div class='main-content wide'"])
def test_copies_and_quotations_in_a_main_part_stay(spark, tag):
    page = lambda *body: f"<body><div>Home page of us</div><{tag}>{''.join(f'<p>{x}</p>' for x in body)}</{tag.split()[0]}><div>Call us now</div></body>"
    rows = [(1, "http://h/a/1", page("one", "two")), (2, "http://h/a/2", page("one", "two")), (3, "http://q/a/1", page("said", "three")), (4, "http://q/a/2", page("four", "said"))]
    got = {r.page_id: r for r in page_diff.extract_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert [got[i].text for i in (1, 2, 3, 4)] == ["one\ntwo", "one\ntwo", "said\nthree", "four\nsaid"]
    assert all(r.n_shared is None for r in got.values())


@pytest.mark.parametrize("part", ["article", "section class=story"])
def test_differencing_decides_between_parts(spark, part):
    """Every page is aligned: parts of which all is template go, the largest part and all parts with a line of their own stay."""
    block = lambda *lines: f"<{part}>{''.join(f'<p>{x}</p>' for x in lines)}</{part.split()[0]}>"
    page = lambda *parts: f"<body><div>Home page of us</div>{''.join(parts)}<footer>End</footer></body>"
    teaser, long = block("Read this too", "Now"), "a text of some length that is in three pages "
    rows = [(k, f"http://h/a/{k}", page(block(f"text {k} of some length", "said before"), teaser, block("Read this too", f"only {k}"))) for k in (1, 2, 3)]
    rows += [(k, f"http://q/a/{k}", page(block(long, long), block(f"other {k}"))) for k in (4, 5, 6)]  # near copies of one main text
    rows += [(k, f"http://z/a/{k}", page(block(f"text {k} of some length"), teaser)) for k in (7, 8)]  # one neighbour alone can't tell
    got = {r.page_id: r for r in page_diff.extract_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for k in (1, 2, 3):
        assert got[k].text == f"text {k} of some length\nsaid before\nRead this too\nonly {k}" and got[k].n_template == 6
    assert all(got[k].text == f"{long.strip()}\n{long.strip()}\nother {k}" and got[k].n_template == 0 for k in (4, 5, 6))
    assert all(got[k].text == f"text {k} of some length\nRead this too\nNow" for k in (7, 8))
    assert all(r.n_shared is None and r.n_chars == len(r.text) for r in got.values())


def test_alignment_of_many_equal_lines():
    """Linear memory: thousands of equal lines between others."""
    rng = np.random.default_rng(14)
    a, b = rng.integers(0, 2, 3000).tolist(), rng.integers(0, 2, 3000).tolist()
    i, j = page_diff.common_lines(a, b)
    assert [a[x] for x in i] == [b[x] for x in j] and i == sorted(set(i)) and j == sorted(set(j)) and len(i) > 2300


def brute_page_texts(pages):
    """Plain version of the extraction of pages without a main part: pairs by sorted path, LCS by table, votes."""
    def lcs(a, b):
        best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for x in range(len(a) - 1, -1, -1):
            for y in range(len(b) - 1, -1, -1):
                best[x][y] = 1 + best[x + 1][y + 1] if a[x] == b[y] else max(best[x + 1][y], best[x][y + 1])
        return best[0][0]

    out = {}
    hosts = defaultdict(list)
    for page, url, html in pages:
        host, _, path = url.removeprefix("http://").partition("/")
        hosts[host].append(("/" + path, page, re.findall("<p>(.*?)</p>", html)))
    for rows in hosts.values():
        rows.sort()
        for k, (path, page, lines) in enumerate(rows):
            near = []
            for step in (-2, -1, 1, 2):
                if 0 <= k + step < len(rows):
                    x, y = path.split("/"), rows[k + step][0].split("/")
                    run = next((n for n, (u, v) in enumerate(zip(x, y, strict=False)) if u != v), min(len(x), len(y)))
                    near.append((-run, abs(step), step, rows[k + step][2]))
            votes, telling = Counter(), 0
            for *_, other in sorted(near)[:3]:
                if lcs(lines, other) < len(lines):
                    telling += 1
                    votes.update(n for n, line in enumerate(lines) if line in other and lines.count(line) == 1)
            out[page] = "\n".join(line for n, line in enumerate(lines) if votes[n] < min(2, telling) or not votes[n])
    return out


def test_differencing_equals_brute_force(spark):
    """Pages without any telling element: templates go, copies and quotations stay."""
    rng = np.random.default_rng(15)
    rows, said = [], [f"quoted {i}" for i in range(4)]
    for h in range(5):
        top, end = [f"Home of {h}", "Offers", "About us"], [f"Imprint {h}", "All rights reserved"]
        for k in range((1, 2, 3, 9, 14)[h]):
            body = [f"line {h} {k} {i}" for i in range(int(rng.integers(1, 7)))] + ([said[k % 4]] if k % 5 == 0 else [])
            rows.append([h * 100 + k, f"http://h{h}/{'ab'[k % 2]}/{k:02d}", "".join(f"<div class=x{k}><p>{x}</p></div>" for x in top + body + end)])
    rows.append([950, "http://h4/a/00a", rows[-14][2]])  # a copy beside its original
    got = {r.page_id: r for r in page_diff.extract_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    want = brute_page_texts(rows)
    assert {i: r.text for i, r in got.items()} == want and sum(r.n_shared > 0 for r in got.values()) >= 28
    assert all(not re.search("Home|Offers|Imprint", got[i].text) for i in got if i >= 200) and got[950].text == got[400].text


def test_names_inside_an_article():
    lines = lambda *names: page_diff.choose_lines(page_diff.page_lines("<article><p>one</p>" + "".join(f"<p class='{x}'>{x}</p>" for x in names) + "</article>"), set())
    assert lines("related", "share-price", "alert", "promotion", "dialog") == "one\nrelated\nshare-price\nalert\npromotion\ndialog"
    assert lines("ad", "cookie-notice", "comments-section", "sidebar left", "Newsletter-Box") == "one"


# --- pipeline ------------------------------------------------------------------------------------------------------


def test_pipeline_stages(spark, tmp_path):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    rng = np.random.default_rng(11)
    base = [prose(rng, int(rng.integers(30, 120)), 900) for _ in range(300)]
    texts = [t + " Grubler Grublung Grublo" if i % 9 == 0 else " ".join(w + "%#" for w in t.split()) if i % 10 == 1 else t for i, t in enumerate(base)] + [base[2], base[3] + " more", None, "", "few words"]
    docs = documents(spark, texts).select("doc_id", "text", "lang", "source", "n_chars")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, int(i % 10 != 1), int(i % 9 == 0)) for i in range(300)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    now = spark.read.parquet(f"{tmp_path}/documents.parquet")
    clean = {i for i in range(300) if i % 9 and i % 10 != 1}
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, now, str(tmp_path))
        if k < 4:
            assert out.columns == docs.columns
            ids = {r.doc_id for r in out.select("doc_id").collect()}
            assert clean <= ids
        out.write.parquet(f"{tmp_path}/{k}")
        now = spark.read.parquet(f"{tmp_path}/{k}")
    assert {300, 301, 302, 303, 304}.isdisjoint(ids) and ids == clean
    assert {r.doc_id for r in now.collect()} == clean and corpus_pipeline.run(spark, str(tmp_path)).count() == now.count()


def test_stages_take_any_bytes(spark, tmp_path):
    """Texts that are not UTF-8 (cut within a character, say) pass every stage and count as with U+FFFD in their place."""
    import pyarrow.parquet as pq

    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    rng = np.random.default_rng(16)
    texts = [(prose(rng, 60, 900) + " Grubler Grublung Grublo" * (i % 9 == 0)).encode() for i in range(200)]
    texts[:4] = [b"\xff\xfe " + texts[0], texts[1] + b" cut \xe2\x82", b"\xed\xa0\x80 " + texts[2], None]
    for name, column in (("raw", pa.array(texts, pa.binary()).view(pa.string())), ("clean", pa.array([t if t is None else t.decode("utf-8", "replace") for t in texts]))):
        (tmp_path / name).mkdir()
        pq.write_table(pa.table({"doc_id": range(200), "text": column, "source": ["s"] * 200}), f"{tmp_path}/{name}/documents.parquet")
        pq.write_table(pa.table({"doc_id": range(200), "quality": [1] * 200, "toxic": [int(i % 9 == 0) for i in range(200)]}), f"{tmp_path}/{name}/labels.parquet")
    raw, clean = (spark.read.parquet(f"{tmp_path}/{name}/documents.parquet") for name in ("raw", "clean"))
    score = lambda docs, name: {tuple(r) for r in toxicity.toxicity_scores(docs, spark.read.parquet(f"{tmp_path}/{name}/labels.parquet")).collect()}
    assert score(raw, "raw") == score(clean, "clean")
    pieces = lambda docs: {tuple(r) for r in packing.token_pieces(docs, WORD_BPE).drop("salt").collect()}
    assert pieces(raw) == pieces(clean)
    assert {0, 3}.isdisjoint(kept := {r.doc_id for r in corpus_pipeline.run(spark, f"{tmp_path}/raw").collect()}) and {1, 2} <= kept


def test_most_frequent_is_bounded(spark):
    from kontolith.llm.common import most_frequent

    df = spark.createDataFrame([(i, n) for i, n in enumerate([1] * 50 + [2] * 10 + [100, 90, 7])], "w int, n long")
    top = lambda d, most: d.where(most_frequent(d, "w", "n", most))
    assert {100, 90, 7} <= {r.n for r in top(df, 8).collect()} <= {100, 90, 7, 2} and top(df, 100).count() == 63
    many = spark.range(60_000).select(F.col("id").alias("w"), F.lit(3).cast("long").alias("n"))
    assert 1800 < top(many, 2000).count() < 2200 and top(df.where("false"), 5).count() == 0


def test_hot_join_equals_join(spark):
    from kontolith.llm.common import hot_join

    rng = np.random.default_rng(12)
    left = spark.createDataFrame([(int(k) if k < 300 else 7, int(k) % 3, i) for i, k in enumerate(rng.integers(0, 900, 4000))], "k long, m long, i long")
    right = left.where("k % 5 <> 1").groupBy("k", "m").agg(F.count("*").alias("n"), F.max("i").alias("top")).withColumn("more", F.col("top") * 2)
    want = left.join(right, ["k", "m"]).select("k", "m", "i", "top", "more")
    got = hot_join(left, right, ["k", "m"], "n", ["top", "more"])
    assert got.columns == want.columns and sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and got.count() > 2000
    assert hot_join(left, right.where("false"), ["k", "m"], "n", ["top", "more"]).count() == 0


def test_split_by_keys(spark):
    from kontolith.llm.common import split_by_keys

    rows = spark.createDataFrame([(i % 500, "x") for i in range(1000)] + [(None, "y")], "id long, t string")
    maybe, sure = split_by_keys(rows, spark.range(0, 500, 5), ["id"])
    a, b = [r.id for r in maybe.collect()], [r.id for r in sure.collect()]
    assert len(a) + len(b) == 1001 and set(range(0, 500, 5)) <= set(a) and not set(range(0, 500, 5)) & set(b) and len(b) > 750
    assert split_by_keys(rows, spark.range(0), ["id"])[1].where("id is not null").count() == 1000


def test_risk_without_features():
    none = np.empty(0, np.int64)
    w, b = toxicity.nn_pu_fit([none] * 3, [none] * 9, 0, 0.2)
    assert len(w) == 0 and np.isfinite(b)


def test_toxicity_memory_of_long_texts():
    import tracemalloc

    text = " ".join("Wort%d" % i for i in range(600_000)) + "\u2003Ende"
    tracemalloc.start()
    found = toxicity.text_features(text, BoundedCache(lambda w: (int(w[4:]),) if w[4:] in ("7", "300000", "599999") else (-1,) if w == "ende" else (), 1000))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert found == {7, 300_000, 599_999, -1}
    assert peak < 2 * len(text)


def test_toxicity_features_in_blocks(monkeypatch):
    text, cache = "Eins ZWEI drei\u00a0vierundzwanzig " * 9 + "x" * 400 + "\nfuenf", BoundedCache(toxicity.word_features)
    whole = toxicity.text_features(text, cache)
    monkeypatch.setattr(toxicity, "BLOCK", 10)
    assert toxicity.text_features(text, cache) == whole and toxicity.feature_array(text, cache).tolist() == sorted(whole)
    assert toxicity.text_features(None, cache) == set() == set(toxicity.feature_array("", cache))
    wanted, rows = np.array([2, 5, 9, 4_000_000_000]), [[5, 1, 9], None, [], [4_000_000_000, 4_000_000_001], [2]]
    listed = pa.array(rows, pa.list_(pa.int64()))
    want = [[1, 2], [], [], [3], [0]]
    assert toxicity.numbers_of(listed, wanted).to_pylist() == want and toxicity.numbers_of(listed.slice(2), wanted).to_pylist() == want[2:]
    assert toxicity.numbers_of(listed, wanted[:0]).to_pylist() == [[]] * 5
