"""Operators over the whole corpus: near duplicates, repeats, packing, mixing, neighbours, chats, the pipeline."""

import random
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from glacierlens.llm import ann, chat, components, mixing, neardup, packing, queries, recompress, tokens, words
from tests.llm import brute
from tests.oracle import compare, connect


def unique_ids(docs):
    """One text for each id, as the plain versions need it."""
    return dict(docs.where("doc_id is not null").select("doc_id", "text").collect())


@pytest.mark.parametrize("table", ["awkward", "documents"])
def test_near_duplicates(request, table):
    docs = request.getfixturevalue(table)
    texts = unique_ids(docs)
    comps, sizes = brute.components(list(texts.items()))
    rows = neardup.link(docs).collect()
    assert len(rows) == docs.count()
    for r in rows:
        if r.doc_id is None:
            assert r.component_id is None and r.kept
        else:
            assert (r.n_shingles, r.component_id) == (sizes[r.doc_id], comps[r.doc_id])
            assert r.kept == (r.doc_id == r.component_id)


def test_near_duplicates_of_nothing(nothing):
    assert neardup.link(nothing).count() == 0


def test_long_words_of_few_letters(spark):
    """The Thue-Morse word of two letters and its complement are two words, whatever their length."""
    for size in (8, 64, 1024, 1 << 14):
        bits = [bin(i).count("1") % 2 for i in range(size)]
        one, two = ("".join("ab"[x ^ turn] for x in bits) for turn in (0, 1))
        prints = words.fingerprints(f"{one} {two} {one}".encode())[2]
        assert prints[0] == prints[2] != prints[1]
    ends = [" ".join(["w"] * 6 + [w] + ["v"] * 6) for w in (one, two)]
    docs = spark.createDataFrame(list(enumerate(ends)), "doc_id long, text string")
    assert [r.n_removed for r in recompress.remove_repeats(docs).orderBy("doc_id").collect()] == [0, 0]


def test_repeated_ids_with_different_texts(spark):
    """Each text of a repeated id is judged by itself, and the pipeline keeps one row of each."""
    rnd = random.Random(5)
    a, b = ([f"{w}{rnd.randrange(10**6)}" for _ in range(120)] for w in "ab")
    near_a, near_b = (x[:60] + ["changed"] + x[61:] for x in (a, b))
    rows = [(1, a), (1, b), (2, near_a), (3, near_b), (1, b), (None, a)]
    docs = spark.createDataFrame([(i, " ".join(t), "en", "src1", 5) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    assert {(r.doc_id, r.component_id) for r in neardup.link(docs).collect()} == {(1, 1), (2, 1), (3, 1), (None, None)}
    kept = dict(corpus_pipeline.STAGES)["near_duplicates"](spark, docs, "").collect()
    assert sorted((r.doc_id or 0, r.text[0]) for r in kept) == [(0, "a"), (1, "a"), (1, "b")]


def test_a_round_has_no_more_pairs_than_members(spark):
    rnd = random.Random(2)
    base = [f"word{i}" for i in range(150)]
    texts = []
    for i in range(300):
        own = list(base)
        for at in rnd.sample(range(150), 3):
            own[at] = f"other{i}x{at}"
        texts.append((i, " ".join(own)))
    drawn = neardup.sketches(spark.createDataFrame(texts, "doc_id long, text string"))
    placed = drawn.select(F.col("doc_id").alias("node"), F.col("doc_id").alias("id"), F.col("n_shingles").alias("n"), F.explode("bands").alias("key"), F.col("doc_id").alias("comp"))
    pairs, _ = neardup._stars(placed, 0)
    assert 200 < pairs.count() <= 300


def test_near_duplicates_in_a_large_group(spark):
    """Variants of one text, whose pairs lie on both sides of the limit."""
    rnd = random.Random(9)
    base = [f"word{i}" for i in range(150)]
    texts = []
    for i in range(120):
        own = list(base)
        for at in rnd.sample(range(150), 3):
            own[at] = f"other{i}x{at}"
        texts.append((i, " ".join(own)))
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    comps, _ = brute.components(texts)
    assert {r.doc_id: r.component_id for r in neardup.link(docs).collect()} == comps


def test_near_duplicates_in_a_group_mostly_unlike(spark):
    """Few links among many variants of one text, below 0.75 for the most part."""
    rnd = random.Random(4)
    base = [f"word{i}" for i in range(150)]
    texts = []
    for i in range(1500):
        own = list(base)
        for at in rnd.sample(range(150), 4):
            own[at] = f"other{i}x{at}"
        texts.append((i, " ".join(own)))
    docs = spark.createDataFrame(texts, "doc_id long, text string").repartition(4)
    comps, _ = brute.components(texts)
    assert {r.doc_id: r.component_id for r in neardup.link(docs).collect()} == comps


def test_bitmaps_leave_no_similar_pair_out():
    rnd = np.random.default_rng(6)
    sets, base = [], rnd.integers(0, 1 << 62, 3000, dtype=np.uint64)
    for size in (1, 3, 60, 62, 64, 70, 126, 130, 150, 1000, 1030, 3000):
        for lost in (0, size // 8, size // 5):
            sets.append(np.unique(np.concatenate([base[: size - lost], rnd.integers(0, 1 << 62, lost, dtype=np.uint64)])))
    at = np.arange(len(sets))
    n = np.array([len(s) for s in sets], float)
    found = set(zip(*map(np.ndarray.tolist, neardup.similar_enough(n, [neardup.bitmap(s) for s in sets], at, at)), strict=True))
    both = [[len(np.intersect1d(x, y)) for y in sets] for x in sets]
    links = {(i, j) for i in at for j in at if 100 * both[i][j] >= 75 * (n[i] + n[j] - both[i][j])}
    assert links <= found and len(found) < 2 * len(links)


def test_densified_signatures_estimate_similarity():
    rnd = np.random.default_rng(1)
    for size in (20, 600):
        hits = []
        for _ in range(30):
            a = rnd.integers(0, 1 << 62, size, dtype=np.uint64)
            b = np.concatenate([a[: size * 9 // 10], rnd.integers(0, 1 << 62, size - size * 9 // 10, dtype=np.uint64)])
            owner = np.repeat([0, 1], size)
            s = neardup.signatures(owner, np.concatenate([a, b]), 2)
            hits.append((s[0] == s[1]).mean())
        assert abs(np.mean(hits) - 0.9 / 1.1) < 0.06


def test_components(spark):
    rnd = random.Random(2)
    edges = [(rnd.randint(0, 300), rnd.randint(0, 300)) for _ in range(220)] + [(1000 + i, 1001 + i) for i in range(40)]
    got = {r.node: r.comp for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    up = {x: x for e in edges for x in e}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        up[max(x, y)] = min(x, y)
    assert got == {x: find(x) for e in edges if e[0] != e[1] for x in e}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("table", ["awkward", "documents"])
def test_substrings(request, table):
    docs = request.getfixturevalue(table)
    want = brute.substring(list(unique_ids(docs).items()))
    found = recompress.remove_repeats(docs).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("sha")).collect()
    assert len(found) == docs.count()
    for r in found:
        if r.doc_id is not None:
            assert (r.n_words, r.n_removed, r.sha) == want[r.doc_id]
    # rows without an id come after all others
    assert all(r.n_removed == r.n_words for r in found if r.doc_id is None)


def test_substrings_with_runs(spark):
    """Few words, so that runs and pairs meet at all borders."""
    rnd = random.Random(4)
    texts = [(i, " ".join(rnd.choice("ab") for _ in range(rnd.randint(0, 60)))) for i in range(150)]
    texts += [(1000 + i, " ".join(["a"] * rnd.randint(0, 40) + ["b"] * rnd.randint(0, 40))) for i in range(50)]
    docs = spark.createDataFrame(texts, "doc_id long, text string").repartition(4)
    want = brute.substring(texts)
    found = recompress.remove_repeats(docs).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("sha")).collect()
    assert {r.doc_id: (r.n_words, r.n_removed, r.sha) for r in found} == want


def test_substrings_of_nothing(nothing):
    assert recompress.remove_repeats(nothing).count() == 0


def test_equal_windows_get_equal_names():
    rnd = random.Random(6)
    passage = [rnd.choice("abcdefg") for _ in range(40)]
    names = set()
    for _ in range(30):
        text = " ".join([rnd.choice("abcdefg") for _ in range(rnd.randint(0, 30))] + passage + [rnd.choice("abcdefg") for _ in range(rnd.randint(0, 30))]).encode()
        starts, _, prints = words.fingerprints(text)
        _, at, name, _ = recompress.window_names(prints, words.word_counts(starts, [text]))
        own = text.split()
        k = next(i for i in range(len(own)) if own[i : i + 40] == [p.encode() for p in passage])
        names.add(tuple(name[(at >= k) & (at <= k + 27)]))
    assert len(names) == 1


def _packed(rows, texts):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokens.vocabulary_path(tokens.JSON_FILE))
    want, got, places = Counter(), Counter(), defaultdict(list)
    for d, t in texts:
        want.update((d, *p) for p in brute.pieces(t, tokenizer))
    for r in rows:
        got[(r.doc_id, r.piece, r.start, r.length, r.ids_crc32)] += 1
        places[r.sequence_id].append((r.offset, r.length))
    assert got == want
    for own in places.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 2048
    return len(places), sum(r.length for r in rows)


@pytest.mark.parametrize("table", ["awkward", "documents"])
def test_packing(request, table):
    docs = request.getfixturevalue(table)
    n, total = _packed(queries.packed(docs).collect(), docs.select("doc_id", "text").collect())
    assert n <= 1.02 * total / 2048 + 1


def test_packing_in_rounds(spark, documents, monkeypatch):
    monkeypatch.setattr(packing, "BLOCK_ITEMS", 24)
    monkeypatch.setattr(packing, "PASSED_ON", 2)
    n, total = _packed(queries.packed(documents).collect(), documents.select("doc_id", "text").collect())
    assert n <= 1.1 * total / 2048 + 1


def test_packing_of_nothing(nothing):
    assert queries.packed(nothing).count() == 0


def test_best_fit_takes_the_tightest_bin():
    bins, offsets, fills = packing.best_fit([7, 6, 4, 3], 10)
    assert fills == [10, 10] and bins == [0, 1, 1, 0] and offsets == [0, 0, 6, 7]


def test_shares():
    assert mixing.share(10, {"a": 1, "b": 1}, {"a": 2, "b": 100}) == {"a": 2, "b": 8}
    assert mixing.share(10, {"a": 1, "b": 0}, {"a": 2, "b": 100}) == {"a": 2, "b": 0}
    got = mixing.budgets({("x", "p"): 1, ("x", "q"): 100, ("y", "p"): 5}, 60, lambda path: 1.0)
    assert got == {("x", "p"): 1, ("x", "q"): 54, ("y", "p"): 5}
    # siblings first: what p lacks stays with x
    got = mixing.budgets({("x", "p"): 1, ("x", "q"): 100, ("y", "p"): 100}, 60, lambda path: 1.0)
    assert got == {("x", "p"): 1, ("x", "q"): 29, ("y", "p"): 30}


@pytest.mark.parametrize("table", ["awkward", "documents"])
def test_mixing(request, table, monkeypatch):
    docs = request.getfixturevalue(table).select("doc_id", "text", "lang", "source")
    encoder = tokens.default_encoder()
    monkeypatch.setattr(mixing, "SLOT_BITS", 2)
    rows = mixing.mix(docs, ["lang", "source"], 0.9, lambda path: 1.0).collect()
    have, got = Counter(), Counter()
    leaves = defaultdict(list)
    for r in docs.collect():
        have[(r.lang, r.source)] += encoder.count(r.text or "")
        leaves[(r.lang, r.source)].append(r)
    plan = mixing.budgets({p: 2 * n for p, n in have.items()}, 0.9 * sum(have.values()), lambda path: 1.0)
    epochs = defaultdict(Counter)
    for r in rows:
        assert r.n_tokens == encoder.count(r.text or "")
        got[(r.lang, r.source)] += r.n_tokens
        epochs[(r.lang, r.source)][r.epoch] += 1
    for leaf, budget in plan.items():
        longest = max(encoder.count(r.text or "") for r in leaves[leaf])
        assert budget - longest < got[leaf] <= budget or budget == 0 == got[leaf]
        for epoch in range(budget // have[leaf] if have[leaf] else 0):
            assert epochs[leaf][epoch] == len(leaves[leaf])


def test_mixing_of_nothing(nothing):
    assert mixing.mix(nothing.select("doc_id", "text", "lang", "source"), ["lang", "source"], 1.0, lambda path: 1.0).count() == 0


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, score double, id long, list int")


def exact(x, q, ids, own, k=20):
    score = np.zeros(len(x))
    for j in range(x.shape[1]):
        score = score + x[:, j] * q[j]
    order = [i for i in np.lexsort((ids, -score)) if ids[i] != own][:k]
    return [(int(ids[i]), float(score[i])) for i in order]


def test_neighbours(spark, small):
    table = spark.read.parquet(f"{small}/embeddings.parquet")
    rows = table.collect()
    x, ids = np.array([r.embedding for r in rows], float), np.array([r.vec_id for r in rows])
    found = defaultdict(list)
    for r in queries.op1_adaptive_scan(spark, small).collect():
        found[r.query_id].append(r)
    asked = [i for i in range(len(ids)) if ids[i] % 20 == 0]
    hits = 0
    for i in asked:
        want = exact(x, x[i], ids, ids[i])
        got = sorted(found[int(ids[i])], key=lambda r: r.rank)
        assert [r.rank for r in got] == list(range(1, len(want) + 1))
        assert [(-r.score, r.vec_id) for r in got] == sorted((-r.score, r.vec_id) for r in got)
        hits += len({v for v, _ in want} & {r.vec_id for r in got})
        scores = dict(exact(x, x[i], ids, ids[i], len(ids)))
        assert all(r.score == scores[r.vec_id] for r in got)
    assert hits >= 0.9 * 20 * len(asked)


def test_awkward_vectors(spark):
    rnd = np.random.default_rng(3)
    rows = [(i, [float(v) for v in rnd.standard_normal(8)], 0.0, 1, 2) for i in range(60)]
    rows += [(100 + i, rows[0][1], 0.0, 1, 2) for i in range(30)]  # ties
    rows += [rows[5]]  # a repeated row
    bad = [(200, None, 0.0, 1, 2), (220, [], 0.0, 1, 2), (240, [0.0] * 8, 0.0, 1, 2), (260, [1.0] * 7 + [float("nan")], 0.0, 1, 2),
           (280, [1.0] * 7 + [None], 0.0, 1, 2), (300, [float("inf")] * 8, 0.0, 1, 2), (320, [1.0] * 3, 0.0, 1, 2), (None, [1.0] * 8, 0.0, 1, 2)]
    table = vectors(spark, rows + bad)
    got = defaultdict(list)
    for r in ann.search(table, table.where("vec_id % 20 = 0"), lists=4, probes=4).collect():
        got[r.query_id].append((r.rank, r.vec_id, r.score))
    assert set(got) == {0, 20, 40, 100, 120}
    x, ids = np.array([r[1] for r in rows[:-1]], np.float32).astype(float), np.array([r[0] for r in rows[:-1]])
    for q in got:
        own = x[list(ids).index(q)]
        assert [(v, s) for _, v, s in sorted(got[q])] == exact(x, own, ids, q)
    assert ann.search(vectors(spark, []), vectors(spark, [])).count() == 0
    few = vectors(spark, rows[:3])
    assert ann.search(few, few).count() == 6


def test_vectors_of_another_length(spark):
    """Longer and shorter strays beside null ones are no candidates, and cost no other row."""
    rnd = np.random.default_rng(3)
    rows = [(i, rnd.standard_normal(8).tolist(), 0.0, 1, 1) for i in range(200)]
    strays = [(900, rnd.standard_normal(9).tolist(), 0.0, 1, 1), (901, rnd.standard_normal(3).tolist(), 0.0, 1, 1), (902, rnd.standard_normal(3).tolist(), 0.0, 1, 1), (903, None, 0.0, 1, 1)]
    every = vectors(spark, rows + strays)
    got = defaultdict(list)
    for r in ann.search(every, every, probes=64).collect():
        got[r.query_id].append((r.rank, r.vec_id, r.score))
    x, ids = np.array([np.float32(r[1]) for r in rows], float), np.array([r[0] for r in rows])
    assert sorted(got) == [*range(200), 901, 902]
    for q in range(200):
        assert [(v, s) for _, v, s in sorted(got[q])] == exact(x, x[q], ids, q)
    assert [v for _, v, _ in got[901]] == [902]


def test_rotation_of_chats(spark, small):
    message, n = compare("op2", queries.op2_perspective_rotation(spark, small), connect(small), chat.SQL)
    assert message is None and n > 0


def test_awkward_chats(spark, monkeypatch):
    rows = [(1, 0, "system", "be kind", 1), (1, 1, "ann", "hi", 1), (1, 2, "bob", None, 1), (1, 2, "bob", None, 1), (1, None, "ann", "", 1),
            (2, 0, "system", "alone", 1), (None, 0, "user", "lost", 1), (3, 5, None, "nameless", 1), (1, 600, "cat", "late ü", 1)]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, segment int")
    con = duckdb.connect()
    con.execute("create table conversations (conv_id bigint, turn bigint, role varchar, text varchar)")
    con.executemany("insert into conversations values (?, ?, ?, ?)", [r[:4] for r in rows])
    message, n = compare("chats", chat.rotate(turns), con, chat.SQL)
    assert message is None and n == 6 * 3 + 2
    whole = {(r.conv_id, r.perspective): r for r in chat.assemble(chat.rotate(turns)).collect()}
    ann_ = whole[(1, "ann")]
    assert [ann_.text[m.start : m.end] for m in ann_.masks] == ["<|im_end|>", "hi<|im_end|>"]
    assert "<|im_start|>user name=cat\nlate ü<|im_end|>\n" in ann_.text
    assert chat.rotate(turns.limit(0)).count() == 0


def test_pipeline(spark, small, documents):
    rows = corpus_pipeline.run(spark, small).collect()
    docs = documents
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, docs = docs, stage(spark, docs, small).cache()
        assert docs.schema.simpleString() == before.schema.simpleString()
        texts = dict(before.select("doc_id", "text").collect())
        if name == "language_id":
            gone = before.join(docs, "doc_id", "left_anti").collect()
            assert all(not any(c.isalpha() for c in r.text or "") for r in gone)
        elif name == "near_duplicates":
            comps, _ = brute.components(list(texts.items()))
            assert {r.doc_id for r in docs.collect()} == set(comps.values())
        elif name == "secret_scan":
            assert docs.count() == before.count()
            assert all(brute.base_spans(r.text)[:3] == (0, 0, 0) for r in docs.collect())
    _packed(rows, docs.select("doc_id", "text").collect())


def test_pipeline_stages_take_awkward_tables(spark, awkward, nothing, small):
    for docs in (awkward, nothing):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            docs = stage(spark, docs, small)
            assert "kept" in docs.columns
        assert corpus_pipeline.STAGES[-1][1](spark, docs, small).count() >= 0
