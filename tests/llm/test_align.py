"""Alignment of two tokenizers against a plain version that looks at every pair of ids."""

import hashlib
from collections import Counter, defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from glacierlens.llm import align, queries, tokens


@pytest.fixture(scope="module")
def libraries():
    import sentencepiece
    from tokenizers import Tokenizer

    left = Tokenizer.from_file(tokens.vocabulary_path(tokens.JSON_FILE))
    left.encode_special_tokens = True
    return left, sentencepiece.SentencePieceProcessor(model_file=tokens.vocabulary_path(align.PIECE_FILE))


def byte_of():
    kept = [*range(33, 127), *range(161, 173), *range(174, 256)]
    table, more = {chr(b): b for b in kept}, 0
    for b in range(256):
        if b not in kept:
            table[chr(256 + more)] = b
            more += 1
    return table


ALPHABET = byte_of()


def plain(text, libraries):
    """Groups of ids and linked pairs of one text."""
    if not text:
        return [], []
    left, right = libraries
    a, b = left.encode(" " + text, add_special_tokens=False).ids, right.encode(text)
    spelled_a = [bytes(ALPHABET[c] for c in left.id_to_token(i)) for i in a]
    pieces = [right.id_to_piece(i) for i in b]
    spelled_b = [bytes([int(p[3:5], 16)]) if right.is_byte(i) else p.replace("▁", " ").encode() for i, p in zip(b, pieces)]
    if b"".join(spelled_a) != (" " + text).encode() or b"".join(spelled_b) != (" " + text).encode():
        return [], []
    ranges = []
    for spelled in (spelled_a, spelled_b):
        at, out = 0, []
        for s in spelled:
            out.append((at, at + len(s)))
            at += len(s)
        ranges.append(out)
    ends = sorted({e for _, e in ranges[0]} & {e for _, e in ranges[1]})
    groups = [([], []) for _ in ends]
    for side, (ids, spans) in enumerate(zip((a, b), ranges)):
        g = 0
        for i, (_, end) in zip(ids, spans):
            groups[g][side].append(i)
            g += end == ends[g]
    links, k = [], 0
    for x, (s, e) in zip(a, ranges[0]):
        while ranges[1][k][1] <= s:
            k += 1
        j = k
        while j < len(b) and ranges[1][j][0] < e:
            links.append((x, b[j]))
            j += 1
    return groups, links


def expected(rows, libraries):
    each = [(d, *plain(t, libraries)) for d, t in rows]
    counts = Counter(pair for _, _, links in each for pair in links)
    most = defaultdict(int)
    for (_, y), n in counts.items():
        most[y] = max(most[y], n)
    out = []
    for d, groups, links in each:
        text = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in groups)
        best = sum(counts[p] == most[p[1]] for p in links)
        digest = hashlib.sha256(text.encode()).hexdigest() if links else ""
        out.append((d, sum(len(a) for a, _ in groups), sum(len(b) for _, b in groups), len(groups), len(links), best, sum(counts[p] for p in links), digest))
    return sorted(out, key=str)


COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def got(df):
    return sorted((tuple(r[c] for c in COLUMNS) for r in df.collect()), key=str)


PARTS = st.sampled_from(["a", " ", "  ", "\n", "the ", "Ünder", "!", "'s", "\t", "<|endoftext|>", "</s>", "<0x0A>", "99", "　", "漢字", "🙂", "▁", "\x1c", "ﬁ", "é", "-- "])


@settings(max_examples=300, deadline=None)
@given(st.lists(PARTS, max_size=25).map("".join) | st.text(max_size=40))
def test_any_text(libraries, text):
    left, right = align.default_sides()
    found = align.align(text, left, right)
    groups, links = plain(text, libraries)
    cuts = zip(found.cuts_a, found.cuts_a[1:], found.cuts_b, found.cuts_b[1:])
    assert [(found.a[p:q].tolist(), found.b[r:s].tolist()) for p, q, r, s in cuts] == groups
    assert list(zip(*(x.tolist() for x in align.links(found)))) == links


def test_documents(spark, documents, libraries, small):
    rows = [(r.doc_id, r.text) for r in documents.select("doc_id", "text").collect()]
    assert got(queries.op11_token_alignment(spark, small)) == expected(rows, libraries)


def test_awkward_rows(awkward, nothing, libraries, monkeypatch):
    rows = [(r.doc_id, r.text) for r in awkward.select("doc_id", "text").collect()]
    want = expected(rows, libraries)
    assert got(align.scored(awkward)) == want
    assert align.scored(nothing).count() == 0
    # the way for many pairs, and small batches
    monkeypatch.setattr(align, "BROADCAST_PAIRS", 0)
    assert got(align.scored(awkward)) == want


def test_ids_and_cuts(awkward, libraries):
    for r in align.alignments(awkward).join(awkward.select("doc_id", "text").dropDuplicates(), "doc_id").collect():
        groups, _ = plain(r.text, libraries)
        assert [(r.a[p:q], r.b[s:t]) for p, q, s, t in zip(r.cuts_a, r.cuts_a[1:], r.cuts_b, r.cuts_b[1:])] == groups


def test_piece_ids_are_those_of_the_model(libraries):
    plain, model = align._Pieces(tokens.vocabulary_path(align.PIECE_FILE)), libraries[1]
    kept = [model.id_to_piece(i).replace("▁", " ") for i in range(model.get_piece_size()) if not model.is_control(i)]
    spaces = [before + " " * n + after for n in range(40) for before in ("", "a", "\n") for after in ("", "the", "é")]
    words = ["x " + "ab" * n + " y" for n in (align.LONG_WORD // 2, align.LONG_WORD // 2 + 1, 3000)]
    for text in [*kept, *("x " + piece for piece in kept), *filter(None, spaces), *words]:
        assert plain.ids(text).tolist() == model.encode(text), text


@settings(max_examples=300, deadline=None)
@given(st.lists(PARTS, min_size=1, max_size=25).map("".join) | st.text(min_size=1, max_size=40))
def test_piece_ids_of_any_text(libraries, text):
    assert align.pieces(tokens.vocabulary_path(align.PIECE_FILE)).encode(text).tolist() == libraries[1].encode(text)


def test_plain_words_need_no_slow_merge(monkeypatch):
    plain = align._Pieces(tokens.vocabulary_path(align.PIECE_FILE))
    want = plain._model.encode("The first  line,\nand ümläute follow.")
    monkeypatch.setattr(plain, "_model", None)
    assert plain.ids("The first  line,\nand ümläute follow.").tolist() == want
