"""Automaton against a plain edit distance, contexts, and accuracy on rows that were held out."""

import random
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from glacierlens.llm import queries, toxicity
from glacierlens.llm.toxicity import Automaton

TERMS = ["idiot", "scum", "worthless", "disgusting", "moron", "réeux*", "bomente*", "a", "moro", "idio*"]
AUTOMATON = Automaton(TERMS)


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row = row, [i]
        for j, y in enumerate(b, 1):
            row.append(min(row[-1] + 1, last[j] + 1, last[j - 1] + (x != y)))
    return row[-1]


def nearest(word):
    """The nearest term by comparing with all: number and edits."""
    found = []
    for number, term in enumerate(TERMS):
        text, stem = term.rstrip("*"), term.endswith("*")
        most = next((e for least, e in (toxicity.STEM_EDITS if stem else toxicity.WORD_EDITS) if len(text) >= least), 0)
        edits = min(distance(text, word[:n]) for n in range(len(word) + 1)) if stem else distance(text, word)
        if edits <= most:
            found.append((edits, stem, -len(text) - stem, number))
    return (min(found)[3], min(found)[0]) if found else None


def garbled(rnd, word):
    for _ in range(rnd.randint(0, 3)):
        at = rnd.randint(0, len(word))
        word = word[:at] + rnd.choice(["", rnd.choice("aeioustdmr1é")]) + word[at + rnd.randint(0, 1) :]
    return word


def test_automaton_finds_what_comparing_finds():
    rnd = random.Random(1)
    for _ in range(6000):
        word = garbled(rnd, rnd.choice(TERMS).rstrip("*") + rnd.choice(["", "", "x", "ment"]))
        assert AUTOMATON.find(word) == nearest(word), word


@settings(max_examples=300, deadline=None)
@given(st.text("idotscumwrhel", max_size=9))
def test_automaton_on_any_word(word):
    assert AUTOMATON.find(word) == nearest(word)


def test_automaton_begins_anew(monkeypatch):
    monkeypatch.setattr(toxicity, "STATES", 20)
    monkeypatch.setattr(toxicity, "KNOWN_WORDS", 10)
    rnd, small = random.Random(2), Automaton(TERMS)
    for _ in range(500):
        word = garbled(rnd, rnd.choice(TERMS).rstrip("*"))
        assert small.find(word) == nearest(word)
        assert len(small.states) < 20 + 200 and len(small.known) <= 12


def test_places_and_quotations():
    text = 'You 1diot! They said "you are SCUM" today.\nİ “no wrothless” and «moron\n moron» x'
    found, n = toxicity.hits(text, AUTOMATON)
    assert [(text[h.start : h.end], TERMS[h.term], h.edits, toxicity.QUOTED in h.cues) for h in found] == [
        ("1diot", "idiot", 1, False), ("SCUM", "scum", 0, True), ("wrothless", "worthless", 2, True), ("moron", "moron", 0, False), ("moron", "moron", 0, False)
    ]
    assert n == 15 and "said" in found[1].cues and "idiot" not in found[1].cues


def test_quotations_count_less(spark):
    """A term that clean texts quote weighs less in a quotation, more where it is meant."""
    rnd = random.Random(4)
    filler = [f"word{i}" for i in range(300)]

    def prose(n):
        return " ".join(rnd.choice(filler) for _ in range(n))

    docs, labels = [], []
    for i in range(3000):
        toxic = i % 3 == 0
        middle = "dreckhead" if toxic else f'she {rnd.choice(["wrote", "said"])} "a dreckhead" in {prose(2)}' if i % 9 == 1 else ""
        docs.append((i, f"{prose(20)} {middle} {prose(20)}"))
        labels.append((i, 1, int(toxic)))
    docs, labels = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model = toxicity.learn(docs, labels)
    assert "dreckhead" in model.terms
    texts = [(1, f"{prose(9)} drekhead {prose(9)}"), (2, f'{prose(9)} she said "a dreckhead" in {prose(9)}'), (3, prose(20)), (4, f"{prose(9)} dreckhead {prose(9)}")]
    score = {r.doc_id: r.score for r in toxicity.scored(spark.createDataFrame(texts, "doc_id long, text string"), model).collect()}
    assert score[4] > 0.5 > score[2] and score[3] < 0.1
    found = {(r.doc_id, r.edits): r for r in toxicity.spans(spark.createDataFrame(texts, "doc_id long, text string"), model).where("term = 'dreckhead'").collect()}
    assert (1, 1) in found and found[2, 0].context < 0.5 < 0.8 < found[4, 0].context


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = queries.op12_toxicity(spark, sf).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and r.predicted == (r.score >= 0.5) for r in rows)
    out = [r for r in rows if r.held_out and r.doc_id in labels]
    toxic = [r for r in out if labels[r.doc_id]]
    assert sum(r.predicted for r in toxic) >= 0.9 * len(toxic)
    assert sum(r.predicted for r in out if not labels[r.doc_id]) <= 0.01 * len(out)


def test_labels_of_held_out_rows_change_nothing(spark):
    docs = [(i, f"some text that is {'vile' if i % 2 else 'fine'} number {i}") for i in range(400)]
    marks = [(i, i % 2) for i in range(400)]
    turned = [(i, 1 - t if zlib.crc32(str(i).encode()) % 5 == 0 else t) for i, t in marks]
    docs = spark.createDataFrame(docs, "doc_id long, text string")
    a, b = (toxicity.learn(docs, spark.createDataFrame(m, "doc_id long, toxic int")) for m in (marks, turned))
    assert a == b and "vile" in a.terms


def test_awkward_rows(spark, awkward, nothing):
    labels = spark.createDataFrame([(0, 1), (0, 0), (1, 0), (2, None), (3, 7), (None, 1), (5, 0), (7, 1)], "doc_id long, toxic int")
    model = toxicity.learn(awkward, labels)
    rows = toxicity.scored(awkward, model).collect()
    assert len(rows) == awkward.count() and all(0 <= r.score <= 1 for r in rows)
    for docs, marks in ((nothing, labels), (awkward, labels.where("false")), (awkward, labels.where("toxic = 0"))):
        bare = toxicity.learn(docs, marks)
        assert bare.coefficients is None
        assert {r.score for r in toxicity.scored(awkward, bare).collect()} == {0.0}
    assert toxicity.scored(nothing, model).count() == 0


@pytest.mark.parametrize("text", ["x" * 200_000, "worthless " * 50_000, '"' * 10_000 + " idiot", "\n" * 10_000])
def test_very_long_texts(text):
    found, n = toxicity.hits(text, AUTOMATON)
    assert len(found) == text.count("worthless") + text.count("idiot") and n >= 0
