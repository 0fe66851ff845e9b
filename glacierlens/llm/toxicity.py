"""Toxicity scores: misspelled lexicon terms by Levenshtein automata, judged by their context.

The lexicon is learned from labelled texts and kept as a trie of words and of stems
(beginnings of words).  A text's word runs through the automaton of all trie places
it may have reached with few edits; sets of such places are the states of a
deterministic automaton that is built as it is needed.  A found term counts by how
much likelier it is in toxic texts, less where the words around it, or quotation
marks, speak for a quotation.  A logistic regression makes a score of a text's sums.

Learned from a bounded sample of labelled rows; see ``learn``.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glacierlens.llm.tables import written

# labelled rows of each label that are learned from, in expectation: a hash of the id takes that share of them
SAMPLE = 6000
# terms of the lexicon and cues of the context at most
TERMS = 400
CUES = 500
# a term is in this many toxic texts of its half of the sample at least, and likelier there by this G-squared
LEAST_TEXTS = 4
LEAST_G2 = 15.0
# a hit counts from this weight
LEAST_WEIGHT = 1.0
# letters of a stem
STEMS = range(4, 9)
# words on either side of a term that are its context
WINDOW = 6
# edits that a term may be missed by, from so many letters; the first entry is for stems
STEM_EDITS = ((7, 1),)
WORD_EDITS = ((9, 2), (5, 1))
# states of the automaton, and words with known results, before either is begun anew
STATES = 20_000
KNOWN_WORDS = 200_000

WORD = re.compile(r"\w+(?:[@$*!'’]\w+)*")
QUOTES = re.compile('["“”„«»]')
QUOTED = "<quoted>"
# words that report speech, and quotation marks, count as so many clean and toxic examples before any is seen
REPORTING = frozenset("said says wrote called calls quote quoted word term sagte schrieb nannte dit écrit appelé dijo escribió llamó".split())
PRIOR_CLEAN, PRIOR_TOXIC = 4.0, 1.0


def held_out(doc_id: Column) -> Column:
    """Rows that are never learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


class Automaton:
    """Levenshtein automata of all words, intersected with the trie of the lexicon.

    ``terms`` are words, or stems that end with an asterisk.  ``find(word)`` gives the
    number of the nearest term and its edits, or None: least edits first, then words
    before stems, longer before shorter, then the earlier term.
    """

    def __init__(self, terms: list[str]):
        self.terms = terms
        self.children: list[dict[str, int]] = [{}]
        self.word: list[int | None] = [None]
        self.stem: list[int | None] = [None]
        self.most = [0]
        self.edits = []
        for number, term in enumerate(terms):
            text = term.rstrip("*")
            stem = term.endswith("*")
            edits = next((e for least, e in (STEM_EDITS if stem else WORD_EDITS) if len(text) >= least), 0)
            self.edits.append(edits)
            at = 0
            self.most[0] = max(self.most[0], edits)
            for letter in text:
                if letter not in self.children[at]:
                    self.children[at][letter] = len(self.children)
                    self.children.append({})
                    self.word.append(None)
                    self.stem.append(None)
                    self.most.append(0)
                at = self.children[at][letter]
                self.most[at] = max(self.most[at], edits)
            (self.stem if stem else self.word)[at] = number
        self.rank = [(not t.endswith("*"), len(t)) for t in terms]
        self._begin()

    def _begin(self) -> None:
        self.known: dict[str, tuple[int, int] | None] = {}
        self.states: list[tuple[dict[int, int], dict[int, int]]] = []
        self.number: dict = {}
        self.step: list[dict[str, int]] = []
        self._state({}, {})  # state 0: nothing can be found any more
        self.start = self._state(self._closed({0: 0}), {})

    def _closed(self, places: dict[int, int]) -> dict[int, int]:
        """With letters of the term left out."""
        todo = list(places.items())
        while todo:
            node, e = todo.pop()
            for below in self.children[node].values():
                if e + 1 <= self.most[below] and e + 1 < places.get(below, 9):
                    places[below] = e + 1
                    todo.append((below, e + 1))
        return places

    def _state(self, places: dict[int, int], stems: dict[int, int]) -> int:
        stems = dict(stems)
        for node, e in places.items():
            term = self.stem[node]
            if term is not None and e <= self.edits[term] and e < stems.get(term, 9):
                stems[term] = e
        key = (frozenset(places.items()), frozenset(stems.items()))
        if key not in self.number:
            self.number[key] = len(self.states)
            self.states.append((places, stems))
            self.step.append({})
        return self.number[key]

    def _next(self, state: int, letter: str) -> int:
        places, stems = self.states[state]
        then: dict[int, int] = {}

        def reach(node, e):
            if e <= self.most[node] and e < then.get(node, 9):
                then[node] = e

        for node, e in places.items():
            for other, below in self.children[node].items():
                reach(below, e + (other != letter))
            reach(node, e + 1)
        return self._state(self._closed(then), stems)

    def _better(self, found: dict[int, int]) -> tuple[int, int] | None:
        return min(((e, tuple(-x for x in self.rank[t]), t) for t, e in found.items()), default=None)

    def find(self, word: str) -> tuple[int, int] | None:
        if word in self.known:
            return self.known[word]
        if len(self.states) > STATES or len(self.known) > KNOWN_WORDS:
            self._begin()
        state, step = self.start, self.step
        for letter in word:
            then = step[state].get(letter)
            if then is None:
                then = step[state][letter] = self._next(state, letter)
            state = then
            if not state:
                break
        places, stems = self.states[state]
        found = dict(stems)
        for node, e in places.items():
            term = self.word[node]
            if term is not None and e <= self.edits[term] and e < found.get(term, 9):
                found[term] = e
        best = self._better(found)
        self.known[word] = out = best and (best[2], best[0])
        return out


@dataclass
class Hit:
    """A term in a text: code points, the term's number, its edits, and the context's cues."""

    start: int
    end: int
    term: int
    edits: int
    cues: list[str] = field(default_factory=list)


def _lower(text: str) -> str:
    """Lower case, letter by letter where a letter's lower case is longer, so that places stay."""
    lower = text.lower()
    return lower if len(lower) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)


def hits(text: str, automaton: Automaton) -> tuple[list[Hit], int]:
    """All terms of a whole text with their contexts, and its number of words."""
    lower = _lower(text)
    found = WORD.findall(lower)
    find = automaton.find
    at = [i for i, w in enumerate(found) if find(w)]
    if not at:
        return [], len(found)
    places = [m.span() for m in WORD.finditer(lower)]
    quoted = _quoted(lower, [places[i][0] for i in at])
    out = []
    for i, inside in zip(at, quoted):
        around = found[max(0, i - WINDOW) : i] + found[i + 1 : i + 1 + WINDOW]
        cues = {w for w in around if not find(w)}
        term, edits = find(found[i])
        out.append(Hit(*places[i], term, edits, sorted(cues | ({QUOTED} if inside else set()))))
    return out, len(found)


def _quoted(text: str, positions: list[int]) -> list[bool]:
    """Whether each position lies between quotation marks of its line."""
    marks = [(m.start(), m[0]) for m in QUOTES.finditer(text)]
    if not marks:
        return [False] * len(positions)
    out, k, open_, line = [], 0, None, -1
    for at in positions:
        if text.rfind("\n", line + 1, at) > line:
            line, open_ = text.rfind("\n", line + 1, at), None
            while k < len(marks) and marks[k][0] < line:
                k += 1
        while k < len(marks) and marks[k][0] < at:
            place, mark = marks[k]
            open_ = None if open_ is not None or mark in "”»" else place
            k += 1
        ends = text.find("\n", at)
        closes = k < len(marks) and (ends < 0 or marks[k][0] < ends)
        out.append(open_ is not None and closes)
    return out


FEATURES = 7


@dataclass
class Model:
    """Lexicon, weights of terms by edits, log-odds of cues, and the regression."""

    terms: list[str]
    weights: dict[tuple[int, int], float]
    cues: dict[str, float]
    coefficients: list[float] | None
    centre: list[float]
    scale: list[float]
    share: float

    def context(self, cues: list[str]) -> float:
        """From 0, a quotation, to 1: what a hit counts for in this context."""
        c = sum(self.cues.get(w, 0.0) for w in cues)
        return 1 / (1 + math.exp(-(2 + max(-8.0, min(8.0, c)))))

    def features(self, found: list[Hit], n_words: int) -> list[float]:
        weighed = [(self.weights.get((h.term, h.edits), 0.0), h) for h in found]
        values = [(w * self.context(h.cues), h) for w, h in weighed if w >= LEAST_WEIGHT]
        total = sum(v for v, _ in values)
        kinds = len({h.term for _, h in values})
        n = math.log1p(n_words)
        dense = 100 * total / (n_words + 20)
        quoted = sum(QUOTED in h.cues for _, h in values) / max(1, len(values))
        return [math.log1p(total), math.log1p(dense), max((v for v, _ in values), default=0.0), math.log1p(kinds), n if values else 0.0, math.log1p(len(values)), quoted]

    def score(self, features: np.ndarray) -> np.ndarray:
        if self.coefficients is None:
            return np.full(len(features), self.share)
        z = (features - np.array(self.centre)) / np.array(self.scale)
        z = z @ np.array(self.coefficients[1:]) + self.coefficients[0]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def sample(docs: DataFrame, labels: DataFrame, most: int = SAMPLE) -> DataFrame:
    """Texts of about ``most`` rows of each label: ``text, toxic, part`` (0 for the lexicon, 1 for the weights).

    Only documents that are not held out.  A document with several labels is toxic
    if one says so; labels that are null or neither 0 nor 1 don't count.
    """
    marked = labels.where("toxic in (0, 1) and doc_id is not null").where(~held_out(F.col("doc_id")))
    marked = marked.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    counts = {r["toxic"]: r["n"] for r in marked.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    drawn = F.pmod(F.xxhash64("doc_id", F.lit("sample")), F.lit(1 << 40)) / float(1 << 40)
    share = F.when(F.col("toxic") == 1, most / max(counts.get(1, 0), 1)).otherwise(most / max(counts.get(0, 0), 1))
    marked = marked.where(drawn < share).select(F.col("doc_id").alias("marked"), "toxic", F.pmod(F.xxhash64("doc_id", F.lit("part")), F.lit(2)).alias("part"))
    # bounded by the parameter, whatever the number of labels
    found = docs.select("doc_id", "text").join(F.broadcast(marked), F.col("doc_id") == F.col("marked"))
    return written(found.select(F.coalesce("text", F.lit("")).alias("text"), "toxic", "part"), "labelled")


def _counted(rows: DataFrame, key_of, kind: str = "key string, toxic long, clean long") -> DataFrame:
    """Sums over texts of ``key_of(text)``, an iterable of keys and numbers, by label."""

    def count(batches):
        for batch in batches:
            sums = ({}, {})
            for text, toxic in zip(batch.column(0), batch.column(1).to_pylist()):
                into = sums[toxic]
                for key, n in key_of(text.as_py()):
                    into[key] = into.get(key, 0) + n
            keys = list(sums[0].keys() | sums[1].keys())
            columns = [pa.array(keys, pa.string()), *(pa.array([sums[k].get(x, 0) for x in keys], pa.int64()) for k in (1, 0))]
            yield pa.RecordBatch.from_arrays(columns, names=["key", "toxic", "clean"])

    counted = rows.select("text", "toxic").mapInArrow(count, kind)
    return counted.groupBy("key").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def _candidates(text: str):
    """Each word and stem of a text, once."""
    distinct = {w for w in WORD.findall(_lower(text)) if 3 <= len(w) <= 40 and not w.isdigit()}
    stems = {w[:n] + "*" for w in distinct for n in STEMS if len(w) > n}
    return ((x, 1) for x in distinct | stems)


def g2(toxic: int, clean: int, n_toxic: int, n_clean: int) -> float:
    """G-squared of a term's texts against those without it; 0 if it isn't likelier in toxic ones."""
    if toxic * n_clean <= clean * n_toxic:
        return 0.0
    total, out = n_toxic + n_clean, 0.0
    for seen, n in ((toxic, n_toxic), (clean, n_clean)):
        for part, whole in ((seen, toxic + clean), (n - seen, total - toxic - clean)):
            if part:
                out += 2 * part * math.log(part * total / (n * whole))
    return out


def lexicon(rows: DataFrame) -> list[str]:
    """Words and stems that toxic texts hold, none the beginning of another; the best of each line of beginnings."""
    totals = {r["toxic"]: r["n"] for r in rows.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    n_toxic, n_clean = totals.get(1, 0), totals.get(0, 0)
    if not n_toxic or not n_clean:
        return []
    found = _counted(rows, _candidates).where(F.col("toxic") >= LEAST_TEXTS)
    rate = (F.col("toxic") / n_toxic) / ((F.col("clean") + 0.5) / n_clean)
    # by the share of toxic texts times the log of how much likelier it is there
    best = found.where(rate > 2).orderBy((F.col("toxic") * F.log(rate)).desc(), "key").limit(50 * TERMS)
    scored = [(g2(r["toxic"], r["clean"], n_toxic, n_clean), r["key"]) for r in best.collect()]
    scored = sorted((x for x in scored if x[0] >= LEAST_G2), key=lambda x: (-round(x[0], 3), x[1].endswith("*"), -len(x[1]), x[1]))
    chosen: list[str] = []
    taken: set[str] = set()
    roots: set[str] = set()
    for _, key in scored:
        text = key.rstrip("*")
        begins = {text[:n] for n in range(STEMS.start, len(text) + 1)}
        if text in roots or begins & taken:
            continue
        chosen.append(key)
        taken.add(text)
        roots |= begins
        if len(chosen) == TERMS:
            break
    return chosen


def _weigh(rows: DataFrame, terms: list[str]) -> tuple[dict, dict]:
    """Log rates of terms by edits, toxic against clean, and log-odds of the words around them.

    A cue's odds are those of its hits against what their terms have anyway, so that a
    language with milder terms doesn't make all its words cues.
    """
    made: list[Automaton] = []

    def found(text):
        if not made:
            made.append(Automaton(terms))
        return hits(text, made[0])

    def term_events(text):
        at, n_words = found(text)
        return [("words", n_words), *Counter(f"{h.term}:{h.edits}" for h in at).items()]

    seen = {r["key"]: (r["toxic"], r["clean"]) for r in _counted(rows, term_events).collect()}
    words = seen.pop("words", (0, 0))
    seen = {tuple(map(int, k.split(":"))): v for k, v in seen.items()}
    by_edits: dict[int, list[int]] = defaultdict(lambda: [0, 0])
    for (_, edits), (t, c) in seen.items():
        by_edits[edits][0] += t
        by_edits[edits][1] += c

    def rate(t, c):
        return math.log((t + 0.5) / (words[0] + 1)) - math.log((c + 0.5) / (words[1] + 1))

    weights, share = {}, {}
    for (term, edits), (t, c) in seen.items():
        # drawn towards what all terms with as many edits have, by the weight of four hits
        weights[term, edits] = max(-3.0, min(7.0, ((t + c) * rate(t, c) + 4 * rate(*by_edits[edits])) / (t + c + 4)))
        share[term, edits] = t / (t + c)

    def cue_events(text):
        for h in found(text)[0]:
            thousandths = round(1000 * share.get((h.term, h.edits), 0.5))
            for cue in h.cues:
                yield f"n:{cue}", 1
                yield f"e:{cue}", thousandths

    counted = _counted(rows, cue_events).select(F.substring("key", 3, 1000).alias("cue"), F.substring("key", 1, 1).alias("kind"), "toxic", "clean")

    def total(kind, *columns):
        return F.sum(F.when(F.col("kind") == kind, sum(map(F.col, columns))).otherwise(0))

    near = counted.groupBy("cue").agg(total("n", "toxic").alias("t"), total("n", "clean").alias("c"), total("e", "toxic", "clean").alias("e"))
    near = near.where("t + c >= 5").orderBy(F.abs(F.col("t") - F.col("e") / 1000).desc(), "cue").limit(CUES)
    cues = {w: math.log(PRIOR_TOXIC / PRIOR_CLEAN) for w in [QUOTED, *REPORTING]}
    for r in near.collect():
        expected = r["e"] / 1000
        more = (PRIOR_TOXIC, PRIOR_CLEAN) if r["cue"] in cues else (2.0, 2.0)
        odds = math.log((r["t"] + more[0]) / (r["c"] + more[1])) - math.log((expected + 2) / (r["t"] + r["c"] - expected + 2))
        cues[r["cue"]] = max(-3.0, min(3.0, odds))
    return weights, cues


def fit(x: np.ndarray, y: np.ndarray, penalty: float = 1.0, rounds: int = 60) -> np.ndarray:
    """Coefficients of a ridge logistic regression, the intercept first, by Newton's method."""
    z = np.column_stack([np.ones(len(x)), x])
    beta = np.zeros(z.shape[1])
    ridge = penalty * np.eye(z.shape[1])
    ridge[0, 0] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ beta, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + ridge, z.T @ (y - p) - ridge @ beta)
        beta = beta + step
        if np.abs(step).max() < 1e-9:
            break
    return beta


def _features(rows: DataFrame, model: Model, keep: str) -> DataFrame:
    """Column ``keep`` and the features of ``text``."""
    kind = dict(rows.dtypes)[keep]

    def run(batches):
        automaton = Automaton(model.terms)
        for batch in batches:
            x = [model.features(*hits(t.as_py() or "", automaton)) for t in batch.column(1)]
            flat = pa.array(np.array(x, np.float64).reshape(-1))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, FEATURES * len(x) + 1, FEATURES), pa.int32()), flat)
            yield pa.RecordBatch.from_arrays([batch.column(0), lists], names=[keep, "features"])

    return rows.select(keep, "text").mapInArrow(run, f"{keep} {kind}, features array<double>")


def learn(docs: DataFrame, labels: DataFrame, most: int = SAMPLE) -> Model:
    """A model of documents ``doc_id, text`` and labels ``doc_id, toxic``.

    Half of a sample (``most`` rows of each label in expectation) gives the lexicon,
    the other half the weights, cues and regression, so that terms which fit their
    texts by chance get no weight.  Without rows of both labels the model has no
    terms and gives every text the share of toxic ones (0 without any row).
    """
    rows = sample(docs, labels, most)
    terms = lexicon(rows.where("part = 0"))
    rest = rows.where("part = 1")
    weights, cues = _weigh(rest, terms)
    model = Model(terms, weights, cues, None, [0.0] * FEATURES, [1.0] * FEATURES, 0.0)
    # in an order of their own, so that equal input gives equal sums
    found = sorted(_features(rest, model, "toxic").collect(), key=lambda r: (r["toxic"], r["features"]))
    y = np.array([r["toxic"] for r in found], float)
    model.share = float(y.mean()) if len(y) else 0.0
    if 0 < model.share < 1:
        x = np.array([r["features"] for r in found])
        centre, scale = x.mean(0), x.std(0)
        scale[scale == 0] = 1
        model.coefficients = fit((x - centre) / scale, y).tolist()
        model.centre, model.scale = centre.tolist(), scale.tolist()
    return model


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id, score`` of every row; null and empty texts are texts without terms."""

    def run(batches):
        automaton = Automaton(model.terms)
        for batch in batches:
            x = np.array([model.features(*hits(t.as_py() or "", automaton)) for t in batch.column(1)], float).reshape(-1, FEATURES)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.score(x))], names=["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, score double")


SPANS = "doc_id long, start int, end int, term string, edits int, weight double, context double"


def spans(docs: DataFrame, model: Model) -> DataFrame:
    """A row for each term found: its code points, what it stands for, and how far the context lets it count."""

    def run(batches):
        automaton = Automaton(model.terms)
        names = [x.split()[0] for x in SPANS.split(", ")]
        for batch in batches:
            out = [[] for _ in names]
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                for h in hits(text.as_py() or "", automaton)[0]:
                    row = (doc_id, h.start, h.end, model.terms[h.term], h.edits, model.weights.get((h.term, h.edits), 0.0), model.context(h.cues))
                    for column, value in zip(out, row):
                        column.append(value)
            kinds = (pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.int32(), pa.float64(), pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], names=names)

    return docs.select("doc_id", "text").mapInArrow(run, SPANS)
