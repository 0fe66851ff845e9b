"""Token counts that follow edits: pre-token segment trees for each document.

A document's leaves are stretches of a few hundred characters that begin at a
sure pre-token boundary: a space between two other characters, which always opens
a pre-token.  Tokens never cross such a boundary, so a document's count is the
sum of its leaves' counts, kept in a binary tree of sums.

An edit re-encodes the leaves it touches.  Where it spoils the boundary beside
it, the neighbouring leaf joins them as context, until the boundary is sure
again.  All other counts come from the tree, whose sums change along the paths
to the root only.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from itertools import accumulate

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from glacierlens.llm.tokens import default_encoder

# characters after which a leaf ends at the next boundary
LEAF_CHARS = 256
_BOUNDARY = re.compile(r"(?<=\S) (?=\S)")

_COUNTS = T.ArrayType(T.IntegerType())
_TREE = [T.StructField("leaf_chars", _COUNTS), T.StructField("leaf_sums", _COUNTS)]
EDITS = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("replacement", T.StringType())]))
EDITED = T.StructType(
    [T.StructField("text", T.StringType()), *_TREE, T.StructField("n_tokens", T.LongType()), T.StructField("n_edits", T.IntegerType()), T.StructField("n_encoded", T.LongType())]
)


def leaves(text: str, size: int = LEAF_CHARS) -> list[int]:
    """Where the leaves of a text begin, and its end."""
    cuts = [0]
    while True:
        m = _BOUNDARY.search(text, cuts[-1] + size)
        if m is None:
            return [*cuts, len(text)] if text else [0]
        cuts.append(m.start())


class Tree:
    """Leaf lengths, and sums of the leaves' tokens with node i over 2i and 2i + 1."""

    def __init__(self, chars: list[int], sums: list[int]):
        self.chars, self.sums = chars, sums

    @classmethod
    def of(cls, chars: list[int], tokens: list[int]) -> Tree:
        n = 1
        while n < len(tokens):
            n *= 2
        sums = [0] * n + tokens + [0] * (n - len(tokens))
        for i in range(n - 1, 0, -1):
            sums[i] = sums[2 * i] + sums[2 * i + 1]
        return cls(chars, sums)

    @property
    def total(self) -> int:
        return self.sums[1] if len(self.sums) > 1 else 0

    def tokens(self) -> list[int]:
        n = len(self.sums) // 2
        return self.sums[n : n + len(self.chars)]

    def set(self, leaf: int, tokens: int) -> None:
        """Change a leaf's count and the sums above it."""
        i = len(self.sums) // 2 + leaf
        more = tokens - self.sums[i]
        while i and more:
            self.sums[i] += more
            i //= 2


def build(text: str, encoder, size: int = LEAF_CHARS) -> Tree:
    cuts = leaves(text, size)
    return Tree.of([b - a for a, b in zip(cuts, cuts[1:])], [encoder.count(text[a:b]) for a, b in zip(cuts, cuts[1:])])


def in_order(edits, length: int) -> list[tuple[int, int, str]]:
    """Edits by place, cut to the text; one that begins before the last one's end is left out."""
    out, at = [], 0
    for start, end, new in sorted((max(0, min(s or 0, length)), max(0, min(e or 0, length)), r or "") for s, e, r in edits or ()):
        if start >= at and end >= start:
            out.append((start, end, new))
            at = end
    return out


def _sure(left: str, right: str) -> bool:
    """Whether a leaf boundary lies between what ends in ``left`` and begins with ``right``."""
    return bool(left) and not left[-1].isspace() and len(right) > 1 and right[0] == " " and not right[1].isspace()


def update(text: str, tree: Tree, edits, encoder, size: int = LEAF_CHARS) -> tuple[str, Tree, int]:
    """The edited text, its tree, and how many characters were encoded again."""
    edits = in_order(edits, len(text))
    if not edits:
        return text, tree, 0
    begins = [0, *accumulate(tree.chars)]
    n = len(tree.chars)
    if n == 0:
        new = "".join(r for _, _, r in edits)
        return new, build(new, encoder, size), len(new)
    # runs of leaves that edits touch; an edit at a boundary touches both sides
    spans: list[list] = []
    for edit in edits:
        first = max(0, bisect_right(begins, max(0, edit[0] - 1)) - 1)
        last = min(n - 1, bisect_right(begins, edit[1]) - 1)
        first = min(first, n - 1)
        if spans and first <= spans[-1][1] + 1:
            spans[-1][1] = max(spans[-1][1], last)
            spans[-1][2].append(edit)
        else:
            spans.append([first, last, [edit]])

    def rewritten(first: int, last: int, own) -> str:
        parts, at = [], begins[first]
        for start, end, new in own:
            parts += [text[at:start], new]
            at = end
        return "".join([*parts, text[at : begins[last + 1]]])

    regions = []  # first leaf, last leaf, new text
    todo = spans[::-1]
    while todo:
        first, last, own = todo.pop()
        while True:
            new = rewritten(first, last, own)
            before = text[max(0, begins[first] - 1) : begins[first]]
            after = text[begins[last + 1] : begins[last + 1] + 2]
            if first > 0 and not _sure(before, new if len(new) > 1 else new + after):
                first -= 1
                if regions and regions[-1][0] <= first <= regions[-1][1]:
                    gone = regions.pop()
                    first, own = gone[0], gone[3] + own
            elif last < n - 1 and not _sure(new or before, after):
                last += 1
                while todo and todo[-1][0] <= last:
                    more = todo.pop()
                    last, own = max(last, more[1]), own + more[2]
            else:
                break
        regions.append((first, last, new, own))

    chars, tokens, again, at, parts = [], [], 0, 0, []
    old = tree.tokens()
    whole = all(len(r[2]) > 0 and r[0] == r[1] and len(r[2]) < 4 * size for r in regions)
    if whole:
        # the leaves stay: only paths to the root change
        kept = Tree(list(tree.chars), list(tree.sums))
        for first, last, new, _ in regions:
            parts += [text[begins[at] : begins[first]], new]
            kept.chars[first] = len(new)
            kept.set(first, encoder.count(new))
            again += len(new)
            at = last + 1
        return "".join([*parts, text[begins[at] :]]), kept, again
    for first, last, new, _ in regions:
        parts += [text[begins[at] : begins[first]], new]
        chars += tree.chars[at:first]
        tokens += old[at:first]
        own = build(new, encoder, size)
        chars += own.chars
        tokens += own.tokens()
        again += len(new)
        at = last + 1
    return "".join([*parts, text[begins[at] :]]), Tree.of(chars + tree.chars[at:], tokens + old[at:]), again


@F.pandas_udf(T.StructType(_TREE))
def tree(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    """Column function: the tree of a whole text.  Null counts as empty and has no leaves."""
    encoder = default_encoder()
    for batch in texts:
        grown = [build(t or "", encoder) for t in batch]
        yield pd.DataFrame({"leaf_chars": [t.chars for t in grown], "leaf_sums": [t.sums for t in grown]})


@F.pandas_udf(EDITED)
def edited(batches: Iterator[tuple[pd.Series, pd.DataFrame, pd.Series]]) -> Iterator[pd.DataFrame]:
    """Column function of text, tree and edits (array of structs ``start, end, replacement``).

    Gives the edited text, its tree and tokens, the edits made, and the characters
    encoded again.  Places are code points of the text before any edit.  Edits are
    cut to the text; one that begins before an earlier one's end is left out, and a
    null replacement is empty.
    """
    encoder = default_encoder()
    for texts, grown, edits in batches:
        rows = []
        for text, chars, sums, own in zip(texts, grown["leaf_chars"], grown["leaf_sums"], edits, strict=True):
            own = in_order([(e["start"], e["end"], e["replacement"]) for e in own] if own is not None else (), len(text or ""))
            new, after, again = update(text or "", Tree([int(c) for c in chars], [int(x) for x in sums]), own, encoder)
            rows.append((new, after.chars, after.sums, after.total, len(own), again))
        yield pd.DataFrame(rows, columns=["text", "leaf_chars", "leaf_sums", "n_tokens", "n_edits", "n_encoded"])


def root(leaf_sums) -> Column:
    """Column: the count of a tree."""
    return F.when(F.size(leaf_sums) > 1, F.get(leaf_sums, 1)).otherwise(0).cast("long")


def gathered(edits: DataFrame) -> DataFrame:
    """Edits ``doc_id, start, end, replacement`` as one array for each document."""
    return edits.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("start", "end", "replacement"))).alias("edits"))


# fixed values: personal data that redaction edits replace
PERSONAL = re.compile(r"(?P<email>[\w.+-]+@[\w-]+\.[\w.-]+)|(?P<ip>\b\d{1,3}(?:\.\d{1,3}){3}\b)|(?P<number>\+?\(?\d[\d() -]{6,}\d)", re.ASCII)


@F.pandas_udf(EDITS)
def redactions(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Column function: edits that replace mail addresses, network addresses and long numbers."""
    for batch in texts:
        yield pd.Series([[{"start": m.start(), "end": m.end(), "replacement": f"[{m.lastgroup.upper()}]"} for m in PERSONAL.finditer(t)] if t else [] for t in batch])


def count_edited(docs: DataFrame, edits: Column) -> DataFrame:
    """Counts before and after edits of each document ``doc_id, text``, one row per row."""
    grown = docs.select("doc_id", "text", edits.alias("edits"), tree("text").alias("tree"))
    done = grown.select("doc_id", "tree", edited("text", "tree", "edits").alias("new"))
    return done.select(
        "doc_id", root(F.col("tree.leaf_sums")).alias("n_tokens_before"), F.col("new.n_tokens").alias("n_tokens"), F.col("new.n_edits").alias("n_edits"),
        F.size("tree.leaf_chars").alias("n_leaves"), F.col("new.n_encoded").alias("n_encoded"), F.length("new.text").alias("n_chars"),
    )
