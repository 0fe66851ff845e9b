"""Secrets in texts: fixed patterns, and strings that a tokenizer finds dear.

Ordinary words take few tokens for their length under a trained vocabulary;
random strings take many.  A long run of key characters with few characters per
token is reported, unless it is a known digest or identifier, holds digits and
separators alone.  Of a run that the patterns report in part, what is left on
either side is judged.  A run that groups of
letters and groups of digits make up, as in paths, names and dates, is judged by
its letter groups: by each long one, and by all but the shortest together.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from glacierlens.llm.tokens import default_encoder

# fixed values: the base patterns, in order of kinds
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
KINDS = ("assign", "access", "hex", "dense")
LEAST = {"assign": 6, "access": 20, "hex": 24}

# a run of key characters is a candidate from this length
RUN = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
# beside a pattern's match the rest of a run is judged from this length
BESIDE = 12
# and reported up to this many characters per token
CHARS_PER_TOKEN = 1.9
# digest lengths in hex digits (MD5, SHA-1, SHA-2) and the form of a UUID
DIGESTS = (32, 40, 56, 64, 96, 128)
UUID = re.compile(r"[0-9A-Fa-f]{8}-(?:[0-9A-Fa-f]{4}-){3}[0-9A-Fa-f]{12}")
DIGEST = re.compile(r"[0-9A-Fa-f]+")
# grouped runs: every part between separators is all letters or all digits
WORDS = re.compile(r"(?:[A-Za-z]+|[0-9]+)(?:[+/_=-]+(?:[A-Za-z]+|[0-9]+))+[+/_=-]*")
LETTERS = re.compile(r"[A-Za-z]+")
# a letter group is judged alone from this length, and with the others from these lengths (each, and in all)
LONG_GROUP = 12
LEAST_GROUP, LEAST_GROUPS = 4, 16

SPANS = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """``(start, kind number, end)`` of the pattern matches, in order."""
    spans = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= LEAST["assign"]] if ":" in text or "=" in text else []
    if "AKIA" in text:
        spans += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST["access"]]
    spans += [(m.start(), 2, m.end()) for m in _LONG_HEX.finditer(text)]
    return sorted(spans)


# a maximal run of hex digits that is long enough: the same matches as HEX with the short ones dropped
_LONG_HEX = re.compile(r"[0-9a-f]{%d,}" % LEAST["hex"])


def _dense(run: str, encoder) -> bool:
    if not WORDS.fullmatch(run):
        return len(run) <= CHARS_PER_TOKEN * encoder.count(run)
    groups = [(len(g), encoder.count(g)) for g in LETTERS.findall(run) if len(g) >= LEAST_GROUP]
    if any(size >= LONG_GROUP and size <= CHARS_PER_TOKEN * n for size, n in groups):
        return True
    size, n = sum(g[0] for g in groups), sum(g[1] for g in groups)
    return size >= LEAST_GROUPS and size <= CHARS_PER_TOKEN * n


def _parts(text: str, base: list[tuple[int, int, int]]) -> Iterator[tuple[int, int]]:
    """Runs of key characters, without what base spans cover; what is left beside one may be shorter."""
    for m in RUN.finditer(text):
        at, end = m.span()
        for start, _, stop in base:
            if stop <= at or start >= end:
                continue
            if start - at >= BESIDE:
                yield at, start
            at = max(at, min(stop, end))
        if end - at >= (BESIDE if at > m.start() else end - m.start()):
            yield at, end


def dense_spans(text: str, base: list[tuple[int, int, int]], encoder) -> list[tuple[int, int, int]]:
    """Runs with few characters per token, apart from what base spans cover."""
    found = []
    for start, end in _parts(text, base):
        run = text[start:end]
        if run.isdigit() or UUID.fullmatch(run) or len(run) in DIGESTS and DIGEST.fullmatch(run):
            continue
        if _dense(run, encoder):
            found.append((start, 3, end))
    return found


def scan(text: str | None, encoder) -> list[tuple[str, int, int]]:
    """All spans of a whole text by start, then kind; code points, end exclusive.  Null counts as empty."""
    if not text:
        return []
    base = base_spans(text)
    return [(KINDS[k], start, end) for start, k, end in sorted(base + dense_spans(text, base, encoder))]


@F.pandas_udf(SPANS)
def secret_spans(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Column function: text to an array of structs ``kind, start, end``."""
    encoder = default_encoder()
    for batch in texts:
        yield pd.Series([scan(t, encoder) for t in batch])


def redact(text, spans, mark: str = "[SECRET]"):
    """Column: the text with every span replaced by ``mark``; overlapping spans become one mark."""
    ends = F.aggregate(
        spans,
        F.struct(F.lit("").alias("out"), F.lit(0).alias("at")),
        lambda acc, s: F.when(s["start"] >= acc["at"], F.struct(F.concat(acc["out"], F.substring(text, acc["at"] + 1, s["start"] - acc["at"]), F.lit(mark)).alias("out"), s["end"].alias("at"))).otherwise(
            F.struct(acc["out"].alias("out"), F.greatest(acc["at"], s["end"]).alias("at"))
        ),
        lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text))),
    )
    return F.when(text.isNull(), text).otherwise(ends)


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def digest(spans: list[tuple[str, int, int]]) -> str:
    return hashlib.sha256(joined(spans).encode()).hexdigest()
