"""Plain versions of the operators for comparison."""

import hashlib
import re
import struct
import zlib
from collections import defaultdict

SPACE = "\x20\x09\x0a\x0b\x0c\x0d"


def words(text):
    return re.findall(rf"[^{SPACE}]+", text or "")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def shingles(text):
    w = words(lower(text))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def components(docs):
    """doc_id to smallest linked id; every pair is compared."""
    sets = {d: shingles(t) for d, t in docs}
    up = {d: d for d in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                up[max(x, y)] = min(x, y)
    return {d: find(d) for d in ids}, {d: len(s) for d, s in sets.items()}


def substring(docs):
    """doc_id to words, removed words and the digest of the rest."""
    first = {}
    for d, t in sorted(docs):
        w = words(t)
        for i in range(len(w) - 12):
            first.setdefault(tuple(w[i : i + 13]), d)
    out = {}
    for d, t in docs:
        w, gone = words(t), set()
        for i in range(len(w) - 12):
            if first[tuple(w[i : i + 13])] < d:
                gone.update(range(i, i + 13))
        rest = " ".join(x for i, x in enumerate(w) if i not in gone)
        out[d] = (len(w), len(gone), hashlib.sha256(rest.encode()).hexdigest())
    return out


def base_counts(text):
    text = text or ""
    w = words(text)
    seen, dup, where, covered = set(), 0, defaultdict(list), set()
    for line in text.split("\n"):
        if words(line):
            dup += line in seen
            seen.add(line)
    for i in range(len(w) - 4):
        where[tuple(w[i : i + 5])].append(i)
    for at in where.values():
        if len(at) > 1:
            for i in at:
                covered.update(range(i, i + 5))
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered)


ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)


def base_spans(text):
    text = text or ""
    a = [(m.start(), 0, "assign", m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    k = [(m.start(), 1, "access", m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    h = [(m.start(), 2, "hex", m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    spans = ",".join(f"{kind}:{start}:{end}" for start, _, kind, end in sorted(a + k + h))
    return len(a), len(k), len(h), hashlib.sha256(spans.encode()).hexdigest()


def pieces(text, tokenizer):
    """(piece, start, length, crc32) by the contract's tokenizer."""
    ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 0]
    cuts, at = [], len(ids) % 2048 or 2048
    cuts = [0, *range(at, len(ids) + 1, 2048)]
    return [(i, a, b - a, zlib.crc32(struct.pack(f"<{b - a}I", *ids[a:b]))) for i, (a, b) in enumerate(zip(cuts, cuts[1:]))]
