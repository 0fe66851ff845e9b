"""The prefix trie against a plain trie built turn by turn."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from glacierlens.llm import prefix_trie, queries

SCHEMA = "conv_id long, turn long, role string, text string, node string, pos string"


def ordered(rows):
    """conv_id to its turns (role, text) in order."""
    by = defaultdict(list)
    for c, turn, role, text, *_ in rows:
        if c is not None:
            by[c].append((turn is not None, turn or 0, role or "", hashlib.sha256((text or "").encode()).hexdigest(), text or ""))
    return {c: [(t[2], t[4]) for t in sorted(x)] for c, x in by.items()}


def rebuild(own):
    out = {}
    for c in own:
        h, base = zlib.crc32(str(c).encode()) % 9, c - (abs(c) % 5) * (1 if c >= 0 else -1)
        out[c] = own.get(base, [])[:h] + own[c][h:]
    return out


def plain(convs):
    members = defaultdict(list)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    children = defaultdict(list)
    for path in members:
        if path:
            children[path[:-1]].append(path)
    leaves, saved = {}, {}
    for path in sorted(members, key=len, reverse=True):
        below = children[path]
        leaves[path] = sum(leaves[p] for p in below) or 1
        saved[path] = sum(saved[p] for p in below) + ((len(members[path]) - 1) * len(path[-1][1].encode()) if path else 0)
    rows = []
    for path, ids in members.items():
        ends = sorted(c for c in ids if len(convs[c]) == len(path))
        digest = hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest()
        up = min(members[path[:-1]]) if path else None
        rows.append((min(ids), len(path), up, len(ids), len(children[path]), leaves[path], saved[path], digest))
    return sorted(rows, key=str)


def found(trie):
    nodes = trie.nodes.join(prefix_trie.digests(trie.ends), "node", "left").withColumn("e", F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)))
    rows = nodes.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "e").collect()
    return sorted(map(tuple, rows), key=str)


def sample(rnd):
    """Short talks, copies of a long one that part late, a very long one alone, gaps and repeated rows."""
    long = [(rnd.choice(["user", "assistant"]), f"line {i} é" * (i % 3)) for i in range(90)]
    rows = []

    def add(c, turns, first=0):
        rows.extend((c, first + i, role, text, "x", "y") for i, (role, text) in enumerate(turns))

    for c in range(-7, 40):
        add(c, [(rnd.choice(["a", "b", None]), rnd.choice(["x", "", None, "same words"])) for _ in range(rnd.randint(1, 12))])
    for c in range(100, 112):
        add(c, long[: rnd.choice([7, 8, 9, 40, 41, 72, 73, 90])] + ([("user", "own end")] if c % 2 else []))
    add(200, [("user", str(i % 7)) for i in range(700)])
    add(201, long + long)
    rows += [(300, None, "user", "no number", "x", "y"), (300, None, "user", "no number", "x", "y"), (300, 2, None, None, "x", "y")]
    rows += [(301, 1, "user", "tie b", "x", "y"), (301, 1, "user", "tie a", "x", "y"), (301, 1, "assistant", "tie", "x", "y")]
    rows += [(None, 1, "user", "nobody", "x", "y")] * 5
    # conversations whose own turns all fall to the beginning of an absent one
    rows += [(c, 0, "user", "gone", "x", "y") for c in (7001, 7002, 7003, 7004)]
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_trie_of_given_conversations(spark, seed):
    rows = sample(random.Random(seed))
    turns = prefix_trie.numbered(spark.createDataFrame(rows, SCHEMA).repartition(3))
    assert found(prefix_trie.build(turns, prefix_trie.lengths(turns))) == plain(ordered(rows))


def test_trie_of_rebuilt_conversations(spark):
    rows = sample(random.Random(3))
    turns = prefix_trie.numbered(spark.createDataFrame(rows, SCHEMA))
    convs = rebuild(ordered(rows))
    assert any(not t for t in convs.values())
    assert found(prefix_trie.build(*prefix_trie.rebuilt(turns))) == plain(convs)


def test_names_keep_role_and_text_apart(spark):
    rows = [(1, 0, "ab", "c", "", ""), (2, 0, "a", "bc", "", ""), (3, 0, "", "abc", "", ""), (4, 0, "ab", "c", "", "")]
    turns = prefix_trie.numbered(spark.createDataFrame(rows, SCHEMA))
    assert turns.select("turn").distinct().count() == 3


def test_conversation_over_many_partitions(spark):
    """A conversation with most rows is numbered in several tasks, without gap or double."""
    rows = [(1, i // 2, "u", f"t{i}", "", "") for i in range(3000)] + [(c, 0, "u", "t", "", "") for c in range(2, 40)]
    turns = prefix_trie.numbered(spark.createDataFrame(rows, SCHEMA).repartition(4))
    assert [r.pos for r in turns.where("conv_id = 1").orderBy("pos").collect()] == list(range(1, 3001))
    assert turns.where("conv_id > 1 and pos <> 1").count() == 0


def test_no_conversations(spark, tmp_path):
    spark.createDataFrame([(None, 1, "a", "b", "", "")], SCHEMA).where("false").write.parquet(str(tmp_path / "conversations.parquet"))
    assert queries.op13_prefix_trie(spark, str(tmp_path)).count() == 0
