"""Prefix trie of conversations by ROLLUP over positional columns of turn names.

A conversation becomes a row with the names of its first turns in columns, and one
ROLLUP over these columns aggregates all prefixes together; ``grouping_id`` tells
the depth.  Longer conversations go on in a further block of columns, keyed by the
node that the block before ended in, as long as another conversation shares that
node.  From there on a conversation alone is a chain, whose nodes are read off its
turns without another round, so the number of rounds follows the longest shared
prefix.  Sums over subtrees are a second ROLLUP over the nodes, last block first.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glacierlens.llm.tables import discard, written

# columns of the first block and of all further ones (Spark groups by 64 columns at most)
FIRST_BLOCK = 8
BLOCK = 32
ROOT = "root"
# conversations of one node whose ids are joined before the shuffle to the node
ENDS = 4096


class Trie(NamedTuple):
    """Written tables of a trie.

    ``nodes``: node, parent, depth, turn (name of the last turn), conv_id (smallest member), parent_conv_id, n_convs,
    n_children, n_leaves, saved_tokens; ``ends``: node, conv_id of each conversation, where it ends.
    """

    nodes: DataFrame
    ends: DataFrame


def numbered(turns: DataFrame) -> DataFrame:
    """``conv_id, pos, turn`` from ``conv_id, turn, role, text``: places from 1 and names of turns.

    Turns follow their number, nulls first, then role and SHA-256 of the text; a null
    role or text is empty; a repeated row is a repeated turn; rows without conv_id
    are no conversation.  A name holds 128 bits of the SHA-256 of role and text, and
    the text's UTF-8 bytes.  Rows are sorted by ranges and numbered by range, so a
    conversation with a third of all rows lies in many tasks.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    rows = turns.where("conv_id is not null").select(
        "conv_id", "turn", role.alias("role"), F.sha2(text, 256).alias("digest"), F.octet_length(text).alias("n_bytes")
    )
    order = ["conv_id", F.asc_nulls_first("turn"), "role", "digest"]
    rows = rows.withColumn("row", F.monotonically_increasing_id())
    rows = rows.repartitionByRange(*order, "row").sortWithinPartitions(*order, "row")
    name = F.concat(F.substring(F.sha2(F.concat(F.octet_length("role").cast("string"), F.lit(":"), "role", "digest"), 256), 1, 32), F.lit(":"), "n_bytes")
    at, part = F.monotonically_increasing_id(), F.spark_partition_id()
    rows = written(rows.select("conv_id", name.alias("turn"), at.alias("at"), part.alias("part")), "turns")
    spans = rows.groupBy("conv_id", "part").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    earlier = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    spans = spans.withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0)))
    done = rows.join(spans.drop("n"), ["conv_id", "part"])
    out = written(done.select("conv_id", (F.col("at") - F.col("first") + F.col("before") + 1).alias("pos"), "turn"), "numbered")
    discard(rows)
    return out


def lengths(turns: DataFrame) -> DataFrame:
    """``conv_id, n_turns`` of numbered turns."""
    return turns.groupBy("conv_id").agg(F.max("pos").alias("n_turns"))


def rebuilt(turns: DataFrame, group: int = 5, most: int = 8) -> tuple[DataFrame, DataFrame]:
    """Numbered turns and lengths of conversations that begin like their group's first one.

    Conversation c takes the first h turns of conversation c - c % group (h is the
    CRC-32 of its decimal id modulo ``most`` + 1), then its own turns after its first h.
    """
    own = lengths(turns)
    plan = own.withColumns({"h": F.crc32(F.col("conv_id").cast("string")) % (most + 1), "base": F.col("conv_id") - F.col("conv_id") % group})
    there = own.select(F.col("conv_id").alias("base"), F.col("n_turns").alias("n_base"))
    plan = plan.join(there, "base", "left").withColumn("taken", F.least("h", F.coalesce("n_base", F.lit(0))))
    plan = written(plan.select("conv_id", "base", "h", "taken", (F.col("taken") + F.greatest(F.col("n_turns") - F.col("h"), F.lit(0))).alias("n_turns")), "plan")
    tail = turns.join(plan.select("conv_id", "h", "taken"), "conv_id").where("pos > h")
    heads = turns.where(F.col("pos") <= most).withColumnRenamed("conv_id", "base").join(plan.select("conv_id", "base", "h"), "base").where("pos <= h")
    rows = tail.select("conv_id", (F.col("pos") - F.col("h") + F.col("taken")).alias("pos"), "turn").union(heads.select("conv_id", "pos", "turn"))
    return written(rows, "rebuilt"), plan.select("conv_id", "n_turns")


def _hash(prior: Column, path: Column) -> Column:
    """Key of the node below ``prior`` along ``path``: 128 bits, and ``prior`` itself without a path."""
    key = F.substring(F.sha2(F.concat(prior, F.lit("/"), F.array_join(path, "/")), 256), 1, 32)
    return F.when(F.size(path) == 0, prior).otherwise(key)


def _columns(width: int) -> list[str]:
    return [f"t{i}" for i in range(1, width + 1)]


def _path(width: int, depth: Column) -> Column:
    return F.slice(F.array(*_columns(width)), F.lit(1), depth)


def _wide(members: DataFrame, turns: DataFrame, start: int, width: int) -> DataFrame:
    """A row for each member, the names of its next ``width`` turns in columns (null after its end)."""
    here = turns.where((F.col("pos") > start) & (F.col("pos") <= start + width))
    placed = here.groupBy("conv_id").agg(*[F.max(F.when(F.col("pos") == start + i, F.col("turn"))).alias(f"t{i}") for i in range(1, width + 1)])
    return members.join(placed, "conv_id", "left").select("conv_id", "n_turns", "prior", *_columns(width))


def _depth(width: int) -> Column:
    """Turns of a ROLLUP group within the block; -1 for the group of all rows."""
    return (F.lit(width) - F.bit_count(F.grouping_id())).cast("int")


def _bytes(turn: Column) -> Column:
    return F.coalesce(F.element_at(F.split(turn, ":"), 2).cast("long"), F.lit(0).cast("long"))


def _prefixes(wide: DataFrame, start: int, width: int) -> DataFrame:
    """All prefixes of a block: their members, the longest one's turns, and the bytes they share."""
    cols = _columns(width)
    rolled = wide.rollup("prior", *cols).agg(
        _depth(width).alias("within"), F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.max("n_turns").alias("longest")
    )
    last = F.when(F.col("within") > 0, F.element_at(F.array(*cols), F.greatest("within", F.lit(1))))
    real = (F.col("within") >= 1) & F.col("turn").isNotNull() | (F.col("within") == 0) & F.lit(start == 0)
    nodes = rolled.withColumn("turn", last).where(real)
    path, up = _path(width, F.col("within")), _path(width, F.greatest(F.col("within") - 1, F.lit(0)))
    return nodes.select(
        _hash(F.col("prior"), path).alias("node"),
        F.when(F.col("within") > 0, _hash(F.col("prior"), up)).alias("parent"),
        (F.col("within") + start).cast("long").alias("depth"), "within", "turn", "conv_id", "n_convs", "longest",
        ((F.col("n_convs") - 1) * _bytes(F.col("turn"))).alias("saved"), "prior", *cols,
    )


def _subtrees(nodes: DataFrame, below: DataFrame | None, width: int) -> DataFrame:
    """``node, within, leaves, saved`` of every prefix of a block, sums over its subtree.

    ``below`` has the sums of what follows in the next block, by the node it begins at.
    """
    alone = (F.col("n_convs") == 1) & (F.col("within") == width)
    rows = nodes.withColumn("leaf", ((F.col("longest") == F.col("depth")) | alone).cast("long"))
    if below is not None:
        further = below.select("node", F.col("leaves").alias("more_leaves"), F.col("saved").alias("more_saved"))
        rows = rows.join(further, "node", "left")
        rows = rows.withColumns({"leaf": F.col("leaf") + F.coalesce("more_leaves", F.lit(0)), "saved": F.col("saved") + F.coalesce("more_saved", F.lit(0))})
    cols = _columns(width)
    rolled = rows.rollup("prior", *cols).agg(_depth(width).alias("within"), F.sum("leaf").alias("leaves"), F.sum("saved").alias("saved"))
    there = (F.col("within") == 0) | F.element_at(F.array(*cols), F.greatest("within", F.lit(1))).isNotNull()
    rolled = rolled.where((F.col("within") >= 0) & there)
    return rolled.select(_hash(F.col("prior"), _path(width, F.col("within"))).alias("node"), "within", "leaves", "saved")


def build(turns: DataFrame, conversations: DataFrame) -> Trie:
    """The trie of numbered turns (``conv_id, pos, turn``) and lengths (``conv_id, n_turns``).

    A conversation without turns is a member of the root alone.  Without any
    conversation there is no node.
    """
    members = conversations.select("conv_id", "n_turns", F.lit(ROOT).alias("prior"))
    start, width = 0, FIRST_BLOCK
    blocks, chains, ends = [], [], []
    while True:
        wide = written(_wide(members, turns, start, width), "wide")
        nodes = written(_prefixes(wide, start, width), "nodes")
        blocks.append((nodes, width))
        key = _hash(F.col("prior"), F.array_compact(F.array(*_columns(width)))).alias("node")
        ends.append(wide.where(F.col("n_turns") <= start + width).select(key, "conv_id"))
        onward = wide.where(F.col("n_turns") > start + width).select("conv_id", "n_turns", key)
        full = nodes.where(F.col("within") == width).select("node", "n_convs")
        onward = written(onward.join(full, "node").select("conv_id", "n_turns", F.col("node").alias("prior"), (F.col("n_convs") > 1).alias("shared")), "onward")
        start, width = start + width, BLOCK
        later = turns.where(F.col("pos") > start)
        rest = written(later.join(onward, "conv_id").select("conv_id", "pos", "turn", "n_turns", "shared"), "rest")
        chains.append(rest.where("not shared"))
        members = onward.where("shared").select("conv_id", "n_turns", "prior")
        if members.isEmpty():
            break
        turns = rest.where("shared").select("conv_id", "pos", "turn")
    below, sums = None, []
    for nodes, width in reversed(blocks):
        found = written(_subtrees(nodes, below, width), "subtrees")
        below = found.where("within = 0")
        # a further block's entry is the last node of the block before
        sums.append(found.where("within > 0") if nodes is not blocks[0][0] else found)
    return _assembled(blocks, sums, chains, ends)


def _assembled(blocks, sums, chains, ends) -> Trie:
    def union(parts):
        out = parts[0]
        for part in parts[1:]:
            out = out.unionByName(part)
        return out

    goes_on = (F.col("n_convs") == 1) & (F.col("longest") > F.col("depth"))
    shared = union([n.select("node", "parent", "depth", "turn", "conv_id", "n_convs", (goes_on & (F.col("within") == w)).cast("long").alias("chain")) for n, w in blocks])
    # sums and children of a node come together; both combine before they are shuffled
    zero = F.lit(0).cast("long")
    own = union(sums).select("node", "leaves", "saved", zero.alias("children"))
    up = shared.where("parent is not null").select(F.col("parent").alias("node"), zero.alias("leaves"), zero.alias("saved"), F.lit(1).cast("long").alias("children"))
    facts = own.union(up).groupBy("node").agg(F.sum("leaves").alias("n_leaves"), F.sum("saved").alias("saved_tokens"), F.sum("children").alias("children"))
    above = shared.select(F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    trunk = shared.join(facts, "node").join(above, "parent", "left").select(
        "node", "parent", "depth", "turn", "conv_id", "parent_conv_id", "n_convs", (F.col("children") + F.col("chain")).alias("n_children"), "n_leaves", "saved_tokens"
    )

    def chain(conv, pos):
        return F.concat(F.lit("chain:"), conv.cast("string"), F.lit(":"), pos.cast("string"))

    one, last = F.lit(1).cast("long"), F.col("pos") == F.col("n_turns")
    rest = union(chains)
    tails = rest.select(
        chain(F.col("conv_id"), F.col("pos")).alias("node"), chain(F.col("conv_id"), F.col("pos") - 1).alias("parent"), F.col("pos").alias("depth"), "turn", "conv_id",
        F.col("conv_id").alias("parent_conv_id"), one.alias("n_convs"), (~last).cast("long").alias("n_children"), one.alias("n_leaves"), zero.alias("saved_tokens"),
    )
    stops = rest.where(last).select(chain(F.col("conv_id"), F.col("pos")).alias("node"), "conv_id")
    return Trie(trunk.unionByName(tails), union(ends).union(stops))


def digests(ends: DataFrame) -> DataFrame:
    """``node, ends_sha256`` of nodes where conversations end: SHA-256 of their ids, ascending, comma-joined.

    Ids of a range are joined first.  A node's whole list is one value at the end, as the digest is of one string.
    """
    ids = F.array_join(F.transform(F.array_sort(F.collect_list("conv_id")), lambda c: c.cast("string")), ",")
    parts = ends.groupBy("node", F.floor(F.col("conv_id") / ENDS).alias("range")).agg(F.min("conv_id").alias("low"), ids.alias("ids"))
    whole = F.transform(F.array_sort(F.collect_list(F.struct("low", "ids"))), lambda p: p["ids"])
    return parts.groupBy("node").agg(F.sha2(F.array_join(whole, ","), 256).alias("ends_sha256"))


#: DuckDB SQL for the query on the table ``conversations``; a node is its smallest member and its depth.
#: CRC-32 is computed bit by bit, as DuckDB has no such function.
SQL = """
with recursive said as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations where conv_id is not null),
own as (
  select conv_id, row_number() over (partition by conv_id order by turn nulls first, role, sha256(text)) as pos, role, text from said),
n_own as (select conv_id, max(pos) as n from own group by 1),
crc as (
  select conv_id, cast(conv_id as varchar) as s, 1 as i, 0 as bit, xor(cast(4294967295 as bigint), ascii(substr(cast(conv_id as varchar), 1, 1))) as c from n_own
  union all
  select conv_id, s, case when bit = 7 then i + 1 else i end, case when bit = 7 then 0 else bit + 1 end,
    xor(xor(c >> 1, case when c % 2 = 1 then cast(3988292384 as bigint) else 0 end), case when bit = 7 and i < length(s) then ascii(substr(s, i + 1, 1)) else 0 end)
  from crc where i <= length(s)),
cut as (select conv_id, xor(c, cast(4294967295 as bigint)) % 9 as h, conv_id - conv_id % 5 as base from crc where i > length(s)),
plan as (
  select c.conv_id, c.base, c.h, least(c.h, coalesce(b.n, 0)) as taken from cut c left join n_own b on b.conv_id = c.base),
turns as (
  select p.conv_id, o.pos, o.role, o.text from plan p join own o on o.conv_id = p.base and o.pos <= p.h
  union all
  select p.conv_id, o.pos - p.h + p.taken, o.role, o.text from plan p join own o on o.conv_id = p.conv_id and o.pos > p.h),
names as (select conv_id, pos, sha256(length(role) || ':' || role || text) as name, strlen(text) as n_bytes from turns),
paths as (
  select conv_id, pos as depth, n_bytes, string_agg(name, '/') over (partition by conv_id order by pos rows between unbounded preceding and current row) as path from names
  union all
  select conv_id, 0, 0, '' from n_own),
totals as (select conv_id, max(depth) as n_turns from paths group by 1),
groups as (
  select depth, path, min(p.conv_id) as conv_id, count(*) as n_convs, max(n_bytes) as n_bytes, max(n_turns) as longest,
    coalesce(string_agg(cast(p.conv_id as varchar), ',' order by p.conv_id) filter (where n_turns = depth), '') as ends
  from paths p join totals t on t.conv_id = p.conv_id group by 1, 2),
member as (select p.conv_id, p.depth, g.conv_id as node from paths p join groups g on g.depth = p.depth and g.path = p.path),
nodes as (select g.*, m.node as parent from groups g left join member m on m.conv_id = g.conv_id and m.depth = g.depth - 1),
children as (select parent, depth - 1 as depth, count(*) as n from nodes where depth > 0 group by 1, 2),
sums as (
  select m.node, m.depth, count(*) filter (where n.longest = n.depth) as n_leaves, sum((n.n_convs - 1) * n.n_bytes) as saved
  from nodes n join member m on m.conv_id = n.conv_id and m.depth <= n.depth group by 1, 2)
select n.conv_id, cast(n.depth as bigint) as depth, n.parent as parent_conv_id, n.n_convs, coalesce(c.n, 0) as n_children,
  s.n_leaves, cast(s.saved as bigint) as saved_tokens, sha256(n.ends) as ends_sha256
from nodes n join sums s on s.node = n.conv_id and s.depth = n.depth left join children c on c.parent = n.conv_id and c.depth = n.depth
"""
