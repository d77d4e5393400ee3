"""Prefix trie of conversations: what many of them begin with, and what sharing it saves.

A node is a distinct sequence of first turns (role, text); the root has none. Each turn is a digest of 16 bytes, a
conversation the string of its digests, and the order of these strings is the order of a walk through the trie in
which parents come first. So conversations are sorted by range over the cluster (copies of one conversation are
divided by id), and every task cuts its run into shards of at most `SHARD` conversations. A shard holds its part of the
trie as balanced parentheses: an opening one where the walk enters a node, a closing one where it leaves. A tree of
least and greatest excess over blocks finds the closing partner of every opening one, which delimits the subtree;
the rank of pairs "()" counts leaves, running sums give members and savings.

Only nodes on the way to a shard's first or last conversation can be in other shards as well. These spines, one row
for each shard, are merged in one task: parts of members, children, leaves and savings are added, and what only the
merged node decides (is it a leaf, what does it save) is counted there once. It is the one place where something of all
shards meets; it grows with the number of shards, at most two conversations' lengths for each. Ids that end at such
nodes travel as ready text of one shard each, and are hashed in order, node by node.

Turns stand by turn (nulls first), at equal turns by role and digest; a null role or text is empty. Rows without
conv_id take no part; repeated rows are turns of their own; a conversation is one row of 24 bytes for each turn and must
fit a row. An empty table gives an empty table; only the four named columns are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from phantomlake.llm.common import crc32_sql, small_batches, written

WIDTH = 16
SHARD, SHARD_TURNS = 50_000, 1_000_000
#: Parentheses of one block of the excess tree.
BLOCK = 64
NODE_COLUMNS = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens")
EMPTY_SHA = hashlib.sha256(b"").hexdigest()


class Parentheses:
    """A sequence of parentheses (1 opens, 0 closes) with the least and greatest excess of its blocks."""

    def __init__(self, bits: np.ndarray):
        self.bits, self.opens = bits, np.flatnonzero(bits)
        self.excess = np.cumsum(bits.astype(np.int64) * 2 - 1)
        n_blocks = max(1, -(-len(bits) // BLOCK))
        self.blocks = np.full((n_blocks, BLOCK), self.excess[-1] if len(bits) else 0)
        self.blocks.ravel()[: len(bits)] = self.excess
        self.least, self.greatest = [self.blocks.min(axis=1)], [self.blocks.max(axis=1)]
        while len(self.least[-1]) > 1:
            for levels, merge, odd in ((self.least, np.minimum, np.iinfo(np.int64).max), (self.greatest, np.maximum, np.iinfo(np.int64).min)):
                x = levels[-1] if len(levels[-1]) % 2 == 0 else np.append(levels[-1], odd)
                levels.append(merge(x[::2], x[1::2]))

    def find_close(self) -> np.ndarray:
        """The position of the closing partner of every opening parenthesis: the next one with an excess one less."""
        want = self.excess[self.opens] - 1
        out = np.full(len(self.opens), -1)
        at, alive = self.opens + 1, np.arange(len(self.opens))
        far = []
        while len(alive):  # in the block where it opens
            left = at[alive] % BLOCK == 0
            far.append(alive[left])
            alive = alive[~left]
            hit = self.excess[at[alive]] == want[alive]
            out[alive[hit]] = at[alive[hit]]
            alive = alive[~hit]
            at[alive] += 1
        far = np.concatenate(far) if far else alive
        if len(far):
            block = self._block_from(at[far] // BLOCK, want[far])
            for a in range(0, len(far), 50_000):
                some, which = far[a : a + 50_000], block[a : a + 50_000]
                out[some] = which * BLOCK + (self.blocks[which] <= want[some, None]).argmax(axis=1)
        return out

    def _block_from(self, start: np.ndarray, want: np.ndarray) -> np.ndarray:
        """The first block at or after `start` that reaches down to `want`."""
        node, found, level_of = start.copy(), np.full(len(start), -1), np.zeros(len(start), np.int64)
        open_ = np.arange(len(start))
        for k, least in enumerate(self.least):  # up, until a node to the right (or the first one itself) reaches it
            known = open_[node[open_] < len(least)]
            hit = known[(least[node[known]] <= want[known]) & (self.greatest[k][node[known]] >= want[known])]
            found[hit], level_of[hit] = node[hit], k
            open_ = open_[found[open_] < 0]
            node[open_] = (node[open_] + 1) // 2  # an odd node's right neighbour is its parent's right neighbour
        for k in range(len(self.least) - 1, 0, -1):  # down, to the leftmost child that reaches it
            at = np.flatnonzero(level_of == k)
            child = found[at] * 2
            found[at] = child + (self.least[k - 1][child] > want[at])
            level_of[at] = k - 1
        return found


class Shard:
    """Sorted conversations as a trie; add() them, then finish()."""

    def __init__(self):
        self.bits, self.parent, self.digest, self.n_bytes, self.depth = [1], [-1], [b""], [0], [0]
        self.stack, self.last, self.first_path = [0], b"", None
        self.ends, self.ids = [], []  # (node, first row) where ids of another node begin

    def add(self, key: bytes, lengths: list[int], conv_id: int) -> None:
        if not self.ids or key != self.last:
            same, most = 0, min(len(key), len(self.last))
            while same < most and key[same : same + WIDTH] == self.last[same : same + WIDTH]:
                same += WIDTH
            same //= WIDTH
            self.bits += [0] * (len(self.stack) - 1 - same)
            del self.stack[same + 1 :]
            for d in range(same, len(lengths)):
                self.parent.append(self.stack[-1])
                self.stack.append(len(self.digest))
                self.digest.append(key[d * WIDTH : (d + 1) * WIDTH])
                self.n_bytes.append(lengths[d])
                self.depth.append(d + 1)
                self.bits.append(1)
            self.last = key
            self.ends.append((self.stack[-1], len(self.ids)))
            if self.first_path is None:
                self.first_path = list(self.stack)
        self.ids.append(conv_id)

    def finish(self) -> tuple[dict[str, np.ndarray], list[dict], list[tuple[int, int, bytes]]]:
        """(columns of the nodes that no other shard can have, the spine, (slot, first id, ids as text) of its ends)."""
        brackets = Parentheses(np.array(self.bits + [0] * len(self.stack), np.uint8))
        parent, depth, n_bytes = np.array(self.parent), np.array(self.depth), np.array(self.n_bytes, np.int64)
        n, opens = len(parent), brackets.opens
        to = np.arange(n) + (brackets.find_close() - opens + 1) // 2  # end of the subtree among nodes in walking order
        ids, nodes, starts = np.array(self.ids, np.int64), np.array([x for x, _ in self.ends]), np.array([x for _, x in self.ends])
        stops = np.append(starts[1:], len(ids))
        members, least = np.zeros(n + 1, np.int64), np.full(n, np.iinfo(np.int64).max)
        members[nodes + 1] = stops - starts
        members = np.cumsum(members)
        n_convs = members[to] - members[np.arange(n)]
        least[nodes] = ids[starts]
        order = np.argsort(depth, kind="stable")
        cuts = np.searchsorted(depth[order], np.arange(depth.max() + 2))
        for d in range(int(depth.max()), 0, -1):
            at = order[cuts[d] : cuts[d + 1]]
            np.minimum.at(least, parent[at], least[at])
        spine = np.unique(np.array(self.first_path + self.stack))
        lone = np.ones(n, bool)
        lone[spine] = False
        leaf = (np.append(brackets.bits[1:], 0)[opens] == 0) & lone
        rank = np.append(0, np.cumsum(leaf))
        saved = np.append(0, np.cumsum(np.where(lone, (n_convs - 1) * n_bytes, 0)))
        found = {
            "conv_id": least, "depth": depth, "n_convs": n_convs, "n_children": np.bincount(parent[1:][lone[1:]], minlength=n),
            "n_leaves": rank[to] - rank[np.arange(n)], "saved_tokens": saved[to] - saved[np.arange(n)],
        }
        slot_of = np.full(n, -1)
        slot_of[spine] = np.arange(len(spine))
        ends = np.full(n, EMPTY_SHA, object)
        texts = []
        for node, a, z in zip(nodes.tolist(), starts.tolist(), stops.tolist(), strict=True):
            text = ",".join(map(str, self.ids[a:z])).encode()
            if lone[node]:
                ends[node] = hashlib.sha256(text).hexdigest()
            else:
                texts.append((int(slot_of[node]), self.ids[a], text))
        up = np.where(parent >= 0, slot_of[parent], -1)
        own = {k: v[lone] for k, v in found.items()}
        own |= {"parent_conv_id": least[parent[lone]], "slot": up[lone], "ends_sha256": ends[lone]}
        slots = [{"up": int(up[i]), "digest": self.digest[i], "n_bytes": int(n_bytes[i])} | {k: int(found[k][i]) for k in found if k != "depth"} for i in spine.tolist()]
        return own, slots, texts


_SLOT = pa.struct([("up", pa.int32()), ("digest", pa.binary()), *((c, pa.int64()) for c in ("n_bytes", "conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens"))])
#: kind 0: a node; 1: a shard's spine; 2: ids that end at a spine's node, as text.
_SHARDS = pa.schema([("kind", pa.int32()), ("shard", pa.int64()), ("slot", pa.int32()), *((c, pa.int64()) for c in NODE_COLUMNS), ("ends_sha256", pa.string()), ("ids", pa.binary()), ("spine", pa.list_(_SLOT))])
SHARDS = "kind int, shard long, slot int, " + ", ".join(f"{c} long" for c in NODE_COLUMNS) + ", ends_sha256 string, ids binary, spine array<struct<up int, digest binary, n_bytes long, conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long>>"


def _shaped(columns: dict[str, list | np.ndarray], rows: int, schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], type=f.type) if f.name in columns else pa.nulls(rows, f.type) for f in schema], schema=schema)


def _shard_rows(shard: Shard, number: int) -> Iterator[pa.RecordBatch]:
    own, spine, texts = shard.finish()
    n = len(own["conv_id"])
    for a in range(0, n, 10_000):
        some = {k: v[a : a + 10_000] for k, v in own.items()}
        some["parent_conv_id"] = pa.array(some["parent_conv_id"], pa.int64(), mask=some["slot"] >= 0)
        some["slot"] = pa.array(some["slot"], pa.int32(), mask=some["slot"] < 0)
        m = len(some["conv_id"])
        yield _shaped(some | {"kind": np.zeros(m, np.int32), "shard": np.full(m, number)}, m, _SHARDS)
    yield _shaped({"kind": [1], "shard": [number], "spine": [spine]}, 1, _SHARDS)
    for slot, first, text in texts:
        yield _shaped({"kind": [2], "shard": [number], "slot": [slot], "conv_id": [first], "ids": [text]}, 1, _SHARDS)


def _sharded(most: int, most_turns: int):
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, shard = TaskContext.get().partitionId() << 32, Shard()
        for part in parts:
            for conv_id, key, lengths in zip(*(part.column(c).to_pylist() for c in ("conv_id", "key", "lengths")), strict=True):
                if len(shard.ids) >= most or len(shard.digest) >= most_turns:
                    yield from _shard_rows(shard, number)
                    number, shard = number + 1, Shard()
                shard.add(key, lengths, conv_id)
        if shard.ids:
            yield from _shard_rows(shard, number)

    return run


#: kind 0: a merged node; 1: what a shard's slots are: nodes and their smallest members.
_MERGED = pa.schema([("kind", pa.int32()), ("node", pa.int64()), *((c, pa.int64()) for c in NODE_COLUMNS), ("shard", pa.int64()), ("nodes", pa.list_(pa.int64())), ("least", pa.list_(pa.int64()))])
MERGED = "kind int, node long, " + ", ".join(f"{c} long" for c in NODE_COLUMNS) + ", shard long, nodes array<long>, least array<long>"


def merged_spines(shards: list[tuple[int, list[dict]]]) -> tuple[dict[str, list], list[list[int]]]:
    """(columns of the merged nodes, for each shard the nodes of its slots)."""
    known, parent, n_bytes, depth = {}, [], [], []
    total = {k: [] for k in ("conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens")}
    slots_of = []
    for _, spine in shards:
        slots = []
        for x in spine:
            up = slots[x["up"]] if x["up"] >= 0 else -1
            node = known.setdefault((up, x["digest"]), len(parent))
            if node == len(parent):
                parent.append(up)
                depth.append(depth[up] + 1 if up >= 0 else 0)
                n_bytes.append(x["n_bytes"])
                for k in total:
                    total[k].append(x[k])
            else:
                for k in total:
                    total[k][node] = min(total[k][node], x[k]) if k == "conv_id" else total[k][node] + x[k]
            slots.append(node)
        slots_of.append(slots)
    for up in parent:
        if up >= 0:
            total["n_children"][up] += 1
    for node in range(len(parent) - 1, -1, -1):  # parents have smaller numbers than their children
        total["n_leaves"][node] += total["n_children"][node] == 0
        total["saved_tokens"][node] += (total["n_convs"][node] - 1) * n_bytes[node]
    # parts that shards counted below a node already hold all but the spine's own; these go up to every ancestor
    own_leaf = [int(c == 0) for c in total["n_children"]]
    own_saved = [(c - 1) * b for c, b in zip(total["n_convs"], n_bytes, strict=True)]
    below_leaf, below_saved = own_leaf[:], own_saved[:]
    for node in range(len(parent) - 1, 0, -1):
        below_leaf[parent[node]] += below_leaf[node]
        below_saved[parent[node]] += below_saved[node]
    for node in range(len(parent)):
        total["n_leaves"][node] += below_leaf[node] - own_leaf[node]
        total["saved_tokens"][node] += below_saved[node] - own_saved[node]
    return total | {"depth": depth, "parent_conv_id": [total["conv_id"][up] if up >= 0 else None for up in parent]}, slots_of


def _merge(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    shards = [x for part in parts for x in zip(part.column("shard").to_pylist(), part.column("spine").to_pylist(), strict=True)]
    if shards:
        columns, slots = merged_spines(shards)
        n = len(columns["conv_id"])
        yield _shaped(columns | {"kind": [0] * n, "node": list(range(n))}, n, _MERGED)
        least = [[columns["conv_id"][i] for i in x] for x in slots]
        yield _shaped({"kind": [1] * len(shards), "shard": [x for x, _ in shards], "nodes": slots, "least": least}, len(shards), _MERGED)


def _hashed(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("node", pa.int64()), ("ends_sha256", pa.string())])
    now, digest = None, None
    for part in parts:
        for node, ids in zip(part.column("node").to_pylist(), part.column("ids").to_pylist(), strict=True):
            if node != now:
                if now is not None:
                    yield _shaped({"node": [now], "ends_sha256": [digest.hexdigest()]}, 1, schema)
                now, digest = node, hashlib.sha256(ids)
            else:
                digest.update(b"," + ids)
    if now is not None:
        yield _shaped({"node": [now], "ends_sha256": [digest.hexdigest()]}, 1, schema)


def turn_lists(conversations: DataFrame) -> DataFrame:
    """conv_id and its turns in order as an array of (digest, n_bytes)."""
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    digest = F.substring(F.unhex(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256)), 1, WIDTH)
    rows = conversations.filter(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"), F.struct(F.col("turn").cast("long").alias("turn"), role.alias("role"), digest.alias("digest"), F.octet_length(text).cast("long").alias("n_bytes")).alias("x")
    )
    ordered = F.sort_array(F.collect_list("x"))
    return rows.groupBy("conv_id").agg(F.transform(ordered, lambda x: F.struct(x["digest"].alias("digest"), x["n_bytes"].alias("n_bytes"))).alias("turns"))


def rebuilt(lists: DataFrame, family: int = 5, most: int = 9) -> DataFrame:
    """Every conversation with the first turns of the first one of its family (ids in steps of `family`) in place of its own."""
    heads = lists.filter(F.col("conv_id") % family == 0).select(F.col("conv_id").alias("base"), F.slice("turns", 1, most - 1).alias("head"))
    own = lists.select("conv_id", "turns", (F.col("conv_id") - F.col("conv_id") % family).alias("base"), (F.crc32(F.col("conv_id").cast("string").cast("binary")) % most).cast("int").alias("h"))
    joined = own.join(heads, "base", "left")
    head = F.when(F.col("head").isNull(), F.slice("turns", 1, 0)).otherwise(F.slice("head", F.lit(1), F.col("h")))
    tail = F.slice("turns", F.col("h") + 1, F.greatest(F.size("turns") - F.col("h"), F.lit(0)))
    return joined.select("conv_id", F.concat(head, tail).alias("turns"))


def trie(lists: DataFrame, shard: int = SHARD, shard_turns: int = SHARD_TURNS) -> DataFrame:
    """The nodes of the trie of (conv_id, turns), as turn_lists and rebuilt give them."""
    small_batches(lists.sparkSession)
    key = F.unhex(F.array_join(F.transform("turns", lambda x: F.hex(x["digest"])), ""))
    keyed = lists.select("conv_id", key.alias("key"), F.transform("turns", lambda x: x["n_bytes"]).alias("lengths"))
    ordered = keyed.repartitionByRange("key", "conv_id").sortWithinPartitions("key", "conv_id")
    shards = written(ordered.mapInArrow(_sharded(shard, shard_turns), SHARDS), "trie-shards")
    merged = written(shards.filter("kind = 1").select("shard", "spine").repartition(1).mapInArrow(_merge, MERGED), "trie-spines")
    slots = merged.filter("kind = 1").select("shard", "nodes", "least")
    at = lambda c: F.get(c, F.col("slot"))
    inner = shards.filter("kind = 0").join(slots, "shard", "left").withColumn("parent_conv_id", F.coalesce("parent_conv_id", at("least")))
    chunks = shards.filter("kind = 2").join(slots, "shard").select(at("nodes").alias("node"), "conv_id", "ids")
    ends = chunks.repartition("node").sortWithinPartitions("node", "conv_id").mapInArrow(_hashed, "node long, ends_sha256 string")
    spine = merged.filter("kind = 0").drop("shard").join(ends, "node", "left").withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(EMPTY_SHA)))
    return inner.select(*NODE_COLUMNS, "ends_sha256").unionByName(spine.select(*NODE_COLUMNS, "ends_sha256"))


def conversation_trie(conversations: DataFrame) -> DataFrame:
    """The trie of all rebuilt conversations."""
    return trie(rebuilt(turn_lists(conversations)))


def oracle_sql() -> str:
    """conversation_trie in DuckDB: nodes by the digests of all their turns, subtrees by every pair of a node and one above it."""
    return f"""
WITH o AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS p, coalesce(role, '') AS r, coalesce(text, '') AS t
  FROM conversations WHERE conv_id IS NOT NULL
), ids AS (SELECT conv_id, conv_id::VARCHAR AS name FROM (SELECT DISTINCT conv_id FROM o)
), h AS (SELECT conv_id, conv_id - conv_id % 5 AS base, {crc32_sql("name")} % 9 AS h FROM ids
), head AS (SELECT h.conv_id, o.p AS d, r, t FROM h JOIN o ON o.conv_id = h.base WHERE o.p <= h.h
), turns AS (
  SELECT * FROM head
  UNION ALL
  SELECT o.conv_id, p - h + coalesce(n, 0) AS d, r, t FROM o JOIN h USING (conv_id) LEFT JOIN (SELECT conv_id, count(*) AS n FROM head GROUP BY 1) USING (conv_id) WHERE p > h
), paths AS (
  SELECT conv_id, d, strlen(t) AS b, array_to_string(list(md5(strlen(r) || ':' || r || t)) OVER (PARTITION BY conv_id ORDER BY d), '') AS k FROM turns
  UNION ALL
  SELECT conv_id, 0, 0, '' FROM h
), ends AS (SELECT k, string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) AS e FROM (SELECT *, max(d) OVER (PARTITION BY conv_id) AS last FROM paths) WHERE d = last GROUP BY k
), nodes AS (SELECT k, min(conv_id) AS conv_id, max(d) AS d, max(b) AS b, count(*) AS n FROM paths GROUP BY k
), children AS (SELECT substr(k, 1, length(k) - 32) AS k, count(*) AS n FROM nodes WHERE k <> '' GROUP BY 1
), full_nodes AS (SELECT n.*, coalesce(c.n, 0) AS n_children FROM nodes n LEFT JOIN children c USING (k)
), below AS (
  SELECT a.k, sum((x.n_children = 0)::BIGINT) AS n_leaves, sum((x.n - 1) * x.b) AS saved
  FROM (SELECT DISTINCT k, substr(k, 1, 32 * up) AS above FROM (SELECT k, unnest(range(0, d + 1)) AS up FROM nodes)) pairs
  JOIN full_nodes x ON x.k = pairs.k JOIN nodes a ON a.k = pairs.above GROUP BY a.k
)
SELECT f.conv_id, f.d::BIGINT AS depth, p.conv_id AS parent_conv_id, f.n::BIGINT AS n_convs, f.n_children::BIGINT AS n_children, below.n_leaves::BIGINT AS n_leaves,
       below.saved::BIGINT AS saved_tokens, sha256(coalesce(e, '')) AS ends_sha256
FROM full_nodes f JOIN below USING (k) LEFT JOIN ends USING (k) LEFT JOIN nodes p ON f.d > 0 AND p.k = substr(f.k, 1, greatest(length(f.k) - 32, 0))
"""
