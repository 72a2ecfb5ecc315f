"""Prefix trie of conversations from vertical bitmaps.

A node is a sequence of turns that some conversation starts with; its members are those conversations.
Conversations are cut into shards by ranges of their id. In a shard every (position, turn) has a
bitset of the conversations that hold the turn there. From the root, which all are members of, the
shard's trie is walked depth first: the lowest member not yet placed says which posting comes next,
and the parent's bitset intersected with it is a child. Set bits are counted for the members, and the
bitset of conversations that end at a depth gives the list of ends.

Shards are put together by a hash of the path. A shard that holds the least member of a node owns
it, so every node has one owner, which also holds all nodes above it. That makes sums over subtrees
sums over owned nodes: each shard adds up its own, and the totals of the nodes in several shards are
added. Turns travel as digests with the length of their text.
"""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from strandframe.session import cut_lineage

#: Turns of a shard, about. A bitset has a bit for each conversation of it.
SHARD_TURNS = 16_384
_EMPTY = hashlib.sha256(b"").hexdigest()
_ROOT = hashlib.md5(b"").digest()


def number_turns(conversations: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """``conv_id``, ``pos`` (from 0 by turn, null first), ``turn_key`` (digest of role and text) and ``chars``.

    Null roles and texts are empty. Rows of one turn number are in order of role, then of digest;
    rows without a conversation id are left out; other columns play no part. The texts themselves are
    not moved: a conversation's digests are sorted in one task, its texts need not fit there.
    """
    role, text = F.coalesce(F.col(role_col), F.lit("")), F.coalesce(F.col(text_col), F.lit(""))
    marks = conversations.filter(F.col(id_col).isNotNull()).select(
        F.col(id_col).cast("long").alias("conv_id"), F.col(turn_col).alias("turn"), role.alias("role"),
        F.unhex(F.md5(F.concat(F.md5(role.cast("binary")), F.md5(text.cast("binary"))).cast("binary"))).alias("turn_key"), F.length(text).cast("long").alias("chars"))
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "turn_key")
    return marks.select("conv_id", (F.row_number().over(order) - 1).alias("pos"), "turn_key", "chars")


class Shard:
    """The trie of one shard's conversations, given as ``(id, [(turn key, characters), …])`` by rising id."""

    def __init__(self, conversations: list):
        self.conversations = conversations
        self.ends: dict[int, int] = {}  # by number of turns
        self.postings: dict[tuple, int] = {}
        for at, (_, turns) in enumerate(conversations):
            bit = 1 << at
            self.ends[len(turns)] = self.ends.get(len(turns), 0) | bit
            for place, (key, _) in enumerate(turns):
                self.postings[place, key] = self.postings.get((place, key), 0) | bit

    def ids(self, members: int) -> list:
        out = []
        while members:
            low = members & -members
            out.append(self.conversations[low.bit_length() - 1][0])
            members ^= low
        return out

    def nodes(self):
        """Nodes in depth-first order: (number, parent's number, path, depth, least member, members, characters of the last turn, ends)."""
        number, stack = 0, [(-1, _ROOT, 0, (1 << len(self.conversations)) - 1, 0)]
        while stack:
            parent, path, depth, members, chars = stack.pop()
            done = members & self.ends.get(depth, 0)
            first = (members & -members).bit_length() - 1
            yield number, parent, path, depth, self.conversations[first][0], members.bit_count(), chars, self.ids(done)
            left = members ^ done
            while left:
                key, size = self.conversations[(left & -left).bit_length() - 1][1][depth]
                child = members & self.postings[depth, key] if left & (left - 1) else left
                stack.append((number, hashlib.md5(path + key).digest(), depth + 1, child, size))
                left &= ~child
            number += 1


_LOCAL = "shard long, number long, parent long, path binary, depth long, conv_id long, n_convs long, chars long, ends string, leaf boolean"


def _shard_nodes(rows: pd.DataFrame) -> pd.DataFrame:
    shard = int(rows["shard"].iat[0])
    conversations: list = []
    for conv, pos, key, chars in rows.sort_values(["conv_id", "pos"], na_position="first")[["conv_id", "pos", "turn_key", "chars"]].itertuples(index=False):
        if not conversations or conversations[-1][0] != conv:
            conversations.append((conv, []))
        if not pd.isna(pos):
            conversations[-1][1].append((bytes(key), int(chars)))
    out = list(Shard(conversations).nodes())
    inner = {n[1] for n in out}
    return pd.DataFrame(
        [(shard, n, up, path, depth, conv, count, chars, ",".join(map(str, ends)), n not in inner) for n, up, path, depth, conv, count, chars, ends in out],
        columns=[c.split()[0] for c in _LOCAL.split(", ")])


_DONE = ("path binary, shared boolean, owned boolean, shard long, conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, "
         "saved_tokens long, ends string")


def _shard_sums(rows: pd.DataFrame) -> pd.DataFrame:
    """Sums over the subtrees of a shard's nodes, which counts the nodes that the shard owns."""
    rows = rows.sort_values("number")
    n = rows["number"].size
    up, least = rows["parent"].to_numpy(), rows["all_conv"].to_numpy()
    owned = (rows["owner"] == rows["shard"]).to_numpy()
    leaves = (owned & rows["all_leaf"].to_numpy()).astype(int).tolist()
    saved = (owned * (rows["all_convs"].to_numpy() - 1) * rows["chars"].to_numpy()).tolist()
    children = [0] * n
    for k in range(n - 1, 0, -1):  # a node comes after the one above it
        leaves[up[k]] += leaves[k]
        saved[up[k]] += saved[k]
        children[up[k]] += bool(owned[k])
    return pd.DataFrame({
        "path": rows["path"], "shared": rows["pieces"] > 1, "owned": owned, "shard": rows["shard"], "conv_id": least, "depth": rows["depth"],
        "parent_conv_id": pd.array([None if p < 0 else int(least[p]) for p in up], "Int64"), "n_convs": rows["all_convs"],
        "n_children": children, "n_leaves": leaves, "saved_tokens": saved, "ends": rows["ends"]})


def _digests(batches):
    """SHA-256 of each path's ends; rows come sorted by (path, shard), a few at a time."""
    path, state = None, None
    for rows in batches:
        done = []
        for p, ends in zip(rows["path"], rows["ends"]):
            p = bytes(p)
            if p != path:
                if path is not None:
                    done.append((path, state.hexdigest()))
                path, state, sep = p, hashlib.sha256(), b""
            state.update(sep + ends.encode())
            sep = b","
        yield pd.DataFrame(done, columns=["path", "ends_sha256"])
    if path is not None:
        yield pd.DataFrame([(path, state.hexdigest())], columns=["path", "ends_sha256"])


def prefix_trie(turns: DataFrame, shard_turns: int = SHARD_TURNS) -> DataFrame:
    """A row per node of the trie: its members, children, leaves and what sharing the prefix saves.

    ``turns`` are rows of ``number_turns``; a row with null ``pos`` only says that the conversation is
    there, which is how one without turns becomes a member of the root. Columns: ``path`` (digest of
    the sequence), ``conv_id`` (least member), ``depth``, ``parent_conv_id`` (least member of the node
    above, null for the root), ``n_convs``, ``n_children``, ``n_leaves`` (nodes without children in
    the subtree), ``saved_tokens`` (over the subtree, members but one times characters of the last
    turn), ``ends_sha256`` (of the decimal ids of members that end here, rising, with commas).

    Without turns there is no node, not even a root. A conversation's digests are in one task, and
    so are the nodes of one shard; the ends of a node pass through a task as a stream.
    """
    turns = cut_lineage(turns.select("conv_id", "pos", "turn_key", "chars"))
    shards = max(turns.count() // shard_turns, 1)
    dealt = turns.repartitionByRange(shards, "conv_id").withColumn("shard", F.spark_partition_id().cast("long"))
    local = cut_lineage(cut_lineage(dealt).groupBy("shard").applyInPandas(_shard_nodes, _LOCAL))
    same = Window.partitionBy("path")
    known = local.select(
        "shard", "number", "parent", "path", "depth", "chars", "ends", F.min("conv_id").over(same).alias("all_conv"),
        F.sum("n_convs").over(same).alias("all_convs"), F.min("shard").over(same).alias("owner"), F.min("leaf").over(same).alias("all_leaf"),
        F.count("*").over(same).alias("pieces"))
    done = cut_lineage(known.groupBy("shard").applyInPandas(_shard_sums, _DONE))
    facts = ["path", "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens"]
    alone = done.filter("not shared").select(*facts, F.sha2(F.col("ends").cast("binary"), 256).alias("ends_sha256"))
    parts = done.filter("shared")
    totals = parts.groupBy("path").agg(
        F.min("conv_id").alias("conv_id"), F.min("depth").alias("depth"), F.min("parent_conv_id").alias("parent_conv_id"), F.min("n_convs").alias("n_convs"),
        F.sum("n_children").alias("n_children"), F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved_tokens"))
    ends = parts.filter("ends <> ''").repartition("path").sortWithinPartitions("path", "shard").select("path", "ends").mapInPandas(
        _digests, "path binary, ends_sha256 string")
    met = totals.join(ends, "path", "left").withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(_EMPTY)))
    return alone.unionByName(met.select(alone.columns))


def share_heads(turns: DataFrame, every: int = 100, most: int = 6) -> DataFrame:
    """Numbered turns in which conversation ``c`` begins like conversation ``c - c % every``.

    Its first ``h = crc32(decimal c) % most`` turns become the first ``h`` of that one: all it has if
    fewer, none if it is not there. A conversation that is left without turns has a row with null ``pos``.
    """
    turns = cut_lineage(turns)
    head = F.pmod(F.crc32(F.col("conv_id").cast("string").cast("binary")), F.lit(most))
    base = F.col("conv_id") - F.col("conv_id") % every
    own = turns.filter(F.col("pos") >= head)
    heads = turns.filter((F.col("conv_id") % every == 0) & (F.col("pos") < most - 1)).select(F.col("conv_id").alias("base"), "pos", "turn_key", "chars")
    convs = turns.filter("pos = 0").select("conv_id", base.alias("base"), head.alias("h"))
    given = convs.join(heads, "base").filter(F.col("pos") < F.col("h")).select("conv_id", "pos", "turn_key", "chars")
    # A gap between the given head and the own rest does not matter: positions are counted again.
    both = own.select("conv_id", "pos", "turn_key", "chars").unionByName(given)
    placed = both.withColumn("pos", F.row_number().over(Window.partitionBy("conv_id").orderBy("pos")) - 1)
    bare = convs.select("conv_id").join(both.select("conv_id").distinct(), "conv_id", "left_anti")
    nothing = bare.select("conv_id", F.lit(None).cast("int").alias("pos"), F.lit(None).cast("binary").alias("turn_key"), F.lit(None).cast("long").alias("chars"))
    return placed.unionByName(nothing)


def with_turns(nodes: DataFrame, conversations: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """``nodes`` with ``role`` and ``text`` of their last turn, read from ``conversations`` (null at the root).

    The trie must be that of these conversations: a node's last turn is at ``depth - 1`` of its least member.
    """
    role, text = F.coalesce(F.col(role_col), F.lit("")), F.coalesce(F.col(text_col), F.lit(""))
    key = F.md5(F.concat(F.md5(role.cast("binary")), F.md5(text.cast("binary"))).cast("binary"))
    order = Window.partitionBy("_conv").orderBy(F.col("_turn").asc_nulls_first(), "role", "_key")
    said = conversations.filter(F.col(id_col).isNotNull()).select(
        F.col(id_col).cast("long").alias("_conv"), F.col(turn_col).alias("_turn"), role.alias("role"), text.alias("text"), key.alias("_key"))
    placed = said.select("_conv", F.row_number().over(order).alias("_depth"), "role", "text")
    met = nodes.join(placed, (F.col("conv_id") == F.col("_conv")) & (F.col("depth") == F.col("_depth")), "left")
    return met.select(*nodes.columns, "role", "text")
