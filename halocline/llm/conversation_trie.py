"""Prefix trie of conversations by whole-sequence collapse.

A conversation is its turns in order; a node of the trie is a distinct sequence of first turns, the root the empty one.

1. Scan: a turn becomes the SHA-256 of role and text and the text's size, so that texts never move. One shuffle brings a conversation's turns
   together, in order; a pass over them in constant memory chains the digests to a 128-bit key per prefix.
2. Collapse: conversations with the same last key are one weighted sequence with the list of its ends. A range partitioning by (key, id)
   sorts the ends, also those of one key over several tasks, and packs up to ``PACK`` ids to a row; what is left to a key's task is to
   hash these packs one after the other. The smallest id represents the sequence from here on.
3. Leaves: the sequences that are no proper prefix of another one, by an anti-join with the prefixes of the representatives.
4. Nodes: two aggregates of the weighted prefixes, combined before their shuffles. What a subtree saves needs no walk over it: the members'
   bytes from a node on are a sum over its weighted sequences, and each node is owned by the sequence of its smallest member, so the
   distinct nodes' bytes are one, too.

A conversation may begin with turns of another one (``lender``, ``borrowed``). Turns go by number, null first; turns of the same number by the SHA-256 of role
and text; repeated turns count as turns. Null role or text: empty. Rows without a conversation id belong to no conversation. Empty table: no node.
A conversation is one path and its chain sequential: a task streams it at some 60 bytes a turn.
"""

from __future__ import annotations

import hashlib
import struct

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from halocline.llm.common import Batches, batch_of, delete_path, id_type, written

ROOT = b""
#: Ids packed into one row, and rows of a result batch.
PACK, ROWS = 1 << 16, 1 << 14
#: A parent with more than this share of all nodes as children is joined by broadcast; there are fewer than its inverse.
HEAVY_SHARE = 1000


class Sink:
    """Rows gathered into record batches."""

    def __init__(self, schema: pa.Schema, rows: int = ROWS):
        self.schema, self.limit, self.rows = schema, rows, []

    def full(self) -> bool:
        return len(self.rows) >= self.limit

    def batch(self) -> pa.RecordBatch:
        columns = list(zip(*self.rows)) or [()] * len(self.schema)
        self.rows = []
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, self.schema)], schema=self.schema)


def key_of(state: bytes) -> tuple[int, int]:
    return struct.unpack("<qq", state) if state else (0, 0)


def chained(state: bytes, digest: bytes) -> bytes:
    return hashlib.blake2b(state + digest, digest_size=16).digest()


def prefixes(turns: DataFrame, lender: Column, borrowed: Column, most: int, names: tuple[str, str, str, str]) -> DataFrame:
    """One row per conversation and prefix: key (k1, k2) and parent's key (u1, u2), depth, bytes of the prefix before its last turn and
    of that turn, and whether the conversation ends here."""
    conv, turn, role, text = (F.col(f"`{n}`") for n in names)
    role, text = F.coalesce(role, F.lit("")), F.coalesce(text, F.lit(""))
    content = F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)
    kind = id_type(turns, names[0])
    source = turns.filter(conv.isNotNull()).select(
        conv.alias("conv"), lender.cast(kind).alias("lender"), borrowed.cast("long").alias("h"), turn.alias("turn"),
        F.unhex(F.sha2(content, 256)).alias("digest"), F.octet_length(text).cast("long").alias("size"),
    )
    own_last = F.col("conv") != F.col("lender")
    ordered = source.repartition("lender").sortWithinPartitions("lender", own_last, "conv", F.col("turn").asc_nulls_first(), "digest")

    def walk(batches: Batches) -> Batches:
        schema, sink = None, None
        family = conv = pending = None
        shared: list[tuple[bytes, int]] = []
        state, depth, total, place = ROOT, 0, 0, 0

        def push(digest: bytes, size: int) -> None:
            nonlocal state, depth, total, pending
            sink.rows.append((*pending, False))
            up, state = state, chained(state, digest)
            depth += 1
            pending = (conv, *key_of(state), *key_of(up), depth, total, size)
            total += size

        for batch in batches:
            if sink is None:
                longs = [(n, pa.int64()) for n in ("k1", "k2", "u1", "u2", "depth", "before", "size")]
                schema = pa.schema([("conv", batch.schema.field("conv").type), *longs, ("last", pa.bool_())])
                sink = Sink(schema)
            rows = zip(*(batch.column(n).to_pylist() for n in ("lender", "conv", "h", "digest", "size")))
            for of, c, h, digest, size in rows:
                if pending is None or c != conv:
                    if pending is not None:
                        sink.rows.append((*pending, True))
                    if of != family:
                        family, shared = of, []
                    conv, state, depth, total, place = c, ROOT, 0, 0, 0
                    pending = (c, 0, 0, 0, 0, 0, 0, 0)
                    for part in shared[:h] if c != of else []:
                        push(*part)
                if c == of and place < most:
                    shared.append((digest, size))
                if c == of or place >= h:
                    push(digest, size)
                place += 1
                if sink.full():
                    yield sink.batch()
        if pending is not None:
            sink.rows.append((*pending, True))
            yield sink.batch()

    out = f"conv {kind}, k1 long, k2 long, u1 long, u2 long, depth long, before long, size long, last boolean"
    return ordered.select("lender", "conv", "h", "digest", "size").mapInArrow(walk, out)


def weighted_sequences(ends: DataFrame) -> DataFrame:
    """(k1, k2, conv, weight, total, ends_sha256) per distinct whole sequence; ``conv`` is the smallest of its ids."""
    kind = id_type(ends, "conv")

    def pack(batches: Batches) -> Batches:
        key, ids, first, total, sink = None, [], None, 0, None
        for batch in batches:
            sink = sink or Sink(pa.schema([("k1", pa.int64()), ("k2", pa.int64()), ("conv", batch.schema.field("conv").type),
                                           ("weight", pa.int64()), ("total", pa.int64()), ("ids", pa.binary())]), 64)
            for k1, k2, c, t in zip(*(batch.column(n).to_pylist() for n in ("k1", "k2", "conv", "total"))):
                if key != (k1, k2) or len(ids) >= PACK:
                    if ids:
                        sink.rows.append((*key, first, len(ids), total, ",".join(ids).encode()))
                    key, ids, first, total = (k1, k2), [], c, t
                    if sink.full():
                        yield sink.batch()
                ids.append(str(c))
        if ids:
            sink.rows.append((*key, first, len(ids), total, ",".join(ids).encode()))
            yield sink.batch()

    def fold(batches: Batches) -> Batches:
        key, first, weight, total, sink, hashed = None, None, 0, 0, None, None
        for batch in batches:
            sink = sink or Sink(pa.schema([("k1", pa.int64()), ("k2", pa.int64()), ("conv", batch.schema.field("conv").type),
                                           ("weight", pa.int64()), ("total", pa.int64()), ("ends_sha256", pa.string())]))
            for k1, k2, c, n, t, ids in zip(*(batch.column(x).to_pylist() for x in ("k1", "k2", "conv", "weight", "total", "ids"))):
                if key == (k1, k2):
                    hashed.update(b",")
                else:
                    if key:
                        sink.rows.append((*key, first, weight, total, hashed.hexdigest()))
                    key, first, weight, total, hashed = (k1, k2), c, 0, t, hashlib.sha256()
                    if sink.full():
                        yield sink.batch()
                hashed.update(ids)
                weight += n
        if key:
            sink.rows.append((*key, first, weight, total, hashed.hexdigest()))
            yield sink.batch()

    base = f"k1 long, k2 long, conv {kind}, weight long, total long"
    by = ["k1", "k2", "conv"]
    packs = ends.repartitionByRange(*by).sortWithinPartitions(*by).select(*by, "total").mapInArrow(pack, f"{base}, ids binary")
    packs, path = written(packs, "trie-packs")
    found, _ = written(packs.repartition("k1", "k2").sortWithinPartitions(*by).mapInArrow(fold, f"{base}, ends_sha256 string"), "trie-sequences")
    delete_path(ends.sparkSession, path)
    return found


def with_parents(nodes: DataFrame) -> DataFrame:
    """``parent_conv_id`` for every node; parents with a large share of all nodes, of which there are few, come by broadcast."""
    total = nodes.count()
    heavy = nodes.filter(F.col("n_children") * HEAVY_SHARE > total).select(
        F.col("k1").alias("h1"), F.col("k2").alias("h2"), F.col("conv_id").alias("heavy_id"), F.lit(True).alias("heavy")
    )
    inner = F.col("depth") > 0
    on_heavy = inner & (F.col("u1") == F.col("h1")) & (F.col("u2") == F.col("h2"))
    split = nodes.join(F.broadcast(heavy), on_heavy, "left").drop("h1", "h2")
    done = split.filter(~inner | F.col("heavy")).withColumn("parent_conv_id", F.col("heavy_id")).drop("heavy", "heavy_id")
    parents = nodes.filter("n_children > 0").select(F.col("k1").alias("u1"), F.col("k2").alias("u2"), F.col("conv_id").alias("parent_conv_id"))
    rest = split.filter(inner & F.col("heavy").isNull()).drop("heavy", "heavy_id").join(parents, ["u1", "u2"])
    return done.unionByName(rest)


def prefix_trie(
    turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text",
    lender: Column | None = None, borrowed: Column | None = None, most: int = 0,
) -> DataFrame:
    """One row per node: its smallest member, depth, parent's smallest member, members, children, leaves of its subtree,
    bytes that sharing saves in its subtree, digest of the ids of the members that end here.

    A conversation starts with the first ``borrowed`` (``most`` at the most) turns of conversation ``lender``, followed by its own turns after as many of them.
    A lender's lender is itself.
    """
    spark = turns.sparkSession
    names = (conv_col, turn_col, role_col, text_col)
    lender = F.col(f"`{conv_col}`") if lender is None else lender
    rows, path = written(prefixes(turns, lender, F.lit(0) if borrowed is None else borrowed, most, names), "trie-prefixes")
    sequences = weighted_sequences(rows.filter("last").select("k1", "k2", "conv", (F.col("before") + F.col("size")).alias("total")))
    key = ["k1", "k2"]

    weighted = rows.join(sequences.select("conv", "weight"), "conv")
    facts = [F.min(c).alias(c) for c in ("u1", "u2", "depth", "before")]
    nodes, nodes_path = written(weighted.groupBy(*key).agg(F.min("conv").alias("conv_id"), F.sum("weight").alias("n_convs"), *facts), "trie-nodes")

    proper = rows.filter(~F.col("last")).join(sequences.select("conv"), "conv").select(*key).distinct()
    leaves = sequences.join(proper, key, "left_anti").select("conv", F.lit(1).alias("leaf"))
    owned = nodes.groupBy(F.col("conv_id").alias("conv")).agg(F.min("before").alias("owned_from"))
    facts = sequences.join(leaves, "conv", "left").join(owned, "conv", "left").select(
        "conv", "weight", "total", F.coalesce("leaf", F.lit(0)).alias("leaf"), F.coalesce("owned_from", "total").alias("owned_from")
    )
    every_copy = F.col("weight") * (F.col("total") - F.col("before"))
    once = F.col("total") - F.greatest("owned_from", "before")
    below = rows.join(facts, "conv").groupBy(*key).agg(F.sum("leaf").alias("n_leaves"), F.sum(every_copy - once).alias("saved_tokens"))

    children = nodes.filter("depth > 0").groupBy(F.col("u1").alias("k1"), F.col("u2").alias("k2")).agg(F.count("*").alias("n_children"))
    ends = sequences.select(*key, "ends_sha256")
    full = nodes.join(below, key).join(children, key, "left").join(ends, key, "left").withColumns({
        "n_children": F.coalesce("n_children", F.lit(0)),
        "ends_sha256": F.coalesce("ends_sha256", F.lit(hashlib.sha256().hexdigest())),
    })
    full, _ = written(full, "trie")
    delete_path(spark, path)
    delete_path(spark, nodes_path)
    return with_parents(full).select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
