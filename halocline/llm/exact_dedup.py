"""Exact deduplication by Grace hashing.

Rows are partitioned by a hash of their content (the shuffle is the first level). A task takes its partition in
blocks and reduces them to one row per distinct content with an open-addressing table that compares
complete contents. When the distinct contents of a partition pass ``memory`` bytes, they and all later rows go to
spill files by the next bits of the hash, and each file is treated the same way. Spill files
live in the task's temporary folder and go with it; a task that is lost starts over from the shuffle.

Before the shuffle each task reduces its own input, one window at a time, in the same way, so a content that
fills a third of the table is sent once per window and not once per row. Which rows belong to
which window's group is written to the shared folder and joined at the end by the group's number.

Null texts count as empty. Of equal texts the largest id stays, null ids come last; among rows equal
in both, the first one of the scan. Repeated rows count as rows. Empty tables give empty results.
"""

from __future__ import annotations

import hashlib
import os
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from halocline.llm.common import Batches, batch_of, delete_path, id_type, reread, written

FAN_OUT_BITS = 4
WINDOW_BYTES, MEMORY_BYTES = 32 << 20, 96 << 20


def signed_hash(content: bytes) -> int:
    h = xxhash.xxh3_64_intdigest(content)
    return h - (1 << 64) if h >> 63 else h


class OpenTable:
    """Linear probing over numbered contents; two contents are one only if all their bytes agree."""

    def __init__(self):
        self.slots, self.mask = [-1] * 1024, 1023
        self.hashes: list[int] = []
        self.contents: list[bytes] = []

    def add(self, h: int, content: bytes) -> int:
        """The content's number; a new one takes the next."""
        at = h & self.mask
        while (entry := self.slots[at]) >= 0:
            if self.hashes[entry] == h and self.contents[entry] == content:
                return entry
            at = (at + 1) & self.mask
        entry = self.slots[at] = len(self.hashes)
        self.hashes.append(h)
        self.contents.append(content)
        if 2 * len(self.hashes) > self.mask:
            self.grow()
        return entry

    def grow(self) -> None:
        self.mask = 2 * self.mask + 1
        self.slots = [-1] * (self.mask + 1)
        for entry, h in enumerate(self.hashes):
            at = h & self.mask
            while self.slots[at] >= 0:
                at = (at + 1) & self.mask
            self.slots[at] = entry


def better(key, rid: int, best_key, best_rid: int) -> bool:
    """Larger id first, null last, then the earlier row."""
    if key is None or best_key is None:
        return best_key is None and (key is not None or rid < best_rid)
    return key > best_key or key == best_key and rid < best_rid


def groups_of(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """(group of each row, winning row of each group) by ``__t``, ``__h``, ``__k`` and ``__rid``."""
    seen, best, order = OpenTable(), [], []
    contents = table.column("__t").cast(pa.large_binary()).to_pylist()
    rows = zip(table.column("__h").to_pylist(), contents, table.column("__k").to_pylist(), table.column("__rid").to_pylist())
    group = np.empty(table.num_rows, np.int64)
    for i, (h, content, key, rid) in enumerate(rows):
        g = group[i] = seen.add(h, content or b"")
        if g == len(best):
            best.append(i)
            order.append((key, rid))
        elif better(key, rid, *order[g]):
            best[g], order[g] = i, (key, rid)
    return group, np.array(best, np.int64)


def reduce_rows(batches: list[pa.RecordBatch]) -> pa.Table:
    """One row per distinct content: the winner's, with ``__n`` added up and ``__reps`` joined where they exist."""
    table = pa.Table.from_batches(batches)
    group, winners = groups_of(table)
    out = table.take(pa.array(winners))
    if "__n" in table.column_names:
        n = np.zeros(len(winners), np.int64)
        np.add.at(n, group, table.column("__n").to_numpy())
        reps: list[list[int]] = [[] for _ in winners]
        for g, more in zip(group.tolist(), table.column("__reps").to_pylist()):
            reps[g] += more
        out = out.set_column(out.column_names.index("__n"), "__n", pa.array(n))
        out = out.set_column(out.column_names.index("__reps"), "__reps", pa.array(reps, pa.list_(pa.int64())))
    return out


class Spill:
    """Files of one level, by the next bits of the hash."""

    def __init__(self, folder: str, depth: int, schema: pa.Schema):
        self.folder = tempfile.mkdtemp(dir=folder)
        self.shift = FAN_OUT_BITS * depth
        self.paths = [os.path.join(self.folder, str(i)) for i in range(1 << FAN_OUT_BITS)]
        self.sinks = [pa.OSFile(p, "wb") for p in self.paths]
        self.writers = [pa.ipc.new_stream(s, schema, options=pa.ipc.IpcWriteOptions(compression="lz4")) for s in self.sinks]

    def add(self, batch: pa.RecordBatch) -> None:
        part = (batch.column("__h").to_numpy().view(np.uint64) >> np.uint64(self.shift)) & np.uint64((1 << FAN_OUT_BITS) - 1)
        for i in np.unique(part).tolist():
            self.writers[i].write_batch(batch.take(pa.array(np.flatnonzero(part == i))))

    def parts(self) -> Iterator[Iterator[pa.RecordBatch]]:
        for writer, sink in zip(self.writers, self.sinks):
            writer.close()
            sink.close()
        for path in self.paths:
            with pa.OSFile(path) as f, pa.ipc.open_stream(f) as reader:
                yield iter(reader)
            os.remove(path)


def grace(batches: Iterator[pa.RecordBatch], folder: str, memory: int, depth: int = 0) -> Iterator[pa.RecordBatch]:
    """Reduced rows of a partition, in memory or by way of spill files."""
    held: list[pa.RecordBatch] = []
    size, spill = 0, None
    for batch in batches:
        if spill:
            spill.add(batch)
            continue
        held.append(batch)
        size += batch.nbytes
        if size > memory:
            held = reduce_rows(held).to_batches()
            size = sum(b.nbytes for b in held)
            if size > memory // 2 and FAN_OUT_BITS * (depth + 1) <= 64:
                spill = Spill(folder, depth, batch.schema)
                for b in held:
                    spill.add(b)
                held = []
    if spill:
        for part in spill.parts():
            yield from grace(part, folder, memory, depth + 1)
    elif held:
        yield from reduce_rows(held).to_batches()


def windows(batches: Batches, size: int) -> Iterator[list[pa.RecordBatch]]:
    held, total = [], 0
    for batch in batches:
        held.append(batch)
        total += batch.nbytes
        if total >= size:
            yield held
            held, total = [], 0
    if held:
        yield held


def numbered(batches: Batches, text: str, key: str) -> Batches:
    """Batches with the working columns: content, its hash, key, and the row's number, unique in the scan."""
    at = TaskContext.get().partitionId() << 36
    for batch in batches:
        content = batch.column(text).cast(pa.large_binary())
        hashes = [signed_hash(c or b"") for c in content.to_pylist()]
        extra = {
            "__t": content, "__h": pa.array(hashes, pa.int64()), "__k": batch.column(key),
            "__rid": pa.array(np.arange(at, at + batch.num_rows)),
        }
        at += batch.num_rows
        yield pa.RecordBatch.from_arrays([*batch.columns, *extra.values()], names=[*batch.schema.names, *extra])


def assign_copies(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW_BYTES, memory: int = MEMORY_BYTES
) -> DataFrame:
    """One row per document: id, keep_id, group_size, kept, text_sha256."""
    key = id_type(docs, id_col)

    def local(batches: Batches) -> Batches:
        for held in windows(numbered(batches, "t", "k"), window):
            table = pa.Table.from_batches(held)
            group, winners = groups_of(table)
            rids, keys = table.column("__rid").to_numpy(), table.column("__k").combine_chunks()
            contents = table.column("__t").take(pa.array(winners))
            shas = np.array([hashlib.sha256(c or b"").hexdigest() for c in contents.to_pylist()], object)
            reps = rids[winners]
            n = len(rids)
            yield batch_of(
                content=pa.array(np.zeros(n, bool)), __rid=pa.array(rids), __k=keys, sha=pa.array(shas[group], pa.string()),
                rep=pa.array(reps[group]), __h=pa.nulls(n, pa.int64()), __t=pa.nulls(n, pa.binary()),
                __n=pa.nulls(n, pa.int64()), __reps=pa.nulls(n, pa.list_(pa.int64())),
            )
            m = len(winners)
            yield batch_of(
                content=pa.array(np.ones(m, bool)), __rid=pa.array(reps), __k=keys.take(pa.array(winners)), sha=pa.nulls(m, pa.string()),
                rep=pa.array(reps), __h=table.column("__h").take(pa.array(winners)).combine_chunks(),
                __t=pa.array([c or b"" for c in contents.to_pylist()], pa.binary()), __n=pa.array(np.bincount(group)),
                __reps=pa.array([[r] for r in reps.tolist()], pa.list_(pa.int64())),
            )

    def resolve(batches: Batches) -> Batches:
        with tempfile.TemporaryDirectory() as folder:
            for out in grace(batches, folder, memory):
                yield batch_of(reps=out.column("__reps"), keep_rid=out.column("__rid"), keep_k=out.column("__k"), n=out.column("__n"))

    source = docs.select(F.col(f"`{id_col}`").alias("k"), F.col(f"`{text_col}`").alias("t"))
    schema = f"content boolean, __rid long, __k {key}, sha string, rep long, __h long, __t binary, __n long, __reps array<long>"
    rows, path = written(source.mapInArrow(local, schema), "copies", "content")
    found = rows.filter("content").select("__rid", "__k", "__h", "__t", "__n", "__reps").repartition("__h")
    found = found.mapInArrow(resolve, f"reps array<long>, keep_rid long, keep_k {key}, n long")
    groups, _ = written(found.select(F.explode("reps").alias("rep"), "keep_rid", "keep_k", "n"), "copy-groups")
    delete_path(docs.sparkSession, f"{path}/content=true")
    return reread(rows, path).filter("not content").select("__rid", "__k", "sha", "rep").join(groups, "rep").select(
        F.col("__k").alias(id_col), F.col("keep_k").alias("keep_id"), F.col("n").alias("group_size"),
        (F.col("__rid") == F.col("keep_rid")).alias("kept"), F.col("sha").alias("text_sha256"),
    )


def drop_copies(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW_BYTES, memory: int = MEMORY_BYTES
) -> DataFrame:
    """The rows that stay, with all their columns; one shuffle and no join."""
    names = docs.columns
    inner = [f"c{i}" for i in range(len(names))]  # columns of any name go through under plain ones
    key, text = inner[names.index(id_col)], inner[names.index(text_col)]
    fields = [T.StructField(n, f.dataType) for n, f in zip(inner, docs.schema)]
    work = [T.StructField("__h", T.LongType()), T.StructField("__rid", T.LongType())]
    last = [*inner, "__h", "__rid"]

    def full(batch: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [*batch.columns, batch.column(text).cast(pa.large_binary()), batch.column(key)], names=[*batch.schema.names, "__t", "__k"]
        )

    def local(batches: Batches) -> Batches:
        for held in windows(numbered(batches, text, key), window):
            yield from reduce_rows(held).select(last).to_batches()

    def resolve(batches: Batches) -> Batches:
        with tempfile.TemporaryDirectory() as folder:
            for out in grace(map(full, batches), folder, memory):
                yield out.select(inner)

    sent = docs.toDF(*inner).mapInArrow(local, T.StructType(fields + work)).repartition("__h")
    return sent.mapInArrow(resolve, T.StructType(fields)).toDF(*names)
