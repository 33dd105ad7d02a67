"""Sequence packing as vector bin packing with the dot-product heuristic.

A sequence has three limits: tokens, segments, and loss-bearing tokens. Documents are tokenized and
cut into full sequences; what is left of each waits in a pool. For an open sequence, every
pooled piece that fits whole gets the score ``sum_d w_d * demand_d * room_d`` over the three limits
(``w_d``: mean demand of the pool, all as shares of the limit), and the best goes in. Where nothing
fits whole, the largest piece is cut to the room that is left.

Each task packs the documents of its own input partition in one pass, so no text is shuffled, and a
lost task is repeated alone. The pool is bounded (``pool`` pieces). Sequences are padded to
``max_tokens``, except that one whose length is a power of two is stored at that length; so a
sequence that cannot be filled up is stored as several of such lengths.

Every id of a document, with the end id after it, lies in exactly one piece. A null text counts as
empty and has the end id alone. Repeated rows are packed as often as they occur; null ids stay null.
"""

from __future__ import annotations

import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from halocline.llm.common import Batches, batch_of, id_type
from halocline.llm.word_bpe import WordSplitter

WIDTH = 4  # bytes of an id
#: A room of fewer tokens is padded rather than filled by a cut.
LEAST_CUT = 16
#: Longer words are encoded each time.
MEMO_CHARS, MEMO_WORDS = 48, 600_000


@lru_cache(maxsize=2)
def word_ids(path: str) -> WordIds:
    return WordIds(path)


class WordIds:
    """Ids of whole texts, by the tokenizer's own model, with a bounded memory of words and pre-tokens."""

    def __init__(self, path: str):
        self.split = WordSplitter(path)
        self.tokens = self.split.model.tokenize
        self.known: dict[bytes, bytes] = {}
        self.runs: dict[str, bytes] = {}

    def pretoken(self, symbols: str | int) -> bytes:
        if isinstance(symbols, int):
            return symbols.to_bytes(WIDTH, "little")
        found = self.runs.get(symbols)
        if found is None:
            found = b"".join([t.id.to_bytes(WIDTH, "little") for t in self.tokens(symbols)])
            if len(self.runs) > MEMO_WORDS:
                self.runs.clear()
            if len(symbols) <= MEMO_CHARS:
                self.runs[symbols] = found
        return found

    def word(self, raw: bytes) -> bytes:
        found = self.known.get(raw)
        if found is None:
            found = b"".join(map(self.pretoken, self.split(raw)))
            if len(raw) <= MEMO_CHARS:
                if len(self.known) > MEMO_WORDS:
                    self.known.clear()
                self.known[raw] = found
        return found

    def text(self, raw: bytes) -> bytes:
        """Ids of a text as little-endian unsigned 32-bit numbers."""
        words = raw.split()
        ids = list(map(self.known.get, words))
        if None in ids:
            ids = [self.word(w) if x is None else x for x, w in zip(ids, words)]
        return b"".join(ids)


def loss_in(start: int, length: int, first: int) -> int:
    """Loss-bearing tokens of a piece; they are those of the document from ``first`` on."""
    return max(0, start + length - max(start, first))


def longest(start: int, first: int, tokens: int, loss: int) -> int:
    """Longest piece from ``start`` within ``tokens`` and ``loss``."""
    return min(tokens, max(0, first - start) + loss)


class Packer:
    """One task's pool and its finished sequences."""

    def __init__(self, first_id: int, max_tokens: int, max_segments: int, max_loss: int, pool: int):
        self.next_id, self.caps, self.pool = first_id, (max_tokens, max_segments, max_loss), pool
        self.items: list[tuple] = []  # (key, start, ids, document's tokens, first loss-bearing token)
        self.done: list[tuple] = []

    def add(self, key, ids: bytes, loss: int | None) -> None:
        n = len(ids) // WIDTH
        first = 1 if loss is None else n - max(0, min(loss, n))
        start, (tokens, _, most) = 0, self.caps
        while (size := longest(start, first, tokens, most)) < n - start or n - start == tokens:
            self.close([(key, start, ids[start * WIDTH : (start + size) * WIDTH], n, first)])
            start += size
        if start < n:
            self.items.append((key, start, ids[start * WIDTH :], n, first))
        if len(self.items) >= 2 * self.pool:
            self.pack(self.pool)

    def pack(self, keep: int) -> None:
        """Fill sequences until at most ``keep`` pieces wait."""
        caps = np.array(self.caps, float)
        items, count = self.items, len(self.items)
        demand = np.empty((count, 3))
        for i, item in enumerate(items):
            demand[i] = self.demand(item)
        demand /= caps
        weight = demand.mean(axis=0) if count else caps
        while count > keep:
            room, used = np.ones(3), []
            while count:
                live = demand[:count]
                fits = (live <= room + 1e-12).all(axis=1)
                if fits.any():
                    at = int(np.argmax(np.where(fits, live @ (weight * room), -1.0)))
                    room -= live[at]
                    used.append(items[at])
                    count -= 1
                    items[at], demand[at] = items[count], demand[count]
                    continue
                tokens, segments, loss = np.rint(room * caps).astype(int)
                at = int(np.argmax(live[:, 0]))
                key, start, ids, n, first = items[at]
                size = longest(start, first, int(tokens), int(loss)) if segments else 0
                if size >= LEAST_CUT:
                    used.append((key, start, ids[: size * WIDTH], n, first))
                    items[at] = (key, start + size, ids[size * WIDTH :], n, first)
                    demand[at] = np.array(self.demand(items[at])) / caps
                break
            del items[count:]
            self.close(used)

    @staticmethod
    def demand(item: tuple) -> tuple[int, int, int]:
        size = len(item[2]) // WIDTH
        return size, 1, loss_in(item[1], size, item[4])

    def close(self, pieces: list[tuple]) -> None:
        """Number the sequence; one with much room is stored as several whose lengths are powers of two."""
        left = sum(len(p[2]) for p in pieces) // WIDTH
        if self.caps[0] - left < LEAST_CUT:
            self.store(pieces)
            return
        pieces = pieces[::-1]
        while left:
            size = room = 1 << (left.bit_length() - 1)
            part = []
            while room:
                key, start, ids, n, first = pieces.pop()
                take = min(room, len(ids) // WIDTH)
                part.append((key, start, ids[: take * WIDTH], n, first))
                if take * WIDTH < len(ids):
                    pieces.append((key, start + take, ids[take * WIDTH :], n, first))
                room -= take
            self.store(part)
            left -= size

    def store(self, pieces: list[tuple]) -> None:
        offset = 0
        for key, start, ids, n, _ in pieces:
            self.done.append((key, start, len(ids) // WIDTH, zlib.crc32(ids), n, self.next_id, offset, ids))
            offset += len(ids) // WIDTH
        self.next_id += 1

    def take(self) -> list[tuple]:
        out, self.done = self.done, []
        return out


FIELDS = ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def pack_documents(
    docs: DataFrame,
    tokenizer: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    loss_col: str | None = None,
    end_id: int = 1,
    max_tokens: int = 2048,
    max_segments: int = 64,
    max_loss: int = 2048,
    pool: int = 2048,
    with_ids: bool = False,
) -> DataFrame:
    """One row per piece; ``with_ids`` adds the ids themselves (``ids``, little-endian bytes).

    ``loss_col`` gives how many tokens at a document's end bear loss (an answer after its prompt; null:
    as if not given); without it all do but a document's first, which nothing precedes.
    """
    if min(max_tokens, max_segments, max_loss) < 1:
        raise ValueError("limits of a sequence must be positive")
    end = int(end_id).to_bytes(WIDTH, "little")

    def rows(done: list[tuple], key_type: pa.DataType) -> pa.RecordBatch:
        cols = list(zip(*done)) or [()] * 8
        out = {"k": pa.array(cols[0], key_type)} | {n: pa.array(c, pa.int64()) for n, c in zip(FIELDS, cols[1:7])}
        return batch_of(**out, **({"ids": pa.array(cols[7], pa.binary())} if with_ids else {}))

    def pack(batches: Batches) -> Batches:
        encode = word_ids(tokenizer).text
        packer = Packer(TaskContext.get().partitionId() << 33, max_tokens, max_segments, max_loss, pool)
        kind = None
        for batch in batches:
            kind = batch.schema.field("k").type
            for lo in range(0, batch.num_rows, 500):
                part = batch.slice(lo, 500)
                raws = [t or b"" for t in part.column("t").cast(pa.large_binary()).to_pylist()]
                for key, raw, loss in zip(part.column("k").to_pylist(), raws, part.column("l").to_pylist()):
                    packer.add(key, encode(raw) + end, loss)
                if packer.done:
                    yield rows(packer.take(), kind)
        packer.pack(0)
        if packer.done:
            yield rows(packer.take(), kind)

    loss = F.col(f"`{loss_col}`").cast("long") if loss_col else F.lit(None).cast("long")
    source = docs.select(F.col(f"`{id_col}`").alias("k"), F.col(f"`{text_col}`").alias("t"), loss.alias("l"))
    schema = f"k {id_type(docs, id_col)}, " + ", ".join(f"{n} long" for n in FIELDS) + (", ids binary" if with_ids else "")
    return source.mapInArrow(pack, schema).withColumnRenamed("k", id_col)
