"""Repeated passages: windows of words that occur more than once, found by super-k-mers.

Every window of ``window`` words has a minimiser, the smallest hash of its runs of ``MER`` words. Consecutive windows
with the same minimiser travel as one packed string to the minimiser's bucket, so a word is sent about three times and not
once per window. All occurrences of a window meet in one bucket. There, windows are sorted by a rolling hash, and
those of equal hash by their words, so that counts are exact.

Strings that repeat inside one block of the input are sent once: the block already knows that all their windows are
repeated. So a passage that is part of very many documents arrives once per block. Strings are packed per block and
bucket and compressed.

The number of buckets follows from the size of the input, and a pass over the input adds up how many bytes each would get. A bucket above ``BUCKET_BYTES`` has a
hot minimiser, a phrase before many different words. Its strings are cut again by the minimisers of another hash, under which the
windows around the phrase part, and so on for up to ``LEVELS`` hashes; equal windows take the same way. So what a task holds at a time, a bucket's
strings and some 40 bytes per window, is bounded, but for windows that all of these hashes keep together.

Words are runs of anything but ASCII white space, unchanged. Null and empty texts, and those with fewer words than a
window, lose nothing. Repeated rows repeat all their windows. Documents are matched to their ranges by hashes of id and
text (128 bits together), so ids may repeat or be null.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from halocline.llm.common import Batches, batch_of, id_type, raw_texts

MER = 4
#: Packed strings are compressed by the tasks, at this level of zstd.
LEVEL = 3
#: Bytes of text that are cut into strings at a time.
BLOCK_BYTES = 4 << 20
#: Bytes of strings that a bucket should have, and those beyond which it is divided; hashes that divide it.
MEAN_BYTES, BUCKET_BYTES, LEVELS = 6 << 20, 24 << 20, 4
#: Levels are told apart by the upper bits of a bucket's number.
LEVEL_BITS = 40
BASE = 0x9E3779B97F4A7C15
SPACE, LINE = 32, 10


def powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


class Rolling:
    """Hashes of byte ranges of a buffer: sums of bytes times powers of an odd base, modulo 2**64."""

    up = down = np.ones(1, np.uint64)

    def __init__(self, data: np.ndarray):
        if len(Rolling.up) <= len(data):
            size = max(len(data) + 1, BLOCK_BYTES + BLOCK_BYTES // 4)
            Rolling.up, Rolling.down = powers(BASE, size), powers(pow(BASE, -1, 1 << 64), size)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(data.astype(np.uint64) * Rolling.up[: len(data)], out=self.sums[1:])

    def ranges(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (self.sums[end] - self.sums[start]) * Rolling.down[start]


def mixed(h: np.ndarray) -> np.ndarray:
    """A one-to-one mix, so that order does not follow content."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def word_bounds(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of words in lines of single-spaced words, each line ended."""
    ends = np.flatnonzero((data == SPACE) | (data == LINE))
    return np.concatenate([[0], ends[:-1] + 1]), ends


def line_words(data: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Number of the first word after each line."""
    return np.flatnonzero(data[ends] == LINE) + 1


def window_starts(after: np.ndarray, window: int) -> np.ndarray:
    """Whether a window starts at each word and ends in the same line."""
    stop = np.repeat(after, np.diff(after, prepend=0))
    return stop - np.arange(len(stop)) >= window


def sliding_min(h: np.ndarray, width: int) -> np.ndarray:
    """Minimum of ``width`` values from each place on; the end is padded with the largest value."""
    top = np.uint64(0xFFFFFFFFFFFFFFFF)
    out, have = h, 1
    while have < width:
        step = min(have, width - have)
        out = np.minimum(out, np.concatenate([out[step:], np.full(step, top, np.uint64)]))
        have += step
    return out


def super_kmers(texts: list[bytes], window: int, level: int = 0) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Packed strings of some texts of single-spaced words, by the hash of a level.

    Buffer, and for each string: text, first word in it, windows, minimiser, and (start, end) in the buffer.
    """
    joined = b"\n".join(texts) + b"\n"
    data = np.frombuffer(joined, np.uint8)
    starts, ends = word_bounds(data)
    after = line_words(data, ends)
    n, mer = len(starts), min(MER, window)
    line = np.repeat(np.arange(len(after)), np.diff(after, prepend=0))
    last = np.minimum(np.arange(n) + mer - 1, n - 1)
    grams = mixed(Rolling(data).ranges(starts, ends[last]) + np.uint64(level) * np.uint64(BASE))
    least = sliding_min(grams, window - mer + 1)  # never looks past its window, so never past its line
    at = np.flatnonzero(window_starts(after, window))
    if not len(at):
        empty = np.zeros(0, np.int64)
        return joined, empty, empty, empty, empty.astype(np.uint64), np.zeros((0, 2), np.int64)
    low = least[at]
    cut = np.flatnonzero((np.diff(at) != 1) | (low[1:] != low[:-1]) | (line[at[1:]] != line[at[:-1]])) + 1
    first = at[np.concatenate([[0], cut])]
    final = at[np.concatenate([cut - 1, [len(at) - 1]])]
    begin = np.concatenate([[0], after[:-1]])
    bounds = np.stack([starts[first], ends[final + window - 1]], axis=1)
    return joined, line[first], first - begin[line[first]], final - first + 1, least[first], bounds


def covered(repeated: np.ndarray, window: int) -> list[tuple[int, int]]:
    """Word ranges of the runs of repeated windows, for windows given as a mask."""
    edges = np.flatnonzero(np.diff(np.concatenate([[0], repeated.view(np.int8), [0]])))
    return [(a, b - 1 + window) for a, b in edges.reshape(-1, 2).tolist()]


class Bucket:
    """All strings of one bucket, with the documents and words at which they start."""

    def __init__(self, window: int):
        self.window = window
        self.strings: dict[bytes, int] = {}
        self.refs: list[list[tuple[int, int, int, bool]]] = []

    def add(self, strings: list[bytes], r1, r2, start, known) -> None:
        for string, *ref in zip(strings, r1, r2, start, known):
            at = self.strings.setdefault(string, len(self.refs))
            if at == len(self.refs):
                self.refs.append([])
            self.refs[at].append(tuple(ref))

    def ranges(self):
        """(r1, r2, first word, word after) of repeated windows, without those of strings known as repeated."""
        strings, window = list(self.strings), self.window
        hashes, owner, offset, firsts, spans = [], [], [], [], []
        lo, block, size = 0, [], 0
        for i, string in enumerate(strings):
            block.append(string)
            size += len(string) + 1
            if size < BLOCK_BYTES and i + 1 < len(strings):
                continue
            data = np.frombuffer(b"\n".join(block) + b"\n", np.uint8)
            begin, end = word_bounds(data)
            after = line_words(data, end)
            at = np.flatnonzero(window_starts(after, window))
            line = np.repeat(np.arange(len(after)), np.diff(after, prepend=0))[at]
            base = np.concatenate([[0], np.cumsum([len(s) + 1 for s in block])[:-1]])
            hashes.append(Rolling(data).ranges(begin[at], end[at + window - 1]))
            owner.append((line + lo).astype(np.int32))
            offset.append((at - np.concatenate([[0], after[:-1]])[line]).astype(np.int32))
            firsts.append((begin[at] - base[line]).astype(np.int32))
            spans.append((end[at + window - 1] - begin[at]).astype(np.int32))
            lo, block, size = i + 1, [], 0
        if not strings:
            return
        h, owner, offset = np.concatenate(hashes), np.concatenate(owner), np.concatenate(offset)
        first, span = np.concatenate(firsts), np.concatenate(spans)
        repeated = np.zeros(len(h), bool)
        order = np.argsort(h, kind="stable")
        same = np.flatnonzero(h[order][1:] == h[order][:-1])
        runs = np.split(same, np.flatnonzero(np.diff(same) != 1) + 1) if len(same) else []
        for run in runs:
            members = order[run[0] : run[-1] + 2].tolist()
            by_words: dict[bytes, list[int]] = {}
            for m in members:
                by_words.setdefault(strings[owner[m]][first[m] : first[m] + span[m]], []).append(m)
            for equal in by_words.values():
                if len(equal) > 1:
                    repeated[equal] = True
        bounds = np.searchsorted(owner, np.arange(len(strings) + 1))
        for i, refs in enumerate(self.refs):
            if len(refs) > 1:
                found = [(0, int(bounds[i + 1] - bounds[i]) - 1 + window)]
            else:
                found = covered(repeated[bounds[i] : bounds[i + 1]], window)
            for r1, r2, start, known in refs:
                if not known:
                    for a, b in found:
                        yield r1, r2, start + a, start + b


class Strings:
    """Packed strings of a block at one level, with the documents and words at which they start.

    ``known``: all their windows are reported as repeated already. A string that occurs again in the block is sent once, from its first place.
    """

    def __init__(self, texts: list[bytes], r1: np.ndarray, r2: np.ndarray, start: np.ndarray, known: np.ndarray, window: int, level: int, buckets: int):
        joined, text, first, count, minimiser, bounds = super_kmers(texts, window, level)
        self.strings = [joined[a:b] for a, b in bounds.tolist()]
        n, seen = len(self.strings), {}
        origin = np.fromiter((seen.setdefault(s, i) for i, s in enumerate(self.strings)), np.int64, n)
        again = np.bincount(origin, minlength=n)[origin] > 1 if n else np.zeros(0, bool)
        was = known[text]
        self.r1, self.r2, self.start = r1[text], r2[text], start[text] + first
        self.stop = self.start + count - 1 + window
        self.known, self.news = again | was, again & ~was
        self.sent = np.flatnonzero(origin == np.arange(n))
        self.bucket = (minimiser % np.uint64(buckets)).astype(np.int64) + (level << LEVEL_BITS)

    def next(self, rows: np.ndarray, window: int, level: int, buckets: int) -> Strings:
        """Some of the strings, cut by the hash of another level."""
        of = [self.strings[i] for i in rows.tolist()]
        return Strings(of, self.r1[rows], self.r2[rows], self.start[rows], self.known[rows], window, level, buckets)


def blocks(batches: Batches, window: int) -> Iterator[tuple[list[bytes], np.ndarray, np.ndarray]]:
    """Texts of single-spaced words that have a window, some megabytes at a time, with the hashes of their documents."""
    texts: list[bytes] = []
    r1: list[int] = []
    r2: list[int] = []
    size = 0
    for batch in batches:
        for raw, a, b in zip(raw_texts(batch), batch.column("r1").to_pylist(), batch.column("r2").to_pylist()):
            words = raw.split()
            if len(words) < window:
                continue
            texts.append(b" ".join(words))
            r1.append(a)
            r2.append(b)
            size += len(raw)
            if size >= BLOCK_BYTES:
                yield texts, np.array(r1, np.int64), np.array(r2, np.int64)
                texts, r1, r2, size = [], [], [], 0
    if texts:
        yield texts, np.array(r1, np.int64), np.array(r2, np.int64)


def levels_of(block: tuple, window: int, buckets: int, hot: list[np.ndarray]) -> Iterator[tuple[Strings, np.ndarray, int]]:
    """Strings of a block level by level, the sent ones that stay at this level, and the level; ``hot`` has the divided buckets of each."""
    texts, r1, r2 = block
    zero = np.zeros(len(texts), np.int64)
    level, now = 0, Strings(texts, r1, r2, zero, zero.astype(bool), window, 0, buckets)
    while True:
        divided = np.isin(now.bucket[now.sent], hot[level]) if level < len(hot) else np.zeros(len(now.sent), bool)
        yield now, now.sent[~divided], level
        if not divided.any():
            return
        level, now = level + 1, now.next(now.sent[divided], window, level + 1, buckets)


def pack_blocks(batches: Batches, window: int, buckets: int, hot: list[np.ndarray]) -> Batches:
    """Rows (bucket, blob, refs) of a task's input; bucket -1 has ranges that are known to be repeated already."""
    pack = zstandard.ZstdCompressor(level=LEVEL).compress
    for block in blocks(batches, window):
        out = {name: [] for name in ("bucket", "blob", "r1", "r2", "start", "stop", "known")}
        for strings, stay, _ in levels_of(block, window, buckets, hot):

            def put(bucket: int, blob: bytes, rows: np.ndarray, of: Strings = strings) -> None:
                for name, value in (("bucket", bucket), ("blob", blob)):
                    out[name].append(value)
                for name in ("r1", "r2", "start", "stop", "known"):
                    out[name].append(pack(np.ascontiguousarray(getattr(of, name)[rows]).tobytes()))

            if strings.news.any():
                put(-1, b"", np.flatnonzero(strings.news))
            where = strings.bucket[stay]
            order = np.argsort(where, kind="stable")
            for rows in np.split(stay[order], np.flatnonzero(np.diff(where[order])) + 1) if len(stay) else []:
                put(int(strings.bucket[rows[0]]), pack(b"\n".join([strings.strings[i] for i in rows.tolist()])), rows)
        kinds = [pa.int64(), *[pa.binary()] * 6]
        yield batch_of(**{name: pa.array(values, kind) for (name, values), kind in zip(out.items(), kinds)})


def hot_buckets(rows: DataFrame, window: int, buckets: int, bucket_bytes: int) -> list[np.ndarray]:
    """The buckets of each level that get more than ``bucket_bytes``: fewer than the strings' bytes over that bound.

    Every pass adds up the bytes of all buckets of a level; there is a further one only while some are too large.
    """
    hot: list[np.ndarray] = []
    while len(hot) < LEVELS - 1:
        deepest = len(hot)

        def weigh(batches: Batches, hot: list[np.ndarray] = list(hot), deepest: int = deepest) -> Batches:
            number, size = [], []
            for block in blocks(batches, window):
                for strings, stay, level in levels_of(block, window, buckets, hot):
                    if level == deepest and len(stay):
                        kinds, which = np.unique(strings.bucket[stay], return_inverse=True)
                        number.append(kinds)
                        size.append(np.bincount(which, np.array([len(strings.strings[i]) for i in stay.tolist()])).astype(np.int64))
                if sum(map(len, number)) > 1 << 16:
                    yield batch_of(bucket=pa.array(np.concatenate(number)), size=pa.array(np.concatenate(size)))
                    number, size = [], []
            if number:
                yield batch_of(bucket=pa.array(np.concatenate(number)), size=pa.array(np.concatenate(size)))

        sums = rows.mapInArrow(weigh, "bucket long, size long").groupBy("bucket").agg(F.sum("size").alias("size"))
        found = [r.bucket for r in sums.filter(F.col("size") > bucket_bytes).select("bucket").collect()]
        if not found:
            break
        hot.append(np.array(sorted(found), np.int64))
    return hot


PACKED = "bucket long, blob binary, r1 binary, r2 binary, start binary, stop binary, known binary"
RANGES = "r1 long, r2 long, start long, stop long"


def bucket_ranges(batches: Batches, window: int) -> Batches:
    """Ranges of repeated windows; rows come sorted by bucket."""
    unpack = zstandard.ZstdDecompressor().decompress

    def batch(rows) -> pa.RecordBatch:
        cols = list(zip(*rows)) or [()] * 4
        return batch_of(**{n: pa.array(c, pa.int64()) for n, c in zip(("r1", "r2", "start", "stop"), cols)})

    held, current = Bucket(window), None
    for part in batches:
        for row in part.to_pylist():
            refs = [np.frombuffer(unpack(row[n]), np.int64).tolist() for n in ("r1", "r2", "start", "stop")]
            if row["bucket"] < 0:
                yield batch(list(zip(*refs)))
                continue
            if row["bucket"] != current:
                yield batch(held.ranges())
                held, current = Bucket(window), row["bucket"]
            held.add(unpack(row["blob"]).split(b"\n"), *refs[:3], np.frombuffer(unpack(row["known"]), bool).tolist())
    yield batch(held.ranges())


def repeated_windows(
    docs: DataFrame, window: int = 35, id_col: str = "doc_id", text_col: str = "text", buckets: int | None = None, with_text: bool = False,
    bucket_bytes: int = BUCKET_BYTES,
) -> DataFrame:
    """One row per document: id, n_words, n_removed, kept_sha256; ``with_text`` adds ``kept_text``.

    ``buckets``: by default as many as the texts' bytes ask for, each word being sent about three times.
    """
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    if buckets is None:
        size = docs.agg(F.sum(F.octet_length(F.col(f"`{text_col}`")))).first()[0] or 0
        buckets = parts * max(1, -(-3 * size // (parts * MEAN_BYTES)))
    k, t = F.col(f"`{id_col}`"), F.col(f"`{text_col}`")
    rows = docs.select(k.alias("k"), t.alias("t"), F.xxhash64(k.isNull(), k, t).alias("r1"), F.xxhash64(t, F.lit(1), k).alias("r2"))

    texts = rows.select("r1", "r2", "t")
    hot = hot_buckets(texts, window, buckets, bucket_bytes)

    def pack(batches: Batches) -> Batches:
        yield from pack_blocks(batches, window, buckets, hot)

    def count(batches: Batches) -> Batches:
        yield from bucket_ranges(batches, window)

    def cut(batches: Batches) -> Batches:
        for batch in batches:
            n_words, n_removed, kept = [], [], []
            for raw, ranges in zip(raw_texts(batch), batch.column("ranges").to_pylist()):
                words = raw.split()
                gone = np.zeros(len(words), bool)
                for r in ranges or ():
                    gone[r["start"] : r["stop"]] = True
                n_words.append(len(words))
                n_removed.append(int(gone.sum()))
                kept.append(b" ".join([w for w, g in zip(words, gone.tolist()) if not g] if n_removed[-1] else words))
            yield batch_of(
                k=batch.column("k"), n_words=pa.array(n_words, pa.int64()), n_removed=pa.array(n_removed, pa.int64()),
                kept_sha256=pa.array([hashlib.sha256(x).hexdigest() for x in kept], pa.string()),
                **({"kept_text": pa.array([x.decode() for x in kept], pa.string())} if with_text else {}),
            )

    packed = texts.mapInArrow(pack, PACKED)
    # every partition takes the same number of buckets; known ranges only pass through
    place = F.when(F.col("bucket") >= 0, F.col("bucket") % parts).otherwise(F.pmod(F.xxhash64("r1"), F.lit(parts)))
    dealt = packed.repartitionById(parts, place.cast("int"))
    ranges = dealt.sortWithinPartitions("bucket").mapInArrow(count, RANGES).distinct()
    of = ranges.groupBy("r1", "r2").agg(F.collect_list(F.struct("start", "stop")).alias("ranges"))
    schema = f"k {id_type(docs, id_col)}, n_words long, n_removed long, kept_sha256 string" + (", kept_text string" if with_text else "")
    return rows.join(of, ["r1", "r2"], "left").select("k", "t", "ranges").mapInArrow(cut, schema).withColumnRenamed("k", id_col)
