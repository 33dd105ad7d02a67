"""Benchmark decontamination: MinHash containment search with size partitions, then an exact check.

The queries are short test items, the data long documents. The Jaccard similarity of a short item and a long document is
tiny even when all of the item is inside, so both sides are partitioned by size: items by their number of
shingles, in classes up to a power of two, and each document, once per class, into blocks of as many shingles as the
class allows. An item of ``q`` shingles with a share ``t`` inside a document then lies in a few blocks, and the
similarities with these add up to about ``t / 3`` at least, whatever the document's length. Signatures have ``HASHES``
minima, each a band of its own, so an item is missed with a chance below 1e-6 at a containment of 0.8; a block and an item
become candidates when they share a minimum. Items of fewer than ``LEAST_CLASS`` shingles are too small for minima of blocks: a document that
holds ``m`` of an item's ``q`` shingles holds one of any ``q - m + 1``, and by these they are looked up, so none is missed. For each candidate
document the shared shingles are then counted exactly, over the whole document.

Words are runs of ASCII digits, lower-cased letters and non-ASCII characters; shingles have ``shingle`` words. Items
with fewer words, null or empty ones have no shingle and are contained nowhere. Null and empty documents contain nothing.
Repeated documents give repeated rows; an item that occurs twice under one id counts once, as the union of its texts.

A benchmark whose shingles take at most ``BROADCAST_BYTES`` is broadcast, and the documents are read once and never
shuffled. A larger one stays on the executors (``matches``): minima of items and of blocks meet in a join, and the
candidates' shingles in another, so the documents are read twice whatever the benchmark's size. There equal texts are
one text until the end, and minima of blocks that no item has are dropped by a Bloom filter of bounded size before the shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from halocline.llm.common import Batches, batch_of, delete_path, id_type, keyed_text, str_texts, written

HASHES = 48
#: Size of the smallest class, and bits of the filter of minima per hash.
LEAST_CLASS, FILTER_BITS = 8, 16
#: Most bytes of item shingles in a broadcast; shingles of documents that are compared at a time.
BROADCAST_BYTES, CHUNK = 16 << 20, 500_000
#: Of the Bloom filter of the join: bits per band, bits at most and bits of a piece as powers of two, odd factors of its two positions.
BITS_PER_BAND, MOST_BITS, PIECE_BITS = 16, 28, 15
MIXERS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
TO_WORDS = bytes(b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def shingle_hashes(text: str, shingle: int) -> tuple[np.ndarray, list[bytes]]:
    """64-bit hashes of a text's shingles in order, and its words."""
    words = words_of(text)
    if len(words) < shingle:
        return np.zeros(0, np.uint64), words
    pieces = map(b" ".join, zip(*(words[i:] for i in range(shingle))))
    digest = xxhash.xxh3_64_intdigest
    return np.fromiter((digest(p) for p in pieces), np.uint64, len(words) - shingle + 1), words


def multipliers() -> np.ndarray:
    """Odd factors of the hash family, from a fixed seed."""
    return np.random.default_rng(20).integers(0, 2**63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def minima(hashes: np.ndarray, starts: np.ndarray, factors: np.ndarray) -> np.ndarray:
    """32-bit minima, one row per hash function and one column per block that begins at ``starts``."""
    out = np.empty((len(factors), len(starts)), np.uint32)
    for i, factor in enumerate(factors):
        out[i] = np.minimum.reduceat(((hashes * factor) >> np.uint64(32)).astype(np.uint32), starts)
    return out


def block_starts(sizes: np.ndarray, step: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of ``sizes`` things in a row are cut every ``step``: starts, the run of each block, blocks per run."""
    blocks = -(-sizes // step)
    run = np.repeat(np.arange(len(sizes)), blocks)
    first = np.concatenate([[0], np.cumsum(blocks)[:-1]])
    offset = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    return offset[run] + (np.arange(len(run)) - first[run]) * step, run, blocks


def chunks(texts: list[str], shingle: int) -> Iterator[tuple[int, list[np.ndarray], list[list[bytes]]]]:
    """Texts in a row with about ``CHUNK`` shingles (one text at least): the first one's position, shingle hashes, words."""
    lo = 0
    while lo < len(texts):
        hashes, words, total = [], [], 0
        while lo + len(hashes) < len(texts) and total < CHUNK:
            h, w = shingle_hashes(texts[lo + len(hashes)], shingle)
            hashes.append(h)
            words.append(w)
            total += len(h)
        yield lo, hashes, words
        lo += len(hashes)


class ItemIndex:
    """Items by size class, and for each class and hash function their minima."""

    def __init__(self, items: list[tuple[object, list[bytes]]], shingle: int, threshold: float):
        self.shingle = shingle
        self.keys = [k for k, _ in items]
        self.texts = [set(s) for _, s in items]
        self.factors = multipliers()
        self.classes: dict[int, list[dict[int, list[int]]]] = {}
        self.filters: dict[int, np.ndarray] = {}
        self.small: dict[int, list[int]] = {}
        digest, mask = xxhash.xxh3_64_intdigest, (1 << FILTER_BITS) - 1
        for number, shingles in enumerate(self.texts):
            if not shingles:
                continue
            if len(shingles) < LEAST_CLASS:
                for s in sorted(shingles)[: len(shingles) - needed(len(shingles), threshold) + 1]:
                    self.small.setdefault(digest(s), []).append(number)
                continue
            size = 1 << (len(shingles) - 1).bit_length()
            maps = self.classes.setdefault(size, [{} for _ in range(HASHES)])
            found = np.array([digest(s) for s in shingles], np.uint64)
            for values, low in zip(maps, minima(found, np.zeros(1, int), self.factors)[:, 0].tolist()):
                values.setdefault(low, []).append(number)
        for size, maps in self.classes.items():
            bits = self.filters[size] = np.zeros((HASHES, mask + 1), bool)
            for i, values in enumerate(maps):
                bits[i, np.fromiter(values, np.uint32, len(values)) & np.uint32(mask)] = True
        self.small_keys = np.array(sorted(self.small), np.uint64)

    def candidates(self, hashes: list[np.ndarray]) -> dict[int, set[int]]:
        """For documents by position: the items that share a minimum with one of their blocks."""
        found: dict[int, set[int]] = {}
        sizes = np.array([len(h) for h in hashes], np.int64)
        if not sizes.sum():
            return found
        if len(self.small_keys):
            every = np.concatenate(hashes)
            place = np.minimum(np.searchsorted(self.small_keys, every), len(self.small_keys) - 1)
            hits = np.flatnonzero(self.small_keys[place] == every)
            for at, key in zip(np.searchsorted(np.cumsum(sizes), hits, side="right").tolist(), every[hits].tolist()):
                found.setdefault(at, set()).update(self.small[key])
        if not self.classes:
            return found
        finest = min(self.classes)
        starts, _, blocks = block_starts(sizes, finest)
        fine = minima(np.concatenate(hashes), starts, self.factors)
        mask = np.uint32((1 << FILTER_BITS) - 1)
        for size, maps in self.classes.items():
            starts, run, _ = block_starts(blocks, size // finest)
            for i in range(HASHES):
                low = np.minimum.reduceat(fine[i], starts)
                for at in np.flatnonzero(self.filters[size][i, low & mask]).tolist():
                    if items := maps[i].get(int(low[at])):
                        found.setdefault(int(run[at]), set()).update(items)
        return found

    def contained(self, texts: list[str], threshold: float) -> list[list[tuple[int, int]]]:
        """For each document the items whose shingles it shares to the threshold at least, with the shared number."""
        out: list[list[tuple[int, int]]] = [[] for _ in texts]
        for lo, hashes, words in chunks(texts, self.shingle):
            for at, items in self.candidates(hashes).items():
                own = distinct_shingles(words[at], self.shingle)
                for number in sorted(items):
                    shared = len(self.texts[number] & own)
                    if shared >= threshold * len(self.texts[number]):
                        out[lo + at].append((number, shared))
        return out


def words_of(text: str | None) -> list[bytes]:
    return (text or "").lower().encode().translate(TO_WORDS).split()


def distinct_shingles(words: list[bytes], shingle: int) -> set[bytes]:
    return set(map(b" ".join, zip(*(words[i:] for i in range(shingle)))))


def needed(size: int, threshold: float) -> int:
    """Fewest shingles of an item of ``size`` that reach the threshold."""
    return next(m for m in range(1, size + 1) if m >= threshold * size or m == size)


def fits_broadcast(benchmark: DataFrame, shingle: int, text_col: str) -> bool:
    """Whether all shingles stay within ``BROADCAST_BYTES``: a word stands in at most ``shingle`` of them, with one space."""
    octets = benchmark.agg(F.sum(F.octet_length(F.col(f"`{text_col}`")).cast("long") + 1)).first()[0] or 0
    return octets * shingle <= BROADCAST_BYTES


def collected_items(benchmark: DataFrame, shingle: int, id_col: str, text_col: str) -> list[tuple[object, list[bytes]]]:
    """Items with their distinct shingles, of a benchmark that ``fits_broadcast``."""
    items: dict[object, set[bytes]] = {}
    for row in keyed_text(benchmark, id_col, text_col).collect():
        items.setdefault(row.k, set()).update(distinct_shingles(words_of(row.t), shingle))
    return [(k, list(s)) for k, s in items.items()]


def positions(bands: np.ndarray, bits: int) -> list[np.ndarray]:
    """Places of 64-bit bands in a Bloom filter of ``2 ** bits`` bits."""
    return [(bands * np.uint64(m)) >> np.uint64(64 - bits) for m in MIXERS]


def band(size: int, number: int, low: np.ndarray) -> np.ndarray:
    """A class, a hash function and minima as one number each, below 2**63."""
    return (np.uint64(size.bit_length()) << np.uint64(40)) | (np.uint64(number) << np.uint64(32)) | low.astype(np.uint64)


def small_band(hashes: np.ndarray) -> np.ndarray:
    """A shingle by which small items are looked up, as a number from 2**63."""
    return (hashes >> np.uint64(1)) | np.uint64(1 << 63)


def signed(values: np.ndarray) -> pa.Array:
    return pa.array(values.astype(np.uint64, copy=False).view(np.int64))


def item_shingles(benchmark: DataFrame, shingle: int, id_col: str, text_col: str) -> DataFrame:
    """Distinct ``(i, s, h)``: item, shingle, its hash."""

    def cut(batches: Batches) -> Batches:
        for batch in batches:
            for one in range(len(batch)):
                found = list(distinct_shingles(words_of(batch.column("t")[one].as_py()), shingle))
                hashes = np.array([xxhash.xxh3_64_intdigest(s) for s in found], np.uint64)
                owner = pa.repeat(batch.column("k")[one], len(found))
                yield batch_of(i=owner, s=pa.array(found, pa.binary()), h=signed(hashes))

    schema = f"i {id_type(benchmark, id_col)}, s binary, h long"
    return keyed_text(benchmark, id_col, text_col).mapInArrow(cut, schema).distinct()


def item_minima(benchmark: DataFrame, shingle: int, id_col: str, text_col: str) -> DataFrame:
    """``(i, m0, m1, ...)``: the minima of each item over all its texts; a text is one row before the shuffle."""
    names, factors = [f"m{n}" for n in range(HASHES)], multipliers()

    def lowest(batches: Batches) -> Batches:
        for batch in batches:
            for lo, hashes, _ in chunks(str_texts(batch), shingle):
                some = np.array([n for n, h in enumerate(hashes) if len(h)], np.int64)
                if not len(some):
                    continue
                starts = np.concatenate([[0], np.cumsum([len(hashes[n]) for n in some])[:-1]])
                lows = minima(np.concatenate(hashes), starts, factors).astype(np.int64)
                owner = batch.column("k").take(pa.array(lo + some))
                yield pa.RecordBatch.from_arrays([owner, *(pa.array(row) for row in lows)], ["i", *names])

    schema = f"i {id_type(benchmark, id_col)}, " + ", ".join(f"{n} long" for n in names)
    return keyed_text(benchmark, id_col, text_col).mapInArrow(lowest, schema).groupBy("i").agg(*[F.min(n).alias(n) for n in names])


def class_bits() -> Column:
    """The class of an item with ``n`` shingles as a power of two, 0 for small ones."""
    return F.when(F.col("n") >= LEAST_CLASS, F.length(F.bin(F.col("n") - 1))).otherwise(0)


def item_bands(lows: DataFrame, shingles: DataFrame, sizes: DataFrame, threshold: float) -> DataFrame:
    """``(b, i)``: the numbers by which items are found. Items of a class have one per hash function, small ones one per looked-up shingle."""
    kind = shingles.schema["i"].dataType.simpleString()

    def number(batches: Batches) -> Batches:
        for batch in batches:
            top = (batch.column("c").to_numpy().astype(np.uint64) + np.uint64(1)) << np.uint64(40)
            for n in range(HASHES):
                yield batch_of(b=signed(top | (np.uint64(n) << np.uint64(32)) | batch.column(f"m{n}").to_numpy().view(np.uint64)), i=batch.column("i"))

    same = F.col("a.i").eqNullSafe(F.col("z.i"))
    classed = sizes.withColumn("c", class_bits())
    large = lows.alias("a").join(classed.filter("c > 0").alias("z"), same).select("a.*", "z.c").mapInArrow(number, f"b long, i {kind}")
    probes = F.coalesce(*[F.when(F.col("n") == q, q - needed(q, threshold) + 1) for q in range(1, LEAST_CLASS)])
    place = F.row_number().over(Window.partitionBy("i").orderBy("s"))  # at most LEAST_CLASS - 1 rows
    small = shingles.alias("a").join(classed.filter("c = 0").alias("z"), same).select("a.*", "z.n")
    small = small.withColumn("p", place).filter(F.col("p") <= probes)
    top = F.lit(-(1 << 63)).cast("long")
    return large.unionByName(small.select(F.shiftrightunsigned("h", 1).bitwiseOR(top).alias("b"), "i"))


def bloom_filter(bands: DataFrame, bits: int) -> np.ndarray:
    """A Bloom filter of the bands as bytes, made in pieces on the executors; ``2 ** bits`` bits reach the driver whatever the bands."""
    piece = min(PIECE_BITS, bits)

    def place(batches: Batches) -> Batches:
        for batch in batches:
            for at in positions(batch.column("b").to_numpy().view(np.uint64), bits):
                yield batch_of(p=signed(at >> np.uint64(piece)), o=pa.array((at & np.uint64((1 << piece) - 1)).astype(np.int64)))

    def pack(table: pa.Table) -> pa.Table:
        field = np.zeros(1 << piece, bool)
        field[table.column("o").to_numpy()] = True
        return pa.table({"p": table.column("p")[:1], "bytes": pa.array([np.packbits(field).tobytes()], pa.binary())})

    out = np.zeros((1 << (bits - piece), (1 << piece) >> 3), np.uint8)
    places = bands.mapInArrow(place, "p long, o long").distinct()
    for row in places.groupBy("p").applyInArrow(pack, "p long, bytes binary").toLocalIterator():
        out[row.p] = np.frombuffer(row.bytes, np.uint8)
    return out.reshape(-1)


def text_bands(texts: DataFrame, shingle: int, sizes: list[int], any_small: bool, field: np.ndarray, bits: int) -> DataFrame:
    """Distinct ``(b, u)`` of texts ``(u, t)``: the numbers of their blocks, for classes ``sizes``, and shingles that the filter lets pass."""
    shared = texts.sparkSession.sparkContext.broadcast(field)

    def keep(bands: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        for n in range(len(MIXERS)):
            at = positions(bands, bits)[n]
            hit = (shared.value[at >> np.uint64(3)] >> (np.uint64(7) - (at & np.uint64(7))).astype(np.uint8)) & np.uint8(1) == 1
            bands, owner = bands[hit], owner[hit]
        return bands, owner

    def found(hashes: list[np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        every = np.concatenate(hashes)
        lengths = np.array([len(h) for h in hashes], np.int64)
        if not len(every):
            return
        if any_small:
            yield keep(small_band(every), np.repeat(np.arange(len(hashes)), lengths))
        if not sizes:
            return
        factors, finest = multipliers(), min(sizes)
        starts, _, blocks = block_starts(lengths, finest)
        fine = minima(every, starts, factors)
        for size in sizes:
            starts, run, _ = block_starts(blocks, size // finest)
            for n in range(HASHES):
                yield keep(band(size, n, np.minimum.reduceat(fine[n], starts)), run)

    def cut(batches: Batches) -> Batches:
        for batch in batches:
            for lo, hashes, _ in chunks(str_texts(batch), shingle):
                for bands, owner in found(hashes):
                    if len(bands):
                        yield batch_of(b=signed(bands), u=batch.column("u").take(pa.array(lo + owner)))

    return texts.mapInArrow(cut, "b long, u binary").distinct()


def text_key(text_col: str) -> Column:
    """128 bits of a text; null counts as empty."""
    digest = F.sha2(F.coalesce(F.col(f"`{text_col}`"), F.lit("")), 256)
    return F.unhex(F.substring(digest, 1, 32))


def matches(docs: DataFrame, benchmark: DataFrame, shingle: int, threshold: float, text_col: str, item_col: str, item_text_col: str) -> DataFrame:
    """``(u, i, n_shingles, n_shared)`` for distinct texts ``u`` (``text_key``) and items inside, by joins on the executors.

    Stored tables end the lineage between steps. A text that holds an item of many copies, or an item that many texts hold, is a hot
    key with rows of its own in the result; adaptive joins split it.
    """
    spark, folders = docs.sparkSession, []

    def stored(df: DataFrame, name: str) -> DataFrame:
        table, path = written(df, name)
        folders.append(path)
        return table

    shingles = stored(item_shingles(benchmark, shingle, item_col, item_text_col), "item-shingles")
    sizes = stored(shingles.groupBy("i").agg(F.count(F.lit(1)).alias("n")), "item-sizes")
    bands = stored(item_bands(item_minima(benchmark, shingle, item_col, item_text_col), shingles, sizes, threshold), "item-bands")
    kinds = [r[0] for r in sizes.select(class_bits().alias("c")).distinct().collect()]  # at most 64
    bits = min(MOST_BITS, max(10, (bands.count() * BITS_PER_BAND).bit_length()))
    texts = docs.select(text_key(text_col).alias("u"), F.col(f"`{text_col}`").alias("t"))
    field = bloom_filter(bands, bits)
    seen = text_bands(texts, shingle, sorted(1 << k for k in kinds if k), 0 in kinds, field, bits)
    pairs = stored(seen.join(bands, "b").select("u", "i").distinct(), "item-candidates")

    def cut(batches: Batches) -> Batches:
        for batch in batches:
            for one in range(len(batch)):
                own = list(distinct_shingles(words_of(batch.column("t")[one].as_py()), shingle))
                yield batch_of(u=pa.repeat(batch.column("u")[one], len(own)), s=pa.array(own, pa.binary()))

    some = texts.join(pairs.select("u").distinct(), "u", "left_semi").dropDuplicates(["u"])
    same = F.col("a.i").eqNullSafe(F.col("z.i"))
    wanted = pairs.alias("a").join(shingles.alias("z"), same).select("a.u", "a.i", "z.s")
    hits = some.mapInArrow(cut, "u binary, s binary").join(wanted, ["u", "s"]).groupBy("u", "i").agg(F.count(F.lit(1)).alias("n_shared"))
    counted = hits.alias("a").join(sizes.alias("z"), same).filter(F.col("n_shared") >= threshold * F.col("n"))
    result, _ = written(counted.select("a.u", "a.i", F.col("n").alias("n_shingles"), "n_shared"), "item-matches")
    for path in folders:
        delete_path(spark, path)
    return result


def find_contained(
    docs: DataFrame,
    benchmark: DataFrame,
    shingle: int = 5,
    threshold: float = 0.8,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
) -> DataFrame:
    """One row per document and item that it contains: ids, n_shingles of the item, n_shared, containment."""
    if not fits_broadcast(benchmark, shingle, item_text_col):
        inside = matches(docs, benchmark, shingle, threshold, text_col, item_col, item_text_col)
        rows = docs.select(F.col(f"`{id_col}`").alias("k"), text_key(text_col).alias("u")).join(inside, "u")
        return rows.select(
            F.col("k").alias(id_col), F.col("i").alias(item_col), "n_shingles", "n_shared", (F.col("n_shared") / F.col("n_shingles")).alias("containment")
        )
    key, item = id_type(docs, id_col), id_type(benchmark, item_col)
    schema = f"k {key}, i {item}, n_shingles long, n_shared long, containment double"
    item_kind = to_arrow_type(benchmark.schema[item_col].dataType)
    shared = docs.sparkSession.sparkContext.broadcast(collected_items(benchmark, shingle, item_col, item_text_col))

    def search(batches: Batches) -> Batches:
        index = ItemIndex(shared.value, shingle, threshold)
        for batch in batches:
            rows = zip(batch.column("k").to_pylist(), index.contained(str_texts(batch), threshold))
            out = [(k, index.keys[n], len(index.texts[n]), hit, hit / len(index.texts[n])) for k, items in rows for n, hit in items]
            cols = list(zip(*out)) or [()] * 5
            yield batch_of(
                k=pa.array(cols[0], batch.schema.field("k").type), i=pa.array(cols[1], item_kind), n_shingles=pa.array(cols[2], pa.int64()),
                n_shared=pa.array(cols[3], pa.int64()), containment=pa.array(cols[4], pa.float64()),
            )

    found = keyed_text(docs, id_col, text_col).mapInArrow(search, schema)
    return found.select(F.col("k").alias(id_col), F.col("i").alias(item_col), "n_shingles", "n_shared", "containment")


def drop_contaminated(
    docs: DataFrame, benchmark: DataFrame, shingle: int = 5, threshold: float = 0.8, text_col: str = "text",
    item_col: str = "item_id", item_text_col: str = "text",
) -> DataFrame:
    """The documents that contain no item, with all their columns; with a broadcast benchmark without a shuffle."""
    if not fits_broadcast(benchmark, shingle, item_text_col):
        inside = matches(docs, benchmark, shingle, threshold, text_col, item_col, item_text_col).select("u").distinct()
        name = max([*docs.columns, "u"], key=len) + "_u"  # longer than any column's name
        return docs.withColumn(name, text_key(text_col)).join(inside.withColumnRenamed("u", name), name, "left_anti").drop(name)
    shared = docs.sparkSession.sparkContext.broadcast(collected_items(benchmark, shingle, item_col, item_text_col))

    def keep(batches: Batches) -> Batches:
        index = ItemIndex(shared.value, shingle, threshold)
        for batch in batches:
            hits = index.contained(str_texts(batch, text_col), threshold)
            yield batch.filter(pa.array([not h for h in hits], pa.bool_()))

    return docs.mapInArrow(keep, docs.schema)
