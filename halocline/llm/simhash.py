"""Near duplicates by SimHash, linked by meet-in-the-middle ball hashing.

A fingerprint has 64 bits; a bit is 1 if it is set in over half of the hashes of the document's shingles.
Two fingerprints within ``3`` bits meet: somewhere between them lies a value at most 1 bit from one and 2 from
the other. So every distinct fingerprint emits the values near it (its ball), the values are shuffled, and those
that came from several fingerprints link them. Two things keep the balls small:

* An odd distance means that the parities differ. So only fingerprints of even parity emit values 2 bits away, and
  only with both bits in the same 16 (of any three bits, two are in the same half).
* One half of 32 bits differs in at most one bit. So a first shuffle takes just the balls of the halves (1 value,
  or 33 at even parity), and only where another fingerprint has that half do the other half's values follow.

At each meeting value the fingerprint nearest to it is linked to all others; if it is within 1 bit, all these links are
true ones by the triangle inequality (and verified by their distance). So links grow with the balls, never with the
square of a group, and fingerprints that are connected by links of up to 3 bits stay so. A meeting value has at most as
many members as a ball has values. Equal fingerprints are one node, however many documents share it.

Words are runs of anything but ASCII white space, after lower-casing A-Z. Fewer words than a shingle: the whole
sequence is hashed. No words (null, empty): fingerprint zero, which links like any other. A component is named by its
smallest id; null ids count in it but name it only if there is no other. Repeated rows are rows.
"""

from __future__ import annotations

import re
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from halocline.llm.common import SPACE, Batches, batch_of, id_type, keyed_text, raw_texts, written
from halocline.llm.components import components

SEED, MAX_BITS = 42, 3
HALF = 32
#: Bytes of a text that are cut into shingles at a time; a block ends before white space.
BLOCK_BYTES = 1 << 20
GAP = re.compile(SPACE)


def fingerprint(raw: bytes, shingle: int = 3) -> int:
    """Fingerprint of a whole text, read a block at a time; a block starts with the words that its last shingles lack."""
    counts, n = np.zeros(64, np.int64), 0
    words: list[bytes] = []

    def add(pieces: list[bytes]) -> int:
        h = np.array([xxhash.xxh64_intdigest(p, SEED) for p in pieces], ">u8")
        counts[:] += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
        return len(pieces)

    at = 0
    while at < len(raw):
        cut = GAP.search(raw, at + BLOCK_BYTES)
        end = cut.start() if cut else len(raw)
        words += raw[at:end].lower().split()
        done = add(list(map(b" ".join, zip(*(words[i:] for i in range(shingle))))))
        words, n, at = words[done:], n + done, end
    if not n and words:
        n = add([b" ".join(words)])
    return int.from_bytes(np.packbits(2 * counts > n).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """(k, th, fp): id, a hash of the text that tells rows of one id apart, and the fingerprint as a signed long."""

    def compute(batches: Batches) -> Batches:
        for batch in batches:
            fps = np.array([fingerprint(raw, shingle) for raw in raw_texts(batch)], np.uint64)
            yield batch_of(k=batch.column("k"), th=batch.column("th"), fp=pa.array(fps.view(np.int64)))

    source = keyed_text(docs, id_col, text_col).withColumn("th", F.xxhash64("t"))
    return source.mapInArrow(compute, f"k {id_type(docs, id_col)}, th long, fp long")


def ball(most: int) -> Column:
    """Masks within ``most`` bits of a half, as (mask, r); pairs of bits only within the same 16."""
    masks = [(0, 0)]
    if most >= 1:
        masks += [(1 << i, 1) for i in range(HALF)]
    if most >= 2:
        masks += [((1 << i) | (1 << j), 2) for lo in (0, HALF // 2) for i, j in combinations(range(lo, lo + HALF // 2), 2)]
    return F.expr("array(" + ",".join(f"named_struct('mask', {m}L, 'r', {r})" for m, r in masks) + ")")


def even(half: str) -> Column:
    return F.bit_count(half) % 2 == 0


def links_within(nodes: DataFrame) -> DataFrame:
    """Links (a, b) that connect the distinct fingerprints ``fp`` within ``MAX_BITS`` bits."""
    upper, lower = F.shiftrightunsigned("fp", HALF), F.col("fp").bitwiseAND((1 << HALF) - 1)
    halves = nodes.select("fp", F.explode(F.array(
        F.struct(F.lit(0).alias("side"), upper.alias("near"), lower.alias("far")),
        F.struct(F.lit(1).alias("side"), lower.alias("near"), upper.alias("far")),
    )).alias("h")).select("fp", "h.*")
    first = halves.select("fp", "side", "near", "far", F.explode(F.when(even("near"), ball(1)).otherwise(ball(0))).alias("v"))
    first = first.select("fp", "side", "far", F.col("near").bitwiseXOR(F.col("v.mask")).alias("m"), F.col("v.r").alias("r"))
    meet = first.groupBy("side", "m").agg(F.count("*").alias("n"), F.min("r").alias("least"))
    live = first.join(meet.filter("n > 1 and least = 0").select("side", "m"), ["side", "m"], "left_semi")
    wide = F.when(even("far"), F.when(F.col("r") == 0, ball(2)).otherwise(ball(1))).otherwise(ball(1))
    second = live.select("fp", "side", "m", "r", "far", F.explode(wide).alias("v")).select(
        "fp", "side", "m", F.col("far").bitwiseXOR(F.col("v.mask")).alias("m2"), (F.col("r") + F.col("v.r")).alias("r")
    )
    stars = second.groupBy("side", "m", "m2").agg(F.min(F.struct("r", "fp")).alias("centre"), F.collect_set("fp").alias("members"))
    stars = stars.filter((F.size("members") > 1) & (F.col("centre.r") <= 1))
    links = stars.select(F.col("centre.fp").alias("a"), F.explode("members").alias("b"))
    return links.filter((F.col("a") != F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= MAX_BITS)).distinct()


def classes(docs: DataFrame, id_col: str, text_col: str, shingle: int) -> DataFrame:
    """(k, th, fp, component_id) per document."""
    rows, _ = written(fingerprints(docs, id_col, text_col, shingle), "fingerprints")
    nodes, _ = written(rows.groupBy("fp").agg(F.min("k").alias("k")), "fingerprint-nodes")
    found = components(links_within(nodes)).withColumnRenamed("a", "fp").withColumnRenamed("b", "root")
    rooted = nodes.join(found, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    names = rooted.groupBy("root").agg(F.min("k").alias("component_id"))
    named, _ = written(rooted.join(names, "root").select("fp", "component_id"), "fingerprint-components")
    return rows.join(named, "fp")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """One row per document: id, fingerprint (16 hex digits), component_id (smallest id reachable over links)."""
    return classes(docs, id_col, text_col, shingle).select(
        F.col("k").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """The rows whose id names their component, with all their columns.

    Null ids stay only where they name one. An id may repeat: rows are told apart by id and text, and all rows of a component that carry its name stay.
    """
    names = docs.columns
    inner = [f"c{i}" for i in range(len(names))]  # columns of any name go through under plain ones
    key, text = inner[names.index(id_col)], inner[names.index(text_col)]
    found = classes(docs, id_col, text_col, shingle)
    gone = found.filter(~F.col("k").eqNullSafe(F.col("component_id"))).select("k", "th").distinct()
    same = F.col(key).eqNullSafe(F.col("k")) & (F.xxhash64(text) == F.col("th"))
    return docs.toDF(*inner).join(gone, same, "left_anti").toDF(*names)
