"""Exact, near and substring deduplication, decontamination and sharding against plain versions."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from halocline.llm.components import components
from halocline.llm.decontaminate import drop_contaminated, find_contained
from halocline.llm.exact_dedup import OpenTable, assign_copies, drop_copies
from halocline.llm.sharding import assign_shards, write_shards
from halocline.llm.simhash import MAX_BITS, drop_near_duplicates, fingerprint, links_within, near_duplicates
from halocline.llm.substring import repeated_windows

CLASHING = "doc_id long, text string, keep_id string, fp long, k int, t string, __h int"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "x", 1, 2, "y", n) for n, (i, t) in enumerate(rows)], CLASHING)


COPIES = [
    (1, "a"), (2, "a"), (3, ""), (4, None), (None, "a"), (5, "b"), (5, "b"), (None, None), (6, "c" * 50_000), (7, "c" * 50_000),
    (8, "a "), *((100 + i, "hot copy") for i in range(300)),
]


@pytest.mark.parametrize("window,memory", [(1 << 25, 1 << 26), (1, 1), (4000, 20_000)])
def test_exact_copies(spark, window, memory):
    docs = frame(spark, COPIES)
    got = [tuple(r) for r in assign_copies(docs, window=window, memory=memory).collect()]
    groups = defaultdict(list)
    for i, t in COPIES:
        groups[t or ""].append(i)
    keep = {t: max((i for i in v if i is not None), default=None) for t, v in groups.items()}
    want = [(i, keep[t or ""], len(groups[t or ""]), hashlib.sha256((t or "").encode()).hexdigest()) for i, t in COPIES]
    assert Counter((a, b, c, e) for a, b, c, _, e in got) == Counter(want)
    stay = Counter(e for _, _, _, kept, e in got if kept)
    assert set(stay.values()) == {1} and len(stay) == len(groups)
    assert all(a == b for a, b, _, kept, _ in got if kept)
    left = drop_copies(docs, window=window, memory=memory)
    assert left.columns == docs.columns
    assert Counter((r.doc_id, r.text or "") for r in left.collect()) == Counter((keep[t], t) for t in groups)


def test_open_table_compares_contents_of_equal_hash():
    table = OpenTable()
    assert [table.add(7, c) for c in (b"x", b"y", b"x")] == [0, 1, 0]
    assert [table.add(i, b"z%d" % i) for i in range(2000)] == list(range(2, 2002))


def test_empty_tables(spark):
    none = frame(spark, [])
    for result in (assign_copies(none), drop_copies(none), near_duplicates(none), drop_near_duplicates(none), repeated_windows(none), assign_shards(none, 10)):
        assert result.collect() == []
    items = spark.createDataFrame([(1, "one two three four five six")], "item_id long, text string")
    assert find_contained(none, items).collect() == []
    some = frame(spark, [(1, "one two three four five six")])
    assert find_contained(some, items.limit(0)).collect() == []
    assert drop_contaminated(some, items.limit(0)).count() == 1


def plain_fingerprint(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    pieces = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [b" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(p, 42) for p in pieces]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_fingerprint_of_a_text_in_many_blocks(monkeypatch):
    rng = random.Random(5)
    texts = ["".join(rng.choices(["ab", "C", " ", "\n\t ", "xyz", "é", "q" * 30], k=k)) for k in range(120)]
    want = [plain_fingerprint(t) for t in texts]
    for size in (1, 7, 40):
        monkeypatch.setattr("halocline.llm.simhash.BLOCK_BYTES", size)
        assert [fingerprint(t.encode()) for t in texts] == want


def plain_components(nodes):
    """Smallest member of each node's group, linked at three bits or fewer."""
    parent = {n: n for n in nodes}

    def root(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for a in nodes:
        for b in nodes:
            if bin(a ^ b).count("1") <= MAX_BITS:
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return {n: root(n) for n in nodes}


def test_balls_connect_just_what_is_within_three_bits(spark):
    rng = random.Random(1)
    values = set()
    for _ in range(60):
        seed = rng.getrandbits(64)
        values.add(seed)
        for _ in range(6):
            for bits in (1, 2, 3, 4, 5):
                flipped = seed
                for b in rng.sample(range(64), bits):
                    flipped ^= 1 << b
                values.add(flipped)
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    links = links_within(spark.createDataFrame([(v,) for v in signed], "fp long"))
    mask = (1 << 64) - 1
    assert all(bin((r.a ^ r.b) & mask).count("1") <= 3 for r in links.collect())
    roots = {r.a & mask: r.b & mask for r in components(links).collect()}
    groups, want = defaultdict(set), defaultdict(set)
    for v in values:
        groups[roots.get(v, v)].add(v)
    for v, r in plain_components(values).items():
        want[r].add(v)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, want.values()))


def test_dense_cluster_makes_no_pairs_of_all(spark):
    """All 4096 values of 12 bits: links stay far below the pairs within three bits, and connect everything."""
    links = links_within(spark.range(4096).selectExpr("shiftleft(id, 20) as fp"))
    pairs = 4096 * (12 + 66 + 220) // 2
    assert links.count() < pairs
    assert components(links).groupBy("b").count().collect() == [(0, 4095)]


def test_near_duplicates_equal_a_plain_version(spark):
    rng = random.Random(2)
    words = ["w%d" % i for i in range(500)]
    rows = [(None, ""), (900, None), (901, "One"), (902, "one"), (903, "one two"), (904, "ONE\x0btwo")]
    for i in range(40):
        base = rng.choices(words, k=rng.choice([5, 60, 400]))
        for j in range(5):
            text = list(base)
            if j:
                text[rng.randrange(len(text))] = rng.choice(words)
            rows.append((5000 - 10 * i + j, " ".join(text)))
    rows += rows[-3:]
    fps = {t: plain_fingerprint(t) for _, t in rows}
    assert all(fingerprint((t or "").encode()) == f for t, f in fps.items())
    roots = plain_components(set(fps.values()))
    names = defaultdict(list)
    for i, t in rows:
        names[roots[fps[t]]].append(i)
    least = {r: min((i for i in v if i is not None), default=None) for r, v in names.items()}
    docs = frame(spark, rows)
    got = Counter((r.doc_id, r.fingerprint, r.component_id) for r in near_duplicates(docs).collect())
    assert got == Counter((i, f"{fps[t]:016x}", least[roots[fps[t]]]) for i, t in rows)
    kept = drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == set(least.values())


def plain_windows(rows, window):
    seen = Counter()
    texts = [(t or "").encode().split() for _, t in rows]
    for w in texts:
        seen.update(tuple(w[i : i + window]) for i in range(len(w) - window + 1))
    out = []
    for (i, _), w in zip(rows, texts):
        gone = {j + k for j in range(len(w) - window + 1) if seen[tuple(w[j : j + window])] > 1 for k in range(window)}
        kept = b" ".join(x for j, x in enumerate(w) if j not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept).hexdigest()))
    return Counter(out)


@pytest.mark.parametrize("window", [2, 7, 35])
@pytest.mark.parametrize("block", [300, 1 << 22])
def test_repeated_windows_equal_a_plain_count(spark, window, block, monkeypatch):
    from halocline.llm import substring

    rng = random.Random(window)
    words = ["a", "b", "of", "thé", "x" * 30, "c"]
    passages = [rng.choices(words, k=n) for n in (20, 50, 90)]
    rows = [(None, None), (1, ""), (2, "a  b\n\na"), (3, "z " * 200), (4, " ".join(passages[2])), (4, " ".join(passages[2])), (None, "q " * 40)]
    for i in range(60):
        text = [f"u{rng.random()}" for _ in range(rng.randint(0, 60))] + rng.choice(passages) + [f"v{rng.random()}" for _ in range(20)]
        rows.append((10 + i, rng.choice([" ", "\n", " \t"]).join(text)))
    monkeypatch.setattr(substring, "BLOCK_BYTES", block)
    got = Counter(map(tuple, repeated_windows(frame(spark, rows).repartition(3), window=window, buckets=5).collect()))
    assert got == plain_windows(rows, window)


@pytest.mark.parametrize("limit", [3000, 400])
def test_a_minimiser_in_every_document_is_divided(spark, limit):
    """One phrase before many different words, and copies that no hash can divide."""
    from halocline.llm import substring

    rng = random.Random(8)
    phrase = "this phrase is everywhere you look".split()
    rows = [(i, " ".join([f"a{rng.randrange(9)}", *phrase, *(f"w{rng.randrange(40)}" for _ in range(12)), *phrase])) for i in range(300)]
    rows += [(1000 + i, " ".join([*phrase, "and", "then", "the", "same", "words", "again"])) for i in range(40)]
    docs = frame(spark, rows).repartition(5)
    texts = docs.select(F.col("doc_id").alias("r1"), F.col("doc_id").alias("r2"), F.col("text").alias("t"))
    hot = substring.hot_buckets(texts, 7, 3, limit)
    assert len(hot[0]) == 3 and (limit > 400 or len(hot) == substring.LEVELS - 1)
    got = Counter(map(tuple, repeated_windows(docs, window=7, buckets=3, bucket_bytes=limit).collect()))
    assert got == plain_windows(rows, 7)


@pytest.mark.parametrize("most", [0, 1 << 24])
def test_short_items_are_never_missed(spark, monkeypatch, most):
    from halocline.llm import decontaminate

    monkeypatch.setattr(decontaminate, "BROADCAST_BYTES", most)
    rng = random.Random(12)
    items = [(i, " ".join(f"q{rng.randrange(100_000)}" for _ in range(5 + i % 8))) for i in range(400)]
    rows = [(i, " ".join([*(f"w{rng.randrange(5000)}" for _ in range(rng.randrange(200))), t, *(f"w{rng.randrange(5000)}" for _ in range(50))]))
            for i, t in items]
    docs, bench = frame(spark, rows), spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in find_contained(docs, bench).collect()}
    assert got == {(i, i) for i, _ in items}
    assert drop_contaminated(docs, bench).count() == 0


@pytest.mark.parametrize("most", [0, 1 << 24])  # a benchmark that stays on the executors, and one that is broadcast
def test_contained_items(spark, monkeypatch, most):
    from halocline.llm import decontaminate

    monkeypatch.setattr(decontaminate, "BROADCAST_BYTES", most)
    rng = random.Random(4)
    words = ["w%d" % i for i in range(3000)]
    items = [(i, " ".join(rng.choices(words, k=rng.choice([3, 5, 12, 40, 90])))) for i in range(60)] + [(60, None), (61, ""), (62, "w1 w2 w3 w4 w5"), (62, "w6 w7 w8 w9 w10")]
    rows = [(None, None), (0, "")]
    for i in range(120):
        text = rng.choices(words, k=rng.choice([10, 300, 6000]))
        item = (rng.choice(items)[1] or "").split()
        if i % 3:
            item = item[: max(1, int(len(item) * rng.choice([1, 0.9, 0.6])))]
        at = rng.randrange(len(text))
        rows.append((i + 10, " ".join(text[:at]) + ", " + " ".join(item).upper() + ". " + " ".join(text[at:])))
    rows.append(rows[-1])

    def shingles(text):
        w = "".join(c if c.isalnum() else " " for c in (text or "").lower()).split()
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)}

    merged = defaultdict(set)
    for i, t in items:
        merged[i] |= shingles(t)
    want = Counter()
    for i, t in rows:
        own = shingles(t)
        want.update((i, j, len(s), len(s & own)) for j, s in merged.items() if s and len(s & own) >= 0.8 * len(s))
    docs, bench = frame(spark, rows), spark.createDataFrame(items, "item_id long, text string")
    got = Counter((r.doc_id, r.item_id, r.n_shingles, r.n_shared) for r in find_contained(docs, bench).collect())
    assert got == want and len(want) > 30
    left = drop_contaminated(docs, bench)
    assert left.columns == docs.columns
    dirty = {(i, n) for n, (i, t) in enumerate(rows) if any(i == w[0] for w in want)}
    assert left.count() == len(rows) - len(dirty)
    for some_docs, some_items in [(docs, bench.limit(0)), (docs.limit(0), bench), (docs, bench.filter("item_id >= 60 and item_id < 62"))]:
        assert find_contained(some_docs, some_items).count() == 0
        assert drop_contaminated(some_docs, some_items).count() == some_docs.count()


def test_items_that_share_a_null_id_and_hot_texts(spark, monkeypatch):
    from halocline.llm import decontaminate

    items = [(None, " ".join(f"a{n}" for n in range(30))), (None, " ".join(f"b{n}" for n in range(20))), (1, " ".join(f"c{n}" for n in range(12)))]
    whole = f"x y {items[0][1]} z {items[1][1]} z {items[2][1]}"
    rows = [(n, whole) for n in range(300)] + [(400 + n, f"w{n} {items[2][1]}") for n in range(20)] + [(500, items[0][1])]
    docs, got = frame(spark, rows).withColumn("u", F.lit(0)), []
    bench = spark.createDataFrame(items, "item_id long, text string")
    for most in (0, 1 << 24):
        monkeypatch.setattr(decontaminate, "BROADCAST_BYTES", most)
        got.append(Counter(tuple(r) for r in find_contained(docs, bench).collect()))
        left = drop_contaminated(docs, bench)
        assert left.columns == docs.columns and [r.doc_id for r in left.collect()] == [500]
    assert got[0] == got[1] and sum(got[0].values()) == 620


def test_shards_split_only_what_is_too_large(spark):
    rng = random.Random(6)
    rows = [(i, "x" * rng.randint(0, 400)) for i in range(500)] + [(None, None), (None, "y" * 50), (7000, "z" * 5000)] + [(42, "hot" * 20)] * 200
    got = assign_shards(frame(spark, rows), 2000).collect()
    assert Counter((r.doc_id, r.n_bytes) for r in got) == Counter((i, len(t or "")) for i, t in rows)
    size, count = Counter(), Counter()
    for r in got:
        size[r.shard] += r.n_bytes
        count[r.shard] += 1
    assert all(r.shard_bytes == size[r.shard] and r.shard_rows == count[r.shard] for r in got)
    assert all(r.fits == (size[r.shard] <= 2000) for r in got)
    assert [r.doc_id for r in got if not r.fits] == [7000]
    # the two halves of a split bucket could not have stayed together
    bits = {i: bin(int(hashlib.md5(str("null" if i is None else i).encode()).hexdigest()[:15], 16))[2:].zfill(60) for i, _ in rows}
    under = Counter()
    for i, t in rows:
        for d in range(60):
            under[bits[i][:d]] += len(t or "")
    for r in got:
        if 0 < r.depth <= 60:
            assert under[bits[r.doc_id][: r.depth - 1]] > 2000
            assert r.shard == f"{r.depth}-{int(bits[r.doc_id][: r.depth], 2)}"


def test_written_shards(spark, tmp_path):
    docs = frame(spark, [(i, "x" * 100) for i in range(50)])
    directory = write_shards(docs, str(tmp_path / "shards"), 1000)
    back = spark.read.parquet(str(tmp_path / "shards"))
    assert back.count() == 50 and back.select("shard").distinct().count() == directory.count() > 4


def test_shards_of_clashing_names_and_repeated_ids(spark, tmp_path):
    docs = spark.createDataFrame([(i % 40, "x" * 100, "own") for i in range(60)], "doc_id long, text string, shard string")
    directory = write_shards(docs, str(tmp_path / "shards"), 1000)
    back = spark.read.parquet(str(tmp_path / "shards"))
    assert back.count() == 60 and set(back.columns) == {"doc_id", "text", "shard", "shard_"} and directory.count() > 4
    assert back.filter("shard = 'own'").count() == 60


def test_near_duplicates_of_clashing_names_and_repeated_ids(spark):
    text = " ".join(f"word{i}" for i in range(400))
    other = " ".join(f"thing{i}" for i in range(400))
    rows = [(5, text), (5, other), (3, other), (7, text), (9, text)]
    docs = spark.createDataFrame([(*r, 1, 2, 3) for r in rows], "doc_id long, text string, __gone int, k int, th int")
    kept = drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id, r.text) for r in kept.collect()) == [(3, other), (5, text)]


def test_unpack_bits_order():
    assert np.packbits([1, 0, 0, 0, 0, 0, 0, 0])[0] == 128
