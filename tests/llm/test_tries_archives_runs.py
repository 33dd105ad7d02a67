"""Conversation trie, WARC archives and periodic runs against plain versions, with odd rows."""

import hashlib
import random
import time
import zlib
from collections import Counter

import pyarrow.fs as pafs
import pytest
from pyspark.sql import functions as F

from halocline.llm import conversation_trie, warc
from halocline.llm.conversation_trie import prefix_trie
from halocline.llm.periodic_runs import block_runs, find_runs, loop_words
from halocline.llm.warc import Bytes, page_record, read_archives, round_trip, salvage, write_archives

TURNS = "conv_id long, turn long, role string, text string, depth int, conv string, k1 string"


def turns_frame(spark, rows):
    return spark.createDataFrame([(*r, 1, "x", "y") for r in rows], TURNS)


def plain_trie(rows, share=True):
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            digest = hashlib.sha256(f"{len((role or '').encode())}:{role or ''}{text or ''}".encode()).digest()
            own.setdefault(c, []).append((turn is not None, turn or 0, digest, role or "", text or ""))
    own = {c: [(r, t) for *_, r, t in sorted(x)] for c, x in own.items()}
    rebuilt = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9 if share else 0
        rebuilt[c] = own.get(c - c % 5, [])[:h] + turns[h:] if share else turns
    members, ends = {}, {}
    for c, turns in rebuilt.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
        ends.setdefault(tuple(turns), []).append(c)
    children = Counter(node[:-1] for node in members if node)
    leaves, saved = Counter(), Counter()
    for node, convs in members.items():
        size = (len(convs) - 1) * len(node[-1][1].encode()) if node else 0
        for d in range(len(node) + 1):
            saved[node[:d]] += size
            leaves[node[:d]] += not children[node]
    return sorted(
        (min(convs), len(node), min(members[node[:-1]]) if node else None, len(convs), children[node], leaves[node], saved[node],
         hashlib.sha256(",".join(map(str, sorted(ends.get(node, [])))).encode()).hexdigest())
        for node, convs in members.items()
    )


def trie(spark, rows, share=True):
    conv = F.col("conv_id")
    rule = {"lender": conv - conv % 5, "borrowed": F.crc32(conv.cast("string").cast("binary")) % 9, "most": 8} if share else {}
    return sorted(map(tuple, prefix_trie(turns_frame(spark, rows), **rule).collect()), key=lambda r: (r[0], r[1]))


ODD_TURNS = [
    (None, 1, "user", "no conversation"), (0, None, "user", "first"), (0, 1, None, None), (0, 1, "user", "é" * 9000), (0, 1, "user", "tie"),
    (1, 0, "user", "x"), (1, 0, "user", "x"), (2, 5, "user", "first"), (7, 1, "a", "bc"), (8, 1, "ab", "c"), (9, 2, "", ""), (5, 0, "user", "first"),
    *((20 + i, 0, "user", "hot") for i in range(40)), *((20 + i, 1, "bot", f"{i % 3}") for i in range(40)), *((61, i, "u", f"{i % 2}") for i in range(300)),
]


@pytest.mark.parametrize("share", [True, False])
def test_trie_equals_a_plain_one(spark, share):
    assert trie(spark, ODD_TURNS, share) == plain_trie(ODD_TURNS, share)


def test_random_tries(spark):
    rng = random.Random(11)
    rows = [(c, t, rng.choice("ab"), rng.choice(["x", "yy", "", None])) for c in range(150) for t in range(rng.randrange(1, 9))]
    assert trie(spark, rows) == plain_trie(rows)


def test_long_lists_of_ends_are_packed(spark, monkeypatch):
    monkeypatch.setattr(conversation_trie, "PACK", 7)
    monkeypatch.setattr(conversation_trie, "ROWS", 3)
    monkeypatch.setattr(conversation_trie, "HEAVY_SHARE", 2)
    assert trie(spark, ODD_TURNS) == plain_trie(ODD_TURNS)


def test_no_conversation_no_node(spark):
    assert trie(spark, []) == [] and trie(spark, [(None, 1, "a", "b")]) == []


PAGES = "page_id long, url string, html string, sha string, n int, path string"


def pages_frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, "y") for r in rows], PAGES)


ODD_PAGES = [
    (1, "http://a/", "short"), (2, "http://b/", "short"), (3, None, None), (4, "", ""), (None, "http://c c\r\n/", "<é>" * 50), (5, "u", "<é>" * 50),
    (9, "u", "<é>" * 50), (6, "u" * 100_000, "WARC/1.1\r\n\r\n" * 20), (7, "x", "a" * 300_000), (8, "x", "a" * 300_000), (-3, "y", "a" * 300_000),
    (10, "z", "\x1f\x00 not gzip " * 30), (11, "z", "b" * 99), (12, "z", "b" * 99), (13, "z", "b" * 100), (14, "z", "b" * 100),
]


def plain_pages(rows):
    payloads = {}
    for k, _, html in rows:
        payloads.setdefault(html or "", []).append(k)
    out = []
    for k, _, html in rows:
        raw = (html or "").encode()
        first = min((x for x in payloads[html or ""] if x is not None), default=None)
        revisit = len(raw) >= 100 and k != first
        out.append((k, len(raw), hashlib.sha256(raw).hexdigest(), "revisit" if revisit else "response", first if revisit else None))
    return sorted(out, key=str)


@pytest.mark.parametrize("compress", [True, False])
@pytest.mark.parametrize("max_bytes", [1, 1 << 20])
def test_pages_come_back(spark, compress, max_bytes):
    got = round_trip(pages_frame(spark, ODD_PAGES), compress=compress, max_bytes=max_bytes)
    assert got.columns == ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    assert sorted(map(tuple, got.collect()), key=str) == plain_pages(ODD_PAGES)
    assert round_trip(pages_frame(spark, []), compress=compress).collect() == []


def test_repeated_pages_are_all_responses(spark):
    rows = [(1, "u", "c" * 200), (1, "u", "c" * 200), (2, "u", "c" * 200)]
    got = round_trip(pages_frame(spark, rows)).collect()
    assert sorted((r.page_id, r.record_type, r.refers_to) for r in got) == [(1, "response", None), (1, "response", None), (2, "revisit", 1)]


def gz(data):
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


def archive(n, compress):
    """Records of an archive, as bytes."""
    rng = random.Random(n)
    out = []
    for i in range(n):
        payload = bytes(rng.randrange(97, 103) for _ in range(rng.randrange(300, 4000)))
        raw = page_record(i, f"http://p/{i}", payload, hashlib.sha256(payload).hexdigest(), None, False)
        out.append(gz(raw) if compress else raw)
    return out


def ids(found):
    return [f.record_id for f in found if f.reason is None]


@pytest.mark.parametrize("compress", [True, False])
def test_damage_costs_only_the_records_it_hits(compress, monkeypatch):
    monkeypatch.setattr(warc, "READ_BYTES", 700)
    parts = archive(12, compress)
    starts = [sum(map(len, parts[:i])) for i in range(13)]
    whole = b"".join(parts)
    rng = random.Random(1)
    for _ in range(150):
        data, hit = bytearray(whole), set()
        for _ in range(rng.randrange(1, 4)):
            i = rng.randrange(12)
            at = rng.randrange(starts[i] + 20, starts[i + 1] - 8)  # not the fields that a check cannot see, like a gzip header's time
            if not compress:
                at = rng.randrange(starts[i + 1] - 200, starts[i + 1] - 4)
            data[at] ^= 0x41
            hit.add(i)
        found = list(salvage(Bytes(bytes(data))))
        assert ids(found) == [f"<urn:halocline:page:{i}>" for i in range(12) if i not in hit]
        assert [(f.offset, f.length) for f in found if f.reason is None] == [(starts[i], len(parts[i])) for i in range(12) if i not in hit]
        spans = sorted((f.offset, f.length) for f in found)
        assert spans[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(spans, spans[1:])) and sum(spans[-1]) == len(whole)


@pytest.mark.parametrize("compress", [True, False])
def test_garbage_cut_and_wrong_length(compress):
    parts = archive(5, compress)
    junk = b"\x1f\x8b\x08 no member WARC/1.1\r\nno record" * 3
    found = list(salvage(Bytes(junk + parts[0] + junk + parts[1] + parts[2][:-30] + parts[3] + parts[4][:200])))
    assert ids(found) == [f"<urn:halocline:page:{i}>" for i in (0, 1, 3)]
    bad = [(f.offset, f.length) for f in found if f.reason]
    at = [0, len(junk) + len(parts[0]), 2 * len(junk) + len(parts[0]) + len(parts[1])]
    assert bad == [(0, len(junk)), (at[1], len(junk)), (at[2], len(parts[2]) - 30), (at[2] + len(parts[2]) - 30 + len(parts[3]), 200)]
    plain = archive(3, False)
    wrong = plain[1].replace(b"Content-Length: ", b"Content-Length: 1", 2)
    assert ids(salvage(Bytes(plain[0] + wrong + plain[2]))) == ["<urn:halocline:page:0>", "<urn:halocline:page:2>"]
    several = gz(plain[0] + plain[1][:-9] + plain[2])  # a member of three records, one damaged
    found = list(salvage(Bytes(several)))
    assert ids(found) == ["<urn:halocline:page:0>", "<urn:halocline:page:2>"] and "inside a member" in [f.reason for f in found if f.reason][0]
    assert list(salvage(Bytes(b""))) == []


@pytest.mark.parametrize("junk", [b"WARC/1.1\r\n", b"WARC/1.1\r\na: b\r\n", bytes.fromhex("1f8b08"), bytes.fromhex("1f8b0808"), bytes.fromhex("1f8b0800000000000003")])
@pytest.mark.parametrize("stored", [True, False])
def test_junk_that_looks_like_starts_is_passed_in_linear_time(junk, stored, tmp_path):
    parts, n = archive(2, False), 1_000_000 // len(junk)
    data = parts[0] + junk * n + b"\r\n" + parts[1]
    (tmp_path / "a").write_bytes(data)
    begin = time.perf_counter()
    if stored:
        with pafs.LocalFileSystem().open_input_file(str(tmp_path / "a")) as source:
            found = list(salvage(Bytes(source)))
    else:
        found = list(salvage(Bytes(data)))
    assert time.perf_counter() - begin < 30
    assert [(f.offset, f.length, f.reason is None) for f in found] == [
        (0, len(parts[0]), True), (len(parts[0]), len(junk) * n + 2, False), (len(data) - len(parts[1]), len(parts[1]), True)
    ]


def test_members_inside_members_are_a_gap():
    parts, nested = archive(1, True), b"x"
    for _ in range(1500):
        nested = gz(nested)
    found = list(salvage(Bytes(nested + parts[0])))
    assert [(f.offset, f.length, f.reason is None) for f in found] == [(0, len(nested), False), (len(nested), len(parts[0]), True)]


@pytest.mark.parametrize("flags", range(32))
def test_members_with_all_parts_of_a_head(flags):
    (raw,) = archive(1, False)
    plain = gz(raw)
    parts = [(4, b"\x05\0extra"), (8, b"a name" * 3000 + b"\0"), (16, b"a comment\0"), (2, b"\0\0")]
    member = plain[:3] + bytes([flags]) + plain[4:10] + b"".join(part for flag, part in parts if flags & flag) + plain[10:]
    found = list(salvage(Bytes(member + plain)))
    assert [(f.offset, f.length, f.reason) for f in found] == [(0, len(member), None), (len(member), len(plain), None)]
    assert [f.reason for f in salvage(Bytes(member[:-1]))] == ["member cut off"]


def test_long_and_endless_headers():
    digest = hashlib.sha256(b"").hexdigest()
    long = page_record(7, "http://p/" + "u" * 3_000_000, b"", digest, None, False)
    assert ids(salvage(Bytes(long))) == ["<urn:halocline:page:7>"]
    assert [f.reason for f in salvage(Bytes(b"WARC/1.1\r\na: " + b"b" * 3_000_000))] == ["header without end"]
    assert [f.reason for f in salvage(Bytes(b"WARC/1.1\r\n\r\n"))] == ["header line without a field"]
    assert [f.reason for f in salvage(Bytes(b"WARC/1.1\r\nContent-Length: " + b"9" * 5000 + b"\r\n\r\n"))] == ["block cut off"]


def test_reader_logs_gaps_and_returns_payloads(spark, tmp_path):
    folder = f"file://{tmp_path}/a"
    archives = write_archives(pages_frame(spark, ODD_PAGES), folder, max_bytes=1 << 20)
    assert sum(r.records for r in archives.collect()) == len(ODD_PAGES)
    path = archives.filter("records > 0").first().path
    files, inner = pafs.FileSystem.from_uri(path)
    with files.open_input_file(inner) as f:
        data = bytearray(f.read())
    data[len(data) - 20] ^= 0x55
    with files.open_output_stream(inner, compression=None) as f:
        f.write(bytes(data))
    found = read_archives(archives)
    lost = warc.gaps(found).collect()
    assert [g.path for g in lost] == [path] and lost[0].reason
    kept = warc.records(found).filter("type = 'response'").collect()
    assert all(hashlib.sha256(r.payload).hexdigest() == r.payload_digest.split(":")[1] for r in kept)
    assert {bytes(r.payload).decode() for r in kept} <= {html or "" for _, _, html in ODD_PAGES}


def plain_runs(words):
    found, n = {}, len(words)
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j + q - i >= max(6, 4 * q):
                found.setdefault((i, j + q), q)
            i = max(j, i + 1)
    return sorted(((s, e - s, q) for (s, e), q in found.items()), key=lambda r: (r[0], r[2]))


def test_runs_equal_a_plain_search():
    rng = random.Random(3)
    for _ in range(400):
        texts = []
        for _ in range(rng.choice([1, 4])):
            letters = "abcde"[: rng.choice([1, 2, 2, 3, 5])]
            words = [rng.choice(letters).encode() for _ in range(rng.randrange(70))]
            for _ in range(rng.randrange(3)):
                unit = [rng.choice(letters).encode() for _ in range(rng.randrange(1, 9))]
                at = rng.randrange(len(words) + 1)
                words[at:at] = (unit * 8)[: rng.randrange(3 * len(unit), 7 * len(unit) + 1)]
            texts.append(words)
        assert block_runs(texts) == [plain_runs(words) for words in texts]


@pytest.mark.parametrize(
    "words,want",
    [
        ([b"a"] * 400_000, [(0, 400_000, 1)]),
        ([b"%d" % (i % 999) for i in range(400_000)], [(0, 400_000, 999)]),
        ([b"%d" % (i % 90_000) for i in range(400_000)], [(0, 400_000, 90_000)]),
        ([b"%d" % i for i in range(200_000)] * 2, []),
    ],
)
def test_long_texts_end(words, want):
    assert block_runs([words]) == [want]


TEXTS = [
    (0, "go " * 40), (1, None), (2, ""), (3, " \t\n"), (None, "x y " * 9), (4, "a b c d"), (4, "a b c d"), (5, "é é " * 7), (6, "A a " * 8),
    *((i, " ".join(f"w{(i * j) % 17}" for j in range(60))) for i in range(7, 60)),
]


@pytest.mark.parametrize("block_bytes", [1, 200, 1 << 22])
def test_run_query_equals_a_plain_version(spark, block_bytes):
    docs = spark.createDataFrame([(k, t, 1, "x", 2) for k, t in TEXTS], "doc_id long, text string, start int, k string, period int")
    found = find_runs(docs, change=loop_words, block_bytes=block_bytes, with_runs=True)
    want = []
    for k, text in TEXTS:
        words = (text or "").encode().split()
        h = zlib.crc32(str(k).encode())
        if k is not None and h % 10 == 0 and words:
            g, n = h // 10, len(words)
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
        runs = plain_runs(words)
        best = max(runs, key=lambda r: (r[1] / r[2], -r[0], -r[2]), default=(None,) * 3)
        gone = {i for s, n, q in runs for i in range(s + q, s + n)}
        rest = b" ".join(w for i, w in enumerate(words) if i not in gone)
        lines = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
        want.append((k, len(runs), *best, best[0] if best[0] is None else 1000 * best[1] // best[2],
                     hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(rest).hexdigest(), runs, rest.decode()))
    got = [(*r[:8], [tuple(x) for x in r.runs], r.collapsed) for r in found.collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert find_runs(docs.limit(0)).collect() == []
