"""Quality field, packing, pipeline and registration."""

import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
import pytest
from tokenizers import Tokenizer

from halocline.llm.packing import LEAST_CUT, Packer, longest, loss_in, pack_documents
from halocline.llm.quality import Field, N, WIDTH, fit_field, keep_good, learn_field, line_features, score_quality

WORD = public_tokenizers.path("word_bpe_49k.json")
SF = "/root/testdata/sf0.01"


def brute_marginals(z, step):
    """P(good) per line over all labellings."""
    n, total, good = len(z), 0.0, np.zeros(len(z))
    for code in range(1 << n):
        y = [code >> i & 1 for i in range(n)]
        w = np.exp(sum(z[i] * y[i] for i in range(n)) + sum(step[a][b] for a, b in zip(y, y[1:])))
        total += w
        good += w * np.array(y)
    return good / total


def test_forward_backward_equals_enumeration():
    rng = np.random.default_rng(0)
    for n in (1, 2, 7):
        x = rng.normal(size=(n, N)).astype(np.float32)
        field = Field(tuple(rng.normal(size=WIDTH) / 3), ((0.5, -1.0), (-0.2, 0.8)), 0.5)
        from halocline.llm.quality import with_neighbours

        z = with_neighbours(x).astype(float) @ np.array(field.weights)
        assert np.allclose(field.marginals(x), brute_marginals(z, field.step))


def test_gradient_equals_differences():
    from halocline.llm.quality import batch_gradient, padded

    rng = np.random.default_rng(1)
    docs = [rng.normal(size=(n, N)).astype(np.float32) for n in (3, 1, 5)]
    y, weights, step = np.array([1, 0, 1]), rng.normal(size=WIDTH) / 4, rng.normal(size=(2, 2)) / 2
    x, mask = padded(docs)

    def likelihood(weights, step):
        total = 0.0
        for d in range(3):
            z = (x[d] @ weights)[mask[d]]
            scores = []
            for code in range(1 << len(z)):
                lab = [code >> i & 1 for i in range(len(z))]
                scores.append(sum(z[i] * lab[i] for i in range(len(z))) + sum(step[a, b] for a, b in zip(lab, lab[1:])))
            own = [z.sum() * y[d] + step[y[d], y[d]] * (len(z) - 1)]
            total += own[0] - np.log(np.exp(scores).sum())
        return total

    gw, gs = batch_gradient(x, mask, y, weights, step)
    for i in (0, 5, WIDTH - 1):
        e = np.eye(WIDTH)[i] * 1e-5
        assert abs((likelihood(weights + e, step) - likelihood(weights - e, step)) / 2e-5 - gw[i]) < 1e-4
    e = np.zeros((2, 2))
    e[0, 1] = 1e-5
    assert abs((likelihood(weights, step + e) - likelihood(weights, step - e)) / 2e-5 - gs[0, 1]) < 1e-4


def test_held_out_accuracy(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    scored = score_quality(docs, learn_field(docs, labels))
    assert scored.count() == docs.count()
    rows = scored.join(labels, "doc_id").filter("held_out").collect()
    assert all(zlib.crc32(str(r.doc_id).encode()) % 4 == 2 and r.predicted == int(r.score >= 0.7) for r in rows)
    assert np.mean([r.predicted == r.quality for r in rows]) >= 0.95
    assert np.mean([r.predicted for r in rows if r.quality == 1]) >= 0.98


def test_quality_of_odd_rows(spark):
    labels = spark.createDataFrame([(1, 1), (None, 0), (3, None)], "doc_id long, quality int")
    docs = spark.createDataFrame([(1, "fine text", 1.0), (2, "", 2.0), (None, None, 3.0), (2, "", 2.0), (4, "w " * 50_000, 0.0)], "doc_id long, text string, score double")
    field = learn_field(docs, labels)
    rows = score_quality(docs, field).collect()
    assert len(rows) == 5 and all(0 <= r.score <= 1 for r in rows)
    none = learn_field(docs, labels.limit(0))
    assert {r.score for r in score_quality(docs, none).collect()} == {0.5}
    assert score_quality(docs.limit(0), field).collect() == []
    assert keep_good(docs, field, threshold=0.0).collect() == docs.collect()
    x, sizes = line_features(b"\n \n\t\nA line.\n\n")
    assert len(x) == 1 and sizes[0] == 7
    assert fit_field([], [], []).prior == 0.5


def pieces_of(df):
    docs, seqs = defaultdict(list), defaultdict(list)
    for r in df.collect():
        docs[r.doc_id].append(r)
        seqs[r.sequence_id].append(r)
    return docs, seqs


def check_packing(docs, seqs, ids_of, tokens=2048, segments=64):
    for key, ids in ids_of.items():
        parts = sorted(docs[key], key=lambda r: r.start)
        at = 0
        for r in parts:
            assert r.start == at and r.doc_tokens == len(ids) and r.length > 0
            assert r.ids_crc32 == zlib.crc32(np.array(ids[at : at + r.length], "<u4").tobytes())
            at += r.length
        assert at == len(ids)
    for rows in seqs.values():
        at = 0
        for r in sorted(rows, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= tokens and len(rows) <= segments


def test_packing_is_whole_and_tight(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    library = Tokenizer.from_file(WORD)
    ids = {r.doc_id: library.encode(r.text or "", add_special_tokens=False).ids + [1] for r in docs.collect()}
    pieces, seqs = pieces_of(pack_documents(docs, WORD))
    check_packing(pieces, seqs, ids)
    used = [sum(r.length for r in rows) for rows in seqs.values()]
    padding = sum(2048 - u for u in used if u & (u - 1))
    assert padding < 0.005 * sum(used)


@pytest.mark.parametrize("limits", [(64, 3, 64), (64, 64, 20), (7, 2, 7), (16, 1, 4)])
def test_all_limits_hold(spark, limits):
    tokens, segments, loss = limits
    rng = random.Random(8)
    rows = [(i, "the " * rng.choice([0, 1, 3, 30, 200]), rng.choice([None, 0, 2, 500]), 5) for i in range(200)] + [(1000, None, None, 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, answer long, start long")
    for column in (None, "answer"):
        got = pack_documents(df, WORD, loss_col=column, max_tokens=tokens, max_segments=segments, max_loss=loss, pool=16, with_ids=True)
        pieces, seqs = pieces_of(got)
        check_packing(pieces, seqs, {i: [518] * (t or "").count("the") + [1] for i, t, *_ in rows}, tokens, segments)
        first = {i: 1 if column is None or a is None else (t or "").count("the") + 1 - min(a, (t or "").count("the") + 1) for i, t, a, _ in rows}
        for part in seqs.values():
            assert sum(loss_in(r.start, r.length, first[r.doc_id]) for r in part) <= loss


def test_packing_keeps_repeated_and_null_rows(spark):
    df = spark.createDataFrame([(None, "the"), (1, ""), (1, ""), (2, None)], "doc_id long, text string")
    rows = pack_documents(df, WORD).collect()
    assert sorted((str(r.doc_id), r.length) for r in rows) == [("1", 1), ("1", 1), ("2", 1), ("None", 2)]
    assert pack_documents(df.limit(0), WORD).collect() == []
    with pytest.raises(ValueError):
        pack_documents(df, WORD, max_segments=0)


def test_packer_bounds_its_pool():
    packer = Packer(0, 64, 8, 64, pool=10)
    for i in range(500):
        packer.add(i, b"\0\0\0\0" * (i % 60 + 1), None)
        assert len(packer.items) < 20
    packer.pack(0)
    assert not packer.items and sum(r[2] for r in packer.take()) == sum(i % 60 + 1 for i in range(500))


class Counted(Packer):
    """Keeps what each sequence holds of the three limits, before it is stored."""

    def __init__(self, *args):
        super().__init__(*args)
        self.filled = []

    def close(self, pieces):
        self.filled.append([sum(x) for x in zip(*map(self.demand, pieces))])


class BestFit(Counted):
    """The plain rule: the longest piece that fits, else a cut, over the same pool."""

    def pack(self, keep):
        while len(self.items) > keep:
            room, used = np.array(self.caps), []
            while self.items:
                self.items.sort(key=lambda item: -len(item[2]))
                at = next((i for i, item in enumerate(self.items) if (np.array(self.demand(item)) <= room).all()), None)
                if at is None:
                    key, start, ids, n, first = self.items[0]
                    size = longest(start, first, int(room[0]), int(room[2])) if room[1] else 0
                    if size >= LEAST_CUT:
                        used.append((key, start, ids[: 4 * size], n, first))
                        self.items[0] = (key, start + size, ids[4 * size :], n, first)
                    break
                used.append(self.items.pop(at))
                room = room - self.demand(used[-1])
            self.close(used)


def answered_conversations():
    """(words of all turns, words of the answers) per conversation."""
    turns = pq.read_table(f"{SF}/conversations.parquet").to_pylist()
    sizes = defaultdict(lambda: [0, 0])
    for t in turns:
        n = len((t["text"] or "").split()) + 1
        sizes[t["conv_id"]][0] += n
        sizes[t["conv_id"]][1] += n if t["role"] == "assistant" else 0
    return [tuple(sizes[k]) for k in sorted(sizes)]


def mixed_demands():
    """Long prompts with short answers, short prompts with long answers, and tiny pieces."""
    rng = random.Random(5)
    kinds = [lambda: (rng.randint(300, 700), rng.randint(5, 40)), lambda: (rng.randint(120, 200), 120), lambda: (rng.randint(2, 12), 1)]
    return [rng.choice(kinds)() for _ in range(600)]


@pytest.mark.parametrize("demands, limits", [(answered_conversations, (1024, 8, 400)), (mixed_demands, (1024, 5, 260))])
def test_dot_product_needs_no_more_sequences_than_best_fit_where_several_limits_bind(demands, limits):
    counts = {}
    for rule in (Counted, BestFit):
        packer = rule(0, *limits, 512)
        for i, (n, loss) in enumerate(demands()):
            packer.add(i, b"\0\0\0\0" * n, loss)
        packer.pack(0)
        assert (np.array(packer.filled) <= limits).all()
        counts[rule] = packer.filled
    assert len(counts[Counted]) <= len(counts[BestFit])
    full = (np.array(counts[Counted]) >= 0.95 * np.array(limits)).mean(axis=0)
    assert full[2] > 0.25 and full[0] < 1, full  # not the tokens alone decide
    least = max(sum(d) / cap for d, cap in zip(zip(*((n, 1, loss) for n, loss in demands())), limits))
    assert len(counts[Counted]) <= 1.1 * least + 1


def test_pipeline_equals_its_plain_stages(spark):
    """Each stage is checked on what its predecessor kept."""
    import corpus_pipeline as cp

    from halocline.llm.queries import SQL
    from tests.compare import connect
    from tests.llm.test_copies import plain_components, plain_fingerprint

    docs = spark.read.parquet(f"{SF}/documents.parquet").cache()
    good = cp.quality_filter(spark, docs, SF).cache()
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    kept = {r.doc_id for r in good.collect()}
    assert all(i in kept for i, q in labels.items() if q == 1)
    assert sum(i in kept for i, q in labels.items() if q == 0) <= 0.1 * sum(q == 0 for q in labels.values())

    largest = {}
    for r in good.collect():
        largest[r.text] = max(largest.get(r.text, -1), r.doc_id)
    unique = cp.exact_dedup(spark, good, SF).cache()
    assert {r.doc_id for r in unique.collect()} == set(largest.values())

    fps = {r.doc_id: plain_fingerprint(r.text) for r in unique.collect()}
    roots = plain_components(set(fps.values()))
    least = {}
    for i, f in fps.items():
        least[roots[f]] = min(least.get(roots[f], i), i)
    apart = cp.near_dedup(spark, unique, SF).cache()
    assert {r.doc_id for r in apart.collect()} == set(least.values())

    dirty = {r[0] for r in connect(SF).sql(f"SELECT DISTINCT doc_id FROM ({SQL['op9_decontamination']})").fetchall()}
    clean = cp.decontaminate(spark, apart, SF)
    assert clean.columns == docs.columns
    assert {r.doc_id for r in clean.collect()} == set(least.values()) - dirty
    packed = cp.run(spark, SF)
    assert {r.doc_id for r in packed.collect()} == set(least.values()) - dirty


def test_entry_registers_one_query_per_operator():
    import __spark_entry__ as entry

    names = set(entry.queries())
    assert all(any(n.startswith(f"op{i}_") for n in names) for i in range(1, 11)) and "pipeline" in names
    assert set(entry.oracle_sql()) <= names
