"""Periodic runs of words, found on a grammar of the text.

A run is a stretch of words with smallest period ``q`` (words ``q`` apart are identical) and a length of at least
``max(6, 4 * q)`` that no neighbouring word extends. Texts are taken in blocks of a few megabytes; a block's words get numbers and then:

1. Every pair of adjacent words inside a run stands three times or more in its document (``(4q - 1) // q`` times). Pairs that do not
   cut the text into segments; segments of under six words hold no run. This loses nothing and leaves little of ordinary prose.
2. Re-Pair: the segments' most frequent pairs become nonterminals, round by round. A pair is replaced wherever it is more frequent
   than the pairs that overlap it (ties by a hash, so that a round replaces a share of the text), until no pair stands twice. What is left of a
   segment is joined in a balanced way, so that one symbol derives it.
3. Each nonterminal ``X -> Y Z`` is looked at once, at its first place. A run that crosses the boundary has two periods on one side: they are
   a square that starts ``Z`` or ends ``Y`` (Z-algorithm, linear), and its stretch is extended to the other side.
4. The stretches are moved to all places that ``X`` derives. The lowest symbol that derives a whole run crosses it, so each run is there at its full
   length; stretches inside a longer one of the same period go.

Words are runs of anything but ASCII white space. Null and empty texts have no words and no run. A text is read whole; its memory
is a few numbers per word. Repeated rows give repeated results; a null id stays null.
"""

from __future__ import annotations

import hashlib
import zlib
from collections import defaultdict
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from halocline.llm.common import Batches, batch_of, id_type, keyed_text, raw_texts

MIN_WORDS, MIN_PERIODS = 6, 4
#: Least number of times that a pair inside a run stands in its document.
PAIR_COUNT = 3
BLOCK_BYTES = 4 << 20

Run = tuple[int, int, int]  # start, length, period
Words = list[bytes]


def ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Concatenated ranges ``starts[i] .. starts[i] + counts[i]``."""
    ends = np.cumsum(counts)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - ends + counts, counts)


def stretches(on: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, length) of the stretches of true values."""
    edges = np.flatnonzero(np.diff(np.concatenate(([0], on.view(np.int8), [0]))))
    return edges[::2], edges[1::2] - edges[::2]


def frequent_pairs(ids: np.ndarray, doc: np.ndarray, glue: np.ndarray) -> np.ndarray:
    """Of the pairs (i, i + 1) marked in ``glue``, those that stand often enough in their document."""
    at = np.flatnonzero(glue)
    code = ids[at].astype(np.int64) * (int(ids.max(initial=0)) + 1) + ids[at + 1]
    if int(code.max(initial=0) + 1) * (int(doc.max(initial=0)) + 1) >= 1 << 63:
        code = np.unique(code, return_inverse=True)[1]
    _, which, count = np.unique(doc[at] * (int(code.max(initial=0)) + 1) + code, return_inverse=True, return_counts=True)
    out = np.zeros(len(glue), bool)
    out[at[count[which] >= PAIR_COUNT]] = True
    return out


def live_segments(ids: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, length) of the segments that may hold runs."""
    glue = np.zeros(len(ids), bool)
    glue[:-1] = doc[:-1] == doc[1:]
    while True:
        before = np.count_nonzero(glue)
        glue = frequent_pairs(ids, doc, glue)
        start, length = stretches(glue)
        wide = length >= MIN_WORDS - 1
        glue[:] = False
        glue[ranges(start[wide], length[wide])] = True
        if np.count_nonzero(glue) == before or before < 10_000:
            return start[wide], length[wide] + 1


class Side:
    """The text read in one direction: longest common extensions and the squares that start at a place."""

    def __init__(self, text: np.ndarray):
        self.array, self.words = text, text.tolist()
        order = np.argsort(text, kind="stable")
        following = np.full(len(text), 1 << 60)
        same = text[order[1:]] == text[order[:-1]]
        following[order[:-1][same]] = order[1:][same]
        self.following = following
        self.known: dict[int, list[tuple[int, int]]] = {}

    def common(self, i: int, j: int, end: int) -> int:
        """How far the words from i on equal those from j on; j + result <= end."""
        words, start = self.words, j
        near = min(end, j + 16)
        while j < near and words[i] == words[j]:
            i, j = i + 1, j + 1
        if j < near:
            return j - start
        block = 64
        while j < end:
            size = min(block, end - j)
            differ = self.array[i : i + size] != self.array[j : j + size]
            if differ.any():
                return j - start + int(differ.argmax())
            i, j, block = i + size, j + size, 2 * block
        return j - start

    def squares(self, symbol: int, b: int, end: int) -> list[tuple[int, int]]:
        """(q, words with period q from b on) of the primitively rooted squares that start the symbol standing in [b, end)."""
        if (found := self.known.get(symbol)) is not None:
            return found
        found, z, half = [], {}, b + (end - b) // 2
        left = right = b
        reach = 0
        i = int(self.following[b])
        while i <= half:
            k = min(right - i, z.get(i - left, 0)) if i < right else 0
            if i + k >= right:
                k += self.common(b + k, i + k, end)
                left, right = i, i + k
            z[i - b] = k
            q = i - b
            if k >= q and 2 * q > reach:
                found.append((q, q + k))
                reach = max(reach, q + k)
            i = int(self.following[i])
        self.known[symbol] = found
        return found


class Finder:
    """Runs that cross boundaries of symbols, in a text that both sides hold."""

    def __init__(self, text: np.ndarray):
        self.size = len(text)
        self.ahead, self.back = Side(text), Side(text[::-1].copy())

    def may_cross(self, pos: np.ndarray, b: np.ndarray, end: np.ndarray) -> np.ndarray:
        """False where neither side can start with a square at the boundary."""
        right = 2 * (self.ahead.following[b] - b) <= end - b
        mirrored = self.size - b
        return right | (2 * (self.back.following[mirrored] - mirrored) <= b - pos)

    def crossing(self, pos: int, b: int, end: int, left: int, right: int) -> dict[tuple[int, int], int]:
        """(start, end) -> smallest period, of stretches in [pos, end) that hold the words b - 1 and b."""
        m, found = self.size, {}

        def note(start: int, stop: int, q: int) -> None:
            if stop - start >= max(MIN_WORDS, MIN_PERIODS * q):
                found[start, stop] = min(q, found.get((start, stop), q))

        for q, reach in self.ahead.squares(right, b, end):
            if before := self.back.common(m - b - q, m - b, m - pos):
                note(b - before, b + reach, q)
        for q, reach in self.back.squares(left, m - b, m - pos):
            if after := self.ahead.common(b - q, b, end):
                note(b - reach, b + after, q)
        return found


def pair_rounds(text: np.ndarray, glue: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
    """Rounds of Re-Pair as (new symbol, place, left length, length, left symbol, right symbol) per replaced pair, ordered by symbol.

    ``glue[i]`` tells whether words i and i + 1 belong to one segment.
    """
    sym, at, size = text.astype(np.int64), np.arange(len(text)), np.ones(len(text), np.int64)
    nxt = int(text.max(initial=0)) + 1

    def replace(won: np.ndarray, new: np.ndarray) -> tuple[np.ndarray, ...]:
        nonlocal sym, at, size, glue
        order = np.argsort(new, kind="stable")
        first = won[order]
        rule = (new[order], at[first], size[first], size[first] + size[first + 1], sym[first], sym[first + 1])
        sym[won], size[won], glue[won] = new, size[won] + size[won + 1], glue[won + 1]
        stay = np.ones(len(sym), bool)
        stay[won + 1] = False
        sym, at, size, glue = sym[stay], at[stay], size[stay], glue[stay]
        return rule

    def even_places(run_start: np.ndarray) -> np.ndarray:
        """Every other entry of each stretch, given where stretches begin."""
        index = np.arange(len(run_start))
        return (index - np.maximum.accumulate(np.where(run_start, index, 0))) % 2 == 0

    while True:
        pairs = np.flatnonzero(glue)
        if not len(pairs):
            return
        code = sym[pairs] * nxt + sym[pairs + 1]
        again = np.zeros(len(pairs), bool)
        again[1:] = (pairs[1:] == pairs[:-1] + 1) & (code[1:] == code[:-1])
        alone = even_places(~again)  # of aaaa, the pairs that do not overlap
        pairs, code = pairs[alone], code[alone]
        kinds, which, count = np.unique(code, return_inverse=True, return_counts=True)
        if count.max() < 2:
            break
        mixed = (kinds.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)
        rank = np.empty(len(kinds), np.int64)
        rank[np.lexsort((mixed, count))] = np.arange(len(kinds))
        rank[count < 2] = -1
        strength = np.full(len(sym) + 2, -1)
        strength[pairs + 1] = rank[which]
        own = strength[pairs + 1]
        won = (own >= 0) & (own > strength[pairs]) & (own > strength[pairs + 2])
        won &= np.bincount(which[won], minlength=len(kinds))[which] >= 2
        used, new = np.unique(which[won], return_inverse=True)
        yield replace(pairs[won], new + nxt)
        nxt += len(used)

    while glue.any():  # nothing repeats: pairs of neighbours, from the start of each segment
        starts = np.concatenate(([True], ~glue[:-1]))
        won = np.flatnonzero(glue & even_places(starts))
        yield replace(won, np.arange(len(won)) + nxt)
        nxt += len(won)


def block_runs(texts: list[Words]) -> list[list[Run]]:
    """The runs of each text, by start and then period."""
    out: list[list[Run]] = [[] for _ in texts]
    number: defaultdict[bytes, int] = defaultdict()
    number.default_factory = number.__len__
    lengths = np.array([len(words) for words in texts], np.int64)
    ids = np.fromiter(map(number.__getitem__, chain.from_iterable(texts)), np.int64, int(lengths.sum()))
    first = np.cumsum(lengths) - lengths
    doc = np.repeat(np.arange(len(texts)), lengths)
    start, length = live_segments(ids, doc)
    if not len(start):
        return out
    place = ranges(start, length)  # of each word that is left, in ``ids``
    text = np.unique(ids[place], return_inverse=True)[1]
    glue = np.ones(len(text), bool)
    glue[np.cumsum(length) - 1] = False
    finder = Finder(text)
    found: list[np.ndarray] = []
    for symbol, pos, left, size, left_symbol, right_symbol in pair_rounds(text, glue):
        head = np.flatnonzero(np.concatenate(([True], symbol[1:] != symbol[:-1])))
        many = np.diff(np.concatenate((head, [len(symbol)])))
        look = np.flatnonzero(size[head] >= MIN_WORDS)
        x = head[look]
        look = look[finder.may_cross(pos[x], pos[x] + left[x], pos[x] + size[x])]
        for i, n in zip(head[look].tolist(), many[look].tolist()):
            p = int(pos[i])
            for (a, b), q in finder.crossing(p, p + int(left[i]), p + int(size[i]), int(left_symbol[i]), int(right_symbol[i])).items():
                places = place[pos[i : i + n] + (a - p)]
                found.append(np.stack((np.full(n, q), places, np.full(n, b - a))))
    if not found:
        return out
    q, at, n = np.concatenate(found, axis=1)
    order = np.lexsort((-n, at, q))
    q, at, n = q[order], at[order], n[order]
    group = np.concatenate(([0], np.cumsum(q[1:] != q[:-1]))) * (len(ids) + 1)
    reach = np.maximum.accumulate(group + at + n)
    whole = np.ones(len(q), bool)
    whole[1:] = (group + at + n)[1:] > np.maximum(reach[:-1], group[1:])
    for d, p, size, period in sorted(zip(doc[at[whole]].tolist(), at[whole].tolist(), n[whole].tolist(), q[whole].tolist()), key=lambda r: (r[1], r[3])):
        out[d].append((p - int(first[d]), size, period))
    return out


def strongest(runs: list[Run]) -> Run | None:
    """The run with the greatest exact length / period; ties: smallest start, then period."""
    best = None
    for run in runs:  # by start, then period
        if best is None or run[1] * best[2] > best[1] * run[2]:
            best = run
    return best


def collapsed(words: Words, runs: list[Run]) -> Words:
    """The words without those that a run holds after its first period."""
    if not runs:
        return words
    cover = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        cover[start + period] += 1
        cover[start + length] -= 1
    return [w for w, n in zip(words, np.cumsum(cover).tolist()) if not n]


def loop_words(doc_id: object, words: Words) -> Words:
    """The rule of ``op13``: one document in ten gets a tail that repeats with a period of its own."""
    h = zlib.crc32(str(doc_id).encode())
    if doc_id is None or h % 10 or not words:
        return words
    g, n = h // 10, len(words)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    loop = words[a : a + p]
    return words[:a] + (loop * ((n - a) // p + 1))[: n - a]


def blocks(rows: Iterator[tuple[object, bytes]], size: int) -> Iterator[list[tuple[object, bytes]]]:
    held, total = [], 0
    for row in rows:
        held.append(row)
        total += len(row[1])
        if total >= size:
            yield held
            held, total = [], 0
    if held:
        yield held


def find_runs(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    change: Callable[[object, Words], Words] | None = None, block_bytes: int = BLOCK_BYTES, with_runs: bool = False,
) -> DataFrame:
    """One row per document: n_runs, the strongest run, digests of all runs and of the text without repeats.

    ``change`` may replace a document's words before the search. ``with_runs`` adds the runs and the collapsed text themselves.
    """

    def scan(batches: Batches) -> Batches:
        for batch in batches:
            for block in blocks(zip(batch.column("k").to_pylist(), raw_texts(batch)), block_bytes):
                texts = [change(k, raw.split()) if change else raw.split() for k, raw in block]
                every = block_runs(texts)
                best = [strongest(runs) for runs in every]
                lists = ["".join(f"{a},{n},{q}\n" for a, n, q in runs) for runs in every]
                kept = [b" ".join(collapsed(words, runs)) for words, runs in zip(texts, every)]
                columns = {
                    "k": pa.array([k for k, _ in block], batch.schema.field("k").type),
                    "n_runs": pa.array([len(runs) for runs in every], pa.int64()),
                    "start": pa.array([r and r[0] for r in best], pa.int64()),
                    "length": pa.array([r and r[1] for r in best], pa.int64()),
                    "period": pa.array([r and r[2] for r in best], pa.int64()),
                    "exponent_milli": pa.array([r and 1000 * r[1] // r[2] for r in best], pa.int64()),
                    "runs_sha256": pa.array([hashlib.sha256(x.encode()).hexdigest() for x in lists], pa.string()),
                    "collapsed_sha256": pa.array([hashlib.sha256(x).hexdigest() for x in kept], pa.string()),
                }
                if with_runs:
                    columns["runs"] = pa.array([[{"start": a, "length": n, "period": q} for a, n, q in runs] for runs in every], RUNS)
                    columns["collapsed"] = pa.array(kept, pa.binary()).cast(pa.string())
                yield batch_of(**columns)

    schema = (
        f"k {id_type(docs, id_col)}, n_runs long, start long, length long, period long, exponent_milli long, "
        "runs_sha256 string, collapsed_sha256 string"
    )
    if with_runs:
        schema += ", runs array<struct<start:long,length:long,period:long>>, collapsed string"
    return keyed_text(docs, id_col, text_col).mapInArrow(scan, schema).withColumnRenamed("k", id_col)


RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
