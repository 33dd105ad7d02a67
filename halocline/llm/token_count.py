"""Token counts by a finite-state transducer compiled from a byte-pair vocabulary with word ends.

*Transducer.* Byte-pair encoding of a prefix of a word ends in one token, and the rest of its
encoding is that of a shorter prefix. So a state needs only the suffix that may still begin a token,
and for each point in it where a token may begin: the token that ends there, and how many tokens
lie behind. Reading a byte either goes on (the word has not ended) or ends the word; both transitions carry
the change in the number of tokens. States are built when first met and kept, up to ``STATES``, within a word as well.
Two neighbouring tokens are compatible when the merges of their joined text give just these two.

*Words.* White space sends every state to the start state. So the state map of a chunk of text is
constant but for its head, the bytes before the first white space, whose effect depends on
the state that comes in; ``Chunk`` holds head, count and open tail, composes associatively, and a long
text's chunks are composed by a tree scan. Words already run from the start state are kept with their
counts, up to ``WORDS``.

Counts are the library's own for any text. Null and empty texts have no tokens. Every text is read whole.
"""

from __future__ import annotations

import re
from functools import lru_cache
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame

from halocline.llm.common import SPACE, Batches, batch_of, id_type, keyed_text, raw_texts
from halocline.llm.word_bpe import WordSplitter

STATES, WORDS, WORD_BYTES = 400_000, 600_000, 48
CHUNK_BYTES = 1 << 20
END = "</w>"
GAPS = re.compile(SPACE)


class Merges:
    """Encoding by rank of merges, for short symbol strings; decides which tokens may stand side by side."""

    def __init__(self, model: dict):
        self.rank = {(m if isinstance(m, str) else " ".join(m)): i for i, m in enumerate(model["merges"])}
        self.vocab = set(model["vocab"])
        self.apart: dict[tuple[str, str], bool] = {}

    def encode(self, symbols: list[str]) -> list[str]:
        symbols = list(symbols)
        while len(symbols) > 1:
            ranks = [self.rank.get(f"{a} {b}", 1 << 60) for a, b in zip(symbols, symbols[1:])]
            best = min(range(len(ranks)), key=ranks.__getitem__)
            if ranks[best] == 1 << 60:
                break
            symbols[best : best + 2] = [symbols[best] + symbols[best + 1]]
        return symbols

    def split(self, token: str) -> list[str]:
        """The single symbols of a token."""
        if token.endswith(END):
            stem = token[: -len(END)]
            return [*stem[:-1], stem[-1] + END]
        return list(token)

    def adjacent(self, left: str, right: str) -> bool:
        known = self.apart.get((left, right))
        if known is None:
            if len(self.apart) > 2_000_000:
                self.apart.clear()
            known = self.apart[left, right] = self.encode(self.split(left) + self.split(right)) == [left, right]
        return known

    def whole(self, token: str) -> bool:
        return self.encode(self.split(token)) == [token]


class State(NamedTuple):
    """Suffix that may begin tokens; per live point of it: (offset, token ending there, tokens behind it relative to now)."""

    suffix: str
    points: tuple[tuple[int, str, int], ...]


START = State("", ((0, "", 0),))


class Transducer:
    """Lazily compiled; ``go[s][c] = (state, change)`` inside a word, ``end[s][c] = change`` on a word's last byte."""

    def __init__(self, model: dict):
        self.merges = Merges(model)
        self.inner = {t for t in self.merges.vocab if not t.endswith(END)}
        heads = set()
        for token in self.merges.vocab:
            symbols = self.merges.split(token)
            heads.update("".join(symbols[:n]) for n in range(1, len(symbols)))
        self.heads = heads  # strings that a longer token goes on from
        self.reset()

    def reset(self) -> None:
        self.ids: dict[State, int] = {START: 0}
        self.states: list[State] = [START]
        self.go: list[dict[str, tuple[int, int]]] = [{}]
        self.end: list[dict[str, int]] = [{}]

    def restart(self, at: int) -> int:
        """Forget all states but the start and the one given; its new number."""
        state = self.states[at]
        self.reset()
        return self.number(state)

    def number(self, state: State) -> int:
        known = self.ids.get(state)
        if known is None:
            known = self.ids[state] = len(self.states)
            self.states.append(state)
            self.go.append({})
            self.end.append({})
        return known

    def last_token(self, state: State, char: str, ended: bool) -> tuple[str, int]:
        """The token that ends at ``char``, and the tokens then, relative to those before ``char``."""
        tail = END if ended else ""
        vocab = self.merges.vocab if ended else self.inner
        for offset, left, depth in state.points:
            token = state.suffix[offset:] + char + tail
            if token in vocab and (self.merges.adjacent(left, token) if left else self.merges.whole(token)):
                return token, depth + 1
        raise ValueError(f"the vocabulary cannot encode {char!r}")

    def follow(self, at: int, char: str) -> tuple[int, int]:
        state = self.states[at]
        token, change = self.last_token(state, char, False)
        suffix = state.suffix + char
        points = [(o, left, d - change) for o, left, d in state.points if suffix[o:] in self.heads]
        points.append((len(suffix), token, 0))
        cut = points[0][0]
        number = self.number(State(suffix[cut:], tuple((o - cut, left, d) for o, left, d in points)))
        self.go[at][char] = number, change
        return number, change

    def count(self, symbols: str) -> int:
        """Tokens of one pre-token, given as byte symbols."""
        go, at, total = self.go, 0, 0
        for char in symbols[:-1]:
            step = go[at].get(char)
            if step is None:
                if len(self.states) > STATES:  # also within a word: start the table over from the state at hand
                    at, go = self.restart(at), self.go
                step = self.follow(at, char)
            at, change = step
            total += change
        last = symbols[-1]
        change = self.end[at].get(last)
        if change is None:
            change = self.end[at][last] = self.last_token(self.states[at], last, True)[1]
        return total + change


class Chunk(NamedTuple):
    """State map of a piece of text: constant after ``head``. ``tail`` None: no white space, all of it is head."""

    head: bytes
    count: int
    tail: bytes | None


class Counter:
    """Counts whole texts as the tokenizer file's library does."""

    def __init__(self, path: str):
        self.split = WordSplitter(path)
        self.transducer = Transducer(self.split.spec)
        self.known: dict[bytes, int] = {}
        self.runs: dict[str | int, int] = {}

    def pretoken(self, symbols: str | int) -> int:
        """Tokens of one pre-token; a special string is one token."""
        found = self.runs.get(symbols)
        if found is None:
            found = 1 if isinstance(symbols, int) else self.transducer.count(symbols)
            if len(self.runs) > WORDS:
                self.runs.clear()
            if isinstance(symbols, int) or len(symbols) <= WORD_BYTES:
                self.runs[symbols] = found
        return found

    def word(self, raw: bytes) -> int:
        """Tokens of a word between ASCII white space."""
        found = self.known.get(raw)
        if found is None:
            found = sum(map(self.pretoken, self.split(raw)))
            if len(raw) <= WORD_BYTES:
                if len(self.known) > WORDS:
                    self.known.clear()
                self.known[raw] = found
        return found

    def words(self, raws: list[bytes]) -> int:
        counts = list(map(self.known.get, raws))
        if None in counts:
            counts = [self.word(w) if n is None else n for n, w in zip(counts, raws)]
        return sum(counts)

    def chunk(self, raw: bytes) -> Chunk:
        first = GAPS.search(raw)
        if first is None:
            return Chunk(raw, 0, None)
        rest = raw[first.end() :].split()
        open_word = rest.pop() if rest and not GAPS.match(raw[-1:]) else b""
        return Chunk(raw[: first.start()], self.words(rest), open_word)

    def compose(self, a: Chunk, b: Chunk) -> Chunk:
        if a.tail is None:
            return Chunk(a.head + b.head, b.count, b.tail)
        if b.tail is None:
            return Chunk(a.head, a.count, a.tail + b.head)
        middle = a.tail + b.head
        return Chunk(a.head, a.count + (self.word(middle) if middle else 0) + b.count, b.tail)

    def text(self, raw: bytes, size: int = CHUNK_BYTES) -> int:
        if len(raw) <= size:
            return self.words(raw.split())
        maps = [self.chunk(raw[lo : lo + size]) for lo in range(0, len(raw), size)]
        while len(maps) > 1:  # one level of the scan's tree
            pairs = [self.compose(a, b) for a, b in zip(maps[::2], maps[1::2])]
            maps = pairs + maps[len(pairs) * 2 :]
        head, count, tail = maps[0]
        return count + sum(self.word(w) for w in (head, tail) if w)


@lru_cache(maxsize=2)
def counter(path: str) -> Counter:
    return Counter(path)


def count_tokens(
    docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 2048
) -> DataFrame:
    """One row per document: UTF-8 bytes, tokens, and whether the tokens exceed ``limit``."""

    def count(batches: Batches) -> Batches:
        tokens = counter(tokenizer).text
        for batch in batches:
            raws = raw_texts(batch)
            n = [tokens(raw) for raw in raws]
            yield batch_of(
                k=batch.column("k"), n_bytes=pa.array(map(len, raws), pa.int64()), n_tokens=pa.array(n, pa.int64()),
                over_limit=pa.array([x > limit for x in n], pa.bool_()),
            )

    schema = f"k {id_type(docs, id_col)}, n_bytes long, n_tokens long, over_limit boolean"
    return keyed_text(docs, id_col, text_col).mapInArrow(count, schema).withColumnRenamed("k", id_col)
