"""Secrets in text: three fixed patterns, and a token-efficiency test for random strings.

A byte-pair vocabulary learned on ordinary text spends few characters per token on a
random string and many on words and names. A run of key characters that costs more than one
token per ``max_ratio`` characters is reported, unless it is a known digest (hex of a digest's
length), an identifier (UUID, number, words joined by separators or camel case) or lies inside
a span of a fixed pattern, which stays as it is.

Null and empty texts have no spans. Every text is read whole. Spans are code points, end
exclusive. Repeated rows give repeated results; a null id stays null.
"""

from __future__ import annotations

import hashlib
import re
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

from halocline.llm.common import Batches, batch_of, id_type, keyed_text, str_texts

# The base patterns, by kind, in the order that ties follow.
ASSIGN = re.compile(
    r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
ACCESS_CHARS, ASSIGN_CHARS = 20, 6
KINDS = ("assign", "access", "hex", "random")

CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
# Hex lengths of MD5, SHA-1, SHA-224, SHA-256, SHA-384 and SHA-512.
DIGEST_LENGTHS = (32, 40, 56, 64, 96, 128)
HEX_ONLY = re.compile(r"[0-9a-f]+|[0-9A-F]+")
UUID = re.compile(r"[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}")
# The last form reads words run together; each part begins in one way only, so that a near miss costs no second reading.
PART = re.compile(
    r"[0-9]*|[A-Za-z]?[a-z]*[0-9]{0,4}|[A-Z]+[0-9]{0,4}|"
    r"[A-Z]?[a-z]{2,}(?:[0-9]{1,2}[a-z]{2,}|[0-9]{0,2}[A-Z][a-z]{2,})*[0-9]{0,2}"
)
SEPARATORS = re.compile(r"[+/_=-]+")

Span = tuple[int, int, str]


@lru_cache(maxsize=2)
def encoding(path: str, pattern: str):
    """The vocabulary as a tiktoken encoding, loaded once per worker."""
    import base64

    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("secret-scan", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def base_spans(text: str) -> list[Span]:
    spans = [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    if "AKIA" in text:
        spans += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= ACCESS_CHARS]
    if ":" in text or "=" in text:
        spans += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= ASSIGN_CHARS]
    return spans


def is_known(run: str) -> bool:
    """Digests and identifiers, which are not secrets however random they look."""
    if HEX_ONLY.fullmatch(run) and len(run) in DIGEST_LENGTHS or UUID.fullmatch(run):
        return True
    return all(PART.fullmatch(part) for part in SEPARATORS.split(run))


def random_spans(text: str, taken: list[Span], encode, max_ratio: float) -> list[Span]:
    found = []
    waiting, reach = sorted(taken, reverse=True), 0  # of the spans that start before the candidate's end, the furthest end
    for m in CANDIDATE.finditer(text):
        start, end, run = m.start(), m.end(), m[0]
        while waiting and waiting[-1][0] < end:
            reach = max(reach, waiting.pop()[1])
        if reach > start or is_known(run):
            continue
        if len(run) < max_ratio * len(encode(run)):
            found.append((start, end, "random"))
    return found


def joined(spans: list[Span]) -> str:
    return ",".join(f"{kind}:{a}:{b}" for a, b, kind in sorted(spans, key=lambda s: (s[0], KINDS.index(s[2]))))


def scan_secrets(
    docs: DataFrame, vocabulary: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", max_ratio: float = 2.0
) -> DataFrame:
    """One row per document: counts by kind and the span lists. ``vocabulary`` is a tiktoken rank file, ``pattern`` its split."""

    def scan(batches: Batches) -> Batches:
        encode = encoding(vocabulary, pattern).encode_ordinary
        for batch in batches:
            rows = []
            for text in str_texts(batch):
                base = base_spans(text)
                extra = random_spans(text, base, encode, max_ratio)
                kinds = [s[2] for s in base]
                digest = hashlib.sha256(joined(base).encode()).hexdigest()
                rows.append([*(kinds.count(k) for k in KINDS[:3]), len(extra), digest, joined(base + extra)])
            cols = list(zip(*rows)) or [()] * 6
            longs = [pa.array(c, pa.int64()) for c in cols[:4]]
            yield batch_of(
                k=batch.column("k"), n_assign=longs[0], n_access=longs[1], n_hex=longs[2], n_random=longs[3],
                base_sha256=pa.array(cols[4], pa.string()), spans=pa.array(cols[5], pa.string()),
            )

    schema = f"k {id_type(docs, id_col)}, n_assign long, n_access long, n_hex long, n_random long, base_sha256 string, spans string"
    return keyed_text(docs, id_col, text_col).mapInArrow(scan, schema).withColumnRenamed("k", id_col)
