"""Licence scan: an Aho-Corasick pass over each text, and a parser for licence expressions.

The automaton holds notice phrases as runs of words and finds them in the text's words joined
by single spaces; a second pattern set finds identifier tags (``SPDX-License-Identifier:``) in the
lower-cased text. What follows a tag is parsed by a shunting-yard parser with ``with`` binding
tighter than ``and``, and ``and`` tighter than ``or``; its value is the obligation that a user has to
accept: the lighter side of ``or``, the heavier of ``and``, one class less for ``with``.

Words are runs of ASCII digits, letters (A-Z lower-cased) and any non-ASCII characters. Null and
empty texts have no words, null positions, empty labels and score 0. A malformed expression
gives the identifiers that can be read and no obligation. Every text is read whole.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

from halocline.llm.common import Batches, batch_of, id_type, keyed_text, raw_texts

# Base phrases and their labels.
BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
# Further phrases of licence notices (words as the scan sees them).
NOTICES = {
    "bsd license": "bsd",
    "bsd 2 clause": "bsd",
    "bsd 3 clause": "bsd",
    "redistribution and use in source and binary forms": "bsd",
    "mozilla public license": "mpl",
    "eclipse public license": "epl",
    "isc license": "isc",
    "lesser general public license": "lgpl",
    "affero general public license": "agpl",
    "permission is hereby granted free of charge": "mit",
    "creative commons attribution": "cc-by",
    "cc by 4 0": "cc-by",
    "cc by sa": "cc-by-sa",
    "cc by nc": "cc-by-nc",
    "cc by nd": "cc-by-nd",
    "cc0 1 0": "cc0",
    "the unlicense": "unlicense",
    "all rights reserved": "proprietary",
}
# Words that make a bare name a grant.
GRANTS = ("licensed under", "released under", "distributed under", "under the terms of", "made available under")
TAGS = ("spdx-license-identifier:", "license-expression:")
# Obligation classes of identifier families, by leading characters, lightest first.
FAMILIES = (
    (("0bsd", "cc0", "unlicense", "public-domain"), 0),
    (("mit", "apache", "bsd", "isc", "zlib", "cc-by-4", "cc-by-3"), 1),
    (("lgpl", "mpl", "epl", "cddl"), 2),
    (("gpl", "agpl", "cc-by-sa"), 3),
    (("cc-by-nc", "cc-by-nd", "proprietary"), 4),
)
OBLIGATIONS = ("none", "notice", "weak-copyleft", "strong-copyleft", "restricted")
UNKNOWN = 4
TO_WORDS = bytes(b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))
BINDING = {"or": 1, "and": 2, "with": 3}
EXPRESSION_TOKEN = re.compile(r"[()]|[a-z0-9][a-z0-9.+:-]*")


@lru_cache(maxsize=1)
def automata():
    """Phrases between spaces, and tags, as two automatons over Latin-1 views of UTF-8."""
    import ahocorasick

    phrases, tags = ahocorasick.Automaton(), ahocorasick.Automaton()
    for phrase in [*BASE, *NOTICES, *GRANTS]:
        phrases.add_word(f" {phrase} ", phrase)
    for tag in TAGS:
        tags.add_word(tag, tag)
    phrases.make_automaton()
    tags.make_automaton()
    return phrases, tags


def family(identifier: str) -> int:
    return next((level for starts, level in FAMILIES if identifier.startswith(starts)), UNKNOWN)


def evaluate(expression: str) -> tuple[list[str], int | None]:
    """Identifiers of an expression, and its obligation class; None where the syntax is wrong."""
    names: list[str] = []
    values: list[int] = []
    waiting: list[str] = []
    wrong = False

    def reduce() -> bool:
        op = waiting.pop()
        if op == "(" or len(values) < 2:
            return False
        right, left = values.pop(), values.pop()
        values.append({"or": min(left, right), "and": max(left, right), "with": max(left - 1, 0)}[op])
        return True

    operand = True  # whether an identifier may come next
    for token in EXPRESSION_TOKEN.findall(expression):
        if token in BINDING:
            wrong |= operand
            while waiting and waiting[-1] != "(" and BINDING[waiting[-1]] >= BINDING[token]:
                wrong |= not reduce()
            waiting.append(token)
            operand = True
        elif token == "(":
            wrong |= not operand
            waiting.append(token)
        elif token == ")":
            wrong |= operand
            while waiting and waiting[-1] != "(":
                wrong |= not reduce()
            if waiting:
                waiting.pop()
            else:
                wrong = True
            operand = False
        else:
            if not operand:
                break  # prose follows the expression
            exception = bool(waiting) and waiting[-1] == "with"
            if not exception:
                names.append(token.rstrip(".:"))
            values.append(0 if exception else family(token))
            operand = False
    while waiting:
        wrong |= not reduce()
    return names, None if wrong or operand or len(values) != 1 else values[0]


def scan_text(raw: bytes) -> tuple:
    """(n_words, n_base, first, last, base labels, labels, score, obligation) of one text."""
    phrases, tags = automata()
    words = raw.translate(TO_WORDS).split()
    line = (b" " + b" ".join(words) + b" ").decode("latin-1")
    starts, base, labels, grants, notices = [], set(), set(), [], []
    spaces = read = 0  # spaces before the end of the match; ends only grow
    for end, phrase in phrases.iter(line):
        if phrase in GRANTS:
            grants.append(end)
            continue
        spaces, read = spaces + line.count(" ", read, end), end
        at = spaces - 1 - phrase.count(" ")
        notices.append(end)
        if phrase in BASE:
            starts.append(at)
            base.add(BASE[phrase])
        labels.add(BASE.get(phrase) or NOTICES[phrase])
    obligation, tagged = None, False
    lowered = raw.lower().decode("latin-1")
    marks = [(end + 1 - len(tag), end + 1) for end, tag in tags.iter(lowered)]
    for (_, begin), (following, _) in zip(marks, [*marks[1:], (len(lowered), 0)]):
        stop = lowered.find("\n", begin, following)  # an expression ends with its line, or where the next tag starts
        names, level = evaluate(lowered[begin : stop if stop >= 0 else following])
        labels.update(names)
        tagged |= bool(names)
        if level is not None:
            obligation = level if obligation is None else max(obligation, level)
    near = [bisect_left(grants, n) for n in notices]
    granted = any(i and n - grants[i - 1] <= 60 for i, n in zip(near, notices))
    score = 1.0 if obligation is not None else 0.9 if granted else 0.75 if tagged else 0.6 if notices else 0.0
    if obligation is None and labels:
        obligation = max(family(label) for label in labels)
    return (
        len(words), len(starts), min(starts, default=None), max(starts, default=None),
        ",".join(sorted(base)), ",".join(sorted(base | labels)), score,
        None if obligation is None else OBLIGATIONS[obligation],
    )


TYPES = (
    ("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()),
    ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64()), ("obligation", pa.string()),
)


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document; see the module text for the columns."""

    def scan(batches: Batches) -> Batches:
        for batch in batches:
            cols = list(zip(*map(scan_text, raw_texts(batch)))) or [()] * len(TYPES)
            found = {name: pa.array(c, kind) for (name, kind), c in zip(TYPES, cols)}
            yield batch_of(k=batch.column("k"), **found)

    schema = f"k {id_type(docs, id_col)}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, obligation string"
    return keyed_text(docs, id_col, text_col).mapInArrow(scan, schema).withColumnRenamed("k", id_col)
