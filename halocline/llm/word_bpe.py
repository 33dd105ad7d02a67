"""Splitting of words into pre-tokens, exactly as a word-end byte-pair tokenizer file does.

A text's pre-tokens are those of its words between ASCII white space: white space is dropped, and
neither normalizing nor splitting crosses it. Words of ASCII and Latin letters are split here by the
file's own pattern; any other word goes through the library's normalizer and pre-tokenizer.
"""

from __future__ import annotations

import json
import os
import re

LETTERS = r"a-zA-ZÀ-ÖØ-öø-įı-ɏ"
#: Words whose lower case and classes are the same for every version of Unicode.
PLAIN = re.compile(rf"[\x00-\x7F{LETTERS}]+")
ONE_RUN = re.compile(rf"[{LETTERS}]+")
# Fixed value: the split pattern of the tokenizer file, for such words.
PRETOKEN = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{LETTERS}]+|[0-9]|[^\x09-\x0D\x20{LETTERS}0-9]+")


def byte_symbols() -> dict[int, int]:
    """The byte-level alphabet: printable Latin-1 stands for itself, other bytes follow from U+0100 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = [b for b in range(256) if b not in plain]
    return {b: 0x100 + i for i, b in enumerate(rest)}


SYMBOLS = byte_symbols()


class WordSplitter:
    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.model = library.model
        self.spec = spec["model"]
        self.normalize = library.normalizer.normalize_str
        self.pieces = library.pre_tokenizer.pre_tokenize_str
        self.specials = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special = re.compile("(" + "|".join(map(re.escape, self.specials)) + ")") if self.specials else None

    def __call__(self, raw: bytes) -> list[str | int]:
        """Pre-tokens of a word as byte symbols, and ids of special strings."""
        text = raw.decode()
        if self.special and "<|" in text:
            out: list[str | int] = []
            for part in self.special.split(text):
                if part in self.specials:
                    out.append(self.specials[part])
                elif part:
                    out += self.split(part)
            return out
        return self.split(text)

    def split(self, text: str) -> list[str]:
        if not PLAIN.fullmatch(text):
            return [piece for piece, _ in self.pieces(self.normalize(text))]
        text = text.lower()
        parts = [text] if ONE_RUN.fullmatch(text) else PRETOKEN.findall(text)
        if text.isascii() and text.isprintable():
            return parts
        return [p.encode().decode("latin-1").translate(SYMBOLS) for p in parts]
