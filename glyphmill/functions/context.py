"""Context dictionaries for scripts that do not write vowels: (previous word, word) to the form with vowels.

Format of a file: the magic ``TRLD``, version, and little-endian counts and offsets of two sorted
sections (single words, then pairs) of length-prefixed strings.
"""

from __future__ import annotations

import os
import re
import struct
import unicodedata
from pathlib import Path

from .translit import Romanizer

MAGIC, VERSION = b"TRLD", 1
HEADER = struct.Struct("<4sIIIII")
_END = re.compile(r"[.!?؟۔،;:]")
FALLBACK = {"fa": "ar"}


class ContextError(ValueError):
    def __init__(self, code: str, message: str):
        super().__init__(f"{code}: {message}")
        self.code = code


def dump(words: dict[str, str], pairs: dict[tuple[str, str], str]) -> bytes:
    """A dictionary as bytes."""

    def text(s: str) -> bytes:
        raw = s.encode()
        return struct.pack("<H", len(raw)) + raw

    first = b"".join(text(k) + text(v) for k, v in sorted(words.items()))
    second = b"".join(text(a) + text(b) + text(v) for (a, b), v in sorted(pairs.items()))
    begin = HEADER.size
    return HEADER.pack(MAGIC, VERSION, len(words), len(pairs), begin, begin + len(first)) + first + second


def parse(data: bytes) -> tuple[dict[str, str], dict[tuple[str, str], str]]:
    try:
        magic, version, n_words, n_pairs, at_words, at_pairs = HEADER.unpack_from(data)
        if magic != MAGIC or version != VERSION:
            raise ContextError("context_dict_corrupt", "wrong magic or version")

        def read(at: int, count: int, fields: int):
            for _ in range(count):
                row = []
                for _ in range(fields):
                    (n,) = struct.unpack_from("<H", data, at)
                    if at + 2 + n > len(data):
                        raise ContextError("context_dict_corrupt", "a string runs past the end")
                    row.append(data[at + 2 : at + 2 + n].decode())
                    at += 2 + n
                yield row

        return {k: v for k, v in read(at_words, n_words, 2)}, {(a, b): v for a, b, v in read(at_pairs, n_pairs, 3)}
    except (struct.error, UnicodeDecodeError) as e:
        raise ContextError("context_dict_corrupt", str(e)) from None


def load_dictionaries(folder: str | None = None) -> dict[str, bytes]:
    """Dictionaries ``<language>.bin`` in an absolute folder, by default ``$GLYPHMILL_DICT_DIR``; read on the driver."""
    folder = folder or os.environ.get("GLYPHMILL_DICT_DIR")
    if not folder or not os.path.isabs(folder):
        return {}
    paths = {lang: os.path.join(folder, f"{lang}.bin") for lang in ("ar", "fa", "he")}
    return {lang: Path(p).read_bytes() for lang, p in paths.items() if os.path.exists(p)}


def _plain(word: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFD", word) if unicodedata.category(c) != "Mn")


class ContextRomanizer:
    """Romanises word by word: by the pair with the word before, by the word, or without context.

    Punctuation that ends a sentence forgets the word before.
    """

    def __init__(self, romanizer: Romanizer, lang: str, dictionaries: dict[str, bytes]):
        data = dictionaries.get(lang) or dictionaries.get(FALLBACK.get(lang, ""))
        if data is None:
            raise ContextError("context_dict_not_found", f"no dictionary for {lang!r}")
        self.words, self.pairs = parse(data)
        self.romanizer = romanizer

    def __call__(self, s: str) -> str:
        before, out = "", []
        for gap, word in re.findall(r"(\W*)(\w*)", s):
            if _END.search(gap):
                before = ""
            plain = _plain(word)
            form = self.pairs.get((before, plain)) or self.words.get(plain) or word
            out.append(self.romanizer(gap) + self.romanizer(form))
            if word:
                before = plain
        return "".join(out)
