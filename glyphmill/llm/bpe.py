"""Byte-level BPE, encoded with a pair occurrence index.

Texts are split into pieces, and each distinct piece of a partition is encoded once. The symbols of
all new pieces of a batch lie in one array, linked to their neighbours. An index maps each active
pair (by its rank) to all of its positions. Ranks are applied in ascending order: a rank's merge is
done at all of its positions at once, and the pairs that arise are appended to the lists of their
ranks. A merge makes a symbol that only later ranks know, so one ascending pass is complete.
"""

from __future__ import annotations

import hashlib
import heapq
import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import release_memory

#: The split pattern of this family of vocabularies.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: A partition's table of pieces is emptied when it holds so many; it only saves work.
MAX_PIECES = 150_000
#: Characters of text that are encoded together.
CHUNK = 1_000_000


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _byte_letters() -> dict[str, int]:
    """The printable character that stands for each byte, turned round."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class _Index(dict):
    """Numbers new keys in the order in which they are asked for."""

    def __missing__(self, piece: str) -> int:
        self[piece] = n = len(self)
        return n


class Bpe:
    """A byte-level BPE vocabulary in the JSON format of the tokenizers library."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, letters = spec["model"], _byte_letters()
        as_bytes = lambda token: bytes(letters[c] for c in token)
        vocab = model["vocab"]
        size = max([*vocab.values(), *(t["id"] for t in spec["added_tokens"])]) + 1
        self.token_bytes: list[bytes] = [b""] * size
        for token, n in vocab.items():
            self.token_bytes[n] = as_bytes(token)
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        for content, n in self.added.items():
            self.token_bytes[n] = content.encode()
        self.split_added = regex.compile("|".join(map(regex.escape, sorted(self.added, key=len, reverse=True)))) if self.added else None
        self.pieces = regex.compile(PATTERN)
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        self.left = np.array([vocab[a] for a, _ in merges], np.int64)
        self.right = np.array([vocab[b] for _, b in merges], np.int64)
        self.made = np.array([vocab[a + b] for a, b in merges], np.int64)
        pair = self.left << 20 | self.right
        self.by_pair = np.argsort(pair, kind="stable")
        self.pairs = pair[self.by_pair]
        self.byte_ids = np.array([vocab[c] for c, _ in sorted(letters.items(), key=lambda x: x[1])], np.int64)

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair, -1 if it has none."""
        pair = left.astype(np.int64) << 20 | right
        at = np.minimum(np.searchsorted(self.pairs, pair), len(self.pairs) - 1)
        return np.where(self.pairs[at] == pair, self.by_pair[at], -1)

    def encode_pieces(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of all pieces one after another, and the number of each piece's."""
        lengths = np.fromiter(map(len, pieces), np.int64, len(pieces))
        symbols = self.byte_ids[np.frombuffer(b"".join(pieces), np.uint8)].astype(np.int32)
        n = len(symbols)
        owner = np.repeat(np.arange(len(pieces), dtype=np.int32), lengths)
        after = np.arange(1, n + 2, dtype=np.int32)  # position n ends every chain
        before = np.arange(-1, n, dtype=np.int32)
        if n:
            edge = np.flatnonzero(owner[1:] != owner[:-1])
            after[edge], before[edge + 1] = n, -1
            after[n - 1] = n
        symbols = np.append(symbols, np.int32(-1))
        alive = np.ones(n + 1, bool)
        alive[n] = False

        lists: dict[int, list[np.ndarray]] = {}
        heap: list[int] = []

        def enter(positions: np.ndarray) -> None:
            rank = self.ranks(symbols[positions], symbols[after[positions]])
            live = rank >= 0
            positions, rank = positions[live], rank[live]
            if not len(rank):
                return
            order = np.argsort(rank, kind="stable")
            positions, rank = positions[order], rank[order]
            cuts = np.flatnonzero(rank[1:] != rank[:-1]) + 1
            for r, own in zip(rank[np.concatenate(([0], cuts))].tolist(), np.split(positions, cuts), strict=True):
                if r in lists:
                    lists[r].append(own)
                else:
                    lists[r] = [own]
                    heapq.heappush(heap, r)

        enter(np.flatnonzero(after[:n] < n))
        while heap:
            r = heapq.heappop(heap)
            found = lists.pop(r)
            at = found[0] if len(found) == 1 else np.unique(np.concatenate(found))
            left, right = self.left[r], self.right[r]
            at = at[alive[at] & (symbols[at] == left) & (symbols[after[at]] == right)]
            if left == right and len(at) > 1:
                at = np.sort(at)
                at = _every_other(at, after)
            if not len(at):
                continue
            gone = after[at]
            symbols[at] = self.made[r]
            alive[gone] = False
            further = after[gone]
            after[at] = further
            inner = further < n
            before[further[inner]] = at[inner]
            ahead = before[at]
            enter(np.unique(np.concatenate((at[inner], ahead[ahead >= 0]))))
        stay = np.flatnonzero(alive[:n])
        return symbols[stay], np.bincount(owner[stay], minlength=len(pieces))

    def split(self, text: str) -> Iterator[tuple[str, int | None]]:
        """Parts of a text: (ordinary text, None) or (added token, its id)."""
        at = 0
        if self.split_added:
            for m in self.split_added.finditer(text):
                if m.start() > at:
                    yield text[at : m.start()], None
                yield m[0], self.added[m[0]]
                at = m.end()
        if at < len(text):
            yield text[at:], None

    def encoder(self, added: bool = True) -> Encoder:
        return Encoder(self, added)

    def decode(self, ids) -> str:
        return b"".join(map(self.token_bytes.__getitem__, ids)).decode("utf-8", "replace")


class Encoder:
    """Encodes texts of one partition and remembers its pieces. Without ``added`` the text of an added token is ordinary."""

    def __init__(self, bpe: Bpe, added: bool = True):
        self.bpe = bpe
        self.added = added
        self._forget()

    def _forget(self) -> None:
        self.index = _Index()
        self.ids, self.begin, self.count = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _learn(self) -> None:
        known = len(self.count)
        if len(self.index) == known:
            return
        new = [p.encode("utf-8", "surrogatepass") for p in list(self.index)[known:]]
        ids, count = self.bpe.encode_pieces(new)
        self.begin = np.concatenate((self.begin, len(self.ids) + np.cumsum(count) - count))
        self.count = np.concatenate((self.count, count))
        self.ids = np.concatenate((self.ids, ids))

    def encode_batch(self, texts: list[str | None]) -> list[np.ndarray]:
        """Token ids of each text (null: none)."""
        if len(self.index) > MAX_PIECES:
            self._forget()
        rows: list[np.ndarray] = []
        number, find = self.index.__getitem__, self.bpe.pieces.findall
        for text in texts:
            parts = []
            for part, added in self.bpe.split(text or "") if self.added else [(text, None)] if text else []:
                parts.append(np.fromiter(map(number, find(part)), np.int32) if added is None else np.array([-1 - added], np.int32))
            rows.append(np.concatenate(parts) if len(parts) != 1 else parts[0]) if parts else rows.append(np.zeros(0, np.int32))
        self._learn()
        return [self._gather(row) for row in rows]

    def _gather(self, row: np.ndarray) -> np.ndarray:
        if not len(row):
            return row
        if row.min() >= 0:
            count = self.count[row]
            total = int(count.sum())
            ends = np.cumsum(count)
            return self.ids[np.repeat(self.begin[row] - ends + count, count) + np.arange(total)]
        out, at = [], 0
        for k in np.flatnonzero(row < 0).tolist():
            out += [self._gather(row[at:k]), np.array([-1 - row[k]], np.int32)]
            at = k + 1
        return np.concatenate([*out, self._gather(row[at:])])


def _every_other(at: np.ndarray, after: np.ndarray) -> np.ndarray:
    """Of positions in a run of equal symbols the first, third and so on: a run merges from its left."""
    follows = np.zeros(len(at), bool)
    follows[1:] = after[at[:-1]] == at[1:]
    starts = np.maximum.accumulate(np.where(~follows, np.arange(len(at)), 0))
    return at[(np.arange(len(at)) - starts) % 2 == 0]


@lru_cache(maxsize=2)
def load(path: str) -> Bpe:
    return Bpe(path)


def chunks(texts, limit: int = CHUNK) -> Iterator[list[str | None]]:
    """Runs of texts (of an Arrow column or a list) of about ``limit`` characters; a longer text is a run of its own."""
    out, size = [], 0
    for t in texts:
        t = t.as_py() if isinstance(t, pa.Scalar) else t
        if out and size + len(t or "") > limit:
            yield out
            out, size = [], 0
        out.append(t)
        size += len(t or "")
    if out:
        yield out


def encode(docs: DataFrame, *, text_col: str = "text", path: str | None = None, carry: list[str] | None = None, digests: bool = False) -> DataFrame:
    """Every document with its tokens.

    Adds ``n_tokens`` long, ``ids`` array<int> and ``decoded`` string; with ``digests``
    ``ids_sha256`` (of little-endian unsigned 32-bit ids) and ``decoded_sha256`` (of UTF-8) instead
    of the last two. Columns of these names are replaced; ``carry`` names the columns to keep
    (default: all). ``path`` names the vocabulary, which must be readable on every executor.

    Null text: as empty, no tokens. Repeated rows are separate documents. Empty table: no rows.
    """
    path = path or vocabulary_path()
    own = ("n_tokens", "ids_sha256", "decoded_sha256") if digests else ("n_tokens", "ids", "decoded")
    keep = [c for c in docs.columns if (carry is None or c in carry) and c.lower() not in own]
    kinds = ("long", "string", "string") if digests else ("long", "array<int>", "string")
    schema = docs.select(*[F.col(f"`{c}`") for c in keep], *(F.lit(None).cast(k).alias(n) for n, k in zip(own, kinds, strict=True))).schema
    needed = [c for c in docs.columns if c in keep or c == text_col]
    rows = docs.select(*[F.col(f"`{c}`") for c in needed])
    at = needed.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        encoder = bpe.encoder()
        for batch in batches:
            begin = 0
            for texts in chunks(batch.column(at)):
                tokens = encoder.encode_batch(texts)
                decoded = [bpe.decode(t.tolist()) for t in tokens]
                columns = [pa.array(map(len, tokens), pa.int64())]
                if digests:
                    columns.append(pa.array([hashlib.sha256(t.astype("<u4").tobytes()).hexdigest() for t in tokens], pa.string()))
                    columns.append(pa.array([hashlib.sha256(d.encode()).hexdigest() for d in decoded], pa.string()))
                else:
                    offsets = np.concatenate(([0], np.cumsum([len(t) for t in tokens])))
                    flat = np.concatenate([*tokens, np.zeros(0, np.int64)]).astype(np.int32)
                    columns += [pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat)), pa.array(decoded, pa.string())]
                part = batch.slice(begin, len(texts))
                begin += len(texts)
                yield pa.RecordBatch.from_arrays([part.column(needed.index(c)) for c in keep] + columns, names=[*keep, *own])
            release_memory()

    return rows.mapInArrow(run, schema)
