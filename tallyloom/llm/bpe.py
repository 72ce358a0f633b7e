"""Byte-level BPE encoding and decoding.

Bytes are mapped to Latin-1 so that the vocabulary fits a pyahocorasick trie. A piece is
encoded by taking the longest token at each place and backtracking: two neighbours stand
only if they are what BPE makes of their joined bytes (that answer is memoised), and a
place from which no token fits is marked dead and never entered again, so the work is
linear in the piece. BPE is consistent under this test, so the result is that of applying
the merges in rank order.

Defined results: null text counts as empty; an empty text has no ids; repeated and tied
rows are encoded row by row; very long pieces are encoded whole; other columns are passed
over, whatever their names.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame, SparkSession

from .common import table

#: Pieces remembered by one Python worker, some 120 bytes each; forgotten all at once when full.
CACHE_PIECES = 500_000
#: Rows that a worker returns at a time.
ROWS = 256


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class Pieces(dict):
    """piece -> its ids as little-endian uint32 bytes."""

    def __init__(self, encode):
        super().__init__()
        self.encode = encode

    def __missing__(self, piece: str) -> bytes:
        if len(self) >= CACHE_PIECES:
            self.clear()
        out = np.array(self.encode(piece.encode()), "<u4").tobytes()
        if len(piece) <= 64:
            self[piece] = out
        return out


class Codec:
    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = {k.decode("latin-1"): v for k, v in ranks.items()}
        self.token = {v: k for k, v in ranks.items()}
        self.widest = max(map(len, ranks), default=1)
        self.trie = ahocorasick.Automaton()
        for k, v in self.ranks.items():
            self.trie.add_word(k, v)
        self.pattern = regex.compile(pattern)
        self.fits: dict[tuple[str, str], bool] = {}
        self.shorter: dict[str, str | None] = {}
        self.pieces = Pieces(self.encode_piece)

    def longest(self, s: str, at: int) -> str | None:
        """The longest token that s holds at this place."""
        s = s[at : at + self.widest]
        found = s[: self.trie.longest_prefix(s)]
        return found if not found or found in self.ranks else self.prefix(found)

    def prefix(self, token: str) -> str | None:
        """The longest token that is a proper prefix of this one."""
        if token not in self.shorter:
            self.shorter[token] = next((token[:n] for n in range(len(token) - 1, 0, -1) if token[:n] in self.ranks), None)
        return self.shorter[token]

    def merged(self, s: str) -> list[str]:
        """Merges in rank order; for the few bytes of two tokens only."""
        parts = list(s)
        while len(parts) > 1:
            rank, k = min((self.ranks.get(parts[i] + parts[i + 1], 1 << 40), i) for i in range(len(parts) - 1))
            if rank == 1 << 40:
                break
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
        return parts

    def compatible(self, a: str, b: str) -> bool:
        known = self.fits.get((a, b))
        if known is None:
            if len(self.fits) >= CACHE_PIECES:
                self.fits.clear()
            known = self.fits[a, b] = self.merged(a + b) == [a, b]
        return known

    def encode_piece(self, piece: bytes) -> list[int]:
        s = piece.decode("latin-1")
        if s in self.ranks:
            return [self.ranks[s]]
        dead, out, at, token = bytearray(len(s) + 1), [], 0, self.longest(s, 0)
        while token:
            last = out[-1] if out else None
            while token and (dead[at + len(token)] or last is not None and not self.compatible(last, token)):
                token = self.prefix(token)
            if token:
                out.append(token)
                at += len(token)
                token = self.longest(s, at) if at < len(s) else None
            elif out:
                dead[at] = 1
                token = out.pop()
                at -= len(token)
            else:
                break
        if at < len(s):
            raise ValueError(f"the vocabulary cannot spell {piece[:40]!r}")
        return [self.ranks[x] for x in out]

    def encode(self, text: str) -> bytes:
        return b"".join(map(self.pieces.__getitem__, self.pattern.findall(text)))

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.token.__getitem__, np.frombuffer(ids, "<u4").tolist()))


@lru_cache(2)
def codec(path: str, pattern: str) -> Codec:
    return Codec(read_ranks(path), pattern)


def public_path(name: str) -> Callable[[], str]:
    """Finds a public vocabulary where it is read, on each executor."""

    def find() -> str:
        import public_tokenizers

        return public_tokenizers.path(name)

    return find


def encode_documents(df: DataFrame, path: str | Callable[[], str], pattern: str, text: str = "text", key: str = "doc_id", keep_ids: bool = True) -> DataFrame:
    """key, n_tokens, ids (array, if kept), ids_sha256, decoded_sha256: the ids of each
    text, decoded again. path leads to the vocabulary on every executor, or finds it there."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c = codec(path if isinstance(path, str) else path(), pattern)
        for b in batches:
            for at in range(0, len(b), ROWS):
                ids = [c.encode(t or "") for t in b["text"].iloc[at : at + ROWS]]
                out = {
                    "key": b["key"].iloc[at : at + ROWS].reset_index(drop=True),
                    "n_tokens": [len(x) // 4 for x in ids],
                    "ids_sha256": [hashlib.sha256(x).hexdigest() for x in ids],
                    "decoded_sha256": [hashlib.sha256(c.decode(x)).hexdigest() for x in ids],
                }
                yield pd.DataFrame(out | ({"ids": [np.frombuffer(x, "<i4") for x in ids]} if keep_ids else {}))

    kind = df.schema[key].dataType.simpleString()
    schema = f"key {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * keep_ids
    return df.selectExpr(f"`{key}` AS key", f"`{text}` AS text").mapInPandas(run, schema).withColumnRenamed("key", key)


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return encode_documents(table(spark, sf_dir, "documents"), public_path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, keep_ids=False)


QUERIES = {"op10_byte_bpe": op10_byte_bpe}
SQL: dict[str, str] = {}
