"""Benchmark decontamination by CGK embedding.

Texts and items become words (lower case; ASCII letters and digits and all other characters
beyond ASCII). An item and a window of its
size are embedded by a CGK random walk: at step t the walk writes its current word and
moves on if a random function of (t, word) says so, after which a small edit distance is
a small Hamming distance. Bit-sampling LSH on the embeddings (several walks, several
samples each) proposes window and item; a word-level edit distance to the text around the
window verifies the pair exactly.

Windows are not embedded where no match is possible: within an edit limit e, an item of n
words keeps one of e + 1 pieces whole, which holds a 3-gram, so every match has an
unbroken 3-gram of the item, and the windows which those 3-grams point at are all embedded. That
loses nothing; embedding the other windows could not find anything.

Texts are read once where they lie, without a shuffle. Items go to the executors in blocks
of at most BLOCK_WORDS words, a pass over the texts for each block. Defined results: null
texts and items count as empty; items of fewer than 3 words match nothing, those of fewer
than 8 words only exactly; repeated rows and items give rows of their own; a text of any
length is scanned whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import DOCUMENT_COLUMNS, table
from .hashing import P1, P2, byte_values, chunks, joined_words, mixed

EDITS = 0.2  # of an item's words
LEAST = 8
WALKS, SAMPLES, PLACES = 4, 24, 3
BLOCK_WORDS = 2_000_000
#: ASCII letters and digits, and all bytes of other characters.
VALUES = byte_values(bytes(b for b in range(256) if b >= 128 or chr(b).isalnum()))


def raw(text: str | None) -> bytes:
    return (text or "").lower().encode()


def hashed(text: str | None) -> np.ndarray:
    return joined_words([raw(text)], VALUES)[0]


def limit(n: int) -> int:
    return int(EDITS * n) if n >= LEAST else 0


def grams(w: np.ndarray) -> np.ndarray:
    return (w[:-2] * P1 + w[1:-1]) * P2 + w[2:] if len(w) >= 3 else w[:0]


def walks(windows: np.ndarray, sizes: np.ndarray, seed: int) -> np.ndarray:
    """The CGK embedding, three steps a word, of each row's first words; 0 follows the end."""
    m, widest = windows.shape
    padded = np.hstack([windows, np.zeros((m, 1), "u8")])
    out, at, row = np.empty((m, 3 * widest), "u8"), np.zeros(m, "i8"), np.arange(m)
    for t in range(3 * widest):
        now = padded[row, at]
        out[:, t] = now
        coin = mixed(now * P2 + np.uint64((seed * 1_000_003 + t) * 0x9E3779B1 & 0xFFFFFFFFFFFFFFFF))
        at = np.minimum(at + (coin >> np.uint64(63)).astype("i8"), sizes)
    return out


def samples(windows: np.ndarray, sizes: np.ndarray) -> Iterator[np.ndarray]:
    """A key a row for each walk and sample; the size of the window is part of it."""
    row = np.arange(len(windows))
    for seed in range(WALKS):
        out, spot = walks(windows, sizes, seed), np.random.default_rng(seed).random((SAMPLES, PLACES))
        for places in spot:
            key = sizes.astype("u8")
            for share in places:
                key = mixed(key * P2 + out[row, (share * 3 * sizes).astype("i8")])
            yield key


def edit_span(item: np.ndarray, text: np.ndarray) -> tuple[int, int, int]:
    """Least edit distance between the item and any stretch of the text; its start and end."""
    n, m = len(item), len(text)
    cost, start = np.zeros(m + 1, "i8"), np.arange(m + 1)
    for i in range(1, n + 1):
        step = np.minimum(cost[:-1] + (text != item[i - 1]), cost[1:] + 1)
        origin = np.where(cost[:-1] + (text != item[i - 1]) <= cost[1:] + 1, start[:-1], start[1:])
        full, origins = np.r_[i, step], np.r_[0, origin]
        # a run of insertions: the least of full[k] + (j - k) over k <= j
        shifted = full - np.arange(m + 1)
        best = np.minimum.accumulate(shifted)
        first = np.maximum.accumulate(np.where(shifted == best, np.arange(m + 1), 0))
        cost, start = best + np.arange(m + 1), origins[first]
    end = int(cost.argmin())
    return int(cost[end]), int(start[end]), end


class Items:
    def __init__(self, items: list[tuple[int, np.ndarray]]):
        self.items = items
        self.words = [w.tolist() for _, w in items]
        self.seeds: dict[int, list[tuple[int, int]]] = {}
        self.filter = np.zeros(1 << 22, bool)
        own = [k for k, (_, w) in enumerate(items) if len(w) >= 3]
        for k in own:
            g = grams(items[k][1])
            self.filter[g >> np.uint64(42)] = True
            for at, x in enumerate(g.tolist()):
                self.seeds.setdefault(x, []).append((k, at))
        self.keys: list[tuple[np.ndarray, np.ndarray]] = []  # sorted keys and their items, a walk and sample each
        for key in samples(*self.rows([(len(items[k][1]), items[k][1], 0) for k in own])) if own else ():
            order = np.argsort(key, kind="stable")
            self.keys.append((key[order], np.array(own)[order]))

    @staticmethod
    def rows(parts: list[tuple[int, np.ndarray, int]]) -> tuple[np.ndarray, np.ndarray]:
        """The words from each start, as many as the size says, as rows of one array."""
        out = np.zeros((len(parts), max(n for n, *_ in parts)), "u8")
        for r, (n, w, s) in enumerate(parts):
            part = w[s : s + n]
            out[r, : len(part)] = part
        return out, np.array([n for n, *_ in parts])

    def windows(self, words: np.ndarray, offsets: np.ndarray) -> set[tuple[int, int, int]]:
        """(size, text, start) of each window that a whole 3-gram points at."""
        g, out = grams(words), set()
        places = np.flatnonzero(self.filter[g >> np.uint64(42)])
        texts = np.searchsorted(offsets, places, "right") - 1
        inside = places + 2 < offsets[texts + 1]
        for p, d in zip(places[inside].tolist(), texts[inside].tolist()):
            low, high = int(offsets[d]), int(offsets[d + 1])
            for k, at in self.seeds.get(int(g[p]), ()):
                n = len(self.items[k][1])
                out.add((n, d, max(0, min(p - low - at, high - low - n))))
        return out

    def matches(self, texts: list[str | None]) -> list[tuple[int, int, int, int, int]]:
        """(text, item, start word, end word, distance), the best place of each pair."""
        words, found = {}, []
        for first, flat, offsets in chunks([raw(t) for t in texts], VALUES):
            for n, d, s in self.windows(flat, offsets):
                words[first + d] = flat[offsets[d] : offsets[d + 1]]
                found.append((n, first + d, s))
        found.sort()
        pairs: set[tuple[int, int, int]] = set()
        for at in range(0, len(found), 20_000):
            part = found[at : at + 20_000]
            for key, (known, items) in zip(samples(*self.rows([(n, words[d], s) for n, d, s in part])), self.keys):
                low, high = np.searchsorted(known, key), np.searchsorted(known, key, "right")
                for r in np.flatnonzero(high > low).tolist():
                    pairs.update((part[r][1], k, part[r][2]) for k in items[low[r] : high[r]].tolist())
        best: dict[tuple[int, int], tuple[int, int, int]] = {}
        for d, k, s in sorted(pairs):
            item, n = self.items[k][1], len(self.items[k][1])
            e = limit(n)
            low = max(0, s - 2 * e)
            near = words[d][low : s + n + 2 * e]
            there = set(near.tolist())
            if sum(x in there for x in self.words[k]) < n - e:
                continue
            dist, a, z = edit_span(item, near)
            if dist <= e and (dist, low + a, low + z) < best.get((d, k), (1 << 30, 0, 0)):
                best[d, k] = (dist, low + a, low + z)
        return [(d, k, a, z, dist) for (d, k), (dist, a, z) in best.items()]


def item_blocks(benchmark: DataFrame, item: str, text: str) -> Iterator[list[tuple[int, np.ndarray]]]:
    """The items in blocks of at most BLOCK_WORDS words (one item at least)."""
    block, size = [], 0
    for r in benchmark.select(item, text).orderBy(item, text).toLocalIterator():
        w = hashed(r[1])
        if block and size + len(w) > BLOCK_WORDS:
            yield block
            block, size = [], 0
        block.append((r[0], w))
        size += len(w)
    yield block


def find_items(df: DataFrame, benchmark: DataFrame, text: str = "text", key: str = "doc_id", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """key, item, start_word, end_word (behind the last), distance: each item that a text
    holds within the edit limit, at its best place."""
    kind, ikind = df.schema[key].dataType.simpleString(), benchmark.schema[item].dataType.simpleString()
    out, rows = None, df.selectExpr(f"`{key}` AS key", f"`{text}` AS text")
    for block in item_blocks(benchmark, item, item_text):
        ids, flat, cuts = [k for k, _ in block], np.concatenate([w for _, w in block]) if block else np.zeros(0, "u8"), np.cumsum([len(w) for _, w in block])

        def run(batches: Iterator[pd.DataFrame], ids=ids, flat=flat, cuts=cuts) -> Iterator[pd.DataFrame]:
            items = Items(list(zip(ids, np.split(flat, cuts[:-1]) if len(cuts) else [])))
            for b in batches:
                keys = b["key"].tolist()
                got = items.matches(b["text"].tolist())
                yield pd.DataFrame({"key": pd.Series([keys[d] for d, *_ in got], dtype=b["key"].dtype), "item": [ids[k] for _, k, *_ in got], "start_word": [x[2] for x in got], "end_word": [x[3] for x in got], "distance": [x[4] for x in got]})

        part = rows.mapInPandas(run, f"key {kind}, item {ikind}, start_word bigint, end_word bigint, distance bigint")
        out = part if out is None else out.unionByName(part)
    return out.withColumnsRenamed({"key": key, "item": item})


def op9_cgk_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold an item go."""
    rows = docs.select(*DOCUMENT_COLUMNS)
    found = find_items(rows.withColumn("_k", F.xxhash64("doc_id", "text")).select("_k", "text"), table(spark, sf_dir, "benchmark"), key="_k")
    return rows.withColumn("_k", F.xxhash64("doc_id", "text")).join(found.select("_k").distinct(), "_k", "left_anti").select(*DOCUMENT_COLUMNS)


QUERIES = {"op9_cgk_decontamination": op9_cgk_decontamination}
SQL: dict[str, str] = {}
