"""Near duplicates by a chosen-path set similarity join.

A document's set is its distinct word shingles. Equal sets form a class and one class stands
for all its copies. Each class is branched through TREES independent trees: at a node a
minwise token (the least hash of the set under one of TOKENS functions that the node itself
chooses) leads to a child, and with chance 1/threshold - 1 a second one does, so a pair at
the threshold keeps one shared path on average however deep the tree grows. Nodes of at
most SMALL classes are compared exhaustively. In a larger node each class is held against a
sample of SAMPLE others: if it resembles them on average (DENSE of the threshold), branching
would not part it from them, so it is compared with the whole node there; the others are
branched on, until no class is left. PLANES bits a token and the set sizes rule out pairs that
cannot reach the threshold.

What a node yields is linear in its classes. Where few pairs fit, all are proposed. Where most
fit (a dense part of more than 2 MANY classes or so), each class proposes its nearest one
and is named a member of the part; parts that share classes make a group. Proposals are
confirmed on the full sets and joined to components. A group whose classes are still in several
components is then compared exhaustively on its full sets: the classes outside the group's
most frequent component meet every class of it, in blocks of VOLUME shingles, each block a
task of its own, and a task emits only the links that join two components. So neither a large
group of near copies nor one around the threshold writes its pairs, and none of its links
between components is lost.

A pair at the threshold shares a node of BASE levels in one tree with chance about 0.64, so
that all trees miss it with chance below one in a million, and below one in a thousand where
nodes are branched to 9 levels; more similar pairs are missed less often.

Words: A-Z are lower-cased, words are what white space (x20, x09-x0D) leaves. Defined results: a text
of fewer words than a shingle is one shingle; null and blank texts have empty sets, are
linked with nothing and are kept; rows that repeat a doc_id share its class if their texts
agree; a null doc_id never names a component unless no other is there; an empty table gives none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import DOCUMENT_COLUMNS, stash, table
from .hashing import P1, P2, byte_values, chunks, mixed

TOKENS = 64
TREES = 14
BASE = 3  # levels branched before nodes are first compared
STEP = 2  # levels between two looks at a large node
SMALL = 512
SAMPLE = 64
DENSE = 0.9  # of the threshold
HOLD = 1 << 14  # classes of a large node in memory at a time
MANY = 4  # fitting pairs a class, up to which all of them are proposed
TINY = 2 * MANY + 1  # classes that cannot have more
BROADCAST = 1_000_000
VOLUME = 1 << 21  # shingles of a group that one task holds
PLANES = 3  # sketch bits a token
ERRORS = 4.5  # standard errors that a sketch may stray
WORDS = byte_values(bytes(b for b in range(256) if b not in (32, 9, 10, 11, 12, 13)))
FACTORS = (mixed(np.arange(1, TOKENS + 1, dtype="u8")) >> np.uint64(32)).astype("u4") | np.uint32(1)
SKETCH = [f"s{k}" for k in range(PLANES)]


def shingles(words: np.ndarray, size: int) -> np.ndarray:
    """The distinct shingles of one text as sorted 64-bit hashes."""
    n = len(words)
    if not n:
        return words
    span = min(n, size)
    out = np.full(n - span + 1, np.uint64(span))
    for k in range(span):
        out = mixed(out * P2 + words[k : n - span + 1 + k])
    return np.unique(out)


def shingle_sets(texts: list[str | None], size: int) -> Iterator[tuple[int, np.ndarray]]:
    raw = [(t or "").encode() for t in texts]
    for first, flat, offsets in chunks(raw, WORDS):
        for k in range(len(offsets) - 1):
            yield first + k, shingles(flat[offsets[k] : offsets[k + 1]], size)


def minwise(s: np.ndarray) -> np.ndarray:
    """The least of the set's hashes under each function."""
    x, out = (s >> np.uint64(32)).astype("u4"), np.full(TOKENS, 0xFFFFFFFF, "u4")
    for k in range(0, len(x), 2048):
        np.minimum(out, (x[k : k + 2048, None] * FACTORS).min(0), out)
    return out


def bits_of(tokens: np.ndarray) -> np.ndarray:
    """PLANES bits a token: a column of 64 bits for each plane."""
    h = mixed(tokens.astype("u8") + P1)
    place = np.arange(TOKENS, dtype="u8")
    return np.stack([np.bitwise_or.reduce((h >> np.uint64(40 + k) & np.uint64(1)) << place, axis=-1) for k in range(PLANES)], -1)


def children(node: np.ndarray, tokens: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """(row, child) of each branch: rows of tokens at their nodes."""
    coin = mixed(node ^ P2)
    one = (coin % np.uint64(TOKENS)).astype("i8")
    two = (mixed(coin + P1) % np.uint64(TOKENS)).astype("i8")
    more = np.flatnonzero((mixed(coin + P2) >> np.uint64(40)) < np.uint64((1 / threshold - 1) * (1 << 24)))
    rows = np.r_[np.arange(len(node)), more]
    place = np.r_[one, two[more]]
    child = mixed(mixed(node[rows] + place.astype("u8") * P1) ^ tokens[rows, place].astype("u8") * P2)
    return rows, child


def branched(node: np.ndarray, tokens: np.ndarray, levels: int, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    rows = np.arange(len(node))
    for _ in range(levels):
        step, node = children(node, tokens[rows], threshold)
        rows = rows[step]
    return rows, node


def sketch(docs: DataFrame, size: int) -> DataFrame:
    """doc_id, row, n, cid (class), tokens (binary) and SKETCH for each row of doc_id, text."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            n, cid, tokens = [], [], []
            for _, s in shingle_sets(b["text"].tolist(), size):
                n.append(len(s))
                cid.append(xxhash.xxh3_64_intdigest(s.tobytes()) - (1 << 63))
                tokens.append(minwise(s))
            planes = bits_of(np.array(tokens).reshape(-1, TOKENS)).view("i8")
            out = {"doc_id": b["doc_id"], "row": b["row"], "n": n, "cid": cid, "tokens": [x.tobytes() for x in tokens]}
            yield pd.DataFrame(out | dict(zip(SKETCH, planes.T)))

    rows = docs.select("doc_id", F.xxhash64("doc_id", "text").alias("row"), "text")
    return rows.mapInPandas(run, f"doc_id {kind}, row bigint, n bigint, cid bigint, tokens binary, " + ", ".join(f"{c} bigint" for c in SKETCH))


MEMBER = ["node", "cid", "n", *SKETCH]


def spread_out(classes: DataFrame, levels: int, threshold: float, at: bool = False) -> DataFrame:
    """MEMBER rows: each class at the nodes that it reaches from the roots, or from column node."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if not len(b):
                continue
            tokens = np.frombuffer(b"".join(b["tokens"]), "u4").reshape(-1, TOKENS)
            own = {c: b[c].to_numpy() for c in MEMBER[1:]}
            starts = [b["node"].to_numpy().astype("i8").view("u8")] if at else [mixed(np.full(len(b), t + 1, "u8") * P1) for t in range(TREES)]
            for start in starts:
                rows, node = branched(start, tokens, levels, threshold)
                yield pd.DataFrame({"node": node.view("i8")} | {c: x[rows] for c, x in own.items()}).drop_duplicates(["node", "cid"])

    return classes.select(*(["node"] if at else []), *MEMBER[1:], "tokens").mapInPandas(run, ", ".join(f"{c} bigint" for c in MEMBER))


def strays(threshold: float) -> float:
    """The share of tokens whose sketches differ in two sets at the threshold."""
    return (1 - threshold) * (1 - 0.5**PLANES)


ONWARD, PAIR, PART = 0, 1, 2


class NodeStream:
    """Reads nodes as sorted streams of MEMBER rows, HOLD of one node at a time, and collects
    (kind, a, b): ONWARD class and node, PAIR of classes, PART class and head of its part."""

    def __init__(self, threshold: float):
        p = strays(threshold)
        self.threshold = threshold
        self.most = int(TOKENS * p + ERRORS * (TOKENS * p * (1 - p)) ** 0.5)
        self.alike = TOKENS * strays(DENSE * threshold)
        self.node, self.held, self.size, self.sample, self.whole, self.split, self.out = None, [], 0, None, False, False, []

    def far(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        differ = x[:, None, 3] ^ y[None, :, 3]
        for k in range(1, PLANES):
            differ |= x[:, None, 3 + k] ^ y[None, :, 3 + k]
        return np.bitwise_count(differ.view("u8"))

    def emit(self, kind: int, a: np.ndarray, b: np.ndarray) -> None:
        if kind == PAIR:
            a, b = np.minimum(a, b), np.maximum(a, b)
        self.out.append(np.stack([np.full(len(a), kind, "i8"), a, b], 1))

    def allowed(self, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """far of each row of x and each row of y, and whether the sketch and the sizes allow the pair."""
        far, n, m = self.far(x, y), x[:, None, 2], y[None, :, 2]
        fits = (far <= self.most) & (np.minimum(n, m) >= self.threshold * np.maximum(n, m) - 1e-9)
        return far, fits & (x[:, None, 1] != y[None, :, 1])

    def tiny(self, rows: np.ndarray, size: int) -> None:
        """All nodes of this size at once; so few classes are never crowded."""
        rows = rows.reshape(-1, size, rows.shape[1])
        for i, j in zip(*np.triu_indices(size, 1)):
            x, y = rows[:, i], rows[:, j]
            differ = x[:, 3] ^ y[:, 3]
            for k in range(1, PLANES):
                differ |= x[:, 3 + k] ^ y[:, 3 + k]
            fits = (np.bitwise_count(differ.view("u8")) <= self.most) & (np.minimum(x[:, 2], y[:, 2]) >= self.threshold * np.maximum(x[:, 2], y[:, 2]) - 1e-9)
            self.emit(PAIR, x[fits, 1], y[fits, 1])

    def small(self, rows: np.ndarray) -> None:
        """Proposals of a node of at most SMALL rows."""
        far, fits = self.allowed(rows, rows)
        i, j = np.nonzero(np.triu(fits))
        if not len(i):
            return
        label = np.arange(len(rows))
        while True:
            low = label.copy()
            np.minimum.at(low, i, label[j])
            np.minimum.at(low, j, label[i])
            low = low[low]
            if (low == label).all():
                break
            label = low
        edges = np.bincount(label[i], minlength=len(rows))
        few = edges[label[i]] <= MANY * np.bincount(label, minlength=len(rows))[label[i]]
        self.emit(PAIR, rows[i[few], 1], rows[j[few], 1])
        own = np.unique(np.r_[i[~few], j[~few]])
        if len(own):
            best = np.where(fits[own], far[own], 255).argmin(1)
            self.emit(PAIR, rows[own, 1], rows[best, 1])
            self.emit(PART, rows[own, 1], rows[label[own], 1])

    def crowd(self, rows: np.ndarray, dense: np.ndarray) -> None:
        """Proposals of the dense rows of a large node: each row that fits one of them is of the
        part and proposes the nearest."""
        near, best = np.full(len(rows), 255, "u1"), np.zeros(len(rows), "i8")
        for at in range(0, len(dense), 128):
            own = dense[at : at + 128]
            far, fits = self.allowed(rows, rows[own])
            far = np.where(fits, far, 255).astype("u1")
            k = far.argmin(1)
            closer = far[np.arange(len(rows)), k] < near
            near[closer], best[closer] = far[closer, k[closer]], own[k[closer]]
        own = np.flatnonzero(near < 255)
        self.emit(PAIR, rows[own, 1], rows[best[own], 1])
        if self.whole:
            self.emit(PART, rows[:, 1], np.full(len(rows), self.head))
        elif len(own):
            self.emit(PART, rows[own, 1], np.full(len(own), rows[own[0], 1]))

    def large(self, rows: np.ndarray, last: bool) -> None:
        """A node above SMALL, or HOLD rows of one above HOLD. In the latter the sample decides for
        the node: if any of it is dense, the whole node is a part."""
        if self.sample is None:
            self.sample, self.head, self.split = rows[:SAMPLE], int(rows[0, 1]), not last
            self.whole = self.split and bool(self.dense(self.sample).any())
        dense = self.dense(rows)
        if self.split and not self.whole:
            dense[:] = False
        self.emit(ONWARD, rows[~dense, 1], np.full((~dense).sum(), self.node))
        if self.whole or dense.any():
            self.crowd(rows, np.flatnonzero(dense))

    def dense(self, rows: np.ndarray) -> np.ndarray:
        own = (rows[:, None, 1] == self.sample[None, :, 1]).sum(1)
        return self.far(rows, self.sample).sum(1) <= self.alike * np.maximum(1, len(self.sample) - own)

    def add(self, part: np.ndarray) -> None:
        if part[0, 0] != self.node:
            self.close()
            self.node = part[0, 0]
        self.held.append(part)
        self.size += len(part)
        if self.size > HOLD:
            rows = np.vstack(self.held)
            while len(rows) > HOLD:
                self.large(rows[:HOLD], False)
                rows = rows[HOLD:]
            self.held, self.size = [rows], len(rows)

    def close(self) -> None:
        if self.size:
            rows = np.vstack(self.held) if len(self.held) > 1 else self.held[0]
            if self.sample is not None or len(rows) > SMALL:
                self.large(rows, True)
            elif len(rows) > 1:
                self.small(rows)
        self.node, self.held, self.size, self.sample, self.whole = None, [], 0, None, False

    def taken(self) -> pd.DataFrame:
        out = np.vstack([np.zeros((0, 3), "i8"), *self.out])
        self.out = []
        return pd.DataFrame(out, columns=["kind", "a", "b"])


def compared(members: DataFrame, threshold: float) -> DataFrame:
    """kind, a, b of all nodes."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        stream = NodeStream(threshold)
        for batch in batches:
            rows = batch.to_numpy("i8")
            if not len(rows):
                continue
            cuts = np.r_[0, np.flatnonzero(rows[1:, 0] != rows[:-1, 0]) + 1, len(rows)]
            sizes = np.diff(cuts)
            sizes[[0, -1]] = len(rows) + TINY  # these may go on in another batch
            for size in range(2, TINY + 1):
                own = cuts[:-1][sizes == size]
                if len(own):
                    stream.tiny(rows[(own[:, None] + np.arange(size)).reshape(-1)], size)
            for k in np.flatnonzero(sizes > TINY):
                stream.add(rows[cuts[k] : cuts[k + 1]])
            yield stream.taken()
        stream.close()
        yield stream.taken()

    dealt = members.repartition("node").sortWithinPartitions("node", "cid").select(*MEMBER)
    return dealt.mapInPandas(run, "kind bigint, a bigint, b bigint")


def proposals(classes: DataFrame, threshold: float) -> tuple[DataFrame, DataFrame]:
    """The distinct pairs (a, b) and the part memberships (a, b) that the trees yield."""
    members, found = spread_out(classes, BASE, threshold), None
    while True:
        got = stash(compared(members, threshold))
        found = got if found is None else found.unionByName(got)
        onward = got.where(F.col("kind") == ONWARD).select(F.col("a").alias("cid"), F.col("b").alias("node")).distinct()
        if not onward.take(1):
            break
        members = spread_out(onward.join(classes, "cid"), STEP, threshold, at=True)
    of = lambda kind: stash(found.where(F.col("kind") == kind).select("a", "b").distinct())
    return of(PAIR), of(PART)


def full_sets(cids: DataFrame, classes: DataFrame, docs: DataFrame, size: int) -> DataFrame:
    """A table of cid, s (the sorted shingles) of some classes, from the text that stands for each. Up to
    BROADCAST classes go to the texts; more of them, and the texts, are shuffled."""
    need = stash(cids.join(classes.select("cid", "row"), "cid"))
    texts = docs.select(F.xxhash64("doc_id", "text").alias("row"), "text").join(F.broadcast(need) if need.count() <= BROADCAST else need, "row")

    def sets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"cid": b["cid"], "s": [s.tobytes() for _, s in shingle_sets(b["text"].tolist(), size)]})

    return stash(texts.select("cid", "text").mapInPandas(sets, "cid bigint, s binary").groupBy("cid").agg(F.first("s").alias("s")))


def confirmed(pairs: DataFrame, classes: DataFrame, docs: DataFrame, size: int, percent: int) -> DataFrame:
    """The pairs whose full sets are similar enough."""

    def check(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            keep = []
            for x, y in zip(b["s"], b["t"]):
                x, y = np.frombuffer(x, "u8"), np.frombuffer(y, "u8")
                same = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * same >= percent * (len(x) + len(y) - same))
            yield b.loc[keep, ["a", "b"]]

    full = full_sets(pairs.select(F.explode(F.array("a", "b")).alias("cid")).distinct(), classes, docs, size)
    both = pairs.select("a", "b").join(full.withColumnRenamed("cid", "a"), "a").join(full.select(F.col("cid").alias("b"), F.col("s").alias("t")), "b")
    return both.select("a", "b", "s", "t").mapInPandas(check, "a bigint, b bigint")


class Block:
    """Classes with their components and full sets, against which others are held one by one."""

    def __init__(self, percent: int):
        self.percent, self.cids, self.roots, self.sets, self.words, self.up = percent, [], [], [], None, {}

    def find(self, root: int) -> int:
        while self.up.get(root, root) != root:
            self.up[root] = root = self.up.get(self.up[root], self.up[root])
        return root

    def add(self, cid: int, root: int, s: np.ndarray) -> None:
        self.cids.append(cid)
        self.roots.append(root)
        self.sets.append(s)

    def links(self, cid: int, root: int, s: np.ndarray) -> Iterator[tuple[int, int]]:
        """One link to each component that the class belongs to and has not been joined to."""
        if self.words is None:
            self.sizes = np.array([len(x) for x in self.sets])
            self.starts = np.cumsum(self.sizes) - self.sizes
            self.words, self.codes = np.unique(np.concatenate(self.sets), return_inverse=True)
            self.mark = np.zeros(len(self.words), bool)
        at = np.searchsorted(self.words, s)
        at = at[self.words[np.minimum(at, len(self.words) - 1)] == s]
        self.mark[at] = True
        same = np.add.reduceat(self.mark[self.codes], self.starts, dtype="i8")
        self.mark[at] = False
        for k in np.flatnonzero(100 * same >= self.percent * (len(s) + self.sizes - same)):
            x, y = self.find(root), self.find(self.roots[k])
            if x != y:
                self.up[max(x, y)] = min(x, y)
                yield cid, self.cids[k]


def across(parts: DataFrame, roots: DataFrame, classes: DataFrame, docs: DataFrame, size: int, percent: int) -> DataFrame:
    """a, b: the links that join components within the groups that parts (a, b) make."""
    members = components(parts).withColumnRenamed("root", "group")
    members = stash(members.join(classes.select("cid", "n"), "cid").join(roots, "cid", "left").withColumn("root", F.coalesce("root", "cid")))
    sizes = members.groupBy("group", "root").agg(F.count(F.lit(1)).alias("k"), F.sum("n").alias("n"))
    groups = sizes.groupBy("group").agg(F.max_by("root", F.struct("k", "root")).alias("main"), F.ceil(F.sum("n") / VOLUME).alias("parts"), F.count(F.lit(1)).alias("roots"))
    members = stash(members.join(groups.where("roots > 1").drop("roots"), "group"))
    full = full_sets(members.select("cid"), classes, docs, size)
    held = members.select("group", F.pmod(F.xxhash64("cid"), "parts").alias("part"), F.lit(0).alias("asks"), "cid", "root")
    asked = members.where("root <> main").select("group", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("parts") - 1)).alias("part"), F.lit(1).alias("asks"), "cid", "root")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, block = None, Block(percent)
        for b in batches:
            out = []
            for group, part, asks, cid, root, s in b.itertuples(index=False, name=None):
                if (group, part) != at:
                    at, block = (group, part), Block(percent)
                s = np.frombuffer(s, "u8")
                if asks:
                    out += block.links(cid, root, s) if block.cids else ()
                else:
                    block.add(cid, root, s)
            yield pd.DataFrame(out, columns=["a", "b"], dtype="int64")

    dealt = held.unionByName(asked).join(full, "cid").repartition("group", "part").sortWithinPartitions("group", "part", "asks", "cid")
    return dealt.select("group", "part", "asks", "cid", "root", "s").mapInPandas(run, "a bigint, b bigint")


def components(links: DataFrame) -> DataFrame:
    """cid, root for each end of a link: in each round a node points at its least neighbour, pointers
    are doubled twice, and links move to where their ends point."""
    links = stash(links.distinct())
    roots = links.select(F.explode(F.array("a", "b")).alias("cid")).distinct().withColumn("root", F.col("cid"))
    while links.take(1):
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        points = stash(both.groupBy(F.col("a").alias("u")).agg(F.min("b").alias("p")).withColumn("p", F.least("u", "p")))
        for _ in range(2):
            jump = points.select(F.col("u").alias("_u"), F.col("p").alias("_p"))
            points = points.join(jump, points["p"] == jump["_u"], "left").select("u", F.coalesce("_p", "p").alias("p"))
        points = stash(points)
        roots = stash(roots.join(points, roots["root"] == points["u"], "left").select("cid", F.coalesce("p", "root").alias("root")))
        moved = links.join(points.select(F.col("u").alias("a"), F.col("p").alias("_a")), "a").join(points.select(F.col("u").alias("b"), F.col("p").alias("_b")), "b")
        links = stash(moved.where("_a <> _b").select(F.least("_a", "_b").alias("a"), F.greatest("_a", "_b").alias("b")).distinct())
    return roots


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, row (hash of doc_id and text), n_shingles, component_id, kept for each row of docs
    (doc_id, text): size words a shingle, links at percent of the union."""
    docs, threshold = docs.select("doc_id", "text"), percent / 100
    rows = stash(sketch(docs, size))
    firsts = (F.first(c).alias(c) for c in ("n", "tokens", *SKETCH))
    classes = stash(rows.where("n > 0").groupBy("cid").agg(F.min("doc_id").alias("low"), F.min_by("row", F.struct("doc_id", "row")).alias("row"), *firsts))
    pairs, parts = proposals(classes, threshold)
    links = stash(confirmed(pairs, classes, docs, size, percent))
    roots = components(links)
    if parts.take(1):
        more = stash(across(parts, roots, classes, docs, size, percent))
        roots = components(links.unionByName(more)) if more.take(1) else roots
    low = classes.select("cid", "low").join(roots, "cid", "left").withColumn("root", F.coalesce("root", "cid"))
    named = low.join(low.groupBy("root").agg(F.min("low").alias("component_id")), "root").select("cid", "component_id")
    out = rows.select("doc_id", "row", F.col("n").alias("n_shingles"), "cid").join(named, "cid", "left")
    component = F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "row", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def op7_chosen_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), 2, 80).drop("row")


def neardup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays: the one that names it, once."""
    rows = docs.select(*DOCUMENT_COLUMNS)
    gone = near_duplicates(rows).where(~F.col("kept")).select(F.col("row").alias("_k")).distinct()
    kept = rows.withColumn("_k", F.xxhash64("doc_id", "text")).join(gone, "_k", "left_anti")
    return kept.dropDuplicates(["_k"]).select(*DOCUMENT_COLUMNS)


QUERIES = {"op7_chosen_path": op7_chosen_path}
SQL: dict[str, str] = {}
