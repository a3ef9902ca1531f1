"""Benchmark decontamination: CGK embedding, bit-sampling LSH, exact edit verification.

Texts are sequences of lower-cased words (runs of letters, digits and underscores), so case,
punctuation and spacing do not matter. A document holds a benchmark item if some window of
its words is within EDIT_RATE * n word edits of the item's n words.

An item of up to 2 * BLOCK - 1 words is one block; a longer one is cut into blocks of BLOCK
to 2 * BLOCK - 1 words. Of m blocks of a matching window, one holds at most an m-th of the
edits, so it is enough to find a block within that many. A random walk (CGK) embeds the
block, and every window of as many words that may hold it: at step t the walk copies the
word it stands on and moves on by a random bit of (t, word), so that few edits give a small
Hamming distance. Each of R repetitions has its own random bits and samples SAMPLES of the
2n first steps; a block and a window that agree on all of them collide. R is measured for
each block size (`repetitions`): the least with which made-up blocks at their edit limit are
found with probability RECALL, for substitutions, deletions, insertions and mixtures alike.
A collision says where the item would lie; an exact edit distance over all words of the item
decides, for each start within the limit. Of an item's verified windows that of the least
distance is reported, the first of equals.

Before embedding, windows that can't hold a block are set aside, without loss: k word edits
break at most 2k of a block's distinct word pairs, so a window holds all but that many of
them within n + k words. Blocks of so few distinct pairs that this says nothing go by words:
a window holds n - k words of the block within n + k.

Scale: the benchmark is a stated query set and is read in blocks of ITEM_BLOCK items; the
documents pass by once a block, in one Arrow pass without any shuffle, whole texts of any
length in one scan, and documents are independent, so hot groups do not matter.

Defined cases: null or wordless texts are clean; items of no word are skipped; items below
5 words have no edit to spare and match as they are; a very long text is scanned as any
other; repeated documents are judged alike; repeated items are reported each; other columns
pass through `decontaminate`, whatever their names.
"""

from __future__ import annotations

import random
import re
from itertools import islice

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from recordgauge.llm.shingles import constants, mix

EDIT_RATE = 0.2
BLOCK, SAMPLES, RECALL = 10, 3, 0.99
#: Made-up blocks of each kind of edit by which R is measured, and the most repetitions tried.
TRIALS, MOST = 300, 256
ITEM_BLOCK = 20_000
WORD = re.compile(r"\w+")
HITS = T.StructType([T.StructField("item_id", T.LongType()), T.StructField("start", T.IntegerType()), T.StructField("n_words", T.IntegerType()), T.StructField("distance", T.IntegerType())])


def words(text: str | None) -> np.ndarray:
    import xxhash

    found = WORD.findall((text or "").lower())
    return np.fromiter(map(xxhash.xxh3_64_intdigest, found), dtype=np.uint64, count=len(found))


def limit(n: int, rate: float = EDIT_RATE) -> int:
    return int(rate * n)


def pair_hashes(w: np.ndarray) -> np.ndarray:
    return mix(w[:-1] * np.uint64(0x9E3779B97F4A7C15) + w[1:])


def walk(n: int, reps: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of windows of n words: a random factor for each (step, repetition), the steps that each repetition samples, and those any does."""
    steps = 2 * n
    chosen = np.random.default_rng(n).random((MOST, steps)).argsort(axis=1)[:reps, :SAMPLES]
    taken = np.zeros((steps, reps), dtype=bool)
    taken[chosen.ravel(), np.repeat(np.arange(reps), chosen.shape[1])] = True
    return constants(MOST * steps, 1000 + n).reshape(MOST, steps)[:reps].T[:, :, None], taken, taken.any(axis=1)


def keys(w: np.ndarray, starts: np.ndarray, n: int, made: tuple[np.ndarray, np.ndarray, np.ndarray]) -> np.ndarray:
    """(R, len(starts)) LSH keys of the n-word windows of w at `starts`, embedded by the walk `made`."""
    factors, taken, used = made
    reps = taken.shape[1]
    padded = np.append(w, np.zeros(n + 1, dtype=np.uint64))
    at, end = np.tile(starts, (reps, 1)), starts + n
    key = np.full((reps, len(starts)), np.uint64(n))
    for t in range(2 * n):
        inside = at < end
        word = padded[at] * inside
        if used[t]:
            rows = taken[t]
            key[rows] = mix(key[rows] * np.uint64(0x9E3779B97F4A7C15) + word[rows])
        at += (word * factors[t] >> np.uint64(47) & np.uint64(1)).astype(np.int64) * inside
    return key


def edited(block: list[int], kind: str, k: int, r: random.Random) -> list[int]:
    """`block` with k edits of a kind (substitute, delete, insert or mixed) at places of their own."""
    out = list(block)
    for at in sorted(r.sample(range(len(out)), k), reverse=True):
        what = r.choice(("substitute", "delete", "insert")) if kind == "mixed" else kind
        out[at : at + (what != "insert")] = [] if what == "delete" else [r.getrandbits(63)]
    return out


#: R by block size and recall, once measured.
_MEASURED: dict[tuple[int, float], int] = {}


def repetitions(n: int, recall: float = RECALL) -> int:
    """R for blocks of n words: measured on made-up blocks with exactly the permitted edits."""
    if (n, recall) not in _MEASURED:
        _MEASURED[n, recall] = measured(n, recall)
    return _MEASURED[n, recall]


def measured(n: int, recall: float) -> int:
    k, r, wide, need = limit(n), random.Random(n), 3 * n, 1
    if not k:
        return 1
    made = walk(n, MOST)
    for kind in ("substitute", "delete", "insert", "mixed"):
        plain, changed = [], []
        for _ in range(TRIALS):
            block = [r.getrandbits(63) for _ in range(n)]
            other = edited(block, kind, k, r)
            plain += block + [0] * (wide - n)
            changed += other + [r.getrandbits(63) for _ in range(wide - len(other))]
        starts = np.arange(TRIALS) * wide
        same = keys(np.array(plain, dtype=np.uint64), starts, n, made) == keys(np.array(changed, dtype=np.uint64), starts, n, made)
        found = np.logical_or.accumulate(same, axis=0).mean(axis=1)
        need = max(need, int(np.searchsorted(found, recall)) + 1)
    return min(need, MOST)


def edit_distance(a: list[int], b: list[int], k: int, anywhere: bool = False) -> int:
    """Least word edits between a and a prefix of b of len(a) - k words or more; k + 1 if over k.

    With `anywhere`, between a and any window of b. Bit-parallel over the words of a."""
    n, free = len(a), 0 if anywhere else 1
    if a == b[:n]:
        return 0
    where: dict[int, int] = {}
    for i, x in enumerate(a):
        where[x] = where.get(x, 0) | 1 << i
    full, top = (1 << n) - 1, 1 << (n - 1)
    up, down, score = full, 0, n
    best = n if n - k <= 0 else k + 1
    for j, y in enumerate(b, 1):
        same = where.get(y, 0)
        vert = same | down
        across = (((same & up) + up) ^ up) | same
        plus, minus = down | (full & ~(across | up)), up & across
        score += bool(plus & top) - bool(minus & top)
        plus, minus = (plus << 1 | free) & full, minus << 1 & full
        up, down = minus | (full & ~(vert | plus)), plus & vert
        if j >= n - k and score < best:
            best = score
    return min(best, k + 1)


class Index:
    """The items of one block of the benchmark: their word blocks with an inverted index of word pairs and LSH tables."""

    def __init__(self, items: list[tuple[int, str]], reps: dict[int, int] | None = None):
        found = [(item, words(text)) for item, text in items]
        self.items = [(item, w) for item, w in found if len(w)]
        #: Of each block: its item, its first word there, its words.
        self.owner, self.offset, parts = [], [], []
        for k, (_, w) in enumerate(self.items):
            m = max(1, len(w) // BLOCK)
            at = [len(w) * j // m for j in range(m + 1)]
            for a, b in zip(at, at[1:], strict=False):
                self.owner.append(k)
                self.offset.append(a)
                parts.append(w[a:b])
        self.parts = parts
        self.length = np.array([len(p) for p in parts], dtype=np.int64)
        #: Words in the longest window that matches a block.
        self.reach = self.length + np.array([limit(n) for n in self.length.tolist()], dtype=np.int64)
        own = [np.unique(pair_hashes(p)) for p in parts]
        #: Distinct pairs that a window of each block must hold; 0 or less: none need be held.
        self.need = np.array([len(p) for p in own], dtype=np.int64) - 2 * (self.reach - self.length)
        #: Blocks of few distinct pairs, with their distinct words.
        self.plain = [(k, np.unique(parts[k])) for k in np.flatnonzero(self.need <= 0).tolist()]
        pairs = np.concatenate(own) if own else np.empty(0, dtype=np.uint64)
        owners = np.repeat(np.arange(len(own)), [len(p) for p in own])
        order = np.argsort(pairs, kind="stable")
        self.owners = owners[order]
        self.pairs, self.first = np.unique(pairs[order], return_index=True)
        self.ends = np.append(self.first[1:], len(pairs))
        self.bits = np.zeros(1 << 20, dtype=bool)
        self.bits[(self.pairs & np.uint64((1 << 20) - 1)).astype(np.int64)] = True
        #: By block size, R tables of key -> blocks.
        reps = reps if reps is not None else repetitions_of(items)
        self.walks = {n: walk(n, reps[n]) for n in set(self.length.tolist())}
        self.tables: dict[int, list[dict[int, list[int]]]] = {}
        for n in sorted(set(self.length.tolist())):
            members = np.flatnonzero(self.length == n).tolist()
            tables: list[dict[int, list[int]]] = [{} for _ in range(reps[n])]
            joined = np.concatenate([parts[k] for k in members])
            for r, row in enumerate(keys(joined, np.arange(len(members)) * n, n, self.walks[n]).tolist()):
                for k, key in zip(members, row, strict=True):
                    tables[r].setdefault(key, []).append(k)
            self.tables[n] = tables

    def hits(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions of the word pairs `h` that blocks hold, and the blocks: one row for each."""
        none = np.empty(0, dtype=np.int64)
        if not len(h) or not len(self.pairs):
            return none, none
        near = np.flatnonzero(self.bits[(h & np.uint64((1 << 20) - 1)).astype(np.int64)])
        k = np.searchsorted(self.pairs, h[near])
        hit = self.pairs[np.minimum(k, len(self.pairs) - 1)] == h[near]
        near, k = near[hit], k[hit]
        counts = self.ends[k] - self.first[k]
        at = np.repeat(near, counts)
        return at, self.owners[np.repeat(self.first[k] - np.cumsum(counts) + counts, counts) + np.arange(len(at))]

    def near(self, h: np.ndarray):
        """(block, positions of its pairs): each block that a stretch of the pairs `h` may hold by their number."""
        at, of = self.hits(h)
        some = np.bincount(of, minlength=len(self.parts)) >= np.maximum(self.need, 1)
        keep = some[of] & (self.need[of] > 0)
        at, of = at[keep], of[keep]
        order = np.argsort(of, kind="stable")
        at, of = at[order], of[order]
        last = np.arange(len(of)) + self.need[of] - 1
        inside = np.minimum(last, len(of) - 1)
        close = (last < len(of)) & (of[inside] == of) & (at[inside] - at < self.reach[of] - 1)
        for k in np.unique(of[close]).tolist():
            yield k, at[np.searchsorted(of, k) : np.searchsorted(of, k, side="right")]

    def starts(self, own: np.ndarray, k: int, h: np.ndarray) -> np.ndarray:
        """Starts of windows that hold enough of block k's distinct pairs, which are at `own`."""
        # a pair counts for the windows that hold it and not an earlier one of its kind
        span, value = self.reach[k] - 1, h[own]
        order = np.lexsort((own, value))
        before = np.full(len(own), -1)
        same = value[order[1:]] == value[order[:-1]]
        before[order[1:][same]] = own[order[:-1][same]]
        step = np.zeros(len(h) + 1, dtype=np.int64)
        np.add.at(step, np.maximum(before + 1, np.maximum(own - span + 1, 0)), 1)
        np.add.at(step, own + 1, -1)
        return np.flatnonzero(np.cumsum(step) >= self.need[k])

    def worded(self, w: np.ndarray, k: int, own: np.ndarray) -> np.ndarray:
        """Starts of windows that hold enough words of block k, whose distinct words are `own`."""
        total = np.concatenate([[0], np.cumsum(np.isin(w, own))])
        p = np.arange(len(w))
        return np.flatnonzero(total[np.minimum(p + self.reach[k], len(w))] - total[p] >= 2 * self.length[k] - self.reach[k])

    def candidates(self, w: np.ndarray):
        """(block, start) of the windows that collide with a block, size by size; a pair may come more than once."""
        h = pair_hashes(w)
        by_size: dict[int, list[np.ndarray]] = {}
        for k, own in self.near(h):
            by_size.setdefault(int(self.length[k]), []).append(self.starts(own, k, h))
        for k, own in self.plain:
            by_size.setdefault(int(self.length[k]), []).append(self.worded(w, k, own))
        for n, lists in sorted(by_size.items()):
            starts = np.unique(np.concatenate(lists))
            for low in range(0, len(starts), 512):
                part = starts[low : low + 512]
                for table, row in zip(self.tables[n], keys(w, part, n, self.walks[n]).tolist(), strict=True):
                    for start, key in zip(part.tolist(), row, strict=True):
                        for k in table.get(key, ()):
                            yield k, start

    def matches(self, text: str | None, first_only: bool = False) -> list[tuple[int, int, int, int]]:
        """(item, first word, words, distance) of each item that the text holds; with `first_only` of one, wherever it lies."""
        w = words(text)
        best: dict[int, tuple[int, int, int]] = {}
        tried: dict[int, set[int]] = {}
        done: set[tuple[int, int]] = set()
        if not len(w) or not self.items:
            return []
        for k, at in self.candidates(w):
            item = self.owner[k]
            if (k, at) in done or item in best and best[item][2] == 0:
                continue
            done.add((k, at))
            own = self.items[item][1].tolist()
            n, allowed = len(own), limit(len(own))
            low = at - self.offset[k]
            seen = tried.setdefault(item, set())
            starts = [p for p in range(max(0, low - allowed), min(len(w), low + allowed + 1)) if p not in seen]
            if not starts:
                continue
            seen.update(starts)
            stretch = w[starts[0] : starts[-1] + n + allowed].tolist()
            least = edit_distance(own, stretch, allowed, anywhere=True)
            if least > allowed or item in best and least > best[item][2]:
                continue
            for p in starts:
                d = edit_distance(own, stretch[p - starts[0] : p - starts[0] + n + allowed], allowed)
                if d <= allowed and (item not in best or (d, p) < (best[item][2], best[item][0])):
                    best[item] = (p, n, d)
                    if first_only:
                        return [(self.items[item][0], p, n, d)]
        return sorted((self.items[i][0], *m) for i, m in best.items())


def repetitions_of(items: list[tuple[int, str]]) -> dict[int, int]:
    """R for each block size of the items."""
    sizes = set()
    for _, text in items:
        if n := len(words(text)):
            m = max(1, n // BLOCK)
            sizes |= {n // m, -(-n // m)}
    return {n: repetitions(n) for n in sizes}


def blocks(benchmark: DataFrame, size: int = ITEM_BLOCK):
    """The items in lists of `size`, in the order of their ids; at least one list, maybe empty."""
    rows = ((r["item_id"], r["text"]) for r in benchmark.select("item_id", "text").orderBy("item_id", "text").toLocalIterator())
    part = list(islice(rows, size))
    yield part
    while part := list(islice(rows, size)):
        yield part


def find(df: DataFrame, benchmark: DataFrame, text: str = "text") -> DataFrame:
    """(doc_id, item_id, start, n_words, distance): each item that each document holds."""
    schema = T.StructType([f for f in df.schema.fields if f.name == "doc_id"] + HITS.fields)
    out = None
    for items in blocks(benchmark):

        reps = repetitions_of(items)

        def run(batches, items=items, reps=reps):
            import pyarrow as pa

            index = Index(items, reps)
            for b in batches:
                rows = [(k, *m) for k, t in enumerate(b.column(text).to_pylist()) for m in index.matches(t)]
                at = pa.array([r[0] for r in rows], pa.int64())
                cols = [pa.array([r[c] for r in rows], kind) for c, kind in ((1, pa.int64()), (2, pa.int32()), (3, pa.int32()), (4, pa.int32()))]
                yield pa.RecordBatch.from_arrays([b.column("doc_id").take(at), *cols], names=schema.names)

        part = df.select("doc_id", text).mapInArrow(run, schema)
        out = part if out is None else out.unionByName(part)
    return out


def decontaminate(df: DataFrame, benchmark: DataFrame, text: str = "text") -> DataFrame:
    """`df` without the rows whose text holds a benchmark item."""
    for items in blocks(benchmark):

        reps = repetitions_of(items)

        def run(batches, items=items, reps=reps):
            import pyarrow as pa

            index = Index(items, reps)
            for b in batches:
                yield b.filter(pa.array([not index.matches(t, True) for t in b.column(text).to_pylist()], pa.bool_()))

        df = df.mapInArrow(run, df.schema)
    return df


def op8(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    return find(documents, benchmark)
