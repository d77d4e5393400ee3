"""Benchmark decontamination by CGK embedding, bit-sampling LSH and exact edit verification.

The unit is the word (runs of letters and digits, lower-cased; other ASCII characters separate). The CGK walk
reads a sequence of words with a pointer and writes the word under it, 3n times for n words; after each step the
pointer moves on or stays, by a random bit of (step, word). Sequences at a small edit distance walk in step most
of the time, so edit distance becomes Hamming distance of the embeddings. A repetition samples `bits` coordinates
of one of `walks` embeddings and hashes them; equal hashes make a candidate. The number of repetitions is the fewest
that find items with `max_edits` of their words edited with probability `recall`. It is measured on the items themselves,
randomly edited inside other words, through the same search that documents go through; where `most_repetitions` do not
reach it, no window is left out and all go to the exact check.

Windows are as long as the item and start where the item would start: each item names more of its words than may be
edited (those in fewest items, spread by a hash) and a window is laid through every such anchor word of a document, so
one anchor at least stands whatever the edits are. Candidates are confirmed by the edit distance of the item to the best
stretch of the document around the window (ends free): at most `max_edits` of its words. Items of fewer than `min_words`
words are found where all their words stand as they are.

Documents are read whole, in one pass without a shuffle. The benchmark is a bounded query set: it is broadcast in
blocks of at most `block` items or `block_words` words, one pass of the documents each. Null and empty texts hold
nothing; a null doc_id is reported with null; repeated rows are reported each; an item is reported once in a document,
at the place with the fewest edits, of several the first; equal items are reported under each of their ids; items
without a word or an id are not looked for; empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from phantomlake.llm.common import WordHashes, by_bytes, id_text, mixed, raw, small_batches, windows_hash

#: ASCII bytes that are not letters or digits become spaces.
SEPARATE = bytes(x if x >= 128 or chr(x).isalnum() else 32 for x in range(256))
FOUND = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("start", pa.int64()), ("item_words", pa.int64()), ("edits", pa.int64()), ("similarity", pa.float64())])


def words_of(text: bytes) -> list[bytes]:
    return (text.lower() if text.isascii() else text.decode(errors="replace").lower().encode()).translate(SEPARATE).split()


@dataclass(frozen=True)
class Settings:
    """Production values; `max_edits` is the share of an item's words that may differ."""

    max_edits: float = 0.2
    min_words: int = 8
    walks: int = 8
    bits: int = 2
    recall: float = 0.99
    most_repetitions: int = 96
    block: int = 20_000
    block_words: int = 2_000_000
    seed: int = 17

    def edits(self, size: int) -> int:
        """The edits that an item of so many words may have."""
        return int(self.max_edits * size)


def walk_bits(words: np.ndarray, step: int, walk: int, seed: int) -> np.ndarray:
    """The random bit of (walk, step, word) for each word hash."""
    key = np.uint64((seed * 1_000_003 + walk * 65_537 + step) & 0xFFFFFFFFFFFFFFFF)
    return ((words * (mixed(np.array([key]))[0] | np.uint64(1))) >> np.uint64(63)).astype(np.int64)


def embedded(words: np.ndarray, starts: np.ndarray, sizes: np.ndarray, ends: np.ndarray, walk: int, seed: int, steps: np.ndarray) -> np.ndarray:
    """The CGK walks over the windows words[start : start + size], which come with falling numbers of steps; past
    the end of a window or of its text 0 is written."""
    at, stop = starts.astype(np.int64), np.minimum(starts + sizes, ends)
    most = int(steps[0]) if len(steps) else 0
    out = np.zeros((len(starts), most), np.uint64)
    last = len(words) - 1
    alive = np.searchsorted(-steps, -np.arange(most), side="left")
    for step in range(most):
        n = alive[step]
        here = at[:n]
        w = np.where(here < stop[:n], words[np.minimum(here, last)], 0)
        out[:n, step] = w
        at[:n] += walk_bits(w, step, walk, seed)
    return out


class Lsh:
    """The items' anchors and hashes in every repetition, and what finds windows for them."""

    def __init__(self, ids: list[int], items: list[np.ndarray], settings: Settings):
        self.settings, self.ids, self.items = settings, np.array(ids, np.int64), items
        self.sizes = np.array([len(x) for x in items], np.int64)
        long = [k for k, x in enumerate(items) if len(x) >= settings.min_words]
        often: dict[int, int] = {}
        for k in long:
            for w in set(items[k].tolist()):
                often[w] = often.get(w, 0) + 1
        anchors: dict[int, list[tuple[int, int]]] = {}
        for k in long:
            x = items[k]
            order = np.lexsort((mixed(x), [often[w] for w in x.tolist()]))
            for offset in order[: settings.edits(len(x)) + 1].tolist():
                anchors.setdefault(int(x[offset]), []).append((k, offset))
        self.words = np.array(sorted(anchors), np.uint64)
        self.first = np.cumsum([0] + [len(anchors[int(w)]) for w in self.words])
        pairs = np.array([x for w in self.words for x in anchors[int(w)]], np.int64).reshape(-1, 2)
        self.item, self.offset = pairs[:, 0], pairs[:, 1]
        self.short: dict[int, dict[int, list[int]]] = {}  # number of words -> hash of all of them -> items
        for k, x in enumerate(items):
            if len(x) < settings.min_words:
                self.short.setdefault(len(x), {}).setdefault(int(windows_hash(x, len(x))[0]), []).append(k)
        ends = np.cumsum(self.sizes)
        self.keys = np.zeros((settings.most_repetitions, len(items)), np.uint64)
        if long:
            words, at = np.concatenate(items), np.array(long)
            self.keys[:, at] = self.hashes(words, (ends - self.sizes)[at], self.sizes[at], ends[at], settings.most_repetitions)
        self.repetitions, self.reached = self.enough(long)
        self.keys = self.keys[: self.repetitions]

    def samples(self, repetition: int, sizes: np.ndarray) -> np.ndarray:
        """sizes x bits: the coordinates that a repetition samples. The walk over a window ends after
        about 2 x size steps; only the first 7/4 x size are sampled, so that ends do not look alike."""
        seeds = np.arange(self.settings.bits, dtype=np.uint64) + np.uint64(repetition * 1009 + self.settings.seed)
        return (mixed(seeds)[None, :] % np.maximum(7 * sizes // 4, 1)[:, None].astype(np.uint64)).astype(np.int64)

    def hashes(self, words: np.ndarray, starts: np.ndarray, sizes: np.ndarray, ends: np.ndarray, n: int) -> np.ndarray:
        """n repetitions x windows hashes; a window has the size of the item it is laid for."""
        out = np.zeros((n, len(starts)), np.uint64)
        order = np.argsort(-sizes, kind="stable")
        starts, sizes, ends = starts[order], sizes[order], ends[order]
        rows = np.arange(len(starts))
        for walk in range(min(self.settings.walks, n)):
            plans = {r: self.samples(r, sizes) for r in range(walk, n, self.settings.walks)}
            steps = np.maximum.accumulate(np.max([p.max(axis=1) for p in plans.values()], axis=0)[::-1])[::-1] + 1
            e = embedded(words, starts, sizes, ends, walk, self.settings.seed, steps)
            for r, plan in plans.items():
                h = np.full(len(starts), np.uint64(r + 1))
                for k in range(plan.shape[1]):
                    h = mixed(h) + e[rows, plan[:, k]]
                out[r, order] = mixed(h)
        return out

    def enough(self, long: list[int], trials: int = 600) -> tuple[int, float]:
        """(repetitions, recall): the fewest that find edited items as often as wanted, and how often they do. 0
        repetitions where none do: then all windows are candidates."""
        rng, s = np.random.default_rng(self.settings.seed), self.settings
        if not long:
            return 0, 1.0
        texts: list[np.ndarray] = []
        own = rng.permutation(np.resize(rng.permutation(long), trials))
        strange = lambda n: rng.integers(1, 2**62, n).tolist()
        for k in own:
            edited = self.items[k].tolist()
            for _ in range(s.edits(len(edited))):
                at, kind = int(rng.integers(len(edited))), int(rng.integers(3))
                edited[at : at + (kind != 1)] = strange(int(kind != 2))
            texts.append(np.array([*strange(20), *edited, *strange(20)], np.uint64))
        ends = np.cumsum([len(x) for x in texts])
        words = np.concatenate(texts)
        start, item, text = self.windows(words, ends - [len(x) for x in texts], ends)
        mine = item == own[text]
        start, item, text = start[mine], item[mine], text[mine]
        same = self.hashes(words, start, self.sizes[item], ends[text], s.most_repetitions) == self.keys[:, item]
        first = np.where(same.any(axis=0), same.argmax(axis=0), s.most_repetitions)
        found = np.full(trials, s.most_repetitions)
        np.minimum.at(found, text, first)
        recall = np.cumsum(np.bincount(found, minlength=s.most_repetitions + 1)[:-1]) / trials
        good = np.flatnonzero(recall >= s.recall)
        return (int(good[0]) + 1, float(recall[good[0]])) if len(good) else (0, 1.0)

    def windows(self, words: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, item, text) of the windows through the anchor words of texts that lie one after another."""
        if not len(self.words) or not len(words):
            return (np.zeros(0, np.int64),) * 3
        at = np.searchsorted(self.words, words)
        at[at == len(self.words)] = 0
        hit = np.flatnonzero(self.words[at] == words)
        first = self.first[at[hit]]
        n = self.first[at[hit] + 1] - first
        row = np.repeat(first, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        start, item = np.repeat(hit, n) - self.offset[row], self.item[row]
        text = np.searchsorted(ends, np.repeat(hit, n), side="right")
        # a window may begin before its text or end after it by the edits allowed
        slack = np.array([self.settings.edits(n) for n in self.sizes.tolist()], np.int64)[item]
        ok = (start >= begins[text] - slack) & (start + self.sizes[item] <= ends[text] + slack)
        start, item, text = np.maximum(start[ok], begins[text[ok]]), item[ok], text[ok]
        kinds = np.unique(np.stack([text, item, start]), axis=1) if len(start) else np.zeros((3, 0), np.int64)
        return kinds[2], kinds[1], kinds[0]

    def candidates(self, words: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> list[tuple[int, int, int]]:
        """(text, item, start) of the windows whose hash equals their item's in some repetition."""
        start, item, text = self.windows(words, begins, ends)
        out: list[tuple[int, int, int]] = self.exact(words, begins, ends)
        most = max(1, 2_000_000 // int(self.sizes.max(initial=1)))  # windows at a time, by what their walks write
        for a in range(0, len(start), most):
            s, i, t = start[a : a + most], item[a : a + most], text[a : a + most]
            if self.repetitions:
                same = (self.hashes(words, s, self.sizes[i], ends[t], self.repetitions) == self.keys[:, i]).any(axis=0)
                s, i, t = s[same], i[same], t[same]
            out += zip(t.tolist(), i.tolist(), s.tolist(), strict=True)
        return out

    def exact(self, words: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> list[tuple[int, int, int]]:
        """(text, item, start) of the places where all words of a short item stand."""
        out: list[tuple[int, int, int]] = []
        for n, items in self.short.items():
            h = windows_hash(words, n)
            at = np.flatnonzero(np.isin(h, np.array(list(items), np.uint64)))
            text = np.searchsorted(ends, at, side="right")
            inside = at + n <= ends[text]
            for t, start in zip(text[inside].tolist(), at[inside].tolist(), strict=True):
                out += [(t, k, start) for k in items[int(h[start])]]
        return out


def edit_distance(item: np.ndarray, stretch: np.ndarray) -> int:
    """Fewest word edits that turn the item into some part of the stretch."""
    column = np.arange(len(stretch) + 1)
    row = np.zeros(len(stretch) + 1, np.int64)
    for k, w in enumerate(item):
        new = np.minimum(row[1:] + 1, row[:-1] + (stretch != w))
        new = np.concatenate([[k + 1], new])
        row = np.minimum.accumulate(new - column) + column
    return int(row.min())


def contaminated(texts: list[bytes], lsh: Lsh, hashes: WordHashes) -> list[list[tuple[int, int, int, int]]]:
    """For each text (item, start, words, edits) of the items that it holds, each once, at its closest stretch."""
    out: list[list[tuple[int, int, int, int]]] = []
    for a, z in by_bytes(texts):
        each = [hashes.of(words_of(x)) for x in texts[a:z]]
        ends = np.cumsum([len(x) for x in each])
        begins, words = ends - [len(x) for x in each], np.concatenate(each)
        best: dict[tuple[int, int], tuple[int, int]] = {}
        checked: dict[bytes, int] = {}
        for t, k, start in lsh.candidates(words, begins, ends):
            item = lsh.items[k]
            allowed = lsh.settings.edits(len(item)) if len(item) >= lsh.settings.min_words else 0
            if (t, k) in best and best[t, k][0] == 0:
                continue
            stretch = words[max(begins[t], start - allowed) : min(ends[t], start + len(item) + allowed)]
            key = k.to_bytes(4, "little") + stretch.tobytes()
            if key not in checked:
                # every item word that the stretch lacks is an edit
                checked[key] = edit_distance(item, stretch) if np.isin(item, stretch).sum() >= len(item) - allowed else len(item)
            edits, at = checked[key], int(start - begins[t])
            if edits <= allowed and ((t, k) not in best or (edits, at) < best[t, k]):
                best[t, k] = edits, at
        found: list[list[tuple[int, int, int, int]]] = [[] for _ in each]
        for (t, k), (edits, at) in sorted(best.items()):
            found[t].append((k, at, len(lsh.items[k]), edits))
        out += found
    return out


def item_blocks(benchmark: DataFrame, settings: Settings) -> Iterator[Lsh]:
    """The benchmark in blocks of bounded size."""
    rows = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("binary").alias("text")).filter("item_id is not null and text is not null")
    hashes = WordHashes()
    ids: list[int] = []
    items: list[np.ndarray] = []
    n_words = 0
    for row in rows.distinct().orderBy("item_id", "text").toLocalIterator():
        words = hashes.of(words_of(bytes(row["text"])))
        if len(words):
            ids.append(row["item_id"])
            items.append(words)
            n_words += len(words)
        if len(ids) == settings.block or n_words >= settings.block_words:
            yield Lsh(ids, items, settings)
            ids, items, n_words = [], [], 0
    if ids:
        yield Lsh(ids, items, settings)


def find_items(docs: DataFrame, benchmark: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """doc_id, item_id, start (in words), item_words, edits, similarity of every item that a document holds."""
    spark, slim, out = docs.sparkSession, id_text(docs), None
    schema = "doc_id long, item_id long, start long, item_words long, edits long, similarity double"
    for block in item_blocks(benchmark, settings):
        sent = spark.sparkContext.broadcast(block)

        def run(parts: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            lsh, hashes = sent.value, WordHashes()
            for part in parts:
                rows = [(i, int(lsh.ids[k]), start, n, edits, 1 - edits / n) for i, xs in zip(part.column("doc_id").to_pylist(), contaminated(raw(part.column("text")), lsh, hashes), strict=True) for k, start, n, edits in xs]
                columns = list(zip(*rows, strict=True)) or [()] * len(FOUND)
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(columns, FOUND, strict=True)], schema=FOUND)

        found = slim.mapInArrow(run, schema)
        out = found if out is None else out.unionByName(found)
    return out if out is not None else slim.limit(0).select(*(F.lit(None).cast(c.split()[1]).alias(c.split()[0]) for c in schema.split(", ")))


def clean_documents(docs: DataFrame, benchmark: DataFrame, settings: Settings = Settings(), text_col: str = "text") -> DataFrame:
    """The documents that hold no item, with all their columns."""
    small_batches(docs.sparkSession)
    spark = docs.sparkSession
    for block in item_blocks(benchmark, settings):
        sent = spark.sparkContext.broadcast(block)

        def run(parts: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            lsh, hashes = sent.value, WordHashes()
            for part in parts:
                yield part.filter(pa.array([not xs for xs in contaminated(raw(part.column(text_col)), lsh, hashes)], pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
