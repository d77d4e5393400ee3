"""Language-model scoring by prediction by partial matching (PPM) over bytes, beside a word unigram base.

One pass over the documents counts, per task and then over all, every word of the training documents and every
(order + 1)-byte gram with its padded context. Shorter contexts are sums of these grams by their last bytes. The model is the
context trie of orders 0 to `order`: a symbol seen after the longest known context is predicted by its count;
otherwise an escape, estimated by method C (distinct symbols seen), leads to the next shorter context, where
the symbols of the longer one are excluded. Below order 0 all symbols left are equally likely. The model is
pretrained (the corpus's counts do not change while a document is scored), so a document's code length is a
sum over its bytes that array code finds level by level.

A text is lower-cased (A-Z), stands between padding and one end symbol (byte 0xFF, which UTF-8 never has), and
its score is the log10 probability of all its bytes and the end.

No count is cut. The trie is dealt to tasks by the last two bytes of the context, or by more where many grams share these:
whatever context ends in them, all its longer suffixes lie in the same task, and of the shorter ones the few grams that
they have are sent along (at most 65,792 of the shortest to all). There every gram
that any document has gets its probability, from the counts of all training documents. At most `max_grams` of the
most frequent grams are sent to the workers with their probability; all others are joined to their documents by a
shuffle. Likewise at most `frequent` of the most frequent words are broadcast, all others are joined by a shuffle.

Null and empty texts have the end alone; a null id is a training document; repeated rows count as often as they
occur; an empty table gives an empty table.
"""

from __future__ import annotations

import uuid
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from phantomlake.llm.common import LOWER, by_bytes, id_text, is_fold, raw, written

#: Padding before a text and the end after it.
MARK = 0xFF
#: Symbols that can follow a context: all bytes, the end among them.
SYMBOLS = 256
COUNTS = pa.schema([("word", pa.binary()), ("gram", pa.int64()), ("n", pa.int64()), ("seen", pa.int64())])


def grams_of(texts: list[bytes], order: int) -> tuple[np.ndarray, np.ndarray]:
    """The (order + 1)-byte grams (first byte highest) that end at each byte of the texts and their ends, and
    the text that each belongs to."""
    pad = bytes([MARK]) * order
    sizes = np.array([len(x) + 1 for x in texts])
    data = np.frombuffer(b"".join(pad + x.translate(LOWER) + bytes([MARK]) for x in texts), np.uint8)
    gram = np.zeros(len(data), np.int64)
    for k in range(order + 1):
        gram[order:] |= data[order - k : len(data) - k].astype(np.int64) << (8 * k)
    own = np.repeat(np.arange(len(texts)), sizes)
    at = np.arange(len(own)) + order * (own + 1)
    return gram[at], own


def pieces(texts: list[bytes], most: int = 500_000) -> Iterator[tuple[int, int]]:
    return by_bytes(texts, most)


def corpus_counts(docs: DataFrame, order: int) -> DataFrame:
    """(word, null, n, n) and (null, gram, n, seen), summed: n in the training documents, seen in all of them. Words
    are counted in the training documents alone."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: Counter[bytes] = Counter()
        none = (np.zeros(0, np.int64),) * 3
        grams = none
        waiting: list[tuple[np.ndarray, ...]] = []

        def summed(xs: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, ...]:
            keys, *counts = (np.concatenate(x) for x in zip(*xs, strict=True))
            order_ = np.argsort(keys, kind="stable")
            keys = keys[order_]
            first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, int)
            return keys[first], *(np.add.reduceat(x[order_], first) if len(first) else x for x in counts)

        def out(words: Counter[bytes], grams: tuple[np.ndarray, ...]) -> Iterator[pa.RecordBatch]:
            n, m = len(words), len(grams[0])
            if n:
                times = pa.array(list(words.values()), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(list(words), pa.binary()), pa.nulls(n, pa.int64()), times, times], schema=COUNTS)
            if m:
                yield pa.RecordBatch.from_arrays([pa.nulls(m, pa.binary()), *(pa.array(x) for x in grams)], schema=COUNTS)

        for part in parts:
            texts, held = raw(part.column("text")), part.column("held_out").to_pylist()
            for a, z in pieces(texts):
                train = [x for x, h in zip(texts[a:z], held[a:z], strict=True) if not h]
                other = [x for x, h in zip(texts[a:z], held[a:z], strict=True) if h]
                for x in train:
                    words.update(x.translate(LOWER).split())
                for some, share in ((train, 1), (other, 0)):
                    if some:
                        keys, n = np.unique(grams_of(some, order)[0], return_counts=True)
                        waiting.append((keys, n * share, n))
                if len(waiting) >= 8:
                    grams, waiting = summed([grams, *waiting]), []
                if len(words) > 400_000 or len(grams[0]) > 1_500_000:
                    yield from out(words, grams)
                    words, grams = Counter(), none
        yield from out(words, summed([grams, *waiting]))

    counted = docs.mapInArrow(run, "word binary, gram long, n long, seen long").groupBy("word", "gram")
    return counted.agg(F.sum("n").alias("n"), F.sum("seen").alias("seen"))


@dataclass
class Trie:
    """Per context length k: the sorted codes of grams of k + 1 bytes and their counts."""

    order: int
    grams: list[np.ndarray]
    counts: list[np.ndarray]


def least_count(counts: DataFrame, most: int, col: str = "n") -> int:
    """A count that at most `most` rows reach. Rows are summed by steps of the logarithm, of which there are few."""
    steps = counts.select(F.floor(F.log(F.col(col).cast("double")) * 50).alias("step")).groupBy("step").count().collect()
    kept = 0
    for row in sorted(steps, key=lambda r: -r["step"]):
        if kept + row["count"] > most:
            return int(np.floor(np.exp((row["step"] + 1) / 50))) + 1
        kept += row["count"]
    return 1


class Slots:
    """Sorted keys -> row, by open addressing: a few array steps find the rows of many keys."""

    def __init__(self, keys: np.ndarray):
        self.bits = max(4, int(np.ceil(np.log2(max(1, len(keys)) * 2))))
        self.row = np.full(1 << self.bits, -1, np.int32)
        self.keys = keys if len(keys) else np.full(1, -1, np.int64)
        at, left = self.at(keys), np.arange(len(keys), dtype=np.int32)
        while len(left):
            free = self.row[at] < 0
            self.row[at[free]] = left[free]  # of several, one stays
            lost = self.row[at] != left
            at, left = (at[lost] + 1) & ((1 << self.bits) - 1), left[lost]

    def at(self, keys: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return ((keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The row of each key, -1 where it is unknown."""
        at = self.at(keys)
        out = self.row[at]
        open_ = np.flatnonzero((out >= 0) & (self.keys[out] != keys))
        while len(open_):
            at[open_] = (at[open_] + 1) & ((1 << self.bits) - 1)
            out[open_] = self.row[at[open_]]
            open_ = open_[(out[open_] >= 0) & (self.keys[out[open_]] != keys[open_])]
        return out


class Scorer:
    """The trie with what each context needs: totals, distinct symbols, and its parent's totals without its symbols."""

    def __init__(self, trie: Trie):
        self.order = trie.order
        self.grams = [Slots(g) for g in trie.grams]
        self.counts = [n.astype(np.float64) for n in trie.counts]
        self.contexts: list[Slots] = []
        self.total: list[np.ndarray] = []
        self.distinct: list[np.ndarray] = []
        self.left_total: list[np.ndarray] = []  # of the parent, without the symbols of the context
        self.left_distinct: list[np.ndarray] = []
        for k in range(trie.order + 1):
            gram, n = trie.grams[k], self.counts[k]
            context = gram >> 8
            first = np.flatnonzero(np.concatenate([[True], context[1:] != context[:-1]])) if len(gram) else np.zeros(0, int)
            own = context[first]
            self.contexts.append(Slots(own))
            self.total.append(np.add.reduceat(n, first) if len(first) else n)
            self.distinct.append(np.diff(np.append(first, len(gram))).astype(np.float64))
            if k:
                mask = (1 << (8 * (k - 1))) - 1
                parent = self.contexts[k - 1].find(own & mask)
                same = self.grams[k - 1].find(gram & ((1 << (8 * k)) - 1))
                taken = np.where(same >= 0, self.counts[k - 1][same], 0.0)
                taken = np.add.reduceat(taken, first) if len(first) else taken
                self.left_total.append(np.where(parent >= 0, self.total[k - 1][parent] - taken, 0.0))
                self.left_distinct.append(np.where(parent >= 0, self.distinct[k - 1][parent] - self.distinct[k], 0.0))
            else:
                self.left_total.append(np.zeros(len(own)))
                self.left_distinct.append(SYMBOLS - self.distinct[0])

    def log10(self, gram: np.ndarray) -> np.ndarray:
        """log10 P(last byte | bytes before) of each (order + 1)-byte gram."""
        out = np.zeros(len(gram))
        left = np.arange(len(gram))
        total, distinct = np.full(len(gram), -1.0), np.zeros(len(gram))  # of the level to come, once symbols are excluded
        for k in range(self.order, -1, -1):
            g = gram[left] & ((1 << (8 * (k + 1))) - 1)
            row = self.grams[k].find(g)
            hit = row >= 0
            context = self.contexts[k].find(g >> 8)
            known = context >= 0
            fresh = total[left] < 0
            n = np.where(fresh, self.total[k][context] if len(self.total[k]) else 0.0, total[left])
            d = np.where(fresh, self.distinct[k][context] if len(self.distinct[k]) else 0.0, distinct[left])
            denominator = np.log10(np.maximum(n + d, 1.0))
            out[left[hit]] += np.log10(self.counts[k][row[hit]]) - denominator[hit]
            miss = known & ~hit
            # with nothing left to exclude from, the escape is certain
            escape = miss & (d > 0)
            out[left[escape]] += np.log10(d[escape]) - denominator[escape]
            at = left[miss]
            total[at] = self.left_total[k][context[miss]]
            distinct[at] = self.left_distinct[k][context[miss]]
            left = left[~hit]
        out[left] -= np.log10(np.where(total[left] < 0, SYMBOLS, np.maximum(distinct[left], 1.0)))
        return out


def levels_of(gram: np.ndarray, n: np.ndarray, lengths: range) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each context length k the sorted last k + 1 bytes of the grams, and their summed counts."""
    out = []
    for k in lengths:
        keys, back = np.unique(gram & ((1 << (8 * (k + 1))) - 1), return_inverse=True)
        # exact sums of integers: bincount would add as floats
        total = np.zeros(len(keys), np.int64)
        np.add.at(total, back, n)
        out.append((keys, total))
    return out


def _last(n_bytes: int) -> Column:
    """The last bytes of a gram's context (the bytes before its last one)."""
    return F.shiftright("gram", 8).bitwiseAND(F.lit((1 << (8 * n_bytes)) - 1))


def dealt_by_ending(grams: DataFrame, order: int, bucket_grams: int) -> tuple[DataFrame, DataFrame]:
    """(bucket, length, gram, n, seen) of all grams, and (bucket, level, gram, n) of the shorter grams that a bucket needs
    besides its own.

    A gram goes where the last two bytes of its context go; where more than `bucket_grams` grams share these, where the last
    three go, and so on up to the whole context, which at most 256 grams share. `length` is the number of these bytes. What
    is shorter than that in such a bucket's contexts is counted over all grams and sent along: at most 256 grams a level.
    """
    spark = grams.sparkSession
    shortest = min(2, order)
    buckets = max(1, -(-grams.count() // bucket_grams))
    rows, crowded = grams.withColumn("length", F.lit(shortest)), []
    for length in range(shortest, order):
        full = rows.filter(F.col("length") == length).groupBy(_last(length).alias("ending")).count().filter(F.col("count") > bucket_grams).select("ending")
        # each of these has more grams than a bucket, so there are fewer of them than buckets
        full = spark.createDataFrame(full.toPandas().astype("int64"), "ending long")
        crowded.append((length, full))
        rows = rows.join(F.broadcast(full.withColumn("crowded", F.lit(True))), (F.col("length") == length) & (_last(length) == F.col("ending")), "left")
        rows = rows.withColumn("length", F.when(F.col("crowded"), length + 1).otherwise(F.col("length"))).drop("ending", "crowded")
    ending = F.shiftright("gram", 8).bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("length") * 8) - 1)
    dealt = rows.select(F.pmod(F.xxhash64("length", ending), F.lit(buckets)).alias("bucket"), "length", "gram", "n", "seen")
    more = spark.createDataFrame([], "bucket long, level int, gram long, n long")
    for level, full in crowded:
        if not full.limit(1).count():
            break
        lower = F.col("gram").bitwiseAND(F.lit((1 << (8 * (level + 1))) - 1))
        counted = grams.filter("n > 0").join(F.broadcast(full), _last(level) == F.col("ending")).groupBy(lower.alias("gram")).agg(F.sum("n").alias("n")).withColumn("ending", _last(level))
        wanted = dealt.filter(F.col("length") > level).select("bucket", _last(level).alias("ending")).distinct()
        more = more.unionByName(wanted.join(counted, "ending").select("bucket", F.lit(level).alias("level"), "gram", "n"))
    return dealt, more


def gram_scores(grams: DataFrame, order: int, bucket_grams: int) -> DataFrame:
    """gram, seen, logp: log10 of the probability of each gram's last byte after the others, from all counts.

    A task takes about `bucket_grams` grams, whatever context is common (see dealt_by_ending)."""
    spark = grams.sparkSession
    shortest = min(2, order)
    trained = grams.filter("n > 0")
    short = []
    for k in range(shortest):  # at most 256 and 65,536 grams
        table = trained.groupBy(F.col("gram").bitwiseAND(F.lit((1 << (8 * (k + 1))) - 1)).alias("gram")).agg(F.sum("n").alias("n")).toArrow()
        gram, n = table.column("gram").to_numpy(), table.column("n").to_numpy()
        short.append((gram[np.argsort(gram)], n[np.argsort(gram)]))
    sent = spark.sparkContext.broadcast(short)
    out = pa.schema([("gram", pa.int64()), ("seen", pa.int64()), ("logp", pa.float64())])

    def run(own: pa.Table, more: pa.Table) -> pa.Table:
        gram, n, length = (own.column(k).to_numpy() for k in ("gram", "n", "length"))
        extra, extra_n, level = (more.column(k).to_numpy() for k in ("gram", "n", "level"))
        levels = list(sent.value)
        for k in range(shortest, order + 1):
            here, sent_here = (n > 0) & (length <= k), level == k
            keys = np.concatenate([gram[here], extra[sent_here]])
            levels += levels_of(keys, np.concatenate([n[here], extra_n[sent_here]]), range(k, k + 1))
        logp = Scorer(Trie(order, [g for g, _ in levels], [c for _, c in levels])).log10(gram)
        return pa.Table.from_arrays([pa.array(gram), own.column("seen"), pa.array(logp)], schema=out)

    dealt, more = dealt_by_ending(grams, order, bucket_grams)
    return dealt.groupBy("bucket").cogroup(more.groupBy("bucket")).applyInArrow(run, "gram long, seen long, logp double")


class Known:
    """Sorted grams with their log10 probability."""

    def __init__(self, gram: np.ndarray, logp: np.ndarray):
        self.slots, self.logp = Slots(gram), logp if len(logp) else np.zeros(1)

    def scores(self, texts: list[bytes], order: int) -> tuple[np.ndarray, list[np.ndarray], list[np.ndarray]]:
        """The sum over the known grams of each text, and each text's other grams and how often it has them."""
        gram, own = grams_of(texts, order)
        kinds, back = np.unique(gram, return_inverse=True)
        row = self.slots.find(kinds)
        total = np.bincount(own, np.where(row >= 0, self.logp[row], 0.0)[back], minlength=len(texts))
        other = np.flatnonzero(row[back] < 0)
        # the place of a gram among the kinds is below 2**32
        pairs, times = np.unique((own[other] << 32) | back[other], return_counts=True)
        cuts = np.searchsorted(pairs >> 32, np.arange(1, len(texts)))
        return total, np.split(kinds[pairs & 0xFFFFFFFF], cuts), np.split(times, cuts)


#: The tables that a worker process made last, kept over its tasks.
_MADE: dict[str, tuple[Known, dict[bytes, float]]] = {}


def score(docs: DataFrame, order: int = 5, max_grams: int = 1_000_000, frequent: int = 200_000, held_mod: int = 7, held_rest: int = 2, bucket_grams: int = 200_000) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score; a context has at most 6 bytes."""
    if not 0 <= order <= 6:
        raise ValueError(f"contexts of {order} bytes: a gram of up to 7 bytes is one 64-bit integer")
    spark: SparkSession = docs.sparkSession
    slim = id_text(docs).withColumn("held_out", is_fold("doc_id", held_mod, held_rest))
    counts = written(corpus_counts(slim.select("text", "held_out"), order), "ppm-counts")
    words = counts.filter("word is not null").select("word", "n")
    grams = counts.filter("gram is not null").select("gram", "n", "seen")
    sizes = words.agg(F.sum("n").alias("n"), F.count("*").alias("v")).first()
    ends = slim.filter(~F.col("held_out")).count()
    n_train = int(sizes["n"] or 0) + ends
    n_types = int(sizes["v"]) + (1 if ends else 0)
    whole = float(n_train + n_types + 1)
    likely = written(gram_scores(grams, order, bucket_grams), "ppm-grams")
    table = likely.filter(F.col("seen") >= least_count(likely, max_grams, "seen")).select("gram", "logp").toArrow()
    sent = spark.sparkContext.broadcast((table.column("gram").to_numpy(), table.column("logp").to_numpy()))
    top = words.filter(F.col("n") >= least_count(words, frequent)).toArrow()
    known = spark.sparkContext.broadcast((top.column("word").to_pylist(), np.log10((top.column("n").to_numpy() + 1) / whole)))
    end_score = float(np.log10((ends + 1) / whole))
    has_end = int(ends > 0)
    out = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64()), ("rare", pa.list_(pa.binary())), ("times", pa.list_(pa.int64())), ("grams", pa.list_(pa.int64())), ("gram_times", pa.list_(pa.int64()))])
    model = uuid.uuid4().hex

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if model not in _MADE:
            _MADE.clear()
            _MADE[model] = (Known(*sent.value), dict(zip(known.value[0], known.value[1].tolist(), strict=True)))
        likely_, logs = _MADE[model]
        for part in parts:
            texts, ids, held, number = raw(part.column("text")), part.column("doc_id"), part.column("held_out"), part.column("row")
            for a, z in pieces(texts):
                rows = []
                for x in texts[a:z]:
                    tokens = x.translate(LOWER).split()
                    found = [logs.get(w) for w in tokens]
                    sure = [v for v in found if v is not None]
                    rare = Counter(w for w, v in zip(tokens, found, strict=True) if v is None) if len(sure) < len(found) else {}
                    rows.append((len(tokens) + 1, len(sure) + has_end, sum(sure) + end_score, list(rare), list(rare.values())))
                n, k, base, rare_, times = zip(*rows, strict=True)
                total, others, other_times = likely_.scores(texts[a:z], order)
                yield pa.RecordBatch.from_arrays([number.slice(a, z - a), ids.slice(a, z - a), held.slice(a, z - a), pa.array(n, pa.int64()), pa.array(k, pa.int64()), pa.array(base), pa.array(total), pa.array(rare_, pa.list_(pa.binary())), pa.array(times, pa.list_(pa.int64())), pa.array(others, pa.list_(pa.int64())), pa.array(other_times, pa.list_(pa.int64()))], schema=out)

    numbered = slim.select(F.monotonically_increasing_id().alias("row"), "doc_id", "held_out", "text")
    first = written(numbered.mapInArrow(run, "row long, doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double, rare array<binary>, times array<long>, grams array<long>, gram_times array<long>"), "ppm-scores")
    rare = first.select("row", F.explode(F.arrays_zip("rare", "times")).alias("x")).select("row", F.col("x.rare").alias("word"), F.col("x.times").alias("times"))
    found = rare.join(words, "word", "left").select("row", "times", "n")
    more = found.groupBy("row").agg(
        F.sum(F.when(F.col("n").isNotNull(), F.col("times")).otherwise(0)).alias("more_known"),
        F.sum(F.col("times") * F.log10((F.coalesce("n", F.lit(0)) + 1) / F.lit(whole))).alias("more_base"),
    )
    others = first.select("row", F.explode(F.arrays_zip("grams", "gram_times")).alias("x")).select("row", F.col("x.grams").alias("gram"), F.col("x.gram_times").alias("times"))
    other = others.join(likely, "gram").groupBy("row").agg(F.sum(F.col("times") * F.col("logp")).alias("more_score"))
    return first.join(more, "row", "left").join(other, "row", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("more_known", F.lit(0))).alias("n_known"), F.lit(n_train).cast("long").alias("train_tokens"),
        (F.col("base_score") + F.coalesce("more_base", F.lit(0.0))).alias("base_score"), (F.col("score") + F.coalesce("more_score", F.lit(0.0))).alias("score"),
    )
