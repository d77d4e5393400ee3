"""MinHash near-duplicates by an inverted join over signature coordinates.

1. Every document becomes its set of 5-word shingles (64-bit hashes) and a signature of `coords` minima. Equal
   sets are one class, told by a 128-bit digest; only the class's smallest id goes on.
2. Each class is posted under its (coordinate, value) pairs. Two documents above the similarity threshold agree
   on at least `matches` of the coordinates; `matches` is derived from the threshold by the exact binomial tail, so
   that at most 1 pair in 30,000 right at the threshold (`MISS`) has fewer. So values
   that only one document has are dropped, and with them every document with fewer than `matches` shared values
   (skip). Of the rest only the `coords - matches + 1` rarest values of a document are posted (prefix): two
   documents with `matches` equal coordinates share one of these.
3. The members of a posting list are compared in a task by whole signatures, collisions counted in array code;
   two documents meet in the first list that they share, once. Lists longer than `block` are cut into blocks, each
   pair of blocks a task of its own, so no task takes a whole long list; a list of long documents is cut finer.
   Before that, long lists are thinned: members first meet the list's most central documents only, and pairs
   inside one confirmed component are not looked for again.
4. Documents with `matches` or more collisions in a unit of comparison get their whole shingle sets there, and the
   pairs are confirmed on these in the same task. Only links leave it, and of each unit a spanning forest: no
   table holds the pairs of a group.
5. Components of the confirmed links come from min-label propagation with pointer jumping over class ids.

No pair is emitted because of a shared passage alone, and copies never meet each other.

Words are runs of anything but space and \\t-\\r, lower-cased A-Z. A text with fewer than 5 words is one shingle;
without words it links with nothing. A doc_id names one document: repeated rows of it are equal and share
their component; a null id is linked with nothing: its component is null, and it is kept.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from phantomlake.llm.common import LOWER, WordHashes, by_bytes, id_text, mixed, raw, windows_hash, written

COORDS, WIDTH = 64, 5
#: The share of the pairs right at the threshold that the signature may miss.
MISS = 1 / 30_000
#: Shingles of an ordinary document: a block of a list holds `block` times as many at most.
ORDINARY = 2_000
#: Buckets of the table in which the shingles of one document are marked.
MARKS = 1 << 18
SIGNED = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("digest", pa.binary()), ("sig", pa.binary())])
SETS = pa.schema([("doc_id", pa.int64()), ("shingles", pa.binary())])


def missed(threshold: int, coords: int, matches: int) -> float:
    """The probability that a pair whose similarity is `threshold` percent agrees on fewer than `matches` of the
    coordinates: the exact binomial tail."""
    p = threshold / 100
    return sum(comb(coords, k) * p**k * (1 - p) ** (coords - k) for k in range(matches))


def least_matches(threshold: int, coords: int, miss: float = MISS) -> int:
    """The most matches that can be asked for so that at most `miss` of the pairs at the threshold are missed."""
    return max((m for m in range(1, coords + 1) if missed(threshold, coords, m) <= miss), default=1)


def shingle_hashes(words: list[bytes], hashes: WordHashes, width: int = WIDTH) -> np.ndarray:
    """The sorted distinct shingle hashes of a text's words."""
    h = hashes.of(words)
    if len(h) < width:
        return windows_hash(h, len(h)) + np.uint64(len(h)) if len(h) else h
    return np.unique(windows_hash(h, width))


def multipliers(coords: int) -> np.ndarray:
    """Odd 64-bit multipliers of the coordinates, the same everywhere."""
    return mixed(np.arange(1, coords + 1, dtype=np.uint64)) | np.uint64(1)


def signatures(sets: list[np.ndarray], coords: int) -> np.ndarray:
    """documents x coords minima (upper 32 bits); only for non-empty sets."""
    starts = np.cumsum([0] + [len(x) for x in sets[:-1]])
    h = mixed(np.concatenate(sets))
    out = np.empty((len(sets), coords), np.uint32)
    for k, a in enumerate(multipliers(coords)):
        out[:, k] = np.minimum.reduceat(((h * a) >> np.uint64(32)).astype(np.uint32), starts)
    return out


def signed(docs: DataFrame, coords: int = COORDS) -> DataFrame:
    """doc_id, n_shingles, digest of the set, signature (null without words)."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for part in parts:
            texts, ids = raw(part.column("text")), part.column("doc_id")
            for a, z in by_bytes(texts, 1_000_000):
                sets = [shingle_hashes(x.translate(LOWER).split(), hashes) for x in texts[a:z]]
                full = [x for x in sets if len(x)]
                sigs = iter(signatures(full, coords) if full else ())
                digests = [hashlib.blake2b(x.tobytes(), digest_size=16).digest() if len(x) else None for x in sets]
                yield pa.RecordBatch.from_arrays([ids.slice(a, z - a), pa.array([len(x) for x in sets], pa.int64()), pa.array(digests, pa.binary()), pa.array([next(sigs).tobytes() if len(x) else None for x in sets], pa.binary())], schema=SIGNED)

    return docs.mapInArrow(run, "doc_id long, n_shingles long, digest binary, sig binary")


def posted(reps: DataFrame, coords: int, matches: int) -> DataFrame:
    """rep, n_shingles, sig, prefix, shared: the classes that could have a partner, a row for each. shared holds their
    rarest shared values as (freq, coord, value, mass), with the documents of the value and the shingles of these
    together; prefix holds, as one bit for each coordinate, where the class is posted."""
    values = pa.schema([("rep", pa.int64()), ("size", pa.int64()), ("coord", pa.int32()), ("value", pa.int64())])

    def spread(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            n = part.num_rows
            sig = np.frombuffer(b"".join(part.column("sig").to_pylist()), np.uint32)
            yield pa.RecordBatch.from_arrays([*(pa.array(np.repeat(part.column(k).to_numpy(), coords)) for k in ("rep", "n_shingles")), pa.array(np.tile(np.arange(coords, dtype=np.int32), n)), pa.array(sig.astype(np.int64))], schema=values)

    each = reps.select("rep", "n_shingles", "sig").mapInArrow(spread, "rep long, size long, coord int, value long")
    # as a table of its own, so that AQE can split a value that very many documents have
    freq = written(each.groupBy("coord", "value").agg(F.count("*").alias("freq"), F.sum("size").alias("mass")).filter("freq > 1"), "frequencies")
    shared = each.join(freq, ["coord", "value"]).groupBy("rep").agg(F.sort_array(F.collect_list(F.struct("freq", "coord", "value", "mass"))).alias("shared"))
    able = shared.filter(F.size("shared") >= matches)
    # the values that only one document has come first in the order by frequency; these are posted nowhere
    able = able.withColumn("shared", F.slice("shared", F.lit(1), F.size("shared") - (matches - 1)))
    bit = lambda x: F.call_function("shiftleft", F.lit(1).cast("long"), x["coord"])
    able = able.withColumn("prefix", F.aggregate("shared", F.lit(0).cast("long"), lambda m, x: m.bitwiseOR(bit(x))))
    return able.join(reps, "rep").select("rep", "n_shingles", "sig", "prefix", "shared")


def members(posts: DataFrame, longer: int = 0) -> DataFrame:
    """A row for each document and list of more than `longer` documents; weight: the lengths of these lists of the
    document together."""
    wanted = F.filter("shared", lambda x: x["freq"] > longer)
    weighed = posts.withColumn("shared", wanted).withColumn("weight", F.aggregate("shared", F.lit(0).cast("long"), lambda n, x: n + x["freq"]))
    return weighed.select("*", F.explode("shared").alias("p")).drop("shared").select("*", "p.*").drop("p")


UNIT = ["coord", "value", "i", "j"]


def list_blocks(rows: DataFrame, block: int) -> DataFrame:
    """Every pair (i, j) of blocks of a list becomes a unit of comparison; short lists have one block."""
    sized = rows.withColumn("blocks", F.ceil(F.greatest(F.col("freq") / block, F.col("mass") / (block * ORDINARY))).cast("int"))
    own = F.when(F.col("blocks") > 1, F.pmod(F.xxhash64("rep"), F.col("blocks"))).otherwise(F.lit(0)).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    both = sized.withColumn("own", own).select("*", other)
    return both.withColumn("i", F.least("own", "other")).withColumn("j", F.greatest("own", "other"))


def units(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of each unit of comparison as one table, from rows sorted by unit."""
    held: list[pa.Table] = []
    for part in parts:
        if not part.num_rows:
            continue
        table = pa.Table.from_batches([part])
        keys = np.stack([part.column(k).to_numpy().astype(np.int64) for k in UNIT])
        cuts = [0, *(np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1).tolist(), part.num_rows]
        if held and any(held[-1].column(k)[-1].as_py() != keys[n, 0] for n, k in enumerate(UNIT)):
            yield pa.concat_tables(held).combine_chunks()
            held = []
        for p, q in zip(cuts, cuts[1:], strict=False):
            held.append(table.slice(p, q - p))
            if q < part.num_rows:
                yield pa.concat_tables(held).combine_chunks()
                held = []
    if held:
        yield pa.concat_tables(held).combine_chunks()


class Unit:
    """The documents of one unit, ordered by block and id; `comp` may be relabelled while they are compared."""

    def __init__(self, table: pa.Table, coords: int, matches: int, threshold: int):
        self.matches, self.threshold = matches, threshold
        rep, own = (table.column(k).to_numpy() for k in ("rep", "own"))
        self.order = np.lexsort((rep, own))
        self.rep, own = rep[self.order], own[self.order]
        self.comp, self.size = (table.column(k).to_numpy()[self.order] for k in ("comp", "n_shingles"))
        self.sig = np.frombuffer(b"".join(table.column("sig").to_pylist()), np.uint32).reshape(-1, coords)[self.order]
        prefix = table.column("prefix").to_numpy().view(np.uint64)[self.order]
        self.bits = ((prefix[:, None] >> np.arange(coords, dtype=np.uint64)) & np.uint64(1)).astype(bool)
        self.coord, i, j = (table.column(k)[0].as_py() for k in ("coord", "i", "j"))
        self.second = int(np.searchsorted(own, j)) if i != j else None

    def partners(self) -> Iterator[tuple[int, np.ndarray]]:
        """Each document with those after it (or in the other block) of other components that collide with it often
        enough, are not too large or small, and meet it here first."""
        for k in range(len(self.rep) - 1 if self.second is None else self.second):
            start = k + 1 if self.second is None else self.second
            size, rest = self.size[k], slice(start, None)
            fit = (self.comp[rest] != self.comp[k]) & (100 * np.minimum(self.size[rest], size) >= self.threshold * np.maximum(self.size[rest], size))
            at = np.flatnonzero(fit) + start
            if not len(at):
                continue
            same = self.sig[at] == self.sig[k]
            enough = same.sum(axis=1) >= self.matches
            at, same = at[enough], same[enough]
            at = at[(same & self.bits[at] & self.bits[k]).argmax(axis=1) == self.coord]
            if len(at):
                yield k, at


def meeting(posts: DataFrame, coords: int, matches: int, block: int, threshold: int) -> DataFrame:
    """The units of comparison with the documents that have a partner there, a row for each, by block and id. `among`
    marks each one's partners, a bit for each row of the unit; `n` is the number of these rows."""
    out = pa.schema([*((k, pa.int32() if k in ("coord", "i", "j") else pa.int64()) for k in UNIT), ("own", pa.int32()), ("rep", pa.int64()), ("comp", pa.int64()), ("n_shingles", pa.int64()), ("among", pa.binary()), ("n", pa.int32())])

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in units(parts):
            if len(table) > 1:
                unit = Unit(table, coords, matches, threshold)
                meets = np.zeros((len(table), len(table)), bool)
                for k, at in unit.partners():
                    meets[k, at] = True
                kept = np.flatnonzero(meets.any(axis=0) | meets.any(axis=1))
                if len(kept):
                    marks = np.packbits(meets[np.ix_(kept, kept)], axis=1)
                    rows = table.take(pa.array(unit.order[kept])).combine_chunks()
                    columns = {k: rows.column(k) for k in (*UNIT, "own", "rep", "comp", "n_shingles")} | {"among": [x.tobytes() for x in marks], "n": np.full(len(kept), len(kept))}
                    yield pa.RecordBatch.from_arrays([pa.array(x, f.type) if isinstance(x, (list, np.ndarray)) else x.combine_chunks().cast(f.type) for x, f in zip(columns.values(), out, strict=True)], schema=out)

    dealt = list_blocks(members(posts), block).select(*UNIT, "own", "rep", "comp", "n_shingles", "sig", "prefix")
    return dealt.repartition(*UNIT).sortWithinPartitions(*UNIT).mapInArrow(run, "coord int, value long, i int, j int, own int, rep long, comp long, n_shingles long, among binary, n int")


def similar(one: np.ndarray, others: list[np.ndarray], marks: np.ndarray, threshold: int) -> Iterator[int]:
    """Which of the sets share enough with `one`. Marks give an upper bound for all at once; sets that pass it are
    intersected. `marks` is all zero before and after."""
    own = one & np.uint64(MARKS - 1)
    marks[own] = 1
    sizes = np.fromiter(map(len, others), np.int64, len(others))
    most = np.add.reduceat(marks[np.concatenate(others) & np.uint64(MARKS - 1)], np.cumsum(sizes) - sizes)
    marks[own] = 0
    for n in np.flatnonzero(100 * most >= threshold * (len(one) + sizes - most)).tolist():
        both = len(np.intersect1d(one, others[n], assume_unique=True))
        if 100 * both >= threshold * (len(one) + len(others[n]) - both):
            yield n


def met(posts: DataFrame, sets: DataFrame, coords: int, matches: int, block: int, threshold: int) -> DataFrame:
    """a, b: the links between documents that meet in a list, of each unit a spanning forest. Signatures are compared once, in
    `meeting`; sets are compared along its marks."""
    out = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marks = np.zeros(MARKS, np.int64)
        for table in units(parts):
            rep, own, comp = (table.column(k).to_numpy() for k in ("rep", "own", "comp"))
            order = np.lexsort((rep, own))
            rep, comp, n = rep[order], comp[order].copy(), table.column("n")[0].as_py()
            if len(rep) != n:
                raise ValueError(f"{len(rep)} of the {n} documents of a unit have sets")
            meets = np.unpackbits(np.frombuffer(b"".join(table.column("among").to_pylist()), np.uint8).reshape(n, -1)[order], axis=1, count=n).astype(bool)
            column = table.column("shingles")
            sets_ = [np.frombuffer(column[x].as_py(), np.uint64) for x in order.tolist()]
            a, b = [], []
            for k in range(n):
                at = np.flatnonzero(meets[k] & (comp != comp[k]))
                if not len(at):
                    continue
                for x in similar(sets_[k], [sets_[m] for m in at.tolist()], marks, threshold):
                    m = at[x]
                    if comp[m] != comp[k]:
                        comp[comp == comp[m]] = comp[k]
                        a.append(min(rep[k], rep[m]))
                        b.append(max(rep[k], rep[m]))
            if a:
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], schema=out)

    held = meeting(posts, coords, matches, block, threshold).join(sets.select(F.col("doc_id").alias("rep"), "shingles"), "rep")
    return held.repartition(*UNIT).sortWithinPartitions(*UNIT).mapInArrow(run, "a long, b long")


def hub_pairs(posts: DataFrame, matches: int, coords: int, long_list: int) -> DataFrame:
    """u, a, b: each member of a long list with the list's most central open member, if they collide enough.
    Central: the largest sum of the frequencies of its posted values."""
    long = members(posts, long_list)
    central = F.max(F.struct("weight", (-F.col("rep")).alias("neg"), "sig", "comp")).alias("hub")
    hubs = long.filter("open").groupBy("coord", "value").agg(central)
    hubs = hubs.select("coord", "value", (-F.col("hub.neg")).alias("hub"), F.col("hub.sig").alias("hub_sig"), F.col("hub.comp").alias("hub_comp"))
    pairs = long.join(hubs, ["coord", "value"]).filter("comp <> hub_comp")
    out = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            s, h = (np.frombuffer(b"".join(part.column(k).to_pylist()), np.uint32).reshape(-1, coords) for k in ("sig", "hub_sig"))
            good = (s == h).sum(axis=1) >= matches
            x, y = part.column("rep").to_numpy()[good], part.column("hub").to_numpy()[good]
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y))], schema=out)

    found = pairs.select("rep", "sig", "hub", "hub_sig").mapInArrow(run, "a long, b long").distinct()
    return found.select(F.xxhash64("a", "b").alias("u"), "a", "b")


def shingle_sets(docs: DataFrame, wanted: DataFrame, broadcast_ids: int = 1_000_000) -> DataFrame:
    """doc_id, shingles (sorted 64-bit hashes) of the wanted ids, whose texts have words, one row of each; few
    enough ids (8 bytes each) are broadcast."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for part in parts:
            texts, ids = raw(part.column("text")), part.column("doc_id")
            for a, z in by_bytes(texts, 1_000_000):
                sets = [shingle_hashes(x.translate(LOWER).split(), hashes) for x in texts[a:z]]
                yield pa.RecordBatch.from_arrays([ids.slice(a, z - a), pa.array([x.tobytes() for x in sets], pa.binary())], schema=SETS)

    ids = F.broadcast(wanted) if wanted.count() <= broadcast_ids else wanted
    rows = docs.join(ids, "doc_id", "left_semi").mapInArrow(run, "doc_id long, shingles binary")
    return rows.groupBy("doc_id").agg(F.min("shingles").alias("shingles"))


def confirmed(pairs: DataFrame, sets: DataFrame, threshold: int, unit_pairs: int = 256) -> DataFrame:
    """a, b of the pairs (one a member of a long list) whose sets are similar enough; of each unit of pairs a spanning
    forest is enough.

    Pairs are dealt to units of about `unit_pairs` pairs; a unit holds the sets of its own documents only."""
    n_units = max(1, -(-pairs.count() // unit_pairs))
    dealt = pairs.select(F.pmod("u", F.lit(n_units)).alias("unit"), "a", "b")
    need = dealt.select(F.col("unit").alias("own"), F.explode(F.array("a", "b")).alias("doc_id")).distinct().join(sets.select("doc_id", "shingles"), "doc_id")
    out = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        own = {k: np.frombuffer(s, np.uint64) for k, s in zip(right.column("doc_id").to_pylist(), right.column("shingles").to_pylist(), strict=True)}
        up: dict[int, int] = {}

        def top(x: int) -> int:
            while up.get(x, x) != x:
                up[x] = up.get(up[x], up[x])
                x = up[x]
            return x

        a, b = [], []
        for x, y in sorted(zip(left.column("a").to_pylist(), left.column("b").to_pylist(), strict=True)):
            p, q = top(x), top(y)
            if p == q:
                continue
            both = len(np.intersect1d(own[x], own[y], assume_unique=True))
            if 100 * both >= threshold * (len(own[x]) + len(own[y]) - both):
                up[max(p, q)] = min(p, q)
                a.append(x)
                b.append(y)
        return pa.Table.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], schema=out)

    return dealt.groupBy("unit").cogroup(need.groupBy("own")).applyInArrow(run, "a long, b long")


def components(links: DataFrame) -> DataFrame:
    """node, comp (smallest id reachable) of all ids in the links (a, b)."""
    edges = written(links.select(F.col("a").alias("x"), F.col("b").alias("y")).union(links.select("b", "a")).distinct(), "edges")
    labels = written(edges.groupBy("x").agg(F.min("y").alias("m")).select(F.col("x").alias("node"), F.least("x", "m").alias("comp")), "labels")
    while True:
        near = edges.join(labels.select(F.col("node").alias("y"), F.col("comp").alias("other")), "y").groupBy("x").agg(F.min("other").alias("near"))
        step = labels.join(near, labels["node"] == near["x"]).select("node", "comp", F.least("comp", "near").alias("to"))
        far = labels.select(F.col("node").alias("to"), F.col("comp").alias("far"))
        new = written(step.join(far, "to").select("node", F.col("comp").alias("old"), F.least("to", "far").alias("comp")), "labels")
        labels = new.select("node", "comp")
        if not new.filter("old <> comp").limit(1).count():
            return labels


def near_duplicates(docs: DataFrame, threshold: int = 85, coords: int = COORDS, matches: int | None = None, block: int = 512, long_list: int = 512, hub_rounds: int = 2) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every document. Without `matches`, it follows from the threshold."""
    matches = least_matches(threshold, coords) if matches is None else matches
    slim = id_text(docs)
    every = written(signed(slim, coords), "signatures")
    linked = every.filter("digest is not null and doc_id is not null")
    smallest = F.min(F.struct("doc_id", "sig")).alias("m")
    classes = linked.groupBy("digest", "n_shingles").agg(smallest).select("digest", "n_shingles", F.col("m.doc_id").alias("rep"), F.col("m.sig").alias("sig"))
    classes = written(classes, "classes")
    posts = written(posted(classes.select("rep", "n_shingles", "sig"), coords, matches), "posts")
    sets = written(shingle_sets(slim, posts.select(F.col("rep").alias("doc_id"))), "sets")
    rounds = hub_rounds if posts.filter(F.exists("shared", lambda x: x["freq"] > long_list)).limit(1).count() else 0
    links = comps = None
    for k in range(rounds + 1):
        now = posts.withColumn("comp", F.col("rep")).withColumn("open", F.lit(True))
        if comps is not None:
            now = posts.join(comps, posts["rep"] == comps["node"], "left").withColumn("open", F.col("node").isNull()).withColumn("comp", F.coalesce("comp", "rep")).drop("node")
        if k < rounds:
            found = confirmed(written(hub_pairs(now, matches, coords, long_list), "pairs"), sets, threshold)
        else:
            found = met(now, sets, coords, matches, block, threshold)
        more = written(found, "links")
        links = more if links is None else links.unionByName(more)
        comps = components(links)
    # what has no words or no id links with nothing and meets nothing in a join
    alone = every.filter("digest is null or doc_id is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"), F.lit(True).alias("kept"))
    rows = linked.join(classes.select("digest", "n_shingles", "rep"), ["digest", "n_shingles"])
    rows = rows.join(comps, rows["rep"] == comps["node"], "left")
    comp = F.coalesce("comp", "rep")
    return rows.select("doc_id", "n_shingles", comp.alias("component_id"), (F.col("doc_id") == comp).alias("kept")).unionByName(alone)


def without_near_duplicates(docs: DataFrame, threshold: int = 80, **options) -> DataFrame:
    """The documents with all their columns, one of each component kept: that with the smallest id."""
    gone = near_duplicates(docs, threshold, **options).filter("not kept").select(F.col("doc_id").alias("_gone")).distinct()
    return docs.join(gone, docs["doc_id"].cast("long") == gone["_gone"], "left_anti")


def oracle_sql(threshold: int = 85) -> str:
    """The same rows in SQL by counting shared shingles of all pairs."""
    return f"""
with recursive w as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') as ws from documents
), s as (
  select distinct doc_id, md5(array_to_string(ws[i : i + 4], ' ')) as h
  from (select doc_id, ws, unnest(range(1, greatest(1, len(ws) - 4) + 1)) as i from w where len(ws) > 0)
), n as (select doc_id, count(*) as n from s group by doc_id),
p as (select a.doc_id as x, b.doc_id as y, count(*) as n_both from s a join s b on a.h = b.h and a.doc_id < b.doc_id group by 1, 2),
e as (select x, y from p join n a on a.doc_id = x join n b on b.doc_id = y where 100 * n_both >= {threshold} * (a.n + b.n - n_both)),
u as (select x, y from e union select y, x from e),
r as (select doc_id as node, doc_id as comp from w union select u.y, r.comp from r join u on u.x = r.node where r.comp < u.y),
c as (select node, min(comp) as comp from r group by node)
select w.doc_id, cast(coalesce(n.n, 0) as bigint) as n_shingles, c.comp as component_id, w.doc_id = c.comp as kept
from w left join n on n.doc_id = w.doc_id join c on c.node = w.doc_id"""
