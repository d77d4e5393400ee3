"""Token-id shards with a minimal perfect hash index.

Layout of one shard file (little-endian), written in ascending key order:

    magic "TOKSHRD2", n_keys u32, n_records u32, n_buckets u32, end id u32, bytes of an id u32 (2 or 4)
    seeds        n_buckets x u32      displacement of each bucket of the hash
    fingerprints n_keys x u32         check of the key that owns a slot
    slots        n_keys x (first record u32, records u32)
    records      n_records x (key i64, has key u8, payload offset u64, ids u64)
    payload      ids, u16 each where the vocabulary allows it, else u32

`find` hashes a key to its slot, compares the fingerprint, and reads the slot's records and their payload: a few
small ranged reads, whatever the shard holds. Reading all documents back goes through the same index; only records
without a key are read in file order. Documents are dealt to shards by ranges of their key, so ids lie in ascending
key order over all shards, and a shard holds at most `shard_ids` ids unless one document has more.

Equal keys lie next to each other; many of them may reach over several shards, and a lookup finds them in all. A null
key sorts first and is kept, but no key finds it. Null and empty texts have the end id alone. An empty table writes
no shard and is read back as no rows.
Files go through pyarrow's file systems (local, S3, GCS, HDFS); a repeated task writes the same bytes under
the same name after writing them elsewhere, so a lost executor leaves no half file behind.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable, Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from phantomlake.llm.common import id_text, make_folder
from phantomlake.llm.tokens import ChunkEncoder, grouped, spans, texts_of

MAGIC = b"TOKSHRD2"
HEAD = struct.Struct("<8sIIIII")
RECORD = np.dtype([("key", "<i8"), ("has", "u1"), ("offset", "<u8"), ("n", "<u8")])
SLOT = np.dtype([("first", "<u4"), ("n", "<u4")])
BUCKET = 4  # keys a bucket has on average


def scrambled(keys: np.ndarray, seed: np.ndarray | int) -> np.ndarray:
    """64-bit hash of int64 keys under a seed."""
    with np.errstate(over="ignore"):
        x = keys.astype(np.int64).view(np.uint64) + np.asarray(seed, np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


BUCKET_SEED, PRINT_SEED = 0xFFFF0001, 0xFFFF0002


def bucket_of(keys: np.ndarray, n_buckets: int) -> np.ndarray:
    return (scrambled(keys, BUCKET_SEED) % np.uint64(n_buckets)).astype(np.int64)


def slot_of(keys: np.ndarray, seeds: np.ndarray, n_keys: int) -> np.ndarray:
    return (scrambled(keys, seeds) % np.uint64(n_keys)).astype(np.int64)


def print_of(keys: np.ndarray) -> np.ndarray:
    return (scrambled(keys, PRINT_SEED) >> np.uint64(32)).astype(np.uint32)


def perfect_hash(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(seeds of the buckets, slot of each key) for distinct int64 keys: buckets, largest first, take the
    first seed that sends all their keys to free slots."""
    n = len(keys)
    n_buckets = max(1, -(-n // BUCKET))
    seeds, slots, free = np.zeros(n_buckets, np.uint32), np.zeros(n, np.int64), np.ones(n, bool)
    if not n:
        return seeds, slots
    bucket = bucket_of(keys, n_buckets)
    order = np.argsort(bucket, kind="stable")
    starts = np.searchsorted(bucket[order], np.arange(n_buckets + 1))
    trial = 64
    for b in np.argsort(-(starts[1:] - starts[:-1]), kind="stable"):
        own = order[starts[b] : starts[b + 1]]
        if not len(own):
            break
        base = 0
        while True:
            at = slot_of(keys[own][None, :], np.arange(base, base + trial)[:, None], n)
            good = free[at].all(axis=1)
            if len(own) > 1:
                s = np.sort(at, axis=1)
                good &= (s[:, 1:] != s[:, :-1]).all(axis=1)
            if good.any():
                k = int(good.argmax())
                seeds[b], slots[own] = base + k, at[k]
                free[at[k]] = False
                break
            base += trial
    return seeds, slots


def shard_bytes(keys: list[int | None], ids: list[bytes], end_id: int, width: int = 4) -> bytes:
    """One shard file; keys ascend (nulls first), ids are little-endian bytes of the given width."""
    sizes = np.array([len(x) // width for x in ids], np.uint64)
    records = np.zeros(len(keys), RECORD)
    records["key"], records["has"] = [k or 0 for k in keys], [k is not None for k in keys]
    records["n"], records["offset"] = sizes, np.concatenate([[0], np.cumsum(sizes)[:-1]]) if len(keys) else []
    real = np.flatnonzero(records["has"])
    distinct, first, counts = np.unique(records["key"][real], return_index=True, return_counts=True)
    seeds, slots = perfect_hash(distinct)
    prints, table = np.zeros(len(distinct), np.uint32), np.zeros(len(distinct), SLOT)
    prints[slots] = print_of(distinct)
    table["first"][slots], table["n"][slots] = (real[first] if len(real) else first), counts
    head = HEAD.pack(MAGIC, len(distinct), len(keys), len(seeds), end_id, width)
    return b"".join([head, seeds.tobytes(), prints.astype("<u4").tobytes(), table.tobytes(), records.tobytes(), *ids])


class Shard:
    """A shard read by `read(offset, size)`, from memory or from a file; only its head is read at once."""

    def __init__(self, read: Callable[[int, int], bytes | memoryview]):
        self.read = read
        magic, self.n_keys, self.n_records, self.n_buckets, self.end_id, self.width = HEAD.unpack(read(0, HEAD.size))
        if magic != MAGIC:
            raise ValueError("not a token shard")
        sizes = (4 * self.n_buckets, 4 * self.n_keys, SLOT.itemsize * self.n_keys, RECORD.itemsize * self.n_records)
        self.seeds_at, self.prints_at, self.slots_at, self.records_at, self.payload_at = accumulate(sizes, initial=HEAD.size)

    @classmethod
    def of(cls, data: bytes | memoryview) -> Shard:
        view = memoryview(data)
        return cls(lambda at, size: view[at : at + size])

    def part(self, kind: np.dtype | str, at: int, first: int, n: int) -> np.ndarray:
        """n entries of a section, from the first on."""
        size = np.dtype(kind).itemsize
        return np.frombuffer(self.read(at + size * first, size * n), kind, n)

    def ids(self, record: np.void) -> np.ndarray:
        return self.part(f"<u{self.width}", self.payload_at, int(record["offset"]), int(record["n"])).astype("<u4")

    def find(self, key: int) -> list[np.ndarray]:
        """The ids of every record of the key; [] if the shard has none."""
        if not self.n_keys:
            return []
        k = np.array([key], np.int64)
        seed = self.part("<u4", self.seeds_at, int(bucket_of(k, self.n_buckets)[0]), 1)
        slot = int(slot_of(k, seed, self.n_keys)[0])
        if self.part("<u4", self.prints_at, slot, 1)[0] != print_of(k)[0]:
            return []
        first, n = self.part(SLOT, self.slots_at, slot, 1)[0].tolist()
        records = self.part(RECORD, self.records_at, first, n)
        return [self.ids(r) for r in records] if int(records[0]["key"]) == key else []

    def all(self) -> np.ndarray:
        """All records, in order; those of each key as the index gives them."""
        records = self.part(RECORD, self.records_at, 0, self.n_records)
        keys = np.unique(records["key"][records["has"] == 1])
        seeds, prints = self.part("<u4", self.seeds_at, 0, self.n_buckets), self.part("<u4", self.prints_at, 0, self.n_keys)
        slots = slot_of(keys, seeds[bucket_of(keys, self.n_buckets)], self.n_keys) if len(keys) else np.zeros(0, np.int64)
        own = self.part(SLOT, self.slots_at, 0, self.n_keys)[slots]
        found = records[spans(own["first"].astype(np.int64), own["n"].astype(np.int64))]
        if len(keys) != self.n_keys or (prints[slots] != print_of(keys)).any() or (found["key"] != np.repeat(keys, own["n"])).any():
            raise ValueError("the index of a token shard is damaged")
        return np.concatenate([records[records["has"] == 0], found])


def write_shards(docs: DataFrame, path: str, tokenizer: str, end_id: int = 1, shard_ids: int = 2_000_000, partitions: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encodes the documents and writes the shards; returns the manifest (shard, n_docs, n_ids, min_key, max_key)."""
    spark = docs.sparkSession
    make_folder(spark, path)
    manifest = pa.schema([("part", pa.int64()), ("k", pa.int64()), ("n_docs", pa.int64()), ("n_ids", pa.int64()), ("min_key", pa.int64()), ("max_key", pa.int64())])

    def write(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context, encoder = TaskContext.get(), ChunkEncoder.of(tokenizer)
        width = 2 if max(encoder.tokenizer.get_vocab_size(), end_id + 1) <= 1 << 16 else 4
        fs, top = pafs.FileSystem.from_uri(path)
        keys: list[int | None] = []
        ids: list[bytes] = []
        held = done = 0

        def flush() -> pa.RecordBatch:
            nonlocal held, done
            name = f"{top}/shard-{context.partitionId():06d}-{done:06d}"
            own = f"{top}/_attempt-{context.taskAttemptId()}-{done}"
            with fs.open_output_stream(own) as out:
                out.write(shard_bytes(keys, ids, end_id, width))
            fs.move(own, f"{name}.tok")
            real = [k for k in keys if k is not None]
            row = [context.partitionId(), done, len(keys), held, real[0] if real else None, real[-1] if real else None]
            keys.clear()
            ids.clear()
            held, done = 0, done + 1
            return pa.RecordBatch.from_arrays([pa.array([x], pa.int64()) for x in row], schema=manifest)

        for table in grouped(parts):
            tokens, begins = encoder.encode(texts_of(table), end_id)
            payload, at = tokens.astype(f"<u{width}").tobytes(), (begins * width).tolist()
            for key, a, z in zip(table.column("doc_id").to_pylist(), at, at[1:], strict=False):
                if keys and held + (z - a) // width > shard_ids:
                    yield flush()
                keys.append(key)
                ids.append(payload[a:z])
                held += (z - a) // width
        if keys:
            yield flush()

    # texts are dealt to ranges before they are encoded: text is smaller than ids; rows with one key may fill several ranges
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    by = (F.col("doc_id").asc_nulls_first(), F.col("row").asc())
    rows = id_text(docs, id_col, text_col).withColumn("row", F.xxhash64(F.monotonically_increasing_id()))
    ordered = rows.repartitionByRange(n, *by).sortWithinPartitions(*by).select("doc_id", "text")
    return ordered.mapInArrow(write, "part long, k long, n_docs long, n_ids long, min_key long, max_key long")


def with_starts(manifest: DataFrame, block: int = 256) -> DataFrame:
    """Adds `start`, the ids of all shards before, by sums of blocks of partitions and then within a block."""
    each = manifest.withColumn("block", F.floor(F.col("part") / block))
    blocks = each.groupBy("block").agg(F.sum("n_ids").alias("block_ids"))
    before = blocks.select("block", (F.sum("block_ids").over(Window.orderBy("block")) - F.col("block_ids")).alias("block_start"))
    inside = F.sum("n_ids").over(Window.partitionBy("block").orderBy("part", "k")) - F.col("n_ids")
    return each.withColumn("inside", inside).join(before, "block").withColumn("start", F.col("inside") + F.col("block_start")).drop("block", "inside", "block_start")


def read_shards(spark: SparkSession, path: str, manifest: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every record, from the files."""
    out = pa.schema([("part", pa.int64()), ("k", pa.int64()), ("doc_id", pa.int64()), ("before", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for name, content in zip(part.column("path").to_pylist(), part.column("content"), strict=True):
                shard = Shard.of(content.as_buffer())
                _, p, k = name.rpartition("/")[2].removesuffix(".tok").split("-")
                r = shard.all()
                n, crc = len(r), [zlib.crc32(shard.ids(x).tobytes()) for x in r]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([int(p)] * n, pa.int64()), pa.array([int(k)] * n, pa.int64()), pa.array(r["key"].astype(np.int64), mask=r["has"] == 0), pa.array(r["offset"].astype(np.int64)), pa.array(r["n"].astype(np.int64)), pa.array(crc, pa.int64())], schema=out
                )

    files = spark.read.format("binaryFile").option("pathGlobFilter", "shard-*.tok").load(path).select("path", "content")
    rows = files.mapInArrow(run, "part long, k long, doc_id long, before long, n_tokens long, ids_crc32 long")
    starts = with_starts(manifest).select("part", "k", "start")
    return rows.join(starts, ["part", "k"]).select("doc_id", (F.col("start") + F.col("before")).alias("start"), "n_tokens", "ids_crc32")


def lookup(spark: SparkSession, path: str, manifest: DataFrame, keys: DataFrame, key_col: str = "doc_id") -> DataFrame:
    """key, ids (array) of the wanted keys: each goes to the shards whose range holds it, which are opened once for all
    of theirs and read by ranges. Sent to the workers is the key range of each partition that wrote (16 bytes each)."""
    parts = manifest.groupBy("part").agg(F.min("min_key").alias("low"), F.max("max_key").alias("high")).filter("low is not null").orderBy("part").toArrow()
    number, low, high = (parts.column(k).to_numpy() for k in ("part", "low", "high"))
    sent = spark.sparkContext.broadcast((number, low, high))

    def ranged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, low, high = sent.value
        for batch in batches:
            key = batch.column("key").to_numpy()
            first, stop = np.searchsorted(high, key, "left"), np.searchsorted(low, key, "right")
            n = np.maximum(stop - first, 0)
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(key, n)), pa.array(number[spans(first, n)].astype(np.int64))], names=["key", "part"])

    out = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fs, top = pafs.FileSystem.from_uri(path)
            for p, k, wanted in zip(batch.column("part").to_pylist(), batch.column("k").to_pylist(), batch.column("wanted").to_pylist(), strict=True):
                with fs.open_input_file(f"{top}/shard-{p:06d}-{k:06d}.tok") as f:
                    shard = Shard(lambda at, size, f=f: f.read_at(size, at))
                    found = [(x, ids.astype(np.int64)) for x in wanted for ids in shard.find(x)]
                yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.int64()), pa.array([x for _, x in found], pa.list_(pa.int64()))], schema=out)

    wanted = keys.select(F.col(key_col).cast("long").alias("key")).filter(F.col("key").isNotNull()).distinct()
    shards = manifest.groupBy("part").agg(F.collect_list(F.struct("k", "min_key", "max_key")).alias("shards"))  # those of one task
    at = wanted.mapInArrow(ranged, "key long, part long").join(shards, "part")
    at = at.select("part", "key", F.explode(F.filter("shards", lambda x: F.col("key").between(x["min_key"], x["max_key"]))).alias("s"))
    return at.groupBy("part", F.col("s.k").alias("k")).agg(F.collect_list("key").alias("wanted")).mapInArrow(run, "doc_id long, ids array<long>")
