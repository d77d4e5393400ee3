"""What the operators share: shared storage, Arrow helpers and word hashes.

Texts cross to Python once, in Arrow batches; a null text counts as empty.
"""

from __future__ import annotations

import tempfile
import uuid
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A-Z to a-z; every other byte stays.
LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
UPPER_AZ, LOWER_AZ = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Rows of one Arrow batch; bounds what a Python worker holds at once.
BATCH_ROWS = 1000

#: What `new_path` has named in this process, for `tidy`.
_MADE: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share, from spark.checkpoint.dir.

    Only where all run on one machine (tests) a temporary folder is set for a session that has none.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        found = spark.sparkContext._jsc.sc().getCheckpointDir()
        if found.isDefined():
            return found.get().rsplit("/", 1)[0]
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.sparkContext.setCheckpointDir(path)
    return path


def new_path(spark: SparkSession, kind: str) -> str:
    """A path of its own in the shared folder; `tidy` removes what is written there."""
    _MADE.append(f"{shared_dir(spark).rstrip('/')}/{kind}-{uuid.uuid4().hex}")
    return _MADE[-1]


def tidy(spark: SparkSession) -> int:
    """Remove the intermediate tables that the operators of this process wrote, and return how many paths there were. To be
    called once the results are stored: those not yet computed still read these tables."""
    for path in _MADE:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    n = len(_MADE)
    _MADE.clear()
    return n


def exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def make_folder(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(at)


def written(df: DataFrame, kind: str) -> DataFrame:
    """df as a Parquet table in the shared folder: cuts the lineage and survives lost executors."""
    path = new_path(df.sparkSession, kind)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of at most BATCH_ROWS rows from now on in this session."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) not in range(1, BATCH_ROWS + 1):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def id_text(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the two columns that the text operators need, a null text as empty; other columns never clash."""
    small_batches(df.sparkSession)
    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def crc_mod(col: str, mod: int) -> Column:
    """crc32 of the column as text, modulo mod (null for null)."""
    return F.crc32(F.col(col).cast("string").cast("binary")) % mod


def is_fold(col: str, mod: int, rest: int) -> Column:
    """True where crc32(col as text) mod `mod` is `rest`; false for null."""
    return F.coalesce(crc_mod(col, mod) == rest, F.lit(False))


def lower_az(text: Column) -> Column:
    return F.translate(text, UPPER_AZ, LOWER_AZ)


def raw(column: pa.Array | pa.ChunkedArray) -> list[bytes]:
    """The UTF-8 bytes of each string, null as empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def crc_ids(ids: bytes) -> int:
    return zlib.crc32(ids)


class WordHashes(dict):
    """word -> 64-bit hash, equal on every machine; forgets all when it holds too many, and never keeps long words."""

    def __init__(self, most: int = 60_000, longest: int = 40):
        super().__init__()
        self.most, self.longest = most, longest

    def __missing__(self, word: bytes) -> int:
        if len(word) > self.longest:
            return xxhash.xxh3_64_intdigest(word)
        if len(self) >= self.most:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), dtype=np.uint64, count=len(words))


def mixed(x: np.ndarray) -> np.ndarray:
    """Each 64-bit value scrambled."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def windows_hash(h: np.ndarray, width: int) -> np.ndarray:
    """A hash of every `width` consecutive values."""
    n = len(h) - width + 1
    if n <= 0:
        return h[:0]
    out = h[:n].copy()
    for k in range(1, width):
        out = mixed(out) + h[k : k + n]
    return mixed(out)


def by_bytes(rows: Iterable[bytes], most: int = 4_000_000) -> Iterator[tuple[int, int]]:
    """(from, to) of consecutive rows holding about `most` bytes together; a longer row stands alone."""
    start, total, k = 0, 0, 0
    for k, x in enumerate(rows):
        if total and total + len(x) > most:
            yield start, k
            start, total = k, 0
        total += len(x)
        k += 1
    if k > start:
        yield start, k


def batches(columns: dict[str, list | np.ndarray], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], type=f.type) for f in schema], schema=schema)


def crc32_sql(text: str) -> str:
    """DuckDB SQL for the unsigned crc32 of an ASCII string: bit by bit, the lowest bit of each character first."""
    bits = f"flatten(list_transform(range(1, length({text}) + 1), lambda i: list_transform(range(0, 8), lambda k: ((ascii({text}[i]) >> k) & 1)::BIGINT)))"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {bits}), lambda c, b: CASE WHEN xor(c & 1, b) = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END), 4294967295)"
