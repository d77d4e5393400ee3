"""Bounded-space online packing of documents into windows of a fixed number of tokens.

Each partition reads its documents once. Whole windows are cut off a long document; its rest (or a short
document) goes to the open window where it fits best, that is, leaves least room. When it fits in none of
the `open_windows` windows, its head fills the fullest, which is emitted, and its tail is placed again. So a task
holds a fixed number of windows, whatever the partition holds, and emits full ones alone. Windows that are still
open at the end are merged, a bounded group of them at a time and in rounds, by the same best-fit rule over whole
windows; then the pieces that are left are cut at window ends, so that in every round all sequences of a group but
one end full, and the last round leaves at most one sequence of all that is not. Open pieces carry their ids for that.

Sequence ids are unique, not dense. A null text is an empty document: its end id alone is packed. Repeated
rows and equal ids are packed each on their own; a null id stays null; an empty table gives no pieces.
"""

from __future__ import annotations

import zlib
from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from phantomlake.llm.common import id_text, written
from phantomlake.llm.tokens import ChunkEncoder, grouped, texts_of

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
FIELDS = [(x.split()[0], pa.int64()) for x in PIECES.split(", ")]
#: Placed pieces also say which partition they come from and whether their window is still open; then they have their ids.
PLACED = pa.schema([*FIELDS, ("ids", pa.binary()), ("part", pa.int64()), ("open", pa.bool_())])
#: Sequence ids: the partition above, a counter of the partition below.
SHIFT = 32


class Windows:
    """The open windows of one partition: id -> [tokens, pieces]."""

    def __init__(self, size: int, most: int, first_id: int):
        self.size, self.most, self.next_id = size, most, first_id
        self.open: dict[int, list] = {}

    def new_id(self) -> int:
        self.next_id += 1
        return self.next_id - 1

    def fitting(self, length: int) -> int | None:
        """The window where a piece leaves least room, if it fits in one."""
        best, room = None, self.size + 1
        for k, used in self.open.items():
            left = self.size - used - length
            if 0 <= left < room:
                best, room = k, left
                if not left:
                    break
        return best

    def place(self, length: int) -> tuple[list[tuple[int, int, int]], list[int]]:
        """(window, offset, length) of the parts of a piece, in order, and the windows that are full by them."""
        parts: list[tuple[int, int, int]] = []
        done: list[int] = []
        best = self.fitting(length)
        if best is None and len(self.open) >= self.most:
            fullest = max(self.open, key=lambda k: (self.open[k], -k))
            at = self.open.pop(fullest)
            parts.append((fullest, at, self.size - at))
            done.append(fullest)
            length -= self.size - at
            best = self.fitting(length)
        if best is None:
            best = self.new_id()
            self.open[best] = 0
        at = self.open[best]
        parts.append((best, at, length))
        self.open[best] = at + length
        if self.open[best] == self.size:
            del self.open[best]
            done.append(best)
        return parts, done


def placed(docs: DataFrame, tokenizer: str, size: int, end_id: int, open_windows: int) -> DataFrame:
    """The pieces of every document with their window, as each partition packs them."""
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part_id = ChunkEncoder.of(tokenizer), TaskContext.get().partitionId()
        windows = Windows(size, open_windows, part_id << SHIFT)
        waiting: dict[int, list[tuple]] = {}  # pieces of the open windows

        def table(rows: list[tuple], is_open: bool) -> pa.RecordBatch:
            columns = list(zip(*rows, strict=True)) or [()] * (len(FIELDS) + 1)
            arrays = [pa.array(x, pa.int64()) for x in columns[:-1]]
            ids = pa.array(columns[-1], pa.binary()) if is_open else pa.nulls(len(rows), pa.binary())
            return pa.RecordBatch.from_arrays([*arrays, ids, pa.array([part_id] * len(rows), pa.int64()), pa.array([is_open] * len(rows), pa.bool_())], schema=PLACED)

        for batch in grouped(parts):
            tokens, begins = encoder.encode(texts_of(batch), end_id)
            at_ = begins.tolist()
            rows: list[tuple] = []
            for doc_id, a, z in zip(batch.column("doc_id").to_pylist(), at_, at_[1:], strict=False):
                n = z - a
                for start in range(0, n, size):
                    length = min(size, n - start)
                    if length == size:
                        rows.append((doc_id, start, length, zlib.crc32(tokens[a + start : a + start + length]), n, windows.new_id(), 0, None))
                        continue
                    parts_, done = windows.place(length)
                    for window, at, some in parts_:
                        own = tokens[a + start : a + start + some].tobytes()
                        waiting.setdefault(window, []).append((doc_id, start, some, zlib.crc32(own), n, window, at, own))
                        start += some
                    for k in done:
                        rows += waiting.pop(k)
            yield table(rows, False)
        yield table([x for xs in waiting.values() for x in xs], True)

    return id_text(docs).mapInArrow(run, PIECES + ", ids binary, part long, open boolean")


def filled(rows: list[dict], size: int) -> list[dict]:
    """The pieces with the emptiest windows cut to fill the fullest; the one window that is not full is open."""
    windows: dict[int, list[dict]] = {}
    for x in sorted(rows, key=lambda x: x["offset"]):
        windows.setdefault(x["sequence_id"], []).append(x)
    fill = {k: sum(x["length"] for x in xs) for k, xs in windows.items()}
    left = deque(sorted((k for k in windows if fill[k] < size), key=lambda k: (-fill[k], k)))
    while len(left) > 1:
        to, source = left[0], left[-1]
        x, room = windows[source].pop(), size - fill[to]
        some = min(room, x["length"])
        if some < x["length"]:
            ids = x["ids"][4 * some :]
            windows[source].append(x | {"start": x["start"] + some, "length": x["length"] - some, "ids": ids, "ids_crc32": zlib.crc32(ids)})
            x = x | {"length": some, "ids": x["ids"][: 4 * some], "ids_crc32": zlib.crc32(x["ids"][: 4 * some])}
        windows[to].append(x | {"sequence_id": to, "offset": fill[to]})
        fill[to], fill[source] = fill[to] + some, fill[source] - some
        if fill[to] == size:
            left.popleft()
        if not fill[source]:
            left.pop()
    for k, xs in windows.items():
        for x in xs:
            x["open"] = fill[k] < size
            if not x["open"]:
                x["ids"] = None
    return [x for xs in windows.values() for x in xs]


def merged(open_pieces: DataFrame, size: int, group: int) -> DataFrame:
    """Moves whole open windows of `group` neighbouring partitions together, best fit, largest first, and cuts the
    rest at window ends: at most one window of the group stays open."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        lengths: dict[int, int] = {}
        for x in rows:
            lengths[x["sequence_id"]] = lengths.get(x["sequence_id"], 0) + x["length"]
        to: dict[int, tuple[int, int]] = {}
        room: dict[int, int] = {}
        for k in sorted(lengths, key=lambda k: (-lengths[k], k)):
            fits = [(left - lengths[k], w) for w, left in room.items() if left >= lengths[k]]
            if fits:
                left, w = min(fits)
                to[k] = (w, size - room[w])
                room[w] = left
                if not left:
                    del room[w]
            else:
                to[k] = (k, 0)
                if lengths[k] < size:
                    room[k] = size - lengths[k]
        for x in rows:
            w, at = to[x["sequence_id"]]
            x["sequence_id"], x["offset"] = w, x["offset"] + at
            x["part"] = key[0].as_py()
        rows = filled(rows, size)
        return pa.Table.from_pylist(rows, schema=PLACED)

    regrouped = open_pieces.withColumn("part", F.floor(F.col("part") / group))
    return regrouped.groupBy("part").applyInArrow(run, PIECES + ", ids binary, part long, open boolean")


def pack(docs: DataFrame, tokenizer: str, size: int = 1024, end_id: int = 0, open_windows: int = 64, group: int = 16) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A task of the merge holds at most `group` x `open_windows` windows in the first round and `group` in the others.
    """
    pieces = written(placed(docs, tokenizer, size, end_id, open_windows), "pieces")
    columns = [x for x, _ in FIELDS]
    left = pieces.filter("open")
    parts = (left.agg(F.max("part")).first()[0] or 0) + 1
    closed = pieces.filter("not open").select(columns)
    while True:
        left = written(merged(left, size, group), "merged")
        parts = -(-parts // group)
        if parts <= 1:
            return closed.unionByName(left.select(columns))
        closed = closed.unionByName(left.filter("not open").select(columns))
        left = left.filter("open")
