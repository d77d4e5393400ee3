"""Token ids of whole texts by the tokenizers library, each distinct chunk of text encoded once per worker.

A text is cut before single spaces (or before white space in general, where runs of it occur). Neither of the two
kinds of tokenizer known here has a token that reaches over such a cut, so the ids of the chunks, one after another,
are the ids of the text; a tokenizer of another kind gets whole texts. Arrow looks the chunks of a batch up among
those that the worker knows. New ones go to the library: plain Latin ones many at a time in one string, where the
tokens themselves tell the chunks apart (by a leading space, or by word ends), all others each on its own.

What a worker keeps is bounded in bytes (`most_bytes`), however long the chunks are: of too many, those that were
seen again since the last time stay. Tests compare all of it with the library over random texts.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: White space of any reading; more characters here only send a text the slower way.
_SPACES = (*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, 0x180E, *range(0x2000, 0x200C), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000, 0xFEFF)
_SPACE = "".join(f"\\x{{{c:x}}}" for c in _SPACES)
#: What Arrow splits by; a text that has it is cut the slower way, too.
_MARK = "\x00"
_RUN = f"[{_SPACE}] (?:[{_SPACE}]|\\z)|{_MARK}"
_CUT = re.compile(f"(?<=[^{''.join(map(chr, _SPACES))}])(?=[ \\t\\n\\r])")
#: Chunks that may stand in one string with others: a space, then plain Latin and no white space; line ends last.
_PLAIN = r"^ [\x21-\x7e\x{a1}-\x{12f}\x{131}-\x{17f}]+\n*$"
#: How tokenizers that mark word ends cut plain Latin text without apostrophes: runs of letters, single digits, runs of
#: others; -1 for the space, 0 for line ends.
KINDS = np.array([{" ": -1, "\n": 0}.get(chr(c), {"L": 1, "N": 2}.get(unicodedata.category(chr(c))[0], 3)) for c in range(0x180)], np.int8)


def default_tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def version_digest(path: str) -> str:
    """Identifies a tokenizer by the bytes of its file."""
    with open(path, "rb") as f:
        return hashlib.sha256(f.read()).hexdigest()[:32]


def grouped(parts: Iterator[pa.RecordBatch], most: int = 16_000_000) -> Iterator[pa.Table]:
    """The batches put together to tables of about `most` bytes."""
    held: list[pa.RecordBatch] = []
    for part in parts:
        if part.num_rows:
            held.append(part)
        if sum(x.nbytes for x in held) >= most:
            yield pa.Table.from_batches(held).combine_chunks()
            held = []
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def texts_of(table: pa.Table, column: str = "text") -> pa.Array:
    """One array of the column's texts, null as empty."""
    whole = table.column(column).combine_chunks()
    whole = whole if isinstance(whole, pa.Array) else pa.concat_arrays(whole.chunks)
    return pc.fill_null(whole.cast(pa.large_string()), "")


class ChunkEncoder:
    """encode(texts) -> the ids of all texts one after another, and where each text begins in them."""

    _loaded: dict[str, ChunkEncoder] = {}

    def __init__(self, path: str, most_bytes: int = 48_000_000, joined: int = 2000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.most_bytes, self.joined = most_bytes, joined
        self.forget()
        with open(path) as f:
            plan = json.load(f)
        steps = (plan["pre_tokenizer"] or {}).get("pretokenizers", [plan["pre_tokenizer"] or {}])
        suffix = plan["model"].get("end_of_word_suffix")
        self.by_word_ends = bool(suffix) and any(x.get("type") == "Split" and x["behavior"] == "Removed" for x in steps)
        self.by_spaces = not suffix and len(steps) == 1 and steps[0].get("type") == "ByteLevel" and steps[0]["use_regex"] and not steps[0]["add_prefix_space"] and not plan["normalizer"]
        vocabulary = self.tokenizer.get_vocab()
        self.flag = np.zeros(max(vocabulary.values()) + 1, bool)
        for token, k in vocabulary.items():
            self.flag[k] = token.endswith(suffix) if suffix else token.startswith("Ġ")
        self.apart = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]

    @classmethod
    def of(cls, path: str) -> ChunkEncoder:
        """One per worker process, so that what it knows lasts over its tasks."""
        if path not in cls._loaded:
            cls._loaded[path] = cls(path)
        return cls._loaded[path]

    def forget(self, keep: np.ndarray | None = None) -> None:
        """Drops the known chunks but the marked ones."""
        if keep is None:
            self.known = pa.array([], pa.large_string())
            self.ids, self.starts, self.sizes = np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64)
        else:
            self.known = self.known.filter(pa.array(keep))
            starts, self.sizes = self.starts[keep], self.sizes[keep]
            self.ids = self.ids[spans(starts, self.sizes)]
            self.starts = np.cumsum(self.sizes) - self.sizes
        self.again = np.zeros(len(self.known), bool)

    def held(self) -> int:
        return self.known.nbytes + self.ids.nbytes + 17 * len(self.sizes)

    def chunks(self, texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
        """(all chunks, where each text's begin): all but the first chunk of a text start with their white space."""
        if not (self.by_spaces or self.by_word_ends):
            return texts, np.arange(len(texts) + 1)
        run = pc.match_substring_regex(texts, _RUN)
        cut = pc.split_pattern(pc.replace_substring(texts, pattern=" ", replacement=_MARK + " "), pattern=_MARK)
        if pc.any(run).as_py():
            odd = pa.array([_CUT.split(x) for x in texts.filter(run).to_pylist()], cut.type)
            order = np.empty(len(texts), np.int64)
            is_run = run.to_numpy(zero_copy_only=False)
            order[~is_run] = np.arange((~is_run).sum())
            order[is_run] = np.arange((~is_run).sum(), len(texts))
            cut = pa.concat_arrays([cut.filter(pc.invert(run)), odd]).take(pa.array(order))
        sizes = pc.list_value_length(cut).to_numpy(zero_copy_only=False).astype(np.int64)
        return cut.flatten(), np.concatenate([[0], np.cumsum(sizes)])

    def new_ids(self, chunks: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, where those of each chunk begin, how many they are)."""
        alone = np.ones(len(chunks), bool)
        starts, sizes, parts, n = np.zeros(len(chunks), np.int64), np.zeros(len(chunks), np.int64), [np.zeros(0, np.uint32)], 0
        if self.by_spaces or self.by_word_ends:
            plain = pc.match_substring_regex(chunks, _PLAIN)
            for some in (*self.apart, *"'" * self.by_word_ends):
                plain = pc.and_(plain, pc.invert(pc.match_substring(chunks, some, ignore_case=True)))
            alone = ~plain.to_numpy(zero_copy_only=False)
        at = np.flatnonzero(~alone)
        for a in range(0, len(at), self.joined):
            own = at[a : a + self.joined]
            joined = "".join(chunks.take(pa.array(own)).to_numpy(zero_copy_only=False))
            ids = np.array(self.tokenizer.encode_batch_fast([joined], add_special_tokens=False)[0].ids, np.uint32)
            begins = self.begins(joined, len(own), ids)
            if begins is None:  # some character is read otherwise than expected
                alone[own] = True
                continue
            starts[own], sizes[own] = n + begins, np.diff(np.append(begins, len(ids)))
            parts.append(ids)
            n += len(ids)
        at = np.flatnonzero(alone)
        for a in range(0, len(at), self.joined):
            own = at[a : a + self.joined]
            for k, x in zip(own, self.tokenizer.encode_batch_fast(chunks.take(pa.array(own)).to_pylist(), add_special_tokens=False), strict=True):
                parts.append(np.array(x.ids, np.uint32))
                starts[k], sizes[k] = n, len(x.ids)
                n += len(x.ids)
        return np.concatenate(parts), starts, sizes

    def begins(self, joined: str, n: int, ids: np.ndarray) -> np.ndarray | None:
        """Where each of the n joined chunks begins in their ids; None if that cannot be told."""
        marks = np.flatnonzero(self.flag[ids])
        if not self.by_word_ends:
            return marks if len(marks) == n else None
        kind = KINDS[np.frombuffer(joined.encode("utf-32-le"), np.uint32)]
        word = (kind == 2) | ((kind > 0) & (kind != np.concatenate([[0], kind[:-1]])))
        before = np.cumsum(word)[np.flatnonzero(kind < 0)]
        return np.concatenate([[0], marks[before[1:] - 1] + 1]) if word.sum() == len(marks) and len(before) == n else None

    def rows(self, chunks: pa.Array) -> np.ndarray:
        """The row of each chunk in the table of known chunks, new ones added."""
        if self.held() > self.most_bytes:
            self.forget(self.again if 2 * self.again.sum() < len(self.again) else None)
        found = pc.index_in(chunks, value_set=self.known)
        out = pc.fill_null(found, -1).to_numpy(zero_copy_only=False).astype(np.int64)
        hit = out >= 0
        self.again[out[hit]] = True
        if not hit.all():
            missing = chunks.filter(pa.array(~hit))
            new = missing.unique()
            out[~hit] = len(self.known) + pc.index_in(missing, value_set=new).to_numpy(zero_copy_only=False)
            ids, starts, sizes = self.new_ids(new)
            self.starts, self.sizes = np.concatenate([self.starts, len(self.ids) + starts]), np.concatenate([self.sizes, sizes])
            self.ids = np.concatenate([self.ids, ids])
            self.known = pa.concat_arrays([self.known, new])
            self.again = np.concatenate([self.again, np.zeros(len(new), bool)])
        return out

    def counts(self, texts: pa.Array) -> np.ndarray:
        """The number of tokens of each text."""
        chunks, begins = self.chunks(texts)
        rows = self.rows(chunks)
        total = np.concatenate([[0], np.cumsum(self.sizes[rows])])
        return total[begins[1:]] - total[begins[:-1]]

    def encode(self, texts: pa.Array, end: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(ids, begins): text k has ids[begins[k] : begins[k + 1]], the end id last where one is given."""
        chunks, begins = self.chunks(texts)
        rows = self.rows(chunks)
        sizes = self.sizes[rows]
        ids = self.ids[spans(self.starts[rows], sizes)]
        at = np.concatenate([[0], np.cumsum(sizes)])[begins]
        if end is None:
            return ids, at
        return np.insert(ids, at[1:], np.uint32(end)), at + np.arange(len(at))


def spans(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places start .. start + size of all spans, one after another."""
    before = np.cumsum(sizes) - sizes
    return np.repeat(starts - before, sizes) + np.arange(int(sizes.sum()))
