"""Packing into fixed windows: sum-of-squares placement over fill levels, tracked in an array."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from riskspark.llm.common import text_rows

WINDOW = 2048
END_ID = 1
#: Most windows a task keeps open; at this number they are filled up by cutting and closed.
OPEN_WINDOWS = 1024

RESULT = ("doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, "
          "offset long, ids array<int>")


class ByteBpe:
    """Token ids of the byte-level BPE file.

    Encoded with the rank file beside it, which holds the same vocabulary and is several times
    faster; a test compares the ids. A text that spells a special token gets that token's id.
    """

    def __init__(self, name: str = "byte_bpe_50k"):
        import base64

        import public_tokenizers
        import tiktoken

        with open(public_tokenizers.path(f"{name}.tiktoken"), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self._encode = tiktoken.Encoding("byte_bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks,
                                         special_tokens={}).encode_ordinary
        self._special, self._special_id = "<|endoftext|>", len(ranks)

    def __call__(self, text: str) -> list[int]:
        if self._special not in text:
            return self._encode(text)
        out: list[int] = []
        for i, part in enumerate(text.split(self._special)):
            out += [self._special_id] * (i > 0) + self._encode(part)
        return out


class SumOfSquares:
    """Online packing: each piece goes where the sum of squared level counts grows least.

    ``levels[h]`` counts the open windows filled to ``h``. A piece of size ``s`` either opens a
    window or moves one from level ``h`` to ``h + s``; the change of the sum of squares is
    evaluated for all occupied levels at once. Long documents give whole windows first.
    """

    def __init__(self, size: int = WINDOW, most_open: int = OPEN_WINDOWS):
        self.size, self.most_open = size, most_open
        self.levels = np.zeros(size + 1, np.int64)
        self.open: dict[int, list[list]] = {}   # level -> windows, each a list of (doc, start, ids)
        self.n_open = 0

    def add(self, doc, ids: np.ndarray):
        """Yields finished windows: lists of (doc, start, ids)."""
        whole = len(ids) // self.size * self.size
        for at in range(0, whole, self.size):
            yield [(doc, at, ids[at: at + self.size])]
        s = len(ids) - whole
        if s:
            window = self._place(s)
            window.append((doc, whole, ids[whole:]))
            level = sum(len(p[2]) for p in window)
            if level == self.size:
                yield window
            else:
                self.levels[level] += 1
                self.open.setdefault(level, []).append(window)
                self.n_open += 1
                if self.n_open > self.most_open:
                    yield from self.close(last=False)

    def _place(self, s: int) -> list:
        n, cap = self.levels, self.size
        at = np.flatnonzero(n[: cap - s + 1])
        to = at + s
        # moving h -> h + s: (n_h - 1)^2 - n_h^2 + (n_t + 1)^2 - n_t^2; a full window is no longer counted
        gain = 2 * (np.where(to < cap, n[to] + 1, 0) - n[at]) + np.where(to < cap, 0, 1)
        new = 2 * n[s] + 1
        if not len(at) or gain.min() > new:
            return []
        h = int(at[np.flatnonzero(gain == gain.min())[-1]])     # ties: the fullest
        n[h] -= 1
        self.n_open -= 1
        window = self.open[h].pop()
        if not self.open[h]:
            del self.open[h]
        return window

    def close(self, last: bool = True):
        """Fill the fullest windows by cutting up the emptiest; what is left at last splits at powers of two."""
        left = [w for h in sorted(self.open, reverse=True) for w in self.open[h]]
        self.open, self.n_open = {}, 0
        self.levels[:] = 0
        spare: list[tuple] = []
        while left:
            window = left.pop(0)
            room = self.size - sum(len(p[2]) for p in window)
            while room and (spare or left):
                if not spare:
                    spare = left.pop()[::-1]
                doc, start, ids = spare.pop()
                window.append((doc, start, ids[:room]))
                if len(ids) > room:
                    spare.append((doc, start + room, ids[room:]))
                room -= min(room, len(ids))
            if room and not last:
                level = self.size - room
                self.levels[level], self.open[level], self.n_open = 1, [window], 1
            elif room:
                yield from self._powers(window)
            else:
                yield window
        if spare:
            spare = spare[::-1]
            if last:
                yield from self._powers(spare)
            else:
                level = sum(len(p[2]) for p in spare)
                self.levels[level], self.open[level], self.n_open = 1, [spare], 1

    def _powers(self, window):
        total = sum(len(p[2]) for p in window)
        for bit in range(self.size.bit_length() - 1, -1, -1):
            room = total & (1 << bit)
            out = []
            while room:
                doc, start, ids = window[0]
                out.append((doc, start, ids[:room]))
                window = ([(doc, start + room, ids[room:])] if len(ids) > room else []) + window[1:]
                room -= min(room, len(ids))
            if out:
                yield out


def packed(docs: DataFrame, size: int = WINDOW, tokenizer: str = "byte_bpe_50k",
           most_open: int = OPEN_WINDOWS, with_ids: bool = True) -> DataFrame:
    """Token windows of ``size`` ids over all documents: one row per piece, no shuffle.

    A document is its token ids and the end id 1; null text counts as empty, so every row has
    at least one id. Every id lies in one piece. Each task packs the rows it reads, so its
    sequence ids are its partition number and a running number, the same in a repeated task.
    Repeated rows are packed each; an empty table gives no piece. All windows are full but
    those at a task's end, whose lengths are powers of two.
    """

    def pack(batches):
        encode, packing = ByteBpe(tokenizer), SumOfSquares(size, most_open)
        number = TaskContext.get().partitionId() << 36
        rows: list[tuple] = []

        def table():
            cols = list(zip(*rows)) if rows else [[]] * 8
            kinds = [pa.int64()] * 7
            ids = (pa.ListArray.from_arrays(
                np.concatenate(([0], np.cumsum([len(x) for x in cols[7]]))).astype(np.int32),
                pa.array(np.concatenate(cols[7]).astype(np.int32) if len(cols[7]) else np.zeros(0, np.int32)))
                if with_ids else None)
            rows.clear()
            arrays = [pa.array(c, k) for c, k in zip(cols, kinds)] + ([ids] if with_ids else [])
            return pa.RecordBatch.from_arrays(arrays, names=[x.split()[0] for x in RESULT.split(", ")][:len(arrays)])

        def emit(windows):
            nonlocal number
            for window in windows:
                at = 0
                for (doc, n), start, ids in window:
                    rows.append((doc, start, len(ids), zlib.crc32(ids.tobytes()), n, number, at, ids))
                    at += len(ids)
                number += 1

        for batch in batches:
            for doc, text in zip(batch["doc_id"].to_pylist(), batch["text"]):
                ids = np.array([*encode(text.as_py() or ""), END_ID], "<u4")
                emit(packing.add((doc, len(ids)), ids))
                if len(rows) >= 4000:
                    yield table()
        emit(packing.close())
        yield table()

    schema = RESULT if with_ids else RESULT.rpartition(", ")[0]
    return text_rows(docs).mapInArrow(pack, schema)
