"""Packing of tokenised documents into fixed windows by best-fit decreasing.

One narrow pass, no exchange: a task tokenises its documents, cuts overlong ones into full windows,
which go out at once, and gathers the remainders in blocks. Each block is packed longest first; a
segment tree over the remaining capacity finds the tightest open window for a piece in
O(log window). Blocks bound the memory: TAILS pieces or BLOCK_BYTES of ids, whichever comes first,
and every piece of every document is in exactly one block.

Windows never span tasks, so the result needs no global state; a task that is run again gives the
same windows, since its input partition is the same. Scan partitions with few documents are merged
beforehand (without an exchange) so that the last windows of a task weigh little.

Null text counts as empty and still has its end id, so every row gives at least one piece. A null
id stays null, repeated rows are packed each for itself, an empty table gives an empty result, other
columns are left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tidepool.llm.common import pick

WINDOW = 2048
END_ID = 1
#: Remainders packed together, and bytes of their ids.
TAILS, BLOCK_BYTES = 16_384, 64 << 20
#: Fewer documents a task than this, and partitions are merged.
DOCS_A_TASK = 4096
SCHEMA = "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary"
_NAMES = [c.split()[0] for c in SCHEMA.split(", ")]
_TYPES = [pa.int64()] * 6 + [pa.binary()]


class OpenWindows:
    """Open windows by remaining capacity, under a segment tree that counts them."""

    def __init__(self, window: int) -> None:
        self.leaves = 1 << window.bit_length()
        self.tree = [0] * (2 * self.leaves)
        self.at: list[list[int]] = [[] for _ in range(window + 1)]

    def add(self, capacity: int, window_id: int) -> None:
        self.at[capacity].append(window_id)
        self._count(capacity, 1)

    def _count(self, capacity: int, by: int) -> None:
        node = capacity + self.leaves
        while node:
            self.tree[node] += by
            node >>= 1

    def take_tightest(self, need: int) -> tuple[int, int] | None:
        """Capacity and id of the open window with the least capacity of at least `need`; it is removed."""
        tree, node = self.tree, need + self.leaves
        while not tree[node]:
            while node & 1:  # a right child: look right of its parent
                node >>= 1
            if not node:
                return None
            node += 1
        while node < self.leaves:
            node <<= 1
            if not tree[node]:
                node += 1
        capacity = node - self.leaves
        self._count(capacity, -1)
        return capacity, self.at[capacity].pop()


def best_fit_decreasing(lengths: list[int], window: int) -> tuple[list[int], list[int], int]:
    """Window and offset of each length (in input order), and the number of windows. Ties go in input order."""
    order = sorted(range(len(lengths)), key=lambda i: -lengths[i])
    where, offset, n, opened = [0] * len(lengths), [0] * len(lengths), 0, OpenWindows(window)
    for i in order:
        need = lengths[i]
        found = opened.take_tightest(need)
        if found is None:
            found, n = (window, n), n + 1
        capacity, w = found
        where[i], offset[i] = w, window - capacity
        if capacity > need:
            opened.add(capacity - need, w)
    return where, offset, n


def pack(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, end_id: int = END_ID) -> DataFrame:
    """One row per piece: its document's id and token count, its start there, its length and ids (little-endian unsigned 32-bit), its sequence and its offset in that."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        from tidepool.llm.vocab import word_bpe

        bpe, full = word_bpe(tokenizer_path), 4 * window
        next_id = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 33
        tails: list[tuple] = []
        held = 0

        def batch(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _TYPES, strict=True)], _NAMES)

        def packed() -> pa.RecordBatch:
            nonlocal next_id
            where, offset, n = best_fit_decreasing([t[2] for t in tails], window)
            rows = [(*t[:4], next_id + w, o, t[4]) for t, w, o in zip(tails, where, offset, strict=True)]
            next_id += n
            return batch(rows)

        for found in batches:
            whole, size = [], 0
            for doc_id, text in zip(found.column(0), found.column(1), strict=True):
                doc_id = doc_id.as_py()
                ids = bpe.ids(text.as_py())
                ids.append(end_id)
                data = np.array(ids, "<u4").tobytes()
                total = len(ids)
                for start in range(0, total - total % window, window):
                    whole.append((doc_id, start, window, total, next_id, 0, data[4 * start : 4 * start + full]))
                    next_id += 1
                    size += full
                if rest := total % window:
                    tails.append((doc_id, total - rest, rest, total, data[4 * (total - rest) :]))
                    held += 4 * rest
                if size > BLOCK_BYTES // 4:
                    yield batch(whole)
                    whole, size = [], 0
                if len(tails) >= TAILS or held >= BLOCK_BYTES:
                    yield packed()
                    tails, held = [], 0
            if whole:
                yield batch(whole)
        if tails:
            yield packed()

    rows = pick(docs, doc_id=(id_col, "long"), text=(text_col, "string")).fillna("", ["text"])
    tasks = max(1, docs.count() // DOCS_A_TASK)  # of Parquet, footers only
    if tasks < rows.rdd.getNumPartitions():
        rows = rows.coalesce(tasks)
    return rows.mapInArrow(run, SCHEMA)
