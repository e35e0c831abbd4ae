"""Token-ID output: documents packed into rows of equal length by best fit decreasing.

A task gathers the token ids of a block of documents, cuts those over the row length into pieces
(the cut loses nothing: each piece says where in its document it starts), and packs the pieces,
longest first, each into the open row with the least room that holds it. A segment tree over the
capacities finds that room in log(capacity) steps. Blocks are cut by a fixed number of tokens, so a
task's memory is bounded and its result is the same each time it runs over the same split; only the
last rows of a block stay unfilled. Nothing is shuffled.

Nulls and odd rows: a null or empty text has no ids and is in no row. Repeated rows are packed as
often as they occur. An empty table gives no rows. Further columns are not read.
"""

from __future__ import annotations

from array import array
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadlens.llm.common import slices

#: Tokens of a block, and chunks whose ids a worker remembers.
BLOCK_TOKENS, CHUNKS = 4_000_000, 500_000


class Capacity:
    """Segment tree over the room of open rows: the least room of at least a given size."""

    def __init__(self, most: int):
        self.leaves = 1 << most.bit_length()
        self.count = [0] * (2 * self.leaves)

    def add(self, room: int, n: int) -> None:
        i = room + self.leaves
        while i:
            self.count[i] += n
            i >>= 1

    def least(self, size: int) -> int:
        """The least room >= size that some row has, or -1."""
        i, count = size + self.leaves, self.count
        if count[i]:
            return size
        while i > 1:
            if not i & 1 and count[i + 1]:  # the right sibling holds larger rooms
                i += 1
                while i < self.leaves:
                    i = 2 * i if count[2 * i] else 2 * i + 1
                return i - self.leaves
            i >>= 1
        return -1


def best_fit(sizes: np.ndarray, capacity: int) -> list[list[int]]:
    """Rows, each a list of places in ``sizes`` (all from 1 to capacity), longest pieces first."""
    tree, open_rows, rows = Capacity(capacity), [deque() for _ in range(capacity + 1)], []
    for i in np.argsort(-sizes, kind="stable").tolist():
        n = int(sizes[i])
        room = tree.least(n)
        if room < 0:
            row, room = [], capacity
            rows.append(row)
        else:
            row = open_rows[room].popleft()
            tree.add(room, -1)
        row.append(i)
        if room > n:
            open_rows[room - n].append(row)
            tree.add(room - n, 1)
    return rows


class Known(dict):
    """Ids, as int32 bytes, of chunks that follow a space; a chunk not met before is encoded."""

    def __init__(self, encode):
        self.encode = encode

    def __missing__(self, chunk: str) -> bytes:
        got = array("i", self.encode(" " + chunk)).tobytes()
        if len(chunk) <= 64:
            self[chunk] = got
        return got


class Ids:
    """Token ids of texts as int32 arrays; chunks between single spaces are remembered."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import regex
        import tiktoken

        self.encode = tiktoken.Encoding("packing", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.unsafe = regex.compile(r" (?<=\s )(?:\s|$)").search
        self.known = Known(self.encode)

    def of(self, text: str) -> np.ndarray:
        if len(text) > 1 << 22 or self.unsafe(text):  # a space inside other white space is no place to cut
            return np.array(self.encode(text), np.int32)
        first, *rest = text.split(" ")
        if len(self.known) > CHUNKS:
            self.known.clear()
        return np.frombuffer(b"".join([array("i", self.encode(first)).tobytes(), *map(self.known.__getitem__, rest)]), np.int32)


def read_ranks(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


_IDS: dict[str, Ids] = {}


def _ids(name: str, pattern: str) -> Ids:
    if name not in _IDS:
        import base64

        from pyspark import SparkFiles

        with open(SparkFiles.get(name), "rb") as f:
            _IDS[name] = Ids({base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}, pattern)
    return _IDS[name]


#: One packed row. ids: the row's matrix line, padded by ``pad``; position_ids start at 0 again at
#: each segment; cu_seqlens: ends of the segments, from 0; doc_ids and doc_starts: of each segment,
#: its document and the place of its first token in it.
ROW = ("seq_id long, ids array<int>, position_ids array<int>, cu_seqlens array<int>, "
       "doc_ids array<{id}>, doc_starts array<long>, n_tokens int")


def pack(docs: DataFrame, vocabulary: str, pattern: str, capacity: int = 2048, end_id: int | None = None, pad: int = 0,
         id_col: str = "doc_id", text_col: str = "text", block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """Packed rows of every document; ``vocabulary`` is a file of token ranks, ``end_id`` is put
    after each document that has tokens."""
    from leadlens.llm.common import ship_file

    name = ship_file(docs.sparkSession, read_ranks(vocabulary), "ranks", ".tiktoken")
    id_field = docs.select(F.col(id_col).alias("doc_id"))
    id_type = id_field.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = _ids(name, pattern)
        seq = TaskContext.get().partitionId() << 33
        block, owners, held = [], [], 0

        def rows(kind):
            nonlocal seq
            pieces = [(d, at, a[at:at + capacity]) for d, a in zip(owners, block) for at in range(0, len(a), capacity)]
            packed = best_fit(np.array([len(p[2]) for p in pieces], np.int64), capacity)
            for lo in range(0, len(packed), 500):
                part = packed[lo:lo + 500]
                matrix = np.full((len(part), capacity), pad, np.int32)
                position = np.zeros((len(part), capacity), np.int32)
                ends, doc, start, used = [], [], [], []
                for r, row in enumerate(part):
                    at, cuts = 0, [0]
                    for i in row:
                        a = pieces[i][2]
                        matrix[r, at:at + len(a)] = a
                        position[r, at:at + len(a)] = np.arange(len(a))
                        at += len(a)
                        cuts.append(at)
                    ends.append(cuts)
                    doc.append([pieces[i][0] for i in row])
                    start.append([pieces[i][1] for i in row])
                    used.append(at)
                flat = pa.array(np.arange(len(part) + 1, dtype=np.int32) * capacity)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.arange(seq, seq + len(part)), pa.int64()),
                     pa.ListArray.from_arrays(flat, pa.array(matrix.ravel())),
                     pa.ListArray.from_arrays(flat, pa.array(position.ravel())),
                     pa.array(ends, pa.list_(pa.int32())), pa.array(doc, pa.list_(kind)),
                     pa.array(start, pa.list_(pa.int64())), pa.array(used, pa.int32())],
                    names=[c.split()[0] for c in ROW.split(", ")])
                seq += len(part)

        kind = pa.int64()
        for b in slices(batches, "text", 4 << 20):
            kind = b.schema.field("doc_id").type
            for d, t in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist()):
                if not t:
                    continue
                a = ids.of(t)
                if end_id is not None and len(a):
                    a = np.append(a, np.int32(end_id))
                block.append(a)
                owners.append(d)
                held += len(a)
                if held >= block_tokens:
                    yield from rows(kind)
                    block, owners, held = [], [], 0
        yield from rows(kind)

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, ROW.format(id=id_type))
