"""Chunks of many records in packed columns: exchanged, met and stored as arrays, not as a row for each chunk.

A chunk is a number of 48 bits, whose low six bits are its length. Chunks are dealt into parts by their hash. A row of the
exchange holds what some records have in one part: the chunks record after record, how many each record has, and the
records. All rows of a part come to one task, which sorts the chunks and compares the records that have one in common; the
number of parts follows the number of chunks, so that a part has about `PART_CHUNKS`. `_meet` has the rules. Within a part
32 bits of a chunk tell nearly all chunks apart; what agrees by chance is compared and found different.

A text that several entries have may come several times; each part keeps it once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from pagesift.llm._chars import U, mix
from pagesift.llm._meet import BITS, LEAST_BITS

#: Bytes of a chunk, and of one that is met with those of its part only.
WIDTH, MET_WIDTH = 6, 4
CHUNK = U((1 << 8 * WIDTH) - 1)
PART_CHUNKS = 2_000_000
#: Records of one chunk in a part of the chunk-to-record table.
MOST_OF_PART = 500_000
#: Chunks and records that a task packs at a time.
SLICE_CHUNKS, SLICE_RECORDS = 2_000_000, 1 << 16
#: A run of more records with a chunk in common is compared in blocks, of so many pairs at most.
LONG_RUN, BLOCK_PAIRS = 128, 1 << 20
#: Pairs are added up whenever a part has found so many.
MOST_FOUND = 4_000_000

#: `counts`: the bytes of a count, then the counts. `records`: numbers of 64 bits for each, (k, s1, s2, units that it must
#: share) or k alone. `dealt`: for each chunk twice the part that a frequent chunk dealt the record to, and 1 if the chunk
#: brings the records of that part together; empty if none is dealt.
EXCHANGED = "part int, chunks binary, counts binary, records binary, dealt binary"
SHARED = "a long, b long, shared long, _need long"
#: A block of the chunk-to-record table: sorted chunks, the number of each one's record, and the records; by planes of bytes.
BLOCKS = "bucket int, chunks binary, numbers binary, records binary"


def packed(chunks: np.ndarray, width: int = WIDTH) -> np.ndarray:
    return chunks.astype("<i8", copy=False).view(np.uint8).reshape(-1, 8)[:, :width]


def unpacked(data, width: int = WIDTH) -> np.ndarray:
    out = np.zeros((len(data) // width, 8), np.uint8)
    out[:, :width] = np.frombuffer(data, np.uint8).reshape(-1, width)
    return out.view("<i8").ravel()


def packed_column(each: list[np.ndarray]) -> pa.Array:
    """A binary for each array of chunks."""
    offsets = np.concatenate([[0], np.cumsum([WIDTH * len(x) for x in each])]).astype(np.int32)
    data = packed(np.concatenate([np.empty(0, np.int64), *each])).tobytes()
    return pa.Array.from_buffers(pa.binary(), len(each), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(data)])


def chunks_in(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All chunks of a column of lists or of packed binaries, and how many each entry has."""
    if not pa.types.is_binary(column.type):
        return column.flatten().to_numpy(zero_copy_only=False), np.diff(column.offsets.to_numpy())
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    return unpacked(memoryview(data)[offsets[0] : offsets[-1]] if data else b""), np.diff(offsets) // WIDTH


def record_slices(counts: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of consecutive records with about `SLICE_CHUNKS` chunks (a record of more makes a slice of its own)."""
    ends, start = np.cumsum(counts), 0
    while start < len(counts):
        before = ends[start - 1] if start else 0
        stop = int(np.searchsorted(ends, before + SLICE_CHUNKS, "right"))
        stop = min(max(stop, start + 1), start + SLICE_RECORDS, len(counts))
        yield start, stop
        start = stop


def parts_for(chunks: int) -> int:
    return max(1, -(-chunks // PART_CHUNKS))


def part_of(chunks: np.ndarray, parts: int) -> np.ndarray:
    return (mix(chunks.view(U)) >> U(40)).astype(np.int64) % parts


def exchanged(chunks: np.ndarray, owners: np.ndarray, records: np.ndarray, part: np.ndarray, width: int, dealt: np.ndarray | None = None) -> pa.RecordBatch:
    """Rows as in `EXCHANGED` of chunks whose owners ascend; records: a row of numbers for each owner; part: of each chunk."""
    order = np.argsort(part.astype(np.uint16) if not len(part) or part.max() < 1 << 16 else part, kind="stable")
    part, owners, data = part[order], owners[order], packed(chunks[order], width)
    edges = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1], [True]])) if len(part) else np.zeros(1, np.int64)
    rows = {name.split()[0]: [] for name in EXCHANGED.split(", ")}
    for a, b in zip(edges[:-1], edges[1:]):
        first = np.flatnonzero(np.concatenate([[True], owners[a + 1 : b] != owners[a : b - 1]]))
        counts = np.diff(np.append(first, b - a))
        size = 1 if counts.max() < 256 else 4
        rows["part"].append(int(part[a]))
        rows["chunks"].append(data[a:b].tobytes())
        rows["counts"].append(bytes([size]) + counts.astype(f"<u{size}").tobytes())
        rows["records"].append(records[owners[a:b][first]].tobytes())
        rows["dealt"].append(b"" if dealt is None else dealt[order[a:b]].astype("<i4").tobytes())
    return pa.RecordBatch.from_arrays([pa.array(x, pa.int32() if name == "part" else pa.binary()) for name, x in rows.items()], names=list(rows))


def _gathered(table: pa.Table, width: int, fields: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray | None]:
    """Of the rows of a part: chunks, their owners, records, and what was dealt."""
    column = {name: table.column(name).to_pylist() for name in table.column_names}
    chunks = unpacked(b"".join(column["chunks"]), width)
    counts = np.concatenate([np.frombuffer(c, f"<u{c[0]}", offset=1).astype(np.int64) for c in column["counts"]])
    records = np.frombuffer(b"".join(column["records"]), "<i8").reshape(-1, fields)
    dealt = None
    if any(column["dealt"]):
        dealt = np.concatenate([np.frombuffer(d, "<i4") if d else np.ones(len(c) // width, np.int32) for d, c in zip(column["dealt"], column["chunks"])])
    # copies of a text have the same chunks; texts that only agree in k have others
    k, total = records[:, 0], np.add.reduceat(chunks, np.cumsum(counts) - counts)
    order = np.lexsort((total, k))
    again = (k[order[1:]] == k[order[:-1]]) & (total[order[1:]] == total[order[:-1]])
    if again.any():
        keep = np.ones(len(k), bool)
        keep[order[1:][again]] = False
        stay = np.repeat(keep, counts)
        chunks, counts, records, dealt = chunks[stay], counts[keep], records[keep], None if dealt is None else dealt[stay]
    return chunks, np.repeat(np.arange(len(counts)), counts), records, dealt


def _added(code: list[np.ndarray], units: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    code, units = np.concatenate(code), np.concatenate(units)
    each, at = np.unique(code, return_inverse=True)
    return each, np.bincount(at, units, len(each)).astype(np.int64)


def _runs(chunks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edges = np.flatnonzero(np.concatenate([[True], chunks[1:] != chunks[:-1], [True]]))
    return edges[:-1], np.diff(edges)


def met(table: pa.Table) -> pa.Table:
    """Pairs as in `SHARED` of records of a part that have chunks in common and whose sketches agree."""
    chunks, owners, records, dealt = _gathered(table, MET_WIDTH, 4)
    order = np.argsort(chunks)
    start, length = _runs(chunks[order])
    order = order[np.repeat(length > 1, length)]  # most chunks have one record only
    chunks, owners = chunks[order], owners[order]
    dealt = None if dealt is None else dealt[order]
    k, s1, s2, need = (np.ascontiguousarray(records[:, j]) for j in range(4))
    # unsigned: of a negative number the bits of its absolute value would be counted
    x1, x2, units = s1[owners].view(U), s2[owners].view(U), (chunks & 63).astype(np.float64)
    found, weights, held = [np.empty(0, np.int64)], [np.empty(0, np.float64)], 0

    def take(i: np.ndarray, j: np.ndarray) -> None:
        nonlocal found, weights, held
        if dealt is not None:  # records of one part meet under that part's own key only
            meet = ((dealt[i] & 1) == 1) | (dealt[i] >> 1 != dealt[j] >> 1)
            i, j = i[meet], j[meet]
        x, y = owners[i], owners[j]
        found.append((np.minimum(x, y) << 32) + np.maximum(x, y))
        weights.append(units[i])
        held += len(i)
        if held > MOST_FOUND:
            each, total = _added(found, weights)
            found, weights, held = [each], [total], 0

    start, length = _runs(chunks) if len(chunks) else (np.empty(0, np.int64),) * 2
    end = np.repeat(np.where(length <= LONG_RUN, start + length, 0), length)
    at, gap = np.flatnonzero(end > np.arange(len(chunks)) + 1), 1
    while len(at):
        i, j = at, at + gap
        near = np.bitwise_count(x1[i] ^ x1[j]) + np.bitwise_count(x2[i] ^ x2[j]) <= BITS - LEAST_BITS
        take(i[near], j[near])
        gap += 1
        at = at[end[at] > at + gap]
    for a, n in zip(start[length > LONG_RUN], length[length > LONG_RUN]):
        step = max(1, BLOCK_PAIRS // n)
        for b in range(a, a + n, step):
            own, rest = slice(b, min(b + step, a + n)), slice(b, a + n)
            near = np.bitwise_count(x1[own, None] ^ x1[None, rest]) + np.bitwise_count(x2[own, None] ^ x2[None, rest]) <= BITS - LEAST_BITS
            i, j = np.nonzero(near)
            later = j > i
            take(i[later] + b, j[later] + b)
    code, shared = _added(found, weights)
    x, y = code >> 32, code & 0xFFFFFFFF
    apart = k[x] != k[y]
    x, y, shared = x[apart], y[apart], shared[apart]
    columns = [np.minimum(k[x], k[y]), np.maximum(k[x], k[y]), shared, np.maximum(need[x], need[y])]
    return pa.Table.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["a", "b", "shared", "_need"])


def meeting_parts(rows: DataFrame) -> DataFrame:
    return rows.groupBy("part").applyInArrow(met, SHARED)


def _planes(numbers: np.ndarray, width: int) -> bytes:
    return np.ascontiguousarray(numbers.astype("<i8", copy=False).view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes()


def _from_planes(data: bytes, width: int) -> np.ndarray:
    out = np.zeros((len(data) // width, 8), np.uint8)
    out[:, :width] = np.frombuffer(data, np.uint8).reshape(width, -1).T
    return out.view("<i8").ravel()


def blocks(rows: DataFrame, buckets: int) -> DataFrame:
    """The chunk-to-record table of rows as in `EXCHANGED`: a block for each bucket that a part has chunks of."""

    def block(table: pa.Table) -> pa.Table:
        chunks, owners, records, _ = _gathered(table, WIDTH, 1)
        k, owners = np.sort(records[:, 0]), np.argsort(np.argsort(records[:, 0], kind="stable"))[owners]  # numbers in the order of k
        order = np.argsort(chunks)
        order = order[np.argsort(bucket_of(chunks[order], buckets).astype(np.uint16 if buckets <= 1 << 16 else np.int64), kind="stable")]
        chunks, owners = chunks[order], owners[order]
        start, length = _runs(bucket_of(chunks, buckets))
        out = []
        for a, b in zip(start, start + length):
            present, number = np.unique(owners[a:b], return_inverse=True)
            out.append((int(bucket_of(chunks[a : a + 1], buckets)[0]), _planes(chunks[a:b], WIDTH), _planes(number, 4), _planes(k[present], 8)))
        return pa.Table.from_arrays([pa.array(x, pa.binary() if j else pa.int32()) for j, x in enumerate(zip(*out))], names=["bucket", "chunks", "numbers", "records"])

    return rows.groupBy("part").applyInArrow(block, BLOCKS)


def bucket_of(chunks: np.ndarray, buckets: int) -> np.ndarray:
    return (chunks >> 6) % buckets


def _unblocked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for chunks, numbers, records in zip(*(batch.column(j) for j in range(3))):
            keys, k = _from_planes(chunks.as_py(), WIDTH), _from_planes(records.as_py(), 8)[_from_planes(numbers.as_py(), 4)]
            for a in range(0, len(keys), SLICE_RECORDS):
                yield pa.RecordBatch.from_arrays([pa.array(keys[a : a + SLICE_RECORDS]), pa.array(k[a : a + SLICE_RECORDS])], names=["key", "k"])


def unblocked(table: DataFrame) -> DataFrame:
    """Rows (`key`, `k`) of a chunk-to-record table."""
    return table.select("chunks", "numbers", "records").mapInArrow(_unblocked, "key long, k long")
