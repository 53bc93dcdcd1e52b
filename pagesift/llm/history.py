"""Checking new batches against everything delivered before (problem 1).

Content-defined chunking: a rolling hash over the letters and digits of the body, in one case and width, sets boundaries.
From every boundary a chunk reaches to the first boundary that is `LEAST_ASCII` or `LEAST_OTHER` characters or more away,
so chunks overlap, and a text whose letters are changed every 31 characters still has whole ones. Chunk hashes join to a
persistent chunk-to-record table, whose rows give the size that two records share; pairs whose shared part (coverage)
reaches the threshold, and whose sketches agree, are decided by an exact check of their texts; the chunks of accepted
texts are appended. Punctuation, which reprints often change throughout, is no part of chunks. Chunks move and are stored
packed (`_packed`), in arrays of many records.

Every chunk of a text is indexed, whatever the length of the text, so the part that two texts share is counted, not
estimated.

Frequent chunks: a record leaves out its most frequent chunks as far as they make up less than `LEAST_COVERAGE` of its
size. A pair that shares more than that still shares a chunk that neither leaves out, because all leave out in one order
(prefix filtering); page furniture so brings nobody together, and a large family of reprints, which consists of frequent
chunks, still meets.

A text that is exactly like an earlier one adds no chunks. Every other text adds its chunks, also if it was reported as a
repeat: a later record may be alike to it only.
"""

from __future__ import annotations

import gc
import json
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagesift.functions.urls import comparable
from pagesift.llm._alike import LEAST_CHARS, LEAST_SHARE, checked_pairs, content_key
from pagesift.llm._chars import U, bare, letters, mix, slices
from pagesift.llm._meet import ROWS, dealt, decided, frequencies, frequency, hot_above, meeting, row_batch, sketches
from pagesift.llm._packed import BLOCKS, CHUNK, EXCHANGED, MET_WIDTH, MOST_OF_PART, WIDTH, blocks, bucket_of, chunks_in, exchanged, meeting_parts, packed_column, part_of, parts_for, record_slices, unblocked
from pagesift.session import scratch, written

WINDOW = 4
#: Characters between boundaries on average, and the least length of a chunk, within ASCII text and elsewhere.
AVERAGE_ASCII, AVERAGE_OTHER = 4, 5
LEAST_ASCII, LEAST_OTHER = 20, 16
LEAST_COVERAGE = 0.05
#: Rows that `accepted` checks at once.
BATCH_ROWS = 5_000_000
#: Chunks are exchanged in turns, each of a part of all hashes, so that the files of one turn go before the next one.
TURN_CHUNKS, MOST_TURNS = 2_000_000, 4

_KEYED = "id long, round_no int, page string, k1 long, k2 long, s1 long, s2 long, chunks array<long>, body string"
_ENTRIES = "id long, round_no int, page string, k1 long, k2 long, s1 long, s2 long, chunks binary"
#: Frequencies from here on count as equal.
_OFTEN = U((1 << 26) - 1)


def _prefix_hashes(points: np.ndarray) -> np.ndarray:
    """Polynomial hash of all characters before each position; differences give the hash of any stretch."""
    base = U(0x9E3779B97F4A7C15)
    powers = np.multiply.accumulate(np.full(len(points) + 1, base, U))
    return np.concatenate([np.zeros(1, U), np.add.accumulate(mix(points.astype(U) + U(977)) * powers[:-1])])


def _inverse_powers(n: int) -> np.ndarray:
    inverse = U(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
    return np.multiply.accumulate(np.full(n + 1, inverse, U))


def chunks_of(texts: list[str]) -> list[np.ndarray]:
    """Of each bare text its distinct chunks: 48-bit hashes whose low six bits are the length (63 at most).

    Chunks that agree by chance bring texts together that the sketches or the exact check part again.
    """
    points, starts = letters(texts)
    n = len(points)
    if n <= WINDOW:
        return [np.empty(0, np.int64)] * len(texts)
    prefix, undo = _prefix_hashes(points), _inverse_powers(n)
    step = np.zeros(n - WINDOW + 1, U)
    for k in range(WINDOW):
        step = step * U(0xD1342543DE82EF95) + points[k : n - WINDOW + 1 + k].astype(U)
    average = np.where(points[WINDOW - 1 :] < 0x80, U(AVERAGE_ASCII), U(AVERAGE_OTHER))
    cut = np.flatnonzero(mix(step) % average == 0) + WINDOW
    owner = np.searchsorted(starts, cut - 1, "right") - 1
    within = starts[owner] <= cut - WINDOW  # a window that reaches over the start of a text sets no boundary
    # a text begins and ends with a boundary
    cut = np.concatenate([cut[within], starts[:-1], starts[1:]])
    owner = np.concatenate([owner[within], *[np.arange(len(texts))] * 2])
    place = np.sort((owner << 32) + cut)
    cut, owner = place & 0xFFFFFFFF, place >> 32
    least = np.where(points[np.minimum(cut, n - 1)] < 0x80, LEAST_ASCII, LEAST_OTHER)
    upto = np.searchsorted(cut, cut + least, "left")
    upto = np.where((upto < len(cut)) & (owner[np.minimum(upto, len(cut) - 1)] == owner), upto, -1)
    left, right, owner = cut[upto >= 0], cut[upto[upto >= 0]], owner[upto >= 0]
    h = mix((prefix[right] - prefix[left]) * undo[left])
    h = (h & CHUNK & ~U(63)) | np.minimum(right - left, 63).astype(U)
    if len(texts) <= 1 << 16:
        both = np.sort((owner.astype(U) << U(48)) | h)
        both = both[np.concatenate([[True], both[1:] != both[:-1]])] if len(both) else both
        owner, h = (both >> U(48)).astype(np.int64), (both & CHUNK).view(np.int64)
    else:
        order = np.lexsort((h, owner))
        owner, h = owner[order], h[order].view(np.int64)
        first = np.concatenate([[True], (owner[1:] != owner[:-1]) | (h[1:] != h[:-1])]) if len(h) else np.empty(0, bool)
        owner, h = owner[first], h[first]
    bounds = np.searchsorted(owner, np.arange(len(texts) + 1))
    return [h[a:b] for a, b in zip(bounds[:-1], bounds[1:])]


def _content_keys(bodies: pa.Array) -> tuple[list[str | None], list[tuple]]:
    texts = [t if len(t) >= LEAST_CHARS else None for t in map(bare, bodies.to_pylist())]
    return texts, [content_key(t) if t else (None, None) for t in texts]


def _drawn(texts: list[str]) -> tuple[list[np.ndarray], list[list[int]]]:
    """Chunks and sketch of each bare text."""
    chunks, drawn = [], []
    for a, b in slices(texts):
        chunks += chunks_of(texts[a:b])
        drawn += sketches(texts[a:b]).tolist()
    return chunks, drawn


def _keyed(batches: Iterator[pa.RecordBatch], pack: bool) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, rounds, pages, bodies = (batch.column(i) for i in range(4))
        texts, keys = _content_keys(bodies)
        present, seen = [], set()
        for i, k in enumerate(keys):  # one of a batch's equal texts is enough
            if texts[i] and k not in seen:
                seen.add(k)
                present.append(i)
        chunks, drawn = (dict(zip(present, x)) for x in _drawn([texts[i] for i in present]))
        each = [chunks.get(i, np.empty(0, np.int64)) for i in range(len(texts))]
        drawn = [drawn.get(i, (None, None)) for i in range(len(texts))]
        columns = [ids, rounds, pages, *(pa.array([x[j] for x in pairs], pa.int64()) for pairs in (keys, drawn) for j in (0, 1))]
        if pack:
            columns += [packed_column(each)]
        else:
            offsets = np.concatenate([[0], np.cumsum([len(h) for h in each])]).astype(np.int32)
            columns += [pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(each))), bodies]
        names = [x.split()[0] for x in (_ENTRIES if pack else _KEYED).split(", ")]
        yield pa.RecordBatch.from_arrays(columns, names=names)


def _source(rows: DataFrame) -> DataFrame:
    page = F.nullif(comparable(F.col("url").cast("string")), F.lit(""))
    return rows.select(F.col("entry_id").cast("long"), F.col("round_no").cast("int"), page.alias("page"), F.col("body").cast("string"))


def keyed(rows: DataFrame) -> DataFrame:
    """Of each entry its page, content key, sketch, chunks and body; sketch and chunks of one of a batch's equal texts."""
    return _source(rows).mapInArrow(lambda batches: _keyed(batches, False), _KEYED)


def _entries(rows: DataFrame, path: str) -> DataFrame:
    """The same as a table at `path`, with the chunks packed and without bodies, which so do not move."""
    _source(rows).mapInArrow(lambda batches: _keyed(batches, True), _ENTRIES).write.parquet(path)
    return rows.sparkSession.read.schema(_ENTRIES).parquet(path)


def _classes(entries: DataFrame) -> DataFrame:
    """A row per distinct text: first round, an entry that holds it, and its sketch."""
    each = entries.where(F.col("k1").isNotNull()).groupBy("k1", "k2")
    return written(each.agg(F.min("round_no").alias("round_no"), F.min("id").alias("rep"), F.max("s1").alias("s1"), F.max("s2").alias("s2")), "classes")


def _sought(keys: np.ndarray, owners: np.ndarray, n: int, counters: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of chunks, whose owners (below n) ascend, those that bring records together: (chunks, owners, units), and of each
    owner the units that a pair must share."""
    # from the most frequent chunk on, what makes up less than the least coverage is left out; chunks of one frequency
    # stay in the order that `chunks_of` gives, which is the same for all records
    rare = _OFTEN - np.minimum(frequency(counters, keys), _OFTEN)
    if n <= 1 << 16 and len(keys) <= 1 << 22:
        order = (np.sort((owners.astype(U) << U(48)) | (rare << U(22)) | np.arange(len(keys), dtype=U)) & U((1 << 22) - 1)).astype(np.int64)
    else:
        order = np.argsort((owners << 26) + rare.astype(np.int64), kind="stable")
    keys = keys[order]  # the owners are in order already
    units = (keys & 63).astype(np.int64)
    whole = np.bincount(owners, units, n)
    upto = np.cumsum(units)
    start = np.concatenate([[0], upto])[np.searchsorted(owners, np.arange(n))]
    stay = upto - start[owners] >= LEAST_COVERAGE * whole[owners]
    left_out = np.bincount(owners[~stay], units[~stay], n)
    need = np.maximum(0, np.ceil(LEAST_COVERAGE * whole - left_out)).astype(np.int32)
    return keys[stay], owners[stay], units[stay], need


def _in_turn(keys: np.ndarray, turn: int, turns: int) -> np.ndarray:
    return (keys >> 40) % turns == turn


def _kept(batches: Iterator[pa.RecordBatch], counters: np.ndarray, limits: tuple[float, float] | None, turn: int, turns: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keys, counts = chunks_in(batch.column(3))
        k, s1, s2 = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
        keys, owners, units, need = _sought(keys, np.repeat(np.arange(len(batch)), counts), len(batch), counters)
        now = _in_turn(keys, turn, turns)
        yield row_batch(keys[now], owners[now], k, s1, s2, units[now], need, counters, limits)


def _searched(records: DataFrame, split: bool = True, counters: np.ndarray | None = None, turn: int = 0, turns: int = 1) -> DataFrame:
    """The chunks by which records (`k`, `s1`, `s2`, `chunks`) are brought together, as rows of `_meet.ROWS`.

    split: deal the records of frequent chunks into parts, where rows meet each other; rows that meet held ones are not.
    counters: frequencies of the chunks, counted here if not given. turn: only this one of so many parts of all hashes.
    """
    counters = _frequencies(records) if counters is None else counters
    sent = records.sparkSession.sparkContext.broadcast((counters, hot_above(counters) if split else None))
    return records.select("k", "s1", "s2", "chunks").mapInArrow(lambda batches: _kept(batches, *sent.value, turn, turns), ROWS)


def _packed_rows(batches: Iterator[pa.RecordBatch], counters: np.ndarray, limits: tuple[float, float], turn: int, turns: int, parts: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        every, counts = chunks_in(batch.column(3))
        ends = np.concatenate([[0], np.cumsum(counts)])
        k, s1, s2 = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
        for a, b in record_slices(counts):
            keys, owners, _, need = _sought(every[ends[a] : ends[b]], np.repeat(np.arange(b - a), counts[a:b]), b - a, counters)
            now = _in_turn(keys, turn, turns)
            keys, owners = keys[now], owners[now]
            split, row, part, same = dealt(counters, limits, keys, owners, k[a:b])
            # a chunk that is dealt keeps its length
            split = np.where(split == keys[row], split, (split & int(CHUNK) & ~63) | (keys[row] & 63))
            records = np.column_stack([k[a:b], s1[a:b], s2[a:b], need])
            yield exchanged(split, owners[row], records, part_of(split, parts), MET_WIDTH, None if same.all() else (part << 1) | same)


def _indexed_rows(batches: Iterator[pa.RecordBatch], counters: np.ndarray, buckets: int, turn: int, turns: int, parts: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        every, counts = chunks_in(batch.column(1))
        ends = np.concatenate([[0], np.cumsum(counts)])
        k = batch.column(0).to_numpy(zero_copy_only=False)
        for a, b in record_slices(counts):
            keys, owners = every[ends[a] : ends[b]], np.repeat(np.arange(b - a), counts[a:b])
            bucket = bucket_of(keys, buckets)
            if turns > 1:  # whole buckets in each turn
                now = bucket % turns == turn
                keys, owners, bucket = keys[now], owners[now], bucket[now]
            # some buckets make a part, or some parts a bucket
            group = max(1, buckets // (turns * parts))
            within = max(1, -(-turns * parts // buckets))
            part = bucket // (turns * group) * within + part_of(keys, within)
            # records of a chunk that alone would fill a part are dealt over several
            wide = np.maximum(U(1), frequency(counters, keys) // U(MOST_OF_PART))
            part += buckets * within * (mix(k[a:b].view(U))[owners] % wide).astype(np.int64)
            yield exchanged(keys, owners, k[a:b, None], part, WIDTH)


def _chunk_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([pa.array(chunks_in(batch.column(0))[0])], names=["key"])


def _frequencies(records: DataFrame) -> np.ndarray:
    return frequencies(records, "chunks", lambda column: chunks_in(column)[0])


def _turns(counters: np.ndarray) -> int:
    return int(min(MOST_TURNS, max(1, -(-int(counters.sum()) // TURN_CHUNKS))))


def _let_go(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files that no table needs any more; else they stay until the driver's next collection."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def _drop(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def _shared(records: DataFrame, counters: np.ndarray, held: DataFrame | None = None) -> DataFrame:
    """Pairs (`a`, `b`) of records, or of a record and a held one (`key`, `k`, `s1`, `s2`), as `meeting` finds them, with
    the chunks exchanged in turns; what a pair shares is added up over all turns before it is decided."""
    turns, parts = _turns(counters), []
    many = parts_for(int(counters.sum()) // turns)
    sent = records.sparkSession.sparkContext.broadcast((counters, hot_above(counters)))
    for turn in range(turns):
        if held is None:
            rows = records.select("k", "s1", "s2", "chunks").mapInArrow(lambda batches, turn=turn: _packed_rows(batches, *sent.value, turn, turns, many), EXCHANGED)
            found = meeting_parts(rows)
        else:
            part = held.where(F.pmod(F.shiftright("key", 40), F.lit(turns)) == turn)
            found = meeting(_searched(records, False, counters, turn, turns), part, final=False)
        parts.append(written(found, "turn") if turns > 1 else found)
        if turns > 1:
            rows = found = None  # no table needs the files of this turn any more
            _let_go(records.sparkSession)
    return decided(reduce(DataFrame.union, parts)).select("a", "b")


def _records(entries: DataFrame) -> DataFrame:
    return entries.where(F.length("chunks") > 0).select(F.col("k1").alias("k"), "s1", "s2", "chunks")


def repeats(rows: DataFrame, least: float = LEAST_SHARE) -> DataFrame:
    """Entries (`entry_id`, `by_page`, `by_body`) whose page or body some entry of an earlier round already had.

    rows: (`entry_id` unique, `round_no`, `url`, `body`, any further columns). The whole history in one run, without
    tables on disk; the answer is the same as of `History.append` round by round. Entries of one round are not history for
    each other, and the order of rows does not matter. A null or blank url has no page; a body that is null, or has fewer
    than 200 characters without header and white space, is alike to none. An entry whose round is null is neither a repeat
    nor history. An empty table gives an empty result.
    """
    known = rows.where(F.col("round_no").isNotNull())
    entries = _entries(known, scratch(rows.sparkSession, "entries"))
    classes = _classes(entries)
    records = _records(entries)
    pairs = written(_shared(records, _frequencies(records)), "shared")
    alike = checked_pairs(pairs, classes, rows.select(F.col("entry_id").cast("long").alias("id"), F.col("body").cast("string").alias("body")), least)
    return _decided(entries, entries, classes, written(alike, "alike"))


def _decided(entries: DataFrame, pages_of: DataFrame, classes: DataFrame, alike: DataFrame) -> DataFrame:
    """Entries later than the first round of their page, of their text or of a text alike to it."""
    pages = pages_of.where(F.col("page").isNotNull()).groupBy("page").agg(F.min("round_no").alias("page_round"))
    both = alike.select("a1", "a2", "b1", "b2").union(alike.select("b1", "b2", "a1", "a2")).toDF("k1", "k2", "o1", "o2")
    others = classes.select(F.col("k1").alias("o1"), F.col("k2").alias("o2"), F.col("round_no").alias("r"))
    by_alike = both.join(others, ["o1", "o2"]).select("k1", "k2", "r")
    body = by_alike.union(classes.select("k1", "k2", "round_no")).groupBy("k1", "k2").agg(F.min("r").alias("body_round"))
    return (
        entries.select("id", "round_no", "page", "k1", "k2")
        .join(pages, "page", "left").join(body, ["k1", "k2"], "left")
        .select(
            F.col("id").alias("entry_id"),
            F.coalesce(F.col("page_round") < F.col("round_no"), F.lit(False)).alias("by_page"),
            F.coalesce(F.col("body_round") < F.col("round_no"), F.lit(False)).alias("by_body"),
        )
        .where("by_page or by_body")
    )


class History:
    """What was delivered so far, as tables in a shared folder to which each batch is appended.

    Every batch has a folder of its own with `pages` (page, first round), `records` (content key, first round, sketch,
    text), `chunks` (chunk-to-record, in blocks) and `repeats` (its result), split by hash into `buckets` and sorted. A batch counts
    once its manifest is there, which is written last and renamed into place: a batch that broke off is written anew, and a
    batch that is appended again gives its stored result. `compact` makes one folder of all.

    A batch reads only the buckets that its own pages, content keys and chunks hash to, and no body of the history but
    those of candidates. With many more buckets than a batch has keys the cost of a round follows the round.
    """

    def __init__(self, spark: SparkSession, folder: str, buckets: int = 64) -> None:
        self.spark, self.folder, self.buckets = spark, folder.rstrip("/"), buckets
        self._fs = None

    # files

    def _path(self, name: str):
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        self._fs = self._fs or p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        return p

    def _manifests(self) -> list[dict]:
        path = self._path("manifests")
        if not self._fs.exists(path):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(path)]
        texts = self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils
        out = []
        for name in sorted(n for n in names if n.endswith(".json")):
            stream = self._fs.open(self._path(f"manifests/{name}"))
            try:
                out.append(json.loads(texts.toString(stream, "UTF-8")))
            finally:
                stream.close()
        replaced = {b for m in out for b in m.get("replaces", [])}
        return [m for m in out if m["batch"] not in replaced]

    def _commit(self, manifest: dict) -> None:
        draft, final = self._path(f"manifests/.{manifest['batch']}.draft"), self._path(f"manifests/{manifest['batch']}.json")
        stream = self._fs.create(draft, True)
        stream.write(bytearray(json.dumps(manifest).encode()))
        stream.close()
        if not self._fs.rename(draft, final):
            raise OSError(f"could not write the manifest of batch {manifest['batch']}")

    # tables

    def _bucket(self, key: str):
        # the hash by which Spark shuffles, so that a shuffle by the key leaves each bucket to few tasks
        return F.pmod(F.hash(F.col(key)), F.lit(self.buckets)).cast("int")

    def _read(self, manifests: list[dict], name: str, key: str, wanted: DataFrame) -> DataFrame | None:
        """Rows of the history whose key is among those wanted; only buckets that some wanted key hashes to are read."""
        paths = [f"{self.folder}/{m['folder']}/{name}" for m in manifests if name in m["tables"]]
        if not paths:
            return None
        chunks = name == "chunks"
        bucket = F.pmod(F.shiftright(key, 6), F.lit(self.buckets)).cast("int") if chunks else self._bucket(key)  # as `_indexed_rows` has it
        keys = written(wanted.select(key, bucket.alias("bucket")).distinct(), "wanted")
        buckets = [r[0] for r in keys.select("bucket").distinct().collect()]  # no more than `buckets`
        held = self._table(paths, BLOCKS if chunks else None).where(F.col("bucket").isin(buckets))
        return (unblocked(held) if chunks else held).join(keys.select(key), key, "left_semi")

    def _table(self, paths: list[str], form: str | None = None) -> DataFrame:
        # each batch is a table of its own, with its buckets
        tables = [(self.spark.read.schema(form) if form else self.spark.read).parquet(p) for p in paths]
        return reduce(DataFrame.union, (t.select(*tables[0].columns) for t in tables))

    def _write(self, folder: str, name: str, df: DataFrame, key: str) -> None:
        self._write_buckets(folder, name, df.withColumn("bucket", self._bucket(key)).sortWithinPartitions("bucket", key))

    def _write_buckets(self, folder: str, name: str, df: DataFrame, mode: str = "overwrite") -> None:
        df.write.mode(mode).option("compression", "zstd").option("parquet.enable.dictionary", "false").partitionBy("bucket").parquet(f"{self.folder}/{folder}/{name}")

    def append(self, batch: DataFrame, least: float = LEAST_SHARE, number: str | None = None) -> DataFrame:
        """Repeats of a batch of one or more rounds, as `repeats` gives them; then the batch becomes history.

        Rounds must not come before rounds that are history already. number: name of the batch, by default its rounds; a
        batch of that name that is history already is not appended again, and its stored repeats are given.
        """
        manifests = self._manifests()
        rows = batch.where(F.col("round_no").isNotNull()).select(F.col("entry_id").cast("long").alias("entry_id"), F.col("round_no").cast("int").alias("round_no"), "url", F.col("body").cast("string").alias("body"))
        if number is None:
            first, last = rows.agg(F.min("round_no"), F.max("round_no")).first()
            number = f"{first}-{last}"
        folder = f"batch={number}"
        done = [m for m in manifests if number == m["batch"] or number in m.get("all", [])]
        if done:
            return self.spark.read.parquet(f"{self.folder}/{folder}/repeats")
        place = scratch(self.spark, "entries")
        entries = _entries(rows, place)
        classes = _classes(entries)
        records = _records(entries)
        counters = _frequencies(records)
        pairs = _shared(records, counters)
        held_chunks = self._read(manifests, "chunks", "key", records.select("chunks").mapInArrow(_chunk_rows, "key long"))
        if held_chunks is not None:
            held_chunks = written(held_chunks.select("key", "k"), "met")
            drawn = self._read(manifests, "records", "k1", held_chunks.select(F.col("k").alias("k1"))).select(F.col("k1").alias("k"), "s1", "s2")
            pairs = pairs.union(_shared(records, counters, held_chunks.join(drawn, "k"))).distinct()
        pairs = written(pairs, "shared")
        own = classes.join(rows.select(F.col("entry_id").alias("rep"), "body"), "rep").drop("rep")
        ends = pairs.select(F.explode(F.array("a", "b")).alias("k1")).union(classes.select("k1"))
        old_records = self._read(manifests, "records", "k1", ends)
        if old_records is None:
            known, texts = classes, rows.select(F.col("entry_id").alias("id"), "body")
        else:
            known = own.select("k1", "k2", "round_no", "body").union(old_records.select("k1", "k2", "round_no", "body"))
            known = written(known.groupBy("k1", "k2").agg(F.min("round_no").alias("round_no"), F.first("body").alias("body")), "known").withColumn("rep", F.concat_ws("/", "k1", "k2"))
            texts = known.select(F.col("rep").alias("id"), "body")
        alike = written(checked_pairs(pairs, known.select("k1", "k2", "rep"), texts, least), "alike")
        _let_go(self.spark)
        old_pages = self._read(manifests, "pages", "page", entries.where(F.col("page").isNotNull()))
        pages_of = entries.select("page", "round_no")
        if old_pages is not None:
            pages_of = pages_of.union(old_pages.select("page", "round_no"))
        _decided(entries, pages_of, known.select("k1", "k2", "round_no"), alike).write.mode("overwrite").parquet(f"{self.folder}/{folder}/repeats")
        new_pages = entries.where(F.col("page").isNotNull()).groupBy("page").agg(F.min("round_no").alias("round_no"))
        if old_pages is not None:
            new_pages = new_pages.join(old_pages.select("page").distinct(), "page", "left_anti")
        if old_records is not None:
            held = written(old_records.select("k1", "k2").distinct(), "held")
            own = own.join(held, ["k1", "k2"], "left_anti")
            records = records.join(held.select(F.col("k1").alias("k")), "k", "left_anti")
        self._write(folder, "pages", new_pages, "page")
        buckets, turns = self.buckets, min(_turns(counters), self.buckets)
        parts, sent = parts_for(int(counters.sum()) // turns), self.spark.sparkContext.broadcast(counters)
        for turn in range(turns):
            part = records.select("k", "chunks").mapInArrow(lambda batches, turn=turn: _indexed_rows(batches, sent.value, buckets, turn, turns, parts), EXCHANGED)
            self._write_buckets(folder, "chunks", blocks(part, self.buckets), "append" if turn else "overwrite")
            part = None
            _let_go(self.spark)
        _drop(self.spark, place)  # the chunks are in the history, and the rest is not read again
        self._write(folder, "records", own, "k1")
        self._commit({"batch": number, "folder": folder, "tables": ["pages", "chunks", "records"]})
        return self.spark.read.parquet(f"{self.folder}/{folder}/repeats")

    def accepted(self, rows: DataFrame, batch_rows: int = BATCH_ROWS, least: float = LEAST_SHARE) -> DataFrame:
        """Repeats of a table of many rounds, appended in batches of whole rounds with about `batch_rows` rows each.

        What is a repeat does not depend on the batches. Rounds are weighed by their rows; a round of more rows than that
        is a batch of its own.
        """
        known = rows.where(F.col("round_no").isNotNull())
        steps = max(1, -(-known.count() // batch_rows))
        edges = known.select(F.percentile_approx("round_no", [i / steps for i in range(1, steps)], 100_000)).first()[0] if steps > 1 else []
        bounds = [None, *sorted(set(edges)), None]
        out = None
        for low, high in zip(bounds[:-1], bounds[1:]):
            part = known if low is None else known.where(F.col("round_no") > low)
            part = part if high is None else part.where(F.col("round_no") <= high)
            found = self.append(part, least, f"{'' if low is None else low + 1}-{'' if high is None else high}")
            out = found if out is None else out.union(found)
        return out

    def compact(self) -> None:
        """One folder of all batches, so that later reads open fewer files. Tables of the old folders go, their repeats stay."""
        manifests = self._manifests()
        if len(manifests) < 2:
            return
        number = f"compact-{len(manifests)}-{manifests[-1]['batch']}"
        folder = f"batch={number}"
        for name, key in (("pages", "page"), ("chunks", None), ("records", "k1")):
            paths = [f"{self.folder}/{m['folder']}/{name}" for m in manifests]
            if name == "chunks":  # blocks stay as they are, those of a bucket in one place
                self._write_buckets(folder, name, self._table(paths, BLOCKS).repartition("bucket"))
            else:
                self._write(folder, name, self._table(paths).drop("bucket"), key)
        every = [b for m in manifests for b in m.get("all", [m["batch"]])]
        self._commit({"batch": number, "folder": folder, "tables": ["pages", "chunks", "records"], "replaces": [m["batch"] for m in manifests], "all": every})
        for m in manifests:
            for name in m["tables"]:
                self._fs.delete(self._path(f"{m['folder']}/{name}"), True)

