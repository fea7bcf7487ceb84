"""Token ids in binary shards, with a minimal perfect hash index for keyed access.

Layout below one folder of the shared storage:
  shard-00000-00000.bin  header (magic, id width, shard number), then the raw little-endian ids of its
                         documents, one after the other
  index-00000.mph        minimal perfect hash of the document keys whose hash falls into this part, and
                         for each slot a fingerprint, shard number, first id and number of ids
Documents lie in ascending order of doc_id over all shards: they are range-partitioned by doc_id and
sorted; the task of a range goes on to its next shard after SHARD_IDS ids, and an index part has about
PART_KEYS keys, so files keep their size whatever the data's. Ids take two bytes when the vocabulary
allows it, else four.

The hash function of an index part is a cascade of bit arrays: each level hashes the keys that are
left into a bit array, keys alone in their place stay there, the others go on; the rank of a set bit
is the slot. Beside the bits stands the rank at every BLOCK bits, so one key takes a few reads of some
bytes (find_one): constant time, whatever the size of the part. Lookups of many keys read each part
once. A lookup compares the stored fingerprint and gives shard, first id and count. Files are written
under a temporary name and moved into place, so a repeated task leaves the same file.

Defined cases: a null text counts as empty; every document ends with the end id, so none is empty;
repeated ids and null ids (sorted first) are kept, each row is a document, the index numbers equal ids
by their order (that of the first ORDER_CHARS characters of their texts, then any) and lookups ask for (doc_id, number);
further columns are ignored; an empty table gives no shards and no rows. Rows of one id may lie in several tasks; their
numbers go on from task to task.
"""

from __future__ import annotations

import struct
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .bpe import slices
from .common import fresh_path
from .units import UnitStore

SHARD_MAGIC, INDEX_MAGIC = b"IDSHARD1", b"IDINDEX1"
SHARD_HEAD, INDEX_HEAD = "<8sIQ", "<8sII"
SHARD_IDS = 1 << 26  # ids after which a task begins its next shard
PART_KEYS = 1 << 20  # keys of an index part
PER_TASK = 20  # bits of a shard's number that count the shards of one task
BLOCK = 512  # bits between two stored ranks
ORDER_CHARS = 24  # first characters of a text by which rows of one id are ordered
JOINED = 256  # units that are encoded as one text


@cache
def _units(path: str) -> UnitStore:
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)
    lengths = np.array([len(tok.id_to_token(i) or "") for i in range(tok.get_vocab_size())])  # one character for each byte

    def ids_of(texts):
        done = [e.ids for e in tok.encode_batch_fast(texts, add_special_tokens=False)]
        sizes = np.fromiter(map(len, done), np.int64, len(done))
        return np.fromiter(chain.from_iterable(done), np.uint32, int(sizes.sum())), sizes

    def encode(texts, inner):
        if not inner:
            return ids_of(texts)
        # Inner units leave their neighbours alone, so many go through the tokenizer in one text; the
        # bytes of the tokens tell where each unit ends.
        ids, _ = ids_of([" " + " ".join(texts[i : i + JOINED]) for i in range(0, len(texts), JOINED)])
        bytes_of = pc.binary_length(pa.array(texts, pa.string())).to_numpy().astype(np.int64) + 1
        ends = np.searchsorted(np.cumsum(lengths[ids]), np.cumsum(bytes_of)) + 1
        return ids, np.diff(ends, prepend=0)

    return UnitStore(encode, np.uint32, 500_000)


@cache
def _special(path: str) -> tuple[dict[str, int], int]:
    """Added tokens with their ids, and the number of ids."""
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)
    return {t.content: i for i, t in tok.get_added_tokens_decoder().items()}, tok.get_vocab_size(with_added_tokens=True)


def encode_ids(path: str, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """texts (no nulls) -> the tokenizer's ids of all texts in one array, and where each text ends."""
    import re

    special, _ = _special(path)
    cut = re.compile("|".join(map(re.escape, sorted(special, key=len, reverse=True)))) if special else None
    marked = np.zeros(len(texts), bool)
    for token in special:
        marked |= pc.match_substring(texts, token).to_numpy(zero_copy_only=False)
    if not marked.any():
        return _units(path).many(texts)
    # Special tokens split a text before anything else.
    parts, numbers = [], []
    for t, m in zip(texts.to_pylist(), marked.tolist(), strict=True):
        parts.append(cut.split(t) if m else [t])
        numbers.append([special[s] for s in cut.findall(t)] if m else [])
    ids, ends = _units(path).many(pa.array([p for ps in parts for p in ps], pa.string()))
    runs, out, at, n = np.split(ids, ends[:-1]), [], 0, []
    for found in numbers:
        own = [runs[at]]
        for i, special_id in enumerate(found):
            own += [np.array([special_id], np.uint32), runs[at + i + 1]]
        at += len(found) + 1
        out += own
        n.append(sum(map(len, own)))
    return np.concatenate(out), np.cumsum(n)


def _mix(keys: np.ndarray, seed: int) -> np.ndarray:
    """A 64-bit finaliser over unsigned keys."""
    with np.errstate(over="ignore"):
        x = keys + np.uint64((0x9E3779B97F4A7C15 * (seed + 1)) & 0xFFFFFFFFFFFFFFFF)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def build_mph(keys: np.ndarray, gamma: float = 1.5) -> list[np.ndarray]:
    """Bit arrays of the levels for distinct unsigned 64-bit keys."""
    levels, left = [], keys
    while len(left):
        size = max(8, int(len(left) * gamma) | 1)
        at = (_mix(left, len(levels)) % np.uint64(size)).astype(np.int64)
        alone = np.bincount(at, minlength=size) == 1
        levels.append(alone)
        left = left[~alone[at]]
        if len(levels) > 200:
            raise ValueError("keys are not distinct")
    return levels


def mph_slots(levels: list[np.ndarray], keys: np.ndarray) -> np.ndarray:
    """Slot of each key; a key that was not indexed gets any slot or -1."""
    slots, before = np.full(len(keys), -1, np.int64), 0
    left = np.arange(len(keys))
    for k, bits in enumerate(levels):
        at = (_mix(keys[left], k) % np.uint64(len(bits))).astype(np.int64)
        ranks = np.cumsum(bits) - 1
        here = bits[at]
        slots[left[here]] = before + ranks[at[here]]
        before += int(bits.sum())
        left = left[~here]
    return slots


def _write(uri: str, data: list[bytes]) -> None:
    where, path = fs.FileSystem.from_uri(uri)
    temp = f"{path}.{np.random.default_rng().integers(1 << 62):x}.tmp"
    with where.open_output_stream(temp) as out:
        for d in data:
            out.write(d)
    where.move(temp, path)


def _read(uri: str) -> bytes:
    where, path = fs.FileSystem.from_uri(uri)
    with where.open_input_stream(path) as f:
        return f.read()


def shard_uri(path: str, shard: int) -> str:
    return f"{path}/shard-{shard >> PER_TASK:05d}-{shard & ((1 << PER_TASK) - 1):05d}.bin"


class ShardWriter:
    """Shards of one task, one after the other."""

    def __init__(self, path: str, first: int, width: int, most: int):
        self.path, self.shard, self.width, self.most, self.out, self.at = path, first - 1, width, most, None, 0

    def add(self, ids: np.ndarray) -> tuple[int, int]:
        """Appends the ids of some documents; -> the shard and the place of the first id in it."""
        if self.out is None or self.at >= self.most:
            self.close()
            self.shard, self.at = self.shard + 1, 0
            self.where, self.target = fs.FileSystem.from_uri(shard_uri(self.path, self.shard))
            self.temp = f"{self.target}.{np.random.default_rng().integers(1 << 62):x}.tmp"
            self.out = self.where.open_output_stream(self.temp)
            self.out.write(struct.pack(SHARD_HEAD, SHARD_MAGIC, self.width, self.shard))
        place, self.at = self.at, self.at + len(ids)
        self.out.write(ids.astype(f"<u{self.width}").tobytes())
        return self.shard, place

    def close(self) -> None:
        if self.out is not None:
            self.out.close()
            self.where.move(self.temp, self.target)
            self.out = None


def with_end(ids: np.ndarray, ends: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids of texts, given by where each ends, with the end id after each; -> them and each one's count."""
    out = np.full(len(ids) + len(ends), end_id, np.uint32)
    counts = np.diff(ends, prepend=0)
    out[np.arange(len(ids)) + np.repeat(np.arange(len(ends)), counts)] = ids
    return out, counts + 1


def write_shards(docs: DataFrame, path: str, tokenizer: str, end_id: int, tasks: int | None = None, shard_ids: int = SHARD_IDS) -> DataFrame:
    """Writes the shards; -> entries: doc_id, number, shard, first, n_tokens (stored). docs: doc_id, text."""
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    n = tasks or int(spark.conf.get("spark.sql.shuffle.partitions"))
    # Rows of one id may be a third of all: they are dealt to several tasks too, by how their texts begin and by their place.
    order = [F.asc_nulls_first("doc_id"), F.asc("_head"), F.asc("_row")]
    rows = rows.withColumns({"_head": F.substring("text", 1, ORDER_CHARS), "_row": F.monotonically_increasing_id()}).repartitionByRange(n, *order).sortWithinPartitions(*order).drop("_head", "_row")

    def run(batches):
        from pyspark import TaskContext

        width = 4 if max(_special(tokenizer)[1], end_id + 1) > 1 << 16 else 2
        writer = ShardWriter(path, TaskContext.get().partitionId() << PER_TASK, width, shard_ids)
        last, number = (), 0
        for big in batches:
            for batch in slices(big, "text"):
                ids, counts = with_end(*encode_ids(tokenizer, batch.column("text")), end_id)
                shard, place = writer.add(ids)
                numbers = []
                for key in batch.column("doc_id").to_pylist():
                    number = number + 1 if (key,) == last else 0
                    last = (key,)
                    numbers.append(number)
                columns = [pa.array(numbers, pa.int64()), pa.array(np.full(len(counts), shard, np.int64)), pa.array(place + np.cumsum(counts) - counts), pa.array(counts)]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], names=["doc_id", "number", "shard", "first", "n_tokens"])
        writer.close()

    where, local = fs.FileSystem.from_uri(path)
    where.create_dir(local)
    entries = rows.mapInArrow(run, "doc_id bigint, number bigint, shard bigint, first bigint, n_tokens bigint")
    kept = f"{path}/entries"
    entries.write.parquet(kept)
    return numbered(spark.read.schema(entries.schema).parquet(kept), f"{path}/numbered")


def numbered(entries: DataFrame, kept: str) -> DataFrame:
    """entries with numbers that go on where the rows of one id lie in several tasks. Only the last id of a task can go
    on in the next one, so these ids are at most as many as tasks."""
    spark, task = entries.sparkSession, F.shiftright("shard", PER_TASK)
    rows = entries.withColumn("_task", task)
    same = lambda a, b: F.col(a).eqNullSafe(F.col(b))
    ends = rows.groupBy("_task").agg(F.max(F.struct(F.col("doc_id").isNotNull().alias("known"), "doc_id")).alias("e"))
    last = ends.select(F.col("e.doc_id").alias("_id")).distinct()
    parts = rows.join(F.broadcast(last), same("doc_id", "_id"), "left_semi").groupBy("_task", "doc_id").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("doc_id").orderBy("_task").rowsBetween(Window.unboundedPreceding, -1))
    shifts = parts.select(F.col("_task").alias("_t"), F.col("doc_id").alias("_id"), before.alias("_shift")).where("_shift > 0")
    shifts = spark.createDataFrame(shifts.collect(), shifts.schema)  # at most one row for each task
    if shifts.isEmpty():
        return entries
    joined = rows.join(F.broadcast(shifts), (F.col("_task") == F.col("_t")) & same("doc_id", "_id"), "left")
    out = joined.select("doc_id", (F.col("number") + F.coalesce("_shift", F.lit(0))).alias("number"), "shard", "first", "n_tokens")
    out.write.parquet(kept)
    return spark.read.schema(entries.schema).parquet(kept)


def key_hash():
    """The 64-bit key of (doc_id, number)."""
    return F.xxhash64(F.coalesce("doc_id", F.lit(0).cast("bigint")), "number", F.col("doc_id").isNull())


def key_of(doc_id: int | None, number: int) -> int:
    """key_hash() of one key, in Python."""
    from xxhash import xxh64_intdigest

    seed = xxh64_intdigest(struct.pack("<q", number), xxh64_intdigest(struct.pack("<q", doc_id or 0), 42))
    return xxh64_intdigest(struct.pack("<i", doc_id is None), seed)


FIELDS = [("fingerprint", np.uint32), ("shard", np.int64), ("first", np.int64), ("n_tokens", np.int64)]


def _fingerprints(keys: np.ndarray) -> np.ndarray:
    return (_mix(keys, 977) >> np.uint64(32)).astype(np.uint32)


def _by_part(rows: DataFrame, parts: int) -> DataFrame:
    rows = rows.withColumn("key", key_hash()).withColumn("part", F.pmod(F.shiftrightunsigned("key", 40), F.lit(parts)).cast("int"))
    return rows.repartition(parts, "part").sortWithinPartitions("part")


def _runs(batches, column: str):
    """Batches of a sorted partition -> (value, table) for each run of equal values."""
    held = []
    for b in batches:
        while b.num_rows:
            values = b.column(column)
            value = values[0].as_py()
            if held and held[0].column(column)[0].as_py() != value:
                yield held[0].column(column)[0].as_py(), pa.Table.from_batches(held)
                held = []
            differ = np.flatnonzero(values.to_numpy(zero_copy_only=False) != value)
            end = int(differ[0]) if len(differ) else b.num_rows
            held.append(b.slice(0, end))
            b = b.slice(end)
    if held:
        yield held[0].column(column)[0].as_py(), pa.Table.from_batches(held)


def part_count(entries: DataFrame) -> int:
    return 1 + entries.count() // PART_KEYS


def write_index(entries: DataFrame, path: str, parts: int) -> int:
    """Writes one index file for each part of the keys; -> how many keys are indexed."""

    def run(batches):
        for part, t in _runs(batches, "part"):
            keys = t.column("key").to_numpy().view(np.uint64)
            levels = build_mph(keys)
            slot = mph_slots(levels, keys)
            data = [struct.pack(INDEX_HEAD, INDEX_MAGIC, len(keys), len(levels)), struct.pack(f"<{len(levels)}I", *map(len, levels))]
            before = 0
            for bits in levels:
                ones = np.add.reduceat(bits, np.arange(0, len(bits), BLOCK), dtype=np.int64)
                data += [(before + np.cumsum(ones) - ones).astype("<u4").tobytes(), np.packbits(bits, bitorder="little").tobytes()]
                before += int(ones.sum())
            stored = {"fingerprint": _fingerprints(keys), **{f: t.column(f).to_numpy() for f, _ in FIELDS[1:]}}
            for name, kind in FIELDS:
                column = np.empty(len(keys), kind)
                column[slot] = stored[name]
                data.append(column.tobytes())
            _write(f"{path}/index-{part:05d}.mph", data)
            yield pa.RecordBatch.from_arrays([pa.array([len(keys)], pa.int64())], names=["n"])

    return _by_part(entries, parts).select("part", "key", "shard", "first", "n_tokens").mapInArrow(run, "n bigint").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def read_index(data: bytes):
    """-> levels, {field: column by slot}"""
    magic, n, depth = struct.unpack_from(INDEX_HEAD, data)
    if magic != INDEX_MAGIC:
        raise ValueError("not an index file")
    at = struct.calcsize(INDEX_HEAD)
    sizes = struct.unpack_from(f"<{depth}I", data, at)
    at += 4 * depth
    levels = []
    for s in sizes:
        at += 4 * -(-s // BLOCK)
        levels.append(np.unpackbits(np.frombuffer(data, np.uint8, -(-s // 8), at), bitorder="little")[:s].astype(bool))
        at += -(-s // 8)
    columns = {}
    for name, kind in FIELDS:
        columns[name] = np.frombuffer(data, kind, n, at)
        at += n * np.dtype(kind).itemsize
    return levels, columns


def find_one(path: str, parts: int, doc_id: int | None, number: int = 0) -> tuple[int, int, int] | None:
    """(shard, first, n_tokens) of one key, or None: a few reads of some bytes each."""
    key = key_of(doc_id, number)
    where, name = fs.FileSystem.from_uri(f"{path}/index-{(key >> 40) % parts:05d}.mph")
    if where.get_file_info(name).type == fs.FileType.NotFound:
        return None
    own = np.array([key], np.uint64)
    with where.open_input_file(name) as f:
        magic, n, depth = struct.unpack(INDEX_HEAD, f.read_at(struct.calcsize(INDEX_HEAD), 0))
        if magic != INDEX_MAGIC:
            raise ValueError(f"{name} is not an index file")
        at = struct.calcsize(INDEX_HEAD)
        sizes = struct.unpack(f"<{depth}I", f.read_at(4 * depth, at))
        at, slot = at + 4 * depth, None
        starts = [at + sum(4 * -(-s // BLOCK) - (-s // 8) for s in sizes[:k]) for k in range(depth + 1)]
        for k, size in enumerate(sizes):
            bit = int(_mix(own, k)[0] % np.uint64(size))
            block = int.from_bytes(f.read_at(min(BLOCK // 8, -(-size // 8) - bit // BLOCK * BLOCK // 8), starts[k] + 4 * -(-size // BLOCK) + bit // BLOCK * BLOCK // 8), "little")
            if block >> bit % BLOCK & 1:
                slot = struct.unpack("<I", f.read_at(4, starts[k] + 4 * (bit // BLOCK)))[0] + (block & ((1 << bit % BLOCK) - 1)).bit_count()
                break
        if slot is None:
            return None
        at, got = starts[-1], []
        for _, kind in FIELDS:
            width = np.dtype(kind).itemsize
            got.append(int(np.frombuffer(f.read_at(width, at + slot * width), kind)[0]))
            at += n * width
    return tuple(got[1:]) if got[0] == int(_fingerprints(own)[0]) else None


def read_one(path: str, parts: int, doc_id: int | None, number: int = 0) -> np.ndarray | None:
    """The ids of one document through the index, or None."""
    found = find_one(path, parts, doc_id, number)
    if found is None:
        return None
    shard, first, count = found
    where, name = fs.FileSystem.from_uri(shard_uri(path, shard))
    with where.open_input_file(name) as f:
        head = struct.calcsize(SHARD_HEAD)
        _, width, _ = struct.unpack(SHARD_HEAD, f.read_at(head, 0))
        return np.frombuffer(f.read_at(count * width, head + first * width), f"<u{width}").astype("<u4")


def lookup(keys: DataFrame, path: str, parts: int) -> DataFrame:
    """keys (doc_id, number) -> doc_id, number, shard, first, n_tokens through the index; keys that were
    not indexed are told by their fingerprint and give no row (a wrong match has odds 2^-32)."""

    def run(batches):
        for part, t in _runs(batches, "part"):
            where, name = fs.FileSystem.from_uri(f"{path}/index-{part:05d}.mph")
            if where.get_file_info(name).type == fs.FileType.NotFound:
                continue
            levels, columns = read_index(_read(f"{path}/index-{part:05d}.mph"))
            own = t.column("key").to_numpy().view(np.uint64)
            slot = mph_slots(levels, own)
            good = np.flatnonzero((slot >= 0) & (columns["fingerprint"][slot] == _fingerprints(own)))
            yield from pa.table([t.column("doc_id").take(pa.array(good)), t.column("number").take(pa.array(good)), *[pa.array(columns[f][slot[good]]) for f, _ in FIELDS[1:]]], names=["doc_id", "number", "shard", "first", "n_tokens"]).to_batches()

    return _by_part(keys.select("doc_id", "number"), parts).select("part", "key", "doc_id", "number").mapInArrow(run, "doc_id bigint, number bigint, shard bigint, first bigint, n_tokens bigint")


def read_ids(places: DataFrame, path: str) -> DataFrame:
    """places (doc_id, number, shard, first, n_tokens) -> the same with ids (binary, little-endian
    unsigned 32-bit), read from the shards; each shard is read front to back by one task."""
    n = places.sparkSession.conf.get("spark.sql.shuffle.partitions")
    rows = places.select("doc_id", "number", "shard", "first", "n_tokens").repartition(int(n), "shard").sortWithinPartitions("shard", "first")

    def run(batches):
        now, file, width = None, None, 0
        for b in batches:
            shards, firsts, counts = (b.column(c).to_pylist() for c in ("shard", "first", "n_tokens"))
            ids, size, start = [], 0, 0
            for i, (shard, first, count) in enumerate(zip(shards, firsts, counts, strict=True)):
                if shard != now:
                    where, name = fs.FileSystem.from_uri(shard_uri(path, shard))
                    file, now = where.open_input_file(name), shard
                    magic, width, own = struct.unpack(SHARD_HEAD, file.read(struct.calcsize(SHARD_HEAD)))
                    if magic != SHARD_MAGIC or own != shard:
                        raise ValueError(f"{name} is not shard {shard}")
                data = file.read_at(count * width, struct.calcsize(SHARD_HEAD) + first * width)
                ids.append(np.frombuffer(data, f"<u{width}").astype("<u4").tobytes())
                size += 4 * count
                if size > 1 << 24 or i + 1 == b.num_rows:
                    part = b.slice(start, i + 1 - start)
                    yield pa.RecordBatch.from_arrays([*part.columns, pa.array(ids, pa.binary())], names=[*b.schema.names, "ids"])
                    ids, size, start = [], 0, i + 1

    return rows.mapInArrow(run, "doc_id bigint, number bigint, shard bigint, first bigint, n_tokens bigint, ids binary")


def with_start(places: DataFrame, entries: DataFrame) -> DataFrame:
    """Adds start: the ids of all documents before. Totals of shards are few, one row for each shard."""
    totals = entries.groupBy("shard").agg(F.sum("n_tokens").alias("total"))
    bases = totals.select(F.col("shard").alias("of"), (F.sum("total").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1))).alias("base"))
    return places.join(bases, F.col("shard") == F.col("of")).withColumn("start", F.coalesce("base", F.lit(0)) + F.col("first")).drop("of", "base")


def new_store(spark: SparkSession) -> str:
    return fresh_path(spark, "ids")
