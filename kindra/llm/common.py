"""Helpers shared by the training-data operators: reading tables, shared scratch tables, Arrow chunks, word hashes."""

from __future__ import annotations

import atexit
import gc
import uuid
import weakref
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that the numpy operators work on at a time; a longer document forms a chunk of its own.
CHUNK_BYTES = 2 << 20
#: Bytes of one Arrow batch on its way to a Python worker or back.
BATCH_BYTES = 4 << 20
#: A null doc_id sorts behind every real one.
NULL_ID = (1 << 63) - 1
_SPACE = np.zeros(256, np.bool_)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bounded_batches(df: DataFrame) -> DataFrame:
    """Arrow batches are bounded by rows alone unless told otherwise; long texts need a bound in bytes."""
    conf, name = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    now = conf.get(name, None)
    if now is None or not now.isdigit() or int(now) > BATCH_BYTES:
        conf.set(name, str(BATCH_BYTES))
    return df


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


# --------------------------------------------------------------------------- scratch tables


def _delete(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # noqa: BLE001  the session may be gone; scratch of an ended application is the folder owner's to remove
        pass


def scratch_dir(spark: SparkSession) -> str:
    """The cluster's shared checkpoint folder. Where none is set, a folder under the warehouse serves on a single machine
    (tests); elsewhere that could be a folder of one machine, so it is an error."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all machines share")
        base = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_scratch"
    return base.rstrip("/")


class Scratch:
    """A table written to the shared folder. It cuts lineage, survives lost executors and goes with its last user.

    A result that reads it is returned through ``holding``; ``drop`` removes it at once.
    """

    def __init__(self, df: DataFrame, label: str) -> None:
        spark = df.sparkSession
        self.path = f"{scratch_dir(spark)}/{label}-{uuid.uuid4().hex}"
        df.write.option("compression", "zstd").parquet(self.path)
        self.spark, self.schema = spark, df.schema
        self._gone = weakref.finalize(self, _delete, spark, self.path)
        self._gone.atexit = False
        atexit.register(self._gone)

    def read(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(self.path)

    def keep(self) -> DataFrame:
        """What was written, for as long as the application runs or until ``drop_scratch``."""
        return holding(self.read(), self)

    def drop(self) -> None:
        self._gone()


def free_shuffles(spark: SparkSession) -> None:
    """Spark removes the shuffle files of plans that nothing refers to any more, but only learns of them when the driver
    collects garbage, which a long chain of small driver steps hardly ever makes it do."""
    gc.collect()
    spark._jvm.System.gc()


def holding(df: DataFrame, *scratches: Scratch) -> DataFrame:
    """``df`` keeps the scratch tables it reads. They live until the application ends, as frames derived from it read them too."""
    _KEPT.extend(scratches)
    return df


_KEPT: list[Scratch] = []


def kept_scratch() -> int:
    """A mark for ``drop_scratch``."""
    return len(_KEPT)


def drop_scratch(mark: int = 0) -> None:
    """Drops the scratch tables kept since ``mark``, for results that have been written elsewhere."""
    while len(_KEPT) > mark:
        _KEPT.pop().drop()


# --------------------------------------------------------------------------- Arrow batches


def blob_list(column: pa.Array) -> list[bytes | None]:
    """UTF-8 bytes of a string column."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if pa.types.is_large_string(column.type):
        return column.cast(pa.large_binary()).to_pylist()
    return column.cast(pa.string()).cast(pa.binary()).to_pylist()


def id_array(column: pa.Array) -> np.ndarray:
    return np.array([NULL_ID if x is None else x for x in column.to_pylist()], np.int64)


def chunks(batches: Iterable[pa.RecordBatch], text: str = "text", limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of the batches whose texts hold ``limit`` bytes or are one row."""
    pa.set_memory_pool(pa.system_memory_pool())  # gives freed batches back at once
    for batch in batches:
        if batch.num_rows == 0:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(text))), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        ends, at = np.cumsum(sizes), 0
        while at < len(sizes):
            base = ends[at - 1] if at else 0
            stop = max(at + 1, int(np.searchsorted(ends, base + limit, "right")))
            yield batch.slice(at, stop - at)
            at = stop


def whole_groups(batches: Iterable[pa.RecordBatch], key: tuple[str, ...], columns: tuple[str, ...]) -> Iterator[list[np.ndarray]]:
    """Stretches of whole groups of rows that are sorted by ``key`` (the first columns): a group never spans two of them."""
    held: list[list[np.ndarray]] = []
    for batch in batches:
        rows = [column_of(batch, c).to_numpy(zero_copy_only=False) for c in columns]
        if len(rows[0]) == 0:
            continue
        same = np.ones(len(rows[0]), np.bool_)
        for c in rows[: len(key)]:
            same &= c == c[-1]
        last = int(np.argmax(same))  # where the last group starts
        if last == 0 and held and all(h[-1] == c[0] for h, c in zip(held[-1][: len(key)], rows, strict=False)):
            held.append(rows)
            continue
        yield [np.concatenate(c) for c in zip(*held, [r[:last] for r in rows], strict=True)]
        held = [[r[last:] for r in rows]]
    if held:
        yield [np.concatenate(c) for c in zip(*held, strict=True)]


def heads_of(columns: list[np.ndarray]) -> np.ndarray:
    """Where the groups of equal values in sorted columns start, and the end."""
    n = len(columns[0])
    new = np.zeros(n, np.bool_)
    new[:1] = True
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    return np.append(np.flatnonzero(new), n)


def column_of(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def held_out(doc_id: str = "doc_id") -> F.Column:
    """The rows that no fit may see: crc32(doc_id as text) mod 4 is 2. A null id is not held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 4 == 2, F.lit(False))


def spread_text(text: F.Column, chars: int, windows: int = 10) -> F.Column:
    """The text; of one over ``chars`` characters, ``windows`` stretches spread evenly over the whole of it, a line break apart.
    Fits read texts so: none is left out for its length, and none outgrows the bound."""
    size = chars // windows
    pieces = F.transform(F.sequence(F.lit(0), F.lit(windows - 1)), lambda i: F.substr(text, (i * (F.length(text) - size) / (windows - 1)).cast("int") + 1, F.lit(size)))
    return F.when(F.length(text) <= chars, text).otherwise(F.array_join(pieces, "\n"))


def labelled_texts(documents: DataFrame, labels: DataFrame, per_label: int, chars: int, salt: str, unseen: bool = False) -> tuple[list[bytes], list[bytes]]:
    """Texts of label 0 and of label 1: of at most ``per_label`` documents of each, drawn by a hash among the rows that are not
    held out (with ``unseen``: that are) and have a word. Documents with labels that differ are left out.

    Only ids meet the labels; the texts of those chosen, a bounded number, are fetched afterwards."""
    some = labels.where(held_out() if unseen else ~held_out()).where("quality IN (0, 1) AND doc_id IS NOT NULL")
    known = some.groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("quality").alias("most")).where("quality = most")
    present = documents.where(F.col("text").rlike(r"[^\x09-\x0D ]")).select("doc_id").distinct().join(known, "doc_id")
    draw = F.xxhash64("doc_id", F.lit(salt))
    chosen = present.where("quality = 0").orderBy(draw, "doc_id").limit(per_label).unionByName(present.where("quality = 1").orderBy(draw, "doc_id").limit(per_label))
    texts = documents.select("doc_id", spread_text(F.col("text"), chars).alias("text")).join(F.broadcast(chosen.select("doc_id", "quality")), "doc_id")
    out: tuple[list[bytes], list[bytes]] = [], []
    for r in texts.orderBy(draw, "doc_id", "text").limit(4 * per_label).collect():
        if r.text and not r.text.isspace():
            out[r.quality].append(r.text.encode())
    return out


# --------------------------------------------------------------------------- word hashes


def _mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


mixed: Callable[[np.ndarray], np.ndarray] = _mixed
_RNG = np.random.default_rng(20240607)
#: By seed: what a word's length and its eight-byte lanes are multiplied by.
_LENGTH_KEYS, _LANE_KEYS = _RNG.integers(0, 2**63, (2, 2), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: Longer words are hashed one by one.
LANE_BYTES = 64
_GRAM_KEYS = _RNG.integers(0, 2**63, (2, 64), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


@dataclass
class Words:
    """Words (runs of other bytes than ASCII white space) of some documents, in order; document d has first[d]:first[d + 1]."""

    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray
    hashes: list[np.ndarray]
    offsets: np.ndarray
    buffer: bytes

    def counts(self) -> np.ndarray:
        return np.diff(self.first)


def span_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, seeds: int) -> list[np.ndarray]:
    """``seeds`` independent 64-bit hashes of each span of bytes; spans are not empty.

    A span is taken in lanes of eight bytes, each mixed into the state of those before it, so no sum or polynomial over the
    bytes can cancel; spans over ``LANE_BYTES`` take xxh3."""
    if len(starts) == 0:
        return [np.zeros(0, np.uint64)] * seeds
    padded = np.concatenate([raw, np.zeros(8, np.uint8)])
    lanes = np.ndarray((len(raw),), "<u8", buffer=padded, strides=(1,))
    lengths = ends - starts
    state = [_mixed(lengths.astype(np.uint64) * _LENGTH_KEYS[seed]) for seed in range(seeds)]
    live = np.flatnonzero(lengths <= LANE_BYTES)
    at = 0
    while len(live):
        left = np.minimum(lengths[live] - at, 8).astype(np.uint64)
        lane = lanes[starts[live] + at] & (np.uint64(0xFFFFFFFFFFFFFFFF) >> (np.uint64(64) - np.uint64(8) * left))
        for seed in range(seeds):
            state[seed][live] = _mixed(state[seed][live] ^ _mixed(lane * _LANE_KEYS[seed] + _LENGTH_KEYS[seed]))
        at += 8
        live = live[lengths[live] > at]
    for i in np.flatnonzero(lengths > LANE_BYTES).tolist():
        span = raw[starts[i] : ends[i]].tobytes()
        for seed in range(seeds):
            state[seed][i] = xxhash.xxh3_64_intdigest(span, seed + 1)
    return state


def words_of(texts: list[bytes | None], seeds: int = 1) -> Words:
    """Words and ``seeds`` independent 64-bit hashes of each, all in numpy."""
    sizes = np.array([len(x) if x else 0 for x in texts], np.int64)
    buffer = b"\n".join(x or b"" for x in texts) + b"\n"
    offsets = np.concatenate([[0], np.cumsum(sizes + 1)])
    raw = np.frombuffer(buffer, np.uint8)
    solid = ~_SPACE[raw]
    edge = np.diff(solid.view(np.int8), prepend=np.int8(0), append=np.int8(0))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    first = np.searchsorted(starts, offsets)
    return Words(starts, ends, first, span_hashes(raw, starts, ends, seeds), offsets, buffer)


def gram_hash(symbols: np.ndarray, size: int, seed: int = 0) -> np.ndarray:
    """Hash of every ``size`` consecutive symbols; the last size - 1 places have none."""
    n = len(symbols) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    total = np.zeros(n, np.uint64)
    for j in range(size):
        total += symbols[j : j + n] * _GRAM_KEYS[seed][j]
    return _mixed(total)


def gram_places(words: Words, size: int) -> np.ndarray:
    """Word indices at which ``size`` words of one document start."""
    n = len(words.starts)
    if n < size:
        return np.zeros(0, np.int64)
    at = np.arange(n - size + 1)
    doc_end = np.repeat(words.first[1:], words.counts())
    return at[at + size <= doc_end[: n - size + 1]]
