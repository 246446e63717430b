"""Line deduplication over a sharded minimal perfect hash.

1. Every document has two 64-bit hashes of each of its distinct line keys. Tasks aggregate those references before they
   send them: a row a key with the ``min_docs`` largest different doc_ids that the task met.
2. Each shard builds a minimal perfect hash over all distinct hashes that it gets (a cascade of bit arrays with popcount
   ranks) and fills the compact arrays that it indexes: fingerprint, count (of different documents, up to ``min_docs``) and
   keeper (the largest doc_id). The index is written as a row a shard.
3. Documents probe the arrays, they never join lines. Keys that hold over a 1/HOT_SHARE part of all references form a hot
   shard: there are fewer than HOT_SHARE of them by arithmetic, so it is sent to every task and probed in place. Other
   references, hash pairs with their doc_id, go to their shard; what hits returns to the documents, which drop the lines.

Defined results: a null or empty text is one empty line; rows that repeat a doc_id are one document (they count once, and
the keeper's rows all keep the line) but are returned row by row; rows without a doc_id together count as one document,
which keeps a line only if no other holds it; texts of any length are split whole; other columns are carried along unless
one is named like a result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kindra.llm.common import Scratch, blob_list, bounded_batches, chunks, column_of, heads_of, holding, mixed, shuffle_width

MIN_DOCS, MIN_CHARS = 3, 20
HOT_SHARE, HOT_FLOOR = 10_000, 1000
#: Line references that one shard takes, about.
SHARD_ROWS = 1 << 19
#: References that a task aggregates at a time.
GATHERED = 1 << 18
#: Stand for rows without a doc_id, and for no document.
NO_ID, NO_DOCUMENT = -(1 << 63) + 1, -(1 << 63)


def line_key(line: bytes) -> bytes:
    """ASCII white space stripped at both ends, A-Z lower-cased."""
    return line.strip(b" \t\n\v\f\r").lower()


def _hash_pair(key: bytes) -> tuple[int, int]:
    x = xxhash.xxh3_128_intdigest(key)
    return x & 0xFFFFFFFFFFFFFFFF, x >> 64


def _long_enough(key: bytes, min_chars: int) -> bool:
    n = len(key)
    return n >= min_chars and (n >= 4 * min_chars or key.isascii() or len(key.decode("utf-8", "replace")) >= min_chars)


# --------------------------------------------------------------------------- minimal perfect hash


@dataclass
class MinimalPerfectHash:
    """Levels of bit arrays: a key that is alone at its place on a level is settled there, the others go on. A key's
    number is the rank of its bit over all levels, so n keys get 0..n-1. After the last level leftovers are listed."""

    sizes: list[int]
    words: np.ndarray
    ranks: np.ndarray
    left_a: np.ndarray
    left_b: np.ndarray
    settled: int

    LEVELS = 24

    @staticmethod
    def _place(a: np.ndarray, b: np.ndarray, level: int, size: int) -> np.ndarray:
        return (mixed(a + b * np.uint64(2 * level + 1) + np.uint64(0x9E3779B97F4A7C15 * level & 0xFFFFFFFFFFFFFFFF)) % np.uint64(size)).astype(np.int64)

    @classmethod
    def build(cls, a: np.ndarray, b: np.ndarray, gamma: float = 2.0) -> MinimalPerfectHash:
        sizes, arrays = [], []
        for level in range(cls.LEVELS):
            if len(a) == 0:
                break
            size = max(64, -(-int(gamma * len(a)) // 64) * 64)
            at = cls._place(a, b, level, size)
            alone = np.bincount(at, minlength=size) == 1
            sizes.append(size)
            arrays.append(np.packbits(alone, bitorder="little").view(np.uint64))
            rest = ~alone[at]
            a, b = a[rest], b[rest]
        words = np.concatenate(arrays) if arrays else np.zeros(0, np.uint64)
        counts = np.bitwise_count(words).astype(np.int64)
        ranks = np.concatenate([[0], np.cumsum(counts)])
        order = np.lexsort((b, a))
        return cls(sizes, words, ranks, a[order], b[order], int(ranks[-1]))

    def __len__(self) -> int:
        return self.settled + len(self.left_a)

    def lookup(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The number of each key; -1 or any number for keys that are not indexed."""
        out, todo, base = np.full(len(a), -1, np.int64), np.arange(len(a)), 0
        for level, size in enumerate(self.sizes):
            if len(todo) == 0:
                return out
            at = self._place(a[todo], b[todo], level, size)
            word = self.words[base // 64 + at // 64]
            bit = (at % 64).astype(np.uint64)
            hit = (word >> bit) & np.uint64(1) == 1
            below = np.bitwise_count(word & ((np.uint64(1) << bit) - np.uint64(1))).astype(np.int64)
            out[todo[hit]] = (self.ranks[base // 64 + at // 64] + below)[hit]
            todo, base = todo[~hit], base + size
        for i in todo if len(self.left_a) else ():
            lo, hi = np.searchsorted(self.left_a, a[i], "left"), np.searchsorted(self.left_a, a[i], "right")
            for j in range(lo, hi):
                if self.left_b[j] == b[i]:
                    out[i] = self.settled + j
        return out


def largest_documents(a: np.ndarray, b: np.ndarray, doc: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of references: the distinct keys in order (a, b), how often each comes, and its ``n`` largest different documents in
    falling order, NO_DOCUMENT where there are fewer."""
    order = np.lexsort((~doc, b, a))
    a, b, doc = a[order], b[order], doc[order]
    heads = heads_of([a, b])
    group = np.repeat(np.arange(len(heads) - 1), np.diff(heads))
    times = np.diff(heads)
    real = doc != NO_DOCUMENT
    new = real.copy()
    new[1:] &= (doc[1:] != doc[:-1]) | (group[1:] != group[:-1])
    before = np.cumsum(new) - new
    place = before - before[heads[:-1]][group] if len(group) else before
    out = np.full((len(heads) - 1, n), NO_DOCUMENT, np.int64)
    keep = new & (place < n)
    out[group[keep], place[keep]] = doc[keep]
    return a[heads[:-1]], b[heads[:-1]], times, out


@dataclass
class LineShard:
    """One shard: the hash and the arrays that it indexes."""

    mph: MinimalPerfectHash
    fingerprint: np.ndarray
    count: np.ndarray
    keeper: np.ndarray

    @staticmethod
    def _print(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return b ^ (a >> np.uint64(7))

    @classmethod
    def build(cls, a: np.ndarray, b: np.ndarray, documents: np.ndarray) -> LineShard:
        """Of distinct keys with a row each of their largest documents."""
        mph = MinimalPerfectHash.build(a, b)
        at = mph.lookup(a, b)
        out = cls(mph, np.zeros(len(a), np.uint64), np.zeros(len(a), np.uint8), np.zeros(len(a), np.int64))
        out.fingerprint[at], out.count[at], out.keeper[at] = cls._print(a, b), (documents != NO_DOCUMENT).sum(1), documents[:, 0]
        return out

    def probe(self, a: np.ndarray, b: np.ndarray, doc: np.ndarray, min_docs: int) -> tuple[np.ndarray, np.ndarray]:
        """Of each (key, document) reference: whether the key is indexed here, whether the document loses its lines."""
        if len(self.fingerprint) == 0:
            return np.zeros(len(a), np.bool_), np.zeros(len(a), np.bool_)
        at = self.mph.lookup(a, b)
        known = (at >= 0) & (self.fingerprint[at] == self._print(a, b))
        return known, known & (self.count[at] >= min_docs) & (self.keeper[at] != doc)

    def packed(self) -> list[bytes]:
        m = self.mph
        return [np.array([m.settled, *m.sizes], np.int64).tobytes(), *(x.tobytes() for x in (m.words, m.ranks, m.left_a, m.left_b, self.fingerprint, self.count, self.keeper))]

    @classmethod
    def unpacked(cls, blobs: list[bytes]) -> LineShard:
        sizes, words, ranks, left_a, left_b, fingerprint, count, keeper = (np.frombuffer(x, k) for x, k in zip(blobs, (np.int64, np.uint64, np.int64, np.uint64, np.uint64, np.uint64, np.uint8, np.int64), strict=True))
        return cls(MinimalPerfectHash(sizes[1:].tolist(), words, ranks, left_a, left_b, int(sizes[0])), fingerprint, count, keeper)


# --------------------------------------------------------------------------- the operator


def _references(min_chars: int):
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            a, b, docs = [], [], []
            for doc, text in zip(column_of(batch, "doc_id").to_pylist(), blob_list(column_of(batch, "text")), strict=True):
                if not text:
                    continue
                keys = {k for k in map(line_key, text.split(b"\n")) if _long_enough(k, min_chars)}
                for key in keys:
                    x, y = _hash_pair(key)
                    a.append(x)
                    b.append(y)
                docs += [NO_ID if doc is None else doc] * len(keys)
            yield pa.RecordBatch.from_arrays([pa.array(np.array(a, np.uint64).view(np.int64)), pa.array(np.array(b, np.uint64).view(np.int64)), pa.array(np.array(docs, np.int64))], ["a", "b", "doc"])

    return emit


_KEYS = ("a", "b", "n", "documents")


def _aggregated(shards: int, min_docs: int):
    """A row (shard, then the keys packed in columns) of what a task knows of each shard's keys."""

    def settled(parts: list[list[np.ndarray]]) -> pa.RecordBatch:
        a, b, doc = (np.concatenate(c) for c in zip(*parts, strict=True))
        a, b, times, documents = largest_documents(a.view(np.uint64), b.view(np.uint64), doc, min_docs)
        shard = (a % np.uint64(shards)).astype(np.int32)
        order = np.argsort(shard, kind="stable")
        columns = [shard[order], a[order], b[order], times[order], documents[order]]
        heads = heads_of(columns[:1])
        blobs = [[c[lo:hi].tobytes() for lo, hi in zip(heads[:-1], heads[1:], strict=True)] for c in columns[1:]]
        return pa.RecordBatch.from_arrays([pa.array(columns[0][heads[:-1]]), *(pa.array(x, pa.binary()) for x in blobs)], ["shard", *_KEYS])

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, size = [], 0
        for batch in batches:
            parts.append([column_of(batch, c).to_numpy() for c in ("a", "b", "doc")])
            size += batch.num_rows
            if size >= GATHERED:
                yield settled(parts)
                parts, size = [], 0
        if size:
            yield settled(parts)

    return emit


_INDEX = ("sizes", "words", "ranks", "left_a", "left_b", "fingerprint", "count", "keeper")
_HOT = ("hot_a", "hot_b", "hot_documents")


def _indexed(min_docs: int, floor: int):
    """A shard's row of the index, and its keys with over ``floor`` references beside it."""

    def build(key: tuple, table: pa.Table) -> pa.Table:
        blobs = lambda c, kind: np.concatenate([np.frombuffer(x, kind) for x in table[c].to_pylist()])
        a, b, times, documents = blobs("a", np.uint64), blobs("b", np.uint64), blobs("n", np.int64), blobs("documents", np.int64).reshape(-1, min_docs)
        order = np.lexsort((b, a))
        heads = heads_of([a[order], b[order]])
        total = np.add.reduceat(times[order], heads[:-1])
        a, b, _, documents = largest_documents(np.repeat(a, min_docs), np.repeat(b, min_docs), documents.ravel(), min_docs)
        shard, hot = LineShard.build(a, b, documents), total > floor
        values = [*shard.packed(), *(c[hot].tobytes() for c in (a, b, documents))]
        return pa.table([pa.array([key[0].as_py()], pa.int32()), *(pa.array([v], pa.binary()) for v in values)], names=["shard", *_INDEX, *_HOT])

    return build


def _probe_hot(shard: LineShard, min_docs: int):
    """Answers references to hot keys in place (hit); the others are passed on."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, doc = (column_of(batch, c).to_numpy() for c in ("a", "b", "doc"))
            known, hit = shard.probe(a.view(np.uint64), b.view(np.uint64), doc, min_docs)
            keep = hit | ~known
            yield pa.RecordBatch.from_arrays([pa.array(a[keep]), pa.array(b[keep]), pa.array(doc[keep]), pa.array(hit[keep])], ["a", "b", "doc", "hit"])

    return emit


def _probe_shard(min_docs: int):
    def answer(key: tuple, index: pa.Table, refs: pa.Table) -> pa.Table:
        if index.num_rows == 0 or refs.num_rows == 0:
            return pa.table({c: pa.array([], pa.int64()) for c in ("a", "b", "doc")})
        shard = LineShard.unpacked([index[c][0].as_py() for c in _INDEX])
        a, b, doc = (refs[c].combine_chunks().to_numpy() for c in ("a", "b", "doc"))
        _, hit = shard.probe(a.view(np.uint64), b.view(np.uint64), doc, min_docs)
        return pa.table({"a": a[hit], "b": b[hit], "doc": doc[hit]})

    return answer


def _drop_lines(carried: list[str], with_text: bool, schema: pa.Schema):
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            kept, n_lines, n_dropped = [], [], []
            for text, marks in zip(blob_list(column_of(batch, "text")), column_of(batch, "_marks").to_pylist(), strict=True):
                text = text or b""
                n_lines.append(text.count(b"\n") + 1)
                if marks:
                    gone = set(marks)
                    lines = text.split(b"\n")
                    stay = [x for x in lines if xxhash.xxh3_128_digest(line_key(x)) not in gone]
                    n_dropped.append(len(lines) - len(stay))
                    kept.append(b"\n".join(stay))
                else:
                    n_dropped.append(0)
                    kept.append(text)
            arrays = [column_of(batch, c) for c in carried] + [pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64())]
            arrays += [pa.array([x.decode("utf-8", "replace") for x in kept], pa.string())] if with_text else []
            arrays += [pa.array([hashlib.sha256(x).hexdigest() for x in kept], pa.string())]
            yield pa.RecordBatch.from_arrays(arrays, schema=pa.schema([*[batch.schema.field(c) for c in carried], *schema]))

    return emit


def dedup_lines(documents: DataFrame, min_docs: int = MIN_DOCS, min_chars: int = MIN_CHARS, keep_text: bool = True) -> DataFrame:
    """The rows of ``documents`` with n_lines, n_dropped, kept_text (with ``keep_text``) and kept_sha256.

    Without ``keep_text`` only doc_id and the figures are returned and no text leaves the last task."""
    spark = bounded_batches(documents).sparkSession
    refs = Scratch(documents.select("doc_id", "text").mapInArrow(_references(min_chars), "a long, b long, doc long"), "lines")
    lines = refs.read()
    total = lines.count()
    shards = max(2 * shuffle_width(spark), total // SHARD_ROWS)
    floor = max(total // HOT_SHARE, HOT_FLOOR)
    blob = lambda names: ", ".join(f"{c} binary" for c in names)
    known = lines.mapInArrow(_aggregated(shards, min_docs), f"shard int, {blob(_KEYS)}")
    index = Scratch(known.groupBy("shard").applyInArrow(_indexed(min_docs, floor), f"shard int, {blob((*_INDEX, *_HOT))}"), "lineindex")
    # Fewer than HOT_SHARE keys: each holds over total / HOT_SHARE references.
    rows = index.read().where(F.length("hot_a") > 0).select(*_HOT).collect()
    hot_a, hot_b, hot_documents = (np.concatenate([np.zeros(0, k), *(np.frombuffer(r[c], k) for r in rows)]) for c, k in zip(_HOT, (np.uint64, np.uint64, np.int64), strict=True))
    hot = LineShard.build(hot_a, hot_b, hot_documents.reshape(-1, min_docs))
    probed = lines.mapInArrow(_probe_hot(hot, min_docs), "a long, b long, doc long, hit boolean")
    done = probed.where("hit").select("a", "b", "doc")
    # As the shard of an unsigned number; a signed one that is below zero is 2 ** 64 short.
    shard = F.pmod(F.pmod("a", F.lit(shards)) + F.when(F.col("a") < 0, F.lit((1 << 64) % shards)).otherwise(F.lit(0)), F.lit(shards)).cast("int").alias("shard")
    sent = probed.where("not hit").select(shard, "a", "b", "doc").groupBy("shard")
    answered = index.read().select("shard", *_INDEX).groupBy("shard").cogroup(sent).applyInArrow(_probe_shard(min_docs), "a long, b long, doc long")
    digest = F.unhex(F.concat(*[F.lpad(F.hex(c), 16, "0") for c in ("b", "a")]))
    marks = done.unionByName(answered).groupBy("doc").agg(F.collect_set(digest).alias("_marks"))
    carried = [c for c in documents.columns if c not in ("n_lines", "n_dropped", "kept_text", "kept_sha256")] if keep_text else ["doc_id"]
    rows = documents.select(*dict.fromkeys([*carried, "doc_id", "text"])).withColumn("_doc", F.coalesce("doc_id", F.lit(NO_ID)))
    joined = rows.join(marks.withColumnRenamed("doc", "_doc").hint("shuffle_hash"), "_doc", "left").drop("_doc")
    fields = "n_lines long, n_dropped long, " + ("kept_text string, " if keep_text else "") + "kept_sha256 string"
    added = pa.schema([("n_lines", pa.int64()), ("n_dropped", pa.int64()), *([("kept_text", pa.string())] if keep_text else []), ("kept_sha256", pa.string())])
    own = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in documents.schema if f.name in carried)
    return holding(joined.mapInArrow(_drop_lines(carried, keep_text, added), f"{own}, {fields}"), refs, index)
