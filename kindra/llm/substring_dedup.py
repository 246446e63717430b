"""Removal of repeated word windows by recompression.

Recompression names what repeats. Round 0 replaces every run of one word by a symbol, each later round replaces
neighbouring pairs (left, right) by a symbol, where a hash of the symbol and the round says which side it is on. Names
are hashes of what they stand for, so all documents agree on them without an exchange, and equal substrings are parsed
alike in their interior. For every symbol the parse keeps the stretch of words that its making depended on. A window that
covers the stretch contains the symbol wherever it occurs, so each window gets a representative that depends on its words
alone: the contained symbol with the longest expansion, least by name (without one: the window's own hash).

1. Documents send the distinct representatives of their windows; those of two documents or more are shared.
2. Documents parse again and send the hashes of the windows under shared representatives, beside them.
3. A window whose hash a smaller doc_id holds too goes back as a place, and the words under it are removed.

In both exchanges a task first settles what repeats among its own documents and sends one entry a key, that of its
least doc_id, so a key that many documents hold arrives once a task.

Defined results: a null text has no words; a null doc_id sorts behind all others; rows that repeat a doc_id are the same
document and don't remove each other's words; texts with fewer words than a window stay whole; other columns are carried
along unless one is named like a result.
"""

from __future__ import annotations

import ctypes
import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kindra.llm.common import NULL_ID, Words, blob_list, bounded_batches, chunks, column_of, gram_hash, gram_places, mixed, shuffle_width, words_of

WINDOW, ROUNDS = 13, 6
_SALTS = np.random.default_rng(5).integers(1, 2**63, 3 * (ROUNDS + 1), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SPAN_SHIFT = np.uint64(58)


def representatives(words: Words, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """Places of all windows and the representative of each."""
    n, at = len(words.starts), gram_places(words, window)
    if len(at) == 0:
        return at, np.zeros(0, np.uint64)
    best = np.zeros(n + 1, np.uint64)
    doc_of = np.repeat(np.arange(len(words.first) - 1), words.counts())
    h = words.hashes[0]

    def offer(name: np.ndarray, start: np.ndarray, end: np.ndarray, low: np.ndarray, high: np.ndarray) -> None:
        """To the windows that cover low:high."""
        fits = (high - low <= window) & (low >= 0) & (high <= n)
        name, low, high, span = name[fits], low[fits], high[fits], (end - start)[fits]
        rank = (np.minimum(span, 63).astype(np.uint64) << _SPAN_SHIFT) | (name >> np.uint64(6))
        for k in range(window):
            place = low - k
            ok = (place >= high - window) & (place >= 0)
            if not ok.any():
                break
            np.maximum.at(best, place[ok], rank[ok])

    head = np.ones(n, np.bool_)
    head[1:] = (h[1:] != h[:-1]) | (doc_of[1:] != doc_of[:-1])
    start = np.flatnonzero(head)
    end = np.append(start[1:], n)
    size = end - start
    symbol = np.where(size > 1, mixed(h[start] * _SALTS[0] + size.astype(np.uint64) * _SALTS[1]), h[start])
    doc, low, high = doc_of[start], start - 1, end + 1
    runs = size > 1
    offer(symbol[runs], start[runs], end[runs], low[runs], high[runs])
    for r in range(1, ROUNDS + 1):
        right = (mixed(symbol ^ _SALTS[3 * r]) & np.uint64(1)) == 1
        joined = np.zeros(len(symbol), np.bool_)
        joined[:-1] = ~right[:-1] & right[1:] & (doc[:-1] == doc[1:])
        i = np.flatnonzero(joined)
        if len(i) == 0:
            break
        made = mixed(symbol[i] * _SALTS[3 * r + 1] + symbol[i + 1] * _SALTS[3 * r + 2])
        # What stays alone needs to have seen the neighbour that it might have joined; off the text's edge nothing can see it.
        last = np.append(doc[1:] != doc[:-1], True)
        new_high = np.where(last, end + window + 1, np.append(high[1:], n + window + 1))
        new_low = np.where(np.append(True, last[:-1]), start - window - 1, np.append(-window, low[:-1]))
        low_alone, high_alone = np.where(right, np.minimum(low, new_low), low), np.where(right, high, np.maximum(high, new_high))
        low_made, high_made = np.minimum(low[i], low[i + 1]), np.maximum(high[i], high[i + 1])
        offer(made, start[i], end[i + 1], low_made, high_made)
        symbol, low, high, end = symbol.copy(), low_alone, high_alone, end.copy()
        symbol[i], low[i], high[i], end[i] = made, low_made, high_made, end[i + 1]
        stay = np.ones(len(symbol), np.bool_)
        stay[i + 1] = False
        symbol, low, high, start, end, doc = symbol[stay], low[stay], high[stay], start[stay], end[stay], doc[stay]
    key = best[at]
    none = key == 0
    if none.any():
        key[none] = gram_hash(h, window)[at[none]] >> np.uint64(6)
    return at, key


# --------------------------------------------------------------------------- settling keys

#: Entries that a task gathers before it settles them among themselves and sends the rest.
GATHERED = 400_000
#: Bytes of text whose entries one shard takes, about: a shard is held whole by one worker, so their number grows with the input.
SHARD_BYTES = 16 << 20
_SENT = "shard int, kind int, a binary, b binary, doc binary, place binary"
#: An entry of this kind needs the shard's answer; an entry of the other kind was settled by the sender.
OPEN, SETTLED = 0, 1
_KINDS = (np.uint64, np.uint64, np.int64, np.int32)


def _cut_by(shard: np.ndarray, kind: int, columns: list[np.ndarray]) -> Iterator[tuple]:
    """A row for each shard with the entries packed, in the order of their documents: neighbours then compress well."""
    if len(shard) == 0:
        return
    order = np.lexsort((columns[3], columns[2], shard))
    shard, columns = shard[order], [c[order] for c in columns]
    heads = np.flatnonzero(np.concatenate([[True], shard[1:] != shard[:-1]]))
    sent = [bool(c.any()) for c in columns[:2]] + [True, bool(columns[3].any())]
    for lo, hi in zip(heads, [*heads[1:], len(shard)], strict=True):
        yield (int(shard[lo]), kind, *(c[lo:hi].tobytes() if used else b"" for c, used in zip(columns, sent, strict=True)))


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [()] * 6
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int32() if k < 2 else pa.binary()) for k, c in enumerate(columns)], ["shard", "kind", "a", "b", "doc", "place"])


def _unpacked(blobs: tuple[bytes, ...]) -> list[np.ndarray]:
    """The columns of a row; a column of zeros was sent empty."""
    columns = [np.frombuffer(x, k) for x, k in zip(blobs, _KINDS, strict=True)]
    return [c if len(c) else np.zeros(len(columns[2]), k) for c, k in zip(columns, _KINDS, strict=True)]


def _groups(a: np.ndarray, b: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order by (a, b, doc), the group of each ordered row, and the place of each group's first row."""
    order = np.lexsort((doc, b, a) if b.any() else (doc, a))
    x, y = a[order], b[order]
    new = np.ones(len(order), np.bool_)
    new[1:] = (x[1:] != x[:-1]) | (y[1:] != y[:-1])
    return order, np.cumsum(new) - 1, np.flatnonzero(new)


def _settle(parts: list[list[np.ndarray]], shards: int, losers_only: bool) -> Iterator[pa.RecordBatch]:
    """What a task sends: a key's least document goes to the key's shard, what is known already goes to the document's.

    Known are, with ``losers_only``, entries whose key a smaller document of the task holds, else all entries whose key two
    of its documents hold."""
    a, b, doc, place = (np.concatenate(c) for c in zip(*parts, strict=True))
    parts.clear()
    order, group, first = _groups(a, b, doc)
    a, b, doc, place = a[order], b[order], doc[order], place[order]
    later = doc > doc[first][group]
    lead = np.zeros(len(a), np.bool_)
    lead[first] = True
    shared = later if losers_only else (np.bincount(group, weights=later, minlength=len(first)) > 0)[group]
    # Repeats inside the least document share its key's fate, so each of their places is sent.
    ask = ~later if losers_only else lead
    to_key = (mixed(a[ask]) % np.uint64(shards)).astype(np.int32)
    to_doc = (mixed(doc[shared].astype(np.uint64)) % np.uint64(shards)).astype(np.int32)
    rows = [*_cut_by(to_key, OPEN, [c[ask] for c in (a, b, doc, place)]), *_cut_by(to_doc, SETTLED, [np.zeros_like(c[shared]) if losers_only and k < 2 else c[shared] for k, c in enumerate((a, b, doc, place))])]
    del a, b, doc, place, order, group
    for at in range(0, len(rows), 64):
        yield _batch(rows[at : at + 64])
    trim()


@lru_cache(1)
def _libc() -> ctypes.CDLL | None:
    try:
        return ctypes.CDLL("libc.so.6")
    except OSError:
        return None


def trim() -> None:
    """Gives freed memory back to the system, where the C library can."""
    if (libc := _libc()) is not None and hasattr(libc, "malloc_trim"):
        libc.malloc_trim(0)


def _answer(shards: int, losers_only: bool):
    """A shard's entries of all tasks. Gives what is known as rows (shard, doc, v): documents and, packed beside them, the
    representatives or, with ``losers_only``, the places that concern them, cut by a hash of the document."""

    def told(doc: np.ndarray, value: np.ndarray) -> pa.RecordBatch:
        to = (mixed(doc.astype(np.uint64)) % np.uint64(shards)).astype(np.int32)
        order = np.lexsort((doc, to))
        to, doc, value = to[order], doc[order], value[order]
        heads = np.flatnonzero(np.concatenate([[True], to[1:] != to[:-1]])) if len(to) else np.zeros(0, np.int64)
        spans = list(zip(heads.tolist(), [*heads[1:].tolist(), len(to)], strict=True)) if len(to) else []
        return pa.RecordBatch.from_arrays([pa.array(to[heads], pa.int32()), *(pa.array([c[lo:hi].tobytes() for lo, hi in spans], pa.binary()) for c in (doc, value))], ["shard", "doc", "v"])

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened: list[list[np.ndarray]] = []
        known: list[tuple[np.ndarray, np.ndarray]] = []
        value = (lambda row: row[3]) if losers_only else (lambda row: row[0])
        for batch in batches:
            for kind, *blobs in zip(*(column_of(batch, c).to_pylist() for c in ("kind", "a", "b", "doc", "place")), strict=True):
                row = _unpacked(tuple(blobs))
                if kind == OPEN:
                    opened.append(row)
                else:
                    known.append((row[2], value(row)))
            if sum(len(k[0]) for k in known) >= GATHERED:
                yield told(*(np.concatenate(c) for c in zip(*known, strict=True)))
                known = []
        if known:
            yield told(*(np.concatenate(c) for c in zip(*known, strict=True)))
        if opened:
            a, b, doc, place = (np.concatenate(c) for c in zip(*opened, strict=True))
            opened.clear()
            order, group, first = _groups(a, b, doc)
            doc = doc[order]
            later = doc > doc[first][group]
            some = later if losers_only else (np.bincount(group, weights=later, minlength=len(first)) > 0)[group]
            yield told(doc[some], value([a, b, doc, place])[order][some])
            del a, b, doc, place, order, group
        trim()

    return emit


def _by_document(kind: type):
    """What all shards told of a task's documents: a row (_doc, _marks) for each, its values packed."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        docs: list[np.ndarray] = []
        values: list[np.ndarray] = []
        for batch in batches:
            docs += [np.frombuffer(x, np.int64) for x in column_of(batch, "doc").to_pylist()]
            values += [np.frombuffer(x, kind) for x in column_of(batch, "v").to_pylist()]
        if docs:
            doc, value = np.concatenate(docs), np.concatenate(values)
            docs.clear()
            values.clear()
            order = np.lexsort((value, doc))
            doc, value = doc[order], value[order]
            heads = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]]))
            ends = np.append(heads[1:], len(doc))
            for at in range(0, len(heads), 4096):
                lo, hi = heads[at : at + 4096], ends[at : at + 4096]
                blobs = [np.unique(value[x:y]).tobytes() for x, y in zip(lo.tolist(), hi.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(doc[lo]), pa.array(blobs, pa.binary())], ["_doc", "_marks"])
        trim()

    return emit


# --------------------------------------------------------------------------- the operator


def _send_representatives(window: int, shards: int):
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, size = [], 0
        for batch in chunks(batches):
            words = words_of(blob_list(column_of(batch, "text")))
            at, key = representatives(words, window)
            row = np.searchsorted(words.first, at, "right") - 1
            new = np.ones(len(key), np.bool_)
            new[1:] = (key[1:] != key[:-1]) | (row[1:] != row[:-1])
            key, doc = key[new], column_of(batch, "_doc").to_numpy()[row[new]]
            parts.append([key, np.zeros(len(key), np.uint64), doc, np.zeros(len(key), np.int32)])
            size += len(key)
            if size >= GATHERED:
                yield from _settle(parts, shards, False)
                parts, size = [], 0
        if parts:
            yield from _settle(parts, shards, False)

    return emit


def _marked(blobs: list[bytes | None], kind: type) -> list[np.ndarray | None]:
    return [np.frombuffer(x, kind) if x else None for x in blobs]


def _send_windows(window: int, shards: int):
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, size = [], 0
        for batch in chunks(batches):
            marks = _marked(column_of(batch, "_marks").to_pylist(), np.uint64)
            words = words_of(blob_list(column_of(batch, "text")), 2)
            at, key = representatives(words, window)
            full = gram_hash(words.hashes[1], window, 1)
            bounds = np.searchsorted(at, words.first)
            ids = column_of(batch, "_doc").to_numpy()
            for d, own in enumerate(marks):
                if own is None or bounds[d] == bounds[d + 1]:
                    continue
                keys = key[bounds[d] : bounds[d + 1]]
                hit = own[np.minimum(np.searchsorted(own, keys), len(own) - 1)] == keys
                place = at[bounds[d] : bounds[d + 1]][hit]
                parts.append([keys[hit], full[place], np.full(len(place), ids[d]), (place - words.first[d]).astype(np.int32)])
                size += len(place)
                if size >= GATHERED:
                    yield from _settle(parts, shards, True)
                    parts, size = [], 0
        if parts:
            yield from _settle(parts, shards, True)

    return emit


def _remove(carried: list[str], window: int, with_text: bool, schema: pa.Schema):
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            kept, n_words, n_removed = [], [], []
            for text, places in zip(blob_list(column_of(batch, "text")), _marked(column_of(batch, "_marks").to_pylist(), np.int32), strict=True):
                words = (text or b"").split()
                n_words.append(len(words))
                if places is not None:
                    gone = np.zeros(len(words) + window, np.bool_)
                    for j in range(window):
                        gone[places + j] = True
                    words = [w for w, g in zip(words, gone.tolist(), strict=False) if not g]
                n_removed.append(n_words[-1] - len(words))
                kept.append(b" ".join(words))
            arrays = [column_of(batch, c) for c in carried] + [pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64())]
            arrays += [pa.array([x.decode("utf-8", "replace") for x in kept], pa.string())] if with_text else []
            arrays += [pa.array([hashlib.sha256(x).hexdigest() for x in kept], pa.string())]
            yield pa.RecordBatch.from_arrays(arrays, schema=pa.schema([*(batch.schema.field(c) for c in carried), *schema]))

    return emit


def _told(sent: DataFrame, shards: int, losers_only: bool) -> DataFrame:
    """(_doc, _marks) of what the shards know of the entries sent."""
    answers = sent.repartitionById(shards, F.col("shard")).mapInArrow(_answer(shards, losers_only), "shard int, doc binary, v binary")
    return answers.repartitionById(shards, F.col("shard")).mapInArrow(_by_document(np.int32 if losers_only else np.uint64), "_doc long, _marks binary")


def remove_repeats(documents: DataFrame, window: int = WINDOW, keep_text: bool = True) -> DataFrame:
    """The rows of ``documents`` with n_words, n_removed, kept_text (with ``keep_text``: the words left, one space apart) and
    kept_sha256. Without ``keep_text`` doc_id and the figures alone are returned."""
    spark = bounded_batches(documents).sparkSession
    shards = max(shuffle_width(spark), (documents.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // SHARD_BYTES)
    carried = [c for c in documents.columns if c not in ("n_words", "n_removed", "kept_text", "kept_sha256")] if keep_text else ["doc_id"]
    rows = documents.select(*dict.fromkeys([*carried, "doc_id", "text"])).withColumn("_doc", F.coalesce("doc_id", F.lit(NULL_ID)))
    sent = rows.select("_doc", "text").mapInArrow(_send_representatives(window, shards), _SENT)
    shared = _told(sent, shards, False)
    # The same columns as in the last step, so that one exchange of the texts serves both.
    asked = rows.join(shared.hint("shuffle_hash"), "_doc").mapInArrow(_send_windows(window, shards), _SENT)
    lost = _told(asked, shards, True)
    added = pa.schema([("n_words", pa.int64()), ("n_removed", pa.int64()), *([("kept_text", pa.string())] if keep_text else []), ("kept_sha256", pa.string())])
    own = [f"`{f.name}` {f.dataType.simpleString()}" for f in documents.schema if f.name in carried]
    fields = ", ".join([*own, *(f"{f.name} {'long' if f.type == pa.int64() else 'string'}" for f in added)])
    return rows.join(lost.hint("shuffle_hash"), "_doc", "left").mapInArrow(_remove(carried, window, keep_text, added), fields)
