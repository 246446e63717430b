"""Packing along a space-filling curve.

Every text is tokenized once; its ids go to a scratch table (two bytes each) together with a point: the hashed bag of
ids, projected to ``DIMS`` dimensions. Mean and spread of the points over the whole table turn them into grid cells, the
Hilbert index of the cell orders the documents, and a hash of doc_id orders those within a cell, so copies never form
one heap. Ranges of that order come from quantiles over all rows; token totals per range give each range its place in
one long stream. The stream is cut every ``length`` ids; the rest at its end is cut at powers of two, which need no
padding. So no sequence is padded, and neighbours on the curve share sequences.

Defined results: a null text counts as an empty one; an empty text has its end id alone; a null doc_id is packed and stays
null; texts of any length are tokenized whole; rows that repeat a doc_id are packed one by one, equal keys go by doc_id and
then by the ids themselves (so the order of equal rows makes no difference); other columns are ignored. A tokenizer file
whose normalizer or pre-tokenizer is another is an error, not a wrong id.
"""

from __future__ import annotations

import json
import unicodedata
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from kindra.llm.common import Scratch, blob_list, bounded_batches, chunks, column_of, holding, shuffle_width
from kindra.llm.token_counts import byte_letters

LENGTH, END_ID = 4096, 2
DIMS, CELL_BITS, HASHED = 4, 10, 1024
TIE_BITS = 62 - DIMS * CELL_BITS
#: Pieces that a worker remembers at most; the half that was not used lately goes first. Longer pieces are not kept.
CACHE, CACHED_BYTES = 500_000, 48
_MARKS = b'!"#$%&()*+,-./:;=?@[]^_`{|}~'
#: The normalizer and the pre-tokenizer that the encoder below knows by heart.
NORMALIZER = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


class PieceEncoder:
    """Ids of whole texts from those of their pieces, each distinct piece encoded once.

    The tokenizer's normalizer and pre-tokenizer never look across white space, so a text's ids are those of its pieces
    between ASCII white space. A piece is cut once more where an ASCII letter or digit meets a run of marks that ends the
    piece, as the pre-tokenizer cuts there too (apostrophes and angle brackets are left alone: they begin contractions and
    special strings). Pieces that are one pre-token in normal form go straight to the merges.
    """

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        steps = spec["pre_tokenizer"].get("pretokenizers", [])
        known = (spec["normalizer"] or {}).get("normalizers") == NORMALIZER and [x["type"] for x in steps] == ["Split", "ByteLevel"] and steps[0]["pattern"] == {"Regex": SPLIT} and steps[0]["invert"] and steps[0]["behavior"] == "Removed"
        if not known or steps[1]["add_prefix_space"] or steps[1]["use_regex"] or spec["model"]["type"] != "BPE" or any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in spec["added_tokens"]):
            raise ValueError("pieces can't stand for whole texts with this tokenizer")
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        if self.tokenizer.get_vocab_size() > 1 << 16:
            raise ValueError("ids must fit two bytes")
        self.letters, self.model = byte_letters(), self.tokenizer.model
        self.two_bytes = [i.to_bytes(2, "little") for i in range(1 << 16)]
        self.met = bytearray(1 << 22)
        self.recent: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}

    def _fresh(self, piece: bytes) -> bytes:
        if piece.isalpha():  # ASCII letters
            word = piece.lower().decode()
        else:
            text = piece.decode("utf-8", "replace")
            if piece.isascii():
                plain = not piece.strip(_MARKS)
            else:
                plain = text.isalpha() and max(text) < "\u0250" and "\u0130" not in text and unicodedata.is_normalized("NFC", text)
            if not plain:
                return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u2").tobytes()
            word = "".join([self.letters[b] for b in text.lower().encode()])
        two = self.two_bytes
        return b"".join([two[t.id] for t in self.model.tokenize(word)])

    def _kept(self, piece: bytes, ids: bytes) -> bytes:
        """Remembers a piece that comes for the second time: most come once."""
        place = hash(piece) & (len(self.met) - 1)
        if not self.met[place]:
            self.met[place] = 1
        elif len(piece) <= CACHED_BYTES:
            if len(self.recent) >= CACHE // 2:
                self.older = dict(self.recent)
                self.recent.clear()
                self.met = bytearray(len(self.met))
            self.recent[piece] = ids
        return ids

    def _part(self, part: bytes) -> bytes:
        ids = self.recent.get(part)
        if ids is None:
            ids = self.older.get(part)
            ids = self._kept(part, self._fresh(part) if ids is None else ids)
        return ids

    def _piece(self, piece: bytes) -> bytes:
        """Ids of a piece that was not used lately."""
        ids = self.older.get(piece)
        if ids is None:
            stem = piece.rstrip(_MARKS)
            if not stem or len(stem) == len(piece) or not stem[-1:].isalnum():
                ids = self._fresh(piece)
            else:
                ids = self._part(stem) + self._part(piece[len(stem) :])
        return self._kept(piece, ids)

    def encode(self, texts: list[bytes | None]) -> list[bytes]:
        """Two-byte ids of each text."""
        out, get, piece_ids = [], self.recent.get, self._piece
        for text in texts:
            pieces = (text or b"").split()
            ids = list(map(get, pieces))
            at = 0
            try:
                while True:
                    at = ids.index(None, at)
                    ids[at] = piece_ids(pieces[at])
            except ValueError:
                out.append(b"".join(ids))
        return out


@lru_cache(2)
def encoder(path: str) -> PieceEncoder:
    return PieceEncoder(path)


@lru_cache(1)
def _projection() -> tuple[np.ndarray, np.ndarray]:
    """The bucket of each id, and the random directions of the buckets."""
    rng = np.random.default_rng(17)
    return rng.integers(0, HASHED, 1 << 16), rng.standard_normal((HASHED, DIMS)).astype(np.float32)


def point(ids: np.ndarray) -> np.ndarray:
    """Hashed bag of ids at unit length, projected."""
    buckets, directions = _projection()
    bag = np.bincount(buckets[ids], minlength=HASHED).astype(np.float32)
    return (bag / max(float(np.linalg.norm(bag)), 1e-9)) @ directions


def _tokenize(path: str, end_id: int):
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            end = np.array([end_id], "<u2").tobytes()
            blobs = [x + end for x in encoder(path).encode(blob_list(column_of(batch, "text")))]
            points = np.array([point(np.frombuffer(x, "<u2")) for x in blobs], np.float64)
            yield pa.RecordBatch.from_arrays([column_of(batch, "doc_id"), pa.array([len(x) // 2 for x in blobs], pa.int64()), *(pa.array(points[:, k]) for k in range(DIMS)), pa.array(blobs, pa.binary())], ["doc_id", "n", *(f"p{k}" for k in range(DIMS)), "ids"])

    return emit


def hilbert_index(cells: np.ndarray, bits: int) -> np.ndarray:
    """Index along the Hilbert curve of cells (rows of coordinates below 2 ** bits), by the transposed Gray-code method."""
    x = cells.astype(np.int64).T.copy()
    dims, top = len(x), 1 << (bits - 1)
    q = top
    while q > 1:
        p = q - 1
        for i in range(dims):
            high = (x[i] & q) != 0
            swap = np.where(high, 0, (x[0] ^ x[i]) & p)
            x[0] = np.where(high, x[0] ^ p, x[0] ^ swap)
            if i:
                x[i] ^= swap
        q >>= 1
    for i in range(1, dims):
        x[i] ^= x[i - 1]
    t, q = np.zeros_like(x[0]), top
    while q > 1:
        t = np.where((x[dims - 1] & q) != 0, t ^ (q - 1), t)
        q >>= 1
    x ^= t
    out = np.zeros(x.shape[1], np.int64)
    for b in range(bits - 1, -1, -1):
        for i in range(dims):
            out = (out << 1) | ((x[i] >> b) & 1)
    return out


def _place(mean: list[float], spread: list[float]):
    """Order key: Hilbert index of the standardized point (logistic scale to the grid), then bits of a hash of doc_id."""

    @F.pandas_udf("long")
    def key(tie: pd.Series, *points: pd.Series) -> pd.Series:
        z = (np.stack([p.to_numpy() for p in points], 1) - np.array(mean)) / np.array(spread)
        cells = np.minimum((1 << CELL_BITS) - 1, (1 / (1 + np.exp(-1.7 * np.clip(z, -20, 20))) * (1 << CELL_BITS)).astype(np.int64))
        return pd.Series(hilbert_index(cells, CELL_BITS) << TIE_BITS | (tie.to_numpy() & ((1 << TIE_BITS) - 1)))

    return key


def cuts_of(total: int, length: int) -> np.ndarray:
    """Lengths of the sequences after the full ones: the rest in powers of two."""
    rest = total % length
    return np.array([1 << b for b in range(length.bit_length(), -1, -1) if rest >> b & 1], np.int64)


def _cut(starts: dict[int, int], total: int, length: int):
    """Over rows sorted by (range, key): the running place in the stream, and the pieces between the cuts."""
    full = total // length
    tail = np.concatenate([[full * length], full * length + np.cumsum(cuts_of(total, length))])

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        range_now, at = None, 0
        for batch in batches:
            out: list[tuple] = []
            for doc_id, rng, blob in zip(*(column_of(batch, c).to_pylist() for c in ("doc_id", "range", "ids")), strict=True):
                if rng != range_now:
                    range_now, at = rng, starts[rng]
                ids = np.frombuffer(blob, "<u2").astype("<u4")
                done = 0
                while done < len(ids):
                    pos = at + done
                    if pos < full * length:
                        sequence, begin, end = pos // length, pos // length * length, (pos // length + 1) * length
                    else:
                        k = int(np.searchsorted(tail, pos, "right")) - 1
                        sequence, begin, end = full + k, int(tail[k]), int(tail[k + 1])
                    n = min(len(ids) - done, end - pos)
                    out.append((doc_id, done, n, zlib.crc32(ids[done : done + n].tobytes()), len(ids), sequence, pos - begin))
                    done += n
                at += len(ids)
            columns = list(zip(*out, strict=True)) or [()] * 7
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

    return emit


def pack(documents: DataFrame, tokenizer_path: str, length: int = LENGTH, end_id: int = END_ID) -> DataFrame:
    """A row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    spark = bounded_batches(documents).sparkSession
    schema = "doc_id long, n long, " + ", ".join(f"p{k} double" for k in range(DIMS)) + ", ids binary"
    encoded = Scratch(documents.select("doc_id", "text").mapInArrow(_tokenize(tokenizer_path, end_id), schema), "ids")
    rows = encoded.read()
    points = [f"p{k}" for k in range(DIMS)]
    stats = rows.agg(F.sum("n").alias("total"), *(F.avg(p).alias(f"{p}_mean") for p in points), *(F.stddev_pop(p).alias(f"{p}_sd") for p in points)).first()
    total = stats["total"] or 0
    key = _place([stats[f"{p}_mean"] or 0.0 for p in points], [max(stats[f"{p}_sd"] or 0.0, 1e-9) for p in points])
    placed = rows.withColumn("key", key(F.xxhash64("doc_id"), *points))
    ranges = 4 * shuffle_width(spark)
    bounds = np.unique(np.array(placed.agg(F.percentile_approx("key", [i / ranges for i in range(1, ranges)], 20 * ranges)).first()[0] or [], np.int64))

    @F.pandas_udf("int")
    def range_of(keys: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(bounds, keys.to_numpy(), "right").astype(np.int32))

    ranged = placed.withColumn("range", range_of("key"))
    sums = {r["range"]: r["n"] for r in ranged.groupBy("range").agg(F.sum("n").alias("n")).collect()}  # a row for each range
    starts, at = {}, 0
    for r in sorted(sums):
        starts[r], at = at, at + sums[r]
    width = min(ranges, max(1, len(bounds) + 1))
    dealt = ranged.select("doc_id", "range", "key", "ids").repartitionById(width, F.col("range")).sortWithinPartitions("range", "key", "doc_id", "ids")
    out = dealt.mapInArrow(_cut(starts, total, length), "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
    return holding(out, encoded)
