"""A byte-level convolutional network in numpy that scores the quality of whole texts.

Each filter sees ``WIDTH`` neighbouring bytes through one learned table a position (a convolution over one-hot bytes).
The document is covered by chunks of ``CHUNK`` positions that overlap by half; each filter's largest rectified response in
a chunk is the chunk's feature, and the mean and the largest of these over all chunks feed a logistic output. Training is
Adam on the cross-entropy; gradients pass through the places of the maxima only. For scoring, the tables of neighbouring
positions are added up for all byte pairs, so a position costs three lookups.

Defined results: a null or empty text is one chunk of zero bytes and gets that score; texts of any length are scored
whole, in strips; of equal responses the first in a half chunk counts; without labelled texts of both kinds the score is the
share of label 1 (0.5 without any); a null doc_id is not held out; repeated rows are scored one by one; other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kindra.llm.common import blob_list, bounded_batches, chunks, column_of, held_out, labelled_texts

FILTERS, WIDTH, CHUNK = 12, 6, 256
THRESHOLD = 0.7
#: Bounds of the fit: documents of each label (least hash of doc_id first) and characters of each (windows spread over the
#: whole text of a longer one); passes over them.
FIT_PER_LABEL, FIT_CHARS, PASSES = 500, 6000, 8
#: Words of the extracts that are added to the fit, one of each document of either label: short texts are rare among them.
EXTRACT_WORDS = 12
#: Bytes that are convolved at once.
_STRIP = 1 << 15


@dataclass
class ByteNetwork:
    tables: np.ndarray
    bias: np.ndarray
    out: np.ndarray
    offset: float

    def __post_init__(self) -> None:
        self._pairs: list[np.ndarray] | None = None

    def __getstate__(self) -> dict:
        return {"tables": self.tables, "bias": self.bias, "out": self.out, "offset": self.offset}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state, _pairs=None)

    @staticmethod
    def padded(text: bytes) -> np.ndarray:
        return np.frombuffer(text + bytes(max(0, WIDTH - len(text))), np.uint8)

    def responses(self, raw: np.ndarray) -> np.ndarray:
        """Of every filter at every place."""
        if self._pairs is None:
            self._pairs = [np.ascontiguousarray((self.tables[j][:, None, :] + self.tables[j + 1][None, :, :]).reshape(1 << 16, -1)) for j in range(0, WIDTH, 2)]
            self._pairs[0] = self._pairs[0] + self.bias
        two = raw[:-1].astype(np.uint16) << np.uint16(8) | raw[1:]
        n = len(raw) - WIDTH + 1
        out = self._pairs[0][two[:n]]
        for k in range(1, WIDTH // 2):
            out += self._pairs[k][two[2 * k : 2 * k + n]]
        return out

    def half_chunks(self, raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The largest response of each filter in each half chunk, and its place."""
        half, tops, places = CHUNK // 2, [], []
        n = len(raw) - WIDTH + 1
        for at in range(0, n, _STRIP):
            r = self.responses(raw[at : min(at + _STRIP, n) + WIDTH - 1])
            short = -len(r) % half
            if short:
                r = np.concatenate([r, np.full((short, r.shape[1]), -1e9, r.dtype)])
            r = r.reshape(-1, half, r.shape[1])
            where = r.argmax(1) if self._training else None
            tops.append(r.max(1))
            if where is not None:
                places.append(where + at + half * np.arange(len(r))[:, None])
        return np.concatenate(tops), np.concatenate(places) if places else np.zeros((0, 0), np.int64)

    _training = False

    @staticmethod
    def pooled(tops: np.ndarray) -> np.ndarray:
        """By chunk: two neighbouring halves, or the only one."""
        return np.maximum(np.maximum(tops[:-1], tops[1:]) if len(tops) > 1 else tops, 0)

    def score(self, text: bytes) -> float:
        chunk = self.pooled(self.half_chunks(self.padded(text))[0])
        z = float(np.concatenate([chunk.mean(0), chunk.max(0)]) @ self.out) + self.offset
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))

    @classmethod
    def constant(cls, share: float) -> ByteNetwork:
        share = min(max(share, 1e-6), 1 - 1e-6)
        return cls(np.zeros((WIDTH, 256, FILTERS), np.float32), np.zeros(FILTERS, np.float32), np.zeros(2 * FILTERS), float(np.log(share / (1 - share))))

    @classmethod
    def fit(cls, texts: list[bytes], labels: list[int], share: float, passes: int = PASSES, rate: float = 0.02, seed: int = 3) -> ByteNetwork:
        """``share``: of label 1 among all labels; it replaces the sample's in the offset."""
        rng = np.random.default_rng(seed)
        net = cls(rng.normal(0, 0.15, (WIDTH, 256, FILTERS)).astype(np.float32), np.zeros(FILTERS, np.float32), rng.normal(0, 0.3, 2 * FILTERS), 0.0)
        net._training = True
        params = [net.tables, net.bias, net.out, np.array([0.0])]
        moments = [(np.zeros_like(p, dtype=np.float64), np.zeros_like(p, dtype=np.float64)) for p in params]
        step = 0
        for _ in range(passes):
            order = rng.permutation(len(texts))
            for lo in range(0, len(order), 16):
                grads = [np.zeros_like(p, dtype=np.float64) for p in params]
                net._pairs, net.offset = None, float(params[3][0])
                some = order[lo : lo + 16]
                for i in some:
                    net._backward(net.padded(texts[i]), labels[i], grads, len(some))
                step += 1
                for p, g, (m, v) in zip(params, grads, moments, strict=True):
                    m *= 0.9
                    m += 0.1 * g
                    v *= 0.999
                    v += 0.001 * g * g
                    p -= (rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)).astype(p.dtype)
        ones = sum(labels)
        net.offset = float(params[3][0]) + float(np.log(share / (1 - share)) - np.log(ones / (len(labels) - ones)))
        net._training, net._pairs = False, None
        return net

    def responses_plain(self, raw: np.ndarray) -> np.ndarray:
        n = len(raw) - WIDTH + 1
        return sum((self.tables[j][raw[j : j + n]] for j in range(WIDTH)), start=np.zeros((1, FILTERS), np.float32)) + self.bias

    def _backward(self, raw: np.ndarray, label: int, grads: list[np.ndarray], batch: int) -> None:
        r, half = self.responses_plain(raw), CHUNK // 2
        short = -len(r) % half
        r = np.concatenate([r, np.full((short, FILTERS), -1e9, r.dtype)]).reshape(-1, half, FILTERS)
        tops, places = r.max(1), r.argmax(1) + half * np.arange(len(r))[:, None]
        if len(tops) > 1:
            later = tops[1:] > tops[:-1]
            at, top = np.where(later, places[1:], places[:-1]), np.maximum(tops[:-1], tops[1:])
        else:
            at, top = places, tops
        chunk = np.maximum(top, 0)
        feature = np.concatenate([chunk.mean(0), chunk.max(0)])
        z = float(feature @ self.out) + self.offset
        error = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - label) / batch
        grads[2] += error * feature
        grads[3] += error
        g = np.repeat((error * self.out[:FILTERS] / len(chunk))[None, :], len(chunk), 0)
        g[chunk.argmax(0), np.arange(FILTERS)] += error * self.out[FILTERS:]
        g = np.where(top > 0, g, 0)
        columns = np.broadcast_to(np.arange(FILTERS), at.shape)
        for j in range(WIDTH):
            np.add.at(grads[0][j], (raw[at + j], columns), g)
        grads[1] += g.sum(0)


def fit_quality(documents: DataFrame, labels: DataFrame, per_label: int = FIT_PER_LABEL, max_chars: int = FIT_CHARS) -> ByteNetwork:
    """Fits on at most ``per_label`` documents of each label; the share of label 1 comes from all rows that may be learned from."""
    known = labels.where(~held_out() & F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull())
    counts = {r["quality"]: r["n"] for r in known.groupBy("quality").agg(F.count("*").alias("n")).collect()}
    share = counts.get(1, 0) / sum(counts.values()) if counts else 0.5
    if len(counts) < 2:
        return ByteNetwork.constant(share)
    rng = np.random.default_rng(9)
    texts, marks = [], []
    for label, some in enumerate(labelled_texts(documents, labels, per_label, max_chars, "quality")):
        for text in dict.fromkeys(some):
            words = text.split(b" ")
            at = int(rng.integers(0, max(1, len(words) - EXTRACT_WORDS)))
            texts += [text, b" ".join(words[at : at + int(rng.integers(1, EXTRACT_WORDS + 1))])]
            marks += [label, label]
    return ByteNetwork.fit(texts, marks, share) if len(set(marks)) == 2 else ByteNetwork.constant(share)


def score_quality(documents: DataFrame, network: ByteNetwork, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score and predicted of every row."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            known: dict[bytes, float] = {}
            scores = []
            for text in blob_list(column_of(batch, "text")):
                text = text or b""
                if text not in known:
                    known[text] = network.score(text)
                scores.append(known[text])
            s = np.array(scores)
            yield pa.RecordBatch.from_arrays([column_of(batch, "doc_id"), column_of(batch, "held_out"), pa.array(s), pa.array((s >= threshold).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    rows = bounded_batches(documents).select("doc_id", held_out().alias("held_out"), "text")
    own = documents.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(emit, f"doc_id {own}, held_out boolean, score double, predicted int")
