"""Language identification with a string kernel.

The blended spectrum presence kernel counts the byte n-grams (1 to 3) that two texts share, divided by the root of the
numbers that each has. The Nyström method maps a text to its kernel values with ``LANDMARKS`` labelled texts, whitened;
kernel ridge regression, one language against the rest, is solved there. Kernel values of a batch are one matrix product
of presence rows with the landmarks' rows, and scores another.

Defined results: ``und`` with score 0 for a null text, a text without any letter, and every text when nothing could be
learned; a letter is what Unicode calls one (no digit, fraction or numeral). Rows with a null lang or a held-out doc_id are
never learned from; a null doc_id is not held out; equal scores go to the language that is first in the alphabet; texts of
any length are judged whole; repeated rows are judged one by one; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kindra.llm.common import blob_list, bounded_batches, chunks, column_of, held_out, spread_text

#: Bounds of the fit: labelled texts of each language, characters of each (windows spread over the whole text of a longer
#: one), and landmarks of each language.
FIT_PER_LANGUAGE, FIT_CHARS, LANDMARKS = 250, 20_000, 24
RIDGE, TRI_BITS = 1e-3, 20
UNKNOWN = "und"
_PLAIN = bytes(b if b >= 0x80 or chr(b).isalpha() else 0x20 for b in range(256))
_BASES = (0, 256, 256 + 65536)
_CODES = 256 + 65536 + (1 << TRI_BITS)
_TRI = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D], np.uint32)


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


def codes(text: str) -> np.ndarray:
    """Numbers of all n-grams of a text, lower-cased, with everything but letters as blanks; trigrams are hashed."""
    raw = np.frombuffer(b" " + text.lower().encode("utf-8", "replace").translate(_PLAIN) + b" ", np.uint8)
    wide = raw.astype(np.uint32)
    two = wide[:-1] * 256 + wide[1:] + _BASES[1]
    three = (wide[:-2] * _TRI[0] + wide[1:-1] * _TRI[1] + wide[2:] * _TRI[2]) >> np.uint32(32 - TRI_BITS)
    return np.concatenate([wide, two, three + _BASES[2]])


@dataclass
class KernelClassifier:
    languages: list[str]
    place: np.ndarray
    landmarks: np.ndarray
    sizes: np.ndarray
    weights: np.ndarray

    def presence(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Presence of the landmarks' n-grams by text, and the number of all distinct n-grams of each."""
        rows, sizes = np.zeros((len(texts), len(self.landmarks) + 1), np.float32), np.zeros(len(texts))
        stamp = np.empty(_CODES, np.int32)
        for i, text in enumerate(texts):
            c = codes(text)
            at = np.arange(len(c), dtype=np.int32)
            stamp[c] = at
            sizes[i] = np.count_nonzero(stamp[c] == at)
            rows[i, self.place[c]] = 1
        return rows[:, :-1], sizes

    def kernel(self, texts: list[str]) -> np.ndarray:
        rows, sizes = self.presence(texts)
        return rows @ self.landmarks / np.sqrt(np.maximum(sizes, 1)[:, None] * self.sizes)

    def scores(self, texts: list[str]) -> np.ndarray:
        return np.column_stack([self.kernel(texts), np.ones(len(texts))]) @ self.weights

    @classmethod
    def fit(cls, texts: list[str], labels: list[str], per_language: int = LANDMARKS) -> KernelClassifier | None:
        languages = sorted(set(labels))
        if not languages:
            return None
        picked = [i for lang in languages for i in [j for j, x in enumerate(labels) if x == lang][:per_language]]
        grams = [np.unique(codes(texts[i])) for i in picked]
        all_grams = np.unique(np.concatenate(grams))
        place = np.full(_CODES, len(all_grams), np.int32)
        place[all_grams] = np.arange(len(all_grams), dtype=np.int32)
        landmarks = np.zeros((len(all_grams), len(picked)), np.float32)
        for k, g in enumerate(grams):
            landmarks[place[g], k] = 1
        model = cls(languages, place, landmarks, np.array([float(len(g)) for g in grams]), np.zeros((len(picked) + 1, len(languages))))
        k_nm = np.concatenate([model.kernel(texts[i : i + 200]) for i in range(0, len(texts), 200)])
        values, vectors = np.linalg.eigh(model.kernel([texts[i] for i in picked]))
        whiten = vectors / np.sqrt(np.maximum(values, 1e-6))
        z = np.column_stack([k_nm @ whiten, np.ones(len(texts))])
        target = np.where(np.array(labels)[:, None] == np.array(languages)[None, :], 1.0, -1.0)
        # Each language weighs the same, however many texts it has.
        weight = 1 / np.array([labels.count(x) for x in labels])[:, None]
        solved = np.linalg.solve(z.T @ (z * weight) + RIDGE * np.eye(z.shape[1]), z.T @ (target * weight))
        model.weights = np.vstack([whiten @ solved[:-1], solved[-1:]])
        return model


def fit_languages(documents: DataFrame, per_language: int = FIT_PER_LANGUAGE, max_chars: int = FIT_CHARS) -> KernelClassifier | None:
    """Fits on about ``per_language`` texts of each language, drawn by a hash of doc_id at a rate that the language's count sets."""
    rows = documents.select("doc_id", "text", "lang").where(~held_out() & F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull())
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return None
    draw = F.pmod(F.xxhash64("doc_id", F.lit("language")), F.lit(1 << 30))
    rate = None
    for lang, n in sorted(counts.items()):
        limit = min(1 << 30, int((1 << 30) * 2 * per_language / n))
        rate = F.when(F.col("lang") == lang, limit) if rate is None else rate.when(F.col("lang") == lang, limit)
    drawn = rows.where(draw < rate).select("doc_id", "lang", spread_text(F.col("text"), max_chars).alias("text"), draw.alias("draw")).orderBy("draw", "doc_id", "text").limit(4 * per_language * len(counts)).collect()
    texts, labels, seen, taken = [], [], set(), dict.fromkeys(counts, 0)
    for r in drawn:
        if r.text not in seen and has_letter(r.text) and taken[r.lang] < per_language:
            seen.add(r.text)
            taken[r.lang] += 1
            texts.append(r.text)
            labels.append(r.lang)
    return KernelClassifier.fit(texts, labels)


def identify_languages(documents: DataFrame, model: KernelClassifier | None) -> DataFrame:
    """doc_id, held_out, lang_pred and score (the softmax of the scores) of every row."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, limit=1 << 20):
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts = [x.decode("utf-8", "replace") if x else "" for x in blob_list(column_of(part, "text"))]
                known = [i for i, x in enumerate(texts) if model is not None and has_letter(x)]
                names, best = [UNKNOWN] * len(texts), np.zeros(len(texts))
                if known:
                    s = model.scores([texts[i] for i in known]) * 4
                    p = np.exp(s - s.max(1, keepdims=True))
                    p /= p.sum(1, keepdims=True)
                    best[known] = p.max(1)
                    for i, k in zip(known, p.argmax(1).tolist(), strict=True):
                        names[i] = model.languages[k]
                yield pa.RecordBatch.from_arrays([column_of(part, "doc_id"), column_of(part, "held_out"), pa.array(names, pa.string()), pa.array(best)], ["doc_id", "held_out", "lang_pred", "score"])

    rows = bounded_batches(documents).select("doc_id", held_out().alias("held_out"), "text")
    own = documents.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(emit, f"doc_id {own}, held_out boolean, lang_pred string, score double")
