"""Quality rules: text statistics, and a linear-chain conditional random field that marks lines as content or boilerplate.

The field has two states a line, linear emission scores of line features, and transition scores. Labels mark documents,
so lines with both labels in one text are made by splicing: half of the training sequences are runs of lines of one
labelled document, the others alternate runs of clean and of junk documents, and each line has the label of the document
it comes from. The field is fitted by gradient steps on their log-likelihood. Viterbi decoding labels the lines of a whole
text; the share of word characters in content lines decides retention.

Defined results: a null or wordless text has no words and fails the base rules; a document fails them with fewer than
``MIN_WORDS`` words or over ``MAX_REPEAT`` percent of them in repeated windows; ties in decoding go to content; texts of
any length are judged whole; repeated rows are judged one by one; other columns are carried along unless one is named like
a result. Without labelled texts of both kinds nothing can be learned: every line is content, and a warning says so.
"""

from __future__ import annotations

import warnings
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kindra.llm.common import Words, blob_list, bounded_batches, chunks, column_of, gram_hash, gram_places, labelled_texts, mixed, words_of

MIN_WORDS, MAX_REPEAT, REPEAT_WINDOW = 10, 20, 5
#: Share of word characters that content lines must have.
CONTENT_SHARE = 0.5
#: Bounds of the fit: documents of each label (least hash of doc_id first), characters of each (windows spread over the whole
#: text of a longer one), steps, training sequences, and lines of a run of one document and of a spliced run.
FIT_PER_LABEL, FIT_CHARS, FIT_STEPS = 600, 20_000, 120
SEQUENCES, OWN_RUN, SPLICED_RUN, SPLICED_RUNS = 1600, 24, 6, 4


def _table(chars: bytes) -> np.ndarray:
    out = np.zeros(256, np.uint8)
    out[list(chars)] = 1
    return out


_SPACE = b" \t\n\v\f\r"
_LEAD = np.array([(b & 0xC0) != 0x80 and b not in _SPACE for b in range(256)], np.uint8)
_CLASSES = {
    "symbol": _table(b"#*$%&|<>"),
    "upper": _table(bytes(range(0x41, 0x5B))),
    "digit": _table(b"0123456789"),
    "bar": _table(b"|"),
    "shout": _table(b"!"),
    "mark": _table(b"\"'()+,-./:;=?@[]\\^_`{}~"),
}
_SENTENCE_END = _table(b".!?")
FEATURES = ("bias", "length", "symbol", "upper", "digit", "bar", "shout", "mark", "ends", "word_length", "echo", "repeated", "some_symbols", "many_symbols", "mostly_upper", "shouts", "bars", "empty")


@dataclass
class Stats:
    """Figures by document, and features by line; document d has lines first_line[d]:first_line[d + 1]."""

    n_words: np.ndarray
    word_chars: np.ndarray
    n_symbols: np.ndarray
    n_dup_lines: np.ndarray
    n_repeat_words: np.ndarray
    features: np.ndarray
    line_chars: np.ndarray
    first_line: np.ndarray


def _sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    return total[bounds[1:]] - total[bounds[:-1]]


def repeated_words(words: Words, window: int = REPEAT_WINDOW) -> np.ndarray:
    """By document: words inside a window that its text holds twice or more."""
    n = len(words.starts)
    at = gram_places(words, window)
    covered = np.zeros(n + window, np.bool_)
    if len(at):
        doc = np.repeat(np.arange(len(words.first) - 1), words.counts())
        key = gram_hash(words.hashes[0], window)[at] ^ mixed(doc[at].astype(np.uint64) + np.uint64(1))
        order = np.argsort(key, kind="stable")
        same = key[order][1:] == key[order][:-1]
        twice = np.zeros(len(at), np.bool_)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        for j in range(window):
            covered[at[twice] + j] = True
    return _sums(covered[:n], words.first)


def examine(texts: list[bytes | None]) -> Stats:
    words = words_of(texts)
    raw = np.frombuffer(words.buffer, np.uint8)
    breaks = np.flatnonzero(raw == 0x0A)
    starts = np.concatenate([[0], breaks[:-1] + 1])
    bounds = np.append(starts, len(raw))
    first_line = np.searchsorted(starts, words.offsets)
    by_line = {name: _sums(lut[raw], bounds) for name, lut in _CLASSES.items()}
    lead = _LEAD[raw]
    line_chars = _sums(lead, bounds)
    line_words = np.diff(np.append(np.searchsorted(words.starts, starts), len(words.starts)))
    h = words.hashes[0]
    echo = np.zeros(len(h), np.uint8)
    echo[1:] = h[1:] == h[:-1]
    first_word = np.append(np.searchsorted(words.starts, starts), len(words.starts))
    echoes = _sums(echo, first_word)
    last = raw[np.maximum(breaks - 1, 0)]
    repeated = np.zeros(len(starts), np.float32)
    n_dup = np.zeros(len(texts), np.int64)
    for d, text in enumerate(texts):
        lines = (text or b"").split(b"\n")
        solid = [x for x in lines if not x.isspace() and x]
        n_dup[d] = len(solid) - len(set(solid))
        if n_dup[d]:
            seen: set[bytes] = set()
            for k, x in enumerate(lines):
                if x and not x.isspace():
                    repeated[first_line[d] + k] = x in seen
                    seen.add(x)
    chars = np.maximum(line_chars, 1)
    share = {name: v / chars for name, v in by_line.items()}
    columns = [
        np.ones(len(starts)), np.log1p(line_chars) / 5, share["symbol"], share["upper"], share["digit"], share["bar"], share["shout"], share["mark"],
        _SENTENCE_END[last] * (line_chars > 0), np.minimum(line_chars / np.maximum(line_words, 1) / 10, 3), echoes / np.maximum(line_words, 1), repeated,
        share["symbol"] > 0.05, share["symbol"] > 0.2, share["upper"] > 0.5, share["shout"] > 0.05, by_line["bar"] >= 2, line_chars == 0,
    ]
    features = np.stack([np.asarray(c, np.float32) for c in columns], 1)
    return Stats(words.counts(), _sums(lead, words.offsets), _sums(_CLASSES["symbol"][raw], words.offsets), n_dup, repeated_words(words), features, line_chars, first_line)


@dataclass
class LineField:
    """Two-state linear-chain conditional random field. State 1 is content; emissions are the score of state 1 over state 0."""

    weights: np.ndarray
    transitions: np.ndarray
    start: float

    @classmethod
    def all_content(cls) -> LineField:
        weights = np.zeros(len(FEATURES))
        weights[0] = 1.0
        return cls(weights, np.zeros((2, 2)), 0.0)

    @staticmethod
    def padded(lines: list[np.ndarray], labels: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Features, labels and what is no padding, by sequence and line."""
        longest, n = max(map(len, lines)), len(lines)
        x, y, mask = np.zeros((n, longest, len(FEATURES)), np.float32), np.zeros((n, longest), np.int64), np.zeros((n, longest), np.bool_)
        for d, (f, own) in enumerate(zip(lines, labels, strict=True)):
            x[d, : len(f)], y[d, : len(f)], mask[d, : len(f)] = f, own, True
        return x, y, mask

    @staticmethod
    def gradient(theta: np.ndarray, x: np.ndarray, y: np.ndarray, mask: np.ndarray) -> np.ndarray:
        """Of the log-likelihood of all sequences, by forward and backward sums: what was seen less what is expected.
        ``theta``: weights, the four transitions, start."""
        w, trans, start = theta[:-5], theta[-5:-1].reshape(2, 2), theta[-1]
        longest = x.shape[1]
        emit = np.zeros((*mask.shape, 2))
        emit[:, :, 1] = x @ w
        alpha, beta = np.zeros_like(emit), np.zeros_like(emit)
        alpha[:, 0] = emit[:, 0] + np.array([0.0, start])
        for t in range(1, longest):
            alpha[:, t] = np.logaddexp(alpha[:, t - 1, 0, None] + trans[0], alpha[:, t - 1, 1, None] + trans[1]) + emit[:, t]
        for t in range(longest - 2, -1, -1):
            after = beta[:, t + 1] + emit[:, t + 1]
            new = np.logaddexp(trans[:, 0] + after[:, 0, None], trans[:, 1] + after[:, 1, None])
            beta[:, t] = np.where(mask[:, t + 1, None], new, 0.0)
        log_z = np.logaddexp(alpha[:, 0, 0] + beta[:, 0, 0], alpha[:, 0, 1] + beta[:, 0, 1])
        content = np.exp(np.minimum(alpha[:, :, 1] + beta[:, :, 1] - log_z[:, None], 0))
        residual = np.where(mask, y - content, 0)
        grad = np.zeros_like(theta)
        grad[:-5] = np.einsum("dl,dlf->f", residual, x)
        both = mask[:, 1:]
        pair = np.exp(np.minimum(alpha[:, :-1, :, None] + trans + (emit + beta)[:, 1:, None, :] - log_z[:, None, None, None], 0)) * both[:, :, None, None]
        seen = np.bincount((2 * y[:, :-1] + y[:, 1:])[both], minlength=4)
        grad[-5:-1] = seen - pair.sum((0, 1)).ravel()
        grad[-1] = residual[:, 0].sum()
        return grad

    @classmethod
    def fit(cls, lines: list[np.ndarray], labels: list[np.ndarray], steps: int = FIT_STEPS, rate: float = 0.15, ridge: float = 1e-3) -> LineField:
        """Adam steps on the mean log-likelihood a line, all sequences at once over padded lines."""
        x, y, mask = cls.padded(lines, labels)
        theta = np.zeros(len(FEATURES) + 5)
        m, v = np.zeros_like(theta), np.zeros_like(theta)
        for step in range(1, steps + 1):
            grad = cls.gradient(theta, x, y, mask) / mask.sum() - ridge * theta
            m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
            theta = theta + rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        return cls(theta[:-5].copy(), theta[-5:-1].reshape(2, 2).copy(), float(theta[-1]))

    def decode(self, features: np.ndarray) -> np.ndarray:
        """The likeliest states of a text's lines. Ties go to content."""
        scores = (features @ self.weights).tolist()
        (t00, t01), (t10, t11) = self.transitions.tolist()
        a, b = 0.0, self.start + scores[0]
        back = []
        for s in scores[1:]:
            from0, from1 = (a + t00, b + t10), (a + t01, b + t11)
            back.append((from0[1] >= from0[0], from1[1] >= from1[0]))
            a, b = max(from0), max(from1) + s
        state = b >= a
        out = [state]
        for zero, one in reversed(back):
            state = one if state else zero
            out.append(state)
        return np.array(out[::-1], np.bool_)


def sequences(by_label: tuple[list[bytes], list[bytes]], n: int, seed: int = 11) -> tuple[list[bytes], list[np.ndarray]]:
    """``n`` texts and the labels of their lines: runs of one junk (0) or clean (1) text, and alternating runs of both."""
    rng = np.random.default_rng(seed)
    lines = [[t.split(b"\n") for t in texts] for texts in by_label]

    def run(label: int, longest: int) -> list[bytes]:
        own = lines[label][int(rng.integers(len(lines[label])))]
        size = min(len(own), int(rng.integers(1, longest + 1)))
        at = int(rng.integers(0, len(own) - size + 1))
        return own[at : at + size]

    texts, labels = [], []
    for i in range(n):
        label, spliced = i % 2, i % 4 >= 2
        runs = [(k, run(k, SPLICED_RUN)) for k in ((label + j) % 2 for j in range(int(rng.integers(2, SPLICED_RUNS + 1))))] if spliced else [(label, run(label, OWN_RUN))]
        texts.append(b"\n".join(x for _, own in runs for x in own))
        labels.append(np.array([k for k, own in runs for _ in own]))
    return texts, labels


def fit_line_field(documents: DataFrame, labels: DataFrame, per_label: int = FIT_PER_LABEL) -> LineField:
    """Fits on sequences made of at most ``per_label`` documents of each label that are not held out."""
    junk, clean = labelled_texts(documents, labels, per_label, FIT_CHARS, "lines")
    if not junk or not clean:
        warnings.warn("quality rules: no labelled texts of both kinds, so every line counts as content", stacklevel=2)
        return LineField.all_content()
    texts, marks = sequences((junk, clean), SEQUENCES)
    stats = examine(texts)
    return LineField.fit([stats.features[a:b] for a, b in zip(stats.first_line[:-1], stats.first_line[1:], strict=True)], marks)


RESULTS = pa.schema([(c, pa.int64()) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")] + [("base_failed", pa.bool_()), ("content_share", pa.float64()), ("kept", pa.bool_())])


def quality_rules(documents: DataFrame, field: LineField, columns: list[str] | None = None, content_share: float = CONTENT_SHARE) -> DataFrame:
    """``columns`` (all by default) with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, content_share, kept."""
    carried = [c for c in (documents.columns if columns is None else columns) if c not in RESULTS.names]

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            s = examine(blob_list(column_of(batch, "text")))
            failed = (s.n_words < MIN_WORDS) | (100 * s.n_repeat_words > MAX_REPEAT * s.n_words)
            share = np.zeros(len(failed))
            for d, (a, b) in enumerate(zip(s.first_line[:-1].tolist(), s.first_line[1:].tolist(), strict=True)):
                chars = s.line_chars[a:b]
                if (n := int(chars.sum())) > 0:
                    share[d] = chars[field.decode(s.features[a:b])].sum() / n
            figures = [s.n_words, s.word_chars, s.n_symbols, s.n_dup_lines, s.n_repeat_words, failed, share, ~failed & (share >= content_share)]
            yield pa.RecordBatch.from_arrays([*(column_of(batch, c) for c in carried), *map(pa.array, figures)], schema=pa.schema([*(batch.schema.field(c) for c in carried), *RESULTS]))

    own = [f"`{f.name}` {f.dataType.simpleString()}" for f in documents.schema if f.name in carried]
    fields = ", ".join([*own, *(f"{f.name} {'long' if f.type == pa.int64() else 'double' if f.type == pa.float64() else 'boolean'}" for f in RESULTS)])
    return bounded_batches(documents).select(*dict.fromkeys([*carried, "text"])).mapInArrow(emit, fields)
