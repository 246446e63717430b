"""Token counts of whole texts without tokenizing them.

A byte-level BPE vocabulary is examined once: each of its strings is put through the merges, and those that come out as
one token are proven whole. A text is cut into pre-tokens; a pre-token that is a proven string counts one, and only the
rest is merged (each distinct one once a worker, within bounds). Where no space touches other white space, the text is
cut at single spaces and the count of each piece (with its leading space) is looked up, as no pre-token crosses the start
of such a piece. Other texts are cut by the pre-token pattern as a whole.

Defined results: a null text counts like an empty one, with no bytes and no tokens; special strings are the tokens that
the library makes of them; repeated rows count one by one; other columns are ignored or carried along.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from tokenizers import Tokenizer

from kindra.llm.common import blob_list, bounded_batches, chunks, column_of

OVER = 512
#: Fixed value: the published pattern of the byte-level pre-tokenizer.
PRE_TOKEN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Entries of the two tables that a worker keeps; a full table is emptied.
CACHE = 300_000
#: Longer pieces are counted but not kept.
CACHED_CHARS = 64


@lru_cache(1)
def byte_letters() -> list[str]:
    """The printable letter of each byte: itself where printable in Latin-1, else the next from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return [chr(b) if b in plain else chr(256 + rest.index(b)) for b in range(256)]


class TokenCounter:
    def __init__(self, path: str) -> None:
        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre, post = spec["pre_tokenizer"], spec.get("normalizer")
        if spec["model"]["type"] != "BPE" or pre["type"] != "ByteLevel" or pre["add_prefix_space"] or post is not None:
            raise ValueError("only a byte-level BPE without normalizer or prefix space can be counted by pre-tokens")
        self.special = [t["content"] for t in spec["added_tokens"]]
        if any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in spec["added_tokens"]):
            raise ValueError("added tokens must match plainly")
        self.special_cut = regex.compile("|".join(regex.escape(x) for x in sorted(self.special, key=len, reverse=True))) if self.special else None
        self.find = regex.compile(PRE_TOKEN).findall
        self.touching = regex.compile(r"\s | \s").search
        self.letters = byte_letters()
        self.whole = self.proven()
        self.pieces: dict[str, int] = {}
        self.merged: dict[str, int] = {}

    def proven(self) -> set[str]:
        """The texts whose vocabulary strings encode alone as one token, found by encoding each of them. A string that is
        no UTF-8 text can't be a pre-token, one that the pattern cuts can't either; they do no harm."""
        value = {c: b for b, c in enumerate(self.letters)}
        out = set()
        for token in self.tokenizer.get_vocab(with_added_tokens=False):
            if token not in self.special and len(self.tokenizer.model.tokenize(token)) == 1:
                try:
                    out.add(bytes(value[c] for c in token).decode())
                except UnicodeDecodeError:
                    continue
        return out

    def merge(self, pre_token: str) -> int:
        n = self.merged.get(pre_token)
        if n is None:
            n = len(self.tokenizer.model.tokenize("".join(self.letters[b] for b in pre_token.encode())))
            if len(pre_token) <= CACHED_CHARS:
                if len(self.merged) >= CACHE:
                    self.merged.clear()
                self.merged[pre_token] = n
        return n

    def span(self, text: str) -> int:
        whole, merge = self.whole, self.merge
        return sum(1 if p in whole else merge(p) for p in self.find(text))

    def plain(self, text: str) -> int:
        """Tokens of a text without special strings."""
        if not text:
            return 0
        if self.touching(text):
            return self.span(text)
        head, *rest = text.split(" ")
        total, get, pieces = self.span(head), self.pieces.get, self.pieces
        for piece in rest:
            n = get(piece)
            if n is None:
                n = self.span(" " + piece)
                if len(piece) <= CACHED_CHARS:
                    if len(pieces) >= CACHE:
                        pieces.clear()
                    pieces[piece] = n
            total += n
        return total

    def count(self, text: str) -> int:
        if self.special_cut is not None and (marks := self.special_cut.findall(text)):
            return len(marks) + sum(self.plain(x) for x in self.special_cut.split(text))
        return self.plain(text)


@lru_cache(2)
def counter(path: str) -> TokenCounter:
    """One a worker: its proven strings and tables serve all of its tasks."""
    return TokenCounter(path)


def count_tokens(documents: DataFrame, tokenizer_path: str, over: int = OVER, columns: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``columns`` with n_bytes, n_tokens and over_limit (more than ``over`` tokens)."""
    own = documents.select(*columns).schema

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(tokenizer_path).count
        for batch in chunks(batches):
            texts = blob_list(column_of(batch, "text"))
            tokens = np.array([count(x.decode("utf-8", "replace")) if x else 0 for x in texts], np.int64)
            sizes = np.array([len(x) if x else 0 for x in texts], np.int64)
            yield pa.RecordBatch.from_arrays([*(column_of(batch, c) for c in columns), pa.array(sizes), pa.array(tokens), pa.array(tokens > over)], [*columns, "n_bytes", "n_tokens", "over_limit"])

    fields = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in own), "n_bytes long, n_tokens long, over_limit boolean"])
    return bounded_batches(documents).select(*dict.fromkeys([*columns, "text"])).mapInArrow(emit, fields)
