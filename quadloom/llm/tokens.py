"""Encode a corpus with a public byte-level BPE tokenizer by forced-boundary splitting.

A pair of bytes that occurs inside no token of the vocabulary can never be merged,
so a token ends between the two. Where cutting there also leaves the tokenizer's
word splitting as it was, the cut is certain: the parts are encoded apart and
their ids concatenated. The word pattern of the tokenizers has no look-behind and
looks ahead only past white space, hence a cut is certain if

* the left byte doesn't end a white-space character, and
* the right byte starts a character, and
* the right byte is no apostrophe after anything but a letter or digit (an
  apostrophe at the start of a part could open a contraction).

Both rules are a table of 65,536 flags. Cuts of a whole Arrow batch are found by
indexing that table with its bytes; equal parts of a batch are encoded once, and a
bounded cache keeps the ids of parts across batches. Work is done in slices that
end at cuts, so memory doesn't grow with the length of a text, apart from its ids.

Defined results: the ids of a null or empty text are an empty list, its count is
0. Nothing in a text is a special token. Texts are never truncated. Equal texts
are encoded alike. An empty table gives no rows. Only the named columns are read.
"""

from __future__ import annotations

import base64
import os
import re
from collections.abc import Callable, Iterator
from functools import cache
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame

#: Folder of the public tokenizers' files; the environment or a parameter may name another.
TOKENIZERS = os.environ.get("QUADLOOM_TOKENIZERS", "/opt/tokenizers")
# Fixed value: the word pattern that byte_bpe_50k and byte_bpe_multi_50k are used with.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
# Last bytes of the white-space characters beyond ASCII (U+0085, U+00A0, U+1680, U+2000-200A, U+2028, U+2029, U+202F, U+205F, U+3000).
_SPACE_ENDS = [*range(0x80, 0x8B), 0x85, 0x9F, 0xA0, 0xA8, 0xA9, 0xAF]
_ASCII_SPACE = [*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85]

_WS = r"[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
_SPACE = re.compile(f"{_WS}+")
_PIECES = re.compile(rf"{_WS}+(?={_WS}|\Z)|{_WS}?(?:(?!{_WS})[\s\S])+|{_WS}")

SLICE_BYTES = 1 << 20
CACHED_PARTS = 150_000


class Encoder:
    """Ids and cut table of one vocabulary; made once per Python worker."""

    def __init__(self, name: str, folder: str):
        import tiktoken

        with (Path(folder) / f"{name}.tiktoken").open("rb") as lines:
            ranks = {base64.b64decode(t): int(n) for t, n in map(bytes.split, lines)}
        self._encoding = tiktoken.Encoding(name, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        inside = np.zeros(65536, bool)
        joined = np.frombuffer(b"".join(ranks), np.uint8).astype(np.uint16)
        ends = np.cumsum([len(t) for t in ranks])
        pairs = (joined[:-1] << 8) | joined[1:]
        within = np.ones(len(pairs), bool)
        within[ends[:-1] - 1] = False
        inside[pairs[within]] = True
        left, right = np.divmod(np.arange(65536), 256)
        word = ((left >= 48) & (left <= 57)) | ((left >= 65) & (left <= 90)) | ((left >= 97) & (left <= 122))
        self.cuts = ~inside & ~np.isin(left, _ASCII_SPACE + _SPACE_ENDS) & ((right < 0x80) | (right >= 0xC0)) & ((right != 0x27) | word)
        self._known: dict[bytes, np.ndarray] = {}

    def encode_part(self, part: bytes) -> list[int]:
        """The ids of one part, which has no certain cut or needs none."""
        text = part.decode("utf-8")
        if len(part) < 50_000:
            return self._encoding.encode_ordinary(text)
        # The library's pattern engine recurses in long runs of white space. Each run is a word of its own but for its last character.
        ids: list[int] = []
        for piece in _PIECES.findall(text):
            if len(piece) > 1 and _SPACE.fullmatch(piece):
                ids += self._encoding._core_bpe.encode_single_piece(piece.encode("utf-8"))
            else:
                ids += self._encoding.encode_ordinary(piece)
        return ids

    def slices(self, data: np.ndarray, ends: np.ndarray) -> Iterator[np.ndarray]:
        """Ascending cut positions, slice by slice: each array starts where the one before ended. `ends` are the texts' ends."""
        at, n = 0, len(data)
        span = SLICE_BYTES
        while at < n:
            stop = min(n, at + span)
            block = data[at : min(n, stop + 1)]
            flags = np.zeros(stop - at + 1, bool)  # is there a cut so many bytes after `at`?
            flags[1 : len(block)] = self.cuts[(block[:-1].astype(np.uint16) << 8) | block[1:]]
            flags[ends[np.searchsorted(ends, at, "right") : np.searchsorted(ends, stop, "right")] - at] = True
            cuts = np.flatnonzero(flags) + at
            if not len(cuts):
                span *= 2  # a part longer than the slice
                continue
            yield np.concatenate([[at], cuts])
            at, span = int(cuts[-1]), SLICE_BYTES

    def parts(self, data: pa.Buffer, cuts: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        """For the parts between the cuts: a code each, and the ids by code."""
        offsets = pa.py_buffer((cuts - cuts[0]).astype(np.int32))
        coded = pa.Array.from_buffers(pa.binary(), len(cuts) - 1, [None, offsets, data.slice(int(cuts[0]), int(cuts[-1] - cuts[0]))]).dictionary_encode()
        known = self._known
        if len(known) > CACHED_PARTS:
            known.clear()
        ids = []
        for part in coded.dictionary.to_pylist():
            found = known.get(part)
            if found is None:
                found = np.array(self.encode_part(part), np.int32)
                if len(part) <= 64:
                    known[part] = found
            ids.append(found)
        return coded.indices.to_numpy(), ids

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts, one after the other, and the number of ids of each text."""
        data, starts, ends = _bytes_of(texts)
        chunks, at_cuts, upto = [], [], []
        total = 0
        for cuts in self.slices(data[1], ends):
            codes, ids = self.parts(data[0], cuts)
            lengths = np.fromiter(map(len, ids), np.int64, len(ids))
            flat, first = np.concatenate(ids) if ids else np.zeros(0, np.int32), np.cumsum(lengths) - lengths
            each = lengths[codes]
            seen = np.cumsum(each)
            place = np.arange(seen[-1]) + np.repeat(first[codes] - (seen - each), each)
            chunks.append(flat[place])
            at_cuts.append(cuts[1:])
            upto.append(total + seen)
            total += int(seen[-1])
        return np.concatenate(chunks) if chunks else np.zeros(0, np.int32), _counts(at_cuts, upto, starts, ends)

    def count(self, texts: pa.Array) -> np.ndarray:
        """The number of ids of each text."""
        data, starts, ends = _bytes_of(texts)
        at_cuts, upto, total = [], [], 0
        for cuts in self.slices(data[1], ends):
            codes, ids = self.parts(data[0], cuts)
            seen = np.cumsum(np.fromiter(map(len, ids), np.int64, len(ids))[codes])
            at_cuts.append(cuts[1:])
            upto.append(total + seen)
            total += int(seen[-1])
        return _counts(at_cuts, upto, starts, ends)


def _bytes_of(texts: pa.Array) -> tuple[tuple[pa.Buffer, np.ndarray], np.ndarray, np.ndarray]:
    """The UTF-8 bytes of the non-null texts in a row, and where each text starts and ends."""
    texts = pa.array(texts, pa.large_string()) if not isinstance(texts, pa.Array) else texts.cast(pa.large_string())
    texts = texts.fill_null("")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    buffer = texts.buffers()[2] or pa.py_buffer(b"")
    buffer = buffer.slice(int(offsets[0]), int(offsets[-1] - offsets[0]))
    offsets = offsets - offsets[0]
    return (buffer, np.frombuffer(buffer, np.uint8)), offsets[:-1], offsets[1:]


def _counts(at_cuts: list[np.ndarray], upto: list[np.ndarray], starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    if not at_cuts:
        return np.zeros(len(starts), np.int64)
    at, seen = np.concatenate([[0], *at_cuts]), np.concatenate([[0], *upto])
    return seen[np.searchsorted(at, ends)] - seen[np.searchsorted(at, starts)]


@cache
def encoder(name: str, folder: str) -> Encoder:
    return Encoder(name, folder)


def _small_batches(batches: Iterator[pa.RecordBatch], limit: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Batches of some MB each, or of one text."""
    for batch in batches:
        lengths = np.cumsum(pa.compute.binary_length(batch.column(1)).fill_null(0).to_numpy(zero_copy_only=False), dtype=np.int64)
        at = 0
        while at < batch.num_rows:
            stop = max(at + 1, int(np.searchsorted(lengths, (lengths[at - 1] if at else 0) + limit)))
            yield batch.slice(at, stop - at)
            at = stop


def _run(name: str, folder: str, make: Callable[[Encoder, pa.Array], pa.Array], column: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(name, folder)
        for batch in _small_batches(batches):
            yield pa.RecordBatch.from_arrays([batch.column(0), make(enc, batch.column(1))], names=[batch.schema.names[0], column])

    return run


def _id_lists(enc: Encoder, texts: pa.Array) -> pa.Array:
    ids, counts = enc.encode(texts)
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), pa.array(ids, pa.int32()))


def _id_counts(enc: Encoder, texts: pa.Array) -> pa.Array:
    return pa.array(enc.count(texts), pa.int64())


def encode_texts(df: DataFrame, key: str, text: str, tokenizer: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> DataFrame:
    """(key, ids): the token ids of every text, in order. One row for every row of `df`; no shuffle."""
    kind = df.schema[key].dataType.simpleString()
    return df.select(key, text).mapInArrow(_run(tokenizer, folder, _id_lists, "ids"), f"`{key}` {kind}, ids array<int>")


def count_tokens(df: DataFrame, key: str, text: str, tokenizer: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> DataFrame:
    """(key, tokens): the number of token ids of every text."""
    kind = df.schema[key].dataType.simpleString()
    return df.select(key, text).mapInArrow(_run(tokenizer, folder, _id_counts, "tokens"), f"`{key}` {kind}, tokens bigint")
