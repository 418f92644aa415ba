"""Texts as indices into a dictionary of their distinct parts.

A tokenizer that never joins two neighbouring parts of a text gives the same ids
part by part, so each distinct part of a chunk of texts is encoded once.  Chunks
hold about ``limit`` bytes of text (or one document, if that is longer) and are
gathered over Arrow batches of one task.
"""

from __future__ import annotations

import functools
import itertools

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK = 8 << 20
KEPT_WORDS = 100_000
BLANKS = r"[\x20\x09-\x0D]"


def gathered(batches, limit: int = CHUNK, text: str = "text"):
    """Tables of about ``limit`` bytes of ``text`` made of the rows of ``batches``."""
    held, size = [], 0
    for batch in batches:
        at = batch.schema.get_field_index(text)
        sizes = pc.fill_null(pc.binary_length(batch.column(at)), 0).to_numpy(zero_copy_only=False)
        first = 0
        for i, s in enumerate(sizes):
            if size and size + s > limit:
                yield pa.Table.from_batches([*held, batch.slice(first, i - first)])
                held, size, first = [], 0, i
            size += int(s)
        if first < len(sizes):
            held.append(batch.slice(first))
    if held:
        yield pa.Table.from_batches(held)


def flat_lists(lists) -> tuple[np.ndarray, pa.Array]:
    """Row bounds (from 0) and the values of a list column without nulls."""
    lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    return np.concatenate([[0], np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False))]).astype(np.int64), lists.flatten()


def distinct(parts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Distinct values and the index of every value."""
    coded = parts.dictionary_encode()
    return coded.dictionary, coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)


def by_frequency(parts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """As ``distinct``, the most frequent value first."""
    values, at = distinct(parts)
    order = np.argsort(-np.bincount(at, minlength=len(values)), kind="stable")
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    return values.take(pa.array(order)), rank[at]


def spread(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For consecutive groups of ``lengths``: group of each member, its number in the group."""
    group = np.repeat(np.arange(len(lengths)), lengths)
    return group, np.arange(len(group)) - np.repeat(np.cumsum(lengths) - lengths, lengths)


def sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sum of ``values`` in each range of ``bounds`` (0 for an empty range)."""
    total = np.concatenate([[0], np.cumsum(values)])
    return total[bounds[1:]] - total[bounds[:-1]]


def vocabulary_path(path: str) -> str:
    """``path`` if it is one, else the place of that public tokenizer file on this machine."""
    if "/" in path:
        return path
    import public_tokenizers
    return public_tokenizers.path(path)


@functools.lru_cache(8)
def tokenizer(path: str, plain: bool = False):
    """A tokenizer of the ``tokenizers`` library, loaded once a worker;
    ``plain``: strings of special tokens are ordinary text."""
    import os
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer
    loaded = Tokenizer.from_file(vocabulary_path(path))
    loaded.encode_special_tokens = plain
    return loaded


@functools.lru_cache(8)
def pieces_model(path: str):
    import sentencepiece
    return sentencepiece.SentencePieceProcessor(model_file=vocabulary_path(path))


class Encoded:
    """Ids of parts of texts.  The first ``KEPT_WORDS`` distinct parts a worker meets
    are remembered (callers give frequent parts first), the others encoded again."""

    SLICE = 4096

    def __init__(self, encode):
        self.encode, self.row = encode, {}
        self.flat, self.first = np.zeros(0, np.int32), np.zeros(1, np.int64)

    def __call__(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Number of ids of each part, and all ids in order."""
        get = self.row.get
        rows = np.fromiter((get(p, -1) for p in parts), np.int64, len(parts))
        new = np.flatnonzero(rows < 0)
        flat, sizes = [self.flat], []
        for at in range(0, len(new), self.SLICE):       # a tokenizer's own results take a kilobyte a part
            lists = self.encode([parts[i] for i in new[at:at + self.SLICE].tolist()])
            sizes.append(np.fromiter(map(len, lists), np.int64, len(lists)))
            flat.append(np.fromiter(itertools.chain.from_iterable(lists), np.int32, int(sizes[-1].sum())))
        flat = np.concatenate(flat)
        first = np.concatenate([self.first, self.first[-1] + np.cumsum(np.concatenate([np.zeros(0, np.int64), *sizes]))])
        known = len(self.row)
        rows[new] = known + np.arange(len(new))
        kept = new[:max(0, KEPT_WORDS - known)].tolist()
        self.row.update((parts[i], known + n) for n, i in enumerate(kept))
        self.first = first[:known + len(kept) + 1].copy()
        self.flat = flat[:self.first[-1]].copy()
        lengths = np.diff(first)[rows]
        part, nth = spread(lengths)
        return lengths, flat[first[rows][part] + nth]
