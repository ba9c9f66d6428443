"""Token arrays of an Arrow batch as integer codes, and what is counted over them.

A batch is worked through in runs of rows of bounded token count, each distinct
token of a run becomes one Python string, and all else stays in Arrow and NumPy
arrays: a worker's memory follows the batch's bytes, not its tokens.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .lcs import lcs_length

RUN_TOKENS = 200_000


def lengths(lists: pa.Array) -> np.ndarray:
    """Elements of each list; a null list has none."""
    return pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)


def runs(*sides: pa.Array, most: int = RUN_TOKENS) -> Iterator[tuple[pa.Array, ...]]:
    """Consecutive rows of the lists with at most ``most`` tokens, or one row with more."""
    ends, n, at = np.cumsum(sum(lengths(s) for s in sides)), len(sides[0]), 0
    while at < n:
        stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, side="right")))
        yield tuple(s.slice(at, stop - at) for s in sides)
        at = stop


def coded(ref: pa.Array, cand: pa.Array, stem: Callable[[str], str] | None = None) -> tuple[np.ndarray, pa.Array]:
    """The codes of all tokens of ``ref``, then of ``cand``, and what they stand for: the distinct tokens, or their stems."""
    tokens = pa.concat_arrays([ref.flatten(), cand.flatten()]).dictionary_encode()
    codes, words = tokens.indices.to_numpy(zero_copy_only=False).astype(np.int64), tokens.dictionary
    if stem is not None:
        stems = pa.array([stem(w) for w in words.to_pylist()], words.type).dictionary_encode()
        codes, words = stems.indices.to_numpy(zero_copy_only=False).astype(np.int64)[codes], stems.dictionary
    return codes, words


def lcs_lengths(codes: np.ndarray, n_ref: np.ndarray, n_cand: np.ndarray) -> np.ndarray:
    """The LCS length of each row, whose codes lie as ``coded`` gives them."""
    r, c = np.concatenate([[0], np.cumsum(n_ref)]), np.concatenate([[0], np.cumsum(n_cand)])
    c += r[-1]
    return np.array([lcs_length(codes[r[i]:r[i + 1]].tolist(), codes[c[i]:c[i + 1]].tolist()) for i in range(len(n_ref))], np.int32)


def clipped_matches(codes: np.ndarray, n_ref: np.ndarray, n_cand: np.ndarray, top: int) -> np.ndarray:
    """(row, order - 1): the n-grams of orders 1 to ``top`` that both sides of a row hold, each as often as on the side
    that holds it less often. An n-gram is known by its first n-1 tokens' number and its last token's code."""
    rows, n = len(n_ref), np.concatenate([n_ref, n_cand])
    row = np.repeat(np.concatenate([np.arange(rows)] * 2), n)
    left = np.repeat(np.cumsum(n), n) - np.arange(len(codes))  # tokens from here to the text's end
    width = int(codes.max(initial=0)) + 1
    out, known, split = np.zeros((rows, top), np.int32), row, int(n_ref.sum())
    for k in range(top):
        at = np.flatnonzero(left > k)
        if not len(at):
            break
        _, first, gram = np.unique(known[at] * width + codes[at + k], return_index=True, return_inverse=True)
        held = np.searchsorted(at, split)
        both = np.minimum(np.bincount(gram[:held], minlength=len(first)), np.bincount(gram[held:], minlength=len(first)))
        out[:, k] = np.bincount(row[at[first]], weights=both, minlength=rows)
        known = np.zeros(len(codes), np.int64)
        known[at] = gram
    return out


def as_lists(codes: np.ndarray, n: np.ndarray, words: pa.Array) -> pa.Array:
    """Lists of ``n`` words each, in the order of ``codes``."""
    offsets = pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32))
    return pa.ListArray.from_arrays(offsets, words.take(pa.array(codes)).cast(pa.string()))
