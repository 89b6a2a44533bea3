"""The different words of many texts, numbered, inside tasks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from hostweave.llm import kernel


def ranges(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start, start + 1, ... for every range, end to end."""
    ahead = np.cumsum(size) - size
    return np.repeat(start - ahead, size) + np.arange(int(size.sum()))


def parts(data: np.ndarray, first: np.ndarray) -> pa.Array:
    """Texts from ``data``, cut at ``first`` (which ends with the size of ``data``)."""
    return pa.LargeStringArray.from_buffers(len(first) - 1, pa.py_buffer(first.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data)))


def numbered(texts: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """A number for each text, the same for equal ones, and the texts by number."""
    coded = pc.dictionary_encode(texts)
    return coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """The words of a piece without what lies between them, and the index of each text's first word."""
    found = kernel.words(data, offsets)
    first = np.concatenate([[0], np.cumsum(found.end - found.start)])
    return parts(data[~kernel.SPACE[data]], first), found.first
