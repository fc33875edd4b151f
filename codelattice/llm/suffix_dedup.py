"""Removal of repeated byte strings by suffix arrays of bounded shards (two-stage sorting)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from codelattice.llm.common import ranges, utf8_column
from codelattice.llm.suffix_sort import common_prefixes, smaller_than_successor, two_stage_sort
from codelattice.llm.windows import Windows, remove


def _index(segments: pa.Array, first: np.ndarray, kind: Windows) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each window of the distinct segments: segment, offset, and the least first place of the segments that hold it."""
    data, bounds = utf8_column(segments)
    n = np.diff(bounds)
    # the text: each segment, its symbols moved up by one, then a separator of 0
    text = np.zeros(len(data) + len(n), np.uint16)
    start = bounds[:-1] + np.arange(len(n))
    text[np.arange(len(data)) + np.repeat(np.arange(len(n)), n)] = data.astype(np.uint16) + 1
    windows = n - kind.length + 1
    owner, offset = np.repeat(np.arange(len(n)), windows), ranges(np.zeros(len(n), np.int64), windows)
    at = start[owner] + offset
    # a suffix that is larger than its successor needs that one too, up to the first that is smaller
    small = np.flatnonzero(smaller_than_successor(text))
    stop = small[np.searchsorted(small, start + windows - 1)]
    needed = np.zeros(len(text) + 1, np.int64)
    np.add.at(needed, start, 1)
    np.add.at(needed, stop + 1, -1)
    suffixes = two_stage_sort(text, np.cumsum(needed)[:-1] > 0, kind.length)
    number = np.full(len(text), -1)
    number[at] = np.arange(len(at))
    suffixes = suffixes[number[suffixes] >= 0]
    shared = common_prefixes(text, suffixes, kind.length)
    cuts = np.flatnonzero(shared < kind.length)
    window = number[suffixes]
    places = first[owner[window]] + (offset[window] if kind.within else 0)
    least = np.empty(len(at), np.int64)
    if len(at):
        least[window] = np.repeat(np.minimum.reduceat(places, cuts), np.diff(np.append(cuts, len(at))))
    return owner, offset, least


def remove_bytes(docs: DataFrame, *, length: int = 50, with_text: bool = False) -> DataFrame:
    """Remove each byte covered by a `length`-byte string that also starts in an earlier document.

    Returns doc_id, n_bytes, n_removed, n_spans, kept_sha256 per row (and kept).
    Documents are ordered by doc_id (null first), then by the digest of the text;
    rows equal in both are one document and get the same result. Null text is empty,
    an empty table gives no rows, and other columns are ignored. Matches are compared
    on the bytes themselves; hashes only choose the shard.
    """
    kind = Windows(length, max(1, 2 * length // 5), words=False, within=False, index=_index)
    return remove(docs, kind, with_text=with_text).withColumnsRenamed({"units": "n_bytes", "removed": "n_removed", "spans": "n_spans"})
