"""Removal of repeated word windows by compressed FM-indexes of bounded shards."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from codelattice.llm.common import ranges, utf8_column, words_of
from codelattice.llm.fm_index import FMIndex
from codelattice.llm.windows import Windows, remove


def _index(segments: pa.Array, first: np.ndarray, kind: Windows) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each window of the distinct segments: segment, offset, and the first place of the same words.

    Every window is a pattern; those that reach the whole length are reported with
    their interval, and an interval stands for one sequence of words.
    """
    data, bounds = utf8_column(segments)
    words, ends = words_of(data, bounds[1:])
    n = np.diff(np.append(0, ends))
    coded = words.dictionary_encode()
    # the text: each segment, its symbols moved up by one, then a separator of 0
    text = np.zeros(len(words) + len(n), np.int64)
    start = np.append(0, ends)[:-1] + np.arange(len(n))
    text[np.arange(len(words)) + np.repeat(np.arange(len(n)), n)] = coded.indices.to_numpy() + 1
    windows = n - kind.length + 1
    owner, offset = np.repeat(np.arange(len(n)), windows), ranges(np.zeros(len(n), np.int64), windows)
    at = start[owner] + offset
    places = first[owner] + (offset if kind.within else 0)
    least = places.copy()
    if len(at):
        found, interval = FMIndex(text, kind.length).statistics(text, at + kind.length, kind.length)
        hit = np.flatnonzero(found >= kind.length)
        order = hit[np.argsort(interval[hit], kind="stable")]
        if len(order):
            cuts = np.flatnonzero(np.append(True, interval[order][1:] != interval[order][:-1]))
            least[order] = np.repeat(np.minimum.reduceat(places[order], cuts), np.diff(np.append(cuts, len(order))))
    return owner, offset, least


def remove_words(docs: DataFrame, *, length: int = 20, with_text: bool = False) -> DataFrame:
    """Remove each word covered by a window of `length` words that also starts earlier, in this document or another.

    Returns doc_id, n_words, n_removed, n_spans, kept_sha256 per row (and kept). Words
    are runs of anything but ASCII white space. Documents are ordered by doc_id (null
    first), then by the digest of the text; rows equal in both are one document and get
    the same result. Null text has no words, an empty table gives no rows, and other
    columns are ignored. Words are compared by their bytes; hashes only choose the shard.
    """
    kind = Windows(length, max(1, 2 * length // 5), words=True, within=True, index=_index)
    return remove(docs, kind, with_text=with_text).withColumnsRenamed({"units": "n_words", "removed": "n_removed", "spans": "n_spans"})
