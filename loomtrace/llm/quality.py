"""Quality rules, among them repetition found with suffix arrays (operator 4).

Each text gets counts over its words and lines, then a suffix array over its words. Adjacent
suffixes' common prefixes (LCP) give the maximal repeated substrings: at each word the deepest
LCP interval that holds its suffix is the longest repeat that starts there, and the union of
those spans is the union of all maximal repeats. A text is rejected if the spans cover too much
of it or one repeat is too long.

The rules go in order: only texts that pass the base rule have their repeats measured, so ``covered_words`` and
``longest_repeat`` of the others are null.

All texts of a step share one array, with the document as part of each suffix's identity, so the
work is vectorised: prefix doubling sorts only suffixes whose first words already occur twice in
their document. Each step holds a bounded number of bytes (or one text, if it is longer).

Cases: null, empty and blank texts have no words and fail the base rule. Repeated rows are judged
alike. An empty table gives an empty result. Other columns of the input are ignored by
``quality_report`` and untouched by ``keep_good``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .texts import as_bytes, numbered, pieces, working


@dataclass(frozen=True)
class QualityLimits:
    """A text needs ``min_words``; words in repeated windows of ``window`` words may make up
    ``max_repeat_percent``. Of the repeats of ``repeat_words`` words or more, the union may cover
    ``max_covered`` of the words, and the longest ``max_longest`` of them (or ``long_words``,
    if that is more)."""

    min_words: int = 50
    window: int = 3
    max_repeat_percent: int = 50
    repeat_words: int = 10
    max_covered: float = 0.30
    max_longest: float = 0.20
    long_words: int = 40


STATISTICS = pa.schema([(n, pa.int64()) for n in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "covered_words", "longest_repeat")] + [("base_failed", pa.bool_()), ("kept", pa.bool_())])

#: Bytes of text in one step, or one text.
STEP = 1 << 20

_SYMBOL = np.zeros(256, np.uint8)
_SYMBOL[list(b"#*$%&|<>")] = 1
_WORD_CHAR = np.array([int(x & 0xC0 != 0x80 and x != 0x20 and not 9 <= x <= 13) for x in range(256)], np.uint8)


def _covered(lengths: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Which words lie in a span; lengths: words of the span that starts at each word, or 0."""
    at = np.arange(len(lengths), dtype=lengths.dtype)
    return np.maximum.accumulate(np.where(lengths > 0, at + lengths, first)) > at


def repeated_windows(words: np.ndarray, doc: np.ndarray, window: int) -> np.ndarray:
    """Where windows start that occur twice or more in their document.

    words: numbers of the words; doc: the document of each word, ascending.
    """
    n = len(words)
    if n < window:
        return np.zeros(0, doc.dtype)
    inside = np.flatnonzero(doc[: n - window + 1] == doc[window - 1 :])
    key = words[inside].astype(np.int64)
    for k in range(1, window):  # rank anew where the product of ranks might overflow
        if len(key) and int(key.max()) + 1 > (1 << 62) // (int(words.max()) + 1):
            key = np.unique(key, return_inverse=True)[1].astype(np.int64)
        key = key * (int(words.max()) + 1) + words[inside + k]
    order = np.argsort(key, kind="stable")  # equal windows keep the order of their documents
    key, place = key[order], inside[order].astype(doc.dtype)
    del order
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]) | (doc[place[1:]] != doc[place[:-1]])
    starts = np.flatnonzero(new)
    sizes = np.diff(np.append(starts, len(key)))
    return place[np.repeat(sizes > 1, sizes)]


def longest_repeats(words: np.ndarray, doc: np.ndarray, window: int, suffixes: np.ndarray) -> np.ndarray:
    """For each word the length of the longest repeat that starts there (0 below ``window`` words).

    suffixes: the repeated windows of the documents to look at, all of them.
    """
    n, small = len(words), doc.dtype
    longest = np.zeros(n, small)
    if not len(suffixes):
        return longest

    # Ranks by the first `length` words. Those that may follow a repeat without being one are
    # ranked along, by fewer words, so that suffixes which share these too are neighbours in the
    # end; each of them has a rank of its own.
    twice, near = np.zeros(n, bool), np.zeros(n + window + 1, bool)
    twice[suffixes] = True
    for k in range(window + 1):
        near[suffixes + k] = True
    items = np.flatnonzero(near[:n]).astype(small)
    ahead = [np.minimum(items + k, n - 1) for k in range(window)]
    next_words = [np.where((items + k < n) & (doc[x] == doc[items]), words[x], -1) for k, x in enumerate(ahead)]
    by = np.lexsort([items, *next_words[::-1], doc[items]])
    items, next_words = items[by], [x[by] for x in next_words]
    alike = twice[items[1:]] & twice[items[:-1]] & (doc[items[1:]] == doc[items[:-1]])
    for x in next_words:
        alike &= x[1:] == x[:-1]
    rank = np.arange(n, 2 * n, dtype=small)
    rank[items] = np.maximum.accumulate(np.where(np.append(True, ~alike), np.arange(len(items), dtype=small), 0))
    del near, items, ahead, next_words, by, alike
    # What each doubling changes, so that ranks by fewer words come back on the way down.
    undo, length, open_ = [], window, suffixes
    while len(open_):
        undo.append((length, open_, rank[open_]))
        beyond = open_ + length
        inside_doc = (beyond < n) & (doc[np.minimum(beyond, n - 1)] == doc[open_])
        second = np.where(inside_doc, rank[np.minimum(beyond, n - 1)], 3 * n + open_)
        by = np.lexsort((second, rank[open_]))
        open_, first, second = open_[by], rank[open_][by], second[by]
        head = np.append(True, first[1:] != first[:-1])
        run = np.append(True, head[1:] | (second[1:] != second[:-1]))
        at = np.arange(len(open_), dtype=small)
        rank[open_] = first + np.maximum.accumulate(np.where(run, at, 0)) - np.maximum.accumulate(np.where(head, at, 0))
        run_starts = np.flatnonzero(run)
        run_sizes = np.diff(np.append(run_starts, len(open_)))
        open_ = open_[np.repeat(run_sizes > 1, run_sizes)]
        length *= 2

    # Common prefixes of neighbours in the suffix array, by descending powers.
    suffixes = suffixes[np.argsort(rank[suffixes])]
    a, b = suffixes[:-1], suffixes[1:]
    together = doc[a] == doc[b]
    a, b = a[together], b[together]
    lcp = np.zeros(len(a), small)

    def step(size: int, value: np.ndarray) -> None:
        x, y = np.minimum(a + lcp, n - 1), np.minimum(b + lcp, n - 1)
        same = (a + lcp < n) & (b + lcp < n) & (value[x] == value[y]) & (doc[x] == doc[a]) & (doc[y] == doc[b])
        lcp[same] += size

    while undo:
        size, at, before = undo.pop()
        rank[at] = before
        step(size, rank)
    for _ in range(window - 1):  # what is left is shorter than the shortest level
        step(1, words)
    np.maximum.at(longest, a, lcp)
    np.maximum.at(longest, b, lcp)
    longest[longest < window] = 0
    return longest


def measure(column: pa.Array, limits: QualityLimits) -> pa.RecordBatch:
    """Statistics and verdict of each text. Texts that fail the base rule have no repeats measured."""
    texts = as_bytes(column)
    ends = np.cumsum([0] + [len(x) for x in texts])
    data = np.frombuffer(b"".join(texts), np.uint8)

    def counted(table: np.ndarray) -> np.ndarray:
        marked = table[data].astype(bool)
        return np.array([np.count_nonzero(marked[a:b]) for a, b in zip(ends[:-1], ends[1:])], np.int64)

    n_dup_lines = []
    for text in texts:
        lines = [x for x in text.split(b"\n") if x.strip()]
        n_dup_lines.append(len(lines) - len(set(lines)))
        del lines
    _, words, n_words = numbered(texts)
    kind = np.int32 if 4 * len(words) < 1 << 31 else np.int64
    words, doc = words.astype(kind), np.repeat(np.arange(len(texts), dtype=kind), n_words)
    starts = np.append(0, np.cumsum(n_words))[:-1]
    first = np.repeat(starts.astype(kind), n_words)
    again = repeated_windows(words, doc, limits.window)

    def by_doc(x: np.ndarray) -> np.ndarray:
        return np.bincount(doc[x], minlength=len(texts)).astype(np.int64)

    spans = np.zeros(len(words), kind)
    spans[again] = limits.window
    n_repeat = by_doc(_covered(spans, first))
    failed = (n_words < limits.min_words) | (100 * n_repeat > limits.max_repeat_percent * n_words)
    long = longest_repeats(words, doc, limits.window, again[~failed[doc[again]]])
    long[long < limits.repeat_words] = 0
    covered = by_doc(_covered(long, first))
    most = np.zeros(len(texts), np.int64)
    np.maximum.at(most, doc[long > 0], long[long > 0])
    kept = ~failed & (covered <= limits.max_covered * n_words) & (most <= np.maximum(limits.long_words, limits.max_longest * n_words))
    whole = [pa.array(x) for x in (n_words, counted(_WORD_CHAR), counted(_SYMBOL), np.array(n_dup_lines, np.int64), n_repeat)]
    return pa.RecordBatch.from_arrays([*whole, pa.array(covered, mask=failed), pa.array(most, mask=failed), pa.array(failed), pa.array(kept)], schema=STATISTICS)


def quality_report(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", limits: QualityLimits = QualityLimits()) -> DataFrame:
    """One row per document: its id, the statistics, ``base_failed`` and ``kept``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "text", STEP):
                found = measure(part.column("text"), limits)
                yield pa.RecordBatch.from_arrays([part.column("id"), *found.columns], names=[id_col, *STATISTICS.names])

    kinds = ", ".join(f"{f.name} {'boolean' if pa.types.is_boolean(f.type) else 'long'}" for f in STATISTICS)
    source = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"))
    return source.mapInArrow(working("quality", run), f"`{id_col}` {source.schema['id'].dataType.simpleString()}, {kinds}")


def keep_good(docs: DataFrame, *, text_col: str = "text", limits: QualityLimits = QualityLimits()) -> DataFrame:
    """The documents that pass, with all their columns. Only texts go to Python."""

    def run(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in columns:
            batch = pa.RecordBatch.from_arrays([column], names=["text"])
            yield pa.concat_arrays([measure(x.column("text"), limits).column("kept") for x in pieces(batch, "text", STEP)] or [pa.array([], pa.bool_())])

    task = working("quality", run)

    @F.arrow_udf("boolean")
    def good(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        yield from task(texts)

    return docs.where(good(docs[text_col].cast("string")))
