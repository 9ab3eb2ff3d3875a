"""Quality rules by repetition coverage, in numpy over many whole texts at once.

Words are runs of bytes other than space and tab to carriage return. Every word and line gets a
polynomial hash from one running sum, and n-grams of several lengths a rolling hash over the word
hashes; equal hashes within a text are repeats. Covered are the characters inside n-grams, and
lines, that equal an earlier one of the same text.

A null or empty text has no words: its counts are 0 and it fails. Repeated rows are judged each; an empty
table gives no row; other columns of the frame are not looked at (``keep_documents`` keeps them). A slice of
texts takes some 60 times its bytes; a text longer than ``SLICE`` is worked on alone and read in stretches of
that size with carried sums, so that beside it only some numbers a word are held.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyframe.llm._common import flat_utf8, id_and_text, keep_rows, mixed, slices

SLICE = 1 << 19
#: Fewer words than this fail, or a larger share (percent) of words in repeated 3-grams.
LEAST_WORDS, MOST_REPEATED = 50, 50
#: Largest share of a text's word characters in repeats, later copies only: by n-gram length (the published
#: limits of repetition filters for web text), and in repeated lines (0).
LIMITS = {0: 0.30, 5: 0.15, 7: 0.13, 10: 0.10}

_BLANK = np.zeros(256, dtype=bool)
_BLANK[[32, *range(9, 14)]] = True
_SYMBOL = np.zeros(256, dtype=bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_VALUE = mixed(np.arange(1, 257, dtype=np.uint64))
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """``base`` to the powers 0 to n - 1, modulo 2**64."""
    if base not in _powers or len(_powers[base]) < n:
        size = max(n, SLICE + 1)
        steps = np.full(size, base, dtype=np.uint64)
        steps[0] = 1
        with np.errstate(over="ignore"):
            made = np.cumprod(steps)
        if size > 2 * SLICE:
            return made[:n]
        _powers[base] = made
    return _powers[base][:n]


class Rolling:
    """Hashes of any stretch of a row of values, by one running sum."""

    def __init__(self, values: np.ndarray):
        n = len(values)
        with np.errstate(over="ignore"):
            self.sums = np.r_[np.uint64(0), np.cumsum(values * powers(_BASE, n))]
        self.inverse = powers(_INVERSE, n + 1)

    def raw(self, first: np.ndarray, end: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return (self.sums[end] - self.sums[first]) * self.inverse[first]

    def of(self, first: np.ndarray, end: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return mixed(self.raw(first, end) + (end - first).astype(np.uint64))


def stretches(flat: np.ndarray):
    """Parts of the bytes of about ``SLICE``, each but the last ending with a blank, so that no word is cut."""
    start = 0
    while start < len(flat):
        stop = min(len(flat), start + SLICE)
        while stop < len(flat):
            blank = np.flatnonzero(_BLANK[flat[stop : stop + SLICE]])
            if len(blank):
                stop += int(blank[0]) + 1
                break
            stop = min(len(flat), stop + SLICE)
        yield start, stop
        start = stop


def words_of(flat: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each word's text, characters and hash."""
    parts = [(np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64), np.empty(0, dtype=np.uint64))]
    for start, stop in stretches(flat):
        part, inner = flat[start:stop], offsets[(offsets >= start) & (offsets <= stop)] - start
        blank = _BLANK[part]
        edge = np.zeros(len(part) + 1, dtype=bool)
        edge[inner] = True
        first = np.flatnonzero(~blank & (np.r_[True, blank[:-1]] | edge[:-1]))
        end = np.flatnonzero(~blank & (np.r_[blank[1:], True] | edge[1:])) + 1
        chars = np.r_[0, np.cumsum((part & 0xC0) != 0x80)]
        row = np.searchsorted(offsets, first + start, side="right") - 1
        parts.append((row, chars[end] - chars[first], Rolling(_VALUE[part]).of(first, end)))
    return tuple(np.concatenate(x) for x in zip(*parts))


def lines_of(flat: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each line's text, word characters and hash, of the lines that hold a word."""
    found = [(np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64), np.empty(0, dtype=np.uint64))]
    carried = (np.uint64(0), 0, 0)  # hash, bytes and characters of the line that a stretch leaves open
    for start, stop in stretches(flat):
        part = flat[start:stop]
        chars = np.r_[0, np.cumsum(~_BLANK[part] & ((part & 0xC0) != 0x80))]
        closed = np.unique(offsets[(offsets > start) & (offsets <= stop)]) - start
        is_open = bool(not len(closed) or closed[-1] < len(part))
        # Texts' ends and line feeds in their order; at one place the end comes first.
        mark = np.sort(np.r_[2 * closed, 2 * np.flatnonzero(part == 10) + 1, [2 * len(part)] * is_open].astype(np.int64))
        ends = mark >> 1
        begin = np.r_[0, ends[:-1] + (mark[:-1] & 1)]
        raw, size, held = Rolling(_VALUE[part]).raw(begin, ends), ends - begin, chars[ends] - chars[begin]
        row = np.searchsorted(offsets, begin + start, side="right") - 1
        with np.errstate(over="ignore"):
            raw[0] = carried[0] + np.uint64(pow(_BASE, carried[1], 1 << 64)) * raw[0]
            size[0], held[0] = size[0] + carried[1], held[0] + carried[2]
            carried = (raw[-1], int(size[-1]), int(held[-1])) if is_open else (np.uint64(0), 0, 0)
            found.append(tuple(x[: len(row) - is_open] for x in (row, held, mixed(raw + size.astype(np.uint64)))))
    row, held, hashes = (np.concatenate(x) for x in zip(*found))
    return row[held > 0], held[held > 0], hashes[held > 0]


def repeats(hashes: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of hashes in the order of their places: whether another of the same row equals it, and whether an earlier one does."""
    with np.errstate(over="ignore"):
        key = hashes ^ mixed(row.astype(np.uint64) + np.uint64(0x51ED27))
    order = np.argsort(key, kind="stable")
    same = key[order[1:]] == key[order[:-1]]
    later = np.zeros(len(key), dtype=bool)
    later[order[1:][same]] = True
    both = later.copy()
    both[order[:-1][same]] = True
    return both, later


def covered(flags: np.ndarray, n: int, words: int) -> np.ndarray:
    """The words inside flagged windows of n words; window i starts at word ``flags[i]``."""
    step = np.zeros(words + 1, dtype=np.int64)
    np.add.at(step, flags, 1)
    np.add.at(step, flags + n, -1)
    return np.cumsum(step[:-1]) > 0


def measure(flat: np.ndarray, offsets: np.ndarray, lengths: tuple[int, ...]) -> dict[str, np.ndarray]:
    """Counts of each text: words, characters, symbols, repeated lines and words, and covered characters."""
    rows = len(offsets) - 1
    by_row = lambda values, of: np.bincount(of, weights=values, minlength=rows).astype(np.int64)
    row, size, hashes = words_of(flat, offsets)
    out = {"n_words": np.bincount(row, minlength=rows).astype(np.int64), "word_chars": by_row(size, row)}
    out["n_symbols"] = np.bincount(np.searchsorted(offsets, np.flatnonzero(_SYMBOL[flat]), side="right") - 1, minlength=rows).astype(np.int64)
    line_row, line_chars, lines = lines_of(flat, offsets)
    _, later = repeats(lines, line_row)
    out["n_dup_lines"] = by_row(later, line_row)
    out["covered_0"] = by_row(np.where(later, line_chars, 0), line_row)

    words = Rolling(hashes)
    for n in (3, *lengths):
        start = np.arange(max(0, len(row) - n + 1))
        start = start[row[start] == row[start + n - 1]] if len(start) else start
        both, later = repeats(words.of(start, start + n), row[start])
        if n == 3:
            out["n_repeat_words"] = by_row(covered(start[both], n, len(row)), row)
        if n in lengths:
            out[f"covered_{n}"] = by_row(np.where(covered(start[later], n, len(row)), size, 0), row)
    return out


BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def measure_documents(df: DataFrame, limits: dict[int, float] = LIMITS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: ``doc_id``, the base counts, ``covered_<n>`` long for each limit, ``base_failed``, ``kept``."""
    lengths = tuple(n for n in limits if n)
    names = (*BASE, *(f"covered_{n}" for n in limits))

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text", SLICE):
                found = measure(*flat_utf8(part, "text"), lengths)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *(pa.array(found[n].astype(np.int64)) for n in names)], names=["doc_id", *names])

    rows = id_and_text(df, id_col, text_col).mapInArrow(run, "doc_id long, " + ", ".join(f"{n} long" for n in names))
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    within = F.lit(True)
    for n, most in limits.items():
        within = within & (F.col(f"covered_{n}") <= most * F.col("word_chars"))
    return rows.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & within)


def keep_documents(df: DataFrame, limits: dict[int, float] = LIMITS, text_col: str = "text") -> DataFrame:
    """The rows, with all their columns, that ``measure_documents`` would keep."""

    def decide(part: pa.RecordBatch) -> np.ndarray:
        found = measure(*flat_utf8(part, text_col), tuple(n for n in limits if n))
        kept = (found["n_words"] >= LEAST_WORDS) & (100 * found["n_repeat_words"] <= MOST_REPEATED * found["n_words"])
        for n, most in limits.items():
            kept &= found[f"covered_{n}"] <= most * found["word_chars"]
        return kept

    return keep_rows(df, text_col, decide, SLICE)
