"""Several values packed in one field, split on the Arrow string buffers.

All rows of a batch are scanned at once: masks over the bytes mark letters, digits, quotes and delimiters, quote
parity tells what lies inside quotes, and the children's offsets follow from where substitutions and mutants begin.
Only a row that mixes quote styles is walked mark by mark, over its quote marks alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Opening quotes and what closes them; styles that open and close alike name themselves.
QUOTES = {
    '"': '"', "'": "'", "`": "`", "´": "´", "“": "”", "„": "”", "‘": "’", "‚": "’",
    "«": "»", "‹": "›", "「": "」", "『": "』", "＂": "＂", "＇": "＇",
}
_MARKS = sorted(set(QUOTES) | set(QUOTES.values()))
_CODES = {m: i + 1 for i, m in enumerate(_MARKS)}
_PAIR = {_CODES[a]: _CODES[b] for a, b in QUOTES.items()}
_SCHEMA = "item_pos int, sub_pos int, substitution string"


def _quote_marks(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte positions and codes of all quote marks, in order."""
    where, codes = [], []
    for mark, code in _CODES.items():
        raw = mark.encode()
        hit = data == raw[0]
        for k, byte in enumerate(raw[1:], 1):
            hit[: len(data) - k] &= data[k:] == byte
            hit[len(data) - k :] = False
        at = np.flatnonzero(hit)
        where.append(at)
        codes.append(np.full(len(at), code, np.int16))
    at, code = np.concatenate(where), np.concatenate(codes)
    order = np.argsort(at, kind="stable")
    return at[order], code[order]


def _stretches(at: np.ndarray, code: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end marks of the quoted stretches, given each mark's row. An opening without its end opens nothing."""
    if not len(at):
        return at, at
    first = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
    size = np.diff(np.r_[first, len(at)])
    nth = np.arange(len(at)) - np.repeat(first, size)
    opener = np.repeat(code[first], size)
    closer = np.array([_PAIR.get(c, 0) for c in range(len(_MARKS) + 1)], np.int16)[opener]
    plain = np.logical_and.reduceat(code == np.where(nth % 2 == 0, opener, closer), first) & (closer[first] > 0)
    is_plain = np.repeat(plain, size)
    opens = is_plain & (nth % 2 == 0) & (nth + 1 < np.repeat(size, size))
    start, end = list(at[opens]), list(at[np.flatnonzero(opens) + 1])
    for r in np.flatnonzero(~plain):
        marks = list(range(first[r], first[r] + size[r]))
        later: dict[int, list[int]] = {}
        for m in reversed(marks):
            later.setdefault(int(code[m]), []).append(m)
        m = marks[0]
        while m < marks[-1]:
            stack = later.get(_PAIR.get(int(code[m]), -1), [])
            while stack and stack[-1] <= m:
                stack.pop()
            if stack:
                start.append(at[m])
                end.append(at[stack[-1]])
                m = stack[-1]
            m += 1
    order = np.argsort(start, kind="stable")
    return np.array(start, np.int64)[order], np.array(end, np.int64)[order]


def split_packed(values: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array]:
    """Parent row, place of the mutant, place in the mutant and the substitution in upper case, in the order written."""
    values = values.cast(pa.large_string()).fill_null("")
    none = np.zeros(0, np.int64)
    if not len(values):
        return none, none, none, pa.array([], pa.string())
    offsets = np.frombuffer(values.buffers()[1], np.int64, len(values) + 1, 8 * values.offset)
    base, stop = int(offsets[0]), int(offsets[-1])
    if base == stop:
        return none, none, none, pa.array([], pa.string())
    data = np.frombuffer(values.buffers()[2], np.uint8, stop)[base:]
    offsets = offsets - base
    folded = data & 0xDF
    letter = (folded >= 65) & (folded <= 90)
    digit = (data >= 48) & (data <= 57)
    edge = np.diff(np.r_[0, digit.astype(np.int8), 0])
    begin, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    ok = (begin > 0) & (end < len(data))
    begin, end = begin[ok], end[ok]
    row = np.searchsorted(offsets, begin, "right") - 1
    ok = letter[begin - 1] & letter[end] & (begin - 1 >= offsets[row]) & (end < offsets[row + 1])
    begin, end, row = begin[ok] - 1, end[ok] + 1, row[ok]
    if not len(begin):
        return none, none, none, pa.array([], pa.string())
    # neighbours that share a letter: of each such chain the first, third, ... count
    shares = np.r_[False, begin[1:] < end[:-1]]
    index = np.arange(len(begin))
    chain = np.maximum.accumulate(np.where(shares, 0, index))
    ok = (index - chain) % 2 == 0
    begin, end, row = begin[ok], end[ok], row[ok]

    at, code = _quote_marks(data)
    start, stop_ = _stretches(at, code, np.searchsorted(offsets, at, "right") - 1)
    inside = np.searchsorted(start, begin, "right") - 1
    quoted = (inside >= 0) & (begin < stop_[np.maximum(inside, 0)]) if len(start) else np.zeros(len(begin), bool)
    stretch = np.where(quoted, inside, -1)

    joins, blank = (data == 43) | (data == 58), data == 32
    joins_to = np.r_[0, np.cumsum(joins)]
    other_to = np.r_[0, np.cumsum(~(joins | blank))]
    gap_from, gap_to = end[:-1], begin[1:]
    glued = (joins_to[gap_to] - joins_to[gap_from] == 1) & (other_to[gap_to] - other_to[gap_from] == 0)
    together = np.where(quoted[1:] & quoted[:-1], stretch[1:] == stretch[:-1], ~quoted[1:] & ~quoted[:-1] & glued)
    opens_item = np.r_[True, ~(together & (row[1:] == row[:-1]))]
    item = np.cumsum(opens_item)
    row_first = np.r_[True, row[1:] != row[:-1]]
    item_pos = item - np.maximum.accumulate(np.where(row_first, item - 1, 0))
    index = np.arange(len(begin))
    sub_pos = index - np.maximum.accumulate(np.where(opens_item, index, 0)) + 1

    size = end - begin
    child = np.r_[0, np.cumsum(size)]
    take = np.repeat(begin - child[:-1], size) + np.arange(child[-1])
    out = np.where(letter[take], folded[take], data[take])
    texts = pa.LargeStringArray.from_buffers(len(size), pa.py_buffer(child.astype(np.int64)), pa.py_buffer(out.tobytes()))
    return row, item_pos, sub_pos, texts.cast(pa.string())


def flatten_packed(df: DataFrame, key: str, column: str) -> DataFrame:
    """One row (key, item_pos, sub_pos, substitution) for each substitution in ``column``.

    Null, empty and substitution-free fields give no row; repeated mutants count each time; keys may repeat. There is
    no shuffle, and memory follows the Arrow batch.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parent, item, sub, texts = split_packed(batch.column(1))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(parent, pa.int64())), pa.array(item, pa.int32()), pa.array(sub, pa.int32()), texts],
                names=[key, "item_pos", "sub_pos", "substitution"],
            )

    kind = df.schema[key].dataType.simpleString()
    return df.select(key, column).mapInArrow(run, f"{key} {kind}, {_SCHEMA}")
