"""Cutting oversized texts at natural boundaries, consecutive pieces sharing a number of tokens: pointer doubling.

Every token boundary of every text is joined to its farthest legal successor - where the next piece would end - at once.
Squaring the table of successors doubles how many cuts one look-up covers, so the cuts of all texts of a block are
reached in as many steps as the longest chain of pieces has binary digits, not one after another.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyweave.llm import tokens

#: Kinds of cuts: the end of a paragraph, a line, a sentence, a word; inside a word; inside a character.
PARAGRAPH, LINE, SENTENCE, WORD, TOKEN, BYTE = 5, 4, 3, 2, 1, 0
#: What a character is, as bits: it ends a sentence before white space (_ENDS) or by itself (_WIDE), closes what an end stands in
#: (_CLOSE), is white space, a line feed, a carriage return. Straight quotes don't count as closing, as they open as well. Codes
#: above the table are none of these.
_ENDS, _WIDE, _CLOSE, _BLANK, _FEED, _RETURN = (1 << k for k in range(6))
_TABLE = 0xFF70
_BITS = np.zeros(_TABLE + 1, np.uint8)
_BITS[[ord(c) for c in ".!?。！？…"]] |= _ENDS
_BITS[[ord(c) for c in "。！？"]] |= _WIDE
_BITS[[ord(c) for c in ")]’”〉》」』】〕〗〙〛）］｝｠｣"]] |= _CLOSE
_BITS[[9, 10, 11, 12, 13, 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]] |= _BLANK
_BITS[10] |= _FEED
_BITS[13] |= _RETURN
#: Characters of the texts that are cut together.
_BLOCK = 300_000
_OUT = "doc_id bigint, limit_name string, piece_no int, first_token int, n_tokens int, first_char int, n_chars int, cut_kind int, piece string"


def farthest(level: np.ndarray, base: np.ndarray, stop: np.ndarray, most: int, shared: int, fill: float = 0.5) -> np.ndarray:
    """Successor of every boundary: where a piece that follows a cut there has to end.

    The piece starts ``shared`` tokens before its cut (at the text's start for the first) and has ``most`` tokens at most. Of
    the better kinds of boundary the farthest is taken if it leaves the piece at least ``fill`` full, else the farthest
    end of a word, then of a token, then the full length. A cut always lies more than ``shared`` tokens after its piece's
    start, so pieces move on. The end of a text is its own successor.
    """
    at = np.arange(len(level), dtype=np.int32)
    start = np.maximum(at - shared, base)
    start[at == base] = base[at == base]
    reach = np.minimum(start + most, stop)
    best = reach.copy()
    left = np.flatnonzero(reach < stop).astype(np.int32)
    for kind in (PARAGRAPH, LINE, SENTENCE, WORD, TOKEN):
        if not len(left):
            break
        last = np.maximum.accumulate(np.where(level >= kind, at, np.int32(-1)))[reach[left]]
        hit = last > start[left] + (max(shared, int(most * fill)) if kind > WORD else shared)
        best[left[hit]] = last[hit]
        left = left[~hit]
    return best


def reached(successor: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Whether each boundary is one of the cuts that following successors from ``first`` comes to."""
    seen = np.zeros(len(successor), bool)
    seen[first] = True
    jump, now = successor, first
    while True:
        new = np.unique(jump[now])
        new = new[~seen[new]]
        if not len(new):
            return seen
        seen[new] = True
        now, jump = np.flatnonzero(seen), jump[jump]


def levels(chars: np.ndarray, before: np.ndarray, after: np.ndarray, whole: np.ndarray, opens: np.ndarray) -> np.ndarray:
    """Kind of each boundary between a token that ends at ``before`` and one that starts at ``after``; texts start at ``opens``."""
    bits = np.zeros(len(chars) + 4, np.uint8)
    bits[3:-1] = _BITS[np.minimum(chars, _TABLE)]
    feeds = np.zeros(len(bits) + 1, np.int32)
    np.cumsum(bits & _FEED != 0, out=feeds[1:])
    a, b = before + 2, after + 3
    left, right, prior = bits[a], bits[b], bits[a - 1]
    gap_lines = feeds[b] - feeds[a + 1]
    ends_line = left & _FEED != 0
    second = (prior & _FEED != 0) | ((prior & _RETURN != 0) & (bits[a - 2] & _FEED != 0))
    apart = (b > a + 1) | (right & _BLANK != 0)
    level = np.where(apart | ((left ^ right) & _BLANK != 0), np.int8(WORD), np.int8(TOKEN))
    level[(left & _ENDS != 0) & apart] = SENTENCE
    wide = bits & _WIDE != 0
    if wide.any():
        close = bits & _CLOSE != 0
        goes_on = wide | close
        close[opens + 3] = False  # what opens a text closes nothing before it
        ended = wide[np.maximum.accumulate(np.where(close, 0, np.arange(len(bits), dtype=np.int32)))]
        level[ended[a] & (apart | ~goes_on[b])] = SENTENCE
    level[(gap_lines == 1) | ends_line] = LINE
    level[(gap_lines > 1) | (ends_line & second)] = PARAGRAPH
    level[~whole] = BYTE
    return level


class Block:
    """Those of some texts that have more than ``least`` tokens, with their tokens' places in these texts joined together.

    Tokens are counted for all texts first; places are worked out for the long ones only.
    """

    def __init__(self, texts: list[str], cut: tokens.Stretches, encoder, least: int):
        byte = isinstance(encoder, tokens.ByteEncoder)
        if byte:
            ids, counts = encoder.runs(cut)
            count = tokens.sums(counts, cut.per_text)
        else:
            starts, ends, count = encoder.places(cut)
        big = count > least
        self.chosen, length = np.flatnonzero(big), np.fromiter(map(len, texts), np.int64, len(texts))
        token, self.count = np.repeat(big, count), count[big]
        text_at = np.concatenate([np.zeros(1, np.int64), np.cumsum(length[big])])
        self.text_at, self.joined = text_at, "".join([texts[i] for i in self.chosen.tolist()])
        self.chars = np.frombuffer(self.joined.encode("utf-32-le"), np.uint32)
        if byte:
            size = encoder.sizes[ids[token]].astype(np.int64)
            ends = np.cumsum(size)
            starts = ends - size
            if len(data := self.joined.encode()) == len(self.joined):
                whole = np.ones(len(ends), bool)
            else:
                head = np.concatenate([(np.frombuffer(data, np.uint8) & 0xC0) != 0x80, np.ones(1, bool)])
                chars_to = np.concatenate([np.zeros(1, np.int64), np.cumsum(head[:-1])])
                whole = head[ends]
                ends, starts = chars_to[ends], chars_to[starts] - ~head[starts]
        else:
            moved = np.repeat(text_at[:-1] - (np.cumsum(length) - length)[big], self.count)
            starts, ends = starts[token] + moved, ends[token] + moved
            whole = ends > starts
        docs = np.arange(len(self.count))
        self.first = (np.cumsum(self.count) - self.count + docs).astype(np.int32)
        self.last = (self.first + self.count).astype(np.int32)
        size = len(ends) + len(docs)
        right = np.arange(len(ends)) + np.repeat(docs, self.count) + 1
        self.before, self.after, self.whole = np.zeros(size, np.int64), np.zeros(size, np.int64), np.ones(size, bool)
        self.before[right], self.after[right - 1], self.whole[right] = ends, starts, whole
        self.before[self.first], self.after[self.last] = text_at[:-1], text_at[1:]
        self.doc = np.repeat(docs, self.count + 1)
        self.level = levels(self.chars, self.before, np.maximum(self.after, self.before), self.whole, text_at[:-1])

    def pieces(self, most: int, shared: int) -> dict[str, np.ndarray]:
        """Pieces of the texts with more than ``most`` tokens; texts below that give none."""
        big = self.count > most
        use = np.flatnonzero(np.repeat(big, self.count + 1))
        # boundaries of the long texts only, numbered anew
        length = (self.count + 1)[big]
        first = (np.cumsum(length) - length).astype(np.int32)
        base, stop = np.repeat(first, length), np.repeat(first + length.astype(np.int32) - 1, length)
        at = np.arange(len(use), dtype=np.int32)
        level, whole = self.level[use], self.whole[use]
        # where the next piece starts has to be a whole character too
        level[~whole[np.maximum(at - shared, base)]] = BYTE
        seen = reached(farthest(level, base, stop, most, shared), first)
        kept = np.flatnonzero(seen & (at > base))
        cuts, level = use[kept], level[kept]
        doc = self.doc[cuts]
        opens = np.r_[True, doc[1:] != doc[:-1]] if len(cuts) else np.zeros(0, bool)
        begin = np.where(opens, self.first[doc], np.concatenate([np.zeros(1, np.int64), cuts])[: len(cuts)] - shared)
        nth = np.arange(len(cuts)) - np.maximum.accumulate(np.where(opens, np.arange(len(cuts)), 0))
        head = np.where(begin == self.first[doc], self.before[begin], self.after[begin])
        tail = np.where(cuts == self.last[doc], self.after[cuts], self.before[cuts])
        kind = np.where(cuts == self.last[doc], PARAGRAPH, level)
        return {"doc": doc, "piece_no": nth, "first_token": begin - self.first[doc], "n_tokens": cuts - begin, "head": head, "tail": np.maximum(tail, head), "kind": kind}


Limits = list[tuple[str, int, int]]


def split_texts(texts: list[str | None], name: str, limits: Limits, folder: str = tokens.TOKENIZERS) -> Iterator[tuple]:
    """(text number, limit_name, piece_no, first_token, n_tokens, first_char, n_chars, cut_kind, piece) columns, block by block."""
    return split_all(texts, {name: limits}, folder)


def split_all(texts: list[str | None], by: dict[str, Limits], folder: str = tokens.TOKENIZERS) -> Iterator[tuple]:
    """As split_texts, for the limits of several tokenizers, whose texts are cut into stretches once."""
    for start, lot in tokens.batches_of(texts, _BLOCK):
        stretches = tokens.Stretches(lot)
        for name, limits in by.items():
            block = Block(lot, stretches, tokens.load(name, folder), min(m for _, m, _ in limits))
            joined, at = block.joined, block.text_at
            for limit, most, shared in limits if len(block.chosen) else ():
                p = block.pieces(most, shared)
                piece = [joined[a:b] for a, b in zip(p["head"].tolist(), p["tail"].tolist())]
                yield start + block.chosen[p["doc"]], limit, p["piece_no"], p["first_token"], p["n_tokens"], p["head"] - at[p["doc"]], p["tail"] - p["head"], p["kind"], piece


def split(docs: DataFrame, limits: DataFrame, folder: str = tokens.TOKENIZERS) -> DataFrame:
    """Pieces of each document with more than max_tokens tokens, for each 'split' row of ``limits``.

    Columns: doc_id, limit_name, piece_no (from 0), first_token, n_tokens, first_char, n_chars, cut_kind, piece. A piece has
    at most max_tokens tokens of the document's encoding; it starts overlap_tokens tokens before the piece before it ends. cut_kind tells
    at what the piece ends (5 paragraph or end of text, 4 line, 3 sentence, 2 word, 1 token, 0 inside a character, where
    nothing else is in reach). Null, empty and shorter texts give no rows; a null overlap counts as 0. ``limits`` is a
    fixed configuration table of a few rows. No shuffle: a text is cut in the task that reads it.
    """
    rows = limits.filter(F.col("purpose") == "split").collect()
    by: dict[str, list] = {}
    for r in sorted(rows, key=lambda r: r["limit_name"]):
        by.setdefault(r["tokenizer"], []).append((r["limit_name"], r["max_tokens"], min(r["overlap_tokens"] or 0, r["max_tokens"] - 1)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for doc, limit, *numbers, piece in split_all(texts, by, folder):
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(doc, pa.int64())), pa.array([limit] * len(doc), pa.string()), *(pa.array(x, pa.int32()) for x in numbers), pa.array(piece, pa.string())],
                    names=[c.split()[0] for c in _OUT.split(", ")],
                )

    return docs.select("doc_id", "text").mapInArrow(run, _OUT)
