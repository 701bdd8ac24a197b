"""Encoding with public tokenizers as a streaming transducer that emits tokens once no later text can change them.

Three facts bound the lookahead, all computed from the vocabulary or its splitting pattern:

* White space that follows something else always starts a new split of the pattern, so text up to it is final.
* Inside a longer run the pattern's splits are final once three characters follow (the longest contraction).
* Inside one split, every encoding of a longer text passes through one of the last ``L`` byte prefixes, ``L`` being the
  longest token. Two tokens may stand side by side exactly if encoding both together gives them back, so each prefix
  has one last token and the prefixes form a tree; a token boundary that all ``L`` last prefixes descend from is final.

Every text goes through the transducer, a block of ``_BLOCK`` characters at a time; what isn't final waits for the next
block, and the state doesn't grow with the text. What became final is cut further into stretches that every tokenizer here
reads alike whatever stands around them. Tables give each stretch's tokens, found once and copied together for many texts;
they forget what the last texts didn't use. Where tokens are counted or placed only, whole texts are cut that way at once.
"""

from __future__ import annotations

import base64
import codecs
import os
import re
from array import array
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Where the vocabulary files lie, unless a query is given another folder.
TOKENIZERS = "/opt/tokenizers"
#: The pattern that splits text before the merges of the rank files.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Unicode White_Space.
_WS = r" \t\n\r\x0b\x0c\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_WS_CHARS = "".join(chr(c) for c in range(0x3001) if re.match(f"[{_WS}]", chr(c)))
#: What of a reversed text may still change: the last run and the white space before it.
_LAST = re.compile(f"[^{_WS}]+[{_WS}]*|[{_WS}]+")
#: Characters read and characters resolved at a time, strings a table holds before it forgets, and the longest it keeps. No result depends on them.
_BLOCK, _LOT, _REMEMBER, _KEY = 1 << 12, 1 << 18, 100_000, 48
#: Kinds of bytes: white space, letters, digits, other ASCII, beyond ASCII.
_SPACE, _LETTER, _DIGIT, _OTHER, _BEYOND = range(5)
_KIND = np.full(256, _OTHER, np.int8)
_KIND[128:] = _BEYOND
_KIND[[9, 10, 11, 12, 13, 32]] = _SPACE
_KIND[48:58] = _DIGIT
_KIND[65:91] = _KIND[97:123] = _LETTER
#: White space beyond ASCII has two or three bytes; which first bytes it has, and which code all of them make.
_WIDE = [c.encode() for c in _WS_CHARS if not c.isascii()]
_OPENS = np.zeros(256, bool)
_OPENS[[b[0] for b in _WIDE]] = True
_WIDE_CODES = np.array(sorted(int.from_bytes(b.ljust(3, b"\0"), "big") for b in _WIDE))


class _Numbers(dict):
    """Numbers of strings, given out as they are met; ``fresh`` holds what has no values yet."""

    def __init__(self, first: int = 0):
        super().__init__()
        self.next, self.fresh = first, []

    def __missing__(self, key) -> int:
        n = self[key] = self.next
        self.next = n + 1
        self.fresh.append(key)
        return n


class Table:
    """A run of 32-bit integers for each string, made for many new strings at once and looked up together by number."""

    def __init__(self, make: Callable[[list[str]], tuple[np.ndarray, np.ndarray]]):
        self.make = make
        self._reset(_Numbers(), np.zeros(0, np.int32), np.zeros(0, np.int64))

    def _reset(self, at: _Numbers, values: np.ndarray, counts: np.ndarray) -> None:
        self.at, self.size, self.used = at, len(counts), len(values)
        self.values, self.count, self.first = (np.concatenate([x, np.zeros(len(x) + 4096, x.dtype)]) for x in (values, counts, np.cumsum(counts) - counts))

    def add(self, values) -> int:
        """Number of a run that has no string."""
        at = self.at
        at.fresh.append(values if type(values) is list else list(values))
        at.next += 1
        return at.next - 1

    def _fill(self) -> None:
        fresh, self.at.fresh = self.at.fresh, []
        named = [x for x in fresh if type(x) is str]
        values, counts = self.make(named)
        values, counts = _merged(fresh, values, counts)
        for name, more, end in (("values", len(values), self.used), ("count", len(counts), self.size), ("first", len(counts), self.size)):
            if end + more > len(held := getattr(self, name)):
                setattr(self, name, np.concatenate([held, np.zeros(len(held) + more, held.dtype)]))
        self.values[self.used : self.used + len(values)] = values
        self.count[self.size : self.size + len(counts)] = counts
        self.first[self.size : self.size + len(counts)] = self.used + np.cumsum(counts) - counts
        self.used, self.size = self.used + len(values), self.size + len(counts)

    def take(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The runs of these numbers one after another, and how long each is."""
        if self.at.fresh:
            self._fill()
        count = self.count[numbers]
        return self.values[_spread(self.first[numbers], count)], count

    def trim(self, numbers: np.ndarray) -> None:
        """Forget, if the table is full, all but the short strings among ``numbers``. Numbers given out before are void then."""
        if self.size <= _REMEMBER:
            return
        used = np.zeros(self.size, bool)
        used[numbers] = True
        kept = [(s, n) for s, n in self.at.items() if used[n] and len(s) <= _KEY][: _REMEMBER // 2]
        values, counts = self.take(np.array([n for _, n in kept], np.int64))
        at = _Numbers(len(kept))
        at.update((s, i) for i, (s, _) in enumerate(kept))
        self._reset(at, values, counts)


def _spread(first: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """first, first + 1, ... for each entry, ``counts`` places each."""
    end = np.cumsum(counts)
    return np.repeat(first - end + counts, counts) + np.arange(end[-1] if len(end) else 0)


def _merged(parts: list, values: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Runs of all parts in order: ``values`` holds those of the strings among them, the others are runs themselves."""
    if len(counts) == len(parts):
        return values, counts
    own = np.fromiter((type(x) is str for x in parts), bool, len(parts))
    runs = [x for x in parts if type(x) is not str]
    size = np.zeros(len(parts), np.int64)
    size[own], size[~own] = counts, list(map(len, runs))
    first, whole = np.cumsum(size) - size, np.zeros(int(size.sum()), np.int32)
    whole[_spread(first[own], counts)] = values
    whole[_spread(first[~own], size[~own])] = np.frombuffer(array("i", chain.from_iterable(runs)), np.int32)
    return whole, size


def sums(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Sums of consecutive stretches of ``values``, which may be empty."""
    to = np.concatenate([np.zeros(1, np.int64), np.cumsum(values)])
    end = np.cumsum(counts)
    return to[end] - to[end - counts]


class Stretches:
    """Texts cut where every tokenizer here cuts, too: before white space, and between runs of letters, digits and others.

    A stretch has the white space before it in front. An apostrophe stays with the letters behind it, and what stands between
    white space is one stretch if it holds a character beyond ASCII. ``keys`` are the different stretches, ``number`` tells
    which one stands at each place, ``per_text`` how many places each text has.
    """

    def __init__(self, texts: list[str]):
        coded = [t.encode() for t in texts]
        raw = b"".join(coded)
        size = np.fromiter(map(len, coded), np.int64, len(coded))
        data = np.frombuffer(raw, np.uint8)
        kind = _KIND[data]
        if not raw.isascii():
            first = np.flatnonzero(_OPENS[data])
            near = np.frombuffer(raw + b"\0\0", np.uint8)
            third = np.where(near[first] >= 0xE0, near[first + 2], 0)
            code = near[first].astype(np.int32) << 16 | near[first + 1].astype(np.int32) << 8 | third
            found = first[np.isin(code, _WIDE_CODES)]
            kind[found] = kind[found + 1] = _SPACE
            kind[found[data[found] >= 0xE0] + 2] = _SPACE
        space = kind == _SPACE
        begins = np.zeros(len(data) + 1, bool)
        begins[1:-1] = space[1:] & ~space[:-1]
        begins[(np.cumsum(size) - size)[size > 0]] = True
        begins = begins[:-1]
        run = np.flatnonzero(begins)
        if len(run):
            plain = np.repeat(np.maximum.reduceat(kind, run) < _BEYOND, np.diff(run, append=len(data)))
            turns = (kind[1:] != kind[:-1]) & ~space[1:] & ~space[:-1] & plain[1:] & ~((data[:-1] == 39) & (kind[1:] == _LETTER))
            begins[1:] |= turns
        at = np.flatnonzero(begins)
        offsets = np.append(at, len(data)).astype(np.int64)
        told = pa.LargeStringArray.from_buffers(len(at), pa.py_buffer(offsets), pa.py_buffer(raw)).dictionary_encode()
        self.number, self.keys = told.indices.to_numpy(), told.dictionary.to_pylist()
        self.per_text = np.diff(np.searchsorted(at, np.concatenate([np.zeros(1, np.int64), np.cumsum(size)])))


class Tabled:
    """An encoder with a table of stretches; what a stretch's run holds is the subclass's matter."""

    table: Table

    def runs(self, cut: Stretches) -> tuple[np.ndarray, np.ndarray]:
        """Values and lengths of the runs of all stretches."""
        numbers = np.fromiter(map(self.table.at.__getitem__, cut.keys), np.int64, len(cut.keys))
        out = self.table.take(numbers[cut.number])
        self.table.trim(numbers)
        return out


class ByteEncoder(Tabled):
    """Byte-level BPE from a rank file."""

    def __init__(self, folder: str, name: str):
        import tiktoken

        with open(os.path.join(folder, f"{name}.tiktoken"), "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.core = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=self.ranks, special_tokens={})._core_bpe
        self.sizes = np.zeros(max(self.ranks.values()) + 1, np.int32)
        self.tokens = {i: t for t, i in self.ranks.items()}
        #: Longest token that ends with these two bytes, so a prefix need not be tried beyond.
        self.back: dict[bytes, int] = {}
        for token, i in self.ranks.items():
            self.sizes[i] = len(token)
            self.back[token[-2:]] = max(self.back.get(token[-2:], 1), len(token))
        self.longest = int(self.sizes.max())
        #: Characters that have to follow before anything inside a run is looked at.
        self.lookahead = 2 * self.longest
        self._fit: dict[tuple[int, int], bool] = {}
        self.table = Table(self._ids)

    def _ids(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        ids = list(map(self.core.encode_ordinary, parts))
        return np.frombuffer(array("i", chain.from_iterable(ids)), np.int32), np.fromiter(map(len, ids), np.int64, len(ids))

    def resolved(self, parts: list) -> tuple[np.ndarray, np.ndarray]:
        """Ids of what streams made final, one after another, and how many each part has."""
        cut = Stretches([x for x in parts if type(x) is str])
        ids, counts = self.runs(cut)
        return _merged(parts, ids, sums(counts, cut.per_text))

    def ids(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the texts one after another, and how many each has."""
        out, ends, waiting, got = [], [0], 0, []
        for text in texts:
            stream = ByteStream(self, out)
            for i in range(0, len(text), _BLOCK):
                stream.push(text[i : i + _BLOCK])
                waiting += min(_BLOCK, len(text) - i)
                if waiting >= _LOT:
                    got.append((len(out), *self.resolved(out)))
                    waiting = 0
                    out.clear()
            stream.finish()
            ends.append(sum(n for n, _, _ in got) + len(out))
        got.append((len(out), *self.resolved(out)))
        _, ids, counts = zip(*got)
        return np.concatenate(ids), sums(np.concatenate(counts), np.diff(np.array(ends, np.int64)))

    def encode(self, text: str) -> bytes:
        """Ids as the bytes of 32-bit integers."""
        return self.ids([text])[0].tobytes()

    def counts(self, texts: list[str]) -> np.ndarray:
        """Number of tokens of each text."""
        return sums(self.runs(cut := Stretches(texts))[1], cut.per_text)

    def count(self, text: str) -> int:
        return int(self.counts([text])[0])

    def fits(self, a: int, b: int) -> bool:
        """Whether token b may follow token a."""
        key = (a, b)
        known = self._fit.get(key)
        if known is None:
            if len(self._fit) > _REMEMBER:
                self._fit.clear()
            known = self._fit[key] = self.core.encode_single_piece(self.tokens[a] + self.tokens[b]) == [a, b]
        return known

    def settled(self, data: bytes) -> tuple[list[int], int]:
        """Ids of an unfinished split that are final, and how many bytes they cover (0: none yet)."""
        ids = self.core.encode_single_piece(data)
        ends = np.cumsum(self.sizes[ids])
        span = 2 * self.longest
        while span < len(data):
            k = int(np.searchsorted(ends, len(data) - span, "right"))
            if k and self._holds(data, int(ends[k - 1]), ids[k - 1]):
                return ids[:k], int(ends[k - 1])
            span *= 2
        return [], 0

    def _holds(self, data: bytes, start: int, before: int) -> bool:
        """Whether the last prefixes of data all descend from the one that ends at start."""
        last, back = {start: before}, self.back
        for end in range(start + 1, len(data) + 1):
            for begin in range(max(start, end - back.get(data[end - 2 : end], 1)), end):
                token = self.ranks.get(data[begin:end])
                if token is not None and begin in last and self.fits(last[begin], token):
                    last[end] = token
                    break
        return all(i in last for i in range(len(data) - self.longest + 1, len(data) + 1))


class ByteStream:
    """Takes blocks of a text of any length; appends to ``out`` what became final: text to be read by itself, or ids."""

    _kinds = None

    def __init__(self, encoder: ByteEncoder, out: list):
        self.encoder, self.out = encoder, out
        self.rest, self.kind, self.open, self.tried = "", None, b"", 0

    def push(self, block: str) -> None:
        text = self.rest + block
        if self.kind is not None:
            text = self._extend(text)
            if self.kind is not None:
                return
        last = _LAST.match(text[::-1])
        cut = len(text) - last.end() if last else 0
        if cut:
            self.out.append(text[:cut])
        self.rest = text[cut:]
        if last and last.end() > self.encoder.lookahead:
            self._inside()

    def _inside(self) -> None:
        """Emit what is final inside a run longer than the lookahead; a split that still goes on stays open."""
        import regex

        if ByteStream._kinds is None:
            ByteStream._kinds = [regex.compile(p) for p in (r"\p{L}+", r"\p{N}+", rf"[{_WS}]+", rf"[^\p{{L}}\p{{N}}{_WS}]+")]
            ByteStream._pattern = regex.compile(PATTERN.replace(r"[^\s", f"[^{_WS}").replace(r"\S", f"[^{_WS}]").replace(r"\s", f"[{_WS}]"))
        text, end = self.rest, 0
        splits = list(self._pattern.finditer(text))
        for m in splits[:-1]:
            if m.end() > len(text) - 3:
                break
            self.out.append(m.group())
            end = m.end()
        self.rest = text = text[end:]
        if len(text) > self.encoder.lookahead and end == splits[-1].start():
            self.kind, self.tried = next(k for k in self._kinds if k.fullmatch(text, len(text) - 1)), 0
            self.rest = ""
            self._extend(text, True)

    def _extend(self, text: str, start: bool = False) -> str:
        """Take what still belongs to the open split; returns what follows it."""
        space = self.kind is self._kinds[2]
        m = self.kind.match(text, 1 if start and text[0] == " " and not space else 0)
        end = m.end() if m else 0
        whole = end == len(text)
        # the last character of white space may yet belong to what follows
        keep = max(0, end - 1) if space else end
        self.open += text[:keep].encode()
        self.rest = ""
        if not whole:
            self.out.append(self.encoder.core.encode_single_piece(self.open))
            self.kind, self.open = None, b""
            return text[keep:]
        self.rest = text[keep:]
        # an open split without a final place is looked at again once it is twice as long
        if len(self.open) > max(self.encoder.lookahead, 2 * self.tried):
            ids, size = self.encoder.settled(self.open)
            self.out.append(ids)
            self.open, self.tried = self.open[size:], 0 if size else len(self.open)
        return ""

    def finish(self) -> None:
        if self.kind is not None:
            self.out.append(self.encoder.core.encode_single_piece(self.open + self.rest.encode()))
        elif self.rest:
            self.out.append(self.rest)


class Decoder:
    """Ids back to text, piece by piece; bytes of an unfinished character wait for the rest of it."""

    def __init__(self, encoder: ByteEncoder):
        self.tokens, self.state = encoder.tokens, codecs.getincrementaldecoder("utf-8")("replace")

    def push(self, ids) -> str:
        return self.state.decode(b"".join(map(self.tokens.__getitem__, ids)))

    def finish(self) -> str:
        return self.state.decode(b"", True)


class PieceCounter:
    """Number of tokens under a sentencepiece BPE model; a stretch's run is that number.

    No piece has a blank after anything but blanks, so blanks after other characters separate. Characters that occur in no
    piece with others stand alone. Both are read off the model; where the first fails, whole texts are encoded.
    """

    def __init__(self, folder: str, name: str):
        import sentencepiece

        file = os.path.join(folder, f"{name}.model")
        self.model = sentencepiece.SentencePieceProcessor(model_file=file)
        with open(file, "rb") as f:
            # a later field 3 (normalizer) with add_dummy_prefix = false is merged into the model's own
            self.bare = sentencepiece.SentencePieceProcessor(model_proto=f.read() + b"\x1a\x02\x18\x00")
        m = self.model
        pieces = [m.id_to_piece(i) for i in range(m.vocab_size()) if not (m.is_byte(i) or m.is_control(i) or m.is_unknown(i))]
        self.separable = not any("▁" in p.lstrip("▁") for p in pieces)
        joined = {c for p in pieces if len(p) > 1 for c in p}
        alone = "".join(c for c in map(chr, range(128)) if c not in joined and c != " ")
        self.alone = re.compile("[" + re.escape(alone) + "]") if alone else None
        self.table, self.bits = Table(self._stretches), Table(self._bits)
        self._find = re.compile(" *[^ ]+| +").findall

    def _bits(self, bits: list[str]) -> tuple[np.ndarray, np.ndarray]:
        counts = np.array([len(x) for x in self.bare.encode(bits, num_threads=1)] if bits else [], np.int32)
        return counts, np.ones(len(counts), np.int64)

    def _stretches(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        number, out, counts, alone = self.bits.at.__getitem__, array("q"), [], []
        for part in parts:
            found = self.alone.split(part) if self.alone else [part]
            alone.append(len(found) - 1)
            found = list(filter(None, found))
            out.extend(map(number, found))
            counts.append(len(found))
        numbers = np.frombuffer(out, np.int64)
        got, _ = self.bits.take(numbers)
        self.bits.trim(numbers)
        return (sums(got, np.array(counts, np.int64)) + np.array(alone, np.int64)).astype(np.int32), np.ones(len(parts), np.int64)

    def counts(self, texts: list[str]) -> np.ndarray:
        """Number of tokens of each text."""
        if not self.separable:
            return np.array([len(self.model.encode(t)) if t else 0 for t in texts], np.int64)
        out, ends = array("q"), [0]
        for text in texts:
            if text:
                out.extend(map(self.table.at.__getitem__, self._find(" " + text)))
            ends.append(len(out))
        numbers = np.frombuffer(out, np.int64)
        values, _ = self.table.take(numbers)
        self.table.trim(numbers)
        return sums(values, np.diff(np.array(ends, np.int64)))

    def count(self, text: str) -> int:
        return int(self.counts([text])[0])


class WordEncoder(Tabled):
    """The lower-casing BPE with word ends: how many tokens, and the characters each token covers.

    A stretch's run is its number of blanks in front, then the number of characters each token adds; of tokens that share a
    character the last adds it, characters that the normaliser drops go with the token before them.
    """

    def __init__(self, folder: str, name: str):
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(os.path.join(folder, f"{name}.json"))
        self.model.encode_special_tokens = True
        vocabulary = self.model.get_vocab()
        self.sizes = np.zeros(max(vocabulary.values()) + 1, np.int32)
        for token, i in vocabulary.items():
            self.sizes[i] = len(token.removesuffix("</w>"))
        self.table = Table(self._stretches)

    def _covered(self, bare: str) -> list[int]:
        found = self.model.encode(bare, add_special_tokens=False).offsets
        if not found:
            return []
        start, end = np.fromiter(chain.from_iterable(found), np.int64, 2 * len(found)).reshape(-1, 2).T
        # a token that shares a character with the next one ends where the one before it does
        ends = np.maximum.accumulate(np.where(np.append(start[1:], len(bare)) < end, 0, end))
        ends[-1] = len(bare)
        return np.diff(ends, prepend=0).tolist()

    def _stretches(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        bares = [p.lstrip(_WS_CHARS) for p in parts]
        plain = [b.isascii() for b in bares]
        size = self.sizes.tolist()
        # the same word behind other white space is read once
        words = list({b.lower(): None for b, p in zip(bares, plain) if p and b and not b.isdigit()})
        found = self.model.encode_batch_fast(words, add_special_tokens=False) if words else []
        known = {w: [size[i] for i in f.ids] for w, f in zip(words, found)}
        out, counts = array("i"), array("q")
        for part, bare, ascii_only in zip(parts, bares, plain):
            if not bare:
                run = []
            elif not ascii_only:
                run = self._covered(bare)
            elif bare.isdigit():
                run = [1] * len(bare)
            else:
                run = known[bare.lower()]
            out.append(len(part) - sum(run))
            out.extend(run)
            counts.append(1 + len(run))
        return np.frombuffer(out, np.int32), np.frombuffer(counts, np.int64)

    def counts(self, texts: list[str]) -> np.ndarray:
        """Number of tokens of each text."""
        cut = Stretches(texts)
        return sums(self.runs(cut)[1] - 1, cut.per_text)

    def count(self, text: str) -> int:
        return int(self.counts([text])[0])

    def places(self, cut: Stretches) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """First character of each token in the joined texts and the one after its last, and how many tokens each text has."""
        values, counts = self.runs(cut)
        first = np.cumsum(counts) - counts
        inner = np.ones(len(values), bool)
        inner[first] = False
        size = values[inner].astype(np.int64)
        # a stretch without tokens adds its characters to the gap before the next token
        gap = np.bincount(first - np.arange(len(first)), values[first], len(size) + 1).astype(np.int64)
        ends = np.cumsum(size + gap[:-1])
        return ends - size, ends, sums(counts - 1, cut.per_text)

    def spans(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """First character of each token and the one after its last; equal ends mark tokens inside a character."""
        return self.places(Stretches([text]))[:2]


_LOADED: dict[tuple[str, str], object] = {}


def load(name: str, folder: str = TOKENIZERS):
    """The encoder of a public tokenizer, read once a process."""
    key = (folder, name)
    if key not in _LOADED:
        kind = ByteEncoder if name.startswith("byte_bpe") else PieceCounter if name.startswith("piece_bpe") else WordEncoder
        _LOADED[key] = kind(folder, name)
    return _LOADED[key]


def count_tokens(text: str, name: str, folder: str = TOKENIZERS) -> int:
    return load(name, folder).count(text)


def batches_of(texts: list[str | None], most: int = _LOT) -> Iterator[tuple[int, list[str]]]:
    """Consecutive texts, null as empty, of about ``most`` characters together, each lot with the place of its first."""
    start, size, lot = 0, 0, []
    for i, text in enumerate(texts):
        lot.append(text or "")
        size += len(lot[-1])
        if size >= most or i + 1 == len(texts):
            yield start, lot
            start, size, lot = i + 1, 0, []


def id_lists(texts: pa.Array, name: str, folder: str = TOKENIZERS) -> Iterator[pa.ListArray]:
    """Lists of ids of the texts, some at a time; null and empty texts give empty lists."""
    encoder = load(name, folder)
    for _, lot in batches_of(texts.to_pylist()):
        ids, counts = encoder.ids(lot)
        yield pa.ListArray.from_arrays(pa.array(np.concatenate([np.zeros(1, np.int64), np.cumsum(counts)]).astype(np.int32)), pa.array(ids))


def encode_corpus(df: DataFrame, key: str, column: str, name: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> DataFrame:
    """(key, ids) of each row: the ids of ``column`` without special tokens, whose names count as ordinary text.

    A null text and an empty one give an empty list; white space has ids like any text. One row in, one row out, without
    a shuffle; rows that share a key stay apart.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for ids in id_lists(batch.column(1), name, folder):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(ids)), ids], names=[key, "ids"])
                at += len(ids)

    kind = df.schema[key].dataType.simpleString()
    return df.select(key, column).mapInArrow(run, f"{key} {kind}, ids array<int>")


def decode_corpus(df: DataFrame, key: str, column: str, name: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> DataFrame:
    """(key, text) of rows of ids; a null or empty list gives an empty text. Decoding goes on in steps of 4096 ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = load(name, folder)
        for batch in batches:
            texts = []
            for ids in batch.column(1).to_pylist():
                state, ids = Decoder(encoder), ids or []
                texts.append("".join([*(state.push(ids[i : i + 4096]) for i in range(0, len(ids), 4096)), state.finish()]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=[key, "text"])

    kind = df.schema[key].dataType.simpleString()
    return df.select(key, column).mapInArrow(run, f"{key} {kind}, text string")
