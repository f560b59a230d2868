"""Byte-level BPE of whole texts with the tokenizers library, fast on repeated words."""

from __future__ import annotations

import functools
import os
import re
from collections.abc import Callable, Sequence
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: bytes of a generation of cached pieces, about; characters that are split at a time
CACHE = 24 << 20
PART = 1 << 22
#: bytes that a cached piece takes besides its contents
_ENTRY = 180

#: stands before the first piece of a text, which has no blank; a line's first piece has its line feed there
_HEAD = "\x01"
_STARTS = (_HEAD, "\n")

#: a blank or line feed between two characters that are not white space: the tokenizer never joins across it
_LONE_BLANK = re.compile(r"(?<=\S) (?=\S)")
#: white space other than blanks and line feeds that stand alone between characters
_UNEVEN = (r"^\x01?[ \n]|[ \n]$|[ \n][ \n]|[\t\x0b\f\r\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]")
#: a mark and Latin letters, behind which marks make a pre-token of their own
_LETTERS = r"^[\x01\n]?[A-Za-z\x{c0}-\x{d6}\x{d8}-\x{f6}\x{f8}-\x{24f}]+$"
_MARKS = ".,;:!?"
_BEFORE_MARKS = r"(?s)^.*?([.,;:!?]*)$"


def byte_letters() -> list[str]:
    """The character that stands for each byte in a byte-level vocabulary: itself if it prints, else one above 255."""
    prints = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = (chr(256 + i) for i in range(256))
    return [chr(b) if b in prints else next(rest) for b in range(256)]


class Encoder:
    """Ids of texts as little-endian bytes.

    The pre-tokenizer splits before every lone blank and around every lone line feed, so a text's ids are those of
    its blank-separated pieces, put together.  The pieces of many texts are dictionary-encoded at once: each distinct
    piece is looked up in a cache of bounded bytes, or encoded, words of Latin letters by the vocabulary's merges alone,
    and the ids are gathered for all occurrences together.  A text that holds the string of an added token goes through
    the library as a whole; with ``ordinary`` such strings are ordinary text.
    """

    def __init__(self, path: str, cache: int = CACHE, piece: int = 48, ordinary: bool = False):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = ordinary
        added = self.tokenizer.get_added_tokens_decoder().values()
        self.added = [_HEAD, *(t.content for t in added if not (ordinary and t.special))]
        self.merges = self.tokenizer.model
        self.vocabulary = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.dtype = np.dtype("<u2" if self.vocabulary < 65_000 else "<u4")
        self.size, self.piece = cache, piece
        self.letters = str.maketrans(dict(enumerate(byte_letters())))
        self.feed = self._plain(["\n"])[0]
        self.forget()

    def forget(self) -> None:
        """Drop the cached pieces; a full newer generation replaces the older one."""
        self.new: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.held = 0

    def _plain(self, texts: Sequence[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast(list(texts), add_special_tokens=False)
        return [np.array(e.ids, self.dtype).tobytes() for e in found]

    def _words(self, words: list[str]) -> list[bytes]:
        """Ids of Latin letters, after a blank or a mark, by the vocabulary's merges alone."""
        flat: list[int] = []
        ends, tokenize, blank = [0], self.merges.tokenize, self.letters[32]
        for w in words:
            if not w.isascii():
                w = w.encode().decode("latin-1").translate(self.letters) if w[0] not in _STARTS else w[0] + w[1:].encode().decode("latin-1").translate(self.letters)
            flat += [t.id for t in tokenize(w[1:] if w[0] in _STARTS else blank + w)]
            ends.append(len(flat))
        data, size = np.array(flat, self.dtype).tobytes(), self.dtype.itemsize
        return [data[a * size:b * size] for a, b in pairwise(ends)]

    def _others(self, pieces: list[str]) -> list[bytes]:
        """Ids of pieces of any other kind, as the library gives them."""
        return self._plain([p[1:] if p[:1] in _STARTS else " " + p for p in pieces])

    def _known(self, names: list[str], learn: Callable[[list[str]], list[bytes]]) -> list[bytes]:
        """Ids of distinct names, out of the cache or learned."""
        found = list(map(self.new.get, names))
        missing = [i for i, x in enumerate(found) if x is None]
        fresh: list[int] = []
        for i in missing:
            found[i] = self.old.get(names[i])
            if found[i] is None:
                fresh.append(i)
        for i, ids in zip(fresh, learn([names[i] for i in fresh]), strict=True):
            found[i] = ids
        for i in missing:
            name, ids = names[i], found[i]
            if len(name) <= self.piece:
                if self.held > self.size:
                    self.old, self.new, self.held = self.new, {}, 0
                self.new[name] = ids
                self.held += len(name) + len(ids) + _ENTRY
        return found

    def _distinct(self, names: pa.Array) -> list[bytes]:
        """Ids of distinct pieces: of a word and what follows it, or of the piece as a whole."""
        words = pc.utf8_rtrim(names, characters=_MARKS)
        plain = pc.match_substring_regex(words, _LETTERS)
        ids = np.empty(len(names), object)
        mask = plain.to_numpy(zero_copy_only=False)
        coded = words.filter(plain).dictionary_encode()
        marks = pc.replace_substring_regex(names.filter(plain), _BEFORE_MARKS, r"\1").dictionary_encode()
        table = np.empty(len(coded.dictionary), object)
        table[:] = self._known(coded.dictionary.to_pylist(), self._words)
        ends = np.empty(len(marks.dictionary), object)
        ends[:] = [x or b"" for x in self._plain(marks.dictionary.to_pylist())]
        ids[mask] = table[coded.indices.to_numpy()] + ends[marks.indices.to_numpy()]
        ids[~mask] = self._known(names.filter(pa.array(~mask)).to_pylist(), self._others)
        out = ids.tolist()
        for i in np.flatnonzero(pc.starts_with(names, "\n").to_numpy(zero_copy_only=False)):
            out[i] = self.feed + out[i]
        return out

    def encode(self, texts: Sequence[str]) -> list[bytes]:
        """One entry per text; call it with some million characters at a time.  Longer texts are worked off in parts."""
        whole = {i: self._plain([t])[0] for i, t in enumerate(texts) if any(a in t for a in self.added)}
        out, parts, of, size = [[whole[i]] if i in whole else [] for i in range(len(texts))], [], [], 0
        for i, t in enumerate(texts):
            at = 0
            while i not in whole and at < len(t):
                cut = _LONE_BLANK.search(t, at + PART) if len(t) - at > PART else None
                stop = cut.start() if cut else len(t)
                parts.append((_HEAD if at == 0 else "") + t[at:stop])
                of.append(i)
                size += stop - at
                at = stop + 1
                if size > PART:
                    for k, ids in zip(of, self._pieces(parts), strict=True):
                        out[k].append(ids)
                    parts, of, size = [], [], 0
        for k, ids in zip(of, self._pieces(parts), strict=True):
            out[k].append(ids)
        return [x[0] if len(x) == 1 else b"".join(x) for x in out]

    def _pieces(self, parts: list[str]) -> list[bytes]:
        """Ids of parts of texts, which begin with a mark or follow a blank."""
        if not parts:
            return []
        column = pa.array(parts, pa.large_string())
        uneven = pc.match_substring_regex(column, _UNEVEN).to_numpy(zero_copy_only=False)
        even = pc.split_pattern(pc.replace_substring(column.filter(pa.array(~uneven)), "\n", " \n"), " ")
        split = [_LONE_BLANK.split(parts[i]) for i in np.flatnonzero(uneven)]
        counts = np.zeros(len(parts), np.int64)
        counts[~uneven] = pc.list_value_length(even).to_numpy()
        counts[uneven] = [len(x) for x in split]
        pieces = pa.chunked_array([even.flatten(), pa.array([p for x in split for p in x], pa.large_string())]).combine_chunks().dictionary_encode()
        codes, known = pieces.indices.to_numpy(), self._distinct(pieces.dictionary)
        flat, sizes = np.frombuffer(b"".join(known), self.dtype), np.fromiter(map(len, known), np.int64, len(known)) // self.dtype.itemsize
        starts, each = np.cumsum(sizes) - sizes, sizes[codes]
        ends = np.cumsum(each)
        data = flat[np.repeat(starts[codes] - (ends - each), each) + np.arange(ends[-1] if len(ends) else 0)].tobytes()
        # texts with lone white space come first, then the others
        order = np.concatenate([np.flatnonzero(~uneven), np.flatnonzero(uneven)])
        stops = np.concatenate([[0], ends])[np.cumsum(counts[order])] * self.dtype.itemsize
        out: list[bytes] = [b""] * len(parts)
        for i, a, b in zip(order.tolist(), [0, *stops[:-1].tolist()], stops.tolist(), strict=True):
            out[i] = data[a:b]
        return out

    def ids(self, data: bytes) -> np.ndarray:
        return np.frombuffer(data, self.dtype)


#: the worker's encoders
_LOADED: list[Encoder] = []


@functools.lru_cache(maxsize=2)
def encoder(path: str, ordinary: bool = False) -> Encoder:
    """The worker's encoder for a vocabulary file; loading takes a second, so tasks share it."""
    _LOADED.append(Encoder(path, ordinary=ordinary))
    del _LOADED[:-2]
    return _LOADED[-1]


def forget() -> None:
    """Empty the caches of the worker's encoders; what a vocabulary file holds stays."""
    for e in _LOADED:
        e.forget()
