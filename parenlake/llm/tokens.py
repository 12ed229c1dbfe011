"""Token ids of whole texts by the tokenizers library, stretch by stretch.

A byte-level tokenizer always splits a text at certain places, whatever stands
around them (``cut_places``), so the stretches between them can be encoded alone
and remembered. Texts are cut and their stretches made distinct on whole Arrow
columns; each distinct one is looked up once, and ids are dealt out by ``take``.

Words between single spaces (``words_of``, ``word_ids``) are for callers that
need words: those not met before are encoded together, one behind the other, and
told apart by their bytes, since every call costs more than a short stretch.
"""

from __future__ import annotations

import json
import os
import re
from array import array
from codecs import charmap_decode
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_TOUCHING = re.compile(r"\s\s")
#: Letters, and behind them ASCII punctuation without an apostrophe (which begins
#: contractions): a byte-level tokenizer always cuts between the two, nowhere else.
_PARTS = re.compile(r"([A-Za-z\u00C0-\u00D6\u00D8-\u00F6\u00F8-\u00FF]+)([!-&(-/:-@\[-`{-~]*)")
#: A stretch that the library's model can be given as it is, but for its spelling.
_LETTERS = re.compile(r" ?[A-Za-z\u00C0-\u00D6\u00D8-\u00F6\u00F8-\u00FF]+")

#: Kinds of bytes: of letters as above, of other visible ASCII, of other characters
#: that aren't white space; the space, other ASCII white space; of any other character.
_LETTER, _MARK, _OTHER, _SPACE, _FEED, _UNSURE = range(6)
_KINDS = np.full(256, _OTHER, np.uint8)
_KINDS[:128] = [_LETTER if chr(b).isalpha() else _MARK if 32 < b < 127 else _SPACE if b == 32 else _FEED if 9 <= b <= 13 else _UNSURE for b in range(128)]
#: White space beyond ASCII (and U+180E, which once was), by first bytes.
_WHITE: dict[int, list[bytes]] = {}
for _c in "\u0085\u00a0\u1680\u180e\u2028\u2029\u202f\u205f\u3000" + "".join(map(chr, range(0x2000, 0x200B))):
    _WHITE.setdefault(_c.encode()[0], []).append(_c.encode())


def _pairs(before: list[int], behind: list[int]) -> list[int]:
    return [8 * a + b for a in before for b in behind]


#: Pairs of kinds between which a text is cut.
_BETWEEN = np.zeros(64, bool)
_BETWEEN[[*_pairs([_LETTER, _MARK, _OTHER], [_SPACE, _FEED]), *_pairs([_LETTER], [_MARK]), *_pairs([_FEED], [_LETTER, _MARK, _OTHER])]] = True
#: Pairs of which the second is white space, and the first may be.
_RUN = np.zeros(64, bool)
_RUN[_pairs([_SPACE, _FEED, _UNSURE], [_SPACE, _FEED])] = True


def cut_places(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """For each byte of UTF-8 texts, which begin at ``starts``, whether one begins
    there or a byte-level tokenizer always splits in front of it: white space
    behind anything else; ASCII that is no letter behind a letter; the last white
    space in front of anything else, and what follows it unless it is a space."""
    kinds = _KINDS[data]
    at = np.flatnonzero(data[:-1] == 0xC3)
    at = at[(data[at + 1] != 0x97) & (data[at + 1] != 0xB7)]
    kinds[at] = kinds[at + 1] = _LETTER
    for first, found in _WHITE.items():
        at = np.flatnonzero(data[: max(0, len(data) + 1 - len(found[0]))] == first)
        for white in found if len(at) else ():
            here = at[np.all([data[at + k] == b for k, b in enumerate(white)], axis=0)]
            for k in range(len(white)):
                kinds[here + k] = _UNSURE
    begins, cut = np.zeros(len(data), bool), np.zeros(len(data), bool)
    begins[starts] = True
    pairs = 8 * kinds[:-1] + kinds[1:]
    cut[1:] = _BETWEEN[pairs]
    last = np.flatnonzero(_RUN[pairs[:-1]]) + 1
    cut[last[(kinds[last + 1] < _SPACE) & ~begins[last + 1]]] = True
    return cut | begins


def byte_values() -> dict[str, int]:
    """Byte-level vocabularies write bytes that don't print as later characters."""
    shown = [b for b in range(256) if chr(b).isprintable() and b not in (32, 173)]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in shown)}


def words_of(text: str) -> list[str] | None:
    """The text cut at single spaces; None if white space touches or stands at
    an end."""
    if _TOUCHING.search(text) or text[:1].isspace() or text[-1:].isspace():
        return None
    return text.split(" ")


class Recent:
    """word -> value, worked out by ``learn`` for many words at once, for the
    words met lately: when ``limit`` new ones are known, those not met since
    the last time are forgotten."""

    def __init__(self, learn: Callable[[list[str]], Iterable], limit: int) -> None:
        self.learn, self.limit = learn, limit
        self.new: dict = {}
        self.old: dict = {}

    def of(self, lists: list[list[str]]) -> list[list]:
        """The value of every word; values are never None."""
        found = [list(map(self.new.get, x)) for x in lists]
        # Only the places that lack a value are looked at again.
        lacking = [(x, values, [k for k, v in enumerate(values) if v is None]) for x, values in zip(lists, found, strict=True) if None in values]
        unknown = {x[k] for x, _, places in lacking for k in places}
        missing = []
        for word in unknown:
            value = self.old.get(word)
            if value is None:
                missing.append(word)
            else:
                self.new[word] = value
        if missing:
            self.new.update(zip(missing, self.learn(missing), strict=True))
        for x, values, places in lacking:
            for k in places:
                values[k] = self.new[x[k]]
        if len(self.new) > self.limit:
            self.old, self.new = self.new, {}
        return found

    def get(self, word: str) -> object | None:
        """The value of a word met lately; None otherwise."""
        value = self.new.get(word)
        return self.old.get(word) if value is None else value


class LibraryTokens:
    """Encodes texts with one tokenizer; special tokens' strings in a text are
    ordinary text. ``LIMIT`` bounds what is remembered (twice)."""

    LIMIT = 200_000
    #: Words that are encoded together.
    TOGETHER = 2_000
    #: Bytes of the longest stretches that are remembered.
    LONGEST = 100

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        with open(path, encoding="utf-8") as f:
            told = json.load(f)
        before = told.get("pre_tokenizer") or {}
        #: Only this kind of tokenizer is known to split as described above.
        self.splits = before.get("type") == "ByteLevel" and not before.get("add_prefix_space") and before.get("use_regex", True) and not told.get("normalizer")
        self.size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        #: Bytes of each id: a byte-level vocabulary writes a byte a character.
        self.lengths = np.array([len(self.tokenizer.id_to_token(k) or "") for k in range(self.size)], np.int64)
        #: stretch -> its ids
        self.known = Recent(self.stretch_ids, self.LIMIT)
        #: Letters can go to the library's model alone, if no added token is of letters.
        self.alone = self.splits and all(x.get("special") or not _PARTS.match(x["content"].strip()) for x in told.get("added_tokens", ()))
        #: A stretch holds no added token and cuts none, if no such token is looked for.
        self.cuts = self.splits and all(x.get("special") for x in told.get("added_tokens", ()))
        shown = {b: c for c, b in byte_values().items()}
        self.spelling = "".join(shown[b] for b in range(256))
        self.space, self.letters = shown[32], {k: "".join(shown[b] for b in chr(k).encode()) for k in range(128, 256)}

    def library(self, texts: list[str]) -> list[bytes]:
        return [array("I", x.ids).tobytes() for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def word_ids(self, words: list[str]) -> list[bytes]:
        """Ids of words, each with a space in front of it. Letters, with or without
        punctuation behind them, need no search for where they are cut: the
        library's model gets them as the library would hand them over."""
        if not self.alone:
            return list(self.spaced(words))
        cut = [_PARTS.fullmatch(w) for w in words]
        others = iter(self.spaced([w for w, m in zip(words, cut, strict=True) if m is None]))
        tokenize, heads, tails, out = self.tokenizer.model.tokenize, {}, {"": b""}, []
        for m in cut:
            if m is None:
                out.append(next(others))
                continue
            head, tail = m.groups()
            ids = heads.get(head)
            if ids is None:
                ids = self.known.get(" " + head) if tail else None
                if ids is None:
                    ids = array("I", [x.id for x in tokenize(self.space + (head if head.isascii() else head.translate(self.letters)))]).tobytes()
                heads[head] = ids
            if tail not in tails:
                tails[tail] = self.library([tail])[0]
            out.append(ids + tails[tail])
        return out

    def spaced(self, words: list[str]) -> Iterator[bytes]:
        """Ids of words, each with a space in front of it, encoded together."""
        blocks = [words[k : k + self.TOGETHER] for k in range(0, len(words), self.TOGETHER)]
        joined = [" " + " ".join(x) for x in blocks]
        for block, text, raw in zip(blocks, joined, self.library(joined), strict=True):
            # No word holds a space, so each begins at one.
            data = np.frombuffer(text.encode(), np.uint8)
            ends = np.append(np.flatnonzero(data == 32)[1:], len(data))
            reached = np.cumsum(self.lengths[np.frombuffer(raw, np.uint32)])
            at = np.searchsorted(reached, ends)
            if len(ends) != len(block) or len(reached) != at[-1] + 1 or (reached[at] != ends).any():
                raise ValueError("the tokenizer does not end a token in front of every space")
            cuts = [0, *(4 * at + 4).tolist()]
            yield from map(raw.__getitem__, map(slice, cuts, cuts[1:]))

    def stretch_ids(self, stretches: list[str]) -> list[bytes]:
        """Ids of stretches as they are. Letters, with or without a space in front
        of them, go to the library's model as the library would hand them over."""
        tokenize, spelling = self.tokenizer.model.tokenize, self.spelling
        lone = [_LETTERS.fullmatch(x) is not None for x in stretches]
        others = iter(self.library([x for x, alone in zip(stretches, lone, strict=True) if not alone]))
        return [
            array("I", [t.id for t in tokenize(charmap_decode(x.encode(), "strict", spelling)[0])]).tobytes() if alone else next(others)
            for x, alone in zip(stretches, lone, strict=True)
        ]

    def of(self, texts: list[str] | pa.Array) -> list[bytes]:
        """Ids of each text (null: none) as little-endian unsigned 32-bit integers."""
        column = pc.fill_null((texts if isinstance(texts, pa.Array) else pa.array(texts, pa.large_string())).cast(pa.large_string()), "")
        if not self.cuts:
            return self.library(column.to_pylist())
        bounds = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
        size, base = int(bounds[-1] - bounds[0]), int(bounds[0])
        if not size:
            return [b""] * len(column)
        text = column.buffers()[2].slice(base, size)
        bounds = bounds - base
        places = np.append(np.flatnonzero(cut_places(np.frombuffer(text, np.uint8), bounds[bounds < size])), size)
        coded = pa.LargeStringArray.from_buffers(len(places) - 1, pa.py_buffer(places), text).dictionary_encode()
        values = self.values(coded.dictionary)
        found = pa.array(values, pa.large_binary()).take(coded.indices)
        ends = np.frombuffer(found.buffers()[1], np.int64)[np.searchsorted(places, bounds)].tolist()
        ids = memoryview(found.buffers()[2])
        return [bytes(ids[a:b]) for a, b in zip(ends, ends[1:])]

    def values(self, stretches: pa.Array) -> list[bytes]:
        """Ids of distinct stretches; long ones are not remembered."""
        long = pc.greater(pc.binary_length(stretches), self.LONGEST)
        words = stretches.to_numpy(zero_copy_only=False).tolist()
        places = np.flatnonzero(long.to_numpy(zero_copy_only=False)).tolist()
        if not places:
            return self.known.of([words])[0]
        whole = dict(zip(places, self.library([words[k] for k in places]), strict=True))
        known = iter(self.known.of([[w for k, w in enumerate(words) if k not in whole]])[0])
        return [whole[k] if k in whole else next(known) for k in range(len(words))]


_shared: dict[str, LibraryTokens] = {}


def library_tokens(path: str) -> LibraryTokens:
    """One tokenizer for each worker process, whatever the number of tasks."""
    if path not in _shared:
        _shared[path] = LibraryTokens(path)
    return _shared[path]
