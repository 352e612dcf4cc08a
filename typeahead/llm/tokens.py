"""Token ids of whole texts with the ``tokenizers`` library, one word piece at a time.

A byte-level BPE never merges across its pre-tokenizer's pieces, so the ids of a text are
the ids of its pieces in order.  Each worker encodes a distinct piece once and looks it up
afterwards; texts with characters outside the checked range, or with a special token's
string, go to the library whole.  Results always equal ``Tokenizer.encode``.
"""

from __future__ import annotations

import itertools
import os
import re

import numpy as np

# The pre-tokenizer's pattern of the byte-level BPE, written for the letters,
# numbers and spaces below U+0180; SAFE lists every other character it treats alike.
LETTERS = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-ſ"
NUMBERS = "0-9\xb2\xb3\xb9\xbc-\xbe"
PIECES = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{LETTERS}]+| ?[{NUMBERS}]+"
                    rf"| ?[^\s{LETTERS}{NUMBERS}]+|\s+(?!\S)|\s+")
UNSAFE = re.compile("[^\x00-\x1b\x20-ſ‐-‧‰-⁞₠-₿]")
SPACED_WORD = re.compile(f" [{LETTERS}]+")

CACHE_PIECES = 150_000  # per generation, two of them per worker; the older one is dropped when full


class PieceEncoder:
    def __init__(self, tokenizer_path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.tok = Tokenizer.from_file(tokenizer_path)
        vocab = self.tok.get_vocab()
        self.special = [t.content for t in self.tok.get_added_tokens_decoder().values()]
        # a byte-level token has one character per byte
        self.n_bytes = np.zeros(max(vocab.values(), default=-1) + 1, np.int64)
        for token, i in vocab.items():
            self.n_bytes[i] = len(token)
        self._turn()
        self._turn()

    def _turn(self):
        """Start a generation; pieces of the last one come over when they are met again."""
        self.old = (self.index, self.ids, self.ends) if hasattr(self, "index") else ({}, None, None)
        self.index: dict[str, int] = {}
        self.ids = np.empty(0, np.uint32)
        self.ends = np.zeros(1, np.int64)

    def rest(self) -> None:
        """At a task's end: a worker that goes on to other work keeps one generation at most."""
        self.old = ({}, None, None)

    def _learn(self, pieces: list[str]) -> None:
        """Append the ids of new pieces, in order, to the cache arrays."""
        known, ids, ends = self.old
        lists = [ids[ends[at]:ends[at + 1]] if (at := known.get(p)) is not None else None for p in pieces]
        spaced = [i for i, p in enumerate(pieces) if lists[i] is None and SPACED_WORD.fullmatch(p)]
        for lo in range(0, len(spaced), 20_000):
            # " word word" splits before each blank again: one call, cut by byte lengths
            part = spaced[lo:lo + 20_000]
            joined = np.asarray(self.tok.encode_batch_fast(
                ["".join(pieces[i] for i in part)], add_special_tokens=False)[0].ids, np.uint32)
            ends = np.cumsum([len(pieces[i].encode()) for i in part])
            cuts = np.searchsorted(np.cumsum(self.n_bytes[joined]), ends) + 1
            for i, found in zip(part, np.split(joined, cuts[:-1])):
                lists[i] = found
        rest = [i for i, x in enumerate(lists) if x is None]
        for i, e in zip(rest, self.tok.encode_batch_fast([pieces[i] for i in rest],
                                                         add_special_tokens=False)):
            lists[i] = np.asarray(e.ids, np.uint32)
        if lists:
            self.ids = np.concatenate([self.ids, *lists])
            self.ends = np.concatenate([self.ends, self.ends[-1] + np.cumsum([len(x) for x in lists])])

    def encode(self, texts: list[str | None], end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """ids of all texts, each followed by ``end_id``, and the end offset of each text."""
        if len(self.index) > CACHE_PIECES:
            self._turn()
        words: list[list[str] | None] = []
        for text in texts:
            plain = text is None or not (UNSAFE.search(text) or any(s in text for s in self.special))
            words.append(PIECES.findall(text or "") if plain else None)
        index, known = self.index, len(self.index)
        lengths = [len(w or ()) for w in words]
        at = np.fromiter((index.setdefault(p, len(index)) for w in words if w for p in w),
                         np.int64, sum(lengths))
        self._learn(list(itertools.islice(index, known, None)))
        out, ends, pos, total = [], [], 0, 0
        for text, w, n in zip(texts, words, lengths):
            if w is None:
                ids = np.asarray(self.tok.encode(text, add_special_tokens=False).ids, np.uint32)
            else:
                ids = self._gather(at[pos:pos + n])
                pos += n
            out += [ids, np.array([end_id], np.uint32)]
            total += len(ids) + 1
            ends.append(total)
        return (np.concatenate(out) if out else np.empty(0, np.uint32)), np.asarray(ends, np.int64)

    def _gather(self, at: np.ndarray) -> np.ndarray:
        start, n = self.ends[at], self.ends[at + 1] - self.ends[at]
        first = np.cumsum(n) - n
        return self.ids[np.repeat(start - first, n) + np.arange(int(n.sum()))]


_encoders: dict[str, PieceEncoder] = {}


def encoder(tokenizer_path: str) -> PieceEncoder:
    """One encoder per Python worker and vocabulary file."""
    if tokenizer_path not in _encoders:
        _encoders[tokenizer_path] = PieceEncoder(tokenizer_path)
    return _encoders[tokenizer_path]


def drop_encoders() -> None:
    _encoders.clear()


def slices(texts: list[str | None], max_chars: int = 4_000_000):
    """Index ranges of ``texts`` of at most ``max_chars`` characters (one text at least)."""
    lo = size = 0
    for i, t in enumerate(texts):
        n = len(t or "")
        if i > lo and size + n > max_chars:
            yield lo, i
            lo, size = i, 0
        size += n
    if lo < len(texts):
        yield lo, len(texts)
