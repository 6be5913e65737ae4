"""Token ids of whole texts by a given tokenizer file, with a bounded cache of text pieces.

Texts are cut where the tokenizer's own pre-tokenizer always cuts, so the ids of a text
are those of its pieces one after the other; the library encodes each new piece once.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from itertools import chain, repeat
from unicodedata import is_normalized

import numpy as np

#: Pieces a process keeps; beyond it the cache starts anew.
CACHE_PIECES = 600_000
#: Characters cut into pieces at once.
SEGMENT = 1 << 20
#: New pieces encoded in one call.
JOINED = 2000

# The characters of Unicode's White_Space property.
SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
_L = "A-Za-z\\xc0-\\xd6\\xd8-\\xf6\\xf8-\\xff"
_PUNCT = "!-/:-@\\[-`{-~"
#: Pieces of byte-level BPE: a word takes the one space before it, a run of space leaves its
#: last character, and letters always end before punctuation.
SPACE_LED = f" ?[{_L}]+(?=[{SPACE}{_PUNCT}]|\\Z)| ?[^{SPACE}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"
#: Pieces of tokenizers that drop white space and mark the end of a word.
WORDS = f"[{_L}]+(?=[{SPACE}{_PUNCT}]|\\Z)|[^{SPACE}]+"


class Encoder:
    """``pieces`` is one of the patterns above, or None to encode texts as they are."""

    def __init__(self, path: str, pieces: str | None):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.tok = Tokenizer.from_file(path)
        self.tok.encode_special_tokens = True           # their strings in a text are ordinary text
        self.cut = re.compile(pieces) if pieces else None
        self.led = pieces == SPACE_LED
        vocab = self.tok.get_vocab(with_added_tokens=True)
        self.mark = np.zeros(max(vocab.values()) + 1, bool)
        self.mark[[i for t, i in vocab.items() if (t.startswith("\u0120") if self.led else t.endswith("</w>"))]] = True
        self.safe = re.compile(f"(?<=[^{SPACE}]) (?=[^{SPACE}])")
        self._clear()

    def _clear(self) -> None:
        self.at: dict[str, int] = {}
        self.start, self.size = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.flat = np.zeros(0, np.uint32)

    def _plain(self, p: str) -> bool:
        """Pieces of letters: one mark each, at the first id or at the last."""
        return p[0] == " " and p[1:].isalpha() if self.led else p.isalpha() and p.lower().isalpha() and is_normalized("NFC", p)

    def _learn(self, new: list[str]) -> None:
        """Words are encoded joined, as one call a piece costs more than its work; the
        marks among the ids tell them apart. Other pieces go one by one."""
        plain, rest = [], []
        for p in new:
            (plain if self._plain(p) else rest).append(p)
        groups = [plain[k:k + JOINED] for k in range(0, len(plain), JOINED)]
        joined = self.tok.encode_batch_fast([("" if self.led else " ").join(g) for g in groups], add_special_tokens=False)
        known, ids, sizes = [], [], []
        for g, e in zip(groups, joined):
            x = np.array(e.ids, np.uint32)
            at = np.flatnonzero(self.mark[x])
            if len(at) != len(g):
                rest += g
                continue
            known += g
            ids.append(x)
            sizes.append(np.diff(at, append=len(x)) if self.led else np.diff(at, prepend=-1))
        got = [e.ids for e in self.tok.encode_batch_fast(rest, add_special_tokens=False)]
        sizes.append(np.fromiter(map(len, got), np.int64, len(got)))
        ids.append(np.fromiter(chain.from_iterable(got), np.uint32, int(sizes[-1].sum())))
        size = np.concatenate(sizes)
        self.start = np.concatenate([self.start, len(self.flat) + np.cumsum(size) - size])
        self.size = np.concatenate([self.size, size])
        self.flat = np.concatenate([self.flat, *ids])
        self.at.update(zip(chain(known, rest), range(len(self.at), len(self.at) + len(new))))

    @property
    def largest(self) -> int:
        """The largest id of the vocabulary, added tokens included."""
        return max(self.tok.get_vocab(with_added_tokens=True).values())

    def _segments(self, text: str) -> Iterator[str]:
        a = 0
        while len(text) - a > SEGMENT and (m := self.safe.search(text, a + SEGMENT)):
            yield text[a:m.start()]
            a = m.start()
        yield text[a:] if a else text

    def __call__(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after the other as uint32, and their n + 1 offsets."""
        if self.cut is None:
            ids = [e.ids for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]
            off = np.cumsum([0, *map(len, ids)])
            return np.fromiter(chain.from_iterable(ids), np.uint32, int(off[-1])), off
        flat, sizes = [], []
        for text in texts:
            n = 0
            for s in self._segments(text):
                found = self.cut.findall(s)
                flat.extend(found)
                n += len(found)
            sizes.append(n)
        ids, off = self._encode(flat)
        return ids, off[np.cumsum([0, *sizes])]

    def _encode(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        at = np.fromiter(map(self.at.get, pieces, repeat(-1)), np.int64, len(pieces))
        miss = np.flatnonzero(at < 0)
        if len(miss) and len(self.at) > CACHE_PIECES:
            self._clear()
            miss = np.arange(len(pieces))
        if len(miss):
            lost = [pieces[i] for i in miss.tolist()]
            self._learn(list(set(lost)))
            at[miss] = np.fromiter(map(self.at.__getitem__, lost), np.int64, len(lost))
        size = self.size[at]
        off = np.concatenate([[0], np.cumsum(size)])
        return self.flat[np.repeat(self.start[at] - off[:-1], size) + np.arange(off[-1])], off


_ENCODERS: dict[tuple, Encoder] = {}


def encoder(path: str, pieces: str | None) -> Encoder:
    """The process's encoder for a file, with what its cache has learned."""
    if (path, pieces) not in _ENCODERS:
        _ENCODERS[path, pieces] = Encoder(path, pieces)
    return _ENCODERS[path, pieces]
