"""Byte-level BPE with the tokenizers library, once per distinct word.

The pre-tokenizer of a byte-level BPE never lets a piece run over the
boundary before a blank that is followed by a visible character, nor around a
single line feed between two visible characters.  So a text's ids are those of
its words, each with its leading blank, put together.  A Python worker keeps
the words it has seen as encoded bytes.  New words of Latin letters with
punctuation behind go straight to the library's BPE model as the two pieces
that the pre-tokenizer would make; everything else goes through the library's
whole encoder.
"""

from __future__ import annotations

import os
import re
import sys
from array import array

import numpy as np

#: Entries kept in each cache of a Python worker; a full cache restarts empty (memory only, never results).
MAX_WORDS = 500_000

_PLAIN = re.compile(r"( ?[A-Za-zÀ-ÖØ-öø-ÿ]+)([!\"#$%&()*+,\-./:;<=>?@\[\\\]^`{|}~]*)")


def _byte_letters() -> dict[int, str]:
    """The byte-level alphabet: printable bytes stand for themselves, the others for U+0100 and up."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


class WordEncoder:
    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer
        self.tok = Tokenizer.from_file(path)
        self.model, self.letters = self.tok.model, _byte_letters()
        self.dtype = np.dtype("<u2") if self.tok.get_vocab_size(with_added_tokens=True) <= 1 << 16 else np.dtype("<u4")
        self.code = "H" if self.dtype.itemsize == 2 else "I"
        self.after_blank: dict[str, bytes] = {}  # word -> ids of " " + word
        self.pieces: dict[str, bytes] = {}       # piece -> ids of the piece itself

    @staticmethod
    def _words(words: list[str]) -> list[str]:
        """Pieces of a text split at blanks: runs of white space stay in one piece."""
        out, cur = [], words[0]
        for w in words[1:]:
            if w and not w[0].isspace():
                out.append(cur)
                cur = " " + w
            else:
                cur += " " + w
        return [*out, cur]

    @staticmethod
    def _lines(piece: str) -> list[str]:
        """Cut around single line feeds between visible characters."""
        if "\n" not in piece:
            return [piece]
        out, lines = [], piece.split("\n")
        cur = lines[0]
        for nxt in lines[1:]:
            if cur and nxt and not cur[-1].isspace() and not nxt[0].isspace():
                out += [cur, "\n"]
                cur = nxt
            else:
                cur += "\n" + nxt
        return [*out, cur]

    def _bpe(self, piece: str) -> bytes:
        """Ids of one pre-token."""
        got = self.pieces.get(piece)
        if got is None:
            if piece.isascii():
                mapped = "Ġ" + piece[1:] if piece[0] == " " else piece
            else:
                mapped = piece.encode().decode("latin-1").translate(self.letters)
            got = self.pieces[piece] = self._raw([t.id for t in self.model.tokenize(mapped)])
        return got

    def _raw(self, ids: list[int]) -> bytes:
        out = array(self.code, ids)
        if sys.byteorder == "big":
            out.byteswap()
        return out.tobytes()

    def _plain(self, piece: str) -> bytes | None:
        m = _PLAIN.fullmatch(piece)
        if m is None:
            return None
        word, marks = m.groups()
        return self._bpe(word) + self._bpe(marks) if marks else self._bpe(word)

    def encode_many(self, texts: list[str]) -> list[bytes]:
        """Little-endian ids (of ``self.dtype``) of each text."""
        if len(self.after_blank) > MAX_WORDS:
            self.after_blank.clear()
        if len(self.pieces) > MAX_WORDS // 2:
            self.pieces.clear()
        words_of, known, plans, later = self.after_blank, self.pieces, [], set()
        known[""] = b""
        for text in texts:
            words = text.split(" ")
            found = list(map(words_of.get, words))
            found[0] = None
            gaps = [k for k, x in enumerate(found) if x is None] if None in found else []
            todo = []
            if all(words[k] and not words[k][0].isspace() for k in gaps[1:]):
                for k in gaps:
                    w = words[k]
                    got = self._plain(" " + w if k else w)
                    if got is None:
                        todo.append((k, w if k else None, self._lines(" " + w if k else w)))
                    else:
                        found[k] = got
                        if k:
                            words_of[w] = got
            else:
                todo = [(k, None, self._lines(p)) for k, p in enumerate(self._words(words))]
                found = [None] * len(todo)
            for _, _, ps in todo:
                for p in ps:
                    if p not in known and (got := self._plain(p)) is not None:
                        known[p] = got
                    elif p not in known:
                        later.add(p)
            plans.append((found, todo))
        new = list(later)
        for piece, enc in zip(new, self.tok.encode_batch_fast(new, add_special_tokens=False)):
            known[piece] = self._raw(enc.ids)
        out = []
        for found, todo in plans:
            for k, w, ps in todo:
                found[k] = known[ps[0]] if len(ps) == 1 else b"".join([known[p] for p in ps])
                if w is not None and len(ps) == 1:
                    words_of[w] = found[k]
            out.append(b"".join(found))
        return out


_ENCODERS: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """The worker's encoder for a tokenizer file (kept across tasks of one Python worker)."""
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]


def default_tokenizer() -> str:
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_50k.json")
