"""Token ids of whole texts from a word-level vocabulary file, word by word.

The vocabulary's pre-tokeniser never lets a token cross white space, its
normaliser never composes characters across a space, and none of its special
strings holds one.  So the ids of a text are the ids of its pieces between
spaces and line ends, and between a letter and the punctuation after it, in
order; lower-casing first changes nothing where it is the library's own
(characters below U+0250).  Each distinct piece is encoded by the library
once per worker; the cache only saves time and is emptied when it is full.
"""

from __future__ import annotations

import os
import re

import numpy as np

from tiller.llm.common import kept

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: Distinct pieces kept per worker.
CACHE_ENTRIES = 500_000
#: A character that no piece in a joint call holds; it separates the pieces' ids.
_MARK = "\x01"
#: Between a lower-case Latin letter and ASCII punctuation a token always ends.
_EDGE = re.compile(r"(?<=[a-zß-öø-ÿ])(?=[!-/:-@\[-`{-~])")
#: Characters whose lower case depends on more than themselves, or is not surely
#: the same for the library; a text with one is not lowered before it is cut.
_OTHER = re.compile("[^\x00-įı-ɏ]")

_tokenizers: dict[str, object] = {}


def tokenizer(path: str):
    """The library's tokenizer for a vocabulary file, loaded once per worker."""
    if path not in _tokenizers:
        from tokenizers import Tokenizer

        _tokenizers[path] = Tokenizer.from_file(path)
    return _tokenizers[path]


class PieceEncoder:
    """Encodes texts as the library does, with a cache of pieces."""

    def __init__(self, path: str, entries: int = CACHE_ENTRIES):
        self.library = tokenizer(path)
        self.entries = entries
        self.known: dict[str, bytes] = {"": b""}
        (self.mark,) = self._ids(_MARK)
        vocabulary = self.library.get_vocab()
        #: ids that end a word
        self.last = np.zeros(max(vocabulary.values()) + 1, bool)
        self.last[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True

    def _ids(self, text: str) -> list[int]:
        return self.library.encode(text, add_special_tokens=False).ids

    def _pieces(self, text: str) -> list[str]:
        if "<|" in text:  # perhaps a special string: cut at spaces only
            return text.replace("\n", " ").split(" ")
        if not _OTHER.search(text):
            text = text.lower()
        return _EDGE.sub(" ", text).replace("\n", " ").split(" ")

    def _learn(self, pieces: set[str]) -> None:
        words, joint = [], []
        for p in pieces:
            if len(p) > 1000 or _MARK in p:
                self.known[p] = np.asarray(self._ids(p), "<u4").tobytes()
            elif p.isalpha() and not _OTHER.search(p):
                words.append(p)
            else:
                joint.append(p)
        for at in range(0, len(words), 2000):
            some = words[at : at + 2000]
            ids = self._joint(" ".join(some))
            ends = np.flatnonzero(self.last[ids]) + 1
            if len(ends) == len(some):
                self._keep(some, ids, np.concatenate(([0], ends[:-1])), ends)
            else:
                joint += some
        for at in range(0, len(joint), 2000):
            some = joint[at : at + 2000]
            ids = self._joint(f" {_MARK} ".join(some))
            cuts = np.flatnonzero(ids == self.mark)
            self._keep(some, ids, np.concatenate(([0], cuts + 1)),
                       np.concatenate((cuts, [len(ids)])))

    def _joint(self, text: str) -> np.ndarray:
        got = self.library.encode_batch_fast([text], add_special_tokens=False)[0].ids
        return np.asarray(got, "<u4")

    def _keep(self, pieces, ids, starts, ends) -> None:
        raw = ids.tobytes()
        self.known.update((p, raw[a:b]) for p, a, b in zip(
            pieces, (starts * 4).tolist(), (ends * 4).tolist(), strict=True))

    def encode(self, texts: list[str]) -> list[bytes]:
        """Each text's ids as little-endian unsigned 32-bit integers."""
        split = [self._pieces(t) for t in texts]
        pieces = set().union(*split)
        new = pieces.difference(self.known)
        if len(self.known) + len(new) > self.entries:
            self.known, new = {"": b""}, pieces
        if new:
            self._learn(new)
        known = self.known
        return [b"".join(map(known.__getitem__, words)) for words in split]


def piece_encoder(path: str) -> PieceEncoder:
    """One encoder per worker and vocabulary file."""
    return kept("tokens", path, lambda: PieceEncoder(path))
