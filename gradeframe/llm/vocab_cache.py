"""Exact whole-text encoding through a bounded cache of white-space chunks.

A byte-pair tokenizer splits a text into pre-tokens first, and a pre-token of
the two supported families never crosses the boundary between a
non-white-space character and a following space or line feed:

* ``spaced=False`` (white space dropped): chunks lie between spaces and line
  feeds;
* ``spaced=True`` (byte level, one leading space belongs to the word): a
  chunk is the leading space together with what follows it, and white-space
  runs of other shapes go to the chunk that follows them.

So the ids of a text are the concatenation of the ids of its chunks. The
tokenizer itself encodes every distinct chunk; the cache is emptied when it
holds ``max_chunks`` (memory stays bounded, results do not change).
"""

from __future__ import annotations

import re
import unicodedata

import numpy as np

MAX_CHUNKS = 1_000_000
END_ID = 1
_MARKS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"   # ASCII marks without the apostrophe, which begins pre-tokens with letters
# white-space run, then the rest of the chunk; the last run of a text may stand alone
_SPACED = re.compile(r"[ \n]*[^ \n]+|[ \n]+\Z")
_ODD_SPACE = re.compile(r"[\t\r\x0b\x0c\x1c-\x1f\x85\xa0  -     　]")


def id_dtype(vocab_size: int) -> str:
    """Narrowest little-endian unsigned type that holds every id."""
    return "<u2" if vocab_size <= 1 << 16 else "<u4"


class ChunkEncoder(dict):
    """chunk -> its ids as bytes of ``dtype``; see the module text."""

    def __init__(self, path: str, spaced: bool, max_chunks: int = MAX_CHUNKS):
        import os
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        super().__init__()
        self.tok = Tokenizer.from_file(path)
        self.spaced, self.max_chunks = spaced, max_chunks
        vocab = self.tok.get_vocab()
        size = max(vocab.values()) + 1
        self.dtype = id_dtype(max(size, END_ID + 1))
        # ids that begin (spaced) or end (word-end marker) a word: they cut a joined encoding into its words
        self.edge = np.zeros(size, bool)
        for s, i in vocab.items():
            self.edge[i] = s.startswith("Ġ") if spaced else s.endswith("</w>")
        self.end = np.array([END_ID], self.dtype).tobytes()

    def chunks(self, text: str) -> list[str]:
        if not self.spaced:
            return text.replace("\n", " ").split(" ")
        if _ODD_SPACE.search(text):
            return [text] if text else []     # other white space: the whole text is one chunk
        return _SPACED.findall(text)

    def _plain(self, chunk: str) -> tuple[str, str]:
        """(letters, the marks behind them) when the chunk is just that, else ('', ''). Letters and marks are pre-tokens
        of their own, unless normalising turns the last letter into something that marks would join."""
        body = chunk[1:] if self.spaced and chunk[:1] == " " else chunk
        word = body if body.isalpha() else body.rstrip(_MARKS)
        if not word.isalpha() or not (self.spaced or word.isascii() or unicodedata.normalize("NFC", word).lower().isalpha()):
            return "", ""
        mark = len(body) - len(word)
        return (chunk[:-mark], chunk[-mark:]) if mark else (chunk, "")

    def learn(self, new: list[str]) -> None:
        """Encode the chunks not yet held."""
        words: set[str] = set()
        parts, single = [], []
        for c in new:
            word, mark = self._plain(c)
            if word and (not self.spaced or word[0] == " "):
                words.add(word)
                if mark:
                    parts.append((c, word, mark))
            else:
                single.append(c)
        todo = [w for w in words if w not in self]
        glue = "" if self.spaced else " "
        step = 256
        lots = [todo[i:i + step] for i in range(0, len(todo), step)]
        for i in range(0, len(lots), 32):
            block = lots[i:i + 32]
            for lot, enc in zip(block, self.tok.encode_batch_fast([glue.join(b) for b in block],
                                                                  add_special_tokens=False), strict=True):
                ids = np.array(enc.ids, self.dtype)
                at = np.flatnonzero(self.edge[ids])
                cut = np.append(at, len(ids)) if self.spaced else np.append(0, at + 1)
                if len(cut) != len(lot) + 1 or cut[0] != 0 or cut[-1] != len(ids):
                    self._each(lot)          # a word that is not one pre-token: encode them one by one
                    continue
                raw, w = ids.tobytes(), ids.itemsize
                for word, a, b in zip(lot, cut[:-1].tolist(), cut[1:].tolist(), strict=True):
                    self[word] = raw[a * w:b * w]
        for i in range(0, len(single), 1024):
            self._each(single[i:i + 1024])
        self._each([m for m in {m for _, _, m in parts} if m not in self])
        for c, word, mark in parts:
            self[c] = self[word] + self[mark]

    def _each(self, items: list[str]) -> None:
        for c, enc in zip(items, self.tok.encode_batch_fast(items, add_special_tokens=False), strict=True):
            self[c] = np.array(enc.ids, self.dtype).tobytes()

    def encode(self, text: str) -> bytes:
        """All ids of ``text`` and the end id, as bytes of ``dtype``."""
        return next(self.encode_all([text]))

    def encode_all(self, texts: list[str]):
        """``encode`` for a list. Unknown chunks are gathered over a lot of
        texts, so that the tokenizer sees large batches."""
        lot, get, end = 256, self.__getitem__, self.end
        for i in range(0, len(texts), lot):
            cut = [self.chunks(t) for t in texts[i:i + lot]]
            new = [c for c in set().union(*cut) if c not in self]
            if new:
                self.learn(new)
            for cs in cut:
                yield b"".join(map(get, cs)) + end
            if len(self) > self.max_chunks:
                self.clear()


_ENCODERS: dict[tuple, ChunkEncoder] = {}


def encoder(path: str, spaced: bool) -> ChunkEncoder:
    """One encoder per worker process and tokenizer file."""
    key = (path, spaced)
    if key not in _ENCODERS:
        _ENCODERS[key] = ChunkEncoder(path, spaced)
    return _ENCODERS[key]


def forget() -> None:
    """Drop the encoders of this worker process, which may hold a few hundred MB for an operator that is done."""
    _ENCODERS.clear()
