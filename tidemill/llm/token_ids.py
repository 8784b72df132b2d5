"""Exact token ids by a tokenizers file, remembered by chunk."""

from __future__ import annotations

import functools
import os
from array import array

import numpy as np

from tidemill.llm.common import Memo, chunks, gathered, marked_chunks, numbered_words


#: Bytes of chunks and ids that a worker remembers.
MEMO = 240_000_000


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class Encoder:
    """Encodes texts with the tokenizers library, each distinct chunk once while it is remembered.

    Ids are the library's own for the whole text: a text that holds the string of an added token is encoded in one
    piece. They come as little-endian unsigned integers of 32 bits."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.added = [x.content for x in self.tokenizer.get_added_tokens_decoder().values()]
        self.size = self.tokenizer.get_vocab_size()
        self.memo = Memo(self._one, MEMO)
        feed = self.tokenizer.encode("\n", add_special_tokens=False).ids
        self.feed = feed[0] if len(feed) == 1 else None

    def _one(self, chunk: str) -> bytes:
        return np.array(self.tokenizer.encode(chunk, add_special_tokens=False).ids, "<u4").tobytes()

    def _words(self, words: list[str]) -> list[bytes]:
        """Ids of words without line feeds: encoded as lines, and parted at the line feeds' id, which no word has. A
        line feed is a pre-token of its own after a word."""
        lines = ["\n".join(words[i : i + 24]) + "\n" for i in range(0, len(words), 24)]
        found = [array("I", x.ids) for x in self.tokenizer.encode_batch_fast(lines, add_special_tokens=False)]
        raw = b"".join(found)
        ends = np.flatnonzero(np.frombuffer(raw, "<u4") == self.feed)
        if len(ends) != len(words):
            return [self._one(x) for x in words]
        ends = (4 * ends).tolist()
        return [raw[a:b] for a, b in zip([0, *(x + 4 for x in ends[:-1])], ends, strict=True)]

    def _plain(self, words: list[str]) -> list[bytes]:
        """Ids of words with at most one blank before them and one line feed after them."""
        end = np.array([self.feed], "<u4").tobytes()
        found = []
        for i in range(0, len(words), 24_000):
            part = words[i : i + 24_000]
            ids = self._words([x[:-1] if x[-1] == "\n" else x for x in part])
            found += [y + end if x[-1] == "\n" else y for x, y in zip(part, ids, strict=True)]
        return found

    def _special(self, text: str) -> bool:
        return any(map(text.__contains__, self.added))

    def _cut(self, text: str) -> str | None:
        return None if self._special(text) else marked_chunks(text)

    def _odd(self, text: str) -> list[str]:
        return [text] if self._special(text) else chunks(text)

    def encode(self, texts: list[str]):
        """Yields the ids of each text as bytes. The chunks of many texts are numbered by Arrow, so that only distinct
        ones are looked up; their ids are then dealt out by number."""
        memo = self.memo
        for words, number, borders, odd in numbered_words(texts, self._cut, self._odd):
            held = memo.values_of(words, self._plain if self.feed is not None else lambda new: list(map(self._one, new)))
            found = gathered(held, number, borders)
            for i, x in enumerate(found):
                yield b"".join(map(self._one, odd[i])) if i in odd else x


_made = functools.lru_cache(maxsize=2)(Encoder)


def encoder(path: str, memo: int = MEMO) -> Encoder:
    """A worker's encoder for a vocabulary, which remembers chunks within about ``memo`` bytes."""
    found = _made(path)
    found.memo.most = memo
    Memo.begin(found.memo)
    return found
