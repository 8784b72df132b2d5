"""Token counts of a unigram tokenizer without building its tokens: a count-only Viterbi.

An Aho-Corasick automaton enumerates every vocabulary piece in a text; dynamic programming over end positions carries the
best score and the piece count of the best path, nothing else. Tie rule of the tokenizer: a later candidate replaces the
best only if its score is higher, and candidates come in ascending order of their start, so the longest last piece wins.
Scores are added in double precision. A character that no single-character piece covers costs the least score minus 10
and counts as its UTF-8 bytes (byte fallback) or as one piece together with its unknown neighbours.

No piece has the blank mark after another character, so every best path has a piece border before each run of blanks:
words are solved one by one and remembered. Where a vocabulary breaks that rule, whole texts are solved instead.

The counts are those of a unigram model with the vocabulary's scores, whatever model the file itself is of: the default file
is a BPE, whose own tokenizer splits otherwise.

Null and empty texts have no tokens. Repeated rows are counted one by one; an empty table gives no rows.
"""

from __future__ import annotations

import functools
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.llm.common import Memo, numbered_words, parts_of, table

MARK = "▁"


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def pieces_of(path: str) -> dict[str, float]:
    """Normal pieces of a sentencepiece model file and their scores."""
    from sentencepiece import SentencePieceProcessor

    m = SentencePieceProcessor(model_file=path)
    special = [m.is_control, m.is_unknown, m.is_byte, m.is_unused]
    return {m.id_to_piece(i): m.get_score(i) for i in range(m.get_piece_size()) if not any(f(i) for f in special)}


class Counter:
    """Best score and piece count of texts under a unigram vocabulary."""

    def __init__(self, pieces: dict[str, float], byte_fallback: bool = True, dummy_prefix: bool = True):
        import ahocorasick

        self.found = ahocorasick.Automaton()
        for piece, score in pieces.items():
            self.found.add_word(piece, (len(piece), score))
        self.found.make_automaton()
        self.single = {p for p in pieces if len(p) == 1}
        self.unknown = min(pieces.values(), default=0.0) - 10.0
        self.bytes, self.prefix = byte_fallback, MARK if dummy_prefix else ""
        self.by_word = not any(MARK in p.lstrip(MARK) for p in pieces)
        self.memo = Memo(self._packed, 60_000_000)

    def _packed(self, word: str) -> bytes:
        score, count = self.solve(word)
        return np.array([score, count]).tobytes()

    def solve(self, text: str) -> tuple[float, int]:
        """Viterbi over one normalised text: (score, pieces)."""
        n = len(text)
        best: list[float | None] = [0.0] + [None] * n
        count, open_run = [0] * (n + 1), [False] * (n + 1)
        if self.single.issuperset(text):  # matches come by end, and the longest first
            for end, (length, score) in self.found.iter(text):
                if (before := best[end + 1 - length]) is not None:
                    old = best[end + 1]
                    if old is None or before + score > old:
                        best[end + 1], count[end + 1] = before + score, count[end + 1 - length] + 1
            return best[n] or 0.0, count[n]
        ends: list[list] = [[] for _ in range(n)]
        for end, value in self.found.iter(text):
            ends[end].append(value)
        single = self.single
        for end in range(n):
            top, pieces, unknown = None, 0, False
            if text[end] not in single and (before := best[end]) is not None:
                # The one-character candidate starts last: only a strictly better score would let it win.
                lone = (before + self.unknown, end)
            else:
                lone = None
            for length, score in sorted(ends[end], reverse=True):
                start = end + 1 - length
                if (before := best[start]) is not None and (top is None or before + score > top):
                    top, pieces = before + score, count[start] + 1
            if lone and (top is None or lone[0] > top):
                top, unknown = lone[0], True
                if self.bytes:
                    pieces = count[end] + len(text[end].encode("utf-8", "surrogatepass"))
                else:
                    pieces = count[end] + (not open_run[end])
            best[end + 1], count[end + 1], open_run[end + 1] = top, pieces, unknown
        return best[n] or 0.0, count[n]

    def _words(self, text: str) -> list[str]:
        """Parts of a raw text that are solved apart: each a run of blank marks and what follows it."""
        whole = self.prefix + text.replace(" ", MARK)
        if not text:
            return []
        # A run of unknown characters is one piece without byte fallback: it must not be parted.
        return _WORDS.findall(whole) if self.by_word and (self.bytes or MARK in self.single) else [whole]

    def _marked(self, text: str) -> str | None:
        odd = "  " in text or MARK in text or "\0" in text or text[0] == " " or not (self.by_word and self.bytes and self.prefix)
        return None if odd else MARK + text.replace(" ", f"\0{MARK}")

    def counts(self, texts: list[str]) -> tuple[list[float], list[int]]:
        """Best scores and piece counts of raw texts."""
        scores, pieces = [], []
        for words, number, borders, odd in numbered_words(texts, self._marked, self._words):
            found = np.frombuffer(b"".join(map(self.memo.__getitem__, words))).reshape(-1, 2)
            sums = np.vstack([np.zeros(2), found[number].cumsum(axis=0)]) if len(number) else np.zeros((1, 2))
            for i, (a, b) in enumerate(zip(borders[:-1].tolist(), borders[1:].tolist(), strict=True)):
                if i in odd:
                    own = np.frombuffer(b"".join(map(self.memo.__getitem__, odd[i]))).reshape(-1, 2).sum(axis=0)
                else:
                    own = sums[b] - sums[a] if sums[-1, 0] > -(2.0**52) else found[number[a:b]].sum(axis=0)
                scores.append(float(own[0]))
                pieces.append(int(own[1]))
        return scores, pieces


_WORDS = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")


@functools.lru_cache(maxsize=2)
def _made(path: str) -> Counter:
    return Counter(pieces_of(path))


def counter(path: str) -> Counter:
    """A worker's counter for a vocabulary."""
    found = _made(path)
    Memo.begin(found.memo)
    return found


def token_counts(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None
) -> DataFrame:
    """One row for each document: its id, ``n_tokens`` and the best path's ``score``. One pass, no shuffle."""
    path = vocabulary or default_vocabulary()

    def solve(batches):
        own = counter(path)
        for batch in batches:
            for part, items in parts_of(batch, "text", 3_000_000):
                scores, pieces = own.counts(items)
                found = [part.column(0), pa.array(pieces, pa.int64()), pa.array(scores, pa.float64())]
                yield pa.record_batch(found, ["doc_id", "n_tokens", "score"])

    kept = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return kept.mapInArrow(solve, "doc_id long, n_tokens long, score double")


def op1_token_counts(spark, sf_dir):
    return token_counts(table(spark, sf_dir, "documents"))
