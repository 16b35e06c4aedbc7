"""Words of a text such that a tokenizer's ids of the text are those of its words in a row.

The tokenizer drops white space and never looks across it, and it starts anew at an ASCII
character that is no letter after a letter. So a text may be cut at white space, and after a run of
letters before such a character, without changing an id; the tokenizer itself encodes the words.
Only blank, tab, line feed and carriage return count as white space here; a word may hold rarer
kinds. U+0130 is no letter here because its lower case ends in a combining mark.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterable, Iterator

import numpy as np

WORD = re.compile(
    r"[A-Za-zÀ-ÖØ-öø-įı-ſ]++(?=[!-@\[-`{-~])|[^ \t\n\r]+"
)

#: A word that is one pre-token, so that only its last piece ends a word.
PLAIN = re.compile(r"[A-Za-zÀ-ÖØ-öø-įı-ſ]+").fullmatch

#: Words and letters that a process remembers at most, in each of two generations. When the younger
#: one is full it becomes the older, and words that are met again move back.
REMEMBERED = 400_000
LETTERS = 8_000_000
#: Plain words that are encoded in one call, apart by blanks.
TOGETHER = 256
#: Letters of text whose new words are encoded together.
AT_ONCE = 200_000

_loaded: dict[str, "Words"] = {}


class Words:
    """Ids of words, as little-endian unsigned 32-bit integers, remembered within bounds."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.letters = 0
        suffix = getattr(self.tokenizer.model, "end_of_word_suffix", None)
        pieces = self.pieces()
        #: Pieces by id, for tasks that look up many; ids without a piece have an empty one.
        self.spelled = [pieces.get(i, "") for i in range(max(pieces, default=0) + 1)]
        self.ends = np.zeros(len(self.spelled), bool)
        if suffix:
            self.ends[[i for i, piece in pieces.items() if piece.endswith(suffix)]] = True
        self.joins = bool(suffix)

    def encode(self, words: list[str], kind: str = "<u4") -> list[bytes]:
        """The ids of each word.

        Plain words go to the tokenizer many at a time, and the pieces that end a word tell them
        apart; where these are not as many as the words, each word goes alone.
        """
        found: dict[str, bytes] = {}
        plain = [w for w in words if PLAIN(w)] if self.joins else []
        groups = [plain[at : at + TOGETHER] for at in range(0, len(plain), TOGETHER)]
        joined = self.tokenizer.encode_batch_fast([" ".join(g) for g in groups], add_special_tokens=False)
        for group, x in zip(groups, joined, strict=True):
            ids = np.array(x.ids, kind)
            ends = (np.flatnonzero(self.ends[ids]) + 1) * ids.itemsize
            if len(ends) == len(group):
                raw, at = ids.tobytes(), 0
                for w, end in zip(group, ends.tolist(), strict=True):
                    found[w] = raw[at:end]
                    at = end
        alone = [w for w in words if w not in found]
        for w, x in zip(alone, self.tokenizer.encode_batch_fast(alone, add_special_tokens=False), strict=True):
            found[w] = np.array(x.ids, kind).tobytes()
        return [found[w] for w in words]

    def narrow(self) -> str:
        """The smallest integers that hold every id."""
        return "<u2" if len(self.spelled) <= 1 << 16 else "<u4"

    def ids(self, text: str) -> bytes:
        """The ids of a whole text."""
        return next(self.each([text]))

    def each(self, texts: Iterable[str]) -> Iterator[bytes]:
        """The ids of each whole text; new words of ``AT_ONCE`` letters of text are encoded together."""
        waiting: list[list[str]] = []
        letters = 0
        for text in texts:
            waiting.append(WORD.findall(text))
            letters += len(text)
            if letters > AT_ONCE:
                yield from self._ids(waiting)
                waiting, letters = [], 0
        yield from self._ids(waiting)

    def _ids(self, split: list[list[str]]) -> list[bytes]:
        parts = set().union(*split)
        new = parts.difference(self.known)
        if new:
            if len(self.known) > REMEMBERED or self.letters > LETTERS:
                self.known, self.older, self.letters = {}, self.known, 0
                new = parts
            self._learn(new)
        return [b"".join(map(self.known.__getitem__, p)) for p in split]

    def _learn(self, new: set[str]) -> None:
        """Remember the ids of words; chunks are not remembered, they hold the same words in many ways."""
        known, older = self.known, self.older
        words = [w for w in new if w not in older]
        known.update((w, older[w]) for w in new if w in older)
        known.update(zip(words, self.encode(words), strict=True))
        self.letters += sum(map(len, new))

    def pieces(self) -> dict[int, str]:
        """The id-to-piece table of the vocabulary, added tokens included."""
        return {i: piece for piece, i in self.tokenizer.get_vocab(with_added_tokens=True).items()}


def words_of(path: str) -> Words:
    """One instance per process and file."""
    if path not in _loaded:
        _loaded[path] = Words(path)
    return _loaded[path]


def chunks(text: str) -> list[str]:
    """What stands between white space."""
    for blank in "\t\n\r":
        text = text.replace(blank, " ")
    return [c for c in text.split(" ") if c]


def cut(chunk: str) -> list[str]:
    """The words of a chunk, one or two."""
    return WORD.findall(chunk)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")
