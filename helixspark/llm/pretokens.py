"""Pre-tokens of byte-level BPE and dictionaries of them."""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Callable, Iterator
from operator import itemgetter

import numpy as np
import public_tokenizers
import regex

#: The characters with the Unicode property White_Space, which is what \s means to the tokenizer libraries.
WHITE_SPACE = "\t-\r \x85\xa0  -     　"

#: Where the classes of _PLAIN end.
_ODD = re.compile("[\u0250-\U0010ffff]")
# \p{L}, \p{N} and White_Space below U+0250, written out: a table lookup a character; of alternatives that begin differently, the most frequent first
_LETTERS, _NUMBERS, _SPACES = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\u024f", "0-9\xb2\xb3\xb9\xbc-\xbe", "\t-\r \x85\xa0"
_PLAIN = re.compile(rf" [{_LETTERS}]+|[{_LETTERS}]+| ?[{_NUMBERS}]+|'(?:[stmd]|re|ve|ll)| ?[^{_SPACES}{_LETTERS}{_NUMBERS}]+|[{_SPACES}]+(?![^{_SPACES}])|[{_SPACES}]+")


def splitter(pattern: str = public_tokenizers.PATTERN) -> Callable[[str], list[str]]:
    """A function from a text to its pre-tokens, which joined give the text."""
    exact = regex.compile(pattern.replace(r"[^\s", "[^" + WHITE_SPACE).replace(r"\s", f"[{WHITE_SPACE}]").replace(r"\S", f"[^{WHITE_SPACE}]"))
    if pattern != public_tokenizers.PATTERN:
        return exact.findall
    return lambda text: _PLAIN.findall(text) if text.isascii() or not _ODD.search(text) else exact.findall(text)


#: A single space between two other characters always begins a pre-token, so a long text may be cut there.
_CUT = re.compile(r"(?<=[^\s\x1c-\x1f])(?= [^\s\x1c-\x1f])")


def pieces(text: str, size: int = 1 << 20) -> Iterator[str]:
    """A text in pieces of about ``size`` characters whose pre-tokens are those of the text."""
    at = 0
    while len(text) - at > size and (cut := _CUT.search(text, at + size)):
        yield text[at : cut.start()]
        at = cut.start()
    yield text[at:] if at else text


class Numbering(defaultdict):
    """Numbers words by first appearance."""

    def __init__(self):
        super().__init__()
        self.default_factory = self.__len__

    def of(self, text: str, split: Callable[[str], list[str]]) -> np.ndarray:
        found = [np.zeros(0, np.uint32)]
        for piece in pieces(text):
            words = split(piece)
            if len(words) > 1:  # all in one call; of one word itemgetter gives no tuple
                found.append(np.fromiter(itemgetter(*words)(self), np.uint32, len(words)))
            elif words:
                found.append(np.array([self[words[0]]], np.uint32))
        return np.concatenate(found) if len(found) > 2 else found[-1]


def gather(flat: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """flat[s:s+n] for each start and length, one after another."""
    ends = np.cumsum(lengths, dtype=np.int64)
    total = int(ends[-1]) if len(ends) else 0
    return flat[np.repeat(starts - (ends - lengths), lengths) + np.arange(total)]


def offsets(lengths: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(lengths, dtype=np.int64)[:-1]]) if len(lengths) else np.zeros(0, np.int64)
