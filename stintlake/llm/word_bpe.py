"""Fast exact use of a word-level BPE tokenizer of the tokenizers library.

The tokenizer lower-cases, composes and cuts at white space, so the ids of a text are those of its space-separated words
in turn. A process keeps the ids of the words that it has met, within a bound of bytes. A word of plain Latin characters goes
to the library's merge model directly; any other goes through the library's whole chain of steps.
"""

from __future__ import annotations

import os
import re
from array import array
from functools import lru_cache

from stintlake.llm.kept import Kept, held

#: White space other than space, tab and line ends, and the separators that Python alone takes for white space.
ODD_SPACE = re.compile("[\x0b\x0c\x1c-\x1f\x85\xa0  -     　]")
WORDS = re.compile("[^ \t\n\r]+")
PLAIN = re.compile("[!-~À-ÖØ-öø-ÿ]+")
#: The tokenizer's own cut of a word, for plain characters in lower case.
PIECES = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-zß-öø-ÿ0-9]+")


def byte_alphabet() -> dict[int, str]:
    """The printable character that stands for each byte: itself if printable, else the next from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + n) for n, b in enumerate(hidden)}


class WordBpe:
    """The tokenizer; as large as its vocabulary, so a worker process may hold on to it."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.alphabet = str.maketrans({chr(b): c for b, c in byte_alphabet().items()})
        #: Bytes that an id of the vocabulary needs in a file.
        self.width = 2 if self.whole.get_vocab_size(with_added_tokens=True) <= 1 << 16 else 4

    def encoder(self, width: int = 4) -> Encoder:
        """The process's encoder of this width."""
        return held((id(self), width), lambda: Encoder(self, width))


class Encoder:
    """Texts to ids as little-endian unsigned integers of ``width`` bytes."""

    def __init__(self, bpe: WordBpe, width: int):
        if width < bpe.width:
            raise ValueError("the vocabulary has ids of more bytes")
        self.tokenize, self.whole, self.alphabet = bpe.whole.model.tokenize, bpe.whole, bpe.alphabet
        self.code = {2: "H", 4: "I"}[width]
        self.kept = Kept(self.word)

    def merged(self, piece: str) -> bytes:
        """The ids of a piece in lower case, which the merge model takes byte by byte."""
        if not piece.isascii():
            piece = piece.encode().decode("latin1").translate(self.alphabet)
        return array(self.code, [t.id for t in self.tokenize(piece)]).tobytes()

    def word(self, word: str) -> bytes:
        if not PLAIN.fullmatch(word) or "<|" in word:
            return array(self.code, self.whole.encode(word, add_special_tokens=False).ids).tobytes()
        low = word.lower()
        if low.isalpha():
            return self.merged(low)
        # a word with its signs: the word alone is often known
        return b"".join([self.kept[p] if p.isalpha() else self.merged(p) for p in PIECES.findall(low)])

    def encode(self, text: str) -> bytes:
        """The ids of a whole text."""
        return b"".join(map(self.kept.__getitem__, WORDS.findall(text) if ODD_SPACE.search(text) else text.split()))


@lru_cache(maxsize=4)
def word_bpe(path: str) -> WordBpe:
    """One tokenizer a worker process."""
    return WordBpe(path)
