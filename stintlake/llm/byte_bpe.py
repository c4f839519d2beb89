"""Byte-level BPE encoding and decoding by prefix dynamic programming.

For every prefix of a piece there is exactly one token that can end its encoding: the token t over the last bytes for
which the shorter prefix's own last token and t stay apart when their bytes are encoded together. ``PrefixTable`` stores
that token for each prefix. Appending bytes extends the table, and after an edit only the entries near it are computed
again, until the table agrees with the old one over the length of the longest token.

Texts are cut by the pre-tokenizer's pattern first; every match is encoded separately. Decoding joins the tokens' bytes.

Defined results: a null text counts as empty (no ids, digests of no bytes); rows with null or repeated ids are kept as
they are; texts of any length are encoded whole.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from stintlake.llm.common import released, table
from stintlake.llm.kept import Kept, held

#: White space as Unicode defines it (fixed values).
SPACE = "\t\n\x0b\x0c\r \x85\xa0  -     　"
#: Runs that the pattern never joins: a word with one space before it, or white space up to it.
RUNS = re.compile(f" ?[^{SPACE}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+")
#: Patterns that never join a word to anything but one space before it (fixed value); with others, texts are matched whole.
APART = (
    r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+""",
)
#: Bytes of the runs, the pieces and the pairs of tokens that a worker keeps, each in two generations.
RUN_BYTES, PIECE_BYTES, PAIRS = 60 << 20, 50 << 20, 2_000_000


class Ranks:
    """A rank file: tokens, their bytes, and which pair of tokens each was merged from."""

    def __init__(self, path: str):
        with open(path, "rb") as lines:
            self.ids = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.bytes = [b""] * (max(self.ids.values(), default=-1) + 1)
        for token, i in self.ids.items():
            self.bytes[i] = token
        self.longest = max(map(len, self.ids), default=0)
        self.parts: dict[int, tuple[int, int]] = {}
        for token, i in self.ids.items():
            if len(token) > 1 and len(made := self.merged(token, i)) == 2:
                self.parts[i] = (made[0], made[1])
        #: The tokens that merges can make; any other stands for a whole piece only.
        self.usable = {token: i for token, i in self.ids.items() if len(token) == 1 or i in self.parts}
        self.apart: dict[int, bool] = {}

    def merged(self, piece: bytes, below: int) -> list[int]:
        """The piece after all merges into tokens of a rank under ``below``."""
        ids = [self.ids[piece[i : i + 1]] for i in range(len(piece))]
        words = [piece[i : i + 1] for i in range(len(piece))]
        while len(ids) > 1:
            rank, at = min((self.ids.get(words[i] + words[i + 1], below), i) for i in range(len(ids) - 1))
            if rank >= below:
                break
            words[at : at + 2], ids[at : at + 2] = [words[at] + words[at + 1]], [rank]
        return ids

    def stay_apart(self, a: int, b: int) -> bool:
        """Whether a and b side by side are the encoding of their joined bytes.

        Undoes the merges of both from the latest back: the tokens that then touch would have merged into one of a lower
        rank than the step undone, or not. On equal ranks the left merge comes first.
        """
        left, right, before, ok = a, b, float("inf"), True
        while True:
            joined = self.ids.get(self.bytes[left] + self.bytes[right])
            if joined is not None and joined < before:
                ok = False
                break
            can_left, can_right = left in self.parts, right in self.parts
            if not can_left and not can_right:
                break
            if can_left and (left > right or not can_right):
                before, left = left, self.parts[left][1]
            else:
                before, right = right + 1, self.parts[right][0]
        if len(self.apart) > PAIRS:  # of about 100 bytes
            self.apart.clear()
        self.apart[a << 32 | b] = ok
        return ok


class PrefixTable:
    """The last token of every byte prefix of one piece."""

    def __init__(self, ranks: Ranks, piece: bytes = b""):
        self.ranks, self.piece, self.last = ranks, b"", []
        self.append(piece)

    def append(self, more: bytes) -> None:
        self.piece += more
        self._fill(len(self.piece))

    def _fill(self, stop: int) -> None:
        """The one valid last token of each prefix up to length ``stop``, from those of the shorter prefixes."""
        ranks, piece, last = self.ranks, self.piece, self.last
        token_of, apart, longest = ranks.usable.get, ranks.apart, ranks.longest
        for end in range(len(last) + 1, stop + 1):
            for start in range(end - longest if end > longest else 0, end):
                token = token_of(piece[start:end])
                if token is None:
                    continue
                if not start:
                    break
                before = last[start - 1]
                if (known := apart.get(before << 32 | token)) or known is None and ranks.stay_apart(before, token):
                    break
            else:
                raise ValueError("a byte is missing from the ranks")
            last.append(token)

    def replace(self, start: int, stop: int, by: bytes) -> None:
        """Put ``by`` for the bytes from start to stop; computes only what may change."""
        old, shift = self.last, len(by) - (stop - start)
        self.piece = self.piece[:start] + by + self.piece[stop:]
        self.last, same = old[:start], 0
        while len(self.last) < len(self.piece):
            end = len(self.last) + 1
            self._fill(end)
            same = same + 1 if end > start + len(by) and self.last[-1] == old[end - shift - 1] else 0
            if same >= self.ranks.longest:
                self.last += old[end - shift :]

    def ids(self) -> list[int]:
        out, end = [], len(self.last)
        while end:
            out.append(self.last[end - 1])
            end -= len(self.ranks.bytes[out[-1]])
        return out[::-1]


class Encoder:
    """Whole texts to ids (as little-endian unsigned 32-bit integers) and back."""

    def __init__(self, path: str, pattern: str):
        self.ranks, self.pieces, self.apart = Ranks(path), regex.compile(pattern), pattern in APART
        self.kept, self.known = Kept(self.run, RUN_BYTES), Kept(self.piece, PIECE_BYTES)
        self.packed = [i.to_bytes(4, "little") for i in range(len(self.ranks.bytes))]

    def piece(self, piece: str) -> bytes:
        raw = piece.encode()
        token = self.ranks.ids.get(raw)
        ids = [token] if token is not None else PrefixTable(self.ranks, raw).ids()
        return b"".join([self.packed[i] for i in ids])

    def run(self, run: str) -> bytes:
        return b"".join(map(self.known.__getitem__, self.pieces.findall(run)))

    def encode(self, text: str) -> bytes:
        return b"".join(map(self.kept.__getitem__, RUNS.findall(text))) if self.apart else self.run(text)

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.ranks.bytes.__getitem__, np.frombuffer(ids, dtype="<u4").tolist()))


def encoder(path: str, pattern: str) -> Encoder:
    """The process's encoder."""
    return held((path, pattern), lambda: Encoder(path, pattern))


def encode_decode(docs: DataFrame, ranks_path: str, pattern: str, digests: bool = True) -> DataFrame:
    """``doc_id, n_tokens, ids`` of each row of ``doc_id, text``; with digests, their hashes in place of the ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(ranks_path, pattern)
        for batch in released(batches):
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                ids = [enc.encode(text or "") for text in part.column(1).to_pylist()]
                counts = pa.array([len(x) // 4 for x in ids], pa.int64())
                if digests:
                    sums = [hashlib.sha256(x).hexdigest() for x in ids], [hashlib.sha256(enc.decode(x)).hexdigest() for x in ids]
                    yield pa.RecordBatch.from_arrays([part.column(0), counts, pa.array(sums[0]), pa.array(sums[1])], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
                else:
                    yield pa.RecordBatch.from_arrays([part.column(0), counts, pa.array([np.frombuffer(x, dtype="<u4").astype(np.int32) for x in ids], pa.list_(pa.int32()))], names=["doc_id", "n_tokens", "ids"])

    kind = "ids_sha256 string, decoded_sha256 string" if digests else "ids array<int>"
    return docs.select(docs["doc_id"].cast("long"), docs["text"].cast("string")).mapInArrow(run, f"doc_id long, n_tokens long, {kind}")


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole document encoded by the multilingual byte-level ranks, and decoded again."""
    import public_tokenizers

    return encode_decode(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
