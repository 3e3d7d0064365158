"""Token ids of whole texts by a monoid of encoded pieces, reduced as a tree.

An element is a text with its ids; two neighbours are joined by encoding anew a window around their boundary. The
window grows on both sides until it ends where a letter, digit or mark of ASCII meets a blank. No word of the
tokenizer's pre-tokenization reaches across such a place, whatever stands around it, so the tokens outside the window
are those of the joined text. Joining is therefore associative, and a text of any length is encoded by halves.
Decoding is the other monoid of the tree: the bytes of two halves of the ids are concatenated on the way up.
"""

from __future__ import annotations

import base64
import os
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import tiktoken
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserine.session import spread

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the pre-tokenization pattern of the vocabulary.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
LEAF = 8192
WINDOW = 64
_PLACE = re.compile(r"[!-~][ \n]")


@lru_cache(maxsize=4)
def _encoding(path: str) -> tuple[tiktoken.Encoding, dict[int, int]]:
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}), {i: len(b) for b, i in ranks.items()}


class Encoder:
    """Encodes texts with a byte-level vocabulary file; strings that look like special tokens are ordinary text."""

    def __init__(self, path: str = VOCABULARY, leaf: int = LEAF, window: int = WINDOW):
        self.encoding, self.width = _encoding(path)
        self.leaf, self.window = max(leaf, 1), max(window, 1)

    def join(self, a: tuple[str, list[int]], b: tuple[str, list[int]]) -> tuple[str, list[int]]:
        (x, left), (y, right) = a, b
        if not x or not y:
            return b if not x else a
        n = self.window
        while True:
            from_ = max(0, len(x) - n)
            cuts = [m.start() + 1 for m in _PLACE.finditer(x, from_)]
            if cuts or not from_:
                break
            n *= 2
        cut = cuts[-1] if cuts else 0
        n = self.window
        while True:
            m = _PLACE.search(y, 0, n)
            if m or n >= len(y):
                break
            n *= 2
        end = m.start() + 1 if m else len(y)
        keep = self._tokens(reversed(left), len(x[cut:].encode("utf-8", "surrogatepass")))
        skip = self._tokens(right, len(y[:end].encode("utf-8", "surrogatepass")))
        return x + y, left[: len(left) - keep] + self.encoding.encode_ordinary(x[cut:] + y[:end]) + right[skip:]

    def _tokens(self, ids, size: int) -> int:
        """How many of the ids make up so many bytes."""
        n = 0
        for i in ids:
            if size <= 0:
                break
            size -= self.width[i]
            n += 1
        return n

    def element(self, text: str) -> tuple[str, list[int]]:
        if len(text) <= self.leaf:
            return text, self.encoding.encode_ordinary(text)
        half = len(text) // 2
        return self.join(self.element(text[:half]), self.element(text[half:]))

    def encode(self, text: str | None) -> list[int]:
        return self.element(text)[1] if text else []


    def bytes_of(self, ids: list[int]) -> bytes:
        if len(ids) <= self.leaf:
            return b"".join(map(self.encoding.decode_single_token_bytes, ids))
        half = len(ids) // 2
        return self.bytes_of(ids[:half]) + self.bytes_of(ids[half:])

    def decode(self, ids: list[int] | None) -> str:
        """The text of the ids; a character is only read from its whole bytes, those that make up none become U+FFFD."""
        return self.bytes_of(ids).decode("utf-8", "replace") if ids else ""


def local_path(path: str) -> str:
    """Where this worker finds the vocabulary: shipped with ``SparkContext.addFile``, or under the path itself."""
    try:
        shipped = SparkFiles.get(os.path.basename(path))
    except Exception:  # outside of Spark
        return path
    return shipped if os.path.exists(shipped) else path


def token_ids(df: DataFrame, id_col: str, text: str, path: str = VOCABULARY, leaf: int = LEAF) -> DataFrame:
    """``(id_col, ids)`` of each row, repeated rows too; null and empty texts give an empty list, blank ones their ids.

    ``path`` is the vocabulary on the driver; it is shipped to the executors and read by each Python worker once. There is no shuffle of any but small tables; a row's text goes whole through one task.
    """

    df.sparkSession.sparkContext.addFile(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(local_path(path), leaf)
        for b in batches:
            ids = [encoder.encode(t) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ids, pa.list_(pa.int32()))], names=[id_col, "ids"])

    kind = dict(df.select(id_col).dtypes)[id_col]
    return spread(df.select(F.col(id_col), F.col(text))).mapInArrow(run, f"`{id_col}` {kind}, ids array<int>")


def decoded_texts(df: DataFrame, id_col: str, ids: str = "ids", path: str = VOCABULARY, leaf: int = LEAF) -> DataFrame:
    """``(id_col, text)`` of each row of token ids; null and empty lists give an empty text, repeated rows come again.

    Ids outside the vocabulary are an error. No shuffle of any but small tables.
    """
    df.sparkSession.sparkContext.addFile(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(local_path(path), leaf)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([encoder.decode(x) for x in b.column(1).to_pylist()], pa.string())], names=[id_col, "text"])

    kind = dict(df.select(id_col).dtypes)[id_col]
    return spread(df.select(F.col(id_col), F.col(ids))).mapInArrow(run, f"`{id_col}` {kind}, text string")
