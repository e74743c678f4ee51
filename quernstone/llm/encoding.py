"""Encoding of a corpus with a public byte-level BPE tokenizer, as a monoid tree reduction.

A text is cut into leaves that are encoded on their own; two neighbours are joined by encoding a
window around their seam again and growing it until it provably no longer matters:

* The pre-tokenizer is a left-to-right scanner whose next piece depends only on the text from the
  current position on. So from any position at which two scans both start a piece, they agree for
  ever after.
* It looks at most a few characters past a piece's end, and those lie within the next two pieces.
  So all pieces of the left part but its last two stay as they are, whatever follows.

The join therefore starts three pieces before the seam, and stops at the first position where the
scan of the joined text and the right part's own scan start a piece together. If there is none
(one endless run of letters, say), the window grows to the whole right part. The join is
associative, so any shape of tree gives the ids of the whole text.

Null and empty texts have the ids ``[]``. Special tokens' strings are ordinary text.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

TOKENIZERS = "/opt/tokenizers"
EDGE = 3  # pieces before a seam that are scanned again
LEAF = 4096  # characters of a leaf


@dataclass
class Part:
    """Ids of text[start:end], and the starts of its last pieces."""

    start: int
    end: int
    ids: list[int]
    tail: list[int]


class Encoder:
    def __init__(self, file: str, leaf: int = LEAF):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(file)
        self.tokenizer.encode_special_tokens = True
        self.leaf = leaf

    def plain(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def starts(self, text: str, shift: int) -> list[int]:
        """Where the scanner starts a piece, and the end of the text."""
        return [a + shift for _, (a, _) in self.tokenizer.pre_tokenizer.pre_tokenize_str(text)] + [shift + len(text)]

    def leaf_part(self, text: str, start: int, end: int) -> Part:
        own = text[start:end]
        return Part(start, end, self.plain([own])[0], self.starts(own, start)[:-1][-EDGE:] or [start])

    def join(self, text: str, left: Part, right: Part) -> Part:
        if left.start == left.end or right.start == right.end:
            return right if left.start == left.end else left
        at = left.tail[0]
        width = 64
        while True:
            stop = min(right.end, right.start + width)
            ours, theirs = self.starts(text[at:stop], at), self.starts(text[right.start : stop], right.start)
            whole = stop == right.end
            # near a cut-off end the scan isn't settled
            settled = ours if whole else ours[: -EDGE - 1]
            common = set(theirs if whole else theirs[: -EDGE - 1])
            meet = next((p for p in settled if p >= right.start and p in common), None)
            if meet is not None:
                break
            width *= 4
        # by pieces: cut off at meet, the scanner could take two pieces of white space for one
        middle, skip = self.pieces(text, ours, meet), self.pieces(text, theirs, meet)
        drop = self.plain([text[at : left.end]])[0]
        left.ids[len(left.ids) - len(drop) :] = middle
        left.ids.extend(right.ids[len(skip) :])
        tail = [*(p for p in left.tail if p <= at), *(p for p in ours if at < p < meet), *(p for p in (*ours, *right.tail) if p >= meet and p < right.end and p in {*right.tail})]
        return Part(left.start, right.end, left.ids, sorted(set(tail))[-EDGE:])

    def pieces(self, text: str, starts: list[int], end: int) -> list[int]:
        """Ids of the scanned pieces before ``end``, each encoded on its own."""
        cuts = [p for p in starts if p <= end]
        return [i for ids in self.plain([text[a:b] for a, b in zip(cuts, cuts[1:])]) for i in ids] if len(cuts) > 1 else []

    def tree(self, text: str, start: int, end: int) -> Part:
        if end - start <= self.leaf:
            return self.leaf_part(text, start, end)
        half = (start + end) // 2
        return self.join(text, self.tree(text, start, half), self.tree(text, half, end))

    def encode(self, text: str | None) -> list[int]:
        return self.tree(text, 0, len(text)).ids if text else []

    def encode_all(self, texts: list[str | None]) -> list[list[int]]:
        """Texts of one leaf go to the tokenizer together; longer ones through the tree."""
        out: list[list[int]] = [[] for _ in texts]
        short = [i for i, t in enumerate(texts) if t and len(t) <= self.leaf]
        for k in range(0, len(short), 128):
            part = short[k : k + 128]
            for i, ids in zip(part, self.plain([texts[i] for i in part])):
                out[i] = ids
        for i, t in enumerate(texts):
            if t and len(t) > self.leaf:
                out[i] = self.encode(t)
        return out

    def decode(self, ids: list[int]) -> str:
        """Decoding is the concatenation of the tokens' bytes, so it needs no seam."""
        if len(ids) <= 4096:
            return self.raw(ids).decode("utf-8", errors="replace")
        half = len(ids) // 2
        return (self.join_bytes(ids[:half]) + self.join_bytes(ids[half:])).decode("utf-8", errors="replace")

    def join_bytes(self, ids: list[int]) -> bytes:
        if len(ids) <= 4096:
            return self.raw(ids)
        half = len(ids) // 2
        return self.join_bytes(ids[:half]) + self.join_bytes(ids[half:])

    def raw(self, ids: list[int]) -> bytes:
        table = byte_table()
        return bytes(table[c] for i in ids for c in self.tokenizer.id_to_token(i))


def byte_table() -> dict[str, int]:
    """The byte each character of a byte-level vocabulary stands for: printable Latin-1 stands for itself, the rest counts up from 256."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(rest)}


_encoders: dict[tuple[str, int], Encoder] = {}


def encoder(file: str, leaf: int = LEAF) -> Encoder:
    """One per worker process: loading a vocabulary costs more than encoding a batch."""
    if (file, leaf) not in _encoders:
        _encoders[file, leaf] = Encoder(file, leaf)
    return _encoders[file, leaf]


def encode_corpus(docs: DataFrame, key: str = "doc_id", text: str = "text", tokenizer: str = "byte_bpe_50k.json", folder: str = TOKENIZERS, leaf: int = LEAF, counts_only: bool = False) -> DataFrame:
    """(key, ids), or (key, n_tokens): one map-only pass over the two columns it needs.

    Rows are independent; nothing is shuffled. Repeated rows come out repeated. Columns other
    than ``key`` and ``text`` are not read, so their names can't clash.
    """
    file = f"{folder}/{tokenizer}"
    small = docs.select(F.col(key), F.col(text).alias("__text"))
    last = T.StructField("n_tokens", T.IntegerType()) if counts_only else T.StructField("ids", T.ArrayType(T.IntegerType()))
    schema = T.StructType([T.StructField(key, small.schema[0].dataType), last])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(file, leaf)
        for batch in batches:
            for k in range(0, batch.num_rows, 512):
                piece = batch.slice(k, 512)
                ids = enc.encode_all(piece.column(1).to_pylist())
                made = pa.array([len(x) for x in ids], pa.int32()) if counts_only else pa.array(ids, pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([piece.column(0), made], names=[key, last.name])

    return small.mapInArrow(run, schema)



def ids(spark, sf_dir: str) -> DataFrame:
    """p8_ids: doc_id and token ids of every document."""
    return encode_corpus(spark.read.parquet(f"{sf_dir}/documents.parquet"))
