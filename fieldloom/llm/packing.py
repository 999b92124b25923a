"""Operator 2: packing by concatenate and cut.

All documents are laid end to end, each closed by an end id, and the line is cut into windows
of ``length`` ids. First pass: each task turns its rows into ids, written to the shared folder
with each document's place inside its task's block. The blocks' totals, summed in order, give
the global offsets (the second prefix sum). Second pass: each document is cut where a window
ends; the pieces at a cut are the boundary records. Only the last window may be short.

Cost: one pass over the text and one over the ids, no shuffle of either; the totals are one
row for each task of the first pass.

Cases: null and empty texts are the end id alone; a text longer than a window becomes many
pieces; repeated rows are packed each; an empty table gives no pieces; other columns are not
read. The order of the line is that of the tasks that read the table.
"""

from __future__ import annotations

import json
import sys
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fieldloom.llm.common import lean, save, slices
from fieldloom.llm.token_count import byte_symbols

#: Entries of a worker's table of words and their ids and of that of words' parts, and the longest word kept there.
KEPT, KEPT_PARTS, KEPT_LENGTH = 500_000, 100_000, 64
#: Blocks up to which their offsets are sent to every executor (16 bytes each).
SENT_BLOCKS = 200_000
ID_TYPE = "I"  # four bytes wherever Spark runs; little-endian is made sure of below
assert array(ID_TYPE).itemsize == 4 and sys.byteorder == "little"
#: Words of these characters are normal as they are, and lowered letter by letter.
PLAIN = regex.compile(r"[\x21-\x7e\xa1-\u012f\u0131-\u017f]+")
CONTROLS = [chr(c) for c in range(0x1C, 0x20)]


class WordIds(dict):
    """Ids of texts under a vocabulary that never joins characters across white space: each
    word's ids are looked up in this table, and the library is asked for those not there."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        super().__init__()
        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            pattern = json.load(f)["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.cut = regex.compile(pattern).findall
        self.shown = byte_symbols()
        self.parts: dict[str, bytes] = {}

    def whole(self, text: str) -> bytes:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def word(self, word: str) -> bytes:
        """Ids of one word. Where normalising is lowering letter by letter, the word is cut by the
        file's own pattern and its parts, of which most are known, go to the library's model."""
        if not word.isascii() and PLAIN.fullmatch(word) is None or len(word) > KEPT_LENGTH or "<|" in word:
            return self.whole(word)
        low = word.lower()
        if low.isalpha():
            return self.part(low)
        if low[-1] in ".,!?;:" and low[:-1].isalpha():
            return self.part(low[:-1]) + self.part(low[-1])
        return b"".join(map(self.part, self.cut(low)))

    def part(self, part: str) -> bytes:
        if (ids := self.parts.get(part)) is None:
            shown = "".join([self.shown[b] for b in part.encode("utf-8")])
            ids = array(ID_TYPE, [t.id for t in self.library.model.tokenize(shown)]).tobytes()
            if len(self.parts) >= KEPT_PARTS:
                self.parts.clear()
            self.parts[part] = ids
        return ids

    def __missing__(self, word: str) -> bytes:
        ids = self.word(word)
        if len(word) <= KEPT_LENGTH:
            self[word] = ids
        return ids

    def ids(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as unsigned little-endian 32-bit numbers."""
        out = []
        for text in texts:
            if len(self) > KEPT:
                self.clear()
            if any(c in text for c in CONTROLS):  # the library has another view of these four
                out.append(self.whole(text))
            else:
                out.append(b"".join(map(self.__getitem__, text.split())))
        return out


@lru_cache(maxsize=4)
def word_ids(path: str) -> WordIds:
    return WordIds(path)


def encode(docs: DataFrame, vocabulary: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, block, place, n_ids, ids`` of every row; ``ids`` is compressed, ``place`` the ids
    before it in its block."""

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lookup, press, end = word_ids(vocabulary), zstandard.ZstdCompressor(level=1), np.array([end_id], "<u4").tobytes()
        block, place = TaskContext.get().partitionId(), 0
        for batch in batches:
            for begin in range(0, batch.num_rows, 500):
                part = batch.slice(begin, 500)
                all_ids = [x + end for x in lookup.ids([t or "" for t in part.column(1).to_pylist()])]
                n = np.array([len(x) // 4 for x in all_ids], np.int64)
                places = place + np.cumsum(n) - n
                place += int(n.sum())
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([block] * len(n), pa.int64()), pa.array(places), pa.array(n), pa.array([press.compress(x) for x in all_ids], pa.binary())],
                    ["doc_id", "block", "place", "n_ids", "ids"],
                )

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(lean(encoded), f"doc_id {kind}, block long, place long, n_ids long, ids binary")


def pieces(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """The pieces of the rows ``doc_id, begin, n_ids, ids``, in steps of some bytes of ids."""
    unpress = zstandard.ZstdDecompressor()
    for batch in (part for whole in batches for part in slices(whole, sizes=4 * whole.column(2).to_numpy())):
        rows = [[] for _ in range(8)]
        for doc, begin, n, ids in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
            ids, at = unpress.decompress(ids), 0
            while at < n:
                sequence, offset = divmod(begin + at, length)
                m = min(n - at, length - offset)
                piece = ids[4 * at : 4 * (at + m)]
                for column, value in zip(rows, (doc, at, m, zlib.crc32(piece), n, sequence, offset, piece), strict=True):
                    column.append(value)
                at += m
        kinds = [batch.schema.field(0).type, *[pa.int64()] * 6, pa.binary()]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(rows, kinds, strict=True)], NAMES)


def pack(docs: DataFrame, vocabulary: str, length: int = 4096, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, ids``;
    ``ids`` holds the piece's ids as little-endian 32-bit numbers."""
    lines = save(encode(docs, vocabulary, end_id, id_col, text_col), "packing-ids")
    totals = lines.groupBy("block").agg(F.sum("n_ids").alias("total"))
    totals = save(totals.select("block", (F.sum("total").over(Window.orderBy("block")) - F.col("total")).alias("base")), "packing-bases")
    if totals.count() <= SENT_BLOCKS:
        totals = F.broadcast(totals)
    placed = lines.join(totals, "block").select("doc_id", (F.col("base") + F.col("place")).alias("begin"), "n_ids", "ids")

    kind = docs.schema[id_col].dataType.simpleString()
    return placed.mapInArrow(lean(lambda batches: pieces(batches, length)), f"doc_id {kind}, " + ", ".join(f"{c} long" for c in NAMES[1:-1]) + ", ids binary")


NAMES = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"]
