"""Operator 1: token counts by heap-and-linked-list byte-pair merging.

The symbols of a piece form a linked list; a heap holds the adjacent pairs that the vocabulary
can merge, lowest rank first and leftmost among equals. A popped pair that has changed since is
skipped, any other is merged and its two new neighbours are pushed. The piece's count is its
initial symbols (bytes) less the merges made; identifiers are never put out.

Cost: one pass over the text, no shuffle. Pieces that have been counted are kept in a bounded
table in each Python worker, as most words of a corpus repeat.

Cases: null and empty texts have 0 bytes and 0 tokens; special strings inside a text are one
token each, as the vocabulary's library handles them by default; texts of any length are
counted whole; repeated rows are counted each; columns other than the id and the text are not
read, whatever their names.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The byte-level pre-tokenizer's pattern, and the bytes that its alphabet shows as themselves.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
SHOWN = [*range(33, 127), *range(161, 173), *range(174, 256)]

#: Entries of a worker's table of counted pieces, and the longest piece kept there.
KEPT, KEPT_LENGTH = 400_000, 64


def byte_symbols() -> dict[int, str]:
    """The character that stands for each byte in a byte-level vocabulary."""
    out = {b: chr(b) for b in SHOWN}
    for b in range(256):
        if b not in out:
            out[b] = chr(256 + len(out) - len(SHOWN))
    return out


class PairMerger:
    """Counts tokens under one vocabulary file of merge rules."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        ids = spec["model"]["vocab"]
        self.first = [ids[c] for _, c in sorted(byte_symbols().items())]
        self.rules: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, rule in enumerate(spec["model"]["merges"]):
            left, right = rule.split(" ") if isinstance(rule, str) else rule
            self.rules.setdefault((ids[left], ids[right]), (rank, ids[left + right]))
        special = sorted((t["content"] for t in spec["added_tokens"]), key=len, reverse=True)
        self.special = regex.compile("|".join(map(regex.escape, special))) if special else None
        self.pieces = regex.compile(PIECES)
        # a space before white space or at the end belongs to a longer run: such texts are cut by the pattern alone
        self.odd_space = regex.compile(r" (?=[\s\x1c-\x1f]|$)")
        self.spaced: dict[str, int] = {}
        self.single: dict[str, int] = {}

    def merged(self, piece: str) -> int:
        """Tokens of one piece."""
        ids = [self.first[b] for b in piece.encode("utf-8")]
        n = len(ids)
        after, before = [*range(1, n), -1], [*range(-1, n - 1)]
        rules, merges = self.rules, 0
        heap = []
        for i in range(n - 1):
            if (rule := rules.get((ids[i], ids[i + 1]))) is not None:
                heap.append((rule[0], i, ids[i], ids[i + 1], rule[1]))
        heapq.heapify(heap)
        while heap:
            _, i, left, right, made = heapq.heappop(heap)
            j = after[i]
            if ids[i] != left or j < 0 or ids[j] != right:
                continue
            ids[i], ids[j] = made, -1
            merges += 1
            after[i] = k = after[j]
            if k >= 0:
                before[k] = i
                if (rule := rules.get((made, ids[k]))) is not None:
                    heapq.heappush(heap, (rule[0], i, made, ids[k], rule[1]))
            if (h := before[i]) >= 0 and (rule := rules.get((ids[h], made))) is not None:
                heapq.heappush(heap, (rule[0], h, ids[h], made, rule[1]))
        return n - merges

    def by_pattern(self, text: str) -> int:
        total, single = 0, self.single
        for piece in self.pieces.findall(text):
            if (n := single.get(piece)) is None:
                n = self.merged(piece)
                if len(piece) <= KEPT_LENGTH:
                    if len(single) >= KEPT:
                        single.clear()
                    single[piece] = n
            total += n
        return total

    def plain(self, text: str) -> int:
        """Tokens of a text without special strings. Where each space stands between two other
        characters, the pattern cuts before every space, so each part counts by itself."""
        if not text:
            return 0
        if self.odd_space.search(text):
            return self.by_pattern(text)
        head, *parts = text.split(" ")
        total, spaced = self.by_pattern(head), self.spaced
        for part in parts:
            if (n := spaced.get(part)) is None:
                n = self.by_pattern(" " + part)
                if len(part) <= KEPT_LENGTH:
                    if len(spaced) >= KEPT:
                        spaced.clear()
                    spaced[part] = n
            total += n
        return total

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        if self.special is None:
            return self.plain(text)
        parts = self.special.split(text)
        return sum(map(self.plain, parts)) + len(parts) - 1


@lru_cache(maxsize=4)
def merger(path: str) -> PairMerger:
    return PairMerger(path)


def count_tokens(docs: DataFrame, vocabulary: str, limit: int = 512, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` of every row.

    ``vocabulary``: path of a byte-level pair-merging vocabulary, on every machine.
    """

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = merger(vocabulary).count
        for batch in batches:
            n = pa.array([count(t) for t in batch.column(2).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), n], ["doc_id", "n_bytes", "n_tokens"])

    kind = docs.schema[id_col].dataType.simpleString()
    read = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long").alias("n_bytes"), F.col(text_col).alias("text"))
    return read.mapInArrow(counted, f"doc_id {kind}, n_bytes long, n_tokens long").withColumn("over_limit", F.col("n_tokens") > limit)
