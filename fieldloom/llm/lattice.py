"""Operator 10: language-model scores by subword lattice likelihood.

A text is its words and one end. Each word, with a mark before it, is a lattice: an arc for
every stretch that the existing vocabulary has, arcs of bytes for letters that it lacks, and one
arc over the whole word if training rows have it. A segmentation weighs the product of its arcs'
probabilities; the word's probability is the sum over all segmentations, by forward recursion in
log space (the whole word's arc enters at the last node), and the text's is the product over
words and the end. A word that training rows lack has its pieces' segmentations alone.

Pieces start at weights by the vocabulary's own scores. These are merge ranks, 0, -1, -2, ..., not
log probabilities, so a score s gives the weight 1 / (RANK - s). ``rounds`` of expectation
maximisation fit the pieces to the distinct training words, as new words are like those rather
than like frequent ones. All pieces together have the mass of words that are new, estimated by the
words seen once; the others share the rest by their counts.

Two things go beyond a plain unigram vocabulary, as the README says with figures: the arcs of whole
words, and classes. A whole word weighs its share of the training words of the text's class (the
most frequent values of ``class_col``; the others are one class), and with NEAR of that mass its
share of all; the class is a hidden choice too, and the text's probability is summed over it.
``class_col=None`` and ``whole_words=False`` leave them out.

Documents are cut into blocks of bounded size; a block is the list of its distinct words and
each document's words as numbers into that list. Only distinct words are counted, joined and
scored, so no shuffle carries texts, and a frequent word is one row a block.

The scored text is never asked for its class: null and unknown classes score as any other.

Cases: a null or empty text is the end alone; texts and words of any length are scored whole;
rows that repeat an id are scored each; a null id is not held out; without training rows all
pieces keep their starting weights; other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldloom.llm.common import lean, save, slices, words_of

MARK = "▁"
#: Bytes of text in a block, and words whose lattices are handled at a time.
BLOCK_BYTES, STEP_WORDS = 24 << 20, 20_000
#: Part of the seen words' mass that is shared out by counts over all classes.
NEAR = 0.03
#: Added to ranks, so that the first pieces don't have all the weight.
RANK = 10.0
#: Bits of a code point beside a trie's node.
POINT = 21


class Pieces:
    """The vocabulary's pieces as numbers, and a trie of their letters: the child of a node by a letter is
    found in one sorted array. Two numbers more stand for a byte and for the end."""

    def __init__(self, names: list[str], scores: list[float]):
        self.names, self.size = names, len(names)
        self.byte, self.end = self.size, self.size + 1
        self.scores = np.array(scores, np.float64)
        child: dict[tuple[int, int], int] = {}
        piece = [-1]
        for number, name in enumerate(names):
            node = 0
            for c in map(ord, name):
                node = child.setdefault((node, c), len(piece))
                if node == len(piece):
                    piece.append(-1)
            piece[node] = number
        keys = np.array([node << POINT | c for node, c in child], np.int64)
        order = np.argsort(keys)
        self.keys, self.child, self.piece = keys[order], np.array([*child.values()], np.int64)[order], np.array(piece, np.int64)

    @classmethod
    def of_file(cls, path: str) -> Pieces:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        numbers = [i for i in range(model.get_piece_size()) if not (model.is_unknown(i) or model.is_control(i) or model.is_byte(i) or model.is_unused(i))]
        return cls([model.id_to_piece(i) for i in numbers], [model.get_score(i) for i in numbers])

    def start(self) -> np.ndarray:
        """Natural logs of the starting weights; a byte and the end weigh as much as the hundredth piece."""
        w = np.append(1.0 / (RANK - np.minimum(self.scores, 0.0)), [1.0 / (RANK + 100)] * 2)
        return np.log(w / w.sum())

    def step(self, node: np.ndarray, letter: np.ndarray) -> np.ndarray:
        """The children of nodes by letters; -1 where there is none."""
        keys = node << POINT | letter
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.child[at], -1)

    def arcs(self, words: list[str]) -> tuple[np.ndarray, ...]:
        """``(begin, end, piece, times)`` of all arcs, nodes numbered through all words, and the last
        node of each word."""
        letters = np.frombuffer("".join(MARK + w for w in words).encode("utf-32-le"), "<u4").astype(np.int64)
        lengths = np.fromiter(map(len, words), np.int64, len(words)) + 1
        ends = np.cumsum(lengths)
        word = np.repeat(np.arange(len(words)), lengths)
        place, length = np.arange(len(letters)), 0
        node = np.zeros(len(letters), np.int64)
        begins, sizes, pieces = [], [], []
        while len(place):
            node = self.step(node, letters[place + length])
            length += 1
            found = self.piece[np.maximum(node, 0)]
            whole = (node >= 0) & (found >= 0)
            begins.append(place[whole])
            sizes.append(np.full(whole.sum(), length))
            pieces.append(found[whole])
            if length == 1:  # letters that aren't pieces are bytes
                bare = place[~whole]
                begins.append(bare)
                sizes.append(np.ones(len(bare), np.int64))
                pieces.append(np.full(len(bare), self.byte))
            on = (node >= 0) & (place + length < ends[word[place]])
            place, node = place[on], node[on]
        begin, size, piece = np.concatenate(begins), np.concatenate(sizes), np.concatenate(pieces)
        point = letters[begin]
        times = np.where(piece == self.byte, 1 + (point > 0x7F) + (point > 0x7FF) + (point > 0xFFFF), 1)
        node = begin + word[begin]  # every word has a node more than letters
        return node, node + size, piece, times, ends + np.arange(len(words))


@lru_cache(maxsize=2)
def pieces_of(path: str) -> Pieces:
    return Pieces.of_file(path)


def recursion(begin: np.ndarray, end: np.ndarray, value: np.ndarray, step: np.ndarray, total: np.ndarray) -> None:
    """Fills ``total`` (logs, starting nodes at 0) over arcs taken in the order of ``step``."""
    order = np.lexsort((end, step))
    begin, end, value, step = begin[order], end[order], value[order], step[order]
    cuts = np.flatnonzero(np.diff(step)) + 1
    for a, b in zip([0, *cuts], [*cuts, len(step)], strict=True):
        if a == b:
            continue
        reach = total[begin[a:b]] + value[a:b]
        first = np.concatenate(([0], np.flatnonzero(np.diff(end[a:b])) + 1))
        total[end[a:b][first]] = np.logaddexp.reduceat(reach, first)


def word_scores(words: list[str], pieces: Pieces, logs: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray | None]:
    """Natural logs of the words' probabilities; given counts, also the expected number of each piece."""
    scores, expected = np.zeros(len(words)), None if counts is None else np.zeros(pieces.size + 2)
    for at in range(0, len(words), STEP_WORDS):
        part = words[at : at + STEP_WORDS]
        begin, end, piece, times, last = pieces.arcs(part)
        value = logs[piece] * times - np.where(piece == pieces.byte, times * math.log(256), 0.0)
        first = np.concatenate(([0], last[:-1] + 1))
        forward = np.full(last[-1] + 1, -np.inf)
        forward[first] = 0.0
        of_word = np.searchsorted(last, begin)
        recursion(begin, end, value, end - first[of_word], forward)
        scores[at : at + len(part)] = forward[last]
        if expected is not None:
            backward = np.full(last[-1] + 1, -np.inf)
            backward[last] = 0.0
            recursion(end, begin, value, last[of_word] - begin, backward)
            share = np.exp(forward[begin] + value + backward[end] - forward[last][of_word]) * counts[at : at + len(part)][of_word]
            expected += np.bincount(piece, share * times, minlength=len(expected))
    return scores, expected


def blocks(docs: DataFrame, classes: int) -> DataFrame:
    """Words and documents of each block: ``block, place, word, n`` (``n``: occurrences in training
    rows of each class) and ``block, doc_id, held_out, counts`` in one table."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=3)
        base, number = TaskContext.get().partitionId() << 32, 0
        places: dict[str, int] = {}
        seen, size = [], 0

        def listed() -> pa.RecordBatch:
            words = [*places]
            total = np.zeros((len(words), classes), np.int64)
            for where, n in seen:
                total[where] += n
            m = len(words)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(m + 1, dtype=np.int32) * classes), pa.array(total.ravel()))
            return batch_of([base + number] * m, [*range(m)], words, lists, [None] * m, [None] * m, [None] * m)

        for whole in batches:
            for batch in slices(whole, limit=4 << 20):
                offsets, codes, distinct = words_of(batch.column(2), lower=True)
                where = np.fromiter((places.setdefault(w, len(places)) for w in distinct), np.int64, len(distinct))
                held = batch.column(1).to_numpy(zero_copy_only=False)
                train = np.repeat(~held, np.diff(offsets))
                kind = np.repeat(batch.column(3).to_numpy(), np.diff(offsets))[train]
                seen.append((where, np.bincount(codes[train].astype(np.int64) * classes + kind, minlength=len(distinct) * classes).reshape(-1, classes)))
                packed = []
                for a, b in zip(offsets[:-1], offsets[1:], strict=True):
                    word, n = np.unique(where[codes[a:b]], return_counts=True)
                    packed.append(press.compress(np.concatenate((np.diff(word, prepend=0), n)).astype("<u4").tobytes()))
                m = batch.num_rows
                yield batch_of([base + number] * m, [None] * m, [None] * m, [None] * m, batch.column(0), batch.column(1), packed)
                size += int(batch.column(2).nbytes)
                if size >= BLOCK_BYTES:
                    yield listed()
                    number, size = number + 1, 0
                    places.clear()
                    seen.clear()
        if places:
            yield listed()

    return docs.mapInArrow(lean(cut), "block long, place int, word string, n array<long>, doc_id long, held_out boolean, counts binary")


def batch_of(*columns) -> pa.RecordBatch:
    kinds = {"block": pa.int64(), "place": pa.int32(), "word": pa.string(), "n": pa.list_(pa.int64()), "doc_id": pa.int64(), "held_out": pa.bool_(), "counts": pa.binary()}
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, k) for c, k in zip(columns, kinds.values(), strict=True)], [*kinds])


def class_number(docs: DataFrame, class_col: str | None, most: int) -> tuple[list[int], object]:
    """Rows of each class among ``docs``, and a row's class as an expression."""
    if class_col is None:
        return [docs.count()], F.lit(0)
    top = docs.where(F.col(class_col).isNotNull()).groupBy(F.col(class_col).cast("string").alias("k")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "k").limit(most).collect()
    number = F.lit(len(top))
    for i, r in enumerate(top):
        number = F.when(F.col(class_col).cast("string") == r["k"], i).otherwise(number)
    return [r["n"] for r in top], number


def score(docs: DataFrame, vocabulary: str, rounds: int = 3, class_col: str | None = "lang", most_classes: int = 7, whole_words: bool = True, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score``; logs are decimal."""
    held = F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 1, F.lit(False))
    sizes, number = class_number(docs.where(~held), class_col, most_classes)
    classes = len(sizes) + (class_col is not None)
    table = save(blocks(docs.select(F.col(id_col).cast("long").alias("doc_id"), held.alias("held_out"), F.col(text_col).alias("text"), number.alias("class")), classes), "lattice-blocks")
    of_words = table.where("word is not null").select("block", "place", "word", "n")
    of_docs = table.where("word is null").select("block", "doc_id", "held_out", "counts")
    words = of_words.groupBy("word").agg(*[F.sum(F.col("n")[k]).alias(f"n{k}") for k in range(classes)])
    words = save(words.select("word", F.array(*[f"n{k}" for k in range(classes)]).alias("n"), sum((F.col(f"n{k}") for k in range(classes)), F.lit(0)).alias("c")), "lattice-words")
    train = words.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count_if(F.col("c") > 0), F.count_if(F.col("c") == 1), *[F.coalesce(F.sum(F.col("n")[k]), F.lit(0)) for k in range(classes)]).first()
    ends = of_docs.where("not held_out").count()
    total, kinds = train[0] + ends, train[1] + (ends > 0)
    rows_of = np.array([*sizes, ends - sum(sizes)][:classes], np.float64)
    prior = (rows_of + 0.5) / (rows_of + 0.5).sum()
    class_total = np.array(train[3:], np.float64) + rows_of  # words and ends
    pieces = pieces_of(vocabulary)
    logs, size = pieces.start(), pieces.size + 2

    def expect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, sums = pieces_of(vocabulary), np.zeros(size)
        for batch in batches:
            sums += word_scores(batch.column(0).to_pylist(), known, logs, np.ones(batch.num_rows))[1]
        some = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(sums[some])], ["piece", "n"])

    for _ in range(rounds if train[1] else 0):
        sums = np.zeros(size)
        for r in words.where("c > 0").select("word").mapInArrow(lean(expect), "piece long, n double").groupBy("piece").agg(F.sum("n").alias("n")).collect():  # one row a piece at most
            sums[r["piece"]] = r["n"]
        sums[pieces.end] = 1
        logs = np.log((sums + 0.1) / (sums.sum() + 0.1 * size))

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = pieces_of(vocabulary)
        for batch in batches:
            out, _ = word_scores(batch.column(0).to_pylist(), known, logs)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(out)], ["word", "n", "c", "log_p"])

    new = min(1.0, (train[2] + 1) / (total + 2)) if whole_words else 1.0
    near = (1 - new) * NEAR if classes > 1 else 0.0
    own = 1 - new - near

    def mixed(log_p: np.ndarray, n: np.ndarray, c: np.ndarray) -> np.ndarray:
        """Log probability of words in each class: the last step of the recursion, where the arc of the whole
        word, by class and all, meets the pieces' segmentations."""
        arcs = own * n / np.maximum(class_total, 1) + near * c[:, None] / max(total, 1)
        with np.errstate(divide="ignore"):
            return np.logaddexp(math.log(new) + log_p[:, None], np.log(arcs))

    end_p = mixed(np.array([logs[pieces.end]]), rows_of[None, :], np.array([float(ends)]))[0]
    floor = total + 0.5 * (kinds + 1)
    rated = save(words.mapInArrow(lean(scored), "word string, n array<long>, c long, log_p double"), "lattice-rated")
    sent = of_words.select("block", "place", "word").join(rated, "word").select(F.col("block").alias("of_block"), "place", "n", "c", "log_p")

    def finished(doc: pa.Table, word: pa.Table) -> pa.Table:
        unpress, m = zstandard.ZstdDecompressor(), doc.num_rows
        order = np.argsort(word.column("place").to_numpy())
        c, log_p = word.column("c").to_numpy()[order], word.column("log_p").to_numpy()[order]
        n_of = word.column("n").combine_chunks().flatten().to_numpy().reshape(-1, classes)[order]
        log_p = mixed(log_p, n_of.astype(np.float64), c.astype(np.float64))
        base = np.log10((c + 0.5) / floor)
        rows = np.zeros((m, 4))
        for i, packed in enumerate(doc.column("counts").to_pylist()):
            both = np.frombuffer(unpress.decompress(packed), "<u4").astype(np.int64)
            where, n = np.cumsum(both[: len(both) // 2]), both[len(both) // 2 :]
            by_class = np.log(prior) + n @ log_p[where] + end_p
            rows[i] = n.sum() + 1, n[c[where] > 0].sum() + (ends > 0), (n * base[where]).sum(), np.logaddexp.reduce(by_class)
        return pa.table(
            {
                "doc_id": doc.column("doc_id"),
                "held_out": doc.column("held_out"),
                "n_tokens": pa.array(rows[:, 0].astype(np.int64)),
                "n_known": pa.array(rows[:, 1].astype(np.int64)),
                "train_tokens": pa.array([total] * m, pa.int64()),
                "base_score": pa.array(rows[:, 2] + math.log10((ends + 0.5) / floor)),
                "score": pa.array(rows[:, 3] / math.log(10)),
            }
        )

    result = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return of_docs.groupBy("block").cogroup(sent.groupBy("of_block")).applyInArrow(finished, result)
