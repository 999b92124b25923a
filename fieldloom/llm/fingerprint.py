"""Operator 3: document fingerprints by consistent weighted sampling.

A text is a set of weighted terms: pairs of adjacent words (with a mark before the first word
and one after the last), weighed by how often they occur. For each sample, every term has
gamma numbers r and c and a uniform b, fixed by its hash; with t = floor(ln w / r + b) the
sample is the term, with its t, of the least ln c - r (t - b) - r. Two texts have a sample in
common with the probability of their generalised Jaccard similarity (sum of the smaller
weights over sum of the larger), so the share of equal samples estimates it.

The numbers are drawn for each term and sample on their own, by scrambling the term's hash: a
gamma number is -ln of a product of two uniforms. Terms of equal score are ordered by hash.

``compare_with_next`` also fingerprints an edited text for each document, its last half
replaced by the beginning of the next document. Documents are dealt by id ranges whose
bounds are ids that occur; the first document of a range is sent to the range before as well,
so each range is a stream of neighbours and no task sees more than its range. Texts are
compressed before that one shuffle.

Cases: null and empty texts have no terms and a fingerprint of their own, at likeness 1 to each
other and 0 to any other; a single row is its own next; rows that repeat an id follow each
other in the order of their bytes; null ids come last; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldloom.llm.common import hashes_of, mixed, odd_numbers, slices, words_of

SAMPLES = 64
#: Terms of a text that are handled at a time.
BLOCK = 512
#: Weighted terms whose scores are held.
MOST_TERMS = 1 << 18
EMPTY = np.uint32(0xFFFFFFFF)
BEGIN, END = np.array([0x9AE16A3B2F90404F], np.uint64), np.array([0xC949C7DEFA83D2F5], np.uint64)
LEFT, RIGHT = odd_numbers(31, 2)


FACTORS = odd_numbers(32, SAMPLES)
SECOND = np.uint64(0x9E3779B97F4A7C15)


def part(x: np.ndarray, low: int, bits: int) -> np.ndarray:
    """Some bits of 64-bit numbers, as a uniform number above 0 and at most 1."""
    whole = (x >> np.uint64(low)).astype(np.uint32) & np.uint32((1 << bits) - 1)
    u = whole.astype(np.float32)
    u += np.float32(0.5)
    u *= np.float32(2.0**-bits)
    return u


def draws(x: np.ndarray, factors: np.ndarray = FACTORS[:, None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``r, ln c, b`` of each sample (rows) and term: all of the term's own hash, none shared."""
    one = mixed(x * factors)
    two = mixed(one + SECOND)
    r = part(one, 32, 32)
    r *= part(one, 0, 32)
    np.negative(np.log(r, out=r), out=r)
    np.maximum(r, np.float32(1e-9), out=r)
    c = part(two, 43, 21)
    c *= part(two, 22, 21)
    np.log(np.negative(np.log(c, out=c), out=c), out=c)
    return r, c, part(two, 0, 22)


def levels(w: np.ndarray, r: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.floor(np.log(w.astype(np.float32)) / r + b)


def scores(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    """The score of each sample (rows) and weighted term."""
    r, c, b = draws(x)
    b -= levels(w, r, b) if (w > 1).any() else np.float32(0)
    b -= np.float32(1)
    b *= r
    b += c
    return b


class Scores:
    """Scores of weighted terms met lately, as neighbours and edited texts share many; one row each."""

    def __init__(self):
        self.keys, self.place, self.rows = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.empty((MOST_TERMS, SAMPLES), np.float32)

    def of(self, x: np.ndarray, w: np.ndarray) -> np.ndarray:
        """The row of each of at most MOST_TERMS terms."""
        keys, first, back = np.unique(mixed(x + w.astype(np.uint64) * SECOND), return_index=True, return_inverse=True)
        known = np.isin(keys, self.keys, assume_unique=True)
        if len(self.keys) + len(keys) - known.sum() > MOST_TERMS:
            self.keys, self.place, known = self.keys[:0], self.place[:0], np.zeros(len(keys), bool)
        new, size = first[~known], len(self.keys)
        new = new[np.argsort(w[new], kind="stable")]  # single terms in blocks of their own
        for at in range(0, len(new), BLOCK):
            some = new[at : at + BLOCK]
            self.rows[size + at : size + at + len(some)] = scores(x[some], w[some]).T
        found = np.concatenate((self.keys, mixed(x[new] + w[new].astype(np.uint64) * SECOND)))
        order = np.argsort(found)
        self.keys, self.place = found[order], np.concatenate((self.place, np.arange(size, size + len(new))))[order]
        return self.place[np.searchsorted(self.keys, keys)][back]


@lru_cache(maxsize=1)
def lately() -> Scores:
    return Scores()


def terms(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes, ascending, and weights of the pairs of adjacent words."""
    if not len(words):
        return words, np.zeros(0, np.int64)
    line = np.concatenate((BEGIN, words, END))
    return np.unique(mixed(line[:-1] * LEFT + line[1:] * RIGHT), return_counts=True)


def sample(h: np.ndarray, w: np.ndarray) -> np.ndarray:
    """The samples of a weighted set as 32-bit numbers."""
    if not len(h):
        return np.full(SAMPLES, EMPTY)
    best, k = np.full(SAMPLES, np.inf, np.float32), np.zeros(SAMPLES, np.int64)
    each = np.arange(SAMPLES)
    for at in range(0, len(h), BLOCK):
        score = scores(h[at : at + BLOCK], w[at : at + BLOCK])
        i = score.argmin(axis=1)
        better = score[each, i] < best
        best, k = np.where(better, score[each, i], best), np.where(better, at + i, k)
    return numbers(h[k], w[k])


def numbers(term: np.ndarray, w: np.ndarray) -> np.ndarray:
    """The chosen terms, one for each sample, with their levels."""
    r, _, b = draws(term, FACTORS)
    level = levels(w, r, b).astype(np.int64).astype(np.uint64)
    return np.minimum((mixed(term + level * SECOND) >> np.uint64(32)).astype(np.uint32), EMPTY - np.uint32(1))


def fingerprints(texts: list[str | None]) -> np.ndarray:
    """Samples of each text, one row each."""
    offsets, codes, distinct = words_of(pa.array(texts, pa.string()))
    h = hashes_of(distinct)[codes]
    out = np.full((len(texts), SAMPLES), EMPTY, np.uint32)
    group, size = [], 0  # texts whose terms are looked up together
    for i, (a, b) in enumerate(zip(offsets[:-1], offsets[1:], strict=True)):
        if b - a >= MOST_TERMS // 8:
            out[i] = sample(*terms(h[a:b]))
        elif b > a:
            group.append((i, *terms(h[a:b])))
            size += len(group[-1][1])
        if size > MOST_TERMS // 4:
            shared(group, out)
            group, size = [], 0
    shared(group, out)
    return out


def shared(group: list[tuple], out: np.ndarray) -> None:
    """``sample`` of each set of a group, by ``lately``'s scores."""
    if not group:
        return
    held = lately()
    places = np.split(held.of(np.concatenate([x for _, x, _ in group]), np.concatenate([w for _, _, w in group])), np.cumsum([len(x) for _, x, _ in group])[:-1])
    chosen, weights = np.empty((len(group), SAMPLES), np.uint64), np.empty((len(group), SAMPLES), np.int64)
    for n, ((_, x, w), place) in enumerate(zip(group, places, strict=True)):
        rows = held.rows[place]
        term, which = np.nonzero(rows == rows.min(axis=0))
        k = np.empty(SAMPLES, np.int64)
        k[which[::-1]] = term[::-1]  # of equal scores the first, as in ``sample``
        chosen[n], weights[n] = x[k], w[k]
    out[[i for i, _, _ in group]] = numbers(chosen, weights)


def shown(samples: np.ndarray) -> str:
    return samples.astype(">u4").tobytes().hex()


def compare_with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next``."""
    spark = docs.sparkSession
    n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    ids = docs.select(F.col("doc_id").alias("x"))
    bounds = np.unique(np.array(ids.approxQuantile("x", [k / n for k in range(n)], max(1e-4, 0.1 / n)), np.int64))
    lowest = ids.agg(F.min("x")).first()[0]
    bounds = np.unique(np.concatenate(([lowest], bounds))) if lowest is not None else bounds

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=3)
        for whole in batches:
            for batch in slices(whole):
                text = pa.array([press.compress((t or "").encode("utf-8")) for t in batch.column(1).to_pylist()], pa.binary())
                null = batch.column(0).is_null().to_numpy(zero_copy_only=False)
                doc = batch.column(0).fill_null(0).to_numpy(zero_copy_only=False)
                at = np.where(null, max(0, len(bounds) - 1), np.searchsorted(bounds, doc, side="right") - 1)
                yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(np.zeros(len(at), np.int32)), batch.column(0), text], NAMES)
                first = np.flatnonzero(~null & np.isin(doc, bounds))
                if len(first):
                    before = np.searchsorted(bounds, doc[first]) - 1
                    before[before < 0] = len(bounds) - 1
                    yield pa.RecordBatch.from_arrays([pa.array(before.astype(np.int32)), pa.array(np.ones(len(first), np.int32)), batch.column(0).take(pa.array(first)), text.take(pa.array(first))], NAMES)

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpress = zstandard.ZstdDecompressor()
        first = last = None  # (range, guest, id, text, samples)
        for whole in batches:
            for batch in slices(whole, "text", 1 << 18):
                texts = [unpress.decompress(x).decode("utf-8") for x in batch.column(3).to_pylist()]
                own = fingerprints(texts)
                rows = [*zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), texts, own, strict=True)]
                pairs = []
                for row in rows:
                    if last is not None and not last[1]:
                        pairs.append((last, row if row[0] == last[0] else first))
                    if last is None or row[0] != last[0]:
                        first = row
                    last = row
                yield answers(pairs)
        if last is not None and not last[1]:
            yield answers([(last, first)])

    kinds = "at int, guest int, doc_id long, text binary"
    streams = docs.mapInArrow(dealt, kinds).repartitionById(n, "at").sortWithinPartitions("at", "guest", F.col("doc_id").asc_nulls_last(), "text")
    return streams.mapInArrow(compared, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


NAMES = ["at", "guest", "doc_id", "text"]


def edited(text: str, following: str) -> str:
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def answers(pairs: list[tuple]) -> pa.RecordBatch:
    changed = [edited(a[3], b[3]) for a, b in pairs]
    samples = fingerprints(changed)
    columns = {
        "doc_id": pa.array([a[2] for a, _ in pairs], pa.int64()),
        "n_chars": pa.array([len(a[3]) for a, _ in pairs], pa.int64()),
        "edited_sha256": pa.array([hashlib.sha256(t.encode("utf-8")).hexdigest() for t in changed], pa.string()),
        "fingerprint": pa.array([shown(a[4]) for a, _ in pairs], pa.string()),
        "edited_fingerprint": pa.array([shown(s) for s in samples], pa.string()),
        "near_edited": pa.array([float((a[4] == s).mean()) for (a, _), s in zip(pairs, samples, strict=True)], pa.float64()),
        "near_next": pa.array([float((a[4] == b[4]).mean()) for a, b in pairs], pa.float64()),
    }
    return pa.RecordBatch.from_arrays([*columns.values()], [*columns])
