"""Operator 8: ordinal cumulative-link regression on graded ratings, over hashed text.

Grades are ordered (0 toxic, 1 poor, 2 good). One set of weights, shared by all grades, gives a
text's score s, and ordered thresholds t give P(grade > k) = sigmoid(s - t[k]); from these come
the expected grade and the tail probability by which rows are kept.

Features are hashed: every distinct word of a text (lower case, without signs at its ends) and
two of its beginnings, and in tenths the share of words of each shape (signs at the end, all
capitals). Features in fewer than ``least_rows`` rows of the sample are left out.

The model is fitted on at most ``sample_rows`` labelled rows, those of least id hash, on the
driver; rows are scored in one pass over the text, in which each distinct word's weight is
looked up once a batch.

Cases: null and empty texts have no words and the score of none; without labelled rows nothing
is rejected (tail probabilities are 1); a label that is null counts as good in that respect, and
a row of two null labels isn't graded;
rows that repeat an id are scored each; other columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldloom.llm.common import lean, slices, words_of

SIZE, KINDS = 1 << 18, 24
SIGNS = ".,!?;:|\"'()%&$#*"
BEGINNINGS = (5, 7)
#: A shape's value beside a word's 1, and the weight decay.
SHAPE, DECAY = 8.0, 6.0
#: Entries of a worker's table of words.
KEPT = 150_000
#: Entries of the sample that one step of the fit handles, so that its arrays stay small.
STEP = 1 << 19


def place(feature: str) -> int:
    return zlib.crc32(feature.encode("utf-8")) % SIZE


def word_features(word: str) -> tuple[list[int], int]:
    """Places of a word's features, and the number of its shape (0: plain)."""
    core, tail = word.strip(SIGNS).lower(), word[len(word.rstrip(SIGNS)) :]
    capitals = len(word) > 1 and word.isupper()
    found = [place("w:" + core), *(place(f"p{n}:{core[:n]}") for n in BEGINNINGS if len(core) > n)] if core else []
    if core and len(tail) < 2 and not capitals:
        return found, 0
    return found, 1 + zlib.crc32(f"{tail[-3:]}{capitals}".encode()) % (KINDS - 1)


TENTHS = np.array([[place(f"s:{k}:{x}") for x in range(11)] for k in range(KINDS)])
ODD = np.array([place(f"o:{x}") for x in range(11)])
LENGTH = np.array([place(f"n:{x}") for x in range(64)])


def shapes(kinds: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """Places of a text's shape features."""
    n = max(1, len(codes))
    share = np.ceil(10 * np.bincount(kinds[codes], minlength=KINDS) / n).astype(np.int64)
    some = np.flatnonzero(share)
    return np.concatenate((TENTHS[some, share[some]], [ODD[int(np.ceil(10 * (kinds[codes] > 0).sum() / n))], LENGTH[n.bit_length()]]))


def features(docs: DataFrame) -> DataFrame:
    """``doc_id, places, values`` of each row: its distinct places, ascending, as 32-bit numbers, and
    how often each occurs, shapes' counted SHAPE times, as 32-bit floats."""

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole):
                offsets, codes, distinct = words_of(batch.column(1))
                info = [word_features(w) for w in distinct]
                kinds = np.array([k for _, k in info], np.int64)
                places, values = [], []
                for a, b in zip(offsets[:-1], offsets[1:], strict=True):
                    words = np.array([x for c in np.unique(codes[a:b]) for x in info[c][0]], np.int64)
                    forms = shapes(kinds, codes[a:b])
                    at, of = np.unique(np.concatenate((words, forms)), return_inverse=True)
                    places.append(at.astype("<u4").tobytes())
                    values.append(np.bincount(of, np.repeat([1.0, SHAPE], [len(words), len(forms)])).astype("<f4").tobytes())
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(places, pa.binary()), pa.array(values, pa.binary())], ["doc_id", "places", "values"])

    return docs.mapInArrow(lean(found), "doc_id long, places binary, values binary")


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * z))


def summed(by: np.ndarray, values, n: int) -> np.ndarray:
    """Sums of ``values(begin, end)`` by ``by``, in steps of STEP entries."""
    out = np.zeros(n)
    for a in range(0, len(by), STEP):
        out += np.bincount(by[a : a + STEP], values(a, a + STEP), minlength=n)
    return out


def fit(row: np.ndarray, col: np.ndarray, value: np.ndarray, grade: np.ndarray, grades: int, rounds: int = 200) -> tuple[np.ndarray, np.ndarray]:
    """Weights and thresholds of most likelihood less decay, by Adam steps that shrink."""
    n = len(grade)
    tail = np.array([(np.sum(grade > k) + 0.5) / (n + 1) for k in range(grades - 1)])
    at = np.concatenate((np.zeros(SIZE), -np.log(tail / (1 - tail))))
    one, two = np.zeros_like(at), np.zeros_like(at)
    each = np.arange(n)
    for step in range(1, rounds + 1):
        w, t = at[:SIZE], at[SIZE:]
        above = np.ones((n, grades + 1))  # P(grade >= k), with 1 and 0 at the ends
        above[:, 1:grades] = sigmoid(summed(row, lambda a, b, w=w: w[col[a:b]] * value[a:b], n)[:, None] - t[None, :])
        above[:, grades] = 0
        slope = above * (1 - above)
        high, low = above[each, grade], above[each, grade + 1]
        p = np.maximum(high - low, 1e-9)
        up, down = slope[each, grade] / p, slope[each, grade + 1] / p
        pull = up - down
        gradient = np.concatenate((summed(col, lambda a, b, pull=pull: pull[row[a:b]] * value[a:b], SIZE) - DECAY * w, np.zeros(grades - 1)))
        for k in range(grades - 1):
            gradient[SIZE + k] = down[grade == k].sum() - up[grade == k + 1].sum()
        one += 0.1 * (gradient - one)
        two += 0.01 * (gradient * gradient - two)
        rate = 0.05 * min(1.0, 2 * (1 - step / (rounds + 1)))
        at = at + rate * (one / (1 - 0.9**step)) / (np.sqrt(two / (1 - 0.99**step)) + 1e-8)
        at[SIZE:] = np.sort(at[SIZE:])
    return at[:SIZE], at[SIZE:]


def train(docs: DataFrame, labels: DataFrame, sample_rows: int = 8000, least_rows: int = 4, grades: int = 3) -> tuple[np.ndarray, np.ndarray] | None:
    """Weights (shapes' value within) and thresholds from ``labels`` (``doc_id, grade``)."""
    picked = labels.where("doc_id is not null and grade is not null").orderBy(F.xxhash64("doc_id"), "doc_id", "grade").limit(sample_rows).select(F.col("doc_id").alias("of"), "grade")
    rows = docs.join(F.broadcast(picked), F.col("doc_id") == F.col("of"))  # sample_rows rows at most
    rows = features(rows.select("doc_id", "text")).join(F.broadcast(picked), F.col("doc_id") == F.col("of")).select("doc_id", "grade", "places", "values").toArrow()
    if not rows.num_rows:
        return None
    rows = rows.combine_chunks().sort_by([("doc_id", "ascending"), ("grade", "ascending"), ("places", "ascending")])  # 8 bytes a place
    grade = rows.column("grade").to_numpy().astype(np.int64)
    col, value = flat(rows.column("places"), "<u4").astype(np.int32), flat(rows.column("values"), "<f4")
    row = np.repeat(np.arange(len(grade), dtype=np.int32), pc.binary_length(rows.column("places")).to_numpy() // 4)
    del rows
    keep = (summed(col, lambda a, b: None, SIZE) >= least_rows)[col]
    return fit(row[keep], col[keep], value[keep], grade, grades)


def flat(column: pa.ChunkedArray, kind: str) -> np.ndarray:
    """The numbers of all rows of a binary column."""
    parts = []
    for chunk in column.chunks:
        ends = np.frombuffer(chunk.buffers()[1], np.int32)[chunk.offset : chunk.offset + len(chunk) + 1]
        parts.append(np.frombuffer(chunk.buffers()[2], np.uint8)[ends[0] : ends[-1]].view(kind))
    return np.concatenate(parts)


def rate(docs: DataFrame, labels: DataFrame, keep_above: int = 1, least: float = 0.5, sample_rows: int = 8000, grades: int = 3, id_col: str = "doc_id", text_col: str = "text", carried: tuple[str, ...] = ()) -> DataFrame:
    """``doc_id, expected_grade, tails, kept`` and, if columns are ``carried``, ``rest`` with them:
    ``tails[k]`` is P(grade > k); kept are rows whose ``tails[keep_above]`` is ``least`` or more."""
    rest = [F.struct(*[F.col(c) for c in carried]).alias("rest")] if carried else []
    inside = carried.index(text_col) if text_col in carried else None  # a carried text is sent to the workers once
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), *rest)
    model = train(docs, labels, sample_rows, grades=grades)
    if model is None:
        tails = F.array(*[F.lit(1.0)] * (grades - 1))
        return docs.select("doc_id", F.lit(float(grades - 1)).alias("expected_grade"), tails.alias("tails"), *docs.columns[2:], F.lit(True).alias("kept"))
    weights, thresholds, others = model[0].astype(np.float32), model[1], ["rest"] if carried else []

    if inside is not None:
        docs = docs.select("doc_id", "rest")

    def rated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, tuple[float, int]] = {}

        def look(word: str) -> tuple[float, int]:
            if (out := known.get(word)) is None:
                found, kind = word_features(word)
                out = known[word] = float(weights[found].sum(dtype=np.float64)) if found else 0.0, kind
            return out

        for whole in batches:
            if inside is not None:
                whole = whole.add_column(1, "text", pc.struct_field(whole.column(1), inside))
            for batch in slices(whole):
                if len(known) > KEPT:
                    known.clear()
                offsets, codes, distinct = words_of(batch.column(1))
                info = [look(w) for w in distinct]
                values, kinds = np.array([v for v, _ in info], np.float64), np.array([k for _, k in info], np.int64)
                score = np.array([values[np.unique(codes[a:b])].sum() + SHAPE * weights[shapes(kinds, codes[a:b])].sum(dtype=np.float64) for a, b in zip(offsets[:-1], offsets[1:], strict=True)])
                tails = sigmoid(score.reshape(-1, 1) - thresholds[None, :])
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(score) + 1, dtype=np.int32) * (grades - 1)), pa.array(tails.ravel()))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(tails.sum(axis=1)), lists, *batch.columns[2:]], ["doc_id", "expected_grade", "tails", *others])

    kinds = "".join(f", {f.name} {f.dataType.simpleString()}" for f in docs.schema.fields if f.name == "rest")
    return docs.mapInArrow(lean(rated), f"doc_id long, expected_grade double, tails array<double>{kinds}").withColumn("kept", F.col("tails")[keep_above] >= least)


def graded(labels: DataFrame) -> DataFrame:
    """``doc_id, grade`` of quality and toxicity marks: 0 toxic, 1 poor, 2 good, null without either mark."""
    unknown = F.col("toxic").isNull() & F.col("quality").isNull()
    return labels.select("doc_id", F.when(F.col("toxic") == 1, 0).when(F.col("quality") == 0, 1).when(~unknown, 2).alias("grade"))
