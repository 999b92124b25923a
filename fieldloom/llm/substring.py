"""Operator 5: incremental substring removal with a log-structured index of window hashes.

A window of ``window`` words is found by its seed: the least hash among the ``gram``-word runs
inside it. Neighbouring windows share a seed, so about one run in seven is one. For every seed
the index holds a digest of all words that its windows cover, which makes equal stretches meet
as one row. A batch of documents becomes a run: its rows, dealt out and sorted by key, never
changed after. The new run is merge-joined with every run of earlier batches (same layout, so
nothing moves). Where all digests of a seed agree, all of its windows are equal and all but the
first are covered. Where they differ, the windows themselves are hashed from the texts and
verified one by one. Of equal windows all but the first (earlier batch, then smaller id, then
earlier start) are covered. A level of ``fanout`` runs is compacted into one run of the next
level, with one row for equal ones; later batches read that run.

Hot seeds are dealt out when they are written. Windows that repeat in a slice of the input are
settled there, so a large group of copies sends one row for each slice; a seed with more than
MANY digests in a slice (a common line in many contexts) is written as its single windows,
each with a key of its own, and a mark under the seed's key says so.

A window's identity is a 64-bit hash of its words, under its seed's 64-bit hash unless the seed
is hot. Words are hashed from the text's bytes, many at once.

``WindowIndex`` keeps an index in a folder, to which batches can be added at any later time;
``remove_repeats`` feeds a whole table to one in batches of equal size.

Cases: null texts and those shorter than a window keep all words; a window that repeats inside
one document is covered from its second start on; equal rows of one id are the same document,
which is indexed once, and all keep the same words; different texts of one id are judged in the
order of their hash, null ids come first; an empty table gives no rows; other columns are not
read.
"""

from __future__ import annotations

import hashlib
import json
import re
import uuid
from collections.abc import Iterator
from functools import lru_cache
from itertools import compress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fieldloom.llm.common import WORD, chained, lean, mixed, new_path, numbered, odd_numbers, save, slices
from fieldloom.plans.tables import delete, read_text, write_text

#: Rows of one seed from which its windows get keys of their own.
HOT = 1000
#: Digests of one seed in a slice of the input from which it is written as windows.
MANY = 16
#: Bytes of text in a slice.
SLICE = 8 << 20
#: Bytes of text, and of its words, that one step within a slice handles, so that its arrays stay small.
STEP, STEP_WORDS = 1 << 20, 1 << 17
#: Kinds of a run's rows: a seed, the mark of a hot seed, a hot seed's window, windows settled in their slice.
SEED, MARK, WINDOW, SETTLED = range(4)
RUN = "k long, kind int, d long, id long, start int, n int"
#: The way that words are hashed; an index made another way cannot be added to.
HASHES = 2
WORDS = re.compile(WORD.encode())
FACTOR = odd_numbers(52, 1)[0]
#: Bytes of a word that are hashed as numbers of eight, beside the others of its step; longer words are hashed one by one.
SHORT = 64
OF_LENGTH, OF_BLOCK = odd_numbers(53, 2)
IN_WORD = np.array([WORDS.match(bytes([b])) is not None for b in range(256)])
#: Of eight bytes read as a number, the first 0, 1, ... 8.
HEADS = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)
SCRAMBLE = np.uint64(0x9E3779B97F4A7C15)


def powers(factor: int, n: int) -> np.ndarray:
    return np.concatenate((np.ones(1, np.uint64), np.cumprod(np.full(n - 1, factor, np.uint64))))


#: Those of a step's length, which workers keep.
kept_powers = lru_cache(maxsize=2)(powers)


def hashed_words(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of the texts, and where each text's begin among them. Words are found and hashed
    from the bytes, as arrays, without an object for each."""
    texts = [t or b"" for t in texts]
    line = b" ".join([b"", *texts, b" " * 8])
    inside = IN_WORD[np.frombuffer(line, np.uint8)]
    edges = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    begin, length = edges[::2], edges[1::2] - edges[::2]
    eights = np.ndarray(len(line) - 7, "<u8", line, strides=(1,))
    h = np.zeros(len(begin), np.uint64)
    for a in range(0, len(h), STEP_WORDS):
        h[a : a + STEP_WORDS] = hashed_short(eights, begin[a : a + STEP_WORDS], length[a : a + STEP_WORDS])
    for i in np.flatnonzero(length > SHORT):
        h[i] = xxhash.xxh3_64_intdigest(line[begin[i] : begin[i] + length[i]])
    starts = 1 + np.cumsum([0, *[len(t) + 1 for t in texts]])
    return np.searchsorted(begin, starts), h


def hashed_short(eights: np.ndarray, begin: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Hashes of the words' first SHORT bytes; ``eights[i]`` is the eight bytes from ``i`` on as a number."""
    h = mixed((eights[begin] & HEADS[np.minimum(length, 8)]) ^ (length.astype(np.uint64) * OF_LENGTH))
    for done in range(8, SHORT, 8):
        left = np.flatnonzero(length > done)
        if not len(left):
            break
        block = eights[begin[left] + done] & HEADS[np.minimum(length[left] - done, 8)]
        h[left] = mixed(h[left] * OF_BLOCK + block)
    return h


class Stretches:
    """Hashes of stretches of a line of words, from sums of the words' hashes times powers."""

    def __init__(self, h: np.ndarray):
        n = 2 * STEP_WORDS
        forth, self.back = (kept_powers(f, n) if len(h) < n else powers(f, len(h) + 1) for f in (int(FACTOR), pow(int(FACTOR), -1, 1 << 64)))
        self.sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(h * forth[: len(h)], dtype=np.uint64)))

    def of(self, begin: np.ndarray, length: np.ndarray | int) -> np.ndarray:
        return mixed((self.sums[begin + length] - self.sums[begin]) * self.back[begin] + np.asarray(length).astype(np.uint64) * SCRAMBLE)


def least(values: np.ndarray, width: int) -> np.ndarray:
    """Place of the first least value among every ``width`` consecutive ones."""
    place, reach = np.arange(len(values)), 1
    while reach < width:
        step = min(reach, width - reach)
        a, b = place[:-step], place[step:]
        place = np.where(values[b] < values[a], b, a)
        reach += step
    return place


def seeds_of(h: np.ndarray, offsets: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, ...]:
    """Of the documents ``h[offsets[i]:offsets[i+1]]``: each seed's document, hash, digest, first window
    (counted through all documents) and number of windows, in order."""
    found = []
    for a, b in steps(offsets):
        of, seed, digest, first, n = seeds_of_step(h[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], window, gram)
        found.append((of + a, seed, digest, first + offsets[a], n))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True)) if found else seeds_of_step(h, offsets, window, gram)


def steps(offsets: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of documents of STEP_WORDS words, or of one longer document."""
    a = 0
    while a < len(offsets) - 1:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + STEP_WORDS, side="right")) - 1)
        yield a, b
        a = b


def seeds_of_step(h: np.ndarray, offsets: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, ...]:
    if len(h) < window:
        none = np.zeros(0, np.int64)
        return none, none.astype(np.uint64), none.astype(np.uint64), none, none
    grams = chained(h, gram, 51)
    of = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    starts = np.arange(len(h) - window + 1)
    starts = starts[starts + window <= offsets[1:][of[starts]]]
    seed = least(grams, window - gram + 1)[starts]
    new = np.flatnonzero(np.diff(seed, prepend=-1))
    first, n = starts[new], np.diff(np.append(new, len(starts)))
    return of[first], grams[seed[new]], Stretches(h).of(first, n + window - 1), first, n


def spread(first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """All of ``first[i], first[i] + 1, ... first[i] + n[i] - 1``."""
    ends = np.cumsum(n)
    return np.arange(ends[-1] if len(n) else 0) + np.repeat(first - (ends - n), n)


def windows_at(h: np.ndarray, at: np.ndarray, window: int) -> np.ndarray:
    """Hashes of the windows that start at the places ``at``, ascending."""
    cuts = np.searchsorted(at, np.arange(0, len(h) + STEP_WORDS, STEP_WORDS))
    out = np.zeros(len(at), np.uint64)
    for k, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
        if a < b:
            low = k * STEP_WORDS
            out[a:b] = Stretches(h[low : at[b - 1] + window]).of(at[a:b] - low, window)
    return out


def firsts(values: np.ndarray) -> np.ndarray:
    """Which entries are the first of their value."""
    out = np.zeros(len(values), bool)
    out[np.unique(values, return_index=True)[1]] = True
    return out


def stretches(first: np.ndarray, n: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``first, n, of`` with neighbours that follow on each other in one document made one."""
    if not len(first):
        return first, n, of
    new = np.flatnonzero(np.concatenate(([True], (first[1:] != first[:-1] + n[:-1]) | (of[1:] != of[:-1]))))
    return first[new], np.add.reduceat(n, new), of[new]


def rows_of_run(h: np.ndarray, offsets: np.ndarray, ids: np.ndarray, window: int, gram: int, many: int = MANY) -> pa.RecordBatch:
    """A slice's rows of its run; documents come in the order of their ids."""
    of, seed, digest, first, n = seeds_of(h, offsets, window, gram)
    new = firsts(digest)
    again = [(first[~new], n[~new], of[~new])]
    of, seed, digest, first, n = (x[new] for x in (of, seed, digest, first, n))
    keys, back, counts = np.unique(seed, return_inverse=True, return_counts=True)
    hot = counts[back] > many
    parts = [(seed[~hot].view(np.int64), SEED, digest[~hot].view(np.int64), of[~hot], first[~hot], n[~hot])]
    if hot.any():
        marks = keys[counts > many].view(np.int64)
        zero = np.zeros(len(marks), np.int64)
        at, doc = spread(first[hot], n[hot]), np.repeat(of[hot], n[hot])
        w = windows_at(h, at, window).view(np.int64)
        new, one = firsts(w), np.ones(len(at), np.int64)
        again.append((at[~new], one[~new], doc[~new]))
        parts += [(marks, MARK, zero, zero, zero + offsets[0], zero), (w[new], WINDOW, w[new], doc[new], at[new], one[new])]
    for place, m, doc in (stretches(*x) for x in again):
        parts.append((ids[doc], SETTLED, np.zeros(len(doc), np.int64), doc, place, m))
    k, d, doc, place, m = (np.concatenate([p[c] for p in parts]) for c in (0, 2, 3, 4, 5))
    kind = np.repeat(np.array([p[1] for p in parts], np.int32), [len(p[0]) for p in parts])
    columns = [k, kind, d, ids[doc] if len(ids) else k, (place - offsets[doc]).astype(np.int32), m.astype(np.int32)]
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["k", "kind", "d", "id", "start", "n"])


class Tables:
    """Tables hashed and sorted by a column, so that joins and groups on it need no exchange."""

    def __init__(self, spark: SparkSession, folder: str, parts: int | None = None):
        self.spark, self.folder, self.names = spark, folder, []
        self.parts = parts or max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))

    def write(self, df: DataFrame, by: str, sort: list[str], name: str | None = None) -> tuple[str, DataFrame]:
        """The table's name below the folder, and the table."""
        name = name or f"{by}-{uuid.uuid4().hex}"
        writer = df.repartition(self.parts, by).write.bucketBy(self.parts, by).sortBy(*sort).option("compression", "zstd").format("parquet")
        writer.option("path", f"{self.folder}/{name}").saveAsTable(self.registered(name))
        return name, self.spark.table(self.registered(name))

    def open(self, name: str, schema: str, by: str, sort: list[str]) -> DataFrame:
        """A table that an earlier session wrote."""
        self.spark.sql(f"create table {self.registered(name)} ({schema}) using parquet options (path '{self.folder}/{name}') clustered by ({by}) sorted by ({', '.join(sort)}) into {self.parts} buckets")
        return self.spark.table(self.registered(name))

    def registered(self, name: str) -> str:
        table = f"fieldloom_{name.replace('-', '_')}"
        if table not in self.names:
            self.names.append(table)
        return table

    def drop(self) -> None:
        """Takes the tables out of the catalogue; their files stay, and tables already read can still be."""
        for name in self.names:
            self.spark.sql(f"drop table if exists {name}")
        self.names = []


class WindowIndex:
    """Runs of all batches added so far, and their texts, in a folder.

    A folder that holds an index is opened with the settings that it was made with. Every ``add``
    writes new files and then names them in the manifest, so a batch that fails leaves the index
    as it was. One writer at a time."""

    def __init__(self, spark: SparkSession, folder: str, window: int = 20, gram: int = 5, fanout: int = 2, parts: int | None = None, hot: int = HOT, many: int = MANY):
        if not 0 < gram <= window:
            raise ValueError("a window holds at least one run of words")
        self.spark, self.folder, self.hot, self.many = spark, folder.rstrip("/"), hot, many
        found = read_text(spark, f"{self.folder}/manifest.json")
        told = json.loads(found) if found else {"window": window, "gram": gram, "fanout": fanout, "parts": parts, "hashes": HASHES, "levels": [], "texts": []}
        if told.get("hashes") != HASHES:
            raise ValueError(f"{self.folder}: its words are hashed in another way; make the index anew")
        self.window, self.gram, self.fanout = (told[x] for x in ("window", "gram", "fanout"))
        self.tables = Tables(spark, self.folder, told["parts"])
        self.levels = [[(n, self.tables.open(n, RUN, "k", ["kind", "k"])) for n in level] for level in told["levels"]]
        self.texts = [(n, self.tables.open(n, "id long, text binary", "id", ["id"])) for n in told["texts"]]
        self.old: list[str] = []  # files that are read no more
        self.spent: list[str] = []  # files that the batches' results are read from

    def add(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """Adds a batch and returns its covered windows: ``id, start, n`` for ``n`` windows from the word
        ``start`` on. Ids are whole numbers and name one text each, in this batch and earlier ones."""
        rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
        texts = self.tables.write(rows.mapInArrow(lean(pressed), "id long, text binary"), "id", ["id"])
        self.texts.append(texts)
        found = save(self.merge(texts[1]), "substring-added")
        self.compact()
        self.old, self.spent = self.old + self.spent, []
        self.close()
        return found

    def close(self) -> None:
        """Writes the manifest; files that it no longer names go."""
        told = {"window": self.window, "gram": self.gram, "fanout": self.fanout, "parts": self.tables.parts, "hashes": HASHES, "levels": [[n for n, _ in level] for level in self.levels], "texts": [n for n, _ in self.texts]}
        write_text(self.spark, f"{self.folder}/manifest.json", json.dumps(told))
        for name in self.old:
            delete(self.spark, f"{self.folder}/{name}")
        self.old = []

    def runs(self) -> list[DataFrame]:
        return [run for level in self.levels for _, run in level]

    def seeds(self, texts: DataFrame) -> DataFrame:
        window, gram, many = self.window, self.gram, self.many

        def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            unpress = zstandard.ZstdDecompressor()
            for whole in batches:
                for batch in slices(whole, limit=SLICE, sizes=opened_sizes(whole.column(1))):
                    batch = batch.take(pc.sort_indices(batch.column(0)))
                    h, counts = [np.zeros(0, np.uint64)], [np.zeros(1, np.int64)]
                    for part in slices(batch, limit=STEP, sizes=opened_sizes(batch.column(1))):
                        offsets, words = hashed_words(opened(part.column(1), unpress))
                        h.append(words)
                        counts.append(np.diff(offsets))
                    yield rows_of_run(np.concatenate(h), np.cumsum(np.concatenate(counts)), batch.column(0).to_numpy(), window, gram, many)

        return texts.select("id", "text").mapInArrow(lean(found), RUN)

    def merge(self, texts: DataFrame) -> DataFrame:
        """Writes the run of ``texts`` (``id, text``, pressed) and returns its covered windows. The texts are
        among ``self.texts`` already."""
        named = self.tables.write(self.seeds(texts), "k", ["kind", "k"])
        run, history = named[1], self.runs()

        def told(r: DataFrame, tag: str) -> DataFrame:
            rows, seed = r.where(F.col("kind") <= MARK), F.col("kind") == SEED
            return rows.groupBy("k").agg(F.min(F.when(seed, F.col("d"))).alias(f"lo{tag}"), F.max(F.when(seed, F.col("d"))).alias(f"hi{tag}"), F.count("*").alias(f"n{tag}"), F.max("kind").alias(f"mark{tag}"))

        flags = told(run, "")
        for i, old in enumerate(history):
            flags = flags.join(told(old, str(i)), "k", "left")
        tags = ["", *[str(i) for i in range(len(history))]]

        def over(f, name: str):
            return f(*[F.col(f"{name}{t}") for t in tags]) if history else F.col(name)

        total = sum((F.coalesce(f"n{t}", F.lit(0)) for t in tags), F.lit(0))
        seen = total > F.col("n")
        flags = flags.select("k", (over(F.greatest, "mark") == MARK).alias("mark"), (over(F.least, "lo") != over(F.greatest, "hi")).alias("differ"), seen.alias("seen"), total.alias("total")).where("total > 1")
        flags = flags.select("k", "seen", (F.col("mark") | F.coalesce("differ", F.lit(False))).alias("open"), (F.col("mark") | (F.col("total") > self.hot)).alias("hot"))
        flags = self.tables.write(flags, "k", ["k"])
        nth = F.row_number().over(Window.partitionBy("k", "d").orderBy("id", "start"))
        new = run.where(F.col("kind") == SEED).join(flags[1], "k").withColumn("nth", nth)
        state = F.when((F.col("nth") > 1) | (F.col("seen") & ~F.col("open")), 0).when(F.col("open"), 1)
        places = new.select("id", "k", "start", "n", "hot", state.alias("state")).where("state is not null")
        places = places.unionByName(run.where(F.col("kind") == SETTLED).select("id", "k", "start", "n", F.lit(False).alias("hot"), F.lit(0).alias("state")))
        for old in history:
            places = places.unionByName(old.where(F.col("kind") == SEED).join(flags[1].where("open"), "k").select("id", "k", "start", "n", "hot", F.lit(2).alias("state")))
        placed = self.tables.write(places, "id", ["id"])
        delete(self.spark, f"{self.folder}/{flags[0]}")
        self.spent.append(placed[0])
        wanted = placed[1].where("state > 0").groupBy("id").agg(F.collect_list(F.struct("k", "start", "n", "hot", "state")).alias("p"))
        rows = None
        for _, part in self.texts:
            found = part.select("id", "text").join(wanted, "id").select("id", "text", "p.k", "p.start", "p.n", "p.hot", "p.state").mapInArrow(lean(self.hashed()), "k long, old boolean, id long, start int, n int, windows binary")
            rows = found if rows is None else rows.unionByName(found)
        for r, old in [(run, False), *[(r, True) for r in history]]:
            held = r.where(F.col("kind") == WINDOW).select("k", F.lit(old).alias("old"), "id", "start", "n", F.lit(None).cast("binary").alias("windows"))
            rows = rows.unionByName(held)
        rows = rows.repartition(self.tables.parts, "k").sortWithinPartitions("k", F.col("old").desc(), "id", "start")
        judged = save(rows.mapInArrow(lean(judge), "id long, start int, n int"), "substring-covered")
        self.levels = [[*(self.levels[0] if self.levels else []), named], *self.levels[1:]]
        return placed[1].where("state = 0").select("id", "start", "n").unionByName(judged)

    def hashed(self):
        window = self.window

        def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            unpress = zstandard.ZstdDecompressor()
            for whole in batches:
                for batch in slices(whole, limit=STEP, sizes=opened_sizes(whole.column(1))):
                    offsets, words = hashed_words(opened(batch.column(1), unpress))
                    counts = pc.list_value_length(batch.column(2)).to_numpy()
                    k, start, n, hot, state = (c.flatten().to_numpy(zero_copy_only=False) for c in batch.columns[2:])
                    ids, first = np.repeat(batch.column(0).to_numpy(), counts), np.repeat(offsets[:-1], counts) + start
                    n = n.astype(np.int64)
                    line = Stretches(words)
                    yield batch_of(k[~hot], state[~hot], ids[~hot], start[~hot], n[~hot], line.of(spread(first[~hot], n[~hot]), window))
                    if hot.any():
                        m, w = n[hot], line.of(spread(first[hot], n[hot]), window)
                        at = spread(start[hot].astype(np.int64), m)
                        yield batch_of(w.view(np.int64), np.repeat(state[hot], m), np.repeat(ids[hot], m), at, np.ones(len(at), np.int64), None)

        return windows

    def compact(self) -> None:
        """Merges every full level into one run of the next, with one row for equal digests and windows."""
        level = 0
        while level < len(self.levels) and len(self.levels[level]) >= self.fanout:
            whole = None
            for _, run in self.levels[level]:
                rows = run.where(F.col("kind") != SETTLED)
                whole = rows if whole is None else whole.unionByName(rows)
            place = F.min(F.struct("id", "start", "n"))
            whole = whole.groupBy("k", "kind", "d").agg(place.alias("p")).select("k", "kind", "d", "p.id", "p.start", "p.n")
            self.old += [n for n, _ in self.levels[level]]
            merged = self.tables.write(whole, "k", ["kind", "k"])
            self.levels[level] = []
            if level + 1 == len(self.levels):
                self.levels.append([])
            self.levels[level + 1].append(merged)
            level += 1


def batch_of(k, state, ids, start, n, w: np.ndarray | None) -> pa.RecordBatch:
    if w is None:
        windows = pa.nulls(len(k), pa.binary())
    else:
        ends = np.concatenate(([0], np.cumsum(n * 8))).astype(np.int32)
        windows = pa.Array.from_buffers(pa.binary(), len(k), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(w))])
    columns = [pa.array(k), pa.array(state == 2), pa.array(ids), pa.array(start.astype(np.int32)), pa.array(n.astype(np.int32)), windows]
    return pa.RecordBatch.from_arrays(columns, ["k", "old", "id", "start", "n", "windows"])


def pressed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The texts, in the column ``text``, pressed."""
    press = zstandard.ZstdCompressor(level=3)
    for whole in batches:
        at = whole.schema.get_field_index("text")
        for batch in slices(whole):
            text = pa.array([None if t is None else press.compress(t.encode("utf-8")) for t in batch.column(at).to_pylist()], pa.binary())
            yield batch.set_column(at, "text", text)


def opened(packed: pa.Array, unpress: zstandard.ZstdDecompressor) -> list[bytes | None]:
    return [None if t is None else unpress.decompress(t) for t in packed.to_pylist()]


def opened_sizes(packed: pa.Array) -> np.ndarray:
    """Bytes of each text as it is when opened, which its pressed form tells at its beginning."""
    return np.array([0 if t is None else zstandard.frame_content_size(t) for t in pc.binary_slice(packed, 0, 18).to_pylist()], np.int64)


def add(columns: list[list], *values) -> None:
    for column, value in zip(columns, values, strict=True):
        column.append(value)


def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Reads rows in the order of key, earlier batches first, id and start, and puts out the windows of
    this batch that were met before under their key. Without hashes, the key is the window."""
    key, seen, wholes = None, set(), set()
    for batch in batches:
        out = [[] for _ in range(3)]
        for k, old, doc, start, n, windows in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if k != key:
                key, seen, wholes = k, set(), set()
            if windows in wholes:
                if not old:
                    add(out, doc, start, n)
                continue
            wholes.add(windows)
            if windows is None:
                continue
            parts = [windows[i : i + 8] for i in range(0, len(windows), 8)]
            if old or seen.isdisjoint(parts) and len(set(parts)) == len(parts):
                seen.update(parts)
                continue
            for i, part in enumerate(parts):
                if part in seen:
                    add(out, doc, start + i, 1)
                seen.add(part)
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int32(), pa.int32()), strict=True)], ["id", "start", "n"])


def repeats(docs: DataFrame, window: int, gram: int, batches: int, fanout: int, hot: int, many: int) -> tuple[DataFrame, DataFrame]:
    """The rows (``doc_id, text, rest``) as a table by id, and their covered windows as ``id, spans``."""
    spark = docs.sparkSession
    index = WindowIndex(spark, new_path(spark, "substring"), window, gram, fanout, hot=hot, many=many)
    rows, twice = numbered(docs, "id")
    rest = docs.schema["rest"].dataType.simpleString()
    name, table = index.tables.write(rows.select("id", "doc_id", "text", "rest").mapInArrow(lean(pressed), f"id long, doc_id long, text binary, rest {rest}"), "id", ["id"])
    texts = table.select("id", "text")
    if twice:  # equal rows are one document; the table is dealt by id, so nothing moves
        texts = texts.withColumn("nth", F.row_number().over(Window.partitionBy("id").orderBy("id"))).where("nth = 1").select("id", "text")
    cuts = sorted({int(x) for x in table.approxQuantile("id", [k / batches for k in range(1, batches)], 0.01)}) if batches > 1 else []
    covered = None
    for low, high in zip([None, *cuts], [*cuts, None], strict=True):
        part = texts if low is None else texts.where(F.col("id") > low)
        part = part if high is None else part.where(F.col("id") <= high)
        index.texts.append((name, part))
        found = index.merge(part)
        covered = found if covered is None else covered.unionByName(found)
        if high is not None:
            index.compact()
    spans = covered.groupBy("id").agg(F.collect_list(F.struct("start", "n")).alias("spans"))
    index.tables.drop()
    for run in index.old + [n for level in index.levels for n, _ in level]:
        delete(spark, f"{index.folder}/{run}")
    return table, spans


def remove_repeats(docs: DataFrame, window: int = 20, gram: int = 5, batches: int = 4, fanout: int = 2, id_col: str = "doc_id", text_col: str = "text", carried: tuple[str, ...] = (), with_text: bool = True, hot: int = HOT, many: int = MANY) -> DataFrame:
    """``doc_id, n_words, n_removed, kept_sha256, kept_text, rest`` of every row. ``kept_sha256`` is of the
    kept words joined by a space. The table is taken in ``batches`` of about equal size by ascending
    id; ``kept_text`` is the text without the removed words and the white space after them; ``rest``
    has the ``carried`` columns as they were. Without ``with_text``, ``kept_text`` is null."""
    rest = F.struct(*[F.col(c) for c in carried]) if carried else F.lit(None).cast("boolean")
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), rest.alias("rest"))
    texts, spans = repeats(docs, window, gram, batches, fanout, hot, many)

    def cut(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpress = zstandard.ZstdDecompressor()
        for whole in parts:
            for begin in range(0, whole.num_rows, 200):
                batch = whole.slice(begin, 200)
                out = [[] for _ in range(4)]
                for packed, starts, n in zip(*(batch.column(k).to_pylist() for k in (1, 2, 3)), strict=True):
                    text = None if packed is None else unpress.decompress(packed)
                    words = (text or b"").split()  # at the six white-space bytes
                    kept, left = words, text if with_text else None
                    if starts:
                        edge = np.zeros(len(words) + 1, np.int64)
                        np.add.at(edge, np.array(starts), 1)
                        np.add.at(edge, np.array(starts) + np.array(n) + window - 1, -1)
                        keep = (np.cumsum(edge)[:-1] == 0).tolist()
                        kept = [*compress(words, keep)]
                        if with_text:
                            spans = [m.span() for m in WORDS.finditer(text)]
                            ends = [s for s, _ in spans[1:]] + [len(text)]
                            left = text[: spans[0][0]] + b"".join([text[s:e] for (s, _), e, k in zip(spans, ends, keep, strict=True) if k])
                    add(out, len(words), len(words) - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest(), left)
                types = [pa.int64(), pa.int64(), pa.string(), pa.binary()]
                columns = [pa.array(c, t) for c, t in zip(out, types, strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0), *columns[:3], columns[3].cast(pa.string()), batch.column(4)], ["doc_id", "n_words", "n_removed", "kept_sha256", "kept_text", "rest"])

    rows = texts.join(spans, "id", "left").select("doc_id", "text", "spans.start", "spans.n", "rest")
    return rows.mapInArrow(lean(cut), f"doc_id long, n_words long, n_removed long, kept_sha256 string, kept_text string, rest {docs.schema['rest'].dataType.simpleString()}")
