"""Operator 7: near-duplicate documents by MinHash bands, odd sketches and full sets.

Texts with equal shingle sets are one node from the start. A node's MinHash samples are banded;
nodes that agree on a band are candidates. The samples are also folded into a bitmap of
parities: two bitmaps differ in about 256 (1 - exp(-d / 256)) of their 512 bits if d sample
values differ, so the count of differing bits tells apart at a few instructions a pair what the
bands let through. What passes is confirmed on the full sets.

Every member of a bucket is compared with the bucket's leader; pairs that pass make families.
Where members are left whose family is not the leader's and their bucket is large, one of them
leads in a further round, for LEADER_ROUNDS rounds, each a row a member. What is left then is
compared in blocks of bitmaps, from which only pairs of families leave. So every pair that shares a
band and passes lies inside one family.

A family's full sets then meet in blocks: a set is marked and counted in all sets of the block
at once, and only a spanning forest of the confirmed links leaves. A family of several blocks
sends some of its members, the LEADERS, to all of them, which as a rule ties the blocks together;
only members that are not tied to the family's first go on to meet every block. No pair is
written at any stage.

With 28 bands of 4, a pair at similarity 0.8 shares no band with probability 4e-7; the bound on
differing bits lies six deviations beyond that similarity.

Cases: null texts and texts without words are linked with nothing; a text of fewer words than a
shingle is one shingle; equal texts have one component whatever their ids, named by the smallest
id reachable; two texts that go by one smallest id are one node; a null id names none: such a row
has its text's component, or null if no id reaches it, and then stays; an empty table gives no
rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldloom.llm.common import chained, hashes_of, lean, mixed, odd_numbers, save, slices, words_of
from fieldloom.plans.components import components

BANDS, PER_BAND, BITS = 28, 4, 512
SAMPLES = BANDS * PER_BAND
#: Differing bits up to which a pair may be 0.8 similar (mean 41, see the module's text).
MOST_BITS = 84
FACTORS = odd_numbers(71, SAMPLES)[:, None]
BLOCK = 4096
#: Sets in a block of a family, and bitmaps in a block of a bucket.
BLOCK_SETS, BLOCK_BITMAPS = 512, 8192
#: Rounds in which members of a bucket that aren't alike the leader get one of their own, where some
#: bucket is larger than a block.
LEADER_ROUNDS = 2
#: Members of a family that all of its blocks get.
LEADERS = 16
#: Ids up to which a table of them is sent to all tasks, at 24 bytes each.
SENT_IDS = 500_000


def shingle_set(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes, ascending, of the distinct ``n``-word shingles; of the whole if there are fewer words."""
    if not len(words):
        return words
    return np.unique(chained(words, min(n, len(words)), 70 if len(words) >= n else 700 + len(words)))


def samples(shingles: np.ndarray) -> np.ndarray:
    out = np.full(SAMPLES, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(shingles), BLOCK):
        np.minimum(out, (FACTORS * shingles[None, at : at + BLOCK]).min(axis=1), out=out)
    return out


def bands_and_sketches(lows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each row of samples: a hash for every band, and the bitmap as eight numbers."""
    n = len(lows)
    bands = np.zeros((n, BANDS), np.uint64)
    for k, factor in enumerate(odd_numbers(72, PER_BAND)):
        bands += mixed(lows.reshape(n, BANDS, PER_BAND)[:, :, k]) * factor
    bands = mixed(bands + np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    bit = (mixed(lows + np.arange(SAMPLES, dtype=np.uint64) * np.uint64(0xA24BAED4963EE407)) % np.uint64(BITS)).astype(np.int64)
    hits = np.bincount((bit + np.arange(n)[:, None] * BITS).ravel(), minlength=n * BITS).reshape(n, BITS)
    return bands.view(np.int64), np.packbits((hits & 1).astype(np.uint8), axis=1).view(np.int64)


def lists(values: np.ndarray) -> pa.Array:
    n, width = values.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * width), pa.array(values.ravel()))


def signatures(docs: DataFrame, shingle: int) -> DataFrame:
    """``doc_id, n, k1, k2, bands, sketch``; the key (k1, k2) tells shingle sets apart."""

    def signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole):
                offsets, codes, distinct = words_of(batch.column(1), lower=True)
                h = hashes_of(distinct)[codes]
                sets = [shingle_set(h[a:b], shingle) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
                keys = np.array([divmod(xxhash.xxh3_128_intdigest(s.tobytes()), 1 << 64) for s in sets], np.uint64).reshape(len(sets), 2).view(np.int64)
                bands, sketch = bands_and_sketches(np.array([samples(s) for s in sets], np.uint64).reshape(len(sets), SAMPLES))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array(keys[:, 0].copy()), pa.array(keys[:, 1].copy()), lists(bands), lists(sketch)],
                    ["doc_id", "n", "k1", "k2", "bands", "sketch"],
                )

    return docs.mapInArrow(lean(signed), "doc_id long, n long, k1 long, k2 long, bands array<long>, sketch array<long>")


def alike(a: str, b: str, threshold: float) -> Column:
    """What a pair of nodes must meet to be worth confirming: sizes and differing bits."""
    bits = sum((F.bit_count(F.col(f"{a}.sketch")[i].bitwiseXOR(F.col(f"{b}.sketch")[i])) for i in range(BITS // 64)), F.lit(0))
    sizes = F.least(f"{a}.n", f"{b}.n") >= F.greatest(f"{a}.n", f"{b}.n") * F.lit(threshold - 1e-9)
    return sizes & (bits <= MOST_BITS)


def linked(sets: list[np.ndarray], first: np.ndarray, second: np.ndarray, same: bool, hundredths: int) -> list[tuple[int, int]]:
    """A spanning forest of the links between the sets ``first`` and ``second`` (indices; one block twice
    if ``same``). Each set of the first is marked and counted in all sets of the second at once."""
    root = np.arange(len(sets))
    size = np.array([len(s) for s in sets])
    if not len(first) or not len(second):
        return []
    line = np.concatenate([sets[j] for j in second])
    order = np.unique(line)
    line, starts = np.searchsorted(order, line), np.cumsum(size[second]) - size[second]
    mark, out = np.zeros(len(order), np.int64), []
    for k, i in enumerate(first):
        at = np.searchsorted(order, sets[i])
        at = at[(at < len(order)) & (order[np.minimum(at, len(order) - 1)] == sets[i])]
        mark[at] = 1
        from_ = k + 1 if same else 0
        if from_ < len(second):
            common = np.add.reduceat(mark[line[starts[from_] :]], starts[from_:] - starts[from_])
            near = second[from_:][100 * common >= hundredths * (size[i] + size[second[from_:]] - common)]
            for j in near[root[near] != root[i]]:
                if root[j] != root[i]:
                    out.append((i, j))
                    root[root == root[j]] = root[i]
        mark[at] = 0
    return out


def chosen(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """``text`` beside the columns of ``ids`` (``id, ...``), of which there are few enough to send, or else by a
    shuffle."""
    few = ids.count() <= SENT_IDS
    return docs.withColumnRenamed("doc_id", "id").join(F.broadcast(ids) if few else ids, "id")


def sets_of(texts: DataFrame, shingle: int) -> DataFrame:
    """``shingles`` in place of the text."""
    others = [c for c in texts.columns if c != "text"]

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole):
                offsets, codes, distinct = words_of(batch.column(0), lower=True)
                h = hashes_of(distinct)[codes]
                out = [shingle_set(h[a:b], shingle).tobytes() for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary()), *batch.columns[1:]], ["shingles", *others])

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in texts.select(*others).schema.fields)
    return texts.select("text", *others).mapInArrow(lean(sets), f"shingles binary, {kinds}")


def joined_within(families: DataFrame, docs: DataFrame, shingle: int, threshold: float) -> DataFrame:
    """``node, component`` over the links of all pairs of similar full sets within each family (``id, family``)."""
    hundredths = round(threshold * 100)

    def compared(group: pa.Table) -> pa.Table:
        ids, first, second = (group.column(c).to_numpy() for c in ("id", "first", "second"))
        first, second = np.flatnonzero(first), np.flatnonzero(second)
        pairs = linked([np.frombuffer(x, np.uint64) for x in group.column("shingles").to_pylist()], first, second, len(first) == len(second) == len(ids), hundredths)
        ends = [[int(ids[k]) for k in side] for side in ([i for i, _ in pairs], [j for _, j in pairs])]
        return pa.table({"a": pa.array(ends[0], pa.int64()), "b": pa.array(ends[1], pa.int64())})

    def links(places: DataFrame) -> DataFrame:
        """Of ``id, family, at``: ``at`` are the groups ``(p, q)`` that the set goes to, and its sides there."""
        sent = sets_of(chosen(docs, places), shingle).select("id", "family", "shingles", F.explode("at").alias("at")).select("id", "family", "shingles", "at.*")
        return sent.groupBy("family", "p", "q").applyInArrow(compared, "a long, b long")

    def place(p, q, first: bool, second: bool) -> Column:
        return F.struct(p.cast("int").alias("p"), q.cast("int").alias("q"), F.lit(first).alias("first"), F.lit(second).alias("second"))

    leads = [F.min(F.struct(F.xxhash64("id", F.lit(k)), "id"))["id"] for k in range(1, LEADERS)]
    sizes = families.groupBy("family").agg(F.ceil(F.count("*") / BLOCK_SETS).cast("int").alias("blocks"), F.array_distinct(F.array(F.min("id"), *leads)).alias("leaders"))
    sizes = save(sizes.select("family", "blocks", F.when(F.col("blocks") > 1, F.col("leaders")).otherwise(F.array().cast("array<long>")).alias("leaders")), "near-blocks")
    placed = families.join(sizes, "family").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    every = F.sequence(F.lit(0), F.col("blocks") - 1)
    at = F.when(F.array_contains("leaders", F.col("id")), F.transform(every, lambda b: place(b, b, True, True))).otherwise(F.array(place(F.col("block"), F.col("block"), True, True)))
    tied = save(components(save(links(placed.select("id", "family", at.alias("at"))), "near-links")), "near-tied")

    of_large = placed.where("blocks > 1").select("id", "family", "blocks", "block").join(tied.withColumnRenamed("node", "id"), "id", "left")
    large = save(of_large.withColumn("loose", F.coalesce("component", "id") != F.col("family")), "near-large")  # a family is named by its first member
    loose = save(large.groupBy("family").agg(F.count_if("loose").alias("n")).where("n > 0").select("family", F.ceil(F.col("n") / BLOCK_SETS).cast("int").alias("others")), "near-loose")
    if loose.isEmpty():
        return tied
    rows = large.join(loose, "family").withColumn("other", F.pmod(F.xxhash64("id", F.lit(3)), F.col("others")).cast("int"))
    as_first = F.when(F.col("loose"), F.transform(every, lambda q: place(F.col("other"), q, True, False))).otherwise(F.array().cast("array<struct<p:int,q:int,first:boolean,second:boolean>>"))
    as_second = F.transform(F.sequence(F.lit(0), F.col("others") - 1), lambda p: place(p, F.col("block"), False, True))
    rows = rows.select("id", "family", F.concat(as_first, as_second).alias("at"))
    more = links(rows).unionByName(tied.select(F.col("node").alias("a"), F.col("component").alias("b")))
    return save(components(save(more, "near-links")), "near-joined")


def apart_in_buckets(rows: DataFrame, threshold: float) -> DataFrame:
    """``a, b``: families that a pair of likely alike members of a bucket (``band, members, id, c, n, sketch``)
    joins. The bitmaps of buckets of many ``members`` meet in pairs of blocks."""
    placed = rows.withColumn("blocks", F.ceil(F.col("members") / BLOCK_BITMAPS).cast("int")).withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    other = F.sequence(F.lit(0), F.col("blocks") - 1)
    pairs = F.transform(other, lambda o: F.struct(F.least("block", o).alias("p"), F.greatest("block", o).alias("q")))
    placed = placed.select("band", "block", "c", "n", "sketch", F.explode(pairs).alias("at")).select("band", "at.p", "at.q", "block", "c", "n", "sketch")

    def crossed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            table = table if kept is None else pa.concat_tables([kept, table]).combine_chunks()
            keys = np.stack([table.column(k).to_numpy() for k in ("band", "p", "q")])
            cuts = np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1
            last = int(cuts[-1]) if len(cuts) else 0
            kept = table.slice(last)
            yield families(table, [0, *cuts])
        if kept is not None:
            yield families(kept, [0, kept.num_rows])

    def families(table: pa.Table, cuts: list[int]) -> pa.RecordBatch:
        block, c, n, p = (table.column(k).to_numpy() for k in ("block", "c", "n", "p"))
        bits = table.column("sketch").combine_chunks().flatten().to_numpy().view(np.uint64).reshape(-1, BITS // 64) if table.num_rows else np.zeros((0, BITS // 64), np.uint64)
        out = [np.zeros((0, 2), np.int64)]
        for low, high in zip(cuts[:-1], cuts[1:], strict=True):
            if (c[low:high] == c[low]).all():
                continue
            inside = np.arange(low, high)
            first = inside[block[low:high] == p[low]] if (block[low:high] != p[low]).any() else inside
            second = inside if len(first) == len(inside) else inside[block[low:high] != p[low]]
            step = max(1, (1 << 18) // len(second))
            for k in range(0, len(first), step):
                i = first[k : k + step, None]
                near = (c[i] != c[second]) & (np.minimum(n[i], n[second]) >= np.maximum(n[i], n[second]) * (threshold - 1e-9))
                a, b = np.nonzero(near)
                a, b = first[k + a], second[b]
                ok = np.bitwise_count(bits[a] ^ bits[b]).sum(axis=1, dtype=np.int64) <= MOST_BITS
                out.append(np.unique(np.sort(np.stack((c[a[ok]], c[b[ok]]), axis=1), axis=1), axis=0))
        found = np.unique(np.concatenate(out), axis=0)
        return pa.RecordBatch.from_arrays([pa.array(found[:, 0]), pa.array(found[:, 1])], ["a", "b"])

    parts = placed.repartition("band", "p", "q").sortWithinPartitions("band", "p", "q")
    return parts.mapInArrow(lean(crossed), "a long, b long").distinct()


def near_duplicates(docs: DataFrame, shingle: int = 5, threshold: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_shingles, component_id, kept``: the smallest id reachable over links, and whether
    that is the row's own. ``threshold`` is a whole number of hundredths, 0.8 or more."""
    if threshold < 0.8:
        raise ValueError("bands and sketches are laid out for a similarity of 0.8 or more")
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    signed = save(signatures(docs, shingle), "near-signatures")
    full = signed.where("n > 0 and doc_id is not null")
    lowest = full.groupBy("k1", "k2").agg(F.min("doc_id").alias("doc_id"))
    nodes = save(full.join(lowest, ["doc_id", "k1", "k2"]).dropDuplicates(["doc_id", "k1", "k2"]).withColumnRenamed("doc_id", "id"), "near-nodes")
    bands = nodes.select("id", F.explode("bands").alias("band"))
    mask = F.col("band").bitwiseAND(F.lit(2**62 - 1))  # orders ids differently in each bucket
    buckets = bands.groupBy("band").agg(F.count("*").alias("members"), F.min(F.col("id").bitwiseXOR(mask)).alias("m")).where("members > 1")
    buckets = save(buckets.select("band", "members", F.col("m").bitwiseXOR(mask).alias("leader")), "near-buckets")
    members = save(bands.join(buckets, "band"), "near-members")
    sketches = nodes.select("id", "n", "sketch")
    to_leader = members.where("id != leader").select("id", "leader").distinct()
    passed = (
        to_leader.join(sketches.alias("p").withColumnRenamed("id", "pid"), F.col("id") == F.col("pid"))
        .join(sketches.alias("q").withColumnRenamed("id", "qid"), F.col("leader") == F.col("qid"))
        .where(alike("p", "q", threshold))
    )
    passed = save(passed.select(F.col("id").alias("a"), F.col("leader").alias("b")), "near-passed")
    family = save(components(passed), "near-families")

    # likely pairs of a bucket that its leader doesn't bring into one family
    open_ = members.where("members > 2 and id != leader").select("band", "id", "leader", "members")
    for turn in range(LEADER_ROUNDS + 1):
        of = open_.join(family.withColumnRenamed("node", "id"), "id", "left")
        of = of.join(family.select(F.col("node").alias("leader"), F.col("component").alias("lc")), "leader", "left")
        of = save(of.select("band", "id", F.coalesce("component", "id").alias("c"), F.coalesce("lc", "leader").alias("lc"), "members"), "near-open")
        left = of.where("c != lc").groupBy("band").agg(F.min(F.struct(F.xxhash64("id", "band", F.lit(turn)), "id", "c")).alias("lead"), F.max("members").alias("most"))
        left = save(left.select("band", F.col("lead.id").alias("leader"), F.col("lead.c").alias("lead_c"), "most"), "near-left")
        most = left.agg(F.max("most")).first()[0]
        if most is None:
            break
        inside = of.join(left.drop("most"), "band")
        last = turn == LEADER_ROUNDS or most <= BLOCK_BITMAPS
        if last:
            crossed = apart_in_buckets(inside.join(sketches, "id").select("band", "members", "id", "c", "n", "sketch"), threshold)
        else:
            pairs = inside.where("c != lead_c").select("id", "leader", "c", "lead_c").distinct()
            pairs = pairs.join(sketches.withColumnRenamed("id", "pid").alias("p"), F.col("id") == F.col("pid")).join(sketches.withColumnRenamed("id", "qid").alias("q"), F.col("leader") == F.col("qid"))
            crossed = pairs.where(alike("p", "q", threshold)).select(F.col("c").alias("a"), F.col("lead_c").alias("b")).distinct()
        crossed = save(crossed, "near-crossed")
        if not crossed.isEmpty():
            passed = passed.unionByName(crossed)
            family = save(components(passed), "near-families")
        if last:
            break
        open_ = inside.where("id != leader").select("band", "id", "leader", "members")
    joined = joined_within(family.select(F.col("node").alias("id"), F.col("component").alias("family")), docs, shingle, threshold)

    of_key = save(nodes.select("k1", "k2", "id").join(joined.withColumnRenamed("node", "id"), "id", "left").select("k1", "k2", F.coalesce("component", "id").alias("component")), "near-keys")
    of_key = of_key.groupBy("k1", "k2").agg(F.min("component").alias("component"))
    of_key = save(of_key, "near-keys")
    rows = signed.select("doc_id", "n", "k1", "k2").join(of_key, ["k1", "k2"], "left")
    component = F.when(F.col("n") > 0, F.coalesce("component", "doc_id")).otherwise(F.col("doc_id"))
    return rows.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), component.eqNullSafe(F.col("doc_id")).alias("kept"))
