import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import zstandard
from tokenizers import Tokenizer

from fieldloom.llm import mixing, packing, sharding, token_count
from fieldloom.llm.queries import op1_token_counts, op2_packing, op4_mixing, op6_sharding
from tests.llm.helpers import awkward, frame

SF = "/root/testdata/sf0.001"


def texts(spark):
    return {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


def test_token_counts_match_the_library(spark):
    path = public_tokenizers.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    rows = awkward()
    got = token_count.count_tokens(frame(spark, rows), path).collect()
    want = Counter((r[0], len((r[1] or "").encode()), len(library.encode(r[1] or "", add_special_tokens=False).ids)) for r in rows)
    assert Counter((r.doc_id, r.n_bytes, r.n_tokens) for r in got) == want
    assert all(r.over_limit == (r.n_tokens > 512) for r in got)
    assert token_count.count_tokens(frame(spark, []), path).count() == 0
    docs = texts(spark)
    for r in op1_token_counts(spark, SF).collect():
        assert r.n_tokens == len(library.encode(docs[r.doc_id], add_special_tokens=False).ids)


def test_merging_takes_the_lowest_rank_then_the_leftmost():
    merger = token_count.merger(public_tokenizers.path("byte_bpe_50k.json"))
    assert merger.merged("the") == 1
    assert merger.merged("") == 0
    assert merger.count("<|endoftext|>a<|endoftext|>") == 3


def check_packing(rows, docs, library, length):
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
    for doc, text in docs.items():
        ids = np.array([*library.encode(text, add_special_tokens=False).ids, 2], "<u4")
        at = 0
        for r in sorted(by_doc[doc], key=lambda r: r.start):
            assert (r.start, r.doc_tokens) == (at, len(ids))
            assert r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
    for s, pieces in by_sequence.items():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at == length if s < len(by_sequence) - 1 else 0 < at <= length
    assert sorted(by_sequence) == list(range(len(by_sequence)))


def test_packing_steps():
    """A batch of many ids leaves in batches of a few MB, with every piece."""
    ids = np.arange(4000, dtype="<u4")
    press = zstandard.ZstdCompressor().compress(ids.tobytes())
    n = 1500
    batch = pa.RecordBatch.from_arrays([pa.array(range(n)), pa.array(np.arange(n) * 4000), pa.array([4000] * n), pa.array([press] * n)], ["doc_id", "begin", "n_ids", "ids"])
    out = [*packing.pieces(iter([batch]), 4096)]
    assert max(b.nbytes for b in out) < 6 << 20 and sum(x for b in out for x in b.column("length").to_pylist()) == 4000 * n
    assert [*packing.pieces(iter([batch.slice(0, 0)]), 4096)] == []


def test_packing_table_of_parts_is_bounded(monkeypatch):
    """The words' parts that a worker keeps are few, and ids are the library's all the same."""
    monkeypatch.setattr(packing, "KEPT_PARTS", 5)
    path = public_tokenizers.path("word_bpe_49k.json")
    library, lookup = Tokenizer.from_file(path), packing.WordIds(path)
    words = [f"{a}{b}" for a in ("river", "Stone", "it's") for b in ("", ",", "ly", "ness.", "9")]
    for text in (" ".join(words), " ".join(reversed(words))):
        assert lookup.ids([text]) == [np.array(library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()]
        assert len(lookup.parts) <= 5


def test_packing(spark):
    path = public_tokenizers.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    check_packing(op2_packing(spark, SF).collect(), texts(spark), library, 4096)
    rows = awkward()
    single = {r[0]: r for r in rows}
    got = packing.pack(frame(spark, list(single.values())), path, length=100).collect()
    check_packing(got, {k: r[1] or "" for k, r in single.items()}, library, 100)
    assert all(zlib.crc32(r.ids) == r.ids_crc32 and len(r.ids) == 4 * r.length for r in got)
    twice = packing.pack(frame(spark, rows), path, length=100).collect()
    assert sum(r.length for r in twice) == sum(r.length for r in got) + 2 * single[rows[-1][0]][1].count("\0") + 2 * next(r.doc_tokens for r in got if r.doc_id == rows[-1][0])
    assert packing.pack(frame(spark, []), path).count() == 0


def brute_targets(sizes, weights, share, most):
    """Shares the total by weight among the sources below their limits, until none is above."""
    out, open_ = [0.0] * len(sizes), {i for i, n in enumerate(sizes) if n}
    left = share * sum(sizes)
    while open_:
        each = left / sum(weights[i] for i in open_)
        full = {i for i in open_ if each * weights[i] >= most * sizes[i]}
        if not full:
            for i in open_:
                out[i] = each * weights[i]
            break
        for i in full:
            out[i] = most * sizes[i]
            left -= out[i]
        open_ -= full
    return out


@pytest.mark.parametrize("sizes", [[10, 10, 100], [100, 100, 100, 100], [100, 900, 50, 0], [7], [0, 0], [*range(1, 60)], [5000, *[1] * 30]])
def test_targets_share_the_excess_by_weight(spark, sizes):
    names = [f"s{i:02}" for i in range(len(sizes) - 1)] + [None]  # null is the last
    found = spark.createDataFrame(list(zip(names, sizes, strict=True)), "source string, total long").repartition(3)
    got = {r.source: r.target for r in mixing.targets(found, [5.0, 2.0, 1.0], 1.5, 2.0).collect()}
    want = brute_targets(sizes, [[5, 2, 1][i % 3] for i in range(len(sizes))], 1.5, 2.0)
    assert [got[n] for n in names] == pytest.approx(want)


@pytest.mark.parametrize(("table", "off"), [("sf0.001", 0.04), ("sf0.01", 0.005)])  # ten and fifty documents a source
def test_mixing(spark, table, off):
    d = f"/root/testdata/{table}"
    rows = op4_mixing(spark, d).collect()
    again = op4_mixing(spark, d).collect()
    assert Counter(rows) == Counter(again)
    docs = {r.doc_id: r for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    sizes = {i: len(re.findall(r"[^\x20\x09-\x0D]+", r.text or "")) for i, r in docs.items()}
    total, taken = Counter(), Counter()
    for i, r in docs.items():
        total[r.source] += sizes[i]
    names = sorted(total, key=lambda s: (s is None, (s or "").encode()))
    aims = dict(zip(names, brute_targets([total[s] for s in names], [[5, 2, 1][k % 3] for k in range(len(names))], 1.5, 2.0), strict=True))
    assert sorted(r.doc_id for r in rows) == sorted(docs)
    for r in rows:
        source = docs[r.doc_id].source
        rate = aims[source] / total[source] if total[source] else 0
        assert (r["size"], r.source_size) == (sizes[r.doc_id], total[source]) and r.target == pytest.approx(aims[source])
        assert r.taken in (r["size"] * math.floor(rate + 1e-9), r["size"] * math.ceil(rate - 1e-9))
        taken[source] += r.taken
    assert sum(abs(taken[s] - aims[s]) for s in names) < off * sum(aims.values())
    largest = {s: max(sizes[i] for i, r in docs.items() if r.source == s) for s in names}
    assert all(abs(taken[s] - aims[s]) <= largest[s] for s in names)


def test_mixing_tree_and_cases(spark):
    rows = awkward(1, 400)
    docs = frame(spark, rows)
    got = mixing.mix(docs, group_rows=8, share=1.2).collect()  # several levels
    assert len(got) == len(rows)
    assert Counter(r.doc_id for r in got) == Counter(r[0] for r in rows)
    assert all(r.copies == 0 for r in got if r["size"] == 0)
    taken, aims, largest = Counter(), {}, defaultdict(int)
    for r in got:
        taken[r.source] += r.copies * r["size"]
        aims[r.source] = r.target
        largest[r.source] = max(largest[r.source], r["size"])
    for source, aim in aims.items():
        assert abs(taken[source] - aim) <= largest[source] + 1e-6
    assert Counter(got) == Counter(mixing.mix(docs.repartition(7), group_rows=8, share=1.2).collect())
    mixed = mixing.mixed_rows(docs, group_rows=8, share=1.2)
    assert mixed.columns == docs.columns
    assert Counter(r.doc_id for r in mixed.collect()) == Counter({k: n for k in {r.doc_id for r in got} if (n := sum(r.copies for r in got if r.doc_id == k))})
    assert mixing.mix(frame(spark, [])).count() == 0


def test_rounding_keeps_expectations():
    import pyarrow as pa

    total = np.zeros(5)
    for seed in range(3000):
        group = pa.table({"size": [3, 5, 8, 13, 21], "mark": list("abcde"), "chance": [0.3] * 5})
        out = mixing.round_group(group, seed)
        assert sum(0 < c < 1 for c in out["chance"].to_pylist()) <= 1
        assert np.dot(out["size"], out["chance"]) == pytest.approx(15)
        total += out["chance"].to_numpy()
    assert np.abs(total / 3000 - 0.3).max() < 0.04


def check_shards(rows, shards):
    loads, slots = Counter(), defaultdict(list)
    for r in rows:
        loads[r.shard] += r.size
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert all(0 <= s < shards for s in slots)
    return [loads[s] for s in range(shards)]


def test_sharding(spark):
    rows = op6_sharding(spark, "/root/testdata/sf0.01").collect()
    loads = check_shards(rows, 16)
    mean = sum(loads) / 16
    assert max(loads) < 1.03 * mean and min(loads) > 0.96 * mean
    docs = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    where = defaultdict(set)
    for r in rows:
        assert r.size == len(docs[r.doc_id].encode()) + 1 and r.text_crc32 == zlib.crc32(docs[r.doc_id].encode())
        where[docs[r.doc_id]].add(r.shard)
    assert all(len(s) == 1 for s in where.values())


def test_sharding_by_a_walk_of_the_ring(spark):
    """Every row's shard, by walking the ring place by place in plain loops."""
    import hashlib

    d = "/root/testdata/sf0.01"
    shards, nodes, bits = 16, 64, 14
    got = {r.doc_id: r.shard for r in op6_sharding(spark, d).collect()}
    rows = spark.read.parquet(f"{d}/documents.parquet").selectExpr("doc_id", "octet_length(text) + 1 as size", "xxhash64(text) as g").selectExpr("*", "xxhash64(g, 7) as at", "xxhash64(doc_id, 11) as h").collect()
    ring = sorted((int.from_bytes(hashlib.blake2b(f"{s}/{v}".encode(), digest_size=4).digest(), "big"), s) for s in range(shards) for v in range(nodes))
    total = sum(r["size"] for r in rows)
    group, load, want = Counter(), [0.0] * shards, {}
    for r in rows:
        group[r.g] += r["size"]

    def walk(place, weight, bound):
        clockwise = [s for p, s in ring if p >= place] + [s for p, s in ring if p < place]
        shard = next((s for s in clockwise if load[s] + weight <= bound), None)
        shard = min(range(shards), key=lambda s: (load[s], s)) if shard is None else shard
        load[shard] += weight
        return shard

    mean = total / shards
    heavy = {g for g, w in group.items() if w > max(1, int(mean / 64))}
    at = {r.g: (r.at % 2**64) >> 32 for r in rows}
    for g in sorted(heavy, key=lambda g: (-group[g], g)):
        assert group[g] <= mean  # larger ones are cut: see the next test
        shard = walk(at[g], group[g], mean)
        want |= {r.doc_id: shard for r in rows if r.g == g}
    cells = defaultdict(list)
    for r in rows:
        if r.g not in heavy:
            cells[(r.at % 2**64) >> (64 - bits)].append(r)
    for cell, inside in sorted(cells.items()):
        weight = sum(r["size"] for r in inside)
        shard = walk(cell << (32 - bits), weight, mean + weight / 2)
        want |= {r.doc_id: shard for r in inside}
    assert got == want


def test_sharding_hot_group_and_growth(spark):
    rows = [(i, f"text {i}" if i % 3 else "hot text", "en", "s", 1, "", "") for i in range(6000)]
    got = sharding.shard(frame(spark, rows)).collect()
    loads = check_shards(got, 16)
    assert max(loads) / (sum(loads) / 16) < 1.05 and min(loads) / (sum(loads) / 16) > 0.9
    more = {r.doc_id: r.shard for r in sharding.shard(frame(spark, rows), shards=17).collect()}
    moved = sum(more[r.doc_id] != r.shard for r in got if r.doc_id % 3)
    assert moved < 0.35 * 4000
    cases = awkward()
    assert len(sharding.shard(frame(spark, cases)).collect()) == len(cases)
    check_shards(sharding.shard(frame(spark, cases)).collect(), 16)
    assert sharding.shard(frame(spark, [])).count() == 0
