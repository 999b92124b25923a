"""Operator 6: a consistent-hash ring with virtual nodes and bounded loads, in DataFrame code alone.

Texts are hashed onto a ring on which every shard stands at ``nodes`` places. A text belongs to
the first shard clockwise that still has room; a full shard's texts go on clockwise, so no
shard exceeds its bound, and texts away from the overflow stay where the ring put them.

The ring is cut into ``2**cell_bits`` cells of equal width. One aggregation gives the weight of
each cell; the driver walks these (a fixed number) and the few heavy groups of equal texts, and
sends the resulting table of places back to the rows. Groups of equal texts stay together,
unless a group alone is larger than a shard's bound: that is cut by id hash. The number of a
row in its shard is its cell's first number plus its rank in the cell, so no task sees a shard.

The law kept is ``bytes``: a shard's bound is the mean and half of the unit (a cell or a part of
a heavy group) that reaches it, so loads end at most half a unit above the mean; a unit for
which no shard has room, as a single text among few, goes to the emptiest shard.

Cases: null texts have size 1 and are one group, as have empty texts; repeated rows take one
place each; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import bisect
import hashlib
import json
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fieldloom.llm.common import save

#: A group of equal texts is heavy beyond this part of a shard's mean, and is counted in parts of PART of it.
HEAVY, PART = 1 / 64, 1 / 256


@dataclass
class Ring:
    """Shards on a ring of 2**32 places, and the load that each has so far."""

    shards: int
    nodes: int = 64
    load: list[float] = field(default_factory=list)

    def __post_init__(self):
        places = [(int.from_bytes(hashlib.blake2b(f"{s}/{v}".encode(), digest_size=4).digest(), "big"), s) for s in range(self.shards) for v in range(self.nodes)]
        self.places = sorted(places)
        self.load = [0.0] * self.shards

    def put(self, place: int, weight: float, bound: float) -> int:
        """The first shard clockwise from ``place`` with room; the emptiest if none has."""
        at = bisect.bisect_left(self.places, (place, -1))
        tried = set()
        for k in range(len(self.places)):
            shard = self.places[(at + k) % len(self.places)][1]
            if shard in tried:
                continue
            if self.load[shard] + weight <= bound:
                break
            tried.add(shard)
            if len(tried) == self.shards:
                shard = min(range(self.shards), key=lambda s: (self.load[s], s))
                break
        self.load[shard] += weight
        return shard


def places(cells: list[tuple[int, int]], heavy: list[tuple[int, int, list[tuple[int, int]]]], shards: int, nodes: int, cell_bits: int) -> dict:
    """Shard of every unit: ``("cell", c, 0)`` and ``("group", g, part)``.

    ``cells``: (cell, weight); ``heavy``: (group, ring place, [(part, weight)]).
    """
    ring = Ring(shards, nodes)
    total = sum(w for _, w in cells) + sum(w for _, _, parts in heavy for _, w in parts)
    mean = total / shards
    out = {}
    for group, place, parts in sorted(heavy, key=lambda x: (-sum(w for _, w in x[2]), x[0])):
        whole = sum(w for _, w in parts)
        if whole <= mean:
            shard = ring.put(place, whole, mean)
            out |= {("group", group, p): shard for p, _ in parts}
        else:
            out |= {("group", group, p): ring.put(place, w, mean + w / 2) for p, w in sorted(parts)}
    width = 32 - cell_bits
    for cell, weight in sorted(cells):
        out["cell", cell, 0] = ring.put(cell << width, weight, mean + weight / 2)
    return out


def shard(docs: DataFrame, shards: int = 16, nodes: int = 64, cell_bits: int = 14, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, size, text_crc32, law, shard, slot, grown_shard`` of every row."""
    spark = docs.sparkSession
    text = F.col(text_col)
    rows = docs.select(
        F.col(id_col).alias("doc_id"), (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"), F.when(text.isNull(), 0).otherwise(F.xxhash64(text)).alias("g"),
    )
    rows = save(rows, "sharding-rows")  # the texts are read once
    groups = save(rows.groupBy("g").agg(F.sum("size").alias("w")), "sharding-groups")
    total = groups.agg(F.sum("w")).first()[0] or 0
    most = max(1, int(total / shards * HEAVY))
    hot = groups.where(F.col("w") > most).collect()  # fewer than shards / HEAVY
    parts = {r["g"]: max(1, -(-r["w"] // max(1, int(total / shards * PART)))) for r in hot}
    ring_hash = F.xxhash64("g", F.lit(7))
    cell = F.shiftrightunsigned(ring_hash, 64 - cell_bits)
    listed = spark.sql("select inline(from_json(:heavy, 'array<struct<g: bigint, parts: bigint>>'))", {"heavy": json.dumps([{"g": g, "parts": n} for g, n in parts.items()])})
    rows = rows.join(F.broadcast(listed), "g", "left")
    of_group = F.col("parts").isNotNull()
    rows = rows.select(
        "doc_id", "size", "text_crc32", "g", ring_hash.alias("at"), F.when(of_group, "group").otherwise("cell").alias("kind"),
        F.when(of_group, F.col("g")).otherwise(cell).alias("unit"), F.when(of_group, F.pmod(F.xxhash64("doc_id", F.lit(11)), F.col("parts"))).otherwise(0).alias("part"),
    )
    units = rows.groupBy("kind", "unit", "part").agg(F.sum("size").alias("w"), F.count("*").alias("n"), F.min("at").alias("at")).collect()  # 2**cell_bits and shards / PART at most, and one for each heavy group
    heavy: dict[int, tuple[int, list[tuple[int, int]]]] = {}
    for u in units:
        if u["kind"] == "group":
            heavy.setdefault(u["unit"], ((u["at"] & (2**64 - 1)) >> 32, []))[1].append((u["part"], u["w"]))
    where = places([(u["unit"], u["w"]) for u in units if u["kind"] == "cell"], [(g, at, p) for g, (at, p) in heavy.items()], shards, nodes, cell_bits)
    plan, first = [], [0] * shards
    for u in sorted(units, key=lambda u: (u["kind"], u["unit"], u["part"])):
        s = where[u["kind"], u["unit"], u["part"]]
        plan.append({"kind": u["kind"], "unit": u["unit"], "part": u["part"], "shard": s, "first": first[s]})
        first[s] += u["n"]
    table = spark.sql("select inline(from_json(:plan, 'array<struct<kind: string, unit: bigint, part: bigint, shard: int, first: bigint>>'))", {"plan": json.dumps(plan)})
    rank = F.row_number().over(Window.partitionBy("kind", "unit", "part").orderBy("at", "g", "doc_id", "text_crc32"))
    return rows.join(F.broadcast(table), ["kind", "unit", "part"]).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("first") + rank - 1).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )
