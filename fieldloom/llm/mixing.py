"""Operator 4: mixing sources to target weights by pivotal dependent rounding.

Every document of a source should be taken ``target / source size`` times, a number that is
rarely whole. The whole part is given to all; the rest is a probability that rounding turns
into 0 or 1. A document is paired with the pool of all smaller ones and words are moved at random
from one's expectation to the other's until one of the two is whole; what is left goes on to the
next pair. The direction is drawn so that no expectation changes, and what one loses in words the
other gains, so the words taken from a source stay at the target until the last document alone is
rounded. Pairs are formed from the largest document down, so that is as a rule a small one.

Rounding runs as a reduction tree: rows fall by hash into groups of about ``group_rows``, each
group leaves one row that isn't whole, and these meet in groups of the next level. A source
that holds a third of all rows is just more groups. All draws are hashes of row ids and the
seed, so reruns agree.

Cases: a null or empty text has size 0 and is taken 0 times; a null source is a source of its
own, the last; rows that repeat an id are told apart by their content, equal rows by number;
sources may be as many as rows, as targets come from prefix sums over their table; a table without
words takes nothing; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Sequence

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldloom.llm.common import WORD, repeat_ids, save

#: Sources up to which their table is sent to all tasks (one row a source).
SENT_SOURCES = 100_000


def running(rows: DataFrame, order: list, **sums: Column) -> DataFrame:
    """``rows`` sorted by ``order``, with sums over the rows before each: of its partition by a window, of
    earlier partitions by their totals."""
    ordered = save(rows.orderBy(*order).withColumn("__m", F.monotonically_increasing_id()).withColumns({f"__{n}": c for n, c in sums.items()}), "mixing-order")
    part = F.shiftright("__m", 33).alias("__p")
    totals = ordered.groupBy(part).agg(*[F.sum(f"__{n}").alias(f"__{n}_all") for n in sums])
    before = Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)  # a row a partition
    totals = totals.select(F.col("__p").alias("__q"), *[F.coalesce(F.sum(f"__{n}_all").over(before), F.lit(0)).alias(f"__{n}_base") for n in sums])
    rows = ordered.withColumn("__p", part).join(F.broadcast(totals), F.col("__p") == F.col("__q"))
    within = Window.partitionBy("__p").orderBy("__m").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumns({n: F.col(f"__{n}_base") + F.coalesce(F.sum(f"__{n}").over(within), F.lit(0)) for n in sums})
    return rows.drop("__m", "__p", "__q", *[f"__{n}{x}" for n in sums for x in ("", "_base")])


def targets(found: DataFrame, weights: Sequence[float], share: float, most: float) -> DataFrame:
    """``target`` and ``rate`` of sources (``source, total``): ``share`` of all by weight, in turn in the order
    of code points, null last, at most ``most`` times a source's own size, the excess shared by weight
    among those below. The least-covered source meets its limit first, so sums over the sources in
    that order tell where the sharing ends."""
    ranked = running(found, [F.col("source").asc_nulls_last()], rank=F.lit(1))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("rank") % len(weights)).cast("int") + 1)
    ranked = running(ranked.withColumn("weight", weight), [F.col("total") / F.col("weight"), "rank"], sizes=F.col("total"), covered=F.col("weight"))
    ranked = save(ranked, "mixing-sources")
    size, whole = ranked.agg(F.coalesce(F.sum("total"), F.lit(0)), F.coalesce(F.sum("weight"), F.lit(0.0))).first()
    level = (share * size - most * F.col("sizes")) / (whole - F.col("covered"))  # words to a weight of one, if all before are at their limits
    free = ranked.where((F.col("total") > 0) & (level * F.col("weight") < most * F.col("total"))).agg(F.min_by(level, F.struct("sizes", "rank"))).first()[0]
    limit = F.col("total") * most
    target = limit if free is None else F.least(limit, F.col("weight") * free)
    ranked = ranked.withColumn("target", target.cast("double"))
    return ranked.withColumn("rate", F.when(F.col("total") > 0, F.col("target") / F.greatest("total", F.lit(1))).otherwise(0.0)).drop("rank", "weight", "sizes", "covered")


def round_group(group: pa.Table, seed: int) -> pa.Table:
    """Rounds one group: each ``chance`` becomes 0 or 1, but for one row at most.

    From the largest row down, a row is paired with the pool of all smaller ones. Words move between
    their expectations until the row is whole, or else the whole pool is, and then the row goes on alone.
    The pool's rows share what it gets or gives in proportion, which is one linear map of their chances."""
    group = group.sort_by([("size", "descending"), ("mark", "ascending")])
    size, chance, mark = (group.column(c).to_pylist() for c in ("size", "chance", "mark"))
    some = [i for i, c in enumerate(chance) if 0 < c < 1]
    up, down = sum(size[i] * (1 - chance[i]) for i in some), sum(size[i] * chance[i] for i in some)  # words that the pool can take and give
    slope, base = 1.0, 0.0
    for k, i in enumerate(some):
        c = min(1.0, max(0.0, slope * chance[i] + base))
        up, down = max(0.0, up - size[i] * (1 - c)), max(0.0, down - size[i] * c)
        rise, fall = min(size[i] * (1 - c), down), min(size[i] * c, up)
        if k == len(some) - 1 or rise + fall <= 0:
            chance[i] = c
            continue
        draw = xxhash.xxh64_intdigest(f"{seed}|{len(size)}|{mark[i]}") / 2.0**64
        if draw * (rise + fall) < fall:  # the row gets words, the pool gives them
            chance[i] = 1.0 if rise == size[i] * (1 - c) else c + rise / size[i]
            share, shift = (1 - rise / down if down > rise else 0.0), 0.0
            up, down = up + rise, down - rise
        else:
            chance[i] = 0.0 if fall == size[i] * c else c - fall / size[i]
            share = 1 - fall / up if up > fall else 0.0
            shift = 1 - share
            up, down = up - fall, down + fall
        slope, base = slope * share, base * share + shift
    chance = [0.0 if c < 1e-9 else 1.0 if c > 1 - 1e-9 else c for c in chance]
    return group.set_column(group.schema.get_field_index("chance"), "chance", pa.array(chance, pa.float64()))


def mix(
    docs: DataFrame,
    weights: Sequence[float] = (5.0, 2.0, 1.0),
    share: float = 1.5,
    most: float = 2.0,
    seed: int = 17,
    group_rows: int = 4096,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
) -> DataFrame:
    """``doc_id, source, content, occurrence, size, source_size, target, copies``: how often each row is taken.

    Sources in code point order, null last, have ``weights`` in turn, repeating.
    ``content`` is the text's hash, ``occurrence`` numbers rows of the same id, source and text.
    """
    rows = docs.select(
        F.col(id_col).alias("key"), F.col(source_col).alias("source"), F.coalesce(F.regexp_count(text_col, F.lit(WORD)), F.lit(0)).cast("long").alias("size"), F.coalesce(F.xxhash64(text_col), F.lit(0)).alias("content")
    )
    rows = save(rows, "mixing-sizes")
    if repeat_ids(rows, "key"):
        alike = Window.partitionBy("key", "source", "content", "size").orderBy("size")
        rows = rows.withColumn("occurrence", F.row_number().over(alike).cast("long") - 1)
    else:
        rows = rows.withColumn("occurrence", F.lit(0).cast("long"))
    plan = targets(rows.groupBy("source").agg(F.sum("size").alias("total"), F.count("*").alias("n")), weights, share, most)
    plan = save(plan.select(F.col("source").alias("of"), F.col("total").alias("source_size"), "target", "rate", F.ceil(F.col("n") / group_rows).alias("groups"), "n"), "mixing-targets")
    sources, most_rows = plan.agg(F.count("*"), F.coalesce(F.max("n"), F.lit(0))).first()
    plan = plan.drop("n")
    rows = rows.join(F.broadcast(plan) if sources <= SENT_SOURCES else plan, rows["source"].eqNullSafe(plan["of"])).drop("of")
    whole = F.floor("rate").cast("long")
    part = F.when(F.col("size") == 0, 0.0).otherwise(F.col("rate") - whole)
    rows = rows.select(
        "key", "source", "content", "occurrence", "size", "source_size", "target", F.when(F.col("size") > 0, whole).otherwise(0).alias("whole"), F.when(part < 1e-12, 0.0).when(part > 1 - 1e-12, 1.0).otherwise(part).alias("chance"),
        F.pmod(F.xxhash64("key", "content", "occurrence", F.lit(seed)), F.col("groups")).alias("group"), F.concat_ws(":", "key", "content", "occurrence").alias("mark"),
    )
    done, groups = [], most_rows // group_rows + 1
    while True:
        rows = save(rows.groupBy("source", "group").applyInArrow(lambda group: round_group(group, seed), rows.schema), "mixing-level")
        if groups == 1:
            break
        done.append(rows.where("chance in (0, 1)"))
        rows = rows.where("chance not in (0, 1)").withColumn("group", F.floor(F.col("group") / group_rows).cast("long"))
        groups = (groups - 1) // group_rows + 1
    draw = F.pmod(F.xxhash64("mark", F.lit(seed)), F.lit(1 << 32)) / float(1 << 32)
    rows = rows.withColumn("chance", F.when(F.col("chance").isin(0.0, 1.0), F.col("chance")).otherwise((draw < F.col("chance")).cast("double")))
    for level in done:
        rows = rows.unionByName(level)
    return rows.select(F.col("key").alias("doc_id"), "source", "content", "occurrence", "size", "source_size", "target", (F.col("whole") + F.col("chance").cast("long")).alias("copies"))


def mixed_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """The rows of ``docs`` themselves, each as often as ``mix`` takes it. Only rows that repeat an id are
    numbered; others are found by their id."""
    names = docs.columns
    taken = mix(docs, id_col=id_col, text_col=text_col, source_col=source_col, **options).where("copies > 0")
    taken = taken.select(F.col("doc_id").alias("__id"), F.col("source").alias("__source"), F.col("content").alias("__hash"), F.col("occurrence").alias("__nth"), F.col("copies").alias("__copies"))
    if repeat_ids(docs, id_col):
        content = F.coalesce(F.xxhash64(text_col), F.lit(0))
        rows = docs.withColumn("__content", content)
        rows = rows.withColumn("__place", F.row_number().over(Window.partitionBy(id_col, source_col, "__content").orderBy("__content")).cast("long") - 1)
        kept = rows.join(taken, rows[id_col].eqNullSafe(taken["__id"]) & rows[source_col].eqNullSafe(taken["__source"]) & (rows["__content"] == taken["__hash"]) & (rows["__place"] == taken["__nth"]))
    else:
        kept = docs.join(taken, docs[id_col] == taken["__id"])
    return kept.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__copies").cast("int")))).select(*[docs[c] for c in names])
