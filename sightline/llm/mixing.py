"""Mixing sources to target weights by pivotal dependent rounding.

Every source has a target number of words; a document of the source is
expected ``target / source_size`` times (at most twice). The whole part of
that is taken outright. The fractional part is a probability, and pivotal
rounding settles it: two open documents meet, word mass moves at random from
one to the other until one of them is at 0 or 1, the other stays open and
meets the next. A transfer keeps the expected words of the pair, so the words
a source takes differ from its target by less than one open document.

The pairing is a reduction tree: open documents fall into hash groups of
about ``FAN_IN``; each group is folded from long to short documents and
leaves at most one open document; the leftovers form the next, smaller level,
until every source has one group. Folding long documents first leaves a short
one open at the end, and one group of each source is kept for the last fold,
so that the final rounding moves few words. All steps are
DataFrame operations (grouping, a fold over a bounded array, joins with the
table of sources); every random number is a hash of the documents involved,
so a rerun gives the same mix.

Defined cases: null text has size 0; null source is a source of its own,
after all others; documents without words are taken as often as a hash draw
against their fraction says and add no words; repeated rows share the fate of
one weighted document and each row still gets its own whole number of copies;
an empty table gives an empty result; columns that clash with the added names
do not matter, the document output has the input columns only.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sightline.llm.tables import (
    REPEAT_RANGE,
    ROW,
    ROW_COUNT,
    ROW_ID,
    ROW_KEY,
    distinct_rows,
    keyed_rows,
    materialise,
    repeat_rows,
    same_row,
)

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST = 2
FAN_IN = 512
EPSILON = 1e-9
BROADCAST_SOURCES = 100_000


def n_words(text: str = "text") -> Column:
    """Number of maximal runs without ASCII white space (null: 0)."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """(source, source_size, target): ``share`` of all words split by weight,
    no source above ``most`` times its size, the excess reshared by weight.

    ``sizes`` has one row per source. Sources are weighted in code-point order
    with null last. Resharing until none is above its cap ends where the
    uncapped sources share what the capped ones leave: sources are capped in
    order of cap over weight, up to the first that stays below its cap.
    """
    turn = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.row_number().over(turn) - 1) % len(weights) + 1)
    ranked = sizes.withColumn("_w", weight).withColumn("_cap", F.col("source_size") * F.lit(float(most)))
    by_ratio = Window.orderBy(F.col("_cap") / F.col("_w"), F.col("source").asc_nulls_last())
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    left = F.sum("source_size").over(everything) * F.lit(share) - F.coalesce(F.sum("_cap").over(before), F.lit(0.0))
    weight_left = F.sum("_w").over(everything) - F.coalesce(F.sum("_w").over(before), F.lit(0.0))
    levels = ranked.withColumn("_level", left / weight_left)
    below = F.col("_cap") >= F.col("_level") * F.col("_w")
    level = F.first(F.when(below, F.col("_level")), ignorenulls=True).over(
        by_ratio.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    )
    return levels.withColumn("_final", level).select(
        "source",
        "source_size",
        F.coalesce(F.least("_cap", F.col("_final") * F.col("_w")), F.col("_cap")).alias("target"),
    )


def _uniform(*cols) -> Column:
    """A number in [0, 1) that depends on the given values alone."""
    return F.shiftrightunsigned(F.xxhash64(*cols), 11) * F.lit(2.0**-53)


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` worked out once (lambda bodies are
    interpreted, repeated subexpressions would be evaluated again and again)."""
    return F.get(F.transform(F.array(value), body), 0)


def _entry(x: Column, p: Column) -> Column:
    return F.struct(*[x[c].alias(c) for c in ("key", "doc_id", "source", "size")], p.alias("p"))


def _settled(p: Column) -> Column:
    return F.when(p < EPSILON, F.lit(0.0)).when(p > 1 - EPSILON, F.lit(1.0)).otherwise(p)


def _transfer(a: Column, b: Column, seed: int) -> Column:
    """Moves word mass between two open documents: struct (a, b) with their
    new probabilities, at least one of them 0 or 1."""
    wa, wb = a["size"].cast("double"), b["size"].cast("double")
    bounds = F.struct(
        F.least(F.lit(1.0) - a["p"], b["p"] * wb / wa).alias("up"),
        F.least(a["p"], (F.lit(1.0) - b["p"]) * wb / wa).alias("down"),
        _uniform(a["key"], b["key"], a["doc_id"], b["doc_id"], F.lit(seed)).alias("draw"),
    )
    # up with probability down / (up + down): the expected words do not change
    shift = _let(
        bounds, lambda t: F.when(t["draw"] * (t["up"] + t["down"]) < t["down"], t["up"]).otherwise(-t["down"])
    )
    return _let(
        shift,
        lambda d: F.struct(_settled(a["p"] + d).alias("a"), _settled(b["p"] - d * wa / wb).alias("b")),
    )


def _meet(state: Column, item: Column, seed: int) -> Column:
    """One pivotal step: the open document of ``state`` meets ``item``."""
    a, b = state["open"], item

    def after(p: Column) -> Column:
        a_done = (p["a"] == 0.0) | (p["a"] == 1.0)
        return _let(
            F.struct(_entry(a, p["a"]).alias("a"), _entry(b, p["b"]).alias("b"), a_done.alias("done")),
            lambda t: F.struct(
                F.when(t["done"], t["b"]).otherwise(t["a"]).alias("open"),
                F.concat(state["done"], F.array(F.when(t["done"], t["a"]).otherwise(t["b"]))).alias("done"),
            ),
        )

    alone = F.struct(b.alias("open"), state["done"].alias("done"))
    closed = F.struct(b.alias("open"), F.concat(state["done"], F.array(a)).alias("done"))
    a_closed = (a["p"] <= 0.0) | (a["p"] >= 1.0)
    return F.when(a.isNull(), alone).when(a_closed, closed).otherwise(_let(_transfer(a, b, seed), after))


def _group(groups: Column, level: int, seed: int) -> Column:
    return F.pmod(F.xxhash64("i.key", "i.doc_id", F.lit(seed), F.lit(level)), groups).alias("_group")


def _fold(open_items: DataFrame, level: int, seed: int) -> DataFrame:
    """Fold each group of each source; one row per document with its new
    probability (0 or 1 for all but one document of a group)."""
    item = F.struct(
        (-F.col("size")).alias("_order"),
        F.xxhash64("key", "doc_id", F.lit(seed + level)).alias("_tie"),
        *[F.col(c) for c in ("key", "doc_id", "source", "size", "p")],
    )
    grouped = (
        open_items.groupBy("source", "_group")
        .agg(F.array_sort(F.collect_list(item)).alias("_items"))
    )
    plain = F.transform(
        "_items",
        lambda x: F.struct(
            x["key"].alias("key"), x["doc_id"].alias("doc_id"), x["source"].alias("source"),
            x["size"].alias("size"), x["p"].alias("p"),
        ),
    )
    entry_type = open_items.select("key", "doc_id", "source", "size", "p").schema.simpleString()
    start = F.struct(F.lit(None).cast(entry_type).alias("open"), F.array().cast(f"array<{entry_type}>").alias("done"))
    folded = F.aggregate(plain, start, lambda s, x: _meet(s, x, seed + level))
    return (
        grouped.select(folded.alias("_f"))
        .select(F.explode(F.concat(F.col("_f.done"), F.array(F.col("_f.open")))).alias("_e"))
        .select("_e.*")
    )


def copies(units: DataFrame, seed: int = 0, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE,
           most: int = MOST) -> DataFrame:
    """Settle the copies of every unit.

    ``units`` (a written table) has the row's key and id, ``source``, ``size``
    and the number of identical rows ``_row_count``. The result adds
    ``source_size``, ``target``, ``base`` (copies of every row of the unit)
    and ``extra`` (how many of its rows get one copy more).
    """
    spark = units.sparkSession
    stats = units.groupBy("source").agg(
        F.sum(F.col("size") * F.col(ROW_COUNT)).alias("source_size"), F.count(F.lit(1)).alias("_units")
    )
    stats, _ = materialise(stats, "mix-sources")
    bound = stats.agg(F.count(F.lit(1)), F.max("_units")).first()
    targets = source_targets(stats.select("source", "source_size"), weights, share, most)
    if bound[0] <= BROADCAST_SOURCES:  # counted: one short row per source
        targets = F.broadcast(targets)

    same = F.col("u.source").eqNullSafe(F.col("t.source"))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(1.0))
    base = F.least(F.floor(rate + EPSILON), F.lit(most)).cast("long")
    mass = F.greatest(rate - F.col("base"), F.lit(0.0)) * F.col(ROW_COUNT)
    whole = F.floor(F.col("_mass") + EPSILON).cast("long")
    rated = (
        units.alias("u")
        .join(targets.alias("t"), same)
        .select("u.*", "source_size", "target")
        .withColumn("base", base)
        .withColumn("_mass", mass)
        .withColumn("_whole", whole)
        .withColumn("_p", F.greatest(F.col("_mass") - F.col("_whole"), F.lit(0.0)))
    )
    rated, _ = materialise(rated, "mix-rated")

    is_open = (F.col("_p") > EPSILON) & (F.col("size") > 0)
    items = rated.where(is_open).select(
        F.col(ROW_KEY).alias("key"), F.col(ROW_ID).alias("doc_id"), "source", "size", F.col("_p").alias("p")
    )
    largest, level = int(bound[1] or 0), 0
    settled, reserve = [], None
    while True:
        last = largest <= FAN_IN
        counts = items.groupBy("source").agg(F.count(F.lit(1)).alias("_n"))
        if bound[0] <= BROADCAST_SOURCES:
            counts = F.broadcast(counts)
        sized = items.alias("i").join(counts.alias("c"), F.col("i.source").eqNullSafe(F.col("c.source")))
        grouped = sized.select("i.*", _group(F.ceil(F.col("_n") / F.lit(FAN_IN)).cast("long"), level, seed))
        if last:
            grouped = grouped.withColumn("_group", F.lit(0).cast("long"))
            if reserve is not None:
                grouped = grouped.unionByName(reserve)
        elif reserve is None:
            # one group of each source waits for the last fold, so that what is
            # open there still meets enough short documents
            reserve = grouped.where("_group = 0")
            grouped = grouped.where("_group > 0")
        folded, _ = materialise(_fold(grouped, level, seed), f"mix-level{level}")
        closed = (F.col("p") <= 0.0) | (F.col("p") >= 1.0)
        settled.append(folded.where(closed))
        items, level = folded.where(~closed), level + 1
        if last:
            break
        largest = -(-largest // FAN_IN)
    # one open document per source is left: a plain draw against its probability
    drawn = _uniform("key", "doc_id", F.lit(seed), F.lit("last")) < F.col("p")
    settled.append(items.withColumn("p", drawn.cast("double")))
    decided = functools.reduce(DataFrame.unionByName, settled).select(F.col("key").alias("_k"), F.col("doc_id").alias("_d"), F.col("p").alias("_won"))

    wordless = (F.col("size") <= 0) & (_uniform(ROW_KEY, ROW_ID, F.lit(seed), F.lit("empty")) < F.col("_p"))
    won = F.coalesce(F.col("_won").cast("long"), wordless.cast("long"))
    return (
        rated.join(decided, (F.col(ROW_KEY) == F.col("_k")) & F.col(ROW_ID).eqNullSafe(F.col("_d")), "left")
        .withColumn("extra", F.col("_whole") + won)
        .drop("_mass", "_whole", "_p", "_k", "_d", "_won")
    )


def _units(documents: DataFrame) -> DataFrame:
    """Distinct rows (by all columns) with source, size and multiplicity."""
    sized = keyed_rows(documents, ["source", "text"]).select(
        ROW_KEY, ROW_ID, F.struct(F.col(f"{ROW}.source"), n_words(f"{ROW}.text").alias("size")).alias(ROW)
    )
    units = distinct_rows(sized).select(ROW_KEY, ROW_ID, ROW_COUNT, f"{ROW}.source", f"{ROW}.size")
    return materialise(units, "mix-units")[0]


def _most_copies(units: DataFrame) -> int:
    return int(units.agg(F.max(ROW_COUNT)).first()[0] or 0)


def mix_digest(documents: DataFrame, seed: int = 0, limit: int = REPEAT_RANGE) -> DataFrame:
    """doc_id, size, source_size, target and taken words of every document."""
    units = _units(documents.select("doc_id", "source", "text"))
    settled, most = copies(units, seed), _most_copies(units)
    if most > limit:  # then it is read twice
        settled, _ = materialise(settled, "mix-settled")
    taken = F.col("size") * (F.col("base") + (F.col("_nth") < F.col("extra")).cast("long"))
    return repeat_rows(settled, ROW_COUNT, "_nth", most, limit).select(
        F.col(ROW_ID).alias("doc_id"), "size", "source_size", "target", taken.alias("taken")
    )


def mix(documents: DataFrame, seed: int = 0, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE,
        most: int = MOST, limit: int = REPEAT_RANGE) -> DataFrame:
    """The mixed documents: every row as often as the mix takes it."""
    units = _units(documents)
    times = F.col("base") * F.col(ROW_COUNT) + F.col("extra")
    total = copies(units, seed, weights, share, most).select(ROW_KEY, ROW_ID, times.alias("_copies")).where("_copies > 0")
    taken = distinct_rows(keyed_rows(documents)).alias("r").join(total.alias("t"), same_row("r", "t"))
    taken = taken.select(f"r.{ROW}", "t._copies")
    largest = most * _most_copies(units)  # no row is taken more than ``most`` times
    if largest > limit:  # then it is read twice
        taken, _ = materialise(taken, "mix-taken")
    return repeat_rows(taken, "_copies", "_nth", largest, limit).select(f"{ROW}.*")
