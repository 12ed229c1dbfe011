"""Mixing sources to target weights by Sainte-Lague apportionment.

The words of a source are laid out on one line in a seeded order and cut into
blocks of equal size. Blocks are the seats, sources the parties: seats go to
the highest quotients target / (2 j + 1). A source's seats are apportioned in
the same way to its shards of consecutive blocks, so every shard has an integer
quota; inside a shard a seeded rotation says which blocks serve it. Everything
is DataFrame arithmetic: blocks are never rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parenlake.llm.common import SPACE, WORD, aside, positions, stage, text_of, word_count

#: Fixed value: words of a shard, at least.
SHARD_WORDS = 1 << 16


def targets(sizes: DataFrame, weights: tuple[int, ...], share: float, most: float) -> DataFrame:
    """source, source_size -> also weight and target.

    Sources in code point order, null last, take the weights in turn. Together
    they share ``share`` times all sizes by weight; none goes above ``most``
    times its size, and what one can't take is shared again by weight. The
    fixed point is min(most * size, level * weight) for one level, found by
    running sums in the order in which sources fill up. One row a source.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    turn = F.pmod(F.row_number().over(order) - 1, F.lit(len(weights)))
    ranked = sizes.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (turn + 1).cast("int")))
    ranked = ranked.withColumn("_cap", F.lit(float(most)) * F.col("source_size"))
    fill = Window.orderBy(F.col("_cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before, everything = fill.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    ranked = ranked.withColumns(
        {
            "_filled": F.coalesce(F.sum("_cap").over(before), F.lit(0.0)),
            "_open": F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)),
            "_goal": F.lit(float(share)) * F.sum("source_size").over(everything),
        }
    )
    # The level if this source and all after it stay below their caps.
    ranked = ranked.withColumn("_level", (F.col("_goal") - F.col("_filled")) / F.col("_open"))
    holds = F.col("_level") * F.col("weight") <= F.col("_cap")
    level = F.min(F.when(holds, F.struct(F.col("_cap") / F.col("weight"), F.col("_level").alias("level")))).over(everything)["level"]
    return ranked.withColumn("target", F.least(F.col("_cap"), F.coalesce(level * F.col("weight"), F.col("_cap")))).select("source", "source_size", "weight", "target")


def sainte_lague(parties: DataFrame, group: list[str], share: str, seats: str, order: list[str], out: str = "quota") -> DataFrame:
    """Add ``out``: the seats of each party when ``seats`` (the same all over a
    group) go to the highest quotients share / (2 j + 1).

    Rounding share / divisor with divisor = sum / seats already gives all but a
    few; the group's surplus or deficit D bounds how far any party can be off,
    so only quotients within D of the rounded count are compared. Ties go by
    ``order``. Parties without a share get no seat.
    """
    whole = Window.partitionBy(*group)
    pile = F.sum(share).over(whole)
    first = F.when(pile > 0, F.floor(F.col(share) * F.col(seats) / pile + 0.5)).otherwise(0).cast("long")
    close = parties.withColumn("_first", first)
    close = close.withColumn("_off", F.abs(F.sum("_first").over(whole) - F.col(seats)))
    close = close.withColumn("_low", F.greatest(F.lit(0).cast("long"), F.col("_first") - F.col("_off")))
    close = close.withColumn("_free", F.col(seats) - F.sum("_low").over(whole))
    none = F.array().cast("array<bigint>")
    contested = F.when((F.col("_off") > 0) & (F.col(share) > 0), F.sequence(F.col("_low"), F.col("_first") + F.col("_off"))).otherwise(none)
    tried = close.withColumn("_j", F.explode_outer(contested))
    best = Window.partitionBy(*group).orderBy((F.col(share) / (2 * F.col("_j") + 1)).desc_nulls_last(), *order, "_j")
    won = tried.withColumn("_won", (F.col("_j").isNotNull() & (F.row_number().over(best) <= F.col("_free"))).cast("long"))
    quota = F.when(F.col("_off") > 0, F.col("_low") + F.col("_wins")).otherwise(F.col("_first"))
    return won.groupBy(*parties.columns, "_first", "_off", "_low").agg(F.sum("_won").alias("_wins")).withColumn(out, quota).select(*parties.columns, out)


def _overlap(a: Column, b: Column, c: Column, d: Column) -> Column:
    return F.greatest(F.lit(0).cast("long"), F.least(b, d) - F.greatest(a, c))


def _runs(parts: Column, most: int) -> Column:
    """[(first, end)]: the stretches of words taken at least once, then those
    taken at least twice, and so on up to ``most``; ``parts`` are [(first, end,
    times)] and may overlap. Stretches that touch are one."""
    ends = F.array_sort(F.array_distinct(F.concat(F.transform(parts, lambda x: x["first"]), F.transform(parts, lambda x: x["end"]))))
    zero = F.lit(0).cast("long")

    def times(at: Column) -> Column:
        return F.aggregate(parts, zero, lambda n, x: n + F.when((x["first"] <= at) & (at < x["end"]), x["times"]).otherwise(zero))

    found = []
    for level in range(1, most + 1):
        first = F.filter(ends, lambda c: (times(c) >= level) & (times(c - 1) < level))  # noqa: B023
        end = F.filter(ends, lambda c: (times(c) < level) & (times(c - 1) >= level))  # noqa: B023
        found.append(F.zip_with(first, end, lambda x, y: F.struct(x.alias("first"), y.alias("end"))))
    return F.concat(*found)


def apply_mix(docs: DataFrame, **settings: object) -> DataFrame:
    """The mixed corpus: each document as often as the mix takes it whole, and
    of one taken in part the stretches of words in the blocks that were taken,
    each a row of its own and with its white space as it is.

    Columns are those of ``docs``; n_chars, if there, follows an excerpt's text.
    Equal rows are told apart by number, so each has its own stretches."""
    docs, back = aside(docs, "doc_id", "source", "text", "n_chars")
    text = text_of("text")
    shares = mix(docs, keep_hash=True, **settings)
    shares = stage(shares.select(F.col("doc_id").alias("_d"), F.col("source").alias("_s"), F.col("size").alias("_size"), F.col("_text").alias("_t"), F.col("_copy").alias("_c"), _runs(F.col("_parts"), settings.get("most", 2)).alias("_runs")).filter("_size > 0"), "taken")
    keyed = docs.withColumn("_hash", F.xxhash64(F.lit(settings.get("seed", 7)), text))
    on = (keyed["_hash"] == shares["_t"]) & keyed["doc_id"].eqNullSafe(shares["_d"]) & keyed["source"].cast("string").eqNullSafe(shares["_s"])
    if not shares.filter("_c > 0").isEmpty():  # some row is there twice
        alike = Window.partitionBy("_hash", "doc_id", "source").orderBy(F.xxhash64(*docs.columns))
        keyed = keyed.withColumn("_number", F.row_number().over(alike).cast("long") - 1)
        on = on & (keyed["_number"] == shares["_c"])
    dealt = keyed.join(shares.filter("size(_runs) > 0"), on).withColumn("_run", F.explode("_runs"))
    short = F.col("_run.end") - F.col("_run.first") < F.col("_size")
    # Each word with the white space after it; what precedes the first is apart.
    words = F.split(text, f"(?<={SPACE})(?={WORD})")
    begin = F.col("_run.first") + F.when(text.rlike(f"^{SPACE}"), 2).otherwise(1)
    part = F.array_join(F.slice(words, begin.cast("int"), (F.col("_run.end") - F.col("_run.first")).cast("int")), "")
    cut = dealt.withColumn("text", F.when(short, F.regexp_replace(part, f"{SPACE}+$", "")).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        cut = cut.withColumn("n_chars", F.when(short, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return cut.select(*back)


def mix(docs: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, most: int = 2, seed: int = 7, blocks: int = 1 << 22, shard_blocks: int = 4096, keep_hash: bool = False) -> DataFrame:
    """One row for each document: doc_id, source, size, source_size, target, taken.

    ``taken`` is how many words the mix takes of the document, repeats
    counted; never above ``most`` times its size. A null source is a source of
    its own; null and empty texts have size 0 and are taken 0 times; repeated
    rows are separate documents; an empty table gives an empty result.
    ``blocks`` is about how many blocks the whole corpus is cut into (a block
    has at least one word), so a source's total is within a block of its
    target.
    """
    text = text_of("text")
    sized = stage(docs.select("doc_id", F.col("source").cast("string").alias("source"), word_count(text).alias("size"), F.xxhash64(F.lit(seed), text).alias("_text")), "sizes")
    sizes = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    aim = targets(sizes, weights, share, most)
    total = Window.partitionBy()
    block = F.greatest(F.lit(1).cast("long"), F.floor(F.sum("source_size").over(total) / F.lit(blocks)))
    aim = aim.withColumn("_block", block).withColumn("_blocks", F.ceil(F.col("source_size") / F.col("_block")).cast("long"))
    aim = aim.withColumn("_all", F.lit(0)).withColumn("_seats", F.round(F.sum("target").over(total) / F.col("_block")).cast("long"))
    seats = sainte_lague(aim, ["_all"], "target", "_seats", ["source"], "_quota")
    seats = stage(seats.withColumn("_quota", F.least(F.col("_quota"), F.lit(most) * F.col("_blocks"))), "seats")

    # Shards of consecutive blocks, each with its own quota. They have many more
    # words than a document, however few a block has: what is taken of a shard
    # ends in two places at most.
    step = F.greatest(F.lit(shard_blocks).cast("long"), F.ceil(F.lit(SHARD_WORDS) / F.col("_block")).cast("long"))
    some = seats.filter("_blocks > 0").withColumn("_step", step)
    shards = some.withColumn("_shard", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("_blocks") - 1) / F.col("_step")))))
    shards = shards.withColumn("_in", F.least(F.col("_step"), F.col("_blocks") - F.col("_shard") * F.col("_step")).cast("double"))
    shards = sainte_lague(shards.select("source", "_block", "_step", "_quota", "_shard", "_in"), ["source"], "_in", "_quota", ["_shard"], "_mine")
    many = F.col("_in").cast("long")
    mine = F.least(F.col("_mine"), F.lit(most) * many)
    quotas = shards.select(
        F.col("source").alias("_source"), F.col("_shard"),
        F.floor(mine / many).alias("_times"), (mine % many).alias("_extra"), many.alias("_many"),
        F.pmod(F.xxhash64(F.lit(seed), "source", "_shard"), many).alias("_turn"),
    )

    keyed = sized.withColumn("_order", F.xxhash64(F.lit(seed), "doc_id"))
    lined = positions(keyed, ["source"], ["_order", "doc_id", "_text", "size"], "size", "_at", "_copy")
    facts = seats.select(F.col("source").alias("_of"), "source_size", "target", "_block", step.alias("_step"))
    lined = lined.join(facts, lined["source"].eqNullSafe(facts["_of"])).drop("_of")
    wide = F.col("_block") * F.col("_step")
    last = F.greatest(F.col("_at"), F.col("_at") + F.col("size") - 1)
    pieces = lined.withColumn("_shard", F.explode(F.sequence(F.floor(F.col("_at") / wide), F.floor(last / wide))))
    joined = pieces.join(quotas, pieces["source"].eqNullSafe(quotas["_source"]) & (pieces["_shard"] == quotas["_shard"]), "left").drop(quotas["_shard"])
    low, high = F.col("_at"), F.col("_at") + F.col("size")
    origin = F.col("_shard") * wide
    begin = origin + F.col("_turn") * F.col("_block")
    end = begin + F.col("_extra") * F.col("_block")
    edge = origin + F.col("_many") * F.col("_block")
    extra = _overlap(low, high, begin, F.least(end, edge)) + _overlap(low, high, origin, origin + F.greatest(F.lit(0).cast("long"), end - edge))
    taken = F.coalesce(F.col("_times") * _overlap(low, high, origin, edge) + extra, F.lit(0).cast("long"))
    done = joined.withColumn("_taken", taken)
    if not keep_hash:
        return done.groupBy("doc_id", "source", "size", "source_size", "target", "_text", "_at", "_copy").agg(F.sum("_taken").alias("taken")).drop("_at", "_copy", "_text")
    inside = lambda c, d, times: F.struct((F.greatest(low, c) - low).alias("first"), (F.least(high, d) - low).alias("end"), times.cast("long").alias("times"))
    parts = F.array(
        inside(origin, edge, F.col("_times")),
        inside(begin, F.least(end, edge), F.lit(1)),
        inside(origin, origin + F.greatest(F.lit(0).cast("long"), end - edge), F.lit(1)),
    )
    done = done.withColumn("_some", F.filter(parts, lambda x: (x["times"] > 0) & (x["first"] < x["end"])))
    return done.groupBy("doc_id", "source", "size", "source_size", "target", "_text", "_at", "_copy").agg(F.sum("_taken").alias("taken"), F.flatten(F.collect_list("_some")).alias("_parts")).drop("_at")
