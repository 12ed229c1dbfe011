"""Pairs of similar forms by tree edit distance.

Equal trees are one class; distances are worked out between classes. Classes of
one head meet through an inverted index: a form's labels, each with its number
among equal ones, are ordered by how many classes have them, rarest first. The
threshold says how many labels two forms must share at least, so forms that can
reach it share one among the first few (the prefix). Keys of many classes are
cut into blocks. Ids alone are joined and made distinct; trees are fetched for
the pairs left. Classes alike but for labels that no other class has are one
pattern, and only patterns are compared: so many trees that differ in names of
their own have few distances. Pairs of forms are made of links of patterns by blocks,
where they go out.

What a report says about all pairs is never counted pair by pair: running sums
over the node counts of each head give the possible pairs and those that sizes
rule out, and members of classes multiply.
"""

from __future__ import annotations

import hashlib
import json
import math
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parenlake.operators.nodes import _parsed, by_name, staged

FORMS = "file_id long, path array<int>, top boolean, head string, tree string, subtree_nodes int, line_span int, span_start long, span_end long, labels array<string>, leftmost array<int>"


def _tasks(table: DataFrame) -> int:
    return int(table.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def forms(sources: DataFrame, min_node_count: int = 4, min_line_span: int = 1, top_level_only: bool = False) -> DataFrame:
    """Candidate forms with their postorder encoding."""
    from parenlake.functions.dialects import operator_key
    from parenlake.functions.distance import encode
    from parenlake.functions.reader import Tree

    def rows(got):
        return by_name(list(each(got))) if isinstance(got, Tree) else None

    def each(got):
        for k, node in enumerate(got.nodes):
            if node.kind != "list" or node.delimiter != "paren" or (top_level_only and node.parent):
                continue
            size = len(got.subtree(k))
            lines = 1 + got.source.count(b"\n", node.start, max(node.start, node.end - 1))
            if size >= min_node_count and lines >= min_line_span:
                labels, leftmost = encode(got, k)
                head = got.head(k)
                tree = hashlib.blake2b("\1".join([*labels, *map(str, leftmost)]).encode("utf-8", "surrogatepass"), digest_size=16).hexdigest()
                yield {
                    "path": got.path(k), "top": not node.parent, "head": operator_key(head) if head is not None else None, "tree": tree, "subtree_nodes": size,
                    "line_span": lines, "span_start": node.start, "span_end": node.end, "labels": labels, "leftmost": leftmost,
                }

    # Texts are small but costly to encode: they are dealt out to all tasks.
    return _parsed(sources.select("file_id", "dialect", "text").repartition(_tasks(sources)), FORMS, rows)


#: Classes of a key that one block holds.
BLOCK = 256
#: Forms of a group that one block holds, about.
DEALT = 2048
NAMES = ["l_file_id", "l_path", "l_span_start", "l_span_end", "r_file_id", "r_path", "r_span_start", "r_span_end", "l_subtree_nodes", "r_subtree_nodes"]


def _head(column: str = "head") -> Column:
    return F.coalesce(column, F.lit("\0"))


def _fits(threshold: float, a: str, b: str) -> Column:
    """Whether two node counts leave room for the threshold."""
    low, high = F.least(a, b), F.greatest(a, b)
    return (high - low) <= (1 - threshold) * high + 1e-9


def classes(found: DataFrame) -> DataFrame:
    """Equal trees, of staged forms: tree, head, subtree_nodes, labels,
    leftmost, members."""
    same = [F.first(c).alias(c) for c in ("head", "subtree_nodes", "labels", "leftmost")]
    return staged(found.groupBy("tree").agg(*same, F.count(F.lit(1)).alias("members")), "classes")


def _keys(trees: DataFrame, threshold: float) -> tuple[DataFrame, DataFrame]:
    """tree, head, subtree_nodes and key, for either side of the candidate join:
    classes that can reach the threshold have a key in common.

    n nodes and m >= n with o labels in common cost at least 10 (m - n) + 3
    (n - o), so o >= (1 - (1 - threshold) 10 / 3) n of either's n. Where that is
    no bound, classes meet by bins of node counts as wide as the threshold."""
    from parenlake.functions.distance import ATOM, GAP

    facts = trees.select("tree", _head().alias("head"), "subtree_nodes")
    share = 1 - (1 - threshold) * GAP / ATOM
    if share > 0:
        spelled = trees.select("tree", _head().alias("head"), "subtree_nodes", F.explode("labels").alias("label")).groupBy("tree", "head", "subtree_nodes", "label").count()
        numbered = spelled.select("tree", "head", "subtree_nodes", "label", F.explode(F.sequence(F.lit(1).cast("long"), "count")).alias("nth"))
        often = numbered.groupBy("head", "label", "nth").agg(F.count(F.lit(1)).alias("often"))
        ranked = numbered.join(often, ["head", "label", "nth"]).withColumn("rank", F.row_number().over(Window.partitionBy("tree").orderBy("often", "label", "nth")))
        prefix = F.col("subtree_nodes") - F.ceil(share * F.col("subtree_nodes") - 1e-9) + 1
        both = staged(ranked.filter(F.col("rank") <= prefix).select("tree", "head", "subtree_nodes", F.xxhash64("head", "label", "nth").alias("key")), "label-keys")
        return both, both
    size_bin = F.floor(F.log("subtree_nodes") / math.log(max(1.01, 1 / threshold))) if threshold > 0 else F.lit(0).cast("long")
    binned = facts.withColumn("bin", size_bin)
    beside = F.explode(F.array(F.col("bin") - 1, F.col("bin"), F.col("bin") + 1)) if threshold > 0 else F.col("bin")
    key = F.xxhash64("head", "bin").alias("key")
    return binned.withColumn("bin", beside).select("tree", "head", "subtree_nodes", key), binned.select("tree", "head", "subtree_nodes", key)


def candidates(trees: DataFrame, threshold: float) -> DataFrame:
    """left, right: classes of one head, by id, whose labels and sizes leave
    room for the threshold. Each pair once; equal trees are no pair."""
    left, right = _keys(trees, threshold)
    cuts = right.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("cuts")).filter("cuts > 1")
    block = F.pmod(F.hash("tree"), F.coalesce("cuts", F.lit(1)))
    ours = left.join(cuts, "key", "left").select(F.col("tree").alias("left"), F.col("head").alias("l_head"), F.col("subtree_nodes").alias("l_size"), "key", block.alias("block"))
    everywhere = F.explode(F.sequence(F.lit(0), F.coalesce("cuts", F.lit(1)) - 1))
    theirs = right.join(cuts, "key", "left").select(F.col("tree").alias("right"), F.col("head").alias("r_head"), F.col("subtree_nodes").alias("r_size"), F.col("key").alias("r_key"), everywhere.alias("r_block"))
    on = (F.col("key") == F.col("r_key")) & (F.col("block") == F.col("r_block")) & (F.col("l_head") == F.col("r_head")) & (F.col("left") < F.col("right"))
    pairs = ours.join(theirs, on & _fits(threshold, "l_size", "r_size")).select("left", "right")
    # Pairs take long to compare for their bytes: their number of tasks is kept.
    return pairs.repartition(int(trees.sparkSession.conf.get("spark.sql.shuffle.partitions")), "left", "right").distinct()


def patterns(trees: DataFrame) -> DataFrame:
    """tree, pattern and members of staged classes, staged.

    A label that only one class of a head has differs from every label of any
    other, whatever it is. Classes that are alike but for such labels are one
    pattern: they have the same distance to any class of another pattern, and
    any two of them have one distance."""
    spelled = trees.select("tree", _head().alias("head"), F.explode(F.array_distinct("labels")).alias("label"))
    own = spelled.groupBy("head", "label").agg(F.count(F.lit(1)).alias("n"), F.min("tree").alias("tree")).filter("n = 1").groupBy("tree").agg(F.collect_list("label").alias("own"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            told = []
            for head, labels, leftmost, mine in zip(*[batch.column(k).to_pylist() for k in range(2, 6)], strict=True):
                alone = set(mine or ())
                said = json.dumps([head, [x[0] if x in alone else x for x in labels], leftmost])
                told.append(hashlib.blake2b(said.encode(), digest_size=16).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(told, pa.string()), batch.column(1)], names=["tree", "pattern", "members"])

    rows = trees.hint("merge").join(own, "tree", "left").select("tree", "members", _head().alias("head"), "labels", "leftmost", "own")
    return staged(rows.mapInArrow(run, "tree string, pattern string, members long"), "patterns")


def _kinds(marked: DataFrame) -> DataFrame:
    """A row for each pattern: its classes, their members, and two of them."""
    return marked.groupBy("pattern").agg(F.count(F.lit(1)).alias("classes"), F.sum("members").alias("members"), F.min("tree").alias("first"), F.max("tree").alias("other"))


def pattern_links(trees: DataFrame, marked: DataFrame, threshold: float) -> DataFrame:
    """left, right, distance_x10 of the patterns whose classes reach the
    threshold, and of those too large to compare (distance null). A pattern is
    linked with itself where its own classes reach it."""
    kinds = staged(_kinds(marked), "kinds")
    spelled = trees.select(F.col("tree").alias("first"), "head", "subtree_nodes", "labels", "leftmost").hint("merge")
    shown = staged(kinds.select(F.col("pattern").alias("tree"), "first").join(spelled, "first").drop("first"), "shown")
    others = kinds.filter("classes > 1").select(F.col("pattern").alias("left"), F.col("pattern").alias("right"), F.col("other").alias("first")).join(spelled, "first")
    side = lambda s: shown.select(F.col("tree").alias(s), F.col("labels").alias(f"{s}_labels"), F.col("leftmost").alias(f"{s}_leftmost")).hint("merge")
    met = candidates(shown, threshold).join(side("left"), "left").join(side("right"), "right")
    met = met.unionByName(others.select("left", "right", F.col("labels").alias("right_labels"), F.col("leftmost").alias("right_leftmost")).join(side("left"), "left"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from parenlake.functions.distance import ATOM, GAP, distance, relabelled

        for batch in batches:
            costs, kept = [], []
            for k, (a, x, b, y) in enumerate(zip(*[batch.column(k).to_pylist() for k in range(2, 6)], strict=True)):
                most = (1 - threshold) * max(len(a), len(b)) * GAP + 1e-6
                if x == y and (cost := relabelled(a, b)) <= 2 * GAP:
                    least = cost  # one topology: changing labels is best
                else:
                    # What the label multisets alone force.
                    ours, theirs = Counter(a), Counter(b)
                    least = abs(len(a) - len(b)) * GAP + ATOM * min((ours - theirs).total(), (theirs - ours).total())
                    cost = None if least > most else distance((a, x), (b, y), most)
                if least <= most and (cost is None or cost <= most):
                    kept.append(k)
                    costs.append(cost)
            some = batch.take(pa.array(kept, pa.int64()))
            yield pa.RecordBatch.from_arrays([some.column(0), some.column(1), pa.array(costs, pa.int64())], names=["left", "right", "distance_x10"])

    rows = met.select("left", "right", "left_labels", "left_leftmost", "right_labels", "right_leftmost").mapInArrow(run, "left string, right string, distance_x10 long")
    return staged(rows, "pattern-links")


def _expanded(marked: DataFrame, links: DataFrame) -> DataFrame:
    """left, right, distance_x10 of classes, of links of patterns: blocks of one
    pattern's classes meet blocks of the other's."""
    cuts = _kinds(marked).select("pattern", F.ceil(F.col("classes") / BLOCK).cast("int").alias("cuts"))
    dealt = staged(marked.join(cuts, "pattern").select("pattern", F.pmod(F.hash("tree"), "cuts").alias("block"), "tree"), "blocks")
    side = lambda table, s, of: table.select(*[F.col(c).alias(f"{s}_{c}") for c in ("pattern", *of)])
    blocks = links.join(side(cuts, "l", ["cuts"]), F.col("left") == F.col("l_pattern")).join(side(cuts, "r", ["cuts"]), F.col("right") == F.col("r_pattern"))
    blocks = blocks.select("l_pattern", "r_pattern", "distance_x10", F.explode(F.sequence(F.lit(0), F.col("l_cuts") - 1)).alias("l_block"), "r_cuts")
    blocks = blocks.withColumn("r_block", F.explode(F.sequence(F.lit(0), F.col("r_cuts") - 1)))
    # Few rows that make very many: their number of tasks is kept.
    blocks = blocks.repartition(int(marked.sparkSession.conf.get("spark.sql.shuffle.partitions")), "l_pattern", "l_block", "r_pattern", "r_block")
    met = blocks.join(side(dealt, "l", ["block", "tree"]), ["l_pattern", "l_block"]).join(side(dealt, "r", ["block", "tree"]), ["r_pattern", "r_block"])
    return met.filter((F.col("l_pattern") != F.col("r_pattern")) | (F.col("l_tree") < F.col("r_tree"))).select(F.col("l_tree").alias("left"), F.col("r_tree").alias("right"), "distance_x10")


def class_links(trees: DataFrame, threshold: float) -> DataFrame:
    """left, right, distance_x10 of the classes at or above the threshold, and
    of those too large to compare (distance null). ``trees``: staged classes."""
    marked = patterns(trees)
    return _expanded(marked, pattern_links(trees, marked, threshold))


def _checked(threshold: float) -> None:
    if not 0 <= threshold <= 1:
        raise ValueError("threshold must lie between 0 and 1")


def possible_pairs(found: DataFrame, threshold: float, within: list[str]) -> DataFrame:
    """One row: possible, the pairs of forms that agree in ``within``, and
    pruned, those whose sizes alone rule the threshold out.

    In the order of node counts, each count's forms pair with all before them;
    a probe below the least partner of a count says how many of these are too
    small. One window over the node counts of a head gives both sums."""
    tally = found.groupBy(*within, F.col("subtree_nodes").alias("size")).agg(F.count(F.lit(1)).alias("n"))
    none = F.lit(0).cast("long")
    entries = tally.select(*within, F.col("size").cast("long").alias("at"), F.lit(1).alias("entry"), "n", none.alias("asking"))
    probes = tally.select(*within, F.ceil(threshold * F.col("size") - 1e-9).cast("long").alias("at"), F.lit(0).alias("entry"), none.alias("n"), F.col("n").alias("asking"))
    run = F.sum("n").over(Window.partitionBy(*within).orderBy("at", "entry").rowsBetween(Window.unboundedPreceding, 0))
    both = entries.unionByName(probes).withColumn("run", run)
    pairs = F.sum(F.col("n") * (F.col("run") - F.col("n")) + F.floor(F.col("n") * (F.col("n") - 1) / 2))
    return both.agg(F.coalesce(pairs, none).alias("possible"), F.coalesce(F.sum(F.col("asking") * F.col("run")), none).alias("pruned"))


def _pair_counts(found: DataFrame, marked: DataFrame, links: DataFrame, within: list[str]) -> DataFrame:
    """One row: matched and skipped pairs of forms, of equal trees or linked
    patterns, that agree in ``within``: members multiply."""
    pairs = lambda n: F.floor(n * (n - 1) / 2)
    held = found.join(marked.select("tree", "pattern"), "tree").groupBy("tree", "pattern", *within).agg(F.count(F.lit(1)).alias("n"))
    held = held.groupBy("pattern", *within).agg(F.sum("n").alias("n"), F.sum(pairs(F.col("n"))).alias("equal"))
    equal = held.agg(F.coalesce(F.sum("equal"), F.lit(0)).alias("equal"))
    left = held.select(F.col("pattern").alias("left"), F.col("n").alias("l_n"), F.col("equal").alias("l_equal"), *within)
    right = held.select(F.col("pattern").alias("right"), F.col("n").alias("r_n"), *within)
    met = links.join(left, "left").join(right, ["right", *within])
    product = F.when(F.col("left") == F.col("right"), pairs(F.col("l_n")) - F.col("l_equal")).otherwise(F.col("l_n") * F.col("r_n"))
    linked = met.agg(*[F.coalesce(F.sum(F.when(c, product)), F.lit(0)).alias(n) for n, c in (("linked", F.col("distance_x10").isNotNull()), ("skipped", F.col("distance_x10").isNull()))])
    return equal.crossJoin(linked).select((F.col("equal") + F.col("linked")).alias("matched"), "skipped")  # one row each


def similarity_summary(
    sources: DataFrame, threshold: float = 0.87, min_node_count: int = 4, min_line_span: int = 1, comparison_scope: str = "all", form_scope: str = "all",
    overlap_policy: str = "all", max_results: int | None = 10_000, fail_on_skipped: bool = False, fail_on_matches: bool = False,
) -> DataFrame:
    """One row about all pairs of forms with one head: possible; pruned by their
    sizes; skipped as too large to compare; unprocessed (none is left out);
    evaluated, all others; matched; suppressed as inside another match; reported
    and whether that is truncated; and the policy: ``decision`` is indeterminate
    where skipped pairs could change it, and passed only if it is passed."""
    _checked(threshold)
    found = staged(forms(sources, min_node_count, min_line_span, form_scope == "top-level").select("file_id", "path", _head().alias("head"), "tree", "subtree_nodes", "span_start", "span_end", "labels", "leftmost"), "forms")
    trees = classes(found)
    marked = patterns(trees)
    links = pattern_links(trees, marked, threshold)

    def counted(within: list[str]) -> DataFrame:
        return possible_pairs(found, threshold, ["head", *within]).crossJoin(_pair_counts(found, marked, links, within))  # one row each

    if comparison_scope == "cross-file":
        names = ["possible", "pruned", "matched", "skipped"]
        same = counted(["file_id"]).select(*[F.col(n).alias(f"s_{n}") for n in names])
        told = counted([]).crossJoin(same).select(*[(F.col(n) - F.col(f"s_{n}")).alias(n) for n in names])
    else:
        told = counted(["file_id"] if comparison_scope == "same-file" else [])
    if overlap_policy == "maximal":
        left = _maximal(_form_pairs(found, _expanded(marked, links), comparison_scope)).agg(F.count(F.lit(1)).alias("left"))
        told = told.crossJoin(left).withColumn("suppressed", F.col("matched") - F.col("left")).drop("left")
    else:
        told = told.withColumn("suppressed", F.lit(0).cast("long"))
    kept = F.col("matched") - F.col("suppressed")
    told = told.withColumn("evaluated", F.col("possible") - F.col("pruned") - F.col("skipped")).withColumn("reported", F.least(kept, F.lit(max_results)) if max_results is not None else kept)
    failed, unsure = F.lit(fail_on_matches) & (kept > 0), F.lit(fail_on_skipped or fail_on_matches) & (F.col("skipped") > 0)
    told = told.withColumn("decision", F.when(failed, "failed").when(unsure, "indeterminate").otherwise("passed"))
    return told.select("possible", "pruned", "skipped", F.lit(0).cast("long").alias("unprocessed"), "evaluated", "matched", "suppressed", "reported", (F.col("reported") < kept).alias("truncated"), "decision", (F.col("decision") == "passed").alias("passed"))


def similarity_classes(sources: DataFrame, threshold: float = 0.87, min_node_count: int = 4, min_line_span: int = 1, form_scope: str = "all") -> DataFrame:
    """A row for each form, however many others it resembles: file, path, its
    class's first form (class_file, class_path), members of the class, linked
    classes, and links: how many other forms reach the threshold with it."""
    _checked(threshold)
    found = staged(forms(sources, min_node_count, min_line_span, form_scope == "top-level").select("file_id", "path", "head", "tree", "subtree_nodes", "labels", "leftmost"), "forms")
    trees = classes(found)
    marked = patterns(trees)
    links = pattern_links(trees, marked, threshold).filter("distance_x10 IS NOT NULL")
    both = links.select(F.col("left").alias("pattern"), F.col("right").alias("other")).unionByName(links.filter("left <> right").select(F.col("right").alias("pattern"), F.col("left").alias("other")))
    sizes = _kinds(marked).select(F.col("pattern").alias("other"), "classes", F.col("members").alias("others"))
    near = both.join(sizes, "other").groupBy("pattern").agg(F.sum("classes").alias("linked_classes"), F.sum("others").alias("linked"), F.max((F.col("pattern") == F.col("other")).cast("long")).alias("itself"))
    near = marked.join(near, "pattern").select("tree", (F.col("linked_classes") - F.col("itself")).alias("linked_classes"), (F.col("linked") - F.col("itself") * F.col("members")).alias("linked"))
    first = found.groupBy("tree").agg(F.min(F.struct("file_id", "path")).alias("first"), F.count(F.lit(1)).alias("members"))
    told = found.select("tree", "file_id", "path").join(first, "tree").join(near, "tree", "left")
    dotted = lambda c: F.array_join(F.col(c).cast("array<string>"), ".")
    return told.select(
        "file_id", dotted("path").alias("path"), F.col("first.file_id").alias("class_file"), dotted("first.path").alias("class_path"), "members",
        F.coalesce("linked_classes", F.lit(0)).cast("long").alias("linked_classes"), (F.coalesce("linked", F.lit(0)) + F.col("members") - 1).cast("long").alias("links"),
    )


def _form_pairs(found: DataFrame, links: DataFrame, comparison_scope: str) -> DataFrame:
    """NAMES and distance_x10 of all matching pairs of forms, the one that comes
    first on the left."""
    place = lambda s: found.select(F.col("tree").alias(s), F.struct("file_id", "path", "span_start", "span_end", "subtree_nodes").alias(f"{s}_form"))
    near = links.filter("distance_x10 IS NOT NULL").join(place("left"), "left").join(place("right"), "right").select("left_form", "right_form", "distance_x10")
    equal = place("left").join(place("right"), (F.col("left") == F.col("right")) & (F.col("left_form") < F.col("right_form"))).select("left_form", "right_form", F.lit(0).cast("long").alias("distance_x10"))
    pairs = near.unionByName(equal).select(F.least("left_form", "right_form").alias("l"), F.greatest("left_form", "right_form").alias("r"), "distance_x10")
    if comparison_scope == "same-file":
        pairs = pairs.filter("l.file_id = r.file_id")
    elif comparison_scope == "cross-file":
        pairs = pairs.filter("l.file_id <> r.file_id")
    return pairs.select(*[F.col(f"{n[0]}.{n[2:]}").alias(n) for n in NAMES], "distance_x10")


def _maximal(matched: DataFrame) -> DataFrame:
    """The pairs that lie in no other of the same two files.

    Each pair asks for every form that holds its right form, by path. Among the
    pairs and questions of one such form and one left file, in the order of
    where left forms start, the running maximum of the ends of pairs' left forms
    says whether one of them holds the asker's. Equal left forms: a pair comes
    after its own question and before those of pairs further in."""
    inner, own, further = F.lit(1), F.lit(0), F.lit(2)
    asked = F.transform(F.sequence(F.lit(1), F.size("r_path")), lambda n: F.struct(F.slice("r_path", 1, n).alias("holder"), F.when(n == F.size("r_path"), own).otherwise(further).alias("turn")))
    rows = matched.withColumn("ask", F.explode(F.concat(asked, F.array(F.struct(F.col("r_path").alias("holder"), inner.alias("turn"))))))
    along = Window.partitionBy("l_file_id", "r_file_id", "ask.holder").orderBy("l_span_start", F.desc("l_span_end"), "ask.turn").rowsBetween(Window.unboundedPreceding, 0)
    reach = F.max(F.when(F.col("ask.turn") == inner, F.col("l_span_end"))).over(along)
    held = F.coalesce((F.col("ask.turn") != inner) & (reach >= F.col("l_span_end")), F.lit(False))
    told = rows.withColumn("held", held).groupBy(*NAMES, "distance_x10").agg(F.max("held").alias("held"))
    return told.filter("NOT held").drop("held")


def _scored(pairs: DataFrame, threshold: float, digits: int | None) -> DataFrame:
    """``pairs`` at or above the threshold, with similarity and score."""
    ratio = F.greatest(F.lit(0.0), 1 - F.col("distance_x10") / (10.0 * F.greatest("l_subtree_nodes", "r_subtree_nodes")))
    told = pairs.withColumn("similarity", ratio).filter(F.col("similarity") >= threshold)
    told = told.withColumn("score", F.col("similarity") * (F.col("l_subtree_nodes") + F.col("r_subtree_nodes")) / 2.0)
    return told if digits is None else told.withColumns({c: F.round(c, digits) for c in ("similarity", "score")})


def _dotted(column: str) -> Column:
    return F.array_join(F.col(column).cast("array<string>"), ".")


def _all_pairs(found: DataFrame, marked: DataFrame, links: DataFrame, threshold: float, comparison_scope: str, digits: int | None) -> DataFrame:
    """The report's columns, left_at and right_at of all matching pairs of forms: at is
    a number in the order of places.

    Forms of one pattern are a group, and so are copies of one tree; a link
    tells all about the pairs of two groups but who they are. Blocks of either
    group are units; a unit's left forms, a row each, meet the list of its right
    ones where it is read, and pairs are never shuffled."""
    tasks = _tasks(found)
    place = ["file_id", "path", "span_start", "span_end", "subtree_nodes", "tree"]
    ranged = found.select(*place).repartitionByRange(tasks, *place).withColumn("range", F.spark_partition_id().cast("long"))
    ranked = ranged.withColumn("at", F.shiftleft("range", 32) + F.dense_rank().over(Window.partitionBy("range").orderBy(*place)))
    copied = F.col("members") > 1
    groups = F.array_compact(F.array(F.struct(F.col("pattern").alias("group"), F.when(copied, F.col("tree")).alias("copy")), F.when(copied, F.struct(F.concat(F.lit("="), "tree").alias("group"), F.lit(None).cast("string").alias("copy")))))
    held = ranked.join(marked, "tree").select("at", "file_id", _dotted("path").alias("path"), "subtree_nodes", F.explode(groups).alias("in"))
    held = staged(held.select("in.group", F.struct("at", "file_id", "path", "in.copy").alias("form"), "subtree_nodes"), "held")
    cuts = staged(held.groupBy("group").agg(F.ceil(F.count(F.lit(1)) / DEALT).cast("int").alias("cuts"), F.max("subtree_nodes").alias("subtree_nodes")), "cuts")
    blocks = staged(held.join(cuts.select("group", "cuts"), "group").groupBy("group", F.pmod(F.hash("form.at"), "cuts").alias("block")).agg(F.collect_list("form").alias("forms")), "blocks")

    side = lambda table, s: table.select(*[F.col(c).alias(f"{s}_{c}") for c in table.columns])
    equal = cuts.filter("group LIKE '=%'").select(F.col("group").alias("left"), F.col("group").alias("right"), F.lit(0).cast("long").alias("distance_x10"))
    met = links.filter("distance_x10 IS NOT NULL").unionByName(equal)
    met = met.join(side(cuts, "l"), F.col("left") == F.col("l_group")).join(side(cuts, "r"), F.col("right") == F.col("r_group"))
    met = _scored(met, threshold, digits).withColumn("l_block", F.explode(F.sequence(F.lit(0), F.col("l_cuts") - 1)))
    itself = F.col("l_group") == F.col("r_group")
    met = met.withColumn("r_block", F.explode(F.sequence(F.when(itself, F.col("l_block")).otherwise(0), F.col("r_cuts") - 1)))
    told = ["distance_x10", "similarity", "score"]
    units = staged(met.select(F.monotonically_increasing_id().alias("unit"), "l_group", "l_block", "r_group", "r_block", (itself & (F.col("l_block") == F.col("r_block"))).alias("same"), *told), "units")
    # Few bytes that make very many rows: their number of tasks is kept. What is
    # joined is sorted, so a task makes the rows of one list at once, no more.
    with_forms = lambda s, *of: units.select("unit", f"{s}_group", f"{s}_block", *of).repartition(tasks, f"{s}_group", f"{s}_block").join(side(blocks, s).repartition(tasks, f"{s}_group", f"{s}_block").hint("merge"), [f"{s}_group", f"{s}_block"])
    ours = with_forms("l").select("unit", F.explode("l_forms").alias("l")).select("unit", *[F.col(f"l.{c}").alias(f"l_{c}") for c in ("at", "file_id", "path", "copy")])
    theirs = with_forms("r", "same", *told).select("unit", "same", *told, "r_forms")
    both = ours.repartition(tasks, "unit").join(theirs.repartition(tasks, "unit").hint("merge"), "unit")
    both = both.select("same", *told, "l_at", "l_file_id", "l_path", "l_copy", F.explode("r_forms").alias("r"))
    first = F.col("l_at") < F.col("r.at")
    both = both.filter((~F.col("same") | first) & F.coalesce(F.col("l_copy") != F.col("r.copy"), F.lit(True)))
    if comparison_scope == "same-file":
        both = both.filter("l_file_id = r.file_id")
    elif comparison_scope == "cross-file":
        both = both.filter("l_file_id <> r.file_id")
    pick = lambda c, d, name: [F.when(first, F.col(c)).otherwise(F.col(d)).alias(f"left_{name}"), F.when(first, F.col(d)).otherwise(F.col(c)).alias(f"right_{name}")]
    return both.select(*pick("l_file_id", "r.file_id", "file"), *pick("l_path", "r.path", "path"), *told, *pick("l_at", "r.at", "at"))


def similarity(
    sources: DataFrame, threshold: float = 0.87, min_node_count: int = 4, min_line_span: int = 1, comparison_scope: str = "all",
    form_scope: str = "all", overlap_policy: str = "maximal", max_results: int | None = 10_000, ranked: bool = True, digits: int | None = None,
) -> DataFrame:
    """Pairs at or above the threshold: files, paths, distance in tenths,
    similarity, score (similarity times mean size), best first. All pairs in no
    order (``ranked`` false) go out as they are made, without a sort.

    comparison_scope: all, same-file or cross-file; form_scope: all or
    top-level; overlap_policy: maximal drops a pair strictly inside another of
    the same two files, all keeps every pair; digits: similarity and score are
    rounded to so many, and ranked as rounded. Pairs too large to compare are
    not here; ``similarity_summary`` counts them."""
    _checked(threshold)
    if max_results is not None and not ranked:
        raise ValueError("max_results takes the best pairs: these must be ranked")
    found = staged(forms(sources, min_node_count, min_line_span, form_scope == "top-level").select("file_id", "path", "head", "tree", "subtree_nodes", "span_start", "span_end", "labels", "leftmost"), "forms")
    trees = classes(found)
    if overlap_policy == "maximal" and form_scope != "top-level":  # no top-level form lies in another
        matched = _scored(_maximal(_form_pairs(found, class_links(trees, threshold), comparison_scope)), threshold, digits)
        order = ["l_file_id", "l_path", "r_file_id", "r_path"]
        shown = [F.col("l_file_id").alias("left_file"), _dotted("l_path").alias("left_path"), F.col("r_file_id").alias("right_file"), _dotted("r_path").alias("right_path")]
    else:
        marked = patterns(trees)
        matched = _all_pairs(found, marked, pattern_links(trees, marked, threshold), threshold, comparison_scope, digits)
        order = ["left_at", "right_at"]
        shown = ["left_file", "left_path", "right_file", "right_path"]
    if ranked:
        matched = matched.orderBy(F.desc("score"), F.desc("similarity"), *order)
    matched = matched.limit(max_results) if max_results is not None else matched
    return matched.select(*shown, "distance_x10", "similarity", "score")
