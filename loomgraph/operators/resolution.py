"""Entity resolution: blocked name similarity, decisions, and the mapping of every name."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from loomgraph.functions.text import comparison_name, entity_type, is_invalid_name, place_by_rules
from loomgraph.operators.graph import canonical_names, connected_components
from loomgraph.runtime import cut_lineage, top_k_per_group, with_global_index


@F.pandas_udf(DoubleType())
def matching_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Share of characters in the longest matching blocks of two strings."""
    return pd.Series([SequenceMatcher(None, x, y).ratio() if x and y else 0.0 for x, y in zip(a, b)])


def _blocked(names: DataFrame, prefix: int = 2) -> DataFrame:
    """`name, norm, n, block` of every distinct name that has a comparable form."""
    rows = names.select("name").distinct().withColumn("norm", comparison_name(F.col("name")))
    rows = rows.filter(F.length("norm") > 0).withColumn("n", F.length("norm"))
    return rows.withColumn("block", F.substring("norm", 1, prefix))


def _longest(n: Column, threshold: float) -> Column:
    """Length of the longest name that one of length n can agree with."""
    return F.floor(n * (2 - threshold) / threshold + 1e-9).cast("int")


def _errors(n: Column, m: Column, threshold: float) -> Column:
    """Most unmatched characters of two names of these lengths, whose number is even or odd as the sum of the lengths is."""
    most = F.floor((1 - threshold) * (n + m) + 1e-9).cast("int")
    return most - F.pmod(most + n + m, F.lit(2))


def _pieces(n: Column, errors: Column) -> Column:
    """Number of segments of a name of length n: more than the errors, and more still while they stay three characters long."""
    return F.least(n, F.greatest(errors + 1, F.least(2 * (errors + 1), F.floor(n / 3).cast("int"))))


def _start(i: Column, n: Column, k: Column) -> Column:
    return F.floor(i * n / k).cast("int")


def _length_pairs(rows: DataFrame, threshold: float, across: bool) -> DataFrame:
    """`(block, side, n, m, e, k)`: lengths of a shorter and a longer name that a block holds and that can agree with at
    least one character unmatched, the most unmatched characters e and the number of segments k. `side` is the shorter name's."""
    held = rows.select("block", "side", "n").distinct()
    other = held.select("block", (1 - F.col("side") if across else F.col("side")).alias("side"), F.col("n").alias("m"))
    both = held.join(other, ["block", "side"]).filter((F.col("n") <= F.col("m")) & (F.col("m") <= _longest(F.col("n"), threshold)))
    both = both.withColumn("e", _errors(F.col("n"), F.col("m"), threshold)).filter((F.col("e") > 0) & (F.col("e") >= F.col("m") - F.col("n")))
    return both.withColumn("k", _pieces(F.col("n"), F.col("e")))


def _same_form(rows: DataFrame) -> DataFrame:
    """Pairs of names of one form; at a ratio of 1 there are no others."""
    left, right = rows.select("block", "norm", F.col("name").alias("a")), rows.select("block", "norm", F.col("name").alias("b"))
    return left.join(right, ["block", "norm"]).filter("a < b").select("a", "b", F.lit(1.0).alias("ratio"))


def _segment_pairs(rows: DataFrame, threshold: float, across: bool = False) -> DataFrame:
    """Pairs `(a, b, ratio)` of `rows(name, norm, n, block, side)` within a block whose ratio reaches the threshold, exactly.

    Names of one form have the ratio 1. Of two others the shorter one is cut into k segments by the two lengths. At a
    ratio of t at most e = (1 - t)(|a| + |b|) characters are not matched, fewer by one where that is odd and the lengths
    add up to an even number. Each spoils one segment, so one of any e + 1 segments stands in the longer name unchanged,
    moved by no more than the errors allow. The rarest e + 1 segments are the keys of a name; the longer name probes with
    its own pieces of those lengths. A segment that many names share is no key unless a name has no rarer ones. Only
    lengths that the block holds are tried. Keys and probes are forms, once each however many names have them, and two
    that more than e single edits part are dropped where they meet; names come back for the rest, before the ratio is
    taken. With `across` a pair takes one name from each `side` (0 or 1) of the block.
    """
    rows = cut_lineage(rows)  # read some ten times below
    plan = _length_pairs(rows, threshold, across)
    forms = rows.select("block", "side", "norm", "n").distinct()
    n = F.col("n")
    cut = F.transform(
        F.sequence(F.lit(0), F.col("k") - 1),
        lambda i: F.struct(
            i.cast("int").alias("i"),
            F.substring(F.col("norm"), _start(i, n, F.col("k")) + 1, _start(i + 1, n, F.col("k")) - _start(i, n, F.col("k"))).alias("seg"),
        ),
    )
    at_lengths = ["block", "side", "n", "m"]
    cells = forms.join(plan, ["block", "side", "n"]).select("norm", *at_lengths, "e", F.inline(cut))
    common = cells.groupBy(*at_lengths, "i", "seg").agg(F.count("*").alias("df"))
    ranked = cells.join(common, [*at_lengths, "i", "seg"]).groupBy("norm", *at_lengths, "e").agg(
        F.array_sort(F.collect_list(F.struct("df", "i", "seg"))).alias("s")  # the segments of one form
    )
    chosen = F.slice("s", F.lit(1), F.least(F.size("s"), F.col("e") + 1))
    keys = ranked.select(F.col("norm").alias("short"), *at_lengths, "e", F.inline(chosen)).drop("df")

    # the longer name: for every length the other can have, its pieces at every place where a segment can have moved to
    other = (1 - F.col("side") if across else F.col("side")).alias("side")
    longer = forms.select("block", other, "norm", F.col("n").alias("m"))
    by_length = longer.join(plan, ["block", "side", "m"])
    placed = by_length.select("*", F.explode(F.sequence(F.lit(0), F.col("k") - 1)).alias("i"))
    at, size = _start(F.col("i"), F.col("n"), F.col("k")), _start(F.col("i") + 1, F.col("n"), F.col("k")) - _start(F.col("i"), F.col("n"), F.col("k"))
    gap = F.col("m") - F.col("n")
    low = F.greatest(F.lit(0), at - F.floor((F.col("e") - gap) / 2).cast("int"))
    high = F.least(F.col("m") - size, at + F.floor((F.col("e") + gap) / 2).cast("int"))
    places = F.when(low <= high, F.sequence(low, high))
    pieces = F.array_distinct(F.transform(places, lambda p: F.substring(F.col("norm"), p + 1, size)))
    probes = placed.select(F.col("norm").alias("long"), *at_lengths, "i", F.explode(pieces).alias("seg"))
    # of equal lengths either form is the shorter one of some row: one of them will do
    met = keys.join(probes, [*at_lengths, "i", "seg"]).filter((F.col("n") < F.col("m")) | (F.col("short") < F.col("long")))
    near = met.filter(F.expr("levenshtein(short, long, e) > 0"))  # -1 beyond e
    near = near.select("block", "side", "short", "long").distinct()

    shorter = rows.select("block", "side", F.col("norm").alias("short"), F.col("name").alias("name_a"))
    longer = rows.select("block", other, F.col("norm").alias("long"), F.col("name").alias("name_b"))
    pairs = near.join(shorter, ["block", "side", "short"]).join(longer, ["block", "side", "long"])
    # the ratio is not quite symmetric: always from the smaller name
    smaller = F.col("name_a") < F.col("name_b")
    first, second = F.when(smaller, F.col("short")).otherwise(F.col("long")), F.when(smaller, F.col("long")).otherwise(F.col("short"))
    names = pairs.select(F.least("name_a", "name_b").alias("a"), F.greatest("name_a", "name_b").alias("b"), first.alias("x"), second.alias("y"))
    scored = names.distinct().select("a", "b", matching_ratio("x", "y").alias("ratio")).filter(F.col("ratio") >= threshold)
    return scored if across else scored.unionByName(_same_form(rows))


def similar_in_block(names: DataFrame, threshold: float, prefix: int = 2) -> DataFrame:
    """All pairs `(a, b, ratio)` of a block whose ratio reaches the threshold above 0, exactly.

    A block holds the names that agree in their first `prefix` characters, so pairs that differ there are lost by
    design; `prefix=0` has no blocks and finds every pair, by the same index.
    """
    rows = _blocked(names, prefix).withColumn("side", F.lit(0))
    return _same_form(rows) if threshold >= 1 else _segment_pairs(rows, threshold)


def similar_across_blocks(names: DataFrame, threshold: float, head: int | None = 10) -> DataFrame:
    """Pairs between the first `head` names of a block and those of the next block.

    Later names of a block are left out by design; `head=None` takes them all.
    """
    rows = _blocked(names)
    if threshold >= 1:  # names of one form are in one block
        return names.sparkSession.createDataFrame([], "a string, b string, ratio double")
    heads = rows if head is None else top_k_per_group(rows, ["block"], [F.col("name")], head).drop("rank")
    blocks = with_global_index(rows.select("block").distinct(), [F.col("block")], "i")
    # two neighbours share a bridge, on which they are on different sides
    here = heads.join(blocks.select("block", F.col("i").cast("long").alias("at")), "block")
    bridges = here.select("name", "norm", "n", "at", F.explode(F.array("at", F.col("at") - 1)).alias("block"))
    side = (F.col("at") == F.col("block")).cast("int").alias("side")
    return _segment_pairs(bridges.select("name", "norm", "n", "block", side), threshold, across=True)


def rule_filter(pairs: DataFrame, minimum: float = 0.15) -> DataFrame:
    """Drop pairs of very different length and pairs with an invalid name."""
    a, b = F.length("a"), F.length("b")
    keep = (F.least(a, b) / F.greatest(a, b) >= minimum) & ~is_invalid_name(F.col("a")) & ~is_invalid_name(F.col("b"))
    return pairs.filter(keep)


Decider = Callable[[pd.DataFrame], pd.DataFrame]
DECISION = "original_name string, standard_name string, entity_type string, country string, province string, city string"


def default_decisions(names: DataFrame) -> DataFrame:
    """Heuristic decision for every name: person test and place rules, all as columns.

    `names(original_name, standard_name)`.
    """
    place = names.withColumn("p", place_by_rules(F.col("original_name")))
    return place.select(
        "original_name",
        "standard_name",
        entity_type(F.col("original_name")).alias("entity_type"),
        F.col("p.country").alias("country"),
        F.col("p.province").alias("province"),
        F.col("p.city").alias("city"),
    )


def decide(names: DataFrame, decider: Decider | None = None, known: DataFrame | None = None) -> DataFrame:
    """Decisions for `(original_name, standard_name)` rows, stored ones first.

    `known` is an earlier result; a decision is keyed by the md5 of its name
    pair. The decider sees batches of undecided rows; names it leaves out, or a
    whole batch that raises, fall back to the default.
    """
    key = F.md5(F.concat_ws(";", "original_name", "standard_name").cast("binary"))
    rows = names.withColumn("decision_key", key)
    done = None
    if known is not None:
        done = rows.select("decision_key").join(known, "decision_key")
        rows = rows.join(known.select("decision_key"), "decision_key", "left_anti")
    base = default_decisions(rows.select("original_name", "standard_name"))
    if decider is None:
        fresh = base
    else:

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                try:
                    yield decider(pdf)
                except Exception:  # noqa: BLE001 - any failure of the outside service means "undecided"
                    continue

        decided = rows.select("original_name", "standard_name").mapInPandas(run, DECISION)
        cols = [c for c in base.columns if c != "original_name"]
        both = base.select("original_name", F.struct(*cols).alias("d")).join(
            decided.select("original_name", F.struct(*cols).alias("x")), "original_name", "left"
        )
        fresh = both.select("original_name", F.coalesce("x", "d").alias("v")).select("original_name", "v.*")
    fresh = fresh.withColumn("decision_key", key)
    # keyed by the asked pair, not by a changed standard name
    asked = rows.select("original_name", F.col("decision_key").alias("k"))
    fresh = fresh.join(asked, "original_name").withColumn("decision_key", F.col("k")).drop("k")
    return fresh if done is None else done.select(*fresh.columns).unionByName(fresh)


def resolve_names(names: DataFrame, pairs: DataFrame) -> DataFrame:
    """Mapping of every name: components of the pairs, standard name per component.

    `names(name, n)` with the frequency of each name.
    """
    nodes = names.select(F.col("name").alias("node"))
    comps = connected_components(nodes, pairs.select("a", "b"))
    return canonical_names(comps, names.select(F.col("name").alias("node"), "n"))
