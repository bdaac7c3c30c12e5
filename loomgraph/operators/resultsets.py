"""Comparing predicted with expected result sets.

Results travel as one long table `(qid, side, row_no, values array<string>)`
with side 'gold' or 'pred'. No result set is gathered into one task: bags are
compared by signed counts per (query, column order, row).
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

from loomgraph.binding import GraphBinding
from loomgraph.functions.columns import let, strip
from loomgraph.operators.filters import filtered_items, without_group
from loomgraph.operators.ranking import exact_percentiles
from loomgraph.operators.sets import jaccard, over_retrieval
from loomgraph.operators.graph import connected_components
from loomgraph.runtime import cut_lineage, with_scalars

NULL_MARK = "\u0000"
SEP = "\u0001"
NUMBER_MARK = "\u0002"


def canonical_text(df: DataFrame, column: str) -> Column:
    """Comparable text of a result value: ISO dates, sorted lists, sorted map entries.

    Numbers and booleans are marked and in one form, so 1, 1.0 and true agree
    with each other and with no text; a text stays what it is.
    """
    kind = df.schema[column].dataType.typeName()
    c = F.col(column)
    if kind == "array":
        text = F.concat(F.lit("["), F.array_join(F.array_sort(F.transform(c, lambda x: x.cast("string"))), ","), F.lit("]"))
    elif kind == "map":
        pairs = F.transform(F.map_entries(c), lambda e: F.concat(e.key.cast("string"), F.lit("="), e.value.cast("string")))
        text = F.concat(F.lit("{"), F.array_join(F.array_sort(pairs), ","), F.lit("}"))
    elif kind == "date":
        text = F.date_format(c, "yyyy-MM-dd")
    elif kind == "boolean":
        text = F.concat(F.lit(NUMBER_MARK), c.cast("int").cast("string"))
    elif kind in ("byte", "short", "integer", "long"):
        text = F.concat(F.lit(NUMBER_MARK), c.cast("string"))
    elif kind in ("float", "double", "decimal"):
        text = F.concat(F.lit(NUMBER_MARK), normal_number(c.cast("string")))
    else:
        text = c.cast("string")
    return F.coalesce(text, F.lit(NULL_MARK))


def normal_number(c: Column) -> Column:
    """Text of a value with numbers and numeric strings in one form: 100, 100.0 and ' 100 ' agree."""
    number = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"

    def form(s: Column) -> Column:
        d = s.try_cast("double")
        whole = (d == F.floor(d)) & (F.abs(d) < 2.0**53)
        return F.when(~s.rlike(number), c).when(whole, d.cast("bigint").cast("string")).otherwise(F.concat(F.lit("f"), d.cast("string")))

    c = F.ltrim(c, F.lit(NUMBER_MARK))
    return let(strip(c), form)


def long_results(df: DataFrame, qid: str, side: str, columns: Sequence[str], order: str) -> DataFrame:
    """A result relation as rows of the long table."""
    values = F.array(*[canonical_text(df, c) for c in columns])
    return df.select(F.col(qid).alias("qid"), F.lit(side).alias("side"), F.col(order).alias("row_no"), values.alias("values"))


def column_orders(gold: Sequence, pred: Sequence, gold_pairs: Mapping, pred_pairs: Mapping, equal: Mapping[int, int]) -> list[list[int]]:
    """Orders of the predicted columns in which columns, and pairs of columns, agree as bags with the gold ones.

    Columns are placed one after the other, each agreeing with those before it. Of predicted columns that are equal in
    every row (`equal` names the first of each such class) only one is tried, since swapping them changes nothing.
    Without pairs the columns alone decide.
    """
    n = len(gold)
    if n != len(pred):
        return []
    out, todo = [], [[]]
    while todo:
        order = todo.pop()
        i = len(order)
        if i == n:
            out.append(order)
            continue
        tried = set()
        for j in range(n):
            if j in order or pred[j] != gold[i] or equal.get(j, j) in tried:
                continue
            if all(gold_pairs.get((k, i)) == pred_pairs.get((order[k], j)) for k in range(i)):
                tried.add(equal.get(j, j))
                todo.append([*order, j])
    return out


@F.pandas_udf(ArrayType(ArrayType(IntegerType())))
def _column_orders(gold: pd.Series, pred: pd.Series, pairs: pd.Series) -> pd.Series:
    def orders(g, p, told):
        sides: dict[str, dict] = {"gold": {}, "pred": {}}
        equal: dict[int, int] = {}
        for t in told if told is not None else []:
            sides[t["side"]][t["i"], t["j"]] = t["m"]
            if t["side"] == "pred" and t["same"]:
                equal[t["j"]] = min(equal.get(t["j"], t["j"]), t["i"])
        return column_orders(list(g), list(p), sides["gold"], sides["pred"], equal)

    return pd.Series([orders(*row) for row in zip(gold, pred, pairs)])


def _bag_mark(*values: str | Column) -> list[Column]:
    """Two sums of hashes that stand for a bag of rows."""
    return [
        F.sum(F.xxhash64(*values).cast("decimal(20,0)")).alias("h1"),
        F.sum(F.xxhash64(*reversed(values), F.lit(1)).cast("decimal(20,0)")).alias("h2"),
    ]


def _pair_marks(rows: DataFrame) -> DataFrame:
    """`(qid, pairs(side, i, j, m, same))`: the bag of every pair of columns, and whether they are equal in all rows."""
    n = F.size("values")
    pairs = F.flatten(
        F.transform(
            F.sequence(F.lit(0), n - 1),
            lambda i: F.transform(
                F.sequence(F.lit(0), n - 1),
                lambda j: F.struct(i.alias("i"), j.alias("j"), F.col("values")[i].alias("v"), F.col("values")[j].alias("w")),
            ),
        )
    )
    cells = rows.filter(n > 0).select("qid", "side", "pos", F.inline(pairs)).filter("i <> j")
    marks = cells.groupBy("qid", "side", "i", "j").agg(*_bag_mark("pos", "v", "w"), F.bool_and(F.col("v") == F.col("w")).alias("same"))
    pair = F.struct("side", "i", "j", F.concat_ws(":", "h1", "h2").alias("m"), "same")
    return marks.groupBy("qid").agg(F.collect_list(pair).alias("pairs"))


def execution_accuracy(queries: DataFrame, results: DataFrame) -> DataFrame:
    """1 when both results are equal as bags under some column order, else 0.

    `queries(qid, gold_text, pred_text, gold_ok, pred_ok)`. Identical texts
    score 1 without looking; a failed side scores 0; both empty is 1, one empty
    is 0. If the gold text orders its rows, the row number is part of the row.

    Column orders are limited to those whose columns agree as bags (an exact
    necessary condition); where several predicted columns agree with one gold
    column, pairs of columns must agree as well and equal columns count as one.
    Every remaining order is checked row by row.
    """
    q = queries.withColumn("same_text", F.trim("gold_text") == F.trim("pred_text"))
    q = q.withColumn("ordered", F.lower("gold_text").contains("order by"))
    sizes = results.groupBy("qid").agg(
        F.count_if(F.col("side") == "gold").alias("gold_rows"),
        F.count_if(F.col("side") == "pred").alias("pred_rows"),
    )
    q = q.join(sizes, "qid", "left").na.fill(0, ["gold_rows", "pred_rows"])
    settled = (
        F.when(F.col("same_text"), 1)
        .when(~F.col("gold_ok") | ~F.col("pred_ok"), 0)
        .when((F.col("gold_rows") == 0) & (F.col("pred_rows") == 0), 1)
        .when(F.col("gold_rows") != F.col("pred_rows"), 0)
    )
    q = q.withColumn("settled", settled)
    open_q = q.filter(F.col("settled").isNull()).select("qid", "ordered")
    rows = results.join(open_q, "qid")
    rows = rows.withColumn("pos", F.when(F.col("ordered"), F.col("row_no").cast("string")).otherwise(F.lit("")))

    cells = rows.select("qid", "side", "pos", F.posexplode("values").alias("col", "v"))
    columns = cells.groupBy("qid", "side", "col").agg(*_bag_mark("pos", "v"))
    prints = columns.groupBy("qid").agg(
        *[
            F.transform(
                F.array_sort(F.collect_list(F.when(F.col("side") == s, F.struct("col", F.concat_ws(":", "h1", "h2").alias("m"))))),
                lambda x: x.m,
            ).alias(s)
            for s in ("gold", "pred")
        ]
    )
    unclear = prints.filter((F.size("gold") == F.size("pred")) & (F.size(F.array_distinct("pred")) < F.size("pred")))
    pairs = _pair_marks(rows.join(unclear.select("qid"), "qid", "left_semi"))
    prints = prints.join(pairs, "qid", "left")
    orders = prints.select("qid", F.posexplode(_column_orders("gold", "pred", "pairs")).alias("order_id", "order"))

    tried = rows.join(orders, "qid")
    moved = F.when(F.col("side") == "gold", F.col("values")).otherwise(
        F.transform("order", lambda i: F.element_at("values", i + 1))
    )
    tried = tried.withColumn("key", F.concat_ws(SEP, "pos", F.array_join(moved, SEP)))
    balance = tried.groupBy("qid", "order_id", "key").agg(F.sum(F.when(F.col("side") == "gold", 1).otherwise(-1)).alias("d"))
    per_order = balance.groupBy("qid", "order_id").agg((F.max(F.abs("d")) == 0).alias("equal"))
    equal = per_order.groupBy("qid").agg(F.bool_or("equal").cast("int").alias("ex"))
    out = q.join(equal, "qid", "left")
    return out.select("qid", F.coalesce("settled", "ex", F.lit(0)).alias("ex"), "gold_rows", "pred_rows")


def quick_reject(results: DataFrame) -> DataFrame:
    """1 when the sets of rows, each sorted inside, differ: the results cannot be equal."""
    key = F.md5(F.array_join(F.array_sort("values"), SEP).cast("binary"))
    per_row = results.select("qid", "side", key.alias("k")).groupBy("qid", "k").agg(F.count_distinct("side").alias("sides"))
    return per_row.groupBy("qid").agg(F.max(F.when(F.col("sides") < 2, 1).otherwise(0)).alias("rejected"))


def column_candidates(results: DataFrame) -> DataFrame:
    """(gold column, pred column) pairs where every predicted value occurs in the gold column."""
    cells = results.select("qid", "side", F.posexplode("values").alias("col", "v")).distinct()
    gold = cells.filter("side = 'gold'").select("qid", "v", F.col("col").alias("gold_col"))
    pred = cells.filter("side = 'pred'").select("qid", "v", F.col("col").alias("pred_col"))
    need = pred.groupBy("qid", "pred_col").agg(F.count("*").alias("need"))
    have = pred.join(gold, ["qid", "v"]).groupBy("qid", "gold_col", "pred_col").agg(F.count("*").alias("have"))
    return have.join(need, ["qid", "pred_col"]).filter("have = need").select("qid", "gold_col", "pred_col")


def _value_sets(results: DataFrame, side: str, lenient: bool) -> DataFrame:
    """Distinct value sets of a side with how often each occurs."""
    vals = F.transform("values", normal_number) if lenient else F.col("values")
    sets = results.filter(F.col("side") == side).select("qid", "row_no", F.array_sort(F.array_distinct(vals)).alias("s"))
    return sets.groupBy("qid", "s").agg(F.count("*").alias("n"))


def covered_sets(results: DataFrame, lenient: bool = False) -> DataFrame:
    """Gold value sets with `found`: some predicted row holds all of its values.

    Both sides are reduced to distinct sets. A gold set probes the predictions
    through its rarest value only, so a value that every row shares never
    pairs all rows; the containment itself is checked on the probe's hits.
    """
    gold = _value_sets(results, "gold", lenient).withColumn("gid", F.xxhash64("qid", F.to_json("s")))
    pred = _value_sets(results, "pred", lenient)
    where = pred.select("qid", F.explode("s").alias("v"), F.col("s").alias("ps"))
    freq = where.groupBy("qid", "v").agg(F.count("*").alias("df"))
    cells = gold.select("qid", "s", F.explode("s").alias("v")).join(freq, ["qid", "v"], "left")
    probe = cells.groupBy("qid", "s").agg(F.min(F.struct(F.coalesce("df", F.lit(0)).alias("df"), F.col("v").alias("v"))).alias("p"))
    probe = probe.filter(F.col("p.df") > 0).select("qid", "s", F.col("p.v").alias("v"))
    hits = probe.join(where, ["qid", "v"]).filter(F.size(F.array_except("s", "ps")) == 0).select("qid", "s").distinct()
    return gold.join(hits.withColumn("found", F.lit(1)), ["qid", "s"], "left").na.fill(0, ["found"])


def semantic_match(results: DataFrame, queries: DataFrame, floor: float = 0.8) -> DataFrame:
    """Recall, precision and F1 of the gold rows found in the prediction; match at `floor`.

    A predicted row may serve many gold rows. `queries(qid)` lists the queries,
    so that empty results are scored too.
    """
    hit = covered_sets(results).groupBy("qid").agg(F.sum(F.col("n") * F.col("found")).alias("matched"))
    sizes = results.groupBy("qid").agg(
        F.count_if(F.col("side") == "gold").alias("gold_rows"), F.count_if(F.col("side") == "pred").alias("pred_rows")
    )
    rows = queries.select("qid").join(sizes, "qid", "left").join(hit, "qid", "left")
    rows = rows.na.fill(0, ["gold_rows", "pred_rows", "matched"])
    g, p, m = (F.col(c).cast("double") for c in ("gold_rows", "pred_rows", "matched"))
    recall = F.when(g == 0, 1.0).otherwise(m / F.when(g > 0, g))
    precision = F.when((g == 0) & (p == 0), 1.0).when((g == 0) | (p == 0), 0.0).otherwise(m / F.when(p > 0, p))
    rows = rows.withColumn("recall", recall).withColumn("precision", precision)
    both = F.col("precision") + F.col("recall")
    f1 = F.when((g == 0) & (p > 0), 0.0).when(both > 0, 2 * F.col("precision") * F.col("recall") / F.when(both > 0, both)).otherwise(0.0)
    return rows.withColumn("f1", f1).withColumn("semantic_match", (F.col("recall") >= floor).cast("int"))


def lenient_match_ordered(results: DataFrame) -> DataFrame:
    """Same number of rows, and each gold row's values lie in the tool row of the same number."""
    vals = F.array_distinct(F.transform("values", normal_number))
    g = results.filter("side = 'gold'").select("qid", "row_no", vals.alias("g"))
    p = results.filter("side = 'pred'").select("qid", "row_no", vals.alias("p"))
    both = g.join(p, ["qid", "row_no"], "full")
    fits = F.coalesce(F.size(F.array_except("g", "p")) == 0, F.lit(False)) & F.col("g").isNotNull() & F.col("p").isNotNull()
    return both.groupBy("qid").agg(F.bool_and(fits).cast("int").alias("match"))


def lenient_match(results: DataFrame) -> DataFrame:
    """Each gold row's value set lies in a tool row of its own, as many rows on both sides.

    Gold rows go in order and each takes the first free tool row that holds its values. Most queries are settled by
    counts: different numbers of rows, a gold set that no tool row covers, or sets of one size, where "contained" means
    "equal" and bags decide. The rest are split into components of the containment graph between distinct sets, found
    through each set's rarest value; rows of different components never compete. A component with one gold or one tool
    set is settled by its counts as well, so only rows with a choice are assigned one by one.
    """
    gold = _value_sets(results, "gold", True).withColumn("side", F.lit("gold"))
    pred = _value_sets(results, "pred", True).withColumn("side", F.lit("pred"))
    sets = gold.unionByName(pred).withColumn("w", F.size("s"))
    sign = F.when(F.col("side") == "gold", F.col("n")).otherwise(-F.col("n"))
    shape = sets.groupBy("qid").agg(
        F.sum(sign).alias("row_diff"),
        F.min("w").alias("min_w"),
        F.max("w").alias("max_w"),
    )
    bag = sets.groupBy("qid", "s").agg(F.sum(sign).alias("d")).groupBy("qid").agg((F.max(F.abs("d")) == 0).alias("bag_equal"))
    lost = covered_sets(results, lenient=True).groupBy("qid").agg((F.min("found") == 0).alias("uncovered"))
    state = shape.join(bag, "qid").join(lost, "qid", "left")
    verdict = (
        F.when(F.col("row_diff") != 0, 0)
        .when(F.coalesce("uncovered", F.lit(False)), 0)
        .when(F.col("min_w") == F.col("max_w"), F.col("bag_equal").cast("int"))
    )
    state = cut_lineage(state.select("qid", verdict.alias("match")))
    rest = results.join(state.filter("match IS NULL").select("qid"), "qid", "left_semi")
    assigned = _assigned_in_order(rest)
    return state.filter("match IS NOT NULL").unionByName(assigned)


def _assigned_in_order(results: DataFrame) -> DataFrame:
    """`(qid, match)` of queries whose gold sets are all covered and whose sides have as many rows."""
    values = F.array_sort(F.array_distinct(F.transform("values", normal_number)))
    node = F.md5(F.to_json(F.struct("qid", "side", "s")).cast("binary"))
    rows = cut_lineage(results.select("qid", "side", "row_no", values.alias("s")).withColumn("node", node))
    sets = rows.groupBy("qid", "side", "node").agg(F.first("s").alias("s"), F.count("*").alias("n"))
    gold, pred = (sets.filter(F.col("side") == side) for side in ("gold", "pred"))
    where = pred.select("qid", F.explode("s").alias("v"), F.col("node").alias("holder"), F.col("s").alias("ps"))
    rare = where.groupBy("qid", "v").agg(F.count("*").alias("df"))
    cells = gold.select("qid", "node", "s", F.explode("s").alias("v")).join(rare, ["qid", "v"])
    probe = cells.groupBy("qid", "node", "s").agg(F.min_by("v", F.struct("df", "v")).alias("v"))
    fits = probe.join(where, ["qid", "v"]).filter(F.size(F.array_except("s", "ps")) == 0)
    fits = cut_lineage(fits.select("qid", F.col("node").alias("a"), F.col("holder").alias("b")))
    nodes = sets.select("node")
    parts = connected_components(nodes, fits.select("a", "b"))
    placed = sets.join(parts, "node").select("qid", "component", "node", "side", "n")

    def total(column: Column, side: str) -> Column:
        return F.sum(F.when(F.col("side") == side, column).otherwise(0))

    shape = placed.groupBy("qid", "component").agg(
        total(F.lit(1), "gold").alias("gold_sets"),
        total(F.lit(1), "pred").alias("pred_sets"),
        (total(F.col("n"), "gold") <= total(F.col("n"), "pred")).cast("int").alias("enough"),
    )
    simple = (F.col("gold_sets") <= 1) | (F.col("pred_sets") <= 1)
    settled = shape.filter(simple | (F.col("enough") == 0)).select("qid", F.col("enough").alias("ok"))
    choice = shape.filter(~simple & (F.col("enough") == 1)).select("component")
    mine = placed.join(choice, "component", "left_semi").select(F.col("component").alias("part"), F.col("node").alias("of"))
    numbered = rows.join(mine, F.col("node") == F.col("of")).select("part", "qid", "side", "node", "row_no")
    theirs = mine.select(F.col("part").alias("in_part"), F.col("of").alias("known"))
    allowed = fits.join(theirs, F.col("a") == F.col("known")).select("in_part", "a", "b")

    def assign(rows: pd.DataFrame, fits: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("row_no", kind="stable")
        free = {node: list(g)[::-1] for node, g in rows[rows["side"] == "pred"].groupby("node")["row_no"]}
        holders = fits.groupby("a")["b"].agg(list).to_dict()
        ok = 1
        for node in rows.loc[rows["side"] == "gold", "node"]:
            left = [b for b in holders.get(node, []) if free[b]]
            if not left:
                ok = 0
                break
            free[min(left, key=lambda b: (free[b][-1], b))].pop()
        return pd.DataFrame({"qid": [rows["qid"].iloc[0]], "ok": [ok]}) if len(rows) else pd.DataFrame({"qid": [], "ok": []})

    qid_type = results.schema["qid"].dataType.simpleString()
    chosen = numbered.groupBy("part").cogroup(allowed.groupBy("in_part")).applyInPandas(assign, f"qid {qid_type}, ok int")
    return settled.unionByName(chosen).groupBy("qid").agg(F.min("ok").alias("match"))


def provenance_similarity(nodes: DataFrame, queries: DataFrame) -> DataFrame:
    """Jaccard of the node ids both queries touch: identical text 1, failure 0, both empty 0.

    `nodes(qid, side, node_id)`, `queries(qid, gold_text, pred_text, gold_ok, pred_ok)`.
    """
    part = jaccard(nodes.filter("side = 'gold'"), nodes.filter("side = 'pred'"), ["qid"], "node_id")
    out = queries.join(part.select("qid", "jaccard"), "qid", "left")
    score = (
        F.when(F.coalesce(F.trim("pred_text"), F.lit("")) == "", 0.0)
        .when(F.trim("pred_text") == F.trim("gold_text"), 1.0)
        .when(~F.col("gold_ok") | ~F.col("pred_ok"), 0.0)
        .otherwise(F.coalesce("jaccard", F.lit(0.0)))
    )
    return out.select("qid", score.alias("psjs"))


def error_class(message: Column) -> Column:
    low = F.lower(message)
    return F.when(low.contains("syntax"), "syntax_error").when(low.contains("timeout"), "timeout").otherwise("execution_error")


def evaluation_report(rows: DataFrame, keys: Sequence[str] = ("model",)) -> DataFrame:
    """One row per model: accuracy, rates, similarity, latency and token means.

    `rows(model, ex, executable, semantic_match, error_type, psjs, latency_ms, input_tokens, output_tokens)`.
    """
    out = rows.groupBy(*keys).agg(
        F.count("*").alias("total"),
        F.avg("ex").alias("execution_accuracy"),
        F.avg(F.col("executable").cast("int")).alias("executable_rate"),
        F.avg("semantic_match").alias("semantic_rate"),
        F.avg((F.coalesce("error_type", F.lit("")) == "syntax_error").cast("int")).alias("syntax_error_rate"),
        F.avg((F.coalesce("error_type", F.lit("")) == "timeout").cast("int")).alias("timeout_rate"),
        F.avg("psjs").alias("psjs"),
        F.avg("latency_ms").alias("latency_mean"),
        F.avg("input_tokens").alias("input_tokens"),
        F.avg("output_tokens").alias("output_tokens"),
    )
    points = exact_percentiles(rows, list(keys), "latency_ms", {"latency_p50": 0.5, "latency_p99": 0.99})
    return out.join(points, list(keys), "left")


def dimensions(text: Column, patterns: Mapping[str, Sequence[str]]) -> Column:
    """Names of the pattern groups of which one occurs in the text, case ignored."""
    hits = []
    for name, group in patterns.items():
        any_of = F.lit(False)
        for p in group:
            any_of = any_of | text.rlike("(?i)" + p)
        hits.append(F.when(any_of, name))
    return F.array_sort(F.array_compact(F.array(*hits)))


def hop_count(text: Column) -> Column:
    """Relations traversed before the first RETURN, at least 1."""
    match = F.split(text, "RETURN", 2)[0]

    def n(p: str) -> Column:
        return F.regexp_count(match, F.lit(p))

    return F.greatest(n(r"-\[.*?\]->") + n(r"<-\[.*?\]-"), n(r"-\[:?\w+\]->"), F.lit(1))


def query_type(text: Column) -> Column:
    """ranking, trend, count or list, from the query text."""
    tail = F.when(text.contains("RETURN"), F.element_at(F.split(text, "RETURN"), -1)).otherwise("")
    counts = tail.rlike(r"(?i)count\s*\(")
    return (
        F.when(text.rlike("(?i)ORDER BY.*LIMIT"), "ranking")
        .when(counts & text.rlike("(?i)year|substring.*0.*4"), "trend")
        .when(counts, "count")
        .otherwise("list")
    )


def expected_tool(text: Column) -> Column:
    """Tool a gold text asks for; the rank rule needs COUNT and is shadowed by the count rule."""
    up = F.upper(text)
    counted = up.contains("COUNT(") | up.contains("COUNT (")
    grouped = up.contains("GROUP BY") | up.contains("WITH")
    yearly = up.contains("YEAR") | up.contains("SUBSTRING")
    tail = F.lower(F.element_at(F.split(text, "RETURN"), -1))
    detail = F.lower(text).contains("application_no") & up.contains("RETURN") & (tail.contains("abstract") | tail.contains("title"))
    return (
        F.when(counted & grouped & yearly, "trend_patents")
        .when(counted, "count_patents")
        .when(up.contains("ORDER BY") & up.contains("LIMIT") & up.contains("COUNT"), "rank_patents")
        .when(up.contains("FULLTEXT"), "search")
        .when(detail, "get_patent_detail")
        .otherwise("query_patents")
    )


def consistency_vote(candidates: DataFrame) -> DataFrame:
    """Majority result among executable candidates; ties go to the candidate seen first.

    `candidates(qid, pos, text, ok, result_hash)`.
    """
    votes = candidates.filter("ok").groupBy("qid", "result_hash").agg(
        F.count("*").alias("votes"), F.min("pos").alias("first_pos"), F.min_by("text", "pos").alias("text")
    )
    best = F.min_by(F.struct("text", "result_hash", "votes"), F.struct((-F.col("votes")).alias("v"), "first_pos"))
    return votes.groupBy("qid").agg(best.alias("b")).select("qid", "b.*")


def result_hash(rows: DataFrame) -> DataFrame:
    """md5 over the sorted row texts of every candidate; 'empty' is left to the caller.

    Rows are folded to an order-free sum of two hashes, so a long result is
    never sorted in one place. `rows(qid, pos, row_text)`.
    """
    h = [F.sum(F.xxhash64(F.lit(i), "row_text").cast("decimal(20,0)")).alias(f"h{i}") for i in (1, 2)]
    agg = rows.groupBy("qid", "pos").agg(F.count("*").alias("n"), *h)
    return agg.select("qid", "pos", F.md5(F.concat_ws(":", "n", "h1", "h2").cast("binary")).alias("result_hash"))


def relaxation_report(
    graph: GraphBinding, specs: Sequence[tuple[str, Mapping[str, object]]], groups: Mapping[str, set[str]]
) -> DataFrame:
    """Per dimension: how often dropping its conditions over-retrieves, and by how much.

    Every spec is run as given and once per dimension with that dimension's
    conditions removed; specs the removal leaves unchanged are skipped.
    """
    gold, relaxed = [], []
    for qid, spec in specs:
        for dim, members in groups.items():
            loose = without_group(spec, members)
            if loose == dict(spec):
                continue
            tags = [F.lit(dim).alias("dim"), F.lit(qid).alias("qid"), "item_id"]
            gold.append(filtered_items(graph, spec).select(*tags))
            relaxed.append(filtered_items(graph, loose).select(*tags))

    def stack(frames: list[DataFrame]) -> DataFrame:
        out = frames[0]
        for f in frames[1:]:
            out = out.unionByName(f)
        return out

    per_query = over_retrieval(stack(relaxed), stack(gold), ["dim", "qid"], "item_id")
    return per_query.groupBy("dim").agg(
        F.count("*").alias("total"),
        F.count_if(F.col("over_retrieved") > 0).alias("violations"),
        (F.count_if(F.col("over_retrieved") > 0) * 100.0 / F.count("*")).alias("violation_pct"),
        F.avg("inflation").alias("avg_inflation"),
    )


def retrieval_scores(found: DataFrame, gold: DataFrame, queries: DataFrame) -> DataFrame:
    """Mean precision and recall of retrieval variants by number of dimensions; empty gold left out.

    `found(qid, method, node_id)`, `gold(qid, node_id)`, `queries(qid, n_dims)`.
    """
    methods = found.agg(F.collect_set("method").alias("methods"))
    grid = with_scalars(queries.select("qid", "n_dims"), methods, "m")
    grid = grid.select("qid", "n_dims", F.explode("m.methods").alias("method"))
    hits = found.distinct().join(gold.distinct().withColumn("hit", F.lit(1)), ["qid", "node_id"], "left")
    per = hits.groupBy("qid", "method").agg(F.count("*").alias("found"), F.count("hit").alias("tp"))
    size = gold.distinct().groupBy("qid").agg(F.count("*").alias("gold"))
    rows = grid.join(size, "qid").join(per, ["qid", "method"], "left").na.fill(0, ["found", "tp"])
    precision = F.when(F.col("found") == 0, 0.0).otherwise(F.try_divide(F.col("tp").cast("double"), F.col("found")))
    rows = rows.withColumn("precision", precision).withColumn("recall", F.col("tp").cast("double") / F.col("gold"))
    return rows.groupBy("method", "n_dims").agg(
        F.count("*").alias("queries"), F.avg("precision").alias("precision"), F.avg("recall").alias("recall")
    )


# fixed values: what the question templates may use
TEMPLATE_RELATIONS = ["BELONGS_TO", "APPLIED_BY", "LOCATED_IN", "TRANSFERRED_TO"]
NON_TEMPLATE_MARKERS = [
    "NOT EXISTS", "NOT (", "OPTIONAL MATCH", "CASE WHEN", "CASE ", "toFloat", "collect(", "any(", "all(", "size(",
    "UNION", "UNWIND", "coalesce(", "EXISTS {", "STARTS WITH",
]


def out_of_template(text: Column) -> Column:
    """`struct<relations, operators, is_oot>`: what lies outside the template lists."""
    known = F.array(*[F.lit(r) for r in TEMPLATE_RELATIONS])
    used = F.array_distinct(F.regexp_extract_all(text, F.lit(r"\[:([A-Z_]+)\]"), F.lit(1)))
    marks = F.array_compact(F.array(*[F.when(text.contains(m), m) for m in NON_TEMPLATE_MARKERS]))
    pair = F.struct(F.array_sort(F.array_except(used, known)).alias("relations"), marks.alias("operators"))
    return let(
        pair, lambda p: F.struct(p.relations.alias("relations"), p.operators.alias("operators"), ((F.size(p.relations) > 0) | (F.size(p.operators) > 0)).alias("is_oot"))
    )


def diversity(rows: DataFrame, text: str, prefix: int = 4) -> DataFrame:
    """Length statistics and the share of distinct openings."""
    return rows.agg(
        F.avg(F.length(text)).alias("avg_length"),
        F.min(F.length(text)).alias("min_length"),
        F.max(F.length(text)).alias("max_length"),
        (F.count_distinct(F.substring(text, 1, prefix)) / F.count("*")).alias("unique_start_ratio"),
    )


def top_prefixes(rows: DataFrame, text: str, prefix: int = 4, n: int = 10) -> DataFrame:
    starts = rows.groupBy(F.substring(text, 1, prefix).alias("start")).agg(F.count("*").alias("n"))
    return starts.orderBy(F.desc("n"), "start").limit(n)


def word_shares(rows: DataFrame, text: str, words: Sequence[str]) -> DataFrame:
    """How many texts hold each word, and their share in percent."""
    hits = F.explode(F.array_compact(F.array(*[F.when(F.col(text).contains(w), w) for w in words])))
    total = rows.agg(F.count("*").alias("t")).select("t").scalar()
    counts = rows.select(hits.alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    return counts.withColumn("share", F.col("n") * 100.0 / total)


def case_studies(rows: DataFrame, n: int = 10, minimum_dims: int = 2) -> DataFrame:
    """Queries the first model gets right and the second wrong, most dimensions and hops first.

    `rows(qid, a_correct, b_correct, n_dims, hops)`.
    """
    picked = rows.filter(F.col("a_correct") & ~F.col("b_correct") & (F.col("n_dims") >= minimum_dims))
    return picked.orderBy(F.desc("n_dims"), F.desc("hops"), "qid").limit(n)


def materialise_answers(graph: GraphBinding, specs: Sequence[tuple[str, Mapping[str, object]]]) -> DataFrame:
    """Gold answers of many filter specs as one table `(qid, success, row_count)`.

    A spec with an unknown key is a failed query, as a query that does not run.
    """
    from functools import reduce

    rows, status = [], []
    for qid, spec in specs:
        try:
            rows.append(filtered_items(graph, spec).select(F.lit(qid).alias("qid"), "item_id"))
            status.append((qid, 1))
        except ValueError:
            status.append((qid, 0))
    spark = graph.items().sparkSession
    counts = reduce(DataFrame.unionByName, rows).groupBy("qid").agg(F.count("*").alias("row_count"))
    base = spark.createDataFrame(status, "qid string, success int")
    return base.join(counts, "qid", "left").na.fill(0, ["row_count"])
