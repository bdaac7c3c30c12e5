"""Building instruction datasets: sampling, templates, splits, deduplication, batching.

Randomness is md5 of `seed:key`, so every sample, split and shuffle repeats
exactly on any cluster and after any retry.
"""

from __future__ import annotations

import heapq
from collections.abc import Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.functions.columns import let, strip
from loomgraph.runtime import (
    cut_lineage,
    first_rows,
    keep_first,
    seeded_digest,
    with_group_index,
    top_k_per_group,
    with_global_index,
    with_group_running_sum,
    with_hash_rank,
    with_scalars,
)

UNIT = 2**52


def uniform(seed: int, *keys: Column | str) -> Column:
    """Seeded uniform number in [0, 1)."""
    return F.conv(F.substring(seeded_digest(seed, *keys), 1, 13), 16, 10).cast("double") / F.lit(float(UNIT))


# --- sampling --------------------------------------------------------------


def sample_by_frequency(rel: DataFrame, key: str, n: int, minimum: int, seed: int = 42) -> DataFrame:
    """At most n keys drawn with replacement by frequency from the top 2n, then made distinct.

    The candidate list is bounded by 2n, so its cumulative weights fit in one
    array; each draw looks its key up there.
    """
    counts = rel.filter(F.coalesce(F.trim(key), F.lit("")) != "").groupBy(F.col(key).alias("name")).agg(F.count("*").alias("n"))
    top = counts.filter(F.col("n") >= minimum).orderBy(F.desc("n"), "name").limit(2 * n)
    listed = top.agg(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("neg"), "name"))).alias("a"))
    sums = F.transform("a", lambda x, i: F.aggregate(F.slice("a", 1, i + 1), F.lit(0).cast("bigint"), lambda s, y: s - y.neg))
    listed = listed.select("a", sums.alias("cum"), F.size("a").alias("m"))
    few = listed.filter(F.col("m") <= n).select(F.explode("a.name").alias("name"))
    draws = listed.filter(F.col("m") > n).withColumn("j", F.explode(F.sequence(F.lit(1), F.lit(n))))
    u = uniform(seed, "j") * F.element_at("cum", -1)
    hit = F.size(F.filter("cum", lambda c: c <= F.col("u"))) + 1
    drawn = draws.withColumn("u", u).select(F.element_at("a", hit).getField("name").alias("name")).distinct()
    return few.unionByName(drawn)


def sample_values(rel: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """n distinct non-blank values in seeded order."""
    values = rel.select(F.col(key).cast("string").alias("value")).filter("value IS NOT NULL AND value <> ''").distinct()
    return first_rows(values, [seeded_digest(seed, "value"), F.col("value")], n)


def cap_rows(df: DataFrame, n: int, order: str, seed: int | None = None) -> DataFrame:
    """First n rows by position, or n rows at random without replacement."""
    lead = [] if seed is None else [seeded_digest(seed, order)]
    return first_rows(df, [*lead, F.col(order)], n)


def resample_by_score(
    df: DataFrame, score: str, key: str, method: str = "pow", power: float = 2.0, seed: int = 42, buckets: int | None = None
) -> DataFrame:
    """As many rows as before, drawn with replacement by weight.

    Weights are whole units laid end to end; each draw is a point on that line.
    The line is cut into equal buckets, so a draw meets only the rows of its
    bucket, and a heavy row is spread over many buckets. By default there is a
    bucket for every 64 rows.
    """
    buckets = buckets or max(1, df.count() // 64)
    s = F.col(score)
    if method == "pow":
        weight, base = F.pow(F.abs(s), F.lit(power)), df
    elif method in ("max_min", "max_random"):
        base = with_scalars(df, df.agg(F.max(score).alias("mx"), F.min(score).alias("mn")), "e")
        if method == "max_min":
            weight = F.when((s == F.col("e.mx")) | (s == F.col("e.mn")), 1.0).otherwise(0.0)
        else:
            weight = F.when(s == F.col("e.mx"), 0.4).otherwise(0.1)
    else:
        raise ValueError(f"unknown resampling method: {method}")
    units = F.greatest(F.round((weight + 1e-8) * 1e8), F.lit(1.0)).cast("decimal(30,0)")
    rows = base.withColumn("_u", units)
    line = with_group_running_sum(rows, [], [F.col(key)], F.col("_u"), "_lo")
    totals = rows.agg(F.sum("_u").cast("double").alias("w"), F.count("*").alias("n"))
    line = with_scalars(line, totals, "t")

    def bucket(c: Column) -> Column:
        return F.floor(c.cast("double") / F.col("t.w") * buckets)

    last = F.least(bucket(F.col("_lo") + F.col("_u")), F.lit(buckets))
    line = line.withColumn("_b", F.explode(F.sequence(bucket(F.col("_lo")), F.greatest(last, bucket(F.col("_lo"))))))
    # one draw per row: the row's key seeds its draw
    draws = with_scalars(rows.select(F.col(key).alias("draw")), totals, "t")
    draws = draws.withColumn("_p", F.floor(uniform(seed, "draw") * F.col("t.w")).cast("decimal(38,0)"))
    draws = draws.withColumn("_b", bucket(F.col("_p"))).select("draw", "_p", "_b")
    hit = draws.join(line.drop("t"), "_b").filter((F.col("_p") >= F.col("_lo")) & (F.col("_p") < F.col("_lo") + F.col("_u")))
    return hit.select("draw", *df.columns)


# --- templates -------------------------------------------------------------


def instantiate(patterns: DataFrame, values: DataFrame, copies: int, seed: int = 42) -> DataFrame:
    """Fill every pattern `copies` times with drawn parameter values.

    `patterns(pattern_id, template, context, params array<struct<name,type>>)`,
    `values(type, value)`. Values are numbered in order inside their type and a
    draw is a number, so a type may have any number of values. `x_start` /
    `x_end` parameters are put in order.
    """
    pools = with_group_index(values.select("type", "value").distinct(), ["type"], [F.col("value")], "at")
    sizes = pools.groupBy("type").agg(F.count("*").alias("n"))
    inst = patterns.withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(copies))))
    need = inst.select("pattern_id", "copy", F.posexplode("params").alias("p", "param")).select(
        "pattern_id", "copy", "p", F.col("param.name").alias("name"), F.col("param.type").alias("type")
    )
    at = F.floor(uniform(seed, "pattern_id", "copy", "name") * F.col("n"))
    drawn = need.join(sizes, "type").withColumn("at", at).join(pools, ["type", "at"])
    got = drawn.groupBy("pattern_id", "copy").agg(F.array_sort(F.collect_list(F.struct("p", "name", "value"))).alias("drawn"))
    out = inst.join(got, ["pattern_id", "copy"], "left")
    complete = F.size("params") == F.coalesce(F.size("drawn"), F.lit(0))
    out = out.filter((F.size("params") == 0) | complete)
    arr = F.coalesce("drawn", F.array().cast("array<struct<p:int,name:string,value:string>>"))
    ranged = F.exists(arr, lambda x: x["name"].endswith("_start")) & F.exists(arr, lambda x: x["name"].endswith("_end"))

    def ordered(a: Column) -> Column:
        ends = F.filter(a, lambda x: x["name"].endswith("_start") | x["name"].endswith("_end"))
        vals = F.transform(ends, lambda x: x["value"])
        low, high = F.array_min(vals), F.array_max(vals)
        return F.transform(
            a,
            lambda x: F.struct(
                x["p"].alias("p"),
                x["name"].alias("name"),
                F.when(x["name"].endswith("_start"), low).when(x["name"].endswith("_end"), high).otherwise(x["value"]).alias("value"),
            ),
        )

    out = out.withColumn("drawn", F.when(ranged, ordered(arr)).otherwise(arr))

    def fill(text: str, prefix: str, suffix: str, quote: str) -> Column:
        return F.aggregate(
            "drawn",
            F.col(text),
            lambda t, x: F.regexp_replace(
                t,
                F.concat(F.lit(prefix), x["name"], F.lit(suffix)),
                F.concat(F.lit(quote), F.regexp_replace(x["value"], r"([\\$])", r"\\$1"), F.lit(quote)),
            ),
        )

    return out.withColumn("text", fill("template", r"\$", r"\b", "'")).withColumn("context", fill("context", r"\{", r"\}", ""))


def quotas(count: int, shares: Mapping[str, float]) -> dict[str, int]:
    """Whole quotas per category; what rounding leaves over goes to the largest."""
    out = {c: int(count * r) for c, r in shares.items()}
    rest = count - sum(out.values())
    if rest > 0:
        out[max(out, key=out.get)] += rest
    return out


def take_quotas(df: DataFrame, text: str, category: str, limits: Mapping[str, int], seed: int = 42) -> DataFrame:
    """Exact-text duplicates out, then at most the quota of each category in seeded order."""
    unique = keep_first(df, [text], [F.col(category)])
    ranked = top_k_per_group(unique.withColumn("_d", seeded_digest(seed, text)), [category], [F.col("_d"), F.col(text)], max(limits.values()))
    allowed = F.lit(0)
    for name, n in limits.items():
        allowed = F.when(F.col(category) == name, n).otherwise(allowed)
    return ranked.filter(F.col("rank") <= allowed).drop("_d", "rank")


def question_from_template(template: Column, context: Column, params: Column) -> Column:
    """Question text with `{context}` and `{name}` replaced, and the placeholders left over.

    `params` is array<struct<name,value>>; the result is `struct<question, unreplaced>`.
    """
    filled = F.aggregate(params, F.replace(template, F.lit("{context}"), context), lambda t, x: F.replace(t, F.concat(F.lit("{"), x["name"], F.lit("}")), x["value"]))
    return let(filled, lambda q: F.struct(q.alias("question"), F.regexp_extract_all(q, F.lit(r"\{(\w+)\}"), F.lit(1)).alias("unreplaced")))


def validation_status(queries: DataFrame, rows: DataFrame, minimum: int = 1, maximum: int = 1000) -> DataFrame:
    """Status of executed queries from their result rows.

    `queries(qid, ok, error)`, `rows(qid, row_no, values array<string>)` with
    row_no from 1. Blank values are looked for in the first row, and in the
    first three when there is more than one row.
    """
    blank = F.exists("values", lambda v: (strip(v) == "") | (strip(v) == "null"))
    exact = F.exists("values", lambda v: v.isin("", "null"))
    per = rows.groupBy("qid").agg(
        F.count("*").alias("result_count"),
        F.bool_or(exact & (F.col("row_no") == 1)).alias("blank_first"),
        F.bool_or(blank & (F.col("row_no") <= 3)).alias("blank_top"),
    )
    out = queries.join(per, "qid", "left").na.fill(0, ["result_count"])
    n, low = F.col("result_count"), F.lower("error")
    status = (
        F.when(~F.col("ok") & low.contains("syntax"), "syntax_error")
        .when(~F.col("ok") & low.contains("timeout"), "timeout")
        .when(~F.col("ok"), "execution_error")
        .when(n < minimum, "empty_result")
        .when(n > maximum, "too_many_results")
        .when(F.coalesce("blank_first", F.lit(False)), "empty_result")
        .when((n > 1) & F.coalesce("blank_top", F.lit(False)), "empty_result")
        .otherwise("valid")
    )
    return out.select("qid", status.alias("status"), "result_count")


def accounting(generated: DataFrame, status: DataFrame) -> DataFrame:
    """Counts by status and category; `generated(qid, category)`."""
    rows = generated.join(status, "qid", "left")
    return rows.groupBy("category", F.coalesce("status", F.lit("not_run")).alias("status")).agg(F.count("*").alias("n"))


# --- splits and deduplication ----------------------------------------------


def split(df: DataFrame, key: str, ratio: float, stratum: str | None = None, seed: int = 42) -> DataFrame:
    """`split` = train or test; each stratum is cut at int(n * ratio) in seeded order."""
    keys = [stratum] if stratum else []
    ranked = with_hash_rank(df, keys, seeded_digest(seed, key), [F.col(key)], "_rank", "_size")
    cut = F.floor(F.col("_size") * F.lit(ratio) + 1e-9)
    return ranked.withColumn("split", F.when(F.col("_rank") <= cut, "train").otherwise("test")).drop("_rank", "_size")


def head_tail(df: DataFrame, order: str, head: float = 0.75, tail: float = 0.25) -> DataFrame:
    """Head and tail shares by position, percentages rounded to the nearest row."""
    rows = with_scalars(with_global_index(df, [F.col(order)], "_i"), df.agg(F.count("*").alias("n")), "t")
    n = F.col("t.n")
    first = F.bround(n * head, 0)
    last = n - F.bround(n * tail, 0)
    parts = F.array_compact(F.array(F.when(F.col("_i") < first, "train"), F.when(F.col("_i") >= last, "test")))
    return rows.withColumn("split", F.explode(parts)).drop("_i", "t")


def preference_to_instructions(df: DataFrame) -> DataFrame:
    """(prompt, chosen, rejected) -> two (prompt, response) rows, chosen first."""
    return df.select("prompt", F.posexplode(F.array("chosen", "rejected")).alias("n", "response"))


def dedup_nested(df: DataFrame, column: str, order: str) -> DataFrame:
    """First row of each canonical JSON of a nested column."""
    keyed = df.withColumn("_k", F.md5(F.to_json(column).cast("binary")))
    return keep_first(keyed, ["_k"], [F.col(order)]).drop("_k")


def word_count(c: Column) -> Column:
    return F.size(F.filter(F.split(c, r"\s+"), lambda w: w != ""))


def drop_long(df: DataFrame, text: str, limit: int, length: Column | None = None) -> DataFrame:
    """Rows within the length limit; rows that cannot be measured are dropped.

    `length` may be an Arrow UDF over a real tokenizer; the default counts words.
    """
    return df.filter((length if length is not None else word_count(F.col(text))) <= limit)


# --- row builders ----------------------------------------------------------


def message(role: str, content: Column) -> Column:
    return F.struct(F.lit(role).alias("role"), content.alias("content"))


def chat_row(source: str, prompt: list[Column], ability: str, truth: Column, index: Column, split_name: Column, **extra: Column) -> list[Column]:
    """Columns of one training row: source, prompt, ability, reward model, extra info."""
    return [
        F.lit(source).alias("data_source"),
        F.array(*prompt).alias("prompt"),
        F.lit(ability).alias("ability"),
        F.struct(F.lit("rule").alias("style"), truth.alias("ground_truth")).alias("reward_model"),
        F.struct(split_name.alias("split"), index.alias("index"), *[c.alias(n) for n, c in extra.items()]).alias("extra_info"),
    ]


def final_solution(answer: Column) -> Column:
    """First `#### n` of an answer without its commas."""
    return F.regexp_replace(F.regexp_extract(answer, r"#### (-?[0-9.,]+)", 1), ",", "")


def clean_ending(c: Column) -> Column:
    """Bracket artefacts off, title marks to full stops, double blanks to single ones."""
    s = F.replace(strip(c), F.lit(" [title]"), F.lit(". "))
    return F.replace(F.regexp_replace(s, r"\[.*?\]", ""), F.lit("  "), F.lit(" "))


def shuffled_options(key: Column, correct: Column, wrong: Sequence[Column], seed: int = 42) -> Column:
    """Options in seeded order and the letter of the correct one."""
    def tagged(c: Column, right: int) -> Column:
        return F.struct(F.md5(F.concat_ws(":", F.lit(str(seed)), key, c).cast("binary")).alias("h"), c.alias("text"), F.lit(right).alias("right"))

    options = F.array_sort(F.array(tagged(correct, 1), *[tagged(w, 0) for w in wrong]))

    def build(a: Column) -> Column:
        place = F.array_position(F.transform(a, lambda x: x.right), 1)
        return F.struct(F.transform(a, lambda x: x.text).alias("options"), F.char(place + 64).alias("gold"))

    return let(options, build)


def turns_to_messages(turns: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """One message array per conversation with a loss flag: 1 for the assistant."""
    flag = F.when(F.col(role) == "assistant", 1).otherwise(0)
    rows = F.array_sort(F.collect_list(F.struct(F.col(turn).alias("turn"), F.col(role).alias("role"), F.col(text).alias("content"), flag.alias("loss_mask"))))
    out = turns.groupBy(conv).agg(rows.alias("m"))
    return out.select(conv, F.transform("m", lambda m: m.dropFields("turn")).alias("messages"))


def append_completion(system: str, prompt: Column, completion: Column) -> Column:
    return F.concat(F.array(message("system", F.lit(system))), prompt, F.array(message("assistant", completion)))


def collapse(df: DataFrame, kept: Sequence[str], truths: Sequence[str]) -> DataFrame:
    """Ground truth from the first filled candidate; every other column into one struct."""
    given = [F.when(F.col(t) != "", F.col(t)) for t in truths if t in df.columns]
    extra = [c for c in df.columns if c not in kept and c != "ground_truth"]
    return df.select(*kept, F.coalesce(*given, F.lit("")).alias("ground_truth"), F.struct(*extra).alias("extra_info"))


# --- batch layout ----------------------------------------------------------


def repeat_rows(df: DataFrame, order: str, times: int, interleave: bool = True) -> DataFrame:
    """Every row `times` times; `position` gives aabbcc or abcabc order."""
    rows = with_global_index(df, [F.col(order)], "_i").withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(times - 1))))
    if interleave:
        return rows.withColumn("position", F.col("_i") * times + F.col("copy")).drop("_i")
    total = df.agg(F.count("*").alias("n")).select("n").scalar()
    return rows.withColumn("position", F.col("copy") * total + F.col("_i")).drop("_i")


def repeat_by_count(df: DataFrame, count: str) -> DataFrame:
    return df.withColumn("copy", F.explode(F.when(F.col(count) > 0, F.sequence(F.lit(1), F.col(count)))))


def chunk_rows(df: DataFrame, order: str, chunks: int) -> DataFrame:
    """Equal chunks in order; a remainder is an error."""
    rows = with_scalars(with_global_index(df, [F.col(order)], "_i"), df.agg(F.count("*").alias("n")), "t")
    n = F.col("t.n")
    size = F.when(n % chunks == 0, n / chunks).otherwise(F.raise_error(F.lit("rows do not divide into equal chunks")).cast("double"))
    return rows.withColumn("chunk", F.floor(F.col("_i") / size)).drop("_i", "t")


def split_rows(df: DataFrame, order: str, size: int) -> DataFrame:
    return with_global_index(df, [F.col(order)], "_i").withColumn("part", F.floor(F.col("_i") / size)).drop("_i")


def pad_rows(df: DataFrame, order: str, divisor: int) -> DataFrame:
    """Rows repeated from the start until the count divides; `padding` marks the copies."""
    rows = with_scalars(with_global_index(df, [F.col(order)], "_i"), df.agg(F.count("*").alias("n")), "t")
    pad = F.pmod(-F.col("t.n"), F.lit(divisor))
    # row i appears once, and again for every multiple of n below the pad size that reaches it
    times = F.when(F.col("_i") < pad, F.floor((pad - 1 - F.col("_i")) / F.col("t.n")) + 1).otherwise(0)
    rows = rows.withColumn("_c", F.explode(F.sequence(F.lit(0).cast("bigint"), times.cast("bigint"))))
    return rows.withColumn("padding", (F.col("_c") > 0).cast("int")).drop("_i", "_c", "t")


def unpad_rows(df: DataFrame) -> DataFrame:
    return df.filter("padding = 0").drop("padding")


# fixed values: workload of a sequence of n tokens
WORKLOAD_LINEAR = 24576


def workload(length: Column) -> Column:
    n = length.cast("bigint")
    return WORKLOAD_LINEAR * n + n * n


def serpentine(df: DataFrame, weight: Column, key: str, k: int) -> DataFrame:
    """Balanced parts at any size: ranks by weight dealt forward and backward in turn."""
    rows = with_global_index(df.withColumn("_w", weight), [F.desc("_w"), F.col(key)], "_i")
    step = F.col("_i") % (2 * k)
    return rows.withColumn("part", F.when(step < k, step).otherwise(2 * k - 1 - step)).drop("_i", "_w")


def settled(states: list[list[tuple[int, list]]], k: int) -> list[tuple[int, list]]:
    """`k` parts `(sum, members)` from partial solutions of up to `k` parts, by largest differencing.

    The two widest spreads are set against each other, so the spread of the
    result is at most the widest given.
    """
    heap = []
    for serial, state in enumerate(states):
        parts = sorted(state, key=lambda p: -p[0]) + [(0, [])] * (k - len(state))
        heapq.heappush(heap, (parts[-1][0] - parts[0][0], serial, parts))
    serial = len(states)
    while len(heap) > 1:
        a, b = heapq.heappop(heap)[2], heapq.heappop(heap)[2]
        parts = sorted(((x[0] + y[0], x[1] + y[1]) for x, y in zip(a, reversed(b))), key=lambda p: -p[0])
        heapq.heappush(heap, (parts[-1][0] - parts[0][0], serial, parts))
        serial += 1
    return heap[0][2] if heap else []


def differencing(weights: Sequence[int], k: int, equal_size: bool) -> list[int]:
    """Part of every weight by largest differencing."""
    order = sorted(range(len(weights)), key=lambda i: (weights[i], i))
    step = k if equal_size else 1
    starts = [[(weights[i], [i]) for i in order[at : at + step]] for at in range(0, len(order), step)]
    out = [0] * len(weights)
    for part, (_, members) in enumerate(settled(starts, k)):
        for i in members:
            out[i] = part
    return out


def differenced(df: DataFrame, weight: Column, key: str, k: int, parts: int = 64, rows: int = 16_384) -> DataFrame:
    """`df` with `part`: `k` parts by largest differencing in bounded blocks, whose results are differenced again.

    Rows are dealt serpentine into the `k` parts; `parts` neighbouring parts
    make a block. A block is cut into tasks of at most `rows` rows by rank,
    each solved alone, and then the `parts` sums of each task are set against
    each other. Inside a block the heaviest and the lightest part differ by at
    most the block's heaviest row. The second step sees `parts` sums for every
    `rows` rows of a block, so a block may hold millions of rows.
    """
    ranked = with_global_index(df.withColumn("_w", weight), [F.desc("_w"), F.col(key)], "_i")
    step = F.col("_i") % (2 * k)
    dealt = ranked.withColumn("_block", F.floor(F.when(step < k, step).otherwise(2 * k - 1 - step) / parts))
    dealt = dealt.withColumn("_task", F.floor(F.floor(F.col("_i") / k) / max(1, rows // parts)))

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_i")
        here = min(parts, k - int(pdf["_block"].iloc[0]) * parts)
        return pdf.assign(_slot=differencing(pdf["_w"].tolist(), here, False))

    def meet(pdf: pd.DataFrame) -> pd.DataFrame:
        block = int(pdf["_block"].iloc[0])
        pdf = pdf.sort_values(["_task", "_slot"]).reset_index(drop=True)
        states = [[(w, [at]) for at, w in zip(g.index, g["_w"].tolist())] for _, g in pdf.groupby("_task")]
        part = [0] * len(pdf)
        for p, (_, members) in enumerate(settled(states, min(parts, k - block * parts))):
            for at in members:
                part[at] = block * parts + p
        return pdf.assign(part=part)[["_block", "_task", "_slot", "part"]]

    solved = dealt.select("_i", "_block", "_task", "_w").groupBy("_block", "_task")
    solved = cut_lineage(solved.applyInPandas(solve, "_i long, _block long, _task long, _w long, _slot long"))
    sums = solved.groupBy("_block", "_task", "_slot").agg(F.sum("_w").alias("_w"))
    placed = sums.groupBy("_block").applyInPandas(meet, "_block long, _task long, _slot long, part long")
    out = solved.join(placed, ["_block", "_task", "_slot"]).select("_i", "part")
    return ranked.join(out, "_i").drop("_i", "_w")


def balance_batches(df: DataFrame, batch: str, key: str, length: str, k: int, equal_size: bool = False) -> DataFrame:
    """Exact differencing inside each training batch, whose size the trainer bounds."""
    schema = f"{batch} {df.schema[batch].dataType.simpleString()}, {key} {df.schema[key].dataType.simpleString()}, part int"

    def assign(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(key)
        n = pdf[length].astype("int64")
        return pdf[[batch, key]].assign(part=differencing((WORKLOAD_LINEAR * n + n * n).tolist(), k, equal_size))

    return df.join(df.select(batch, key, length).groupBy(batch).applyInPandas(assign, schema), [batch, key])


def greedy_parts(weights: Sequence[int], k: int, equal_size: bool) -> list[int]:
    """Each weight in turn to the lightest part; the lowest part wins ties."""
    bias = sum(weights) + 1 if equal_size else 0
    heap = [(0, j) for j in range(k)]
    out = []
    for w in weights:
        total, j = heapq.heappop(heap)
        out.append(j)
        heapq.heappush(heap, (total + w + bias, j))
    return out


def imbalance(df: DataFrame, order: str, length: str, part: str, k: int) -> DataFrame:
    """Sums of consecutive equal batches against the sums of the balanced parts."""
    rows = with_scalars(with_global_index(df, [F.col(order)], "_i"), df.agg(F.count("*").alias("n")), "t")
    before = rows.groupBy(F.floor(F.col("_i") / F.floor(F.col("t.n") / k)).alias("b")).agg(F.sum(length).alias("s"))
    after = df.groupBy(part).agg(F.sum(length).alias("s"))
    a = before.agg(F.min("s").alias("min"), F.max("s").alias("max"))
    b = after.agg(F.min("s").alias("balanced_min"), F.max("s").alias("balanced_max"), F.sum("s").alias("total"))
    both = with_scalars(a, b, "x")
    return both.select(
        "min",
        "max",
        (F.col("max") - F.col("min")).alias("minmax_diff"),
        F.col("x.balanced_min").alias("balanced_min"),
        F.col("x.balanced_max").alias("balanced_max"),
        (F.col("x.total") / k).alias("mean"),
    )


def micro_batches(
    df: DataFrame,
    key: str,
    length: str,
    budget: int,
    minimum: int | None = None,
    divisor: int | None = None,
    difference: bool = False,
    fit: bool = False,
) -> DataFrame:
    """Balanced micro-batches under a token budget.

    Their number is ceil(total / budget), at least `minimum`, at most the rows,
    and rounded up to a multiple of `divisor`. `micro_batch` is numbered so
    that light batches sit at both ends; `original_idx` restores the rows.
    Rows are dealt serpentine, or by largest differencing with `difference`.
    Batches balance work, so one may pass the budget in tokens; `fit` adds
    batches until none does.
    """
    totals = df.agg(F.count("*").alias("n"), F.coalesce(F.sum(length), F.lit(0)).alias("s"), F.max(length).alias("mx")).first()
    if (totals["mx"] or 0) > budget:
        raise ValueError("the budget must hold the longest row")
    k = min(totals["n"], max(minimum or 1, -(-totals["s"] // budget)))
    deal = differenced if difference else serpentine
    rows = with_global_index(df, [F.col(key)], "original_idx")
    while True:
        if divisor:
            k = -(-k // divisor) * divisor
        dealt = deal(rows, workload(F.col(length)), key, k)
        if not fit:
            break
        dealt = cut_lineage(dealt)
        heaviest = dealt.groupBy("part").agg(F.sum(length).alias("s")).agg(F.max("s")).first()[0] or 0
        if heaviest <= budget or k >= totals["n"]:
            break
        k = min(totals["n"], max(k + 1, -(-k * heaviest // budget)))
    # one row per micro-batch from here on
    loads = dealt.groupBy("part").agg(F.sum(workload(F.col(length))).alias("load"), F.min("original_idx").alias("first"))
    ranked = with_global_index(loads, [F.desc("load"), F.desc("first")], "r")
    # ranks 0, 2, 4, ... run down to the middle from the left end, 1, 3, ... from the right
    evens = (k + 1) // 2
    place = F.when(F.col("r") % 2 == 0, evens - 1 - F.floor(F.col("r") / 2)).otherwise(evens + F.floor(F.col("r") / 2))
    return dealt.join(ranked.select("part", place.alias("micro_batch")), "part").drop("part")


def micro_batch_report(batched: DataFrame, length: str, budget: int) -> DataFrame:
    """`(micro_batch, rows, tokens, work, fits)`: what each micro-batch holds and whether it keeps the budget."""
    loads = batched.groupBy("micro_batch").agg(
        F.count("*").alias("rows"), F.sum(length).alias("tokens"), F.sum(workload(F.col(length))).alias("work")
    )
    return loads.withColumn("fits", F.col("tokens") <= budget)


def instruction_rows(qa: DataFrame, system: str) -> DataFrame:
    return qa.select(F.lit(system).alias("instruction"), F.col("question").alias("input"), F.col("cypher").alias("output"))


