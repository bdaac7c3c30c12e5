"""Group-relative advantages and batch statistics over response tables.

A response is one row: `uid` (prompt group), `pos` (order in the batch),
`score`, and per-token arrays such as `mask`, `rewards`, `values`. Group
statistics are aggregates joined back, so a group of any size is fine.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from loomgraph.functions.columns import let
from loomgraph.runtime import cut_lineage, first_rows, top_k_per_group, with_group_index, with_group_running_sum, with_group_stats, with_once, with_scalars

EPS = 1e-6
SAFETY = 20.0

# --- token helpers ---------------------------------------------------------


def token_sum(values: Column, mask: Column | None = None) -> Column:
    """Sum over the tokens whose mask is set."""
    masked = values if mask is None else F.zip_with(values, mask, lambda x, m: F.when(m != 0, x * m).otherwise(0.0))
    return F.aggregate(masked, F.lit(0.0), lambda s, x: s + x)


def token_count(mask: Column) -> Column:
    return F.aggregate(mask, F.lit(0.0), lambda s, m: s + m)


def broadcast_to_tokens(value: Column, mask: Column) -> Column:
    return let(value, lambda v: F.transform(mask, lambda m: v * m))


def masked_moments(df: DataFrame, values: str, mask: str) -> DataFrame:
    """One row: token count, masked mean and Bessel-corrected masked variance."""
    v, m = F.col(values), F.col(mask)
    sq = F.transform(v, lambda x: x * x)
    sums = df.agg(F.sum(token_count(m)).alias("n"), F.sum(token_sum(v, m)).alias("s"), F.sum(token_sum(sq, m)).alias("q"))
    mean = F.col("s") / (F.col("n") + 1e-8)
    centred = F.col("q") - 2 * mean * F.col("s") + mean * mean * F.col("n")
    var = centred / (F.col("n") + 1e-8) * F.col("n") / (F.col("n") - 1)
    return sums.select(F.col("n"), F.col("s").alias("sum"), mean.alias("mean"), var.alias("var"))


def whiten(df: DataFrame, values: str, mask: str, out: str, shift_mean: bool = True) -> DataFrame:
    """Values to zero mean and unit variance over all masked tokens of the table."""
    stats = with_scalars(df, masked_moments(df, values, mask), "w")

    def one(x: Column) -> Column:
        y = (x - F.col("w.mean")) / F.sqrt(F.col("w.var") + 1e-8)
        return y if shift_mean else y + F.col("w.mean")

    return stats.withColumn(out, F.transform(values, one)).drop("w")


# tokens that a fold gathers before it adds them to the row's result, which keeps long rows from being copied per token
FOLD_BLOCK = 256


def from_the_end(tokens: Column, start: Mapping[str, Column], step: Callable[[Column, Column], dict[str, Column]], out: str) -> Column:
    """State `out` at every token of a recurrence that runs from the last token to the first.

    `step(state, token)` gives the next state, of which each part is an affine map of the one before.
    """

    def state(parts: Mapping[str, Column], values: Column) -> Column:
        return F.struct(*[c.cast("double").alias(n) for n, c in parts.items()], values.alias("values"))

    nothing = F.array().cast("array<double>")

    def one(s: Column, t: Column) -> Column:
        moved = F.struct(*[c.cast("double").alias(n) for n, c in step(s, t).items()])
        return let(moved, lambda m: state({n: m[n] for n in start}, F.concat(F.array(m[out]), s["values"])))

    def block(s: Column, part: Column) -> Column:
        inner = F.aggregate(part, state({n: s[n] for n in start}, nothing), one)
        return let(inner, lambda r: state({n: r[n] for n in start}, F.concat(r["values"], s["values"])))

    def blocks(back: Column) -> Column:
        firsts = F.when(F.size(back) > 0, F.sequence(F.lit(1), F.size(back), F.lit(FOLD_BLOCK)))
        return F.transform(F.coalesce(firsts, F.array().cast("array<int>")), lambda i: F.slice(back, i, FOLD_BLOCK))

    return F.aggregate(let(F.reverse(tokens), blocks), state(start, nothing), block, lambda s: s["values"])


def discounted_returns(rewards: Column, mask: Column, gamma: float) -> Column:
    """Reverse discounted sum; a masked token cuts the sum that reaches earlier tokens."""
    tokens = F.zip_with(rewards, mask, lambda r, m: F.struct(r.cast("double").alias("r"), m.cast("double").alias("m")))

    def step(s: Column, t: Column) -> dict[str, Column]:
        here = t["r"] + gamma * s["run"]
        return {"back": here, "run": here * t["m"]}

    return from_the_end(tokens, {"back": F.lit(0.0), "run": F.lit(0.0)}, step, "back")


def gae_advantages(rewards: Column, values: Column, mask: Column, gamma: float, lam: float) -> Column:
    """Exponentially weighted temporal differences; masked tokens are passed over and repeat what follows them."""
    pairs = F.zip_with(rewards, values, lambda r, v: F.struct(r.cast("double").alias("r"), v.cast("double").alias("v")))
    tokens = F.zip_with(pairs, mask, lambda p, m: F.struct(p["r"].alias("r"), p["v"].alias("v"), (m.cast("double") != 0).alias("here")))

    def step(s: Column, t: Column) -> dict[str, Column]:
        moved = t["r"] + gamma * s["next"] - t["v"] + gamma * lam * s["last"]
        return {"last": F.when(t["here"], moved).otherwise(s["last"]), "next": F.when(t["here"], t["v"]).otherwise(s["next"])}

    return from_the_end(tokens, {"last": F.lit(0.0), "next": F.lit(0.0)}, step, "last")


# --- group statistics ------------------------------------------------------


def group_stats(df: DataFrame, key: str = "uid", score: str = "score", eps: float = EPS) -> DataFrame:
    """Mean, sample std (variance floored at eps) and count of the row's group; a singleton gives 0 and 1."""
    rows = with_group_stats(
        df, [key], F.count("*").alias("count"), F.avg(score).alias("_m"), F.var_samp(score).alias("_v")
    )
    single = F.col("count") == 1
    return rows.select(
        *df.columns,
        F.when(single, 0.0).otherwise(F.col("_m")).alias("mean"),
        F.when(single, 1.0).otherwise(F.sqrt(F.greatest("_v", F.lit(eps)))).alias("std"),
        "count",
    )


def _grouped(df: DataFrame) -> DataFrame:
    rows = with_group_stats(df, ["uid"], F.count("*").alias("_n"), F.avg("score").alias("_m"), F.stddev_samp("score").alias("_s"))
    single = F.col("_n") == 1
    return rows.withColumn("_mean", F.when(single, 0.0).otherwise(F.col("_m"))).withColumn(
        "_std", F.when(single, 1.0).otherwise(F.col("_s"))
    )


def grpo(df: DataFrame, normalise: bool = True, eps: float = EPS) -> DataFrame:
    """(r - mean) / (std + eps) in the group; without the division if not normalised."""
    diff = F.col("score") - F.col("_mean")
    return _grouped(df).select(*df.columns, (diff / (F.col("_std") + eps) if normalise else diff).alias("advantage"))


def passk(df: DataFrame, normalise: bool = True, eps: float = EPS) -> DataFrame:
    """Only the best response of a group gets r1 - r2 (over std); a group of one is an error."""
    top = top_k_per_group(df.select("uid", "pos", "score"), ["uid"], [F.desc("score"), F.col("pos")], 2)
    two = top.groupBy("uid").agg(
        F.max(F.when(F.col("rank") == 1, F.col("score"))).alias("_r1"),
        F.max(F.when(F.col("rank") == 2, F.col("score"))).alias("_r2"),
        F.max(F.when(F.col("rank") == 1, F.col("pos"))).alias("_best"),
        F.count("*").alias("_n2"),
    )
    stats = df.groupBy("uid").agg(F.stddev_samp("score").alias("_s"))
    rows = df.join(two.join(stats, "uid"), "uid")
    gain = F.col("_r1") - F.col("_r2")
    if normalise:
        gain = gain / (F.col("_s") + eps)
    error = F.raise_error(F.concat(F.lit("pass@k needs two responses per group: "), F.col("uid").cast("string"))).cast("double")
    adv = F.when(F.col("_n2") < 2, error).when(F.col("pos") == F.col("_best"), gain).otherwise(0.0)
    return rows.select(*df.columns, adv.alias("advantage"))


def best_margin(df: DataFrame) -> DataFrame:
    """Best minus second best score per group."""
    top = top_k_per_group(df.select("uid", "pos", "score"), ["uid"], [F.desc("score"), F.col("pos")], 2)
    return top.groupBy("uid").agg((F.max("score") - F.min("score")).alias("margin"))


def rloo(df: DataFrame, singleton_keeps_score: bool = True) -> DataFrame:
    """Leave-one-out baseline: n / (n - 1) (r - mean). A singleton keeps its score, or gets 0."""
    n = F.col("_n")
    alone = F.col("score") if singleton_keeps_score else F.lit(0.0)
    adv = F.when(n > 1, (F.col("score") - F.col("_m")) * n / F.when(n > 1, n - 1)).otherwise(alone)
    return _grouped(df).select(*df.columns, adv.alias("advantage"))


def opo(df: DataFrame) -> DataFrame:
    """Length-weighted group mean as the baseline; needs `length`."""
    rows = with_group_stats(
        df,
        ["uid"],
        F.count("*").alias("_n"),
        F.sum(F.col("length") * F.col("score")).alias("_ls"),
        F.sum("length").alias("_l"),
    )
    base = F.when(F.col("_n") == 1, 0.0).otherwise(F.try_divide("_ls", F.col("_l").cast("double")))
    return rows.select(*df.columns, (F.col("score") - base).alias("advantage"))


def reinforce_pp_baseline(df: DataFrame) -> DataFrame:
    """Score minus group mean, spread over the tokens and whitened over all tokens."""
    rows = _grouped(df).select(*df.columns, (F.col("score") - F.col("_mean")).alias("_c"))
    rows = rows.withColumn("_t", broadcast_to_tokens(F.col("_c"), F.col("mask")))
    out = whiten(rows, "_t", "mask", "_a")
    adv = F.zip_with("_a", "mask", lambda a, m: a * m)
    return out.select(*df.columns, adv.alias("advantages"))


def reinforce_pp(df: DataFrame, gamma: float = 1.0) -> DataFrame:
    """Discounted returns, whitened over all tokens."""
    rows = with_once(df, "returns", discounted_returns(F.col("rewards"), F.col("mask"), gamma))
    out = whiten(rows, "returns", "mask", "_a")
    return out.select(*df.columns, "returns", F.zip_with("_a", "mask", lambda a, m: a * m).alias("advantages"))


def remax(df: DataFrame, baseline: str = "baseline") -> DataFrame:
    """Reverse cumulative rewards minus the row's baseline."""
    rows = with_once(df, "returns", discounted_returns(F.zip_with("rewards", "mask", lambda r, m: r * m), F.transform("mask", lambda m: F.lit(1.0)), 1.0))
    adv = F.zip_with("returns", "mask", lambda r, m: r - F.col(baseline) * m)
    return rows.withColumn("advantages", adv)


def gpg(df: DataFrame, f_norm: float = 1.0) -> DataFrame:
    """alpha (r - mean) / f with alpha = rows over rows with a non-zero score."""
    counts = df.agg(F.count("*").alias("n"), F.greatest(F.count_if(F.col("score") != 0), F.lit(1)).alias("m"))
    rows = with_scalars(_grouped(df), counts, "c")
    adv = F.col("c.n") / F.col("c.m") * (F.col("score") - F.col("_mean")) / f_norm
    return rows.select(*df.columns, adv.alias("advantage"))


def gae(df: DataFrame, gamma: float, lam: float) -> DataFrame:
    """Generalised advantage estimation; masked tokens are skipped, advantages whitened."""
    rows = with_once(df, "_raw", gae_advantages(F.col("rewards"), F.col("values"), F.col("mask"), gamma, lam))
    rows = rows.withColumn("returns", F.zip_with("_raw", "values", lambda a, v: a + v))
    return whiten(rows, "_raw", "mask", "advantages").drop("_raw")


def kl_estimate(logp: Column, ref: Column, kind: str) -> Column:
    """Per-token KL estimator: k1, abs, k2 or k3 (exponent within 20, result within 10)."""

    def one(a: Column, b: Column) -> Column:
        if kind in ("kl", "k1"):
            return a - b
        if kind == "abs":
            return F.abs(a - b)
        if kind in ("mse", "k2"):
            return 0.5 * (a - b) * (a - b)
        if kind in ("low_var_kl", "k3"):
            d = F.greatest(F.least(b - a, F.lit(SAFETY)), F.lit(-SAFETY))
            return F.greatest(F.least(F.exp(d) - d - 1, F.lit(10.0)), F.lit(-10.0))
        raise ValueError(f"unknown KL estimator: {kind}")

    return F.zip_with(logp, ref, one)


def kl_penalised(scores: Column, logp: Column, ref: Column, ratio: float) -> Column:
    return F.zip_with(scores, kl_estimate(logp, ref, "k1"), lambda s, k: s - k * ratio)


def aggregate_tokens(df: DataFrame, values: str, mask: str, mode: str, scale: float | None = None) -> DataFrame:
    """Table-wide mean of per-token values in one of four modes."""
    v, m = F.col(values), F.col(mask)
    seq_sum, n = token_sum(v, m), token_count(m)
    live = (n > 0).cast("double")
    if mode == "token-mean":
        value = F.sum(seq_sum) / F.sum(n)
    elif mode == "seq-mean-token-sum":
        value = F.sum(seq_sum * live) / F.sum(live)
    elif mode == "seq-mean-token-mean":
        value = F.sum(seq_sum / (n + 1e-8) * live) / F.sum(live)
    elif mode == "seq-mean-token-sum-norm":
        value = F.sum(seq_sum) / (F.lit(scale) if scale else F.max(F.size(m)))
    else:
        raise ValueError(f"unknown aggregation mode: {mode}")
    return df.agg(value.alias("value"))


# --- preference and filtering ----------------------------------------------


def preference(df: DataFrame, pair: str = "pair") -> DataFrame:
    """Chosen flag inside each pair: higher score wins, the first wins ties."""
    best = df.groupBy(pair).agg(F.min_by("pos", F.struct((-F.col("score")).alias("s"), "pos")).alias("_w"))
    return df.join(best, pair).withColumn("chosen", (F.col("pos") == F.col("_w")).cast("int")).drop("_w")


def preference_rows(df: DataFrame, pair: str, text: str) -> DataFrame:
    """One (chosen, rejected) row per pair."""
    key = F.struct((-F.col("score")).alias("s"), "pos")
    return df.groupBy(pair).agg(F.min_by(text, key).alias("chosen"), F.max_by(text, key).alias("rejected"))


def varied_groups(df: DataFrame, metric: str = "score") -> DataFrame:
    """Rows of groups whose metric varies, and of groups of one."""
    stats = df.groupBy("uid").agg(F.stddev_pop(metric).alias("sd"), F.count("*").alias("n"))
    kept = stats.filter((F.col("sd") > 0) | (F.col("n") == 1)).select("uid")
    return df.join(kept, "uid", "left_semi")


def cut_batch(df: DataFrame, rows: int) -> DataFrame:
    """The first `rows` trajectories in batch order."""
    return first_rows(df, [F.col("pos")], rows)


def filter_and_downsample(
    df: DataFrame, low: float, high: float, max_length: int, keep: int, group: str = "uid"
) -> DataFrame:
    """Groups inside the accuracy band and not truncated come first; `keep` rows stay."""
    stats = df.groupBy(group).agg(F.avg("score").alias("acc"), F.max("length").alias("len"), F.min("pos").alias("first"))
    ok = F.col("acc").between(low, high) & (F.col("len") < max_length - 1)
    rows = df.join(stats.select(group, ok.cast("int").alias("passed"), "first"), group)
    return first_rows(rows, [F.desc("passed"), F.col("first"), F.col("pos")], keep).drop("first")


def softmean_baseline(df: DataFrame, beta: float) -> DataFrame:
    """Score minus the soft mean of the batch; beta 0 is the plain mean."""
    if beta == 0:
        base = df.agg(F.avg("score").alias("b"))
    else:
        x = F.col("score") * beta
        top = df.agg(F.max(x).alias("t"))
        shifted = with_scalars(df, top, "s")
        base = shifted.agg(
            ((F.max("s.t") + F.log(F.sum(F.exp(x - F.col("s.t")))) - F.log(F.count("*"))) / beta).alias("b")
        )
    return with_scalars(df, base, "o").withColumn("advantage", F.col("score") - F.col("o.b")).drop("o")


# positions that a task compares with each other
RANK_BLOCK = 1 << 16


def _weigh_blocks(code: np.ndarray, idx: np.ndarray, label: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Sums of label differences over the pairs of every group that are in order and out of order by label.

    Two positions differ first at one bit; at each bit, the rows of a block with the bit clear come before those with it
    set. In label order, running counts and sums of the former give the differences to the latter: n log n, no pairs.
    """
    groups = int(code.max()) + 1
    right, wrong = np.zeros(groups), np.zeros(groups)
    for bit in range(bits):
        block = idx >> (bit + 1)
        order = np.lexsort((label, block, code))
        c, l, later = code[order], label[order], (idx[order] >> bit & 1).astype(bool)
        start = np.ones(len(order), bool)
        start[1:] = (c[1:] != c[:-1]) | (block[order][1:] != block[order][:-1])
        first = np.flatnonzero(start)
        node = np.cumsum(start) - 1
        early, weight = np.cumsum(~later), np.cumsum(np.where(later, 0.0, l))
        n_before = early - (early[first] - ~later[first])[node]
        sum_before = weight - (weight[first] - np.where(later[first], 0.0, l[first]))[node]
        n_all = np.bincount(node, ~later)
        sum_all = np.bincount(node, np.where(later, 0.0, l))
        gain = np.where(later, l * n_before - sum_before, 0.0)
        loss = np.where(later, (sum_all[node] - sum_before) - l * (n_all[node] - n_before), 0.0)
        right += np.bincount(c, gain, groups)
        wrong += np.bincount(c, loss, groups)
    return right, wrong


def pairwise_accuracy(df: DataFrame, group: str = "uid", label: str = "label") -> DataFrame:
    """Share of pairs in a group that the score orders as the label does, weighted by label difference.

    In (score, pos) order a pair counts as right exactly when the row with the smaller label comes first. Rows get their
    position in that order; pairs inside a block of positions are weighed in one task, many blocks at a time, and pairs
    of blocks of a larger group by distributed running sums, one round for each doubling of the group beyond a block.
    Labels may be any numbers; rows with a null label are in no pair. 0.5 when no labels of a group differ.
    """
    rows = df.filter(F.col(label).isNotNull()).select(
        F.struct(F.col(group)).alias("g"), F.col("score"), F.col("pos"), F.col(label).cast("double").alias("l")
    )
    placed = cut_lineage(with_group_index(rows, ["g"], [F.col("score"), F.col("pos")], "idx").select("g", "idx", "l"))
    n, longest = placed.agg(F.count("*"), F.max("idx")).first()
    local = RANK_BLOCK.bit_length() - 1
    block = F.shiftright("idx", local)
    # a task takes about as many rows as a block has, whole blocks of one or many groups
    task = F.pmod(F.xxhash64("g", block), F.lit(max(1, -(-n // RANK_BLOCK))))

    def weigh(pdf: pd.DataFrame) -> pd.DataFrame:
        code = pdf.groupby(["key", "block"], sort=False, dropna=False).ngroup().to_numpy()
        idx = pdf["idx"].to_numpy() & (RANK_BLOCK - 1)
        right, wrong = _weigh_blocks(code, idx, pdf["l"].to_numpy(), int(idx.max()).bit_length())
        first = pdf.assign(code=code).drop_duplicates("code").sort_values("code")
        return pd.DataFrame({"key": first["key"], "right": right, "wrong": wrong})

    # groups travel as text, which null and repeated values of any type have
    keyed = placed.withColumn("key", F.to_json("g"))
    inner = keyed.select("key", "idx", "l", block.alias("block"), task.alias("task"))
    sums = inner.groupBy("task").applyInPandas(weigh, "key string, right double, wrong double")
    for bit in range(local, int(longest or 0).bit_length()):
        node = keyed.withColumn("node", F.shiftright("idx", bit + 1)).withColumn("late", F.shiftright("idx", bit) % 2 == 1)
        early = F.when(F.col("late"), 0).otherwise(1)
        run = with_group_running_sum(node, ["key", "node"], [F.col("l"), F.col("idx")], early, "n_before")
        run = with_group_running_sum(run, ["key", "node"], [F.col("l"), F.col("idx")], early * F.col("l"), "sum_before")
        late = F.col("late").cast("int")
        told = run.groupBy("key", "node").agg(
            F.sum(late * (F.col("l") * F.col("n_before") - F.col("sum_before"))).alias("right"),
            F.sum(late).alias("n_late"),
            F.sum(late * F.col("l")).alias("sum_late"),
            F.sum(early).alias("n_early"),
            F.sum(early * F.col("l")).alias("sum_early"),
        )
        # all differences early minus late, plus those that are late minus early
        wrong = F.col("n_late") * F.col("sum_early") - F.col("n_early") * F.col("sum_late") + F.col("right")
        sums = sums.unionByName(told.select("key", "right", wrong.alias("wrong")))
    per_group = sums.groupBy("key").agg(F.sum("right").alias("r"), F.sum("wrong").alias("w"))
    every = df.select(F.struct(F.col(group)).alias("g")).distinct().withColumn("of", F.to_json("g"))
    out = every.join(per_group, F.col("of") == F.col("key"), "left")
    total = F.col("r") + F.col("w")
    return out.select(F.col(f"g.{group}").alias(group), F.coalesce(F.when(total > 0, F.col("r") / total), F.lit(0.5)).alias("accuracy"))


def sign_accuracy(df: DataFrame, label: str = "label") -> DataFrame:
    """Share of rows whose score sign agrees with a 0/1 label."""
    hit = (F.signum("score") == F.signum(F.col(label) * 2 - 1)).cast("int")
    return df.agg(F.avg(hit).alias("accuracy"))


def overlong_penalty(length: Column, max_length: int, buffer: int, factor: float) -> Column:
    """Linear penalty in the last `buffer` tokens before the maximum."""
    over = length - (max_length - buffer)
    return F.least(-over / buffer * factor, F.lit(0.0))


# --- registries ------------------------------------------------------------

ESTIMATORS: dict[str, Callable[..., DataFrame]] = {}


def register_estimator(name: str, fn: Callable[..., DataFrame]) -> None:
    """Add an advantage estimator; the same name with another function is an error."""
    if name in ESTIMATORS and ESTIMATORS[name] is not fn:
        raise ValueError(f"estimator '{name}' is already registered with another function")
    ESTIMATORS[name] = fn


def estimator(name: str) -> Callable[..., DataFrame]:
    if name not in ESTIMATORS:
        raise ValueError(f"unknown advantage estimator: {name}")
    return ESTIMATORS[name]


for _name, _fn in {
    "gae": gae,
    "grpo": grpo,
    "grpo_passk": passk,
    "rloo": rloo,
    "opo": opo,
    "reinforce_plus_plus": reinforce_pp,
    "reinforce_plus_plus_baseline": reinforce_pp_baseline,
    "remax": remax,
    "gpg": gpg,
}.items():
    register_estimator(_name, _fn)

REWARDS: dict[str, Callable[[pd.DataFrame], pd.Series]] = {}


def register_reward(name: str, fn: Callable[[pd.DataFrame], pd.Series]) -> None:
    """Add a custom reward: a function of a batch with `data_source, solution, ground_truth, extra`."""
    REWARDS[name] = fn


def apply_reward(df: DataFrame, name: str) -> DataFrame:
    """Score every row with a registered reward, batch by batch."""
    fn = REWARDS[name]

    @F.pandas_udf(DoubleType())
    def run(source: pd.Series, solution: pd.Series, truth: pd.Series, extra: pd.Series) -> pd.Series:
        batch = pd.DataFrame({"data_source": source, "solution": solution, "ground_truth": truth, "extra": extra})
        return pd.Series(fn(batch)).astype("float64")

    return df.withColumn("score", run("data_source", "solution", "ground_truth", "extra"))


# --- exact-result reward ---------------------------------------------------


def exact_result_reward(samples: DataFrame, rows: DataFrame) -> DataFrame:
    """1 iff both sides ran and their row sets (with column names) are equal; both empty is 1.

    `samples(sample_id, gold_ok, pred_ok)`, `rows(sample_id, side, row_text)`.
    """
    per_row = rows.groupBy("sample_id", "row_text").agg(F.count_distinct("side").alias("sides"))
    diff = per_row.groupBy("sample_id").agg(F.max((F.col("sides") < 2).cast("int")).alias("differs"))
    out = samples.join(diff, "sample_id", "left")
    equal = F.col("gold_ok") & F.col("pred_ok") & (F.coalesce("differs", F.lit(0)) == 0)
    return out.select("sample_id", F.when(equal, 1.0).otherwise(0.0).alias("score"))
