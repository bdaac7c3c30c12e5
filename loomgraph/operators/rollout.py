"""Off-policy weights and monitoring metrics over response tables.

Token arrays of a response (`old_logp`, `rollout_logp`, `mask`, ...) stay on
its row; batch metrics are single-pass aggregates of per-row sums.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

from loomgraph.functions.columns import let
from loomgraph.functions.draws import seeded_draws
from loomgraph.operators.rewards import SAFETY, token_count, token_sum
from loomgraph.runtime import seeded_digest, with_group_stats, with_scalars


def clamp(c: Column, low: float | Column | None = None, high: float | Column | None = None) -> Column:
    if low is not None:
        c = F.greatest(c, low if isinstance(low, Column) else F.lit(low))
    if high is not None:
        c = F.least(c, high if isinstance(high, Column) else F.lit(high))
    return c


def log_ratio(old: str = "old_logp", rollout: str = "rollout_logp") -> Column:
    return F.zip_with(old, rollout, lambda a, b: a - b)


def masked_row_mean(values: Column, mask: Column) -> Column:
    return token_sum(values, mask) / (token_count(mask) + 1e-8)


def _level_log(ratio: Column, mask: Column, level: str) -> Column:
    """Log ratio at the chosen level, one value per token."""
    if level == "token":
        return ratio
    one = token_sum(ratio, mask) if level == "sequence" else masked_row_mean(ratio, mask)
    return let(one, lambda v: F.transform(mask, lambda m: v))


def _weights(df: DataFrame, level: str) -> DataFrame:
    if level not in ("token", "sequence", "geometric"):
        raise ValueError(f"unknown level: {level}")
    rows = df.withColumn("_log", _level_log(log_ratio(), F.col("mask"), level))
    return rows.withColumn("_w", F.transform("_log", lambda x: F.exp(clamp(x, -SAFETY, SAFETY))))


def importance_weights(df: DataFrame, level: str = "token", threshold: float = 2.0, normalise: bool = False) -> DataFrame:
    """Truncated importance weights per token; zero where masked; optionally mean 1 over the batch."""
    if level == "geometric" or threshold <= 0:
        raise ValueError("level must be token or sequence, threshold positive")
    rows = _weights(df, level)
    rows = rows.withColumn("weights", F.zip_with("_w", "mask", lambda w, m: F.least(w * m, F.lit(threshold))))
    if normalise:
        m = F.col("mask")
        if level == "token":
            mean = F.sum(token_sum(F.col("weights"), m)) / (F.sum(token_count(m)) + 1e-8)
        else:
            live = (token_count(m) > 0).cast("double")
            mean = F.sum(masked_row_mean(F.col("weights"), m) * live) / F.greatest(F.sum(live), F.lit(1e-8))
        rows = with_scalars(rows, rows.agg(mean.alias("m")), "b")
        factor = F.when(F.col("b.m") > 1e-8, F.col("b.m")).otherwise(1.0)
        rows = rows.withColumn("weights", let(factor, lambda f: F.transform("weights", lambda w: w / f))).drop("b")
    return rows.drop("_log", "_w")


def rejection_mask(df: DataFrame, level: str, upper: float, lower: float | None = None) -> DataFrame:
    """Mask with the tokens (or whole responses) outside [lower, upper] switched off."""
    low = lower if lower is not None else 1.0 / upper
    rows = _weights(df, level)
    keep = F.zip_with("_w", "mask", lambda w, m: F.when((w >= low) & (w <= upper), m).otherwise(m * 0))
    return rows.withColumn("new_mask", keep).drop("_log", "_w")


def rejection_metrics(rows: DataFrame, level: str) -> DataFrame:
    """Rejected share of tokens and of responses; input from `rejection_mask`."""
    before, after = token_count(F.col("mask")), token_count(F.col("new_mask"))
    hit = (before - after > 0).cast("double")
    return rows.agg(
        (F.sum(before - after) / (F.sum(before) + 1e-8)).alias("masked_fraction"),
        F.avg(hit).alias("seq_masked_fraction"),
    )


def weight_diagnostics(df: DataFrame, level: str = "token", upper: float = 2.0, lower: float | None = None) -> DataFrame:
    """Mean, extremes, std, effective sample size and extreme fractions of the weights."""
    low = lower if lower is not None else 1.0 / upper
    rows = _weights(df, level)
    m, w = F.col("mask"), F.col("_w")
    n = token_count(m)
    rows = rows.select(
        n.alias("n"),
        token_sum(w, m).alias("s"),
        token_sum(F.transform(w, lambda x: clamp(x, low, upper)), m).alias("cs"),
        token_sum(F.transform(w, lambda x: let(clamp(x, low, upper), lambda c: c * c)), m).alias("cq"),
        token_sum(F.transform(w, lambda x: (x > upper).cast("double")), m).alias("hi"),
        token_sum(F.transform(w, lambda x: (x < low).cast("double")), m).alias("lo"),
        F.array_max(F.zip_with(w, m, lambda x, k: F.when(k != 0, x))).alias("mx"),
        F.array_min(F.zip_with(w, m, lambda x, k: F.when(k != 0, x))).alias("mn"),
        F.element_at("_log", 1).alias("seq_log"),
        (token_sum(w, m) / (n + 1e-8)).alias("row_mean"),
    )
    total = F.sum("n") + 1e-8
    mean_c = F.sum("cs") / total
    var = F.greatest(F.sum("cq") / total - mean_c * mean_c, F.lit(0.0))
    ess = 1.0 / ((F.sum("cq") / total) / ((mean_c + 1e-8) * (mean_c + 1e-8)))
    dev = F.abs(F.col("row_mean") - 1)
    if level == "token":
        top, bottom = F.max("mx"), F.min("mn")
        high, under = F.sum("hi") / total, F.sum("lo") / total
    else:
        top, bottom = F.exp(clamp(F.max("seq_log"), high=SAFETY)), F.exp(F.min("seq_log"))
        high = F.avg((F.col("seq_log") > F.log(F.lit(upper))).cast("double"))
        under = F.avg((F.col("seq_log") < F.log(F.lit(low))).cast("double"))
    return rows.agg(
        (F.sum("s") / total).alias("mean"),
        top.alias("max"),
        bottom.alias("min"),
        F.sqrt(var).alias("std"),
        ess.alias("eff_sample_size"),
        high.alias("fraction_high"),
        under.alias("fraction_low"),
        F.avg("row_mean").alias("seq_mean"),
        F.coalesce(F.stddev_samp("row_mean"), F.lit(0.0)).alias("seq_std"),
        F.max("row_mean").alias("seq_max"),
        F.min("row_mean").alias("seq_min"),
        F.max(dev).alias("seq_max_deviation"),
        F.avg((F.col("row_mean") > upper).cast("double")).alias("seq_fraction_high"),
        F.avg((F.col("row_mean") < low).cast("double")).alias("seq_fraction_low"),
    )


def offpolicy_metrics(df: DataFrame) -> DataFrame:
    """Perplexities, their differences, KL, k3 and chi-square between the two policies."""
    m, old, roll = F.col("mask"), F.col("old_logp"), F.col("rollout_logp")
    ratio = log_ratio()
    rows = df.select(
        token_count(m).alias("n"),
        masked_row_mean(old, m).alias("mt"),
        masked_row_mean(roll, m).alias("mr"),
        token_sum(ratio, m).alias("lr"),
        token_sum(F.transform(ratio, lambda x: F.exp(x) - x - 1), m).alias("k3"),
        token_sum(F.transform(ratio, lambda x: let(F.exp(clamp(x, -SAFETY, SAFETY)), lambda r: r * r)), m).alias("r2"),
    )
    total = F.sum("n") + 1e-8
    diff = F.col("mr") - F.col("mt")
    return rows.agg(
        F.avg(F.exp(-F.col("mt"))).alias("training_ppl"),
        F.avg(-F.col("mt")).alias("training_log_ppl"),
        (-F.sum("lr") / total).alias("kl"),
        (F.sum("k3") / total).alias("k3_kl"),
        F.avg(F.exp(-F.col("mr"))).alias("rollout_ppl"),
        F.avg(-F.col("mr")).alias("rollout_log_ppl"),
        F.avg(diff).alias("log_ppl_diff"),
        F.avg(F.abs(diff)).alias("log_ppl_abs_diff"),
        F.max(diff).alias("log_ppl_diff_max"),
        F.min(diff).alias("log_ppl_diff_min"),
        F.avg(F.exp(diff)).alias("ppl_ratio"),
        (F.sum("r2") / total - 1.0).alias("chi2_token"),
        (F.avg(F.exp(2.0 * clamp(F.col("lr"), -SAFETY, SAFETY))) - 1.0).alias("chi2_seq"),
    )


def batch_metrics(df: DataFrame, max_response: int, max_prompt: int) -> DataFrame:
    """Score, reward, advantage, return and length statistics of a batch in one aggregate.

    `df(score, reward, advantages, returns, values, mask, response_length, prompt_length, turns)`.
    """
    live = F.col("response_length") > 0
    m = F.col("mask")

    def tokens(name: str) -> list[Column]:
        v = F.col(name)
        kept = F.zip_with(v, m, lambda x, k: F.when(k != 0, x))
        return [
            (F.sum(token_sum(v, m)) / F.sum(token_count(m))).alias(f"{name}_mean"),
            F.max(F.array_max(kept)).alias(f"{name}_max"),
            F.min(F.array_min(kept)).alias(f"{name}_min"),
        ]

    def rows(name: str, cond: Column | None = None, prefix: str | None = None) -> list[Column]:
        c = F.col(name) if cond is None else F.when(cond, F.col(name))
        p = prefix or name
        return [F.avg(c).alias(f"{p}_mean"), F.max(c).alias(f"{p}_max"), F.min(c).alias(f"{p}_min")]

    def moments(values: Column, tag: str) -> list[Column]:
        sq = F.transform(values, lambda x: x * x)
        return [F.sum(token_sum(values, m)).alias(f"_{tag}_s"), F.sum(token_sum(sq, m)).alias(f"_{tag}_q")]

    error = F.zip_with("returns", "values", lambda r, v: r - v)
    n = F.col("_n")

    def var(tag: str) -> Column:
        return (F.col(f"_{tag}_q") - F.col(f"_{tag}_s") * F.col(f"_{tag}_s") / n) / (n - 1)

    out = df.agg(
        *rows("score", live),
        *rows("reward", live),
        *tokens("advantages"),
        *tokens("returns"),
        *tokens("values"),
        F.sum(token_count(m)).alias("_n"),
        *moments(error, "e"),
        *moments(F.col("returns"), "r"),
        *rows("response_length"),
        F.avg((F.col("response_length") == max_response).cast("double")).alias("response_clip_ratio"),
        *rows("response_length", live, "live_length"),
        F.avg(F.when(live, (F.col("response_length") == max_response).cast("double"))).alias("live_clip_ratio"),
        F.avg((~live).cast("double")).alias("aborted_ratio"),
        *rows("prompt_length"),
        F.avg((F.col("prompt_length") == max_prompt).cast("double")).alias("prompt_clip_ratio"),
        *rows("turns"),
    )
    out = out.withColumn("explained_var", 1.0 - var("e") / (var("r") + 1e-5))
    return out.drop(*[c for c in out.columns if c.startswith("_")])


# fixed values: stages timed per token; generation counts response tokens only
RESPONSE_STAGES = ["gen"]
ALL_TOKEN_STAGES = ["ref", "values", "adv", "update_critic", "update_actor"]


def timing_metrics(lengths: DataFrame, timings: DataFrame) -> DataFrame:
    """Seconds per stage and milliseconds per token; `timings(stage, seconds)`."""
    totals = lengths.agg(
        F.sum("response_length").alias("response"), (F.sum("response_length") + F.sum("prompt_length")).alias("all")
    )
    rows = with_scalars(timings, totals, "t")
    tokens = F.when(F.col("stage").isin(RESPONSE_STAGES), F.col("t.response")).when(
        F.col("stage").isin(ALL_TOKEN_STAGES), F.col("t.all")
    )
    return rows.select("stage", "seconds", (F.col("seconds") * 1000 / tokens).alias("ms_per_token"))


def throughput(lengths: DataFrame, step_seconds: float, workers: int) -> DataFrame:
    total = F.sum(F.col("response_length") + F.col("prompt_length"))
    return lengths.agg(
        total.alias("total_tokens"),
        F.lit(step_seconds).alias("time_per_step"),
        (total / (step_seconds * workers)).alias("throughput"),
    )


DRAW_BLOCK = 50
# most rows of a group whose draws are made where the group is, beside its rows; larger groups meet their draws by a shuffle
GROUP_ARRAY = 65536


def _draws(sizes: DataFrame, keys: Sequence[str], draws: int, seed: int) -> DataFrame:
    """`sizes` by (n, block, draw, i) with `idx`: seeded index draws for n = 2, 4, ... and the group size."""
    powers = F.filter(F.array(*[F.lit(2**i) for i in range(1, 31)]), lambda p: p < F.col("total"))
    ns = F.array_append(powers, F.col("total").cast("int"))
    grid = sizes.withColumn("n", F.explode(ns))
    # dealt out in blocks of draws before they are made, so that neither few nor large groups end in few tasks
    grid = grid.withColumn("block", F.explode(F.sequence(F.lit(1), F.lit(draws), F.lit(DRAW_BLOCK))))
    parts = int(sizes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    grid = grid.repartition(parts, *keys, "n", "block")
    last = F.least(F.col("block") + DRAW_BLOCK - 1, F.lit(draws))
    grid = grid.withColumn("draw", F.explode(F.sequence("block", last)))
    grid = grid.withColumn("i", F.explode(F.sequence(F.lit(1), F.col("n"))))
    head = F.substring(seeded_digest(seed, *keys, "n", "draw", "i"), 1, 8)
    idx = F.conv(head, 16, 10).cast("long") % F.col("total")
    return grid.withColumn("idx", idx)


def _moments(values: np.ndarray) -> tuple[float | None, float | None]:
    """Mean and population deviation."""
    if not len(values):
        return None, None
    mean = np.mean(values)
    return float(mean), float(np.sqrt(np.mean((values - mean) ** 2)))


Picker = Callable[[np.ndarray, np.ndarray, "np.ndarray | None"], Callable[[np.ndarray], "list[np.ndarray]"]]


def _bootstrap(
    rows: DataFrame, keys: Sequence[str], draws: int, seed: int, picker: Picker, summed: Callable[[DataFrame, list[str]], DataFrame], names: Sequence[str]
) -> DataFrame:
    """Mean and deviation over all draws, for the groups of `rows(keys, idx, v, ...)` with two rows or more.

    `picker(v, empty, p)` prepares the rows of a group and turns indices by i and draw into the row that stands for each
    draw (-1: none), once for each of `names`; `summed(drawn rows, columns of a draw)` gives the values of the draws of
    groups of more than `GROUP_ARRAY` rows. Nothing is sent to all tasks, and no draw of the other groups leaves its task.
    """
    values = [c for c in rows.columns if c not in (*keys, "idx")]
    sizes = rows.groupBy(*keys).agg(F.count("*").alias("total")).filter(F.col("total") > 1)
    # a number of tasks that is asked for is kept, however few the bytes: the work is in the draws
    parts = 4 * int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    held = sizes.filter(F.col("total") <= GROUP_ARRAY).repartition(parts, *keys)  # on both sides, else the join undoes it
    few = rows.repartition(parts, *keys).join(held.hint("merge"), list(keys))
    packed = few.groupBy(*keys, "total").agg(F.array_sort(F.collect_list(F.struct("idx", *values))).alias("rows"))
    prefix = F.concat_ws(":", F.lit(str(seed)), *[F.col(k).cast("string") for k in keys])
    packed = packed.select(*keys, prefix.alias("prefix"), *[F.col("rows")[c].alias(c) for c in values])
    stats = [f"{name}_{stat}" for name in names for stat in ("mean", "std")]
    schema = StructType([*packed.select(*keys).schema, StructField("n", IntegerType()), *[StructField(s, DoubleType()) for s in stats]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = batch.column("v")
            starts = v.offsets.to_numpy()
            flat, empty = v.values.to_numpy(zero_copy_only=False), v.values.is_null().to_numpy(zero_copy_only=False)
            votes = None
            if "p" in values:
                p = batch.column("p").values.dictionary_encode(null_encoding="encode")
                votes = p.indices.to_numpy()
            at, ns_of, found = [], [], []
            for row, group in enumerate(batch.column("prefix").to_pylist()):
                mine = slice(starts[row], starts[row + 1])
                total = int(starts[row + 1] - starts[row])
                pick = picker(flat[mine], empty[mine], None if votes is None else votes[mine])
                ns = [*[2**i for i in range(1, total.bit_length()) if 2**i < total], total]
                # one n after the other, each by parts of its draws
                for n, of_n in groupby(seeded_draws(group, ns, draws, total), key=lambda d: d[0]):
                    rows_of = [np.concatenate(one) for one in zip(*[pick(idx) for _, _, idx in of_n])]
                    at.append(row)
                    ns_of.append(n)
                    found.append([x for one in rows_of for x in _moments(flat[mine][one[one >= 0]])])
            columns = [batch.column(k).take(pa.array(at, pa.int64())) for k in keys] + [pa.array(ns_of, pa.int32())]
            columns += [pa.array([x[i] for x in found], pa.float64()) for i in range(len(stats))]
            yield pa.RecordBatch.from_arrays(columns, [*keys, "n", *stats])

    small = packed.mapInArrow(run, schema)
    draw = [*keys, "n", "block", "draw"]
    large = _draws(sizes.filter(F.col("total") > GROUP_ARRAY), keys, draws, seed).join(rows.hint("merge"), [*keys, "idx"])
    # the block of draws is among the columns of a draw, so that a draw is summed where it is made
    per_draw = summed(large.select(*draw, "i", *values), draw)
    whole = [f(name).alias(f"{name}_{stat}") for name in names for f, stat in ((F.avg, "mean"), (F.stddev_pop, "std"))]
    return small.unionByName(per_draw.groupBy(*keys, "n").agg(*whole))


def bootstrap_extremes(
    df: DataFrame, keys: Sequence[str], value: str = "score", index: str = "idx", draws: int = 1000, seed: int = 42
) -> DataFrame:
    """Mean and population std of the best and worst of n, by seeded resampling.

    `index` numbers the rows of a group from 0. The draws of a group are made beside its rows; those of a group too large
    for that are rows, so its work is spread over the cluster.
    """
    rows = df.select(*keys, F.col(index).alias("idx"), F.col(value).cast("double").alias("v"))

    def picker(v: np.ndarray, empty: np.ndarray, _: np.ndarray | None) -> Callable[[np.ndarray], list[np.ndarray]]:
        order = np.argsort(v, kind="stable").astype(np.int32)  # a number that is none comes last, as in Spark
        place = np.empty_like(order)
        place[order] = np.arange(len(v), dtype=np.int32)
        high, low = np.where(empty, np.int32(-1), place), np.where(empty, np.int32(len(v)), place)
        row_at = np.append(order, np.int32(-1))  # both ends stand for no row
        return lambda idx: [row_at[high[idx].max(axis=0)], row_at[low[idx].min(axis=0)]]

    def summed(picked: DataFrame, draw: list[str]) -> DataFrame:
        return picked.groupBy(*draw).agg(F.max("v").alias("best"), F.min("v").alias("worst"))

    return _bootstrap(rows, keys, draws, seed, picker, summed, ["best", "worst"])


def bootstrap_majority(
    df: DataFrame,
    keys: Sequence[str],
    value: str = "score",
    vote: str = "pred",
    index: str = "idx",
    draws: int = 1000,
    seed: int = 42,
) -> DataFrame:
    """Mean and population std of the majority value of n draws; ties go to the vote drawn first.

    The value of a vote is the first one drawn for it that is not null.
    """
    rows = df.select(*keys, F.col(index).alias("idx"), F.col(value).cast("double").alias("v"), F.col(vote).alias("p"))
    best = F.min_by("v", F.struct((-F.col("c")).alias("c"), "first"))

    def picker(v: np.ndarray, empty: np.ndarray, p: np.ndarray) -> Callable[[np.ndarray], list[np.ndarray]]:
        kinds, code = np.unique(p, return_inverse=True)
        k, holes = len(kinds), empty.any()

        def part(idx: np.ndarray) -> np.ndarray:
            n, many = idx.shape
            cell = code[idx] + k * np.arange(many)
            counts = np.bincount(cell.ravel(), minlength=k * many).reshape(many, k)
            first = np.full(k * many, n)
            # the last of several writes to a cell stays, here the one drawn first
            first[cell[::-1].ravel()] = np.repeat(np.arange(n)[::-1], many)
            won = np.argmax(counts * (n + 1) - first.reshape(many, k), axis=1) + k * np.arange(many)
            if not holes:
                return idx[first[won], np.arange(many)].astype(np.int32)
            valued = np.full(k * many, -1)
            i, d = np.nonzero(~empty[idx][::-1])
            valued[cell[::-1][i, d]] = n - 1 - i
            at = valued[won]
            return np.where(at < 0, -1, idx[at, np.arange(many)].astype(np.int32))

        def pick(idx: np.ndarray) -> list[np.ndarray]:
            step = max(1, (1 << 20) // k)  # cells of all votes of a few draws at a time
            return [np.concatenate([part(idx[:, s : s + step]) for s in range(0, idx.shape[1], step)])]

        return pick

    def summed(picked: DataFrame, draw: list[str]) -> DataFrame:
        valued = F.when(F.col("v").isNotNull(), F.col("i"))
        votes = picked.groupBy(*draw, "p").agg(F.count("*").alias("c"), F.min("i").alias("first"), F.min_by("v", valued).alias("v"))
        return votes.groupBy(*draw).agg(best.alias("maj"))

    return _bootstrap(rows, keys, draws, seed, picker, summed, ["maj"])


def validation_metrics(df: DataFrame, source: str = "source", uid: str = "uid", value: str = "score") -> DataFrame:
    """mean@N and std@N per prompt, then averaged over the prompts of a source."""
    per = df.groupBy(source, uid).agg(
        F.count("*").alias("n"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("std")
    )
    std = F.avg(F.when(F.col("n") > 1, F.col("std")))
    return per.groupBy(source, "n").agg(F.avg("mean").alias("mean_at_n"), std.alias("std_at_n"), F.count("*").alias("prompts"))


def majority_value(df: DataFrame, keys: Sequence[str], vote: str, value: str, order: str) -> DataFrame:
    """Value of the first row of the most common answer; ties go to the answer seen first."""
    votes = df.groupBy(*keys, vote).agg(
        F.count("*").alias("c"), F.min(order).alias("first"), F.min_by(value, order).alias("v")
    )
    best = F.min_by(F.struct(F.col(vote).alias("answer"), F.col("v").alias("value")), F.struct((-F.col("c")).alias("c"), "first"))
    return votes.groupBy(*keys).agg(best.alias("b")).select(*keys, "b.*")


def probability_difference(df: DataFrame) -> DataFrame:
    """Max, mean and std of |p_actor - p_rollout| over masked tokens, and their correlation."""
    cells = df.select(F.explode(F.arrays_zip("old_logp", "rollout_logp", "mask")).alias("t")).filter(F.col("t.mask") != 0)
    cells = cells.select(F.exp("t.old_logp").alias("a"), F.exp("t.rollout_logp").alias("r"))
    diff = F.abs(F.col("a") - F.col("r"))
    return cells.agg(
        F.max(diff).alias("diff_max"), F.avg(diff).alias("diff_mean"), F.stddev_samp(diff).alias("diff_std"), F.corr("a", "r").alias("corr")
    )


def with_row_index(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """0-based row number inside a group, for the bootstrap."""
    from loomgraph.runtime import with_group_index

    return with_group_index(df, keys, [F.col(order)], "idx")


def group_sizes(df: DataFrame, keys: list[str]) -> DataFrame:
    return with_group_stats(df, keys, F.count("*").alias("group_rows"))
