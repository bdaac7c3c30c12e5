"""Off-policy weights and monitoring metrics over the token arrays of the events."""

from pyspark.sql import functions as F

from loomgraph.catalog.base import query, table
from loomgraph.catalog.rewards import C, r6, responses, tokens
from loomgraph.operators import rollout as M

_RATIO = "SELECT *, old_logp - rollout_logp AS lr, sum((old_logp - rollout_logp) * mask) OVER (PARTITION BY pos) AS slr, sum(mask) OVER (PARTITION BY pos) AS nm FROM tok"
_CR = {**C, "ratio": _RATIO}


def _exploded(df, col):
    z = df.select("pos", F.posexplode(col).alias("t", "v"))
    return z.select("pos", (F.col("t") + 1).cast("bigint").alias("t"), F.round("v", 6).alias(col))


@query("r12_token_weights", "SELECT pos, t, round(least(exp(lr) * mask, 1.05::DOUBLE), 6) AS weights FROM ratio", _CR)
def token_weights(spark, path):
    return _exploded(M.importance_weights(tokens(spark, path), "token", 1.05), "weights")


@query(
    "r12_sequence_weights_normalised",
    """SELECT pos, t, round(w / (SELECT sum(m) / count(*) FROM (SELECT pos, sum(w) / (sum(mask) + 1e-8::DOUBLE) AS m FROM sw GROUP BY 1 HAVING sum(mask) > 0)), 6) AS weights FROM sw""",
    {**_CR, "sw": "SELECT pos, t, mask, least(exp(least(greatest(slr, -20), 20)) * mask, 1.2::DOUBLE) AS w FROM ratio"},
)
def sequence_weights(spark, path):
    return _exploded(M.importance_weights(tokens(spark, path), "sequence", 1.2, True), "weights")


def _reject(name: str, level: str, weight: str) -> None:
    sql = f"""SELECT '{level}' AS level, round((sum(mask) - sum(nm2)) / (sum(mask) + 1e-8::DOUBLE), 6) AS masked_fraction,
        round((SELECT avg(h) FROM (SELECT max(CASE WHEN mask > nm2 THEN 1 ELSE 0 END) AS h FROM rj GROUP BY pos)), 6) AS seq_masked_fraction FROM rj"""
    rj = f"SELECT pos, mask, CASE WHEN {weight} BETWEEN 1 / 1.06::DOUBLE AND 1.06::DOUBLE THEN mask ELSE 0 END AS nm2 FROM ratio"

    @query(name, sql, {**_CR, "rj": rj})
    def run(spark, path, level=level):
        rows = M.rejection_mask(tokens(spark, path), level, 1.06)
        out = M.rejection_metrics(rows, level)
        return r6(out.select(F.lit(level).alias("level"), "*"), "masked_fraction", "seq_masked_fraction")


_reject("r13_reject_token", "token", "exp(lr)")
_reject("r13_reject_sequence", "sequence", "exp(slr)")
_reject("r13_reject_geometric", "geometric", "exp(slr / (nm + 1e-8::DOUBLE))")


@query(
    "r14_weight_diagnostics",
    """SELECT round(s / n, 6) AS mean, round(mx, 6) AS max, round(mn, 6) AS min, round(sqrt(greatest(cq / n - pow(cs / n, 2), 0)), 6) AS std,
       round(1 / ((cq / n) / pow(cs / n + 1e-8::DOUBLE, 2)), 6) AS eff_sample_size, round(hi / n, 6) AS fraction_high, round(lo / n, 6) AS fraction_low, rs.* FROM
       (SELECT sum(mask) + 1e-8::DOUBLE AS n, sum(w * mask) AS s, max(w) FILTER (mask = 1) AS mx, min(w) FILTER (mask = 1) AS mn, sum(c * mask) AS cs, sum(c * c * mask) AS cq,
          sum(CASE WHEN w > 1.06::DOUBLE THEN mask ELSE 0 END) AS hi, sum(CASE WHEN w < 1 / 1.06::DOUBLE THEN mask ELSE 0 END) AS lo FROM
          (SELECT *, exp(lr) AS w, least(greatest(exp(lr), 1 / 1.06::DOUBLE), 1.06::DOUBLE) AS c FROM ratio)),
       (SELECT round(avg(rm), 6) AS seq_mean, round(stddev_samp(rm), 6) AS seq_std, round(max(rm), 6) AS seq_max, round(min(rm), 6) AS seq_min, round(max(abs(rm - 1)), 6) AS seq_max_deviation,
          round(avg(CASE WHEN rm > 1.06::DOUBLE THEN 1 ELSE 0 END), 6) AS seq_fraction_high, round(avg(CASE WHEN rm < 1 / 1.06::DOUBLE THEN 1 ELSE 0 END), 6) AS seq_fraction_low
        FROM (SELECT pos, sum(exp(lr) * mask) / (sum(mask) + 1e-8::DOUBLE) AS rm FROM ratio GROUP BY 1)) rs""",
    _CR,
)
def weight_diagnostics(spark, path):
    out = M.weight_diagnostics(tokens(spark, path), "token", 1.06)
    return r6(out, *out.columns)


@query(
    "r14_sequence_diagnostics",
    """SELECT round(exp(least(max(slr), 20)), 6) AS max, round(exp(min(slr)), 6) AS min, round(avg(CASE WHEN slr > ln(1.06::DOUBLE) THEN 1 ELSE 0 END), 6) AS fraction_high,
       round(avg(CASE WHEN slr < ln(1 / 1.06::DOUBLE) THEN 1 ELSE 0 END), 6) AS fraction_low FROM (SELECT pos, max(slr) AS slr FROM ratio GROUP BY 1)""",
    _CR,
)
def sequence_diagnostics(spark, path):
    out = M.weight_diagnostics(tokens(spark, path), "sequence", 1.06).select("max", "min", "fraction_high", "fraction_low")
    return r6(out, *out.columns)


@query(
    "r14_offpolicy_metrics",
    """SELECT round(avg(exp(-mt)), 6) AS training_ppl, round(avg(-mt), 6) AS training_log_ppl, round(-sum(lr) / (sum(n) + 1e-8::DOUBLE), 6) AS kl, round(sum(k3) / (sum(n) + 1e-8::DOUBLE), 6) AS k3_kl,
       round(avg(exp(-mr)), 6) AS rollout_ppl, round(avg(-mr), 6) AS rollout_log_ppl, round(avg(mr - mt), 6) AS log_ppl_diff, round(avg(abs(mr - mt)), 6) AS log_ppl_abs_diff,
       round(max(mr - mt), 6) AS log_ppl_diff_max, round(min(mr - mt), 6) AS log_ppl_diff_min, round(avg(exp(mr - mt)), 6) AS ppl_ratio,
       round(sum(r2) / (sum(n) + 1e-8::DOUBLE) - 1, 6) AS chi2_token, round(avg(exp(2 * lr)) - 1, 6) AS chi2_seq FROM
       (SELECT pos, sum(mask) AS n, sum(old_logp * mask) / (sum(mask) + 1e-8::DOUBLE) AS mt, sum(rollout_logp * mask) / (sum(mask) + 1e-8::DOUBLE) AS mr, sum(lr * mask) AS lr,
          sum((exp(lr) - lr - 1) * mask) AS k3, sum(exp(2 * lr) * mask) AS r2 FROM ratio GROUP BY 1)""",
    _CR,
)
def offpolicy(spark, path):
    out = M.offpolicy_metrics(tokens(spark, path))
    return r6(out, *out.columns)


_BATCH = "SELECT pos, score, length, n, t, mask, reward AS ret, val, score / 2 AS rew, reward - val AS adv FROM tok"


@query(
    "r15_batch_metrics",
    """SELECT round(avg(score) FILTER (rl > 0), 6) AS score_mean, max(score) FILTER (rl > 0) AS score_max, min(score) FILTER (rl > 0) AS score_min,
       round(avg(rl), 6) AS response_length_mean, max(rl) AS response_length_max, min(rl) AS response_length_min, round(avg(CASE WHEN rl = 5 THEN 1 ELSE 0 END), 6) AS response_clip_ratio,
       round(avg(rl) FILTER (rl > 0), 6) AS live_length_mean, round(avg(CASE WHEN rl = 0 THEN 1 ELSE 0 END), 6) AS aborted_ratio, max(a.adv_mean) AS advantages_mean, max(a.adv_max) AS advantages_max,
       max(a.ret_mean) AS returns_mean, max(a.ev) AS explained_var, max(length) AS prompt_length_max FROM (SELECT pos, max(score) AS score, max(length) AS length, sum(mask) AS rl FROM b GROUP BY 1),
       (SELECT round(avg(adv), 6) AS adv_mean, round(max(adv), 6) AS adv_max, round(avg(ret), 6) AS ret_mean, round(1 - var_samp(ret - val) / (var_samp(ret) + 1e-5::DOUBLE), 6) AS ev FROM b WHERE mask = 1) a""",
    {**C, "b": _BATCH},
)
def batch_metrics(spark, path):
    rows = tokens(spark, path).select(
        "score",
        (F.col("score") / 2).alias("reward"),
        F.zip_with("rewards", "values", lambda r, v: r - v).alias("advantages"),
        F.col("rewards").alias("returns"),
        "values",
        "mask",
        F.aggregate("mask", F.lit(0.0), lambda s, m: s + m).cast("bigint").alias("response_length"),
        F.col("length").alias("prompt_length"),
        F.col("n").alias("turns"),
    )
    out = M.batch_metrics(rows, 5, 99)
    keep = [
        "score_mean", "score_max", "score_min", "response_length_mean", "response_length_max", "response_length_min", "response_clip_ratio",
        "live_length_mean", "aborted_ratio", "advantages_mean", "advantages_max", "returns_mean", "explained_var", "prompt_length_max",
    ]
    return r6(out.select(*keep), *[c for c in keep if "length_m" not in c or "mean" in c])


_TIMES = "SELECT event_type AS stage, round(sum(value), 6) AS seconds FROM (SELECT CASE event_type WHEN 'view' THEN 'gen' WHEN 'click' THEN 'adv' ELSE event_type END AS event_type, value FROM events) GROUP BY 1"


@query(
    "r16_timing_metrics",
    """SELECT stage, seconds, round(CASE stage WHEN 'gen' THEN seconds * 1000 / r WHEN 'adv' THEN seconds * 1000 / (r + p) END, 6) AS ms_per_token FROM tm,
       (SELECT sum(n_chars) AS r, sum(length(source)) AS p FROM documents)""",
    {"tm": _TIMES},
)
def timing(spark, path):
    stage = F.when(F.col("event_type") == "view", "gen").when(F.col("event_type") == "click", "adv").otherwise(F.col("event_type"))
    times = table(spark, path, "events").groupBy(stage.alias("stage")).agg(F.round(F.sum("value"), 6).alias("seconds"))
    lengths = table(spark, path, "documents").select(F.col("n_chars").alias("response_length"), F.length("source").alias("prompt_length"))
    return r6(M.timing_metrics(lengths, times), "ms_per_token")


@query("r16_throughput", "SELECT CAST(sum(n_chars + length(source)) AS BIGINT) AS total_tokens, 12.5::DOUBLE AS time_per_step, round(sum(n_chars + length(source)) / (12.5::DOUBLE * 8), 6) AS throughput FROM documents")
def throughput(spark, path):
    lengths = table(spark, path, "documents").select(F.col("n_chars").alias("response_length"), F.length("source").alias("prompt_length"))
    return r6(M.throughput(lengths, 12.5, 8), "throughput")


@query(
    "r17_validation_metrics",
    """SELECT source, n, round(avg(m), 6) AS mean_at_n, round(avg(CASE WHEN n > 1 THEN s END), 6) AS std_at_n, count(*) AS prompts FROM
       (SELECT source, uid, count(*) AS n, avg(score) AS m, stddev_pop(score) AS s FROM responses GROUP BY 1, 2) GROUP BY 1, 2""",
)
def validation(spark, path):
    return r6(M.validation_metrics(responses(spark, path)), "mean_at_n", "std_at_n")


# 1,000 seeded draws of n = 2, 4, ... and all rows of each group
_DRAWS = {
    "placed": """SELECT source, uid, score, k % 4 AS pred, row_number() OVER (PARTITION BY source, uid ORDER BY event_id) - 1 AS idx,
        count(*) OVER (PARTITION BY source, uid) AS total FROM responses""",
    "sizes": """SELECT source, uid, total, unnest(list_append([p FOR p IN [2, 4, 8, 16, 32, 64, 128, 256, 512, 1024, 2048, 4096] IF p < total], total)) AS n
        FROM (SELECT DISTINCT source, uid, total FROM placed WHERE total > 1)""",
    "drawn": """SELECT s.source, s.uid, n, draw, i, p.score, p.pred FROM
        (SELECT *, ('0x' || substr(md5('42:' || source || ':' || uid || ':' || n || ':' || draw || ':' || i), 1, 8))::BIGINT % total AS idx
         FROM (SELECT *, unnest(range(1, n + 1)) AS i FROM sizes, range(1, 1001) d(draw))) s
        JOIN placed p ON p.source = s.source AND p.uid = s.uid AND p.idx = s.idx""",
}


@query(
    "r17_bootstrap_extremes",
    """SELECT source, uid, n, round(avg(b), 6) AS best_mean, round(stddev_pop(b), 6) AS best_std, round(avg(w), 6) AS worst_mean,
       round(stddev_pop(w), 6) AS worst_std FROM (SELECT source, uid, n, draw, max(score) AS b, min(score) AS w FROM drawn GROUP BY 1, 2, 3, 4)
       GROUP BY 1, 2, 3""",
    {**C, **_DRAWS},
)
def bootstrap_extremes(spark, path):
    rows = M.with_row_index(responses(spark, path).select("source", "uid", "pos", "score"), ["source", "uid"], "pos")
    out = M.bootstrap_extremes(rows, ["source", "uid"])
    return r6(out.withColumn("n", F.col("n").cast("bigint")), "best_mean", "best_std", "worst_mean", "worst_std")


@query(
    "r17_bootstrap_majority",
    """SELECT source, uid, n, round(avg(m), 6) AS maj_mean, round(stddev_pop(m), 6) AS maj_std FROM
       (SELECT source, uid, n, draw, first(v ORDER BY c DESC, f) AS m FROM
        (SELECT source, uid, n, draw, pred, count(*) AS c, min(i) AS f, min_by(score, i) AS v FROM drawn GROUP BY 1, 2, 3, 4, 5) GROUP BY 1, 2, 3, 4)
       GROUP BY 1, 2, 3""",
    {**C, **_DRAWS},
)
def bootstrap_majority(spark, path):
    rows = responses(spark, path).select("source", "uid", "pos", "score", (F.col("length") % 4).alias("pred"))
    out = M.bootstrap_majority(M.with_row_index(rows, ["source", "uid"], "pos"), ["source", "uid"])
    return r6(out.withColumn("n", F.col("n").cast("bigint")), "maj_mean", "maj_std")


@query(
    "r18_majority_value",
    """SELECT uid, first(source ORDER BY c DESC, f) AS answer, first(v ORDER BY c DESC, f) AS value FROM
       (SELECT uid, source, count(*) AS c, min(event_id) AS f, min_by(score, event_id) AS v FROM responses GROUP BY 1, 2) GROUP BY 1""",
)
def majority_value(spark, path):
    return M.majority_value(responses(spark, path), ["uid"], "source", "score", "pos")


@query(
    "r30_probability_difference",
    """SELECT round(max(d), 6) AS diff_max, round(avg(d), 6) AS diff_mean, round(stddev_samp(d), 6) AS diff_std, round(corr(a, r), 6) AS corr FROM
       (SELECT exp(old_logp) AS a, exp(rollout_logp) AS r, abs(exp(old_logp) - exp(rollout_logp)) AS d FROM tok WHERE mask = 1)""",
    C,
)
def probability_difference(spark, path):
    out = M.probability_difference(tokens(spark, path))
    return r6(out, *out.columns)
