"""Advantages, rewards and scoring; a response is an event, its group the user."""

from pyspark.sql import functions as F

from loomgraph.catalog.base import query, table
from loomgraph.operators import rewards as R
from loomgraph.operators import scoring as S


def r6(df, *cols):
    return df.select(*[F.round(c, 6).alias(c) if c in cols else c for c in df.columns])


def responses(spark, path):
    k = F.get_json_object("props", "$.k").cast("bigint")
    return table(spark, path, "events").select(
        F.col("event_id").alias("pos"),
        F.col("user_id").alias("uid"),
        F.col("event_type").alias("source"),
        F.col("value").alias("score"),
        k.alias("length"),
    )


def tokens(spark, path):
    """Responses with token arrays of 1 to 6 tokens built from value and props."""
    n = (F.col("length") % 6 + 1).cast("int")
    rows = responses(spark, path).withColumn("n", n)
    ts = F.sequence(F.lit(1), F.col("n"))

    def arr(fn):
        return F.transform(ts, fn)

    return rows.select(
        "pos",
        "uid",
        "source",
        "score",
        "length",
        "n",
        arr(lambda t: F.when((t + F.col("length")) % 4 == 0, 0.0).otherwise(1.0)).alias("mask"),
        arr(lambda t: F.when(t == F.col("n"), F.col("score")).otherwise(t * 0.25)).alias("rewards"),
        arr(lambda t: F.col("score") / (t + 1)).alias("values"),
        arr(lambda t: -(t * 0.1 + F.col("length") / 100)).alias("old_logp"),
        arr(lambda t: -(t * 0.12 + F.col("length") / 110)).alias("rollout_logp"),
    )


# the same arrays, one row per token
TOK = """SELECT event_id AS pos, user_id AS uid, event_type AS source, value AS score, k AS length, n, t, CASE WHEN (t + k) % 4 = 0 THEN 0 ELSE 1 END AS mask,
    CASE WHEN t = n THEN value ELSE t * 0.25::DOUBLE END AS reward, value / (t + 1) AS val, -(t * 0.1::DOUBLE + k / 100) AS old_logp,
    -(t * 0.12::DOUBLE + k / 110) AS rollout_logp FROM (SELECT *, unnest(range(1, n + 1)) AS t FROM
    (SELECT *, k % 6 + 1 AS n FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events)))"""
G = "SELECT uid, count(*) AS n, avg(score) AS m, stddev_samp(score) AS s, sum(k * score) AS ls, sum(k) AS l FROM responses GROUP BY 1"
C = {"tok": TOK, "grp": G}


@query(
    "w08_group_statistics",
    "SELECT event_id AS pos, round(m, 6) AS mean, round(sqrt(greatest(s * s, 1e-6)), 6) AS std, n AS count FROM responses r JOIN grp g ON g.uid = r.uid",
    C,
)
def group_statistics(spark, path):
    return r6(R.group_stats(responses(spark, path)).select("pos", "mean", "std", "count"), "mean", "std")


def _advantage(name: str, sql: str, build) -> None:
    @query(name, sql, C)
    def run(spark, path, build=build):
        out = build(spark, path)
        # a value on the edge of rounding is pushed the same way on both sides
        return out.select("pos", F.round(F.col("advantage") + 1e-9, 6).alias("advantage"))


_SEL = "SELECT event_id AS pos, round({} + 1e-9::DOUBLE, 6) AS advantage FROM responses r JOIN grp g ON g.uid = r.uid"
_advantage("r02_group_advantage", _SEL.format("(score - m) / (s + 1e-6::DOUBLE)"), lambda s, p: R.grpo(responses(s, p)))
_advantage("r02_group_advantage_no_std", _SEL.format("score - m"), lambda s, p: R.grpo(responses(s, p), normalise=False))
_advantage(
    "r03_passk_advantage",
    """SELECT event_id AS pos, round(CASE WHEN rn = 1 THEN (score - nxt) / (s + 1e-6::DOUBLE) ELSE 0 END + 1e-9::DOUBLE, 6) AS advantage FROM
       (SELECT r.*, s, row_number() OVER w AS rn, lead(score) OVER w AS nxt FROM responses r JOIN grp g ON g.uid = r.uid
        WINDOW w AS (PARTITION BY r.uid ORDER BY score DESC, event_id))""",
    lambda s, p: R.passk(responses(s, p)),
)
_advantage("r04_leave_one_out", _SEL.format("CASE WHEN n > 1 THEN n / (n - 1) * (score - m) ELSE score END"), lambda s, p: R.rloo(responses(s, p)))
_advantage("r05_length_weighted", _SEL.format("score - ls / l"), lambda s, p: R.opo(responses(s, p)))
_advantage(
    "r08_scaled_advantage",
    _SEL.format("(SELECT count(*) / greatest(count(*) FILTER (score <> 0), 1) FROM responses) * (score - m)"),
    lambda s, p: R.gpg(responses(s, p)),
)
_advantage(
    "r28_softmean_baseline",
    "SELECT event_id AS pos, round(score - (SELECT (0.5::DOUBLE * max(score) + ln(sum(exp(0.5::DOUBLE * score - 0.5::DOUBLE * (SELECT max(score) FROM responses)))) - ln(count(*))) / 0.5::DOUBLE FROM responses) + 1e-9::DOUBLE, 6) AS advantage FROM responses",
    lambda s, p: R.softmean_baseline(responses(s, p), 0.5),
)


@query("w09_best_margin", "SELECT uid, round(max(score) - min(score), 6) AS margin FROM (SELECT *, row_number() OVER (PARTITION BY uid ORDER BY score DESC, event_id) AS rn FROM responses) WHERE rn <= 2 GROUP BY 1")
def best_margin(spark, path):
    return r6(R.best_margin(responses(spark, path)), "margin")


_RETURNS = """SELECT a.pos, a.t, a.mask, a.val, sum(b.reward * pow(0.9::DOUBLE, b.t - a.t) * CASE WHEN EXISTS (SELECT 1 FROM tok c WHERE c.pos = a.pos AND c.t > a.t AND c.t <= b.t AND c.mask = 0) THEN 0 ELSE 1 END) AS ret
    FROM tok a JOIN tok b ON a.pos = b.pos AND b.t >= a.t GROUP BY 1, 2, 3, 4"""
_WHITE = "SELECT mean, var * n / (n - 1) AS var FROM (SELECT n, mean, (SELECT sum((x - mean) * (x - mean)) FROM src WHERE mask = 1) / (n + 1e-8::DOUBLE) AS var FROM (SELECT count(*) AS n, sum(x) / (count(*) + 1e-8::DOUBLE) AS mean FROM src WHERE mask = 1))"


def _exploded(df, *cols):
    z = df.select("pos", F.posexplode(F.arrays_zip(*cols)).alias("t", "z"))
    return z.select("pos", (F.col("t") + 1).cast("bigint").alias("t"), *[F.round(F.col(f"z.{c}"), 6).alias(c) for c in cols])


@query("w10_discounted_returns", "SELECT pos, t, round(ret, 6) AS returns FROM ret", {**C, "ret": _RETURNS})
def discounted(spark, path):
    rows = tokens(spark, path).withColumn("returns", R.discounted_returns(F.col("rewards"), F.col("mask"), 0.9))
    return _exploded(rows, "returns")


@query(
    "r06_baseline_whitened",
    "SELECT pos, t, round((x - mean) / sqrt(var + 1e-8::DOUBLE) * mask, 6) AS advantages FROM src CROSS JOIN white",
    {**C, "src": "SELECT pos, t, mask, (score - m) * mask AS x FROM tok JOIN grp g ON g.uid = tok.uid", "white": _WHITE},
)
def baseline_whitened(spark, path):
    return _exploded(R.reinforce_pp_baseline(tokens(spark, path)), "advantages")


@query(
    "r07_returns_whitened",
    "SELECT pos, t, round(x, 6) AS returns, round((x - mean) / sqrt(var + 1e-8::DOUBLE) * mask, 6) AS advantages FROM src CROSS JOIN white",
    {**C, "ret": _RETURNS, "src": "SELECT pos, t, mask, ret AS x FROM ret", "white": _WHITE},
)
def returns_whitened(spark, path):
    return _exploded(R.reinforce_pp(tokens(spark, path), 0.9), "returns", "advantages")


@query(
    "r07_remax",
    "SELECT pos, t, round(r, 6) AS returns, round(r - length / 10 * mask, 6) AS advantages FROM (SELECT *, sum(reward * mask) OVER (PARTITION BY pos ORDER BY t DESC) AS r FROM tok)",
    C,
)
def remax(spark, path):
    return _exploded(R.remax(tokens(spark, path).withColumn("baseline", F.col("length") / 10)), "returns", "advantages")


_VALID = "SELECT *, row_number() OVER (PARTITION BY pos ORDER BY t) AS j, reward + 0.99::DOUBLE * coalesce(lead(val) OVER (PARTITION BY pos ORDER BY t), 0) - val AS delta FROM tok WHERE mask = 1"
_ADV = "SELECT a.pos, a.t, sum(b.delta * pow(0.99::DOUBLE * 0.95::DOUBLE, b.j - a.j)) AS adv FROM valid a JOIN valid b ON a.pos = b.pos AND b.j >= a.j GROUP BY 1, 2"
_SRC = "SELECT k.pos, k.t, k.mask, k.val, coalesce((SELECT first(v.adv ORDER BY v.t) FROM adv v WHERE v.pos = k.pos AND v.t >= k.t), 0) AS x FROM tok k"


@query(
    "r09_gae",
    "SELECT pos, t, round(x + val + 1e-9::DOUBLE, 6) AS returns, round((x - mean) / sqrt(var + 1e-8::DOUBLE) + 1e-9::DOUBLE, 6) AS advantages FROM src CROSS JOIN white",
    {**C, "valid": _VALID, "adv": _ADV, "src": _SRC, "white": _WHITE},
)
def gae(spark, path):
    out = R.gae(tokens(spark, path), 0.99, 0.95)
    nudge = [F.transform(c, lambda x: x + 1e-9).alias(c) for c in ("returns", "advantages")]
    return _exploded(out.select("pos", *nudge), "returns", "advantages")


@query(
    "r10_kl_penalties",
    """SELECT pos, t, round(reward - (old_logp - rollout_logp) * 0.1::DOUBLE, 6) AS penalised, round(d, 6) AS k1, round(abs(d), 6) AS abs, round(0.5::DOUBLE * d * d, 6) AS k2,
       round(least(greatest(exp(-d) + d - 1, -10), 10), 6) AS k3 FROM (SELECT *, old_logp - rollout_logp AS d FROM tok)""",
    C,
)
def kl_penalties(spark, path):
    rows = tokens(spark, path)
    old, ref = F.col("old_logp"), F.col("rollout_logp")
    kinds = [R.kl_estimate(old, ref, k).alias(k) for k in ("k1", "abs", "k2", "k3")]
    return _exploded(rows.select("pos", R.kl_penalised(F.col("rewards"), old, ref, 0.1).alias("penalised"), *kinds), "penalised", "k1", "abs", "k2", "k3")


_ROW = "SELECT pos, sum(reward * mask) AS s, sum(mask) AS n, max(t) AS w FROM tok GROUP BY 1"


@query(
    "r11_token_aggregation",
    """SELECT 'token-mean' AS mode, round(sum(s) / sum(n), 6) AS value FROM rw UNION ALL SELECT 'seq-mean-token-sum', round(sum(CASE WHEN n > 0 THEN s END) / count(*) FILTER (n > 0), 6) FROM rw
       UNION ALL SELECT 'seq-mean-token-mean', round(sum(CASE WHEN n > 0 THEN s / (n + 1e-8::DOUBLE) END) / count(*) FILTER (n > 0), 6) FROM rw
       UNION ALL SELECT 'seq-mean-token-sum-norm', round(sum(s) / max(w), 6) FROM rw""",
    {**C, "rw": _ROW},
)
def token_aggregation(spark, path):
    rows = tokens(spark, path)
    out = None
    for mode in ("token-mean", "seq-mean-token-sum", "seq-mean-token-mean", "seq-mean-token-sum-norm"):
        part = R.aggregate_tokens(rows, "rewards", "mask", mode).select(F.lit(mode).alias("mode"), F.round("value", 6).alias("value"))
        out = part if out is None else out.unionByName(part)
    return out


@query(
    "r11_masked_moments",
    "SELECT n, round(s, 6) AS sum, round(mean, 6) AS mean, round((SELECT sum((reward - mean) * (reward - mean)) FROM tok WHERE mask = 1) / (n + 1e-8::DOUBLE) * n / (n - 1), 6) AS var FROM (SELECT count(*)::DOUBLE AS n, sum(reward) AS s, sum(reward) / (count(*) + 1e-8::DOUBLE) AS mean FROM tok WHERE mask = 1)",
    C,
)
def masked_moments(spark, path):
    return r6(R.masked_moments(tokens(spark, path), "rewards", "mask"), "sum", "mean", "var")


@query(
    "r01_exact_result_reward",
    """SELECT c_custkey AS sample_id, CASE WHEN c_acctbal > 0 AND NOT EXISTS (SELECT 1 FROM (SELECT o_orderpriority AS v, count(DISTINCT o_orderstatus = 'F') AS c FROM orders WHERE o_custkey = c_custkey GROUP BY 1) WHERE c < 2)
       THEN 1.0::DOUBLE ELSE 0.0 END AS score FROM customer""",
)
def exact_reward(spark, path):
    rows = table(spark, path, "orders").select(
        F.col("o_custkey").alias("sample_id"), (F.col("o_orderstatus") == "F").cast("string").alias("side"), F.col("o_orderpriority").alias("row_text")
    )
    samples = table(spark, path, "customer").select(F.col("c_custkey").alias("sample_id"), F.lit(True).alias("gold_ok"), (F.col("c_acctbal") > 0).alias("pred_ok"))
    return R.exact_result_reward(samples, rows)


@query(
    "r19_varied_groups",
    "SELECT pos, uid FROM (SELECT event_id AS pos, user_id AS uid, stddev_pop(CASE WHEN value > 60 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id) AS sd, count(*) OVER (PARTITION BY user_id) AS n FROM events) WHERE sd > 0 OR n = 1 ORDER BY pos LIMIT 2000",
)
def varied_groups(spark, path):
    rows = responses(spark, path).withColumn("score", F.when(F.col("score") > 60, 1.0).otherwise(0.0))
    return R.cut_batch(R.varied_groups(rows), 2000).select("pos", "uid")


@query("r20_overlong_penalty", "SELECT event_id AS pos, round(least(-(k - (100 - 40)) / 40 * 0.5::DOUBLE, 0), 6) AS penalty FROM responses")
def overlong(spark, path):
    return responses(spark, path).select("pos", F.round(R.overlong_penalty(F.col("length"), 100, 40, 0.5), 6).alias("penalty"))


_PAIR = "SELECT *, event_id // 2 AS pair FROM responses"


@query(
    "r26_preference_mask",
    "SELECT event_id AS pos, CASE WHEN row_number() OVER (PARTITION BY pair ORDER BY score DESC, event_id) = 1 THEN 1 ELSE 0 END AS chosen FROM pr",
    {"pr": _PAIR},
)
def preference_mask(spark, path):
    rows = responses(spark, path).withColumn("pair", F.floor(F.col("pos") / 2))
    return R.preference(rows).select("pos", "chosen")


@query(
    "r26_preference_rows",
    "SELECT pair, first(source ORDER BY score DESC, event_id) AS chosen, last(source ORDER BY score DESC, event_id) AS rejected FROM pr GROUP BY 1",
    {"pr": _PAIR},
)
def preference_rows(spark, path):
    return R.preference_rows(responses(spark, path).withColumn("pair", F.floor(F.col("pos") / 2)), "pair", "source")


@query(
    "r27_filter_and_downsample",
    """SELECT pos, passed FROM (SELECT r.event_id AS pos, CASE WHEN acc BETWEEN 45 AND 55 AND ml < 99 THEN 1 ELSE 0 END AS passed, fst FROM responses r
       JOIN (SELECT uid, avg(score) AS acc, max(k) AS ml, min(event_id) AS fst FROM responses GROUP BY 1) g ON g.uid = r.uid) ORDER BY passed DESC, fst, pos LIMIT 3000""",
)
def filter_and_downsample(spark, path):
    return R.filter_and_downsample(responses(spark, path), 45, 55, 100, 3000).select("pos", "passed")


@query(
    "r29_pairwise_accuracy",
    """SELECT uid, round(coalesce(sum(CASE WHEN (sa > sb) = (la > lb) THEN abs(la - lb) ELSE 0 END) / nullif(sum(abs(la - lb)), 0), 0.5), 6) AS accuracy FROM
       (SELECT a.uid, a.score AS sa, b.score AS sb, a.k % 3 AS la, b.k % 3 AS lb FROM responses a JOIN responses b ON a.uid = b.uid AND a.event_id < b.event_id) GROUP BY 1""",
)
def pairwise_accuracy(spark, path):
    rows = responses(spark, path).withColumn("label", F.col("length") % 3)
    return r6(R.pairwise_accuracy(rows), "accuracy")


@query("r29_sign_accuracy", "SELECT round(avg(CASE WHEN sign(score - 50) = sign((k % 2) * 2 - 1) THEN 1 ELSE 0 END), 6) AS accuracy FROM responses")
def sign_accuracy(spark, path):
    rows = responses(spark, path).select((F.col("score") - 50).alias("score"), (F.col("length") % 2).alias("label"))
    return r6(R.sign_accuracy(rows), "accuracy")


# --- text scoring: solutions are documents with an answer appended ----------


def _solutions(spark, path):
    docs = table(spark, path, "documents")
    n = F.col("n_chars").cast("string")
    thousands = F.format_number("n_chars", 0)
    return docs.select("doc_id", "text", n.alias("n"), thousands.alias("nn"), "lang", "source")


@query("r22_final_number", "SELECT doc_id, CASE WHEN lang = 'fr' THEN 0.0::DOUBLE WHEN lang = 'de' THEN 0.1 ELSE 1.0 END AS strict, 1.0::DOUBLE AS flexible FROM documents")
def final_number(spark, path):
    d = _solutions(spark, path)
    strict = F.concat("text", F.lit(" 12 #### 7 then "), F.when(F.col("lang") == "fr", F.repeat(F.lit(" word"), F.lit(80))).otherwise(F.concat(F.lit("#### "), "nn")))
    truth = F.when(F.col("lang") == "de", F.lit("x")).otherwise(F.col("n"))
    flexible = F.concat("text", F.lit(" so "), "n", F.lit(" . done ."))
    return d.select(
        "doc_id",
        S.final_number_score(strict, truth, "strict", 0.1).alias("strict"),
        (S.final_number(flexible, "flexible") == F.col("n")).cast("double").alias("flexible"),
    )


@query(
    "r23_tagged_answer",
    """SELECT doc_id, CASE WHEN lang = 'fr' THEN 0.0::DOUBLE WHEN lang = 'es' THEN 0.25 ELSE 1.0 END AS score, CASE WHEN lang = 'fr' THEN 0.0::DOUBLE WHEN lang = 'es' THEN 0.25 ELSE 1.0 END AS sub FROM documents""",
)
def tagged_answer(spark, path):
    d = _solutions(spark, path)
    many = F.when(F.col("lang") == "es", F.repeat(F.lit("<answer>no</answer>"), F.lit(11))).otherwise("")
    body = F.concat("text", many, F.lit("<answer>\n The "), F.initcap("source"), F.lit("! </answer> end"))
    solution = F.when(F.col("lang") == "fr", F.col("text")).otherwise(body)
    golds = F.array(F.lit("nothing"), F.concat(F.lit("a "), F.col("source"), F.lit(".")))
    return d.select("doc_id", S.tagged_answer_score(solution, golds).alias("score"), S.tagged_answer_score(solution, golds, True).alias("sub"))


@query("r24_boxed_answer", "SELECT doc_id, CASE WHEN lang = 'fr' THEN 0.0::DOUBLE ELSE 1.0 END AS score FROM documents")
def boxed_answer(spark, path):
    d = _solutions(spark, path)
    box = F.concat("text", F.lit(r" \boxed{1} so \boxed{\dfrac{"), "n", F.lit(r"}{2} \left(x\right)} end"))
    solution = F.when(F.col("lang") == "fr", F.col("text")).otherwise(box)
    truth = F.concat(F.lit(r"\frac{"), "n", F.lit(r"}{2}(x)"))
    return d.select("doc_id", S.boxed_score(solution, truth).alias("score"))


@query("r25_final_answer", "SELECT doc_id, CASE WHEN lang = 'fr' THEN -1.0::DOUBLE ELSE 1.0 END AS score FROM documents")
def final_answer(spark, path):
    d = _solutions(spark, path)
    tail = F.when(F.col("lang") == "fr", "nothing here").otherwise(F.concat(F.lit("\nANSWER : x = $"), "nn", F.lit("$ dollars\nbye")))
    solution = F.concat(F.regexp_replace("text", "(?i)answer", "reply"), tail)
    return d.select("doc_id", S.final_answer_score(solution, F.col("n")).alias("score"))


@query(
    "r21_routed_score",
    "SELECT doc_id, CASE lang WHEN 'en' THEN 1.0::DOUBLE WHEN 'fr' THEN -1.0 WHEN 'de' THEN 0.0 ELSE 1.0 END AS score FROM documents",
)
def routed_score(spark, path):
    d = _solutions(spark, path)
    source = (
        F.when(F.col("lang") == "en", "openai/gsm8k").when(F.col("lang") == "fr", "aime24").when(F.col("lang") == "de", "hiyouga/geometry3k").otherwise("searchR1_nq")
    )
    solution = F.concat(F.regexp_replace("text", "(?i)answer", "reply"), F.lit(" #### "), "nn", F.lit(" <answer>"), "n", F.lit("</answer>"))
    return d.select("doc_id", S.routed_score(source, solution, F.col("n")).alias("score"))


@query(
    "r32_choice_and_format",
    "SELECT doc_id, CASE WHEN lang = 'en' THEN 1.0::DOUBLE ELSE 0.0 END AS choice, CASE WHEN lang = 'en' THEN 1.0::DOUBLE WHEN lang = 'fr' THEN 0.1 ELSE 0.9 END AS blended FROM documents",
)
def choice_and_format(spark, path):
    d = _solutions(spark, path)
    text = F.regexp_replace("text", "(?i)answer", "reply")
    choice = F.concat(text, F.lit(" answer: $"), F.when(F.col("lang") == "en", "C").otherwise("B"), F.lit("$"))
    box = F.concat(F.lit(r" \boxed{"), F.when(F.col("lang") == "fr", "0").otherwise(F.col("n")), F.lit("}"))
    think = F.when(F.col("lang").isin("en", "fr"), F.concat(F.lit("<think>"), text, F.lit("</think>"))).otherwise(text)
    return d.select("doc_id", S.choice_score(choice, F.lit("C")).alias("choice"), F.round(S.blended_score(F.concat(think, box), F.col("n")), 6).alias("blended"))


@query(
    "r31_turn_words",
    r"""SELECT conv_id, CAST(sum(CASE WHEN rn > 1 THEN len(list_filter(string_split_regex(text, '\s+'), lambda w: w <> '')) ELSE 0 END) AS BIGINT) AS words FROM
        (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS rn FROM conversations) GROUP BY 1""",
)
def turn_words(spark, path):
    conv = table(spark, path, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("m"))
    return conv.select("conv_id", S.turn_words(F.col("m"), F.lit(1), "text").cast("bigint").alias("words"))


@query("h02_custom_reward", "SELECT doc_id, CASE WHEN contains(text, 'thing') THEN length(text)::DOUBLE ELSE 0.0 END AS score FROM documents")
def custom_reward(spark, path):
    R.register_reward("length_if_thing", lambda b: b["solution"].str.len().where(b["solution"].str.contains("thing", regex=False), 0))
    docs = table(spark, path, "documents").select(
        "doc_id", F.col("source").alias("data_source"), F.col("text").alias("solution"), F.col("lang").alias("ground_truth"), F.lit("").alias("extra")
    )
    return R.apply_reward(docs, "length_if_thing").select("doc_id", "score")


@query(
    "h03_estimator_registry",
    _SEL.format("(score - m) / (s + 1e-6::DOUBLE)").replace("AS pos,", "AS pos, 'grpo' AS name,")
    + " UNION ALL " + _SEL.format("CASE WHEN n > 1 THEN n / (n - 1) * (score - m) ELSE score END").replace("AS pos,", "AS pos, 'rloo' AS name,"),
    C,
)
def estimator_registry(spark, path):
    out = None
    for name in ("grpo", "rloo"):
        part = R.estimator(name)(responses(spark, path)).select("pos", F.lit(name).alias("name"), F.round(F.col("advantage") + 1e-9, 6).alias("advantage"))
        out = part if out is None else out.unionByName(part)
    return out
