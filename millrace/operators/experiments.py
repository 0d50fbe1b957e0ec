"""Tables of A/B experiments: paired savings, lift of a gate, cost against accuracy."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.functions.usage import ratio


def paired(runs: DataFrame, base: str = "baseline", other: str = "optimized", arm: str = "config", tokens: str = "total_tokens", ok: str = "success", task: str = "task") -> DataFrame:
    """task, base_tokens, opt_tokens, save_pct, base_ok, opt_ok of each task that both arms ran, by one grouping (a pivot, no join)."""
    of = lambda a: F.col(arm) == a
    means = runs.where(F.col(arm).isin(base, other)).groupBy(task).agg(
        *[F.avg(F.when(of(a), F.col(tokens))).alias(f"{n}_tokens") for n, a in (("base", base), ("opt", other))],
        *[F.avg(F.when(of(a), F.col(ok).cast("int"))).alias(f"{n}_ok") for n, a in (("base", base), ("opt", other))],
        *[F.count_if(of(a)).alias(f"{n}_runs") for n, a in (("base", base), ("opt", other))],
    )
    both = means.where("base_runs > 0 and opt_runs > 0")
    return both.select(task, "base_tokens", "opt_tokens", (100 * ratio(F.col("base_tokens") - F.col("opt_tokens"), F.col("base_tokens"))).alias("save_pct"), "base_ok", "opt_ok")


def overall(pairs: DataFrame) -> DataFrame:
    """base_tokens and opt_tokens (sums of task means), save_pct, and whether no task lost success."""
    sums = pairs.agg(F.sum("base_tokens").alias("base_tokens"), F.sum("opt_tokens").alias("opt_tokens"), F.coalesce(~F.bool_or(F.col("opt_ok") < F.col("base_ok")), F.lit(True)).alias("quality_held"))
    return sums.withColumn("save_pct", 100 * ratio(F.col("base_tokens") - F.col("opt_tokens"), F.col("base_tokens")))


def lift(runs: DataFrame, first: str = "A", gated: str = "C", pos: str = "pos") -> DataFrame:
    """tier, accuracies, lift, rescued (wrong, then right), damaged, mean tokens, of each tier that both arms ran.

    Runs pair by task and rep; of runs that repeat these within an arm the last by ``pos`` counts for pairs, all for means.
    One grouping by tier, task and rep, and one by tier.
    """
    arm = lambda a: F.col("arm") == a
    last = lambda a: F.max_by(F.when(arm(a), F.col("ok")), F.when(arm(a), F.struct(pos, "ok")))
    sums = [f(F.when(arm(a), x)).alias(f"{n}_{k}") for n, a in (("a", first), ("c", gated)) for k, f, x in (("n", F.count, F.lit(1)), ("right", F.sum, F.col("ok").cast("bigint")), ("tokens", F.sum, F.col("tokens")))]
    cells = runs.where(F.col("arm").isin(first, gated)).groupBy("tier", "task", "rep").agg(last(first).alias("a"), last(gated).alias("c"), *sums)
    tiers = cells.groupBy("tier").agg(F.count_if(~F.col("a") & F.col("c")).alias("rescued"), F.count_if(F.col("a") & ~F.col("c")).alias("damaged"), *[F.sum(f"{n}_{k}").alias(f"{n}_{k}") for n in "ac" for k in ("n", "right", "tokens")])
    both = tiers.where("a_n > 0 and c_n > 0")
    acc = lambda n: F.col(f"{n}_right") / F.col(f"{n}_n")
    return both.select("tier", acc("a").alias("acc_a"), acc("c").alias("acc_c"), (acc("c") - acc("a")).alias("lift"), "rescued", "damaged", (F.col("a_tokens") / F.col("a_n")).alias("tokens_a"), (F.col("c_tokens") / F.col("c_n")).alias("tokens_c"))


def cap_tier(lifts: DataFrame) -> DataFrame:
    """The lowest tier where the gate has stopped helping; null if there is none."""
    return lifts.agg(F.min(F.when((F.col("lift") <= 0) | (F.col("damaged") >= F.col("rescued")), F.col("tier"))).alias("cap_tier"))


def against_baseline(runs: DataFrame, baseline: str = "baseline") -> DataFrame:
    """arm, accuracy, mean_tokens and delta_pct to the baseline arm, which is one row however many runs there are."""
    arms = runs.groupBy("arm").agg(F.avg(F.col("ok").cast("int")).alias("accuracy"), F.avg("tokens").alias("mean_tokens"))
    base = arms.where(F.col("arm") == baseline).agg(F.max("mean_tokens").alias("base"))
    return arms.crossJoin(F.broadcast(base)).select("arm", "accuracy", "mean_tokens", F.when(F.col("base") > 0, 100 * (F.col("mean_tokens") - F.col("base")) / F.col("base")).alias("delta_pct"))


def arm_totals(runs: DataFrame) -> DataFrame:
    """Tokens of each arm and rep, summed over its parts."""
    return runs.groupBy("arm", "rep").agg(F.sum("tokens").alias("tokens"), F.bool_and("ok").alias("ok"))
