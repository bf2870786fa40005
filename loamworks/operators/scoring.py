"""Metrics of predicted calls, episodes and rankings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def same_calls(gold: Column, pred: Column) -> Column:
    """Whether two arrays of calls are equal as multisets of (name, arguments)."""
    plain = lambda c: F.array_sort(F.transform(c, lambda x: F.struct(x["name"], x["args"])))
    return plain(gold) == plain(pred)


def ratio(a: Column, b: Column, digits: int = 6) -> Column:
    """a / b, null where b is 0."""
    return F.round(a / F.nullif(b, F.lit(0)), digits)


def name_overlap(calls: DataFrame, keys: list[str]) -> DataFrame:
    """calls(keys, side, name) -> per key and name the gold, predicted and common occurrences."""
    n = calls.groupBy(*keys, "name").agg(F.count_if(F.col("side") == "gold").alias("n_gold"), F.count_if(F.col("side") == "pred").alias("n_pred"))
    return n.withColumn("common", F.least("n_gold", "n_pred"))


def choose(n: Column, k: Column) -> Column:
    """Binomial coefficient as a product of ratios; 0 where n < k."""
    prod = F.aggregate(F.sequence(F.lit(1), F.greatest(k, F.lit(1))), F.lit(1.0), lambda acc, i: acc * (n - k + i) / i)
    return F.when(k == 0, 1.0).when(n < k, 0.0).otherwise(prod)


def pass_hat(successes: Column, n: Column, k: Column) -> Column:
    """Chance that k runs drawn from a task's n all succeed: C(s, k) / C(n, k), as one product that can't overflow."""
    prod = F.aggregate(F.sequence(F.lit(0), F.greatest(k - 1, F.lit(0))), F.lit(1.0), lambda acc, i: acc * F.greatest(successes - i, F.lit(0)) / (n - i))
    return F.when(n < k, 0.0).otherwise(prod)


def sign_test(wins: Column, losses: Column) -> Column:
    """One-sided P(X >= wins) for X ~ Binomial(wins + losses, 1/2); 1 without any. One pass of running log-binomials."""
    n = (wins + losses).cast("double")
    start = F.struct(F.lit(0.0).alias("log_c"), F.lit(0.0).alias("sum"))

    def step(acc: Column, k: Column) -> Column:
        log_c = F.when(k == 0, 0.0).otherwise(acc["log_c"] + F.log(n - k + 1) - F.log(k.cast("double")))
        return F.struct(log_c.alias("log_c"), (acc["sum"] + F.when(k >= wins, F.exp(log_c - n * F.log(F.lit(2.0)))).otherwise(0.0)).alias("sum"))

    tail = F.aggregate(F.sequence(F.lit(0).cast("long"), (wins + losses).cast("long")), start, step)["sum"]
    return F.when(n == 0, 1.0).otherwise(F.least(tail, F.lit(1.0)))


def gate_table(metrics: DataFrame, group: str, gates: DataFrame) -> DataFrame:
    """metrics(group, a column each), gates(gate, metric, comparator, threshold) -> group, gate, comparator, threshold, observed, passed, ready.

    Comparators are >=, <= and ==; another one fails the query. A null observation fails >= and <= and equals a null threshold only. A
    group is ready if all its gates pass. Gates are a list that people write, so they are broadcast.
    """
    names = [c for c in metrics.columns if c != group]
    long = metrics.select(group, F.explode(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("observed")) for c in names])).alias("x")).select(group, "x.*")
    o, t, c = F.col("observed"), F.col("threshold"), F.col("comparator")
    passed = F.when(c == ">=", F.coalesce(o >= t, F.lit(False))).when(c == "<=", F.coalesce(o <= t, F.lit(False))).when(c == "==", o.eqNullSafe(t)).otherwise(F.raise_error("unsupported comparator"))
    j = long.join(F.broadcast(gates), "metric").withColumn("passed", passed)
    ready = F.bool_and("passed").over(Window.partitionBy(group))  # as many rows as there are gates
    return j.select(group, "gate", "comparator", "threshold", "observed", "passed", ready.alias("ready"))


def oracle_candidates(gold: DataFrame, candidates: DataFrame, key: str) -> DataFrame:
    """gold(key, g), candidates(key, p) -> key, missing (names of g that p lacks, joined), complete. A key on one side only fails the query."""
    j = gold.join(candidates, key, "full_outer")
    both = F.assert_true(F.col("g").isNotNull() & F.col("p").isNotNull(), "tasks and candidates don't match").isNull()
    lacks = F.array_sort(F.array_except("g", "p"))
    return j.filter(both).select(key, F.array_join(lacks, ",").alias("missing"), (F.size(lacks) == 0).alias("complete"))
