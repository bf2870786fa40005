"""Orders without replacement, and selections that depend on an order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ranks import global_rank, rank_within
from ..sources.stages import staged
from . import dedup

#: Rows up to which one side of a join is broadcast here.
SMALL_SIDE = 100_000


def decisions(conversations: DataFrame, role: str = "assistant") -> DataFrame:
    """One row per assistant turn: conv_id, turn, ordinal, decisions, with_system, chars, sha, stratum fields and id."""
    every, upto = Window.partitionBy("conv_id"), Window.partitionBy("conv_id").orderBy("turn")
    mine = F.col("role") == role
    d = conversations.withColumns({
        "decisions": F.count_if(mine).over(every), "ordinal": F.count_if(mine).over(upto), "with_system": F.bool_or(F.col("role") == "system").over(every),
    }).filter(mine)
    d = d.withColumns({
        "chars": F.length("text").cast("long"), "sha": F.sha2("text", 256), "shape": F.when(F.col("decisions") > 1, "trajectory").otherwise("simple"),
        "kind": F.when(F.length("text") < 300, "short").otherwise("long"), "place": F.least("ordinal", F.lit(3)),
    })
    return d.withColumn("stratum", F.sha2(F.concat_ws("|", "shape", "kind", "place", F.col("with_system").cast("string")), 256))


def quota_order(rows: DataFrame, stratum: str, sha: str, ids: list[str]) -> DataFrame:
    """rows with `pos` (from 1): first one row of each stratum, rare strata first; then all others at centred quantiles.

    The i-th of a stratum's m other rows stands at (2i - 1) / 2m; equal quantiles are equal doubles, and hashes break ties.
    """
    r = rank_within(rows, stratum, [sha, *ids], "_i", "_n")
    head = F.col("_i") == 1
    tie = F.sha2(F.concat(stratum, F.lit("\x1f"), sha), 256)
    r = r.withColumns({
        "_phase": F.when(head, 0).otherwise(1), "_size": F.when(head, F.col("_n")).otherwise(0), "_q": F.when(head, 0.0).otherwise((2 * F.col("_i") - 3) / (2 * (F.col("_n") - 1))), "_tie": F.when(head, F.col(stratum)).otherwise(tie),
    })
    return global_rank(r, ["_phase", "_size", "_q", "_tie", *ids], "pos").drop("_n", "_i", "_phase", "_size", "_q", "_tie")


def spread(ordered: DataFrame, coverage: int, n: int) -> DataFrame:
    """ordered(pos 1..n) with `place` (from 0): the first `coverage` rows go to floor((2i + 1) n / 2c), the rest fill the gaps in order."""
    spark = ordered.sparkSession
    to = F.expr(f"((2 * (pos - 1) + 1) * {n}) div {2 * coverage}")
    taken = spark.range(1, coverage + 1).select(F.col("id").alias("pos")).select(to.alias("id"))
    free = global_rank(spark.range(n).join(taken.hint("merge"), "id", "left_anti"), ["id"], "_k").select((F.col("_k") + coverage).alias("pos"), F.col("id").alias("_free"))
    j = ordered.join(free.hint("merge"), "pos", "left")
    return j.withColumn("place", F.when(F.col("pos") <= coverage, to).otherwise(F.col("_free"))).drop("_free")


def capped_select(rows: DataFrame, order: list[str], cluster: str, template: str, cluster_cap: int, template_cap: int, most: int, least: int = 0, least_clusters: int = 0) -> DataFrame:
    """rows with `state` of the walk in `order`: taken, cluster_full, template_full, or cut (behind the last of `most` taken rows).

    Rounds: among undecided rows of groups with room, the first of each cluster and of each template are found, as many as
    there is room for; what is among both is taken, and rows of full groups leave. The earliest undecided row is always
    taken. Only the first `cap` rows of a group are ranked (the rest is pruned before the shuffle), so a hot cluster or
    template is no task of its own. Fails when fewer than `least` rows or `least_clusters` clusters are taken. The order
    must be total and without nulls; a null cluster or template is one too.
    """
    open_ = staged(rows.select(*order, F.col(cluster).alias("_c"), F.col(template).alias("_t")), "capped")
    key = F.struct(*order)
    taken = open_.limit(0)
    caps = {"_c": cluster_cap, "_t": template_cap}

    def with_counts(df: DataFrame, by: str) -> DataFrame:
        n = taken.groupBy(F.col(by).alias("_g")).agg(F.count("*").alias("_n"))
        hint = "broadcast" if n.limit(SMALL_SIDE + 1).count() <= SMALL_SIDE else "merge"
        return df.join(n.hint(hint), F.col(by).eqNullSafe(F.col("_g")), "left").withColumn("_n", F.coalesce("_n", F.lit(0))).drop("_g")

    while True:
        firsts = []
        for by, cap in caps.items():
            ranked = open_.withColumn("_k", F.row_number().over(Window.partitionBy(by).orderBy(*order))).filter(F.col("_k") <= cap)
            firsts.append(with_counts(ranked, by).filter(F.col("_k") <= cap - F.col("_n")).select(*order, "_c", "_t"))
        new = staged(firsts[0].join(firsts[1].select(*order).hint("merge"), order, "left_semi"), "capped-new")
        taken = staged(taken.unionByName(new), "capped-taken")
        open_ = open_.join(new.select(*order).hint("merge"), order, "left_anti")
        for by, cap in caps.items():
            open_ = with_counts(open_, by).filter(F.col("_n") < cap).drop("_n")
        last = _nth(taken, order, most)
        if last is not None:
            open_ = open_.filter(key < last)  # what comes later is cut in any case
        open_ = staged(open_, "capped")
        if not open_.limit(1).count():
            break
    last = _nth(taken, order, most)
    if last is not None:
        taken = taken.filter(key <= last)
    n, clusters = taken.agg(F.count("*"), F.count_distinct(F.struct("_c"))).first()
    if n < least or clusters < least_clusters:
        raise ValueError(f"{n} rows of {clusters} clusters are taken, fewer than {least} of {least_clusters}")
    full = taken.groupBy(F.col("_c").alias("_g")).agg(F.count("*").alias("_n"), F.max(key).alias("_at")).filter(F.col("_n") >= cluster_cap).select("_g", "_at")
    out = rows.join(taken.select(*order, F.lit(True).alias("_taken")).hint("merge"), order, "left")
    out = out.join(full.hint("broadcast" if full.limit(SMALL_SIDE + 1).count() <= SMALL_SIDE else "merge"), F.col(cluster).eqNullSafe(F.col("_g")), "left")
    cut = F.lit(False) if last is None else key > last
    state = F.when(F.col("_taken"), "taken").when(cut, "cut").when(F.col("_at") < key, "cluster_full").otherwise("template_full")
    return out.withColumn("state", state).drop("_taken", "_g", "_at")


def _nth(taken: DataFrame, order: list[str], n: int):
    """The order columns of the n-th row, as a literal struct; None if there are fewer. One row reaches the driver."""
    first = taken.select(*order).orderBy(*order).limit(n)
    row = first.agg(F.count("*").alias("n"), F.max(F.struct(*order)).alias("m")).first()
    return None if row.n < n else F.struct(*[F.lit(row.m[c]).alias(c) for c in order])


def greedy_cover(strata: DataFrame, most: int) -> DataFrame:
    """strata(row_id, h, stratum) -> (row_id, kind, pos): rows picked until every stratum is covered, most new strata first, then
    h; then others in the order of h, up to `most` rows in all. pos is the place in the order of row_id.

    Rows with the same strata are one candidate (their first by hash). A round brings one winner to the driver. Fails if the
    cover alone has more than `most` rows.
    """
    sets = strata.groupBy("row_id", "h").agg(F.array_sort(F.collect_set("stratum")).alias("set"))
    sets = sets.groupBy("set").agg(F.min(F.struct("h", "row_id")).alias("w")).select("set", "w.h", "w.row_id")
    left = staged(sets.select("row_id", "h", F.explode("set").alias("stratum")), "cover")
    picked: list[tuple] = []
    while True:
        best = left.groupBy("row_id", "h").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "h", "row_id").first()
        if best is None:
            break
        picked.append((best.row_id, "cover"))
        if len(picked) > most:
            raise ValueError(f"a cover needs more than {most} rows")
        gone = left.filter(F.col("row_id") == best.row_id).select("stratum")
        left = staged(left.join(F.broadcast(gone), "stratum", "left_anti"), "cover")  # one row's strata
    kind = dict(strata.dtypes)["row_id"]
    cover = strata.sparkSession.createDataFrame(picked, f"row_id {kind}, kind string")
    rest = strata.groupBy("row_id").agg(F.min("h").alias("h")).join(F.broadcast(cover.select("row_id")), "row_id", "left_anti")  # `most` rows at most
    fill = rest.orderBy("h", "row_id").limit(most - len(picked)).select("row_id", F.lit("fill").alias("kind"))
    return global_rank(cover.union(fill), ["row_id"], "pos")


def component_sides(members: DataFrame, row: str, key: str, percent: int) -> DataFrame:
    """members(row, key): rows that share a key, directly or through others, get one label, and a hash of it decides the side."""
    first = members.groupBy(key).agg(F.min(row).alias("a"))
    edges = members.join(first.hint("merge"), key).filter(F.col("a") != F.col(row)).select("a", F.col(row).alias("b")).distinct()
    labels = dedup.connected(edges)
    rows = members.select(row).distinct().join(labels.withColumnRenamed("node", row).hint("merge"), row, "left").withColumn("label", F.coalesce("label", row))
    side = F.conv(F.substring(F.sha2(F.col("label").cast("string"), 256), 1, 8), 16, 10).cast("long") % 100 < percent
    return rows.select(row, "label", F.when(side, "eval").otherwise("train").alias("side"))


def serve(sources: Column, draws: int) -> Column:
    """sources: array of (source, a, b), weights at the first and the last draw -> array of (source, target, served) after all draws.

    Every draw adds its weights to what each source is owed (target) and serves one unit to the largest deficit; deficits closer than 1e-9
    tie, and the first source wins. One row holds all sources: there is a weight for each in a configuration.
    """
    start = F.transform(sources, lambda s: F.struct(s["source"].alias("source"), s["a"].alias("a"), s["b"].alias("b"), F.lit(0.0).alias("target"), F.lit(0).cast("long").alias("served")))

    def draw(state: Column, step: Column) -> Column:
        owed = F.transform(state, lambda s: s.withField("target", s["target"] + s["a"] + (s["b"] - s["a"]) * step / F.lit(max(draws - 1, 1))))
        # Bound once a draw: each is used for all sources.
        picked = F.transform(F.array(owed), lambda o: F.struct(o.alias("o"), F.array_max(F.transform(o, lambda s: s["target"] - s["served"])).alias("most")))
        picked = F.transform(picked, lambda x: F.struct(x["o"].alias("o"), F.array_position(F.transform(x["o"], lambda s: s["target"] - s["served"] >= x["most"] - 1e-9), F.lit(True)).alias("at")))
        return F.transform(picked, lambda x: F.transform(x["o"], lambda s, i: s.withField("served", s["served"] + (i + 1 == x["at"]).cast("long"))))[0]

    done = F.aggregate(F.sequence(F.lit(0), F.lit(draws - 1)), start, draw)
    return F.transform(done, lambda s: F.struct(s["source"].alias("source"), s["target"].alias("target"), s["served"].alias("served")))
