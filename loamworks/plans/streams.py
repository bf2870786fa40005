"""Streaming jobs over the shared tables, read as streams of their files."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as tx
from ..registry import Register
from ..sources.stages import table
from ..streaming import jobs
from .corpus import FLAGS, REASON, REASONS, SQUEEZED

QUERIES = query = Register()


@query(f"SELECT DISTINCT sha256({SQUEEZED}) AS digest FROM documents WHERE {REASON} IS NULL")
def ss_pool(spark, sf_dir):
    """Run twice on one checkpoint: the second run adds nothing."""
    job = jobs.Job(spark, "pool")
    job.append(jobs.pool(jobs.source(spark, sf_dir, "documents")))
    return job.append(jobs.pool(jobs.source(spark, sf_dir, "documents")))


@query("SELECT source, count(*) AS documents, sum(n_chars)::BIGINT AS chars FROM documents GROUP BY source")
def ss_resume_source(spark, sf_dir):
    """Acquisition resumed from its checkpoint: files that were done aren't read again."""
    job = jobs.Job(spark, "resume")
    for _ in range(2):
        got = job.append(jobs.source(spark, sf_dir, "documents").select("doc_id", "source", "n_chars"))
    return got.groupBy("source").agg(F.count("*").alias("documents"), F.sum("n_chars").alias("chars"))


def _in_time(spark, sf_dir):
    """Events in three parts by time, then a late part: every 40th event of the first third, long behind the watermark by then."""
    e = table(spark, sf_dir, "events")
    low, high = e.agg(F.min("ts").cast("timestamp").cast("double"), F.max("ts").cast("timestamp").cast("double")).first()
    if low is None:
        return jobs.arriving(spark, [e])
    third = F.least(F.floor((F.col("ts").cast("timestamp").cast("double") - low) * 3 / max(high - low, 1e-9)), F.lit(2))
    late = (third == 0) & (F.col("event_id") % 40 == 0)
    return jobs.arriving(spark, [e.filter((third == i) & ~late) for i in range(3)] + [e.filter(late)])


#: Events that aren't late: a third is a third of the time between the first and the last event.
ON_TIME = "b AS (SELECT min(epoch(ts)) AS low, max(epoch(ts)) AS high FROM events), ev AS (SELECT events.* FROM events, b WHERE NOT (least(floor((epoch(ts) - low) * 3 / greatest(high - low, 1e-9)), 2) = 0 AND event_id % 40 = 0))"


@query(f"""WITH {ON_TIME} SELECT strftime(time_bucket(INTERVAL 1 day, ts), '%Y-%m-%d %H:%M:%S') AS window_start, count(*) AS n, count(*) FILTER (WHERE value <= 50) AS on_time, count(*) FILTER (WHERE value <= 50 AND event_id % 3 <> 0 AND event_type <> 'error') AS successes, quantile_disc(value, 0.5) AS p50
FROM ev GROUP BY 1, time_bucket(INTERVAL 1 day, ts) HAVING time_bucket(INTERVAL 1 day, ts) + INTERVAL 1 day <= (SELECT max(ts) FROM ev) - INTERVAL 1 hour""")
def ss_deadline_window(spark, sf_dir):
    """Daily windows over four micro-batches; the last brings rows behind the watermark, which are dropped. A second run on the checkpoint adds nothing."""
    job, events = jobs.Job(spark, "windows"), _in_time(spark, sf_dir)
    for _ in range(2):
        out = job.append(jobs.deadline_windows(events, 50.0))
    return out


@query(f"""WITH {ON_TIME}, g AS (SELECT *, CASE WHEN ts - lag(ts) OVER w < INTERVAL 6 hours THEN 0 ELSE 1 END AS new FROM ev WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM g)
SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS session_start, count(*) AS steps, round(sum(value), 4) AS total FROM s GROUP BY user_id, k HAVING max(ts) + INTERVAL 6 hours <= (SELECT max(ts) FROM ev) - INTERVAL 1 hour""")
def ss_sessions(spark, sf_dir):
    """Sessions of users over the same four micro-batches; late rows open none."""
    return jobs.Job(spark, "sessions").append(jobs.sessions(_in_time(spark, sf_dir)))


@query("""WITH s AS (SELECT source, sum(n_chars)::BIGINT AS served FROM documents GROUP BY source), t AS (SELECT *, sum(served) OVER () / count(*) OVER () AS entitled FROM s)
SELECT source, served, round(entitled - served, 4) AS deficit, entitled - served = max(entitled - served) OVER () AS next FROM t""")
def ss_mixture_state(spark, sf_dir):
    """Running totals per source as streaming state; the source with the largest deficit is served next."""
    job = jobs.Job(spark, "mixture")
    totals = jobs.source(spark, sf_dir, "documents").groupBy("source").agg(F.sum("n_chars").alias("served"))
    states = job.batches(totals, lambda b: b, "complete")
    last = states.filter(F.col("batch") == states.agg(F.max("batch")).first()[0])
    from pyspark.sql import Window

    w = Window.partitionBy()  # one row a source
    t = last.withColumn("gap", F.sum("served").over(w) / F.count("*").over(w) - F.col("served"))
    return t.select("source", "served", F.round("gap", 4).alias("deficit"), (F.col("gap") == F.max("gap").over(w)).alias("next"))


#: As tx.folded: white space of all scripts, where RE2's own is ASCII's.
SEEN = r"lower(trim(regexp_replace(text, '[\t-\r\x{85}\p{Z}]+', ' ', 'g')))"


@query(f"""WITH r AS (SELECT doc_id, {SEEN} AS t, {FLAGS} FROM documents), h AS (SELECT r.*, (SELECT count(*) FROM (SELECT DISTINCT {SEEN} AS entry FROM benchmark) e WHERE entry <> '' AND contains(r.t, e.entry)) AS entries FROM r)
SELECT doc_id, entries, concat_ws(',', {", ".join(f"CASE WHEN {k} THEN '{k}' END" for k in REASONS)}) AS reasons, entries = 0 AND NOT coalesce({" OR ".join(REASONS)}, false) AS kept FROM h""")
def ss_screen(spark, sf_dir):
    """Arriving documents against the static denylist and all privacy rules. A null text has no reason; null and empty entries and texts match nothing."""
    deny = table(spark, sf_dir, "benchmark").select(tx.folded(F.col("text")).alias("entry"))
    return jobs.Job(spark, "screen").batches(jobs.source(spark, sf_dir, "documents"), lambda batch: jobs.screen(batch, deny)).drop("batch")
