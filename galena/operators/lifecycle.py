"""Lifecycle jobs over tables of documents and generations. The time is always a parameter."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def count_differences(expected: DataFrame, stored: DataFrame, key: str) -> DataFrame:
    """Keys whose expected and stored counts differ; a missing count is 0."""
    both = expected.join(stored, key, "full").select(key, F.coalesce("expected", F.lit(0)).alias("expected"), F.coalesce("stored", F.lit(0)).alias("stored"))
    return both.filter("expected <> stored")


def next_generations(generations: DataFrame) -> DataFrame:
    """(document_id, next_generation)"""
    return generations.groupBy("document_id").agg((F.max("generation") + 1).alias("next_generation"))


def publication_outcomes(candidates: DataFrame, generations: DataFrame) -> DataFrame:
    """What publishing each candidate (document_id, generation, status) does: an already published
    one stays, one that is not staged is an error, one behind a published later one is superseded,
    else it is published and the earlier published one retires."""
    live = generations.filter("generation_status = 'PUBLISHED'").groupBy("document_id").agg(F.max("generation").alias("live"))
    outcome = (
        F.when(F.col("status") == "PUBLISHED", "ALREADY_PUBLISHED")
        .when(F.col("status") != "STAGING", "INVALID")
        .when(F.col("live") > F.col("generation"), "SUPERSEDED")
        .when(F.col("live").isNotNull(), "PUBLISHED_AND_RETIRED_PREVIOUS")
        .otherwise("PUBLISHED")
    )
    return candidates.join(live, "document_id", "left").select("document_id", "generation", outcome.alias("outcome"))


def retention_claims(lifecycle: DataFrame, active: DataFrame, as_of: Column, limit: int) -> DataFrame:
    """The next expired documents to delete, oldest first, that no ingestion works on."""
    due = lifecycle.filter((F.col("retention_status") == "ACTIVE") & (F.col("expires_at") <= as_of))
    return due.join(active.select("document_id").distinct(), "document_id", "left_anti").orderBy("expires_at", "document_id").limit(limit)


def stale_ingestions(jobs: DataFrame, leases: DataFrame, as_of: Column, seconds: int) -> DataFrame:
    """Jobs in work for longer than `seconds` without a live lease."""
    live = leases.filter(F.col("lease_until") > as_of).select("document_id").distinct()
    old = jobs.filter((F.col("status") == "INGESTING") & (F.col("started_at") < as_of - F.make_dt_interval(secs=F.lit(seconds))))
    return old.join(live, "document_id", "left_anti")


def orphan_generations(generations: DataFrame, published: DataFrame, as_of: Column, grace_seconds: int) -> DataFrame:
    """Generations to clean: retiring ones at once, retired and failed ones past their grace; never
    the one that is published."""
    past = F.col("updated_at") < as_of - F.make_dt_interval(secs=F.lit(grace_seconds))
    due = generations.filter((F.col("generation_status") == "RETIRING") | (F.col("generation_status").isin("RETIRED", "FAILED") & past))
    return due.join(published.select("document_id", F.col("published_generation").alias("generation")), ["document_id", "generation"], "left_anti")


def tombstones(gone: DataFrame, as_of: Column, days: int = 7) -> DataFrame:
    return gone.select("document_id", F.lit("PURGED").alias("state"), (as_of + F.make_dt_interval(days=F.lit(days))).alias("purge_after"))


def claim_decisions(requests: DataFrame) -> DataFrame:
    """Idempotent claims, in order of arrival per key: the first claims, the same fingerprint again
    replays (or retries, while the claim's lease lives), another fingerprint is a conflict.

    requests: key, fingerprint, at (seconds), seq, done_at (when the first would succeed)."""
    w = Window.partitionBy("key").orderBy("at", "seq")
    first = requests.withColumns({"owner": F.first("fingerprint").over(w), "ready": F.first("done_at").over(w), "n": F.row_number().over(w)})
    decision = F.when(F.col("n") == 1, "CLAIMED").when(F.col("fingerprint") != F.col("owner"), "CONFLICT").when(F.col("at") >= F.col("ready"), "REPLAY").otherwise("RETRY_LATER")
    return first.select("key", "seq", decision.alias("decision"))


def backoff_seconds(attempt: Column, base: float = 5.0, most: float = 300.0) -> Column:
    return F.least(F.lit(most), F.lit(base) * F.pow(F.lit(2.0), attempt - 1))


def repaired(stored: DataFrame, source: DataFrame, key: str) -> DataFrame:
    """The stored rows, where documents whose number of rows differs from the source's are replaced by
    the source's rows; documents that the source lacks go."""
    wrong = count_differences(source.groupBy(key).agg(F.count("*").alias("expected")), stored.groupBy(key).agg(F.count("*").alias("stored")), key).select(key)
    return stored.join(wrong, key, "left_anti").unionByName(source.join(wrong, key, "left_semi"))


def reembedding(snapshot: DataFrame, staged: DataFrame, current: DataFrame, dimensions: int) -> DataFrame:
    """What to do with each document of a re-embedding: snapshot (document_id, generation, chunk) was taken
    when it began, staged (document_id, chunk, size) has the new vectors, current (document_id, generation)
    is published now. A document that has changed since is FENCED, one with missing or misshapen vectors
    stays STAGING, and the others can CUTOVER."""
    expected = snapshot.groupBy("document_id", "generation").agg(F.count_distinct("chunk").alias("expected"))
    there = snapshot.select("document_id", "chunk").distinct().join(staged.select("document_id", "chunk", "size").distinct(), ["document_id", "chunk"])
    counts = there.groupBy("document_id").agg(F.count_distinct(F.when(F.col("size") == dimensions, F.col("chunk"))).alias("good"))
    now = current.select("document_id", F.col("generation").alias("_now"))
    rows = expected.join(counts, "document_id", "left").join(now, "document_id", "left")
    good = F.coalesce("good", F.lit(0))
    step = F.when(~F.col("_now").eqNullSafe(F.col("generation")), "FENCED").when(good < F.col("expected"), "STAGING").otherwise("CUTOVER")
    return rows.select("document_id", "generation", "expected", good.alias("good"), step.alias("step"))


def due_jobs(jobs: DataFrame, as_of: Column) -> DataFrame:
    """Jobs (job, last_run, every_seconds, at_second) that should run: those never run, those with a delay
    that has passed, and daily ones whose second of the day came since their last run."""
    day = F.date_trunc("day", as_of)
    today = day + F.make_dt_interval(secs=F.col("at_second"))
    slot = F.when(today <= as_of, today).otherwise(today - F.make_dt_interval(days=F.lit(1)))
    by_delay = F.col("last_run") + F.make_dt_interval(secs=F.col("every_seconds")) <= as_of
    due = F.col("last_run").isNull() | F.coalesce(by_delay, F.lit(False)) | F.coalesce(F.col("last_run") < slot, F.lit(False))
    return jobs.filter(due)


def compared_and_set(values: DataFrame, updates: DataFrame) -> DataFrame:
    """(name, value, version) after updates (name, seq, expected, value), in order of seq: one takes effect if
    it expects the version that its name then has. A name's updates are folded in one row, and their
    number is that of the writes to one setting."""
    listed = updates.groupBy("name").agg(F.array_sort(F.collect_list(F.struct("seq", "expected", "value"))).alias("_u"))

    def step(acc: Column, u: Column) -> Column:
        return F.when(u["expected"] == acc["version"], F.struct(u["value"].alias("value"), (acc["version"] + 1).alias("version"))).otherwise(acc)

    start = F.struct(F.col("value").alias("value"), F.col("version").cast("long").alias("version"))
    none = F.array().cast("array<struct<seq:bigint,expected:bigint,value:string>>")
    rows = values.join(listed.select("name", F.col("_u").cast("array<struct<seq:bigint,expected:bigint,value:string>>").alias("_u")), "name", "left")
    return rows.select("name", F.aggregate(F.coalesce("_u", none), start, step).alias("r")).select("name", "r.value", "r.version")


#: What an error of an ingestion means: those of the first group are tried again.
TRANSIENT = ("TIMEOUT", "UNAVAILABLE", "CONFLICT", "RATE_LIMIT")


def retried(jobs: DataFrame, as_of: Column, attempts: int = 5) -> DataFrame:
    """(job, decision, at): RETRY with its time for failed jobs (job, error, attempt, failed_at) whose error
    may pass and that have attempts left, RUN if that time has come, else FAIL."""
    again = F.col("error").isin(*TRANSIENT) & (F.col("attempt") < attempts)
    at = F.col("failed_at") + F.make_dt_interval(secs=backoff_seconds(F.col("attempt")).cast("int"))
    decision = F.when(~F.coalesce(again, F.lit(False)), "FAIL").when(at <= as_of, "RUN").otherwise("RETRY")
    return jobs.select("job", decision.alias("decision"), F.when(F.coalesce(again, F.lit(False)), at).alias("at"))
