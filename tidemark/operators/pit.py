"""Point-in-time reads over evidence records: visibility, revisions, lineage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .asof import asof_backward, salted_join
from .running import running_sums

TIMES = ("event_time", "published_time", "available_time", "ingested_time")


def evidence_reason() -> Column:
    """First causality rule a record breaks, or null."""
    reason = None
    for t in TIMES:
        c = F.col(t).isNull()
        reason = F.when(c, f"missing_{t}") if reason is None else reason.when(c, f"missing_{t}")
    return reason.when(F.col("published_time") < F.col("event_time"), "published_before_event").when(
        F.col("available_time") < F.col("published_time"), "available_before_published"
    )


def validate_evidence(records: DataFrame) -> DataFrame:
    return records.withColumn("reject_reason", evidence_reason())


def validate_revisions(records: DataFrame) -> DataFrame:
    """Records that break a revision rule, one row per broken rule.

    The batch form flags every offender: duplicate ids, unknown targets,
    revisions available before their target, and the second and later revision
    of one record in (ingested_time, record_id) order.
    """
    ids = records.groupBy("record_id").agg(F.count("*").alias("copies"), F.min("available_time").alias("prior_available"))
    duplicate = ids.filter(F.col("copies") > 1).select("record_id", F.lit("DUPLICATE_ID").alias("violation"))
    revs = records.filter(F.col("supersedes_record_id").isNotNull()).select("record_id", "supersedes_record_id", "available_time", "ingested_time")
    target = ids.select(F.col("record_id").alias("supersedes_record_id"), "prior_available")
    checked = revs.join(target, "supersedes_record_id", "left")
    unknown = checked.filter(F.col("prior_available").isNull()).select("record_id", F.lit("UNKNOWN_TARGET").alias("violation"))
    early = checked.filter(F.col("available_time") < F.col("prior_available")).select("record_id", F.lit("REVISION_BEFORE_ORIGINAL").alias("violation"))
    first = revs.groupBy("supersedes_record_id").agg(F.min(F.struct("ingested_time", "record_id")).alias("kept"))
    second = revs.join(first, "supersedes_record_id").filter(F.col("record_id") != F.col("kept.record_id")).select("record_id", F.lit("SECOND_REVISION").alias("violation"))
    return duplicate.unionByName(unknown).unionByName(early).unionByName(second)


def with_hidden_from(records: DataFrame) -> DataFrame:
    """Add ``hidden_from``: when the first superseding record became available.

    Visible at t means available_time <= t and not hidden_from <= t. A
    superseder hides its target even when quarantined or of another ticker.
    """
    cover = records.filter(F.col("supersedes_record_id").isNotNull()).groupBy(F.col("supersedes_record_id").alias("record_id")).agg(
        F.min("available_time").alias("hidden_from")
    )
    return records.join(cover, "record_id", "left")


def as_of(records: DataFrame, decision_time: Column, ticker: str | None = None, include_quarantined: bool = False, latest_vintage_only: bool = True) -> DataFrame:
    """Everything knowable at one decision time: the only read path."""
    df = with_hidden_from(records) if latest_vintage_only else records
    seen = F.col("available_time") <= decision_time
    if ticker:
        seen = seen & (F.col("ticker_at_time") == ticker)
    if not include_quarantined:
        seen = seen & (F.col("validation_status") != "QUARANTINED")
    if latest_vintage_only:
        seen = seen & ~F.coalesce(F.col("hidden_from") <= decision_time, F.lit(False))
    return df.filter(seen).select(*records.columns)


def as_of_many(records: DataFrame, decisions: DataFrame, include_quarantined: bool = False, salts: int = 16) -> DataFrame:
    """``as_of`` for a table of (ticker_at_time, decision_time).

    The revision test is folded into one interval per record first, so each
    decision needs no join of its own; hot tickers are salted.
    """
    df = with_hidden_from(records)
    if not include_quarantined:
        df = df.filter(F.col("validation_status") != "QUARANTINED")
    pairs = salted_join(df, decisions, "ticker_at_time", "record_id", salts)
    return pairs.filter(
        (F.col("available_time") <= F.col("decision_time"))
        & ~F.coalesce(F.col("hidden_from") <= F.col("decision_time"), F.lit(False))
    )


def unresolved() -> Column:
    c = F.col("lineage_cluster_id")
    return c.isNull() | F.upper(c).startswith("UNKNOWN")


def independent_events(visible: DataFrame, keys: list[str]) -> DataFrame:
    """Distinct lineage clusters per key; counting clusters first keeps copies of
    one story from crowding a task. A missing cluster counts as one value."""
    clusters = visible.groupBy(*keys, "lineage_cluster_id").agg(F.count("*").alias("n"))
    return clusters.groupBy(*keys).agg(F.count("*").alias("independent_events"), F.sum("n").alias("records"))


def independent_events_conservative(visible: DataFrame, keys: list[str]) -> DataFrame:
    """Confirmed clusters, unresolved records and the optimistic upper bound."""
    clusters = visible.groupBy(*keys, "lineage_cluster_id").agg(F.count("*").alias("n"))
    return (
        clusters.groupBy(*keys)
        .agg(
            F.count_if(~unresolved()).alias("confirmed_independent_events"),
            F.coalesce(F.sum(F.when(unresolved(), F.col("n"))), F.lit(0)).alias("unresolved_count"),
        )
        .withColumn("optimistic_upper_bound", F.col("confirmed_independent_events") + F.col("unresolved_count"))
    )


COUNTS = ("records", "independent_events", "confirmed_independent_events", "unresolved_count")


def visibility_steps(records: DataFrame, include_quarantined: bool = False, bucket_seconds: int = 86400) -> DataFrame:
    """(ticker_at_time, changed_at) with what is visible from then on: records, clusters, confirmed clusters, unresolved records.

    A record adds one when it becomes available and takes it away when a revision
    hides it. Within a cluster these steps run to the number of its visible
    records; where that leaves or meets zero, the cluster itself appears or goes.
    Steps of one instant are added up first, and running sums are cut by time, so
    neither a story with many copies nor a hot ticker is one task.
    """
    df = with_hidden_from(records)
    if not include_quarantined:
        df = df.filter(F.col("validation_status") != "QUARANTINED")
    df = df.filter(F.col("hidden_from").isNull() | (F.col("hidden_from") > F.col("available_time")))
    step = lambda when, n: F.struct(F.col(when).alias("changed_at"), F.lit(n).cast("long").alias("d"))
    story = F.coalesce("lineage_cluster_id", F.lit("\u0000"))  # records without a cluster count as one
    steps = df.select("ticker_at_time", story.alias("_story"), unresolved().alias("_unresolved"), F.explode(F.array(step("available_time", 1), step("hidden_from", -1))).alias("s"))
    steps = steps.select("ticker_at_time", "_story", "_unresolved", "s.*").filter(F.col("changed_at").isNotNull() & F.col("ticker_at_time").isNotNull())
    at_once = steps.groupBy("ticker_at_time", "_story", "_unresolved", "changed_at").agg(F.sum("d").alias("d"))
    bucket = F.floor(F.unix_micros("changed_at") / F.lit(bucket_seconds * 1_000_000))
    run = running_sums(at_once, ["ticker_at_time", "_story"], bucket, ["changed_at"], {"held": F.col("d")})
    before = F.col("held") - F.col("d")
    appears = F.when((F.col("held") > 0) & (before == 0), 1).when((F.col("held") == 0) & (before > 0), -1).otherwise(0)
    zero = F.lit(0).cast("long")
    changes = {
        "records": F.col("d"), "independent_events": F.col("_appears"),
        "confirmed_independent_events": F.when(F.col("_unresolved"), zero).otherwise(F.col("_appears")), "unresolved_count": F.when(F.col("_unresolved"), F.col("d")).otherwise(zero),
    }
    per_ticker = run.withColumn("_appears", appears.cast("long")).groupBy("ticker_at_time", "changed_at").agg(*[F.sum(c).alias(f"d_{n}") for n, c in changes.items()])
    return running_sums(per_ticker, ["ticker_at_time"], bucket, ["changed_at"], {n: F.col(f"d_{n}") for n in COUNTS}).select("ticker_at_time", "changed_at", *COUNTS)


def visibility_counts(records: DataFrame, decisions: DataFrame, include_quarantined: bool = False, bucket_seconds: int = 86400) -> DataFrame:
    """Per decision (ticker_at_time, decision_time) that sees something: ``COUNTS`` and the optimistic upper bound.

    Equals counting the rows of ``as_of_many`` without making a record x decision pair.
    """
    steps = visibility_steps(records, include_quarantined, bucket_seconds)
    asked = decisions.select("ticker_at_time", "decision_time").distinct()
    seen = asof_backward(asked, steps, "ticker_at_time", "decision_time", "changed_at", list(COUNTS), bucket_seconds=bucket_seconds).filter(F.col("records") > 0)
    return seen.withColumn("optimistic_upper_bound", F.col("confirmed_independent_events") + F.col("unresolved_count"))


def lineage_breakdown(visible: DataFrame, keys: list[str]) -> DataFrame:
    """Cluster membership, one row per record with its cluster's size.

    Long form on purpose: a cluster of copies can be arbitrarily large, so it is
    never gathered into one array.
    """
    sizes = visible.groupBy(*keys, "lineage_cluster_id").agg(F.count("*").alias("cluster_size"), F.min("record_id").alias("first_record_id"))
    match = [F.col(f"v.{k}").eqNullSafe(F.col(f"s.{k}")) for k in [*keys, "lineage_cluster_id"]]
    cond = match[0]
    for m in match[1:]:
        cond = cond & m
    return visible.alias("v").join(sizes.alias("s"), cond).select(*[F.col(f"v.{k}") for k in keys], "v.lineage_cluster_id", "v.record_id", "s.cluster_size", "s.first_record_id")


def future_features(features: DataFrame, keys: list[str], feature_time: str, decision_time: str) -> DataFrame:
    """Per key: how many feature times postdate the decision, and the earliest."""
    return features.filter(F.col(feature_time) > F.col(decision_time)).groupBy(*keys).agg(
        F.count("*").alias("violations"), F.min(feature_time).alias("first_offender")
    )


def bars_as_known(vintages: DataFrame, cutoff: Column) -> DataFrame:
    """Per (ticker, date) the latest-available vintage at ``cutoff``, with faults.

    Faults: availability before the event, market date and event disagree, or
    two vintages with one availability time and different content.
    """
    from ..functions.clock import market_date

    body = F.xxhash64("close", "event_time")
    seen = vintages.filter(F.col("available_time") <= cutoff)
    # Two-step: vintages of one availability collapse first, then the latest wins.
    per_time = seen.groupBy("ticker", "date", "available_time").agg(
        (F.min(body) != F.max(body)).alias("conflict"),
        F.min_by("close", "vintage").alias("close"), F.min_by("event_time", "vintage").alias("event_time"), F.min("vintage").alias("vintage"),
    )
    latest = per_time.groupBy("ticker", "date").agg(
        F.max_by(F.struct("close", "event_time", "vintage"), "available_time").alias("b"),
        F.max("available_time").alias("available_time"), F.bool_or("conflict").alias("conflict"),
    )
    fault = (
        F.when(F.col("available_time") < F.col("b.event_time"), "AVAILABLE_BEFORE_EVENT")
        .when(market_date("b.event_time") != F.col("date"), "DATE_EVENT_DISAGREE")
        .when(F.col("conflict"), "CONFLICTING_VINTAGES")
    )
    return latest.select("ticker", "date", "b.close", "b.vintage", "available_time", fault.alias("fault"))


def usable_contracts(specs: DataFrame) -> DataFrame:
    """Standard 100-share contracts with ``usable_from``: when they were both known and listed."""
    ok = (
        F.col("standard_contract") & (F.col("premium_multiplier") == 100) & (F.col("deliverable_shares") == 100)
        & F.col("spec_source").isNotNull()
    )
    return specs.filter(ok).withColumn("usable_from", F.greatest("known_utc", "listed_utc"))


def known_contracts(specs: DataFrame, decisions: DataFrame) -> DataFrame:
    """Standard 100-share contracts both known and listed by each decision, one row per pair."""
    pairs = salted_join(usable_contracts(specs), decisions, "underlying", "contract_id")
    return pairs.filter(F.col("usable_from") <= F.col("decision_utc"))


def known_contract_counts(specs: DataFrame, decisions: DataFrame, bucket_seconds: int = 86400 * 30) -> DataFrame:
    """(underlying, decision_utc, contracts, first_usable) of decisions that know a contract, by running counts and an as-of read."""
    usable = usable_contracts(specs).filter(F.col("usable_from").isNotNull())
    steps = usable.groupBy("underlying", "usable_from").agg(F.count("*").alias("n"))
    bucket = F.floor(F.unix_micros("usable_from") / F.lit(bucket_seconds * 1_000_000))
    run = running_sums(steps, ["underlying"], bucket, ["usable_from"], {"contracts": F.col("n")})
    first = steps.groupBy("underlying").agg(F.min("usable_from").alias("first_usable"))
    asked = decisions.select("underlying", "decision_utc").distinct()
    seen = asof_backward(asked, run.join(first, "underlying"), "underlying", "decision_utc", "usable_from", ["contracts", "first_usable"], bucket_seconds=bucket_seconds)
    return seen.filter(F.col("contracts").isNotNull())


def precondition_reason(decision_utc: str = "decision_utc", snapshot: str = "snapshot_utc") -> Column:
    """Why a decision may not run, in priority order; null when it may."""
    from ..functions.clock import market_date

    day = market_date(decision_utc)
    return (
        F.when(F.weekday(day) >= 5, "market closed: decision date is a weekend")
        .when(F.col(snapshot).isNull(), "no option chain snapshot")
        .when(F.col(snapshot) > F.col(decision_utc), "option chain was captured after the decision cutoff")
        .when(market_date(snapshot) != day, "option chain is stale")
    )
