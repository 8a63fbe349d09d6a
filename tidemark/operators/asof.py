"""As-of and interval joins that keep a hot key spread over the cluster."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def asof_backward(
    left: DataFrame, right: DataFrame, key: str, left_time: str, right_time: str,
    payload: list[str], tie_break: list[str] | None = None, strict: bool = False, bucket_seconds: int = 86400,
    best_by: list[str] | None = None,
) -> DataFrame:
    """Latest right row per left row with right_time <= left_time (< if strict).

    Time is cut into buckets. Inside a (key, bucket) one ordered window finds
    the match; for a left row with none in its bucket, the last right row of an
    earlier bucket is carried over from a one-row-per-bucket summary. No task
    ever orders a whole key. Adds the payload columns; no match gives nulls.

    With ``best_by`` the match is not the last row by right_time but, among all
    rows up to left_time, the one greatest in those columns (a second clock).
    """
    bucket = lambda t: F.floor(F.unix_micros(F.col(t).cast("timestamp")) / F.lit(bucket_seconds * 1_000_000))
    ties = tie_break or []
    pay = F.struct(*[F.col(c).alias(f"o{i}") for i, c in enumerate(best_by or [])], *payload)
    l = left.select(F.col(key).alias("_k"), F.col(left_time).cast("timestamp").alias("_t"), bucket(left_time).alias("_b"), F.struct(*left.columns).alias("_left"))
    r = right.filter(F.col(key).isNotNull() & F.col(right_time).isNotNull()).select(
        F.col(key).alias("_k"), F.col(right_time).cast("timestamp").alias("_t"), bucket(right_time).alias("_b"),
        F.struct(*[F.col(c) for c in ties]).alias("_tie") if ties else F.struct(F.lit(0).alias("z")).alias("_tie"), pay.alias("_pay"),
    )
    tie_type, pay_type = r.schema["_tie"].dataType, r.schema["_pay"].dataType
    left_type = l.schema["_left"].dataType
    u = l.select("_k", "_t", "_b", F.lit(not strict).alias("_side"), F.lit(None).cast(tie_type).alias("_tie"), F.lit(None).cast(pay_type).alias("_pay"), "_left").unionByName(
        r.select("_k", "_t", "_b", F.lit(strict).alias("_side"), "_tie", "_pay", F.lit(None).cast(left_type).alias("_left"))
    )
    w = Window.partitionBy("_k", "_b").orderBy("_t", "_side", "_tie").rowsBetween(Window.unboundedPreceding, 0)
    pick = (lambda c: F.max(c)) if best_by else (lambda c: F.last(c, ignorenulls=True))
    local = u.select("*", pick("_pay").over(w).alias("_hit")).filter(F.col("_left").isNotNull())
    summary = F.max("_pay") if best_by else F.max_by("_pay", F.when(F.col("_pay").isNotNull(), F.struct("_t", "_tie")))
    edge = u.groupBy("_k", "_b").agg(summary.alias("_last"))
    before = Window.partitionBy("_k").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    carry = edge.select("_k", "_b", pick("_last").over(before).alias("_carry"))
    chosen = F.greatest("_hit", "_carry") if best_by else F.coalesce("_hit", "_carry")
    out = local.join(carry, ["_k", "_b"], "left").select("_left.*", chosen.alias("_m"))
    return out.select(*left.columns, *[F.col(f"_m.{c}").alias(c) for c in payload])


def forward_candidates(
    left: DataFrame, right: DataFrame, key: str, left_time: str, right_time: str, tolerance_seconds: int, left_end: str | None = None
) -> DataFrame:
    """Pairs with left_time < right_time < min(left_time + tolerance, left_end).

    Buckets are one tolerance wide, so a left row looks into two of them and
    meets only rows near its own time, by equality on (key, bucket).
    """
    width = tolerance_seconds * 1_000_000
    b = F.floor(F.unix_micros(F.col(left_time)) / F.lit(width))
    l = left.withColumn("_b", F.explode(F.array(b, b + 1)))
    r = right.withColumn("_b", F.floor(F.unix_micros(F.col(right_time)) / F.lit(width)))
    end = F.col(left_time) + F.expr(f"INTERVAL '{tolerance_seconds}' SECOND")
    if left_end:
        end = F.least(end, F.col(left_end))
    pairs = l.join(r, [key, "_b"]).filter((F.col(right_time) > F.col(left_time)) & (F.col(right_time) < end))
    return pairs.drop("_b")


def salted_join(big: DataFrame, other: DataFrame, key: str, spread_by: str, salts: int = 16, how: str = "inner") -> DataFrame:
    """Equi-join where one key may hold a large share of ``big``.

    Every key of ``big`` is cut into ``salts`` parts by a stable hash of
    ``spread_by``; ``other`` is repeated once per part.
    """
    a = big.withColumn("_salt", F.pmod(F.xxhash64(spread_by), F.lit(salts)).cast("int"))
    b = other.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return a.join(b, [key, "_salt"], how).drop("_salt")


def containing_session(df: DataFrame, sessions: DataFrame, when: str, known_by: str) -> DataFrame:
    """Each row with the one session that covers ``when``, or why there is none.

    ``sessions``: open_utc, close_utc, available_utc, source. Sessions are cut
    into the UTC dates they touch, so the containment test runs on equal dates.
    """
    days = sessions.select("*", F.explode(F.sequence(F.to_date("open_utc"), F.to_date("close_utc"))).alias("_day"))
    covered = df.withColumn("_row", F.monotonically_increasing_id()) if "row_id" not in df.columns else df.withColumn("_row", F.col("row_id"))
    inside = (F.col(when) >= F.col("open_utc")) & (F.col(when) < F.col("close_utc"))
    hit = F.struct("open_utc", "close_utc", "available_utc", "source")
    joined = covered.withColumn("_day", F.to_date(when)).join(days, "_day", "left")
    rest = [c for c in df.columns]
    per = joined.groupBy("_row", *rest).agg(F.count_if(inside).alias("n_sessions"), F.max(F.when(inside, hit)).alias("s"))
    status = (
        F.when(F.col("n_sessions") != 1, "NOT_ONE_SESSION")
        .when(F.col("s.source").isNull() | (F.col("s.available_utc") > F.col(known_by)), "SCHEDULE_NOT_KNOWN")
        .otherwise("OK")
    )
    return per.select(*rest, "n_sessions", F.col("s.open_utc").alias("session_open"), F.col("s.close_utc").alias("session_close"), status.alias("session_status"))


def exact_once(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """First row per key in ``order``, by a min over a struct: combines before the shuffle."""
    rest = [c for c in df.columns if c not in keys]
    packed = F.struct(*[o.alias(f"_o{i}") for i, o in enumerate(order)], F.struct(*rest).alias("_rest"))
    return df.groupBy(*keys).agg(F.min(packed).alias("_p")).select(*keys, "_p._rest.*")
