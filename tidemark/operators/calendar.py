"""Session calendar taken from the bars, and splits counted in sessions.

Calendars and splits are bounded by the number of trading days that exist (a
few thousand rows per decade), so ordering them in one task and broadcasting
them is safe at any data volume.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.guards import col

TRAIN, TEST, HORIZON, EMBARGO = 180, 30, 5, 2


def trading_calendar(bars: DataFrame, date: str = "date") -> DataFrame:
    """(session_date, session_idx) over every ticker's bars, indexed from 0."""
    days = bars.select(F.col(date).alias("session_date")).filter(F.col("session_date").isNotNull()).distinct()
    return days.select("session_date", (F.row_number().over(Window.orderBy("session_date")) - 1).cast("long").alias("session_idx"))


def session_index(df: DataFrame, calendar: DataFrame, date: str) -> DataFrame:
    """Exact session lookup; a day that was no session is flagged, never guessed."""
    return df.join(F.broadcast(calendar), F.col(date) == F.col("session_date"), "left").select(
        *df.columns, "session_idx", F.col("session_idx").isNull().alias("not_a_session")
    )


def calendar_position(calendar: DataFrame) -> DataFrame:
    """For every calendar day in range: sessions before it, and up to it.

    Turns the open-interval session count into two lookups and a subtraction.
    """
    span = calendar.agg(F.min("session_date").alias("lo"), F.max("session_date").alias("hi"))
    days = span.select(F.explode(F.sequence("lo", "hi")).alias("day"))
    marked = days.join(F.broadcast(calendar), F.col("day") == F.col("session_date"), "left")
    w = Window.orderBy("day").rowsBetween(Window.unboundedPreceding, 0)
    upto = F.count("session_date").over(w)
    return marked.select("day", (upto - F.col("session_date").isNotNull().cast("int")).alias("before"), upto.alias("upto"))


def sessions_between(df: DataFrame, calendar: DataFrame, start: str, end: str, name: str = "gap_sessions") -> DataFrame:
    """Sessions strictly inside (start, end); days outside the range clamp to its ends.

    An inverted interval, or one that is a single session, counts zero or less: callers test the order first.
    """
    pos = calendar_position(calendar)
    n = calendar.agg(F.count("*")).scalar()
    first = calendar.agg(F.min("session_date")).scalar()
    last = calendar.agg(F.max("session_date")).scalar()
    a = F.broadcast(pos.select(F.col("day").alias(start), F.col("upto").alias("_upto_start")))
    b = F.broadcast(pos.select(F.col("day").alias(end), F.col("before").alias("_before_end")))
    joined = df.join(a, start, "left").join(b, end, "left")
    upto = F.when(F.col(start) < first, F.lit(0)).when(F.col(start) > last, n).otherwise(F.col("_upto_start"))
    before = F.when(F.col(end) < first, F.lit(0)).when(F.col(end) > last, n).otherwise(F.col("_before_end"))
    return joined.select(*df.columns, (before - upto).cast("long").alias(name))


def spans(df: DataFrame, calendar: DataFrame, start: str, end: str, name: str = "in_calendar") -> DataFrame:
    first = calendar.agg(F.min("session_date")).scalar()
    last = calendar.agg(F.max("session_date")).scalar()
    return df.select("*", ((F.col(start) >= first) & (F.col(end) <= last)).alias(name))


def make_splits(calendar: DataFrame, train: int = TRAIN, test: int = TEST, horizon: int = HORIZON, embargo: int = EMBARGO) -> DataFrame:
    """Rolling-origin splits in index space, in closed form.

    Fold i trains on ``train`` sessions from ``i * (test + embargo)``, skips
    ``horizon`` purged sessions and tests on the next ``test``.
    """
    if train < 1 or test < 1 or horizon < 0 or embargo < 0:
        raise ValueError("window sizes must be positive; horizon and embargo non-negative")
    step, need = test + embargo, train + horizon + test
    folds = calendar.agg(F.count("*").alias("n")).filter(F.col("n") >= need).select(
        F.explode(F.sequence(F.lit(0), F.floor((F.col("n") - need) / F.lit(step)).cast("int"))).alias("fold")
    )
    first = F.col("fold") * step
    edges = {
        "train_start": first,
        "train_end": first + (train - 1),
        "test_start": first + (train + horizon),
        "test_end": first + (train + horizon + test - 1),
    }
    out = folds.select(F.col("fold"), *[e.cast("long").alias(f"{n}_idx") for n, e in edges.items()])
    for name in edges:
        day = F.broadcast(calendar.select(F.col("session_idx").alias(f"{name}_idx"), F.col("session_date").alias(name)))
        out = out.join(day, f"{name}_idx")
    return out.select("fold", *edges)


def validate_splits(splits: DataFrame, calendar: DataFrame, horizon: int = HORIZON) -> DataFrame:
    """Each split with the first violated rule, or OK."""
    checked = spans(sessions_between(splits, calendar, "train_end", "test_start"), calendar, "train_end", "test_start")
    verdict = (
        F.when(F.col("train_end") >= F.col("test_start"), "OVERLAP")
        .when(F.col("test_end") <= F.col("test_start"), "EMPTY_TEST")
        .when(~F.col("in_calendar"), "OUTSIDE_CALENDAR")
        .when(F.col("gap_sessions") < horizon, "PURGE_TOO_SHORT")
        .otherwise("OK")
    )
    return checked.select(*splits.columns, "gap_sessions", verdict.alias("verdict"))


def fold_dates(calendar: DataFrame, splits: DataFrame) -> DataFrame:
    """(fold, role, decision_date) for every session inside a window.

    The session table is small, so the range match happens here once and the
    observations join it on plain date equality.
    """
    roles = splits.select(
        "fold",
        F.explode(
            F.array(
                F.struct(F.lit("train").alias("role"), F.col("train_start").alias("lo"), F.col("train_end").alias("hi")),
                F.struct(F.lit("test").alias("role"), F.col("test_start").alias("lo"), F.col("test_end").alias("hi")),
            )
        ).alias("r"),
    ).select("fold", "r.*")
    # A window covers every calendar day between two dates, so exploding days is bounded and exact.
    return (
        roles.select("fold", "role", F.explode(F.sequence("lo", "hi")).alias("decision_date"))
        .join(F.broadcast(calendar.select(F.col("session_date").alias("decision_date"))), "decision_date", "left_semi")
        .select("fold", "role", "decision_date")
    )


def complete_folds(rows: DataFrame) -> DataFrame:
    """Fold ids with both halves present, from rows carrying (fold, role)."""
    return (
        rows.groupBy("fold")
        .agg(F.count_if(F.col("role") == "train").alias("n_train"), F.count_if(F.col("role") == "test").alias("n_test"))
        .filter((F.col("n_train") > 0) & (F.col("n_test") > 0))
    )


def assign_folds(observations: DataFrame, calendar: DataFrame, splits: DataFrame) -> DataFrame:
    """Observations by fold and role; purged rows match neither, half folds drop."""
    tagged = observations.join(F.broadcast(fold_dates(calendar, splits)), "decision_date")
    whole = complete_folds(tagged).select("fold")
    return tagged.join(F.broadcast(whole), "fold", "left_semi")


def fold_chronology(rows: DataFrame, calendar: DataFrame | None, horizon: int = HORIZON, time: str = "decision_date") -> DataFrame:
    """Per fold: last train, first test, sessions between, and the verdict."""
    edges = rows.groupBy("fold").agg(
        F.max(F.when(F.col("role") == "train", F.col(time))).alias("last_train"),
        F.min(F.when(F.col("role") == "test", F.col(time))).alias("first_test"),
    )
    if calendar is None:
        refused = F.when(F.col("last_train") >= F.col("first_test"), "NOT_CHRONOLOGICAL").otherwise("NO_CALENDAR")
        return edges.select("*", F.lit(None).cast("long").alias("gap_sessions"), refused.alias("verdict"))
    gap = sessions_between(edges, calendar, "last_train", "first_test")
    verdict = (
        F.when(F.col("last_train") >= F.col("first_test"), "NOT_CHRONOLOGICAL")
        .when(F.col("gap_sessions") < horizon, "PURGE_TOO_SHORT")
        .otherwise("OK")
    )
    return gap.select("*", verdict.alias("verdict"))


def add_weekdays(date: str | Column, n: int) -> Column:
    """The n-th weekday strictly after ``date``; holidays are not known here."""
    reach = 2 * n + 7
    days = F.sequence(F.date_add(col(date), 1), F.date_add(col(date), reach))
    return F.element_at(F.filter(days, lambda d: F.weekday(d) < 5), n)
