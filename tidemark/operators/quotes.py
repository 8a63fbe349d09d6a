"""Quote validation, identity, marketable fills and displayed-size allocation.

The column functions serve batch and streaming alike.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from ..functions.canonical import digest
from ..functions.guards import is_finite
from .asof import asof_backward
from .running import running_sums

# Feeds whose quotes may be traded against.
EXECUTABLE_FEEDS = ("OPRA", "NBBO", "CONSOLIDATED")
MAX_AGE_SECONDS = 60
LATENCY_SECONDS = 1
WINDOW_SECONDS = 60
#: Windows of an order search that one cell of time spans.
CELL_WINDOWS = 32
IDENTITY = ("contract_id", "source", "feed_type", "bid", "ask", "bid_size", "ask_size", "bid_utc", "ask_utc", "observed_utc")


def _seconds(n: float) -> Column:
    return F.expr(f"INTERVAL '{n}' SECOND")


def side_times() -> tuple[Column, Column]:
    return F.coalesce("bid_utc", "observed_utc"), F.coalesce("ask_utc", "observed_utc")


def quote_reject_reason(decision: str | Column, max_age_seconds: int = MAX_AGE_SECONDS) -> Column:
    """First reason a quote may not be used at ``decision``; null when eligible."""
    t = F.col(decision) if isinstance(decision, str) else decision
    bid_t, ask_t = side_times()
    obs, avail = F.col("observed_utc"), F.col("available_utc")
    numbers_ok = is_finite("bid") & is_finite("ask") & (F.col("bid") >= 0) & (F.col("ask") >= 0)
    oldest, newest = F.least(obs, bid_t, ask_t), F.greatest(obs, bid_t, ask_t)
    return (
        F.when(~numbers_ok | obs.isNull() | avail.isNull() | t.isNull(), "malformed_quote")
        .when((F.coalesce("contract_id", F.lit("")) == "") | (F.coalesce("source", F.lit("")) == ""), "missing_contract_or_source")
        .when(avail < newest, "impossible_availability")
        .when(F.greatest(newest, avail) > t, "lookahead_quote")
        .when(oldest < t - _seconds(max_age_seconds), "stale_quote")
        .when((F.col("ask") <= 0) | (F.col("bid") > F.col("ask")), "crossed_or_invalid_market")
        .when(~F.coalesce(F.col("feed_type").isin(*EXECUTABLE_FEEDS), F.lit(False)) | F.coalesce("delayed", F.lit(True)), "non_executable_feed_type")
        .when(F.coalesce("size_units", F.lit("")) != "CONTRACTS", "unverified_size_units")
        .when(F.col("bid_size").isNull() | F.col("ask_size").isNull() | (F.col("bid_size") < 0) | (F.col("ask_size") < 0), "malformed_quote")
    )


def quote_identity() -> Column:
    """Hash of the book without its receipt time: the same book read twice is one."""
    return digest(**{c: F.col(c) for c in IDENTITY})


def distinct_books(quotes: DataFrame) -> DataFrame:
    """First receipt of each book, with how often it was received."""
    return quotes.withColumn("quote_id", quote_identity()).groupBy("quote_id").agg(
        F.min("available_utc").alias("first_available"), F.min_by("contract_id", "available_utc").alias("contract_id"), F.count("*").alias("receipts")
    )


def latest_known_quotes(decisions: DataFrame, quotes: DataFrame, decision_time: str, payload: list[str], tie: str, bucket_seconds: int = 86400) -> DataFrame:
    """Per decision, the newest observation among quotes received by then."""
    sane = quotes.filter(F.col("observed_utc") <= F.col("available_utc"))
    return asof_backward(
        decisions, sane, "contract_id", decision_time, "available_utc", payload, bucket_seconds=bucket_seconds,
        best_by=["observed_utc", "available_utc", tie],
    )


def fill_columns(execution: str | Column, max_age_seconds: int = MAX_AGE_SECONDS, latency_seconds: int = LATENCY_SECONDS, consumed: Column | None = None) -> dict[str, Column]:
    """Outcome of a marketable limit order against the quote on the same row.

    Reads side, limit_price, quantity, submitted_utc and the quote columns.
    Order problems come first, then the quote's own reasons, then timing,
    marketability and displayed size.
    """
    ex = F.col(execution) if isinstance(execution, str) else execution
    used = consumed if consumed is not None else F.lit(0)
    buy = F.col("side") == "BUY"
    bid_t, ask_t = side_times()
    price = F.when(buy, F.col("ask")).otherwise(F.col("bid"))
    shown = F.greatest(F.lit(0), F.when(buy, F.col("ask_size")).otherwise(F.col("bid_size")) - used)
    qty = F.least("quantity", shown)
    bad_order = (
        ~F.coalesce(F.col("side").isin("BUY", "SELL"), F.lit(False)) | ~F.coalesce(is_finite("limit_price") & (F.col("limit_price") > 0), F.lit(False))
        | ~F.coalesce(F.col("quantity") >= 1, F.lit(False)) | ~F.coalesce(ex >= F.col("submitted_utc"), F.lit(False))
    )
    reason = (
        F.when(bad_order, "invalid_order")
        .when(quote_reject_reason(ex, max_age_seconds).isNotNull(), quote_reject_reason(ex, max_age_seconds))
        .when(F.when(buy, ask_t).otherwise(bid_t) < F.col("submitted_utc") + _seconds(latency_seconds), "no_post_submission_quote")
        .when((price <= 0) | (buy & (price > F.col("limit_price"))) | (~buy & (price < F.col("limit_price"))), "not_marketable")
        .when(qty <= 0, "insufficient_displayed_size")
    )
    status = F.when(reason.isNotNull(), "NO_FILL").when(qty == F.col("quantity"), "FILLED").otherwise("PARTIAL_FILL")
    return {
        "status": status, "reason": reason, "fill_quantity": F.when(reason.isNull(), qty), "fill_price": F.when(reason.isNull(), price),
    }


def _first_at_most(level: np.ndarray, start: np.ndarray, bound: np.ndarray, steps: int = 12) -> np.ndarray:
    """Per query the first place from ``start`` on where ``level`` is at most ``bound``; its length where there is none.

    Minima over runs of 1, 2, 4, ... values let a query skip a whole run at once.
    """
    n, runs = len(level), [level]
    while len(runs) < steps and 2 ** len(runs) <= n:
        half = 2 ** (len(runs) - 1)
        runs.append(np.minimum(runs[-1][:-half], runs[-1][half:]))
    at, top = start.copy(), len(runs) - 1
    for k in reversed(range(len(runs))):
        live = np.arange(len(at))
        while len(live):
            live = live[at[live] + 2**k <= n]
            live = live[runs[k][at[live]] > bound[live]]
            at[live] += 2**k
            if k < top:  # less than twice this run is left
                break
    return at


def _fills_in_cell(o: pd.DataFrame, q: pd.DataFrame, latency: int) -> pd.DataFrame:
    """First whole fill of each order of one cell; times are microseconds, quotes usable at receipt."""
    names = ["key", "available", "observed", "tie", "fill_price"]
    parts = []
    for side, sign, price, size, at in (("BUY", 1.0, "ask", "ask_size", "ask_at"), ("SELL", -1.0, "bid", "bid_size", "bid_at")):
        mine = o[(o["side"] == side).to_numpy()]
        book = q[(q[price] > 0).to_numpy()].sort_values(["available", "observed", "tie", price], na_position="first")
        if not len(mine) or not len(book):
            continue
        seen, shown, level, deep = (book[c].to_numpy() for c in ("available", at, price, size))
        since, until, limit = (mine[c].to_numpy() for c in ("submitted", "until", "limit_price"))
        level, limit, hit = sign * level, sign * limit, np.full(len(mine), -1)
        # Orders that the same quotes are large enough for are searched together.
        sizes = np.unique(deep)
        group = np.searchsorted(sizes, mine["quantity"].to_numpy())
        for g in np.unique(group[group < len(sizes)]):
            rows, row = np.flatnonzero(group == g), np.flatnonzero(deep >= sizes[g])
            times, values = seen[row], level[row]
            place, stop = np.searchsorted(times, since[rows], side="right"), np.searchsorted(times, until[rows], side="left")
            live = np.flatnonzero(place < stop)
            while len(live):
                place[live] = _first_at_most(values, place[live], limit[rows[live]])
                live = live[place[live] < stop[live]]
                good = shown[row[place[live]]] >= since[rows[live]] + latency
                hit[rows[live[good]]] = row[place[live[good]]]
                live = live[~good]
                place[live] += 1
                live = live[place[live] < stop[live]]
        found = np.flatnonzero(hit >= 0)
        chosen = book.iloc[hit[found]]
        parts.append(pd.DataFrame(dict(zip(names, (mine["key"].to_numpy()[found], *(chosen[c].to_numpy() for c in (*names[1:4], price)))))))
    return pd.concat(parts, ignore_index=True) if parts else pd.DataFrame({c: [] for c in names})


def whole_fills(orders: DataFrame, usable: DataFrame, tolerance_seconds: int = WINDOW_SECONDS, key: str = "order_id", end: str | None = "session_close", tie: str = "quote_no", latency_seconds: int = LATENCY_SECONDS) -> DataFrame:
    """(key, available_utc, observed_utc, tie, fill_price): the first of the usable quotes that fills an order whole.

    Contracts are cut into cells of time, 32 windows wide; a quote goes to its
    own cell and, near the start, to the one before. A cell's task searches its
    quotes with minima over runs of them, so orders x quotes pairs are never made
    and the work per order grows with the logarithm of the quotes in a cell. A
    task holds one cell of one contract.
    """
    width = tolerance_seconds * 1_000_000
    cell = F.lit(CELL_WINDOWS * width)
    at = lambda c: F.unix_micros(F.col(c) if isinstance(c, str) else c)
    bid_t, ask_t = side_times()
    until = at("submitted_utc") + width
    if end:
        until = F.least(until, at(end))
    fit = F.col("side").isin("BUY", "SELL") & is_finite("limit_price") & (F.col("limit_price") > 0) & (F.col("quantity") >= 1)
    o = orders.filter(F.coalesce(fit, F.lit(False)) & F.col("submitted_utc").isNotNull()).select(
        "contract_id", F.floor(at("submitted_utc") / cell).alias("cell"), F.col(key).alias("key"), "side", F.col("quantity").cast("long").alias("quantity"),
        F.col("limit_price").cast("double").alias("limit_price"), at("submitted_utc").alias("submitted"), until.alias("until"),
    )
    seen = at("available_utc")
    q = usable.select(
        "contract_id", F.explode(F.array_distinct(F.array(F.floor(seen / cell), F.floor((seen - width) / cell)))).alias("cell"), seen.alias("available"), at("observed_utc").alias("observed"),
        F.col(tie).alias("tie"), *[F.col(c).cast("double").alias(c) for c in ("bid", "ask")], *[F.col(c).cast("long").alias(c) for c in ("bid_size", "ask_size")],
        at(bid_t).alias("bid_at"), at(ask_t).alias("ask_at"),
    )
    latency = latency_seconds * 1_000_000
    kinds = [df.schema[c].dataType.simpleString() for df, c in ((orders, key), (usable, tie))]
    found = o.groupBy("contract_id", "cell").cogroup(q.groupBy("contract_id", "cell")).applyInPandas(
        lambda left, right: _fills_in_cell(left, right, latency), f"key {kinds[0]}, available long, observed long, tie {kinds[1]}, fill_price double"
    )
    return found.select(F.col("key").alias(key), F.timestamp_micros("available").alias("available_utc"), F.timestamp_micros("observed").alias("observed_utc"), F.col("tie").alias(tie), "fill_price")


def first_fills(orders: DataFrame, quotes: DataFrame, tolerance_seconds: int = WINDOW_SECONDS, key: str = "order_id", end: str | None = "session_close", tie: str = "quote_no") -> DataFrame:
    """First quote in the window after submission that fills each order whole."""
    usable = quotes.filter(quote_reject_reason("available_utc").isNull())
    found = whole_fills(orders, usable, tolerance_seconds, key, end, tie)
    best = found.groupBy(key).agg(F.min(F.struct("available_utc", "observed_utc", tie, "fill_price")).alias("f"))
    out = orders.join(best, key, "left")
    return out.select(
        *orders.columns, F.when(F.col("f").isNotNull(), "FILLED").otherwise("NO_FILL").alias("fill_status"),
        F.col("f.available_utc").alias("fill_utc"), F.col(f"f.{tie}").alias("fill_quote"), F.col("f.fill_price").alias("fill_price"),
    )


def allocate_displayed_size(claims: DataFrame, keys: list[str], order: list[str], bucket: Column, size: str = "size", quantity: str = "quantity") -> DataFrame:
    """Orders on one side of one quote consume its size in submission order."""
    run = running_sums(claims, keys, bucket, order, {"_upto": F.col(quantity)})
    prior = F.col("_upto") - F.col(quantity)
    return run.withColumn("allocated", F.least(F.col(quantity), F.greatest(F.lit(0), F.col(size) - prior))).drop("_upto")


def conflicting_versions(quotes: DataFrame) -> DataFrame:
    """Quote keys seen with different contents at the same two clocks."""
    h = F.xxhash64(*[F.col(c) for c in IDENTITY])
    return quotes.groupBy("contract_id", "observed_utc", "available_utc").agg(
        F.count("*").alias("versions"), (F.min(h) != F.max(h)).alias("conflict")
    ).filter("conflict").drop("conflict")


def contract_spec_faults(specs: DataFrame, identity: tuple[str, ...] = ("underlying", "expiration", "type", "strike")) -> DataFrame:
    """Contract ids used twice, and identities claimed by several contracts."""
    dup = specs.groupBy("contract_id").agg(F.count("*").alias("n")).filter("n > 1").select("contract_id", F.lit("DUPLICATE_CONTRACT").alias("fault"))
    shared = specs.groupBy(*identity).agg(F.count("*").alias("n")).filter("n > 1").select(*identity)
    amb = specs.join(shared, list(identity), "left_semi").select("contract_id", F.lit("AMBIGUOUS_SPECIFICATION").alias("fault"))
    return dup.unionByName(amb)
