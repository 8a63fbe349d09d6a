"""Account events as tables: cash, positions, cost basis, audits."""

from __future__ import annotations

from typing import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.guards import col
from .quotes import quote_reject_reason
from .running import running_max, running_sums

FEE_CENTS, MULTIPLIER = 80, 100
#: Fills of one account that a single task may order.
BUSY_ROWS = 1_000_000
#: Fills by time and number; fills that share both come by content, so that results do not depend on the run.
ORDER = ["at_utc", "fill_no", "quantity", "price"]


def premium_cents(price: str | Column, quantity: str | Column, multiplier: int = MULTIPLIER) -> Column:
    """Integer cents, half up, in exact decimal arithmetic."""
    p = col(price).cast("decimal(18,6)")
    return F.round(p * col(quantity).cast("decimal(12,0)") * F.lit(multiplier * 100), 0).cast("long")


def _amounts(fills: DataFrame, fee_cents: int = FEE_CENTS) -> DataFrame:
    money, fee = premium_cents("price", "quantity"), F.col("quantity") * fee_cents
    return fills.select("*", money.alias("money_cents"), fee.alias("fee_cents"))


def busy_accounts(fills: DataFrame, rows: int = BUSY_ROWS) -> DataFrame | None:
    """Accounts with more than ``rows`` fills, at most one per that many rows; None where there is none."""
    found = fills.groupBy("account").agg(F.count("*").alias("n")).filter(F.col("n") > rows).select("account").collect()
    return fills.sparkSession.createDataFrame(found, fills.select("account").schema) if found else None


def cash_and_quantity(fills: DataFrame, starting_cents: int = 0, fee_cents: int = FEE_CENTS, busy_rows: int = BUSY_ROWS) -> DataFrame:
    """Add money, fee, running account cash and running position quantity.

    Fills: account, contract, fill_no, at_utc, side, quantity, price. One shuffle
    by account serves both running sums. Only accounts with more than
    ``busy_rows`` fills are cut into time slices; sums are integers, so their
    order does not matter.
    """
    buy = F.col("side") == "BUY"
    df = _amounts(fills, fee_cents).select(
        "*", F.when(buy, -(F.col("money_cents") + F.col("fee_cents"))).otherwise(F.col("money_cents") - F.col("fee_cents")).alias("cash_delta"),
        F.when(buy, F.col("quantity")).otherwise(-F.col("quantity")).alias("signed_qty"),
    )
    cash, position = F.coalesce(F.col("cash_cents"), F.lit(0)) + F.lit(starting_cents), F.coalesce("position", F.lit(0))

    def whole(rows: DataFrame) -> DataFrame:
        upto = lambda *keys: Window.partitionBy(*keys).orderBy(*ORDER).rowsBetween(Window.unboundedPreceding, 0)
        return rows.repartition("account").select("*", F.sum("cash_delta").over(upto("account")).alias("cash_cents")).select(
            "*", F.sum("signed_qty").over(upto("account", "contract")).alias("position")
        )

    def sliced(rows: DataFrame) -> DataFrame:
        slice_ = F.floor(F.unix_seconds("at_utc") / F.lit(86400 * 30))
        run = running_sums(rows, ["account"], slice_, ORDER, {"cash_cents": F.col("cash_delta")})
        return running_sums(run, ["account", "contract"], slice_, ORDER, {"position": F.col("signed_qty")})

    busy = busy_accounts(fills, busy_rows)
    out = whole(df) if busy is None else whole(df.join(busy, "account", "left_anti")).unionByName(sliced(df.join(busy, "account", "left_semi")))
    return out.withColumns({"cash_cents": cash, "position": position})


def round_trips(fills: DataFrame) -> DataFrame:
    """Add ``trip``: how often the position was flat before this fill.

    Cost basis resets at every flat point, so trips are independent and a busy
    account splits into them.
    """
    slice_ = F.floor(F.unix_seconds("at_utc") / F.lit(86400 * 30))
    flat = (F.col("position") == 0).cast("long")
    run = running_sums(fills, ["account", "contract"], slice_, ORDER, {"_flats": flat})
    return run.withColumn("trip", F.col("_flats") - flat).drop("_flats")


def with_trips(fills: DataFrame, fee_cents: int = FEE_CENTS, busy_rows: int = BUSY_ROWS) -> DataFrame:
    """Fills with money, fee and ``trip``, for the cost basis.

    The basis starts anew at every flat point by itself, so the fills of one
    account and contract stay together as trip 0; only accounts with more than
    ``busy_rows`` fills are cut into their round trips.
    """
    cols = ["account", "contract", "fill_no", "at_utc", "side", "quantity", "money_cents", "fee_cents", "trip"]
    together = lambda rows: _amounts(rows, fee_cents).withColumn("trip", F.lit(0).cast("long")).select(*cols)
    busy = busy_accounts(fills, busy_rows)
    if busy is None:
        return together(fills)
    cut = round_trips(cash_and_quantity(fills.join(busy, "account", "left_semi"), 0, fee_cents, busy_rows)).select(*cols)
    return together(fills.join(busy, "account", "left_anti")).unionByName(cut)


def realized_pnl(fills: DataFrame) -> DataFrame:
    """Average-cost realized P&L in cents per fill; sells release basis in proportion.

    Rounding each release makes the fold sequential inside one round trip. Rows
    are partitioned by round trip, sorted on disk if need be, and streamed: the
    task keeps only the current trip's quantity and cost, never a whole group.
    A row travels as its order, its side, its quantity and its net cash.
    """
    keys = ["account", "contract", "trip"]
    buy = F.col("side") == "BUY"
    net = F.when(buy, F.col("money_cents") + F.col("fee_cents")).otherwise(F.col("money_cents") - F.col("fee_cents"))
    rows = fills.select(*keys, "at_utc", "fill_no", F.coalesce(buy, F.lit(False)).alias("buy"), "quantity", net.alias("net"))

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        trip, held, cost = None, 0, 0
        for pdf in batches:
            costs, gains = [], []
            for key, bought, q, net in zip(zip(*(pdf[k].tolist() for k in keys)), *(pdf[c].tolist() for c in ("buy", "quantity", "net"))):
                if key != trip:
                    trip, held, cost = key, 0, 0
                gain = 0
                if bought:
                    held, cost = held + q, cost + net
                else:
                    basis = cost if q == held else round(cost * q / held)
                    gain = net - basis
                    held, cost = held - q, cost - basis
                costs.append(cost)
                gains.append(gain)
            yield pdf[["account", "contract", "fill_no"]].assign(cost_cents=costs, realized_cents=gains)

    ordered = rows.repartition(*keys).sortWithinPartitions(*keys, "at_utc", "fill_no", "quantity", "net").drop("at_utc")
    return ordered.mapInPandas(fold, "account long, contract string, fill_no long, cost_cents long, realized_cents long")


def reserved_cash(orders: DataFrame, fee_cents: int = FEE_CENTS) -> DataFrame:
    """Per account: cash held for open buys, open risk, distinct exposures."""
    live = (F.col("side") == "BUY") & (F.col("remaining") > 0)
    need = premium_cents("limit_price", "remaining") + F.col("remaining") * fee_cents
    per_contract = orders.groupBy("account", "contract").agg(
        F.coalesce(F.sum(F.when(live, need)), F.lit(0)).alias("reserved"), F.count_if(live).alias("open_orders")
    )
    return per_contract.groupBy("account").agg(
        F.sum("reserved").alias("reserved_cents"), F.sum("open_orders").alias("open_orders"), F.count_if(F.col("open_orders") > 0).alias("exposures")
    )


def proposal_context(df: DataFrame) -> DataFrame:
    """position_pct, portfolio_heat_pct and cash check for a proposed entry.

    Reads equity_cents, cash_cents, open_risk_cents, entry_price, quantity.
    """
    cost = premium_cents("entry_price", "quantity")
    return df.select(
        "*", cost.alias("proposed_cents"), F.try_divide(cost, F.col("equity_cents")).alias("position_pct"),
        F.try_divide(F.col("open_risk_cents") + cost, F.col("equity_cents")).alias("portfolio_heat_pct"), (F.col("cash_cents") >= cost).alias("cash_sufficient"),
    )


def liquidation_equity(positions: DataFrame, marks: DataFrame, at: Column, max_age_seconds: int = 60) -> DataFrame:
    """Cash plus bid value per account; null when any held mark is not fresh.

    ``marks`` has one latest quote per contract, far fewer rows than positions.
    """
    judged = marks.select("contract_id", "bid", quote_reject_reason(at, max_age_seconds).isNull().alias("fresh"))
    j = positions.join(judged, positions.contract == judged.contract_id, "left")
    value = premium_cents("bid", "quantity")
    return j.groupBy("account").agg(
        F.when(F.bool_and(F.coalesce("fresh", F.lit(False))), F.sum(value) + F.first("cash_cents")).alias("equity_cents"),
        F.count("*").alias("positions"), F.count_if(~F.coalesce("fresh", F.lit(False))).alias("stale_marks"),
    )


def audit_hash_chain(events: DataFrame, chain: str = "chain", stretch: int = 10_000) -> DataFrame:
    """Per event: link to the previous hash, digest of its own content, sequence gap.

    The previous event is the one with seq - 1. A chain is cut into stretches of
    its numbers, and the last number of one is shown to the next as well, so that
    one long chain is ordered in parts and no event is shuffled a second time
    where a chain's events are together already.
    """
    last = F.coalesce(F.pmod(F.col("seq") + 1, F.lit(stretch)) == 0, F.lit(False))
    shown = events.select("*", F.explode(F.when(last, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("_next"))
    shown = shown.withColumn("_part", F.floor(F.col("seq") / F.lit(stretch)) + F.col("_next"))
    w = Window.partitionBy(chain, "_part").orderBy("seq").rangeBetween(-1, -1)
    before = F.when(F.col(chain).isNotNull() & F.col("seq").isNotNull(), F.collect_list(F.struct("event_hash")).over(w))
    j = shown.withColumn("_before", before).filter(F.col("_next") == 0).select("*", F.explode_outer("_before.event_hash").alias("_prev"))
    expected = F.sha2(F.concat_ws("|", F.col("seq").cast("string"), "request", F.coalesce("_prev", F.lit(""))), 256)
    return j.select(
        chain, "seq", (F.coalesce("previous_hash", F.lit("")) == F.coalesce("_prev", F.lit(""))).alias("link_ok"),
        (F.col("event_hash") == expected).alias("digest_ok"), ((F.col("seq") > 1) & F.col("_prev").isNull()).alias("sequence_gap"),
    )


def command_status(events: DataFrame) -> DataFrame:
    """ACCEPTED, DUPLICATE, REUSED_ID or TIME_BACKWARDS per command event.

    Events: account, seq, command_id, at_utc, request. The first use of an id, by
    seq, is the reference; an event may not precede an earlier one in time.
    """
    first = events.groupBy("account", "command_id").agg(F.min(F.struct("seq", "request")).alias("first"))
    j = events.join(first, ["account", "command_id"])
    seen = running_max(j, ["account"], F.floor(F.col("seq") / F.lit(10000)), ["seq"], "at_utc", "latest_before")
    status = (
        F.when((F.col("seq") > F.col("first.seq")) & (F.col("request") == F.col("first.request")), "DUPLICATE")
        .when(F.col("seq") > F.col("first.seq"), "REUSED_ID")
        .when(F.col("at_utc") < F.col("latest_before"), "TIME_BACKWARDS")
        .otherwise("ACCEPTED")
    )
    return seen.select(*events.columns, status.alias("status"))


def day_order_status(at: str | Column, close: str = "session_close", remaining: str = "remaining") -> Column:
    a = col(at)
    return F.when(F.col(remaining) <= 0, "DONE").when(a >= F.col(close), "EXPIRED_DAY_ORDER").otherwise("LIVE")


def build_chain(events: DataFrame, chain: str = "chain") -> DataFrame:
    """Hash-chain short event lists, one list per ``chain`` key."""
    step = F.struct("seq", "request")
    ordered = F.array_sort(F.collect_list(step))
    zero = F.array().cast("array<struct<seq:bigint,request:string,previous_hash:string,event_hash:string>>")

    def link(acc, x):
        prev = F.when(F.size(acc) > 0, F.element_at(acc, -1)["event_hash"]).otherwise("")
        h = F.sha2(F.concat_ws("|", x["seq"].cast("string"), x["request"], prev), 256)
        return F.concat(acc, F.array(F.struct(x["seq"].alias("seq"), x["request"].alias("request"), prev.alias("previous_hash"), h.alias("event_hash"))))

    return events.groupBy(chain).agg(ordered.alias("e")).select(chain, F.explode(F.aggregate("e", zero, link)).alias("x")).select(chain, "x.*")
