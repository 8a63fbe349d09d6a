"""European option pricing with continuous yield, as native column expressions.

Price and Greeks are column expressions. The normal distribution uses Hart's
rational form in double precision, because Spark has no erf; it and the iterative
implied-volatility inversion run as Arrow UDFs over batches. Written as a column
expression, the form made a stage's generated method longer than the 8,000 bytes
that the JVM still compiles, and every row of a chain was interpreted.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T
from pyspark.sql.functions import pandas_udf

from .guards import col, is_finite

# Hart (1968) coefficients for the normal tail, highest power first.
HART_NUMERATOR = (
    3.52624965998911e-02, 0.700383064443688, 6.37396220353165, 33.912866078383,
    112.079291497871, 221.213596169931, 220.206867912376,
)
HART_DENOMINATOR = (
    8.83883476483184e-02, 1.75566716318264, 16.064177579207, 86.7807322029461,
    296.564248779674, 637.333633378831, 793.826512519948, 440.413735824752,
)
HART_SPLIT = 7.07106781186547
ROOT_TWO_PI = math.sqrt(2.0 * math.pi)

MIN_VOL, MAX_VOL = 1e-4, 5.0
TOLERANCE, MAX_STEPS = 1e-6, 200


def _horner(coefficients, x):
    acc = F.lit(coefficients[0])
    for c in coefficients[1:]:
        acc = acc * x + F.lit(c)
    return acc


def upper_tail(a: Column, e: Column) -> Column:
    """Normal mass above ``a`` >= 0, given e = exp(-a*a/2)."""
    near = e * _horner(HART_NUMERATOR, a) / _horner(HART_DENOMINATOR, a)
    tail = a + F.lit(0.65)
    for k in (4.0, 3.0, 2.0, 1.0):
        tail = a + F.lit(k) / tail
    return F.when(a > 37.0, F.lit(0.0)).when(a < HART_SPLIT, near).otherwise(e / tail / F.lit(ROOT_TWO_PI))


def usable_inputs(s, k, t, sigma, r, q) -> Column:
    ok = is_finite(r) & is_finite(q)
    for c in (s, k, t, sigma):
        ok = ok & is_finite(c) & (col(c) > 0)
    return ok


def _horner_np(coefficients, a: np.ndarray) -> np.ndarray:
    acc = coefficients[0] * a + coefficients[1]
    for c in coefficients[2:]:
        acc *= a
        acc += c
    return acc


def _phi_np(x: np.ndarray) -> np.ndarray:
    a = np.abs(x)
    e = np.exp(-0.5 * a * a)
    upper = e * _horner_np(HART_NUMERATOR, a) / _horner_np(HART_DENOMINATOR, a)
    far = np.flatnonzero(a >= HART_SPLIT)
    if len(far):
        beyond = a[far]
        tail = beyond + 0.65
        for k in (4.0, 3.0, 2.0, 1.0):
            tail = beyond + k / tail
        upper[far] = np.where(beyond > 37.0, 0.0, e[far] / tail / ROOT_TWO_PI)
    return np.where(x > 0, 1.0 - upper, upper)


@pandas_udf(T.DoubleType())
def normal_below(x: pd.Series) -> pd.Series:
    """Normal mass below ``x``; null for null."""
    return pd.Series(_phi_np(x.to_numpy(dtype="float64", na_value=np.nan)))


def with_option_model(
    df: DataFrame, s, k, t, r, sigma, q, kind, price: str | None = None, greeks: bool = False
) -> DataFrame:
    """Add the price under ``price`` and, with ``greeks``, delta, gamma,
    theta_per_day, vega and rho. Unusable inputs or an unknown kind give nulls.

    Built as a few projections: each intermediate is used several times, so
    Catalyst keeps the projections apart and every value is computed once.
    """
    base = df.columns
    ok = F.coalesce(usable_inputs(s, k, t, sigma, r, q) & col(kind).isin("CALL", "PUT"), F.lit(False))
    vals = {"_s": s, "_k": k, "_t": t, "_r": r, "_v": sigma, "_q": q}
    x = df.select("*", ok.alias("_ok"), (col(kind) == "CALL").alias("_call"))
    x = x.select("*", *[F.when(F.col("_ok"), col(c)).alias(n) for n, c in vals.items()])
    x = x.select("*", (F.col("_v") * F.sqrt("_t")).alias("_vt"), F.exp(-F.col("_r") * F.col("_t")).alias("_dr"), F.exp(-F.col("_q") * F.col("_t")).alias("_dq"))
    d1 = (F.log(F.col("_s") / F.col("_k")) + (F.col("_r") - F.col("_q") + F.col("_v") * F.col("_v") * 0.5) * F.col("_t")) / F.col("_vt")
    x = x.select("*", d1.alias("_d1"))
    x = x.select("*", (F.col("_d1") - F.col("_vt")).alias("_d2"))
    # Mass below d for a call, below -d for a put: the one each formula needs. The
    # UDF also keeps a later filter on a result from being pushed down as a copy of
    # the whole formula. Filter the input beforehand.
    sign = F.when(F.col("_call"), 1.0).otherwise(-1.0)
    x = x.select("*", F.exp(F.col("_d1") * F.col("_d1") * -0.5).alias("_e1"), sign.alias("_sg"))
    x = x.select("*", normal_below(F.col("_sg") * F.col("_d1")).alias("_n1"), normal_below(F.col("_sg") * F.col("_d2")).alias("_n2"))
    x = x.select("*", (F.col("_s") * F.col("_dq")).alias("_fs"), (F.col("_k") * F.col("_dr")).alias("_fk"), (F.col("_e1") / ROOT_TWO_PI).alias("_pdf"))
    out = []
    if price:
        out.append(F.when(F.col("_ok"), F.col("_sg") * (F.col("_fs") * F.col("_n1") - F.col("_fk") * F.col("_n2"))).alias(price))
    if greeks:
        root_t = F.sqrt("_t")
        decay = -(F.col("_fs") * F.col("_pdf") * F.col("_v")) / (root_t * 2.0)
        carry = F.col("_sg") * (F.col("_q") * F.col("_fs") * F.col("_n1") - F.col("_r") * F.col("_fk") * F.col("_n2"))
        out += [
            (F.col("_sg") * F.col("_dq") * F.col("_n1")).alias("delta"),
            (F.col("_dq") * F.col("_pdf") / (F.col("_s") * F.col("_vt"))).alias("gamma"),
            ((decay + carry) / 365.0).alias("theta_per_day"),
            (F.col("_fs") * F.col("_pdf") * root_t / 100.0).alias("vega"),
            (F.col("_sg") * F.col("_fk") * F.col("_t") * F.col("_n2") / 100.0).alias("rho"),
        ]
    return x.select(*base, *out)


class _Options:
    """Prices of a batch of options at any volatility; what does not depend on it is worked out once."""

    def __init__(self, s, k, t, r, q, sign):
        self.log, self.carry, self.t, self.root, self.sign = np.log(s / k), r - q, t, np.sqrt(t), sign
        self.fs, self.fk = s * np.exp(-q * t), k * np.exp(-r * t)

    def take(self, rows) -> "_Options":
        part = object.__new__(_Options)
        part.__dict__ = {n: a[rows] for n, a in self.__dict__.items()}
        return part

    def d1(self, sigma):
        return (self.log + (self.carry + 0.5 * sigma * sigma) * self.t) / (sigma * self.root)

    def price(self, sigma, d1=None):
        d1 = self.d1(sigma) if d1 is None else d1
        return self.sign * (self.fs * _phi_np(self.sign * d1) - self.fk * _phi_np(self.sign * (d1 - sigma * self.root)))

    def vega(self, d1):
        return self.fs * np.exp(-0.5 * d1 * d1) / ROOT_TWO_PI * self.root


def _near_root(o: _Options, p: np.ndarray, steps: int = 8) -> tuple[np.ndarray, np.ndarray]:
    """Newton's root per option and a lower bound of the price's slope around it; a slope of zero where it is not to be trusted.

    Prices are monotone in volatility. The slope changes by less than half within
    ``reach`` of the root, so a volatility further away than any distance d up to
    ``reach`` misses the price by more than d times half the slope.
    """
    n = len(p)
    root, slope = np.full(n, np.nan), np.zeros(n)
    live = np.arange(n)
    sigma = np.clip(np.sqrt(2.0 * np.abs(np.log(o.fs / o.fk)) / o.t), 0.05, 2.0)
    for _ in range(steps):
        if not len(live):
            break
        x = o.take(live)
        d1 = x.d1(sigma)
        vega, miss = x.vega(d1), x.price(sigma, d1) - p[live]
        good = (np.abs(miss) < 1e-9) & (vega > 1e-3)
        at, v, d = sigma[good], vega[good], d1[good]
        reach = np.minimum(0.02, 0.25 * at / np.maximum(1.0, np.abs(d * (d - at * x.root[good]))))
        root[live[good]], slope[live[good]] = at, np.where(0.5 * v * reach > 4 * TOLERANCE, 0.5 * v, 0.0)
        on = ~good & (vega > 1e-3)
        live, sigma = live[on], np.clip(sigma[on] - miss[on] / vega[on], MIN_VOL, MAX_VOL)
    return root, slope


def _bracketed(p: np.ndarray, s, k, t, r, q, sign) -> tuple[np.ndarray, np.ndarray, _Options]:
    """(places, prices, options) of what has a solution.

    There is none where the price breaks the no-arbitrage bounds, is not bracketed
    on [1e-4, 5], or any input is unusable.
    """
    stack = np.vstack([p, s, k, t, r, q, sign])
    live = np.isfinite(stack).all(axis=0) & (stack[:4] > 0).all(axis=0)
    idx = np.flatnonzero(live)
    p, s, k, t, r, q, sign = (a[idx] for a in stack)
    o = _Options(s, k, t, r, q, sign)
    floor = np.maximum(sign * (o.fs - o.fk), 0.0)
    ceiling = np.where(sign > 0, o.fs, o.fk)
    keep = (floor - TOLERANCE <= p) & (p <= ceiling + TOLERANCE)
    keep &= (o.price(np.full(len(p), MIN_VOL)) - TOLERANCE <= p) & (p <= o.price(np.full(len(p), MAX_VOL)) + TOLERANCE)
    return idx[keep], p[keep], o.take(keep)


def _bisected(p: np.ndarray, o: _Options) -> np.ndarray:
    """Volatility reproducing each bracketed price by bisection over a whole batch.

    Newton's root tells the side of a midpoint that is clearly off the price; only
    midpoints that may be the last one, and options with hardly any slope, are
    priced.
    """
    result, idx = np.full(len(p), np.nan), np.arange(len(p))
    root, slope = _near_root(o, p)
    lo, hi = np.full(len(p), MIN_VOL), np.full(len(p), MAX_VOL)
    for _ in range(MAX_STEPS):
        if not len(idx):
            break
        mid = 0.5 * (lo + hi)
        below, done = mid < root, (hi - lo) < TOLERANCE
        unsure = np.flatnonzero(~(np.abs(mid - root) * slope > 2 * TOLERANCE))
        if len(unsure):
            at_mid = o.take(unsure).price(mid[unsure])
            below[unsure] = at_mid < p[unsure]
            done[unsure] |= np.abs(at_mid - p[unsure]) < TOLERANCE
        result[idx[done]] = mid[done]
        lo, hi = np.where(below, mid, lo), np.where(below, hi, mid)
        if done.any():
            go = ~done
            idx, p, root, slope, lo, hi = (a[go] for a in (idx, p, root, slope, lo, hi))
            o = o.take(go)
    result[idx] = 0.5 * (lo + hi)
    return result


def _solved(p: np.ndarray, s, k, t, r, q, sign) -> np.ndarray:
    """Volatility reproducing each price, NaN where there is none."""
    result = np.full(len(p), np.nan)
    idx, prices, o = _bracketed(p, s, k, t, r, q, sign)
    result[idx] = _bisected(prices, o)
    return result


def _numbers(*columns: pd.Series) -> list[np.ndarray]:
    return [c.to_numpy(dtype="float64", na_value=np.nan) for c in columns]


def _doubles(*names: str) -> T.StructType:
    return T.StructType([T.StructField(n, T.DoubleType()) for n in names])


def _signs(kind: pd.Series) -> np.ndarray:
    return kind.map({"CALL": 1.0, "PUT": -1.0}).to_numpy(dtype="float64", na_value=np.nan)


@pandas_udf(T.DoubleType())
def implied_volatility(
    price: pd.Series, s: pd.Series, k: pd.Series, t: pd.Series, r: pd.Series, q: pd.Series, kind: pd.Series
) -> pd.Series:
    """Volatility reproducing ``price``; null where ``_solved`` has none."""
    result = _solved(*_numbers(price, s, k, t, r, q), _signs(kind))
    return pd.Series(result).where(~np.isnan(result), None)


GREEKS = ("delta", "gamma", "theta_per_day", "vega", "rho")


SOLVED = T.StructType([T.StructField("solvable", T.BooleanType()), *_doubles("iv_solved", *GREEKS)])


@pandas_udf(SOLVED)
def solved_model(
    price: pd.Series, s: pd.Series, k: pd.Series, t: pd.Series, r: pd.Series, q: pd.Series, sign: pd.Series, wanted: pd.Series
) -> pd.DataFrame:
    """Whether some volatility reproduces ``price``; where ``wanted``, that volatility and the Greeks at it, else nulls."""
    inputs = np.vstack(_numbers(price, s, k, t, r, q, sign))
    at, p, o = _bracketed(*inputs)
    solvable = np.zeros(len(price), bool)
    solvable[at] = True
    asked = np.flatnonzero(wanted.to_numpy(dtype=bool, na_value=False)[at])
    at, p, o = at[asked], p[asked], o.take(asked)
    sigma = _bisected(p, o)
    s_, q_, r_, sign_ = inputs[1, at], inputs[5, at], inputs[4, at], o.sign
    d1, vt, dq = o.d1(sigma), sigma * o.root, np.exp(-q_ * o.t)
    n1, n2, pdf = _phi_np(sign_ * d1), _phi_np(sign_ * (d1 - vt)), np.exp(d1 * d1 * -0.5) / ROOT_TWO_PI
    decay = -(o.fs * pdf * sigma) / (o.root * 2.0)
    carry = sign_ * (q_ * o.fs * n1 - r_ * o.fk * n2)
    values = (sigma, sign_ * dq * n1, dq * pdf / (s_ * vt), (decay + carry) / 365.0, o.fs * pdf * o.root / 100.0, sign_ * o.fk * o.t * n2 / 100.0)
    out = {c: np.full(len(price), np.nan) for c in ("iv_solved", *GREEKS)}
    for name, found in zip(out, values):
        out[name][at] = found
    return pd.DataFrame({"solvable": solvable} | out)


def kind_sign(kind: str | Column) -> Column:
    """1 for a call, -1 for a put, else null."""
    return F.when(col(kind) == "CALL", 1.0).when(col(kind) == "PUT", -1.0)


def with_solved_model(df: DataFrame, price: Column, s: Column, k: Column, t: Column, r: Column, q: Column, kind: Column, wanted: Column | None = None) -> DataFrame:
    """Add solvable, and where ``wanted`` (everywhere, by default) iv_solved and the Greeks at it.

    The function is marked as one that may not be repeated, so that a later filter
    on a result stays behind it: Spark would otherwise carry the filter down as
    copies of everything that its columns are made of, which made methods that
    were too long to compile at all.
    """
    wanted = F.lit(True) if wanted is None else wanted
    x = df.withColumn("_model", solved_model.asNondeterministic()(price, s, k, t, r, q, kind_sign(kind), wanted))
    return x.select(*df.columns, *[F.col("_model")[c].alias(c) for c in SOLVED.names])


@pandas_udf(_doubles("bid", "ask", "mid"))
def model_quotes(s: pd.Series, k: pd.Series, t: pd.Series, r: pd.Series, sigma: pd.Series, sign: pd.Series, spread: pd.Series) -> pd.DataFrame:
    """A made-up maker's quotes to the cent, half of ``spread`` on each side of the model price; null unless 0 < bid <= ask."""
    stack = np.vstack(_numbers(s, k, t, sigma, r, spread, sign))
    at = np.flatnonzero(np.isfinite(stack).all(axis=0) & (stack[:4] > 0).all(axis=0))
    s_, k_, t_, v, r_, half, side = stack[:, at]
    half = half / 2
    fair = _Options(s_, k_, t_, r_, np.zeros(len(at)), side).price(v)
    cents = lambda x: np.rint(x * 100.0 + 0.000137) / 100.0 + 0.0
    bid, ask = cents(fair * (1.0 - half)), cents(fair * (half + 1.0) + 0.01)
    good = (bid > 0) & (ask >= bid)
    out = {c: np.full(stack.shape[1], np.nan) for c in ("bid", "ask", "mid")}
    for name, values in zip(out, (bid, ask, np.rint((bid + ask) / 2 * 10000.0) / 10000.0 + 0.0)):
        out[name][at[good]] = values[good]
    return pd.DataFrame(out)


def years_to_expiry(snapshot: str | Column, expiration: str | Column) -> Column:
    """Calendar days over 365; null once expired."""
    days = F.datediff(col(expiration), col(snapshot))
    return F.when(days > 0, days / F.lit(365.0))
