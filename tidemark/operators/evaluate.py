"""Walk-forward evaluation with a refit, date-block-permuted noise floor.

Permutation 0 is the real labelling, 1..N are shuffles, and one plan fits and
scores all of them. A shuffle moves whole dates in blocks. The study packs a
row's labels under all permutations into bits (``label_matrix``); learners that
need rows get one row per permutation (``permute_labels``).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.guards import rounded
from ..session import materialize, spread
from .calendar import assign_folds
from .features import COMPONENTS, weighted_columns
from .running import running_sums

PERMUTATIONS, SEED, BLOCK = 200, 7, 10
#: Rows that a fold's task writes at a time; slices of scores per unit.
CHUNK, SLICES = 50_000, 8
#: Rows below which a study says nothing of an edge.
LEAST_ROWS = 20


def build_observations(features: DataFrame, labels: DataFrame, benchmark: str, required: tuple[str, ...] = COMPONENTS) -> DataFrame:
    """Usable labels with every required component; the benchmark is left out.

    NaN excess is dropped, infinite excess is kept.
    """
    ok = labels.filter(F.col("usable") & F.col("y").isNotNull() & (F.col("ticker") != benchmark))
    ok = ok.filter(F.col("excess_log_return").isNotNull() & ~F.isnan("excess_log_return"))
    return (
        ok.select("ticker", "decision_date", "y", "excess_log_return")
        .join(features.select("ticker", "decision_date", *required), ["ticker", "decision_date"])
        .dropna(subset=list(required))
    )


def block_key(seed: Column | int, perm: Column, fold: Column, role: Column, block: Column) -> Column:
    """Order key of one block in one permutation: md5 text, equal on any engine."""
    parts = [F.lit(seed), perm, fold, role, block]
    return F.md5(F.concat_ws(":", *[p.cast("string") for p in parts]))


def permuted_slots(tagged: DataFrame, permutations: int = PERMUTATIONS, seed: int = SEED, block: int = BLOCK) -> DataFrame:
    """(perm, fold, role, decision_date) with the old and the new first position.

    Sized by sessions, not by observations. ``block`` counts dates, so a date's
    rows always move together.
    """
    per_date = tagged.groupBy("fold", "role", "decision_date").agg(F.count("*").alias("n"))
    w = Window.partitionBy("fold", "role").orderBy("decision_date")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    slots = per_date.select(
        "*",
        F.coalesce(F.sum("n").over(before), F.lit(0)).alias("old_start"),
        F.floor((F.row_number().over(w) - 1) / F.lit(block)).cast("long").alias("block"),
    )
    perms = slots.select("*", F.explode(F.sequence(F.lit(0), F.lit(permutations))).alias("perm"))
    keyed = perms.withColumn("key", block_key(seed, F.col("perm"), F.col("fold"), F.col("role"), F.col("block")))
    shuffled = Window.partitionBy("perm", "fold", "role").orderBy("key", "block", "decision_date").rowsBetween(Window.unboundedPreceding, -1)
    moved = F.coalesce(F.sum("n").over(shuffled), F.lit(0))
    return keyed.select(
        "perm", "fold", "role", "decision_date", "old_start",
        F.when(F.col("perm") == 0, F.col("old_start")).otherwise(moved).alias("new_start"),
    )


def permute_labels(tagged: DataFrame, permutations: int = PERMUTATIONS, seed: int = SEED, block: int = BLOCK) -> DataFrame:
    """Every observation under every permutation, with the label it is given.

    Rows keep their place; labels are dealt out by position after the dates'
    blocks move. ``tagged`` carries fold, role, decision_date, ticker, y.
    """
    in_date = Window.partitionBy("fold", "role", "decision_date").orderBy("ticker")
    rows = tagged.withColumn("idx", F.row_number().over(in_date) - 1)
    slots = permuted_slots(tagged, permutations, seed, block)
    keys = ["fold", "role", "decision_date"]
    labels = rows.select(*keys, "idx", "y").join(slots, keys).select(
        "perm", "fold", "role", (F.col("new_start") + F.col("idx")).alias("pos"), F.col("y").alias("y_perm")
    )
    places = rows.drop("y").join(slots, keys).withColumn("pos", F.col("old_start") + F.col("idx"))
    return places.join(labels, ["perm", "fold", "role", "pos"]).drop("old_start", "new_start", "idx")


def block_permute(df: DataFrame, keys: list[str], position: str, label: str, block: int, seed: int = SEED, perm: int = 1) -> DataFrame:
    """Permute one label column in contiguous blocks of rows (1 = plain shuffle).

    ``position`` is a dense 0-based row position inside each key.
    """
    blocks = df.select(*keys, F.floor(F.col(position) / F.lit(block)).cast("long").alias("block"), position, label)
    sizes = blocks.groupBy(*keys, "block").agg(F.count("*").alias("n"), F.min(position).alias("first"))
    tag = F.concat_ws("|", *[F.col(k).cast("string") for k in keys]) if keys else F.lit("")
    order = Window.partitionBy(*keys).orderBy(block_key(seed, F.lit(perm), tag, F.lit("rows"), F.col("block")), "block").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(*keys, "block", "first", F.coalesce(F.sum("n").over(order), F.lit(0)).alias("start"))
    dealt = blocks.join(starts, [*keys, "block"]).select(
        *keys, (F.col("start") + F.col(position) - F.col("first")).alias(position), F.col(label).alias(f"{label}_perm")
    )
    return df.join(dealt, [*keys, position])


def best_thresholds(train: DataFrame, keys: list[str], score: str = "score", label: str = "y_perm", weight: str | None = None) -> DataFrame:
    """Per key, the cut maximizing training accuracy of ``score > threshold``.

    The lowest cut wins ties. ``inclusive`` marks the all-positive candidate
    just below the smallest training score. Score ties are pre-counted; scores
    lie in [-1, 1], so slices of the score range split hot folds. ``weight``
    names a row count when the input is already collapsed.
    """
    n = F.col(weight) if weight else F.lit(1).cast("long")
    tally = lambda v: F.coalesce(F.sum(F.when(F.col(label) == v, n)), F.lit(0))
    counts = train.groupBy(*keys, score).agg(tally(0).alias("n0"), tally(1).alias("n1"))
    slice_ = F.floor(F.col(score) * 16.0)
    swept = running_sums(counts, keys, slice_, [score], {"zeros_le": F.col("n0"), "ones_le": F.col("n1")}, totals=True)
    correct = F.col("zeros_le") + F.col("ones_le_total") - F.col("ones_le")
    best = swept.groupBy(*keys).agg(
        F.max(F.struct(correct.alias("correct"), (-F.col(score)).alias("neg"))).alias("best"),
        F.min(score).alias("lowest"),
        F.first("ones_le_total").alias("ones"),
    )
    all_positive = F.col("ones") >= F.col("best.correct")
    return best.select(
        *keys,
        F.when(all_positive, F.col("lowest")).otherwise(-F.col("best.neg")).alias("threshold"),
        all_positive.alias("inclusive"),
        F.greatest("ones", "best.correct").alias("train_correct"),
    )


def predict(test: DataFrame, thresholds: DataFrame, keys: list[str], score: str = "score") -> DataFrame:
    hit = (F.col(score) > F.col("threshold")) | (F.col("inclusive") & (F.col(score) >= F.col("threshold")))
    return test.join(thresholds, keys).withColumn("predicted", hit.cast("int"))


def variant_cells(variants: dict[str, dict[str, float]], digits: int = 9) -> Column:
    """Array of each variant's weighted score, in their order; a missing component adds zero."""
    return F.array(*[rounded(weighted_columns(w, missing_as_zero=True), digits) for w in variants.values()])


def score_variants(rows: DataFrame, variants: dict[str, dict[str, float]], keep: list[str], digits: int = 9) -> DataFrame:
    """One row per variant with its weighted score."""
    return spread_variants(rows.select(*keep, variant_cells(variants, digits).alias("scores")), variants, keep)


def spread_variants(rows: DataFrame, variants: dict[str, dict[str, float]], keep: list[str]) -> DataFrame:
    """Rows with an array ``scores`` to one row per variant."""
    names = F.array(*[F.lit(v) for v in variants])
    out = rows.select(*keep, F.posexplode("scores").alias("nth", "score"))
    return out.select(*keep, F.get(names, F.col("nth")).alias("variant"), "score")


def _bytes_of(permutations: int) -> int:
    return permutations // 8 + 1


def label_matrix(rows: DataFrame, permutations: int = PERMUTATIONS, seed: int = SEED, block: int = BLOCK, chunk: int = CHUNK) -> DataFrame:
    """(fold, role, decision_date, bits): each row's label under every permutation, one bit each.

    ``rows`` carry fold, role, decision_date, ticker, y (0 or 1). A fold's labels
    travel once, a byte per row; its task moves the blocks of dates and writes
    ``chunk`` rows at a time. ``bits`` holds the date's rows one after the other,
    in order of ticker, ``permutations // 8 + 1`` bytes each; bit 0 is the real label.
    """
    width = _bytes_of(permutations)
    keys = ["fold", "role"]
    letters = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ticker", "y"))), lambda r: r["y"].cast("string")), "")
    dated = spread(rows, *keys).groupBy(*keys, "decision_date").agg(letters.alias("labels"))
    whole = dated.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("decision_date", "labels"))).alias("dates"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for fold, role, dates in zip(batch["fold"], batch["role"], batch["dates"]):
                days, n = [d["decision_date"] for d in dates], np.array([len(d["labels"]) for d in dates])
                y = np.frombuffer("".join(d["labels"] for d in dates).encode(), np.uint8) & 1
                old = np.r_[0, np.cumsum(n)]
                head = np.arange(0, len(days), block)
                first, size = old[head], np.diff(old[np.r_[head, len(days)]])
                orders = [np.arange(len(head))]
                for perm in range(1, permutations + 1):
                    names = [hashlib.md5(f"{seed}:{perm}:{fold}:{role}:{i}".encode()).hexdigest() for i in range(len(head))]
                    orders.append(np.array(sorted(range(len(head)), key=lambda i: (names[i], i))))
                at = 0
                while at < len(days):
                    stop = max(at + 1, int(np.searchsorted(old, old[at] + chunk, "right")) - 1)
                    place = np.arange(old[at], old[stop])
                    bits = np.zeros((len(place), width), np.uint8)
                    for perm, order in enumerate(orders):
                        new = np.r_[0, np.cumsum(size[order])]
                        nth = np.searchsorted(new, place, "right") - 1
                        bits[:, perm // 8] |= y[first[order][nth] + place - new[nth]] << (perm % 8)
                    edges = (old[at : stop + 1] - old[at]).tolist()
                    yield pd.DataFrame({"fold": fold, "role": role, "decision_date": days[at:stop], "bits": [bits[i:j].tobytes() for i, j in zip(edges, edges[1:])]})
                    at = stop

    types = dict(rows.dtypes)
    return whole.mapInPandas(run, f"fold {types['fold']}, role string, decision_date {types['decision_date']}, bits binary")


def _swept(rows: pd.DataFrame, permutations: int) -> pd.DataFrame:
    """One slice of a fold's scores: what its cuts gain under each permutation, or, for test rows, the rows packed."""
    width = _bytes_of(permutations)
    rows = rows.sort_values("score", kind="stable")
    score = rows["score"].to_numpy()
    bits = np.frombuffer(b"".join(rows["bits"]), np.uint8).reshape(-1, width)
    head = {c: rows[c].iloc[0] for c in ("variant", "fold", "role")}
    if head["role"] != "train":
        return pd.DataFrame([head | {"slice": 0, "n": len(score), "ones": None, "gain": None, "cut": None, "lowest": 0.0, "scores": score.tobytes(), "bits": bits.tobytes()}])
    last = np.flatnonzero(np.r_[score[1:] != score[:-1], True])
    ones, gain, cut = [], [], []
    for i in range(0, width, 4):  # a few permutations at a time, to bound the sums
        labels = np.unpackbits(bits[:, i : i + 4], axis=1, bitorder="little").astype(np.int8)
        ones.append(labels.sum(axis=0, dtype=np.int64))
        lead = np.cumsum(1 - 2 * labels, axis=0, dtype=np.int32)[last]
        best = lead.argmax(axis=0)
        gain.append(lead[best, np.arange(lead.shape[1])].astype(np.int64))
        cut.append(score[last][best])
    kept = permutations + 1
    joined = [np.concatenate(x)[:kept].tobytes() for x in (ones, gain, cut)]
    return pd.DataFrame([head | {"slice": int(rows["slice"].iloc[0]), "n": len(score), "ones": joined[0], "gain": joined[1], "cut": joined[2], "lowest": float(score[0]), "scores": None, "bits": None}])


def _fold_cuts(slices: pd.DataFrame) -> pd.DataFrame:
    """The best cut of each permutation over a fold's slices, in their order; the lowest cut wins ties."""
    slices = slices.sort_values("slice")
    ones, gain, cut = (np.stack([np.frombuffer(x, t) for x in slices[c]]) for c, t in (("ones", np.int64), ("gain", np.int64), ("cut", np.float64)))
    zeros_lead = slices["n"].to_numpy()[:, None] - 2 * ones
    before = np.cumsum(zeros_lead, axis=0) - zeros_lead
    correct = before + gain + ones.sum(axis=0)
    best, every = correct.argmax(axis=0), np.arange(correct.shape[1])
    all_positive = ones.sum(axis=0) >= correct[best, every]
    threshold = np.where(all_positive, slices["lowest"].min(), cut[best, every])
    return pd.DataFrame([{"variant": slices["variant"].iloc[0], "fold": slices["fold"].iloc[0], "threshold": threshold.tobytes(), "inclusive": all_positive.tobytes()}])


def _judged(batches: Iterator[pd.DataFrame], permutations: int) -> Iterator[pd.DataFrame]:
    width = _bytes_of(permutations)
    for batch in batches:
        out = []
        for r in batch.itertuples():
            score, threshold, inclusive = np.frombuffer(r.scores, np.float64), np.frombuffer(r.threshold, np.float64), np.frombuffer(r.inclusive, bool)
            correct, ones = np.zeros(permutations + 1, np.int64), np.zeros(permutations + 1, np.int64)
            bits = np.frombuffer(r.bits, np.uint8).reshape(-1, width)
            for i in range(0, len(score), 4096):
                labels = np.unpackbits(bits[i : i + 4096], axis=1, bitorder="little")[:, : permutations + 1]
                own = score[i : i + 4096, None]
                correct += (((own > threshold) | (inclusive & (own >= threshold))) == labels).sum(axis=0)
                ones += labels.sum(axis=0, dtype=np.int64)
            out.append((r.variant, r.fold, r.n, correct.tolist(), ones.tolist()))
        yield pd.DataFrame(out, columns=["variant", "fold", "n", "correct", "ones"])


def fold_results(
    observations: DataFrame, calendar: DataFrame, splits: DataFrame, variants: dict[str, dict[str, float]],
    permutations: int = PERMUTATIONS, seed: int = SEED, block: int = BLOCK,
) -> DataFrame:
    """(variant, perm, fold): test rows and correct predictions, refit each time.

    Scores do not depend on the permutation: a row carries all its permuted labels
    as bits, and each slice of a fold's scores is sorted once and swept for all
    permutations together. A cut's standing within its slice does not depend on
    the other slices, so a fold's choice needs one row per slice.
    """
    tagged = assign_folds(observations, calendar, splits)
    keys = ["fold", "role", "decision_date"]
    narrow = materialize(tagged.select(*keys, "ticker", "y", variant_cells(variants).alias("scores")), "study-rows")
    width = _bytes_of(permutations)
    nth = F.row_number().over(Window.partitionBy(*keys).orderBy("ticker")) - 1
    placed = narrow.select(*keys, "scores", nth.alias("nth")).join(label_matrix(narrow, permutations, seed, block), keys)
    own = placed.select("fold", "role", "scores", F.expr(f"substring(bits, nth * {width} + 1, {width})").alias("bits"))
    cells = spread_variants(own, variants, ["fold", "role", "bits"]).withColumn("slice", F.floor(F.col("score") * SLICES).cast("int"))
    types = dict(cells.dtypes)
    schema = f"variant string, fold {types['fold']}, role string, slice int, n long, ones binary, gain binary, cut binary, lowest double, scores binary, bits binary"
    group = ["variant", "fold", "role", "slice"]
    swept = spread(cells, *group).groupBy(*group).applyInPandas(lambda rows: _swept(rows, permutations), schema)
    swept = materialize(swept, "study-slices")
    cuts = swept.where("role = 'train'").select("variant", "fold", "slice", "n", "ones", "gain", "cut", "lowest")
    cuts = cuts.groupBy("variant", "fold").applyInPandas(lambda rows: _fold_cuts(rows), f"variant string, fold {types['fold']}, threshold binary, inclusive binary")
    test = swept.where("role = 'test'").select("variant", "fold", "n", "scores", "bits").join(cuts, ["variant", "fold"])
    judged = test.mapInPandas(lambda batches: _judged(batches, permutations), f"variant string, fold {types['fold']}, n long, correct array<long>, ones array<long>")
    each = judged.select("variant", "fold", "n", F.posexplode(F.arrays_zip("correct", "ones")).alias("perm", "of"))
    return each.groupBy("variant", "perm", "fold").agg(F.sum("n").alias("n"), F.sum("of.correct").alias("correct"), F.sum("of.ones").alias("ones"))


def evaluation_report(results: DataFrame) -> DataFrame:
    """Per variant: accuracy against the majority rate and the noise floor."""
    runs = results.groupBy("variant", "perm").agg(
        F.sum("n").alias("n"), F.sum("correct").alias("correct"), F.sum("ones").alias("ones"), F.count("*").alias("folds"),
        (F.max(F.col("correct") / F.col("n")) - F.min(F.col("correct") / F.col("n"))).alias("spread"),
    )
    acc = F.col("correct") / F.col("n")
    real = runs.filter(F.col("perm") == 0).select(
        "variant", F.col("n").alias("observations"), "folds", acc.alias("accuracy"),
        (F.greatest("ones", F.col("n") - F.col("ones")) / F.col("n")).alias("majority_rate"),
        F.col("spread").alias("fold_accuracy_spread"),
    )
    null = runs.filter(F.col("perm") > 0).select("variant", acc.alias("null_accuracy"))
    stats = (
        null.join(real.select("variant", "accuracy"), "variant")
        .groupBy("variant")
        .agg(
            F.avg("null_accuracy").alias("permutation_mean"),
            F.stddev_pop("null_accuracy").alias("permutation_std"),
            ((F.count_if(F.col("null_accuracy") >= F.col("accuracy")) + 1) / (F.count("*") + 1)).alias("p_value"),
            F.count("*").alias("permutations"),
        )
    )
    z = F.when(F.col("permutation_std") < 1e-12, F.lit(0.0)).otherwise(
        F.try_divide(F.col("accuracy") - F.col("permutation_mean"), F.col("permutation_std"))
    )
    df = real.join(stats, "variant", "left").withColumn("z_vs_noise", F.coalesce(z, F.lit(0.0)))
    return df.withColumn("verdict", verdict())


def study_result(observations: DataFrame, splits: DataFrame, calendar: DataFrame, report: DataFrame, ic: DataFrame, variants: dict[str, dict[str, float]]) -> DataFrame:
    """One row per (variant, component it weighs): the variant's report beside the component's rank IC and the study's extent.

    ``status`` says whether the training and test rows suffice to speak of an edge.
    """
    tagged = assign_folds(observations, calendar, splits)
    sides = tagged.groupBy("role").agg(F.count("*").alias("n")).groupBy().pivot("role", ["train", "test"]).agg(F.first("n")).na.fill(0)
    extent = observations.agg(
        F.count("*").alias("study_rows"), F.count_distinct("ticker").alias("instruments"), F.min("decision_date").alias("first_decision"), F.max("decision_date").alias("last_decision")
    ).crossJoin(F.broadcast(calendar.agg(F.count("*").alias("sessions")))).crossJoin(F.broadcast(sides.withColumnsRenamed({"train": "n_train", "test": "n_test"})))
    spark = observations.sparkSession
    weights = spark.createDataFrame([(v, c, float(w)) for v, own in variants.items() for c, w in own.items()], "variant string, component string, weight double")
    summary = ic.select("component", "mean_ic", "t_stat", "thin_universe", F.col("folds").alias("ic_folds"))
    joined = F.broadcast(weights).join(summary, "component", "left").join(report, "variant", "left").crossJoin(F.broadcast(extent))
    enough = (F.col("n_train") >= LEAST_ROWS) & (F.col("n_test") >= LEAST_ROWS)
    return joined.withColumn("status", F.when(enough, "STUDY_REPORT").otherwise("INSUFFICIENT_ELIGIBLE_DATA")).withColumn("verdict", F.when(enough, F.col("verdict")))


def verdict() -> Column:
    """Harsh by design: the default answer is no edge."""
    return (
        F.when(F.col("accuracy") <= F.col("majority_rate"), "NO_EDGE_MAJORITY")
        .when(F.coalesce("p_value", F.lit(1.0)) > 0.05, "NO_EDGE_CHANCE")
        .when(F.col("z_vs_noise") < 2.0, "INCONCLUSIVE")
        .otherwise("SIGNAL_CANDIDATE")
    )


def fit_predict_groups(
    rows: DataFrame, keys: list[str], features: list[str], fit_predict: Callable[[pd.DataFrame, pd.Series, pd.DataFrame], pd.Series]
) -> DataFrame:
    """Arbitrary learner: one fit per (variant, permutation, fold) group.

    The group is one fold's rows, which any in-memory learner must hold anyway;
    folds, variants and permutations spread over the cluster.
    """

    def run(batch: pd.DataFrame) -> pd.DataFrame:
        train, test = batch[batch.role == "train"], batch[batch.role == "test"]
        guess = fit_predict(train[features], train["y_perm"], test[features])
        out = test[keys + ["decision_date", "ticker", "y_perm"]].copy()
        out["predicted"] = list(guess)
        return out

    types = dict(rows.dtypes)
    schema = ", ".join(f"{c} {types[c]}" for c in keys + ["decision_date", "ticker", "y_perm"]) + ", predicted int"
    return rows.groupBy(*keys).applyInPandas(run, schema)
