"""Language of web pages by fusing evidence in Bayes' rule.

Text: hashed byte trigrams, with counts per language over all documents, give
each page a likelihood per language. Host: votes of the text alone are counted
by (host, language), (address suffix, language) and overall, and a page's prior
shrinks from its host's other pages to its suffix's to all pages', by grouped
aggregation. Declared markup language and address suffix: how often pages that
vote for a language declare a code or end in a suffix, smoothed. The posterior
adds the logarithms; text is tempered, since trigrams depend on each other.

Sums of counts are packed rows, added up in ``PARTS`` groups per language
first, so a language with most documents is no larger task than others. Every
value of lang is a language: pages are scored by ``GROUP`` languages a pass, so
that many tables are in memory at once. Hosts are joined on counts already
grouped.

Defined results: documents without lang or text teach nothing; null or empty html has no text and
is decided by the rest; url or declaration may be missing; ties go to the
language first in the alphabet; every row gives one row; columns beyond
page_id, url and html (lang and text) are ignored. Without taught languages
the language is null.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from tidemark.session import materialize

from .extract import main_text

BINS, GROUP, PARTS = 1 << 14, 64, 64
#: Numbers of one array while evidence is fused.
CELLS = 1 << 20
TEMPER, ENOUGH = 0.2, 200.0
HOST_WEIGHT, SUFFIX_WEIGHT, SMOOTH = 4.0, 20.0, 1.0


def trigram_bins(text: str) -> np.ndarray:
    """Bin of each byte trigram of the lower-cased text."""
    raw = np.frombuffer(text.lower().encode("utf-8", "surrogatepass"), np.uint8).astype(np.uint32)
    if len(raw) < 3:
        return np.empty(0, np.uint32)
    return ((raw[:-2] * np.uint32(65599) + raw[1:-1]) * np.uint32(65599) + raw[2:]) * np.uint32(2654435761) >> np.uint32(18)


def _packed(sums: np.ndarray) -> bytes:
    """Bins that are not zero, with their sums."""
    at = np.flatnonzero(sums)
    return at.astype(np.float64).tobytes() + sums[at].tobytes()


def _unpacked(rows: pd.Series) -> np.ndarray:
    """The sum of packed rows."""
    total = np.zeros(BINS)
    for raw in rows:
        at, sums = np.frombuffer(raw).reshape(2, -1)
        total[at.astype(np.int64)] += sums
    return total


def language_counts(docs: DataFrame) -> DataFrame:
    """(lang, sums): packed trigram counts of every language; stored."""
    named = docs.where("lang is not null and text is not null")

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for nth, b in enumerate(batches):
            rows = []
            for lang, texts in b.groupby("lang")["text"]:
                sums = np.zeros(BINS)
                for t in texts:
                    sums += np.bincount(trigram_bins(t), minlength=BINS)
                rows.append((lang, hash((len(texts), nth, float(sums[:64].sum()))) % PARTS, _packed(sums)))
            yield pd.DataFrame(rows, columns=["lang", "part", "sums"])

    def add(rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"lang": [rows["lang"].iloc[0]], "part": [0], "sums": [_packed(_unpacked(rows["sums"]))]})

    schema = "lang string, part int, sums binary"
    counted = named.select("lang", "text").mapInPandas(count, schema)
    found = counted.groupBy("lang", "part").applyInPandas(add, schema).groupBy("lang").applyInPandas(add, schema)
    return materialize(found.select("lang", "sums"), "languages")


def _tables(counts: DataFrame, langs: list[str]) -> np.ndarray:
    """Log probability of each bin in each of ``langs``."""
    found = {r["lang"]: _unpacked([r["sums"]]) for r in counts.where(F.col("lang").isin(langs)).collect()}
    return np.stack([np.log((found[x] + 0.1) / (found[x].sum() + 0.1 * BINS)) for x in langs]).astype(np.float32)


READ = "page_id long, url string, declared string, seen binary, logs array<double>, vote int"


def text_evidence(pages: DataFrame, counts: DataFrame, langs: list[str], group: int) -> DataFrame:
    """(page_id, url, declared, logs, vote, host, suffix): tempered log likelihood per language, in the order of ``langs``."""
    groups = [langs[i : i + group] for i in range(0, len(langs), group)]

    def scored(table: np.ndarray, last: bool, first: bool):
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                logs, votes, kept = [], [], []
                for page, before in zip(b["html"] if first else b["seen"], [()] * len(b) if first else b["logs"]):
                    seen = trigram_bins(main_text(page)) if first else np.frombuffer(page, np.uint16)
                    own = table[:, seen].sum(axis=1, dtype=float) * TEMPER * min(1.0, ENOUGH / max(len(seen), 1))
                    own = np.concatenate([before, own])
                    logs.append(own.tolist())
                    votes.append(int(own.argmax()) if len(seen) else -1)
                    kept.append(b"" if last else seen.astype(np.uint16).tobytes())
                yield pd.DataFrame({"page_id": b["page_id"], "url": b["url"], "declared": b["declared"], "seen": kept, "logs": logs, "vote": votes})

        return run

    declared = F.lower(F.regexp_extract(F.coalesce("html", F.lit("")), r"(?is)<html\b[^>]*?\blang\s*=\s*[\"']?([A-Za-z]{2,3})", 1))
    read = pages.select("page_id", "url", "html", declared.alias("declared"))
    for i, names in enumerate(groups):
        if i:
            read = materialize(read, "scores")
        read = read.mapInPandas(scored(_tables(counts, names), i == len(groups) - 1, i == 0), READ)
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    return materialize(read.drop("seen").withColumn("host", host).withColumn("suffix", F.regexp_extract("host", r"([^.]+)$", 1)), "evidence")


def _votes(evidence: DataFrame, key: str) -> DataFrame:
    """The languages voted for with each value of ``key``, and how often; pages that lack it share nothing."""
    each = evidence.where("vote >= 0").where(F.col(key) != "").groupBy(key, "vote").agg(F.count("*").cast("double").alias("votes"))
    both = each.groupBy(key).agg(F.collect_list(F.struct("vote", "votes")).alias("both"))
    return both.select(key, F.col("both.vote").alias(f"of_{key}"), F.col("both.votes").alias(f"by_{key}"))


def _dense(of: pd.Series, by: pd.Series, n: int) -> np.ndarray:
    """Votes per language of each row."""
    out = np.zeros((len(of), n))
    for row, where, votes in zip(out, of, by):
        if where is not None:
            row[where] = votes
    return out


def page_languages(pages: DataFrame, docs: DataFrame, group: int = GROUP) -> DataFrame:
    """(page_id, url, lang, probability, declared, text_lang) of every page."""
    counts = language_counts(docs)
    langs = sorted(r["lang"] for r in counts.select("lang").collect())
    n = len(langs)
    if not n:
        return pages.select("page_id", "url", F.lit(None).cast("string").alias("lang"), F.lit(0.0).alias("probability"), F.lit("").alias("declared"), F.lit(None).cast("string").alias("text_lang"))
    evidence = text_evidence(pages, counts, langs, group)
    overall = (evidence.where("vote >= 0").groupBy("vote").count().collect())
    world = np.ones(n)
    for r in overall:
        world[r["vote"]] += r["count"]
    joined = evidence
    for key in ("host", "suffix", "declared"):
        joined = joined.join(_votes(evidence, key), key, "left")
    codes = evidence.agg(F.countDistinct("declared"), F.countDistinct("suffix")).first()

    def fuse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        step = max(1, CELLS // n)
        for b in (b.iloc[i : i + step] for b in batches for i in range(0, len(b), step)):
            own, voted = np.zeros((len(b), n)), b["vote"].to_numpy() >= 0
            own[np.flatnonzero(voted), b["vote"].to_numpy()[voted]] = 1  # a page's own vote tells nothing of its host
            host, suffix, declared = (np.maximum(_dense(b[f"of_{k}"], b[f"by_{k}"], n) - own, 0) for k in ("host", "suffix", "declared"))
            rest = np.maximum(world - own, 0.5)
            share = rest / rest.sum(axis=1, keepdims=True)
            share = (suffix + SUFFIX_WEIGHT * share) / (suffix.sum(axis=1, keepdims=True) + SUFFIX_WEIGHT)
            share = (host + HOST_WEIGHT * share) / (host.sum(axis=1, keepdims=True) + HOST_WEIGHT)
            told = np.log((declared + SMOOTH) / (rest + SMOOTH * codes[0])) * (b["declared"].to_numpy() != "")[:, None]
            ends = np.log((suffix + SMOOTH) / (rest + SMOOTH * codes[1])) * (b["suffix"].to_numpy() != "")[:, None]
            log = np.stack(b["logs"].to_numpy()) + told + ends + np.log(share)
            weight = np.exp(log - log.max(axis=1, keepdims=True))
            weight /= weight.sum(axis=1, keepdims=True)
            best, vote = weight.argmax(axis=1), b["vote"].to_numpy()
            yield pd.DataFrame({"page_id": b["page_id"].array, "url": b["url"].array, "lang": [langs[i] for i in best], "probability": weight.max(axis=1), "declared": b["declared"].array, "text_lang": [langs[i] if i >= 0 else None for i in vote]})

    columns = ["page_id", "url", "declared", "suffix", "logs", "vote", *[f"{x}_{k}" for k in ("host", "suffix", "declared") for x in ("of", "by")]]
    return joined.select(columns).mapInPandas(fuse, "page_id long, url string, lang string, probability double, declared string, text_lang string")
