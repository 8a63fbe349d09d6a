"""The registered queries of this subpackage and their SQL twins."""

from __future__ import annotations

import corpus_pipeline

from . import collocations, decontaminate, extract, jaccard, language, packing, pii, quality, repeats, search, secret_scan, substrings, topk
from .common import read


def op1_decontaminate(spark, sf_dir):
    return decontaminate.contamination(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op2_jaccard(spark, sf_dir):
    return jaccard.jaccard_components(read(spark, sf_dir, "documents"))


def op3_secrets(spark, sf_dir):
    return secret_scan.secret_spans(read(spark, sf_dir, "documents"))


def op4_quality(spark, sf_dir):
    return quality.quality_scores(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op5_pii(spark, sf_dir):
    return pii.surrogate_texts(read(spark, sf_dir, "documents"))


def op6_substrings(spark, sf_dir):
    return substrings.substring_digests(read(spark, sf_dir, "documents"))


def op7_extract(spark, sf_dir):
    return extract.extracted(read(spark, sf_dir, "pages"))


def op8_topk(spark, sf_dir):
    return topk.top_products(read(spark, sf_dir, "embeddings"))


def op9_language(spark, sf_dir):
    return language.page_languages(read(spark, sf_dir, "pages"), read(spark, sf_dir, "documents"))


def op10_packing(spark, sf_dir):
    return packing.packed(read(spark, sf_dir, "documents"))


def op11_collocations(spark, sf_dir):
    return collocations.collocations(read(spark, sf_dir, "documents"))


def op12_search(spark, sf_dir):
    return search.ranked(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op13_repeats(spark, sf_dir):
    return repeats.repeat_digests(read(spark, sf_dir, "documents"))


def pipeline(spark, sf_dir):
    return corpus_pipeline.run(spark, sf_dir)


def all_queries():
    return {f.__name__: f for f in (op1_decontaminate, op2_jaccard, op3_secrets, op4_quality, op5_pii, op6_substrings, op7_extract, op8_topk, op9_language, op10_packing, op11_collocations, op12_search, op13_repeats, pipeline)}


def all_oracles():
    return {"op1_decontaminate": decontaminate.SQL, "op2_jaccard": jaccard.SQL, "op6_substrings": substrings.SQL, "op8_topk": topk.SQL, "op11_collocations": collocations.SQL, "op12_search": search.SQL, "op13_repeats": repeats.SQL}
