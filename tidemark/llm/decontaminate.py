"""Benchmark decontamination with a positional inverted index, in DataFrame operations only.

The index holds one posting (term, document, position) for each occurrence of a
benchmark term in the corpus and is stored once. Its term counts give the
rarest two terms of every phrase; the posting lists of these, shifted by their
offsets in the phrase, are intersected on (document, phrase, start). What is
left is nearly exact, and a comparison with the document's own words makes it
exact. Phrases with a term that the corpus lacks are dropped unread.

Postings are dealt by document, never by term: a frequent word costs rows, not
a large group. Terms and phrases are broadcast up to ``BROADCAST_ROWS`` rows
and joined by shuffle beyond that.

Defined results: rows without doc_id are left out; null or empty texts have no
words and no hits; items without words or without item_id have no phrases;
equal phrases of several items hit for each of them; rows that share a doc_id
are judged row by row, with their item lists united; columns beyond doc_id and
text (item_id and text) are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from tidemark.session import materialize

from .common import NOT_ALNUM, broadcast_if_small, words

WINDOW = 13
ANCHORS = 2


def phrase_table(items: DataFrame, window: int = WINDOW, separators: str = NOT_ALNUM) -> tuple[DataFrame, DataFrame]:
    """Distinct phrases (phrase_id, phrase) and their owners (phrase_id, item_id), both stored."""
    tokens = items.where("item_id is not null").select("item_id", words(F.col("text"), separators, True).alias("w"))
    starts = F.sequence(F.lit(0), F.greatest(F.size("w") - window, F.lit(0)))
    owned = materialize(
        tokens.where(F.size("w") > 0)
        .select("item_id", "w", F.explode(starts).alias("at"))
        .select("item_id", F.slice("w", F.col("at") + 1, window).alias("phrase"))
        .distinct(),
        "phrase-owners",
    )
    phrases = materialize(owned.select("phrase").distinct().withColumn("phrase_id", F.monotonically_increasing_id()), "phrases")
    return phrases, owned.join(phrases, "phrase").select("phrase_id", "item_id")


def build_index(docs: DataFrame, phrases: DataFrame, separators: str = NOT_ALNUM) -> tuple[DataFrame, DataFrame]:
    """Terms (term_id, term) of the phrases and the stored postings (term_id, doc_id, pos) of all documents."""
    terms = materialize(phrases.select(F.explode("phrase").alias("term")).distinct().withColumn("term_id", F.monotonically_increasing_id()), "terms")
    spread = docs.where("doc_id is not null").select("doc_id", F.posexplode(words(F.col("text"), separators, True)).alias("pos", "term"))
    return terms, materialize(spread.join(broadcast_if_small(terms), "term").select("term_id", "doc_id", "pos"), "postings")


def _offsets(phrases: DataFrame, terms: DataFrame, postings: DataFrame) -> DataFrame:
    """Each place of each phrase with its term's corpus count, rarest first; no phrase with an absent term."""
    counts = postings.groupBy("term_id").count()
    places = phrases.select("phrase_id", F.posexplode("phrase").alias("offset", "term"))
    known = places.join(terms, "term").join(counts, "term_id", "left").withColumn("count", F.coalesce("count", F.lit(0)))
    rarest = Window.partitionBy("phrase_id").orderBy("count", "offset")
    return known.withColumn("nth", F.row_number().over(rarest)).withColumn("least", F.min("count").over(Window.partitionBy("phrase_id"))).where("least > 0").drop("least")


def phrase_candidates(phrases: DataFrame, terms: DataFrame, postings: DataFrame, anchors: int = ANCHORS) -> DataFrame:
    """(doc_id, phrase_id, start) where the shifted lists of a phrase's rarest terms meet; stored."""
    chosen = materialize(_offsets(phrases, terms, postings).where(F.col("nth") <= anchors).select("phrase_id", "term_id", "offset"), "anchors")
    wanted = chosen.groupBy("phrase_id").agg(F.count("*").alias("wanted"))
    shifted = postings.join(broadcast_if_small(chosen), "term_id").select("doc_id", "phrase_id", (F.col("pos") - F.col("offset")).alias("start")).where("start >= 0")
    met = shifted.groupBy("doc_id", "phrase_id", "start").agg(F.count("*").alias("met"))
    return materialize(met.join(broadcast_if_small(wanted), "phrase_id").where("met >= wanted").select("doc_id", "phrase_id", "start"), "candidates")


def phrase_hits(docs: DataFrame, items: DataFrame, window: int = WINDOW, separators: str = NOT_ALNUM) -> tuple[DataFrame, DataFrame]:
    """Per document: doc_id, n_words, n_hit and the ids of its phrases, stored; and the phrases' owners.

    A word is hit if an occurrence of a phrase covers it.
    """
    phrases, owners = phrase_table(items, window, separators)
    terms, postings = build_index(docs, phrases, separators)
    found = phrase_candidates(phrases, terms, postings)
    per_doc = found.join(broadcast_if_small(phrases, 100_000), "phrase_id").groupBy("doc_id").agg(F.collect_list(F.struct("start", "phrase_id", "phrase")).alias("found"))
    own = docs.where("doc_id is not null").select("doc_id", "text").join(per_doc, "doc_id", "left")
    own = own.select("doc_id", "found", words(F.col("text"), separators, True).alias("w"))
    exact = own.select("doc_id", "w", F.filter(F.coalesce("found", F.array()), lambda c: F.slice(F.col("w"), c.start + 1, F.size(c.phrase)) == c.phrase).alias("hits"))
    covered = F.array_distinct(F.flatten(F.transform("hits", lambda c: F.sequence(c.start, c.start + F.size(c.phrase) - 1))))
    return materialize(exact.select("doc_id", F.size("w").cast("long").alias("n_words"), F.size(covered).cast("long").alias("n_hit"), F.array_distinct(F.col("hits.phrase_id")).alias("phrase_ids")), "hits"), owners


def contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW, one_in: int = 20) -> DataFrame:
    """Contract of op1: a document is contaminated if at least one word in ``one_in`` is hit."""
    hits, owners = phrase_hits(docs, items, window)
    named = hits.select("doc_id", F.explode("phrase_ids").alias("phrase_id")).join(owners, "phrase_id").select("doc_id", F.col("item_id").cast("string").alias("item_id")).distinct()
    lists = named.groupBy("doc_id").agg(F.count("*").alias("n_items"), F.sha2(F.concat_ws(",", F.array_sort(F.collect_list("item_id"))), 256).alias("items_sha256"))
    return hits.drop("phrase_ids").join(lists, "doc_id", "left").select(
        "doc_id", "n_words", "n_hit", F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"), F.coalesce("items_sha256", F.sha2(F.lit(""), 256)).alias("items_sha256"),
        ((F.col("n_hit") > 0) & (one_in * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"),
    )


def proximity_matches(docs: DataFrame, items: DataFrame, width: int, window: int = WINDOW, separators: str = NOT_ALNUM) -> DataFrame:
    """(doc_id, item_id, start) where all distinct terms of a phrase lie within ``width`` words, in any order.

    Documents that lack a phrase's rarest term are left out before the other
    lists are read; ``start`` is each place that opens such a span.
    """
    phrases, owners = phrase_table(items, window, separators)
    terms, postings = build_index(docs, phrases, separators)
    places = _offsets(phrases, terms, postings)
    rarest = postings.join(places.where("nth = 1").select("phrase_id", "term_id"), "term_id").select("phrase_id", "doc_id").distinct()
    of_phrase = places.select("phrase_id", "term_id").distinct()
    n_terms = of_phrase.groupBy("phrase_id").agg(F.count("*").alias("n_terms"))
    seen = postings.join(of_phrase, "term_id").join(rarest, ["phrase_id", "doc_id"])
    ahead = Window.partitionBy("phrase_id", "doc_id").orderBy("pos").rangeBetween(0, width - 1)
    spans = seen.withColumn("within", F.size(F.collect_set("term_id").over(ahead))).join(n_terms, "phrase_id").where("within = n_terms")
    return spans.join(owners, "phrase_id").select("doc_id", "item_id", F.col("pos").alias("start")).distinct()


SQL = """
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents WHERE doc_id IS NOT NULL),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark WHERE item_id IS NOT NULL),
p AS (SELECT DISTINCT item_id, least(len(w), 13) AS n, array_to_string(w[s : s + least(len(w), 13) - 1], ' ') AS phrase
      FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 13, 0) + 2)) AS s FROM b WHERE len(w) > 0)),
k AS (SELECT DISTINCT n FROM p),
o AS (SELECT doc_id, n, s, array_to_string(w[s : s + n - 1], ' ') AS phrase
      FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM d, k WHERE len(w) >= n)),
h AS (SELECT o.doc_id, o.n, o.s, p.item_id FROM o JOIN p ON o.phrase = p.phrase AND o.n = p.n),
c AS (SELECT doc_id, count(DISTINCT pos) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) AS pos FROM h) GROUP BY doc_id),
i AS (SELECT doc_id, count(*) AS n_items, sha256(string_agg(item, ',' ORDER BY item)) AS items_sha256 FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM h) GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       coalesce(items_sha256, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN c USING (doc_id) LEFT JOIN i USING (doc_id)
"""
