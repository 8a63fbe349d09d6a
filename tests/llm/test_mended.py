"""Cases that earlier versions got wrong."""

import random
import re

import pytest
from pyspark.sql import functions as F

from tests.llm import cases
from tests.llm.conftest import some_text
from tidemark.llm import language, pii, secret_scan


def test_surrogates_differ_across_genders(spark, documents):
    """Short names of men, women and both: no surrogate equals another's or an original."""
    rng = random.Random(4)
    names = sorted({rng.choice("BCDFGKLMNPRST") + rng.choice("aeiou") + rng.choice("bdgklmnrst") for _ in range(80)})
    docs = [(i, f"Then {title} {name} came.") for i, (title, name) in enumerate((t, n) for n in names for t in ("Mr", "Ms"))]
    rows = {r.doc_id: r.text for r in pii.surrogate_texts(documents(docs)).collect()}
    made = {i: re.fullmatch(r"Then (?:Mr|Ms) (\w+) came\.", rows[i])[1].lower() for i, _ in docs}
    assert len(set(made.values())) == len(docs)
    assert not set(made.values()) & {n.lower() for n in names}


def test_secrets_of_a_text_with_many_matches(documents):
    """Places over several runs equal brute force; a random token counts only apart from all of them."""
    rng = random.Random(2)
    one = lambda: rng.choice(["token=" + "a1B2c3D4e5" * rng.randrange(1, 3), "deadbeef" * 5, "AKIA" + "Q7" * 9, "é😀 words"]) + rng.choice([" ", "\n", ", "])
    texts = {n: "".join(one() for _ in range(n)) for n in (1, 255, 256, 257, 5_000)}
    rows = documents(list(texts.items())).select("doc_id", secret_scan.joined(secret_scan.base_spans(F.col("text"))).alias("base")).collect()
    assert {r.doc_id: r.base for r in rows} == {n: cases.base_spans(t) for n, t in texts.items()}
    spans = [(int(a), int(b)) for _, a, b in (s.split(":") for s in cases.base_spans(texts[257]).split(","))]
    runs = documents([(1, texts[257])]).select(secret_scan._runs(secret_scan.base_spans(F.col("text"))).alias("runs")).first().runs
    assert [(s.start, s.end) for r in runs for s in r.own] == spans and all(r.start == r.own[0].start and r.end == max(s.end for s in r.own) for r in runs)


def test_pages_without_url_share_no_host(spark, documents):
    """A dozen German pages without url say nothing of a page that has neither text nor url."""
    rng = random.Random(3)
    english, german = "the house and the river of the evening with that", "der und die das mit dem nicht von der Straße ein Abend"
    say = lambda words: " ".join(rng.choice(words.split()) for _ in range(80))
    docs = spark.createDataFrame([(i, say(english if i % 2 else german), "en" if i % 2 else "de") for i in range(80)], "doc_id long, text string, lang string")
    page = lambda text: f"<html><body><p>{text}</p></body></html>"
    rows = [(i, f"http://site{i % 5}.example.com/{i}", page(say(english))) for i in range(60)]
    rows += [(100 + i, None if i % 2 else "", page(say(german))) for i in range(12)] + [(200, None, None), (201, "http://unseen.example.com/", None), (202, "nonsense", "")]
    got = {r.page_id: r for r in language.page_languages(spark.createDataFrame(rows, "page_id long, url string, html string"), docs).collect()}
    assert len(got) == len(rows)
    assert all(got[i].lang == "en" for i in range(60)) and all(got[100 + i].lang == "de" for i in range(12))
    assert got[200].lang == got[202].lang == "en" and got[200].text_lang is None
    assert got[200].probability == pytest.approx(61 / 74, abs=0.01)
    assert got[201].lang == "en" and got[201].probability > got[200].probability
