"""Secret scan: fixed patterns, and a battery of randomness tests under a false-discovery limit.

DataFrame operations only. A match's place comes from the lengths of the pieces
between matches, so a text is read by one test and, if that finds something,
by one split per pattern. Runs of encoding characters become candidates; the
battery infers each one's encoding and tests

* chi-squared of its alphabet: against uniform draws, and against text whose
  letters concentrate as they do in this corpus's own long words; the second
  gives the p-value, whose power grows with length;
* runs above and below the middle of the alphabet;
* serial correlation of neighbouring symbols, and steps that repeat.

A candidate that fails uniformity, runs, correlation or steps is out. Of the others
those are kept whose length-weighted p-values pass a Benjamini-Hochberg step at
``FDR`` over all candidates of the corpus; the step reads a histogram of
p-values of at most ``BINS`` rows, so ties in a bin are decided alike.

Defined results: rows without doc_id are left out; null and empty texts have no
spans; rows that share a doc_id are scanned row by row; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tidemark.functions.pricing import upper_tail
from tidemark.session import materialize

# The patterns of the contract; kinds in its order.
PATTERNS = {
    "assign": r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    "access": r"AKIA[A-Z0-9]+",
    "hex": r"[0-9a-f]{32,}",
}
KINDS = ("assign", "access", "hex", "random")
CANDIDATE = r"[A-Za-z0-9+/_-]{20,}"
DIGITS, LETTERS = "0123456789", "abcdefghijklmnopqrstuvwxyz"
#: (encoding, pattern of its tokens, its symbols in order); the first that fits is taken.
ENCODINGS = (
    ("decimal", "^[0-9]+$", DIGITS),
    ("hex", "^[0-9a-f]+$", DIGITS + "abcdef"),
    ("hex upper", "^[0-9A-F]+$", DIGITS + "ABCDEF"),
    ("base32", "^[A-Z2-7]+$", LETTERS.upper() + "234567"),
    ("base36", "^[0-9a-z]+$", DIGITS + LETTERS),
    ("base36 upper", "^[0-9A-Z]+$", DIGITS + LETTERS.upper()),
    ("base62", "^[0-9A-Za-z]+$", DIGITS + LETTERS.upper() + LETTERS),
    ("base64", "^[0-9A-Za-z+/]+$", DIGITS + LETTERS.upper() + LETTERS + "+/"),
    ("base64 url", "^[0-9A-Za-z_+/-]+$", DIGITS + LETTERS.upper() + LETTERS + "-_+/"),
)
FDR, VETO, BINS, PER_DECADE = 0.01, 3.5, 15_000, 50
USUAL_CONCENTRATION = 0.065
#: Matches that are placed one after the other.
RUN = 256


def located(text: Column, pattern: str, group: int = 0) -> Column:
    """Array of (start, end, value) of all matches, in code points; ``value`` is that group.

    Matches are placed within runs of ``RUN``, then the runs among themselves, so
    that no array grows match by match over a whole text.
    """
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    value = whole if group == 0 else F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    parts = F.arrays_zip(F.slice(F.split(text, pattern, -1), F.lit(1), F.size(whole)).alias("gap"), whole.alias("whole"), value.alias("value"))
    empty = F.array().cast("array<struct<start:int,end:int,value:string>>")

    def step(acc, p):
        start = acc.at + F.length(p.gap)
        end = start + F.length(p.whole)
        found = F.struct(start.alias("start"), end.alias("end"), p.value.alias("value"))
        return F.struct(end.alias("at"), F.concat(acc.out, F.array(found)).alias("out"))

    def placed(all_parts: Column) -> Column:
        many = F.ceil(F.size(all_parts) / F.lit(RUN)).cast("int")
        runs = F.transform(F.sequence(F.lit(0), F.greatest(many - 1, F.lit(0))), lambda i: F.aggregate(F.slice(all_parts, i * RUN + 1, F.lit(RUN)), F.struct(F.lit(0).alias("at"), empty.alias("out")), step))
        return _bound(runs, joined_runs)

    def joined_runs(runs: Column) -> Column:
        start = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))
        begins = F.aggregate(runs, start, lambda acc, r: F.struct((acc.at + r.at).alias("at"), F.concat(acc.out, F.array(acc.at)).alias("out")), lambda acc: acc.out)
        moved = lambda r, by: F.transform(r.out, lambda s: F.struct((s.start + by).alias("start"), (s.end + by).alias("end"), s.value.alias("value")))
        return F.flatten(F.zip_with(runs, begins, moved))

    return F.when(text.rlike(pattern), _bound(parts, placed)).otherwise(empty)


def _bound(value: Column, use) -> Column:
    """``use(value)`` with ``value`` worked out once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _runs(spans: Column) -> Column:
    """Sorted spans in runs of ``RUN``, each with the stretch it lies in: (start, end, own)."""
    many = F.greatest(F.ceil(F.size(spans) / F.lit(RUN)).cast("int") - 1, F.lit(0))
    cut = F.transform(F.sequence(F.lit(0), many), lambda i: F.slice(spans, i * RUN + 1, F.lit(RUN)))
    return F.transform(cut, lambda own: F.struct(F.array_min(own.start).alias("start"), F.array_max(own.end).alias("end"), own.alias("own")))


def base_spans(text: Column) -> Column:
    """Array of (start, kind number, end, kind), sorted, of the patterns' matches that are long enough."""
    kept = {
        "assign": F.filter(located(text, PATTERNS["assign"], 2), lambda s: F.length(s.value) >= 8),
        "access": F.filter(located(text, PATTERNS["access"]), lambda s: s.end - s.start >= 16),
        "hex": located(text, PATTERNS["hex"]),
    }
    return F.array_sort(F.concat(*[_spans(v, k) for k, v in kept.items()]))


def _spans(matches: Column, kind: str) -> Column:
    return F.transform(matches, lambda s: F.struct(s.start.alias("start"), F.lit(KINDS.index(kind)).alias("nth"), s.end.alias("end"), F.lit(kind).alias("kind")))


def joined(spans: Column) -> Column:
    """``kind:start:end``, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s.kind, s.start, s.end)), ",")


def _choose(token: Column, values: list) -> Column:
    """The value of the first encoding that fits ``token``."""
    out = F.lit(values[-1])
    for (_, pattern, _), v in reversed(list(zip(ENCODINGS, values))[:-1]):
        out = F.when(token.rlike(pattern), F.lit(v)).otherwise(out)
    return out


def battery(token: Column, concentration: dict[str, float]) -> Column:
    """Struct (encoding, p, vetoed): p is small where a token is more even than text of its length."""
    n = F.length(token).cast("double")
    k = _choose(token, [float(len(a)) for _, _, a in ENCODINGS])
    alphabet = _choose(token, [a for _, _, a in ENCODINGS])
    delta = _choose(token, [max(len(a) * concentration[e] - 1, 0.5) for e, _, a in ENCODINGS])
    symbols = F.split(token, "")
    squares = F.aggregate(F.array_distinct(symbols), F.lit(0.0), lambda acc, c: acc + F.pow(n - F.length(F.replace(token, c, F.lit(""))), F.lit(2.0)))
    chi = k / n * squares - n
    z_text = (chi - (k - 1 + n * delta)) / F.sqrt(2 * (k - 1) + 4 * n * delta)
    tail = upper_tail(F.abs(z_text), F.exp(-z_text * z_text / 2))
    p = F.greatest(F.when(z_text < 0, tail).otherwise(1 - tail), F.lit(1e-299))
    z_even = (chi - (k - 1)) / F.sqrt(2 * (k - 1))
    places = F.transform(symbols, lambda c: F.instr(alphabet, c) - 1.0)
    mean = F.aggregate(places, F.lit(0.0), lambda acc, x: acc + x) / n
    neighbours = F.arrays_zip(F.slice(places, F.lit(1), F.size(places) - 1).alias("a"), F.slice(places, F.lit(2), F.size(places) - 1).alias("b"))
    spread = F.aggregate(places, F.lit(0.0), lambda acc, x: acc + (x - mean) * (x - mean))
    together = F.aggregate(neighbours, F.lit(0.0), lambda acc, x: acc + (x.a - mean) * (x.b - mean))
    z_serial = F.when(spread > 0, (together / spread + 1 / n) * F.sqrt(n)).otherwise(F.lit(99.0))
    above = F.aggregate(places, F.lit(0.0), lambda acc, x: acc + F.when(x >= k / 2, 1.0).otherwise(0.0))
    runs = 1 + F.aggregate(neighbours, F.lit(0.0), lambda acc, x: acc + F.when((x.a >= k / 2) != (x.b >= k / 2), 1.0).otherwise(0.0))
    usual = 2 * above * (n - above) / n + 1
    z_runs = F.when((above > 0) & (above < n), (runs - usual) / F.sqrt(F.greatest((usual - 1) * (usual - 2) / (n - 1), F.lit(0.25)))).otherwise(F.lit(99.0))
    steps = F.transform(neighbours, lambda x: x.b - x.a)
    turns = F.arrays_zip(F.slice(steps, F.lit(1), F.size(steps) - 1).alias("a"), F.slice(steps, F.lit(2), F.size(steps) - 1).alias("b"))
    steady = F.aggregate(turns, F.lit(0.0), lambda acc, x: acc + F.when(x.a == x.b, 1.0).otherwise(0.0))
    z_steps = (steady - (n - 2) / k) / F.sqrt((n - 2) / k)
    return F.struct(_choose(token, [e for e, _, _ in ENCODINGS]).alias("encoding"), p.alias("p"), ((F.abs(z_serial) > VETO) | (F.abs(z_runs) > VETO) | (z_steps > VETO) | (z_even > VETO)).alias("vetoed"))


def letter_concentration(candidates: DataFrame) -> dict[str, float]:
    """For each encoding, the sum of squared letter shares in the corpus's long all-letter tokens.

    ``candidates``: one column ``token``. At most 26 rows reach the driver.
    """
    letters = candidates.where(F.col("token").rlike("^[A-Za-z]+$")).select(F.explode(F.split(F.lower("token"), "")).alias("c"))
    counts = {r["c"]: r["count"] for r in letters.groupBy("c").count().collect()}
    found = {}
    for name, _, alphabet in ENCODINGS:
        own = [counts.get(c, 0) for c in LETTERS if c in alphabet.lower()]
        total = sum(own)
        found[name] = sum(v * v for v in own) / total**2 if total >= 1000 else max(USUAL_CONCENTRATION, 1.5 / len(alphabet))
    return found


def discovery_limit(scored: DataFrame, fdr: float = FDR) -> int | None:
    """The lowest histogram bin of -log10 q that the Benjamini-Hochberg step admits; None if none."""
    bins = {r["bin"]: r["count"] for r in scored.groupBy("bin").count().collect()}
    total, above, limit = sum(bins.values()), 0, None
    for b in sorted(bins, reverse=True):
        above += bins[b]
        if 10 ** (-b / PER_DECADE) * total / above <= fdr:
            limit = b
    return limit


def secret_spans(docs: DataFrame, fdr: float = FDR) -> DataFrame:
    """Contract of op3, and ``n_random``: (doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_random)."""
    text = F.coalesce("text", F.lit(""))
    rows = materialize(docs.where("doc_id is not null").select("doc_id", base_spans(text).alias("base"), located(text, CANDIDATE).alias("found")), "secrets")
    tokens = rows.select(F.explode("found.value").alias("token"))
    concentration = letter_concentration(tokens)
    mean_length = tokens.agg(F.avg(F.length("token"))).first()[0] or 1.0

    def scored(s: Column) -> Column:
        b = battery(s.value, concentration)
        return F.struct(s.start.alias("start"), s.end.alias("end"), b.vetoed.alias("vetoed"), _bin(b.p, s.value, mean_length).alias("bin"))

    tested = materialize(rows.select("doc_id", "base", F.transform("found", scored).alias("found")), "tested")
    limit = discovery_limit(tested.select(F.explode("found").alias("s")).select(F.when(F.col("s.vetoed"), 0).otherwise(F.col("s.bin")).alias("bin")), fdr)
    admitted = F.filter("found", lambda s: ~s.vetoed & (s.bin >= (limit if limit is not None else BINS + 1)))
    meets = lambda a, b: (b.start < a.end) & (a.start < b.end)
    apart = _bound(_runs(F.col("base")), lambda runs: F.filter(admitted, lambda s: ~F.exists(runs, lambda r: meets(s, r) & F.exists(r.own, lambda b: meets(s, b)))))
    random = _spans(apart, "random")
    count = lambda kind: F.size(F.filter("base", lambda s: s.kind == kind)).cast("long").alias(f"n_{kind}")
    return tested.select(
        "doc_id", count("assign"), count("access"), count("hex"), F.sha2(joined(F.col("base")), 256).alias("base_sha256"),
        joined(F.array_sort(F.concat("base", random))).alias("spans"), F.size(random).cast("long").alias("n_random"),
    )


def _bin(p: Column, token: Column, mean_length: float) -> Column:
    """-log10 of p over a weight that grows with length and is 1 at the mean length."""
    weighted = -F.log10(p) + F.log10(F.greatest(F.least(F.length(token) / mean_length, F.lit(4.0)), F.lit(0.25)))
    return F.floor(F.least(F.greatest(weighted, F.lit(0.0)) * PER_DECADE, F.lit(float(BINS)))).cast("int")
