"""Personal data by weak supervision, in DataFrame functions alone.

Patterns find candidate spans. Labelers vote on each candidate (for, against, silent): a strict form check, a
gazetteer, the words before it, and its borders. Candidates with equal votes are alike, so expectation-maximisation
runs on the table of vote patterns, whose size does not depend on the data: it estimates how reliable each labeler is
and how likely each pattern is personal data. A logistic span classifier is trained on these probabilities. Both are loops inside one SQL expression over that small table. Spans that
pass the base rules stay whatever it says; it adds those of the others that it accepts.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowsieve.session import materialise

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "iban", "ssn")
#: Possessive forms of the base patterns: the same leftmost matches, in time linear in the text.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9]){13,}+",  # a shorter run has too few digits, and so has every part of it
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:[A-Z0-9]{11,30})(?![A-Za-z0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
}
#: A text without this has no match; a plain search for it is cheaper than the pattern.
NEEDED = {"email": "@", "phone": "+", "ssn": "-", "ip": "."}
CONTEXT = {
    "email": r"mail|contact|write|reach|correo|courriel|schreib",
    "ip": r"\bip\b|host|server|address|login|from",
    "card": r"card|credit|visa|pay|karte|carte|tarjeta",
    "phone": r"phone|call|tel|fax|mobile|cell|telefon",
    "iban": r"iban|account|bank|konto|compte|cuenta",
    "ssn": r"ssn|social|security|tax|insurance",
}
AGAINST = r"version|isbn|order|invoice|serial|ticket|build|ref(?:erence)? *(?:no|number|#)"
CONTEXT_CHARS = 40
#: Gazetteers, fixed values.
DOMAINS = "com org net edu gov info io co de fr es it uk eu ch at be nl us ca au jp cn br in".split()
COUNTRY_CODES = "1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 54 55 56 57 60 61 62 63 64 65 66 81 82 84 86 90 91 92 351 352 353 358 420 421".split()
IBAN_COUNTRIES = "AT BE CH CZ DE DK ES FI FR GB GR HU IE IT LU NL NO PL PT SE".split()
LABELERS = ("form", "gazetteer", "context", "border")
ROUNDS = 12
#: Matches whose places are summed up in one piece.
SLICE_MATCHES = 256
_FOUND = "array<struct<start:bigint,end:bigint,m:string,before:string,after:string>>"


def matches(text: Column, kind: str) -> Column:
    """All matches of a kind's pattern, leftmost and without overlap, as found; empty without one."""
    found = F.regexp_extract_all(text, F.lit(PATTERNS[kind]), F.lit(0))
    return F.when(F.contains(text, F.lit(NEEDED[kind])), found).otherwise(F.array().cast("array<string>")) if kind in NEEDED else found


def _bound(value: Column, use) -> Column:
    """``use`` of a value that is computed once, although it is read inside a lambda."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def placed(text: Column, found: Column, kind: str) -> Column:
    """Start and end in code points of each match, with the text around it: lengths of gaps and matches, summed up.

    Sums run inside slices of the matches and then over the slices, so an array is grown within a slice alone and work
    is linear in the matches of a text.
    """
    gaps, n = F.split(text, PATTERNS[kind], -1), F.size(found)
    rows = F.zip_with(
        found, F.zip_with(F.slice(gaps, F.lit(1), n), F.slice(gaps, F.lit(2), n), lambda g, h: F.struct(g.alias("g"), h.alias("h"))),
        lambda m, x: F.struct(
            F.length(x["g"]).alias("gap"), F.length(m).alias("length"), m.alias("m"),
            F.lower(F.right(x["g"], F.lit(CONTEXT_CHARS))).alias("before"), F.left(x["h"], F.lit(1)).alias("after"),
        ),
    )
    begin = lambda kind: F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast(kind).alias("out"))

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + x["gap"]
        end = start + x["length"]
        span = F.struct(start.alias("start"), end.alias("end"), x["m"].alias("m"), x["before"].alias("before"), x["after"].alias("after"))
        return F.struct(end.cast("bigint").alias("at"), F.concat(acc["out"], F.array(span)).alias("out"))

    def shift(acc: Column, part: Column) -> Column:
        return F.struct((acc["at"] + part["at"]).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out"))

    def moved(part: Column, by: Column) -> Column:
        return F.transform(
            part["out"],
            lambda s: F.struct((s["start"] + by).alias("start"), (s["end"] + by).alias("end"), s["m"].alias("m"), s["before"].alias("before"), s["after"].alias("after")),
        )

    firsts = F.sequence(F.lit(1), n, F.lit(SLICE_MATCHES))
    slices = _bound(rows, lambda r: F.transform(firsts, lambda i: F.aggregate(F.slice(r, i, F.lit(SLICE_MATCHES)), begin(_FOUND), step)))
    whole = _bound(slices, lambda p: F.flatten(F.zip_with(p, F.aggregate(p, begin("array<bigint>"), shift, lambda acc: acc["out"]), moved)))
    return F.when(n > 0, whole).otherwise(F.array().cast(_FOUND))


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def passes(m: Column, kind: str) -> Column:
    """The base rule of a kind; for the kinds that the method adds, their strict form."""
    d = _digits(m)
    if kind == "ip":
        return F.forall(F.split(m, r"\."), lambda p: (F.length(F.ltrim(p, F.lit("0"))) <= 3) & (F.coalesce(F.ltrim(p, F.lit("0")).try_cast("int"), F.lit(0)) <= 255))
    if kind == "card":
        return F.length(d).between(14, 19) & F.call_function("luhn_check", d)
    if kind == "phone":
        return F.length(d).between(10, 15)
    if kind == "iban":
        return F.length(m).between(15, 34)
    return F.lit(True)


def _vote(yes: Column, no: Column) -> Column:
    return F.when(yes, 1).when(no, -1).otherwise(0)


def gazetteer_vote(m: Column, kind: str) -> Column:
    d = _digits(m)
    listed = {
        "email": F.lower(F.element_at(F.split(m, r"\."), -1)).isin(*DOMAINS),
        "ip": ~F.split(m, r"\.")[0].isin("0", "10", "127", "169", "192", "255"),
        "card": F.left(m, F.lit(1)).isin("3", "4", "5", "6"),
        "phone": reduce(lambda a, n: a | F.left(d, F.lit(n)).isin(*[c for c in COUNTRY_CODES if len(c) == n]), (2, 3), F.left(d, F.lit(1)).isin("1", "7")),
        "iban": F.left(m, F.lit(2)).isin(*IBAN_COUNTRIES),
        "ssn": ~F.left(m, F.lit(3)).isin("000", "666") & ~m.startswith("9"),
    }[kind]
    return _vote(listed, ~listed)


def labelled(spans: Column, kind: str) -> Column:
    """Each span with the labelers' votes."""
    letter = "[A-Za-z0-9_]"

    def votes(s: Column) -> Column:
        ok = passes(s["m"], kind)
        glued = F.right(s["before"], F.lit(1)).rlike(letter) | s["after"].rlike(letter)
        return F.struct(
            F.lit(kind).alias("kind"), s["start"].alias("start"), s["end"].alias("end"),
            (F.lit(kind in BASE_KINDS) & ok).alias("base"),
            _vote(ok, ~ok).alias("form"),
            gazetteer_vote(s["m"], kind).alias("gazetteer"),
            _vote(s["before"].rlike(CONTEXT[kind]), s["before"].rlike(AGAINST)).alias("context"),
            _vote(~glued, glued).alias("border"),
            F.least(F.floor((s["end"] - s["start"]) / 4), F.lit(10)).cast("int").alias("size"),
        )

    return F.transform(spans, votes)


def candidates(documents: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, spans: every candidate of every document row with its votes; NULL text is empty."""
    docs = documents.select(documents[doc_id].alias("doc_id"), F.coalesce(documents[text], F.lit("")).alias("text"))
    found = docs.select("doc_id", "text", *[matches(F.col("text"), k).alias(k) for k in KINDS])
    spans = found.select("doc_id", *[placed(F.col("text"), F.col(k), k).alias(k) for k in KINDS])
    return spans.select("doc_id", F.concat(*[labelled(F.col(k), k) for k in KINDS]).alias("spans"))


def vote_patterns(spans: DataFrame) -> DataFrame:
    """Number of candidates by kind, votes and size: a few thousand rows at most, whatever the data."""
    keys = ["kind", *LABELERS, "size"]
    return spans.select(F.explode("spans").alias("s")).groupBy(*[F.col(f"s.{k}").alias(k) for k in keys]).agg(F.count("*").alias("n"))


def marks(get) -> Column:
    """The places that a pattern or a span has in the parameter arrays: one for each labeler's vote, its kind, its size.

    ``get`` gives a field. Votes take three places for each labeler, then come the kinds, then the sizes.
    """
    votes = [F.lit(3 * i + 1) + get(v) for i, v in enumerate(LABELERS)]
    kind = F.array_position(F.array(*[F.lit(k) for k in KINDS]), get("kind")).cast("int") - 1 + 3 * len(LABELERS)
    return F.array(*votes, kind, get("size") + PRIORS)


PRIORS = 3 * len(LABELERS) + len(KINDS)
PLACES = PRIORS + 11


def _logit(weights: Column, places: Column) -> Column:
    return F.aggregate(places, F.lit(0.0), lambda total, j: total + F.get(weights, j))


def _sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def _sums(rows: Column, places: int, value) -> Column:
    """For each place: the sum of ``value`` over the rows that have it."""
    return F.transform(
        F.sequence(F.lit(0), F.lit(places - 1)),
        lambda j: F.aggregate(rows, F.lit(0.0), lambda total, x: total + F.when(F.array_contains(x["at"], j), value(x)).otherwise(0.0)),
    )


def reliabilities(rows: Column, rounds: int = ROUNDS) -> Column:
    """Log-odds of each place after expectation-maximisation over the vote patterns (n, at).

    The expectation gives every pattern its probability, as the product of what its votes say and how common true spans
    are in its kind. The maximisation counts each vote of each labeler among the true and among the false.
    """
    begin = [x for _ in LABELERS for x in (-1.8, 0.0, 1.3)] + [0.0] * (PLACES - 3 * len(LABELERS))

    def step(weights: Column, _: Column) -> Column:
        scored = F.transform(
            rows, lambda x: F.struct(x["at"].alias("at"), (x["n"] * _sigmoid(_logit(weights, x["at"]))).alias("true"), x["n"].alias("n"))
        )
        true, total = _sums(scored, PRIORS, lambda x: x["true"]), _sums(scored, PRIORS, lambda x: x["n"])
        all_true = F.aggregate(scored, F.lit(0.0), lambda a, x: a + x["true"])
        every = F.aggregate(scored, F.lit(0.0), lambda a, x: a + x["n"])
        votes = 3 * len(LABELERS)
        odds = F.transform(
            F.arrays_zip(true.alias("t"), total.alias("n")),
            lambda x, i: F.log((x["t"] + 1) / (x["n"] - x["t"] + 1)) - F.when(i < votes, F.log((all_true + 3) / (every - all_true + 3))).otherwise(0.0),
        )
        return F.concat(odds, F.array(*[F.lit(0.0)] * (PLACES - PRIORS)))

    return F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), F.array(*[F.lit(x) for x in begin]), step)


def fitted_classifier(rows: Column, odds: Column, steps: int = 60, ridge: float = 1.0) -> Column:
    """Weights of a logistic model on the places, trained on the patterns' probabilities by damped Newton steps."""
    aims = F.transform(rows, lambda x: F.struct(x["at"].alias("at"), x["n"].alias("n"), _sigmoid(_logit(odds, x["at"])).alias("aim")))

    def step(weights: Column, _: Column) -> Column:
        now = F.transform(aims, lambda x: F.struct(x["at"].alias("at"), x["n"].alias("n"), x["aim"].alias("aim"), _sigmoid(_logit(weights, x["at"])).alias("p")))
        slope = _sums(now, PLACES, lambda x: x["n"] * (x["aim"] - x["p"]))
        bend = _sums(now, PLACES, lambda x: x["n"] * x["p"] * (1 - x["p"]))
        moves = F.arrays_zip(weights.alias("w"), slope.alias("g"), bend.alias("h"))
        return F.transform(moves, lambda m: m["w"] + (m["g"] - ridge * m["w"]) / ((len(LABELERS) + 2) * (m["h"] + ridge)))

    return F.aggregate(F.sequence(F.lit(1), F.lit(steps)), F.array(*[F.lit(0.0)] * PLACES), step)


def train_classifier(patterns: DataFrame) -> list[float]:
    """Weights of the span classifier, in one query over the table of vote patterns; all 0 without candidates."""
    rows = patterns.select(F.struct(F.col("n").cast("double").alias("n"), marks(F.col).alias("at")).alias("r"))
    one = materialise(rows.agg(F.sort_array(F.collect_list("r")).alias("rows")), "pii-votes")
    odds = materialise(one.select("rows", reliabilities(F.col("rows")).alias("odds")), "pii-reliabilities")
    return list(odds.select(fitted_classifier(F.col("rows"), F.col("odds"))).head()[0])


def find_pii(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", threshold: float = 0.5) -> DataFrame:
    """doc_id, spans (kind, start, end, base) of every document row, by start and then kind as listed in ``KINDS``.

    Positions are code points, ends exclusive. NULL and empty texts have no spans; ids may be NULL or repeated; only
    the two named columns are read. The texts are read once, candidates are written to the shared folder, and training
    sees only the table of vote patterns.
    """
    spans = materialise(candidates(documents, doc_id, text), "pii-candidates")
    patterns = materialise(vote_patterns(spans), "pii-patterns")
    weights = F.array(*[F.lit(w) for w in train_classifier(patterns)])

    def kept(s: Column) -> Column:
        return s["base"] | (_sigmoid(_logit(weights, marks(lambda n: s[n]))) >= threshold)

    order = lambda s: F.array_position(F.array(*[F.lit(k) for k in KINDS]), s["kind"])
    rows = F.transform(
        F.filter("spans", kept),
        lambda s: F.struct(s["start"].alias("start"), order(s).alias("at"), s["end"].alias("end"), s["kind"].alias("kind"), s["base"].alias("base")),
    )
    out = F.transform(F.array_sort(rows), lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["base"].alias("base")))
    return spans.select("doc_id", out.alias("spans"))


def pii_digest(found: DataFrame) -> DataFrame:
    """Counts of the base kinds, digest of the base spans, all spans as text."""
    base = F.filter("spans", lambda s: s["base"])
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    count = lambda kind: F.size(F.filter(base, lambda s: s["kind"] == kind)).cast("long")
    return found.select(
        "doc_id",
        *[count(k).alias(f"n_{k}") for k in BASE_KINDS],
        F.sha2(joined(base), 256).alias("base_sha256"),
        joined(F.col("spans")).alias("spans"),
    )
