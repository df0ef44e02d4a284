"""Personal data by weak supervision, in DataFrame functions only.

Every text gives candidate spans: the four base patterns, whose matches always stay, and looser ones. Labelers vote on
each candidate, yes, no or not at all: one checks its form, one looks it up in short gazetteers, two read the words
around it, one looks at the characters it touches. Expectation-maximisation over the counts of vote combinations
estimates how reliable each labeler is and how likely each candidate is personal data. A final classifier of the spans,
naive Bayes over kind, form and votes, is trained on those likelihoods and decides on the looser candidates.

Texts are read once. What is counted over the corpus is a table of vote combinations, which has a fixed largest size.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from assayer.session import cut

# Base patterns. They find the same matches as the plain forms in the comments, without trying a run of characters
# from each of its positions: a match can only begin where a run begins or where the last match ended.
BASE = {
    # [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    # [0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    # [0-9]([\x20-]?[0-9])+ of 14 to 19 digits; a match is a whole run of digits with single separators
    "card": r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){13,18}+(?![ -]?[0-9])",
    # \+[0-9][\x20().0-9-]+[0-9]
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
# A cheap look for texts that can hold a match at all.
HINT = {"email": r"@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9](?:[ -]?[0-9]){13}", "phone": r"\+[0-9]"}
OCTET = r"0*+(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])?"

# Looser candidates.
LOOSE = {
    "email": r"[A-Za-z0-9._%+-]{1,64} ?[\[(]at[\])] ?[A-Za-z0-9-]{1,63}(?: ?(?:[\[(]dot[\])]|\.) ?[A-Za-z0-9-]{1,63}){1,4}",
    "phone": r"(?<![0-9+.-])\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9.-]?[0-9])",
    "id": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?![A-Za-z0-9])",
    "name": r"(?<![A-Za-z])(?:Mr|Mrs|Ms|Dr|Prof)\.? [A-Z][a-z]{1,30}(?: [A-Z][a-z]{1,30})?(?![a-z])",
}
LOOSE_HINT = r"[\[(]at[\])]|[0-9]{3}[ .)-]|[A-Z]{2}[0-9]{2}|(?:Mrs?|Ms|Dr|Prof)\.? [A-Z]"
KINDS = ["email", "ip", "card", "phone", "id", "iban", "name"]

# Gazetteers: mail providers and endings, common given names, country calling codes, card issuers.
MAIL = r"(?i)(?:gmail|yahoo|hotmail|outlook|icloud|aol|gmx|web|proton|protonmail|mail)[0-9]*\.|\.(?:com|org|net|edu|gov|de|fr|es|uk|io)$"
GIVEN = r"(?i)\b(?:james|mary|john|anna|robert|maria|michael|laura|david|sarah|peter|julia|thomas|emma|paul|marie|hans|jean|jose|carmen)\b"
CALLING = r"^\+(?:1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58])"
ISSUER = r"^(?:4|5[1-5]|2[2-7]|3[47]|6(?:011|5))"
FOR = r"(?i)\b(?:e-?mail|contact|phone|tel|telephone|call|fax|mobile|card|visa|mastercard|credit|ssn|iban|account|address|host|server|ip|write|name|born|telefon|karte|adresse|correo|telefono|tarjeta|courriel|carte)\b"
AGAINST = r"(?i)\b(?:version|release|isbn|issn|figure|table|chapter|section|page|order|invoice|sku|total|sum|example|sample|test|doi|part|model)\b"
AROUND = 40  # characters of context on either side

LABELERS = ["form", "gazetteer", "for", "against", "touching"]
ROUNDS = 12
ACCEPT = 0.5
SMALLEST = 1e-3  # no labeler is taken to be surer than this


CHUNK = 128  # matches whose places are added up together

PIECES = "array<struct<skip:int,size:int,value:string,before:string,after:string>>"
SPANS = "array<struct<start:int,end:int,kind:string,value:string,before:string,after:string>>"


def pieces(text: Column, pattern: str, hint: str) -> Column:
    """Every match of a pattern with its length, the number of characters since the last one, and what stands beside it."""
    # what stands between the matches, and the matches, give every place
    gaps, matches = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    beside = F.zip_with(gaps, F.slice(gaps, F.lit(2), F.lit(1 << 30)), lambda g, h: F.struct(g.alias("g"), h.alias("h")))
    # one more gap than matches; the last pair has no match
    pairs = F.zip_with(beside, matches, lambda z, v: F.struct(
        F.length(z["g"]).alias("skip"), F.length(v).alias("size"), v.alias("value"),
        F.right(z["g"], F.lit(AROUND)).alias("before"), F.left(z["h"], F.lit(AROUND)).alias("after")))
    return F.when(text.rlike(hint), F.filter(pairs, lambda x: x["value"].isNotNull())).otherwise(F.array().cast(PIECES))


def placed(column: str, kind: str) -> Column:
    """The pieces in a column as spans; characters, end exclusive.

    A place is a sum over all matches before. Adding up chunk by chunk keeps a text with very many matches from being
    copied as many times.
    """
    last = F.floor((F.size(column) - 1) / CHUNK).cast("int")
    chunks = F.transform(F.sequence(F.lit(0), last), lambda c: F.slice(F.col(column), c * CHUNK + 1, F.lit(CHUNK)))
    lengths = F.transform(chunks, lambda chunk: F.aggregate(chunk, F.lit(0), lambda n, x: n + x["skip"] + x["size"]))
    begins = F.aggregate(
        lengths, F.array(F.lit(0)), lambda acc, n: F.concat(acc, F.array(F.element_at(acc, -1) + n)))

    def add(acc: Column, x: Column) -> Column:
        start = acc["at"] + x["skip"]
        span = F.struct(start.alias("start"), (start + x["size"]).alias("end"), F.lit(kind).alias("kind"), x["value"].alias("value"),
                        x["before"].alias("before"), x["after"].alias("after"))
        return F.struct((start + x["size"]).alias("at"), F.concat(acc["out"], F.array(span)).alias("out"))

    none = F.array().cast(SPANS)
    each = F.zip_with(chunks, F.slice(begins, F.lit(1), F.size(chunks)), lambda chunk, begin: F.aggregate(
        chunk, F.struct(begin.alias("at"), none.alias("out")), add, lambda acc: acc["out"]))
    return F.when(F.size(column) > 0, F.flatten(each)).otherwise(none)


def luhn(digits: Column) -> Column:
    """Whether the check digit is right."""
    values = F.transform(F.split(F.reverse(digits), ""), lambda d: d.cast("int"))
    doubled = F.transform(values, lambda d, i: F.when(i % 2 == 0, d).when(d > 4, d * 2 - 9).otherwise(d * 2))
    return F.aggregate(doubled, F.lit(0), lambda a, d: a + d) % 10 == 0


def digits_of(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def valid(kind: str, value: Column) -> Column:
    """What a match of a base pattern has to fulfil besides."""
    digits = digits_of(value)
    if kind == "ip":
        return value.rlike(rf"^{OCTET}(?:\.{OCTET}){{3}}$")
    if kind == "card":
        return luhn(digits)
    if kind == "phone":
        return F.length(digits).between(10, 15)
    return F.lit(True)


def spans_of_texts(docs: DataFrame, text: str, doc_id: str) -> DataFrame:
    """doc_id, base spans, and all candidates with their votes, written once so that texts are read once."""
    body = F.coalesce(F.col(text), F.lit(""))
    # each step is written, so that what several places of the next one name is computed once; few texts hold any piece
    read = cut(docs.select(
        F.col(doc_id).alias("doc_id"), *[pieces(body, p, HINT[k]).alias(f"base_{k}") for k, p in BASE.items()],
        *[pieces(body, p, LOOSE_HINT).alias(f"loose_{k}") for k, p in LOOSE.items()]))
    spans = cut(read.select(
        "doc_id", *[placed(f"base_{k}", k).alias(f"base_{k}") for k in BASE],
        F.concat(*[placed(f"loose_{k}", k) for k in LOOSE]).alias("loose")))
    base = cut(spans.select("doc_id", F.concat(*[_valid_only(k) for k in BASE]).alias("base"), "loose"))
    free = F.filter("loose", lambda s: ~F.exists("base", lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"])))
    voted = F.concat(F.transform("base", lambda s: _voted(s, True)), F.transform(free, lambda s: _voted(s, False)))
    return cut(base.select("doc_id", voted.alias("spans")))


def _valid_only(kind: str) -> Column:
    return F.filter(f"base_{kind}", lambda s: valid(kind, s["value"])) if kind != "email" else F.col("base_email")


def of_kind(spans: str, kind: str) -> Column:
    return F.filter(spans, lambda s: s["kind"] == kind)


def _voted(span: Column, base: bool) -> Column:
    """A span with its votes: 1 for personal data, 0 against, 2 for no opinion."""
    value, kind = span["value"], span["kind"]
    context = F.concat(span["before"], F.lit(" "), span["after"])
    touching = F.concat(F.right(span["before"], F.lit(1)), F.left(span["after"], F.lit(1)))
    form = (
        F.when(F.lit(base), 1)
        .when(kind == "iban", F.when(F.length(F.regexp_replace(value, " ", "")).between(15, 34), 2).otherwise(0))
        .when(kind == "id", F.when(value.rlike(r"^(?:000|666|9)|-00-|-0000$"), 0).otherwise(2))
        .otherwise(2))
    listed = (
        ((kind == "email") & value.rlike(MAIL)) | ((kind == "name") & value.rlike(GIVEN))
        | ((kind == "phone") & value.rlike(CALLING)) | ((kind == "card") & digits_of(value).rlike(ISSUER)))
    return F.struct(
        span["start"].alias("start"), span["end"].alias("end"), kind.alias("kind"), F.lit(base).alias("base"),
        form.cast("int").alias("form"), F.when(listed, 1).otherwise(2).cast("int").alias("gazetteer"),
        F.when(context.rlike(FOR), 1).otherwise(2).cast("int").alias("for"),
        F.when(context.rlike(AGAINST), 0).otherwise(2).cast("int").alias("against"),
        F.when(touching.rlike(r"[A-Za-z0-9/_]"), 0).otherwise(1).cast("int").alias("touching"),
    )


Rates = dict[str, tuple[float, float]]


def posterior(votes: dict, share: float, rates: Rates) -> float:
    """How likely a candidate with these votes is personal data."""
    odds = math.log(share / (1 - share))
    for labeler, (yes, other) in rates.items():
        if votes[labeler] == 1:
            odds += math.log(yes / other)
        elif votes[labeler] == 0:
            odds += math.log((1 - yes) / (1 - other))
    return 1 / (1 + math.exp(-odds))


def reliabilities(patterns: list[dict], rounds: int = ROUNDS) -> tuple[float, Rates]:
    """The share of personal data, and of each labeler the chance to vote yes, if it votes, on such data and on other.

    Expectation-maximisation. `patterns` holds a count n for every combination of votes and kind, a few hundred at most.
    """
    share, rates = 0.5, {labeler: (0.8, 0.2) for labeler in LABELERS}
    total = sum(row["n"] for row in patterns)
    for _ in range(rounds if total else 0):
        likely = [posterior(row, share, rates) for row in patterns]
        share = min(max(sum(row["n"] * p for row, p in zip(patterns, likely)) / total, SMALLEST), 1 - SMALLEST)
        for labeler in LABELERS:
            sides = []
            # one imagined vote on each side keeps the rates off 0 and 1
            for weights, prior in (likely, 0.8), ([1 - p for p in likely], 0.2):
                yes, no = (sum(r["n"] * w for r, w in zip(patterns, weights) if r[labeler] == vote) for vote in (1, 0))
                sides.append((yes + prior) / (yes + no + 1))
            rates[labeler] = (sides[0], sides[1])
    return share, rates


def span_classifier(patterns: list[dict], share: float, rates: Rates) -> dict[str, float]:
    """Naive Bayes: log odds of every feature value, from counts weighted by the likelihoods; `prior` is that of all."""
    counts: dict[str, list[float]] = {}
    totals = [1.0, 1.0]
    for row in patterns:
        p = posterior(row, share, rates)
        for side, n in enumerate((row["n"] * p, row["n"] * (1 - p))):
            totals[side] += n
            for c in ("kind", *LABELERS):
                counts.setdefault(f"{c}={row[c]}", [1.0, 1.0])[side] += n
    odds = {feature: math.log(yes / (totals[0] + 1)) - math.log(no / (totals[1] + 1)) for feature, (yes, no) in counts.items()}
    return odds | {"prior": math.log(totals[0] / totals[1])}


def personal_data(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row per input row: doc_id and spans, an array of (start, kind_rank, end, kind, base, likely) in order.

    Null counts as the empty text, which has no spans. Repeated rows give repeated rows, an empty table an empty result;
    other columns are not read.
    """
    rows = spans_of_texts(docs, text, doc_id)
    counted = rows.select(F.explode("spans").alias("s")).select("s.*").groupBy("kind", *LABELERS).agg(F.count(F.lit(1)).alias("n"))
    patterns = [r.asDict() for r in counted.orderBy("kind", *LABELERS).collect()]  # a row per combination of votes
    share, rates = reliabilities(patterns)
    odds = span_classifier(patterns, share, rates)

    def likely(s: Column) -> Column:
        value = F.lit(odds["prior"])
        for c in ["kind", *LABELERS]:
            for key, weight in odds.items():
                if key.startswith(f"{c}="):
                    value = value + F.when(s[c].cast("string") == key.partition("=")[2], weight).otherwise(0.0)
        return 1 / (1 + F.exp(-value))

    rank = F.create_map(*[x for i, k in enumerate(KINDS) for x in (F.lit(k), F.lit(i))])
    judged = F.transform("spans", lambda s: F.struct(
        s["start"].alias("start"), F.element_at(rank, s["kind"]).alias("kind_rank"), s["end"].alias("end"),
        s["kind"].alias("kind"), s["base"].alias("base"), likely(s).alias("likely")))
    kept = F.filter(judged, lambda s: s["base"] | (s["likely"] >= ACCEPT))
    return rows.select("doc_id", F.array_sort(kept).alias("spans"))


def written(spans: Column) -> Column:
    """kind:start:end of each span, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def summary(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, counts of the base kinds, base_sha256 and all spans as text."""
    rows = personal_data(docs, text, doc_id)
    base = F.filter("spans", lambda s: s["base"])
    rows = rows.withColumn("_base", base)
    counts = [F.size(of_kind("_base", k)).cast("long").alias(f"n_{k}") for k in BASE]
    return rows.select(
        "doc_id", *counts, F.sha2(written(F.col("_base")), 256).alias("base_sha256"), written(F.col("spans")).alias("spans"))
