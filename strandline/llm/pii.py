"""Personal data by weak supervision: patterns propose spans, labelers vote, a trained classifier decides.

Candidates come from wide and narrow patterns.  Four labelers look at each: a strict form (a regular
expression, a checksum or a range), a gazetteer (domains, country codes, card issuers), words of the
context, and the characters next to the span.  Expectation-maximisation over the counts of all vote
patterns of the corpus estimates how reliable each labeler is for each kind, without labels; a logistic
span classifier is then trained on the resulting probabilities and applied to every candidate.

Spans of the base rules are kept whatever the votes; the classifier adds others that overlap none.
Only counts of vote patterns reach the driver, at most KINDS x 3^4 x 4 rows whatever the corpus.
Everything on the executors is DataFrame functions.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import folds
from .common import let, stored

KINDS = ("email", "ip", "card", "phone")
LABELERS = ("form", "gazetteer", "context", "edges")

# Patterns.  Possessive and anchored so that no text makes them slow: an attempt starts only where a run
# of its first character class starts, or right after the last match.
_LOCAL = "[A-Za-z0-9._%+-]"
EMAIL = rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"(?:\G|(?<![0-9]))[0-9](?:[\x20-]?[0-9]){13,}+"  # shorter chains of digits can't pass
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
SPELT_EMAIL = rf"(?<!{_LOCAL}){_LOCAL}++ ?[\[({{] ?(?i:at) ?[\])}}] ?[A-Za-z0-9-]++(?: ?(?:\.|[\[({{] ?(?i:dot) ?[\])}}]) ?[A-Za-z0-9-]++)++"
GROUPED_CARD = r"(?<![0-9])(?:[0-9]{4}([ -]?)[0-9]{4}\1[0-9]{4}\1[0-9]{4}|3[47][0-9]{2}([ -]?)[0-9]{6}\2[0-9]{5})(?![0-9])"
NATIONAL_PHONE = r"(?<![0-9+])(?:\+?[0-9]{1,3}[ .-])?\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9])"
SHORT_INTERNATIONAL = r"\+[0-9]{1,3}[ .-]?\(?[0-9]{2,4}\)?[ .-][0-9]{3,4}[ .-][0-9]{3,4}(?![0-9])"

# What each pattern finds, and the cheap test that must hold before it is tried.
SOURCES = (
    ("email", True, EMAIL, "@"),
    ("ip", True, IP, "[0-9]\\.[0-9]"),
    ("card", True, CARD, "[0-9]{2}|[0-9][ -][0-9]"),
    ("phone", True, PHONE, "\\+[0-9]"),
    ("email", False, SPELT_EMAIL, "(?i)[\\[({] ?at ?[\\])}]"),
    ("card", False, GROUPED_CARD, "[0-9]{4}"),
    ("phone", False, SHORT_INTERNATIONAL, "\\+[0-9]"),
    ("phone", False, NATIONAL_PHONE, "[0-9]{3}[ .-][0-9]{4}"),
)

# Gazetteers and context words.
TLDS = "com|org|net|edu|gov|mil|int|info|biz|io|dev|app|ai|co|me|tv|eu|uk|us|ca|au|nz|de|at|ch|fr|be|lu|nl|es|pt|it|pl|se|no|dk|fi|ie|jp|cn|kr|in|br|mx|ar|cl|ru|za|example|test"
COUNTRY_CODES = "1|7|20|27|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]"
ISSUERS = "4|5[1-5]|2[2-7]|3[47]|3[068]|6(?:011|4[4-9]|5)|35|62"
UNROUTED = "0|10|127|22[4-9]|23[0-9]|24[0-9]|25[0-5]"
FOR_IT = {
    "email": "mail|contact|kontakt|contacto|courriel|correo|write|reach|address",
    "ip": "\\bip\\b|host|server|serveur|servidor|client|login|address|adresse|from",
    "card": "card|visa|master|amex|credit|karte|carte|tarjeta|payment",
    "phone": "phone|tel|call|fax|mobile|handy|ruf|appel|llam|contact",
}
AGAINST_IT = {
    "email": "package|import|version",
    "ip": "version|section|chapter|release|build|oid|v\\.?$",
    "card": "isbn|serial|order|invoice|tracking|hash|id[:= #]*$",
    "phone": "isbn|version|serial|order|score",
}


@dataclass(frozen=True)
class Model:
    """Weights of the span classifier by feature name; reliabilities are kept to be looked at."""

    weights: dict
    reliabilities: dict


def find(text: Column, pattern: str, test: str) -> Column:
    """All matches as array<struct<start, text, before, after>>, from the pieces between them."""
    kind = "struct<start:int,text:string,before:string,after:string>"
    none = F.array().cast(f"array<{kind}>")

    def place(found: Column) -> Column:
        return F.when(F.size(found) == 0, none).otherwise(let(F.split(text, F.lit(pattern), F.lit(-1)), lambda pieces: walk(found, pieces)))

    def walk(found: Column, pieces: Column) -> Column:
        start = F.struct(F.lit(0).alias("at"), folds.nothing(kind).alias("out"))

        def step(acc: Column, x: Column) -> Column:
            begun = acc["at"] + F.length(x["piece"])
            hit = F.struct(begun.alias("start"), x["found"].alias("text"), F.right(x["piece"], F.lit(40)).alias("before"), F.left(x["next"], F.lit(12)).alias("after"))
            return F.struct((begun + F.length(x["found"])).alias("at"), folds.push(acc["out"], hit).alias("out"))

        n = F.size(found)
        rows = F.arrays_zip(F.slice(pieces, 1, n).alias("piece"), found.alias("found"), F.slice(pieces, 2, n).alias("next"))
        return F.aggregate(rows, start, step, lambda acc: folds.gathered(acc["out"]))

    tried = text.contains(test) if test == "@" else text.rlike(test)
    return F.when(tried, let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), place)).otherwise(none)


def luhn(digits: Column) -> Column:
    """Whether a string of at least one digit passes the checksum."""
    n = F.length(digits)

    def worth(k: Column) -> Column:
        d = F.substring(digits, n - k, F.lit(1)).cast("int")
        return F.when(k % 2 == 0, d).when(d > 4, d * 2 - 9).otherwise(d * 2)

    return F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), lambda s, k: s + worth(k)) % 10 == 0


def valid(kind: str, text: Column) -> Column:
    """The base rule's check of a match."""
    digits = F.regexp_replace(text, "[^0-9]", "")
    if kind == "ip":
        part = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
        return text.rlike(rf"^(?:{part}\.){{3}}{part}$")
    if kind == "card":
        return F.when(F.length(digits).between(14, 19), luhn(digits)).otherwise(False)
    return F.length(digits).between(10, 15) if kind == "phone" else F.lit(True)


def votes(kind: str, c: Column) -> Column:
    """The four labelers' votes on a candidate: 1 for, -1 against, 0 none; then a bucket of its length."""
    text, near = c["text"], F.lower(F.concat(c["before"], F.lit(" "), c["after"]))
    digits = F.regexp_replace(text, "[^0-9]", "")
    yes = lambda test: F.when(test, 1).otherwise(-1)
    if kind == "email":
        plain = F.lower(F.regexp_replace(F.regexp_replace(text, "(?i) ?[\\[({] ?at ?[\\])}] ?", "@"), "(?i) ?[\\[({] ?dot ?[\\])}] ?", "."))
        form, known = yes(plain.rlike(r"^[a-z0-9][a-z0-9._%+-]*@(?:[a-z0-9](?:[a-z0-9-]*[a-z0-9])?\.)+[a-z]{2,}$")), yes(plain.rlike(rf"\.(?:{TLDS})$"))
    elif kind == "ip":
        form, known = yes(valid("ip", text) & ~text.rlike(r"(?:^|\.)0[0-9]")), F.when(text.rlike(rf"^(?:{UNROUTED})\."), -1).otherwise(1)
    elif kind == "card":
        form = yes(F.when(F.length(digits).between(13, 19), luhn(digits)).otherwise(False))
        known = yes(digits.rlike(f"^(?:{ISSUERS})"))
    else:
        form = yes(F.length(digits).between(10, 15))
        known = yes(F.when(text.startswith("+"), digits.rlike(f"^(?:{COUNTRY_CODES})")).otherwise(digits.rlike("^1?[2-9][0-9]{2}")))
    context = F.when(near.rlike(AGAINST_IT[kind]), -1).when(near.rlike(FOR_IT[kind]), 1).otherwise(0)
    edges = F.when(c["before"].rlike(r"[\p{L}\p{N}_@/=-]$") | c["after"].rlike(r"^[\p{L}\p{N}_@/=]"), -1).otherwise(1)
    bucket = F.least(F.floor(F.length(text) / 8).cast("int"), F.lit(3))
    return F.array(form, known, context, edges, bucket)


def candidates(docs: DataFrame) -> DataFrame:
    """doc_id and its array ``c`` of candidates: struct<kind, start, end, base, votes>, by start, kind, base first."""
    text = F.coalesce(F.col("text"), F.lit(""))

    def told(kind: str, base: bool):
        def one(c: Column) -> Column:
            ok = valid(kind, c["text"]) if base else F.lit(False)
            return F.struct(
                c["start"].alias("start"), F.lit(KINDS.index(kind)).alias("kind"), (~ok).alias("extra"),
                (c["start"] + F.length(c["text"])).alias("end"), votes(kind, c).alias("votes"),
            )

        return one

    every = [F.transform(find(text, p, test), told(kind, base)) for kind, base, p, test in SOURCES]
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.array_sort(F.array_distinct(F.concat(*every))).alias("c"))


def _feature_names(kind: int, v: list[int]) -> list[str]:
    return ["bias", f"kind{kind}", f"len{v[4]}", *(f"{LABELERS[k]}{v[k]}" for k in range(4)), f"kind{kind}:form{v[0]}"]


def estimate(counts: list[tuple[int, list[int], int]], rounds: int = 40) -> tuple[dict, dict]:
    """Expectation-maximisation for each kind: (kind, votes) -> probability, and the labelers' reliabilities.

    Two classes; given the class, labelers vote independently.  Begins from labelers that are right more
    often than not, with pseudo-counts of the same, so the classes keep their meaning.
    """
    begin = {True: {1: 0.6, 0: 0.3, -1: 0.1}, False: {1: 0.15, 0: 0.3, -1: 0.55}}
    prob, trust = {}, {}
    for kind in sorted({k for k, _, _ in counts}):
        own = sorted((tuple(v), n) for k, v, n in counts if k == kind)
        share, says = 0.5, [{y: dict(begin[y]) for y in begin} for _ in LABELERS]
        for _ in range(rounds):
            sums, total, tally = 0.0, 0.0, [{y: {x: 4 * p for x, p in begin[y].items()} for y in begin} for _ in LABELERS]
            for v, n in own:
                a = share * math.prod(says[k][True][v[k]] for k in range(4))
                b = (1 - share) * math.prod(says[k][False][v[k]] for k in range(4))
                p = prob[kind, v] = a / (a + b)
                sums, total = sums + n * p, total + n
                for k in range(4):
                    tally[k][True][v[k]] += n * p
                    tally[k][False][v[k]] += n * (1 - p)
            share = (sums + 1) / (total + 2)
            says = [{y: {x: c / sum(t[y].values()) for x, c in t[y].items()} for y in t} for t in tally]
        trust[KINDS[kind]] = {LABELERS[k]: {"for": says[k][True][1], "false alarm": says[k][False][1]} for k in range(4)}
    return prob, trust


def train(counts: list[tuple[int, list[int], int]], steps: int = 400, ridge: float = 1e-3) -> Model:
    """The classifier: logistic regression on the estimated probabilities, by gradient steps over the counted patterns."""
    prob, trust = estimate(counts)
    rows = [(_feature_names(k, v), prob[k, tuple(v)], math.log1p(n)) for k, v, n in sorted(counts, key=lambda c: (c[0], c[1]))]
    weights = {name: 0.0 for names, _, _ in rows for name in names}
    total = sum(n for _, _, n in rows) or 1.0
    for _ in range(steps):
        grad = {name: -ridge * w for name, w in weights.items()}
        for names, p, n in rows:
            z = sum(weights[x] for x in names)
            err = n / total * (p - 1 / (1 + math.exp(-max(-50.0, min(50.0, z)))))
            for x in names:
                grad[x] += err
        for x in weights:
            weights[x] += 2.0 * grad[x]
    return Model(weights, trust)


def fit(found: DataFrame) -> Model:
    """Learn from the candidates of the whole corpus; from none the model takes nothing."""
    one = found.select(F.explode("c").alias("c"))
    counts = one.groupBy("c.kind", "c.votes").agg(F.count("*").alias("n")).collect()  # bounded: see above
    return train([(r.kind, list(r.votes), r.n) for r in counts])


def wanted(c: Column, model: Model) -> Column:
    """Whether the classifier takes a candidate; no votes outweigh a failed form, such as a wrong checksum."""
    w, z = model.weights, F.lit(model.weights.get("bias", -1.0))
    for k in range(len(KINDS)):
        z = z + F.when(c["kind"] == k, F.lit(w.get(f"kind{k}", 0.0))).otherwise(0.0)
        for x in (-1, 1):
            z = z + F.when((c["kind"] == k) & (c["votes"][0] == x), F.lit(w.get(f"kind{k}:form{x}", 0.0))).otherwise(0.0)
    for k in range(4):
        z = z + F.when(c["votes"][4] == k, F.lit(w.get(f"len{k}", 0.0))).otherwise(0.0)
        for x in (-1, 0, 1):
            z = z + F.when(c["votes"][k] == x, F.lit(w.get(f"{LABELERS[k]}{x}", 0.0))).otherwise(0.0)
    return (c["votes"][0] == 1) & (z >= 0)


def spans(docs: DataFrame) -> DataFrame:
    """doc_id, base, spans of every row: arrays of struct<start, kind, end>, by start and kind.

    ``base`` has the base rules' spans; ``spans`` adds those the classifier takes that overlap no base
    span and no earlier added one of their kind.  A null text is empty; texts without candidates have
    empty arrays; repeated rows stay and each counts in training; other columns are ignored.
    """
    found = stored(candidates(docs), "pii-candidates")
    model = fit(found)

    def over(a: Column, b: Column) -> Column:
        return (a["kind"] == b["kind"]) & (a["start"] < b["end"]) & (b["start"] < a["end"])

    def choose(c: Column) -> Column:
        return let(F.filter(c, lambda x: ~x["extra"]), lambda base: let(F.filter(c, lambda x: x["extra"] & wanted(x, model) & ~F.exists(base, lambda b: over(x, b))), lambda more: both(base, more)))

    def both(base: Column, more: Column) -> Column:
        short = lambda x: F.struct(x["start"].alias("start"), x["kind"].alias("kind"), x["end"].alias("end"))
        ahead = lambda x, y: (y["start"] < x["start"]) | ((y["start"] == x["start"]) & (y["end"] > x["end"]))
        added = F.filter(more, lambda x: ~F.exists(more, lambda y: over(x, y) & ahead(x, y)))
        return F.struct(F.transform(base, short).alias("base"), F.array_sort(F.array_distinct(F.concat(F.transform(base, short), F.transform(added, short)))).alias("spans"))

    return found.select("doc_id", let(F.col("c"), choose).alias("s")).select("doc_id", "s.base", "s.spans")


def digest(found: DataFrame) -> DataFrame:
    """doc_id, counts of base spans by kind, digest of the base spans, and all spans in words."""
    names = F.array(*map(F.lit, KINDS))
    said = lambda spans: F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["start"], x["end"])), ",")
    count = lambda k: F.size(F.filter("base", lambda x: x["kind"] == k)).cast("long")
    return found.select("doc_id", *(count(k).alias(f"n_{kind}") for k, kind in enumerate(KINDS)), F.sha2(said(F.col("base")).cast("binary"), 256).alias("base_sha256"), said(F.col("spans")).alias("spans"))
