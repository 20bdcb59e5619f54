"""Personal data in whole texts by weak supervision, on DataFrame and SQL functions only.

1. One scan finds candidates: matches of the base patterns, and of wider patterns (local
   phone numbers, spelled-out mail addresses, 13 to 15 digit cards, IPv6, values given to a
   name like ``token``).
2. Labelers vote +1, 0 or -1 on every candidate: the base pattern, a check of its form
   (Luhn sum, octets, digit counts, letters mixed with digits), a gazetteer of what exists
   (top-level domains, networks, card issuers, calling codes, names of secrets), cue words
   before it in four languages, and its surroundings.
3. The votes are counted per pattern of votes, at most a few hundred rows whatever the input.
   Expectation-maximisation over that table estimates each labeler's reliability per kind
   and the probability of every pattern; no vote is taken on trust.
4. A logistic span classifier is fitted to those probabilities and scores the candidates.

Base matches that pass their check always stay; the classifier decides on the others, and an
added span never overlaps a base one.  Positions are code points, end exclusive: the texts
between matches (``split``) and the matches (``regexp_extract_all``) alternate, so their
lengths add up to positions without any per-row code.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tables import stored

KINDS = ("email", "ip", "card", "phone")
#: kinds that only the method finds come last
ALL_KINDS = (*KINDS, "secret")
#: added spans need this probability
THRESHOLD = 0.9
SMOOTH = 1.0

# The base patterns.  Written without backtracking over long runs: a run that
# failed from its first character fails from every later one, so only run starts (or the end
# of the match before, \G) are tried.
_LOCAL = "A-Za-z0-9._%+-"
BASE = {
    "email": rf"(?:(?<![{_LOCAL}])|\G)[{_LOCAL}]++@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    # a whole chain of digits with single blanks or hyphens, of 16 to 19 digits
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?+[0-9]){15,18}+(?![\x20-]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: what a text must hold before a pattern is tried, at little cost
NEEDED = {"email": "@", "ip": ".", "card": None, "phone": "+"}

# Names of secrets.
SECRETS = "token|secret|passw(?:or)?d|passphrase|api[_-]?key|access[_-]?key|secret[_-]?key|private[_-]?key|client[_-]?secret|bearer"
# Wider patterns.
WIDE = {
    "email": r"(?<![\p{L}0-9._%+-])[\p{L}0-9._%+-]++\x20?[(\[]at[)\]]\x20?[\p{L}0-9-]++(?:\x20?(?:\.|[(\[]dot[)\]])\x20?[\p{L}0-9-]++)++",
    "ip": r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])",
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?+[0-9]){12,14}+(?![\x20-]?[0-9])",
    "phone": r"(?<![0-9+(.-])(?<!\)\x20)(?:\([0-9]{3}\)\x20?|[0-9]{3}[-.\x20])[0-9]{3}[-.\x20][0-9]{4}(?![0-9])",
    # what stands behind a name and = or :, in quotes or not
    "secret": r"(?<=[A-Za-z]\x20{0,2}[=:]\x20{0,2}[\x22']?)(?<![A-Za-z0-9+/_.=-])[A-Za-z0-9+/_.-]{16,}+={0,2}",
}
WIDE_NEEDED = {"email": "at", "ip": ":", "card": None, "phone": None, "secret": "[=:]"}

# The gazetteer.  Frequent top-level domains, networks that name no one's host,
# first digits of card issuers, and calling codes.
DOMAINS = "com|org|net|edu|gov|mil|int|info|biz|io|ai|app|dev|eu|uk|us|ca|au|nz|de|at|ch|fr|be|nl|lu|es|pt|it|ie|dk|se|no|fi|pl|cz|hu|gr|ru|ua|tr|il|in|cn|jp|kr|tw|hk|sg|za|br|mx|ar|cl|co|pe|ve"
NO_HOST = r"^0*(?:0|127|255|22[4-9]|23[0-9])\."
ISSUERS = "^(?:4|5[0-8]|2[2-7]|3[0-9]|6)"
CALLING = r"^\+\x20?(?:1|7|2(?:0|7|[1-689][0-9])|3(?:[0-469]|[578][0-9])|4(?:[013-9]|2[0-9])|5(?:[1-8]|[09][0-9])|6(?:[0-6]|[789][0-9])|8(?:[1246]|[058][0-9])|9(?:[0-58]|[679][0-9]))"

# Cue words (English, French, German, Spanish).
CUES = {
    "email": "e-?mail|mail|contact|courriel|kontakt|correo|write to",
    "ip": "ip|ipv6|address|adresse|host|server|servidor|serveur",
    "card": "card|visa|mastercard|amex|carte|karte|tarjeta|credit",
    "phone": "phone|tel|telephone|call|mobile|fax|appel|telefon|anruf|llame",
    "secret": SECRETS,
}


#: numbers added up in one go
STRETCH = 256


def running(numbers: Column) -> Column:
    """Sums of the numbers before each one.

    Adding to a growing list copies it, so stretches of the list are summed on their own, each
    behind the sum of the stretches before it.
    """
    zero = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast("array<bigint>").alias("sums"))

    def add(acc, n):
        return F.struct((acc["at"] + n).alias("at"), F.concat(acc["sums"], F.array(acc["at"])).alias("sums"))

    # one-element arrays bind a value once for all the places that use it
    let = lambda value, use: F.get(F.transform(F.array(value), use), F.lit(0))

    def cut(all_):
        starts = F.sequence(F.lit(0), F.floor((F.size(all_) - 1) / STRETCH))
        return F.transform(starts, lambda k: F.aggregate(F.slice(all_, (k * STRETCH + 1).cast("int"), F.lit(STRETCH)), zero, add))

    def put(parts):
        before = F.aggregate(F.transform(parts, lambda p: p["at"]), zero, add)["sums"]
        return let(before, lambda b: F.flatten(F.transform(parts, lambda p, i: let(F.get(b, i), lambda at: F.transform(p["sums"], lambda x: x + at)))))

    return let(let(numbers, cut), put)


def spans_of(text: Column, pattern: str, needed: str | None = None) -> Column:
    """Matches in order: start, end, match, the text before (40 characters) and the next character.

    Only texts in which ``needed`` is found are searched.
    """
    empty = F.array().cast("array<struct<start:int,end:int,match:string,before:string,after:string>>")
    let = lambda value, use: F.get(F.transform(F.array(value), use), F.lit(0))

    def placed(found, between):
        gaps = F.transform(between, F.length)
        sizes = F.zip_with(F.slice(gaps, F.lit(1), F.size(found)), F.transform(found, F.length), lambda a, b: (a + b).cast("bigint"))

        def span(at, i):
            piece, match = F.get(between, i), F.get(found, i)
            start = (at + F.length(piece)).cast("int")
            return F.struct(
                start.alias("start"),
                (start + F.length(match)).alias("end"),
                match.alias("match"),
                F.when(F.length(piece) > 40, F.substring(piece, -40, 40)).otherwise(piece).alias("before"),
                F.substring(F.get(between, i + 1), 1, 1).alias("after"),
            )

        return F.transform(running(sizes), span)

    def walk(found):
        return F.when(F.size(found) > 0, let(F.split(text, pattern, -1), lambda between: placed(found, between))).otherwise(empty)

    spans = let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), walk)
    if needed is None:
        return spans
    told = F.rlike(text, F.lit(needed)) if needed.startswith("[") else F.contains(text, F.lit(needed))
    return F.when(told, spans).otherwise(empty)


def digits_of(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a digit string passes the Luhn sum."""
    at = F.sequence(F.lit(1), F.length(digits))

    def add(total, i):
        digit = F.substring(F.reverse(digits), i, F.lit(1)).cast("int")
        twice = F.when(digit > 4, 2 * digit - 9).otherwise(2 * digit)
        return total + F.when(i % 2 == 0, twice).otherwise(digit)

    return F.aggregate(at, F.lit(0), add) % 10 == 0


def _octets(match: Column) -> Column:
    """Whether every part is at most 255; leading zeros do not count."""
    return F.forall(
        F.split(match, "[.]"),
        lambda p: F.rlike(F.regexp_replace(p, "^0+(?=[0-9])", ""), F.lit("^(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$")),
    )


def passes(kind: str, match: Column) -> Column:
    """The base check of a match."""
    digits = digits_of(match)
    return {
        "email": F.lit(True),
        "ip": _octets(match),
        "card": luhn(digits),
        "phone": F.length(digits).between(8, 15),
        "secret": F.lit(False),
    }[kind]


def _known(kind: str, match: Column, before: Column) -> Column:
    """The gazetteer's vote: whether the candidate names something that exists."""
    yes = lambda pattern: F.rlike(F.lower(match), F.lit(pattern))
    return {
        "email": F.when(yes(rf"[.\x20)\]](?:{DOMAINS})$"), 1).otherwise(0),
        "ip": F.when(F.contains(match, F.lit(":")), 0).otherwise(F.when(yes(NO_HOST), -1).otherwise(1)),
        "card": F.when(yes(ISSUERS), 1).otherwise(-1),
        "phone": F.when(~F.startswith(match, F.lit("+")), 0).otherwise(F.when(yes(CALLING), 1).otherwise(-1)),
        "secret": F.when(F.rlike(F.lower(before), F.lit(rf"(?:^|[^a-z])(?:{SECRETS})\x20{{0,2}}[=:]\x20{{0,2}}[\x22']?$")), 1).otherwise(-1),
    }[kind]


def _form(kind: str, match: Column) -> Column:
    """The form labeler: a check independent of how the candidate was found."""
    digits = digits_of(match)
    return {
        "email": F.rlike(match, F.lit(r"[.)\]]\x20?\p{L}{2,24}$")),
        "ip": F.when(F.contains(match, F.lit(":")), F.lit(True)).otherwise(_octets(match)),
        "card": luhn(digits),
        "phone": F.length(digits).between(10, 15),
        # letters and digits mixed, as chance does it
        "secret": F.rlike(match, F.lit("[0-9][^0-9]+[0-9]")) & F.rlike(match, F.lit("[A-Za-z].*[A-Za-z]")) & ~F.contains(match, F.lit("..")),
    }[kind]


def votes(kind: str, span: Column, base: bool) -> Column:
    """The labelers' votes on one candidate."""
    yes = lambda c: F.when(c, F.lit(1)).otherwise(F.lit(-1))
    cue = F.rlike(F.lower(span["before"]), F.lit(rf"(?:^|[^\p{{L}}])(?:{CUES[kind]})[^\p{{L}}0-9]{{0,3}}(?:\p{{L}}{{2,3}}[^\p{{L}}0-9]{{1,3}})?$"))
    joined = F.lit(False) if kind == "secret" else F.rlike(span["before"], F.lit(r"[0-9=/_#.,:-]$")) | F.rlike(span["after"], F.lit("[0-9=/_#:]"))
    return F.struct(
        F.lit(ALL_KINDS.index(kind)).alias("kind"),
        (yes(passes(kind, span["match"])) if base else F.lit(0)).alias("pattern"),
        yes(_form(kind, span["match"])).alias("form"),
        _known(kind, span["match"], span["before"]).alias("gazetteer"),
        F.when(cue, F.lit(1)).otherwise(F.lit(0)).alias("cue"),
        F.when(joined, F.lit(-1)).otherwise(F.when(F.rlike(F.concat(span["before"], F.lit(" ")), F.lit(r"[\s(|]\s$")) | (F.length(span["before"]) == 0), F.lit(1)).otherwise(F.lit(0))).alias("around"),
        (F.length(span["match"]) > 18).cast("int").alias("long"),
    )


LABELERS = ("pattern", "form", "gazetteer", "cue", "around")


def candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, base spans and other candidates with their votes."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    text = F.col("text")
    found = rows.select(
        "doc_id",
        *[spans_of(text, BASE[k], NEEDED[k]).alias(f"b_{k}") for k in KINDS],
        *[spans_of(text, WIDE[k], WIDE_NEEDED[k]).alias(f"w_{k}") for k in ALL_KINDS],
    )

    def voted(kind, name, base):
        return F.transform(
            F.col(name),
            lambda s: F.struct(
                s["start"].alias("start"),
                s["end"].alias("end"),
                (passes(kind, s["match"]) if base else F.lit(False)).alias("base"),
                votes(kind, s, base).alias("votes"),
            ),
        )

    every = [voted(k, f"b_{k}", True) for k in KINDS] + [voted(k, f"w_{k}", False) for k in ALL_KINDS]
    return found.select("doc_id", F.concat(*every).alias("found"))


def vote_table(found: DataFrame) -> list[dict]:
    """Counts per pattern of votes: at most 5 kinds * 3^5 votes * 2 lengths rows."""
    rows = found.select(F.explode("found").alias("f")).groupBy("f.votes").agg(F.count("*").alias("n"))
    return [r["votes"].asDict() | {"n": r["n"]} for r in rows.collect()]


def reliabilities(table: list[dict], rounds: int = 50) -> tuple[list[float], dict]:
    """Expectation-maximisation over the vote table.

    Returns the probability of each row, and P(vote | real or not) per kind and labeler.
    Starts from the mean vote; counts are smoothed, so no labeler becomes certain.  A labeler
    that a row does not name abstains.
    """
    table = [dict.fromkeys(LABELERS, 0) | r for r in table]
    real = [1 / (1 + math.exp(-sum(r[j] for j in LABELERS))) for r in table]
    chance: dict = {}
    for _ in range(rounds):
        for kind in range(len(ALL_KINDS)):
            own = [(r, p) for r, p in zip(table, real, strict=True) if r["kind"] == kind]
            total = [sum(r["n"] * (1 - p) for r, p in own), sum(r["n"] * p for r, p in own)]
            chance[kind] = [(total[y] + SMOOTH) / (sum(total) + 2 * SMOOTH) for y in (0, 1)]
            for j in LABELERS:
                for v in (-1, 0, 1):
                    hits = [sum(r["n"] * (p if y else 1 - p) for r, p in own if r[j] == v) for y in (0, 1)]
                    chance[kind, j, v] = [(hits[y] + SMOOTH) / (total[y] + 3 * SMOOTH) for y in (0, 1)]
        for i, r in enumerate(table):
            score = [math.log(chance[r["kind"]][y]) + sum(math.log(chance[r["kind"], j, r[j]][y]) for j in LABELERS) for y in (0, 1)]
            real[i] = 1 / (1 + math.exp(min(700.0, score[0] - score[1])))
    return real, chance


FEATURES = (*LABELERS, "long")


def span_classifier(table: list[dict], real: list[float], rounds: int = 400, rate: float = 0.5, shrink: float = 1e-3) -> dict[str, float]:
    """Logistic weights of the features and kinds, fitted to the rows' probabilities."""
    names = [*FEATURES, *ALL_KINDS]
    table = [dict.fromkeys(FEATURES, 0) | r for r in table]
    weight = dict.fromkeys(names, 0.0)
    total = sum(math.log1p(r["n"]) for r in table) or 1.0
    values = [{f: float(r[f]) for f in FEATURES} | {k: float(r["kind"] == i) for i, k in enumerate(ALL_KINDS)} for r in table]
    for _ in range(rounds):
        slope = dict.fromkeys(names, 0.0)
        for r, x, p in zip(table, values, real, strict=True):
            z = sum(weight[n] * x[n] for n in names)
            error = (1 / (1 + math.exp(-max(-30.0, min(30.0, z)))) - p) * math.log1p(r["n"]) / total
            for n in names:
                slope[n] += error * x[n]
        for n in names:
            weight[n] -= rate * (slope[n] + shrink * weight[n])
    return weight


def score(span_votes: Column, weight: dict[str, float]) -> Column:
    z = F.lit(0.0)
    for f in FEATURES:
        z = z + F.lit(weight[f]) * span_votes[f]
    for i, k in enumerate(ALL_KINDS):
        z = z + F.when(span_votes["kind"] == i, F.lit(weight[k])).otherwise(0.0)
    return 1 / (1 + F.exp(-z))


def _named(spans: Column) -> Column:
    """kind:start:end by kind, then start, comma-joined."""
    names = F.array(*[F.lit(k) for k in ALL_KINDS])
    order = F.array_sort(F.transform(spans, lambda s: F.struct(s["votes"]["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"))))
    return F.array_join(F.transform(order, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """Per row: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added.

    Counts and digest are of the base spans; ``spans`` lists base and added ones, the added kind
    ``secret`` (values given to a name like token or password) last.  A null text
    is an empty one; repeated rows are each reported; other columns are not looked at.
    """
    found = stored(candidates(docs, id_col, text_col), "candidates")
    table = vote_table(found)
    real, _ = reliabilities(table)
    weight = span_classifier(table, real)
    base = F.filter("found", lambda s: s["base"])
    rows = found.select("doc_id", "found", base.alias("base"))
    apart = lambda s, b: (s["end"] <= b["start"]) | (b["end"] <= s["start"])
    added = F.filter(
        "found",
        lambda s: ~s["base"] & (s["votes"]["pattern"] >= 0) & (score(s["votes"], weight) >= threshold) & F.forall("base", lambda b: apart(s, b)),
    )
    rows = rows.withColumn("added", added)
    count = lambda k: F.size(F.filter("base", lambda s: s["votes"]["kind"] == KINDS.index(k))).cast("long")
    return rows.select(
        "doc_id",
        *[count(k).alias(f"n_{k}") for k in KINDS],
        F.sha2(_named(F.col("base")), 256).alias("base_sha256"),
        _named(F.concat("base", "added")).alias("spans"),
        F.size("added").cast("long").alias("n_added"),
    )
