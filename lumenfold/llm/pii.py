"""Personal data: regular expressions propose spans, checksums confirm them, context words move the score.

All in DataFrame functions. For each kind, the gaps between matches (split) and the matches (extract_all)
of one expression give the places by adding up lengths in code points. Possessive forms make the
expressions linear and free of recursion on texts of any length; they match what the plain forms match. Matches are gone
through in runs of RUN and contexts are read from pieces of the text, so that a text takes time in proportion to its length
and its matches.

An account number (iban) may be followed by a space and more capitals or digits, so the expression gives only
its start and the run of signs after it; the end is the place between words of the run at which the number has its
country's length and passes mod-97. Countries without a fixed length take the longest end that passes.

The base kinds (email, ip, card, phone) keep every span that passes their check, whatever the context;
the further kinds (iban, ssn, secret) need a score of THRESHOLD, which a passed checksum or a context
word within CONTEXT characters gives.

Cases: a null or empty text has no span; repeated rows are treated alike; extra columns are passed
through, but for those named spans_<kind>, which are replaced; an empty table gives no row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CONTEXT, THRESHOLD = 40, 0.5
#: Items that are gathered in one array before it is copied, and code points of a piece of a text.
RUN, PIECE = 256, 1_024
BASE = ("email", "ip", "card", "phone")

# The patterns of the kinds.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9]){12,}+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?=((?:\x20?[A-Z0-9]){11,30}+[A-Za-z0-9]?))",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "secret": r"(?<![0-9A-Za-z])[0-9a-f]{32,64}+(?![0-9A-Za-z])",
}
# A text without a match of these has no span of the kind.
HINTS = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9][\x20-]?[0-9][\x20-]?[0-9]", "phone": r"\+[0-9]", "iban": "[A-Z]{2}[0-9]{2}", "ssn": "[0-9]-[0-9]{2}-[0-9]", "secret": "[0-9a-f]{32}"}
# Context words that raise a kind's score.
WORDS = {
    "email": "mail|contact|write|courriel|correo|kontakt",
    "ip": "ip|address|host|server|login",
    "card": "card|visa|credit|payment|carte|karte|tarjeta",
    "phone": "phone|call|tel|mobile|fax|anruf|appel|llam",
    "iban": "iban|bank|account|konto|compte|cuenta",
    "ssn": "ssn|social|security|tax",
    "secret": "token|secret|key|password|passwd|auth",
}
# Lengths of account numbers by country.
LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA",
    23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HN HU LB NI PL SV",
    29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
}
_LISTED = "|".join(x for names in LENGTHS.values() for x in names.split())
_FORM = "^(?:" + "|".join(f"(?:{names.replace(' ', '|')})[A-Z0-9]{{{n - 2}}}" for n, names in LENGTHS.items()) + f"|(?!{_LISTED})[A-Z0-9]{{15,34}})$"
#: Scores before context: a passed check, and without one.
CHECKED, UNCHECKED, RAISE = 0.7, 0.4, 0.3

_SPANS = "array<struct<start:int,end:int,text:string>>"


def bound(value: Column, body) -> Column:
    """body(value), in which `value` is computed once however often it stands there."""
    return F.transform(F.array(value), body)[0]


def scanned(items: Column, zero: Column, step) -> Column:
    """What `step` gathers over the items of an array: step(acc, item) gives acc (at: the state, from `zero` on; out: an array of spans) anew.

    An array that grows by one is copied each time, so each run of RUN items gathers its own; the runs' arrays are joined at the end.
    """
    run = F.array().cast(f"array<struct<at:int,out:{_SPANS}>>")
    state = lambda done: F.struct(F.coalesce(F.try_element_at(done, F.lit(-1))["at"], zero).alias("at"), F.array().cast(_SPANS).alias("out"))

    def gathered(items: Column) -> Column:
        runs = F.transform(F.sequence(F.lit(0), F.floor(F.size(items) / RUN).cast("int")), lambda k: F.slice(items, k * RUN + 1, F.lit(RUN)))
        return F.flatten(F.transform(F.aggregate(runs, run, lambda done, part: F.array_append(done, F.aggregate(part, state(done), step))), lambda x: x["out"]))

    return bound(items, gathered)


def matches(text: Column, pattern: str) -> Column:
    """start, end (exclusive) and text of the leftmost matches that don't overlap."""
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    pairs = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), hits.alias("hit"))

    def step(acc: Column, x: Column) -> Column:
        begin = acc["at"] + F.length(x["gap"])
        end = begin + F.length(x["hit"])
        return F.struct(F.coalesce(end, acc["at"]).alias("at"), F.when(x["hit"].isNull(), acc["out"]).otherwise(F.array_append(acc["out"], F.struct(begin.alias("start"), end.alias("end"), x["hit"].alias("text")))).alias("out"))

    return scanned(pairs, F.lit(0), step)


def luhn(digits: Column) -> Column:
    """Whether the check digit of a string of digits is right."""
    size = F.length(digits)
    doubled = lambda d: F.when(d > 4, 2 * d - 9).otherwise(2 * d)
    digit = lambda i: F.substring(digits, i, 1).cast("int")
    return F.aggregate(F.sequence(F.lit(1), size), F.lit(0), lambda acc, i: acc + F.when(F.pmod(size - i, 2) == 1, doubled(digit(i))).otherwise(digit(i))) % 10 == 0


def mod97(text: Column) -> Column:
    """Whether an account number's remainder is 1: the first four signs moved to the end, letters as 10 to 35."""
    plain = F.regexp_replace(text, " ", "")
    moved = F.concat(F.substring(plain, 5, 64), F.substring(plain, 1, 4))
    sign = lambda i: F.ascii(F.substring(moved, i, 1))
    return F.aggregate(F.sequence(F.lit(1), F.length(moved)), F.lit(0), lambda acc, i: F.when(sign(i) >= 65, (acc * 100 + sign(i) - 55) % 97).otherwise((acc * 10 + sign(i) - 48) % 97)) == 1


def ibans(text: Column) -> Column:
    """start, end (exclusive) and text of the account numbers that pass mod-97, the leftmost first, without overlaps."""
    tails = F.regexp_extract_all(text, F.lit(PATTERNS["iban"]), F.lit(1))

    def number(head: Column, tail: Column) -> Column:
        words = F.split(F.concat(head["text"], tail), " ", -1)
        ends = F.transform(F.sequence(F.lit(1), F.size(words)), lambda k: F.array_join(F.slice(words, 1, k), " "))
        found = F.try_element_at(F.filter(ends, lambda x: F.replace(x, F.lit(" "), F.lit("")).rlike(_FORM) & mod97(x)), F.lit(-1))
        return F.struct(head["start"].alias("start"), (head["start"] + F.length(found)).alias("end"), found.alias("text"))

    def step(acc: Column, x: Column) -> Column:
        taken = x["text"].isNotNull() & (acc["at"] <= x["start"])
        return F.struct(F.when(taken, x["end"]).otherwise(acc["at"]).alias("at"), F.when(taken, F.array_append(acc["out"], x)).otherwise(acc["out"]).alias("out"))

    return scanned(F.zip_with(matches(text, PATTERNS["iban"]), tails, number), F.lit(0), step)


def checked(kind: str, text: Column) -> Column:
    """Whether a match passes its kind's check; null for kinds that have none."""
    digits = F.regexp_replace(text, "[^0-9]", "")
    if kind == "ip":
        return F.forall(F.split(text, r"\."), lambda x: F.length(F.ltrim(x, F.lit("0"))) <= 3) & F.forall(F.split(text, r"\."), lambda x: F.coalesce(F.right(x, F.lit(3)).cast("int"), F.lit(0)) <= 255)
    if kind == "card":
        return F.when(F.length(digits).between(13, 19), luhn(digits)).otherwise(False)
    if kind == "phone":
        return F.length(digits).between(9, 15)
    return mod97(text) if kind == "iban" else F.lit(True) if kind == "email" else F.lit(None).cast("boolean")


def _cut(pieces: Column, start: Column, size: Column) -> Column:
    """`size` (PIECE at most) code points of a text in pieces, from `start` on."""
    first = F.floor(start / PIECE).cast("int")
    both = F.concat(F.coalesce(F.get(pieces, first), F.lit("")), F.coalesce(F.get(pieces, first + 1), F.lit("")))
    return F.substring(both, start - first * PIECE + 1, size)


def spans_of(text: Column, kind: str) -> Column:
    """Array of kind, start, end, text and score: the spans of one kind."""

    def scored(x: Column, pieces: Column) -> Column:
        before = F.least(x["start"], F.lit(CONTEXT))
        near = F.lower(F.concat_ws(" ", _cut(pieces, x["start"] - before, before), _cut(pieces, x["end"], F.lit(CONTEXT))))
        score = F.coalesce(F.when(checked(kind, x["text"]), F.lit(CHECKED)).otherwise(F.when(~checked(kind, x["text"]), F.lit(0.0))), F.lit(UNCHECKED))
        score = F.when(score > 0, score + F.when(near.rlike(WORDS[kind]), RAISE).otherwise(0.0)).otherwise(score)
        return F.struct(F.lit(kind).alias("kind"), x["start"].alias("start"), x["end"].alias("end"), x["text"].alias("text"), score.alias("score"))

    hits = ibans(text) if kind == "iban" else matches(text, PATTERNS[kind])
    pieces = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0))
    none = F.array().cast("array<struct<kind:string,start:int,end:int,text:string,score:double>>")
    found = bound(hits, lambda h: F.when(F.size(h) > 0, bound(pieces, lambda p: F.filter(F.transform(h, lambda x: scored(x, p)), lambda x: x["score"] >= THRESHOLD))).otherwise(none))
    return F.when(text.rlike(HINTS[kind]), found).otherwise(none)


def find(docs: DataFrame, kinds: tuple = tuple(PATTERNS)) -> DataFrame:
    """All rows and columns of `docs` with one column of spans a kind (array of kind, start, end, text, score)."""
    text = F.coalesce("text", F.lit(""))
    return docs.withColumns({f"spans_{k}": spans_of(text, k) for k in kinds})


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, the counts of the base kinds, the hash of their places, all places, and their number."""
    found = find(docs)
    written = lambda k: F.transform(F.col(f"spans_{k}"), lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string")))
    joined = lambda kinds: F.array_join(F.concat(*[written(k) for k in kinds]), ",")
    return found.select(
        "doc_id",
        *[F.size(f"spans_{k}").cast("long").alias(f"n_{k}") for k in BASE],
        F.sha2(joined(BASE).cast("binary"), 256).alias("base_sha256"),
        joined(tuple(PATTERNS)).alias("spans"),
        sum((F.size(f"spans_{k}").cast("long") for k in PATTERNS), F.lit(0).cast("long")).alias("n_spans"),
    )
