"""Personal data: patterns propose, checksums confirm, nearby words adjust the score.

In Spark expressions only. A kind is found by splitting the text at its matches: the
lengths of the parts between give the places of the matches in code points. Patterns
are possessive and start only where a run starts (or where the last match ended), so
that a long run of letters or digits is read once.

Base kinds (email, ip, card, phone) are decided by form and checksum alone and always
reported. Further kinds are proposals with a score: a checksum must confirm those that
have one, words nearby that name the kind raise the score, and words that speak of an
example lower it; from 0.5 on they are reported. So an account number or an access key is
reported unless it is an example, and a social, routing, health or identity number, whose
form many other numbers have, only beside a word that names it.

Defined cases: a null text holds nothing, and ``redact`` leaves it null; repeated rows
and null ids are handled like any others; an empty table gives no rows; columns other
than ``doc_id`` and ``text`` are ignored by ``spans`` and kept by ``redact``.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tables import let, running, whole_rows


@dataclass(frozen=True)
class Kind:
    name: str
    pattern: str
    #: score without a telling word nearby; reported from 0.5 on
    score: float
    #: words that add 0.4 when they stand within ``near`` characters
    words: str = ""
    near: int = 40
    #: a form that every text with a match holds, quick to look for
    hint: str = r"[0-9][\x20-]?[0-9]"


#: The forms of the kinds, in the order in which ties are reported.
EMAIL = Kind(
    "email",
    r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    1.0,
)
IP = Kind("ip", r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", 1.0)
CARD = Kind("card", r"(?<![0-9])[0-9](?:[\x20-]?[0-9])++", 1.0)
PHONE = Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", 1.0)
IBAN = Kind(
    "iban", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:[\x20]?[A-Z0-9]){11,30}+(?![A-Za-z0-9])", 0.6,
    r"(?i)\b(iban|account|bank|konto|cuenta|compte)\b",
)
SOCIAL = Kind(
    "social", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", 0.3,
    r"(?i)\b(ssn|social security|social insurance)\b",
)
ROUTING = Kind(
    "routing", r"(?<![A-Za-z0-9.-])[0-9]{9}(?![A-Za-z0-9-])", 0.3,
    r"(?i)\b(routing|aba|transit number)\b", hint="[0-9]{9}",
)
HEALTH = Kind(
    "health", r"(?<![A-Za-z0-9.-])[0-9]{3}[\x20-]?[0-9]{3}[\x20-]?[0-9]{4}(?![A-Za-z0-9-])", 0.3,
    r"(?i)\b(nhs|health service)\b", hint=r"[0-9]{3}[\x20-]?[0-9]{4}",
)
IDENTITY = Kind(
    "identity", r"(?<![A-Za-z0-9.-])[0-9]{8}-?[A-Z](?![A-Za-z0-9-])", 0.3,
    r"(?i)\b(dni|nif|identidad|identity card)\b", hint="[0-9]{8}-?[A-Z]",
)
ACCESS_KEY = Kind("key", r"(?<![A-Za-z0-9])AKIA[A-Z0-9]{16}(?![A-Za-z0-9])", 0.6, r"(?i)\b(key|secret|access)\b", hint="AKIA")
#: Words that take 0.3 from a score, and the check letters of identity numbers by remainder.
EXAMPLES = r"(?i)\b(example|sample|dummy|fake|fictitious|placeholder)\b"
LETTERS = "TRWAGMYFPDXBNJZSQVHLCKE"
BASE = (EMAIL, IP, CARD, PHONE)
KINDS = (*BASE, IBAN, SOCIAL, ROUTING, HEALTH, IDENTITY, ACCESS_KEY)


def _digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """Whether the digits pass: from the right, every second one is doubled."""
    each = F.transform(F.split(F.reverse(digits), ""), lambda d: d.cast("int"))
    weighed = F.transform(each, lambda d, i: F.when(i % 2 == 0, d).otherwise(d * 2 - F.when(d > 4, 9).otherwise(0)))
    return F.aggregate(weighed, F.lit(0), lambda a, d: a + F.coalesce(d, F.lit(0))) % 10 == 0


def _mod97(value: Column) -> Column:
    """Whether an account number leaves 1: country and check digits last, letters as 10 to 35."""
    plain = F.regexp_replace(value, " ", "")
    turned = F.concat(F.substring(plain, 5, 64), F.substring(plain, 1, 4))
    code = lambda c: F.ascii(c) - F.when(c >= "A", 55).otherwise(48)
    return F.aggregate(
        F.filter(F.split(turned, ""), lambda c: c != ""),
        F.lit(0),
        lambda a, c: (a * F.when(c >= "A", 100).otherwise(10) + code(c)) % 97,
    ) == 1


def _weighed(digits: Column, weights: tuple[int, ...]) -> Column:
    """The digits' sum, each times its weight."""
    each = F.filter(F.split(digits, ""), lambda d: d != "")
    return F.aggregate(
        F.zip_with(each, F.array(*[F.lit(w) for w in weights]), lambda d, w: d.cast("int") * w),
        F.lit(0),
        lambda x, y: x + y,
    )


def _valid(kind: Kind, value: Column) -> Column:
    digits = _digits(value)
    if kind.name == "ip":
        parts = F.transform(F.split(value, r"\."), lambda p: F.regexp_replace(p, "^0+(?=[0-9])", ""))
        return F.forall(parts, lambda p: (F.length(p) <= 3) & (F.substring(p, 1, 3).cast("int") <= 255))
    if kind.name == "card":
        return F.length(digits).between(12, 19) & _luhn(digits)
    if kind.name == "phone":
        return F.length(digits).between(9, 15)
    if kind.name == "iban":
        return F.length(F.regexp_replace(value, " ", "")).between(15, 34) & _mod97(value)
    if kind.name == "routing":
        return (digits != "000000000") & (_weighed(digits, (3, 7, 1, 3, 7, 1, 3, 7, 1)) % 10 == 0)
    if kind.name == "health":  # the last digit fills up to a multiple of 11
        return (digits != "0000000000") & (_weighed(digits, (10, 9, 8, 7, 6, 5, 4, 3, 2, 1)) % 11 == 0)
    if kind.name == "identity":
        return F.substring(F.lit(LETTERS), digits.cast("int") % 23 + 1, F.lit(1)) == F.right(value, F.lit(1))
    return F.lit(True)


def _may_hold(kind: Kind, text: Column) -> Column:
    """A cheap test that every text with a match passes."""
    if kind is EMAIL:
        return text.contains("@")
    if kind is PHONE:
        return text.contains("+")
    return text.rlike(kind.hint if kind is not IP else r"[0-9]\.[0-9]")


def _found(kind: Kind, rank: int, text: Column) -> Column:
    """Array of (start, rank, kind, end, score) of the kind's confirmed matches, in order."""
    gaps = F.transform(F.split(text, kind.pattern, -1), lambda g: F.length(g))
    values = F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(0))
    steps = F.filter(
        F.zip_with(gaps, values, lambda g, v: F.struct(g.alias("gap"), v.alias("v"))),
        lambda s: s["v"].isNotNull(),
    )
    step = lambda s, at: F.struct((at + s["gap"]).alias("start"), s["v"].alias("value"))
    sizes = lambda all: F.transform(all, lambda s: s["gap"] + F.length(s["v"]))
    placed = let(steps, lambda all: F.zip_with(all, running(sizes(all)), step))

    def scored(m: Column) -> Column:
        end = m["start"] + F.length(m["value"])
        score = F.lit(kind.score)
        if kind.words:
            from_ = F.greatest(m["start"] - kind.near, F.lit(0))
            around = F.substring(text, from_ + 1, end - from_ + kind.near)
            score = score + F.when(around.rlike(kind.words), 0.4).otherwise(0.0)
            score = score - F.when(around.rlike(EXAMPLES), 0.3).otherwise(0.0)
        return F.struct(
            m["start"].alias("start"), F.lit(rank).alias("rank"), F.lit(kind.name).alias("kind"),
            end.alias("end"), score.alias("score"),
        )

    kept = F.filter(placed, lambda m: _valid(kind, m["value"]))
    sure = F.filter(F.transform(kept, scored), lambda m: m["score"] >= 0.5)
    none = F.array().cast("array<struct<start:int,rank:int,kind:string,end:int,score:double>>")
    return F.when(_may_hold(kind, text), sure).otherwise(none)


def _with_spans(docs: DataFrame) -> DataFrame:
    """``_<kind>`` for every kind, and ``_base`` and ``_spans``: sorted arrays of spans."""
    text = F.coalesce("text", F.lit(""))
    df = docs.withColumns({f"_{k.name}": _found(k, i, text) for i, k in enumerate(KINDS)})
    together = lambda kinds: F.array_sort(F.concat(*[f"_{k.name}" for k in kinds]))
    return df.withColumns({"_base": together(BASE), "_spans": together(KINDS)})


def _told(spans: str) -> Column:
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))),
        ",",
    )


def spans(docs: DataFrame) -> DataFrame:
    """Per row: counts of the base kinds, digest of the base spans, and all spans as text."""
    df = _with_spans(docs.select("doc_id", "text"))
    return df.select(
        "doc_id",
        *[F.size(f"_{k.name}").cast("long").alias(f"n_{k.name}") for k in BASE],
        F.sha2(_told("_base").cast("binary"), 256).alias("base_sha256"),
        _told("_spans").alias("spans"),
    )


@whole_rows
def redact(docs: DataFrame) -> DataFrame:
    """Every span replaced by its kind in angle brackets; overlapping spans become one, under the first's kind."""
    df = _with_spans(docs)
    cut = F.aggregate(
        "_spans",
        F.struct(F.lit(0).alias("at"), F.lit("").alias("out")),
        lambda acc, s: F.struct(
            F.greatest(acc["at"], s["end"]).alias("at"),
            F.when(
                s["start"] >= acc["at"],
                F.concat(
                    acc["out"],
                    F.substring(F.col("text"), acc["at"] + 1, s["start"] - acc["at"]),
                    F.lit("<"), F.upper(s["kind"]), F.lit(">"),
                ),
            ).otherwise(acc["out"]).alias("out"),
        ),
        lambda acc: F.concat(acc["out"], F.substring(F.col("text"), acc["at"] + 1, F.length("text"))),
    )
    return df.withColumn("text", F.when(F.size("_spans") > 0, cut).otherwise(F.col("text"))).select(*docs.columns)
