"""Personal data: patterns propose, checksums confirm, context words score (operator 2).

Every kind has a pattern; its leftmost non-overlapping matches are the proposals.  Validators then decide: parts of an
IP address at most 255, Luhn for cards, digit counts for cards and phones, mod-97 for IBANs.  The score of a span is its
kind's prior, plus ``CONTEXT_BONUS`` when a context word of its kind stands within ``CONTEXT_CHARS`` characters.  The
four base kinds stay whatever their score; the added kinds (iban, ssn) need ``MIN_SCORE``.

The patterns are written so that they scan a text in linear time: a match can begin only at the start of a run of
characters or where the last match ended, and runs are taken possessively; the matches are the same.  Each row is worked
on by itself: no shuffle.

Defined cases: a null text counts as empty and has no span (base_sha256 is that of the empty string); repeated rows give
repeated results; an empty table gives an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import text_of
from .spans import add_spans, joined

BASE = ("email", "ip", "card", "phone")
ADDED = ("iban", "ssn")
CONTEXT_CHARS = 40
CONTEXT_BONUS = 0.3
MIN_SCORE = 0.6
PRIOR = {"email": 0.9, "ip": 0.6, "card": 0.7, "phone": 0.6, "iban": 0.8, "ssn": 0.4}
CONTEXT = {
    "email": "mail|contact|write|kontakt|correo|courriel",
    "ip": r"\bip\b|address|host|server|adresse",
    "card": "card|visa|master|credit|payment|karte|tarjeta|carte",
    "phone": "phone|call|tel|mobile|fax|telefon|llam",
    "iban": "iban|bank|account|konto|cuenta|compte",
    "ssn": r"ssn|social|security|\btax\b",
}
_LOCAL = "[A-Za-z0-9._%+-]"
PATTERN = {
    "email": rf"(?:(?<!{_LOCAL})|\G){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
}
_BYTE = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{1,2})"


def _digits(hit: Column) -> Column:
    return F.regexp_replace(hit, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """Luhn's checksum over a string of digits."""
    n = F.length(digits)
    total = F.aggregate(F.sequence(F.lit(1), n), F.lit(0), lambda acc, i: acc + F.when(
        (n - i) % 2 == 1, _folded(F.substring(digits, i, F.lit(1)).cast("int") * 2)).otherwise(
        F.substring(digits, i, F.lit(1)).cast("int")))
    return total % 10 == 0


def _folded(d: Column) -> Column:
    return F.when(d > 9, d - 9).otherwise(d)


def _mod97(hit: Column) -> Column:
    """ISO 7064 mod 97-10: the first four characters go last, letters count as 10 to 35, the rest must be 1."""
    plain = F.replace(hit, F.lit(" "), F.lit(""))
    chars = F.split(F.concat(F.substr(plain, F.lit(5)), F.substring(plain, 1, 4)), "")
    rest = F.aggregate(F.filter(chars, lambda c: c != ""), F.lit(0), lambda acc, c: _step97(acc, c))
    return rest == 1


def _step97(acc: Column, c: Column) -> Column:
    v = F.instr(F.lit("0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"), c) - 1
    return (acc * F.when(v > 9, 100).otherwise(10) + v) % 97


def _valid(kind: str, hit: Column) -> Column:
    n = F.length(_digits(hit))
    if kind == "ip":
        return hit.rlike(rf"^{_BYTE}\.{_BYTE}\.{_BYTE}\.{_BYTE}$")
    if kind == "card":
        return F.when(n.between(14, 19), _luhn(_digits(hit))).otherwise(False)
    if kind == "phone":
        return n.between(10, 15)
    if kind == "iban":
        return F.when(F.length(F.replace(hit, F.lit(" "), F.lit(""))).between(15, 34), _mod97(hit)).otherwise(False)
    if kind == "ssn":
        return ~hit.rlike("^(000|666|9)|-00-|-0000$")
    return F.lit(True)


def find_personal_data(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: doc_id and ``spans``, an array of struct<start, kind_no, end, kind, hit, score>
    sorted by start and kind."""
    df = docs.select(docs["doc_id"], text_of(docs).alias("text"))
    text = F.col("text")
    need = {
        "email": F.contains(text, F.lit("@")),
        "ip": text.rlike(r"[0-9]\.[0-9]"),
        "card": text.rlike(r"(?:[0-9][\x20-]?){14}"),
        "phone": F.contains(text, F.lit("+")),
        "iban": text.rlike(r"[A-Z]{2}[0-9]{2}"),
        "ssn": text.rlike(r"-[0-9]{2}-"),
    }
    df = add_spans(df, "text", {k: (PATTERN[k], need[k]) for k in PATTERN}, CONTEXT_CHARS)

    def scored(no: int, kind: str) -> Column:
        ok = F.filter(F.col(kind), lambda s: _valid(kind, s["hit"]))
        spans = F.transform(ok, lambda s: F.struct(
            s["start"].alias("start"), F.lit(no).alias("kind_no"), s["end"].alias("end"), F.lit(kind).alias("kind"),
            s["hit"].alias("hit"), (F.lit(PRIOR[kind]) + F.when(
                s["near"].rlike(CONTEXT[kind]), CONTEXT_BONUS).otherwise(0.0)).alias("score")))
        return spans if kind in BASE else F.filter(spans, lambda s: s["score"] >= MIN_SCORE)

    found = F.concat(*[scored(no, kind) for no, kind in enumerate(BASE + ADDED)])
    return df.select("doc_id", F.array_sort(found).alias("spans"))


def digest(found: DataFrame) -> DataFrame:
    """Counts of the base kinds, the digest of the base spans, and all spans as text."""
    base = F.filter(F.col("spans"), lambda s: s["kind_no"] < len(BASE))
    count = lambda kind: F.size(F.filter(F.col("spans"), lambda s: s["kind"] == kind)).cast("bigint")
    return found.select(
        "doc_id", *[count(k).alias(f"n_{k}") for k in BASE], F.sha2(joined(base), 256).alias("base_sha256"),
        joined(F.col("spans")).alias("spans"),
        F.array_join(F.transform("spans", lambda s: F.format_number(s["score"], 2)), ",").alias("scores"))
