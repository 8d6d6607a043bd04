r"""Personal data (7), in DataFrame functions alone.

Regular expressions propose spans, kind by kind, leftmost and not overlapping within a kind; validators confirm them:
the Luhn sum for card numbers, the mod-97 sum for IBANs, ranges for address parts, digit counts for phones. Each span
has a prior by kind that nearby context words raise; kinds that need context count from a score of 0.5. Nearby is the
text on both sides, up to 40 characters and no further than the next proposal of the kind. A private key counts to the
end of its END line; one without such a line to the end of the lines of key signs.

A text goes through a kind's expression only if a cheap test finds the signs that the kind needs. Repetitions are
possessive where nothing after them could take a character back, so long runs neither recurse nor rescan.

Starts and ends are code points, the end exclusive. Results for special cases: null or empty text has no spans; a
proposal that fails its validator is dropped and not tried again in part; spans of different kinds may overlap, and
masking covers their union. Repeated rows give repeated results. Other columns are ignored (`find_personal_data`) or
carried unchanged, whatever their names (`mask_personal_data`).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .base import fresh, whole_text
from .spans import bind, chunked, cut, positions, scan

SPAN = "array<struct<start:int,end:int,kind:string,score:double>>"
#: Characters on both sides in which context words are looked for.
NEAR = 40


@dataclass(frozen=True)
class Kind:
    name: str
    gate: str
    pattern: str
    valid: object
    prior: float
    context: str


def digits(found: Column) -> Column:
    return F.regexp_replace(found, "[^0-9]", "")


def luhn(found: Column, least: int, most: int) -> Column:
    """Digit count within bounds and a Luhn sum of a multiple of ten."""
    number = F.reverse(digits(found))
    size = F.length(number)

    def add(total: Column, i: Column) -> Column:
        d = F.substring(number, i, F.lit(1)).cast("int") * (F.lit(2) - i % 2)
        return total + F.when(d > 9, d - 9).otherwise(d)

    total = F.aggregate(F.sequence(F.lit(1), F.least(F.greatest(size, F.lit(1)), F.lit(most))), F.lit(0), add)
    return F.when(size.between(least, most), total % 10 == 0).otherwise(F.lit(False))


def mod_97(found: Column) -> Column:
    """IBAN check: the first four signs moved to the end, letters as 10 to 35, remainder 1."""
    plain = F.regexp_replace(found, " ", "")
    turned = F.concat(F.substring(plain, 5, 40), F.substring(plain, 1, 4))

    def add(rest: Column, i: Column) -> Column:
        code = F.ascii(F.substring(turned, i, F.lit(1)))
        return F.when(code <= 57, (rest * 10 + code - 48) % 97).otherwise((rest * 100 + code - 55) % 97)

    size = F.length(plain)
    rest = F.aggregate(F.sequence(F.lit(1), F.least(F.greatest(size, F.lit(1)), F.lit(34))), F.lit(0), add)
    return F.when(size.between(15, 34), rest == 1).otherwise(F.lit(False))


def no_check(found: Column) -> Column:
    return F.lit(True)


PART = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
KEY_NAME = "(?:[A-Z0-9]+ ){0,3}PRIVATE KEY(?: BLOCK)?"
BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = [
    Kind("email", "@", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", no_check, 0.9, "mail|contact|write|address"),
    Kind("ip", r"[0-9]\.[0-9]++\.[0-9]", r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)", lambda m: m.rlike(rf"^{PART}(?:\.{PART}){{3}}$"), 0.7, "ip|host|server|address|login"),
    Kind("card", r"[0-9](?:[ -]?[0-9]){13}", r"[0-9](?:[ -]?[0-9])++", lambda m: luhn(m, 14, 19), 0.8, "card|visa|credit|debit|payment|amex|master"),
    Kind("phone", r"\+[0-9]", r"\+[0-9][ ().0-9-]+[0-9]", lambda m: F.length(digits(m)).between(10, 15), 0.7, "call|phone|tel|mobile|cell|fax"),
    Kind("card13", r"(?<![0-9])[0-9]{13}(?![0-9])", r"(?<![0-9])[0-9]{13}(?![0-9])", lambda m: luhn(m, 13, 13), 0.3, "card|visa|credit|debit|payment"),
    Kind("iban", r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){4}", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}(?![A-Za-z0-9])", mod_97, 0.9, "iban|bank|account|konto|transfer"),
    Kind("ssn", r"[0-9]{3}-[0-9]{2}-[0-9]{4}", r"(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])", no_check, 0.6, "ssn|social|security"),
    Kind("mac", r"[0-9A-Fa-f]{2}:[0-9A-Fa-f]{2}:", r"(?<![0-9A-Fa-f:])[0-9A-Fa-f]{2}(?::[0-9A-Fa-f]{2}){5}(?![0-9A-Fa-f:])", no_check, 0.6, "mac|device|hardware"),
    Kind("access_key", "A[KS]IA[A-Z0-9]", r"(?<![A-Za-z0-9])A[KS]IA[A-Z0-9]{16}(?![A-Za-z0-9])", no_check, 0.9, "key|secret|access"),
    Kind("token", "(?:gh[pousr]|sk|pk|rk|xox[abprs])[_-]", r"(?<![A-Za-z0-9])(?:gh[pousr]_[A-Za-z0-9]{20,}+|(?:sk|pk|rk)[_-](?:live|test)[_-][A-Za-z0-9]{10,}+|sk-[A-Za-z0-9]{20,}+|xox[abprs]-[A-Za-z0-9-]{10,}+)(?![A-Za-z0-9])", no_check, 0.9, "token|secret|key"),
    Kind("jwt", "eyJ[A-Za-z0-9_-]", r"(?<![A-Za-z0-9])eyJ[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+", no_check, 0.9, "token|bearer|auth"),
    Kind("private_key", "-----BEGIN", rf"-----BEGIN {KEY_NAME}-----(?:(?:[^-]|-(?!----))*+-----END {KEY_NAME}-----|(?:\s*+[A-Za-z0-9+/=]{{16,}}+)*+)", no_check, 1.0, "key"),
    Kind("password", r"(?i)(?:password|passwd|pwd|secret|token|api[_-]?key)[\"']? ?[=:]", r"(?i)(?<![A-Za-z])(?:password|passwd|pwd|secret|token|api[_-]?key)[\"']? ?[=:] ?[\"']?[^\s\"',;]{6,}+", no_check, 0.8, "login|user|admin|account"),
    Kind("passport", r"(?i)passport|travel document", r"(?<![A-Za-z0-9])[A-Z]{1,2}[0-9]{6,8}(?![A-Za-z0-9])", no_check, 0.3, "passport|travel document"),
]


def spans_of(text: Column, kind: Kind) -> Column:
    def scored(span: Column) -> Column:
        near = F.concat_ws(" ", span["before"], span["after"])
        score = F.when(near.rlike(f"(?i)(?<![A-Za-z])(?:{kind.context})"), F.lit(min(1.0, kind.prior + 0.3))).otherwise(F.lit(kind.prior))
        return F.struct(span["start"].alias("start"), span["end"].alias("end"), F.lit(kind.name).alias("kind"), score.alias("score"))

    found = positions(text, kind.pattern, NEAR)
    confirmed = found if kind.valid is no_check else F.filter(found, lambda s: kind.valid(s["found"]))
    spans = F.transform(confirmed, scored)
    if kind.name not in BASE_KINDS:
        spans = F.filter(spans, lambda s: s["score"] >= 0.5)
    gate = F.contains(text, F.lit(kind.gate)) if kind.gate == "@" else text.rlike(kind.gate)
    return F.when(gate, spans).otherwise(F.expr(f"cast(array() as {SPAN})"))


def find_personal_data(docs: DataFrame, text: str = "text", id_column: str = "doc_id") -> DataFrame:
    """id and `pii`, an array of (start, end, kind, score) by start, then kind as listed in KINDS."""
    return docs.select(F.col(id_column), personal_data(whole_text(text)).alias("pii"))


def personal_data(text: Column) -> Column:
    order = F.array(*(F.lit(k.name) for k in KINDS))
    every = F.flatten(F.array(*(spans_of(text, k) for k in KINDS)))
    suspect = text.rlike("|".join(f"(?:{k.gate})" for k in KINDS))
    found = F.when(suspect, every).otherwise(F.expr(f"cast(array() as {SPAN})"))
    keyed = F.array_sort(F.transform(found, lambda s: F.struct(s["start"].alias("start"), F.array_position(order, s["kind"]).alias("n"), s["end"].alias("end"), s["kind"].alias("kind"), s["score"].alias("score"))))
    return F.transform(keyed, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"), s["score"].alias("score")))


def listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def masked(text: Column, spans: Column) -> Column:
    """The text with the union of the spans replaced, each stretch by the kind of its first span in brackets."""

    def joined(parts: Column) -> Column:
        def piece(s: Column, i: Column) -> Column:
            done = F.when(i > 0, F.get(parts["reach"], i - 1)).otherwise(F.lit(0))
            return F.when(s["start"] >= done, F.concat(cut(parts["chunks"], done, s["start"]), F.lit("["), F.upper(s["kind"]), F.lit("]"))).otherwise(F.lit(""))

        last = F.coalesce(F.get(parts["reach"], F.size(parts["reach"]) - 1), F.lit(0))
        return F.concat(F.array_join(F.transform(parts["spans"], piece), ""), F.substring(text, last + 1, F.length(text)))

    reach = scan(F.transform(spans, lambda s: s["end"]), lambda a, b: F.greatest(a, b))
    return bind(F.struct(spans.alias("spans"), reach.alias("reach"), chunked(text).alias("chunks")), joined)


def mask_personal_data(docs: DataFrame, text: str = "text") -> DataFrame:
    """The same rows and columns with every span masked in the text; null texts stay null."""
    (spans,) = fresh(docs, "spans")
    found = docs.withColumn(spans, personal_data(whole_text(text)))
    new = F.when(F.col(text).isNotNull() & (F.size(spans) > 0), masked(F.col(text), F.col(spans))).otherwise(F.col(text))
    return found.withColumn(text, new).select(*docs.columns)
