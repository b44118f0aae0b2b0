"""Personal data in texts, with DataFrame functions only.

Per kind, a regular expression proposes leftmost non-overlapping spans; a validator confirms them (octet range for
addresses, Luhn for card numbers, digit count for phones, mod-97 for IBANs, digits and letters for secrets); words of the
surroundings move a score, and spans below ``min_score`` are not reported. The base kinds reach it by their validator;
long hexadecimal and key-like strings, which are mostly digests and names of files, only where a word nearby says so.
Offsets come from the lengths of the pieces between matches, so they count code points, and ends are exclusive.

The patterns are possessive forms of the stated ones. Where a run can only match as a whole, a look-behind stops
the engine from trying every later start in it, which keeps long texts linear and the matcher's stack flat.

Defined results: a null text counts as empty and has no spans; every row gives one row, in any order, repeated rows
included; an empty table gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The span patterns. Cards of under 12 digits cannot pass, so shorter digit runs are not proposed.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9]){11,}+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
IBAN = r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}+(?:\x20?[A-Z0-9]{1,3}+)?+(?![A-Za-z0-9])"
SECRET = r"(?<![A-Za-z0-9_-])(?:[0-9A-Fa-f]{32,}+|AKIA[0-9A-Z]{16}+|(?:sk|pk|ghp|gho|xox[abp])[_-][A-Za-z0-9_-]{16,}+)(?![A-Za-z0-9_-])"

#: kind, pattern, a substring pattern that every match contains, score when confirmed, context words; in output order.
KINDS = (
    ("email", EMAIL, "@", 0.90, r"(?i)\b(?:e-?mail|mail|contact|write)\b"),
    ("ip", IP, ".", 0.60, r"(?i)\b(?:ip|host|server|address|login)\b"),
    ("card", CARD, None, 0.80, r"(?i)\b(?:card|visa|credit|debit|payment|amex)\b"),
    ("phone", PHONE, "+", 0.70, r"(?i)\b(?:tel|phone|call|mobile|fax|whatsapp)\b"),
    ("iban", IBAN, None, 0.85, r"(?i)\b(?:iban|bank|account|transfer|konto|cuenta|compte)\b"),
    ("secret", SECRET, None, 0.30, r"(?i)(?:token|secret|passw(?:or)?d|pwd|passwort|api.?key|auth|bearer|credential)"),
)
BASE_KINDS = ("email", "ip", "card", "phone")
#: Characters on either side that are looked at, what a context word adds, and the least score of a span that is reported.
CONTEXT_CHARS, CONTEXT_BONUS, MIN_SCORE = 40, 0.3, 0.5


def _digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    n = F.length(digits)

    def add(acc: Column, i: Column) -> Column:
        d = F.substring(digits, n - i + 1, F.lit(1)).cast("int")
        twice = d * 2
        return acc + F.when(i % 2 == 1, d).otherwise(F.when(twice > 9, twice - 9).otherwise(twice))

    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), add) % 10 == 0


def mod97(compact: Column) -> Column:
    """Whether an IBAN without blanks has remainder 1 modulo 97."""
    turned = F.concat(F.substring(compact, F.lit(5), F.length(compact)), F.substring(compact, 1, 4))

    def add(acc: Column, i: Column) -> Column:
        code = F.ascii(F.substring(turned, i, F.lit(1)))
        return F.when(code >= 65, (acc * 100 + code - 55) % 97).otherwise((acc * 10 + code - 48) % 97)

    return F.aggregate(F.sequence(F.lit(1), F.length(turned)), F.lit(0), add) == 1


OCTET = "0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"


def confirmed(kind: str, s: Column) -> Column:
    if kind == "ip":
        return s.rlike(rf"^{OCTET}(?:\.{OCTET}){{3}}$")
    if kind == "card":
        return F.length(_digits(s)).between(12, 19) & luhn(_digits(s))
    if kind == "phone":
        return F.length(_digits(s)).between(9, 15)
    if kind == "iban":
        return F.length(F.replace(s, F.lit(" "), F.lit(""))).between(15, 34) & mod97(F.replace(s, F.lit(" "), F.lit("")))
    if kind == "secret":
        return s.rlike("[0-9]") & s.rlike("[A-Za-z]")
    return F.lit(True)


def _placed(text: Column, pattern: str, found: Column) -> Column:
    """array<struct<start,end,text>> of the matches, from the lengths of the pieces between them."""
    pieces = F.split(text, pattern, -1)
    empty = F.array().cast("array<struct<start:int,end:int,text:string>>")

    def step(acc: Column, i: Column) -> Column:
        start = acc["at"] + F.length(F.get(acc["pieces"], i))
        end = start + F.length(F.get(found, i))
        span = F.struct(start.alias("start"), end.alias("end"), F.get(found, i).alias("text"))
        return F.struct(end.alias("at"), acc["pieces"].alias("pieces"), F.concat(acc["out"], F.array(span)).alias("out"))

    first = F.struct(F.lit(0).alias("at"), pieces.alias("pieces"), empty.alias("out"))
    walked = F.aggregate(F.sequence(F.lit(0), F.size(found) - 1), first, step, lambda acc: acc["out"])
    return F.when(F.size(found) > 0, walked).otherwise(empty)


def _scored(text: Column, ord_: int, kind: str, pattern: str, _mark: str | None, base: float, words: str) -> Column:
    """The confirmed spans of a kind, with their scores."""
    good = F.filter(_placed(text, pattern, F.col(f"_m_{kind}")), lambda s: confirmed(kind, s["text"]))

    def scored(s: Column) -> Column:
        before = F.substring(text, F.greatest(s["start"] + 1 - CONTEXT_CHARS, F.lit(1)), F.least(s["start"], F.lit(CONTEXT_CHARS)))
        after = F.substring(text, s["end"] + 1, F.lit(CONTEXT_CHARS))
        bonus = F.when(before.rlike(words) | after.rlike(words), CONTEXT_BONUS).otherwise(0.0)
        return F.struct(
            s["start"].alias("start"), F.lit(ord_).alias("ord"), s["end"].alias("end"), F.lit(kind).alias("kind"), s["text"].alias("text"),
            F.round(F.least(F.lit(base) + bonus, F.lit(1.0)), 3).alias("score"),
        )

    return F.transform(good, scored)


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_score: float = MIN_SCORE) -> DataFrame:
    """Per row: the identifier and the spans of at least min_score, array<struct<start, ord, end, kind, text, score>> by
    start, then kind as in KINDS."""
    df = docs.select(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    text = F.col("_text")
    none = F.array().cast("array<string>")
    proposals = {}
    for kind, pattern, mark, _, _ in KINDS:
        found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
        proposals[f"_m_{kind}"] = F.when(text.contains(mark), found).otherwise(none) if mark else found
    df = df.withColumns(proposals)
    spans = [_scored(text, ord_, *kind) for ord_, kind in enumerate(KINDS)]
    return df.select(id_col, F.array_sort(F.filter(F.concat(*spans), lambda s: s["score"] >= min_score)).alias("spans"))


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_score: float = MIN_SCORE) -> DataFrame:
    """docs with every span of at least min_score replaced by <KIND>; overlapping spans are replaced once, from the first."""
    # The row travels as the identifier, so nothing is joined back.
    inner = find_pii(docs.select(F.struct(*docs.columns).alias("_row"), F.col(text_col).alias("_whole")), "_row", "_whole", min_score)

    def step(acc: Column, s: Column) -> Column:
        skip = s["start"] < acc["at"]
        piece = F.concat(F.substring(F.coalesce(F.col(f"_row.{text_col}"), F.lit("")), acc["at"] + 1, s["start"] - acc["at"]), F.lit("<"), F.upper(s["kind"]), F.lit(">"))
        return F.struct(F.when(skip, acc["at"]).otherwise(s["end"]).alias("at"), F.when(skip, acc["out"]).otherwise(F.concat(acc["out"], piece)).alias("out"))

    whole = F.coalesce(F.col(f"_row.{text_col}"), F.lit(""))
    done = F.aggregate(
        F.col("spans"), F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), step,
        lambda acc: F.concat(acc["out"], F.substring(whole, acc["at"] + 1, F.length(whole))),
    )
    return inner.select(*[F.when(F.col(f"_row.{text_col}").isNotNull(), done).alias(text_col) if c == text_col else F.col(f"_row.{c}") for c in docs.columns])
