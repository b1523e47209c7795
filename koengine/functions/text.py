"""Text expressions: tokens, similarities, name normalisation, dates, redaction. All JVM-side."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def token_list(text: Column) -> Column:
    """Lower-case runs of letters and digits, with repeats."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda x: x != "")


def tokens(text: Column) -> Column:
    """The set of a text's tokens."""
    return F.array_distinct(token_list(text))


def jaccard(a: Column, b: Column) -> Column:
    """Shared share of two token sets (lists without repeats), 0 if either is empty."""
    shared = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(shared / (F.size(a) + F.size(b) - shared))


def normalize_name(name: Column) -> Column:
    """Lower case, spaces collapsed, trailing ``type`` and then ``_t`` removed."""
    x = F.trim(F.regexp_replace(F.lower(name), r"\s+", " "))
    return F.regexp_replace(F.regexp_replace(x, "(type)+$", ""), "(_t)+$", "")


def snake_case(s: Column) -> Column:
    return F.regexp_replace(F.trim(F.regexp_replace(F.lower(s), r"[^\p{L}\p{N}]+", " ")), " ", "_")


def name_similarity(a: Column, b: Column) -> Column:
    """1 equal, 0.95 but for case, containment 0.8 * short/long + 0.1, shared tokens 0.7 * Jaccard (two tokens each), 0.5 for a shared single token."""
    la, lb = F.lower(a), F.lower(b)
    na, nb = F.octet_length(a), F.octet_length(b)
    ta, tb = tokens(a), tokens(b)
    shared = F.size(F.array_intersect(ta, tb))
    inside = (F.length(la) > 0) & (F.length(lb) > 0) & (la.contains(lb) | lb.contains(la))
    return (
        F.when(a == b, 1.0).when(la == lb, 0.95).when(inside, 0.8 * F.least(na, nb) / F.greatest(na, nb) + 0.1)
        .when((shared > 0) & (F.size(ta) >= 2) & (F.size(tb) >= 2), 0.7 * shared / F.size(F.array_union(ta, tb)))
        .when(shared > 0, 0.5).otherwise(0.0)
    )


#: Months by name.
MONTHS = ("January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December")
DATE_PATTERN = r"\b(?:" + "|".join(MONTHS) + r") \d{1,2}, \d{4}\b|\b(?:" + "|".join(MONTHS) + r") \d{4}\b|\bQ[1-4] \d{4}\b|\b\d{4}-\d{2}-\d{2}\b"


def dates_in(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit("(" + DATE_PATTERN + ")"), F.lit(1))


def date_range(s: Column) -> tuple[Column, Column]:
    """First and last day of a date text, as ISO dates; null if it is none."""
    month = F.lit(None).cast("int")
    for i, m in enumerate(MONTHS, 1):
        month = F.when(s.startswith(m), F.lit(i)).otherwise(month)
    year = F.regexp_extract(s, r"(\d{4})$", 1).cast("int")
    quarter = F.regexp_extract(s, r"^Q([1-4])", 1).try_cast("int")
    day = F.regexp_extract(s, r" (\d{1,2}),", 1).try_cast("int")
    iso = F.when(s.rlike(r"^\d{4}-\d{2}-\d{2}$"), s.try_cast("date"))
    make = lambda y, m, d: F.expr("null").cast("date") if False else F.try_make_timestamp(y, m, d, F.lit(0), F.lit(0), F.lit(0)).cast("date")
    begin = F.when(iso.isNotNull(), iso).when(quarter.isNotNull(), make(year, quarter * 3 - 2, F.lit(1))).when(month.isNotNull() & day.isNotNull(), make(year, month, day)).when(month.isNotNull(), make(year, month, F.lit(1)))
    end = F.when(quarter.isNotNull(), F.last_day(F.add_months(begin, 2))).when(month.isNotNull() & day.isNull(), F.last_day(begin)).otherwise(begin)
    return begin.cast("string"), end.cast("string")


#: Secrets, in the order in which they are replaced. Published token formats.
SECRETS = (
    ("PEM_KEY", r"-----BEGIN [A-Z ]*PRIVATE KEY(?: BLOCK)?-----[\s\S]*?-----END [A-Z ]*PRIVATE KEY(?: BLOCK)?-----"),
    ("AWS_SECRET", r"(?i)\baws_?secret_?(?:access_?)?key[\x22\x27]?\s*[=:]\s*[\x22\x27]?[A-Za-z0-9/+]{40}"),
    ("AWS_KEY", r"\bAKIA[0-9A-Z]{16}\b"),
    ("GITHUB_TOKEN", r"\bgh[pousr]_[A-Za-z0-9]{36,}\b"),
    ("JWT", r"\beyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\b"),
    ("OAUTH_TOKEN", r"\bya29\.[A-Za-z0-9_-]+"),
    ("DATABASE_URL", r"\b(?:postgres|postgresql|mysql|mongodb(?:\+srv)?|redis)://[^\s:@/]+:[^\s@]+@[^\s]+"),
    ("STRIPE_KEY", r"\b[srp]k_(?:live|test)_[A-Za-z0-9]{16,}\b"),
    ("SLACK_TOKEN", r"\bxox[abprs]-[A-Za-z0-9-]{10,}"),
    ("PASSWORD", r"(?i)\bpassword\s*[=:]\s*\S+"),
    ("BEARER", r"(?i)\bbearer\s+[A-Za-z0-9._-]{16,}"),
    ("SSN", r"\b\d{3}-\d{2}-\d{4}\b"),
    ("CARD", r"\b(?:\d{4}[ -]){3}\d{4}\b"),
)


#: A run of 40 base64 characters or more that is not all hexadecimal, with both cases and a digit, plus, slash or padding (else long identifiers would count). It needs lookahead, which DuckDB has not, so it is no part of SECRETS and of the SQL.
_B64 = "[A-Za-z0-9+/]"
BASE64 = rf"(?<!{_B64})(?!(?:0x)?[0-9a-fA-F]+(?!{_B64}))(?={_B64}*[a-z])(?={_B64}*[A-Z])(?:(?={_B64}*[0-9+/])|(?={_B64}+=)){_B64}{{40,}}={{0,2}}"


def _redact_known(text: Column) -> Column:
    for kind, pattern in SECRETS:
        text = F.regexp_replace(text, pattern, f"[REDACTED:{kind}]")
    return text


def redact_secrets(text: Column) -> Column:
    """Every secret replaced by ``[REDACTED:KIND]``."""
    return F.regexp_replace(_redact_known(text), BASE64, "[REDACTED:BASE64]")


def secret_count(text: Column) -> Column:
    """Number of secrets, each known kind counted in the text as it stands, base64 in what they leave."""
    total = F.regexp_count(_redact_known(text), F.lit(BASE64))
    for _, pattern in SECRETS:
        total = total + F.regexp_count(text, F.lit(pattern))
    return total


#: Phrases that try to give orders to a reader of data.
INJECTIONS = ("ignore previous", "ignore all", "disregard", "you are now", "new instructions", "system prompt", "override", "bypass")
DEONTIC = r"(?i)\b(?:must|should|shall|never|always|do not|don't|required|forbidden)\b"


def suspicious(text: Column) -> Column:
    return F.coalesce(F.lower(text).rlike("|".join(INJECTIONS)), F.lit(False))
