"""Column expressions on records: identities, spellings of DOIs, decisions, ratings, redaction."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Forms of personal identifiers that are redacted before storing.
EMAIL = r"[A-Za-z0-9._%+\-]+@[A-Za-z0-9\-]+(?:\.[A-Za-z0-9\-]+)*\.[A-Za-z]{2,}"
ORCID = r"\b\d{4}-\d{4}-\d{4}-\d{3}[\dX]\b"
PROFILE = r"~[A-Za-z][A-Za-z.\-']*(?:_[A-Za-z][A-Za-z.\-']*)+\d+"
DOI = r"^10\.\d{4,9}/\S+$"
DOI_PREFIX = r"(?i)^(?:https?://(?:dx\.)?doi\.org/|doi:\s*)"

# Decision rules in order; the first that matches counts.
DECISION_RULES = [
    ("withdrawn", r"\bwithdrawn?\b", "withdrawn"),
    ("desk_reject", r"\bdesk[ \-]?reject", "desk_reject"),
    ("reject", r"\breject", "reject"),
    ("submitted_to", r"\bsubmitted to\b", "reject"),
    ("oral", r"\boral\b", "accept_oral"),
    ("spotlight", r"\bspotlight\b", "accept_spotlight"),
    ("poster", r"\bposter\b", "accept_poster"),
    ("accept", r"\baccept", "accept"),
]


def text_sha256(c: Column) -> Column:
    return F.sha2(c, 256)


def excerpt_id(kind: Column, source: Column, start: Column, end: Column) -> Column:
    """ex_ and 16 hex digits of the hash over the parts, joined by a zero character."""
    joined = F.concat_ws("\0", kind, source, start.cast("string"), end.cast("string"))
    return F.concat(F.lit("ex_"), F.substring(F.sha2(joined, 256), 1, 16))


def line_feeds(c: Column) -> Column:
    """Line ends as LF; nothing is trimmed."""
    return F.replace(F.replace(c, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))


def redacted(c: Column) -> Column:
    """E-mail addresses, ORCIDs and profile ids as placeholders."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(c, PROFILE, "[PROFILE]"), EMAIL, "[EMAIL]"), ORCID, "[ORCID]")


def holds_personal_data(c: Column) -> Column:
    return c.rlike(EMAIL) | c.rlike(ORCID)


def normalized_doi(c: Column) -> Column:
    """Lower-case DOI without prefix, percent signs decoded; null where it is none. A plus sign stays."""
    bare = F.trim(F.regexp_replace(F.trim(c), DOI_PREFIX, ""))
    decoded = F.when(bare.rlike("%[0-9A-Fa-f]{2}"), F.coalesce(F.try_url_decode(F.replace(bare, F.lit("+"), F.lit("%2B"))), bare)).otherwise(bare)
    low = F.lower(decoded)
    return F.when(low.rlike(DOI), low)


def decision_rule(raw: Column) -> Column:
    """Name of the first rule that matches, or unmatched:<raw>."""
    key = F.lower(F.trim(F.replace(raw, F.lit("_"), F.lit(" "))))
    out = None
    for name, pattern, _ in DECISION_RULES:
        out = F.when(key.rlike(pattern), F.lit(name)) if out is None else out.when(key.rlike(pattern), F.lit(name))
    return out.otherwise(F.concat(F.lit("unmatched:"), raw))


def decision_outcome(raw: Column) -> Column:
    key = F.lower(F.trim(F.replace(raw, F.lit("_"), F.lit(" "))))
    out = None
    for _, pattern, outcome in DECISION_RULES:
        out = F.when(key.rlike(pattern), F.lit(outcome)) if out is None else out.when(key.rlike(pattern), F.lit(outcome))
    return out.otherwise(F.lit("unknown"))


def rating_value(c: Column) -> Column:
    """The number at the head of a rating as written; null where there is none."""
    return F.regexp_extract(c, r"^\s*(-?\d+(?:\.\d+)?)", 1).try_cast("double")


def source_of(work_id: Column) -> Column:
    """The name space before the first colon."""
    return F.when(F.instr(work_id, ":") > 0, F.substring_index(work_id, ":", 1))


def native_key(work_id: Column) -> Column:
    """The part behind the last colon, in lower case; of a URL its id parameter."""
    param = F.regexp_extract(work_id, r"[?&]id=([^&#]+)", 1)
    return F.lower(F.when(param != "", param).when(work_id.contains("://"), work_id).otherwise(F.substring_index(work_id, ":", -1)))


def title_key(c: Column) -> Column:
    """Lower case, runs of anything but ASCII letters and digits as one blank."""
    return F.trim(F.regexp_replace(F.lower(c), r"[^a-z0-9]+", " "))


def split_values(c: Column, sep: str = ";") -> Column:
    """Trimmed, distinct, non-empty parts in order of first mention; null as none."""
    parts = F.transform(F.split(F.coalesce(c, F.lit("")), sep), lambda x: F.trim(x))
    return F.array_distinct(F.filter(parts, lambda x: x != ""))


def language(c: Column) -> Column:
    """ko, en, mixed or unknown by the share of Hangul among Hangul and Latin letters."""
    ko, en = F.regexp_count(c, F.lit("[가-힣]")), F.regexp_count(c, F.lit("[A-Za-z]"))
    share = ko / (ko + en)
    return F.when(ko + en == 0, "unknown").when(share >= 0.7, "ko").when(share <= 0.1, "en").otherwise("mixed")
