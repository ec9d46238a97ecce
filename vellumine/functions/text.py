"""Text: redaction, words and keywords, metadata fields in markup, path kinds, error kinds."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

REDACTED = "[REDACTED]"
# Forms of credentials.
CREDENTIALS = [
    r"sk-[A-Za-z0-9_\-]{16,}",
    r"xai-[A-Za-z0-9_\-]{16,}",
    r"gh[pousr]_[A-Za-z0-9]{20,}",
    r"github_pat_[A-Za-z0-9_]{20,}",
    r"(?i)\b(api[_-]?key|token|secret|password|authorization)\b\s*[=:]\s*\S+",
    r"https://[^/\s:@]+:[^/\s@]+@",
]
# Suffixes by kind.
RAW = ["rw2", "cr2", "cr3", "nef", "arw", "raf", "orf", "dng", "pef", "srw"]
JPEG, TIFF, HEIC = ["jpg", "jpeg"], ["tif", "tiff"], ["heic", "heif"]
OTHER_PHOTO = ["png", "webp", "bmp"]
VIDEO = ["mp4", "mov", "m4v", "avi", "mts", "mkv"]
STOPWORDS = ["the", "and", "for", "with", "from", "that", "this", "was", "are", "into", "over", "under", "what", "there"]


def redact(text: Column) -> Column:
    for pattern in CREDENTIALS:
        text = F.regexp_replace(text, pattern, REDACTED.replace("[", r"[").replace("]", r"]"))
    return text


def suffix(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))


def media_kind(path: Column) -> Column:
    s = suffix(path)
    return F.when(s.isin(RAW + JPEG + TIFF + HEIC + OTHER_PHOTO), "photo").when(s.isin(VIDEO), "video").otherwise("unsupported")


def photo_format(path: Column) -> Column:
    s = suffix(path)
    return F.when(s.isin(RAW), "RAW").when(s.isin(JPEG), "JPEG").when(s.isin(TIFF), "TIFF").when(s.isin(HEIC), "HEIC").otherwise("OTHER")


def has_latitude(path: Column) -> Column:
    """Whether the format keeps sensor or 16-bit data."""
    return photo_format(path).isin("RAW", "TIFF")


def markup_value(text: Column, name: str) -> Column:
    """A field of markup, as an attribute or else as an element, in any namespace where none is named; empty if there is none."""
    any_ = "" if ":" in name else r"(?:\w+:)?"
    attribute = F.regexp_extract(text, rf'\b{any_}{name}\s*=\s*"([^"]*)"', 1)
    return F.coalesce(F.nullif(attribute, F.lit("")), F.regexp_extract(text, rf"<{any_}{name}(?:\s[^>]*)?>([^<]*)<", 1))


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(r"([a-z][a-z'-]+)"), 1)


def keywords(text: Column, most: int = 40, least_chars: int = 3) -> Column:
    """The distinct words in order, without short and stop words."""
    kept = F.filter(words(text), lambda w: (F.length(w) >= least_chars) & ~w.isin(STOPWORDS))
    return F.slice(F.array_distinct(kept), 1, most)


def title(text: Column, most: int = 120) -> Column:
    clean = F.trim(F.regexp_replace(text, r"\s+", " "))
    return F.substring(F.concat(F.upper(F.substring(clean, 1, 1)), F.substring(clean, 2, 1 << 30)), 1, most)


def first_words(text: Column, most: int = 12) -> Column:
    return F.array_join(F.slice(F.split(F.trim(text), r"\s+"), 1, most), " ")


def tri_state(value: Column, default: bool = True) -> Column:
    """Words and digits for yes and no as a boolean, others as the default."""
    v = F.lower(F.trim(value))
    return F.when(v.isin("true", "yes", "1", "y"), True).when(v.isin("false", "no", "0", "n"), False).otherwise(default)


def failure_kind(message: Column) -> Column:
    """What an error text is about: auth, billing, rate, model, network or other."""
    m = F.lower(message)
    return (
        F.when(m.rlike("401|invalid.*key|unauthor"), "auth").when(m.rlike("billing|quota|insufficient"), "billing").when(m.rlike("429|rate limit"), "rate_limit")
        .when(m.rlike("model.*not.*found|404"), "model").when(m.rlike("timed? ?out|connection|dns|network"), "network").otherwise("other")
    )
