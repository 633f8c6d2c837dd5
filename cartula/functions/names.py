"""Names of sources, domains and languages under one spelling, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Writings of a missing name, after letter case, spacing and separators are gone.
MISSING = [
    "", "missing", "na", "nan", "nd", "nessuna", "nessuno", "nil", "none", "nondisponibile",
    "nonnota", "nonnoto", "null", "sconosciuta", "sconosciuto", "undefined", "unknown",
]

# File endings that a source name may carry.
FILE_ENDINGS = ["csv", "gz", "json", "jsonl", "ndjson", "parquet", "tsv", "txt", "xml", "zip", "zst"]

# Three-letter codes (ISO 639-2 and 639-3) and names of languages, by two-letter code.
LANGUAGES = {
    "de": ["de", "deu", "deutsch", "ger", "german", "tedesco"],
    "en": ["en", "eng", "english", "inglese"],
    "es": ["es", "espanol", "español", "spa", "spagnolo", "spanish"],
    "fr": ["fr", "fra", "francais", "français", "francese", "fre", "french"],
    "it": ["it", "ita", "italian", "italiano"],
    "nl": ["dut", "dutch", "nederlands", "nl", "nld", "olandese"],
    "pt": ["por", "portoghese", "portuguese", "portugues", "português", "pt"],
}

_ENDING = r"(\.(" + "|".join(FILE_ENDINGS) + r"))+[\s/\\]*$"


def name_key(name: Column) -> Column:
    """The one key of all spellings of a name that differ in letter case, spacing, separators or file ending.

    Null when the name is missing, however that is written.
    """
    bare = F.regexp_replace(F.lower(name), _ENDING, "")
    key = F.regexp_replace(bare, r"[^\p{L}\p{N}]+", "")
    return F.when(~key.isin(MISSING), key)


def spelling(name: Column) -> Column:
    """A readable spelling for reports: small letters, one underscore for each run of separators."""
    bare = F.regexp_replace(F.lower(name), _ENDING, "")
    return F.regexp_replace(F.regexp_replace(bare, r"[^\p{L}\p{N}]+", "_"), "^_+|_+$", "")


def language_key(code: Column) -> Column:
    """Two-letter code of a language however it is written (``It``, ``ita``, ``it-IT``); null when missing."""
    head = F.lower(F.regexp_extract(F.trim(F.regexp_replace(code, r"\s+", " ")), r"^([\p{L}]+)([-_ ].*)?$", 1))
    pairs = [F.lit(x) for two, writings in LANGUAGES.items() for w in writings for x in (w, two)]
    known = F.create_map(*pairs)[head]
    whole = F.regexp_replace(F.lower(code), r"[^\p{L}\p{N}]+", "")
    return F.when(~whole.isin(MISSING) & (head != ""), F.coalesce(known, head))
