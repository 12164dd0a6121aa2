"""String expressions: names, stream addresses, error texts, labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sightmatch.params import MAX_NAME_CHARS

# What str.strip removes: white space, including the wide and no-break kinds.
_BLANKS = r"[\s\x1c-\x1f\x85\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+"


def strip(c: Column) -> Column:
    return F.regexp_replace(c, f"^{_BLANKS}|{_BLANKS}$", "")


def name_error(name: Column) -> Column:
    clean = strip(name)
    bad = clean.isNull() | (clean == "") | (F.char_length(clean) > MAX_NAME_CHARS)
    return F.when(bad, F.lit("invalid_target_name"))


def scheme(uri: Column) -> Column:
    return F.lower(F.regexp_extract(uri, r"^([A-Za-z][A-Za-z0-9+.-]*):", 1))


def mask_uri(uri: Column) -> Column:
    """scheme://host[:port]/*** ; user, password, path and query are dropped."""
    authority = F.regexp_extract(uri, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)
    location = F.regexp_replace(authority, r"^.*@", "")
    host = F.lower(F.regexp_extract(location, r"^(?:\[([^\]]*)\]|[^:]*)", 0))
    bare = F.regexp_replace(host, r"[\[\]]", "")
    port = F.regexp_extract(location, r":0*([1-9][0-9]*)$", 1)
    return F.concat(
        scheme(uri),
        F.lit("://"),
        F.when(bare == "", F.lit("source")).otherwise(bare),
        F.when(port == "", F.lit("")).otherwise(F.concat(F.lit(":"), port)),
        F.lit("/***"),
    )


def safe_error(error_type: Column, message: Column) -> Column:
    """Only model errors keep their text; every other one shows no more than its type."""
    hidden = F.concat(error_type, F.lit(": processing failed"))
    return F.when(error_type == "ModelUnavailableError", message).otherwise(hidden)


def track_label(state: Column, similarity: Column) -> Column:
    word = F.when(state == "confirmed", F.lit("FOUND")).when(
        state == "candidate", F.lit("CANDIDATE")
    )
    return F.when(
        word.isNotNull(), F.concat(word, F.lit("  "), F.format_string("%.2f", similarity))
    )
