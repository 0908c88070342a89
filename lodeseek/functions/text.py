"""Text and token-list expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

CLS, SEP, MASK = "[CLS]", "[SEP]", "[MASK]"


def strip(x: Column) -> Column:
    return F.regexp_replace(x, r"^\s+|\s+$", "")


def doc_to_text(title: Column, text: Column) -> Column:
    """Title, a full stop and the text; nulls count as empty."""
    return strip(F.concat(F.coalesce(title, F.lit("")), F.lit(". "), F.coalesce(text, F.lit(""))))


def marked(text: Column, marker: str = "[D] ") -> Column:
    return F.concat(F.lit(marker), text)


def snippet(text: Column, size: int = 90) -> Column:
    return F.regexp_replace(F.substring(text, 1, size), "\n", " ")


def words(text: Column) -> Column:
    return F.filter(F.split(text, r"[ \t\n\x0B\f\r]+"), lambda w: w != "")


def with_specials(tokens: Column) -> Column:
    return F.concat(F.array(F.lit(CLS)), tokens, F.array(F.lit(SEP)))


def truncate(tokens: Column, max_len: int) -> Column:
    """At most max_len tokens, the two special ones counted."""
    return F.slice(tokens, 1, max(0, max_len - 2))


def pad(tokens: Column, max_len: int) -> Column:
    """Special tokens around the truncated tokens, then MASK up to max_len."""
    full = with_specials(truncate(tokens, max_len))
    return F.concat(full, F.array_repeat(F.lit(MASK), F.greatest(F.lit(max_len) - F.size(full), F.lit(0))))


def drop_ends(tokens: Column) -> Column:
    return F.slice(tokens, 2, F.greatest(F.size(tokens) - 2, F.lit(0)))


def keep_mask(tokens: Column) -> Column:
    """Without the first token and the first SEP; padding stays."""
    first = F.array_position(tokens, SEP) - 1
    return F.filter(tokens, lambda t, i: (i != 0) & (i != first))
