"""Text functions of the predicate library: tokens, fuzzy distance, overlap score."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What separates tokens: any character that is neither a letter nor a decimal digit.
SEPARATOR = r"[^\p{L}\p{Nd}]"
MIN_TOKEN = 2


def tokens(column: Column) -> Column:
    """Lower-cased tokens of a text; single characters are no tokens."""
    return F.filter(F.split(F.lower(column), SEPARATOR), lambda t: F.length(t) >= MIN_TOKEN)


def query_tokens(text: str) -> list[str]:
    """``tokens`` for a query string, on the driver."""
    cut = "".join(c if unicodedata.category(c)[0] == "L" or unicodedata.category(c) == "Nd" else " " for c in text.lower())
    return [t for t in cut.split(" ") if len(t) >= MIN_TOKEN]


def fuzzy_distance(term: str) -> int:
    """Edits allowed for a term: none below 3 characters, one below 6, else two."""
    return 0 if len(term) < 3 else 1 if len(term) < 6 else 2


def overlap_score(column: Column, terms: list[str]) -> Column:
    """Share of the query's terms that a text has; the score of raw index queries."""
    found = F.array_intersect(tokens(column), F.array(*[F.lit(t) for t in dict.fromkeys(terms)]))
    return F.coalesce(F.size(found), F.lit(0)) / F.lit(float(max(1, len(set(terms)))))
