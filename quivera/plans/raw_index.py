"""Raw index queries: a small query string over text properties, with scores, order, offset, limit and totals.

The string holds terms ``field:word`` or ``field:"a phrase"`` (with the prefix ``v.`` or ``e.`` or none), joined by
blanks; ``+`` asks for a term, ``-`` forbids it. The score is the share of terms that an element has: a
documented measure of overlap, as scores depend on the index in use elsewhere.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import predicates as Pr
from ..functions.predicates import holds
from .graph import Graph

_TERM = re.compile(r'([+-]?)(?:[vep]\.)?"?(\w+)"?:(?:"([^"]*)"|(\S+))')


class IndexQuery:
    def __init__(self, graph: Graph, query: str):
        self.graph, self.terms = graph, [(sign, key, phrase or word, bool(phrase)) for sign, key, phrase, word in _TERM.findall(query)]
        if not self.terms:
            raise ValueError("the query has no term")
        self.start, self.size, self.orders = 0, None, []

    def limit(self, n: int) -> "IndexQuery":
        self.size = n
        return self

    def offset(self, n: int) -> "IndexQuery":
        self.start = n
        return self

    def orderBy(self, key: str, order: str = "asc") -> "IndexQuery":
        self.orders.append((key, order))
        return self

    def _term(self, df: DataFrame, key: str, text: str, phrase: bool) -> Column:
        if key not in df.columns:
            return F.lit(False)
        p = Pr.text_contains_phrase(text) if phrase else Pr.text_contains_prefix(text[:-1]) if text.endswith("*") else Pr.text_contains(text)
        return holds(p, F.col(f"`{key}`").cast("string"), T.StringType())

    def _found(self, df: DataFrame) -> DataFrame:
        hits = [(sign, self._term(df, key, text, phrase)) for sign, key, text, phrase in self.terms]
        wanted = [h for s, h in hits if s != "-"]
        score = reduce(lambda a, b: a + b, [h.cast("double") for h in wanted]) / len(wanted) if wanted else F.lit(0.0)
        allowed = reduce(lambda a, b: a & b, [h for s, h in hits if s == "+"] + [~h for s, h in hits if s == "-"], F.lit(True))
        some = reduce(lambda a, b: a | b, wanted, F.lit(False))
        return df.where(allowed & some).withColumn("score", score)

    def _page(self, df: DataFrame) -> DataFrame:
        keys = [F.col(k).desc_nulls_last() if o == "desc" else F.col(k).asc_nulls_last() for k, o in self.orders]
        df = df.orderBy(*keys, F.col("score").desc(), "id")
        df = df.offset(self.start) if self.start else df
        return df if self.size is None else df.limit(self.size)

    def vertices(self) -> DataFrame:
        return self._page(self._found(self.graph.vertices()))

    def edges(self) -> DataFrame:
        return self._page(self._found(self.graph.edges()))

    def vertexTotals(self) -> DataFrame:
        return self._found(self.graph.vertices()).agg(F.count("*").alias("total"))

    def edgeTotals(self) -> DataFrame:
        return self._found(self.graph.edges()).agg(F.count("*").alias("total"))
