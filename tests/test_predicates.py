"""Truth tables of the predicate library."""

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quivera.functions import predicates as P
from quivera.functions.geo import Geoshape, point_column
from quivera.functions.predicates import holds

TEXT = "This world is full of 1funny surprises! A Full Yes"
NAME = "fully funny"

CONTAINS = {"world": True, "wOrLD": True, "this": True, "yes": True, "FULL": True, "full surprises": True, "full,surprises,world": True, "a world": True, "worl": False, "funny": False, "full bunny": False}
PREFIX = {"worl": True, "ye": True, "Y": True, "fo": False, "of 1f": False, "ses": False}
CASES = [
    *[(P.text_contains(q), TEXT, v) for q, v in CONTAINS.items()],
    *[(P.text_not_contains(q), TEXT, not v) for q, v in CONTAINS.items()],
    *[(P.text_contains_prefix(q), TEXT, v) for q, v in PREFIX.items()],
    *[(P.text_not_contains_prefix(q), TEXT, not v) for q, v in PREFIX.items()],
    (P.text_contains_regex("fu[l]+"), TEXT, True), (P.text_contains_regex("wor[l]{1}"), TEXT, False), (P.text_contains_regex(r"\dfu\w*"), TEXT, True), (P.text_not_contains_regex("fo"), TEXT, True),
    (P.text_prefix("fully"), NAME, True), (P.text_prefix("ful"), NAME, True), (P.text_prefix("fully fu"), NAME, True), (P.text_prefix("fun"), NAME, False), (P.text_not_prefix("fun"), NAME, True),
    (P.text_regex("(fu[ln]*y) (fu[ln]*y)"), NAME, True), (P.text_regex("(fu[l]*y) (fu[l]*y)"), NAME, False), (P.text_regex("fully"), NAME, False), (P.text_regex(".*"), NAME + "\n", False),
    (P.text_fuzzy("fully funny"), NAME, True), (P.text_fuzzy("fully funy"), NAME, True), (P.text_fuzzy("fully bunny"), NAME, True), (P.text_fuzzy("full gun"), NAME, False),
    (P.text_fuzzy("ah"), "ah", True), (P.text_fuzzy("ai"), "ah", False), (P.text_fuzzy("hop"), "hap", True), (P.text_fuzzy("hop"), "hapy", False), (P.text_not_fuzzy("hop"), "hapy", True),
    (P.text_contains_fuzzy("surprize"), TEXT, True), (P.text_contains_fuzzy("worlt"), TEXT, True), (P.text_contains_fuzzy("zzz"), TEXT, False), (P.text_not_contains_fuzzy("zzz"), TEXT, True),
    (P.text_contains_phrase("full of 1funny"), TEXT, True), (P.text_contains_phrase("world full"), TEXT, False), (P.text_not_contains_phrase("world full"), TEXT, True),
    *[(p("x"), None, False) for p in (P.text_contains, P.text_not_contains, P.text_prefix, P.text_not_prefix, P.text_regex, P.text_not_regex, P.text_fuzzy, P.text_not_fuzzy, P.text_contains_phrase, P.text_not_contains_phrase)],
    (P.text_contains("!"), TEXT, False), (P.starting_with("This"), TEXT, True), (P.ending_with("Yes"), TEXT, True), (P.containing("1fun"), TEXT, True),
    (P.eq(None), None, True), (P.neq(None), None, False), (P.neq("a"), None, False), (P.eq("a"), None, False), (P.within("a", "b"), "a", True), (P.within(()), "a", False),
    (P.without("a"), None, False), (P.without(()), None, True), (P.eq(1), "1", False), (P.neq(1), "1", True), (P.lt(3), "2", False), (P.lte(None), None, True), (P.gt(None), None, False),
]


def test_string_predicates(spark):
    """All cases in one plan: a column each."""
    column = lambda v: F.lit(v).cast("string")
    row = spark.range(1).select(*[holds(p, column(v), T.StringType()).alias(f"c{k}") for k, (p, v, _) in enumerate(CASES)]).first()
    wrong = [(CASES[k][0].name, CASES[k][1], CASES[k][2]) for k in range(len(CASES)) if row[k] is not CASES[k][2]]
    assert not wrong


NAN = float("nan")
NUMBERS = [
    (P.gt(1), NAN, False), (P.lt(1), NAN, False), (P.eq(NAN), NAN, True), (P.gt(1.5), 2.0, True), (P.between(1, 2), 2.0, False), (P.between(1, 2), 1.0, True), (P.inside(1, 2), 1.0, False), (P.outside(1, 2), 2.5, True),
    (P.between(1, 2).negate(), 2.0, True), (P.gt(1).and_(P.lt(3)).negate(), 2.0, False), (P.eq("a"), 1.0, False), (P.eq(2**53 + 1), 1.0, False),
]


def test_number_predicates(spark):
    row = spark.range(1).select(*[holds(p, F.lit(v).cast("double"), T.DoubleType()).alias(f"c{k}") for k, (p, v, _) in enumerate(NUMBERS)]).first()
    assert [row[k] for k in range(len(NUMBERS))] == [v for _, _, v in NUMBERS]


def test_large_longs(spark):
    row = spark.range(1).select(holds(P.eq(2**53 + 1), F.lit(2**53).cast("long"), T.LongType()).alias("a"), holds(P.gt(2**53), F.lit(2**53 + 1).cast("long"), T.LongType()).alias("b")).first()
    assert (row["a"], row["b"]) == (False, True)


def test_multi_valued(spark):
    kind = T.ArrayType(T.IntegerType())
    df = spark.createDataFrame([(0, [1, 5]), (1, []), (2, None)], T.StructType([T.StructField("k", T.IntegerType()), T.StructField("v", kind)]))
    got = {r["k"]: (r["a"], r["b"], r["c"]) for r in df.select("k", *[holds(p, F.col("v"), kind).alias(n) for n, p in (("a", P.gt(4)), ("b", P.neq(1)), ("c", P.eq(None)))]).collect()}
    assert got == {0: (True, True, False), 1: (False, False, True), 2: (False, False, True)}


@pytest.mark.parametrize(
    ("shape", "inside"),
    [
        (Geoshape.circle(0, 0, 200), True), (Geoshape.circle(3, 3, 200), False), (Geoshape.box(-1, -1, 2, 2), True), (Geoshape.box(1.5, 1.5, 2, 2), False),
        (Geoshape.polygon((-2, -2), (-2, 2), (2, 2), (2, -2)), True), (Geoshape.polygon((2, 2), (2, 3), (3, 3)), False), (Geoshape.point(1, 1), True),
        (Geoshape.multi("MultiPolygon", Geoshape.polygon((2, 2), (2, 3), (3, 3)), Geoshape.polygon((0, 0), (0, 2), (2, 2), (2, 0))), True),
        (Geoshape.from_wkt("POLYGON((-2 -2, 2 -2, 2 2, -2 2, -2 -2))"), True), (Geoshape.from_wkt("BUFFER(POINT(0 0), 100)"), False), (Geoshape.from_wkt("ENVELOPE(-1, 2, 2, -1)"), True),
    ],
)
def test_geo_points(spark, shape, inside):
    value = point_column(F.lit(1.0), F.lit(1.0))
    none = point_column(F.lit(None).cast("double"), F.lit(1.0))
    within, meets, apart = P.geo_within(shape), P.geo_intersect(shape), P.geo_disjoint(shape)
    row = spark.range(1).select(*[holds(p, v, T.NullType()).alias(f"c{k}") for k, (p, v) in enumerate([(within, value), (meets, value), (apart, value), (within, none), (apart, none)])]).first()
    assert tuple(row) == (inside, inside, not inside, False, False)


def test_geo_shapes(spark):
    circle, box = Geoshape.circle(0, 0, 500).column(), Geoshape.box(-1, -1, 1, 1).column()
    cases = [
        (P.geo_contains(Geoshape.point(1, 1)), circle, True), (P.geo_contains(Geoshape.circle(0, 0, 600)), circle, False), (P.geo_within(Geoshape.circle(0, 0, 600)), circle, True),
        (P.geo_contains(Geoshape.box(-0.5, -0.5, 0.5, 0.5)), box, True), (P.geo_intersect(Geoshape.circle(3, 0, 300)), box, True), (P.geo_disjoint(Geoshape.circle(9, 0, 300)), box, True),
        (P.geo_within(Geoshape.box(-2, -2, 2, 2)), box, True), (P.geo_intersect(Geoshape.box(0, 0, 9, 9)), circle, True),
    ]
    row = spark.range(1).select(*[holds(p, c, T.NullType()).alias(f"c{k}") for k, (p, c, _) in enumerate(cases)]).first()
    assert [row[k] for k in range(len(cases))] == [x for _, _, x in cases]
    with pytest.raises(ValueError):
        P.geo_within(Geoshape.point(0, 0)).negate()
