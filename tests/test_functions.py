"""Scalar functions and the front end, without or with little Spark."""

import math

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F
from pyspark.sql.types import _parse_datatype_string

from engram import prose
from engram.operators.evoke import SCHEMA as EVOKE
from engram.functions import physics, text, vectors
from engram.mql import MqlError, parse, validate
from engram.mql.ast import And, Compare, Distill, Evoke, Fade, Imprint, Not, Or, Perceive, Recall, Reinforce
from engram.mql.parser import parse_predicate
from engram.operators.archetype import Trace
from engram.operators.predicate import Scope, compile_predicate


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_half_lives():
    assert physics.halflife_from_lambda(physics.lambda_from_halflife(123.0)) == pytest.approx(123.0)
    for bad in (0, -1):
        with pytest.raises(ValueError):
            physics.lambda_from_halflife(bad)
        with pytest.raises(ValueError):
            physics.halflife_from_lambda(bad)


def test_trace(spark):
    t = Trace(1.0, physics.lambda_from_halflife(43_200.0), 0.0, 0.0)
    assert t.weight(43_200.0) == pytest.approx(0.5) and t.weight(-5.0) == 1.0
    t.touch(0.0, 0.1)
    assert t.weight(0.0) == 2.0
    for _ in range(50):
        t.touch(0.0, 0.1)
    assert 1 < t.reinforcement < 12
    for _ in range(500):
        t.touch(0.0, 0.1)
    assert t.lam == physics.LAMBDA_FLOOR
    r = [one(spark, physics.reinforcement_after(F.lit(n))) for n in (0, 1, 5)]
    assert r == [0.0, 1.0, pytest.approx(2.5530103704789475)]
    lam = one(spark, physics.lambda_after(F.lit(t.lam * 2), F.lit(600), 0.1))
    assert lam == physics.LAMBDA_FLOOR and one(spark, physics.lambda_after(F.lit(1e-12), F.lit(0), 0.1)) == 1e-12


@given(s=st.floats(0.01, 1), h=st.floats(10, 1e6), now=st.floats(0, 1e6))
def test_expiry_is_the_threshold(s, h, now):
    lam = math.log(2) / h
    w = s * math.exp(-lam * now)
    alive = s >= 0.05 and now <= math.log(s / 0.05) / lam
    assert abs(w - 0.05) < 1e-12 or alive == (w >= 0.05)


def test_vectors(spark):
    a, z = F.lit([3.0, 4.0]), F.lit([0.0, 0.0])
    assert one(spark, vectors.norm(a)) == 5 and one(spark, vectors.cosine(a, z)) == 0 and one(spark, vectors.cosine(a, a)) == pytest.approx(1)
    assert one(spark, vectors.normalize(a)) == [0.6, 0.8] and one(spark, vectors.normalize(z)) == [0, 0]
    assert one(spark, vectors.dot(F.lit([1.0, 2.0, 3.0]), F.lit([1.0, 1.0]))) == 3
    rows = spark.createDataFrame([(1, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [1.0]), (2, [1.0, 2.0])], "k int, embedding array<double>")
    assert [tuple(r) for r in vectors.centroids(rows, ["k"]).collect()] == [(1, [0.5, 0.5])]


@given(st.lists(st.text(), max_size=8))
def test_fnv1a(texts):
    assert text.fnv1a_batch(texts).tolist() == [text.fnv1a(t) for t in texts]


def test_texts(spark):
    assert text.fnv1a("running") == 6923298942445325836
    assert text.snapshot_filename("user:X/ñ").startswith("user_X__-") and len(text.snapshot_filename("a" * 99)) == 48 + 1 + 16 + 5
    assert [one(spark, text.heuristic_tokens(F.lit(t))) for t in ("", "a", "one two three", "x" * 41)] == [0, 1, 4, 10]
    traits = F.create_map(*map(F.lit, ("b", "2", "a", "1")))
    assert one(spark, text.trait_values(traits)) == "1 2" and one(spark, text.trait_pairs(traits)) == "a 1 b 2"
    assert one(spark, text.with_trait(traits, "a", "9")) == {"b": "2", "a": "9"}
    assert text.seconds(2, "week") == 1_209_600
    with pytest.raises(ValueError):
        text.seconds(1, "H")
    assert one(spark, text.clean_label_column(F.lit(" text trail_running "))) == "trail running"


def test_statements():
    program = """
    perceive interaction FROM subject "u" AS {act: "x y", n: 3.0, m: 2.5, act: z,} WITH salience 0.9 DECAYS halflife 2 week
    DISTILL subject "u" FROM perceptions WHERE a == 1 OR NOT b "t" AND (weight now < 0.5) INTO intention_vector COMPRESSING BY semantic_variance RETAINING {p, q}
    """
    first, second = parse(program)
    assert first == Perceive("u", {"act": "z", "n": "3", "m": "2.5"}, 0.9, 1_209_600.0)
    assert second.where == Or(Compare("a", False, "==", 1.0), And(Not(Compare("b", False, "==", "t")), Compare("weight", True, "<", 0.5)))
    assert second.compressing and second.retaining == ("p", "q")
    assert parse('EVOKE archetype OF "u" WITHIN budget 5 tokens RESOLUTION point ACROSS span 1 h WITHIN budget 7 tokens RETURN compressed_context') == [Evoke("u", "archetype", 3600.0, (), "point", None, 7)]
    assert parse('FADE noise WHERE resonates > 1 PRESERVING archetype_contribution')[0] == Fade("noise", Compare("resonance", True, ">", 1.0), True)
    assert parse('IMPRINT archetype "u" FROM intention_vector RESILIENCE low RECALL facts FROM subject "u" REINFORCE facts FROM subject "u" RESONATING WITH {a} WITHIN k 9') == [Imprint("u", "low"), Recall("u"), Reinforce("u", ("a",), 9)]
    assert parse("-- nothing") == [] and isinstance(parse('DISTILL subject "u" INTO intention_vector')[0], Distill)
    for bad in ('PERCEIVE interaction FROM subject u AS {}', 'EVOKE essence OF "u" ACROSS span 3 s', 'FADE noise WHERE', '"', 'FADE noise WHERE (a 1', "@", "RECALL facts FROM subject"):
        with pytest.raises(MqlError):
            parse(bad)


def test_validation_reports_all_at_once():
    program = 'PERCEIVE interaction FROM subject " " AS {} WITH salience 1.5 EVOKE essence OF "u" EVOKE essence OF "u" WITHIN budget 0 tokens FADE noise WHERE weight now "low" DISTILL subject "u" FROM perceptions WHERE weight "low" INTO intention_vector'
    assert [e.kind for e in validate(parse(program))] == ["empty_subject", "empty_perception", "salience_out_of_range", "missing_budget", "zero_budget", "physical_field_vs_text"]
    assert str(validate(parse(program))[2]) == "statement 1: salience is 1.5, but must be above 0 and at most 1" and "AS { ... }" in str(validate(parse(program))[1])


@pytest.mark.parametrize(
    ("predicate", "expected"),
    [
        ('missing == "x"', False), ('NOT missing == "x"', True), ("n > 3", True), ("n > 3.9", True), ("n > 4", False), ('act > "a"', True), ("act > 1", False), ('weight "x"', False), ("weight >= 0.5", True), ("resonates > 0", False),
        ("odd > 0", False), ("nan == 1", False), ("nan != 1", True), ("NOT (n 4 OR n 5)", False), ('n "4" AND act != "b"', True),
    ],
)
def test_predicates_are_two_valued(spark, predicate, expected):
    traits = F.create_map(*map(F.lit, ("n", "4", "act", "c", "odd", "1d", "nan", "NaN")))
    assert one(spark, compile_predicate(parse_predicate(predicate), Scope({"weight": F.lit(0.5)}, traits))) is expected


def test_prose(spark):
    context = {
        "subject": "u", "core_label": "text yoga", "arc_points": [{"tick": t, "drift": d} for t, d in ((0.0, 0.0), (1.0, 0.4), (2.0, 0.05))], "arc_labels": ["yoga", "trail", "trail", "yoga"], "arc_label_histograms": [[{"label": "trail running", "n": 2}, {"label": "yoga", "n": 3}]],
        "domain_arcs": [{"label": "yoga", "series": [0.7, 0.1, 0.6]}, {"label": "trail", "series": [0.9, 0.4, 0.1]}, {"label": "dull", "series": [0.01, 0.01]}], "anomalies_included": 1, "anomaly_labels": ["crypto"], "represented": 1234, "vectors_returned": 5, "compression_ratio": 246.8,
    }
    bare = context | {"subject": "v", "core_label": "", "arc_points": [], "arc_labels": [], "arc_label_histograms": [], "domain_arcs": [], "anomalies_included": 0, "anomaly_labels": [], "represented": 0, "vectors_returned": 0, "compression_ratio": 0.0}
    flat = bare | {"subject": "w", "arc_points": [{"tick": t, "drift": 0.01} for t in (0.0, 1.0)]}
    kind = _parse_datatype_string(EVOKE)
    rows = spark.createDataFrame([tuple(c.get(f) for f in kind.names) for c in (context, bare, flat)], kind)
    said = {r.subject: r.prose.split("\n") for r in prose.to_prose(rows, "a week").collect()}
    assert said["u"] == [
        "# Memory of u, a week", "- Mostly: yoga", "- Themes: yoga, running, trail", "- Course: went elsewhere and came back (drift +0.05, at most 0.40) ▁█▁", "- Path: yoga > trail > yoga",
        "- Behaviours: yoga: paused, then resumed; trail: less than at first", "- Unusual: 1, such as crypto", "- Basis: 1,234 perceptions in 5 vectors, 246.8 to 1",
    ]
    assert said["v"] == ["# Memory of v, a week", "- Basis: 0 perceptions in 0 vectors, 0.0 to 1"]
    assert said["w"][1] == "- Course: close to where it began (drift +0.00, at most 0.01) ▅▅"
