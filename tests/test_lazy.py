"""Lazy breaths equal breathing every time, and write in proportion to what changed; sessions go on after reopening."""

import random

import pytest

from engram.operators import consolidate
from engram.operators.lazy import LazyMemory
from engram.session import Session
from engram.sources.embedder import HashingEmbedder
from engram.sources.ingest import SCHEMA as PERCEPTIONS

DAY = 86_400.0


def state(rows):
    r6 = lambda x: round(x, 9)
    return {
        r.subject: (
            [r6(x) for x in r.core], r.core_label, r.represented, [(m.tick, m.absorbed, m.label) for m in r.arc], [(m.label, m.absorbed, r6(m.reinforcement), r6(m.last_touch), [r6(x) for x in m.centroid]) for m in r.modes],
            len(r.anomalies), r6(r.reinforcement), r6(r.last_touch), r6(r["lambda"]),
        )
        for r in rows.collect()
    }


def arrivals(rnd, breath, n):
    rows = []
    for k in range(n):
        tick = (breath - rnd.choice([0.1, 0.5, 2.5, -1.5])) * DAY  # late ones and future ones too
        life = rnd.choice([0.2, 1.0, 3.0, 9.0, None])
        vector = [rnd.choice([0.0, 1.0]), rnd.random(), rnd.random()]
        rows.append((1000 * breath + k, f"s{rnd.randint(0, 11)}", vector, {}, rnd.choice(["a", "b", ""]), 0.7, 1e-5, max(tick, 0.0), None if life is None else tick + life * DAY))
    return rows


def test_equal_to_breathing_every_time(spark, tmp_path):
    rnd = random.Random(4)
    lazy, eager, known, written = LazyMemory(spark, str(tmp_path / "m")), None, [], []
    for breath in range(1, 13):
        new = arrivals(rnd, breath, 6 if breath in (1, 2, 6) else 0)
        if new:
            lazy.perceive(spark.createDataFrame(new, PERCEPTIONS))
            known += new
        everything = spark.createDataFrame(known, PERCEPTIONS)
        eager = consolidate.breathe(eager, everything, breath * DAY)
        eager = spark.createDataFrame(eager.collect(), eager.schema)
        written.append(lazy.breathe(breath * DAY))
        if breath in (1, 5, 9, 12):
            assert state(lazy.archetypes()) == state(eager)
        if breath == 7:  # another session goes on from what is stored
            lazy = LazyMemory(spark, str(tmp_path / "m"))
    one = next(iter(state(eager)))
    assert state(lazy.archetypes(one)) == {one: state(eager)[one]}
    assert sum(written) < 0.5 * 12 * len(state(eager)) and 0 in written
    with pytest.raises(ValueError):
        lazy.breathe(0.0)


def test_a_breath_that_failed_is_run_again(spark, tmp_path):
    lazy = LazyMemory(spark, str(tmp_path / "m"))
    assert lazy.archetypes().count() == 0
    lazy.perceive(spark.createDataFrame([(1, "a", [1.0, 0.0], {}, "x", 0.7, 1e-5, 0.0, 2 * DAY), (2, "b", [1.0, 0.0], {}, "x", 0.7, 1e-5, 0.0, None)], PERCEPTIONS))
    ticks = lazy.ticks
    assert lazy.breathe(DAY) == 1
    again = LazyMemory(spark, str(tmp_path / "m"))
    again.ticks = ticks  # as if the tick had not been written
    assert again.stored().count() == 0 and state(lazy.archetypes()).keys() == {"a"}


def test_a_session_goes_on_where_it_was(spark, tmp_path):
    folder = str(tmp_path / "s")
    first = Session(spark, HashingEmbedder(32), folder=folder)
    first.tick(100.0)
    assert first.remember("u", "one") == first.remember("u", "two") == "inserted"
    first.perceive("u", "walk")
    assert first.short_term_len() == 1
    again = Session(spark, HashingEmbedder(32), folder=folder)
    assert again.now == 100.0
    assert again.remember("u", "one") == "merged" and again.remember("u", "three") == "inserted"
    seqs = [r.seq for r in again.facts().select("seq").collect()]
    assert len(set(seqs)) == 3
    again.recall("u", "two", k=1)
    touched = {r.text: r.reinforcement > 0 for r in again.facts().collect()}
    assert touched == {"one": True, "two": True, "three": False}
    again.perceive("u", "walk again")
    assert sorted(r.seq for r in again.perceptions().select("seq").collect())[0] not in seqs and again.short_term_len() == 2


def test_perceptions_outlive_a_failing_append(spark, tmp_path, monkeypatch):
    s = Session(spark, HashingEmbedder(16), folder=str(tmp_path / "s"))
    s.perceive("u", "walk")
    monkeypatch.setattr(s.tables, "append", lambda *a, **k: (_ for _ in ()).throw(RuntimeError("met another commit")))
    with pytest.raises(RuntimeError):
        s.perceptions()
    monkeypatch.undo()
    assert s.short_term_len() == 1
