"""Folds against plain Python, the session, stores, streams and the shell."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from engram.cli import Shell
from engram.operators import archetype, calibrate, consolidate, distill, evoke, facts
from engram.operators.archetype import Archetype
from engram.session import Session
from engram.sources import fixtures as fx
from engram.sources import store
from engram.sources.embedder import CachingEmbedder, HashingEmbedder
from engram.sources.ingest import perceptions, perceptions_of_texts
from engram.streaming.breath import BreathingStream, event_stream, stream_expiry

SF = "/root/testdata/sf0.001"


def leaders(rows, theta=0.5, most=8):
    """Leader clustering, stated plainly."""
    modes = []
    cos = lambda a, b: 0.0 if not (np.linalg.norm(a) and np.linalg.norm(b)) else float(np.dot(a, b) / np.linalg.norm(a) / np.linalg.norm(b))
    for v in rows:
        near = [cos(np.sum(m, axis=0), v) for m in modes]
        if near and (max(near) >= theta or len(modes) == most):
            modes[near.index(max(near))].append(v)
        else:
            modes.append([v])
    return [(len(m), np.mean(m, axis=0)) for m in modes]


def test_cluster_modes_equals_plain_python(spark):
    rng = np.random.default_rng(3)
    rows = [(s, i, rng.normal(size=3).round(3).tolist(), f"l{i % 4}") for s in ("a", "b", "c") for i in range(60)]
    df = spark.createDataFrame(rows, "subject string, seq long, embedding array<double>, label string").repartition(7)
    for most in (2, 8):
        for r in distill.cluster_modes(df, ["subject"], max_modes=most).collect():
            want = leaders([np.array(x[2]) for x in rows if x[0] == r.subject], most=most)
            assert [s.absorbed for s in r.seeds] == [n for n, _ in want]
            assert all(np.allclose(s.centroid, c) for s, (_, c) in zip(r.seeds, want, strict=True))


def test_remember_equals_plain_python(spark):
    rng = np.random.default_rng(4)
    base = rng.normal(size=(4, 3))
    rows = [(i, "s", f"t{i}", (base[rng.integers(4)] + rng.normal(size=3) * 0.15).tolist(), "p", float(i), 0.9, 1000.0) for i in range(50)]
    df = spark.createDataFrame(rows, "seq long, subject string, text string, embedding array<double>, provenance string, tick double, salience double, halflife double").repartition(5)
    kept = []
    for r in rows:
        v = np.array(r[3])
        near = [(float(v @ k["v"] / np.linalg.norm(v) / np.linalg.norm(k["v"])), i) for i, k in enumerate(kept)]
        if near and max(near)[0] >= 0.95:
            kept[max(near)[1]]["n"] += 1
        else:
            kept.append({"seq": r[0], "v": v, "n": 0})
    first = facts.remember(None, df.where("seq < 20"))
    got = {r.seq: r for r in facts.remember(first, df.where("seq >= 20")).collect()}
    assert sorted(got) == [k["seq"] for k in kept] and len(kept) < 50
    for k in kept:
        r = 0.0
        for _ in range(k["n"]):
            r += 1 / (1 + r)
        assert got[k["seq"]].reinforcement == pytest.approx(r) and got[k["seq"]].text == f"t{k['seq']}"


def test_archetype_evolves_by_volume():
    iv = lambda v, n, label: {"centroid": v, "absorbed": n, "core_label": label, "anomalies": [], "anomaly_labels": [], "label_histogram": [{"label": label, "n": n}], "seeds": [{"centroid": v, "label": label, "label_histogram": [{"label": label, "n": n}], "absorbed": n}]}
    a = Archetype("u")
    a.absorb(iv([1.0, 0.0], 100, "x"), 0.0)
    a.absorb(iv([0.0, 1.0], 50, "y"), 10.0)
    assert np.allclose(a.core, [2 / 3, 1 / 3]) and a.represented == 150 and len(a.modes) == 2 and len(a.arc) == 2
    a.absorb(iv([0.9, 0.1], 50, "x"), 20.0)
    assert a.modes[0]["absorbed"] == 150 and a.modes[0]["origin"] == [1.0, 0.0] and a.modes[0]["reinforcement"] == 1.0
    assert a.modes[1]["lambda"] == pytest.approx(archetype.physics.lambda_from_halflife(720 * 86400))
    assert Archetype.of(a.row()).row() == a.row()


def test_budget_arithmetic():
    budget = evoke.vector_budget(800)
    assert (budget, evoke.arc_quota(budget, "full"), evoke.arc_quota(budget, "summary"), evoke.arc_quota(budget, "none")) == (33, 21, 4, 0)
    assert evoke.thinned(10, 4) == [0, 3, 6, 9] and evoke.thinned(3, 5) == [0, 1, 2] and evoke.thinned(9, 1) == [0]
    shares = evoke.domain_series([{"label_histogram": [{"label": "yoga", "n": a}, {"label": "trail", "n": b}]} for a, b in ((7, 3), (2, 8), (1, 9), (6, 4))], 5)
    assert {s["label"]: s["series"] for s in shares} == {"yoga": [0.7, 0.2, 0.1, 0.6], "trail": [0.3, 0.8, 0.9, 0.4]}


def test_knapsack_skips_and_goes_on(spark):
    rows = spark.createDataFrame([("s", i, s, c) for i, (s, c) in enumerate([(0.9, 5), (0.8, 9), (0.7, 4), (0.6, 1)])], "subject string, seq long, score double, cost long")
    assert [r.seq for r in facts.pack_budget(rows, 10).orderBy("seq").collect()] == [0, 2, 3]
    assert facts.pack_budget(rows, 0).count() == 0


def test_pareto_over_many_ranges(spark):
    rng = np.random.default_rng(2)
    points = [(i, float(a), float(b)) for i, (a, b) in enumerate(rng.integers(0, 400, (600, 2)) / 400)]
    front = {i for i, a, b in points if not any(c >= a and d >= b and (c > a or d > b) for _, c, d in points)}
    assert {r.i for r in calibrate.pareto_front(spark.createDataFrame(points, "i int, x double, y double"), "x", "y").collect()} == front


def test_pareto(spark):
    rows = spark.createDataFrame([(0, 0.9, 0.2), (1, 0.2, 0.9), (2, 0.5, 0.5), (3, 0.6, 0.6)], "i int, x double, y double")
    assert sorted(r.i for r in calibrate.pareto_front(rows, "x", "y").collect()) == [0, 1, 3]


def test_breathing_twice(spark):
    p = fx.perceptions_onehot(spark, SF)
    day = 86_400.0
    once = consolidate.breathe(None, p, 3 * day)
    twice = {r.subject: r for r in consolidate.breathe(once, p, 5 * day).collect()}
    live = lambda t: {r.subject: r["count"] for r in p.where((F.col("tick") <= t) & (F.col("expires_at") >= t)).groupBy("subject").count().collect()}
    a, b = live(3 * day), live(5 * day)
    assert {s: r.represented for s, r in twice.items()} == {s: a.get(s, 0) + b.get(s, 0) for s in a | b}
    assert all(len(r.arc) == (s in a) + (s in b) for s, r in twice.items())


def test_ingest(spark):
    rows = spark.createDataFrame([(1, "u", 0.0, "Trail run"), (2, "u", 5.0, None)], "seq long, subject string, tick double, text string")
    got = perceptions_of_texts(rows.where("text is not null"), HashingEmbedder(16)).first()
    assert got.traits == {"text": "Trail run"} and got.label == "Trail run" and len(got.embedding) == 16
    with pytest.raises(ValueError):
        perceptions(rows)
    cache = CachingEmbedder(HashingEmbedder(8))
    assert cache.stats()["hit_rate"] == 1.0
    assert cache.embed("a") == cache.embed("a") and cache.stats() == {"hits": 1, "misses": 1, "entries": 1, "hit_rate": 0.5}
    cache.clear()
    assert cache.stats()["entries"] == 0


@pytest.fixture(scope="module")
def memory(spark, tmp_path_factory):
    s = Session(spark, HashingEmbedder(32), folder=str(tmp_path_factory.mktemp("memory")))
    for i in range(6):
        s.perceive("user:x", "trail running" if i % 3 else "yoga class")
    s.breathe()
    s.tick(86_400)
    s.breathe()
    return s


def test_session(memory):
    s = memory
    assert (s.short_term_len(), s.long_term_len(), s.subjects()) == (6, 1, ["user:x"])
    context = s.evoke("user:x", 800, query="trail running")
    assert context["represented"] == 12 and len(context["arc_points"]) == 2 and "trail" in context["resonating_mode"] and s.evoke("nobody") is None
    assert s.prompt("user:x").startswith("# Memory of user:x") and s.prompt("nobody") is None and s.resonate("trail running") == ["user:x"]
    assert s.remember("user:x", "likes hills") == "inserted" and s.remember("user:x", "likes hills") == "merged" and s.remember("user:x", "owns a dog") == "inserted"
    before = s.search("user:x", "hills", 1)[0]
    assert before["text"] == "likes hills" and s.recall("user:x", "hills", 1)[0]["text"] == "likes hills" and s.search("user:x", "hills", 1)[0]["score"] > before["score"]
    assert [f["text"] for f in s.search("user:x", "hills", 5, "resonates > 0.5")] == ["likes hills"]
    both = s.evoke_unified("user:x", "hills", 800, 2)
    assert [f["text"] for f in both["facts"]] == ["likes hills"] and both["gist"]["represented"] == 12 and both["total_tokens"] == 2 + both["gist"]["token_estimate"]
    assert s.count_tokens("a text of words").method == "heuristic" and s.fits("", 0) and not s.fits("a text of words", 1)
    s.tokenizer = lambda text: len(text)
    assert (s.count_tokens("abc").tokens, s.count_tokens("abc").method, s.fits("abc", 2), s.fits("abc", 3)) == (3, "tokenizer", False, True)
    assert s.reflect("user:x") == [] and s.dream_reflect("user:x") == 0
    s.tick(400 * 86_400)
    assert s.fade() == 6 and s.fade_facts() >= 1


def test_snapshots(spark, memory, tmp_path):
    folder = str(tmp_path / "saved")
    assert store.load_snapshots(spark, folder).count() == 0
    assert memory.save(folder) == 1
    path = next(p for p in (tmp_path / "saved").iterdir() if p.name not in ("facts.json",) and not p.name.startswith("."))
    again = store.load_snapshots(spark, folder).first().asDict(recursive=True)
    assert again == memory.archetypes().first().asDict(recursive=True)
    old = json.loads(path.read_text())
    for m in old["modes"]:
        del m["origin"], m["label_histogram"]
    path.write_text(json.dumps(old))
    for crc in path.parent.glob(".*.crc"):
        crc.unlink()
    loaded = store.load_snapshots(spark, folder).first()
    assert all(m.origin == m.centroid and m.label_histogram == [] for m in loaded.modes)
    assert all(m.origin == m.centroid for m in store.read_snapshot_table(spark, folder).first().modes)
    path.write_text("{")
    with pytest.raises(ValueError):
        store.load_snapshots(spark, folder)


def test_versioned_tables(spark, tmp_path):
    tables = store.TableStore(spark, str(tmp_path / "t"))
    assert tables.read("x", "subject string, n int").count() == 0 and tables.version("x") is None
    first = tables.write("x", spark.createDataFrame([("a", 1), ("b", 2)], "subject string, n int"))
    second = tables.upsert("x", "subject string, n int", spark.createDataFrame([("b", 3), ("c", 4)], "subject string, n int"))
    assert first != second == tables.version("x")
    rows = lambda name="x", only=None: sorted(map(tuple, tables.read(name, "", only).collect()))
    assert rows() == [("a", 1), ("b", 3), ("c", 4)]
    tables.append("x", spark.createDataFrame([("d", 5)], "subject string, n int"))
    assert rows() == [("a", 1), ("b", 3), ("c", 4), ("d", 5)]
    tables.write("y", tables.read("x", ""), buckets=8)
    only = store.buckets_of(["b"], 8)
    assert ("b", 3) in rows("y", only) and rows("y") == rows()
    tables.commit({"y": spark.createDataFrame([("b", 9)], "subject string, n int")}, buckets={"y": 8}, only={"y": only})
    assert rows("y", only) == [("b", 9)] and ("b", 3) not in rows("y") and {r for r in rows() if store.buckets_of([r[0]], 8) != only} < set(rows("y"))


def test_a_failure_between_any_two_steps_of_a_commit_leaves_the_version_before(spark, tmp_path, monkeypatch):
    tables = store.TableStore(spark, str(tmp_path / "t"))
    one, two = (spark.createDataFrame([(k,) for k in ks], "n int") for ks in ([1], [2, 3]))
    tables.commit({"a": one, "b": one}, marks={"batch": 1})
    told = lambda: [sorted(r.n for r in tables.read(t, "").collect()) for t in "ab"] + [tables.marks()["batch"]]
    before = told()
    put, create = store.TableStore._put, store._Files.create

    def fails(after):
        done = []

        def run(self, *given):
            if len(done) == after:
                raise OSError("lost")
            done.append(given)
            return put(self, *given)

        return run

    for after in (0, 1):  # before the parts of the first table, and of the second
        with monkeypatch.context() as m:
            m.setattr(store.TableStore, "_put", fails(after))
            with pytest.raises(OSError, match="lost"):
                tables.commit({"a": two, "b": two}, marks={"batch": 2})
        assert told() == before

    def half(self, path, text):
        create(self, path, text[: len(text) // 2])
        raise OSError("lost")

    with monkeypatch.context() as m:  # within the manifest
        m.setattr(store._Files, "create", half)
        with pytest.raises(OSError, match="lost"):
            tables.commit({"a": two, "b": two}, marks={"batch": 2})
    assert told() == before
    tables.commit({"a": two, "b": two}, marks={"batch": 2})
    assert told() == [[2, 3], [2, 3], 2]


def test_commits_that_meet(spark, tmp_path, monkeypatch):
    tables = store.TableStore(spark, str(tmp_path / "t"))
    one = spark.createDataFrame([(1,)], "n int")
    tables.write("a", one)
    put = store.TableStore._put

    def meets(name):
        def run(self, *given):
            monkeypatch.setattr(store.TableStore, "_put", put)
            tables.append(name, one)
            return put(self, *given)

        return run

    monkeypatch.setattr(store.TableStore, "_put", meets("a"))
    with pytest.raises(RuntimeError, match="another commit"):
        tables.write("a", one)
    for way in (tables.append, tables.write):
        monkeypatch.setattr(store.TableStore, "_put", meets("b"))
        way("a" if way == tables.write else "b", one)
    assert tables.read("a", "").count() == 1 and tables.read("b", "").count() == 3


def test_shell(memory):
    shell = Shell(memory)
    assert shell.eval("") == "" and shell.eval(":quit") is shell.eval(":q") is None and shell.eval(":tick -1").startswith(":tick SECONDS") and shell.eval(":x").startswith("no such command")
    assert shell.eval(":tick 60").startswith("time: ") and shell.eval(":save").startswith(":save [FOLDER]") and shell.eval(":help").count("\n") == 7
    assert shell.eval("NOPE").startswith("not understood: ") and "budget" in shell.eval('EVOKE essence OF "u" WITHIN budget 0 tokens')
    assert shell.eval('EVOKE essence OF "zz" WITHIN budget 100 tokens') == "failed: nothing alive is known of zz"


@pytest.fixture
def arrivals(spark, tmp_path):
    """Three batches of 30 perceptions."""
    events = spark.read.parquet(f"{SF}/events.parquet").where("event_id < 90")
    for k in range(3):
        events.where(f"event_id div 30 = {k}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    return event_stream(spark, str(tmp_path / "in")).withColumn("embedding", fx.one_hot())


@pytest.mark.parametrize(("watermark", "breaths", "pending"), [(30, 3, 0), (60, 1, 30), (256, 0, 90)])
def test_pressure_counts_pending_rows(spark, tmp_path, arrivals, watermark, breaths, pending):
    run = BreathingStream(store.TableStore(spark, str(tmp_path / "tables")), watermark=watermark)
    run.start(arrivals, str(tmp_path / "checkpoint")).awaitTermination()
    s = run.stats
    assert (s.breaths, s.breaths_pressure, s.pending, s.short_term_len + s.faded) == (breaths, breaths, pending, 90)
    assert (s.long_term_len > 0) == (breaths > 0) and s.prometheus().count("\n") == 30 and f"engram_pending {pending}\n" in s.prometheus()
    if pending:
        run.breathe_now()
        assert (s.breaths_ondemand, s.pending) == (1, 0)


def test_a_batch_tried_again_counts_once_and_missed_ticks_are_skipped(spark, tmp_path):
    p = fx.perceptions_onehot(spark, SF)
    time = [0.0]
    run = BreathingStream(store.TableStore(spark, str(tmp_path / "tables")), span=60, clock=lambda: time[0])
    run.breathe(p.where("seq < 10"), 0)
    time[0] = 200.0  # three ticks have passed: one breath
    run.breathe(p.where("seq between 10 and 19"), 1)
    held = lambda: (sum(r.represented for r in run.store.read("archetypes", "").collect()), run.store.read("perceptions", "").count(), run.stats.breaths)
    before = held()
    assert before[2] == run.stats.breaths_basal == 1 and run.next_tick == 240.0
    run.breathe(p.where("seq between 10 and 19"), 1)
    again = BreathingStream(run.store, run.stats)  # a new driver
    again.breathe(p.where("seq < 10"), 0)
    assert held() == before
    run.breathe(p.where("seq between 20 and 24"), 2)
    assert run.stats.pending == 5 and held()[1:] == (before[1] + 5, 1)


def test_timers_expire_perceptions_as_event_time_passes(spark, tmp_path):
    p = spark.read.parquet(f"{SF}/events.parquet").where("event_id < 900")
    for k in range(3):  # in order of time
        p.where(f"event_id div 300 = {k}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    got = {r.subject: r.living for r in stream_expiry(spark, str(tmp_path / "in")).collect()}
    rows = fx.perceptions_of(p)
    end = rows.agg(F.max("tick")).first()[0]
    assert got == {r.subject: r["count"] for r in rows.where(F.col("expires_at") >= end - 1e-3).groupBy("subject").count().collect()}
