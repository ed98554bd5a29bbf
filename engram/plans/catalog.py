"""Registered queries over the driver's tables. Their DuckDB twins are in :mod:`oracles`."""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import physics, text, vectors
from ..operators import arc as arcs
from ..operators import archetype, calibrate, consolidate, distill, evoke, facts, retrieval, tree_index
from ..operators.lazy import LazyMemory
from ..operators.predicate import compile_predicate, fact_scope, perception_scope, select_where, with_hot_traits
from ..sources import fixtures as fx
from ..sources.shared import shared_folder
from . import oracles

Query = Callable[[SparkSession, str], DataFrame]

_QUERIES: dict[str, Query] = {}

NOW = oracles.NOW
THETAS = oracles.THETAS
SINCE = oracles.SINCE

ROWS_A_FILE = 50_000  # of a turn of the breathing stream


def query(f: Query) -> Query:
    _QUERIES[f.__name__] = f
    return f


def r6(c: F.Column | str, name: str | None = None) -> F.Column:
    column = F.round(c, 6) + 0.0  # no negative zero
    return column.alias(name or c) if name or isinstance(c, str) else column


def _subject_sums(rows: DataFrame) -> DataFrame:
    return rows.groupBy("subject", "label").agg(F.count("*").alias("n"), r6(F.sum("w"), "weight"))


# physics ---------------------------------------------------------------


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten labels with most life left, over all subjects' living perceptions."""
    p = fx.perceptions(spark, sf_dir).where((F.col("tick") <= NOW) & (F.col("expires_at") >= NOW))
    w = physics.weight(NOW, F.col("salience"), F.col("lambda"), F.col("tick"))
    return _subject_sums(p.withColumn("w", w)).orderBy(F.desc("weight"), "subject", "label").limit(10)


@query
def top_living_labels(spark, sf_dir):
    return flagship(spark, sf_dir)


@query
def halflife_lambda(spark, sf_dir):
    rows = fx.perceptions(spark, sf_dir).select("label", "halflife", "lambda").distinct()
    return rows.select("label", F.round("lambda", 12).alias("lambda"), r6(physics.halflife_from_lambda(F.col("lambda")), "halflife"))


@query
def decayed_weight(spark, sf_dir):
    p = fx.perceptions(spark, sf_dir)
    return p.select("seq", r6(physics.delta_t(NOW, F.col("tick")), "elapsed"), r6(physics.weight(NOW, F.col("salience"), F.col("lambda"), F.col("tick")), "weight"))


@query
def alive_at(spark, sf_dir):
    p = fx.perceptions(spark, sf_dir).where((F.col("tick") <= NOW) & (F.col("expires_at") >= NOW))
    return _subject_sums(p.withColumn("w", physics.weight(NOW, F.col("salience"), F.col("lambda"), F.col("tick"))))


@query
def faded_at(spark, sf_dir):
    p = fx.perceptions(spark, sf_dir).where(F.col("tick") <= NOW)
    return p.where(physics.is_faded(NOW, F.col("expires_at"))).select("seq", "subject", "label")


@query
def expiry_tick(spark, sf_dir):
    return fx.perceptions(spark, sf_dir).select("seq", F.round("expires_at", 3).alias("expires_at"))


@query
def reinforced_trace(spark, sf_dir):
    p = fx.perceptions(spark, sf_dir)
    t = p.groupBy("subject", "label").agg((F.count("*") - 1).alias("touches"), F.max("tick").alias("last_touch"), F.min_by("salience", "seq").alias("salience"), F.first("lambda").alias("l0"))
    r, lam = physics.reinforcement_after(F.col("touches")), physics.lambda_after(F.col("l0"), F.col("touches"), 0.1)
    rows = t.select("subject", "label", "touches", "last_touch", "salience", r.alias("r"), lam.alias("lam"))
    w = physics.weight(fx.CYCLES * fx.CYCLE_SECONDS, F.col("salience"), F.col("lam"), F.col("last_touch"), F.col("r"))
    return rows.select("subject", "label", "touches", r6("r", "reinforcement"), F.round("lam", 12).alias("lambda"), r6(w, "weight"))


# vectors ---------------------------------------------------------------


@query
def vector_norms(spark, sf_dir):
    v = F.col("embedding")
    return fx.read(spark, sf_dir, "embeddings").select("vec_id", r6(vectors.sq_norm(v), "sq_norm"), r6(vectors.norm(v), "norm"))


@query
def pairwise_cosine(spark, sf_dir):
    rows = fx.read(spark, sf_dir, "embeddings")
    return retrieval.all_pairs(rows, "label", "vec_id", "embedding", 6)


@query
def centroid_by_label(spark, sf_dir):
    c = vectors.centroids(fx.read(spark, sf_dir, "embeddings"), ["label"])
    return c.select("label", F.posexplode("centroid").alias("pos", "x")).select("label", "pos", r6("x", "value"))


@query
def unit_vectors(spark, sf_dir):
    rows = fx.perceptions_graded(spark, sf_dir).select("seq", F.posexplode(vectors.normalize(F.col("embedding"))).alias("pos", "x"))
    return rows.select("seq", "pos", r6("x", "value"))


@query
def unit_distance(spark, sf_dir):
    c = vectors.centroids(fx.read(spark, sf_dir, "embeddings"), ["label"]).select("label", vectors.normalize(F.col("centroid")).alias("c"))
    rows = fx.read(spark, sf_dir, "embeddings").join(c, "label")
    d = vectors.euclidean(vectors.normalize(F.col("embedding")), F.col("c"))
    return rows.select("vec_id", r6(d, "distance"))


# projections and predicates -----------------------------------------------


@query
def trait_text(spark, sf_dir):
    t = F.col("traits")
    wider = text.with_trait(t, "k", F.concat(F.lit("n"), t["k"]))
    return fx.perceptions(spark, sf_dir).select("seq", text.trait_values(t).alias("representative"), text.trait_pairs(t).alias("embedded"), text.trait_values(wider).alias("replaced"))


def _predicate(name: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        p = fx.perceptions(spark, sf_dir).where(F.col("tick") <= NOW)
        return p.where(compile_predicate(oracles.PREDICATES[name][0], perception_scope(NOW))).select("seq", "subject")

    _QUERIES[name] = run


for _name in oracles.PREDICATES:
    _predicate(_name)


@query
def predicate_pruned(spark, sf_dir):
    """The numeric trait predicate over a table with traits in columns of their own, sorted by them, so that the scan skips row groups."""
    path = f"{shared_folder(spark)}/traits-{uuid.uuid4().hex}"
    with_hot_traits(fx.perceptions(spark, sf_dir), ["act", "k"]).repartitionByRange("trait_act", "number_k").sortWithinPartitions("trait_act", "number_k").write.parquet(path)
    return select_where(spark.read.parquet(path), oracles.PREDICATES["predicate_trait_numeric"][0], perception_scope(NOW)).select("seq")


@query
def fact_predicate(spark, sf_dir):
    near = vectors.cosine(F.col("embedding"), F.lit(oracles.QUERY_5))
    rows = fx.perceptions_onehot(spark, sf_dir).where(F.col("tick") <= NOW).withColumns({"last_touch": F.col("tick"), "reinforcement": F.lit(0.0)})
    return rows.where(compile_predicate(oracles.FACT_PREDICATE, fact_scope(NOW, near))).select("seq")


@query
def fade_where(spark, sf_dir):
    p = fx.perceptions(spark, sf_dir).where(F.col("tick") <= NOW)
    left = consolidate.sweep(p, NOW, compile_predicate("act == \"error\" AND age > 86400", perception_scope(NOW)))
    return left.groupBy("label").agg(F.count("*").alias("n"))


@query
def point_lookup(spark, sf_dir):
    return fx.perceptions(spark, sf_dir).where(F.col("subject") == "user:1").orderBy("seq").select("seq", "label", "k")


# distill ------------------------------------------------------------------


def _alive(spark: SparkSession, sf_dir: str, now: float = NOW) -> DataFrame:
    return fx.perceptions_onehot(spark, sf_dir).where((F.col("tick") <= now) & (F.col("expires_at") >= now))


@query
def distill_histogram(spark, sf_dir):
    return distill.label_counts(_alive(spark, sf_dir), ["subject"])


@query
def distill_core_label(spark, sf_dir):
    return distill.histograms(distill.label_counts(_alive(spark, sf_dir), ["subject"]), ["subject"]).select("subject", "core_label", F.size("label_histogram").cast("long").alias("labels"))


@query
def distill_split(spark, sf_dir):
    rows = distill.split(_alive(spark, sf_dir), ["subject"])
    return rows.select("seq", "subject", r6("cosine"), "redundant", "anomaly")


@query
def distill_intentions(spark, sf_dir):
    rows = distill.intentions(_alive(spark, sf_dir), ["subject"])
    return rows.select("subject", "absorbed", "redundant", F.size("anomalies").cast("long").alias("anomalies"), F.array_join("anomaly_labels", ",").alias("anomaly_labels"), "core_label")


@query
def distill_cycles(spark, sf_dir):
    live = fx.alive_per_cycle(fx.perceptions(spark, sf_dir))
    return live.groupBy("subject", "cycle").agg(F.count("*").alias("absorbed"), F.countDistinct("label").alias("labels"), F.sum("k").alias("k_sum"))


@query
def modes_onehot(spark, sf_dir):
    seeds = distill.cluster_modes(_alive(spark, sf_dir), ["subject"]).select("subject", F.explode("seeds").alias("s"))
    return seeds.select("subject", F.col("s.mode").alias("mode"), F.col("s.label").alias("label"), F.col("s.absorbed").alias("absorbed"))


@query
def histogram_merge(spark, sf_dir):
    live = fx.alive_per_cycle(fx.perceptions(spark, sf_dir))
    counts = distill.label_counts(live, ["subject", "cycle"])
    return distill.merge_histograms(counts, ["subject"])


# archetypes -----------------------------------------------------------------


def _cycles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(subject, cycle, tick, absorbed, centroid) of every cycle."""
    live = fx.alive_per_cycle(fx.perceptions_onehot(spark, sf_dir))
    sums = [F.sum(F.col("embedding")[i]) for i in range(len(fx.LABELS))]
    n = F.count("*")
    return live.groupBy("subject", "cycle").agg((F.first("cycle") * fx.CYCLE_SECONDS).alias("tick"), n.alias("absorbed"), F.array(*(s / n for s in sums)).alias("centroid"))


@query
def archetype_core(spark, sf_dir):
    run = archetype.running_core(_cycles(spark, sf_dir))
    return run.select("subject", "cycle", "pos", r6("core"), "represented")


@query
def archetype_trace(spark, sf_dir):
    run = archetype.running_core(_cycles(spark, sf_dir)).where("pos = 0")
    return run.select("subject", "cycle", r6("reinforcement"), F.round(F.col("lambda") * 1e6, 9).alias("lambda_e6"))


def archetypes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return consolidate.replay(fx.alive_per_cycle(fx.perceptions_onehot(spark, sf_dir)), fx.CYCLE_SECONDS)


@query
def archetype_modes(spark, sf_dir):
    m = archetype.mode_rows(archetypes(spark, sf_dir))
    return m.select("subject", "mode", "label", "absorbed", r6("reinforcement"), F.round(F.col("lambda") * 1e6, 9).alias("lambda_e6"), r6("drift"))


@query
def mode_drift(spark, sf_dir):
    """How far each mode has moved from the direction it was born with; vectors lie between 0.5 and 1 within a mode."""
    a = consolidate.replay(fx.alive_per_cycle(fx.perceptions_graded(spark, sf_dir)), fx.CYCLE_SECONDS)
    return archetype.mode_rows(a).select("subject", "label", "absorbed", F.round("drift", 5).alias("drift"))


@query
def archetype_summary(spark, sf_dir):
    a = archetypes(spark, sf_dir)
    return a.select("subject", "represented", F.size("arc").cast("long").alias("milestones"), F.size("modes").cast("long").alias("modes"), F.size("anomalies").cast("long").alias("anomalies"), "core_label", r6("reinforcement"), r6("last_touch"))


@query
def archetype_consolidated(spark, sf_dir):
    now = 31 * fx.CYCLE_SECONDS
    a = archetype.consolidate(archetypes(spark, sf_dir), "user:1", now, archetype.IMPRINT_CONSOLIDATION["high"])
    return a.select("subject", r6("reinforcement"), F.round(F.col("lambda") * 1e6, 9).alias("lambda_e6"), "last_touch")


@query
def breath_report(spark, sf_dir):
    return consolidate.breath_report(fx.perceptions(spark, sf_dir), [fx.CYCLE_SECONDS * (i + 1) for i in range(fx.CYCLES)])


@query
def breathe_once(spark, sf_dir):
    p = fx.perceptions_onehot(spark, sf_dir)
    a = consolidate.breathe(None, p, NOW, where=compile_predicate('NOT act == "view"', perception_scope(NOW)))
    return a.select("subject", "represented", "core_label", F.size("modes").cast("long").alias("modes"))


@query
def breathe_twice(spark, sf_dir):
    """A second breath evolves the archetypes of the first one, and creates those of new subjects."""
    p = fx.perceptions_onehot(spark, sf_dir)
    a = consolidate.breathe(consolidate.breathe(None, p, oracles.EARLIER), p, NOW)
    return a.select("subject", "represented", "core_label", F.size("modes").cast("long").alias("modes"), F.size("arc").cast("long").alias("milestones"), r6("reinforcement"), "last_touch")


@query
def lazy_breaths(spark, sf_dir):
    """Six breaths, five days apart, each of which writes the subjects that changed; read after the last one."""
    memory = LazyMemory(spark, f"{shared_folder(spark)}/lazy-{uuid.uuid4().hex}")
    p, span = fx.perceptions_onehot(spark, sf_dir), 5 * fx.CYCLE_SECONDS
    for k in range(1, 7):
        memory.perceive(p.where((F.col("tick") > (k - 1) * span if k > 1 else F.lit(True)) & (F.col("tick") <= k * span)))
        memory.breathe(k * span)
    a = memory.archetypes()
    return a.select("subject", "represented", F.size("arc").cast("long").alias("milestones"), F.size("modes").cast("long").alias("modes"), "core_label", r6("reinforcement"), "last_touch")


@query
def basal_breaths(spark, sf_dir):
    """Perceptions by the day whose breath first sees them."""
    p = fx.perceptions(spark, sf_dir).withColumn("breath", F.greatest(F.lit(1), F.ceil(F.col("tick") / fx.CYCLE_SECONDS)).cast("int"))
    return p.groupBy("breath").agg(F.count("*").alias("arrived"), F.countDistinct("subject").alias("subjects"))


@query
def pressure_breaths(spark, sf_dir):
    """A breath whenever 256 perceptions of all subjects are pending; ``seq`` counts arrivals."""
    p = fx.perceptions(spark, sf_dir).withColumn("breath", F.floor(F.col("seq") / 256))
    return p.groupBy("breath").agg(F.count("*").alias("arrived"), F.countDistinct("subject").alias("subjects"), F.round(F.max("tick"), 3).alias("tick"))


@query
def predictive_compression(spark, sf_dir):
    p = consolidate.predictive_compression(fx.perceptions_onehot(spark, sf_dir))
    return p.select("subject", r6("modal"), r6("centroid"), "held_out")


# the arc ----------------------------------------------------------------------


def _arc(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    live = fx.alive_per_cycle(fx.perceptions(spark, sf_dir))
    ranked = distill.label_counts(live, ["subject", "cycle"])
    tick = F.col("cycle") * fx.CYCLE_SECONDS
    counts = ranked.select("subject", "cycle", tick.alias("tick"), "label", "n")
    shares = [F.coalesce(F.sum(F.when(F.col("label") == x, F.col("n"))), F.lit(0)).cast("double") for x in fx.LABELS]
    arc = ranked.groupBy("subject", "cycle").agg(F.max(tick).alias("tick"), F.array(*shares).alias("direction"), F.sum("n").alias("absorbed"), F.min_by("label", "rank").alias("label"))
    return arc, counts


@query
def arc_drift(spark, sf_dir):
    return arcs.drift(_arc(spark, sf_dir)[0], SINCE).select("subject", "cycle", r6("drift"), "label")


@query
def arc_thinned(spark, sf_dir):
    return arcs.thin(arcs.drift(_arc(spark, sf_dir)[0]), 7).select("subject", "cycle", r6("drift"))


@query
def domain_trajectories(spark, sf_dir):
    t = arcs.trajectories(_arc(spark, sf_dir)[1], 3)
    return t.select("subject", "label", "rank", r6("score"), F.posexplode("series").alias("pos", "x")).select("subject", "label", "rank", "score", "pos", r6("x", "share"))


@query
def dominant_transition(spark, sf_dir):
    return arcs.transitions(_arc(spark, sf_dir)[0])


@query
def predict_next(spark, sf_dir):
    return arcs.predict_next(_arc(spark, sf_dir)[0])


@query
def revivals(spark, sf_dir):
    return arcs.revivals(_arc(spark, sf_dir)[1])


@query
def reflect_insights(spark, sf_dir):
    return arcs.reflect(*_arc(spark, sf_dir))


@query
def dream_facts(spark, sf_dir):
    arc, counts = _arc(spark, sf_dir)
    live = fx.alive_per_cycle(fx.perceptions(spark, sf_dir))
    modes = live.select("subject", "label", fx.one_hot().alias("centroid"), F.lit(0).alias("mode")).distinct()
    rows = arcs.insight_facts(arcs.reflect(arc, counts), modes, arc)
    return rows.select("subject", "kind", "text", F.array_position("embedding", 1.0).cast("long").alias("place"))


@query
def arc_reading(spark, sf_dir):
    rows = arcs.reading(arcs.drift(_arc(spark, sf_dir)[0]).withColumn("drift", F.round("drift", 9)))
    return rows.select("subject", r6("drift_total"), r6("drift_peak"), "span", "inflexions", "direction")


@query
def domain_trend(spark, sf_dir):
    t = arcs.trajectories(_arc(spark, sf_dir)[1], 5)
    return t.select("subject", "label", arcs.domain_trend(F.col("series")).alias("trend"), arcs.is_faded_peak(F.col("series")).alias("faded_peak"))


@query
def label_islands(spark, sf_dir):
    return arcs.label_islands(_arc(spark, sf_dir)[0]).select("subject", "cycle", "label")


# facts ------------------------------------------------------------------------


@query
def facts_dedup(spark, sf_dir):
    f = facts.remember(None, fx.facts_onehot(spark, sf_dir))
    return f.select("seq", "subject", "text", r6("created_at"), r6("reinforcement"), F.round(F.col("lambda") * 1e6, 9).alias("lambda_e6"), r6("last_touch"))


def _remembered(f: DataFrame) -> DataFrame:
    return f.select("seq", "subject", "text", r6("created_at"), r6("reinforcement"), F.round(F.col("lambda") * 1e6, 9).alias("lambda_e6"), r6("last_touch"))


@query
def facts_dedup_graded(spark, sf_dir):
    """Vectors at all angles around the threshold, so that what merges depends on the order of arrival."""
    return _remembered(facts.remember(None, fx.facts_graded(spark, sf_dir)))


@query
def facts_dedup_hot(spark, sf_dir):
    """The same with half of all rows in one subject, which is folded group by group."""
    return _remembered(facts.remember(None, fx.facts_graded(spark, sf_dir, hot=True), hot=300))


@query
def facts_search(spark, sf_dir):
    """The three best facts of each subject for the first vector."""
    q = fx.read(spark, sf_dir, "embeddings").where("vec_id = 0").first()["embedding"]
    rows = facts.search(fx.facts_vec(spark, sf_dir), q, oracles.FACTS_NOW)
    return rows.select("subject", "rank", "seq", r6("score"))


@query
def facts_recall_topk(spark, sf_dir):
    """Ten nearest living facts for every twentieth vector: a stated query set against all rows."""
    rows = facts.living(fx.facts_vec(spark, sf_dir), oracles.FACTS_NOW)
    asked = fx.read(spark, sf_dir, "embeddings").where("vec_id % 20 = 0")
    found = retrieval.nearest_exact(rows, "seq", "embedding", asked, "vec_id", "embedding", 10, weight=F.col("weight"))
    return found.select("query", "rank", F.col("id").alias("seq"), r6("score"))


@query
def facts_reinforced(spark, sf_dir):
    f = fx.facts_vec(spark, sf_dir)
    q = fx.read(spark, sf_dir, "embeddings").where("vec_id = 0").first()["embedding"]
    after = facts.reinforce(f, facts.search(f, q, oracles.FACTS_NOW), oracles.FACTS_NOW)
    return after.select("seq", r6("reinforcement"), F.round(F.col("lambda") * 1e6, 9).alias("lambda_e6"), "last_touch")


@query
def facts_faded(spark, sf_dir):
    return facts.fade(fx.facts_vec(spark, sf_dir), oracles.FACTS_FADE_NOW).select("seq", "subject")


@query
def knapsack(spark, sf_dir):
    f = fx.facts_text(spark, sf_dir)
    w = physics.weight(oracles.TEXT_NOW, F.col("salience"), F.col("lambda"), F.col("created_at"))
    return facts.pack_budget(f.withColumn("score", F.round(w, 9)), oracles.FACT_BUDGET).select("subject", "seq", "cost", "left")


# retrieval and evoke ------------------------------------------------------------


@query
def resonate_flat(spark, sf_dir):
    rows = retrieval.resonate(archetypes(spark, sf_dir), oracles.QUERY_5, 10, 31 * fx.CYCLE_SECONDS)
    return rows.select("subject", r6("score"))


@query
def resonate_modes(spark, sf_dir):
    a, q = archetypes(spark, sf_dir), F.lit(oracles.QUERY_5)
    return a.select("subject", r6(retrieval.mode_resonance(F.col("modes"), F.col("core"), q), "resonance"), retrieval.resonant_mode_label(F.col("modes"), q).alias("label"))


@query
def resonate_ann(spark, sf_dir):
    """Ten nearest by the tree of centroids for every twentieth vector, all vectors indexed."""
    rows = fx.read(spark, sf_dir, "embeddings")
    index = tree_index.TreeIndex(rows, "vec_id", "embedding")
    return index.join(rows.where("vec_id % 20 = 0"), "vec_id", "embedding", 10).select("query", "rank", "id", r6("cosine"))


@query
def resonate_subjects(spark, sf_dir):
    return tree_index.Retriever(flat_limit=10).resonate_subjects(archetypes(spark, sf_dir), oracles.QUERY_5, 5, 31 * fx.CYCLE_SECONDS)


@query
def evoke_budget(spark, sf_dir):
    rows = evoke.evoke_counts(archetypes(spark, sf_dir), evoke.Request(800), 31 * fx.CYCLE_SECONDS)
    return rows.withColumn("compression_ratio", r6("compression_ratio"))


@query
def evoke_contexts(spark, sf_dir):
    rows = evoke.evoke(archetypes(spark, sf_dir), evoke.Request(800, "summary", query=tuple(oracles.QUERY_5)), 31 * fx.CYCLE_SECONDS)
    return rows.select("subject", "core_label", F.size("arc_points").cast("long").alias("points"), F.size("domain_arcs").cast("long").alias("domains"), "vectors_returned", "token_estimate", "resonating_mode")


@query
def evoke_unified(spark, sf_dir):
    a = archetypes(spark, sf_dir)
    f = fx.perceptions_onehot(spark, sf_dir).where(F.col("tick") <= NOW)
    w = physics.weight(NOW, F.col("salience"), F.col("lambda"), F.col("tick"))
    texts = f.select("subject", "seq", F.concat_ws(" ", "label", "seq").alias("text"), F.lit("event").alias("provenance"), F.round(w, 9).alias("score"), F.lit(2).cast("long").alias("cost"))
    u = evoke.evoke_unified(a, texts, evoke.Request(100), 20, 31 * fx.CYCLE_SECONDS)
    return u.select("subject", F.size("facts").cast("long").alias("facts"), "fact_tokens", "total_tokens", F.col("gist.vectors_returned").alias("gist_vectors"))


# calibration ---------------------------------------------------------------------


@query
def confusion_metrics(spark, sf_dir):
    rows = fx.labelled_scores(spark, sf_dir)
    m = calibrate.metrics(calibrate.confusion(rows, [], F.col("score") >= 1000.0, F.col("actual")))
    return m.select("tp", "fp", "fn", "tn", r6("precision"), r6("recall"), r6("f1"))


@query
def threshold_sweep(spark, sf_dir):
    m = calibrate.sweep(fx.labelled_scores(spark, sf_dir), THETAS)
    return m.select("theta", "tp", "fp", "fn", "tn", r6("precision"), r6("recall"), r6("f1"))


@query
def pareto_front(spark, sf_dir):
    m = calibrate.sweep(fx.labelled_scores(spark, sf_dir), THETAS).select("theta", r6("precision"), r6("recall"))
    return calibrate.pareto_front(m, "precision", "recall")


def _traces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.perceptions(spark, sf_dir).select("salience", "lambda", F.lit(0.0).alias("reinforcement"), F.col("tick").alias("last_touch"), F.col("label").isin("error", "click").alias("is_noise"))


def _labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return distill.split(_alive(spark, sf_dir), ["subject"]).select(F.round("cosine", 9).alias("cosine"), F.when(F.col("label") == "purchase", "redundant").when(F.col("label") == "error", "anomaly").otherwise("signal").alias("kind"))


@query
def fade_sweep(spark, sf_dir):
    m = calibrate.sweep_fade(_traces(spark, sf_dir), horizon=NOW)
    return m.select("theta", "tp", "fp", "fn", "tn", r6("f1"), r6("memory_loss"), r6("objective"))


@query
def semantic_sweep(spark, sf_dir):
    m = calibrate.sweep_semantic(_labelled(spark, sf_dir))
    return m.select("theta_redundancy", "theta_anomaly", r6("f1_redundancy"), r6("f1_anomaly"), r6("signal_faded"), r6("objective"))


@query
def calibration_report(spark, sf_dir):
    """The verdict on both default thresholds, over the labelled rows of both sweeps."""
    semantic, fade = calibrate.report(_labelled(spark, sf_dir), _traces(spark, sf_dir), horizon=NOW)
    keep = [r6("best_objective"), r6("default_objective"), "keep_default"]
    return semantic.select(F.lit("semantic").alias("what"), *keep).unionByName(fade.select(F.lit("fade").alias("what"), *keep))


# scalar functions ------------------------------------------------------------------


@query
def token_counts(spark, sf_dir):
    rows = fx.read(spark, sf_dir, "conversations")
    return rows.select("conv_id", "turn", text.word_count(F.col("text")).alias("words"), text.heuristic_tokens(F.col("text")).alias("tokens"))


@query
def fnv1a_tokens(spark, sf_dir):
    words = fx.perceptions(spark, sf_dir).select(F.concat_ws("-", "label", "k").alias("token")).distinct()
    return words.select("token", text.fnv1a_column(F.col("token")).cast("string").alias("hash"))


@query
def snapshot_names(spark, sf_dir):
    s = fx.perceptions(spark, sf_dir).select("subject").distinct()
    safe = F.substring(F.regexp_replace("subject", "[^0-9A-Za-z]", "_"), 1, 48)
    h = text.fnv1a_column(F.col("subject"))
    return s.select("subject", F.concat(safe, F.lit("-"), F.lpad(F.lower(F.conv(h.cast("string"), 10, 16)), 16, "0"), F.lit(".json")).alias("name"))


@query
def common_terms(spark, sf_dir):
    rows = fx.read(spark, sf_dir, "documents").where("text is not null").select("lang", "text", F.lit(1).cast("long").alias("n"))
    return text.common_terms(rows, ["lang"], "text", "n", 10)


@query
def clean_labels(spark, sf_dir):
    p = fx.perceptions(spark, sf_dir).select(F.concat(F.lit("act "), "label", F.lit("_"), F.lit("x ")).alias("raw")).distinct()
    return p.select("raw", text.clean_label_column(F.col("raw")).alias("label"))


@query
def hashed_embeddings(spark, sf_dir):
    """Hashing embeddings of the distinct turns, joined back to all of them."""
    from ..sources.embedder import HashingEmbedder, embed

    rows = embed(fx.read(spark, sf_dir, "conversations"), "text", HashingEmbedder(64))
    digest = F.aggregate(F.transform("embedding", lambda x, i: x * (i + 1)), F.lit(0.0), lambda a, x: a + x)
    return rows.select("conv_id", "turn", F.round(vectors.norm(F.col("embedding")), 6).alias("norm"), r6(digest, "digest"))


# statements and streams ------------------------------------------------------------


@query
def mql_program(spark, sf_dir):
    """A program of the seven verbs over a session that holds all events as perceptions."""
    from ..session import Session

    session = Session(spark)
    session.take(fx.perceptions_onehot(spark, sf_dir))
    results = session.run(oracles.PROGRAM)
    rows = [(i, r.kind, r.text) for i, r in enumerate(results)]
    return spark.createDataFrame(rows, "statement int, kind string, result string")


def _turns(events: DataFrame) -> list[DataFrame]:
    """The events in six turns of five days; every 97th is a turn late."""
    span = F.floor((F.unix_micros(F.col("ts").cast("timestamp")) / 1e6 - fx.EPOCH_START) / (5 * fx.CYCLE_SECONDS))
    turn = F.least(F.greatest(span, F.lit(0)), F.lit(5)) + F.when(F.col("event_id") % 97 == 0, 1).otherwise(0)
    return [events.where(turn == k) for k in range(7)]


def _arrivals(spark: SparkSession, sf_dir: str) -> str:
    """A folder to which the events have come in turns. Files hold a sixteenth of all rows at most; their number doesn't follow that of the table's files."""
    from ..streaming.breath import QUEUE, enqueue

    events = fx.read(spark, sf_dir, "events")
    folder = f"{shared_folder(spark)}/arrivals-{uuid.uuid4().hex}"
    n = events.count()
    for part in _turns(events):
        enqueue(part.repartition(3), folder, max(QUEUE, n // 16))
    return folder


@query
def stream_breaths(spark, sf_dir):
    """Basal breaths of the event stream; the streaming twin of ``basal_breaths``."""
    from ..streaming.breath import stream_basal

    return stream_basal(spark, _arrivals(spark, sf_dir))


@query
def stream_pressure(spark, sf_dir):
    """Breaths of the event stream by the number of pending perceptions."""
    from ..streaming.breath import stream_by_pressure

    return stream_by_pressure(spark, _arrivals(spark, sf_dir))


@query
def stream_living(spark, sf_dir):
    """Perceptions per subject after the stream ran dry, by a stateful operator with expiry."""
    from ..streaming.breath import stream_living

    return stream_living(spark, _arrivals(spark, sf_dir), NOW)


@query
def stream_expiry(spark, sf_dir):
    """Perceptions per subject that live ten days before the stream's end, expired by event-time timers; some rows come five days late."""
    from ..streaming import breath

    return breath.stream_expiry(spark, _arrivals(spark, sf_dir), "10 days")


@query
def stream_breathing(spark, sf_dir):
    """The breathing stream itself: a batch for each turn of arrivals, whatever its number of files, which brings on a breath."""
    from ..sources.store import TableStore
    from ..streaming import breath

    folder = f"{shared_folder(spark)}/breathing-{uuid.uuid4().hex}"
    run = breath.BreathingStream(TableStore(spark, f"{folder}/tables"), watermark=1)
    events = fx.read(spark, sf_dir, "events")
    files = max(1, math.ceil(events.count() / 7 / ROWS_A_FILE))
    for part in _turns(events):
        breath.enqueue(part.repartition(files), f"{folder}/arrivals", 2 * ROWS_A_FILE)
        rows = breath.event_stream(spark, f"{folder}/arrivals", None).withColumn("embedding", fx.one_hot())
        stream = run.start(rows, f"{folder}/checkpoint")
        stream.awaitTermination()
    a = run.store.read("archetypes", archetype.SCHEMA)
    return a.select("subject", "represented", F.size("arc").cast("long").alias("milestones"), "core_label", r6("last_touch"))


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(oracles.ORACLES)
