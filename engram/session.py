"""A session: the tables of one memory, a logical clock, and the verbs on them.

Perceptions are appended, facts are rewritten by buckets of subjects, archetypes and
swept perceptions as a whole; a result is committed to the session's store before the
next verb uses it, so lineages stay short and a read that touches facts happens once.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable
from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import physics
from .functions.text import heuristic_tokens, seconds, word_count
from .mql import ast, parse, validate
from .operators import arc, archetype, consolidate, evoke, facts, retrieval, tree_index
from .operators.predicate import compile_predicate, fact_scope, perception_scope
from .prose import SPAN, to_prose
from .sources import ingest, store
from .sources.embedder import CachingEmbedder, Embedder, HashingEmbedder

# Defaults of the calls.
SALIENCE, HALFLIFE = 0.7, 7 * physics.DAY
FACT_SALIENCE, FACT_HALFLIFE = 0.9, 30 * physics.DAY
INSIGHT_SALIENCE, INSIGHT_HALFLIFE = 0.9, 90 * physics.DAY
EVOKE_BUDGET, UNIFIED_BUDGET = 800, (800, 200)
FACT_BUCKETS = 64
FACTS_K, THETA_DEDUP = facts.DEFAULT_K, facts.THETA_DEDUP


@dataclass
class Result:
    """Outcome of one statement: its kind, a line of text, and the value."""

    kind: str
    text: str
    value: Any = None


@dataclass(frozen=True)
class TokenCount:
    tokens: int
    method: str


class Session:
    """``tokenizer`` gives the number of tokens of a text."""

    def __init__(self, spark: SparkSession, embedder: Embedder | None = None, *, tokenizer: Callable[[str], int] | None = None, theta_fade: float = physics.THETA_FADE, theta_dedup: float = THETA_DEDUP, resilience: str = "high", folder: str | None = None):
        self.spark, self.embedder = spark, CachingEmbedder(embedder or HashingEmbedder())
        self.theta_fade, self.theta_dedup, self.resilience = theta_fade, theta_dedup, resilience
        self.tokenizer = tokenizer
        self.tables = store.TableStore(spark, folder or f"{store.shared_folder(spark)}/session-{uuid.uuid4().hex}")
        found = self.tables.marks()
        self.now = found.get("now", 0.0)
        self.retriever = tree_index.Retriever()
        self._arrivals: list[tuple] = []
        self._seq = found.get("seq", 0)

    def _marks(self) -> dict[str, float]:
        """The clock and the last number given, committed with whatever they date and number; a session on the same folder goes on from there."""
        return {"now": self.now, "seq": self._seq}

    # tables ------------------------------------------------------------

    def perceptions(self) -> DataFrame:
        self._flush()
        return self.tables.read("perceptions", ingest.SCHEMA)

    def archetypes(self) -> DataFrame:
        return self.tables.read("archetypes", archetype.SCHEMA)

    def facts(self) -> DataFrame:
        return self.tables.read("facts", facts.SCHEMA)

    def _flush(self) -> None:
        """Write what has been perceived since the last read, in one go."""
        if self._arrivals:
            rows = list(self._arrivals)
            self.tables.append("perceptions", self.spark.createDataFrame(rows, ingest.SCHEMA), marks=self._marks())
            del self._arrivals[: len(rows)]  # once they are committed, not before

    def tick(self, by: float) -> float:
        if by < 0:
            raise ValueError("time doesn't run backwards")
        self.now += by
        return self.now

    # perceiving and breathing --------------------------------------------

    def perceive_traits(self, subject: str, traits: dict[str, str], vector: list[float], salience: float, halflife: float) -> None:
        lam = physics.lambda_from_halflife(halflife)
        expires = self.now + math.log(salience / self.theta_fade) / lam if salience >= self.theta_fade else None
        label = " ".join(traits[k] for k in sorted(traits))
        self._arrivals.append((self._next(), subject, [float(x) for x in vector], traits, label, float(salience), lam, self.now, expires))

    def _next(self) -> int:
        self._seq += 1
        return self._seq

    def perceive(self, subject: str, text: str, salience: float = SALIENCE, halflife: float = HALFLIFE) -> None:
        self.perceive_traits(subject, {"text": text}, self.embedder.embed(text), salience, halflife)

    def perceive_vector(self, subject: str, vector: list[float], label: str = "", salience: float = SALIENCE, halflife: float = HALFLIFE) -> None:
        self.perceive_traits(subject, {"text": label} if label else {}, vector, salience, halflife)

    def take(self, perceptions: DataFrame) -> None:
        """Take in a table of perceptions, with numbers and ticks of its own; the clock goes on to the latest."""
        self._flush()
        last = perceptions.agg(F.max("seq").alias("seq"), F.max("tick").alias("tick")).first()
        self._seq, self.now = max(self._seq, last.seq or 0), max(self.now, last.tick or 0.0)
        self.tables.append("perceptions", perceptions.select(*(f.split()[0] for f in ingest.SCHEMA.split(", "))), marks=self._marks())

    def breathe(self, subjects: list[str] | None = None, where: ast.Predicate | str | None = None) -> dict[str, int]:
        """One cycle: distill, imprint, then sweep everything that has faded."""
        p = self.perceptions()
        keep = None if where is None else compile_predicate(where, perception_scope(self.now))
        live = p.where((F.col("tick") <= self.now) & (F.col("expires_at") >= self.now))
        live = live if subjects is None else live.where(F.col("subject").isin(subjects))
        live = live if keep is None else live.where(keep)
        distilled, absorbed = live.agg(F.countDistinct("subject"), F.count("*")).first()
        if absorbed:
            old = self.archetypes() if self.tables.version("archetypes") else None
            self.tables.write("archetypes", consolidate.breathe(old, p, self.now, resilience=self.resilience, where=keep, subjects=subjects), marks=self._marks())
        return {"distilled_subjects": distilled, "perceptions_absorbed": absorbed, "faded": self.fade()}

    def fade(self, where: ast.Predicate | str | None = None) -> int:
        p = self.perceptions()
        drop = None if where is None else compile_predicate(where, perception_scope(self.now))
        left = consolidate.sweep(p, self.now, drop)
        gone = p.count() - left.count()
        if gone:
            self.tables.write("perceptions", left, marks=self._marks())
        return gone

    def consolidate(self, subject: str, amount: float) -> bool:
        a = self.archetypes()
        if a.where(F.col("subject") == subject).isEmpty():
            return False
        self.tables.write("archetypes", archetype.consolidate(a, subject, self.now, amount), marks=self._marks())
        return True

    # evoking --------------------------------------------------------------

    def evoke(self, subject: str, budget: int = EVOKE_BUDGET, *, detail: str = "full", span: float | None = None, query: str | None = None) -> dict | None:
        since = None if span is None else max(self.now - span, 0.0)
        vector = tuple(self.embedder.embed(query)) if query else None
        mine = self.archetypes().where(F.col("subject") == subject)
        found = evoke.evoke(mine, evoke.Request(budget, detail, since, query=vector), self.now).first()
        return found.asDict(recursive=True) if found else None

    def prompt(self, subject: str, budget: int = EVOKE_BUDGET, span_label: str = SPAN) -> str | None:
        """The context of a subject as a note for a language model."""
        mine = self.archetypes().where(F.col("subject") == subject)
        found = to_prose(evoke.evoke(mine, evoke.Request(budget), self.now), span_label).first()
        return found.prose if found else None

    def evoke_unified(self, subject: str, query: str, budget: int = UNIFIED_BUDGET[0], fact_budget: int = UNIFIED_BUDGET[1]) -> dict | None:
        vector = self.embedder.embed(query)
        own = facts.scored(self._facts_of(subject), F.lit(vector), self.now, self.theta_fade).withColumn("cost", word_count(F.col("text")))
        found = evoke.evoke_unified(self.archetypes().where(F.col("subject") == subject), own, evoke.Request(budget), fact_budget, self.now).first()
        return found.asDict(recursive=True) if found else None

    # facts ----------------------------------------------------------------

    def remember(self, subject: str, text: str, provenance: str = "", salience: float = FACT_SALIENCE, halflife: float = FACT_HALFLIFE) -> str:
        return self.remember_vectors([(subject, text, self.embedder.embed(text), provenance)], salience, halflife)[0]

    def remember_vectors(self, rows: list[tuple[str, str, list[float], str]], salience: float, halflife: float) -> list[str]:
        """Remember rows (subject, text, vector, provenance) in order; says of each whether it was inserted or merged."""
        ids = [self._next() for _ in rows]
        new = self.spark.createDataFrame([(i, s, t, [float(x) for x in v], p, self.now, salience, halflife) for i, (s, t, v, p) in zip(ids, rows, strict=True)], "seq bigint, subject string, text string, embedding array<double>, provenance string, tick double, salience double, halflife double")
        only = store.buckets_of([r[0] for r in rows], FACT_BUCKETS)
        self._replace_facts(facts.remember(self.tables.read("facts", facts.SCHEMA, only), new, theta=self.theta_dedup), only)
        kept = {r.seq for r in self.tables.read("facts", facts.SCHEMA, only).where(F.col("seq").isin(ids)).select("seq").collect()}
        return ["inserted" if i in kept else "merged" for i in ids]

    def _facts_of(self, subject: str) -> DataFrame:
        return self.tables.read("facts", facts.SCHEMA, store.buckets_of([subject], FACT_BUCKETS)).where(F.col("subject") == subject)

    def _replace_facts(self, rows: DataFrame, only: list[int] | None = None) -> None:
        """Write all facts, or those of some buckets."""
        self.tables.commit({"facts": rows}, buckets={"facts": FACT_BUCKETS}, only=None if only is None else {"facts": only}, marks=self._marks())

    def search(self, subject: str, query: str, k: int = FACTS_K, where: ast.Predicate | str | None = None) -> list[dict]:
        """The k best living facts, untouched."""
        vector = self.embedder.embed(query)
        rows = facts.scored(self._facts_of(subject), F.lit(vector), self.now, self.theta_fade)
        if where is not None:
            rows = rows.where(compile_predicate(where, fact_scope(self.now, F.col("resonance"))))
        return [r.asDict() for r in rows.orderBy(F.desc("score"), "seq").limit(k).select("seq", "text", "provenance", "score").collect()]

    def recall(self, subject: str, query: str, k: int = FACTS_K) -> list[dict]:
        """The k best living facts, each of which is thereby reinforced."""
        found = self.search(subject, query, k)
        if found:
            ids = self.spark.createDataFrame([(f["seq"],) for f in found], "seq bigint")
            only = store.buckets_of([subject], FACT_BUCKETS)
            self._replace_facts(facts.reinforce(self.tables.read("facts", facts.SCHEMA, only), ids, self.now), only)
        return found

    def fade_facts(self) -> int:
        left = facts.fade(self.facts(), self.now, self.theta_fade)
        gone = self.facts().count() - left.count()
        if gone:
            self._replace_facts(left)
        return gone

    # reflection and retrieval ------------------------------------------------

    def _arc(self, subject: str | None) -> tuple[DataFrame, DataFrame]:
        a = self.archetypes() if subject is None else self.archetypes().where(F.col("subject") == subject)
        rows = a.select("subject", F.posexplode("arc").alias("cycle", "m")).select("subject", "cycle", "m.*")
        counts = rows.select("subject", "cycle", "tick", F.explode("label_histogram").alias("h")).select("subject", "cycle", "tick", "h.label", "h.n")
        return rows, counts

    def reflect(self, subject: str) -> list[dict]:
        return [r.asDict() for r in arc.reflect(*self._arc(subject)).collect()]

    def dream_reflect(self, subject: str) -> int:
        """Remember the insights on a subject as facts; the number made, merged ones included."""
        rows, counts = self._arc(subject)
        modes = archetype.mode_rows(self.archetypes().where(F.col("subject") == subject))
        made = arc.insight_facts(arc.reflect(rows, counts), modes, rows).orderBy("kind", "text").collect()
        if made:
            self.remember_vectors([(r.subject, r.text, r.embedding, "reflection") for r in made], INSIGHT_SALIENCE, INSIGHT_HALFLIFE)
        return len(made)

    def predict_next(self, subject: str, current: str) -> str | None:
        found = arc.predict_next(self._arc(subject)[0]).where(F.col("current") == current).first()
        return found.predicted if found else None

    def resonate(self, query: str, k: int = retrieval.DEFAULT_K) -> list[str]:
        found = self.retriever.resonate_subjects(self.archetypes(), self.embedder.embed(query), k, self.now, version=self.tables.version("archetypes"), theta=self.theta_fade)
        return [r.subject for r in found.orderBy("rank").collect()]

    # tables in and out -------------------------------------------------------

    def save(self, folder: str) -> int:
        """Snapshots of all archetypes, and the facts."""
        store.save_facts(self.facts(), folder, self.theta_dedup)
        return store.save_snapshots(self.archetypes(), folder)

    def load(self, folder: str) -> int:
        self.tables.write("archetypes", store.load_snapshots(self.spark, folder), marks=self._marks())
        rows, self.theta_dedup = store.load_facts(self.spark, folder)
        self._seq = max(self._seq, rows.agg(F.max("seq")).first()[0] or 0)
        self._replace_facts(rows)
        return self.archetypes().count()

    def subjects(self) -> list[str]:
        return [r.subject for r in self.archetypes().select("subject").orderBy("subject").collect()]

    def short_term_len(self) -> int:
        return self.perceptions().count()

    def long_term_len(self) -> int:
        return self.archetypes().count()

    def cache_stats(self) -> dict[str, float]:
        return self.embedder.stats()

    def count_tokens(self, text: str) -> TokenCount:
        """Tokens of a text by the session's tokenizer, else by the heuristic, and which of the two it was."""
        if self.tokenizer is not None:
            return TokenCount(self.tokenizer(text), "tokenizer")
        return TokenCount(self.spark.range(1).select(heuristic_tokens(F.lit(text)).alias("n")).first().n, "heuristic")

    def fits(self, text: str, budget: int) -> bool:
        return self.count_tokens(text).tokens <= budget

    # statements ---------------------------------------------------------------

    def validate(self, source: str) -> list[str]:
        return [str(e) for e in validate(parse(source))]

    def run(self, source: str) -> list[Result]:
        """Run a program; a failed statement doesn't stop the others, a wrong program doesn't start."""
        statements = parse(source)
        if problems := validate(statements):
            raise ValueError("\n".join(map(str, problems)))
        return [self.execute(s) for s in statements]

    def execute(self, s: ast.Statement) -> Result:
        match s:
            case ast.Perceive():
                words = " ".join(f"{k} {s.traits[k]}" for k in sorted(s.traits))
                self.perceive_traits(s.subject, s.traits, self.embedder.embed(words), ingest.SALIENCE if s.salience is None else s.salience, s.halflife or ingest.HALFLIFE)
                return Result("perceived", f"heard: {s.subject}")
            case ast.Distill():
                r = self.breathe([s.subject], s.where)
                return Result("dreamed", "breath: " + ", ".join(f"{k}={v}" for k, v in r.items()), r)
            case ast.Evoke():
                return self._evoke(s)
            case ast.Fade():
                n = self.fade(s.where)
                return Result("faded", f"forgot perceptions: {n}", n)
            case ast.Imprint():
                if not self.consolidate(s.archetype, archetype.IMPRINT_CONSOLIDATION[s.resilience]):
                    return self._unknown(s.archetype)
                return Result("imprinted", f"strengthened: {s.archetype}")
            case ast.Recall():
                found = self.search(s.subject, " ".join(s.resonating), s.k, s.where)
                listed = "; ".join(f"{f['score']:.2f} {f['text']}" for f in found)
                return Result("recalled", f"facts: {listed or 'none'}", found)
            case ast.Reinforce():
                n = len(self.recall(s.subject, " ".join(s.resonating), s.k))
                return Result("reinforced", f"strengthened facts: {n}", n)
        raise TypeError(s)

    def _evoke(self, s: ast.Evoke) -> Result:
        if s.budget is None:
            return Result("error", "failed: a budget is missing (WITHIN budget N tokens)")
        told = {"arc": "full", "point": "none", "summary": "summary"}.get(s.resolution) or {"snapshot": "none"}.get(s.projecting, "full")
        c = self.evoke(s.subject, s.budget, detail=told, span=s.span, query=" ".join(s.resonating) or None)
        if c is None:
            return self._unknown(s.subject)
        return Result("evoked", f"context of {c['subject']}: perceptions={c['represented']}, vectors={c['vectors_returned']}, tokens={c['token_estimate']}", c)

    @staticmethod
    def _unknown(subject: str) -> Result:
        return Result("error", f"failed: nothing alive is known of {subject}")


def duration(text: str) -> float:
    """Seconds of ``7 d`` and the like."""
    amount, unit = text.split()
    return seconds(float(amount), unit)
