"""DuckDB twins of the registered queries."""

from __future__ import annotations

import math

DAY = 86_400.0
NOW = 10 * DAY
SINCE = 12 * DAY
FACTS_NOW = 2_000_000.0
FACTS_FADE_NOW = 12_000_000.0
TEXT_NOW = 20 * DAY
FACT_BUDGET = 120
EARLIER = NOW - 5 * DAY
THETAS = [100.0, 300.0, 500.0, 1000.0, 2000.0, 4000.0, 8000.0]
QUERY_5 = [0.2, 0.1, 0.9, 0.3, 0.15]
FACT_PREDICATE = 'resonates > 0.25 AND NOT (weight < 0.3) OR age <= 3600 OR act == "view"'
PREDICATES = {
    "predicate_and_or_not": ('act == "click" AND weight now >= 0.1 OR NOT (salience < 0.5) AND age > 86400', "(label = 'click' AND w >= 0.1) OR (NOT (salience < 0.5) AND dt > 86400)"),
    "predicate_trait_numeric": ('k >= 50 AND k != 77 AND act < "signup"', "k >= 50 AND k <> 77 AND label < 'signup'"),
    "predicate_missing_is_false": ('NOT missing == "x" AND (other > 3 OR k "7" OR resonates > 0 OR weight "low")', "k = 7"),
    "predicate_implicit_equality": ('act "purchase" AND NOT k 5', "label = 'purchase' AND k <> 5"),
}
PROGRAM = """
FADE noise WHERE act == "error" AND weight now < 0.5 -- of all subjects
DISTILL subject "user:1" FROM perceptions WHERE act == "click" OR k >= 50 INTO intention_vector
DISTILL subject "user:2" INTO intention_vector
IMPRINT archetype "user:1" FROM intention_vector RESILIENCE high
IMPRINT archetype "user:3" FROM intention_vector RESILIENCE low
PERCEIVE interaction FROM subject "user:x" AS {act: "trail running", place: "hills"} WITH salience 0.9 DECAYS halflife 7 d
FADE noise WHERE place == "hills"
RECALL facts FROM subject "user:1" RESONATING WITH {trail} WHERE resonates > 0.1 WITHIN k 2
REINFORCE facts FROM subject "user:1" RESONATING WITH {trail} WITHIN k 1
EVOKE essence OF "user:3" WITHIN budget 100 tokens
"""

LN2 = math.log(2)
FLOOR = LN2 / (10 * 365 * DAY)
LABELS = ("click", "error", "purchase", "signup", "view")

P0 = f"""p0 AS (
  SELECT event_id AS seq, 'user:' || user_id AS subject, epoch(ts) - 1704067200 AS tick, 0.1 + 0.9 * value / 600 AS salience, event_type AS label,
         CASE event_type WHEN 'error' THEN 3600.0 WHEN 'click' THEN 21600.0 WHEN 'view' THEN 43200.0 WHEN 'signup' THEN 604800.0 ELSE 2592000.0 END::DOUBLE AS halflife,
         regexp_extract(props, '"k": *([0-9]+)', 1)::INTEGER AS k
  FROM events
), p AS (SELECT *, {LN2!r} / halflife AS lam0, salience * exp(-{LN2!r} / halflife * greatest({NOW} - tick, 0)) AS w, greatest({NOW} - tick, 0) AS dt FROM p0)"""
ALIVE = P0 + f", alive AS (SELECT * FROM p WHERE tick <= {NOW} AND w >= 0.05)"
CYCLES = P0 + f""", cyc AS (SELECT i::INTEGER AS cycle, (i * {DAY})::DOUBLE AS ct FROM range(1, 31) t(i)),
live AS (SELECT p.*, cycle, ct FROM p, cyc WHERE tick <= ct AND salience * exp(-lam0 * (ct - tick)) >= 0.05)"""
COUNTS = CYCLES + """, counts AS (SELECT subject, cycle, any_value(ct) AS tick, label, count(*) AS n FROM live GROUP BY subject, cycle, label),
ranked AS (SELECT *, row_number() OVER (PARTITION BY subject, cycle ORDER BY n DESC, label) AS r FROM counts),
arc AS (SELECT subject, cycle, any_value(tick) AS tick, sum(n)::BIGINT AS absorbed, min_by(label, r) AS label FROM ranked GROUP BY subject, cycle),
origin AS (SELECT subject, min(cycle) AS cycle FROM arc GROUP BY subject),
drift AS (
  SELECT a.subject, a.cycle, a.tick, a.label, 1 - coalesce(d.dot, 0) / (sqrt(x.sq) * sqrt(y.sq)) AS drift
  FROM arc a JOIN origin o USING (subject)
  JOIN (SELECT subject, cycle, sum(n * n)::DOUBLE AS sq FROM counts GROUP BY 1, 2) x ON x.subject = a.subject AND x.cycle = a.cycle
  JOIN (SELECT subject, cycle, sum(n * n)::DOUBLE AS sq FROM counts GROUP BY 1, 2) y ON y.subject = a.subject AND y.cycle = o.cycle
  LEFT JOIN (SELECT c.subject, c.cycle, sum(c.n * f.n)::DOUBLE AS dot FROM counts c JOIN origin USING (subject) JOIN counts f ON f.subject = c.subject AND f.cycle = origin.cycle AND f.label = c.label GROUP BY 1, 2) d
    ON d.subject = a.subject AND d.cycle = a.cycle
),
shares AS (
  SELECT g.subject, g.cycle, g.tick, g.label, coalesce(c.n, 0) / g.absorbed AS share
  FROM (SELECT a.subject, a.cycle, a.tick, a.absorbed, l.label FROM arc a JOIN (SELECT DISTINCT subject, label FROM counts) l USING (subject)) g
  LEFT JOIN counts c ON c.subject = g.subject AND c.cycle = g.cycle AND c.label = g.label
)"""
STEPS = COUNTS + """, steps AS (SELECT * FROM (SELECT subject, label AS a, lead(label) OVER (PARTITION BY subject ORDER BY cycle) AS b FROM arc) WHERE b IS NOT NULL AND a <> b),
moved AS (SELECT subject, a AS from_label, b AS to_label, n AS support FROM (SELECT *, row_number() OVER (PARTITION BY subject ORDER BY n DESC, a, b) AS r FROM (SELECT subject, a, b, count(*) AS n FROM steps GROUP BY 1, 2, 3)) WHERE r = 1),
topped AS (SELECT *, max(share) OVER w AS peak, count(*) OVER w AS milestones FROM shares WINDOW w AS (PARTITION BY subject, label)),
at_top AS (SELECT *, min(CASE WHEN abs(share - peak) <= 1e-6 THEN cycle END) OVER (PARTITION BY subject, label) AS top FROM topped WHERE milestones >= 3 AND peak > 0),
fell AS (SELECT *, min(CASE WHEN cycle > top AND share < peak * 0.25 THEN cycle END) OVER (PARTITION BY subject, label) AS low FROM at_top),
back AS (SELECT DISTINCT subject, label AS domain FROM fell WHERE cycle > low AND share >= peak * 0.25)"""


def r_of(n: str) -> str:
    """R(n), the reinforcement after n touches."""
    return f"CASE WHEN {n} > 0 THEN list_reduce(range(1, ({n})::BIGINT + 1), lambda r, i: r + 1 / (1 + r), 0.0::DOUBLE) ELSE 0.0 END"


def lam_of(base: str, n: str, c: float = 0.1) -> str:
    return f"CASE WHEN {n} > 0 THEN greatest({base} * pow({1 - c!r}, {n}), {FLOOR!r}) ELSE {base} END"


ARCH_LAMBDA = LN2 / (720 * DAY)
_NORM = "sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x)))"
_UNIT = ", ".join(f"CASE WHEN label = '{x}' THEN 1.0 ELSE 0.0 END" for x in LABELS)

#: Cosine of a label's rows to the centroid of its subject's living rows: n of the label over the norm of all counts.
SPLIT = ALIVE + """, c AS (SELECT subject, label, count(*) AS n FROM alive GROUP BY 1, 2),
s AS (SELECT subject, sqrt(sum(n * n)) AS norm FROM c GROUP BY 1),
scored AS (SELECT seq, a.subject, a.label, n / norm AS cosine FROM alive a JOIN c ON c.subject = a.subject AND c.label = a.label JOIN s ON s.subject = a.subject)"""
FLAGS = "cosine >= 0.92 AS redundant, cosine < 0.92 AND cosine <= 0.30 AS anomaly"

MODES = COUNTS + f""", cycles_of AS (SELECT subject, cycle, row_number() OVER (PARTITION BY subject ORDER BY cycle) - 1 AS j FROM arc),
first_seen AS (SELECT subject, cycle, label, min(seq) AS first_seq, count(*) AS n FROM live GROUP BY 1, 2, 3),
born AS (SELECT f.*, j, row_number() OVER (PARTITION BY f.subject, label ORDER BY f.cycle) AS nth FROM first_seen f JOIN cycles_of c ON c.subject = f.subject AND c.cycle = f.cycle),
mode_rows AS (SELECT subject, label, min_by(cycle, nth) AS birth, min_by(first_seq, nth) AS birth_seq, min_by(j, nth) AS j, sum(n)::BIGINT AS absorbed, count(*) - 1 AS merges FROM born GROUP BY 1, 2),
modes AS (
  SELECT *, (row_number() OVER (PARTITION BY subject ORDER BY birth, birth_seq) - 1)::INTEGER AS mode,
         CASE WHEN j > 1 THEN greatest({ARCH_LAMBDA!r} * pow(0.9, j - 1), {FLOOR!r}) ELSE {ARCH_LAMBDA!r} END AS l0
  FROM mode_rows
)"""
#: Facts in order of arrival: the leaders by a fold over the list of rows, then each other row's nearest leader of those before it.
GRADED = f"""WITH {P0.replace("{", "{{").replace("}", "}}")}, g AS (SELECT seq, {{subject}} AS subject, tick, k, 0.04 * k + 0.0001 * k * k AS a FROM p),
lists AS (SELECT subject, list([{{{{'seq': seq, 'a': a}}}}] ORDER BY seq) AS l FROM g GROUP BY 1),
led AS (SELECT subject, unnest(list_reduce(l, lambda acc, x: CASE WHEN len(list_filter(acc, lambda y: abs(y.a - x[1].a) <= acos(0.95))) > 0 THEN acc ELSE list_concat(acc, x) END)) AS y FROM lists),
leaders AS (SELECT subject, y.seq AS seq, y.a AS a FROM led),
merged AS (SELECT lead_seq, count(*) AS n, max_by(tick, seq) AS last_touch FROM (SELECT g.seq, g.tick, min_by(l.seq, abs(l.a - g.a)) AS lead_seq FROM g JOIN leaders l ON l.subject = g.subject AND l.seq < g.seq AND abs(l.a - g.a) <= acos(0.95) GROUP BY 1, 2) GROUP BY 1),
f AS (SELECT g.seq, g.subject, k, tick, coalesce(n, 0) AS n, coalesce(last_touch, tick) AS last_touch FROM leaders l JOIN g ON g.seq = l.seq LEFT JOIN merged ON lead_seq = l.seq)
SELECT seq, subject, 'k ' || k || ' ' || seq AS text, round(tick, 6) AS created_at, round({r_of('n')}, 6) AS reinforcement, round(({lam_of(repr(LN2 / (30 * DAY)), 'n')}) * 1e6, 9) AS lambda_e6, round(last_touch, 6) AS last_touch FROM f"""

SUMMARY = MODES + """, odd AS (
  SELECT subject, sum(n)::BIGINT AS anomalies FROM (SELECT subject, cycle, label, n, n / sqrt(sum(n * n) OVER (PARTITION BY subject, cycle)) AS cosine FROM counts) WHERE cosine < 0.92 AND cosine <= 0.30 GROUP BY 1
), arch AS (SELECT subject, sum(absorbed)::BIGINT AS represented, count(*) AS milestones, max_by(label, cycle) AS core_label, max(tick) AS last_touch FROM arc GROUP BY 1)"""


def _life(now: float) -> str:
    n = "(milestones - 1)"
    return f"exp(-({lam_of(repr(ARCH_LAMBDA), n)}) * greatest({now} - last_touch, 0)) * (1 + {r_of(n)})"


def _query_cosine(label: str) -> str:
    norm = math.sqrt(sum(x * x for x in QUERY_5))
    return "CASE " + label + " " + " ".join(f"WHEN '{x}' THEN {q / norm!r}" for x, q in zip(LABELS, QUERY_5, strict=True)) + " END::DOUBLE"


NOW_31 = 31 * DAY
FACTS = f"""f AS (SELECT vec_id AS seq, 'label:' || label AS subject, label, embedding::DOUBLE[] AS v, vec_id * 3600.0 AS created_at FROM embeddings),
w AS (SELECT *, exp(-{LN2 / (30 * DAY)!r} * greatest({FACTS_NOW} - created_at, 0)) AS weight FROM f)"""
FACTS_RANKED = FACTS + """, q AS (SELECT v FROM f WHERE seq = 0),
ranked AS (SELECT subject, seq, greatest(list_cosine_similarity(w.v, q.v), 0) * weight AS score FROM w, q WHERE weight >= 0.05),
top AS (SELECT *, (row_number() OVER (PARTITION BY subject ORDER BY score DESC, seq))::INTEGER AS rank FROM ranked)"""
CONFUSION = "WITH t AS (SELECT n_chars::DOUBLE AS score, quality = 1 AS actual FROM documents JOIN labels USING (doc_id))"
RATIO = lambda a, b: f"CASE WHEN {b} = 0 THEN 1.0 ELSE {a} / ({b}) END"


def _metrics(source: str, keys: str = "") -> str:
    return f"""m0 AS ({source}), m1 AS (SELECT *, {RATIO('tp', '(tp + fp)')} AS precision, {RATIO('tp', '(tp + fn)')} AS recall FROM m0),
m AS (SELECT *, CASE WHEN precision + recall = 0 THEN 0.0 ELSE 2 * precision * recall / (precision + recall) END AS f1 FROM m1)"""


def _counts(flag: str, truth: str) -> str:
    return ", ".join(f"count(*) FILTER (WHERE {c}) AS {n}" for n, c in (("tp", f"({flag}) AND ({truth})"), ("fp", f"({flag}) AND NOT ({truth})"), ("fn", f"NOT ({flag}) AND ({truth})"), ("tn", f"NOT ({flag}) AND NOT ({truth})")))


_SWEEP = f"{CONFUSION}, g AS (SELECT unnest({THETAS}::DOUBLE[]) AS theta), " + _metrics(f"SELECT theta, {_counts('score >= theta', 'actual')} FROM t, g GROUP BY theta")
#: The same over UTF-8 bytes in hex, for texts that aren't ASCII.
_FNV_HEX = "list_reduce(list_transform(range(1, length({0}), 2), lambda i: ('0x' || {0}[i:i + 1])::BIGINT::UHUGEINT), lambda h, b: (xor(h, b) * 1099511628211::UHUGEINT) % 18446744073709551616::UHUGEINT, 14695981039346656037::UHUGEINT)"
_FNV = "list_reduce(list_transform(range(1, length({0}) + 1), lambda i: ord({0}[i])::UHUGEINT), lambda h, b: (xor(h, b) * 1099511628211::UHUGEINT) % 18446744073709551616::UHUGEINT, 14695981039346656037::UHUGEINT)"

ORACLES: dict[str, str] = {
    "top_living_labels": f"WITH {ALIVE} SELECT subject, label, count(*) AS n, round(sum(w), 6) AS weight FROM alive GROUP BY 1, 2 ORDER BY weight DESC, subject, label LIMIT 10",
    "halflife_lambda": f"""WITH {P0} SELECT DISTINCT label, round(lam0, 12) AS "lambda", round({LN2!r} / lam0, 6) AS halflife FROM p""",
    "decayed_weight": f"WITH {P0} SELECT seq, round(dt, 6) AS elapsed, round(w, 6) AS weight FROM p",
    "alive_at": f"WITH {ALIVE} SELECT subject, label, count(*) AS n, round(sum(w), 6) AS weight FROM alive GROUP BY 1, 2",
    "faded_at": f"WITH {P0} SELECT seq, subject, label FROM p WHERE tick <= {NOW} AND w < 0.05",
    "expiry_tick": f"WITH {P0} SELECT seq, CASE WHEN salience >= 0.05 THEN round(tick + ln(salience / 0.05) / lam0, 3) END AS expires_at FROM p",
    "reinforced_trace": f"""WITH {P0}, t AS (SELECT subject, label, count(*) - 1 AS touches, max(tick) AS last_touch, min_by(salience, seq) AS salience, any_value(lam0) AS l0 FROM p GROUP BY 1, 2),
x AS (SELECT *, {r_of('touches')} AS r, {lam_of('l0', 'touches')} AS lam FROM t)
SELECT subject, label, touches, round(r, 6) AS reinforcement, round(lam, 12) AS "lambda", round(salience * exp(-lam * greatest({30 * DAY} - last_touch, 0)) * (1 + r), 6) AS weight FROM x""",
    "vector_norms": f"SELECT vec_id, round({_NORM} * {_NORM}, 6) AS sq_norm, round({_NORM}, 6) AS norm FROM embeddings",
    "pairwise_cosine": """SELECT a.vec_id AS left_id, b.vec_id AS right_id, round(list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) + 0.0 AS dot, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) + 0.0 AS cosine
FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id < b.vec_id""",
    "centroid_by_label": "SELECT label, (pos - 1)::INTEGER AS pos, round(avg(embedding[pos]::DOUBLE), 6) + 0.0 AS value FROM embeddings, range(1, 65) t(pos) GROUP BY 1, 2",
    "unit_vectors": f"""WITH {P0}, v AS (SELECT seq, [{_UNIT}, k / 100.0]::DOUBLE[] AS v FROM p)
SELECT seq, (pos - 1)::INTEGER AS pos, round(v[pos] / sqrt(list_sum(list_transform(v, lambda x: x * x))), 6) + 0.0 AS value FROM v, range(1, 7) t(pos)""",
    "unit_distance": """WITH c AS (SELECT label, list(m ORDER BY pos) AS c FROM (SELECT label, pos, avg(embedding[pos]::DOUBLE) AS m FROM embeddings, range(1, 65) t(pos) GROUP BY 1, 2) GROUP BY 1)
SELECT vec_id, round(sqrt(2 - 2 * list_cosine_similarity(embedding::DOUBLE[], c)), 6) AS distance FROM embeddings JOIN c USING (label)""",
    "trait_text": f"WITH {P0} SELECT seq, label || ' ' || k AS representative, 'act ' || label || ' k ' || k AS embedded, label || ' n' || k AS replaced FROM p",
    "fact_predicate": f"WITH {P0}, x AS (SELECT *, {_query_cosine('label')} AS c FROM p WHERE tick <= {NOW}) SELECT seq FROM x WHERE (c > 0.25 AND NOT w < 0.3) OR dt <= 3600",
    "fade_where": f"WITH {P0} SELECT label, count(*) AS n FROM p WHERE tick <= {NOW} AND NOT (label = 'error' AND dt > 86400) GROUP BY 1",
    "point_lookup": f"WITH {P0} SELECT seq, label, k FROM p WHERE subject = 'user:1'",
    "distill_histogram": f"WITH {ALIVE} SELECT *, (row_number() OVER (PARTITION BY subject ORDER BY n DESC, label))::INTEGER AS rank FROM (SELECT subject, label, count(*) AS n FROM alive GROUP BY 1, 2)",
    "distill_core_label": f"WITH {ALIVE}, c AS (SELECT *, row_number() OVER (PARTITION BY subject ORDER BY n DESC, label) AS r FROM (SELECT subject, label, count(*) AS n FROM alive GROUP BY 1, 2)) SELECT subject, min_by(label, r) AS core_label, count(*) AS labels FROM c GROUP BY 1",
    "distill_split": f"WITH {SPLIT} SELECT seq, subject, round(cosine, 6) AS cosine, {FLAGS} FROM scored",
    "distill_intentions": f"""WITH {SPLIT}, x AS (SELECT *, {FLAGS} FROM scored), l AS (SELECT subject, label, row_number() OVER (PARTITION BY subject ORDER BY n DESC, label) AS r FROM c)
SELECT x.subject, count(*) AS absorbed, count(*) FILTER (WHERE redundant) AS redundant, count(*) FILTER (WHERE anomaly) AS anomalies,
       coalesce(string_agg(x.label, ',' ORDER BY seq) FILTER (WHERE anomaly), '') AS anomaly_labels, any_value(l.label) AS core_label
FROM x JOIN l ON l.subject = x.subject AND r = 1 GROUP BY 1""",
    "distill_cycles": f"WITH {CYCLES} SELECT subject, cycle, count(*) AS absorbed, count(DISTINCT label) AS labels, sum(k)::BIGINT AS k_sum FROM live GROUP BY 1, 2",
    "modes_onehot": f"WITH {ALIVE}, m AS (SELECT subject, label, min(seq) AS s, count(*) AS absorbed FROM alive GROUP BY 1, 2) SELECT subject, (row_number() OVER (PARTITION BY subject ORDER BY s) - 1)::INTEGER AS mode, label, absorbed FROM m",
    "histogram_merge": f"WITH {CYCLES}, m AS (SELECT subject, label, count(*) AS n FROM live GROUP BY 1, 2) SELECT *, (row_number() OVER (PARTITION BY subject ORDER BY n DESC, label))::INTEGER AS rank FROM m",
    "archetype_core": f"""WITH {COUNTS}, l AS (SELECT label, (row_number() OVER (ORDER BY label) - 1)::INTEGER AS pos FROM (SELECT unnest({list(LABELS)}) AS label)),
g AS (SELECT a.subject, a.cycle, a.absorbed, l.pos, coalesce(c.n, 0) AS n FROM arc a CROSS JOIN l LEFT JOIN counts c ON c.subject = a.subject AND c.cycle = a.cycle AND c.label = l.label)
SELECT subject, cycle, pos, round(sum(n) OVER w / sum(absorbed) OVER w, 6) AS core, (sum(absorbed) OVER w)::BIGINT AS represented FROM g WINDOW w AS (PARTITION BY subject, pos ORDER BY cycle)""",
    "archetype_trace": f"""WITH {COUNTS}, t AS (SELECT subject, cycle, row_number() OVER (PARTITION BY subject ORDER BY cycle) - 1 AS n FROM arc)
SELECT subject, cycle, round({r_of('n')}, 6) AS reinforcement, round(({lam_of(repr(ARCH_LAMBDA), 'n')}) * 1e6, 9) AS lambda_e6 FROM t""",
    "archetype_modes": f"WITH {MODES} SELECT subject, mode, label, absorbed, round({r_of('merges')}, 6) AS reinforcement, round(({lam_of('l0', 'merges')}) * 1e6, 9) AS lambda_e6, 0.0::DOUBLE AS drift FROM modes",
    "mode_drift": f"""WITH {CYCLES}, g AS (SELECT subject, label, cycle, count(*) AS n, sum(k) / 100.0 AS s FROM live GROUP BY 1, 2, 3),
m AS (SELECT subject, label, sum(n)::BIGINT AS absorbed, sum(s)::DOUBLE / sum(n) AS c, (min_by(s, cycle) / min_by(n, cycle))::DOUBLE AS o FROM g GROUP BY 1, 2)
SELECT subject, label, absorbed, round(greatest(1 - (1 + c * o) / (sqrt(1 + c * c) * sqrt(1 + o * o)), 0), 5) AS drift FROM m""",
    "archetype_summary": f"""WITH {SUMMARY} SELECT arch.subject, represented, milestones, m.n AS modes, coalesce(anomalies, 0)::BIGINT AS anomalies, core_label, round({r_of('milestones - 1')}, 6) AS reinforcement, last_touch
FROM arch JOIN (SELECT subject, count(*) AS n FROM modes GROUP BY 1) m USING (subject) LEFT JOIN odd USING (subject)""",
    "archetype_consolidated": f"""WITH {SUMMARY}, x AS (SELECT subject, milestones - 1 AS n, last_touch, subject = 'user:1' AS mine FROM arch), y AS (SELECT *, {r_of('n')} AS r, {lam_of(repr(ARCH_LAMBDA), 'n')} AS lam FROM x)
SELECT subject, round(CASE WHEN mine THEN r + 1 / (1 + r) ELSE r END, 6) AS reinforcement, round(CASE WHEN mine THEN greatest(lam * 0.8, {FLOOR!r}) ELSE lam END * 1e6, 9) AS lambda_e6, CASE WHEN mine THEN {NOW_31}::DOUBLE ELSE last_touch END AS last_touch FROM y""",
    "breath_report": f"""WITH {CYCLES}, a AS (SELECT cycle, count(DISTINCT subject) AS d, count(*) AS n FROM live GROUP BY 1),
gone AS (SELECT seq, min(cycle) AS cycle FROM p, cyc WHERE tick <= ct AND salience * exp(-lam0 * (ct - tick)) < 0.05 GROUP BY 1), f AS (SELECT cycle, count(*) AS n FROM gone GROUP BY 1)
SELECT cyc.cycle, coalesce(d, 0) AS distilled_subjects, coalesce(a.n, 0) AS perceptions_absorbed, coalesce(f.n, 0) AS faded FROM cyc LEFT JOIN a USING (cycle) LEFT JOIN f USING (cycle)""",
    "lazy_breaths": f"""WITH {P0}, five AS (SELECT i AS cycle, (i * 5 * {DAY})::DOUBLE AS ct FROM range(1, 7) t(i)),
live AS (SELECT p.*, cycle, ct FROM p, five WHERE tick <= ct AND salience * exp(-lam0 * (ct - tick)) >= 0.05),
c AS (SELECT subject, cycle, ct, label, count(*) AS n FROM live GROUP BY ALL), ranked AS (SELECT *, row_number() OVER (PARTITION BY subject, cycle ORDER BY n DESC, label) AS r FROM c),
arc AS (SELECT subject, cycle, any_value(ct) AS ct, sum(n)::BIGINT AS absorbed, min_by(label, r) AS label FROM ranked GROUP BY 1, 2),
s AS (SELECT subject, sum(absorbed)::BIGINT AS represented, count(*) AS milestones, max_by(label, cycle) AS core_label, max(ct) AS last_touch FROM arc GROUP BY 1)
SELECT s.subject, represented, milestones, m.n AS modes, core_label, round({r_of('milestones - 1')}, 6) AS reinforcement, last_touch FROM s JOIN (SELECT subject, count(DISTINCT label) AS n FROM c GROUP BY 1) m USING (subject)""",
    "breathe_once": f"""WITH {ALIVE}, c AS (SELECT *, row_number() OVER (PARTITION BY subject ORDER BY n DESC, label) AS r FROM (SELECT subject, label, count(*) AS n FROM alive WHERE label <> 'view' GROUP BY 1, 2))
SELECT subject, sum(n)::BIGINT AS represented, min_by(label, r) AS core_label, count(*) AS modes FROM c GROUP BY 1""",
    "breathe_twice": f"""WITH {P0}, t AS (SELECT unnest([{EARLIER}, {NOW}])::DOUBLE AS moment), a AS (SELECT subject, label, moment FROM p, t WHERE tick <= moment AND salience * exp(-lam0 * (moment - tick)) >= 0.05),
c AS (SELECT *, row_number() OVER (PARTITION BY subject, moment ORDER BY n DESC, label) AS r FROM (SELECT subject, moment, label, count(*) AS n FROM a GROUP BY 1, 2, 3))
SELECT subject, sum(n)::BIGINT AS represented, max_by(label, moment) FILTER (WHERE r = 1) AS core_label, count(DISTINCT label) AS modes, count(DISTINCT moment) AS milestones, (count(DISTINCT moment) - 1)::DOUBLE AS reinforcement, max(moment) AS last_touch FROM c GROUP BY 1""",
    "basal_breaths": f"WITH {P0} SELECT greatest(1, ceil(tick / {DAY}))::INTEGER AS breath, count(*) AS arrived, count(DISTINCT subject) AS subjects FROM p GROUP BY 1",
    "pressure_breaths": f"WITH {P0} SELECT seq // 256 AS breath, count(*) AS arrived, count(DISTINCT subject) AS subjects, round(max(tick), 3) AS tick FROM p GROUP BY 1",
    "predictive_compression": f"""WITH {P0}, o AS (SELECT subject, label, row_number() OVER (PARTITION BY subject ORDER BY seq) AS i, count(*) OVER (PARTITION BY subject) AS n FROM p),
s AS (SELECT *, i <= greatest(1, least(floor(n * 0.7::DOUBLE + 0.5)::BIGINT, n - 1)) AS train FROM o WHERE n > 1),
c AS (SELECT subject, label, count(*) AS k FROM s WHERE train GROUP BY 1, 2), z AS (SELECT subject, sqrt(sum(k * k)) AS norm FROM c GROUP BY 1)
SELECT s.subject, round(avg(CASE WHEN c.k IS NULL THEN 0.0 ELSE 1.0 END), 6) AS modal, round(avg(coalesce(c.k, 0) / norm), 6) AS centroid, count(*) AS held_out
FROM s JOIN z ON z.subject = s.subject LEFT JOIN c ON c.subject = s.subject AND c.label = s.label WHERE NOT train GROUP BY 1""",
    "arc_drift": f"WITH {COUNTS} SELECT subject, cycle, round(drift, 6) + 0.0 AS drift, label FROM drift WHERE tick >= {SINCE}",
    "arc_thinned": f"""WITH {COUNTS}, o AS (SELECT *, row_number() OVER (PARTITION BY subject ORDER BY cycle) - 1 AS i, count(*) OVER (PARTITION BY subject) AS n FROM drift),
k AS (SELECT DISTINCT subject, j * (n - 1) // 6 AS i FROM o, range(0, 7) t(j) WHERE n > 7)
SELECT o.subject, cycle, round(drift, 6) + 0.0 AS drift FROM o LEFT JOIN k ON k.subject = o.subject AND k.i = o.i WHERE n <= 7 OR k.i IS NOT NULL""",
    "domain_trajectories": f"""WITH {COUNTS}, s AS (SELECT subject, label, max(share) * (1 + var_pop(share)) AS score FROM shares GROUP BY 1, 2),
r AS (SELECT *, (row_number() OVER (PARTITION BY subject ORDER BY round(score, 12) DESC, label))::INTEGER AS rank FROM s)
SELECT r.subject, r.label, rank, round(score, 6) AS score, (row_number() OVER (PARTITION BY r.subject, r.label ORDER BY cycle) - 1)::INTEGER AS pos, round(share, 6) AS share
FROM r JOIN shares x ON x.subject = r.subject AND x.label = r.label WHERE rank <= 3""",
    "dominant_transition": f"WITH {STEPS} SELECT * FROM moved",
    "predict_next": f"WITH {STEPS} SELECT subject, a AS current, b AS predicted FROM (SELECT *, row_number() OVER (PARTITION BY subject, a ORDER BY n DESC, b) AS r FROM (SELECT subject, a, b, count(*) AS n FROM steps GROUP BY 1, 2, 3)) WHERE r = 1",
    "revivals": f"WITH {STEPS} SELECT * FROM back",
    "reflect_insights": f"WITH {STEPS} SELECT subject, 'transition' AS kind, from_label, to_label, support, NULL AS domain FROM moved UNION ALL SELECT subject, 'revival', NULL, NULL, NULL, domain FROM back",
    "dream_facts": f"""WITH {STEPS}, i AS (SELECT subject, 'transition' AS kind, to_label AS label, 'moves most often from ' || from_label || ' to ' || to_label AS text FROM moved UNION ALL SELECT subject, 'revival', domain, 'came back after it had faded: ' || domain FROM back)
SELECT subject, kind, text, list_position({list(LABELS)}, label)::BIGINT AS place FROM i""",
    "arc_reading": f"""WITH {COUNTS}, d AS (SELECT subject, cycle, tick, round(drift, 9) AS drift FROM drift), e AS (SELECT *, drift - lag(drift) OVER (PARTITION BY subject ORDER BY cycle) AS x FROM d),
g AS (SELECT *, x * lag(x) OVER (PARTITION BY subject ORDER BY cycle) < 0 AS turn FROM e),
s AS (SELECT subject, max_by(drift, cycle) - min_by(drift, cycle) AS total, max(abs(drift)) AS peak, max(tick) - min(tick) AS span, count(*) FILTER (WHERE turn) AS inflexions FROM g GROUP BY 1)
SELECT subject, round(total, 6) + 0.0 AS drift_total, round(peak, 6) + 0.0 AS drift_peak, span, inflexions,
       CASE WHEN peak < 0.015 THEN 'stable' WHEN inflexions >= 2 THEN 'volatile' WHEN inflexions = 1 AND peak >= 2 * abs(total) THEN 'returned' WHEN total > 0.05 THEN 'rising' WHEN total < -0.05 THEN 'falling' ELSE 'stable' END AS direction FROM s""",
    "domain_trend": f"""WITH {COUNTS}, s AS (SELECT subject, label, list(share ORDER BY cycle) AS s, max(share) AS peak, count(*) AS n FROM shares GROUP BY 1, 2),
t AS (SELECT *, s[1] / peak AS a, s[-1] / peak AS z, CASE WHEN n > 2 THEN list_min(s[2:-2]) / peak ELSE least(s[1], s[-1]) / peak END AS low FROM s)
SELECT subject, label, CASE WHEN n < 2 OR peak < 0.07 THEN NULL WHEN a >= 0.6 AND low <= 0.45 AND z >= 0.6 THEN 'returned' WHEN z < 0.25 AND a = 1 THEN 'decayed' WHEN z < 0.25 THEN 'faded_peak' WHEN z >= 0.85 AND a <= 0.55 THEN 'growing' ELSE 'present' END AS trend,
       n >= 2 AND peak >= 0.07 AND z < 0.25 AS faded_peak FROM t""",
    "label_islands": f"WITH {COUNTS} SELECT subject, cycle, label FROM (SELECT *, lag(label) OVER (PARTITION BY subject ORDER BY cycle) AS b FROM arc) WHERE label IS DISTINCT FROM b",
    "facts_dedup": f"""WITH {P0}, g AS (SELECT subject, label, min(seq) AS seq, min(tick) AS created_at, max(tick) AS last_touch, count(*) - 1 AS n FROM p GROUP BY 1, 2)
SELECT seq, subject, label || ' ' || seq AS text, round(created_at, 6) AS created_at, round({r_of('n')}, 6) AS reinforcement, round(({lam_of(repr(LN2 / (30 * DAY)), 'n')}) * 1e6, 9) AS lambda_e6, round(last_touch, 6) AS last_touch FROM g""",
    "facts_dedup_graded": GRADED.format(subject="subject"),
    "facts_dedup_hot": GRADED.format(subject="CASE WHEN seq % 2 = 0 THEN 'hot' ELSE subject END"),
    "facts_search": f"WITH {FACTS_RANKED} SELECT subject, rank, seq, round(score, 6) AS score FROM top WHERE rank <= 3",
    "facts_recall_topk": f"""WITH {FACTS}, s AS (SELECT q.seq AS query, w.seq, greatest(list_cosine_similarity(w.v, q.v), 0) * weight AS score FROM w, f q WHERE q.seq % 20 = 0 AND weight >= 0.05),
t AS (SELECT *, (row_number() OVER (PARTITION BY query ORDER BY score DESC, seq))::INTEGER AS rank FROM s) SELECT query, rank, seq, round(score, 6) AS score FROM t WHERE rank <= 10""",
    "facts_reinforced": f"""WITH {FACTS_RANKED}, h AS (SELECT f.seq, created_at, t.seq IS NOT NULL AS hit FROM f LEFT JOIN (SELECT seq FROM top WHERE rank <= 3) t ON t.seq = f.seq)
SELECT seq, (CASE WHEN hit THEN 1.0 ELSE 0.0 END)::DOUBLE AS reinforcement, round({LN2 / (30 * DAY)!r} * CASE WHEN hit THEN 0.9 ELSE 1 END * 1e6, 9) AS lambda_e6, CASE WHEN hit THEN {FACTS_NOW} ELSE created_at END::DOUBLE AS last_touch FROM h""",
    "facts_faded": f"WITH {FACTS} SELECT seq, subject FROM f WHERE exp(-{LN2 / (30 * DAY)!r} * greatest({FACTS_FADE_NOW} - created_at, 0)) >= 0.05",
    "knapsack": f"""WITH RECURSIVE f AS (
  SELECT 'conv:' || conv_id AS subject, conv_id * 1000 + turn AS seq, len(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '')) AS cost, round(exp(-{LN2 / (30 * DAY)!r} * greatest({TEXT_NOW} - turn * 3600.0, 0)), 9) AS score FROM conversations
), o AS (SELECT *, row_number() OVER (PARTITION BY subject ORDER BY score DESC, seq) AS i FROM f),
k AS (
  SELECT subject, i, seq, cost, cost <= {FACT_BUDGET} AS took, {FACT_BUDGET} - CASE WHEN cost <= {FACT_BUDGET} THEN cost ELSE 0 END AS rest FROM o WHERE i = 1
  UNION ALL SELECT o.subject, o.i, o.seq, o.cost, o.cost <= k.rest, k.rest - CASE WHEN o.cost <= k.rest THEN o.cost ELSE 0 END FROM k JOIN o ON o.subject = k.subject AND o.i = k.i + 1
) SELECT subject, seq, cost::BIGINT AS cost, rest::BIGINT AS "left" FROM k WHERE took""",
    "resonate_flat": f"""WITH {SUMMARY}, b AS (SELECT subject, max({_query_cosine('label')}) AS c FROM modes GROUP BY 1), x AS (SELECT arch.subject, c * {_life(NOW_31)} AS score, {_life(NOW_31)} AS life FROM arch JOIN b USING (subject))
SELECT subject, round(score, 6) AS score FROM x WHERE life >= 0.05 ORDER BY x.score DESC, subject LIMIT 10""",
    "resonate_modes": f"WITH {MODES}, x AS (SELECT subject, label, {_query_cosine('label')} AS c FROM modes) SELECT subject, round(max(c), 6) AS resonance, max_by(label, c) AS label FROM x GROUP BY 1",
    "evoke_budget": f"""WITH {SUMMARY}, x AS (SELECT arch.subject, least(milestones, 21) AS arc_count, coalesce(anomalies, 0) AS a, represented FROM arch LEFT JOIN odd USING (subject) WHERE {_life(NOW_31)} >= 0.05),
y AS (SELECT *, least(a, greatest(32 - arc_count, 0)) AS odd_count FROM x)
SELECT subject, arc_count::BIGINT AS arc_count, odd_count::BIGINT AS anomalies_included, (1 + arc_count + odd_count)::BIGINT AS vectors_returned, represented, (24 * (1 + arc_count + odd_count))::BIGINT AS token_estimate, round(represented / (1 + arc_count + odd_count), 6) AS compression_ratio FROM y""",
    "evoke_contexts": f"""WITH {SUMMARY}, b AS (SELECT subject, max_by(label, {_query_cosine('label')}) AS resonating_mode, count(*) AS domains FROM modes GROUP BY 1),
x AS (SELECT arch.subject, core_label, least(milestones, 4) AS points, domains, least(coalesce(anomalies, 0), 32 - least(milestones, 4)) AS o, resonating_mode FROM arch JOIN b USING (subject) LEFT JOIN odd USING (subject) WHERE {_life(NOW_31)} >= 0.05)
SELECT subject, core_label, points::BIGINT AS points, domains, (1 + points + o)::BIGINT AS vectors_returned, (24 * (1 + points + o))::BIGINT AS token_estimate, resonating_mode FROM x""",
    "evoke_unified": f"""WITH {SUMMARY}, e AS (SELECT subject, least(count(*), 10) AS facts FROM p WHERE tick <= {NOW} GROUP BY 1),
x AS (SELECT coalesce(arch.subject, e.subject) AS subject, coalesce(facts, 0) AS facts, 2 * coalesce(facts, 0) AS spent, arch.subject IS NOT NULL AND {_life(NOW_31)} >= 0.05 AS has, milestones, coalesce(anomalies, 0) AS a FROM arch FULL JOIN e ON e.subject = arch.subject LEFT JOIN odd ON odd.subject = arch.subject),
y AS (SELECT *, (100 - spent) // 24 AS b FROM x), z AS (SELECT *, least(milestones, greatest(b - 1, 0) * 2 // 3) AS pts FROM y),
u AS (SELECT *, CASE WHEN has AND b >= 1 THEN 1 + pts + least(a, greatest(b - 1 - pts, 0)) END AS v FROM z)
SELECT subject, facts::BIGINT AS facts, spent::BIGINT AS fact_tokens, (spent + coalesce(24 * v, 0))::BIGINT AS total_tokens, v::BIGINT AS gist_vectors FROM u""",
    "confusion_metrics": f"{CONFUSION}, " + _metrics(f"SELECT {_counts('score >= 1000', 'actual')} FROM t") + " SELECT tp, fp, fn, tn, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1 FROM m",
    "threshold_sweep": _SWEEP + " SELECT theta, tp, fp, fn, tn, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1 FROM m",
    "pareto_front": _SWEEP + """, r AS (SELECT theta, round(precision, 6) AS precision, round(recall, 6) AS recall FROM m)
SELECT * FROM r WHERE NOT EXISTS (SELECT 1 FROM r o WHERE o.precision >= r.precision AND o.recall >= r.recall AND (o.precision > r.precision OR o.recall > r.recall))""",
    "fade_sweep": f"WITH {P0}, g AS (SELECT unnest([0.01, 0.02, 0.05, 0.10, 0.15, 0.20, 0.30]::DOUBLE[]) AS theta), " + _metrics(f"SELECT theta, {_counts('w < theta', 'label IN (' + chr(39) + 'error' + chr(39) + ', ' + chr(39) + 'click' + chr(39) + ')')} FROM p, g GROUP BY theta")
    + """, l AS (SELECT *, CASE WHEN fp + tn = 0 THEN 0.0 ELSE fp / (fp + tn) END AS loss FROM m) SELECT theta, tp, fp, fn, tn, round(f1, 6) AS f1, round(loss, 6) AS memory_loss, round(f1 * (1 - loss), 6) AS objective FROM l""",
    "semantic_sweep": f"""WITH {SPLIT}, x AS (SELECT round(cosine, 9) AS cosine, label FROM scored), ga AS (SELECT unnest([0.80, 0.84, 0.88, 0.90, 0.92, 0.94, 0.96]::DOUBLE[]) AS tr), gb AS (SELECT unnest([0.1, 0.2, 0.3, 0.4, 0.5, 0.6]::DOUBLE[]) AS ta),
g AS (SELECT tr, ta, cosine >= tr AS red, cosine < tr AND cosine <= ta AS odd, label FROM x, ga, gb),
cnt AS (SELECT tr, ta, count(*) FILTER (WHERE red AND label = 'purchase') AS rt, count(*) FILTER (WHERE red) AS rp, count(*) FILTER (WHERE label = 'purchase') AS ra,
             count(*) FILTER (WHERE odd AND label = 'error') AS ot, count(*) FILTER (WHERE odd) AS op, count(*) FILTER (WHERE label = 'error') AS oa,
             count(*) FILTER (WHERE red AND label NOT IN ('purchase', 'error')) AS sl, count(*) FILTER (WHERE label NOT IN ('purchase', 'error')) AS sa FROM g GROUP BY 1, 2),
d AS (SELECT *, {RATIO('rt', 'rp')} AS p1, {RATIO('rt', 'ra')} AS r1, {RATIO('ot', 'op')} AS p2, {RATIO('ot', 'oa')} AS r2, CASE WHEN sa = 0 THEN 0.0 ELSE sl / sa END AS sf FROM cnt),
e AS (SELECT *, CASE WHEN p1 + r1 = 0 THEN 0.0 ELSE 2 * p1 * r1 / (p1 + r1) END AS f1, CASE WHEN p2 + r2 = 0 THEN 0.0 ELSE 2 * p2 * r2 / (p2 + r2) END AS f2 FROM d)
SELECT tr AS theta_redundancy, ta AS theta_anomaly, round(f1, 6) AS f1_redundancy, round(f2, 6) AS f1_anomaly, round(sf, 6) AS signal_faded, round(least(f1, f2) * (1 - sf), 6) AS objective FROM e""",
    "token_counts": """WITH t AS (SELECT conv_id, turn, text, len(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> ''))::BIGINT AS words FROM conversations)
SELECT conv_id, turn, words, CASE WHEN text = '' THEN 0 ELSE greatest(1, round_even(greatest(words * 1.333::DOUBLE, length(text) / 4.0::DOUBLE), 0)::BIGINT) END AS tokens FROM t""",
    "fnv1a_tokens": f"WITH {P0}, t AS (SELECT DISTINCT label || '-' || k AS token FROM p) SELECT token, ({_FNV.format('token')})::VARCHAR AS hash FROM t",
    "hashed_embeddings": f"""WITH w AS (SELECT conv_id, turn, hex(encode(unnest(regexp_extract_all(lower(text), '[^\\s]+')))) AS token FROM conversations WHERE text IS NOT NULL),
h AS (SELECT conv_id, turn, ({_FNV_HEX.format('token')})::UBIGINT AS h FROM w),
v AS (SELECT conv_id, turn, (h % 64)::INTEGER AS place, sum(CASE WHEN h >= 9223372036854775808 THEN -1.0 ELSE 1.0 END)::DOUBLE AS x FROM h GROUP BY 1, 2, 3),
n AS (SELECT conv_id, turn, sqrt(sum(x * x)) AS size, sum((place + 1) * x) AS d FROM v GROUP BY 1, 2)
SELECT c.conv_id, c.turn, CASE WHEN text IS NULL THEN NULL WHEN coalesce(size, 0) = 0 THEN 0.0 ELSE 1.0 END::DOUBLE AS norm, CASE WHEN text IS NULL THEN NULL WHEN coalesce(size, 0) = 0 THEN 0.0 ELSE round(d / size, 6) END::DOUBLE + 0.0 AS digest
FROM conversations c LEFT JOIN n ON n.conv_id = c.conv_id AND n.turn = c.turn""",
    "snapshot_names": f"WITH {P0}, t AS (SELECT DISTINCT subject FROM p) SELECT subject, regexp_replace(subject, '[^0-9A-Za-z]', '_', 'g')[1:48] || '-' || lpad(lower(to_hex(({_FNV.format('subject')})::UBIGINT)), 16, '0') || '.json' AS name FROM t",
    "clean_labels": f"WITH {P0} SELECT DISTINCT 'act ' || label || '_x ' AS raw, label || ' x' AS label FROM p",
    "calibration_report": """SELECT 'semantic' AS what, max(objective) AS best_objective, max(objective) FILTER (WHERE abs(theta_redundancy - 0.92) < 1e-9 AND abs(theta_anomaly - 0.30) < 1e-9) AS default_objective FROM ({semantic})
UNION ALL SELECT 'fade', max(objective), max(objective) FILTER (WHERE abs(theta - 0.05) < 1e-9) FROM ({fade})""",
    "mql_program": f"""WITH {P0}, t AS (SELECT max(tick) AS now FROM p), x AS (SELECT p.*, now, salience * exp(-lam0 * (now - tick)) AS wn FROM p, t),
first AS (SELECT *, label = 'error' AND wn < 0.5 AS gone FROM x), left_ AS (SELECT * FROM first WHERE NOT gone), a AS (SELECT * FROM left_ WHERE wn >= 0.05),
one AS (SELECT count(*) AS n FROM a WHERE subject = 'user:1' AND (label = 'click' OR k >= 50)), two AS (SELECT count(*) AS n FROM a WHERE subject = 'user:2'),
faded AS (SELECT count(*) FILTER (WHERE wn < 0.05) AS n FROM left_), g AS (SELECT count(*) AS n FROM first WHERE gone)
SELECT 0 AS statement, 'faded' AS kind, 'forgot perceptions: ' || n AS result FROM g
UNION ALL SELECT 1, 'dreamed', 'breath: distilled_subjects=' || (one.n > 0)::INTEGER || ', perceptions_absorbed=' || one.n || ', faded=' || faded.n FROM one, faded
UNION ALL SELECT 2, 'dreamed', 'breath: distilled_subjects=' || (n > 0)::INTEGER || ', perceptions_absorbed=' || n || ', faded=0' FROM two
UNION ALL SELECT 3, CASE WHEN n > 0 THEN 'imprinted' ELSE 'error' END, CASE WHEN n > 0 THEN 'strengthened: user:1' ELSE 'failed: nothing alive is known of user:1' END FROM one
UNION ALL VALUES (4, 'error', 'failed: nothing alive is known of user:3'), (5, 'perceived', 'heard: user:x'), (6, 'faded', 'forgot perceptions: 1'), (7, 'recalled', 'facts: none'), (8, 'reinforced', 'strengthened facts: 0'), (9, 'error', 'failed: nothing alive is known of user:3')""",
    "stream_breaths": f"WITH {P0} SELECT greatest(1, ceil(tick / {DAY}))::INTEGER AS breath, count(*) AS arrived FROM p GROUP BY 1",
    "stream_pressure": f"WITH {P0} SELECT seq // 256 AS breath, count(*) AS arrived, round(max(tick), 3) AS tick FROM p GROUP BY 1",
    "stream_expiry": f"WITH {P0}, t AS (SELECT floor(max(tick) * 1000) / 1000 - {10 * DAY} AS moment FROM p) SELECT subject, count(*) AS living FROM p, t WHERE salience * exp(-lam0 * greatest(moment - tick, 0)) >= 0.05 GROUP BY 1",
    "stream_breathing": f"""WITH {P0}, turned AS (SELECT *, least(greatest(floor(tick / {5 * DAY}), 0), 5)::INTEGER + (seq % 97 = 0)::INTEGER AS turn FROM p),
ticks AS (SELECT turn AS cycle, max(max(tick)) OVER (ORDER BY turn) AS ct FROM turned GROUP BY turn),
c AS (SELECT subject, cycle, ct, label, count(*) AS n FROM turned, ticks WHERE turn <= cycle AND tick <= ct AND salience * exp(-lam0 * (ct - tick)) >= 0.05 GROUP BY ALL),
arc AS (SELECT subject, cycle, any_value(ct) AS ct, sum(n)::BIGINT AS absorbed, min_by(label, r) AS label FROM (SELECT *, row_number() OVER (PARTITION BY subject, cycle ORDER BY n DESC, label) AS r FROM c) GROUP BY 1, 2)
SELECT subject, sum(absorbed)::BIGINT AS represented, count(*) AS milestones, max_by(label, cycle) AS core_label, round(max(ct), 6) AS last_touch FROM arc GROUP BY 1""",
    "stream_living": f"WITH {ALIVE} SELECT subject, count(*) AS living, round(sum(w), 6) AS weight FROM alive GROUP BY 1",
}
ORACLES["predicate_pruned"] = f"WITH {P0} SELECT seq FROM p WHERE {PREDICATES['predicate_trait_numeric'][1]}"
for _name, (_, _sql) in PREDICATES.items():
    ORACLES[_name] = f"WITH {P0} SELECT seq, subject FROM p WHERE tick <= {NOW} AND ({_sql})"
_STOP = "this that with from have your just they them their what when which would could about there here into than then some more most very really much many like good great best well also even still movie movies film films review reviewed stars star watch watched story dont didnt isnt thing things make made show shows text phrase"
ORACLES["common_terms"] = f"""WITH w AS (SELECT lang, unnest(regexp_extract_all(lower(text), '[a-zA-Záéíóúñ]+')) AS term FROM documents),
c AS (SELECT lang, term, count(*) AS n FROM w WHERE length(term) >= 4 AND NOT list_contains(string_split('{_STOP}', ' '), term) GROUP BY 1, 2),
r AS (SELECT *, (row_number() OVER (PARTITION BY lang ORDER BY n DESC, term))::INTEGER AS rank FROM c) SELECT lang, term, n, rank FROM r WHERE rank <= 10"""

_VERDICT = ORACLES["calibration_report"].format(semantic=ORACLES["semantic_sweep"], fade=ORACLES["fade_sweep"])
ORACLES["calibration_report"] = f"SELECT *, best_objective - default_objective < 0.01 AS keep_default FROM ({_VERDICT})"
