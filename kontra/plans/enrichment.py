"""Queries on ontology enrichment."""

from __future__ import annotations

from pyspark.sql import functions as F

from kontra.operators import detect, enrich, matrix
from kontra.plans.detection import HITS_SQL, LABELS_SQL, bh_sql, cells, cells_sql, fisher_sql, labels, rounded
from kontra.sources import ontology
from kontra.sources.tables import CONTRAST_SQL, contrasts, kept


def closed(s, d):
    return kept(s, d, "closure", lambda: enrich.closure(ontology.parents(s, d)))


def full(s, d):
    return kept(s, d, "propagated", lambda: enrich.propagated(ontology.associations(s, d), closed(s, d)))


def modules(s, d):
    """Studies: the modules of detected entities."""
    return labels(contrasts(s, d)).select(F.concat(F.lit("M"), F.col("module").cast("string")).alias("study"), "entity")


def by_condition(s, d):
    """Studies: condition and module, condition's exclusive and shared detections."""
    c = contrasts(s, d)
    hits = detect.detected(c).select("entity", "condition")
    lab = labels(c)
    return hits.join(lab, "entity").select(F.concat_ws("|", "condition", F.concat(F.lit("M"), F.col("module").cast("string"))).alias("study"), "entity")


def tested(s, d):
    return kept(s, d, "tested", lambda: enrich.family(modules(s, d), contrasts(s, d), full(s, d)))


def within(s, d):
    """Family of condition x module studies against the detected entities only."""
    c = contrasts(s, d)
    return enrich.family(by_condition(s, d), detect.detected(c), full(s, d))


def flow(s, d):
    best = enrich.best_specific(tested(s, d), 400).where("study_count is not null").select(F.substring("study", 2, 9).cast("int").alias("module"), "term", "study_count")
    return matrix.flows(cells(s, d), best)


_MODULES = "stu AS (SELECT 'M' || module AS study, entity FROM labels)"
_COND = "stu AS (SELECT DISTINCT condition || '|M' || module AS study, entity FROM hits JOIN labels USING (entity))"
_FULL = ontology.ONTOLOGY_SQL + ", full_t AS (SELECT namespace, entity, term FROM assoc UNION SELECT namespace, entity, ancestor FROM assoc JOIN clo ON clo.child = term)"


def family_sql(studies: str, population: str, prefix: str | None = None) -> str:
    return f"""{prefix or f'WITH {CONTRAST_SQL}, {HITS_SQL}, {LABELS_SQL}'}, {_FULL}, {studies}, pp AS (SELECT DISTINCT entity FROM {population}), back AS (SELECT DISTINCT namespace, entity FROM full_t SEMI JOIN pp USING (entity)),
tt AS (SELECT f.* FROM full_t f SEMI JOIN back USING (namespace, entity)), pop AS (SELECT namespace, term, count(*) AS pop_count FROM tt GROUP BY ALL), pn AS (SELECT namespace, count(*) AS pop_n FROM back GROUP BY ALL),
el AS (SELECT i.study, i.namespace, input_entities, coalesce(mapped, 0) AS mapped FROM (SELECT study, namespace, count(DISTINCT entity) AS input_entities FROM stu CROSS JOIN (SELECT DISTINCT namespace FROM back) GROUP BY ALL) i LEFT JOIN (SELECT study, namespace, count(*) AS mapped FROM stu JOIN back USING (entity) GROUP BY ALL) m ON m.study = i.study AND m.namespace = i.namespace),
hh AS (SELECT study, namespace, term, count(*) AS study_count FROM stu JOIN tt USING (entity) GROUP BY ALL),
f0 AS (SELECT b.study, b.namespace, pop.term, coalesce(study_count, 0) AS study_count, mapped AS study_n, pop_count, pop_n FROM el b JOIN pop USING (namespace) JOIN pn USING (namespace) LEFT JOIN hh ON hh.study = b.study AND hh.namespace = b.namespace AND hh.term = pop.term WHERE mapped >= 10),
f1 AS (SELECT *, {fisher_sql('study_count', 'study_n', 'pop_count', 'pop_n')} AS p_raw, CASE WHEN study_count * pop_n > pop_count * study_n THEN 'e' ELSE 'p' END AS enrichment FROM f0),
fam AS (SELECT * FROM {bh_sql('f1', 'p_raw', 'study, namespace, term')})"""


_FAM_COLS = "study, namespace, term, study_count, study_n, pop_count, pop_n, round(p_raw, 6) AS p_raw, enrichment, round(q, 6) AS q"
_DEPTHS = "dp AS (SELECT t.term, coalesce(max(depth), 0) AS depth FROM (SELECT child AS term FROM edges UNION SELECT parent FROM edges) t LEFT JOIN clo ON clo.child = t.term GROUP BY t.term)"

QUERIES = {
    "ontology_closure": (lambda s, d: closed(s, d), f"WITH {ontology.ONTOLOGY_SQL} SELECT child, ancestor, max(depth)::INTEGER AS depth FROM clo GROUP BY ALL"),
    "count_propagation": (lambda s, d: full(s, d).groupBy("namespace", "term").agg(F.count(F.lit(1)).alias("entities")), f"WITH {_FULL} SELECT namespace, term, count(*) AS entities FROM full_t GROUP BY ALL"),
    "namespace_background": (
        lambda s, d: enrich.background(contrasts(s, d), ontology.associations(s, d)).groupBy("namespace").agg(F.count(F.lit(1)).alias("entities")),
        f"WITH {CONTRAST_SQL}, {ontology.ONTOLOGY_SQL} SELECT namespace, count(DISTINCT entity) AS entities FROM assoc SEMI JOIN contrast USING (entity) GROUP BY namespace",
    ),
    "enrichment_family": (lambda s, d: rounded(tested(s, d)).select("study", "namespace", "term", "study_count", "study_n", "pop_count", "pop_n", "p_raw", "enrichment", "q"), f"{family_sql(_MODULES, 'contrast')} SELECT {_FAM_COLS} FROM fam"),
    "enrichment_within_detected": (lambda s, d: rounded(within(s, d)).select("study", "namespace", "term", "study_count", "study_n", "pop_count", "pop_n", "p_raw", "enrichment", "q"), f"{family_sql(_COND, 'hits')} SELECT {_FAM_COLS} FROM fam"),
    "enrichment_skipped": (
        lambda s, d: enrich.skipped(by_condition(s, d), enrich.background(contrasts(s, d), full(s, d))),
        f"{family_sql(_COND, 'contrast')} SELECT study, namespace, input_entities, mapped, 'fewer than 10 mapped entities' AS reason FROM el WHERE mapped < 10",
    ),
    "top_terms_per_group": (
        lambda s, d: enrich.top_terms(tested(s, d), ["study", "namespace"], 3, 1.01).select("study", "namespace", "term", "rank"),
        f"{family_sql(_MODULES, 'contrast')} SELECT study, namespace, term, rank FROM (SELECT *, row_number() OVER (PARTITION BY study, namespace ORDER BY p_raw, namespace, term)::INTEGER AS rank FROM fam WHERE enrichment = 'e' AND q < 1.01) WHERE rank <= 3",
    ),
    "term_count_grid": (
        lambda s, d: enrich.count_grid(enrich.top_terms(tested(s, d), ["study", "namespace"], 15, 0.999), [f"M{i}" for i in range(5)], full(s, d)),
        f"{family_sql(_MODULES, 'contrast')}, tp AS (SELECT study, namespace FROM (SELECT *, row_number() OVER (PARTITION BY study, namespace ORDER BY p_raw, namespace, term) AS rn FROM fam WHERE enrichment = 'e' AND q < 0.999) WHERE rn <= 15) SELECT s.study, n.namespace, count(tp.study) AS terms FROM (SELECT 'M' || range AS study FROM range(5)) s CROSS JOIN (SELECT DISTINCT namespace FROM full_t) n LEFT JOIN tp ON tp.study = s.study AND tp.namespace = n.namespace GROUP BY ALL",
    ),
    "best_specific_term": (
        lambda s, d: rounded(enrich.best_specific(tested(s, d), 400)),
        f"{family_sql(_MODULES, 'contrast')}, b AS (SELECT *, row_number() OVER (PARTITION BY study ORDER BY q, p_raw, namespace, term) AS rn FROM fam WHERE pop_count <= 400) SELECT s.study, coalesce(b.term, 'no specific term') AS term, b.study_count, round(b.q, 6) AS q FROM (SELECT DISTINCT study FROM fam) s LEFT JOIN b ON b.study = s.study AND b.rn = 1",
    ),
    "nearest_selected_ancestor": (
        lambda s, d: enrich.nearest_ancestors(enrich.top_terms(tested(s, d), ["study"], 20, 1.01), closed(s, d), enrich.depths(ontology.parents(s, d), closed(s, d))),
        f"{family_sql(_MODULES, 'contrast')}, {_DEPTHS}, sel AS (SELECT DISTINCT term FROM (SELECT *, row_number() OVER (PARTITION BY study ORDER BY p_raw, namespace, term) AS rn FROM fam WHERE enrichment = 'e' AND q < 1.01) WHERE rn <= 20) SELECT child, parent FROM (SELECT clo.child, clo.ancestor AS parent, row_number() OVER (PARTITION BY clo.child ORDER BY dp.depth DESC, clo.ancestor DESC) AS rn FROM clo JOIN sel a ON a.term = clo.child JOIN sel b ON b.term = clo.ancestor JOIN dp ON dp.term = clo.ancestor) WHERE rn = 1",
    ),
    "flow_edges": (
        flow,
        family_sql(_MODULES, "contrast", cells_sql()) + ", b AS (SELECT *, row_number() OVER (PARTITION BY study ORDER BY q, p_raw, namespace, term) AS rn FROM fam WHERE pop_count <= 400) SELECT condition AS source, 'M' || module AS target, observed AS value FROM r WHERE observed > 0 UNION ALL SELECT study, term, study_count FROM b WHERE rn = 1 AND study_count > 0",
    ),
}
