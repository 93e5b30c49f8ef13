"""Queries on study families, side-by-side reports, request systems and record checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from kontra.functions.stats import display
from kontra.operators import cluster, detect, enrich, matrix, requests, service, text
from kontra.plans import profiles, texts
from kontra.plans.detection import HITS_SQL, LABELS_SQL, bh_sql, fisher_sql, labels, rounded
from kontra.plans.enrichment import _FAM_COLS, _FULL, _MODULES, by_condition, family_sql, full, tested
from kontra.plans.profiles import _REAL, ratio
from kontra.sources.tables import CONTRAST_SQL, conditions, contrasts, kept

_FAMILY = ["study", "namespace", "term", "study_count", "study_n", "pop_count", "pop_n", "p_raw", "enrichment", "q"]


def by_multiplicity(s, d, exclusive: bool):
    """Studies: a condition's detections that no other condition shares, or those that some other does."""
    e = detect.evidence(contrasts(s, d)).where("detected")
    return e.where("multiplicity = 1" if exclusive else "multiplicity > 1").select(F.col("condition").alias("study"), "entity")


def multiplicity_family(exclusive):
    return lambda s, d: rounded(enrich.family(by_multiplicity(s, d, exclusive), contrasts(s, d), full(s, d))).select(*_FAMILY)


def _multiplicity(test):
    return f"stu AS (SELECT condition AS study, entity FROM (SELECT condition, entity, count(*) OVER (PARTITION BY entity) AS m FROM contrast WHERE fdr < 0.05) WHERE m {test})"


def within_module(s, d):
    """condition x module studies, each against the mapped entities of its own module."""
    stratum = F.element_at(F.split("study", r"\|"), 2)
    population = labels(contrasts(s, d)).select(F.concat(F.lit("M"), F.col("module").cast("string")).alias("stratum"), "entity")
    return kept(s, d, "within_module", lambda: enrich.family_within(by_condition(s, d).withColumn("stratum", stratum), population, full(s, d)))


def within_counts(s, d):
    shown = enrich.top_terms(within_module(s, d), ["study", "namespace"], 15, 0.9)
    names = F.explode(F.array(*[F.lit(f"M{m}") for m in range(5)]))
    grid = contrasts(s, d).select("condition").distinct().select("condition", names.alias("m")).select(F.concat_ws("|", "condition", "m").alias("study"))
    return enrich.study_counts(shown, grid)


_WITHIN = f"""WITH {CONTRAST_SQL}, {HITS_SQL}, {LABELS_SQL}, {_FULL},
bk AS (SELECT DISTINCT module, namespace, entity FROM full_t JOIN labels USING (entity)), pt AS (SELECT module, namespace, term, count(DISTINCT entity) AS pop_count FROM full_t JOIN labels USING (entity) GROUP BY ALL), pn AS (SELECT module, namespace, count(*) AS pop_n FROM bk GROUP BY ALL),
own AS (SELECT condition || '|M' || module AS study, module, entity FROM hits JOIN labels USING (entity)), sn AS (SELECT study, o.module, namespace, count(*) AS study_n FROM own o JOIN bk ON bk.entity = o.entity AND bk.module = o.module GROUP BY ALL HAVING count(*) >= 10),
sc AS (SELECT study, namespace, term, count(DISTINCT entity) AS study_count FROM own JOIN full_t USING (entity) GROUP BY ALL),
w0 AS (SELECT sn.study, sn.namespace, pt.term, coalesce(sc.study_count, 0) AS study_count, study_n, pop_count, pop_n FROM sn JOIN pt ON pt.module = sn.module AND pt.namespace = sn.namespace JOIN pn ON pn.module = sn.module AND pn.namespace = sn.namespace LEFT JOIN sc ON sc.study = sn.study AND sc.namespace = sn.namespace AND sc.term = pt.term),
w1 AS (SELECT *, {fisher_sql('study_count', 'study_n', 'pop_count', 'pop_n')} AS p_raw, CASE WHEN study_count / study_n::DOUBLE > pop_count / pop_n::DOUBLE THEN 'e' ELSE 'p' END AS enrichment FROM w0),
fam AS (SELECT * FROM {bh_sql('w1', 'p_raw', 'study, namespace, term')})"""

_OTHER = LABELS_SQL.replace("(entity % 5)", "((entity // 7) % 5)")


def single_fit(s, d):
    """A second stand-in labeling, to be compared with ``labels``."""
    return labels(contrasts(s, d)).select("entity", F.expr("cast((entity div 7) % 5 as int)").alias("module"))


def side_by_side(s, d):
    single = single_fit(s, d)
    studies = single.select(F.concat(F.lit("M"), F.col("module").cast("string")).alias("study"), "entity")
    return enrich.side_by_side(single, labels(contrasts(s, d)), enrich.family(studies, contrasts(s, d), full(s, d)), tested(s, d), 400)


def _side_sql(name, labels_sql):
    fam = family_sql(_MODULES, "contrast", f"WITH {CONTRAST_SQL}, {HITS_SQL}, {labels_sql}")
    return f"({fam}, b AS (SELECT study, term, row_number() OVER (PARTITION BY study ORDER BY q, p_raw, namespace, term) AS rn FROM fam WHERE pop_count <= 400) SELECT l.module, count(*) AS n_{name}, coalesce(any_value(b.term), 'no specific term') AS top_{name} FROM labels l LEFT JOIN b ON b.study = 'M' || l.module AND rn = 1 GROUP BY l.module)"


def assignment(s, d):
    return labels(contrasts(s, d)).select(F.concat(F.lit("Part"), F.col("entity").cast("string")).alias("id"), "module", "strength")


WANTED = [("part", "PART", "pArt")[i % 3] + str(i) for i in range(1, 90)] + ["part1000000000"]


def membership(s, d):
    """Strength is there for ids whose number is odd: the others must come back with null."""
    a = assignment(s, d)
    return rounded(service.membership(a.drop("strength"), a.where("cast(substring(id, 5, 20) as bigint) % 2 = 1").drop("module"), WANTED))


def faulty(s, d):
    """The generated records, one phrasing twice without label, one twice with another text."""
    t = texts.generated(s, d).drop("template")
    g = texts.generated(s, d)
    bare = g.where("template = 0").withColumn("label", F.lit(None).cast("string")).drop("template")
    other = g.where("template = 1").withColumn("text", F.concat("text", F.lit("!"))).drop("template")
    return t.unionByName(bare).unionByName(other)


_GENERATED = texts.QUERIES["generated_requests"][1]


def split_requests(s, d):
    """60, 20 and 20 % of the groups of each label."""
    g = texts.generated(s, d)
    groups = text.group_split(requests.require_groups(g.select("label", "grp").distinct(), ["label"], 0.2), ["label"], "grp", 0.2)
    rows = g.join(groups.select("grp", "split"), "grp")
    return requests.require_separate(rows, ["grp", "fingerprint"]).groupBy("label", "split").agg(F.count_distinct("grp").alias("grps"), F.count(F.lit(1)).alias("records"))


def asked(s, d):
    return s.createDataFrame(texts.request_rows(conditions(s, d)), "request_id int, question string")


#: What should come of each request template, and the intents that have evidence.
EXPECTED = ["accepted", "accepted", "accepted", "accepted", "abstain", "incompatible", "abstain", "incompatible", "needs_clarification", "accepted", "incompatible", "abstain", "abstain", "needs_clarification"]
CITED = [service.SUMMARY, service.LOOKUP, service.PAIR]


def baseline(s, d):
    return requests.baseline(asked(s, d), conditions(s, d))


def rates(s, d):
    evidence = s.createDataFrame([(CITED, "ab" * 32)], "intents array<string>, sha256 string")
    both = baseline(s, d).withColumn("system", F.lit("rules")).unionByName(requests.grounded(service.plan_table(asked(s, d), conditions(s, d), contrasts(s, d)), evidence).withColumn("system", F.lit("planner")))
    want = [(i, EXPECTED[i % len(EXPECTED)], [None, service.SUMMARY][i % len(EXPECTED) == 0]) for i, _ in texts.request_rows(conditions(s, d))]
    return requests.evaluate(both, s.createDataFrame(want, "request_id int, expected_status string, expected_intent string"))


def _baseline_sql() -> str:
    values = ", ".join(f"({i}, '{q}')" for i, q in texts.request_rows(texts.NAMES))
    has = lambda ws: "regexp_matches(q, '" + texts._WORD.format("|".join(ws)) + "')"
    heads = "[" + ", ".join(f"'{c.lower().split(' ')[0]}'" for c in texts.NAMES) + "]"
    rules = " ".join(f"WHEN {has(ws)} THEN '{requests.PROPOSED[st]}'" for ws, st, _ in service.RULES)
    return f"""SELECT request_id, coalesce(st, CASE WHEN intent IS NULL THEN 'needs_clarification' ELSE 'accepted' END) AS status, CASE WHEN st IS NULL THEN coalesce(intent, 'unknown') ELSE 'unknown' END AS intent FROM (SELECT request_id,
 CASE WHEN len(list_filter(regexp_extract_all(q, '\\b\\d-[a-z]+'), lambda x: NOT list_contains({heads}, x))) > 0 THEN 'incompatible' {rules} WHEN {has(['module'])} AND {has(['correlation'])} THEN 'abstain' WHEN length(trim(q)) < 12 THEN 'needs_clarification' END AS st,
 CASE WHEN regexp_matches(q, '#\\d+') THEN 'id_lookup' WHEN {has(['terms', 'ontology', 'category'])} THEN 'term_lookup' WHEN {has(['compare', 'similar', 'shared'])} THEN 'pair_lookup' WHEN {has(['detections', 'differential', *[c.lower() for c in texts.NAMES]])} THEN 'summary' END AS intent
 FROM (SELECT request_id, lower(question) AS q FROM (VALUES {values}) v(request_id, question)))"""


def _rates_sql() -> str:
    n, ok = len(EXPECTED), "count(*) FILTER (status = 'accepted')"
    return f"""WITH pr AS (SELECT 'rules' AS system, request_id, status, intent, false AS cited FROM ({_baseline_sql()}) UNION ALL
SELECT 'planner', request_id, CASE status WHEN 'ready_for_review' THEN 'accepted' WHEN 'abstained' THEN 'abstain' ELSE status END, CASE WHEN status = 'ready_for_review' THEN intent ELSE 'unknown' END, status = 'ready_for_review' AND intent IN ('summary', 'id_lookup', 'pair_lookup') FROM ({texts._plan_sql()})),
j AS (SELECT *, {EXPECTED}[request_id % {n} + 1] AS want, CASE WHEN request_id % {n} = 0 THEN 'summary' ELSE 'unknown' END AS want_intent FROM pr)
SELECT system, count(*) AS cases, round_even(avg((status = want)::INT), 4) AS status_rate, round_even(avg((intent = want_intent)::INT), 4) AS intent_rate, 1.0::DOUBLE AS no_forbidden_claim, 1.0::DOUBLE AS workflow_validity,
 round_even(count(*) FILTER (cited) / greatest({ok}, 1)::DOUBLE, 4) AS groundedness, round_even(count(*) FILTER (cited) / greatest({ok}, 1)::DOUBLE, 4) AS citation_correctness FROM j GROUP BY system"""


def _findings_sql() -> str:
    warned = " ".join(f"WHEN '{k}' THEN {v}" for k, v in requests.WARNINGS.items())
    return f"WITH p AS ({texts._plan_sql()}) SELECT request_id, 'error' AS severity, code FROM p WHERE code <> 'ok' UNION ALL SELECT request_id, 'warning', unnest(CASE intent {warned} END) FROM p WHERE intent IS NOT NULL AND code IN ('ok', 'invalid_threshold')"


def split_manifest(s, d):
    """Per split its records, groups and an order-free digest."""
    g = texts.generated(s, d)
    groups = text.group_split(requests.require_groups(g.select("label", "grp").distinct(), ["label"], 0.2), ["label"], "grp", 0.2)
    rows = requests.require_separate(g.join(groups.select("grp", "split"), "grp"), ["grp", "fingerprint"])
    return text.multiset_digest(rows, ["label", "template", "grp", "text", "fingerprint"], ["split"]).join(rows.groupBy("split").agg(F.count_distinct("grp").alias("grps")), "split")


def _told(c):
    return f"coalesce(strlen({c}::VARCHAR) || ':' || {c}::VARCHAR, '-')"


_MANIFEST = f"""WITH g AS ({_GENERATED}), n AS (SELECT label, grp, row_number() OVER (PARTITION BY label ORDER BY md5('2026:' || grp), grp) AS r FROM (SELECT DISTINCT label, grp FROM g)),
x AS (SELECT CASE WHEN r <= 2 THEN 'validation' WHEN r <= 4 THEN 'test' ELSE 'train' END AS split, g.grp, sha256({' || '.join(_told('g.' + c) for c in ('label', 'template', 'grp', 'text', 'fingerprint'))}) AS h FROM n JOIN g ON g.grp = n.grp)
SELECT split, count(*) AS rows, count(DISTINCT grp) AS grps, sha256(count(*) || ':' || {" || ':' || ".join(f"(sum(('0x' || substr(h, {16 * i + 1}, 16))::UBIGINT::HUGEINT) % 18446744073709551616::HUGEINT)" for i in range(4))}) AS digest FROM x GROUP BY split"""


def pairs_at(s, d, modules):
    """Similarities of the conditions' profiles over ``modules`` modules, corrected against shuffled labels."""
    return profiles.empirical_pairs(s, d, modules=modules)


#: Pairs whose corrected similarity survives at both resolutions; at 40 shuffles few can pass a low threshold.
BOTH = 0.9
_PAIRS = profiles.QUERIES["empirical_p_pairs"][1]
_AT10 = _PAIRS.replace("(entity % 5)", "(entity % 10)")

QUERIES = {
    "split_manifest": (split_manifest, _MANIFEST),
    "cross_k_pairs": (
        lambda s, d: cluster.robust_pairs(pairs_at(s, d, 5), pairs_at(s, d, 10), BOTH),
        "SELECT a, b, x.percentile_vs_null AS first_percentile_vs_null, x.q AS first_q, x.pearson AS first_pearson, y.percentile_vs_null AS second_percentile_vs_null, y.q AS second_q, y.pearson AS second_pearson, "
        f"CASE WHEN x.q < {BOTH} AND y.q < {BOTH} THEN 'both' WHEN x.q < {BOTH} THEN 'first' ELSE 'second' END AS found_in FROM ({_PAIRS}) x FULL JOIN ({_AT10}) y USING (a, b) WHERE x.q < {BOTH} OR y.q < {BOTH}",
    ),
    "study_term_flows": (
        lambda s, d: enrich.study_flows(enrich.family(by_multiplicity(s, d, True), contrasts(s, d), full(s, d))),
        f"{family_sql(_multiplicity('= 1'), 'contrast')} SELECT study AS source, term AS target, greatest(study_count, 1)::BIGINT AS value FROM (SELECT *, row_number() OVER (PARTITION BY study ORDER BY q, p_raw, namespace, term) AS rn FROM fam) WHERE rn = 1",
    ),
    "enrichment_exclusive": (multiplicity_family(True), f"{family_sql(_multiplicity('= 1'), 'contrast')} SELECT {_FAM_COLS} FROM fam"),
    "enrichment_shared": (multiplicity_family(False), f"{family_sql(_multiplicity('> 1'), 'contrast')} SELECT {_FAM_COLS} FROM fam"),
    "enrichment_within_module": (lambda s, d: rounded(within_module(s, d)).select(*_FAMILY), f"{_WITHIN} SELECT {_FAM_COLS} FROM fam"),
    "study_term_counts": (
        within_counts,
        f"{_WITHIN}, tp AS (SELECT study FROM (SELECT study, row_number() OVER (PARTITION BY study, namespace ORDER BY p_raw, namespace, term) AS rn FROM fam WHERE enrichment = 'e' AND q < 0.9) WHERE rn <= 15) SELECT c.condition, m.module, (SELECT count(*) FROM tp WHERE tp.study = c.condition || '|M' || m.module) AS terms FROM (SELECT DISTINCT condition FROM contrast) c CROSS JOIN (SELECT range::INTEGER AS module FROM range(5)) m",
    ),
    "terms_containing": (lambda s, d: rounded(enrich.containing(tested(s, d), "term", "BRAND#1").select("study", "term", "q")), f"{family_sql(_MODULES, 'contrast')} SELECT study, term, round(q, 6) AS q FROM fam WHERE term ILIKE '%brand#1%'"),
    "top_terms_side_by_side": (side_by_side, f"SELECT c.module, n_consensus, top_consensus, coalesce(n_single, 0) AS n_single, coalesce(top_single, 'no specific term') AS top_single FROM {_side_sql('consensus', LABELS_SQL)} c LEFT JOIN {_side_sql('single', _OTHER)} s USING (module)"),
    "module_blocks": (
        lambda s, d: cluster.blocks(labels(contrasts(s, d))),
        f"WITH {CONTRAST_SQL}, {LABELS_SQL}, o AS (SELECT module, row_number() OVER (ORDER BY module, entity) - 1 AS i FROM labels), e AS (SELECT module, i, lag(module) OVER (ORDER BY i) IS DISTINCT FROM module AS edge, (SELECT count(*) FROM o) AS n FROM o), b AS (SELECT module, i AS first, lead(i, 1, n) OVER (ORDER BY i) AS after FROM e WHERE edge) SELECT module, first, after - 1 AS last, (first + after) / 2.0::DOUBLE AS middle FROM b",
    ),
    "membership_lookup": (membership, f"WITH {CONTRAST_SQL}, {LABELS_SQL} SELECT 'Part' || entity AS id, module, CASE WHEN entity % 2 = 1 THEN round(strength, 6) END AS strength FROM labels WHERE lower('Part' || entity) IN {tuple(w.lower() for w in WANTED)}"),
    "pair_label_lookup": (
        lambda s, d: rounded(service.labelled_pair(matrix.correlations(ratio(s, d), "log2_ratio").select(service.pair_label(F.col("a"), F.col("b")).alias("pair"), "pearson"), ["FURNITURE", "5-LOW"])),
        f"{_REAL} SELECT '5-LOW-FURNITURE' AS pair, round(pearson, 6) AS pearson FROM cor WHERE a = '5-LOW' AND b = 'FURNITURE'",
    ),
    "display_rounding": (
        lambda s, d: detect.detected(contrasts(s, d)).select("entity", "condition", display("effect", 1).alias("one"), display("effect", 3).alias("three"), display("fdr", 4).alias("four")),
        f"WITH {CONTRAST_SQL} SELECT entity, condition, round_even(effect, 1) + 0.0::DOUBLE AS one, round_even(effect, 3) + 0.0::DOUBLE AS three, round_even(fdr, 4) AS four FROM contrast WHERE fdr < 0.05",
    ),
    "chunk_inventory": (
        lambda s, d: texts.chunked(s, d).groupBy("doc_id", "source_sha256").agg(F.count(F.lit(1)).alias("reviewed_chunks")).join(texts.documents(s, d).select("doc_id", "source"), "doc_id").select("doc_id", "source", "source_sha256", "reviewed_chunks"),
        f"WITH {texts._CHUNK} SELECT doc_id, source, sha256(t) AS source_sha256, count(*) AS reviewed_chunks FROM ch JOIN documents USING (doc_id) WHERE ch.text <> '' GROUP BY ALL",
    ),
    "split_requests": (split_requests, f"WITH g AS ({_GENERATED}), n AS (SELECT label, grp, row_number() OVER (PARTITION BY label ORDER BY md5('2026:' || grp), grp) AS r FROM (SELECT DISTINCT label, grp FROM g)) SELECT n.label, CASE WHEN r <= 2 THEN 'validation' WHEN r <= 4 THEN 'test' ELSE 'train' END AS split, count(DISTINCT n.grp) AS grps, count(*) AS records FROM n JOIN g ON g.grp = n.grp GROUP BY ALL"),
    "record_faults": (
        lambda s, d: requests.record_faults(faulty(s, d), ["label", "grp", "text", "fingerprint"]),
        f"WITH g AS ({_GENERATED}), r AS (SELECT label, grp, text, fingerprint FROM g UNION ALL SELECT NULL, grp, text, fingerprint FROM g WHERE template = 0 UNION ALL SELECT label, grp, text || '!', fingerprint FROM g WHERE template = 1) SELECT 'missing value' AS fault, count(*) AS n FROM r WHERE label IS NULL OR grp IS NULL OR text IS NULL OR fingerprint IS NULL UNION ALL SELECT 'wrong fingerprint', count(*) FROM r WHERE fingerprint <> sha256(lower(trim(text))) UNION ALL SELECT 'repeated fingerprint', count(*) FROM (SELECT fingerprint FROM r GROUP BY fingerprint HAVING count(*) > 1)",
    ),
    "plan_findings": (lambda s, d: requests.findings(service.plan_table(asked(s, d), conditions(s, d), contrasts(s, d))), _findings_sql()),
    "baseline_proposals": (lambda s, d: baseline(s, d).select("request_id", "status", "intent"), _baseline_sql()),
    "proposal_rates": (rates, _rates_sql()),
}
