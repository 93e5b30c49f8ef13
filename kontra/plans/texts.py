"""Queries of the text layer and the service."""

from __future__ import annotations

from pyspark.sql import functions as F

from kontra.functions import ranks
from kontra.functions.stats import keyed
from kontra.operators import integrity, matrix, service, text
from kontra.operators import perceptron as network
from kontra.plans.detection import LABELS_SQL, labels, rounded
from kontra.plans.enrichment import _MODULES, family_sql, tested
from kontra.plans.profiles import _REAL, ratio
from kontra.sources.tables import CONTRAST_SQL, conditions, contrasts, table

_TEMPLATES = ["Summary of detections under {c} at fdr 0.05", "Compare {c} with {d}", "Which module has #{i}?", "Show terms for {c}", "Prove that {c} causes it", "Use Excel for {c}", "Detections under {c} with alpha = 0.5", "Compare 9-RUSH with {c}", "Please look deeper", "The page on {c}", "Mean age under {c}", "Use the retracted method on {c}", "Correlation of {c} with its module", "Data?"]


def request_rows(names: list[str]) -> list[tuple[int, str]]:
    out = []
    for a, c in enumerate(names):
        for b, t in enumerate(_TEMPLATES):
            out.append((a * len(_TEMPLATES) + b, t.format(c=c, d=names[(a + 3) % len(names)], i=a * 7 + 1 if a % 2 else 10**9 + a)))
    return out


#: The ten conditions of the driver tables, as the oracle's request list needs them spelled out.
NAMES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW", "AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]


def plans(s, d):
    t = service.plan_table(s.createDataFrame(request_rows(conditions(s, d)), "request_id int, question string"), conditions(s, d), contrasts(s, d))
    return t.select("request_id", "intent", F.array_join("conditions", ",").alias("conditions"), F.array_join("ids", ",").alias("ids"), "threshold", "status", "code")


def documents(s, d):
    return table(s, d, "documents")


def chunked(s, d):
    return text.chunks(documents(s, d))


def queries_of(s, d):
    return table(s, d, "benchmark").select(F.col("item_id").alias("query_id"), "text")


def split_rows(s, d):
    docs = documents(s, d).select("doc_id", "lang", "source", text.normalized(F.col("text")).alias("norm"))
    docs = docs.withColumn("grp", F.concat_ws(":", "lang", "source"))
    groups = text.group_split(docs.select("lang", "grp").distinct(), ["lang"], "grp")
    return docs.join(groups.select("grp", "split"), "grp")


def leaky_rows(s, d):
    """The split rows, and those of even doc_id once more as test rows: a leak that must be found."""
    t = split_rows(s, d)
    return t.unionByName(t.where("doc_id % 2 = 0").withColumn("split", F.lit("test")))


def judged(s, d):
    docs = documents(s, d).select("doc_id", "lang", "n_chars")
    return table(s, d, "labels").join(docs, "doc_id").select("doc_id", "lang", F.col("quality").alias("true"), (F.col("n_chars") > 1000).cast("int").alias("pred"), "toxic")


def cases(s, d):
    t = judged(s, d)
    return t.select("lang", (F.col("true") == F.col("pred")).alias("status_ok"), (F.col("toxic") == 0).alias("intent_ok"), (F.col("pred") == 1).alias("accepted"), (F.col("true") == 1).alias("expected"), (F.col("true") == 1).alias("grounded"))


def generated(s, d):
    """Synthetic requests: 4 labels x conditions x 4 phrasings, grouped so that phrasings of one pair stay together."""
    words = {"summary": "count", "lookup": "find", "terms": "explain", "pair": "compare"}
    forms = ["please {w} {c}", "{w} {c} now", "for {c}: {w}", "could you {w} {c}"]
    lab = s.createDataFrame(list(words.items()), "label string, w string")
    form = s.createDataFrame(list(enumerate(forms)), "template int, f string")
    names = contrasts(s, d).select("condition").distinct()
    t = lab.crossJoin(form).crossJoin(F.broadcast(names))
    body = F.replace(F.replace(F.col("f"), F.lit("{w}"), F.col("w")), F.lit("{c}"), F.lower("condition"))
    return t.select("label", "template", F.concat_ws(":", "label", F.lower("condition")).alias("grp"), body.alias("text"), F.sha2(body, 256).alias("fingerprint"))


#: Kinds of candidates: status, intent, text with {c}, {d} (conditions), {e} (an entity) and {t} (a threshold).
KINDS = [
    ("accepted", "summary", "Count detections under {c}"),
    ("accepted", "pair_lookup", "Compare {c} with {d}"),
    ("accepted", "id_lookup", "Which module holds #{e}?"),
    ("accepted", "term_lookup", "Terms of the module of #{e} under {c}"),
    ("abstain", "unknown", "Show beyond doubt that {c} drives #{e}"),
    ("accepted", "summary", " Detections under {c} at fdr 0.0{t} "),
    ("incompatible", "unknown", "Use the raw price files for {c}"),
    ("needs_clarification", "unknown", "tell me MORE about {c}"),
]


def candidates(s, d):
    """candidate, kind, status, intent, text, fingerprint: every kind for every detected entity, conditions in rotation."""
    names = conditions(s, d)
    kinds = s.createDataFrame([(k, *x) for k, x in enumerate(KINDS)], "kind int, status string, intent string, form string")
    e = labels(contrasts(s, d)).select("entity").crossJoin(F.broadcast(kinds))
    of = lambda shift: F.element_at(F.array(*[F.lit(c) for c in names]), (F.pmod(F.col("entity") * 3 + F.col("kind") + shift, F.lit(len(names))) + 1).cast("int"))
    t = F.col("form")
    for mark, value in (("{c}", of(0)), ("{d}", of(3)), ("{e}", F.col("entity").cast("string")), ("{t}", (F.pmod("entity", F.lit(9)) + 1).cast("string"))):
        t = F.replace(t, F.lit(mark), value)
    return e.select((F.col("entity") * len(KINDS) + F.col("kind")).alias("candidate"), "kind", "status", "intent", t.alias("text")).withColumn("fingerprint", F.sha2(F.lower(F.trim("text")), 256))


def training_records(s, d):
    """Candidates, of one fingerprint the first, in an order that depends on nothing but the seed and the fingerprint."""
    t = candidates(s, d)
    first = t.groupBy("fingerprint").agg(F.min_by(F.struct("candidate", "kind", "status", "intent", "text"), "candidate").alias("r")).select("r.*", "fingerprint")
    return ranks.numbered_by_key(first.withColumn("k", keyed(F.lit(2026), F.col("fingerprint"))), [], "k", [F.col("fingerprint")], "position").drop("k")


def _records_sql() -> str:
    values = ", ".join(f"({k}, '{a}', '{b}', '{c}')" for k, (a, b, c) in enumerate(KINDS))
    names = "[" + ", ".join(f"'{c}'" for c in NAMES) + "]"
    of = lambda shift: f"{names}[(entity * 3 + kind + {shift}) % {len(NAMES)} + 1]"
    text_ = f"replace(replace(replace(replace(form, '{{c}}', {of(0)}), '{{d}}', {of(3)}), '{{e}}', entity::VARCHAR), '{{t}}', (entity % 9 + 1)::VARCHAR)"
    return f"""WITH {CONTRAST_SQL}, {LABELS_SQL}, kinds(kind, status, intent, form) AS (VALUES {values}), c AS (SELECT entity * {len(KINDS)} + kind AS candidate, kind, status, intent, {text_} AS text FROM labels CROSS JOIN kinds),
f AS (SELECT *, sha256(lower(trim(text))) AS fingerprint FROM c), r AS (SELECT *, row_number() OVER (PARTITION BY fingerprint ORDER BY candidate) AS n FROM f)
SELECT candidate, kind, status, intent, text, fingerprint, row_number() OVER (ORDER BY md5('2026:' || fingerprint), fingerprint) AS position FROM r WHERE n = 1"""


def perceptron(s, d):
    """Metrics on the test fold of the classifier fitted to three folds, stopped by the fifth."""
    rows = documents(s, d).select("doc_id", "text").join(table(s, d, "labels").select("doc_id", "quality"), "doc_id")
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5
    train = rows.where(fold > 1)
    vocab = text.vocabulary(train).persist()
    sparse = lambda t: text.sparse_rows(t, vocab, "quality")
    model = network.fit(sparse(train), sparse(rows.where(fold == 1)), vocab.count())
    test = sparse(rows.where(fold == 0))
    t = test.select("id", F.col("y").alias("true")).join(network.predict(test, model.network), "id").select("true", "pred")
    return text.class_metrics(text.confusion(t, [0, 1])).withColumn("epochs", F.lit(model.epochs)).withColumn("parameters", F.lit(model.network.parameters))


def nested():
    """A JSON text of depth five whose keys, values and numbers hold what is replaced."""
    return F.concat(F.lit('{"src1": {"a": [{"src": ["'), "source", F.lit('", '), F.col("n_chars").cast("string"), F.lit(', {"lang": "'), "lang", F.lit(':src", "src12": null}]}]}}'))


_NESTED = """'{"src1": {"a": [{"src": ["' || source || '", ' || n_chars || ', {"lang": "' || lang || ':src", "src12": null}]}]}}'"""


def audit(s, d):
    t = table(s, d, "supplier").select(F.col("s_name").alias("path"), "s_nationkey")
    n = table(s, d, "nation").select(F.col("n_nationkey").alias("s_nationkey"), "n_name")
    return integrity.coverage(t, ["s_nationkey"], "path", n, "s_nationkey")


_STOP = "[" + ", ".join(f"'{w}'" for w in text.STOP) + "]"
_TOK = "list_filter(list_distinct(regexp_extract_all(lower({c}), '[a-z0-9][a-z0-9_-]+')), lambda x: NOT list_contains(" + _STOP + ", x))"
_CHUNK = r"""trimmed AS (SELECT doc_id, text AS t, regexp_replace(text, '^\s+|\s+$', '', 'g') AS s FROM documents WHERE text IS NOT NULL),
raw AS (SELECT doc_id, t, s, unnest(range(0, (length(s) + 1799) // 1800)) AS part FROM trimmed WHERE s <> ''),
ch AS (SELECT doc_id, doc_id || ':0:' || part AS chunk_id, regexp_replace(substr(s, (part * 1800 + 1)::BIGINT, 1800), '^\s+|\s+$', '', 'g') AS text, regexp_replace(split_part(s, chr(10), 1), '^\s+|\s+$', '', 'g') AS heading, t FROM raw)"""
_BOTH = "concat_ws(' ', heading, text)"
_WORDS = "regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+')"
_VOC = f"voc AS (SELECT w AS token, count(*) AS n, row_number() OVER (ORDER BY w) - 1 AS index FROM (SELECT unnest({_WORDS}) AS w FROM documents) GROUP BY w)"
_SPLIT = r"""d0 AS (SELECT doc_id, lang, source, lang || ':' || source AS grp, lower(trim(regexp_replace(text, '[ \t\n\r\f\v]+', ' ', 'g'), ' ')) AS norm FROM documents),
g0 AS (SELECT lang, grp, row_number() OVER (PARTITION BY lang ORDER BY md5('2026:' || grp), grp) AS r, greatest(1, round_even(count(*) OVER (PARTITION BY lang) * 0.15::DOUBLE, 0)::INTEGER) AS k FROM (SELECT DISTINCT lang, grp FROM d0)),
g1 AS (SELECT lang, grp, CASE WHEN r <= k THEN 'validation' WHEN r <= 2 * k THEN 'test' ELSE 'train' END AS split FROM g0), d1 AS (SELECT d0.*, split FROM d0 JOIN g1 USING (grp))"""
_LEAK = "SELECT splits, count(*) AS keys FROM (SELECT {k}, string_agg(split, '+' ORDER BY split) AS splits, count(*) AS n FROM (SELECT DISTINCT {k}, split FROM d1) GROUP BY {k}) WHERE n > 1 GROUP BY splits"
_JUDGED = "j AS (SELECT l.doc_id, lang, quality AS t, (n_chars > 1000)::INTEGER AS p, toxic FROM labels l JOIN documents d USING (doc_id))"
_WORD = "(^|[^a-z0-9_])({})([^a-z0-9_]|$)"


def _plan_sql() -> str:
    values = ", ".join(f"({i}, '{q}')" for i, q in request_rows(NAMES))
    has = lambda ws: "regexp_matches(q, '" + _WORD.format("|".join(ws)) + "')"
    found = "list_filter([" + ", ".join(f"CASE WHEN {has([c.lower()])} THEN '{c}' END" for c in NAMES) + "], lambda x: x IS NOT NULL)"
    heads = "[" + ", ".join(f"'{c.lower().split(' ')[0]}'" for c in NAMES) + "]"
    rules = " ".join(f"WHEN {has(ws)} THEN '{code}'" for ws, _, code in service.RULES)
    rules += f" WHEN {has(['module'])} AND {has(['correlation'])} THEN 'retracted_method'"
    return f"""WITH {CONTRAST_SQL}, rq(request_id, question) AS (VALUES {values}), a AS (SELECT request_id, question, lower(question) AS q FROM rq),
b AS (SELECT *, {found} AS conds, list_distinct(regexp_extract_all(question, '#(\\d+)', 1)) AS ids, coalesce(TRY_CAST(nullif(regexp_extract(q, '(?:fdr|alpha)\\s*(?:<|=|at)?\\s*(0?\\.\\d+)', 1), '') AS DOUBLE), 0.05::DOUBLE) AS threshold FROM a),
ab AS (SELECT request_id FROM (SELECT request_id, unnest(ids)::BIGINT AS e FROM b) u WHERE NOT EXISTS (SELECT 1 FROM contrast WHERE entity = e)),
c AS (SELECT *, CASE WHEN len(ids) > 0 THEN 'id_lookup' WHEN {has(['terms', 'ontology', 'category'])} THEN 'term_lookup' WHEN len(conds) >= 2 AND {has(['compare', 'similar', 'shared', 'pair'])} THEN 'pair_lookup' WHEN len(conds) > 0 OR {has(['detections', 'differential', 'summary', 'response'])} THEN 'summary' END AS intent,
 len(list_filter(regexp_extract_all(q, '\\b\\d-[a-z]+'), lambda x: NOT list_contains({heads}, x))) > 0 AS unknown, request_id IN (SELECT request_id FROM ab) AS absent FROM b),
e AS (SELECT *, CASE WHEN unknown THEN 'unknown_condition' {rules} WHEN absent THEN 'unknown_id' WHEN intent IS NULL THEN 'ambiguous_request' WHEN intent = 'summary' AND NOT (threshold > 0 AND threshold <= 0.1) THEN 'invalid_threshold' ELSE 'ok' END AS code FROM c)
SELECT request_id, intent, array_to_string(conds, ',') AS conditions, array_to_string(ids, ',') AS ids, threshold, CASE WHEN code = 'ok' THEN 'ready_for_review' WHEN code = 'ambiguous_request' THEN 'needs_clarification' WHEN code IN ('unsupported_claim', 'retracted_method', 'invalid_threshold') THEN 'abstained' ELSE 'incompatible' END AS status, code FROM e"""


QUERIES = {
    "training_records": (training_records, _records_sql()),
    "chunk_documents": (lambda s, d: chunked(s, d).select("doc_id", "chunk_id", "heading", F.length("text").alias("n_chars"), F.md5(F.col("text").cast("binary")).alias("digest"), "source_sha256"), f"WITH {_CHUNK} SELECT doc_id, chunk_id, heading, length(text)::INTEGER AS n_chars, md5(text) AS digest, sha256(t) AS source_sha256 FROM ch WHERE text <> ''"),
    "token_df": (lambda s, d: text.document_frequency(chunked(s, d)), f"WITH {_CHUNK} SELECT token, count(*) AS df FROM (SELECT unnest({_TOK.format(c=_BOTH)}) AS token FROM ch WHERE text <> '') GROUP BY token"),
    "lexical_retrieval": (
        lambda s, d: text.retrieve(queries_of(s, d), chunked(s, d)).select("query_id", "chunk_id", F.round("score", 6).alias("score"), "rank"),
        f"""WITH {_CHUNK}, d AS (SELECT chunk_id, {_TOK.format(c=_BOTH)} AS ts FROM ch WHERE text <> ''), q AS (SELECT item_id AS query_id, {_TOK.format(c='text')} AS ts FROM benchmark),
dt AS (SELECT chunk_id, greatest(len(ts), 1) AS dn, unnest(ts) AS token FROM d), qt AS (SELECT query_id, greatest(len(ts), 1) AS qn, unnest(ts) AS token FROM q), f AS (SELECT token, ln(((SELECT count(*) FROM d) + 1)::DOUBLE / (count(*) + 1)) + 1 AS idf FROM dt GROUP BY token),
s AS (SELECT query_id, chunk_id, round(sum(idf) / sqrt(any_value(qn) * any_value(dn)), 9) AS score FROM dt JOIN qt USING (token) JOIN f USING (token) GROUP BY ALL)
SELECT query_id, chunk_id, round(score, 6) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id)::INTEGER AS rank FROM s WHERE score >= 0.08) WHERE rank <= 4""",
    ),
    "vocabulary_index": (lambda s, d: text.vocabulary(documents(s, d), least=2), f"WITH {_VOC} SELECT token, n, index FROM voc WHERE n >= 2"),
    "vectorize_l2": (
        lambda s, d: rounded(text.vectors(documents(s, d), text.vocabulary(documents(s, d), least=5))),
        f"WITH {_VOC}, c AS (SELECT doc_id, index, count(*) AS c FROM (SELECT doc_id, unnest({_WORDS}) AS token FROM documents) JOIN voc USING (token) WHERE n >= 5 GROUP BY ALL) SELECT doc_id, index, round(c / sqrt(sum(c * c) OVER (PARTITION BY doc_id)), 6) AS value FROM c",
    ),
    "group_split": (lambda s, d: split_rows(s, d).groupBy("lang", "grp", "split").agg(F.count(F.lit(1)).alias("rows")), f"WITH {_SPLIT} SELECT lang, grp, split, count(*) AS rows FROM d1 GROUP BY ALL"),
    "leakage_groups": (lambda s, d: text.leakage(leaky_rows(s, d), "grp"), f"WITH {_SPLIT.replace('d1 AS', 'd2 AS')}, d1 AS (SELECT * FROM d2 UNION ALL SELECT * REPLACE ('test' AS split) FROM d2 WHERE doc_id % 2 = 0) {_LEAK.format(k='grp')}"),
    "leakage_texts": (lambda s, d: text.leakage(split_rows(s, d), "norm"), f"WITH {_SPLIT} {_LEAK.format(k='norm')}"),
    "dedup_last_wins": (lambda s, d: text.last_wins(documents(s, d), "text", "doc_id"), "SELECT sha256(lower(trim(text, ' '))) AS fingerprint, max(doc_id) AS doc_id, count(*) AS copies FROM documents GROUP BY 1"),
    "generated_requests": (
        generated,
        f"WITH {CONTRAST_SQL}, l(label, w) AS (VALUES ('summary', 'count'), ('lookup', 'find'), ('terms', 'explain'), ('pair', 'compare')), f(template, f) AS (VALUES (0, 'please {{w}} {{c}}'), (1, '{{w}} {{c}} now'), (2, 'for {{c}}: {{w}}'), (3, 'could you {{w}} {{c}}')), t AS (SELECT label, template, label || ':' || lower(condition) AS grp, replace(replace(f, '{{w}}', w), '{{c}}', lower(condition)) AS text FROM l CROSS JOIN f CROSS JOIN (SELECT DISTINCT condition FROM contrast)) SELECT *, sha256(text) AS fingerprint FROM t",
    ),
    "confusion_metrics": (
        lambda s, d: rounded(text.class_metrics(text.confusion(judged(s, d), [0, 1]))),
        f"WITH {_JUDGED}, m AS (SELECT k AS label, (SELECT count(*) FROM j WHERE t = k) AS support, (SELECT count(*) FROM j WHERE t = k AND p = k) AS tp, (SELECT count(*) FROM j WHERE p = k) AS predicted FROM (SELECT unnest([0, 1]) AS k)), r AS (SELECT *, coalesce(tp / nullif(predicted, 0)::DOUBLE, 0) AS pr, coalesce(tp / nullif(support, 0)::DOUBLE, 0) AS rc FROM m), f AS (SELECT *, coalesce(2 * pr * rc / nullif(pr + rc, 0), 0) AS f1 FROM r) SELECT label, support, round(pr, 6) AS precision, round(rc, 6) AS recall, round(f1, 6) AS f1, round(sum(tp) OVER () / (sum(support) OVER ())::DOUBLE, 6) AS accuracy, round(avg(f1) OVER (), 6) AS macro_f1 FROM f",
    ),
    "error_analysis": (lambda s, d: judged(s, d).where(F.col("true") != F.col("pred")).select("doc_id", "true", "pred"), f'WITH {_JUDGED} SELECT doc_id, t AS "true", p AS pred FROM j WHERE t <> p'),
    "evaluation_rates": (lambda s, d: rounded(text.rates(cases(s, d), "lang")), f"WITH {_JUDGED} SELECT lang, count(*) AS cases, round(avg((t = p)::INT), 6) AS status_rate, round(avg((toxic = 0)::INT), 6) AS intent_rate, round(avg((t = 1)::INT) FILTER (p = 1), 6) AS groundedness FROM j GROUP BY lang"),
    "refusal_precision_recall": (lambda s, d: rounded(text.refusals(cases(s, d))), f"WITH {_JUDGED} SELECT round(count(*) FILTER (p = 0 AND t = 0) / nullif(count(*) FILTER (p = 0), 0)::DOUBLE, 6) AS precision, round(count(*) FILTER (p = 0 AND t = 0) / nullif(count(*) FILTER (t = 0), 0)::DOUBLE, 6) AS recall, round(avg((t = p)::INT), 6) AS exact FROM j"),
    "legacy_coverage_audit": (audit, "SELECT s_nationkey, count(*) AS n, min(s_name) AS first_path, any_value(n_name) AS n_name FROM supplier LEFT JOIN nation ON n_nationkey = s_nationkey GROUP BY s_nationkey"),
    "scrub_paths": (
        lambda s, d: documents(s, d).select("doc_id", text.scrub(nested(), [("src1", "src"), ("src", "origin")]).alias("told")),
        f"WITH n AS (SELECT doc_id, {_NESTED} AS j FROM documents) SELECT doc_id, array_to_string(list_transform(regexp_extract_all(j, '{text.JSON_PARTS}'), lambda p: CASE WHEN starts_with(p, '\"') AND NOT ends_with(p, ':') THEN replace(replace(p, 'src1', 'src'), 'src', 'origin') ELSE p END), '') AS told FROM n",
    ),
    "plan_requests": (plans, _plan_sql()),
    "lookup_ids": (lambda s, d: rounded(service.lookup(labels(contrasts(s, d)), [3, 7, 19, 42, 77, 103, 10**9])), f"WITH {CONTRAST_SQL}, {LABELS_SQL} SELECT entity, module, round(strength, 6) AS strength FROM labels WHERE entity IN (3, 7, 19, 42, 77, 103, 1000000000)"),
    "module_terms_lookup": (
        lambda s, d: rounded(service.terms_per_module(tested(s, d), 5)),
        f"{family_sql(_MODULES, 'contrast')} SELECT study, rank, namespace, term, round(q, 6) AS q FROM (SELECT *, row_number() OVER (PARTITION BY study ORDER BY q, p_raw, namespace, term)::INTEGER AS rank FROM fam) WHERE rank <= 5",
    ),
    "pair_lookup": (lambda s, d: rounded(service.pair_lookup(matrix.correlations(ratio(s, d), "log2_ratio"), ["FURNITURE", "5-LOW"])), f"{_REAL} SELECT a, b, round(pearson, 6) AS pearson, round(cosine, 6) AS cosine FROM cor WHERE a = '5-LOW' AND b = 'FURNITURE'"),
    "perceptron_metrics": (perceptron, None),
}
