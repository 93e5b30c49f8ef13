"""Two systems that answer requests (fixed rules, and the planner), their evaluation, and checks of request records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kontra.operators import service

#: Requests shorter than this, blanks at the ends aside, say too little.
SHORTEST = 12
#: What ``Service.records`` runs for an intent, operation by operation.
STEPS = {
    service.LOOKUP: ["filter the labels by the entities named"],
    service.TERMS: ["number each study's tested terms by q", "keep the first five of every study"],
    service.PAIR: ["order the two names", "filter the stored correlations by that pair"],
    service.SUMMARY: ["filter the long table by the conditions named", "count its rows, and those with fdr under the threshold, by condition"],
}
#: What a plan of an intent must be read with.
WARNINGS = {
    service.SUMMARY: ["contrast_scope"],
    service.TERMS: ["term_scope"],
    service.PAIR: ["retracted_predecessor", "pair_scope"],
    service.LOOKUP: ["module_scope"],
}
#: Status of the planner -> status of a proposal.
PROPOSED = {service.READY: "accepted", service.CLARIFY: "needs_clarification", service.INCOMPATIBLE: "incompatible", service.ABSTAIN: "abstain"}
#: Claims that no answer from these tables supports.
FORBIDDEN = ["demonstrates causation", "is the cause of", "beyond doubt"]


def _lookup(names: dict, key: Column) -> Column:
    return F.element_at(F.create_map(*[x for k, v in names.items() for x in (F.lit(k), F.lit(v) if isinstance(v, str) else F.array(*[F.lit(w) for w in v]))]), key)


def findings(plans: DataFrame) -> DataFrame:
    """request_id, severity, code: the error that stops a plan, and the warnings of its intent where it is ready or its threshold is wrong."""
    error = F.when(F.col("code") != "ok", F.array(F.struct(F.lit("error").alias("severity"), F.col("code").alias("code"))))
    kept = F.col("intent").isNotNull() & F.col("code").isin("ok", "invalid_threshold")
    warned = F.when(kept, F.transform(_lookup(WARNINGS, F.col("intent")), lambda w: F.struct(F.lit("warning").alias("severity"), w.alias("code"))))
    none = F.array().cast("array<struct<severity:string,code:string>>")
    return plans.select("request_id", F.inline(F.concat(F.coalesce(error, none), F.coalesce(warned, none))))


def screen(requests: DataFrame, names: list[str]) -> DataFrame:
    """request_id, question, status: why a request is refused or sent back before any intent is looked for, else null.

    The planner's rules on its words, then the length; ids are not looked up.
    """
    q = F.lower("question")
    heads = F.array(*[F.lit(c.lower().split(" ")[0]) for c in names])
    status = F.when(F.size(F.array_except(F.regexp_extract_all(q, F.lit(service.NAMED), 0), heads)) > 0, PROPOSED[service.INCOMPATIBLE])
    for words, found, _ in service.RULES:
        status = status.when(service.matches(q, words), PROPOSED[found])
    status = status.when(service.matches(q, service.TOGETHER[:1]) & service.matches(q, service.TOGETHER[1:]), PROPOSED[service.ABSTAIN])
    status = status.when(F.length(F.trim("question")) < SHORTEST, PROPOSED[service.CLARIFY])
    return requests.select("request_id", "question", status.alias("status"))


def _explained(status: Column) -> Column:
    return F.concat(F.lit("rules gave: "), status)


def baseline(requests: DataFrame, names: list[str]) -> DataFrame:
    """Proposals by fixed rules alone: request_id, status, intent, steps, citations (none), explanation."""
    t = screen(requests, names)
    q = F.lower("question")
    intent = (
        F.when(q.rlike(service.ID), service.LOOKUP)
        .when(service.matches(q, ["terms", "ontology", "category"]), service.TERMS)
        .when(service.matches(q, ["compare", "similar", "shared"]), service.PAIR)
        .when(service.matches(q, ["detections", "differential", *[c.lower() for c in names]]), service.SUMMARY)
    )
    t = t.withColumn("found", F.when(F.col("status").isNull(), intent))
    status = F.coalesce("status", F.when(F.col("found").isNull(), PROPOSED[service.CLARIFY]), F.lit("accepted"))
    return t.select("request_id", status.alias("status"), F.coalesce("found", F.lit("unknown")).alias("intent"), F.coalesce(_lookup(STEPS, F.col("found")), F.array().cast("array<string>")).alias("steps"), F.array().cast("array<string>").alias("citations"), _explained(status).alias("explanation"))


def grounded(plans: DataFrame, evidence: DataFrame) -> DataFrame:
    """The planner's plans as proposals, with the digests of the evidence (intents, sha256) that its intent reads."""
    cited = evidence.select(F.explode("intents").alias("intent"), "sha256").groupBy("intent").agg(F.array_sort(F.collect_set("sha256")).alias("cited"))
    t = plans.join(cited, "intent", "left")
    ready, status = F.col("status") == service.READY, _lookup(PROPOSED, F.col("status"))
    none = F.array().cast("array<string>")
    return t.select(
        "request_id", status.alias("status"), F.when(ready, F.col("intent")).otherwise("unknown").alias("intent"),
        F.when(ready, _lookup(STEPS, F.col("intent"))).otherwise(none).alias("steps"), F.when(ready, F.coalesce("cited", none)).otherwise(none).alias("citations"), _explained(status).alias("explanation"),
    )


def evaluate(proposals: DataFrame, expected: DataFrame) -> DataFrame:
    """Per system: rates of right status and intent, of no forbidden claim and valid steps; of the accepted those with citations and right ones.

    proposals: system and the columns of a proposal.  expected: request_id, expected_status,
    expected_intent (null: unknown).  Rates are rounded half-even to four digits.
    """
    t = proposals.join(expected, "request_id")
    ok = F.col("status") == "accepted"
    claim = F.lower("explanation").rlike("|".join(FORBIDDEN))
    cited = F.size("citations") > 0
    right = cited & F.forall("citations", lambda c: F.length(c) == 64)
    share = lambda c: F.bround(F.avg(c.cast("int").cast("double")), 4)
    of_accepted = lambda c: F.bround(F.count_if(ok & c) / F.greatest(F.count_if(ok), F.lit(1)), 4)
    return t.groupBy("system").agg(
        F.count(F.lit(1)).alias("cases"),
        share(F.col("status") == F.col("expected_status")).alias("status_rate"),
        share(F.col("intent") == F.coalesce("expected_intent", F.lit("unknown"))).alias("intent_rate"),
        share(~claim).alias("no_forbidden_claim"),
        share((F.size("steps") > 0) == ok).alias("workflow_validity"),
        of_accepted(cited).alias("groundedness"),
        of_accepted(right).alias("citation_correctness"),
    )


def record_faults(records: DataFrame, required: list[str], text: str = "text") -> DataFrame:
    """fault, n: records that lack a required value, whose fingerprint is not that of their text, and fingerprints that occur twice."""
    own = F.sha2(F.lower(F.trim(F.coalesce(F.col(text), F.lit("")))), 256)
    lacks = F.lit(False)
    for c in required:
        lacks = lacks | F.col(c).isNull()
    t = records.select(lacks.alias("lacks"), (~F.col("fingerprint").eqNullSafe(own)).alias("wrong"), F.coalesce("fingerprint", F.lit("")).alias("fingerprint"))
    per = t.groupBy("fingerprint").agg(F.count(F.lit(1)).alias("n"), F.count_if("lacks").alias("lacks"), F.count_if("wrong").alias("wrong"))
    s = per.agg(F.coalesce(F.sum("lacks"), F.lit(0)).alias("a"), F.coalesce(F.sum("wrong"), F.lit(0)).alias("b"), F.count_if(F.expr("n > 1")).alias("c"))
    return s.select(F.inline(F.array(*[F.struct(F.lit(n).alias("fault"), F.col(c).alias("n")) for n, c in (("missing value", "a"), ("wrong fingerprint", "b"), ("repeated fingerprint", "c"))])))


def require_valid(records: DataFrame, required: list[str], text: str = "text") -> DataFrame:
    """The records, refused if any has a fault."""
    bad = {r["fault"]: r["n"] for r in record_faults(records, required, text).collect() if r["n"]}
    if bad:
        raise ValueError(f"records fail their checks: {bad}")
    return records


def require_separate(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The rows (with ``split``), refused if a value of one of the keys is in more than one split."""
    for key in keys:
        if not rows.groupBy(key).agg(F.count_distinct("split").alias("n")).where("n > 1").isEmpty():
            raise ValueError(f"{key} is shared by splits")
    return rows


def require_groups(groups: DataFrame, strata: list[str], share: float = 0.15) -> DataFrame:
    """The groups, refused if a stratum is too small for three splits."""
    part = F.greatest(F.lit(1), F.bround(F.count(F.lit(1)) * F.lit(share)))
    if not groups.groupBy(*strata).agg(F.count(F.lit(1)).alias("n"), part.alias("part")).where("2 * part >= n").isEmpty():
        raise ValueError("a stratum has too few groups for three splits")
    return groups
