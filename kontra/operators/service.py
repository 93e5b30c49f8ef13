"""Typed requests: plan, approve, execute; and the planner over a whole table of requests.

The rules are data.  ``plan_table`` applies them to any number of requests in one job;
``Planner`` runs a single request through the same expressions.
"""

from __future__ import annotations

import hashlib
import json
from dataclasses import asdict, dataclass, field
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kontra.operators import detect

READY, CLARIFY, INCOMPATIBLE, ABSTAIN = "ready_for_review", "needs_clarification", "incompatible", "abstained"
SUMMARY, LOOKUP, TERMS, PAIR = "summary", "id_lookup", "term_lookup", "pair_lookup"
MAX_THRESHOLD = 0.1

# fixed values: the codes and statuses below, and how a threshold is written
#: (words, status, code), first match wins; each word is matched whole
RULES: list[tuple[list[str], str, str]] = [
    (["raw price files", "clickstream", "batch correction", "survey"], INCOMPATIBLE, "missing_required_data"),
    (["tableau", "excel"], INCOMPATIBLE, "unsupported_tool"),
    (["age", "sex", "patient_id", "batch_id"], INCOMPATIBLE, "unknown_column"),
    (["prove", "causes", "causal", "guarantees"], ABSTAIN, "unsupported_claim"),
    (["retracted", "percent-per-module"], ABSTAIN, "retracted_method"),
]
#: Words that together fall under the rule of the retracted method.
TOGETHER = ["module", "correlation"]
ID = r"#(\d+)"
NAMED = r"\b\d-[a-z]+"
THRESHOLD = r"(?:fdr|alpha)\s*(?:<|=|at)?\s*(0?\.\d+)"


def matches(text: Column, words: list[str]) -> Column:
    """Whether one of the words stands in the text on its own."""
    return text.rlike("(^|[^a-z0-9_])(" + "|".join(w.replace(".", r"\.") for w in words) + ")([^a-z0-9_]|$)")


def plan_table(requests: DataFrame, names: list[str], known: DataFrame) -> DataFrame:
    """request_id, intent, conditions, ids, threshold, status, code of every request (request_id, question).

    ``known`` (entity) is joined on the ids that requests mention, never collected.
    """
    q = F.lower("question")
    found = F.array_compact(F.array(*[F.when(matches(q, [c.lower()]), F.lit(c)) for c in names]))
    heads = [c.lower().split(" ")[0] for c in names]
    threshold = F.regexp_extract(q, THRESHOLD, 1)
    t = requests.select("request_id", "question", q.alias("q"), found.alias("conditions"), F.array_distinct(F.regexp_extract_all("question", F.lit(ID), 1)).alias("ids"), F.when(threshold == "", F.lit(0.05)).otherwise(F.expr("try_cast(nullif(regexp_extract(lower(question), '" + THRESHOLD.replace("\\", "\\\\") + "', 1), '') as double)")).alias("threshold"))
    absent = t.select("request_id", F.explode("ids").alias("id")).withColumn("entity", F.expr("try_cast(id as bigint)")).join(known.select("entity").distinct(), "entity", "left_anti")
    absent = absent.select("request_id").distinct().withColumn("absent", F.lit(True))
    t = t.join(absent, "request_id", "left")
    q, n = F.col("q"), F.size("conditions")
    intent = (
        F.when(F.size("ids") > 0, LOOKUP)
        .when(matches(q, ["terms", "ontology", "category"]), TERMS)
        .when((n >= 2) & matches(q, ["compare", "similar", "shared", "pair"]), PAIR)
        .when((n > 0) | matches(q, ["detections", "differential", "summary", "response"]), SUMMARY)
    )
    unknown = F.size(F.array_except(F.regexp_extract_all("q", F.lit(NAMED), 0), F.array(*[F.lit(h) for h in heads]))) > 0
    t = t.withColumn("intent", intent)
    code = F.when(unknown, F.lit("unknown_condition"))
    for words, _, name in RULES:
        code = code.when(matches(q, words), F.lit(name))
    code = code.when(matches(q, TOGETHER[:1]) & matches(q, TOGETHER[1:]), F.lit("retracted_method"))
    code = code.when(F.col("absent"), F.lit("unknown_id")).when(F.col("intent").isNull(), F.lit("ambiguous_request"))
    code = code.when((F.col("intent") == SUMMARY) & ~((F.col("threshold") > 0) & (F.col("threshold") <= MAX_THRESHOLD)), F.lit("invalid_threshold"))
    t = t.withColumn("code", code)
    abstained = [c for _, s, c in RULES if s == ABSTAIN] + ["invalid_threshold"]
    status = F.when(F.col("code").isNull(), READY).when(F.col("code") == "ambiguous_request", CLARIFY).when(F.col("code").isin(abstained), ABSTAIN).otherwise(INCOMPATIBLE)
    return t.select("request_id", "intent", "conditions", "ids", "threshold", status.alias("status"), F.coalesce("code", F.lit("ok")).alias("code"))


def file_digest(path: Path) -> str:
    """sha256 in blocks of one MiB; of a folder that of its files' names and digests."""
    if path.is_dir():
        each = [f"{f.relative_to(path)}:{file_digest(f)}" for f in sorted(path.rglob("*")) if f.is_file()]
        return hashlib.sha256("\n".join(each).encode()).hexdigest()
    h = hashlib.sha256()
    with path.open("rb") as f:
        while block := f.read(1 << 20):
            h.update(block)
    return h.hexdigest()


@dataclass(frozen=True)
class Evidence:
    """A file below the catalog's root, and the intents that may rest on it."""

    source: str
    intents: tuple[str, ...]


class Catalog:
    """Evidence by intent; digests are taken from the files each time they are asked for."""

    def __init__(self, root: str, records: list[Evidence]):
        self.root, self.records = Path(root).resolve(), list(records)

    def path(self, source: str) -> Path:
        at = (self.root / source).resolve()
        if not at.is_relative_to(self.root):
            raise ValueError(f"{source} lies outside the catalog")
        return at

    def retrieve(self, intent: str) -> tuple[tuple[str, str], ...]:
        """(source, sha256) of the intent's evidence; a file that is not there is an error."""
        wanted = [r.source for r in self.records if intent in r.intents]
        gone = [w for w in wanted if not self.path(w).exists()]
        if gone:
            raise FileNotFoundError(f"evidence of {intent} is not there: {gone}")
        return tuple(sorted((w, file_digest(self.path(w))) for w in wanted))

    def verify(self, cited: tuple[tuple[str, str], ...]) -> None:
        for source, sha in cited:
            at = self.path(source)
            if not at.exists() or file_digest(at) != sha:
                raise ValueError(f"{source} has changed since the plan was made")


@dataclass(frozen=True)
class Plan:
    status: str
    intent: str | None
    conditions: tuple[str, ...] = ()
    ids: tuple[int, ...] = ()
    threshold: float = 0.05
    code: str = "ok"
    evidence: tuple[tuple[str, str], ...] = ()

    def __post_init__(self):
        if (self.status == READY) != (self.code == "ok") or (self.status == READY and self.intent is None):
            raise ValueError("a plan is ready exactly if it has an intent and no finding against it")

    def digest(self) -> str:
        """sha256 of the plan's canonical JSON; an approval is bound to it."""
        return hashlib.sha256(json.dumps(asdict(self), sort_keys=True, separators=(",", ":")).encode()).hexdigest()


@dataclass(frozen=True)
class Review:
    decision: str
    plan_digest: str
    reviewer: str = "reviewer"

    def __post_init__(self):
        if self.decision not in ("approved", "rejected") or len(self.plan_digest) != 64 or set(self.plan_digest) - set("0123456789abcdef"):
            raise ValueError("a review names a decision and the digest of a plan")


@dataclass
class Result:
    execution_id: str
    plan_digest: str
    records: DataFrame
    provenance: dict[str, dict] = field(default_factory=dict)


class Service:
    """Plans, checks approvals and runs the four allowed queries; every input has a digest."""

    def __init__(self, spark: SparkSession, contrast: DataFrame, labels: DataFrame, tested: DataFrame, pairs: DataFrame, names: list[str], catalog: Catalog):
        self.spark, self.names = spark, names
        self.contrast, self.labels, self.tested, self.pairs = contrast, labels, tested, pairs
        self.catalog = catalog

    def health(self) -> dict[str, int]:
        row = self.contrast.agg(F.count_distinct("condition").alias("conditions"), F.count_distinct("entity").alias("entities")).first()
        return row.asDict()

    def contract(self) -> dict[str, object]:
        """What callers may ask: intents, limits, statuses."""
        return {"intents": [SUMMARY, LOOKUP, TERMS, PAIR], "max_threshold": MAX_THRESHOLD, "statuses": [READY, CLARIFY, INCOMPATIBLE, ABSTAIN], "conditions": self.names}

    def plan(self, question: str) -> Plan:
        one = self.spark.createDataFrame([(0, question)], "request_id int, question string")
        r = plan_table(one, self.names, self.contrast).first()
        if r["status"] != READY:
            return Plan(r["status"], r["intent"], code=r["code"])
        return Plan(READY, r["intent"], tuple(r["conditions"]), tuple(int(i) for i in r["ids"]), r["threshold"], "ok", self.catalog.retrieve(r["intent"]))

    def objections(self, plan: Plan, review: Review) -> list[str]:
        """Everything that stands against running the plan, at once; nothing is run or hashed for it."""
        own = plan.digest()
        held = {
            f"its status is {plan.status}": plan.status == READY,
            f"its review says {review.decision}": review.decision == "approved",
            f"its review is of plan {review.plan_digest[:12]}, this is {own[:12]}": review.plan_digest == own,
        }
        return [reason for reason, ok in held.items() if not ok]

    def execute(self, plan: Plan, review: Review) -> Result:
        """Runs a plan against which nothing stands, on inputs that still have the digests it cites."""
        if against := self.objections(plan, review):
            raise ValueError("not run: " + "; ".join(against))
        self.catalog.verify(plan.evidence)
        used = dict(plan.evidence)
        told = hashlib.sha256()
        for part in (plan.digest(), *(x for pair in sorted(used.items()) for x in pair)):
            told.update(f"{len(part)}:{part}".encode())
        return Result(told.hexdigest()[:20], plan.digest(), self.records(plan), {source: {"sha256": sha, "roles": ["planning_evidence", "result_input"]} for source, sha in used.items()})

    def records(self, plan: Plan) -> DataFrame:
        if plan.intent == SUMMARY:
            return detect.summary(self.contrast, list(plan.conditions) or self.names, plan.threshold)
        if plan.intent == LOOKUP:
            return lookup(self.labels, list(plan.ids))
        if plan.intent == TERMS:
            return terms_per_module(self.tested, 5)
        if plan.intent == PAIR:
            return pair_lookup(self.pairs, list(plan.conditions))
        raise ValueError(f"unsupported query {plan.intent}")


def router_disclosure(spark: SparkSession, metrics: str | None = None) -> dict[str, object]:
    """What chooses the query, and what is known of a trained candidate that does not: the figures of its JSON file, if there is one."""
    told: dict[str, object] = {"router": "rules", "candidate": None, "note": "a trained candidate takes no part in decisions"}
    if metrics is not None:
        want = {"model_name": "string", "seed": "bigint", "max_steps": "bigint", "train_loss": "double", "test_loss": "double"}
        row = spark.read.option("multiLine", True).option("mode", "FAILFAST").schema(", ".join(f"{k} {v}" for k, v in want.items())).json(metrics).first()
        if row is None or any(row[k] is None for k in want):
            raise ValueError(f"a candidate's metrics name {', '.join(want)}")
        told["candidate"] = row.asDict() | {"evaluation": "losses only"}
    return told


def lookup(labels: DataFrame, ids: list[int]) -> DataFrame:
    return labels.where(F.col("entity").isin(ids))


def membership(assignment: DataFrame, strength: DataFrame, ids: list[str]) -> DataFrame:
    """Assignments (id, module) of the wanted ids, in whatever case they are written, with their strength; null where there is none."""
    return assignment.where(F.upper("id").isin([i.upper() for i in ids])).join(strength, "id", "left")


def terms_per_module(tested: DataFrame, n: int) -> DataFrame:
    order = Window.partitionBy("study").orderBy("q", "p_raw", "namespace", "term")
    return tested.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n).select("study", "rank", "namespace", "term", "q")


def pair_lookup(pairs: DataFrame, wanted: list[str]) -> DataFrame:
    """The row of an unordered pair of conditions."""
    key = lambda a, b: F.array_sort(F.array(a, b))
    return pairs.where(key(F.col("a"), F.col("b")) == F.array(*[F.lit(c) for c in sorted(wanted)])) if len(wanted) == 2 else pairs.limit(0)



def pair_label(a: Column, b: Column) -> Column:
    return F.concat_ws("-", a, b)


def labelled_pair(pairs: DataFrame, wanted: list[str]) -> DataFrame:
    """Rows whose label (pair) is that of the two names in either order; names may hold hyphens themselves."""
    if len(wanted) != 2:
        return pairs.limit(0)
    a, b = (F.lit(w) for w in wanted)
    return pairs.where(F.col("pair").isin(pair_label(a, b), pair_label(b, a)))
