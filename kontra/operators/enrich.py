"""Ontology enrichment: closure, propagation, one declared family of tests, and its reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kontra.functions.stats import benjamini_hochberg, fisher


def closure(edges: DataFrame, limit: int = 20) -> DataFrame:
    """child, ancestor, depth (longest path) of an acyclic graph, itself not included.

    Paths are doubled in each round, so a hierarchy of depth n takes about log2 n rounds
    of joins on the terms, which are few beside the entities.
    """
    found = edges.select("child", F.col("parent").alias("ancestor"), F.lit(1).alias("depth")).distinct()
    n = -1
    for _ in range(limit):
        a, b = found.alias("a"), found.alias("b")
        step = a.join(b, F.col("a.ancestor") == F.col("b.child")).select(F.col("a.child"), F.col("b.ancestor"), (F.col("a.depth") + F.col("b.depth")).alias("depth"))
        before, found = found, found.unionByName(step).groupBy("child", "ancestor").agg(F.max("depth").alias("depth")).persist()
        now = found.agg(F.count(F.lit(1)), F.sum("depth")).first()
        before.unpersist()
        if now == n:
            return found
        n = now
    raise ValueError("the hierarchy has a cycle or is too deep")


def propagated(assoc: DataFrame, closed: DataFrame) -> DataFrame:
    """namespace, entity, term with every ancestor of each associated term."""
    up = assoc.join(closed.select(F.col("child").alias("term"), "ancestor"), "term").select("namespace", "entity", F.col("ancestor").alias("term"))
    return assoc.select("namespace", "entity", "term").unionByName(up).distinct()


def background(population: DataFrame, assoc: DataFrame) -> DataFrame:
    """namespace, entity: members of the population that are mapped there."""
    return assoc.select("namespace", "entity").distinct().join(population.select("entity").distinct(), "entity", "left_semi")


def eligible(studies: DataFrame, back: DataFrame) -> DataFrame:
    """study, namespace, input and mapped entities of every study in every namespace."""
    spaces = back.select("namespace").distinct()
    size = studies.groupBy("study").agg(F.count_distinct("entity").alias("input_entities"))
    mapped = studies.select("study", "entity").distinct().join(back, "entity").groupBy("study", "namespace").agg(F.count(F.lit(1)).alias("mapped"))
    return size.crossJoin(F.broadcast(spaces)).join(mapped, ["study", "namespace"], "left").fillna(0, ["mapped"])


def skipped(studies: DataFrame, back: DataFrame, least: int = 10) -> DataFrame:
    t = eligible(studies, back).where(F.col("mapped") < least)
    return t.select("study", "namespace", "input_entities", "mapped", F.lit(f"fewer than {least} mapped entities").alias("reason"))


def family(studies: DataFrame, population: DataFrame, full: DataFrame, least: int = 10) -> DataFrame:
    """study x namespace x term: counts, two-sided Fisher p, direction and BH over the whole family.

    Terms tested are all that occur in the background.  ``e``: the study's share is above
    the population's, else ``p``.
    """
    back = background(population, full)
    terms = full.join(back, ["namespace", "entity"], "left_semi")
    pop = terms.groupBy("namespace", "term").agg(F.count(F.lit(1)).alias("pop_count"))
    pop_n = back.groupBy("namespace").agg(F.count(F.lit(1)).alias("pop_n"))
    big = eligible(studies, back).where(F.col("mapped") >= least).select("study", "namespace", F.col("mapped").alias("study_n"))
    hits = studies.select("study", "entity").distinct().join(terms, "entity").groupBy("study", "namespace", "term").agg(F.count(F.lit(1)).alias("study_count"))
    t = big.join(pop, "namespace").join(pop_n, "namespace").join(hits, ["study", "namespace", "term"], "left").fillna(0, ["study_count"])
    return _judged(t, ["study", "namespace", "term"])


def _judged(t: DataFrame, key: list[str]) -> DataFrame:
    k, n, K, M = (F.col(c) for c in ("study_count", "study_n", "pop_count", "pop_n"))
    t = t.withColumn("p_raw", fisher(k, n, K, M)).withColumn("enrichment", F.when(k * M > K * n, "e").otherwise("p"))
    return benjamini_hochberg(t, "p_raw", key)


def family_within(studies: DataFrame, population: DataFrame, full: DataFrame, least: int = 10) -> DataFrame:
    """As ``family``, but each study (study, stratum, entity) has the background of its stratum (stratum, entity)."""
    back = full.select("namespace", "entity").distinct().join(population.select("stratum", "entity").distinct(), "entity")
    terms = full.join(back, ["namespace", "entity"])
    at = ["stratum", "namespace"]
    pop = terms.groupBy(*at, "term").agg(F.count(F.lit(1)).alias("pop_count"))
    pop_n = back.groupBy(*at).agg(F.count(F.lit(1)).alias("pop_n"))
    own = studies.select("study", "stratum", "entity").distinct()
    big = own.join(back, ["stratum", "entity"]).groupBy("study", *at).agg(F.count(F.lit(1)).alias("study_n")).where(F.col("study_n") >= least)
    hits = own.join(terms, ["stratum", "entity"]).groupBy("study", *at, "term").agg(F.count(F.lit(1)).alias("study_count"))
    t = big.join(pop, at).join(pop_n, at).join(hits, ["study", *at, "term"], "left").fillna(0, ["study_count"])
    return _judged(t, ["study", "namespace", "term"])


def study_counts(shown: DataFrame, studies: DataFrame) -> DataFrame:
    """condition, module, terms of every study named condition|Mk, 0 for those that show none."""
    n = shown.groupBy("study").agg(F.count(F.lit(1)).alias("terms"))
    t = studies.select("study").distinct().join(n, "study", "left").fillna(0, ["terms"])
    part = F.split("study", r"\|")
    return t.select(part[0].alias("condition"), F.substring(part[1], 2, 9).cast("int").alias("module"), "terms")


def containing(rows: DataFrame, column: str, phrase: str) -> DataFrame:
    """Rows whose text contains the phrase in any case; null contains nothing."""
    return rows.where(F.coalesce(F.lower(column).contains(phrase.lower()), F.lit(False)))


def side_by_side(single: DataFrame, consensus: DataFrame, tested_single: DataFrame, tested_consensus: DataFrame, cap: int) -> DataFrame:
    """Per module of the consensus: its entities and best specific term in either labeling (entity, module; studies Mk)."""

    def side(labels: DataFrame, tested: DataFrame, name: str) -> DataFrame:
        size = labels.groupBy("module").agg(F.count(F.lit(1)).alias(f"n_{name}"))
        best = best_specific(tested, cap).select(F.substring("study", 2, 9).cast("int").alias("module"), F.col("term").alias(f"top_{name}"))
        return size.join(best, "module", "left").fillna("no specific term", [f"top_{name}"])

    t = side(consensus, tested_consensus, "consensus").join(side(single, tested_single, "single"), "module", "left")
    return t.fillna(0, ["n_single"]).fillna("no specific term", ["top_single"])


def top_terms(tested: DataFrame, by: list[str], n: int, q: float = 0.05) -> DataFrame:
    """Per group the n enriched terms of least p with q below the threshold."""
    t = tested.where((F.col("enrichment") == "e") & (F.col("q") < q))
    order = Window.partitionBy(*by).orderBy("p_raw", "namespace", "term")
    return t.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)


def best_specific(tested: DataFrame, cap: int) -> DataFrame:
    """Per study the term of least q that is not generic (population count up to the cap), or a note."""
    order = Window.partitionBy("study").orderBy("q", "p_raw", "namespace", "term")
    t = tested.where(F.col("pop_count") <= cap).withColumn("rn", F.row_number().over(order)).where("rn = 1")
    return tested.select("study").distinct().join(t.select("study", "term", "study_count", "q"), "study", "left").fillna("no specific term", ["term"])


def study_flows(tested: DataFrame) -> DataFrame:
    """source, target, value: each study's term of least q with the study's entities there, one at least."""
    best = F.min_by(F.struct("term", "study_count"), F.struct("q", "p_raw", "namespace", "term"))
    t = tested.groupBy("study").agg(best.alias("b"))
    return t.select(F.col("study").alias("source"), F.col("b.term").alias("target"), F.greatest(F.col("b.study_count"), F.lit(1)).cast("bigint").alias("value"))


def nearest_ancestors(selected: DataFrame, closed: DataFrame, depths: DataFrame) -> DataFrame:
    """child, parent: of a selected term's selected ancestors the deepest (ties to the greatest name)."""
    s = selected.select("term").distinct()
    t = closed.join(s.withColumnRenamed("term", "child"), "child").join(s.withColumnRenamed("term", "ancestor"), "ancestor")
    t = t.join(depths.withColumnRenamed("term", "ancestor").withColumnRenamed("depth", "level"), "ancestor")
    return t.groupBy("child").agg(F.max_by("ancestor", F.struct("level", "ancestor")).alias("parent"))


def depths(edges: DataFrame, closed: DataFrame) -> DataFrame:
    """term, depth: longest way down from a root (0)."""
    every = edges.select(F.col("child").alias("term")).union(edges.select("parent")).distinct()
    return every.join(closed.groupBy(F.col("child").alias("term")).agg(F.max("depth").alias("depth")), "term", "left").fillna(0, ["depth"])


def count_grid(top: DataFrame, studies: list[str], namespaces: DataFrame) -> DataFrame:
    """Terms shown for each study and namespace, zero filled."""
    n = top.groupBy("study", "namespace").agg(F.count(F.lit(1)).alias("terms"))
    grid = namespaces.select("namespace").distinct().select("namespace", F.explode(F.array(*[F.lit(s) for s in studies])).alias("study"))
    return grid.join(n, ["study", "namespace"], "left").fillna(0, ["terms"])
