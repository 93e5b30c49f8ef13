"""Text and dataset layer: chunks, tokens, lexical retrieval, vectors, splits, guards, metrics."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kontra.functions.stats import keyed

# fixed value: what a token is
TOKEN = "[a-z0-9][a-z0-9_-]+"
# fixed values: words that are not indexed
STOP = ["the", "and", "for", "with", "from", "that", "this", "into", "are", "was", "what"]


# fixed values: where a section begins, a chunk's characters, and how many chunks of which score are retrieved
HEADING, SIZE, BEST, LEAST = r"^#{1,6}\s+", 1800, 4, 0.08


def stripped(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def spread(rows: DataFrame) -> DataFrame:
    """The rows, dealt over the executors if their files give fewer tasks than there are cores, as one row group of texts does."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(2 * cores) if rows.rdd.getNumPartitions() < cores else rows


def chunks(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = SIZE) -> DataFrame:
    """Sections before headings, cut into slices: chunk_id (document:section:part), heading, text, source digest.

    Sections count from 0 with the piece before the first heading, also where it is empty.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    t = spread(docs.select(doc_id, text)).select(F.col(doc_id).alias("doc_id"), body.alias("t"), F.posexplode(F.split(body, f"(?m)(?={HEADING})")).alias("pos", "raw"))
    t = t.withColumn("section", F.col("pos") + F.col("t").rlike(HEADING).cast("int")).withColumn("s", stripped(F.col("raw"))).where("s != ''")
    first = F.split("s", "\n", 2)[0]
    heading = stripped(F.regexp_replace(first, HEADING, ""))
    t = t.select("doc_id", "section", "s", F.when(heading == "", "Introduction").otherwise(heading).alias("heading"), F.sha2("t", 256).alias("source_sha256"), F.posexplode(F.sequence(F.lit(1), F.length("s"), F.lit(size))).alias("part", "at"))
    t = t.withColumn("text", stripped(F.substring(F.col("s"), F.col("at"), F.lit(size)))).where("text != ''")
    return t.select("doc_id", F.concat_ws(":", "doc_id", "section", "part").alias("chunk_id"), "heading", "text", "source_sha256")


def token_set(c: Column) -> Column:
    return F.array_except(F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit(TOKEN), 0)), F.array(*[F.lit(w) for w in STOP]))


def chunk_tokens() -> Column:
    """The tokens of a chunk are those of its heading and its text."""
    return token_set(F.concat_ws(" ", "heading", "text"))


def document_frequency(chunked: DataFrame) -> DataFrame:
    return chunked.select(F.explode(chunk_tokens()).alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("df"))


def retrieve(queries: DataFrame, chunked: DataFrame, k: int = BEST, least: float = LEAST, limit: int = 32 << 20) -> DataFrame:
    """The k best chunks of every query: (query_id, chunk_id, score, rank), all queries in one job.

    score = sum over common tokens of (ln((N + 1) / (df + 1)) + 1) / sqrt(|q| |d|).  Where
    the queries' tokens fit ``limit`` bytes, by count, they go to the executors: the
    patterns run once, a chunk keeps its number of tokens and those that some query has,
    and each task scores its chunks and keeps its k best of every query, so that no pair
    of chunk and query is shuffled but those.  More queries meet the chunks in a join.
    """
    q = queries.select("query_id", token_set(F.col("text")).alias("ts")).withColumn("qn", F.greatest(F.size("ts"), F.lit(1)))
    want = q.select("query_id", "qn", F.explode("ts").alias("token"))
    d = chunked.select("chunk_id", chunk_tokens().alias("ts")).withColumn("dn", F.greatest(F.size("ts"), F.lit(1)))
    if want.agg(F.coalesce(F.sum(F.length("token") + 128), F.lit(0))).first()[0] <= limit:
        s = _best_of_tasks(d, want.toArrow(), queries.schema["query_id"].dataType.simpleString(), k, least)
    else:
        s = _joined(d, want, least)
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "chunk_id")
    return s.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _joined(d: DataFrame, want: DataFrame, least: float) -> DataFrame:
    """(query_id, chunk_id, qn, dn, score) of every pair that shares a token."""
    total = d.agg(F.count(F.lit(1)).alias("total"))
    have = d.select("chunk_id", "dn", F.explode("ts").alias("token")).join(want.select("token").distinct(), "token", "left_semi")
    df = have.groupBy("token").agg(F.count(F.lit(1)).alias("df"))
    weights = want.join(df, "token").crossJoin(F.broadcast(total)).select("query_id", "qn", "token", (F.log((F.col("total") + 1) / (F.col("df") + 1)) + 1).alias("idf"))
    s = have.join(weights, "token").groupBy("query_id", "chunk_id", "qn", "dn").agg(F.sum("idf").alias("s"))
    return s.select("query_id", "chunk_id", F.round(F.col("s") / F.sqrt(F.col("qn") * F.col("dn")), 9).alias("score")).where(F.col("score") >= least)


def _best_of_tasks(d: DataFrame, want: pa.Table, kind: str, k: int, least: float) -> DataFrame:
    """(query_id, chunk_id, score): of each task its k best chunks of every query."""
    context = d.sparkSession.sparkContext
    ids = list(dict.fromkeys(want["query_id"].to_pylist()))
    place = {q: i for i, q in enumerate(ids)}
    size = np.ones(len(ids))
    for q, n in zip(want["query_id"].to_pylist(), want["qn"].to_pylist(), strict=True):
        size[place[q]] = n
    tokens = {t: i for i, t in enumerate(sorted(set(want["token"].to_pylist())))}
    token, query = np.array([tokens[t] for t in want["token"].to_pylist()], dtype=np.int64), np.array([place[q] for q in want["query_id"].to_pylist()], dtype=np.int64)
    by = np.argsort(token, kind="stable")
    of, first = query[by], np.searchsorted(token[by], np.arange(len(tokens) + 1))
    known = context.broadcast(tokens)

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = known.value.get
        for batch in batches:
            hits = [[i for i in map(at, ts) if i is not None] for ts in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(hits, pa.list_(pa.int32()))], names=["chunk_id", "dn", "hits"])

    hits = d.select("chunk_id", "dn", "ts").mapInArrow(number, "chunk_id string, dn int, hits array<int>").persist()
    total = hits.count()
    df = np.zeros(len(tokens))
    for r in hits.select(F.explode("hits").alias("t")).groupBy("t").agg(F.count(F.lit(1)).alias("n")).collect():
        df[r["t"]] = r["n"]
    idf = np.log((total + 1) / (df + 1)) + 1
    sent = context.broadcast((ids, of, first, idf, size))

    def best_of(query: np.ndarray, score: np.ndarray, chunk: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        order = np.lexsort((chunk, -score, query))
        order = order[np.arange(len(order)) - np.searchsorted(query[order], query[order]) < k]
        return query[order], score[order], chunk[order]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, of, first, idf, size = sent.value
        best = (np.zeros(0, dtype=np.int64), np.zeros(0), np.zeros(0, dtype="U1"))
        at_once = max(1, (1 << 22) // max(1, len(ids)))
        for batch in batches:
            for lo in range(0, batch.num_rows, at_once):
                part = batch.slice(lo, at_once)
                dn, lists = np.asarray(part.column(1)), part.column(2)
                t, n = np.asarray(lists.flatten()), np.asarray(lists.value_lengths())
                rows = np.repeat(np.arange(len(dn)), n)
                # every query that has the token
                many = first[t + 1] - first[t]
                pick = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + np.repeat(first[t], many)
                cell = np.repeat(rows, many) * len(ids) + of[pick]
                sums = np.bincount(cell, weights=np.repeat(idf[t], many), minlength=len(dn) * len(ids)).reshape(len(dn), len(ids)) if len(ids) else np.zeros((len(dn), 0))
                score = np.round(sums / np.sqrt(dn[:, None] * size), 9)
                r, query = np.nonzero((sums > 0) & (score >= least))
                chunk = np.array(part.column(0).to_pylist())[r] if len(r) else best[2][:0]
                best = best_of(*(np.concatenate(x) for x in zip(best, (query, score[r, query], chunk), strict=True)))
        query, score, chunk = best
        if len(query):
            yield pa.RecordBatch.from_arrays([pa.array([ids[i] for i in query.tolist()], like), pa.array(chunk.tolist(), pa.string()), pa.array(score)], names=["query_id", "chunk_id", "score"])

    like = want.schema.field("query_id").type
    return hits.mapInArrow(run, f"query_id {kind}, chunk_id string, score double")


def words(c: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit("[a-z0-9]+"), 0)


def vocabulary(docs: DataFrame, text: str = "text", least: int = 1) -> DataFrame:
    """token, n, index: the index counts all tokens in order, before rare ones are left out.

    The index is a token's number within its first two characters plus the count of the
    tokens before these, so that no task sorts the whole vocabulary.
    """
    n = docs.select(F.explode(words(F.col(text))).alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    n = n.withColumn("_p", F.substring("token", 1, 2))
    before = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    start = n.groupBy("_p").agg(F.count(F.lit(1)).alias("_c")).select("_p", F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_s"))
    n = n.join(F.broadcast(start), "_p").withColumn("index", F.col("_s") + F.row_number().over(Window.partitionBy("_p").orderBy("token")) - 1)
    return n.where(F.col("n") >= least).select("token", "n", "index")


def vectors(docs: DataFrame, vocab: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, index, value: counts over the vocabulary with unit length; documents without known words have no rows."""
    c = docs.select(doc_id, F.explode(words(F.col(text))).alias("token")).groupBy(doc_id, "token").agg(F.count(F.lit(1)).alias("c"))
    c = c.join(vocab.select("token", "index"), "token")
    norm = F.sqrt(F.sum(F.col("c") * F.col("c")).over(Window.partitionBy(doc_id)))
    return c.select(doc_id, "index", (F.col("c") / norm).alias("value"))


def group_split(groups: DataFrame, strata: list[str], group: str, share: float = 0.15, seed: int = 2026) -> DataFrame:
    """Adds ``split`` to one row per group: within a stratum, groups in md5 order, validation and test first."""
    order = Window.partitionBy(*strata).orderBy(keyed(F.lit(seed), F.col(group)), group)
    n = F.count(F.lit(1)).over(Window.partitionBy(*strata))
    t = groups.withColumn("_r", F.row_number().over(order)).withColumn("_n", F.greatest(F.lit(1), F.bround(n * F.lit(share)).cast("int")))
    return t.withColumn("split", F.when(F.col("_r") <= F.col("_n"), "validation").when(F.col("_r") <= 2 * F.col("_n"), "test").otherwise("train")).drop("_r", "_n")


def leakage(rows: DataFrame, key: str) -> DataFrame:
    """Keys that occur in more than one split, counted by the splits they join."""
    t = rows.select(key, "split").distinct().groupBy(key).agg(F.array_join(F.array_sort(F.collect_set("split")), "+").alias("splits"), F.count(F.lit(1)).alias("n")).where("n > 1")
    return t.groupBy("splits").agg(F.count(F.lit(1)).alias("keys"))


def normalized(c: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(c, r"[ \t\n\r\f\x0B]+", " ")))


def last_wins(rows: DataFrame, text: str, order: str) -> DataFrame:
    """One row per fingerprint (digest of the trimmed, lower-cased text): the last in order."""
    return rows.groupBy(F.sha2(F.lower(F.trim(F.col(text))), 256).alias("fingerprint")).agg(F.max(order).alias(order), F.count(F.lit(1)).alias("copies"))


def confusion(rows: DataFrame, classes: list[int]) -> DataFrame:
    """true, pred, n of all pairs of classes, absent ones 0."""
    n = rows.groupBy("true", "pred").agg(F.count(F.lit(1)).alias("n"))
    grid = rows.sparkSession.createDataFrame([(a, b) for a in classes for b in classes], "true int, pred int")
    return grid.join(n, ["true", "pred"], "left").fillna(0, ["n"])


def class_metrics(cells: DataFrame) -> DataFrame:
    """Per class precision, recall, F1 (0 where undefined) and support, with accuracy and macro F1 on every row."""
    hit = F.when(F.col("true") == F.col("pred"), F.col("n")).otherwise(0)
    t = cells.groupBy(F.col("true").alias("label")).agg(F.sum("n").alias("support"), F.sum(hit).alias("tp"))
    p = cells.groupBy(F.col("pred").alias("label")).agg(F.sum("n").alias("predicted"))
    zero = lambda a, b: F.coalesce(F.try_divide(a, F.nullif(b, F.lit(0))), F.lit(0.0))
    m = t.join(p, "label").withColumn("precision", zero(F.col("tp"), F.col("predicted"))).withColumn("recall", zero(F.col("tp"), F.col("support")))
    m = m.withColumn("f1", F.coalesce(F.try_divide(2 * F.col("precision") * F.col("recall"), F.nullif(F.col("precision") + F.col("recall"), F.lit(0.0))), F.lit(0.0)))
    whole = Window.partitionBy(F.lit(1))
    return m.select("label", "support", "precision", "recall", "f1", zero(F.sum("tp").over(whole), F.sum("support").over(whole)).alias("accuracy"), F.avg("f1").over(whole).alias("macro_f1"))


def rates(cases: DataFrame, by: str) -> DataFrame:
    """Per system: share of right statuses and intents, and of grounded answers among those accepted."""
    share = lambda c: F.avg(F.col(c).cast("double"))
    return cases.groupBy(by).agg(F.count(F.lit(1)).alias("cases"), share("status_ok").alias("status_rate"), share("intent_ok").alias("intent_rate"), F.avg(F.when(F.col("accepted"), F.col("grounded").cast("double"))).alias("groundedness"))


def refusals(cases: DataFrame) -> DataFrame:
    """Precision and recall of refusing, and the share of exact matches."""
    refused, should = ~F.col("accepted"), ~F.col("expected")
    both = F.count_if(refused & should)
    return cases.agg(F.try_divide(both, F.nullif(F.count_if(refused), F.lit(0))).alias("precision"), F.try_divide(both, F.nullif(F.count_if(should), F.lit(0))).alias("recall"), F.avg((F.col("accepted") == F.col("expected")).cast("double")).alias("exact"))


def sparse_rows(docs: DataFrame, vocab: DataFrame, label: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """id, y, index, value: one row for each document, its counts over the vocabulary with unit length; without known words the lists are empty."""
    v = vectors(docs, vocab, doc_id, text).groupBy(doc_id).agg(F.array_sort(F.collect_list(F.struct(F.col("index").cast("int").alias("index"), "value"))).alias("v"))
    t = docs.select(F.col(doc_id), F.col(label).cast("int").alias("y")).join(v, doc_id, "left")
    part = lambda name, kind: F.coalesce(F.transform("v", lambda x: x[name]), F.array().cast(kind)).alias(name)
    return t.select(F.col(doc_id).alias("id"), "y", part("index", "array<int>"), part("value", "array<double>"))


#: The parts of a JSON text: a string (with the colon behind it, if it is a key), what stands between strings, and a quote that ends nothing.
JSON_PARTS = r'"(?:[^"\\]|\\[\s\S])*"(?:\s*:)?|[^"]+|"'


def scrub(c: Column, replacements: list[tuple[str, str]]) -> Column:
    """Ordered literal replacements in the string values of a JSON text, at any depth.

    Keys, numbers and everything else stay as they are written, and so do values in which
    nothing is found; escapes are resolved before the search.  Null stays null, and what
    is no JSON keeps its text outside of quotes.
    """

    def value(part: Column) -> Column:
        told = F.from_json(F.concat(F.lit("["), part, F.lit("]")), "array<string>")[0]
        new = told
        for old, to in replacements:
            new = F.replace(new, F.lit(old), F.lit(to))
        written = F.to_json(F.array(new))
        return F.when(new.eqNullSafe(told), part).otherwise(F.substring(written, F.lit(2), F.length(written) - 2))

    parts = F.regexp_extract_all(c, F.lit(JSON_PARTS), F.lit(0))
    return F.array_join(F.transform(parts, lambda p: F.when(p.startswith('"') & (F.length(p) > 1) & ~p.endswith(":"), value(p)).otherwise(p)), "")


def multiset_digest(rows: DataFrame, columns: list[str], by: list[str] | None = None) -> DataFrame:
    """by, rows, digest: the same for the same rows in any order and partitioning, repeats counted.

    Each row's sha256 is four numbers of 64 bits; their sums modulo 2^64 and the number of
    rows are hashed together.  Values are written with their lengths, nulls as a dash.
    """
    told = lambda c: F.coalesce(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c), F.lit("-"))
    h = F.sha2(F.concat(*[told(F.col(c).cast("string")) for c in columns]), 256)
    limbs = [F.conv(F.substring(h, 16 * i + 1, 16), 16, 10).cast("decimal(20,0)") for i in range(4)]
    t = rows.groupBy(*(by or [])).agg(F.count(F.lit(1)).alias("rows"), *[F.sum(x).alias(f"_{i}") for i, x in enumerate(limbs)])
    mod = F.lit(str(2**64)).cast("decimal(20,0)")
    sums = [F.coalesce(F.pmod(F.col(f"_{i}"), mod), F.lit(0).cast("decimal(20,0)")).cast("decimal(20,0)").cast("string") for i in range(4)]
    return t.select(*(by or []), "rows", F.sha2(F.concat_ws(":", F.col("rows").cast("string"), *sums), 256).alias("digest"))
