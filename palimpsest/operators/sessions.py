"""Interview turns, claim checks, expectations of a suite, partitioned output, job queues."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import rules
from ..functions.text import query_terms
from .retrieval import hybrid, hybrid_many, lexical_topk

#: Parts that the documents of a term are dealt into.
SALTS = 16


def beat(answered: Column, turns: Column, beats: int) -> Column:
    """min(floor(answered / turns * beats), beats - 1)"""
    return F.least(F.floor(answered / turns * beats), F.lit(beats - 1))


def next_turn(turns: DataFrame, session: str = "session", mode: str = "mode", beats: int = 5) -> DataFrame:
    """session, answered, remaining, beat, move: what comes next in each session; with no turn left it is wrapped up."""
    known = F.create_map(*[F.lit(x) for kv in rules.INTERVIEW_TURNS.items() for x in kv])
    counted = turns.groupBy(session).agg(F.count_if(F.col("role") == "candidate").alias("answered"), F.max(known[F.col(mode)]).alias("__turns"), F.max_by("text", "idx").alias("last"))
    left = F.greatest(F.lit(0), F.col("__turns") - F.col("answered"))
    return counted.select(session, "answered", left.alias("remaining"), beat(F.col("answered"), F.col("__turns"), beats).alias("beat"), F.when(left == 0, "wrap").otherwise("ask").alias("move"), F.left("last", F.lit(400)).alias("query"))


def check_claims(docs: DataFrame, keywords: list[str], k: int = 14, vectors: DataFrame | None = None, vector: list[float] | None = None) -> DataFrame:
    """The k documents that bear most on a claim's keywords, by words and, with vectors (vec_id, embedding) and the claim's own, by hybrid retrieval; none is no evidence."""
    query = " ".join(keywords)[:400]
    return lexical_topk(docs, query, k) if vectors is None else hybrid(docs, vectors, query, vector, k)


def suite_results(found: DataFrame, expected: DataFrame) -> DataFrame:
    """repo, passed: expected (repo, min_files, languages, redaction) against found (repo, files, languages, findings); a repo
    that was not found fails."""
    met = (F.col("files") >= F.col("min_files")) & (F.size(F.array_except(F.col("e.languages"), F.col("f.languages"))) == 0) & (~F.col("redaction") | (F.col("findings") > 0))
    return expected.alias("e").join(found.alias("f"), "repo", "left").select("repo", F.coalesce(met, F.lit(False)).alias("passed"))


def first_readme(files: DataFrame) -> DataFrame:
    """readme: the first readme.* in path order, at any depth."""
    named = files.where(F.lower(F.element_at(F.split("path", "/"), -1)).rlike(r"^readme(\..*)?$"))
    return named.agg(F.min_by("content", "path").alias("readme"))


def write_snapshot(df: DataFrame, path: str, snapshot: str = "snapshot") -> None:
    """Append rows under their snapshot's folder; a reader that asks for one snapshot reads one folder."""
    df.write.mode("append").partitionBy(snapshot).parquet(path)


def take_jobs(jobs: DataFrame, now: Column, retry_s: int = 30, expiry_min: int = 45) -> DataFrame:
    """One row for each job key that may run: never tried, or its one retry is due, or its run expired."""
    newest = jobs.groupBy("job_id").agg(F.max_by(F.struct("state", "tries", "at"), "at").alias("j")).select("job_id", "j.*")
    age = F.unix_micros(now.cast("timestamp")) - F.unix_micros(F.col("at").cast("timestamp"))
    ready = (F.col("state") == "queued") | ((F.col("state") == "failed") & (F.col("tries") < 2) & (age >= retry_s * 1_000_000)) | ((F.col("state") == "active") & (age >= expiry_min * 60_000_000))
    return newest.where(ready)


def turn_context(turns: DataFrame, docs: DataFrame, k: int = 6, session: str = "session", index=None, vectors: DataFrame | None = None) -> DataFrame:
    """session, doc_id, hits: for each next turn (session, move, query), the k documents that hold most of its query's terms
    as words; a session that is wrapped up has none.

    With a vector index of the documents and the sessions' vectors (session, embedding), k by hybrid retrieval instead: session, doc_id, score, rank. Words: a term that a session
    asks for meets the documents that hold it in salted parts, so that a common one is many tasks' work, and sums are by session and document.
    """
    wanted = turns.where("move != 'wrap'")
    if index is not None:
        asked = wanted.select(session, F.col("query").alias("text")).join(vectors, session)
        return hybrid_many(docs, index, asked, k, session)
    terms = wanted.select(session, F.explode(F.array_distinct(query_terms(F.col("query")))).alias("term"))
    held = docs.select("doc_id", F.explode(F.array_distinct(query_terms(F.col("text"), 1 << 30))).alias("term"))
    asked = held.join(terms.select("term").distinct(), "term", "left_semi").withColumn("__salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)))
    salted = terms.withColumn("__salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    hits = salted.join(asked, ["term", "__salt"]).groupBy(session, "doc_id").agg(F.count("*").alias("hits"))
    return first_per(hits, [session], [F.desc("hits"), F.col("doc_id")], k)


def first_per(df: DataFrame, keys: list[str], order: list[Column], k: int) -> DataFrame:
    return df.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("__n") <= k).drop("__n")
