"""Verification, validation, models, interview turns, jobs and outputs."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import shared, streaming
from ..functions import models, rules, text
from ..operators import evidence, ledger, reports, sessions, tables, vector_index
from ..sources import exports
from .base import read, registry

QUERIES, ORACLE_SQL, query = registry()


def _shared(spark, name: str) -> str:
    return f"{shared.fresh_dir(spark)}/{name}"


@query("""WITH c AS (SELECT conv_id, turn * 10 + 1 AS a, turn * 10 + 10 AS b, role || turn AS content FROM conversations), q AS (SELECT conv_id AS citation_id, conv_id, 5 AS a, 15 + conv_id % 3 * 10 AS b FROM (SELECT DISTINCT conv_id FROM conversations))
SELECT citation_id, min(c.a) AS start_line, arg_max(c.b, (c.a, c.b, content)) AS end_line, string_agg(content, chr(10) ORDER BY c.a, c.b, content) AS content FROM q JOIN c USING (conv_id) WHERE q.a <= c.b AND q.b >= c.a GROUP BY citation_id""")
def citation_content(spark, d):
    """JOI-4: the chunks that a citation's lines overlap, joined in order."""
    c = read(spark, d, "conversations")
    chunks = c.selectExpr("conv_id % 2 AS snapshot", "conv_id AS path", "turn * 10 + 1 AS start_line", "turn * 10 + 10 AS end_line", "role || turn AS content")
    asked = c.select("conv_id").distinct().selectExpr("conv_id AS citation_id", "conv_id % 2 AS snapshot", "conv_id AS path", "5 AS start_line", "15 + conv_id % 3 * 10 AS end_line")
    return evidence.resolve(asked, chunks)


_VERIFY_SQL = """WITH RECURSIVE met AS (SELECT DISTINCT v.vec_id AS id FROM embeddings v JOIN documents d ON d.doc_id = v.vec_id, range(1, 9) AS n(n) WHERE n <= 6 AND n * 10 + v.vec_id % 70 <= d.n_chars % 100 AND n * 10 + v.vec_id % 70 + 4 >= 1),
j AS (SELECT v.vec_id AS id, v.embedding::DOUBLE[] AS e, round(0.4 + 0.06 * (v.vec_id % 10), 2) AS g, CASE WHEN m.id IS NULL THEN 'unresolved' WHEN l.doc_id IS NULL THEN 'unchecked'
 WHEN round(0.4 + 0.06 * (v.vec_id % 10), 2) < 0.5 OR (quality <> 1 AND toxic <> 0) THEN 'unsupported' ELSE 'kept' END AS status FROM embeddings v LEFT JOIN met m ON m.id = v.vec_id LEFT JOIN labels l ON l.doc_id = v.vec_id),
s AS (SELECT *, row_number() OVER (ORDER BY g DESC, id) AS n FROM j WHERE status = 'kept'),
f(n, kept) AS (SELECT 0::BIGINT, []::STRUCT(i BIGINT, v DOUBLE[])[] UNION ALL SELECT s.n, CASE WHEN len(list_filter(f.kept, lambda k: list_dot_product(k.v, s.e) > 0.3)) > 0 THEN f.kept ELSE list_append(f.kept, {'i': s.id, 'v': s.e}) END FROM f JOIN s ON s.n = f.n + 1),
k AS (SELECT unnest(list_transform(kept, lambda k: k.i)) AS id FROM f WHERE n = (SELECT coalesce(max(n), 0) FROM s)),
o AS (SELECT j.id, CASE WHEN j.status = 'kept' AND k.id IS NULL THEN 'duplicate' ELSE j.status END AS status, g FROM j LEFT JOIN k ON k.id = j.id)"""


@query(f"{_VERIFY_SQL} SELECT status, count(*) AS n, round(avg(CASE WHEN status IN ('unresolved', 'unchecked') THEN NULL ELSE g END), 6) AS grounded FROM o GROUP BY status")
def verify_chain(spark, d):
    """PIP-10, JOI-5, FLT-11, PIP-6: citations, verdicts and near duplicates in a row, with what each drops. Vector n is question n, document n its file."""
    items = read(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    cited = items.select("id", F.explode(F.sequence(F.lit(1), F.lit(8))).alias("n")).selectExpr("id", "n", "id AS path", "n * 10 + id % 70 AS start_line", "n * 10 + id % 70 + 4 AS end_line")
    chunks = read(spark, d, "documents").selectExpr("doc_id AS path", "1 AS start_line", "n_chars % 100 AS end_line")
    verdicts = read(spark, d, "labels").select(F.col("doc_id").alias("id"), F.round(0.4 + 0.06 * (F.col("doc_id") % 10), 2).alias("grounded"), (F.col("quality") == 1).alias("supported"), F.when(F.col("toxic") == 0, F.lit("c")).alias("corrected"))
    found = evidence.verify(items, cited, chunks, verdicts, 0.3)
    return found.groupBy("status").agg(F.count("*").alias("n"), F.round(F.avg(F.when(~F.col("status").isin("unresolved", "unchecked"), F.col("grounded"))), 6).alias("grounded"))


@query("SELECT l_orderkey % 100 AS path, max(l_linenumber * 3 + l_orderkey % 7) AS last FROM lineitem GROUP BY 1")
def last_cited_lines(spark, d):
    """AGG-12."""
    return evidence.last_cited_lines(read(spark, d, "lineitem").selectExpr("l_orderkey % 100 AS path", "l_linenumber * 3 + l_orderkey % 7 AS end_line"))


@query("""WITH e AS (SELECT event_id, event_type, event_id % 120 / 100.0 AS g, event_id % 7 AS probes, event_id % 4 AS cited FROM events)
SELECT event_id, CASE WHEN event_id % 17 = 3 THEN 'unreadable' ELSE concat_ws(',', CASE WHEN event_type = 'signup' THEN 'category' END, CASE WHEN g > 1 THEN 'groundedness' END, CASE WHEN probes > 5 THEN 'probes' END, CASE WHEN cited = 0 THEN 'citations' END) END AS errors FROM e""")
def schema_quarantine(spark, d):
    """FLT-13, JSN-1: enum, range and array bounds of a model's answers; rows that break them are quarantined with the reasons."""
    e = read(spark, d, "events").withColumn("answer", F.expr("""CASE WHEN event_id % 17 = 3 THEN '{"category": ' ELSE to_json(named_struct('category', event_type, 'groundedness', event_id % 120 / 100.0, 'probes', slice(array('a', 'b', 'c', 'd', 'e', 'f'), 1, int(event_id % 7)), 'citations', slice(array(1, 2, 3), 1, int(event_id % 4)))) END"""))
    holds = {
        "category": F.col("parsed.category").isin("view", "purchase", "click", "error"), "groundedness": F.col("parsed.groundedness").between(0, 1), "probes": F.size("parsed.probes") <= 5, "citations": F.size("parsed.citations") >= 1,
    }
    good, bad = tables.validate(e, "answer", "category string, groundedness double, probes array<string>, citations array<int>", holds)
    return good.select("event_id", F.lit("").alias("errors")).unionByName(bad.select("event_id", F.array_join("errors", ",").alias("errors")))


@query("""WITH u AS (SELECT user_id, ['deep', 'usual', 'quick', 'none'][event_id % 4 + 1] AS tier, CAST(floor(value * 100) AS BIGINT) + 1000 AS tokens_in, CAST(floor(value * 10) AS BIGINT) AS tokens_out, CAST(floor(value * 30) AS BIGINT) AS cached FROM events),
m AS (SELECT u.*, CASE tier WHEN 'deep' THEN 'large-2' WHEN 'usual' THEN 'custom-7' WHEN 'quick' THEN 'free-1' END AS model FROM u),
p AS (SELECT *, CASE model WHEN 'large-2' THEN (greatest(0, tokens_in - cached) * 500.0::DOUBLE + cached * 50.0::DOUBLE + tokens_out * 2500.0::DOUBLE) / 1e6 WHEN 'free-1' THEN 0.0::DOUBLE END AS cents FROM m)
SELECT coalesce(model, '-') AS model, count(*) AS calls, round(sum(cents), 6) AS cents FROM p GROUP BY 1""")
def model_costs(spark, d):
    """SRC-9, UDF-6, MTH-8: tier to model, one tier's model overridden, rates by model; models without rates cost null, not zero."""
    tier = F.element_at(F.array(*map(F.lit, ("deep", "usual", "quick", "none"))), (F.col("event_id") % 4 + 1).cast("int"))
    usage = read(spark, d, "events").select(tier.alias("tier"), (F.floor(F.col("value") * 100) + 1000).alias("tokens_in"), F.floor(F.col("value") * 10).alias("tokens_out"), F.floor(F.col("value") * 30).alias("cached"))
    specs = spark.createDataFrame([("deep", "large-2"), ("usual", "medium-2"), ("quick", "free-1")], "tier string, model string")
    rates = spark.createDataFrame([("large-2", 500.0, 2500.0, 50.0), ("medium-2", 300.0, 1500.0, 30.0), ("free-1", 0.0, 0.0, 0.0), ("other-1", None, None, None)], "model string, rate_in double, rate_out double, rate_cached double")
    priced = ledger.priced_by_model(ledger.with_model(usage, specs, spark.createDataFrame([("usual", "custom-7")], "tier string, model string")), rates)
    return priced.groupBy(F.coalesce("model", F.lit("-")).alias("model")).agg(F.count("*").alias("calls"), F.round(F.sum("cents"), 6).alias("cents"))


@query("""WITH c AS (SELECT conv_id, count(*) FILTER (WHERE role = 'user') AS answered, arg_max(text, turn) AS last, CASE conv_id % 3 WHEN 0 THEN 6 WHEN 1 THEN 14 ELSE 24 END AS turns FROM conversations GROUP BY conv_id),
q AS (SELECT conv_id, unnest(list_distinct(list_transform(regexp_extract_all(left(last, 400), '[A-Za-z_][A-Za-z0-9_]{2,}')[1:12], lambda w: lower(w)))) AS term FROM c WHERE answered < turns),
w AS (SELECT item_id AS doc_id, unnest(list_distinct(list_transform(regexp_extract_all(text, '[A-Za-z_][A-Za-z0-9_]{2,}'), lambda w: lower(w)))) AS term FROM benchmark)
SELECT conv_id AS session, doc_id, count(*) AS hits FROM q JOIN w USING (term) GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY session ORDER BY hits DESC, doc_id) <= 6""")
def interview_context(spark, d):
    """PIP-12, AGG-20, MTH-11: the next turn of each conversation and six passages for it; none where no turn is left."""
    mode = F.element_at(F.array(*map(F.lit, ("quick", "standard", "deep"))), (F.col("conv_id") % 3 + 1).cast("int"))
    c = read(spark, d, "conversations").select(F.col("conv_id").alias("session"), mode.alias("mode"), F.when(F.col("role") == "user", "candidate").otherwise("interviewer").alias("role"), F.col("turn").alias("idx"), "text")
    return sessions.turn_context(sessions.next_turn(c), read(spark, d, "benchmark").select(F.col("item_id").alias("doc_id"), "text"))


@query("""WITH c AS (SELECT conv_id, count(*) FILTER (WHERE role = 'user') AS answered, arg_max(text, turn) AS last, CASE conv_id % 3 WHEN 0 THEN 6 WHEN 1 THEN 14 ELSE 24 END AS turns FROM conversations GROUP BY conv_id),
q AS (SELECT conv_id, list_transform(regexp_extract_all(left(last, 400), '[A-Za-z_][A-Za-z0-9_]{2,}')[1:12], lambda w: lower(w)) AS terms, embedding::DOUBLE[] AS v FROM c JOIN embeddings ON vec_id = conv_id WHERE answered < turns),
h AS (SELECT conv_id, doc_id, len(list_filter(terms, lambda t: lower(text) LIKE '%' || t || '%')) AS hits FROM q, documents), l AS (SELECT conv_id, doc_id, row_number() OVER (PARTITION BY conv_id ORDER BY hits DESC, doc_id) AS r FROM h WHERE hits > 0 QUALIFY r <= 12),
n AS (SELECT conv_id, vec_id AS doc_id, row_number() OVER (PARTITION BY conv_id ORDER BY round(list_dot_product(embedding::DOUBLE[], v), 6) DESC, vec_id) AS r FROM q, embeddings QUALIFY r <= 12),
f AS (SELECT conv_id, doc_id, round(sum(1.0 / (60 + r)), 6) AS score FROM (SELECT * FROM l UNION ALL SELECT * FROM n) GROUP BY 1, 2)
SELECT conv_id AS session, doc_id, score, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY score DESC, doc_id) AS INT) AS rank FROM f QUALIFY rank <= 6""")
def interview_hybrid(spark, d):
    """PIP-12: the next turn of each conversation and six documents for it, by hybrid retrieval for all sessions at once. Vector n belongs to document n, and to conversation n."""
    mode = F.element_at(F.array(*map(F.lit, ("quick", "standard", "deep"))), (F.col("conv_id") % 3 + 1).cast("int"))
    c = read(spark, d, "conversations").select(F.col("conv_id").alias("session"), mode.alias("mode"), F.when(F.col("role") == "user", "candidate").otherwise("interviewer").alias("role"), F.col("turn").alias("idx"), "text")
    e = read(spark, d, "embeddings")
    return sessions.turn_context(sessions.next_turn(c), read(spark, d, "documents").select("doc_id", "text"), index=vector_index.build_index(e), vectors=e.select(F.col("vec_id").alias("session"), "embedding"))


@query("""WITH near AS (SELECT vec_id AS doc_id, row_number() OVER (ORDER BY round(list_dot_product(embedding::DOUBLE[], (SELECT embedding FROM embeddings WHERE vec_id = 3)::DOUBLE[]), 6) DESC, vec_id) AS r FROM embeddings QUALIFY r <= 28),
h AS (SELECT doc_id, len(list_filter(['the', 'and', 'thing', 'erst'], lambda t: lower(text) LIKE '%' || t || '%')) AS hits FROM documents), lex AS (SELECT doc_id, row_number() OVER (ORDER BY hits DESC, doc_id) AS r FROM h WHERE hits > 0 QUALIFY r <= 28)
SELECT doc_id, round(sum(1.0 / (60 + r)), 6) AS score FROM (SELECT * FROM near UNION ALL SELECT * FROM lex) GROUP BY doc_id ORDER BY score DESC, doc_id LIMIT 14""")
def claim_hybrid(spark, d):
    """PIP-13: the documents that bear on a claim, by words and by its vector (that of document 3)."""
    e = read(spark, d, "embeddings")
    return sessions.check_claims(read(spark, d, "documents"), ["the", "and", "thing", "erst"], vectors=e, vector=list(e.where("vec_id = 3").first()["embedding"]))


@query("""WITH e AS (SELECT event_id, ts, event_type FROM events WHERE user_id = 7), t AS (SELECT min((ts, event_id)) AS stop FROM e WHERE event_type = 'purchase')
SELECT event_id, event_type FROM e, t WHERE stop IS NULL OR (ts, event_id) <= stop""")
def stream_job_events(spark, d):
    """STM-2: one job's events, to its first terminal one."""
    e = streaming.events_stream(spark, d).select("ts", "event_id", "user_id", "event_type")
    return streaming.follow(e, F.col("user_id") == 7, F.col("event_type") == "purchase", ["ts", "event_id"]).select("event_id", "event_type")


@query("SELECT CAST(json_extract(props, '$.k') AS BIGINT) AS k, count(*) AS n FROM events WHERE event_id % 9 <> 4 GROUP BY 1")
def stream_payloads(spark, d):
    """STM-1: payloads parsed as they come; what does not parse is dropped."""
    lines = streaming.events_stream(spark, d).select(F.when(F.col("event_id") % 9 == 4, "{broken").otherwise(F.col("props")).alias("value"))
    return streaming.drain(streaming.parse_events(lines, "k long").groupBy("k").agg(F.count("*").alias("n")), "update", ["k"])


@query(r"""SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN '[redacted]' ELSE source END AS scrubbed, array_to_string(regexp_extract_all(lower(text), '[a-z][a-z0-9+#.]{2,}'), ' ') AS terms,
CASE doc_id % 3 WHEN 0 THEN 'Data modeling' WHEN 1 THEN 'Security' ELSE 'unknown' END AS label, CASE WHEN n_chars < 1000 THEN printf('%.2f', n_chars / 1000.0::DOUBLE + CASE WHEN n_chars / 1000.0::DOUBLE * 8 % 2 = 1 THEN 0.001 ELSE 0 END) || '¢' ELSE '$' || printf('%.2f', n_chars / 1000.0::DOUBLE / 100 + CASE WHEN n_chars / 1000.0::DOUBLE / 100 * 8 % 2 = 1 THEN 0.001 ELSE 0 END) END AS cents,
doc_id % 3 = 1 AS allowed, 'critic@' || doc_id % 5 || ',dossier@2' AS versions, '{"k": ' || doc_id || '}' AS json, CAST(doc_id AS BIGINT) AS k FROM documents""")
def text_helpers(spark, d):
    """STR-4, STR-10, STR-17, STR-19, STR-20, STR-22, EXT-9."""
    n = F.col("doc_id").cast("string")
    pick = lambda *v: F.element_at(F.array(*map(F.lit, v)), (F.col("doc_id") % len(v) + 1).cast("int"))
    answer = F.concat(F.lit("Sure:\n"), pick("```json\n", "it is "), F.lit('{"k": '), n, F.lit("}"), pick("\n```\nDone.", " I think"))
    json = text.lenient_json(answer)
    return read(spark, d, "documents").select(
        "doc_id", F.map_values(text.scrub_map(F.create_map(pick("apiKey", "name"), F.col("source"))))[0].alias("scrubbed"), F.array_join(text.claim_terms(F.col("text")), " ").alias("terms"),
        text.label(rules.CATEGORIES, pick("data-modeling", "security", "unknown")).alias("label"), text.cents_text(F.col("n_chars") / 1000).alias("cents"),
        text.email_allowed(F.concat(F.lit("u"), n, F.lit("@"), pick("a.org", "Example.com", "b.com.example")), ["example.com"]).alias("allowed"),
        text.fingerprint(F.create_map(F.lit("dossier"), F.lit(2).cast("long"), F.lit("critic"), F.col("doc_id") % 5)).alias("versions"), json.alias("json"), F.get_json_object(json, "$.k").cast("long").alias("k"),
    )


@query("SELECT strftime(o_orderdate, '%Y-%m-%d') AS day, count(*) AS n FROM orders GROUP BY 1")
def iso_dates(spark, d):
    """DTE-2."""
    return read(spark, d, "orders").groupBy(text.iso_date(F.col("o_orderdate")).alias("day")).agg(F.count("*").alias("n"))


@query("""WITH c AS (SELECT p_brand, p_type, count(*) AS n FROM part GROUP BY 1, 2), l AS (SELECT p_brand, string_agg(p_type, ', ' ORDER BY n DESC, p_type) AS types FROM (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY n DESC, p_type) <= 6) GROUP BY 1),
f AS (SELECT p_brand, string_agg(p_name, ', ' ORDER BY p_partkey) AS findings FROM (SELECT * FROM part QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) <= 8) GROUP BY 1) SELECT * FROM l JOIN f USING (p_brand)""")
def card_lists(spark, d):
    """SRT-11: the first six and eight entries that a card shows of each repository (a brand)."""
    p = read(spark, d, "part")
    kinds = tables.first_listed(p.groupBy("p_brand", "p_type").agg(F.count("*").alias("n")), ["p_brand"], "p_type", [F.desc("n"), "p_type"], rules.CARD_LANGUAGES, "types")
    names = tables.first_listed(p, ["p_brand"], "p_name", ["p_partkey"], rules.CARD_FINDINGS, "findings")
    return kinds.join(names, "p_brand").select("p_brand", F.array_join("types", ", ").alias("types"), F.array_join("findings", ", ").alias("findings"))


@query("""WITH l AS (SELECT 0 AS i, '| metric | score |' AS line UNION ALL SELECT 1, '|---|---|' UNION ALL SELECT 1 + row_number() OVER (ORDER BY event_type), '| ' || event_type || ' | ' || count(*) || ' |' FROM events GROUP BY event_type) SELECT line FROM l""")
def report_lines(spark, d):
    """SNK-6: a Markdown table written as text files and read back."""
    made = read(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("n"))
    path = _shared(spark, "report")
    reports.write_lines(reports.markdown_table(made, ["event_type", "n"], ["metric", "score"]), "line", ["row", "line"], path)
    return spark.read.text(path).withColumnRenamed("value", "line")


@query("""SELECT unnest(['#separator:tab', '#html:true', '#tags column:3']) AS line UNION ALL SELECT replace(replace(p_name || ' & ' || p_size, '&', '&amp;'), chr(9), ' ') || chr(9) || p_type || chr(9) || 'pack::' || p_brand FROM part""")
def tsv_file(spark, d):
    """SNK-2: cards under the three header lines, written as text files and read back."""
    p = read(spark, d, "part")
    cards = p.select(reports.tsv_line(F.concat("p_name", F.lit(" & "), F.col("p_size").cast("string")), reports.card_text(F.col("p_type")), F.concat(F.lit("pack::"), "p_brand")).alias("line"))
    path = _shared(spark, "cards")
    reports.write_lines(reports.tsv_table(cards, "line"), "line", ["row", "line"], path)
    return spark.read.text(path).withColumnRenamed("value", "line")


@query("SELECT doc_id, n_chars FROM documents WHERE source = 'src1' UNION ALL SELECT doc_id + 1000000, n_chars FROM documents WHERE source = 'src1'")
def snapshot_rows(spark, d):
    """SNK-5: two appends by snapshot; one snapshot is read, and only its folder."""
    path, rows = _shared(spark, "snapshots"), read(spark, d, "documents").select("doc_id", "n_chars", F.col("source").alias("snapshot"))
    sessions.write_snapshot(rows, path)
    sessions.write_snapshot(rows.withColumn("doc_id", F.col("doc_id") + 1_000_000), path)
    return spark.read.parquet(path).where("snapshot = 'src1'").select("doc_id", "n_chars")


@query("SELECT user_id, count(*) AS n FROM events GROUP BY user_id")
def checkpointed_stage(spark, d):
    """PIP-11: the second call's rows are the same in another order, so it reads what the first one made; its own maker would fail."""
    path, e = _shared(spark, "stages"), read(spark, d, "events")
    tables.checkpointed(spark, path, "counts", e, lambda: e.groupBy("user_id").agg(F.count("*").alias("n")))
    return tables.checkpointed(spark, path, "counts", e.repartition(7, "user_id"), lambda: spark.range(1).select(F.raise_error(F.lit("made twice"))))


@query("SELECT user_id, count(*) AS n FROM (SELECT user_id FROM events UNION ALL SELECT 1) GROUP BY user_id")
def remade_stage(spark, d):
    """PIP-11: one more row in the input, and the stage is made again."""
    path, e = _shared(spark, "stages"), read(spark, d, "events").select("user_id")
    count = lambda df: tables.checkpointed(spark, path, "counts", df, lambda: df.groupBy("user_id").agg(F.count("*").alias("n")))
    count(e)
    return count(e.unionByName(spark.createDataFrame([(1,)], "user_id long")))


@query("""WITH j AS (SELECT user_id * 10 + event_id % 3 AS job_id, event_id AS seen, ['queued', 'active', 'failed', 'done'][event_id % 4 + 1] AS state, event_id % 3 AS tries FROM events), n AS (SELECT job_id, max(seen) AS seen, arg_max(state, seen) AS state, arg_max(tries, seen) AS tries FROM j GROUP BY 1), c AS (SELECT max(event_id) AS now FROM events)
SELECT job_id, state FROM n, c WHERE state = 'queued' OR (state = 'failed' AND tries < 2 AND now - seen >= 30) OR (state = 'active' AND now - seen >= 2700)""")
def job_queue(spark, d):
    """SRC-8, STM-8: one row a job, its newest; an event's number is its second."""
    e = read(spark, d, "events")
    state = F.element_at(F.array(*map(F.lit, ("queued", "active", "failed", "done"))), (F.col("event_id") % 4 + 1).cast("int"))
    jobs = e.select((F.col("user_id") * 10 + F.col("event_id") % 3).alias("job_id"), state.alias("state"), (F.col("event_id") % 3).alias("tries"), F.timestamp_seconds("event_id").alias("at"))
    now = e.agg(F.max("event_id")).first()[0]
    return sessions.take_jobs(jobs, F.timestamp_seconds(F.lit(now))).select("job_id", "state")


@query("""SELECT item_id, hits FROM (SELECT item_id, CAST(len(list_filter(['the', 'and', 'thing', 'erst'], lambda t: lower(text) LIKE '%' || t || '%')) AS INT) AS hits FROM benchmark) WHERE hits > 0 ORDER BY hits DESC, item_id LIMIT 14""")
def claim_evidence(spark, d):
    """PIP-13: the passages that share most terms with a claim's keywords."""
    docs = read(spark, d, "benchmark").select(F.col("item_id").alias("doc_id"), "text")
    return sessions.check_claims(docs, ["the", "and", "thing", "erst"]).select(F.col("doc_id").alias("item_id"), "hits")


@query("""WITH f AS (SELECT source, count(*) AS files, list_distinct(list(lang)) AS langs, count(*) FILTER (WHERE n_chars > 5000) AS found FROM documents GROUP BY 1),
e AS (SELECT 'src' || i AS repo, 30 + i AS least, i % 2 = 0 AS redaction FROM range(0, 25) AS t(i)) SELECT repo, coalesce(files >= least AND list_has_all(langs, ['en', 'de']) AND (NOT redaction OR found > 0), false) AS passed FROM e LEFT JOIN f ON source = repo""")
def suite_outcomes(spark, d):
    """PIP-14: repositories (sources) against what a suite expects; one that was not found fails."""
    found = read(spark, d, "documents").groupBy(F.col("source").alias("repo")).agg(F.count("*").alias("files"), F.collect_set("lang").alias("languages"), F.count_if(F.col("n_chars") > 5000).alias("findings"))
    expected = spark.range(25).selectExpr("'src' || id AS repo", "30 + id AS min_files", "array('en', 'de') AS languages", "id % 2 = 0 AS redaction")
    return sessions.suite_results(found, expected)


@query("""WITH h AS (SELECT item_id, CAST('0x' || left(sha256(text), 8) AS BIGINT) AS h FROM benchmark) SELECT item_id, h % 4 <> 0 AS supported, round(h % 101 / 100.0, 2)::DOUBLE AS groundedness, item_id % 10 = 3 AS failed FROM h""")
def model_verdicts(spark, d):
    """UDF-3, UDF-4, UDF-5, UDF-8: a model called by batch; a batch that fails is tried again row by row, and rows that fail stay, with the error."""
    docs = read(spark, d, "benchmark").withColumn("prompt", F.when(F.col("item_id") % 10 == 3, "").otherwise(F.col("text")))

    def call(prompts):
        if not all(prompts):
            raise ValueError("empty prompt")
        return models.stub_answer(prompts)

    said = models.apply_model(models.apply_model(docs, "prompt", "answer", T.StringType(), call), "text", "sure", T.StringType(), models.stub_answer)
    v = F.from_json("sure", "supported boolean, groundedness double")
    return said.select("item_id", v["supported"].alias("supported"), F.round(v["groundedness"], 2).alias("groundedness"), F.col("answer_error").isNotNull().alias("failed"))


@query("""WITH h AS (SELECT item_id, CAST('0x' || left(sha256('ask ' || item_id), 8) AS BIGINT) AS h FROM benchmark) SELECT item_id, CASE WHEN item_id % 6 IN (2, 5) THEN NULL ELSE round(h % 101 / 100.0, 2)::DOUBLE END AS groundedness,
CASE WHEN item_id % 6 IN (0, 4) THEN 1 ELSE 2 END AS tries, CASE item_id % 6 WHEN 2 THEN 'range' WHEN 5 THEN 'unreadable' ELSE '' END AS problems FROM h""")
def repaired_answers(spark, d):
    """UDF-4: answers that break their schema are asked for again, once, with what was wrong; those that break it again stay without a value, with the problem."""

    def call(prompts):
        out = []
        for p in prompts:
            first, again = p.split("\n")[0], "does not hold" in p
            kind, good = int(first.split()[1]) % 6, models.stub_answer([first])[0]
            out.append('{"groundedness": 7}' if kind == 2 or (kind == 1 and not again) else "I think so" if kind == 5 or (kind == 3 and not again) else good)
        return out

    asked = read(spark, d, "benchmark").select("item_id", F.concat(F.lit("ask "), F.col("item_id")).alias("prompt"))
    said = models.apply_structured(asked, "prompt", "verdict", call, "groundedness double", {"range": F.col("parsed.groundedness").between(0, 1)})
    return said.select("item_id", F.round("verdict.groundedness", 2).alias("groundedness"), F.col("verdict_tries").alias("tries"), F.coalesce(F.array_join("verdict_problems", ","), F.lit("")).alias("problems"))


@query("SELECT item_id, true AS same FROM benchmark")
def embedded_batches(spark, d):
    """UDF-2, PIP-4: the registered embedder, by batch, against the same embedding by DataFrame functions."""
    from .corpus import _embedded

    docs = read(spark, d, "benchmark").select(F.col("item_id").alias("doc_id"), "text")
    called = models.embed(docs, "text").select("doc_id", F.posexplode("embedding").alias("dim", "y")).where("y != 0")
    both = called.join(_embedded(docs), ["doc_id", "dim"], "full").groupBy(F.col("doc_id").alias("item_id"))
    return both.agg(F.bool_and((F.col("x").isNotNull() & F.col("y").isNotNull() & (F.abs(F.col("x") - F.col("y")) < 2e-6)) | (F.coalesce(F.col("x"), F.col("y")) == 0)).alias("same"))


@query(r"""WITH p AS (SELECT p_brand || ' & Co' AS title, p_brand, p_partkey AS k, split_part(p_type, ' ', 1) AS c, 'L' || p_size % 3 + 1 AS lev, p_name || ' <' || p_size || '>' AS stem, p_type || chr(10) || 'x' AS answer, 'pack::' || p_brand AS tags FROM part WHERE CAST(right(p_brand, 1) AS INT) % 2 = 0),
s AS (SELECT DISTINCT title, lower(regexp_replace(title, '[^A-Za-z0-9_.-]+', '-', 'g')) AS slug FROM p), esc AS (SELECT *, replace(replace(replace(stem, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') AS es, replace(replace(replace(answer, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') AS ea FROM p JOIN s USING (title)),
sec AS (SELECT title, c, row_number() OVER (PARTITION BY title ORDER BY min(k), c) AS sec FROM p GROUP BY title, c),
num AS (SELECT *, row_number() OVER (PARTITION BY title, c ORDER BY k) AS i, row_number() OVER (PARTITION BY title ORDER BY k) AS j FROM esc JOIN sec USING (title, c)),
b AS (SELECT slug || '.md' AS name, 0 AS a, 0 AS o, '# ' || title AS block FROM s UNION ALL SELECT slug || '.md', sec, 0, '## ' || c FROM sec JOIN s USING (title) UNION ALL SELECT slug || '.md', sec, i, '### ' || i || '. ' || stem || chr(10) || chr(10) || answer || chr(10) || chr(10) || '---' FROM num
UNION ALL SELECT slug || '.tsv', 0, x.i, x.l FROM s, (SELECT unnest([{'i': 0, 'l': '#separator:tab'}, {'i': 1, 'l': '#html:true'}, {'i': 2, 'l': '#tags column:3'}]) AS x) UNION ALL SELECT slug || '.tsv', 1, k, es || chr(9) || replace(ea, chr(10), '<br>') || chr(9) || tags FROM num
UNION ALL SELECT slug || '.html', 0, 0, '<!doctype html><html><head><meta charset="utf-8"><title>' || replace(title, '&', '&amp;') || '</title></head><body><h1>' || replace(title, '&', '&amp;') || '</h1>' FROM s UNION ALL SELECT slug || '.html', 2, 0, '</body></html>' FROM s
UNION ALL SELECT slug || '.html', 1, j, '<article><div class="meta">' || c || ' · ' || lev || '</div><h3>' || j || '. ' || es || '</h3><p>' || replace(ea, chr(10), '<br>') || '</p></article>' FROM num),
d AS (SELECT name, string_split(string_agg(block, chr(10) ORDER BY a, o), chr(10)) AS lines FROM b GROUP BY name) SELECT name, CAST(generate_subscripts(lines, 1) AS INT) AS n, unnest(lines) AS line FROM d""")
def export_documents(spark, d):
    """SNK-1 to SNK-4: one user's sets (brands) as Markdown, TSV and HTML documents, written by the data source and read back; sets of others are left out."""
    part = read(spark, d, "part")
    owner = F.when(F.right("p_brand", F.lit(1)).cast("int") % 2 == 0, "ann").otherwise("bob")
    sets = part.select(F.col("p_brand").alias("set_id"), F.concat("p_brand", F.lit(" & Co")).alias("title"), owner.alias("owner")).distinct()
    items = part.select(
        F.col("p_brand").alias("set_id"), F.col("p_partkey").alias("position"), F.split_part("p_type", F.lit(" "), F.lit(1)).alias("category"), F.expr("'L' || (p_size % 3 + 1)").alias("level"),
        F.expr("p_name || ' <' || p_size || '>'").alias("stem"), F.concat("p_type", F.lit("\nx")).alias("answer"), F.concat(F.lit("pack::"), "p_brand").alias("tags"),
    )
    folder = _shared(spark, "documents")
    blocks = None
    for kind in exports.FORMATS:
        own = exports.export_lines(items, sets, "ann", kind)
        blocks = own if blocks is None else blocks.unionByName(own)
    exports.write_documents(blocks, folder)
    return exports.read_documents(spark, folder)
