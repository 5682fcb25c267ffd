"""Queries over questions, their checks and their evaluation."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from inkstone.functions.text import compatible, squash
from inkstone.operators import evaluation as E
from inkstone.operators import questions as Q
from inkstone.plans.base import chunks, chunks_sql, questions, questions_sql
from inkstone.functions.salvage import HasKey
from inkstone.providers import QuotingModel

#: Types of questions that the table has.
TYPES = ("contrast", "objection", "shared_ground", "other")
COLUMNS = ("community", "topic", "question", "answer", "type", "authors", "sources")


def _questions(spark: SparkSession, sf: str) -> DataFrame:
    q = questions(spark, sf, *COLUMNS)
    n = F.coalesce(F.size("sources"), F.lit(0))
    labels = F.when(n > 0, F.transform(F.sequence(F.lit(1), n), lambda k: F.concat(F.lit("[P"), k.cast("string"), F.lit("]"))))
    return q.withColumn("n", n).withColumn("labels", labels)


def _defect() -> Column:
    cited = F.transform("sources", lambda s: s["author"])
    return Q.question_defect(F.col("question"), F.col("answer"), F.col("labels"), cited, F.col("authors"), F.col("n"))


def question_check(spark: SparkSession, sf: str) -> DataFrame:
    return _questions(spark, sf).select("id", _defect().alias("reason"))


def rejection_report(spark: SparkSession, sf: str) -> DataFrame:
    return _questions(spark, sf).select(F.coalesce(_defect(), F.lit("accepted")).alias("reason")).groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


def question_ids(spark: SparkSession, sf: str) -> DataFrame:
    taken = _questions(spark, sf).where(_defect().isNull()).withColumn("call_no", F.regexp_extract("id", r"q(\d+)$", 1).try_cast("int")).withColumnRenamed("id", "item_no")
    return Q.question_ids(taken).select(F.col("item_no").alias("old_id"), F.col("id").alias("new_id"))


def question_topics(spark: SparkSession, sf: str) -> DataFrame:
    q = _questions(spark, sf).withColumn("call_no", F.regexp_extract("id", r"q(\d+)$", 1).try_cast("int")).withColumn("parsed", F.col("answer").isNotNull())
    return Q.first_topics(q)


def question_types(spark: SparkSession, sf: str) -> DataFrame:
    return _questions(spark, sf).groupBy(Q.known_type(F.col("type"), TYPES).alias("kind")).agg(F.count(F.lit(1)).alias("n"))


def questions_per_pair(spark: SparkSession, sf: str) -> DataFrame:
    pair = F.array_join(F.array_sort("authors"), " - ")
    return _questions(spark, sf).where("authors IS NOT NULL").groupBy(pair.alias("pair")).agg(F.count(F.lit(1)).alias("n"))


def cite_rewrite(spark: SparkSession, sf: str) -> DataFrame:
    q = _questions(spark, sf).where("answer IS NOT NULL")
    citations = F.transform(F.coalesce("sources", F.array().cast(dict(q.dtypes)["sources"])), lambda s: F.concat(F.coalesce(s["author"], F.lit("?")), F.lit(", p. "), F.coalesce(F.get(s["pages"], F.lit(0)).cast("string"), F.lit("?"))))
    return q.select("id", Q.cite(F.concat("answer", F.lit(" See [P1], P2 and [P19].")), citations).alias("cited"))


def markdown_export(spark: SparkSession, sf: str) -> DataFrame:
    q = _questions(spark, sf).where("question IS NOT NULL AND answer IS NOT NULL AND community IS NOT NULL")
    entry = Q.markdown_entry(F.col("id"), F.col("topic"), Q.known_type(F.col("type"), TYPES), F.col("question"), F.col("answer"), F.col("sources"))
    return Q.markdown(q, "community", entry, ["id"])


def _passages(spark: SparkSession, sf: str) -> DataFrame:
    """Cited chunks of each question in order: ``id, position, author, chunk_id, text`` and what heads a passage."""
    q = questions(spark, sf, "sources").select("id", F.posexplode("sources").alias("position", "s"))
    cited = q.select("id", "position", F.col("s.author").alias("author"), F.col("s.chunk_id").alias("chunk_id"))
    return cited.join(chunks(spark, sf, "text", "doc_title", "section", "start_page", "end_page"), "chunk_id", "left")


def render_passages(spark: SparkSession, sf: str) -> DataFrame:
    p = _passages(spark, sf)
    made = Q.render_passage(F.col("position") + 1, F.coalesce("author", F.lit("")), F.col("doc_title"), F.col("section"), F.coalesce("start_page", F.lit(0)), F.coalesce("end_page", F.lit(0)), F.col("text"))
    return p.select("id", "position", made.alias("rendered"))


def prompt_build(spark: SparkSession, sf: str) -> DataFrame:
    p = _passages(spark, sf)
    made = Q.render_passage(F.col("position") + 1, F.coalesce("author", F.lit("")), F.col("doc_title"), F.col("section"), F.coalesce("start_page", F.lit(0)), F.coalesce("end_page", F.lit(0)), F.col("text"))
    return Q.prompts(p.select("id", "position", F.coalesce("author", F.lit("")).alias("author"), made.alias("rendered")), ["id"], TYPES)


def llm_replay(spark: SparkSession, sf: str) -> DataFrame:
    """Every prompt put to an offline model that quotes its first passage; calls whose answer is no question are repeated."""
    return Q.ask(prompt_build(spark, sf), ["id"], "prompt", QuotingModel(), usable=HasKey(("question",)))


def _claims(spark: SparkSession, sf: str) -> DataFrame:
    """A claim for each source of each question, with a verdict and evidence made from the texts.

    Evidence is a stretch of the cited chunk, two such stretches around an omission, the answer's beginning, or too short.
    """
    p = _passages(spark, sf).join(questions(spark, sf, "answer"), "id")
    k = F.pmod(F.length("chunk_id") + F.col("position") + F.coalesce(F.length("answer"), F.lit(0)), F.lit(4))
    text = F.coalesce("text", F.lit(""))
    evidence = F.when(k == 0, F.substring(text, 11, 80)).when(k == 1, F.concat(F.substring(text, 21, 60), F.lit(" ... "), F.substring(text, 101, 60))).when(k == 2, F.substring(F.coalesce("answer", F.lit("")), 1, 90)).otherwise(F.substring(text, 11, 12))
    verdict = F.when(F.pmod(F.coalesce(F.length("answer"), F.lit(0)), F.lit(7)) == 3, "contradicted").when(F.pmod(F.coalesce(F.length("answer"), F.lit(0)), F.lit(11)) == 5, "not_supported").when(F.pmod(F.coalesce(F.length("answer"), F.lit(0)), F.lit(13)) == 7, "unsure").otherwise("supported")
    return p.select("id", "position", "author", "chunk_id", evidence.alias("evidence"), verdict.alias("judged"), "text")


def _checked(spark: SparkSession, sf: str) -> DataFrame:
    c = _claims(spark, sf)
    c = c.withColumn("evidence", compatible(F.col("evidence")))
    sources = c.select("id", compatible(F.coalesce("text", F.lit(""))).alias("text")).groupBy("id").agg(F.collect_set(squash(F.col("text"))).alias("sources"))
    joined = c.join(sources, "id").withColumn("found", E.evidence_found(F.col("evidence"), F.col("sources")))
    return joined.select("id", "position", "author", "judged", "found", E.checked_verdict(F.col("judged"), F.col("found")).alias("verdict"))


def evidence_match(spark: SparkSession, sf: str) -> DataFrame:
    return _checked(spark, sf).select("id", "position", "found", "verdict")


def _scored(spark: SparkSession, sf: str) -> DataFrame:
    return E.score_answers(_checked(spark, sf)).withColumn("needs_both", F.col("n_claims") >= 2)


def claim_scores(spark: SparkSession, sf: str) -> DataFrame:
    return E.score_answers(_checked(spark, sf))


def eval_report(spark: SparkSession, sf: str) -> DataFrame:
    return E.evaluation_report(_scored(spark, sf), _checked(spark, sf))


def author_verdict_pivot(spark: SparkSession, sf: str) -> DataFrame:
    return E.verdicts_by_author(_checked(spark, sf).where("author IS NOT NULL"))


def judge_without_evidence(spark: SparkSession, sf: str) -> DataFrame:
    return _checked(spark, sf).agg(F.count_if((F.col("judged") == "supported") & ~F.col("found")).alias("n"))


def final_questions(spark: SparkSession, sf: str) -> DataFrame:
    return E.final_set(questions(spark, sf, "question"), _scored(spark, sf)).select("id", "question")


def worst_answers(spark: SparkSession, sf: str) -> DataFrame:
    return E.worst(_scored(spark, sf)).select("id", "support")


ALL = (question_check, rejection_report, question_ids, question_topics, question_types, questions_per_pair, cite_rewrite, markdown_export, render_passages, prompt_build, llm_replay, evidence_match, claim_scores, eval_report, author_verdict_pivot, judge_without_evidence, final_questions, worst_answers)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in ALL}


CHECK = (
    "WITH "
    + questions_sql(*COLUMNS)
    + r""", r AS (SELECT *, CASE WHEN trim(coalesce(question, '')) = '' OR trim(coalesce(answer, '')) = '' THEN 'empty question or answer'
    WHEN regexp_matches(trim(question), '(?i)passage|\bp\d+\b') THEN 'question refers to passages' WHEN coalesce(len(sources), 0) = 0 THEN 'no valid sources'
    WHEN NOT coalesce(list_sort(list_distinct(list_transform(sources, lambda s: s.author))) = list_sort(list_distinct(authors)), false) THEN 'sources do not cover both authors' END AS reason FROM q)
"""
)
PASSAGES = (
    "WITH "
    + questions_sql("answer", "sources")
    + ", "
    + chunks_sql("text", "doc_title", "section", "start_page", "end_page")
    + """, e AS (SELECT id, answer, unnest(range(len(sources)::BIGINT))::INT AS position, unnest(sources) AS s FROM q),
p AS (SELECT id, answer, position, s.author AS author, s.chunk_id AS chunk_id, text, doc_title, section, start_page, end_page FROM e LEFT JOIN c ON c.chunk_id = s.chunk_id)
"""
)
CLAIMS = (
    PASSAGES.rstrip()
    + r""",
k AS (SELECT *, (length(chunk_id) + position + coalesce(length(answer), 0)) % 4 AS k, coalesce(length(answer), 0) AS n, coalesce(text, '') AS t FROM p),
cl AS (SELECT id, position, author, t, CASE k WHEN 0 THEN substring(t, 11, 80) WHEN 1 THEN substring(t, 21, 60) || ' ... ' || substring(t, 101, 60) WHEN 2 THEN substring(coalesce(answer, ''), 1, 90) ELSE substring(t, 11, 12) END AS evidence,
    CASE WHEN n % 7 = 3 THEN 'contradicted' WHEN n % 11 = 5 THEN 'not_supported' WHEN n % 13 = 7 THEN 'unsure' ELSE 'supported' END AS judged FROM k),
src AS (SELECT id, list(DISTINCT regexp_replace(lower(t), '[^a-z0-9]', '', 'g')) AS sources FROM cl GROUP BY id),
pc AS (SELECT cl.*, sources, list_filter(list_transform(regexp_split_to_array(coalesce(evidence, ''), '\.\.\.|…'), lambda x: regexp_replace(lower(x), '[^a-z0-9]', '', 'g')), lambda x: length(x) >= 20) AS pieces FROM cl JOIN src USING (id)),
f AS (SELECT *, len(pieces) > 0 AND len(list_filter(sources, lambda s: len(list_filter(pieces, lambda x: NOT contains(s, x))) = 0)) > 0 AS found FROM pc),
ck AS (SELECT id, position, author, judged, found, CASE WHEN judged = 'supported' AND NOT found THEN 'not_supported' ELSE judged END AS verdict FROM f),
sc AS (SELECT id, count(*) FILTER (verdict IN ('supported', 'not_supported', 'contradicted')) AS n_claims, count(*) FILTER (verdict = 'supported') AS y, count(*) FILTER (verdict = 'contradicted') > 0 AS contradicted FROM ck GROUP BY id),
scored AS (SELECT id, n_claims, round(CASE WHEN n_claims > 0 THEN y / n_claims ELSE 0.0 END, 3) AS support, n_claims > 0 AND y = n_claims AS grounded, contradicted FROM sc)
"""
)


def oracle_sql() -> dict[str, str]:
    return {
        "question_check": CHECK + "SELECT id, reason FROM r",
        "rejection_report": CHECK + "SELECT coalesce(reason, 'accepted') AS reason, count(*) AS n FROM r GROUP BY 1",
        "question_ids": CHECK + r"SELECT id AS old_id, 'c' || community || '-q' || row_number() OVER (PARTITION BY community ORDER BY try_cast(regexp_extract(id, 'q(\d+)$', 1) AS INT), id) AS new_id FROM r WHERE reason IS NULL",
        "question_topics": CHECK + r"SELECT community, arg_min(coalesce(topic, ''), try_cast(regexp_extract(id, 'q(\d+)$', 1) AS INT)) AS topic FROM r WHERE answer IS NOT NULL GROUP BY community",
        "question_types": CHECK + "SELECT CASE WHEN type IN ('contrast', 'objection', 'shared_ground', 'other') THEN type ELSE 'other' END AS kind, count(*) AS n FROM r GROUP BY 1",
        "questions_per_pair": CHECK + "SELECT array_to_string(list_sort(authors), ' - ') AS pair, count(*) AS n FROM r WHERE authors IS NOT NULL GROUP BY 1",
        "markdown_export": CHECK
        + """SELECT community, string_agg('## ' || concat_ws(' · ', id, coalesce(topic, ''), CASE WHEN type IN ('contrast', 'objection', 'shared_ground') THEN type ELSE 'other' END) || chr(10) || chr(10) || '**Q:** ' || trim(question) || chr(10) || chr(10) || '**A:** ' || trim(answer) || chr(10) || chr(10) || '*Sources:* '
            || coalesce(array_to_string(list_transform(sources, lambda s: coalesce(s.author, '') || ', ' || coalesce(s.section, '') || ' (pp. ' || coalesce(s.pages[1]::VARCHAR, '') || '-' || coalesce(s.pages[2]::VARCHAR, '') || ')'), '; '), ''), chr(10) || chr(10) ORDER BY id) AS markdown FROM r WHERE question IS NOT NULL AND answer IS NOT NULL AND community IS NOT NULL GROUP BY community""",
        "render_passages": PASSAGES + r""", w AS (SELECT *, regexp_extract_all(coalesce(text, ''), '[^\s]+') AS ws FROM p)
            SELECT id, position, '[P' || (position + 1) || '] ' || upper(coalesce(author, '')) || ' - ' || coalesce(doc_title, '') || ', ' || coalesce(section, '') || ' (pp. ' || coalesce(start_page, 0) || '-' || coalesce(end_page, 0) || ')' || chr(10) ||
            CASE WHEN len(ws) > 700 THEN array_to_string(ws[1:700], ' ') || ' [...]' ELSE array_to_string(ws, ' ') END AS rendered FROM w""",
        "cite_rewrite": "WITH RECURSIVE " + questions_sql("answer", "sources")
        + r""", c AS (SELECT id, answer || ' See [P1], P2 and [P19].' AS t, list_transform(coalesce(sources, []), lambda s: coalesce(s.author, '?') || ', p. ' || coalesce(s.pages[1]::VARCHAR, '?')) AS names FROM q WHERE answer IS NOT NULL),
            f AS (SELECT id, t, names, len(names)::INT AS k FROM c UNION ALL SELECT id, regexp_replace(t, '\[P' || k || '\]|\bP' || k || '\b', '[' || names[k] || ']', 'g'), names, k - 1 FROM f WHERE k > 0)
            SELECT id, regexp_replace(t, '\[P\d+\]|\bP\d+\b', '', 'g') AS cited FROM f WHERE k = 0""",
        "prompt_build": PASSAGES
        + r""", w AS (SELECT *, regexp_extract_all(coalesce(text, ''), '[^\s]+') AS ws FROM p),
            m AS (SELECT id, position, coalesce(author, '') AS author, '[P' || (position + 1) || '] ' || upper(coalesce(author, '')) || ' - ' || coalesce(doc_title, '') || ', ' || coalesce(section, '') || ' (pp. ' || coalesce(start_page, 0) || '-' || coalesce(end_page, 0) || ')' || chr(10) ||
                CASE WHEN len(ws) > 700 THEN array_to_string(ws[1:700], ' ') || ' [...]' ELSE array_to_string(ws, ' ') END AS rendered FROM w)
            SELECT id, printf('""" + Q.PROMPT.replace("'", "''") + """', min(author), max(author), string_agg(rendered, chr(10) || chr(10) ORDER BY position), 'contrast | objection | shared_ground | other') AS prompt FROM m GROUP BY id""",
        "evidence_match": CLAIMS + "SELECT id, position, found, verdict FROM ck",
        "claim_scores": CLAIMS + "SELECT * FROM scored",
        "eval_report": CLAIMS
        + """, ev AS (SELECT count(*) AS n, sum(round(support * 1000)::BIGINT) AS s, count(*) FILTER (grounded) AS g, count(*) FILTER (contradicted) AS c, count(*) FILTER (n_claims >= 2) AS b, count(*) FILTER (grounded AND n_claims >= 2) AS final FROM scored),
            v AS (SELECT count(*) AS claims, count(*) FILTER (verdict = 'supported') AS supported, count(*) FILTER (verdict = 'not_supported') AS not_supported, count(*) FILTER (verdict = 'contradicted') AS contradicted, count(*) FILTER (judged = 'supported' AND NOT found) AS yes_without_evidence FROM ck WHERE verdict IN ('supported', 'not_supported', 'contradicted'))
            SELECT n AS answers, floor((2000 * g + n) / (2 * n)) / 10 AS grounded_pct, floor((2000 * c + n) / (2 * n)) / 10 AS contradicted_pct, floor((2000 * b + n) / (2 * n)) / 10 AS needs_both_pct, floor((2 * s + n) / (2 * n)) / 1000 AS mean_support, final AS final_questions,
                claims, supported, not_supported, contradicted, yes_without_evidence FROM ev, v""",
        "author_verdict_pivot": CLAIMS + "SELECT author, count(*) FILTER (verdict = 'supported') AS supported, count(*) FILTER (verdict = 'not_supported') AS not_supported, count(*) FILTER (verdict = 'contradicted') AS contradicted FROM ck WHERE author IS NOT NULL GROUP BY author",
        "judge_without_evidence": CLAIMS + "SELECT count(*) FILTER (judged = 'supported' AND NOT found) AS n FROM ck",
        "final_questions": CLAIMS + ", qq AS (SELECT id, first(question) AS question FROM questions WHERE id IS NOT NULL GROUP BY id) SELECT id, question FROM qq WHERE id IN (SELECT id FROM scored WHERE grounded AND n_claims >= 2)",
        "worst_answers": CLAIMS + "SELECT id, support FROM scored ORDER BY support, id LIMIT 3",
    }
