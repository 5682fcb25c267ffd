"""From communities to questions: central passages, author pairs, prompts, and the checks of what models return."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkstone.functions.vector import centroid, dot

# fixed values: passages an author gives, words of a passage, pairs of a community, attempts of a call, the question types
PER_AUTHOR, PASSAGE_WORDS, MOST_PAIRS, ATTEMPTS = 2, 700, 3, 2
TYPES = ("comparison", "agreement", "synthesis")

PROMPT = """You are given passages by two authors, %s and %s.

%s

Write one exam question that can only be answered with the passages of both authors, and its answer. Name the authors;
do not mention the passages in the question. Use nothing but the passages, and never give one author's thought to the
other. Cite passages in the answer as [P1]. Reply with JSON only:
{"topic": "...", "question": "...", "answer": "...", "type": "%s", "sources": ["P1", "P3"]}"""


def central_passages(members: DataFrame, per_author: int = PER_AUTHOR) -> DataFrame:
    """``community, author, id, rank``: each author's members nearest the community's centroid; ties go to the smaller id.

    ``members`` has ``community, author, id, unit``.
    """
    centres = centroid(members, ["community"], "unit")
    scored = members.join(centres, "community").select("community", "author", "id", dot(F.col("unit"), F.col("centroid")).alias("score"))
    w = Window.partitionBy("community", "author").orderBy(F.desc(F.round("score", 9)), "id")
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= per_author)


def first_pairs(counts: DataFrame) -> DataFrame:
    """``community, a, b``: the pair of authors with most chunks; of equals the first by name. ``counts`` has ``community, author, n``."""
    other = counts.select("community", F.col("author").alias("b"), F.col("n").alias("nb"))
    pairs = counts.select("community", F.col("author").alias("a"), F.col("n").alias("na")).join(other, "community").where("a < b")
    w = Window.partitionBy("community").orderBy((F.col("na") + F.col("nb")).desc(), "a", "b")
    return pairs.withColumn("_r", F.row_number().over(w)).where("_r = 1").select("community", "a", "b")


def choose_pairs(counts: DataFrame, most: int = MOST_PAIRS) -> DataFrame:
    """``community, position, a, b``: up to ``most`` pairs, those with most authors not used yet first, then with most chunks.

    One row an author enters, so a community's group is as small as its list of authors.
    """
    kind = dict(counts.dtypes)["community"]

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        n = dict(zip(frame["author"], frame["n"], strict=True))
        names = sorted(n)
        left = [(a, b) for i, a in enumerate(names) for b in names[i + 1 :]]
        used: set[str] = set()
        rows = []
        while left and len(rows) < most:
            best = min(left, key=lambda p: (-len(set(p) - used), -(n[p[0]] + n[p[1]]), p))
            left.remove(best)
            used.update(best)
            rows.append((frame["community"].iloc[0], len(rows) + 1, *best))
        return pd.DataFrame(rows, columns=["community", "position", "a", "b"])

    return counts.groupBy("community").applyInPandas(run, f"community {kind}, position int, a string, b string")


def shorten(text: Column, words: int = PASSAGE_WORDS) -> Column:
    """The first ``words`` words, and a sign where more follow."""
    parts = F.filter(F.split(F.coalesce(text, F.lit("")), r"\s+"), lambda w: w != "")
    return F.when(F.size(parts) > words, F.concat(F.array_join(F.slice(parts, 1, words), " "), F.lit(" [...]"))).otherwise(F.array_join(parts, " "))


def render_passage(number: Column, author: Column, title: Column, section: Column, first: Column, last: Column, text: Column) -> Column:
    head = F.concat(F.lit("[P"), number.cast("string"), F.lit("] "), F.upper(author), F.lit(" - "), F.coalesce(title, F.lit("")), F.lit(", "), F.coalesce(section, F.lit("")), F.lit(" (pp. "), first.cast("string"), F.lit("-"), last.cast("string"), F.lit(")"))
    return F.concat(head, F.lit("\n"), shorten(text))


def prompts(passages: DataFrame, keys: list[str], types: tuple[str, ...] = TYPES) -> DataFrame:
    """``keys, prompt`` from ``keys, author, position, rendered``: the passages of a call in order under the instructions."""
    ordered = F.array_sort(F.collect_list(F.struct("position", "rendered")))
    grouped = passages.groupBy(*keys).agg(F.min("author").alias("a"), F.max("author").alias("b"), F.array_join(F.transform(ordered, lambda p: p["rendered"]), "\n\n").alias("body"))
    return grouped.select(*keys, F.format_string(PROMPT, "a", "b", "body", F.lit(" | ".join(types))).alias("prompt"))


def ask(df: DataFrame, keys: list[str], prompt: str, provider: Callable, attempts: int = ATTEMPTS, usable: Callable[[str | None], bool] | None = None) -> DataFrame:
    """``keys, raw, error, attempts``: a model's answers. ``provider`` is a picklable factory of a function from a prompt to text.

    A call that fails, or whose answer ``usable`` does not take, is made again; the last answer and the last error are
    kept, other rows go on. A call that never gave an answer has a null ``raw``.
    """
    source = df.select(*keys, prompt)
    fields = ", ".join(f"{k} {dict(source.dtypes)[k]}" for k in keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = provider()
        for batch in batches:
            raws, errors, tries = [], [], []
            for p in batch.column(len(keys)).to_pylist():
                raw, error, n = None, None, 0
                while n < attempts:
                    n += 1
                    try:
                        raw, error = model(p), None
                    except Exception as e:  # noqa: BLE001 - a provider may fail in any way; the row says how
                        error = f"{type(e).__name__}: {e}"
                        continue
                    if usable is None or usable(raw):
                        break
                raws.append(raw)
                errors.append(error)
                tries.append(n)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keys)], pa.array(raws, pa.string()), pa.array(errors, pa.string()), pa.array(tries, pa.int32())], names=[*keys, "raw", "error", "attempts"])

    return source.mapInArrow(run, f"{fields}, raw string, error string, attempts int")


def call_report(calls: DataFrame) -> DataFrame:
    """One row: calls, those without an answer, repeated ones, and how many different errors there were."""
    return calls.agg(F.count(F.lit(1)).alias("calls"), F.count_if(F.col("raw").isNull()).alias("failed"), F.count_if(F.col("attempts") > 1).alias("repeated"), F.count_distinct("error").alias("errors"))


def labels(sources: Column, n_passages: Column) -> Column:
    """Valid passage numbers among labels such as ``P2`` or ``[P2]``: distinct, ascending, in range."""
    bare = F.transform(sources, lambda s: F.regexp_extract(F.regexp_replace(F.trim(s), r"^\[+|\]+$", ""), r"^P(\d+)$", 1))
    numbers = F.transform(F.filter(bare, lambda s: s != ""), lambda s: s.try_cast("int"))
    return F.array_sort(F.array_distinct(F.filter(numbers, lambda k: (k >= 1) & (k <= n_passages))))


def question_defect(question: Column, answer: Column, sources: Column, cited_authors: Column, pair: Column, n_passages: Column) -> Column:
    """Why a question is not taken, or null: empty, speaks of its passages, cites none, or not those of both authors."""
    text = F.trim(F.coalesce(question, F.lit("")))
    return (
        F.when((text == "") | (F.trim(F.coalesce(answer, F.lit(""))) == ""), "empty question or answer")
        .when(text.rlike(r"(?i)passage|\bp\d+\b"), "question refers to passages")
        .when(F.size(F.coalesce(labels(sources, n_passages), F.array().cast("array<int>"))) == 0, "no valid sources")
        .when(~F.coalesce(F.array_sort(F.array_distinct(cited_authors)) == F.array_sort(F.array_distinct(pair)), F.lit(False)), "sources do not cover both authors")
    )


def known_type(kind: Column, types: tuple[str, ...] = TYPES) -> Column:
    return F.when(kind.isin(*types), kind).otherwise("other")


def cite(answer: Column, citations: Column) -> Column:
    """``[P2]`` and ``P2`` as the second citation in brackets; labels out of range are taken away."""
    numbers = F.sequence(F.size(citations), F.lit(1), F.lit(-1))
    step = lambda text, k: F.regexp_replace(text, F.concat(F.lit(r"\[P"), k.cast("string"), F.lit(r"\]|\bP"), k.cast("string"), F.lit(r"\b")), F.concat(F.lit("["), F.element_at(citations, k), F.lit("]")))
    done = F.when(F.size(citations) > 0, F.aggregate(numbers, answer, step)).otherwise(answer)
    return F.regexp_replace(done, r"\[P\d+\]|\bP\d+\b", "")


def question_ids(accepted: DataFrame) -> DataFrame:
    """Adds ``id``: the community and the running number of its accepted questions. ``accepted`` has ``community, call_no, item_no``."""
    w = Window.partitionBy("community").orderBy("call_no", "item_no")
    return accepted.withColumn("id", F.concat(F.lit("c"), F.col("community").cast("string"), F.lit("-q"), F.row_number().over(w).cast("string")))


def first_topics(calls: DataFrame) -> DataFrame:
    """``community, topic``: of the first call that could be read, even if its questions were not taken."""
    return calls.where("parsed").groupBy("community").agg(F.min_by(F.coalesce("topic", F.lit("")), "call_no").alias("topic"))


def markdown_entry(key: Column, topic: Column, kind: Column, question: Column, answer: Column, sources: Column) -> Column:
    """One question as Markdown: what it is, the question, its answer and its sources (``array<struct<author, section, pages>>``)."""
    text = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    source = lambda s: F.concat(text(s["author"]), F.lit(", "), text(s["section"]), F.lit(" (pp. "), text(F.get(s["pages"], F.lit(0))), F.lit("-"), text(F.get(s["pages"], F.lit(1))), F.lit(")"))
    listed = F.array_join(F.transform(sources, source), "; ")
    head = F.concat_ws(" · ", key, text(topic), text(kind))
    return F.concat(F.lit("## "), head, F.lit("\n\n**Q:** "), F.trim(question), F.lit("\n\n**A:** "), F.trim(answer), F.lit("\n\n*Sources:* "), F.coalesce(listed, F.lit("")))


def markdown(df: DataFrame, group: str, text: Column, order: list[str]) -> DataFrame:
    """``group, markdown``: the entries of each group in order, joined by blank lines."""
    entries = df.select(group, F.struct(*order).alias("_o"), text.alias("_t"))
    made = entries.groupBy(group).agg(F.array_sort(F.collect_list(F.struct("_o", "_t"))).alias("_all"))
    return made.select(group, F.array_join(F.transform("_all", lambda x: x["_t"]), "\n\n").alias("markdown"))
