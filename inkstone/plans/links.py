"""Queries over similar chunks and their communities. Vectors stand for chunks, works for documents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkstone.functions.vector import centroid
from inkstone.operators import community as M
from inkstone.operators import questions as Q
from inkstone.operators import similarity as S
from inkstone.plans.base import chunks, chunks_sql
from inkstone.session import cut, release
from inkstone.session import read_table as table

MODEL = "lumen-embed-1"
#: Score of the links whose components stand for communities where SQL has to follow.
STRONG = 0.5
PIVOT = ("Braquoth", "Haldwirne", "Odrmoth", "Ystmol")


def _vectors(spark: SparkSession, sf: str) -> DataFrame:
    """``id, doc, raw, unit`` of one model, for chunks that have a work."""
    v = table(spark, sf, "vectors").where((F.col("model") == MODEL) & (F.size("embedding") == 128) & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x)))
    joined = v.join(chunks(spark, sf, "doc").where("doc IS NOT NULL"), "chunk_id")
    return S.cut_vectors(S.usable_vectors(joined, "vec_id", "doc", "embedding"))


def _nodes(spark: SparkSession, sf: str, vectors: DataFrame) -> DataFrame:
    """``id, author`` for each vector; the author of a work is its first in the table of works, or the work itself."""
    works = table(spark, sf, "corpus").where("doc IS NOT NULL").groupBy("doc").agg(F.min("author").alias("a"))
    return vectors.select("id", "doc").join(works, "doc", "left").select("id", F.coalesce("a", "doc").alias("author"))


def cross_pairs_stats(spark: SparkSession, sf: str) -> DataFrame:
    s = S.cross_statistics(_vectors(spark, sf))
    return s.select("pairs", *[F.round(c, 6).alias(c) for c in ("threshold", "min_score", "median_score", "max_score")])


def similarity_histogram(spark: SparkSession, sf: str) -> DataFrame:
    return S.cross_histogram(_vectors(spark, sf))


def top_neighbours(spark: SparkSession, sf: str) -> DataFrame:
    return S.top_partners(_vectors(spark, sf)).select("id", "other", "rank", F.round("score", 6).alias("score"))


def _links(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    v = _vectors(spark, sf)
    links = cut(S.cross_links(v))
    release(spark)
    return links, _nodes(spark, sf, v)


def cross_links(spark: SparkSession, sf: str) -> DataFrame:
    return S.cross_links(_vectors(spark, sf)).select("a", "b", F.round("score", 4).alias("score"))


def links_per_pair(spark: SparkSession, sf: str) -> DataFrame:
    links, nodes = _links(spark, sf)
    return S.links_per_pair(S.with_authors(links, nodes)).select("pair", "n", F.round("best", 4).alias("best"))


def strongest_links(spark: SparkSession, sf: str) -> DataFrame:
    links, _ = _links(spark, sf)
    return links.select("a", "b", F.round("score", 4).alias("score")).orderBy(F.desc("score"), "a", "b").limit(25)


def links_by_author_pair(spark: SparkSession, sf: str) -> DataFrame:
    links, nodes = _links(spark, sf)
    return S.between(S.with_authors(links.withColumn("score", F.round("score", 4)), nodes), "Ystmol", "Braquoth")


def unlinked_chunks(spark: SparkSession, sf: str) -> DataFrame:
    links, nodes = _links(spark, sf)
    return S.unlinked(nodes, links)


def components(spark: SparkSession, sf: str) -> DataFrame:
    links, nodes = _links(spark, sf)
    return M.components(nodes, links)


def _component_communities(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Strong links only, so that components are of many sizes."""
    links, nodes = _links(spark, sf)
    strong = links.where(F.col("score") >= STRONG)
    return cut(M.components(nodes, strong).select("id", F.col("component").alias("community"))), strong, nodes


def leiden_assign(spark: SparkSession, sf: str) -> DataFrame:
    links, nodes = _links(spark, sf)
    return M.leiden_communities(nodes, links).select("id", "community")


def leiden_sweep(spark: SparkSession, sf: str) -> DataFrame:
    links, nodes = _links(spark, sf)
    return M.sweep(M.leiden_communities(nodes, links, M.RESOLUTIONS), nodes)


def leiden_modularity(spark: SparkSession, sf: str) -> DataFrame:
    links, nodes = _links(spark, sf)
    return M.modularity(cut(M.leiden_communities(nodes, links, M.RESOLUTIONS)), links)


def community_modularity(spark: SparkSession, sf: str) -> DataFrame:
    assigned, strong, _ = _component_communities(spark, sf)
    return M.modularity(assigned.withColumn("resolution", F.lit(1.0)), strong).select("resolution", F.round("modularity", 6).alias("modularity"))


def community_members(spark: SparkSession, sf: str) -> DataFrame:
    assigned, _, nodes = _component_communities(spark, sf)
    return M.members(assigned, nodes)


def community_summary(spark: SparkSession, sf: str) -> DataFrame:
    assigned, _, nodes = _component_communities(spark, sf)
    return M.summary(assigned, nodes)


def community_top10(spark: SparkSession, sf: str) -> DataFrame:
    assigned, _, nodes = _component_communities(spark, sf)
    return M.ranked(assigned, nodes)


def community_examples(spark: SparkSession, sf: str) -> DataFrame:
    assigned, _, nodes = _component_communities(spark, sf)
    return M.examples(assigned, nodes)


def community_pivot(spark: SparkSession, sf: str) -> DataFrame:
    """Chunks of each community by author, one column for each of four authors and one for the rest."""
    assigned, _, nodes = _component_communities(spark, sf)
    who = F.when(F.col("author").isin(*PIVOT), F.col("author")).otherwise("others")
    counts = assigned.join(nodes, "id").withColumn("who", who).groupBy("community").pivot("who", [*PIVOT, "others"]).agg(F.count(F.lit(1)))
    return counts.fillna(0)


def community_links(spark: SparkSession, sf: str) -> DataFrame:
    assigned, strong, _ = _component_communities(spark, sf)
    return M.with_inner_links(assigned, strong).select("community", "id", "n_links", F.round("strongest", 4).alias("strongest"))


def _members(spark: SparkSession, sf: str) -> DataFrame:
    """``community, author, id, unit``: linked chunks of the communities of strong links."""
    v = _vectors(spark, sf)
    nodes = _nodes(spark, sf, v)
    strong = cut(S.cross_links(v)).where(F.col("score") >= STRONG)
    assigned = cut(M.components(nodes, strong).select("id", F.col("component").alias("community")))
    return assigned.join(nodes, "id").join(v.select("id", "unit"), "id").select("community", "author", "id", "unit")


def community_centroid(spark: SparkSession, sf: str) -> DataFrame:
    c = centroid(_members(spark, sf), ["community"], "unit")
    return c.select("community", F.posexplode("centroid").alias("pos", "x")).select("community", "pos", (F.round("x", 6) + 0.0).alias("x"))


def central_passages(spark: SparkSession, sf: str) -> DataFrame:
    return Q.central_passages(_members(spark, sf)).withColumn("score", F.round("score", 6))


def _author_counts(spark: SparkSession, sf: str) -> DataFrame:
    assigned, _, nodes = _component_communities(spark, sf)
    return assigned.join(nodes, "id").groupBy("community", "author").agg(F.count(F.lit(1)).alias("n"))


def author_pairs(spark: SparkSession, sf: str) -> DataFrame:
    return Q.first_pairs(cut(_author_counts(spark, sf)))


def author_pairs_chosen(spark: SparkSession, sf: str) -> DataFrame:
    return Q.choose_pairs(_author_counts(spark, sf))


ALL = (cross_pairs_stats, similarity_histogram, top_neighbours, cross_links, links_per_pair, strongest_links, links_by_author_pair, unlinked_chunks, components, leiden_assign, leiden_sweep, leiden_modularity, community_modularity, community_members, community_summary, community_top10, community_examples, community_pivot, community_links, community_centroid, central_passages, author_pairs, author_pairs_chosen)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in ALL}


PAIRS = (
    "WITH RECURSIVE "
    + chunks_sql("doc")
    + """, v AS (SELECT vec_id AS id, arg_min(embedding, doc)::DOUBLE[] AS e, min(doc) AS doc FROM vectors JOIN c USING (chunk_id) WHERE model = 'lumen-embed-1' AND doc IS NOT NULL AND len(embedding) = 128
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0 GROUP BY vec_id),
u AS MATERIALIZED (SELECT id, doc, list_transform(e, lambda x: x / sqrt(list_dot_product(e, e))) AS unit FROM v),
s AS MATERIALIZED (SELECT x.id AS a, y.id AS b, list_dot_product(x.unit, y.unit) AS score FROM u x JOIN u y ON x.id < y.id AND x.doc <> y.doc),
thr AS (SELECT quantile_cont(score, 0.9) AS threshold FROM s),
two AS (SELECT a AS id, b AS other, score FROM s UNION ALL SELECT b, a, score FROM s),
top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, other) AS rank FROM two) WHERE rank <= 10),
links AS MATERIALIZED (SELECT DISTINCT least(id, other) AS a, greatest(id, other) AS b, score FROM top, thr WHERE score >= threshold),
works AS (SELECT doc, min(author) AS w FROM corpus GROUP BY doc),
nodes AS (SELECT id, coalesce(w, doc) AS author FROM u LEFT JOIN works USING (doc)),
named AS (SELECT a, b, score, x.author AS author_a, y.author AS author_b FROM links JOIN nodes x ON x.id = a JOIN nodes y ON y.id = b)
"""
)
REACH = """, strong AS (SELECT * FROM links WHERE score >= {limit}), ends AS (SELECT a AS id, b AS o FROM strong UNION SELECT b, a FROM strong),
reach AS (SELECT id, id AS r FROM nodes UNION SELECT reach.id, ends.o FROM reach JOIN ends ON ends.id = reach.r),
comp AS (SELECT id, min(r) AS community FROM reach GROUP BY id)
"""
COMMUNITY = PAIRS + REACH.format(limit=0.5) + """, sized AS (SELECT community, count(*) AS size, count(DISTINCT author) AS n_authors FROM comp JOIN nodes USING (id) GROUP BY community)
"""
MEMBERS = COMMUNITY.rstrip() + """,
k AS MATERIALIZED (SELECT community, author, id, unit FROM comp JOIN nodes USING (id) JOIN u USING (id)),
m AS (SELECT community, pos, avg(x) AS x FROM (SELECT community, unnest(range(len(unit)::BIGINT)) AS pos, unnest(unit) AS x FROM k) GROUP BY ALL)
"""


def oracle_sql() -> dict[str, str]:
    return {
        "cross_pairs_stats": PAIRS + "SELECT count(*) AS pairs, round(any_value(threshold), 6) AS threshold, round(min(score), 6) AS min_score, round(median(score), 6) AS median_score, round(max(score), 6) AS max_score FROM s, thr",
        "similarity_histogram": PAIRS + "SELECT least(59, greatest(0, floor((score + 1) * 30)))::BIGINT AS bin, count(*) AS n FROM s GROUP BY 1",
        "top_neighbours": PAIRS + "SELECT id, other, rank::INT AS rank, round(score, 6) AS score FROM top",
        "cross_links": PAIRS + "SELECT a, b, round(score, 4) AS score FROM links",
        "links_per_pair": PAIRS + "SELECT least(author_a, author_b) || ' - ' || greatest(author_a, author_b) AS pair, count(*) AS n, round(max(score), 4) AS best FROM named GROUP BY 1",
        "strongest_links": PAIRS + "SELECT a, b, round(score, 4) AS score FROM links ORDER BY round(score, 4) DESC, a, b LIMIT 25",
        "links_by_author_pair": PAIRS + "SELECT a, b, round(score, 4) AS score, author_a, author_b FROM named WHERE (author_a = 'Ystmol' AND author_b = 'Braquoth') OR (author_a = 'Braquoth' AND author_b = 'Ystmol') ORDER BY round(score, 4) DESC, a, b LIMIT 25",
        "unlinked_chunks": PAIRS + "SELECT id FROM nodes WHERE id NOT IN (SELECT a FROM links UNION SELECT b FROM links)",
        "components": PAIRS + REACH.format(limit=-2) + "SELECT id, community AS component FROM comp",
        "community_modularity": COMMUNITY + """, m AS (SELECT sum(score) AS m FROM strong), k AS (SELECT id, sum(score) AS k FROM (SELECT a AS id, score FROM strong UNION ALL SELECT b, score FROM strong) GROUP BY id),
            vol AS (SELECT community, sum(k) AS k FROM comp JOIN k USING (id) GROUP BY community),
            ins AS (SELECT x.community, sum(score) AS w FROM strong JOIN comp x ON x.id = a JOIN comp y ON y.id = b WHERE x.community = y.community GROUP BY 1)
            SELECT 1.0::DOUBLE AS resolution, round(sum(coalesce(w, 0) / m - pow(k / (2 * m), 2)), 6) AS modularity FROM vol LEFT JOIN ins USING (community), m""",
        "community_members": COMMUNITY + """SELECT community, count(*) AS size, count(DISTINCT author)::INT AS n_authors, string_agg(DISTINCT author, ',' ORDER BY author) AS authors, count(DISTINCT author) > 1 AS cross_document,
            string_agg(id::VARCHAR, ',' ORDER BY id) AS members FROM comp JOIN nodes USING (id) GROUP BY community""",
        "community_summary": COMMUNITY + """SELECT count_if(n_authors >= 2)::BIGINT AS cross_document, count_if(n_authors < 2 AND size > 1)::BIGINT AS single_author, count_if(size = 1)::BIGINT AS isolated,
            coalesce(sum(size) FILTER (n_authors >= 2), 0)::BIGINT AS chunks_in_cross, min(size) FILTER (n_authors >= 2) AS min_size, median(size) FILTER (n_authors >= 2) AS median_size, max(size) FILTER (n_authors >= 2) AS max_size FROM sized""",
        "community_top10": COMMUNITY + "SELECT community, size, n_authors FROM sized ORDER BY n_authors DESC, size DESC, community LIMIT 10",
        "community_examples": COMMUNITY + "SELECT community, author, count(*) AS n, min(id) AS example FROM comp JOIN nodes USING (id) GROUP BY ALL",
        "community_pivot": COMMUNITY + "SELECT community, " + ", ".join(f"count(*) FILTER (author = '{a}') AS {a}" for a in PIVOT) + ", count(*) FILTER (author NOT IN (" + ", ".join(f"'{a}'" for a in PIVOT) + ")) AS others FROM comp JOIN nodes USING (id) GROUP BY community",
        "community_links": COMMUNITY + """, e AS (SELECT a AS id, score FROM strong UNION ALL SELECT b, score FROM strong)
            SELECT community, id, count(score) AS n_links, round(max(score), 4) AS strongest FROM comp LEFT JOIN e USING (id) GROUP BY ALL""",
        "community_centroid": MEMBERS + "SELECT community, pos::INT AS pos, round(x, 6) + 0.0 AS x FROM m",
        "central_passages": MEMBERS + """, middle AS (SELECT community, list(x ORDER BY pos) AS c FROM m GROUP BY community)
            SELECT community, author, id, round(score, 6) AS score, rank FROM (SELECT community, author, id, list_dot_product(unit, c) AS score, (row_number() OVER (PARTITION BY community, author ORDER BY round(list_dot_product(unit, c), 9) DESC, id))::INT AS rank FROM k JOIN middle USING (community)) WHERE rank <= 2""",
        "author_pairs_chosen": COMMUNITY.rstrip() + """,
            n AS (SELECT community, author, count(*) AS n FROM comp JOIN nodes USING (id) GROUP BY ALL), pr AS MATERIALIZED (SELECT x.community, x.author AS a, y.author AS b, x.n + y.n AS n FROM n x JOIN n y ON x.community = y.community AND x.author < y.author),
            p1 AS MATERIALIZED (SELECT * FROM pr QUALIFY row_number() OVER (PARTITION BY community ORDER BY n DESC, a, b) = 1),
            r2 AS (SELECT pr.*, (pr.a IN (p1.a, p1.b))::INT + (pr.b IN (p1.a, p1.b))::INT AS used FROM pr JOIN p1 USING (community) WHERE NOT (pr.a = p1.a AND pr.b = p1.b)),
            p2 AS MATERIALIZED (SELECT * FROM r2 QUALIFY row_number() OVER (PARTITION BY community ORDER BY used, n DESC, a, b) = 1),
            r3 AS (SELECT pr.*, (pr.a IN (p1.a, p1.b, p2.a, p2.b))::INT + (pr.b IN (p1.a, p1.b, p2.a, p2.b))::INT AS used FROM pr JOIN p1 USING (community) JOIN p2 USING (community) WHERE NOT (pr.a = p1.a AND pr.b = p1.b) AND NOT (pr.a = p2.a AND pr.b = p2.b)),
            p3 AS (SELECT * FROM r3 QUALIFY row_number() OVER (PARTITION BY community ORDER BY used, n DESC, a, b) = 1)
            SELECT community, 1 AS position, a, b FROM p1 UNION ALL SELECT community, 2, a, b FROM p2 UNION ALL SELECT community, 3, a, b FROM p3""",
        "author_pairs": COMMUNITY + """, n AS (SELECT community, author, count(*) AS n FROM comp JOIN nodes USING (id) GROUP BY ALL)
            SELECT x.community, x.author AS a, y.author AS b FROM n x JOIN n y ON x.community = y.community AND x.author < y.author QUALIFY row_number() OVER (PARTITION BY x.community ORDER BY x.n + y.n DESC, x.author, y.author) = 1""",
    }
