"""The search request: validation, leg sizes, and a lazy plan for each mode."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Protocol

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.operators import retrieval as R
from quire.operators.reranking import Reranker, with_scores
from quire.operators.text_index import TextIndex

MODES = ("keyword", "semantic", "hybrid")


@dataclass(frozen=True)
class SearchRequest:
    """A checked request. With recall_k the window of candidates is fixed and pages cut from it."""

    query: str
    mode: str = "hybrid"
    top_k: int = 10
    recall_k: int | None = None
    offset: int = 0
    rerank: bool = False
    backend: str = "native"
    filters: dict = field(default_factory=dict)

    def __post_init__(self) -> None:
        def need(ok: bool, what: str) -> None:
            if not ok:
                raise ValueError(what)

        object.__setattr__(self, "query", self.query.strip())
        need(0 < len(self.query) <= 1000, "query must have 1 to 1000 characters")
        need(self.mode in MODES, f"unknown mode {self.mode!r}")
        need(self.backend in ("native", "python"), f"unknown backend {self.backend!r}")
        need(1 <= self.top_k <= 50, "top_k must be 1..50")
        need(0 <= self.offset <= 499, "offset must be 0..499")
        if self.recall_k is None:
            need(self.offset == 0, "offset needs recall_k")
        else:
            need(1 <= self.recall_k <= 500, "recall_k must be 1..500")
            need(self.top_k <= self.recall_k, "top_k must not exceed recall_k")
            need(self.offset < self.recall_k, "offset must be below recall_k")
            need(self.backend == "native", "recall_k needs the native backend")

    @property
    def collapses(self) -> bool:
        """One hit a paper and its siblings: the native plan of hybrid mode, and of every mode with recall_k."""
        return self.recall_k is not None or (self.mode == "hybrid" and self.backend == "native")

    def papers(self) -> int:
        return self.recall_k or self.top_k + self.offset

    def leg_size(self) -> int:
        """Rows a leg hands on."""
        if self.collapses:
            return 5 * self.papers()
        fetch = self.fetch()
        return {"keyword": fetch, "semantic": 3 * fetch, "hybrid": 5 * fetch}[self.mode]

    def fetch(self) -> int:
        """Chunks that the plan without collapse keeps."""
        return min(self.papers() * R.RERANK_CANDIDATES, R.RERANK_LIMIT) if self.rerank else self.papers()


def filtered(chunks: DataFrame, request: SearchRequest) -> DataFrame:
    """Chunks that the request's filters leave, without reference sections unless it asks for them."""
    base = R.without_bibliography(chunks, bool(request.filters.get("include_references")))
    return base.where(R.build_filter({k: v for k, v in request.filters.items() if k != "include_references"}))


def _legs(
    base: DataFrame, request: SearchRequest, vector: list[float] | None, keyword_size: int | None, semantic_size: int, index: TextIndex | None
) -> list[tuple[str, DataFrame]]:
    """(name, doc_id with score and, if cut to a size, rank) of the legs of the request's mode."""
    out = []
    if request.mode != "semantic":
        boosts = {"title": 2.0, "text": 1.0}
        if index is None:
            scored = R.bm25_best_field(base, request.query, boosts, "chunk_id")
        else:
            scored = index.scores(request.query, boosts, filtered(index.documents(), request))
        out.append(("keyword", scored if keyword_size is None else R.top(scored, keyword_size)))
    if request.mode != "keyword":
        if vector is None:
            raise ValueError("semantic and hybrid search need the query's vector")
        out.append(("semantic", R.knn(base, vector, semantic_size, "chunk_id")))
    return out


def search_chunks(chunks: DataFrame, request: SearchRequest, vector: list[float] | None = None, weights: dict[str, float] | None = None, index: TextIndex | None = None) -> DataFrame:
    """Chunks with score, position (from 0) and is_primary, filters applied before any scoring.

    chunks: chunk_id, paper_id, title, text, section, embedding and the filter fields. The native plan
    fuses legs of five chunks a paper wanted, keeps the best papers by their best chunk and lets up to three
    (four for reranking) more chunks of each follow with that chunk's score. Otherwise chunks are kept as they come.
    With an index of the chunks (by chunk_id; fields title and text; the filter fields as attributes) the lexical leg
    reads no text.
    """
    base = filtered(chunks, request)
    legs = [(name, leg) for name, leg in _legs(base, request, vector, request.leg_size(), request.leg_size(), index)]
    if len(legs) == 1:
        fused = legs[0][1].select("doc_id", "score", (F.col("rank") - 1).alias("best_position"))
    else:
        both = legs[0][1].withColumn("leg", F.lit(legs[0][0])).unionByName(legs[1][1].withColumn("leg", F.lit(legs[1][0])))
        fused = R.rrf(both.select("leg", "doc_id", (F.col("rank") - 1).alias("position")), weights or {"keyword": 1.0, "semantic": 1.0})
    order = [F.desc("score"), F.asc("best_position"), F.asc("chunk_id")]
    fused = fused.withColumnRenamed("doc_id", "chunk_id")
    if not request.collapses:
        fused = fused.orderBy(*order).limit(request.fetch())
        placed = fused.withColumn("position", F.row_number().over(Window.orderBy(*order)) - 1).withColumn("is_primary", F.lit(True))  # a bounded window
        return base.drop("embedding").join(F.broadcast(placed.drop("best_position")), "chunk_id")
    rows = base.drop("embedding").join(F.broadcast(fused), "chunk_id")  # two legs of bounded size
    siblings = max(R.EVIDENCE, 4) if request.rerank else R.EVIDENCE
    rows = rows.withColumn("_at", F.row_number().over(Window.partitionBy("paper_id").orderBy(*order))).where(F.col("_at") <= siblings + 1)
    lead = F.struct(-F.col("score"), F.col("best_position"), F.col("chunk_id"))
    rows = rows.withColumn("_lead", F.min(lead).over(Window.partitionBy("paper_id")))
    rows = rows.withColumn("_paper", F.dense_rank().over(Window.orderBy("_lead"))).where(F.col("_paper") <= request.papers())  # bounded by the legs
    best = F.max("score").over(Window.partitionBy("paper_id"))
    rows = rows.withColumns({"score": best, "is_primary": F.col("_at") == 1, "position": F.row_number().over(Window.orderBy("_paper", "_at")) - 1})
    return rows.drop("_at", "_lead", "_paper", "best_position")


def search(
    chunks: DataFrame, request: SearchRequest, vector: list[float] | None = None, scorer: Column | None = None, index: TextIndex | None = None, reranker: Callable[[], Reranker] | None = None
) -> DataFrame:
    """Papers of a request: rank, paper_id, score, relevance, matched_chunks, evidence.

    A request that asks for it is reranked by a column, by a service (a function that makes one, see operators.reranking), or by the
    share of query terms.
    """
    hits = search_chunks(chunks, request, vector, index=index)
    if request.rerank:
        if reranker is not None:
            hits, scorer = with_scores(hits, request.query, reranker), F.col("service_score")
        hits = R.rerank(hits, scorer if scorer is not None else R.overlap_scorer(request.query), request.papers(), request.collapses)
        hits = hits.drop("position").withColumnRenamed("new_position", "position")
    else:
        hits = hits.withColumns({"retrieval_score": F.col("score"), "rerank_score": F.lit(None).cast("double")})
    papers = R.normalize_results(R.aggregate_papers(R.evidence_items(hits)), [])
    order = Window.orderBy(F.desc("score"), "first_position", "paper_id")  # papers of a bounded window
    ranked = papers.withColumn("rank", F.row_number().over(order).cast("int"))
    page = ranked.where((F.col("rank") > request.offset) & (F.col("rank") <= request.offset + request.top_k))
    return page.select("rank", "paper_id", "score", "relevance", "matched_chunks", "evidence")


#: Fields that an outcome's facets count papers by, where chunks have them.
FACETS = ("venue", "paper_type", "ieee_terms", "author_terms", "dynamic_index_terms", "source_tags")
#: Nearest chunks that count towards a total.
COUNT_K = 1000


def total(chunks: DataFrame, request: SearchRequest, vector: list[float] | None = None, index: TextIndex | None = None) -> DataFrame:
    """One row, total: distinct papers that the request's legs find; the vector leg is bounded by COUNT_K chunks."""
    base = filtered(chunks, request)
    ids = None
    for _, leg in _legs(base, request, vector, None, COUNT_K, index):
        ids = leg.select("doc_id") if ids is None else ids.union(leg.select("doc_id"))
    found = base.select("chunk_id", "paper_id").join(ids.withColumnRenamed("doc_id", "chunk_id"), "chunk_id", "left_semi")
    return R.total_papers(found)


def facets(chunks: DataFrame, request: SearchRequest) -> DataFrame:
    """facet, key, papers, place over the filtered chunks: terms by count, years in order."""
    base = filtered(chunks, request)
    out = R.facet_counts(base, [f for f in FACETS if f in chunks.columns])
    if "year" not in chunks.columns:
        return out
    years = base.select("paper_id", F.col("year").cast("int").alias("year")).where("year is not null").distinct().groupBy("year").agg(F.count("*").alias("papers"))
    place = F.row_number().over(Window.orderBy("year"))  # one row a year
    return out.unionByName(years.select(F.lit("year").alias("facet"), F.col("year").cast("string").alias("key"), "papers", place.alias("place")))


@dataclass(frozen=True)
class SearchOutcome:
    """What a request gives, each part a lazy plan."""

    papers: DataFrame
    total: DataFrame
    facets: DataFrame


def search_outcome(
    chunks: DataFrame, request: SearchRequest, vector: list[float] | None = None, scorer: Column | None = None, index: TextIndex | None = None
) -> SearchOutcome:
    return SearchOutcome(search(chunks, request, vector, scorer, index), total(chunks, request, vector, index), facets(chunks, request))


class Rewriter(Protocol):
    """Turns a query into another one; a model outside of this package."""

    def __call__(self, query: str) -> str: ...


def needs_rewrite(query: str, enabled: bool = True) -> bool:
    """Only short queries with a CJK character are rewritten."""
    return enabled and 0 < len(query.strip()) <= 300 and bool(re.search("[぀-ヿ㐀-䶿一-鿿가-힯]", query))


def rewrite(query: str, rewriter: Rewriter | None, enabled: bool = True) -> tuple[str, bool]:
    """The query to search for, and whether it was rewritten. A rewriter that fails or gives nothing leaves the query."""
    if rewriter is None or not needs_rewrite(query, enabled):
        return query, False
    try:
        lines = [x.strip().strip("\"'`") for x in rewriter(query).splitlines()]
    except (RuntimeError, ValueError, OSError, TimeoutError):
        return query, False
    new = next((x for x in lines if x), "")
    return (new, True) if new and len(new) <= 1000 and new != query else (query, False)
