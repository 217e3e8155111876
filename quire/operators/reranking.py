"""A reranker as a service: batches of passages, checked replies, and the first-stage order on any fault."""

from __future__ import annotations

import math
import numbers
from collections.abc import Callable, Sequence
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.functions.text import query_terms
from quire.operators.retrieval import RERANK_CANDIDATES, RERANK_LIMIT

#: Characters of a passage that a reranker sees, and passages in one call.
PASSAGE_CHARS, BATCH = 2000, 16


class Reranker(Protocol):
    """Scores of passages for a query, as (index, score) in any order; a model outside of this package."""

    def __call__(self, query: str, passages: list[str]) -> Sequence[tuple[int, float]]: ...


class BadReply(ValueError):
    """A reply that does not give each passage one score."""


def checked_scores(reply: Sequence, n: int) -> list[float]:
    """The scores in the order of the passages; BadReply for a wrong count, a repeated, missing or foreign index, or a score that is no finite number."""
    try:
        pairs = [(item["index"], item["score"]) if isinstance(item, dict) else tuple(item) for item in reply]
    except (TypeError, KeyError) as fault:
        raise BadReply("not a list of index and score") from fault
    if len(pairs) != n or any(len(p) != 2 for p in pairs):
        raise BadReply(f"{len(pairs)} scores for {n} passages")
    scores: list[float | None] = [None] * n
    for index, score in pairs:
        if isinstance(index, bool) or not isinstance(index, numbers.Integral) or not 0 <= index < n or scores[index] is not None:
            raise BadReply(f"bad index {index!r}")
        if isinstance(score, bool) or not isinstance(score, numbers.Real) or not math.isfinite(score):
            raise BadReply(f"bad score {score!r}")
        scores[index] = float(score)
    return scores


#: One reranker a Python worker, made when it is first asked for.
_made: dict[Callable, Reranker] = {}


def _service(factory: Callable[[], Reranker]) -> Reranker:
    if factory not in _made:
        _made[factory] = factory()
    return _made[factory]


def with_scores(hits: DataFrame, query: str, factory: Callable[[], Reranker], batch: int = BATCH) -> DataFrame:
    """Adds service_score to the hits of one request: chunk_id, paper_id, position, text.

    Scored are the first five chunks of a paper, up to 100 in all, in order of position; others have null. If the service fails
    or answers badly in any batch, all have null, so that the first-stage order stands. factory must be importable by workers.
    """
    near = F.row_number().over(Window.partitionBy("paper_id").orderBy("position")) <= RERANK_CANDIDATES
    marked = hits.select("chunk_id", "position", F.substring("text", 1, PASSAGE_CHARS).alias("text"), near.alias("near"))
    pool = marked.where("near").orderBy("position").limit(RERANK_LIMIT)

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("position", kind="stable")
        texts = [t or "" for t in rows.text]
        scores: list[float | None] = []
        try:
            ask = _service(factory)
            for at in range(0, len(texts), batch):
                some = texts[at : at + batch]
                scores += checked_scores(ask(query, some), len(some))
        except (RuntimeError, ValueError, TypeError, OSError, ArithmeticError, LookupError):
            scores = [None] * len(texts)
        return pd.DataFrame({"chunk_id": rows.chunk_id, "service_score": pd.array(scores, "Float64")})

    kind = hits.schema["chunk_id"].dataType.simpleString()
    scored = pool.groupBy(F.lit("all")).applyInPandas(run, f"chunk_id {kind}, service_score double")  # at most RERANK_LIMIT rows
    return hits.join(F.broadcast(scored), "chunk_id", "left")


class Overlap:
    """A stand-in for a cross-encoder: the share of the query's terms that a passage holds."""

    def __call__(self, query: str, passages: list[str]) -> list[tuple[int, float]]:
        words = query_terms(query)
        return [(k, len(set(words) & set(query_terms(p))) / max(1, len(words))) for k, p in enumerate(passages)]
