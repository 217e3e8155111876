"""Retrieval over chunks: lexical and vector legs, fusion, collapse, rerank, evidence, facets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.functions.identifiers import identifier_form, normalize_arxiv_id, normalize_doi
from quire.functions.text import CJK, cjk_terms, index_terms, is_bibliography, is_noise, query_terms, truncate_text
from quire.functions.unicode import plain_text
from quire.functions.vectors import l2_score, literal

K1, B = 1.2, 0.75
RRF_K = 60
RERANK_CANDIDATES, RERANK_LIMIT = 5, 100
EVIDENCE, EVIDENCE_CHARS = 3, 500
HIGH, MEDIUM = 0.9, 0.6


# ---- filters


def build_filter(filters: dict) -> Column:
    """All fields must hold; within a list any value may.

    Blank values are ignored, single values stand for lists, doi and arxiv_id use their first value,
    `tag` takes precedence over `tags`, and unknown fields are ignored. Values are brought into the form in
    which they are stored: identifiers by their scheme, venues and tags as comparison keys, types in lower case.
    """

    def listed(value) -> list:
        items = value if isinstance(value, (list, tuple)) else [value]
        return [s for s in (str(x).strip() for x in items if x is not None) if s]

    def whole(value) -> int | None:
        try:
            return None if isinstance(value, bool) or value is None or str(value).strip() == "" else int(float(value))
        except (TypeError, ValueError):
            return None

    out = F.lit(True)
    low, high = whole(filters.get("year_from")), whole(filters.get("year_to"))
    if low is not None:
        out = out & (F.col("year") >= low)
    if high is not None:
        out = out & (F.col("year") <= high)
    for field, form in (("doi", normalize_doi), ("arxiv_id", normalize_arxiv_id)):
        if values := listed(filters.get(field)):
            wanted = form(F.lit(values[0]))
            out = out & (wanted.isNull() | (F.col(field) == wanted))
    if values := listed(filters.get("venue")):
        out = out & F.col("venue").isin([name_key(v) for v in values])
    if values := listed(filters.get("paper_type")):
        out = out & F.col("paper_type").isin([v.lower() for v in values])
    if years := [y for y in map(whole, listed(filters.get("venue_year"))) if y is not None]:
        out = out & F.col("venue_year").isin(years)
    many = {f: filters.get(f) for f in ("authors", "identifiers", "ieee_terms", "author_terms", "dynamic_index_terms", "source_tags")}
    many["tags"] = filters.get("tag") or filters.get("tags")
    for field, value in many.items():
        if values := listed(value):
            if field == "identifiers":
                wanted = [F.concat(F.lit(f"{s}:"), identifier_form(s, F.lit(v))) for s, v in (scheme_of(x) for x in values)]
            elif field == "authors":
                wanted = [F.lit(v) for v in values]
            else:
                wanted = [F.lit(name_key(v)[:128]) for v in values]
            out = out & F.arrays_overlap(F.col(field), F.array(*wanted))
    return F.coalesce(out, F.lit(False))


def name_key(value: str) -> str:
    """A venue's or tag's name as it is compared; names without a letter or digit fall back to lower case."""
    return plain_text(value) or value.strip().lower()


def scheme_of(entry: str) -> tuple[str, str]:
    """`scheme:value` in two, the scheme in lower case."""
    scheme, _, value = entry.partition(":")
    return scheme.strip().lower(), value


def without_bibliography(chunks: DataFrame, include_references: bool = False) -> DataFrame:
    """Chunks of reference sections are left out unless asked for; a missing section passes."""
    return chunks if include_references else chunks.where(~is_bibliography(F.col("section")))


# ---- lexical leg


def postings(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """term, doc_id, tf, length: one row for each distinct term of a document."""
    words = docs.select(F.col(doc_id).alias("doc_id"), index_terms(F.col(text)).alias("words"))
    counted = words.select("doc_id", F.size("words").alias("length"), F.explode("words").alias("term"))
    return counted.groupBy("doc_id", "length", "term").agg(F.count("*").alias("tf"))


def bm25(docs: DataFrame, query: str, doc_id: str = "doc_id", text: str = "text", k1: float = K1, b: float = B) -> DataFrame:
    """doc_id, score of documents with a term of the query."""
    return bm25_best_field(docs, query, {text: 1.0}, doc_id, k1, b)


def bm25_best_field(docs: DataFrame, query: str, fields: dict[str, float], doc_id: str = "doc_id", k1: float = K1, b: float = B) -> DataFrame:
    """doc_id, score: the largest of the boosted scores of several fields, for documents with a term of the query.

    For texts without an index (operators.text_index). Each text is read once: only the query's terms are counted in it, without arrays of its words. Documents
    without any term are summed up within their task, so one exchange carries the matching documents and
    a row for each task; both the statistics and the scores are worked out from it (Spark reuses the exchange).
    """
    words = query_terms(query)
    if not words:
        return docs.select(F.col(doc_id).alias("doc_id"), F.lit(0.0).alias("score")).limit(0)
    counted = docs.select(F.col(doc_id).alias("doc_id"), *(_spaced(F.col(f"`{f}`")).alias(f"t{i}") for i, f in enumerate(fields)))
    tf = {(i, j): f"f{i}_{j}" for i in range(len(fields)) for j in range(len(words))}
    length = [f"l{i}" for i in range(len(fields))]
    counted = counted.select(
        "doc_id",
        *(_times(F.col(f"t{i}"), " ").alias(c) for i, c in enumerate(length)),
        *(_times(F.col(f"t{i}"), f" {words[j]} ").alias(c) for (i, j), c in tf.items()),
    )
    # Two spaces between words: the number of words is half that of spaces.
    counted = counted.withColumns({c: F.expr(f"{c} div 2") for c in length})
    hit = F.greatest(F.lit(0), *tf.values()) > 0
    summed = counted.groupBy(F.when(hit, F.col("doc_id")).alias("doc_id"), F.when(~hit, F.spark_partition_id()).alias("task")).agg(
        F.count("*").alias("n"), *(F.sum(c).alias(c) for c in (*length, *tf.values()))
    )
    sums = summed.agg(
        F.sum("n").alias("n"), *(F.sum(c).alias(f"sum_{c}") for c in length), *(F.sum(F.when(F.col(c) > 0, F.col("n"))).alias(f"df_{c}") for c in tf.values())
    )
    rows = summed.where("task is null").drop("n").crossJoin(F.broadcast(sums))  # one row
    legs = []
    for i, (field, boost) in enumerate(fields.items()):
        score = F.lit(0.0)
        for j in range(len(words)):
            n, df, times = F.col("n"), F.col(f"df_{tf[i, j]}"), F.col(tf[i, j])
            idf = F.log(1 + (n - df + 0.5) / (df + 0.5))
            norm = times + k1 * (1 - b + b * F.col(length[i]) * n / F.col(f"sum_{length[i]}"))
            score = score + F.when(times > 0, idf * times * (k1 + 1) / norm).otherwise(0.0)
        found = F.greatest(F.lit(0), *(F.col(tf[i, j]) for j in range(len(words)))) > 0
        legs.append(F.when(found, score * boost))
    return rows.select("doc_id", (legs[0] if len(legs) == 1 else F.greatest(*legs)).alias("score"))


def _spaced(text: Column) -> Column:
    """Lower-cased terms, each with a space on either side."""
    text = F.coalesce(text.cast("string"), F.lit(""))
    words = F.trim(F.regexp_replace(F.lower(text), "[^\\p{L}\\p{N}]+", "  "))
    low = F.when(text.rlike(f"[{CJK}]"), F.array_join(cjk_terms(text), "  ")).otherwise(words)
    return F.when(low == "", F.lit("")).otherwise(F.concat(F.lit(" "), low, F.lit(" ")))


def _times(text: Column, part: str) -> Column:
    """How often a part occurs, by the length that dropping it takes away."""
    return ((F.char_length(text) - F.char_length(F.replace(text, F.lit(part), F.lit("")))) / len(part)).cast("long")


def top(scored: DataFrame, k: int, id_: str = "doc_id") -> DataFrame:
    """The k best by score, ties by id, with rank from 1: a top-k per task, merged."""
    best = scored.orderBy(F.desc("score"), id_).limit(k)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), id_)).cast("int"))  # at most k rows


# ---- vector leg


def knn(vectors: DataFrame, query: Sequence[float], k: int, id_: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """The k nearest by L2; score 1 / (1 + d^2). Filters belong on `vectors`, before this."""
    usable = vectors.where(F.size(vector) == len(query))
    return top(usable.select(F.col(id_).alias("doc_id"), l2_score(F.col(vector), literal(list(query))).alias("score")), k)


# ---- fusion


def rrf(legs: DataFrame, weights: dict[str, float], k: int = RRF_K) -> DataFrame:
    """Weighted reciprocal rank fusion of rows (leg, doc_id, position from 0).

    A repeated id counts once a leg, at its best position, but uses up positions. Weight 0 leaves an
    id in with score 0. Order: score, best position, id.
    """
    if k <= 0 or any(w < 0 for w in weights.values()):
        raise ValueError("k must be positive and weights not negative")
    weight = F.create_map(*(F.lit(x) for pair in weights.items() for x in pair))
    once = legs.groupBy("leg", "doc_id").agg(F.min("position").alias("position"))
    part = F.try_element_at(weight, F.col("leg")) / (k + F.col("position") + 1)
    return once.groupBy("doc_id").agg(F.sum(part).alias("score"), F.min("position").alias("best_position"))


def min_max(scored: DataFrame, by: list[str] | None = None, score: str = "score", into: str = "scaled") -> DataFrame:
    """Adds scores scaled to 0..1 over all rows, or within groups; 1.0 where all are equal; rounded to 6; null for null."""
    if by:
        w = Window.partitionBy(*by)
        rows = scored.withColumns({"_low": F.min(score).over(w), "_high": F.max(score).over(w)})
    else:
        ends = scored.agg(F.min(score).alias("_low"), F.max(score).alias("_high"))
        rows = scored.crossJoin(F.broadcast(ends))  # one row
    scaled = F.when(F.col("_high") == F.col("_low"), F.lit(1.0)).otherwise(F.round((F.col(score) - F.col("_low")) / (F.col("_high") - F.col("_low")), 6))
    return rows.withColumn(into, F.when(F.col(score).isNotNull(), scaled)).drop("_low", "_high")


def min_max_fusion(a: DataFrame, b: DataFrame, weights: tuple[float, float] = (0.5, 0.5)) -> DataFrame:
    """Weighted mean of two legs' scaled scores; a leg without the id counts as 0."""
    scaled = lambda leg, name: min_max(leg, into=name).select("doc_id", name)
    both = scaled(a, "a").join(scaled(b, "b"), "doc_id", "full_outer")
    total = (weights[0] * F.coalesce("a", F.lit(0.0)) + weights[1] * F.coalesce("b", F.lit(0.0))) / sum(weights)
    return both.select("doc_id", total.alias("score"))


# ---- collapse and paper level


def collapse(hits: DataFrame, group: str, siblings: int = 3, id_: str = "doc_id") -> DataFrame:
    """Best hit of each group and up to `siblings` more, which carry the best one's score.

    Adds place (0 for the best) and is_primary. Spark keeps only the first rows of a group before it
    shuffles.
    """
    w = Window.partitionBy(group).orderBy(F.desc("score"), id_)
    ranked = hits.withColumn("place", F.row_number().over(w) - 1).where(F.col("place") <= siblings)
    return ranked.withColumns({"score": F.max("score").over(Window.partitionBy(group)), "is_primary": F.col("place") == 0})


def first_papers(hits: DataFrame, limit: int, paper: str = "paper_id") -> DataFrame:
    """Rows of the first `limit` papers, papers in the order of their first position."""
    firsts = hits.groupBy(paper).agg(F.min("position").alias("first")).orderBy("first", paper).limit(limit)
    return hits.join(firsts.select(paper), paper, "left_semi")


PAPER_FIELDS = ("title", "authors", "year", "doi", "venue")


def aggregate_papers(hits: DataFrame, paper: str = "paper_id") -> DataFrame:
    """One row a paper: its best hit's score and fields, first position, matched chunks, best retrieval and rerank scores.

    Hits with an item (evidence_items) give the paper's evidence too.
    """
    named = hits.where(F.trim(F.coalesce(F.col(paper).cast("string"), F.lit(""))) != "")
    best = F.struct("score", -F.col("position"))
    return named.groupBy(paper).agg(
        F.max("score").alias("score"),
        F.min("position").alias("first_position"),
        F.count("*").alias("matched_chunks"),
        F.max("retrieval_score").alias("retrieval_score"),
        F.max("rerank_score").alias("rerank_score"),
        *(F.max_by(c, best).alias(c) for c in PAPER_FIELDS if c in hits.columns and c != paper),
        *([F.sort_array(F.collect_list("item")).alias("evidence")] if "item" in hits.columns else []),
    )


def relevance(score: Column) -> Column:
    return F.when(score >= HIGH, "high").when(score >= MEDIUM, "medium").otherwise("low")


def normalize_results(papers: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Scores as a share of the best one, to 4 digits; reranked papers keep theirs; adds relevance.

    With by=[] the rows are those of one request, few enough for one window.
    """
    if by is not None:
        rows = papers.withColumn("_best", F.max("score").over(Window.partitionBy(*(by or [F.lit(1)]))))
    else:
        rows = papers.crossJoin(F.broadcast(papers.agg(F.max("score").alias("_best"))))  # one row
    best = F.col("_best")
    score = F.when(best <= 0, F.lit(0.0)).when(F.col("rerank_score").isNotNull(), F.col("score")).otherwise(F.round(F.col("score") / best, 4))
    out = rows.withColumn("score", score)
    return out.withColumn("relevance", F.when(best <= 0, "low").otherwise(relevance(F.col("score")))).drop("_best")


def evidence_items(hits: DataFrame, paper: str = "paper_id", most: int = EVIDENCE, chars: int = EVIDENCE_CHARS) -> DataFrame:
    """Adds item, a struct for each of a paper's first three hits (prose before noise), else null."""
    noisy = is_noise(F.col("text"), F.col("section"), F.col("section_title"))
    place = F.row_number().over(Window.partitionBy(paper).orderBy(noisy, F.desc("score"), "position"))
    item = F.struct(
        "place",
        "chunk_id",
        F.col("page_start").alias("page"),
        F.coalesce("section_title", "section").alias("section"),
        truncate_text(F.col("text"), chars).alias("text"),
        "score",
    )
    return hits.withColumn("place", place).withColumn("item", F.when(F.col("place") <= most, item)).drop("place")


def evidence(hits: DataFrame, paper: str = "paper_id", most: int = EVIDENCE, chars: int = EVIDENCE_CHARS) -> DataFrame:
    """paper, evidence: array of up to three structs in order, prose before noise."""
    best = evidence_items(hits, paper, most, chars).where("item is not null")
    return best.groupBy(paper).agg(F.sort_array(F.collect_list("item")).alias("evidence"))


# ---- rerank


def overlap_scorer(query: str) -> Column:
    """A stand-in for a cross-encoder: share of the query's terms in the first 2000 characters."""
    words = query_terms(query)
    found = F.size(F.array_intersect(index_terms(F.substring("text", 1, 2000)), F.array(*(F.lit(w) for w in words))))
    return found / F.lit(float(max(1, len(words))))


def rerank(hits: DataFrame, scorer: Column | None, top_k: int, by_paper: bool = True) -> DataFrame:
    """Fold a reranker's raw scores into hits (chunk_id, paper_id, position, score, is_primary); adds new_position from 0.

    rerank_score is the raw score, retrieval_score the old one, score the raw one scaled to 0..1. By chunk:
    raw scores decide, ties by position; what the scorer leaves null keeps its standing after that; twice
    top_k stay. By paper: a paper stands where its best chunk of the pool stands, and that chunk leads
    it; papers that the pool or the scorer left out follow in their old order; all hits of the first top_k papers stay,
    with their leader's scores. Without a scorer the old order stays and rerank_score is null.
    """
    first = hits.withColumn("retrieval_score", F.col("score"))
    if "is_primary" not in hits.columns:
        first = first.withColumn("is_primary", F.lit(True))
    if scorer is None:
        kept = first_papers(first, top_k) if by_paper else first.orderBy("position").limit(2 * top_k)
        return kept.withColumns({"rerank_score": F.lit(None).cast("double"), "new_position": F.col("position")})
    # All windows here are over the hits of one request, which its legs bound; each hit is worked out once.
    everything = Window.partitionBy(F.lit(1))
    if not by_paper:
        scored = first.withColumn("rerank_score", scorer.cast("double"))
        order = Window.orderBy(F.desc_nulls_last("rerank_score"), "position")
        scored = scored.withColumn("score", _scaled(F.col("rerank_score"), F.col("score"), everything))
        return scored.withColumn("new_position", F.row_number().over(order) - 1).where(F.col("new_position") < 2 * top_k)
    near = F.row_number().over(Window.partitionBy("paper_id").orderBy("position")) <= RERANK_CANDIDATES
    rows = first.withColumn("_near", near)
    rows = rows.withColumn("_pool", F.col("_near") & (F.count_if("_near").over(Window.orderBy("position")) <= RERANK_LIMIT))
    rows = rows.withColumn("_raw", F.when(F.col("_pool"), scorer.cast("double")))
    lead = Window.partitionBy("paper_id").orderBy(F.desc_nulls_last("_raw"), F.when(F.col("_raw").isNull(), ~F.col("is_primary")), "position")
    of_paper = lead.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = rows.withColumns({"_n": F.row_number().over(lead), "_best": F.first("_raw").over(of_paper), "_at": F.first("position").over(of_paper), "_old": F.first("score").over(of_paper)})
    rows = rows.withColumn("_place", F.dense_rank().over(Window.orderBy(F.desc_nulls_last("_best"), "_at")))
    rows = rows.withColumns({"is_primary": F.col("_n") == 1, "retrieval_score": F.col("_old"), "rerank_score": F.col("_best"), "score": _scaled(F.col("_best"), F.col("_old"), everything)})
    rows = rows.where(F.col("_place") <= top_k)
    rows = rows.withColumn("new_position", F.row_number().over(Window.orderBy("_place", F.desc("is_primary"), "position")) - 1)
    return rows.drop("_near", "_pool", "_raw", "_n", "_best", "_at", "_old", "_place")


def _scaled(raw: Column, otherwise: Column, window) -> Column:
    low, high = F.min(raw).over(window), F.max(raw).over(window)
    return F.when(raw.isNull(), otherwise).when(high == low, F.lit(1.0)).otherwise(F.round((raw - low) / (high - low), 6))


# ---- facets and totals


def facet_key(value: Column, kind: T.DataType) -> Column:
    """How a facet's value is shown: whole numbers without a fraction."""
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        return F.when(value == F.floor(value), F.floor(value).cast("string")).otherwise(value.cast("string"))
    return value.cast("string")


def facet_counts(chunks: DataFrame, fields: list[str], paper: str = "paper_id", most: int = 50) -> DataFrame:
    """facet, key, papers, place: distinct papers by value (of lists by element), the first 50 of a field by count and key."""

    def cells(field: str) -> Column:
        kind = chunks.schema[field].dataType
        name = F.lit(field).alias("facet")
        if isinstance(kind, T.ArrayType):
            shown = F.transform(F.coalesce(F.col(field), F.array().cast(kind)), lambda v: F.struct(name, facet_key(v, kind.elementType).alias("key")))
            return shown
        return F.array(F.struct(name, facet_key(F.col(field), kind).alias("key")))

    pairs = chunks.select(paper, F.explode(F.flatten(F.array(*map(cells, fields)))).alias("c")).select(paper, "c.facet", "c.key").where("key is not null")
    counted = pairs.distinct().groupBy("facet", "key").agg(F.count("*").alias("papers"))
    w = Window.partitionBy("facet").orderBy(F.desc("papers"), "key")
    return counted.withColumn("place", F.row_number().over(w)).where(F.col("place") <= most)


def year_histogram(rows: DataFrame, year: Column) -> DataFrame:
    """year, papers by year, ascending; years without papers have no bucket."""
    return rows.select(year.cast("int").alias("year")).where("year is not null").groupBy("year").agg(F.count("*").alias("papers")).orderBy("year")


def total_papers(*legs: DataFrame, paper: str = "paper_id") -> DataFrame:
    """Distinct papers over the union of legs."""
    ids = legs[0].select(paper)
    for leg in legs[1:]:
        ids = ids.union(leg.select(paper))
    return ids.distinct().agg(F.count("*").alias("total"))
