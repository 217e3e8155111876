"""Bibliographic records: deduplication, matching, merging by authority, the claim ledger, conflicts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions.text import title_overlap

#: How far a source is trusted.
AUTHORITY = {
    "manual": 3, "ieee_api": 2, "arxiv_api": 2, "crossref": 2, "import_file": 2,
    "pdf_embedded": 1, "pdf_heuristic": 0, "filename": 0,
}
LOCAL_SOURCES = ("pdf_embedded", "pdf_heuristic", "filename")
HISTORY_ONLY = ("pdf_heuristic", "manual")
STRUCTURED = ("ieee_api", "arxiv_api", "crossref", "import_file")
#: Identifier schemes that decide a match, in order.
MATCH_SCHEMES = ("doi", "arxiv", "ieee_article_number")


def authority(source_type: Column, field: Column) -> Column:
    """Rank of a source; page text counts more for titles. Unknown sources have none."""
    table = F.create_map(*(F.lit(x) for pair in AUTHORITY.items() for x in pair))
    key = F.lower(F.trim(source_type))
    return F.when((field == "title") & (key == "pdf_heuristic"), 1).otherwise(F.try_element_at(table, key))


def dedupe(rows: DataFrame, key: str, *order: Column) -> DataFrame:
    """The first row of each key by `order`; rows of a key beyond are discarded. Null keys stay."""
    w = Window.partitionBy(key).orderBy(*order)
    keyed = rows.where(F.col(key).isNotNull()).withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
    return keyed.unionByName(rows.where(F.col(key).isNull()))


def ingest(known: DataFrame, incoming: DataFrame, key: str = "fingerprint", *order: Column) -> tuple[DataFrame, DataFrame]:
    """(taken, discarded): of each new fingerprint the first row comes in; rows whose fingerprint is known go."""
    fresh = dedupe(incoming.join(known.select(key).distinct(), key, "left_anti"), key, *(order or (F.asc("id"),)))
    return fresh, incoming.join(fresh.select("id"), "id", "left_anti")


def upgrade_fingerprints(papers: DataFrame, better: DataFrame) -> DataFrame:
    """papers (id, fingerprint, created_at) with better fingerprints (id, fingerprint) where nobody else has them.

    Of several papers that would get one fingerprint the oldest gets it; the others keep theirs.
    """
    new = better.select("id", F.col("fingerprint").alias("_new"))
    rows = papers.join(new, "id", "left")
    taken = papers.select(F.col("fingerprint").alias("_new"), F.col("id").alias("_owner")).groupBy("_new").agg(F.min("_owner").alias("_owner"))
    rows = rows.join(taken, "_new", "left")
    first = F.row_number().over(Window.partitionBy("_new").orderBy("created_at", "id")) == 1
    free = F.col("_new").isNotNull() & (F.col("_owner").isNull() | (F.col("_owner") == F.col("id")))
    rows = rows.withColumn("_ok", free & F.when(F.col("_new").isNotNull(), first).otherwise(False))
    return rows.withColumn("fingerprint", F.when(F.col("_ok"), F.col("_new")).otherwise(F.col("fingerprint"))).select(*papers.columns)


def latest(rows: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """Upsert by union: the latest row of each key wins."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def primary_file(files: DataFrame, kind_order: list[str]) -> DataFrame:
    """The live file of each paper with the best kind, then the earliest."""
    place = F.array_position(F.array(*(F.lit(k) for k in kind_order)), F.col("kind"))
    best = F.when(place > 0, place).otherwise(len(kind_order) + 1)
    return latest(files.where("deleted_at is null"), ["paper_id"], best.asc(), F.asc("created_at"), F.asc("id"))


def compatible_titles(a: Column, b: Column) -> Column:
    """Normalized titles that are equal, contain one another, or share 0.6 of the smaller one's words."""
    known = (F.coalesce(a, F.lit("")) != "") & (F.coalesce(b, F.lit("")) != "")
    return known & ((a == b) | F.contains(a, b) | F.contains(b, a) | (title_overlap(a, b) >= 0.6))


def match_records(records: DataFrame, papers: DataFrame, identifiers: DataFrame, files: DataFrame) -> DataFrame:
    """record_id, status, method, confidence, paper_id: the first step that decides each record.

    records: record_id, source_type, title (normalized), first_author (normalized), year, identifiers
    map<scheme, normalized value>, sha256, filename, exclude_paper_id. papers: id, title
    (normalized), first_author (normalized), year, filename_doi, all live. identifiers: paper_id,
    scheme, normalized_value. files: paper_id, sha256, filename (normalized).

    A match by identifier is named after the scheme that comes first among those that hit.
    Each step is an equi-join that gives (record, candidate) rows; steps are united and the least
    one wins. Several candidates make a match ambiguous. Titles are compared by equality of their
    normalized form, so no pair of unlike titles is ever formed.
    """
    live = papers.select(F.col("id").alias("paper_id"), F.col("title").alias("p_title"), F.col("first_author").alias("p_author"), F.col("year").alias("p_year"), "filename_doi")
    not_self = F.col("paper_id") != F.coalesce("exclude_paper_id", F.lit(""))
    ids = records.select("record_id", "exclude_paper_id", F.explode("identifiers").alias("scheme", "normalized_value")).where(F.col("scheme").isin(*MATCH_SCHEMES))
    by_id = (
        ids.join(identifiers.select("paper_id", "scheme", "normalized_value"), ["scheme", "normalized_value"])
        .where(not_self)
        .join(live.select("paper_id"), "paper_id", "left_semi")
        .groupBy("record_id", "paper_id")
        .agg(F.min(F.array_position(F.array(*map(F.lit, MATCH_SCHEMES)), F.col("scheme"))).alias("by"))
        .withColumn("step", F.lit(1))
    )
    by_sha = (
        records.where(F.length("sha256") == 64)
        .select("record_id", "exclude_paper_id", "sha256")
        .join(files.select("paper_id", "sha256"), "sha256")
        .where(not_self)
        .select("record_id", "paper_id")
        .distinct()
        .withColumn("step", F.lit(2))
    )
    doi = F.try_element_at("identifiers", F.lit("doi"))
    by_file_doi = (
        records.select("record_id", "exclude_paper_id", doi.alias("filename_doi"))
        .join(live.select("paper_id", "filename_doi"), "filename_doi")
        .where(not_self)
        .select("record_id", "paper_id")
        .withColumn("step", F.lit(3))
    )
    by_title = (
        records.where(F.coalesce("title", F.lit("")) != "")
        .select("record_id", "exclude_paper_id", F.col("title").alias("p_title"))
        .join(live.select("paper_id", "p_title"), "p_title")
        .where(not_self)
        .select("record_id", "paper_id")
        .withColumn("step", F.lit(4))
    )
    by_name = (
        records.where(F.coalesce("filename", F.lit("")) != "")
        .select("record_id", "exclude_paper_id", "filename")
        .join(files.select("paper_id", "filename"), "filename")
        .where(not_self)
        .select("record_id", "paper_id")
        .distinct()
        .withColumn("step", F.lit(5))
    )
    candidates = by_sha.unionByName(by_file_doi).unionByName(by_title).unionByName(by_name).unionByName(by_id, allowMissingColumns=True)
    about = records.select("record_id", "source_type", "title", "first_author", "year", doi.alias("doi"), "sha256")
    paper_doi = identifiers.where("scheme = 'doi'").groupBy("paper_id").agg(F.min("normalized_value").alias("p_doi"))
    rows = candidates.join(about, "record_id").join(live, "paper_id").join(paper_doi, "paper_id", "left")
    other_doi = lambda c: F.col("doi").isNotNull() & F.col(c).isNotNull() & (F.col("doi") != F.col(c))
    by_name = F.coalesce(F.col("doi") == F.col("filename_doi"), F.lit(False))
    strangers = ~by_name & F.col("doi").isNotNull() & F.col("sha256").isNull() & ~compatible_titles(F.col("title"), F.col("p_title")) & (title_overlap(F.col("title"), F.col("p_title")) == 0)
    conflict = F.coalesce(other_doi("filename_doi") | other_doi("p_doi") | strangers, F.lit(False))
    structured = F.lower("source_type").isin(*STRUCTURED)
    agrees = structured | F.coalesce(compatible_titles(F.col("title"), F.col("p_title")), F.lit(False)) | by_name
    sure = F.coalesce((F.col("first_author") == F.col("p_author")) & (F.col("year") == F.col("p_year")), F.lit(False))
    rows = rows.withColumns({"conflict": conflict, "agrees": agrees, "structured": structured, "sure": sure})
    decided = rows.groupBy("record_id", "step").agg(
        F.count("*").alias("n"),
        F.min("paper_id").alias("paper_id"),
        F.min("by").alias("by"),
        F.bool_or("conflict").alias("conflict"),
        F.bool_and("agrees").alias("agrees"),
        F.bool_and("structured").alias("structured"),
        F.count_if("sure").alias("n_sure"),
        F.min(F.when(F.col("sure"), F.col("paper_id"))).alias("sure_paper"),
        F.bool_or(F.col("sure") & F.col("conflict")).alias("sure_conflict"),
    )
    first = latest(decided, ["record_id"], F.asc("step"))
    one, step = F.col("n") == 1, F.col("step")
    matched = (
        ((step == 1) & one & ~F.col("conflict") & F.col("agrees"))
        | ((step == 2) & one)
        | ((step == 3) & one & ~F.col("conflict"))
        | ((step == 4) & (F.col("n_sure") == 1) & ~F.col("sure_conflict"))
    )
    confidence = (
        F.when(step == 1, F.when(F.col("structured"), 1.0).otherwise(0.95))
        .when(step == 2, 1.0)
        .when(step == 3, 0.95)
        .when(step == 4, F.when(F.col("n_sure") >= 1, 0.8).otherwise(0.5))
        .otherwise(0.5)
    )
    methods = F.array(*(F.lit(m) for m in ("identifier_conflict", "sha256", "filename_identity", "title_author_year", "filename")))
    decisions = first.select(
        "record_id",
        F.when(matched, "matched").otherwise("ambiguous").alias("status"),
        F.when((step == 1) & one, F.element_at(F.array(*map(F.lit, MATCH_SCHEMES)), F.col("by").cast("int"))).otherwise(F.element_at(methods, step)).alias("method"),
        confidence.alias("confidence"),
        F.when(matched, F.when(step == 4, F.col("sure_paper")).otherwise(F.col("paper_id"))).alias("paper_id"),
    )
    return records.select("record_id").join(decisions, "record_id", "left").withColumn("status", F.coalesce("status", F.lit("unmatched")))


def merge_decision(rows: DataFrame) -> DataFrame:
    """Adds outcome to rows of (current, incoming) values of a field, by the first rule that applies.

    Columns: field, current, incoming (canonical text), current_source, incoming_source,
    human_decision boolean, rejected_before boolean, same_identifier boolean. Outcomes: unchanged,
    filled, overridden, archived, conflict.
    """
    blank = lambda c: F.coalesce(F.trim(F.col(c)), F.lit("")).isin("", "[]", "{}", "null")
    rank = lambda c: authority(F.col(c), F.col("field"))
    now, new = F.coalesce(rank("current_source"), F.lit(-1)), F.coalesce(rank("incoming_source"), F.lit(-1))
    manual = F.lower("incoming_source") == "manual"
    local = lambda c: F.coalesce(F.lower(c).isin(*LOCAL_SOURCES), F.lit(False))
    bare = F.regexp_replace(F.col("current"), "[.…\\s]+$", "")
    completed = (F.col("field") == "abstract") & F.col("current").rlike("(\\.\\.\\.|…)\\s*$") & (bare != "") & F.startswith("incoming", bare)
    completed = completed & (F.length("incoming") > F.length("current"))
    outcome = (
        F.when(blank("incoming"), "unchanged")
        .when(F.col("current").eqNullSafe(F.col("incoming")), "unchanged")
        .when(~manual & F.coalesce("rejected_before", F.lit(False)), "archived")
        .when(~manual & F.coalesce("human_decision", F.lit(False)), "archived")
        .when(blank("current"), "filled")
        .when(F.coalesce("same_identifier", F.lit(False)), "unchanged")
        .when(manual, "overridden")
        .when(local("current_source") & local("incoming_source") & (new <= now), "archived")
        .when(new > now, "overridden")
        .when(new < now, "archived")
        .when(F.col("field") == "title", "conflict")
        .when(completed, "overridden")
        .otherwise("conflict")
    )
    return rows.withColumn("outcome", outcome)


def record_claims(ledger: DataFrame, claims: DataFrame) -> DataFrame:
    """Claims that say something new: not what the field currently is, nor what the source said before."""
    current = ledger.where("is_current").select("paper_id", "field", F.col("value").alias("_now"))
    said = ledger.select("paper_id", "field", "source_id", "value")
    new = claims.join(current, ["paper_id", "field"], "left").where(~F.col("_now").eqNullSafe(F.col("value"))).drop("_now")
    return new.join(said, ["paper_id", "field", "source_id", "value"], "left_anti")


def promote(ledger: DataFrame, chosen: DataFrame, decided_by: str, at: Column) -> DataFrame:
    """The ledger with the chosen claims (id) current and their fields' other claims not."""
    picked = ledger.join(chosen.select("id"), "id", "left_semi").select("paper_id", "field", F.col("id").alias("_chosen"))
    both = ledger.join(picked, ["paper_id", "field"], "left")
    on = F.col("id") == F.col("_chosen")
    return both.select(
        *(
            F.when(F.col("_chosen").isNull(), F.col(c)).otherwise(on).alias(c)
            if c == "is_current"
            else F.when(on, F.lit(decided_by)).otherwise(F.col(c)).alias(c)
            if c == "decided_by"
            else F.when(on, at).otherwise(F.col(c)).alias(c)
            if c == "decided_at"
            else F.col(c)
            for c in ledger.columns
        )
    )


DISMISSED = "dismissed"


def rollback(ledger: DataFrame, chosen: DataFrame, at: Column) -> DataFrame:
    """The ledger with earlier claims (id, paper_id, field) current again.

    The claims that they replace count as dismissed, and both as decided by a human at that time. Claims
    that are not in the ledger under that paper and field change nothing.
    """
    picked = ledger.join(chosen.select("id", "paper_id", "field"), ["id", "paper_id", "field"], "left_semi").select("paper_id", "field", F.col("id").alias("_chosen"))
    both = ledger.join(picked, ["paper_id", "field"], "left")
    on = F.col("_chosen").isNotNull() & (F.col("id") == F.col("_chosen"))
    loses = F.col("_chosen").isNotNull() & (F.col("id") != F.col("_chosen")) & F.col("is_current")
    settled = on | (loses & ~F.coalesce(F.col("decided_by") == DISMISSED, F.lit(False)))
    changed = {
        "is_current": F.when(F.col("_chosen").isNull(), F.col("is_current")).otherwise(on),
        "decided_by": F.when(loses, F.lit(DISMISSED)).otherwise(F.col("decided_by")),
        "decision_at": F.when(settled, at).otherwise(F.col("decision_at")),
    }
    return both.select(*(changed.get(c, F.col(c)).alias(c) for c in ledger.columns))


def dismiss(ledger: DataFrame, chosen: DataFrame, at: Column) -> DataFrame:
    """The ledger with losing claims (id, paper_id, field) marked as looked at; current ones stay as they are."""
    marks = chosen.select("id", "paper_id", "field").distinct().withColumn("_d", F.lit(True))
    both = ledger.join(marks, ["id", "paper_id", "field"], "left")
    on = F.coalesce(F.col("_d"), F.lit(False)) & ~F.col("is_current")
    changed = {"decided_by": F.when(on, F.lit(DISMISSED)).otherwise(F.col("decided_by")), "decision_at": F.when(on, at).otherwise(F.col("decision_at"))}
    return both.select(*(changed.get(c, F.col(c)).alias(c) for c in ledger.columns))


def sources_with_papers(sources: DataFrame, papers: DataFrame) -> DataFrame:
    """Every source with its paper's title and whether that is deleted; sources without a paper have nulls."""
    about = papers.select(F.col("id").alias("paper_id"), F.col("title").alias("paper_title"), F.col("deleted_at").isNotNull().alias("paper_deleted"))
    return sources.join(about, "paper_id", "left")


def conflict_page(claims: DataFrame, sources: DataFrame, limit: int = 50, offset: int = 0) -> DataFrame:
    """Claims that lost against a current value and still need a look: the newest of each paper and field.

    claims: id, paper_id, field, value, source_id, is_current, decision, decision_at, decided_by,
    decided_at of live papers. sources: id, source_type. Deduplication comes before paging.
    """
    kinds = sources.select(F.col("id").alias("source_id"), F.lower("source_type").alias("kind"))
    lost = claims.where("not is_current").join(kinds, "source_id", "left")
    now = (
        claims.where("is_current")
        .join(kinds, "source_id", "left")
        .select("paper_id", "field", F.col("value").alias("now"), F.col("kind").alias("now_kind"), F.col("decided_by").alias("now_by"), F.col("decision_at").alias("now_at"))
    )
    rows = lost.join(now, ["paper_id", "field"], "left")
    pdf = F.col("kind").isin("pdf_embedded", "pdf_heuristic") & F.col("field").isin("authors", "abstract")
    kept, other = authority(F.col("now_kind"), F.col("field")), authority(F.col("kind"), F.col("field"))
    no_current = F.col("now_kind").isNull() & F.col("now").isNull()
    open_ = (
        ~F.coalesce(F.col("decision").isin("dismissed", "quality_rejected", "manual"), F.lit(False))
        & F.col("decision_at").isNull()
        & F.col("now_at").isNull()
        & ~F.coalesce(F.col("now_by") == "manual", F.lit(False))
        & ~F.col("value").eqNullSafe(F.col("now"))
        & (~F.coalesce(F.col("kind").isin(*HISTORY_ONLY), F.lit(False)) | pdf)
        & (~no_current | pdf)
        & ~F.coalesce(F.col("now_kind") == "manual", F.lit(False))
        & (pdf | F.coalesce(kept <= other, F.lit(True)))
    )
    newest = latest(rows.where(open_), ["paper_id", "field"], F.desc("decided_at"), F.desc("id"))
    return newest.orderBy(F.desc("decided_at"), F.desc("id")).offset(offset).limit(max(1, min(200, limit)))


def review_queue(sources: DataFrame) -> DataFrame:
    """Sources whose match is pending or ambiguous, newest first."""
    return sources.where(F.col("match_status").isin("pending", "ambiguous")).orderBy(F.desc("imported_at"), F.desc("id"))
