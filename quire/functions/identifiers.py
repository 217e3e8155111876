"""Identifiers, fingerprints, dates and page ranges of bibliographic records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions.unicode import normalize_text

SCHEMES = ("doi", "arxiv", "ieee_article_number", "isbn", "issn", "pmid", "openalex", "semantic_scholar", "url", "sha256")


def _blank_to_null(c: Column) -> Column:
    return F.when(c != "", c)


def normalize_doi(doi: Column) -> Column:
    """Trimmed, lower-cased, without one leading address or scheme; null if blank."""
    return _blank_to_null(F.trim(F.regexp_replace(F.lower(F.trim(doi)), "^(https?://doi\\.org/|doi:)", "")))


def normalize_arxiv_id(value: Column) -> Column:
    """The same for arXiv, also without a version at the end."""
    bare = F.trim(F.regexp_replace(F.lower(F.trim(value)), "^(https?://arxiv\\.org/abs/|arxiv:)", ""))
    return _blank_to_null(F.regexp_replace(bare, "v\\d+$", ""))


def _digits(raw: Column) -> Column:
    return _blank_to_null(F.regexp_replace(raw, "[^0-9]", ""))


def _book_number(raw: Column) -> Column:
    return _blank_to_null(F.upper(F.regexp_replace(raw, "[^0-9xX]", "")))


def _address(raw: Column) -> Column:
    return F.lower(F.regexp_replace(raw, "/+$", ""))


def _digest(raw: Column) -> Column:
    return F.when(F.lower(raw).rlike("^[0-9a-f]{64}$"), F.lower(raw))


def _tail(raw: Column) -> Column:
    return _blank_to_null(F.lower(F.element_at(F.split(F.regexp_replace(raw, "/+$", ""), "/"), -1)))


def _named(raw: Column) -> Column:
    return F.coalesce(_blank_to_null(normalize_text(raw)), F.lower(raw))


_FORMS = {
    "doi": normalize_doi, "arxiv": normalize_arxiv_id, "ieee_article_number": _digits, "pmid": _digits, "issn": _book_number, "isbn": _book_number,
    "url": _address, "sha256": _digest, "openalex": _tail, "semantic_scholar": _tail,
}


def identifier_form(scheme: str, value: Column) -> Column:
    """The form of a value of a known scheme in which equal identifiers are equal; null if unusable."""
    raw = F.trim(value)
    return F.when(F.coalesce(raw, F.lit("")) != "", _FORMS.get(scheme, _named)(raw))


def normalize_identifier(scheme: Column, value: Column) -> Column:
    """The same with the scheme as a column. Only values of unknown schemes are looked at as names."""
    key, raw = F.lower(F.trim(scheme)), F.trim(value)
    out = _named(F.when(~F.coalesce(key.isin(*_FORMS), F.lit(False)), raw))
    for name, form in _FORMS.items():
        out = F.when(key == name, form(raw)).otherwise(out)
    return F.when(F.coalesce(raw, F.lit("")) != "", out)


def primary_identifiers(identifiers: DataFrame) -> DataFrame:
    """paper_id, scheme, normalized_value: the identifier that names each paper, its DOI or else its arXiv id."""
    place = F.when(F.lower(F.trim("scheme")) == "doi", 0).when(F.lower(F.trim("scheme")) == "arxiv", 1)
    usable = identifiers.where(place.isNotNull() & (F.coalesce("normalized_value", F.lit("")) != ""))
    best = F.min_by(F.struct("scheme", "normalized_value"), F.struct(place, F.col("normalized_value")))
    return usable.groupBy("paper_id").agg(best.alias("b")).select("paper_id", "b.*")


def fingerprint(doi: Column, arxiv_id: Column, title: Column, first_author: Column, year: Column, sha256: Column) -> Column:
    """The first that is known: DOI, arXiv id, title with author and year, file digest, digest of the title.

    Titles count up to 200 and authors up to 40 characters. `title` and `first_author` are already
    normalized.
    """
    full = (F.coalesce(title, F.lit("")) != "") & (F.coalesce(first_author, F.lit("")) != "") & (F.coalesce(year, F.lit(0)) != 0)
    named = F.concat(F.lit("title:"), F.substring(title, 1, 200), F.lit("|"), F.substring(first_author, 1, 40), F.lit("|"), year.cast("string"))
    fallback = F.concat(F.lit("sha256:"), F.sha2(F.coalesce(_blank_to_null(title), F.lit("untitled")), 256))
    return F.coalesce(
        F.concat(F.lit("doi:"), normalize_doi(doi)),
        F.concat(F.lit("arxiv:"), normalize_arxiv_id(arxiv_id)),
        F.when(full, named),
        F.concat(F.lit("sha256:"), _blank_to_null(F.lower(F.trim(sha256)))),
        fallback,
    )


def year_in_text(text: Column) -> Column:
    """Of the standalone four-digit numbers the first in 1900..2199, else the first in 1000..2999."""
    years = F.transform(F.regexp_extract_all(text, F.lit("(?<!\\d)(\\d{4})(?!\\d)"), F.lit(1)), lambda y: y.cast("int"))
    first = lambda low, high: F.get(F.filter(years, lambda y: y.between(low, high)), F.lit(0))
    return F.coalesce(first(1900, 2199), first(1000, 2999))


MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")


def month_date(text: Column) -> Column:
    """First of the first named month in the text's year, or null."""
    name = F.regexp_extract(F.lower(text), "\\b(" + "|".join(MONTHS) + ")[a-z]*\\b", 1)
    month = F.array_position(F.array(*(F.lit(m) for m in MONTHS)), name).cast("int")
    return F.when((month > 0) & year_in_text(text).isNotNull(), F.make_date(year_in_text(text), month, F.lit(1)))


def page_range(start: Column, end: Column) -> Column:
    """a-b, or the one that is there, or null."""
    a, b = _blank_to_null(F.trim(start)), _blank_to_null(F.trim(end))
    return F.when(a == b, a).otherwise(_blank_to_null(F.concat_ws("-", a, b)))


def identifiers_in_text(text: Column) -> Column:
    """struct(doi, arxiv, isbn, issn): the first of each in running text."""
    grab = lambda p: _blank_to_null(F.regexp_extract(text, p, 1))
    return F.struct(
        F.lower(grab("(?i)\\b(10\\.\\d{4,9}/[-._;()/:a-z0-9]*[a-z0-9])")).alias("doi"),
        grab("(?i)arxiv:\\s*(\\d{4}\\.\\d{4,5})").alias("arxiv"),
        F.regexp_replace(grab("(?i)isbn[-: ]*((?:97[89][- ]?)?(?:\\d[- ]?){9}[\\dx])"), "[- ]", "").alias("isbn"),
        F.upper(grab("(?i)issn[-: ]*(\\d{4}-\\d{3}[\\dx])")).alias("issn"),
    )


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "[/\\\\]"), -1)


def filename_doi(filename: Column) -> Column:
    """DOI that a PDF's name stands for: 10.<digits>_<rest>.pdf. With further underscores it would be a guess, so it is null."""
    bare = F.regexp_extract(file_name(filename), "(?i)^(10\\.\\d{4,9}_[^_]+)\\.pdf$", 1)
    return normalize_doi(_blank_to_null(F.replace(bare, F.lit("_"), F.lit("/"))))


def filename_arxiv(filename: Column) -> Column:
    """The first arXiv id (year and month, then four or five digits) in a file's name, or null."""
    tokens = F.regexp_extract_all(file_name(filename), F.lit("(?<![0-9.])(\\d{2}(?:0[1-9]|1[0-2])\\.\\d{4,5})(?:v\\d+)?(?![0-9])"), F.lit(1))
    return normalize_arxiv_id(F.get(tokens, F.lit(0)))
