"""Readers: tables, JSON and JSONL payloads, bibliographic formats, folders, archives, evaluation files."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def read_json_lines(spark: SparkSession, path: str, schema: T.StructType, tolerant: bool = False) -> DataFrame:
    """One object a line; blank lines are skipped. Bad lines raise, or with tolerant=True come with `_bad` text."""
    if not tolerant:
        return spark.read.schema(schema).option("mode", "FAILFAST").json(path)
    wide = T.StructType([*schema.fields, T.StructField("_bad", T.StringType())])
    return spark.read.schema(wide).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_bad").json(path)


def read_json_document(spark: SparkSession, path: str) -> DataFrame:
    """A file that is one JSON value: a list gives a row an element."""
    return spark.read.option("multiLine", "true").json(path)


RECORD = (
    "title string, abstract string, doi string, article_number string, publication_title string, publication_year string, "
    "publication_date string, content_type string, volume string, issue string, start_page string, end_page string, html_url string, "
    "pdf_url string, abstract_url string, publication_number string, is_number string, type string, `container-title` string, page string, "
    "authors string, author string, venue string, year string, url string, issn string, issued string, index_terms string, citing_paper_count string"
)
#: The lists of index terms that an article has, each an object with `terms`.
TERM_LISTS = ("ieee_terms", "author_terms", "dynamic_index_terms")
#: Fields that mark a record of the publisher's article format; two of them decide.
ARTICLE_MARKS = ("article_number", "publication_title", "publication_number", "is_number", "html_url", "pdf_url", "abstract_url", "content_type")


def detect_format(record: Column, csl_doi: Column) -> Column:
    """ieee, csl or generic, by the fields that a record struct has; csl_doi is the field DOI, in capitals."""
    marks = F.lit(0)
    for m in ARTICLE_MARKS:
        marks = marks + record[m].isNotNull().cast("int")
    return F.when(marks >= 2, "ieee").when(csl_doi.isNotNull() | record["type"].isNotNull(), "csl").otherwise("generic")


def read_bibliography(spark: SparkSession, path: str) -> DataFrame:
    """Canonical records of a JSONL file in any of the three formats; bad lines give a row with `error`.

    format, title, abstract, doi, authors array (in the order that they are numbered in), venue, year, date, volume, issue, pages,
    article_number, issue_number, issn, citing_count, ieee_terms, author_terms, dynamic_index_terms (arrays), url, error.
    """
    from quire.functions.identifiers import month_date, normalize_doi, page_range, year_in_text

    lines = spark.read.text(path).where(F.trim("value") != "")
    rows = lines.select("value", F.from_json("value", RECORD, {"mode": "PERMISSIVE"}).alias("r"), F.try_parse_json("value").isNull().alias("bad"))
    r = F.col("r")
    csl_doi = F.get_json_object("value", "$.DOI")
    kind = detect_format(r, csl_doi)
    people = F.coalesce(r["authors"], r["author"])
    person = "array<struct<author_order: string, full_name: string, name: string, family: string, given: string>>"
    listed = F.from_json(F.coalesce(F.get_json_object(people, "$.authors"), people), person)
    # Numbered authors in that order, those without a number after them as they come.
    numbered = F.transform(listed, lambda x, i: F.struct(F.coalesce(x["author_order"].try_cast("int"), F.lit(1 << 30)).alias("n"), i.alias("i"), _name(x).alias("name")))
    ieee_names = F.filter(F.transform(F.array_sort(numbered), lambda x: x["name"]), lambda n: F.trim(n) != "")
    terms = F.from_json(r["index_terms"], ", ".join(f"{t} struct<terms: array<string>>" for t in TERM_LISTS))
    plain = F.from_json(people, "array<string>")
    date_text = F.coalesce(r["publication_date"], r["issued"])
    return rows.select(
        F.when(~F.col("bad"), kind).alias("format"),
        r["title"].alias("title"),
        r["abstract"].alias("abstract"),
        normalize_doi(F.coalesce(r["doi"], csl_doi)).alias("doi"),
        F.when(people.rlike('^\\s*\\[\\s*"'), plain).otherwise(ieee_names).alias("authors"),
        F.coalesce(r["publication_title"], r["container-title"], r["venue"]).alias("venue"),
        F.coalesce(r["publication_year"].try_cast("int"), r["year"].try_cast("int"), year_in_text(date_text)).alias("year"),
        month_date(date_text).alias("date"),
        r["volume"].alias("volume"),
        r["issue"].alias("issue"),
        F.coalesce(page_range(r["start_page"], r["end_page"]), r["page"]).alias("pages"),
        r["article_number"].alias("article_number"),
        r["is_number"].alias("issue_number"),
        r["issn"].alias("issn"),
        r["citing_paper_count"].try_cast("int").alias("citing_count"),
        *(F.filter(F.transform(F.coalesce(terms[t]["terms"], F.array().cast("array<string>")), lambda w: F.trim(w)), lambda x: x != "").alias(t) for t in TERM_LISTS),
        F.coalesce(r["html_url"], r["abstract_url"], r["url"]).alias("url"),
        F.when(F.col("bad"), F.lit("invalid_json")).alias("error"),
    )


def _name(x: Column) -> Column:
    return F.coalesce(x["full_name"], x["name"], F.concat_ws(" ", x["given"], x["family"]))


def read_checked_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of a JSONL file of an evaluation set; a bad line raises an error that names file and line."""
    rows = read_json_lines(spark, path, T.StructType.fromDDL(schema), tolerant=True).select("*", F.col("_metadata.file_path").alias("_file"))
    bad = rows.where("_bad is not null").limit(1).collect()  # whole rows: Spark can't read the bad text alone
    if bad:
        lines = spark.read.text(bad[0]["_file"], wholetext=True).select(F.posexplode(F.split("value", "\n")))
        at = lines.where(F.trim("col") == bad[0]["_bad"].strip()).agg(F.min("pos")).first()[0]
        raise ValueError(f"{bad[0]['_file'].rpartition('/')[2]}:{'?' if at is None else at + 1}: not a record: {bad[0]['_bad'][:200]!r}")
    return rows.drop("_bad", "_file")


def read_graded_labels(spark: SparkSession, path: str) -> DataFrame:
    return read_checked_lines(spark, path, "query_id string, paper_id string, grade int")


def read_eval_queries(spark: SparkSession, path: str) -> DataFrame:
    return read_checked_lines(spark, path, "id string, query string, language string, note string")


def read_folder(spark: SparkSession, path: str, pattern: str = "*", max_bytes: int = 100 << 20) -> DataFrame:
    """path, modificationTime, length, content of files below a folder.

    The pattern is a glob for the name, case-insensitive; hidden and temporary files and larger ones
    are left out.
    """
    import fnmatch

    # The listing filters names first (each letter in both cases), so the contents of other files are never read.
    glob = "".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() and "[" not in pattern else c for c in pattern)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(path)
    name = F.element_at(F.split("path", "/"), -1)
    hidden = name.rlike("^[.~]|~$|(?i)\\.(tmp|part|crdownload)$")
    return files.where(~hidden & (F.col("length") <= max_bytes) & F.lower(name).rlike(fnmatch.translate(pattern.lower()).replace("\\Z", "$")))


def read_archives(
    files: DataFrame, max_files: int = 2000, max_bytes: int = 2 << 30, max_ratio: float = 100.0, suffixes: tuple[str, ...] = (".pdf", ".txt", ".md", ".html")
) -> DataFrame:
    """archive, name, content, error of the members of zip files (path, content).

    Unsafe paths, nested archives, too many files, too many bytes and suspicious ratios give a row
    with an error in place of content; an unreadable archive gives one such row.
    """

    def members(path: str, content: bytes) -> Iterator[tuple]:
        try:
            with zipfile.ZipFile(io.BytesIO(content)) as z:
                infos = [i for i in z.infolist() if not i.is_dir()]
                if len(infos) > max_files:
                    yield path, None, None, "too_many_files"
                    return
                if sum(i.file_size for i in infos) > max_bytes:
                    yield path, None, None, "too_large"
                    return
                for i in infos:
                    parts = i.filename.replace("\\", "/").split("/")
                    if i.filename.startswith(("/", "\\")) or ".." in parts or ":" in parts[0]:
                        yield path, i.filename, None, "unsafe_path"
                    elif i.filename.lower().endswith((".zip", ".tar", ".gz", ".7z", ".rar")):
                        yield path, i.filename, None, "nested_archive"
                    elif i.compress_size and i.file_size / i.compress_size > max_ratio:
                        yield path, i.filename, None, "suspicious_ratio"
                    elif i.filename.lower().endswith(suffixes):
                        yield path, i.filename, z.read(i), None
        except (zipfile.BadZipFile, RuntimeError, OSError):
            yield path, None, None, "bad_archive"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, content in zip(batch.path, batch.content):
                for row in members(path, content):
                    yield pd.DataFrame([row], columns=["archive", "name", "content", "error"])

    return files.select("path", "content").mapInPandas(run, "archive string, name string, content binary, error string")


def object_listing(spark: SparkSession, root: str, prefix: str = "") -> DataFrame:
    """key, size, modified of the files below root whose key starts with prefix; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path", "length", "modificationTime")
    key = F.regexp_replace("path", "^.*?" + root.rstrip("/").replace(".", "\\.") + "/", "")
    return files.select(key.alias("key"), F.col("length").alias("size"), F.col("modificationTime").alias("modified")).where(F.startswith("key", F.lit(prefix)))
