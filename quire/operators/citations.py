"""Citations of papers as text, BibTeX and RIS."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions.fields import clean_title

#: How signs are written in BibTeX, and what a paper's type is called there and in RIS.
TEX = {"\\": "\\textbackslash{}", "{": "\\{", "}": "\\}", "&": "\\&", "%": "\\%", "$": "\\$", "#": "\\#", "_": "\\_", "~": "\\textasciitilde{}", "^": "\\textasciicircum{}"}
KINDS = {"journal": ("article", "JOUR"), "conference": ("inproceedings", "CONF"), "book": ("book", "BOOK"), "preprint": ("misc", "UNPB"), "standard": ("misc", "STAND")}
OTHER_KIND = ("misc", "GEN")
#: Signs that are escaped in identifiers and addresses too.
TEX_ALWAYS = "\\{}"
KEY_PREFIX = "paper"


def _flat(value: Column) -> Column:
    """Text in one line, single spaces; empty for null."""
    return F.trim(F.regexp_replace(F.coalesce(value.cast("string"), F.lit("")), "\\s+", " "))


def _escaped(value: Column, signs: str = "".join(TEX)) -> Column:
    table = F.create_map(*(F.lit(x) for sign in signs for x in (sign, TEX[sign])))
    return F.array_join(F.transform(F.split(value, ""), lambda sign: F.coalesce(F.try_element_at(table, sign), sign)), "")


def _kind(place: int) -> Column:
    table = F.create_map(*(F.lit(x) for name, kinds in KINDS.items() for x in (name, kinds[place])))
    return F.coalesce(F.try_element_at(table, F.lower(F.coalesce("paper_type", F.lit("")))), F.lit(OTHER_KIND[place]))


def _present(lines: list[Column], between: str) -> Column:
    return F.array_join(F.array_compact(F.array(*lines)), between)


def citations(papers: DataFrame) -> DataFrame:
    """Adds citation, bibtex and ris; papers: id, title, authors array, venue, year, volume, issue, pages, doi, url, paper_type, publication_date.

    Missing columns count as null, and what is missing or blank is left out. Line ends inside values become spaces, so no value can
    start a record of its own. The key of a BibTeX entry is made of the id's letters and digits.
    """
    have = set(papers.columns)
    rows = papers.withColumns({c: F.lit(None).cast("string") for c in ("venue", "year", "volume", "issue", "pages", "doi", "url", "paper_type", "publication_date") if c not in have})
    value = {c: _flat(F.col(c)) for c in ("venue", "year", "volume", "issue", "pages", "doi", "url")}
    title = _flat(clean_title(F.col("title").cast("string")))
    names = F.filter(F.transform(F.coalesce("authors", F.array().cast("array<string>")), _flat), lambda n: n != "")
    rows = rows.withColumns({"_title": title, "_names": names})
    title, names = F.col("_title"), F.col("_names")
    if_any = lambda test, shown: F.when(test != "", shown)

    volume = F.concat(value["volume"], F.when(value["issue"] != "", F.concat(F.lit("("), value["issue"], F.lit(")"))).otherwise(""))
    parts = [F.array_join(names, ", "), title, value["venue"], value["year"], if_any(value["volume"], volume), if_any(value["pages"], F.concat(F.lit("pp. "), value["pages"])), if_any(value["doi"], F.concat(F.lit("doi:"), value["doi"]))]
    text = F.concat(_present([if_any(p, F.regexp_replace(p, "\\.+$", "")) for p in parts], ". "), F.lit("."))

    kind = _kind(0)
    home = F.when(kind == "article", "journal").when(kind == "inproceedings", "booktitle").otherwise("howpublished")
    in_braces = lambda v: F.concat(F.lit("{"), v, F.lit("}"))
    field = lambda name, test, shown: if_any(test, F.concat(F.lit("  "), name if isinstance(name, Column) else F.lit(name), F.lit(" = "), in_braces(shown)))
    # A name with the word that parts names is kept together by braces.
    people = F.array_join(F.transform(names, lambda n: F.when(n.rlike("(?i)\\band\\b"), in_braces(_escaped(n))).otherwise(_escaped(n))), " and ")
    span = F.regexp_replace(value["pages"], "(?<=\\w)\\s*[-–—]\\s*(?=\\w)", "--")
    entries = [
        field("title", title, in_braces(_escaped(title))), field("author", people, people), field(home, value["venue"], _escaped(value["venue"])), field("year", value["year"], _escaped(value["year"])),
        field("volume", value["volume"], _escaped(value["volume"])), field("number", value["issue"], _escaped(value["issue"])), field("pages", value["pages"], _escaped(span)),
        field("doi", value["doi"], _escaped(value["doi"], TEX_ALWAYS)), field("url", value["url"], _escaped(value["url"], TEX_ALWAYS)),
    ]
    key = F.concat(F.lit(KEY_PREFIX), F.regexp_replace(F.col("id").cast("string"), "[^a-zA-Z0-9]", ""))
    bibtex = F.concat(F.lit("@"), kind, F.lit("{"), key, F.lit(",\n"), _present(entries, ",\n"), F.lit("\n}\n"))

    tag = lambda name, shown: if_any(shown, F.concat(name if isinstance(name, Column) else F.lit(name), F.lit("  - "), shown))
    ends = lambda place: F.regexp_extract(value["pages"], "^(\\d+)\\s*[-–—]+\\s*(\\d+)$", place)
    lines = [
        tag("TY", _kind(1)), tag("ID", _flat(F.col("id"))), if_any(F.array_join(names, ""), F.array_join(F.transform(names, lambda n: F.concat(F.lit("AU  - "), n)), "\r\n")), tag("TI", title),
        tag(F.when(_kind(1) == "JOUR", "JO").otherwise("T2"), value["venue"]), tag("PY", value["year"]), tag("DO", value["doi"]), tag("VL", value["volume"]), tag("IS", value["issue"]), tag("UR", value["url"]),
        tag("DA", F.coalesce(F.substring(F.col("publication_date").cast("string"), 1, 10), F.lit(""))), tag("SP", F.when(ends(1) != "", ends(1)).otherwise(value["pages"])), tag("EP", ends(2)),
    ]
    ris = F.concat(_present(lines, "\r\n"), F.lit("\r\nER  - \r\n"))
    return rows.withColumns({"citation": text, "bibtex": bibtex, "ris": ris}).select(*papers.columns, "citation", "bibtex", "ris")
