"""Claims about a paper's fields, replayed in order: what each changes depends on all that came before."""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import Any, NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.functions import fields as V
from quire.operators.metadata import LOCAL_SOURCES, authority

PDF_SOURCES = ("pdf_embedded", "pdf_heuristic")
BETWEEN = "\x1f"


def _prepared(claims: DataFrame) -> DataFrame:
    """Each claim with all that its replay needs and that depends on the claim alone."""
    have = set(claims.columns)
    col = lambda name, kind: (F.col(name) if name in have else F.lit(None)).cast(kind)
    field, value, names, title = F.col("field"), F.col("value"), col("names", "array<string>"), col("title", "string")
    byline, body = col("byline", "array<string>"), col("body", "string")
    # Step by step, so what several columns are made of is a column and worked out once.
    claims = claims.withColumn("_cleaned", F.when(field == "title", V.clean_title(value)))
    claims = claims.withColumns({"_shown": V.shown(field, value, F.col("_cleaned")), "_w_shown": V.shown(field, body, V.clean_title(body))})
    claims = claims.withColumns({"_normal": V.unicode_form(F.col("_shown"), "NFKC"), "_w_normal": V.unicode_form(F.col("_w_shown"), "NFKC")})
    source = F.lower(F.trim("source_type"))
    is_authors, is_abstract = field == "authors", field == "abstract"
    problem = F.when(is_abstract, V.abstract_problem(value)).when(is_authors, V.authors_problem(names, title))
    empty = F.when(is_authors, F.coalesce(F.size(names), F.lit(0)) <= 0).otherwise(F.coalesce(F.trim(value), F.lit("")).isin("", "[]", "{}", "null"))
    usable = F.when(is_authors, F.coalesce(F.size(byline), F.lit(0)) > 0).otherwise(F.coalesce(body, F.lit("")) != "")
    witness_problem = F.when(is_authors, V.authors_problem(byline, title)).when(is_abstract, V.abstract_problem(body))
    trailing = F.when(is_abstract & value.rlike("(\\.\\.\\.|…)\\s*$"), F.regexp_replace(value, "[.…\\s]+$", ""))
    return claims.select(
        "id", "paper_id", "field", F.when(is_abstract, value).alias("value"), trailing.alias("bare"),
        F.when(is_authors, F.array_join(V.canonical_list(F.lit("authors"), names), BETWEEN)).otherwise(V.folded(field, F.col("_normal"))).alias("canon"), authority(source, field).alias("rank"),
        F.coalesce(source.isin(*LOCAL_SOURCES), F.lit(False)).alias("local"), F.coalesce(source.isin(*PDF_SOURCES), F.lit(False)).alias("pdf"),
        F.coalesce(source == "pdf_heuristic", F.lit(False)).alias("guessed"), F.coalesce(source == "manual", F.lit(False)).alias("manual"),
        F.coalesce(col("decided", "boolean"), F.lit(False)).alias("decided"), F.coalesce(col("dismissed", "boolean"), F.lit(False)).alias("dismissed"),
        empty.alias("empty"), problem.isNotNull().alias("bad"), F.coalesce(F.col("_cleaned") != value, F.lit(False)).alias("markup"),
        V.squeezed(F.coalesce(value, F.lit(""))).alias("key"),
        # Lists go as texts: with a list that is null in most rows, Spark's Arrow writer takes a time that grows with the square of a batch.
        F.when(is_authors, F.array_join(F.transform(V.skeletons(names), lambda n: n["bare"]), BETWEEN)).alias("skeletons"),
        (usable & witness_problem.isNull()).alias("witness"), F.coalesce(col("complete", "boolean"), F.lit(False)).alias("complete"), (usable | col("complete", "boolean").isNotNull()).alias("evidence"),
        F.when(is_authors, F.array_join(V.canonical_list(F.lit("authors"), byline), BETWEEN)).otherwise(V.folded(field, F.col("_w_normal"))).alias("w_canon"),
        V.squeezed(F.coalesce(body, F.lit(""))).alias("w_key"),
        (F.coalesce(col("text_state", "string"), F.lit("ok")) != "ok").alias("unreliable"),
    )


class _Claim(NamedTuple):
    """What a replay needs of a claim, as _prepared gives it; a field's state holds the claim that its value is from."""

    field: str | None = None
    #: Abstracts only; bare: without the points of one that breaks off.
    value: str | None = None
    bare: str | None = None
    canon: str | None = None
    rank: int | None = None
    local: bool = False
    pdf: bool = False
    guessed: bool = False
    manual: bool = False
    decided: bool = False
    dismissed: bool = False
    empty: bool = False
    bad: bool = False
    markup: bool = False
    key: str = ""
    skeletons: str | None = None
    witness: bool = False
    complete: bool = False
    evidence: bool = False
    w_canon: str | None = None
    w_key: str = ""
    unreliable: bool = False


def _names(canon: str | None) -> list[str] | None:
    return None if canon is None else canon.split(BETWEEN)


def _abbreviated(now: _Claim, new: _Claim) -> bool:
    """quire.functions.fields.abbreviated for the names of two claims."""
    left, right = (list(zip(_names(c.canon), c.skeletons.split(BETWEEN))) if c.canon is not None and c.skeletons is not None else None for c in (now, new))
    if left is None or right is None or len(left) != len(right):
        return False
    stands: set[tuple[str, str]] = set()
    for (form, a), (other, b) in zip(left, right):
        if a == b:
            if form != other:
                return False
            continue
        p, q = re.split("[ -]", a), re.split("[ -]", b)
        signs = re.sub("[^ -]+", "", a)
        if not signs or signs != re.sub("[^ -]+", "", b) or p[-1] != q[-1] or len(p[-1]) < 2:
            return False
        if not all(v == w or (len(v) == 1 and w.startswith(v)) or (len(w) == 1 and v.startswith(w)) for v, w in zip(p, q)):
            return False
        if any(len(v) == 1 and len(w) > 1 for v, w in zip(p, q)):
            stands.add((a, b))
        if any(len(w) == 1 and len(v) > 1 for v, w in zip(p, q)):
            stands.add((b, a))
    return bool(stands) and len(stands) == len({s for s, _ in stands})


def _page_choice(now: _Claim, new: _Claim, blank: bool) -> str | None:
    """Which of two values a claim read from pages speaks for: reject, current, incoming, or null where authority decides.

    Values are judged by whether they can be one at all and by what the document's body says, never by length.
    """
    if not new.pdf or new.field not in ("authors", "abstract"):
        return None
    if new.bad:
        return "reject"
    if not blank and not now.pdf:
        return None
    if new.field == "authors" and new.guessed and new.evidence and not new.complete:
        return "current"
    if blank:
        return "incoming"
    if new.unreliable:
        return "current"
    is_now, is_new = (c is not None and c == new.w_canon for c in (now.canon, new.canon))
    if new.field == "authors":
        # A byline that is the front part of the names at hand may be cut off.
        names, byline = _names(now.canon), _names(new.w_canon)
        may_be_cut = not now.bad and names is not None and byline is not None and len(names) > len(byline) and set(byline) <= set(names)
        wins = new.witness and new.complete and is_new and not is_now and not may_be_cut and not _abbreviated(now, new)
    else:
        in_now, in_new = (key != "" and key in new.w_key for key in (now.key, new.key))
        wins = is_new if new.witness and new.complete and is_now != is_new else in_new if new.witness and in_now != in_new else now.bad
    return "incoming" if wins else "current"


def _outcome(now: _Claim, new: _Claim, free: bool) -> str:
    """free: no human has settled the field against this claim."""
    blank = not now.canon
    known = now.rank is not None and new.rank is not None
    if new.empty:
        return "unchanged"
    if not blank and now.canon == new.canon:
        cleaner = new.field == "title" and known and new.rank >= 2 and new.rank >= now.rank and free and now.markup and not new.markup
        return "overridden" if cleaner else "unchanged"
    if not free:
        return "archived"
    choice = _page_choice(now, new, blank)
    if choice == "incoming":
        return "filled" if blank else "overridden"
    if choice is not None:
        return "archived"
    if blank:
        return "filled"
    if new.manual:
        return "overridden"
    if known and new.local and now.local and new.rank <= now.rank:
        return "archived"
    if known and new.rank != now.rank:
        return "overridden" if new.rank > now.rank else "archived"
    if known and (new.field == "title" or new.rank == 0):
        return "conflict"
    completed = new.field == "abstract" and now.bare and new.value.startswith(now.bare) and len(new.value) > len(now.value)
    return "overridden" if completed else "conflict"


class _Replay:
    """The state of one field of one paper."""

    def __init__(self) -> None:
        self.now, self.human, self.settled = _Claim(), False, set()

    def add(self, new: _Claim) -> str:
        now = self.now
        outcome = _outcome(now, new, new.manual or (not self.human and (new.canon or "") not in self.settled))
        taken, same, said = outcome in ("filled", "overridden"), now.canon == new.canon, new.manual or new.decided
        turned_down = None
        if taken:
            turned_down = now.canon if self.human and not same else None
            self.human = said or (same and self.human)
            self.now = new
        else:
            turned_down = new.canon if not same and (new.decided or new.dismissed) else None
            self.human = self.human or (same and said and not new.empty)
        if turned_down is not None:
            self.settled.add(turned_down)
        return outcome


def _replayed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Outcomes of claims that come field by field, in order. Of a field's claims only the one taken last is kept back: it is current if no other follows."""

    def result(rows: pa.RecordBatch, outcomes: list[str], current: bool) -> pa.RecordBatch:
        arrays = [*(rows.column(k) for k in range(3)), pa.array(outcomes, pa.string()), pa.array([current] * len(outcomes), pa.bool_())]
        return pa.RecordBatch.from_arrays(arrays, names=["id", "paper_id", "field", "outcome", "is_current"])

    at: tuple[Any, Any] | None = None
    replay = _Replay()
    held: tuple[pa.RecordBatch, list[str]] | None = None
    for batch in filter(len, batches):
        columns = [batch.column(k).to_pylist() for k in range(1, batch.num_columns)]
        outcomes: list[str] = []
        last: list[int] = []  # of each field that has a taken claim in this batch
        open_ = False
        for paper, *claim in zip(*columns):
            new = _Claim(*claim)
            if (paper, new.field) != at:
                if held is not None:
                    yield result(*held, True)
                    held = None
                at, replay, open_ = (paper, new.field), _Replay(), False
            outcome = replay.add(new)
            if outcome in ("filled", "overridden"):
                if held is not None:
                    yield result(*held, False)
                    held = None
                if open_:
                    last.pop()
                last.append(len(outcomes))
                open_ = True
            outcomes.append(outcome)
        of = lambda places: (batch.take(pa.array(places, pa.int64())), [outcomes[k] for k in places])  # noqa: B023, E731
        if open_:
            held = of([last[-1]])
        current = set(last)
        yield result(*of([k for k in range(len(batch)) if k not in current]), False)
        yield result(*of(last[: len(last) - open_]), True)
    if held is not None:
        yield result(*held, True)


def replay_claims(claims: DataFrame) -> DataFrame:
    """id, paper_id, field, outcome, is_current of each claim: the claims of a field are taken in the order of seq, then id.

    claims: id, paper_id, field, seq, source_type, value (text; for authors names array<string> as well). Optional: decided, dismissed
    (a human has settled this claim), title (the paper's), and what the document itself says: byline array<string> or body text,
    complete (is it whole), text_state. Outcomes: unchanged, filled, overridden, archived, conflict. A value that a human
    chose gives way to manual claims only, and a value that a human has turned down does not come back by others. Each id comes once. The
    claims of one field of one paper are replayed by one task, in a stream: what it keeps of them are the state and the values turned down.
    """
    spread = int(claims.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # A given number of partitions, as the work is by row and not by size. Claims are prepared after the exchange, so each task has a share of that.
    ordered = claims.repartition(spread, "paper_id", "field").sortWithinPartitions("paper_id", "field", "seq", "id")
    kinds = [T.StructField(c, claims.schema[c].dataType) for c in ("id", "paper_id", "field")]
    return _prepared(ordered).mapInArrow(_replayed, T.StructType([*kinds, T.StructField("outcome", T.StringType()), T.StructField("is_current", T.BooleanType())]))
