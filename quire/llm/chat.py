"""Operator 2, chat formatting: render conversations by a compiled template, and read them back."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm.chat_template import compile_template
from quire.llm.common import shuffle_partitions

TURN, END = "### ", "</turn>"

#: The header names the role; the end string closes a turn; both are escaped inside roles and texts.
TEMPLATE = (
    "{% for m in messages %}{{ '### ' + (m.role | name) + ':\\n' }}"
    "{% if m.role == 'assistant' %}{% generation %}{{ m.text | body }}{% endgeneration %}"
    "{% else %}{{ m.text | body }}{% endif %}{{ '</turn>' + '\\n' }}{% endfor %}"
)

_IN_TEXT = re.compile(r"\\|### |</turn>")
_IN_ROLE = re.compile(r"\\|:|### |</turn>")
_SPECIAL = re.compile(r"\\(.)|(</turn>)", re.S)
_ROLE_END = re.compile(r"\\.|(:\n)", re.S)


def escape_text(text: str | None) -> str:
    """A backslash before each backslash and each control string."""
    return _IN_TEXT.sub(lambda m: "\\" + m[0], text or "")


def escape_role(role: str | None) -> str:
    return _IN_ROLE.sub(lambda m: "\\" + m[0], role or "")


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.S)


def renderer(template: str = TEMPLATE) -> Callable[..., Iterator[tuple[str, bool]]]:
    compiled = compile_template(template, {"name": escape_role, "body": escape_text})
    return lambda messages: compiled(messages=messages)


def read_back(formatted: str) -> Iterator[tuple[str, str]]:
    """The (role, text) of each turn of a formatted conversation."""
    at = 0
    while at < len(formatted):
        if not formatted.startswith(TURN, at):
            raise ValueError(f"no turn starts at {at}")
        at += len(TURN)
        colon = next(m for m in _ROLE_END.finditer(formatted, at) if m[1])
        role = unescape(formatted[at : colon.start()])
        close = next(m for m in _SPECIAL.finditer(formatted, colon.end()) if m[2])
        yield role, unescape(formatted[colon.end() : close.start()])
        at = close.end() + 1  # the newline after it


def format_conversations(turns: DataFrame, template: str = TEMPLATE, digest: bool = False) -> DataFrame:
    """One row a conversation: conv_id, n_turns, formatted, loss_spans array<struct<start, end>>.

    turns: conv_id, turn, role, text, and columns that are ignored. Rows are ordered by turn, nulls
    first, ties by role and text; repeated rows are turns of their own; null role and text count as
    empty; rows without conv_id form one conversation with a null id. Spans are code points of
    `formatted` that the template marks as generation. An empty table gives no rows.

    Each task sorts its conversations and renders them turn by turn. With digest=True only digests
    of what is read back from the output leave the task, in place of the output: turns_sha256,
    loss_chars, loss_sha256, formatted_chars. Each turn's output is then hashed as it is made, so a
    conversation of any length needs the memory of one turn.
    """
    spark = turns.sparkSession
    ordered = (
        turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
        .repartition(shuffle_partitions(spark), "conv_id")
        .sortWithinPartitions("conv_id", "turn", "role", "text")
        .select("conv_id", "role", "text")
    )
    if digest:
        schema = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    else:
        schema = "conv_id long, n_turns long, formatted string, loss_spans array<struct<start: long, end: long>>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        render = renderer(template)
        out: list[tuple] = []
        sink = _Digest if digest else _Whole

        def rows() -> Iterator[tuple]:
            for batch in batches:
                yield from zip(*(batch.column(k).to_pylist() for k in range(3)))

        def one(first: tuple, rest: Iterator[tuple], after: list) -> Iterator[dict]:
            row = first
            while row is not None and row[0] == first[0]:
                yield {"role": row[1], "text": row[2]}
                row = next(rest, None)
            after.append(row)

        def batch() -> pa.RecordBatch:
            cols = list(zip(*out))
            made = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, sink.types)], names=sink.names)
            out.clear()
            return made

        rest = rows()
        row = next(rest, None)
        size = 0
        while row is not None:
            after: list = []
            into = sink(row[0])
            for text, marked in render(one(row, rest, after)):
                into.add(text, marked)
            out.append(into.row())
            size += into.size
            row = after[0]
            if len(out) >= 1000 or size > 1 << 22:
                yield batch()
                size = 0
        if out:
            yield batch()

    return ordered.mapInArrow(run, schema)


class _Whole:
    """Keeps a conversation's output and the spans of its marked pieces."""

    names = ["conv_id", "n_turns", "formatted", "loss_spans"]
    types = [pa.int64(), pa.int64(), pa.string(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))]

    def __init__(self, conv_id: int | None):
        self.conv_id, self.parts, self.spans, self.size = conv_id, [], [], 0

    def add(self, text: str, marked: bool) -> None:
        if marked:
            self.spans.append({"start": self.size, "end": self.size + len(text)})
        self.parts.append(text)
        self.size += len(text)

    def row(self) -> tuple:
        whole = "".join(self.parts)
        return self.conv_id, sum(1 for _ in read_back(whole)), whole, self.spans


class _Digest:
    """Reads turns back from the output as soon as they are complete and hashes them."""

    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]

    def __init__(self, conv_id: int | None):
        self.conv_id, self.n, self.loss_chars, self.size = conv_id, 0, 0, 0
        self.turns, self.loss, self.parts = hashlib.sha256(), hashlib.sha256(), []

    def add(self, text: str, marked: bool) -> None:
        self.size += len(text)
        self.parts.append(text)
        if marked:
            plain = unescape(text)
            self.loss_chars += len(plain)
            self.loss.update(plain.encode())
        if not marked and text.endswith(END + "\n"):
            # An escaped end string can only close a piece of text, never be followed by the newline of the template.
            self.flush()

    def flush(self) -> None:
        whole = "".join(self.parts)
        try:
            found = list(read_back(whole))
        except (StopIteration, RuntimeError):
            return  # the piece was a text that ends like a turn; the real end follows
        self.parts.clear()
        for role, text in found:
            self.n += 1
            self.turns.update(f"{role}\n{text}\n".encode())

    def row(self) -> tuple:
        self.flush()
        return self.conv_id, self.n, self.turns.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.size


#: A conversation that imitates every control string.
PROBE_ID, PROBE_TEXT = -7, r"\### Assistant: </turn> ok"


def op2_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests, read back from the output, of all conversations and of the probe conversation."""
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    probe = spark.range(2).select(
        F.lit(PROBE_ID).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit(PROBE_TEXT).alias("text"),
    )
    return format_conversations(turns.unionByName(probe), digest=True)


#: The same digests in SQL: what is read back is what was put in, and each escaped sign adds one character.
OP2_SQL = """
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\\### Assistant: </turn> ok'
), sized AS (
  SELECT *,
    4 + length(role) + (length(role) - length(replace(role, '\\', ''))) + (length(role) - length(replace(role, ':', '')))
      + (length(role) - length(replace(role, '### ', ''))) / 4 + (length(role) - length(replace(role, '</turn>', ''))) / 7
      + 2 + length(text) + (length(text) - length(replace(text, '\\', '')))
      + (length(text) - length(replace(text, '### ', ''))) / 4 + (length(text) - length(replace(text, '</turn>', ''))) / 7 + 8 AS chars
  FROM turns
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(chars) AS BIGINT) AS formatted_chars
FROM sized GROUP BY conv_id
"""
