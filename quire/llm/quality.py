"""Operator 4, quality rules by weak supervision. Native: DataFrame expressions only.

Each rule looks at one property of a text and votes good (1), bad (-1) or abstains (0). Over the
counts of vote patterns, expectation-maximisation estimates how often each rule votes so on good
and on bad texts; the posterior probability of being good replaces "all rules must pass".
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm.common import SPACE_RUN, kept_row, materialize

#: Words in a window that counts as repeated when it is found again.
WINDOW = 8
#: Words in a stretch whose distinct words are counted, so that the share does not depend on a text's length.
STRETCH = 1000
COUNTS = (
    "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_distinct", "n_upper", "n_letters", "n_marks", "n_stops", "n_repeat_words",
)


def base_columns(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add the counts that rules look at; the text and all other columns are kept.

    n_words, word_chars (code points in words), n_symbols (of #*$%&|<>), n_lines (lines with a
    word), n_dup_lines (such lines equal to an earlier one), n_repeat_words (words inside 8-word
    windows that the text holds at least twice), n_distinct (distinct words of each stretch of 1000
    words, summed), n_upper, n_letters, n_marks (exclamation marks), n_stops (words that end in . ?
    or !), all long. Null and empty texts have zeros. Windows are compared by 64-bit hashes of eight
    word hashes, within one text only. Columns named like the counts are replaced, any other name is free.
    """
    row, unpacked = kept_row(docs, COUNTS)
    df = docs.select(row, F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("_t"))
    df = df.withColumn("_w", F.array_remove(F.split("_t", SPACE_RUN), ""))
    df = df.withColumn("_lines", F.array_remove(F.transform(F.split("_t", "\n"), lambda x: F.when(x.rlike("[^\\x20\\x09-\\x0D]"), x).otherwise("")), ""))
    df = df.withColumn("_h", F.transform("_w", lambda w: F.xxhash64(w)))
    at = ", ".join(f"_h[i + {k}]" for k in range(WINDOW))
    df = df.withColumn(
        "_win",
        F.expr(f"if(size(_h) >= {WINDOW}, transform(sequence(0, size(_h) - {WINDOW}), i -> xxhash64({at})), cast(array() as array<bigint>))"),
    )
    # Only texts with a repeated window pay for finding where: sort (hash, place), keep equal neighbours.
    places = (
        "transform(array(array_sort(transform(_win, (h, i) -> named_struct('h', h, 'i', i)))), s -> "
        "array_sort(transform(filter(sequence(0, size(s) - 1), k -> s[k].h <=> get(s, k - 1).h or s[k].h <=> get(s, k + 1).h), k -> s[k].i)))[0]"
    )
    covered = f"aggregate({places}, named_struct('last', -{WINDOW}, 'n', 0L), (a, x) -> named_struct('last', x, 'n', a.n + least({WINDOW}, x - a.last)), a -> a.n)"
    df = df.withColumn("n_repeat_words", F.expr(f"if(size(array_distinct(_win)) < size(_win), {covered}, 0L)"))
    length = F.length("_t")
    less = lambda pattern: (length - F.length(F.regexp_replace("_t", pattern, ""))).cast("long")
    df = df.withColumns(
        {
            "n_words": F.size("_w").cast("long"),
            "word_chars": F.length(F.array_join("_w", "")).cast("long"),
            "n_symbols": less("[#*$%&|<>]+"),
            "n_lines": F.size("_lines").cast("long"),
            "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
            "n_distinct": F.expr(
                f"aggregate(sequence(0, (size(_h) - 1) div {STRETCH}), 0L, (n, c) -> n + size(array_distinct(slice(_h, c * {STRETCH} + 1, {STRETCH}))))"
            ),
            "n_upper": less("\\p{Lu}+"),
            "n_letters": less("\\p{L}+"),
            "n_marks": less("!+"),
            "n_stops": F.size(F.split("_t", "[.?!](?=[\\x20\\x09-\\x0D]|$)")).cast("long") - 1,
        }
    )
    return df.select(*unpacked, *COUNTS)


@dataclass(frozen=True)
class Rule:
    """Votes bad where `bad` holds, else good where `good` holds, else abstains."""

    name: str
    bad: str
    good: str = "false"

    def vote(self) -> Column:
        return F.expr(f"case when n_words = 0 then 0 when {self.bad} then -1 when {self.good} then 1 else 0 end")


#: Products are compared instead of quotients, so no rule divides.
RULES = (
    Rule("symbols_per_word", "10 * n_symbols > n_words", "50 * n_symbols <= n_words"),
    Rule("letters_share", "100 * n_letters < 70 * word_chars", "100 * n_letters >= 88 * word_chars"),
    Rule("shouting", "10 * n_upper > 4 * n_letters", "10 * n_upper <= n_letters"),
    Rule("marks_per_word", "10 * n_marks > n_words"),
    Rule("repeated_windows", "100 * n_repeat_words > 15 * n_words", "n_repeat_words = 0"),
    Rule("repeated_lines", "n_dup_lines >= 2 and 10 * n_dup_lines > 2 * n_lines"),
    Rule("few_distinct_words", "n_words >= 60 and 100 * n_distinct < 30 * n_words"),
    Rule("few_words", "n_words < 20"),
    Rule("word_length", "word_chars > 16 * n_words or 2 * word_chars < 3 * n_words"),
    Rule("sentence_ends", "n_words >= 100 and 200 * n_stops < n_words"),
)


@dataclass
class LabelModel:
    """P(vote | good) and P(vote | bad) of each rule, for the votes -1, 0 and 1."""

    prior: float
    good: list[list[float]]
    bad: list[list[float]]

    def log_odds(self, votes: tuple[int, ...]) -> float:
        x = math.log(self.prior / (1 - self.prior))
        for r, v in enumerate(votes):
            if v:
                x += math.log(self.good[r][v + 1] / self.bad[r][v + 1])
        return x

    def column(self, votes: list[Column]) -> Column:
        """The posterior log odds as an expression."""
        out = F.lit(math.log(self.prior / (1 - self.prior)))
        for r, v in enumerate(votes):
            for k in (-1, 1):
                out = out + F.when(v == k, F.lit(math.log(self.good[r][k + 1] / self.bad[r][k + 1]))).otherwise(F.lit(0.0))
        return out


def fit(patterns: dict[tuple[int, ...], int], n_rules: int, rounds: int = 100, strength: float = 20.0) -> LabelModel:
    """Expectation-maximisation over pattern counts (at most 3 ** rules of them, whatever the input).

    An abstention says nothing of the label, so only cast votes count. Each rule starts as better
    than chance, and pseudo-counts of `strength` texts hold it there where votes are few.
    """
    start_good, start_bad = [0.02, 0.0, 0.98], [0.75, 0.0, 0.25]
    model = LabelModel(0.85, [start_good[:] for _ in range(n_rules)], [start_bad[:] for _ in range(n_rules)])
    for _ in range(rounds):
        sums = {y: [[strength * p for p in s] for _ in range(n_rules)] for y, s in ((1, start_good), (0, start_bad))}
        mass = {1: strength * 0.85, 0: strength * 0.15}
        for votes, n in patterns.items():
            p = 1 / (1 + math.exp(-max(-500.0, min(500.0, model.log_odds(votes)))))
            for y, share in ((1, p * n), (0, (1 - p) * n)):
                mass[y] += share
                for r, v in enumerate(votes):
                    if v:
                        sums[y][r][v + 1] += share
        scale = lambda row: [row[0] / (row[0] + row[2]), 0.0, row[2] / (row[0] + row[2])]
        new = LabelModel(mass[1] / (mass[0] + mass[1]), [scale(x) for x in sums[1]], [scale(x) for x in sums[0]])
        moved = max([abs(new.prior - model.prior), *(abs(a[0] - b[0]) for a, b in zip(new.good + new.bad, model.good + model.bad))])
        model = new
        if moved < 1e-9:
            break
    return model


def judge(
    docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES, threshold: float = 0.5, keep_text: bool = True
) -> DataFrame:
    """Keep every row and add the counts, base_failed, votes array<int>, quality double and kept.

    base_failed: fewer than 20 words, or over 30 % of words in repeated windows. quality is the
    posterior probability of being good; kept is quality >= threshold and not base_failed. The counts
    are written once, as the model needs them before any row can be judged. Null and
    empty texts fail the base; repeated rows are judged alike; texts of any length are read whole.
    Columns named like the added ones (and the counts) are replaced, any other name is free. An empty
    table gives no rows.
    """
    counted = base_columns(docs.drop("votes", "base_failed", "quality", "kept"), text)
    if not keep_text:
        counted = counted.drop(text)
    votes = F.array(*(r.vote().cast("int") for r in rules))
    counted = materialize(counted.withColumn("votes", votes), "counted")
    patterns = {tuple(v): n for v, n in counted.groupBy("votes").count().collect()}
    model = fit(patterns, len(rules))
    odds = model.column([F.col("votes")[r] for r in range(len(rules))])
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    return (
        counted.withColumn("base_failed", failed)
        .withColumn("quality", 1 / (1 + F.exp(-odds)))
        .withColumn("kept", ~failed & (F.col("quality") >= threshold))
    )


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The counts and the verdict for all documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return judge(docs, keep_text=False).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "quality"
    )


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: rejected documents go.

    Columns keep their values, whatever their names. Null and empty texts are rejected, as too short; repeated
    rows share a verdict, as do texts with equal votes; long texts are read whole. An empty table gives no rows.
    """
    row, unpacked = kept_row(docs)
    return judge(docs.select(row, F.col("text")), keep_text=False).where("kept").select(*unpacked)
