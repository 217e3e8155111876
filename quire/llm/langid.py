"""Operator 10, language identification: script ranges, per-word scores, Viterbi over words.

Training counts hashed letter trigrams (with word ends) and scripts of each language. A word is
scored by the sum of its trigrams' log probabilities in each language that uses the word's script.
Viterbi with a penalty for each switch labels the words, so that texts in several languages fall
into spans; the language with the most letters is the text's.
"""

from __future__ import annotations

import functools
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Starts of the scripts' code point ranges (from the Unicode block list).
SCRIPTS = (
    (0x0000, "latin"), (0x0370, "greek"), (0x0400, "cyrillic"), (0x0530, "armenian"), (0x0590, "hebrew"),
    (0x0600, "arabic"), (0x0780, "other"), (0x0900, "devanagari"), (0x0980, "bengali"), (0x0A00, "indic"),
    (0x0E00, "thai"), (0x0E80, "other"), (0x10A0, "georgian"), (0x1100, "hangul"), (0x1200, "other"),
    (0x1E00, "latin"), (0x1F00, "greek"), (0x2000, "other"), (0x3040, "kana"), (0x3100, "han"),
    (0x3130, "hangul"), (0x3190, "han"), (0xA000, "other"), (0xAC00, "hangul"), (0xD7B0, "other"),
    (0xF900, "han"), (0xFB00, "other"), (0x20000, "han"),
)
SCRIPT_NAMES = sorted({n for _, n in SCRIPTS})

BITS = 15
BUCKETS = 1 << BITS
#: Letters scored at once; bounds the memory of a batch.
SLICE = 1 << 19
#: Longer texts are read in slices, with Viterbi's state carried from one to the next.
LONG = 1 << 21


@functools.cache
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """By code point: is a letter; is part of a word; lower case; and the script ranges."""
    kinds = np.array([unicodedata.category(chr(c))[0] for c in range(0x110000)])
    letter = kinds == "L"
    word = letter | (kinds == "M")
    lower = np.arange(0x110000, dtype=np.uint32)
    for c in np.flatnonzero(letter).tolist():
        low = chr(c).lower()
        if len(low) == 1:
            lower[c] = ord(low)
    starts = np.array([s for s, _ in SCRIPTS], np.uint32)
    names = np.array([SCRIPT_NAMES.index(n) for _, n in SCRIPTS], np.int16)
    return letter, word, lower, starts, names


@dataclass
class Words:
    """The words of some texts: where they start, how long they are, and their trigram buckets."""

    text: np.ndarray  # number of the text of each word
    start: np.ndarray  # code point in its text
    length: np.ndarray
    script: np.ndarray  # of the first letter
    buckets: np.ndarray  # of all letters of all words
    has_letter: np.ndarray  # by text


def _hashes(low: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Buckets of the trigrams around the places `at` of lower-cased letters, 0 where no word is."""
    with np.errstate(over="ignore"):
        h = low[at - 1] * np.uint32(0x9E3779B1) ^ low[at] * np.uint32(0x85EBCA77) ^ low[np.minimum(at + 1, len(low) - 1)] * np.uint32(0xC2B2AE3D)
        h ^= h >> np.uint32(15)
        h *= np.uint32(0x2C1B3C6D)
    return (h >> np.uint32(32 - BITS)).astype(np.int64)


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def read_words(texts: list[str]) -> Words:
    letter, word, lower, starts, names = _tables()
    codes = _codes("\0" + "".join(f"{t}\0" for t in texts))
    offsets = np.cumsum([1, *(len(t) + 1 for t in texts)])
    inside = word[codes]
    at = np.flatnonzero(inside)
    low = np.where(inside, lower[codes], 0).astype(np.uint32)
    first = at[~inside[at - 1]]
    ends = np.flatnonzero(inside[:-1] & ~inside[1:])
    owner = np.searchsorted(offsets, first, "right") - 1
    script = names[np.searchsorted(starts, codes[first], "right") - 1]
    has = np.zeros(len(texts), bool)
    has[np.searchsorted(offsets, at[letter[codes[at]]], "right") - 1] = True
    return Words(owner, first - offsets[owner], ends - first + 1, script, _hashes(low, at), has)


@dataclass
class Slice:
    """The letters of one slice of a text. `first` marks letters that start a word; the others go on with it."""

    buckets: np.ndarray
    place: np.ndarray  # code point of each letter in the text
    first: np.ndarray
    script: np.ndarray  # of the letters that start a word
    has_letter: bool


def slices(text: str) -> Iterator[Slice]:
    """A text of any length in slices of SLICE code points, each read with one neighbour on either side."""
    letter, word, lower, starts, names = _tables()
    for begin in range(0, len(text), SLICE):
        end = min(begin + SLICE, len(text))
        codes = _codes((text[begin - 1] if begin else "\0") + text[begin:end] + (text[end] if end < len(text) else "\0"))
        inside = word[codes]
        at = np.flatnonzero(inside[1:-1]) + 1
        low = np.where(inside, lower[codes], 0).astype(np.uint32)
        first = ~inside[at - 1]
        script = names[np.searchsorted(starts, codes[at[first]], "right") - 1]
        yield Slice(_hashes(low, at), at - 1 + begin, first, script, bool(letter[codes[at]].any()))


@dataclass
class LanguageModel:
    languages: list[str]
    logp: np.ndarray  # (BUCKETS, languages) float32
    uses: np.ndarray  # (scripts, languages) bool

    def emissions(self, words: Words) -> np.ndarray:
        """(words, languages): log scores; languages that don't use a word's script are out."""
        n = len(words.length)
        out = np.zeros((n, len(self.languages)), np.float32)
        ends = np.cumsum(words.length)
        k = 0
        while k < n:
            base = int(ends[k - 1]) if k else 0
            stop = max(k + 1, int(np.searchsorted(ends, base + SLICE, "right")))
            some = self.logp[words.buckets[base : int(ends[stop - 1])]]
            out[k:stop] = np.add.reduceat(some, (ends[k:stop] - words.length[k:stop]) - base, axis=0)
            k = stop
        return self.narrowed(out, words.script)

    def narrowed(self, scores: np.ndarray, script: np.ndarray) -> np.ndarray:
        uses = self.uses[script]
        return np.where(uses | ~uses.any(axis=1, keepdims=True), scores, np.float32(-1e6))


def viterbi(scores: np.ndarray, lengths: np.ndarray, penalty: float) -> np.ndarray:
    """The best label of each word. `scores` holds the sequences one after another.

    All sequences advance together, longest first; the few that outlast the rest go on one by one.
    """
    n_labels = scores.shape[1]
    label = np.zeros(len(scores), np.int64)
    order = np.argsort(-lengths, kind="stable")
    lengths = lengths[order]
    starts = (np.cumsum(np.concatenate([[0], lengths_in_order(order, lengths)])))[:-1][order]
    live = lengths > 0
    lengths, starts = lengths[live], starts[live]
    if not len(lengths):
        return label
    came = np.zeros(len(scores), np.int16)
    moved = np.zeros(scores.shape, bool)
    v = scores[starts].astype(np.float64)
    together = int(lengths[min(7, len(lengths) - 1)])  # beyond, under 8 sequences go on
    alive = np.searchsorted(-lengths, -np.arange(1, together + 1), "right")  # sequences longer than t
    for t in range(1, together):
        a = int(alive[t])
        at = starts[:a] + t
        top = v[:a].argmax(axis=1)
        best = v[np.arange(a), top] - penalty
        came[at] = top
        moved[at] = best[:, None] > v[:a]
        v[:a] = np.maximum(v[:a], best[:, None]) + scores[at]
    tail = int(np.searchsorted(-lengths, -together, "left"))  # sequences with more than `together` words
    last = v.argmax(axis=1)
    for d in range(tail):
        s, n = int(starts[d]), int(lengths[d])
        state = v[d].tolist()
        for t in range(together, n):
            row = scores[s + t].tolist()
            best = max(state)
            came[s + t] = state.index(best)
            best -= penalty
            for k in range(n_labels):
                if best > state[k]:
                    moved[s + t, k] = True
                    state[k] = best + row[k]
                else:
                    state[k] += row[k]
        now = max(range(n_labels), key=lambda k: (state[k], -k))
        for t in range(n - 1, together - 1, -1):
            label[s + t] = now
            if moved[s + t, now]:
                now = int(came[s + t])
        last[d] = now
    for t in range(together - 1, -1, -1):
        a = int(alive[t])
        at = starts[:a] + t
        label[at] = last[:a]
        last[:a] = np.where(moved[at, last[:a]], came[at], last[:a])
    return label


def lengths_in_order(order: np.ndarray, sorted_lengths: np.ndarray) -> np.ndarray:
    """Undo a sort of lengths."""
    out = np.empty_like(sorted_lengths)
    out[order] = sorted_lengths
    return out


def count_trigrams(rows: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """lang, bucket, n: trigrams (and, from BUCKETS on, words by script) of all rows with a text and a language."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}

        def add(name: str, buckets: np.ndarray, script: np.ndarray) -> None:
            mine = sums.setdefault(name, np.zeros(BUCKETS + len(SCRIPT_NAMES), np.int64))
            mine[:BUCKETS] += np.bincount(buckets, minlength=BUCKETS)
            mine[BUCKETS:] += np.bincount(script, minlength=len(SCRIPT_NAMES))

        def out() -> Iterator[pa.RecordBatch]:
            for name, counts in sums.items():
                at = np.flatnonzero(counts)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([name] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(counts[at])], names=["lang", "bucket", "n"]
                )
            sums.clear()

        for batch in batches:
            texts, langs = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for some, names in _chunks(texts, langs):
                if len(some) == 1 and len(some[0]) > SLICE:
                    for part in slices(some[0]):
                        add(names[0], part.buckets, part.script)
                    continue
                words = read_words(some)
                names = np.array(names, object).astype(str)
                known = np.unique(names[words.text]) if len(words.text) else []
                of_word = np.searchsorted(known, names[words.text]) if len(words.text) else np.zeros(0, int)
                of_letter = np.repeat(of_word, words.length)
                for k, name in enumerate(known):
                    add(str(name), words.buckets[of_letter == k], words.script[of_word == k])
            if len(sums) > 200:  # memory of a task is bounded
                yield from out()
        yield from out()

    counted = rows.where(F.col(text).isNotNull() & F.col(lang).isNotNull()).select(text, lang)
    return counted.mapInArrow(run, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))


def train(rows: DataFrame, text: str = "text", lang: str = "lang", alpha: float = 0.5) -> LanguageModel:
    """Count trigrams and scripts of all rows with a text and a language.

    What comes to the driver is at most (BUCKETS + scripts) numbers a language; texts of any length are
    read whole, repeated rows count as often as they occur, and empty texts and an empty table add
    nothing. A language uses a script that has 1 % of its words. Other columns are ignored.
    """
    counts: dict[str, np.ndarray] = {}
    for name, bucket, n in count_trigrams(rows, text, lang).toLocalIterator():
        if name not in counts:
            counts[name] = np.zeros(BUCKETS + len(SCRIPT_NAMES))
        counts[name][bucket] = n
    names = sorted(counts)
    table = np.array([counts[n][:BUCKETS] for n in names]).reshape(len(names), BUCKETS).T + alpha
    scripts = np.array([counts[n][BUCKETS:] for n in names]).reshape(len(names), len(SCRIPT_NAMES)).T
    return LanguageModel(names, np.log(table / table.sum(axis=0)).astype(np.float32), scripts > 0.01 * scripts.sum(axis=0))


def _chunks(texts: list, others: list, chars: int = 1 << 20) -> Iterator[tuple[list, list]]:
    """Neighbouring texts of about `chars` together; a longer text comes alone."""
    start, size = 0, 0
    for k, t in enumerate(texts):
        if size and size + len(t) > chars:
            yield texts[start:k], others[start:k]
            start, size = k, 0
        size += len(t)
    if start < len(texts):
        yield texts[start:], others[start:]


Judged = tuple[list, list, list]


def judge(some: list[str], model: LanguageModel, penalty: float, spans: bool) -> Judged:
    """Languages, scores and spans of some texts, all at once."""
    words = read_words(some)
    n, languages = len(some), model.languages
    if not languages:
        return ["und"] * n, [0.0] * n, [[] for _ in some]
    label = viterbi(model.emissions(words), np.bincount(words.text, minlength=n), penalty)
    letters = np.zeros((n, len(languages)), np.int64)
    np.add.at(letters, (words.text, label), words.length)
    top = letters.argmax(axis=1)
    share = letters[np.arange(n), top] / np.maximum(1, letters.sum(axis=1))
    names = [languages[k] if has else "und" for k, has in zip(top.tolist(), words.has_letter.tolist())]
    score = np.where(words.has_letter, share, 0.0).tolist()
    found: list[list] = [[] for _ in some]
    if spans and len(label):
        cut = np.flatnonzero((np.diff(label) != 0) | (np.diff(words.text) != 0)) + 1
        begin, end = np.concatenate([[0], cut]), np.concatenate([cut, [len(label)]]) - 1
        for b, e in zip(begin.tolist(), end.tolist()):
            found[words.text[b]].append(
                {"start": int(words.start[b]), "end": int(words.start[e] + words.length[e]), "lang": languages[label[b]]}
            )
    return names, score, found


def _scored(text: str, model: LanguageModel) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, bool]]:
    """Starts, lengths and scores of a text's words, and whether it has letters, slice by slice; a word that a slice cuts waits for its rest."""
    total, start, length, script = None, 0, 0, 0  # the word at hand
    for part in slices(text):
        if not len(part.place):
            continue
        rows = model.logp[part.buckets]
        cuts = np.flatnonzero(part.first)
        lead = int(cuts[0]) if len(cuts) else len(rows)
        if total is not None:
            total = total + rows[:lead].sum(axis=0)
            length += lead
        done: tuple[list, list, list, list] = ([], [], [], [])
        if len(cuts):
            sums = np.add.reduceat(rows, cuts, axis=0)
            sizes = np.diff(np.append(cuts, len(rows)))
            starts = part.place[cuts]
            if total is not None:
                done = ([start], [length], [script], [total])
            keep = slice(0, len(cuts) - 1)
            cols = (
                np.array(done[0] + starts[keep].tolist(), np.int64), np.array(done[1] + sizes[keep].tolist(), np.int64),
                np.array(done[2] + part.script[keep].tolist(), np.int64), np.concatenate([np.array(done[3], np.float32).reshape(-1, rows.shape[1]), sums[keep]]),
            )
            total, start, length, script = sums[-1], int(starts[-1]), int(sizes[-1]), int(part.script[-1])
            yield cols[0], cols[1], model.narrowed(cols[3], cols[2]), part.has_letter
        else:
            yield np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros((0, rows.shape[1]), np.float32), part.has_letter
    if total is not None:
        yield np.array([start]), np.array([length]), model.narrowed(total[None, :].astype(np.float32), np.array([script])), False


def judge_long(text: str, model: LanguageModel, penalty: float, spans: bool) -> tuple[str, float, list]:
    """The same for one long text. What is kept of each word is where it is and, in bits, where its states came from."""
    languages = model.languages
    if not languages:
        return "und", 0.0, []
    state, has = None, False
    kept: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []
    for starts, lengths, scores, some in _scored(text, model):
        has |= some
        came, moved = np.zeros(len(scores), np.int16), np.zeros(scores.shape, bool)
        for t, row in enumerate(scores.astype(np.float64)):
            if state is None:
                state = row
                continue
            came[t] = top = int(state.argmax())
            best = state[top] - penalty
            moved[t] = best > state
            state = np.maximum(state, best) + row
        kept.append((starts, lengths, came, np.packbits(moved, axis=1)))
    if state is None:
        return "und", 0.0, []
    now, letters, found = int(state.argmax()), np.zeros(len(languages), np.int64), []
    for starts, lengths, came, bits in reversed(kept):
        moved = np.unpackbits(bits, axis=1, count=len(languages)).astype(bool)
        label = np.zeros(len(starts), np.int64)
        for t in range(len(starts) - 1, -1, -1):
            label[t] = now
            if moved[t, now]:
                now = int(came[t])
        np.add.at(letters, label, lengths)
        if spans and len(label):
            cut = np.flatnonzero(np.diff(label)) + 1
            for b, e in zip(reversed([0, *cut.tolist()]), reversed([*cut.tolist(), len(label)])):
                span = {"start": int(starts[b]), "end": int(starts[e - 1] + lengths[e - 1]), "lang": languages[label[b]]}
                if found and found[-1]["lang"] == span["lang"]:
                    span["end"] = found.pop()["end"]
                found.append(span)
    if not has:
        return "und", 0.0, found[::-1]
    top = int(letters.argmax())
    return languages[top], float(letters[top] / max(1, letters.sum())), found[::-1]


def identify(docs: DataFrame, model: LanguageModel, text: str = "text", penalty: float = 6.0, spans: bool = True) -> DataFrame:
    """Keep every row and add lang_pred string, score double and, if asked, spans.

    lang_pred is the language with the most letters, ties to the first by name; score is its share
    of the letters. Null texts and texts without a letter get `und` and score 0. With a model of no
    language every text is `und`. spans: array<struct<start, end, lang>> in code points. Whole texts
    are read, whatever their length; long ones are streamed. Repeated rows are judged alike. Columns named
    like the added ones are replaced, any other name is free. An empty table gives no rows.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)  # languages * BUCKETS floats
    made = ["lang_pred", "score", *(["spans"] if spans else [])]
    keep = [c for c in docs.columns if c not in made]
    at = keep.index(text)
    schema = docs.select(*(f"`{c}`" for c in keep)).schema.add("lang_pred", "string").add("score", "double")
    span_type = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("lang", pa.string())]))
    if spans:
        span = T.StructType().add("start", "long").add("end", "long").add("lang", "string")
        schema = schema.add("spans", T.ArrayType(span))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            texts = [t or "" for t in batch.column(at).to_pylist()]
            cols: list[list] = [[], [], []]
            for some, _ in _chunks(texts, texts, LONG):
                if len(some[0]) > LONG:
                    for col, one in zip(cols, judge_long(some[0], model, penalty, spans)):
                        col.append(one)
                    continue
                for col, part in zip(cols, judge(some, model, penalty, spans)):
                    col.extend(part)
            arrays = [pa.array(cols[0], pa.string()), pa.array(cols[1], pa.float64())]
            if spans:
                arrays.append(pa.array(cols[2], span_type))
            yield pa.RecordBatch.from_arrays([*batch.columns, *arrays], names=[*batch.schema.names, *made])

    return docs.select(*(f"`{c}`" for c in keep)).mapInArrow(run, schema)


def op10_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document; learned from those whose crc32(doc_id) mod 4 is not 2."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    fold = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 4
    model = train(docs.where(fold != 2).select("text", "lang"))
    rows = docs.select("doc_id", (fold == 2).alias("held_out"), "text")
    return identify(rows, model, spans=False).select("doc_id", "held_out", "lang_pred", "score")
