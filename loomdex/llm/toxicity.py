"""Toxicity of documents: a weighted lexicon, matched after folding disguises, normalised by length.

Texts are folded first: compatibility forms, case, Cyrillic and Greek letters
that look Latin, digits and signs that stand for letters inside a word. One
Aho-Corasick automaton then finds all lexicon entries in one pass: whole words,
word beginnings (toxic stems with any ending), and exception phrases, whose
words do not count. A word counts once, with its heaviest entry. The score is a
logistic function of the summed weights by length.

Entries and weights are learned from labelled documents (log odds of document
counts), the logistic function from others that the lexicon has not seen.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomdex.llm import words as wd
from loomdex.llm.labelled import sample

# Letters of other scripts that look like Latin ones, signs that stand for letters,
# words that insult in any setting, and phrases in which such a word is harmless.
HOMOGLYPHS = str.maketrans("аеорсухіјѕԁһӏвкмнтαενικορτυχ", "aeopcyxijsdhlbkmhtaevikoptux")
SIGNS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i", "|": "l"}
INSULTS = ("idiot", "moron", "scum", "stupid", "worthless", "pathetic")
EXCEPTIONS = ("trash can", "trash cans", "clown fish", "sore loser", "pond scum", "class clown")

LOOKALIKE = re.compile("[аеорсухіјѕԁһӏвкмнтαενικορτυχ]")
SIGN = re.compile(r"[013457@$!|](?=[^\W\d_])|(?<=[^\W\d_])[013457@$!|](?=[^\W_])")
BREAK = re.compile(r"[\W_]+")

#: Labelled documents of each class to learn from, and lexicon entries to keep at most.
SAMPLE, ENTRIES = 3000, 5000
#: Lengths of word beginnings that may become entries.
STEMS = range(4, 9)
#: Documents that must show an entry, and its least weight.
SUPPORT, LEAST = 8, 2.0


def folded(text: str | None) -> str:
    """Words of a text without their disguises, each between blanks."""
    if not text:
        return " "
    if not text.isascii() and not unicodedata.is_normalized("NFKC", text):
        text = unicodedata.normalize("NFKC", text)
    text = text.lower()
    if not text.isascii() and LOOKALIKE.search(text):
        text = text.translate(HOMOGLYPHS)
    text = SIGN.sub(lambda m: SIGNS[m[0]], text)
    return f" {BREAK.sub(' ', text).strip()} "


@dataclass
class Lexicon:
    """Entries begin with a blank; whole words end with one. ``curve``: bias and a factor for each feature."""

    weights: dict[str, float] = field(default_factory=lambda: {f" {w} ": 4.0 for w in INSULTS})
    exceptions: tuple[str, ...] = EXCEPTIONS
    curve: tuple[float, ...] = (-4.0, 1.5, 1.0)

    def automaton(self) -> ahocorasick.Automaton:
        a = ahocorasick.Automaton()
        for entry, weight in self.weights.items():
            a.add_word(entry, (len(entry), weight))
        for phrase in self.exceptions:
            entry = folded(phrase)
            a.add_word(entry, (len(entry), None))
        a.make_automaton()
        return a


def features(text: str, automaton: ahocorasick.Automaton) -> tuple[float, float]:
    """Summed weight, and summed weight by the root of the words, of a folded text."""
    best, calm = {}, []
    if len(automaton):
        for end, (length, weight) in automaton.iter(text):
            start = end - length + 1
            if weight is None:
                calm.append((start, end))
            elif weight > best.get(start, 0.0):
                best[start] = weight
    if calm:
        best = {s: w for s, w in best.items() if not any(a <= s < b for a, b in calm)}
    total = sum(best.values())
    n_words = max(1, text.count(" ") - 1)
    return math.log1p(total), total / math.sqrt(n_words)


def matched(text: str, automaton: ahocorasick.Automaton) -> list[str]:
    """Entries found in a folded text, for reports."""
    return [text[end - length + 1 : end + 1].strip() for end, (length, weight) in automaton.iter(text) if weight is not None]


def chance(x: np.ndarray, curve: tuple[float, ...]) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(curve[0] + x @ np.array(curve[1:]), -40, 40)))


def terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(text, label) to partial counts (term, toxic, clean) of documents that show a term."""
    toxic, clean = Counter(), Counter()
    for batch in batches:
        for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            shown = set()
            for word in set(folded(text).split()):
                shown.add(f" {word} ")
                shown.update(f" {word[:n]}" for n in STEMS if len(word) > n)
            (toxic if label else clean).update(shown)
    names = sorted(toxic)  # terms of clean documents alone never become entries
    yield pa.RecordBatch.from_arrays(
        [pa.array(names, pa.string()), pa.array([toxic[t] for t in names], pa.int64()), pa.array([clean[t] for t in names], pa.int64())],
        ["term", "toxic", "clean"])


def origin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Add the least hash of three-word shingles: most near copies share it, and only one of them should vote."""
    for batch in batches:
        for w in wd.words(batch.column(1), lower=True):
            at, row = wd.row_windows(w, 3)
            least = np.arange(w.rows, dtype=np.int64)
            if len(at):
                starts = np.flatnonzero(np.diff(row, prepend=-1))
                least[row[starts]] = np.minimum.reduceat(wd.window_hashes(wd.word_hashes(w), 3)[at], starts).view(np.int64)
            part = batch.slice(w.first, w.rows)
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(least)], ["doc_id", "text", "label", "origin"])


def learn(docs: DataFrame, labels: DataFrame, usable: Column, label: str = "toxic", rows: int = SAMPLE,
          entries: int = ENTRIES, support: int = SUPPORT, least: float = LEAST,
          exceptions: tuple[str, ...] = EXCEPTIONS) -> Lexicon:
    """A lexicon from at most ``rows`` usable labelled documents of each class, of which near copies vote once.

    Two thirds of the sample give the entries, one third the curve. Without
    labelled documents of both classes the given insults and curve stand.
    """
    drawn = sample(docs, labels, label, usable, rows).mapInArrow(origin, "doc_id long, text string, label int, origin long")
    drawn = drawn.groupBy("origin", "label").agg(F.min_by("text", F.md5(F.col("doc_id").cast("string"))).alias("text"))
    drawn = drawn.select("text", "label", (F.pmod(F.col("origin"), F.lit(3)) == 0).alias("late")).persist()
    sizes = {(r.label, r.late): r.n for r in drawn.groupBy("label", "late").agg(F.count("*").alias("n")).collect()}
    n_toxic, n_clean = sizes.get((1, False), 0), sizes.get((0, False), 0)
    lexicon = Lexicon(exceptions=exceptions)
    if n_toxic and n_clean:
        counts = drawn.where("not late").select("text", "label").mapInArrow(terms, "term string, toxic long, clean long")
        # a term that only a task's clean documents show is missing in its part, so clean counts come from a second look
        toxic = counts.groupBy("term").agg(F.sum("toxic").alias("toxic")).where(F.col("toxic") >= support)
        names = [r.term for r in toxic.orderBy(F.desc("toxic"), "term").limit(40 * entries).collect()]
        shown = count_terms(drawn.where("not late"), names)
        weighted = []
        for term, (t, c) in shown.items():
            weight = math.log((t + 0.5) / (n_toxic + 1)) - math.log((c + 0.5) / (n_clean + 1))
            if weight >= least:
                weighted.append((t * weight, term, weight))
        chosen = sorted(weighted, reverse=True)[:entries]
        lexicon.weights |= {term: weight for _, term, weight in chosen}
    automaton = lexicon.automaton()
    if sizes.get((1, True), 0) and sizes.get((0, True), 0):
        seen = drawn.where("late").select("text", "label").mapInArrow(measure(automaton), "a double, b double, label int").collect()
        x, y = np.array([(r.a, r.b) for r in seen]), np.array([r.label for r in seen], float)
        lexicon.curve = fit(x, y)
    drawn.unpersist()
    return lexicon


def count_terms(drawn: DataFrame, names: list[str]) -> dict[str, tuple[int, int]]:
    """For each of the named terms, how many toxic and clean documents of the sample show it."""
    wanted = frozenset(names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        toxic, clean = Counter(), Counter()
        for batch in batches:
            for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                shown = set()
                for word in set(folded(text).split()):
                    shown.update(t for t in (f" {word} ", *(f" {word[:n]}" for n in STEMS if len(word) > n)) if t in wanted)
                (toxic if label else clean).update(shown)
        found = sorted({*toxic, *clean})
        yield pa.RecordBatch.from_arrays(
            [pa.array(found, pa.string()), pa.array([toxic[t] for t in found], pa.int64()), pa.array([clean[t] for t in found], pa.int64())],
            ["term", "toxic", "clean"])

    parts = drawn.select("text", "label").mapInArrow(run, "term string, toxic long, clean long")
    return {r.term: (r.toxic, r.clean) for r in parts.groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean")).collect()}


def measure(automaton: ahocorasick.Automaton):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array([features(folded(t), automaton) for t in batch.column(0).to_pylist()]).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(x[:, 0]), pa.array(x[:, 1]), batch.column(1)], ["a", "b", "label"])

    return run


def fit(x: np.ndarray, y: np.ndarray, rounds: int = 50, ridge: float = 0.3) -> tuple[float, ...]:
    """Logistic regression by Newton steps; both classes weigh the same."""
    ones = np.hstack((np.ones((len(x), 1)), x))
    weight = np.where(y > 0, 0.5 / max(1, y.sum()), 0.5 / max(1, (1 - y).sum())) * len(y)
    beta, penalty = np.zeros(ones.shape[1]), ridge * np.diag([1e-3] + [1.0] * x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(ones @ beta, -40, 40)))
        step = np.linalg.solve((ones * (weight * p * (1 - p))[:, None]).T @ ones + penalty, ones.T @ (weight * (y - p)) - penalty @ beta)
        beta += step
        if np.abs(step).max() < 1e-8:
            break
    return tuple(float(b) for b in beta)


def scored(docs: DataFrame, lexicon: Lexicon, keep: tuple[str, ...] = ("doc_id",), report: bool = False) -> DataFrame:
    """Columns ``keep`` of ``docs`` (text, ...) and ``score`` (0 to 1), one row for each row; ``report`` adds ``hits``.

    The whole text counts. Null, empty and blank texts have no hits and get the
    score of that; rows that repeat are scored alike; other columns are ignored.
    """
    return judged(docs, lexicon, keep, report).select("_key.*", "score", *(["hits"] if report else []))


def judged(docs: DataFrame, lexicon: Lexicon, keep: tuple[str, ...], report: bool = False) -> DataFrame:
    """(_key, score, hits): the kept columns as one struct, so that their names may be any."""
    source = docs.select(F.struct(*keep).alias("_key"), F.col("text").cast("string").alias("_text"))
    automaton = lexicon.automaton()
    curve = lexicon.curve

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values, hits = [], []
            for text in batch.column(1):
                text = folded(text.as_py())
                values.append(features(text, automaton))
                hits.append(matched(text, automaton) if report else [])
            score = chance(np.array(values).reshape(-1, 2), curve)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score), pa.array(hits, pa.list_(pa.string()))], ["_key", "score", "hits"])

    schema = f"_key {source.schema['_key'].dataType.simpleString()}, score double, hits array<string>"
    return source.mapInArrow(run, schema)


def without_toxic(docs: DataFrame, lexicon: Lexicon, threshold: float = 0.7) -> DataFrame:
    """The rows of ``docs`` that score below ``threshold``, unchanged."""
    return judged(docs, lexicon, tuple(docs.columns)).where(F.col("score") < threshold).select("_key.*")
