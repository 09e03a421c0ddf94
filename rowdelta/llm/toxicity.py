"""Toxicity by a weighted lexicon.

Texts are folded (case, accents, look-alike letters, digits that stand for letters) to words of plain letters. An Aho-Corasick
automaton over the folded text finds the lexicon's entries, which are words and beginnings of words; entries inside an exception
phrase don't count. Each different word counts once, by its heaviest entry, so that a common word's repeats don't add up. A document's score is a logistic function of the summed weights and
of their density, that is the sum normalised by length.

The lexicon and the logistic function are fitted on labelled rows outside the held-out fold. The fit reads at most ``FIT_ROWS`` rows of
either class (those with the smallest hashes of their ids), which bounds the lexicon and what reaches the driver; every document is scored in full.
"""

from __future__ import annotations

import math
import unicodedata
import zlib
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .common import cut, in_batches, text_or_empty

FIT_ROWS = 4000
PREFIXES = range(3, 9)
#: An entry must be in toxic texts so often that chance would do it this rarely.
UNLIKELY = 2e-3

# Letters of other scripts, and digits and signs, that look like Latin letters.
LOOKALIKES = dict(
    zip(
        "авекмнорстухіјѕԁԛԝһӏαβεικνορτυχγηω0134578@$",
        "abekmhopctyxijsdqwhlaeeikvoptuxynwoieastbas",
        strict=True,
    )
)


class _Fold(dict):
    """Translation table made as letters turn up."""

    def __missing__(self, code: int) -> str:
        c = unicodedata.normalize("NFKD", chr(code)).lower()
        out = "".join(LOOKALIKES.get(x, x) for x in c if not unicodedata.combining(x))
        self[code] = kept = "".join(x if x.isalpha() else " " for x in out)
        return kept


_FOLD = _Fold()


def fold(text: str) -> str:
    """Folded words with one space before and after each; runs of other characters become one space."""
    return f" {' '.join(text.lower().translate(_FOLD).split())} "


@dataclass
class Lexicon:
    """Entries map a folded pattern to its weight: ``" word "`` is a word, ``" begin"`` a beginning. Exceptions are phrases ``" a b "``."""

    entries: dict[str, float] = field(default_factory=dict)
    exceptions: list[str] = field(default_factory=list)
    intercept: float = -4.0
    slopes: tuple[float, float] = (1.0, 0.5)

    def matcher(self):
        import ahocorasick

        machine = ahocorasick.Automaton()
        for k, w in self.entries.items():
            machine.add_word(k, (len(k), w))
        for k in self.exceptions:
            machine.add_word(k, (len(k), None))
        if len(machine):
            machine.make_automaton()
        return machine

    def weigh(self, machine, text: str) -> tuple[float, int]:
        """Summed weights of the different words that match, and the number of words."""
        folded = fold(text)
        words: dict[int, float] = {}
        spared: list[tuple[int, int]] = []
        if len(machine):
            for end, (size, weight) in machine.iter(folded):
                at = end - size + 1
                if weight is None:
                    spared.append((at, end))
                elif weight > words.get(at, 0.0):
                    words[at] = weight
        if spared and words:
            spared.sort()
            starts, reach = [a for a, _ in spared], list(accumulate((b for _, b in spared), max))
            words = {at: w for at, w in words.items() if not ((k := bisect_right(starts, at)) and reach[k - 1] > at)}
        kinds: dict[str, float] = {}
        for at, w in words.items():
            kinds[folded[at : folded.index(" ", at + 1)]] = w
        return sum(kinds.values()), folded.count(" ") - 1

    def features(self, total: float, n: int) -> tuple[float, float]:
        return math.log1p(total), math.log1p(1000 * total / (n + 20))

    def score(self, total: float, n: int) -> float:
        a, b = self.features(total, n)
        z = self.intercept + self.slopes[0] * a + self.slopes[1] * b
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def held_out(id_col: str = "doc_id"):
    """Whether a row is in the held-out fold: crc32 of the id as text, modulo 5, is 0 (a null id counts as empty text)."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 5 == 0


def _grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each word and beginning of a word, in how many toxic and clean texts it is; summed within the task first."""
    counts: tuple[Counter, Counter] = (Counter(), Counter())

    def summed() -> pa.RecordBatch:
        keys = list(counts[0].keys() | counts[1].keys())
        out = pa.RecordBatch.from_pydict({"gram": keys, "clean": [counts[0][k] for k in keys], "toxic": [counts[1][k] for k in keys]}, pa.schema([("gram", pa.string()), ("clean", pa.int64()), ("toxic", pa.int64())]))
        counts[0].clear(), counts[1].clear()
        return out

    for batch in batches:
        for text, y in zip(batch.column("text").to_pylist(), batch.column("y").to_pylist(), strict=True):
            words = set(fold(text).split())
            counts[y].update({f" {w} " for w in words} | {f" {w[:k]}" for w in words for k in PREFIXES if len(w) >= k})
        if len(counts[0]) + len(counts[1]) > 200_000:
            yield summed()
    yield summed()


def _contexts(grams: list[str]):
    """For each place of an entry, the words before and after it, as a hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = set(grams)
        for batch in batches:
            seen: set[tuple[str, int]] = set()
            for text in batch.column("text").to_pylist():
                words = fold(text).split()
                for before, w, after in zip(["", *words], words, [*words[1:], ""], strict=False):
                    context = zlib.crc32(f"{before} {after}".encode())
                    seen.update((g, context) for g in (f" {w} ", *[f" {w[:k]}" for k in PREFIXES if len(w) >= k]) if g in wanted)
            yield pa.RecordBatch.from_pydict({"gram": [g for g, _ in seen], "context": [c for _, c in seen]}, pa.schema([("gram", pa.string()), ("context", pa.int64())]))

    return run


def _phrases(entries: set[str]):
    """For each word with an entry, the two words that it makes with the word before and the word after it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: set[tuple[str, str, int, int]] = set()
            for text, y in zip(batch.column("text").to_pylist(), batch.column("y").to_pylist(), strict=True):
                folded = fold(text)
                words, mark = folded.split(), zlib.crc32(folded.encode())
                for k, w in enumerate(words):
                    for g in {f" {w} ", *[f" {w[:n]}" for n in PREFIXES if len(w) >= n]} & entries:
                        rows.update((f" {a} {b} ", g, y, mark) for a, b in zip(words[max(0, k - 1) : k + 1], words[max(0, k - 1) + 1 : k + 2], strict=False))
            phrase, gram, ys, marks = zip(*rows, strict=True) if rows else ((),) * 4
            yield pa.RecordBatch.from_arrays([pa.array(phrase, pa.string()), pa.array(gram, pa.string()), pa.array(ys, pa.int32()), pa.array(marks, pa.int64())], ["phrase", "gram", "y", "text"])

    return run


def _unlikely(n: int, k: int, rate: float) -> float:
    """Chance that k or more of n texts are toxic when each is with this rate."""
    up = k > n * rate
    i, odds = k if up else k - 1, rate / (1 - rate)
    if i < 0:
        return 1.0
    # From the mean outwards terms only fall, so one that underflows has nothing behind it; below the mean the other tail is summed.
    term, total = math.exp(math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(rate) + (n - i) * math.log1p(-rate)), 0.0
    while 0 <= i <= n and term > total * 1e-17:
        total += term
        term *= (n - i) / (i + 1) * odds if up else i / (n - i + 1) / odds
        i += 1 if up else -1
    return min(1.0, total) if up else max(0.0, 1 - total)


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", rows: int = FIT_ROWS, seed_entries: dict[str, float] | None = None) -> Lexicon:
    """Learn a lexicon from labelled rows outside the held-out fold.

    Rows without an id or a label are left out; an id labelled twice counts as toxic if any label says so. With no row of one class
    nothing is learned and the lexicon has ``seed_entries`` only.
    """
    marked = labels.select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("y")).where(F.col("_id").isNotNull() & F.col("y").isin(0, 1))
    marked = marked.where(~held_out("_id")).groupBy("_id").agg(F.max("y").alias("y"))
    order = F.xxhash64("_id")
    few = marked.where("y = 1").orderBy(order, "_id").limit(rows).unionByName(marked.where("y = 0").orderBy(order, "_id").limit(rows))
    texts = in_batches(docs).select(F.col(id_col).alias("_id"), text_or_empty(text_col).alias("text"))
    sample = cut(texts.join(F.broadcast(few), "_id").select("text", "y"))  # at most 2 * rows ids are sent
    n = {r["y"]: r["n"] for r in sample.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    lexicon = Lexicon(entries=dict(seed_entries or {}))
    if len(n) < 2:
        return lexicon
    rate = n[1] / (n[0] + n[1])
    grams = cut(sample.mapInArrow(_grams, "gram string, clean long, toxic long").groupBy("gram").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic")))
    weight = F.log((F.col("toxic") + 0.5) / (n[1] + 1.0)) - F.log((F.col("clean") + 0.5) / (n[0] + 1.0))
    good = grams.withColumn("w", weight).where("toxic >= 2 and w > 1.5").orderBy(F.col("toxic").desc(), "clean", "gram").collect()
    likely = [r for r in good if _unlikely(r["toxic"] + r["clean"], r["toxic"], rate) < UNLIKELY]
    around = sample.where("y = 1").mapInArrow(_contexts([r["gram"] for r in likely]), "gram string, context long")
    places = {r["gram"]: r["n"] for r in around.groupBy("gram").agg(F.countDistinct("context").alias("n")).collect()}
    for r in likely:
        # A text and its copies are one piece of evidence: what counts is between how many different neighbours an entry stands.
        k = min(r["toxic"], places.get(r["gram"], 0))
        if _unlikely(k + r["clean"], k, rate) < UNLIKELY:
            lexicon.entries[r["gram"]] = round(r["w"], 6)
    begins = [k for k in lexicon.entries if not k.endswith(" ")]
    if begins:
        # Words that begin like an entry but stand in clean texts only.
        clean = grams.where("toxic = 0 and clean >= 2").where(F.col("gram").endswith(" ") & F.substring("gram", 1, PREFIXES[0] + 1).isin(sorted({k[: PREFIXES[0] + 1] for k in begins})))
        lexicon.exceptions = [r["gram"] for r in clean.orderBy(F.col("clean").desc(), "gram").collect() if any(r["gram"].startswith(k) for k in begins)]
    if lexicon.entries:
        # Two words, one of them an entry's, that stand in so many different clean texts and no toxic one that chance would hardly do it.
        share = {r["gram"]: (r["toxic"] + 0.5) / (r["toxic"] + r["clean"] + 1) for r in likely if r["gram"] in lexicon.entries}
        pairs = sample.mapInArrow(_phrases(set(share)), "phrase string, gram string, y int, text long").groupBy("phrase", "gram").agg(F.max("y").alias("toxic"), F.countDistinct("text").alias("n"))
        found: dict[str, bool] = {}
        for r in pairs.where("n > 1 or toxic = 1").collect():
            found[r["phrase"]] = found.get(r["phrase"], True) and not r["toxic"] and (1 - share[r["gram"]]) ** r["n"] < UNLIKELY
        lexicon.exceptions += sorted(k for k, good in found.items() if good)
    seen = sample.mapInArrow(_weigher(lexicon, ("y",)), "y int, total double, n long").collect()
    x = np.array([[1.0, *lexicon.features(r["total"], r["n"])] for r in seen])
    y = np.array([r["y"] for r in seen], dtype=float)
    w = np.zeros(3)
    for _ in range(50):  # Newton steps with a ridge, so separable classes give finite weights
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x.T * (p * (1 - p))) @ x + 0.05 * np.eye(3), x.T @ (y - p) - 0.05 * w)
        w = w + step
        if np.abs(step).max() < 1e-8:
            break
    lexicon.intercept, lexicon.slopes = float(w[0]), (float(w[1]), float(w[2]))
    return lexicon


def _weigher(lexicon: Lexicon, keep: tuple[str, ...]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = lexicon.matcher()
        for batch in batches:
            found = [lexicon.weigh(machine, x) for x in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*[batch.column(k) for k in keep], pa.array([x for x, _ in found], pa.float64()), pa.array([n for _, n in found], pa.int64())], [*keep, "total", "n"])

    return run


def _scores(lexicon: Lexicon, machine, texts: pa.Array) -> np.ndarray:
    return np.array([lexicon.score(*lexicon.weigh(machine, x or "")) for x in texts.cast(pa.string()).to_pylist()], dtype=float)


def score(docs: DataFrame, lexicon: Lexicon, text_col: str = "text") -> DataFrame:
    """Add ``tox_score`` (0 to 1) to every row of ``docs``; all its columns stay, but for one of that name, which it replaces.

    Null and empty texts have no match and score low. Rows pass through one by one, with no shuffle, so copies, ties and hot sources don't matter.
    """
    rest = docs.drop("tox_score")
    names = rest.columns
    schema = StructType([*rest.schema.fields, StructField("tox_score", DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = lexicon.matcher()
        for batch in batches:
            scores = _scores(lexicon, machine, batch.column(names.index(text_col)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores, pa.float64())], [*names, "tox_score"])

    return in_batches(rest).mapInArrow(run, schema)


def reject_toxic(docs: DataFrame, lexicon: Lexicon, threshold: float = 0.5, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that score under ``threshold``, with the columns of ``docs`` as they are."""
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = lexicon.matcher()
        for batch in batches:
            yield batch.filter(pa.array(_scores(lexicon, machine, batch.column(at)) < threshold))

    return in_batches(docs).mapInArrow(run, docs.schema)
