"""Language identification by mixture inference.

A document is a mixture of languages: each of its words is drawn from one of them, with a likelihood that the word's n-grams give. Expectation
maximisation estimates the document's proportions; languages are then taken out, the least first, as long as the likelihood loses less than
the penalty of a language more. The language with the greatest proportion is the prediction, its proportion the score.

The n-grams of a language are counted on at most ``FIT_ROWS`` labelled rows outside the held-out fold, into a table of ``BUCKETS`` hashed n-grams, so the model's
size follows the number of languages only. Every document is read whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import in_batches, text_or_empty

#: Labelled rows that a language is learned from: those with the smallest hashes of their texts.
FIT_ROWS = 2000
#: Languages that are learned: those with the most labelled rows.
MAX_LANGUAGES = 256
BUCKET_BITS = 16
BUCKETS = 1 << BUCKET_BITS
#: Letters of the longest n-grams.
LONGEST = 4
_BASE, _SPREAD = np.uint64(0x5851F42D4C957F2D), np.uint64(0x9E3779B97F4A7C15)
#: What every bucket counts before the first n-gram is seen.
PRIOR = 0.5
#: Rounds of expectation maximisation, for all languages and after one is taken out.
ROUNDS, MORE_ROUNDS = 12, 4
#: The likelihood that a word comes from no language in particular, next to that of its best one.
NOISE = 1e-3
UNDETERMINED = "und"
#: Code points whose words are scored at once.
_PIECE = 1 << 18


@lru_cache(1)
def _letters() -> np.ndarray:
    """For each code point whether it is a letter."""
    return np.array([chr(c).isalpha() for c in range(0x110000)])


def _words(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Small letters of texts, with a zero for each run of anything else, before, between and after words; the words' starts, and the number of each one's text."""
    small = [t.lower() for t in texts]
    codes = np.frombuffer("\n".join(small).encode("utf-32-le", "surrogatepass"), np.uint32)
    kept = np.zeros(len(codes) + 2, np.uint32)
    kept[1:-1] = np.where(_letters()[np.minimum(codes, 0x10FFFF)], codes, 0)
    stays = np.ones(len(kept), bool)
    stays[1:] = (kept[1:] != 0) | (kept[:-1] != 0)
    places = np.flatnonzero(stays) - 1
    kept = kept[stays]
    starts = np.flatnonzero((kept[:-1] == 0) & (kept[1:] != 0)) + 1
    begins = np.cumsum([0, *[len(t) + 1 for t in small[:-1]]])
    return kept, starts, np.searchsorted(begins, places[starts], "right") - 1


def _grams(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all n-grams within the words of ``codes`` (a word's edges count as letters), and the places where they begin."""
    buckets, places = [], []
    solid = codes != 0
    hashes, inner = codes.astype(np.uint64) + np.uint64(1), solid
    for n in range(1, min(LONGEST, len(codes)) + 1):
        m = len(codes) - n + 1
        if n > 1:  # one letter more on the right; what was the right end has to be a letter now
            hashes = hashes[:m] * _BASE + codes[n - 1 :]
            inner = np.ones(m, bool) if n == 2 else inner[:m] & solid[n - 2 : n - 2 + m]
        at = np.flatnonzero(inner)
        buckets.append(((hashes[at] * _SPREAD) >> np.uint64(64 - BUCKET_BITS)).astype(np.int64))
        places.append(at)
    return (np.concatenate(buckets), np.concatenate(places)) if buckets else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def _pieces(text: str, most: int = _PIECE) -> Iterator[str]:
    """Slices of a text that end outside of words, where one has an end within twice the size."""
    at = 0
    while at < len(text):
        end = min(len(text), at + most)
        while end < min(len(text), at + 2 * most) and text[end].isalpha():
            end += 1
        yield text[at:end]
        at = end


def _grouped(texts: list[str]) -> Iterator[tuple[list[int], list[str]]]:
    """Pieces of texts with their texts' numbers, together of about ``_PIECE`` code points."""
    rows, parts, size = [], [], 0
    for row, text in enumerate(texts):
        for piece in _pieces(text):
            rows.append(row)
            parts.append(piece)
            size += len(piece)
            if size >= _PIECE:
                yield rows, parts
                rows, parts, size = [], [], 0
    if rows:
        yield rows, parts


@dataclass(frozen=True)
class Model:
    """``logs``: for each language the logarithm of each bucket's share."""

    languages: tuple[str, ...]
    logs: np.ndarray


def held_out(id_column: str = "doc_id") -> Column:
    """Rows of this fold are never learned from. A row without an id belongs to it."""
    return F.coalesce(F.crc32(F.col(id_column).cast("string").cast("binary")) % 3 == 1, F.lit(True))


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: dict[str, np.ndarray] = {}
    for batch in batches:
        langs, texts = np.array(batch.column("lang").to_pylist(), object), batch.column("text").to_pylist()
        for lang in dict.fromkeys(langs):
            have = counts.setdefault(lang, np.zeros(BUCKETS, np.int64))
            for _, parts in _grouped([texts[k] for k in np.flatnonzero(langs == lang)]):
                have += np.bincount(_grams(_words(parts)[0])[0], minlength=BUCKETS)
    for lang, have in counts.items():
        at = np.flatnonzero(have)
        yield pa.RecordBatch.from_pydict({"lang": pa.array([lang] * len(at), pa.string()), "bucket": pa.array(at, pa.int32()), "n": pa.array(have[at], pa.int64())})


def fit(docs: DataFrame, fit_rows: int = FIT_ROWS, max_languages: int = MAX_LANGUAGES, id_column: str = "doc_id") -> Model:
    """Learn the languages of ``docs`` from the texts and ``lang`` of labelled rows outside the held-out fold.

    Null languages, null texts and texts without letters teach nothing; texts that repeat teach once. Without any labelled row there is no language, and every document
    is undetermined.
    """
    labelled = docs.where(~held_out(id_column) & F.col("lang").isNotNull() & F.col("text").isNotNull()).select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    known = labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), "lang").limit(max_languages).collect()
    names = tuple(sorted(r["lang"] for r in known))
    # Hashes are ranked without the texts; a text comes in if its hash is among its language's smallest.
    hashed = labelled.withColumn("h", F.xxhash64("text")).where(F.col("lang").isin(list(names)))
    ranked = hashed.select("lang", "h").distinct().withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy("h"))).where(F.col("r") <= fit_rows)
    bounds = {r["lang"]: r["most"] for r in ranked.groupBy("lang").agg(F.max("h").alias("most")).collect()}
    most = F.create_map(*[F.lit(x) for kv in bounds.items() for x in kv]) if bounds else F.create_map().cast("map<string,bigint>")
    taken = hashed.where(F.col("h") <= F.try_element_at(most, F.col("lang"))).dropDuplicates(["lang", "h"]).select("lang", "text")
    counts = in_batches(taken).mapInArrow(_counted, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    table = np.full((len(names), BUCKETS), PRIOR)
    at = {n: k for k, n in enumerate(names)}
    table[[at[x] for x in counts["lang"]], counts["bucket"].to_numpy()] += counts["n"].to_numpy()
    return Model(names, np.log(table / table.sum(axis=1, keepdims=True)).astype(np.float32))


def word_likelihoods(texts: list[str], logs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each word the likelihood in each language, relative to its best one (languages by words), and the number of its text."""
    codes, starts, text = _words(texts)
    if not len(starts):
        return np.zeros((len(logs), 0), np.float32), text
    buckets, places = _grams(codes)
    begun = np.zeros(len(codes) + 1, np.int64)
    begun[starts] = 1
    word = (np.cumsum(begun) - 1)[places + (codes[places] == 0)]  # at a word's left edge an n-gram begins one before it
    scores = np.stack([np.bincount(word, log[buckets], len(starts)) for log in logs])
    return np.exp(np.maximum(scores - scores.max(axis=0), -60)).astype(np.float32), text


def _distinct(likelihoods: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Different columns and their weights, so that a very long text takes the room of its different words."""
    rows = np.ascontiguousarray(likelihoods.T)
    _, at, back = np.unique(rows.view(np.dtype((np.void, rows.itemsize * rows.shape[1]))).ravel(), return_index=True, return_inverse=True)
    return likelihoods[:, at], np.bincount(back, weight, len(at)).astype(np.float32)


class _Mixtures:
    """Mixture inference for several documents at once; ``bounds`` are where each one's words begin in ``p`` (languages by words)."""

    def __init__(self, p: np.ndarray, weight: np.ndarray, bounds: np.ndarray) -> None:
        self.p, self.weight, self.bounds = p, weight, bounds
        self.doc = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))

    def part(self, docs: np.ndarray) -> _Mixtures:
        keep = np.isin(self.doc, docs)
        return _Mixtures(self.p[:, keep], self.weight[keep], np.concatenate([[0], np.cumsum(np.diff(self.bounds)[docs])]))

    def sums(self, values: np.ndarray) -> np.ndarray:
        """Each document's sum over its words."""
        return np.add.reduceat(values, self.bounds[:-1], axis=-1)

    def _mixed(self, shares: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
        parts = [p * share[self.doc] for p, share in zip(self.p, shares.astype(np.float32), strict=True)]
        total = np.full(len(self.doc), NOISE, np.float32)
        for part in parts:
            total += part
        return parts, total

    def climb(self, shares: np.ndarray, rounds: int) -> tuple[np.ndarray, np.ndarray]:
        """Shares of the languages (languages by documents) after some rounds, and the log likelihoods. A language without a share stays without."""
        for _ in range(rounds):
            parts, total = self._mixed(shares)
            each = self.weight / total
            shares = np.stack([self.sums(part * each) for part in parts]).astype(np.float64)
            shares /= np.maximum(shares.sum(axis=0), 1e-30)
        return shares, self.sums(self.weight * np.log(self._mixed(shares)[1], dtype=np.float64))


def mixture(p: np.ndarray, weight: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """The proportions of languages (languages by documents), each document having a word at least, with as few languages as the penalised likelihood asks for.

    A language more costs half the logarithm of the number of words and half a nat; it is taken out when that is more than what the likelihood loses.
    """
    everything = _Mixtures(p, weight, bounds)
    n, k = len(bounds) - 1, len(p)
    shares, fits = everything.climb(np.full((k, n), 1.0 / k), ROUNDS)
    penalty = 0.5 * np.log(np.maximum(everything.sums(weight), 1)) + 0.5
    left = np.arange(n)
    for _ in range(k - 1):
        left = left[(shares[:, left] > 0).sum(axis=0) > 1]
        if not len(left):
            break
        tried = shares[:, left]
        tried[np.where(tried > 0, tried, np.inf).argmin(axis=0), np.arange(len(left))] = 0
        tried /= np.maximum(tried.sum(axis=0), 1e-30)
        new, fit_of = (everything if len(left) == n else everything.part(left)).climb(tried, MORE_ROUNDS)
        better = fit_of + penalty[left] >= fits[left]
        left, new, fit_of = left[better], new[:, better], fit_of[better]
        shares[:, left], fits[left] = new, fit_of
    return shares


#: Words of documents that are worked on together.
_TOGETHER = 200_000


def shares_of(texts: list[str], model: Model) -> tuple[np.ndarray, np.ndarray]:
    """The proportions of languages in each text that has a word (languages by texts), and which texts these are."""
    rows, shares = [], []
    p, weight, text = np.zeros((len(model.languages), 0), np.float32), np.zeros(0, np.float32), np.zeros(0, np.int64)

    def settle(upto: int) -> None:
        """Infer the texts before ``upto``, of which nothing is to come."""
        nonlocal p, weight, text
        n = int(np.searchsorted(text, upto))
        if n:
            found, begins = np.unique(text[:n], return_index=True)
            rows.append(found)
            shares.append(mixture(p[:, :n], weight[:n], np.append(begins, n)))
            p, weight, text = p[:, n:], weight[n:], text[n:]

    for at, parts in _grouped(texts):
        new, part = word_likelihoods(parts, model.logs)
        p, weight, text = np.concatenate([p, new], axis=1), np.concatenate([weight, np.ones(len(part), np.float32)]), np.concatenate([text, np.array(at)[part]])
        if len(text) >= _TOGETHER:
            settle(at[-1])
        if len(text) >= 2 * _TOGETHER:  # one very long text
            p, weight = _distinct(p, weight)
            text = np.full(len(weight), at[-1])
    settle(len(texts))
    return (np.concatenate(shares, axis=1), np.concatenate(rows)) if rows else (np.zeros((len(model.languages), 0)), np.zeros(0, np.int64))


def _predict(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, scores = np.full(batch.num_rows, UNDETERMINED, object), np.zeros(batch.num_rows)
            if model.languages:
                shares, rows = shares_of(batch.column("text").to_pylist(), model)
                langs[rows], scores[rows] = np.array(model.languages, object)[shares.argmax(axis=0)], np.clip(shares.max(axis=0), 0, 1)
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("held_out"), pa.array(langs, pa.string()), pa.array(scores)], names=["id", "held_out", "lang_pred", "score"])

    return run


def predict(docs: DataFrame, model: Model, id_column: str = "doc_id") -> DataFrame:
    """The id, held_out, lang_pred and score (the predicted language's proportion) of each row.

    A null or empty text, one without a letter, or any text when no language was learned is ``und`` with score 0. Every row counts for itself, rows that repeat as well; a word of more than
    half a million letters is cut. Other columns aren't read. An empty table gives no rows.
    """
    id_type = docs.schema[id_column].dataType.simpleString()
    rows = docs.select(F.col(id_column).alias("id"), held_out(id_column).alias("held_out"), text_or_empty("text").alias("text"))
    out = in_batches(rows).mapInArrow(_predict(model), f"id {id_type}, held_out boolean, lang_pred string, score double")
    return out.withColumnRenamed("id", id_column)
