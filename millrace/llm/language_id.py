"""Language identification as inference of a mixture of languages.

Training counts letter trigrams (bytes of lower-cased text, hashed to GRAMS slots, spaces between
words) for each language over all labelled rows. For a document every word gets a log likelihood
under each language from its trigrams; expectation-maximisation then estimates the languages' shares
of the words. Nested language sets (the best one, the best two, and so on) are refitted until a further
language, less its penalty, no longer raises the likelihood. The prediction is the set's largest share.

The model holds GRAMS log probabilities for each language, and half, a quarter and so on of the slots
where there are so many languages that it would pass MODEL entries; so its broadcast is bounded.

Defined results: a null text, or one without a letter, is ``und`` with score 0; with nothing to learn
from, every prediction is ``und``; ties go to the language first in alphabetical order; a null doc_id
is not held out; rows that repeat a doc_id are predicted each; other columns pass, and columns
named like added ones are replaced; an empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.llm.common import drop_stored, lean, ship, small_batches, stored

#: Slots of a language's trigrams, and entries of the model for all languages (4 bytes each).
GRAMS, MODEL = 1 << 16, 1 << 25
SMOOTHING = 0.1
#: Rounds of a fit; what a further language must add to the log likelihood, beside half the logarithm of the words.
ROUNDS, PENALTY = 10, 6.0
NONE = "und"
ADDED = ("lang_pred", "score", "lang_set")

_FOLD = np.where([chr(b).isalpha() or b >= 0x80 for b in range(256)], np.arange(256), 0x20).astype("u1")


@dataclass
class Model:
    languages: list[str]
    table: np.ndarray  # slots x languages: log probabilities


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def _letters(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Trigram slot of every letter byte of all texts, the first slot of each word, and each word's text."""
    raw = [x.lower().encode() for x in texts]
    ends = np.cumsum([len(x) + 1 for x in raw])
    b = _FOLD[np.frombuffer(b" " + b" ".join(raw) + b" ", dtype="u1")].astype("u4")
    inside = b[1:-1] != 0x20
    at = np.flatnonzero(inside)
    key = b[at] | b[at + 1] << 8 | b[at + 2] << 16
    slots = ((key * np.uint32(2654435761)) >> np.uint32(16)).astype("i8")
    fresh = b[at] == 0x20
    starts = np.flatnonzero(fresh)
    return slots, starts, np.searchsorted(ends, at[starts], side="right")


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[str, np.ndarray] = {}
    for batch in small_batches(batches, "text", 1 << 20):
        langs = batch.column("lang").to_pylist()
        names = sorted(set(langs))
        code = {x: i for i, x in enumerate(names)}
        own = np.array([code[x] for x in langs])
        slots, starts, texts = _letters(batch.column("text").to_pylist())
        if not len(slots):
            continue
        word = np.zeros(len(slots), "i8")
        word[starts] = 1
        sums = np.bincount(own[texts[np.cumsum(word) - 1]] * GRAMS + slots, minlength=len(names) * GRAMS).reshape(len(names), GRAMS)
        for name, row in zip(names, sums):
            total[name] = total[name] + row if name in total else row
    for name, row in total.items():
        found = np.flatnonzero(row)
        yield pa.RecordBatch.from_arrays([pa.array([name] * len(found), pa.string()), pa.array(found.astype("i4")), pa.array(row[found])], names=["lang", "gram", "n"])


def train(labelled: DataFrame) -> Model:
    """Learns from text and non-null lang of all given rows; only summed counts reach the driver."""
    ship(labelled.sparkSession)
    rows = labelled.select("text", "lang").where("text IS NOT NULL AND lang IS NOT NULL").mapInArrow(lean(_counts), "lang string, gram int, n long")
    sums = stored(rows.groupBy("lang", "gram").agg(F.sum("n").alias("n")), "grams")
    slots, n = GRAMS, sums.select("lang").distinct().count()
    while slots > 1 and slots * n > MODEL:
        slots //= 2
    folded = sums.groupBy("lang", F.shiftright("gram", (GRAMS // slots).bit_length() - 1).alias("gram")).agg(F.sum("n").alias("n")) if slots < GRAMS else sums
    sums_here = folded.toArrow()  # MODEL rows at most
    drop_stored(sums)
    sums = sums_here
    languages = sorted(set(sums.column("lang").to_pylist()))
    counts = np.zeros((slots, len(languages)))
    code = {x: i for i, x in enumerate(languages)}
    counts[sums.column("gram").to_numpy(), [code[x] for x in sums.column("lang").to_pylist()]] = sums.column("n").to_numpy()
    kinds = max(1, int((counts.sum(1) > 0).sum()))
    table = np.log((counts + SMOOTHING) / (counts.sum(0) + SMOOTHING * kinds)) if languages else counts
    return Model(languages, table.astype("f4"))


def _fit(likely: np.ndarray, most: np.ndarray, first: np.ndarray, of: np.ndarray, n: np.ndarray, share: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """EM from the given shares (documents x languages): shares, and log likelihood of each document."""
    for _ in range(ROUNDS):
        part = likely * share[of]
        share = np.add.reduceat(part / np.maximum(part.sum(1, keepdims=True), 1e-300), first, axis=0) / n[:, None]
    total = np.log(np.maximum((likely * share[of]).sum(1), 1e-300)) + most
    return share, np.add.reduceat(total, first)


def infer(model: Model, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For the texts that have a word: their index, language code, score, and shares."""
    slots, starts, of = _letters(texts)
    if not len(slots) or not model.languages:
        return np.zeros(0, "i8"), np.zeros(0, "i8"), np.zeros(0), np.zeros((0, len(model.languages)))
    slots >>= (GRAMS // len(model.table)).bit_length() - 1
    word = np.add.reduceat(model.table[slots], starts, axis=0, dtype="f8")
    docs, first, of, n = np.unique(of, return_index=True, return_inverse=True, return_counts=True)
    most = word.max(1)
    likely = np.exp(np.maximum(word - most[:, None], -60))
    k = len(model.languages)
    single = np.add.reduceat(word, first, axis=0)
    best = single.argmax(1)
    alone = np.exp(single - single.max(1, keepdims=True))
    sure = alone.max(1) / alone.sum(1)
    rows = np.arange(len(docs))
    shares = np.zeros((len(docs), k))
    shares[rows, best] = 1
    value = single.max(1)
    if k > 1:
        full, _ = _fit(likely, most, first, of, n, np.full((len(docs), k), 1 / k))
        order = np.argsort(-full, axis=1, kind="stable")
        rising = rows  # texts whose set may still grow
        for size in range(2, k + 1):
            own = np.zeros(len(docs), bool)
            own[rising] = True
            use = own[of]
            renamed = np.cumsum(own) - 1
            of_own, n_own = renamed[of[use]], n[rising]
            among = np.zeros((len(rising), k))
            np.put_along_axis(among, order[rising, :size], 1, axis=1)
            among *= full[rising] + 1e-12
            share, total = _fit(likely[use], most[use], np.cumsum(n_own) - n_own, of_own, n_own, among / among.sum(1, keepdims=True))
            total = total - (size - 1) * (PENALTY + 0.5 * np.log(n_own))
            wins = total > value[rising]
            rising, share, total = rising[wins], share[wins], total[wins]
            if not len(rising):
                break
            shares[rising], value[rising] = share, total
    code = shares.argmax(1)
    top = shares[rows, code]
    return docs, code, np.clip(np.where(top >= 1, sure, top), 0, 1), shares


def _predict(model, keep: list[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: Model = model.value
        for batch in small_batches(batches, "text", max(1 << 14, (2 << 20) // max(1, len(own.languages)))):
            texts = [x or "" for x in batch.column("text").to_pylist()]
            pred, score, chosen = [NONE] * len(texts), [0.0] * len(texts), [[]] * len(texts)
            for i, c, s, shares in zip(*infer(own, texts)):
                x = texts[i]
                if x.isascii() or any(map(str.isalpha, x)):
                    pred[i], score[i] = own.languages[c], float(s)
                    chosen[i] = [own.languages[j] for j in np.argsort(-shares, kind="stable") if shares[j] > 0.01]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(x) for x in keep), pa.array(pred, pa.string()), pa.array(score, pa.float64()), pa.array(chosen, pa.list_(pa.string()))], names=[*keep, *ADDED]
            )

    return lean(run)


def identified(docs: DataFrame, model: Model) -> DataFrame:
    """All columns with lang_pred, score and lang_set (largest share first). No exchange."""
    ship(docs.sparkSession)
    docs = docs.drop(*ADDED)
    schema = T.StructType([*docs.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("lang_set", T.ArrayType(T.StringType()))])
    return docs.mapInArrow(_predict(docs.sparkSession.sparkContext.broadcast(model), docs.columns), schema)


def accepted(docs: DataFrame, model: Model, least_share: float = 0.3) -> DataFrame:
    """The documents of a known language that has at least the given share."""
    return identified(docs, model).where((F.col("lang_pred") != NONE) & (F.col("score") >= least_share)).drop(*ADDED)
