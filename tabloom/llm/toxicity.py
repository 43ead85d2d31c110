"""Toxicity by non-negative positive-unlabelled learning.

Confirmed toxic documents are the positives; everything else is unlabelled, toxic documents included.  With the share ``prior`` of
toxic documents, the risk on negatives is that on unlabelled text minus ``prior`` times that of positives counted as negatives;
where a batch makes this difference negative, which no true risk is, the step undoes the overfitting instead.

Texts are seen as the set of their words and of the beginnings of these, hashed; words are runs of letters and digits after A-Z
are lower-cased, and beginnings let inflected and compound forms of a word count together.  The model is linear in those that are
more frequent among positives than chance explains.  A whole word among them decides alone where most of the unlabelled documents that hold
it are toxic by the same prior: ``prior`` times its share of positives, over its share of unlabelled documents.  The model is fitted in numpy on bounded samples (``MOST_TOXIC`` and ``MOST_UNLABELLED`` documents with the smallest hashes of their
ids) and scores every document in one pass without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabloom.llm.common import ODD, SEPARATOR, cut, lowered_hash, mixed, pieces, quoted, text_column, utf8, word_ranges

MOST_TOXIC, MOST_UNLABELLED = 4_000, 8_000
BITS = 22
WHOLE = 1 << (BITS - 1)  # set in features that are whole words
BEGINNINGS = (4, 5, 6, 7, 8)  # bytes
DECISIVE, SUREST = 0.5, 0.99  # share of toxic documents among those with a word that decides alone, and the most that is taken for it
WITNESSES, DECISIVE_GROUPS = 8, 0.3  # groups of like toxic documents that such a word needs, and the share that is toxic among groups
LEAST_DOCUMENTS, LEAST_LIFT, LEAST_Z = 5, 4.0, 6.0  # of features: toxic documents, ratio of shares, standard deviations
STEPS, BATCH, RATE, DECAY = 1500, 1024, 0.05, 1e-5
SETTINGS_SEED = 11

_WORD_BORDER = SEPARATOR.copy()
_WORD_BORDER[[b for b in range(0x21, 0x80) if not chr(b).isalnum()]] = True


@dataclass(frozen=True)
class Model:
    weight: np.ndarray
    bias: float
    decisive: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))  # whole words, ascending
    sure: np.ndarray = field(default_factory=lambda: np.zeros(0))  # log odds of a text with each

    def __reduce__(self):
        own = np.flatnonzero(self.weight)
        return _unpacked, (len(self.weight), own, self.weight[own], self.bias, self.decisive, self.sure)

    def scores(self, column: pa.Array) -> np.ndarray:
        out = np.full(len(column), self.bias)
        known = self.weight != 0
        known[self.decisive] = True
        for first, last, document, word in word_sets(column, known):
            out[first:last] += np.bincount(document, self.weight[word], last - first)
            if len(self.decisive):
                place = np.minimum(np.searchsorted(self.decisive, word), len(self.decisive) - 1)
                hit = self.decisive[place] == word
                np.maximum.at(out, first + document[hit], self.sure[place[hit]])
        return 1 / (1 + np.exp(-np.clip(out, -30, 30)))


def _unpacked(n_words: int, own: np.ndarray, weight: np.ndarray, bias: float, decisive: np.ndarray, sure: np.ndarray) -> Model:
    whole = np.zeros(n_words)
    whole[own] = weight
    return Model(whole, bias, decisive, sure)


def word_sets(column: pa.Array, known: np.ndarray | None = None) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Distinct (document, word) pairs, piece by piece: (first text, last text, document in the piece, word)."""
    data, at = utf8(column)
    for first, last in pieces(at):
        own = at[first:last + 1]
        own_data = data[own[0]:own[-1]]
        begin, end, counts = word_ranges(own_data, own - own[0], _WORD_BORDER)
        hashes = lowered_hash(own_data)
        of_word = np.repeat(np.arange(last - first), counts)
        words, documents = [hashes.of(begin, end)], [of_word]
        for size in BEGINNINGS:
            longer = end - begin > size
            words.append(hashes.of(begin[longer], begin[longer] + size) ^ ODD[size])
            documents.append(of_word[longer])
        word = (np.concatenate(words) >> np.uint64(65 - BITS)).astype(np.int64)
        word[:len(begin)] |= WHOLE
        document = np.concatenate(documents)
        if known is not None:
            hit = known[word]
            word, document = word[hit], document[hit]
        pair = np.unique((document << BITS) | word)
        yield first, last, pair >> BITS, pair & ((1 << BITS) - 1)


@dataclass(frozen=True)
class Side:
    """Documents of one kind: the telling features of each, flat and with borders, and the group of like documents of each."""

    words: np.ndarray
    at: np.ndarray
    group: np.ndarray
    groups: int

    def held(self, n_words: int) -> tuple[np.ndarray, np.ndarray]:
        """How many documents, and how many groups of like documents, hold each feature."""
        of = np.repeat(self.group, np.diff(self.at))
        pairs = np.unique(self.words * self.groups + of)
        return np.bincount(self.words, minlength=n_words), np.bincount(pairs // max(self.groups, 1), minlength=n_words)


def sample(docs: DataFrame, labels: DataFrame, doc_id: str, text: str) -> tuple[np.ndarray, Side, Side, float]:
    """Telling features, those of toxic and of unlabelled documents by their numbers, and the share of toxic ones among the labelled.

    Features are counted on the cluster, so that of a document's features only telling ones reach the driver.
    """
    rows = docs.select(docs[quoted(doc_id)].alias("_doc"), text_column(docs, text).alias("_text")).where("_doc IS NOT NULL")
    told = labels.select(F.col("doc_id").alias("_doc"), F.col("toxic")).where("_doc IS NOT NULL AND toxic IS NOT NULL")
    # labels of other documents say nothing about these
    told = cut(told.join(rows.select("_doc"), "_doc", "left_semi"), "labels-of-documents")
    counts = told.agg(F.count(F.lit(1)), F.sum((F.col("toxic") == 1).cast("int"))).first()
    prior = min(max((counts[1] or 0) / max(counts[0], 1), 1e-4), 0.5)
    order = F.xxhash64("_doc", F.lit(SETTINGS_SEED))
    # the ids are chosen first: at most so many, so that only these texts are fetched
    toxic = told.where("toxic = 1").select("_doc").distinct().orderBy(order).limit(MOST_TOXIC)
    unlabelled = rows.select("_doc").distinct().orderBy(order).limit(MOST_UNLABELLED)
    sides = [cut(rows.join(F.broadcast(chosen), "_doc", "left_semi").mapInArrow(_words, "words array<int>, least long"), "word-sets")
             for chosen in (toxic, unlabelled)]
    n_p, n_u = (side.count() for side in sides)
    p, u = (side.select(F.explode("words").alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias(n)) for side, n in zip(sides, "pu", strict=True))
    held = p.where(F.col("p") >= LEAST_DOCUMENTS).join(u, "word", "left").na.fill(0, ["u"]).toArrow()
    word, p, u = (held[c].to_numpy() for c in ("word", "p", "u"))
    names = np.sort(word[_telling(p, u, n_p, n_u, prior)]).astype(np.int64)
    return names, *(_fetched(side, names) for side in sides), prior


def _words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Features of each document and, by which like documents are known, the least of them under one random order."""
    for batch in batches:
        for first, last, document, word in word_sets(batch.column("_text")):
            at = np.searchsorted(document, np.arange(last - first + 1)).astype(np.int32)
            least = np.zeros(last - first, np.uint64)
            some = at[1:] > at[:-1]
            if some.any():
                least[some] = np.minimum.reduceat(mixed(word.astype(np.uint64) + ODD[0]), at[:-1][some])
            yield pa.RecordBatch.from_arrays(
                [pa.ListArray.from_arrays(at, pa.array(word.astype(np.int32))), pa.array(least.view(np.int64))], ["words", "least"])


def _fetched(side: DataFrame, names: np.ndarray) -> Side:
    def telling(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("words")
            word, at = np.asarray(lists.flatten()), np.append(0, np.cumsum(np.asarray(lists.value_lengths())))
            number = np.minimum(np.searchsorted(names, word), max(len(names) - 1, 0))
            own = names[number] == word if len(names) else np.zeros(len(word), bool)
            kept = np.append(0, np.cumsum(own))[at].astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [pa.ListArray.from_arrays(kept, pa.array(number[own].astype(np.int32))), batch.column("least")], ["words", "least"])

    table = side.mapInArrow(telling, "words array<int>, least long").toArrow().combine_chunks()
    lists = table["words"].combine_chunks()
    groups, group = np.unique(table["least"].to_numpy(), return_inverse=True)
    return Side(np.asarray(lists.flatten()).astype(np.int64), np.append(0, np.cumsum(np.asarray(lists.value_lengths()))).astype(np.int64), group, len(groups))


def fit(positive: list[np.ndarray], unlabelled: list[np.ndarray], prior: float) -> Model:
    """Model of features that are at hand, one array of distinct ones for each document."""
    prior = min(max(prior, 1e-4), 0.5)
    p, u = (np.bincount(np.concatenate([np.zeros(0, np.int64), *rows]), minlength=1 << BITS) for rows in (positive, unlabelled))
    names = np.flatnonzero(_telling(p, u, len(positive), len(unlabelled), prior))
    sides = []
    for rows in (positive, unlabelled):
        kept = [np.searchsorted(names, r[np.isin(r, names)]) for r in rows]
        least = [mixed(r.astype(np.uint64) + ODD[0]).min() if len(r) else 0 for r in rows]
        groups, group = np.unique(np.array(least, np.uint64), return_inverse=True)
        sides.append(Side(np.concatenate([np.zeros(0, np.int64), *kept]), np.append(0, np.cumsum([len(k) for k in kept])).astype(np.int64), group, len(groups)))
    return fitted(names, *sides, prior)


def fitted(names: np.ndarray, positive: Side, unlabelled: Side, prior: float) -> Model:
    """Linear model by the non-negative risk estimator; without positives every score is low."""
    n_words = 1 << BITS
    if not len(positive.group) or not len(unlabelled.group):
        return Model(np.zeros(n_words), -5.0)
    sides = [(side.words, side.at) for side in (positive, unlabelled)]
    weight, bias = np.zeros(len(names)), -1.0
    moment, square = np.zeros(len(names) + 1), np.zeros(len(names) + 1)
    rng = np.random.default_rng(SETTINGS_SEED)

    def batch(side, n):
        flat, at = side
        rows = rng.integers(0, len(at) - 1, n)
        size = at[rows + 1] - at[rows]
        place = np.repeat(at[rows] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
        row = np.repeat(np.arange(n), size)
        word = flat[place]
        return row, word, np.bincount(row, weight[word], n) + bias

    for step in range(1, STEPS + 1):
        p_row, p_word, p = batch(sides[0], BATCH // 2)
        u_row, u_word, u = batch(sides[1], BATCH)
        # sigmoid losses: of a positive taken for negative s(g), of a positive taken for positive s(-g)
        s_p, s_u = 1 / (1 + np.exp(-np.clip(p, -30, 30))), 1 / (1 + np.exp(-np.clip(u, -30, 30)))
        log_p, log_u = np.logaddexp(0, p), np.logaddexp(0, u)  # logistic loss of the label "negative"
        negative = log_u.mean() - prior * log_p.mean()
        if negative >= 0:
            d_p = prior * ((s_p - 1) - s_p) / len(p)
            d_u = s_u / len(u)
        else:  # undo: ascend on the negative part only
            d_p = prior * s_p / len(p)
            d_u = -s_u / len(u)
        gradient = np.bincount(p_word, d_p[p_row], len(names)) + np.bincount(u_word, d_u[u_row], len(names)) + DECAY * weight
        gradient = np.append(gradient, d_p.sum() + d_u.sum())
        moment = 0.9 * moment + 0.1 * gradient
        square = 0.999 * square + 0.001 * gradient**2
        move = RATE * (moment / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.999**step)) + 1e-8)
        weight -= move[:-1]
        bias -= move[-1]
    whole = np.zeros(n_words)
    whole[names] = weight
    return Model(whole, float(bias), *_decisive(positive, unlabelled, names, prior))


def _decisive(positive: Side, unlabelled: Side, names: np.ndarray, prior: float) -> tuple[np.ndarray, np.ndarray]:
    """Whole words of which most unlabelled documents must be toxic, and the log odds that each gives.

    Copies and near copies of a document are one witness: a word of one large group of copies would else pass for toxic.  So a
    word needs ``WITNESSES`` groups of positives, and has to be telling among groups, too.
    """
    (p, p_groups), (u, u_groups) = positive.held(len(names)), unlabelled.held(len(names))
    n_p, n_u = len(positive.group), len(unlabelled.group)
    share = np.minimum(prior * (p / n_p) / ((u + 0.5) / (n_u + 1)), SUREST)
    of_groups = prior * (p_groups / positive.groups) / ((u_groups + 0.5) / (unlabelled.groups + 1))
    own = ((names & WHOLE) != 0) & (share >= DECISIVE) & (p_groups >= WITNESSES) & (of_groups >= DECISIVE_GROUPS)
    return names[own], np.log(share[own] / (1 - share[own]))


def _telling(p: np.ndarray, u: np.ndarray, n_p: int, n_u: int, prior: float) -> np.ndarray:
    """Features that more positives hold than their share of unlabelled documents explains."""
    u = (u + 0.5) / (n_u + 1)
    expected = n_p * u
    lift = min(LEAST_LIFT, 0.7 / prior)  # a word of toxic documents alone is 1 / prior times as frequent in them
    return (p >= LEAST_DOCUMENTS) & (p >= lift * expected) & (p - expected >= LEAST_Z * np.sqrt(expected * (1 - u)))


def scored(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, score), one row per row of ``docs``; one pass, no shuffle.

    Null and empty texts get the score of a text without words.  Repeated rows and equal texts get equal scores, null ids are
    scored too, an empty table gives an empty result.  Other columns are not looked at.
    """
    return _scored(docs, model, text).select(F.col(f"_c{docs.columns.index(doc_id)}").alias(doc_id), F.col("_score").alias("score"))


def harmless(docs: DataFrame, model: Model, text: str = "text", limit: float = 0.5) -> DataFrame:
    """The rows of ``docs``, with all their columns, whose score is below the limit."""
    kept = _scored(docs, model, text).where(F.col("_score") < limit)
    return kept.select(*[f"_c{i}" for i in range(len(docs.columns))]).toDF(*docs.columns)


def _scored(docs: DataFrame, model: Model, text: str) -> DataFrame:
    rows = docs.toDF(*[f"_c{i}" for i in range(len(docs.columns))])
    place = docs.columns.index(text)
    names = [*rows.columns, "_score"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(model.scores(batch.column(place)))], names)

    return rows.mapInArrow(run, T.StructType([*rows.schema.fields, T.StructField("_score", T.DoubleType())]))


def trained(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text") -> Model:
    """Model of the toxic ones among the labelled documents.  Without any, every score is low."""
    return fitted(*sample(docs, labels, doc_id, text))
