"""Problem 10: the reading level of each English document.

Sentences of the running prose are the unit.  A word model (words and word
pairs) and a character model (letter groups within words, and the lengths of
the sentence and its words) give every sentence a distribution over levels.
They are fitted to the labelled documents' sentences; as a document's label
says only what most of its prose is, the sentences' own levels are re-estimated
between fits (expectation-maximisation with the label as prior).  Sentence
distributions, weighted by words, are added up, and a calibration fitted to
the labelled documents turns the sums into the document's level.

Documents without text, or with fewer than ``least`` words of English running
prose, have no level.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import prose
from . import words as W
from .linear import MeanModel, softmax
from .sampling import bounded

LEVELS = 5
BITS = 16
LEAST = 40
MOST_LABELS = 600  # bound of the labelled sample that is brought to the driver


class Features:
    """Hashed features of sentences; words' letter groups are kept per distinct word."""

    def __init__(self) -> None:
        self.languages = prose.Languages()
        self.known: dict[int, np.ndarray] = {}

    def letters(self, word: bytes) -> np.ndarray:
        text = f"<{word.decode('utf-8', 'replace').lower()}>"
        groups = {text[i : i + n] for n in (2, 3, 4) for i in range(len(text) - n + 1)}
        hashes, _ = W.words(pa.array(["".join(f"{ord(c):x}x" for c in g) for g in sorted(groups)]))
        return (hashes & np.uint64((1 << BITS) - 1)).astype(np.int32)


class Batch:
    """Sentences of a batch of texts as arrays."""

    def __init__(self, texts: list[str | None], features: Features) -> None:
        own: list[str] = []
        count: list[int] = []
        for text in texts:
            found = prose.sentences(text) if text else []
            own += found
            count.append(len(found))
        self.documents = np.concatenate([[0], np.cumsum(count)]).astype(np.int64)
        data, offsets = W.raw(W.plain(pa.array(own, pa.string())))
        first, last, self.hashes = W.spans(data, offsets)
        self.rows = np.searchsorted(first, offsets)
        self.n = np.diff(self.rows)
        self.size, self.first, self.data = last - first, first, data
        counts = features.languages.counts(self.hashes, self.rows)
        en = features.languages.names.index("en")
        total = np.concatenate([np.zeros((1, counts.shape[1]), np.int64), np.cumsum(counts, axis=0)])
        document = total[self.documents[1:]] - total[self.documents[:-1]]
        mostly = document[:, en] >= document.max(axis=1, initial=0)
        self.owner = np.repeat(np.arange(len(count)), count)
        best = counts.max(axis=1, initial=0)
        self.english = np.where(best == 0, mostly[self.owner], (counts[:, en] == best)) & (self.n > 0)

    def words(self) -> tuple[np.ndarray, np.ndarray]:
        """Word and word pair features: each word, and each word with the one before it in its sentence."""
        pair = self.hashes.copy()
        with np.errstate(over="ignore"):
            pair[1:] = W.mix64(self.hashes[:-1] * np.uint64(3) + self.hashes[1:])
        pair[self.rows[:-1][self.n > 0]] = 77
        both = np.stack([self.hashes, pair], axis=1).reshape(-1)
        return (both & np.uint64((1 << BITS) - 1)).astype(np.int32), self.rows * 2

    def shape(self) -> np.ndarray:
        """Features of the sentence's length and its words' mean length, as classes."""
        total = np.concatenate([[0], np.cumsum(self.size)])
        mean = (total[self.rows[1:]] - total[self.rows[:-1]]) / np.maximum(self.n, 1)
        length = np.minimum(np.log2(np.maximum(self.n, 1)) * 3, 31).astype(np.int64)
        return np.stack([length, 32 + np.minimum(mean * 2, 31).astype(np.int64)], axis=1)


class Model:
    def __init__(self) -> None:
        self.word, self.char, self.shape = MeanModel(1 << BITS, LEVELS), MeanModel(1 << BITS, LEVELS), MeanModel(64, LEVELS)
        self.calibration = np.zeros(LEVELS, np.float32)
        self.cache: dict[int, np.ndarray] = {}

    def letter_features(self, batch: Batch, features: Features) -> tuple[np.ndarray, np.ndarray]:
        """For each distinct word its letter groups, and the index of every word among the distinct ones."""
        distinct, at, inverse = np.unique(batch.hashes, return_index=True, return_inverse=True)
        groups = []
        for h, i in zip(distinct.tolist(), at.tolist()):
            if h not in features.known:
                features.known[h] = features.letters(batch.data[batch.first[i] : batch.first[i] + batch.size[i]].tobytes())
            groups.append(features.known[h])
        if len(features.known) > 200_000:
            features.known.clear()
        return groups, inverse

    def sentence_levels(self, batch: Batch, features: Features) -> np.ndarray:
        """Distribution over levels of each sentence."""
        ids, rows = batch.words()
        out = self.word.logits(ids, rows)
        out += self.shape.logits(batch.shape().reshape(-1), np.arange(len(batch.n) + 1) * 2)
        distinct, at, inverse = np.unique(batch.hashes, return_index=True, return_inverse=True)
        table = np.zeros((len(distinct), LEVELS), np.float32)
        for k, (h, i) in enumerate(zip(distinct.tolist(), at.tolist())):
            own = self.cache.get(h)
            if own is None:
                own = self.cache[h] = self.char.weights[features.letters(batch.data[batch.first[i] : batch.first[i] + batch.size[i]].tobytes())].mean(axis=0)
            table[k] = own
        if len(self.cache) > 500_000:
            self.cache.clear()
        total = np.concatenate([np.zeros((1, LEVELS), np.float64), np.cumsum(table[inverse], axis=0, dtype=np.float64)])
        out += ((total[batch.rows[1:]] - total[batch.rows[:-1]]) / np.maximum(batch.n, 1)[:, None]).astype(np.float32) + self.char.bias
        return softmax(out)

    def documents(self, batch: Batch, levels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Words of English prose of each document, and their distribution over levels."""
        weight = np.where(batch.english, batch.n, 0)
        total = np.concatenate([np.zeros((1, LEVELS)), np.cumsum(levels * weight[:, None], axis=0)])
        words = np.concatenate([[0], np.cumsum(weight)])
        n = words[batch.documents[1:]] - words[batch.documents[:-1]]
        return n, (total[batch.documents[1:]] - total[batch.documents[:-1]]) / np.maximum(n, 1)[:, None]

    def fit(self, texts: list[str], labels: np.ndarray, features: Features, rounds: int = 3, prior: float = 0.85) -> None:
        batch = Batch(texts, features)
        own = np.zeros((len(texts), LEVELS), np.float32)
        own[np.arange(len(texts)), labels - 1] = 1
        belief = np.repeat(prior * own + (1 - prior) / LEVELS, np.diff(batch.documents), axis=0)
        target, weight = belief, np.where(batch.english, 1.0, 0.0).astype(np.float32)
        ids, rows = batch.words()
        groups, inverse = self.letter_features(batch, features)
        lengths = np.array([len(g) for g in groups])
        flat, start = np.concatenate(groups), np.concatenate([[0], np.cumsum(lengths)])
        n = lengths[inverse]
        index = np.arange(n.sum()) + np.repeat(start[inverse] - (np.cumsum(n) - n), n)
        chars, char_rows = flat[index], np.concatenate([[0], np.cumsum(n)])[batch.rows]
        shapes = batch.shape().reshape(-1), np.arange(len(batch.n) + 1) * 2
        for k in range(rounds):
            last = k == rounds - 1
            self.word, self.char, self.shape = MeanModel(1 << BITS, LEVELS), MeanModel(1 << BITS, LEVELS), MeanModel(64, LEVELS)
            self.cache = {}
            self.word.fit(ids, rows, target, weight, epochs=8 if last else 4)
            self.char.fit(chars, char_rows, target, weight, epochs=4 if last else 2)
            self.shape.fit(*shapes, target, weight, epochs=4)
            levels = self.sentence_levels(batch, features)
            target = levels * belief
            target = (target / target.sum(axis=1, keepdims=True)).astype(np.float32)
        n, share = self.documents(batch, levels)
        for _ in range(200):  # offsets of the levels, fitted to the labelled documents
            p = softmax(8 * share + self.calibration)
            self.calibration -= 0.5 * ((p - own) * (n > 0)[:, None]).mean(axis=0).astype(np.float32)

    def predict(self, texts: list[str | None], features: Features, least: int = LEAST) -> np.ndarray:
        """Level of each text, 0 for those without enough English prose."""
        batch = Batch(texts, features)
        n, share = self.documents(batch, self.sentence_levels(batch, features))
        return np.where(n >= least, np.argmax(8 * share + self.calibration, axis=1) + 1, 0)


def fitted(documents: DataFrame, labels: DataFrame, most: int = MOST_LABELS) -> Model | None:
    """A model of the labelled documents, at most ``most`` of them, drawn by a hash of their ids; None without labels."""
    known = labels.filter(F.col("reading_level").between(1, LEVELS)).select("doc_id", "reading_level").dropDuplicates(["doc_id"])
    drawn = {r["doc_id"]: r["reading_level"] for r in bounded(known, ["doc_id"], most)}
    sample = documents.sparkSession.createDataFrame(list(drawn.items()), known.schema) if drawn else known.limit(0)
    rows = documents.select("doc_id", "text").filter("text is not null").join(F.broadcast(sample), "doc_id").orderBy("doc_id").collect()  # bounded by most
    if not rows:
        return None
    model = Model()
    model.fit([r["text"] for r in rows], np.array([r["reading_level"] for r in rows]), Features())
    model.cache = {}
    return model


def levels(documents: DataFrame, labels: DataFrame, most: int = MOST_LABELS, least: int = LEAST) -> DataFrame:
    """(doc_id, reading_level) of every document with enough English running prose; none without labels."""
    model = fitted(documents, labels, most)
    kind = dict(documents.dtypes)["doc_id"]
    rows = documents.filter("doc_id is not null and text is not null").select("doc_id", "text")
    if model is None:
        return rows.filter("false").select("doc_id", F.lit(1).alias("reading_level"))
    shared = documents.sparkSession.sparkContext.broadcast(model)  # of fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Features()
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                part = batch.slice(at, 2000)
                level = shared.value.predict(part.column(1).to_pylist(), features, least)
                out = pa.RecordBatch.from_arrays([part.column(0), pa.array(level.astype(np.int32))], ["doc_id", "reading_level"])
                yield out.filter(pa.array(level > 0))

    return rows.mapInArrow(run, f"doc_id {kind}, reading_level int")
