"""Quality classifier: random-indexing word vectors, pooled per document, and a two-layer network.

1. Words (runs of letters, of digits, of other signs; case kept) are hashed
   into ``buckets`` entries, each with a fixed sparse random index vector; words
   of one entry share a vector.  An
   entry's word vector is the sum of the index vectors around and at its
   occurrences in all documents, with unit length.  Tasks sum their own
   occurrences; the sums meet in a partial aggregate of a fixed size.
2. A document's features are the mean and the spread of its word vectors, the
   mean square step from one to the next and the logarithm of their number.
3. A two-layer network is fitted in numpy to labelled rows (at most
   ``fit_rows``, by hash of their id, one text an id); a temperature fitted to the part that
   the network has not seen makes its outputs probabilities.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import documents, kept, quoted, slices
from .tokens import PART, cut_chunks, gather, split_spaces, strings, sums

BUCKETS, DIMENSIONS, NONZERO, REACH = 1 << 14, 32, 6, 2
FEATURES = 2 * DIMENSIONS + 2
#: Bytes of text whose words are listed, and words whose vectors are held, at a time.
SLICE, BLOCK = 4_000_000, 1 << 16
_WORDS = re.compile(r"[^\W\d_]+|\d+|[^\w\s]+|_+")
_PARTED = re.compile(rf"{PART}|[^\W\d_]+|\d+|[^\w\s{PART}]+|_+")


def index_vectors(buckets: int = BUCKETS) -> np.ndarray:
    """The fixed random index vector of every entry: ``NONZERO`` entries of plus or minus one."""
    rng = np.random.default_rng(20)
    out = np.zeros((buckets, DIMENSIONS), np.int16)
    places = rng.random((buckets, DIMENSIONS)).argsort(axis=1)[:, :NONZERO]
    np.put_along_axis(out, places, rng.choice([-1, 1], places.shape).astype(np.int16), axis=1)
    return out


def _hash(word: str) -> int:
    return zlib.crc32(word.encode("utf-8"))


def word_entries(texts: pa.Array, buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray]:
    """The entries of all words of the texts, and each text's number of words."""
    words, bounds = split_spaces(texts)
    coded = words.dictionary_encode()
    chunks, index = strings(coded.dictionary), coded.indices.to_numpy()
    joined = PART.join([*chunks, ""])
    if joined.count(PART) == len(chunks):
        pieces, places, begins = cut_chunks(joined, _PARTED)
        entries = (np.fromiter(map(_hash, pieces), np.int64, len(pieces)) % buckets).astype(np.int32)[places]
    else:                                                       # a text holds the parting sign itself
        found = [_WORDS.findall(c) for c in chunks]
        entries = np.array([_hash(w) % buckets for f in found for w in f], np.int32)
        begins = np.concatenate([[0], np.cumsum([len(f) for f in found], dtype=np.int64)])
    lengths = np.diff(begins)
    return gather(entries, lengths, index), sums(lengths[index], bounds)


def word_vectors(rows: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """The unit word vectors learned from all texts of ``rows`` (column ``text``); zero for entries never met."""
    names = [f"v{d}" for d in range(DIMENSIONS)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = kept(f"word vectors {buckets}", lambda: index_vectors(buckets))
        total = np.zeros((buckets, DIMENSIONS), np.int64)
        for batch in slices(batches, limit=SLICE):
            entries, counts = word_entries(batch.column("text"), buckets)
            text = np.repeat(np.arange(len(counts), dtype=np.int32), counts)
            for begin in range(0, len(entries), BLOCK):
                # a block's words with their neighbours on both sides
                low, high = max(0, begin - REACH), min(len(entries), begin + BLOCK + REACH)
                own, of = index[entries[low:high]], text[low:high]
                around = own.copy()
                for step in range(1, REACH + 1):
                    together = (of[step:] == of[:-step])[:, None]
                    around[step:] += own[:-step] * together
                    around[:-step] += own[step:] * together
                inside = slice(begin - low, min(begin + BLOCK, len(entries)) - low)
                words = entries[low:high][inside]
                order = np.argsort(words, kind="stable")
                met, begins = np.unique(words[order], return_index=True)
                total[met] += np.add.reduceat(around[inside][order], begins, axis=0, dtype=np.int32)
        met = np.flatnonzero(total.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(met), *(pa.array(total[met, d]) for d in range(DIMENSIONS))],
                                         ["entry", *names])

    summed = (rows.select("text").mapInArrow(run, "entry long, " + ", ".join(f"{n} long" for n in names))
              .groupBy("entry").agg(*[F.sum(n).alias(n) for n in names]).collect())      # buckets rows at most
    vectors = np.zeros((buckets, DIMENSIONS))
    for row in summed:
        vectors[row[0]] = row[1:]
    norms = np.linalg.norm(vectors, axis=1, keepdims=True)
    return (vectors / np.where(norms > 0, norms, 1)).astype(np.float32)


def _word_blocks(counts: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of words: whole texts up to ``BLOCK`` words together, a longer text in pieces of its own.

    A text's sums are then added up in the same order whatever stands beside it.
    """
    ends = np.cumsum(counts)
    text, at = 0, 0
    while text < len(counts):
        last = int(np.searchsorted(ends, at + BLOCK, "right"))
        if last > text:
            yield at, int(ends[last - 1])
            text, at = last, int(ends[last - 1])
        else:
            for begin in range(at, int(ends[text]), BLOCK):
                yield begin, min(begin + BLOCK, int(ends[text]))
            text, at = text + 1, int(ends[text])


def features(texts: pa.Array, vectors: np.ndarray) -> np.ndarray:
    """Of each text: mean and spread of its word vectors, mean square step from word to word, log of its words."""
    entries, counts = word_entries(texts, len(vectors))
    text = np.repeat(np.arange(len(counts), dtype=np.int32), counts)
    total = np.zeros((len(counts), 2 * DIMENSIONS + 1))
    for begin, end in _word_blocks(counts):
        if begin == end:
            continue
        low = max(begin - 1, 0)                                   # the step to a block's first word
        values, of = vectors[entries[low:end]], text[low:end]
        step = values[1:] - values[:-1]
        np.multiply(step, step, out=step)
        steps = np.zeros(end - low, np.float32)
        steps[1:] = step.sum(axis=1) * (of[1:] == of[:-1])
        values, of, steps = values[begin - low:], of[begin - low:], steps[begin - low:]
        met, begins = np.unique(of, return_index=True)
        total[met, :DIMENSIONS] += np.add.reduceat(values, begins, axis=0)
        total[met, -1] += np.add.reduceat(steps, begins)
        np.multiply(values, values, out=values)
        total[met, DIMENSIONS:-1] += np.add.reduceat(values, begins, axis=0)
    n = np.maximum(counts, 1)[:, None]
    out = np.zeros((len(counts), FEATURES), np.float32)
    out[:, :DIMENSIONS] = total[:, :DIMENSIONS] / n
    out[:, DIMENSIONS:-2] = np.sqrt(np.maximum(total[:, DIMENSIONS:-1] / n - out[:, :DIMENSIONS].astype(float) ** 2, 0))
    out[:, -2] = total[:, -1] / np.maximum(n[:, 0] - 1, 1)
    out[:, -1] = np.log1p(counts)
    return out


class Network:
    """Two layers, fitted by Adam to the logistic loss; a temperature calibrates the outputs."""

    def __init__(self, x: np.ndarray, y: np.ndarray, hidden: int = 32, rounds: int = 60, seed: int = 1):
        rng = np.random.default_rng(seed)
        self.rate = float(y.mean()) if len(y) else 0.5
        self.layers = None
        if len(y) < 20 or y.min() == y.max():         # too little to learn from: the labels' mean
            return
        self.centre, self.scale = x.mean(axis=0), x.std(axis=0) + 1e-6
        x = (x - self.centre) / self.scale
        aside = np.arange(len(y)) % 5 == 0            # for the temperature
        fit = np.flatnonzero(~aside)
        layers = [rng.normal(0, x.shape[1] ** -0.5, (x.shape[1], hidden)), np.zeros(hidden),
                  rng.normal(0, hidden ** -0.5, hidden), np.zeros(1)]
        first, second, step = [0.0] * 4, [0.0] * 4, 0
        for _ in range(rounds):
            for part in np.array_split(rng.permutation(fit), max(1, len(fit) // 128)):
                a, t = x[part], y[part]
                h = np.tanh(a @ layers[0] + layers[1])
                err = (1 / (1 + np.exp(-np.clip(h @ layers[2] + layers[3], -50, 50))) - t) / len(part)
                back = np.outer(err, layers[2]) * (1 - h * h)
                grads = [a.T @ back + 1e-4 * layers[0], back.sum(axis=0), h.T @ err + 1e-4 * layers[2],
                         err.sum(keepdims=True)]
                step += 1
                for k, g in enumerate(grads):
                    first[k] = 0.9 * first[k] + 0.1 * g
                    second[k] = 0.999 * second[k] + 0.001 * g * g
                    layers[k] = layers[k] - 3e-3 * (first[k] / (1 - 0.9**step)) / (
                        np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
        self.layers, self.temperature = layers, 1.0
        raw, t = self._raw(x[aside]), y[aside]
        loss = [np.logaddexp(0, np.where(t == 1, -raw, raw) / k).mean() for k in TEMPERATURES]
        self.temperature = float(TEMPERATURES[int(np.argmin(loss))])

    def _raw(self, x: np.ndarray) -> np.ndarray:
        return np.tanh(x @ self.layers[0] + self.layers[1]) @ self.layers[2] + self.layers[3]

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.layers is None:
            return np.full(len(x), self.rate)
        raw = self._raw((x - self.centre) / self.scale) / self.temperature
        return 1 / (1 + np.exp(-np.clip(raw, -50, 50)))


TEMPERATURES = np.exp(np.linspace(np.log(0.25), np.log(8), 61))


def held_out(doc_id: Column) -> Column:
    """Rows that are never learned from: those whose crc32(id as text) leaves 2 when divided by 4."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


class Classifier:
    """Word vectors and network: a fixed size, whatever the corpus."""

    def __init__(self, vectors: np.ndarray, network: Network):
        self.vectors, self.network = vectors, network

    def score(self, texts: pa.Array) -> np.ndarray:
        """Scores of a batch, a few megabytes of text at a time; null texts count as empty."""
        kept("scores", lambda: None)                              # lets other operators' caches go
        batch = pa.RecordBatch.from_arrays([texts.cast(pa.string()).fill_null("")], ["text"])
        return np.concatenate([np.empty(0), *(self.network.score(features(part.column("text"), self.vectors)
                                                                 .astype(np.float64))
                                              for part in slices([batch], limit=SLICE))])


def fit_quality(docs: DataFrame, labels: DataFrame, fit_rows: int = 20_000, id_col: str = "doc_id",
                text_col: str = "text", label_col: str = "quality", buckets: int = BUCKETS) -> Classifier:
    """Learn word vectors from all texts, and labels from at most ``fit_rows`` rows that are not held out.

    An id with several labels has their largest, an id with several rows gives
    its least text; null labels and ids label nothing; with fewer than 20 labels, or one class only, every score will be
    the labels' mean (0.5 without labels).
    """
    rows = documents(docs, id_col, text_col)
    known = (labels.select(quoted(id_col).alias("doc_id"), quoted(label_col).cast("int").alias("label"))
             .where("label is not null and doc_id is not null").groupBy("doc_id").agg(F.max("label").alias("label")))
    # ids first: at most fit_rows of them are broadcast to fetch their texts
    some = (known.join(rows.select("doc_id"), "doc_id", "left_semi").where(~held_out(F.col("doc_id")))
            .orderBy(F.xxhash64("doc_id"), "doc_id").limit(fit_rows))
    chosen = (rows.join(F.broadcast(some), "doc_id").groupBy("doc_id", "label").agg(F.min("text").alias("text"))
              .select("label", "text"))
    vectors = word_vectors(rows, buckets)
    shared = rows.sparkSession.sparkContext.broadcast(vectors)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, limit=SLICE):
            x = features(batch.column("text"), shared.value)
            lists = pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), FEATURES).cast(pa.list_(pa.float32()))
            yield pa.RecordBatch.from_arrays([batch.column("label"), lists], ["label", "x"])

    fit = sorted(chosen.mapInArrow(run, "label int, x array<float>").collect())      # fit_rows rows at most
    x = np.array([r.x for r in fit], np.float64).reshape(len(fit), FEATURES)
    return Classifier(vectors, Network(x, np.array([r.label for r in fit], np.float64)))


def score_quality(docs: DataFrame, labels: DataFrame, fit_rows: int = 20_000, id_col: str = "doc_id",
                  text_col: str = "text", label_col: str = "quality", buckets: int = BUCKETS) -> DataFrame:
    """``doc_id, held_out, score`` of every row: the calibrated probability that its label is 1.

    Ids, labels and other columns take no part in a score.  Null texts count
    as empty and get the score of a text without words.  Repeated rows stay;
    an empty table gives no rows; see ``fit_quality`` for odd labels.
    """
    rows = documents(docs, id_col, text_col)
    model = rows.sparkSession.sparkContext.broadcast(
        fit_quality(docs, labels, fit_rows, id_col, text_col, label_col, buckets))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(model.value.score(batch.column("text")))],
                                             ["doc_id", "score"])

    scored = rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score")


def keep_quality(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, fit_rows: int = 20_000,
                 id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
                 buckets: int = BUCKETS) -> DataFrame:
    """The rows of ``docs`` that score ``threshold`` or more, with all their columns.

    Null texts count as empty; null and repeated ids and repeated rows stay or
    go by their own text; an empty table gives no rows; columns may have any
    names.  Only the texts that the fit reads are shuffled.
    """
    model = docs.sparkSession.sparkContext.broadcast(
        fit_quality(docs, labels, fit_rows, id_col, text_col, label_col, buckets))
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(model.value.score(batch.column(at)) >= threshold))

    plain = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])        # names may hold dots
    return plain.mapInArrow(run, plain.schema).toDF(*docs.columns)
