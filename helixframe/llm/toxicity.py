"""Toxicity by averaged subword embeddings under a linear softmax.

A text is the bag of the character n-grams of its words; every n-gram has a vector (hashed into
``BUCKETS`` rows), the text's vector is their mean (a word that a text has *n* times weighs as
sqrt(*n*), so that repeated lines do not drown the rest), and a linear softmax on it gives two classes.
Vectors and softmax are trained jointly in numpy on a bounded sample of labelled texts, at most
``PER_CLASS`` clean and toxic ones, drawn by hash order.  Misspelled and inflected words share most
n-grams with the words they derive from, and so their vectors.  n-grams that the sample does not
tie to either class (``ASSOCIATION``) have zero vectors: few labelled texts would only teach them
by heart.  They are counted by Spark; the driver sees the others' parts of the sampled bags.

Scoring needs one number per n-gram (the model is linear in the mean), which is what is
broadcast: ``4 * BUCKETS`` bytes at any input.

Null and wordless texts get the score of the bias alone; repeated rows get equal scores; an empty
table gives an empty result; columns other than doc_id, text are ignored, so that labels, lang,
source and doc_id never enter a score.  Null labels are not learned from; of several labels for
one doc_id the highest counts, of several texts the first in byte order.  Without toxic labels (or
without any) every score is near zero, without clean ones near one.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from ._runs import BYTE_SYMBOLS, Hasher
from ._shared import as_bytes, as_numpy, batch_of, materialise, small_batches

BUCKETS = 1 << 19
GRAMS = (3, 4, 5)
DIM = 8
PER_CLASS = (3000, 1500)
EPOCHS = 6
#: Small samples are gone through more often, for at least so many batches.
LEAST_BATCHES = 800
RATE = 0.3
#: n-grams are learned whose share of toxic texts is this many standard errors off that of all
#: texts; chosen, as ``SCALE``, on folds 1 to 3.
ASSOCIATION = 4.0
LEAST_TEXTS = 3
#: Factor of the mean: few n-grams of a text have a vector, so means are short.
SCALE = 20.0
BATCH = 64
CACHE = 250_000
FOLDS = 5

#: Letters and digits of ASCII in lower case and all other bytes above it; the rest parts words.
_WORD_BYTES = bytes(
    c if c >= 0x80 or chr(c).isalnum() else 0x20 for c in bytes(range(128)).lower() + bytes(range(128, 256))
)


def words_of(body: bytes) -> list[bytes]:
    return body.translate(_WORD_BYTES).split()


def word_grams(words: list[bytes], buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all words' n-grams (with word ends marked), and how many each word has."""
    line = b"<" + b"><".join(words) + b">"
    size = np.fromiter(map(len, words), np.int64, len(words)) + 2
    start = np.cumsum(size) - size
    hasher = Hasher(BYTE_SYMBOLS[np.frombuffer(line, np.uint8)])
    found, owner = [], []
    for n in GRAMS:
        count = np.maximum(size - n + 1, 0)
        at = np.repeat(start - (np.cumsum(count) - count), count) + np.arange(count.sum())
        found.append(hasher.lane(0, at, at + n))
        owner.append(np.repeat(np.arange(len(words)), count))
    owner = np.concatenate(owner)
    order = np.argsort(owner, kind="stable")
    bucket = (np.concatenate(found) % np.uint64(buckets)).astype(np.int64)
    return bucket[order], np.bincount(owner, minlength=len(words))


def bag(body: bytes, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Different buckets of one text and their shares of the bag."""
    words = words_of(body)
    if not words:
        return np.zeros(0, np.int64), np.zeros(0)
    times = Counter(words)
    bucket, size = word_grams(list(times), buckets)
    ids, inverse = np.unique(bucket, return_inverse=True)
    total = np.bincount(inverse, np.repeat(np.sqrt(list(times.values())), size))
    return ids, total / total.sum()


@dataclass
class SubwordModel:
    """``gram`` has each bucket's part in the log odds of class 1."""

    gram: np.ndarray
    bias: float


def associated(texts: np.ndarray, toxic: np.ndarray, all_texts: int, all_toxic: int) -> np.ndarray:
    """Which n-grams, in ``texts`` texts of which ``toxic`` are toxic, say something about the class."""
    rate = all_toxic / max(all_texts, 1)
    spread = np.sqrt(texts * rate * (1 - rate))
    return (texts >= LEAST_TEXTS) & (np.abs(toxic - texts * rate) >= ASSOCIATION * spread) & (spread > 0)


def train(bags: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, known: np.ndarray, buckets: int, seed: int = 7) -> SubwordModel:
    """Joint AdaGrad training of the vectors of the n-grams ``known`` (sorted) and the softmax."""
    gram = np.zeros(buckets, np.float32)
    if not 0 < labels.sum() < len(labels):
        return SubwordModel(gram, 30.0 if len(labels) and labels.all() else -30.0)
    rng = np.random.default_rng(seed)
    bags = [(np.searchsorted(known, b[0]), b[1]) for b in bags]
    ids = np.concatenate([b[0] for b in bags])
    share = np.concatenate([b[1] for b in bags]).astype(np.float32) * np.float32(SCALE)
    ends = np.cumsum([len(b[0]) for b in bags])
    starts = ends - [len(b[0]) for b in bags]
    vectors = rng.normal(0, 0.003, (len(known), DIM)).astype(np.float32)
    weight, bias = rng.normal(0, 0.1, (DIM, 2)).astype(np.float32), np.zeros(2, np.float32)
    seen = np.full(len(known), 1e-6, np.float32)
    seen_w, seen_b = np.full_like(weight, 1e-6), np.full_like(bias, 1e-6)
    batches = max(1, len(bags) // BATCH)
    for _ in range(max(EPOCHS, -(-LEAST_BATCHES // batches))):
        order = rng.permutation(len(bags))
        for some in np.array_split(order, batches):
            at = np.concatenate([np.arange(starts[i], ends[i]) for i in some])
            text = np.repeat(np.arange(len(some)), ends[some] - starts[some])
            own, part = ids[at], share[at]
            hidden = np.zeros((len(some), DIM), np.float32)
            values = vectors[own] * part[:, None]
            for d in range(DIM):
                hidden[:, d] = np.bincount(text, values[:, d], len(some))
            z = hidden @ weight + bias
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            error = p - np.eye(2, dtype=np.float32)[labels[some]]
            back = error @ weight.T
            grad_w, grad_b = hidden.T @ error, error.sum(0)
            different, inverse = np.unique(own, return_inverse=True)
            grad = np.empty((len(different), DIM), np.float32)
            scaled = back[text] * part[:, None]
            for d in range(DIM):
                grad[:, d] = np.bincount(inverse, scaled[:, d], len(different))
            seen[different] += (grad**2).mean(1)
            vectors[different] -= RATE * grad / np.sqrt(seen[different])[:, None]
            seen_w += grad_w**2
            weight -= RATE * grad_w / np.sqrt(seen_w)
            seen_b += grad_b**2
            bias -= RATE * grad_b / np.sqrt(seen_b)
    gram[known] = SCALE * vectors @ (weight[:, 1] - weight[:, 0])
    return SubwordModel(gram, float(bias[1] - bias[0]))


class Scorer:
    """Scores texts; each different word's n-grams are added up once and kept in a bounded cache."""

    def __init__(self, model: SubwordModel):
        self.model, self.words = model, {}
        self.sums, self.counts = np.zeros(0), np.zeros(0)

    def scores(self, bodies: list[bytes]) -> np.ndarray:
        texts = [words_of(b) for b in bodies]
        if len(self.words) > CACHE:
            self.words, self.sums, self.counts = {}, np.zeros(0), np.zeros(0)
        fresh = list({w for t in texts for w in t}.difference(self.words))
        if fresh:
            bucket, size = word_grams(fresh, len(self.model.gram))
            owner = np.repeat(np.arange(len(fresh)), size)
            first = len(self.words)
            self.words.update(zip(fresh, range(first, first + len(fresh)), strict=True))
            self.sums = np.concatenate([self.sums, np.bincount(owner, self.model.gram[bucket], len(fresh))])
            self.counts = np.concatenate([self.counts, size])
        out = np.empty(len(texts))
        for i, words in enumerate(texts):
            at = np.fromiter(map(self.words.__getitem__, words), np.int64, len(words))
            at, times = np.unique(at, return_counts=True)
            weight = np.sqrt(times)
            mean = self.sums[at] @ weight / (self.counts[at] @ weight) if self.counts[at].any() else 0.0
            out[i] = 1 / (1 + np.exp(-np.clip(mean + self.model.bias, -30, 30)))
        return out


def fold(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % FOLDS


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", per_class: tuple[int, int] = PER_CLASS, buckets: int = BUCKETS) -> SubwordModel:
    """Train on labelled rows outside fold 0: the first ``per_class`` (clean, toxic) by hash order."""
    usable = labels.where(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1) & (fold(F.col("doc_id")) != 0))
    one = usable.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(label).cast("int").alias("label"))
    order = F.xxhash64(F.lit("sample"), "doc_id")
    parts = [one.where(F.col("label") == k).orderBy(order, "doc_id").limit(per_class[k]) for k in (0, 1)]
    sample = F.broadcast(parts[0].unionByName(parts[1]))  # sum(per_class) rows at most
    schema = pa.schema([("doc_id", pa.int64()), ("label", pa.int32()), ("ids", pa.binary()), ("share", pa.binary())])
    bag_ddl = "doc_id long, label int, ids binary, share binary"

    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bags = [bag(b.tobytes(), buckets) for b in as_bytes(batch.column("body"))]
            ids, share = [b[0].astype(np.int32).tobytes() for b in bags], [b[1].astype(np.float32).tobytes() for b in bags]
            yield batch_of(schema, [batch.column("doc_id"), batch.column("label"), ids, share])

    counts = pa.schema([("bucket", pa.int32()), ("texts", pa.int64()), ("toxic", pa.int64())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts, toxic = np.zeros(buckets, np.int64), np.zeros(buckets, np.int64)
        for batch in batches:
            for own, label in zip(as_bytes(batch.column("ids")), as_numpy(batch.column("label")), strict=True):
                texts[own.view(np.int32)] += 1  # a bag has each bucket once
                toxic[own.view(np.int32)] += label
        at = np.flatnonzero(texts)
        yield batch_of(counts, [at.astype(np.int32), texts[at], toxic[at]])

    bodies = small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).cast("binary").alias("body"))
    chosen = bodies.join(sample, "doc_id").groupBy("doc_id", "label").agg(F.min("body").alias("body"))
    bags = materialise(chosen.mapInArrow(spell, bag_ddl), "bags")
    sizes = bags.agg(F.count("*"), F.coalesce(F.sum("label"), F.lit(0))).first()
    by_gram = bags.mapInArrow(count, "bucket int, texts long, toxic long").groupBy("bucket").agg(F.sum("texts").alias("texts"), F.sum("toxic").alias("toxic"))
    found = by_gram.where(F.col("texts") >= LEAST_TEXTS).toArrow().sort_by("bucket")  # of at most ``buckets`` rows
    bucket, texts, toxic = (as_numpy(found.column(c)) for c in ("bucket", "texts", "toxic"))
    known = bucket[associated(texts, toxic, *sizes)]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = []
            for ids, share in zip(as_bytes(batch.column("ids")), as_bytes(batch.column("share")), strict=True):
                kept = np.isin(ids.view(np.int32), known)
                held.append((ids.view(np.int32)[kept].tobytes(), share.view(np.float32)[kept].tobytes()))
            yield batch_of(schema, [batch.column("doc_id"), batch.column("label"), [a for a, _ in held], [b for _, b in held]])

    rows = bags.mapInArrow(cut, bag_ddl).toArrow().sort_by("doc_id").combine_chunks()
    views = zip(*(as_bytes(rows.column(c).combine_chunks()) for c in ("ids", "share")), strict=True)
    return train([(a.view(np.int32), b.view(np.float32)) for a, b in views], as_numpy(rows.column("label")).astype(np.int64), known, buckets)


def score(docs: DataFrame, model: SubwordModel, *keep: str) -> DataFrame:
    """``doc_id`` and the columns of ``keep``, with ``score`` of each whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    source = "text" if "text" in keep else "body"
    body = F.coalesce("text", F.lit("")).cast("binary").alias("body")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                found = scorer.scores([b.tobytes() for b in as_bytes(batch.column(source))])
                names = [c for c in batch.schema.names if c != "body"]
                own = [batch.column(c) for c in names]
                yield pa.RecordBatch.from_arrays([*own, pa.array(found)], names=[*names, "score"])

    chosen = small_batches(docs).select("doc_id", *keep, *([body] if source == "body" else []))
    kinds = StructType([*(f for f in chosen.schema if f.name != "body"), StructField("score", DoubleType())])
    return chosen.mapInArrow(run, kinds)


def op7_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score(docs, model).select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(fold(F.col("doc_id")) == 0, F.lit(False)).alias("held_out"), "score",
        F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"),
    )
