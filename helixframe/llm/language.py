"""Language identification by Bayesian fusion of text, markup and address evidence.

Text likelihoods come from byte trigrams, learned from at most ``PER_LANGUAGE`` documents of each
language by hash order.  Pages add the language their markup declares, the suffix of their
address and their host.  Priors are grouped sums of the text posteriors, smoothed downwards:
all pages, then suffix, then host, each level with ``STRENGTH`` pages' worth of the one above; a
page's own share is taken out of its groups.  How far declarations are to be believed is learned
the same way, as the share of each declared value among the pages of each language.

Null pages have no text and keep the prior's language; null addresses share one empty host and
suffix; a missing declaration is a value of its own; repeated rows are classified each; ties go to
the language first in order; an empty table gives an empty result; without documents of a known
language every page's language is null; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._runs import BYTE_SYMBOLS, Hasher
from ._shared import as_bytes, batch_of, materialise

BUCKETS = 1 << 16
GRAM = 3
PER_LANGUAGE = 300
STRENGTH = 5.0
_MARK = re.compile(rb"(?i)<|&[a-z#0-9]+;")
_HIDDEN = re.compile(rb"(?i)<(script|style)\b")
_CLOSING = {name: re.compile(rb"(?i)</%s\s*>" % name) for name in (b"script", b"style")}
_ROOT = re.compile(rb"(?i)<html")
_LANG = re.compile(rb"""(?i)(?=\blang\s*=\s*["']?([a-z]{2,3}))""")
_SPACE = re.compile(rb"[\x00-\x40\x5b-\x60\x7b-\x7f]+")


def without_tags(body: bytes) -> bytes:
    """``body`` with a space for each script, style, comment, tag and entity.

    One scan forwards: what closes a mark is searched for from the mark on, and once nothing of a
    kind is left to close, that kind is not searched for again.  So time is linear in any page.
    """
    out, kept, at = [], 0, 0
    open_ = {b"script", b"style", b"<!--", b"<"}

    def closed(kind: bytes, end: int) -> int:
        if end < 0:
            open_.discard(kind)
        return end

    while mark := _MARK.search(body, at):
        start, end = mark.span()
        if end - start == 1:
            end = -1
            if (hidden := _HIDDEN.match(body, start)) and (name := hidden[1].lower()) in open_:
                close = _CLOSING[name].search(body, hidden.end())
                end = closed(name, close.end() if close else -1)
            if end < 0 and b"<!--" in open_ and body.startswith(b"<!--", start):
                end = closed(b"<!--", body.find(b"-->", start + 4))
                end += 3 if end >= 0 else 0
            if end < 0 and b"<" in open_:
                end = closed(b"<", body.find(b">", start + 1)) + 1 or -1
            if end < 0:
                at = start + 1
                continue
        out.append(body[kept:start])
        kept = at = end
    return b" ".join([*out, body[kept:]])


def declared_language(body: bytes) -> bytes:
    """The last ``lang`` within the first ``html`` tag that has one, lowered; empty without any.

    Later openings of a tag that is not closed in between see less of it, so each tag is read once.
    """
    at = 0
    while root := _ROOT.search(body, at):
        end = body.find(b">", root.end())
        end = len(body) if end < 0 else end
        if found := [m[1] for m in _LANG.finditer(body, root.end(), end)]:
            return found[-1].lower()
        at = end
    return b""


def grams(body: bytes) -> np.ndarray:
    """Buckets of the trigrams of a text's lowered letters."""
    letters = b" " + _SPACE.sub(b" ", body.lower()).strip() + b" "
    if len(letters) < GRAM + 1:
        return np.zeros(0, np.int64)
    return (Hasher(BYTE_SYMBOLS[np.frombuffer(letters, np.uint8)]).grams(GRAM) % np.uint64(BUCKETS)).astype(np.int64)


def fit(docs: DataFrame, per_language: int = PER_LANGUAGE) -> tuple[list[str], np.ndarray]:
    """Languages in order, and the log probability of each bucket in each."""
    known = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    order = Window.partitionBy("lang").orderBy(F.xxhash64(F.lit("language"), "doc_id"), "doc_id")
    # a window's rank filter is applied in each task before the shuffle, so no task sees a whole language
    chosen = known.select("lang", "doc_id").withColumn("r", F.row_number().over(order)).where(F.col("r") <= per_language).drop("r")
    schema = pa.schema([("lang", pa.string()), ("ids", pa.list_(pa.int32())), ("n", pa.list_(pa.int32()))])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [np.unique(grams(b.tobytes()), return_counts=True) for b in as_bytes(batch.column("body"))]
            yield batch_of(schema, [batch.column("lang"), [i.astype(np.int32) for i, _ in found], [n.astype(np.int32) for _, n in found]])

    sample = F.broadcast(chosen.distinct())  # per_language rows of each language at most
    texts = known.select("doc_id", "lang", F.col("text").cast("binary").alias("body")).join(sample, ["doc_id", "lang"])
    one_each = texts.groupBy("doc_id", "lang").agg(F.min("body").alias("body"))
    rows = one_each.mapInArrow(count, "lang string, ids array<int>, n array<int>").select("lang", F.inline(F.arrays_zip("ids", "n")))
    counted = rows.groupBy("lang", "ids").agg(F.sum("n").alias("n")).toArrow().to_pandas()  # BUCKETS rows a language at most
    languages = sorted(set(counted["lang"]) | {r[0] for r in chosen.select("lang").distinct().collect()})
    counts = np.full((len(languages), BUCKETS), 0.5)
    place = {x: i for i, x in enumerate(languages)}
    np.add.at(counts, (counted["lang"].map(place).to_numpy(np.int64), counted["ids"].to_numpy(np.int64)), counted["n"].to_numpy())
    return languages, np.log(counts / counts.sum(1, keepdims=True))


def likelihoods(pages: DataFrame, languages: list[str], model: np.ndarray) -> DataFrame:
    """``page_id, host, suffix, declared, ll, soft``: text likelihoods and the posterior of text alone.

    Without languages both lists are empty.
    """
    shared = pages.sparkSession.sparkContext.broadcast(model)
    host = F.lower(F.coalesce(F.regexp_extract("url", r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/:?#]*)", 1), F.lit("")))
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"), host.alias("host"), F.element_at(F.split(host, r"\."), -1).alias("suffix"),
        F.coalesce("html", F.lit("")).cast("binary").alias("body"),
    )
    names = ["page_id", "host", "suffix"]
    doubles = pa.list_(pa.float64())
    schema = pa.schema([("page_id", pa.int64()), *((n, pa.string()) for n in [*names[1:], "declared"]), ("ll", doubles), ("soft", doubles)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        logs = shared.value
        for batch in batches:
            said, lls, softs = [], [], []
            for body in map(np.ndarray.tobytes, as_bytes(batch.column("body"))):
                said.append(declared_language(body).decode())
                ids, n = np.unique(grams(without_tags(body)), return_counts=True)
                ll = logs[:, ids] @ n.astype(np.float64)
                best = ll.max(initial=-np.inf)
                raised = np.exp(ll - best)
                lls.append((ll - best).tolist())
                softs.append((raised / raised.sum()).tolist())
            yield batch_of(schema, [*(batch.column(c) for c in names), said, lls, softs])

    return rows.mapInArrow(run, "page_id long, host string, suffix string, declared string, ll array<double>, soft array<double>")


def _sums(df: DataFrame, by: list[str], k: int, name: str) -> DataFrame:
    shares = F.array(*(F.sum(F.col("soft")[i]) for i in range(k)))
    return df.groupBy(*by).agg(shares.alias(name), F.count("*").cast("double").alias(f"{name}_n"))


def identify(pages: DataFrame, languages: list[str], model: np.ndarray, strength: float = STRENGTH) -> DataFrame:
    """``page_id, lang, confidence, text_lang, declared, host``."""
    k = len(languages)
    if not k:
        none = F.lit(None).cast("string")
        return likelihoods(pages, languages, model).select("page_id", none.alias("lang"), F.lit(None).cast("double").alias("confidence"), none.alias("text_lang"), "declared", "host")
    found = materialise(likelihoods(pages, languages, model), "likelihoods")
    every = _sums(found, [], k, "a")  # one row of sums
    by_suffix, by_host, by_word = (_sums(found, [c], k, n) for c, n in (("suffix", "s"), ("host", "h"), ("declared", "d")))
    vocabulary = found.agg(F.count_distinct("declared").cast("double").alias("words"))
    joined = found.join(by_suffix, "suffix").join(by_host, "host").join(by_word, "declared").join(F.broadcast(every)).join(F.broadcast(vocabulary))

    def log_prior(i: int):
        own = F.col("soft")[i]
        top = (F.col("a")[i] - own + 1.0) / (F.col("a_n") - 1 + k)
        suffix = (F.col("s")[i] - own + strength * top) / (F.col("s_n") - 1 + strength)
        host = (F.col("h")[i] - own + strength * suffix) / (F.col("h_n") - 1 + strength)
        said = (F.col("d")[i] - own + 1.0) / (F.col("a")[i] - own + F.col("words"))
        floor = F.lit(1e-9)
        return F.ln(F.greatest(host, floor)) + F.ln(F.greatest(said, floor))

    total = F.array(*(F.col("ll")[i] + log_prior(i) for i in range(k)))
    scored = joined.withColumn("total", total).withColumn("best", F.array_max("total"))
    mass = F.aggregate(F.transform("total", lambda x: F.exp(x - F.col("best"))), F.lit(0.0), lambda a, b: a + b)
    names = F.array(*map(F.lit, languages))
    pick = lambda c: names[(F.array_position(c, F.array_max(c)) - 1).cast("int")]
    return scored.select("page_id", pick(F.col("total")).alias("lang"), (1 / mass).alias("confidence"), pick(F.col("ll")).alias("text_lang"), "declared", "host")


def op8_language(spark, sf_dir: str) -> DataFrame:
    languages, model = fit(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return identify(spark.read.parquet(f"{sf_dir}/pages.parquet"), languages, model)
