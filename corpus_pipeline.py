"""A training-corpus pipeline of five stages, each applying one operator to what is left.

Null texts count as empty, null ids are ids of their own, and an empty text is a document like any
other: it is scored, may be a near copy of other empty texts, has no words or secrets, and packs as
its end id alone.  Repeated rows are near copies of each other, of which one stays; of near copies
the row of the least id stays, nulls last.  Texts are handled whole, however long.  All stages but
the last keep the columns of their input, whatever their names, in order, and an empty table gives
an empty result with the same columns.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from helixframe.llm import decontamination, near_dedup, packing, secrets, toxicity
from helixframe.llm._shared import materialise

MASK = "<secret>"


def packed(docs: DataFrame) -> DataFrame:
    """``doc_id, text`` and all other columns in ``row``, where no name can clash."""
    rest = [c for c in docs.columns if c not in ("doc_id", "text")]
    return docs.select("doc_id", "text", F.struct(*(F.col(f"`{c}`") for c in rest)).alias("row") if rest else F.lit(0).alias("row"))


def unpacked(df: DataFrame, names: list[str]) -> DataFrame:
    return df.select(*(c if c in ("doc_id", "text") else F.col("row").getField(c).alias(c) for c in names))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier scores under one half."""
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = toxicity.score(packed(docs), model, "text", "row")
    return unpacked(scored.where("score < 0.5"), docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group."""
    return near_dedup.keep_one(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any benchmark window; a row is known by a hash of its id and text."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    key = F.xxhash64("doc_id", "text").alias("doc_id")
    found = decontamination.matches(docs.select(key, "text"), benchmark)
    hit = found.where(F.size("hits") > 0).select("doc_id").distinct()
    return docs.select(key, F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")).join(hit, "doc_id", "left_anti").select("row.*")


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with found secrets masked and ``n_chars`` counted again where any was."""
    ledger = secrets.new_ledger(spark)
    secrets.scan_unseen(docs, ledger)
    found = secrets.findings(packed(docs), ledger, secrets.RULES, "text", "row")
    kept = ["doc_id", "text", "row", "masked"]

    def mask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for i, spans in enumerate(batch.column("spans").to_pylist()):
                if spans:
                    out, at = [], 0
                    for s in sorted(spans, key=lambda s: (s["start"], s["end"])):
                        if s["start"] >= at:
                            out += [texts[i][at : s["start"]], MASK]
                        at = max(at, s["end"])
                    texts[i] = "".join([*out, texts[i][at:]])
            columns = [pa.array(texts, pa.string()) if c == "text" else batch.column(c) for c in kept]
            yield pa.RecordBatch.from_arrays(columns, names=kept)

    with_flag = found.withColumn("masked", F.size("spans") > 0)
    masked = with_flag.mapInArrow(mask, StructType([with_flag.schema[c] for c in kept]))
    out = unpacked(masked, docs.columns)
    if "n_chars" in docs.columns:
        n_chars = F.when(F.col("masked"), F.length("text")).otherwise(F.col("row.n_chars")).cast(docs.schema["n_chars"].dataType)
        out = unpacked(masked.withColumn("row", F.col("row").withField("n_chars", n_chars)), docs.columns)
    return out


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of the documents, placed in sequences."""
    return packing.pack(docs).select(
        "doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"), "sequence_id", "offset"
    )


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("simhash near-dedup", drop_near_copies),
    ("benchmark decontamination", drop_contaminated),
    ("secret scans", mask_secrets),
    ("best-fit packing", pack_sequences),
]

#: No SQL states a trained classifier or a tokenizer; tests hold stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), "stage")
    return STAGES[-1][1](spark, docs, sf_dir)
