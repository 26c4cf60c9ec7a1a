"""The sequence tables that queries run on, derived from the given tables, in Spark and in SQL."""

from __future__ import annotations

import string

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..operators.fragment import fragment, fragment_counts
from ..operators.store import dealt

ALPHA = string.ascii_uppercase + string.ascii_lowercase + "-"
CODE = ("ACGT" * 7)[:26] * 2 + "N"
LENGTH, SHIFT = 250, 50
#: Score thresholds of the queries: the scores are base shares, with many ties.
T, CONF = 0.5, 0.55


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_BASE_OF = bytearray(b"N" * 256)
for _letter, _base in zip(ALPHA, CODE, strict=True):
    _BASE_OF[ord(_letter)] = ord(_base)


def spell(texts: pa.Array) -> pa.Array:
    """Bases of texts, a letter a character: all texts' bytes are translated at once, and bytes within a character dropped."""
    texts = pa.concat_arrays([texts.cast(pa.string())])  # from its own first byte
    _, offsets, data = texts.buffers()
    edge = np.frombuffer(offsets, np.int32, len(texts) + 1, texts.offset * 4).astype(np.int64)
    raw = np.frombuffer(data, np.uint8, edge[-1] - edge[0], edge[0]) if edge[-1] > edge[0] else np.empty(0, np.uint8)
    edge = edge - edge[0]
    if raw.size and raw.max() > 127:
        within = (raw & 0xC0) == 0x80
        edge = edge - np.append(0, np.cumsum(within))[edge]
    letters = raw.tobytes().translate(bytes(_BASE_OF), _WITHIN)
    nulls = pa.py_buffer(np.packbits(texts.is_valid().to_numpy(zero_copy_only=False), bitorder="little").tobytes()) if texts.null_count else None
    return pa.Array.from_buffers(pa.string(), len(texts), [nulls, pa.py_buffer(edge.astype(np.int32).tobytes()), pa.py_buffer(letters)], texts.null_count)


#: Bytes of a UTF-8 character beyond its first.
_WITHIN = bytes(range(0x80, 0xC0))
_spelled = F.arrow_udf(spell, StringType())


def contigs(spark: SparkSession, sf_dir: str, of: DataFrame | None = None) -> DataFrame:
    """``genome, contig, seq, len``; those of ``of (contig, ...)`` alone, with its columns, if it is given: others are not spelled."""
    docs, kept = table(spark, sf_dir, "documents").select("source", F.col("doc_id").alias("contig"), "text"), []
    if of is not None:
        docs, kept = dealt(docs, "contig").join(of, "contig"), [c for c in of.columns if c != "contig"]
    # the length is the text's own, so that what needs no bases spells none
    return docs.select(F.col("source").alias("genome"), "contig", _spelled("text").alias("seq"), F.length("text").cast("long").alias("len"), *kept)


def fragments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fragment(contigs(spark, sf_dir), LENGTH, SHIFT)


def fragment_shares(spark: SparkSession, sf_dir: str, letters: str) -> DataFrame:
    """Fragments without their texts, with the share ``p`` of ``letters`` in each."""
    counts = fragment_counts(contigs(spark, sf_dir), letters, LENGTH, SHIFT)
    return counts.select("genome", "contig", "start", "end", (F.col("n") / F.lit(float(LENGTH))).alias("p"))


def reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fragments(spark, sf_dir).selectExpr(
        "contig * 100000 + frag_id as read_id", "genome", "contig", "seq"
    )


def base_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = [f"length(seq) - length(replace(seq, '{b}', '')) as {b.lower()}" for b in "ACGT"]
    return reads(spark, sf_dir).selectExpr("read_id", "genome", "contig", *counts)


_MODELS = "(a + c + g + t) * 4 >= 750"
#: Bases whose share is a model's score.
SHARES = {"ac": "a + c", "ag": "a + g", "gc": "g + c"}


def scores(spark: SparkSession, sf_dir: str, models: tuple[str, ...] = tuple(SHARES)) -> DataFrame:
    """``read_id, genome, contig, model, p``: base shares as scores, null where over a quarter is N."""
    by_model = f"stack({len(models)}, " + ", ".join(f"'{m}', {SHARES[m]}" for m in models) + ") as (model, k)"
    return (
        base_counts(spark, sf_dir)
        .selectExpr("read_id", "genome", "contig", f"{_MODELS} as known", by_model)
        .selectExpr("read_id", "genome", "contig", "model", "case when known then k / 250.0D end as p")
    )


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "labels").selectExpr("doc_id as contig", "quality as label", "quality * 2 + toxic as label4")


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scores(spark, sf_dir).join(labels(spark, sf_dir), "contig")


def features(spark: SparkSession, sf_dir: str, lengths: DataFrame | None = None) -> DataFrame:
    """Three features a contig; ``lengths (genome, contig, len)`` may be given, else they are the texts'."""
    long_enough = (contigs(spark, sf_dir) if lengths is None else lengths).where("len > 0").selectExpr("genome", "contig", "len", "explode(array(0L, 1L, 2L)) as k")
    return long_enough.selectExpr(
        "genome", "contig", "element_at(array('gene', 'CDS', 'tRNA'), cast(k + 1 as int)) as type",
        "(contig * 37 + k * 101) % len as start", "least((contig * 37 + k * 101) % len + 60 + 20 * k, len) as end",
        "concat('G', contig % 7) as gene", "concat('P', contig % 5) as product", "concat('I', contig) as id",
    )


SQL = {
    "contigs": f"contigs AS (SELECT *, length(seq) AS len FROM (SELECT source AS genome, doc_id AS contig, translate(regexp_replace(text, '[^A-Za-z]', '-', 'g'), '{ALPHA}', '{CODE}') AS seq FROM documents))",
    "fragments": f"""fragments AS (SELECT genome, contig, i AS frag_id, i * {SHIFT} - lp AS start, i * {SHIFT} - lp + {LENGTH} AS "end",
        substring(repeat('N', lp) || seq || repeat('N', cov - len - lp), i * {SHIFT} + 1, {LENGTH}) AS seq
        FROM (SELECT *, unnest(range(n)) AS i FROM (SELECT *, (cov - len) // 2 AS lp FROM (SELECT *, {LENGTH} + {SHIFT} * (n - 1) AS cov
        FROM (SELECT *, greatest(1, (len - {LENGTH} + 2 * {SHIFT} - 1) // {SHIFT}) AS n FROM contigs)))))""",
    "reads": "reads AS (SELECT contig * 100000 + frag_id AS read_id, genome, contig, seq FROM fragments)",
    "base_counts": "base_counts AS (SELECT read_id, genome, contig, "
    + ", ".join(f"length(seq) - length(replace(seq, '{b}', '')) AS {b.lower()}" for b in "ACGT")
    + " FROM reads)",
    "scores": f"""scores AS (SELECT read_id, genome, contig, m AS model, CASE WHEN {_MODELS} THEN
        (CASE m WHEN 'ac' THEN a + c WHEN 'ag' THEN a + g ELSE g + c END) / 250.0::DOUBLE END AS p
        FROM base_counts CROSS JOIN (SELECT unnest(['ac', 'ag', 'gc']) AS m))""",
    "lab": "lab AS (SELECT doc_id AS contig, quality AS label, quality * 2 + toxic AS label4 FROM labels)",
    "labelled": "labelled AS (SELECT s.*, label, label4 FROM scores s JOIN lab USING (contig))",
    "features": """features AS (SELECT genome, contig, ['gene', 'CDS', 'tRNA'][k + 1] AS type, (contig * 37 + k * 101) % len AS start,
        least((contig * 37 + k * 101) % len + 60 + 20 * k, len) AS "end", 'G' || (contig % 7) AS gene, 'P' || (contig % 5) AS product, 'I' || contig AS id
        FROM (SELECT *, unnest([0, 1, 2]) AS k FROM contigs WHERE len > 0))""",
}
_ORDER = list(SQL)


def with_tables(*names: str) -> str:
    """``WITH`` clause of the named tables and those they build on."""
    needs = {"fragments": ["contigs"], "reads": ["fragments"], "base_counts": ["reads"], "scores": ["base_counts"], "labelled": ["scores", "lab"], "features": ["contigs"]}
    wanted, todo = set(), list(names)
    while todo:
        if (n := todo.pop()) not in wanted:
            wanted.add(n)
            todo += needs.get(n, [])
    return "WITH RECURSIVE " + ", ".join(SQL[n] for n in _ORDER if n in wanted)
