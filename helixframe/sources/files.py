"""Readers and writers of sequence, annotation and score files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.store import dealt
from ..operators.windows import running_sums

GFF = "seqid string, source string, type string, start long, end long, score string, strand string, phase string, attrs string"
HITS6 = "query string, subject string, pident double, length int, mismatch int, gapopen int, qstart int, qend int, sstart int, send int, evalue double, bitscore double"


def _records(spark: SparkSession, path: str) -> DataFrame:
    """``title, body, file`` of records that start with ``>`` at the start of a line."""
    raw = spark.read.option("lineSep", "\n>").text(path).select("value", F.input_file_name().alias("file"))
    clean = F.regexp_replace(F.regexp_replace("value", "\r", ""), "^>|\n+$", "")
    parts = F.split(clean, "\n", 2)
    return raw.where(F.trim("value") != "").select(F.element_at(parts, 1).alias("title"), F.try_element_at(parts, F.lit(2)).alias("body"), "file")


def read_fasta(spark: SparkSession, path: str, name: str = "") -> DataFrame:
    """``read_id, set, title, seq``; ids are unique and rise within a file."""
    seq = F.coalesce(F.regexp_replace("body", r"\s", ""), F.lit(""))
    return _records(spark, path).select(F.monotonically_increasing_id().alias("read_id"), F.lit(name).alias("set"), "title", seq.alias("seq"))


def read_fastq(spark: SparkSession, path: str, min_len: int = 0, start: int = 0, end: int | None = None) -> DataFrame:
    """``title, seq`` of four-line records, from splits of any size.

    Files are cut before each ``@`` at a line's start.  That is a record's start or, as quality may
    begin with it, the rest of a quality line, which has no third line with a plus.
    """
    raw = spark.read.option("lineSep", "\n@").text(path)
    lines = F.split(F.regexp_replace("value", "\r", ""), "\n")
    kept = raw.select(lines.alias("lines")).where((F.size("lines") > 2) & F.try_element_at("lines", F.lit(3)).startswith("+"))
    found = kept.select(F.regexp_replace(F.element_at("lines", 1), "^@", "").alias("title"), F.element_at("lines", 2).alias("seq"))
    return found.where(F.length("seq") >= min_len).withColumn("seq", F.substring("seq", start + 1, (end if end is not None else 1 << 30) - start))


def read_gff3(spark: SparkSession, path: str) -> DataFrame:
    """Features with 0-based half-open ``start0, end`` and the attribute map."""
    rows = spark.read.schema(GFF).csv(path, sep="\t", comment="#")
    attrs = F.when(F.col("attrs") != ".", F.expr("str_to_map(attrs, ';', '=')"))
    return rows.withColumns({"start0": F.col("start") - 1, "attrs": attrs}).drop("start")


def contig_lengths(features: DataFrame, end: str = "end") -> DataFrame:
    regions = features.where(F.col("source").rlike("Genbank|RefSeq") & (F.col("type") == "region"))
    return regions.select(F.col("seqid").alias("contig"), F.col(end).alias("len"))


def read_scores(spark: SparkSession, path: str) -> DataFrame:
    """Parquet scores with undefined ones as null."""
    df = spark.read.parquet(path)
    return df.withColumn("p", F.when(~F.isnan("p"), F.col("p"))) if dict(df.dtypes)["p"] in ("double", "float") else df


def read_contribs(spark: SparkSession, path: str, filter_id: str) -> DataFrame:
    """``filter_id, read_id, hits`` of three-line records: id, positions, scores (may be blank)."""
    lines = F.split(F.col("body"), "\n")
    numbers = lambda i, t: F.filter(F.split(F.coalesce(F.try_element_at(lines, F.lit(i)), F.lit("")), r"[,\s]+"), lambda x: x != "").cast(f"array<{t}>")
    rows = _records(spark, path).select(F.col("title").alias("read_id"), numbers(1, "int").alias("pos"), numbers(2, "double").alias("score"))
    return rows.where(F.size("score") > 0).select(F.lit(filter_id).alias("filter_id"), "read_id", F.arrays_zip("pos", "score").alias("hits"))


def _dmp(spark: SparkSession, path: str, names: list[str]) -> DataFrame:
    parts = F.split(F.regexp_replace("value", r"\t\|$", ""), r"\t\|\t")
    return spark.read.text(path).select(*(F.trim(parts[i]).alias(n) for i, n in enumerate(names)))


def read_taxdump(spark: SparkSession, nodes: str, names: str, merged: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``nodes (taxid, parent, rank)``, one name a taxid with the scientific one first, ``merged``."""
    tree = _dmp(spark, nodes, ["taxid", "parent", "rank"]).selectExpr("cast(taxid as long) taxid", "cast(parent as long) parent", "rank")
    called = _dmp(spark, names, ["taxid", "name", "unique", "kind"]).selectExpr("cast(taxid as long) taxid", "name", "kind")
    moved = _dmp(spark, merged, ["old", "new"]).selectExpr("cast(old as long) old", "cast(new as long) new")
    return tree, one_name(called), moved


def one_name(names: DataFrame) -> DataFrame:
    w = Window.partitionBy("taxid").orderBy((F.col("kind") != "scientific name"), "name")
    return names.withColumn("__r", F.row_number().over(w)).where("__r = 1").select("taxid", "name")


def read_hits6(spark: SparkSession, path: str) -> DataFrame:
    """Twelve-column hits with ``file, block, line_no``, by which lines have the file's order."""
    rows = spark.read.schema(HITS6).csv(path, sep="\t")
    return rows.select("*", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line_no"))


def first_hit(hits: DataFrame, query: str = "query", order: tuple[str, ...] = ("file", "block", "line_no")) -> DataFrame:
    w = Window.partitionBy(query).orderBy(*order)
    return dealt(hits, query).withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r")


def with_slices(df: DataFrame, n: int, order: str) -> DataFrame:
    """``slice`` from 0: contiguous by the numeric ``order`` and equal to within one row.

    Row numbers come from ranges of ``order`` and their counts, so no task sees all rows.
    """
    placed = running_sums(df.withColumn("__one", F.lit(1)), [], order, {"__row": "__one"})
    big, small, row = F.col("__row_all") % n, F.floor(F.col("__row_all") / n), F.col("__row") - 1
    cut = big * (small + 1)
    at = F.when(row < cut, F.floor(row / (small + 1))).otherwise(big + F.floor((row - cut) / F.greatest(small, F.lit(1))))
    return placed.withColumn("slice", at.cast("int")).drop("__one", "__row", "__row_all")


def write_slices(df: DataFrame, path: str, n: int, order: str) -> None:
    with_slices(df, n, order).write.partitionBy("slice").parquet(path)


def score_header(title: Column, p: Column, std: Column | None = None, digits: int = 3) -> Column:
    """``title | pp=0.123 +/- 0.004``; array scores are joined by ``; ``, a null std is left out."""
    one = lambda x: F.format_string(f"%.{digits}f", x)
    text = F.concat(title, F.lit(" | pp="), one(p))
    return text if std is None else F.concat(text, F.when(std.isNotNull(), F.concat(F.lit(" +/- "), one(std))).otherwise(""))


def score_header_multi(title: Column, p: Column, digits: int = 3) -> Column:
    return F.concat(title, F.lit(" | pp="), F.array_join(F.transform(p, lambda x: F.format_string(f"%.{digits}f", x)), "; "))


def write_fasta(df: DataFrame, path: str, header: Column) -> None:
    df.select(F.concat(F.lit(">"), header, F.lit("\n"), F.col("seq"))).write.text(path)


def write_bed(df: DataFrame, path: str, columns: list[str]) -> None:
    """Tab-separated rows, sorted by contig and start over the files' order."""
    df.repartitionByRange("contig", "start").sortWithinPartitions("contig", "start").select(*columns).write.csv(path, sep="\t")


#: Letters of the full nucleotide alphabet, in the order of the matrix columns.
IUPAC = "ACGTRYKMSWBDHVN"


def transfac_text(matrix: DataFrame, letters: str = "ACGT") -> DataFrame:
    """``filter_id, text``: each count matrix ``(filter_id, pos, base, cnt)`` in TRANSFAC form."""
    wide = matrix.groupBy("filter_id", "pos").pivot("base", list(letters)).agg(F.first("cnt"))
    row = F.concat_ws("\t", F.format_string("%02d", F.col("pos") + 1), *(F.format_string("%.2f", F.coalesce(F.col(b), F.lit(0.0))) for b in letters))
    rows = wide.groupBy("filter_id").agg(F.array_sort(F.collect_list(F.struct("pos", row.alias("line")))).alias("rows"))
    name = F.col("filter_id").cast("string")
    head = F.concat(F.lit("AC\t"), name, F.lit("\nXX\nID\t"), name, F.lit("\nXX\nPO\t" + "\t".join(letters) + "\n"))
    return rows.select("filter_id", F.concat(head, F.array_join(F.transform("rows", lambda r: r["line"]), "\n"), F.lit("\nXX\n//")).alias("text"))


def write_transfac(matrix: DataFrame, path: str, letters: str = "ACGT") -> None:
    transfac_text(matrix, letters).select("text").write.text(path)
