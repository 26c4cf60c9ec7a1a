"""Scalar functions of sequences, scores and names, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def one_hot(seq: Column, length: int) -> Column:
    """One (A, C, G, T) array per base; other letters and padding give zeros."""
    bases = F.split(F.rpad(seq, length, "N"), "")
    return F.transform(F.slice(bases, 1, length), lambda b: F.array(*((F.upper(b) == x).cast("int") for x in "ACGT")))


def flatten_one_hot(encoded: Column) -> Column:
    return F.flatten(encoded)


def one_hot_text(seq: Column, length: int, codes: tuple[str, ...] = ("1000", "0100", "0010", "0001"), other: str = "0000") -> Column:
    """``one_hot`` as text: the ``codes`` of A, C, G and T one after the other, ``other`` for the rest.

    Letters are replaced in the whole text, so no array is made of a base; codes have none of the letters.
    """
    if any(b in code for code in (*codes, other) for b in "ACGTN"):
        raise ValueError("codes may not hold letters of bases")
    known = F.translate(F.rpad(seq, length, "N"), "acgt", "ACGT")
    known = F.when(known.rlike("[^ACGTN]"), F.regexp_replace(known, "[^ACGT]", "N")).otherwise(known)
    for base, code in zip("ACGTN", (*codes, other), strict=True):
        known = F.replace(known, F.lit(base), F.lit(code))
    return known


def fit_length(df: DataFrame, length: int, trim: bool = False, seq: str = "seq") -> DataFrame:
    """Pad to ``length``; longer reads are trimmed or raise when evaluated."""
    fitted = F.rpad(seq, length, "N")
    if not trim:
        too_long = F.raise_error(F.lit(f"a read is longer than {length}")).cast("string")
        fitted = F.when(F.length(seq) > length, too_long).otherwise(fitted)
    return df.withColumn(seq, fitted)


def revcomp(seq: Column, length: int | None = None) -> Column:
    """Reverse complement, of the padded read if ``length`` is given."""
    return F.translate(F.reverse(F.rpad(seq, length, "N") if length else seq), "ACGT", "TGCA")


def subreads(df: DataFrame, ks: list[int], seq: str = "seq") -> DataFrame:
    """One row for each prefix length, with ``k`` and the prefix."""
    return df.withColumn("k", F.explode(F.array(*map(F.lit, ks)))).withColumn(seq, F.expr(f"left({seq}, k)"))


def largest_read(df: DataFrame, by: str, seq: str = "seq") -> DataFrame:
    """``by, n, seq``: how many reads each group has, and the largest.

    Its prefix of any length is the largest prefix of that length, so prefixes are cut from one read a
    group.  The set of lengths keeps groups in hash tables: a plain maximum of texts would sort all reads.
    """
    found = df.groupBy(by).agg(F.count("*").alias("n"), F.max(seq).alias(seq), F.collect_set(F.length(seq)).alias("__lengths"))
    return found.where(F.size("__lengths") >= 0).drop("__lengths")


def random_subread(df: DataFrame, lo: int, hi: int, seed: int = 0, seq: str = "seq") -> DataFrame:
    """A prefix of uniform length in ``[lo, hi]``, by an md5 of read_id and seed and so repeatable."""
    drawn = F.conv(F.substring(F.md5(F.concat(F.col("read_id").cast("string"), F.lit(f"|{seed}"))), 1, 8), 16, 10).cast("long")
    k = (F.lit(lo) + drawn % (hi - lo + 1)).cast("int")
    return df.withColumn("k", k).withColumn(seq, F.expr(f"left({seq}, k)"))


def slice_reads(df: DataFrame, start: int, end: int, min_len: int = 0, seq: str = "seq") -> DataFrame:
    return df.where(F.length(seq) >= min_len).withColumn(seq, F.substring(seq, start + 1, end - start))


def sigmoid(z: Column) -> Column:
    return 1 / (1 + F.exp(-z))


def softmax(z: Column) -> Column:
    raised = F.transform(z, lambda x: F.exp(x - F.array_max(z)))
    return F.transform(raised, lambda x: x / F.aggregate(raised, F.lit(0.0), lambda a, b: a + b))


def signif(x: Column, digits: int = 4) -> Column:
    scale = F.pow(F.lit(10.0), F.lit(digits - 1) - F.floor(F.log10(F.abs(x))))
    return F.when(x == 0, F.lit(0.0)).otherwise(F.round(x * scale) / scale)


def accession(text: Column) -> Column:
    """First assembly accession or project id of a text, null if there is none."""
    return F.nullif(F.regexp_extract(text, r"(GCA_\d{9}\.\d|PRJ[A-Z]{2}\d+)", 1), F.lit(""))


def asm_url(path: Column, ext: str) -> Column:
    return F.concat(path, F.lit("/"), F.element_at(F.split(path, "/"), -1), F.lit(ext))


#: Marks of names that are no species.
NOT_SPECIES = ("sp.", "cf.", "aff.", " x ", "uncultured", "virus", "complex")


def species_names(df: DataFrame, name: str = "name", marks: tuple[str, ...] = NOT_SPECIES, keep: tuple[str, ...] = (" var. ", " f. sp. ")) -> DataFrame:
    """Drop marked names and those of more than two words, except where ``keep`` occurs."""
    marked, kept = F.lit(False), F.lit(False)
    for m in marks:
        marked = marked | F.col(name).contains(m)
    for k in keep:
        kept = kept | F.col(name).contains(k)
    return df.where(kept | (~marked & (F.size(F.split(name, " ")) <= 2)))


def clean_names(df: DataFrame, typos: DataFrame, name: str = "name") -> DataFrame:
    """Strip brackets and ``(nom. ...)``, squeeze spaces, then map ``typos (wrong, right)``."""
    bare = F.regexp_replace(F.regexp_replace(name, r"\(nom\.[^)]*\)", ""), r"[\[\]]", "")
    cleaned = df.withColumn(name, F.trim(F.regexp_replace(bare, " +", " ")))
    mapped = cleaned.join(typos, cleaned[name] == typos["wrong"], "left")
    return mapped.withColumn(name, F.coalesce("right", name)).drop("wrong", "right")


def append_strains(df: DataFrame, name: str = "name", strain: str = "strain") -> DataFrame:
    """Add the strain's tokens that the name lacks (in any case)."""
    fresh = F.filter(F.split(strain, " "), lambda t: (t != "") & ~F.lower(F.col(name)).contains(F.lower(t)))
    return df.withColumn(name, F.concat_ws(" ", F.col(name), F.when(F.size(fresh) > 0, F.array_join(fresh, " "))))
