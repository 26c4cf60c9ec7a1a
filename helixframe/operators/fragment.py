"""Genomes cut into overlapping windows, and fragment ids read back."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

#: Windows that are cut from one piece of a contig.
PIECE = 1024
#: Letters that are counted at a time.
COUNT = 1 << 20


def _pieces(contigs: DataFrame, length: int, shift: int, keep: Sequence[str] = ()) -> DataFrame:
    """``genome, contig, *keep, lp, low, piece, first, last``: bytes of up to ``PIECE`` windows, from place ``low``; the padding is not in them."""
    n = F.greatest(F.lit(1), F.floor((F.col("len") - length + 2 * shift - 1) / shift)).cast("long")
    sized = contigs.withColumn("n", n).withColumn("cov", F.lit(length) + shift * (F.col("n") - 1))
    sized = sized.select("genome", "contig", *keep, F.col("seq").cast("binary").alias("seq"), "n", F.expr("(cov - len) div 2").alias("lp"))
    step = F.lit(PIECE).cast("long")
    pieces = sized.withColumn("first", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, step)))
    low = F.greatest(F.lit(0), F.col("first") * shift - F.col("lp"))
    cut = F.substring("seq", (low + 1).cast("int"), F.lit(PIECE * shift + length))
    last = F.least(F.col("first") + step, F.col("n")) - 1
    return pieces.select("genome", "contig", *keep, "lp", low.alias("low"), cut.alias("piece"), "first", last.alias("last"))


def fragment(contigs: DataFrame, length: int = 250, shift: int = 50) -> DataFrame:
    """``genome, contig, frag_id, start, end, seq``: windows that cover each contig.

    The contig is padded with N on both sides to what the windows cover, so starts may be negative.
    Contigs are handled as bytes and in pieces of ``PIECE`` windows, so that work is linear in them.
    """
    each = _pieces(contigs, length, shift).select("genome", "contig", "lp", "low", "piece", F.explode(F.sequence("first", "last")).alias("frag_id"))
    at = F.col("frag_id") * shift - F.col("lp")
    before = F.greatest(F.lit(0), -at).cast("int")
    inside = F.substring("piece", (F.greatest(F.lit(0), at) - F.col("low") + 1).cast("int"), F.lit(length) - before).cast("string")
    return each.select(
        "genome", "contig", "frag_id", at.alias("start"), (at + length).alias("end"),
        F.rpad(F.concat(F.repeat(F.lit("N"), before), inside), length, "N").alias("seq"),
    )


def fragment_counts(contigs: DataFrame, letters: str, length: int = 250, shift: int = 50) -> DataFrame:
    """``genome, contig, frag_id, start, end, n``: how many of ``letters`` each window of ``fragment`` has.

    Letters are counted once along each piece of a contig, and a window's count is the difference of two
    places, so windows that overlap are never spelled out.  The padding is N, so N cannot be counted.
    """
    if "N" in letters:
        raise ValueError("N is the padding")
    counted = np.zeros(256, np.int64)
    counted[list(letters.encode("ascii"))] = 1
    pieces = _pieces(contigs, length, shift)
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in pieces.select("genome", "contig").schema)
    kept = list(to_arrow_schema(pieces.select("genome", "contig").schema))
    schema = pa.schema([*kept, *((c, pa.int64()) for c in ("frag_id", "start", "end", "n"))])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = pc.fill_null(pc.binary_length(batch.column("piece")), 0).to_numpy().astype(np.int64)
            ends, at = np.cumsum(sizes), 0
            while at < batch.num_rows:
                to = max(int(np.searchsorted(ends, ends[at] - sizes[at] + COUNT)), at + 1)
                yield some(batch.slice(at, to - at), sizes[at:to])
                at = to

    def some(batch: pa.RecordBatch, sizes: np.ndarray) -> pa.RecordBatch:
        bytes_ = np.frombuffer(b"".join(x or b"" for x in batch.column("piece").to_pylist()), np.uint8)
        so_far = np.append(0, np.cumsum(counted[bytes_]))
        lp, low, first, last = (batch.column(c).fill_null(0).to_numpy() for c in ("lp", "low", "first", "last"))
        n = last - first + 1
        row = np.repeat(np.arange(len(n)), n)
        frag = np.arange(len(row)) - np.repeat(np.cumsum(n) - n - first, n)
        start = frag * shift - lp[row]
        edge, size = (np.cumsum(sizes) - sizes)[row], sizes[row]
        inside = lambda place: so_far[edge + np.clip(place - low[row], 0, size)]
        known = pc.and_(batch.column("lp").is_valid(), batch.column("piece").is_valid()).to_numpy(zero_copy_only=False)
        columns = [start, start + length, inside(start + length) - inside(start)]
        own = [batch.column(i).take(pa.array(row)).cast(f.type) for i, f in enumerate(kept)]
        return pa.RecordBatch.from_arrays([*own, pa.array(frag), *(pa.array(c, mask=~known[row]) for c in columns)], schema=schema)

    return pieces.mapInArrow(count, f"{fields}, frag_id long, start long, end long, n long")


def fragment_id(contig: Column, start: Column, end: Column) -> Column:
    return F.concat(contig, F.lit(":"), start, F.lit(".."), end)


def parse_fragment_id(df: DataFrame, frag: str, length: str) -> DataFrame:
    """Adds ``p_contig, p_start, p_end`` of ``contig:start..end``, clipped to ``[0, length)``."""
    parts = [F.regexp_extract(frag, r"^(.*):(-?\d+)\.\.(-?\d+)$", i) for i in (1, 2, 3)]
    return df.withColumns({
        "p_contig": parts[0],
        "p_start": F.greatest(parts[1].cast("long"), F.lit(0)),
        "p_end": F.least(parts[2].cast("long"), F.col(length)),
    })
