"""Genome maps, feature scores and enrichment over half-open intervals."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema, to_arrow_type

from ..functions.seq import signif
from .joins import overlap
from .store import dealt, ranged, running, same, stored

DIGITS = 12
#: Scores are added up as whole numbers: what is before the point, and twice so many bits behind it.
PARTS = ("whole", "high", "low")
PART_BITS = 31
#: Scores beyond this are no scores.
LARGEST = 2.0**62


#: log2 of the places of a contig that one task sweeps.
SWEEP_BITS = 20


#: log2 of the places whose changes travel as one row.
CHUNK_BITS = 10
#: Changes that are swept at a time.
SWEPT = 1 << 20


def gather(batches: Iterator[pa.RecordBatch], bits: int) -> Iterator[tuple]:
    """Contigs' changes of fragments ``genome, contig, start, end, p``, added up by place: a row a batch and chunk of places.

    A score is three whole numbers, which add up without rounding: what is before the point, and twice
    ``PART_BITS`` bits behind it.  Fragments without a finite score change nothing.
    """
    chunk_bits = min(bits, CHUNK_BITS)
    for batch in batches:
        p = batch.column("p").to_numpy(zero_copy_only=False)
        counted = np.abs(p) < LARGEST
        batch, p = batch.filter(pa.array(counted)), p[counted]
        if not batch.num_rows:
            continue
        whole = np.floor(p)
        behind = (p - whole) * 2.0**PART_BITS
        high = np.floor(behind)
        parts = [x.astype(np.int64) for x in (whole, high, np.floor((behind - high) * 2.0**PART_BITS), np.ones(len(p)))]
        code = [batch.column(c).dictionary_encode().indices.to_numpy().astype(np.int64) for c in ("genome", "contig")]
        code = np.tile(code[0] * (code[1].max() + 1) + code[1], 2)
        place = np.concatenate([batch.column("start").to_numpy(), batch.column("end").to_numpy()])
        order = np.lexsort((place, code))
        row, code, place = (order % len(p)), code[order], place[order]
        fresh = np.ones(len(order), bool)
        fresh[1:] = (np.diff(code) != 0) | (np.diff(place) != 0)
        head = np.flatnonzero(fresh)
        sums = [np.add.reduceat(np.concatenate([x, -x])[order], head) for x in parts]
        row, code, place = row[head], code[head], place[head]
        opens = np.ones(len(head), bool)
        opens[1:] = (np.diff(code) != 0) | (np.diff(place >> chunk_bits) != 0)
        first = np.flatnonzero(opens)
        edge = pa.array(np.append(first, len(head)), pa.int32())
        own = batch.select(["genome", "contig"]).take(pa.array(row[first])).columns
        chunk = place[first] >> chunk_bits
        lists = [pa.ListArray.from_arrays(edge, pa.array(x)) for x in (place, *sums)]
        yield [*own, pa.array(chunk >> (bits - chunk_bits)), pa.array(chunk), pa.array(np.full(len(first), -1)), *lists]


def _slices(batch: pa.RecordBatch, column: str, limit: int) -> Iterator[pa.RecordBatch]:
    """Rows of ``batch`` whose lists in ``column`` have ``limit`` values together, or one row."""
    ends, at = np.cumsum(pc.list_value_length(batch.column(column)).to_numpy().astype(np.int64)), 0
    while at < batch.num_rows:
        to = max(int(np.searchsorted(ends, (ends[at - 1] if at else 0) + limit, "right")), at + 1)
        yield batch.slice(at, to - at)
        at = to


def sweep(batches: Iterator[pa.RecordBatch], bits: int, shift: float) -> Iterator[pa.RecordBatch]:
    """Runs of equal mean score of blocks, from their changes: ``genome, contig, block, start, end, score``.

    Rows come by contig and chunk.  Of what goes on in the next batch two rows are held, whatever the depth
    of cover: the last chunk with the sums up to it, and the last run.
    """
    key, sums = ["genome", "contig", "block"], [*PARTS, "depth"]
    chunk_bits = min(bits, CHUNK_BITS)

    def firsts(rows: pa.RecordBatch | pa.Table) -> np.ndarray:
        """Which rows have another key than the row before."""
        fresh = np.ones(rows.num_rows, bool)
        codes = [rows.column(c).dictionary_encode("encode").indices.to_numpy(zero_copy_only=False) for c in key]
        fresh[1:] = np.any([np.diff(c) != 0 for c in codes], axis=0)
        return fresh

    def segments(rows: pa.RecordBatch, final: bool) -> tuple[pa.RecordBatch, pa.RecordBatch | None]:
        opens = firsts(rows)
        group = (np.cumsum(opens) - 1)[np.repeat(np.arange(rows.num_rows), pc.list_value_length(rows.column("place")).to_numpy())]
        start = rows.column("place").flatten().to_numpy()
        order = np.lexsort((start, group))
        group, start = group[order], start[order]
        fresh = np.ones(len(order), bool)
        fresh[1:] = (np.diff(group) != 0) | (np.diff(start) != 0)
        at = np.flatnonzero(fresh)
        group, start = group[at], start[at]
        change = {c: np.add.reduceat(rows.column(c).flatten().to_numpy()[order], at) for c in sums}
        head = np.flatnonzero(np.diff(group, prepend=-1))
        size = np.diff(np.append(head, len(group)))
        total = {c: np.cumsum(x) for c, x in change.items()}
        # sums of other groups are taken off again
        total = {c: x - np.repeat(x[head] - change[c][head], size) for c, x in total.items()}
        first = np.flatnonzero(opens)
        length = np.maximum.reduceat(rows.column("len").to_numpy(), first)
        until = np.minimum(length, (rows.column("block").to_numpy()[first] + 1) << bits)[group]
        end = np.append(start[1:], 0)
        end[head + size - 1] = np.iinfo(np.int64).max
        n, left = len(group), None
        if not final:
            chunk = rows.column("chunk")[rows.num_rows - 1].as_py()
            low = chunk << chunk_bits
            n = head[-1] + int(np.searchsorted(start[head[-1] :], low))
            before = {c: x[n - 1] if n > head[-1] else 0 for c, x in total.items()}
            if n > head[-1]:
                end[n - 1] = low
            lists = [np.append(low, start[n:]), *(np.append(before[c], change[c][n:]) for c in sums)]
            own = rows.select([*key, "chunk"]).slice(rows.num_rows - 1).columns
            left = pa.RecordBatch.from_arrays([x.cast(f.type) for x, f in zip([*own, pa.array(length[-1:]), *(pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), pa.array(x)) for x in lists)], rows.schema, strict=True)], schema=rows.schema)
        end = np.minimum(end, until)[:n]
        start, group, depth = start[:n], group[:n], total["depth"][:n]
        mean = (total["whole"][:n] + (total["high"][:n] + total["low"][:n] * 2.0**-PART_BITS) * 2.0**-PART_BITS) / np.maximum(depth, 1)
        # half away from zero; beyond 2 ** 52 a double has no more digits
        far = mean * 10.0**DIGITS
        mean = np.where(np.abs(far) < 2.0**52, np.trunc(far + np.copysign(0.5, far)) / 10.0**DIGITS, mean)
        there = np.flatnonzero(start < end)
        keys = rows.select(key).take(pa.array(first[group[there]])).columns
        return pa.RecordBatch.from_arrays([*keys, pa.array(start[there]), pa.array(end[there]), pa.array((mean - shift)[there], mask=depth[there] <= 0)], names=[*key, "start", "end", "score"]), left

    def runs(rows: pa.RecordBatch) -> pa.RecordBatch:
        score, known = rows.column("score").fill_null(0.0).to_numpy(), rows.column("score").is_valid().to_numpy(zero_copy_only=False)
        fresh = firsts(rows)
        fresh[1:] |= (np.diff(score) != 0) | (known[1:] != known[:-1])
        head = np.flatnonzero(fresh)
        end = rows.column("end").to_numpy()[np.append(head[1:], rows.num_rows) - 1]
        rows = rows.take(pa.array(head))
        return pa.RecordBatch.from_arrays([pa.array(end) if c == "end" else rows.column(c) for c in rows.schema.names], schema=rows.schema)

    joined = lambda a, b: b if a is None else pa.Table.from_batches([a, b]).combine_chunks().to_batches()[0]
    held, run = None, None
    for part in (x for batch in batches for x in _slices(batch, "place", SWEPT)):
        part = pa.RecordBatch.from_arrays(part.columns, names=part.schema.names)
        some, held = segments(joined(held, part), False)
        if some.num_rows:
            some = runs(joined(run, some))
            run = some.slice(some.num_rows - 1)
            yield some.slice(0, some.num_rows - 1)
    if held is not None:
        some, _ = segments(held, True)
        if some.num_rows:
            run = runs(joined(run, some))
        if run is not None:
            yield run


def genome_map(scored: DataFrame, contigs: DataFrame, shift: float = 0.5, bits: int = SWEEP_BITS) -> DataFrame:
    """``genome, contig, start, end, score``: mean of covering scores less ``shift``, as runs.

    A sweep over fragment bounds: running sums of what starts and ends at each place give the covering
    scores, so the work does not grow with the depth of cover and bases are never spelled out.  Each task
    adds up its fragments' bounds by place before anything is shuffled, and a row has a chunk of places.
    Blocks of ``2 ** bits`` places are swept apart, each with what covers its first place, so a contig of
    any length spreads over tasks.  Runs are joined over blocks only where contigs have several.  Sums are
    of whole numbers, to 62 bits behind the point, so what was added is taken off exactly.  Fragments
    without a finite score change nothing, and ends beyond a contig's are not looked at.
    """
    key, sums = ["genome", "contig"], [*PARTS, "depth"]
    whole, zero = F.lit(1 << bits).cast("long"), F.lit(0).cast("long")
    chunks = bits - min(bits, CHUNK_BITS)
    lens = stored(contigs.where("len > 0").select(*key, F.col("len").cast("long").alias("len")), "lengths")
    long = lens.where(F.col("len") > whole).select(*key).distinct()
    several = not long.isEmpty()
    frags = scored.where("genome is not null and contig is not null").select(*key, F.greatest("start", F.lit(0)).cast("long").alias("start"), F.col("end").cast("long").alias("end"), F.col("p").cast("double").alias("p")).where("start < `end`")
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in frags.select(*key).schema)
    schema = pa.schema([*to_arrow_schema(frags.select(*key).schema), *((c, pa.int64()) for c in ("block", "chunk", "len")), *((c, pa.list_(pa.int64())) for c in ("place", *sums))])
    added = lambda batches: (pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(x, schema, strict=True)], schema=schema) for x in gather(batches, bits))
    changes = frags.mapInArrow(added, f"{fields}, block long, chunk long, len long, " + ", ".join(f"{c} array<long>" for c in ("place", *sums)))
    blocks = lens.withColumn("block", F.explode(F.sequence(zero, F.shiftright(F.col("len") - 1, bits))))
    at = lambda rows, values: rows.select(*key, "block", F.shiftleft("block", chunks).alias("chunk"), "len", F.array(F.col("block") * whole).alias("place"), *(F.array(v).alias(c) for c, v in zip(sums, values, strict=True)))
    edges = at(blocks, [zero] * len(sums))
    if several:
        changes = stored(changes, "changes")
        own = changes.unionByName(edges).join(long, key, "left_semi")
        totals = own.groupBy(*key, "block").agg(*(F.sum(F.aggregate(c, zero, lambda x, y: x + y)).alias(c) for c in sums))
        before = Window.partitionBy(*key).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
        totals = totals.select(*key, "block", F.lit(-1).cast("long").alias("len"), *(F.coalesce(F.sum(c).over(before), zero).alias(c) for c in sums))
        changes = changes.unionByName(at(totals, [F.col(c) for c in sums]))
    ordered = dealt(changes.unionByName(edges), *key, "block").sortWithinPartitions("contig", "genome", "chunk")
    runs = ordered.mapInArrow(lambda batches: sweep(batches, bits, shift), f"{fields}, block long, start long, end long, score double")
    if not several:
        return runs.drop("block")
    runs = stored(runs, "runs")
    touches = (F.col("start") % whole == 0) & (F.col("block") > 0) | (F.col("end") % whole == 0)
    contig = Window.partitionBy(*key).orderBy("start")
    edge = runs.where(touches).withColumn("last", F.lag(F.struct("end", "score")).over(contig))
    goes_on = F.col("last").isNotNull() & (F.col("last.end") == F.col("start")) & F.col("last.score").eqNullSafe(F.col("score"))
    edge = edge.withColumn("run", F.sum((~goes_on).cast("int")).over(contig)).groupBy(*key, "run").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.first("score").alias("score"))
    return runs.where(~touches).drop("block").unionByName(edge.drop("run"))


def genome_mean(intervals: DataFrame, shift: float = 0.5) -> DataFrame:
    size = F.col("end") - F.col("start")
    known = intervals.where("score is not null")
    return known.groupBy("genome").agg((F.sum(F.col("score") * size) / F.sum(size) + shift).alias("mean"))


#: Places of a contig whose per-base sums travel as one row.
NT_BLOCK = 1 << 10


def block_sums(contig: pa.Array, start: pa.Array, sums: pa.ListArray, counts: pa.ListArray) -> tuple:
    """Contigs, starts (null for null), sums and counts of rows of bases, added up within blocks of ``NT_BLOCK``.

    A count of -1 is a place that no row covers.  Rows without a start have one place, which is null.
    """
    code = contig.dictionary_encode("encode").indices.to_numpy(zero_copy_only=False).astype(np.int64)
    known, at = start.is_valid().to_numpy(zero_copy_only=False), start.fill_null(0).to_numpy()
    size = pc.list_value_length(sums).to_numpy().astype(np.int64)
    first = at // NT_BLOCK
    n = np.where(known, (at + size - 1) // NT_BLOCK, first) - first + 1
    row = np.repeat(np.arange(len(at)), n)
    block = first[row] + np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
    code, known = code[row], known[row]
    low = np.where(known, np.maximum(at[row], block * NT_BLOCK), 0)
    high = np.where(known, np.minimum((at + size)[row], (block + 1) * NT_BLOCK), 1)
    bases = np.where(known, high - low, size[row])
    order = np.lexsort((block, known, code))
    fresh = np.ones(len(order), bool)
    fresh[1:] = np.any([np.diff(x[order]) != 0 for x in (block, known, code)], axis=0)
    head, group = np.flatnonzero(fresh), np.empty(len(order), np.int64)
    group[order] = np.cumsum(fresh) - 1
    lowest = np.minimum.reduceat(low[order], head)
    edge = np.append(0, np.cumsum(np.maximum.reduceat(high[order], head) - lowest))
    to = edge[group] + low - lowest[group]
    slot = np.repeat(to - np.cumsum(bases) + bases, bases) + np.arange(bases.sum())
    if not known.all():
        slot = np.where(np.repeat(known, bases), slot, np.repeat(to, bases))
    count = counts.flatten().to_numpy()
    total = np.bincount(slot, sums.flatten().to_numpy(), edge[-1])
    often = np.bincount(slot, np.maximum(count, 0), edge[-1]).astype(np.int32)
    often[np.bincount(slot[count >= 0], minlength=edge[-1]) == 0] = -1
    edge = pa.array(edge, pa.int32())
    starts = pa.array(lowest, pa.int64(), mask=~known[order][head])
    return contig.take(pa.array(row[order][head])), starts, pa.ListArray.from_arrays(edge, pa.array(total)), pa.ListArray.from_arrays(edge, pa.array(often))


def nt_map(nuc_scores: DataFrame, scorer: Callable[[pa.Array], pa.ListArray] | None = None) -> DataFrame:
    """``contig, pos, score``: mean of per-base scores over fragments.

    Fragments have arrays ``score``, or letters ``seq`` of which ``scorer`` makes the arrays in the task.

    Each task adds up its fragments in blocks of places before anything is shuffled, so what travels is
    a sum and a count a base, as arrays, whatever the depth of cover; blocks of several tasks or batches
    are added up where they meet, and only there is a base a row.
    """
    values = F.col("score").cast("array<double>") if scorer is None else F.col("seq")
    rows = nuc_scores.select("contig", F.col("start").cast("long").alias("start"), values.alias("score"))
    kind = rows.schema["contig"].dataType
    own = to_arrow_type(kind)
    summed = pa.schema([("contig", own), ("start", pa.int64()), ("sums", pa.list_(pa.float64())), ("counts", pa.list_(pa.int32()))])
    flat = pa.schema([("contig", own), ("pos", pa.int64()), ("score", pa.float64())])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            each = batch.column("score") if scorer is None else scorer(batch.column("score"))
            some = pc.fill_null(pc.greater(pc.list_value_length(each), 0), False)
            batch, each = batch.filter(some), each.filter(some)
            if batch.num_rows:
                sizes = pc.list_value_length(each)
                edge = pa.array(np.append(0, np.cumsum(sizes.to_numpy())), pa.int32())
                values = each.flatten()
                counts = pa.ListArray.from_arrays(edge, values.is_valid().cast(pa.int32()))
                sums = pa.ListArray.from_arrays(edge, values.fill_null(0.0))
                yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(block_sums(batch.column("contig"), batch.column("start"), sums, counts), summed, strict=True)], schema=summed)

    def spelled(contig: pa.Array, start: pa.Array, sums: pa.ListArray, counts: pa.ListArray) -> pa.RecordBatch:
        size = pc.list_value_length(sums).to_numpy().astype(np.int64)
        row, count = np.repeat(np.arange(len(size)), size), counts.flatten().to_numpy()
        place = np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)
        pos = pc.add(start.take(pa.array(row)), pa.array(place))
        score = pa.array(sums.flatten().to_numpy() / np.maximum(count, 1), mask=count < 1)
        return pa.RecordBatch.from_arrays([contig.take(pa.array(row)).cast(own), pos, score], schema=flat).filter(pa.array(count >= 0))

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = pa.Table.from_batches([], summed)  # a batch's last block may go on in the next
        for batch in batches:
            if not batch.num_rows:
                continue
            batch = batch.select(summed.names).cast(summed)
            last = batch.slice(batch.num_rows - 1)
            block = lambda start: pc.floor(pc.divide(start.cast(pa.float64()), float(NT_BLOCK)))
            every = pa.concat_tables([held, pa.Table.from_batches([batch])]).combine_chunks().to_batches()[0]
            got = pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(block_sums(*every.columns), summed, strict=True)], schema=summed)
            same_as = lambda x, y: np.array([v == y for v in x.to_pylist()], bool)
            ends = same_as(got.column("contig"), last.column("contig")[0].as_py()) & same_as(block(got.column("start")), block(last.column("start"))[0].as_py())
            held = pa.Table.from_batches([got.filter(pa.array(ends))])
            yield spelled(*got.filter(pa.array(~ends)).columns)
        for batch in held.to_batches():
            yield spelled(*batch.columns)

    ddl = f"contig {kind.simpleString()}, start long, sums array<double>, counts array<int>"
    blocks = rows.mapInArrow(add, ddl).withColumn("block", F.floor(F.col("start") / NT_BLOCK))
    met = blocks.repartition("contig", "block").sortWithinPartitions("contig", "block")
    return met.mapInArrow(meet, f"contig {kind.simpleString()}, pos long, score double")


def merge_intervals(df: DataFrame, by: Sequence[str]) -> DataFrame:
    """Union of overlapping and touching intervals.

    A sweep over ranges of starts: an interval opens an island if it starts beyond every end before
    it, in its range or carried over from earlier ones, so one contig's intervals spread over tasks.
    """
    order = ["start", "end"]
    sweep = ranged(df.select(*by, *order).distinct(), by, order)
    opened = running(sweep, by, order, past=True, __top=("max", F.col("end")))
    fresh = F.coalesce((F.col("start") > F.col("__top")).cast("int"), F.lit(1))
    islands = running(opened.withColumn("__new", fresh), by, order, __island=("sum", F.col("__new")))
    return islands.groupBy(*by, "__island").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("__island")


def covered_bases(df: DataFrame, by: Sequence[str], within: Sequence[str]) -> DataFrame:
    return merge_intervals(df, by).groupBy(*within).agg(F.sum(F.col("end") - F.col("start")).alias("bases"))


def _keys(features: DataFrame, extended: bool):
    named = F.col("type").isin("rRNA", "tRNA", "tmRNA", "ncRNA")
    gene = F.coalesce(*(c for c in ("gene", "name", "id") if c in features.columns)) if extended else F.col("gene")
    cds = F.array(F.lit("CDS"), F.col("product")) if extended else F.array(F.lit("CDS"))
    return F.when(F.col("type") == "gene", F.array(gene)).when(F.col("type") == "CDS", cds).when(named, F.array(F.col("product")))


def feature_keys(features: DataFrame, extended: bool = False) -> DataFrame:
    """``genome, key``: genes, products and ``CDS``; extended, a gene without one goes by name, else id."""
    return features.select("genome", F.explode(F.array_compact(_keys(features, extended))).alias("key")).distinct()


def feature_members(features: DataFrame, keys: DataFrame) -> DataFrame:
    """``genome, key`` with each feature whose type, product, gene, name or id it is."""
    named = F.col("type").isin("CDS", "rRNA", "tRNA", "tmRNA", "ncRNA")
    spelled = [F.when(F.col("type") == "gene", F.col(c)) for c in ("gene", "name", "id") if c in features.columns]
    candidates = F.array_distinct(F.array_compact(F.array("type", F.when(named, F.col("product")), *spelled)))
    return features.withColumn("key", F.explode(candidates)).join(keys, ["genome", "key"])


def feature_scores(members: DataFrame, intervals: DataFrame) -> DataFrame:
    """``genome, key, score, bases``: overlap-weighted mean; null without overlap."""
    each = overlap(members.select("genome", "contig", "key", "start", "end"), intervals.where("score is not null").select("genome", "contig", "start", "end", "score"), ["genome", "contig"])
    means = each.groupBy("genome", "key").agg((F.sum(F.col("score") * F.col("ov")) / F.sum("ov")).alias("score"), F.sum("ov").alias("bases"))
    return members.select("genome", "key").distinct().join(means, ["genome", "key"], "left")


def rank_features(scores: DataFrame) -> DataFrame:
    w = Window.partitionBy("genome").orderBy(F.desc_nulls_last("score"), "key")
    return scores.withColumn("rank", F.row_number().over(w))


def rank_genomes(means: DataFrame) -> DataFrame:
    """One row a genome, ascending by mean score."""
    return means.withColumn("rank", F.row_number().over(Window.orderBy(F.asc_nulls_last("mean"), "genome")))


def project_hits(hits: DataFrame, motif_len: int) -> DataFrame:
    """Read-relative ``pos`` to genome coordinates; what ends before 0 is dropped."""
    start = F.col("pos") - (motif_len - 1) // 2 + F.col("read_start")
    placed = hits.withColumns({"start": start, "end": start + motif_len}).where("`end` > 0")
    return placed.withColumn("start", F.greatest("start", F.lit(0)))


def dedup_hits(hits: DataFrame) -> DataFrame:
    """Highest activation of each filter, strand and place, to 4 significant digits."""
    best = hits.where("activation > 0").groupBy("filter_id", "strand", "contig", "start", "end").agg(F.max("activation").alias("activation"))
    return best.withColumn("activation", signif(F.col("activation")))


def enrichment_table(hits: DataFrame, members: DataFrame, contigs: DataFrame, m: int = 15) -> DataFrame:
    """2 x 2 counts for each filter and feature key.

    Of ``2 (len + n + m n - 2 (m div 3) n)`` places within ``n`` merged features of ``len`` bases,
    ``a`` have a hit; a hit counts if a third of it lies within.
    """
    hits = stored(hits.select("genome", "contig", "filter_id", "start", "end"), "hits")
    merged = stored(merge_intervals(members.select("genome", "contig", "key", "start", "end"), ["genome", "contig", "key"]), "merged")
    places = merged.groupBy("key").agg(F.sum(F.col("end") - F.col("start")).alias("len"), F.count("*").alias("n"))
    places = places.withColumn("inside", 2 * (F.col("len") + F.col("n") + m * F.col("n") - 2 * (m // 3) * F.col("n")))
    total = contigs.agg(F.sum(F.greatest(2 * (F.col("len") - m + 1), F.lit(0))).alias("total"))
    within = overlap(hits, merged, ["genome", "contig"], (1, 3), tables=True).groupBy("filter_id", "key").agg(F.count("*").alias("a"))
    every = hits.groupBy("filter_id").agg(F.count("*").alias("hits"))
    grid = every.crossJoin(places).join(within, ["filter_id", "key"], "left").crossJoin(total)
    a = F.coalesce("a", F.lit(0))
    return grid.select(
        "filter_id", "key", a.alias("a"), (F.col("inside") - a).alias("b"), (F.col("hits") - a).alias("c"),
        (F.col("total") - F.col("inside") - F.col("hits") + a).alias("d"),
    )


def _log_choose(n: float, k: float) -> float:
    return math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1)


def fisher_p(a: int, b: int, c: int, d: int) -> tuple[float, float, float]:
    """Fisher's exact p: two-sided, greater, less.

    Terms beyond the observed one fall at least geometrically once past the mode, so each tail is
    summed outwards until a term no longer counts.
    """
    row, col, n = a + b, a + c, a + b + c + d
    lo, hi = max(0, row + col - n), min(row, col)
    base = _log_choose(n, col)
    term = lambda x: math.exp(_log_choose(row, x) + _log_choose(n - row, col - x) - base)
    mode = min(hi, max(lo, (row + 1) * (col + 1) // (n + 2)))

    def tail(x: int, step: int) -> float:
        total = 0.0
        while lo <= x <= hi:
            p = term(x)
            total += p
            past = x >= mode if step > 0 else x <= mode
            if past and p < total * 1e-17 or p == 0.0 and past:
                break
            x += step
        return total

    observed = term(a)
    limit = observed * (1 + 1e-7)
    greater, less = tail(a, 1), tail(a, -1)
    # the other side starts where terms fall to the observed one again: found by bisection
    if a >= mode:
        x, y = lo, mode
        while x < y:
            mid = (x + y + 1) // 2
            x, y = (mid, y) if term(mid) <= limit else (x, mid - 1)
        x = min(x, a - 1)
        other = tail(x, -1) if x >= lo and term(x) <= limit else 0.0
        two = greater + other
    else:
        x, y = mode, hi
        while x < y:
            mid = (x + y) // 2
            x, y = (x, mid) if term(mid) <= limit else (mid + 1, y)
        other = tail(x, 1) if term(x) <= limit else 0.0
        two = less + other
    return min(1.0, two), min(1.0, greater), min(1.0, less)


def fisher(table: DataFrame) -> DataFrame:
    """Adds ``p, p_greater, p_less, odds_ratio`` to 2 x 2 counts ``a, b, c, d``."""

    @F.pandas_udf("p double, p_greater double, p_less double")
    def test(a: pd.Series, b: pd.Series, c: pd.Series, d: pd.Series) -> pd.DataFrame:
        found = [fisher_p(*map(int, x)) for x in zip(a, b, c, d, strict=True)]
        return pd.DataFrame(found, columns=["p", "p_greater", "p_less"], dtype=float)

    tested = table.withColumn("__t", test("a", "b", "c", "d"))
    odds = F.expr("try_divide(cast(a as double) * d, cast(b as double) * c)")
    return tested.select(*table.columns, "__t.*", odds.alias("odds_ratio"))


def bh_adjust(df: DataFrame, by: Sequence[str], p: str = "p") -> DataFrame:
    """Benjamini-Hochberg ``q`` within each group.

    Worked out on distinct p, stored once in ranges: ranks from counts up to each, then the least
    ``p * n / rank`` at or above each, both tied over ranges.
    """
    counted = df.where(F.col(p).isNotNull()).groupBy(*by, p).agg(F.count("*").alias("__c"))
    ranked = running(ranged(counted, by, [p]), by, [p], whole=True, __i=("sum", F.col("__c")))
    falling = ranked.withColumn("__range", -F.col("__range"))
    least = running(falling, by, [F.desc(p)], __q=("min", F.col(p) * F.col("__i_all") / F.col("__i")))
    adjusted = least.select(*by, p, F.least("__q", F.lit(1.0)).alias("q"))
    return same(df, adjusted, [*by, p], "left")
