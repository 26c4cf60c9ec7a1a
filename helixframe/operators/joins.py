"""Joins by key, by interval overlap and by contained text."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from .store import stored

#: The lowest level's bins have 2 ** BIN_BITS places, each higher level's four times as many.
BIN_BITS = 10


def link_inner(a: DataFrame, b: DataFrame, on: str) -> DataFrame:
    return a.join(b, on)


def link_left(a: DataFrame, b: DataFrame, on: str, suffix: str = "_right") -> DataFrame:
    """Keep all of ``a``; columns of ``b`` that clash get ``suffix``."""
    for c in set(a.columns) & set(b.columns) - {on}:
        b = b.withColumnRenamed(c, c + suffix)
    return a.join(b, on, "left")


def pair_outer(a: DataFrame, b: DataFrame, on: str, shared: Sequence[str]) -> DataFrame:
    """Full outer join; of ``shared`` attributes the first side's value counts if it has one."""
    right = b.select(on, *(F.col(c).alias(f"__{c}") for c in shared), *(c for c in b.columns if c != on and c not in shared))
    both = a.join(right, on, "full")
    return both.withColumns({c: F.coalesce(c, f"__{c}") for c in shared}).drop(*(f"__{c}" for c in shared))


def keep_known(a: DataFrame, b: DataFrame, on: str) -> DataFrame:
    return a.join(b.select(on), on, "left_semi")


def novel_rows(new: DataFrame, old: DataFrame, key: str, species: str) -> DataFrame:
    """Rows of a later snapshot with a new key, a new species and a name."""
    named = new.where(F.col(species).isNotNull() & (F.col(species) != ""))
    return named.join(old.select(key), key, "left_anti").join(old.select(species), species, "left_anti")


def update_ids(df: DataFrame, mapping: DataFrame, key: str) -> DataFrame:
    """Replace ids that ``mapping (old, new)`` has."""
    mapped = df.join(mapping.select(F.col("old").alias(key), F.col("new").alias("__new")), key, "left")
    return mapped.withColumn(key, F.coalesce("__new", key)).drop("__new")


def _level(size: Column, base: int) -> Column:
    """Level of an interval: bins of level ``l`` have ``2 ** (base + 2 l)`` places, no fewer than the interval."""
    bits = F.length(F.bin(F.greatest(size - 1, F.lit(0)).cast("long")))
    return F.greatest(F.ceil((bits - base) / 2), F.lit(0)).cast("int")


def binned(df: DataFrame, levels: Column, base: int) -> DataFrame:
    """A row with ``__level, __bin`` for each of an array of levels and each bin there that the interval touches.

    At its own level or above an interval touches one bin or two, however long it is.
    """
    spread = df.withColumn("__level", F.explode(levels))
    return spread.withColumn("__bin", F.explode(F.expr(f"sequence(shiftright(start, {base} + 2 * __level), shiftright(`end` - 1, {base} + 2 * __level))")))


def overlap(a: DataFrame, b: DataFrame, on: Sequence[str], min_frac: tuple[int, int] | None = None, base: int = BIN_BITS, tables: bool = False) -> DataFrame:
    """Pairs of overlapping half-open intervals, with ``ov``; ``b``'s bounds come as ``b_start, b_end``.

    Bins are hierarchical: an interval has one level, by its length.  A pair meets at the higher of
    its two levels, so each side is put in bins of its own level for the shorter intervals of the
    other, and in bins of the other's higher levels: rows grow with intervals and levels, not with
    lengths.  Of the bins where a pair meets, it is kept in the one where the later of its starts
    lies, so each pair comes once and none needs a range join.  ``min_frac`` ``(m, n)`` keeps pairs
    that cover at least m / n of the first interval.  Both sides are stored once, unless they are
    ``tables`` that are cheap to read again.
    """
    sides = []
    for df, name in ((a, "overlap-a"), (b, "overlap-b")):
        kept = df if tables else stored(df, name)
        bounds = kept.where("start < `end`").withColumns({"start": F.col("start").cast("long"), "end": F.col("end").cast("long")})
        sides.append(bounds.withColumn("__own", _level(F.col("end") - F.col("start"), base)))
    own = [sorted(r[0] for r in s.select("__own").distinct().collect()) for s in sides]  # levels: 32 at most
    met = None
    for held, other, strict in ((0, 1, False), (1, 0, True)):
        if met is not None and not any(x > y for x in own[held] for y in own[other]):
            continue  # no interval of the other side is shorter
        shared = F.filter(F.array(*map(F.lit, own[held])).cast("array<int>"), lambda x: x > F.col("__own") if strict else x >= F.col("__own"))  # noqa: B023
        least = min(own[other], default=0)  # none of the other side is shorter than that
        long = binned(sides[held].where(F.col("__own") > least if strict else F.col("__own") >= least), F.array("__own"), base)
        short = binned(sides[other], shared, base)
        left, right = (long, short) if held == 0 else (short, long)
        right = right.withColumnsRenamed({"start": "b_start", "end": "b_end"}).drop("__own")
        pairs = left.drop("__own").join(right, [*on, "__level", "__bin"])
        met = pairs if met is None else met.unionByName(pairs)
    hit = (F.col("start") < F.col("b_end")) & (F.col("b_start") < F.col("end"))
    pairs = met.where(hit & (F.expr(f"shiftright(greatest(start, b_start), {base} + 2 * __level)") == F.col("__bin")))
    pairs = pairs.drop("__bin", "__level").withColumn("ov", F.least("end", "b_end") - F.greatest("start", "b_start"))
    if min_frac:
        pairs = pairs.where(F.col("ov") * min_frac[1] >= (F.col("end") - F.col("start")) * min_frac[0])
    return pairs


#: Letters of source names that one automaton may hold; it is sent to every task.
AUTOMATON_LETTERS = 16 << 20


def name_lookup(source: DataFrame, names: DataFrame, key: str = "source_name", gram: int = 3, letters: int = AUTOMATON_LETTERS) -> DataFrame:
    """Names (``name, id``) that contain a source name; sources that none contains keep a null id.

    The different source names make one automaton, if they have no more than ``letters`` letters:
    every name is read once, whatever number of sources it may hold.  More of them meet names by
    their rarest ``gram`` letters.  Case counts, nothing is a pattern, and an empty source name is
    in no name.
    """
    different = stored(source.where(F.col(key).isNotNull() & (F.col(key) != "")).select(F.col(key).alias("__word")).distinct(), "words")
    total = different.agg(F.coalesce(F.sum(F.length("__word")), F.lit(0))).first()[0]
    known = names.where("name is not null")
    found = _by_automaton(different, known) if total <= letters else _by_rarest_gram(different, known, gram)
    return source.join(found.select(F.col("__word").alias(key), "name", "id").distinct(), key, "left")


def _by_automaton(words: DataFrame, names: DataFrame) -> DataFrame:
    shared = words.sparkSession.sparkContext.broadcast([r[0] for r in words.collect()])  # AUTOMATON_LETTERS at most
    schema = to_arrow_schema(names.select("name", "id").schema)
    out = schema.append(pa.field("__word", pa.string()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        automaton = ahocorasick.Automaton()
        for word in shared.value:
            automaton.add_word(word, word)
        if not len(automaton):
            return
        automaton.make_automaton()
        for batch in batches:
            rows, hits = [], []
            for i, name in enumerate(batch.column("name").to_pylist()):
                own = {word for _, word in automaton.iter(name)}
                rows += [i] * len(own)
                hits += own
            taken = batch.take(pa.array(rows, pa.int64()))
            yield pa.RecordBatch.from_arrays([*(c.cast(f.type) for c, f in zip(taken.columns, schema, strict=True)), pa.array(hits, pa.string())], schema=out)

    kind = names.schema["id"].dataType.simpleString()
    return names.select("name", "id").mapInArrow(run, f"name string, id {kind}, __word string")


def _by_rarest_gram(words: DataFrame, names: DataFrame, gram: int) -> DataFrame:
    """Each word waits at the gram of its own that fewest names have; a word with a gram that none has is in none."""
    cut = lambda c, n: F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(c) - n + 1, F.lit(1))), lambda i: F.substring(c, i, n)))
    every = F.array_distinct(F.flatten(F.array(*(F.when(F.length("name") >= n, cut("name", F.lit(n))).otherwise(F.array().cast("array<string>")) for n in range(1, gram + 1)))))
    spread = stored(names.select("name", "id", F.explode(every).alias("__g")), "grams")
    often = spread.groupBy("__g").agg(F.count("*").alias("__n"))
    own = words.withColumn("__g", F.explode(cut("__word", F.least(F.length("__word"), F.lit(gram)))))
    weighed = own.join(often, "__g", "left").groupBy("__word").agg(F.min_by("__g", F.struct(F.coalesce("__n", F.lit(0)), F.col("__g"))).alias("__g"))
    return spread.join(weighed, "__g").where(F.col("name").contains(F.col("__word")))


def length_grid(lengths: DataFrame) -> DataFrame:
    """All pairs of a short list of lengths."""
    return lengths.select(F.col("length").alias("len1")).crossJoin(lengths.select(F.col("length").alias("len2")))


def model_pairs(models: DataFrame) -> DataFrame:
    """All unordered pairs of a short list of models."""
    a, b = models.select(F.col("model").alias("a")), models.select(F.col("model").alias("b"))
    return a.join(b, F.col("a") < F.col("b"))
