"""Prefix trie of conversations, with subtree totals by parallel tree contraction.

Turns are told apart by two 64-bit hashes of role and text, so texts leave the data at the first
projection.  A prefix is known by sums of hashes of its turns with their places: such sums need no
pass through a conversation from its start, so a conversation of any length is spread over tasks in
blocks of ``BLOCK`` turns.  A node is a distinct prefix.

Subtree totals come from rounds of joins.  A round rakes all leaves into their parents and then
compresses unary chains: of the nodes with one child, an independent set is spliced out, picked from
numbers that a node knows itself (depths of its parent, itself and its child: half of every fresh
chain; coins by hash where that removes little).  A constant share of the nodes goes in each round.
Then the rounds are undone, last one first: a spliced node's total is what it held plus its child's.
Every round is a table in the shared folder, so a lost executor costs no earlier round.

Null roles and texts are empty; rows without conversation id take no part.  Turns of equal number
are ordered by role, then text, by its first 64 characters and beyond them by hash; null numbers
come first.  Repeated rows are turns of their own.  An empty table has no node.  Extra columns are
ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._shared import batch_of, materialise

BLOCK = 1024
#: Conversation ids joined into one row of a digest's input, at most.
IDS = 1 << 14
_SUMS = ("s0", "s1", "s2", "s3")


def ordered_turns(turns: DataFrame) -> DataFrame:
    """``conv_id, pos (from 1), a, b, bytes`` of ``turns (conv_id, turn, role, text)``.

    Ranges of the order are numbered by themselves; what a range's first conversation has in
    earlier ranges is added, from one row a range.
    """
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    keyed = turns.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn", role.alias("role"), F.left(text, F.lit(64)).alias("lead"),
        F.xxhash64(role, text).alias("a"), F.xxhash64(F.lit("turn"), text, role).alias("b"),
        F.octet_length(text).cast("long").alias("bytes"), F.monotonically_increasing_id().alias("tie"),
    )
    order = [F.asc("conv_id"), F.asc_nulls_first("turn"), F.asc("role"), F.asc("lead"), F.asc("a"), F.asc("b"), F.asc("tie")]
    schema = pa.schema([("part", pa.int32()), ("conv_id", pa.int64()), ("at", pa.int64()), ("a", pa.int64()), ("b", pa.int64()), ("bytes", pa.int64())])

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last, at = TaskContext.get().partitionId(), None, 0
        for batch in batches:
            conv = batch.column("conv_id").to_pylist()
            places = []
            for c in conv:
                at = at + 1 if c == last else 1
                last = c
                places.append(at)
            yield batch_of(schema, [[part] * len(conv), batch.column("conv_id"), places, *(batch.column(c) for c in ("a", "b", "bytes"))])

    placed = keyed.repartitionByRange(*order).sortWithinPartitions(*order).select("conv_id", "a", "b", "bytes")
    placed = materialise(placed.mapInArrow(number, "part int, conv_id long, at long, a long, b long, bytes long"), "turns")
    ends = placed.groupBy("part").agg(F.min("conv_id").alias("first"), F.max(F.struct("conv_id", "at")).alias("last")).orderBy("part").collect()  # a row a task
    before, carried, offsets = None, 0, []
    for r in ends:
        offset = carried if r["first"] == before else 0
        if offset:
            offsets.append((r.part, r["first"], offset))
        carried = r["last"]["at"] + (offset if r["last"]["conv_id"] == r["first"] else 0)
        before = r["last"]["conv_id"]
    known = turns.sparkSession.createDataFrame(offsets, "part int, conv_id long, before long")
    pos = F.col("at") + F.coalesce("before", F.lit(0))
    return placed.join(F.broadcast(known), ["part", "conv_id"], "left").select("conv_id", pos.alias("pos"), "a", "b", "bytes")


def _key(depth: Column, sums: list[Column]) -> Column:
    return F.md5(F.concat_ws(",", depth.cast("string"), *(s.cast("string") for s in sums)))


def prefixes(turns: DataFrame) -> DataFrame:
    """``seq, depth, bytes, last, key, parent_key`` of ``turns (seq, depth from 1, a, b, bytes, last)``."""
    one, two = F.xxhash64("a", "b", "depth"), F.xxhash64(F.lit("place"), "depth", "b", "a")
    low = lambda h: h.bitwiseAND(F.lit(0xFFFFFFFF))
    high = lambda h: F.shiftrightunsigned(h, 32)
    terms = dict(zip(("p0", "p1", "p2", "p3"), (low(one), high(one), low(two), high(two)), strict=True))
    block = F.shiftright(F.col("depth") - 1, BLOCK.bit_length() - 1)
    held = turns.select("seq", "depth", "bytes", "last", block.alias("block"), *(c.alias(p) for p, c in terms.items()))
    earlier = Window.partitionBy("seq").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    totals = held.groupBy("seq", "block").agg(*(F.sum(p).alias(p) for p in terms))
    starts = totals.select("seq", "block", *(F.sum(p).over(earlier).alias(s) for p, s in zip(terms, _SUMS, strict=True))).where("block > 0")
    inside = Window.partitionBy("seq", "block").orderBy("depth")
    summed = held.select("*", *(F.sum(p).over(inside).alias(f"w{p}") for p in terms)).join(starts, ["seq", "block"], "left")
    sums = [F.coalesce(s, F.lit(0)) + F.col(f"w{p}") for p, s in zip(terms, _SUMS, strict=True)]
    before = [s - F.col(p) for s, p in zip(sums, terms, strict=True)]
    return summed.select("seq", "depth", "bytes", "last", _key(F.col("depth"), sums).alias("key"), _key(F.col("depth") - 1, before).alias("parent_key"))


def root_key() -> Column:
    return _key(F.lit(0), [F.lit(0)] * 4)


def trie(rows: DataFrame, sequences: DataFrame) -> DataFrame:
    """``node, parent, key, conv_id, depth, parent_conv_id, n_convs, gain, n_children`` of ``prefixes`` and ``sequences (seq)``.

    ``gain`` is what storing the node's turn once saves: its bytes for all members but one.
    """
    inner = rows.groupBy("key").agg(
        F.min("seq").alias("conv_id"), F.min("depth").cast("long").alias("depth"), F.min("parent_key").alias("parent_key"),
        F.count("*").alias("n_convs"), F.min("bytes").alias("bytes"),
    )
    root = sequences.agg(F.min("seq").alias("conv_id"), F.count("*").alias("n_convs")).where("n_convs > 0").select(
        root_key().alias("key"), "conv_id", F.lit(0).cast("long").alias("depth"), F.lit(None).cast("string").alias("parent_key"),
        "n_convs", F.lit(0).cast("long").alias("bytes"),
    )
    nodes = materialise(inner.unionByName(root).withColumn("node", F.monotonically_increasing_id()), "nodes")
    up = nodes.select(F.col("key").alias("parent_key"), F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    kids = nodes.groupBy("parent_key").agg(F.count("*").alias("n_children")).withColumnRenamed("parent_key", "key")
    gain = ((F.col("n_convs") - 1) * F.col("bytes")).alias("gain")
    joined = nodes.join(up, "parent_key", "left").join(kids, "key", "left")
    return materialise(joined.select("node", "parent", "key", "conv_id", "depth", "parent_conv_id", "n_convs", gain, F.coalesce("n_children", F.lit(0)).alias("n_children")), "trie")


def _marked(upper: Column, lower: Column) -> Column:
    """Whether ``lower`` has the lowest bit in which two depths differ."""
    lowest = upper.bitwiseXOR(lower).bitwiseAND(-(upper.bitwiseXOR(lower)))
    return lower.bitwiseAND(lowest) != 0


def subtree_totals(tree: DataFrame, values: list[str]) -> DataFrame:
    """``node`` and, for each of ``values`` (long), the sum over the node's subtree.

    ``tree (node, parent, depth, n_children, *values)`` is a forest; roots have no parent, and a
    node is deeper than its parent.  Values must not be null.
    """
    alive = materialise(
        tree.select("node", "parent", F.col("depth").cast("long").alias("depth"), (F.col("depth") - 1).cast("long").alias("pdepth"), *values, F.col("n_children").alias("k")),
        "alive",
    )
    left = [F.count("*"), F.count("parent")]
    (size, below), slow, rounds = alive.agg(*left).first(), False, []
    while below:
        leaf = F.col("k") == 0
        inner = alive.where("parent is not null").groupBy(F.col("parent").alias("node")).agg(
            *(F.sum(F.when(leaf, F.col(v)).otherwise(0)).alias(f"raked_{v}") for v in values),
            F.count(F.when(~leaf, 1)).alias("left"), F.min(F.when(~leaf, F.struct(F.col("depth").alias("d"), F.col("node").alias("n")))).alias("child"),
        )
        if slow:
            coin = lambda node: F.xxhash64(node, F.lit(len(rounds))) % 2 != 0  # noqa: B023, E731
            chosen = coin(F.col("node")) & ~coin(F.col("child.n"))
        else:
            chosen = _marked(F.col("pdepth"), F.col("depth")) & ~_marked(F.col("depth"), F.col("child.d"))
        chosen = F.col("parent").isNotNull() & (F.col("left") == 1) & chosen
        state = alive.where((F.col("k") > 0) | F.col("parent").isNull()).join(inner, "node", "left")
        state = materialise(
            state.select(
                "node", "parent", "depth", "pdepth", *((F.col(v) + F.coalesce(f"raked_{v}", F.lit(0))).alias(v) for v in values),
                F.coalesce("left", F.lit(0)).alias("k"), F.col("child.n").alias("child"), F.coalesce(chosen, F.lit(False)).alias("out"),
            ),
            "raked",
        )
        rounds.append((alive.where(leaf & F.col("parent").isNotNull()).select("node", *values), state.where("out").select("node", "child", *values)))
        spliced = state.where("out")
        moved = spliced.select(F.col("child").alias("node"), F.col("parent").alias("to"), F.col("pdepth").alias("to_depth"), *(F.lit(0).cast("long").alias(f"add_{v}") for v in values))
        held = spliced.select(F.col("parent").alias("node"), F.lit(None).cast("long").alias("to"), F.lit(None).cast("long").alias("to_depth"), *(F.col(v).alias(f"add_{v}") for v in values))
        news = moved.unionByName(held).groupBy("node").agg(F.max("to").alias("to"), F.max("to_depth").alias("to_depth"), *(F.sum(f"add_{v}").alias(f"add_{v}") for v in values))
        alive = state.where("not out").join(news, "node", "left").select(
            "node", F.coalesce("to", "parent").alias("parent"), "depth", F.coalesce("to_depth", "pdepth").alias("pdepth"),
            *((F.col(v) + F.coalesce(f"add_{v}", F.lit(0))).alias(v) for v in values), "k",
        )
        alive = materialise(alive, "alive")
        before, (size, below) = size, alive.agg(*left).first()
        slow = 8 * size > 7 * before
    totals = alive.select("node", *values)
    for leaves, spliced in reversed(rounds):
        known = totals.select(F.col("node").alias("child"), *(F.col(v).alias(f"of_{v}") for v in values))
        regained = spliced.join(known, "child").select("node", *((F.col(v) + F.col(f"of_{v}")).alias(v) for v in values))
        totals = materialise(totals.unionByName(leaves).unionByName(regained), "totals")
    return totals


def id_digests(ends: DataFrame) -> DataFrame:
    """``key, ends_sha256`` of ``ends (key, seq)``: hash of the ids in ascending order, comma-joined.

    Ranges of ids are joined to pieces by separate tasks; a key's pieces are hashed one after the
    other as they stream past, so no task holds a key's ids.
    """
    pieces_as = pa.schema([("key", pa.string()), ("first", pa.int64()), ("ids", pa.binary())])
    digest_as = pa.schema([("key", pa.string()), ("ends_sha256", pa.string())])

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple[str, int, list[str]]] = []
            for key, seq in zip(batch.column("key").to_pylist(), batch.column("seq").to_pylist(), strict=True):
                if not out or out[-1][0] != key or len(out[-1][2]) >= IDS:
                    out.append((key, seq, []))
                out[-1][2].append(str(seq))
            if out:
                keys, first, ids = zip(*out, strict=True)
                yield batch_of(pieces_as, [keys, first, [",".join(x).encode() for x in ids]])

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, state = None, None
        for batch in batches:
            keys, found = [], []
            for key, ids in zip(batch.column("key").to_pylist(), batch.column("ids").to_pylist(), strict=True):
                if key == current:
                    state.update(b"," + ids)
                    continue
                if state is not None:
                    keys.append(current)
                    found.append(state.hexdigest())
                current, state = key, hashlib.sha256(ids)
            yield batch_of(digest_as, [keys, found])
        if state is not None:
            yield batch_of(digest_as, [[current], [state.hexdigest()]])

    pieces = ends.select("key", "seq").repartitionByRange("key", "seq").sortWithinPartitions("key", "seq").mapInArrow(join, "key string, first long, ids binary")
    return pieces.repartition("key").sortWithinPartitions("key", "first").mapInArrow(digest, "key string, ends_sha256 string")


def prefix_trie(turns: DataFrame, sequences: DataFrame) -> DataFrame:
    """Every node with its counts and subtree totals, and its ``key``.

    ``turns (seq, depth, a, b, bytes, last)`` are the turns of ``sequences (seq)``, which may have none.
    ``rows`` of ``prefixes`` tell which nodes a sequence passes.
    """
    return _with_totals(trie(prefixes(turns), sequences))


def _with_totals(tree: DataFrame) -> DataFrame:
    leaves = tree.withColumn("leaf", F.when(F.col("n_children") == 0, 1).otherwise(0).cast("long"))
    totals = subtree_totals(leaves, ["leaf", "gain"]).select("node", F.col("leaf").alias("n_leaves"), F.col("gain").alias("saved_tokens"))
    return tree.drop("gain").join(totals, "node")


def rebuilt(turns: DataFrame, group: int = 5, most: int = 9) -> tuple[DataFrame, DataFrame]:
    """Turns and sequences of conversations that begin as the first of their group does.

    Of ``c - c % group`` the first ``crc32(c) % most`` turns, then c's own after as many.
    """
    own = ordered_turns(turns)
    counts = own.groupBy("conv_id").agg(F.max("pos").alias("n"))
    head = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % most).alias("h")
    convs = counts.select("conv_id", "n", (F.col("conv_id") - F.col("conv_id") % group).alias("base"), head)
    bases = counts.select(F.col("conv_id").alias("base"), F.col("n").alias("base_n"))
    kept = F.least("h", F.coalesce("base_n", F.lit(0)))
    convs = convs.join(bases, "base", "left").select("conv_id", "base", "h", kept.alias("kept"), (kept + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("length"))
    convs = materialise(convs, "conversations")
    later = own.join(convs.select("conv_id", "h", "kept", "length"), "conv_id").where("pos > h")
    later = later.select(F.col("conv_id").alias("seq"), (F.col("pos") - F.col("h") + F.col("kept")).alias("depth"), "a", "b", "bytes", "length")
    heads = own.where((F.col("pos") < most) & (F.col("conv_id") % group == 0)).withColumnRenamed("conv_id", "base")
    heads = heads.join(convs, "base").where("pos <= h").select(F.col("conv_id").alias("seq"), F.col("pos").alias("depth"), "a", "b", "bytes", "length")
    rows = materialise(later.unionByName(heads).withColumn("last", F.col("depth") == F.col("length")).drop("length"), "rebuilt")
    return rows, convs.select(F.col("conv_id").alias("seq"), "length")


def digested(rows: DataFrame, sequences: DataFrame) -> DataFrame:
    """The query's columns of ``rows`` and ``sequences`` as ``rebuilt`` gives them."""
    passed = materialise(prefixes(rows), "prefixes")
    nodes = _with_totals(trie(passed, sequences))
    ends = passed.where("last").select("key", "seq").unionByName(sequences.where("length = 0").select(root_key().alias("key"), "seq"))
    none = F.lit(hashlib.sha256(b"").hexdigest())
    found = nodes.join(id_digests(ends), "key", "left")
    return found.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", none).alias("ends_sha256"))


def op12_prefix_trie(spark, sf_dir: str) -> DataFrame:
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    return digested(*rebuilt(turns))
