"""Near-dedup: texts that share at least 80 % of their five-word shingles link.

Every link is decided on the exact sets of shingle hashes; fingerprints and bands only propose.
Proposed are pairs whose fingerprints differ in ``simhash.RADIUS`` bits at most (the covering
tables miss none) and pairs that meet in one of ``BANDS`` bands of shingle minima, as texts that
share 0.8 of their shingles do with a chance over 0.999.

Texts with equal sets are one node.  In buckets of ``FEW`` nodes or less all pairs are compared.  A
larger bucket takes its hub, the node with most neighbours in all its buckets, and compares it with
all others, then the next such node with those of other components, and so on until a round of
hubs adds no link anywhere.  Large buckets that then still hold several components are joined by
their rarest shingles (:func:`rare_pairs`), which misses no pair, so hubs only save work.

Nulls and wordless texts form one group; repeated rows and copies share a node and so a group; an
empty table gives an empty result; all columns of the input are kept as they are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import simhash as S
from ._components import connected_components
from ._repeats import forget_words, word_symbols
from ._runs import Hasher
from ._shared import as_bytes, batch_of, keyed, materialise

SHINGLE = 5
SIMILARITY = 0.8
BANDS = 16
BAND_ROWS = 4

_RNG = np.random.default_rng(11)
_FACTORS = _RNG.integers(1, 1 << 63, BANDS * BAND_ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SHIFTS = _RNG.integers(0, 1 << 63, BANDS * BAND_ROWS, dtype=np.uint64)
_EPS = 1e-9
CHUNK = 1024
#: The largest bucket whose pairs are all compared.
FEW = 16
#: Rows of at most four numbers that are sent to every task.
SENT = 1_000_000


def shingle_set(body: bytes, words_each: int) -> np.ndarray:
    """Sorted distinct shingle hashes of one text; A-Z in lower case, too few words are one shingle."""
    symbols = word_symbols(np.frombuffer(body.lower(), np.uint8))
    if not len(symbols):
        return np.zeros(0, np.uint64)
    return np.unique(Hasher(symbols).grams(min(words_each, len(symbols))))


def describe(body: bytes, words_each: int) -> tuple[np.ndarray, int, list[int]]:
    """One text's shingle set, and the fingerprint and band keys of it."""
    shingles = shingle_set(body, words_each)
    count = np.zeros(S.BITS, np.int64)
    least = np.full(len(_FACTORS), np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(shingles), CHUNK):
        h = shingles[at : at + CHUNK]
        count += np.unpackbits(h.view(np.uint8), bitorder="little").reshape(-1, S.BITS).sum(0, dtype=np.int64)
        least = np.minimum(least, (h[:, None] * _FACTORS + _SHIFTS).min(0))
    fp = int(np.packbits(2 * count > len(shingles), bitorder="little").view(np.int64)[0])
    bands = [xxhash.xxh3_64_intdigest(row.tobytes(), i) - (1 << 63) for i, row in enumerate(least.reshape(BANDS, BAND_ROWS))]
    return shingles, fp, bands


def described(docs: DataFrame, words_each: int) -> DataFrame:
    """``dkey, tkey, doc_id, node, n, fp, bands``: equal nodes are equal shingle sets of ``n``."""
    fields = [(c, pa.int64()) for c in ("dkey", "tkey", "doc_id", "node")]
    schema = pa.schema([*fields, ("n", pa.int32()), ("fp", pa.int64()), ("bands", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(_node(h), len(h), fp, bands) for h, fp, bands in (describe(b.tobytes(), words_each) for b in as_bytes(batch.column("body")))]
            own = [batch.column(c) for c in ("dkey", "tkey", "doc_id")]
            yield batch_of(schema, [*own, *(list(zip(*found, strict=True)) or [()] * 4)])
        forget_words()

    ddl = "dkey long, tkey long, doc_id long, node long, n int, fp long, bands array<long>"
    return materialise(keyed(docs).mapInArrow(run, ddl), "described")


def _node(shingles: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(shingles.tobytes()) - (1 << 63)


def sent(few: DataFrame) -> DataFrame:
    """``few`` to all tasks if it has at most ``SENT`` rows of a few numbers; shuffled above that."""
    few = materialise(few, "few")
    return F.broadcast(few) if few.count() <= SENT else few


def distinct_nodes(marked: DataFrame) -> DataFrame:
    """``node, of, n, fp, bands``: one row a node, with the keys of one of its texts."""
    same = [F.first(c).alias(c) for c in ("n", "fp", "bands")]  # these follow from the node's set
    return materialise(marked.groupBy("node").agg(F.min(F.struct("dkey", "tkey")).alias("of"), *same), "nodes")


def sets_of(used: DataFrame, nodes: DataFrame, docs: DataFrame, words_each: int) -> DataFrame:
    """``node, shingles`` of the nodes ``used``, spelled again from one text of each."""
    wanted = sent(nodes.join(sent(used), "node", "left_semi").select("of.dkey", "of.tkey", "node"))
    texts = keyed(docs).join(wanted, ["dkey", "tkey"]).groupBy("node").agg(F.first("body").alias("body"))
    schema = pa.schema([("node", pa.int64()), ("shingles", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_set(b.tobytes(), words_each).view(np.int64) for b in as_bytes(batch.column("body"))]
            yield batch_of(schema, [batch.column("node"), sets])
        forget_words()

    return materialise(texts.select("node", "body").mapInArrow(run, "node long, shingles array<long>"), "sets")


def buckets(nodes: DataFrame) -> DataFrame:
    """``bucket, bits, member``: every node under its bands and covering tables (``bits``)."""
    keys = lambda b, bits: F.struct(b.alias("bucket"), F.lit(bits).alias("bits"))
    bands = F.transform("bands", lambda key, i: keys(F.xxhash64(i, key), False))
    masks = S.covering_masks(S.RADIUS)
    tables = [keys(F.xxhash64(F.lit(-1 - t), F.col("fp").bitwiseAND(F.lit(m))), True) for t, m in enumerate(masks)]
    member = F.struct("node", "n", "fp").alias("member")
    return nodes.select(member, F.explode(F.concat(bands, F.array(*tables))).alias("key")).select("key.bucket", "key.bits", "member")


def _proposed(a: Column, b: Column, bits: Column, similarity: float) -> Column:
    """Whether sizes leave room for the similarity, and covering tables' members are near in fact."""
    near = F.bit_count(a["fp"].bitwiseXOR(b["fp"])) <= S.RADIUS
    return (F.least(a["n"], b["n"]) >= similarity * F.greatest(a["n"], b["n"]) - _EPS) & (~bits | near)


def alike(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """``u, v`` of the pairs whose shingle sets have the similarity."""
    both = pairs.join(sets.select(F.col("node").alias("u"), F.col("shingles").alias("x")), "u")
    both = both.join(sets.select(F.col("node").alias("v"), F.col("shingles").alias("y")), "v")
    shared = F.size(F.array_intersect("x", "y"))
    counted = both.select("u", "v", shared.alias("shared"), (F.size("x") + F.size("y")).alias("sizes"))
    held = counted.where(F.col("shared") >= similarity * (F.col("sizes") - F.col("shared")) - _EPS)
    return materialise(held.select("u", "v"), "links")


def unsettled(many: DataFrame, roots: DataFrame) -> DataFrame:
    """``node, n, root`` of the large buckets that hold more than one component."""
    placed = many.select("bucket", "member.node", "member.n").join(roots.withColumnRenamed("u", "node"), "node", "left")
    placed = placed.withColumn("root", F.coalesce("root", "node"))
    mixed = placed.groupBy("bucket").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low < high")
    return materialise(placed.join(mixed, "bucket", "left_semi").select("node", "n", "root").distinct(), "unsettled")


def rare_pairs(nodes: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """``u, v``: candidates among ``nodes (node, n, root)`` of different roots, without loss.

    Shingles are ordered from the rarest.  Sets that have the similarity share so many that the
    first one they share lies among the first ``n - ceil(t * n) + 1`` of the larger set and the
    first ``n - ceil(2 * t / (1 + t) * n) + 1`` of the smaller; only these are joined.
    """
    each = nodes.join(sets, "node").select("node", "n", "root", F.explode("shingles").alias("shingle"))
    common = each.groupBy("shingle").agg(F.count("*").alias("times"))
    order = Window.partitionBy("node").orderBy("times", "shingle")
    ranked = each.join(common, "shingle").withColumn("place", F.row_number().over(order))
    head = lambda share: F.col("place") <= F.col("n") - F.ceil(share * F.col("n") - _EPS) + 1
    lead = head(2 * similarity / (1 + similarity)).alias("lead")
    posts = materialise(ranked.where(head(similarity) & (F.col("times") > 1)).select("shingle", "node", "n", "root", "place", lead), "posts")
    by_root = posts.groupBy("shingle", "root").agg(F.count("*").alias("size")).groupBy("shingle")
    mixed = by_root.agg(F.count("*").alias("roots"), F.max_by("root", F.struct("size", "root")).alias("top")).where("roots > 1")
    posts = posts.join(mixed.select("shingle", "top"), "shingle").withColumn("in_top", F.col("root") == F.col("top"))
    # a shingle's largest component meets the others, never itself
    sides = F.when(F.col("in_top"), F.array(F.lit(False))).otherwise(F.array(F.lit(False), F.lit(True)))
    small, large = posts.where("lead").withColumn("side", F.explode(sides)).alias("a"), posts.alias("b")
    sized = F.expr("a.root != b.root and (a.n < b.n or (a.n = b.n and a.node < b.node))") & (F.col("a.n") >= similarity * F.col("b.n") - _EPS)
    # what both may share from the first shingle that they share on
    rest = F.least(F.expr("a.n - a.place"), F.expr("b.n - b.place")) + 1
    enough = rest >= similarity / (1 + similarity) * F.expr("a.n + b.n") - _EPS
    met = small.join(large, F.expr("a.shingle = b.shingle and a.side = b.in_top") & sized & enough)
    return met.select(F.least("a.node", "b.node").alias("u"), F.greatest("a.node", "b.node").alias("v")).distinct()


def links_of(marked: DataFrame, docs: DataFrame, words_each: int, similarity: float) -> DataFrame:
    """``u, root`` of nodes linked by exact similarity; marked is ``described``'s of ``docs``."""
    nodes = distinct_nodes(marked)
    each = buckets(nodes)
    # a hot bucket shrinks to one row a task before it is dealt by its key
    shared = each.groupBy("bucket", "bits").agg(F.count("*").alias("size")).where("size > 1")
    rows = materialise(each.join(sent(shared), ["bucket", "bits"]), "buckets")
    sets = sets_of(rows.select("member.node").distinct(), nodes, docs, words_each)
    # what most buckets hold in common is likely the text that the others derive from
    degree = rows.groupBy(F.col("member.node").alias("u")).agg(F.sum("size").alias("degree"))
    ranked = rows.withColumn("u", F.col("member.node")).join(degree, "u")
    ranked = materialise(ranked.select("bucket", "bits", "size", F.struct("degree", "member.node", "member.n", "member.fp").alias("member")), "ranked")
    member, hub = F.col("member"), F.col("hub")
    ends = lambda x, y: [F.least(x["node"], y["node"]).alias("u"), F.greatest(x["node"], y["node"]).alias("v")]

    few, many = ranked.where(F.col("size") <= FEW), ranked.where(F.col("size") > FEW)
    other = F.col("other")
    pairs = few.join(few.select("bucket", member.alias("other")), "bucket").where(member["node"] < other["node"])
    pairs = pairs.where(_proposed(member, other, F.col("bits"), similarity)).select(*ends(member, other))
    hubs = many.groupBy("bucket").agg(F.max("member").alias("hub"))
    stars = many.join(hubs, "bucket").where((member["node"] != hub["node"]) & _proposed(hub, member, F.col("bits"), similarity))
    first = materialise(pairs.unionByName(stars.select(*ends(hub, member))).distinct(), "pairs")
    roots = connected_components(alike(first, sets, similarity))
    while True:
        hubs = materialise(many.join(hubs.withColumnRenamed("hub", "last"), "bucket").where("member < last").groupBy("bucket").agg(F.max("member").alias("hub")), "hubs")
        of = roots.select(F.col("u").alias("node"), "root")
        hubs_of = hubs.withColumn("node", hub["node"]).join(of, "node", "left").select("bucket", "hub", F.coalesce("root", "node").alias("hub_root"))
        left = many.join(hubs_of, "bucket").withColumn("node", member["node"]).join(of, "node", "left")
        left = left.where((F.coalesce("root", "node") != F.col("hub_root")) & _proposed(hub, member, F.col("bits"), similarity))
        more = alike(materialise(left.select(*ends(hub, member)).distinct(), "pairs"), sets, similarity)
        if more.isEmpty():
            break
        roots = merged(roots, more)
    left = unsettled(many, roots)
    if left.isEmpty():
        return roots
    return merged(roots, alike(materialise(rare_pairs(left, sets, similarity), "pairs"), sets, similarity))


def merged(roots: DataFrame, links: DataFrame) -> DataFrame:
    """``u, root`` of the components ``roots`` once ``links`` are added."""
    return connected_components(links.unionByName(roots.select("u", F.col("root").alias("v"))))


def groups(docs: DataFrame, words_each: int = SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """``dkey, tkey, doc_id, root`` for every document (see ``keyed``); equal roots are a group."""
    marked = described(docs, words_each)
    roots = links_of(marked, docs, words_each, similarity).withColumnRenamed("u", "node")
    return marked.join(roots, "node", "left").select("dkey", "tkey", "doc_id", F.coalesce("root", "node").alias("root"))


def keep_one(docs: DataFrame, words_each: int = SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """``docs`` with one row of each group: that of the least doc_id (nulls last)."""
    found = groups(docs, words_each, similarity)
    first = found.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("absent"), "dkey", "tkey")).alias("first"))
    chosen = first.select("first.dkey", "first.tkey").distinct()
    dkey, tkey = F.coalesce(F.col("doc_id").cast("long"), F.lit(0)), F.xxhash64(F.coalesce(F.col("text"), F.lit("")))
    # all columns of the input travel in one, so that no name clashes
    tagged = docs.select(dkey.alias("dkey"), tkey.alias("tkey"), F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
    return tagged.join(chosen, ["dkey", "tkey"], "left_semi").dropDuplicates(["dkey", "tkey"]).select("row.*")
