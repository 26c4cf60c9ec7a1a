"""Curation of labelled genome tables: rules, taxonomy, names, evidence."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .store import dealt, stored


def filter_genomes(df: DataFrame, keep: dict[str, str], drop_empty: Sequence[str]) -> DataFrame:
    """Rows whose columns match patterns in any case and whose ``drop_empty`` are filled."""
    for c, pattern in keep.items():
        df = df.where(F.col(c).rlike(f"(?i){pattern}"))
    for c in drop_empty:
        df = df.where(F.col(c).isNotNull() & (F.trim(c) != ""))
    return df


def apply_rules(df: DataFrame, rules: Sequence[tuple[str, str, bool]]) -> DataFrame:
    """``label`` from (name, condition, label) rules; both labels give null and a conflict.

    ``rules`` names those that held, in their order.
    """
    held = [(n, F.coalesce(F.expr(c), F.lit(False)), v) for n, c, v in rules]
    yes = [h for _, h, v in held if v]
    no = [h for _, h, v in held if not v]
    any_of = lambda hs: F.greatest(*hs, F.lit(False)) if hs else F.lit(False)
    pos, neg = any_of(yes), any_of(no)
    return df.withColumns({
        "label": F.when(pos & neg, None).when(pos, True).when(neg, False), "conflict": pos & neg,
        "rules": F.concat_ws(",", *(F.when(h, n) for n, h, _ in held)),
    })


def resolve_conflicts(df: DataFrame, species: str, label: str) -> DataFrame:
    """Tag species that have both labels and drop their negative rows."""
    w = Window.partitionBy(species)
    both = F.coalesce(F.bool_or(F.col(label)).over(w) & F.bool_or(~F.col(label)).over(w), F.lit(False))
    tagged = df.withColumn("mixed", both)
    return tagged.where(~F.col("mixed") | F.coalesce(F.col(label), F.lit(True)))


def resolve_candidates(links: DataFrame, key: str, agrees: Column, order: Sequence[Column | str]) -> DataFrame:
    """Sole candidates stay; of several, the first that agrees by ``order``."""
    counted = links.withColumns({"__n": F.count("*").over(Window.partitionBy(key)), "__ok": agrees})
    kept = counted.where((F.col("__n") == 1) | F.col("__ok"))
    w = Window.partitionBy(key).orderBy(*order)
    return kept.withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__n", "__ok", "__r")


def species_agrees(species: Column, organism: Column) -> Column:
    return F.coalesce(F.lower(organism).contains(F.lower(species)), F.lit(False))


def strains_agree(genome: Column, strain: Column, organism: Column, infraspecific: Column) -> Column:
    """Strain or organism of a candidate in our genome's name, or our strain in either; case and dashes aside."""
    plain = lambda c: F.trim(F.lower(F.replace(F.coalesce(c, F.lit("")), F.lit("-"))))
    g, s, o, i = plain(genome), plain(strain), plain(organism), plain(F.replace(infraspecific, F.lit("strain=")))
    theirs = (i != "") & (g.contains(i) | g.contains(o))
    return theirs | ((s != "") & (i.contains(s) | o.contains(s)))


def one_of_each(df: DataFrame, key: str, order: Sequence[Column | str], agrees: Column | None = None, exempt: Column | None = None) -> DataFrame:
    """Of rows that share ``key``, the first that agrees by ``order``.

    Rows alone or without a key stay, and so do all rows of a key that has an ``exempt`` one.
    """
    w = Window.partitionBy(key)
    flags = {"__n": F.count("*").over(w), "__ok": F.lit(True) if agrees is None else agrees, "__x": F.lit(False) if exempt is None else F.bool_or(F.coalesce(exempt, F.lit(False))).over(w)}
    counted = df.where(F.col(key).isNotNull()).withColumns(flags)
    ranked = counted.withColumn("__r", F.row_number().over(w.orderBy(F.desc("__ok"), *order)))
    kept = ranked.where((F.col("__n") == 1) | F.col("__x") | (F.col("__ok") & (F.col("__r") == 1)))
    return kept.drop("__n", "__ok", "__x", "__r").unionByName(df.where(F.col(key).isNull()))


def resolve_duplicates(df: DataFrame, order: Sequence[Column | str]) -> DataFrame:
    """One row of each organism, then of each genome name, then of each species and strain.

    Columns ``species, strain, genome, organism, infraspecific``; organisms' rows must agree in
    species and strain, and names with a sub-strain (``substr.``) keep all their rows.
    """
    agrees = species_agrees(F.col("species"), F.col("organism")) & strains_agree(*map(F.col, ("genome", "strain", "organism", "infraspecific")))
    sub = F.col("infraspecific").contains("substr.")
    by_organism = one_of_each(df, "organism", order, agrees)
    by_name = one_of_each(by_organism, "genome", order, exempt=sub)
    both = F.when(F.col("strain") != "", F.trim(F.concat_ws(" ", "species", "strain")))
    return one_of_each(by_name.withColumn("__both", both), "__both", order, exempt=sub).drop("__both")


def extend_links(links: DataFrame, better: DataFrame, key: str, name: str, order: Sequence[Column | str]) -> DataFrame:
    """Replace links by the best row of ``better`` with the same name; ``extended`` tells which."""
    w = Window.partitionBy(name).orderBy(*order)
    best = better.withColumn("__r", F.row_number().over(w)).where("__r = 1").select(name, F.col("assembly").alias("__new"))
    out = links.join(best, name, "left").withColumn("extended", F.col("__new").isNotNull() & ~F.col("__new").eqNullSafe(F.col("assembly")))
    return out.withColumn("assembly", F.coalesce("__new", "assembly")).drop("__new")


def extend_by_names(selected: DataFrame, candidates: DataFrame) -> DataFrame:
    """``link, assembly, linked_by_project, linked_by_organism``: better assemblies for selected links.

    ``selected (link, project, species, strain, organism, infraspecific)`` and ``candidates
    (assembly, project, organism, infraspecific)``.  All candidates of the same organism name are
    found; those of a project of the link's, or found by strain as well, are flagged.  Candidates
    whose organism is a link's species and strain come besides, unless found by organism for any
    link, if their infraspecific name lies within the link's (case, dashes and spaces aside);
    sub-strains (``substr``) only if the two names are the same.
    """
    plain = lambda c: F.lower(F.regexp_replace(F.coalesce(c, F.lit("")), r"strain=|-|\s+", ""))
    theirs = candidates.select("assembly", "organism", F.col("project").alias("__p"), F.col("infraspecific").alias("__i"))
    strained = selected.where(F.coalesce(F.col("strain"), F.lit("")) != "").withColumn("organism", F.trim(F.concat_ws(" ", "species", "strain")))
    # what is known of an assembly by its rows: links are only joined where they come out
    linked = theirs.join(selected.select("organism").distinct(), "organism", "left_semi").select("assembly").distinct()
    seen = theirs.join(strained.select("organism").distinct(), "organism", "left_semi").select("assembly").distinct()
    known = theirs.join(seen.withColumn("__seen", F.lit(True)), "assembly", "left")
    first = _salted(selected.select("link", "organism", "project"), known, ["organism"]).select(
        "link", "assembly", (F.coalesce(F.col("project") == F.col("__p"), F.lit(False)) | F.coalesce("__seen", F.lit(False))).alias("linked_by_project"), F.lit(True).alias("linked_by_organism")
    )
    within = (F.coalesce(F.col("__i"), F.lit("")) != "") & plain(F.col("infraspecific")).contains(plain(F.col("__i")))
    whole = ~plain(F.col("__i")).contains("substr") | (F.col("__i") == F.col("infraspecific"))
    fresh = theirs.join(linked, "assembly", "left_anti")
    names = strained.select("organism", "infraspecific").distinct().join(fresh.select("organism", "__i").distinct(), "organism").where(within & whole)
    named = strained.select("link", "organism", "infraspecific").join(names, ["organism", "infraspecific"])
    novel = _salted(named, fresh.select("assembly", "organism", "__i"), ["organism", "__i"])
    return first.unionByName(novel.select("link", "assembly", F.lit(True).alias("linked_by_project"), F.lit(False).alias("linked_by_organism")))


#: Parts over which the second side of a join on few keys is spread.
SALT = 16


def _salted(few: DataFrame, many: DataFrame, on: list[str]) -> DataFrame:
    """Join on keys that many rows share: each key of ``many`` is dealt over ``SALT`` parts, each of which meets all of ``few``."""
    every = few.withColumn("__salt", F.explode(F.array(*map(F.lit, range(SALT)))))
    parted = many.withColumn("__salt", F.pmod(F.xxhash64("assembly"), F.lit(SALT)).cast("int"))
    return dealt(every, *on, "__salt").join(dealt(parted, *on, "__salt"), [*on, "__salt"]).drop("__salt")


def ancestors(nodes: DataFrame) -> DataFrame:
    """``taxid, ancestor, depth`` for every node, itself included, by doubling the climbed path.

    Each round joins the climbed pairs with themselves, so rounds grow with the logarithm of the
    depth; a table of pairs replaces one walk for each id.  Paths are climbed to their end; a cycle
    of parents raises ``ValueError``.
    """
    parents = nodes.where("parent <> taxid").select("taxid", F.col("parent").alias("ancestor"))
    own = nodes.select("taxid", F.col("taxid").alias("ancestor"), F.lit(0).alias("depth"))
    pairs = own.unionByName(parents.select("taxid", "ancestor", F.lit(1).alias("depth")))
    reach = 1
    while not (longest := pairs.where(F.col("depth") == reach)).isEmpty():
        if not pairs.where("depth > 0 and ancestor = taxid").isEmpty():
            raise ValueError("parents of nodes form a cycle")
        b = pairs.alias("b")
        further = longest.alias("a").join(b, F.col("a.ancestor") == F.col("b.taxid")).where("b.depth > 0").select("a.taxid", "b.ancestor", (F.col("a.depth") + F.col("b.depth")).alias("depth"))
        grown = pairs.unionByName(further)
        pairs, reach = grown.checkpoint() if nodes.sparkSession.sparkContext.getCheckpointDir() else grown, reach * 2
    return pairs.where(F.col("ancestor") != 0)


def nearest_at(nodes: DataFrame, rank: str) -> DataFrame:
    """``taxid, at_rank``: each node's nearest ancestor of ``rank``, itself included; null where there is none.

    Pointer jumping with one row a node: a node holds the place it has climbed to.  A round looks
    there: it takes over that node's answer, or else its place, so the climbed stretch doubles.
    Answered nodes and those at the top leave the round; rounds grow with the logarithm of the
    depth.  Node 0 is the root above all and no one's answer.  Raises ``ValueError`` where parents
    form a cycle without an answer.
    """
    wanted = (F.col("rank") == rank) & (F.col("taxid") != 0)
    above = F.when((F.col("parent") != F.col("taxid")) & F.col("parent").isNotNull(), F.col("parent"))
    state = nodes.select("taxid", F.when(wanted, F.col("taxid")).alias("at_rank"), F.when(~F.coalesce(wanted, F.lit(False)), above).alias("at"))
    state = stored(state, "climb")
    rounds, n = 0, None
    while not state.where("at is not null").isEmpty():
        n = state.count() if n is None else n
        if rounds > n.bit_length() + 1:
            raise ValueError("parents of nodes form a cycle")
        there = state.select(F.col("taxid").alias("__t"), F.col("at_rank").alias("__hit"), F.col("at").alias("__at"))
        climbing = state.where("at is not null").join(there, F.col("at") == F.col("__t"), "left").select("taxid", F.col("__hit").alias("at_rank"), F.col("__at").alias("at"))
        state = stored(state.where("at is null").unionByName(climbing), "climb")
        rounds += 1
    return state.select("taxid", "at_rank")


def ancestor_at(ids: DataFrame, nodes: DataFrame, rank: str, merged: DataFrame | None = None) -> DataFrame:
    """Nearest ancestor of each id with ``rank``; ids pass through ``merged (old, new)`` first."""
    if merged is not None:
        ids = ids.join(merged.select(F.col("old").alias("taxid"), "new"), "taxid", "left").select(F.coalesce("new", "taxid").alias("taxid"))
    return ids.join(nearest_at(nodes, rank), "taxid", "left")


def resolve_names(names: DataFrame, candidates: DataFrame) -> DataFrame:
    """Best tier of candidates for each name: exact species, exact synonym, first two words, any.

    ``candidates (name, taxid, species, synonym)``; ties stay except in the last tier.
    """
    two = F.substring_index("name", " ", 2)
    both = names.join(candidates, "name")
    tier = F.when(F.col("species") == F.col("name"), 1).when(F.col("synonym") == F.col("name"), 2).when(F.col("synonym") == two, 3).otherwise(4)
    tiered = both.withColumn("tier", tier)
    w = Window.partitionBy("name")
    best = tiered.withColumns({"__b": F.min("tier").over(w), "__r": F.row_number().over(w.orderBy("tier", "taxid"))})
    return best.where((F.col("tier") == F.col("__b")) & ((F.col("tier") < 4) | (F.col("__r") == 1))).drop("__b", "__r")


def merge_evidence(evidence: DataFrame, labels: Sequence[str]) -> DataFrame:
    """Long ``species, label, source, seq_no`` to a flag and joined citations for each label."""
    cited = lambda v: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("label") == v, F.struct("seq_no", "source")))), lambda x: x["source"]), "; ")
    flags = [F.bool_or(F.col("label") == v).alias(v) for v in labels]
    return evidence.groupBy("species").agg(*flags, *(cited(v).alias(f"{v}_source") for v in labels))


def label_tiers(df: DataFrame, tiers: Sequence[tuple[str, str]], rest: str = "rest") -> DataFrame:
    """First tier whose condition holds."""
    tier = F.coalesce(*(F.when(F.expr(c), F.lit(n)) for n, c in tiers), F.lit(rest))
    return df.withColumn("tier", tier)


def temporal_update(old: DataFrame, new: DataFrame, key: str, label: str) -> DataFrame:
    """Labels of a later snapshot over those of an earlier one, with what changed."""
    both = old.select(key, F.col(label).alias("__o")).join(new.select(key, F.col(label).alias("__n")), key, "full")
    status = F.when(F.col("__o").isNull(), "new").when(F.col("__n").isNull(), "kept").when(F.col("__o") == F.col("__n"), "same").otherwise("changed")
    return both.select(key, F.coalesce("__n", "__o").alias(label), status.alias("status"))


def temporal_test(old: DataFrame, new: DataFrame, key: str, label: str, stamp: str) -> DataFrame:
    """Labelled rows of a later snapshot whose key the earlier one lacks, under its date."""
    novel = new.where(F.col(label).isNotNull()).join(old.select(key), key, "left_anti")
    return novel.select(key, label, F.lit(stamp).alias("snapshot"))


def label_hits(hits: DataFrame, lists: Sequence[tuple[str, DataFrame]], key: str) -> DataFrame:
    """Label of the first list that has a hit's id."""
    every = None
    for i, (name, df) in enumerate(lists):
        own = df.select(key, F.lit(i).alias("i"), F.lit(name).alias("target"))
        every = own if every is None else every.unionByName(own)
    return hits.join(every.groupBy(key).agg(F.min_by("target", "i").alias("target")), key, "left")
