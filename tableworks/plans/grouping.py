"""Topic groups of table titles: matching proposed titles, merging groups, grouped index.

All functions work within a scope (normally the domain) given by the column ``scope``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tableworks.functions.columns import col
from tableworks.functions.text import clean_group_name
from tableworks.operators import fuzzy, ordered
from tableworks.session import pin

SCOPE = ["scope"]


def match_titles(
    proposed: DataFrame, titles: DataFrame, least: float = 0.7, measure: str = "edits",
) -> DataFrame:
    """``(scope, proposal, title, tier, ratio)`` for each distinct proposal.

    ``proposed`` has (scope, proposal), ``titles`` has (scope, title, at) with ``at`` the list order.
    Equal texts win, then the first title that contains the proposal or lies in it, then the most
    similar title with ratio ≥ ``least`` (see ``fuzzy.similar_pairs`` for ``measure``). Empty texts
    match nothing.
    """
    asked = proposed.select("scope", "proposal").distinct().withColumn(
        "text", F.lower(F.trim("proposal")))
    listed = titles.select("scope", "title", "at", F.lower("title").alias("low"))
    texts = asked.select("scope", "text").filter("text <> ''").distinct()
    equal = listed.groupBy("scope", F.trim("low").alias("text")).agg(
        F.min(F.struct("at", "title")).alias("f")).join(texts, ["scope", "text"], "left_semi")
    equal = equal.select("scope", "text", "f.title", F.lit("equal").alias("tier"),
                         F.lit(1.0).alias("ratio"))
    rest = pin(texts.join(equal, ["scope", "text"], "left_anti"))
    part = pin(fuzzy.first_contained(rest, listed, SCOPE, "at").select(
        "scope", "text", "title", F.lit("part").alias("tier"), F.lit(None).cast("double").alias("ratio")))
    far = rest.join(part, ["scope", "text"], "left_anti")
    like = fuzzy.best_similar(far, listed, SCOPE, "at", least, measure).select(
        "scope", "text", "title", F.lit("similar").alias("tier"), "ratio")
    found = equal.unionByName(part).unionByName(like)
    return asked.join(found, ["scope", "text"], "left").select(
        "scope", "proposal", "title", "tier", "ratio")


def assign_titles(groups: DataFrame, matches: DataFrame, titles: DataFrame) -> DataFrame:
    """``(scope, group_id, group_name, title)`` with each title used once.

    ``groups`` has (scope, group_id, group_name, at, proposal). The first proposal, by group and
    place in it, takes a title; titles that nobody takes become groups of their own, named after
    them.
    """
    claims = groups.join(matches.filter("title is not null"), ["scope", "proposal"])
    name = clean_group_name(col("group_name"))
    first = claims.groupBy("scope", "title").agg(
        F.min(F.struct("group_id", "at", name.alias("group_name"))).alias("c"))
    taken = first.select("scope", col("c")["group_id"].alias("group_id"),
                         col("c")["group_name"].alias("group_name"), "title")
    left = titles.select("scope", "title").distinct().join(taken, ["scope", "title"], "left_anti")
    alone = left.select("scope", F.concat(F.lit("title:"), "title").alias("group_id"),
                        clean_group_name(col("title")).alias("group_name"), "title")
    return taken.withColumn("group_id", F.concat(F.lit("group:"), col("group_id").cast("string"))
                            ).unionByName(alone)


def name_edges(groups: DataFrame, above: float = 0.7, measure: str = "edits") -> DataFrame:
    """``(scope, src, dst)`` between groups with the same name or names of ratio > ``above``.

    Equal names are tied to one representative, and only distinct names are compared.
    """
    names = groups.select("scope", "group_id", "group_name").distinct()
    reps = pin(names.groupBy("scope", "group_name").agg(F.min("group_id").alias("rep")))
    same = names.join(reps, ["scope", "group_name"]).filter("group_id <> rep").select(
        "scope", F.col("group_id").alias("src"), F.col("rep").alias("dst"))
    pairs = fuzzy.similar_pairs(
        reps.select("scope", F.col("group_name").alias("left")),
        reps.select("scope", F.col("group_name").alias("right")), SCOPE, None, above, measure, once=True,
    ).filter(col("ratio") > above)
    a = reps.select("scope", F.col("group_name").alias("left"), F.col("rep").alias("src"))
    b = reps.select("scope", F.col("group_name").alias("right"), F.col("rep").alias("dst"))
    near = pairs.join(a, ["scope", "left"]).join(b, ["scope", "right"]).select("scope", "src", "dst")
    return same.unionByName(near)


#: The rarer half of a group's titles is cut off by a sketch of this accuracy, with a share on the safe side.
_SKETCH, _HALF = 1000, 0.51


def overlap_edges(members: DataFrame, above: float = 0.5, changed: DataFrame | None = None) -> DataFrame:
    """``(scope, src, dst)`` between groups whose title sets have a Jaccard index > ``above`` (≥ 0.5).

    Groups with equal sets are tied to one representative. Of the others, two sets this alike share
    a title among the rarer half of both, so only those titles are joined; the overlap of each
    found pair is then counted in full. The half is cut by a bounded sketch on the safe side, so no group
    is ranked as a whole. ``changed`` (scope, group_id) asks only for pairs with at least one of these groups.
    """
    if above < 0.5:
        raise ValueError("the half-prefix rule needs a limit of at least 0.5")
    titles = members.select("scope", "group_id", "title").distinct()
    shape = titles.groupBy("scope", "group_id").agg(
        F.count(F.lit(1)).alias("size"), F.sum(F.xxhash64("title").cast("decimal(38,0)")).alias("h1"),
        F.bit_xor(F.xxhash64(F.lit("b"), "title")).alias("h2"))
    reps = shape.groupBy("scope", "size", "h1", "h2").agg(F.min("group_id").alias("rep"))
    tied = pin(shape.join(reps, ["scope", "size", "h1", "h2"]).select("scope", "group_id", "size", "rep"))
    same = tied.filter("group_id <> rep").select(
        "scope", F.col("group_id").alias("src"), F.col("rep").alias("dst"))
    kept = tied.filter("group_id = rep").select("scope", "group_id", "size")
    sets = titles.join(kept, ["scope", "group_id"])
    often = sets.groupBy("scope", "title").agg(F.count(F.lit(1)).alias("often"))
    # rarity as one number: how often a title occurs, then its hash
    rarity = col("often") + F.pmod(F.xxhash64("title"), F.lit(2 ** 20)) / 2 ** 20
    keyed = sets.join(often, ["scope", "title"]).withColumn("rarity", rarity)
    half = keyed.groupBy("scope", "group_id").agg(F.percentile_approx("rarity", _HALF, _SKETCH).alias("upto"))
    rare = keyed.join(half, ["scope", "group_id"]).filter("rarity <= upto")
    a = rare.select("scope", "title", F.col("group_id").alias("src"), F.col("size").alias("n_src"))
    b = rare.select("scope", "title", F.col("group_id").alias("dst"), F.col("size").alias("n_dst"))
    if changed is not None:
        # a changed group may be the representative of others
        new = tied.join(changed, ["scope", "group_id"], "left_semi").select("scope", col("rep").alias("src")).distinct()
        a = a.join(new, ["scope", "src"], "left_semi")
        same = same.join(new.withColumnRenamed("src", "dst"), ["scope", "dst"], "left_semi").select("scope", "src", "dst")
    order = (col("src") < col("dst")) if changed is None else (col("src") != col("dst"))
    pairs = a.join(b, ["scope", "title"]).filter(
        order & (col("n_src") < col("n_dst") * 2) & (col("n_dst") < col("n_src") * 2)
    ).select("scope", F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"),
             F.when(col("src") < col("dst"), col("n_src")).otherwise(col("n_dst")).alias("n_src"),
             F.when(col("src") < col("dst"), col("n_dst")).otherwise(col("n_src")).alias("n_dst")).distinct()
    left = titles.select("scope", F.col("group_id").alias("src"), "title")
    right = titles.select("scope", F.col("group_id").alias("dst"), "title")
    counted = pairs.join(left, ["scope", "src"]).join(right, ["scope", "dst", "title"]).groupBy(
        "scope", "src", "dst", "n_src", "n_dst").agg(F.count(F.lit(1)).alias("common"))
    union = col("n_src") + col("n_dst") - col("common")
    return same.unionByName(counted.filter(col("common") / union > above).select("scope", "src", "dst"))


def _joined(groups: DataFrame, edges: DataFrame) -> DataFrame:
    """Groups after one round, with ``new`` where several of them became one: titles once, the longest name."""
    ends = edges.select(*(F.struct("scope", col(c).alias("group_id")).alias(c) for c in ("src", "dst")))
    found = fuzzy.components(ends).select(
        "id.scope", "id.group_id", F.col("component")["group_id"].alias("merged"))
    placed = groups.join(found, ["scope", "group_id"], "left").withColumn("group_id", F.coalesce("merged", "group_id"))
    placed = placed.withColumn("new", F.col("merged").isNotNull())
    # a name has at most 60 characters, so length and name make one small key
    names = placed.select("scope", "group_id", "group_name").distinct().groupBy("scope", "group_id").agg(F.min_by(
        "group_name", F.struct(-F.char_length("group_name"), "group_name")).alias("group_name"))
    titles = placed.groupBy("scope", "group_id", "title").agg(F.max("new").alias("new"))
    return pin(titles.join(names, ["scope", "group_id"]).select("scope", "group_id", "group_name", "title", "new"))


def merge_groups(groups: DataFrame, measure: str = "edits") -> DataFrame:
    """``(scope, group_id, group_name, title)`` after merging alike groups within a scope until nothing changes.

    A round merges along chains of alike names (ratio > 0.7) or overlapping titles (Jaccard > 0.5), whatever
    the order of the groups; a merged group has the longest name (ties: the smallest) and every title once.
    Later rounds compare the groups that the last round made with all others. Only their titles can bring
    something new: each of their names was compared with all names, and merged along, in the first round.
    """
    groups = pin(groups.select("scope", "group_id", "group_name", "title"))
    edges = pin(name_edges(groups, measure=measure).unionByName(overlap_edges(groups)))
    while not edges.isEmpty():
        groups = _joined(groups.drop("new"), edges)
        edges = pin(overlap_edges(groups, changed=groups.filter("new").select("scope", "group_id").distinct()))
    return groups.select("scope", "group_id", "group_name", "title")


def drop_singles(groups: DataFrame) -> DataFrame:
    """Without groups of one title, unless a scope has no other groups."""
    sizes = groups.groupBy("scope", "group_id").agg(F.count(F.lit(1)).alias("size"))
    several = sizes.groupBy("scope").agg(F.bool_or(col("size") > 1).alias("several"))
    kept = sizes.join(several, "scope").filter((col("size") > 1) | ~col("several"))
    return groups.join(kept.select("scope", "group_id"), ["scope", "group_id"], "left_semi")


def grouped_index(groups: DataFrame, tables: DataFrame, order: str = "table_id") -> DataFrame:
    """Tables of every topic group: ``groups`` (scope, group_name, title) joined with table infos.

    Several tables with one title are handed out one by one: the n-th mention of a title gets the
    n-th table with it.
    """
    named = groups.select("scope", "group_id", "group_name", "title")
    mentions = ordered.positions(named, ["group_id"], by=["scope", "title"], out="nth")
    infos = ordered.positions(tables, [order], by=["scope", "title"], out="nth")
    return mentions.join(infos, ["scope", "title", "nth"]).drop("nth")
