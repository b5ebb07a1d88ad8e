"""Containment and similarity joins of short texts, exact and without comparing all pairs.

Containment becomes equality with the substrings of the longer text. Similarity uses the pigeonhole
rule: two texts within edit distance k share at least one of the k + 1 pieces of the second text, at
a place shifted by at most k.
"""

from __future__ import annotations

import functools
import math
import operator
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tableworks.functions.columns import as_columns, col
from tableworks.functions.similarity import block_ratio
from tableworks.session import are_few, pin


def _substrings(text: Column, lengths: Column) -> Column:
    """All substrings whose length is in the array, each once."""
    of_length = lambda n: F.transform(
        F.sequence(F.lit(1), F.char_length(text) - n + 1), lambda i: F.substr(text, i, n))
    fitting = F.filter(lengths, lambda n: n <= F.char_length(text))
    return F.array_distinct(F.flatten(F.transform(fitting, of_length)))


#: Texts of at least so many characters are looked up by substrings of that length, the rarest ones first, unless
#: even the rarest is in more than ``OFTEN`` texts.
GRAM, OFTEN = 6, 1_000


def _grams(text: Column) -> Column:
    """Digests of all substrings of ``GRAM`` characters, in order."""
    starts = F.sequence(F.lit(1), F.char_length(text) - GRAM + 1)
    return F.when(F.char_length(text) >= GRAM, F.transform(starts, lambda i: F.xxhash64(F.substr(text, i, F.lit(GRAM))))
                  ).otherwise(F.array().cast("array<bigint>"))


def _holding(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """The rows with a wanted ``_key``, pinned, where the keys can be broadcast; else all: the join to come drops them."""
    keys = wanted.select("_key").distinct()
    return pin(rows.join(F.broadcast(keys), "_key", "left_semi")) if are_few(keys, 1_000_000) else rows


def _lying_in(inner: DataFrame, outer: DataFrame, by: list[str]) -> tuple[DataFrame, DataFrame]:
    """``(by…, inner, outer, _first)`` of the texts that lie in another one, found by the rarest gram of the inner text, and
    the inner texts left to do: they are too short for that or have frequent grams only.

    ``inner`` has (by…, inner) and ``outer`` (by…, outer), each text once; one of them has ``_first`` too.
    """
    held = _spread(outer, *by, "outer").select(*as_columns(outer.columns), F.explode(F.array_distinct(_grams(col("outer")))).alias("_key"))
    often = held.groupBy(*as_columns(by), "_key").agg(F.count(F.lit(1)).alias("often"))
    grams = _spread(inner.filter(F.char_length("inner") >= GRAM), *by, "inner").withColumn("_grams", F.array_distinct(_grams(col("inner"))))
    asked = grams.select(*as_columns(inner.columns), F.size("_grams").alias("grams"), F.explode("_grams").alias("_key"))
    kept = [F.min(c).alias(c) for c in inner.columns if c == "_first"]
    # a gram that no outer text has settles it
    rarest = pin(asked.join(often.hint("merge"), ["_key", *by]).groupBy(*as_columns(by), "inner").agg(
        F.count(F.lit(1)).alias("found"), F.max("grams").alias("grams"), F.min(F.struct("often", "_key")).alias("r"), *kept
    ).filter("found = grams").select(*as_columns(inner.columns), "r.*"))
    rare = rarest.filter(col("often") <= OFTEN).drop("often")
    rest = inner.filter(F.char_length("inner").between(1, GRAM - 1)).unionByName(
        rarest.filter(col("often") > OFTEN).select(*as_columns(inner.columns)))
    met = rare.join(_holding(held, rare).hint("merge"), ["_key", *by]).filter(F.contains("outer", "inner"))
    return met.select(*as_columns(by), "inner", "outer", "_first"), rest


def first_contained(
    texts: DataFrame, titles: DataFrame, by: list[str], order: str,
) -> DataFrame:
    """For each text the first title that contains it or lies in it: ``(by…, text, order, title)``.

    ``titles`` is (by…, title, low, order) with ``low`` the form to compare. The inner text is looked up by its
    rarest substring of ``GRAM`` characters among the outer texts. For short and frequent inner texts containment becomes
    equality with the substrings of the outer texts that have their lengths; there the titles that contain a text are
    reduced to the first one per substring before the join, on the map side. Substrings look as small as the texts
    they come from when the join is planned, so they are kept from being broadcast.
    """
    wanted = pin(texts.filter("text <> ''").select(*as_columns(by), "text").distinct())
    shapes = pin(titles.filter("low <> ''").groupBy(*as_columns(by), "low").agg(F.min(F.struct(order, "title")).alias("_first")))
    first = lambda df: df.groupBy(*as_columns(by), "text").agg(F.min("_first").alias("_first"))
    cut = lambda df, text, sizes, out: _spread(df, *by, text).withColumn("_sizes", sizes).select(
        *as_columns(df.columns), F.explode(_substrings(col(text), col("_sizes"))).alias(out))

    above, rest = _lying_in(wanted.withColumnRenamed("text", "inner"), shapes.withColumnRenamed("low", "outer"), by)
    found = first(above.withColumnRenamed("inner", "text"))
    if not rest.isEmpty():
        rest = pin(rest.withColumnRenamed("inner", "text"))
        sizes = rest.agg(F.collect_set(F.char_length("text"))).scalar()
        # only substrings that are asked for travel on; then one row per text
        found = found.unionByName(first(cut(shapes, "low", sizes, "text").join(rest, [*by, "text"], "left_semi")))
    below, rest = _lying_in(shapes.withColumnRenamed("low", "inner"), wanted.withColumnRenamed("text", "outer"), by)
    found = found.unionByName(first(below.withColumnRenamed("outer", "text")))
    if not rest.isEmpty():
        rest = pin(rest.withColumnRenamed("inner", "low"))
        sizes = rest.agg(F.collect_set(F.char_length("low"))).scalar()
        found = found.unionByName(first(cut(wanted, "text", sizes, "low").join(rest.hint("merge"), [*by, "low"])))
    return first(found).select(*as_columns(by), "text", "_first.*")


def _slack(least: float, measure: str) -> float:
    """Edits per character that a text may need to reach a partner with ratio ≥ ``least``.

    With ratio 1 − d / longer: d ≤ (1 − r)(len + d). With the matching-block ratio, whose unmatched
    characters bound the edits: d ≤ (1 − r)(2·len + d).
    """
    if measure not in ("edits", "blocks"):
        raise ValueError("measure must be 'edits' or 'blocks'")
    return (1 if measure == "edits" else 2) * (1 - least) / least


def _most_edits(length: Column, slack: float) -> Column:
    """Largest distance a text of this length can have to any partner."""
    return F.floor(length * F.lit(slack) + 1e-9).cast("int")


def _edits_of(size: Column, edits: int | None, slack: float) -> Column:
    """How many edits the pieces of a text of this length allow for: one piece more than that."""
    most = F.greatest(F.least(_most_edits(size, slack), size - 1), F.lit(0))
    return most if edits is None else F.least(F.lit(edits), most)


def _piece_start(size: Column, i: Column, n: Column) -> Column:
    """Start (from 0) of piece ``i`` (from 0) of a text cut into ``n`` almost equal pieces."""
    return F.floor(size * i / n).cast("int")


def _pieces(text: Column, edits: Column) -> Column:
    """The text cut into k + 1 almost equal pieces for each k of ``edits``, as (k, no, piece)."""
    size = F.char_length(text)

    def cut(k: Column) -> Column:
        start = lambda i: _piece_start(size, i, k + 1)
        return F.transform(F.sequence(F.lit(0), k), lambda i: F.struct(
            k.alias("k"), i.alias("no"), F.substr(text, start(i) + 1, start(i + 1) - start(i)).alias("piece")))

    return F.flatten(F.transform(edits, cut))


def _probes(text: Column, lengths: Column, edits_to: Callable[[Column], Column]) -> Column:
    """The substrings of a text that could be a piece of a similar text of one of these lengths, as (size, k, no, piece).

    The pieces are as long as the edits that these two lengths may be apart allow (``edits_to``), not as the partner's
    length alone would have them. For a partner of length ``n``, piece number ``i`` can only be found where neither the
    pieces before it nor those behind it would need more edits than are left for them (otherwise another piece matches),
    which leaves few starts on both sides of its own.
    """
    size = F.char_length(text)

    def of_length(n: Column) -> Column:
        k, delta = edits_to(n), size - n

        def of_piece(i: Column) -> Column:
            start = _piece_start(n, i, k + 1)
            length = _piece_start(n, i + 1, k + 1) - start
            first = F.greatest(F.lit(0), start - i, start + delta - (k - i))
            last = F.least(size - length, start + i, start + delta + (k - i))
            at = F.when(first <= last, F.sequence(first, last)).otherwise(F.array().cast("array<int>"))
            return F.array_distinct(F.transform(at, lambda p: F.struct(
                n.alias("size"), k.alias("k"), i.alias("no"), F.substr(text, p + 1, length).alias("piece"))))

        return F.flatten(F.transform(F.sequence(F.lit(0), k), of_piece))

    return F.flatten(F.transform(lengths, of_length))


def _allowed(left: Column, right: Column, edits: int | None, least: float, measure: str) -> Column:
    """Edits that two texts of these lengths may be apart."""
    shared = F.greatest(left, right) if measure == "edits" else left + right
    most = F.floor(shared * F.lit(1 - least) + 1e-9).cast("int")
    return most if edits is None else F.least(F.lit(edits), most)


def _edits_between(left: Column, right: Column, edits: int | None, least: float, slack: float, measure: str) -> Column:
    """Edits that the pieces of the right text allow for when the left one has this length."""
    return F.least(_edits_of(right, edits, slack), _allowed(left, right, edits, least, measure))


def _spread(df: DataFrame, *columns: str) -> DataFrame:
    """Few rows that become many each: dealt over several tasks a core, however few files they come from."""
    return df.repartition(4 * df.sparkSession.sparkContext.defaultParallelism, *as_columns(columns))


def _meeting(
    left: DataFrame, right: DataFrame, by: list[str], edits: int | None, least: float, measure: str, once: bool,
) -> DataFrame:
    """``(by…, left, right)`` and the other columns of both sides for every piece that two texts share, met by a digest of
    (length of the right text, edits between the two lengths, number of the piece, piece). Only lengths that occur are
    asked for; with ``once`` the left text is not the shorter one. Neither side is
    broadcast: pieces look as small as their texts when the join is planned."""
    slack = _slack(least, measure)
    key = lambda size, p: F.xxhash64(size, p["k"], p["no"], p["piece"]).alias("_key")
    sizes = lambda df, name: df.agg(F.sort_array(F.collect_set(F.char_length(name)))).scalar()
    mine, other = F.char_length("left"), F.char_length("right")
    between = lambda m, n: _edits_between(m, n, edits, least, slack, measure)
    near = lambda m, n: (F.abs(m - n) <= between(m, n)) & ((m >= n) if once else F.lit(True))
    probes = _spread(left, *by, "left").withColumn("_sizes", sizes(right, "right"))
    found = _probes(col("left"), F.filter("_sizes", lambda n: (n > 0) & near(mine, n)), lambda n: between(mine, n))
    probes = probes.select(*as_columns(left.columns), F.explode(found).alias("p")).select(
        *as_columns(left.columns), key(col("p")["size"], col("p")))
    pieces = _spread(right, *by, "right").withColumn("_sizes", sizes(left, "left"))
    asked = F.array_distinct(F.transform(F.filter("_sizes", lambda m: near(m, other)), lambda m: between(m, other)))
    pieces = pieces.select(*as_columns(right.columns), F.explode(_pieces(col("right"), asked)).alias("q")).select(
        *as_columns(right.columns), key(other, col("q")))
    return probes.join(pieces.hint("merge"), ["_key", *by]).drop("_key")


def candidate_pairs(
    left: DataFrame, right: DataFrame, by: list[str], edits: int | None, least: float, measure: str = "edits",
) -> DataFrame:
    """``(by…, left, right)`` of the texts that share a piece where similar texts share one."""
    return _meeting(left, right, by, edits, least, measure, False).distinct()


def _letters(kinds: Column) -> Column:
    """A number whose bits say how often each of 16 kinds of characters occurs, up to four times: four bits a kind."""
    shift = lambda number, n: F.call_function("shiftleft", number, n)

    def more(seen: Column, kind: Column) -> Column:
        first, four = (shift(F.lit(n).cast("long"), kind * 4) for n in (1, 15))
        return seen.bitwiseOR(first).bitwiseOR(shift(seen.bitwiseAND(four), F.lit(1)).bitwiseAND(four))

    return F.aggregate(kinds, F.lit(0).cast("long"), more)


def _with_letters(df: DataFrame, text: str) -> DataFrame:
    """With the length and the letters of a text, 32 kinds of them."""
    kinds = df.withColumn("_kinds", F.transform(F.split(text, ""), lambda c: F.ascii(c).bitwiseAND(31)))
    return kinds.select(
        *as_columns(df.columns), F.char_length(text).alias(f"_{text}0"), _letters(F.filter("_kinds", lambda k: k < 16)).alias(f"_{text}1"),
        _letters(F.transform(F.filter("_kinds", lambda k: k >= 16), lambda k: k - 16)).alias(f"_{text}2"))


def _letters_allow(allowed: Column) -> Column:
    """Whether the letters of two texts differ by no more than so many edits explain: an edit puts one in the place of one."""
    more = lambda a, b: functools.reduce(operator.add, [
        F.bit_count(col(f"_{a}{i}").bitwiseAND(F.bitwise_not(f"_{b}{i}"))) for i in (1, 2)])
    return (more("left", "right") <= allowed) & (more("right", "left") <= allowed)


def similar_pairs(
    left: DataFrame, right: DataFrame, by: list[str], edits: int | None, least: float,
    measure: str = "edits", once: bool = False,
) -> DataFrame:
    """All pairs within ``edits`` edits (any number if None) and ratio ≥ ``least``: ``(by…, left, right, ratio)``.

    ``left`` has (by…, left), ``right`` has (by…, right); texts are distinct per group. ``measure``
    is ``edits`` (1 − distance / longer length) or ``blocks`` (matching blocks, compared in Python
    for the pairs that are within the distance). Empty texts are similar to nothing. Pairs that meet are compared
    where they meet, so only similar ones travel on. ``once`` is for two times the same texts: each pair comes once,
    the smaller text left.
    """
    met = _meeting(_with_letters(left.select(*as_columns(by), "left"), "left"),
                   _with_letters(right.select(*as_columns(by), "right"), "right"), by, edits, least, measure, once)
    return _close(met, by, edits, least, measure, once)


def _close(
    met: DataFrame, by: list[str], edits: int | None, least: float, measure: str, once: bool = False, letters: bool = True,
) -> DataFrame:
    """The pairs of :func:`similar_pairs` among pairs that met, with the lengths and, for a first test, the letters of both."""
    sizes = [col("_left0"), col("_right0")]
    allowed = _allowed(*sizes, edits, least, measure)
    apart = F.call_function("levenshtein", col("left"), col("right"), allowed)
    ends = [F.least("left", "right").alias("left"), F.greatest("left", "right").alias("right")] if once else ["left", "right"]
    close = met.filter(_letters_allow(allowed)) if letters else met
    if once:
        close = close.filter((sizes[0] > sizes[1]) | (col("left") < col("right")))
    close = close.filter(apart >= 0).select(*as_columns(by), *as_columns(ends)).distinct()
    if measure == "edits":
        return close.withColumn("ratio", 1 - F.levenshtein("left", "right") / F.greatest(F.char_length("left"), F.char_length("right")))
    return close.withColumn("ratio", block_ratio(col("left"), col("right"))).filter(
        col("ratio") >= least)


def edit_levels(longest: int, least: float, measure: str = "edits") -> list[int]:
    """Distances to try in turn: 1, 4, 16, … up to what the longest text allows. Between 1 and 4 all those that texts
    of this length are looked up by grams for."""
    most = int(longest * _slack(least, measure) + 1e-9)
    levels, step = [], 1
    while step < most:
        levels.append(step)
        step = step * 4 if step >= 4 else step + 1 if longest >= GRAM * (step + 2) else 4
    return levels + [most] if most else []


@F.pandas_udf(T.ArrayType(T.IntegerType()))
def _fewest_hits(often: pd.Series, pieces: pd.Series) -> pd.Series:
    """Places (from 0) of so many disjoint grams that together are in the fewest texts."""
    def chosen(counts: list[int], n: int) -> list[int]:
        size = len(counts)
        # best[j][i]: fewest hits of j grams from place i on
        best = [[0] * (size + GRAM)] + [[math.inf] * (size + GRAM) for _ in range(n)]
        for j in range(1, n + 1):
            row, fewer = best[j], best[j - 1]
            for i in range(size - 1, -1, -1):
                row[i] = min(row[i + 1], counts[i] + fewer[i + GRAM])
        places, i = [], 0
        for j in range(n, 0, -1):
            while best[j][i] == best[j][i + 1]:
                i += 1
            places.append(i)
            i += GRAM
        return places

    return pd.Series([chosen(list(c), n) for c, n in zip(often, pieces)])


def _with_often(texts: DataFrame, titles: DataFrame, by: list[str]) -> DataFrame:
    """``texts`` (by…, text) with ``_often``: for each gram in how many places of ``titles`` (by…, right) it is found."""
    held = _spread(titles, *by, "right").select(*as_columns(by), F.explode(_grams(col("right"))).alias("_key"))
    often = held.groupBy(*as_columns(by), "_key").agg(F.count(F.lit(1)).alias("often"))
    asked = _spread(texts, *by, "text").select(*as_columns(by), "text", F.posexplode_outer(_grams(col("text"))).alias("at", "_key"))
    counted = asked.join(often.hint("merge"), ["_key", *by], "left").groupBy(*as_columns(by), "text").agg(
        F.array_sort(F.collect_list(F.struct("at", F.coalesce("often", F.lit(0)).alias("often")))).alias("o"))
    return counted.select(*as_columns(by), "text", F.transform("o", lambda x: x["often"]).alias("_often"))


def _close_by_grams(
    texts: DataFrame, titles: DataFrame, by: list[str], edits: int, least: float, measure: str,
) -> DataFrame:
    """:func:`similar_pairs` for texts (by…, text, _often) that have room for a gram more than ``edits``.

    So many edits leave one of ``edits`` + 1 disjoint grams of a text as it is, at a place shifted by at most ``edits``.
    Those that together are the rarest are looked up; a gram that no title has meets nothing, and costs an edit.
    """
    picked = texts.withColumn("_at", _fewest_hits("_often", F.lit(edits + 1)))
    picked = picked.withColumn("_keys", _grams(col("text"))).select(
        *as_columns(by), col("text").alias("left"), "_often", "_keys", F.explode("_at").alias("_at")
    ).filter(F.get("_often", col("_at")) > 0).select(*as_columns(by), "left", "_at", F.get("_keys", col("_at")).alias("_key"))
    picked = pin(picked)
    held = _spread(titles, *by, "right").select(
        *as_columns(by), "right", F.posexplode(_grams(col("right"))).alias("_place", "_key"))
    met = picked.join(_holding(held, picked).hint("merge"), ["_key", *by]).filter(F.abs(col("_at") - col("_place")) <= edits)
    met = met.select(*as_columns(by), "left", "right", F.char_length("left").alias("_left0"), F.char_length("right").alias("_right0"))
    return _close(met.filter(F.abs(col("_left0") - col("_right0")) <= edits), by, edits, least, measure, letters=False)


def best_similar(
    texts: DataFrame, titles: DataFrame, by: list[str], order: str, least: float = 0.7,
    measure: str = "edits",
) -> DataFrame:
    """For each text the most similar title with ratio ≥ ``least``, ties by title order.

    Small distances are tried first. A text is settled as soon as no title further away could have
    a better ratio, so only texts without a close title reach the wide comparisons. Up to four edits long texts are
    looked up by rare grams, short ones and wide distances by pieces.
    """
    wanted = pin(texts.select(*as_columns(by), "text").distinct())
    shapes = pin(titles.groupBy(*as_columns(by), F.col("low").alias("right")).agg(
        F.min(F.struct(order, "title")).alias("_first")))
    listed = shapes.select(*as_columns(by), "right")
    longest = wanted.agg(F.max(F.char_length("text"))).first()[0] or 0
    open_texts, found = pin(_with_often(wanted, listed, by)), None
    size = F.char_length("text")
    for edits in edit_levels(longest, least, measure):
        if open_texts.isEmpty():
            break
        short = open_texts if edits > 4 else open_texts.filter(size < GRAM * (edits + 1))
        pairs = None
        if not short.isEmpty():
            pairs = similar_pairs(short.select(*as_columns(by), F.col("text").alias("left")), listed, by, edits, least, measure)
        if edits <= 4 and longest >= GRAM * (edits + 1):
            by_grams = _close_by_grams(open_texts.filter(size >= GRAM * (edits + 1)), listed, by, edits, least, measure)
            pairs = by_grams if pairs is None else pairs.unionByName(by_grams)
        best = pairs.join(shapes, [*by, "right"]).groupBy(
            *as_columns(by), F.col("left").alias("text")).agg(
            F.min(F.struct((-col("ratio")).alias("key"), col("_first").alias("first"))).alias("b"))
        best = best.select(*as_columns(by), "text", (-col("b")["key"]).alias("ratio"),
                           col("b")["first"].alias("_first"))
        # a title with more edits is at best this similar
        whole = size if measure == "edits" else size * 2
        settled = col("ratio") > whole / (whole + edits + 1) + 1e-9
        joined = pin(open_texts.join(best, [*by, "text"], "left").withColumn(
            "_done", F.coalesce(settled, F.lit(False)) | (_most_edits(size, _slack(least, measure)) <= edits)))
        part = joined.filter(col("_done") & col("ratio").isNotNull()).drop("_done", "_often")
        found = part if found is None else found.unionByName(part)
        open_texts = joined.filter(~col("_done")).select(*as_columns(by), "text", "_often")
    if found is None:
        return wanted.limit(0).select("*", F.lit(None).cast("double").alias("ratio"),
                                      F.lit(None).cast(titles.schema[order].dataType).alias(order),
                                      F.lit(None).cast("string").alias("title"))
    return found.select(*as_columns(by), "text", "ratio", "_first.*")


def components(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """``(id, component)``: the smallest id reachable over the edges (src, dst).

    Without ``nodes`` only ids that occur in an edge are listed. Each round takes the smallest label among
    the neighbours and then the label of that label, so long chains shrink quickly. Labels are pinned
    every round together with the old ones; the loop ends when nothing changes. Labels that are counted as
    few are broadcast, as a round of many small shuffles takes more files and time than its rows are worth.
    """
    both = pin(edges.select("src", "dst").unionByName(
        edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct())
    # the first round needs no labels: every id starts as its own
    labels = pin(both.groupBy("src").agg(F.min("dst").alias("offer")).select(
        F.col("src").alias("id"), F.least("src", "offer").alias("component")))
    # there are as many labels in every round
    near = F.broadcast if are_few(labels) else lambda df: df
    while True:
        offered = both.join(near(labels), both["dst"] == labels["id"]).groupBy("src").agg(
            F.min("component").alias("offer"))
        lower = near(labels).join(offered, labels["id"] == offered["src"]).select(
            "id", F.col("component").alias("before"), F.least("component", "offer").alias("component"))
        jump = lower.select(F.col("id").alias("_to"), F.col("component").alias("_next"))
        moved = pin(lower.join(near(jump), lower["component"] == jump["_to"]).select(
            "id", "before", F.least("component", "_next").alias("component")))
        labels = moved.select("id", "component")
        if moved.filter("component <> before").isEmpty():
            break
    if nodes is None:
        return labels
    return nodes.select("id").join(labels, "id", "left").select("id", F.coalesce("component", "id").alias("component"))
