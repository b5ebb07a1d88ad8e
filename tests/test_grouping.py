"""Fuzzy matching and grouping against brute force."""

import random
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from tableworks.functions.answers import answers_match, classify_response
from tableworks.functions.similarity import block_ratio
from tableworks.operators import fuzzy, names
from tableworks.plans import grouping


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


@pytest.fixture(scope="module")
def titles():
    random.seed(5)
    base = ["".join(random.choice("abc ") for _ in range(random.randint(1, 14))).strip() or "a" for _ in range(40)]
    return sorted(set(base))


def test_similar_pairs_are_complete(spark, titles):
    df = spark.createDataFrame([("s", t) for t in titles], "scope string, t string")
    for edits, least in [(1, 0.7), (3, 0.7), (6, 0.6)]:
        got = {(r.left, r.right) for r in fuzzy.similar_pairs(
            df.withColumnRenamed("t", "left"), df.withColumnRenamed("t", "right"), ["scope"], edits, least).collect()}
        want = {(a, b) for a in titles for b in titles
                if distance(a, b) <= edits and 1 - distance(a, b) / max(len(a), len(b)) >= least - 1e-9}
        assert got == want


def test_block_pairs_are_complete(spark, titles):
    df = spark.createDataFrame([("s", t) for t in titles], "scope string, t string")
    got = {(r.left, r.right) for r in fuzzy.similar_pairs(
        df.withColumnRenamed("t", "left"), df.withColumnRenamed("t", "right"), ["scope"],
        fuzzy.edit_levels(14, 0.7, "blocks")[-1], 0.7, "blocks").collect()}
    assert got == {(a, b) for a in titles for b in titles if SequenceMatcher(None, a, b).ratio() >= 0.7}


def edit_likeness(a, b):
    return 1 - distance(a, b) / max(len(a), len(b)) + 1e-9


def block_likeness(a, b):
    return SequenceMatcher(None, a, b).ratio()


def expected(text, titles, likeness):
    low = text.lower().strip()
    for t in titles:
        if low == t.lower().strip():
            return t, "equal"
    for t in titles:
        if low in t.lower() or t.lower() in low:
            return t, "part"
    best = max(titles, key=lambda t: likeness(low, t.lower()))
    return (best, "similar") if likeness(low, best.lower()) >= 0.7 else (None, None)


@pytest.mark.parametrize("measure, likeness", [("edits", edit_likeness), ("blocks", block_likeness)])
def test_match_titles(spark, measure, likeness):
    random.seed(8)
    words = ["coal", "oil", "wind", "solar", "power", "output", "price", "share"]
    titles = sorted({" ".join(random.sample(words, random.randint(2, 4))).title() for _ in range(40)})
    random.shuffle(titles)
    asked = []
    for t in titles[:25]:
        slip = list(t)
        for _ in range(random.randint(0, 5)):
            slip[random.randrange(len(slip))] = random.choice("xyz")
        asked += ["".join(slip), t.upper(), t[:-4], t + " (new)"]
    listed = spark.createDataFrame([("s", t, i) for i, t in enumerate(titles)], "scope string, title string, at int")
    proposed = spark.createDataFrame([("s", a) for a in asked], "scope string, proposal string")
    got = {r.proposal: (r.title, r.tier) for r in grouping.match_titles(
        proposed, listed, measure=measure).collect()}
    assert got == {a: expected(a, titles, likeness) for a in asked}


def test_block_ratio(spark, titles):
    pairs = [(a, b) for a in titles[:8] for b in titles[:8]]
    df = spark.createDataFrame(pairs, "a string, b string")
    got = {(r.a, r.b): r.r for r in df.select("a", "b", block_ratio(F.col("a"), F.col("b")).alias("r")).collect()}
    assert got == {(a, b): SequenceMatcher(None, a, b).ratio() for a, b in pairs}


def test_components_of_a_chain(spark):
    nodes = spark.createDataFrame([(i,) for i in range(12)], "id int")
    edges = spark.createDataFrame([(i, i + 1) for i in range(8)] + [(11, 10)], "src int, dst int")
    got = {r.id: r.component for r in fuzzy.components(edges, nodes).collect()}
    assert got == {**{i: 0 for i in range(9)}, 9: 9, 10: 10, 11: 10}


def test_overlap_edges(spark):
    random.seed(2)
    sets = {f"g{i:02d}": frozenset(random.sample("hot abcdefg".replace(" ", ""), random.randint(1, 5))) for i in range(24)}
    rows = [("s", g, g, t) for g, ts in sets.items() for t in ts]
    df = spark.createDataFrame(rows, "scope string, group_id string, group_name string, title string")
    edges = fuzzy.components(grouping.overlap_edges(df).select("src", "dst"),
                             df.select(F.col("group_id").alias("id")).distinct())
    got = {r.id: r.component for r in edges.collect()}
    want = {g: g for g in sets}
    for _ in sets:
        for a in sets:
            for b in sets:
                if len(sets[a] & sets[b]) / len(sets[a] | sets[b]) > 0.5:
                    want[a] = want[b] = min(want[a], want[b])
    assert got == want


def test_single_groups_stay_when_all_are_single(spark):
    df = spark.createDataFrame([("x", "g1", "a"), ("x", "g1", "b"), ("x", "g2", "c"), ("y", "g3", "d")],
                               "scope string, group_id string, title string")
    assert {r.group_id for r in grouping.drop_singles(df).collect()} == {"g1", "g3"}


def test_align(spark):
    headers = spark.createDataFrame([("t", ["Entity", "GDP per  capita", "gdp growth rate", "Year"])],
                                    "table_id string, columns array<string>")
    asked = ["Year", " ENTITY ", '"gdp growth rate"', "GDP per capita", "growth of the gdp", "nothing"]
    df = spark.createDataFrame([(i, "t", a) for i, a in enumerate(asked)], "req_id int, table_id string, name string")
    got = {r.name: (r.column_name, r.tier) for r in names.align(df, headers).collect()}
    assert got == {"Year": ("Year", "exact"), " ENTITY ": ("Entity", "case"),
                   '"gdp growth rate"': ("gdp growth rate", "quotes"), "GDP per capita": ("GDP per  capita", "spaces"),
                   "growth of the gdp": ("gdp growth rate", "words"), "nothing": (None, None)}


def test_answers(spark):
    pairs = {("Yes", "true."): True, ("three", "3"): True, ("a, b", "B ,a,a!"): True, ("a", "b"): False,
             ("3.0", " 3 "): True, (None, "x"): False, ("No", "true"): False}
    df = spark.createDataFrame(list(pairs), "g string, a string")
    got = {(r.g, r.a): r.m for r in df.select("g", "a", answers_match(F.col("g"), F.col("a")).alias("m")).collect()}
    assert got == pairs


def test_responses(spark):
    cases = {
        "": ("ERROR", "FORMAT_NO_BLOCK"), "just words": ("ERROR", "FORMAT_NO_BLOCK"),
        "PLAN\nload(t)\nEND PLAN": ("PLAN", "load(t)"), "END\n42\nEND": ("END", "42"), "END 42": ("END", "42"),
        "**END**\n42": ("END", "42"), "## END\n42": ("END", "42"), "END\n42": ("END", "42"),
        "**PLAN**\nPLAN\nload(t)\nEND PLAN": ("PLAN", "load(t)"), "**PLAN**\nload(t)\n**END**": ("PLAN", "load(t)"),
        "PLAN\na\nEND PLAN\nPLAN\nb\nEND PLAN": ("PLAN", "a\nb"), "PLAN\nload(t)": ("PLAN", "load(t)"),
        "PLAN\na\nEND PLAN\nEND\n7\nEND": ("PLAN", "a"),
    }
    df = spark.createDataFrame([(t,) for t in cases], "t string")
    got = {r.t: (r.c.kind, r.c.content) for r in df.select("t", classify_response(F.col("t")).alias("c")).collect()}
    assert got == cases
    later = df.filter("t like '%7%'").select(classify_response(F.col("t"), True).alias("c")).first().c
    assert (later.kind, later.content) == ("END", "7")


def test_candidates_are_few(spark):
    """Pieces met by length, number and text leave few pairs that are not similar."""
    names = spark.read.parquet("/root/testdata/sf0.01/part.parquet").selectExpr(
        "p_brand as scope", "concat(p_type, ' ', p_name) as name").distinct()
    left, right = names.selectExpr("scope", "name as left"), names.selectExpr("scope", "name as right")
    found = fuzzy.similar_pairs(left, right, ["scope"], None, 0.8)
    assert fuzzy.candidate_pairs(left, right, ["scope"], None, 0.8).count() <= 20 * found.count()


def test_merging_goes_on_until_nothing_changes(spark):
    titles = {"A": "1234", "B": "5678", "C": "123567", "D": "1235679XY"}
    names = {"A": "alpha group one", "B": "alpha group two", "C": "zzzz", "D": "qqqqqqqqqqqqqqqq"}
    rows = [("s", g, names[g], t) for g, ts in titles.items() for t in ts]
    df = spark.createDataFrame(rows, "scope string, group_id string, group_name string, title string")
    first = grouping.name_edges(df).unionByName(grouping.overlap_edges(df)).select("src", "dst")
    assert {r.component for r in fuzzy.components(first).collect()} == {"A", "C"}  # two groups after one round
    got = {(r.group_id, r.title) for r in grouping.merge_groups(df).collect()}
    assert got == {("A", t) for t in "123456789XY"}


def test_candidates_of_unlike_texts_are_few(spark):
    """Random texts of one length: as many pieces as that length asks for, not as longer partners would."""
    texts = spark.range(300).selectExpr("'s' as scope", "md5(cast(id as string)) as t")
    pairs = fuzzy.candidate_pairs(texts.withColumnRenamed("t", "left"), texts.withColumnRenamed("t", "right"),
                                  ["scope"], None, 0.7)
    assert pairs.filter("left < right").count() < 0.1 * 300 * 299 / 2


def test_exploded_texts_are_never_broadcast(spark):
    """Substrings and pieces look as small as the texts they are cut from; only the texts may be broadcast."""
    texts = spark.range(20).selectExpr("'s' as scope", "concat('title number ', id) as text")
    pairs = fuzzy.candidate_pairs(texts.withColumnRenamed("text", "left"), texts.withColumnRenamed("text", "right"), ["scope"], 4, 0.7)
    plan = pairs._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan
    listed = texts.select("scope", F.col("text").alias("title"), F.col("text").alias("low"), F.length("text").alias("at"))
    found = fuzzy.first_contained(texts, listed, ["scope"], "at")
    joins = [line for line in found._jdf.queryExecution().executedPlan().toString().splitlines() if "Join [" in line]
    assert len(joins) == 2 and all("SortMergeJoin" in line or "LeftSemi, BuildRight" in line for line in joins)
    assert found.count() == 20


def test_few_labels_are_broadcast_in_every_round(spark, monkeypatch):
    """A round over few labels shuffles the offers only, whatever Spark thinks of the sizes."""
    plans, pin = [], fuzzy.pin
    monkeypatch.setattr(fuzzy, "pin", lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or pin(df))
    key = "spark.sql.autoBroadcastJoinThreshold"
    spark.conf.set(key, "-1")
    try:
        found = {(r.id, r.component) for r in fuzzy.components(spark.range(30).selectExpr("id as src", "id + 1 as dst")).collect()}
    finally:
        spark.conf.unset(key)
    assert found == {(i, 0) for i in range(31)}
    assert len(plans) > 3 and not any("SortMergeJoin" in plan for plan in plans)


def test_pairs_of_one_list_come_once(spark, titles):
    """Each pair once, the smaller text left, for every level of likeness and texts of all lengths."""
    more = titles + ["ü" + t for t in titles[:5]] + ["x" * 9, "x" * 12]
    df = spark.createDataFrame([(s, t) for s in ("s", "t") for t in more], "scope string, t string")
    for edits, least in [(None, 0.7), (2, 0.5)]:
        got = sorted((r.scope, r.left, r.right) for r in fuzzy.similar_pairs(
            df.withColumnRenamed("t", "left"), df.withColumnRenamed("t", "right"), ["scope"], edits, least, once=True).collect())
        want = sorted((s, a, b) for s in ("s", "t") for a in more for b in more if a < b
                      and distance(a, b) <= (edits or 99) and 1 - distance(a, b) / max(len(a), len(b)) >= least - 1e-9)
        assert got == want


def test_pairs_are_compared_where_they_meet(spark):
    """Unlike pairs that share a piece do not travel, and pieces are cut only for lengths that occur."""
    texts = spark.range(200).selectExpr("'s' as scope", "md5(cast(id as string)) as t")
    left, right = texts.withColumnRenamed("t", "left"), texts.withColumnRenamed("t", "right")
    plan = fuzzy.similar_pairs(left, right, ["scope"], None, 0.7)._jdf.queryExecution().optimizedPlan().toString()
    assert all("levenshtein" in line for line in plan.splitlines() if "Join Inner" in line)
    met = fuzzy._meeting(left, right, ["scope"], None, 0.7, "edits", False)
    assert met.count() < 200 * 200 * 0.05 + 200 * 50


def test_letters_are_a_bound(spark, titles):
    """Two texts never differ by more letters than edits; saturated and other letters included."""
    texts = titles + ["a" * 9, "aaabbbccc ", "üöä", "o" * 5 + "O" * 5]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    both = fuzzy._with_letters(df.withColumnRenamed("t", "left"), "left").crossJoin(
        fuzzy._with_letters(df.withColumnRenamed("t", "right"), "right"))
    rows = both.filter(fuzzy._letters_allow(F.levenshtein("left", "right"))).count()
    assert rows == len(texts) ** 2
    assert both.filter(fuzzy._letters_allow(F.lit(0))).count() < rows / 4


def _addresses(n):
    random.seed(8)
    hosts = ["www.one.example.net", "blog.two.example.com"]
    return sorted({f"https://{random.choice(hosts)}/{random.choice(['en', 'de'])}/{random.randint(1, 99999)}" for _ in range(n)})


def _slipped(text, edits):
    for _ in range(edits):
        i = random.randrange(len(text))
        text = random.choice([text[:i] + text[i + 1:], text[:i] + "q" + text[i:], text[:i] + random.choice("q7e") + text[i + 1:]])
    return text


@pytest.mark.parametrize("often", [1_000, 2])
def test_addresses_match_like_brute_force(spark, often, monkeypatch):
    """Long texts that share most of their characters: equal, inner, outer, near and far ones, with rare and frequent grams."""
    monkeypatch.setattr(fuzzy, "OFTEN", often)
    listed = _addresses(60)
    asked = [_slipped(t, i % 8) for i, t in enumerate(listed)]
    asked += [listed[3][8:], "see " + listed[4], listed[5] + "/x", "/en/", "one", "https://", "x" * 40, "", " " + listed[6].upper()]
    listed += ["two", "net/"]
    titles = spark.createDataFrame([("s", t, i) for i, t in enumerate(listed)], "scope string, title string, at int")
    texts = spark.createDataFrame([("s", t) for t in set(asked)] + [(None, listed[0])], "scope string, proposal string")
    got = {r.proposal: (r.title, r.tier) for r in grouping.match_titles(texts, titles).filter("scope is not null").collect()}
    want = {}
    for t in asked:
        low = t.lower().strip()
        equal, part = [x for x in listed if x == low], [x for x in listed if low and (low in x or x in low)]
        like = [(-edit_likeness(low, x), i, x) for i, x in enumerate(listed) if low and 1 - distance(low, x) / max(len(low), len(x)) >= 0.7]
        want[t] = (equal[0], "equal") if equal else (part[0], "part") if part else (min(like)[2], "similar") if like else (None, None)
    assert got == want


def test_addresses_of_one_host_are_not_all_compared(spark, monkeypatch):
    """Slips in the part that all addresses share are looked up by the part that they do not share."""
    listed = [f"https://www.one.example.net/en/{i * 7919 % 90000 + 10000}" for i in range(400)]
    titles = spark.createDataFrame([("s", t, t, i) for i, t in enumerate(listed)], "scope string, title string, low string, at int")
    texts = spark.createDataFrame([("s", t.replace("https", "htps").replace("example", "exampel")) for t in listed], "scope string, text string")
    met, close = [], fuzzy._close
    monkeypatch.setattr(fuzzy, "_close", lambda df, *a, **k: met.append(df.count()) or close(df, *a, **k))
    found = fuzzy.best_similar(texts, titles, ["scope"], "at")
    assert {r.title for r in found.collect()} == set(listed)
    assert sum(met) < 400 * 10
