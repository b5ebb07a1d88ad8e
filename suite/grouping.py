"""Topic groups of titles: matching, assignment, merging and the grouped index."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from suite import read
from tableworks.functions.columns import col
from tableworks.functions.similarity import edit_ratio
from tableworks.functions.text import clean_group_name
from tableworks.operators import fuzzy
from tableworks.plans import grouping


def clean_group_names(spark, folder):
    """Group names from whole pages addresses and part names."""
    pages = read(spark, folder, "pages").select("page_id", col("url").alias("raw"))
    return pages.select("page_id", clean_group_name(col("raw")).alias("name"))


def edit_ratios(spark, folder):
    """Likeness of each part's name and its type and brand."""
    df = read(spark, folder, "part")
    return df.select("p_partkey", F.round(edit_ratio(F.lower("p_type"), col("p_name")), 6).alias("by_type"),
                     F.round(edit_ratio(F.lower("p_brand"), col("p_name")), 6).alias("by_brand"))


# Proposed spellings of part names: exact, upper case, a part of it, longer, one letter off, far off.
_SPELLED = """case when p_size < 8 then p_name when p_size < 16 then concat(' ', upper(p_name), ' ')
  when p_size < 24 then split_part(p_name, ' ', 2) when p_size < 32 then concat('all ', p_name, 's here')
  when p_size < 40 then replace(replace(p_name, 'i', 'e'), 'o', 'u')
  when p_size < 46 then concat(replace(p_name, ' ', ''), 'x') else lower(p_type) end"""


def _titles(spark, folder):
    """Distinct part names per type, listed by their first part."""
    return read(spark, folder, "part").groupBy(col("p_type").alias("scope"), col("p_name").alias("title")).agg(
        F.min("p_partkey").alias("at"))


def _proposals(spark, folder):
    return read(spark, folder, "part").select(
        col("p_type").alias("scope"), F.expr(_SPELLED).alias("proposal"), "p_partkey", "p_brand")


def match_titles(spark, folder):
    df = grouping.match_titles(_proposals(spark, folder), _titles(spark, folder))
    return df.withColumn("ratio", F.round("ratio", 6))


# Page addresses with one or two slips, or cut down to their middle.
_SLIPPED = """case when page_id % 5 = 0 then replace(url, 'example', 'exmple')
  when page_id % 5 = 1 then replace(replace(url, 'example', 'exampel'), 'http', 'htp')
  when page_id % 5 = 2 then upper(url) when page_id % 5 = 3 then regexp_replace(url, '^https?://', '')
  else concat('see ', url) end"""


def match_page_titles(spark, folder):
    """Every page's mistyped address matched against all addresses."""
    pages = read(spark, folder, "pages")
    titles = pages.groupBy(F.lit("pages").alias("scope"), col("url").alias("title")).agg(F.min("page_id").alias("at"))
    asked = pages.select(F.lit("pages").alias("scope"), F.expr(_SLIPPED).alias("proposal"))
    df = grouping.match_titles(asked, titles)
    return df.withColumn("ratio", F.round("ratio", 6))


def assign_titles(spark, folder):
    """Each title goes to the first brand that proposed it; the rest stand alone."""
    titles = _titles(spark, folder)
    groups = _proposals(spark, folder).select(
        "scope", col("p_brand").alias("group_id"), F.concat(F.lit("the parts of "), "p_brand").alias("group_name"),
        col("p_partkey").alias("at"), "proposal")
    matches = grouping.match_titles(groups, titles)
    return grouping.assign_titles(groups, matches, titles)


def _groups(spark, folder):
    """Parts of one brand grouped by type and noun."""
    noun = F.substring_index("p_name", " ", -1)
    return read(spark, folder, "part").select(
        col("p_brand").alias("scope"), F.concat_ws("/", "p_type", noun).alias("group_id"),
        clean_group_name(F.concat_ws(" ", "p_type", noun)).alias("group_name"), col("p_name").alias("title"),
    ).distinct()


def name_edges(spark, folder):
    df = grouping.name_edges(_groups(spark, folder))
    return df.select("scope", F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct()


def overlap_edges(spark, folder):
    """Groups with equal titles as chains, and pairs that share more than half of theirs."""
    df = grouping.overlap_edges(_groups(spark, folder))
    ids = _groups(spark, folder).select("scope", col("group_id").alias("id")).distinct()
    nodes = ids.select(F.struct("scope", "id").alias("id"))
    edges = df.select(F.struct("scope", col("src").alias("id")).alias("src"),
                      F.struct("scope", col("dst").alias("id")).alias("dst"))
    found = fuzzy.components(edges, nodes)
    return found.select("id.scope", "id.id", col("component")["id"].alias("component"))


def merge_groups(spark, folder):
    return grouping.merge_groups(_groups(spark, folder)).select("scope", "group_name", "title")


#: Groups over blocks of twelve parts: which parts a group has. A and B have alike names; C and D overlap
#: enough with both together only, E only with all of them, so merging takes three rounds.
_CHAIN = {"A": [0, 1, 2, 3], "B": [4, 5, 6, 7], "C": [0, 1, 2, 4, 5, 6], "D": [0, 1, 2, 4, 5, 6, 8, 9, 10],
          "E": [0, 1, 3, 7, 8, 9, 10]}


def _chain_name(letter, block):
    """Names of blocks and groups are unlike, but for the last letter of A and B."""
    name = f"md5(concat({block}, '{'A' if letter == 'B' else letter}'))"
    return f"concat(substr({name}, 1, 31), 'x')" if letter == "B" else name


def _chain_select(letter, integer, whole):
    block = f"cast({whole} as {integer})"
    return [f"concat('s', {block} % 5) as scope", f"concat({block}, '-{letter}') as group_id",
            f"{_chain_name(letter, block)} as group_name", "concat('part ', p_partkey) as title"]


def merge_chains(spark, folder):
    """Groups that become alike only after others were merged."""
    part = read(spark, folder, "part")
    groups = functools.reduce(DataFrame.union, [
        part.filter((F.col("p_partkey") % 12).isin(places)).selectExpr(
            *_chain_select(letter, "bigint", "p_partkey div 12")) for letter, places in _CHAIN.items()])
    return grouping.merge_groups(groups).select("scope", "group_id", "group_name", "title")


def drop_single_groups(spark, folder):
    df = grouping.drop_singles(_groups(spark, folder))
    return df.select("scope", "group_id", "title")


def grouped_index(spark, folder):
    """Topic groups per brand with their parts; parts of one name are handed out in order."""
    tables = read(spark, folder, "part").select(
        col("p_brand").alias("scope"), col("p_name").alias("title"), col("p_partkey").alias("table_id"))
    return grouping.grouped_index(_groups(spark, folder), tables).select(
        "scope", "group_id", "title", "table_id")


def topic_index(spark, folder):
    """The whole path: merge alike groups, leave single ones, list tables by domain and topic."""
    merged = grouping.drop_singles(grouping.merge_groups(_groups(spark, folder)))
    tables = read(spark, folder, "part").select(
        col("p_brand").alias("scope"), col("p_name").alias("title"), col("p_partkey").alias("table_id"))
    return grouping.grouped_index(merged, tables).select("scope", "group_name", "title", "table_id")


QUERIES = {f.__name__: f for f in [
    clean_group_names, edit_ratios, match_titles, match_page_titles, assign_titles,
    name_edges, overlap_edges, merge_groups, merge_chains, drop_single_groups, grouped_index, topic_index,
]}


def _clean(text):
    bare = f"trim(regexp_replace({text}, '[^\\w\\s-]', '', 'g'))"
    parts = f"list_filter(string_split(regexp_replace({bare}, '\\s+', '_', 'g'), '_'), lambda w: w <> '')"
    titled = f"array_to_string(list_transform({parts}, lambda w: upper(w[1:1]) || lower(w[2:])), '_')"
    return f"""case when {titled} = '' then 'Untitled_Group' when length({titled}) > 60
      then regexp_replace(left({titled}, 60), '_[^_]*$', '') else {titled} end"""


def _match(proposals, titles):
    """Full three-tier matching by comparing everything with everything."""
    return f"""p as (select distinct scope, proposal, lower(trim(proposal)) as t from {proposals}),
      l as (select scope, title, pos, lower(title) as low from {titles}),
      x as (select p.scope, p.proposal, l.title, l.pos, trim(low) = t as eq,
        t <> '' and low <> '' and (contains(low, t) or contains(t, low)) as part,
        1 - levenshtein(t, low) / greatest(length(t), length(low)) as ratio
        from p join l on l.scope = p.scope where t <> ''),
      b as (select scope, proposal, title, case when eq then 'equal' when part then 'part' else 'similar' end as tier,
        case when eq then 1.0 when part then null else ratio end as ratio
        from x where eq or part or ratio >= 0.7 qualify row_number() over (partition by scope, proposal
          order by not eq, not part, case when eq or part then 0 else -ratio end, pos) = 1),
      m as (select p.scope, p.proposal, b.title, b.tier, b.ratio from p
        left join b on b.scope = p.scope and b.proposal = p.proposal)"""


_TITLES = "(select p_type as scope, p_name as title, min(p_partkey) as pos from part group by 1, 2)"
_PROPOSALS = f"(select p_type as scope, {_SPELLED} as proposal, p_partkey, p_brand from part)"
_PAGES = "(select 'pages' as scope, url as title, min(page_id) as pos from pages group by 2)"
_ASKED = f"(select 'pages' as scope, {_SLIPPED} as proposal from pages)"
_GROUPS = f"""(select distinct p_brand as scope, p_type || '/' || split_part(p_name, ' ', -1) as group_id,
  {_clean("p_type || ' ' || split_part(p_name, ' ', -1)")} as group_name, p_name as title from part)"""
_NAME_EDGE = "1 - levenshtein(a.group_name, b.group_name) / greatest(length(a.group_name), length(b.group_name)) > 0.7"


def _graph(k=""):
    """Names, sizes and both kinds of edges between the groups of ``g``."""
    return f"""n{k} as materialized (select distinct scope, group_id, group_name from g{k}),
  s{k} as materialized (select scope, group_id, count(*) as size from g{k} group by 1, 2),
  o{k} as materialized (select a.scope, a.group_id as src, b.group_id as dst from g{k} a join g{k} b
    on a.scope = b.scope and a.title = b.title and a.group_id <> b.group_id
    join s{k} sa on sa.scope = a.scope and sa.group_id = a.group_id
    join s{k} sb on sb.scope = b.scope and sb.group_id = b.group_id
    group by 1, 2, 3, sa.size, sb.size having count(*) / (sa.size + sb.size - count(*)) > 0.5),
  ne{k} as materialized (select a.scope, a.group_id as src, b.group_id as dst from n{k} a join n{k} b
    on a.scope = b.scope and a.group_id <> b.group_id where {_NAME_EDGE})"""


_GRAPH = f"g as materialized (select * from {_GROUPS}), {_graph()}"


def _components(edges, k=""):
    return f"""reach{k}(scope, id, other) as (select scope, group_id, group_id from n{k}
        union select r.scope, r.id, e.dst from reach{k} r join {edges} e on e.scope = r.scope and e.src = r.other),
      comp{k} as (select scope, id, min(other) as component from reach{k} group by 1, 2)"""


def _round(k):
    """The groups of round ``k`` along all edges, as those of the next one."""
    return f"""{_graph(k)}, {_components(f'(select * from o{k} union select * from ne{k})', k)},
  named{k} as (select c.scope, c.component, n.group_name from comp{k} c join n{k} n on n.scope = c.scope and n.group_id = c.id
    qualify row_number() over (partition by c.scope, c.component
      order by length(n.group_name) desc, n.group_name) = 1),
  g{k + 1} as materialized (select distinct c.scope, c.component as group_id, w.group_name, g.title from g{k} g
    join comp{k} c on c.scope = g.scope and c.id = g.group_id
    join named{k} w on w.scope = c.scope and w.component = c.component)"""


def _merged(groups, rounds=4):
    """Groups merged again and again; the last round finds nothing any more on these tables."""
    return f"g1 as materialized (select * from {groups}), {', '.join(map(_round, range(1, rounds + 1)))}, merged as (select * from g{rounds + 1})"


_MERGED = _merged(_GROUPS)
_CHAINS = "(" + " union all ".join(
    f"select {', '.join(_chain_select(x, 'bigint', 'p_partkey // 12'))} from part where p_partkey % 12 in ({', '.join(map(str, places))})"
    for x, places in _CHAIN.items()) + ")"


def _index(groups):
    return f"""mentions as (select *, row_number() over (partition by scope, title order by group_id) as nth from {groups}),
      infos as (select p_brand as scope, p_name as title, p_partkey as table_id,
        row_number() over (partition by p_brand, p_name order by p_partkey) as nth from part)"""


def _several(groups):
    return f"""sizes as (select scope, group_id, count(*) as size from {groups} group by 1, 2),
      kept as (select * from sizes where size > 1 or scope not in (select scope from sizes where size > 1))"""


SQL = {
    "clean_group_names": f"select page_id, {_clean('url')} as name from pages",
    "edit_ratios": """select p_partkey, round(1 - levenshtein(lower(p_type), p_name)
          / greatest(length(p_type), length(p_name)), 6) as by_type,
        round(1 - levenshtein(lower(p_brand), p_name) / greatest(length(p_brand), length(p_name)), 6) as by_brand
        from part""",
    "match_titles": f"""with {_match(_PROPOSALS, _TITLES)}
        select scope, proposal, title, tier, round(ratio, 6) as ratio from m""",
    "match_page_titles": f"""with {_match(_ASKED, _PAGES)}
        select scope, proposal, title, tier, round(ratio, 6) as ratio from m""",
    "assign_titles": f"""with {_match(_PROPOSALS, _TITLES)},
        c as (select q.scope, q.p_brand, q.p_partkey, m.title from {_PROPOSALS} q
          join m on m.scope = q.scope and m.proposal = q.proposal where m.title is not null
          qualify row_number() over (partition by q.scope, m.title order by q.p_brand, q.p_partkey) = 1)
        select scope, 'group:' || p_brand as group_id, {_clean("'the parts of ' || p_brand")} as group_name, title from c
        union all select scope, 'title:' || title, {_clean("title")}, title from {_TITLES} t
          where not exists (select 1 from c where c.scope = t.scope and c.title = t.title)""",
    "name_edges": f"""with {_GRAPH}
        select scope, least(src, dst) as a, greatest(src, dst) as b from ne group by all""",
    "overlap_edges": f"""with recursive {_GRAPH}, {_components('o')} select scope, id, component from comp""",
    "merge_groups": f"with recursive {_MERGED} select scope, group_name, title from merged",
    "merge_chains": f"with recursive {_merged(_CHAINS)} select scope, group_id, group_name, title from merged",
    "drop_single_groups": f"""with g as (select * from {_GROUPS}), {_several('g')}
        select g.scope, g.group_id, title from g join kept k on k.scope = g.scope and k.group_id = g.group_id""",
    "grouped_index": f"""with g as (select * from {_GROUPS}), {_index('g')}
        select m.scope, group_id, m.title, table_id from mentions m
        join infos i on i.scope = m.scope and i.title = m.title and i.nth = m.nth""",
    "topic_index": f"""with recursive {_MERGED}, {_several('merged')},
        final as (select m.* from merged m join kept k on k.scope = m.scope and k.group_id = m.group_id),
        {_index('final')}
        select m.scope, group_name, m.title, table_id from mentions m
        join infos i on i.scope = m.scope and i.title = m.title and i.nth = m.nth""",
}
