"""The repair of conversations as DuckDB SQL: the edits by a recursion from the last turn to the first."""

from __future__ import annotations

#: The state after keeping a turn, by state: what its role must start with, and the state behind.
_KEEP = {0: {"s": 1, "u": 2}, 1: {"u": 2}, 2: {"a": 3}, 3: {"u": 2}}
_ONWARD = {0: 2, 1: 2, 2: 3, 3: 2}
_ROLE = {2: "user", 3: "assistant"}


def _way(cost: str, letter: str, line: str | None, at: str) -> str:
    """A way from a state: cost, letters and lines, put before those of ``at``."""
    lines = f"list_prepend({line}, {at}.l)" if line else f"{at}.l"
    return f"{{'c': {at}.c + {cost}, 'e': '{letter}' || {at}.e, 'l': {lines}}}"


def _least(ways: list[str]) -> str:
    return f"list_min(list_filter([{', '.join(ways)}], lambda x: x is not null))"


def _turn(q: int) -> str:
    """The best way from a state when the next edit is on a turn."""
    ways = [_way("3", "D", None, f"v{q}")]
    cut = "(case when fault = 'truncated' then 1 else 0 end)"
    live = "fault is null or fault = 'truncated'"
    for initial, to in _KEEP[q].items():
        ways.append(f"case when ({live}) and initial = '{initial}' then {_way(cut, 'K', "role || ':' || text", f'v{to}')} end")
    to = _ONWARD[q]
    line = f"'{_ROLE[to]}:' || text"
    ways.append(f"case when {live} then {_way(f'2 + {cut}', 'R', line, f'v{to}')} end")
    return _least(ways)


def _insert(q: int, name: str) -> str:
    to = _ONWARD[q]
    return _least([f"{name}{q}", _way("2", "I", f"'{_ROLE[to]}:'", f"{name}{to}")])


def _all(make, name: str) -> str:
    return ", ".join(f"{make(q)} as {name}{q}" for q in range(4))


def _end(q: int) -> str:
    missing = {0: [], 1: ["user", "assistant"], 2: ["assistant"], 3: []}[q]
    lines = f"[{', '.join(repr(m + ':') for m in missing)}]::varchar[]"
    return f"{{'c': {2 * len(missing)}::bigint, 'e': '{'I' * len(missing)}', 'l': {lines}}}"


#: CRC-32 of an ASCII text in bits, lowest first.
_TEXT = "coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' ')"
_BITS = "list_reduce(list_prepend(xor(c, b), [0, 0, 0, 0, 0, 0, 0, 0]::bigint[]), lambda x, z: xor(x >> 1, 3988292384 * (x & 1)))"
CRC = (f"xor(list_reduce(list_prepend(4294967295::bigint, list_transform(string_split({_TEXT}, ''), lambda x: ascii(x)::bigint)), "
       f"lambda c, b: {_BITS}), 4294967295)")

REPAIR = f"""
with recursive harm as (
  select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text,
    {CRC} % 20 as h from conversations),
changed as (
  select conv_id, turn, case when h = 4 then 'user' else role end as role,
    case when h = 1 then '' when h = 2 then regexp_replace(text, '[.!?]', '', 'g') else text end as text,
    unnest(range(case when h = 3 then 2 else 1 end)) as copy
  from harm where h <> 0),
placed as (
  select *, row_number() over (partition by conv_id order by turn nulls first, role, text, copy) as i,
    row_number() over (partition by conv_id, role, text order by turn nulls first, copy) as said,
    left(role, 1) as initial from changed),
marked as (
  select *, case when not regexp_matches(text, '[^\\x20\\x09-\\x0D]') then 'blank' when said > 1 then 'duplicate'
      when not regexp_matches(text, '[.!?][\\x20\\x09-\\x0D]*\\z') then 'truncated' end as fault,
    lag(initial) over (partition by conv_id order by i) || initial as pair from placed),
found as (
  select conv_id, count(*) as n, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0)::bigint as gaps,
    count(*) filter (fault = 'blank') as blank, count(*) filter (fault = 'duplicate') as duplicate,
    count(*) filter (fault = 'truncated') as truncated, count(*) filter (pair not in ('su', 'ua', 'au')) as illegal
  from marked group by conv_id),
ways as (
  select conv_id, n as i, {_all(_end, 'v')} from found
  union all
  select conv_id, i - 1, {_all(lambda q: _insert(q, 'w'), 'v')} from (
    select conv_id, i, {_all(lambda q: _insert(q, 'b'), 'w')} from (
      select w.conv_id, w.i, {_all(_turn, 'b')}
      from ways w join marked m on m.conv_id is not distinct from w.conv_id and m.i = w.i)))
select c.conv_id, coalesce(gaps, 0) as gaps, coalesce(blank, 0) as blank, coalesce(duplicate, 0) as duplicate,
  coalesce(truncated, 0) as truncated, coalesce(illegal, 0) as illegal, coalesce(v0.c, 0) as cost,
  coalesce(v0.e, '') as audit, sha256(coalesce(array_to_string(v0.l, chr(10)), '')) as repaired_sha256
from (select distinct conv_id from conversations) c
left join found f on f.conv_id is not distinct from c.conv_id
left join ways w on w.conv_id is not distinct from c.conv_id and w.i = 0
"""
