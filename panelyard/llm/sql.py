"""DuckDB statements for the queries that SQL can express."""

from __future__ import annotations

from panelyard.llm import chat, mixing, quality

ORACLE: dict[str, str] = {}

GAPS = r"[\x20\x09-\x0D]+"
_stops = ", ".join(f"'{w}'" for w in quality.stop_list())


def _breaks(rule: quality.Rule) -> str:
    if " / " in rule.measure:
        top, bottom = rule.measure.split(" / ")
        return f"coalesce({top}::double / nullif({bottom}, 0) {rule.op} {rule.limit}, false)"
    return f"({rule.measure} {rule.op} {rule.limit})"


_BASE = f"(n_words < {quality.MIN_WORDS} or 100 * n_repeat_words > {quality.REPEAT_PERCENT} * n_words)"
_BROKEN = " or ".join(_breaks(r) for r in quality.RULES)

ORACLE["op9_quality_rules"] = rf"""
with d as (select row_number() over () as r, doc_id, coalesce(text, '') as text from documents),
w as (select *, list_filter(string_split_regex(text, '{GAPS}'), lambda x: x <> '') as w,
       list_filter(string_split(text, chr(10)),
                   lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as lines from d),
win as (select r, i, w[i] as a, w[i + 1] as b, w[i + 2] as c
        from (select r, w, unnest(range(1, len(w) - 1)) as i from w)),
dup as (select r, a, b, c from win group by all having count(*) > 1),
rep as (select r, count(distinct p) as n from (
          select win.r, unnest([i, i + 1, i + 2]) as p from win join dup using (r, a, b, c))
        group by r),
m as (select doc_id, len(w)::bigint as n_words, length(array_to_string(w, ''))::bigint as word_chars,
       length(regexp_replace(array_to_string(w, ''), '[^#*$%&|<>]', '', 'g'))::bigint as n_symbols,
       length(regexp_replace(array_to_string(w, ''), '[^!]', '', 'g'))::bigint as n_bangs,
       len(lines)::bigint as n_lines, (len(lines) - len(list_distinct(lines)))::bigint as n_dup_lines,
       len(list_distinct(list_filter(w, lambda x: x in ({_stops}))))::bigint as n_stop_words,
       coalesce(rep.n, 0)::bigint as n_repeat_words
      from w left join rep on w.r = rep.r)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       {_BASE} as base_failed, not ({_BASE} or {_BROKEN}) as kept
from m
"""

ORACLE["op6_chat_format"] = rf"""
with said as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text
              from conversations
              union all select * from (values (-1, 0, 'user', '{chat.CONTROL_SAMPLE}'),
                                              (-1, 1, 'assistant', '{chat.CONTROL_SAMPLE}'))),
t as (select *, role || chr(10) || text || chr(10) as said,
        length(regexp_replace(text, '<(\\*)\|', '<\\\1|', 'g'))
        + length(regexp_replace(role, '<(\\*)\|', '<\\\1|', 'g')) + {len(chat.START + chat.END) + 2} as size
      from said)
select conv_id, count(*)::bigint as n_turns,
  sha256(string_agg(said, '' order by turn, role, text)) as turns_sha256,
  coalesce(sum(length(text)) filter (role = 'assistant'), 0)::bigint as loss_chars,
  sha256(coalesce(string_agg(text, '' order by turn, role, text) filter (role = 'assistant'), ''))
    as loss_sha256,
  sum(size)::bigint as formatted_chars
from t group by conv_id
"""

ORACLE["op10_source_mix"] = rf"""
with recursive d as (
  select doc_id, source, len(list_filter(string_split_regex(coalesce(text, ''), '{GAPS}'),
         lambda x: x <> ''))::bigint as size,
         md5(coalesce(doc_id::varchar, '') || chr(10) || coalesce(text, '')) as h
  from documents),
s as (select source, sum(size)::bigint as source_size,
        {list(mixing.WEIGHTS)}[(row_number() over (order by source nulls last) - 1) % 3 + 1] as weight
      from d group by source),
w(level, held, step) as (
  select 0.0::double, -1::bigint, 0
  union all
  select case when o.n = w.held or o.w is null then w.level
              else ({mixing.SHARE} * o.total - coalesce(o.capped, 0)) / o.w end,
         case when o.w is null then w.held else o.n end, step + 1
  from w, lateral (select sum(source_size) as total,
      count(*) filter (weight * w.level > {mixing.REPEATS} * source_size) as n,
      sum({mixing.REPEATS} * source_size) filter (weight * w.level > {mixing.REPEATS} * source_size) as capped,
      sum(weight) filter (not weight * w.level > {mixing.REPEATS} * source_size) as w from s) o
  where step < 1000 and (w.held is distinct from o.n)),
t as (select s.*, least({mixing.REPEATS} * source_size, weight * level) as target
      from s, (select level from w order by step desc limit 1)),
p as (select d.*, t.source_size, t.target, round(t.target)::bigint as words,
        coalesce(sum(size) over (partition by d.source order by h, doc_id, size
          rows between unbounded preceding and 1 preceding), 0)::bigint as start
      from d join t on d.source is not distinct from t.source)
select doc_id, size, source_size, target,
  (greatest(0, least(start + size, words) - start)
   + greatest(0, least(start + size, words - source_size) - start))::bigint as taken
from p
"""


def _crc32(number: str) -> str:
    """Unsigned CRC-32 of a number in figures."""
    bit = "lambda x, y: case when x & 1 = 1 then xor(x >> 1, 3988292384) else x >> 1 end"
    byte = f"list_reduce(list_concat([xor(a, b)], [0::bigint for i in range(8)]), {bit})"
    codes = f"list_transform(string_split({number}::varchar, ''), lambda x: ascii(x)::bigint)"
    return f"xor(list_reduce(list_prepend(4294967295::bigint, {codes}), lambda a, b: {byte}), 4294967295)"


ORACLE["op12_prefix_trie"] = rf"""
with t as (select conv_id as c, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
           where conv_id is not null),
s as (select c, list(substring(sha256(length(role)::varchar || ':' || role || ':' || text), 1, 32)
                     order by turn nulls first, sha256(length(role)::varchar || ':' || role || ':' || text)) as turns
      from t group by c),
w as (select substring(sha256(length(role)::varchar || ':' || role || ':' || text), 1, 32) as turn,
             max(len(list_filter(string_split_regex(text, '{GAPS}'), lambda x: x <> ''))) as words
      from t group by 1),
r as (select s.c, list_concat(coalesce(d.turns, [])[1:h], s.turns[h + 1:]) as turns
      from (select *, {_crc32('c')} % 4 as h from s) s left join s d on d.c = s.c - s.c % 20),
p as (select c, d, turns[1:d] as node, len(turns) = d as ends from (
          select *, unnest(range(0, len(turns) + 1)) as d from r)),
n as (select node, d, min(c) as conv_id, count(*) as n_convs,
             sha256(coalesce(string_agg(c::varchar, ',' order by c) filter (ends), '')) as ends_sha256
      from p group by node, d),
own as (select n.*, case when d = 0 then 0 else (n_convs - 1) * coalesce(w.words, 0) end as saved
        from n left join w on w.turn = n.node[d]),
kids as (select node[1:d - 1] as node, d - 1 as d, count(*) as k from n where d > 0 group by all),
up as (select own.node[1:a] as node, a as d, sum(saved) as saved_tokens,
              count(*) filter (kids.k is null) as n_leaves
       from (select *, unnest(range(0, d + 1)) as a from own) own left join kids
            on kids.node = own.node and kids.d = own.d group by 1, 2)
select own.conv_id, own.d as depth, above.conv_id as parent_conv_id, own.n_convs,
       coalesce(kids.k, 0) as n_children, up.n_leaves, up.saved_tokens::bigint as saved_tokens, own.ends_sha256
from own join up on up.node = own.node and up.d = own.d
left join kids on kids.node = own.node and kids.d = own.d
left join n above on above.node = own.node[1:own.d - 1] and above.d = own.d - 1
"""
