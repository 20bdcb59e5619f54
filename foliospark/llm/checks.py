"""SQL for the queries that SQL can express on whole tables."""

from __future__ import annotations

RULES_SQL = r"""
with d as (
  select doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') as w,
         list_filter(str_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as lines
  from (select doc_id, coalesce(text, '') as t from documents)),
runs as (
  select doc_id, i, array_to_string(w[i:i + 4], ' ') as run
  from (select doc_id, w, unnest(range(1, len(w) - 3)) as i from d)),
again as (
  select doc_id, i from (select *, count(*) over (partition by doc_id, run) as n from runs) where n > 1),
covered as (
  select doc_id, sum(least(5, coalesce(i - before, 5))) as n
  from (select *, lag(i) over (partition by doc_id order by i) as before from again) group by doc_id),
figures as (
  select d.doc_id, t, cast(len(w) as bigint) as n_words, cast(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) as bigint) as word_chars,
         cast(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) as bigint) as n_symbols,
         cast(len(lines) - len(list_distinct(lines)) as bigint) as n_dup_lines,
         cast(coalesce(n, 0) as bigint) as n_repeat_words
  from d left join covered using (doc_id)),
judged as (select *, n_words < 10 or 100 * n_repeat_words > 20 * n_words as base_failed from figures)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       not base_failed and not (100 * n_symbols > 20 * n_words) and not (100 * n_dup_lines > 40 * len(str_split(t, chr(10))))
       and not (word_chars > 25 * n_words) and not (100 * ((length(t) - length(replace(t, '!!', ''))) / 2) > 30 * n_words) as kept
from judged
"""

_WORDS = r"""regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
  '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w"""

CONTAMINATION_SQL = f"""
with item as (select cast(item_id as varchar) as item_id, {_WORDS} from benchmark),
phrase as (
  select distinct item_id, size, array_to_string(w[i:i + size - 1], ' ') as words
  from (select *, least(10, len(w)) as size, unnest(range(1, len(w) - least(10, len(w)) + 2)) as i from item where len(w) > 0)),
doc as (select doc_id, {_WORDS} from documents),
place as (
  select doc_id, size, i, array_to_string(w[i:i + size - 1], ' ') as words
  from (select doc_id, w, size, unnest(range(1, len(w) - size + 2)) as i from doc, (select distinct size from phrase))),
hit as (select doc_id, place.size, i, item_id from place join phrase using (size, words)),
covered as (select doc_id, count(distinct spot) as n_hit from (select doc_id, unnest(range(i, i + size)) as spot from hit) group by doc_id),
listed as (select doc_id, count(*) as n_items, string_agg(item_id, ',' order by item_id) as ids
           from (select distinct doc_id, item_id from hit) group by doc_id)
select doc_id, cast(len(w) as bigint) as n_words, cast(coalesce(n_hit, 0) as bigint) as n_hit,
       cast(coalesce(n_items, 0) as bigint) as n_items, sha256(coalesce(ids, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from doc left join covered using (doc_id) left join listed using (doc_id)
"""

ARCHIVE_SQL = """
with p as (select page_id, coalesce(html, '') as html from pages),
q as (select page_id, cast(strlen(html) as bigint) as payload_bytes, sha1(html) as payload_digest,
             max(page_id) over (partition by html) as answer from p)
select page_id, payload_bytes, payload_digest,
       case when payload_bytes >= 1000 and answer <> page_id then 'revisit' else 'response' end as record_type,
       case when payload_bytes >= 1000 and answer <> page_id then answer end as refers_to
from q
"""

# crc32 of a list of bytes, by the usual table
_CRC_TABLE = """(select list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)),
  lambda c, k: case when c % 2 = 1 then xor(3988292384, c // 2) else c // 2 end)) as tab)"""


def _crc(letters: str) -> str:
    return f"""xor(list_reduce(list_prepend(4294967295, {letters}),
  lambda c, b: xor(c >> 8, tab[1 + (xor(c, b) & 255)])), 4294967295)"""


SPELLING_SQL = f"""
with recursive run as (
  select coalesce(cast(doc_id as varchar), '') as doc, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[a-z\u00C0-\u00FF]+')) as w from documents),
counted as (select doc, w, count(*) as times from run group by all),
hashed as (
  select w, times, {_crc("""list_transform(str_split(doc || ':', ''), lambda c: cast(unicode(c) as bigint)) ||
    flatten(list_transform(str_split(w, ''), lambda c: case when unicode(c) < 128 then [cast(unicode(c) as bigint)]
      else [195, cast(unicode(c) - 64 as bigint)] end))""")} as h from counted, {_CRC_TABLE}),
slipped as (
  select case when h % 199 = 0 then left(w, h % length(w)) || substr(w, h % length(w) + 2) else w end as word, times from hashed),
lexicon as (
  select word, cast(sum(times) as bigint) as n from slipped where length(word) >= 6 group by word having sum(times) >= 5),
hole as (
  select word, n, i, left(word, i - 1) as a, substr(word, i + 1) as b
  from (select *, unnest(range(1, length(word) + 1)) as i from lexicon)),
near as (
  select x.word, y.word as other, y.n as m from hole x join hole y on x.a = y.a and x.b = y.b and x.word <> y.word
  union select x.word, y.word, y.n from hole x join lexicon y on y.word = x.a || x.b
  union select y.word, x.word, x.n from hole x join lexicon y on y.word = x.a || x.b),
best as (
  select word, count(*) as n_near, max(m) as top from near group by word),
formed as (
  select lexicon.word, lexicon.n, coalesce(n_near, 0) as n_near, case when top >= 5 * lexicon.n then top end as form_n,
    case when top >= 5 * lexicon.n then (select min(other) from near where near.word = best.word and m = top) end as form
  from lexicon left join best using (word)),
chain as (
  select word, word as root, form as next from formed
  union all select chain.word, formed.word, formed.form from chain join formed on formed.word = chain.next)
select formed.word, form, chain.root, n, n_near, form_n from formed join chain on formed.word = chain.word and chain.next is null
"""


def _put(state: str, cost: str, letter: str, row: str) -> str:
    return f"{{'c': {state}.c + {cost}, 'a': {state}.a || '{letter}', 't': coalesce({state}.t || chr(10), '') || {row}}}"


def _gone(state: str) -> str:
    return f"{{'c': {state}.c + 4, 'a': {state}.a || 'D', 't': {state}.t}}"


def _stays(state: str, initial: str, role: str) -> str:
    keep = _put(state, f"case when initial = '{initial}' then stay else 1000000000 end", "K", "role || ':' || text")
    return keep + ", " + _put(state, "stay + 3", "R", f"'{role}:' || text")


_NONE = "{'c': cast(1000000000 as bigint), 'a': cast('' as varchar), 't': cast(null as varchar)}"

REPAIR_SQL = f"""
with recursive hashed as (
  select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text, {_crc("""list_transform(str_split(
    coalesce(cast(conv_id as varchar), ' ') || ':' || coalesce(cast(turn as varchar), ' '), ''), lambda c: cast(unicode(c) as bigint))""")} % 20 as kind
  from conversations, {_CRC_TABLE}),
damaged as (
  select conv_id, turn, case when kind = 4 then 'user' else role end as role,
    case kind when 1 then '' when 2 then regexp_replace(text, '[.!?]', '', 'g') else text end as text,
    unnest(range(case when kind = 3 then 2 else 1 end)) as copy
  from hashed where kind <> 0),
ranked as (
  select *, row_number() over (partition by conv_id order by turn nulls first, role, text, copy) as i,
    row_number() over (partition by conv_id, role, text order by turn nulls first, copy) as nth,
    regexp_replace(text, '[\x20\x09-\x0D]+$', '') as solid
  from damaged),
judged as (
  select *, left(role, 1) as initial,
    case when solid = '' then 1 when nth > 1 then 2 when not right(solid, 1) in ('.', '!', '?') then 3 else 0 end as fault
  from ranked),
rows_ as (select *, case fault when 0 then 0 when 3 then 3 else 1000000000 end as stay from judged),
paired as (select *, lag(initial) over (partition by conv_id order by i) as before from rows_),
figures as (
  select conv_id, count(*) as n, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps,
    count(*) filter (where fault = 1) as blank, count(*) filter (where fault = 2) as duplicate,
    count(*) filter (where fault = 3) as truncated, count(*) filter (where not before || initial in ('su', 'ua', 'au')) as illegal
  from paired group by conv_id),
walk as (
  select conv_id, cast(0 as bigint) as i, {{'c': cast(0 as bigint), 'a': cast('' as varchar), 't': cast(null as varchar)}} as p0, {_NONE} as p1,
    {{'c': cast(3 as bigint), 'a': cast('I' as varchar), 't': cast('user:' as varchar)}} as p2,
    {{'c': cast(6 as bigint), 'a': cast('II' as varchar), 't': cast('user:' || chr(10) || 'assistant:' as varchar)}} as p3
  from (select distinct conv_id from conversations)
  union all
  select conv_id, i, g0, g1, h2, list_min([g3, {_put("h2", "3", "I", "'assistant:'")}]) from (
    select *, list_min([g2, {", ".join(_put(s, "3", "I", "'user:'") for s in ("g0", "g1", "g3"))}]) as h2 from (
      select r.conv_id, r.i, {_gone("p0")} as g0,
        list_min([{_gone("p1")}, {_put("p0", "case when initial = 's' then stay else 1000000000 end", "K", "role || ':' || text")}]) as g1,
        list_min([{_gone("p2")}, {", ".join(_stays(s, "u", "user") for s in ("p0", "p1", "p3"))}]) as g2,
        list_min([{_gone("p3")}, {_stays("p2", "a", "assistant")}]) as g3
      from walk w join rows_ r on r.conv_id is not distinct from w.conv_id and r.i = w.i + 1) as moved) as filled),
last as (
  select w.conv_id, list_min([p0, p3]) as best from walk w left join figures f on f.conv_id is not distinct from w.conv_id
  where w.i = coalesce(f.n, 0))
select last.conv_id, cast(coalesce(gaps, 0) as bigint) as gaps, coalesce(blank, 0) as blank, coalesce(duplicate, 0) as duplicate,
  coalesce(truncated, 0) as truncated, coalesce(illegal, 0) as illegal, best.c as cost, best.a as audit,
  sha256(coalesce(best.t, '')) as repaired_sha256
from last left join figures f on f.conv_id is not distinct from last.conv_id
"""
