"""DuckDB SQL for the operators that SQL can express, written from the definitions rather than from the operators' plans."""

from __future__ import annotations

from sluice.llm.decontaminate import EQUAL, MASKS, SHORT, SHORT_MASKS, SPAN, WINDOW
from sluice.llm.licenses import BARS, COVERAGE, DENSITY, MARKS, NEEDS, NEIGHBOUR, PHRASES, TEMPLATES, WHOLE, K

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_PLAIN = f"translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}')"
_SPACED = rf"regexp_extract_all({_PLAIN}, '[^\x20\x09-\x0D]+')"
_ALNUM = rf"regexp_extract_all({_PLAIN}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

OP1 = f"""with recursive w as (select doc_id, {_SPACED} as ws from documents),
sets as (select doc_id, case when len(ws) = 0 then [] when len(ws) < 4 then [array_to_string(ws, ' ')]
  else list_sort(list_distinct(list_transform(range(1, len(ws) - 2), lambda i: array_to_string(ws[i:i + 3], ' ')))) end as s from w),
holds as (select doc_id, unnest(s) as g from sets),
pairs as (select a.doc_id as a, b.doc_id as b, count(*) as n from holds a join holds b on a.g = b.g and a.doc_id < b.doc_id group by 1, 2),
links as (select p.a, p.b from pairs p join sets x on x.doc_id = p.a join sets y on y.doc_id = p.b where 100 * n >= 80 * (len(x.s) + len(y.s) - n)),
ways as (select a, b from links union all select b, a from links),
reach(x, y) as (select doc_id, doc_id from sets union select r.x, ways.b from reach r join ways on ways.a = r.y),
least_ as (select x as doc_id, min(y) as component_id from reach group by x)
select doc_id, cast(len(s) as bigint) as n_shingles, component_id, component_id = doc_id as kept,
  case when len(s) = 0 then doc_id else min(doc_id) over (partition by s) end as set_id from sets join least_ using (doc_id)"""

def _seeds(masks: tuple[str, ...], words: str, place: str) -> str:
    return "[" + ", ".join(f"'{m}|' || array_to_string([{', '.join(f'{words}[{place} + {j + 1}]' for j, bit in enumerate(m) if bit == '1')}], ' ')" for m in masks) + "]"


OP4 = f"""with items as (select item_id, {_ALNUM} as item from benchmark),
docs as (select doc_id, {_ALNUM} as words from documents),
item_places as (select item_id, item, unnest(range(0, len(item) - {SPAN - 1})) as p from items),
item_seeds as (select item_id, p, unnest({_seeds(MASKS, 'item', 'p')}) as seed from item_places union all select item_id, p, unnest({_seeds(SHORT_MASKS, 'item', 'p')}) from item_places where len(item) < {SHORT}),
doc_places as (select doc_id, words, unnest(range(0, len(words) - {SPAN - 1})) as i from docs),
doc_seeds as (select doc_id, i, unnest({_seeds(MASKS + SHORT_MASKS, 'words', 'i')}) as seed from doc_places),
hits as (select distinct d.doc_id, s.item_id, i - p as diagonal from doc_seeds d join item_seeds s using (seed)),
laid as (select h.*, list_transform(range(0, len(item)), lambda j: case when diagonal + j >= 0 and diagonal + j < len(words) and words[diagonal + j + 1] = item[j + 1] then 1 else 0 end) as agree
  from hits h join docs using (doc_id) join items using (item_id)),
wide as (select *, least({WINDOW}, len(agree)) as width from laid),
best as (select *, list_max(list_transform(range(0, len(agree) - width + 1), lambda s: list_sum(agree[s + 1:s + width]))) as top from wide),
good as (select doc_id, item_id, diagonal, list_position(agree, 1) - 1 as lo, len(agree) - list_position(list_reverse(agree), 1) as hi, cast(list_sum(agree) as bigint) as n_equal
  from best where top >= ceil(width * {EQUAL} / {WINDOW})),
one as (select *, row_number() over (partition by doc_id, item_id order by n_equal desc, diagonal) as r from good)
select doc_id, item_id, cast(diagonal + lo as bigint) as doc_start, cast(lo as bigint) as item_start, cast(hi - lo + 1 as bigint) as length, n_equal from one where r = 1"""

_TEMPLATES = ", ".join("({}, '{}', '{}')".format(i, label, text.replace("'", "''")) for i, (label, text) in enumerate(TEMPLATES))
_GRAM = "array_to_string(ws[{at} + 1:{at} + " + str(K) + "], ' ')"
#: The words from a place on, one column for each number of words that a phrase has.
_LENGTHS = sorted({len(p.split()) for p in (*PHRASES, *MARKS)})
_AHEAD = ", ".join(f"array_to_string(ws[i + 1:i + {n}], ' ') as p{n}" for n in _LENGTHS)


def _spoken(phrases: dict[str, str], name: str) -> str:
    rows = {n: ", ".join(f"('{p}', '{x}')" for p, x in phrases.items() if len(p.split()) == n) for n in _LENGTHS}
    return " union all ".join(f"select doc_id, i, {name} from places join (values {v}) t(phrase, {name}) on phrase = p{n}" for n, v in rows.items() if v)


_RULES = ", ".join(f"('{label}', {NEEDS.get(label, [])!r}::varchar[], {BARS.get(label, [])!r}::varchar[])" for label in sorted({label for label, _ in TEMPLATES}))

OP5 = f"""with docs as (select doc_id, {_ALNUM} as ws from documents),
spots as (select doc_id, ws, unnest(range(0, len(ws))) as i from docs),
places as materialized (select doc_id, i, case when i + {K} <= len(ws) then {_GRAM.format(at='i')} end as g, {_AHEAD} from spots),
base as ({_spoken(PHRASES, "label")}),
marks as materialized ({_spoken(MARKS, "mark")}),
summary as (select doc_id, count(*) as n_base, min(i) as first_word, max(i) as last_word, list_distinct(list(label)) as base_set from base group by doc_id),
templates as (select id, label, {_ALNUM} as ws from (values {_TEMPLATES}) t(id, label, text)),
rules as (select * from (values {_RULES}) t(label, needs, bars)),
template_places as (select id, label, len(ws) as size, ws, unnest(range(0, len(ws) - {K - 1})) as p from templates),
votes as (select doc_id, id, label, size, i, p, i - p as diagonal
  from places d join (select id, label, size, p, {_GRAM.format(at='p')} as g from template_places) t using (g)),
fresh as (select *, case when diagonal - lag(diagonal) over (partition by doc_id, id order by diagonal, i) <= {NEIGHBOUR} then 0 else 1 end as new from votes),
runs as (select *, sum(new) over (partition by doc_id, id order by diagonal, i rows unbounded preceding) as run from fresh),
merged as (select doc_id, id, label, size, run, len(list_distinct(flatten(list_transform(list(p), lambda x: range(x, x + {K}))))) as matched,
  len(list_distinct(flatten(list_transform(list(i), lambda x: range(x, x + {K}))))) as agreeing, min(i) as lo, max(i) + {K} as hi, min(diagonal) as start, max(diagonal) + size as stop from runs group by doc_id, id, label, size, run),
verified as (select * from merged where 100 * matched >= {COVERAGE} * size and matched >= least(size, {WHOLE}) and 100 * agreeing >= {DENSITY} * (hi - lo)),
told as (select v.* from verified v join rules using (label)
  where len(needs) = (select count(distinct m.mark) from marks m where m.doc_id = v.doc_id and list_contains(needs, m.mark) and m.i >= lo and m.i < hi)
  and not exists (select 1 from marks m where m.doc_id = v.doc_id and list_contains(bars, m.mark) and m.i >= least(lo, start) and m.i < greatest(hi, stop))),
own as (select distinct r.doc_id, r.id, r.run, r.i, t.label, t.matched, t.matched::double / t.size as coverage from runs r join told t on r.doc_id = t.doc_id and r.id = t.id and r.run = t.run),
ranked as (select *, row_number() over (partition by doc_id, i order by matched desc, coverage desc, id, run desc) as place from own),
stands as (select doc_id, id, run, label, max(coverage) as coverage from ranked group by doc_id, id, run, label having 2 * count(*) filter (where place = 1) >= count(*)),
found as (select doc_id, list_distinct(list(label)) as own_set, max(coverage) as coverage from stands group by doc_id)
select doc_id, cast(len(ws) as bigint) as n_words, coalesce(n_base, 0) as n_base, first_word, last_word, array_to_string(list_sort(coalesce(base_set, [])), ',') as base_labels,
  array_to_string(list_sort(list_distinct(list_concat(coalesce(base_set, []), coalesce(own_set, [])))), ',') as labels,
  greatest(coalesce(coverage, 0.0::double), case when n_base > 0 then 0.5::double else 0.0::double end) as score
from docs left join summary using (doc_id) left join found using (doc_id)"""

OP6 = """with d as (select doc_id, hex(encode(coalesce(text, ''))) as h, octet_length(encode(coalesce(text, ''))) as n from documents),
g as (select doc_id, unnest(range(0, n - 49)) as p, h from d),
s as (select doc_id, p, substr(h, 2 * p + 1, 100) as bytes from g),
low as (select bytes, min(doc_id) as m from s group by bytes),
hit as (select s.doc_id, p from s join low using (bytes) where m < s.doc_id),
fresh as (select *, case when p - lag(p) over (partition by doc_id order by p) <= 50 then 0 else 1 end as new from hit),
runs as (select *, sum(new) over (partition by doc_id order by p rows unbounded preceding) as run from fresh),
spans as (select doc_id, run, min(p) as lo, max(p) + 50 as hi from runs group by doc_id, run),
gaps as (select doc_id, run, lo, hi, coalesce(lag(hi) over (partition by doc_id order by lo), 0) as after from spans),
kept as (select g.doc_id, string_agg(substr(d.h, 2 * after + 1, 2 * (lo - after)), '' order by lo) as head, max(hi) as last_hi, sum(hi - lo) as gone, count(*) as n_spans from gaps g join d using (doc_id) group by g.doc_id)
select d.doc_id, cast(n as bigint) as n_bytes, cast(coalesce(gone, 0) as bigint) as n_removed, coalesce(n_spans, 0) as n_spans,
  sha256(unhex(coalesce(head, '') || substr(h, 2 * coalesce(last_hi, 0) + 1))) as kept_sha256 from d left join kept using (doc_id)"""

ORACLES = {"op1_minhash": OP1, "op4_spaced_seeds": OP4, "op5_license_diagonals": OP5, "op6_suffix_repeats": OP6}
