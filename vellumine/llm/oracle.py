"""DuckDB SQL for the ``opN_<name>`` queries that SQL can express."""

from __future__ import annotations

SPACES = "chr(32)||chr(9)||chr(10)||chr(11)||chr(12)||chr(13)"
WORDS = r"list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')"

OP9_MEASURES = rf"""
w as (select doc_id, text, {WORDS} as words from documents_in),
l as (select doc_id, text, words, list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: trim(x, {SPACES}) <> '') as lines,
      case when len(words) < 3 then [] else list_transform(range(1, len(words) - 1), lambda i: words[i]||' '||words[i+1]||' '||words[i+2]) end as grams from w),
g as (select row_number() over () as r, * from l),
u as (select r, i, grams[i] as gram from (select r, grams, unnest(range(1, len(grams) + 1)) as i from g)),
c as (select r, i from u qualify count(*) over (partition by r, gram) > 1),
p as (select r, count(distinct j)::bigint as n_repeat_words from (select r, unnest([i, i + 1, i + 2]) as j from c) group by r),
m as (select doc_id, text, len(words)::bigint as n_words, coalesce(n_repeat_words, 0) as n_repeat_words,
      list_sum(list_transform(words, lambda x: length(x))) as chars,
      length(coalesce(text, '')) - length(translate(coalesce(text, ''), '#*$%&|<>', '')) as n_symbols,
      length(coalesce(text, '')) - length(translate(coalesce(text, ''), '0123456789', '')) as n_digits,
      len(lines) as n_lines, len(lines) - len(list_distinct(lines)) as n_dup_lines
      from g left join p using (r)),
n as (select doc_id, text, n_words, n_repeat_words, coalesce(chars, 0)::bigint as word_chars, n_symbols::bigint as n_symbols,
      n_dup_lines::bigint as n_dup_lines, n_digits, n_lines from m),
f as (select *, (case when n_words < 50 then 1 else 0 end + case when 100 * n_repeat_words > 50 * n_words then 2 else 0 end
      + case when word_chars < 2 * n_words then 4 else 0 end + case when word_chars > 20 * n_words then 8 else 0 end
      + case when 4 * n_symbols > word_chars then 16 else 0 end + case when 2 * n_digits > word_chars then 32 else 0 end
      + case when 2 * n_dup_lines > n_lines then 64 else 0 end)::bigint as failures from n)
"""

OP9 = f"""
with documents_in as (select * from documents), {OP9_MEASURES}
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (failures & 3) <> 0 as base_failed, failures = 0 as kept, failures, '2' as policy_version from f
"""

DECON_WORDS = r"list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')"

OP2_HITS = f"""
b as (select item_id, {DECON_WORDS} as words from benchmark),
win as (select distinct item_id, least(13, len(words)) as need, array_to_string(words[i:i + least(13, len(words)) - 1], ' ') as phrase
        from (select item_id, words, unnest(range(1, greatest(len(words) - 12, 1) + 1)) as i from b where len(words) > 0)),
dw as (select row_number() over () as r, *, {DECON_WORDS} as words from documents_in),
needs as (select distinct need from win),
occ as (select r, i, need, array_to_string(words[i:i + need - 1], ' ') as phrase
        from (select r, words, need, unnest(range(1, len(words) - need + 2)) as i from dw, needs where len(words) >= need)),
hit as (select r, i, occ.need, item_id from occ join win on occ.phrase = win.phrase and occ.need = win.need),
cov as (select r, count(distinct p)::bigint as n_hit from (select r, unnest(range(i, i + need)) as p from hit) group by r),
its as (select r, list_sort(list(distinct item_id::varchar)) as ids from hit group by r),
j as (select dw.*, len(words)::bigint as n_words, coalesce(n_hit, 0) as n_hit, coalesce(ids, []) as ids from dw left join cov using (r) left join its using (r))
"""

OP2 = f"""
with documents_in as (select * from documents), {OP2_HITS}
select doc_id, n_words, n_hit, len(ids)::bigint as n_items, sha256(array_to_string(ids, ',')) as items_sha256, n_hit > 0 and 20 * n_hit >= n_words as contaminated from j
"""

OP3 = rf"""
with w as (select row_number() over () as r, doc_id, {WORDS} as words from documents),
win as (select r, doc_id, i, hash(array_to_string(words[i:i + 49], ' ')) as h, array_to_string(words[i:i + 49], ' ') as gram
        from (select r, doc_id, words, unnest(range(1, len(words) - 48)) as i from w where len(words) >= 50)),
rep as (select gram, min(doc_id) as least from win group by gram having min(doc_id) < max(doc_id)),
cov as (select distinct r, j from (select r, unnest(range(i, i + 50)) as j from win join rep using (gram) where doc_id > least)),
gone as (select r, list(j) as js from cov group by r)
select doc_id, len(words)::bigint as n_words, coalesce(len(js), 0)::bigint as n_removed,
       sha256(array_to_string(case when js is null then words else list_filter(words, lambda x, k: not list_contains(js, k)) end, ' ')) as kept_sha256
from w left join gone using (r)
"""

LINE_ROWS = f"""
ln as (select row_number() over () as r, *, string_split(coalesce(text, ''), chr(10)) as lines from documents_in),
ky as (select r, list_transform(lines, lambda x: translate(trim(x, {SPACES}), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) as keys from ln),
fr as (select coalesce(list(k), []) as ks from (select k from (select distinct r, unnest(keys) as k from ky) where k <> '' group by k having count(*) >= 10)),
ka as (select ln.*, list_filter(list_zip(lines, keys), lambda z: not list_contains(ks, z[2])) as kept from ln join ky using (r), fr)
"""

OP5 = f"""
with documents_in as (select * from documents), {LINE_ROWS}
select doc_id, len(lines)::bigint as n_lines, (len(lines) - len(kept))::bigint as n_dropped,
       sha256(array_to_string(list_transform(kept, lambda z: z[1]), chr(10))) as kept_sha256 from ka
"""

OP7 = rf"""
with recursive w as (select doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ 	-
]+'), lambda x: x <> '') as words from documents),
s as (select doc_id, case when len(words) = 0 then [] when len(words) < 3 then [array_to_string(words, ' ')]
      else list_distinct(list_transform(range(1, len(words) - 1), lambda i: words[i]||' '||words[i+1]||' '||words[i+2])) end as grams from w),
g as (select doc_id, len(grams) as n, unnest(grams) as gram from s),
p as (select a.doc_id as x, b.doc_id as y, any_value(a.n) as m, any_value(b.n) as n, count(*) as k
      from g a join g b on a.gram = b.gram and a.doc_id < b.doc_id and 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n) group by a.doc_id, b.doc_id),
e as (select x, y from p where 100 * k >= 85 * (m + n - k)),
b as (select x, y from e union all select y, x from e),
reach as (select doc_id as node, doc_id as seen from s union select r.node, b.y from reach r join b on r.seen = b.x)
select s.doc_id, len(grams)::bigint as n_shingles, c as component_id, s.doc_id = c as kept
from s join (select node, min(seen) as c from reach group by node) on s.doc_id = node
"""

ORACLE = {"op3_substring_dedup": OP3, "op5_line_dedup": OP5, "op7_near_dedup": OP7, "op2_decontamination": OP2, "op9_quality_rules": OP9}
