"""DuckDB equivalents of the queries that SQL can express."""

WORDS = r"list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')"

QUALITY_RULES = rf"""
with d as (select doc_id, coalesce(lang, '') stratum, coalesce(text, '') t, {WORDS} w from documents),
b as (
  select row_number() over () r, doc_id, stratum, w, len(w) n_words,
    length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) word_chars,
    length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) n_symbols,
    list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) l
  from d),
win as (select r, unnest(range(1, n_words - 3)) i, w from b where n_words >= 5),
named as (select r, i, list_slice(w, i, i + 4) g from win),
dup as (select r, i from (select r, i, count(*) over (partition by r, g) c from named) where c > 1),
cov as (select r, sum(least(5, coalesce(nxt - i, 5))) c from (select r, i, lead(i) over (partition by r order by i) nxt from dup) group by r),
s as (
  select b.r, doc_id, stratum, n_words, word_chars, n_symbols, len(l) n_lines, len(l) - len(list_distinct(l)) n_dup_lines,
    coalesce(cov.c, 0) n_repeat_words
  from b left join cov using (r)),
v as (
  select *,
    least(floor(coalesce(n_symbols / nullif(word_chars, 0), 0) * 50), 50)::int symbols,
    least(floor(coalesce(n_dup_lines / nullif(n_lines, 0), 0) * 50), 50)::int dup_lines,
    least(floor(coalesce(n_repeat_words / nullif(n_words, 0), 0) * 50), 50)::int repeats,
    least(floor(coalesce(word_chars / nullif(n_words, 0), 0) * 2), 50)::int long_words
  from s),
x as (select *, 50 - long_words short_words from v),
lab as (select doc_id, min(quality) quality from labels where quality is not null group by 1),
u as (unpivot (select doc_id, stratum, quality, symbols, dup_lines, repeats, long_words, short_words from x join lab using (doc_id))
      on symbols, dup_lines, repeats, long_words, short_words into name rule value level),
grid as (select distinct stratum, rule, c from u, range(1, 51) t(c)),
k as (
  select grid.stratum, grid.rule, c, count(*) filter (quality = 1 and level >= c) k,
    count(*) filter (quality = 0 and level >= c) hits, count(*) filter (quality = 1) n
  from grid join u on u.stratum = grid.stratum and u.rule = grid.rule group by all),
p as (
  select *, (select sum(exp(lgamma(n + 1) - lgamma(j + 1) - lgamma(n - j + 1) + j * ln(0.01) + (n - j) * ln(0.99)))
             from range(0, k.k + 1) t(j)) tail from k where n > 0),
ok as (select *, hits - 10 * k gain from p where tail <= 0.1 / (5 * (select count(distinct stratum) from u)) and k < 0.01 * n),
cut as (select stratum, rule, c from ok where gain > 0 qualify row_number() over (partition by stratum, rule order by gain desc, c desc) = 1),
rej as (select distinct x.r from x join cut on cut.stratum = x.stratum and c <= case rule when 'symbols' then symbols when 'dup_lines'
   then dup_lines when 'repeats' then repeats when 'long_words' then long_words else short_words end)
select doc_id, n_words::bigint n_words, word_chars::bigint word_chars, n_symbols::bigint n_symbols, n_dup_lines::bigint n_dup_lines,
  n_repeat_words::bigint n_repeat_words, (n_words < 10 or 100 * n_repeat_words > 20 * n_words) base_failed,
  not (n_words < 10 or 100 * n_repeat_words > 20 * n_words) and rej.r is null kept
from x left join rej on rej.r = x.r
"""

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
ALNUM = rf"list_filter(regexp_split_to_array({_LOWER}, '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')"

DECONTAMINATION = rf"""
with d as (select row_number() over () r, doc_id, {ALNUM} w from documents),
i as (select coalesce(item_id::varchar, 'null') item, {ALNUM} w from benchmark),
it as (select item, w, least(len(w), 13) m from i where len(w) > 0),
iw as (select distinct item, m, array_to_string(list_slice(w, s, s + m - 1), ' ') g
       from (select item, w, m, unnest(range(1, len(w) - m + 2)) s from it)),
dw as (select r, m, s, array_to_string(list_slice(w, s, s + m - 1), ' ') g
       from (select r, w, m, unnest(range(1, len(w) - m + 2)) s from d, (select distinct m from it) where len(w) >= m)),
hit as (select r, s, iw.m, item from dw join iw on dw.m = iw.m and dw.g = iw.g),
cov as (select r, count(distinct p) n_hit from (select r, unnest(range(s, s + m)) p from hit) group by r),
its as (select r, count(distinct item) n_items, array_to_string(list_sort(list(distinct item)), ',') ids from hit group by r)
select doc_id, len(w)::bigint n_words, coalesce(n_hit, 0)::bigint n_hit, coalesce(n_items, 0)::bigint n_items,
  sha256(coalesce(ids, '')) items_sha256, coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(w) contaminated
from d left join cov using (r) left join its using (r)
"""

MIXING = rf"""
with recursive d as (select doc_id, coalesce(source, '') source, len({WORDS})::bigint n from documents),
s as (select source, sum(n)::bigint tokens, sum(n) / sum(sum(n)) over () share from d group by 1 having sum(n) > 0),
c as (select ln(count(*)) * 0.97 target, sum(tokens)::bigint total, -sum(share * ln(share)) plain from s),
e as (select 0 i, 0.0::double lo, 1.0::double hi union all
  select i + 1, case when h >= target then (lo + hi) / 2 else lo end, case when h >= target then hi else (lo + hi) / 2 end
  from (select i, lo, hi, target, (select ln(sum(pow(share, (lo + hi) / 2))) - sum(pow(share, (lo + hi) / 2) * ln(pow(share, (lo + hi) / 2)))
     / sum(pow(share, (lo + hi) / 2)) from s) h from e, c) where i < 32),
f as (select 0 i, 0.0::double lo, 1.0::double hi union all
  select i + 1, case when r <= 4 then lo else (lo + hi) / 2 end, case when r <= 4 then (lo + hi) / 2 else hi end
  from (select i, lo, hi, (select max(pow(share, (lo + hi) / 2 - 1)) / sum(pow(share, (lo + hi) / 2)) from s) r from f) where i < 32),
x as (select greatest(case when plain >= target then 1 else (select max(lo) from e) end,
  case when (select max(1 / share) / count(*) from s) <= 4 then 0 else (select min(hi) from f) end) ex, total from c),
p as (select source, tokens, floor(round(pow(share, ex) / (select sum(pow(share, ex)) from s, x), 9) * total)::bigint quota,
  ceil(tokens / 1000000)::bigint nb from s, x),
b as (select d.*, tokens, quota, ('0x' || substr(md5('17:' || coalesce(doc_id::varchar, 'null')), 1, 8))::bigint % nb block from d join p using (source)),
z as (select source, block, sum(n)::bigint size, any_value(tokens) tokens, any_value(quota) quota from b group by all),
ze as (select *, unnest(range(0, quota // tokens + 1)) epoch from z),
zo as (select *, row_number() over w block_pos, sum(size) over w - size before from ze
  window w as (partition by source, epoch order by md5('17:' || epoch || ':' || block || ':' || source), block)),
zr as (select *, case when epoch < quota // tokens then tokens else quota % tokens end - before room from zo),
t as (select b.doc_id, b.source, b.n, epoch, block_pos, size, room,
  sum(b.n) over (partition by b.source, epoch, b.block order by md5('17:' || epoch || ':' || coalesce(doc_id::varchar, 'null'))) upto
  from b join zr on zr.source = b.source and zr.block = b.block and room > 0)
select doc_id, source, n n_words, epoch::bigint epoch, block_pos::bigint block_pos from t where size <= room or upto <= room
"""


def license_sql(sentences: dict[str, str], rules: list[tuple[str, list[str]]]) -> str:
    known = ", ".join(f"('{s}', '{i}')" for s, i in sentences.items())
    steps, hits = [], []
    for i, (name, ids) in enumerate(rules):
        run = "".join(f"<{x}>" for x in ids)
        steps.append(f"q{i} as (select *, replace(l{i}, '{run}', '|') l{i + 1}, case when contains(l{i}, '{run}') then '{name}' end r{i} from {'base' if not i else f'q{i - 1}'})")
        hits.append(f"r{i}")
    return rf"""
with known(sentence, id) as (values {known}),
d as (select row_number() over () r, doc_id, list_filter(list_transform(regexp_split_to_array(coalesce(text, ''),
  '\n+|[.;:!?]+[\x20\x09]+|[.;:!?]+$'), lambda x: trim(regexp_replace(lower(x), '[^a-z0-9]+', ' ', 'g'))), lambda x: x <> '') s from documents),
u as (select r, unnest(range(1, len(s) + 1)) i, s from d),
h as (select r, string_agg(id, ',' order by i) ids, string_agg('<' || id || '>', '' order by i) seq
      from (select r, i, s[i] sentence from u) join known using (sentence) group by r),
base as (select doc_id, len(s)::bigint n_sentences, coalesce(ids, '') ids, coalesce(seq, '') l0 from d left join h using (r)),
{", ".join(steps)}
select doc_id, n_sentences, ids sentence_ids, array_to_string(list_sort(list_distinct(list_filter([{", ".join(hits)}], lambda x: x is not null))), ',') licenses,
  (length(l{len(rules)}) - length(replace(l{len(rules)}, '<', '')))::bigint n_unmatched from q{len(rules) - 1}
"""

SUBSTRING_DEDUP = rf"""
with d as (select row_number() over () r, doc_id, {WORDS} w from documents),
win as (select r, doc_id, s, array_to_string(list_slice(w, s, s + 12), ' ') g
        from (select r, doc_id, w, unnest(range(1, len(w) - 11)) s from d where len(w) >= 13)),
rep as (select r, s from (select r, s, doc_id, min(doc_id) over (partition by g) low from win) where low < doc_id),
gone as (select r, list(distinct p) ps from (select r, unnest(range(s, s + 13)) p from rep) group by r)
select doc_id, len(w)::bigint n_words, coalesce(len(ps), 0)::bigint n_removed,
  sha256(coalesce(array_to_string(list_filter(w, lambda x, i: not list_contains(coalesce(ps, []), i)), ' '), '')) kept_sha256
from d left join gone using (r)
"""

CRC_TABLE = """tab as materialized (
  select list_transform(range(256), lambda n: list_reduce(list_prepend(n::bigint, range(8)::bigint[]),
    lambda c, k: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end)) crc_tab)"""


def crc32_sql(text: str) -> str:
    """Unsigned CRC-32 of the UTF-8 bytes of ``text``, with the 256 entries of ``CRC_TABLE`` in ``crc_tab``."""
    code = f"hex(encode({text}))"
    data = f"list_transform(range(length({code}) // 2), lambda i: ('0x' || ({code})[2 * i + 1:2 * i + 2])::bigint)"
    step = "lambda c, x: xor(c >> 8, crc_tab[(xor(c, x) & 255) + 1])"
    return f"xor(list_reduce(list_prepend(4294967295, {data}), {step}), 4294967295)"


SHARDING = f"""
with {CRC_TABLE},
t as (select doc_id, coalesce(source, '') source, coalesce(text, '') body, hex(encode(coalesce(text, ''))) code from documents),
b as (select *, list_transform(range(length(code) // 2), lambda i: ('0x' || code[2 * i + 1:2 * i + 2])::bigint) bytes from t),
d as (
  select doc_id, source, length(code) // 2 + 1 size,
    xor(list_reduce(list_prepend(4294967295, bytes), lambda c, x: xor(c >> 8, crc_tab[(xor(c, x) & 255) + 1])), 4294967295) text_crc32
  from b, tab),
r as (
  select *, row_number() over (partition by source
      order by md5(concat_ws(':', '17', coalesce(doc_id::varchar, 'null'), text_crc32)), doc_id, size) nth,
    count(*) over (partition by source) n
  from d),
g as (select *, row_number() over (order by (nth - 0.5::double) / n, source) - 1 pos, count(*) over () total from r),
s as (select *, pos * 16 // total shard from g)
select doc_id, size::bigint size, text_crc32::bigint text_crc32, 'rows' law, shard::int shard,
  (pos - (shard * total + 15) // 16)::bigint slot, null::int grown_shard
from s
"""

CONVERSATION_REPAIR = f"""
with recursive {CRC_TABLE},
raw as (
  select conv_id, turn, coalesce(role, ' ') role, coalesce(text, ' ') body,
    {crc32_sql("concat(coalesce(conv_id::varchar, ' '), ':', coalesce(turn::varchar, ' '))")} % 20 k
  from conversations, tab),
names as (select conv_id, row_number() over () c from (select distinct conv_id from conversations)),
damaged as (
  select conv_id, turn, case k when 4 then 'user' else role end role,
    case k when 1 then '' when 2 then regexp_replace(body, '[.!?]', '', 'g') else body end body,
    unnest(range(case k when 0 then 0 when 3 then 2 else 1 end)) copy
  from raw),
placed as (
  select c, turn, role, body, rtrim(body, chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' ') ended,
    row_number() over (partition by c order by turn nulls first, md5(length(role) || ':' || role || body), copy) pos
  from damaged join names on damaged.conv_id is not distinct from names.conv_id),
faulty as (
  select *, role[1:1] initial, lag(role[1:1]) over (partition by c order by pos) before,
    case when ended = '' then 'blank' when row_number() over (partition by c, role, body order by pos) > 1 then 'duplicate'
      when ended[-1:] not in ('.', '!', '?') then 'truncated' else '' end fault
  from placed),
stats as (
  select c, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) gaps, count(*) n,
    count(*) filter (fault = 'blank') blank, count(*) filter (fault = 'duplicate') duplicate,
    count(*) filter (fault = 'truncated') truncated,
    count(*) filter (before is not null and before || initial not in ('su', 'ua', 'au')) illegal
  from faulty group by c),
-- states: 0 nothing written, 1 system, 2 user, 3 assistant; writes(before, initial, after)
writes(p, w, q) as (values (0, 's', 1), (0, 'u', 2), (1, 'u', 2), (2, 'a', 3), (3, 'u', 2)),
one as (select p, q from writes where w <> 's'),
inserts as (
  select p, p q, 0 k from (values (0), (1), (2), (3)) s(p) union all select p, q, 1 from one
  union all select a.p, b.q, 2 from one a join one b on a.q = b.p),
edits as (
  select i.p, i.q, 2 * k + 3 cost, repeat('I', k) || 'D' audit, null needs, true any_row from inserts i
  union all select i.p, w.q, 2 * k, repeat('I', k) || 'K', w.w, false from inserts i join writes w on i.q = w.p
  union all select i.p, w.q, 2 * k + 2, repeat('I', k) || 'R', null, false from inserts i join writes w on i.q = w.p where w.w <> 's'),
steps as (
  select f.c, f.pos, e.p, e.q, e.cost + case when f.fault = 'truncated' and not any_row then 1 else 0 end cost, e.audit
  from faulty f join edits e on any_row or (f.fault not in ('blank', 'duplicate') and (needs is null or needs = f.initial))),
ways as (
  select c, 0::bigint pos, 0 state, {{'cost': 0, 'audit': ''}} best from names
  union all
  select w.c, s.pos, s.q, min({{'cost': w.best.cost + s.cost, 'audit': w.best.audit || s.audit}})
  from ways w join steps s on s.c = w.c and s.pos = w.pos + 1 and s.p = w.state group by w.c, s.pos, s.q),
ended as (
  select w.c, min({{'cost': w.best.cost + 2 * e.k, 'audit': w.best.audit || repeat('I', e.k)}}) best
  from ways w join stats using (c) join (values (0, 0), (1, 2), (2, 1), (3, 0)) e(state, k) on w.state = e.state
  where w.pos = stats.n group by w.c),
ops as (select c, i, best.audit[i:i] op from (select c, best, unnest(range(1, length(best.audit) + 1)) i from ended)),
counted as (
  select *, sum((op <> 'I')::int) over (partition by c order by i) pos, sum((op <> 'D')::int) over (partition by c order by i) line from ops),
matched as (select o.*, role, body, initial from counted o left join faulty f on f.c = o.c and f.pos = o.pos and o.op <> 'I'),
lead_s as (select c, count(*) filter (line = 1 and op = 'K' and initial = 's') s from matched where op <> 'D' group by c),
written as (
  select c, i, case when op = 'K' then role when (line - s) % 2 = 1 then 'user' else 'assistant' end || ':' || coalesce(body, '') line
  from matched join lead_s using (c) where op <> 'D'),
texts as (select c, string_agg(line, chr(10) order by i) body from written group by c)
select conv_id, coalesce(gaps, 0)::bigint gaps, coalesce(blank, 0)::bigint blank, coalesce(duplicate, 0)::bigint duplicate,
  coalesce(truncated, 0)::bigint truncated, coalesce(illegal, 0)::bigint illegal, coalesce(best.cost, 0)::bigint "cost",
  coalesce(best.audit, '') audit, sha256(coalesce(body, '')) repaired_sha256
from names left join stats using (c) left join ended using (c) left join texts using (c)
"""

PREFIX_TRIE = f"""
with {CRC_TABLE},
rows as (
  select conv_id, turn, coalesce(role, '') role, coalesce(text, '') body,
    row_number() over (partition by conv_id order by turn nulls first, md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) nth
  from conversations),
ids as (select c, {crc32_sql("c::varchar")} % 4 h from (select distinct conv_id c from conversations where conv_id is not null), tab),
turns as (
  select c, 0 part, nth, role, body from ids join rows on conv_id = c - c % 20 and nth <= h
  union all select c, 1, nth, role, body from ids join rows on conv_id = c and nth > h),
placed as (
  select c, row_number() over (partition by c order by part, nth) depth,
    md5(length(role) || ':' || role || body) mark, len({WORDS.replace("text", "body")}) n_words from turns),
paths as (
  select c, 0 depth, '' path, 0 n_words from ids
  union all
  select c, depth, string_agg(mark, '') over (partition by c order by depth), n_words from placed),
sizes as (select c, max(depth) size from paths group by c),
nodes as (
  select path, any_value(depth) depth, min(c) conv_id, count(*) n_convs, any_value(n_words) n_words,
    string_agg(c::varchar, ',' order by c) filter (depth = size) ends
  from paths join sizes using (c) group by path),
linked as (select n.*, p.path parent_path, p.conv_id parent_conv_id from nodes n left join nodes p on n.depth > 0 and p.path = n.path[:-33]),
children as (select parent_path path, count(*) n from linked where depth > 0 group by 1),
full_nodes as (select l.*, coalesce(children.n, 0) n_children from linked l left join children using (path)),
-- every node with all nodes above it and itself
above as (select distinct a.path top, d.path from paths a join paths d on a.c = d.c and a.depth <= d.depth),
sums as (
  select top path, count(*) filter (n_children = 0) n_leaves, sum((n_convs - 1) * n_words) saved
  from above join full_nodes using (path) group by top)
select conv_id::bigint conv_id, depth::bigint depth, parent_conv_id::bigint parent_conv_id, n_convs::bigint n_convs,
  n_children::bigint n_children, n_leaves::bigint n_leaves, saved::bigint saved_tokens, sha256(coalesce(ends, '')) ends_sha256
from full_nodes join sums using (path)
"""
