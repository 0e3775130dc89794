"""The SQL that DuckDB runs beside the queries whose results SQL can express."""

from __future__ import annotations

from . import chatrepair, linededup, quality, urlfilter


_GAP = r"[\x20\x09-\x0D]"
_WORD = r"[^\x20\x09-\x0D]+"


def line_dedup() -> str:
    place = "partition by rid order by k"
    return f"""with r as (select row_number() over () as rid, * from (select distinct doc_id, text from documents where text is not null)),
 c as (select rid, unnest(regexp_extract_all(text, '{_GAP}*{_WORD}')) as chunk, unnest(range(len(regexp_extract_all(text, '{_WORD}')))) as k from r),
 w as (select *, regexp_extract(chunk, '{_WORD}') as word, sum(length(chunk)) over ({place}) as upto, contains(chunk, chr(10)) and k > 0 as breaks from c),
 o as (select *, k = 0 or breaks as opens, k = 0 or breaks or regexp_matches(word, '^\\p{{Lu}}') or regexp_matches(lag(word) over ({place}), '[.!?]$') as cuts from w),
 p as (select rid, k, upto, word, translate(word, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as low, sum(opens::int) over ({place}) as line, sum(cuts::int) over ({place}) as unit from o),
 u as (select rid, unit, any_value(line) as line, min(k) as first, max(k) + 1 as upto, min(upto - length(word)) as "start", max(upto) as "end", string_agg(low, ' ' order by k) as words from p group by 1, 2),
 l as (select rid, min(unit) as i, max(unit) as j from u group by rid, line having max(upto) - min(first) >= {linededup.MIN_WORDS}),
 ahead as (select a.rid, a.unit as i, b.unit as j from u a asof join u b on a.rid = b.rid and a.first + {linededup.RUN_WORDS} <= b.upto),
 behind as (select a.rid, b.unit as i, a.unit as j from u a asof join u b on a.rid = b.rid and a.upto - {linededup.RUN_WORDS} >= b.first),
 s as (select * from l union select * from ahead union select * from behind),
 d as (select s.rid, i, j, min("start") as "start", max("end") as "end", md5(string_agg(words, ' ' order by unit)) as digest from s join u on u.rid = s.rid and unit between i and j group by 1, 2, 3),
 f as (select d.*, doc_id, first_value(doc_id) over w as first_doc_id, first_value(d.rid) over w as first_rid, first_value("end") over w as first_end from d join r using (rid) window w as (partition by digest order by doc_id nulls last, rid, "start")),
 again as (select * from f where rid <> first_rid or "start" >= first_end),
 parted as (select *, case when "start" < max("end") over (partition by rid order by "start", "end" rows between unbounded preceding and 1 preceding) then 0 else 1 end as fresh from again),
 named as (select *, sum(fresh) over (partition by rid order by "start", "end" rows between unbounded preceding and current row) as part from parted)
 select any_value(doc_id) as doc_id, min("start")::bigint as "start", max("end")::bigint as "end" from named group by rid, part"""


def host_trust() -> str:
    rules = sorted(urlfilter.RULES, key=lambda r: -len(r[1]))
    fits = lambda r: f"(host = '{r.partition('/')[0]}' or ends_with(host, '.{r.partition('/')[0]}')) and starts_with(path, '/{r.partition('/')[2]}')"
    rule = "case " + " ".join(f"when {fits(r)} then '{r}'" for _, r in rules) + " end"
    said = "case rule " + " ".join(f"when '{r}' then '{v}'" for v, r in rules) + " end"
    low = lambda x: f"translate({x}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    link = r"""(?i)href\s*=\s*["'']?([a-z][a-z0-9+.-]*:)?(//[^"''\s>/?#]+)"""
    steps = [
        f"r as (select *, {rule} as rule from (select page_id, html, {low('regexp_extract(url, $$^(?s:.*?)://([^/?#]*)$$, 1)')} as host, regexp_extract(url, $$^(?s:.*?)://[^/?#]*([^?#]*)$$, 1) as path from pages))",
        f"ruled as (select *, {said} as said from (select page_id, html, coalesce(host, '') as host, coalesce(path, '') as path, rule from r))",
        f"h as (select host, count(*) filter (said = 'allow') / count(*) as a, count(*) filter (said = 'block') / count(*) as b from ruled where host <> '' group by 1)",
        f"seeds as (select host, 'trust' as kind from h where a > {urlfilter.SEED_SHARE} union all select host, 'distrust' from h where b > {urlfilter.SEED_SHARE})",
        f"found as (select host as src, unnest(regexp_extract_all(html, '{link}', 2)) as target from ruled)",
        f"named as (select src, {low('split_part(substr(target, 3), $$@$$, -1)')} as dst from found)",
        "edges as (select src, dst, count(*)::double as n from named where src <> '' and dst <> '' and src <> dst group by 1, 2)",
        "both_ways as (select 'trust' as kind, src, dst, n from edges union all select 'distrust', dst, src, n from edges)",
        "steps as materialized (select kind, src, dst, n / sum(n) over (partition by kind, src) as p from both_ways)",
        f"walk as (select 0 as i, kind, host, {1 - urlfilter.DAMPING} as score from seeds union all select i + 1, w.kind, dst, sum({urlfilter.DAMPING} * score * p) from walk w join steps s on s.kind = w.kind and s.src = w.host where i < {urlfilter.MOST} group by i, w.kind, dst)",
        f"t as (select host, coalesce(sum(score) filter (kind = 'trust'), 0) / {1 - urlfilter.DAMPING} as trust, coalesce(sum(score) filter (kind = 'distrust'), 0) / {1 - urlfilter.DAMPING} as distrust from walk group by 1)",
    ]
    steps.append("s as (select ruled.*, coalesce(trust, 0) as tr, coalesce(distrust, 0) as di from ruled left join t using (host))")
    return "with recursive " + ",\n ".join(steps) + f"\n select page_id, host, path, rule, coalesce(said, case when di >= {urlfilter.THRESHOLD} and di > tr then 'block' else 'allow' end) as verdict, round(tr, 6) as trust, round(di, 6) as distrust from s"


def quality_rules() -> str:
    grid = ", ".join(f"('{r}', {i}, {c})" for r, cuts in quality.GRID.items() for i, c in enumerate(cuts))
    p, rules = quality.RISK / len(quality.GRID), len(quality.GRID)
    return f"""with t as (select doc_id, coalesce(lang, '') as stratum, coalesce(text, '') as text from documents),
 w as (select *, list_filter(regexp_split_to_array(text, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') as words, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) as lines from t),
 m as (select doc_id, stratum, len(words) as n_words, length(array_to_string(words, '')) as word_chars, length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) as n_symbols, len(lines) - len(list_distinct(lines)) as n_dup_lines, length(regexp_replace(text, '\\P{{Lu}}', '', 'g')) as caps from w),
 g as (select doc_id, unnest(words) as x, unnest(range(len(words))) as i from w),
 win as (select doc_id, i, x, lead(x, 1) over d as y, lead(x, 2) over d as z from g window d as (partition by doc_id order by i)),
 rep as (select doc_id, i from (select doc_id, i, count(*) over (partition by doc_id, x, y, z) as c from win where z is not null) where c > 1),
 cov as (select doc_id, count(distinct i) as n_repeat_words from (select doc_id, i + unnest([0, 1, 2]) as i from rep) group by 1),
 a as (select m.*, coalesce(n_repeat_words, 0) as n_repeat_words, n_words < 50 or 100 * coalesce(n_repeat_words, 0) > 50 * n_words as base_failed from m left join cov using (doc_id)),
 s as (select *, {{'symbols': n_symbols / greatest(word_chars, 1), 'dup_lines': n_dup_lines / greatest(n_words, 1) * 10, 'repeats': n_repeat_words / greatest(n_words, 1), 'upper': caps / greatest(word_chars, 1)}} as v from a),
 val as (select doc_id, stratum, base_failed, unnest(['symbols', 'dup_lines', 'repeats', 'upper']) as rule, unnest([v.symbols, v.dup_lines, v.repeats, v.upper]) as score from s),
 grid(rule, step, cutoff) as (values {grid}),
 good as (select doc_id from labels group by 1 having min(quality) = 1 and max(quality) = 1),
 cells as (select stratum, rule, step, any_value(cutoff)::double as cutoff, count(*) as n, count(*) filter (score > cutoff) as k from val join grid using (rule) join good using (doc_id) where not base_failed group by 1, 2, 3),
 tests as (select count(distinct stratum) * {rules} as n_tests from cells),
 tail as (select stratum, rule, step, cutoff, case when k < n * {p} then list_sum(list_transform(range(k + 1), lambda j: exp(lgamma(n + 1) - lgamma(j + 1) - lgamma(n - j + 1) + j * ln({p}) + (n - j) * ln(1 - {p})))) else 1.0 end as pv from cells),
 ok as (select stratum, rule, cutoff, min(case when pv <= {quality.DELTA} / n_tests then 1 else 0 end) over (partition by stratum, rule order by step) as good_so_far from tail, tests),
 cuts as (select stratum, rule, min(cutoff) as cutoff from ok where good_so_far = 1 group by 1, 2),
 bad as (select distinct doc_id from val join cuts using (stratum, rule) where score > cutoff)
 select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, not base_failed and doc_id not in (select doc_id from bad) as kept from a"""


def _crc32(text: str) -> str:
    """CRC-32 of a text of ASCII characters."""
    table = "list_reduce(list_prepend(xor(c, b), range(8)::bigint[]), lambda x, k: case when x & 1 = 1 then xor(x >> 1, 3988292384::bigint) else x >> 1 end)"
    codes = f"list_transform(string_split({text}, ''), lambda ch: ascii(ch)::bigint)"
    return f"xor(list_reduce(list_prepend(4294967295::bigint, {codes}), lambda c, b: {table}), 4294967295::bigint)"


def chat_repair() -> str:
    r = chatrepair
    inserts = [(q, j, (r.AFTER[q] if j == 1 else r.AFTER[r.AFTER[q]] if j == 2 else r.AFTER[r.AFTER[r.AFTER[q]]]) if j else q) for q in range(4) for j in range(4)]
    arcs = sorted({(q, "'-'", "D", r.DELETE, q) for q in range(4)} | {(q, f"'{c}'", "K", r.KEEP, to) for (q, c), to in r.STEP.items()} | {(q, "'-'", "R", r.REROLE, r.AFTER[q]) for q in range(4)})
    values = lambda rows: ", ".join("(" + ", ".join(str(x) for x in row) + ")" for row in rows)
    order = "turn nulls first, role, digest, copy"
    return f"""with recursive
 raw as (select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text, coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' ') as name from conversations),
 hit as (select *, {_crc32("name")} % 20 as h from raw),
 hurt as (select conv_id, turn, case h when 4 then 'user' else role end as role, case h when 1 then '' when 2 then regexp_replace(text, '[.!?]', '', 'g') else text end as text, unnest(case h when 0 then [] when 3 then [1, 2] else [1] end) as copy from hit),
 marked as (select *, sha256(text) as digest from hurt),
 placed as (select *, row_number() over (partition by conv_id order by {order}) as i, row_number() over (partition by conv_id, role, digest order by {order}) as nth, role[1] as c from marked),
 r as materialized (select *, not regexp_matches(text, '[^{r.SPACE}]') as blank, nth > 1 as again, regexp_matches(text, '[^{r.SPACE}.!?][{r.SPACE}]*$') as opened, coalesce(lag(c) over (partition by conv_id order by i) || c not in ('su', 'ua', 'au'), false) as bad from placed),
 counts as (select conv_id, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0)::bigint as gaps, count(*) filter (blank)::bigint as blank, count(*) filter (not blank and again)::bigint as duplicate, count(*) filter (not blank and not again and opened)::bigint as truncated, count(*) filter (bad)::bigint as illegal, max(i) as m from r group by conv_id),
 ins(q, j, into_q) as (values {values(inserts)}),
 arc(q, c, letter, cost, into_q) as (values {values((q, c, f"'{x}'", cost, to) for q, c, x, cost, to in arcs)}),
 walk as (
  select conv_id, 0::bigint as i, 0 as q, 0::bigint as cost, '' as audit from counts
  union all
  select b.conv_id, b.i, b.q, b.best.cost, b.best.audit from (
   select w.conv_id, r.i, arc.into_q as q, min({{'cost': (w.cost + {r.INSERT} * j + arc.cost + case when letter <> 'D' and opened then {r.TRUNCATED} else 0 end)::bigint, 'audit': w.audit || repeat('I', j) || letter}}) as best
   from walk w join r on r.conv_id is not distinct from w.conv_id and r.i = w.i + 1 join ins on ins.q = w.q join arc on arc.q = ins.into_q and arc.c in ('-', r.c)
   where letter = 'D' or not (blank or again) group by w.conv_id, r.i, arc.into_q) b),
 tails(q, tail) as (values {values((q, f"'{t}'") for q, t in r.TAIL.items())}),
 ends as (select w.conv_id, min({{'cost': (w.cost + {r.INSERT} * length(tail))::bigint, 'audit': w.audit || tail}}) as best from walk w join counts on counts.conv_id is not distinct from w.conv_id and w.i = m join tails using (q) group by w.conv_id),
 letters as (select conv_id, unnest(string_split(best.audit, '')) as letter, generate_subscripts(string_split(best.audit, ''), 1) as k from ends where best.audit <> ''),
 spots as (select *, sum((letter <> 'D')::int) over w as place, sum((letter <> 'I')::int) over w as i from letters window w as (partition by conv_id order by k)),
 kept as (select s.conv_id, place, case letter when 'K' then r.role end as own, case letter when 'I' then '' else r.text end as text from spots s left join r on r.conv_id is not distinct from s.conv_id and r.i = s.i where letter <> 'D'),
 named as (select *, place - max(case when place = 1 and own[1] = 's' then 1 else 0 end) over (partition by conv_id) as pair from kept),
 sums as (select conv_id, sha256(string_agg(coalesce(own, case pair % 2 when 1 then 'user' else 'assistant' end) || ':' || text, chr(10) order by place)) as repaired_sha256 from named group by conv_id)
 select a.conv_id, coalesce(gaps, 0) as gaps, coalesce(blank, 0) as blank, coalesce(duplicate, 0) as duplicate, coalesce(truncated, 0) as truncated, coalesce(illegal, 0) as illegal, coalesce(best.cost, 0) as cost, coalesce(best.audit, '') as audit, coalesce(repaired_sha256, sha256('')) as repaired_sha256
 from (select distinct conv_id from conversations) a left join counts on counts.conv_id is not distinct from a.conv_id left join ends on ends.conv_id is not distinct from a.conv_id left join sums on sums.conv_id is not distinct from a.conv_id"""


def warc() -> str:
    return """with p as (select page_id, encode(coalesce(html, '')) as payload from pages),
 d as (select page_id, octet_length(payload)::bigint as payload_bytes, sha256(payload) as payload_digest from p),
 n as (select *, row_number() over (partition by payload_digest order by page_id nulls last) as nth, first_value(page_id) over (partition by payload_digest order by page_id nulls last) as head from d)
 select page_id, payload_bytes, payload_digest, case when nth > 1 and payload_bytes >= 100 then 'revisit' else 'response' end as record_type, case when nth > 1 and payload_bytes >= 100 then head end as refers_to from n"""
