"""SQL for the queries of `queries.py`, written for DuckDB over the same tables."""

from __future__ import annotations

from pagesift import tables
from pagesift.functions import dates, documents, text, urls
from pagesift.operators import conflicts, ranking
from pagesift.plans.queries import ADDRESSES, DECOYS, ENGINES

AS_OF, YEAR = "2025-03-15", 2025


def q(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def lst(values) -> str:
    return "[" + ", ".join(q(v) for v in values) + "]"


def pairs(values, a: str = "h", b: str = "p") -> str:
    return "[" + ", ".join(f"{{'{a}': {q(x)}, '{b}': {q(y)}}}" for x, y in values) + "]"


def weights(values: dict) -> str:
    return "(values " + ", ".join(f"({q(k)}, {float(v)}::double)" for k, v in values.items()) + ") as w(domain, weight)"


WHITE = q(text.WHITE)
SPACE = "[" + "".join(c for c in text.WHITE) + "]"
HAN = "[\\x{4e00}-\\x{9fff}]"


def strip(x: str) -> str:
    return f"trim(coalesce({x}, ''), {WHITE})"


def bare(x: str) -> str:
    """Without header."""
    return f"trim(regexp_replace({strip(x)}, '^#{{0,3}}\\s*来源\\s*[:：]\\s*\\S+\\s*', ''), {WHITE})"


def plain(x: str) -> str:
    return f"regexp_replace({bare(x)}, {q(SPACE + '+')}, '', 'g')"


def raw_host(u: str) -> str:
    return f"regexp_replace(regexp_replace(regexp_extract(lower({strip(u)}), '^(?:[a-z][a-z0-9+.-]*:)?//([^/?#]*)', 1), '^.*@', ''), ':[^:\\]]*$', '')"


def host(u: str) -> str:
    return f"regexp_replace({raw_host(u)}, '^www\\.', '')"


def path(u: str) -> str:
    return f"regexp_extract({strip(u)}, '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://[^/?#]*)?([^?#]*)', 1)"


def query_part(u: str) -> str:
    return f"regexp_extract({strip(u)}, '^[^?#]*\\?([^#]*)', 1)"


def path_and_query(u: str) -> str:
    return f"lower({path(u)} || case when {query_part(u)} <> '' then '?' || {query_part(u)} else '' end)"


def any_of(x: str, needles) -> str:
    return f"len(list_filter({lst(needles)}, lambda needle: contains({x}, needle))) > 0"


def any_pair(h: str, p: str, values) -> str:
    return f"len(list_filter({pairs(values)}, lambda needle: contains({h}, needle.h) and contains({p}, needle.p))) > 0"


def under(h: str, domains) -> str:
    return f"len(list_filter({lst(domains)}, lambda needle: ends_with('.' || {h}, '.' || needle))) > 0"


def blacklisted(u: str) -> str:
    return f"({raw_host(u)} <> '' and ({any_of(raw_host(u), tables.BLACKLISTED_HOSTS)} or {any_pair(raw_host(u), path_and_query(u), tables.BLACKLISTED_PATHS)}))"


def decoded(x: str) -> str:
    # bad escapes leave the text as it is
    return f"case when regexp_matches({x}, '%([^0-9a-fA-F]|[0-9a-fA-F][^0-9a-fA-F]|$|[0-9a-fA-F]$)') then {x} else url_decode({x}) end"


def tier(u: str) -> str:
    p = path_and_query(u)
    return f"case when {any_of(raw_host(u), tables.LOW_VALUE_HOSTS)} then 2 when {any_of(p, tables.LOW_VALUE_PATHS)} or {any_of('lower(' + decoded(p) + ')', tables.LOW_VALUE_PATHS)} then 1 else 0 end"


def soup(u: str) -> str:
    return f"({raw_host(u)} <> '' and ({any_of(raw_host(u), tables.TEXT_SOUP_HOSTS)} or {any_pair(raw_host(u), 'lower(' + path(u) + ')', tables.TEXT_SOUP_PATHS)}))"


def mill(u: str) -> str:
    return f"({under(raw_host(u), tables.REPORT_MILLS)} and regexp_matches(lower({path(u)}), '^/(?:zh|cn)(?:[/-]|$)|zh-cn'))"


def han_share(x: str) -> str:
    return f"(len(regexp_extract_all({x}, '{HAN}')) / greatest(length({x}), 1)::double)"


GARBLED = "|".join(f"(?:{p})" for p in text.GARBLED)


def garbled(x: str) -> str:
    return f"({strip(x)} = '' or regexp_matches(coalesce({x}, ''), {q(GARBLED)}) or (length({x}) > 200 and {han_share(x)} < 0.05 and len(regexp_extract_all({x}, '[A-Za-z]{{2,}}')) < 5))"


def template(t: str) -> str:
    markers = [m.lower() for m in tables.TEMPLATE_MARKERS]
    return f"({any_of(f'lower(substr({t}, 1, 3000))', markers)} or {any_of(f'lower(right({t}, 3000))', markers)})"


def block(t: str) -> str:
    return f"(length({t}) between 1 and {tables.BLOCK_PAGE_LENGTH} and {any_of(f'lower({t})', [m.lower() for m in tables.BLOCK_MARKERS])})"


def form_parts(t: str) -> dict[str, str]:
    n = f"length({t})"
    p = f"((length({t}) - length(translate({t}, {q(tables.PUNCTUATION)}, ''))) / greatest({n}, 1)::double)"
    lines = f"list_filter(string_split({t}, chr(10)), lambda x: trim(x, {WHITE}) <> '')"
    size = f"len({lines})"
    full = f"len(list_filter({lines}, lambda x: length(trim(x, {WHITE})) >= 15))"
    whole = f"coalesce(list_sum(list_transform({lines}, lambda x: length(x))), 0)"
    latin = f"(coalesce(list_sum(list_transform(regexp_extract_all({t}, '[A-Za-z]{{2,}}'), lambda x: length(x))), 0) / greatest({n}, 1)::double)"
    return {
        "length": f"case when {n} >= 200 then case when {n} > 8000 then greatest(0.7::double, 1.0 - ({n} - 8000) / 40000.0::double * 0.3::double) else 1.0 end when {n} >= 30 then ({n} - 30) / 170.0::double else 0.0 end::double",
        "punctuation": f"case when {p} < 0.01::double then {p} / 0.01::double else least(1.0::double, {p} / 0.05::double) * case when {p} > 0.3::double then 0.5::double else 1.0::double end end",
        "paragraphs": f"case when {size} = 0 then 0.0 when {size} <= 2 then case when {whole} >= 300 then 1.0 else 0.3 end else least(1.0::double, 0.5::double * ({full} / {size}::double) + 0.5::double * least(1.0::double, {size} / 6.0::double)) end::double",
        "language": f"least(1.0::double, greatest({han_share(t)}, {latin}) / 0.4::double)",
    }


def suffix_weight(h: str, values: dict, default: float) -> str:
    return f"coalesce((select w.weight from {weights(values)} where ends_with('.' || {h}, '.' || w.domain) order by length(w.domain) desc limit 1), {default}::double)"


def rounded(x: str, digits: int = 4) -> str:
    """Half up on the shortest decimal form of a double, as Spark rounds."""
    return f"round(({x})::double::varchar::decimal(38, 18), {digits})::double"


def number(x: str) -> str:
    return f"(case when isnan({x}) or {x} = -1 then null else {x} end)"


ALL_ADDRESSES = "(select distinct url from (select url from ledger_entry union all select url from fetched_item union all select url from candidate union all select url from eval_item union all select unnest(" + lst(ADDRESSES) + ")) where url is not null) a"
ITEMS = "(select distinct on (item_id) * replace (case when isnan(score) then null else score end as score) from fetched_item) i"

SQL: dict[str, str] = {}

SQL["u1_first_addresses"] = "select url, min(item_id) as item_id from fetched_item where regexp_matches(url, '^(?i)https?:') group by url"
_elem = f"lower({strip('url')})"
SQL["u2_hosts"] = f"""select url, {host('url')} as host, {raw_host('url')} as raw, lower(regexp_extract(url, '^https?://([^/?#]+)', 1)) as with_port,
  regexp_replace(case when contains({_elem}, '/') and {raw_host('url')} <> '' then {raw_host('url')} else {_elem} end, '^www\\.', '') as learner,
  round(least(1.0, (length(string_split(url, '//')[-1]) - length(replace(string_split(url, '//')[-1], '/', ''))) / 4.0), 4)::double as depth from {ALL_ADDRESSES}"""

_port = f"regexp_extract(regexp_extract({strip('url')}, '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)', 1), ':([^:\\]]*)$', 1)"
_scheme = f"lower(regexp_extract({strip('url')}, '^([A-Za-z][A-Za-z0-9+.-]*):', 1))"
_plus = "replace(url_encode(x), '%20', '+')"
SQL["u3_comparable"] = f"""
with parts as (
  select entry_id, {strip('url')} as s, {raw_host('url')} as h, {_port} as port, {_scheme} as scheme, regexp_replace({path('url')}, ';[^/]*$', '') as p, {query_part('url')} as qs from ledger_entry where url is not null
), paths as (
  select *, string_split(array_to_string(list_transform(string_split(p, ''), lambda c: case when regexp_matches(c, '^[!-~]?$') then c else url_encode(c) end), ''), '%') as ps from parts
), pairs as (
  select *, list_sort(list_filter(list_transform(list_filter(string_split(qs, '&'), lambda x: x <> ''), lambda x: {{'k': url_decode(replace(case when contains(x, '=') then split_part(x, '=', 1) else x end, '+', ' ')), 'v': url_decode(replace(case when contains(x, '=') then substr(x, instr(x, '=') + 1) else '' end, '+', ' '))}}), lambda x: not list_contains({lst(urls.TRACKING)}, lower(x.k)))) as kv,
    regexp_replace(array_to_string(list_transform(ps, lambda x, i: case when i > 1 and regexp_matches(x, '^[0-9a-fA-F]{{2}}') then upper(substr(x, 1, 2)) || substr(x, 3) else x end), '%'), '/+$', '') as pp from paths
), joined as (
  select *, array_to_string(list_transform(kv, lambda x: replace(url_encode(x.k), '%20', '+') || '=' || replace(url_encode(x.v), '%20', '+')), '&') as qq from pairs
)
select entry_id, case when s = '' then '' when h = '' or (port <> '' and not regexp_matches(port, '^[0-9]{{1,5}}$')) then lower(s)
  else h || case when port = '' or (scheme = 'http' and port = '80') or (scheme = 'https' and port = '443') then '' else ':' || port end || case when pp = '' then '/' else pp end || case when qq <> '' then '?' || qq else '' end end as page
from joined"""
SQL["s8_known_pages"] = f"""with u as ({SQL['u3_comparable']}), f as (select nurl, min(round_no) as known_round from ledger_entry where nurl <> '' group by 1)
select entry_id, known_round from u left join f on f.nurl = u.page"""
SQL["u4_u7_classes"] = f"select url, {blacklisted('url')} as blacklisted, {tier('url')} as tier, {soup('url')} as soup, {mill('url')} as mill from {ALL_ADDRESSES}"
SQL["u8_suffix_weights"] = f"""with h as (select distinct {host('url')} as host from {ALL_ADDRESSES})
select host, coalesce(max_by(weight, length(domain)), 1.0) as weight from h left join {weights({**tables.HOST_WEIGHTS, 'gov.test': 1.4, 'edu.test': 1.3, 'com.example': 0.8, 'cn.example': 0.7})} on ends_with('.' || host, '.' || domain) where host <> '' group by host"""
SQL["u9_skip_reasons"] = """with r as (select distinct item_id, url, [200, 403, 404, 451, 500][item_id % 5 + 1] as a, [200, 403, 404, 451, 500][(item_id // 5) % 5 + 1] as b, case when item_id % 3 = 0 then 'utf-8 codec can''t decode byte' else '' end as e from fetched_item)
select item_id, case when a in (404, 410) or b in (404, 410) then '404/410 gone' when a in (403, 451) and b in (403, 451) then '403/451 blocked at both L0 and L1'
  when contains(e, 'codec can''t decode') and (contains(lower(url), 'pdf') or (item_id % 2 = 0 and url is not null)) then 'binary decode failure on a PDF' else '' end as reason from r"""


def _file_name(x: str, most: int, fallback: str) -> str:
    s = f"substr(regexp_replace(regexp_replace(regexp_replace({strip(x)}, '[\\\\/:*?\"<>|\\x00-\\x1f]', '-', 'g'), {q(SPACE + '+')}, ' ', 'g'), '^[ .]+|[ .]+$', '', 'g'), 1, {most})"
    return f"case when {s} = '' then '{fallback}' else {s} end"


SQL["u14_file_names"] = f"select doc_id, {_file_name('title', 20, 'query')} as name, {_file_name(chr(39) + ' GB 4789.1:2016 ' + chr(39) + ' || url || ' + chr(39) + ' . ' + chr(39), 60, 'pdf')} as pdf from documents"
SQL["q1_q4_flags"] = f"with t as (select entry_id, body, {strip('body')} as s from ledger_entry) select entry_id, length({bare('body')}) as n, {garbled('body')} as garbled, {template('s')} as template, {block('s')} as block from t"
_fp = form_parts("t")
SQL["q5_form_parts"] = f"with d as (select doc_id, {bare('text')} as t from documents) select doc_id, " + ", ".join(f"round({e}, 6) as {k}" for k, e in _fp.items()) + ", 0.5::double as host from d"


def _hits(markers) -> str:
    return f"len(list_filter({lst(markers)}, lambda m: contains(scan, m)))"


def _score(u: str) -> str:
    weight = f"case when {under(host(u), tables.WHITELISTED_HOSTS)} then {suffix_weight(host(u), tables.HOST_WEIGHTS, 1.0)} else greatest(0.1::double, least(1.5::double, {suffix_weight(host(u), tables.HOST_WEIGHTS, 1.0)} + 0.0::double)) end"
    host_part = f"greatest(0.0::double, least(1.0::double, ({weight}) - 0.5::double))"
    form = f"(0.35::double * len_part + 0.2::double * punct_part + 0.2::double * para_part + 0.15::double * lang_part + 0.1::double * {host_part})"
    marked = f"(({form} - least(0.3::double, 0.03::double * weak) - least(0.3::double, 0.1::double * neg) + least(0.15::double, 0.03::double * pos)) * least(1.0::double, n / 200.0::double))"
    tiered = f"(case {tier(u)} when 2 then least({marked}, 0.2::double) when 1 then {marked} * 0.5::double else {marked} end)"
    capped = f"(case when {soup(u)} then least({tiered}, 0.2::double) else {tiered} end)"
    return f"case when t = '' or {blacklisted(u)} or blocked or bad then 0.0 when templ then 0.05 else round(greatest(0.0::double, least(1.0::double, {capped})), 4) end::double"


SQL["q7_content_score"] = f"""
with base as (select entry_id, coalesce(url, '') as url, {lst(ADDRESSES)}[entry_id % {len(ADDRESSES)} + 1] as other, {bare('body')} as t from ledger_entry),
parts as (select *, length(t) as n, lower(substr(t, 1, 3000)) || lower(right(t, 3000)) as scan, {block('t')} as blocked, {garbled('t')} as bad, {template('t')} as templ,
  {_fp['length']} as len_part, {_fp['punctuation']} as punct_part, {_fp['paragraphs']} as para_part, {_fp['language']} as lang_part from base),
marks as (select *, {_hits([m.lower() for m in tables.WEAK_MARKERS])} as weak, {_hits(tables.NEGATIVE_MARKERS)} as neg, {_hits(tables.POSITIVE_MARKERS)} as pos from parts)
select entry_id, round({_score('url')}, 4) as score, round({_score('other')}, 4) as other from marks"""
SQL["q8_collected"] = "select distinct item_id, batch_id from fetched_item where not isnan(score) and score >= 0.4"
SQL["q9_citations"] = r"""with a as (select doc_id, regexp_replace(text, '(?i)<sup>\s*\[[^\]]*\]\s*</sup>', '', 'g') as t from documents),
b as (select doc_id, regexp_replace(t, '\[\d+(?:\s*[-–,，]\s*\d+)*\]([^(\[]|$)', '\1', 'g') as t from a)
select doc_id, md5(regexp_replace(regexp_replace(coalesce(t, ''), '[ \t]{2,}', ' ', 'g'), '[ \t]+\n', chr(10), 'g')) as hash from b"""
_foot = "coalesce(text, '')"
for _p in text.FOOTERS:
    _foot = f"regexp_replace({_foot}, {q(_p.replace('(?dms)', '(?ms)'))}, '', 'g')"
SQL["q10_footers"] = f"""with c as (select doc_id, {_foot} as t from documents),
l as (select doc_id, list_transform(string_split(t, chr(10)), lambda x: {{'line': x, 's': trim(x, {WHITE})}}) as ls from c),
m as (select doc_id, list_transform(ls, lambda x: {{'line': x.line, 'blank': x.s = '', 'ok': length(x.s) > 20 or regexp_matches(x.s, '[。！？.!?]')}}) as ls from l),
n as (select *, coalesce(list_max(list_transform(ls, lambda x, i: case when x.ok or x.blank then i else 0 end)), 0) as last from m)
select doc_id, md5(coalesce(array_to_string(list_transform(list_filter(ls, lambda x, i: not x.blank and (x.ok or (i > last and len(ls) - last < 3))), lambda x: x.line), chr(10)), '')) as hash from n"""
SQL["q11_page_titles"] = f"select doc_id, substr(trim(regexp_replace(replace(chr(10) || ' ' || coalesce(title, ''), '|', '·') || ' ©', {q(SPACE + '+')}, ' ', 'g'), {WHITE}), 1, 200) as title from documents"

_terms = f"list_filter(regexp_split_to_array({strip('query')}, {q('(?:' + SPACE + '|[,，、;；])+')}), lambda t: length(t) >= 2)"
SQL["v1_v5_relevance"] = f"""
with asked as (
  select batch_id, {_terms} as cov, regexp_extract_all({strip('query')}, '{HAN}+') as runs, list_transform(regexp_extract_all({strip('query')}, '[A-Za-z]{{3,}}'), lambda w: lower(w)) as words from search_batch
), asked2 as (
  select *, list_transform(list_filter(cov, lambda t: regexp_matches(t, '[\\x{{4e00}}-\\x{{9fff}}A-Za-z]')), lambda t: lower(t)) as terms,
    list_transform(list_filter(cov, lambda t: regexp_matches(t, '[\\x{{4e00}}-\\x{{9fff}}A-Za-z]') and not list_contains({lst(tables.GENERIC_TERMS)}, t)), lambda t: lower(t)) as core,
    flatten(list_transform(runs, lambda r: flatten(list_transform(range(1, length(r) + 1), lambda i: list_transform(range(1, length(r) - i + 2), lambda n: substr(r, i, n)))))) as frags
  from asked
), hay as (
  select i.item_id, a.*, lower(coalesce(i.page_title, '') || chr(10) || {bare('i.text')}) as hay, lower(coalesce(i.page_title, '') || chr(10) || substr(coalesce(i.text, ''), 1, 500)) as win from {ITEMS} join asked2 a using (batch_id)
), parts as (
  select *, regexp_split_to_array(hay, '[^\\p{{L}}\\p{{N}}\\p{{M}}_]+') as toks, {han_share('hay')} as hs, {han_share('win')} as ws,
    greatest(0, coalesce(list_max(list_transform(list_filter(frags, lambda f: contains(hay, f)), lambda f: length(f))), 0)) as best_han from hay
), nums as (
  select *, greatest(best_han, coalesce(list_max(list_transform(list_filter(words, lambda w: list_contains(toks, w)), lambda w: length(w))), 0)) as best,
    len(list_filter(terms, lambda t: case when regexp_matches(t, '{HAN}') then contains(hay, t) else list_contains(toks, t) end)) as n_hits from parts
), done as (
  select item_id, case when not (len(words) > 0 or len(list_filter(runs, lambda r: length(r) >= 3)) > 0) then null when trim(hay, {WHITE}) = '' then 0 when best = 0 and len(runs) > 0 and len(words) = 0 and hs < 0.05 then null else best end as overlap,
    case when len(terms) < 2 then null when trim(hay, {WHITE}) = '' then 0 when len(list_filter(terms, lambda t: not regexp_matches(t, '{HAN}'))) = 0 and hs < 0.05 then null else n_hits end as hits,
    case when len(core) = 0 or trim(win, {WHITE}) = '' or (len(list_filter(core, lambda t: regexp_matches(t, '{HAN}'))) > 0 and ws < 0.05) then 99 else list_max(list_transform(core, lambda t: (length(win) - length(replace(win, t, ''))) // length(t))) end as front from nums
)
select *, overlap is null or overlap >= 3 or hits is null or hits >= 2 as kept, front < 2 as weak_core from done"""
SQL["v6_coverage"] = f"""
with asked as (select batch_id, list_distinct({_terms}) as terms from search_batch),
x as (select i.item_id, i.batch_id, lower(coalesce(i.text, '')) as low, a.terms from {ITEMS} join asked a using (batch_id)),
h as (select item_id, batch_id, low, unnest(terms) as term from x),
w as (select batch_id, term, ln(1 + max(n) / (1 + sum(contains(low, lower(term))::int))) as w from h join (select batch_id, count(*) as n from x group by 1) using (batch_id) group by 1, 2),
s as (select item_id, round(sum(w * contains(low, term)::int) / sum(w), 4) as c from h join w using (batch_id, term) group by 1)
select x.batch_id, x.item_id, coalesce(s.c, 0.5) as coverage from x left join s using (item_id)"""


def _title(x: str) -> str:
    return f"regexp_replace(lower({strip(x)}), '[^\\p{{L}}\\p{{N}}\\p{{M}}_]', '', 'g')"


def _bigrams(x: str) -> str:
    return f"list_distinct(list_transform(range(1, length({x})), lambda i: substr({x}, i, 2)))"


def _jaccard(a: str, b: str) -> str:
    union = f"len(list_distinct(list_concat({_bigrams(a)}, {_bigrams(b)})))"
    return f"(case when {a} = '' or {b} = '' then 0.0 when length({a}) = 1 and length({b}) = 1 then ({a} = {b})::int when {union} = 0 then 0.0 else len(list_intersect({_bigrams(a)}, {_bigrams(b)})) / {union}::double end)::double"


SQL["v7_title_mismatch"] = f"""
with c as (select distinct on (batch_id, url) batch_id, url, title from candidate where url is not null order by batch_id, url, pos, title nulls first),
x as (select i.item_id, regexp_replace({strip('i.url')}, '^(https?://[^/]*/).*$', '\\1') as home, {_title('i.page_title')} as p, {_title('c.title')} as t, {_title('b.query')} as a from {ITEMS} join search_batch b using (batch_id) join c on c.batch_id = i.batch_id and c.url = i.url)
select item_id, len(list_filter(string_split({path('home')}, '/'), lambda s: s <> '')) <= 1 and length(t) >= 8 and length(p) >= 8 and not (a <> '' and length(t) >= 6 and {_jaccard('t', 'a')} > 0.8) and {_jaccard('t', 'p')} < 0.15 as mismatch,
  round({_jaccard('p', 'a')}, 6) as likeness from x"""

_W, _A = ranking.WEIGHTS, ranking.AD_PARTS
SQL["r1_meta_rank"] = f"""
with pool as (
  select distinct on (batch_id, url) batch_id, url, coalesce(title, '') as title, coalesce(snippet, '') as body, date, positions from candidate where url is not null order by batch_id, url, pos, title nulls first, snippet nulls first, date nulls first
), asked as (
  select batch_id, coalesce(query, '') as query, list_distinct(list_concat(
    flatten(list_transform(regexp_extract_all(lower(query), '{HAN}+'), lambda r: case when length(r) < 2 then [r] else list_transform(range(1, length(r)), lambda i: substr(r, i, 2)) end)),
    list_filter(regexp_extract_all(lower(query), '[a-z0-9][a-z0-9+._-]*'), lambda w: length(w) >= 2))) as terms from search_batch
), items as (
  select p.*, a.query, a.terms, title || chr(10) || body as txt, lower(regexp_extract(url, '^https?://([^/?#]+)', 1)) as h from pool p join asked a using (batch_id)
), hits as (
  select batch_id, url, unnest(terms) as term, title, txt from items
), w as (
  select batch_id, term, ln(1 + max(n) / (1 + sum(contains(txt, term)::int))) as w from hits join (select batch_id, count(*) as n from items group by 1) using (batch_id) group by 1, 2
), rel as (
  select batch_id, url, least(1.0, (1.35 * sum(w * contains(lower(title), term)::int) + 0.3 * sum(w * contains(lower(txt), term)::int)) / (1.35 * sum(w))) as rel from hits join w using (batch_id, term) group by 1, 2
), model(h, p_bad) as (values ('m.relqui.edu.test', 0.9::double), ('m.linshaqui.com.example', 0.05), ('vorlinmis.edu.test', 0.7)
), f as (
  select i.*, coalesce(r.rel, 0) as rel, count(*) over (partition by i.batch_id, i.h) as burst, coalesce(m.p_bad, 0.4) as p_bad,
    list_filter(regexp_split_to_array(lower({strip('query')}), {q(SPACE + '+')}), lambda p: length(p) >= 2) as parts,
    case when not regexp_matches(query, '[\\x{{3040}}-\\x{{30ff}}]') and regexp_matches(query, '{HAN}') and len(regexp_extract_all(txt, '[\\x{{3040}}-\\x{{30ff}}]')) > 0.03 * greatest(length(txt), 1) then 0.25 else 1.0 end as lang,
    list_filter(list_transform(regexp_split_to_array(body, '[。！？\\n]+'), lambda s: trim(s, {WHITE})), lambda s: length(s) >= 8) as sents,
    greatest(1, length(body)) as n, list_min(map_values(positions)) as best, try_cast(nullif(regexp_extract(coalesce(date, ''), '^(\\d{{4}})', 1), '') as int) as yr
  from items i left join rel r using (batch_id, url) left join model m on m.h = i.h
), g as (
  select *, case when len(parts) = 0 then 0.0 else len(list_filter(parts, lambda p: contains(lower(title), p))) / len(parts)::double end as phrase,
    case when yr is null then 0.5 when {YEAR} - yr <= 2 then 1.0 else greatest(0.0, 1 - ({YEAR} - yr - 2) / 5.0) end as fresh,
    0.34 * least(1.0, length(body) / 500.0) + 0.22 * least(1.0, length(body) / (length(title) + 1)::double / 20.0) + 0.22 * least(1.0, len(regexp_extract_all(body, '{HAN}+')) * 2 / n::double / 0.45)
      + 0.1 * least(1.0, len(regexp_extract_all(body, '[，。！？；：、,.!?;:]')) / greatest(1.0, length(body) / 120.0)) + 0.12 * (1 - case when len(sents) >= 4 then 1 - len(list_distinct(sents)) / len(sents)::double else 0 end) as qual,
    least(1.0, (length(string_split(url, '//')[-1]) - length(replace(string_split(url, '//')[-1], '/', ''))) / 4.0) as depth,
    regexp_matches(title, {q(ranking.PRICE)})::int as price, least(1.0, (len(regexp_extract_all(body, 'https?://')) + len(regexp_extract_all(body, '\\]\\('))) / 10.0) as links,
    least(1.0, (length(body) < 30)::int + ((length(body) - length(replace(body, chr(65533), '')) + len(regexp_extract_all(substr(body, 1, 2000), '[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f]'))) / n::double > 0.002)::int
      + (coalesce(list_sum(list_transform(regexp_extract_all(substr(body, 1, 3000), '<[a-zA-Z/!][^>]*>'), lambda x: length(x))), 0) / least(n, 3000)::double > 0.05)::int) as broken
  from f
), s as (
  select batch_id, url, coalesce(best, 99) as best, round(0.2 * (phrase * lang) + 0.38 * (rel * lang) + 0.18 * qual + 0.14 * (1.0 / (1.0 + 0.35 * (greatest(1, coalesce(best, 20)) - 1))) + 0.05 * fresh + 0.05 * depth
    - 1.6 * greatest(0.0, least(1.0, 0.55 * p_bad + 0.3 * price + 0.2 * links + 0.15 * least(1.0, (burst - 1) / 3.0))) - 1.15 * greatest(0.0, least(1.0, broken + 0.35 * p_bad)), 6)::double as score from g
)
select batch_id, url, score, row_number() over (partition by batch_id order by score desc, best, url) as rank from s"""
_auth = suffix_weight(raw_host("addr"), tables.AUTHORITY, tables.AUTHORITY_DEFAULT)
_kinds = " + ".join(f"regexp_matches(coalesce(t, ''), {q(p)})::int" for p in text.SCHOLARLY)
SQL["r6_authority"] = f"""with d as (select doc_id, {lst(ADDRESSES)}[doc_id % {len(ADDRESSES)} + 1] as addr, text || case when doc_id % 4 = 0 then chr(10) || 'DOI: 10.1234/x 收稿日期：2020' when doc_id % 4 = 1 then chr(10) || 'ISSN 1000-1234' else '' end as t from documents),
e as (select doc_id, {_auth} as base, {_kinds} as kinds from d)
select doc_id, round(base, 4) as base, round(case when base >= 0.75 or kinds = 0 then base else least(0.75::double, base + 0.1::double * least(kinds, 2)) end, 4) as authority from e"""
_labels = f"""(select query as batch_id, eval_id as pos, coalesce(case when isnan(form) then null else least(greatest(form, 0.0), 1.0) end, 0) as f, coalesce({number('authority')}, 0) as a, case when eval_id % 3 = 0 then 0.0 else coalesce({number('coverage')}, 0) end as c, coalesce(weak_core, false) as weak from eval_item) l"""
_rs = rounded("f * (0.5::double + a) * (0.9::double + 0.2::double * c) * case when weak then 0.45::double else 1.0::double end")
SQL["r8_rank_items"] = f"with s as (select *, {_rs} as rank_score, {rounded('0.5::double * f + 0.4::double * a + 0.1::double * c')} as linear from {_labels}) select pos as eval_id, rank_score, linear, row_number() over (partition by batch_id order by rank_score desc, pos) as rank from s"
SQL["r10_zero_coverage"] = f"""with s as (select *, {_rs} as rs from {_labels}),
t as (select *, count(*) over (partition by batch_id) as n, list(rs) over (partition by batch_id) as all_rs from s),
u as (select *, n >= 10 and c = 0 and rs < list_sort(all_rs)[n // 2 + 1] as gone from t),
v as (select *, count(*) filter (not gone) over (partition by batch_id) as kept, row_number() over (partition by batch_id, gone order by rs desc, pos) as back from u),
k as (select * from v where not gone or kept + back <= 5)
select pos as eval_id, row_number() over (partition by batch_id order by rs desc, pos) as rank from k"""
SQL["r11_top"] = f"select * from (select batch_id, item_id, row_number() over (partition by batch_id order by coalesce(score, 0) desc, item_id) as rank from {ITEMS}) where rank <= 15"
SQL["r12_truncate"] = f"""with s as (select batch_id, item_id, score, length({strip('text')}) as n from {ITEMS}),
t as (select *, sum(n) over (partition by batch_id order by coalesce(score, 0) desc, item_id rows unbounded preceding) as upto from s where n > 0),
u as (select *, min(case when upto > 4000 then upto end) over (partition by batch_id) as f from t),
v as (select *, case when f is null or upto < f then 'whole' when upto = f and 4000 - (upto - n) > 100 then 'cut' else 'dropped' end as status from u)
select item_id, status, (case status when 'whole' then n when 'cut' then 4000 - (upto - n) else 0 end)::int as shown from v"""
SQL["r13_fetch_window"] = f"""with s as (select batch_id, item_id, {host('url')} as h, (item_id % 11 = 0)::int as failed from {ITEMS}),
t as (select *, h <> '' and coalesce(max(failed) over (partition by batch_id, h order by item_id rows between unbounded preceding and 1 preceding), 0) = 1 as skipped from s)
select item_id, skipped, not skipped and sum((not skipped)::int) over (partition by batch_id order by item_id rows unbounded preceding) <= 29 as tried from t"""
SQL["r14_interleave"] = f"""with s as (select batch_id, item_id, {host('url')} as h from {ITEMS}), t as (select *, (h <> '' and row_number() over (partition by batch_id, h order by item_id) > 2)::int as late from s)
select item_id, late, row_number() over (partition by batch_id order by late, item_id) as new_pos from t"""
_stats = f"""(select *, case when n < 5 then 0.0 when ok = 0 and n >= 8 then -0.5 when ok / n::double < 0.2 then -0.5 when (case when ok > 0 then score_sum / ok else 0 end) < 0.25 and low / n::double > 0.6 then -0.4
    when (case when lat_n > 0 then lat_sum / lat_n else 0 end) > 25 then -0.3 when (case when ok > 0 then score_sum / ok else 0 end) > 0.7 and n >= 10 then 0.1 else 0.0 end::double as delta
  from (select host, count(*) as n, count(*) filter (ok) as ok, coalesce(sum(sc) filter (ok), 0) as score_sum, sum(coalesce(sc < 0.25, false)::int + bad::int) as low, coalesce(sum(lat), 0) as lat_sum, count(lat) as lat_n
    from (select distinct on (obs_id) obs_id, regexp_replace(case when contains(e, '/') and rh <> '' then rh else e end, '^www\\.', '') as host, coalesce(fetch_ok, false) as ok, case when isnan(score) then null else score end as sc,
        coalesce(template_hit or garbled_hit, false) as bad, case when latency > 0 then latency end as lat from (select *, lower({strip('host')}) as e, {raw_host('host')} as rh from observation)) where host <> '' group by host))"""
SQL["r15_demote"] = f"""with c as (select distinct on (batch_id, url) batch_id, pos, url, engine, coalesce({lst(ADDRESSES)}[pos % 60 + 1], url) as a from candidate where url is not null order by batch_id, url, pos),
f as (select c.*, {tier('a')} > 0 as low, {blacklisted('a')} as bl, {host('a')} <> '' and not {under(host('a'), tables.WHITELISTED_HOSTS)} and coalesce(s.delta, 0) <= -0.4 as neg,
  len(list_filter(coalesce(engine, []), lambda e: e <> '')) > 0 and len(list_filter(coalesce(engine, []), lambda e: e <> '' and not list_contains({lst(DECOYS)}, e))) = 0 as dec from c left join {_stats} s on s.host = {host('a')})
select batch_id, url, row_number() over (partition by batch_id order by dec, neg, bl, low, pos, url) as new_pos from f"""
SQL["r20_quota"] = f"""with s as (select batch_id, item_id, length({strip('text')}) as n from {ITEMS}), t as (select *, greatest(0, 2000 - coalesce(sum(n) over (partition by batch_id order by item_id rows between unbounded preceding and 1 preceding), 0)) as room from s)
select item_id, least(n, room)::int as shown, case when room = 0 then 'used' when n = 0 then 'empty' when n > room then 'cut' else 'whole' end as state from t"""


def _grams(x: str) -> str:
    return f"(case when {x} = '' then []::varchar[] when length({x}) < 3 then [{x}] else list_distinct(list_transform(range(1, length({x}) - 1), lambda i: substr({x}, i, 3))) end)"


SQL["s2_containment"] = f"""with p as (select entry_id, substr({plain('body')}, 1, 512) as t from ledger_entry), g as (select entry_id, {_grams('t')} as g from p)
select a.entry_id, len(a.g) as n, round(coalesce(len(list_intersect(a.g, b.g)) / nullif(least(len(a.g), len(b.g)), 0)::double, 0), 6) as containment from g a join g b on b.entry_id = a.entry_id + 1"""
_slices = f"""(select round_no, entry_id, k, t from (select round_no, entry_id, unnest([0, 1, 2, 3]) as k, substr({plain('body')}, unnest([0, 1, 2, 3]) * 512 + 1, 512) as t from ledger_entry) where t <> '')"""
_gram_rows = f"(select round_no, entry_id, k, len(gs) as size, unnest(gs) as gram from (select *, {_grams('t')} as gs from {_slices}))"
_pairs = f"""pr as (select round_no, a, b, max(c) as similarity from (select x.round_no, x.entry_id as a, y.entry_id as b, count(*) / least(max(x.size), max(y.size))::double as c from {_gram_rows} x join {_gram_rows} y on x.round_no = y.round_no and x.gram = y.gram and x.entry_id < y.entry_id group by x.round_no, x.entry_id, y.entry_id, x.k, y.k) group by 1, 2, 3)"""
SQL["s4_slices"] = f"with {_pairs} select round_no, a as entry_a, b as entry_b, round(similarity, 6) as similarity from pr where similarity > 0.3"
_bits = " | ".join(f"(case when sum(case when (h >> {b}) & 1 = 1 then n else -n end) > 0 then 1::ubigint << {b} else 0::ubigint end)" for b in range(64))
_hash = f"""sh as (select l.entry_id, coalesce(s.v, 0) as v from ledger_entry l left join (
  select entry_id, {_bits} as v from (select entry_id, ('0x' || substr(md5(g), 1, 16))::ubigint as h, count(*)::hugeint as n from (select entry_id, unnest(list_transform(range(1, length(t) - 1), lambda i: substr(t, i, 3))) as g from (select entry_id, substr({plain('body')}, 1, 2000) as t from ledger_entry) where length(t) >= 3) group by 1, 2) group by 1) s using (entry_id))"""
_signed = "(case when v >= 9223372036854775808 then (v::hugeint - 18446744073709551616)::bigint else v::bigint end)"
SQL["s5_simhash"] = f"with {_hash} select entry_id, {_signed} as simhash from sh"
SQL["s6_hamming"] = f"with {_hash} select a.entry_id, bit_count(xor(a.v::ubigint, b.v::ubigint))::bigint as distance from sh a join sh b on b.entry_id = a.entry_id + 1"
_cluster = f"""with recursive {_pairs}, {_hash},
e as (select a, b from pr where similarity > 0.6 union select x.entry_id, y.entry_id from (select l.round_no, s.* from sh s join ledger_entry l using (entry_id) where v <> 0) x join (select l.round_no, s.* from sh s join ledger_entry l using (entry_id) where v <> 0) y on x.round_no = y.round_no and x.entry_id < y.entry_id and bit_count(xor(x.v::ubigint, y.v::ubigint)) <= 4),
both_ways as (select a, b from e union select b, a from e),
reach(id, r) as (select entry_id, entry_id from ledger_entry union select reach.id, both_ways.b from reach join both_ways on both_ways.a = reach.r),
lab as (select id, min(r) as cluster from reach group by 1),
full_ as (select l.round_no, lab.id, lab.cluster, length(coalesce(l.body, '')) as n from lab join ledger_entry l on l.entry_id = lab.id),
done as (select *, row_number() over (partition by cluster order by n desc, id) = 1 as keep from full_)"""
SQL["s7_clusters"] = f"{_cluster} select id as entry_id, cluster, keep from done"
SQL["a8_cluster_stats"] = f"{_cluster} select round_no as batch_id, count(*) as before, count(*) filter (keep) as after, count(*) filter (not keep) as dropped from done group by 1"
SQL["l1_record"] = """with r as (select *, row_number() over () as x from ledger_entry where nurl is not null and nurl <> '')
select nurl, min(round_no) as round_no, max(length(coalesce(body, ''))) as n from r group by nurl"""
SQL["l2_evict"] = """with r as (select round_no, sum(length(coalesce(body, ''))) as n from ledger_entry group by 1), s as (select round_no, sum(n) over (order by round_no desc) <= 400000 or row_number() over (order by round_no desc) = 1 as keep from r)
select entry_id, case when keep then length(body) else 0 end as n from ledger_entry join s using (round_no)"""
SQL["h1_host_stats"] = f"select host, n, ok, round(score_sum, 4) as score_sum, low, round(lat_sum, 3) as lat_sum, lat_n, delta from {_stats}"
SQL["h5_capped_hosts"] = f"""with s as (select * from {_stats}), r as (select *, count(*) over () as total, row_number() over (partition by coalesce(delta, 0) < 0 order by n, host) as k from s)
select host, n, delta from r where coalesce(delta, 0) < 0 or k > total - 60"""
SQL["h6_deltas"] = f"select item_id, coalesce(s.delta, 0) as delta from {ITEMS} left join {_stats} s on s.host = {host('url')}"
_lh = f"regexp_replace(case when contains(lower({strip('url')}), '/') and {raw_host('url')} <> '' then {raw_host('url')} else lower({strip('url')}) end, '^www\\.', '')"
SQL["h7_observed"] = f"select batch_id, {_lh} as host, min(item_id) as item_id from {ITEMS} where {_lh} <> '' group by 1, 2"
SQL["a1_engines"] = f"""with c as (select distinct batch_id, url, pos, engine from candidate where url is not null), e as (select unnest(engine) as engine, (len(engine) = 1)::int as solo from c), h as (select engine, count(*) as hits, sum(solo)::bigint as solo from e where engine <> '' group by 1), k as (select unnest({lst(ENGINES)}) as engine)
select coalesce(h.engine, k.engine) as engine, coalesce(hits, 0) as hits, coalesce(solo, 0) as solo, hits is null as idle from h full join k on h.engine = k.engine"""
_money = q(conflicts.MONEY)
_amounts = f"""am as (select distinct round_no, entry_id, metric, u as unit, v::double * case when s = '万亿' then 10000.0 else 1.0 end as value from (
  select round_no, entry_id, metric, unnest(regexp_extract_all(near, {_money}, 1)) as v, unnest(regexp_extract_all(near, {_money}, 2)) as s, unnest(regexp_extract_all(near, {_money}, 3)) as u from (
    select round_no, entry_id, substr(body, p, 4) as metric, substr(body, greatest(1, p - 60), p - greatest(1, p - 60)) || substr(body, p, 64) as near from (
      select round_no, entry_id, body, unnest(list_filter(range(1, length(body) + 1), lambda i: list_contains({lst(conflicts.METRICS)}, substr(body, i, 4)))) as p from ledger_entry where regexp_matches(body, '{"|".join(conflicts.METRICS)}')))))"""
_each = "ea as (select round_no, entry_id, metric, unit, min(value) as lo, max(value) as hi from am group by all)"
SQL["a2_self_conflicts"] = f"with {_amounts}, {_each} select distinct entry_id from ea where lo > 0 and hi >= 5 * lo"
SQL["a2_conflicts"] = f"""with {_amounts}, {_each}, se as (select round_no, metric, unit, count(*) as selfs from ea where lo > 0 and hi >= 5 * lo group by 1, 2, 3), va as (select round_no, metric, unit, count(distinct value) as n, min(value) as lo, max(value) as hi from am group by 1, 2, 3),
bo as (select round_no, metric, unit, coalesce(selfs, 0) as selfs, case when n >= 5 and lo > 0 and hi >= 10 * lo then n end as "distinct", case when n >= 5 and lo > 0 and hi >= 10 * lo then lo end as lowest, case when n >= 5 and lo > 0 and hi >= 10 * lo then hi end as highest from va left join se using (round_no, metric, unit)),
ra as (select *, row_number() over (partition by round_no order by coalesce("distinct", 0) desc, metric, unit) as r from bo where selfs > 0 or "distinct" is not null)
select round_no, metric, unit, selfs, "distinct", round(lowest, 4) as lowest, round(highest, 4) as highest from ra where r <= 2"""
_clean = f"""cl as (select distinct on (query, url) eval_id, query, url, coalesce(domain, '') as domain, coalesce({number('form')}, 0) as form, coalesce({number('authority')}, 0) as authority, coalesce({number('coverage')}, 0) as coverage, coalesce({number('rel')}, 0) as rel, coalesce(weak_core, false) as weak_core from eval_item where query is not null and url is not null order by query, url, eval_id)"""


def _replay(form: str) -> str:
    return f"""(select query, array_to_string(list_sort(list({{'r': r, 'url': url}}) filter (r <= 3)).list_transform(lambda x: x.url), ' ') as top3, max(case when r = 1 then rel end) as top1_rel, round(avg(rel), 4) as top5_rel, count(*) filter (rel = 0) as off_top5
  from (select *, row_number() over (partition by query order by {rounded(form + ' * (0.5::double + authority) * (0.9::double + 0.2::double * coverage) * case when weak_core then 0.45::double else 1.0::double end')} desc, eval_id) as r from cl) where r <= 5 group by query)"""


SQL["a3_replay"] = f"with {_clean} select * from {_replay('form')}"
SQL["a4_regressions"] = f"""with {_clean}, n as (select query, unnest(['top1_rel', 'top5_rel', 'off_top5']) as metric, unnest([top1_rel, top5_rel, -off_top5::double]) as v from {_replay('0.5::double')}), b as (select query, unnest(['top1_rel', 'top5_rel', 'off_top5']) as metric, unnest([top1_rel, top5_rel, -off_top5::double]) as v from {_replay('form')})
select query, metric, b.v as was, n.v as "is" from n join b using (query, metric) where n.v < b.v"""
SQL["a5_grid"] = f"""with {_clean}, g as (select (35 + 5 * f) / 100.0::double as wf, a / 100.0::double as wa from range(8) x(f), (values (10), (20), (30), (40), (50)) y(a)),
s as (select *, {rounded('wf * form + wa * authority + greatest(0.0::double, 1 - wf - wa) * coverage')} as s from cl, g), p as (select *, row_number() over (partition by wf, wa, query order by s desc, eval_id) as r from s)
select wf as w_form, wa as w_authority, round(avg(authority), 6) as top5_auth, round(avg(case when r = 1 then authority end), 6) as first_auth, count(*) filter (rel = 0) as low_bad from p where r <= 5 group by 1, 2"""
SQL["a6_leave_one_out"] = f"""with {_clean}, g(w, wf, wa, wc) as (values (0, 0.5::double, 0.4::double, 0.1::double), (1, 0.6, 0.25, 0.15), (2, 0.35, 0.5, 0.15), (3, 0.8, 0.1, 0.1)),
p as (select *, row_number() over (partition by w, query order by {rounded('wf * form + wa * authority + wc * coverage')} desc, eval_id) as r from cl, g), t as (select * from p where r <= 5),
k as (select distinct domain, w from t), b as (select k.domain, k.w, round((select avg(rel) from t where t.w = k.w and t.domain <> k.domain), 6) as others, round((select avg(rel) from t where t.w = k.w and t.domain = k.domain), 6) as own from k),
o as (select *, row_number() over (partition by domain order by coalesce(others, -1) desc, w) as r, max(own) over (partition by domain) as top from b)
select domain, w, others, own, top - own <= 0.02 as stable from o where r = 1"""
SQL["a9_profile"] = f"with {_clean} select domain, count(*) as rows, count(distinct query) as queries, count(distinct {host('url')}) as hosts from cl group by rollup (domain)"


def _iso(y: str, m: str, d: str) -> str:
    return f"coalesce(strftime(try_strptime(lpad({y}, 4, '0') || '-' || lpad({m}, 2, '0') || '-' || lpad({d}, 2, '0'), '%Y-%m-%d'), '%Y-%m-%d'), '')"


def _month(x: str) -> str:
    return f"coalesce(nullif(list_position({lst(dates.MONTHS)}, lower(substr({x}, 1, 3))), 0)::varchar, '')"


def _normalized(s: str) -> str:
    def ex(p: str, k: int) -> str:
        return f"regexp_extract({s}, {q(p)}, {k})"

    n1, n2 = r"^(\d{4})-(\d{1,2})-(\d{1,2})", r"^(\d{4})[/.](\d{1,2})[/.](\d{1,2})"
    cn = r"^(\d{4})\s*年\s*(\d{1,2})\s*月(?:\s*(\d{1,2})\s*日)?"
    en = r"^([A-Za-z]{3,9})\.?\s+(\d{1,2})(?:st|nd|rd|th)?,?\s+(\d{4})"
    ago = r"(?i)^(\d+)\s*(minute|hour|day|week|month|year)s?\s+ago$"
    units = "case lower(" + ex(ago, 2) + ") " + " ".join(f"when '{k}' then {v}" for k, v in dates.UNIT_DAYS.items()) + " end"
    return (
        f"case when {s} = '' then '' when regexp_matches({s}, {q(n1)}) then {_iso(ex(n1, 1), ex(n1, 2), ex(n1, 3))} when regexp_matches({s}, {q(n2)}) then {_iso(ex(n2, 1), ex(n2, 2), ex(n2, 3))}"
        f" when regexp_matches({s}, {q(cn)}) then {_iso(ex(cn, 1), ex(cn, 2), 'case when ' + ex(cn, 3) + chr(32) + '= ' + chr(39) * 2 + ' then ' + chr(39) + '1' + chr(39) + ' else ' + ex(cn, 3) + ' end')}"
        f" when regexp_matches({s}, {q(en)}) and {_month(ex(en, 1))} <> '' then {_iso(ex(en, 3), _month(ex(en, 1)), ex(en, 2))}"
        f" when regexp_matches({s}, {q(ago)}) then strftime(date '{AS_OF}' - (try_cast({ex(ago, 1)} as int) * {units})::int, '%Y-%m-%d') else '' end"
    )


def _page_date(t: str) -> str:
    s = f"substr(coalesce({t}, ''), 1, 2000)"
    cn = rf"(?i)(?:{dates.LABELS_CN})\s*[:：]?\s*(\d{{4}})\s*[-/年]\s*(\d{{1,2}})\s*[-/月]\s*(\d{{1,2}})"
    en = rf"(?i)(?:{dates.LABELS_EN})(?:\s+on)?\s*[:：]?\s*(?:([A-Za-z]{{3,9}})\.?\s+(\d{{1,2}})(?:st|nd|rd|th)?|(\d{{1,2}})(?:st|nd|rd|th)?\s+([A-Za-z]{{3,9}})\.?)\s*,?\s+(\d{{4}})"
    c = [f"regexp_extract({s}, {q(cn)}, {k})" for k in range(6)]
    e = [f"regexp_extract({s}, {q(en)}, {k})" for k in range(6)]
    return f"case when {_iso(c[1], c[2], c[3])} <> '' then {_iso(c[1], c[2], c[3])} when {_month(e[1] + ' || ' + e[4])} <> '' then {_iso(e[5], _month(e[1] + ' || ' + e[4]), e[2] + ' || ' + e[3])} else '' end"


SQL["t1_dates"] = f"with d as (select date from candidate union select page_date from documents), s as (select distinct date, {strip('date')} as s from d where date is not null) select date, {_normalized('s')} as iso from s"
SQL["t2_page_dates"] = f"""with d as (select doc_id, text, {strip('page_date')} as s, case when doc_id % 3 = 0 then 'Last updated on : 31 August, 2024' || chr(10) when doc_id % 3 = 1 then 'Published: Oct 6, 2023' || chr(10) else '' end || text as t from documents)
select doc_id, {_page_date('text')} as iso, {_page_date('t')} as labelled, coalesce(nullif({_normalized('s')}, ''), {_page_date('text')}) as best from d"""
_line = f"list_transform(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_replace(trim(x, {WHITE}), {q(SPACE + '+')}, ' ', 'g'))"
SQL["t5_titles"] = f"""with d as (select doc_id, coalesce(case when doc_id % 3 = 0 then substr(title, 1, 6) || '最终版' else title end, '') as t, {_line} as ls from documents),
e as (select *, list_filter(ls, lambda x: length(x) between 2 and 50 and not regexp_matches(x, '[。；，,;:：？！?!]') and regexp_matches(x, {q(documents.CONTENTS)})) as hs from d)
select doc_id, length(t) < 4 or list_contains({lst(documents.GENERIC_TITLES)}, lower(t)) or regexp_matches(lower(t), '^microsoft (?:word|powerpoint|excel)') or len(list_filter({lst(documents.EXPORT_SUFFIXES)}, lambda s: ends_with(lower(t), s))) > 0 or (length(t) <= 20 and regexp_matches(t, {q(documents.EXPORT_NAMES)})) as generic,
  coalesce(substr(array_to_string(list_filter(ls, lambda x: length(x) >= 4 and not regexp_matches(x, '(?i)^(?:ICS|CCS)\\b') and not regexp_matches(x, '^\\d+(?:\\.\\d+)*$') and not starts_with(x, '中华人民共和国')), ' '), 1, 120), '') as "first",
  coalesce(array_to_string(list_slice(list_filter(hs, lambda x, i: list_position(list_transform(hs, lambda y: lower(y)), lower(x)) = i), 1, 18), ' | '), '') as contents from e"""
SQL["t9_pdf_payloads"] = "select doc_id, doc_id % 2 = 0 and doc_id % 1100 + 5 <= 1024 as pdf from documents"
SQL["src5_first_success"] = """with a as (select url, unnest([0, 1, 2]) as level, unnest([case when doc_id % 2 = 0 then substr(text, 1, 200) end, case when doc_id % 3 = 0 then substr(text, 1, 400) end, case when doc_id % 4 = 0 then substr(text, 1, 600) end]) as t from documents)
select distinct on (url) url, level, length(t) as n from a where length(t) > 0 order by url, level"""
SQL["snk6_summary"] = f"""with r as (select batch_id, count(*) as fetched, count(*) filter (template_hit) as truncated, count(*) filter (garbled_hit) as mt, regexp_replace(coalesce(max(url), ''), '^https?://', '') as u from {ITEMS} group by 1)
select batch_id, concat_ws(' · ', case when fetched > 0 then 'fetched: ' || fetched end, case when truncated > 0 then 'truncated: ' || truncated end, case when mt > 0 then 'mt_flagged: ' || mt end) as line, case when length(u) > 58 then substr(u, 1, 57) || '…' else u end as shown from r"""


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
