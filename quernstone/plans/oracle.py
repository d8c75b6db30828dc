"""The catalogue's queries in SQL, for comparison."""

from __future__ import annotations

SCORES = """
e as (select vec_id, label, embedding::double[] as v from embeddings),
s as (select q.vec_id as query_id, q.label, c.vec_id as id, c.label as other, list_cosine_similarity(q.v, c.v) as score
      from e q join e c on q.vec_id % 50 = 0 and q.vec_id <> c.vec_id),
h as (select * from (select *, row_number() over (partition by query_id order by score desc, id) as rank from s) where rank <= 5),
x as (select query_id, label, expected_id from (
        select q.vec_id as query_id, q.label, c.vec_id as expected_id, row_number() over (partition by q.vec_id order by list_cosine_similarity(q.v[1:32], c.v[1:32]) desc, c.vec_id) as n
        from e q join e c on q.vec_id % 50 = 0 and q.vec_id <> c.vec_id) where n = 1)
"""

RANKS = SCORES + """,
o as (select x.query_id, x.label, x.expected_id, s.score from x left join s on s.query_id = x.query_id and s.id = x.expected_id),
r as (select o.query_id, o.label, o.expected_id,
        case when any_value(o.score) is not null then 1 + sum(case when s.score > o.score or (s.score = o.score and s.id < o.expected_id) then 1 else 0 end)::bigint end as rank
      from o left join s on s.query_id = o.query_id group by all)
"""

FAMILIES = SCORES + """,
g as (select x.query_id, h.score from x left join h on h.query_id = x.query_id and h.id = x.expected_id where x.label <> 9),
a as (select * from (select query_id, score, row_number() over (partition by query_id order by score desc, id) as rank
      from s where label = 9 and other <> 9) where rank <= 5),
d as (select x.query_id, max(a.score) as best from x left join a on a.query_id = x.query_id where x.label = 9 group by 1)
"""

SERIES = FAMILIES + """,
b as (select 'golden' as series, round(score, 6) as score from g where score is not null
      union all select 'distractor', round(score, 6) from a)
"""

STRIP = r"'^[\s\x{00a0}]+|[\s\x{00a0}]+$', '', 'g'"


def unescaped(t: str) -> str:
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&#039;", "''"), ("&apos;", "''"), ("&nbsp;", " "), ("&middot;", "·"), ("&copy;", "©"), ("&amp;", "&")):
        t = f"replace({t}, '{entity}', '{char}')"
    return t


def lines_stripped(t: str) -> str:
    return f"array_to_string(list_transform(string_split({t}, chr(10)), lambda l: regexp_replace(l, {STRIP})), chr(10))"


def raw_body(t: str) -> str:
    """The canonical text of a body without markup: lines stripped, empty lines at most one."""
    return rf"regexp_replace(regexp_replace({lines_stripped(t)}, '\n{{3,}}', chr(10) || chr(10), 'g'), {STRIP})"


CANONICAL = unescaped(r"regexp_replace(regexp_replace(html, '</(?:p|div|li|tr|h[1-6])>|<br\s*/?>', chr(10), 'gi'), '<[^>]+>', '', 'g')")


def measured(t: str) -> str:
    bare = rf"regexp_replace(regexp_replace(regexp_replace({t}, '<(br|/p|/li|/tr|/h[1-6])[^>]*>', chr(10), 'gi'), '<li[^>]*>', '- ', 'gi'), '<[^>]+>', '', 'g')"
    flat = rf"regexp_replace(regexp_replace(replace(replace({unescaped(bare)}, '{chr(160)}', ' '), chr(13), ''), '[ \t]+', ' ', 'g'), '\n\s*\n+', chr(10), 'g')"
    return f"regexp_replace({lines_stripped(flat)}, {STRIP})"


JUDGED = r"""
w as (select doc_id, lang, text, regexp_extract_all(lower(text), '[\p{L}\p{N}_]+') as w from documents),
j as (select doc_id, lang, not (len(list_filter(w, lambda x: x in ('the', 'les', 'und', 'que'))) > 0
        and len(list_filter(w, lambda x: x not in ('the', 'les', 'und', 'que'))) <= 10) as keep,
        substr(regexp_replace(text, '^\s+|\s+$', '', 'g'), 1, 80) as evidence from w)
"""

CALLS = """
p(vendor, alias, pin, pout) as (values ('added', 'north', 0.9::double, 4.2::double), ('inside', 'south', 2.2, 11.0), ('inside', 'east', 0.6, 3.1), ('own', 'west', 0.0, 0.0)),
k as (select event_id, value, (['north', 'south', 'east', 'west'])[(user_id % 4)::int + 1] as alias, floor(value * 100)::bigint as n from events),
t as (select event_id, value, alias, n as a, floor(n / 3)::bigint as b, floor(n / 10)::bigint as w, floor(n / 2)::bigint as r from k),
c as (select t.*, case vendor when 'added' then (a + 1.25::double * w + 0.1::double * r) * pin / 1e6 + b * pout / 1e6
        when 'inside' then (greatest(a - r, 0) + 0.1::double * r) * pin / 1e6 + b * pout / 1e6 else 0 end as cost_usd from t join p using (alias))
"""

MODE = """
e{m} as (select vec_id, label, (embedding::double[])[{a}:{b}] as v from embeddings),
s{m} as (select q.vec_id as query_id, c.vec_id as id, list_cosine_similarity(q.v, c.v) as score from e{m} q join e{m} c on q.vec_id % 50 = 0 and q.vec_id <> c.vec_id),
x{m} as (select query_id, expected_id from (
        select q.vec_id as query_id, c.vec_id as expected_id, row_number() over (partition by q.vec_id order by list_cosine_similarity(q.embedding::double[], c.embedding::double[]) desc, c.vec_id) as n
        from embeddings q join embeddings c on q.vec_id % 50 = 0 and q.vec_id <> c.vec_id) where n = 1),
o{m} as (select x.query_id, x.expected_id, s.score from x{m} x left join s{m} s on s.query_id = x.query_id and s.id = x.expected_id),
r{m} as (select '{m}' as mode, o.query_id, case when any_value(o.score) is not null then 1 + sum(case when s.score > o.score or (s.score = o.score and s.id < o.expected_id) then 1 else 0 end) end as rank
  from o{m} o left join s{m} s on s.query_id = o.query_id group by o.query_id)
"""

#: What is wrong with each document taken as a parsed record (``catalogue.record_texts``), from the
#: documents' own columns: errors of the fields in their order, then of the whole record.
CHECKED = r"""
a as (select doc_id, lang, source, n_chars, doc_id % 6 as kind, regexp_replace(substr(text, 1, 40), '^\s+|\s+$', '', 'g') as problem, text,
        '2024-' || lpad((doc_id % 14)::varchar, 2, '0') || '-' || lpad((doc_id % 33)::varchar, 2, '0') as day from documents),
f as (select *, list_filter([
        case when try_cast(day as date) is null then 'date: not a date' end,
        case when lang is null then 'component: missing' when trim(lang) = '' then 'component: blank or missing' end,
        case when kind = 2 then case when n_chars is null then 'problem: missing' else 'problem: not a text' end when text is null then 'problem: missing' when problem = '' then 'problem: blank or missing' end,
        case when source is null then 'symptoms: missing' when trim(source) = '' then 'symptoms: blank or missing' end,
        case when (kind = 3 and lang is not null) or (kind <> 3 and lang is null and false) then 'error_codes: not a list of texts' end,
        case when n_chars % 4 = 0 then 'cause: blank or missing' end,
        case when source is null then 'solution: missing' when trim(source) = '' then 'solution: blank or missing' end,
        case when n_chars is null then 'resolution: missing' end,
        case when kind = 1 and n_chars is not null then 'extra: unknown field' end], lambda x: x is not null) as e from a),
v as (select *, case when kind = 4 then 'rekord: not a JSON object' when len(e) > 0 then array_to_string(e, '; ')
        when n_chars % 5 = 0 then 'rekord: vocabulary version is not 1'
        when 'class ' || (n_chars % 3) not in (select 'class ' || (r_regionkey // 2) from region where r_regionkey % 2 = 0) then 'rekord: resolution is not in the vocabulary' else '' end as errors from f)
"""

#: The same as model answers: date and version are the source's.
ANSWERED = CHECKED + r""",
w as (select doc_id, case when kind = 4 then 'rekord: not a JSON object' when len(g) > 0 then array_to_string(g, '; ')
        when n_chars % 3 = 2 then 'rekord: resolution is not in the vocabulary' else '' end as errors
      from (select *, list_filter(e, lambda x: x <> 'date: not a date') as g from v))
"""

TURNS = """
t as (select conv_id, turn, role, text, row_number() over (partition by conv_id, turn > 0 order by turn) as place from conversations)
"""


def entity_values() -> str:
    """Names and values of the HTML5 references, as SQL values."""
    from html.entities import html5

    quoted = lambda t: "'" + t.replace("'", "''") + "'"
    return ", ".join(f"({quoted('&' + name)}, {quoted(value)})" for name, value in sorted(html5.items()) if name.endswith(";"))


LOCATED = "least(n - 1, floor({f} * n)::bigint)::int + 1"

RENDERED = """select conv_id, 'ZGŁOSZENIE ' || conv_id || ' z 2024-01-01' || chr(10) || 'Temat: rozmowa' || chr(10) || chr(10) || 'OPIS ZGŁASZAJĄCEGO:' || chr(10)
          || coalesce(nullif(max(case when turn = 0 then text end), ''), '(brak opisu)') || chr(10)
          || coalesce(string_agg(line, chr(10) order by turn) filter (where turn > 0), chr(10) || '(brak komentarzy w wątku)') as thread
        from (select *, chr(10) || 'KOMENTARZ ' || row_number() over (partition by conv_id, turn > 0 order by turn) || ' — ' || role || ', ' || turn || ' (typ: zwyczajny):' || chr(10)
                || coalesce(nullif(text, ''), '(pusty komentarz)') as line from conversations) group by conv_id"""

STRATIFIED = """with d as (select doc_id, lang, row_number() over (partition by lang order by doc_id::varchar) - 1 as pos from documents where length(text) > 50),
        n as (select lang, count(*) as n from d group by 1), q as (select lang, n, greatest(1, round_even(200 * n / (select sum(n) from n)::double, 0)::bigint) as quota from n),
        z as (select *, greatest(1, n // quota) as step from q)
        select doc_id, lang from d join z using (lang) where pos % step = 0 and pos // step < quota order by doc_id limit 200"""

ORACLE = {
    "search_topk": f"with {SCORES} select query_id, rank::int as rank, id as vec_id, round(score, 6) as score from h",
    "search_threshold": f"with {SCORES} select x.query_id, count(*) filter (where score >= 0.30) as kept, count(*) filter (where score < 0.30) as dropped_below from x left join h using (query_id) group by 1",
    "rank_full": f"with {RANKS} select query_id, expected_id, rank from r",
    "rank_topk_miss": f"with {SCORES} select x.query_id, x.expected_id, coalesce(h.rank, 1000000)::int as rank from x left join h on h.query_id = x.query_id and h.id = x.expected_id",
    "recall_curve": f"""with {RANKS}, y as (select *, query_id % 2 as parity, unnest(range(1, 11)) as k from r)
        select case when grouping(y.label) = 0 then 'label' when grouping(y.parity) = 0 then 'parity' else 'overall' end as grouping, coalesce(y.label::varchar, 'all') as label, coalesce(y.parity::varchar, 'all') as parity, k::int as k, count(*) as n,
          round(100.0::double * count(*) filter (where rank <= k) / count(*), 6) as recall, round(coalesce(sum(1.0::double / rank), 0) / count(*), 6) as mrr
        from y group by grouping sets ((k), (k, y.label), (k, y.parity))""",
    "modes_compare": f"""with {MODE.format(m="problem", a=1, b=32)}, {MODE.format(m="sts", a=33, b=64)}, u as (select * from rproblem union all select * from rsts)
        select mode, round(100.0::double * count(*) filter (where rank <= 1) / count(*), 6) as recall_1, round(100.0::double * count(*) filter (where rank <= 3) / count(*), 6) as recall_3,
          round(100.0::double * count(*) filter (where rank <= 5) / count(*), 6) as recall_k, round(avg(1.0::double / rank), 6) as mrr from u group by mode""",
    "threshold_sweep": f"""with {FAMILIES}, t as (select i / 100.0::double as threshold from (select unnest(range(30, 61, 2)) as i))
        select threshold, (select count(*) from g where score >= threshold) as kept,
          round(coalesce(100.0::double * (select count(*) from g where score >= threshold) / nullif((select count(*) from g), 0), 0), 6) as kept_percent,
          (select count(*) from g where score < threshold) as cut, (select count(*) from d where coalesce(best < threshold, true)) as silenced,
          round(coalesce(100.0::double * (select count(*) from d where coalesce(best < threshold, true)) / nullif((select count(*) from d), 0), 0), 6) as silenced_percent from t""",
    "score_distribution": f"""with {SERIES}, l as (select series, list_sort(list(score)) as v, count(*) as n from b group by 1)
        select series, n, v[1] as min, v[{LOCATED.format(f="0.05::double")}] as p05, v[{LOCATED.format(f="0.25::double")}] as p25, round((v[((n - 1) // 2)::int + 1] + v[(n // 2)::int + 1]) / 2, 6) as median,
          v[{LOCATED.format(f="0.75::double")}] as p75, v[{LOCATED.format(f="0.95::double")}] as p95, v[n::int] as max from l""",
    "score_histogram": f"""with {SERIES}, i as (select unnest(range(0, 100)) as i), n as (select series, count(*) as n from b group by 1)
        select b.series, i::int as bin, round(100.0::double * count(*) / any_value(n), 6) as share
        from b join i on score >= i / 100.0::double and (score < (i + 1) / 100.0::double or (i = 99 and score = 1)) join n on n.series = b.series group by 1, 2""",
    "strip_html_canonical": f"select page_id, regexp_replace(regexp_replace({lines_stripped(CANONICAL)}, '\\n{{3,}}', chr(10) || chr(10), 'g'), {STRIP}) as body from pages",
    "strip_html_sampling": f"select page_id, {measured('html')} as body from pages",
    "render_thread": RENDERED,
    "thread_budget": f"select conv_id, sum(len)::int as chars, sum(len) + 500 <= 2304 as fits from (select conv_id, length({measured('text')}) as len from conversations) group by 1",
    "embedding_text": "select doc_id, concat_ws(chr(10), lang, text) as embedded from documents",
    "format_duration": """select event_id, case when s < 90 then round_even(s, 0)::bigint || 's' when floor(s) < 3600 then floor(s)::bigint // 60 || 'min ' || lpad((floor(s)::bigint % 60)::varchar, 2, '0') || 's'
          else floor(s)::bigint // 3600 || 'h ' || lpad((floor(s)::bigint // 60 % 60)::varchar, 2, '0') || 'min' end as took from (select event_id, value * 37 as s from events)""",
    "quality_verdicts": f"with {JUDGED} select doc_id, keep, case when not keep then 'no_resolution' end as rule, case when not keep then evidence end as evidence from j",
    "quality_report": f"with {JUDGED} select 'no_resolution' as rule, count(*) as dropped from j where not keep having count(*) > 0",
    "index_report": f"""with {JUDGED} select count(*) as read, count(*) filter (where keep) as indexed, count(*) filter (where not keep) as dropped,
          round(count(*) filter (where not keep) / count(*)::double, 6) as drop_rate, count(*) >= 50 and count(*) filter (where not keep) / count(*)::double < 0.095 as warning from j""",
    "filter_vs_labels": f"""with {JUDGED}, l as (select distinct doc_id from labels where quality = 0), d as (select doc_id from j where not keep)
        select (select count(*) from d where doc_id in (select doc_id from l)) as caught, (select count(*) from d where doc_id not in (select doc_id from l)) as false_positives,
          (select count(*) from l where doc_id not in (select doc_id from d)) as missed""",
    "not_yet_processed": "select doc_id from documents where doc_id not in (select doc_id from labels)",
    "kept_semi": f"with {JUDGED} select doc_id, lang from j where keep",
    "stratified_sample": STRATIFIED,
    "export_nested": """select o_orderkey, c_name, n_name, r_name, case when o_orderpriority = '1-URGENT' then 'konsultant' when o_orderstatus = 'O' then 'klient' else 'brak' end as role,
          coalesce(n, 0)::int as line_count, lines from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey
          left join (select l_orderkey, count(*) as n, string_agg(l_linenumber || ':' || l_partkey || ':' || l_suppkey, ',' order by l_linenumber, l_partkey, l_suppkey) as lines from lineitem group by 1) on l_orderkey = o_orderkey""",
    "export_verify": """with d as (select o_orderkey from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey),
        a as (select (select count(*) from d) as documents, (select count(*) from lineitem join d on l_orderkey = o_orderkey) as nested_rows, (select count(*) from orders) as parents,
          (select count(*) from lineitem join orders on l_orderkey = o_orderkey) as source_rows) select *, documents = parents and nested_rows = source_rows as complete from a""",
    "validate_json": """select event_id, concat_ws('; ', case when not coalesce(try(json_type(props) = 'OBJECT'), false) then 'rekord: not a JSON object' end,
          case when len(list_filter(json_keys(props), lambda k: k <> 'k')) > 0 then 'rekord: unknown field' end,
          case when coalesce((json_extract_string(props, '$.k'))::int < 10, true) then 'k: below 10' end,
          case when event_type not in ('view', 'click', 'purchase') then 'event_type: not in the vocabulary' end) as errors from events""",
    "llm_cost": f"with {CALLS} select event_id, alias, round(cost_usd, 9) as cost_usd from c",
    "run_totals": f"with {CALLS} select alias, count(*) as calls, sum(a)::bigint as tokens_in, sum(b)::bigint as tokens_out, round(sum(value), 2) as latency, round(sum(cost_usd), 6) as cost_usd from c group by 1",
    "running_elapsed": "select event_id, (sum(round(value * 100)::bigint) over (partition by user_id order by event_id))::bigint as elapsed from events",
    "upsert_latest": "select user_id, event_id, event_type, value from events qualify row_number() over (partition by user_id order by ts desc, event_id desc) = 1",
    "point_ids": """select doc_id, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' || lower(printf('%02x', (('0x' || substr(h, 17, 2))::int & 63) | 128)) || substr(h, 19, 2) || '-' || substr(h, 21, 12) as point_id
        from (select doc_id, sha1(unhex('6f1d5a3c6b8e5e2a9a440f2c6f9c1b77') || doc_id::varchar::blob) as h from documents)""",
    "validate_records": f"with {CHECKED} select doc_id, errors from v",
    "validation_summary": f"with {CHECKED} select count(*) as checked, count(*) filter (where errors <> '') as failed, count(*) filter (where errors <> '') = 0 as ok from v",
    "html_entities": f"""with r as (select page_id, regexp_extract_all(html, '&#?[A-Za-z0-9]+;') as l from pages), u as (select page_id, unnest(l) as reference, generate_subscripts(l, 1) - 1 as place from r)
        select page_id, place::int as place, reference, case when reference like '&#x%' or reference like '&#X%' then chr(('0x' || substr(reference, 4, length(reference) - 4))::int) when reference like '&#%' then chr(substr(reference, 3, length(reference) - 3)::int)
          else coalesce(c, reference) end as text from u left join (values {entity_values()}) as e(n, c) on n = reference""",
    "html_numbers": """select event_id, chr((event_id % 50000 + 160)::int) || '.' || chr((event_id % 50000 + 160)::int) || ' &;' as text from events""",
    "mode_deltas": f"""with {MODE.format(m="problem", a=1, b=32)}, {MODE.format(m="sts", a=33, b=64)}, u as (select * from rproblem union all select * from rsts),
        m as (select mode, 100.0::double * count(*) filter (where rank <= 1) / count(*) as a, 100.0::double * count(*) filter (where rank <= 3) / count(*) as b,
          100.0::double * count(*) filter (where rank <= 5) / count(*) as c, avg(1.0::double / rank) as d from u group by mode)
        select round(p.a - s.a, 6) as recall_1_delta, round(p.b - s.b, 6) as recall_3_delta, round(p.c - s.c, 6) as recall_k_delta, round(p.d - s.d, 6) as mrr_delta from m p, m s where p.mode = 'problem' and s.mode = 'sts'""",
    "mode_table": f"""with {MODE.format(m="problem", a=1, b=32)}, {MODE.format(m="sts", a=33, b=64)}, u as (select * from rproblem union all select * from rsts)
        select case when query_id % 100 = 0 then 'even' else 'odd' end as input, mode, round(100.0::double * count(*) filter (where rank <= 1) / count(*), 6) as recall_1,
          round(100.0::double * count(*) filter (where rank <= 3) / count(*), 6) as recall_3, round(100.0::double * count(*) filter (where rank <= 5) / count(*), 6) as recall_k,
          round(avg(1.0::double / rank), 6) as mrr from u group by 1, 2""",
    "missed_queries": f"with {SCORES} select x.query_id from x left join h on h.query_id = x.query_id and h.id = x.expected_id where h.id is null",
    "lost_hits": f"with {FAMILIES} select query_id, round(score, 6) as score from g where score < 0.48",
    "distractor_detail": f"""with {FAMILIES} select query_id, array_to_string(list(printf('%.4f', score) order by rank), ' ') as scores, count(*) filter (where score >= 0.30) as passing,
          case when count(*) filter (where score >= 0.30) = 0 then 'silenced' else 'answers' end as verdict from a group by 1""",
    "search_responses": f"""with {SCORES} select x.query_id, '{{"problem":"label ' || x.label || '","cause":"brak"}}' as query,
          coalesce(string_agg(coalesce(d.doc_id::varchar, '') || ':' || round(h.score, 4)::decimal(10, 4) || ':' || coalesce(d.lang, ''), ' ' order by rank) filter (where h.score >= 0.30), '') as hits,
          count(h.id) filter (where h.score < 0.30) as dropped_below_threshold from x left join h using (query_id) left join documents d on d.doc_id = h.id group by x.query_id, x.label""",
    "median_length": "select median(length(text)) as median_length from documents where text is not null",
    "sample_report": f"""with p as ({STRATIFIED}) select lang, size, coalesce(picked, 0) as picked, ids from (select lang, count(*) as size from documents where length(text) > 50 group by 1)
        left join (select lang, count(*) as picked, string_agg(doc_id::varchar, ' ' order by doc_id) as ids from p group by 1) using (lang)""",
    "clipped_text": "select doc_id, case when length(text) > 60 then substr(text, 1, 59) || '…' else text end as text from documents",
    "strip_answer": "select event_id, props as answer from events",
    "too_long": "select doc_id from documents where length(text) > 6144",
    "ids_for_rule": f"with {JUDGED} select doc_id from j where not keep",
    "run_summary": f"""with {CALLS} select count(*) as calls, count(*) filter (where event_id % 7 <> 0) as parsed, count(*) filter (where event_id % 7 = 0) as failed, sum(a)::bigint as tokens_in,
          sum(b)::bigint as tokens_out, round(sum(value), 2) as latency_ms, round(sum(cost_usd), 6) as cost_usd, round(sum(cost_usd) / count(*), 9) as cost_per_ticket from c""",
    "valid_records": f"with {CHECKED} select doc_id, doc_id::varchar as ticket_id, lang as component, problem, source as symptoms, 'class ' || (n_chars % 3) as resolution from v where errors = ''",
    "answers_as_records": f"with {ANSWERED} select doc_id, errors, case when errors = '' then doc_id::varchar end as ticket_id, case when errors = '' then '2024-05-06' end as date, case when errors = '' then 1 end as resolution_vocabulary_version from w",
    "vocabulary_text": "select r_regionkey % 2 + 1 as version, string_agg('- class ' || (r_regionkey // 2) || ': ' || r_name, chr(10) order by r_regionkey) as classes from region group by 1",
    "tokens_estimate": r"select doc_id, len(regexp_extract_all(text, '\S+'))::int as tokens from documents",
    "has_content": f"""select conv_id, conv_id % 3 <> 0 and coalesce(max(case when turn = 0 then length({measured('text')}) end) > 400, false) and coalesce(bool_or(turn > 0 and length({measured('text')}) > 400), false) as has_content
        from conversations group by 1""",
    "answer_problems": f"with {CALLS} select event_id, case when a >= 5000 then 'window full' when b > 0 and a > 0 and b * 10 / a::double > 3 then 'prompt cut' end as problem from c",
    "index_upsert": """select user_id, event_id, event_type, value from events
        qualify row_number() over (partition by user_id order by (event_id % 3 = 0) desc, event_id desc) = 1""",
    "index_count": "select count(distinct user_id) as points from events",
    "index_points": f"""with {CHECKED}, i as (select e.vec_id, sha1(unhex('6f1d5a3c6b8e5e2a9a440f2c6f9c1b77') || e.vec_id::varchar::blob) as h, v.problem, v.day, (embedding::double[])[1:32] as a, (embedding::double[])[33:64] as b from embeddings e join v on v.doc_id = e.vec_id where errors = '')
        select substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' || lower(printf('%02x', (('0x' || substr(h, 17, 2))::int & 63) | 128)) || substr(h, 19, 2) || '-' || substr(h, 21, 12) as point_id,
          vec_id::varchar as ticket_id, day as date, problem, round(list_sum(a) / sqrt(list_dot_product(a, a)), 9) as problem_sum, round(list_sum(b) / sqrt(list_dot_product(b, b)), 9) as sts_sum from i""",
    "decoded_hits": f"""with {SCORES}, i as (select *, sha1(unhex('6f1d5a3c6b8e5e2a9a440f2c6f9c1b77') || id::varchar::blob) as z from h)
        select query_id, rank::int as rank, substr(z, 1, 8) || '-' || substr(z, 9, 4) || '-5' || substr(z, 14, 3) || '-' || lower(printf('%02x', (('0x' || substr(z, 17, 2))::int & 63) | 128)) || substr(z, 19, 2) || '-' || substr(z, 21, 12) as point_id,
          round(score, 4) as score, case when rank % 2 = 0 then id::varchar else '' end as ticket_id from i""",
    "search_requests": f"""with {TURNS} select conv_id::varchar as ticket_id, '2024-02-03' as date, max(case when turn = 0 then length(text) end)::int as body_chars,
          coalesce(string_agg('zwyczajny,' || case when role <> 'user' then role else 'nieznany' end || ',,' || length(text), ';' order by turn) filter (where turn > 0), '') as comments from t group by 1""",
    "failed_ids": "select event_id from events where coalesce((json_extract_string(props, '$.k'))::int < 5, true)",
    "completions": r"""select doc_id, 'brak danych' as text, len(regexp_extract_all(concat_ws(' ', 'language', lang, 'from', source), '\S+'))::bigint as prompt_tokens, 2::bigint as completion_tokens, null::varchar as error_kind from documents""",
    "document_files": "select 'supplier-' || s_suppkey || '.json' as file_name, s_suppkey::int as number, s_name from supplier",
    "stream_activity": "select date_trunc('hour', ts) as start, event_type, count(*) as n, round(sum(value), 2) as total from events group by 1, 2",
    "rule_drops": r"""with w as (select doc_id, text, regexp_extract_all(lower(text), '[\p{L}\p{N}_]+') as w from documents),
        h as (select doc_id, 'no_resolution' as rule from w where len(list_filter(w, lambda x: x in ('the', 'les', 'und', 'que'))) > 0 and len(list_filter(w, lambda x: x not in ('the', 'les', 'und', 'que'))) <= 60
          union all select doc_id, 'listing' from documents where contains(text, chr(10))),
        r as (select *, row_number() over (partition by rule order by doc_id) as n from h)
        select rule, count(*) as dropped, string_agg(doc_id::varchar, ' ' order by doc_id) filter (where n <= 10) as shown, greatest(count(*) - 10, 0) as more from r group by 1""",
    "raw_tickets": f"""with {TURNS} select conv_id::varchar as ticket_id, '2024-03-04' as date, '' as category, 'rozmowa' as subject, coalesce({raw_body("max(case when turn = 0 then text end)")}, '') as body,
          (count(*) filter (where turn > 0))::int as comments, coalesce(string_agg(role, ' ' order by turn) filter (where turn > 0), '') as roles, conv_id::int as number from t group by conv_id""",
    "artifacts": f"with {CHECKED} select 'record-' || doc_id || '.json' as file_name, doc_id::varchar as ticket_id, lang as component, 'class ' || (n_chars % 3) as resolution from v where errors = ''",
    "ids_file": f"select doc_id from ({STRATIFIED})",
    "prompts": f"""with r as ({RENDERED}), y as (select string_agg('- class ' || (r_regionkey // 2) || ': ' || r_name, chr(10) order by r_regionkey) as classes from region where r_regionkey % 2 = 0)
        select conv_id, classes || chr(10) || '--' || chr(10) || thread as prompt from r, y""",
    "hourly_activity": "select date_trunc('hour', ts) as start, event_type, count(*) as n, round(sum(value), 2) as total from events group by 1, 2",
}
