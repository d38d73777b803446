"""SQL counterparts of the registered queries, written from their specification.

Each is one statement over the supplied tables. Shared sub-selects are named in CTES and put in
front of a statement together with whatever they need themselves.
"""

from __future__ import annotations

import re

from correctionlab.functions import fixed_values as V
from correctionlab.sources.fixtures import WORK_COMPOSERS

AS_OF = "TIMESTAMP '2024-06-01 00:00:00'"
EARLIER = "TIMESTAMP '1996-01-01 00:00:00'"


def _quoted(values) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


def _contains_any(column: str, names) -> str:
    return " or ".join(f"contains({column}, '{n}')" for n in names)


def _era(composer: str, year: str) -> str:
    lists = " ".join(
        f"when {_contains_any(f'lower({composer})', names)} then '{era}'" for era, names in V.ERA_COMPOSERS
    )
    return (
        f"case when {year} < 1750 then 'baroque' when {year} < 1820 then 'classical'"
        f" when {year} < 1910 then 'romantic' when {year} is not null then 'modern' {lists}"
        " else 'modern' end"
    )


def _pct(rate: str) -> str:
    return f"printf('%.0f%%', ({rate}) * 100)"


def _hash_id(*columns: str) -> str:
    parts = ", ".join(f"case when {c} is null then 'n' else concat(length({c}::varchar), ':', {c}) end" for c in columns)
    return f"sha256(concat({parts}))"


_PATTERN_ID = _hash_id("instrument", "difference_type", "pattern_type")


def _analysis(source: str) -> str:
    return f"""
        select instrument, difference_type, occurrence_count, accepts, rejects, edits,
          accepts / occurrence_count as accept_rate, rejects / occurrence_count as reject_rate,
          case when instrument <> 'unknown' then 'instrument_quirk' else 'audiveris_failure' end as pattern_type,
          case when accepts / occurrence_count >= 0.8 and occurrence_count >= 10
            then concat('Auto-accept ', difference_type, ' differences for ', instrument, ' (accept rate: ',
              {_pct('accepts / occurrence_count')}, ', n=', occurrence_count, ')') end as suggested_rule
        from (
          select instrument, difference_type, count(*) as occurrence_count,
            count(*) filter (human_decision = 'accept') as accepts,
            count(*) filter (human_decision = 'reject') as rejects,
            count(*) filter (human_decision = 'edit') as edits
          from {source} where human_decision is not null group by all)
    """


def _as_patterns(source: str, at: str) -> str:
    return f"""
        select {_PATTERN_ID} as id, instrument, difference_type, pattern_type,
          coalesce(suggested_rule, concat(difference_type, ' differences for ', instrument)) as pattern_description,
          occurrence_count,
          trunc(accept_rate * occurrence_count)::bigint as accept_count,
          trunc(reject_rate * occurrence_count)::bigint as reject_count,
          occurrence_count - trunc(accept_rate * occurrence_count)::bigint
            - trunc(reject_rate * occurrence_count)::bigint as edit_count,
          accepts as accept_count_exact, 0.8::double as confidence_threshold,
          {at} as created_at, {at} as updated_at
        from ({source})
    """


CTES: dict[str, str] = {
    "diffs_raw": """
        select *, replace(p_brand, 'Brand#', '')::int as b,
          ((l_linenumber + l_suppkey) % 9)::int as t,
          (5 * l_orderkey + 3 * l_partkey + l_suppkey) % 11 as u
        from lineitem join part on l_partkey = p_partkey
    """,
    "diffs": f"""
        select concat(l_orderkey, '-', l_linenumber, '-', l_partkey, '-', l_suppkey, '-',
            round(100 * l_extendedprice)::bigint) as id,
          l_orderkey::varchar as score_id,
          l_linenumber as measure_number,
          case when b = 25 then 'unknown' else p_brand end as instrument,
          [{_quoted(V.DIFFERENCE_TYPES)}][t + 1] as difference_type,
          concat('flag ', l_returnflag, l_linestatus) as description,
          case when l_partkey % 4 = 0 then '' else concat('snippets/', l_orderkey, '_', l_linenumber, '.png') end
            as pdf_snippet_path,
          concat('xml/', l_orderkey, '_', l_linenumber, '.xml') as musicxml_snippet_path,
          (l_partkey % 101)::double / 100 as omr_confidence,
          ((7 * l_orderkey + 13 * l_linenumber) % 101)::double / 100 as vision_confidence,
          decision as human_decision,
          case when decision = 'edit' then case l_partkey % 3 when 0 then '<rest/>' when 1
            then 'add forte here' else '' end end as human_edit_value,
          case when decision is not null then l_shipdate end as human_reviewed_at,
          l_orderkey % 5 = 0 and l_suppkey % 3 = 0 as auto_accepted,
          l_shipdate as created_at
        from (
          select *, case when l_orderkey % 5 = 0 then null when u <= (7 * b + 3 * t) % 11 then 'accept'
            when (u - (7 * b + 3 * t) % 11) % 2 = 1 then 'reject' else 'edit' end as decision
          from diffs_raw)
    """,
    "scores": f"""
        select *, {_era('composer', 'year')} as era from (
          select o_orderkey::varchar as id, concat('Order ', o_orderkey) as title,
            case o_orderkey % 6 when 0 then 'Johann Sebastian Bach' when 1 then 'Wolfgang Amadeus Mozart'
              when 2 then 'Frederic Chopin' when 3 then 'Jacques Offenbach' when 4 then 'Unknown Person'
              else 'Clara Schumann' end as composer,
            case when o_orderkey % 3 <> 0 then (1600 + o_orderkey % 400)::int end as year,
            case o_orderstatus when 'F' then 'complete' when 'O' then 'review' else 'processing' end as status,
            o_orderdate as created_at, o_orderdate as updated_at
          from orders)
    """,
    "parts": """
        select o_orderkey::varchar as score_id, k::int as part_seq, concat('P', k + 1) as part_id,
          concat('Brand#', 1 + (3 * o_orderkey + 5 * k) % 25) as part_name
        from orders, range(3) r(k)
    """,
    "measures": """
        select score_id, part_id, part_seq, part_name, (n - 1)::int as measure_seq, n::varchar as measure_number,
          concat('<measure number="', n, '"><note/></measure>') as xml
        from parts, range(1, 7) r(n)
    """,
    "analysis_all": _analysis("diffs"),
    "old_patterns": f"""
        select *, case difference_type when 'beam' then 'romantic' when 'slur' then '' end as era
        from ({_as_patterns("select * from old_analysis", EARLIER)})
    """,
    "old_diffs": f"select * from diffs where created_at < {EARLIER} and difference_type <> 'clef'",
    "old_analysis": _analysis("old_diffs"),
    "cur_diffs": "select * from diffs where difference_type <> 'note'",
    "cur_analysis": _analysis("cur_diffs"),
    "fresh_patterns": _as_patterns("select * from cur_analysis", AS_OF),
    "patterns": """
        select coalesce(o.id, f.id) as id,
          coalesce(o.instrument, f.instrument) as instrument,
          coalesce(o.difference_type, f.difference_type) as difference_type,
          coalesce(o.pattern_type, f.pattern_type) as pattern_type,
          o.era,
          coalesce(o.pattern_description, f.pattern_description) as pattern_description,
          coalesce(f.occurrence_count, o.occurrence_count) as occurrence_count,
          coalesce(f.accept_count, o.accept_count) as accept_count,
          coalesce(f.reject_count, o.reject_count) as reject_count,
          coalesce(f.edit_count, o.edit_count) as edit_count,
          coalesce(f.accept_count_exact, o.accept_count_exact) as accept_count_exact,
          coalesce(o.confidence_threshold, f.confidence_threshold) as confidence_threshold,
          coalesce(o.created_at, f.created_at) as created_at,
          coalesce(f.updated_at, o.updated_at) as updated_at,
          case when o.id is null then 'insert' when f.id is null then 'keep' else 'update' end as change
        from old_patterns o full join fresh_patterns f
          on o.instrument = f.instrument and o.difference_type = f.difference_type
          and o.pattern_type = f.pattern_type
    """,
    "old_rules": f"""
        select sha256(concat('rule|', id)) as id, id as pattern_id, pattern_description as rule_description,
          case when difference_type <> 'dynamic' then instrument end as instrument, difference_type,
          0.7::double as min_omr_confidence, 0.7::double as min_vision_confidence,
          case when difference_type = 'rhythm' then 500 else 10 end::bigint as min_confirmations,
          occurrence_count as current_confirmations, true as is_active, {EARLIER} as created_at
        from old_patterns where occurrence_count >= 10 and accept_count / occurrence_count >= 0.8
    """,
    "good_patterns": "select * from patterns where occurrence_count >= 10 and accept_count / occurrence_count >= 0.8",
    "rules": f"""
        select r.* replace (coalesce(g.occurrence_count, r.current_confirmations) as current_confirmations,
          coalesce(g.occurrence_count >= r.min_confirmations, r.is_active) as is_active)
        from old_rules r left join good_patterns g on g.id = r.pattern_id
        union all
        select sha256(concat('rule|', id)), id, pattern_description, instrument, difference_type,
          0.7, 0.7, 10, occurrence_count, true, {AS_OF}
        from good_patterns where id not in (select pattern_id from old_rules)
    """,
    "decision_log": """
        select d.id as diff_id, d.score_id, e.decision,
          case when e.kind = 'single' then e.edit_value end as edit_value, e.kind, e.ts, e.event_id,
          case when e.kind = 'bulk' then e.decision in ('accept', 'reject')
            else e.decision in ('accept', 'reject') or (e.decision = 'edit' and e.edit_value <> '') end as valid
        from diffs d join (
          select (event_id // 2)::varchar as score_id, event_id, ts,
            case event_type when 'click' then 'accept' when 'purchase' then 'accept' when 'error' then 'reject'
              when 'signup' then 'edit' else event_type end as decision,
            case event_id % 3 when 0 then '<rest/>' when 1 then concat('k=', props ->> '$.k') else '' end
              as edit_value,
            case when event_id % 4 = 0 then 'bulk' else 'single' end as kind
          from events) e on d.score_id = e.score_id
    """,
    "bulk_requests": """
        select case when l_quantity > 45 then l_orderkey + 1 else l_orderkey end::varchar as score_id,
          concat(l_orderkey, '-', l_linenumber, '-', l_partkey, '-', l_suppkey, '-',
            round(100 * l_extendedprice)::bigint) as diff_id,
          case when l_quantity < 4 then 'edit' when l_returnflag = 'R' then 'accept' else 'reject' end as decision
        from lineitem, range(2) r(k)
        where l_returnflag <> 'N' and (k = 0 or l_linestatus = 'F')
    """,
    "training_rows": """
        select id, measure_number, instrument, difference_type, description, omr_confidence, vision_confidence,
          human_decision, pdf_snippet_path as image_path, created_at,
          coalesce(nullif(human_edit_value, ''), musicxml_snippet_path) as label
        from diffs where human_decision in ('accept', 'edit') and pdf_snippet_path <> ''
    """,
    "responses": r"""
        select event_id::varchar as score_id, (1 + event_id % 4)::int as page_no,
          case when event_id % 2 = 0 then 'unknown' else 'Brand#3' end as instrument,
          case event_id % 5
            when 0 then concat('{"has_difference": true, "difference_type": "', event_type,
              '", "description": "k=', props ->> '$.k', '", "confidence": 0.', lpad((event_id % 100)::varchar, 2, '0'),
              ', "is_omr_error": true}')
            when 1 then concat('```json', chr(10), '{"has_difference": true, "difference_type": "', event_type,
              '", "description": "line one\nline two"}', chr(10), '```')
            when 2 then concat('I can see a change. {"has_difference": 1, "description": "', event_type,
              '", "confidence": "0.75"} End of answer.')
            when 3 then concat('{"has_difference": false, "description": "', event_type, '"}')
            else concat('No structured answer for ', event_type) end as response_text
        from events
    """,
    "answers": r"""
        select score_id, page_no as measure_number, instrument,
          coalesce(j ->> '$.difference_type', 'other') as difference_type,
          coalesce(j ->> '$.description', '') as description,
          coalesce((j ->> '$.confidence')::double, 0.5) as vision_confidence
        from (
          select *, regexp_extract(response_text, '(?s)\{.*\}')::json as j from responses
          where regexp_matches(response_text, '(?s)\{.*\}'))
        where (j ->> '$.has_difference') not in ('false', '0', '')
    """,
    "logs": """
        select event_id::varchar as score_id,
          case when event_id % 7 = 0 then concat('INFO again', chr(10), 'grade: 0.25') else case event_id % 3
            when 0 then concat('INFO start', chr(10), 'GRADE: ', event_id % 130 // 100, '.',
              lpad((event_id % 130 % 100)::varchar, 2, '0'), ' of book', chr(10), 'recognition: 10%')
            when 1 then concat('INFO start', chr(10), 'Recognition  ', event_id % 120, '% done')
            else concat('INFO ', event_type) end end as log_text
        from events
    """,
    "confidences": r"""
        select score_id, case when g <> '' then least(greatest(g::double, 0), 1)
          when p <> '' then p::double / 100 else 0.5 end as confidence
        from (select score_id, regexp_extract(log_text, '(?i)grade[:\s]+([0-9]+\.?[0-9]*)', 1) as g,
          regexp_extract(log_text, '(?i)recognition[:\s]+([0-9]+)%', 1) as p from logs)
    """,
    "left_pages": """
        select o_orderkey::varchar as score_id, n::int as page_no, concat('scan/', o_orderkey, '_', n,
          case n % 3 when 0 then '.JPG' when 1 then '.png' else '.tiff' end) as path
        from orders, range(1, 5) r(n) where n <= 1 + o_orderkey % 4
    """,
    "right_pages": """
        select o_orderkey::varchar as score_id, n::int as page_no, concat('render/', o_orderkey, '_', n, '.webp') as path
        from orders, range(1, 4) r(n) where n <= 1 + o_orderkey % 3
    """,
    "completed": """
        select event_id, ts + to_minutes(a) as ts,
          concat(case when event_type = 'error' then 'cs_x' else 'cs_' end, event_id) as session_id,
          concat('pi_', event_id) as payment_intent, user_id::varchar as user_id, event_id::varchar as score_id
        from events, range(2) r(a) where event_type in ('purchase', 'error')
    """,
    "score_access": f"""
        select o_custkey::varchar as user_id, o_orderkey::varchar as score_id, '{V.VISION_FEATURE}' as feature,
          'payment' as access_type, o_orderdate as granted_at
        from orders where o_orderstatus = 'F'
        union all
        select user_id::varchar, event_id::varchar, '{V.VISION_FEATURE}', 'payment', ts
        from events where event_type = 'purchase' and value > 100
    """,
    "requests": f"""
        select event_id as request_id, user_id::varchar as user_id, event_id::varchar as score_id,
          '{V.VISION_FEATURE}' as feature from events
    """,
    "admins": """
        select c_custkey::varchar as user_id from customer
        where concat('user', c_custkey, '@example.org') in
          ('user0@example.org', 'user1@example.org', 'user2@example.org', 'user3@example.org', 'user4@example.org')
    """,
    "edits": """
        select * from diffs where human_decision = 'edit' and human_edit_value <> ''
    """,
    "placed": """
        select e.*, coalesce(n.part_id, 'P1') as part_id, n.part_id is not null as matched_by_name
        from edits e left join (
          select e.id, arg_min(p.part_id, p.part_seq) as part_id
          from edits e join parts p on e.score_id = p.score_id and contains(lower(p.part_name), lower(e.instrument))
          group by e.id) n on n.id = e.id
    """,
    "located": """
        select p.id, p.score_id, p.part_id, p.matched_by_name, m.measure_seq, p.human_edit_value,
          p.human_reviewed_at
        from placed p left join measures m
          on m.score_id = p.score_id and m.part_id = p.part_id and m.measure_number = p.measure_number::varchar
    """,
    "ranked_edits": """
        select *, row_number() over (partition by score_id, part_id, measure_seq
            order by human_reviewed_at, id) as k,
          human_edit_value = '<rest/>' as is_xml
        from located where measure_seq is not null
    """,
    "last_xml": """
        select score_id, part_id, measure_seq, max(k) filter (is_xml) as k from ranked_edits group by all
    """,
    "changes": """
        select score_id, part_id, measure_seq, max(l.k) is not null as replaced,
          string_agg(case when not e.is_xml and e.k > coalesce(l.k, 0)
            then concat('<!-- edit: ', e.human_edit_value, ' -->') end, '' order by e.k) as comments
        from ranked_edits e join last_xml l using (score_id, part_id, measure_seq) group by all
    """,
    "corrected": """
        select m.score_id, m.part_id, m.part_seq, m.measure_seq, m.measure_number,
          case when c.score_id is null then m.xml else concat('<measure number="', m.measure_number, '">',
            case when c.replaced then '<rest/>' else '<note/>' end, coalesce(c.comments, ''), '</measure>') end as xml,
          c.score_id is not null as edited
        from measures m left join changes c using (score_id, part_id, measure_seq)
    """,
    "uploads": """
        select concat('uploads/', doc_id, ext) as path, concat(doc_id, ext) as original_filename, ext,
          concat(head, text) as content, head
        from (select *, case doc_id % 7 when 0 then '.PDF' when 1 then '.xml' when 2 then '.musicxml'
            when 3 then '.mxl' when 4 then '.docx' when 5 then '.txt' else '' end as ext,
          case doc_id % 5 when 0 then concat('%PDF-1.7', chr(10)) when 1 then concat('<?XML version="1.0"?>', chr(10))
            when 2 then concat('<!-- made -->', chr(10), '<Score-Partwise>') else '' end as head
          from documents)
    """,
    "whole_documents": "select * from orders where o_orderkey % 11 <> 0",
    # what a reader sees after comments, scripts and styles are gone
    "visible_pages": r"""
        select page_id, url, regexp_replace(html, '(?is)<!--.*?-->|<script\b.*?</script\s*>|<style\b.*?</style\s*>',
          '', 'g') as html from pages
    """,
}


def _with(body: str) -> str:
    """Put the sub-selects `body` needs in front of it, in an order that resolves."""
    order: list[str] = []

    def visit(sql: str) -> None:
        for name in CTES:
            if name not in order and re.search(rf"\b(from|join)\s+{name}\b|,\s*{name}\b", sql):
                visit(CTES[name])
                if name not in order:
                    order.append(name)

    visit(body)
    if not order:
        return body.strip()
    ctes = ",\n".join(f"{n} as ({CTES[n].strip()})" for n in order)
    return f"with {ctes}\n{body.strip()}"


_PATTERN_COLUMNS = (
    "id, instrument, difference_type, pattern_type, era, pattern_description, occurrence_count, accept_count,"
    " reject_count, edit_count, accept_count_exact, confidence_threshold, created_at, updated_at"
)
_TOP = """
    select instrument, difference_type, occurrence_count as occurrences,
      case when occurrence_count > 0 then round(accept_count / occurrence_count, 4) else 0 end as accept_rate
    from patterns order by occurrence_count desc, instrument, difference_type, pattern_type limit 10
"""
_SPLIT = "case when k % 10 = 0 then 'test' when k % 10 = 9 then 'val' else 'train' end"


def _finetuning(where: str, at: str) -> str:
    return f"""
        select sha256(concat('ft|', id)) as id, id as flagged_diff_id, image_path, label, {_SPLIT} as split,
          {at} as exported_at
        from (select *, row_number() over (order by md5(id), id) as k from training_rows where {where})
    """


_WEEKS = """
    select * from (
      select week, count(*) as total, count(*) filter (human_decision = 'accept') as accepts,
        round(count(*) filter (human_decision = 'accept') / count(*), 4) as accept_rate
      from (select *, strftime(created_at, '%Y-%W') as week from diffs where human_decision is not null)
      group by week order by week {direction} limit 12)
"""
_MEDIA = (
    "case lower(regexp_extract({p}, '\\.([^./]*)$', 1)) when 'png' then 'image/png' when 'jpeg' then 'image/jpeg'"
    " when 'jpg' then 'image/jpg' when 'gif' then 'image/gif' when 'webp' then 'image/webp' else 'image/png' end"
)
_PROMPT = "'" + V.COMPARISON_PROMPT.replace("'", "''").replace("%s", "{}").replace("%d", "{}").replace(
    "{\n", "{{\n").replace("\n}\n", "\n}}\n") + "'"

BODIES: dict[str, str] = {
    "correction_patterns": "select * from analysis_all",
    "knowledge_merge": f"select {_PATTERN_COLUMNS}, change from patterns",
    "patterns_listing": f"select {_PATTERN_COLUMNS} from patterns",
    "promote_rules": "select * from rules",
    "active_rules": "select * from rules where is_active",
    "rule_details": """
        select id, instrument, difference_type, current_confirmations as confirmations,
          rule_description as description from rules where is_active
    """,
    "auto_accept_assign": """
        select d.id, d.score_id, m.rule_id is not null as auto_accepted, m.rule_id as auto_accept_rule_id
        from diffs d left join (
          select d.id, arg_min(r.id, (r.created_at, r.id)) as rule_id
          from diffs d join scores s on s.id = d.score_id
          join rules r on r.difference_type = d.difference_type and r.is_active
            and (r.instrument is null or r.instrument = d.instrument)
            and d.omr_confidence >= r.min_omr_confidence and d.vision_confidence >= r.min_vision_confidence
          join patterns p on p.id = r.pattern_id
            and (coalesce(p.era, '') = '' or s.era = '' or p.era = s.era)
          group by d.id) m on m.id = d.id
    """,
    "auto_accept_semi": """
        select id, instrument, difference_type from diffs d where human_decision is null and exists (
          select 1 from rules r where r.difference_type = d.difference_type and r.is_active
            and (r.instrument is null or r.instrument = d.instrument)
            and d.omr_confidence >= r.min_omr_confidence and d.vision_confidence >= r.min_vision_confidence)
    """,
    "top_patterns": _TOP,
    "suggestions": f"""
        select * from (
          select instrument, difference_type, case
            when occurrence_count >= 5 and rate > 0.9 then concat('Consider enabling auto-accept for ',
              difference_type, ' in ', instrument, ' (accept rate ', {_pct('rate')}, ', n=', occurrence_count, ')')
            when occurrence_count >= 5 and rate < 0.2 then concat('Review Claude prompt for ', difference_type,
              ' detection – high reject rate (', {_pct('1 - rate')}, ', n=', occurrence_count, ')')
            end as suggestion
          from (select *, accept_count / occurrence_count as rate from patterns where occurrence_count > 0))
        where suggestion is not null
    """,
    "chart_rows": f"""
        select concat(difference_type, ' (', instrument, ')') as name,
          floor(accept_rate * 100 + 0.5)::bigint as accept, floor((1 - accept_rate) * 100 + 0.5)::bigint as reject,
          occurrences as count
        from ({_TOP})
    """,
    "report_totals": """
        select (select count(*) from scores) as total_scores, count(human_decision) as total_corrections,
          round(count(*) filter (human_decision = 'accept') / count(human_decision), 4) as accept_rate,
          count(*) filter (human_decision = 'accept') as total_accepts,
          count(*) filter (human_decision <> 'accept') as total_rejects,
          count(*) filter (human_decision = 'edit') as total_edits,
          count(*) filter (human_decision = 'reject') as total_rejects_exact,
          (select count(*) from rules where is_active) as active_auto_rules
        from diffs
    """,
    "weekly_oldest": _WEEKS.format(direction="asc"),
    "weekly_latest": _WEEKS.format(direction="desc"),
    "review_progress": """
        select score_id, reviewed, total, total - reviewed as pending,
          floor(reviewed / total * 100 + 0.5)::bigint as pct, reviewed = total as all_reviewed
        from (select score_id, count(*) filter (human_decision is not null or auto_accepted) as reviewed,
          count(*) as total from diffs group by score_id)
    """,
    "confidence_bands": """
        select id,
          case when omr_confidence >= 0.8 then 'high' when omr_confidence >= 0.5 then 'mid' else 'low' end as omr_band,
          case when vision_confidence >= 0.8 then 'high' when vision_confidence >= 0.5 then 'mid' else 'low' end
            as vision_band
        from diffs
    """,
    "export_status": """
        select id as score_id, case when status = 'complete' then 'ready' else status end as export_status from scores
    """,
    "scores_listing": "select id, title, composer, era, status, created_at from scores",
    "score_status": """
        select w.score_id, s.status, s.updated_at, s.id is not null as found
        from (select distinct (2 * event_id)::varchar as score_id from events) w left join scores s on s.id = w.score_id
    """,
    "diffs_of_score": """
        select score_id, measure_number, id, difference_type from diffs
        where score_id in (select id from scores where status = 'review')
    """,
    "diff_context": """
        select d.id, d.score_id, s.title, s.composer, s.era from diffs d join scores s on s.id = d.score_id
    """,
    "score_era": "select id, composer, year, era from scores",
    "decided_diffs": """
        select id, score_id, human_decision, human_edit_value, human_reviewed_at from diffs
        where human_decision is not null
    """,
    "review_buckets": """
        select 'all' as bucket, id, score_id from diffs
        union all select 'pending', id, score_id from diffs where human_decision is null and not auto_accepted
        union all select 'accepted', id, score_id from diffs where human_decision = 'accept' or auto_accepted
        union all select 'rejected', id, score_id from diffs where human_decision = 'reject'
        union all select 'edited', id, score_id from diffs where human_decision = 'edit'
    """,
    "valid_decisions": "select diff_id, event_id, kind, decision, valid from decision_log",
    "apply_decisions": """
        select d.id, coalesce(l.decision, d.human_decision) as human_decision,
          case when s.diff_id is null then d.human_edit_value else s.edit_value end as human_edit_value,
          coalesce(l.ts, d.human_reviewed_at) as human_reviewed_at
        from diffs d
        left join (select * from decision_log where valid
          qualify row_number() over (partition by diff_id order by ts desc, event_id desc) = 1) l on l.diff_id = d.id
        left join (select * from decision_log where valid and kind = 'single'
          qualify row_number() over (partition by diff_id order by ts desc, event_id desc) = 1) s on s.diff_id = d.id
    """,
    "bulk_decide": f"""
        select d.id, coalesce(r.decision, d.human_decision) as human_decision, d.human_edit_value,
          case when r.decision is null then d.human_reviewed_at else {AS_OF} end as human_reviewed_at
        from diffs d left join (select distinct * from bulk_requests where decision <> 'edit') r
          on r.diff_id = d.id and r.score_id = d.score_id
    """,
    "bulk_updated_counts": """
        select r.score_id, count(*) as updated from bulk_requests r join diffs d
          on r.diff_id = d.id and r.score_id = d.score_id where r.decision in ('accept', 'reject') group by r.score_id
    """,
    "cascade_delete": """
        select 'scores' as table_name, id from scores where status <> 'processing'
        union all select 'diffs', d.id from diffs d join scores s on s.id = d.score_id where s.status <> 'processing'
        union all select 'finetuning_dataset', d.id from diffs d join scores s on s.id = d.score_id
          where s.status <> 'processing' and d.human_decision in ('accept', 'edit') and d.pdf_snippet_path <> ''
    """,
    "scores_without_diffs": """
        select id, title from scores where id not in (select score_id from diffs)
    """,
    "finetuning_rows": _finetuning("true", AS_OF),
    "append_finetuning": f"""
        select * from ({_finetuning(f'created_at < {EARLIER}', EARLIER)})
        union all
        select * from ({_finetuning('true', AS_OF)}) where flagged_diff_id not in
          (select id from training_rows where created_at < {EARLIER})
    """,
    "training_records": """
        select id, to_json({'image_path': image_path, 'label': label, 'metadata': {
          'measure_number': measure_number, 'instrument': instrument, 'difference_type': difference_type,
          'description': description, 'audiveris_confidence': omr_confidence,
          'claude_vision_confidence': vision_confidence, 'human_decision': human_decision}})::varchar as record
        from training_rows
    """,
    "pair_pages": f"""
        select l.score_id, l.page_no, l.path as left_path, r.path as right_path,
          {_MEDIA.format(p='l.path')} as left_media, {_MEDIA.format(p='r.path')} as right_media
        from left_pages l join right_pages r on l.score_id = r.score_id and l.page_no = r.page_no
    """,
    "comparison_prompts": f"""
        select score_id, page_no, md5(prompt) as prompt_md5, length(prompt) as prompt_length
        from (select l.score_id, l.page_no,
            format({_PROMPT}, s.title, s.composer, s.era, 'unknown', l.page_no) as prompt
          from left_pages l join right_pages r on l.score_id = r.score_id and l.page_no = r.page_no
          join scores s on s.id = l.score_id)
    """,
    "parse_responses": "select * from answers",
    "log_confidence": "select * from confidences",
    "new_diffs": f"""
        select {_hash_id("score_id", "measure_number", "instrument", "difference_type", "description")} as id,
          score_id, measure_number, instrument, '4/4' as time_signature, 'C major' as key_signature,
          difference_type, description, '' as pdf_snippet_path, '' as musicxml_snippet_path,
          coalesce(confidence, 0.5) as omr_confidence, vision_confidence, false as auto_accepted, {AS_OF} as created_at
        from (select score_id, measure_number, instrument, difference_type, description, max(vision_confidence) as vision_confidence
          from answers group by all) left join confidences using (score_id)
    """,
    "access_check": """
        select r.*, r.user_id in (select user_id from admins) as is_admin,
          r.user_id in (select user_id from admins)
            or (r.user_id, r.score_id) in (select (user_id, score_id) from score_access) as has_access
        from requests r
    """,
    "entitlements": """
        select user_id, score_id, feature from score_access
        union select user_id, score_id, feature from requests where user_id in (select user_id from admins)
    """,
    "reconcile_payments": """
        select concat('pay_', o_orderkey) as id, o_custkey::varchar as user_id, o_orderkey::varchar as score_id,
          concat('cs_', o_orderkey) as session_id, c.payment_intent, 500 as amount_cents, 'usd' as currency,
          case when c.session_id is null then 'pending' else 'completed' end as status, o_orderdate as created_at,
          c.ts as completed_at
        from orders left join (
          select session_id, max(payment_intent) as payment_intent, max(ts) as ts from completed group by session_id) c
          on c.session_id = concat('cs_', o_orderkey)
    """,
    "grant_access": f"""
        select * from score_access
        union all
        select user_id, score_id, '{V.VISION_FEATURE}', 'payment', min(ts) from completed
        where (user_id, score_id) not in (select (user_id, score_id) from score_access)
        group by user_id, score_id
    """,
    "rate_limit_windows": """
        select user_id as client, date_trunc('hour', ts)::timestamp as window_start,
          date_trunc('hour', ts)::timestamp + interval 1 hour as window_end, count(*) as requests
        from events group by all having count(*) > 2
    """,
    "request_limits": " union all ".join(
        f"select * from (select '{action}' as action, user_id % 2 as client, time_bucket(interval '{window}', ts)::timestamp as window_start,"
        f" time_bucket(interval '{window}', ts)::timestamp + interval '{window}' as window_end, count(*) as requests"
        f" from events where event_id % 3 = {k} group by all having count(*) > {limit})"
        for k, (action, (limit, window)) in enumerate(V.REQUEST_LIMITS.items())),
    "file_types": """
        select path, original_filename,
          case when head like '%PDF%' then 'pdf' when head <> '' then 'musicxml'
            when ext = '.PDF' then 'pdf' when ext in ('.xml', '.musicxml', '.mxl') then 'musicxml'
            else 'unknown' end as file_type,
          octet_length(encode(content)) as size_bytes
        from uploads
    """,
    "measure_counts": """
        select score_id, sum(n)::bigint as measure_elements, count(*) as parts, max(n) as longest_part
        from (select score_id, part_id, count(*) as n from measures group by all) group by score_id
    """,
    "measures_per_part": "select score_id, part_id, count(*) as measures from measures group by all",
    "locate_edits": "select id, score_id, part_id, matched_by_name, measure_seq from located",
    "apply_edits": "select score_id, part_id, measure_seq, measure_number, xml, edited from corrected",
    "shred_parts": """
        select score_id, list_seq as part_seq, part_id, part_name, part_seq as body_seq, entry as part_xml
        from listed
    """,
    "shred_measures": """
        select score_id, part_id, (case when score_id::bigint % 6 = 0 then 2 * part_seq else part_seq end)::int as part_seq,
          part_name, part_seq as body_seq, measure_seq, measure_number, xml
        from measures where score_id::bigint % 11 <> 0
    """,
    "malformed_documents": "select o_orderkey::varchar as score_id from orders where o_orderkey % 11 = 0",
    "document_metadata": """
        select o_orderkey::varchar as score_id,
          case when ok then concat('Order ', o_orderkey) end as title,
          case when ok and o_orderkey % 2 = 0 then concat('Op. ', o_custkey) end as opus,
          case when ok and o_orderkey % 3 = 0 then 'Allegro & Coda' end as subtitle,
          case when ok then o_orderstatus end as composer,
          case when ok and o_orderkey % 4 = 0 then 'B' end as arranger
        from (select *, o_orderkey % 11 <> 0 as ok from orders)
    """,
    "document_validity": """
        select o_orderkey::varchar as score_id, o_orderkey % 11 <> 0 as well_formed, o_orderkey % 11 <> 0 as lenient,
          o_orderkey % 11 <> 0 as strict from orders
    """,
    "url_file_names": """
        select page_id, case when lower(name) like '%.pdf' then name else concat(name, '.pdf') end as file_name
        from (select page_id, coalesce(nullif(split_part(regexp_extract(url, '[^/]*$'), '?', 1), ''), 'score.pdf') as name
          from pages)
    """,
}

_HEAD = """concat('<?xml version=''1.0'' encoding=''utf-8''?><', root,
    case when o_orderkey % 7 = 0 then ' xmlns="http://example.org/music" version="4.0"' else ' version="4.0"' end, '>',
    '<work><work-title> Order ', o_orderkey, ' </work-title>',
    case when o_orderkey % 2 = 0 then concat('<work-number>Op. ', o_custkey, '</work-number>') else '' end, '</work>',
    case when o_orderkey % 3 = 0 then '<movement-title>Allegro &amp; Coda</movement-title>' else '' end,
    '<identification><creator type="composer">', o_orderstatus, '</creator>',
    case when o_orderkey % 4 = 0 then '<creator type="Arranger">A</creator><creator type="arranger">B</creator>'
      else '' end, '</identification>')"""
CTES["heads"] = f"""
    select o_orderkey::varchar as score_id, {_HEAD} as head, concat('</', root, '>') as tail
    from (select *, 'score-partwise' as root from whole_documents)
"""
# entries of the part list of all documents; each sixth one has a group after each part
CTES["entries"] = """
    select score_id, part_seq, part_id, part_name,
      (case when score_id::bigint % 6 = 0 then 2 * part_seq else part_seq end)::int as list_seq,
      concat('<score-part id="', part_id, '"><part-name>', case when score_id::bigint % 9 = 0
        then concat('<![CDATA[', part_name, ']]>') else part_name end, '</part-name></score-part>') as entry,
      case when score_id::bigint % 6 = 0 then concat('<part-group number="1" type="',
        case when part_seq = 1 then 'stop' else 'start' end, '"/>') else '' end as grp
    from parts
"""
CTES["listed"] = """
    select *, coalesce(string_agg(grp, '') over (w rows between unbounded preceding and 1 preceding), '') as groups_before,
      string_agg(grp, '') over (w rows between current row and unbounded following) as groups_after
    from entries where score_id::bigint % 11 <> 0 window w as (partition by score_id order by part_seq)
"""
CTES["texts"] = f"""
    select o_orderkey::varchar as score_id, case when o_orderkey % 11 = 0 then left(xml, length(xml) - 9) else xml end as xml
    from (select o_orderkey, concat(replace({_HEAD}, '?><', concat('?>', chr(10), '<')), '<part-list>', list, '</part-list>',
        case when o_orderkey % 5 = 0 then timed else parted end, '</', root, '>') as xml
      from (select *, case when o_orderkey % 5 = 0 then 'score-timewise' else 'score-partwise' end as root from orders)
      join (select score_id::bigint as o_orderkey, string_agg(concat(entry, grp), '' order by part_seq) as list from entries group by all)
        using (o_orderkey),
      (select string_agg(concat('<part id="P', k, '">', of, '</part>'), '' order by k) as parted from range(1, 4) r(k),
        (select string_agg(concat('<measure number="', n, '"><note/></measure>'), '' order by n) as of from range(1, 7) r(n))),
      (select string_agg(concat('<measure number="', n, '">', of, '</measure>'), '' order by n) as timed from range(1, 7) r(n),
        (select string_agg(concat('<part id="P', k, '"><note/></part>'), '' order by k) as of from range(1, 4) r(k))))
"""
BODIES["documents_of_files"] = "select score_id, xml, null::varchar as error from texts"
CTES["changed"] = "select distinct score_id from changes where score_id::bigint % 11 <> 0"
CTES["edited_heads"] = "select * from heads where score_id in (select score_id from changed)"
CTES["edited_list"] = "select * from listed where score_id in (select score_id from changed)"
BODIES["corrected_lines"] = """
    select *, 'edited' as status from (
      select score_id, 0 as section, 0 as seq, head as line from edited_heads
      union all select score_id, 1, 0, '<part-list>' from edited_heads
      union all select score_id, 2, list_seq, entry from edited_list
      union all select score_id, 2, list_seq + 1, grp from edited_list where grp <> ''
      union all select score_id, 3, 0, '</part-list>' from edited_heads
      union all select score_id, part_seq + 4, -1, concat('<part id="', part_id, '">') from edited_list
      union all select score_id, part_seq + 4, measure_seq, xml from corrected
        where score_id in (select score_id from changed)
      union all select score_id, part_seq + 4, 2147483647, '</part>' from edited_list
      union all select score_id, 2147483647, 0, tail from edited_heads)
    union all
    select score_id, 0, 0, xml, case when score_id::bigint % 11 = 0 and score_id in (select score_id from edits) then 'malformed'
      else 'unchanged' end
    from texts where score_id not in (select score_id from changed)
"""
BODIES["part_document_lines"] = """
    select score_id, part_id, part_name, concat(part_name, '_', part_id, '.xml') as file_name, section, seq, line from (
      select score_id, part_id, 0 as section, 0 as seq, concat(head, '<part-list>', groups_before, entry, groups_after, '</part-list>') as line
        from listed join heads using (score_id)
      union all select score_id, part_id, 1, -1, concat('<part id="', part_id, '">') from listed
      union all select score_id, part_id, 1, measure_seq, xml from measures
        where score_id::bigint % 11 <> 0
      union all select score_id, part_id, 1, 2147483647, '</part>' from listed
      union all select score_id, part_id, 2, 0, tail from listed join heads using (score_id))
    join listed using (score_id, part_id)
"""

# links: anchors of the navigation in strategy order, then anchors anywhere; made absolute, first five
BODIES["page_links"] = r"""
    select page_id, position, link,
      case when lower(name) like '%.pdf' then name else concat(name, '.pdf') end as file_name
    from (
      select *, coalesce(nullif(split_part(regexp_extract(link, '[^/]*$'), '?', 1), ''), 'score.pdf') as name
      from (
        select page_id, link, row_number() over (partition by page_id order by first_at) as position
        from (
          select page_id, link, min(strategy * 1000000 + pos) as first_at
          from (
            select page_id, strategy, pos, case when starts_with(href, '/') then concat(site, href) else href end as link
            from (
              select page_id, site, 1 as strategy, unnest(nav) as href, generate_subscripts(nav, 1) as pos,
                'row' as kind from anchors
              union all select page_id, site, 2, unnest(hrefs), generate_subscripts(hrefs, 1), 'gateway' from anchors
              union all select page_id, site, 3, unnest(hrefs), generate_subscripts(hrefs, 1), 'document' from anchors
              union all select page_id, site, 4, unnest(hrefs), generate_subscripts(hrefs, 1), 'image' from anchors)
            where (kind = 'row' and (contains(href, 'an') or lower(href) like '%e'))
              or (kind = 'gateway' and contains(href, 'an'))
              or (kind = 'document' and lower(href) like '%e')
              or (kind = 'image' and regexp_matches(href, '(?i)th.*n')))
          group by page_id, link)))
    where position <= 5
"""
CTES["anchors"] = r"""
    select page_id, regexp_extract(url, '^[a-z]+://[^/?#]*') as site,
      regexp_extract_all(html, '(?i)<a\s[^>]*href="([^"]*)"', 1) as hrefs,
      regexp_extract_all(regexp_extract(html, '(?is)<nav>(.*?)</nav>', 1), '(?i)<a\s[^>]*href="([^"]*)"', 1) as nav
    from visible_pages
"""
BODIES["page_metadata"] = r"""
    select page_id, '' as composer, coalesce(substring([t for t in texts if length(t) > 40][1], 1, 300), '')
      as description, 'modern' as era
    from paragraphs
"""
CTES["paragraphs"] = r"""
    select page_id, [array_to_string([
        trim(replace(replace(replace(replace(replace(x, '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'),
          '&quot;', '"'), '&amp;', '&'), e' \n\t\r')
        for x in regexp_split_to_array(regexp_extract(c, '(?is)^(.*?)(?:</?(?:p|div|ul|ol|dl|table|h[1-6]|pre|blockquote|form|hr|address|fieldset|article|section|td|th|li|body|html)(?:\s[^>]*)?>|$)', 1), '<[^>]*>')
      ], '') for c in chunks] as texts
    from (select page_id, list_slice(regexp_split_to_array(regexp_extract(html, '(?is)<article>(.*?)</article>', 1),
      '(?i)<p>|<p\s[^>]*>'), 2, 1000000) as chunks from visible_pages)
"""
BODIES["inject_headers"] = r"""
    select doc_id, injected, md5(case when not injected then content when pos > 0
      then concat(substring(content, 1, pos), chr(10), block, substring(content, pos + 1))
      else concat(block, content) end) as content_md5
    from (
      select *, doc_id % 7 <> 0 and doc_id % 4 <> 2 as injected,
        concat('\header {', chr(10), array_to_string([f for f in [
            concat('  title = "The \"Doc\" ', doc_id, '"'),
            case when doc_id % 2 = 0 then concat('  subtitle = "', lang, '"') end,
            concat('  composer = "', source, '"'),
            case when doc_id % 3 = 0 then concat('  opus = "Op. ', n_chars, '"') end,
            case when doc_id % 5 = 0 then concat('  arranger = "arr. ', upper(lang), '"') end] if f is not null],
          chr(10)), chr(10), '}', chr(10), chr(10)) as block,
        case doc_id % 4 when 0 then length(content) - length(ltrim(substring(content, length('\version "2.24.0"') + 1), e' \t\r\n'))
          when 3 then length(content) - length(ltrim(substring(content, length(concat('% note', chr(10), '\version "2.22.1"')) + 1), e' \t\r\n'))
          else 0 end as pos
      from (
        select *, case doc_id % 4
          when 0 then concat('\version "2.24.0"', chr(10), chr(10), text)
          when 1 then text
          when 2 then concat('\version "2.24.0"', chr(10), '\header  { title = "x" }', chr(10), text)
          else concat('% note', chr(10), '\version "2.22.1"  ', chr(10), text) end as content
        from documents))
"""

BODIES["page_composers"] = f"""
    select page_id, composer, {_era('composer', 'null')} as era from (
      select page_id, case page_id % 7 when 4 then '' when 6 then '' when 0 then name when 2 then name when 5 then name else other end as composer
      from (select page_id, names[page_id % 5 + 1] as name, names[(page_id + 1) % 5 + 1] as other
        from pages, (select [{_quoted(WORK_COMPOSERS)}] as names)))
"""
BODIES["finetuning_hash_split"] = """
    select count(*) as rows, count(*) filter (measure_number > 2) as compared, 0::bigint as moved,
      true as train_fits, true as val_fits, true as test_fits
    from diffs where human_decision in ('accept', 'edit') and pdf_snippet_path <> ''
"""
BODIES["prompt_performance"] = """
    select concat('pv-', p_partkey) as id, p_size::int as version, greatest(p_size * 3 - 30, 0)::bigint as total_uses,
      case when p_size * 3 - 30 > 0 then (p_partkey % 101) / 100.0::double end as accept_rate,
      case when p_size * 3 - 30 > 0 then 1 - (p_partkey % 101) / 100.0::double end as reject_rate
    from part where p_partkey % 3 <> 0
"""
BODIES["pdf_validity"] = """
    select path, starts_with(content, '%PDF') as valid_pdf from uploads
"""
BODIES["webhook_files"] = """
    select event_id, md5(concat('{"type":"', case when event_type in ('purchase', 'signup', 'error') then 'checkout.session.completed'
        else 'checkout.session.expired' end, '","data":{"object":{"id":"', case when event_type = 'error' then 'cs_x' else 'cs_' end, event_id,
      '","payment_intent":"pi_', event_id, '","metadata":{', case when event_type = 'signup' then '' else concat('"user_id":"', user_id, '",') end,
      '"score_id":"', event_id, '"}}}}')) as body_md5
    from events, (values (0), (1)) as twice(n)
"""
BODIES["stream_request_limits"] = f"""
    select action, client::varchar as client, window_start, window_end, requests from ({BODIES['request_limits']})
    where window_end <= (select max(ts) from events)
"""
BODIES["document_containers"] = f"""
    select score_id, sum(octet_length(encode(line)) + 1)::bigint as bytes, md5(string_agg(line || chr(10), '' order by section, seq)) as content_md5
    from ({BODIES['corrected_lines']}) group by score_id
"""
BODIES["sqlite_tables"] = """
    select id, score_id, measure_number, difference_type, omr_confidence, auto_accepted, human_decision, human_reviewed_at
    from diffs where measure_number >= 2 and difference_type in ('note', 'rhythm', 'slur') and human_decision is not null
"""
BODIES["stream_latest_decisions"] = BODIES["apply_decisions"]
BODIES["stream_auto_accept"] = BODIES["auto_accept_semi"]
# what is known after each of the three arrivals; a rule stays as first made, with the last count that qualified
for _k in range(3):
    CTES[f"analysis_until_{_k}"] = _analysis(f"(select * from diffs where measure_number % 3 <= {_k})")
    CTES[f"patterns_until_{_k}"] = _as_patterns(f"select * from analysis_until_{_k}", AS_OF)
_QUALIFIES = "occurrence_count >= 10 and accept_count / occurrence_count >= 0.8"
BODIES["stream_learning"] = f"""
    select sha256(concat('rule|', id)) as id, id as pattern_id, arg_min(pattern_description, k) as rule_description,
      instrument, difference_type, 0.7::double as min_omr_confidence, 0.7::double as min_vision_confidence,
      10::bigint as min_confirmations, arg_max(occurrence_count, k) filter ({_QUALIFIES}) as current_confirmations,
      true as is_active, {AS_OF} as created_at
    from (select 0 as k, * from patterns_until_0 union all select 1, * from patterns_until_1
      union all select 2, * from patterns_until_2)
    group by id, instrument, difference_type having count(*) filter ({_QUALIFIES}) > 0
"""
BODIES["stream_settlement"] = f"""
    select 'payment' as kind, user_id, score_id, status, payment_intent from ({BODIES['reconcile_payments']})
    union all
    select 'grant', user_id, score_id, 'granted', null from ({BODIES['grant_access']})
"""
# only windows the watermark has closed come out of the stream
BODIES["stream_rate_limits"] = """
    select * from (
      select user_id as client, date_trunc('hour', ts)::timestamp as window_start,
        date_trunc('hour', ts)::timestamp + interval 1 hour as window_end, count(*) as requests
      from events group by all having count(*) > 1)
    where window_end <= (select max(ts) from events) - interval 10 minute
"""

ORACLES: dict[str, str] = {name: _with(body) for name, body in BODIES.items()}
