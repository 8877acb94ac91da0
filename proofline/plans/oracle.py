"""The same queries as DuckDB SQL over the raw test tables.

Written from the semantics and not from the Spark plans: plain window functions
and pairwise joins, which are fine at the scale of the check.
"""

from __future__ import annotations

import re

from proofline import constants as K
from proofline.functions.dates import DATE_PATTERN
from proofline.functions.status import needed_score
from proofline.functions.text import plain_letters
from proofline.plans.catalog import APP, CUTOFF, END, NOW, RAW_MAPPING, REGISTRY, START, TODAY
from proofline.plans.fixtures import VIEWS, with_views

assert RAW_MAPPING["group_id"] == "raw_id"


def _q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _list(values) -> str:
    return ", ".join(_q(v) for v in values)


IN_PERIOD = f"received_at >= timestamp '{START} 00:00:00' and received_at < timestamp '{END} 00:00:00' + interval 1 day"
DONE = "processing_status in ('COMPLETED','REQUIRES_REVIEW')"
USABLE = f"coalesce(sync_status='SUCCESS' and {DONE} and duplicate_of_id is null, false)"
COPY = "(duplicate_of_id is not null or processing_status='DUPLICATE')"
PENDING = "processing_status in ('PENDING','QUEUED','PROCESSING')"
DATED = "(coalesce(sync_date,'')<>'' and not date_is_ambiguous)"
KEYED = f"(sender_identity is not null and application_id is not null and coalesce(group_id,'')<>'' and {DATED})"
REASON = f"""case when {COPY} or {PENDING} or {USABLE} then null else coalesce(nullif(concat_ws('; ',
 case when processing_status='FAILED' then {_q(K.REASON_ANALYSIS)} end,
 case when not regexp_matches(coalesce(raw_text,''), '\\S') or coalesce(confidence < 0.55, true) then {_q(K.REASON_UNREADABLE)} end,
 case when application_id is null then {_q(K.REASON_NO_APPLICATION)} end,
 case when coalesce(group_id,'')='' then {_q(K.REASON_NO_GROUP)} end,
 case when not {DATED} then {_q(K.REASON_NO_DATE)} end,
 case when sync_status='FAILED' then {_q(K.REASON_SYNC_FAILED)}
  when coalesce(sync_status,'')<>'SUCCESS' then {_q(K.REASON_SYNC_UNCONFIRMED)} end), ''), {_q(K.REASON_DEFAULT)}) end"""
STATE = f"""case when {COPY} then 'DUPLICATE' when {USABLE} then 'SYNCHRONIZED' when {PENDING} then 'PENDING'
 when sync_status='FAILED' then 'FAILED' when sync_status='SUCCESS' then 'REVIEW' else 'UNCONFIRMED' end"""
CATEGORY = f"""case when {COPY} then 'DUPLICATE' when {PENDING} then 'PENDING'
 when {DONE} and sync_status='SUCCESS' then 'VALID' else 'NOT_VALIDATED' end"""


def _nearest(claims: str, ledger: str, ident: str = "evidence_id") -> str:
    """Ranked pairs of claims and ledger rows of the same group."""
    return f"""
select c.{ident}, l.row_id, l.sync_date as ledger_date,
 abs(date_diff('day', try_cast(l.sync_date as date), try_cast(c.sync_date as date))) as gap,
 row_number() over (partition by c.{ident} order by
  coalesce(abs(date_diff('day', try_cast(l.sync_date as date), try_cast(c.sync_date as date))), 2147483647), l.row_id) as rk
from {claims} c join {ledger} l on l.group_id=c.group_id and (l.application_id is null or l.application_id=c.application_id)"""


def _reconcile(prefix: str, app: str | None, claim_where: str, ledger: str, tolerance: int) -> dict[str, str]:
    """Views of one run: <prefix>res holds its results."""
    p = prefix
    other = "false" if app is None else f"group_id in (select group_id from ledger where application_id<>'{app}')"
    unknown = "false" if app is None else (
        f"(exists (select 1 from assignments where application_id='{app}') and group_id not in "
        f"(select group_id from assignments where application_id='{app}'))"
    )
    return {
        f"{p}claims": f"select * from submissions where {DONE} and duplicate_of_id is null and {claim_where}",
        f"{p}led": ledger,
        f"{p}gated": f"""
select *, case when coalesce(group_id,'')='' then 'ID_ILLISIBLE' when coalesce(sync_date,'')='' then 'DATE_ILLISIBLE'
 when sync_status='FAILED' then 'ECHEC_SYNCHRONISATION' when sync_status='UNCONFIRMED' then 'SYNCHRONISATION_NON_CONFIRMEE'
 when requires_review or date_is_ambiguous or application_id is null or processing_status<>'COMPLETED'
  then 'VERIFICATION_MANUELLE' end as gate from {p}claims""",
        f"{p}near": _nearest(f"(select * from {p}gated where gate is null)", f"{p}led"),
        f"{p}matched": f"""
select g.*, n.row_id, n.ledger_date, n.gap, n.row_id is null and {other} as wrong
from {p}gated g left join (select * from {p}near where rk=1) n on n.evidence_id=g.evidence_id""",
        f"{p}ranked": f"""
select *, row_number() over (partition by gate is null and not wrong, application_id, group_id, sync_date
 order by received_at, evidence_id) as rank_in_key from {p}matched""",
        f"{p}status": f"""
select *, case when gate is not null then gate when wrong then 'MAUVAISE_APPLICATION' when rank_in_key>1 then 'DOUBLON_WHATSAPP'
 when row_id is null and {unknown} then 'ID_INCONNU' when row_id is null then 'DECLARE_WHATSAPP_ABSENT_DASHBOARD'
 when sync_date=ledger_date or gap<={tolerance} then 'CONFORME' else 'ECART_DATE' end as status from {p}ranked""",
        f"{p}res": f"""
select evidence_id, application_id, status, group_id as whatsapp_group_id,
 case when status in ('CONFORME','ECART_DATE') then group_id end as dashboard_group_id, sync_date as whatsapp_date,
 case when status in ('CONFORME','ECART_DATE') then ledger_date end as dashboard_date,
 case when status in ('CONFORME','ECART_DATE') then row_id end as row_id, confidence from {p}status
union all
select null, {_q(app) if app else 'null'}, case when count(*) over (partition by group_id, sync_date)>1 then 'DOUBLON_DASHBOARD'
 else 'DASHBOARD_SANS_PREUVE_WHATSAPP' end, null, group_id, null, sync_date, row_id, null from {p}led
where group_id is not null and group_id not in (select group_id from {p}claims where coalesce(group_id,'')<>'')""",
    }


FOLDED = "replace(lower(strip_accents(coalesce(text,''))), '_', ' ')"
FOLDED_PLAIN = "lower(strip_accents(coalesce(text,'')))"


def _keyword(keywords) -> str:
    """Best whole-word keyword: multi-word or long ones first, later in the list first."""
    long = [k for k in keywords if " " in k or len(k) > 14]
    short = [k for k in keywords if not (" " in k or len(k) > 14)]
    whens = "".join(
        f" when regexp_matches({FOLDED}, '(^|\\W){k}(\\W|$)') then {_q(k)}" for k in [*long[::-1], *short[::-1]]
    )
    return f"case{whens} end"


STATUS_VIEW = f"""
select *, case when not regexp_matches(coalesce(text,''), '\\S') then 'UNCONFIRMED' when neg then 'FAILED' when bad is not null then 'FAILED'
 when doing then 'UNCONFIRMED' when good is not null then 'SUCCESS' else 'UNCONFIRMED' end as status,
 case when not regexp_matches(coalesce(text,''), '\\S') then null when neg then {_q(K.TEXT_NOT_SYNCED)} when bad is not null then bad
 when doing then {_q(K.TEXT_IN_PROGRESS)} else good end as matched
from (select *, {_keyword(K.ERROR_KEYWORDS)} as bad, {_keyword(K.SUCCESS_KEYWORDS)} as good,
 regexp_matches({FOLDED}, '\\b(non synchronis\\w*|pas synchronis\\w*|not sync\\w*|unsynced|not completed|non termine\\w*)\\b') as neg,
 regexp_matches({FOLDED}, '\\b(en cours|en attente|in progress|pending)\\b') as doing from {{source}}) s"""

PANEL = """(
 (f like '%enregistrement de l''ecran%' or f like '%screen recording%' or f like '%enregistrement d''ecran%'
  or (f like '%notifications silencieuses%' and f like '%tout effacer%'))
 and (f like '%bluetooth%' or f like '%mode avion%' or f like '%airplane mode%')
 and (f like '%notifications%' or f like '%effacer%' or f like '%gerer%' or f like '%clear all%' or f like '%economiseur%'))"""

_DASHES = K.DASH_CHARS
IDS_VIEW = f"""
select *, case when num<>'' and slug<>'' and raw_id<>'' then concat('gr', num, '.', slug) end as norm from (
 select *, regexp_replace(translate(digits, 'oilsbz', '011582'), '[^0-9]', '', 'g') as num,
  regexp_replace(regexp_replace(regexp_replace(rest, '[^a-z0-9\\-]', '', 'g'), '-+', '-', 'g'), '^-+|-+$', '', 'g') as slug from (
  select *, regexp_extract(low, '^gr([a-z0-9]+)[.\\-\\s]?(.*)$', 1) as digits,
   regexp_extract(low, '^gr([a-z0-9]+)[.\\-\\s]?(.*)$', 2) as rest from (
   select *, lower(regexp_replace(regexp_replace(translate(trim(raw_id), '{_DASHES}', '{"-" * len(_DASHES)}'),
    '-+', '-', 'g'), '\\s*([.\\-])\\s*', '\\1', 'g')) as low from raw_rows) a) b) c"""

_MONTH = "case lower(word) " + " ".join(f"when {_q(w)} then {n}" for w, n in K.MONTH_NUMBER.items()) + " end"
_TIDY = "regexp_replace(replace(regexp_replace({}, '^[\\s,]+|[\\s,]+$', '', 'g'), ',', ' '), '\\s+', ' ', 'g')"
DATES_VIEW = f"""
select *, regexp_matches(raw, '(19|20)[0-9]{{2}}') as has_year, case
 when regexp_matches(raw, '^\\d{{4}}-') then try_cast(raw as date)
 when regexp_matches(raw, '^\\d{{1,2}}[/\\-]') then try_cast(concat_ws('-', regexp_extract(raw, '(\\d+)$', 1),
  lpad(regexp_extract(raw, '[/\\-](\\d+)[/\\-]', 1), 2, '0'), lpad(regexp_extract(raw, '^(\\d+)', 1), 2, '0')) as date)
 else try_cast(concat_ws('-', nullif(case when regexp_matches(raw, '\\d{{4}}$') then right(raw, 4) else ctx_year end, ''),
  lpad(cast({_MONTH} as varchar), 2, '0'), lpad(regexp_extract(raw, '^(\\d+)', 1), 2, '0')) as date) end as d
from (select *, regexp_extract(raw, '^\\d+\\s*([^\\d\\s.]+)', 1) as word from (
 select *, {_TIDY.format(f"nullif(regexp_extract(raw_date, {_q(DATE_PATTERN)}, 1), '')")} as raw, {{context}} as ctx_year
 from raw_rows) a) b"""

_ID_HITS = (
    "list_filter(list_transform(regexp_extract_all({t}, "
    + _q("(?i)" + K.ID_CANDIDATE) + "), lambda h: trim(regexp_extract(trim(h, e' \\n\\r\\t'), '^([^\\n\\r]*)', 1), e'\\n\\r')), lambda p: p<>'')"
)
_CUT = "regexp_replace({}, '(^|\\s)" + K.STANDALONE_DATE + "(\\s|$)', e'\\\\1\\n\\\\2', 'g')"

#: 200 * LCS / letters of two lists of letters a and b, row by row of the usual table.
_INDEL = """200.0*list_reduce(list_prepend(list_transform(b, lambda y: 0), list_transform(a, lambda x: list_transform(b, lambda y: case when x=y then 1 else 0 end))),
    lambda held, hit: list_transform(range(1, len(hit)+1), lambda j: list_max(list_transform(range(1, j+1), lambda t: greatest(held[t], case when t>1 then held[t-1] else 0 end + hit[t])))))[-1]
    / (len(a)+len(b))"""

def _stretches(pairs: str, keep: str = "true") -> str:
    """(columns of pairs, a, b): the shorter text of each pair with every stretch of the longer one that may hang over its ends."""
    return f"""select * exclude (i, s, t, w), string_split(s, '') as a, string_split(w, '') as b from (
 select *, substr(t, greatest(i, 0)+1, length(s)+least(i, 0)) as w from (
  select *, unnest(range(1-length(s), length(t))) as i from ({pairs}) p0) p1) p2 where {keep}"""


def _weighted(pairs: str, bar: float) -> str:
    """Weighted scores of (id, known) pairs without white space, of at least `bar`; Levenshtein only spares most of the work."""
    far = f"""select id, known, case when length(id)<=length(known) then id else known end as s, case when length(id)<=length(known) then known else id end as t
 from ({pairs}) f where greatest(length(id), length(known)) between 1.5*least(length(id), length(known)) and 8*least(length(id), length(known))"""
    return f"""select id, known, max(score) as score from (
 select id, known, {_INDEL} as score from (select id, known, string_split(id, '') as a, string_split(known, '') as b from ({pairs}) c0
  where levenshtein(id, known)<=(1-{bar}/100.0)*(length(id)+length(known))+1e-9) c1
 union all select id, known, 0.9*{_INDEL} from ({_stretches(far, f"levenshtein(s, w)<=(1-{bar}/90.0)*(length(s)+length(w))+1e-9")}) c2) c3
 where score>={bar}-1e-9 group by 1,2"""


ORACLE_VIEWS: dict[str, str] = {
    **VIEWS,
    **_reconcile("r_", APP, f"application_id='{APP}'", f"select * from ledger where application_id='{APP}'", 0),
    **_reconcile(
        "p_", None,
        f"((sync_date between '{START}' and '{END}') or (sync_date is null and {IN_PERIOD}))",
        "select row_id, cast(null as varchar) as application_id, group_id, sync_date, is_valid from ledger "
        f"where sync_date between '{START}' and '{END}'", 2,
    ),
    "first_message": """
select evidence_id, sender_external_id, channel_id from (select *, row_number() over (partition by evidence_id
 order by message_date, message_id) as rk from messages) m where rk=1""",
    "phone_agent": """
select phone, min(agent_id) as agent_id from agents where regexp_matches(phone, '^\\d{8,15}$') group by phone having count(*)=1""",
    "linked_agent": """
select m.sender_external_id as address, min(i.agent_id) as agent_id from messages m join intake i on i.evidence_id=m.evidence_id
where m.sender_external_id is not null and i.agent_id is not null group by 1 having count(distinct i.agent_id)=1""",
    "addressed": """
select i.*, m.sender_external_id as first_sender, coalesce(case when regexp_matches(m.sender_external_id, '^\\d+@(c\\.us|lid)$')
 then m.sender_external_id end, concat(i.sender_phone, '@c.us')) as address
from intake i left join first_message m on m.evidence_id=i.evidence_id""",
    "ident": """
select a.evidence_id, coalesce(cast(a.agent_id as varchar), cast(p.agent_id as varchar), cast(l.agent_id as varchar), a.address)
 as sender_identity, a.agent_id, a.sender_phone
from addressed a left join phone_agent p on concat(p.phone, '@c.us')=a.address left join linked_agent l on l.address=a.address""",
    "judged": f"""
select *, case when {DATED} then sync_date else cast(cast(received_at as date) as varchar) end as day,
 case when {DATED} then 'report_date' else 'received_at_unverified' end as basis, {STATE} as state, {REASON} as reason from intake""",
    "vw": f"""
select i.evidence_id, g.agent_id, coalesce(g.full_name, i.sender_name, {_q(K.UNKNOWN_AGENT)}) as agent,
 case when g.agent_id is not null then 'registry' else 'sender_unverified' end as identity_source, g.locality, i.application_id,
 coalesce(ap.name, {_q(K.UNKNOWN_APPLICATION)}) as application, i.group_id as "group", i.day as date, i.basis as date_basis, i.state as status,
 i.sync_status, i.processing_status, d.sender_identity, i.requires_review, i.reason as review_reason, i.sync_date as detected_date,
 i.date_is_ambiguous, i.confidence, i.received_at, i.duplicate_of_id
from judged i join ident d on d.evidence_id=i.evidence_id left join phone_agent o on o.phone=i.sender_phone
left join agents g on cast(g.agent_id as varchar)=coalesce(cast(i.agent_id as varchar), cast(o.agent_id as varchar), d.sender_identity)
left join applications ap on ap.application_id=i.application_id""",
    "people": f"""
select * from (select *, row_number() over (partition by sender_identity, application_id, "group" order by received_at, evidence_id) as rk
 from vw where sender_identity is not null and application_id is not null and coalesce("group",'')<>'' and status<>'DUPLICATE'
 and cast(received_at as date)<=date '{END}') p where rk=1""",
    "attributable": f"""
select *, case status when 'SYNCHRONIZED' then 0 when 'REVIEW' then 1 when 'PENDING' then 2 when 'FAILED' then 3 else 4 end as pr
from vw where status<>'DUPLICATE' and date_basis='report_date' and date between '{START}' and '{END}'""",
    "calendar": f"""
select cast(cast(d as date) as varchar) as day from range(timestamp '{START}', timestamp '{END}' + interval 1 day, interval 1 day) t(d)""",
    "daily_best": """
select * from (select *, count(*) over k as submission_count, row_number() over (k order by pr, received_at, evidence_id) as rk
 from attributable window k as (partition by sender_identity, application_id, "group", date)) b where rk=1""",
    "period_best": """
select * from (select *, count(*) over k as submission_count, row_number() over (k order by pr, received_at, evidence_id) as rk
 from attributable window k as (partition by sender_identity, application_id, "group")) b where rk=1""",
    "cover": """
select p.sender_identity, p.agent, p.locality, p.application_id, p.application, p."group", c.day as date, c.day as period_end,
 coalesce(b.status, 'MISSING') as status, b.evidence_id, coalesce(b.submission_count, 0) as submission_count,
 exists (select 1 from ledger l where l.application_id=p.application_id and l.group_id=p."group" and l.sync_date=b.date) as dashboard_present
from people p cross join calendar c left join daily_best b on b.sender_identity=p.sender_identity
 and b.application_id=p.application_id and b."group"=p."group" and b.date=c.day""",
    "received_0": f"""
select * from submissions where {IN_PERIOD} and evidence_id in (select m.evidence_id from messages m join links k on k.channel_id=m.channel_id
 where k.project_id=0)""",
    "counted_0": f"""
select application_id, lower(trim(group_id)) as business_id, date_diff('day', date '{START}', cast(received_at as date)) as day_no,
 count(*) as received, count(*) filter ({USABLE}) as valid from received_0
where not {COPY} and coalesce(group_id,'')<>'' and application_id is not null group by 1,2,3""",
    "keyed_cases": f"""
select c.*, p.received_at, coalesce(case when {KEYED} then concat_ws('|', sender_identity, application_id, group_id, sync_date) end,
 concat('case ', c.case_evidence_id)) as group_key, case when {KEYED} then concat_ws('|', sender_identity, application_id, group_id, sync_date) end as report
from open_cases c join proofs p on p.evidence_id=c.case_evidence_id""",
    "case_lead": """
select group_key, report, case_evidence_id, reason, received_at from (select *, row_number() over (partition by group_key
 order by received_at, case_evidence_id) as rk from keyed_cases) c where rk=1""",
    "case_done": """
select group_key, replacement_evidence_id from (select *, row_number() over (partition by group_key order by received_at, case_evidence_id) as rk
 from keyed_cases where status='RESOLVED') c where rk=1""",
    "case_size": "select group_key, count(*) as case_count from keyed_cases group by 1",
    "case_attempts": """
select k.group_key, count(*) as attempt_count, min(a.created_at) as first_at, arg_max(a.status, struct_pack(t := a.created_at, i := a.attempt_id)) as last_send_status,
 bool_or(a.status in ('SENDING','UNKNOWN')) as uncertain_send, count(*) filter (a.status in ('SENT','MANUALLY_CONFIRMED')) as sent_count,
 max(a.created_at) filter (a.status in ('SENT','MANUALLY_CONFIRMED')) as last_sent_at
from keyed_cases k join attempts a on a.case_evidence_id=k.case_evidence_id group by 1""",
    "reports": f"""
select evidence_id, received_at, concat_ws('|', sender_identity, application_id, group_id, sync_date) as report from proofs
where {KEYED} and duplicate_of_id is null""",
    "returns": """
select l.group_key, count(*) as returned_count from case_lead l join case_attempts h on h.group_key=l.group_key
join reports r on r.report=l.report and r.evidence_id<>l.case_evidence_id and r.received_at>l.received_at and r.received_at>h.first_at group by 1""",
    "followups": """
select l.group_key, l.case_evidence_id, s.case_count, l.reason,
 case when d.group_key is not null then 'RESOLVED' when r.returned_count>0 then 'RETURNED_INVALID' when h.attempt_count>0 then 'WAITING' else 'OPEN' end as status,
 coalesce(r.returned_count,0) as returned_count, coalesce(h.attempt_count,0) as attempt_count, h.last_send_status,
 coalesce(h.uncertain_send,false) as uncertain_send, d.replacement_evidence_id, coalesce(h.sent_count,0) as sent_count, h.last_sent_at
from case_lead l join case_size s on s.group_key=l.group_key left join case_done d on d.group_key=l.group_key
left join case_attempts h on h.group_key=l.group_key left join returns r on r.group_key=l.group_key""",
    "flagged": f"select *, {USABLE} as usable, {PENDING} as transitional, {REASON} as new_reason, {KEYED} as keyed from proofs",
    "next_usable": """
select a.evidence_id, arg_min(b.evidence_id, struct_pack(t := b.received_at, i := b.evidence_id)) as replacement_id
from flagged a join flagged b on b.keyed and b.usable and a.keyed and b.sender_identity=a.sender_identity and b.application_id=a.application_id
 and b.group_id=a.group_id and b.sync_date=a.sync_date and b.received_at>=a.received_at group by 1""",
    "rebuilt": f"""
select evidence_id as case_evidence_id, case when settled or answer is not null then 'RESOLVED' when reopened or old is null then 'OPEN' else old end as status,
 case when settled then old_rep else answer end as replacement_evidence_id, case when settled then null else new_reason end as reason
from (select f.*, c.status as old, c.replacement_evidence_id as old_rep,
  coalesce(c.status='RESOLVED' and not r.usable and not r.transitional, false) as reopened,
  coalesce(c.status='RESOLVED' and not coalesce(not r.usable and not r.transitional, false), false) as settled,
  case when f.usable then f.evidence_id else s.replacement_id end as answer
 from flagged f left join prior_cases c on c.case_evidence_id=f.evidence_id left join flagged r on r.evidence_id=c.replacement_evidence_id
 left join next_usable s on s.evidence_id=f.evidence_id where c.case_evidence_id is not null or f.new_reason is not null) z""",
    "recipients": """
select p.evidence_id, a.name as application, p.group_id, p.sync_date, p.sender_name, p.received_at,
 case when regexp_matches(p.sender_external_id, '^\\d+@(c\\.us|lid)$') then p.sender_external_id else coalesce(nullif(p.sender_phone, ''), g.phone) || '@c.us' end as recipient
from contacts p left join agents g on g.agent_id=p.agent_id left join applications a on a.application_id=p.application_id""",
    "norm_ids": IDS_VIEW,
    "import_rows": f"""
select i.row_number, nullif(i.raw_id,'') as raw_group_id, i.norm as normalized_group_id, nullif(i.raw_date,'') as sync_date_raw,
 case when has_year then cast(d.d as varchar) end as sync_date, i.agent, i.locality, concat_ws('|',
 case when i.raw_id='' then {_q(K.ERROR_ID_MISSING)} when i.norm is null then concat('Format d''ID de groupe invalide: ''', i.raw_id, '''') end,
 case when i.raw_date='' then {_q(K.ERROR_DATE_MISSING)} when not coalesce(has_year, false) or d.d is null
  then concat('Date illisible ou incomplete: ''', i.raw_date, '''') end) as validation_errors,
 coalesce(i.row_number > min(i.row_number) over (partition by i.norm) and i.norm is not null, false) as is_duplicate
from norm_ids i join ({DATES_VIEW.replace("{context}", "null")}) d on d.row_number=i.row_number""",
    "frame_read": f"""
select *, lower(strip_accents(text)) as f, case when position='end' then duration_seconds-offset_seconds else offset_seconds end as at_time
from ({STATUS_VIEW.format(source="frames")}) r""",
    "known_ids": "select distinct group_id as known from ledger",
    "read_ids": "select distinct norm as id from norm_ids where norm is not null",
    "scan_texts": """
select proof_id, coalesce(string_agg(coalesce(text,''), chr(10) order by at_time, frame_id) filter (position='start'), '') as start_text,
 coalesce(string_agg(coalesce(text,''), chr(10) order by at_time, frame_id) filter (position='end'), '') as text, avg(confidence) as ocr,
 regexp_matches(coalesce(string_agg(text, ' ') filter (position='end'), ''), '\\S') as has_end
from (select *, case when position='end' then duration_seconds-offset_seconds else offset_seconds end as at_time from scans) f group by 1""",
    "scan_parts": """
select proof_id, 0 as second, start_text as part from scan_texts union all select proof_id, 1, concat(start_text, chr(10), text) from scan_texts where has_end""",
    "scan_pieces": f"""
select proof_id, second, nth, raw_id from (select proof_id, second, unnest(hits) as raw_id, generate_subscripts(hits, 1) as nth
 from (select proof_id, second, {_ID_HITS.replace("{t}", _CUT.replace("{}", _CUT.replace("{}", "part")))} as hits from scan_parts) h) g""",
    "scan_norm": IDS_VIEW.replace("raw_rows", "scan_pieces"),
    "scan_near": f"""
select asked, known as best, score, score-coalesce(second_score, 0)>=5 as accepted from (
 select *, row_number() over (partition by asked order by score desc, known) as rk, lead(score) over (partition by asked order by score desc, known) as second_score
 from (select id as asked, known, score from ({_weighted("select asked as id, known from (select distinct coalesce(norm, lower(trim(raw_id))) as asked from scan_norm) a, known_ids", 83)}) w) p) q
where rk=1 and score>=88""",
    "scan_ids": """
select * from (select n.*, k.best, k.score, k.accepted, row_number() over (partition by proof_id order by second, nth) as rk
 from scan_norm n left join scan_near k on k.asked=coalesce(n.norm, lower(trim(n.raw_id))) where n.norm is not null or coalesce(k.accepted, false)) z where rk=1""",
    "scan_dates": "select proof_id, second, raw, has_year, case when true then cast(d as varchar) end as day from (" +
        DATES_VIEW.replace("{context}", "null").replace("from raw_rows", "from (select proof_id, second, part as raw_date from scan_parts) raw_part") + ") dated",
    "scan_status": STATUS_VIEW.format(source="scan_texts"),
    "media_plain": "select file_name, case when file_name like '%.mp4' then 'video' else 'image' end as kind from media_files",
}


def _digest(day: str) -> str:
    opening = K.DIGEST_OPENING.format(day)
    closing = "\n".join((K.DIGEST_CLOSING, K.RECORDING_INSTRUCTIONS, K.PRIVATE_CHAT_NOTICE))
    return f"""
select recipient, entries, length(full_body) as body_length, outcome, case when outcome='prepared' then full_body end as body from (
 select *, case when stopped then 'skipped_sent_or_uncertain' when length(full_body)>4000 then 'skipped_too_long' else 'prepared' end as outcome from (
  select recipient, count(*) as entries, concat({_q(opening)}, chr(10), string_agg(concat(rk, '. ', line), chr(10) order by rk), chr(10), {_q(closing)}) as full_body,
   recipient in (select recipient from campaigns where day='{day}' union select recipient from attempts where status in ('SENDING','UNKNOWN')
    or (status in ('SENT','MANUALLY_CONFIRMED') and cast(created_at as date)=date '{day}')) as stopped from (
   select r.recipient, row_number() over (partition by r.recipient order by c.case_evidence_id) as rk,
    concat(coalesce(r.application, {_q(K.UNKNOWN_APPLICATION)}), ' / ', coalesce(nullif(r.group_id,''), {_q(K.UNREADABLE_GROUP)}), ' : ', c.reason, '. Réf. ', c.case_evidence_id) as line
   from open_cases c join recipients r on r.evidence_id=c.case_evidence_id and r.recipient is not null
   where c.status<>'RESOLVED' and cast(r.received_at as date)=date '{day}') a group by recipient) b) c"""


_OVERVIEW = f"""
select s.*, r.*, case when rec>0 then round(conform*100.0/rec, 1) else 0.0 end as conformity_rate,
 case when total_evidence>0 then round(processed*100.0/total_evidence, 1) else 0.0 end as automatic_rate from (
 select count(*) as total_evidence, count(*) filter (media_type='image') as total_images, count(*) filter (media_type='video') as total_videos,
  count(*) filter (processing_status='COMPLETED') as processed, count(*) filter ({PENDING}) as pending,
  count(*) filter (processing_status='REQUIRES_REVIEW') as requires_review, count(*) filter (processing_status='FAILED') as failed,
  count(*) filter ({DONE} and confidence>=0.55 and length(trim(raw_text))>0) as readable,
  count(*) filter (not {COPY} and not {PENDING} and sync_status='SUCCESS') as cat_sync_visible,
  count(*) filter (not {COPY} and not {PENDING} and sync_status='SUCCESS' and not {DONE}) as cat_sync_review,
  count(*) filter ({CATEGORY}='VALID') as cat_valid, count(*) filter ({CATEGORY}='PENDING') as cat_pending,
  count(*) filter ({CATEGORY}='DUPLICATE') as cat_duplicate, count(*) filter ({CATEGORY}='NOT_VALIDATED') as cat_not_validated
 from submissions where {{where}}) s, (
 select count(*) as rec, count(*) filter (status='CONFORME') as conform, count(*) filter (status='ECART_DATE') as date_gaps,
  count(*) filter (status='ECHEC_SYNCHRONISATION') as sync_failures, count(*) filter (status in ('ID_ILLISIBLE','DATE_ILLISIBLE')) as unreadable
 from r_res where {{tied}}) r"""
_TIED = f"evidence_id in (select evidence_id from submissions where {IN_PERIOD})"
_RANK = "case status " + " ".join(f"when '{s}' then {i}" for i, s in enumerate(K.ANOMALY_ORDER)) + " end"
_SHEET = "case status " + " ".join(f"when '{s}' then {_q(n)}" for s, n in K.SHEET_OF_STATUS.items()) + " end"
_ROUTE = f"""case when message_date < timestamp '{CUTOFF}' then 'SKIPPED_NO_MEDIA' when download_status<>'DOWNLOADED' then download_status
 when not coalesce(is_monitored,false) then 'SKIPPED_UNAUTHORIZED_GROUP' when storage_path is null then 'FAILED' else 'ACCEPTED' end"""
_CHANGES = """
select {ident}, {key}, {state}, prev as previous_state from (select *, lag({state}) over (partition by {key} order by {at}, {ident}) as prev
 from {source} where {state} is not null) s where prev is null or prev<>{state}"""


def _detect() -> str:
    def score(app) -> str:
        words = [w.lower() for w in (app[2], app[1], *app[3])]
        hit = " or ".join(f"{FOLDED} like {_q('%' + w + '%')}" for w in words)
        return f"select evidence_id, text, {_q(app[0])} as app, case when {hit} then 100.0 else 0.0 end as score from texts"
    return f"""
select evidence_id, case when regexp_matches(max(text), '\\S') and max(score)>=70 and max(score)-coalesce(min(score) filter (rk=2),0)>=8
 then max(app) filter (rk=1) end as application_id, case when regexp_matches(max(text), '\\S') then max(score) else 0.0 end as detection_score
from (select *, row_number() over (partition by evidence_id order by score desc, app desc) as rk from ({" union all ".join(map(score, REGISTRY))}) u) v group by evidence_id"""


def _near_status(source: str, ident: str) -> str:
    """Status of each text with near spellings: every run of as many words as a keyword has, by indel ratio."""
    words = [("bad", k) for k in K.ERROR_KEYWORDS] + [("good", k) for k in K.SUCCESS_KEYWORDS]
    table = ", ".join(f"({_q(kind)}, {n}, {_q(k)}, {len(k.split())}, {needed_score(k)})" for n, (kind, k) in enumerate(words))
    lengths = sorted({len(k.split()) for _, k in words})
    runs = " union all ".join(
        f"select distinct {ident}, {n} as n, array_to_string(ws[i:i+{n - 1}], ' ') as w from (select *, unnest(range(1, greatest(len(ws)-{n - 1}, 1)+1)) as i from folded) r where len(ws)>0"
        for n in lengths
    )
    return f"""select * from (with folded as (select {ident}, f, list_filter(string_split_regex(f, '\\s+'), lambda x: x<>'') as ws from (select {ident}, {FOLDED} as f from {source}) f0),
keywords(kind, nr, word, n, needed) as (values {table}),
near as (select {ident}, kind, nr, word, needed, {_INDEL} as score from (
  select r.{ident}, k.kind, k.nr, k.word, k.needed, string_split(k.word, '') as a, string_split(r.w, '') as b from ({runs}) r join keywords k on k.n=r.n
  where k.needed<100 and levenshtein(k.word, r.w)<=0.15*(length(k.word)+length(r.w))+1e-9) n0),
whole as (select {ident}, kind, nr, word, needed, 100.0 as score from folded join keywords on regexp_matches(f, concat('(^|\\W)', word, '(\\W|$)'))),
best as (select {ident}, kind, word from (select *, row_number() over (partition by {ident}, kind order by score-needed desc, nr desc) as rk
  from (select * from near union all select * from whole) s0 where score>=needed) s1 where rk=1)
select {ident}, case when neg or bad is not null then 'FAILED' when doing then 'UNCONFIRMED' when good is not null then 'SUCCESS' else 'UNCONFIRMED' end as status,
 case when neg then {_q(K.TEXT_NOT_SYNCED)} when bad is not null then bad when doing then {_q(K.TEXT_IN_PROGRESS)} else good end as matched
from (select f.{ident}, regexp_matches(f.f, {_q(K.NOT_DONE)}) as neg, regexp_matches(f.f, {_q(K.UNDER_WAY)}) as doing, b.word as bad, g.word as good from folded f
 left join best b on b.{ident}=f.{ident} and b.kind='bad' left join best g on g.{ident}=f.{ident} and g.kind='good') j) z"""


def _detect_near() -> str:
    words = [(app[0], plain_letters(w).lower()) for app in REGISTRY for w in (app[2], app[1], *app[3])]
    table = ", ".join(f"({_q(a)}, {_q(w)})" for a, w in words)
    short = """select f, app, word, case when length(word)<=length(f) then word else f end as s, case when length(word)<=length(f) then f else word end as t
 from asked where length(f)>0 and not contains(f, word)"""
    turned = "select f, app, word, f as s, word as t from asked where length(f)=length(word) and f<>word"
    return f"""select * from (with asked as (select distinct f, app, word from (select {FOLDED_PLAIN} as f from texts) f0 cross join (values {table}) k(app, word)),
scores as (select f, app, max(score) as score from (select f, app, 100.0 as score from asked where contains(f, word)
 union all select f, app, {_INDEL} from ({_stretches(short)}) s0 union all select f, app, {_INDEL} from ({_stretches(turned)}) s1) s group by 1,2),
ranked as (select *, row_number() over (partition by f order by score desc, app desc) as rk from scores),
told as (select f, max(score) as top, coalesce(min(score) filter (rk=2), 0) as next, max(app) filter (rk=1) as app from ranked group by 1)
select evidence_id, case when top>=70 and top-next>=8 then app end as application_id, round(coalesce(top, 0.0), 3) as detection_score
from (select evidence_id, {FOLDED_PLAIN} as f from texts) t left join told using (f)) z"""


SQL: dict[str, str] = {
    # sources and sinks
    "read_tabular": "select row_number as line, raw_id, raw_date, agent, locality from raw_rows",
    "read_chat_log": """
select case when event_id%4=1 then date_trunc('second', ts) else date_trunc('minute', ts) end as sent_at, concat('Agent ', user_id) as sender,
 case event_id%4 when 0 then concat('photo IMG_', event_id, '.jpg') when 1 then 'image omitted' else 'bonjour' end as text,
 case event_id%4 when 0 then concat('IMG_', event_id, '.jpg') when 1 then '__unnamed_attachment__' end as media_filename
from events where event_id%4<3""",
    "read_messages": "select event_type, count(*) as n, max(ts) as last_at from events group by 1",
    "import_expected": f"""
select business_id, case when business_id in (select business_id from expected_ids where project_id=0 and application_id='{APP}')
 then 'already_present' else 'added' end as outcome from (select distinct lower(trim(value)) as business_id from typed_ids) t
where business_id not in ('', {_list(K.EXPECTED_HEADER_WORDS)})""",
    "import_agents": """
select row_number, nullif(trim(nom_agent), '') as full_name, case when trim(nom_agent)<>'' then trim(telephone) end as phone,
 case when trim(nom_agent)<>'' then trim(zone) end as locality,
 case when coalesce(trim(nom_agent),'')='' then concat('Ligne ', row_number, ': nom manquant') end as error from agent_rows""",
    "report_sheets": f"""
select {_SHEET} as sheet, status, whatsapp_group_id, dashboard_group_id, whatsapp_date, dashboard_date, coalesce(confidence,0.0) as confidence,
 cast(null as varchar) as locality, evidence_id, row_id, cast(null as bigint) as n, cast(null as double) as percent, cast(null as varchar) as corrected_group_id,
 cast(null as varchar) as corrected_date from r_res
union all select {_q(K.SHEET_SUMMARY)}, status, null, null, null, null, null, null, null, null, count(*),
 round(count(*)*100.0/(select count(*) from r_res), 1), null, null from r_res group by status
union all select {_q(K.SHEET_RAW_CLAIMS)}, sync_status, normalized_group_id, null, normalized_date, null, confidence, null, evidence_id, null, null, null, null, null from intake
union all select {_q(K.SHEET_RAW_LEDGER)}, 'Oui', null, group_id, null, sync_date, null, null, null, row_id, null, null, null, null from ledger
union all select {_q(K.SHEET_CORRECTIONS)}, null, normalized_group_id, null, normalized_date, null, null, null, evidence_id, null, null, null, corrected_group_id, corrected_date
 from intake where coalesce(corrected_group_id,'')<>'' or coalesce(corrected_date,'')<>''""",
    "safe_csv_sink": """
select c_custkey, case c_custkey%4 when 0 then concat('''=', c_name) when 1 then concat('''  @', c_name) when 2 then concat('''-', c_name) else '' end as agent,
 concat(c_mktsegment, '; "x"') as locality from customer""",
    "export_ids": f"""
select distinct coalesce(nullif(corrected_group_id,''), normalized_group_id) as group_id from intake
where normalized_group_id is not null and {IN_PERIOD}""",
    "export_ids_detailed": f"""
select coalesce(nullif(corrected_group_id,''), normalized_group_id) as detected_id, i.application_id as application, c.name as channel,
 coalesce(a.full_name, i.sender_name) as contact, i.sender_phone as phone, coalesce(nullif(corrected_date,''), normalized_date) as detected_date,
 i.sync_status as status, strftime(i.received_at, '%Y-%m-%d %H:%M') as received
from intake i left join (select m.evidence_id, arg_min(h.name, struct_pack(d := m.message_date, i := m.message_id)) as name from messages m join channels h on h.channel_id=m.channel_id group by 1) c
 on c.evidence_id=i.evidence_id left join agents a on a.agent_id=i.agent_id
where normalized_group_id is not null and i.application_id='{APP}' and {IN_PERIOD.replace('received_at', 'i.received_at')}""",
    # projections, filters, predicates
    "effective_values": """
select evidence_id, coalesce(nullif(corrected_group_id,''), normalized_group_id) as group_id, coalesce(nullif(corrected_date,''), normalized_date) as sync_date from intake""",
    "usable_filter": f"select evidence_id, application_id, group_id from submissions where {USABLE}",
    "report_category": f"""
select evidence_id, {CATEGORY} as category, not {COPY} and not {PENDING} and sync_status='SUCCESS' as sync_visible,
 not {COPY} and not {PENDING} and sync_status='SUCCESS' and not {DONE} as sync_review from submissions""",
    "readable_filter": f"select evidence_id, confidence from submissions where {DONE} and confidence>=0.55 and length(trim(raw_text))>0",
    "evidence_state": f"select evidence_id, {STATE} as state from submissions",
    "evidence_day": f"""
select evidence_id, case when {DATED} then sync_date else cast(cast(received_at as date) as varchar) end as day,
 case when {DATED} then 'report_date' else 'received_at_unverified' end as day_basis from submissions""",
    "problem_reason": f"select evidence_id, {REASON} as reason from submissions",
    "period_filter": f"select evidence_id from submissions where {IN_PERIOD}",
    "claim_period_filter": f"""
select evidence_id, sync_date from submissions where (sync_date between '{START}' and '{END}') or (sync_date is null and {IN_PERIOD})""",
    "operational_filter": """
select evidence_id, application, "group", status from vw where lower(application) like '%suivi a%' and lower("group") like '%zone-1%'
 and status in ('REVIEW','FAILED','UNCONFIRMED')""",
    "list_evidence": f"""
select evidence_id, received_at, application_id, processing_status from submissions where {CATEGORY}='NOT_VALIDATED' and {IN_PERIOD} and media_type='image'
order by received_at desc, evidence_id limit 50 offset 20""",
    "list_results": """
select evidence_id, row_id, status, whatsapp_group_id, dashboard_group_id from r_res where whatsapp_group_id='gr8.zone-6' or dashboard_group_id='gr8.zone-6'
order by evidence_id nulls last, row_id nulls last limit 200""",
    "list_cases": f"""
select k.case_evidence_id, k.status, k.created_at from keyed_cases k join followups f on f.group_key=k.group_key
where f.status='WAITING' and floor(epoch(timestamp '{NOW}' - f.last_sent_at)/86400)>=5 order by k.created_at desc, k.case_evidence_id limit 100""",
    "list_messages": """
select message_id, evidence_id, message_date, channel_id from messages where download_status='FAILED'
order by message_date desc, message_id, evidence_id limit 100 offset 10""",
    "list_audit": "select * from audit where action='purchase' order by created_at desc, audit_id limit 100",
    "search_channels": "select channel_id, name from channels where name ilike '%tion_1%'",
    "cutoff_filter": f"select evidence_id, message_date < timestamp '{CUTOFF}' as is_late from messages",
    "scope_guard": f"""
select evidence_id, case when evidence_id%3=0 and evidence_id%4=0 then {_q(K.SCOPE_NEEDS_PERIOD)} when evidence_id%120-10 < 0 then {_q(K.SCOPE_OUT_OF_ORDER)} when evidence_id%120-10+1 > 93 then {_q(K.SCOPE_TOO_LONG)} end as problem from submissions""",
    # joins
    "join_extraction": f"""
select evidence_id, received_at, processing_status, group_id, sync_date, sync_status from submissions where {DONE} and duplicate_of_id is null""",
    "join_sender": "select s.evidence_id, m.sender_external_id from submissions s left join first_message m on m.evidence_id=s.evidence_id",
    "origin_lookup": """
select i.evidence_id, c.channel_id, c.name as channel_name, a.full_name as agent_name from intake i
left join (select m.evidence_id, arg_min(h.name, struct_pack(d := m.message_date, i := m.message_id)) as name,
 arg_min(h.channel_id, struct_pack(d := m.message_date, i := m.message_id)) as channel_id from messages m join channels h on h.channel_id=m.channel_id group by 1) c
 on c.evidence_id=i.evidence_id left join agents a on a.agent_id=i.agent_id""",
    "resolve_identity": "select evidence_id, sender_identity from ident",
    "resolve_agent": """
select m.evidence_id, a.agent_id from messages m left join (select phone, min(agent_id) as agent_id from agents group by 1 having count(*)=1) a
 on a.phone=regexp_replace(m.sender_phone, '\\D', '', 'g')""",
    "evidence_view": "select * exclude (received_at, duplicate_of_id) from vw",
    "ledger_anti": """
select row_id, group_id, sync_date from r_led where group_id not in (select group_id from r_claims where coalesce(group_id,'')<>'')""",
    "wrong_application": f"""
select evidence_id, group_id, coalesce(group_id in (select group_id from ledger where application_id<>'{APP}'), false) as in_other_application from r_claims""",
    "unknown_group": f"""
select evidence_id, group_id, not coalesce(group_id in (select group_id from assignments where application_id='{APP}'), false) as is_unknown from r_claims""",
    "nearest_date_match": f"""
select evidence_id, row_id, ledger_date, gap from ({_nearest(f"(select * from submissions where {DONE} and duplicate_of_id is null and sync_date is not null)", "ledger")}) n where rk=1""",
    "reconcile": "select * from r_res",
    "reconcile_period": "select * from p_res",
    "asof_forward_match": "select a.evidence_id, a.replacement_id from next_usable a join flagged f on f.evidence_id=a.evidence_id where f.new_reason is not null",
    "match_guards": f"""
select p.evidence_id, p.replacement_id, coalesce(b.usable and a.keyed and b.keyed and b.received_at>=a.received_at and a.sender_identity=b.sender_identity
 and a.application_id=b.application_id and a.group_id=b.group_id and a.sync_date=b.sync_date, false) as ok from (
 select a.evidence_id, b.evidence_id as replacement_id from proofs a join proofs b on a.sender_identity=b.sender_identity
 and a.group_id=b.group_id and a.sync_date=b.sync_date and a.evidence_id<b.evidence_id) p
 left join flagged a on a.evidence_id=p.evidence_id left join flagged b on b.evidence_id=p.replacement_id""",
    "manual_link_check": """
select p.evidence_id, p.replacement_id, coalesce(b.usable and a.sender_identity=b.sender_identity and b.received_at>=a.received_at
 and (a.application_id is null or coalesce(a.application_id=b.application_id,false)) and (coalesce(a.group_id,'')='' or coalesce(a.group_id=b.group_id,false))
 and (coalesce(a.sync_date,'')='' or coalesce(a.sync_date=b.sync_date,false)), false) as ok from (
 select a.evidence_id, b.evidence_id as replacement_id from proofs a join proofs b on a.sender_identity=b.sender_identity
 and coalesce(a.group_id, 'none')=coalesce(b.group_id, 'none') and cast(a.received_at as date)=cast(b.received_at as date) and a.evidence_id<b.evidence_id) p
 join flagged a on a.evidence_id=p.evidence_id join flagged b on b.evidence_id=p.replacement_id""",
    "returned_after_reminder": "select case_evidence_id, returned_count from followups where attempt_count>0",
    "coverage": "select * from cover",
    "coverage_period": f"""
select p.sender_identity, p.agent, p.locality, p.application_id, p.application, p."group", '{START}' as date, '{END}' as period_end,
 coalesce(b.status, 'MISSING') as status, b.evidence_id, coalesce(b.submission_count, 0) as submission_count,
 exists (select 1 from ledger l where l.application_id=p.application_id and l.group_id=p."group" and l.sync_date=b.date) as dashboard_present
from people p left join period_best b on b.sender_identity=p.sender_identity and b.application_id=p.application_id and b."group"=p."group" """,
    "ledger_presence": """
select evidence_id, date as day, exists (select 1 from ledger l where l.application_id=b.application_id and l.group_id=b."group" and l.sync_date=b.date) as dashboard_present
from (select *, row_number() over (partition by sender_identity, application_id, "group", date order by
 case status when 'SYNCHRONIZED' then 0 when 'REVIEW' then 1 when 'PENDING' then 2 when 'FAILED' then 3 else 4 end, received_at, evidence_id) as rk
 from vw where status<>'DUPLICATE' and date_basis='report_date' and sender_identity is not null and application_id is not null and "group" is not null) b where rk=1""",
    "project_grid": f"""
select e.business_id, e.application_id, c.day as start, c.day as "end", coalesce(x.received,0) as received, coalesce(x.valid,0) as valid,
 case when x.received is null then 'MISSING' when x.valid>0 then 'VALID' else 'RECEIVED_NOT_VALIDATED' end as status
from expected_ids e cross join calendar c left join counted_0 x on x.application_id=e.application_id and x.business_id=e.business_id
 and x.day_no=date_diff('day', date '{START}', cast(c.day as date))""",
    "project_grid_weekly": f"""
select e.business_id, e.application_id, cast(date '{START}' + 7*b as varchar) as start, cast(date '{START}' + 7*b + 6 as varchar) as "end",
 coalesce(sum(x.received),0)::bigint as received, coalesce(sum(x.valid),0)::bigint as valid,
 case when coalesce(sum(x.received),0)=0 then 'MISSING' when sum(x.valid)>0 then 'VALID' else 'RECEIVED_NOT_VALIDATED' end as status
from expected_ids e cross join (select 0 as b union all select 1) w left join counted_0 x on x.application_id=e.application_id and x.business_id=e.business_id
 and x.day_no//7=b where e.application_id='{APP}' group by e.business_id, e.application_id, b""",
    "case_history_join": """
select a.attempt_id, a.case_evidence_id, a.recipient, a.status as send_status, a.created_at as sent_at, c.status as case_status, s.application_id, s.sender_phone
from attempts a join open_cases c on c.case_evidence_id=a.case_evidence_id join submissions s on s.evidence_id=a.case_evidence_id
where a.created_at>=timestamp '2024-01-15' and a.created_at<timestamp '2024-01-19'""",
    "channel_links": "select c.channel_id, c.name, l.project_id from channels c left join links l on l.channel_id=c.channel_id",
    "channel_conflict": "select channel_id, name from channels where channel_id in (select channel_id from links where project_id<>1)",
    "extraction_outcome": f"""
select p.proof_id, i.raw_id as raw_group_id, case when replaced then best else i.norm end as group_id,
 case when replaced then 'correction_floue' when i.norm is null then null when i.num<>i.digits or i.low<>i.norm then 'regex_corrige' else 'regex' end as id_method,
 d.raw as raw_date, d.day as sync_date, coalesce(d.day is null or not d.has_year, true) as date_is_ambiguous, s.status as sync_status, s.matched as evidence_text,
 id_c as confidence_group, coalesce(case when d.day is null then 0.0 when d.has_year then 0.9 else 0.6 end, 0.0) as confidence_date, sync_c as confidence_sync,
 round((id_c + coalesce(case when d.day is null then 0.0 when d.has_year then 0.9 else 0.6 end, 0.0) + sync_c + ocr) / 4, 3) as global_confidence,
 reasons<>'' as requires_review, nullif(reasons, '') as review_reasons
from (select *, concat_ws('; ', case when i.proof_id is null then {_q(K.REVIEW_NO_ID)} when close then concat('Correspondance floue ambigue avec les IDs connus (meilleur: ', best, ', score ', round(score, 1), ')')
   when raced then {_q(K.REVIEW_ID_UNSURE)} end,
  case when d.raw is null then {_q(K.REVIEW_NO_DATE)} when d.day is null and not d.has_year then {_q(K.REVIEW_NO_YEAR)} when d.day is null then {_q(K.REVIEW_BAD_DATE)} end,
  case when ocr<{K.READABLE_CONFIDENCE} then {_q(K.REVIEW_UNREADABLE)} end, case when s.status<>'SUCCESS' then {_q(K.REVIEW_SYNC)} end) as reasons,
  case when replaced then score/100 when i.proof_id is null then 0.0 when i.norm is null then 0.0 when i.num<>i.digits then 0.75 else 1.0 end as id_c,
  case when s.matched is null or s.status='UNCONFIRMED' then 0.0 else 1.0 end as sync_c
 from (select p.proof_id, p.ocr, i, s, coalesce(case when a.raw is not null and (a.day is not null or not p.has_end) then a else b end, a) as d, i.best, i.score,
   coalesce(i.accepted and i.best is distinct from i.norm and i.score<97, false) as close, coalesce(i.accepted and i.best is distinct from i.norm and i.score>=97, false) as replaced,
   coalesce(not i.accepted, false) as raced
  from scan_texts p join scan_status s on s.proof_id=p.proof_id left join (select * from scan_dates where second=0) a on a.proof_id=p.proof_id
  left join (select * from scan_dates where second=1) b on b.proof_id=p.proof_id left join scan_ids i on i.proof_id=p.proof_id) x) p""",
    "indel_ratio": f"""
select row_number, case when raw_id='' and agent='' then 100.0 when raw_id='' or agent='' then 0.0 else round({_INDEL}, 3) end as score
from (select row_number, raw_id, agent, string_split(raw_id, '') as a, string_split(agent, '') as b from raw_rows) r""",
    "fuzzy_id_match_indel": f"""
select id, known as best_id, score as best_score, second as second_score, score-coalesce(second, 0)>=2 as accepted,
 not (score-coalesce(second, 0)>=2) or (known<>id and score<97) as needs_review from (
 select *, row_number() over (partition by id order by score desc, known) as rk, lead(score) over (partition by id order by score desc, known) as second from (
  select id, known, {_INDEL} as score from (select id, known, string_split(id, '') as a, string_split(known, '') as b from read_ids, known_ids) c) p
 where score>=80-1e-9) q where rk=1 and score>=82""",
    "fuzzy_id_match": """
select id, known as best_id, round(score, 4) as best_score, score-coalesce(second, 0)>=5 as accepted from (
 select *, row_number() over (partition by id order by score desc, known) as rk, lead(score) over (partition by id order by score desc, known) as second from (
  select id, known, 100.0*(1-levenshtein(id, known)::double/greatest(length(id), length(known))) as score from read_ids, known_ids) p
 where score>=65-1e-9) q where rk=1 and score>=70""",
    "fuzzy_id_match_weighted": f"""
select id, best_id, best_score, second_score, best_score-coalesce(second_score, 0)>=2 as accepted,
 not (best_score-coalesce(second_score, 0)>=2) or (best_id<>id and best_score<97) as needs_review, candidates from (
 select id, max(known) filter (rk=1) as best_id, round(max(score), 6) as best_score, round(max(score) filter (rk=2), 6) as second_score,
  string_agg(known, ' ' order by rk) filter (rk<=3) as candidates from (
  select *, row_number() over (partition by id order by score desc, known) as rk from ({_weighted("""
   select id, known from (select id from read_ids union select concat('ouest', substr(known, 1, 6)) from known_ids) i,
    (select known from known_ids union select concat('zone-ouest', known, '.region-', length(known)) from known_ids) k""", 84)}) w) r group by id) g where best_score>=86""",
    "detect_application": _detect(),
    "detect_application_fuzzy": _detect_near(),
    "attach_media": """
select m.message_id, m.media_filename as file_name from chat_messages m where m.media_filename in (select file_name from media_files)
union all select a.message_id, b.file_name from
 (select message_id, row_number() over (order by message_date, message_id) as n from chat_messages where media_filename='__unnamed_attachment__') a
 join (select file_name, row_number() over (order by file_name) as n from media_files where file_name not in
  (select media_filename from chat_messages where media_filename is not null)) b on a.n=b.n""",
    # aggregations
    "run_summary": "select status, count(*) as n from r_res group by 1",
    "status_share": "select status, count(*) as n, round(count(*)*100.0/(select count(*) from r_res), 1) as percent from r_res group by 1",
    "overview": f"select * exclude (rec) from ({_OVERVIEW.format(where='true', tied='true')}) o",
    "overview_period": f"select * exclude (rec) from ({_OVERVIEW.format(where=IN_PERIOD, tied=_TIED)}) o",
    "by_application": f"""
select a.application_id, a.name as application, (select count(*) from submissions s where s.application_id=a.application_id and {IN_PERIOD}) as total_evidence,
 (select count(*) from r_res r where r.application_id=a.application_id and status='CONFORME' and {_TIED}) as conform,
 (select count(*) from r_res r where r.application_id=a.application_id and status='ECART_DATE' and {_TIED}) as date_gaps from applications a""",
    "by_period": f"""
select cast(cast(received_at as date) as varchar) as period, count(*) as n, 'day' as granularity from submissions where received_at>=timestamp '{NOW}' - interval 20 day group by 1
union all select cast(cast(date_trunc('week', received_at) as date) as varchar), count(*), 'week' from submissions where received_at>=timestamp '{NOW}' - interval 91 day group by 1
union all select strftime(received_at, '%Y-%m'), count(*), 'month' from submissions where received_at>=timestamp '{NOW}' - interval 365 day group by 1""",
    "anomalies": f"select status, count(*) as n, {_RANK} as rank from r_res where status<>'CONFORME' group by status",
    "anomalies_period": f"select status, count(*) as n, {_RANK} as rank from r_res where status<>'CONFORME' and {_TIED} group by status",
    "operational_totals": """
select concat('status:', status) as measure, count(*) as value from vw group by 1
union all select 'registered_agents', count(distinct agent_id) from vw
union all select 'unregistered_contacts', count(distinct sender_identity) filter (agent_id is null) from vw
union all select 'total', count(*) from vw
union all select 'unknown_sender_reports', count(*) filter (agent_id is null and sender_identity is null) from vw
union all select 'review_queue', count(*) filter (processing_status='REQUIRES_REVIEW') from vw
union all select 'unattributed', count(*) filter (agent_id is null or date_basis<>'report_date') from vw""",
    "channel_stats": f"""
select c.channel_id, c.name, c.is_monitored, count(*) filter (m.download_status='DOWNLOADED' and m.message_date>=timestamp '{TODAY}') as media_today,
 count(*) filter (m.download_status='FAILED') as errors from channels c left join messages m on m.channel_id=c.channel_id group by 1,2,3""",
    "queue_summary": """
select count(*) filter (download_status='PENDING') as pending, count(*) filter (download_status='DOWNLOADING') as downloading,
 count(*) filter (download_status='FAILED') as failed, count(*) filter (download_status='SKIPPED_UNAUTHORIZED_GROUP') as unassigned,
 count(*) filter (evidence_id in (select evidence_id from submissions where processing_status='PENDING')) as processing from messages""",
    "import_totals": """
select count(*) as total_rows, count(*) filter (validation_errors='') as imported_rows, count(*) filter (validation_errors<>'') as rejected_rows,
 count(*) filter (is_duplicate) as duplicate_rows from import_rows""",
    "frequent_recipients": f"""
select recipient, count(distinct coalesce(external_message_id, case when status='MANUALLY_CONFIRMED' then concat(cast(created_at as date), '|', body)
 else concat('#', attempt_id) end)) as sent_count from attempts
where status in ('SENT','MANUALLY_CONFIRMED') and strftime(created_at, '%Y-%m')='{TODAY[:7]}' group by 1 having sent_count>5""",
    "case_send_stats": f"""
select case_evidence_id, sent_count, last_sent_at, cast(floor(epoch(timestamp '{NOW}' - last_sent_at)/86400) as bigint) as days_since_reminder from followups""",
    "campaign_stats": f"select status, count(*) as n from campaigns where day='{TODAY}' group by 1",
    "campaign_recipients": "select day, recipient, status from campaigns order by day desc, recipient, status limit 200",
    "campaign_runs": "select run_id, created_at, result from campaign_runs order by created_at desc, run_id desc limit 30",
    "reminder_digest": _digest(TODAY),
    "project_totals": f"""
select (select count(*) from received_0) as received, (select count(*) from received_0 where not {COPY} and {USABLE}) as valid,
 (select count(*) from received_0 where {COPY}) as duplicates,
 (select count(*) from received_0 where not {COPY} and (coalesce(group_id,'')='' or application_id is null)) as unidentified,
 (select count(*) from expected_ids, calendar) as expected,
 (select count(*) from expected_ids e, calendar c where not exists (select 1 from counted_0 x where x.application_id=e.application_id
  and x.business_id=e.business_id and x.day_no=date_diff('day', date '{START}', cast(c.day as date)))) as missing""",
    "project_by_application": f"""
select application_id, count(*) as received, count(*) filter (not {COPY} and {USABLE}) as valid, count(*) filter ({COPY}) as duplicates,
 count(*) filter (not {COPY} and (coalesce(group_id,'')='' or application_id is null)) as unidentified from received_0 group by 1""",
    "job_health": "select count(*) filter (status in ('PENDING','QUEUED','PROCESSING')) as open_jobs, count(*) filter (status='FAILED') as failed_jobs from jobs",
    "registry_totals": """
select 'agents' as registry, count(*) as total, count(*) filter (is_active) as active from agents
union all select 'applications', count(*), count(*) filter (is_active) from applications""",
    "confidence_rollup": """
select proof_id, round(avg(confidence), 3) as mean_ocr, max(confidence) as best_ocr,
 round((max(id_confidence)+max(date_confidence)+max(sync_confidence)+avg(confidence))/4, 3) as global_confidence,
 round((max(id_confidence)+max(date_confidence)+max(sync_confidence)+max(confidence))/4, 3) as refreshed_confidence from readings group by 1""",
    "keyword_union": f"""
select concat('mot', s_nationkey) as keyword from supplier where s_acctbal>0 union select concat('cle', s_suppkey%20) from supplier where s_acctbal>0
union select unnest([{_list(K.SUCCESS_KEYWORDS)}])""",
    "agents_nested": """
select a.agent_id, a.full_name, g.application_id, g.group_id from agents a left join agent_groups g on g.agent_id=a.agent_id""",
    "case_groups": """
select l.case_evidence_id, s.case_count, d.group_key is not null as resolved, d.replacement_evidence_id from case_lead l
join case_size s on s.group_key=l.group_key left join case_done d on d.group_key=l.group_key""",
    # windows
    "dup_claims": """
select evidence_id, open and row_number() over (partition by open, application_id, group_id, sync_date order by received_at, evidence_id)>1 as is_repeat
from (select *, coalesce(group_id,'')<>'' and coalesce(sync_date,'')<>'' and coalesce(sync_status='SUCCESS',false) and not coalesce(requires_review,true)
  and not coalesce(date_is_ambiguous,true) and application_id is not null and processing_status='COMPLETED' as open from r_claims) c""",
    "dup_ledger": "select row_id, count(*) over (partition by group_id, sync_date) as n from ledger",
    "import_dups": "select row_number, normalized_group_id, is_duplicate from import_rows",
    "content_dedup": """
select doc_id, h as sha256, case when h is not null then nullif(min(doc_id) over (partition by h), doc_id) end as duplicate_of_id
from (select doc_id, case when doc_id%11<>0 then sha256(text) end as h from documents) d""",
    "recipient_of_agent": "select evidence_id, recipient from recipients",
    "import_errors": "select row_number, raw_group_id, validation_errors from import_rows where validation_errors<>''",
    "complete_usable": f"select evidence_id, case when {USABLE} then 'COMPLETED' else processing_status end as processing_status from proofs",
    "latest_run": "select job_id as run_id, finished_at from jobs where status='COMPLETED' order by finished_at desc, job_id desc limit 1",
    "best_status": f"""
select user_id, status, evidence_id, best_date, submission_count from (select *, count(*) over (partition by user_id) as submission_count,
 row_number() over (partition by user_id order by case status when 'SYNCHRONIZED' then 0 when 'REVIEW' then 1 when 'PENDING' then 2 when 'FAILED' then 3 else 4 end,
  received_at, evidence_id) as rk from (select *, {STATE} as status, case when {DATED} then sync_date else cast(cast(received_at as date) as varchar) end as best_date
  from submissions) s where status<>'DUPLICATE') q where rk=1""",
    "first_observation": 'select sender_identity, application_id, "group", agent, locality, application from people',
    "latest_explicit_state": """
select proof_id, arg_max(status, struct_pack(t := at_time, i := frame_id)) as state from frame_read where matched is not null group by 1""",
    "state_changes": _CHANGES.format(ident="event_id", key="user_id", state="event_type", at="ts", source="events"),
    "best_reading": """
select b.proof_id, b.reading_id as best_reading_id, b.text as best_text, b.confidence as best_confidence, regexp_matches(b.text, '\\S') as is_read, c.combined_text
from (select *, row_number() over (partition by proof_id order by not regexp_matches(text, '\\S'), confidence desc, reading_id) as rk from readings) b
join (select proof_id, string_agg(text, chr(10) order by place) as combined_text from (select proof_id, text, min(rk) as place from (
  select *, row_number() over (partition by proof_id order by confidence desc, reading_id) as rk from readings) r where rk<=3 and text<>'' group by 1,2) d group by 1) c
 on c.proof_id=b.proof_id where b.rk=1""",
    "representative_picks": """
select proof_id, pick, frame_id from (select proof_id, frame_id, row_number() over (partition by proof_id order by case when is_visual then 0 else 1 end,
  case when is_visual then -place else place end, frame_id) as pick
 from (select *, count(*) over (partition by proof_id) as n from shots) s where is_visual or place=0 or place=n//2 or place=n-1) q where pick<=3""",
    "best_frame": """
select proof_id, frame_id, position, is_selected_best from (select *, row_number() over (partition by proof_id order by not is_selected_best, position<>'end', frame_id) as rk
 from frames) f where rk=1""",
    "budget_select": """
select batch_id, generate_subscripts(kept, 1)-1 as turn, unnest(kept) as image_id from (
 select batch_id, list_reduce(list({'used': size, 'kept': [image_id]} order by place, image_id),
  lambda acc, x: case when acc.used+x.used<=10000000 then {'used': acc.used+x.used, 'kept': list_concat(acc.kept, x.kept)} else acc end,
  {'used': 0::bigint, 'kept': []::bigint[]}).kept as kept
 from images where size<=2000000 group by 1) r""",
    # order, limit, sets
    "page": "select doc_id, lang, n_chars from documents order by n_chars desc, doc_id limit 50 offset 25",
    "list_recent": "select job_id, status, finished_at from jobs order by finished_at desc, job_id limit 50",
    "top_failures": "select job_id, job_type, finished_at from jobs where status='FAILED' order by finished_at desc, job_id limit 10",
    "sorted_ids": "select distinct group_id from submissions where coalesce(group_id,'')<>''",
    "result_union": "select evidence_id, 'claim' as side, cast(null as bigint) as row_id from r_claims union all select null, 'ledger', row_id from ledger",
    "retention_plan": f"""
select path, problem is null as removable, problem from (select path, case when path like '%.exe' then 'type not allowed' end as problem from (
 select path, bool_and(old) as all_old from (
  select storage_path as path, received_at < timestamp '{NOW}' - interval 14 day and not {PENDING} and evidence_id not in (select job_id from jobs where status='PROCESSING') as old from intake
  union all select f.storage_path, i.received_at < timestamp '{NOW}' - interval 14 day and not {PENDING} and i.evidence_id not in (select job_id from jobs where status='PROCESSING')
  from frame_files f join intake i on i.evidence_id=f.evidence_id) a group by 1) b where all_old) c""",
    "new_ids": """
select business_id, case when business_id in (select business_id from expected_ids) then 'already_present' else 'added' end as outcome
from (select distinct lower(trim(value)) as business_id from typed_ids) t""",
    # scalar functions
    "fold_text": "select doc_id, md5(lower(strip_accents(text))) as folded from documents",
    "find_id_candidates": f"""
select doc_id, len(hits) as n, array_to_string(hits, '|') as candidates from (
 select doc_id, {_ID_HITS.replace("{t}", _CUT.replace("{}", _CUT.replace("{}", "text")))} as hits from documents) d""",
    "normalize_id": """
select row_number, norm as normalized, norm is not null as valid, case when norm is null then 0.0 when num<>digits then 0.75 else 1.0 end as confidence,
 concat_ws('|', case when digits<>'' and num<>digits then concat('segment numerique ''', digits, ''' -> ''', num, '''') end,
 case when norm is not null and low<>norm then concat('nettoyage separateurs: ''', raw_id, ''' -> ''', norm, '''') end) as corrections from norm_ids""",
    "find_date_candidates": f"""
select row_number, array_to_string(list_transform(regexp_extract_all(concat_ws(' ', raw_id, raw_date, agent), {_q(DATE_PATTERN)}, 1),
 lambda p: {_TIDY.format("p")}), '|') as candidates from raw_rows""",
    "parse_report_date": f"""
select row_number, raw as raw_text, cast(d as varchar) as normalized_date, d is null or not has_year as is_ambiguous, coalesce(not has_year, false) as missing_year,
 case when d is null then 0.0 when has_year then 0.9 else 0.6 end as confidence
from ({DATES_VIEW.replace("{context}", "case when row_number%2=0 then '2024' end")}) p""",
    "sync_text_status": f"""
select evidence_id, status, matched, case when matched is null or status='UNCONFIRMED' then 0.0 else 1.0 end as confidence
from ({STATUS_VIEW.format(source="texts")}) s""",
    "sync_text_status_fuzzy": _near_status("documents", "doc_id"),
    "phone_key": """
select evidence_id, regexp_replace(sender_phone, '[\\s+().-]', '', 'g') as phone, cast(null as varchar) as address_phone from messages""",
    "recipient": """
select evidence_id, coalesce(case when regexp_matches(sender_external_id, '^\\d+@(c\\.us|lid)$') then sender_external_id end,
 concat(regexp_replace(sender_phone, '[\\s+().-]', '', 'g'), '@c.us')) as recipient from messages""",
    "business_key": "select row_number, lower(trim(coalesce(raw_id,''))) as business_id from raw_rows",
    "media_kind": "select * from media_plain",
    "week_start": "select event_id, cast(cast(date_trunc('week', ts) as date) as varchar) as week from events",
    "month_key": "select o_orderkey, strftime(o_orderdate, '%Y-%m') as month from orders",
    "suggested_message": f"""
select evidence_id, concat('Bonjour ', coalesce(sender_name,''), ', votre rapport (', coalesce(a.name,'Application à préciser'), ' / ',
 coalesce(group_id,'Groupe à préciser'), ' / ', coalesce(sync_date,'Date à préciser'), ') est à refaire. Motif : ', sync_status, '. ',
 {_q(K.RECORDING_INSTRUCTIONS)}, ' Renvoyez la correction dans le groupe WhatsApp d''origine. ', {_q(K.PRIVATE_CHAT_NOTICE)}, ' Référence de suivi : ', evidence_id, '.') as body from intake i left join applications a on a.application_id=i.application_id""",
    "append_history": "select evidence_id, case when evidence_id%2=0 then 2 else 1 end as entries from submissions",
    "validation_errors": "select row_number, validation_errors='' as is_valid, validation_errors from import_rows",
    "notification_panel": f"select frame_id, {PANEL} as is_panel from frame_read",
    # pipelines
    "import_ledger": "select *, validation_errors='' as is_valid from import_rows",
    "frame_state": f"""
select proof_id, last.status as sync_status, last.matched as evidence_text, last.confidence from (
 select proof_id, list_reduce(list_prepend(struct_pack(status := 'UNCONFIRMED', matched := cast(null as varchar), confidence := 0.0::double, kind := 'N'),
  list(struct_pack(status := status, matched := matched, confidence := confidence, kind := kind) order by at_time, frame_id)),
  lambda a, x: case when x.kind in ('F','C','W') or (x.kind in ('G','U') and a.status<>'SUCCESS') then x else a end) as last from (
  select proof_id, frame_id, at_time, kind, case kind when 'C' then 'SUCCESS' when 'U' then 'UNCONFIRMED' else status end as status,
   case when kind='C' then {_q(K.TEXT_CHECK_VISIBLE)} when kind='U' and code='pfnlcoach' then {_q(K.TEXT_LABEL_UNCONFIRMED)} else matched end as matched,
   case when kind='C' then 0.95 when kind='U' or status='UNCONFIRMED' then 0.0 else 1.0 end as confidence from (
   select f.*, a.code, case when position not in ('start','middle','end') or {PANEL} then 'N' when status='FAILED' then 'F'
    when coalesce(a.code, '') not like '%coach' then case when matched is not null then 'W' else 'N' end
    when check_visible then 'C' when a.code in ('watercoach','yebcoach','financecoach') then 'N'
    when a.code='pfnlcoach' then case when regexp_matches(regexp_replace(f, '[^a-z]', '', 'g'), 'uploaddata|telechargerlesdonnees') then 'U' else 'N' end
    when matched is null then 'N' when status='SUCCESS' then case when a.code='agricoach' then 'N' else 'G' end else 'U' end as kind
   from frame_read f left join proof_apps a on a.proof_id=f.proof_id) k) e group by 1) z""",
    "apply_reviews": """
select s.evidence_id, coalesce(g.v, s.group_id) as group_id, coalesce(d.v, s.sync_date) as sync_date, case when d.v is not null then false else s.date_is_ambiguous end as date_is_ambiguous,
 case when o.validated or o.completed then false else s.requires_review end as requires_review, case when o.validated then 'SUCCESS' else s.sync_status end as sync_status,
 coalesce(o.outcome, s.processing_status) as processing_status
from submissions s
left join (select evidence_id, arg_max(new_group, at_time) as v from review_events where kind='correct' and new_group is not null group by 1) g on g.evidence_id=s.evidence_id
left join (select evidence_id, arg_max(new_date, at_time) as v from review_events where kind='correct' and new_date is not null group by 1) d on d.evidence_id=s.evidence_id
left join (select evidence_id, arg_max(outcome, at_time) filter (outcome is not null) as outcome, bool_or(kind='validate') as validated, bool_or(kind='correct' and outcome='COMPLETED') as completed from (
 select e.*, case kind when 'validate' then 'COMPLETED' when 'reject' then 'FAILED' when 'status' then new_status
  else case when (b.group_id is not null or exists (select 1 from review_events x where x.evidence_id=e.evidence_id and x.kind='correct' and x.new_group is not null and x.at_time<=e.at_time))
   and (b.sync_date is not null or exists (select 1 from review_events x where x.evidence_id=e.evidence_id and x.kind='correct' and x.new_date is not null and x.at_time<=e.at_time))
   then 'COMPLETED' end end as outcome from review_events e join submissions b on b.evidence_id=e.evidence_id) z group by 1) o on o.evidence_id=s.evidence_id""",
    "review_history": f"""
select evidence_id, at_time, kind, case when kind='correct' then new_group end as new_group, case when kind='correct' then new_date end as new_date,
 case when kind='validate' then 'SUCCESS' end as new_sync_status, case when kind='validate' then {_q(K.TEXT_VALIDATED)} end as evidence_text
from review_events where kind in ('correct','validate')""",
    "evidence_dataset": f"""
select evidence_id, agent, locality, application, date, status from vw where date between '{START}' and '{END}' and lower(coalesce(locality,'')) like '%a%'""",
    "followup_dataset": """
select f.case_evidence_id, f.case_count, f.status, f.returned_count, f.attempt_count, f.last_send_status, f.uncertain_send, f.replacement_evidence_id, f.reason, v.agent
from vfollowups f join vw v on v.evidence_id=f.case_evidence_id""",
    "coverage_dataset": """
select sender_identity, application, "group", date, status from cover where status='MISSING' and lower(agent) like '%supplier%'""",
    "rebuild_cases": "select * from rebuilt",
    "rebuild_followups": f"""
select p.evidence_id, case when {USABLE} then 'COMPLETED' else processing_status end as processing_status, r.status as case_status, r.replacement_evidence_id
from proofs p left join rebuilt r on r.case_evidence_id=p.evidence_id""",
    "reminder_candidates": f"""
select case_evidence_id, r.recipient, case when outcome<>'closed' and r.recipient is null then 'no_recipient' else outcome end as outcome from (
 select coalesce(k.group_key, concat('unknown ', a.case_evidence_id)) as lead, min(a.case_evidence_id) as case_evidence_id,
  max(case when k.group_key is null then 'closed' when b.group_key is not null then 'blocked' else 'ready' end) as outcome
 from (select case_evidence_id from open_cases) a left join (select * from keyed_cases where status<>'RESOLVED') k on k.case_evidence_id=a.case_evidence_id
 left join (select distinct y.group_key from attempts t join (select * from keyed_cases where status<>'RESOLVED') y on y.case_evidence_id=t.case_evidence_id
  where t.status in ('SENDING','UNKNOWN') or t.created_at > timestamp '{NOW}' - interval 60 second) b on b.group_key=k.group_key group by 1) q
 join recipients r on r.evidence_id=q.case_evidence_id""",
    "prepare_drafts": f"""
select l.case_evidence_id, r.recipient, concat('Bonjour ', coalesce(r.sender_name,''), ', votre rapport (', coalesce(r.application,'Application à préciser'), ' / ',
 coalesce(r.group_id,'Groupe à préciser'), ' / ', coalesce(r.sync_date,'Date à préciser'), ') est à refaire. Motif : ', l.reason, '. ', {_q(K.RECORDING_INSTRUCTIONS)},
 ' Renvoyez la correction dans le groupe WhatsApp d''origine. ', {_q(K.PRIVATE_CHAT_NOTICE)}, ' Référence de suivi : ', l.case_evidence_id, '.') as body
from case_lead l join recipients r on r.evidence_id=l.case_evidence_id where l.group_key not in (select group_key from case_done)
 and l.group_key not in (select y.group_key from attempts t join keyed_cases y on y.case_evidence_id=t.case_evidence_id
  where t.status in ('SENDING','UNKNOWN') or t.created_at > timestamp '{NOW}' - interval 60 second)
and r.recipient is not null""",
    # streaming (batch twins)
    "stream_dedup": "select distinct message_id from messages",
    "stream_route": f"""
select evidence_id, {_ROUTE} as route, case when message_date < timestamp '{CUTOFF}' then {_q(K.CUTOFF_NOTE)}
 when download_status='DOWNLOADED' and coalesce(is_monitored,false) and storage_path is null then {_q(K.MISSING_FILE_NOTE)} end as route_note
from messages m left join channels c on c.channel_id=m.channel_id""",
    "stream_late": f"select evidence_id, message_date < timestamp '{CUTOFF}' as is_late from messages",
    "discover_channels": """
select channel_id, channel_id not in (select channel_id from channels) as is_new, max(message_date) as last_activity from messages group by 1""",
    "stream_content_dedup": """
select evidence_id, sha256, nullif(first_value(evidence_id) over (partition by sha256 order by ts, evidence_id), evidence_id) as duplicate_of_id
from (select event_id as evidence_id, ts, md5(concat(user_id, '-', k)) as sha256 from ev0) m""",
    "stream_case_state": "select * from rebuilt",
    "stream_dedup_tables": "select distinct message_id from messages",
    "gateway_transitions": _CHANGES.format(ident="event_id", key="gateway_id", state="connection_state", at="at_time", source="gateway"),
    "stream_gateway": _CHANGES.format(ident="event_id", key="gateway_id", state="connection_state", at="at_time", source="gateway"),
    "tumbling_counts": """
select cast(cast(message_date as date) as varchar) as day, channel_id, count(*) as messages, count(*) filter (download_status='DOWNLOADED') as downloaded
from messages group by 1,2""",
    "daily_digest": _digest("2024-01-17"),
    "retry_budget": """
select evidence_id, case when retry_count<5 then retry_count+1 else retry_count end as retry_count,
 case when retry_count<5 then 'DOWNLOADED' else download_status end as download_status, case when retry_count<5 then 'retry' else 'spent' end as outcome from messages""",
}


_CASE_VIEWS = (
    "keyed_cases", "case_lead", "case_done", "case_size", "case_attempts", "reports", "returns", "followups", "proofs",
)


def _for_view(sql: str) -> str:
    """Case views over the operational view instead of the plain proofs."""
    return re.sub(r"\b(" + "|".join(_CASE_VIEWS) + r")\b", r"v\1", sql)


ORACLE_VIEWS["vproofs"] = """
select evidence_id, received_at, sender_identity, application_id, "group" as group_id, detected_date as sync_date, date_is_ambiguous, duplicate_of_id from vw"""
for _name in _CASE_VIEWS[:-1]:
    ORACLE_VIEWS[f"v{_name}"] = _for_view(ORACLE_VIEWS[_name])


def oracles() -> dict[str, str]:
    return {name: with_views(sql, ORACLE_VIEWS) for name, sql in SQL.items()}
