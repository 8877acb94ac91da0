"""Domain views over the test tables, as one SQL text for Spark and DuckDB alike.

They only shape inputs: operators take any DataFrame with the same columns.
"""

from __future__ import annotations

import re
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession

from proofline.session import configure

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
    "embeddings", "pages", "benchmark", "labels", "conversations",
)

VIEWS: dict[str, str] = {
    "ev0": """
select event_id, ts, user_id, event_type, value, cast(regexp_extract(props, '([0-9]+)', 1) as int) as k
from events""",
    "submissions": """
select event_id as evidence_id, ts as received_at, user_id,
 concat('22670', lpad(cast(user_id as string), 6, '0')) as sender_phone,
 case when event_id%29=0 then null else concat('app', cast(k%5 as string)) end as application_id,
 case when event_id%23=0 then null when event_id%17=0 then concat('gr', cast(200+user_id%4 as string), '.zone-0')
  else concat('gr', cast(user_id%40 as string), '.zone-', cast(user_id%7 as string)) end as group_id,
 case when event_id%19=0 then null else cast(cast(ts as date) - cast(event_id%3 as int) as string) end as sync_date,
 event_id%31=0 as date_is_ambiguous, event_id%53=0 as requires_review,
 case event_type when 'error' then 'FAILED' when 'view' then 'UNCONFIRMED' else 'SUCCESS' end as sync_status,
 case when event_id%43=0 then 'DUPLICATE' when event_id%37=0 then 'PENDING' when event_id%13=0 then 'REQUIRES_REVIEW'
  when event_id%41=0 then 'FAILED' else 'COMPLETED' end as processing_status,
 case when event_id%43=0 then event_id-1 end as duplicate_of_id,
 case when event_id%2=0 then 'video' else 'image' end as media_type,
 case when event_id%47=0 then '' else 'rapport' end as raw_text,
 cast(k as double)/100 as confidence
from ev0 where event_type<>'purchase'""",
    "intake": """
select s.*, group_id as normalized_group_id, sync_date as normalized_date,
 case when evidence_id%25=0 then 'gr7.zone-7' when evidence_id%25=1 then '' end as corrected_group_id,
 case when evidence_id%50=0 then '2024-01-10' when evidence_id%50=1 then '' end as corrected_date,
 case when evidence_id%15=0 then user_id%100+1 end as agent_id,
 case when evidence_id%3=0 then concat('Envoyeur ', cast(user_id as string)) end as sender_name,
 concat('uploads/', cast(user_id%40 as string), '/', cast(evidence_id - evidence_id%2 as string),
  case when evidence_id%61=0 then '.exe' else '.jpg' end) as storage_path
from submissions s""",
    "proofs": """
select i.*, concat(sender_phone, '@c.us') as sender_identity,
 case when user_id%3=1 then concat('99', cast(user_id as string), '@lid') end as sender_external_id
from intake i""",
    "contacts": """
select evidence_id, received_at, application_id, group_id, sync_date, date_is_ambiguous, requires_review, sync_status, processing_status,
 duplicate_of_id, media_type, raw_text, confidence, sender_identity, sender_name, agent_id,
 case when evidence_id%10=0 then null when evidence_id%10=5 then '' else sender_phone end as sender_phone,
 case when evidence_id%10=0 then null else sender_external_id end as sender_external_id
from proofs""",
    "ledger": """
select event_id as row_id, concat('app', cast(k%5 as string)) as application_id,
 case when event_id%6=0 then concat('gr', cast(100+user_id%3 as string), '.zone-0')
  else concat('gr', cast(user_id%40 as string), '.zone-', cast(user_id%7 as string)) end as group_id,
 cast(cast(ts as date) as string) as sync_date, true as is_valid
from ev0 where event_type='purchase'""",
    "assignments": """
select distinct application_id, group_id from submissions
where group_id is not null and application_id is not null and group_id not in ('gr201.zone-0','gr203.zone-0')""",
    "applications": """
select concat('app', cast(r_regionkey as string)) as application_id, concat('Suivi ', r_name) as name,
 r_regionkey<>3 as is_active
from region""",
    "agents": """
select s_suppkey as agent_id, s_name as full_name, n_name as locality,
 concat('22670', lpad(cast(s_suppkey%90 as string), 6, '0')) as phone, s_acctbal > 0 as is_active
from supplier join nation on s_nationkey=n_nationkey""",
    "agent_groups": """
select distinct user_id%100+1 as agent_id, application_id, group_id from submissions
where application_id is not null and group_id is not null""",
    "channels": """
select n_nationkey as channel_id, n_name as name, n_nationkey%3<>0 as is_monitored,
 concat('app', cast(n_nationkey%5 as string)) as application_id, n_regionkey as project_id
from nation""",
    "links": """
select channel_id, project_id from channels where channel_id%6<>0""",
    "messages": """
select concat('m', cast(case when event_id%20=1 then event_id-1 else event_id end as string)) as message_id,
 event_id%27 as channel_id, ts as message_date, event_id as evidence_id,
 case user_id%3 when 0 then concat('22670', lpad(cast(user_id as string), 6, '0'), '@c.us')
  when 1 then concat('99', cast(user_id as string), '@lid') end as sender_external_id,
 concat('+226 70', lpad(cast(user_id as string), 6, '0')) as sender_phone,
 case when event_id%11=0 then 'FAILED' when event_id%12=0 then 'PENDING' else 'DOWNLOADED' end as download_status,
 case when event_id%14=0 then null else concat('inbox/', cast(event_id as string), '.jpg') end as storage_path,
 md5(concat(cast(user_id as string), '-', cast(k%10 as string))) as sha256, event_id%8 as retry_count
from ev0""",
    "attempts": """
select evidence_id*10 + n as attempt_id, evidence_id as case_evidence_id, concat(sender_phone, '@c.us') as recipient,
 received_at + interval 6 hour * n as created_at, 'rappel' as body,
 case when evidence_id%5=0 then 'UNKNOWN' when evidence_id%7=0 then 'MANUALLY_CONFIRMED' else 'SENT' end as status,
 case when evidence_id%7=0 then null else concat('x', cast(evidence_id*10+n as string)) end as external_message_id
from submissions cross join (select 1 as n union all select 2 as n) t
where evidence_id%4=0 and sync_status<>'SUCCESS'""",
    "prior_cases": """
select evidence_id as case_evidence_id,
 case when evidence_id%6=0 then 'RESOLVED' when evidence_id%6=3 then 'WAITING' else 'OPEN' end as status,
 case when evidence_id%6=0 then evidence_id+1 end as replacement_evidence_id, received_at as created_at
from submissions where sync_status<>'SUCCESS' and evidence_id%3=0""",
    "open_cases": """
select evidence_id as case_evidence_id,
 case when evidence_id%6=0 then 'RESOLVED' when evidence_id%6=3 then 'WAITING' else 'OPEN' end as status,
 case when evidence_id%6=0 then evidence_id+1 end as replacement_evidence_id, received_at as created_at,
 concat('motif ', cast(evidence_id%5 as string)) as reason
from submissions where sync_status<>'SUCCESS'""",
    "campaigns": """
select cast(cast(received_at as date) as string) as day, concat(sender_phone, '@c.us') as recipient,
 case when evidence_id%3=0 then 'UNKNOWN' else 'SENT' end as status
from submissions where evidence_id%40=0""",
    "campaign_runs": """
select event_id as run_id, ts as created_at, concat('batch ', cast(k as string), ': ', event_type) as result from ev0 where event_id%97=0""",
    "expected_ids": """
select distinct 0 as project_id, application_id, group_id as business_id from submissions
where application_id in ('app0','app1') and group_id is not null
union all select 0 as project_id, 'app0' as application_id, 'gr.absent' as business_id""",
    "typed_ids": """
select case c_custkey%9 when 0 then 'ID' when 1 then '' when 2 then 'Identifiant'
 else concat(' GR', cast(c_custkey%60 as string), '.Zone-', cast(c_custkey%7 as string), ' ') end as value
from customer""",
    "raw_rows": """
select c_custkey as row_number,
 case c_custkey%8 when 0 then concat('GR', cast(c_custkey%50 as string), '.ZONE NORD')
  when 1 then concat('gr', cast(c_custkey%50 as string), ' . zone_sud') when 2 then 'grO.zone-est' when 3 then ''
  when 4 then 'sans identifiant' else concat('gr', cast(c_custkey%50 as string), '.zone-ouest') end as raw_id,
 case c_custkey%6 when 0 then concat('2026-07-', lpad(cast(1+c_custkey%28 as string),2,'0'))
  when 1 then concat(lpad(cast(1+c_custkey%28 as string),2,'0'), '/07/2026')
  when 2 then concat(cast(1+c_custkey%28 as string), ' juillet 2026')
  when 3 then concat('Jeudi ', cast(1+c_custkey%28 as string), ', Juillet') when 4 then 'date-invalide' else '' end as raw_date,
 c_name as agent, c_mktsegment as locality
from customer""",
    "agent_rows": """
select s_suppkey + 1 as row_number, case when s_suppkey%9=0 then ' ' when s_suppkey%9=1 then null else concat(' ', s_name) end as nom_agent,
 concat('+226 70 ', cast(s_suppkey as string)) as telephone, concat('Zone ', cast(s_nationkey as string)) as zone
from supplier""",
    "texts": """
select event_id as evidence_id, case event_id%8 when 0 then 'Synchronisation réussie !'
  when 1 then 'Envoi du lot 3: Failed' when 2 then 'Appuyez sur Synchroniser'
  when 3 then 'Données non synchronisées' when 4 then 'Synchronisation en cours, upload data'
  when 5 then 'lot 1 completed, lot 2 Failed' when 6 then '' else 'FieldCoach upload complete' end as text,
 case when event_id%3=0 then 'start' when event_id%3=1 then 'middle' else 'end' end as position,
 event_id%60 as offset_seconds, user_id as proof_id, k%2=0 as check_visible, cast(k as double)/100 as confidence
from ev0""",
    "frames": """
select evidence_id as frame_id, proof_id, position, offset_seconds, 120 as duration_seconds, check_visible, confidence,
 evidence_id%77=0 as is_selected_best,
 case when evidence_id%31=0 then 'Enregistrement de l''écran - Bluetooth - Gérer les notifications - Failed' else text end as text
from texts""",
    "scans": """
select evidence_id as frame_id, proof_id, position, offset_seconds, 120 as duration_seconds, confidence,
 case when evidence_id%10=0 then concat('GR', cast(proof_id%40 as string), '. zone ', cast(proof_id%7 as string), ' ecran')
  when evidence_id%10=1 then concat('Jeudi ', cast(1+evidence_id%28 as string), ' juillet 2026') else text end as text
from texts""",
    "proof_apps": """
select distinct proof_id, case proof_id%9 when 0 then 'fieldcoach' when 1 then 'watercoach' when 2 then 'pfnlcoach' when 3 then 'yebcoach'
 when 4 then 'financecoach' when 5 then 'agricoach' when 6 then null else 'terrain' end as code from texts""",
    "readings": """
select conv_id as proof_id, conv_id*1000+turn as reading_id, text, cast((conv_id*7+turn*13)%100 as double)/100 as confidence,
 cast(conv_id%10 as double)/10 as id_confidence, 0.9 as date_confidence, 1.0 as sync_confidence
from conversations""",
    "shots": """
select conv_id as proof_id, conv_id*1000+turn as frame_id, turn as place, turn%4=3 as is_visual from conversations""",
    "images": """
select user_id as batch_id, event_id as image_id, event_id as place, cast(k*45000 + event_id%1000 as bigint) as size from ev0""",
    "jobs": """
select o_orderkey as job_id, case o_orderstatus when 'F' then 'FAILED' when 'O' then 'COMPLETED' else 'PROCESSING' end as status,
 o_orderdate as finished_at, o_orderpriority as job_type, o_orderkey as evidence_id
from orders""",
    "frame_files": """
select evidence_id, concat('frames/', cast(evidence_id - evidence_id%4 as string), '.png') as storage_path from submissions
where evidence_id%2=0""",
    "review_events": """
select evidence_id, evidence_id*10+1 as event_id, received_at + interval 1 hour as at_time,
 case evidence_id%4 when 0 then 'validate' when 1 then 'reject' when 2 then 'correct' else 'status' end as kind,
 case when evidence_id%4=2 then 'gr1.zone-1' end as new_group, case when evidence_id%8=2 then '2024-01-15' end as new_date,
 case when evidence_id%4=3 then 'REQUIRES_REVIEW' end as new_status
from submissions where evidence_id%9=0
union all
select evidence_id, evidence_id*10+2 as event_id, received_at + interval 2 hour as at_time, 'validate' as kind,
 null as new_group, null as new_date, null as new_status
from submissions where evidence_id%27=0""",
    "audit": """
select event_id as audit_id, event_type as action, ts as created_at, user_id as entity_id from events""",
    "gateway": """
select event_id, ts as at_time, user_id as gateway_id,
 case event_type when 'error' then 'ERROR' when 'view' then 'CONNECTED' when 'click' then 'CONNECTED'
  when 'purchase' then null else 'RECONNECTING' end as connection_state
from ev0""",
    "media_files": """
select concat(case when page_id%3=0 then 'IMG-' else 'VID-' end, lpad(cast(page_id as string), 7, '0'),
 case when page_id%5=0 then '.mp4' else '.jpg' end) as file_name from pages""",
    "chat_messages": """
select concat('m', lpad(cast(event_id as string), 9, '0')) as message_id, ts as message_date,
 case when event_id%4=0 then concat('IMG-', lpad(cast(event_id%3000 as string), 7, '0'), '.jpg')
  when event_id%4=1 then '__unnamed_attachment__' end as media_filename
from ev0""",
}

_WORD = re.compile(r"[a-z_0-9]+")


def _needed(sql: str, views: Mapping[str, str]) -> list[str]:
    """Views a text mentions, with those they need, in definition order."""
    wanted: set[str] = set()
    queue = [sql]
    while queue:
        for name in set(_WORD.findall(queue.pop())) & views.keys() - wanted:
            wanted.add(name)
            queue.append(views[name])
    return [name for name in views if name in wanted]


def with_views(sql: str, views: Mapping[str, str]) -> str:
    """The query with the views it needs as common table expressions."""
    parts = [f"{name} AS ({views[name].strip()})" for name in _needed(sql, views)]
    return f"WITH {', '.join(parts)} {sql.strip()}" if parts else sql.strip()


_SOURCE = re.compile(r"\b(from|join)\s+([a-z_0-9]+)")


class Tables:
    """Test tables and views of one folder, as DataFrames by name. Each is planned once."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = configure(spark)
        self.sf_dir = str(sf_dir).rstrip("/")
        self._known: dict[str, DataFrame] = {}

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._known:
            self._known[name] = (
                self.sql(VIEWS[name]) if name in VIEWS
                else self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
            )
        return self._known[name]

    def sql(self, sql: str) -> DataFrame:
        """A query over the tables and views, each handed to Spark as a DataFrame."""
        names = {n for _, n in _SOURCE.findall(sql) if n in VIEWS or n in TABLES}
        marked = _SOURCE.sub(lambda m: f"{m[1]} {{{m[2]}}}" if m[2] in names else m[0], sql.strip())
        return self.spark.sql(marked, **{n: self[n] for n in names})

    def operations(self) -> dict[str, DataFrame]:
        """Inputs of the operational datasets."""
        return {
            "submissions": self["intake"], "messages": self["messages"], "agents": self["agents"],
            "applications": self["applications"], "ledger": self["ledger"], "cases": self["open_cases"],
            "attempts": self["attempts"],
        }
