"""DuckDB SQL for the queries that SQL can express."""

_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLES = {
    "op2_line_dedup": f"""
with docs as (select doc_id, coalesce(text, '') as t, string_split(coalesce(text, ''), chr(10)) as ls from documents),
lines as (select doc_id, unnest(ls) as line, generate_subscripts(ls, 1) as pos from docs),
keyed as (select doc_id, line, pos, {_LOWER.format("trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))")} as k from lines),
freq as (select k, max(doc_id) as holder from keyed where length(k) >= 20 group by k having count(distinct doc_id) >= 3),
marked as (select keyed.*, holder is not null and holder <> doc_id as drops from keyed left join freq using (k)),
kept as (
  select doc_id, count(*) as n_lines, count(*) filter (drops) as n_dropped,
         coalesce(string_agg(line, chr(10) order by pos) filter (not drops), '') as kept from marked group by doc_id)
select doc_id, n_lines, n_dropped, sha256(kept) as kept_sha256 from kept
""",
    "op9_exact_dedup": f"""
with t as (select doc_id, {_LOWER.format("coalesce(text, '')")} as norm from documents)
select doc_id, max(doc_id) over (partition by norm) as keep_id, count(*) over (partition by norm) as group_size,
       doc_id = max(doc_id) over (partition by norm) as kept, sha256(norm) as text_sha256
from t
""",
    "op5_warc": """
with p as (select page_id, coalesce(html, '') as payload from pages),
sized as (select page_id, octet_length(encode(payload)) as payload_bytes, sha1(payload) as payload_digest, max(page_id) over (partition by payload) as holder from p)
select page_id, payload_bytes, payload_digest,
       case when payload_bytes >= 1000 and page_id <> holder then 'revisit' else 'response' end as record_type,
       case when payload_bytes >= 1000 and page_id <> holder then holder end as refers_to
from sized
""",
}
