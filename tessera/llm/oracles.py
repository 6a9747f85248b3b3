"""DuckDB SQL of the queries that SQL can express. The others are learned, hash bytes that DuckDB can't, or run compiled tokenizers;
tests/llm holds them against brute force."""

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP9 = rf"""with recursive w as (select doc_id, regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+') ws from documents),
s as (select doc_id, case when len(ws) = 0 then [] when len(ws) < 5 then [array_to_string(ws, ' ')]
      else list_distinct([array_to_string(ws[i:i+4], ' ') for i in range(1, len(ws)-3)]) end sh from w),
e as (select doc_id, len(sh) n, unnest(sh) g from s),
p as (select a.doc_id a, b.doc_id b, a.n na, b.n nb, count(*) k from e a join e b on a.g = b.g and a.doc_id < b.doc_id group by all),
l as (select a, b from p where 100*k >= 75*(na+nb-k)), both_ways as (select a, b from l union all select b, a from l),
r(a, b) as (select a, b from both_ways union select r.a, l.b from r join both_ways l on l.a = r.b),
m as (select a, least(a, min(b)) c from r group by a)
select s.doc_id, len(sh)::bigint n_shingles, coalesce(m.c, s.doc_id) component_id, s.doc_id = coalesce(m.c, s.doc_id) kept from s left join m on m.a = s.doc_id"""

ORACLE_SQL: dict[str, str] = {"op9_neardup": OP9}
