"""Query op2: all ``documents`` without sentences in repeating runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from gleanery.llm.common import table
from gleanery.llm.spans import LEAST_WORDS, drop_repeated_runs


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, text, n_sentences, n_removed of every document."""
    return drop_repeated_runs(table(spark, sf_dir, "documents"), least_words=LEAST_WORDS)


#: Runs are compared by their text, and all shortest runs of a sentence are found by a range join.
SQL = r"""
with cut as (
  select doc_id, text, flatten(list_transform(
    string_split(regexp_replace(coalesce(text, ''), '([.!?][ \t-\r]+|[。！？।][ \t-\r]*|[ \t\x0b-\r]*\n[ \t-\r]*)', '\1' || chr(30), 'g'), chr(30)),
    lambda p: case when len(regexp_extract_all(p, '[^\x20\x09-\x0D]+')) >= 30
      then string_split(regexp_replace(p, '([,;:][ \t-\r]+)', '\1' || chr(30), 'g'), chr(30)) else [p] end)) as ps
  from documents
), piece as (
  select doc_id, k, p, regexp_replace(p, '^[ \t-\r]+|[ \t-\r]+$', '', 'g') as u
  from (select doc_id, unnest(ps) as p, generate_subscripts(ps, 1) as k from cut)
), unit as (
  select doc_id, k, u, row_number() over (partition by doc_id order by k) - 1 as n,
    greatest(len(regexp_extract_all(u, '[^\x20\x09-\x0D]+')), strlen(u) // 12) as w
  from piece where u <> ''
), total as (
  select *, sum(w) over (partition by doc_id order by n) as upto from unit
), span as (
  select a.doc_id, a.n as start, min(b.n) + 1 as stop from total a join total b
    on a.doc_id = b.doc_id and b.n > a.n and b.upto - a.upto + a.w >= {least} group by all
  union
  select b.doc_id, max(a.n), b.n + 1 from total a join total b
    on a.doc_id = b.doc_id and b.n > a.n and b.upto - a.upto + a.w >= {least} group by b.doc_id, b.n
), held as (
  select doc_id, list(u order by n) as us from unit group by doc_id
), run as (
  select s.doc_id, s.start, s.stop,
    row_number() over (partition by array_to_string(us[s.start + 1 : s.stop], chr(31)) order by s.doc_id, s.start) as nth
  from span s join held using (doc_id)
), gone as (
  select distinct u.doc_id, u.k from run r join unit u on u.doc_id = r.doc_id and u.n >= r.start and u.n < r.stop where r.nth > 1
), kept as (
  select p.doc_id, string_agg(p.p, '' order by p.k) filter (g.k is null) as t, count(*) filter (p.u <> '') as n, count(g.k) as m
  from piece p left join gone g on g.doc_id = p.doc_id and g.k = p.k group by p.doc_id
)
select doc_id, case when d.text is null then null when d.text = '' then '' else coalesce(k.t, '') end as text,
  coalesce(k.n, 0)::bigint as n_sentences, coalesce(k.m, 0)::bigint as n_removed
from documents d left join kept k using (doc_id)
"""

QUERIES = {"op2_substring_dedup": op2_substring_dedup}
ORACLES = {"op2_substring_dedup": SQL.format(least=LEAST_WORDS)}
