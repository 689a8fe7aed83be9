"""Query op1: all ``documents`` mixed to targets of 1, 2, 3, repeating, by source."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from gleanery.llm.common import table
from gleanery.llm.mixing import cyclic_weights, mix_sources


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, size, source_size, target, taken of every document."""
    docs = table(spark, sf_dir, "documents")
    mixed = mix_sources(docs, cyclic_weights(docs))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


#: The documents come from {documents}; the pipeline puts its own rows there.
SQL = r"""
with m as (
  select doc_id, source as s,
    coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::bigint as size,
    coalesce(greatest(0.1::double, 1::double - 2::double * length(regexp_replace(text, '[^!-@\[-`{{-~]+', '', 'g'))
      / nullif(length(text), 0)), 0.1::double) as w
  from {documents}
), d as (
  select *, -ln((('0x' || md5('mix:' || coalesce(doc_id::varchar, ''))[:13])::bigint::double + 0.5::double)
    / 4503599627370496::double) / greatest(w, 1e-9::double) as key from m
), totals as (
  select s, sum(size)::double as source_size,
    ((row_number() over (order by s nulls last) - 1) % 3 + 1)::double as weight
  from d group by s
), filled as (
  select *, sum(source_size) over () as total,
    coalesce(sum(3 * source_size) over (order by 3 * source_size / weight, weight, s nulls last
      rows between unbounded preceding and 1 preceding), 0) as used,
    sum(weight) over (order by 3 * source_size / weight, weight, s nulls last
      rows between current row and unbounded following) as rest,
    row_number() over (order by 3 * source_size / weight, weight, s nulls last) as k
  from totals
), lev as (
  select arg_min(l, k) as level from (
    select k, greatest(0, total - used) / rest as l from filled
    where greatest(0, total - used) / rest * weight <= 3 * source_size)
), planned as (
  select s, source_size, round(least(3 * source_size, coalesce(level, 0) * weight), 6) as target
  from totals, lev
), epochs as (
  select *, case when source_size > 0 then floor(target / source_size) else 0 end as epochs from planned
), units as (
  select s, key, doc_id, sum(size)::double as words from d group by all
), run as (
  select *, sum(words) over (partition by s order by key, doc_id rows unbounded preceding) as upto from units
)
select {columns}
from d join epochs e on d.s is not distinct from e.s
join run r on r.s is not distinct from d.s and r.key = d.key and r.doc_id is not distinct from d.doc_id
"""
_COPIES = """(e.epochs + case when 2 * r.upto - r.words <= 2 * (e.target - e.epochs * e.source_size)
  and e.target > e.epochs * e.source_size then 1 else 0 end)"""

QUERIES = {"op1_mix_sources": op1_mix_sources}
ORACLES = {
    "op1_mix_sources": SQL.format(
        documents="documents",
        columns=f"d.doc_id, d.size, e.source_size::bigint as source_size, e.target, ({_COPIES} * d.size)::bigint as taken",
    )
}
