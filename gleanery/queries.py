"""Registered queries of the retrieval engine, with their DuckDB counterparts."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanery import queries_sources
from gleanery.functions import ids, text, wikitext
from gleanery.operators import boolean, codec, evaluation, index, search, sets, vectors
from gleanery.plans import boolean as plans
from gleanery.plans.language import parse
from gleanery.storage import read_table as _table
from gleanery.storage import materialize, shared_dir, spread

SINGLE = "tion shing the erble, and thati."
REPEATED = "erin erin thble of ouing ERIN"
SEGMENT = 300
BOOLEAN = {
    "bool_term": "erble",
    "bool_and": "erble AND shing",
    "bool_or": "erble OR ouing",
    "bool_and_not": "erble AND NOT shing",
    "bool_multi_not": "tion AND NOT erble AND NOT shing",
    "bool_or_of_and": "(erble AND shing) OR ouing",
    "bool_nested": "tion AND ((erble AND NOT shing) OR ouing)",
}
_stored_at: dict[tuple, str] = {}
VECTOR_QUERY = 0  # the vector that knn_l2 takes as its query


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(_table(spark, sf_dir, "documents").select("doc_id", "text"))


def _benchmark(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")


def _query(spark: SparkSession, words: str) -> DataFrame:
    return spark.range(1).select(F.lit(0).alias("query_id"), F.lit(words).alias("text"))


# ---------------------------------------------------------------- analysis and index
def tokenize_terms(spark, sf_dir):
    words = text.normalize_words(F.col("text"))
    return _docs(spark, sf_dir).select("doc_id", F.posexplode(words).alias("pos", "w")).select("doc_id", "pos", "w.word", "w.term")


def stop_word_filter(spark, sf_dir):
    terms = _benchmark(spark, sf_dir).select("query_id", F.explode(text.terms(F.col("text"))).alias("term"))
    return terms.where(text.not_stop_word(F.col("term"))).groupBy("query_id", "term").agg(F.count("*").alias("times"))


def doc_lengths(spark, sf_dir):
    return index.analysed(_docs(spark, sf_dir)).select("doc_id", "doc_len")


def term_postings(spark, sf_dir):
    return index.postings_of(index.analysed(_docs(spark, sf_dir)), ["doc_id"]).select("term", "doc_id", "tf")


def term_dictionary(spark, sf_dir):
    return term_postings(spark, sf_dir).groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("total_tf"))


def corpus_stats(spark, sf_dir):
    found = index.build_index(_docs(spark, sf_dir), None)
    return found.stats.select("indexed_docs", "max_posting_list", F.round("terms_per_doc_avg", 6).alias("terms_per_doc_avg"))


def segment_stats(spark, sf_dir):
    found = index.build_index(_docs(spark, sf_dir), SEGMENT)
    return found.stats.select("segment_id", "indexed_docs", "max_posting_list", F.round("terms_per_doc_avg", 6).alias("terms_per_doc_avg"))


def segment_doc_ids(spark, sf_dir):
    return index.build_index(_docs(spark, sf_dir), SEGMENT).docs


def posting_block_stats(spark, sf_dir):
    return codec.posting_block_stats(index.build_index(_docs(spark, sf_dir), None).postings)


# ---------------------------------------------------------------- search
def search_bm25_single(spark, sf_dir):
    return search.search_documents(_docs(spark, sf_dir), _query(spark, SINGLE)).select("rank", "doc_id", "score")


def search_bm25_repeated_term(spark, sf_dir):
    return search.search_documents(_docs(spark, sf_dir), _query(spark, REPEATED)).select("rank", "doc_id", "score")


def search_tfidf(spark, sf_dir):
    return search.search_documents(_docs(spark, sf_dir), _query(spark, SINGLE), scorer="tfidf").select("rank", "doc_id", "score")


def search_bm25_batch(spark, sf_dir):
    """Every benchmark text as a query."""
    return search.search_documents(_docs(spark, sf_dir), _benchmark(spark, sf_dir))


def search_bm25_per_segment(spark, sf_dir):
    found = index.build_index(_docs(spark, sf_dir), SEGMENT)
    return search.search_index(found, _query(spark, SINGLE), stats="segment").select("rank", "doc_id", "score")


def _stored(spark, sf_dir, max_segment_docs=SEGMENT):
    """An index of the documents, written to the shared folder in two steps (once for an application)
    and opened again."""
    key = (spark.sparkContext.applicationId, sf_dir, max_segment_docs)
    if key not in _stored_at:
        path = f"{shared_dir(spark)}/index-{uuid.uuid4().hex}"
        docs = _docs(spark, sf_dir)
        index.build_index(docs.where("doc_id % 3 <> 0"), max_segment_docs).write(path)
        index.build_index(docs.where("doc_id % 3 = 0"), max_segment_docs).write(path, "append")
        _stored_at[key] = path
    return index.Index.open(spark, _stored_at[key])


def stored_search_single(spark, sf_dir):
    return search.search_index(_stored(spark, sf_dir), _query(spark, SINGLE)).select("rank", "doc_id", "score")


def stored_search_batch(spark, sf_dir):
    return search.search_index(_stored(spark, sf_dir), _benchmark(spark, sf_dir))


def stored_search_tfidf(spark, sf_dir):
    return search.search_index(_stored(spark, sf_dir), _query(spark, SINGLE), scorer="tfidf").select("rank", "doc_id", "score")


def stored_bool_nested(spark, sf_dir):
    return boolean.boolean_search(_stored(spark, sf_dir), BOOLEAN["bool_nested"])


def stored_postings(spark, sf_dir):
    """The posting lists of two terms, with the documents that they stand for."""
    found = _stored(spark, sf_dir)
    return found.postings_for("erble", "shing").join(found.docs, ["segment_id", "seg_doc_id", "doc_len"]).select("term", "doc_id", "doc_len", "tf")


def _boolean(query):
    return lambda spark, sf_dir: boolean.boolean_search(_docs(spark, sf_dir), query)


def collect_count(spark, sf_dir):
    return boolean.collect_count(boolean.boolean_search(_docs(spark, sf_dir), BOOLEAN["bool_or_of_and"], scored=False))


def collect_top(spark, sf_dir):
    return boolean.collect_top(boolean.boolean_search(_docs(spark, sf_dir), BOOLEAN["bool_or_of_and"]), 20)


def collect_top_segments(spark, sf_dir):
    found = index.build_index(_docs(spark, sf_dir), SEGMENT)
    return boolean.collect_top_segments(boolean.boolean_search(found, BOOLEAN["bool_or_of_and"], with_places=True), 5)


def _scored(spark, sf_dir, term):
    return boolean.boolean_search(_docs(spark, sf_dir), term)


def set_intersect(spark, sf_dir):
    return _rounded(sets.intersect(*(_scored(spark, sf_dir, t) for t in ("erble", "tion"))))


def set_union(spark, sf_dir):
    return _rounded(sets.union(*(_scored(spark, sf_dir, t) for t in ("erble", "ouing", "shing"))))


def set_exclude(spark, sf_dir):
    return _rounded(sets.exclude(*(_scored(spark, sf_dir, t) for t in ("tion", "erble", "shing"))))


def set_seek(spark, sf_dir):
    return _rounded(sets.seek(_scored(spark, sf_dir, "tion"), 100))


def _rounded(found):
    return found.select("doc_id", F.round("score", 6).alias("score"))


# ---------------------------------------------------------------- evaluation
JUDGED_TERMS = 6


def _qrels(spark, sf_dir):
    """Judgments: documents that hold the first terms of a benchmark text in a row, of relevance 1 or
    2 by the last bit of the id. The runs of terms, which one expression finds in a document's line
    of them, are compared by an equi-join. An outer explode, since for an inner one the planner adds a
    filter that works the array out once more."""
    n = JUDGED_TERMS
    line = F.array_join(text.terms(F.col("text")), " ")
    runs = _docs(spark, sf_dir).select("doc_id", F.explode_outer(F.regexp_extract_all(line, F.lit(rf"(?=(\S++(?: \S++){{{n - 1}}}))\S++"), F.lit(1))).alias("run"))
    items = _benchmark(spark, sf_dir).select("query_id", text.terms(F.col("text")).alias("t")).where(F.size("t") >= n)
    heads = items.select("query_id", F.array_join(F.slice("t", 1, n), " ").alias("run"))
    return runs.join(heads, "run").select("query_id", "doc_id", (1.0 + F.col("doc_id") % 2).alias("relevance")).distinct()


def qrels_filter(spark, sf_dir):
    return _qrels(spark, sf_dir).where("relevance > 1")


def _quality(spark, sf_dir, scheme="burges"):
    judged = materialize(_qrels(spark, sf_dir), "qrels")  # used twice
    return evaluation.query_quality(search_bm25_batch(spark, sf_dir), judged, _benchmark(spark, sf_dir), scheme=scheme)


def precision_recall(spark, sf_dir):
    q = _quality(spark, sf_dir)
    return q.select("query_id", "found", "relevant", "hits", F.round("precision", 6).alias("precision"), F.round("recall", 6).alias("recall"))


def ndcg_at_10(spark, sf_dir):
    return _quality(spark, sf_dir).select("query_id", F.round("ndcg", 6).alias("ndcg"))


def ndcg_jarvelin(spark, sf_dir):
    return _quality(spark, sf_dir, "jarvelin").select("query_id", F.round("ndcg", 6).alias("ndcg"))


def eval_summary(spark, sf_dir):
    s = evaluation.summary(_quality(spark, sf_dir))
    return s.select("queries", *(F.round(c, 6).alias(c) for c in s.columns[1:]))


def ranked_overlap(spark, sf_dir):
    """How alike BM25 and TF-IDF rank the benchmark texts."""
    scores = search.score_documents(_docs(spark, sf_dir), _benchmark(spark, sf_dir), search.SCORERS)
    ranked = []
    for scorer in search.SCORERS:
        top = search.rank(scores.withColumnRenamed(scorer, "score"), 10)
        in_order = F.transform(F.sort_array(F.collect_list(F.struct("rank", "doc_id"))), lambda x: x["doc_id"])
        ranked.append(top.groupBy("query_id").agg(in_order.alias(scorer)))
    both = ranked[0].join(ranked[1], "query_id")
    return both.select("query_id", F.round(evaluation.ranked_overlap(F.col("bm25"), F.col("tfidf")), 6).alias("overlap"))


# ---------------------------------------------------------------- vectors
def knn_l2(spark, sf_dir):
    table = _table(spark, sf_dir, "embeddings")
    query = table.where(F.col("vec_id") == VECTOR_QUERY).select("embedding").first()
    return vectors.nearest(table, query.embedding)


def knn_batch(spark, sf_dir):
    """The ten nearest of every vector whose id is divisible by 20."""
    table = _table(spark, sf_dir, "embeddings")
    return vectors.nearest_batch(table, table.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding"))


# ---------------------------------------------------------------- without SQL counterparts
def explain_tree(spark, sf_dir):
    rows = [(n, str(plans.explain(plans.plan(parse(q))))) for n, q in BOOLEAN.items()]
    return spark.createDataFrame(rows, "name string, plan string")


def parse_id(spark, sf_dir):
    """Ids of pages by the numbers in their addresses, else by hash."""
    tail = F.regexp_extract("url", r"([^/?#]*)(?:[?#].*)?$", 1)
    return _table(spark, sf_dir, "pages").select("page_id", tail.alias("tail"), ids.parse_id_column(tail).alias("id"))


def wikitext_strip(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", wikitext.strip_wikitext_column(F.col("text")).alias("text"))


def codec_round_trip(spark, sf_dir):
    """Every posting list encoded and decoded again; the postings must be those of term_postings."""
    postings = index.build_index(_docs(spark, sf_dir), None).postings
    return codec.decode_lists(codec.encode_lists(postings)).select("term", "seg_doc_id", "tf")


QUERIES = {
    f.__name__: f
    for f in (
        search_bm25_batch, tokenize_terms, stop_word_filter, doc_lengths, term_postings, term_dictionary, corpus_stats, segment_stats,
        segment_doc_ids, posting_block_stats, search_bm25_single, search_bm25_repeated_term, search_tfidf, search_bm25_per_segment,
        stored_search_single, stored_search_batch, stored_search_tfidf, stored_bool_nested, stored_postings,
        collect_count, collect_top, collect_top_segments, set_intersect, set_union, set_exclude, set_seek, qrels_filter, precision_recall, ndcg_at_10, ndcg_jarvelin, eval_summary, ranked_overlap, knn_l2,
        knn_batch, explain_tree, parse_id, wikitext_strip, codec_round_trip,
    )
} | {name: _boolean(query) for name, query in BOOLEAN.items()} | queries_sources.QUERIES


# ---------------------------------------------------------------- the same in SQL
_STOP = ", ".join(f"'{w}'" for w in sorted(text.STOP_WORDS))
_TERM = r"lower(regexp_replace(w, '[^\p{L}]', '', 'g'))"


def _with(*parts: str) -> str:
    return "with " + ",\n".join(parts) + "\n"


_TOK = rf"""words as (select doc_id, unnest(string_split_regex(text, '\s+')) as w from documents),
tok as (select doc_id, term from (select doc_id, {_TERM} as term from words) where term <> ''),
dl as (select d.doc_id, count(t.term)::int as doc_len from documents d left join tok t using (doc_id) group by d.doc_id),
post as (select term, doc_id, count(*)::int as tf from tok group by all),
dict as (select term, count(*)::bigint as df from post group by term),
tot as (select count(*)::double as n, avg(doc_len)::double as avgdl from dl)"""
_BM25 = """(tf::double * 2.2::double) / (tf::double + 1.2::double * (0.25::double + 0.75::double * doc_len::double / avgdl))
  * ln(1::double + (n - df::double + 0.5::double) / (df::double + 0.5::double))"""
_TFIDF = "tf::double / doc_len::double * ln(n / df::double)"


def _asked(source: str) -> str:
    return rf"""asked as (select query_id, term, count(*) as times from (
  select query_id, {_TERM} as term from (select query_id, unnest(string_split_regex(text, '\s+')) as w from ({source})))
  where term <> '' and term not in ({_STOP}) group by all)"""


_ITEMS = "select item_id as query_id, text from benchmark"


def _ranked(score: str, name: str = "ranked", limit: int = 10) -> str:
    return f"""{name}_sum as (select query_id, doc_id, round(sum(times * ({score})), 6) as score
  from asked join post using (term) join dict using (term) join dl using (doc_id) cross join tot group by all),
{name} as (select * from (select *, row_number() over (partition by query_id order by score desc, doc_id)::int as rank from {name}_sum) where rank <= {limit})"""


def _one(words: str) -> str:
    return _asked(f"select 0 as query_id, '{words}' as text")


_SEG = f"""numbered as (select doc_id, ((row_number() over (order by doc_id) - 1) // {SEGMENT})::int as segment_id,
  ((row_number() over (order by doc_id) - 1) % {SEGMENT})::int as seg_doc_id from documents),
sdocs as (select segment_id, seg_doc_id, doc_id, doc_len from numbered join dl using (doc_id)),
spost as (select segment_id, seg_doc_id, doc_id, term, tf from post join numbered using (doc_id)),
sdict as (select segment_id, term, count(*)::bigint as df from spost group by all),
sstat as (select segment_id, count(*)::bigint as indexed_docs, sum(doc_len)::double / count(*) as avgdl from sdocs group by all)"""

_QREL = f"""seq as (select doc_id, ' ' || string_agg(term, ' ' order by p) || ' ' as line from (
  select doc_id, {_TERM} as term, p from (select doc_id, unnest(string_split_regex(text, '\\s+')) as w, generate_subscripts(string_split_regex(text, '\\s+'), 1) as p from documents))
  where term <> '' group by doc_id),
heads as (select query_id, ' ' || array_to_string(t[1:{JUDGED_TERMS}], ' ') || ' ' as head from (
  select query_id, list(term order by p) as t from (
    select query_id, {_TERM} as term, p from (select query_id, unnest(string_split_regex(text, '\\s+')) as w, generate_subscripts(string_split_regex(text, '\\s+'), 1) as p from ({_ITEMS})))
  where term <> '' group by query_id) where len(t) >= {JUDGED_TERMS}),
qrels as (select query_id, doc_id, (1 + doc_id % 2)::double as relevance from seq, heads where contains(line, head))"""


def _quality_sql(gain: str) -> str:
    return f"""got as (select r.query_id, count(*) as found, count(q.relevance) as hits,
    sum(case when q.relevance is null then 0 else {gain.format(r='q.relevance')} end / log2(rank + 1)) as dcg
  from ranked r left join qrels q using (query_id, doc_id) group by all),
ideal as (select query_id, count(*) as relevant, sum(case when k <= 10 then {gain.format(r='relevance')} / log2(k + 1) end) as ideal
  from (select *, row_number() over (partition by query_id order by relevance desc) as k from qrels) group by all),
quality as (select query_id, coalesce(found, 0)::bigint as found, coalesce(relevant, 0)::bigint as relevant, coalesce(hits, 0)::bigint as hits,
    case when coalesce(found, 0) = 0 then case when relevant is null then 1 else 0 end else hits / found end::double as precision,
    case when relevant is null then 1 else coalesce(hits, 0) / relevant end::double as recall,
    case when relevant is null then case when coalesce(found, 0) = 0 then 1 else 0 end else coalesce(dcg, 0) / ideal end::double as ndcg
  from ({_ITEMS}) left join got using (query_id) left join ideal using (query_id))"""


_BURGES, _JARVELIN = "(pow(2, {r}) - 1)", "{r}"
_EVAL = _with(_TOK, _asked(_ITEMS), _ranked(_BM25), _QREL, _quality_sql(_BURGES))


def _leaf(name: str, term: str) -> str:
    return f"{name} as (select doc_id, {_BM25} as s from post join dict using (term) join dl using (doc_id) cross join tot where term = '{term}')"


_LEAVES = _with(_TOK, _leaf("erble", "erble"), _leaf("shing", "shing"), _leaf("ouing", "ouing"), _leaf("tion", "tion"))
_OR_OF_AND = """(select doc_id, sum(s) as s from (select a.doc_id, a.s + b.s as s from erble a join shing b using (doc_id)
  union all select * from ouing) group by doc_id)"""
_NESTED = """(select t.doc_id, t.s + u.s as s from tion t join (select doc_id, sum(s) as s from (
  select * from erble where doc_id not in (select doc_id from shing) union all select * from ouing) group by doc_id) u using (doc_id))"""
_OUT = "select doc_id, round(s, 6) as score from "

_PLANS = {
    "bool_term": "Term (term = erble)\n",
    "bool_and": "Intersection\n├── Term (term = erble)\n└── Term (term = shing)\n",
    "bool_or": "Union\n├── Term (term = erble)\n└── Term (term = ouing)\n",
    "bool_and_not": "Exclusion\n├── include = Term (term = erble)\n└── exclude = Term (term = shing)\n",
    "bool_multi_not": "Exclusion\n├── include = Term (term = tion)\n└── exclude = Union\n    ├── Term (term = erble)\n    └── Term (term = shing)\n",
    "bool_or_of_and": "Union\n├── Intersection\n│   ├── Term (term = erble)\n│   └── Term (term = shing)\n└── Term (term = ouing)\n",
    "bool_nested": "Intersection\n├── Term (term = tion)\n└── Union\n    ├── Exclusion\n    │   ├── include = Term (term = erble)\n"
    "    │   └── exclude = Term (term = shing)\n    └── Term (term = ouing)\n",
}

ORACLES = queries_sources.ORACLES | {
    "explain_tree": "select * from (values " + ", ".join(f"('{name}', '{plan}')" for name, plan in _PLANS.items()) + ") as t(name, plan)",
    "tokenize_terms": rf"""select doc_id, (row_number() over (partition by doc_id order by p) - 1)::int as pos, w as word, {_TERM} as term from (
      select doc_id, unnest(string_split_regex(text, '\s+')) as w, generate_subscripts(string_split_regex(text, '\s+'), 1) as p from documents) where w <> ''""",
    "stop_word_filter": _with(_asked(_ITEMS)) + "select query_id, term, times from asked",
    "doc_lengths": _with(_TOK) + "select doc_id, doc_len from dl",
    "term_postings": _with(_TOK) + "select term, doc_id, tf from post",
    "term_dictionary": _with(_TOK) + "select term, count(*) as df, sum(tf)::bigint as total_tf from post group by term",
    "corpus_stats": _with(_TOK) + "select (select count(*) from dl) as indexed_docs, (select max(df) from dict) as max_posting_list, (select round(avgdl, 6) from tot) as terms_per_doc_avg",
    "segment_stats": _with(_TOK, _SEG)
    + "select segment_id, indexed_docs, (select max(df) from sdict d where d.segment_id = s.segment_id) as max_posting_list, round(avgdl, 6) as terms_per_doc_avg from sstat s",
    "segment_doc_ids": _with(_TOK, _SEG) + "select segment_id, seg_doc_id, doc_id, doc_len from sdocs",
    "posting_block_stats": _with(_TOK)
    + f"""select 0 as segment_id, term, count(*) as blocks, sum(k)::bigint as postings, max(dw)::bigint as doc_bits, max(tw)::bigint as tf_bits,
      sum(5 + (dw * (k - 1) + 7) // 8 + 1 + (tw * k + 7) // 8)::bigint as bytes from (
        select term, block, count(*) as k, greatest(1, length(ltrim(bin(coalesce(max(gap), 0)), '0'))) as dw, greatest(1, length(ltrim(bin(max(tf)), '0'))) as tw from (
          select *, doc - lag(doc) over (partition by term, block order by doc) as gap from (
            select term, tf, doc, (row_number() over (partition by term order by doc) - 1) // {codec.BLOCK} as block
            from post join (select doc_id, row_number() over (order by doc_id) - 1 as doc from documents) using (doc_id)))
        group by term, block) group by term""",
    "codec_round_trip": _with(_TOK)
    + "select term, doc::int as seg_doc_id, tf from post join (select doc_id, row_number() over (order by doc_id) - 1 as doc from documents) using (doc_id)",
    "search_bm25_single": _with(_TOK, _one(SINGLE), _ranked(_BM25)) + "select rank, doc_id, score from ranked",
    "search_bm25_repeated_term": _with(_TOK, _one(REPEATED), _ranked(_BM25)) + "select rank, doc_id, score from ranked",
    "search_tfidf": _with(_TOK, _one(SINGLE), _ranked(_TFIDF)) + "select rank, doc_id, score from ranked",
    "search_bm25_batch": _with(_TOK, _asked(_ITEMS), _ranked(_BM25)) + "select query_id, rank, doc_id, score from ranked",
    "stored_search_single": _with(_TOK, _one(SINGLE), _ranked(_BM25)) + "select rank, doc_id, score from ranked",
    "stored_search_batch": _with(_TOK, _asked(_ITEMS), _ranked(_BM25)) + "select query_id, rank, doc_id, score from ranked",
    "stored_search_tfidf": _with(_TOK, _one(SINGLE), _ranked(_TFIDF)) + "select rank, doc_id, score from ranked",
    "stored_bool_nested": _LEAVES + _OUT + _NESTED,
    "stored_postings": _with(_TOK) + "select term, doc_id, doc_len, tf from post join dl using (doc_id) where term in ('erble', 'shing')",
    "search_bm25_per_segment": _with(_TOK, _SEG, _one(SINGLE))
    + f"""select rank, doc_id, score from (select *, row_number() over (order by score desc, doc_id)::int as rank from (
      select doc_id, round(sum(times * ({_BM25})), 6) as score from (
        select p.doc_id, times, tf, doc_len, df, indexed_docs::double as n, avgdl from asked join spost p using (term)
        join sdict d on d.segment_id = p.segment_id and d.term = p.term join sstat s on s.segment_id = p.segment_id join dl on dl.doc_id = p.doc_id)
      group by doc_id)) where rank <= 10""",
    "bool_term": _LEAVES + _OUT + "erble",
    "bool_and": _LEAVES + _OUT + "(select a.doc_id, a.s + b.s as s from erble a join shing b using (doc_id))",
    "bool_or": _LEAVES + _OUT + "(select doc_id, sum(s) as s from (select * from erble union all select * from ouing) group by doc_id)",
    "bool_and_not": _LEAVES + _OUT + "erble where doc_id not in (select doc_id from shing)",
    "bool_multi_not": _LEAVES + _OUT + "tion where doc_id not in (select doc_id from erble union select doc_id from shing)",
    "bool_or_of_and": _LEAVES + _OUT + _OR_OF_AND,
    "bool_nested": _LEAVES + _OUT + _NESTED,
    "collect_count": _LEAVES + f"select count(*) as matches from {_OR_OF_AND}",
    "collect_top": _LEAVES + _OUT + _OR_OF_AND + " order by score desc, doc_id limit 20",
    "collect_top_segments": _LEAVES
    + f""", numbered as (select doc_id, ((row_number() over (order by doc_id) - 1) // {SEGMENT})::int as segment_id from documents)
    select doc_id, score from (select *, row_number() over (partition by segment_id order by score desc, doc_id) as k
      from (select doc_id, round(s, 6) as score from {_OR_OF_AND}) join numbered using (doc_id)) where k <= 5 order by score desc, doc_id limit 5""",
    "set_intersect": _LEAVES + _OUT + "(select a.doc_id, round(a.s, 6) + round(b.s, 6) as s from erble a join tion b using (doc_id))",
    "set_union": _LEAVES + _OUT + "(select doc_id, sum(round(s, 6)) as s from (select * from erble union all select * from ouing union all select * from shing) group by doc_id)",
    "set_exclude": _LEAVES + _OUT + "(select doc_id, round(s, 6) as s from tion where doc_id not in (select doc_id from erble) and doc_id not in (select doc_id from shing))",
    "set_seek": _LEAVES + _OUT + "(select doc_id, round(s, 6) as s from tion where doc_id >= 100)",
    "qrels_filter": _with(_QREL) + "select query_id, doc_id, relevance from qrels where relevance > 1",
    "precision_recall": _EVAL + "select query_id, found, relevant, hits, round(precision, 6) as precision, round(recall, 6) as recall from quality",
    "ndcg_at_10": _EVAL + "select query_id, round(ndcg, 6) as ndcg from quality",
    "ndcg_jarvelin": _with(_TOK, _asked(_ITEMS), _ranked(_BM25), _QREL, _quality_sql(_JARVELIN)) + "select query_id, round(ndcg, 6) as ndcg from quality",
    "eval_summary": _EVAL
    + "select count(*) as queries, "
    + ", ".join(f"round(avg({c}), 6) as {c}_avg" for c in ("precision", "recall", "ndcg"))
    + ", "
    + ", ".join(f"round(quantile_cont({c}, {p / 100}), 6) as {c}_p{p}" for c in ("precision", "recall") for p in (50, 90, 100))
    + " from quality",
    "ranked_overlap": _with(_TOK, _asked(_ITEMS), _ranked(_BM25, "r1"), _ranked(_TFIDF, "r2"))
    + """, lists as (select query_id, l1, l2, greatest(len(l1), len(l2)) as m from (select query_id, list(doc_id order by rank) as l1 from r1 group by query_id)
      join (select query_id, list(doc_id order by rank) as l2 from r2 group by query_id) using (query_id))
    select query_id, round(sum(len(list_intersect(l1[1:k], l2[1:k])) / k) / any_value(m), 6) as overlap from (
      select *, unnest(generate_series(1, m)) as k from lists) group by query_id""",
    "knn_l2": f"""select vec_id, round(list_distance(embedding::double[], (select embedding::double[] from embeddings where vec_id = {VECTOR_QUERY})), 6) as distance
      from embeddings order by distance, vec_id limit 10""",
    "knn_batch": """select query_id, rank, vec_id, distance from (
      select *, row_number() over (partition by query_id order by distance, vec_id)::int as rank from (
        select q.vec_id as query_id, e.vec_id, round(list_distance(q.embedding::double[], e.embedding::double[]), 6) as distance
        from embeddings q, embeddings e where q.vec_id % 20 = 0)) where rank <= 10""",
}
