"""DuckDB SQL of the catalogue's queries, written from the definitions and not from the plans."""

from __future__ import annotations

WORKLOAD = (
    (1, "q1", "the and of"),
    (2, "q2", "in en"),
    (3, "q3", "the zzzzmissing"),
    (4, "q4", "the"),
    (5, "q5", "zzzzmissing yyyymissing"),
    (6, "q6", "that The was is"),
    (7, "q6", "of of the of"),
    (8, "q8", ""),
)
GAPS = "1, 2, 3, 5, 31, 32, 33, 127, 128, 129, 4096, 16383, 16384, 2097151, 2097152, 268435455, 268435456, 1000000000, 4294967295"
FREQS = "1, 2, 3, 4, 5, 130, 131, 200, 16386, 16387"

_WORDS = r"'[^ \t\n\x0B\f\r]+'"


def _tokens(table: str = "documents", docid: str = "doc_id + 1", text: str = "text", name: str = "tok") -> str:
    return f"""{name} AS (SELECT docid, unnest(w) AS term, generate_subscripts(w, 1)::BIGINT AS position
  FROM (SELECT {docid} AS docid, regexp_extract_all(coalesce({text}, ''), {_WORDS}) AS w FROM {table}))"""


TOK = _tokens()
PO = f"{TOK}, po AS (SELECT term, docid, count(*) AS tf FROM tok GROUP BY term, docid)"
LX = f"{PO}, lx AS (SELECT term, count(*) AS df, sum(tf)::BIGINT AS cf, max(docid) AS last_docid FROM po GROUP BY term)"


def _queries(benchmark: bool = False) -> str:
    rows = ", ".join(f"({o}::BIGINT, '{i}', '{t}')" for o, i, t in WORKLOAD)
    source = "(SELECT item_id AS query_ord, item_id::VARCHAR AS qid, text FROM benchmark)" if benchmark else f"(VALUES {rows}) v(query_ord, qid, text)"
    return f"qt AS (SELECT DISTINCT query_ord, qid, unnest(regexp_extract_all(text, {_WORDS})) AS term FROM {source})"


def _hits(benchmark: bool = False) -> str:
    return f"""WITH {LX}, {_queries(benchmark)},
kn AS (SELECT query_ord, qid, term, df, count(*) OVER (PARTITION BY query_ord) AS n_found FROM qt JOIN lx USING (term)),
hit AS (SELECT query_ord, qid, term, df, n_found, docid, tf FROM kn JOIN po USING (term)),
n AS (SELECT count(*) AS n FROM documents),
ands AS (SELECT query_ord, qid, docid FROM hit GROUP BY query_ord, qid, docid, n_found HAVING count(*) = n_found),
ors AS (SELECT DISTINCT query_ord, qid, docid FROM hit)"""


def _scores(n: str = "(SELECT n FROM n)", benchmark: bool = False) -> str:
    return f"""{_hits(benchmark)},
sc AS (SELECT * FROM (SELECT query_ord, qid, docid, round(sum(ln(1 + tf::DOUBLE) * ln(1 + {n}::DOUBLE / df::DOUBLE)), 6) AS score
  FROM hit GROUP BY query_ord, qid, docid) WHERE score > 0),
rk AS (SELECT *, row_number() OVER (PARTITION BY query_ord ORDER BY score DESC, docid) - 1 AS rank FROM sc)"""


def _top(k: int, **options) -> str:
    return f"{_scores(**options)} SELECT query_ord, qid, rank::BIGINT AS rank, docid, score FROM rk WHERE rank < {k}"


def _stats(tokens: str, table: str) -> str:
    return f"""WITH {tokens}, p AS (SELECT docid, term FROM tok GROUP BY docid, term),
d AS (SELECT (SELECT count(*) FROM {table}) AS n_docs, (SELECT count(*) FROM tok) AS n_words, (SELECT count(*) FROM p) AS n_postings,
  (SELECT count(DISTINCT term) FROM tok) AS vocabulary)
SELECT *, n_postings // n_docs AS mean_postings FROM d"""


def _pairs(columns: str) -> str:
    return f"num AS (SELECT {columns} FROM (SELECT unnest([{GAPS}])::BIGINT AS gap) a, (SELECT unnest([{FREQS}])::BIGINT AS tf) b)"


def _size(x: str) -> str:
    return f"(CASE WHEN {x} < 128 THEN 1 WHEN {x} < 16384 THEN 2 WHEN {x} < 2097152 THEN 3 WHEN {x} < 268435456 THEN 4 ELSE 5 END)"


def _posting_size(gap: str, tf: str) -> str:
    return f"(CASE WHEN {tf} < 4 THEN {_size(f'(({gap} - 1) * 4 + {tf})')} ELSE {_size(f'({gap} * 4)')} + {_size(f'({tf} - 3)')} END)"


def _vbyte(x: str) -> str:
    """Hexadecimal digits of the code: five bytes at most, each present if the value reaches it."""
    part = lambda k: f"CASE WHEN {_size(x)} > {k} THEN lpad(lower(to_hex((({x}) >> {7 * k}) % 128 + CASE WHEN {_size(x)} > {k + 1} THEN 128 ELSE 0 END)), 2, '0') ELSE '' END"
    return "(" + " || ".join(part(k) for k in range(5)) + ")"


_SLABS = """sl AS (
  SELECT 0::BIGINT AS i, 1::BIGINT AS blocks, 60.0::DOUBLE AS cum
  UNION ALL
  SELECT i + 1, CASE WHEN s * 64 >= 65535 THEN blocks ELSE s END, cum + s * 64 - 4
  FROM (SELECT i, blocks, cum, floor((4 + {wish}) / 64 + 0.9999)::BIGINT AS s FROM sl WHERE i < 255))"""
_WISH = {"triangle": "sqrt(8.0::DOUBLE * cum)", "expon": "(1.1::DOUBLE - 1) * cum", "fixed": "0.0::DOUBLE"}


def _layout(growth: str) -> str:
    head = 18 if growth == "fixed" else 20
    need = _posting_size("(n.docid - f.docid)", "n.tf")
    linked = _posting_size("(n.docid - f.first)", "n.tf")
    opens = f"f.at + {need} > 64 * (SELECT blocks FROM sl WHERE sl.i = f.g)"
    return f"""WITH RECURSIVE {PO}, {_SLABS.format(wish=_WISH[growth])},
o AS MATERIALIZED (SELECT term, docid, tf, strlen(term) AS size, row_number() OVER (PARTITION BY term ORDER BY docid) AS rn FROM po),
f AS (
  SELECT term, 0::BIGINT AS rn, 0::BIGINT AS docid, {head} + size AS at, 0::BIGINT AS g, 0::BIGINT AS first,
         0::BIGINT AS payload, 1::BIGINT AS slabs, 1::BIGINT AS blocks
  FROM o WHERE rn = 1
  UNION ALL
  SELECT n.term, n.rn, n.docid,
         CASE WHEN {opens} THEN 4 + {linked} ELSE f.at + {need} END,
         CASE WHEN {opens} THEN least(f.g + 1, 255) ELSE f.g END,
         CASE WHEN {opens} THEN n.docid ELSE f.first END,
         f.payload + CASE WHEN {opens} THEN {linked} ELSE {need} END,
         f.slabs + CASE WHEN {opens} THEN 1 ELSE 0 END,
         f.blocks + CASE WHEN {opens} THEN (SELECT blocks FROM sl WHERE sl.i = least(f.g + 1, 255)) ELSE 0 END
  FROM f JOIN o n ON n.term = f.term AND n.rn = f.rn + 1),
lay AS (SELECT term, max(rn)::BIGINT AS df, max(slabs) AS slabs, max(blocks) AS blocks, max(payload) AS payload FROM f GROUP BY term)"""


_CHAIN = " INTERSECT ".join(f"SELECT docid FROM po WHERE term = '{t}'" for t in ("the", "and", "of"))
_TARGETS = "(VALUES ('the', 1), ('the', 100), ('the', 1000000000), ('of', 500), ('in', 999), ('zzzzmissing', 1)) t(term, target)"
_LISTS = "SELECT term, 0::BIGINT AS k, count(*) AS value FROM po GROUP BY term UNION ALL SELECT term, row_number() OVER (PARTITION BY term ORDER BY docid) AS k, {value} AS value FROM po"
_GAPS = f"WITH {TOK} SELECT term, docid, position, (position - coalesce(lag(position) OVER (PARTITION BY term, docid ORDER BY position), 0))::BIGINT AS wgap"

ORACLES: dict[str, str] = {
    "tokens": f"WITH {TOK} SELECT docid, position, term FROM tok",
    "postings": f"WITH {PO} SELECT * FROM po",
    "positional_postings": f"WITH {TOK} SELECT term, docid, string_agg(position::VARCHAR, ' ' ORDER BY position) AS positions FROM tok GROUP BY term, docid",
    "lexicon": f"WITH {LX} SELECT * FROM lx",
    "doc_stats": f"SELECT doc_id + 1 AS docid, len(w)::BIGINT AS length, len(list_distinct(w))::BIGINT AS n_postings FROM (SELECT doc_id, regexp_extract_all(coalesce(text, ''), {_WORDS}) AS w FROM documents)",
    "collection_stats": _stats(TOK, "documents"),
    "pages_collection_stats": _stats(_tokens("pages", "page_id", "html"), "pages"),
    "conversation_lexicon": f"WITH {_tokens('conversations', 'conv_id * 100000 + turn')}, po AS (SELECT term, docid, count(*) AS tf FROM tok GROUP BY term, docid) SELECT term, count(*) AS df, sum(tf)::BIGINT AS cf, max(docid) AS last_docid FROM po GROUP BY term",
    "doc_term_frequency": f"WITH {PO} SELECT d.docid, t.term, coalesce(po.tf, 0) AS tf FROM (SELECT doc_id + 1 AS docid FROM documents) d CROSS JOIN (VALUES ('the'), ('of'), ('in'), ('que'), ('zzzzmissing')) t(term) LEFT JOIN po ON po.docid = d.docid AND po.term = t.term",
    "term_scan": f"WITH {PO} SELECT * FROM po WHERE term = 'the'",
    "point_lookup": f"WITH {PO} SELECT * FROM po WHERE term IN ('the', 'of', 'in', 'que', 'zzzzmissing')",
    "point_and": f"WITH {PO} {_CHAIN}",
    "next_geq": f"WITH {PO} SELECT t.term, t.target::BIGINT AS target, coalesce(min(po.docid), -1) AS docid, coalesce(arg_min(po.tf, po.docid), 0) AS tf FROM {_TARGETS} LEFT JOIN po ON po.term = t.term AND po.docid >= t.target GROUP BY 1, 2",
    "next_geq_documents": f"""WITH {PO}, w AS (SELECT doc_id + 1 AS docid, regexp_extract_all(coalesce(text, ''), {_WORDS}) AS w FROM documents),
t AS (SELECT w[1] AS term, docid + 1 AS target FROM w WHERE len(w) > 0 UNION ALL SELECT w[-1], docid + 100 FROM w WHERE len(w) > 0)
SELECT t.term, t.target, coalesce(po.docid, -1) AS docid, coalesce(po.tf, 0) AS tf FROM t ASOF LEFT JOIN po ON t.term = po.term AND t.target <= po.docid""",
    "query_terms": f"WITH {_queries()} SELECT * FROM qt",
    "query_stats": f"WITH {_queries()} SELECT {len(WORKLOAD)}::BIGINT AS n_queries, count(*)::DOUBLE / {len(WORKLOAD)} AS mean_terms FROM qt",
    "resolved_terms": f"{_hits()} SELECT query_ord, qid, term, df FROM kn",
    "unknown_terms": f"WITH {LX}, {_queries()} SELECT * FROM qt WHERE term NOT IN (SELECT term FROM lx)",
    "and_count": f"{_hits()} SELECT query_ord, qid, count(*) AS matches FROM ands GROUP BY query_ord, qid",
    "and_docs": f"{_hits()} SELECT * FROM ands",
    "and_semi_chain": f"WITH {PO} {_CHAIN}",
    "or_count": f"{_hits()} SELECT query_ord, qid, count(*) AS matches FROM ors GROUP BY query_ord, qid",
    "or_docs": f"{_hits()} SELECT * FROM ors",
    "and_profile": f"""{_hits()},
o AS (SELECT query_ord, qid, term, df, row_number() OVER (PARTITION BY query_ord ORDER BY df, term) - 1 AS i FROM kn)
SELECT a.query_ord, a.qid, a.i::BIGINT AS i, a.term, a.df,
  CASE WHEN a.i = 0 THEN a.df ELSE (SELECT count(*) FROM (SELECT p.docid FROM o b JOIN po p ON p.term = b.term
    WHERE b.query_ord = a.query_ord AND b.i < a.i GROUP BY p.docid HAVING count(*) = a.i)) END AS next_geq_count
FROM o a""",
    "ranked_topk": _top(10),
    "ranked_topk_n_override": _top(5, n="123456"),
    "ranked_returned_count": f"{_scores()} SELECT query_ord, qid, least(count(*), 600) AS returned FROM sc GROUP BY query_ord, qid",
    "ranked_zero_n": _top(10, n="0"),
    "ranked_threshold": f"{_scores()} SELECT query_ord, CASE WHEN count(*) >= 10 THEN min(score) ELSE 0.0 END AS threshold FROM rk WHERE rank < 10 GROUP BY query_ord",
    "trec_run": f"{_scores()} SELECT query_ord, rank::BIGINT AS rank, qid || ' Q0 ' || docid || ' ' || rank || ' ' || format('{{:.6f}}', score) || ' loomdex' AS line FROM rk WHERE rank < 10",
    "match_stats": f"{_hits()}, c AS (SELECT count(*) AS m FROM ands GROUP BY query_ord) SELECT count(*) AS n, sum(m)::DOUBLE / count(*) AS mean, min(m) AS min, list_sort(list(m))[(50 * count(*)) // 100 + 1] AS p50, max(m) AS max FROM c",
    "floor_percentiles": f"{_hits(True)}, c AS (SELECT count(*) AS m FROM ors GROUP BY query_ord) SELECT " + ", ".join(f"list_sort(list(m))[({p} * count(*)) // 100 + 1] AS p{p}" for p in (50, 90, 95, 99)) + " FROM c",
    "gap_percentiles": f"WITH {PO}, g AS (SELECT docid - coalesce(lag(docid) OVER (PARTITION BY term ORDER BY docid), 0) AS g FROM po), l AS (SELECT list_sort(list(g)) AS l, count(*) AS n FROM g) SELECT n, l[1] AS min, " + ", ".join(f"l[({p} * n) // 100 + 1] AS p{p}" for p in (50, 90, 95, 99)) + ", l[n] AS max FROM l",
    "benchmark_as_queries_and": f"{_hits(True)} SELECT query_ord, qid, count(*) AS matches FROM ands GROUP BY query_ord, qid",
    "benchmark_as_queries_ranked": _top(10, benchmark=True),
    "segment_bounds": f"WITH {PO} SELECT (docid - 1) // 256 AS segment, term, count(*) AS n, max(tf) AS max_tf FROM po GROUP BY 1, 2",
    "ranked_pruned": _top(10),
    "benchmark_ranked_pruned": _top(10, benchmark=True),
    "benchmark_ranked_segments": _top(10, benchmark=True),
    "benchmark_and_segments": f"{_hits(True)} SELECT query_ord, qid, count(*) AS matches FROM ands GROUP BY query_ord, qid",
    "benchmark_or_segments": f"{_hits(True)} SELECT query_ord, qid, count(*) AS matches FROM ors GROUP BY query_ord, qid",
    "and_docs_segments": f"{_hits()} SELECT * FROM ands",
    "idf_table": "SELECT n, df, round(ln(1 + n::DOUBLE / df::DOUBLE), 9) AS weight FROM (SELECT unnest([0, 1, 1000, 1000000])::BIGINT AS n) a, (SELECT unnest([1, 2, 999, 1000])::BIGINT AS df) b",
    "tf_table": "SELECT tf, round(ln(1 + tf::DOUBLE), 9) AS weight FROM range(1, 201) r(tf)",
    "dgaps": f"WITH {PO} SELECT *, docid - coalesce(lag(docid) OVER (PARTITION BY term ORDER BY docid), 0) AS dgap FROM po",
    "stream_gaps": f"WITH {PO} SELECT *, docid - coalesce(lag(docid) OVER (PARTITION BY term ORDER BY docid), 0) AS dgap FROM po",
    "level_postings": f"WITH {PO} SELECT * FROM po",
    "stream_answers": _top(10),
    "dgap_roundtrip": f"WITH {PO} SELECT term, docid, tf FROM po",
    "word_gaps": f"{_GAPS} FROM tok",
    "positional_doc_gaps": f"""{_GAPS},
  CASE WHEN lag(docid) OVER w IS NULL THEN docid WHEN lag(docid) OVER w = docid THEN 1 ELSE docid - lag(docid) OVER w + 1 END AS dgap
FROM tok WINDOW w AS (PARTITION BY term ORDER BY docid, position)""",
    "vbyte_size": f"WITH {_pairs('*')} SELECT DISTINCT gap, {_size('gap')}::BIGINT AS bytes FROM num",
    "double_vbyte_size": f"WITH {PO}, g AS (SELECT term, docid, tf, docid - coalesce(lag(docid) OVER (PARTITION BY term ORDER BY docid), 0) AS gap FROM po) SELECT term, docid, {_posting_size('gap', 'tf')}::BIGINT AS bytes FROM g",
    "double_vbyte_bytes": f"WITH {_pairs('*')} SELECT gap, tf, CASE WHEN tf < 4 THEN {_vbyte('(gap - 1) * 4 + tf')} ELSE {_vbyte('gap * 4')} || {_vbyte('tf - 3')} END AS code FROM num WHERE gap < 1000000000",
    "vbyte_bytes": f"WITH {_pairs('*')} SELECT DISTINCT gap, {_vbyte('gap')} AS code FROM num",
    "raw_u32": f"WITH {_pairs('*')} SELECT DISTINCT gap, " + " || ".join(f"lpad(lower(to_hex((gap >> {8 * k}) % 256)), 2, '0')" for k in range(4)) + " AS code, gap AS back FROM num",
    "codec_roundtrip": f"WITH {PO} SELECT term, docid, tf FROM po",
    "slab_sizes_triangle": f"WITH RECURSIVE {_SLABS.format(wish=_WISH['triangle'])} SELECT i, blocks FROM sl",
    "slab_sizes_expon": f"WITH RECURSIVE {_SLABS.format(wish=_WISH['expon'])} SELECT i, blocks FROM sl",
    "block_layout_fixed": f"{_layout('fixed')} SELECT * FROM lay",
    "block_layout_triangle": f"{_layout('triangle')} SELECT * FROM lay",
    "block_layout_expon": f"{_layout('expon')} SELECT * FROM lay",
    "slab_chain": f"""{_layout('triangle')},
c AS (SELECT term, slabs AS slab, min(docid) AS first_docid, count(*) AS postings FROM f WHERE rn > 0 GROUP BY term, slabs)
SELECT term, slab, first_docid, postings, CASE WHEN slab = 2 THEN first_docid WHEN slab > 2 THEN first_docid - lag(first_docid) OVER (PARTITION BY term ORDER BY slab) ELSE 0 END AS bgap FROM c""",
    "size_report": f"""{_layout('triangle')},
s AS (SELECT (SELECT count(*) FROM documents) AS n_docs, (SELECT count(*) FROM tok) AS n_words, sum(df)::BIGINT AS n_postings, count(*) AS vocabulary, sum(blocks)::BIGINT AS blocks FROM lay)
SELECT *, vocabulary * 8 + blocks * 64 AS total_bytes, round((vocabulary * 8 + blocks * 64)::DOUBLE / n_words, 6) AS bytes_per_word, round((vocabulary * 8 + blocks * 64)::DOUBLE / n_postings, 6) AS bytes_per_posting FROM s""",
    "interleaved_export": f"WITH {PO} SELECT term, docid - 1 AS docid, docid - 1 - coalesce(lag(docid) OVER w - 1, 0) AS dgap, tf FROM po WINDOW w AS (PARTITION BY term ORDER BY docid)",
    "canonical_docs": f"WITH {PO} {_LISTS.format(value='docid - 1')}",
    "canonical_read_back": f"WITH {PO} {_LISTS.format(value='docid - 1')}",
    "canonical_freqs": f"WITH {PO} {_LISTS.format(value='tf')}",
    "canonical_sizes": f"SELECT 0::BIGINT AS seq, count(*) AS value FROM documents UNION ALL SELECT doc_id + 1, len(regexp_extract_all(coalesce(text, ''), {_WORDS}))::BIGINT FROM documents",
    "canonical_terms": f"WITH {TOK} SELECT DISTINCT term FROM tok",
    "canonical_documents": "SELECT doc_id AS seq, doc_id::VARCHAR AS text_id FROM documents",
    "compaction_invariance": f"WITH {PO} SELECT * FROM po",
    "append_invariance": f"WITH {LX} SELECT * FROM lx",
    "stream_postings": f"WITH {PO} SELECT * FROM po",
    "stream_df": f"WITH {LX} SELECT term, df FROM lx",
    "stream_text_postings": f"WITH {_tokens(docid='row_number() OVER (ORDER BY doc_id)')} SELECT term, docid, count(*) AS tf FROM tok GROUP BY term, docid",
    "stream_totals": f"WITH {TOK} SELECT (SELECT count(*) FROM documents) AS documents, (SELECT count(*) FROM (SELECT DISTINCT docid, term FROM tok)) AS postings, (SELECT count(*) FROM tok) AS words",
    "docstream_file": f"SELECT row_number() OVER (ORDER BY doc_id) AS docid, doc_id::VARCHAR AS text_id, len(regexp_extract_all(coalesce(text, ''), {_WORDS}))::BIGINT AS length FROM documents",
    "query_file": f"SELECT DISTINCT query_ord, qid, unnest(regexp_extract_all(coalesce(text, ''), {_WORDS})) AS term FROM (SELECT row_number() OVER (ORDER BY item_id) AS query_ord, item_id::VARCHAR AS qid, text FROM benchmark)",
    "run_log": f"{_hits(True)} SELECT query_ord, qid, count(*) AS matches FROM ands GROUP BY query_ord, qid",
    "termid_buckets": "SELECT (doc_id + 1) % 64 AS bucket, count(*) AS ids FROM documents GROUP BY 1",
}
