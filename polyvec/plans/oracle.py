"""SQL twins of the queries, for DuckDB: written as plain joins and windows, without the engine's kernels."""

from __future__ import annotations

import re

from polyvec.functions.text import STOP_WORDS
from polyvec.operators.encode import FACTOR, MODULUS, START
from polyvec.plans.queries import ALPHA, ALPHAS, BITS, BUDGETS_MS, CURVE, DEPTH, KEEP, LEVELS, PROJ, REPS, WIDTH

_STOP = ", ".join(f"'{w}'" for w in STOP_WORDS)


def _unit(v: str) -> str:
    return f"list_transform({v}::double[], lambda x: x / greatest(sqrt(list_dot_product({v}::double[], {v}::double[])), 1e-12))"


def _finite(v: str) -> str:
    return f"{v} is not null and len(list_filter({v}, lambda x: x is null or isnan(x) or isinf(x))) = 0 and len(list_filter({v}, lambda x: x <> 0)) > 0"


def _latest(table: str, keys: str, at: str, ties: str, where: str) -> str:
    return f"select * exclude (pick) from (select *, row_number() over (partition by {keys} order by {at} desc nulls last, {ties}) as pick from {table} where {where}) where pick = 1"


def _random(seed: int, rows: int, unit: bool) -> str:
    u = " + ".join(f"x{i} / {MODULUS}::double" for i in (1, 2, 3, 4))
    v = "v / sqrt(sum(v * v) over (partition by a))" if unit else "v"
    return f"""select a, list(w order by dim) as vec from (select a, dim, {v} as w from (select a, dim, {u} - 2.0::double as v from (
      select *, x3 * {FACTOR} % {MODULUS} as x4 from (select *, x2 * {FACTOR} % {MODULUS} as x3 from (select *, x1 * {FACTOR} % {MODULUS} as x2 from (
      select *, x0 * {FACTOR} % {MODULUS} as x1 from (select r.range as a, c.range as dim, (r.range * 64 + c.range + {seed * 7919 + 1}) * {START} % {MODULUS} as x0 from range({rows}) r, range(64) c)))))))
      group by a"""


def _signs(seed: int, rows: int) -> str:
    return f"""select a, list(case when x1 % 2 = 0 then 1.0::double else -1.0::double end / sqrt({rows}::double) order by dim) as vec from (
      select a, dim, x0 * {FACTOR} % {MODULUS} as x1 from (select r.range as a, c.range as dim, (r.range * 64 + c.range + {seed * 7919 + 1}) * {START} % {MODULUS} as x0 from range({rows}) r, range(64) c)) group by a"""


def _projected(bags: str, anchors: str) -> str:
    return f"""select id, a as term, p from (select id, pos, a, p, row_number() over (partition by id, pos, a // {WIDTH} order by p desc, a) as place
      from (select id, pos, a, round(list_dot_product(vec, anchor), 9) as p from {bags}, (select a, vec as anchor from {anchors}))) where place <= {KEEP}"""


def _top(scores: str, k: int) -> str:
    return f"select query_id, doc_id, score, rank from (select *, row_number() over (partition by query_id order by score desc, doc_id) as rank from {scores}) where rank <= {k}"


def _product(q: str, d: str, where: str = "true") -> str:
    return f"select q.id as query_id, d.id as doc_id, round(sum(q.weight * d.weight), 6) as score from {q} q join {d} d using (term) where {where} group by all"


def _metrics(run: str, ks: str, judged: str = "J") -> str:
    return f"""select query_id, k, coalesce(dcg, 0) / ideal as ndcg, coalesce(hits, 0) / k as precision, coalesce(hits, 0) / relevant as recall, coalesce(1.0 / first, 0) as mrr, coalesce(precs, 0) / relevant as map
      from (select query_id, count(*)::double as relevant from {judged} group by query_id)
      cross join (select unnest({ks})::bigint as k)
      join (select query_id, k, sum(rel / log2(place + 1)) as ideal from (select query_id, rel, row_number() over (partition by query_id order by rel desc, doc_id) as place from {judged}), (select unnest({ks})::bigint as k) where place <= k group by all) using (query_id, k)
      left join (select query_id, k, sum(rel / log2(rank + 1)) as dcg, count(*)::double as hits, min(rank) as first, sum(nth / rank) as precs
        from (select query_id, rel, rank, row_number() over (partition by query_id order by rank) as nth from {judged} join {run} using (query_id, doc_id)), (select unnest({ks})::bigint as k) where rank <= k group by all) using (query_id, k)"""


def _rerank(run: str, scores: str, depth: int) -> str:
    return f"""select query_id, doc_id, new as score, row_number() over (partition by query_id order by rank > {depth}, case when rank <= {depth} then new end desc nulls last, old) as rank
      from (select r.query_id, r.doc_id, r.rank, r.rank as old, s.score as new from {run} r left join {scores} s using (query_id, doc_id))"""


def _curve(score: str) -> str:
    return f"""select n, n / size as frac, mean + won / size as value from (
        select row_number() over (order by {score} desc, query_id) as n, sum(gain) over (order by {score} desc, query_id rows unbounded preceding) as won from SC
        union all select 0, 0), (select count(*) as size, avg(base) as mean from SC)"""


def _area(curve: str) -> str:
    return f"select coalesce(sum((frac - f0) * ((value + v0) / 2 - y0)), 0) as area from (select frac, value, lag(frac) over (order by n) as f0, lag(value) over (order by n) as v0, first(value) over (order by n) as y0 from {curve})"


def _avg_rank(table: str, value: str, name: str) -> str:
    return f"select *, rank() over (order by {value}) + (count(*) over (partition by {value}) - 1) / 2.0::double as {name} from {table}"


def _lists(run: str, name: str) -> str:
    at = lambda r: f"coalesce(max(score) filter (rank = {r}), 0)"
    return f"""select query_id, {at(1)} as {name}_top1, {at(1)} - {at(2)} as {name}_margin12, {at(1)} - {at(10)} as {name}_gap1_10,
      sqrt(greatest(sum(score * score) / 10 - (sum(score) / 10) * (sum(score) / 10), 0)) as {name}_std10, list(doc_id) as {name}_ids, max(doc_id) filter (rank = 1) as {name}_first from {run} where rank <= 10 group by query_id"""


_KS = "[1, 3, 5, 10, 20, 50, 100]"

#: Named parts; a query gets those it names, and those that these name.
PARTS: dict[str, str] = {
    "D": f"select doc_id, dataset, title, doc_texts as text from ({_latest('docs', 'doc_id', 'loaded_at', 'doc_texts', 'doc_texts is not null')})",
    "Q": f"select query_id, dataset, split, query_text as text from ({_latest('queries', 'query_id', 'created_at', 'query_text', chr(39).join(['trim(query_text) <> ', '', '']))})",
    "J": f"select query_id, doc_id, score as rel from ({_latest('qrels', 'query_id, doc_id', 'judged_at', 'score desc', 'score is not null')}) where score > 0",
    "TB": f"select doc_id as id, token_id as pos, {_unit('colbert_flat')} as vec from (select *, row_number() over (partition by token_id order by doc_id, pos, colbert_flat) as pick from token_embeddings where {_finite('colbert_flat')}) where pick = 1",
    "QB": f"select label as id, vec_id as pos, {_unit('embedding')} as vec from embeddings",
    "DV": f"select doc_id as id, {_unit('dense')} as vec from ({_latest('doc_embeddings', 'doc_id', 'encoded_at', 'dense', _finite('dense'))})",
    "SW": f"select doc_id as id, term, sum(w::double) as weight from (select doc_id, unnest(sparse_ids) as term, unnest(sparse_weights) as w from ({_latest('doc_embeddings', 'doc_id', 'encoded_at', 'sparse_ids', 'sparse_ids is not null')})) where term is not null and w is not null group by all",
    "DOT": "select a.pos as query_id, b.pos as doc_id, round(list_dot_product(a.vec, b.vec), 6) as score from QB a, QB b",
    "MS": "select query_id, doc_id, round(sum(m), 6) as score from (select q.id as query_id, d.id as doc_id, q.pos, max(list_dot_product(q.vec, d.vec)) as m from QB q, TB d group by all) group by all",
    "A1": _random(0, WIDTH, True),
    "A2": _random(0, WIDTH * REPS, True),
    "SD1": f"select id, term, avg(p) as weight from ({_projected('TB', 'A1')}) group by all",
    "SQ1": f"select id, term, sum(p) as weight from ({_projected('QB', 'A1')}) group by all",
    "SD2": f"select id, term, avg(p) as weight from ({_projected('TB', 'A2')}) group by all",
    "SQ2": f"select id, term, sum(p) as weight from ({_projected('QB', 'A2')}) group by all",
    "MU": "select list(m order by dim) as mu from (select dim, avg(x) as m from (select unnest(vec) as x, generate_subscripts(vec, 1) - 1 as dim from TB) group by dim)",
    "TBC": f"select id, pos, {_unit('vec')} as vec from (select id, pos, list_transform(list_zip(vec, mu), lambda e: e[1] - e[2]) as vec from TB, MU)",
    "QBC": f"select id, pos, {_unit('vec')} as vec from (select id, pos, list_transform(list_zip(vec, mu), lambda e: e[1] - e[2]) as vec from QB, MU)",
    "SDC": f"select id, term, avg(p) as weight from ({_projected('TBC', 'A1')}) group by all",
    "SQC": f"select id, term, sum(p) as weight from ({_projected('QBC', 'A1')}) group by all",
    "SR": _top(f"({_product('SQ1', 'SD1')})", 50),
    "PL": _random(1000, REPS * BITS, False),
    "SG": " union all ".join(f"select {r} as rep, a as dim, vec from ({_signs(2000 + r, PROJ)})" for r in range(REPS)),
    "CD": f"select id, pos, a // {BITS} as rep, sum(case when round(list_dot_product(t.vec, PL.vec), 9) > 0 then 1 << (a % {BITS})::int else 0 end)::bigint as code from TB t, PL group by all",
    "CQ": f"select id, pos, a // {BITS} as rep, sum(case when round(list_dot_product(t.vec, PL.vec), 9) > 0 then 1 << (a % {BITS})::int else 0 end)::bigint as code from QB t, PL group by all",
    "ED": "select c.id, c.pos, c.rep, code, dim, list_dot_product(t.vec, SG.vec) as v from CD c join TB t using (pos) join SG using (rep)",
    "EQ": "select c.id, c.pos, c.rep, code, dim, list_dot_product(t.vec, SG.vec) as v from CQ c join QB t using (pos) join SG using (rep)",
    "FQ": "select id, rep, code as bucket, dim, sum(v) as value from EQ group by all",
    "FD": f"""select id, rep, code as bucket, dim, avg(v) as value from ED group by all union all
      select id, rep, bucket, dim, v from (select *, bit_count(xor(code, bucket)) as away, row_number() over (partition by id, rep, bucket, dim order by bit_count(xor(code, bucket)), pos) as n from ED, (select range as bucket from range({1 << BITS}))) where n = 1 and away > 0""",
    "FDT": f"select id, (rep * {1 << BITS} + bucket) * {PROJ} + dim as term, value as weight from FD",
    "FQT": f"select id, (rep * {1 << BITS} + bucket) * {PROJ} + dim as term, value as weight from FQ",
    "W": f"select doc_id as id, term, count(*) as tf, sum(count(*)) over (partition by doc_id) as length from (select doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) as term from D) where term not in ({_STOP}) group by doc_id, term",
    "WA": "select doc_id as id, term, count(*) as tf, sum(count(*)) over (partition by doc_id) as length from (select doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) as term from D) group by doc_id, term",
    "QT": f"select query_id as id, term, count(*)::double as weight from (select query_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) as term from Q) where term not in ({_STOP}) group by all",
    "QTA": "select query_id as id, term, count(*)::double as weight from (select query_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) as term from Q) group by all",
    "BI": "select id, term, ln(1 + (n - df + 0.5::double) / (df + 0.5::double)) * tf * 2.2::double / (tf + 1.2::double * (0.25::double + 0.75::double * length / avgl)) as weight from W join (select term, count(*) as df from W group by term) using (term), (select (select count(*) from D) as n, (select sum(tf) from W)::double / (select count(*) from D) as avgl)",
    "BA": "select id, term, ln(1 + (n - df + 0.5::double) / (df + 0.5::double)) * tf * 2.2::double / (tf + 1.2::double * (0.25::double + 0.75::double * length / avgl)) as weight from WA join (select term, count(*) as df from WA group by term) using (term), (select (select count(*) from D) as n, (select sum(tf) from WA)::double / (select count(*) from D) as avgl)",
    "BS": _product("QT", "BI"),
    "BR": _top("BS", DEPTH),
    "LW": "select id, term, ln(tf + 1.0::double) as weight from W",
    "LS": _product("QT", "LW"),
    "LR": _top("LS", DEPTH),
    "HS": f"select query_id, doc_id, round(b.score + {ALPHA}::double * coalesce(l.score, 0), 9) as score from BS b left join LS l using (query_id, doc_id)",
    "HR": _top("HS", DEPTH),
    "SS": _product("SW", "SW", "q.id <> d.id"),
    "DD": "select a.id as query_id, b.id as doc_id, round(list_dot_product(a.vec, b.vec), 6) as score from DV a, DV b where a.id <> b.id",
    "HD": f"select query_id, doc_id, round(d.score + {ALPHA}::double * coalesce(s.score, 0), 9) as score from DD d left join SS s using (query_id, doc_id)",
    "H20": _top("HD", 20),
    "M20": "select query_id, doc_id, round(sum(m), 6) as score from (select h.query_id, h.doc_id, q.pos, max(list_dot_product(q.vec, t.vec)) as m from H20 h join TB q on q.id = h.query_id join TB t on t.id = h.doc_id group by all) group by all",
    "EB": _metrics("BR", _KS),
    "EB10": _metrics("BR", "[10]"),
    "EL10": _metrics("LR", "[10]"),
    "FR": "select query_id, min(rank) as first_rank from (select distinct query_id from J) left join (select query_id, rank from J join BR using (query_id, doc_id)) using (query_id) group by query_id",
    "DE": "select query_id, round(l.ndcg - b.ndcg, 6) as delta from EL10 l join EB10 b using (query_id)",
    "ST": """select method, string_split(method, ' ')[1] as family, try_cast(regexp_extract(method, 'w=(\\d+)', 1) as bigint) as w, try_cast(regexp_extract(method, 'k=(\\d+)', 1) as bigint) as k, try_cast(regexp_extract(method, 'r=(\\d+)', 1) as bigint) as reps,
      contains(method, 'center') as center, count(*) as n, round(median(total_ms), 6) as cost, round(avg(postings_read), 6) as value from (select lower(trim(method)) as method, total_ms, postings_read from latency_log where method is not null and total_ms > 0 and not isnan(total_ms)) group by method""",
    "PL5": f"select level, query_id as a, doc_id as b, score as cosine from (select *, row_number() over (partition by level order by query_id, doc_id) as n from DOT, (select unnest({list(LEVELS)})::double as level) where query_id < doc_id and abs(round(score - level, 6)) <= 0.025) where n <= 1000",
    "HT": f"select pos as id, term, p from (select id, pos, a as term, p, row_number() over (partition by pos order by p desc, a) as place from (select id, pos, a, round(list_dot_product(QB.vec, A1.vec), 9) as p from QB, A1)) where place <= {KEEP}",
    "ME": "select level, a, b, cosine, round(coalesce(s, 0), 6) as score from PL5 left join (select level, a, b, sum(x.p * y.p) as s from PL5 join HT x on x.id = a join HT y on y.id = b and x.term = y.term group by all) using (level, a, b)",
    "PS": f"select query_id, doc_id, ce_score as score, n_tokens from ({_latest('pair_scores', 'query_id, doc_id', 'scored_at', '(ce_score is not null and not isnan(ce_score)) desc, ce_score desc', 'true')}) where ce_score is not null and not isnan(ce_score)",
    "RB": _rerank("BR", "LS", 10),
    "RE": _rerank("BR", "PS", 20),
    "LA": f"""select query_id, round(f.ndcg, 6) as ndcg_first, round(b.ndcg, 6) as ndcg_base, round(e.ndcg, 6) as ndcg_escalate, round(e.ndcg - b.ndcg, 6) as gain, (e.ndcg > b.ndcg)::bigint as y
      from EB10 f join ({_metrics('RB', '[10]')}) b using (query_id) join ({_metrics('RE', '[10]')}) e using (query_id)""",
    "FE": f"""select query_id, round(hyb_top1, 6) as hyb_top1, round(hyb_margin12, 6) as hyb_margin12, round(hyb_gap1_10, 6) as hyb_gap1_10, round(hyb_std10, 6) as hyb_std10,
      round(coalesce(dense_top1, 0), 6) as dense_top1, round(coalesce(dense_margin12, 0), 6) as dense_margin12, round(coalesce(dense_gap1_10, 0), 6) as dense_gap1_10,
      round(coalesce(lex_top1, 0), 6) as lex_top1, round(coalesce(lex_margin12, 0), 6) as lex_margin12, round(coalesce(lex_gap1_10, 0), 6) as lex_gap1_10,
      round(coalesce(len(list_intersect(dense_ids, lex_ids))::double / nullif(len(list_distinct(list_concat(dense_ids, lex_ids))), 0), 0), 6) as dense_lex_jaccard10,
      coalesce(list_contains(lex_ids, dense_first), false)::bigint as dense_top1_in_lex10, coalesce(list_contains(dense_ids, lex_first), false)::bigint as lex_top1_in_dense10, coalesce(hyb_first = dense_first, false)::bigint as hyb_top1_is_dense_top1,
      coalesce(q_tokens, 0) as q_tokens, coalesce(q_lex_terms, 0) as q_lex_terms
      from ({_lists('HR', 'hyb')}) left join ({_lists('BR', 'dense')}) using (query_id) left join ({_lists('LR', 'lex')}) using (query_id)
      left join (select id as query_id, sum(weight)::bigint as q_tokens, count(*) as q_lex_terms from QT group by id) using (query_id)""",
    "SC": "select query_id, -hyb_margin12 as score, gain, ndcg_base as base, y from LA join FE using (query_id)",
    "CU": "select distinct query_id, doc_id from (select query_id, doc_id from BR where rank <= 20 union all select query_id, doc_id from LR where rank <= 20)",
    "PB": "select query_id, 1 / (1 + exp(-score)) as p, y from SC",
    "RL": "select least(floor(p * 10), 9)::bigint as bin, count(*) as n, avg(p) as confidence, avg(y) as accuracy from PB group by 1",
}

_ROUNDED = ", ".join(f"round({m}, 6) + 0.0 as {m}" for m in ("ndcg", "precision", "recall", "mrr", "map"))
_LONG = "select query_id, k, metric, value from ({}) unpivot (value for metric in (ndcg, precision, recall, mrr, map))"


def _means(table: str) -> str:
    return f"select metric, k, round(avg(value), 6) + 0.0 as value from ({_LONG.format(table)}) group by metric, k"


QUERIES: dict[str, str] = {
    "dense_topk": _top("DOT", 10),
    "dense_topk_self_excluded": _top("(select * from DOT where query_id <> doc_id)", 10),
    "maxsim_exhaustive": "select * from MS",
    "maxsim_topk": _top("MS", 10),
    "maxsim_rerank_tail": f"select query_id, doc_id, rank from ({_rerank('SR', '(select * from MS)', 20)})",
    "maxsim_rerank_truncate": f"select query_id, doc_id, rank from ({_rerank('SR', '(select * from MS)', 20)}) where rank <= 20",
    "token_mean": "select generate_subscripts(mu, 1) - 1 as dim, round(unnest(mu), 6) + 0.0 as mean from MU",
    "centered_tokens": "select pos as token_id, generate_subscripts(vec, 1) - 1 as dim, round(unnest(vec), 6) + 0.0 as value from TBC",
    "smve_encode_docs": "select id, term, round(weight, 6) + 0.0 as weight from SD1",
    "smve_encode_queries": "select id, term, round(weight, 6) + 0.0 as weight from SQ1",
    "smve_topk": "select * from SR where rank <= 10",
    "smve_reps": _top(f"({_product('SQ2', 'SD2')})", 10),
    "smve_centered": _top(f"({_product('SQC', 'SDC')})", 10),
    "muvera_codes": "select pos as token_id, rep, code from CD",
    "muvera_fde_docs": "select id, rep, bucket, dim, round(value, 6) + 0.0 as value from FD",
    "muvera_fde_queries": "select id, rep, bucket, dim, round(value, 6) + 0.0 as value from FQ",
    "muvera_topk": _top(f"({_product('FQT', 'FDT')})", 10),
    "bm25_terms": "select id, term, tf, length::bigint as length from W",
    "bm25_from_segments": "select id, term, round(weight, 6) + 0.0 as weight from BI",
    "bm25_index": "select id, term, round(weight, 6) + 0.0 as weight from BI",
    "bm25_topk": "select * from BR",
    "bm25_nostop": _top(f"({_product('QTA', 'BA')})", 10),
    "lexical_topk": _top("SS", 10),
    "postings_read": "select q.id as query_id, coalesce(sum(df), 0)::bigint as postings from QT q left join (select term, count(*) as df from W group by term) using (term) group by q.id",
    "index_size": "select count(*) as nnz, count(distinct term) as terms, count(*) * 8 + ((select count(*) from D) + 1) * 4 as csr_bytes, count(*) * 8 + (count(distinct term) + 1) * 8 as index_bytes from W",
    "nnz_stats": "select (select count(*) from D) as items, count(*) as nnz, round(count(*)::double / (select count(*) from D), 6) as mean_nnz, 'documents' as side from W union all select (select count(*) from Q), count(*), round(count(*)::double / (select count(*) from Q), 6), 'queries' from QT",
    "hybrid_topk": _top("HD", 10),
    "hybrid_three_way": _top("(select query_id, doc_id, round(0.4::double * d.score + 0.2::double * coalesce(s.score, 0) + 0.4::double * coalesce(m.score, 0), 9) as score from H20 h join DD d using (query_id, doc_id) left join SS s using (query_id, doc_id) left join M20 m using (query_id, doc_id))", 10),
    "alpha_sensitivity": " union all ".join(
        f"select {a}::double as alpha, round(avg(ndcg), 6) + 0.0 as ndcg from ({_metrics('(' + _top(f'(select query_id, doc_id, round(b.score + {a}::double * coalesce(l.score, 0), 9) as score from BS b left join LS l using (query_id, doc_id))', 10) + ')', '[10]')})" for a in ALPHAS
    ),
    "eval_per_query": f"select query_id, k, {_ROUNDED} from EB",
    "eval_mean": _means("select * from EB"),
    "eval_wide": "select query_id, " + ", ".join(f"max(round({m}, 6) + 0.0) filter (k = {k}) as {m}_{k}" for m in ("ndcg", "precision", "recall", "mrr", "map") for k in (1, 10)) + " from EB group by query_id",
    "metrics_at_k": _means(_metrics("BR", f"range(1, {CURVE + 1})")),
    "first_relevant": "select * from FR",
    "first_relevant_profile": f"select case when first_rank = 1 then '1' when first_rank between 2 and 3 then '2-3' when first_rank between 4 and 5 then '4-5' when first_rank between 6 and 10 then '6-10' when first_rank between 11 and 20 then '11-20' when first_rank between 21 and 50 then '21-50' when first_rank between 51 and {DEPTH} then '51-{DEPTH}' else '>{DEPTH}' end as bin, count(*) as queries from FR group by 1",
    "score_separation": "select J.rel is not null as relevant, count(*) as n, round(avg(score), 6) as mean, round(min(score), 6) as low, round(median(score), 6) as median, round(max(score), 6) as high from BR left join J using (query_id, doc_id) group by 1",
    "ndcg_histogram": "select least(floor(round(ndcg, 6) / 0.125) + 1, 8)::bigint as bin, count(*) as n from EB10 group by 1",
    "dataset_means": "select dataset, round(avg(b.ndcg), 6) as bm25, round(avg(l.ndcg), 6) as lexical, round(avg(l.ndcg) - avg(b.ndcg), 6) + 0.0 as headroom from EB10 b join EL10 l using (query_id) join Q using (query_id) group by dataset",
    "run_fidelity": "select count(*) as queries, round(avg(o), 6) as overlap, round(avg(c), 6) as coverage, round(median(t), 6) as median_rank, count(*) filter (t is null) as missing from (select b.query_id, count(*) filter (l.rank <= 10) / 10.0::double as o, count(l.rank) / 10.0::double as c, max(l.rank) filter (b.rank = 1) as t from BR b left join LR l using (query_id, doc_id) where b.rank <= 10 group by b.query_id)",
    "paired_delta": "select query_id, delta + 0.0 as delta from DE",
    "paired_summary": "select count(*) as n, round(avg(delta), 6) + 0.0 as mean_delta, count(*) filter (delta > 1e-9) as wins, count(*) filter (abs(delta) <= 1e-9) as ties, count(*) filter (delta < -1e-9) as losses from DE",
    "paired_bootstrap": f"select round(quantile_cont(m, 0.025), 6) + 0.0 as low, round(quantile_cont(m, 0.975), 6) + 0.0 as high from (select b, avg(delta) as m from (select b, (((b * 1000003 + place + 1) * {START} % {MODULUS}) * {FACTOR} % {MODULUS}) % n as pick from (select row_number() over (order by query_id) - 1 as place from DE), (select range as b from range(200)), (select count(*) as n from DE)) join (select row_number() over (order by query_id) - 1 as pick, delta from DE) using (pick) group by b)",
    "wilcoxon": f"""with R as ({_avg_rank('(select delta, round(abs(delta), 12) as size from DE where abs(delta) > 1e-12)', 'size', 'r')})
      select n, round(wp, 6) + 0.0 as w_plus, round(wm, 6) + 0.0 as w_minus, round((wp - n * (n + 1) / 4.0::double) / sqrt(n * (n + 1) * (2 * n + 1) / 24.0::double - t / 48.0::double), 6) as z
      from (select count(*) as n, coalesce(sum(r) filter (delta > 0), 0)::double as wp, coalesce(sum(r) filter (delta < 0), 0)::double as wm from R), (select coalesce(sum(c * c * c - c), 0)::double as t from (select count(*) as c from R group by size))""",
    "experiment_table": "select * from ST",
    "experiment_labels": "select method, family || ' w' || w || ' k' || k || case when reps > 1 then ' x' || reps else '' end || case when center then ' centred' else '' end as label from ST where w is not null",
    "pareto_frontier": "select method, cost, value from (select *, max(value) over (order by cost, value desc rows between unbounded preceding and 1 preceding) as best from ST where value is not null) where best is null or value > best",
    "equal_budget_best": f"select family, lim as \"limit\", method, cost, value from (select *, row_number() over (partition by family, lim order by value desc, method) as pick from ST, (select unnest({list(BUDGETS_MS)})::double as lim) where value is not null and cost <= lim) where pick = 1",
    "seed_spread": "select family, w, k, count(*) as n, round(avg(cost), 9) as mean, round(stddev_samp(cost), 9) as std from ST where w is not null group by family, w, k having count(*) > 1",
    "reps_vs_single": "select a.method as reps_method, b.method as single_method, a.cost as reps_cost, b.cost as single_cost, round((a.cost / b.cost - 1) * 100, 6) + 0.0 as change from ST a join ST b on a.w * a.reps = b.w and a.k * a.reps = b.k and a.center = b.center and a.family = b.family where a.reps > 1 and b.reps = 1",
    "cost_comparison": "select a.method, round(b.cost / a.cost, 6) as speed_up, round(100.0::double / greatest(1e-9::double, (b.cost - a.cost) / 1000), 3) as break_even from ST a, ST b where b.method = 'maxsim exhaustive'",
    "latency_summary": "select method, count(*) as n, round(median(total_ms), 6) as median, round(quantile_cont(total_ms, 0.95), 6) as p95 from latency_log where total_ms is not null and not isnan(total_ms) group by method",
    "pair_levels": "select * from PL5",
    "pair_mechanism": "select level, count(*) as n, round(count(*) filter (score = 0)::double / count(*), 6) as zero_share, round(avg(score), 6) as mean, round(stddev_pop(score) filter (score <> 0) / avg(score) filter (score <> 0), 6) as cv from ME group by level",
    "rank_correlation": f"select round(corr(cosine, score), 6) as pearson, round(corr(rx, ry), 6) as spearman from ({_avg_rank('(' + _avg_rank('ME', 'cosine', 'rx') + ')', 'score', 'ry')})",
    "router_features": "select * from FE",
    "rerank_stored": "select query_id, doc_id, rank from RE",
    "router_labels": "select query_id, ndcg_first, ndcg_base, ndcg_escalate, gain + 0.0 as gain, y from LA",
    "escalation_curve": f"select n, round(frac, 6) as frac, round(value, 6) + 0.0 as value from ({_curve('score')})",
    "router_gain_kept": f"select round(area, 6) + 0.0 as area, round(oracle_area, 6) + 0.0 as oracle_area, round(random_area, 6) + 0.0 as random_area, round(case when abs(oracle_area - random_area) > 1e-12 then (area - random_area) / (oracle_area - random_area) end, 6) + 0.0 as gain_kept from ({_area('(' + _curve('score') + ')')}), (select area as oracle_area from ({_area('(' + _curve('gain') + ')')})), (select avg(gain) / 2 as random_area from SC)",
    "router_budgets": f"select budget, n, round(value, 6) + 0.0 as value from (select budget, round_even(budget * (select count(*) from SC), 0)::bigint as n from (select unnest([0.1, 0.2, 0.3])::double as budget)) join ({_curve('score')}) using (n)",
    "router_auc": f"select round((sum(r) filter (y = 1) - p * (p + 1) / 2) / (p * n), 6) as auc from ({_avg_rank('SC', 'score', 'r')}), (select count(*) filter (y = 1)::double as p, count(*) filter (y = 0)::double as n from SC) group by p, n",
    "router_ece": "select round(sum(abs(confidence - accuracy) * n) / sum(n), 6) as ece from RL",
    "router_reliability": "select bin, n, round(confidence, 6) as confidence, round(accuracy, 6) as accuracy from RL where n >= 2",
    "candidate_union": "select * from CU",
    "cache_todo": "select * from CU where not exists (select 1 from pair_scores p where p.query_id = CU.query_id and p.doc_id = CU.doc_id)",
    "overlap_rerank": f"""with OV as (select r.query_id, r.doc_id, round(coalesce(count(w.term)::double / nullif(count(t.term), 0), 0), 6) as score from BR r left join QT t on t.id = r.query_id left join W w on w.id = r.doc_id and w.term = t.term where r.rank <= 20 group by all)
      select * from ({_rerank('(select * from BR where rank <= 20)', 'OV', 20)})""",
    "shorten_text": "select doc_id, array_to_string(words[1:120], ' ') || case when len(words) > 120 then ' ...' else '' end as short from (select doc_id, list_filter(regexp_split_to_array(text, '[ \\t\\n\\x0B\\f\\r]+'), lambda w: w <> '') as words from D)",
    "request_key": "select query_id, sha256('[\"' || query_id || '\",\"' || dataset || '\"]') as key from Q",
    "join_titles": "select doc_id, sha256(case when trim(coalesce(title, '')) = '' then 'body' else title || '. body' end) as joined from D",
    "trec_export": "select printf('%s Q0 %s %d %.6f bm25', query_id, doc_id, rank, score) as line from BR where rank <= 10",
    "cost_model": "select query_id, count(*) as pairs, sum(n_tokens)::bigint as tokens, round(sum(2 * 567e6::double * n_tokens + 4.0::double * 24 * 1024 * n_tokens * n_tokens) / 1e12, 6) as tflops, round(sum(n_tokens) * 0.042::double / 1e6, 9) as price from PS where n_tokens is not null group by query_id",
    "storage_bytes": "select count(*) as items, coalesce(sum(octet_length(encode(text))), 0)::bigint as text_bytes from D",
    "judged_queries": "select query_id, dataset, split from Q where query_id in (select query_id from J)",
    "corpus_ranges": "select id, unnest(range(start, start + len)) as value from (select id, len, coalesce(sum(len) over (order by id rows between unbounded preceding and 1 preceding), 0)::bigint as start from (select id, count(*) as len from TB group by id))",
}


PARTS |= {
    "EL": _metrics("LR", _KS),
    "RUNS": "select 'bm25' as run, * from EB union all select 'lexical', * from EL",
    "PQ": "select run, query_id, k, metric, value from RUNS unpivot (value for metric in (ndcg, precision, recall, mrr, map))",
    "OVL": "select r.query_id, r.doc_id, r.rank, round(coalesce(count(w.term)::double / nullif(count(t.term), 0), 0), 6) as score from BR r left join QT t on t.id = r.query_id left join W w on w.id = r.doc_id and w.term = t.term where r.rank <= 20 group by all",
    "MD": "select dataset, method, round(avg(ndcg), 6) as value from (" + " union all ".join(f"select '{m}' as method, query_id, ndcg from ({t})" for m, t in (("bm25", "select * from EB10"), ("lexical", "select * from EL10"), ("bm25 > lexical@10", _metrics("RB", "[10]")), ("bm25 > stored@20", _metrics("RE", "[10]")))) + ") join Q using (query_id) group by all",
}


def _rule_auc(rule: str, column: str) -> str:
    ranked = _avg_rank(f"(select -{column} as score, y from FE join LA using (query_id))", "score", "r")
    return f"select '{rule}' as rule, round((sum(r) filter (y = 1) - p * (p + 1) / 2) / (p * n), 6) as auc from ({ranked}), (select count(*) filter (y = 1)::double as p, count(*) filter (y = 0)::double as n from FE join LA using (query_id)) group by p, n"


def _median(column: str) -> str:
    return f"select method, '{column}' as part, count(*) as n, round(median({column}), 6) + 0.0 as median from latency_log where method is not null and {column} is not null and not isnan({column}) group by method"


def _at_depth(depth: int) -> str:
    flops = "2 * 567e6::double * n_tokens + 4.0::double * 24 * 1024 * n_tokens::double * n_tokens"
    return f"""select {depth}::bigint as depth, (select round(avg(ndcg), 6) from ({_metrics(f"({_rerank('BR', 'PS', depth)})", "[10]")})) as ndcg,
      count(*) as pairs, round(coalesce(sum({flops}), 0) / 1e12, 6) as tflops, round(coalesce(sum(n_tokens), 0) * 0.042::double / 1e6, 9) as price from BR join PS p using (query_id, doc_id) where rank <= {depth}"""


QUERIES |= {
    "saved_summaries": "select run, count(distinct query_id) as n_queries, (select count(*) from D) as n_docs, metric, k, round(avg(value), 5) as value from PQ group by run, metric, k",
    "run_comparison": """select 'lexical' as run, metric, k, count(*) as queries, round(avg(b.value), 6) as base, round(avg(l.value), 6) as value, round(avg(l.value - b.value), 6) + 0.0 as delta,
      round(case when avg(b.value) <> 0 then (avg(l.value) / avg(b.value) - 1) * 100 end, 6) + 0.0 as change, count(*) filter (l.value - b.value > 1e-9) as wins, count(*) filter (abs(l.value - b.value) <= 1e-9) as ties, count(*) filter (l.value - b.value < -1e-9) as losses
      from (select * from PQ where run = 'lexical') l join (select * from PQ where run = 'bm25') b using (query_id, metric, k) group by metric, k""",
    "run_folder": "select 'bm25' as run, count(*) as lines, max(rank) as deepest from BR having count(*) > 0 union all select 'lexical', count(*), max(rank) from LR having count(*) > 0",
    "rerank_depths": " union all ".join(_at_depth(d) for d in (5, 10, 20, 50)),
    "first_stage_costs": f"""select query_id, round(2.0::double * 64 * docs / 1e6, 6) as dense, round((2.0::double * 64 * {WIDTH} * q_tokens + 2.0::double * q_nnz * (nnz::double / docs * docs / {WIDTH})) / 1e6, 6) as sparse, round(2.0::double * 64 * q_tokens * doc_tokens / 1e6, 6) as maxsim
      from (select id as query_id, count(*) as q_tokens from QB group by id) join (select id as query_id, count(*) as q_nnz from SQ1 group by id) using (query_id), (select count(distinct id) as docs, count(*) as doc_tokens from TB), (select count(*) as nnz from SD1)""",
    "cross_dataset": "select dataset, method, value, row_number() over (partition by dataset order by value desc, method) as place, round(value - b, 6) + 0.0 as headroom from MD left join (select dataset, value as b from MD where method = 'bm25') using (dataset)",
    "fixed_settings": "select family, method, cost, value from ST where method in (select min(method) from ST group by family)",
    "sweep_axes": "select family, array_to_string(list_sort(list_distinct(list(w))), ',') as w, array_to_string(list_sort(list_distinct(list(k))), ',') as k from ST where w is not null group by family",
    "sweep_heat_map": "select family, w, k, round(avg(cost), 9) as cost, round(avg(cost) filter (center) - avg(cost) filter (not center), 9) + 0.0 as centring from ST where w is not null and k is not null group by family, w, k",
    "nearest_levels": f"select level, count(*) as pairs, round(avg(score), 6) + 0.0 as mean from (select score, list_sort(list_transform({list(LEVELS)}, lambda x: {{'away': round(abs(score - x), 6), 'level': x::double}}))[1].level as level from DOT where query_id < doc_id) group by level",
    "latency_split": " union all ".join(_median(c) for c in ("encode_ms", "score_ms", "topk_ms", "total_ms")),
    "escalation_latency": """select budget, parallel, round(base + case when parallel then greatest(0, decision - base) else decision end + budget * extra, 6) as ms
      from (select max(cost) filter (method = 'hybrid > maxsim@10') as base, max(cost) filter (method = 'maxsim exhaustive') as extra, max(cost) filter (method = 'bm25 index') as decision from ST), (select unnest([0.1, 0.2, 0.3])::double as budget), (select unnest([true, false]) as parallel)""",
    "router_heuristics": " union all ".join(_rule_auc(r, c) for r, c in (("margin", "hyb_margin12"), ("jaccard", "dense_lex_jaccard10"), ("gap", "hyb_gap1_10"), ("top1", "hyb_top1"))),
    "decision_answers": "select query_id, sha256(to_json([query_id, text])::varchar) as key, round(length(text) % 100 / 100, 2) as value from Q",
    "yes_no_rerank": "select query_id, doc_id, row_number() over (partition by query_id order by score >= 0.5 desc, rank) as rank from OVL",
    "routing_questions": """select query_id, sha256('Query: ' || text || chr(10) || 'Results:' || chr(10) || coalesce(titles, '') || chr(10) || 'Would a slower reranker improve this order?') as question
      from Q left join (select query_id, string_agg(coalesce(title, ''), chr(10) order by rank) as titles from BR join D using (doc_id) where rank <= 3 group by query_id) using (query_id)""",
    "ndcg_explicit": "select query_id, round(ndcg, 6) + 0.0 as ndcg from EB10",
    "score_per_token": "select query_id, doc_id, round(score / q, 9) as score from BR join (select id as query_id, sum(weight) as q from QT group by id) using (query_id) where rank <= 10",
    "bag_subset": "select id, pos as token_id, row_number() over (order by id desc, pos) - 1 as row from TB where id in (select doc_id from J)",
    "item_lookup": "select term::bigint as term, round(weight, 6) + 0.0 as weight from SW where id = (select min(id) from SW)",
    "bag_lookup": "select id, row_number() over (order by pos) - 1 as place, round(vec[1], 6) + 0.0 as first from TB where id = (select min(id) from TB)",
    "topk_of_list": "select query_id, doc_id, score from PS order by score desc, doc_id limit 10",
    "one_to_one": "select query_id, dataset, judged from Q left join (select query_id, count(*) as judged from J group by query_id) using (query_id)",
}


def _needs(sql: str, found: dict[str, None]) -> None:
    for name in PARTS:
        if name not in found and re.search(rf"\b{name}\b", sql):
            _needs(PARTS[name], found)
            found[name] = None


def oracle_sql() -> dict[str, str]:
    out = {}
    for name, sql in QUERIES.items():
        found: dict[str, None] = {}
        _needs(sql, found)
        own = re.match(r"with (\w+) as (.*)", sql, re.S)
        parts = ",\n".join(f"{p} as materialized ({PARTS[p]})" for p in found)
        out[name] = f"with {parts}, {sql[5:]}" if own and parts else f"with {parts}\n{sql}" if parts else sql
    return out
