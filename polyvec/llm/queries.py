"""The queries of this folder, and SQL for those that SQL can express on whole tables."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from polyvec.llm import leaks, neighbours, percentiles, quality, split, terms, tokenizer, topn
from polyvec.plans.shared import checkpoint

QUANTILES = (0.5, 0.9, 0.95, 0.99)
MANTISSA = 8  # kept bits: the middle of a bucket is within 2 ** -9 of the value


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def ranks_path() -> str:
    """The rank file of byte_bpe_50k: $POLYVEC_TOKENIZERS, else the installed package of vocabularies."""
    folder = os.environ.get("POLYVEC_TOKENIZERS", "/opt/tokenizers")
    return os.path.join(folder, "byte_bpe_50k.tiktoken")


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    return split.cut_kinds(_table(spark, folder, "docs"), "doc_id", "doc_texts", 2000, 200)


def p1_pieces(spark: SparkSession, folder: str) -> DataFrame:
    """The pieces of every different long text of a document."""
    return _pieces(spark, folder).drop("text_key")


def _pieces(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "docs").select("doc_id", "doc_texts").where(F.char_length("doc_texts") > 2000)
    docs = docs.withColumn("text_key", F.sha2("doc_texts", 256)).dropDuplicates(["doc_id", "text_key"])  # texts aren't the key
    named = docs.select(F.struct("doc_id", "text_key").alias("of"), "doc_texts")
    return split.split_long(named, "of", "doc_texts", 2000, 200).select("of.*", "piece", "start", "end", "cut", "text")


def p1_coverage(spark: SparkSession, folder: str) -> DataFrame:
    """What the pieces of each long text add up to: characters covered from 0 without a gap, pieces over the limit, pieces whose
    text isn't that of their place, whether there are enough pieces and whether any cut was forced."""
    last = F.lag("end").over(Window.partitionBy("doc_id", "text_key").orderBy("piece"))
    rows = _pieces(spark, folder).withColumn("gap", F.col("start") > F.coalesce(last, F.lit(0)))
    per = rows.groupBy("doc_id", "text_key").agg(
        F.max("end").alias("characters"), F.count_if("gap").alias("gaps"), F.count_if(F.char_length("text") > 2000).alias("over_limit"), F.count_if(F.char_length("text") != F.col("end") - F.col("start")).alias("unlike"),
        F.count(F.lit(1)).alias("pieces"), F.max(F.col("cut") == split.FORCED).alias("forced"),
    )
    return per.select("doc_id", "characters", "gaps", "over_limit", "unlike", (F.col("pieces") >= F.ceil((F.col("characters") - 200) / 1800)).alias("enough"), "forced")


def _selected(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    log = _table(spark, folder, "latency_log")
    days = checkpoint(percentiles.summarise(log, ["method", "run_day"], "total_ms", MANTISSA))
    overall = percentiles.combine(days, ["method"])
    return (
        percentiles.select(days, ["method", "run_day"], QUANTILES, MANTISSA),
        percentiles.select(overall, ["method"], QUANTILES, MANTISSA),
    )


def p2_percentiles(spark: SparkSession, folder: str) -> DataFrame:
    """Per method and day, and per method over all days (``run_day`` null, ``whole`` true), from the days' summaries."""
    by_day, overall = (percentiles.bounds(s, MANTISSA) for s in _selected(spark, folder))
    return by_day.withColumn("whole", F.lit(False)).unionByName(
        overall.withColumns({"run_day": F.lit(None).cast("date"), "whole": F.lit(True)})
    )


def p2_exact(spark: SparkSession, folder: str) -> DataFrame:
    """The exact order statistics per method over all days: the digits beyond the summaries, by another read."""
    log = _table(spark, folder, "latency_log")
    _, overall = _selected(spark, folder)
    return percentiles.refine(log, ["method"], "total_ms", checkpoint(overall), MANTISSA).withColumnRenamed("value", "total_ms")


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    return p3_top(spark, folder).select("query_id", "doc_id")


def p3_top(spark: SparkSession, folder: str) -> DataFrame:
    scores = topn.latest_scores(_table(spark, folder, "pair_scores"), "query_id", "doc_id", "ce_score", "scored_at")
    return topn.top_n(scores, "query_id", "doc_id", "ce_score", 10)


def p4_terms(spark: SparkSession, folder: str) -> DataFrame:
    texts = terms.latest_values(_table(spark, folder, "docs"), "doc_id", "doc_texts", "loaded_at")
    ids = terms.latest_values(_table(spark, folder, "doc_embeddings"), "doc_id", "sparse_ids", "encoded_at")
    return terms.term_frequencies([("doc_texts", texts, terms.text_terms), ("sparse_ids", ids, terms.id_terms)])


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    return p4_terms(spark, folder).where("mark is not null").select("field", "term", "mark")


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    pairs = neighbours.similar_pairs(_table(spark, folder, "token_embeddings"), "token_id", "colbert_flat", 5, 0.92)
    return pairs.select(F.col("a").alias("token_a"), F.col("b").alias("token_b"))


def p5_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    """The five most similar of all vectors for each id divisible by 20."""
    return neighbours.most_similar(_table(spark, folder, "token_embeddings"), "token_id", "colbert_flat", 5, query=F.col("id") % 20 == 0)


def p6_ids(spark: SparkSession, folder: str) -> DataFrame:
    return tokenizer.encode_texts(_table(spark, folder, "documents"), "doc_id", "text", ranks_path())


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    return leaks.find_leaks(*_leaks(spark, folder)).distinct()


def p7_items(spark: SparkSession, folder: str) -> DataFrame:
    """Which held-out items leaked, and into how many documents."""
    return p7_found(spark, folder).groupBy("item_id").agg(F.count(F.lit(1)).alias("documents"))


def _leaks(spark: SparkSession, folder: str) -> tuple:
    return _table(spark, folder, "documents"), "doc_id", "text", _table(spark, folder, "eval_items"), "item_id", "item_text"


def p7_spans(spark: SparkSession, folder: str) -> DataFrame:
    """Where the passages are, in code points of the stored text."""
    return leaks.leak_spans(*_leaks(spark, folder))


def p7_cleaned(spark: SparkSession, folder: str) -> DataFrame:
    """Every document without its passages."""
    return leaks.remove_spans(*_leaks(spark, folder))


def p8_statistics(spark: SparkSession, folder: str) -> DataFrame:
    return quality.text_statistics(_table(spark, folder, "documents"), "doc_id", "text")


def p8_ratios(spark: SparkSession, folder: str) -> DataFrame:
    """The statistics without the kind."""
    found = p8_statistics(spark, folder)
    return found.select("doc_id", "words", *[(F.round(c, 6) + F.lit(0.0)).alias(c) for c in quality.STATISTICS[1:5]])


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    return p8_statistics(spark, folder).where("kind is not null").select("doc_id", "kind")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (p1_found, p1_pieces, p1_coverage, p2_percentiles, p2_exact, p3_found, p3_top, p4_found, p4_terms, p5_found, p5_neighbours, p6_ids, p7_found, p7_items, p7_spans, p7_cleaned, p8_found, p8_statistics, p8_ratios)}


_P3 = """
with latest as (
  select query_id, doc_id, ce_score, row_number() over (
    partition by query_id, doc_id
    order by scored_at desc nulls last, (ce_score is not null and not isnan(ce_score)) desc, ce_score desc) as pick
  from pair_scores),
ranked as (
  select query_id, doc_id, ce_score, row_number() over (partition by query_id order by ce_score desc, doc_id) as rank
  from latest where pick = 1 and ce_score is not null and not isnan(ce_score))
"""

_P4 = """
with docs1 as (
  select doc_id, doc_texts from (
    select doc_id, doc_texts, row_number() over (partition by doc_id order by loaded_at desc nulls last, doc_texts desc) as pick
    from docs where doc_texts is not null) where pick = 1),
ids1 as (
  select doc_id, sparse_ids from (
    select doc_id, sparse_ids, row_number() over (partition by doc_id order by encoded_at desc nulls last, sparse_ids desc) as pick
    from doc_embeddings where sparse_ids is not null) where pick = 1),
words as (
  select 'doc_texts' as field, doc_id, unnest(regexp_extract_all(lower(doc_texts), '[a-z0-9]+')) as term from docs1
  union all
  select 'sparse_ids', doc_id, cast(unnest(sparse_ids) as varchar) from ids1),
records as (
  select 'doc_texts' as field, count(*) as n from docs1 union all select 'sparse_ids', count(*) from ids1),
counted as (
  select field, term, count(*) as occurrences, count(distinct doc_id) as records
  from words where term is not null group by field, term),
marked as (
  select field, term, occurrences, counted.records,
    case when counted.records <= 2 then 'rare' when counted.records * 5 > records.n then 'common' end as mark
  from counted join records using (field))
"""


# White space, and Chinese and Japanese characters; a word is one of the latter or a run of other letters and digits.
_SPACE = r"\t-\r\x{1C}-\x{20}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
_IDEO = r"\x{3040}-\x{30FF}\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{AC00}-\x{D7AF}"
_P8 = rf"""
with parts as (
  select doc_id,
    regexp_extract_all(regexp_replace(lower(text), '([{_IDEO}])', ' \1 ', 'g'), '[\p{{L}}\p{{N}}]+|[{_IDEO}]') as w,
    length(regexp_replace(text, '[\p{{L}}\p{{N}}{_SPACE}]', '', 'g')) as symbols,
    length(regexp_replace(text, '[{_SPACE}]', '', 'g')) as solid,
    list_filter(regexp_split_to_array(text, '\r\n|[\n-\r\x{{85}}\x{{2028}}\x{{2029}}]'), lambda l: length(regexp_replace(l, '[{_SPACE}]', '', 'g')) > 0) as lines
  from documents),
counts as (
  select doc_id, coalesce(len(w), 0) as words, list_sum(list_transform(w, lambda x: length(x))) as chars, symbols, solid, len(lines) as n_lines,
    len(list_filter(lines, lambda l: regexp_matches(regexp_replace(l, '[{_SPACE}]+$', ''), '{{ENDS}}'))) as ended, len(list_filter(w, lambda x: x in ({{COMMON}}))) as common
  from parts)
select doc_id, cast(words as bigint) as words, round(chars / nullif(words, 0), 6) as mean_word_length, round(symbols / nullif(solid, 0), 6) as symbol_ratio,
  round(ended / nullif(n_lines, 0), 6) as punct_line_share, round(common / nullif(words, 0), 6) as common_share
from counts
"""


def _p2_case(select: str, group: str) -> str:
    return " union all ".join(
        f"select {select}, cast({q} as double) as q, n, list_extract(v, cast(greatest(ceil(n * {q}::double - 1e-9), 1) as bigint)) as x from ({group})" for q in QUANTILES
    )


def oracle_sql() -> dict[str, str]:
    # The longest run of characters that aren't boundaries: split at the boundaries, longest part.
    boundaries = "[ \\t\\n\\r\\x{00A0}\\x{3000}\\x{3002}\\x{FF01}\\x{FF1F}]"
    valid = "from latency_log where total_ms is not null and not isnan(total_ms)"
    by_day = f"select method, run_day, count(*) as n, list(total_ms order by total_ms) as v {valid} group by method, run_day"
    whole = f"select method, count(*) as n, list(total_ms order by total_ms) as v {valid} group by method"
    step = 2**MANTISSA
    # The power of two at or below |x|, then its mantissa cut to MANTISSA bits.
    scale = "pow(2::double, case when pow(2::double, floor(log2(abs(x)))) > abs(x) then floor(log2(abs(x))) - 1 when pow(2::double, floor(log2(abs(x))) + 1) <= abs(x) then floor(log2(abs(x))) + 1 else floor(log2(abs(x))) end)"
    cut = f"floor(abs(x) / ({scale}) * {step})"
    exact = f"abs(x) / ({scale}) * {step} = {cut}"
    up, down = f"({cut} + 1) * ({scale}) / {step}", f"{cut} * ({scale}) / {step}"
    tiny = f"pow(2::double, -1023) * pow(2::double, {1 - MANTISSA})"
    low = f"case when x = 0 then 0 when x > 0 then {down} when {exact} then x else -({up}) end"
    high = f"case when x = 0 then {tiny} when x > 0 then {up} when {exact} and {cut} = {step} then -{2 * step - 1} * ({scale}) / {2 * step} when {exact} then -({cut} - 1) * ({scale}) / {step} else -({down}) end"
    ends = quality._LINE_END.pattern.replace("'", "''")
    return {
        "p8_ratios": _P8.replace("{ENDS}", ends).replace("{COMMON}", ", ".join(f"'{w}'" for w in sorted(quality.COMMON))),
        "p1_found": f"""
            select doc_id, case when max(list_aggregate(list_transform(regexp_split_to_array(doc_texts, '{boundaries}'), lambda p: length(p)), 'max')) > 2000
              then 'forced' else 'natural' end as cut
            from docs where length(doc_texts) > 2000 group by doc_id""",
        "p1_coverage": f"""
            select doc_id, length(doc_texts) as characters, 0 as gaps, 0 as over_limit, 0 as unlike, true as enough,
              list_aggregate(list_transform(regexp_split_to_array(doc_texts, '{boundaries}'), lambda p: length(p)), 'max') > 2000 as forced
            from (select distinct doc_id, doc_texts from docs where length(doc_texts) > 2000)""",
        "p2_percentiles": f"""
            with picked as (
              {_p2_case("method, run_day, false as whole", by_day)}
              union all {_p2_case("method, null::date as run_day, true as whole", whole)})
            select method, run_day, q, n, low + (high - low) / 2 as value, low, high, whole from (select *, {low} as low, {high} as high from picked)""",
        "p2_exact": f"select method, q, n, x as total_ms from ({_p2_case('method', whole)})",
        "p3_found": _P3 + "select query_id, doc_id from ranked where rank <= 10",
        "p3_top": _P3 + "select query_id, doc_id, ce_score, rank from ranked where rank <= 10",
        "p4_found": _P4 + "select field, term, mark from marked where mark is not null",
        "p4_terms": _P4 + "select field, term, occurrences, records, mark from marked",
    }
