"""Queries of the text problems 6 to 8 and the SQL of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataform.llm import leaks, pii, tokens
from strataform.sources.tables import table


def p6_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.encode(table(spark, sf_dir, "documents"))


def p6_decoded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The round trip: every document's ids turned back into text."""
    return tokens.decode(p6_ids(spark, sf_dir))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = leaks.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))
    # The exact check: no word of the passage differs.
    return found.where("distance = 0").select("doc_id", "item_id")


def p7_near(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaks with at most one word changed, added or left out in a passage of ten."""
    return leaks.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))


def p7_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per suite and split: items, leaked items and documents they leaked into."""
    items = table(spark, sf_dir, "eval_items").select("item_id", "suite", "split").distinct()
    joined = items.join(p7_found(spark, sf_dir), "item_id", "left")
    return joined.groupBy("suite", "split").agg(
        F.countDistinct("item_id").alias("n_items"),
        F.countDistinct(F.when(F.col("doc_id").isNotNull(), F.col("item_id"))).alias("n_leaked"),
        F.countDistinct("doc_id").alias("n_documents"),
    )


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_pii(table(spark, sf_dir, "documents"), table(spark, sf_dir, "name_parts"))
    return found.select("doc_id", "pii_type", "found_value")


def p8_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents with typed placeholders."""
    return pii.redact_pii(table(spark, sf_dir, "documents"), table(spark, sf_dir, "name_parts"))


QUERIES = {f.__name__: f for f in (p6_ids, p6_decoded, p7_found, p7_near, p7_report, p8_found, p8_redacted)}

_WORDS = """select {id}, list_transform(regexp_extract_all(regexp_replace(text, '\\p{{Cf}}+', '', 'g'), '[\\p{{L}}\\p{{N}}]+'), lambda w: lower(w)) as w from {table} where text is not null"""
_BOTH = f"""d as (select distinct * from ({_WORDS.format(id='doc_id', table='documents')}) where doc_id is not null), i as (select distinct * from ({_WORDS.format(id='item_id', table='eval_items')}) where item_id is not null)"""


def _grams(source: str, key: str, n: int) -> str:
    """The runs of n words of every text."""
    return f"select {key}, w[p : p + {n - 1}] as g from (select {key}, w, unnest(generate_series(1, len(w) - {n - 1})) as p from {source} where len(w) >= {n})"


def _without(source: str, key: str, places: range) -> str:
    """The runs with one word left out, and its place."""
    return f"select {key}, k, list_concat(g[: k - 1], g[k + 1 :]) as g from (select {key}, g, unnest(generate_series({places[0]}, {places[-1]})) as k from ({source}))"


_P7_FOUND = f"with {_BOTH} select distinct doc_id, item_id from ({_grams('d', 'doc_id', 10)}) join ({_grams('i', 'item_id', 10)}) using (g)"
#: One word changed: both without it agree; left out of the document: its nine words are the item's without it; added: its eleven without it are the item's ten.
_P7_NEAR = f"""with {_BOTH}, d10 as ({_grams('d', 'doc_id', 10)}), i10 as ({_grams('i', 'item_id', 10)}), i9 as ({_without('select * from i10', 'item_id', range(1, 11))}),
  hits as (select doc_id, item_id, 0 as distance from d10 join i10 using (g)
    union all select doc_id, item_id, 1 from ({_without('select * from d10', 'doc_id', range(1, 11))}) join i9 using (g, k)
    union all select doc_id, item_id, 1 from ({_grams('d', 'doc_id', 9)}) join i9 using (g)
    union all select doc_id, item_id, 1 from ({_without(_grams('d', 'doc_id', 11), 'doc_id', range(2, 11))}) join i10 using (g))
  select doc_id, item_id, cast(min(distance) as bigint) as distance from hits group by 1, 2"""

SQL = {
    "p6_decoded": "select doc_id, coalesce(text, '') as text from documents",
    "p7_found": _P7_FOUND,
    "p7_near": _P7_NEAR,
    "p7_report": f"""select suite, split, count(distinct e.item_id) as n_items, count(distinct f.item_id) as n_leaked, count(distinct doc_id) as n_documents
      from (select distinct item_id, suite, split from eval_items) e left join ({_P7_FOUND}) f on f.item_id = e.item_id group by 1, 2""",
}
