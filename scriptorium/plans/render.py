"""Documents rendered from the star schema: letters, notes and letters with known misreadings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame, key: str) -> DataFrame:
    """Rows dealt out by their key over all cores: a text costs far more than the row it is rendered from, of which one task reads a whole file."""
    return df.repartition(4 * df.sparkSession.sparkContext.defaultParallelism, key)


def letters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, text): a letter an order; the small nation side is joined by whatever strategy its size allows."""
    rows = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    key = F.col("o_orderkey").cast("string")
    cust = F.col("c_custkey").cast("string")
    return spread(rows, "o_orderkey").select(
        F.col("o_orderkey").alias("doc_id"),
        F.concat(
            F.lit("Dear "), "n_name", F.lit(" Desk,\nOrder "), key, F.lit(" of "), F.date_format("o_orderdate", "d MMMM yyyy"), F.lit(" is confirmed.The total is $"), F.format_string("%.2f", "o_totalprice"),
            F.lit(" and\nthe due date is "), F.date_format("o_orderdate", "dd/MM/yyyy"), F.lit(".\n\nWrite to c"), cust, F.lit("@shop.example or call 98"), F.lpad(cust, 8, "0"),
            F.lit(".\nSee https://shop.example/o/"), key, F.lit(". PIN "), (F.col("o_orderkey") + 100000).cast("string"), F.lit("\n\nYours sincerely,\nAsha Rao"),
        ).alias("text"),
    )


def notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    key, size = F.col("p_partkey").cast("string"), F.col("p_size").cast("string")
    body = F.concat(F.lit("Q1. Meaning of economics:- "), "p_name", F.lit(" 1) Wealth of part "), key, F.lit(" 2) Welfare and scarsity\n#%% @\ndef. size "), size)
    return spread(table(spark, sf_dir, "part"), "p_partkey").select(F.col("p_partkey").alias("doc_id"), body.alias("text"))


def noisy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Letters with misreadings that depend on the key; the clean letter is the truth."""
    swap = lambda c, a, b: F.replace(c, F.lit(a), F.lit(b))
    t = F.col("text")
    part = F.col("doc_id") % 3
    out = F.when(part == 0, swap(swap(t, "The ", "Tbe "), "and", "aud")).when(part == 1, swap(swap(t, " is ", " 1s "), "total", "t0tal")).otherwise(swap(t, "due", "d!ue"))
    return letters(spark, sf_dir).select("doc_id", out.alias("text"))


LETTERS_SQL = """SELECT o_orderkey AS doc_id, 'Dear ' || n_name || ' Desk,' || chr(10) || 'Order ' || o_orderkey || ' of ' || strftime(o_orderdate, '%-d %B %Y')
 || ' is confirmed.The total is $' || printf('%.2f', o_totalprice) || ' and' || chr(10) || 'the due date is ' || strftime(o_orderdate, '%d/%m/%Y') || '.' || chr(10) || chr(10)
 || 'Write to c' || c_custkey || '@shop.example or call 98' || lpad(c_custkey::varchar, 8, '0') || '.' || chr(10) || 'See https://shop.example/o/' || o_orderkey
 || '. PIN ' || (o_orderkey + 100000) || chr(10) || chr(10) || 'Yours sincerely,' || chr(10) || 'Asha Rao' AS text
 FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey"""
NOTES_SQL = """SELECT p_partkey AS doc_id, 'Q1. Meaning of economics:- ' || p_name || ' 1) Wealth of part ' || p_partkey || ' 2) Welfare and scarsity' || chr(10) || '#%% @' || chr(10) || 'def. size ' || p_size AS text FROM part"""
NOISY_SQL = f"""SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN replace(replace(text, 'The ', 'Tbe '), 'and', 'aud') WHEN 1 THEN replace(replace(text, ' is ', ' 1s '), 'total', 't0tal') ELSE replace(text, 'due', 'd!ue') END AS text FROM ({LETTERS_SQL}) l"""
