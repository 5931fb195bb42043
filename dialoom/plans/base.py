"""Tables that the registered queries start from, in Spark and as DuckDB common table expressions."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from dialoom.functions.text import tokens
from dialoom.operators import encode, vocab


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession, what: str) -> str:
    """A new path under the shared folder of spark.checkpoint.dir. Where that is unset it is set to a temporary folder
    if Spark runs in this process alone; on a cluster, whose machines wouldn't share it, that is an error."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = f"file://{tempfile.mkdtemp(prefix='spark-')}"
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{what}-{uuid.uuid4().hex}"


def stored(df: DataFrame, what: str) -> DataFrame:
    """Write a table that is used more than once to the shared folder and read it again."""
    path = scratch(df.sparkSession, what)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode.splits(load(spark, sf_dir, "conversations"))


def tokenised(spark: SparkSession, sf_dir: str, tokenizer=None) -> DataFrame:
    return turns(spark, sf_dir).withColumn("toks", tokens(F.col("text"), tokenizer=tokenizer))


def counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vocab.word_counts(tokenised(spark, sf_dir))


def vocabulary(spark: SparkSession, sf_dir: str, **how) -> DataFrame:
    return vocab.vocabulary(counts(spark, sf_dir), **how)


def ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode.token_ids(tokenised(spark, sf_dir), vocabulary(spark, sf_dir), bounded=True)


def steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode.steps(ids(spark, sf_dir))


def gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(conv_id, t, logit, loss, split, total_steps): the events as a step log, a user's events a dialogue."""
    e = load(spark, sf_dir, "events")
    t = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    return e.select(F.col("user_id").cast("long").alias("conv_id"), t.cast("long").alias("t"), ((F.col("value") - 50) / 25).alias("logit"), F.col("value").alias("loss"), F.col("event_type").alias("split"), F.col("event_id").cast("long").alias("total_steps"))


# ---- DuckDB ----
def clean_sql(text: str) -> str:
    return rf"""lower(regexp_replace(regexp_replace(regexp_replace({text}, '(?i)https?://\S+|www\.\S+', ' ', 'g'), '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{{2,}}', ' ', 'g'), '[\x{{1F300}}-\x{{1FAFF}}\x{{2700}}-\x{{27BF}}\x{{2600}}-\x{{26FF}}\x{{2190}}-\x{{2BFF}}]', '', 'g'))"""


def numbers_sql(words: str) -> str:
    return rf"list_transform({words}, lambda w: CASE WHEN regexp_matches(w, '^\p{{Nd}}{{5,}}$') THEN '<NUM>' ELSE w END)"


def tokens_sql(text: str) -> str:
    return numbers_sql(rf"regexp_extract_all({clean_sql(text)}, '[\x{{4e00}}-\x{{9fff}}]+|[A-Za-z]+|\p{{Nd}}+')")


CTES = {
    "turns": "SELECT CASE conv_id % 10 WHEN 8 THEN 'valid' WHEN 9 THEN 'test' ELSE 'train' END AS split, CASE conv_id % 10 WHEN 8 THEN 1 WHEN 9 THEN 2 ELSE 0 END AS split_ord, CAST(conv_id AS BIGINT) AS conv_id, CAST(turn AS BIGINT) AS turn, role, text FROM conversations",
    "tok": f"SELECT split, split_ord, conv_id, turn, role, {tokens_sql('text')} AS toks FROM turns",
    "words": "SELECT split_ord, conv_id, turn, unnest(toks) AS word, unnest(range(len(toks))) AS pos FROM tok",
    "firsts": "SELECT *, row_number() OVER (ORDER BY split_ord, conv_id, turn, pos) AS seen FROM words",
    "cnt": "SELECT word, count(*) AS n, min(seen) AS first_seen FROM firsts GROUP BY word",
    "vocab": "SELECT word, n, CAST(row_number() OVER (ORDER BY n DESC, first_seen) + 3 AS BIGINT) AS idx FROM (SELECT * FROM cnt WHERE n >= 2 ORDER BY n DESC, first_seen LIMIT 30000)",
    "lists": "SELECT conv_id, turn, list(coalesce(idx, 3) ORDER BY pos) AS l FROM words LEFT JOIN vocab USING (word) GROUP BY conv_id, turn",
    "ids": "SELECT split, split_ord, t.conv_id, t.turn, list_append(coalesce(l, []), 2) AS ids FROM tok t LEFT JOIN lists USING (conv_id, turn)",
    "steps": "SELECT * FROM (SELECT split, split_ord, conv_id, turn - 1 AS step, first_value(ids) OVER w AS x_ref, lag(ids) OVER w AS x_t, ids AS target, 1.0::DOUBLE AS gate FROM ids WINDOW w AS (PARTITION BY split, conv_id ORDER BY turn)) WHERE step >= 0",
    "gates": "SELECT CAST(user_id AS BIGINT) AS conv_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS t, (value - 50) / 25 AS logit, value AS loss, event_type AS split, CAST(event_id AS BIGINT) AS total_steps FROM events",
}
NEEDS = {"tok": ["turns"], "words": ["tok"], "firsts": ["words"], "cnt": ["firsts"], "vocab": ["cnt"], "lists": ["words", "vocab"], "ids": ["tok", "lists"], "steps": ["ids"]}


def sql(name: str, query: str, *more: tuple[str, str]) -> str:
    """The query after WITH of the named tables that it needs, and further (name, query) pairs."""
    order: list[str] = []

    def need(x: str) -> None:
        for y in NEEDS.get(x, []):
            need(y)
        if x not in order:
            order.append(x)

    for x in name.split():
        need(x)
    parts = [f"{x} AS (SELECT * FROM ({CTES[x]}))" for x in order] + [f"{a} AS ({b})" for a, b in more]
    return ("WITH " + ", ".join(parts) + " " if parts else "") + query


def show(column: str) -> str:
    """An id list as text."""
    return f"array_to_string({column}, ' ')"
