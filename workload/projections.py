"""Given tables -> users, submissions, comments, activity, lexicon, gazetteer.

Each SQL text below runs on Spark (`{table}` bound to a DataFrame) and, with plain table names, on
the SQL engine that checks the results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chatterscope.functions import text as tx
from chatterscope.operators.sentiment import LOWERING, NEGATIONS, RAISING, Rules

AS_OF = 1706745600
# Scores of the invented words from which the kept tokens are checked.
ABBREVIATION = 0.001
# What a harvest of so many items for each user would see.
HARVEST_LIMITS = {"comment": 25, "submission": 25}
# The documents are invented words, so the rules also get words that do occur in them.
RULES = Rules(
    raising=RAISING | {"this", "for"},
    lowering=LOWERING | {"from", "of the"},
    negations=NEGATIONS | {"that", "der"},
    idioms={"in the": 1.5, "to the": -1.5, "it is": 2.0},
    contrast="with",
)


def _author(k: str) -> str:
    return f"""case when {k} % 29 = 0 then null when {k} % 23 = 0 then 'AutoModerator'
     when {k} % 11 = 0 then concat('ghost_', cast({k} % 7 as varchar(9)))
     else concat('Customer#', lpad(cast({k} % 150 as varchar(9)), 9, '0')) end"""


USERS = """
select concat('t2_', cast(c_custkey as varchar(20))) as redditor_id, c_name as redditor,
  1672531200 + (c_custkey * 7919 % 400) * 86400 as created_utc,
  cast(floor(c_acctbal * 0.25) as int) as link_karma,
  cast(floor(c_acctbal * 0.75) as int) as comment_karma,
  cast(floor(c_acctbal * 0.25) as int) + cast(floor(c_acctbal * 0.75) as int) as total_karma,
  c_custkey % 97 = 0 as is_employee, c_custkey % 13 = 0 as is_mod, c_mktsegment = 'BUILDING' as is_gold,
  cast(c_custkey % 30 as int) as dormant_days,
  c_custkey % 3 <> 0 as has_verified_email, c_custkey % 5 <> 0 as accepts_followers,
  c_custkey % 2 = 0 as redditor_is_subscriber
from {customer}
"""

SUBMISSIONS = f"""
select concat('p', cast(page_id as varchar(20))) as submission_id, {_author('page_id')} as author,
  regexp_extract(html, '(?s)<title>(.*?)</title>', 1) as title,
  cast(page_id * 31 % 500 - 50 as int) as submission_score, url,
  1704067200 + page_id * 3600 as submission_created_utc, page_id % 9 = 0 as over_18
from {{pages}}
union all
select concat('r', cast(page_id as varchar(20))), {_author('page_id')},
  upper(regexp_extract(html, '(?s)<title>(.*?)</title>', 1)), cast(page_id * 31 % 500 - 50 as int),
  concat('  ', url), 1704067200 + page_id * 3600 + 60, page_id % 9 = 0
from {{pages}} where page_id % 10 = 1
"""

COMMENTS_RAW = f"""
select concat('c', cast(doc_id as varchar(20))) as comment_id, {_author('doc_id')} as comment_author,
  1704067200 + doc_id * 600 as comment_created_utc, text as body,
  cast(doc_id * 31 % 200 - 20 as int) as comment_score, doc_id % 17 = 0 as is_submitter,
  case doc_id % 4 when 0 then 'false' when 1 then '1700000000.0' when 2 then null else 'true' end as edited_raw,
  concat('t3_p', cast(doc_id % 25 as varchar(9))) as link_id
from {{documents}}
"""

# All comments, typed, with the bare link id.
COMMENTS = f"""
select comment_id, comment_author, comment_created_utc, body, comment_score, is_submitter,
  edited_raw is not null and edited_raw <> 'false' as edited, substring(link_id, 4) as link_id
from ({COMMENTS_RAW}) raw
"""
# Those by people: what a load keeps.
PEOPLES = f"""
select * from ({COMMENTS}) every
where comment_author is not null and lower(comment_author) not in ('automoderator', 'reddit')
"""

_ACTIVITY = """
select concat('Customer#', lpad(cast(user_id as varchar(20)), 9, '0')) as redditor,
  {seconds} as created_utc,
  case when event_type in ('purchase','signup') then 'submission' else 'comment' end as kind,
  cast(event_id as varchar(20)) as item_id
from {events}
"""
# `ts` has no time zone; the interval since the epoch does not depend on the session's.
ACTIVITY = _ACTIVITY.replace(
    "{seconds}",
    "cast(floor(cast(cast(cast(ts as timestamp_ntz) - timestamp_ntz'1970-01-01 00:00:00' as interval second) as decimal(20,6))) as bigint)",
)
ACTIVITY_CHECK = _ACTIVITY.replace("{seconds}", "epoch_us(ts) // 1000000")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def users(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(USERS, customer=table(spark, sf_dir, "customer"))


def submissions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(SUBMISSIONS, pages=table(spark, sf_dir, "pages"))


def comments_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(COMMENTS_RAW, documents=table(spark, sf_dir, "documents"))


def comments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(COMMENTS, documents=table(spark, sf_dir, "documents"))


def peoples_comments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(PEOPLES, documents=table(spark, sf_dir, "documents"))


def activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(ACTIVITY, events=table(spark, sf_dir, "events"))


def lexicon(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of the benchmark passages with a valence from -4 to 4 by rule."""
    words = table(spark, sf_dir, "benchmark").select(
        F.explode(tx.clean_tokens(F.col("text"))).alias("token")
    ).distinct()
    size = F.length("token")
    valence = ((size * 7 + F.ascii("token")) % 17 - 8) / F.lit(2.0)
    return words.where((size >= 4) & (valence != 0)).select("token", valence.alias("valence"))


def gazetteer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Phrases of one to four tokens from the benchmark passages, labelled by rule."""
    passages = table(spark, sf_dir, "benchmark").select("item_id", tx.tokens(F.col("text")).alias("t"))
    item = F.col("item_id")
    label = F.element_at(F.array(*map(F.lit, ("GPE", "ORGANIZATION", "PERSON"))), (item % 3 + 1).cast("int"))
    cuts = F.array(
        F.slice("t", F.lit(1), (item % 4 + 1).cast("int")),
        F.slice("t", F.lit(3), (item % 3 + 1).cast("int")),
    )
    phrases = passages.select(F.explode(cuts).alias("p"), label.alias("label")).select(
        F.array_join("p", " ").alias("phrase"), "label"
    )
    return phrases.where(F.col("phrase").rlike(r"^\p{Lu}[\p{L} ]*$")).groupBy("phrase").agg(F.min("label").alias("label"))
