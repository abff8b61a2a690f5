"""One query for each operator of this package, with production parameters, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from chatterscope.llm import align, bpe, chunks, exact, fingerprint, langid, lines, minhash, packing, suffix, toxicity, unigram, whitening
from chatterscope.llm.shared import documents

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
#: SQL for the queries that it can express.
ORACLE: dict[str, str] = {}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What every document loses to runs of chunks that occurred before; later copies of a text lose all of it."""
    return chunks.removals(documents(spark, sf_dir), least_copy=1)


@query
def op2_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every text."""
    return langid.identify(documents(spark, sf_dir))


@query
def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text encoded and decoded."""
    return bpe.round_trip(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))


@query
def op4_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document and the one that stays for its text."""
    return exact.deduplicate(documents(spark, sf_dir))


ORACLE["op4_exact"] = """
with d as (select doc_id, coalesce(text, '') as t from documents)
select doc_id, max(doc_id) over (partition by t) as keep_id, count(*) over (partition by t) as group_size,
  row_number() over (partition by t order by doc_id desc nulls last) = 1 as kept, sha256(t) as text_sha256
from d
"""


@query
def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The toxicity of every text."""
    return toxicity.detect(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


@query
def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text packed into sequences of 2048 ids."""
    return packing.pack(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))


@query
def op7_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The near-duplicate component of every document: three-word shingles, likeness 0.85."""
    return minhash.components(documents(spark, sf_dir), minhash.Likeness(3, 85))


@query
def op8_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What every document loses to strings of 400 bytes that occur elsewhere, and how much of it shorter passages repeat."""
    return suffix.removals(documents(spark, sf_dir), shorter=suffix.PASSAGE)


@query
def op9_unigram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The number of unigram pieces of every text."""
    return unigram.counts(documents(spark, sf_dir), public_tokenizers.path("piece_bpe_32k.model"))


@query
def op10_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's fingerprint, beside those of its edited text and of the next document."""
    return fingerprint.fingerprints(documents(spark, sf_dir), shift=1)


@query
def op11_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How the tokens of two tokenizers overlap in every text."""
    return align.alignments(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


@query
def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every embedding, whitened: 32 components."""
    return whitening.whitened(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


@query
def op13_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What every document loses to lines that ten documents have."""
    return lines.removals(documents(spark, sf_dir))


ORACLE["op13_lines"] = """
with d as (select row_number() over () as r, doc_id, string_split(coalesce(text, ''), chr(10)) as parts from documents),
l as (select r, doc_id, unnest(parts) as line, unnest(range(len(parts))) as i from d),
k as (select *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as key from l),
c as (select key as often from k where key <> '' group by key having count(distinct r) >= 10)
select doc_id, count(*) as n_lines, count(often) as n_dropped,
  sha256(coalesce(string_agg(line, chr(10) order by i) filter (where often is null), '')) as kept_sha256
from k left join c on key = often group by r, doc_id
"""
