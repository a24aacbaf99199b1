"""The registered queries of this folder: one per operator, over whole tables, and the pipeline.

The SQL beside a query is what its rows must equal; queries without one are tested against brute force.
"""

from __future__ import annotations

from collections.abc import Callable
from uuid import uuid4

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from gleanery.llm import backoff, bagminhash, bytebpe, divergence, fingerprint, language, licenses, linecrf, mixing, permutation, piececount, treap, warc
from gleanery.session import durable, shared_dir, ship_package

Query = Callable[[SparkSession, str], DataFrame]

MAX_TOKENS = 4096
MIN_QUALITY = 0.3


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def byte_codec() -> bytebpe.Codec:
    return bytebpe.Codec(bytebpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")), public_tokenizers.PATTERN)


def op1_warc_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write all pages as archives into the shared folder, read them back and reassemble them."""
    path = f"{shared_dir(spark)}/warc-{uuid4().hex}"
    warc.write(warc.records(warc.captures(table(spark, sf_dir, "pages"))), path)
    found = durable(warc.reassemble(warc.read(spark, path)))
    page = lambda c: F.col(c).cast("long")
    return warc.resolve(found).select(
        page("key").alias("page_id"), "payload_bytes", "payload_digest", "record_type", page("refers_to").alias("refers_to")
    )


OP1_SQL = """
with sized as (
  select page_id, strlen(coalesce(html, ''))::bigint as payload_bytes, sha256(coalesce(html, '')) as payload_digest from pages),
firsts as (select payload_digest, min(page_id) as first_id from sized where payload_bytes >= 100 group by 1)
select page_id, payload_bytes, payload_digest,
  case when page_id > first_id then 'revisit' else 'response' end as record_type,
  case when page_id > first_id then first_id end as refers_to
from sized left join firsts using (payload_digest)
"""


def op2_weighted_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and of its edited text, and how alike they are."""
    return fingerprint.with_edited(table(spark, sf_dir, "documents"))


def op3_language_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learned from the documents outside the held-out fold."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = language.train(docs.where(language.fold("doc_id") != 0))
    found = language.predict(docs, model)
    return found.select("doc_id", (language.fold("doc_id") == 0).alias("held_out"), "lang_pred", "score", "languages")


def op4_license_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licences of every document, by sentence rules."""
    found = licenses.scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_sentences", F.array_join("licenses", ",").alias("licenses"))


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every document by the 50k byte-level vocabulary, and what they decode to, as digests."""
    return bytebpe.encode(table(spark, sf_dir, "documents"), byte_codec(), keep_ids=False)


def op6_bag_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate class of every document."""
    return bagminhash.classes(table(spark, sf_dir, "documents")).select("doc_id", "class_id")


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document by the 32k piece vocabulary."""
    with open(public_tokenizers.path("piece_bpe_32k.model"), "rb") as model:
        return piececount.count(table(spark, sf_dir, "documents"), model.read(), limit=MAX_TOKENS)


def op8_backoff_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log probability of every document, learned from the documents outside the held-out fold."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = backoff.score(docs, language.fold("doc_id") != 1)
    held = (language.fold("doc_id") == 1).alias("held_out")
    return found.select("doc_id", held, "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op9_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that a mix of all documents by source weights takes from each."""
    rows = durable(mixing.sized(table(spark, sf_dir, "documents")))
    mixed = mixing.apply(rows, mixing.plan(rows))
    return mixed.select(F.col("key").alias("doc_id"), "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def op10_permutation_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 vectors of largest inner product for every vector whose id is divisible by 20."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    found = permutation.search(rows, rows.where("vec_id % 20 = 0"), k=20)
    return found.select("query_id", "rank", F.col("id").alias("vec_id"), "score")


def op11_k2_treap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 50 best documents of every benchmark item."""
    return treap.rank(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_line_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document by its lines, learned from the labelled documents outside the held-out fold."""
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels")
    found = linecrf.score(docs, linecrf.train(docs, labels.where(language.fold("doc_id") != 0)))
    predicted = (F.col("score") >= MIN_QUALITY).cast("int").alias("predicted")
    return found.select("doc_id", (language.fold("doc_id") == 0).alias("held_out"), "score", predicted, "n_lines", "bad_lines")


def op13_pointer_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far apart the sources of each language are, and the words that each overuses."""
    return divergence.audit(table(spark, sf_dir, "documents"))


OP9_SQL = r"""
with docs as (
  select doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::bigint as size,
    ('0x' || substr(md5(coalesce(doc_id::varchar, '')), 1, 15))::bigint as h
  from documents),
sources as (
  select source, sum(size)::bigint as source_size, (row_number() over (order by source nulls last) - 1) % 3 + 1 as weight,
    row_number() over (order by source nulls last) as n
  from docs group by source),
filled as (
  select *, 3 * source_size as room,
    coalesce(sum(3 * source_size) over (order by 3 * source_size / weight, n rows between unbounded preceding and 1 preceding), 0) as given,
    sum(weight) over (order by 3 * source_size / weight, n rows between current row and unbounded following) as open,
    sum(source_size) over () as total
  from sources),
levels as (select *, (total - given)::double / open::double as level from filled),
goals as (
  select source, source_size, case when level * weight >= room then room::double
    else max(case when level * weight < room then level end) over () * weight end as target
  from levels),
needs as (
  select *, case when source_size > 0 then floor(target / source_size)::bigint else 0 end as copies from goals),
running as (
  select d.*, g.source_size, g.target, g.copies, g.target - g.copies * g.source_size as need,
    sum(d.size) over (partition by d.source order by d.h range between unbounded preceding and current row) as upto,
    sum(d.size) over (partition by d.source, d.h) as tied
  from docs d join needs g on d.source is not distinct from g.source)
select doc_id, size, source_size, target,
  (size * (copies + case when upto - tied >= need then 0 when upto <= need then 1
    when upto - need <= need - (upto - tied) then 1 else 0 end))::bigint as taken
from running
"""


QUERIES: dict[str, tuple[Query, str | None]] = {
    "op1_warc_segments": (op1_warc_segments, OP1_SQL),
    "op2_weighted_samples": (op2_weighted_samples, None),
    "op3_language_mixture": (op3_language_mixture, None),
    "op4_license_rules": (op4_license_rules, licenses.sql()),
    "op5_byte_bpe": (op5_byte_bpe, None),
    "op6_bag_minhash": (op6_bag_minhash, None),
    "op7_token_counts": (op7_token_counts, None),
    "op8_backoff_automaton": (op8_backoff_automaton, None),
    "op9_source_mix": (op9_source_mix, OP9_SQL),
    "op10_permutation_index": (op10_permutation_index, None),
    "op11_k2_treap": (op11_k2_treap, treap.SQL),
    "op12_line_crf": (op12_line_crf, None),
    "op13_pointer_audit": (op13_pointer_audit, divergence.SQL),
}


def _prepared(query: Query) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship_package(spark)
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        return query(spark, sf_dir)

    run.__name__, run.__doc__ = query.__name__, query.__doc__
    return run


def queries() -> dict[str, Query]:
    return {name: _prepared(query) for name, (query, _) in QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in QUERIES.items() if sql is not None}
