"""One query per operator, over its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeops.llm.common import table
from lakeops.session import shared_dir

QueryFn = Callable[[SparkSession, str], DataFrame]


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


def op1_bloom_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bloom-filter language-model scores of every document."""
    from lakeops.llm.bloom_lm import score_corpus
    return score_corpus(table(spark, sf_dir, "documents"))


def op2_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages as WARC records, against a replica in which records by a rule are damaged or lost."""
    from lakeops.llm.fixity import audit, damaged, tree, warc_records
    records = warc_records(table(spark, sf_dir, "pages"))
    return audit(tree(records), tree(damaged(records))).select(
        F.col("record_id").alias("page_id"), "file", "offset", "state")


OP2_SQL = """
WITH r AS (SELECT page_id, floor(page_id / 4096)::BIGINT AS block, 'WARC/1.1' || chr(13) || chr(10) || 'WARC-Type: response'
    || chr(13) || chr(10) || 'WARC-Target-URI: ' || coalesce(url, '') || chr(13) || chr(10)
    || 'WARC-Payload-Digest: sha256:' || sha256(coalesce(html, '')) || chr(13) || chr(10) || 'Content-Length: '
    || octet_length(encode(coalesce(html, ''))) || chr(13) || chr(10) || chr(13) || chr(10) || coalesce(html, '')
    || chr(13) || chr(10) || chr(13) || chr(10) AS content FROM pages),
o AS (SELECT page_id, block, coalesce(sum(octet_length(encode(content))) OVER (PARTITION BY block ORDER BY page_id
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS pos FROM r)
SELECT page_id, printf('pages-%06d-%04d.warc', block, pos // 1073741824) AS file, pos % 1073741824 AS "offset",
    CASE substr(sha256(page_id::VARCHAR), 1, 2) WHEN '00' THEN 'altered' ELSE 'missing' END AS state
FROM o WHERE substr(sha256(page_id::VARCHAR), 1, 2) IN ('00', '01')
"""


def op3_mcd_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality verdict on every document."""
    from lakeops.llm.mcd import judge
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "text")
    return judge(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                              "base_failed", "kept", "distance")


def op4_icws(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The near-duplicate class of every document."""
    from lakeops.llm.icws import near_duplicates
    return near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "class_size")


def op5_host_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    from lakeops.llm.host_paths import extract
    return extract(table(spark, sf_dir, "pages")).select(
        "page_id", "url", "text", F.length("text").cast("long").alias("n_chars"), "path")


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packing of every document; no SQL (needs a tokenizer), tested against a brute-force packing check."""
    from lakeops.llm.packing import pack_documents
    return pack_documents(table(spark, sf_dir, "documents"), tokenizer_path(), keep_ids=False).select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def op8_containment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document that contains a benchmark item, with the item."""
    from lakeops.llm.containment import contained
    return contained(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


OP8_SQL = r"""
WITH w AS (SELECT doc_id, list_filter(string_split_regex(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
b AS (SELECT item_id, list_filter(string_split_regex(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM benchmark),
ds AS (SELECT DISTINCT doc_id, unnest(list_transform(range(1, greatest(len(ws) - 4, 1) + 1),
        lambda i: array_to_string(ws[i:i + 4], ' '))) AS s FROM w WHERE len(ws) > 0),
bs AS (SELECT DISTINCT item_id, unnest(list_transform(range(1, greatest(len(ws) - 4, 1) + 1),
        lambda i: array_to_string(ws[i:i + 4], ' '))) AS s FROM b WHERE len(ws) > 0),
n AS (SELECT item_id, count(*) AS n FROM bs GROUP BY item_id)
SELECT doc_id, item_id, n AS n_shingles, count(*) AS n_found, count(*) / n AS containment
FROM ds JOIN bs USING (s) JOIN n USING (item_id) GROUP BY doc_id, item_id, n HAVING count(*) >= 0.8 * n
"""


def op9_severity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expected toxic severity of every document; no SQL (a fitted model), tested by held-out accuracy."""
    from lakeops.llm.ordinal import fit, grade_labels, predict
    docs = table(spark, sf_dir, "documents")
    return predict(docs, fit(grade_labels(docs, table(spark, sf_dir, "labels"))))


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeated 20-word windows removed from every document."""
    from lakeops.llm.superkmer import remove_repeats
    out = remove_repeats(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every document: base spans and those found by their contexts."""
    from lakeops.llm.pii import digest, find
    return digest(find(table(spark, sf_dir, "documents")))


def op11_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Periodic runs of words in every document, some made periodic; no SQL (too slow on whole tables), tested against brute force."""
    from lakeops.llm.runs import digest, find_runs, planted
    return digest(find_runs(planted(table(spark, sf_dir, "documents"))))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whitened embeddings; no SQL (eigenvectors), tested against brute force."""
    from lakeops.llm.whitening import whiten
    return whiten(table(spark, sf_dir, "embeddings"))


def op13_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's place in the record files of token ids, read back from them; no SQL (needs a tokenizer)."""
    from lakeops.llm.records import positions, write_records
    path = shared_dir(spark, "corpus")
    write_records(table(spark, sf_dir, "documents"), path, tokenizer_path("byte_bpe_50k.json"))
    return positions(spark, path)


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The corpus pipeline over documents."""
    import corpus_pipeline
    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, QueryFn]:
    return {f.__name__: f for f in (op1_bloom_lm, op2_fixity, op3_mcd_outliers, op4_icws, op5_host_paths, op6_packing, op7_substring_dedup, op8_containment, op9_severity, op10_pii,
                                   op11_runs, op12_whitening, op13_records, pipeline)}


def oracle_sql() -> dict[str, str]:
    return {"op2_fixity": OP2_SQL, "op8_containment": OP8_SQL}
