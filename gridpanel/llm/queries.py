"""One registered query per text operator, over its whole table, and its SQL where SQL can express it."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from gridpanel.llm import bpe, conversation_sql, dedup, fingerprints, html_text, jaccard, langid, mixture, private_data, repair, toxicity, trie, urls, warc
from gridpanel.llm.langid import held_out
from gridpanel.llm.registry import ORACLES, QUERIES, query, table

__all__ = ["ORACLES", "QUERIES"]

# The rules the URL query applies.
RULES = (
    urls.Rule("allow", "org", "/"),
    urls.Rule("block", "example.org", "/es/"),
    urls.Rule("block", "example.org", "/en/1"),
    urls.Rule("allow", "com", "/fr/"),
    urls.Rule("block", "com", "/de/"),
)


@query("op1_language_id")
def op1(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    out = held_out(F.col("doc_id"))
    vocabulary = bpe.ranks_of(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    model = langid.train(docs.where(~out), vocabulary)
    told = langid.identify(docs.select("doc_id", "text"), model)
    return told.select("doc_id", out.alias("held_out"), "lang_pred", "score")


# Fixed value: the score from which a text counts as toxic.
TOXIC_FROM = 0.3


@query("op2_toxicity")
def op2(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = held_out(F.col("doc_id"))
    net = toxicity.train(docs, table(spark, sf_dir, "labels").select("doc_id", "toxic").where(~out))
    told = toxicity.score(docs, net)
    return told.select("doc_id", out.alias("held_out"), "score", (F.col("score") >= TOXIC_FROM).cast("int").alias("predicted"))


@query("op3_fingerprints")
def op3(spark, sf_dir):
    return fingerprints.fingerprint_versions(table(spark, sf_dir, "documents").select("doc_id", "text"))


@query("op4_ngram_jaccard")
def op4(spark, sf_dir):
    told = jaccard.components(table(spark, sf_dir, "documents"))
    return told.select("doc_id", "n_shingles", "component_id")


@query(
    "op5_exact_dedup",
    """
    WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
    g AS (SELECT text, max(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY text)
    SELECT t.doc_id, g.keep_id, g.group_size, t.doc_id = g.keep_id AS kept, sha256(t.text) AS text_sha256
    FROM t JOIN g ON g.text = t.text
    """,
)
def op5(spark, sf_dir):
    told = dedup.duplicate_groups(*dedup.split_snapshot(table(spark, sf_dir, "documents")))
    return told.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


@query("op6_private_data")
def op6(spark, sf_dir):
    found = private_data.find(table(spark, sf_dir, "documents").select("doc_id", "text"))
    kinds = F.transform("base", lambda x: x["kind"])
    count = [(F.size(kinds) - F.size(F.array_remove(kinds, k))).cast("long").alias(f"n_{k}") for k in private_data.KINDS]
    base = F.sha2(private_data.listed(F.col("base")), 256).alias("base_sha256")
    return found.select("doc_id", *count, base, private_data.listed(F.col("spans")).alias("spans"))


@query(
    "op7_source_mixture",
    r"""
    WITH d AS (
      SELECT doc_id, source, md5(CAST(doc_id AS VARCHAR)) AS o,
             coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS size FROM documents),
    s AS (
      SELECT source, sum(size)::BIGINT AS source_size,
             row_number() OVER (ORDER BY source IS NULL, source) - 1 AS k FROM d GROUP BY source),
    w AS (SELECT *, CASE k % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS w, source_size * 3.0::DOUBLE AS full_ FROM s),
    p AS (
      SELECT *, full_ / w AS ratio,
             ((SELECT sum(source_size)::DOUBLE FROM s) - coalesce(sum(full_) OVER before, 0))
             / ((SELECT sum(w) FROM w) - coalesce(sum(w) OVER before, 0)) AS level
      FROM w WINDOW before AS (ORDER BY full_ / w, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
    l AS (SELECT arg_min(level, (ratio, k)) AS level FROM p WHERE ratio >= level),
    t AS (SELECT source, source_size, least(full_, coalesce(w * l.level, full_)) AS target FROM p, l),
    b AS (
      SELECT d.doc_id, d.size, t.source_size, t.target, floor(t.target)::BIGINT AS want,
             coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.o, d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS begin_
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
    SELECT doc_id, size, source_size, target,
           (greatest(least(want - begin_, size), 0) + greatest(least(want - source_size - begin_, size), 0)
            + greatest(least(want - 2 * source_size - begin_, size), 0))::BIGINT AS taken
    FROM b
    """,
)
def op7(spark, sf_dir):
    planned = mixture.schedule(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    return planned.select("doc_id", "size", "source_size", "target", "taken")


@query("op8_html_text")
def op8(spark, sf_dir):
    told = html_text.extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return told.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


@query(
    "op9_url_filter",
    r"""
    WITH u AS (SELECT page_id, url, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
    h AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                 regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
    r AS (SELECT page_id, host, path,
      CASE WHEN (host = 'example.org' OR host LIKE '%.example.org') AND starts_with(path, '/en/1') THEN 'example.org/en/1'
           WHEN (host = 'example.org' OR host LIKE '%.example.org') AND starts_with(path, '/es/') THEN 'example.org/es/'
           WHEN (host = 'com' OR host LIKE '%.com') AND starts_with(path, '/fr/') THEN 'com/fr/'
           WHEN (host = 'com' OR host LIKE '%.com') AND starts_with(path, '/de/') THEN 'com/de/'
           WHEN (host = 'org' OR host LIKE '%.org') AND starts_with(path, '/') THEN 'org/' END AS rule FROM h)
    SELECT page_id, host, path, rule, CASE WHEN rule IN ('example.org/en/1', 'example.org/es/', 'com/de/') THEN 'block' ELSE 'allow' END AS verdict FROM r
    """,
)
def op9(spark, sf_dir):
    judged = urls.judge(table(spark, sf_dir, "pages").select("page_id", "url", "html"), RULES)
    return judged.select("page_id", "host", "path", "rule", "verdict")


# Fixed value: the word rule of the byte-level tokenizer file.
WORD_RULE = public_tokenizers.PATTERN


@query("op10_bpe_codec")
def op10(spark, sf_dir):
    path = public_tokenizers.path("byte_bpe_50k.json")
    both = bpe.bpe_codec(table(spark, sf_dir, "documents").select("doc_id", "text"), path, WORD_RULE)
    return both.select(
        "doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.encode("decoded", "UTF-8"), 256).alias("decoded_sha256")
    )


@query("op11_prefix_trie", conversation_sql.TRIE)
def op11(spark, sf_dir):
    return trie.prefix_trie(table(spark, sf_dir, "conversations"))


@query(
    "op12_warc",
    """
    WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages),
    d AS (
      SELECT page_id, html, list_aggregate(list_transform(range(8), lambda i: list_aggregate(list_transform(range(4), lambda j:
               substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((('0x' || substr(h, 5 * i::INT + 1, 5))::INT >> (15 - 5 * j::INT)) & 31) + 1, 1)), 'string_agg', '')), 'string_agg', '') AS digest
      FROM p),
    f AS (SELECT html, min(page_id) AS first FROM d GROUP BY html)
    SELECT page_id, strlen(d.html)::BIGINT AS payload_bytes, digest AS payload_digest,
           CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to
    FROM d JOIN f ON f.html = d.html
    """,
)
def op12(spark, sf_dir):
    told = warc.through_archives(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return told.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query("op13_conversation_repair", conversation_sql.REPAIR)
def op13(spark, sf_dir):
    return repair.repair(repair.damaged(table(spark, sf_dir, "conversations")))
