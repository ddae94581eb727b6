"""One query per operator, over the whole of its table, and its SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession, functions as F

from skylag.llm import (
    chat_format, decontaminate, exact_dedup, jaccard, language_id, licenses, merkle, pii, sentencepiece_bpe, substring_dedup,
    term_pipeline, threshold_topk, warc)
from skylag.llm.tables import reach_workers, read_table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(build):
    """Register a function of (spark, sf_dir) under its own name."""
    @wraps(build)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        reach_workers(spark)
        return build(spark, sf_dir)
    QUERIES[build.__name__] = run
    return build


@query
def op1_sentencepiece(spark, sf_dir):
    return sentencepiece_bpe.summary(read_table(spark, sf_dir, "documents"))


@query
def op2_license_scan(spark, sf_dir):
    found = licenses.scan(read_table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.array_join("rules", ",").alias("rules"),
                        F.array_join("licences", ",").alias("licences"), "sequence")


@query
def op3_decontaminate(spark, sf_dir):
    shards = decontaminate.indexes(read_table(spark, sf_dir, "benchmark"))
    return decontaminate.find(read_table(spark, sf_dir, "documents"), shards)


@query
def op4_ngram_jaccard_join(spark, sf_dir):
    return jaccard.classes(read_table(spark, sf_dir, "documents"))


@query
def op5_substring_dedup(spark, sf_dir):
    return substring_dedup.summary(read_table(spark, sf_dir, "documents"))


@query
def op6_pii(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    found = pii.find(docs, pii.fit(docs))
    counts = {f"n_{kind}": F.regexp_count("base", F.lit(f"{kind}:")).cast("bigint") for kind in pii.KINDS}
    return found.select("doc_id", *[c.alias(n) for n, c in counts.items()], F.sha2("base", 256).alias("base_sha256"), "spans")


@query
def op7_exact_dedup(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents")
    index = exact_dedup.DigestIndex(spark)
    index.add(docs)
    return exact_dedup.decisions(docs, index)


@query
def op8_chat_format(spark, sf_dir):
    turns = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    quoting = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-7, 0, "user", quoting), (-7, 1, "assistant", quoting)], turns.schema)
    return chat_format.read_back(chat_format.format_conversations(turns.unionByName(extra)))


@query
def op9_warc_archive(spark, sf_dir):
    archive = warc.write_archive(read_table(spark, sf_dir, "pages"))
    return warc.read_back(archive)


@query
def op10_language_id(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents")
    predicted = language_id.predict(docs.select("doc_id", "text"), language_id.fit(docs))
    return predicted.select("doc_id", language_id.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


@query
def op11_merkle_manifest(spark, sf_dir):
    return merkle.verify(merkle.build(read_table(spark, sf_dir, "documents"), merkle.tampered_leaf()))


@query
def op12_ranked_search(spark, sf_dir):
    return term_pipeline.rank(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


@query
def op13_exact_topk(spark, sf_dir):
    return threshold_topk.search(read_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def _license_sql() -> str:
    known = ", ".join(f"('{text}', '{code}')" for text, code in licenses.known_sentences().items())
    rules = ", ".join(f"('{codes}', '{rule}', '{licence}')" for rule, licence, codes in licenses.RULES)
    pattern = "|".join(codes for _, _, codes in licenses.RULES)
    text = "text"
    for was, now in ((licenses.CONTINUED, r"\1 \2"), (licenses.CONTINUED_CAPITALS, r"\1 \2"), (licenses.ENDS, "\\1\n")):
        text = f"regexp_replace({text}, '{was}', '{now}', 'g')"
    return f"""
WITH known(sentence, code) AS (VALUES {known}),
rules(codes, rule, licence) AS (VALUES {rules}),
pieces AS (SELECT doc_id, unnest(string_split({text}, '\n')) AS s, generate_subscripts(string_split({text}, '\n'), 1) AS place
           FROM documents),
found AS (SELECT doc_id, place, code FROM pieces
          JOIN known ON trim(regexp_replace(lower(s), '{licenses.DROPPED}', ' ', 'g')) = sentence),
gaps AS (SELECT doc_id, place, code, place - lag(place) OVER (PARTITION BY doc_id ORDER BY place) > {licenses.MAX_GAP + 1} AS gap FROM found),
sequences AS (SELECT doc_id, string_agg(CASE WHEN gap THEN '{licenses.GAP}' ELSE '' END || code, '' ORDER BY place) AS sequence
              FROM gaps GROUP BY doc_id),
matched AS (SELECT doc_id, sequence, unnest(regexp_extract_all(sequence, '{pattern}')) AS codes,
                   generate_subscripts(regexp_extract_all(sequence, '{pattern}'), 1) AS k FROM sequences)
SELECT doc_id, string_agg(rule, ',' ORDER BY k) AS rules, string_agg(licence, ',' ORDER BY k) AS licences, sequence
FROM matched JOIN rules USING (codes) GROUP BY doc_id, sequence"""


ORACLE["op2_license_scan"] = _license_sql()

ORACLE["op7_exact_dedup"] = r"""
WITH digests AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents),
sized AS (SELECT doc_id, text_sha256, min(doc_id) OVER (PARTITION BY text_sha256) AS keep_id,
                 count(*) OVER (PARTITION BY text_sha256) AS group_size FROM digests)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM sized"""

ORACLE["op9_warc_archive"] = """
WITH facts AS (SELECT page_id, sha1(coalesce(html, '')) AS payload_digest, strlen(coalesce(html, '')) AS payload_bytes FROM pages),
kept AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS keeper FROM facts)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 1000 AND page_id <> keeper THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 1000 AND page_id <> keeper THEN keeper END AS refers_to
FROM kept"""

ORACLE["op8_chat_format"] = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')),
sized AS (
  SELECT *, length(text) + length(text) - length(regexp_replace(text, '[\\<\[]', '', 'g'))
            + CASE role WHEN 'user' THEN 15 WHEN 'assistant' THEN 4 WHEN 'system' THEN 15
              ELSE 13 + length(role) + length(role) - length(regexp_replace(role, '[\\<>\[]', '', 'g')) END AS formatted
  FROM turns)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(3 + sum(formatted) AS BIGINT) AS formatted_chars
FROM sized GROUP BY conv_id"""

def _leaf_sql(text: str) -> str:
    parts = [f"coalesce(strlen(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR), '-')" for c in ("doc_id", "source", "lang", "n_chars", text)]
    return f"sha256({' || '.join(parts)})"


# The last bit of the CRC-32 is the complement of its register's.
_TAMPERED = """xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT),
    list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT))),
    lambda a, b: list_reduce(list_prepend(xor(a, b), CAST(range(8) AS BIGINT[])),
                             lambda x, i: xor(x >> 1, 3988292384 * (x & 1)))), 1) & 1"""


def _walk_sql(name: str, start: str, runs: str) -> str:
    """From a node (i of n) up to where one is left: its digest folded and the siblings met."""
    return f"""{name}(doc_id, tree, i, n, level, h, proof) AS (
  {start}
  UNION ALL
  SELECT w.doc_id, w.tree, w.i // 3, (w.n + 2) // 3, w.level + 1,
         sha256(array_to_string(r.hs[1:w.i % 3], '') || w.h || array_to_string(r.hs[w.i % 3 + 2:], '')),
         w.proof || array_to_string(r.hs[1:w.i % 3], '') || array_to_string(r.hs[w.i % 3 + 2:], '')
  FROM {name} w JOIN {runs} r ON r.tree IS NOT DISTINCT FROM w.tree AND r.level = w.level AND r.k = w.i // 3 WHERE w.n > 1)"""


def _tree_sql(name: str, start: str) -> str:
    return f"""{name}(tree, level, i, n, h) AS (
  {start}
  UNION ALL
  SELECT tree, level + 1, i // 3, (n + 2) // 3, sha256(string_agg(h, '' ORDER BY i)) FROM {name} WHERE n > 1
  GROUP BY tree, level, i // 3, n),
{name}_runs AS (SELECT tree, level, i // 3 AS k, list(h ORDER BY i) AS hs FROM {name} WHERE n > 1 GROUP BY tree, level, i // 3)"""


ORACLE["op11_merkle_manifest"] = f"""
WITH RECURSIVE leaves AS (
  SELECT doc_id, source AS tree, {_leaf_sql("text")} AS leaf, {_leaf_sql("replace(text, chr(10), '')")} AS bare, {_TAMPERED} AS bit FROM documents),
numbered AS (
  SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY tree) AS n FROM leaves),
{_tree_sql("nodes", "SELECT tree, 0, i, n, leaf FROM numbered")},
subroots AS (
  SELECT tree, h, row_number() OVER (ORDER BY tree NULLS FIRST) - 1 AS i, count(*) OVER () AS n FROM nodes WHERE n = 1),
{_tree_sql("top", "SELECT '' AS tree, 0, i, n, h FROM subroots")},
{_walk_sql("low", "SELECT doc_id, tree, i, n, 0, CASE bit WHEN 0 THEN bare ELSE leaf END, '' FROM numbered", "nodes_runs")},
{_walk_sql("high", "SELECT w.doc_id, '', s.i, s.n, 0, w.h, w.proof FROM low w JOIN subroots s ON s.tree IS NOT DISTINCT FROM w.tree WHERE w.n = 1", "top_runs")}
SELECT n.doc_id, n.leaf, s.h AS subroot, t.h AS root, sha256(w.proof) AS proof_sha256, w.h AS folded_root, w.h = t.h AS verified
FROM numbered n JOIN subroots s ON s.tree IS NOT DISTINCT FROM n.tree JOIN high w ON w.doc_id = n.doc_id AND w.n = 1
JOIN top t ON t.n = 1"""

_TERMS = r"""regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"""

ORACLE["op12_ranked_search"] = f"""
WITH words AS (SELECT doc_id, {_TERMS} AS terms FROM documents),
sized AS (SELECT doc_id, terms, len(terms) AS n FROM words WHERE len(terms) > 0),
total AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS words FROM sized),
asked AS (SELECT DISTINCT item_id, unnest({_TERMS}) AS term FROM benchmark),
occurring AS (SELECT doc_id, n, unnest(terms) AS term FROM sized),
counted AS (SELECT doc_id, n, term, count(*) AS tf FROM occurring WHERE term IN (SELECT term FROM asked) GROUP BY doc_id, n, term),
weighted AS (SELECT term, CAST(floor(1000 * ln((2 * docs + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM counted, total GROUP BY term, docs),
scored AS (
  SELECT item_id, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + (90 * n * docs) // words)))) AS BIGINT) AS score
  FROM asked JOIN weighted USING (term) JOIN counted USING (term), total GROUP BY item_id, doc_id)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score
FROM scored WHERE score > 0 QUALIFY rank <= 10"""

ORACLE["op13_exact_topk"] = """
WITH taken AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)
SELECT q.vec_id AS query_id, CAST(row_number() OVER (PARTITION BY q.vec_id ORDER BY list_inner_product(q.v, c.v) DESC, c.vec_id) AS INTEGER) AS rank,
       c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
FROM taken q JOIN taken c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0 QUALIFY rank <= 10"""
