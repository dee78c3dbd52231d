"""The text operators' queries over the whole tables, with SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline
from spanwise.llm import chat, decontam, filter_audit, html_extract, langid, media, mixing, quality, secret_scan, simhash, token_counts, toxicity, whiten
from spanwise.llm.common import table


def op1_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.secret_spans(table(spark, sf_dir, "documents"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract_pages(table(spark, sf_dir, "pages"))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_components(table(spark, sf_dir, "documents"))


def op8_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_by_source(table(spark, sf_dir, "documents"))


def op10_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_digests(table(spark, sf_dir, "documents"))


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten.whiten(table(spark, sf_dir, "embeddings"))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.filter_audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op13_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.chat_digests(chat.with_probe(table(spark, sf_dir, "conversations")))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (op1_secrets, op2_toxicity, op3_html, op4_quality, op5_decontamination, op6_language, op7_simhash, op8_tokens, op9_mixing, op10_media, op11_whitening, op12_filter_audit, op13_chat)
    return {f.__name__: f for f in found} | {"pipeline": corpus_pipeline.run}


#: SQL for what SQL can express. Models, compression, flows and seeded choices, shingle hashes and images it can't; tests
#: hold those against brute force.
_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

SQL: dict[str, str] = {
    "op5_decontamination": f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT cast(item_id AS varchar) AS item, w, least(13, len(w)) AS n FROM (SELECT item_id, {_WORDS} AS w FROM benchmark) WHERE len(w) > 0),
runs AS (SELECT DISTINCT item, n, array_to_string(w[i : i + n - 1], ' ') AS run FROM (SELECT *, unnest(range(1, len(w) - n + 2)) AS i FROM b)),
places AS (SELECT rid, n, i, array_to_string(w[i : i + n - 1], ' ') AS run FROM (SELECT d.*, l.n, unnest(range(1, len(w) - l.n + 2)) AS i FROM d CROSS JOIN (SELECT DISTINCT n FROM runs) l)),
found AS (SELECT p.rid, p.n, p.i, r.item FROM places p JOIN runs r ON r.n = p.n AND r.run = p.run),
hits AS (SELECT rid, count(DISTINCT word) AS n_hit FROM (SELECT rid, unnest(range(i, i + n)) AS word FROM found) GROUP BY 1),
items AS (SELECT rid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS listed FROM (SELECT DISTINCT rid, item FROM found WHERE item IS NOT NULL) GROUP BY 1)
SELECT doc_id, cast(len(w) AS bigint) AS n_words, cast(coalesce(n_hit, 0) AS bigint) AS n_hit, cast(coalesce(n_items, 0) AS bigint) AS n_items, sha256(coalesce(listed, '')) AS items_sha256,
    coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN hits USING (rid) LEFT JOIN items USING (rid)
""",
    "op12_filter_audit": r"""
WITH d AS (
    SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, [x FOR x IN regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+') IF x <> ''] AS w,
        min(doc_id) OVER (PARTITION BY coalesce(text, '')) AS least FROM documents),
l AS (SELECT doc_id, max(cast(quality = 1 AS int)) AS good, max(cast(toxic = 1 AS int)) AS bad FROM labels GROUP BY 1),
f AS (SELECT part, [len(w) < 200, 100 * len(list_distinct(w)) < 50 * len(w), 100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > 2 * length(t),
    regexp_matches(t, '[#$%&*|]'), coalesce(doc_id > least, false)] AS fails, coalesce(good, 0) AS good, coalesce(bad, 0) AS bad FROM d LEFT JOIN l USING (doc_id)),
cells AS (SELECT part, fails, count(*) AS n, sum(good) AS good, sum(bad) AS bad FROM f GROUP BY ALL),
five AS (SELECT unnest([1, 2, 3, 4, 5]) AS k),
orders AS (SELECT [a.k, b.k, c.k, d.k, e.k] AS o FROM five a, five b, five c, five d, five e WHERE len(list_distinct([a.k, b.k, c.k, d.k, e.k])) = 5),
steps AS (SELECT o, array_to_string([substr('ABCDE', x, 1) FOR x IN o], '') AS filter_order, s.k AS step, o[s.k] AS here, o[1 : s.k - 1] AS before FROM orders, five s),
each AS (SELECT part, filter_order, step, here, n, good, bad, fails[here] AS hit, len([x FOR x IN before IF fails[x]]) > 0 AS gone,
    len([x FOR x IN fails IF x]) = 1 AS alone FROM steps, cells),
sums AS (SELECT part, filter_order, step, here, sum(CASE WHEN NOT hit AND NOT gone THEN n ELSE 0 END) AS kept, sum(CASE WHEN hit AND NOT gone THEN n ELSE 0 END) AS removed,
    sum(CASE WHEN hit AND gone THEN n ELSE 0 END) AS redundant, sum(CASE WHEN hit AND alone THEN n ELSE 0 END) AS unique_fails,
    sum(CASE WHEN hit AND NOT gone THEN good ELSE 0 END) AS good_lost, sum(CASE WHEN hit AND NOT gone THEN bad ELSE 0 END) AS toxic_lost FROM each GROUP BY ALL)
SELECT part, filter_order, cast(step AS int) AS step, cast(kept AS bigint) AS kept, cast(removed AS bigint) AS removed, cast(redundant AS bigint) AS redundant, cast(unique_fails AS bigint) AS unique_fails,
    cast(good_lost AS bigint) AS good_lost, cast(toxic_lost AS bigint) AS toxic_lost, cast(sum(removed) OVER (PARTITION BY part, here) AS bigint) AS shapley FROM sums
""",
    "op13_chat": r"""
WITH c AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
t AS (
    SELECT *, length(text) + length(regexp_replace(text, '[^\\\[\]<]', '', 'g')) AS n_text,
        CASE role WHEN 'system' THEN 8 + 10 WHEN 'user' THEN 7 + 8 WHEN 'assistant' THEN 3 + 4 ELSE 6 + length(role) + length(regexp_replace(role, '[^\\\[\]<]', '', 'g')) + 1 + 7 END AS n_marks,
        row_number() OVER w AS pos, lag(role) OVER w AS prev FROM c WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)),
s AS (SELECT *, CASE WHEN role = 'system' THEN pos = 1 WHEN role = 'user' THEN pos = 1 OR prev IN ('system', 'assistant') WHEN role = 'assistant' THEN pos > 1 AND prev = 'user' ELSE false END AS legal FROM t),
g AS (
    SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY pos)) AS turns_sha256,
        coalesce(string_agg(text, '' ORDER BY pos) FILTER (role = 'assistant'), '') AS learned, cast(sum(n_text + n_marks) AS bigint) AS formatted_chars,
        bool_and(legal) AS valid, arg_max(role, pos) = 'assistant' AS ended, arg_min(turn, pos) FILTER (NOT legal) AS wrong_turn FROM s GROUP BY conv_id)
SELECT conv_id, n_turns, turns_sha256, cast(length(learned) AS bigint) AS loss_chars, sha256(learned) AS loss_sha256, formatted_chars, valid, valid AND ended AS complete, wrong_turn FROM g
""",
}
