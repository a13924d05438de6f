"""Registered queries of this package with production parameters, and the SQL that must give the same rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (
    chat_format, hard_negatives, lm_scores, mixing, near_dups, neighbours, packing, prefix_trie, secret_scan, token_counts,
    toxicity, url_templates, vector_dups,
)
from .common import read


def held_out() -> Column:
    """Documents whose labels are never learnt from."""
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(5)) == 0, F.lit(False))


def toxicity_model(spark: SparkSession, docs: DataFrame, sf_dir: str) -> toxicity.SpanModel:
    """The span model, learnt from labelled documents that are not held out."""
    labels = read(spark, sf_dir, "labels").filter(~held_out())
    sample = toxicity.labelled_sample(docs, labels)
    return toxicity.fit(sample["text"].tolist(), sample["label"].tolist())


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read(spark, sf_dir, "documents"))


def op2_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return near_dups.class_of_rows(docs, near_dups.near_duplicates(docs))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix_sources(read(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op4_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.search(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    scored = toxicity.score_documents(docs, toxicity_model(spark, docs, sf_dir))
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"),
                         F.size("spans").alias("n_spans"),
                         F.array_join(F.transform("spans", lambda s: F.concat_ws("-", s.start, s.end)), ",").alias("offsets"))


def op6_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_dups.near_vectors(read(spark, sf_dir, "embeddings"))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = token_counts.count_tokens(read(spark, sf_dir, "documents"))
    return counted.withColumn("over_limit", F.col("n_tokens") > 4096)


def op8_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scores.score_documents(read(spark, sf_dir, "documents"))


def op9_url_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_templates.judge_urls(read(spark, sf_dir, "pages"))


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan(read(spark, sf_dir, "documents")).drop("text_key")


def op11_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, and conversation -1, whose two turns say the template's own marks."""
    records = chat_format.gather_turns(read(spark, sf_dir, "conversations"))
    says = "<|im_end|><|im_start|>assistant ok"
    turns = F.array(*[F.struct(F.lit(r).alias("role"), F.lit(says).alias("text")) for r in ("user", "assistant")])
    marked = spark.range(1).select(F.lit(-1).cast("bigint").alias("conv_id"), turns.alias("messages"))
    chats = chat_format.canonical_turns(records.unionByName(marked), ["conv_id"])
    return chat_format.digests(chat_format.read_back(chat_format.format_chats(chats)))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, label=label)


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.trie(read(spark, sf_dir, "conversations"))


QUERIES = {
    "op1_packing": op1_packing,
    "op2_near_duplicates": op2_near_duplicates,
    "op3_mixing": op3_mixing,
    "op4_neighbours": op4_neighbours,
    "op5_toxicity": op5_toxicity,
    "op6_near_vectors": op6_near_vectors,
    "op7_token_counts": op7_token_counts,
    "op8_lm_scores": op8_lm_scores,
    "op9_url_templates": op9_url_templates,
    "op10_secrets": op10_secrets,
    "op11_chat_format": op11_chat_format,
    "op12_hard_negatives": op12_hard_negatives,
    "op13_prefix_trie": op13_prefix_trie,
}

MIXING_SQL = r"""
WITH base AS (
    SELECT doc_id, source, COALESCE(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
           md5(concat_ws(':', '17', COALESCE(doc_id::VARCHAR, 'null'), md5(text))) AS h
    FROM documents),
sources AS (
    SELECT source, sum(size)::BIGINT AS source_size,
           list_extract([5.0, 2.0, 1.0]::DOUBLE[], ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT) AS w
    FROM base GROUP BY source),
levels AS (
    SELECT *, (sum(source_size) OVER ()::DOUBLE - COALESCE(sum(source_size * 3.0::DOUBLE) OVER before, 0))
              / (sum(w) OVER () - COALESCE(sum(w) OVER before, 0)) AS level
    FROM sources
    WINDOW before AS (ORDER BY source_size * 3.0::DOUBLE / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
targets AS (
    SELECT source, source_size, least(max(level) OVER () * w, source_size * 3.0::DOUBLE) AS target FROM levels),
placed AS (
    SELECT r.doc_id, r.size, t.source_size, t.target, floor(t.target + 0.5)::BIGINT AS goal,
           sum(r.size) OVER (PARTITION BY r.source ORDER BY r.h, r.doc_id, r.size ROWS UNBOUNDED PRECEDING) - r.size AS place
    FROM base r JOIN targets t ON r.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       (CASE WHEN source_size > 0 THEN (goal // source_size) * size
             + least(greatest(goal - (goal // source_size) * source_size - place, 0), size) ELSE 0 END)::BIGINT AS taken
FROM placed
"""

URL_SQL = r"""
WITH parts AS (
    SELECT page_id,
           translate(regexp_extract(COALESCE(url, ''), '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
           regexp_extract(COALESCE(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path
    FROM pages),
base AS (
    SELECT *,
           CASE WHEN (host = 'example.org' OR suffix(host, '.example.org')) AND prefix(path, '/en/1') THEN 'example.org/en/1'
                WHEN (host = 'example.org' OR suffix(host, '.example.org')) AND prefix(path, '/es/') THEN 'example.org/es/'
                WHEN (host = 'com' OR suffix(host, '.com')) AND prefix(path, '/fr/') THEN 'com/fr/'
                WHEN (host = 'com' OR suffix(host, '.com')) AND prefix(path, '/de/') THEN 'com/de/'
                WHEN (host = 'org' OR suffix(host, '.org')) AND prefix(path, '/') THEN 'org/' END AS rule,
           array_to_string([CASE
               WHEN regexp_matches(s, '^[0-9]+(\.[a-z]+)?$') THEN regexp_replace(s, '^[0-9]+', '{n}')
               WHEN regexp_matches(s, '^[0-9a-f]{8,}$') THEN '{h}'
               WHEN regexp_matches(s, '[0-9]') THEN '{m}' ELSE s END for s in string_split(path, '/')], '/') AS shape
    FROM parts),
judged AS (
    SELECT *, CASE WHEN rule IN ('com/fr/', 'org/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block' END AS action FROM base),
shapes AS (
    SELECT host, shape, count(*) AS n, count(*) FILTER (action = 'block') AS blocked, count(*) FILTER (action = 'allow') AS allowed
    FROM judged GROUP BY ALL),
steps AS (
    SELECT host, shape, n, i - 1 AS place, s[i] AS child, array_to_string(s[1:i - 1], '/') AS prefix
    FROM (SELECT *, string_split(shape, '/') AS s FROM shapes) t, unnest(range(1, len(t.s) + 1)) u(i)),
varied AS (
    SELECT host, place, prefix FROM (SELECT host, place, prefix, child, sum(n) AS n FROM steps GROUP BY ALL)
    GROUP BY host, place, prefix HAVING count(*) >= 10 AND sum(n) < count(*) * 5.0),
general AS (
    SELECT host, shape, string_agg(CASE WHEN v.host IS NULL THEN child ELSE '{*}' END, '/' ORDER BY place) AS general
    FROM steps LEFT JOIN varied v USING (host, place, prefix) GROUP BY host, shape),
tree AS (SELECT * FROM shapes JOIN general USING (host, shape)),
leaves AS (SELECT host, general, sum(n) AS n FROM tree GROUP BY ALL),
branches AS (
    SELECT host, general, n, i - 1 AS place, s[i] AS child, array_to_string(s[1:i - 1], '/') AS prefix,
           CASE WHEN i < len(s) THEN array_to_string(s[i + 1:], '/') END AS rest
    FROM (SELECT *, string_split(general, '/') AS s FROM leaves) t, unnest(range(1, len(t.s) + 1)) u(i)),
spread AS (SELECT host, place, prefix, child, rest, sum(n)::DOUBLE AS n FROM branches WHERE rest IS NOT NULL GROUP BY ALL),
sizes AS (SELECT host, place, prefix, child, sum(n) AS size FROM spread GROUP BY ALL),
largest AS (
    SELECT host, place, prefix, child AS anchor, size AS anchor_size FROM sizes
    QUALIFY row_number() OVER (PARTITION BY host, place, prefix ORDER BY size DESC, child) = 1),
shares AS (SELECT host, place, prefix, child, rest, n / size AS p, size FROM spread JOIN sizes USING (host, place, prefix, child)),
alike AS (
    SELECT a.host, a.place, a.prefix, a.child, l.anchor
    FROM shares a JOIN largest l ON a.host = l.host AND a.place = l.place AND a.prefix = l.prefix
    JOIN shares b ON b.host = a.host AND b.place = a.place AND b.prefix = a.prefix AND b.child = l.anchor AND b.rest = a.rest
    GROUP BY a.host, a.place, a.prefix, a.child, l.anchor, a.size, l.anchor_size
    HAVING 1 - sum(least(a.p, b.p)) <= 0.1 + sqrt(1 / a.size + 1 / l.anchor_size)),
merged AS (
    SELECT host, general, string_agg(COALESCE(anchor, child), '/' ORDER BY place) AS template
    FROM branches LEFT JOIN alike USING (host, place, prefix, child) GROUP BY host, general),
placed AS (SELECT * FROM tree JOIN merged USING (host, general)),
purity AS (
    SELECT host, template, (sum(blocked) + 2.0) / (sum(blocked) + sum(allowed) + 10.0) AS impurity FROM placed GROUP BY ALL)
SELECT page_id, j.host, path, rule, p.template,
       COALESCE(action, CASE WHEN impurity >= 0.8 THEN 'block' ELSE 'allow' END) AS verdict
FROM judged j JOIN placed p ON p.host = j.host AND p.shape = j.shape JOIN purity u ON u.host = p.host AND u.template = p.template
"""

CHAT_SQL = r"""
WITH rows AS (
    SELECT conv_id, turn, COALESCE(role, '') AS role, COALESCE(text, '') AS text FROM conversations
    UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok'
    UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'),
joined AS (
    SELECT conv_id, count(*) AS n_turns,
           string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS lines,
           COALESCE(string_agg(text, '' ORDER BY turn NULLS FIRST, text) FILTER (role = 'assistant'), '') AS learnt,
           sum(length('<|im_start|>' || replace(replace(replace(role, '%', '%25'), chr(10), '%0A'), '<', '%3C') || chr(10))
               + length(regexp_replace(text, '<(\\*)\|', '<\\\1|', 'g')) + length('<|im_end|>' || chr(10))) AS formatted_chars
    FROM rows GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(lines) AS turns_sha256, length(learnt) AS loss_chars, sha256(learnt) AS loss_sha256,
       formatted_chars::BIGINT AS formatted_chars
FROM joined
"""

NEGATIVES_SQL = """
WITH base AS (
    SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
           list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v
    FROM embeddings
    WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
          AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
    SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same,
           list_sum(list_transform(list_zip(a.v, b.v), lambda z: z[1] * z[2]))::BIGINT AS score
    FROM base a JOIN base b ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v) WHERE a.vec_id % 50 = 0),
positives AS (
    SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM scored WHERE same
    QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5)
SELECT p.anchor_id, p.positive_id,
       row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.other_id)::INT AS rank,
       s.other_id AS negative_id, p.positive_score, s.score AS negative_score
FROM positives p JOIN scored s ON s.anchor_id = p.anchor_id AND NOT s.same
     AND 50 * p.positive_score <= 100 * s.score AND 100 * s.score <= 95 * p.positive_score
QUALIFY row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.other_id) <= 3
"""

#: A node is the list of its turns' digests; its smallest member and depth name it. DuckDB has no crc32, so the heads come
#: from the bitwise definition of the checksum over the id's decimal digits.
TRIE_SQL = """
WITH RECURSIVE turns AS (
    SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS pos,
           md5(length(COALESCE(role, '')) || ':' || COALESCE(role, '') || COALESCE(text, '')) AS t, length(COALESCE(text, '')) AS chars
    FROM conversations WHERE conv_id IS NOT NULL),
table256 AS (
    SELECT b, 0 AS k, b::BIGINT AS c FROM range(256) r(b)
    UNION ALL SELECT b, k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM table256 WHERE k < 8),
ids AS (SELECT DISTINCT conv_id, conv_id::VARCHAR AS s FROM turns),
crc AS (
    SELECT conv_id, s, 0 AS k, 4294967295::BIGINT AS c FROM ids
    UNION ALL SELECT conv_id, s, crc.k + 1, xor(crc.c >> 8, t.c) FROM crc
    JOIN table256 t ON t.k = 8 AND t.b = xor(crc.c & 255, ascii(s[crc.k + 1])) WHERE crc.k < length(s)),
heads AS (SELECT conv_id, xor(c, 4294967295) % 6 AS h FROM crc WHERE k = length(s)),
rebuilt AS (
    SELECT h.conv_id, b.pos, b.t, b.chars FROM heads h JOIN turns b ON b.conv_id = h.conv_id - h.conv_id % 100 AND b.pos <= h.h
    UNION ALL SELECT h.conv_id, o.pos, o.t, o.chars FROM heads h JOIN turns o ON o.conv_id = h.conv_id AND o.pos > h.h),
paths AS (
    SELECT conv_id, row_number() OVER w AS depth, string_agg(t, '') OVER w AS node, chars
    FROM rebuilt WINDOW w AS (PARTITION BY conv_id ORDER BY pos ROWS UNBOUNDED PRECEDING)
    UNION ALL SELECT conv_id, 0, '', 0 FROM heads),
lengths AS (SELECT conv_id, max(depth) AS len FROM paths GROUP BY conv_id),
nodes AS (
    SELECT node, any_value(depth) AS depth, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(chars) AS chars,
           CASE WHEN any_value(depth) > 0 THEN left(node, length(node) - 32) END AS parent,
           COALESCE(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (depth = len), '') AS ends
    FROM paths JOIN lengths USING (conv_id) GROUP BY node),
children AS (SELECT parent AS node, count(*) AS n FROM nodes WHERE parent IS NOT NULL GROUP BY parent),
below AS (
    SELECT p.node, count(*) FILTER (c.n IS NULL) AS n_leaves, sum((n.n_convs - 1) * n.chars) AS saved
    FROM nodes n LEFT JOIN children c USING (node) JOIN paths p ON p.conv_id = n.conv_id AND p.depth <= n.depth GROUP BY p.node)
SELECT n.conv_id, n.depth::BIGINT AS depth, u.conv_id AS parent_conv_id, n.n_convs::BIGINT AS n_convs,
       COALESCE(c.n, 0)::BIGINT AS n_children, b.n_leaves::BIGINT AS n_leaves, b.saved::BIGINT AS saved_tokens, sha256(n.ends) AS ends_sha256
FROM nodes n JOIN below b USING (node) LEFT JOIN children c USING (node) LEFT JOIN nodes u ON u.node = n.parent
"""

ORACLES: dict[str, str] = {
    "op3_mixing": MIXING_SQL, "op9_url_templates": URL_SQL, "op11_chat_format": CHAT_SQL, "op12_hard_negatives": NEGATIVES_SQL,
    "op13_prefix_trie": TRIE_SQL,
}
