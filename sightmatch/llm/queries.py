"""The registered query of each operator, with the parameters meant for production."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sightmatch.llm import (
    bpe,
    ego,
    exact_dedup,
    langid,
    merkle,
    minhash,
    mixing,
    packing,
    ppm,
    prefix_trie,
    quality,
    sharding,
    token_counts,
)

MULTI = ("ranks", public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
ENGLISH = ("json", public_tokenizers.path("byte_bpe_50k.json"))
PIECES = public_tokenizers.path("piece_bpe_32k.model")
#: Bytes of text in a shard.
SHARD_BYTES = 4 << 20


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.group_copies(_documents(spark, sf_dir))


OP1_SQL = r"""
WITH d AS (
 SELECT doc_id, length(coalesce(text, '')) AS n_points,
        regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS clean
 FROM documents)
SELECT doc_id,
       first_value(doc_id) OVER (PARTITION BY clean ORDER BY n_points DESC, doc_id) AS keep_id,
       count(*) OVER (PARTITION BY clean) AS group_size,
       row_number() OVER (PARTITION BY clean ORDER BY n_points DESC, doc_id) = 1 AS kept,
       sha256(clean) AS text_sha256
FROM d
"""


def _in_fold(modulus: int, fold: int):
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % modulus == fold


def op2_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ppm.score(_documents(spark, sf_dir), held_out=_in_fold(7, 2))


def op3_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(_documents(spark, sf_dir), words=3, threshold=(85, 100))


OP3_SQL = r"""
WITH RECURSIVE w AS (
 SELECT doc_id, list_filter(string_split_regex(
          translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
          '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words
 FROM documents),
sets AS (
 SELECT doc_id, CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 3 THEN [array_to_string(words, ' ')]
          ELSE list_distinct([array_to_string(words[i:i+2], ' ') for i in range(1, len(words) - 1)]) END AS s
 FROM w),
flat AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM sets),
pairs AS (
 SELECT a.doc_id AS x, b.doc_id AS y, a.n + b.n - count(*) AS total, count(*) AS common
 FROM flat a JOIN flat b ON a.g = b.g AND a.doc_id < b.doc_id AND a.n * 100 >= b.n * 85 AND b.n * 100 >= a.n * 85
 GROUP BY a.doc_id, b.doc_id, a.n, b.n),
links AS (SELECT x, y FROM pairs WHERE 100 * common >= 85 * total
          UNION ALL SELECT y, x FROM pairs WHERE 100 * common >= 85 * total),
reach AS (SELECT doc_id AS node, doc_id AS other FROM documents
          UNION SELECT r.node, l.y FROM reach r JOIN links l ON r.other = l.x)
SELECT s.doc_id, CAST(len(s) AS BIGINT) AS n_shingles, min(other) AS component_id,
       s.doc_id = min(other) AS kept
FROM sets s JOIN reach r ON r.node = s.doc_id GROUP BY s.doc_id, len(s)
"""


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    held_out = _in_fold(5, 0)
    model = langid.fit(docs, learn=~held_out)
    return langid.predict(docs, model).withColumn("held_out", held_out)


def trusted_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of the documents labelled as good."""
    return spark.read.parquet(f"{sf_dir}/labels.parquet").filter("quality = 1").select("doc_id")


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(_documents(spark, sf_dir), trusted_ids(spark, sf_dir))


def op6_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ego.near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


OP6_SQL = """
WITH RECURSIVE e AS (
 SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
 WHERE label IS NOT NULL AND list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[])) > 0),
links AS (
 SELECT a.vec_id AS x, b.vec_id AS y FROM e a JOIN e b ON a.label = b.label AND a.vec_id <> b.vec_id
 WHERE list_dot_product(a.v, b.v) >= 0.98 * sqrt(list_dot_product(a.v, a.v) * list_dot_product(b.v, b.v))),
reach AS (SELECT vec_id AS node, vec_id AS other FROM embeddings
          UNION SELECT r.node, l.y FROM reach r JOIN links l ON r.other = l.x),
n AS (SELECT x, count(*) AS n_links FROM links GROUP BY x)
SELECT m.vec_id, coalesce(n.n_links, 0) AS n_links, min(r.other) AS component_id,
       m.vec_id = min(r.other) AS kept
FROM embeddings m JOIN reach r ON r.node = m.vec_id LEFT JOIN n ON n.x = m.vec_id
GROUP BY m.vec_id, n.n_links
"""


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode(_documents(spark, sf_dir), MULTI, decoded=True).select(
        "doc_id",
        "n_tokens",
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(_documents(spark, sf_dir), PIECES)


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign_shards(_documents(spark, sf_dir), SHARD_BYTES)


OP9_SQL = f"""
WITH d AS (
 SELECT doc_id, CAST(strlen(coalesce(text, '')) AS BIGINT) AS n_bytes,
        lpad(bin(CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 15) AS BIGINT)),
             60, '0') AS bits
 FROM documents),
start AS (
 SELECT CASE WHEN sum(n_bytes) > {SHARD_BYTES}
             THEN CAST(floor(log2(sum(n_bytes) / {SHARD_BYTES}.0)) AS INTEGER) ELSE 0 END AS first_depth
 FROM d),
every AS (
 SELECT d.*, CAST(depth AS INTEGER) AS depth, substr(bits, 1, depth) AS shard
 FROM d, start, unnest(range(0, 61)) AS t(depth) WHERE depth >= first_depth),
sized AS (
 SELECT *, sum(n_bytes) OVER (PARTITION BY depth, shard) AS shard_bytes,
        count(*) OVER (PARTITION BY depth, shard) AS shard_docs
 FROM every)
SELECT doc_id, n_bytes, shard, depth, CAST(shard_bytes AS BIGINT) AS shard_bytes, shard_docs
FROM sized WHERE shard_bytes <= {SHARD_BYTES} OR shard_docs = 1
QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY depth) = 1
"""


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_documents(spark, sf_dir), ENGLISH)


def op11_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_documents(spark, sf_dir))


OP11_SQL = r"""
WITH RECURSIVE d AS (
 SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
        (CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 13) AS BIGINT) + 0.5::DOUBLE)
          / 4503599627370496::DOUBLE AS random
 FROM documents),
sources AS (
 SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
        row_number() OVER (ORDER BY source NULLS LAST) AS source_no FROM d GROUP BY source),
weighed AS (
 SELECT *, 1 + (source_no - 1) % 3 AS weight, 3 * source_size AS cap,
        sum(source_size) OVER () AS total FROM sources),
levels AS (
 SELECT 0 AS k, 0::DOUBLE AS level
 UNION ALL
 SELECT k + 1, (any_value(total) - sum(CASE WHEN level * weight > cap THEN cap ELSE 0 END))::DOUBLE
               / sum(CASE WHEN level * weight > cap THEN 0 ELSE weight END)::DOUBLE
 FROM levels, weighed WHERE k < 60 GROUP BY k, level),
targets AS (
 SELECT source, source_no, source_size,
        least((SELECT level FROM levels WHERE k = 60) * weight, cap::DOUBLE) AS target FROM weighed),
rows AS (
 SELECT d.doc_id, d.size, d.random, t.source_no, t.source_size, t.target,
        CASE WHEN t.source_size > 0 THEN least(t.target / t.source_size::DOUBLE, 3::DOUBLE) ELSE 0 END AS copies
 FROM d JOIN targets t ON d.source IS NOT DISTINCT FROM t.source),
parts AS (
 SELECT *, CAST(floor(copies) AS BIGINT) AS whole, copies - floor(copies) AS part,
        length(bin(size)) AS class FROM rows),
ranked AS (
 SELECT *, row_number() OVER w AS nth, CAST(sum(size) OVER w AS BIGINT) AS words,
        CAST(sum(CAST(floor(part * size * 1000000) AS BIGINT)) OVER (PARTITION BY source_no, class) AS BIGINT) AS goal
 FROM (SELECT *, (random / (1 - random)) / (part / (1 - part)) AS odds FROM parts WHERE part > 0 AND size > 0)
 WINDOW w AS (PARTITION BY source_no, class ORDER BY odds, doc_id NULLS FIRST, size
              ROWS UNBOUNDED PRECEDING)),
classes AS (
 SELECT source_no, class, any_value(goal) AS goal,
        row_number() OVER (PARTITION BY source_no ORDER BY class DESC) AS i
 FROM ranked GROUP BY source_no, class),
choices AS (
 SELECT c.*, r.nth, r.words * 1000000 AS words FROM classes c JOIN ranked r USING (source_no, class)
 WHERE abs(r.words * 1000000 - c.goal) <= 4000000 * (1::BIGINT << c.class)
 UNION ALL SELECT c.*, 0, 0 FROM classes c),
walk AS (
 SELECT source_no, 0::BIGINT AS i, 0 AS class, 0::BIGINT AS carry, 0::BIGINT AS takes
 FROM classes GROUP BY source_no
 UNION ALL
 SELECT source_no, i, class, goal + carry - words, nth
 FROM (SELECT c.source_no, c.i, c.class, c.goal, w.carry, c.words, c.nth,
              row_number() OVER (PARTITION BY c.source_no ORDER BY abs(c.goal + w.carry - c.words), c.nth) AS best
       FROM walk w JOIN choices c ON c.source_no = w.source_no AND c.i = w.i + 1)
 WHERE best = 1)
SELECT doc_id, size, source_size, target, copies * size AS taken, copies
FROM (
 SELECT r.doc_id, r.size, r.source_size, r.target,
        r.whole + CASE WHEN r.nth <= w.takes THEN 1 ELSE 0 END AS copies
 FROM ranked r JOIN walk w ON w.source_no = r.source_no AND w.class = r.class AND w.i > 0
 UNION ALL
 SELECT doc_id, size, source_size, target, whole FROM parts WHERE NOT (part > 0 AND size > 0))
"""


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = prefix_trie.ordered_turns(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    conv = F.col("conv_id")
    take, donor = F.crc32(conv.cast("string")) % 4, conv - conv % 20
    return prefix_trie.prefix_nodes(prefix_trie.spliced(turns, take, donor, most=3))


# DuckDB has no CRC-32: it is folded over the digits, a bit at a time.
OP12_SQL = r"""
WITH t AS (
 SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text
 FROM conversations WHERE conv_id IS NOT NULL),
digits AS (SELECT DISTINCT conv_id, CAST(conv_id AS VARCHAR) AS s FROM t),
crc AS (
 SELECT conv_id, xor(list_reduce(
   list_prepend(4294967295::BIGINT, list_transform(range(1, 8 * len(s) + 1),
     lambda i: CASE WHEN (i - 1) % 8 = 0 THEN ascii(s[CAST((i - 1) // 8 + 1 AS INTEGER)])::BIGINT ELSE 0 END)),
   lambda c, b: (CASE WHEN (xor(c, b) & 1) = 1 THEN xor(xor(c, b) >> 1, 3988292384::BIGINT)
                      ELSE xor(c, b) >> 1 END)), 4294967295::BIGINT) % 4 AS h
 FROM digits),
lists AS (
 SELECT conv_id, list(struct_pack(role := role, text := text) ORDER BY turn NULLS FIRST, role, text) AS l
 FROM t GROUP BY conv_id),
built AS (
 SELECT a.conv_id, list_concat(coalesce(p.l, [])[1:c.h], a.l[c.h + 1:]) AS l
 FROM lists a JOIN crc c USING (conv_id) LEFT JOIN lists p ON p.conv_id = a.conv_id - a.conv_id % 20),
prefixes AS (
 SELECT conv_id, d AS depth, len(l) AS length,
        sha256(array_to_string(list_transform(l[1:d],
          lambda x: strlen(x.role) || ':' || x.role || strlen(x.text) || ':' || x.text), '')) AS node,
        sha256(array_to_string(list_transform(l[1:d - 1],
          lambda x: strlen(x.role) || ':' || x.role || strlen(x.text) || ':' || x.text), '')) AS parent,
        CASE WHEN d = 0 THEN 0 ELSE len(regexp_extract_all(l[d].text, '[^\x20\x09-\x0D]+')) END AS words
 FROM built, unnest(range(0, len(l) + 1)) AS u(d)),
nodes AS (
 SELECT depth, node, any_value(parent) AS parent, min(conv_id) AS conv_id, count(*) AS n_convs,
        (count(*) - 1) * any_value(words) AS own_saved,
        sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id)
                        FILTER (depth = length), '')) AS ends_sha256
 FROM prefixes GROUP BY depth, node),
children AS (SELECT depth - 1 AS depth, parent AS node, count(*) AS n FROM nodes WHERE depth > 0 GROUP BY ALL),
sums AS (
 SELECT p.depth, p.node, sum(n.own_saved) AS saved, count(*) FILTER (c.n IS NULL) AS leaves
 FROM nodes n LEFT JOIN children c ON c.depth = n.depth AND c.node = n.node
 JOIN prefixes p ON p.conv_id = n.conv_id AND p.depth <= n.depth
 GROUP BY p.depth, p.node)
SELECT n.conv_id, n.depth, u.conv_id AS parent_conv_id, n.n_convs, coalesce(c.n, 0) AS n_children,
       s.leaves AS n_leaves, CAST(s.saved AS BIGINT) AS saved_tokens, n.ends_sha256
FROM nodes n JOIN sums s ON s.depth = n.depth AND s.node = n.node
LEFT JOIN children c ON c.depth = n.depth AND c.node = n.node
LEFT JOIN nodes u ON n.depth > 0 AND u.depth = n.depth - 1 AND u.node = n.parent
"""


def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    fields = ["doc_id", "source", "lang", "n_chars", "text"]
    lower = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    third = F.crc32(F.col("doc_id").cast("string")) % 3 == 0
    return merkle.manifest(
        _documents(spark, sf_dir), fields, changes={"text": lower}, suspect=third
    )


OP13_SQL = r"""
WITH RECURSIVE fields AS (
 SELECT *, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS lower_text,
        CAST(doc_id AS VARCHAR) AS s
 FROM documents),
crc AS (
 SELECT *, xor(list_reduce(
   list_prepend(4294967295::BIGINT, list_transform(range(1, 8 * len(s) + 1),
     lambda i: CASE WHEN (i - 1) % 8 = 0 THEN ascii(s[CAST((i - 1) // 8 + 1 AS INTEGER)])::BIGINT ELSE 0 END)),
   lambda c, b: (CASE WHEN (xor(c, b) & 1) = 1 THEN xor(xor(c, b) >> 1, 3988292384::BIGINT)
                      ELSE xor(c, b) >> 1 END)), 4294967295::BIGINT) % 3 = 0 AS suspect,
  coalesce(strlen(CAST(doc_id AS VARCHAR)) || ':' || doc_id, '-')
   || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-')
   || coalesce(strlen(CAST(n_chars AS VARCHAR)) || ':' || n_chars, '-') AS head
 FROM fields),
leaves AS (
 SELECT doc_id, lang, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
        sha256(head || coalesce(strlen(text) || ':' || CASE WHEN suspect THEN lower_text ELSE text END, '-')) AS changed
 FROM crc),
tree AS (
 SELECT 0 AS level, lang, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx,
        leaf AS digest, count(*) OVER (PARTITION BY lang) AS n
 FROM leaves
 UNION ALL
 SELECT any_value(level) + 1, lang, idx // 8, sha256(string_agg(digest, '' ORDER BY idx)), (any_value(n) + 7) // 8
 FROM tree WHERE n > 1 GROUP BY lang, idx // 8),
subroots AS (SELECT lang, digest FROM tree WHERE n = 1),
forest AS (
 SELECT 0 AS level, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS idx, digest, count(*) OVER () AS n
 FROM subroots
 UNION ALL
 SELECT any_value(level) + 1, idx // 8, sha256(string_agg(digest, '' ORDER BY idx)), (any_value(n) + 7) // 8
 FROM forest WHERE n > 1 GROUP BY idx // 8),
tree_steps AS (
 SELECT a.lang, a.level, a.idx, coalesce(string_agg(b.digest, '' ORDER BY b.idx) FILTER (b.idx < a.idx), '') AS l,
        coalesce(string_agg(b.digest, '' ORDER BY b.idx) FILTER (b.idx > a.idx), '') AS r
 FROM tree a JOIN tree b ON a.lang IS NOT DISTINCT FROM b.lang AND a.level = b.level AND a.idx // 8 = b.idx // 8
 WHERE a.n > 1 GROUP BY a.lang, a.level, a.idx),
forest_steps AS (
 SELECT a.level, a.idx, coalesce(string_agg(b.digest, '' ORDER BY b.idx) FILTER (b.idx < a.idx), '') AS l,
        coalesce(string_agg(b.digest, '' ORDER BY b.idx) FILTER (b.idx > a.idx), '') AS r
 FROM forest a JOIN forest b ON a.level = b.level AND a.idx // 8 = b.idx // 8
 WHERE a.n > 1 GROUP BY a.level, a.idx),
placed AS (
 SELECT l.*, row_number() OVER (PARTITION BY l.lang ORDER BY l.doc_id NULLS FIRST, leaf) - 1 AS idx, g.idx AS group_idx
 FROM leaves l JOIN (SELECT lang, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS idx FROM subroots) g
   ON l.lang IS NOT DISTINCT FROM g.lang),
folds AS (
 SELECT lang, idx AS place, group_idx, 0 AS part, 0 AS level, idx, changed AS digest, '' AS siblings FROM placed
 UNION ALL
 SELECT lang, place, group_idx, part, level, idx, digest, siblings FROM (
  SELECT f.lang, f.place, f.group_idx, 0 AS part, f.level + 1 AS level, f.idx // 8 AS idx,
         sha256(s.l || f.digest || s.r) AS digest, f.siblings || s.l || s.r AS siblings
  FROM folds f JOIN tree_steps s
    ON f.part = 0 AND s.lang IS NOT DISTINCT FROM f.lang AND s.level = f.level AND s.idx = f.idx
  UNION ALL
  SELECT f.lang, f.place, f.group_idx, 1, 0, f.group_idx, f.digest, f.siblings
  FROM folds f JOIN tree t ON f.part = 0 AND t.n = 1 AND t.lang IS NOT DISTINCT FROM f.lang AND t.level = f.level
  UNION ALL
  SELECT f.lang, f.place, f.group_idx, 1, f.level + 1, f.idx // 8,
         sha256(s.l || f.digest || s.r), f.siblings || s.l || s.r
  FROM folds f JOIN forest_steps s ON f.part = 1 AND s.level = f.level AND s.idx = f.idx)),
root AS (SELECT level, digest FROM forest WHERE n = 1)
SELECT p.doc_id, p.leaf, s.digest AS subroot, root.digest AS root, sha256(f.siblings) AS proof_sha256,
       f.digest AS folded_root, f.digest = root.digest AS verified
FROM placed p JOIN subroots s ON p.lang IS NOT DISTINCT FROM s.lang CROSS JOIN root
JOIN folds f ON f.part = 1 AND f.level = root.level AND f.place = p.idx AND f.lang IS NOT DISTINCT FROM p.lang
"""


QUERIES = {
    "op1_exact_dedup": (op1_exact_dedup, OP1_SQL),
    "op2_lm_scoring": (op2_lm_scoring, None),
    "op3_minhash": (op3_minhash, OP3_SQL),
    "op4_language_id": (op4_language_id, None),
    "op5_quality": (op5_quality, None),
    "op6_embedding_dedup": (op6_embedding_dedup, OP6_SQL),
    "op7_byte_bpe": (op7_byte_bpe, None),
    "op8_token_counts": (op8_token_counts, None),
    "op9_sharding": (op9_sharding, OP9_SQL),
    "op10_packing": (op10_packing, None),
    "op11_mixing": (op11_mixing, OP11_SQL),
    "op12_prefix_trie": (op12_prefix_trie, OP12_SQL),
    "op13_merkle": (op13_merkle, OP13_SQL),
}
