"""The queries opN_<name>: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from skillgrid.llm import neardup

    return neardup.near_duplicates(table(spark, sf_dir, "documents"))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from skillgrid.llm import decontaminate

    out = decontaminate.matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "item_id", F.col("start").cast("long").alias("start"), F.col("size").cast("long").alias("size"), "shared", "total")


def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    from skillgrid.llm import language, sampling

    docs = table(spark, sf_dir, "documents").withColumn("held_out", sampling.remainder("doc_id", 4) == 2)
    model = language.fit(docs.filter(~F.col("held_out")))
    out = language.identify(docs.select("doc_id", "held_out", "text"), model)
    return out.select("doc_id", "held_out", "lang_pred", F.col("lang_score").alias("score"), F.col("lang_accepted").alias("accepted"))


def op4_lmscore(spark: SparkSession, sf_dir: str) -> DataFrame:
    from skillgrid.llm import lmscore, sampling

    docs = table(spark, sf_dir, "documents")
    return lmscore.score(docs.withColumn("held_out", sampling.remainder("doc_id", 7) == 2))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from skillgrid.llm import packing

    out = packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return out.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op6_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    from skillgrid.llm import lines

    out = lines.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from skillgrid.llm import secrets

    out = secrets.scan(table(spark, sf_dir, "documents"))
    count = lambda kind: F.size(F.filter("base", lambda s: s.rank == secrets.KINDS.index(kind))).cast("long").alias(f"n_{kind}")
    return out.select("doc_id", *[count(k) for k in secrets.BASE], F.sha2(secrets.listing("base"), 256).alias("base_sha256"), secrets.listing("spans").alias("spans"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from skillgrid.llm import quality, sampling

    docs = table(spark, sf_dir, "documents").select("doc_id", "text", (sampling.remainder("doc_id", 3) == 1).alias("held_out"))
    model = quality.fit(docs.filter(~F.col("held_out")), table(spark, sf_dir, "labels"))
    out = docs.select("doc_id", "held_out", quality.score(model, docs).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def op9_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    from skillgrid.llm import repeats

    out = repeats.remove_repeats(table(spark, sf_dir, "documents"))
    removed = F.col("n_bytes") - F.octet_length("kept")
    return out.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("removed").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op10_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    from skillgrid.llm import media

    out = media.load(media.store(table(spark, sf_dir, "documents")))
    return out.select(
        "doc_id", "n_bytes", F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.substring("payload", -16, 16)).alias("tail_crc32"), F.octet_length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"), "feature",
    )


def op11_fim(spark: SparkSession, sf_dir: str) -> DataFrame:
    from skillgrid.llm import fim

    out = fim.rearrange(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(fim.restored(), 256).alias("restored_sha256"))


def op12_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from skillgrid.llm import mixing

    return mixing.mix(table(spark, sf_dir, "documents"))


def op13_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    from skillgrid.llm import importance

    return importance.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_neardup": op1_neardup,
    "op2_decontamination": op2_decontamination,
    "op3_language": op3_language,
    "op4_lmscore": op4_lmscore,
    "op5_packing": op5_packing,
    "op6_lines": op6_lines,
    "op7_secrets": op7_secrets,
    "op8_quality": op8_quality,
    "op9_repeats": op9_repeats,
    "op10_media": op10_media,
    "op11_fim": op11_fim,
    "op12_mixing": op12_mixing,
    "op13_resampling": op13_resampling,
}
ORACLE_SQL: dict[str, str] = {
    "op1_neardup": r"""
WITH RECURSIVE tokens AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents
), sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s
  FROM tokens
), flat AS MATERIALIZED (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM sets),
links AS MATERIALIZED (
  SELECT a.doc_id AS a, b.doc_id AS b FROM flat a JOIN flat b ON a.x = b.x AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))
), reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, m.component_id, s.doc_id = m.component_id AS kept
FROM sets s JOIN (SELECT a, min(b) AS component_id FROM reach GROUP BY a) m ON m.a = s.doc_id
""",
    "op11_fim": r"""
WITH units AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS u, sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents
), drawn AS (
  SELECT *, CAST(len(u) AS BIGINT) AS n, CAST('0x' || h[1:8] AS BIGINT) % (len(u) + 1) AS a, CAST('0x' || h[9:16] AS BIGINT) % (len(u) + 1) AS b, CAST('0x' || h[25:32] AS BIGINT) % 100 < 50 AS spm,
    t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') AS plain FROM units
), pieces AS (
  SELECT *, array_to_string(u[1:least(a, b)], '') AS p, array_to_string(u[least(a, b) + 1:greatest(a, b)], '') AS m, array_to_string(u[greatest(a, b) + 1:], '') AS s FROM drawn
)
SELECT doc_id, n, CASE WHEN plain THEN 'plain' WHEN spm THEN 'spm' ELSE 'psm' END AS form, CASE WHEN NOT plain THEN CAST(length(p) AS BIGINT) END AS prefix_chars, CASE WHEN NOT plain THEN CAST(length(m) AS BIGINT) END AS middle_chars,
  sha256(CASE WHEN plain THEN t WHEN spm THEN '<S>' || s || '<P>' || p || '<M>' || m ELSE '<P>' || p || '<S>' || s || '<M>' || m END) AS output_sha256, sha256(t) AS restored_sha256
FROM pieces
""",
    "op12_mixing": r"""
WITH RECURSIVE docs AS MATERIALIZED (
  SELECT doc_id, coalesce('0' || source, '1') AS key, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size, md5('12:' || coalesce(CAST(doc_id AS VARCHAR), md5(coalesce(text, '')))) AS place FROM documents
), sources AS (
  SELECT key, CAST(sum(size) AS BIGINT) AS source_size, CAST(ceil(sqrt(count(*))) AS BIGINT) AS shards FROM docs GROUP BY key
), weighed AS (
  SELECT *, [3.0, 1.0, 2.0][(row_number() OVER (ORDER BY key) - 1) % 3 + 1]::DOUBLE AS w, CAST(2 * source_size AS DOUBLE) AS most FROM sources
), levels(shared, fixed) AS (  -- words that go by weight, and the sources that stop at their limit: round by round, until none is above
  SELECT 1.5::DOUBLE * (SELECT sum(source_size) FROM sources), CAST([] AS VARCHAR[])
  UNION ALL
  SELECT shared - (SELECT sum(most) FROM weighed WHERE list_contains(over_limit, key)), fixed || over_limit FROM (
    SELECT shared, fixed, (SELECT list(key) FROM weighed WHERE NOT list_contains(fixed, key) AND w * (shared / (SELECT sum(w) FROM weighed WHERE NOT list_contains(fixed, key))) > most) AS over_limit FROM levels
  ) WHERE len(over_limit) > 0
), level AS (SELECT shared, fixed FROM levels ORDER BY len(fixed) DESC LIMIT 1
), aims AS MATERIALIZED (
  SELECT key, source_size, shards, CASE WHEN list_contains(fixed, key) THEN most ELSE least(most, w * (shared / (SELECT sum(w) FROM weighed x WHERE NOT list_contains(fixed, x.key)))) END AS target FROM weighed, level
), votes AS (
  SELECT key, target * ceil(source_size / 64) / source_size AS v, 2 * CAST(ceil(source_size / 64) AS BIGINT) AS most FROM aims WHERE source_size > 0
), source_seats AS MATERIALIZED (  -- every seat that a source can have, by its quotient
  SELECT key, count(*) AS seats FROM (
    SELECT key, row_number() OVER (ORDER BY v / (2 * s + 1) DESC, key, s) AS place FROM (SELECT key, v, unnest(range(0, most)) AS s FROM votes)
  ) WHERE place <= (SELECT CAST(round(sum(v)) AS BIGINT) FROM votes) GROUP BY key
), laid AS MATERIALIZED (
  SELECT d.*, CAST('0x' || place[1:8] AS BIGINT) % shards AS shard FROM docs d JOIN sources USING (key)
), whole AS MATERIALIZED (
  SELECT *, CAST(sum(size) OVER (PARTITION BY key ORDER BY shard, place, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) - size AS start FROM laid
), shard_blocks AS MATERIALIZED (
  SELECT key, shard, CAST(ceil(min(start) / 64) AS BIGINT) AS first, CAST(ceil(max(start + size) / 64) AS BIGINT) - CAST(ceil(min(start) / 64) AS BIGINT) AS blocks FROM whole GROUP BY key, shard
), quotas AS (
  SELECT key, shard, count(*) AS quota FROM (
    SELECT key, shard, row_number() OVER (PARTITION BY key ORDER BY blocks / (2 * s + 1) DESC, shard, s) AS place FROM (SELECT key, shard, blocks, unnest(range(0, 2 * blocks)) AS s FROM shard_blocks)
  ) JOIN source_seats USING (key) WHERE place <= seats GROUP BY key, shard
), chosen AS MATERIALIZED (
  SELECT key, block, quota // blocks + CASE WHEN row_number() OVER (PARTITION BY key, shard ORDER BY CAST('0x' || md5('12:' || key || ':' || block)[1:8] AS BIGINT), block) <= quota % blocks THEN 1 ELSE 0 END AS times
  FROM (SELECT key, shard, blocks, coalesce(quota, 0) AS quota, unnest(range(first, first + blocks)) AS block FROM shard_blocks LEFT JOIN quotas USING (key, shard) WHERE blocks > 0)
), taken AS (
  SELECT key, start, sum(times * (least(start + size, 64 * block + 64) - greatest(start, 64 * block))) AS taken
  FROM (SELECT key, start, size, unnest(range(start // 64, (start + size - 1) // 64 + 1)) AS block FROM whole WHERE size > 0) JOIN chosen USING (key, block) GROUP BY key, start
)
SELECT doc_id, size, source_size, target, CAST(CASE WHEN size = 0 THEN 0 ELSE coalesce(taken, 0) END AS BIGINT) AS taken FROM whole JOIN aims USING (key) LEFT JOIN taken USING (key, start)
""",
    "op13_resampling": r"""
WITH crc_table AS MATERIALIZED (
  SELECT list(list_reduce(list_prepend(b, range(0, 8)), lambda c, _: xor(c >> 1, CASE WHEN c % 2 = 1 THEN 3988292384 ELSE 0 END)) ORDER BY b) AS t FROM range(0, 256) AS x(b)
), docs AS MATERIALIZED (
  SELECT row_number() OVER () AS row, doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS words FROM documents
), own AS MATERIALIZED (SELECT row, unnest(words) AS w FROM docs
), aim AS MATERIALIZED (
  SELECT unnest(list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '')) AS w FROM benchmark
), hexes AS (SELECT w, hex(encode(w)) AS x FROM (SELECT w FROM own UNION SELECT w FROM aim)
), hashed AS MATERIALIZED (
  SELECT w, xor(list_reduce(list_prepend(4294967295, list_transform(range(1, len(x) // 2 + 1), lambda i: CAST('0x' || x[2 * i - 1:2 * i] AS BIGINT))), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % 10000 AS bucket FROM hexes, crc_table
), source AS (SELECT bucket, count(*) AS s FROM own JOIN hashed USING (w) GROUP BY bucket
), target AS (SELECT bucket, count(*) AS t FROM aim JOIN hashed USING (w) GROUP BY bucket
), gains AS MATERIALIZED (
  SELECT bucket, floor(1000 * ln(((coalesce(t, 0)::DOUBLE + 1) * ((SELECT count(*) FROM own)::DOUBLE + 10000)) / ((s::DOUBLE + 1) * ((SELECT count(*) FROM aim)::DOUBLE + 10000)))) AS gain FROM source LEFT JOIN target USING (bucket)
), weights AS (SELECT row, CAST(sum(gain) AS BIGINT) AS weight FROM own JOIN hashed USING (w) JOIN gains USING (bucket) GROUP BY row
), scored AS (
  SELECT row, doc_id, CAST(len(words) AS BIGINT) AS n_features, coalesce(weight, 0) AS weight,
    CAST(coalesce(weight, 0) + floor(-1000 * ln(-ln((CAST('0x' || sha256('2024:' || coalesce(CAST(doc_id AS VARCHAR), ''))[1:8] AS BIGINT) + 0.5::DOUBLE) / 4294967296.0::DOUBLE))) AS BIGINT) AS score
  FROM docs LEFT JOIN weights USING (row)
), placed AS (SELECT row, row_number() OVER (ORDER BY score DESC, doc_id NULLS LAST, row) AS place, count(*) OVER () AS n FROM scored WHERE n_features >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN place <= 10 * n // 100 THEN place END AS rank FROM scored LEFT JOIN placed USING (row)
""",
}
