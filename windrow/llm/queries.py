"""Registered queries of the operators over the given tables, with SQL twins where SQL can say it."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from windrow.llm import (
    binary_ids, collocations, decontamination, embedding_dedup, language, near_duplicates, packing, pseudo_likelihood, quality,
    sharding, spelling, substring_dedup, token_counts,
)
from windrow.llm.common import write_path, written

SHARDS = 8
SHARD_SEED = 1
END_ID = 2


def table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_feistel_shards(spark, sf_dir):
    """Every document's place in eight shards; copies of a text are placed like any other rows."""
    docs = table(spark, sf_dir, "documents").select(
        "doc_id", (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"),
        F.coalesce(F.crc32(F.col("text").cast("binary")), F.lit(0)).alias("text_crc32"),
    )
    placed = sharding.shard_rows(docs, ["doc_id", "size", "text_crc32"], SHARDS, SHARD_SEED)
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"), "row_number", "position",
    )


def _mix(x: str, key: str) -> str:
    a = f"((((({x}) % {sharding.PRIME}) + {sharding.PRIME}) % {sharding.PRIME} * 1103515245 + ({key})) % {sharding.PRIME})"
    b = f"((xor({a}, {a} >> 15) * 1597334677) % {sharding.PRIME})"
    return f"xor({b}, {b} >> 13)"


def _op1_sql() -> str:
    prime, seed = sharding.PRIME, SHARD_SEED
    scrambled = _mix("blk", str(seed))
    steps = ["SELECT *, " + scrambled + " AS m0 FROM blocks"]
    for i, c in enumerate(("doc_id", "size", "text_crc32")):
        part = f"coalesce((({c} % {prime}) + {prime}) % {prime}, -1)"
        steps.append(f"SELECT *, {_mix(f'm{i} + {part}', str(seed + 1))} AS m{i + 1} FROM ({steps[-1]})")
    rounds = "SELECT id, step, (p - p % b) // b AS x0, p % b AS y0, a, b, n FROM walk WHERE step = 0 OR p >= n"
    for i, key in enumerate(sharding.round_keys(seed)):
        size = "a" if i % 2 == 0 else "b"
        rounds = f"SELECT *, y{i} AS x{i + 1}, (x{i} + {_mix(f'y{i}', str(key))}) % {size} AS y{i + 1} FROM ({rounds})"
    last = sharding.ROUNDS
    return f"""
WITH RECURSIVE crc_table AS (
  SELECT list(c ORDER BY i) AS t FROM (
    SELECT i, list_reduce(list_prepend(i, [0, 0, 0, 0, 0, 0, 0, 0]),
      lambda c, _: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c
    FROM (SELECT unnest(range(256)) AS i))),
hexed AS (SELECT doc_id, text, regexp_extract_all(hex(encode(text)), '..') AS bytes FROM documents),
docs AS (
  SELECT doc_id, coalesce(strlen(text), 0) + 1 AS size,
    CASE WHEN text IS NULL OR text = '' THEN 0 ELSE xor(4294967295, list_reduce(
      list_prepend(4294967295::BIGINT, list_transform(bytes, lambda h: ('0x' || h)::BIGINT)),
      lambda c, v: xor(c >> 8, t[(xor(c, v) & 255) + 1]))) END AS text_crc32
  FROM hexed, crc_table),
sizes AS (SELECT count(*) AS n, ceil(sqrt(count(*)))::BIGINT AS a0 FROM docs),
halves AS (
  SELECT n, a, greatest(1, (n + a - 1) // a) AS b,
    least({sharding.MAX_BUCKETS}, 2 ** greatest(0, ceil(log2(greatest(1, n / {sharding.ROWS_PER_BUCKET})))))::BIGINT AS buckets
  FROM (SELECT n, greatest(1, CASE WHEN (a0 - 1) * (a0 - 1) >= n THEN a0 - 1 WHEN a0 * a0 < n THEN a0 + 1 ELSE a0 END) AS a FROM sizes)),
blocks AS (
  SELECT *, k // {sharding.BLOCK} AS blk FROM (
    SELECT *, row_number() OVER (PARTITION BY doc_id, size, text_crc32) - 1 AS k FROM docs)),
bucketed AS (SELECT *, m3 % (SELECT buckets FROM halves) AS bucket FROM ({steps[-1]})),
numbered AS (
  SELECT *, row_number() OVER (ORDER BY bucket, doc_id NULLS FIRST, size, text_crc32, k) - 1 AS row_number FROM bucketed),
walk AS (
  SELECT row_number AS id, 0 AS step, row_number AS p, a, b, n FROM numbered, halves
  UNION ALL
  SELECT id, step + 1, x{last} * b + y{last}, a, b, n FROM ({rounds})),
placed AS (SELECT id, p AS position FROM walk WHERE step > 0 AND p < n)
SELECT doc_id, size::BIGINT AS size, text_crc32::BIGINT AS text_crc32, 'rows' AS law, (position % {SHARDS})::INTEGER AS shard,
  (position // {SHARDS})::BIGINT AS slot, NULL::INTEGER AS grown_shard, row_number, position
FROM numbered JOIN placed ON row_number = id"""


def op2_length_histogram(spark, sf_dir):
    """Length histogram of all documents with its suffix sums."""
    histogram = token_counts.length_histogram(
        table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return token_counts.length_curve(written(histogram, "lengths"))


def op3_pseudo_likelihood(spark, sf_dir):
    """Pseudo-likelihood of every document."""
    return pseudo_likelihood.score_documents(
        table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op4_pack(spark, sf_dir):
    """Every piece of every document with its place in sequences of 4,096 tokens."""
    packed = packing.pack(
        table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), end_id=END_ID, capacity=4096)
    return packed.drop("ids")


def op5_positional_index(spark, sf_dir):
    """Benchmark windows found in every document."""
    return decontamination.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), width=10)


_OP5_WORDS = (
    "coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
    r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), [])"
)
OP5_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {_OP5_WORDS} AS w FROM documents),
b AS (SELECT coalesce(item_id::VARCHAR, '') AS item, {_OP5_WORDS} AS w FROM benchmark),
cut AS (SELECT item, w, least(10, len(w)) AS need, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS s FROM b WHERE len(w) > 0),
windows AS (SELECT DISTINCT item, need, array_to_string(w[s:s + need - 1], ' ') AS phrase FROM cut),
places AS (
  SELECT rid, need, p, array_to_string(w[p:p + need - 1], ' ') AS phrase
  FROM (SELECT rid, w, need, unnest(range(1, len(w) - need + 2)) AS p FROM d, (SELECT DISTINCT need FROM windows))),
met AS (SELECT rid, need, p, item FROM places JOIN windows USING (need, phrase)),
hit AS (SELECT rid, count(DISTINCT pos) AS n_hit FROM (SELECT rid, unnest(range(p, p + need)) AS pos FROM met) GROUP BY rid),
named AS (
  SELECT rid, count(*) AS n_items, sha256(string_agg(item, ',' ORDER BY item)) AS items_sha256
  FROM (SELECT DISTINCT rid, item FROM met) GROUP BY rid)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  coalesce(items_sha256, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (rid) LEFT JOIN named USING (rid)"""


def held_out(doc_id):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def learnable(doc_id):
    """Documents that a language model may learn from; NULL ids are in no fold."""
    return F.col(doc_id).isNotNull() & ~held_out(doc_id)


def op6_language_mixture(spark, sf_dir):
    """Language of every document, by a model of the documents outside the held-out fold."""
    docs = table(spark, sf_dir, "documents")
    model = language.fit(docs, learnable("doc_id"))
    found = language.identify(docs.select("doc_id", "text"), model)
    return found.select(F.col("row.doc_id").alias("doc_id"), "lang_pred", "score", "languages", "shares").withColumn(
        "held_out", held_out("doc_id"))


def op7_hyperplane_dedup(spark, sf_dir):
    """Links and components of all vectors at a cosine of 0.9."""
    return embedding_dedup.near_duplicates(table(spark, sf_dir, "embeddings"), cosine=0.9)


def op8_binary_ids(spark, sf_dir):
    """Documents read back from the written set."""
    path = write_path(spark, "ids")
    binary_ids.write_ids(
        table(spark, sf_dir, "documents"), path, public_tokenizers.path("byte_bpe_50k.json"), end_id=END_ID)
    return binary_ids.read_ids(spark, path).select(
        "doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op9_prob_minhash(spark, sf_dir):
    """Class of every document at a similarity of 0.8 of five-word shingles, and the one that stays."""
    return near_duplicates.deduplicate(table(spark, sf_dir, "documents"), similarity=0.8).drop("k1", "k2")


def op10_importance_resampling(spark, sf_dir):
    """Importance weight, Gumbel key and verdict of every document."""
    return quality.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_collocations(spark, sf_dir):
    """The first 2,000 phrases of each language."""
    return collocations.mine_collocations(table(spark, sf_dir, "documents"), least=10, top=2000, share=50)


OP11_SQL = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents WHERE text IS NOT NULL),
cut AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
grams AS (
  SELECT lang, 1 AS size, unnest(w) AS phrase FROM cut
  UNION ALL SELECT lang, 2, array_to_string(w[i:i + 1], ' ') FROM (SELECT lang, w, unnest(range(1, len(w))) AS i FROM cut)
  UNION ALL SELECT lang, 3, array_to_string(w[i:i + 2], ' ') FROM (SELECT lang, w, unnest(range(1, len(w) - 1)) AS i FROM cut)),
counts AS (SELECT lang, size, phrase, count(*) AS f FROM grams GROUP BY ALL),
totals AS (SELECT lang, sum(f) AS n FROM counts WHERE size = 1 GROUP BY lang),
candidates AS (SELECT lang, size, phrase, f AS a, string_split(phrase, ' ') AS w FROM counts WHERE size > 1 AND f >= 10),
cuts AS (
  SELECT lang, size, phrase, a, w, k, array_to_string(w[1:k], ' ') AS head, array_to_string(w[k + 1:], ' ') AS tail
  FROM (SELECT *, unnest(range(1, size)) AS k FROM candidates)),
scored AS (
  SELECT c.*, h.f AS l, t.f AS r, (1000000::HUGEINT * a * a) // (h.f::HUGEINT * t.f) AS score
  FROM cuts c JOIN counts h ON h.lang = c.lang AND h.phrase = c.head AND h.size = k
  JOIN counts t ON t.lang = c.lang AND t.phrase = c.tail AND t.size = c.size - k),
lowest AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase, size ORDER BY score, k) = 1),
longer AS (
  SELECT lang, inner_phrase AS phrase, max(a) AS most FROM (
    SELECT lang, a, array_to_string(w[1:2], ' ') AS inner_phrase FROM candidates WHERE size = 3
    UNION ALL SELECT lang, a, array_to_string(w[2:3], ' ') FROM candidates WHERE size = 3) GROUP BY ALL),
kept AS (
  SELECT lowest.* FROM lowest LEFT JOIN longer ON longer.lang = lowest.lang AND longer.phrase = lowest.phrase AND size = 2
  WHERE most IS NULL OR 100 * most < 50 * a),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
SELECT lang, rank::BIGINT AS rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n::BIGINT AS n, score::BIGINT AS score
FROM ranked JOIN totals USING (lang) WHERE rank <= 2000"""


def op12_spelling_variants(spark, sf_dir):
    """Every word of six letters and five occurrences with its near words and the form it varies."""
    return spelling.spelling_variants(table(spark, sf_dir, "documents"), least_length=6, least_count=5, noise=199, factor=5)


OP12_SQL = r"""
WITH RECURSIVE crc_table AS (
  SELECT list(c ORDER BY i) AS t FROM (
    SELECT i, list_reduce(list_prepend(i, [0, 0, 0, 0, 0, 0, 0, 0]),
      lambda c, _: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c
    FROM (SELECT unnest(range(256)) AS i))),
runs AS (
  SELECT coalesce(doc_id::VARCHAR, '') AS id, unnest(regexp_extract_all(text, '[A-Za-z\x{C0}-\x{FF}]+')) AS run FROM documents),
lowered AS (
  SELECT id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS w, count(*) AS c
  FROM runs WHERE length(run) >= 6 GROUP BY ALL),
hashed AS (
  SELECT w, c, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT,
      list_transform(regexp_extract_all(hex(encode(id || ':' || w)), '..'), lambda h: ('0x' || h)::BIGINT)),
    lambda s, v: xor(s >> 8, t[(xor(s, v) & 255) + 1]))) AS h
  FROM lowered, crc_table),
altered AS (
  SELECT CASE WHEN h % 199 = 0 THEN left(w, (h % length(w))::INT) || substring(w, (h % length(w))::INT + 2) ELSE w END AS word, c
  FROM hashed),
words AS (SELECT word, sum(c)::BIGINT AS n FROM altered WHERE length(word) >= 6 GROUP BY word HAVING sum(c) >= 5),
holes AS (
  SELECT word, left(word, i) || '_' || substring(word, i + 2) AS replaced, left(word, i) || substring(word, i + 2) AS shorter
  FROM (SELECT word, unnest(range(length(word))) AS i FROM words)),
links AS (
  SELECT DISTINCT a.word AS word, b.word AS near FROM holes a JOIN holes b USING (replaced) WHERE a.word <> b.word
  UNION SELECT DISTINCT holes.word, words.word FROM holes JOIN words ON words.word = shorter
  UNION SELECT DISTINCT words.word, holes.word FROM holes JOIN words ON words.word = shorter),
near AS (
  SELECT links.word, count(*) AS n_near, first(near ORDER BY words.n DESC, near) AS best, max(words.n) AS best_n
  FROM links JOIN words ON words.word = near GROUP BY links.word),
formed AS (
  SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN best_n >= 5 * n THEN best END AS form,
    CASE WHEN best_n >= 5 * n THEN best_n END AS form_n
  FROM words LEFT JOIN near USING (word)),
walk AS (
  SELECT word, word AS here, form AS ahead FROM formed
  UNION ALL SELECT walk.word, walk.ahead, formed.form FROM walk JOIN formed ON formed.word = walk.ahead)
SELECT word, form, here AS root, n, n_near::BIGINT AS n_near, form_n FROM formed JOIN walk USING (word) WHERE ahead IS NULL"""


def op13_substring_dedup(spark, sf_dir):
    """Words kept of every document, without windows of 50 words that an earlier document has."""
    kept = substring_dedup.remove_repeats(table(spark, sf_dir, "documents"), window=50)
    return kept.select(
        F.col("row.doc_id").alias("doc_id"), "n_words", "n_removed",
        F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


OP13_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
windows AS (
  SELECT rid, doc_id, s, array_to_string(w[s:s + 49], ' ') AS phrase FROM (SELECT *, unnest(range(1, len(w) - 48)) AS s FROM d)),
firsts AS (SELECT phrase, min(doc_id) AS owner FROM windows GROUP BY phrase),
gone AS (
  SELECT DISTINCT rid, unnest(range(s, s + 50)) AS i FROM windows JOIN firsts USING (phrase) WHERE owner < doc_id OR (doc_id IS NULL AND owner IS NOT NULL)),
words AS (SELECT rid, unnest(range(1, len(w) + 1)) AS i, unnest(w) AS word FROM d),
kept AS (
  SELECT rid, count(*) AS n_kept, string_agg(word, ' ' ORDER BY i) AS text
  FROM words ANTI JOIN gone USING (rid, i) GROUP BY rid)
SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n_kept, 0))::BIGINT AS n_removed, sha256(coalesce(text, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (rid)"""


QUERIES = {
    "op1_feistel_shards": op1_feistel_shards,
    "op2_length_histogram": op2_length_histogram,
    "op3_pseudo_likelihood": op3_pseudo_likelihood,
    "op4_pack": op4_pack,
    "op5_positional_index": op5_positional_index,
    "op6_language_mixture": op6_language_mixture,
    "op7_hyperplane_dedup": op7_hyperplane_dedup,
    "op8_binary_ids": op8_binary_ids,
    "op9_prob_minhash": op9_prob_minhash,
    "op10_importance_resampling": op10_importance_resampling,
    "op11_collocations": op11_collocations,
    "op12_spelling_variants": op12_spelling_variants,
    "op13_substring_dedup": op13_substring_dedup,
}
ORACLE = {
    "op1_feistel_shards": _op1_sql(), "op5_positional_index": OP5_SQL, "op11_collocations": OP11_SQL,
    "op12_spelling_variants": OP12_SQL, "op13_substring_dedup": OP13_SQL,
}
