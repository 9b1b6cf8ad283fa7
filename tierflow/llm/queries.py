"""The queries of the operators in this subpackage: production parameters, whole tables."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tierflow.llm import bpe, decontaminate, jaccard, lines, multiindex, ngrams, phrases, resampling, secrets, sharding, suffixes, toxicity, urls

RANKS = "byte_bpe_50k.tiktoken"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language-model scores of every document; six sevenths of the ids are the training part."""
    docs = table(spark, sf_dir, "documents")
    learned = "crc32(cast(cast(doc_id as string) as binary)) % 7 <> 2"
    scored = ngrams.score_documents(docs, docs.where(learned), learned)
    return scored.select("doc_id", (~F.expr(learned)).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op2_nearest_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 nearest vectors, by Hamming distance of their sign codes, of every vector whose id is divisible by 100."""
    return multiindex.nearest_codes(table(spark, sf_dir, "embeddings"), 10, "id % 100 = 0")


def op3_benchmark_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of a document and a benchmark item that it holds, as it stands or re-parameterised."""
    return decontaminate.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """24 shards of nearly equal bytes."""
    placed = sharding.shard_documents(table(spark, sf_dir, "documents"), 24)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts and digests of every document's encoding and of its decoding."""
    return bpe.encode_documents(table(spark, sf_dir, "documents"), public_tokenizers.path(RANKS), public_tokenizers.PATTERN, with_ids=False)


#: Rules of the URL filter: host and start of the path, verdict.
URL_RULES = [("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block")]


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secret spans of every document."""
    return secrets.secret_report(table(spark, sf_dir, "documents"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity scores of every document with the examples they rest on, learnt from two thirds of the labels."""
    docs = table(spark, sf_dir, "documents")
    index = toxicity.fit(docs, toxicity.learnable(table(spark, sf_dir, "labels")))
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1
    return toxicity.score_documents(docs, index).select("doc_id", held_out.alias("held_out"), "score", "predicted", "evidence")


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents linked by a Jaccard similarity of 0.8 or more."""
    return jaccard.jaccard_components(table(spark, sf_dir, "documents"))


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rule that fits each page's URL, and its verdict."""
    return urls.judge_urls(table(spark, sf_dir, "pages"), URL_RULES)


def op10_repeated_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document without the 400-byte strings that occur elsewhere."""
    return suffixes.cut_repeats(table(spark, sf_dir, "documents"), with_kept=False)


def op11_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document without the lines that 10 documents or more have in common."""
    kept = lines.drop_common_lines(table(spark, sf_dir, "documents").select("doc_id", "text"), 10, 1)
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 2,000 best phrases of 2 to 3 words of each language."""
    return phrases.collocations(table(spark, sf_dir, "documents"), 3, 10, 50, 2000)


def op13_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weights of every document for the benchmark's distribution, and the ranks of the tenth that is drawn."""
    drawn = resampling.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), 10, 20, 10_000, 1, 2024)
    return drawn.select("doc_id", "n_features", "weight", "score", "rank")


QUERIES = {
    "op1_lm_scores": op1_lm_scores,
    "op2_nearest_codes": op2_nearest_codes,
    "op3_benchmark_leaks": op3_benchmark_leaks,
    "op4_shards": op4_shards,
    "op5_byte_bpe": op5_byte_bpe,
    "op6_secret_scan": op6_secret_scan,
    "op7_toxicity": op7_toxicity,
    "op8_jaccard_join": op8_jaccard_join,
    "op9_url_filter": op9_url_filter,
    "op10_repeated_bytes": op10_repeated_bytes,
    "op11_line_dedup": op11_line_dedup,
    "op12_collocations": op12_collocations,
    "op13_resampling": op13_resampling,
}

_RULE_ROWS = ", ".join(f"('{rule}', '{rule.partition('/')[0]}', '/{rule.partition('/')[2]}', '{verdict}')" for rule, verdict in URL_RULES)

ORACLE_SQL: dict[str, str] = {
    "op2_nearest_codes": """
        WITH codes AS (SELECT vec_id, list_transform(embedding, lambda x: CASE WHEN x > 0 THEN 1 ELSE 0 END) AS code FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL),
        pairs AS (SELECT q.vec_id AS query_id, c.vec_id AS neighbour_id, CAST(list_sum(list_transform(list_zip(q.code, c.code), lambda p: CASE WHEN p[1] <> p[2] THEN 1 ELSE 0 END)) AS INTEGER) AS distance
                  FROM codes q JOIN codes c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id),
        ranked AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY distance, neighbour_id) AS INTEGER) AS rank, neighbour_id, distance FROM pairs)
        SELECT query_id, rank, neighbour_id, distance FROM ranked WHERE rank <= 10""",
    "op9_url_filter": f"""
        WITH rules(rule, r_host, r_path, verdict) AS (VALUES {_RULE_ROWS}),
        rest AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
        cut AS (SELECT page_id, regexp_extract(rest, '^[^/?#]*') AS h, rest FROM rest),
        parts AS (SELECT row_number() OVER () AS n, page_id, translate(h, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                         regexp_extract(substr(rest, length(h) + 1), '^[^?#]*') AS path FROM cut),
        best AS (SELECT n, max_by(rule, length(rule)) AS rule, max_by(verdict, length(rule)) AS verdict FROM parts JOIN rules
                 ON (host = r_host OR ends_with(host, '.' || r_host)) AND starts_with(path, r_path) GROUP BY n)
        SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM parts LEFT JOIN best USING (n)""",
    "op11_line_dedup": r"""
        WITH texts AS (SELECT row_number() OVER () AS n, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
        each AS (SELECT n, unnest(lines) AS line, unnest(range(len(lines))) AS pos FROM texts),
        keyed AS (SELECT n, line, pos, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM each),
        common AS (SELECT key FROM keyed WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT n) >= 10),
        marked AS (SELECT k.n, k.line, k.pos, c.key IS NOT NULL AS gone FROM keyed k LEFT JOIN common c ON k.key = c.key),
        cut AS (SELECT n, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped, coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '') AS kept FROM marked GROUP BY n)
        SELECT doc_id, n_lines, n_dropped, sha256(kept) AS kept_sha256 FROM texts JOIN cut USING (n)""",
    "op13_resampling": r"""
        WITH crcs AS (SELECT list_transform(range(256), lambda k: list_reduce(list_prepend(k, range(8)), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END)) AS crc),
        texts AS (SELECT row_number() OVER () AS n, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents),
        target AS (SELECT unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS word FROM benchmark),
        each AS (SELECT n, word, count(*) AS k FROM (SELECT n, unnest(words) AS word FROM texts) GROUP BY ALL),
        wide AS (SELECT word, hex(encode(word)) AS h FROM (SELECT word FROM each UNION SELECT word FROM target)),
        bytes AS (SELECT word, list_transform(range(length(h) // 2), lambda i: CAST('0x' || substr(h, 2 * i + 1, 2) AS BIGINT)) AS b FROM wide),
        hashed AS (SELECT word, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), b), lambda c, x: xor(c >> 8, crc[(xor(c, x) & 255) + 1])), 4294967295) % 10000 AS bucket FROM bytes, crcs),
        s AS (SELECT bucket, sum(k) AS s FROM each JOIN hashed USING (word) GROUP BY 1),
        t AS (SELECT bucket, count(*) AS t FROM target JOIN hashed USING (word) GROUP BY 1),
        gains AS (SELECT bucket, floor(1000 * ln(CAST(coalesce(t, 0) + 1 AS DOUBLE) * ((SELECT coalesce(sum(s), 0) FROM s) + 10000) / (CAST(coalesce(s, 0) + 1 AS DOUBLE) * ((SELECT coalesce(sum(t), 0) FROM t) + 10000)))) AS gain FROM s FULL JOIN t USING (bucket)),
        weights AS (SELECT n, CAST(sum(k * gain) AS BIGINT) AS weight FROM each JOIN hashed USING (word) JOIN gains USING (bucket) GROUP BY 1),
        scores AS (SELECT n, doc_id, len(words) AS n_features, coalesce(weight, 0) AS weight, coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('2024:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296))) AS BIGINT) AS score FROM texts LEFT JOIN weights USING (n)),
        ranks AS (SELECT n, row_number() OVER (ORDER BY score DESC, doc_id) AS r, count(*) OVER () AS many FROM scores WHERE n_features >= 20)
        SELECT doc_id, n_features, weight, score, CASE WHEN r <= many * 10 // 100 THEN r END AS rank FROM scores LEFT JOIN ranks USING (n)""",
    "op12_collocations": r"""
        WITH pieces AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
        lists AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
        grams AS (SELECT lang, 1 AS k, unnest(w) AS phrase FROM lists
                  UNION ALL SELECT lang, 2, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) FROM lists
                  UNION ALL SELECT lang, 3, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) FROM lists),
        f AS (SELECT lang, k, phrase, count(*) AS f FROM grams GROUP BY ALL),
        total AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM f WHERE k = 1 GROUP BY lang),
        c AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE k > 1 AND f >= 10),
        cut AS (SELECT lang, phrase, a, 1 AS j, w[1] AS x, array_to_string(w[2:], ' ') AS y FROM c UNION ALL SELECT lang, phrase, a, 2, array_to_string(w[1:2], ' '), w[3] FROM c WHERE k = 3),
        scored AS (SELECT cut.lang, cut.phrase, a, j, l.f AS l, r.f AS r, CAST((1000000::HUGEINT * a * a) // (l.f::HUGEINT * r.f) AS BIGINT) AS score FROM cut JOIN f l ON l.lang = cut.lang AND l.phrase = x JOIN f r ON r.lang = cut.lang AND r.phrase = y),
        lowest AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1),
        inner_ AS (SELECT lang, phrase, max(a) AS most FROM (SELECT lang, a, array_to_string(w[1:2], ' ') AS phrase FROM c WHERE k = 3 UNION ALL SELECT lang, a, array_to_string(w[2:3], ' ') FROM c WHERE k = 3) GROUP BY 1, 2),
        kept AS (SELECT s.* FROM lowest s LEFT JOIN inner_ i USING (lang, phrase) WHERE most IS NULL OR 100 * most < 50 * a)
        SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score FROM kept JOIN total USING (lang) QUALIFY rank <= 2000""",
}
