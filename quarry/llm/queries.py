"""The queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import lines, mixing, ngrams, rules, shards, simhash
from quarry.llm import license as licenses
from quarry.llm import toxicity as toxic
from quarry.llm.bpe import bpe
from quarry.llm.common import crc_mod, documents
from quarry.llm.multiset import edited_fingerprints


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    """Place of a public vocabulary file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SimHash fingerprints and components of all documents; see :func:`quarry.llm.simhash.near_duplicates` for nulls, ties and empty tables."""
    found = simhash.near_duplicates(documents(spark, sf_dir))
    return found.select("doc_id", simhash.hex16(F.col("fp")).alias("fingerprint"), "component_id")


def op2_ngram_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents by the trigram model of six sevenths of them; see :func:`quarry.llm.ngrams.score`."""
    return ngrams.score(documents(spark, sf_dir), ngrams.held_out_by("doc_id", 7, 2))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of all documents with the examples it rests on; see :func:`quarry.llm.toxicity.toxicity`."""
    found = toxic.toxicity(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return found.select("doc_id", (crc_mod("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "evidence")


def op4_license(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License phrases and notices in all documents; see :func:`quarry.llm.license.license_scan`."""
    return licenses.license_scan(documents(spark, sf_dir)).drop("blocks")


def op5_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What line dedup drops from each document and leaves of it; see :func:`quarry.llm.lines.dedup_lines`."""
    found = lines.dedup_lines(documents(spark, sf_dir).select("doc_id", "text"))
    return found.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


def op6_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ledger of all documents with the verdicts of two policies; see :func:`quarry.llm.rules.ledger`."""
    found = rules.ledger(documents(spark, sf_dir).select("doc_id", "text"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", (~rules.kept("base-1")).alias("base_failed"), rules.kept("full-1").alias("kept"), "failures")


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Posteriors, rate and copies of each document; see :func:`quarry.llm.mixing.decided`."""
    return mixing.decided(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op8_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all texts and of their edited texts; see :func:`quarry.llm.multiset.edited_fingerprints`."""
    return edited_fingerprints(documents(spark, sf_dir))


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shards and slots of all documents, with one shard more too; see :func:`quarry.llm.shards.sharded`."""
    return shards.sharded(documents(spark, sf_dir))


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of all documents' token ids and decoded texts; see :func:`quarry.llm.bpe.bpe`."""
    return bpe(documents(spark, sf_dir), tokenizer_path()).select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " ").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_simhash, op2_ngram_lm, op3_toxicity, op4_license, op5_lines, op6_rules, op7_mixing, op8_fingerprints, op9_sharding, op10_bpe)
}

#: A-Z to lower case, and the blanks, in DuckDB.
_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_BLANKS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"

#: The draw of a child's name for a row's key, by the first 52 bits of an md5.
_DRAW = "-ln((('0x' || left(md5({} || ':' || key), 13))::BIGINT + 0.5) / 4503599627370496.0)"

ORACLE_SQL: dict[str, str] = {
    "op5_lines": f"""
        WITH each AS (
            SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
                   generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i
            FROM documents),
        keyed AS (SELECT *, {_LOWER.format(f"trim(line, {_BLANKS})")} AS key FROM each),
        often AS (
            SELECT key, max(doc_id) AS keeper FROM keyed WHERE length(key) >= 20
            GROUP BY key HAVING count(DISTINCT doc_id) >= 3)
        SELECT doc_id, count(*) AS n_lines,
               count(*) FILTER (WHERE doc_id < keeper) AS n_dropped,
               sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE keeper IS NULL OR doc_id >= keeper), '')) AS kept_sha256
        FROM keyed LEFT JOIN often USING (key) GROUP BY doc_id""",
    "op6_rules": f"""
        WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
        w AS (
            SELECT doc_id, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
                   list_filter(string_split(t, chr(10)), lambda x: trim(x, {_BLANKS}) <> '') AS l,
                   length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
                   length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS word_chars FROM d),
        g AS (
            SELECT doc_id, i, array_to_string(w[i:i + 7], ' ') AS g
            FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS i FROM w WHERE len(w) >= 8)),
        again AS (SELECT doc_id, i FROM g QUALIFY count(*) OVER (PARTITION BY doc_id, g) >= 2),
        steps AS (SELECT doc_id, least(8, i - coalesce(lag(i) OVER (PARTITION BY doc_id ORDER BY i), -8)) AS n FROM again),
        r AS (SELECT doc_id, sum(n) AS n FROM steps GROUP BY doc_id),
        m AS (
            SELECT doc_id, len(w)::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols,
                   len(l)::BIGINT AS n_lines, (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(r.n, 0)::BIGINT AS n_repeat_words
            FROM w LEFT JOIN r USING (doc_id)),
        f AS (
            SELECT *, (CASE WHEN n_words < 20 THEN 1 ELSE 0 END
                + CASE WHEN 100 * n_repeat_words > 30 * n_words THEN 2 ELSE 0 END
                + CASE WHEN 2 * n_symbols > n_words THEN 4 ELSE 0 END
                + CASE WHEN n_dup_lines >= 4 AND 2 * n_dup_lines > n_lines THEN 8 ELSE 0 END
                + CASE WHEN word_chars > 40 * n_words THEN 16 ELSE 0 END)::BIGINT AS failures FROM m)
        SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
               failures & 3 <> 0 AS base_failed, failures = 0 AS kept, failures FROM f""",
    "op9_sharding": f"""
        WITH crc AS (
            SELECT list_transform(range(256), lambda b: list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, b)) AS t),
        d AS (
            SELECT row_number() OVER () AS n, doc_id, coalesce(doc_id::VARCHAR, '') AS key, hex(encode(coalesce(text, ''))) AS h FROM documents),
        sized AS (
            SELECT n, doc_id, key, length(h) // 2 + 16 AS size,
                   xor(list_reduce(list_transform(regexp_extract_all(h, '..'), lambda x: ('0x' || x)::BIGINT),
                                   lambda c, b: xor(c >> 8, t[1 + (xor(c, b) & 255)]), 4294967295), 4294967295)::BIGINT AS text_crc32
            FROM d, crc),
        leaves AS (
            SELECT shards, i, CASE WHEN i < 40 THEN 'r' || 2 * (i // 8) ELSE 'rs' || i END AS region,
                   CASE WHEN i < 40 THEN 'k' || 4 * (i // 4) ELSE 'ks' || i END AS rack
            FROM (SELECT shards, unnest(range(shards)) AS i FROM (VALUES (40), (41)) AS v(shards))),
        regions AS (SELECT shards, region, min(i) AS i, count(*) AS weight FROM leaves GROUP BY ALL),
        racks AS (SELECT shards, region, rack, min(i) AS i, count(*) AS weight FROM leaves GROUP BY ALL),
        a AS (SELECT n, key, shards, arg_min(region, ({_DRAW.format("region")} / weight, i)) AS region FROM sized, regions GROUP BY ALL),
        b AS (SELECT n, key, shards, arg_min(rack, ({_DRAW.format("rack")} / weight, i)) AS rack FROM a JOIN racks USING (shards, region) GROUP BY ALL),
        c AS (SELECT n, shards, arg_min(i, ({_DRAW.format("'s' || i")}, i)) AS shard FROM b JOIN leaves USING (shards, rack) GROUP BY ALL)
        SELECT doc_id, size, text_crc32, 'key' AS law, x.shard::INTEGER AS shard,
               row_number() OVER (PARTITION BY x.shard ORDER BY doc_id NULLS FIRST, text_crc32, size) - 1 AS slot, y.shard::INTEGER AS grown_shard
        FROM sized JOIN c x USING (n) JOIN c y USING (n) WHERE x.shards = 40 AND y.shards = 41""",
}
