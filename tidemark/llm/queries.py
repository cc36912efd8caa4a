"""The queries of ``__spark_entry__`` over these operators, with production parameters."""

from __future__ import annotations

import secrets
import warnings
from collections.abc import Callable
from functools import cache

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import line_dedup, packing, pieces, pii, prefix_trie, quality, rollup, simhash, suffix_dedup
from tidemark.llm import token_files, topk, vector_codes, word_windows
from tidemark.llm.frames import staged
from tidemark.session import scratch_path

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
EXPECTED: dict[str, str] = {}
BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")
MULTI_BPE = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
PIECES = public_tokenizers.path("piece_bpe_32k.model")
#: Key of the pseudonyms where a local session names none: good for a trial, not for a release.
KEY_SETTING, TRIAL_KEY = "spark.tidemark.pii.key", "trial key"
#: Documents below so many tokens are deleted from the totals.
SHORT = 16


def query(run: Query) -> Query:
    QUERIES[run.__name__] = run
    return run


EXPECTED["op6_top_k"] = """
WITH v AS (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS q FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
scored AS (
  SELECT a.r, a.vec_id AS query_id, b.vec_id, CAST(list_inner_product(a.q, b.q) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.r <> b.r),
ranked AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
  FROM scored)
SELECT * FROM ranked WHERE rank <= 5"""
EXPECTED["op7_line_dedup"] = """
WITH split AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
placed AS (SELECT doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS place FROM split),
keyed AS (
  SELECT doc_id, line, place, translate(trim(line, concat(' ', chr(9), chr(10), chr(11), chr(12), chr(13))),
         'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM placed),
shared AS (
  SELECT key, min(doc_id) AS first FROM keyed WHERE length(key) >= 10 GROUP BY key HAVING min(doc_id) <> max(doc_id)),
marked AS (SELECT k.*, coalesce(s.first <> k.doc_id, false) AS gone FROM keyed k LEFT JOIN shared s ON k.key = s.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id"""

EXPECTED["op11_super_kmers"] = r"""
WITH split AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
placed AS (SELECT doc_id, len(words) AS n, unnest(words) AS word, generate_subscripts(words, 1) AS place FROM split),
starts AS (
  SELECT doc_id, unnest(range(1, len(words) - 48)) AS place, words FROM split WHERE len(words) >= 50),
windows AS (SELECT doc_id, place, md5(array_to_string(list_slice(words, place, place + 49), ' ')) AS w FROM starts),
first AS (SELECT w, min(doc_id) AS least FROM windows GROUP BY w),
late AS (SELECT DISTINCT doc_id, place FROM windows JOIN first USING (w) WHERE least < doc_id),
marked AS (
  SELECT p.doc_id, p.place, p.word, coalesce(max(l.place) OVER (
    PARTITION BY p.doc_id ORDER BY p.place ROWS BETWEEN 49 PRECEDING AND CURRENT ROW), 0) > 0 AS gone
  FROM placed p LEFT JOIN late l USING (doc_id, place)),
counted AS (
  SELECT doc_id, count(*) AS n_words, count(*) FILTER (gone) AS n_removed,
         string_agg(word, ' ' ORDER BY place) FILTER (NOT gone) AS kept
  FROM marked GROUP BY doc_id)
SELECT s.doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM split s LEFT JOIN counted USING (doc_id)"""

EXPECTED["op12_prefix_trie"] = """
WITH turns AS (
  SELECT conv_id, row_number() OVER (
           PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS k,
         struct_pack(role := coalesce(role, ''), text := coalesce(text, '')) AS u
  FROM conversations WHERE conv_id IS NOT NULL),
own AS (SELECT conv_id AS c, list(u ORDER BY k) AS seq FROM turns GROUP BY conv_id),
steps AS (
  SELECT c, seq, flatten(list_transform(string_split(CAST(c AS VARCHAR), ''), lambda x: list_prepend(
    CAST(ascii(x) AS BIGINT), CAST([-1, -1, -1, -1, -1, -1, -1, -1] AS BIGINT[])))) AS s
  FROM own),
heads AS (
  SELECT c, seq, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), s), lambda a, b: CASE WHEN b >= 0 THEN xor(a, b)
    ELSE xor(a >> 1, CAST(3988292384 AS BIGINT) * (a & 1)) END), CAST(4294967295 AS BIGINT)) % 9 AS h
  FROM steps),
built AS (
  SELECT o.c, list_concat(coalesce(list_filter(b.seq, lambda x, i: i <= o.h), []), list_filter(o.seq, lambda x, i: i > o.h)) AS seq
  FROM heads o LEFT JOIN own b ON b.c = o.c - o.c % 5),
prefixes AS (
  SELECT c, len(seq) AS n, seq, unnest(range(0, len(seq) + 1)) AS depth FROM built),
named AS (
  SELECT c, n, depth, list_filter(seq, lambda x, i: i <= depth) AS path FROM prefixes),
nodes AS (
  SELECT path, any_value(depth) AS depth, min(c) AS conv_id, count(*) AS n_convs,
         coalesce(any_value(strlen(path[depth].text)), 0) AS bytes,
         sha256(coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (n = depth), '')) AS ends_sha256
  FROM named GROUP BY path),
above AS (SELECT *, list_filter(path, lambda x, i: i < depth) AS parent FROM nodes),
children AS (SELECT parent, count(*) AS n_children FROM above WHERE depth > 0 GROUP BY parent),
counted AS (SELECT a.*, coalesce(k.n_children, 0) AS n_children FROM above a LEFT JOIN children k ON k.parent = a.path),
spread AS (
  SELECT path, CAST(n_children = 0 AS BIGINT) AS leaf, (n_convs - 1) * bytes AS saved, unnest(range(0, depth + 1)) AS d FROM counted),
sums AS (
  SELECT list_filter(path, lambda x, i: i <= d) AS path, CAST(sum(leaf) AS BIGINT) AS n_leaves, CAST(sum(saved) AS BIGINT) AS saved_tokens
  FROM spread GROUP BY 1)
SELECT c.conv_id, c.depth, p.conv_id AS parent_conv_id, c.n_convs, c.n_children, s.n_leaves, s.saved_tokens, c.ends_sha256
FROM counted c JOIN sums s ON s.path = c.path LEFT JOIN nodes p ON c.depth > 0 AND p.path = c.parent"""


def _codes_sql(parts: int = 8, entries: int = 16, rounds: int = 6) -> str:
    """Rounds written out one after another; a distance and its entry are compared as one number."""
    steps = []
    for k in range(rounds + 1):
        steps.append(f"""near{k} AS MATERIALIZED (
  SELECT r, p, min(list_sum(list_transform(list_zip(a.v, b.v), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) * {entries} + e) AS best
  FROM cut a JOIN book{k} b USING (p) GROUP BY r, p)""")
        if k < rounds:
            steps.append(f"""book{k + 1} AS MATERIALIZED (
  WITH cells AS (
    SELECT p, CAST(best % {entries} AS BIGINT) AS e, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM near{k} JOIN cut USING (r, p)),
  means AS (SELECT p, e, i, CAST(floor(sum(x) / count(*)) AS BIGINT) AS x FROM cells GROUP BY p, e, i),
  moved AS (SELECT p, e, list(x ORDER BY i) AS v FROM means GROUP BY p, e)
  SELECT p, e, coalesce(m.v, b.v) AS v FROM book{k} b LEFT JOIN moved m USING (p, e))""")
    return f"""
WITH kept AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY vec_id, embedding) AS r, vec_id, label,
         list_transform(embedding, lambda x: CAST(floor(4096 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
cut AS MATERIALIZED (
  SELECT r, p, v[p * (len(v) // {parts}) + 1 : (p + 1) * (len(v) // {parts})] AS v
  FROM kept, (SELECT unnest(range({parts})) AS p)),
book0 AS MATERIALIZED (SELECT p, r - 1 AS e, v FROM cut WHERE r <= {entries}),
{", ".join(steps)},
coded AS (
  SELECT r, string_agg(printf('%02x', CAST(best % {entries} AS BIGINT)), '' ORDER BY p) AS code,
         CAST(sum((best - best % {entries}) // {entries}) AS BIGINT) AS error
  FROM near{rounds} GROUP BY r),
digest AS (
  SELECT sha256(string_agg(list_aggregate(v, 'string_agg', ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM book{rounds})
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256
FROM coded JOIN kept USING (r), digest"""


EXPECTED["op13_limb_codes"] = _codes_sql()


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@cache
def _own_key(application: str) -> str:
    """A secret key for one Spark application, held by its driver and gone with it."""
    warnings.warn(f"{KEY_SETTING} is not set: the pseudonyms of {application} can be neither undone nor linked after it ends", stacklevel=3)
    return secrets.token_hex(32)


def pii_key(spark: SparkSession) -> bytes:
    """The key that the session names. A local master that names none takes the trial key. Whoever knows
    that one can undo its pseudonyms, so an application on a cluster gets a secret key of its own instead."""
    key = spark.conf.get(KEY_SETTING, None)
    if not key:
        context = spark.sparkContext
        key = TRIAL_KEY if context.master.startswith("local") else _own_key(context.applicationId)
    return key.encode()


@query
def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as token files, read back."""
    folder = scratch_path(spark, "tokens")
    token_files.write_token_files(documents(spark, sf_dir), BYTE_BPE, folder)
    return token_files.read_token_files(spark, folder).select(
        "doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32")
    )


@query
def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without the bytes of 100-byte strings that start earlier."""
    found = suffix_dedup.remove_repeats(documents(spark, sf_dir), scratch_path(spark, "suffixes"))
    return found.select(
        "doc_id",
        "n_bytes",
        (F.col("n_bytes") - F.length("kept")).alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


@query
def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents encoded and decoded again."""
    return pieces.round_trip(documents(spark, sf_dir), PIECES)


@query
def op4_compression_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, ratios and verdict of all documents."""
    return quality.measure(documents(spark, sf_dir))


@query
def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of 2048 tokens."""
    packed = packing.pack(documents(spark, sf_dir), BYTE_BPE, scratch_path(spark, "packed"))
    return packed.select(
        "doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"), "sequence_id", F.col("offset").cast("long")
    )


@query
def op6_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five best products of every fiftieth vector with all others."""
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return topk.top_k(vectors, F.col("vec_id") % 50 == 0, scratch_path(spark, "topk"))


@query
def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without the lines of earlier ones."""
    found = line_dedup.dedup_lines(documents(spark, sf_dir), scratch_path(spark, "lines"))
    return found.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


@query
def op8_token_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals after four batches: all documents, short ones deleted, other languages recounted with
    another tokenizer, and the first batch once more, which changes nothing."""
    folder = scratch_path(spark, "totals")
    first = rollup.Version("byte_bpe_50k", BYTE_BPE)
    second = rollup.Version("byte_bpe_multi_50k", MULTI_BPE, public_tokenizers.PATTERN)
    other = F.col("lang") != "en"
    counts = staged(rollup.counted_twice(documents(spark, sf_dir), first, second, other), f"{folder}/counts")
    load = rollup.inserts(rollup.tokens_of(counts, "old", first))
    short = counts.filter(F.col("old") < SHORT)
    again = counts.filter((F.col("old") >= SHORT) & F.col("new").isNotNull())
    totals = rollup.TokenTotals(spark, folder)
    totals.apply("load", load)
    totals.apply("short", rollup.deletes(rollup.tokens_of(short, "old", first)))
    totals.apply("recount", rollup.revisions(rollup.tokens_of(again, "old", first), rollup.tokens_of(again, "new", second)))
    totals.apply("load", load)
    return totals.totals()


@query
def op9_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with personal data replaced, and how much of each kind."""
    return pii.pseudonymized(documents(spark, sf_dir), pii_key(spark))


@query
def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate classes of all documents."""
    found = simhash.near_duplicates(documents(spark, sf_dir), scratch_path(spark, "simhash"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


@query
def op11_super_kmers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without the words of 50-word windows that an earlier document holds."""
    found = word_windows.remove_shared_windows(documents(spark, sf_dir), scratch_path(spark, "windows"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


@query
def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes of the prefix tree of all rebuilt conversations."""
    folder = scratch_path(spark, "trie")
    own = staged(prefix_trie.turns(spark.read.parquet(f"{sf_dir}/conversations.parquet")), f"{folder}/own")
    return prefix_trie.prefix_trie(prefix_trie.rebuilt(own), folder)


@query
def op13_limb_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes of all vectors, their errors, and the hash of the codebooks."""
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    coded, books = vector_codes.encode(vectors, scratch_path(spark, "codes"))
    digest = F.lit(vector_codes.books_sha256(books)).alias("codebooks_sha256")
    return coded.select("vec_id", F.lower(F.hex("code")).alias("code"), "error", "label_error", digest)
