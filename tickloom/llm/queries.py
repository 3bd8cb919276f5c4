"""One query per operator over its whole table, and the SQL that states the same where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..session import staging_path
from . import language, merkle, quality_model
from .bin_slack import pack_full
from .common import table
from .decontaminate import contamination_report, find_contamination
from .lexical import rank_documents
from .minhash import near_duplicates
from .packing import digests as piece_digests, pack
from .quality_rules import quality_rules
from .substrings import substring_dedup
from .token_store import FORMAT, digests, read_tokens, with_starts, write_tokens
from .url_filter import Rule, filter_urls, host_of
from .warc import read_archive, write_archive

VOCABULARY = "word_bpe_49k.json"

RULES = (
    Rule("allow", "org", "/"),
    Rule("block", "example.org", "/es/"),
    Rule("block", "example.org", "/en/1"),
    Rule("allow", "com", "/fr/"),
    Rule("block", "com", "/de/"),
)
#: Stand-in for a published list of URLs: those of the table on hosts with one of these labels.
LISTED_LABELS = "ads-track|spam-farm|casino-win|adult-x|cheap-pills|free-bets"


def vocabulary(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_minhash(spark: SparkSession, folder: str) -> DataFrame:
    return near_duplicates(table(spark, folder, "documents"), size=4, percent=80)


def op2_quality_classifier(spark: SparkSession, folder: str) -> DataFrame:
    docs, labels = table(spark, folder, "documents"), table(spark, folder, "labels")
    rated = labels.select("doc_id", quality_model.rating(F.col("quality"), F.col("toxic")).alias("grade"))
    model = quality_model.fit(docs, rated, n_grades=3, reach=2)
    return quality_model.grade(docs, model, reach=2)


def op3_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    pages = table(spark, folder, "pages")
    listed = pages.filter(host_of(F.col("url")).rlike(rf"(^|\.)({LISTED_LABELS})\."))
    return filter_urls(pages, listed, RULES).select("page_id", "host", "path", "rule", "verdict")


def op4_token_store(spark: SparkSession, folder: str) -> DataFrame:
    path = staging_path(spark, "tokens")
    write_tokens(table(spark, folder, "documents"), path, vocabulary(), end=1)
    found = with_starts(digests(read_tokens(spark, path)))
    return found.select("doc_id", "start", "n_tokens", "ids_crc32")


def op5_warc(spark: SparkSession, folder: str) -> DataFrame:
    path = staging_path(spark, "archive")
    write_archive(table(spark, folder, "pages"), path, least=0)
    return read_archive(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op6_decontaminate(spark: SparkSession, folder: str) -> DataFrame:
    docs, benchmark = table(spark, folder, "documents"), table(spark, folder, "benchmark")
    return contamination_report(find_contamination(docs, benchmark))


def op7_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    done = substring_dedup(table(spark, folder, "documents"), size=13, joiner=" ")
    return done.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op8_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    return quality_rules(table(spark, folder, "documents"))


def op9_language(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").withColumn("held_out", language.held_out())
    model = language.fit(docs.filter("NOT held_out"), "lang", "text", "doc_id")
    return language.identify(docs, model, carry=("held_out",))


def op10_packing(spark: SparkSession, folder: str) -> DataFrame:
    path = staging_path(spark, "packed")
    packed = pack(table(spark, folder, "documents"), vocabulary(), end=2)
    packed.write.options(**FORMAT).parquet(path)
    found = piece_digests(spark.read.schema(packed.schema).parquet(path))
    return found.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def op11_best_fit(spark: SparkSession, folder: str) -> DataFrame:
    packed = pack_full(table(spark, folder, "documents"), vocabulary(), end=1)
    found = piece_digests(packed)
    return found.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op12_lexical(spark: SparkSession, folder: str) -> DataFrame:
    return rank_documents(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


def op13_merkle(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    fields = ("doc_id", "source", "lang", "n_chars", "text")
    tampered = F.crc32(F.col("doc_id").cast("string")) % 7 == 0
    offered = [F.when(tampered, F.col(c) + 1).otherwise(F.col(c)) if c == "n_chars" else F.col(c) for c in fields]
    leaves = docs.select(
        "doc_id", "lang", merkle.leaf(*[F.col(c) for c in fields]).alias("leaf"), merkle.leaf(*offered).alias("offered")
    )
    found = merkle.verify(merkle.manifest(leaves, carry=["offered"]), "offered")
    digests = [F.lower(F.hex(c)).alias(c) for c in ("leaf", "subroot", "root")]
    return found.select("doc_id", *digests, "proof_sha256", F.lower(F.hex("folded_root")).alias("folded_root"), "verified")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_minhash,
        op2_quality_classifier,
        op3_url_filter,
        op4_token_store,
        op5_warc,
        op6_decontaminate,
        op7_substring_dedup,
        op8_quality_rules,
        op9_language,
        op10_packing,
        op11_best_fit,
        op12_lexical,
        op13_merkle,
    )
}

_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_SPACED = r"'[^\x20\x09-\x0D]+'"

_LEAF = "sha256(" + " || ".join(
    f"coalesce(octet_length(encode(CAST({c} AS VARCHAR))) || ':' || CAST({c} AS VARCHAR), '-')" for c in ("doc_id", "source", "lang", "{0}", "text")
) + ")"

ORACLES: dict[str, str] = {
    "op1_minhash": f"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, {_SPACED}) AS w FROM documents
), shingles AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 3], ' ') AS s
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 2))) AS i FROM words WHERE len(w) > 0)
), sizes AS (
  SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id
), links AS (
  SELECT a, b FROM (
    SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c
    FROM shingles x JOIN shingles y ON x.s = y.s AND x.doc_id < y.doc_id GROUP BY ALL)
  JOIN sizes p ON p.doc_id = a JOIN sizes q ON q.doc_id = b
  WHERE 100 * c >= 80 * (p.n + q.n - c)
), both_ways AS (SELECT a, b FROM links UNION SELECT b, a FROM links
), reach AS (
  SELECT doc_id AS a, doc_id AS b FROM documents
  UNION SELECT r.a, l.b FROM reach r JOIN both_ways l ON r.b = l.a
), lowest AS (SELECT a, min(b) AS c FROM reach GROUP BY a)
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, c AS component_id, c = d.doc_id AS kept
FROM documents d LEFT JOIN sizes USING (doc_id) JOIN lowest ON a = d.doc_id
""",
    "op3_url_filter": rf"""
WITH parts AS (
  SELECT page_id,
    {_LOWER.format("regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1)")} AS host,
    regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path,
    list_sort(list_filter(string_split(regexp_extract(coalesce(url, ''), '(?s)^[^?#]*\?([^#]*)', 1), '&'),
      lambda x: x <> '' AND NOT regexp_matches(x, '^(utm_[a-z]+|ref|fbclid|gclid)(=|$)'))) AS q
  FROM pages
), keyed AS (
  SELECT *, regexp_replace(regexp_replace(host, '^www\.', ''), ':(80|443)$', '') || regexp_replace(path, '/+$', '')
    || CASE WHEN len(q) > 0 THEN '?' || array_to_string(q, '&') ELSE '' END AS key
  FROM parts
), listed AS (
  SELECT DISTINCT key FROM keyed WHERE regexp_matches(host, '(^|\.)({LISTED_LABELS})\.') AND key <> ''
), rules(verdict, h, p) AS (VALUES {", ".join(f"('{r.verdict}', '{r.host}', '{r.path}')" for r in RULES)}
), best AS (
  SELECT page_id, arg_max(h || p, length(h || p)) AS rule, arg_max(verdict, length(h || p)) AS v
  FROM (SELECT DISTINCT page_id, host, path FROM keyed)
  JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY page_id
)
SELECT k.page_id, host, path, rule,
  coalesce(v, CASE WHEN l.key IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict
FROM keyed k LEFT JOIN best b ON b.page_id = k.page_id LEFT JOIN listed l ON l.key = k.key
""",
    "op5_warc": """
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha1(coalesce(html, '')) AS h,
    min(page_id) OVER (PARTITION BY coalesce(html, '')) AS f FROM pages
)
SELECT page_id, n::BIGINT AS payload_bytes,
  translate(lpad(to_base(('0x' || h[1:10])::BIGINT, 32), 8, '0') || lpad(to_base(('0x' || h[11:20])::BIGINT, 32), 8, '0')
    || lpad(to_base(('0x' || h[21:30])::BIGINT, 32), 8, '0') || lpad(to_base(('0x' || h[31:40])::BIGINT, 32), 8, '0'),
    '0123456789ABCDEFGHIJKLMNOPQRSTUV', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567') AS payload_digest,
  CASE WHEN f < page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN f < page_id THEN f END AS refers_to
FROM p
""",
    "op6_decontaminate": rf"""
WITH items AS (
  SELECT item_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), grams AS (
  SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS g
  FROM (SELECT item_id, w, least(len(w), 10) AS n, unnest(range(1, greatest(len(w) - 8, 2))) AS i FROM items WHERE len(w) > 0)
), docs AS (
  SELECT doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), windows AS (
  SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS g
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM docs, (SELECT DISTINCT n FROM grams))
), met AS (
  SELECT DISTINCT doc_id, i, n, item_id FROM windows JOIN grams USING (n, g)
), hit AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM met) GROUP BY doc_id
), named AS (
  SELECT doc_id, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS names
  FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS x FROM met) GROUP BY doc_id
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM docs LEFT JOIN hit USING (doc_id) LEFT JOIN named USING (doc_id)
""",
    "op7_substring_dedup": f"""
WITH docs AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), {_SPACED}) AS w FROM documents
), windows AS (
  SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM docs)
), firsts AS (SELECT g, min(doc_id) AS f FROM windows GROUP BY g
), gone AS (
  SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS p FROM windows JOIN firsts USING (g) WHERE f < doc_id
), left_over AS (
  SELECT doc_id, string_agg(x, ' ' ORDER BY p) AS kept, count(*) AS n
  FROM (SELECT doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS p FROM docs)
  ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id
)
SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM docs LEFT JOIN left_over USING (doc_id)
""",
    "op12_lexical": rf"""
WITH docs AS (
  SELECT *, len(w) AS n, row_number() OVER () AS d FROM (
    SELECT doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents)
  WHERE len(w) > 0
), sums AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS words FROM docs
), postings AS (
  SELECT d, doc_id, n, term, count(*) AS tf FROM (SELECT d, doc_id, n, unnest(w) AS term FROM docs) GROUP BY ALL
), weights AS (
  SELECT term, CAST(floor(1000 * ln((2 * docs + 2) / (2 * count(*) + 1))) AS BIGINT) AS weight FROM postings, sums GROUP BY term, docs
), asked AS (
  SELECT i, item_id, term, count(*) AS times FROM (
    SELECT row_number() OVER () AS i, item_id,
      unnest(regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS term FROM benchmark)
  GROUP BY ALL
), scores AS (
  SELECT i, item_id, d, doc_id, CAST(sum(times * weight * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * docs) // words)))) AS BIGINT) AS score
  FROM asked JOIN postings USING (term) JOIN weights USING (term), sums GROUP BY ALL
)
SELECT item_id, rank, doc_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id NULLS FIRST) AS rank FROM scores WHERE score > 0)
WHERE rank <= 10
""",
    "op13_merkle": f"""
WITH RECURSIVE bits AS (
  SELECT i, 0 AS k, i AS v FROM range(256) AS r(i)
  UNION ALL SELECT i, k + 1, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END FROM bits WHERE k < 8
), codes AS (SELECT list(v ORDER BY i) AS t FROM bits WHERE k = 8
), told AS (
  SELECT *, xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))),
      lambda c, b: xor(c >> 8, t[xor(c, b) % 256 + 1]))) % 7 = 0 AS tampered
  FROM documents, codes
), leaves AS (
  SELECT doc_id, lang, {_LEAF.format("n_chars")} AS leaf, {_LEAF.format("n_chars + CAST(coalesce(tampered, false) AS BIGINT)")} AS offered FROM told
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx, count(*) OVER (PARTITION BY lang) AS n FROM leaves
), nodes AS (
  SELECT lang, 0 AS level, idx, leaf AS d, n FROM placed
  UNION ALL
  SELECT lang, level + 1, idx // 2, sha256(string_agg(d, '' ORDER BY idx)), (n + 1) // 2 FROM nodes WHERE n > 1 GROUP BY lang, level, idx // 2, n
), subroots AS (
  SELECT lang, d AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS idx, count(*) OVER () AS n FROM nodes WHERE n = 1
), tops AS (
  SELECT 0 AS level, idx, subroot AS d, n FROM subroots
  UNION ALL
  SELECT level + 1, idx // 2, sha256(string_agg(d, '' ORDER BY idx)), (n + 1) // 2 FROM tops WHERE n > 1 GROUP BY level, idx // 2, n
), walk AS (
  SELECT doc_id, lang, leaf, idx AS place, 0 AS level, idx, n, offered AS folded, '' AS others FROM placed
  UNION ALL
  SELECT w.doc_id, w.lang, w.leaf, w.place, w.level + 1, w.idx // 2, (w.n + 1) // 2,
    sha256(CASE WHEN w.idx % 2 = 1 THEN s.d || w.folded ELSE w.folded || coalesce(s.d, '') END), w.others || coalesce(s.d, '')
  FROM walk w LEFT JOIN nodes s ON s.lang IS NOT DISTINCT FROM w.lang AND s.level = w.level AND s.idx = xor(w.idx, 1)
  WHERE w.n > 1
), climb AS (
  SELECT w.doc_id, w.lang, w.leaf, w.place, r.subroot, 0 AS level, r.idx, r.n, w.folded, w.others
  FROM walk w JOIN subroots r ON r.lang IS NOT DISTINCT FROM w.lang WHERE w.n = 1
  UNION ALL
  SELECT c.doc_id, c.lang, c.leaf, c.place, c.subroot, c.level + 1, c.idx // 2, (c.n + 1) // 2,
    sha256(CASE WHEN c.idx % 2 = 1 THEN s.d || c.folded ELSE c.folded || coalesce(s.d, '') END), c.others || coalesce(s.d, '')
  FROM climb c LEFT JOIN tops s ON s.level = c.level AND s.idx = xor(c.idx, 1)
  WHERE c.n > 1
)
SELECT doc_id, leaf, subroot, t.d AS root, sha256(others) AS proof_sha256, folded AS folded_root, folded = t.d AS verified
FROM climb c, tops t WHERE c.n = 1 AND t.n = 1
""",
}
