"""The registered queries of this subpackage: one per operator, over whole tables.

Each takes its rows from its operator and derives the digests that are compared.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import langid, media, secrets
from .ann import nearest
from .bpe import encode_documents
from .collocations import collocations
from .common import shared_dir, table
from .kmeans import cluster
from .packing import pack_documents
from .simhash import near_duplicates
from .substringdedup import remove_repeated_words
from .suffixdedup import remove_repeated_bytes
from .urlfilter import filter_urls
from .warc import read_warc, write_warc

#: The rules of op1: action, host, path.
URL_RULES = [("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/")]


def op1_urlfilter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "action string, host string, path string")
    return filter_urls(table(spark, sf_dir, "pages"), rules)


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return out.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op3_substringdedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeated_words(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op4_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    found = langid.identify(docs, langid.train(docs.where(~held_out)))
    return found.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "lang_pred", "score")


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = encode_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, decode=True)
    return out.select("doc_id", (F.length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op7_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"))


def op8_suffixdedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeated_bytes(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = secrets.scan(docs, secrets.train(docs))
    text = lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))
    joined = lambda spans: F.array_join(F.transform(spans, text), ",")
    count = lambda kind: F.size(F.filter("found", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("found", lambda s: s["kind"] != "random")
    return found.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("found")).alias("spans"))


def op10_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recordings rendered from ``embeddings`` (there is no media table): fingerprints of all, all alignments of every hundredth."""
    return media.align(media.fingerprint(media.render(table(spark, sf_dir, "embeddings"))))


def op11_kmeans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = cluster(table(spark, sf_dir, "embeddings"))
    digest = F.sha2(F.array_join(F.transform("centroid", lambda c: c.cast("string")), ","), 256)
    return found.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", digest.alias("centroid_sha256"))


def op12_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page written to archives in the shared folder, and read back from them."""
    root = f"{shared_dir(spark)}/quillmesh/warc-{uuid.uuid4().hex}"
    write_warc(table(spark, sf_dir, "pages"), root)
    return read_warc(spark, root, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


def _kmeans_sql(k: int = 8, rounds: int = 10, dim: int = 64) -> str:
    """Plain rounds, one after the other: every vector against every centroid."""
    square = "list_sum(list_transform(range(1, 65), lambda j: (x.v[j] - c.v[j]) * (x.v[j] - c.v[j])))::BIGINT".replace("65", str(dim + 1))
    parts = [
        f"""k AS MATERIALIZED (SELECT row_number() OVER () AS row, vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS v FROM embeddings
 WHERE len(embedding) = {dim} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {dim})""",
        f"c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h) - 1 AS cluster, v FROM (SELECT sha256('3:' || vec_id) AS h, v FROM k ORDER BY h LIMIT {k}))",
    ]
    for i in range(rounds + 1):
        parts.append(f"a{i} AS MATERIALIZED (SELECT row, first(cluster ORDER BY d, cluster) AS cluster, min(d) AS d FROM (SELECT x.row, c.cluster, {square} AS d FROM k x, c{i} c) GROUP BY row)")
        if i < rounds:
            parts.append(f"""c{i + 1} AS MATERIALIZED (SELECT c.cluster, coalesce(n.v, c.v) AS v FROM c{i} c LEFT JOIN (SELECT cluster, list(m ORDER BY j) AS v FROM (
 SELECT cluster, j, ((sum(x) - ((sum(x) % count(*)) + count(*)) % count(*)) // count(*))::BIGINT AS m FROM (SELECT a.cluster, unnest(k.v)::HUGEINT AS x, unnest(range({dim})) AS j FROM k JOIN a{i} a USING (row)) GROUP BY cluster, j) GROUP BY cluster) n USING (cluster))""")
    end = f"a{rounds}"
    return "WITH " + ",\n".join(parts) + f"""
SELECT k.vec_id, {end}.cluster::INTEGER AS cluster, {end}.d AS distance, (sum({end}.d) OVER (PARTITION BY {end}.cluster))::BIGINT AS cluster_inertia, (sum({end}.d) OVER ())::BIGINT AS inertia,
 sha256(array_to_string(c.v, ',')) AS centroid_sha256 FROM k JOIN {end} USING (row) JOIN c{rounds} c ON c.cluster = {end}.cluster"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    named = [op1_urlfilter, op2_packing, op3_substringdedup, op4_langid, op5_simhash, op6_bpe, op7_ann, op8_suffixdedup, op9_secrets, op10_media, op11_kmeans, op12_warc, op13_collocations]
    return {f.__name__: f for f in named}


def oracle_sql() -> dict[str, str]:
    return {
        "op1_urlfilter": """
WITH u AS (
  SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages
), p AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u
), r(action, rhost, rpath) AS (
  VALUES ('block', 'com', '/en/'), ('allow', 'example.com', '/en/7'), ('allow', 'net', '/de/'), ('block', 'example.net', '/de/8'), ('block', 'org', '/es/')
), best AS (
  SELECT page_id, first(rhost || rpath ORDER BY length(rhost || rpath) DESC, length(rhost) DESC, action) AS rule,
         first(action ORDER BY length(rhost || rpath) DESC, length(rhost) DESC, action) AS action
  FROM p JOIN r ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath) GROUP BY page_id
)
SELECT p.page_id, p.host, p.path, best.rule, coalesce(best.action, 'allow') AS verdict FROM p LEFT JOIN best USING (page_id)
""",
        "op3_substringdedup": r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT doc_id, unnest(range(1, len(w) - 11)) AS i, w FROM d WHERE len(w) >= 13
), win AS (
  SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS t FROM s
), low AS (
  SELECT doc_id, i, min(doc_id) OVER (PARTITION BY t) AS m FROM win
), hit AS (
  SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS i FROM low WHERE m < doc_id
), words AS (
  SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM d
), kept AS (
  SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS t, count(*) AS n FROM words ANTI JOIN hit USING (doc_id, i) GROUP BY doc_id
)
SELECT d.doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
""",
        "op8_suffixdedup": r"""
WITH d AS (
  SELECT doc_id, hex(coalesce(text, '')) AS h FROM documents
), win AS (
  SELECT doc_id, unnest(list_transform(range(length(h) // 2 - 49), lambda k: substr(h, 2 * k + 1, 100))) AS t, unnest(range(length(h) // 2 - 49)) AS i FROM d WHERE length(h) >= 100
), low AS (
  SELECT doc_id, i, min(doc_id) OVER (PARTITION BY t) AS m FROM win
), hit AS (
  SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS i FROM low WHERE m < doc_id
), runs AS (
  SELECT doc_id, count(*) AS n, count(*) FILTER (fresh) AS spans FROM (SELECT doc_id, coalesce(lag(i) OVER (PARTITION BY doc_id ORDER BY i) < i - 1, true) AS fresh FROM hit) GROUP BY doc_id
), bytes AS (
  SELECT doc_id, unnest(list_transform(range(length(h) // 2), lambda k: substr(h, 2 * k + 1, 2))) AS b, unnest(range(length(h) // 2)) AS i FROM d
), kept AS (
  SELECT doc_id, string_agg(b, '' ORDER BY i) AS h FROM bytes ANTI JOIN hit USING (doc_id, i) GROUP BY doc_id
)
SELECT d.doc_id, (length(d.h) // 2)::BIGINT AS n_bytes, coalesce(n, 0)::BIGINT AS n_removed, coalesce(spans, 0)::BIGINT AS n_spans, sha256(unhex(coalesce(kept.h, ''))) AS kept_sha256
FROM d LEFT JOIN runs USING (doc_id) LEFT JOIN kept USING (doc_id)
""",
        "op11_kmeans": _kmeans_sql(),
        "op12_warc": """
WITH p AS (
  SELECT page_id, url, strlen(coalesce(html, ''))::BIGINT AS n, sha256(coalesce(html, '')) AS d FROM pages
), o AS (
  SELECT *, row_number() OVER (PARTITION BY d ORDER BY page_id NULLS LAST, url NULLS LAST) AS k, first(page_id) OVER (PARTITION BY d ORDER BY page_id NULLS LAST, url NULLS LAST) AS first_id FROM p
)
SELECT page_id, n AS payload_bytes, d AS payload_digest, CASE WHEN n >= 100 AND k > 1 THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN n >= 100 AND k > 1 THEN first_id END AS refers_to FROM o
""",
        "op13_collocations": r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents
), w AS (
  SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces
), n AS (
  SELECT lang, sum(len(w))::BIGINT AS n FROM w GROUP BY lang
), g AS (
  SELECT lang, m, unnest(list_transform(range(1, len(w) - m + 2), lambda i: array_to_string(w[i:i + m - 1], ' '))) AS phrase FROM w, range(1, 4) t(m) WHERE len(w) >= m
), f AS (
  SELECT lang, m, phrase, count(*) AS f FROM g GROUP BY ALL HAVING count(*) >= 10
), cuts AS (
  SELECT lang, phrase, m, f AS a, string_split(phrase, ' ') AS w, unnest(range(1, m)) AS k FROM f WHERE m > 1
), scored AS (
  SELECT c.lang, c.phrase, c.m, c.a, c.k, x.f AS l, y.f AS r, (1000000::HUGEINT * a * a // (x.f::HUGEINT * y.f))::BIGINT AS score
  FROM cuts c JOIN f x ON x.lang = c.lang AND x.phrase = array_to_string(w[1:k], ' ') JOIN f y ON y.lang = c.lang AND y.phrase = array_to_string(w[k + 1:], ' ')
), best AS (
  SELECT DISTINCT ON (lang, phrase) * FROM scored ORDER BY lang, phrase, score, k
), kept AS (
  SELECT * FROM best b WHERE m = 3 OR NOT EXISTS (
    SELECT 1 FROM (SELECT lang, f, unnest([array_to_string(string_split(phrase, ' ')[1:2], ' '), array_to_string(string_split(phrase, ' ')[2:3], ' ')]) AS inner FROM f WHERE m = 3) t
    WHERE t.lang = b.lang AND t.inner = b.phrase AND 100 * t.f >= 50 * b.a)
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank FROM kept
)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN n USING (lang) WHERE rank <= 2000
""",
    }
