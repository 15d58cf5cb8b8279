"""The registered operator queries, one per operator, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, codes, fmindex, langid, lpf, mixing, packing, quality, repair, rules, simhash, tiles, toxicity
from .common import WORD_GAP, fold, held_out, table
from .features import labelled

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def wrap(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn

    return wrap


WORDS_SQL = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

RULES_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text, {WORDS_SQL} AS ws FROM documents),
win AS (
  SELECT rid, i, array_to_string(ws[i:i+7], ' ') AS w
  FROM (SELECT rid, ws, unnest(range(1, len(ws) - 6)) AS i FROM d WHERE len(ws) >= 8)),
rep AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, w) AS n FROM win) WHERE n > 1),
cov AS (SELECT rid, sum(least(8, coalesce(nxt - i, 8))) AS n FROM (SELECT rid, i, lead(i) OVER (PARTITION BY rid ORDER BY i) AS nxt FROM rep) GROUP BY rid),
ln AS (SELECT rid, count(*) - count(DISTINCT l) AS n FROM (SELECT rid, unnest(string_split(text, chr(10))) AS l FROM d)
       WHERE regexp_matches(l, '[^\x20\x09-\x0D]') GROUP BY rid),
m AS (
  SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars,
         CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(coalesce(ln.n, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(cov.n, 0) AS BIGINT) AS n_repeat_words
  FROM d LEFT JOIN cov USING (rid) LEFT JOIN ln USING (rid))
SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
       NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AND 10 * n_symbols <= 3 * n_words AS kept
FROM m
"""


@query("op10_quality_rules", RULES_SQL)
def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measurements, base failure and the verdict of policy v1 for every document."""
    entries = rules.ledger(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return entries.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        (~rules.verdict(F.col("fail_bits"), "base")).alias("base_failed"),
        rules.verdict(F.col("fail_bits"), "v1").alias("kept"),
    )


@query("op6_suffix_array_dedup")
def op6_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of 50-byte strings that also start in an earlier document, removed."""
    cut = lpf.dedup_bytes(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return cut.select(
        "doc_id", F.col("n_symbols").alias("n_bytes"), "n_removed", F.size("runs").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


WINDOWS_SQL = rf"""
WITH d AS (SELECT doc_id, {WORDS_SQL} AS ws FROM documents),
b AS (SELECT doc_id, ws, unnest(range(1, len(ws) + 1)) AS i FROM d),
w AS (SELECT doc_id, i, array_to_string(ws[i:i+19], ' ') AS s FROM b WHERE i + 19 <= len(ws)),
hit AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY s ORDER BY doc_id, i) AS k FROM w) WHERE k > 1),
m AS (SELECT b.doc_id, b.i, b.ws[b.i] AS c,
        max(hit.i) OVER (PARTITION BY b.doc_id ORDER BY b.i ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) IS NOT NULL AS gone
      FROM b LEFT JOIN hit ON hit.doc_id = b.doc_id AND hit.i = b.i),
g AS (SELECT doc_id, count(*) FILTER (gone) AS n_removed, coalesce(string_agg(CASE WHEN NOT gone THEN c END, ' ' ORDER BY i), '') AS kept FROM m GROUP BY doc_id)
SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN g ON g.doc_id = d.doc_id
"""


@query("op9_substring_dedup", WINDOWS_SQL)
def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of 20-word windows that also start earlier, removed."""
    cut = fmindex.dedup_words(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return cut.select("doc_id", F.col("n_symbols").alias("n_words"), "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


@query("op7_simhash_near_dedup")
def op7_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    found = simhash.near_components(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def tokenizer_path() -> str:
    """The tokenizer file, installed with its package on every machine."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


@query("op2_harmonic_packing")
def op2_harmonic_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of 2048 tokens."""
    pieces = packing.pack(table(spark, sf_dir, "documents"), tokenizer_path())
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


@query("op3_source_mixing")
def op3_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents drawn for the target weights, once per epoch that reads them."""
    drawn = mixing.mix_sources(table(spark, sf_dir, "documents"))
    return drawn.select("doc_id", *mixing.leaf_columns(), "epoch", "n_tokens")


def _with_fold(scored: DataFrame, parts: int, part: int, *columns) -> DataFrame:
    return scored.select("doc_id", held_out(F.col("doc_id"), parts, part).alias("held_out"), *columns)


@query("op1_language_id")
def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every text, learned from three of four folds."""
    docs = table(spark, sf_dir, "documents")
    model = langid.fit(docs.filter(fold(F.col("doc_id"), 4) != 2))
    return _with_fold(langid.identify(docs, model), 4, 2, "lang_pred", "score", "languages")


@query("op5_toxicity")
def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every text, learned from four of five folds."""
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels")
    weights = toxicity.fit(docs, labels, fold(F.col("doc_id"), 5) != 0)
    scored = toxicity.score(docs, weights)
    return _with_fold(scored, 5, 0, "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))


@query("op8_quality_classifier")
def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every text, learned from three of four folds."""
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels")
    weights = quality.fit(labelled(docs, labels, "quality", fold(F.col("doc_id"), 4) != 2, quality.SAMPLE, 8))
    scored = quality.score(docs, weights)
    return _with_fold(scored, 4, 2, "score", F.when(F.col("score") >= 0.7, 1).otherwise(0).alias("predicted"))


@query("op4_dimension_scan")
def op4_dimension_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest vectors to each whose id is divisible by 50."""
    return ann.nearest(table(spark, sf_dir, "embeddings"), F.col("id") % 50 == 0)


LINKS_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
ok AS (SELECT * FROM v WHERE len(e) > 0 AND list_count(e) = len(e) AND len(list_filter(e, lambda x: NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
l AS MATERIALIZED (SELECT a.vec_id AS a, b.vec_id AS b FROM ok a, ok b WHERE a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.95),
r AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON l.a = r.b),
n AS (SELECT a, count(*) AS n FROM l GROUP BY a),
c AS (SELECT a, least(a, min(b)) AS root FROM r GROUP BY a)
SELECT v.vec_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_links, coalesce(c.root, v.vec_id) AS component_id, coalesce(c.root, v.vec_id) = v.vec_id AS kept
FROM v LEFT JOIN n ON n.a = v.vec_id LEFT JOIN c ON c.a = v.vec_id
"""


@query("op13_embedding_near_dedup", LINKS_SQL)
def op13_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and components of all vectors at a cosine of 0.95 or more."""
    return tiles.near_vectors(table(spark, sf_dir, "embeddings"))


_NEAR = """
{name} AS MATERIALIZED (
  SELECT rid, p, min(struct_pack(d := d, e := e)) AS best FROM (
    SELECT x.rid, x.p, c.e, list_sum(list_transform(list_zip(x.v, c.v), lambda q: (q[1] - q[2]) * (q[1] - q[2])))::BIGINT AS d FROM x JOIN {books} c ON c.p = x.p)
  GROUP BY rid, p)"""
_MOVED = """
{name} AS MATERIALIZED (
  SELECT p, e, list(CASE WHEN n IS NULL THEN old ELSE CAST(floor(CAST(total AS DOUBLE) / n) AS BIGINT) END ORDER BY k) AS v FROM (
    SELECT c.p, c.e, k, c.v[k] AS old, s.total, s.n FROM (SELECT *, unnest(range(1, len(v) + 1)) AS k FROM {books}) c
    LEFT JOIN (SELECT p, e, k, sum(c) AS total, count(*) AS n FROM (
        SELECT x.p, a.best.e AS e, unnest(range(1, len(x.v) + 1)) AS k, unnest(x.v) AS c FROM x JOIN {near} a ON a.rid = x.rid AND a.p = x.p) GROUP BY p, e, k) s USING (p, e, k))
  GROUP BY p, e)"""
CODES_SQL = f"""
WITH r AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY vec_id) AS rid, vec_id, label, list_transform(embedding, lambda c: CAST(floor(256 * CAST(c AS DOUBLE)) AS BIGINT)) AS v, len(embedding) // 16 AS w
  FROM embeddings WHERE list_count(embedding) = len(embedding) AND len(list_filter(embedding, lambda c: NOT isfinite(c))) = 0),
x AS MATERIALIZED (SELECT rid, p, v[p * w + 1 : p * w + w] AS v FROM (SELECT *, unnest(range(16)) AS p FROM r)),
c0 AS MATERIALIZED (SELECT p, rid - 1 AS e, v FROM x WHERE rid <= 64),
{_NEAR.format(name="a0", books="c0")}, {_MOVED.format(name="c1", books="c0", near="a0")},
{_NEAR.format(name="a1", books="c1")}, {_MOVED.format(name="c2", books="c1", near="a1")},
{_NEAR.format(name="a2", books="c2")},
o AS (SELECT rid, string_agg(lpad(lower(hex(best.e)), 2, '0'), '' ORDER BY p) AS code, CAST(sum(best.d) AS BIGINT) AS error FROM a2 GROUP BY rid),
g AS (SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY p, e)) AS sha FROM c2)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, sha AS codebooks_sha256 FROM r JOIN o USING (rid), g
"""


@query("op11_vector_codes", CODES_SQL)
def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes of sixteen parts for every usable vector, with exact errors."""
    coded, books = codes.compress(table(spark, sf_dir, "embeddings"))
    digest = F.lit(books.sha256() if books else None).cast("string")
    return coded.select(F.col("id").alias("vec_id"), F.lower(F.hex("code")).alias("code"), "error", "label_error", digest.alias("codebooks_sha256"))


def planted(text: Column, key: Column) -> Column:
    """The text of the contract: where crc32 of the id ends in 0, the words from a on repeat the first p of them."""
    words = F.filter(F.split(text, WORD_GAP), lambda w: w != "")
    g = F.floor(F.crc32(key.cast("string").cast("binary")) / 10)

    def repeated(ws: Column) -> Column:
        n = F.size(ws)
        a = F.pmod(g, n)
        p = F.floor((n - a) / (3 + F.pmod(g, F.lit(8)))) + 1
        at = lambda i: F.when(i < a, i).otherwise(a + F.pmod(i - a, p))
        word = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.get(ws, at(i).cast("int")))
        return F.when(n > 0, F.array_join(word, " ")).otherwise("")

    # One element, so that the words are split once.
    return F.when(F.crc32(key.cast("string").cast("binary")) % 10 == 0, F.transform(F.array(words), repeated)[0]).otherwise(text)


@query("op12_periodic_runs")
def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Periodic runs of words of every document, and its words without their repeats."""
    docs = table(spark, sf_dir, "documents").select("doc_id", planted(F.col("text"), F.col("doc_id")).alias("text"))
    found = repair.periodic_runs(docs)
    line = lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])
    lines = F.concat_ws("", F.transform("runs", lambda r: F.concat(line(r), F.lit("\n"))))
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
        F.expr("1000 * best.length div best.period").alias("exponent_milli"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
