"""Thin registered queries of the operators in this folder, with their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from passagelake.llm import bpe, embeddings, htmltext, langid, linededup, mixing, quality, simhash, toxicity, warc
from passagelake.llm.common import read, written


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and verdict of every document."""
    out = quality.filtered(read(spark, sf_dir, "documents"))
    return out.select("doc_id", *quality.COUNTS, "base_failed", "kept", F.array_join("outside", ",").alias("outside"))


def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that a mix with source weights 5, 2, 1, ... takes of every document."""
    sized = written(mixing.sizes(read(spark, sf_dir, "documents"), ["doc_id", "source"]), "sized")
    drawn = mixing.draw(sized, mixing.plan(sized))
    return drawn.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("n_copies")).alias("taken"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every whole text of documents."""
    docs = read(spark, sf_dir, "documents")
    model = toxicity.fitted(docs, read(spark, sf_dir, "labels"))
    scored = toxicity.score(docs, model, ["doc_id"])
    return scored.select("doc_id", toxicity.held_out_flag().alias("held_out"), "score", (F.col("score") >= toxicity.TOXIC).cast("int").alias("predicted"))


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every whole text of documents."""
    docs = read(spark, sf_dir, "documents")
    found = langid.predict(docs, langid.fitted(docs), ["doc_id"])
    return found.select("doc_id", toxicity.held_out_flag(4, 2).alias("held_out"), "lang_pred", "score")


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and near-duplicate group of every document."""
    return simhash.near_duplicates(read(spark, sf_dir, "documents"))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without later copies of repeated line runs."""
    out = linededup.deduplicated(read(spark, sf_dir, "documents").select("doc_id", "text"))
    spans = F.array_join(F.transform("deleted_spans", lambda x: F.concat_ws("-", x["start"], x["end"])), ",")
    return out.select("doc_id", "n_lines", "n_deleted", "deleted_words", spans.alias("deleted_spans"), "text")


def op7_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate group of every vector of embeddings."""
    return embeddings.near_duplicates(read(spark, sf_dir, "embeddings"))


def op8_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return htmltext.extract(read(spark, sf_dir, "pages"), ["page_id", "url"])


def op9_warc_normaliser(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the normalised archives of all pages hold."""
    return warc.archive(read(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts and digests of every whole text of documents."""
    import public_tokenizers as P

    return bpe.encode(read(spark, sf_dir, "documents"), P.path("byte_bpe_50k.tiktoken"), P.PATTERN, keep=["doc_id"], with_ids=False)


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five stages of corpus_pipeline.py, which stands beside the package."""
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_quality_rules": op1_quality_rules,
        "op2_mix_sources": op2_mix_sources,
        "op3_toxicity": op3_toxicity,
        "op4_language": op4_language,
        "op5_simhash": op5_simhash,
        "op6_line_dedup": op6_line_dedup,
        "op7_embedding_dedup": op7_embedding_dedup,
        "op8_html_text": op8_html_text,
        "op9_warc_normaliser": op9_warc_normaliser,
        "op10_byte_bpe": op10_byte_bpe,
        "pipeline": pipeline,
    }


def op1_sql() -> str:
    """The counts, and the same sketches, fences and verdicts, in SQL."""
    import math

    growth = (1 + quality.ACCURACY) / (1 - quality.ACCURACY)
    word = r"[^\x20\x09-\x0D]"
    ratios = {
        "word_length": "word_chars / greatest(n_words, 1)",
        "symbol_ratio": "n_symbols / greatest(n_words, 1)",
        "dup_line_ratio": "n_dup_lines / greatest(n_lines, 1)",
        "repeat_ratio": "n_repeat_words / greatest(n_words, 1)",
        "upper_ratio": "n_upper / greatest(n_letters, 1)",
        "mark_ratio": "n_marks / greatest(n_words, 1)",
        "same_ratio": "n_same / greatest(n_words, 1)",
    }
    left = lambda kind: f"CAST(length(regexp_replace(joined, '[^{kind}]', '', 'g')) AS BIGINT)"
    stacked = " UNION ALL ".join(f"SELECT lang, source, '{m}' AS metric, CAST({m} AS DOUBLE) AS x FROM r WHERE NOT base_failed" for m in (*quality.METRICS, *quality.SIZES))
    lend = quality.MIN_GROUP * quality.PARTS
    at = lambda i: f"min(CASE WHEN 4 * upto >= {i} * total THEN coalesce(2 * pow({growth!r}, bucket) / ({growth!r} + 1), 0.0) END) AS q{i}"
    of = lambda name, q: f"max(CASE WHEN metric = '{name}' THEN {q} END)"
    reach = {m: f"{quality.FENCE} * greatest({of(m, 'q3')} - {of(m, 'q1')}, {step} / greatest({of(size, 'q2')}, 1.0))" for m, (step, size, _) in quality.METRICS.items()}
    limits = ", ".join(f"{f'{of(m, "q1")} - {reach[m]}' if below else '-1.0'} AS {m}_low, {of(m, 'q3')} + {reach[m]} AS {m}_high" for m, (_, _, below) in quality.METRICS.items())
    outside = ", ".join(f"CASE WHEN {m} < {m}_low OR {m} > {m}_high THEN '{m}' END" for m in quality.METRICS)
    return f"""WITH w AS (
  SELECT row_number() OVER () AS id, doc_id, lang, source, regexp_extract_all(coalesce(text, ''), '{word}+') AS words,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '{word}')) AS lines FROM documents
), j AS (SELECT *, array_to_string(words, '') AS joined FROM w),
win AS (SELECT id, i, list_slice(words, i, i + 7) AS k FROM (SELECT id, words, unnest(range(1, len(words) - 6)) AS i FROM w)),
twice AS (SELECT id, i FROM (SELECT id, i, count(*) OVER (PARTITION BY id, k) AS n FROM win) WHERE n > 1),
rep AS (SELECT id, count(DISTINCT p) AS n FROM (SELECT id, unnest(range(i, i + 8)) AS p FROM twice) GROUP BY id),
c AS (SELECT j.*, CAST(len(words) AS BIGINT) AS n_words, CAST(length(joined) AS BIGINT) AS word_chars, {left('#*$%&|<>')} AS n_symbols, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
  CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words, len(lines) AS n_lines, {left('A-Z')} AS n_upper, {left('A-Za-z')} AS n_letters, {left('!?')} AS n_marks,
  len(list_filter(range(2, len(words) + 1), lambda i: words[i] = words[i - 1])) AS n_same FROM j LEFT JOIN rep USING (id)),
r AS (SELECT *, n_words < {quality.MIN_WORDS} OR 100 * n_repeat_words > {quality.MAX_REPEAT} * n_words AS base_failed, {', '.join(f'{x} AS {m}' for m, x in ratios.items())} FROM c),
m AS ({stacked}), b AS (SELECT lang, source, metric, CASE WHEN x > 0 THEN CAST(ceil(ln(x) / {math.log(growth)!r}) AS INTEGER) END AS bucket, count(*) AS n FROM m GROUP BY ALL),
b0 AS (SELECT metric, bucket, sum(n) * {quality.PARTS} AS n FROM b GROUP BY ALL),
p0 AS (SELECT metric, bucket, n * {lend} // sum(n) OVER (PARTITION BY metric) AS n FROM b0),
b1 AS (SELECT lang, metric, bucket, sum(n) AS n FROM (SELECT lang, metric, bucket, n * {quality.PARTS} AS n FROM b UNION ALL SELECT lang, metric, bucket, n FROM (SELECT DISTINCT lang, metric FROM b) JOIN p0 USING (metric)) GROUP BY ALL),
p1 AS (SELECT lang, metric, bucket, n * {lend} // sum(n) OVER (PARTITION BY lang, metric) AS n FROM b1),
b2 AS (SELECT lang, source, metric, bucket, sum(n) AS n FROM (SELECT lang, source, metric, bucket, n * {quality.PARTS} AS n FROM b UNION ALL
  SELECT g.lang, source, g.metric, bucket, n FROM (SELECT DISTINCT lang, source, metric FROM b) g JOIN p1 ON g.lang IS NOT DISTINCT FROM p1.lang AND g.metric = p1.metric) GROUP BY ALL),
u AS (SELECT *, sum(n) OVER (PARTITION BY lang, source, metric ORDER BY bucket NULLS FIRST ROWS UNBOUNDED PRECEDING) AS upto, sum(n) OVER (PARTITION BY lang, source, metric) AS total FROM b2),
f AS (SELECT lang, source, metric, {at(1)}, {at(2)}, {at(3)} FROM u GROUP BY lang, source, metric),
l AS (SELECT lang, source, {limits} FROM f GROUP BY lang, source),
o AS (SELECT r.*, array_to_string(list_filter([{outside}], lambda x: x IS NOT NULL), ',') AS outside FROM r LEFT JOIN l ON r.lang IS NOT DISTINCT FROM l.lang AND r.source IS NOT DISTINCT FROM l.source)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND outside = '' AS kept, outside FROM o"""


def op2_sql() -> str:
    """The same targets, expected copies, ranks, certain copies and closing documents, in SQL."""
    most, damp = mixing.MAX_COPIES, mixing.DAMPING
    weights = " ".join(f"WHEN {i} THEN {w}" for i, w in enumerate(mixing.WEIGHTS))
    return rf"""WITH s AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents
), sources AS (
  SELECT source, sum(size) AS source_size, {most} * sum(size) AS bound, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(mixing.WEIGHTS)} {weights} END AS weight FROM s GROUP BY source
), o AS (
  SELECT *, row_number() OVER (ORDER BY bound / weight, source) AS r, sum(source_size) OVER () AS total FROM sources
), levels AS (
  SELECT *, (total - coalesce(sum(bound) OVER (ORDER BY r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(weight) OVER (ORDER BY r DESC ROWS UNBOUNDED PRECEDING) AS level FROM o
), goal AS (
  SELECT source, source_size, least(weight * (SELECT min_by(level, r) FROM levels WHERE level * weight <= bound), bound) AS target FROM sources
), c AS (
  SELECT source, CAST(floor(log2(size)) AS INTEGER) AS kind, sum(size) AS class_size FROM s WHERE size > 0 GROUP BY ALL
), x AS (
  SELECT c.source, kind, pow(2.0, -{damp} * kind) AS rel, greatest(0.0, target - {most} * coalesce(sum(class_size) OVER (PARTITION BY c.source ORDER BY kind ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
         / sum(class_size * pow(2.0, -{damp} * kind)) OVER (PARTITION BY c.source ORDER BY kind DESC ROWS UNBOUNDED PRECEDING) AS scale
  FROM c JOIN goal ON c.source IS NOT DISTINCT FROM goal.source
), scales AS (
  SELECT source, min_by(scale, kind) FILTER (WHERE scale * rel <= {most} * (1 + 1e-12)) AS scale FROM x GROUP BY source
), d AS (
  SELECT s.*, source_size, target, least({most}, coalesce(scale, 1e300) * pow(2.0, -{damp} * CASE WHEN size > 0 THEN floor(log2(size)) ELSE -1 END)) AS expected,
         (CAST(CAST(concat('0x', left(md5(concat('{mixing.SEED}/', coalesce(CAST(doc_id AS VARCHAR), ''))), 13)) AS BIGINT) AS DOUBLE) + 0.5) / {float(1 << 52)} AS u
  FROM s JOIN goal ON s.source IS NOT DISTINCT FROM goal.source LEFT JOIN scales ON s.source IS NOT DISTINCT FROM scales.source
), e AS (
  SELECT *, CASE WHEN abs(expected - round(expected)) < 1e-12 THEN round(expected) ELSE expected END AS copies FROM d
), f AS (
  SELECT *, floor(copies) AS whole, CASE WHEN copies - floor(copies) > 0 THEN ln(u / (1 - u)) - ln((copies - floor(copies)) / (1 - (copies - floor(copies)))) END AS odds FROM e
), r AS (
  SELECT *, target - sum(CASE WHEN size > 0 THEN whole * size ELSE 0 END) OVER (PARTITION BY source) AS room,
         CASE WHEN odds IS NOT NULL AND size > 0 THEN sum(CASE WHEN odds IS NOT NULL AND size > 0 THEN size ELSE 0 END) OVER (PARTITION BY source ORDER BY odds NULLS LAST, doc_id ROWS UNBOUNDED PRECEDING) END AS upto FROM f
), g AS (
  SELECT *, coalesce(upto <= room, false) AS fits, room - sum(CASE WHEN upto <= room THEN size ELSE 0 END) OVER (PARTITION BY source) AS gap FROM r
), h AS (
  SELECT *, NOT fits AND upto IS NOT NULL AND abs(size - gap) < gap AS near FROM g
), z AS (
  SELECT *, near AND row_number() OVER (PARTITION BY source ORDER BY near DESC, abs(size - gap), odds, doc_id) = 1 AS closing FROM h
)
SELECT doc_id, size, CAST(source_size AS BIGINT) AS source_size, target, CASE WHEN size > 0 THEN CAST(size * (whole + CAST(fits AS INTEGER) + CAST(closing AS INTEGER)) AS BIGINT) ELSE 0 END AS taken FROM z"""


#: The least runs of 50 words from and up to each line, their first occurrences, and the texts without the later ones.
OP6_SQL = r"""
WITH e AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS num FROM documents
), w AS (
  SELECT *, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS words FROM e
), k AS (
  SELECT doc_id, num, words, trim(line, concat(' ', chr(9), chr(10), chr(11), chr(12), chr(13))) AS line,
         row_number() OVER d - 1 AS pos, sum(words) OVER d AS upto
  FROM w WHERE words > 0 WINDOW d AS (PARTITION BY doc_id ORDER BY num)
), g AS (
  SELECT doc_id, list(line ORDER BY pos) AS lines, list(upto ORDER BY pos) AS sums FROM k GROUP BY doc_id
), runs AS (
  SELECT k.doc_id, pos AS a, len(list_filter(sums, lambda x: x < upto - words + 50)) + 1 AS b, len(sums) AS n FROM k JOIN g USING (doc_id)
  UNION
  SELECT k.doc_id, len(list_filter(sums, lambda x: x <= upto - 50)) - (CASE WHEN upto >= 50 THEN 0 ELSE 1 END) AS a, pos + 1 AS b, len(sums) AS n FROM k JOIN g USING (doc_id)
), named AS (
  SELECT doc_id, a, b, md5(array_to_string(list_slice(lines, a + 1, b), chr(10))) AS run FROM runs JOIN g USING (doc_id) WHERE a >= 0 AND b <= n
), later AS (
  SELECT doc_id, a, b FROM named QUALIFY row_number() OVER (PARTITION BY run ORDER BY doc_id, a) > 1
), gone AS (
  SELECT DISTINCT doc_id, unnest(range(a, b)) AS pos FROM later
), f AS (
  SELECT w.*, CASE WHEN w.words > 0 THEN gone.pos IS NOT NULL END AS cut
  FROM w LEFT JOIN k ON w.doc_id = k.doc_id AND w.num = k.num LEFT JOIN gone ON k.doc_id = gone.doc_id AND k.pos = gone.pos
), h AS (
  SELECT *, coalesce(last_value(cut IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY num ROWS UNBOUNDED PRECEDING), false) AS out FROM f
), spans AS (
  SELECT doc_id, string_agg(concat(low, '-', high + 1), ',' ORDER BY low) AS spans FROM (
    SELECT doc_id, min(num) AS low, max(num) AS high FROM (SELECT doc_id, num, num - row_number() OVER (PARTITION BY doc_id ORDER BY num) AS island FROM h WHERE out) GROUP BY doc_id, island
  ) GROUP BY doc_id
), t AS (
  SELECT doc_id, count(*) FILTER (WHERE words > 0) AS n_lines, count(*) FILTER (WHERE cut) AS n_deleted, CAST(coalesce(sum(words) FILTER (WHERE cut), 0) AS BIGINT) AS deleted_words,
         coalesce(string_agg(line, chr(10) ORDER BY num) FILTER (WHERE NOT out), '') AS text FROM h GROUP BY doc_id
)
SELECT doc_id, n_lines, n_deleted, deleted_words, coalesce(spans, '') AS deleted_spans, text FROM t LEFT JOIN spans USING (doc_id)
"""

#: All pairs of a label. The operator finds each pair at the threshold with probability 0.99, closer ones more often.
OP7_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS x FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND list_bool_and(list_transform(embedding, lambda c: c IS NOT NULL AND isfinite(c))) AND list_bool_or(list_transform(embedding, lambda c: c <> 0))
), links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.x) = len(b.x) WHERE list_cosine_similarity(a.x, b.x) >= 0.93
), reach AS (
  SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a
), c AS (SELECT a AS vec_id, min(b) AS component_id FROM reach GROUP BY a), n AS (SELECT a AS vec_id, count(*) AS n FROM links GROUP BY a)
SELECT vec_id, coalesce(n, 0) AS n_links, component_id, vec_id = component_id AS kept FROM c LEFT JOIN n USING (vec_id)
"""

OP9_SQL = """
WITH seen AS (
  SELECT page_id, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest
  FROM pages
), firsts AS (
  SELECT payload_digest, min(page_id) AS first_id FROM seen WHERE payload_bytes >= 100 GROUP BY payload_digest
)
SELECT page_id, payload_bytes, s.payload_digest,
       CASE WHEN first_id IS NOT NULL AND page_id IS DISTINCT FROM first_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN first_id IS NOT NULL AND page_id IS DISTINCT FROM first_id THEN first_id END AS refers_to
FROM seen s LEFT JOIN firsts f ON s.payload_digest = f.payload_digest
"""


def oracle_sql() -> dict[str, str]:
    return {
        "op1_quality_rules": op1_sql(),
        "op2_mix_sources": op2_sql(),
        "op6_line_dedup": OP6_SQL,
        "op7_embedding_dedup": OP7_SQL,
        "op9_warc_normaliser": OP9_SQL,
    }
