"""The queries of this subpackage, with production parameters on whole tables, and their SQL."""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, cotraining, html_wrappers, mixing, near_join, packing, privacy, pseudo_likelihood, quality_rules, runtime, token_store


@lru_cache
def vocabulary(name: str) -> str:
    """The file of a public tokenizer; the package is installed on every machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_dac_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = runtime.shared_folder(spark)
    token_store.write(table(spark, sf_dir, "documents"), path, vocabulary("byte_bpe_50k.json"), end_id=2)
    return token_store.read_documents(spark, path).select("doc_id", "start", "n_tokens", "ids_crc32")


def op2_disclosure_privacy(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = privacy.find(table(spark, sf_dir, "documents"))
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    return found.select(
        "doc_id", *[count(k).alias(f"n_{name}") for k, name in enumerate(privacy.KINDS[:4])],
        F.sha2(privacy.spelled(F.col("base")), 256).alias("base_sha256"), privacy.spelled(F.col("spans")).alias("spans"),
    )


def op3_parity_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_join.near_components(table(spark, sf_dir, "documents"), words=4, num=85, den=100)


def op4_fair_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


OP4_SQL = r"""
WITH sizes AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents),
sources AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS place FROM sizes GROUP BY source),
weighted AS (
  SELECT *, [5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE][(place % 3 + 1)::INT] AS weight, 2.0::DOUBLE * source_size AS cap FROM sources),
levels AS (
  SELECT *, (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(cap) OVER full_first, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER full_first, 0)) AS level
  FROM weighted WINDOW full_first AS (ORDER BY cap / weight, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
targets AS (
  SELECT *, CASE WHEN level * weight >= cap THEN cap ELSE weight * max(CASE WHEN level * weight < cap THEN level END) OVER () END AS target FROM levels),
queued AS (
  SELECT s.doc_id, s.size, t.source_size, t.target, t.place, md5('mix:' || s.doc_id) AS key,
         sum(s.size) OVER (PARTITION BY t.place ORDER BY md5('mix:' || s.doc_id), s.doc_id, s.size ROWS UNBOUNDED PRECEDING) AS sofar
  FROM sizes s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source),
copies AS (
  SELECT q.*, r.round, (r.round * source_size + sofar) / target AS finish FROM queued q, (VALUES (0), (1)) r(round)
  WHERE target > 0 AND r.round * source_size < target),
kept AS (
  SELECT doc_id, size, sum(size) OVER (ORDER BY finish, place, round, key, doc_id ROWS UNBOUNDED PRECEDING) <= 1.5::DOUBLE * (SELECT sum(size) FROM sizes) AS keep FROM copies)
SELECT q.doc_id, q.size, q.source_size, q.target, (q.size * coalesce(k.n, 0))::BIGINT AS taken
FROM queued q LEFT JOIN (SELECT doc_id, count(*) FILTER (keep) AS n FROM kept GROUP BY doc_id) k ON q.doc_id = k.doc_id
"""


OP3_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 4 THEN list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) WHEN len(w) > 0 THEN [len(w) || ' ' || array_to_string(w, ' ')] ELSE [] END) AS shingle FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id),
e AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * k >= 85 * (a.n + b.n - k)),
r(d, c) USING KEY (d) AS (
  SELECT doc_id, doc_id FROM documents
  UNION SELECT e.y, min(r.c) FROM r JOIN e ON r.d = e.x JOIN recurring.r k ON k.d = e.y WHERE r.c < k.c GROUP BY e.y)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, r.c AS component_id FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id JOIN r ON r.d = d.doc_id
"""


def _divergence(counts: list[str], shares: dict[str, list[float]], default: list[float]) -> str:
    """Jensen-Shannon distance in SQL between lists of counts and of shares chosen by language."""
    reference = "CASE lang " + " ".join(f"WHEN '{k}' THEN {v}::DOUBLE[]" for k, v in shares.items()) + f" ELSE {default}::DOUBLE[] END"
    total = " + ".join(counts)
    p = f"list_transform([{', '.join(counts)}], lambda c: c::DOUBLE / greatest({total}, 1))"
    half = "CASE WHEN {a} > 0 THEN {a} * log2({a} / ((z[1] + z[2]) / 2)) ELSE 0.0 END"
    return f"sqrt(greatest(list_sum(list_transform(list_zip({p}, {reference}), lambda z: {half.format(a='z[1]')} + {half.format(a='z[2]')})) / 2, 0.0))"


def _op8_sql() -> str:
    q = quality_rules
    rest = lambda shares: [*shares, 1.0 - sum(shares)]
    classes = {k: "len(regexp_extract_all(t, '" + v.replace("'", "''") + "'))" for k, v in q.CLASSES.items()}
    pooled = rest([sum(s[k] for s in q.CLASS_SHARES.values()) / len(q.CLASS_SHARES) for k in range(len(q.CLASSES))])
    chars = _divergence([*classes, f"(length(t) - {' - '.join(classes)})"], {k: rest(v) for k, v in q.CLASS_SHARES.items()}, pooled)
    nth = lambda k: "CASE lang " + " ".join(f"WHEN '{lang}' THEN '{list(w)[k]}'" for lang, w in q.COMMON.items()) + " END"
    common = [f"len(list_filter(w, lambda x: x = {nth(k)})) AS c{k}" for k in range(q.SIZE)]
    names = [f"c{k}" for k in range(q.SIZE)]
    words = _divergence([*names, f"(n_words - {' - '.join(names)})"], {k: rest(list(v.values())) for k, v in q.COMMON.items()}, [0.0] * (q.SIZE + 1))
    languages = ", ".join(f"'{k}'" for k in q.COMMON)
    return rf"""
WITH d AS (SELECT doc_id, lang, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
x AS (SELECT doc_id, generate_subscripts(w, 1) AS i, unnest(w) AS a FROM d),
y AS (SELECT doc_id, i, a, lead(a) OVER o AS b, lead(a, 2) OVER o AS c FROM x WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
z AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, a, b, c) AS n FROM y WHERE c IS NOT NULL),
r AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM z, (VALUES (0), (1), (2)) v(k) WHERE n > 1 GROUP BY doc_id),
l AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM d) WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id),
f AS (SELECT d.doc_id, d.lang, t, len(w) AS n_words, list_sum(list_transform(w, lambda x: length(x))) AS word_chars, len(regexp_extract_all(t, '[#*$%&|<>]')) AS n_symbols,
  coalesce(l.n, 0) AS n_dup_lines, coalesce(r.n, 0) AS n_repeat_words, {', '.join(f'{v} AS {k}' for k, v in classes.items())}, {', '.join(common)}
  FROM d LEFT JOIN l USING (doc_id) LEFT JOIN r USING (doc_id)),
g AS (SELECT *, n_words < {q.LEAST_WORDS} OR 100 * n_repeat_words > {q.MOST_REPEATED} * n_words AS base_failed, {chars} AS js_chars, {words} AS js_words FROM f)
SELECT doc_id, n_words::BIGINT AS n_words, coalesce(word_chars, 0)::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words, base_failed,
  NOT base_failed AND NOT (length(t) >= {q.LEAST_CHARS} AND js_chars > {q.CHAR_LIMIT}) AND NOT coalesce(lang IN ({languages}) AND n_words >= {q.LEAST_COMMON} AND js_words > {q.WORD_LIMIT}, false) AS kept FROM g
"""


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"), end_id=1, window=2048)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op8_divergence_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules.judge(table(spark, sf_dir, "documents"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op10_posting_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"), k=5, every=50)


def op5_page_wrappers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_wrappers.main_text(table(spark, sf_dir, "pages"))


def op7_cotraining(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return cotraining.score(docs, cotraining.train(docs, table(spark, sf_dir, "labels")))


def op9_pseudo_likelihood(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudo_likelihood.score(table(spark, sf_dir, "documents"))


def queries() -> dict:
    return {"op7_cotraining": op7_cotraining, "op9_pseudo_likelihood": op9_pseudo_likelihood, "op5_page_wrappers": op5_page_wrappers, "op10_posting_lists": op10_posting_lists, "op3_parity_join": op3_parity_join, "op2_disclosure_privacy": op2_disclosure_privacy, "op8_divergence_rules": op8_divergence_rules, "op1_dac_tokens": op1_dac_tokens, "op4_fair_mix": op4_fair_mix, "op6_best_fit_packing": op6_best_fit_packing}


def oracle_sql() -> dict[str, str]:
    return {"op3_parity_join": OP3_SQL, "op4_fair_mix": OP4_SQL, "op8_divergence_rules": _op8_sql()}
