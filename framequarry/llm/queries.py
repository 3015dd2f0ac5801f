"""Queries of the thirteen operators over their whole tables, and SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framequarry.llm import bpe, divergence, exact, interaction, leaks, lm, mixing, near, quality, repeats, rules, toxicity, urls
from framequarry.llm.base import fold
from framequarry.session import table

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql.strip()
        return fn

    return add


def tokenizer_json(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    with open(public_tokenizers.path(name), encoding="utf-8") as f:
        return f.read()


@query("op1_quality")
def op1(spark, d) -> DataFrame:
    docs = table(spark, d, "documents")
    model = quality.train(docs.filter(fold("doc_id", 4) != 2), table(spark, d, "labels"))
    out = docs.select("doc_id", (fold("doc_id", 4) == 2).alias("held_out"), quality.quality_score(model).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= 0.7).cast("int"))


@query("op2_bpe")
def op2(spark, d) -> DataFrame:
    return bpe.round_trip(table(spark, d, "documents"), tokenizer_json())


@query("op3_rules", rules.quality_rules_sql())
def op3(spark, d) -> DataFrame:
    out = rules.quality_rules(table(spark, d, "documents"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


@query("op4_lm")
def op4(spark, d) -> DataFrame:
    return lm.score_documents(table(spark, d, "documents"), fold("doc_id", 7) != 2)


@query("op5_repeats")
def op5(spark, d) -> DataFrame:
    out = repeats.remove_repeats(table(spark, d, "documents"))
    return out.select(
        "doc_id", "n_bytes", repeats.removed_bytes("spans").alias("n_removed"), F.size("spans").cast("bigint").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"), (F.size("spans") == 0).alias("kept"))


WEIGHTS = [5, 2, 1]


@query("op6_mixing", r"""WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size, md5('mix:' || coalesce(doc_id::VARCHAR, 'null')) AS place FROM documents),
  s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
  w AS (SELECT *, [5, 2, 1][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS weight, 3 * source_size AS cap FROM s),
  o AS (SELECT *, row_number() OVER (ORDER BY cap / weight, source NULLS LAST) AS nth FROM w),
  l AS (SELECT *, sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY nth ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS words_left,
    sum(weight) OVER () - coalesce(sum(weight) OVER (ORDER BY nth ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS weight_left FROM o),
  c AS (SELECT *, weight * words_left > cap * weight_left AS capped FROM l),
  f AS (SELECT words_left, weight_left FROM c WHERE NOT capped ORDER BY nth LIMIT 1),
  t AS (SELECT c.source, c.source_size, CASE WHEN capped THEN cap::DOUBLE ELSE weight::DOUBLE * f.words_left::DOUBLE / f.weight_left::DOUBLE END AS target FROM c, f),
  r AS (SELECT d.*, t.source_size, t.target, coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY place, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
  q AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS whole FROM r)
  SELECT doc_id, size, source_size, target, (CASE WHEN source_size > 0 THEN whole + CASE WHEN (start * 2 + size)::DOUBLE < (target - whole * source_size) * 2 THEN 1 ELSE 0 END ELSE 0 END * size)::BIGINT AS taken FROM q""")
def op6(spark, d) -> DataFrame:
    out = mixing.mix(table(spark, d, "documents"), WEIGHTS)
    return out.select("doc_id", "size", "source_size", "target", (F.col("times") * F.col("size")).alias("taken"))


@query("op7_exact", """WITH t AS (SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256 FROM documents),
  g AS (SELECT text_sha256, max(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY 1)
  SELECT doc_id, keep_id, group_size, doc_id IS NOT DISTINCT FROM keep_id AS kept, text_sha256 FROM t JOIN g USING (text_sha256)""")
def op7(spark, d) -> DataFrame:
    return exact.exact_classes(table(spark, d, "documents"))


@query("op8_toxicity")
def op8(spark, d) -> DataFrame:
    docs = table(spark, d, "documents")
    model = toxicity.train(docs.filter(fold("doc_id", 4) != 2), table(spark, d, "labels"))
    return toxicity.grade_documents(docs, model)


URL_RULES = (
    urls.UrlRule("allow", "org", "/"),
    urls.UrlRule("block", "example.org", "/es/"),
    urls.UrlRule("block", "example.org", "/en/1"),
    urls.UrlRule("allow", "com", "/fr/"),
    urls.UrlRule("block", "com", "/de/"),
)


@query("op9_urls")
def op9(spark, d) -> DataFrame:
    return urls.judge_urls(table(spark, d, "pages"), URL_RULES)


@query("op10_near", r"""WITH RECURSIVE t AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
  s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 3], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(2, len(w) - 2))) AS i FROM t WHERE len(w) > 0)),
  n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
  p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS shared FROM s x JOIN s y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY ALL),
  l AS (SELECT a, b FROM p JOIN n m ON m.doc_id = a JOIN n k ON k.doc_id = b WHERE 100 * shared >= 80 * (m.n + k.n - shared)),
  e AS (SELECT a AS u, b AS v FROM l UNION ALL SELECT b, a FROM l),
  r AS (SELECT doc_id AS u, doc_id AS v FROM documents UNION SELECT r.u, e.v FROM r JOIN e ON e.u = r.v)
  SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, c.component_id, d.doc_id = c.component_id AS kept
  FROM documents d LEFT JOIN n USING (doc_id) JOIN (SELECT u, min(v) AS component_id FROM r GROUP BY u) c ON c.u = d.doc_id""")
def op10(spark, d) -> DataFrame:
    return near.near_classes(table(spark, d, "documents"), n=4)


@query("op11_divergence", divergence.audit_sql())
def op11(spark, d) -> DataFrame:
    return divergence.audit_sources(table(spark, d, "documents"))


@query("op12_leaks", leaks.leaks_sql())
def op12(spark, d) -> DataFrame:
    out = leaks.find_leaks(table(spark, d, "documents"), table(spark, d, "benchmark"))
    listed = F.sha2(F.array_join("items", ",").cast("binary"), 256)
    return out.select("doc_id", "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"), listed.alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


@query("op13_interaction", interaction.audit_sql())
def op13(spark, d) -> DataFrame:
    return interaction.audit_filters(table(spark, d, "documents"), table(spark, d, "labels"))
