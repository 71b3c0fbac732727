"""The registered queries of this subpackage, with production parameters, and their DuckDB counterparts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallgrass.llm import balanced_mix, ball_kmeans, blob_ledger, decontaminate, hard_negatives, kneser_ney, language_id, license_scan, ngram_join, quality_model, robust_outliers, shard_table, window_dedup
from tallgrass.llm.shared import crc_mod


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_balanced_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return balanced_mix.mix(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "source", "copies")


def op2_robust_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return robust_outliers.judge(_table(spark, sf_dir, "documents"))


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = decontaminate.scan(_table(spark, sf_dir, "documents").select("doc_id", "text"), _table(spark, sf_dir, "benchmark"))
    return marked.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


OP3_SQL = r"""
WITH low AS (SELECT doc_id, row_number() OVER () AS r, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
dw AS (SELECT doc_id, r, regexp_extract_all(t, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM low),
iw AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
sizes AS (SELECT DISTINCT least(len(w), 10) AS k FROM iw WHERE len(w) > 0),
items AS (SELECT DISTINCT item_id, least(len(w), 10) AS k, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS g
  FROM iw, unnest(generate_series(1, len(w) - least(len(w), 10) + 1)) AS u(i) WHERE len(w) > 0),
docs AS (SELECT r, k, i, array_to_string(w[i:i + k - 1], ' ') AS g FROM dw, sizes, unnest(generate_series(1, len(w) - k + 1)) AS u(i)),
found AS (SELECT docs.r, docs.k, docs.i, items.item_id FROM docs JOIN items USING (k, g)),
hit AS (SELECT r, count(DISTINCT p) AS n_hit FROM found, unnest(generate_series(i, i + k - 1)) AS u(p) GROUP BY r),
named AS (SELECT r, count(*) AS n_items, string_agg(item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS names FROM (SELECT DISTINCT r, item_id FROM found) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN hit USING (r) LEFT JOIN named USING (r)
"""


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang", (crc_mod(3) == 1).alias("held_out"))
    dictionaries = language_id.fit(docs.filter(~F.col("held_out")))
    found = language_id.predict(docs.drop("lang"), dictionaries)
    return found.select("doc_id", "held_out", F.col("best").alias("lang_pred"), "score", "margin", F.col("lang").isNull().alias("rejected"))


def op5_window_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return window_dedup.dedup(docs, with_text=False)


OP5_SQL = r"""
WITH dw AS (SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
windows AS (SELECT r, doc_id, i, array_to_string(w[i:i + 12], ' ') AS g FROM dw, unnest(generate_series(1, len(w) - 12)) AS u(i)),
least AS (SELECT g, min(doc_id) AS d FROM windows GROUP BY g HAVING min(doc_id) < max(doc_id)),
gone AS (SELECT DISTINCT r, p FROM windows JOIN least USING (g), unnest(generate_series(i, i + 12)) AS u(p) WHERE d < doc_id),
places AS (SELECT r, unnest(generate_series(1, len(w))) AS p, unnest(w) AS word FROM dw),
kept AS (SELECT places.r, string_agg(word, ' ' ORDER BY p) AS t, count(*) AS n FROM places ANTI JOIN gone USING (r, p) GROUP BY places.r)
SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM dw LEFT JOIN kept USING (r)
"""


def op6_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join(_table(spark, sf_dir, "documents").select("doc_id", "text"))


OP6_SQL = r"""
WITH RECURSIVE dw AS (SELECT doc_id, row_number() OVER () AS r,
  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
sh AS (SELECT DISTINCT r, array_to_string(w[i:i + 4], ' ') AS g FROM dw, unnest(generate_series(1, greatest(len(w) - 4, 1))) AS u(i) WHERE len(w) > 0),
sizes AS (SELECT r, count(*) AS n FROM sh GROUP BY r),
met AS (SELECT a.r AS a, b.r AS b, count(*) AS k FROM sh a JOIN sh b ON a.g = b.g AND a.r <> b.r GROUP BY a.r, b.r),
links AS (SELECT a, b FROM met JOIN sizes x ON x.r = a JOIN sizes y ON y.r = b WHERE 100 * k >= 80 * (x.n + y.n - k)),
reach AS (SELECT r AS a, r AS b FROM dw UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a),
least AS (SELECT reach.a AS r, min(doc_id) AS component_id FROM reach JOIN dw ON dw.r = reach.b GROUP BY reach.a)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id FROM dw JOIN least USING (r) LEFT JOIN sizes USING (r)
"""


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its best license match, null if it has none, and the number of matches."""
    found = license_scan.scan(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    best = F.get("matches", 0)
    return found.select("doc_id", best["name"].alias("license"), best["matched"].alias("matched"), best["coverage"].alias("coverage"), best["first_word"].alias("first_word"), best["last_word"].alias("last_word"), best["span"].alias("span"), F.size("matches").cast("long").alias("n_matches"))


def op8_shard_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_table.place(_table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars"))


OP8_SQL = f"""
WITH slots AS (SELECT {{table}} AS shards)
SELECT doc_id, source, n_chars, slot, shards[slot + 1]::INTEGER AS shard
FROM (SELECT doc_id, source, n_chars, (('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT % {shard_table.SLOTS})::INTEGER AS slot FROM documents), slots
"""


def op9_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", (crc_mod(5) == 0).alias("held_out"))
    scored = quality_model.classify(docs, _table(spark, sf_dir, "labels"), learn=~F.col("held_out"))
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op10_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", (crc_mod(5) == 1).alias("held_out"))
    model = kneser_ney.train(docs.filter(~F.col("held_out")))
    scored = kneser_ney.score(docs, model).withColumn("train_tokens", F.lit(model.tokens).cast("long"))
    return scored.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity")


def op11_blob_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document is the one version of a path of its own."""
    scanned = blob_ledger.scan(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = [r.kind for r in blob_ledger.RULES[:3]]
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    digest = F.sha2(blob_ledger.written(F.filter("spans", lambda s: s["kind"].isin(base))).cast("binary"), 256)
    return scanned.select("doc_id", *map(count, base), digest.alias("base_sha256"), blob_ledger.written(F.col("spans")).alias("spans"))


def _op11_sql() -> str:
    quoted = [(n, r, r.pattern.replace("'", "''")) for n, r in enumerate(blob_ledger.RULES)]
    matches = " UNION ALL ".join(
        f"""SELECT r, {n} AS k, '{rule.kind}' AS kind, i, length(s[i]) AS gap, length(m[i]) AS size, length(v[i]) >= {rule.least} AS kept
  FROM (SELECT r, regexp_extract_all(t, '{p}', 0) AS m, regexp_extract_all(t, '{p}', {rule.value}) AS v, regexp_split_to_array(t, '{p}') AS s FROM d), unnest(generate_series(1, len(m))) AS u(i)"""
        for n, rule, p in quoted
    )
    return f"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, coalesce(text, '') AS t FROM documents),
matches AS ({matches}),
placed AS (SELECT *, sum(gap + size) OVER (PARTITION BY r, k ORDER BY i) AS stop FROM matches),
spans AS (SELECT r, k, kind, (stop - size)::BIGINT AS start, kind || ':' || (stop - size)::BIGINT || ':' || stop::BIGINT AS span FROM placed WHERE kept),
found AS (SELECT r, count(*) FILTER (k = 0) AS a, count(*) FILTER (k = 1) AS b, count(*) FILTER (k = 2) AS c,
  string_agg(span, ',' ORDER BY start, k) FILTER (k < 3) AS base, string_agg(span, ',' ORDER BY start, k) AS every FROM spans GROUP BY r)
SELECT doc_id, coalesce(a, 0)::BIGINT AS n_assign, coalesce(b, 0)::BIGINT AS n_access, coalesce(c, 0)::BIGINT AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(every, '') AS spans
FROM d LEFT JOIN found USING (r)
"""


def op12_ball_kmeans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ball_kmeans.cluster(_table(spark, sf_dir, "embeddings"))


def _op12_sql(rounds: int = 3) -> str:
    nearest = lambda c: f"""SELECT r, c, d FROM (SELECT v.r, c.c, list_sum(list_transform(list_zip(v.v, c.v), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT AS d,
  row_number() OVER (PARTITION BY v.r ORDER BY d, c.c) AS n FROM v CROSS JOIN {c} c) WHERE n = 1"""  # noqa: E731
    steps = ""
    for n in range(rounds):
        steps += f""", a{n} AS MATERIALIZED ({nearest(f'c{n}')}),
m{n} AS (SELECT c, list(x ORDER BY j) AS v FROM (SELECT c, j, floor(sum(v[j]) / count(*))::BIGINT AS x FROM a{n} JOIN v USING (r), unnest(generate_series(1, 64)) AS u(j) GROUP BY c, j) GROUP BY c),
c{n + 1} AS MATERIALIZED (SELECT c, coalesce(m.v, o.v) AS v FROM c{n} o LEFT JOIN m{n} m USING (c))"""
    return f"""
WITH v AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE len(embedding) = 64 AND list_count(embedding) = 64 AND list_bool_and(list_transform(embedding, lambda x: isfinite(x)))),
c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('1:' || vec_id), v) - 1 AS c, v FROM v QUALIFY c < 16){steps},
final AS MATERIALIZED ({nearest(f'c{rounds}')})
SELECT vec_id, c::INTEGER AS cluster, d AS distance, (sum(d) OVER (PARTITION BY c))::BIGINT AS cluster_inertia, (sum(d) OVER ())::BIGINT AS inertia, sha256(array_to_string(k.v, ',')) AS centroid_sha256
FROM final JOIN v USING (r) JOIN c{rounds} k USING (c)
"""


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(_table(spark, sf_dir, "embeddings").withColumn("label", moved), F.col("vec_id") % 50 == 0)


OP13_SQL = """
WITH v AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND list_count(embedding) = len(embedding) AND list_bool_and(list_transform(embedding, lambda x: isfinite(x)))),
met AS MATERIALIZED (SELECT a.r, a.vec_id AS anchor_id, b.vec_id AS other, a.label = b.label AS same, list_inner_product(a.v, b.v)::BIGINT AS score FROM v a JOIN v b ON a.r <> b.r WHERE a.vec_id % 50 = 0),
p AS (SELECT * FROM met WHERE same QUALIFY row_number() OVER (PARTITION BY r ORDER BY score DESC, other) <= 5),
n AS (SELECT p.anchor_id, p.other AS positive_id, met.other AS negative_id, p.score AS positive_score, met.score AS negative_score,
  row_number() OVER (PARTITION BY p.r, p.other ORDER BY met.score DESC, met.other)::INTEGER AS rank
  FROM p JOIN met ON p.r = met.r AND NOT met.same AND 50 * p.score <= 100 * met.score AND 100 * met.score <= 95 * p.score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 3
"""


def queries() -> dict:
    return {name: f for name, f in globals().items() if name.startswith("op") and callable(f)}


def oracle_sql() -> dict[str, str]:
    return {
        "op3_decontaminate": OP3_SQL,
        "op5_window_dedup": OP5_SQL,
        "op6_ngram_join": OP6_SQL,
        "op11_blob_ledger": _op11_sql(),
        "op12_ball_kmeans": _op12_sql(),
        "op13_hard_negatives": OP13_SQL,
        "op8_shard_table": OP8_SQL.format(table=shard_table.fill(shard_table.shard_names(shard_table.SHARDS))),
    }
