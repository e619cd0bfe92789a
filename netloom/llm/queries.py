"""One query for each operator, and the SQL of those that SQL can express."""

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from netloom.llm import bestfit, chat, exact, forest, infill, mixing, near, negatives, packing, pii, quality, secrets, urls


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_mixing(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    out = mixing.mix(docs, mixing.ranked_weights(docs, [1, 2, 3]))
    return out.select("doc_id", "size", "source_size", "target", "taken")


def op2_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    return urls.judged(table(spark, folder, "pages"))


def op3_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return exact.exact_duplicates(table(spark, folder, "documents"))


def op4_quality(spark: SparkSession, folder: str) -> DataFrame:
    return quality.quality_scores(table(spark, folder, "documents"), table(spark, folder, "labels"))


def op5_nearest(spark: SparkSession, folder: str) -> DataFrame:
    return forest.nearest(table(spark, folder, "embeddings"), F.col("vec_id") % 20 == 0)


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op6_packing(spark: SparkSession, folder: str) -> DataFrame:
    pieces = packing.pack(table(spark, folder, "documents"), tokenizer_path())
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op7_chat(spark: SparkSession, folder: str) -> DataFrame:
    given = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.range(2).select(
        F.lit(-7).cast("bigint").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit("\\### Assistant: </turn> ok").alias("text"),
    )
    return chat.read_back(chat.formatted(given.unionByName(probe)))


def op8_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return near.near_duplicates(table(spark, folder, "documents"), width=3, percent=85)


def spans_text(spans: Column, kinds: tuple[str, ...]) -> Column:
    """kind:start:end, comma-joined."""
    names = F.array(*[F.lit(k) for k in kinds])
    one = lambda x: F.concat_ws(":", F.element_at(names, x["kind"] + 1), x["start"].cast("string"), x["stop"].cast("string"))
    return F.array_join(F.transform(spans, one), ",")


def count_of(spans: Column, kind: int) -> Column:
    return F.size(F.filter(spans, lambda x: x["kind"] == kind)).cast("bigint")


def op9_secrets(spark: SparkSession, folder: str) -> DataFrame:
    found = secrets.secret_spans(table(spark, folder, "documents"))
    counts = [count_of(F.col("spans"), i).alias(f"n_{kind}") for i, kind in enumerate(secrets.KINDS[:3])]
    return found.select("doc_id", *counts, "base_sha256", spans_text(F.col("spans"), secrets.KINDS).alias("spans"), "n_live", "n_copied")


def op10_pii(spark: SparkSession, folder: str) -> DataFrame:
    found = pii.personal_spans(table(spark, folder, "documents"))
    counts = [count_of(F.col("base"), i).alias(f"n_{kind}") for i, kind in enumerate(pii.KINDS)]
    digest = F.sha2(spans_text(F.col("base"), pii.KINDS), 256)
    return found.select("doc_id", *counts, digest.alias("base_sha256"), spans_text(F.array_sort(F.concat("base", "added")), pii.KINDS).alias("spans"))


def op11_negatives(spark: SparkSession, folder: str) -> DataFrame:
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.hard_negatives(table(spark, folder, "embeddings").withColumn("label", moved), F.col("vec_id") % 100 == 0)


def op12_best_fit(spark: SparkSession, folder: str) -> DataFrame:
    return bestfit.pack_best_fit(table(spark, folder, "documents"), tokenizer_path(), carry=F.crc32("ids")).withColumnRenamed("carried", "ids_crc32")


def op13_infill(spark: SparkSession, folder: str) -> DataFrame:
    cut = infill.fill_in_middle(table(spark, folder, "documents"))
    text = infill.restored(F.col("output"), F.col("form"))
    return cut.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(text, 256).alias("restored_sha256"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_mixing, op2_url_filter, op3_exact_dedup, op4_quality, op5_nearest, op6_packing, op7_chat, op8_near_dedup, op9_secrets, op10_pii, op11_negatives,
        op12_best_fit, op13_infill,
    )
}

SQL: dict[str, str] = {
    "op1_mixing": r"""
WITH sized AS (
    SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
           substr(md5('mix:' || coalesce(doc_id::VARCHAR, '')), 1, 16) AS mark
    FROM documents),
sources AS (
    SELECT source, sum(size)::BIGINT AS source_size,
           CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 1.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 3.0::DOUBLE END AS weight
    FROM sized GROUP BY source),
levels AS (
    SELECT *, 3 * source_size / weight AS full_at,
           (sum(source_size) OVER () - coalesce(sum(3 * source_size) OVER (ORDER BY 3 * source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
             / sum(weight) OVER (ORDER BY 3 * source_size / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level,
           row_number() OVER (ORDER BY 3 * source_size / weight, source NULLS LAST) AS place
    FROM sources),
aims AS (
    SELECT source, source_size,
           least(3.0::DOUBLE * source_size, coalesce((SELECT arg_min(level, place) FROM levels WHERE level <= full_at) * weight, 3.0::DOUBLE * source_size)) AS target
    FROM levels),
queue AS (
    SELECT s.*, a.source_size, a.target,
           sum(size) OVER (PARTITION BY s.source ORDER BY mark, doc_id NULLS FIRST, size ROWS UNBOUNDED PRECEDING)::BIGINT AS ending
    FROM sized s JOIN aims a ON s.source IS NOT DISTINCT FROM a.source),
copies AS (
    SELECT doc_id, source, size, turn, ending, (turn * source_size + ending)::DOUBLE / target AS finish
    FROM queue, (VALUES (0), (1), (2)) AS t(turn) WHERE size > 0 AND target > 0),
cut AS (
    SELECT *, sum(size) OVER (ORDER BY finish, source NULLS LAST, ending, turn ROWS UNBOUNDED PRECEDING) AS total FROM copies),
taken AS (
    SELECT source, ending, count(*) AS n FROM cut WHERE total <= (SELECT round(sum(target)) FROM aims) GROUP BY source, ending)
SELECT q.doc_id, q.size, q.source_size, q.target, (coalesce(n, 0) * q.size)::BIGINT AS taken
FROM queue q LEFT JOIN taken t ON q.source IS NOT DISTINCT FROM t.source AND q.ending = t.ending AND q.size > 0
""",
    "op3_exact_dedup": """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       coalesce(doc_id = max(doc_id) OVER w, max(doc_id) OVER w IS NULL) AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
""",
    "op8_near_dedup": r"""
WITH RECURSIVE words AS MATERIALIZED (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
shingles AS MATERIALIZED (
    SELECT DISTINCT doc_id, s FROM (
        SELECT doc_id, unnest(CASE WHEN len(w) >= 3 THEN [w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] FOR i IN range(1, len(w) - 1)] WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM words)),
sizes AS MATERIALIZED (SELECT w.doc_id, coalesce(n, 0) AS n FROM words w LEFT JOIN (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id) USING (doc_id)),
pairs AS MATERIALIZED (
    SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS both_have FROM shingles x JOIN shingles y ON x.s = y.s AND x.doc_id < y.doc_id GROUP BY ALL),
edges AS MATERIALIZED (
    SELECT a, b FROM pairs JOIN sizes p ON p.doc_id = a JOIN sizes q ON q.doc_id = b WHERE 100 * both_have >= 85 * (p.n + q.n - both_have)),
ways AS MATERIALIZED (SELECT a, b FROM edges UNION ALL SELECT b, a FROM edges),
reach AS (SELECT DISTINCT a AS doc_id, a AS seen FROM ways UNION SELECT r.doc_id, e.b FROM reach r JOIN ways e ON r.seen = e.a)
SELECT s.doc_id, s.n AS n_shingles, coalesce(least(m.low, s.doc_id), s.doc_id) AS component_id, coalesce(least(m.low, s.doc_id), s.doc_id) = s.doc_id AS kept
FROM sizes s LEFT JOIN (SELECT doc_id, min(seen) AS low FROM reach GROUP BY doc_id) m USING (doc_id)
""",
    "op7_chat": r"""
WITH given AS (
    SELECT conv_id, turn, role, text FROM conversations
    UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
turns AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS n FROM given),
sized AS (
    SELECT *, length(text) + length(text) - length(translate(text, '\#:<', '')) AS written,
           CASE WHEN role IN ('system', 'user', 'assistant') THEN length(role) ELSE 1 + 2 * length(role) - length(translate(role, '\#:<', '')) END AS name_chars,
           lag(role, 1, '') OVER (PARTITION BY conv_id ORDER BY n) AS before
    FROM turns)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY n)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY n) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(4 + name_chars + 2 + written + 8)::BIGINT AS formatted_chars,
       count(*) FILTER (NOT ((before = '' AND role IN ('system', 'user')) OR (before = 'system' AND role = 'user') OR (before = 'user' AND role = 'assistant') OR (before = 'assistant' AND role = 'user')))::BIGINT AS n_errors
FROM sized GROUP BY conv_id
""",
    "op11_negatives": """
WITH given AS (
    SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
    FROM embeddings
    WHERE label IS NOT NULL AND vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x::DOUBLE))) = 0),
scored AS (
    SELECT a.vec_id AS anchor_id, c.vec_id AS other_id, a.label = c.label AS same, list_inner_product(a.v, c.v)::BIGINT AS score
    FROM given a JOIN given c ON a.vec_id % 100 = 0 AND a.vec_id <> c.vec_id AND len(a.v) = len(c.v)),
positives AS (
    SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM scored WHERE same
    QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5),
ranked AS (
    SELECT anchor_id, positive_id, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other_id) AS rank, other_id AS negative_id, positive_score, score AS negative_score
    FROM positives JOIN scored USING (anchor_id)
    WHERE NOT same AND 100 * score BETWEEN 30 * positive_score AND 90 * positive_score)
SELECT anchor_id, positive_id, rank::INTEGER AS rank, negative_id, positive_score, negative_score FROM ranked WHERE rank <= 10
""",
    "op13_infill": r"""
WITH given AS (
    SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS u, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS d FROM documents),
numbers AS (
    SELECT *, len(u)::BIGINT AS n, ('0x' || substr(d, 1, 8))::BIGINT AS h1, ('0x' || substr(d, 9, 8))::BIGINT AS h2, ('0x' || substr(d, 17, 8))::BIGINT AS h3, ('0x' || substr(d, 25, 8))::BIGINT AS h4 FROM given),
cut AS (
    SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
           CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
    FROM numbers),
parts AS (SELECT *, array_to_string(u[1:a], '') AS p, array_to_string(u[a + 1:b], '') AS m, array_to_string(u[b + 1:], '') AS s FROM cut)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM parts
""",
}
