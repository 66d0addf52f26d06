"""Queries of the training-data operators, each over its whole table, and DuckDB SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, decontaminate, exact_dedup, html_text, language, lm_score, near_dedup, pieces, pii, quality, toxicity, vector_codes, warc
from .common import held_out, materialize, scratch_dir, table


def tokenizer_path(name: str = "piece_bpe_32k.model") -> str:
    """The place of a public tokenizer's file; the operators take any path."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontaminate.scan(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


OP1_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
sized AS (SELECT item_id, w, least(10, len(w)) AS n FROM b WHERE len(w) > 0),
win AS (SELECT DISTINCT item_id, n, array_to_string(list_slice(w, i, i + n - 1), ' ') AS win FROM (SELECT item_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM sized)),
dw AS (SELECT doc_id, n, i, array_to_string(list_slice(w, i, i + n - 1), ' ') AS win
       FROM (SELECT d.doc_id, d.w, s.n, unnest(range(1, len(d.w) - s.n + 2)) AS i FROM d, (SELECT DISTINCT n FROM sized) s WHERE len(d.w) >= s.n)),
hit AS (SELECT dw.doc_id, dw.i, dw.n, win.item_id FROM dw JOIN win ON dw.win = win.win AND dw.n = win.n),
hw AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM (SELECT DISTINCT doc_id, i, n FROM hit)) GROUP BY doc_id),
hi AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hit) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hw ON d.doc_id = hw.doc_id LEFT JOIN hi ON d.doc_id = hi.doc_id
"""


def op2_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = toxicity.fit(docs, toxicity.training_labels(labels))
    return toxicity.score(docs, model).select("doc_id", held_out("doc_id", 3, 1).alias("held_out"), "score", "predicted")


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = language.fit(language.training_rows(docs))
    return language.predict(docs, model).select("doc_id", held_out("doc_id", 5, 0).alias("held_out"), "lang_pred", "score")


def op5_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    good = table(spark, sf_dir, "labels").where("quality = 1").select("doc_id")
    out = lm_score.score(table(spark, sf_dir, "documents"), good)
    return out.select("doc_id", "n_bytes", *[F.round(c, 6).alias(c) for c in ("background_loss", "target_loss", "score")])


OP5_SQL = """
WITH d AS (SELECT doc_id, repeat('00', 4) || hex(coalesce(text, '')) AS h, CAST(strlen(coalesce(text, '')) AS BIGINT) AS n_bytes FROM documents),
t AS (SELECT DISTINCT doc_id FROM labels WHERE quality = 1),
e AS (SELECT doc_id, substr(h, 2 * i - 1, 10) AS gram, count(*) AS n FROM (SELECT doc_id, h, unnest(range(1, n_bytes + 1)) AS i FROM d) GROUP BY 1, 2),
g AS (SELECT e.doc_id, gram, substr(gram, 1, 8) AS context, n, sum(n) OVER (PARTITION BY e.doc_id, substr(gram, 1, 8)) AS own, CASE WHEN t.doc_id IS NULL THEN 0 ELSE 1 END AS good FROM e LEFT JOIN t ON e.doc_id = t.doc_id),
c AS (SELECT gram, context, sum(n * good) AS tn, sum(n) AS bn FROM g GROUP BY 1, 2),
k AS (SELECT context, sum(tn) AS ta, sum(bn) AS ba FROM c GROUP BY 1),
s AS (SELECT doc_id, sum(-n * ln((tn - good * n + 0.1) / (ta - good * own + 25.6))) AS tl, sum(-n * ln((bn - n + 0.1) / (ba - own + 25.6))) AS bl
      FROM g JOIN c ON g.gram = c.gram JOIN k ON c.context = k.context GROUP BY doc_id)
SELECT d.doc_id, n_bytes, round(bl / n_bytes, 6) AS background_loss, round(tl / n_bytes, 6) AS target_loss, round((bl - tl) / n_bytes, 6) AS score
FROM d LEFT JOIN s ON d.doc_id = s.doc_id
"""


def op6_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.classes(table(spark, sf_dir, "documents"), size=2)


OP6_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ 	-
]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, sh FROM (SELECT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) = 1 THEN [w[1]] ELSE list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) END) AS sh FROM d)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
i AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT x, y FROM i JOIN n nx ON x = nx.doc_id JOIN n ny ON y = ny.doc_id WHERE 100 * c >= 80 * (nx.n + ny.n - c)),
e AS (SELECT x, y FROM l UNION SELECT y, x FROM l),
r AS (SELECT x AS doc_id, x AS reached FROM e UNION SELECT e.y, r.reached FROM r JOIN e ON r.doc_id = e.x),
m AS (SELECT doc_id, min(reached) AS reached FROM r GROUP BY doc_id)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, least(d.doc_id, coalesce(m.reached, d.doc_id)) AS component_id, d.doc_id = least(d.doc_id, coalesce(m.reached, d.doc_id)) AS kept
FROM d LEFT JOIN n ON d.doc_id = n.doc_id LEFT JOIN m ON d.doc_id = m.doc_id
"""


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_dir(spark, "warc")
    warc.write_archive(table(spark, sf_dir, "pages"), path)
    return warc.read_archive(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP7_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
q AS (SELECT page_id, CAST(strlen(h) AS BIGINT) AS payload_bytes, sha256(h) AS payload_digest, min(page_id) OVER (PARTITION BY h) AS winner FROM p)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 100 AND page_id <> winner THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND page_id <> winner THEN winner END AS refers_to
FROM q
"""


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.deduplicate(table(spark, sf_dir, "documents"))


OP8_SQL = r"""
WITH d AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY text_sha256) AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size,
       doc_id = min(doc_id) OVER (PARTITION BY text_sha256) AS kept, text_sha256
FROM d
"""

def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.round_trip(table(spark, sf_dir, "documents"), tokenizer_path())


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    matches = materialize(pii.matches(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "found"), "matches")
    found = pii.select(matches, pii.fit(matches))
    count = lambda k: F.size(F.filter("base", lambda x: x["kind"] == k)).cast("long")
    return found.select("doc_id", *[count(k).alias(f"n_{kind}") for k, kind in enumerate(pii.BASE)], F.sha2(pii.listed("base"), 256).alias("base_sha256"), pii.listed("spans").alias("spans"))


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"), tokenizer_path())


def op12_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = quality.fit(docs, quality.training_labels(labels))
    return quality.score(docs, model).select("doc_id", held_out("doc_id", 5, 0).alias("held_out"), "score", "predicted")


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.compress(table(spark, sf_dir, "embeddings"))


def _op13_sql() -> str:
    """The rounds of op13, one after the other: codebooks b0, b1, ... and the entries that are nearest to the parts, a0, a1, ..."""
    near = """a{k} AS MATERIALIZED (SELECT vec_id, part, min_by(entry, d * 256 + entry) AS entry, min(d) AS d FROM (
    SELECT p.vec_id, p.part, b.entry, CAST(list_sum(list_transform(list_zip(p.v, b.v), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS BIGINT) AS d FROM p JOIN b{k} b ON p.part = b.part) GROUP BY 1, 2)"""
    move = """m{k} AS (SELECT part, entry, i, CAST(floor(sum(x) / count(*)) AS BIGINT) AS x FROM (SELECT p.part, entry, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM p JOIN a{j} a ON p.vec_id = a.vec_id AND p.part = a.part) GROUP BY 1, 2, 3),
b{k} AS MATERIALIZED (SELECT b.part, b.entry, coalesce(n.v, b.v) AS v FROM b{j} b LEFT JOIN (SELECT part, entry, list(x ORDER BY i) AS v FROM m{k} GROUP BY 1, 2) n ON b.part = n.part AND b.entry = n.entry)"""
    rounds = ",\n".join(f"{near.format(k=k)},\n{move.format(k=k + 1, j=k)}" for k in range(vector_codes.ROUNDS))
    last = vector_codes.ROUNDS
    return f"""
WITH k AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
      WHERE embedding IS NOT NULL AND list_bool_and(list_transform(embedding, lambda x: coalesce(isfinite(x), false)))),
p AS MATERIALIZED (SELECT vec_id, part, v[part * len(v) // 4 + 1 : (part + 1) * len(v) // 4] AS v FROM k, range(4) r(part)),
b0 AS MATERIALIZED (SELECT part, row_number() OVER (PARTITION BY part ORDER BY vec_id) - 1 AS entry, v FROM p QUALIFY entry < 256),
{rounds},
{near.format(k=last)},
h AS (SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM b{last}),
c AS (SELECT vec_id, string_agg(lower(printf('%02x', entry)), '' ORDER BY part) AS code, CAST(sum(d) AS BIGINT) AS error FROM a{last} GROUP BY 1)
SELECT k.vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM k JOIN c ON k.vec_id = c.vec_id, h
"""


OP13_SQL = _op13_sql()

QUERIES = {
    "op1_decontaminate": op1_decontaminate,
    "op2_html_text": op2_html_text,
    "op3_toxicity": op3_toxicity,
    "op4_language_id": op4_language_id,
    "op5_lm_score": op5_lm_score,
    "op6_near_dedup": op6_near_dedup,
    "op7_warc": op7_warc,
    "op8_exact_dedup": op8_exact_dedup,
    "op9_sentencepiece": op9_sentencepiece,
    "op10_pii": op10_pii,
    "op11_alignment": op11_alignment,
    "op12_quality": op12_quality,
    "op13_vector_codes": op13_vector_codes,
}
ORACLE_SQL = {"op1_decontaminate": OP1_SQL, "op5_lm_score": OP5_SQL, "op6_near_dedup": OP6_SQL, "op7_warc": OP7_SQL, "op8_exact_dedup": OP8_SQL, "op13_vector_codes": OP13_SQL}
