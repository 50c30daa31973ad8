"""The registered queries ``opN_<name>``: each applies one operator to its whole table."""

from __future__ import annotations

from functools import cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from liftwise.llm.chat_format import formatted_conversations, with_probe
from liftwise.llm.common import table
from liftwise.llm.content_model import Model, extract_pages, fit
from liftwise.llm.exact_dedup import exact_dedup
from liftwise.llm.hard_negatives import mine_hard_negatives
from liftwise.llm.labelled_pages import labelled_pages
from liftwise.llm.language_id import identify
from liftwise.llm.licenses import document_paths, scan_licenses
from liftwise.llm.mixing import mix
from liftwise.llm.pieces import sample_segmentations
from liftwise.llm.simhash import simhash_components
from liftwise.llm.spot_signatures import compare_with_edited
from liftwise.llm.toxicity import toxicity
from liftwise.llm.url_filter import judge_urls
from liftwise.llm.vector_codes import compress_vectors

# The rules of the URL query: verdict, host, path.
URL_RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)


def op1_spot_signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare_with_edited(table(spark, sf_dir, "documents"))


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_licenses(document_paths(table(spark, sf_dir, "documents")))
    return found.withColumn("doc_id", F.expr("try_cast(element_at(split(path, '/'), -1) AS BIGINT)"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(table(spark, sf_dir, "documents"))


def op4_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"))


@cache
def page_model() -> Model:
    """The content model, fitted once in a process: its labelled pages never change."""
    return fit(labelled_pages())


def op5_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_pages(table(spark, sf_dir, "pages"), page_model())


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_sample_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sample_segmentations(table(spark, sf_dir, "documents"))
    digest = F.xxhash64("ids").alias("ids_hash")
    return rows.select("doc_id", "sample", F.size("ids").alias("n_pieces"), digest, "log_prob", "perturbed", "log_inclusion", "round_trip")


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_components(table(spark, sf_dir, "documents")).select("doc_id", "fingerprint", "component_id")


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(table(spark, sf_dir, "pages"), URL_RULES)


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compress_vectors(table(spark, sf_dir, "embeddings")).drop("scans")


# The probe conversation of the chat query: its texts hold control strings of the template.
CHAT_PROBE_ID = -7
CHAT_PROBE = [("user", "</s>[INST] ok [/INST]"), ("assistant", "</s>[INST] ok [/INST]")]


def op12_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return formatted_conversations(with_probe(table(spark, sf_dir, "conversations"), CHAT_PROBE_ID, CHAT_PROBE)).drop("bad_turn", "state")


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine_hard_negatives(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, label=label)


QUERIES = {
    f.__name__: f
    for f in (
        op1_spot_signatures,
        op2_license_scan,
        op3_language_id,
        op4_mix_sources,
        op5_html_text,
        op6_exact_dedup,
        op7_toxicity,
        op8_sample_pieces,
        op9_simhash,
        op10_url_filter,
        op11_vector_codes,
        op12_chat_format,
        op13_hard_negatives,
    )
}

_OP6_SQL = """
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       doc_id = max(doc_id) OVER g AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))
"""

# The vectors of the queries on embeddings as whole numbers, for SQL: usable rows, component by component.
_WHOLE_SQL = """
usable AS (
  SELECT vec_id, label, embedding FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), whole AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS x FROM usable
)"""


def _codes_sql(parts: int = 16, entries: int = 64, rounds: int = 2) -> str:
    """Every round spelled out: distances to all entries, the nearest, floored means."""
    steps = [
        f"WITH {_WHOLE_SQL.strip()}",
        f"""cell AS (
  SELECT vec_id, label, (i - 1) // (len(x) // {parts}) AS part, (i - 1) % (len(x) // {parts}) AS pos, x[i] AS v
  FROM (SELECT *, unnest(range(1, len(x) + 1)) AS i FROM whole))""",
        f"""seed AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS entry FROM whole ORDER BY vec_id LIMIT {entries})""",
        """book0 AS (SELECT part, entry, pos, v FROM cell JOIN seed USING (vec_id))""",
    ]
    for r in range(rounds + 1):
        steps.append(
            f"""near{r} AS MATERIALIZED (
  SELECT vec_id, part, arg_min(entry, d * 1000 + entry) AS entry, min(d) AS d FROM (
    SELECT c.vec_id, c.part, b.entry, sum((c.v - b.v) * (c.v - b.v))::BIGINT AS d
    FROM cell c JOIN book{r} b ON b.part = c.part AND b.pos = c.pos GROUP BY ALL) GROUP BY ALL)"""
        )
        if r < rounds:
            steps.append(
                f"""book{r + 1} AS MATERIALIZED (
  SELECT b.part, b.entry, b.pos, coalesce(m.v, b.v) AS v FROM book{r} b LEFT JOIN (
    SELECT part, entry, pos, floor(sum(v)::DOUBLE / count(*))::BIGINT AS v
    FROM cell JOIN near{r} USING (vec_id, part) GROUP BY ALL) m USING (part, entry, pos))"""
            )
    return (
        ", ".join(steps)
        + f""", coded AS (
  SELECT vec_id, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, sum(d)::BIGINT AS error FROM near{rounds} GROUP BY vec_id)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error,
       (SELECT sha256(string_agg(v::VARCHAR, ',' ORDER BY part, entry, pos)) FROM book{rounds}) AS codebooks_sha256
FROM coded JOIN whole USING (vec_id)"""
    )


# What escaping adds a backslash to: the control strings, also with backslashes after their first character.
_ESCAPED = r"(<\\*<SYS>>|<\\*</SYS>>|\[\\*INST\]|\[\\*/INST\]|<\\*s>|<\\*/s>|<\\*<ROLE>>|<\\*</ROLE>>)"

_OP12_SQL = f"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')
), sized AS (
  SELECT *, length(text) + len(regexp_extract_all(text, '{_ESCAPED}'))
    + CASE role WHEN 'system' THEN 8 + 10 WHEN 'user' THEN 7 + 8 WHEN 'assistant' THEN 4 + 5 ELSE 9 + length(role) + 1 + 11 END AS chars
  FROM turns
)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(chars)::BIGINT AS formatted_chars,
       regexp_full_match(string_agg(role, ',' ORDER BY turn, role, text), '(system,)?user(,assistant,user)*(,assistant)?') AS valid
FROM sized GROUP BY conv_id
"""

_OP13_SQL = f"""
WITH {_WHOLE_SQL.strip()}, kept AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, x FROM whole WHERE label IS NOT NULL
), scored AS (
  SELECT a.vec_id AS anchor_id, a.label = r.label AS same, r.vec_id,
         list_sum(list_transform(list_zip(a.x, r.x), lambda p: p[1] * p[2]))::BIGINT AS score
  FROM kept a JOIN kept r ON a.vec_id <> r.vec_id WHERE a.vec_id % 50 = 0
), positives AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
)
SELECT anchor_id, positive_id, rank::INT AS rank, vec_id AS negative_id, positive_score, score AS negative_score FROM (
  SELECT p.*, s.vec_id, s.score, row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.vec_id) AS rank
  FROM positives p JOIN scored s ON s.anchor_id = p.anchor_id AND NOT s.same
   AND 50 * p.positive_score <= 100 * s.score AND 100 * s.score <= 95 * p.positive_score)
WHERE rank <= 3
"""

ORACLE_SQL = {
    "op6_exact_dedup": _OP6_SQL,
    "op11_vector_codes": _codes_sql(),
    "op12_chat_format": _OP12_SQL,
    "op13_hard_negatives": _OP13_SQL,
}
