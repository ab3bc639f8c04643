"""The queries of the text operators, by name, and SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from quillspark.llm import containers, languages, mixing, near_duplicates, residue, scan_noise, shared_spans, splitting, tokens, truncation
from quillspark.session import cut
from quillspark.sources.tables import table

Query = Callable[[SparkSession, str], DataFrame]

#: Rows that a table of settings (fields, containers, targets, languages) may have.
SETTINGS_ROWS = 100_000


def small_rows(settings: DataFrame) -> list[Row]:
    """The rows of a table of settings; one with more than ``SETTINGS_ROWS`` is refused, not cut."""
    rows = settings.limit(SETTINGS_ROWS + 1).collect()
    if len(rows) > SETTINGS_ROWS:
        raise ValueError(f"a table of settings has more than {SETTINGS_ROWS} rows")
    return rows


RESIDUE_FIELDS = {"title": "document_info.title", "full_text_content": "full_text_content"}


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return scan_noise.find_noise(table(spark, d, "aiscript"), "rec_id", "full_text_content").withColumnRenamed("id", "rec_id")


def p1_repaired(spark: SparkSession, d: str) -> DataFrame:
    """All records' texts as continuous paragraphs."""
    out = scan_noise.repaired(table(spark, d, "aiscript"), "rec_id", "full_text_content")
    return out.select(F.col("id").alias("rec_id"), F.col("text").alias("full_text_content"))


def _inspected(spark: SparkSession, d: str) -> DataFrame:
    records = table(spark, d, "aiscript")
    model = residue.fit_on(records, RESIDUE_FIELDS)
    fields = {"full_text_content": "full_text_content", "summary": "main_content.summary"}
    return cut(truncation.inspect(records, "rec_id", fields, "source", model, ("full_text_content",)))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return truncation.find_truncated(_inspected(spark, d)).withColumnRenamed("id", "rec_id")


def p2_limits(spark: SparkSession, d: str) -> DataFrame:
    """Hidden storage limits: lengths, by way of counting, at which values pile up."""
    return truncation.hidden_limits(_inspected(spark, d))


def p2_report(spark: SparkSession, d: str) -> DataFrame:
    """How often each source truncates, by the verdict of ``p2_found``."""
    return truncation.truncation_report(_inspected(spark, d))


def p3_pieces(spark: SparkSession, d: str) -> DataFrame:
    """The pieces of all oversized values."""
    limits = {r["field"]: (r["max_chars"], r["overlap_chars"]) for r in small_rows(table(spark, d, "size_limit"))}
    return splitting.oversized(splitting.record_values(table(spark, d, "aiscript")), limits).withColumnRenamed("id", "rec_id")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return p3_pieces(spark, d).filter("piece_no = 1").select("rec_id", "field", "pos").distinct()


P3_SQL = """
WITH sections AS (SELECT rec_id, generate_subscripts(detailed_sections, 1) - 1 AS pos, unnest(detailed_sections) AS s FROM aiscript),
vals AS (SELECT rec_id, 'full_text_content' AS field, 0 AS pos, length(full_text_content) AS n FROM aiscript
  UNION ALL SELECT rec_id, 'detailed_sections', pos, length(s.content) FROM sections)
SELECT DISTINCT rec_id, v.field, CAST(pos AS INTEGER) AS pos FROM vals v JOIN size_limit l ON v.field = l.field WHERE n > max_chars
"""


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    pairs = near_duplicates.similar_pairs(table(spark, d, "aiscript"), "rec_id", "full_text_content")
    return pairs.select(F.col("id_a").alias("rec_id_a"), F.col("id_b").alias("rec_id_b"))


def p4_groups(spark: SparkSession, d: str) -> DataFrame:
    return near_duplicates.similar_groups(table(spark, d, "aiscript"), "rec_id", "full_text_content").withColumnRenamed("id", "rec_id")


def _stretches(spark: SparkSession, d: str, without_residue: bool) -> DataFrame:
    records = table(spark, d, "aiscript")
    codes = {r["code"]: r["name"] for r in small_rows(table(spark, d, "lang_code"))}
    model = residue.fit_on(records, RESIDUE_FIELDS) if without_residue else None
    return languages.language_stretches(records, "rec_id", "full_text_content", "lang", codes, model)


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    """Stretches of the records whose label is missing or wrong, or which mix languages."""
    wrong = F.col("label").isNull() | (F.col("label") != F.col("doc_lang")) | (F.col("n_segments") > 1)
    return _stretches(spark, d, True).filter(wrong).select(F.col("id").alias("rec_id"), "seg_no", "lang")


def p6_stretches(spark: SparkSession, d: str) -> DataFrame:
    """The language and confidence of each stretch of each record."""
    return _stretches(spark, d, False).select(F.col("id").alias("rec_id"), "seg_no", "lang", "confidence", "start", "stop", F.col("doc_lang").alias("record_lang"), F.col("doc_confidence").alias("record_confidence"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    found = residue.find_residue(table(spark, d, "aiscript"), "rec_id", RESIDUE_FIELDS)
    return found.select(F.col("id").alias("rec_id"), "field")


def p7_residue(spark: SparkSession, d: str) -> DataFrame:
    """The residue itself: where it stands and how much of the value it covers."""
    found = residue.find_residue(table(spark, d, "aiscript"), "rec_id", RESIDUE_FIELDS)
    return found.select(F.col("id").alias("rec_id"), "field", "coverage", F.explode("spans").alias("s")).select("rec_id", "field", "coverage", "s.start", "s.stop")


def p7_clean(spark: SparkSession, d: str) -> DataFrame:
    """The records without residue."""
    records = table(spark, d, "aiscript")
    found = residue.find_residue(records, "rec_id", RESIDUE_FIELDS).select(F.col("id").alias("rec_id")).distinct()
    return records.join(found, "rec_id", "left_anti").select("rec_id", "source", "lang", F.col("document_info.title").alias("title"), "full_text_content")


def _specs(spark: SparkSession, d: str) -> dict[str, int]:
    return {r["container"]: r["capacity_tokens"] for r in small_rows(table(spark, d, "container_spec"))}


def _counted(spark: SparkSession, d: str) -> DataFrame:
    return cut(tokens.token_counts(table(spark, d, "documents"), "doc_id", "text", "source"))


def _filled(spark: SparkSession, d: str) -> tuple[DataFrame, dict[str, int], dict[str, containers.Solution]]:
    specs = _specs(spark, d)
    parts = containers.salted(_counted(spark, d), specs)
    solved = containers.solutions(parts, specs)
    return containers.fill(parts, specs, solved), specs, solved


def p8_containers(spark: SparkSession, d: str) -> DataFrame:
    return _filled(spark, d)[0].withColumnRenamed("id", "doc_id")


def p8_report(spark: SparkSession, d: str) -> DataFrame:
    """How many containers of each kind there are, how full, and the linear program's bound."""
    return containers.report(*_filled(spark, d))


def _targets(spark: SparkSession, d: str) -> dict[str, tuple[float, int]]:
    return {r["source"].strip().lower(): (r["target_share"], r["max_repeats"]) for r in small_rows(table(spark, d, "mix_target"))}


def p9_mix(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix_sources(_counted(spark, d), _targets(spark, d)).withColumnRenamed("id", "doc_id")


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    """The share that each source really reached."""
    targets = _targets(spark, d)
    return mixing.shares(cut(mixing.mix_sources(_counted(spark, d), targets)), targets)


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    pairs = shared_spans.sharing_pairs(table(spark, d, "documents"), "doc_id", "text")
    return pairs.select(F.col("id_a").alias("doc_id_a"), F.col("id_b").alias("doc_id_b"))


def p10_passages(spark: SparkSession, d: str) -> DataFrame:
    return shared_spans.shared_passages(table(spark, d, "documents"), "doc_id", "text").withColumnRenamed("id", "doc_id")


def p10_report(spark: SparkSession, d: str) -> DataFrame:
    return shared_spans.shared_report(table(spark, d, "documents"), "doc_id", "text").withColumnRenamed("id", "doc_id")


def queries() -> dict[str, Query]:
    return {
        "p1_found": p1_found,
        "p1_repaired": p1_repaired,
        "p2_found": p2_found,
        "p2_limits": p2_limits,
        "p2_report": p2_report,
        "p3_found": p3_found,
        "p3_pieces": p3_pieces,
        "p4_found": p4_found,
        "p4_groups": p4_groups,
        "p6_found": p6_found,
        "p6_stretches": p6_stretches,
        "p7_found": p7_found,
        "p7_residue": p7_residue,
        "p7_clean": p7_clean,
        "p8_containers": p8_containers,
        "p8_report": p8_report,
        "p9_mix": p9_mix,
        "p9_shares": p9_shares,
        "p10_found": p10_found,
        "p10_passages": p10_passages,
        "p10_report": p10_report,
    }


#: Every run of three words of every text of 50 words or more, each once for its text.
_RUNS = """t AS (SELECT rec_id, list_filter(regexp_split_to_array(lower(full_text_content), '[\\s\\x{85}\\x{a0}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]+'), lambda w: w <> '') AS w FROM aiscript WHERE full_text_content IS NOT NULL),
r AS (SELECT DISTINCT rec_id, hash(w[i], w[i + 1], w[i + 2]) AS h FROM (SELECT rec_id, w, unnest(range(1, len(w) - 1)) AS i FROM t WHERE len(w) >= 50) x), n AS (SELECT rec_id, count(*) AS n FROM r GROUP BY rec_id),
links AS (SELECT a.rec_id AS rec_id_a, b.rec_id AS rec_id_b, count(*) AS c FROM r a JOIN r b ON a.h = b.h AND a.rec_id < b.rec_id GROUP BY ALL),
similar_ AS (SELECT rec_id_a, rec_id_b FROM links JOIN n na ON na.rec_id = rec_id_a JOIN n nb ON nb.rec_id = rec_id_b WHERE c >= 0.6 * (na.n + nb.n - c))"""
P4_GROUPS_SQL = f"""WITH RECURSIVE {_RUNS}, e AS (SELECT rec_id_a AS a, rec_id_b AS b FROM similar_ UNION ALL SELECT rec_id_b, rec_id_a FROM similar_),
c AS (SELECT rec_id, rec_id AS root FROM aiscript UNION SELECT c.rec_id, e.b FROM c JOIN e ON c.root = e.a),
l AS (SELECT e.a AS rec_id, count(DISTINCT y.full_text_content) AS n_links FROM e JOIN aiscript x ON x.rec_id = e.a JOIN aiscript y ON y.rec_id = e.b WHERE x.full_text_content <> y.full_text_content GROUP BY e.a)
SELECT c.rec_id, min(root) AS group_id, coalesce(min(n_links), 0) AS n_links FROM c LEFT JOIN l ON c.rec_id = l.rec_id GROUP BY c.rec_id"""
P4_SQL = f"WITH {_RUNS} SELECT rec_id_a, rec_id_b FROM similar_"

#: Every run of 200 characters of every document, and those that two different documents have.
_WINDOWS = """w AS (SELECT doc_id, i, md5(substr(text, i, 200)) AS h FROM (SELECT doc_id, text, unnest(range(1, length(text) - 198)) AS i FROM documents WHERE length(text) >= 200) x),
shared AS (SELECT h FROM w GROUP BY h HAVING min(doc_id) < max(doc_id)), s AS (SELECT doc_id, h, i - 1 AS start FROM w WHERE h IN (SELECT h FROM shared))"""
_PASSAGES = f"""{_WINDOWS}, g AS (SELECT doc_id, start, CASE WHEN start - lag(start) OVER (PARTITION BY doc_id ORDER BY start) <= 200 THEN 0 ELSE 1 END AS new FROM s),
k AS (SELECT doc_id, start, sum(new) OVER (PARTITION BY doc_id ORDER BY start) AS run FROM g), p AS (SELECT doc_id, CAST(min(start) AS INTEGER) AS start, CAST(max(start) + 200 AS INTEGER) AS stop FROM k GROUP BY doc_id, run)"""
P10_SQL = {
    "p10_found": f"WITH {_WINDOWS} SELECT DISTINCT a.doc_id AS doc_id_a, b.doc_id AS doc_id_b FROM s a JOIN s b ON a.h = b.h AND a.doc_id < b.doc_id",
    "p10_passages": f"WITH {_PASSAGES} SELECT doc_id, start, stop FROM p",
    "p10_report": f"""WITH {_PASSAGES}, o AS (SELECT doc_id, count(*) AS n_passages, CAST(sum(stop - start) AS BIGINT) AS shared_chars FROM p GROUP BY doc_id)
SELECT d.doc_id, CAST(coalesce(length(text), 0) AS INTEGER) AS n_chars, coalesce(n_passages, 0) AS n_passages, coalesce(shared_chars, 0) AS shared_chars, CASE WHEN length(text) > 0 THEN coalesce(shared_chars, 0) / length(text) ELSE 0.0 END AS shared_part FROM documents d LEFT JOIN o ON d.doc_id = o.doc_id""",
}


def oracle_sql() -> dict[str, str]:
    return {"p3_found": P3_SQL, "p4_found": P4_SQL, "p4_groups": P4_GROUPS_SQL, **P10_SQL}
