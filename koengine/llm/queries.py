"""The pN_ queries of the training-data problems, and the SQL that checks them where SQL can."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from koengine.runtime import table


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of objects of one model, one among the other's 10 most similar, of cosine 0.90 or more."""
    from koengine.llm import ann

    live = ann.latest_live(table(spark, sf_dir, "ko"))
    near, members = ann.similar_vectors(live, "koid", "model", "vec", k=10, min_cosine=0.90)
    return ann.expand_copies(near, members, 10).select(F.col("key_a").alias("koid_a"), F.col("key_b").alias("koid_b"))


def p1_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 most similar of every embedding whose id is divisible by 50, against all, through the forest."""
    from koengine.llm import ann

    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("key"), F.lit("one").alias("model"), F.col("embedding").alias("vec"))
    near, members = ann.similar_vectors(e, k=10)
    own = members.select("rid", F.col("key").alias("query_id")).where("query_id % 50 = 0")
    other = members.select(F.col("rid").alias("other"), F.col("key").alias("id"))
    return near.join(own, "rid").join(other, "other").select("query_id", "id", F.col("rank").cast("int").alias("rank"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records whose name means an entry of kb_entry without being its name letter for letter."""
    from koengine.llm.names import link_names

    entity = table(spark, sf_dir, "entity_candidate").select(F.lit("entity").alias("record_kind"), F.col("candidate_id").alias("record_id"), "name")
    conflict = table(spark, sf_dir, "entity_conflict").where("koid IS NULL").select(F.lit("conflict").alias("record_kind"), F.col("conflict_id").alias("record_id"), F.col("entity_name").alias("name"))
    kb = table(spark, sf_dir, "kb_entry")
    records = entity.unionByName(conflict).where("name IS NOT NULL").distinct()
    links = link_names(records, kb)
    exact = kb.select("koid", "name")
    return records.join(links, "name").join(exact, ["koid", "name"], "left_anti").select("record_kind", "record_id", "koid")


def p2_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every distinct name with its group: the entry it means, or else its variants' group."""
    from koengine.llm.names import group_names

    names = table(spark, sf_dir, "entity_candidate").select("name").unionByName(table(spark, sf_dir, "entity_conflict").select(F.col("entity_name").alias("name")))
    return group_names(names, table(spark, sf_dir, "kb_entry"))


def p3_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ordered, overlapping pieces of every oversized block."""
    from koengine.llm.split import split_oversized

    return split_oversized(table(spark, sf_dir, "ast_node"), table(spark, sf_dir, "chunk_profile"), key="node_id", text="text", kind="block_type")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks that are above their limit: those that the splitter cut."""
    return p3_pieces(spark, sf_dir).where("piece_no = 1").select("node_id")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Noisy lines of every scanned page, by type of noise."""
    from koengine.llm.ocr import detect, noise_table

    return noise_table(detect(table(spark, sf_dir, "ocr_page")))


def p4_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every scanned document as continuous paragraphs."""
    from koengine.llm.ocr import repair

    return repair(table(spark, sf_dir, "ocr_page"))


def _personal(spark: SparkSession, sf_dir: str) -> DataFrame:
    from koengine.llm.pii import find_personal

    people = table(spark, sf_dir, "kb_entry").where("type_name = 'Person'")
    return find_personal(table(spark, sf_dir, "ast_node"), people, key="node_id", text="text")


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each item of personal information in the blocks' texts."""
    return _personal(spark, sf_dir).select(F.col("key").alias("node_id"), "pii_type", "start_at")


def p6_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The blocks' texts with typed placeholders."""
    from koengine.llm.pii import redact

    return redact(table(spark, sf_dir, "ast_node"), _personal(spark, sf_dir), key="node_id", text="text")


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Surviving row of each field of each group of conflicts that report one contradiction."""
    from koengine.llm.survivor import survivors

    c = table(spark, sf_dir, "entity_conflict")
    c = c.withColumn("property_key", F.regexp_replace(F.lower("property_name"), r"[\s_\-./]+", ""))
    out = survivors(
        c, group=("document_id", "koid", "property_key"), key="conflict_id", bundles=(("document_value",), ("existing_value",), ("severity",)),
        trust=(F.try_element_at("evidence", F.lit(1))["confidence"], F.col("detected_at")),
    )
    return out.select("field_name", "conflict_id")


def p7_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same groups with dependent fields kept together: the value with its extractor, what exists with its severity, the place with its own extractor, which must be the value's."""
    from koengine.llm.survivor import survivors

    c = table(spark, sf_dir, "entity_conflict")
    e = F.try_element_at("evidence", F.lit(1))
    c = c.withColumn("property_key", F.regexp_replace(F.lower("property_name"), r"[\s_\-./]+", ""))
    c = c.withColumn("extractor", e["extractor"]).withColumn("place_extractor", e["extractor"]).withColumn("page", e["page"].cast("string")).withColumn("model", e["model"])
    return survivors(
        c, group=("document_id", "koid", "property_key"), key="conflict_id", bundles=(("document_value", "extractor"), ("existing_value", "severity"), ("page", "model", "place_extractor")),
        trust=(e["confidence"], F.col("detected_at")), dependencies=(("extractor", "place_extractor"),),
    ).select("document_id", "koid", "property_key", "field_name", "conflict_id", "value")


def p8_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every document by byte_bpe_50k."""
    from koengine.llm.tokens import encode_corpus

    return encode_corpus(table(spark, sf_dir, "documents"), key="doc_id", text="text")


def _mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    from koengine.llm.mixing import mix_sources, with_sizes

    sized = with_sizes(table(spark, sf_dir, "documents"), key="doc_id", source="source", text="text")
    return mix_sources(sized, table(spark, sf_dir, "mix_target"))


def p9_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mixture: each use of a document, with its slot in the schedule."""
    return _mixture(spark, sf_dir).withColumnRenamed("key", "doc_id")


def p9_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shares reached by the mixture, beside the targets."""
    from koengine.llm.mixing import share_report

    return share_report(_mixture(spark, sf_dir), table(spark, sf_dir, "mix_target"))


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of template residue, filler, error pages or script notices."""
    from koengine.llm.residue import find_residue

    return find_residue(table(spark, sf_dir, "documents"), key="doc_id", text="text", host="collection").select("doc_id")


QUERIES = {
    "p1_found": p1_found,
    "p1_neighbours": p1_neighbours,
    "p2_found": p2_found,
    "p2_groups": p2_groups,
    "p3_found": p3_found,
    "p3_pieces": p3_pieces,
    "p4_found": p4_found,
    "p4_text": p4_text,
    "p6_found": p6_found,
    "p6_redacted": p6_redacted,
    "p7_found": p7_found,
    "p7_records": p7_records,
    "p8_ids": p8_ids,
    "p9_mix": p9_mix,
    "p9_shares": p9_shares,
    "p10_found": p10_found,
}
_DOT = "list_sum(list_transform(list_zip({0}, {1}), lambda z: z[1]::DOUBLE * z[2]::DOUBLE))"
ORACLES: dict[str, str] = {
    "p1_neighbours": f"""
SELECT query_id, id, rank::INTEGER AS rank FROM (
  SELECT a.vec_id AS query_id, b.vec_id AS id, row_number() OVER (PARTITION BY a.vec_id ORDER BY {_DOT.format('a.embedding', 'b.embedding')} / sqrt({_DOT.format('b.embedding', 'b.embedding')}) DESC) AS rank
  FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0) WHERE rank <= 10""",
    "p3_found": """
SELECT DISTINCT a.node_id FROM ast_node a JOIN chunk_profile p ON p.block_type = coalesce(a.block_type, 'Unknown')
WHERE length(a.text) > p.max_chars""",
    "p7_found": r"""
WITH rows AS (
  SELECT DISTINCT document_id, koid, regexp_replace(lower(property_name), '[\s_\-./]+', '', 'g') AS prop, conflict_id,
         evidence[1].confidence AS conf, detected_at, document_value, existing_value, severity
  FROM entity_conflict WHERE document_id IS NOT NULL AND koid IS NOT NULL AND property_name IS NOT NULL
), groups AS (
  SELECT document_id, koid, prop FROM rows GROUP BY ALL HAVING count(DISTINCT conflict_id) >= 2
), vals AS (
  SELECT document_id, koid, prop, conflict_id, conf, detected_at, 'document_value' AS field_name, document_value AS v FROM rows
  UNION ALL SELECT document_id, koid, prop, conflict_id, conf, detected_at, 'existing_value', existing_value FROM rows
  UNION ALL SELECT document_id, koid, prop, conflict_id, conf, detected_at, 'severity', severity FROM rows
), good AS (
  SELECT *, regexp_replace(lower(v), '\s+', '', 'g') AS k FROM vals JOIN groups USING (document_id, koid, prop)
  WHERE v IS NOT NULL
), usable AS (
  SELECT * FROM good WHERE k NOT IN ('', '-', '--', '?', 'n/a', 'k.a.', 'none', 'null', 'tbd', 'unknown', 'notstated')
    AND NOT regexp_matches(k, '(\.\.+|…)$')
), best AS (
  SELECT document_id, koid, prop, field_name, k, min(conflict_id) AS conflict_id, max(struct_pack(c := coalesce(conf, -1), d := detected_at)) AS t
  FROM usable GROUP BY ALL
)
SELECT field_name, conflict_id FROM best
QUALIFY row_number() OVER (PARTITION BY document_id, koid, prop, field_name ORDER BY t DESC, k) = 1""",
}
