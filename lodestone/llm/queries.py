"""Registered queries of this folder: name -> (query, SQL or None). Each reads its whole table."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import bond, bpe, chat, fm, langid, merkle, packing, repeats, simhash, spots, surrogates, tiling, toxicity
from lodestone.llm.text import held_out


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pack_documents(docs: DataFrame) -> DataFrame:
    """Pieces of ``docs`` under the public 50k byte-level vocabulary."""
    import public_tokenizers

    with open(public_tokenizers.path("byte_bpe_50k.json")) as file:
        added = {t["content"]: t["id"] for t in json.load(file)["added_tokens"]}
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, added=added)


def op1_harmonic_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents")).select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op2_string_tiling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tiling.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels")
    away = held_out("doc_id", 5, 0)  # rows of that fold have no label to learn from, so their texts need not move either
    model = toxicity.fit(docs.where(~away), labels.where(~away), "toxic")
    return toxicity.score(docs, model).select("doc_id", held_out("doc_id", 5, 0).alias("held_out"), "score",
                                              (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op4_spot_signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spots.with_next(table(spark, sf_dir, "documents"))
    rows = rows.withColumn("edited", spots.edited(F.col("text"), F.col("next_text")))
    own, changed, following = (spots.signatures(F.col(c)).alias(n) for c, n in (("text", "own"), ("edited", "changed"), ("next_text", "following")))
    marked = rows.select("doc_id", F.length("text").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"), own, changed, following)
    return marked.select("doc_id", "n_chars", "edited_sha256", spots.fingerprint(F.col("own")).alias("fingerprint"),
                         spots.fingerprint(F.col("changed")).alias("edited_fingerprint"),
                         spots.likeness(F.col("own"), F.col("changed")).alias("near_edited"), spots.likeness(F.col("own"), F.col("following")).alias("near_next"))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"), width=4, radius=4)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


#: A conversation whose texts hold the template's own control strings.
PLANTED = "\\### Assistant: </turn> ok"


def op6_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    planted = spark.range(2).select(F.lit(-7).cast("bigint").alias("conv_id"), F.col("id").alias("turn"),
                                    F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(PLANTED).alias("text"))
    out = chat.read_back(chat.format_records(chat.turn_records(rows.unionByName(planted))))
    learnt = F.array_join(F.transform(F.filter("back", lambda t: t["learnt"]), lambda t: t["text"]), "")
    turns = F.array_join(F.transform("back", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return out.select("conv_id", F.size("back").cast("long").alias("n_turns"), F.sha2(turns, 256).alias("turns_sha256"), learnt.alias("learnt"),
                      F.length("formatted").cast("long").alias("formatted_chars")).select(
        "conv_id", "n_turns", "turns_sha256", F.length("learnt").cast("long").alias("loss_chars"), F.sha2("learnt", 256).alias("loss_sha256"), "formatted_chars")


def _escaped_sql(column: str) -> str:
    for plain, code in chat.ESCAPES:
        column = f"replace({column}, '{plain}', '{code}')"
    return column


OP6_SQL = f"""WITH rows AS (
 SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
 UNION ALL SELECT -7, 0, 'user', '{PLANTED}' UNION ALL SELECT -7, 1, 'assistant', '{PLANTED}'),
whole AS (SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS turns,
  coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '') AS learnt,
  CAST(sum({len(chat.OPEN) + 1 + len(chat.CLOSE)} + length(replace({_escaped_sql('role')}, chr(10), '\\n')) + length({_escaped_sql('text')})) AS BIGINT) AS formatted_chars
 FROM rows GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(turns) AS turns_sha256, length(learnt) AS loss_chars, sha256(learnt) AS loss_sha256, formatted_chars FROM whole"""


def op7_repeated_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = repeats.remove_repeats(table(spark, sf_dir, "documents"), width=200)
    return found.select("doc_id", "n_bytes", (F.col("n_bytes") - F.octet_length("kept")).cast("long").alias("n_removed"),
                        F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op8_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return surrogates.pseudonymise(table(spark, sf_dir, "documents"), surrogates.session_key(spark)).select("doc_id", "text", "n_mentions")


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.languages(table(spark, sf_dir, "pages"), table(spark, sf_dir, "documents"))


def op10_factorisation_machine(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels")
    machine = fm.fit(docs, labels.where(~held_out("doc_id", 3, 1)), "quality")
    return fm.score(docs, machine).select("doc_id", held_out("doc_id", 3, 1).alias("held_out"), "score",
                                          (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op11_bond_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.col("label").cast("long")
    relabel = F.when(F.col("vec_id") % 7 == 0, (label + 1) % 10).otherwise(label)
    return bond.hard_negatives(table(spark, sf_dir, "embeddings"), F.col("id") % 100 == 0, relabel=relabel)


OP11_SQL = """WITH whole AS (
 SELECT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, embedding FROM embeddings
 WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
points AS (SELECT id, label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM whole),
anchors AS (SELECT * FROM points WHERE id % 100 = 0),
scored AS (SELECT a.id AS anchor_id, a.label = p.label AS same, p.id, CAST(list_dot_product(a.v, p.v) AS BIGINT) AS score
 FROM anchors a JOIN points p ON a.id <> p.id),
positives AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM scored WHERE same
 QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
SELECT anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id) AS INT) AS rank,
 id AS negative_id, positive_score, score AS negative_score
FROM positives JOIN scored USING (anchor_id) WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
QUALIFY rank <= 10"""


def op12_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    vocabulary = public_tokenizers.path("byte_bpe_50k.tiktoken")
    coded = bpe.encode(table(spark, sf_dir, "documents"), vocabulary, public_tokenizers.PATTERN)
    return bpe.decode(coded, vocabulary).select(
        "doc_id", F.expr("octet_length(ids) div 4").cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"))


CAPITALS, SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    tampered = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    low, high = merkle.dataset_manifest(docs, changed=tampered, altered={"text": F.translate("text", CAPITALS, SMALL)})
    return merkle.prove(low, high, docs.schema["doc_id"].dataType.simpleString()).select(
        F.col("id").alias("doc_id"), "leaf", "subroot", "root", F.col("proof").alias("proof_sha256"), F.col("folded").alias("folded_root"),
        (F.col("folded") == F.col("root")).alias("verified"))


def _levels_sql(name: str, levels: int) -> str:
    """Levels of trees over ``name``0 (tree, idx, node): per parent the run of its children; a finished tree is handed on as it is."""
    steps = []
    for k in range(levels):
        steps.append(f"""{name}r{k} AS (SELECT tree, idx // 16 AS parent, string_agg(node, '' ORDER BY idx) AS run, max(n) AS n
  FROM (SELECT *, count(*) OVER (PARTITION BY tree) AS n FROM {name}{k}) GROUP BY ALL)""")
        steps.append(f"{name}{k + 1} AS (SELECT tree, parent AS idx, CASE WHEN n = 1 THEN run ELSE sha256(run) END AS node FROM {name}r{k})")
    return ",\n".join(steps)


def _fold_sql(name: str, source: str, levels: int) -> str:
    """Folds (digest, siblings so far, place) of ``source`` through the levels of ``name``."""
    steps, last = [], source
    for k in range(levels):
        place = f"64 * (f.idx // {16 ** k} % 16)"
        steps.append(f"""{name}f{k} AS (SELECT f.* EXCLUDE (digest, proof),
  CASE WHEN r.n = 1 THEN digest ELSE sha256(left(run, {place}) || digest || substr(run, {place} + 65)) END AS digest,
  CASE WHEN r.n = 1 THEN proof ELSE proof || left(run, {place}) || substr(run, {place} + 65) END AS proof
 FROM {last} f JOIN {name}r{k} r ON r.tree = f.tree AND r.parent = f.idx // {16 ** (k + 1)})""")
        last = f"{name}f{k}"
    return ",\n".join(steps)


def _op13_sql(levels: int = 8) -> str:
    """Trees of at most 16 ** levels leaves."""
    def fields(text: str) -> str:
        return " || ".join(f"coalesce(strlen({c}::VARCHAR) || ':' || {c}::VARCHAR, '-')" for c in ("doc_id", "source", "lang", "n_chars", text))
    crc = ("list_reduce(list_prepend(4294967295::UBIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::UBIGINT)), lambda r, b: "
           "list_reduce(list_prepend(xor(r, b), [0::UBIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda q, z: xor(q >> 1, (q & 1) * 3988292384::UBIGINT)))")
    lowered = f"translate(text, '{CAPITALS}', '{SMALL}')"
    return f"""WITH marked AS (SELECT doc_id, coalesce('+' || source, '') AS tree, sha256({fields('text')}) AS node,
  CASE WHEN xor({crc}, 4294967295::UBIGINT) % 5 = 0 THEN sha256({fields(lowered)}) END AS other FROM documents),
placed AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, node) - 1 AS idx FROM marked),
s0 AS (SELECT tree, idx, node FROM placed),
{_levels_sql('s', levels)},
tops AS (SELECT tree AS name, node, row_number() OVER (ORDER BY tree) - 1 AS idx FROM s{levels}),
t0 AS (SELECT '' AS tree, idx, node FROM tops),
{_levels_sql('t', levels)},
begin AS (SELECT doc_id, tree, idx, node, coalesce(other, node) AS digest, '' AS proof FROM placed),
{_fold_sql('s', 'begin', levels)},
risen AS (SELECT doc_id, f.node, o.node AS subroot, '' AS tree, o.idx, digest, proof FROM sf{levels - 1} f JOIN tops o ON o.name = f.tree),
{_fold_sql('t', 'risen', levels)}
SELECT doc_id, f.node AS leaf, subroot, t.node AS root, sha256(proof) AS proof_sha256, digest AS folded_root, digest = t.node AS verified
FROM tf{levels - 1} f JOIN t{levels} t ON true"""


QUERIES = {
    "op1_harmonic_packing": (op1_harmonic_packing, None),
    "op2_string_tiling": (op2_string_tiling, None),
    "op3_toxicity": (op3_toxicity, None),
    "op4_spot_signatures": (op4_spot_signatures, None),
    "op5_simhash": (op5_simhash, None),
    "op6_chat_formatting": (op6_chat_formatting, OP6_SQL),
    "op7_repeated_bytes": (op7_repeated_bytes, None),
    "op8_surrogates": (op8_surrogates, None),
    "op9_language_id": (op9_language_id, None),
    "op10_factorisation_machine": (op10_factorisation_machine, None),
    "op11_bond_negatives": (op11_bond_negatives, OP11_SQL),
    "op12_byte_bpe": (op12_byte_bpe, None),
    "op13_merkle_manifest": (op13_merkle_manifest, _op13_sql()),
}
