"""The registered queries of this folder: each applies its operator to whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bagminhash, bpe, chat_hmm, langid_cnn, merkle, packing, periodic, pst, secrets_forest, set_join, suffix_dedup, vptree, winnow
from .common import materialize, mod_of_id, partitions, table


def byte_bpe() -> str:
    """The public byte-level vocabulary; every operator takes its path as a parameter."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_suffix_tree_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pst.score(table(spark, sf_dir, "documents"), mod_of_id("doc_id", 10) != 0)


def op2_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bagminhash.classes(table(spark, sf_dir, "documents").select("doc_id", "text"), least=0.8, size=5)


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), byte_bpe(), window=2048, end_id=1)


def op4_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return winnow.compare_neighbours(docs, max(8, partitions(spark), docs.rdd.getNumPartitions()))  # ranges grow with the files read


def op5_chat_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations become raw logs; roles are learned on four fifths of them and recovered in all."""
    own = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    log = chat_hmm.as_log(own)
    model = chat_hmm.fit(log.where(mod_of_id("conv_id", 5) != 0))
    return chat_hmm.rendered(chat_hmm.recover(log, model)).select("conv_id", "turn", "part", "role", "rendered")


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = materialize(secrets_forest.findings(table(spark, sf_dir, "documents")), "findings")
    kept = secrets_forest.secrets(found, labelled=materialize(secrets_forest.examples(spark), "examples"))
    return kept.select("doc_id", F.col("at").alias("word_index"), F.length("value").alias("length"), F.sha2("value", 256).alias("value_sha256"), "probability")


def op7_nearest_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return vptree.nearest(rows, rows.where(F.col("vec_id") % 20 == 0), k=20, factor=1.0)


def op8_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf_dir, "documents"), byte_bpe())


def op9_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of repeated 400-byte strings; beside them the words in repeated runs of 50 words, which may be shorter than 400 bytes."""
    return suffix_dedup.repeats(table(spark, sf_dir, "documents"), length=400, words=50)


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = mod_of_id("doc_id", 5) == 0
    net = langid_cnn.fit(docs, ~held_out)
    return langid_cnn.identify(docs.select("doc_id", held_out.alias("held_out"), "text"), net).drop("text")


def op11_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return set_join.linked(table(spark, sf_dir, "documents"), percent=80, size=5)


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.manifest(table(spark, sf_dir, "documents"), fanout=2, tampered=7).drop("path")


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic.summary(periodic.runs(table(spark, sf_dir, "documents"), loops=True))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_suffix_tree_scores": op1_suffix_tree_scores,
    "op2_near_duplicates": op2_near_duplicates,
    "op3_packing": op3_packing,
    "op4_fingerprints": op4_fingerprints,
    "op5_chat_turns": op5_chat_turns,
    "op6_secrets": op6_secrets,
    "op7_nearest_vectors": op7_nearest_vectors,
    "op8_bpe_round_trip": op8_bpe_round_trip,
    "op9_repeated_passages": op9_repeated_passages,
    "op10_language_id": op10_language_id,
    "op11_ngram_jaccard": op11_ngram_jaccard,
    "op12_merkle_manifest": op12_merkle_manifest,
    "op13_periodic_runs": op13_periodic_runs,
}


def _field(x: str) -> str:
    return f"coalesce(strlen({x}) || ':' || {x}, '-')"


_LEAF = [_field(f) for f in ("CAST(doc_id AS VARCHAR)", "source", "lang", "CAST(n_chars AS VARCHAR)", "text")]
_MORE = [*_LEAF[:3], _field("CAST(n_chars + 1 AS VARCHAR)"), _LEAF[4]]
#: crc32 of decimal ids by its table of 256 steps, made from the polynomial; then levels, siblings and the folding of each row, level by level.
MERKLE = f"""WITH RECURSIVE bits AS (SELECT i, 0 AS k, i AS c FROM range(256) t(i) UNION ALL SELECT i, k + 1, xor(c >> 1, CASE WHEN c % 2 = 1 THEN 3988292384 ELSE 0 END) FROM bits WHERE k < 8),
 steps AS (SELECT list(c ORDER BY i) AS step FROM bits WHERE k = 8),
 own AS (SELECT doc_id, lang, sha256({' || '.join(_LEAF)}) AS leaf, CASE WHEN n_chars IS NOT NULL AND xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(coalesce(CAST(doc_id AS VARCHAR), ''), ''), lambda x: CAST(coalesce(unicode(x), 0) AS BIGINT))), lambda c, b: xor(c >> 8, step[CAST(xor(c, b) % 256 AS INT) + 1])), 4294967295) % 7 = 0
  THEN sha256({' || '.join(_MORE)}) END AS altered FROM documents, steps),
 leaves AS (SELECT *, coalesce('=' || lang, '-') AS tree, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place, count(*) OVER (PARTITION BY lang) AS n FROM own),
 nodes AS (SELECT tree, 0 AS level, place, n, leaf AS digest FROM leaves UNION ALL SELECT tree, level + 1, place // 2, (max(n) + 1) // 2, sha256(string_agg(digest, '' ORDER BY place)) FROM nodes WHERE n > 1 GROUP BY tree, level, place // 2),
 upper AS (SELECT tree, level, digest AS subroot, row_number() OVER (ORDER BY tree) - 1 AS place, count(*) OVER () AS n FROM nodes WHERE n = 1),
 roots AS (SELECT 0 AS level, place, n, subroot AS digest FROM upper UNION ALL SELECT level + 1, place // 2, (max(n) + 1) // 2, sha256(string_agg(digest, '' ORDER BY place)) FROM roots WHERE n > 1 GROUP BY level, place // 2),
 spot AS (SELECT l.*, row_number() OVER () AS k, u.subroot, u.level AS height, u.place AS upper_place FROM leaves l JOIN upper u USING (tree)),
 steps_up AS (SELECT k, level, (a.place >> level) % 2 AS behind, s.digest FROM spot a JOIN nodes m ON m.tree = a.tree AND m.n > 1 AND m.place = a.place >> m.level LEFT JOIN (SELECT tree, level AS slevel, place AS splace, digest FROM nodes) s ON s.tree = a.tree AND s.slevel = m.level AND s.splace = xor(a.place >> m.level, 1)
  UNION ALL SELECT k, height + m.level, (a.upper_place >> m.level) % 2, s.digest FROM spot a JOIN roots m ON m.n > 1 AND m.place = a.upper_place >> m.level LEFT JOIN (SELECT level AS slevel, place AS splace, digest FROM roots) s ON s.slevel = m.level AND s.splace = xor(a.upper_place >> m.level, 1)),
 proofs AS (SELECT k, sha256(coalesce(string_agg(digest, '' ORDER BY level), '')) AS proof_sha256 FROM steps_up GROUP BY k),
 fold AS (SELECT k, 0 AS level, coalesce(altered, leaf) AS now FROM spot UNION ALL SELECT f.k, f.level + 1, sha256(CASE WHEN s.behind = 1 THEN coalesce(s.digest, '') || f.now ELSE f.now || coalesce(s.digest, '') END) FROM fold f JOIN steps_up s ON s.k = f.k AND s.level = f.level),
 ends AS (SELECT k, arg_max(now, level) AS folded_root FROM fold GROUP BY k)
SELECT doc_id, leaf, subroot, root, coalesce(proof_sha256, sha256('')) AS proof_sha256, folded_root, folded_root = root AS verified FROM spot LEFT JOIN proofs USING (k) JOIN ends USING (k), (SELECT digest AS root FROM roots WHERE n = 1)"""

#: Sets of shingles, all pairs that share one, components as the least id reached.
JACCARD = r"""WITH RECURSIVE own AS (SELECT row_number() OVER () AS k, doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents),
 sets AS (SELECT DISTINCT k, unnest(CASE WHEN len(w) BETWEEN 1 AND 4 THEN [hash(w)] ELSE list_transform(range(1, len(w) - 3), lambda i: hash(w[i:i + 4])) END) AS s FROM own),
 n AS (SELECT k, doc_id, coalesce(size, 0) AS size FROM own LEFT JOIN (SELECT k, count(*) AS size FROM sets GROUP BY 1) USING (k)),
 pairs AS (SELECT a.k, b.k AS other, count(*) AS common FROM sets a JOIN sets b ON a.s = b.s AND a.k <> b.k GROUP BY 1, 2),
 links AS (SELECT p.k, other FROM pairs p JOIN n a ON a.k = p.k JOIN n b ON b.k = other WHERE 100 * common >= 80 * (a.size + b.size - common)),
 reach AS (SELECT k, k AS other FROM n UNION SELECT r.k, l.other FROM reach r JOIN links l ON l.k = r.other)
SELECT n.doc_id, n.size AS n_shingles, least(n.doc_id, min(o.doc_id)) AS component_id FROM n JOIN reach r ON r.k = n.k JOIN n o ON o.k = r.other GROUP BY n.k, n.doc_id, n.size"""

ORACLE_SQL: dict[str, str] = {"op11_ngram_jaccard": JACCARD, "op12_merkle_manifest": MERKLE}
