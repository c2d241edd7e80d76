"""Each stage on what the one before it kept, against plain computations."""

import re

import corpus_pipeline
from pyspark.sql import functions as F
from tideline.llm.common import materialize

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, before = docs.columns, docs.toPandas()
    steps = dict(corpus_pipeline.STAGES)
    one = materialize(steps["language ID"](spark, docs, SF), "t1")
    got = one.toPandas()
    letters = before[before["text"].map(lambda t: bool(re.search(r"[^\W\d_]", t or "")))]
    assert list(one.columns) == columns and set(got["doc_id"]) <= set(letters["doc_id"]) and len(got) >= 0.97 * len(letters)
    two = materialize(steps["near-dedup"](spark, one, SF), "t2")
    kept = two.toPandas()
    assert list(two.columns) == columns and kept["text"].is_unique and set(kept["doc_id"]) <= set(got["doc_id"])
    firsts = got.sort_values("doc_id").drop_duplicates("text")
    assert set(kept["doc_id"]) <= set(firsts["doc_id"])
    three = materialize(steps["suffix-array dedup"](spark, two, SF), "t3")
    cut = three.toPandas()
    seen: dict[bytes, int] = {}
    for t in cut["text"]:
        assert t is not None
    assert len(cut) == len(kept) and (cut["n_chars"] == cut["text"].str.len()).all()
    for t in kept["text"]:
        b = t.encode()
        for i in range(len(b) - 399):
            seen[b[i : i + 400]] = seen.get(b[i : i + 400], 0) + 1
    runs: dict[tuple, int] = {}
    words_of = lambda t: re.findall(r"[^\x20\x09-\x0d]+", t.lower())
    fifty = lambda t: [tuple(w[i : i + 50]) for w in [words_of(t)] for i in range(len(w) - 49)]
    for t in kept["text"]:
        for r in fifty(t):
            runs[r] = runs.get(r, 0) + 1
    assert not any(runs.get(r, 0) > 1 for t in cut["text"] for r in fifty(t))
    whole = kept[kept["text"].map(lambda t: all(runs[r] == 1 for r in fifty(t)) and all(seen[t.encode()[i : i + 400]] == 1 for i in range(max(0, len(t.encode()) - 399))))]
    assert set(whole["text"]) <= set(cut["text"])
    four = materialize(steps["secret scan"](spark, three, SF), "t4")
    clean = four.toPandas()
    assert list(four.columns) == columns and len(clean) == len(cut)
    assert not clean["text"].str.contains(r'token = "[0-9a-f]{40}|AKIA[0-9A-Z]{16}|password=[0-9a-f]{18}').any()
    packed = steps["packing"](spark, four, SF).toPandas()
    assert set(packed["doc_id"]) == set(clean["doc_id"]) and packed.groupby("sequence_id")["length"].sum().max() <= 2048


def test_stages_keep_columns_of_any_name(spark):
    """Names that stages use themselves, null ids and texts, no n_chars, and empty tables."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("doc_id < 60").drop("n_chars").withColumn("score", F.lit(7.0)).withColumn("text_key", F.lit("a")).withColumn("ck", F.lit(1)).withColumn("lang_pred", F.lit("x"))
    odd = spark.createDataFrame([(None, "words of a text without any number in it"), (1000, None), (1001, "")], "doc_id long, text string")
    docs = materialize(docs.unionByName(odd, allowMissingColumns=True), "odd")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        rows = stage(spark, docs, SF)
        got = rows.toPandas()
        assert rows.columns == docs.columns and len(got) > 20 and set(got["score"].dropna()) == {7.0} and set(got["ck"].dropna()) == {1.0} and set(got["lang_pred"].dropna()) == {"x"}
        assert stage(spark, docs.limit(0), SF).count() == 0
