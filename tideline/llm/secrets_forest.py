"""Secret scans: pattern findings, with false positives removed by a random forest.

Everything here is DataFrame code. Findings are runs of letters, digits and
`_ + / -` inside a text's words: runs of 12 or more in words that hold a digit or
have a run of 20, runs of 8 or more right behind a `:` or `=` in words that name a
secret, and web tokens of three parts as a whole. Shorter runs, and passwords that
stand in a word of their own without a digit, are not looked at. Each finding has
the text before and after it, up to a fixed width. The forest sees a finding's
length, its character classes and transitions, how much of it dictionary words
and common letter pairs cover, whether its word looks like a path or an
address, and whether words beside it speak of secrets. It is trained on labelled
findings: `examples` makes texts that hold a planted secret or a planted look-alike
(digests, identifiers, paths, images, versions, counts), so a label is known from
what was planted, not from any feature. Where no labelled findings are given, the
findings themselves are labelled by `rule`. Dictionary and letter pairs are counted
over all distinct findings that the rule rejects, and all distinct labelled
findings train the forest and set its thresholds; only a caller who gives
`per_label` bounds them.

Defined cases: null text counts as empty and has no findings. A value that
occurs several times in a text is several findings. Rows with a null or a
repeated id are scanned and redacted like others, by their text. Where no label is
positive or none negative, the label rule itself decides.
"""

from __future__ import annotations

import math
import re

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import apart, lowest, materialize

RUN = "[A-Za-z0-9_+/-]"
#: A web token; a run right behind a sign of assignment; any long run.
VALUE = f"eyJ[A-Za-z0-9_-]{{8,}}(?:\\.[A-Za-z0-9_-]{{8,}}){{2}}|(?<=[:=][\"']{{0,1}}){RUN}{{8,}}|{RUN}{{12,}}"
#: A word is looked at if it has a run of 12 with a digit in it, any run of 20, or a run of 8 set after a secret's name.
CANDIDATE = f"(?=\\S*[0-9])\\S*{RUN}{{12,}}|{RUN}{{20,}}|(?i:pass|pwd|secret|token|key|auth)[A-Za-z0-9_-]*[\"']?[:=][\"']?{RUN}{{8,}}"
#: What leads to the next run of a word, the run, and what follows it. \G: a match begins where the last one ended, so a tail is read once.
RUNS = f"(?s)\\G(.*?)({VALUE})(?=(.{{0,256}}))"
#: Characters seen to either side of a run (so a long text without blanks costs no square of its length), and as many runs as those can hold.
SIDE, NEAR = 256, 22
# Names that stand beside secrets, and formats that providers publish.
NAMES = "(?i)(pass|pwd|secret|token|api|key|auth|credential|bearer|private)"
#: From such a name to its value: the rest of the name, no other field between them.
SET = "[^\\s,;&?{}:=]*\\s*[:=]+[\\s\"']*$"
FIELD = "[^,;&?{}]*$"
PROVIDERS = "^(AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36}|xox[abp]-[0-9A-Za-z-]{10,}|sk_live_[0-9A-Za-z]{16,}|AIza[0-9A-Za-z_-]{35})$"
FEATURES = ["length", "digits", "upper", "lower", "hex", "switches", "pairs", "words", "slashes", "dots", "address", "named", "assigned", "quoted"]


def _key() -> Column:
    """What a row is known by: ids may be null or repeated, and rows of one text have the same findings."""
    return F.unhex(F.md5("text"))


def findings(docs: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """(id, text_key, at, run, word, before, prefix, value): each run of a candidate word; word is what is seen of it, before the two words before it, prefix the text from its seen start to the run."""
    words = docs.select(id_column, _key().alias("text_key"), F.split(F.coalesce("text", F.lit("")), r"\s+").alias("w"))
    near = F.filter(
        F.transform("w", lambda x, i: F.when(x.rlike(CANDIDATE), F.struct(i.alias("at"), x.alias("word"), F.concat_ws(" ", F.get("w", i - 2), F.get("w", i - 1)).alias("before")))),
        lambda s: s.isNotNull(),
    )
    out = words.select(id_column, "text_key", F.explode(near).alias("f")).select(id_column, "text_key", "f.at", "f.word", "f.before")
    lead, value, tail = (F.regexp_extract_all("word", F.lit(RUNS), F.lit(g)) for g in (1, 2, 3))
    out = out.select(id_column, "text_key", "at", "before", F.arrays_zip(lead.alias("lead"), value.alias("value"), tail.alias("tail")).alias("runs"))

    def seen(r: Column, i: Column) -> Column:
        earlier = F.slice("runs", F.greatest(i - NEAR + 1, F.lit(1)), F.least(i, F.lit(NEAR)))
        prefix = F.right(F.concat(F.array_join(F.transform(earlier, lambda e: F.concat(e["lead"], e["value"])), ""), r["lead"]), F.lit(SIDE))
        return F.struct(i.alias("run"), r["value"].alias("value"), prefix.alias("prefix"), r["tail"].alias("tail"))

    each = out.select(id_column, "text_key", "at", "before", F.explode(F.transform("runs", seen)).alias("r")).select(id_column, "text_key", "at", "before", "r.run", "r.value", "r.prefix", "r.tail")
    return each.select(id_column, "text_key", "at", "run", F.concat("prefix", "value", "tail").alias("word"), "before", "prefix", "value")


def _share(pattern: str, of: str = "value") -> Column:
    return F.regexp_count(F.col(of), F.lit(pattern)) / F.length(of)


def featured(found: DataFrame, words: list[str], pairs: list[str]) -> DataFrame:
    low, prefix = F.lower("value"), F.col("prefix")
    covered = F.lit(0.0) if not words else 1 - F.length(F.regexp_replace(low, "|".join(map(re.escape, words)), "")) / F.length("value")
    common = F.lit(0.0) if not pairs else F.regexp_count(low, F.lit("(?=" + "|".join(map(re.escape, pairs)) + ")")) / F.length("value")
    return found.withColumns({
        "length": F.length("value").cast("double"),
        "digits": _share("[0-9]"),
        "upper": _share("[A-Z]"),
        "lower": _share("[a-z]"),
        "hex": _share("[0-9a-f]"),
        "switches": (F.regexp_count("value", F.lit("[0-9]+")) + F.regexp_count("value", F.lit("[A-Z]+")) + F.regexp_count("value", F.lit("[a-z]+")) - 1) / F.length("value"),
        "pairs": common.cast("double"),
        "words": covered.cast("double"),
        "slashes": F.regexp_count("word", F.lit(r"[/\\]")).cast("double"),
        "dots": F.regexp_count("word", F.lit(r"\.")).cast("double"),
        "address": F.col("word").rlike("@|://").cast("double"),
        "named": (F.col("before").rlike(NAMES) | F.regexp_extract("prefix", FIELD, 0).rlike(NAMES)).cast("double"),
        "assigned": F.concat_ws(" ", "before", prefix).rlike("[:=][\\s\"']*$").cast("double"),
        "quoted": prefix.rlike("[\"']$").cast("double"),
    })


def rule(found: DataFrame) -> Column:
    """The label of a finding without one: provider formats, or digits and letters set after a secret's name."""
    said = F.concat_ws(" ", "before", "prefix")
    mixed = F.col("value").rlike("[0-9]") & F.col("value").rlike("[A-Za-z]")
    return F.col("value").rlike(PROVIDERS) | (said.rlike(NAMES + SET) & mixed)


def examples(spark: SparkSession, n: int = 6000) -> DataFrame:
    """Labelled findings: n texts of one planted string each, among invented words; label is true where a secret was planted."""
    at = lambda tag: F.sha2(F.concat(F.lit(tag), F.col("id").cast("string")), 512)
    mixed = lambda tag: F.regexp_replace(F.base64(F.unhex(at(tag))), "[^A-Za-z0-9]", "")
    size = lambda low, high: (F.lit(low) + F.pmod(F.xxhash64("id", F.lit(low)), F.lit(high - low + 1))).cast("int")
    hexed, digits = at("h"), F.regexp_replace(at("d"), "[a-f]", "")
    letters = lambda tag: F.translate(at(tag), "0123456789abcdef", "aeioutnrslhdcmpg")
    uuid = F.concat_ws("-", *(F.substr(hexed, F.lit(a), F.lit(k)) for a, k in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))))
    part = lambda tag, low, high: F.substr(mixed(tag), F.lit(1), size(low, high))
    web = F.concat(F.lit("eyJ"), part("j", 20, 30), F.lit(".eyJ"), part("k", 30, 60), F.lit("."), part("l", 30, 43))
    slug = F.concat_ws("-", F.substr(letters("s"), F.lit(1), size(4, 8)), F.substr(letters("t"), F.lit(1), size(5, 9)), F.substr(digits, F.lit(1), F.lit(4)))
    path = F.concat(F.lit("/"), F.concat_ws("/", *(F.substr(letters(x), F.lit(1), size(3, 7)) for x in "uvwx")), F.lit("_1"))
    cut = lambda value, low, high: F.substr(value, F.lit(1), size(low, high))
    # the value that each kind of text holds, the text before it and after it, and whether it is a secret
    kinds = [
        (True, cut(hexed, 24, 64), ['token = "', "secret=", "api_key: ", "AUTH_TOKEN=", '"client_secret": "'], '"'), (True, part("a", 20, 44), ["access_token=", 'password: "', "PRIVATE_KEY=", "?api_key=", "Authorization: Bearer "], ""),
        (True, F.concat(F.lit("AKIA"), F.upper(part("b", 16, 16))), ["", "id ", '"key":"', "uses "], ""), (True, F.concat(F.lit("ghp_"), part("c", 36, 36)), ["", "token ", "push with "], ""),
        (True, F.concat(F.lit("sk_live_"), part("e", 20, 30)), ["", "pay by ", "key="], ""), (True, web, ["", "Bearer ", "token=", "jwt: "], ""), (True, part("f", 9, 14), ["password=", "db_pass: '", "pwd=", "secret_key="], "'"),
        (True, cut(hexed, 16, 24), ["password=", "passwd: ", "token:"], ""), (False, cut(hexed, 32, 64), ["commit ", "sha256:", "md5 = ", 'etag: "', "checksum=", "digest ", "revision "], ""),
        (False, uuid, ["id=", "uuid ", 'request: "', "session of ", "urn:uuid:"], ""), (False, cut(digits, 13, 20), ["", "order ", "reference_number=", "isbn ", "account ", "call "], ""), (False, part("g", 16, 40), ["order_reference_number=", "tracking_code=", "parcel:", "image;base64,", "cache_id="], ""),
        (False, slug, ["https://example.org/", "see ", "package ", "release="], ".html"), (False, path, ["", "/usr/lib", "from ", "file=", "keys in "], ".py"), (False, cut(letters("y"), 20, 34), ["", "word ", "the ", "name="], ""),
        (False, F.concat(F.substr(letters("z"), F.lit(1), F.lit(9)), F.lit("_v"), cut(digits, 3, 8)), ["", "module ", "version=", "model:", "monkey:"], ""),
    ]
    texts = spark.range(n)
    chosen = F.array(*(F.struct(F.lit(label).alias("secret"), value.alias("planted"), F.element_at(F.array(*map(F.lit, lead)), (F.pmod(F.xxhash64("id", F.lit("lead")), F.lit(len(lead))) + 1).cast("int")).alias("lead"), F.lit(tail).alias("tail")) for label, value, lead, tail in kinds))
    texts = texts.select("id", F.element_at(chosen, (F.pmod("id", F.lit(len(kinds))) + 1).cast("int")).alias("p")).select("id", "p.*")
    word = lambda tag: F.substr(letters(tag), F.lit(1), size(2, 7))
    around = texts.withColumn("text", F.concat(word("1"), F.lit(" "), word("2"), F.lit(" "), F.col("lead"), F.col("planted"), F.col("tail"), F.lit(" "), word("3")))
    found = findings(around.select("id", "text"), "id").join(around.select("id", "planted", "secret"), "id")
    return found.withColumn("label", F.col("secret") & F.col("planted").contains(F.col("value"))).drop("planted", "secret")


def fit(found: DataFrame, per_label: int | None = None, dictionary: int = 120, trees: int = 20, depth: int = 6, seed: int = 5, labelled: DataFrame | None = None) -> tuple[PipelineModel | None, list[str], list[str]]:
    """The forest, dictionary and letter pairs, from all distinct findings; with per_label from at most so many of each label, those with the least hashes."""
    seen = ["value", "before", "word", "prefix"]
    ruled = found if "label" in found.columns else found.withColumn("label", rule(found))

    def taken(rows: DataFrame, tag: str) -> DataFrame:
        marked = rows.select(*seen, "label", F.xxhash64(*seen).alias("mark")).where(F.col("label").isNotNull())
        return materialize(marked.distinct() if per_label is None else lowest(marked, "label", "mark", per_label), tag)

    own = taken(ruled, "own_findings")
    learnt = own if labelled is None else taken(labelled, "labelled")
    present = {r["label"]: r["count"] for r in learnt.groupBy("label").count().collect()}
    beside = own.where(~F.col("label")).select(F.explode(F.split(F.lower(F.regexp_replace("before", r"[^\p{L} ]", "")), " ")).alias("w")).where("length(w) > 1").groupBy("w").agg(F.count("*").alias("n"))
    words = [r["w"] for r in beside.orderBy(F.desc("n"), "w").limit(dictionary).collect()]
    two = beside.select("n", F.explode(F.transform(F.sequence(F.lit(1), F.length("w") - 1), lambda i: F.substring(F.col("w"), i, F.lit(2)))).alias("p"))
    pairs = [r["p"] for r in two.groupBy("p").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "p").limit(60).collect()]
    if present.keys() != {True, False}:
        return None, words, pairs
    words.sort(key=lambda w: (-len(w), w))
    n = sum(present.values())
    # Spark looks for thresholds in maxBins ** 2 rows, 10000 at least: so many bins that these are all rows
    bins = 32 if n <= 10_000 else math.isqrt(n) + 1
    forest = RandomForestClassifier(featuresCol="features", labelCol="target", numTrees=trees, maxDepth=depth, maxBins=bins, seed=seed)
    rows = featured(learnt, words, pairs).select(*FEATURES, F.col("label").cast("double").alias("target"), "mark", "value")
    dealt = rows.repartition(1 + n // 10_000, "mark").sortWithinPartitions("mark", "value", "target")  # trees draw rows by task and place
    return Pipeline(stages=[VectorAssembler(inputCols=FEATURES, outputCol="features"), forest]).fit(dealt), words, pairs


def judged(found: DataFrame, model: PipelineModel | None, words: list[str], pairs: list[str]) -> DataFrame:
    """found with probability of being a secret."""
    if model is None:
        return found.withColumn("probability", rule(found).cast("double"))
    out = model.transform(featured(found, words, pairs))
    return out.withColumn("probability", vector_to_array("probability")[1]).select(*found.columns, "probability")


def secrets(found: DataFrame, least: float = 0.5, **settings) -> DataFrame:
    """The findings that the forest accepts; found is best read from storage, as it is read twice."""
    model, words, pairs = fit(found, **settings)
    return judged(found, model, words, pairs).where(F.col("probability") >= least)


def redact(docs: DataFrame, accepted: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """docs with each accepted value replaced in the texts it was found in, whatever their ids; longer values first."""
    values = accepted.groupBy("text_key").agg(F.array_sort(F.collect_set(F.struct((-F.length("value")).alias("n"), "value"))).alias("found_values"))
    own, back = apart(docs, "text")
    joined = own.withColumn("text_key", _key()).join(values, "text_key", "left")
    clean = F.aggregate(F.coalesce("found_values", F.expr("cast(array() as array<struct<n:int,value:string>>)")), F.col("text"), lambda text, v: F.replace(text, v["value"], F.lit(mark)))
    return joined.withColumn("text", clean).select(*back)
