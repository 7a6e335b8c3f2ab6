"""Secret scan: pattern candidates, false positives removed by a random forest.

Candidates are long runs of the characters that keys and tokens are made of,
shorter values given to telling names, private keys and passwords of
connection strings. A forest decides which are secrets, from their length, the changes of character
class, how much of them common words of the corpus cover, the document's path
and the words next to them. It is trained from labelled findings.

Everything is column functions and the DataFrame learner of Spark; no Python
code runs on the data. Candidates are exploded as narrow rows, texts are not.
"""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomdex.session import materialize, scratch_dir

# Shapes of candidates, names that announce a secret, paths where made-up ones are usual.
CHARS = "[A-Za-z0-9+/_=-]"
SHORTEST = 16
NAMES = "token|secret|passw|pwd|api|auth|bearer|credential|private|key"
#: Right before a value: an assignment to a telling name; shorter values are candidates only there.
GIVEN = f"(?i:{NAMES})[A-Za-z0-9_-]{{0,16}}[\"'`]?\\s{{0,2}}:?[=:]\\s{{0,2}}"
SHORTER = 6
KEY_BODY = r"[A-Za-z0-9+/=\s:,\\-]"
#: What a candidate is: the password of a connection string, the body of a private key, a value given to a telling name, a long run.
SPOTS = "|".join([
    rf"://[^\s:/@]{{1,64}}:{CHARS}{{{SHORTER},}}(?=@)",
    rf"-----BEGIN [A-Z ]{{0,24}}PRIVATE KEY-----\s*{KEY_BODY}{{{SHORTEST},16384}}?(?=[\s\\n]*-----END)",
    rf":?[=:]\s{{0,2}}[\"'`](?<={GIVEN}[\"'`])[^\"'`\s]{{{SHORTER},256}}(?=[\"'`])",
    rf":?[=:]\s{{0,2}}(?<={GIVEN})(?!=|(?i:bearer|basic|token|digest)\s){CHARS}{{{SHORTER},}}",
    rf"{CHARS}{{{SHORTEST},}}",
])
#: Beginnings of the tokens that providers give out; words after which a hash is no secret.
ISSUED = (r"^(gh[pousr]_[A-Za-z0-9]{20,}|github_pat_[A-Za-z0-9_]{20,}|glpat-[A-Za-z0-9_-]{16,}|xox[abeoprs]-[A-Za-z0-9-]{10,}|[sr]k_(live|test)_[A-Za-z0-9]{16,}"
          r"|sk-[A-Za-z0-9_-]{20,}|(AKIA|ASIA)[A-Z0-9]{16}$|AIza[A-Za-z0-9_-]{30,}|npm_[A-Za-z0-9]{30,}|hf_[A-Za-z0-9]{30,}|pypi-[A-Za-z0-9_-]{30,})")
HASHES = r"(?i)\b(commit|revision|rev|checksum|digest|hash|md5|sha-?[0-9]+|integrity|etag|uuid)\b[^\n]{0,4}$"
MADE_UP = "test|example|sample|mock|fixture|doc"

#: Labelled findings of each class that train the forest; share of all documents that show a word of the dictionary.
SAMPLE, DICTIONARY_SHARE = 5000, 0.001
TREES, DEPTH, SEED = 20, 6, 7
#: Characters before and after a candidate that count as next to it.
BEFORE, AFTER = 48, 16
#: Words of a value, cut at changes of case as well.
VALUE_WORD = "[A-Z]?[a-z]{2,}|[A-Z]{3,}"

FEATURES = [
    "length", "transitions", "kinds", "digits", "capitals", "vowels", "variety", "hex", "coverage", "depth", "made_up", "named",
    "assigned", "quoted", "closed", "given", "issued", "headed", "locked", "hash",
]


def candidates(docs: DataFrame, key: list[str], path: Column) -> DataFrame:
    """(key, path, nth, value, before, after): all candidates of ``SPOTS``, in order, with what stands around them.

    The text is cut into pieces that end with a candidate each, so the rest of a
    piece, and the piece after it, are the surroundings. A run that begins with
    an assignment to a telling name is cut behind it.
    """
    piece = f"\\G(?s).*?(?:{SPOTS})"  # from where the last one ended, so the rest of a text is read once
    text = F.col("text").cast("string")
    rows = docs.where(text.rlike(SPOTS)).select(*key, path.alias("path"), text.alias("_text"))
    rows = rows.withColumn("_pieces", F.regexp_extract_all("_text", F.lit(piece), F.lit(0)))
    read = F.aggregate("_pieces", F.lit(0), lambda n, p: n + F.length(p))
    rest = F.substr("_text", read + 1, F.lit(AFTER))
    spots = F.transform("_pieces", lambda p, i: F.struct(
        i.alias("nth"), p.alias("_piece"),
        F.coalesce(F.substr(F.get("_pieces", i + 1), F.lit(1), F.lit(AFTER)), rest).alias("after")))
    rows = rows.select(*key, "path", F.inline(spots))

    def tail(n: int, pattern: str) -> Column:
        return F.nullif(F.regexp_extract(F.right("_piece", F.lit(n)), pattern, 1), F.lit(""))

    run = F.regexp_extract("_piece", f"({CHARS}+)$", 1)
    cut = F.nullif(F.regexp_extract(run, f"(?i:{NAMES})[A-Za-z0-9_-]{{0,16}}=([^=].{{{SHORTER - 1},}})$", 1), F.lit(""))
    value = F.coalesce(
        tail(17000, rf"PRIVATE KEY-----\s*({KEY_BODY}{{{SHORTEST},}})$"), tail(340, f"{GIVEN}[\"'`]([^\"'`\\s]{{{SHORTER},}})$"), cut, run)
    rows = rows.withColumn("value", value).withColumn("_gap", F.length("_piece") - F.length("value"))
    before = F.substr("_piece", F.greatest(F.lit(1), F.col("_gap") - BEFORE + 1), F.least(F.col("_gap"), F.lit(BEFORE)))
    return rows.select(*key, "path", "nth", "value", before.alias("before"), "after")


def dictionary(docs: DataFrame, share: float = DICTIONARY_SHARE) -> DataFrame:
    """``word``: those of three ASCII letters or more that at least ``share`` of all documents with a text show, two at least.

    Counted over every document; counts are combined before the shuffle. The
    words stay a table, however many they are.
    """
    texts = docs.where("text is not null").select(F.lower(F.col("text").cast("string")).alias("text"))
    words = texts.select(F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit("[a-z]{3,}"), F.lit(0)))).alias("word"))
    least = max(2.0, share * texts.count())
    return materialize(words.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least).select("word"), "dictionary")


def described(found: DataFrame, common: DataFrame) -> DataFrame:
    """Candidates with the features, stored: their words are met with the dictionary ``common``, and covered letters summed back."""
    found = materialize(found.withColumn("_row", F.monotonically_increasing_id()), "candidates")
    words = found.select("_row", F.explode(F.regexp_extract_all("value", F.lit(VALUE_WORD), F.lit(0))).alias("_word"))
    met = words.select("_row", F.lower("_word").alias("word")).join(common, "word")
    letters = met.groupBy("_row").agg(F.sum(F.length("word")).alias("_covered"))
    rows = found.join(letters, "_row", "left")
    value, length = F.col("value"), F.length("value").cast("double")
    lower = F.lower(value)
    small, large, digits = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
    kinds = F.translate(value, small + large + digits, "a" * 26 + "B" * 26 + "0" * 10)
    runs = F.length(F.regexp_replace(kinds, "(.)\\1+", "$1")).cast("double")

    def share(p: str) -> Column:
        return F.regexp_count(value, F.lit(p)) / length

    def flag(c: Column) -> Column:
        return F.coalesce(c, F.lit(False)).cast("double")

    rows = rows.withColumns({
        "length": length, "transitions": (runs - 1) / length,
        "kinds": F.size(F.array_distinct(F.split(kinds, ""))).cast("double"),
        "digits": share("[0-9]"), "capitals": share("[A-Z]"), "vowels": share("(?i)[aeiou][^aeiou0-9]"),
        "variety": F.size(F.array_distinct(F.split(value, ""))) / length,
        "hex": flag(lower.rlike("^[0-9a-f]+$")),
        "coverage": F.coalesce("_covered", F.lit(0)) / length,
        "depth": F.coalesce(F.regexp_count("path", F.lit("/")), F.lit(0)).cast("double"),
        "made_up": flag(F.lower("path").rlike(MADE_UP)),
        "named": flag(F.lower("before").rlike(f"({NAMES})[^\\n]{{0,16}}$")),
        "assigned": flag(F.col("before").rlike("[=:]\\s*[\"'`]?$")),
        "quoted": flag(F.col("before").rlike("[\"'`]$")),
        "given": flag(F.col("before").rlike(f"{GIVEN}[\"'`]?$")),
        "issued": flag(value.rlike(ISSUED)),
        "headed": flag(F.col("before").rlike(r"(?i)\b(bearer|authorization:\s*(basic|token))\s+$")),
        "locked": flag(F.col("before").rlike(r"PRIVATE KEY-----\s*$") | (F.col("before").rlike(r"://[^\s:/@]+:$") & F.col("after").startswith("@"))),
        "hash": flag(F.col("before").rlike(HASHES)),
        "closed": flag(F.col("after").rlike("^[\"'`;,\\s]") | (F.col("after") == "")),
    })
    return materialize(rows.drop("_row", "_covered"), "described")


def assembled(rows: DataFrame) -> DataFrame:
    return VectorAssembler(inputCols=FEATURES, outputCol="features").transform(rows)


def train(findings: DataFrame, rows: int = SAMPLE, trees: int = TREES, depth: int = DEPTH, seed: int = SEED) -> RandomForestClassificationModel | None:
    """A forest from described findings with ``label`` 0 or 1: those of the smallest md5 of value and surroundings.

    At most ``rows`` of each class, in one fixed order, so reruns agree; each
    distinct finding counts once. None unless there are both classes.
    """
    place = ["value", "before", "after", "depth", "made_up"]
    distinct = findings.where("label in (0, 1)").withColumn("label", F.col("label").cast("double")).dropDuplicates([*place, "label"])
    order = [F.md5(F.concat_ws("|", *place)), *place]
    drawn = [distinct.where(F.col("label") == c).orderBy(*order).limit(rows) for c in (0.0, 1.0)]
    taught = materialize(assembled(drawn[0].union(drawn[1])).select("features", "label").coalesce(1), "taught")
    if {r.label for r in taught.select("label").distinct().collect()} != {0.0, 1.0}:
        return None
    forest = RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=seed, featuresCol="features", labelCol="label")
    # read back without the summary of its training, which holds the session and cannot go to tasks
    path = f"{scratch_dir(findings.sparkSession)}/forest"
    forest.fit(taught).write().save(path)
    return RandomForestClassificationModel.load(path)


def plain_labels(described_rows: DataFrame) -> DataFrame:
    """``label`` for findings whose nature is plain, null for the rest; stands in where no one has labelled findings.

    1: ``proven``. 0: letters of one kind only, bare numbers, runs that common
    words cover by half, and hashes after a word that says so. A candidate that
    is neither, assigned or not, teaches nothing.
    """
    plain = F.col("value").rlike("^([A-Za-z][a-z]*|[A-Z]+|[0-9]+|[^A-Za-z0-9]+)$") | (F.col("coverage") >= 0.5) | (F.col("hash") == 1)
    return described_rows.withColumn("label", F.when(certain(), 1).when(plain, 0).when(proven(), 1))


def mixed() -> Column:
    return (F.col("transitions") >= 0.2) & (F.col("digits") > 0.1)


def certain() -> Column:
    """The shape of a provider's token, the body of a private key, a connection's password, or mixed characters in a header."""
    return (F.col("issued") == 1) | (F.col("locked") == 1) | ((F.col("headed") == 1) & mixed())


def proven() -> Column:
    """Certain, or given to a telling name, in quotes or not, and mixed of digits and letters."""
    return certain() | ((F.col("given") == 1) & mixed())


def scored(found: DataFrame, model: RandomForestClassificationModel | None) -> DataFrame:
    """Add ``probability`` that a described candidate is a secret: 1 for certain ones, else the model's.

    Without a model it is 1 for proven ones and 0 for all others.
    """
    if model is None:
        return found.withColumn("probability", proven().cast("double"))
    out = model.transform(assembled(found)).withColumn("probability", F.when(certain(), 1.0).otherwise(vector_to_array("probability")[1]))
    return out.drop("features", "rawPrediction", "prediction")


def learn(docs: DataFrame, path: Column, labelled: DataFrame | None = None, rows: int = SAMPLE) -> tuple[DataFrame, RandomForestClassificationModel | None]:
    """(dictionary, forest). ``labelled`` are findings (path, value, before, after, label); without, plain ones of ``docs``."""
    common = dictionary(docs)
    if labelled is not None:
        return common, train(described(labelled, common), rows)
    return common, train(plain_labels(described(candidates(docs, [], path), common)), rows)


def judged(found: DataFrame, model: RandomForestClassificationModel | None, key: tuple[str, ...], least: float) -> DataFrame:
    kept = scored(found, model).select(*key, "nth", "value", "before", "after", "probability")
    return kept.withColumn("is_secret", F.col("probability") >= least)


def scan(docs: DataFrame, common: DataFrame, model: RandomForestClassificationModel | None, path: Column,
         key: tuple[str, ...] = ("doc_id",), least: float = 0.5) -> DataFrame:
    """One row for each candidate in each row of ``docs`` (text, ...): ``key``, nth, value, before, after, probability, is_secret.

    Candidates are numbered from 0 in their text, which is read whole. Null,
    empty and short texts have none, nor has an empty table; repeated rows give
    repeated findings; a null path is no path. Other columns are ignored.
    """
    return judged(described(candidates(docs, list(key), path), common), model, key, least)


def learn_and_scan(docs: DataFrame, path: Column, key: tuple[str, ...] = ("doc_id",), least: float = 0.5, rows: int = SAMPLE) -> DataFrame:
    """``scan`` of ``docs`` by what ``learn`` makes of the same ``docs``; their candidates are looked for once."""
    found = described(candidates(docs, list(key), path), dictionary(docs))
    return judged(found, train(plain_labels(found), rows), key, least)


def masked(docs: DataFrame, found: DataFrame, mask: str = "<secret>") -> DataFrame:
    """The rows of ``docs`` (doc_id, text, ...) with every secret of ``found`` (doc_id, _hash, value, is_secret) replaced.

    n_chars, if there, is counted anew. Longer secrets are replaced first. Only
    the secrets travel: rows are met by doc_id and a hash of the text, so equal
    rows are masked alike.
    """
    text = F.col("text").cast("string")
    lists = materialize(found.where("is_secret").groupBy("doc_id", "_hash").agg(F.collect_set("value").alias("_values")), "secrets")
    ordered = F.reverse(F.array_sort(F.transform("_values", lambda v: F.struct(F.length(v).alias("n"), v.alias("v")))))
    lists = lists.select(F.col("doc_id").alias("_id"), "_hash", ordered.alias("_values"))
    met = docs.withColumn("_mine", F.xxhash64(text)).join(
        lists.hint("shuffle_hash"), F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_mine") == F.col("_hash")), "left")
    replaced = F.when(F.col("_values").isNull(), F.col("text")).otherwise(
        F.aggregate("_values", text, lambda t, v: F.replace(t, v["v"], F.lit(mask))))
    columns = {"text": replaced}
    if "n_chars" in docs.columns:
        columns["n_chars"] = F.when(F.col("_values").isNull(), F.col("n_chars")).otherwise(F.length(replaced).cast(docs.schema["n_chars"].dataType))
    return met.select(*[columns[c].alias(c) if c in columns else c for c in docs.columns])


def hashed(docs: DataFrame, path: Column) -> DataFrame:
    return docs.select("doc_id", F.xxhash64(F.col("text").cast("string")).alias("_hash"), "text", path.alias("_path"))


def redacted(docs: DataFrame, common: DataFrame, model: RandomForestClassificationModel | None, path: Column,
             mask: str = "<secret>", least: float = 0.5) -> DataFrame:
    """``masked`` by ``scan``."""
    return masked(docs, scan(hashed(docs, path), common, model, F.col("_path"), ("doc_id", "_hash"), least), mask)


def learn_and_redact(docs: DataFrame, path: Column, mask: str = "<secret>", least: float = 0.5) -> DataFrame:
    """``masked`` by ``learn_and_scan``."""
    return masked(docs, learn_and_scan(hashed(docs, path), F.col("_path"), ("doc_id", "_hash"), least), mask)
