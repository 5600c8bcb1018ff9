"""Secret scanning with a random forest that removes false positives, DataFrame functions only.

Candidates are words of a text that look unlike language: long with digits and
letters, or a value given to a name, in the same word or the words before; and
inside such a word every published key format and every pair of name and value.
Each is described by its length, by its
transitions between kinds of characters, by how much of it common words cover,
by the path it stands in and by the words next to it.  The forest learns from
labelled findings; without any given, findings label themselves where the
evidence is decisive: formats that only keys have, values of names that say
secret, and on the other side addresses, links, numbers, hashes named as such
and placeholders.  Everything runs in the JVM; candidates leave their text for
the forest as narrow rows, and redaction joins the confirmed ones back.
"""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, functions as F

from ..session import materialise
from ..operators.sizing import broadcast_if_small

#: Labelled findings that the forest is fitted on, about.
TRAIN_ROWS = 20_000
TREES, DEPTH = 24, 6
THRESHOLD = 0.5
BROADCAST_BYTES = 32 << 20
MASK = "[SECRET]"

#: Formats that providers publish for their keys.
PROVIDERS = "|".join([
    r"(AKIA|ASIA)[0-9A-Z]{16}", r"gh[pousr]_[A-Za-z0-9]{36}", r"glpat-[A-Za-z0-9_-]{20}", r"xox[abprs]-[A-Za-z0-9-]{10,}",
    r"sk-[A-Za-z0-9_-]{20,}", r"AIza[0-9A-Za-z_-]{35}", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]*",
])
#: A key of a provider inside a word, not the end of a longer word; escapes before it are no letters of it.
INSIDE = rf"(?:(?<![A-Za-z0-9])|(?<=%[0-9A-Fa-f]{{2}})|(?<=\\[nrt]))(?:{PROVIDERS})(?![A-Za-z0-9])"
#: Name and value inside a word, at every start of a name: the value in quotes, or up to what ends it in JSON, links and lists.
_BARE = r"""[^\s"'&;,<>(){}\[\]|\\"""
PAIRS = (
    r"""(?<![\w.-])(?=([A-Za-z][\w.-]{1,40})\\?["']?[=:]+(?!//)(?:\\?"([^"\s\\]{4,})\\?"|\\?'([^'\s\\]{4,})\\?'|"""
    rf"""(?={_BARE}]{{4}})({_BARE}:=]*(?:[:=]+{_BARE}:=]*){{0,64}})))"""
)
#: Names whose values are secrets, words beside harmless values, placeholders.
NAMES = r"(?i)(pass(word|wd|phrase)?|pwd|token|secret|api_?-?key|access_?-?key|auth(orization)?|bearer|credentials?|private_?-?key)"
HARMLESS = r"(?i)\b(commit|sha(1|256)?|md5|checksum|hash|uuid|guid|version|revision|order|invoice|phone|tel|isbn|issn|doi|page|id|date|time|ip|mail|e-mail)\b"
PLACEHOLDER = r"(?i)(example|sample|dummy|changeme|placeholder|your_?-?|xxxx|test|foo|bar|0000|1234567)"
ADDRESS = r"(?i)^([\w.+-]+@[\w-]+(\.[\w-]+)+|https?://.*|www\..*|\d{1,3}(\.\d{1,3}){3}(:\d+)?|[\d.,:/()+-]+|[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12})$"
#: Common words and fragments for the coverage of a candidate by language.
COMMON = (
    "the and for that with this from have not are was you all can out use one new time more about which their will would there what "
    "when your into than then some could other only also over after first because where most such make made like long way many day "
    "number name value user file data code page home work test key text line list item type class import return string index image "
    "version server client system public private static service config default country street city phone order price total date year "
    "der die und ein eine nicht mit von auf les des une dans pour que los las una con por tion ment ing able heit keit ung lich"
).split()

FEATURES = [
    "length", "classes", "transitions", "case_changes", "digits", "capitals", "symbols", "distinct", "longest_letters", "hexadecimal", "vowels", "coverage",
    "slashes", "dots", "at_sign", "path_like", "path_code", "path_test", "named", "names_near", "harmless_near", "placeholder", "quoted", "letters_before", "letters_after",
]


def _rate(value: Column, pattern: str) -> Column:
    return F.regexp_count(value, F.lit(pattern)) / F.greatest(F.length(value), F.lit(1))


def candidates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", path: str | None = None, key: Column | None = None) -> DataFrame:
    """(id, position, word, name, value, before, after, path): every candidate of every whole text, several in a word.

    With ``key``, a column of ``docs``, that too, as ``key``.
    """
    long = lambda w: F.length(w) >= 12
    mixed = lambda w: long(w) & w.rlike("[0-9]") & w.rlike("[A-Za-z]")
    given = lambda w: w.rlike(NAMES + r"""[\w.-]{0,40}\\?["']?[=:]+\\?["']?[^"'=:\s]{4,}""")
    told = lambda x: (F.length(x["word"]) >= 4) & x["said"].rlike(NAMES + r"""[\w.-]{0,40}["']?\s*[=:]+>?\s*["'({\[<]*$""")
    rows = docs.select(F.col(doc_id).alias("id"), (F.col(path) if path else F.lit("")).cast("string").alias("path"), F.col(text).alias("text"), *([] if key is None else [key.alias("key")]))
    kept = rows.drop("text", "id", "path").columns
    rows = rows.filter(F.col("text").rlike(r"[0-9=:]|\S{12}")).withColumn("words", F.split("text", r"[\x20\x09-\x0D]+")).drop("text")
    # One pass over the words: an optimizer may copy the split into every use of it.
    said = lambda i: F.concat_ws(" ", *(F.get("words", i - k) for k in (3, 2, 1)))
    numbered = F.transform("words", lambda w, i: F.struct((i + 1).alias("position"), w.alias("word"), F.when(said(i).rlike(r"""[=:]>?\s*["'({\[<]*$"""), said(i)).otherwise("").alias("said")))
    spots = F.filter(numbered, lambda x: mixed(x["word"]) | given(x["word"]) | (long(x["word"]) & x["word"].rlike(INSIDE)) | told(x))
    around = lambda *ks: F.concat_ws(" ", *(F.get("words", F.col("position") - 1 + k) for k in ks))
    found = rows.select("id", "path", *kept, "words", F.explode(spots).alias("spot")).select("id", "path", *kept, "words", "spot.position", "spot.word")
    found = found.select("id", "path", *kept, "position", "word", around(-3, -2, -1).alias("before"), around(1, 2).alias("after"))
    pair = r"""^["'({\[]*([A-Za-z][A-Za-z_.-]{1,40})["']?[=:]+["']?(\S{4,}?)["',;.)}\]]*$"""
    quoted = F.regexp_extract("word", r"""^[^\w"']*["']([^"'\s]{4,})["']""", 1)
    bare = F.when(quoted != "", quoted).otherwise(F.regexp_replace("word", r"""^["'({\[<]+|["',;.)}\]>!?]+$""", ""))
    name = F.regexp_extract("word", pair, 1)
    # "name = value" in three words gives the name, too.
    spoken = F.regexp_extract("before", r"""([A-Za-z][\w.-]{1,40})["']?\s*[=:]+>?\s*["'({\[<]*$""", 1)
    found = found.withColumn("name", F.when(name != "", name).otherwise(spoken)).withColumn("value", F.when(name != "", F.regexp_extract("word", pair, 2)).otherwise(bare))
    # Names and values have no blanks, so a blank joins them; strings are compared by hash, structs one by one.
    each = lambda k: F.regexp_extract_all("word", F.lit(PAIRS), F.lit(k))
    bounds = F.zip_with(each(2), each(3), lambda a, b: F.concat(a, b))
    values = F.zip_with(bounds, each(4), lambda a, b: F.concat(a, F.regexp_replace(b, r"[.]+$", "")))
    found = found.withColumn("pairs", F.zip_with(each(1), values, lambda n, v: F.concat_ws(" ", n, v)))
    found = found.withColumn("inner", F.transform("pairs", lambda x: F.substring_index(x, " ", -1)))
    keys = F.array_except(F.regexp_extract_all("word", F.lit(INSIDE), F.lit(0)), F.concat("inner", F.array("value")))
    own = F.when(F.array_contains("inner", F.col("value")), F.array().cast("array<string>")).otherwise(F.array(F.concat_ws(" ", "name", "value")))
    found = found.withColumn("given", F.explode(F.concat(own, F.array_distinct("pairs"), F.transform(keys, lambda v: F.concat(F.lit(" "), v)))))
    found = found.withColumn("name", F.substring_index("given", " ", 1)).withColumn("value", F.substring_index("given", " ", -1))
    return found.drop("pairs", "inner", "given").filter(F.length("value") >= 4)


def described(found: DataFrame) -> DataFrame:
    """Candidates with the columns of ``FEATURES``."""
    v = F.col("value")
    kinds = ["[a-z]", "[A-Z]", "[0-9]", "[^A-Za-z0-9]"]
    turn = r"(?<=[A-Za-z])(?=[0-9])|(?<=[0-9])(?=[A-Za-z])"
    case = r"(?<=[a-z])(?=[A-Z])"
    near = F.concat_ws(" ", "before", "after")
    runs = F.transform(F.split(v, "[^A-Za-z]+"), F.length)
    made = {
        "length": F.length(v), "classes": sum(v.rlike(k).cast("int") for k in kinds),
        "transitions": _rate(v, turn), "case_changes": _rate(v, case), "digits": _rate(v, "[0-9]"), "capitals": _rate(v, "[A-Z]"),
        "symbols": _rate(v, "[^A-Za-z0-9]"), "distinct": F.size(F.array_distinct(F.split(v, ""))) / F.least(F.length(v), F.lit(64)),
        "longest_letters": F.array_max(runs), "hexadecimal": v.rlike("^[0-9a-fA-F]{16,}$"), "vowels": _rate(F.lower(v), "[aeiou]"),
        "coverage": 1 - F.length(F.regexp_replace(F.lower(v), "|".join(sorted(COMMON, key=len, reverse=True)), "")) / F.greatest(F.length(v), F.lit(1)),
        "slashes": F.regexp_count(v, F.lit("/")), "dots": F.regexp_count(v, F.lit(r"\.")), "at_sign": v.contains("@"),
        "path_like": v.rlike(r"^(\.{0,2}/|[A-Za-z]:\\|\w+/)[\w./\\-]+$"), "path_code": F.col("path").rlike(r"(?i)\.(py|js|java|go|rb|env|ya?ml|json|toml|cfg|ini|sh)$"),
        "path_test": F.col("path").rlike("(?i)test|example|sample|doc|spec"), "named": F.col("name").rlike(NAMES), "names_near": near.rlike(NAMES),
        "harmless_near": F.concat_ws(" ", "name", near).rlike(HARMLESS), "placeholder": v.rlike(PLACEHOLDER), "quoted": F.col("word").rlike("""["']"""),
        "letters_before": _rate(F.col("before"), r"[\p{L}]"), "letters_after": _rate(F.col("after"), r"[\p{L}]"),
    }
    return found.withColumns({k: F.coalesce(made[k].cast("double"), F.lit(0.0)) for k in FEATURES})


def self_labelled(found: DataFrame) -> DataFrame:
    """Candidates whose label is beyond doubt, with ``label`` 1 or 0."""
    v = F.col("value")
    provider = v.rlike(f"^({PROVIDERS})$")
    keyed = F.col("name").rlike(f"^{NAMES}$") & (F.length(v) >= 12) & v.rlike("[0-9]") & v.rlike("[A-Za-z]") & ~v.rlike(ADDRESS)
    told = F.col("name").rlike(HARMLESS) | F.col("before").rlike(HARMLESS + r"\W*$")
    harmless = v.rlike(ADDRESS) | (~F.col("name").rlike(NAMES) & (told | v.rlike(r"^\p{L}+[\d.,:;!?]*$")))
    label = F.when(v.rlike(PLACEHOLDER) & ~provider, 0).when(provider | keyed, 1).when(harmless, 0)
    return found.withColumn("label", label).filter("label IS NOT NULL")


class Forest:
    """A fitted forest, or the share of secrets where there was only one kind of finding."""

    def __init__(self, model=None, share: float = 0.0):
        self.model, self.share = model, share

    def score(self, rows: DataFrame) -> DataFrame:
        """Described candidates with ``score``."""
        if self.model is None:
            return rows.withColumn("score", F.lit(self.share)).drop(*FEATURES)
        done = self.model.transform(VectorAssembler(inputCols=FEATURES, outputCol="features").transform(rows))
        return done.withColumn("score", vector_to_array("probability")[1]).drop(*FEATURES, "features", "rawPrediction", "probability", "prediction")


def fit(findings: DataFrame, limit: int = TRAIN_ROWS) -> Forest:
    """A forest from described, labelled candidates, about ``limit`` of them by a hash of the finding."""
    counts = {r["label"]: r["count"] for r in findings.groupBy("label").count().collect()}
    total = sum(counts.values())
    if len(counts) < 2:
        return Forest(share=float(bool(counts.get(1))))
    share = min(1.0, limit / total)
    picked = findings.filter(F.pmod(F.xxhash64("id", "position", "value"), F.lit(1 << 20)) < int(share * (1 << 20)))
    # Both kinds weigh the same, however rare secrets are.
    weight = F.when(F.col("label") == 1, F.lit(total / (2.0 * counts[1]))).otherwise(F.lit(total / (2.0 * counts[0])))
    rows = materialise(picked.withColumn("weight", weight).select("label", "weight", *FEATURES), "findings").coalesce(4)
    forest = RandomForestClassifier(featuresCol="features", labelCol="label", weightCol="weight", numTrees=TREES, maxDepth=DEPTH, minInstancesPerNode=3, seed=11)
    return Forest(forest.fit(VectorAssembler(inputCols=FEATURES, outputCol="features").transform(rows)))


def scan(docs: DataFrame, forest: Forest | None = None, doc_id: str = "doc_id", text: str = "text", path: str | None = None) -> DataFrame:
    """A row per candidate: doc_id, position of the word (from 1), name, value, score, is_secret.

    Without a forest one is fitted on the findings that label themselves.  Null
    and empty texts and texts without candidates give no row.  A null id stays
    null; repeated rows give their findings again.  Without findings to learn
    from nothing is a secret.  Other columns are left out; ``path`` names a
    column with the path of the text, if there is one.
    """
    return _judged(candidates(docs, doc_id, text, path), forest).select(F.col("id").alias("doc_id"), "position", "name", "value", "score", "is_secret")


def _judged(found: DataFrame, forest: Forest | None) -> DataFrame:
    """Candidates with score and is_secret."""
    found = materialise(described(found), "candidates")
    forest = forest or fit(self_labelled(found))
    done = forest.score(found)
    # Published key formats are secrets whatever stands around them.
    sure = F.col("value").rlike(f"^({PROVIDERS})$") & ~F.col("value").rlike("(?i)example")
    done = done.withColumn("score", F.when(sure, F.greatest("score", F.lit(THRESHOLD))).otherwise(F.col("score")))
    return done.withColumn("is_secret", F.col("score") >= THRESHOLD)


def redacted(docs: DataFrame, forest: Forest | None = None, doc_id: str = "doc_id", text: str = "text", path: str | None = None) -> DataFrame:
    """``docs`` with every confirmed secret in a text replaced by a mask; all rows and columns stay."""
    # By id and text: an array is bounded by its own text, whatever rows share a null or repeated id.
    parts = [F.col(doc_id).cast("string"), *([F.col(path).cast("string")] if path else []), F.col(text)]
    key = F.md5(F.concat_ws("\n", *(F.coalesce(F.concat(F.lit("="), c), F.lit("null")) for c in parts)))
    found = _judged(candidates(docs, doc_id, text, path, key), forest).filter("is_secret")
    # Longer values first, so that none is cut by one that it contains.
    values = F.array_sort(F.collect_set(F.struct("position", "value")), lambda a, b: F.length(b["value"]) - F.length(a["value"]))
    by_key = materialise(found.groupBy(F.col("key").alias("_key")).agg(values.alias("_secrets")), "secrets")
    joined = docs.withColumn("_key", key).join(broadcast_if_small(by_key, BROADCAST_BYTES), "_key", "left")
    # Masked in its own word only: the same characters elsewhere are something else.  Words and blanks take turns,
    # so the position of a word follows from its place among both; no value has a blank.
    pieces = F.regexp_extract_all(text, F.lit(r"[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+"), F.lit(0))
    own = lambda i: F.filter("_secrets", lambda s: s["position"] == F.floor((i + 1) / 2) + 1)
    masked = F.transform(pieces, lambda t, i: F.aggregate(own(i), t, lambda done, s: F.replace(done, s["value"], F.lit(MASK))))
    clean = F.array_join(masked, "")
    return joined.withColumn(text, F.when(F.col("_secrets").isNull(), F.col(text)).otherwise(clean)).select(*docs.columns)
