"""Secrets in texts: candidates by pattern, false positives removed by a random forest. DataFrame functions only."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, functions as F

from corpusloom.session import materialise

_RUN = "[A-Za-z0-9+/_=-]"
CONTEXT = 48
# names that announce a credential, and words that announce an example
_NAMES = "(?:token|secret|passw(?:or)?d|pwd|api[_-]?key|access[_ -]?key|auth(?!or)|bearer|credential|private[_-]?key)"
CREDENTIAL = f"(?i){_NAMES}"
# what stands directly before a value that is given to a name, or follows the word bearer
_NAME = f"(?i:{_NAMES})[A-Za-z0-9_-]{{0,12}}"
_SIGN = r"[\"'`]?(?:\s{0,3}[=:]|\s{1,3}(?:is|was))\s{0,3}"
_BEARER = r"(?i:bearer)\s{1,3}"
_GIVEN = rf"(?:{_NAME}{_SIGN}[\"'`]?|{_BEARER})"
_VALUE = rf"(?!=)(?:(?={_RUN}*?[0-9]){_RUN}{{8,}}|{_RUN}{{16,}})"
# A candidate is a private key block; behind a credential's name, what stands in quotes, a bearer token, or a run of 8
# characters with a digit, or 16 without; elsewhere a run of 16 with a digit or 28 without, which does not give a value
# to such a name. No length is cut. The first group is what announces a value, the others are values.
_BLOCK = r"(-----BEGIN [A-Z ]*PRIVATE KEY-----[A-Za-z0-9+/=\s:,.-]*?-----END [A-Z ]*PRIVATE KEY-----)"
_BEHIND = (
    rf"({_BEARER}(?=[A-Za-z0-9+/_=.~-]{{16}})|{_NAME}{_SIGN}(?:[\"'`](?=[^\s\"'`]{{8,}}[\"'`])|[\"'`]?(?={_VALUE})))"
    rf"((?<=[\"'`])[^\s\"'`]{{8,}}(?=[\"'`])|(?<=(?i:bearer)\s{{1,3}})[A-Za-z0-9+/_=.~-]{{16,}}|{_VALUE})"
)
_PLAIN = (
    rf"((?<!{_RUN})(?={_RUN}{{16}})(?:(?={_RUN}{{28}})|(?={_RUN}*?[0-9]))(?![A-Za-z0-9_-]{{0,64}}?{_NAME}={_VALUE}){_RUN}{{16,}})"
)
CANDIDATE = f"{_BLOCK}|{_BEHIND}|{_PLAIN}"
# ends of a candidate while a text is cut: a character that stands for nothing, doubled forms keep it where a text holds it
_MARK = "\ufdd0"
# formats that only credentials have
KNOWN = (
    r"^(?:(?:AKIA|ASIA)[0-9A-Z]{16}$|gh[pousr]_[A-Za-z0-9]{30,}|github_pat_[A-Za-z0-9_]{30,}|glpat-[A-Za-z0-9_-]{16,}|xox[abprs]-[A-Za-z0-9-]{16,}"
    r"|[sr]k_live_[A-Za-z0-9]{16,}|AIza[0-9A-Za-z_-]{35}|eyJ[A-Za-z0-9_-]{16,}|-----BEGIN [A-Z ]*PRIVATE KEY-----)"
)
PLACEHOLDER = r"(?i)(?:example|sample|dummy|placeholder|changeme|your[_-]|xxxx|todo)"
TEST_PATH = r"(?i)(?:^|[/_.-])(?:tests?|examples?|fixtures?|mocks?|docs?|vendor|samples?)(?:$|[/_.-])"

DICTIONARY_WORDS = 5_000
# findings of either label that the forest is fitted on, those of the lowest hashes
SAMPLE_ROWS = 10_000
TREES, DEPTH = 15, 5

FEATURES = (
    "length digits capitals others transitions vowel_turns repeats coverage test_path in_path "
    "credential assigned quoted placeholder words_before named known entropy"
).split()


def dictionary(documents: DataFrame, text: str = "text", words: int = DICTIONARY_WORDS) -> list[str]:
    """The most frequent words of 3 letters or more over all texts, ties in order of the word; at most ``words``."""
    found = documents.select(F.explode(F.split(F.lower(text), "[^a-z]+")).alias("w")).where(F.length("w") >= 3)
    top = found.groupBy("w").count().orderBy(F.desc("count"), "w").limit(words)
    return [row["w"] for row in top.collect()]


def pieces(text: str) -> Column:
    """A text cut at its candidates, from one search: what lies between them, and at odd places (from 0) their values."""
    own = F.replace(F.coalesce(F.col(text).cast("string"), F.lit("")), F.lit(_MARK), F.lit(f"{_MARK}."))
    cut = f"{_MARK}|"
    # of the groups that hold values one is found, the others are empty
    marked = F.regexp_replace(own, F.lit(CANDIDATE), F.lit(f"$2{cut}$1$3$4{cut}"))
    return F.transform(F.split(marked, rf"{_MARK}\|", -1), lambda piece: F.replace(piece, F.lit(f"{_MARK}."), F.lit(_MARK)))


def candidates(cut: Column) -> Column:
    """Array of (before, value, after) of the candidates among the pieces of a text.

    Either side has up to CONTEXT characters, of the next three pieces.
    """

    def near(places: list[Column]) -> Column:
        return F.concat(*(F.coalesce(F.get(cut, place), F.lit("")) for place in places))

    def found(at: Column) -> Column:
        before, after = (near([at + step for step in steps]) for steps in ((-3, -2, -1), (1, 2, 3)))
        return F.struct(
            F.right(before, F.lit(CONTEXT)).alias("before"), F.get(cut, at).alias("value"), F.left(after, F.lit(CONTEXT)).alias("after")
        )

    last = F.size(cut) - 2
    return F.when(last < 1, F.array().cast("array<struct<before: string, value: string, after: string>>")).otherwise(
        F.transform(F.sequence(F.lit(1), F.greatest(last, F.lit(1)), F.lit(2)), found)
    )


def entropy(value: Column) -> Column:
    """Bits per character of a value, by its own frequencies."""
    size = F.length(value).cast("double")

    def bits(total: Column, letter: Column) -> Column:
        n = size - F.length(F.replace(value, letter, F.lit("")))
        return total + n * F.log2(size / n)

    return F.aggregate(F.array_distinct(F.regexp_extract_all(value, F.lit("(?s)(.)"), 1)), F.lit(0.0), bits) / size


def coverage(value: Column, words: list[str]) -> Column:
    """The share of a value's characters that are dictionary words of 3 letters or more; words end at other characters and at capitals."""
    parts = F.regexp_extract_all(F.lower(F.regexp_replace(value, "([a-z])([A-Z])", "$1 $2")), F.lit("[a-z]{3,}"), 0)
    known = F.filter(parts, lambda word: word.isin(words)) if words else F.array().cast("array<string>")
    return F.aggregate(known, F.lit(0), lambda total, word: total + F.length(word)) / F.length(value)


def features(before: Column, value: Column, after: Column, path: Column, words: list[str]) -> dict[str, Column]:
    """The forest's inputs: length, character transitions, dictionary coverage, path, neighbouring words."""
    count = lambda column, pattern: F.regexp_count(column, F.lit(pattern)).cast("double")
    flag = lambda column, pattern: F.coalesce(column.rlike(pattern), F.lit(False)).cast("double")
    size = F.length(value).cast("double")
    return {
        "length": size,
        "digits": count(value, "[0-9]") / size,
        "capitals": count(value, "[A-Z]") / size,
        "others": count(value, "[^A-Za-z0-9]") / size,
        # neighbours of different classes, and vowels followed by consonants
        "transitions": count(value, "[a-z](?=[^a-z])|[A-Z](?=[^A-Z])|[0-9](?=[^0-9])|[^A-Za-z0-9](?=[A-Za-z0-9])") / size,
        "vowel_turns": count(F.lower(value), "[aeiou](?=[b-df-hj-np-tv-z])") / size,
        "repeats": count(value, r"(.)(?=\1)") / size,
        "coverage": coverage(value, words),
        "test_path": flag(path, TEST_PATH),
        "in_path": flag(before, r"(?:://|[/\\])[^\s\"']*$"),
        "credential": flag(before, CREDENTIAL),
        "assigned": flag(before, r"[=:]\s*[\"'`]?$"),
        "quoted": flag(before, "[\"'`]$") * flag(after, "^[\"'`]"),
        "placeholder": flag(F.concat(before, value), PLACEHOLDER),
        "words_before": count(before, r"\b[A-Za-z]{2,}\b"),
        "named": flag(before, f"{_GIVEN}$"),
        "known": flag(value, KNOWN),
        "entropy": entropy(value),
    }


def labelled(before: Column, value: Column, after: Column) -> Column:
    """The label of a finding where no person gave one: 1 for a known format, or for a value of random characters that is
    given to a credential's name, in quotes or without, or follows the word bearer; 0 for everything else."""
    named = before.rlike(f"{_GIVEN}$")
    digits = F.regexp_count(value, F.lit("[0-9]")) * 8 >= F.length(value)
    # without many digits: letters of both cases mixed as words do not mix them, or other characters
    turns = F.regexp_count(value, F.lit("[a-z](?=[^a-z])|[A-Z](?=[^A-Z])|[0-9](?=[^0-9])")) * 4 >= F.length(value)
    short = F.length(value) < 16
    kinds = sum((value.rlike(kind).cast("int") for kind in ("[a-z]", "[A-Z]", "[0-9]", "[^A-Za-z0-9]")), F.lit(0))
    random = F.when(short, (kinds >= 2) & value.rlike("[0-9]") & (entropy(value) >= 2.5)).otherwise(digits | turns & (entropy(value) >= 3.5))
    given = named & random | value.rlike(KNOWN)
    return F.coalesce(given & ~F.concat(before, value).rlike(PLACEHOLDER), F.lit(False)).cast("int")


def _cut(documents: DataFrame, usable: Column, path: str | None, text: str) -> DataFrame:
    """``document`` (all other columns), ``path, cut, empty, usable``: every text searched once and written as its pieces."""
    rest = [F.col(f"`{c}`") for c in documents.columns if c != text]
    return materialise(
        documents.select(
            F.struct(*rest, F.lit(None).cast("int").alias("_")).alias("document"), (F.col(path).cast("string") if path else F.lit("")).alias("path"),
            pieces(text).alias("cut"), F.col(f"`{text}`").isNull().alias("empty"), F.coalesce(usable, F.lit(True)).alias("usable"),
        ),
        "pieces",
    )


def findings(cut: DataFrame, words: list[str], *columns: str) -> DataFrame:
    """A row per candidate of ``cut`` (``path, cut``): ``columns``, ``n`` (its number in the text, from 0), ``before, value,
    after``, the features and the rules' label."""
    rows = cut.select(*columns, "path", F.posexplode(candidates(F.col("cut"))).alias("n", "c"))
    own = rows.select(*columns, "n", "path", "c.before", "c.value", "c.after")
    made = features(F.col("before"), F.col("value"), F.col("after"), F.col("path"), words)
    label = labelled(F.col("before"), F.col("value"), F.col("after")).alias("label")
    return own.select(*columns, "n", "before", "value", "after", label, *(column.alias(name) for name, column in made.items()))


@dataclass
class Forest:
    """Trees as nested tuples: (feature, threshold, left, right), leaves are shares of label 1."""

    trees: list

    def score(self, inputs: dict[str, Column]) -> Column:
        """The mean of the trees, as an expression; 1 for a known format that is no placeholder, which the sample may not hold."""
        total = F.lit(0.0)
        for tree in self.trees:
            total = total + _as_column(tree, inputs)
        return F.when((inputs["known"] == 1) & (inputs["placeholder"] == 0), 1.0).otherwise(total / len(self.trees))


def _as_column(node, inputs: dict[str, Column]) -> Column:
    if isinstance(node, float):
        return F.lit(node)
    name, threshold, left, right = node
    return F.when(inputs[name] <= threshold, _as_column(left, inputs)).otherwise(_as_column(right, inputs))


def _tree(node) -> object:
    if node.subtreeDepth() == 0:
        stats = node.impurityStats().stats()
        return float(stats[1] / (stats[0] + stats[1])) if len(stats) > 1 and stats[0] + stats[1] else 0.0
    split = node.split()
    return FEATURES[split.featureIndex()], float(split.threshold()), _tree(node.leftChild()), _tree(node.rightChild())


def drawn(labelled_findings: DataFrame, sample_rows: int = SAMPLE_ROWS, key: str = "doc_id") -> DataFrame:
    """Of each label at most ``sample_rows`` findings, those of the lowest hashes of document and number.

    A finding that is repeated in many documents takes its share of the sample and no more.
    Rows with a null label or feature are left out.
    """
    rows = labelled_findings.select(key, "n", "label", *FEATURES).where(F.col("label").isin(0, 1)).dropna(subset=["label", *FEATURES])
    order = [F.xxhash64(key, "n"), key, "n", *FEATURES]
    parts = [rows.where(F.col("label") == y).orderBy(*order).limit(sample_rows) for y in (0, 1)]
    return materialise(parts[0].union(parts[1]).select(F.col("label").cast("double").alias("label"), *FEATURES), "findings")


def fit(sample: DataFrame, seed: int = 5):
    """Spark's forest over a sample of both labels."""
    rows = with_vector(sample)
    forest = RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, seed=seed, featureSubsetStrategy="sqrt", minInstancesPerNode=2)
    return forest.fit(rows.select("label", "features"))


def with_vector(rows: DataFrame) -> DataFrame:
    return VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(rows)


def compiled(model) -> Forest:
    return Forest([_tree(tree._call_java("rootNode")) for tree in model.trees])


def train_forest(labelled_findings: DataFrame, sample_rows: int = SAMPLE_ROWS, seed: int = 5, key: str = "doc_id") -> Forest:
    """Fit on the drawn findings. With findings of one label, or none, every score is that label's, or 0."""
    sample = drawn(labelled_findings, sample_rows, key)
    seen = {row["label"] for row in sample.select("label").distinct().collect()}
    return compiled(fit(sample, seed)) if len(seen) == 2 else Forest([float(max(seen, default=0.0))])


def scan(documents: DataFrame, usable: Column, key: str = "doc_id", text: str = "text", path: str | None = "source") -> DataFrame:
    """All findings of all texts: ``key, n, before, value, after``, the features, ``label``, ``score`` and ``is_secret``.

    The forest is trained on the findings of rows for which ``usable`` (over
    ``documents``) is true; its label there is ``labelled``. A null or empty text has no
    findings; rows with a null key and repeated rows are scanned like all others. Texts and values of any
    length are searched whole.
    """
    words = dictionary(documents, text)
    cut = _cut(documents, usable, path, text).withColumn("id", F.col(f"document.`{key}`"))
    found = materialise(findings(cut, words, "id", "usable"), "findings")
    forest = train_forest(found.where("usable"), key="id")
    score = forest.score({name: F.col(name) for name in FEATURES})
    told = found.drop("usable").withColumn("score", score).withColumn("is_secret", F.col("score") >= 0.5)
    return told.withColumnRenamed("id", key)


def redact(
    documents: DataFrame, usable: Column, key: str = "doc_id", text: str = "text", path: str | None = "source", mask: str = "[SECRET]"
) -> DataFrame:
    """``documents`` with every secret in ``text`` replaced by ``mask``; all other rows and columns as they are.

    Every text is searched once and cut at its candidates; those that the forest takes as
    secrets are replaced where they stand, and so are candidates of the same value
    elsewhere in the text. Characters outside candidates never change. A null text stays
    null; columns may have any names.
    """
    words = dictionary(documents, text)
    cut = _cut(documents, usable, path, text)
    found = findings(cut.where("usable").withColumn("id", F.col(f"document.`{key}`")), words, "id")
    forest = train_forest(materialise(found.select("id", "n", "label", *FEATURES), "findings"), key="id")

    # the inputs are made once per candidate, before the trees ask for them
    def judged(c: Column) -> Column:
        made = features(c["before"], c["value"], c["after"], F.col("path"), words)
        return F.struct(c["value"].alias("value"), *(column.alias(name) for name, column in made.items()))

    kept = F.filter(F.transform(candidates(F.col("cut")), judged), lambda c: forest.score({name: c[name] for name in FEATURES}) >= 0.5)
    told = cut.select("document", "cut", "empty", F.transform(kept, lambda c: c["value"]).alias("secrets"))

    def masked(piece: Column, at: Column) -> Column:
        return F.when((at % 2 == 1) & F.array_contains(F.col("secrets"), piece), F.lit(mask)).otherwise(piece)

    whole = F.when(~F.col("empty"), F.array_join(F.transform("cut", masked), ""))
    return told.select(*(whole.alias(c) if c == text else F.col(f"document.`{c}`").alias(c) for c in documents.columns))
