"""Secret scans in DataFrame operations alone: candidates by pattern, false positives removed by a random forest.

Candidates are marked in a text by one regular expression, cut out with their surroundings as an array column, turned into
features and scored, all within the row: no shuffle, no explode before the end, no Python. The forest is trained by Spark
ML from labelled findings and then written out as a column expression, so scoring is part of the plan.

Features: length, transitions between character classes, the likelihood of the steps from character to character (learned
from the findings), shares of digits, upper case and hex digits, distinct characters, the share covered by dictionary
words, the path, and the neighbouring words and signs.
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Candidates: runs of key characters with a digit, or what is assigned to a name that speaks of a secret, or a key block.
#: Each is whole, whatever its length; possessive, so that time and stack do not follow it.
KEYWORDS = "token|secret|passwd|password|pwd|api[_-]?key|access[_-]?key|private[_-]?key|auth|credential"
PATTERN = (
    # up to the next five hyphens, whatever lies between: header lines, escaped line ends
    r"-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----(?:[^-]++|-(?!----))*+-----END [A-Z ]{0,20}PRIVATE KEY-----"
    # the first two looks behind follow from the third and are cheap
    rf"|(?<=[:= \t\"'])(?<=[:=][ \t]{{0,2}}[\"']?)(?<=(?i:(?:{KEYWORDS}))[\"']?[ \t]{{0,2}}[:=][ \t]{{0,2}}[\"']?)[A-Za-z0-9+/_=!@#$%^&*~.-]{{8,}}+"
    r"|(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]*+[0-9])[A-Za-z0-9+/_-]{16,}+={0,2}"
)
#: Words that speak for and against a secret in the text around, and words that make a value a placeholder or a name.
NEAR_GOOD, NEAR_BAD = rf"(?i){KEYWORDS}|bearer|signing", r"(?i)example|sample|dummy|placeholder|test|fake|sha1|sha256|md5|checksum|commit|digest|hash|uuid|guid|version|card|phone|order|invoice|isbn"
#: Words that names, placeholders and sentences are made of: of programs and settings, and common English ones of four letters or more.
DICTIONARY = (
    "access|account|active|address|admin|alpha|array|auth|author|backup|basic|batch|beta|block|build|bucket|cache|category|change|changeme|channel|client|cluster|code|column|commit|common|config|connect|content|"
    "count|create|current|customer|data|database|date|default|delete|deploy|description|detail|device|direct|disable|document|domain|dummy|email|enable|error|event|example|export|fake|false|feature|field|file|"
    "filter|folder|format|frame|function|global|group|handler|header|here|host|image|import|index|input|insert|internal|invoice|item|label|language|large|level|library|limit|list|local|login|main|manager|master|"
    "memory|message|method|model|module|name|network|node|none|null|number|object|option|order|output|page|parent|password|path|payment|photo|placeholder|plugin|point|policy|port|print|private|process|product|"
    "profile|project|public|query|queue|random|record|region|release|remote|replace|report|request|resource|response|result|review|role|root|route|sample|schema|script|search|secret|section|select|server|service|session|"
    "setting|shared|small|source|stage|start|state|static|status|storage|stream|string|system|table|target|task|team|template|test|text|thing|this|time|title|token|total|true|type|update|upload|user|value|version|"
    "video|view|virtual|volume|website|window|worker|about|after|again|also|because|been|before|being|between|both|could|down|each|even|every|first|from|good|great|have|into|just|know|last|like|long|made|make|many|"
    "more|most|much|must|never|only|other|over|people|same|should|some|such|take|than|that|their|them|then|there|these|they|three|through|under|very|want|water|well|were|what|when|where|which|while|will|with|word|"
    "work|would|write|year|your|http|www|com|xxxx|0000|1234|abcd"
)
PATH_BAD = r"(?i)test|example|sample|fixture|mock|doc|readme"
FEATURES = ["length", "transitions", "digits", "uppers", "hexes", "distinct", "dictionary", "placeholder", "prefixed", "assigned", "quoted", "near_good", "near_bad", "path_bad", "key_block", "likelihood"]
#: Kinds of characters whose transitions are told apart: others, 26 lower-case letters, digits, upper-case letters.
KINDS = 29
BEFORE, AFTER, CHUNK = 48, 24, 256
THRESHOLD = 0.5


def transitions(value: Column) -> Column:
    """The steps from each character to the next as an array of numbers below ``KINDS`` squared; null for fewer than two characters."""

    def kind(c: Column) -> Column:
        n = F.ascii(c)
        return F.when((n >= 97) & (n <= 122), n - 96).when((n >= 48) & (n <= 57), F.lit(27)).when((n >= 65) & (n <= 90), F.lit(28)).otherwise(F.lit(0))

    return F.when(F.length(value) > 1, let(F.transform(F.split(value, ""), kind), lambda k: F.zip_with(F.slice(k, 1, F.size(k) - 1), F.slice(k, 2, F.size(k) - 1), lambda a, b: a * KINDS + b)))


def likelihoods(findings: DataFrame) -> list[float]:
    """For each step, the logarithm of how much likelier it is in a secret than in another candidate, learned from labelled findings.

    The table has ``KINDS`` squared numbers whatever the findings; a step that neither has seen counts for nothing.
    """
    steps = findings.where("label is not null").select(F.col("label").cast("double").alias("label"), F.explode(transitions(F.coalesce("value", F.lit("")))).alias("t"))
    seen = {r["t"]: (r["y"], r["n"]) for r in steps.groupBy("t").agg(F.sum("label").alias("y"), F.sum(1 - F.col("label")).alias("n")).collect()}
    total = [sum(v[k] for v in seen.values()) + KINDS * KINDS for k in (0, 1)]
    return [round(math.log((seen[t][0] + 1) / total[0]) - math.log((seen[t][1] + 1) / total[1]), 3) if t in seen else 0.0 for t in range(KINDS * KINDS)]


def features(value: Column, before: Column, after: Column, path: Column, table: list[float]) -> Column:
    """The features of a candidate as an array of doubles, in the order of ``FEATURES``; ``table`` is that of ``likelihoods``."""
    odds = F.from_json(F.lit(json.dumps(table)), "array<double>")
    likelihood = let(transitions(value), lambda t: F.aggregate(t, F.lit(0.0), lambda acc, k: acc + odds[k]) / F.size(t))
    n = F.greatest(F.length(value), F.lit(1)).cast("double")
    share = lambda pattern: F.length(F.regexp_replace(value, pattern, "")) / n
    classes = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(value, "[a-z]+", "l"), "[A-Z]+", "U"), "[0-9]+", "9"), "[^lU9]+", "+")
    flag = lambda c: F.when(c, 1.0).otherwise(0.0)
    uncovered = F.length(F.regexp_replace(F.lower(value), DICTIONARY, ""))
    return F.array(
        n,
        (F.length(classes) - 1) / n,
        share("[^0-9]"),
        share("[^A-Z]"),
        share("[^0-9a-fA-F]"),
        F.size(F.array_distinct(F.split(F.substring(value, 1, 64), ""))) / F.least(n, F.lit(64.0)),
        (n - uncovered) / n,
        flag(value.rlike(r"(?i)xxx|\*\*\*|your[_-]|changeme|example|(.)\1{5}")),
        flag(value.rlike(r"^(AKIA|ASIA|ghp_|gho_|ghs_|github_pat_|xox[abp]-|sk-|sk_live_|pk_live_|glpat-|AIza|eyJ|npm_)")),
        flag(before.rlike(r"[:=][ \t]{0,2}[\"']?$")),
        flag(before.rlike(r"[\"']$") & after.rlike(r"^[\"']")),
        flag(before.rlike(NEAR_GOOD)),
        flag(F.concat(before, F.lit(" "), after).rlike(NEAR_BAD)),
        flag(path.rlike(PATH_BAD)),
        flag(value.startswith("-----BEGIN")),
        F.coalesce(likelihood, F.lit(0.0)),
    )


def let(value: Column, body) -> Column:
    """``body`` of ``value``, which is evaluated once however often the body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def marked(text: Column) -> Column:
    """``text`` cut at its candidates: an array of text and candidate in turn, text first and last; each candidate begins with U+0002.

    A U+0001 or U+0002 of the text itself becomes a space, so that places stay. A null text is an empty one.
    """
    clean = F.translate(F.coalesce(text, F.lit("")), "\x01\x02", "  ")
    return F.split(F.regexp_replace(clean, f"({PATTERN})", "\x01\x02$1\x01"), "\x01")


def _running(sizes: Column) -> Column:
    """For each element the sum of those before it. Takes time with the square of the array's length: for short arrays."""
    begin = F.struct(F.array().cast("array<long>").alias("out"), F.lit(0).cast("long").alias("at"))
    return F.aggregate(sizes, begin, lambda acc, n: F.struct(F.concat(acc["out"], F.array(acc["at"])).alias("out"), (acc["at"] + n).alias("at")), lambda acc: acc["out"])


def placed(parts: Column) -> Column:
    """The candidates of ``marked`` parts: an array of (start, value, before, after).

    Parts are taken in chunks of ``CHUNK`` candidates, with the running length of chunks and, within one, of parts: time
    grows with the text, also where a text has very many candidates.
    """
    hits = ((F.size(parts) - 1) / 2).cast("int")
    count = F.ceil(hits / F.lit(CHUNK)).cast("int")
    chunks = F.transform(F.sequence(F.lit(0), count - 1), lambda c: F.slice(parts, c * (2 * CHUNK) + 1, F.lit(2 * CHUNK + 1)))
    # characters of a full chunk: without its last part, which begins the next, and without the candidates' marks
    length = lambda chunk: F.aggregate(F.slice(chunk, 1, 2 * CHUNK), F.lit(-CHUNK).cast("long"), lambda acc, p: acc + F.length(p))

    def one(chunk: Column, base: Column) -> Column:
        inner = F.sequence(F.lit(0), ((F.size(chunk) - 1) / 2).cast("int") - 1)
        found = lambda at: F.transform(
            inner,
            lambda i: F.struct(
                (base + at[i * 2 + 1] - i).cast("int").alias("start"),
                F.substring(chunk[i * 2 + 1], 2, 1 << 30).alias("value"),
                F.right(chunk[i * 2], F.lit(BEFORE)).alias("before"),
                F.left(chunk[i * 2 + 2], F.lit(AFTER)).alias("after"),
            ),
        )
        return let(_running(F.transform(chunk, lambda p: F.length(p).cast("long"))), found)

    whole = let(chunks, lambda cs: let(_running(F.transform(cs, length)), lambda bases: F.flatten(F.transform(cs, lambda chunk, c: one(chunk, bases[c])))))
    return F.when(hits > 0, whole).otherwise(F.array().cast("array<struct<start:int,value:string,before:string,after:string>>"))


def scored(parts: Column, path: Column, score) -> Column:
    """The candidates of ``marked`` parts with their probability: an array of (start, length, value, probability)."""
    where = F.coalesce(path, F.lit(""))
    known = F.transform(placed(parts), lambda c: F.struct(c["start"].alias("start"), c["value"].alias("value"), features(c["value"], c["before"], c["after"], where, score.table).alias("x")))
    return F.transform(known, lambda c: F.struct(c["start"].alias("start"), F.length(c["value"]).alias("length"), c["value"].alias("value"), score(c["x"]).alias("probability")))


def labelled_findings(spark: SparkSession, n: int = 6000) -> DataFrame:
    """Labelled findings to train from: value, before, after, path, label (1 a secret). ``n`` rows at most, the same every time.

    Secrets are keys of the shapes that services issue beside words and signs of assignment; the rest are what the patterns
    also catch: digests, ids, card numbers, versions, placeholders, names and long words.
    """
    i = F.col("id")
    hex_ = F.sha2(i.cast("string").cast("binary"), 512)
    b62 = F.regexp_replace(F.base64(F.unhex(hex_)), "[+/=]", "")
    pick = lambda seed, *options: F.element_at(F.array(*(F.lit(o) if isinstance(o, str) else o for o in options)), F.pmod(F.xxhash64(i, F.lit(seed)), F.lit(len(options))).cast("int") + 1)
    digits = F.substring(F.regexp_replace(hex_, "[a-f]", ""), 1, 16)
    name = pick(1, "token", "secret", "api_key", "password", "access_key", "auth", "credential")
    sign = pick(2, " = \"", "=", ": ", "=\"", ": \"", " = ", "='")
    word = pick(3, "thering ", "of the ", "entre la ", "und der ", "", "los de ", "config ")
    good = pick(4, F.left(hex_, F.lit(40)), F.left(hex_, F.lit(32)), F.left(b62, F.lit(40)), F.left(b62, F.lit(24)), F.concat(F.lit("AKIA"), F.upper(F.left(b62, F.lit(16)))), F.concat(F.lit("ghp_"), F.left(b62, F.lit(36))), F.concat(F.lit("sk_live_"), F.left(b62, F.lit(24))), F.left(hex_, F.lit(64)))
    uuid = F.concat_ws("-", F.substring(hex_, 1, 8), F.substring(hex_, 9, 4), F.substring(hex_, 13, 4), F.substring(hex_, 17, 4), F.substring(hex_, 21, 12))
    bad = pick(5, digits, F.concat(F.lit("your_"), name, F.lit("_here_1")), F.concat(F.lit("xxxxxxxxxxxxxxxx"), F.left(digits, F.lit(2))), F.left(hex_, F.lit(40)), uuid, F.concat(F.lit("version-1-2-"), F.left(digits, F.lit(4)), F.lit("-release")), F.concat(F.lit("example_"), name, F.lit("_1234")), F.concat(F.lit("thing_with_long_name_"), F.left(digits, F.lit(1))), F.concat(F.lit("img/2024/photo"), F.left(digits, F.lit(3)), F.lit("/large")), F.concat(F.left(digits, F.lit(8)), F.lit("-"), F.right(digits, F.lit(8))))
    bad_before = F.concat(word, pick(6, "commit ", "sha1 ", "checksum: ", "", "id=", "uuid ", "card ", "order ", "see ", "file "))
    own = F.pmod(i, F.lit(5))  # 2 of 5 are secrets
    rows = spark.range(n).select(
        F.when(own < 2, good).otherwise(bad).alias("value"),
        F.when(own < 2, F.concat(word, F.when(F.pmod(F.xxhash64(i, F.lit(7)), F.lit(8)) == 0, "key ").otherwise(F.concat(name, sign)))).when(bad.rlike("your_|xxxx|example_"), F.concat(word, name, sign)).otherwise(bad_before).alias("before"),
        F.when(own < 2, F.when(F.right(sign, F.lit(1)).isin("\"", "'"), F.concat(F.right(sign, F.lit(1)), F.lit(" "), word)).otherwise(F.concat(F.lit(" "), word))).otherwise(F.concat(F.lit(" "), word)).alias("after"),
        F.when((own >= 2) & (F.pmod(F.xxhash64(i, F.lit(8)), F.lit(3)) == 0), "tests/fixtures/data").otherwise(pick(9, "src1", "src12", "src7", "lib/config")).alias("path"),
        F.when(own < 2, 1.0).otherwise(0.0).alias("label"),
    )
    # digests as such are no secrets: the same value counts by its surroundings
    return rows


def train(findings: DataFrame, *, trees: int = 16, depth: int = 6, seed: int = 7):
    """A Spark ML random forest of labelled findings (value, before, after, path, label; a null counts as empty), and its table of likelihoods."""
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.functions import array_to_vector

    c = lambda name: F.coalesce(F.col(name), F.lit(""))
    table = likelihoods(findings)
    rows = findings.where(F.col("label").isNotNull()).select(array_to_vector(features(c("value"), c("before"), c("after"), c("path"), table)).alias("features"), F.col("label").cast("double").alias("label"))
    return RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=seed).fit(rows), table


@dataclass(frozen=True)
class Score:
    """A function from an array of features to a column, and the table of likelihoods that the features need."""

    of: Callable[[Column], Column]
    table: list[float]

    def __call__(self, x: Column) -> Column:
        return self.of(x)


def as_column(trained) -> Score:
    """The forest that ``train`` gives as a column: the mean of its trees' shares of secrets."""
    model, table = trained

    def tree(node, x: Column) -> Column:
        if node.getClass().getSimpleName() == "LeafNode":
            stats = list(node.impurityStats().stats())
            return F.lit(float(stats[1] / sum(stats)))
        split = node.split()
        return F.when(x[split.featureIndex()] <= F.lit(float(split.threshold())), tree(node.leftChild(), x)).otherwise(tree(node.rightChild(), x))

    roots = [t._call_java("rootNode") for t in model.trees]
    return Score(lambda x: reduce(lambda a, b: a + b, (tree(r, x) for r in roots)) / F.lit(float(len(roots))), table)


def _source(path: str | None) -> Column:
    return F.col(path) if path else F.lit("")


def with_findings(docs: DataFrame, score, *, text: str = "text", path: str | None = "source", name: str = "findings") -> DataFrame:
    """``docs`` with an array column of (start, length, value, probability) for every candidate, secrets or not.

    A null or empty text has an empty array, a null path is an empty one; rows, their order and other columns stay, except
    that a column called ``name`` is replaced. Candidates do not overlap; ties do not arise.
    """
    return docs.withColumn(name, let(marked(F.col(text)), lambda parts: scored(parts, _source(path), score)))


def findings(docs: DataFrame, score, *, id: str = "doc_id", text: str = "text", path: str | None = "source", threshold: float = THRESHOLD) -> DataFrame:
    """One row per candidate: ``id``, start, length (characters), value_sha256, probability, is_secret.

    Documents without candidates, null and empty texts give none; repeated rows give theirs each, null ids stay. A null path is an
    empty one. Other columns are not read, whatever their names. An empty table gives an empty result.
    """
    # exploded as an expression: of a column, Spark would infer a filter on its size and evaluate it twice
    found = let(marked(F.col(text)), lambda parts: scored(parts, _source(path), score))
    rows = docs.select(F.col(id).alias("id"), F.explode(found).alias("f"))
    return rows.select(F.col("id").alias(id), F.col("f.start").cast("long").alias("start"), F.col("f.length").cast("long").alias("length"), F.sha2(F.col("f.value").cast("binary"), 256).alias("value_sha256"), F.round("f.probability", 9).alias("probability"), (F.col("f.probability") > threshold).alias("is_secret"))


def redacted(docs: DataFrame, score, *, text: str = "text", path: str | None = "source", mark: str = "[SECRET]", threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with every secret in ``text`` replaced by ``mark``. A text without any, or null, is unchanged; in one with a secret U+0001 and U+0002 become spaces."""

    def joined(parts: Column, found: Column) -> Column:
        part = lambda p, i: F.when(i % 2 == 0, p).when(found[((i - 1) / 2).cast("int")]["probability"] > threshold, F.lit(mark)).otherwise(F.substring(p, 2, 1 << 30))
        return F.when(F.exists(found, lambda f: f["probability"] > threshold), F.array_join(F.transform(parts, part), ""))

    changed = let(marked(F.col(text)), lambda parts: let(scored(parts, _source(path), score), lambda found: joined(parts, found)))
    return docs.withColumn(text, F.coalesce(changed, F.col(text)))
