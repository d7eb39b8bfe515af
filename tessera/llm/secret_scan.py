"""Secret scanning: candidates by pattern, false positives removed by a random forest.

DataFrame functions and ``pyspark.ml`` only.

Candidates are the whole value (6 or more printable characters, quoted or up to white space, a comma or a semicolon)
that stands after an assignment to a name such as ``password``, and runs of 8 or more token characters that have a
digit.  Neither is longer than 2,048 characters: longer runs are data, no credentials.  Texts are read in chunks of
8,192 characters with margins, cut where the place in the text is known; a candidate belongs to the chunk that it
starts in, so time is in proportion to the text and its places are exact whatever the text's length.  One pattern
takes a chunk apart into gaps and candidates.

The forest sees a candidate's length, its transitions between kinds of characters, how much of it dictionary words
cover, the path that it or its row stands in, and the words around it (up to 160 characters of its line before it).
It is trained from labelled findings: by default a generated set of secrets and of look-alikes (checksums, ids,
versions, hosts, card numbers, placeholders, plain words ...), or any table of (text, label) rows.

Null and empty texts have no candidates.  Repeated rows give repeated findings, and redaction treats them alike; rows
with a null doc_id are scanned like any other and told apart by their texts.  Ties can't be: a place has one finding.
Long texts are scanned whole.  Other columns, whatever their names, are not looked at.
"""

from __future__ import annotations

import json
import random
import string

from pyspark.ml import PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.pipeline import Pipeline
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: Published prefixes of credentials.
KNOWN = r"^(?:AKIA|ASIA|ghp_|gho_|ghu_|ghs_|ghr_|github_pat_|glpat-|xox[abprs]-|sk_live_|rk_live_|sk-|AIza|ya29\.|eyJ|npm_|pypi-|SG\.|hf_)"
SECRET_NAMES = r"(?i)(?:pass(?:word|wd|phrase)?|pwd|secret|token|api[_-]?key|apikey|access[_-]?key|auth|bearer|credential|private[_-]?key|client[_-]?key|signing[_-]?key)"
BENIGN_NAMES = r"(?i)(?:sha\d*|md5|commit|revision|checksum|digest|hash|uuid|guid|build|version|etag|isbn|doi|order|invoice|phone|card|serial|issue|ticket|example|sample|dummy|public)"
DICTIONARY = r"(?i)(?:password|passwd|secret|token|example|sample|dummy|change|placeholder|your|here|test|demo|default|null|none|true|false|admin|user|name|mail|http|https|www|com|org|net|html|index|file|path|data|build|release|version|alpha|beta|stable|linux|windows|server|client|config|main|image|images|page|news|article|item|product|insert|value|string|redacted|hidden|foo|bar|baz|xxx+|\*{3,}|abc|key)"
#: Characters of a chunk, of the margins before and after it, and the most that a candidate may have.
CHUNK, BEFORE, LONGEST = 8192, 512, 2048
_RUN = r"A-Za-z0-9+/_.~\-"
#: A secret name, the rest of its identifier and the assignment.
_ASSIGNED = SECRET_NAMES + r"(?:s|[_\-][A-Za-z0-9_\-]{0,20}|[0-9]{1,4}|Id|ID|Value)?[\"'\]]{0,2}[ \t]{0,64}(?:=>|:=|==|[:=])[ \t]{0,64}"
_VALUE = "{6,%d}+" % LONGEST
#: A gap from the last match on (or else each place without one would be tried anew), then an assignment and a value in
#: double or single quotes or a bare one, or a run with a digit.  Secret names begin with one of a few letters.
CANDIDATE = (
    rf"(?s)\G(.*?)(?:(?=[abcpstABCPST])({_ASSIGNED})(?:\"([^\"\r\n]{_VALUE})\"|'([^'\r\n]{_VALUE})'|([^\s\"'`,;]{_VALUE})(?=[\s\"'`,;]|\z))"
    rf"|((?<![{_RUN}])(?=[A-Za-z+/_.~\-]*+[0-9])[{_RUN}]{{8,{LONGEST}}}+(?![{_RUN}])={{0,2}}))"
)
FEATURES = ["size", "digits", "upper", "letters", "symbols", "changes", "distinct", "hex", "only_digits", "dotted", "covered", "vowels", "path", "assigned", "quoted", "named", "benign", "known"]


def _chunks(docs: DataFrame, path: Column) -> DataFrame:
    """doc_id, text_key, doc_path, k, shift (characters before the chunk and its margin), chunk."""
    n = F.length("text")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_key"), path.alias("doc_path"), F.when(n <= CHUNK, F.col("text")).alias("short"), F.when(n > CHUNK, F.encode("text", "UTF-32")).alias("points"), n.alias("n"))
    each = texts.where("n > 0").select("*", F.explode(F.sequence(F.lit(0), ((F.col("n") - 1) / CHUNK).cast("int"))).alias("k"))
    each = each.withColumn("shift", F.greatest(F.col("k") * CHUNK - BEFORE, F.lit(0)))
    cut = F.decode(F.substring("points", F.col("shift") * 4 + 1, F.lit(4 * (CHUNK + BEFORE + LONGEST + 512))), "UTF-32")
    return each.select("doc_id", "text_key", "doc_path", "k", "shift", F.coalesce("short", cut).alias("chunk"))


def candidates(docs: DataFrame, path_col: str | None = None) -> DataFrame:
    """doc_id, text_key, doc_path, token, start (code points before it), left and right context: one row a candidate."""
    path = F.col(path_col).cast("string") if path_col else F.lit(None).cast("string")
    found = _chunks(docs, path).withColumn("found", F.regexp_extract_all("chunk", F.lit(CANDIDATE), F.lit(0))).where(F.size("found") > 0)

    # Small structs are made of a chunk's matches before these become rows, so that no row holds the chunk again.
    def placed(match: Column, nth: Column) -> Column:
        part = lambda groups: F.regexp_replace(match, F.lit(CANDIDATE), F.lit(groups))
        skipped = F.aggregate(F.slice("found", F.lit(1), nth), F.lit(0), lambda n, m: n + F.length(m))
        token = part("$3$4$5$6")
        # What stands before the candidate: all but itself and a closing quote.
        return F.struct(token.alias("token"), (skipped + F.length(match) - F.length(token) - F.when(part("$3$4") != "", 1).otherwise(0)).alias("at"))

    def around(x: Column) -> Column:
        token, at = x["token"], x["at"]
        left = F.substring("chunk", F.greatest(at - 159, F.lit(1)), F.least(at, F.lit(160)))
        return F.struct(token.alias("token"), at.alias("at"), F.regexp_extract(left, r"[^\r\n]*\z", 0).alias("left"), F.substring("chunk", at + F.length(token) + 1, F.lit(40)).alias("right"))

    each = found.select("doc_id", "text_key", "doc_path", "k", "shift", F.explode(F.transform(F.transform("found", placed), around)).alias("x"))
    start = (F.col("shift") + F.col("x.at")).cast("long")
    own = (F.col("start") >= F.col("k") * CHUNK) & (F.col("start") < (F.col("k") + 1) * CHUNK)
    return each.withColumn("start", start).where(own).select("doc_id", "text_key", "doc_path", "x.token", "start", "x.left", "x.right")


def _share(token: Column, drop: str) -> Column:
    """Share of the characters that ``drop`` takes away."""
    return 1.0 - F.length(F.regexp_replace(token, drop, "")) / F.length(token)


def with_features(found: DataFrame) -> DataFrame:
    t, left = F.col("token"), F.col("left")
    kinds = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(t, "[a-z]+", "a"), "[A-Z]+", "b"), "[0-9]+", "c"), "[^abc]+", "d")
    flag = lambda c: F.coalesce(c, F.lit(False)).cast("double")
    values = {
        "size": F.length(t).cast("double"),
        "digits": _share(t, "[0-9]"),
        "upper": _share(t, "[A-Z]"),
        "letters": _share(t, "[A-Za-z]"),
        "symbols": _share(t, "[^A-Za-z0-9]"),
        "changes": (F.length(kinds) - 1) / F.length(t),
        "distinct": F.size(F.array_distinct(F.split(t, ""))).cast("double"),
        "hex": flag(t.rlike("^(?:[0-9a-f]+|[0-9A-F]+)$")),
        "only_digits": flag(t.rlike("^[0-9.\\-]+$")),
        "dotted": flag(t.rlike("\\.[A-Za-z0-9]+\\.") | t.rlike("\\.(?:com|org|net|html?|png|jpe?g|js|css|txt|py|java)$")),
        "covered": _share(t, DICTIONARY),
        "vowels": _share(t, "(?i)[aeiou]"),
        "path": flag(left.rlike("(?:://|/|\\\\|@)[^\\s]*$") | t.rlike("/[a-z]+/") | F.col("doc_path").rlike("(?i)(?:test|example|sample|mock|fixture|lock)")),
        "assigned": flag(left.rlike("[=:]\\s*[\"'`]?$")),
        "quoted": flag(left.rlike("[\"'`]$") & F.col("right").rlike("^[\"'`]")),
        "named": flag(left.rlike(SECRET_NAMES + "[A-Za-z0-9_\"'\\]\\-]{0,20}\\s*(?:[=:]|is)?[>=]?\\s*[\"'`]?$")),
        "benign": flag(left.rlike(BENIGN_NAMES + "[^\\s]{0,12}\\s*[=:]?\\s*[\"'`]?$")),
        "known": flag(t.rlike(KNOWN)),
    }
    return found.select("*", *[v.alias(k) for k, v in values.items()])


def generated_findings(n: int = 2000, seed: int = 11) -> list[tuple[str, int]]:
    """Labelled lines, half of them with a secret: (text, 1 or 0).  The same for the same arguments."""
    r = random.Random(seed)
    pick = lambda alphabet, k: "".join(r.choice(alphabet) for _ in range(k))
    mixed, hexa = string.ascii_letters + string.digits, "0123456789abcdef"
    word = lambda: pick("bcdfghlmnprst", 1) + pick("aeiou", 1) + pick("lmnrst", 1) + pick("aeiou", 1) + pick("nrst", 1)
    prose = lambda: " ".join(word() for _ in range(r.randint(2, 6)))
    name = lambda: r.choice(["token", "password", "passwd", "pwd", "secret", "api_key", "apikey", "access_key", "auth_token", "client_secret", "API_KEY", "DB_PASSWORD", "SECRET_KEY", "private_key", "aws_secret_access_key"])

    def value() -> str:
        k = r.randrange(11)
        if k > 8:
            v = word()[:4] + pick("!@#$%&*?+", 1) + pick(mixed, r.randint(4, 8)) + pick("!@#$%&*?", r.randint(0, 2)) + pick(string.digits, r.randint(1, 4))
        elif k < 3:
            v = pick(hexa, r.choice([16, 18, 20, 24, 32, 40, 40, 48, 64]))
        elif k < 5:
            v = pick(mixed, r.randint(16, 48))
        elif k == 5:
            v = pick(mixed + "+/", r.choice([32, 40, 44])) + r.choice(["", "=", "=="])
        elif k == 6:
            v = r.choice(["ghp_", "sk_live_", "AIza", "xoxb-", "glpat-", "hf_"]) + pick(mixed, 36)
        elif k == 7:
            v = "AKIA" + pick(string.ascii_uppercase + string.digits, 16)
        else:
            v = pick(string.ascii_letters, 5) + pick(string.digits, 3) + pick(mixed + "_-", r.randint(4, 10))
        return v.upper() if r.random() < 0.1 else v

    def secret() -> str:
        q = r.choice(['"', '"', "'", ""])
        end = r.choice(["", "", "", ".", ";", ",", "###", "$$$", "!!", "%%%"])
        if r.random() < 0.1:
            return f"{prose()} {r.choice(['ghp_', 'sk_live_', 'AKIA', 'AIza'])}{pick(mixed, 32)} {prose()}"
        line = f"{name()}{r.choice(['=', ' = ', ': ', ':', ' => ', ':      ', '\\t=\\t'])}{q}{value()}{q}"
        line = line.upper() if r.random() < 0.05 else line
        return f"{prose()} {line}{end} {prose()}"

    def other() -> str:
        k = r.randrange(18)
        d = lambda m: pick(string.digits, m)
        end = r.choice(["", "", "", ".", ",", "###", "$$$", "!!"])
        v = [
            lambda: d(16),
            lambda: ".".join(str(r.randrange(256)) for _ in range(4)),
            lambda: f"{word()}.{d(2)}@mail{d(1)}.example.com",
            lambda: f"commit {pick(hexa, 40)}",
            lambda: f"{r.choice(['sha256', 'md5', 'checksum', 'digest', 'etag'])}{r.choice([': ', '=', ' '])}{pick(hexa, r.choice([32, 40, 64]))}",
            lambda: f"uuid {pick(hexa, 8)}-{pick(hexa, 4)}-{pick(hexa, 4)}-{pick(hexa, 4)}-{pick(hexa, 12)}",
            lambda: f"{r.randint(1990, 2030)}-{d(2)}-{d(2)}T{d(2)}:{d(2)}",
            lambda: f"{word()}-{word()}-{d(1)}.{d(2)}.{d(1)}",
            lambda: f"https://{word()}.example.org/{word()}/{d(6)}/{word()}.html",
            lambda: f"/usr/lib/{word()}/{word()}{d(2)}/{word()}.py",
            lambda: f"{name()} = {r.choice(['changeme', 'your_token_here', 'password123', 'xxxxxxxxxxxx', 'placeholder1', 'example-token-1', 'test_secret_1', 'insert_key_here1'])}",
            lambda: f"{word()}{word()}{word()}{d(2)}",
            lambda: f"{word()}_{word()}_{d(3)}_{word()}",
            lambda: f"+{d(1)} ({d(3)}) 555-{d(4)} order {d(10)}",
            lambda: f"{r.choice(['version', 'build', 'id', 'serial'])}={d(4)}.{d(3)}.{d(4)}",
            lambda: f"{name()}: {r.choice(['required', 'expired', 'optional', 'invalid', word() + word()])}",
            lambda: f"{r.choice(['secret', 'token', 'auth', 'password'])} = {r.choice(['None', 'null', 'get_token()', 'os.environ[1]', '<' + word() + '>', '${' + word().upper() + '}', '********'])}      ",
            lambda: f"{name()}: {word()}{word()} {prose()}",
        ][k]()
        return f"{prose()} {v}{end} {prose()}"

    return [(secret(), 1) if k % 2 else (other(), 0) for k in range(n)]


def train(spark: SparkSession, findings: DataFrame | None = None, trees: int = 24, depth: int = 7, seed: int = 11) -> PipelineModel:
    """The forest.  ``findings``: (text, label 0 or 1); each candidate of a text has the text's label."""
    if findings is None:
        rows = json.dumps([{"text": t, "label": y} for t, y in generated_findings()])
        findings = spark.range(1).select(F.explode(F.from_json(F.lit(rows), "array<struct<text string, label int>>")).alias("x")).select("x.*")
    numbered = findings.select(F.xxhash64("text", "label").alias("doc_id"), "text", "label")
    rows = with_features(candidates(numbered)).join(numbered.select("doc_id", F.col("label").cast("double").alias("label")), "doc_id").select("label", *FEATURES)
    forest = RandomForestClassifier(labelCol="label", featuresCol="features", numTrees=trees, maxDepth=depth, featureSubsetStrategy="sqrt", seed=seed)
    return Pipeline(stages=[VectorAssembler(inputCols=FEATURES, outputCol="features"), forest]).fit(rows)


def scan(docs: DataFrame, model: PipelineModel, threshold: float = 0.5, path_col: str | None = None) -> DataFrame:
    """doc_id, start, length, kind, score, is_secret, token_sha256: one row per candidate, with its place to redact it.

    More columns: text_key (hash of the row's text), token.
    """
    scored = model.transform(with_features(candidates(docs, path_col))).withColumn("score", vector_to_array("probability")[1])
    kind = F.when(F.col("known") > 0, "known format").when(F.col("named") > 0, "assignment").otherwise("token")
    return scored.select("doc_id", "start", F.length("token").cast("long").alias("length"), kind.alias("kind"), F.round("score", 6).alias("score"), (F.col("score") >= threshold).alias("is_secret"), F.sha2("token", 256).alias("token_sha256"), "text_key", "token")


def redact(docs: DataFrame, model: PipelineModel, mark: str = "[SECRET]", threshold: float = 0.5) -> DataFrame:
    """The documents with each secret replaced by ``mark``; nothing else changes, no document goes."""
    found = scan(docs, model, threshold).where("is_secret").dropDuplicates(["doc_id", "text_key", "start"])
    # Back to front, so that places before a replacement stay right.
    spans = found.groupBy("doc_id", "text_key").agg(F.sort_array(F.collect_list(F.struct("start", "length")), asc=False).alias("spans"))
    other = spans.withColumnsRenamed({"doc_id": "_t_id", "text_key": "_t_key", "spans": "_t_spans"})
    same = docs["doc_id"].cast("long").eqNullSafe(other["_t_id"]) & (F.xxhash64(docs["text"]) == other["_t_key"])
    joined = docs.join(other, same, "left")
    clean = F.aggregate("_t_spans", F.col("text"), lambda text, s: F.concat(F.substr(text, F.lit(1), s["start"].cast("int")), F.lit(mark), F.substr(text, (s["start"] + s["length"] + 1).cast("int"))))
    return joined.withColumn("text", F.when(F.col("_t_spans").isNull(), F.col("text")).otherwise(clean)).select(docs.columns)
