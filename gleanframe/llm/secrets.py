"""Secret scans: pattern candidates, and a random forest that tells false positives.

Candidates are long runs of token characters, and shorter values that are assigned to a secret's name or stand
before the host of a URL. Each has features from its length, its character transitions, the part that dictionary words
cover, how path-like it is, and the words before and after it. A random forest trained on labelled findings gives
the part of its trees that call it a secret. The fitted trees become column expressions, so scanning is one pass of
DataFrame functions inside the row: no join, no shuffle, no Python.

The same extraction makes the candidates of training and of scanning. ``labelled_findings`` puts generated values
into texts of many shapes and into a passage of every document, extracts, and labels what it finds by
whether it is a planted secret; the candidates of all whole documents are its look-alikes. Weights keep the balance between
them, however many documents there are. The dictionary (words by number of documents) and the transitions (pairs of
characters in those words) are counted in all documents.

Edge cases: null and empty texts have no findings; every candidate of a text of any length is looked at; repeated
rows and ids get findings each; an empty table gives an empty result; further columns of the input, whatever
their names, are kept by ``redact`` and ignored by ``scan``.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanframe.llm.common import cut, free

#: A value after a secret's name and an assignment, or between ``://user:`` and ``@``, or a long run; quotes, ``=`` and ``:`` are no part of a run.
_NAME = r"(?i:passw(?:or)?d|passphrase|pwd|secret|token|credentials?|api[_ -]?key|access[_ -]?key|private[_ -]?key|auth)"
_VALUE = r"[^\s\"'`<>,;()\[\]{}&]"
CANDIDATE = (
    rf"(?<=[=:\s\"'`])(?<=[:=]\s{{0,2}}[\"'`]?)(?<={_NAME}[\"'`]?\s{{0,2}}[:=]{{1,2}}\s{{0,2}}[\"'`]?){_VALUE}{{5,}}(?:&(?!\w+=){_VALUE}*){{0,20}}"
    r"|(?<=:)(?<=://[^\s:/@]{1,40}:)[^\s:/@]{6,}(?=@)"
    r"|(?<![A-Za-z0-9+/_.\-])[A-Za-z0-9+/_.\-]{16,}={0,2}"
)
AROUND = 40
MASK = "[SECRET]"
#: Words in the dictionary.
DICTIONARY = 3000
#: What the generated lines weigh together, and what the documents' own candidates do for each document, which together weigh as so many at most.
LINES, DOCUMENTS = 12_000, 2000
#: Partitions of the training rows, at least, and rows in one: what the forest draws depends on it.
PARTS, PART_ROWS = 8, 20_000
#: Lengths whose sums are taken together, so that offsets need no sum over all candidates before.
RUN = 256
#: Words that name a secret, or something else that looks like one.
SECRET_WORDS = ("token", "secret", "passw", "passphrase", "pwd", "credential", "api_key", "apikey", "api-key", "api key", "access_key", "access key", "private_key", "auth", "bearer", "client_id")
OTHER_WORDS = ("sha1", "sha256", "sha512", "md5", "commit", "checksum", "digest", "etag", "uuid", "revision", "integrity", "hash", "http", "www", "href", "version", "file", "path", "import", "class")
STOPS = ("example", "placeholder", "changeme", "your", "dummy", "sample", "insert", "redacted", "xxxx", "todo", "none", "null", "true", "false")
#: Words of code and configuration, beside those of the documents.
CODE_WORDS = (
    "account", "admin", "array", "build", "class", "client", "code", "common", "config", "content", "count", "create", "data", "default", "field", "file", "format", "group", "handle", "home", "http",
    "image", "index", "input", "item", "level", "library", "list", "local", "mail", "main", "manager", "message", "model", "module", "name", "node", "number", "object", "output", "page", "password",
    "path", "process", "project", "public", "query", "request", "response", "result", "secret", "server", "service", "size", "source", "string", "system", "table", "test", "text", "time", "token",
    "type", "update", "user", "value", "version", "word", "access", "private", "docs", "static", "assets", "util", "helper", "factory", "provider", "internal", "example",
)
FEATURES = (
    "length", "digits", "uppers", "switches", "repeats", "distinct", "hex_only", "numeric", "symbols", "likely", "covered", "stop", "slashes", "dots", "dashes",
    "assigned", "quoted", "secret_before", "other_before", "url_before", "at_after", "known_form",
)
_CHARS = "abcdefghijklmnopqrstuvwxyz0123456789"
_KNOWN_FORM = r"^(AKIA[0-9A-Z]{16}$|gh[pousr]_|xox[baprs]-|[sr]k_(live|test)_|glpat-|AIza|eyJ[A-Za-z0-9_-]+\.)"


class Language:
    """The dictionary and the transitions that features are measured by."""

    def __init__(self, words: dict[str, int]) -> None:
        self.words = sorted({*words, *CODE_WORDS})
        n, size = {}, len(_CHARS) + 1
        for w, times in [*words.items(), *((w, 1) for w in CODE_WORDS)]:
            at = [_CHARS.find(c) + 1 for c in w]
            for a, b in zip(at, at[1:], strict=False):
                n[a, b] = n.get((a, b), 0) + times
        rows = [sum(n.get((a, b), 0) for b in range(size)) for a in range(size)]
        #: Log of the probability of each pair of characters given the first, smoothed; others count as place 0.
        self.pairs = [math.log((n.get((a, b), 0) + 1) / (rows[a] + size)) for a in range(size) for b in range(size)]


def language(docs: DataFrame, text_col: str = "text", words: int = DICTIONARY) -> Language:
    """The ``words`` words that most documents hold, three at least, and their transitions."""
    found = F.array_distinct(F.regexp_extract_all(F.lower(docs[text_col]), F.lit(r"\b[a-z]{4,20}\b"), F.lit(0)))
    counted = docs.select(F.explode(found).alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    top = counted.where("n >= 3").orderBy(F.desc("n"), "word").limit(words).collect()
    return Language({r["word"]: r["n"] for r in top})


def _part(candidate: Column, pattern: str) -> Column:
    return F.regexp_count(candidate, F.lit(pattern)) / F.length(candidate)


def _has(context: Column, words: Iterable[str]) -> Column:
    return context.rlike("(" + "|".join(map(re.escape, words)) + ")").cast("double")


def features(before: Column, candidate: Column, after: Column, known: Language) -> list[Column]:
    """The ``FEATURES`` of a candidate between two contexts, each a double."""
    left, low = F.lower(before), F.lower(candidate)
    spaced = F.lower(F.regexp_replace(candidate, "(?<=[a-z])(?=[A-Z])", " "))
    parts = F.regexp_extract_all(spaced, F.lit("[a-z]{4,}"), F.lit(0))
    covered = F.aggregate(F.filter(parts, lambda w: w.isin(known.words)), F.lit(0), lambda t, w: t + F.length(w))
    size = len(_CHARS) + 1
    places = F.transform(F.split(low, ""), lambda c: F.instr(F.lit(_CHARS), c))
    pairs = F.array(*map(F.lit, known.pairs))
    step = lambda s, x: F.struct((s["sum"] + F.element_at(pairs, s["last"] * size + x + 1)).alias("sum"), x.alias("last"))
    likely = lambda p: F.aggregate(F.slice(p, F.lit(2), F.size(p)), F.struct(F.lit(0.0).alias("sum"), F.element_at(p, 1).alias("last")), step, lambda s: s["sum"])
    found = [
        F.log2(F.length(candidate)),
        _part(candidate, "[0-9]"),
        _part(candidate, "[A-Z]"),
        _part(candidate, "[a-z](?=[0-9A-Z])|[0-9](?=[A-Za-z])|[A-Z](?=[0-9])"),
        _part(candidate, r"(.)(?=\1)"),
        F.array_size(F.array_distinct(F.split(low, ""))) / F.least(F.length(candidate), F.lit(36)),
        candidate.rlike("^([0-9a-f]+|[0-9A-F]+)$").cast("double"),
        candidate.rlike(r"^[0-9.\-]+$").cast("double"),
        _part(candidate, "[^A-Za-z0-9+/_.=-]"),
        likely(places) / F.greatest(F.length(candidate) - 1, F.lit(1)),
        covered / F.length(candidate),
        _has(low, STOPS),
        _part(candidate, "/"),
        _part(candidate, "[.]"),
        _part(candidate, "[_-]"),
        left.rlike(r"[=:]\s*[\"'`]?$").cast("double"),
        left.rlike("[\"'`]$").cast("double"),
        _has(left, SECRET_WORDS),
        _has(left, OTHER_WORDS),
        left.rlike(r"://[^\s]*$").cast("double"),
        after.rlike("^@").cast("double"),
        candidate.rlike(_KNOWN_FORM).cast("double"),
    ]
    return [F.coalesce(c.cast("double"), F.lit(0.0)).alias(n) for c, n in zip(found, FEATURES, strict=True)]


# --- candidates


def candidates(docs: DataFrame, text_col: str, found: str, gaps: str) -> DataFrame:
    """``docs`` with the candidates of each text, and what stands before, between and after them (null without a candidate)."""
    rows = docs.withColumn(found, F.coalesce(F.regexp_extract_all(docs[text_col], F.lit(CANDIDATE), F.lit(0)), F.array().cast("array<string>")))
    return rows.withColumn(gaps, F.when(F.size(found) > 0, F.split(docs[text_col], CANDIDATE, -1)))


def context(found: str, gaps: str, i: Column) -> tuple[Column, Column]:
    """What stands before and after the ``i``-th candidate (from 1): the last characters up to it, the candidate before it included."""
    gap = lambda k: F.get(gaps, k)
    short = lambda c: F.right(F.coalesce(c, F.lit("")), F.lit(AROUND))
    before = F.right(F.concat(short(gap(i - 2)), short(F.get(found, i - 2)), short(gap(i - 1))), F.lit(AROUND))
    after = F.left(F.concat(F.left(gap(i), F.lit(AROUND)), F.left(F.coalesce(F.get(found, i), F.lit("")), F.lit(AROUND))), F.lit(AROUND))
    return before, after


# --- labelled findings


def labelled_findings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = LINES, seed: int = 0) -> DataFrame:
    """``(before, candidate, after, label, weight)``: what extraction finds in texts with planted secrets and look-alikes.

    Each document gets a generated line, or as many as make ``n`` lines; a line is made around a value from a hash of its document
    and stands in the document's first passage, so that its neighbours are real words. Together the lines weigh ``n``. A candidate is a
    secret if it is a line's planted value; all others, those of all whole documents included, are not, but candidates of
    the documents after a secret's name, or of a secret's known form, teach nothing, since nobody has looked at them.
    """
    spark = docs.sparkSession
    texts = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text")).where("text is not null")
    count = texts.count()
    real = candidates(texts, "text", "found", "gaps").where("size(found) > 0").select("found", "gaps", F.explode(F.sequence(F.lit(1), F.size("found"))).alias("i"))
    before, after = context("found", "gaps", F.col("i"))
    real = real.select(before.alias("before"), F.element_at("found", F.col("i")).alias("candidate"), after.alias("after"), F.lit(0).alias("label"))
    real = real.where((_has(F.lower("before"), SECRET_WORDS) == 0) & ~F.col("before").rlike(r"[=:]\s*[\"'`]?$") & ~F.col("candidate").rlike(_KNOWN_FORM))
    real = real.withColumn("weight", F.lit(min(1.0, DOCUMENTS / max(count, 1))))

    salt = F.lit(f"{seed}:")
    hashed = lambda k: F.sha2(F.concat(salt, F.lit(f"{k}:"), F.col("id").cast("string")), 512)
    draw = lambda k, m: F.pmod(F.xxhash64("id", F.lit(k), salt), F.lit(m)).cast("int")
    pick = lambda k, options: F.element_at(F.array(*map(F.lit, options)), draw(k, len(options)) + 1)
    hexes = lambda k, size: F.substring(hashed(k), 1, size)
    base = lambda k: F.regexp_replace(F.base64(F.unhex(hashed(k))), r"[=\s]", "")
    alnum = lambda k, size: F.substring(F.regexp_replace(base(k), "[+/]", ""), 1, size)
    words = lambda k, m, sep: F.concat_ws(sep, *(pick(k + j, CODE_WORDS) for j in range(m)))
    letters = lambda k, size: F.translate(F.substring(hashed(k), 1, size), "0123456789abcdef", "eanirstlodumchbg")
    mixed = lambda k: F.concat(F.initcap(letters(k, 4)), F.substring(hashed(k + 1), 1, 2), pick(k + 2, ("!", "$", "&", "#", "*", "%", "@9", "?")), alnum(k + 3, 5))

    name = pick(1, ("token", "secret", "password", "api_key", "access_key", "auth_token", "client_secret", "private_key", "SECRET_KEY", "passwd", "credentials", "API-KEY", "apiKey", "AWS_SECRET_ACCESS_KEY", "STRIPE_SECRET_KEY", "DATABASE_PASSWORD"))
    assign = pick(2, (' = "', '="', ": ", "=", " = '", '": "', ": '", " := \"", " = "))
    named, plain = F.concat(name, assign), pick(3, ("the value of ", "see ", "id ", "from ", "", "in ", "and "))
    other = F.concat(pick(4, ("commit", "sha256", "md5", "checksum", "etag", "uuid", "revision", "sha1", "digest", "hash", "integrity", "build")), pick(5, (" ", ": ", "=", " = ", '="')))
    query = F.concat(F.lit("https://api."), pick(6, CODE_WORDS), F.lit(".com/v1?"), name, F.lit("="))
    value = F.element_at(F.array(hexes(10, 32), hexes(11, 40), hexes(12, 64), alnum(13, 20), alnum(14, 24), F.substring(base(15), 1, 40), F.upper(hexes(16, 40)), F.concat(alnum(17, 22), F.lit("=="))), draw(7, 8) + 1)
    prefixed = F.element_at(F.array(F.concat(F.lit("AKIA"), F.upper(alnum(20, 16))), *(F.concat(F.lit(p), alnum(21, 32)) for p in ("ghp_", "xoxb-", "sk_live_", "glpat-", "AIza"))), draw(8, 6) + 1)
    kinds = [
        (named, value, 1), (named, value, 1), (named, value, 1), (query, value, 1), (named, mixed(30), 1), (named, F.concat(letters(35, 5), number := F.lpad(draw(36, 10_000).cast("string"), 4, "0"), F.lit("!"), letters(37, 3)), 1),
        (plain, prefixed, 1), (named, prefixed, 1), (named, F.concat(F.lit("eyJhbGciOi"), alnum(40, 30), F.lit("."), alnum(41, 40)), 1), (F.lit("Authorization: Bearer "), value, 1),
        (F.concat(F.lit("postgres://"), pick(42, CODE_WORDS), F.lit(":")), F.concat(alnum(43, 10), number), 1),
        (other, hexes(50, 40), 0), (other, hexes(51, 64), 0), (other, hexes(52, 32), 0), (other, F.concat(hexes(53, 12), F.lit("."), words(54, 1, "")), 0),
        (plain, F.concat_ws("-", hexes(55, 8), hexes(56, 4), hexes(57, 4), hexes(58, 12)), 0), (plain, words(60, 4, "_"), 0), (plain, words(64, 4, "."), 0), (plain, words(68, 3, "/"), 0), (plain, F.upper(words(72, 4, "_")), 0),
        (F.lit("file /usr/"), F.concat(words(76, 3, "/"), F.lit(".txt")), 0), (F.lit("https://www."), F.concat(words(80, 2, "."), F.lit(".com/"), words(82, 2, "-")), 0),
        (named, words(84, 3, "_"), 0), (named, words(87, 2, "."), 0), (named, F.concat(words(90, 1, ""), F.lit("_"), words(91, 1, "")), 0), (named, F.repeat(pick(92, ("x", "*", "a", "0", "-", ".")), 20), 0),
        (named, pick(93, ("your_token_goes_here", "REPLACE_WITH_YOUR_KEY", "example_secret_value", "changeme", "insert-api-key-here", "<password>", "${PASSWORD}", "os.environ", "required", "string", "config.password", "placeholder")), 0),
        (plain, F.repeat(pick(94, ("-", "=", "_", ".", "ha", "la", "no")), 20), 0), (plain, F.concat(number, F.lpad(draw(95, 1_000_000).cast("string"), 6, "0"), F.lpad(draw(96, 1_000_000).cast("string"), 6, "1")), 0),
        (plain, letters(97, 24), 0), (plain, F.initcap(letters(98, 22)), 0), (plain, F.upper(letters(99, 20)), 0), (plain, F.concat_ws("-", letters(100, 9), letters(101, 10)), 0), (plain, F.concat(letters(102, 8), F.lit("."), letters(103, 9)), 0),
        (plain, F.concat(words(104, 1, ""), number, F.lit("."), words(105, 2, ".")), 0), (plain, F.concat_ws("", *(F.initcap(pick(106 + j, CODE_WORDS)) for j in range(4))), 0),
        (F.lit("data:image/png;base64,"), base(110), 0), (F.concat(F.lit("class "), F.lit("")), F.concat_ws("", *(F.initcap(pick(111 + j, CODE_WORDS)) for j in range(4)), F.lit("Token")), 0),
    ]
    made = F.array(*(F.struct(b.alias("lead"), c.cast("string").alias("value"), F.lit(y).alias("label")) for b, c, y in kinds))
    made = F.element_at(made, F.pmod(F.col("id"), F.lit(len(kinds))).cast("int") + 1)
    each = max(1, -(-n // max(count, 1)))
    if count:
        rows = texts.select(F.xxhash64("doc_id", "text", F.lit(121), salt).alias("h"), F.left("text", F.lit(600)).alias("passage"))
        rows = rows.select(F.explode(F.sequence(F.lit(1), F.lit(each))).alias("j"), "h", "passage").select(F.xxhash64("h", "j").alias("id"), "passage")
    else:
        rows = spark.range(n).withColumn("passage", F.lit(None).cast("string"))
    lines = rows.select("passage", made.alias("r"), pick(120, ('"', '",', "'", "", "", "&x=1", " # note", ";")).alias("end"))
    head = F.regexp_extract(F.coalesce("passage", F.lit("")), r"(?s)^(.{0,200})\s", 1)
    tail = F.left(F.regexp_replace(F.coalesce("passage", F.lit("")), r"(?s)^.{0,200}\s", ""), F.lit(60))
    closing = F.when(F.col("r.lead").rlike("@$|://[^@]*:$"), F.concat(F.lit("@db."), "end")).otherwise(F.col("end"))
    lines = lines.select(F.concat(head, F.lit(" "), "r.lead", "r.value", closing, F.lit(" "), tail).alias("text"), F.col("r.value").alias("value"), F.col("r.label").alias("planted"))
    found = candidates(cut(lines), "text", "found", "gaps").where("size(found) > 0").select("*", F.explode(F.sequence(F.lit(1), F.size("found"))).alias("i"))
    candidate = F.element_at("found", F.col("i"))
    is_value = (candidate == F.col("value")) | ((F.length(candidate) >= F.length("value")) & F.startswith(candidate, F.col("value")))
    found = found.select(before.alias("before"), candidate.alias("candidate"), after.alias("after"), F.when(is_value, F.col("planted")).otherwise(0).alias("label"), (is_value | (_has(F.lower(before), SECRET_WORDS) == 0)).alias("sure"))
    return found.where("sure").drop("sure").withColumn("weight", F.lit(n / (each * max(count, 1)))).unionByName(real)


# --- the forest


class Forest:
    """Trees as nested tuples ``(feature, threshold, left, right)`` with votes 0.0 or 1.0 as leaves, and what features are measured by."""

    def __init__(self, trees: list, known: Language) -> None:
        self.trees, self.known = trees, known

    def vote(self, row: str) -> str:
        """SQL for the part of the trees that call ``row``, a struct of the ``FEATURES``, a secret."""

        def one(node) -> str:
            if isinstance(node, float):
                return f"{node}D"
            feature, threshold, left, right = node
            return f"CASE WHEN {row}.{FEATURES[feature]} <= {threshold!r}D THEN {one(left)} ELSE {one(right)} END"

        return f"(({' + '.join(map(one, self.trees))}) / {len(self.trees)})"


def _tree(lines: list[str]):
    """A tree from its printed form: ``If (feature i <= t)``, ``Else (feature i > t)`` and ``Predict: y``."""
    line = lines.pop(0).strip()
    if line.startswith("Predict"):
        return float(line.split(":")[1])
    feature, threshold = re.match(r"If \(feature (\d+) <= (\S+)\)", line).groups()
    left = _tree(lines)
    lines.pop(0)
    return (int(feature), float(threshold), left, _tree(lines))


def train(findings: DataFrame, known: Language, trees: int = 20, depth: int = 7) -> Forest:
    """A forest from ``(before, candidate, after, label, weight)``.

    Findings with the same features are one row that weighs as all of them. Of these rows, Spark's forest draws the thresholds that its trees
    choose from by a sample of its own (about 10,000 rows); each tree is then fitted to all rows.
    """
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.feature import VectorAssembler

    rows = findings.select(*features(F.col("before"), F.col("candidate"), F.col("after"), known), F.col("label").cast("double").alias("label"), "weight")
    rows = cut(rows.groupBy(*rows.columns).count().withColumn("weight", F.col("weight") * F.col("count")).drop("count"))
    # training passes over them again and again, and draws by their place, which is the same in every run
    rows = cut(rows.repartition(max(PARTS, rows.count() // PART_ROWS), *rows.columns).sortWithinPartitions(*rows.columns))
    if rows.select("label").distinct().count() < 2:
        return Forest([0.0], known)  # nothing to tell apart
    vectors = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(rows).select("features", "label", "weight")
    model = RandomForestClassifier(weightCol="weight", numTrees=trees, maxDepth=depth, seed=1, featureSubsetStrategy="onethird").fit(vectors)
    return Forest([_tree([x for x in t.toDebugString.splitlines()[1:] if x.strip()]) for t in model.trees], known)


def learn(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Forest:
    """A forest for these documents: dictionary, transitions and findings come from all of them."""
    return train(labelled_findings(docs, id_col, text_col), language(docs, text_col))


# --- scanning


def _judged(docs: DataFrame, forest: Forest, text_col: str, least: float, found: str, gaps: str, kept: str) -> DataFrame:
    """``docs`` with :func:`candidates` and ``kept``: a struct of ``place`` (from 1) and ``score`` for each one taken for a secret."""

    def described(i: Column) -> Column:
        before, after = context(found, gaps, i)
        return F.struct(i.alias("place"), *features(before, F.element_at(found, i), after, forest.known))

    rows = candidates(docs, text_col, found, gaps)
    rows = rows.withColumn(kept, F.when(F.size(found) > 0, F.transform(F.sequence(F.lit(1), F.size(found)), described)))
    judged = f"filter(transform(`{kept}`, r -> struct(r.place AS place, {forest.vote('r')} AS score)), r -> r.score >= {float(least)!r}D)"
    return rows.withColumn(kept, F.expr(judged))


def scan(docs: DataFrame, forest: Forest, id_col: str = "doc_id", text_col: str = "text", least: float = 0.5) -> DataFrame:
    """``(doc_id, start, length, secret_sha256, score)``, one row per secret; ``start`` counts characters from 0."""
    slim = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text"))
    rows = _judged(slim, forest, "text", least, "found", "gaps", "kept")
    # lengths of each gap and the candidate after it, summed by runs, so that an offset adds up one run and the runs' sums
    lengths = F.transform("found", lambda c, i: F.length(c) + F.length(F.get("gaps", i)))
    runs = F.transform(F.sequence(F.lit(0), F.floor((F.size("lengths") - 1) / RUN).cast("int")), lambda b: F.aggregate(F.slice("lengths", b * RUN + 1, F.lit(RUN)), F.lit(0), lambda t, x: t + x))
    rows = rows.withColumn("lengths", lengths).withColumn("runs", runs)
    total = lambda cells: F.aggregate(cells, F.lit(0), lambda t, x: t + x)

    def placed(s: Column) -> Column:
        place = s["place"]
        run = F.floor((place - 1) / RUN).cast("int")
        start = total(F.slice("runs", F.lit(1), run)) + total(F.slice("lengths", run * RUN + 1, (place - 1) % RUN)) + F.length(F.get("gaps", place - 1))
        secret = F.element_at("found", place)
        return F.struct(start.cast("long").alias("start"), F.length(secret).cast("long").alias("length"), F.sha2(secret, 256).alias("secret_sha256"), s["score"].alias("score"))

    # a filter before the generator would work out everything twice
    return rows.select("doc_id", F.explode_outer(F.transform("kept", placed)).alias("s")).where("s is not null").select("doc_id", "s.*")


def redact(docs: DataFrame, forest: Forest, text_col: str = "text", mask: str = MASK, least: float = 0.5) -> DataFrame:
    """``docs`` with every secret in the text replaced by ``mask``; rows without one stay as they are."""
    found, gaps, kept = (free(c, docs.columns) for c in ("found", "gaps", "kept"))
    rows = _judged(docs, forest, text_col, least, found, gaps, kept)
    hidden = F.map_from_arrays(F.transform(kept, lambda s: s["place"]), F.transform(kept, lambda s: F.lit(mask)))
    shown = F.transform(found, lambda c, i: F.concat(F.get(gaps, i), F.coalesce(hidden[i + 1], c)))
    text = F.when(F.size(kept) > 0, F.concat(F.array_join(shown, ""), F.element_at(gaps, -1))).otherwise(docs[text_col])
    return rows.select(*(text.alias(c) if c == text_col else docs[c] for c in docs.columns))
