"""Secret scanning with a random forest that removes false positives. DataFrame operations and JVM models only.

Candidates are

* unbroken runs of 16 or more token characters with a digit, "=" only at their end, so that ``KEY=`` stands before a value and not in it;
* whatever is assigned to a key word, of 4 or more characters, with or without digits and in any characters;
* private keys in armour, from their first to their last line.

Each gets features: length, classes of characters and changes between them, the mean log-likelihood of its character transitions, coverage by
words, whether it stands in a path or URL or looks like an identifier of a known kind, and the words around it. Transitions and words are
those of the labelled findings' benign candidates and surroundings (``language``). A random forest trained on labelled findings keeps the
secrets.

Labelled findings are a parameter, rows of ``before``, ``candidate``, ``after`` and ``label``. ``labelled_findings`` makes a set: secrets
of common kinds in assignments, and look-alikes that scanners report wrongly (commit ids, checksums, UUIDs, file names, card and order
numbers, placeholders, dates), all from a hash of the row's number, cut out of lines by ``candidates`` itself, so they have the form that a
scan gives. At most ``TRAINING_ROWS`` rows are learnt from; the driver gets ``DICTIONARY`` words and a table of transitions of them.

Texts without a candidate are dropped by two patterns at the scan; only lines with a candidate are cut up further.

Defined cases: null and empty texts have no findings; a null ``doc_id`` is kept; repeated rows give repeated findings; findings labelled
all alike, or none, leave every candidate with that label's score (0.5 without any); an empty table gives no rows; other columns are
ignored; very long texts and lines are cut at matches, in time linear in their length.
"""

from __future__ import annotations

import math

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ID, Scratch, texts

TRAINING_ROWS = 6000
CUT = 0.5
TREES, DEPTH = 40, 9
#: A run's start is looked for once, and its digit without going back: time is linear in the text.
_RUN = "A-Za-z0-9_+/.-"
CANDIDATE = rf"(?<![{_RUN}])(?=[A-Za-z_+/.-]*+[0-9])(?:[{_RUN}]{{16,}}|[{_RUN}]{{15}}(?==(?![{_RUN}=]))|[{_RUN}]{{14}}(?===(?![{_RUN}=])))(?:={{1,2}}(?![{_RUN}=]))?"

# Words beside secrets, words beside look-alikes, words of code and prose, common letter pairs.
KEYS = "token|secret|password|passwd|pwd|api[_-]?key|apikey|access[_-]?key|private[_-]?key|auth|bearer|credential|client[_-]?secret"
BENIGN = "commit|sha1|sha256|sha|md5|checksum|digest|uuid|guid|etag|rev|revision|version|build|order|invoice|card|phone|isbn|tracking|serial|example|image|file|path|src|href|url|integrity|parcel|id"
WORDS = "config|test|main|handler|user|data|name|file|image|http|www|com|org|static|asset|index|page|module|version|release|build|install|package|node|server|client|service|manager|factory|controller|example|placeholder|changeme|dummy|sample|your|the|and|with|from|for|jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec|report|final|draft|copy|photo|video|document|backup|update"
PAIRS = "th|he|in|er|an|re|on|at|en|nd|ti|es|or|te|of|ed|is|it|al|ar|st|to|nt|ng|se|ha|as|ou|io|le|ve|co|me|de|hi|ri|ro|ic|ne|ea|ra|ce|li|ch|ll|be|ma|si|om|ur"
#: A private key in armour, over lines.
ARMOUR = r"-----BEGIN [A-Z0-9 ]{0,40}PRIVATE KEY-----[A-Za-z0-9+/=\s,:-]*?-----END [A-Z0-9 ]{0,40}PRIVATE KEY-----"
ARMOUR_HINT = "PRIVATE KEY-----"
#: Words that the labelled findings teach, and characters that transitions tell apart: letters, digits, others.
DICTIONARY, SYMBOLS = 800, 28
#: A key word and its sign; what is assigned to one, in quotes up to the same quote; both as Java reads them.
ASSIGNMENT = rf"(?i:{KEYS})(?:[_-][A-Za-z0-9]{{1,12}})?[\"']?[ \t]{{0,3}}(?::=|=>|[=:])[ \t]{{0,3}}"
#: Without quotes a value ends at white space, a comma, a semicolon or a query's next name; closing brackets at its end aren't its own.
#: The few groups that repeat are bounded: Java's regular expressions take stack for each round of a group, and none for a class.
_CLASS = r"[^\s\"'`,;&]"
_BARE = rf"(?=[^\s\"'`,;]{{4}}){_CLASS}*(?:&(?![A-Za-z0-9_-]+=){_CLASS}*){{0,20}}(?<![.:)}}\]>&])"
ASSIGNED = "|".join([*(rf"(?<={q})(?<={ASSIGNMENT}{q})[^{q}\n]{{4,200}}(?={q})" for q in "\"'`"), rf"(?<=[=:> \t])(?<={ASSIGNMENT}){_BARE}"])
SCAN = f"{ASSIGNED}|{CANDIDATE}"


def _words(c: Column) -> Column:
    """The letter runs of a text, those in camel case apart, in lower case."""
    return F.regexp_extract_all(F.lower(F.regexp_replace(c, "([a-z])([A-Z])", "$1 $2")), F.lit("[a-z]{3,}"), F.lit(0))


def _symbol(c: Column) -> Column:
    """A character's number, from 0: letters, then digits as one, then all others as one."""
    code = F.ascii(c)
    return F.when(code.between(97, 122), code - 97).when(code.between(48, 57), 26).otherwise(27)


class Language:
    """What benign text looks like: its words, and the log-likelihood of each character after each (``SYMBOLS`` squared numbers)."""

    def __init__(self, words: list[str], transitions: list[float]) -> None:
        self.words, self.transitions = words, transitions

    def likelihood(self, c: Column) -> Column:
        """Mean log-likelihood of a text's transitions; 0 for a single character. One pass: the characters' numbers beside themselves, one on."""
        codes = F.transform(F.split(F.lower(c), ""), _symbol)
        table = F.array(*map(F.lit, self.transitions))
        n = F.length(c) - 1
        steps = F.zip_with(F.slice(codes, F.lit(1), n), F.slice(codes, F.lit(2), n), lambda a, b: F.get(table, a * SYMBOLS + b))
        return F.when(n > 0, F.aggregate(steps, F.lit(0.0), lambda s, x: s + x) / n).otherwise(0.0)

    def covered(self, c: Column) -> Column:
        """How many characters stand in known words."""
        known = F.array(*map(F.lit, self.words)) if self.words else F.array().cast("array<string>")
        return F.aggregate(F.filter(_words(c), lambda w: F.array_contains(known, w)), F.lit(0), lambda s, w: s + F.length(w))


def language(findings: DataFrame) -> Language:
    """From labelled findings (``before``, ``candidate``, ``after``, ``label``), and the fixed words."""
    benign = F.when(F.col("label") < 0.5, F.col("candidate")).otherwise("")
    said = findings.select(F.explode(_words(F.concat_ws(" ", F.coalesce("before", F.lit("")), benign, F.coalesce("after", F.lit(""))))).alias("w"))
    fixed = findings.sparkSession.createDataFrame([(w,) for w in WORDS.split("|")], "w string")
    counted = said.filter(F.length("w") <= 24).unionByName(fixed).groupBy("w").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "w").limit(DICTIONARY)
    words = [r["w"] for r in counted.collect()]
    times = [[0.5] * SYMBOLS for _ in range(SYMBOLS)]
    for w in words:
        for a, b in zip(w, w[1:], strict=False):
            times[ord(a) - 97][ord(b) - 97] += 1
    return Language(words, [math.log(x / sum(row)) for row in times for x in row])


def features(before: Column, c: Column, after: Column, known: Language) -> dict[str, Column]:
    n = F.length(c).cast("double")
    share = lambda pattern: F.regexp_count(c, F.lit(pattern)) / n
    low = F.lower(c)
    near = F.lower(F.right(before, F.lit(48)))
    return {
        "length": n,
        "digits": share("[0-9]"),
        "upper": share("[A-Z]"),
        "lower": share("[a-z]"),
        "marks": share("[_+/=.-]"),
        "hex": share("[0-9a-fA-F]"),
        "distinct": F.size(F.array_distinct(F.split(c, ""))) / n,
        "class_changes": share("(?<=[0-9])(?=[A-Za-z])|(?<=[A-Za-z])(?=[0-9])|(?<=[a-z])(?=[A-Z])|(?<=[A-Za-z0-9])(?=[_+/=.-])"),
        "longest_digits": F.length(F.regexp_replace(c, r"^.*?([0-9]*).*$", "$1")) / n,
        "pairs": F.regexp_count(low, F.lit(f"(?=(?:{PAIRS}))")) / n,
        "transitions": known.likelihood(c),
        "repeats": share(r"(.)(?=\1)"),
        "fixed_words": (n - F.length(F.regexp_replace(low, f"(?:{WORDS})", ""))) / n,
        "dictionary": known.covered(c) / n,
        "uuid": c.rlike("^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-").cast("double"),
        "digits_only": c.rlike("^[0-9.-]+$").cast("double"),
        "path": (c.contains("/") & c.rlike(r"[A-Za-z_-]{3,}/|\.[a-z]{2,4}$") | F.right(before, F.lit(1)).isin("/", "#", "@", "?", "&")).cast("double"),
        "extension": c.rlike(r"\.(?:js|css|png|jpg|html|json|py|txt|pdf|gz|zip|com|org|net)$").cast("double"),
        "prefix": c.rlike("^(?:AKIA|ghp_|gho_|sk[-_]|xox[abp]-|eyJ|glpat-|AIza|-----BEGIN)").cast("double"),
        "code": c.rlike(r"^[$%{<(\[]|[)>}\]]$|^[A-Za-z_]+(?:\.[A-Za-z_]+)+$|::|\(").cast("double"),
        "key_before": near.rlike(f"(?:{KEYS})[^a-z0-9]{{0,8}}$").cast("double"),
        "key_near": near.rlike(f"(?:{KEYS})").cast("double"),
        "benign_before": near.rlike(rf"\b(?:{BENIGN})[^a-z0-9]{{0,8}}$").cast("double"),
        "assigned": F.rtrim(near).rlike("[=:][\"' ]{0,3}$").cast("double"),
        "quoted": (F.right(before, F.lit(1)).isin('"', "'", "`") & F.left(after, F.lit(1)).isin('"', "'", "`")).cast("double"),
    }


def candidates(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``line`` and ``start`` (from 0, code points within the line), ``before``, ``candidate``, ``after``."""
    hit = F.lit(SCAN)
    has = lambda c: F.col(c).rlike(CANDIDATE) | F.col(c).rlike(ASSIGNMENT)
    lengths = lambda a, n: F.aggregate(F.slice(a, 1, n), F.lit(0), lambda s, x: s + F.length(x))
    breaks = lambda x: F.length(x) - F.length(F.replace(x, F.lit("\n"), F.lit("")))
    broken = lambda a, n: F.aggregate(F.slice(a, 1, n), F.lit(0), lambda s, x: s + breaks(x))
    some = texts(docs).filter(has("text") | F.contains("text", F.lit(ARMOUR_HINT)))
    armoured = F.contains("text", F.lit(ARMOUR_HINT))
    cut = some.select(
        ID,
        F.when(armoured, F.split("text", ARMOUR, -1)).otherwise(F.array("text")).alias("parts"),
        F.when(armoured, F.regexp_extract_all("text", F.lit(ARMOUR), F.lit(0))).otherwise(F.array().cast("array<string>")).alias("keys"),
    )
    tail = lambda x: F.substring_index(x, "\n", -1)
    # where a part begins: the line, and the place in it
    parts = cut.select(ID, "keys", "parts", F.posexplode("parts").alias("k", "part"))
    line0 = broken(F.col("parts"), F.col("k")) + broken(F.col("keys"), F.col("k"))
    lead = F.when(F.col("k") > 0, tail(F.get("keys", F.col("k") - 1))).otherwise("")
    lead = F.when(F.contains(F.coalesce(lead, F.lit("")), F.lit("-----")), F.length(lead)).otherwise(0)
    placed = parts.select(ID, "part", line0.alias("line0"), lead.alias("lead"), F.get("keys", F.col("k")).alias("key"), F.get("parts", F.col("k") + 1).alias("next"))
    armour = placed.filter("key is not null").select(
        ID,
        (F.col("line0") + breaks(F.col("part"))).cast("int").alias("line"),
        (F.length(tail(F.col("part"))) + F.when(F.contains("part", F.lit("\n")), 0).otherwise(F.col("lead"))).cast("int").alias("start"),
        tail(F.col("part")).alias("before"),
        F.col("key").alias("candidate"),
        F.substring_index(F.coalesce("next", F.lit("")), "\n", 1).alias("after"),
    )
    lines = placed.filter(has("part")).select(ID, "line0", "lead", F.posexplode(F.split("part", "\n", -1)).alias("line", "one")).filter(has("one"))
    # the pieces between candidates; a candidate's place follows from the lengths before it
    found = lines.select(ID, (F.col("line0") + F.col("line")).cast("int").alias("line"), F.when(F.col("line") == 0, F.col("lead")).otherwise(0).alias("lead"), F.split("one", SCAN, -1).alias("gaps"), F.regexp_extract_all("one", hit, F.lit(0)).alias("found"))
    each = found.select(ID, "line", "lead", "gaps", "found", F.posexplode("found").alias("k", "candidate"))
    start = F.col("lead") + lengths(F.col("gaps"), F.col("k") + 1) + lengths(F.col("found"), F.col("k"))
    runs = each.select(ID, "line", start.cast("int").alias("start"), F.element_at("gaps", F.col("k") + 1).alias("before"), "candidate", F.element_at("gaps", F.col("k") + 2).alias("after"))
    return runs.unionByName(armour)


def labelled_findings(spark: SparkSession, rows: int = TRAINING_ROWS) -> DataFrame:
    """``before``, ``candidate``, ``after``, ``label``: made findings, the same ones each time."""
    r = lambda i: F.sha2(F.concat(F.lit(f"finding {i} "), F.col("id").cast("string")).cast("binary"), 512)
    pick = lambda words, i: F.element_at(F.array(*map(F.lit, words)), (F.pmod(F.xxhash64(F.lit(i), "id"), F.lit(len(words))) + 1).cast("int"))
    base64 = F.regexp_replace(F.base64(F.unhex(r(1))), "[+/=\r\n]", "x")
    digits = F.regexp_replace(F.translate(r(2), "abcdef", "123456"), "^0", "4")
    hex_ = r(3)
    prose = pick(["thonder that ", "la reelle de ", "und der enge ", "the report of ", "see also "], "prose")
    key = pick(["token", "api_key", "secret", "password", "access_key", "client_secret", "auth_token", "TOKEN", "apikey", "API_KEY", "export SECRET", "x?token"], "key")
    sign = pick([' = "', ': "', "='", " = '", ": ", "=", '":"'], "sign")
    close = pick(['"', '"', "'", "'", "", "", '"'], "sign")
    secret = pick(range(14), "kind").cast("int")
    alike = pick(range(20), "kind").cast("int")
    letters = F.translate(F.substring(base64, 1, 48), "0123456789", "qKzWxjVbHd")
    # a token that tells its kind needs no key word
    alone = secret.isin(2, 3, 5) & pick([True, False, False], "alone") | (secret == 13)
    good = [
        F.substring(hex_, 1, 40), F.substring(base64, 1, 40), F.concat(F.lit("AKIA"), F.upper(F.substring(hex_, 1, 16))), F.concat(F.lit("ghp_"), F.substring(base64, 1, 36)), F.upper(F.substring(hex_, 1, 40)), F.concat(F.lit("sk-"), F.substring(base64, 1, 32)),
        F.substring(letters, 1, 24), F.concat(pick(["hunter", "dragon", "Summer", "winter", "Qwerty", "monkey"], "word"), F.substring(digits, 1, F.lit(1) + F.length(F.substring(digits, 1, 1)))), F.concat(F.substring(letters, 1, 4), pick(["!", "$", "%", "@", ":", "#"], "mark"), F.substring(base64, 9, 6)), F.substring(base64, 1, 12), F.concat(F.substring(base64, 1, 30), F.lit("==")), F.concat(F.substring(base64, 1, 43), F.lit("=")),
        F.concat(pick(["correct", "purple", "seven", "little", "frozen"], "w1"), F.lit("-"), pick(["horse", "lantern", "rivers", "engine"], "w2"), F.lit("-"), pick(["battery", "garden", "copper", "signal"], "w3")),
        F.concat(F.lit("-----BEGIN "), pick(["RSA ", "", "EC ", "OPENSSH "], "armour"), F.lit("PRIVATE KEY-----\n"), F.substring(base64, 1, 60), F.lit("\n"), F.substring(base64, 9, 60), F.lit("\n-----END "), pick(["RSA ", "", "EC ", "OPENSSH "], "armour"), F.lit("PRIVATE KEY-----")),
    ]
    uuid = F.concat_ws("-", *(F.substring(hex_, a, k) for a, k in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))))
    name = F.concat(pick(["main", "image", "report-final", "index.page", "user_handler", "package"], "name"), F.lit("-"), F.substring(digits, 1, 4))
    bad = [
        (F.lit("commit "), F.substring(hex_, 1, 40), F.lit(" fixes")), (F.lit('sha256: "'), F.substring(hex_, 1, 64), F.lit('"')), (F.lit('id = "'), uuid, F.lit('"')), (F.lit("/static/"), F.concat(name, F.lit("."), F.substring(hex_, 1, 16), F.lit(".js")), F.lit('"')),
        (prose, F.substring(digits, 1, 16), F.lit(" and")), (F.lit("order "), F.substring(digits, 1, 18), F.lit(".")), (F.concat(key, sign), F.concat(pick(["xxxxxxxxxxxxxxxx", "your-token-here-", "changeme-example", "0000000000000000", "placeholder-1234"], "filler"), F.lit("1")), close),
        (F.lit("on "), F.concat(F.lit("2023-01-"), F.substring(digits, 1, 2), F.lit("T10.00.00-report")), F.lit(" ")), (prose, F.concat(name, F.lit("ControllerFactory"), F.substring(digits, 1, 2)), F.lit("(")), (F.lit("mail "), F.concat(name, F.lit(".mail.example.com")), F.lit(" ")), (F.lit("(checksum "), F.substring(hex_, 1, 32), F.lit(")")),
        (F.concat(key, pick([": ", " = ", "=", ' = "'], "ask")), pick("required please expired invalid string None null true false undefined password changeme missing rotated nothing should reset empty optional unknown about never given default hidden vergessen obligatoire".split(), "plain"), pick([" ", " ", " ", '" '], "ask")),
        (F.concat(key, pick([": ", " = ", "="], "ask2")), pick(["os.environ", "$TOKEN", "${PASSWORD}", "config.password", "self.token", "request.headers", "settings.SECRET", "String", "process.env.KEY", "********", "%s", "https://example.com/login", "xxxxxxxx"], "code"), F.lit(" ")),
        (F.lit("?page="), F.concat(name, F.lit("-index-page")), F.lit("&")),
        (pick(["parcel ", "account ", "reference ", "ticket "], "number"), F.concat(pick(["DE", "1Z", "FR76", "RX", "GB29"], "country"), F.substring(digits, 1, F.lit(12) + F.length(pick(["", "a", "aaaa"], "more")))), F.lit(" arrived")),
        (F.concat(key, F.lit(" = ")), F.concat(pick(["read", "ask", "input", "load", "prompt"], "call"), pick([".", "_"], "dot"), pick(["password", "value", "secret", "line"], "what"), pick(["()", "(user)", "(key)"], "paren")), F.lit(" ")),
        (F.concat(key, F.lit(": ")), F.concat(pick("tomorrow always between another gestern später immer zwischen demain toujours ensuite mañana siempre entonces welcome letters numbers contact support people garden window morning service".split(), "later"), pick(["", "", "", "lich", "ment", "mente", "ness", "heit", "ung"], "ending")), F.concat(F.lit(" "), pick("and morgen pour que of the".split(), "next"))),
        (F.lit("build "), F.concat(F.lit("v"), F.substring(digits, 1, 2), F.lit(".4.1-release-"), F.substring(hex_, 1, 12)), F.lit(" out")),
        (F.lit('integrity="sha384-'), F.substring(base64, 1, 60), F.lit('"')),
        (F.concat(pick(["trace", "request", "session log", "etag", "object", "key id"], "id"), pick([" id ", ": ", " "], "idsign")), F.concat(F.substring(hex_, 1, 32)), F.lit(" done")),
    ]
    is_secret = F.pmod("id", F.lit(2)) == 0
    chosen = lambda options, at: F.element_at(F.array(*options), at + 1)
    made = spark.range(0, rows, 1, 4).select(
        F.col("id").alias(ID),
        F.when(is_secret, F.concat(prose, F.when(alone, "").otherwise(F.concat(key, sign)), chosen(good, secret), F.when(alone, "").otherwise(close), F.lit(" "))).otherwise(F.concat(prose, *(chosen([b[k] for b in bad], alike) for k in range(3)))).alias("text"),
    )
    return candidates(made).select("before", "candidate", "after", F.when(F.pmod(ID, F.lit(2)) == 0, 1.0).otherwise(0.0).alias("label"))


def _featured(rows: DataFrame, known: Language) -> tuple[DataFrame, list[str]]:
    made = features(F.col("before"), F.col("candidate"), F.col("after"), known)
    return rows.withColumns({f"f_{k}": v.cast("double") for k, v in made.items()}), [f"f_{k}" for k in made]


class SecretModel:
    """What keeps secrets: the benign language and the forest over features."""

    def __init__(self, known: Language, forest: PipelineModel) -> None:
        self.known, self.forest = known, forest


def train(findings: DataFrame, most: int = TRAINING_ROWS) -> SecretModel | float:
    """The model, or a constant score where the labels tell nothing."""
    known = findings.filter(F.col("label").isNotNull() & F.col("candidate").isNotNull()).select(F.coalesce("before", F.lit("")).alias("before"), "candidate", F.coalesce("after", F.lit("")).alias("after"), F.col("label").cast("double").alias("label"))
    n, mean = known.agg(F.count("*"), F.avg("label")).first()
    if not n or mean in (0.0, 1.0):
        return 0.5 if not n else float(mean)
    if n > most:
        known = known.filter(F.pmod(F.xxhash64("before", "candidate"), F.lit(1 << 32)) < int((1 << 32) * most / n))
    scratch = Scratch(findings.sparkSession, "findings")
    known = scratch.save(known)
    benign = language(known)
    rows, names = _featured(known, benign)
    rows = scratch.save(rows)  # the forest reads them many times
    forest = RandomForestClassifier(labelCol="label", featuresCol="features", numTrees=TREES, maxDepth=DEPTH, seed=11, featureSubsetStrategy="sqrt", minInstancesPerNode=2)
    return SecretModel(benign, Pipeline(stages=[VectorAssembler(inputCols=names, outputCol="features", handleInvalid="keep"), forest]).fit(rows))


def score(rows: DataFrame, model: SecretModel | float) -> DataFrame:
    """``rows`` (``before``, ``candidate``, ``after``) with ``score``."""
    if isinstance(model, float):
        return rows.withColumn("score", F.lit(model))
    made, _ = _featured(rows, model.known)
    return model.forest.transform(made).withColumn("score", vector_to_array("probability")[1]).select(*rows.columns, "score")


def scan(docs: DataFrame, findings: DataFrame | None = None, cut: float = CUT) -> DataFrame:
    """Findings kept: ``doc_id``, ``line``, ``start``, ``length``, ``secret_sha256`` (never the secret), ``score``."""
    model = train(labelled_findings(docs.sparkSession) if findings is None else findings)
    kept = score(candidates(docs), model).filter(F.col("score") >= cut)
    return kept.select(ID, "line", "start", F.length("candidate").alias("length"), F.sha2(F.col("candidate").cast("binary"), 256).alias("secret_sha256"), F.round("score", 6).alias("score"))
