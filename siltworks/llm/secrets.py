"""Secret scans: candidates by pattern, false positives removed by a random forest (operator 9). DataFrame expressions only."""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .base import documents, settle

#: Characters of text on either side that count as neighbouring words.
BESIDE = 64
#: Labelled findings that the forest is fitted on, at most.
TRAINING = 6000
TREES, DEPTH, SEED = 24, 8, 17
#: Votes from which a candidate is a secret.
CUT = 0.5
MASK = "[SECRET]"

# Words beside a candidate that speak for and against a secret, and parts of paths of examples.
NAMES = "token|secret|passwd|password|api_key|apikey|access_key|auth|bearer|credential|private_key"

# What stands right before an assigned value: a naming word, the rest of its name, a sign, perhaps a quote. It is only
# looked for after a sign, which is looked for first.
_SIGN = r"(?<=[=:>\s\"'])(?<=[=:]>?\s{0,3}[\"']?)"
_NAMED = rf"(?<=(?i:{NAMES})s?(?:[_\-0-9][A-Za-z0-9_\-]{{0,24}})?[\"']?\s{{0,3}}[=:]{{1,2}}>?\s{{0,3}}"
_TOKEN = r"[A-Za-z0-9+/_\-]"
#: Values of any length and kind behind a naming word with "=" or ":" (quoted ones to their quote); and runs of 16 or more
#: token characters with a digit anywhere among them, dots within, "=" as padding at their end only. All is possessive
#: and a run is entered at its start only, so that long runs cost one pass.
CANDIDATE = (
    rf"{_SIGN}(?:{_NAMED}[\"'])[^\s\"']++(?=[\"'])|{_NAMED}[\"']?)[^\s\"'`,;<>(){{}}\[\]&?=|]++(?:={{1,2}}+(?![^\s\"'&,;]))?)"
    rf"|(?<!{_TOKEN})(?<!{_TOKEN}\.)(?=[A-Za-z+/_.\-]*+[0-9])(?=[A-Za-z0-9+/_.\-]{{16}}){_TOKEN}++(?:\.{_TOKEN}++)*+(?:={{1,2}}+(?![A-Za-z0-9+/_=\-\"']))?"
)
HARMLESS = "commit|sha1|sha256|md5|checksum|digest|hash|uuid|revision|isbn|order|invoice|card|account|phone|example|sample|dummy"
EXAMPLES = "test|example|sample|fixture|docs|demo"
# Starts by which keys of known services show without a naming word.
PREFIXES = r"^(AKIA|ASIA|gh[pousr]_|github_pat_|glpat-|[srp]k_(live|test)_|xox[abprs]-|AIza|npm_|SG\.|eyJ)"
# Common words and parts of words whose letters do not look random.
DICTIONARY = (
    "the|and|ing|tion|ent|ment|for|with|that|this|from|have|key|user|name|data|file|test|example|sample|value|"
    "number|string|class|config|default|service|server|client|change|your|here|abc|123456|000000|xxxx|"
    "required|optional|none|null|true|false|self|environ|getpass|must|not|field|valid|expired|reset"
)
# Pairs of letters that follow one another often in words.
BIGRAMS = (
    "th|he|in|er|an|re|nd|at|on|nt|ha|es|st|en|ed|to|it|ou|ea|hi|is|or|ti|as|te|et|ng|of|al|de|se|le|sa|si|ar|ve|ra|ld|ur|io|co|me|ne|li|ce|ro|ma|el|il|us"
)
FEATURES = ("bigrams", "length", "digits", "uppers", "changes", "distinct", "hexes", "coverage", "path_example", "named", "assigned", "quoted", "harmless", "prefixed", "naming")


def features(rows: DataFrame) -> DataFrame:
    """Adds FEATURES, all doubles, to rows of candidate, before, after (its neighbours' text) and path."""
    c = F.col("candidate")
    n = F.greatest(F.length(c), F.lit(1)).cast("double")
    low = F.lower(F.coalesce("before", F.lit("")))
    kinds = F.translate(F.regexp_replace(F.regexp_replace(F.regexp_replace(c, "[a-z]", "a"), "[A-Z]", "A"), "[0-9]", "0"), "+/_=-", ".....")
    left = lambda pattern, s=c: F.length(F.regexp_replace(s, pattern, "")).cast("double")
    flag = lambda x: F.coalesce(x, F.lit(False)).cast("double")
    last = F.substring(low, -32, 32)
    return rows.withColumns({
        "length": F.length(c).cast("double"),
        "digits": 1 - left("[0-9]") / n,
        "uppers": 1 - left("[A-Z]") / n,
        # Character transitions: runs of one kind of character, for each character.
        "changes": F.length(F.regexp_replace(kinds, r"(.)\1+", "$1")).cast("double") / n,
        # And of letters: the part of neighbouring characters that words have.
        "bigrams": F.size(F.regexp_extract_all(F.lower(c), F.lit(f"(?=({BIGRAMS}))"), F.lit(1))).cast("double") / n,
        "distinct": F.size(F.array_distinct(F.split(c, ""))).cast("double") / n,
        "hexes": 1 - left("[0-9a-fA-F]") / n,
        "coverage": 1 - left(DICTIONARY, F.lower(c)) / n,
        "path_example": flag(F.lower("path").rlike(EXAMPLES)),
        "named": flag(last.rlike(NAMES)),
        "assigned": flag(low.rlike(r"[=:]\s*[\"']?$")),
        "quoted": flag(low.rlike("[\"']$") & F.coalesce("after", F.lit("")).rlike("^[\"']")),
        "prefixed": flag(c.rlike(PREFIXES)),
        "naming": flag(F.coalesce("after", F.lit("")).rlike("^[\"']?\\s*[=:]")),
        "harmless": flag(F.concat_ws(" ", last, F.lower(F.substring(F.coalesce("after", F.lit("")), 1, 24))).rlike(HARMLESS)),
    })


def labelled_findings(spark: SparkSession, n: int = TRAINING) -> DataFrame:
    """Findings with a label, 1 for a secret: `n` of them, made by rule from their number alone, the same each time.

    Secrets are random hex, base64 or prefixed keys: beside naming words, glued to names by "=" or ":" (also names without
    a naming word, and in URLs), prefixed keys and dotted tokens alone, or short passwords beside naming words. Others are numbers, identifiers, checksums, placeholders and
    compound words, some beside the same naming words or glued to other names, paths, and long names before a value.
    """
    i = F.col("id")
    hexes, b64 = F.col("hexes"), F.col("b64")
    pick = lambda salt, *xs: F.element_at(F.array(*[x if isinstance(x, Column) else F.lit(x) for x in xs]), (F.pmod(F.xxhash64(F.lit(salt), i), F.lit(len(xs))) + 1).cast("int"))
    size = (F.lit(20) + F.pmod(F.xxhash64(F.lit("n"), i), F.lit(24))).cast("int")
    digits = F.regexp_replace(F.conv(F.substring(hexes, 1, 15), 16, 10), "-", "")
    uuid = F.concat_ws("-", *[F.substring(hexes, a, k) for a, k in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])
    secret = F.col("label") == 1.0
    value = F.when(
        secret, pick("v", F.substring(hexes, 1, 40), F.substring(hexes, 1, 32), F.upper(F.substring(hexes, 1, 40)), F.substring(b64, 1, 40), F.expr("substring(translate(base64(unhex(sha2(concat('s', cast(id as string)), 256))), '=', ''), 1, 24)"), F.concat(F.lit("AKIA"), F.upper(F.substring(hexes, 1, 16))), F.concat(F.lit("ghp_"), F.substring(b64, 1, 36)), F.concat(F.lit("sk_live_"), F.substring(b64, 1, 24)))
    ).otherwise(
        pick("w", F.substring(F.rpad(digits, 19, "7"), 1, 16), F.substring(F.rpad(digits, 19, "3"), 1, 18), uuid, F.substring(hexes, 1, 40), hexes, F.concat(F.lit("your-api-key-example-"), F.pmod(i, F.lit(10)).cast("string")), F.concat(F.lit("xxxxxxxxxxxxxxxx"), F.pmod(i, F.lit(10)).cast("string")), F.concat(F.lit("default-user-service-config-"), F.pmod(i, F.lit(100)).cast("string")))
    )
    form = F.pmod(F.xxhash64(F.lit("k"), i), F.lit(10))
    key = pick("x", F.concat(F.lit("AKIA"), F.upper(F.substring(hexes, 1, 16))), F.concat(F.lit("ghp_"), F.substring(b64, 1, 36)), F.concat(F.lit("sk_live_"), F.substring(b64, 1, 24)))
    route = F.concat(pick("u", "/guide/config/page", "src/main/service/v", "//host.net/archive/", "usr/share/data/file-"), F.pmod(i, F.lit(1000)).cast("string"), pick("t", "", "/index", "/the-name-of-it"))
    name = F.concat(pick("A", "MY_SERVICE_V", "APP_CONFIG_", "aws_account_", "x-client-h"), F.pmod(i, F.lit(10)).cast("string"), pick("B", "_API_KEY", "_SECRET_TOKEN", "_HOST_NAME", "-auth-token"))
    web = F.translate(b64, "+/", "-_")
    dotted = pick("E", F.concat(F.lit("eyJ"), F.substring(web, 1, 17), F.lit(".eyJ"), F.reverse(web), F.lit("."), web), F.concat(F.lit("SG."), F.substring(web, 1, 22), F.lit("."), F.reverse(web)))
    key = F.when(form == 7, dotted).otherwise(key)
    low = F.translate(F.substring(F.translate(hexes, "0123456789", "ghkmprstwy"), 1, 8), "f", "o")
    short = pick("G", F.concat(low, F.pmod(i, F.lit(100)).cast("string")), F.substring(b64, 1, 10), F.substring(b64, 1, 14), F.translate(F.substring(b64, 1, 20), "0123456789+/", ""), F.concat(low, F.reverse(low)), F.concat(F.substring(b64, 1, 6), F.lit("!"), F.pmod(i, F.lit(50)).cast("string")), F.concat(F.lit("hunter"), F.pmod(i, F.lit(10)).cast("string"), low), F.concat(F.substring(low, 1, 6), F.pmod(i, F.lit(100)).cast("string"), pick("I", "secret", "Pass", "user", "key", "admin")))
    plain = pick("H", "required", "optional", "none", "None", "null", "true", "false", "string", "os.environ", "getpass.getpass", "self.token", "config.password", "must", "the", "not", "your-password", "changeme", "12", "3600", "a", "is", "xxxxxxxx", "expired", "reset")
    value = F.when(secret & (form == 8), short).when(~secret & (form == 8), plain).when(~secret & (form == 7), name).when(secret & form.isin(6, 7), key).when(~secret & (form == 6), route).otherwise(value)
    rows = spark.range(n).withColumn("label", F.pmod(F.xxhash64(F.lit("y"), i), F.lit(2)).cast("double")).withColumn("hexes", F.sha2(F.concat(F.lit("s"), i.cast("string")), 256))
    rows = rows.withColumn("b64", F.translate(F.base64(F.unhex(hexes)), "=", ""))
    rows = settle(rows.withColumn("candidate", value))
    value = F.col("candidate")
    hashlike = (F.length(value) >= 40) & ~secret
    before = F.when(
        form == 8, F.concat(pick("f", "the ", "set ", "", "with new "), pick("b", "token", "api_key", "password", "secret", "DB_PASSWORD", "auth"), pick("e", " = \"", "=", ": ", " = '", ": \""))
    ).when(
        secret & form.isin(3, 4, 5), F.concat(pick("g", "export ", "", "\n", "?", "&", "see https://host.net/a?"), pick("m", "api_key", "TOKEN", "auth_token", "client_secret", "password", "access_token", "STRIPE_KEY", "DB_PASS"), pick("l", "=", "=", ":", "=\"", "='"))
    ).when(secret & form.isin(6, 7), pick("a", "", "the ", "use ", "key ", "and then ", "- ", "see ", "X=")).when(
        secret, F.concat(pick("f", "the ", "set ", "", "with new "), pick("b", "token", "api_key", "password", "secret", "access_key", "auth", "TOKEN", "client credential"), pick("e", " = \"", "=", ": ", " = '", ": \""))
    ).when(~secret & (form == 6), pick("j", "see ", "https:", "path=", "at ", "url: ", "in ", "")).when(~secret & (form == 7), pick("D", "export ", "", "\n", "{\"", "?")).when(
        hashlike, F.concat(pick("h", "commit ", "sha1 ", "checksum: ", "md5 = ", "digest=\"", "revision ", "sha256=", "?commit="), F.lit(""))
    ).when(form.isin(3, 4), F.concat(pick("g", "export ", "", "\n", "?", "&", "see https://host.net/a?"), pick("i", "id", "uuid", "order", "page", "version", "card", "name"), pick("l", "=", "=", ":", "=\"", "='"))).otherwise(
        F.concat(pick("o", "in the ", "order ", "see ", "number ", "version ", "for token ", "and then ", "card "), pick("q", "", "", "", "= ", "\""))
    )
    after = F.when(~secret & (form == 7), pick("C", "=", "=\"", ": ", " = ", "\": \"")).when(before.endswith('"'), '" and').when(before.endswith("'"), "' and").otherwise(" and then")
    path = F.when(secret, pick("p", "src0", "app/settings", "deploy/env", "src7")).otherwise(pick("r", "src0", "docs/guide", "src3", "tests/fixtures", "app/main"))
    return rows.select("label", "candidate", before.alias("before"), after.alias("after"), path.alias("path"), size.alias("spare")).drop("spare")


def train(findings: DataFrame) -> RandomForestClassificationModel:
    """A forest on labelled findings (candidate, before, after, path, label), of which at most TRAINING are used."""
    rows = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(features(findings.limit(TRAINING))).select("features", "label")
    forest = RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, seed=SEED, featureSubsetStrategy="sqrt")
    return forest.fit(settle(rows.coalesce(1)))


def candidates(docs: DataFrame, path: Column) -> DataFrame:
    """One row per candidate of the whole text: doc_id, text_key, place (from 0), start, candidate, before, after, path.

    `before` reaches into the candidate before, which may be a long name.

    Texts without one stop at the pattern; for the others the text is split at the candidates, so that each stands
    between the two parts that are its neighbours.
    """
    has = docs.where(F.col("text").rlike(CANDIDATE)).select("doc_id", F.xxhash64("text").alias("text_key"), path.alias("path"), "text")
    cut = has.select("doc_id", "text_key", "path", F.regexp_extract_all("text", F.lit(CANDIDATE), 0).alias("hits"), F.split("text", CANDIDATE, -1).alias("parts"))
    # Where each candidate starts, in characters: all parts and hits before it.
    sizes = F.zip_with(F.transform("parts", F.length), F.transform("hits", F.length), lambda a, b: F.struct(a.alias("a"), F.coalesce(b, F.lit(0)).alias("b")))
    starts = F.aggregate(
        sizes, F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("all")),
        lambda s, x: F.struct((s["at"] + x["a"] + x["b"]).alias("at"), F.concat(s["all"], F.array(s["at"] + x["a"])).alias("all")), lambda s: s["all"],
    )
    each = cut.withColumn("starts", starts).withColumn("places", F.sequence(F.lit(0), F.size("hits") - 1)).withColumn("place", F.explode("places"))
    return each.select(
        "doc_id", "text_key", "place", F.get("starts", "place").alias("start"), F.get("hits", "place").alias("candidate"),
        F.substring(F.concat(F.coalesce(F.get("hits", F.col("place") - 1), F.lit("")), F.get("parts", "place")), -BESIDE, BESIDE).alias("before"), F.substring(F.get("parts", F.col("place") + 1), 1, BESIDE).alias("after"), "path",
    )


def scan(docs: DataFrame, model: RandomForestClassificationModel, path: Column | None = None) -> DataFrame:
    """Candidates with `probability` and is_secret; `path` defaults to the source."""
    found = features(candidates(docs, F.coalesce(path if path is not None else F.col("source"), F.lit(""))))
    voted = model.transform(VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(found))
    p = vector_to_array("probability")[1]
    return voted.select("doc_id", "text_key", "place", "start", "candidate", p.alias("vote")).withColumn("is_secret", F.col("vote") >= CUT).withColumnRenamed("vote", "probability")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per candidate, with a digest instead of the candidate itself.

    A null or empty text has none; a null source is an empty path; repeated rows are scanned each; without documents
    there are no rows.
    """
    found = scan(documents(spark, sf_dir), train(labelled_findings(spark)))
    return found.select(
        "doc_id", F.col("place").cast("long").alias("place"), F.col("start").cast("long").alias("start"), F.length("candidate").cast("long").alias("length"),
        F.sha2("candidate", 256).alias("candidate_sha256"), F.round("probability", 6).alias("probability"), "is_secret",
    )


def redact(docs: DataFrame, found: DataFrame, mask: str = MASK) -> DataFrame:
    """`docs` with each secret of `found` (doc_id, text_key, place, is_secret) replaced by the mask, n_chars set anew."""
    places = found.where("is_secret").groupBy(F.col("doc_id").alias("id"), F.col("text_key").alias("key")).agg(F.collect_set("place").alias("places"))
    # The document stays one struct, so that its columns' names cannot meet the others.
    keyed = docs.select(F.struct("*").alias("doc"), F.xxhash64("text").alias("text_key"))
    rows = keyed.join(settle(places), keyed["doc.doc_id"].eqNullSafe(F.col("id")) & (keyed["text_key"] == F.col("key")), "left")
    old, masked = F.col("doc.text"), F.col("places").isNotNull()
    hits = F.regexp_extract_all(old, F.lit(CANDIDATE), 0)
    kept = F.transform(hits, lambda x, i: F.when(F.array_contains("places", i), F.lit(mask)).otherwise(x))
    new = F.array_join(F.zip_with(F.split(old, CANDIDATE, -1), kept, lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")
    text = F.when(masked, new).otherwise(old)
    out = {"text": text, "n_chars": F.when(masked, F.length(new).cast(dict(docs.dtypes).get("n_chars", "long"))).otherwise(F.col("doc.n_chars")) if "n_chars" in docs.columns else None}
    return rows.select(*[out[c].alias(c) if c in out else F.col("doc").getField(c).alias(c) for c in docs.columns])


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents; secrets in their texts are masked."""
    return redact(docs, scan(docs, train(labelled_findings(spark))))
