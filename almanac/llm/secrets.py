"""Operator 7: secret scan with a random forest that removes false positives, with DataFrame functions only.

Candidates are runs of at least ``LEAST_LENGTH`` key characters that hold a digit; ``=`` belongs to one only as padding at its end,
so that a name and its value are apart. Where an announcing word and an assignment or a quote stand before a run, it is a candidate
from ``LEAST_ANNOUNCED`` characters on, with or without a digit, and other signs of passwords belong to it; in quotes it reaches to
the closing one or the next blank. The text beside a candidate is what stands there, other candidates included. The forest judges each by its length, its
character transitions (how often the kind of character changes, and the log-likelihood ratio of its character pairs under the
genuine and the false training findings), how much of it dictionary words cover, signs of a path, and the words beside it.

The forest is trained on labelled findings (before, candidate, after, genuine). A caller may give a table of them; the default is
a bounded table of ``FINDINGS`` rows that Spark derives from hashes: keys in the formats of services and in assignments against
checksums, identifiers, paths, numbers and placeholders. Findings are written out as lines and cut as texts are. Texts are scanned whole, every candidate is returned with its score.

Defined results: null texts and texts without candidates give no row; equal candidates in one text are rows of their own, told apart
by their position; rows without id are kept; rows repeated with equal id give repeated findings; an empty table gives an empty
result; other columns are not read.
"""

from __future__ import annotations

from functools import reduce

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from almanac.llm.common import BOOK, read
from almanac.storage import written

LEAST_LENGTH, LEAST_ANNOUNCED = 16, 6
BESIDE = 64
FINDINGS = 6000
TREES, DEPTH = 40, 8
THRESHOLD = 0.5

#: Words of identifiers and placeholders, words that announce a secret, words that announce something else.
DICTIONARY = ("account address admin alpha archive article backup beta build cache change chapter class client color column commit "
              "config content count country customer data database date default delete demo dev document draft dummy error "
              "example field file final first folder format group header here html image index input insert item label lang last "
              "layer level line link list local login main master message method model module name node null number object order "
              "output page param part path placeholder point post prefix product project public query record region release "
              "report request result route sample schema script section select server service session setting source stage start "
              "state status step string style system table target temp template test text title total type update upload user "
              "value version view week window your").split()
ANNOUNCING = "api_key apikey key token secret password passwd pwd auth authorization bearer credential private access".split()
DENYING = ("sha sha1 sha256 md5 checksum digest hash commit revision uuid guid etag id isbn phone call tel card invoice serial version "
           "build example sample path file").split()

SIGN = r"A-Za-z0-9_+/\-"
MORE = rf"{SIGN}~!@#$%^*"
PADDING = f"={{1,2}}(?![{SIGN}=])"
#: An announcing word, the rest of its name, and an assignment or an opening quote.
ASSIGNED = (rf"(?i:{'|'.join(ANNOUNCING)})(?![A-Za-z0-9])[A-Za-z0-9_-]{{0,30}}(?:[\"'`]?\s{{0,8}}(?::=|=>|->|={{1,3}}|:)\s{{0,8}}[\"'`]?|\s{{0,8}}[\"'`])"
            r"(?:(?i:bearer|basic)\x20{1,4})?")
#: What is no value but a name with one after it.
NAME = rf"(?:[A-Za-z0-9]{{1,30}}[_-]){{0,6}}{ASSIGNED}"
LEAD = rf"(?<![A-Za-z0-9]){ASSIGNED}(?!{NAME})"
#: A run of any kind after a lead: up to the quote or blank where one was opened, else of key characters and signs, not ending in a stop.
VALUE = (rf"(?:(?<=[\"'`])[^\s\"'`]{{{LEAST_ANNOUNCED},}}+"
         rf"|(?:[{MORE}]|[.?](?=[.?]*+[{MORE}])){{{LEAST_ANNOUNCED},}}+(?:{PADDING})?)")
PLAIN = (rf"(?<![{SIGN}])(?=[A-Za-z_+/-]*+[0-9])(?!{NAME})(?:[{SIGN}]{{{LEAST_LENGTH},}}+(?:{PADDING})?|[{SIGN}]{{{LEAST_LENGTH - 1}}}{PADDING}"
         rf"|[{SIGN}]{{{LEAST_LENGTH - 2}}}==(?![{SIGN}=]))")
KEY = rf"{LEAD}{VALUE}|{PLAIN}"


def shares(candidate: Column) -> dict[str, Column]:
    """Shares of digits, capitals and other signs, and whether all is hexadecimal."""
    n = F.length(candidate)

    def share(kind: str) -> Column:
        return F.regexp_count(candidate, F.lit(kind)) / n

    return {"digits": share("[0-9]"), "capitals": share("[A-Z]"), "signs": share("[^A-Za-z0-9]"),
            "hexadecimal": candidate.rlike("^([0-9a-f]+|[0-9A-F]+)$").cast("double"),
            "commonest": F.array_max(F.transform(
                F.array(*[F.lit(c) for c in "0123456789abcdefghijklmnopqrstuvwxyz"]),
                lambda c: F.length(F.lower(candidate)) - F.length(F.replace(F.lower(candidate), c, F.lit(""))))) / n}


def pairs(candidate: Column) -> Column:
    """Character pairs, digits written as 0 and capitals as A, so that they are few."""
    plain = F.regexp_replace(F.regexp_replace(candidate, "[0-9]", "0"), "[A-Z]", "A")
    return F.transform(F.sequence(F.lit(1), F.length(candidate) - 1), lambda i: F.substring(plain, i, F.lit(2)))


def features(found: DataFrame, odds: Column) -> DataFrame:
    """The findings (before, candidate, after) with their features; ``odds`` is a map from character pair to log-likelihood ratio."""
    c, before, after = F.col("candidate"), F.lower("before"), F.lower("after")
    changes = sum(F.regexp_count(c, F.lit(p)) for p in ("[A-Za-z](?=[0-9])", "[0-9](?=[A-Za-z])", "[a-z](?=[A-Z])", "[A-Z](?=[a-z])"))
    rest = F.regexp_replace(F.lower(c), "|".join(sorted(DICTIONARY, key=lambda w: (-len(w), w))), "")
    ratio = F.aggregate(pairs(c), F.lit(0.0), lambda total, p: total + F.coalesce(F.element_at(odds, p), F.lit(0.0)))
    near = F.regexp_extract(before, r"((?:[\p{L}0-9_-]+[^\p{L}0-9_-]{0,8}){0,3})$", 1)

    def says(words: list[str]) -> Column:
        return near.rlike(r"(?<![\p{L}0-9])(" + "|".join(words) + r")(?![\p{L}0-9])").cast("double")

    columns = shares(c) | {
        "length": F.log2(F.length(c)), "changes": changes / F.length(c), "pair_odds": ratio / F.length(c),
        "covered": 1 - F.length(rest) / F.length(c),
        "slashes": F.regexp_count(c, F.lit("/")).cast("double"), "after_path": before.rlike(r"[/\\.@#]$").cast("double"),
        "before_path": after.rlike(r"^([/\\@]|\.[a-z])").cast("double"), "grouped": c.rlike("^[0-9a-zA-Z]+([-_][0-9a-zA-Z]+)+$").cast("double"),
        "names": after.rlike(r"^[\"'`]?\s{0,4}[=:]").cast("double"), "announced": says(ANNOUNCING), "denied": says(DENYING), "assigned": before.rlike(r"[=:]\s*[\"'`]?$").cast("double"),
        "quoted": (before.rlike("[\"'`]$") & after.rlike("^[\"'`]")).cast("double")}
    return found.withColumn("f", F.struct(*[v.cast("double").alias(k) for k, v in columns.items()]))


def default_findings(spark: SparkSession, n: int = FINDINGS) -> DataFrame:
    """Labelled findings (before, candidate, after, genuine), each derived from the hash of its number."""
    rows = spark.range(n).withColumn("h", F.sha2(F.concat(F.lit("finding-"), F.col("id").cast("string")), 512))
    wide = F.concat("h", F.md5("h"))
    rows = rows.withColumn("m", F.regexp_replace(F.base64(F.unhex("h")), "[+/=]", ""))
    mixed = F.col("m")

    def pick(options, at: int) -> Column:
        return F.element_at(F.array(*[F.lit(o) for o in options]), F.pmod(F.xxhash64(F.lit(at), "id"), F.lit(len(options))).cast("int") + 1)

    def number(k: int) -> Column:
        return F.substring(F.translate("h", "abcdef", "372941"), 1, k)

    def word(at: int) -> Column:
        return pick(DICTIONARY, at)

    lead = F.concat(pick(["api_key", "token", "secret", "password", "auth_token", "access_key", "client_secret", "private_key"], 1),
                    pick([" = \"", ": \"", "=", " = '", ": ", "\": \""], 2))
    tail = F.when(F.endswith(lead, F.lit("\"")), "\"").when(F.endswith(lead, F.lit("'")), "'").otherwise(" ")
    prose = F.concat(word(3), F.lit(" "), word(4), F.lit(" "))
    url = F.concat(prose, F.lit("https://"), word(17), F.lit(".example/"), word(18), F.lit("?"), pick(["", "page=3&", "id=7&"], 19))
    short = F.expr("substring(m, 2, 8 + pmod(id, 7))")
    sign = pick(["!", "~", ".", "#", "$", "@", "%", "-", "*"], 23)
    genuine = [  # before, candidate, after
        (F.concat(prose, lead), F.substring(wide, 1, 40), tail), (F.concat(prose, lead), F.substring(wide, 5, 32), tail),
        (F.concat(prose, lead), F.substring(wide, 1, 64), tail), (F.concat(prose, lead), F.upper(F.substring(wide, 3, 40)), tail),
        (F.concat(prose, lead), F.substring(mixed, 1, 40), tail), (F.concat(prose, lead), F.substring(mixed, 3, 24), tail),
        (prose, F.concat(F.lit("AKIA"), F.upper(F.substring(mixed, 1, 14)), F.lit("7Q")), F.lit(" ")),
        (prose, F.concat(F.lit("ghp_"), F.substring(mixed, 1, 36)), F.lit(" ")),
        (F.concat(F.lit("Authorization: Bearer "), F.lit("")), F.concat(F.lit("eyJ0eXAi"), F.substring(mixed, 1, 60)), F.lit(".")),
        (F.concat(prose, lead), F.concat(F.lit("sk_live_"), F.substring(mixed, 1, 24)), tail),
        (F.concat(url, pick(["token=", "key=", "access_token=", "api_key=", "auth="], 14)), F.substring(wide, 1, 40), pick(["&", " ", "&page=2 "], 15)),
        (F.concat(url, pick(["token=", "secret=", "access_token=", "api_key="], 14)), F.substring(mixed, 2, 32), pick(["&", " ", "\""], 15)),
        (F.concat(prose, lead), F.concat(F.substring(mixed, 1, 30), pick(["=", "=="], 16)), tail),
        (F.concat(prose, lead), short, tail), (F.concat(prose, lead), F.concat(F.substring(mixed, 9, 4), sign, F.substring(mixed, 21, 4), sign), tail),
        (F.concat(prose, lead), F.concat(F.initcap(word(20)), number(2), sign, F.substring(mixed, 31, 3)), tail),
        (F.concat(prose, lead), F.substring(F.regexp_replace(mixed, "[0-9]", ""), 1, 24), tail),
        (F.concat(prose, lead), F.concat_ws(".", F.substring(mixed, 1, 12), F.substring(mixed, 13, 12), F.substring(mixed, 25, 12)), tail),
        (F.concat(prose, lead), F.translate(F.initcap(F.concat(word(21), word(22))), "oeias", "03145"), tail)]
    false = [
        (F.concat(prose, pick(["commit ", "sha1 ", "sha256: ", "checksum: ", "md5 = ", "digest ", "etag \"", "revision "], 5)),
         F.substring(wide, 1, 40), F.lit(" ")),
        (F.concat(prose, pick(["uuid ", "id: ", "guid = \"", ""], 6)), F.concat_ws("-", F.substring("h", 1, 8), F.substring("h", 9, 4),
                                                                                F.substring("h", 13, 4), F.substring("h", 17, 4), F.substring("h", 21, 12)), F.lit(" ")),
        (prose, F.concat_ws("_", word(7), word(8), word(9), number(2)), F.lit(" ")),
        (F.concat(prose, lead), F.concat_ws("_", F.lit("your"), word(7), word(8), F.lit("here"), number(1)), tail),
        (F.concat(prose, F.lit("/")), F.concat_ws("/", word(7), word(8), F.concat(word(9), number(3))), pick([".html", ".txt", "/", ".png"], 10)),
        (prose, number(16), F.lit(" ")), (F.concat(prose, pick(["call ", "card ", "invoice ", "+"], 11)), number(18), F.lit(" ")),
        (F.concat(prose, lead), F.concat(F.repeat(pick(["x", "0", "a", "abc", "1234", "test"], 12), 8), number(2)), tail),
        (prose, F.concat_ws("-", word(7), F.concat(F.lit("v"), number(1)), word(8), number(4)), F.lit(" ")),
        (F.concat(prose, lead), F.concat(F.lit("AKIAIOSFODNN7"), F.upper(pick(["example", "sample", "placeholder"], 13)), number(1)), tail),
        (F.concat(url, pick(["id=", "session=", "etag=", "order=", "v="], 14)), F.substring(wide, 1, 32), pick(["&", " ", "&page=2 "], 15)),
        (F.concat(url, pick(["id=", "order=", "call="], 14)), number(18), pick(["&", " "], 15)),
        (prose, F.concat_ws("_", word(7), pick(["api_key", "token", "secret", "password", "access_key"], 1), word(8), number(3)),
         F.concat(pick([" = \"", "=", ": "], 2), F.substring(mixed, 5, 30), F.lit(" "))),
        (F.concat(prose, lead), word(20), tail), (F.concat(prose, lead), F.concat(word(20), pick(["_", "-", "."], 24), word(21)), tail),
        (F.concat(prose, lead), pick(["required", "changeme", "optional", "undefined", "placeholder", "redacted", "************", "xxxxxxxx", "xxxxxxxxxxxx",
                                      "your_password", "your-token", "your_key_here", "${PASSWORD}", "example123", "process.env.TOKEN", "config.secret",
                                      "settings.password", "forgotten", "something", "expired", "missing"], 25), tail),
        (F.concat(prose, pick(["the key: ", "a token: ", "private: ", "access: ", "secret: ", "password: "], 26)),
         pick(["because", "whatever", "between", "nothing", "everyone", "together", "remember", "morning", "without", "another"], 27), F.concat(F.lit(" "), word(28)))]
    sides = [(1.0, kind) for kind in genuine] + [(0.0, kind) for kind in false]
    parts = [rows.filter(F.pmod("id", F.lit(len(sides))) == k).select(
        before.alias("before"), candidate.alias("candidate"), after.alias("after"), F.lit(y).alias("genuine"))
        for k, (y, (before, candidate, after)) in enumerate(sides)]
    return reduce(DataFrame.union, parts)


def cut(findings: DataFrame) -> DataFrame:
    """The findings as the scan would make them of the lines they stand in; those it does not make are left out."""
    lines = findings.select(F.struct("candidate", F.col("genuine").cast("double").alias("genuine")).alias("finding"), F.concat(
        F.coalesce("before", F.lit("")), "candidate", F.coalesce("after", F.lit(""))).alias("line"))
    made = candidates(lines, "finding", "line").filter(
        F.contains("doc.candidate", "candidate") | F.contains("candidate", "doc.candidate"))
    return made.select("before", "candidate", "after", F.col("doc.genuine").alias("genuine"))


def fit(findings: DataFrame) -> tuple[RandomForestClassificationModel, Column]:
    """Train on labelled findings: the forest and the map of character pair odds. A quarter of the findings, chosen by hash, gives
    the odds, so that the forest sees them on findings that did not make them."""
    findings = written(cut(findings), "findings")
    first = F.pmod(F.xxhash64("before", "candidate"), F.lit(4)) == 0
    counted = findings.filter(first).select("genuine", F.explode(pairs(F.col("candidate"))).alias("pair")).groupBy("pair").agg(
        F.sum("genuine").alias("yes"), F.sum(1 - F.col("genuine")).alias("no"))
    rows = counted.orderBy("pair").collect()  # pairs of ASCII key characters with one digit and one capital: at most 32 * 32
    yes, no = (sum(r[c] for r in rows) + len(rows) + 1 for c in ("yes", "no"))
    odds = F.create_map(*[x for r in rows for x in (F.lit(r["pair"]), F.log(F.lit((r["yes"] + 1) / yes / ((r["no"] + 1) / no))))])
    table = features(findings.filter(~first), odds).select("f.*", F.col("genuine").alias("label"))
    names = [c for c in table.columns if c != "label"]
    vectors = VectorAssembler(inputCols=names, outputCol="features").transform(table).select("features", "label")
    return RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, seed=11).fit(vectors), odds


def candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc, position, before, candidate, after): every run of key characters with the text beside it."""
    text = F.col(text_col).cast("string")
    found, between = F.regexp_extract_all(text, F.lit(KEY), F.lit(0)), F.split(text, KEY)
    pieces = BESIDE // LEAST_ANNOUNCED + 1  # so many candidates at most reach into the text beside another

    def joined(parts: Column) -> Column:
        return F.array_join(parts, "")

    def ends(p: Column) -> Column:
        """What precedes each candidate with the candidate, and it with what follows, as far as others can have use for it."""
        n = F.size(p["found"])
        return F.struct(
            p["found"].alias("found"), p["between"].alias("between"),
            F.zip_with(F.slice(p["between"], F.lit(1), n), p["found"], lambda b, c: F.right(F.concat(b, c), F.lit(BESIDE))).alias("tails"),
            F.zip_with(p["found"], F.slice(p["between"], F.lit(2), n), lambda c, b: F.left(F.concat(c, b), F.lit(BESIDE))).alias("heads"))

    def parted(p: Column) -> Column:
        """The lead of an announced candidate belongs to the text before it."""
        lead = F.transform(p["found"], lambda c: F.regexp_extract(c, f"^{LEAD}(?={VALUE}$)", 0))
        n = F.size(p["found"])
        return F.struct(
            F.zip_with(p["found"], lead, lambda c, l: F.substring(c, F.length(l) + 1, F.length(c))).alias("found"),
            F.concat(F.zip_with(F.slice(p["between"], F.lit(1), n), lead, lambda b, l: F.concat(b, l)), F.slice(p["between"], n + 1, F.lit(1))).alias("between"))

    def beside(p: Column) -> Column:
        first = lambda i: F.greatest(i - pieces, F.lit(0))
        return F.transform(p["found"], lambda c, i: F.struct(
            F.right(F.concat(joined(F.slice(p["tails"], first(i) + 1, i - first(i))), F.get(p["between"], i)), F.lit(BESIDE)).alias("before"),
            c.alias("candidate"),
            F.left(F.concat(F.get(p["between"], i + 1), joined(F.slice(p["heads"], i + 2, F.lit(pieces)))), F.lit(BESIDE)).alias("after")))

    # The one-element arrays make what stands in them once, not for every candidate.
    parts = F.transform(F.transform(F.array(F.struct(found.alias("found"), between.alias("between"))), parted), ends)
    rows = docs.filter(text.isNotNull()).select(F.col(id_col).alias("doc"), F.posexplode(F.flatten(F.transform(parts, beside))).alias("position", "x"))
    return rows.select("doc", "position", "x.before", "x.candidate", "x.after")


def scan(docs: DataFrame, findings: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc, position, candidate, score): every candidate with the forest's probability that it is a secret."""
    model, odds = fit(default_findings(docs.sparkSession) if findings is None else findings)
    rows = features(candidates(docs, id_col, text_col), odds)
    names = [f"f.{c}" for c in rows.schema["f"].dataType.names]
    plain = rows.select("doc", "position", "candidate", *[F.col(n).alias(n[2:]) for n in names])
    vectors = VectorAssembler(inputCols=[n[2:] for n in names], outputCol="features").transform(plain)
    judged = model.transform(vectors.select("doc", "position", "candidate", "features"))
    return judged.select("doc", "position", "candidate", vector_to_array("probability")[1].alias("score"))


@BOOK.add("op7_secret_scan")
def op7_secret_scan(spark, sf_dir):
    found = scan(read(spark, sf_dir, "documents"))
    shown = F.concat(F.left("candidate", F.lit(4)), F.lit("..."))
    return found.select(
        F.col("doc").alias("doc_id"), "position", shown.alias("shown"), F.length("candidate").alias("length"),
        F.sha2(F.col("candidate").cast("binary"), 256).alias("candidate_sha256"), "score", (F.col("score") >= THRESHOLD).alias("is_secret"))
