r"""Secrets: a pattern proposes candidates, a random forest removes false positives.

The forest is trained with Spark ML from a table of labelled findings (value,
before, path, label) and then turned into one column expression, so that
scoring candidates needs neither a shuffle nor Python: every document is
scanned, scored and reported in one projection.  ``labelled_findings`` makes
such a table where there is none.

Features of a candidate: its length, transitions between character classes and
between letters (how likely they are in the documents' own words), repeated characters, shares of digits,
capitals and vowels, coverage by dictionary words, signs of a path, what the
path of its document says, and the words beside it.
"""

from __future__ import annotations

import math
from collections import Counter
from functools import reduce
from typing import NamedTuple

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import let, running, saved

#: What a secret's name ends in; whatever stands before it belongs to the name.
NAME = r"(?i:password|passwd|pwd|secret|token|api[_-]?key|auth[_-]?key|credential|key|pat|sig)"
ASSIGNED = NAME + r"[\x22']?\x20?[=:]\x20?[\x22']?"
#: A URL's next parameter ends an assigned value.
VALUE = r"(?:(?!&[A-Za-z0-9_.%-]++=)[^\s\x22',;]){6,}+"
#: A run after anything but itself, so also after "="; past a "/" that no run took, a URL's segment, or the three of a webhook.
#: The name of an assignment goes with its value, and "=" before a value is no padding.
TAIL = rf"(?!(?<={NAME})[\x22']?\x20?[=:])(?:={{1,2}}+(?![\x22']?[A-Za-z0-9+/_$%.-]))?+"
BARE = rf"(?<![A-Za-z0-9+/_.@-])(?!(?<=:)//)[A-Za-z0-9+/_-]{{16,}}+{TAIL}"
WEBHOOK = r"T[A-Z0-9]{7,}+/B[A-Z0-9]{7,}+/"
SEGMENT = rf"(?<=/)(?:{WEBHOOK})?+[A-Za-z0-9+_-]{{16,}}+{TAIL}"
CANDIDATE = f"{ASSIGNED}{VALUE}|{BARE}|{SEGMENT}"
SECRET_WORDS = ("password", "passwd", "pwd", "secret", "token", "key", "auth", "credential", "bearer", "login")
BENIGN_WORDS = ("commit", "sha", "md5", "checksum", "hash", "digest", "uuid", "revision", "example", "sample", "file", "path", "order", "version", "card", "phone")
DICTIONARY = (
    "about above account action admin after again also always another answer apple application archive array backup banner base before begin "
    "below between block board body book branch bridge build business button cable cache cancel change channel chart check child class clean client "
    "clock close cloud code color column command common company config content control copy count country course cover create current customer data "
    "date default delete demo detail device display document door down drive dummy early edit email empty enable entry error event example export "
    "extra false field file filter final first folder follow form format found front full game general global green group guest hash head hello help "
    "hidden history home hour house image import index info input inside item java john kind label language large last later layer layout left "
    "letter level light limit line link list load local long main make manager master match media member menu message middle model module month more "
    "name never next night node none note null number object office only open option order other output owner page paper parent part pass path "
    "people phone photo picture place plain plan play point post power press print private process product profile project public query quick ready "
    "record region release remove report request reset result return review right root route sample save school screen search secret section select "
    "server service session set share short simple site size source space spring start state static status stop store street string style system "
    "table target task temp test text than that then there these thing this time title token tool total track true type under unit update upload user "
    "value version video view water week welcome where which white width window with word work world write year your"
).split()
#: Bound of the generated training set, and the forest's size.
FIT_ROWS, TREES, DEPTH, SEED = 6_000, 16, 7, 11
FEATURES = ["chars", "changes", "pairs", "repeats", "digits", "capitals", "vowels", "words", "slashes", "dots", "hexlike", "assigned", "secretish", "benign", "prefix", "in_tests", "in_settings"]
#: What a document's path says of its contents.
TEST_PATHS, SETTING_PATHS = ("test", "spec", "mock", "fixture", "example", "sample", "docs"), (".env", "config", "conf/", "settings", "secret", "credential", ".pem", ".yml", ".yaml", ".properties")
LETTERS = "abcdefghijklmnopqrstuvwxyz"
#: Words that a language model of documents is asked for, and their length; runs that may be candidates are longer.
VOCABULARY, SHORTEST, LONGEST = 400, 2, 15


class Language(NamedTuple):
    """How the words of some documents look: the commonest of them, and for each pair of letters how much likelier the second is after the first than by chance (log2, within 4)."""

    words: list[str]
    pairs: list[float]


def letter_pairs(counts: dict[str, int]) -> list[float]:
    """The scores of all 676 pairs of letters."""
    after = {a: sum(counts.get(a + b, 0) for b in LETTERS) for a in LETTERS}
    return [max(-4.0, min(4.0, math.log2(26 * (counts.get(a + b, 0) + 0.5) / (after[a] + 13)))) for a in LETTERS for b in LETTERS]


#: Where there are no documents to learn from: the dictionary's own.
PLAIN = Language(DICTIONARY, letter_pairs(Counter(w[i : i + 2] for w in DICTIONARY for i in range(len(w) - 1))))


def language(docs: DataFrame, *, text_col: str = "text", words: int = VOCABULARY) -> Language:
    """The language of all documents: counts over the words that are letters only and too short for a candidate.

    Words are counted before they are shuffled; the driver gets ``words`` words
    and a count for each pair of letters.  Without any such word it is PLAIN.
    """
    each = docs.select(F.explode(F.split(F.lower(F.col(text_col).cast("string")), "[^a-z0-9+/_-]+")).alias("w")).where(F.col("w").rlike(f"^[a-z]{{{SHORTEST},{LONGEST}}}$"))
    counts = saved(each.groupBy("w").agg(F.count("*").alias("n")), "words")
    pairs = counts.select("n", "w", F.explode(F.sequence(F.lit(1), F.length("w") - 1)).alias("i")).groupBy(F.substring("w", F.col("i"), F.lit(2)).alias("p")).agg(F.sum("n").alias("n")).collect()
    common = counts.where(F.length("w") >= 4).orderBy(F.desc("n"), "w").limit(words).collect()
    return Language([r.w for r in common] or DICTIONARY, letter_pairs({r.p: r.n for r in pairs})) if pairs else PLAIN


def likeness(value: Column, pairs: list[float]) -> Column:
    """The mean score of a value's letter pairs, over its length."""
    table = F.expr(f"cast(split('{','.join(map(str, pairs))}', ',') as array<double>)")  # folded to one constant
    codes = F.transform(F.split(F.lower(value), ""), lambda c: F.when(c == "", 0).otherwise(F.instr(F.lit(LETTERS), c)))
    score = lambda a, b: F.when((a > 0) & (b > 0), F.get(table, (a - 1) * 26 + b - 1)).otherwise(0.0)
    total = let(codes, lambda x: F.aggregate(F.sequence(F.lit(0), F.size(x) - 1), F.lit(0.0), lambda t, i: t + F.coalesce(score(F.get(x, i), F.get(x, i + 1)), F.lit(0.0))))
    return total / F.greatest(F.length(value), F.lit(1)).cast("double")


def features(value: Column, before: Column, path: Column, pairs: list[float] = PLAIN.pairs) -> dict[str, Column]:
    """before: the text just before the candidate, the assignment included; path: of its document, empty if unknown; pairs: of the language of documents."""
    n = F.greatest(F.length(value), F.lit(1)).cast("double")
    kinds = F.translate(value, "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", "a" * 26 + "A" * 26 + "0" * 10)

    def left_by(pattern: str, text: Column = value) -> Column:
        return F.length(F.regexp_replace(text, pattern, "")).cast("double")

    near, place = F.lower(before), F.lower(path)

    def any_near(words: tuple[str, ...], where: Column = near) -> Column:
        return reduce(lambda a, b: a | b, [F.contains(where, F.lit(w)) for w in words]).cast("double")

    return {
        "chars": F.least(n, F.lit(200.0)),
        "changes": (left_by(r"(a)(?=a)|(A)(?=A)|(0)(?=0)", kinds) - 1) / n,
        "pairs": likeness(value, pairs),
        "repeats": 1 - left_by(r"(.)(?=\1)") / n,
        "digits": 1 - left_by("[0-9]") / n,
        "capitals": 1 - left_by("[A-Z]") / n,
        "vowels": 1 - left_by("(?i)[aeiou]") / n,
        "words": 1 - left_by("|".join(sorted(DICTIONARY, key=lambda w: (-len(w), w))), F.lower(value)) / n,
        "slashes": n - left_by("/"),
        "dots": n - left_by(r"[._-]"),
        "hexlike": value.rlike("^[0-9a-fA-F]+$").cast("double"),
        "assigned": before.rlike(ASSIGNED + "$").cast("double"),
        "secretish": any_near(SECRET_WORDS),
        "benign": any_near(BENIGN_WORDS),
        "prefix": value.rlike(f"^(?:AKIA|ASIA|gh[pousr]_|xox[abpr]-|sk_live_|sk-|AIza|glpat-|eyJ|{WEBHOOK})").cast("double"),
        "in_tests": any_near(TEST_PATHS, place),
        "in_settings": any_near(SETTING_PATHS, place),
    }


def labelled_findings(spark: SparkSession, rows: int = FIT_ROWS, vocabulary: list[str] = PLAIN.words) -> DataFrame:
    """A bounded set of generated findings (value, before, path, label, template), the same each time.

    Real credentials are strings drawn evenly from an alphabet, with the
    prefixes and assignments that issuers and programs give them; false ones
    are placeholders, words, numbers, paths, checksums, identifiers, and long
    words, titles and names without a digit; long words are put together of
    those in ``vocabulary``, which a language of documents has.  Most paths say nothing; of those
    that do, settings go more with real ones and tests with false ones.
    """
    def drawn(alphabet: str, least: int, most: int | None = None) -> Column:
        size = F.lit(least) if most is None else F.pmod(F.xxhash64("id", F.lit("size")), F.lit(most - least + 1)) + least
        one = lambda i: F.substring(F.lit(alphabet), (F.pmod(F.xxhash64("id", i, F.lit(alphabet)), F.lit(len(alphabet))) + 1).cast("int"), F.lit(1))
        return F.array_join(F.transform(F.sequence(F.lit(1), size.cast("int")), one), "")

    def pick(words: list[str], salt: str) -> Column:
        return F.get(F.array(*map(F.lit, words)), F.pmod(F.xxhash64("id", F.lit(salt)), F.lit(len(words))).cast("int"))

    hexa, upper = "0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
    b62 = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    talk = pick(["and then the ", "of that ", "in ", "see ", "using ", "", "with our ", "\n"], "talk")
    put = pick(["password=", "token = \"", "secret=", "api_key: ", "pwd=", "apikey=\"", "credential: "], "put")
    word = lambda salt: pick(DICTIONARY, salt)
    spoken = F.rpad(F.concat(*(pick(vocabulary, f"s{k}") for k in range(4))), 16, "e")
    words = lambda by: F.concat_ws(by, *map(word, "ghij"))
    named = pick(["name=", "path=", "mode = ", "class=\"", "https://host.example.org/", "/", "primary key: ", "type: "], "named")
    named_so = pick(["order ", "card ", "phone ", "version ", "example ", "sample ", "file ", "path ", "commit ", "checksum ", "the hash ", "uuid ", "revision "], "so")
    cases = [
        (F.concat(F.lit("AKIA"), drawn(upper, 16)), talk, 1), (drawn(hexa, 16, 40), F.concat(talk, put), 1), (drawn(b62, 20, 44), F.concat(talk, put), 1),
        (F.concat(pick(["ghp_", "gho_", "glpat-", "sk_live_", "xoxb-"], "kind"), drawn(b62, 24, 40)), talk, 1), (drawn(b62 + "+/", 32, 64), F.concat(talk, put), 1),
        (drawn(b62, 8, 14), F.concat(talk, put), 1),
        (pick(["changeme", "xxxxxxxxxxxx", "your_password_here", "placeholder", "<password>", "example123", "secret123456", "********"], "fake"), F.concat(talk, put), 0),
        (F.concat(word("a"), word("b"), F.lit("_"), word("c"), F.pmod("id", F.lit(100)).cast("string")), F.concat(talk, F.when(F.col("id") % 3 == 0, put).otherwise("")), 0),
        (drawn("0123456789", 16, 20), F.concat(talk, F.when(F.col("id") % 2 == 0, named_so).otherwise("")), 0), (F.concat(word("d"), F.lit("/"), word("e"), F.lit("/v2/"), word("f")), talk, 0),
        (drawn(hexa, 32, 64), F.concat(talk, pick(["commit ", "sha1 ", "md5: ", "checksum ", "hash of the file ", "digest: ", "revision "], "sum")), 0),
        (F.concat(drawn(hexa, 8), F.lit("-"), drawn(hexa, 4), F.lit("-4"), drawn(hexa, 3), F.lit("-a"), drawn(hexa, 3), F.lit("-"), drawn(hexa, 12)), F.concat(talk, pick(["id ", "uuid ", "order ", "for "], "id")), 0),
        (F.concat(pick(["T", "T0"], "team"), drawn(upper, 8), F.lit("/B0"), drawn(upper, 8), F.lit("/"), drawn(b62, 24)), F.concat(talk, F.lit("https://hooks.host.com/services/")), 1),
        (F.when(F.col("id") % 2 == 0, drawn(b62, 20, 44)).otherwise(drawn(b62 + "+//", 40)), F.concat(talk, pick(["AUTH_KEY_V2=", "\nexport SECRET_VALUE=", "token_prod = "], "kept")), 1),
        (F.when(F.col("id") % 3 == 0, spoken).otherwise(F.initcap(spoken)), F.concat(talk, F.when(F.col("id") % 4 == 0, named).otherwise("")), 0),
        (F.when(F.col("id") % 2 == 0, words("-")).otherwise(words("_")), F.concat(talk, F.when(F.col("id") % 3 == 0, named).otherwise("")), 0),
        (F.upper(F.concat_ws("_", word("g"), word("h"), pick(["key", "id", "api", "url"], "i"), pick(["key", "id", "no", "base"], "j"))), F.concat(talk, pick(["", "export ", "\n", "secret "], "shell")), 0),
        (F.replace(F.initcap(words(" ")), F.lit(" "), F.lit("")), F.concat(talk, F.when(F.col("id") % 3 == 0, named).otherwise("")), 0),
        (F.upper(F.when(F.col("id") % 2 == 0, spoken).otherwise(F.concat_ws("_", drawn(LETTERS, 2, 4), word("g"), pick(["key", "id", "api", "url"], "i"), pick(["key", "id", "no", "base"], "j")))), F.concat(talk, pick(["", "export ", "\n", "with "], "shell")), 0),
        (drawn(b62, 16, 40), F.concat(talk, named_so), 0),
        (F.concat_ws("-", drawn(b62, 6, 10), drawn(hexa, 6, 12), drawn("0123456789", 4)), F.concat(talk, named_so), 0),
    ]
    tests, settings = pick(["src/test/login_test.py", "docs/example.md", "spec/fixtures/a.json", "samples/app.rb"], "tests"), pick(["deploy/.env", "conf/app.properties", "settings.py", "config/prod.yml"], "settings")
    roll = F.pmod(F.xxhash64("id", F.lit("roll")), F.lit(20))
    path = lambda label: F.when(roll < (3 if label else 1), settings).when(roll < 4, tests).otherwise(pick(["", "web", "forum", "src/main/app.py", "crawl"], "place"))
    one = lambda k, v, b, label: spark.range(k, rows, len(cases), 1).select(v.alias("value"), b.alias("before"), path(label).alias("path"), F.lit(float(label)).alias("label"), F.lit(k).alias("template"))
    return reduce(DataFrame.unionByName, [one(k, *case) for k, case in enumerate(cases)])


def train(findings: DataFrame, *, trees: int = TREES, depth: int = DEPTH, seed: int = SEED, pairs: list[float] = PLAIN.pairs) -> list:
    """A forest from labelled findings (value, before, path, label): per tree nested (feature, threshold, left, right), or a leaf's share of secrets.

    Rows without a value or a label are left out; a missing ``before`` or
    ``path`` is empty.  All findings meet on one executor, so their number is
    the caller's to bound.
    """
    known = [F.coalesce(F.col(c).cast("string"), F.lit("")) if c in findings.columns else F.lit("") for c in ("before", "path")]
    x = findings.where("value is not null and label is not null").select(F.col("label").cast("double").alias("label"), *(c.alias(n) for n, c in features(F.col("value"), *known, pairs).items()))
    x = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(x).select("label", "features").coalesce(1)
    model = RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=seed, featureSubsetStrategy="sqrt", minInstancesPerNode=2).fit(x)

    def walk(node):
        if node.getClass().getSimpleName() == "LeafNode":
            counts = list(node.impurityStats().stats())
            return counts[1] / max(sum(counts), 1e-9) if len(counts) > 1 else 0.0
        split = node.split()
        return FEATURES[split.featureIndex()], split.threshold(), walk(node.leftChild()), walk(node.rightChild())

    return [walk(t._java_obj.rootNode()) for t in model.trees]


def vote(forest: list, x: Column) -> Column:
    """The mean of the trees' shares, over a struct of features."""
    def tree(node) -> Column:
        if not isinstance(node, tuple):
            return F.lit(float(node))
        name, cut, left, right = node
        return F.when(x[name] <= cut, tree(left)).otherwise(tree(right))

    return reduce(lambda a, b: a + b, map(tree, forest)) / F.lit(float(len(forest)))


def find_secrets(docs: DataFrame, forest: list, *, id_col: str = "doc_id", text_col: str = "text", path_col: str | None = None, least: float = 0.5, pairs: list[float] = PLAIN.pairs) -> DataFrame:
    """``id_col``, n_candidates, and secrets: array<struct(start, end, value, score)> with scores of ``least`` or more.

    Offsets are code points, the end exclusive.  ``path_col`` names the column
    with a document's path, if there is one; a null path is empty.  ``pairs``
    are those that the forest has learnt with.  Null and
    empty texts have no candidates.  Each row stands on its own, so null and
    repeated ids pass; other columns are not read, so they cannot clash.
    """
    kind = "array<struct<start:bigint,end:bigint,value:string,before:string>>"
    text = F.col("text")

    def placed(hits: Column) -> Column:
        gaps = F.split(text, CANDIDATE, -1)
        pieces = F.flatten(F.zip_with(gaps, hits, lambda g, h: F.array(g, F.coalesce(h, F.lit("")))))

        def found(p: Column, ends: Column) -> Column:
            def one(hit: Column, i: Column) -> Column:
                gap, name = F.get(p, 2 * i), F.length(F.regexp_extract(hit, "^" + ASSIGNED, 0))
                before = F.concat(F.right(gap, F.lit(32)), F.substring(hit, F.lit(1), name))
                return F.struct((F.get(ends, 2 * i) + name).alias("start"), F.get(ends, 2 * i + 1).alias("end"), F.substring(hit, name + 1, F.length(hit)).alias("value"), before.alias("before"))

            return F.transform(hits, one).cast(kind)

        return F.when(F.size(hits) > 0, let(pieces, lambda p: let(running(F.transform(p, lambda x: F.length(x))), lambda e: found(p, e)))).otherwise(F.array().cast(kind))

    path = F.coalesce(F.col(path_col).cast("string"), F.lit("")) if path_col else F.lit("")
    src = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"), path.alias("path"))
    candidates = src.select("id", "path", let(F.regexp_extract_all(text, F.lit(CANDIDATE), F.lit(0)), placed).alias("found"))

    def scored(c: Column) -> Column:
        x = F.struct(*(f.alias(n) for n, f in features(c["value"], c["before"], F.col("path"), pairs).items()))
        return F.struct(c["start"].alias("start"), c["end"].alias("end"), c["value"].alias("value"), let(x, lambda v: vote(forest, v)).alias("score"))

    return candidates.select(F.col("id").alias(id_col), F.size("found").cast("long").alias("n_candidates"), F.filter(F.transform("found", scored), lambda s: s["score"] >= least).alias("secrets"))
