"""Secret scans: candidates by pattern, false positives removed by a random forest, Spark expressions only.

One regular expression finds candidates: values of any length assigned to a name with a word such as
``password`` in it, known key prefixes, long runs with a digit, passwords in URLs, private-key blocks. Not
found are runs without digit, known prefix or name, and what follows a blank in a value. A forest judges each
from its length, how likely its character transitions are in words, how much of it is dictionary words,
whether it looks like a path, and the words before and after it. Spark's own ``RandomForestClassifier`` trains
it from labelled findings (``value, before, after, label``); the trees become arrays that SQL expressions walk, so
that documents are scanned in a single pass without a shuffle or Python.

Dictionary and transitions are counted over every distinct text of the corpus, whole (``learn_language``), and
the labelled findings are planted into every one of them (``planted``): secrets and look-alikes made by rule,
each after words that stand at a place of that text. Pass your own table to ``train`` where there is one.

Memory: the candidates of one document at a time; the driver gets the dictionary and sums by pair of letters.
Defined results: null and empty texts have no candidates; repeated rows have the same findings, and count
once in training; without documents the dictionary is ``CODE_WORDS``; extra columns of any name stay.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass
from math import log

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import forget, free_name, let, running, written

#: Words that a value is assigned to.
KEYWORDS = r"password|passwd|pwd|passphrase|secret[ _\-]?key|secret|token|api[ _\-]?key|access[ _\-]?key|auth|credential|private[ _\-]?key"
_RUN = r"A-Za-z0-9_+/\-"
# A name is scanned once, to its first keyword: what follows in it does not depend on which one that is.
_ASSIGN = (
    rf"(?i:(?>[{_RUN}.]*?(?:{KEYWORDS}))[{_RUN}.]*+)[\\\"'`\])}}]*+\s*+(?:=>|:=|={{1,3}}+|::?+)\s*+[\\\"'`]*+"
    rf"(?i:(?:bearer|basic)\s++(?=[{_RUN}.~]{{8}}))?+(?!-----BEGIN )(?=[^\s\"'<>])"
)
_URL_HEAD = r"://[^\s/:@\"'<>]*+:"
_BLOCK = r"[A-Z0-9 ]*?PRIVATE KEY(?: BLOCK)?-----"
CANDIDATE = (
    rf"(?<![{_RUN}.]){_ASSIGN}[^\s\"'<>]++"
    rf"|(?<=[A-Za-z0-9]){_URL_HEAD}[^\s/@\"'<>]++(?=@)"
    rf"|(?<![A-Za-z0-9])(?:AKIA|ASIA|gh[pousr]_|github_pat_|sk[-_]|xox[abp]-|AIza|eyJ)[{_RUN}]{{12,}}+(?:\.[{_RUN}]++){{0,2}}+={{0,2}}"
    rf"|(?<![{_RUN}])(?=[A-Za-z_+/\-]*[0-9])[{_RUN}]{{16,}}+={{0,2}}"
    rf"|-----BEGIN {_BLOCK}(?:(?>(?s:.*?)(?=-----))-----END {_BLOCK}|[A-Za-z0-9+/=\s]*+)"
)
#: Words of programs and placeholders, beside those of the corpus.
CODE_WORDS = (
    "example sample test demo placeholder changeme your here value default user name admin file path data "
    "image version release build commit page section chapter article figure table index part item list "
    "the and for with that this from have not are was get set new old one two three main core util config "
    "service server client request response handler manager controller factory module package class function "
    "id key token secret password hash public static final string number date time year month day"
).split()
NEGATIVE = "commit|sha1?|sha256|md5|checksum|digest|uuid|guid|revision|rev|build|version|example|placeholder|isbn|doi|order|invoice|phone|tel|file|path|see|image|figure|url|href|src|class|id"
POSITIVE = f"{KEYWORDS}|bearer|key|signing|login"
FEATURES = ("length", "changes", "transitions", "dictionary", "slashes", "dots", "before_positive", "before_negative", "after_negative", "assigned", "digits", "upper", "hex_only", "distinct", "known_prefix", "dashes", "symbols")


_KINDS, _FIRST = 30, 0xE000  # kinds of characters: letters, digit, dash, slash, other
_LETTERS = "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Language:
    """Words, the log-probabilities of transitions between kinds of characters in them, stretches of text."""

    words: tuple[str, ...] = ()
    transitions: tuple[float, ...] = ()
    stretches: tuple[str, ...] = ("",)


def _kind(c: str) -> int:
    return _LETTERS.index(c) if c in _LETTERS else 26 if c.isdigit() else 27 if c in "-_" else 28 if c == "/" else 29


def transitions(words: dict[str, int]) -> tuple[float, ...]:
    """Log-probability of each kind of character after each other in ``words``, by count with one added."""
    seen = Counter()
    for w, n in words.items():
        for a, b in zip(w, w[1:], strict=False):
            seen[_kind(a), _kind(b)] += n
    total = [sum(seen[a, b] for b in range(_KINDS)) + _KINDS for a in range(_KINDS)]
    return tuple(log((seen[a, b] + 1) / total[a]) for a in range(_KINDS) for b in range(_KINDS))


def learn_language(docs: DataFrame, text_col: str = "text", max_words: int = 4000, max_stretches: int = 200) -> Language:
    """The language of all distinct texts: a word is a run of 3 to 29 letters that three of them have.

    Transitions are those of all words, by the number of texts. ``max_words`` is the size of the dictionary, the most
    frequent ones; ``max_stretches`` of text are for ``labelled_findings``.
    """
    texts = docs.select(F.col(text_col).alias("t")).where(F.length("t") > 0)
    each = texts.distinct().select(F.explode(F.array_distinct(F.regexp_extract_all(F.lower("t"), F.lit("[a-z]{3,}"), F.lit(0)))).alias("w"))
    found = written(each.where(F.length("w") < 30).groupBy("w").agg(F.count("*").alias("n")).where("n > 2"), "words")
    most = found.orderBy(F.desc("n"), "w").limit(max_words).collect()
    pairs = found.select("n", F.explode(F.transform(F.sequence(F.lit(1), F.length("w") - 1), lambda i: F.substring("w", i, F.lit(2)))).alias("p"))
    seen = Counter({r.p: r.n for r in pairs.groupBy("p").agg(F.sum("n").alias("n")).collect()})
    seen.update(CODE_WORDS)
    forget(found)
    near = _places(docs, text_col, 1).select("h", F.get("s", F.lit(0)).alias("s")).where("s <> ''").orderBy("h").limit(max_stretches).collect() if max_stretches else []
    return Language(tuple(dict.fromkeys([*(r.w for r in most), *CODE_WORDS])), transitions(seen), tuple(sorted({r.s for r in near})) or ("",))


def _places(docs: DataFrame, text_col: str, n: int) -> DataFrame:
    """Of each distinct text that is not empty its hash ``h``, and ``s``: the words at ``n`` places of it, none where there is no room."""
    rows = docs.select(F.col(text_col).alias("t"), F.xxhash64(text_col).alias("h")).where(F.length("t") > 0)

    def words(i: Column, x: Column) -> Column:
        some = F.substring("t", F.pmod(F.xxhash64(x["h"], i), x["n"]).cast("int") + 1, F.lit(96))
        return F.regexp_extract(some, r"(?:^|\s)(\S[^\x00-\x1f]{8,46}\s)", 1)

    at = F.struct("h", F.length("t").alias("n"))
    each = let(at, lambda x: F.transform(F.sequence(F.lit(1), F.lit(n)), lambda i: words(i, x)))
    return rows.select("h", each.alias("s")).groupBy("h").agg(F.min("s").alias("s"))


def _table(values, separator: str = "\x01") -> Column:
    """A constant array of strings."""
    return F.split(F.lit(separator.join(values)), separator)


def _share(value: Column, kind: str) -> Column:
    """Share of characters in a character class."""
    return F.regexp_count(value, F.lit(kind)) / F.greatest(F.lit(1), F.length(value))


def likeliness(value: Column, language: Language) -> Column:
    """Mean log-probability of the value's character transitions in words."""
    kinds = "".join(chr(_FIRST + i) for i in range(26)) + chr(_FIRST + 26) * 10 + chr(_FIRST + 27) * 2 + chr(_FIRST + 28)
    codes = F.transform(F.split(F.translate(F.lower(value), _LETTERS + "0123456789-_/", kinds), ""), lambda c: F.ascii(c) - _FIRST)
    codes = F.transform(codes, lambda k: F.when((k < 0) | (k > 28), 29).otherwise(k))
    table = _table([f"{x:.4f}" for x in language.transitions] or ["-3.4"] * _KINDS**2).cast("array<double>")

    def mean(codes: Column) -> Column:
        each = F.zip_with(codes, F.slice(codes, 2, F.size(codes)), lambda a, b: F.coalesce(F.get(table, a * _KINDS + b), F.lit(0.0)))
        return F.aggregate(each, F.lit(0.0), lambda acc, x: acc + x) / F.greatest(F.lit(1), F.size(codes) - 1)

    return let(codes, mean)


def coverage(value: Column, language: Language) -> Column:
    """Share of the value's characters that are whole words of the dictionary; a capital begins a word."""
    known = _table(language.words or CODE_WORDS, " ")
    parts = F.filter(F.regexp_extract_all(value, F.lit("[A-Z]?[a-z]{2,29}|[A-Z]{3,30}"), F.lit(0)), lambda w: F.array_contains(known, F.lower(w)))
    return F.aggregate(parts, F.lit(0), lambda acc, w: acc + F.length(w)) / F.greatest(F.lit(1), F.length(value))


def features(value: Column, before: Column, after: Column, language: Language) -> list[Column]:
    """FEATURES of one candidate, as doubles. Context: up to 48 characters before, 24 after."""
    n = F.greatest(F.lit(1), F.length(value))
    flags = [
        n,
        F.regexp_count(value, F.lit(r"(?<=[a-z])(?=[A-Z0-9])|(?<=[A-Z])(?=[0-9])|(?<=[0-9])(?=[A-Za-z])")) / n,
        likeliness(value, language),
        coverage(value, language),
        _share(value, "/"),
        _share(value, r"[.]"),
        F.regexp_like(before, F.lit(rf"(?i)(?:{POSITIVE})\W{{0,6}}$|(?:{KEYWORDS})(?:s|(?:[_.\-\d]|(?-i:[A-Z][a-z]))[{_RUN}.]*)?\W*(?:(?:bearer|basic)\W+)?$|://[^\s/:@]*:$")).cast("int"),
        F.regexp_like(before, F.lit(rf"(?i)(?<![a-z])(?:{NEGATIVE})\W{{0,6}}$")).cast("int"),
        F.regexp_like(after, F.lit(r"(?i)^[\"']?\s*(?:is an example|placeholder|\.(?:html?|png|jpe?g|pdf|txt))")).cast("int"),
        F.regexp_like(before, F.lit(r"[:=>]\s*[\\\"'`]*$")).cast("int"),
        _share(value, "[0-9]"),
        _share(value, "[A-Z]"),
        F.regexp_like(value, F.lit("^(?:[0-9a-f]+|[0-9A-F]+)$")).cast("int"),
        F.size(F.array_distinct(F.split(value, ""))) / n,
        F.regexp_like(value, F.lit(r"^(?:AKIA|ASIA|gh[pousr]_|github_pat_|sk[-_]|xox[abp]-|AIza|-----BEGIN|eyJ)")).cast("int"),
        _share(value, "[-_]"),
        _share(value, r"[!@#$%^&*?~]"),
    ]
    return [f.cast("double") for f in flags]


def _findings(language: Language):
    """A function from a number and words of a text to the finding of that number, planted after the words, or after nothing."""
    common = [w for w in language.words if w.isalpha()][:400]

    def finding(id_: Column, words: Column) -> Column:
        h = F.sha2(F.concat(F.lit("finding"), id_.cast("string")), 256)
        h2 = F.sha2(F.concat(F.lit("other"), id_.cast("string")), 256)
        wide = F.translate(F.base64(F.unhex(h)), "=", "")
        upper = F.upper(F.translate(F.substring(wide, 1, 40), "+/", "Q7"))
        one_of = lambda i, xs, sep: F.get(_table(xs, sep), F.pmod(F.xxhash64(id_, F.lit(i)), F.lit(len(xs))).cast("int"))
        word = lambda i: F.when(F.pmod(F.xxhash64(id_, F.lit(i), F.lit("w")), F.lit(2)) == 0, one_of(i, CODE_WORDS, " ")).otherwise(one_of(i, common or CODE_WORDS, " "))
        pick = lambda i, *xs: F.element_at(F.array(*(F.lit(x) for x in xs)), (F.pmod(F.xxhash64(id_, F.lit(i)), F.lit(len(xs))) + 1).cast("int"))
        size = (F.pmod(F.xxhash64(id_, F.lit(9)), F.lit(30)) + 12).cast("int")
        prose = F.when(F.pmod(F.xxhash64(id_, F.lit(3)), F.lit(5)) == 0, "").otherwise(words)
        number = F.translate(F.concat(h, h2), "abcdef", "123456")
        letters = F.translate(h, "0123456789abcdef", "eaiotnsrlcdumhgp")
        plain = F.substring(letters, F.lit(1), (F.pmod(F.xxhash64(id_, F.lit(10)), F.lit(9)) + 2).cast("int"))
        few = F.substring(number, F.lit(1), (F.pmod(F.xxhash64(id_, F.lit(11)), F.lit(3)) + 1).cast("int"))
        short = F.concat(F.substring(letters, 1, 4), F.substring(plain, 1, 4), few)
        given = F.concat(prose, pick(5, "password=", "password: ", 'password = "', "SECRET_KEY = '", "api-key: ", "api_token: ", "passphrase: "))
        end = pick(4, " and", '"', "\n", "'", "")
        cases = [  # (label, value, before, after)
            (1, F.concat(F.lit("AKIA"), F.substring(upper, 1, 16)), prose, pick(4, " then", ".", "")),
            (1, F.substring(h, 1, 40), F.concat(prose, pick(5, 'token = "', 'secret = "', "api_key: ", "token=")), pick(4, '" and', '"', "")),
            (1, F.substring(h, F.lit(1), size), F.concat(prose, pick(5, "password=", "passwd: ", 'password = "', "pwd=")), pick(4, " and", "", "\n")),
            (1, F.substring(wide, 1, 40), F.concat(prose, pick(5, "access_key = ", "secret: ", "private_key=", "auth=")), pick(4, " and", "", "\n")),
            (1, F.concat(pick(6, "ghp_", "sk-", "xoxb-", "AIza"), F.substring(F.translate(wide, "+/", "aB"), 1, 36)), prose, pick(4, " and", "", "\n")),
            (1, F.concat(F.lit("-----BEGIN PRIVATE KEY-----\n"), wide, F.lit("\n-----END PRIVATE KEY-----")), prose, F.lit("\n")),
            (1, F.concat(word(1), F.substring(h, 1, 10), F.lit("!")), F.concat(prose, pick(5, "password=", "passwd: ", 'password = "')), pick(4, " and", "", "\n")),
            (1, wide, F.concat(prose, pick(5, "bearer ", "token: ", "auth = ")), pick(4, " and", "", "\n")),
            (0, F.substring(h, 1, 40), F.concat(prose, pick(5, "commit ", "sha1 ", "revision ", "rev: ")), pick(4, " and", ".", "")),
            (0, h, F.concat(prose, pick(5, "sha256: ", "checksum ", "digest=", "sha256=")), pick(4, " and", ".", "")),
            (0, F.substring(h, 1, 32), F.concat(prose, pick(5, "md5 ", "md5: ", "checksum=")), pick(4, " and", ".", "")),
            (0, F.regexp_replace(F.substring(h, 1, 32), "(.{8})(.{4})(.{4})(.{4})(.{12})", "$1-$2-$3-$4-$5"), F.concat(prose, pick(5, "id ", "uuid: ", "guid=", "")), pick(4, " and", ".", "")),
            (0, F.concat_ws("/", word(1), word(2), word(3), F.concat(word(4), F.lit("2"))), F.concat(prose, pick(5, "path ", "file: ", "see ", "")), pick(4, ".html", ".png", ".txt", "")),
            (0, F.concat(word(1), F.initcap(word(2)), F.initcap(word(3)), F.initcap(word(4)), F.lit("2")), F.concat(prose, pick(5, "class ", "see ", "", "the ")), pick(4, " and", ".", "")),
            (0, F.concat_ws("-", word(1), word(2), word(3), F.substring(number, 1, 4)), F.concat(prose, pick(5, "url ", "page ", "", "see ")), pick(4, " and", ".", "")),
            (0, F.concat_ws("_", F.lit("your"), word(1), word(2), F.lit("here123")), F.concat(prose, pick(5, "password=", 'token = "', "api_key: ", "secret=")), pick(4, " and", ".", "")),
            (0, F.substring(number, 1, 18), F.concat(prose, pick(5, "order ", "invoice ", "phone ", "")), pick(4, " and", ".", "")),
            (0, F.concat(F.lit("example"), word(1), F.lit("1234")), F.concat(prose, pick(5, "password=", "passwd: ", "token=")), pick(4, " is an example", " placeholder", "")),
            (0, F.substring(h, 1, 20), F.concat(prose, pick(5, "build ", "version ", "rev ", "image ")), pick(4, " and", ".", "")),
            (0, F.concat_ws("+", word(1), word(2), word(3), F.substring(number, 1, 3)), prose, pick(4, " and", ".", "")),
            (1, short, given, end),
            (1, F.concat(F.translate(word(1), "aeios", "43105"), pick(6, "!", "#", "1", "9!")), given, end),
            (1, F.substring(F.translate(h, "0123456789abcdef", "#q$j!kx-vz%wmtpn"), F.lit(1), (F.pmod(F.xxhash64(id_, F.lit(12)), F.lit(10)) + 7).cast("int")), given, end),
            (1, F.concat(pick(6, "AKIA", "ASIA"), F.substring(F.upper(letters), 1, 16)), prose, pick(4, " then", ".", "")),
            (1, F.concat(pick(6, "ghp_", "sk-", "xoxb-", "AIza"), F.substring(F.translate(wide, "+/0123456789", "aBcDeFgHiJkL"), 1, 36)), prose, pick(4, " and", "", "\n")),
            (1, F.when(F.length(plain) > 6, short).otherwise(F.substring(wide, F.lit(1), size)), F.concat(prose, pick(5, "postgres", "https", "redis", "amqp"), F.lit("://"), pick(7, "app", "", "user", "me"), F.lit(":")), pick(4, "@host", "@db.local/x", "@10.0.0.1")),
            (1, F.concat(F.lit("-----BEGIN PGP PRIVATE KEY BLOCK-----\nVersion: 1\n\n"), wide, F.lit("\n-----END PGP PRIVATE KEY BLOCK-----")), prose, F.lit("\n")),
            (0, F.concat(plain, pick(6, "", ".", ",", "")), given, end),
            (0, F.concat(F.initcap(plain), pick(6, "", ".", ",", "")), F.concat(prose, pick(5, "Password: ", "Secret: ", "Author: ", "secretary: ", "tokenizer = ", "Auth: ")), end),
            (0, F.concat_ws("_", plain, word(1)), F.concat(prose, pick(5, "password=", "token = ", "auth: ", "secret=")), pick(4, ", ", ")", "\n")),
            (0, F.concat(pick(6, "self.", "os.environ[", "getenv(", "request.", "${", "config."), pick(7, "password", "token", "SECRET", "API_KEY"), pick(8, "", ")", "}", ",")), given, end),
            (0, pick(6, "null", "None", "true", "False", "****", "string", "str", "xxxxxxxx", "...", "{", "[", "-", "1", "is", "|"), given, end),
            (0, F.concat(few, pick(6, "", ",", ".", "0")), F.concat(prose, pick(5, "tokens: ", "token_count = ", "tokens=", "auth_attempts: ")), end),
            (0, F.concat(pick(6, "sk-", "sk_"), F.concat_ws("-", word(1), plain, word(2))), prose, pick(4, " and", ".", "")),
        ]
        k = F.pmod(F.xxhash64(id_), F.lit(len(cases)))
        cols = []
        for name, at in (("value", 1), ("before", 2), ("after", 3), ("label", 0)):
            pick_ = [F.lit(c[at]) if at == 0 else c[at] for c in cases]
            col = pick_[0]
            for i, c in enumerate(pick_[1:], 1):
                col = F.when(k == i, c).otherwise(col)
            cols.append(col.alias(name))
        return F.struct(*cols)

    return finding


def _table_of(rows: DataFrame, finding) -> DataFrame:
    """The findings of ``rows`` (id, words): value, before, after, label (1: a secret)."""
    # inside an array function the many cases are interpreted, not compiled
    each = F.transform(F.array(F.struct("id", "words")), lambda r: finding(r["id"], r["words"]))
    return rows.select(F.explode(each).alias("f")).select("f.*")


def labelled_findings(spark: SparkSession, language: Language = Language(), n: int = 10_000, first: int = 0) -> DataFrame:
    """Findings planted by rule into the language's stretches: value, before, after, label (1: a secret).

    Numbers ``first`` to ``first + n`` of an endless list, the same at each call; others are for tests.
    """
    words = F.get(_table(language.stretches), F.pmod(F.xxhash64("id", F.lit(13)), F.lit(len(language.stretches))).cast("int"))
    return _table_of(spark.range(first, first + n, 1, 2).withColumn("words", words), _findings(language))


def planted(docs: DataFrame, language: Language, text_col: str = "text", least: int = 10_000) -> DataFrame:
    """Findings planted by rule into every distinct text, one in each; several where that makes fewer than ``least``.

    The table is the same at each call, order and partitions too: a forest's draws go by them.
    """
    total = docs.where(F.length(text_col) > 0).select(F.xxhash64(text_col)).distinct().count()
    if not total:
        return labelled_findings(docs.sparkSession, language, least)
    per = -(-least // total)
    places = min(per, 16)
    rows = _places(docs, text_col, places).withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(per - 1))))
    rows = rows.select(F.xxhash64("h", "i").alias("id"), F.get("s", F.col("i") % places).alias("words"))
    return _table_of(rows.repartition(2 + total // 10_000, "id").sortWithinPartitions("id", "words"), _findings(language))


def _tree(lines: list[str], at: int = 0):
    """A tree of ``toDebugString`` as nested (feature, cut, low, high), leaves as numbers; next line."""
    line = lines[at].strip()
    if line.startswith("Predict"):
        return float(line.split(":")[1]), at + 1
    m = re.match(r"If \(feature (\d+) <= (\S+)\)", line)
    low, at = _tree(lines, at + 1)
    high, at = _tree(lines, at + 1)  # the line "Else (...)"
    return (int(m[1]), float(m[2]), low, high), at


class Forest:
    """Trees end to end in constant arrays: node k tests feature[k] <= cut[k], a leaf leads to itself; the score is their mean vote."""

    def __init__(self, trees: list, language: Language):
        self.trees, self.language, self.depth = trees, language, 0
        self.nodes: list[tuple] = []  # (feature, cut, low, high, value)
        self.roots = [self._lay(t, 0) for t in trees]

    def _lay(self, t, depth: int) -> int:
        k = len(self.nodes)
        self.nodes.append((0, 0.0, k, k, t))
        if not isinstance(t, float):
            self.depth = max(self.depth, depth + 1)
            self.nodes[k] = (t[0], t[1], self._lay(t[2], depth + 1), self._lay(t[3], depth + 1), 0.0)
        return k

    def probability(self, x: Column) -> Column:
        feature, cut, low, high, value = (_table(map(repr, c), " ").cast(f"array<{k}>") for c, k in zip(zip(*self.nodes, strict=True), ("int", "double", "int", "int", "double"), strict=True))
        step = lambda k, _: F.when(F.get(x, F.get(feature, k)) <= F.get(cut, k), F.get(low, k)).otherwise(F.get(high, k))
        leaf = lambda root: F.aggregate(F.sequence(F.lit(1), F.lit(max(1, self.depth))), root, step)
        roots = _table(map(repr, self.roots), " ").cast("array<int>")
        return F.aggregate(roots, F.lit(0.0), lambda total, root: total + F.get(value, leaf(root))) / float(len(self.roots))


def cuts_of(rows: DataFrame, bins: int = 32, digits: int = 3) -> list[list[float]]:
    """Where each element of the arrays ``x`` may be cut: between its values in all rows, rounded, ``bins`` parts at most.

    A part has at least a hundredth of the rows where values allow, so that Spark, which looks for the places in about
    10,000 rows, finds all of them.
    """
    each = rows.select(F.posexplode("x").alias("f", "v")).groupBy("f", F.round("v", digits).alias("v")).agg(F.count("*").alias("n"))
    values: dict[int, list] = {}
    for r in each.orderBy("f", "v").collect():
        values.setdefault(r.f, []).append((r.v, r.n))
    out = []
    for f in range(len(FEATURES)):
        found = values.get(f, [])
        total = sum(n for _, n in found)
        part = total / (100 if len(found) <= bins else bins)
        cuts, have, rest = [], 0, total
        for (v, n), (w, _) in zip(found, found[1:], strict=False):
            have, rest = have + n, rest - n
            if have >= part and rest >= total / 100:
                cuts.append((v + w) / 2)
                have = 0
        out.append(cuts)
    return out


def _counted(findings: DataFrame, language: Language) -> tuple[DataFrame, DataFrame, list[list[float]]]:
    """(training rows, the persisted table below them, cuts): a row's features are the numbers of cuts below them."""
    from pyspark.ml.functions import array_to_vector

    rows = findings.na.drop(subset=["value", "before", "after", "label"])
    # inside an array function each column is made once, whatever number of features read it
    x = F.transform(F.array(F.struct("value", "before", "after")), lambda f: F.array(*features(f["value"], f["before"], f["after"], language)))
    raw = rows.select(F.get(x, F.lit(0)).alias("x"), F.col("label").cast("double").alias("label")).persist()
    cuts = cuts_of(raw)
    table = F.transform(_table([" ".join(map(repr, c)) for c in cuts]), lambda c: F.filter(F.split(c, " "), lambda y: y != "").cast("array<double>"))
    below = F.zip_with("x", table, lambda v, c: F.size(F.filter(c, lambda y: y < v)).cast("double"))
    return raw.select(array_to_vector(below).alias("features"), "label"), raw, cuts


def _grown(rows: DataFrame, trees: int = 24, depth: int = 8, seed: int = 5):
    from pyspark.ml.classification import RandomForestClassifier

    rows.persist()
    model = RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=seed, featureSubsetStrategy="sqrt").fit(rows)
    rows.unpersist()
    return model


def fit(findings: DataFrame, language: Language, **how):
    """(Spark's model, its training rows) from labelled findings (value, before, after, label); rows with nulls are not used."""
    rows, raw, _ = _counted(findings, language)
    model = _grown(rows, **how)
    raw.unpersist()
    return model, rows


def train(findings: DataFrame, language: Language = Language(), **how) -> Forest:
    rows, raw, cuts = _counted(findings, language)
    model = _grown(rows, **how)
    raw.unpersist()

    def raised(t):
        """The tree by features, not by numbers of cuts."""
        return t if isinstance(t, float) else (t[0], cuts[t[0]][int(t[1])], raised(t[2]), raised(t[3]))

    out = []
    for block in re.split(r"\n\s*Tree \d+ \(weight [^)]*\):\n", model.toDebugString)[1:]:
        out.append(raised(_tree([x for x in block.split("\n") if x.strip()])[0]))
    return Forest(out, language)


def trained(docs: DataFrame, text_col: str = "text") -> Forest:
    """A forest for these documents: their language, and findings planted into each of them."""
    language = learn_language(docs, text_col, max_stretches=0)
    return train(planted(docs, language, text_col), language)


def _value(candidate: Column) -> Column:
    """The candidate without the name it is assigned to, or the URL before it."""
    return F.regexp_replace(candidate, rf"^(?:{_ASSIGN}|{_URL_HEAD})", "")


def judged(text: Column, forest: Forest) -> Column:
    """Array of (value, start, p) of a text's candidates; start counts code points from 0."""
    both = F.struct(F.regexp_extract_all(text, F.lit(CANDIDATE), F.lit(0)).alias("found"), F.split(text, CANDIDATE, -1).alias("between"))

    def place(b: Column) -> Column:
        """Candidates with the pieces around them and their places."""
        sizes = F.zip_with(b["between"], b["found"], lambda p, c: F.length(p) + F.coalesce(F.length(c), F.lit(0)))
        return let(running(sizes), lambda at: F.transform(b["found"], lambda c, i: F.struct(c.alias("c"), F.get(b["between"], i).alias("before"), F.get(b["between"], i + 1).alias("after"), (F.get(at, i) + F.length(F.get(b["between"], i))).alias("at"))))

    def one(z: Column) -> Column:
        value = _value(z["c"])
        gone = F.length(z["c"]) - F.length(value)
        before = F.right(F.concat(F.right(z["before"], F.lit(48)), F.regexp_replace(F.left(z["c"], gone), r"\s+", " ")), F.lit(48))
        return F.struct(value.alias("value"), before.alias("before"), F.left(z["after"], F.lit(24)).alias("after"), (z["at"] + gone).alias("start"))

    found = F.transform(let(both, place), one)
    found = F.transform(found, lambda f: F.struct(f["value"].alias("value"), f["start"].alias("start"), F.array(*features(f["value"], f["before"], f["after"], forest.language)).alias("x")))
    return F.transform(found, lambda f: F.struct(f["value"].alias("value"), f["start"].alias("start"), forest.probability(f["x"]).alias("p")))


def _candidate(text: Column) -> Column:
    return F.regexp_like(text, F.lit(CANDIDATE))


def scan(docs: DataFrame, forest: Forest, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",), threshold: float = 0.5) -> DataFrame:
    """One row a candidate: ``keep``, start, length, value digest, probability, is_secret."""
    rows = docs.where(_candidate(F.col(text_col))).select(*keep, F.explode(judged(F.col(text_col), forest)).alias("_f"))
    return rows.select(*keep, F.col("_f.start").cast("long").alias("start"), F.length("_f.value").cast("long").alias("length"), F.sha2(F.col("_f.value").cast("binary"), 256).alias("value_sha256"), F.col("_f.p").alias("probability"), (F.col("_f.p") >= threshold).alias("is_secret"))


def redact(docs: DataFrame, forest: Forest, text_col: str = "text", threshold: float = 0.5, by: str = "[SECRET]") -> DataFrame:
    """``docs`` with each secret's value replaced throughout its text; other rows and columns stay."""
    t = F.col(text_col)
    secrets = F.array_distinct(F.transform(F.filter(judged(t, forest), lambda f: f["p"] >= threshold), lambda f: f["value"]))
    longest = F.array_sort(secrets, lambda a, b: F.length(b) - F.length(a))
    clean = F.aggregate(longest, t, lambda acc, v: F.replace(acc, v, F.lit(by)))
    return docs.withColumn(text_col, F.when(_candidate(t), clean).otherwise(t))


def op5_secret_scan(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return scan(docs, trained(docs))


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: secrets in texts are masked, and n_chars follows the text."""
    was = free_name(docs.columns, "_was")
    out = redact(docs.withColumn(was, F.col("text")), trained(docs))
    chars = F.when(F.col("text").eqNullSafe(F.col(was)), F.col("n_chars")).otherwise(F.length("text").cast("long"))
    return out.withColumn("n_chars", chars).select(*docs.columns)
