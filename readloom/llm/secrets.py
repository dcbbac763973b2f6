"""Secret scan: candidates by pattern, false positives removed by a random forest.

A candidate is a run of at least 12 token characters with a digit in it; a run of at least 20 of them whose letters
change case often; a value of 6 or more characters that a secret word is assigned (in quotes also with blanks); the
password of a URL; or a block of a private key. Other shapes, such as a short password without a secret word before
it, are not judged. Features are length, character make-up, transitions between character classes, common letter
pairs, the shares that dictionary words and words of placeholders cover, marks of a path or URL around it, and the
words beside it. The forest is grown on the driver from labelled
findings (a bounded set; by default the generated ones below) whose features the same expressions compute, and
becomes one SQL expression. Everything over the corpus is Spark SQL on arrays within a row: no shuffle, so
no key can be hot.

Defined cases: null and empty texts have no candidate; very long texts are scanned whole; a null doc_id passes through; repeated rows are each
reported; an empty table gives an empty result; other columns are ignored (pipeline stage: kept as they are).
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cache

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

# Shapes of candidates. What LEAD finds at the beginning of a match stays outside the candidate.
_ASSIGNED = r"(?i:passw(?:or)?d|passphrase|pwd|secret|token|api[_-]?key|(?:access|auth|private)[_-]?key|credentials?)[A-Za-z0-9_-]{0,12}[\"']?\s{0,2}(?:=>|:=|[:=])\s{0,2}"
_USER = r"(?<![A-Za-z0-9+.-])[A-Za-z][A-Za-z0-9+.-]{1,20}://[^\s:/@]{0,64}:"
_KEY = r"(?:[A-Z0-9]{1,12} ){0,3}PRIVATE KEY(?: BLOCK)?-----"
_BREAK = r"(?:\s|\\[nr]){1,4}"
CANDIDATE = "|".join((
    rf"-----BEGIN {_KEY}(?:{_BREAK}[A-Za-z0-9+/]{{16,200}}={{0,2}}){{0,400}}(?:{_BREAK}[A-Za-z0-9+/]{{1,15}}={{0,2}}(?={_BREAK}-----END))?(?:{_BREAK}-----END {_KEY})?",
    rf"{_USER}[^\s/@]{{3,}}(?=@)",
    rf"{_ASSIGNED}(?:\"(?=[^\"\n]{{6,200}}\")[^\"\n]+|'(?=[^'\n]{{6,200}}')[^'\n]+|[\"'`]?[^\s\"'`,;<>]{{5,}}[^\s\"'`,;<>.:)])",
    r"(?<![A-Za-z0-9_+/-])(?=[A-Za-z_+/-]*+[0-9])[A-Za-z0-9_+/-]{12,}+={0,2}",
    r"(?<![A-Za-z0-9_+/-])(?=(?:[a-z]{0,3}[A-Z]{1,3}){5})[A-Za-z_+/-]{20,}+",
))
LEAD = rf"^(?:{_USER}|{_ASSIGNED}[\"'`]?)(?=[\s\S]{{3}})"
BEFORE, AFTER, THRESHOLD, MASK = 40, 12, 0.5, "[SECRET]"
GROUP = 256
TREES, DEPTH, SEED = 25, 7, 7
# Dictionary words, and words that stand beside secrets and beside other long tokens.
DICTIONARY = (
    "about account address admin after again and answer application article before build bytes cache change check class client code color "
    "column common component config content control count create data date default delete demo detail device document dummy error event "
    "example factory field file first format from function group handler header home http https image index info input insert item kind last "
    "line link list local main manager member message method model module name network number object option order other output package page "
    "parameter part password path picture place placeholder point print process product project public query read record release report request "
    "resource response result return sample screen script search section select server service session setting simple size source start state "
    "static status store string style system table target template test text that the this time title token total type update upload user "
    "value version video view were what when which will window with word world write year your nicht eine einer und der die das pour dans avec "
    "les des que para como una los las"
).split()
PLACEHOLDERS = "required optional none null true false undefined empty redacted hidden changeme placeholder example sample dummy your enter insert please must should contain unset unknown string value here environ getenv config settings input prompt".split()
SECRET_WORDS = "password passwd pwd passphrase secret token api_key apikey api-key key credential credentials auth authorization bearer private access_key access login".split()
OTHER_WORDS = "sha sha1 sha256 md5 checksum digest hash commit revision rev uuid guid etag id isbn doi order invoice phone tel card version build ticket serial ref figure".split()
PAIRS = "th he in er an re on at en nd ti es or te of ed is it al ar st to nt ch ei ie de le ou la qu co ra".split()


def _any(words: list[str]) -> str:
    return "|".join(sorted(words, key=lambda w: (-len(w), w)))


def features(token: Column, before: Column, after: Column) -> dict[str, Column]:
    """Numbers of one candidate; before and after are the characters beside it."""
    n = F.length(token).cast("double")
    low = F.lower(token)
    left = lambda pattern: n - F.length(F.regexp_replace(token, pattern, ""))
    flag = lambda c: F.when(c, 1.0).otherwise(0.0)
    near = F.lower(F.regexp_replace(before, r"[^A-Za-z0-9_-]+", " "))
    return {
        "length": n,
        "digits": left("[0-9]+") / n,
        "capitals": left("[A-Z]+") / n,
        "marks": left("[A-Za-z0-9]+") * -1 / n + 1,
        "transitions": F.regexp_count(token, F.lit("[0-9](?=[A-Za-z])|[A-Za-z](?=[0-9])|[a-z](?=[A-Z])|[A-Z](?=[a-z])")) / n,
        "pairs": F.regexp_count(low, F.lit(f"(?={_any(PAIRS)})")) / n,
        "distinct": F.size(F.array_distinct(F.split(token, ""))) / F.least(n, F.lit(40.0)),
        "dictionary": (n - F.length(F.regexp_replace(low, _any([w for w in DICTIONARY if len(w) > 3]), ""))) / n,
        "placeholder": (n - F.length(F.regexp_replace(low, _any(PLACEHOLDERS), ""))) / n,
        "template": flag(token.rlike(r"^[\[{<$%(*]|[({]\S*[)}]$|\$\{|\{\{|\w\[|[a-z]\.[a-z]|^(.)\1+$")),
        "user": flag(before.rlike(r"://[^\s:/@]*:$")),
        "hexadecimal": flag(token.rlike("^([0-9a-f]+|[0-9A-F]+)$")),
        "grouped": flag(token.rlike("^[0-9A-Fa-f]+(-[0-9A-Fa-f]+)+$|^[0-9]+([-/][0-9A-Za-z]+)+$")),
        "prefix": flag(token.rlike("^(AKIA|ASIA|gh[pousr]_|sk[-_]|pk_|xox[abprs]-|AIza|eyJ|glpat-|npm_|-----BEGIN )")),
        "path": F.regexp_count(token, F.lit("/")) / n + flag(before.rlike(r"([/.@]|https?:\S*|[A-Za-z]:\\)$") | after.rlike(r"^([.@][A-Za-z]|/)")),
        "assigned": flag(before.rlike("[=:]\\s*[\"'`]?$")),
        "quoted": flag(before.rlike("[\"'`]$") & after.rlike("^[\"'`]")),
        "secret_word": flag(near.rlike(rf"(^|[^a-z])({_any(SECRET_WORDS)})(\s\S*)?\s*$")),
        "other_word": flag(near.rlike(rf"(^|[^a-z])({_any(OTHER_WORDS)})(\s\S*)?\s*$")),
    }


NAMES = [
    "length", "digits", "capitals", "marks", "transitions", "pairs", "distinct", "dictionary", "placeholder", "template", "user", "hexadecimal", "grouped", "prefix", "path",
    "assigned", "quoted", "secret_word", "other_word",
]


def _bind(value: Column, body) -> Column:
    """body of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _total(numbers: Column) -> Column:
    return F.aggregate(numbers, F.lit(0), lambda a, x: a + x)


def _before(sizes: Column) -> Column:
    """What all sizes before each group of GROUP add up to: sums of sums, so that many candidates in one text cost
    no more than their number times GROUP."""
    groups = F.transform(F.sequence(F.lit(0), (F.size(sizes) / GROUP).cast("int")), lambda k: _total(F.slice(sizes, k * GROUP + 1, F.lit(GROUP))))
    return F.aggregate(groups, F.array(F.lit(0)), lambda a, x: F.concat(a, F.array(F.element_at(a, -1) + x)))


def _candidates(text: Column) -> Column:
    """array<struct<lead, token, before, after, start>>; gaps are the texts between matches, lead what a match has
    before its candidate."""
    tokens, gaps = F.regexp_extract_all(text, F.lit(CANDIDATE), F.lit(0)), F.split(text, CANDIDATE, -1)

    def described(parts: Column) -> Column:
        t, g = parts.tokens, parts.gaps
        return _bind(F.transform(t, lambda x, i: F.length(x) + F.length(F.get(g, i))), lambda sizes: _bind(_before(sizes), lambda ends: F.transform(
            t, lambda x, i: _bind(F.regexp_extract(x, LEAD, 0), lambda lead: F.struct(
                lead.alias("lead"), F.substring(x, F.length(lead) + 1, F.length(x)).alias("token"),
                F.substring(F.concat(F.get(g, i), lead), -BEFORE, BEFORE).alias("before"), F.substring(F.get(g, i + 1), 1, AFTER).alias("after"),
                (F.get(ends, (i / GROUP).cast("int")) + _total(F.slice(sizes, (i / GROUP).cast("int") * GROUP + 1, i % GROUP + 1)) - F.length(x) + F.length(lead)).cast("long").alias("start"))))))

    parts = F.array(F.struct(tokens.alias("tokens"), gaps.alias("gaps")))
    none = F.array().cast("array<struct<lead:string,token:string,before:string,after:string,start:bigint>>")
    return F.when(text.rlike(CANDIDATE), F.get(F.transform(parts, described), F.lit(0))).otherwise(none)


@dataclass
class Node:
    share: float
    feature: int = -1
    cut: float = 0.0
    low: Node | None = None
    high: Node | None = None


def grow(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, seed: int = SEED) -> list[Node]:
    """Bootstrap samples, a random third of the features at each split, Gini impurity."""
    rng = np.random.default_rng(seed)

    def split(rows: np.ndarray, left: int) -> Node:
        share = float(y[rows].mean())
        node = Node(round(share, 6))
        if left == 0 or share in (0.0, 1.0) or len(rows) < 6:
            return node
        best = (1e-9, -1, 0.0)
        for f in sorted(rng.choice(x.shape[1], max(1, x.shape[1] // 3), replace=False)):
            order = rows[np.argsort(x[rows, f], kind="stable")]
            v, t = x[order, f], np.cumsum(y[order])
            k = np.flatnonzero(v[1:] > v[:-1]) + 1
            if not len(k):
                continue
            n, ones = len(order), t[-1]
            a, b = t[k - 1] / k, (ones - t[k - 1]) / (n - k)
            gain = share * (1 - share) - (k * a * (1 - a) + (n - k) * b * (1 - b)) / n
            j = int(gain.argmax())
            if gain[j] > best[0]:
                best = (float(gain[j]), int(f), round(float(v[k[j] - 1] + v[k[j]]) / 2, 6))
        if best[1] < 0:
            return node
        high = x[rows, best[1]] > best[2]
        if high.all() or not high.any():
            return node
        node.feature, node.cut = best[1], best[2]
        node.low, node.high = split(rows[~high], left - 1), split(rows[high], left - 1)
        return node

    return [split(rng.integers(0, len(y), len(y)), depth) for _ in range(trees)]


def scored(forest: list[Node], f: Column) -> Column:
    """The mean vote of the trees on a struct of features, as one expression."""

    def tree(node: Node) -> Column:
        if node.feature < 0:
            return F.lit(node.share)
        return F.when(f[NAMES[node.feature]] > node.cut, tree(node.high)).otherwise(tree(node.low))

    total = tree(forest[0])
    for node in forest[1:]:
        total = total + tree(node)
    return total / len(forest)


def labelled_findings(seed: int = SEED, each: int = 60) -> list[tuple[str, str, str, int]]:
    """Generated findings (token, before, after, 1 for a secret): the default training set."""
    rng = np.random.default_rng(seed)
    pick = lambda items: items[int(rng.integers(len(items)))]
    draw = lambda alphabet, n: "".join(pick(alphabet) for _ in range(n))
    lower, upper, digit, hexa = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", "0123456789abcdef"
    prose = lambda: " ".join(pick(DICTIONARY) for _ in range(4)) + " "
    out: list[tuple[str, str, str, int]] = []
    for _ in range(each):
        mixed = lambda n: draw(lower + upper + digit, n - 2) + draw(digit, 1) + draw(upper, 1)
        word, sign = pick(SECRET_WORDS), pick(["=", ": ", ' = "', "='", ':"', " "])
        end = {'"': '"', "'": "'"}.get(sign[-1], pick([" ", "\n", ", "]))
        for token in (draw(hexa, pick([18, 24, 32, 40, 64])), mixed(pick([16, 20, 32, 40])), draw(lower + digit, 14) + "7", mixed(30) + "/" + mixed(9), draw(lower, 8) + draw(digit, 5)):
            out.append((token, prose() + word + sign, end + prose()[:8], 1))
        assigned = prose() + pick(SECRET_WORDS[:9]) + pick(["=", ": ", " = \"", ": '"])
        special = lambda: pick("!@#$%^&*?+")
        words = [pick(DICTIONARY) for _ in range(4)]
        case = lambda n: "".join(pick(lower) + pick(upper) if rng.random() < 0.7 else pick(lower + upper) for _ in range(n))
        for token in (
            draw(lower, int(rng.integers(4, 8))) + draw(digit, int(rng.integers(1, 4))) + draw(lower, int(rng.integers(0, 3))),
            words[0].title() + special() + draw(digit, int(rng.integers(2, 5))), "".join(pick(lower + upper + digit + "!@#$%&*?") for _ in range(int(rng.integers(7, 16)))),
            pick(words).replace("a", "4").replace("e", "3").replace("o", "0") + draw(digit, 2) + special(), case(int(rng.integers(9, 16))), pick("-_ ").join(words),
            draw(lower, int(rng.integers(8, 13))),
        ):
            out.append((token, assigned, end + prose()[:8], 1))
        out.append((case(int(rng.integers(12, 18))), prose() + pick(["", word + sign]), pick([" ", "\n", ". "]) + prose()[:6], 1))
        for token in (draw(lower, 6) + draw(digit, 2), mixed(9), "".join(pick(lower + upper + digit + "!#$%") for _ in range(10)), draw(lower, 5)):
            out.append((token, prose() + pick(["postgres", "https", "redis", "ftp", "mysql", "amqp"]) + "://" + pick(["admin", "root", "app", ""]) + ":", "@" + pick(["db", "host", "10.0.0.1"]) + pick([":5432/x", "/"]), 1))
        out.append((f"-----BEGIN {pick(['RSA ', 'EC ', 'OPENSSH ', ''])}PRIVATE KEY-----" + pick(["", "\n" + mixed(64) + "\n" + mixed(64)]), prose(), pick(["\n", " "]), 1))
        placeholder = pick(PLACEHOLDERS)
        for token in (
            placeholder + pick(["", "_" + pick(words), " " + pick(words)]), pick(words) + pick(["", "s", " " + pick(words)]) + " " + placeholder, f"${{{pick(words).upper()}_{word.upper()}}}", f"{{{{ {pick(words)} }}}}",
            f"os.environ['{word.upper()}']", f"process.env.{word.upper()}", f"config.{pick(words)}.{word}", f"get_{pick(words)}()", pick("*x.") * int(rng.integers(6, 13)), f"<{pick(words)}-{word}>", f"[{placeholder.upper()}]",
            f"${pick(words).upper()}", f"self.{pick(words)}_{word}", pick(words) + "ing", f"{pick(['str', 'Optional[str]', 'string', 'boolean'])}",
        ):
            out.append((token, assigned, pick([end, " "]) + prose()[:8], 0))
        for token in ("password", "pass", "secret", f"${{{pick(words).upper()}}}", f"<{placeholder}>", "***", f"${word.upper()}"):
            out.append((token, prose() + pick(["postgres", "https", "redis"]) + "://" + pick(["user", "username", "admin"]) + ":", "@" + pick(["host", "localhost", "db"]), 0))
        out.append((pick(lower).join(w.title() for w in words) + pick(["", "Handler", "Factory"]), prose() + pick(["", "class ", "= new "]), pick(["(", ".", " "]), 0))
        for token in ("AKIA" + draw(upper + "234567", 15) + "3", "ghp_" + mixed(36), "sk-" + mixed(40), "xoxb-" + draw(digit, 12) + "-" + mixed(20), "AIza" + mixed(35), "eyJ" + mixed(60)):
            out.append((token, prose() + pick(["", "", word + sign]), " " + prose()[:8], 1))
        uuid = "-".join(draw(hexa, n) for n in (8, 4, 4, 4, 12))
        names = [pick(DICTIONARY) for _ in range(3)]
        tail = pick([" ", "\n", ". ", ", "]) + prose()[:6]
        other = pick(OTHER_WORDS)
        for token, before, after in (
            (draw("4", 1) + draw(digit, 15), prose(), tail),
            (draw(digit, pick([12, 14, 16, 20])), prose() + pick(["", other + " ", other + ": "]), tail),
            (draw(hexa, pick([32, 40, 64])), prose() + other + pick([" ", ": ", "="]), tail),
            (draw(hexa, 40), prose() + pick(["", "https://example.org/commit/"]), tail),
            (uuid, prose() + pick(["", other + " ", other + "="]), tail),
            ("/".join(names) + draw(digit, 2), prose() + pick(["/", "./", "https://example.org/"]), pick([".py", ".html", "/x", " "])),
            ("_".join(names) + draw(digit, 1), prose() + pick(["", "= ", "("]), pick(["(", " ", ")"])),
            ("".join(n.title() for n in names) + draw(digit, 2), prose(), tail),
            ("-".join(names) + "-" + draw(digit, 4), prose() + pick(["", "https://example.org/"]), tail),
            (f"20{draw(digit, 2)}-0{draw('123456789', 1)}-1{draw(digit, 1)}T0{draw(digit, 1)}", prose(), ":00:00"),
            ("your_" + pick(["token", "key", "password"]) + "_here1", prose() + word + sign, end),
            ("example" + draw("x", 6) + "1234", prose() + word + sign, end),
            (f"{draw(digit, 3)}-555-{draw(digit, 4)}", prose() + pick(["", "tel "]), tail),
            (pick(names) + draw(digit, 9), prose() + pick(["@", "#", ""]), tail),
        ):
            out.append((token, before[-BEFORE:], after[:AFTER], 0))
    return out


@cache
def _forest(app: str, findings: tuple) -> list[Node]:
    spark = SparkSession.active()
    data = spark.createDataFrame(list(findings), "token string, before string, after string, label int")
    rows = data.select("label", *[c.cast("double").alias(k) for k, c in features(F.col("token"), F.col("before"), F.col("after")).items()]).collect()
    x = np.array([[r[k] for k in NAMES] for r in rows])
    y = np.array([r.label for r in rows], dtype=np.float64)
    return grow(x, y)


def forest(spark: SparkSession, findings: list[tuple[str, str, str, int]] | None = None) -> list[Node]:
    return _forest(spark.sparkContext.applicationId, tuple(findings or labelled_findings()))


def with_findings(docs: DataFrame, trees: list[Node]) -> DataFrame:
    """docs and _findings: array<struct<lead, token, start, score>> of every candidate of the whole text."""
    described = F.transform(
        _candidates(F.col("text")),
        lambda c: F.struct(c.lead.alias("lead"), c.token.alias("token"), c.start.alias("start"), F.struct(*[x.cast("double").alias(k) for k, x in features(c.token, c.before, c.after).items()]).alias("f")),
    )
    judged = F.transform(described, lambda c: F.struct(c.lead.alias("lead"), c.token.alias("token"), c.start.alias("start"), scored(trees, c.f).alias("score")))
    return docs.withColumn("_findings", judged)


def scan(docs: DataFrame, trees: list[Node] | None = None) -> DataFrame:
    """One row a candidate: doc_id, finding (its number in the text), start, length, value_sha256, score, is_secret."""
    trees = trees or forest(docs.sparkSession)
    found = with_findings(docs.select("doc_id", "text"), trees).select("doc_id", F.posexplode("_findings").alias("finding", "x"))
    return found.select(
        "doc_id", "finding", "x.start", F.length("x.token").cast("long").alias("length"), F.sha2("x.token", 256).alias("value_sha256"),
        F.round("x.score", 6).alias("score"), (F.col("x.score") >= THRESHOLD).alias("is_secret"),
    )


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the documents stay; each secret in a text gives way to MASK, and n_chars follows."""
    names = docs.columns
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("_row"), F.col("text"))
    found = with_findings(rows, forest(spark))
    shown = F.transform("_findings", lambda c: F.concat(c.lead, F.when(c.score >= THRESHOLD, F.lit(MASK)).otherwise(c.token)))
    gaps = F.split("text", CANDIDATE, -1)
    text = F.when(
        F.exists("_findings", lambda c: c.score >= THRESHOLD),
        F.array_join(F.zip_with(gaps, shown, lambda g, s: F.concat(g, F.coalesce(s, F.lit("")))), ""),
    ).otherwise(F.col("text"))
    out = found.select("_row", text.alias("_text"))
    columns = [F.col("_text").alias(c) if c == "text" else F.length("_text").cast("long").alias(c) if c == "n_chars" else F.col(f"_row.`{c}`").alias(c) for c in names]
    return out.select(*columns)
