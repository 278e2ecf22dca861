"""Secret scans with a random forest that removes false positives, in DataFrame functions only.

Candidates are what a word for secrets leads ("password is ...", to the closing quote or white space, 4 characters or
more), passwords in addresses (3 or more), keys between their lines, and runs of key characters: 16 or more anywhere, 8
or more where something is assigned. A name before its value is none, however long. Each is described by
its length and alphabet, by its character transitions (mean log-likelihood of its letter pairs among the corpus's
words), by dictionary coverage (its parts among the corpus's frequent words), by the path it was found under, and by the
words next to it. A forest trained on labelled findings then votes. The fitted trees become one Column expression, so
scanning is a projection: no join, no shuffle, and the text can be redacted in the same row.

Labelled findings come from the caller or are planted: seeded keys, passwords and look-alikes (commit hashes, checksums,
order numbers, identifiers, paths, prose in base64, placeholders, test fixtures) between words of sampled documents.
Their labels say what was planted; no rule over the features makes them. What a neighbouring word says is learned from
one half of the findings, the forest from the other.
"""

from __future__ import annotations

import math
import re
from typing import NamedTuple

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldloom.operators.shared import bounded_batches, checkpoint

#: Findings that are planted, in so many documents at most; distinct findings of each class that the forest is fitted on.
FINDINGS, CONTEXTS, SAMPLE = 10_000, 2_500, 6_000
TREES, DEPTH, SEED = 16, 7, 5
#: Frequent words of the corpus that make the dictionary, and neighbouring words with a meaning, at most.
DICTIONARY, NEIGHBOURS = 4_000, 300
REDACTED = "[REDACTED]"

_KEY = r"[A-Za-z0-9_+/.-]"
#: One or two closing "=" belong to a value, but not where another value, quoted or not, follows: that one is a name.
_END = r"[A-Za-z0-9_+/-](?:={1,2}(?![^\s\"'`,;)\]}]|[\"'`][A-Za-z0-9_+/-]))?"
#: Words that name a secret, and what stands between a name and its value. The look ahead spares the long
#: look back wherever nothing leads on.
KEYWORD = r"(?i:pass(?:word|wd|phrase)?|pwd|secret|token|credential|bearer|auth|api[_-]?key|access[_-]?key|private[_-]?key)"
_LED = rf"(?=[=:]|\bis\b)(?<={KEYWORD}[A-Za-z0-9_\"'`\]]{{0,24}}\s{{0,3}})(?:=>|:=|==?|:|\bis\b)\s{{0,3}}"
#: Each alternative: what precedes a value (kept), the value. In order: a key between its lines, the password in an address,
#: what a keyword leads (to the closing quote, or to white space), another assigned value; or a long value anywhere.
_FORMS = (
    (r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----\s*", r"[A-Za-z0-9+/=\s]*[A-Za-z0-9+/=](?=\s*-----END)"),
    (r"://[^\s:/@\"'`]{0,64}:", r"[^\s:/@\"'`]{3,}(?=@)"),
    (_LED + r"[\"'`]", r"[^\"'`\r\n]{4,}+(?=[\"'`])"),
    (_LED + r"[\"'`]?", r"[^\s\"'`]{3,}[^\s\"'`,.;:!?()\[\]{}<>]"),
    (r"[=:]\s{0,3}[\"'`]?", rf"{_KEY}{{7,}}{_END}"),
)
CANDIDATE = "|".join(f"({before})({value})" for before, value in _FORMS) + rf"|(?<!{_KEY})({_KEY}{{15,}}{_END})"
_BEFORE, _VALUE = "".join(f"${2 * i + 1}" for i in range(len(_FORMS))), "".join(f"${2 * i + 2}" for i in range(len(_FORMS))) + f"${2 * len(_FORMS) + 1}"
#: A name and what follows it: it is no candidate of its own, however long.
_NAME, _NAMES = r"^[A-Za-z_.-]+[0-9]{0,3}$", r"^[\"'`\]]{0,2}\s{0,3}(?:=|:(?!//))"
#: Characters before and after a candidate that count as next to it.
NEAR, AFTER = 40, 12
#: Marks a candidate's ends while a text is cut (a noncharacter); where a text holds it, its own digest is put between two.
_MARK = "\ufdd0"
_ALPHABET = "abcdefghijklmnopqrstuvwxyz0"

FEATURES = (
    "n_chars", "transitions", "likelihood", "digits", "hex", "upper", "marks", "distinct", "dictionary",
    "neighbours", "nearest", "assigned", "quoted", "in_path", "test_path", "led", "spaces",
)


class Corpus(NamedTuple):
    """What the corpus's words say: log-likelihoods of letter pairs (row by row over _ALPHABET, 0 for other characters),
    frequent words, and the meaning (log-odds) of neighbouring words. All three are bounded by constants."""

    pairs: list[float]
    words: list[str]
    neighbours: dict[str, float]


def _folded(x: Column) -> Column:
    return F.translate(F.lower(x), "123456789", "0" * 9)


def word_statistics(docs: DataFrame, dictionary: int = DICTIONARY) -> Corpus:
    """Counts over the words of all documents: the frequent ones of four letters or more, and their letter pairs."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    plain = F.translate(F.lower(text), "123456789\t\n\r.,;:!?\"'()[]{}|/", "0" * 9 + " " * 18)
    words = docs.select(F.explode(F.split(plain, " ")).alias("w")).where("length(w) between 2 and 40")
    words = checkpoint(words.groupBy("w").agg(F.count("*").alias("n")).where("w rlike '^[a-z0]+$'"))
    known = words.where("length(w) >= 4 and instr(w, '0') = 0").orderBy(F.desc("n"), "w").limit(dictionary).select("w").collect()
    pair = F.explode(F.transform(F.sequence(F.lit(1), F.length("w") - 1), lambda i: F.substring("w", i, F.lit(2)))).alias("p")
    counts = {r.p: r.n for r in words.select(pair, "n").groupBy("p").agg(F.sum("n").alias("n")).collect()}  # 27^2 at most
    size = len(_ALPHABET)
    table = [0.0] * (size + 1) ** 2
    for i, a in enumerate(_ALPHABET, 1):
        total = sum(counts.get(a + b, 0) for b in _ALPHABET) + size
        for j, b in enumerate(_ALPHABET, 1):
            table[i * (size + 1) + j] = (counts.get(a + b, 0) + 1) / total
    return Corpus([round(math.log(v), 6) if v else 0.0 for v in table], [r.w for r in known], {})


def neighbour_words(left: Column, right: Column) -> Column:
    """The distinct whole words next to a candidate, those on its right marked."""
    own = lambda x: F.filter(F.split(F.lower(x), "[^a-z]+"), lambda w: F.length(w) > 1)
    # a character more than counts: letters that reach it may be part of a longer word
    far = F.when(F.length(left) <= NEAR, left).otherwise(F.regexp_replace(F.right(left, F.lit(NEAR + 1)), "^[A-Za-z]+", ""))
    near = F.when(F.length(right) <= AFTER, right).otherwise(F.regexp_replace(F.left(right, F.lit(AFTER + 1)), "[A-Za-z]+$", ""))
    return F.array_distinct(F.concat(own(far), F.transform(own(near), lambda w: F.concat(F.lit(">"), w))))


def _numbers(x: list) -> Column:
    """A table as a constant array: one literal that Catalyst folds, however long."""
    return F.split(F.lit(" ".join(map(repr, x)) or "0"), " ").cast("array<double>")


def _features(x: Column, left: Column, right: Column, path: Column, corpus: Corpus) -> list[Column]:
    n = F.length(x)
    kinds = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(x, "[^A-Za-z0-9]", "-"), "[0-9]", "0"), "[A-Z]", "A"), "[a-z]", "a")
    near = F.right(left, F.lit(NEAR))
    flag = lambda c: c.cast("double")
    share = lambda pattern: 1 - F.length(F.regexp_replace(x, pattern, "")) / n
    size = len(_ALPHABET) + 1
    codes = F.transform(F.split(_folded(x), ""), lambda c: F.instr(F.lit(_ALPHABET), c))
    pairs, dictionary = _numbers(corpus.pairs), F.split(F.lit(" ".join(corpus.words)), " ")
    both = F.zip_with(F.slice(codes, F.lit(1), n - 1), F.slice(codes, F.lit(2), n - 1), lambda a, b: a * size + b + 1)
    steps = F.aggregate(both, F.lit(0.0), lambda s, i: s + F.element_at(pairs, i))
    parts = F.split(F.lower(F.regexp_replace(x, "([a-z])(?=[A-Z])", "$1 ")), "[^a-z]+")
    known = F.filter(parts, lambda w: (F.length(w) >= 4) & F.array_contains(dictionary, w))
    names, odds = F.split(F.lit(" ".join(corpus.neighbours)), " "), _numbers(list(corpus.neighbours.values()))
    says = lambda w: F.coalesce(F.get(odds, F.array_position(names, w).cast("int") - 1), F.lit(0.0)) if corpus.neighbours else F.lit(0.0)
    words = neighbour_words(left, right)
    before = F.filter(words, lambda w: ~w.startswith(">"))
    return [
        n.cast("double"),
        (F.length(F.regexp_replace(kinds, r"(.)\1+", "$1")) - 1) / n,
        steps / (n - 1),
        share("[0-9]"),
        share("[0-9a-fA-F]"),
        share("[A-Z]"),
        share("[^A-Za-z0-9]"),
        F.size(F.array_distinct(F.split(x, ""))) / n,
        F.aggregate(known, F.lit(0.0), lambda s, w: s + F.length(w)) / n,
        F.aggregate(words, F.lit(0.0), lambda s, w: s + says(w)),
        says(F.get(before, F.size(before) - 1)),
        flag(near.rlike(r"(?:[=:>]|\bis)\s*[\"'`]?$")),
        flag(F.substring(right, 1, 1).rlike("[\"'`]")),
        flag(near.rlike("[/@]$") | x.rlike("/[A-Za-z0-9_.-]*/")),
        flag(F.lower(path).rlike("(test|example|sample|fixture|mock)")),
        flag(near.rlike(_LED + r"[\"'`]?$") | near.rlike(r"://[^\s:/@]*:$") | near.rlike(r"PRIVATE KEY-----\s*$")),
        share(r"\s"),
    ]


def _cut(text: Column) -> Column:
    """The text as an array: what precedes a candidate, the candidate, what follows, and so on; one pass of the pattern."""

    def by(mark: Column) -> Column:
        return F.split(F.regexp_replace(text, F.lit(CANDIDATE), F.concat(F.lit(_BEFORE), mark, F.lit(_VALUE), mark)), mark, -1)

    return F.when(F.instr(text, _MARK) == 0, by(F.lit(_MARK))).otherwise(by(F.concat(F.lit(_MARK), F.md5(text), F.lit(_MARK))))


def _once(c: Column) -> Column:
    """c, in a projection that filters are not pushed through: they would compute it again, lambdas once an element."""
    return F.when(F.monotonically_increasing_id() >= 0, c)


def described(text: Column, path: Column, corpus: Corpus) -> tuple[Column, Column]:
    """(cut text, features of each of its parts, as arrays: null for those between candidates, names and mere punctuation)."""
    parts = _cut(F.coalesce(text.cast("string"), F.lit("")))

    def before(all_, i):
        # what stands before a candidate, as far as NEAR reaches: four parts are two candidates and the text between them
        last = F.slice(all_, F.greatest(F.lit(1), i - 3), F.least(i, F.lit(4)))
        return F.array_join(F.transform(last, lambda x: F.right(x, F.lit(NEAR + 1))), "")

    def features(all_):
        def one(x, i):
            own = _features(x, before(all_, i), F.concat(F.get(all_, i + 1), F.coalesce(F.get(all_, i + 2), F.lit(""))), F.coalesce(path.cast("string"), F.lit("")), corpus)
            name = x.rlike(_NAME) & F.coalesce(F.get(all_, i + 1), F.lit("")).rlike(_NAMES)
            return F.when((i % 2 == 1) & x.rlike("[A-Za-z0-9]") & ~name, F.array(*(c.cast("double") for c in own)))

        return F.transform(all_, one)

    return parts, features


# labelled findings
#: Names of what is secret and of what is not, and how values stand in texts (n: name, N: in capitals).
SECRET_NAMES = ("token", "secret", "password", "passwd", "pwd", "api_key", "apikey", "access_key", "access_token", "auth_token", "client_secret", "private_key", "credential", "secret_access_key", "db_password", "bearer")
OTHER_NAMES = ("commit", "commits", "revision", "sha1", "sha256", "sha256sum", "md5", "checksum", "digest", "etag", "order", "order number", "invoice", "tracking", "serial", "isbn", "phone", "card number", "uuid", "request id", "build", "version", "hash", "id", "url", "path", "file", "image", "ref")
ASSIGNED = ('{n} = "{v}"', "{n}: '{v}'", "{N}={v}", '"{n}": "{v}"', "{n} = {v}", 'export {N}="{v}"', "my_{n}=`{v}`", "{n}: {v}", "SERVICE_{N}: {v}", "--{n} {v}", "{n} is {v}", "Bearer {v}", '{n} => "{v}"', "{n} := '{v}'")
NAMED = ("{n} {v}", "{n}: {v}", "{n}={v}", '{n} = "{v}"', "({n} {v})", "{n} {v}.", "see {v} there", "at {v}", "{n} is {v}", '{n} => "{v}"')
#: Where only passwords stand, and a key between its lines.
LOGIN, PEM = ("https://{n}:{v}@db.example.org/x", "amqp://admin:{v}@queue:5672"), "-----BEGIN RSA PRIVATE KEY-----\n{v}\n-----END RSA PRIVATE KEY-----"


def planted(docs: DataFrame, findings: int = FINDINGS, contexts: int = CONTEXTS, seed: int = SEED, path: str = "source") -> DataFrame:
    """text, path, value, kind, label: about `findings` seeded values between words of at most `contexts` documents."""
    picked = docs.select("doc_id").where("doc_id is not null").distinct().orderBy(F.xxhash64("doc_id", F.lit(seed)), "doc_id").limit(contexts)
    picked = checkpoint(picked)
    n = picked.count()
    where = F.coalesce(F.col(path).cast("string"), F.lit("")) if path in docs.columns else F.lit("")
    rows = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), where.alias("path")).join(F.broadcast(picked), "doc_id")
    rows = rows.groupBy("doc_id").agg(F.max(F.struct("text", "path")).alias("d"))  # `contexts` rows at most
    rows = rows.select("doc_id", F.split("d.text", r"\s+").alias("w"), "d.path", F.explode(F.sequence(F.lit(1), F.lit(max(1, -(-findings // max(1, n)))))).alias("turn"))
    key = F.concat_ws(":", F.lit(str(seed)), F.col("doc_id").cast("string"), F.col("turn").cast("string"))
    draw = lambda what, k: F.pmod(F.xxhash64(key, F.lit(what)), F.lit(k)).cast("int")
    pick = lambda what, options: F.get(F.array(*(F.lit(x) if isinstance(x, str) else x for x in options)), draw(what, len(options)))
    hexes = F.sha2(key, 512)
    b64 = F.regexp_replace(F.base64(F.unhex(F.sha2(F.concat(key, F.lit("b")), 512))), "[=\r\n]", "")
    b62, letters = F.regexp_replace(b64, "[+/]", ""), F.regexp_replace(b64, "[^A-Za-z]", "")
    numbers = F.translate(F.sha2(F.concat(key, F.lit("d")), 512), "abcdef", "135790")
    cut = lambda c, k, at=1: F.substring(c, F.lit(at), k if isinstance(k, Column) else F.lit(k))
    at = draw("at", 1 << 30) % F.greatest(F.lit(1), F.size("w"))
    near = F.filter(F.slice("w", at + 1, 40), lambda x: x.rlike(r"^[^\s\"'`=:$%#&*|!]{2,14}$"))
    name = F.regexp_replace(F.lower(F.array_join(F.slice(near, 1, 3), "_")), "[^a-z_]", "x")
    prose = F.regexp_replace(F.base64(F.encode(F.concat(F.array_join(F.slice("w", at + 1, 12), " "), F.lit(" it is")), "utf-8")), "[=\r\n]", "")
    secret = {
        "hex": cut(hexes, 40), "hex32": cut(hexes, 32), "hexcaps": F.upper(cut(hexes, 40)), "base64": cut(b64, 40), "long": b64, "base62": cut(b62, 24), "short": cut(b62, 12), "letters": cut(letters, 20),
        "anyhex": cut(hexes, F.get(F.array(*map(F.lit, (16, 18, 20, 24, 28, 48, 64))), draw("length", 7))), "password": F.concat(cut(letters, 6), pick("mark", ("-", "_", "+", ".")), cut(numbers, 4)),
        "simple": F.concat(F.lower(cut(letters, F.get(F.array(*map(F.lit, (4, 5, 6, 7, 8))), draw("length", 5)))), cut(numbers, F.get(F.array(*map(F.lit, (1, 2, 3))), draw("tail", 3)))),
        "marked": F.concat(cut(letters, 3), pick("mark", ("@", "#", "$", "%", "&", "*")), cut(letters, F.get(F.array(*map(F.lit, (2, 4, 6))), draw("length", 3)), 4), cut(numbers, 2), pick("end", ("!", "?", "x", "^", "=", "~"))),
        "salted": F.concat(cut(b62, 4), cut(numbers, 2), pick("mark", ("&", "!", "(", "/", ";")), cut(b62, 5, 9), pick("end", ("!", "x", "9"))),
    }
    bare = {
        "cloud": F.concat(F.lit("AKIA"), F.upper(cut(b62, 16))), "host": F.concat(F.lit("ghp_"), cut(b62, 36)), "pay": F.concat(F.lit("sk_live_"), cut(b62, 24)),
        "signed": F.concat(F.lit("eyJ"), cut(b62, 20), F.lit(".eyJ"), cut(b62, 24, 20), F.lit("."), cut(b62, 30, 40)),
        "chat": F.concat(F.lit("xoxb-"), cut(numbers, 11), F.lit("-"), cut(b62, 24)),
    }
    other = {
        "hash": cut(hexes, 40), "sum": hexes.substr(1, 64), "md5": cut(hexes, 32), "number": cut(numbers, 16), "digits": cut(numbers, 20), "grouped": F.concat_ws("-", cut(numbers, 4), cut(numbers, 4, 5), cut(numbers, 4, 9), cut(numbers, 4, 13)),
        "uuid": F.concat_ws("-", cut(hexes, 8), cut(hexes, 4, 9), cut(hexes, 4, 13), cut(hexes, 4, 17), cut(hexes, 12, 21)), "prose": prose,
        "time": F.concat(F.lit("2024-0"), cut(numbers, 1), F.lit("-1"), cut(numbers, 1, 2), F.lit("T10.2"), cut(numbers, 1, 3), F.lit("."), cut(numbers, 6, 4), F.lit("Z")),
        "package": F.concat(name, F.lit("-"), cut(numbers, 1), F.lit("."), cut(numbers, 2, 2), F.lit("."), cut(numbers, 1, 4), F.lit("-x86_64.tar")),
    }
    plain = {
        "path": F.concat(F.lit("/usr/share/"), F.regexp_replace(name, "_", "/"), F.lit("_"), cut(numbers, 2), F.lit("/index")), "dotted": F.concat(F.lit("www."), F.regexp_replace(name, "_", "."), F.lit(".example.org/"), cut(numbers, 3)),
        "identifier": F.concat(name, F.lit("_file_"), cut(numbers, 2)), "camel": F.concat(F.regexp_replace(F.initcap(F.regexp_replace(name, "_", " ")), " ", ""), F.lit("Handler")),
        "word": F.regexp_replace(name, "_", ""), "score": F.concat(name, F.lit("_"), name),
    }
    dummy = {
        "example": F.concat(F.lit("EXAMPLE"), F.upper(F.regexp_replace(name, "_", "")), F.lit("KEY")), "your": F.concat(F.lit("your-"), F.regexp_replace(name, "_", "-"), F.lit("-here")), "crosses": F.lit("x" * 20),
        "change": F.lit("changeme-changeme"), "zeros": F.lit("0" * 24), "words": name, "count": F.lit("1234567890123456"),
        "word": F.lower(F.regexp_replace(F.get(near, F.lit(0)), "[^A-Za-z]", "")), "none": pick("none", ("none", "null", "string", "required", "invalid", "optional", "disabled", "undefined", "<password>", "${SECRET}", "%(password)s", "********")),
    }
    one = lambda kind, label, value, form, names, where: F.struct(F.lit(kind).alias("kind"), F.lit(label).alias("label"), value.alias("value"), form.alias("form"), names.alias("name"), where.alias("path"))
    mine, fixture = F.col("path"), F.concat(F.lit("tests/fixtures/"), F.col("path"))
    named, assigned = pick("n", SECRET_NAMES), pick("f", ASSIGNED)
    options = [one(k, 1, v, assigned, named, mine) for k, v in secret.items()]
    options += [one(k, 1, v, pick("f", (*ASSIGNED, "{v}", "use {v} here")), named, mine) for k, v in bare.items()]
    options += [one(f"login-{k}", 1, secret[k], pick("f", LOGIN), named, mine) for k in ("password", "base62", "simple")]
    options += [one("pem", 1, F.concat_ws("\n", b64, F.reverse(b64)), F.lit(PEM), named, mine)]
    options += [one(k, 0, v, pick("f", NAMED), pick("o", OTHER_NAMES), mine) for k, v in other.items()]
    options += [one(k, 0, v, pick("f", (*NAMED, "{v}", "{v},", '"{v}"')), pick("o", (*OTHER_NAMES, "name", "label", "title")), mine) for k, v in plain.items()]
    options += [one(f"dummy-{k}", 0, v, assigned, named, mine) for k, v in dummy.items()]
    options += [one(f"fixture-{k}", 0, secret[k], assigned, named, fixture) for k in ("hex", "base62")]
    rows = rows.select("w", at.alias("at"), F.get(F.array(*options), draw("kind", len(options))).alias("x"))
    said = F.replace(F.replace(F.replace("x.form", F.lit("{n}"), F.col("x.name")), F.lit("{N}"), F.upper("x.name")), F.lit("{v}"), F.col("x.value"))
    left, right = F.slice("w", F.greatest(F.lit(1), F.col("at") - 6), F.least(F.col("at"), F.lit(7))), F.slice("w", F.col("at") + 1, 7)
    rows = rows.where("length(x.value) >= 4")
    return checkpoint(rows.select(F.concat_ws(" ", F.array_join(left, " "), said, F.array_join(right, " ")).alias("text"), "x.path", "x.value", "x.kind", "x.label"))


def _overlaps(x: Column) -> Column:
    return (F.instr(F.col("value"), x) > 0) | (F.instr(x, F.col("value")) > 0)


def neighbour_meaning(found: DataFrame, most: int = NEIGHBOURS) -> dict[str, float]:
    """Log-odds of the words next to planted values: the `most` strongest of those that stand next to five or more."""
    parts = _cut(F.col("text"))
    i = F.array_position(F.transform("parts", lambda x: _overlaps(x)), True).cast("int") - 1
    rows = found.select("value", "label", parts.alias("parts")).withColumn("i", i).where("i >= 0")
    left = F.array_join(F.slice("parts", F.lit(1), F.col("i")), "")
    words = rows.select("label", F.explode(neighbour_words(left, F.coalesce(F.get("parts", F.col("i") + 1), F.lit("")))).alias("w"))
    counts = words.groupBy("w").agg(F.sum("label").alias("a"), F.count("*").alias("n")).where("n >= 5").orderBy(F.desc("n"), "w").limit(10 * most).collect()
    total = rows.agg(F.sum("label"), F.count("*")).first()
    prior = math.log((total[0] + 1) / (total[1] - total[0] + 1)) if total[1] else 0.0
    odds = {r.w: round(math.log((r.a + 0.5) / (r.n - r.a + 0.5)) - prior, 4) for r in counts}
    return dict(sorted(sorted(odds.items(), key=lambda kv: (-abs(kv[1]), kv[0]))[:most]))


def labelled(found: DataFrame, corpus: Corpus) -> DataFrame:
    """FEATURES, kind and label of the candidates that overlap their row's planted value."""
    parts, features = described(F.col("text"), F.col("path"), corpus)
    rows = found.select("value", "kind", "label", "path", parts.alias("parts"))
    rows = rows.select("value", "kind", "label", F.explode(F.arrays_zip(F.col("parts").alias("x"), features(F.col("parts")).alias("f"))).alias("c"))
    rows = rows.where(F.col("c.f").isNotNull() & _overlaps(F.col("c.x")))
    return rows.select(*(F.get("c.f", F.lit(i)).alias(n) for i, n in enumerate(FEATURES)), "kind", "label")


def spread(findings: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """Training rows (FEATURES..., label) of each class, at most 2 `sample`, that do not hinge on how often a finding is repeated.

    Equal findings are counted first. `sample` distinct ones are drawn with chances that grow with their counts (the
    smallest -ln(u) / n, u from a seeded hash), so frequent ones are in and leave the other places to rare ones. Each
    then gets its share of `sample` rows, one at least.
    """
    rows = findings.select(*FEATURES, F.col("label").cast("double").alias("label")).where("label is not null")
    rows = checkpoint(rows.groupBy("label", *FEATURES).agg(F.count("*").alias("_n")))
    u = (F.pmod(F.xxhash64(*FEATURES, F.lit(SEED)), F.lit(1 << 52)) + 1) / F.lit(float(1 << 52))
    rows = rows.withColumn("_o", -F.log(u) / F.col("_n"))
    total = rows.groupBy("label").agg(F.sum("_n").alias("_all"))  # one row a class
    picked = [rows.where(F.col("label") == k).orderBy("_o", *FEATURES).limit(sample) for k in (0.0, 1.0)]
    times = F.greatest(F.lit(1), F.floor(F.col("_n") * F.least(F.lit(1.0), sample / F.col("_all"))).cast("int"))
    return picked[0].union(picked[1]).join(F.broadcast(total), "label").withColumn("_k", F.explode(F.array_repeat(F.lit(0), times))).select(*FEATURES, "label")


def fit_forest(findings: DataFrame, sample: int = SAMPLE):
    """A forest from (FEATURES..., label) rows, fitted on spread(findings, sample); None if a class is missing."""
    train = checkpoint(spread(findings, sample).coalesce(1).sortWithinPartitions("label", *FEATURES))
    if train.select("label").distinct().count() < 2:
        return None
    train = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(train)
    return RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, seed=SEED, featureSubsetStrategy="onethird").fit(train.select("features", "label"))


def forest_votes(model, f: Column) -> Column:
    """The share of trees that vote 1, as an expression over the array f of FEATURES: the trees are constant arrays of
    nodes (feature or -1 at a leaf, cut or vote, children), walked from their roots."""
    nodes: list[tuple] = []

    def put(t) -> int:
        at = len(nodes)
        nodes.append((-1, t, 0, 0))
        if not isinstance(t, float):
            k, cut, low, high = t
            nodes[at] = (k, cut, put(low), put(high))
        return at

    roots = _numbers([put(_tree(iter(x))) for x in _tree_lines(model.toDebugString)])
    feature, cut, low, high = (_numbers(list(x)) for x in zip(*nodes))
    get = lambda table, i: F.element_at(table, i.cast("int") + 1)

    def step(at, _):
        own = get(feature, at)
        return F.when(own < 0, at).when(get(f, own) <= get(cut, at), get(low, at)).otherwise(get(high, at))

    walk = lambda root: F.aggregate(F.sequence(F.lit(1), F.lit(DEPTH)), root, step)
    return F.aggregate(roots, F.lit(0.0), lambda s, root: s + get(cut, walk(root))) / F.size(roots)


def _tree_lines(debug: str) -> list[list[str]]:
    out: list[list[str]] = []
    for line in debug.splitlines():
        line = line.strip()
        if line.startswith("Tree "):
            out.append([])
        elif out and line:
            out[-1].append(line)
    return out


def _tree(lines):
    line = next(lines)
    if line.startswith("Predict:"):
        return float(line.split(":")[1])
    m = re.match(r"If \(feature (\d+) <= (\S+)\)", line)
    low = _tree(lines)
    next(lines)  # its Else
    return int(m[1]), float(m[2]), low, _tree(lines)


def trained(docs: DataFrame, findings: DataFrame | None = None, path: str = "source", seed: int = SEED):
    """(forest or None, Corpus) for docs; findings: labelled rows of FEATURES, or None for planted ones."""
    corpus = word_statistics(docs)
    if findings is None:
        found = planted(docs, seed=seed, path=path)
        half = F.pmod(F.xxhash64("value", "text"), F.lit(2))
        corpus = corpus._replace(neighbours=neighbour_meaning(found.where(half == 0)))
        findings = labelled(found.where(half == 1), corpus)
    return fit_forest(findings), corpus


def _scanned(text: Column, path: Column, model, corpus: Corpus) -> tuple:
    parts, features = described(text, path, corpus)
    vote = (lambda f: forest_votes(model, f)) if model else (lambda f: F.lit(0.0))
    votes = lambda all_: F.transform(features(all_), lambda f: F.when(f.isNotNull(), F.round(vote(f), 6)))
    return parts, votes


def scan(docs: DataFrame, findings: DataFrame | None = None, threshold: float = 0.5, path: str = "source", model=None) -> DataFrame:
    """Rows of docs with candidates: all columns, `found` and `redacted`.

    found: array of (finding, start, length, votes, is_secret, sha256), start in code points; redacted: the text with
    each secret replaced. findings: labelled rows of FEATURES and label, planted ones by default; if a class has no
    labelled finding nothing counts as a secret. model: what trained() returned, to use it again. Null or empty texts
    and an empty table have no candidates; repeated rows get equal results and equal votes are ties that all count;
    texts are cut whole, at any length, in one row. A column named found or redacted is replaced; all other names of
    docs are free.
    """
    bounded_batches(docs.sparkSession)
    model, corpus = model or trained(docs, findings, path)
    keep = [c for c in docs.columns if c.lower() not in ("found", "redacted")]
    where = F.col("row").getField(path) if path in docs.columns else F.lit("")
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in (keep if "text" in keep else [*keep, "text"]))).alias("row"))
    parts, votes = _scanned(F.col("row").getField("text"), where, model, corpus)
    rows = rows.withColumn("parts", _once(parts)).where(F.size("parts") > 1)
    rows = rows.withColumn("votes", _once(votes(F.col("parts"))))
    size = F.transform("parts", lambda x: F.length(x).cast("long"))
    starts = F.aggregate(size, F.array(F.lit(0).cast("long")), lambda s, x: F.concat(s, F.array(F.element_at(s, -1) + x)))
    # the arrays are zipped, as a lambda that reads a column by index may have it computed for every element
    rows = rows.select("row", F.arrays_zip("parts", "votes", starts.alias("starts")).alias("c"))
    counts = lambda c: c["votes"] >= F.lit(threshold)
    one = F.transform(
        F.filter("c", lambda c: c["votes"].isNotNull()),
        lambda c, i: F.struct(
            i.cast("long").alias("finding"), c["starts"].alias("start"), F.length(c["parts"]).cast("long").alias("length"),
            c["votes"].alias("votes"), counts(c).alias("is_secret"), F.sha2(c["parts"], 256).alias("sha256"),
        ),
    )
    safe = F.filter("c", lambda c: c["parts"].isNotNull())
    safe = F.transform(safe, lambda c: F.when(counts(c), F.lit(REDACTED)).otherwise(c["parts"]))
    rows = rows.select("row", one.alias("found"), F.array_join(safe, "").alias("redacted"))
    return rows.select(*(F.col("row").getField(c).alias(c) for c in keep), "found", "redacted")


def redact(docs: DataFrame, findings: DataFrame | None = None, threshold: float = 0.5, path: str = "source", model=None) -> DataFrame:
    """docs with secrets replaced in text, and n_chars, if there, counted anew where the text changed.

    Every row stays, in its place and with its other columns, whatever their names; a null text stays null. Rows without
    a secret are unchanged. Empty tables, ties, repeated rows and long texts: as in scan().
    """
    bounded_batches(docs.sparkSession)
    model, corpus = model or trained(docs, findings, path)
    where = F.col("row").getField(path) if path in docs.columns else F.lit("")
    rows = docs.select(F.struct("*").alias("row"))
    parts, votes = _scanned(F.col("row").getField("text"), where, model, corpus)
    rows = rows.withColumn("parts", _once(parts))
    rows = rows.withColumn("votes", F.when(F.size("parts") > 1, votes(F.col("parts"))))
    v = F.col("votes")
    changed = F.coalesce(F.exists(v, lambda x: x >= F.lit(threshold)), F.lit(False))
    safe = F.array_join(F.zip_with("parts", v, lambda x, y: F.when(y >= F.lit(threshold), F.lit(REDACTED)).otherwise(x)), "")
    rows = rows.select("row", F.when(changed, safe).alias("new"))
    out = []
    for c in docs.columns:
        own = F.col("row").getField(c)
        new = {"text": F.col("new"), "n_chars": F.length("new").cast("long")}.get(c)
        out.append((own if new is None else F.when(F.col("new").isNotNull(), new).otherwise(own)).alias(c))
    return rows.select(*out)
