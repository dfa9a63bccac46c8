"""Secret scans: candidates by one pattern, judged by a random forest that runs as a Spark expression.

The forest is fitted on the driver from labelled findings, a bounded number made from a seed; scanning uses no Python on
the executors. Every feature is a SQL expression over a candidate and the text around it, and every tree a CASE.
"""

from __future__ import annotations

import random
import re
import string
import uuid
from collections.abc import Callable
from functools import lru_cache

import numpy as np
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Characters around a candidate that count as its neighbours.
NEAR = 48
MASK = "<secret>"
#: Candidates whose lengths are summed up one by one.
BLOCK = 128
#: Labelled findings, trees and their depth: the forest's size does not depend on the corpus.
FINDINGS, TREES, DEPTH, SEED = 6000, 24, 7, 20

# Words by which a name, a neighbour or a path speaks for or against a secret.
DICTIONARY = (
    "about access account admin after again api app auth backup base before build cache cafe change check class client "
    "cloud code commit config content current data database debug default demo dev develop document domain dummy email "
    "en entry error event example export fake feature file final first folder font from group guide handle header hello "
    "home host html http image import index input item job key label latest layout level library light line link list "
    "local login main manual master media memory message method metric mode model module name network news node note "
    "number object offer online open option order origin output package page param part pass password patch path person "
    "photo place placeholder plan play point policy port post prefix press preview price print process product profile "
    "program project public query queue random read record ref release remote render report request resource response "
    "result review right root route sample save scale schema scope script search secret section select server service "
    "session setting share simple site size snapshot sort source stage start state static status step stop storage store "
    "stream string style summary support switch system table tag target task team template test text theme thread time "
    "title token tool topic track type unit update upload url user util value vector version video view volume watch "
    "week window word work world write year your zone"
).split()
FOR = (
    r"(?:pass(?:wd|word|phrase)?|pwd|secret|token|api[ _-]?key|access[ _-]?key|private[ _-]?key|credentials?|"
    r"auth(?:orization)?|bearer)"
)
AGAINST = (
    r"(?:commit|rev(?:ision)?|sha-?[0-9]*|md5|crc|checksum|digest|hash|uuid|guid|build|version|isbn|order|invoice|ticket|"
    r"phone|tel|fax|card|iban|account|number|no|id|image|file|path|page|href|src|url)"
)
PREFIX = (
    r"^(?:A[KS]IA[A-Z0-9]{16}$|gh[pousr]_|github_pat_|glpat-|[sr]k[-_](?:live|test|ant|proj)|xox[abprs]-|AIza|eyJ|npm_|"
    r"hf_|pypi-)"
)
PATHS = r"(?i)(?:^|[/._-])(?:tests?|examples?|samples?|fixtures?|mocks?|docs?|demos?)(?:$|[/._-])"
QUOTE = r"[\x22\x27\x60]"

def _candidate() -> str:
    """All that could be a secret. What starts where is bounded by looking back, which keeps the scan linear.

    A private key from its first line on; what a secret's name is set to; the password in a URL; runs of twelve or more of
    [A-Za-z0-9+/_-] with a digit; and key ids that happen to have none.
    """
    word = r"(?:[A-Z0-9]{1,12} ){0,4}PRIVATE KEY-----"
    set_to = rf"(?<=[=:]|[=:][ \t]|[=:]{QUOTE}|[=:][ \t]{QUOTE})(?<=(?i:{FOR}){QUOTE}?[ \t]{{0,2}}[=:][ \t]?{QUOTE}?)"
    return "|".join(
        [
            rf"-----BEGIN {word}[A-Za-z0-9+/=\x20\x09-\x0D]*+(?:-----END {word})?",
            rf"{set_to}(?![=:\x00-\x20\x22\x27\x60]|https?://)[^\x00-\x20\x22\x27\x60<>]{{6,}}(?<![.,;:)\]}}])",
            r"(?<=:)(?<=://[^\x00-\x20/:@\x22\x27\x60<>]{0,40}:)[^\x00-\x20/@\x22\x27\x60<>]{3,}(?=@)",
            r"(?<![A-Za-z0-9+/_-])(?:(?=[A-Za-z+/_-]*[0-9])[A-Za-z0-9+/_-]{12,}+={0,2}|A[KS]IA[A-Z]{16}(?![A-Za-z0-9+/_-]))",
        ]
    )


CANDIDATE = _candidate()
_find = regex.compile(CANDIDATE).finditer
_WORDS = "|".join(sorted((w for w in DICTIONARY if len(w) > 2), key=lambda w: (-len(w), w)))


def _share(pattern: str):
    """Matches a letter, in SQL and in Python."""
    return f"regexp_count(x.c, r'{pattern}') / length(x.c)", lambda c, **_: len(re.findall(pattern, c, re.A)) / len(c)


def _has(of: str, pattern: str):
    """Whether a pattern is found, in SQL and in Python; a dollar is the very end in both."""
    java, python = pattern.replace("$", r"\z"), re.compile(pattern.replace("$", r"\Z"), re.A)
    return f"cast(x.{of} rlike r'{java}' as double)", lambda **near: float(bool(python.search(near[of])))


#: By name, the SQL over x, a struct of c, the candidate, l and r, the text before and after, and p, the path; and the
#: same in Python, for the labelled findings.
FEATURES = {
    "length": ("cast(length(x.c) as double)", lambda c, **_: float(len(c))),
    "digits": _share("[0-9]"),
    "capitals": _share("[A-Z]"),
    "small": _share("[a-z]"),
    "hex": _share("[0-9a-f]"),
    "marks": _share("[+/_-]"),
    "to_digit": _share("[A-Za-z](?=[0-9])"),
    "to_letter": _share("[0-9](?=[A-Za-z])"),
    "case_changes": _share("[a-z](?=[A-Z])"),
    "same_again": _share(r"(.)(?=\1)"),
    "vowels_in_turn": _share("[b-df-hj-np-tv-z][aeiou]"),
    "distinct": ("size(array_distinct(regexp_extract_all(x.c, '(?s).', 0))) / length(x.c)", lambda c, **_: len(set(c)) / len(c)),
    "dictionary": (
        f"(length(x.c) - length(regexp_replace(lower(x.c), r'{_WORDS}', ''))) / length(x.c)",
        lambda c, **_: (len(c) - len(re.sub(_WORDS, "", c.lower()))) / len(c),
    ),
    "other_marks": _share("[^A-Za-z0-9+/_-]"),
    "private_key": _has("c", "^-----BEGIN "),
    "in_url": _has("l", r"://[^/:@]{0,40}:$"),
    "expression": _has("c", r"[(){}\[\]\x24]|^(?:os|process|env|self|config|settings)\."),
    "one_word": _has("c", r"^[a-z]+$|^[A-Z][a-z]+$|^[A-Z]{1,15}$"),
    "placeholder": _has("c", r"(?i)example|sample|dummy|fake|your|x{4}|0{6}|123456|abcdef|placeholder|changeme|^pass(?:word|wd)?$|^secret$"),
    "prefix": _has("c", PREFIX),
    "assigned": _has("l", rf"[=:][ \t]*{QUOTE}?$"),
    "named": _has("l", rf"(?i)(?:^|[^A-Za-z0-9]){FOR}[ \t]*{QUOTE}?[ \t]*(?:[=:]|is|)[ \t]*{QUOTE}?$"),
    "other_named": _has("l", rf"(?i)(?:^|[^A-Za-z0-9]){AGAINST}[ \t]*{QUOTE}?[ \t]*[=:#/]?[ \t]*{QUOTE}?$"),
    "quoted": _has("r", f"^{QUOTE}"),
    "in_path": _has("l", r"[/.?&]$"),
    "goes_on": _has("r", r"^[/.?&@%:][A-Za-z0-9]"),
    "test_path": _has("p", PATHS),
}


def findings(n: int = FINDINGS, seed: int = SEED) -> list[tuple[str, str, str, str, int]]:
    """(candidate, text before, text after, path, label) of ``n`` labelled findings, made from the seed.

    Some of them are no candidates of the pattern: those are left out of the fit, and are misses where recall is measured.
    """
    r = random.Random(seed)
    run = lambda letters, k: "".join(r.choice(letters) for _ in range(k))
    hexa, alnum, b64 = "0123456789abcdef", string.ascii_letters + string.digits, string.ascii_letters + string.digits + "+/"
    vowel, consonant = "aeiou", "bcdfghjklmnprstvw"
    word = lambda: r.choice([r.choice(DICTIONARY), "".join(r.choice(consonant) + r.choice(vowel) for _ in range(r.randint(2, 4)))])
    prose = lambda: " ".join(word() for _ in range(r.randint(0, 6)))
    after = lambda: r.choice([" ", "\n", ". ", ", ", "; "]) + prose() if r.random() < 0.9 else ""
    plain = lambda: (prose() + r.choice([" ", "\n", ", ", ". ", " the ", " was "]), after())

    def named(names: list[str]) -> tuple[str, str]:
        q = r.choice(["", "", '"', "'"])
        return f"{prose()} {r.choice(names)}{r.choice(['=', ' = ', ': ', ':', ' '])}{q}", q + after()

    def mixed(k: int) -> str:
        kinds = [string.ascii_lowercase, string.ascii_uppercase, string.digits, "!#$%^&*?-_+=~"]
        c = [r.choice(x) for x in kinds] + [r.choice("".join(kinds)) for _ in range(k - 4)]
        r.shuffle(c)
        return r.choice(alnum) + "".join(c[1:-1]) + r.choice(alnum)

    def in_url() -> tuple[str, str]:
        scheme = r.choice(["postgres", "mysql", "https", "redis", "amqp", "ftp", "mongodb+srv"])
        return f"{prose()} {scheme}://{r.choice(['', word()])}:", f"@{word()}.{word()}/{word()} {prose()}"

    secret_names = ["password", "passwd", "pwd", "secret", "token", "api_key", "API_KEY", "apikey", "access_key", "auth", "client_secret", "DB_PASSWORD", "auth_token", "credentials", "bearer", "Authorization"]
    other_names = ["commit", "sha", "sha256", "md5", "checksum", "digest", "hash", "uuid", "build", "revision", "id", "order", "invoice", "phone", "card", "account", "isbn", "number", "ticket", "etag", "file", "version"]
    paths = ["src/app", "web", "src0", "crawl", "", "lib/net", "news", "forum"]
    out = []
    for i in range(n):
        path = r.choice(paths) if r.random() < 0.85 else r.choice(["tests/unit", "docs/guide", "examples", "test_data/mock"])
        if i % 2:
            kind = r.randrange(11)
            if kind == 0:
                c, around = r.choice(["AKIA", "ASIA"]) + run(string.ascii_uppercase + r.choice([string.digits] * 5 + [""]), 16), r.choice([plain, lambda: named(secret_names)])()
            elif kind == 1:
                head, k = r.choice([("ghp_", 36), ("gho_", 36), ("glpat-", 20), ("sk_live_", 24), ("sk-proj", 40), ("xoxb-", 32), ("AIza", 35), ("npm_", 36), ("hf_", 34), ("eyJ", 60)])
                c, around = head + run(alnum, k), r.choice([plain, lambda: named(secret_names)])()
            elif kind in (2, 3):
                c, around = run(hexa, r.choice([12, 16, 18, 20, 24, 32, 40, 48, 64])), named(secret_names)
            elif kind == 4:
                c, around = run(alnum, r.randint(12, 48)), named(secret_names)
            elif kind == 5:
                c, around = run(b64, r.randint(20, 64)), named(secret_names)
            elif kind == 6:
                c, around = mixed(r.randint(8, 20)), named(secret_names)
            elif kind == 7:
                c, around = r.choice([mixed(r.randint(8, 16)), run(alnum, r.randint(8, 20))]), in_url()
            elif kind == 8:
                kept = r.choice(["RSA ", "EC ", "", "OPENSSH ", "ENCRYPTED "]) + "PRIVATE KEY-----"
                lines = "\n".join(run(b64, 64) for _ in range(r.randint(2, 12)))
                c, around = f"-----BEGIN {kept}\n{lines}\n" + r.choice([f"-----END {kept}", ""]), (prose() + "\n", "")
                c = c.rstrip() if c.endswith("\n") else c
            elif kind == 9:
                c, around = "".join(r.choice(string.ascii_letters) for _ in range(r.randint(12, 32))), named(secret_names)
            else:
                c, around = r.choice([word() + run(string.digits, r.randint(1, 4)) + word(), word().capitalize() + run("!@#$%&*?", r.randint(1, 2)) + run(string.digits, r.randint(2, 4))]), named(secret_names[:4])
        else:
            kind, around = r.randrange(13), plain()
            if kind == 0:
                c, around = run(hexa, r.choice([12, 32, 40, 40, 64])), named(other_names)
            elif kind == 1:
                c = str(uuid.UUID(int=r.getrandbits(128)))
                around = r.choice([plain, lambda: named(other_names)])()
            elif kind == 2:
                c, around = run(string.digits, r.randint(12, 20)), r.choice([plain, lambda: named(other_names)])()
            elif kind == 3:
                c = r.choice([f"{run(string.digits, 3)}-{run(string.digits, 3)}-{run(string.digits, 4)}", f"20{run('012', 2)}-{run('01', 2)}-{run('012', 2)}T{run('01', 2)}", f"+{run(string.digits, 12)}", f"{run(string.digits, 4)}-" * 3 + run(string.digits, 4)])
            elif kind == 4:
                c, around = r.choice(["-", "_", "/"]).join([word() for _ in range(r.randint(2, 6))] + [run(string.digits, r.randint(1, 6))]), (prose() + r.choice([" ", "/", "http://", "=", "."]), r.choice(["/", ".html", " ", "?", "."]) + prose())
            elif kind == 5:
                c, around = word() + run(string.digits, r.randint(1, 4)) + word() + word(), plain()
            elif kind == 6:
                c, around = r.choice(["your-api-key-", "example_token_", "xxxxxxxxxxxx", "placeholder-", "dummy-secret-", "sample_password_", "0000000000", "123456789012"]) + run(string.digits, r.randint(1, 4)), named(secret_names)
            elif kind == 7:
                c, around = "".join(word().capitalize() for _ in range(3)) + run(string.digits, r.randint(1, 3)), r.choice([plain, lambda: named(["name", "class", "user", "title", "key"])])()
            elif kind == 8:
                c, around = run(hexa, r.choice([16, 20, 32, 40])), (prose() + r.choice(["/", "?id=", "/commit/", "&v=", "img/", "."]), r.choice([".png", "/", ".html", "&x=1", ".js", " "]) + prose())
            elif kind == 9:
                c, around = r.choice(["-", "", "_"]).join(word() for _ in range(3)) + run(string.digits, 2), named([*secret_names, "name"])
            elif kind == 10:
                c, around = r.choice([word(), word().capitalize(), word().upper(), "required", "string", "undefined", "boolean", "optional"]), named(secret_names)
            elif kind == 11:
                c, around = r.choice([f"{word()}.{word()}('{word().upper()}')", f"${{{word().upper()}}}", f"os.environ['{word().upper()}']", f"process.env.{word().upper()}", f"{word()}({word()})", f"{word()}[{run(string.digits, 1)}]", f"/{word()}/{word()}"]), named(secret_names)
                c = c.split("'")[0]
                c, ends = re.fullmatch(r"(.*?)([.,;:)\]}]*)", c).groups()
                around = around[0], ends + around[1]
            else:
                c, around = r.choice(["password", "passwd", "secret", "changeme", "xxxxxxxx", "user", "pass", "your-password"]), in_url()
        out.append((c, around[0][-NEAR:], around[1][:NEAR], path, i % 2))
    return out


def is_candidate(c: str, l: str, r: str) -> bool:  # noqa: E741
    """Whether the pattern finds just that in a text."""
    return any(m.span() == (len(l), len(l) + len(c)) for m in _find(l + c + r))


class Tree:
    """A classification tree by Gini impurity; ``split`` has (feature, threshold, left, right) or a leaf's share."""

    def __init__(self, x: np.ndarray, y: np.ndarray, depth: int, rng: np.random.Generator):
        self.split = self._grow(x, y, depth, rng)

    def _grow(self, x: np.ndarray, y: np.ndarray, depth: int, rng: np.random.Generator):
        share = float((y.sum() + 0.5) / (len(y) + 1))
        if not depth or len(y) < 8 or y.min() == y.max():
            return share
        best = None
        for f in rng.choice(x.shape[1], max(2, round(x.shape[1] ** 0.5) + 1), replace=False):
            values = np.unique(x[:, f])
            if len(values) < 2:
                continue
            cuts = (values[1:] + values[:-1]) / 2
            for cut in cuts[:: max(1, len(cuts) // 24)]:
                left = x[:, f] <= cut
                n = left.sum()
                if n < 3 or len(y) - n < 3:
                    continue
                a, b = y[left].mean(), y[~left].mean()
                impurity = n * a * (1 - a) + (len(y) - n) * b * (1 - b)
                if best is None or impurity < best[0] - 1e-12:
                    best = impurity, int(f), float(cut), left
        if best is None:
            return share
        _, f, cut, left = best
        return f, cut, self._grow(x[left], y[left], depth - 1, rng), self._grow(x[~left], y[~left], depth - 1, rng)

    def share(self, row: np.ndarray) -> float:
        at = self.split
        while isinstance(at, tuple):
            at = at[2] if row[at[0]] <= at[1] else at[3]
        return at

    def sql(self, names: list[str]) -> str:
        def text(at) -> str:
            if not isinstance(at, tuple):
                return f"{at!r}D"
            return f"CASE WHEN {names[at[0]]} <= {at[1]!r}D THEN {text(at[2])} ELSE {text(at[3])} END"

        return text(self.split)


def features_of(c: str, l: str, r: str, p: str) -> np.ndarray:  # noqa: E741
    return np.array([f(c=c, l=l, r=r, p=p) for _, f in FEATURES.values()])


@lru_cache(maxsize=4)
def forest(n: int = FINDINGS, trees: int = TREES, depth: int = DEPTH, seed: int = SEED) -> tuple[Tree, ...]:
    """Trees on bootstrap samples of the labelled findings, each split from a random few of the features."""
    found = [f for f in findings(n, seed) if is_candidate(*f[:3])]
    x, y = np.array([features_of(*f[:4]) for f in found]), np.array([f[4] for f in found], float)
    rng = np.random.default_rng(seed)
    picks = [rng.integers(0, len(y), len(y)) for _ in range(trees)]
    return tuple(Tree(x[i], y[i], depth, rng) for i in picks)


def score_of(c: str, l: str, r: str, p: str) -> float:  # noqa: E741
    """The forest's verdict in Python, as the SQL expression has it."""
    row = features_of(c, l, r, p)
    return sum(t.share(row) for t in forest()) / TREES


def scan(text: str, path: str | None) -> list[tuple[int, int, str, float]]:
    """(start, end, candidate, score) of a text in Python, as the SQL expressions have it."""
    found, pieces, last = list(_find(text)), [], 0
    for m in found:
        pieces.append(text[last : m.start()])
        last = m.end()
    pieces.append(text[last:])
    near = [(pieces[i][-NEAR:], pieces[i + 1][:NEAR]) for i in range(len(found))]
    return [(*m.span(), m[0], score_of(m[0], *near[i], path or "")) for i, m in enumerate(found)]


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body has it."""
    return F.get(F.transform(F.array(value), body), 0)


def _running(values: Column) -> Column:
    """Running sums of an array of one or more, by blocks: work for a value is bounded by BLOCK, and that for blocks small."""
    total = lambda x: F.aggregate(x, F.lit(0), lambda a, b: a + b)

    def within(v: Column, sums: Column) -> Column:
        def one(b: Column) -> Column:
            before = total(F.slice(sums, F.lit(1), b))
            inside = lambda block: F.transform(
                F.sequence(F.lit(1), F.size(block)), lambda k: F.aggregate(F.slice(block, F.lit(1), k), F.lit(0), lambda x, y: x + y)
            )
            here = _let(F.slice(v, b * BLOCK + 1, F.lit(BLOCK)), inside)
            return _let(before, lambda past: F.transform(here, lambda x: x + past))

        return F.flatten(F.transform(F.sequence(F.lit(0), F.size(sums) - 1), one))

    def blocks(v: Column) -> Column:
        last = F.floor((F.size(v) - 1) / BLOCK).cast("int")
        return F.transform(F.sequence(F.lit(0), last), lambda b: total(F.slice(v, b * BLOCK + 1, F.lit(BLOCK))))

    return _let(values, lambda v: _let(blocks(v), lambda sums: within(v, sums)))


def _scanned(docs: DataFrame, text_col: str, path_col: str) -> DataFrame:
    """(row, findings, pieces): a struct of the columns of ``docs``, all candidates, and the text between them."""
    text = F.col(f"row.{text_col}")
    rows = docs.select(F.struct("*").alias("row"))
    hit = text.rlike(CANDIDATE)
    rows = rows.withColumn("found", F.when(hit, F.regexp_extract_all(text, F.lit(CANDIDATE), F.lit(0))))
    rows = rows.withColumn("pieces", F.when(F.col("found").isNotNull(), F.split(text, CANDIDATE, -1)))
    path = F.coalesce(F.col(f"row.{path_col}").cast("string"), F.lit(""))
    none = F.array().cast("array<struct<start:int,end:int,c:string,l:string,r:string,p:string>>")

    def placed(s: Column) -> Column:
        found, pieces = s["found"], s["pieces"]
        lengths = F.zip_with(found, F.slice(pieces, F.lit(1), F.size(found)), lambda c, p: F.length(p) + F.length(c))

        def at(ends: Column) -> Column:
            return F.transform(
                found,
                lambda c, i: F.struct(
                    (F.get(ends, i) - F.length(c)).alias("start"), F.get(ends, i).alias("end"), c.alias("c"),
                    F.right(F.get(pieces, i), F.lit(NEAR)).alias("l"), F.left(F.get(pieces, i + 1), F.lit(NEAR)).alias("r"),
                    s["p"].alias("p"),
                ),
            )

        return _let(_running(lengths), at)

    near = F.when(F.size("found") > 0, _let(F.struct("found", "pieces", path.alias("p")), placed))
    rows = rows.withColumn("near", F.coalesce(near, none))
    fields = ", ".join(f"'{n}', {sql}" for n, (sql, _) in FEATURES.items())
    trees = " + ".join(t.sql([f"y.f.{n}" for n in FEATURES]) for t in forest())
    scored = (
        f"transform(transform(near, x -> named_struct('x', x, 'f', named_struct({fields}))), y -> named_struct("
        f"'start', y.x.start, 'end', y.x.end, 'candidate', y.x.c, 'score', ({trees}) / {TREES}D))"
    )
    return rows.select("row", F.expr(scored).alias("findings"), "pieces")


def with_findings(docs: DataFrame, text_col: str = "text", path_col: str = "source") -> DataFrame:
    """(row, findings): a struct of the columns of ``docs``, and an array of (start, end, candidate, score).

    All candidates of the whole text are given, the unlikely ones too, with the forest's probability that they are
    secrets; offsets are in characters. The array is empty for null and empty texts and those without a candidate, which
    cost one pass of the pattern; a text with many takes time in proportion to them. A null path counts as empty. Every row
    comes back, null ids and repeated rows too, with columns of any name; an empty table gives an empty result.
    """
    return _scanned(docs, text_col, path_col).select("row", "findings")


def redact(docs: DataFrame, text_col: str = "text", path_col: str = "source", threshold: float = 0.5) -> DataFrame:
    """``docs`` with every secret in the text replaced by MASK: those of a score of ``threshold`` or more.

    Null texts stay null, and all rows and columns stay, whatever their names.
    """
    text = F.col(f"row.{text_col}")
    rows = _scanned(docs, text_col, path_col)
    shown = F.transform("findings", lambda f: F.when(f["score"] >= threshold, MASK).otherwise(f["candidate"]))
    parts = F.zip_with(F.slice("pieces", F.lit(1), F.size("findings")), shown, lambda p, c: F.concat(p, c))
    clean = F.when(F.size("findings") > 0, F.concat(F.array_join(parts, ""), F.element_at("pieces", -1))).otherwise(text)
    return rows.select(*((clean if c == text_col else F.col("row").getField(c)).alias(c) for c in docs.columns))
