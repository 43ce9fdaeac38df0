"""Secret scans: candidates by their form, false ones removed by a random forest.

A candidate is a run of 16 or more letters, digits and signs of encodings, a
signed token or key with points, a block of a private key, the password in a
URL, or, after a word of secrets and an assignment, a value of 6 or more
non-space signs. Shorter values, those without such a word and assignment before them on the
line, and what follows a space or quote in a value are not seen. Its features are
its length, its characters and their transitions, how much of it words cover,
whether it stands in a path, and the words near it. The forest is fitted on
labelled findings, on the driver, and applied as expressions over arrays: the
scan is a projection of DataFrame functions and shuffles nothing.
"""

from __future__ import annotations

import random
import string
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RUN = r"[A-Za-z0-9+/_\-]{16,}+={0,2}+"
NEAR = 48
THRESHOLD = 0.5
#: Findings that a forest is fitted on, at most: those with the least hashes.
MOST_FINDINGS = 50_000
REPLACEMENT = "[SECRET]"

# Pieces of common words and identifiers, common pairs of letters, and words near secrets and near other long runs.
WORDS = ("about account action admin after again also and application array attribute base before being block body build button cache change check class client code color common component config content context control count create current data date default delete description document "
         "edit element email entry error event example export false field file filter first format from function global group handler have header height hello image import index info input insert instance integer item label language layer length level line link list load local login make manager "
         "menu message method model module name network node number object option order other output package page panel parent password path pattern point position post private product project property public query read record report request resource response result return sample save schema search section "
         "select server service session setting shape show simple size sort source start state status string style submit system table target template test text that the their theme this time title tool type update upload user utils value version view which window with word your tion ing ment heit keit lich sch ung ción mente eaux elle").split()  # fmt: skip
PAIRS = "th he in er an re on at en nd ti es or te of ed is it al ar st to nt ng se ha as ou io le ve co me de hi ri ro ic ne ea ra ce li ch ll be ma si om ur ie ei un ge qu ai eu oi".split()
SECRET_WORDS = "token|secret|passw|pwd|api|key|auth|bearer|credential|private|access|login|signature"
OTHER_WORDS = "commit|sha1|sha256|sha|md5|hash|checksum|digest|revision|rev|uuid|guid|etag|integrity|example|sample|placeholder|dummy|your|image|base64|fingerprint|build|version|trace"
PREFIXES = "AKIA|ASIA|ghp_|gho_|github_pat_|sk_live_|rk_live_|sk-|xox[abp]-|AIza|eyJ|glpat-|npm_|SG\\.|-----BEGIN"
#: Candidates with signs that runs do not have: tokens of three parts, keys of two, blocks of private keys, and passwords in URLs.
WHOLE = r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]*|SG\.[A-Za-z0-9_-]{16,}\.[A-Za-z0-9_-]{16,}|-----BEGIN [A-Z ]{0,24}PRIVATE KEY-----[^-]{16,}+-----END [A-Z ]{0,24}PRIVATE KEY-----|(?<=:)(?<=://[^\s/:@\x22\x27]{1,64}:)[^\s/@:\x22\x27]{6,64}(?=@)"
#: After a word near secrets, what may end its name, and an assignment; the first test is quick.
ASSIGNED = rf"(?<=[:=\s\x22\x27`])(?<=[:=][\s&&[^\r\n]]{{0,2}}[\x22\x27`]?)(?<=(?i:{SECRET_WORDS})[A-Za-z0-9_-]{{0,16}}[\x22\x27`\]]{{0,2}}[\s&&[^\r\n]]{{0,2}}[:=]{{1,2}}[\s&&[^\r\n]]{{0,2}}[\x22\x27`]?)"
#: A value of any signs but spaces and quotes; what closes a sentence or bracket after it stays.
VALUE = r"[^\s\x22\x27`=:][^\s\x22\x27`]{4,}[^\s\x22\x27`.,;:)\]}>]"
#: One of WHOLE, a run that ends where a value can end, a value, or any run.
CANDIDATE = rf"{WHOLE}|{RUN}(?=[\s\x22\x27`,;&)\]}}<>]|\.[a-z]{{2,4}}\b|\.?(?:\s|$))|{ASSIGNED}{VALUE}|{RUN}"

FEATURES = ("length", "transitions", "common_pairs", "coverage", "in_path", "slashes", "secret_word", "other_word", "assigned", "quoted", "digit_share", "upper_share", "hex", "letters_only", "digits_only", "distinct_share", "known_prefix", "uuid", "repeats", "separators", "signs", "code")


def feature_sql(c: str, left: str, right: str) -> str:
    """An array of FEATURES of the candidate c between left and right."""
    n = f"length({c})"
    count = lambda p: f"regexp_count({c}, r'{p}')"
    flag = lambda p, of=c: f"if({of} rlike r'{p}', 1, 0)"
    parts = [
        n,
        f"{count('(?<=[a-z])(?=[A-Z0-9+/_=-])|(?<=[A-Z])(?=[0-9+/_=-])|(?<=[0-9])(?=[A-Za-z+/_=-])|(?<=[+/_=-])(?=[A-Za-z0-9])')} / {n}",
        f"{count('(?i)(?=' + '|'.join(PAIRS) + ')')} / {n}",
        f"1 - length(regexp_replace({c}, r'(?i){'|'.join(sorted(WORDS, key=len, reverse=True))}', '')) / {n}",
        f"if({left} rlike r'[/.\\\\]$' or {right} rlike r'^[/\\\\]' or {right} rlike r'^\\.[a-z]{{2,4}}\\b' or {left} rlike r'(https?:|www\\.)\\S*$', 1, 0)",
        f"{count('/')} / {n}",
        flag(f"(?i)({SECRET_WORDS})[^\\n]{{0,16}}$", left),
        flag(f"(?i)({OTHER_WORDS})[^\\n]{{0,12}}$", left),
        flag("[:=]\\s*[\\x22\\x27`]?$", left),
        f"if({left} rlike r'[\\x22\\x27`]$' and {right} rlike r'^[\\x22\\x27`]', 1, 0)",
        f"{count('[0-9]')} / {n}",
        f"{count('[A-Z]')} / {n}",
        flag("^([0-9a-f]+|[0-9A-F]+)$"),
        flag("^[A-Za-z]+$"),
        flag("^[0-9_-]+$"),
        f"size(array_distinct(split({c}, ''))) / {n}",
        flag(f"^({PREFIXES})"),
        flag("^[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$"),
        f"{count(r'(.)\\1\\1')} / {n}",
        f"{count('[_-]')} / {n}",
        f"{count('[^A-Za-z0-9]')} / {n}",
        flag(r"[({<\[*]|^\$|^[A-Za-z_]+[.][A-Za-z_.]+$|://"),
    ]
    return f"array({', '.join(f'cast({p} as double)' for p in parts)})"


def default_findings(n: int = 4000, seed: int = 7) -> list[tuple[str, str, str, int]]:
    """Labelled findings (left, candidate, right, label), made by rule: secrets of
    common forms where secrets stand, and hashes, identifiers, paths, numbers,
    placeholders and long words where those stand."""
    r = random.Random(seed)
    run = lambda chars, k: "".join(r.choices(chars, k=k))
    hexes, b64, alnum = "0123456789abcdef", string.ascii_letters + string.digits + "+/", string.ascii_letters + string.digits
    word = lambda: r.choice(WORDS)
    noise = lambda: " ".join(run(string.ascii_lowercase, r.randint(2, 8)) for _ in range(r.randint(0, 5))) + r.choice([" ", "\n", ". "])
    def password() -> str:
        """Of at least three of small letters, capitals, digits and signs."""
        while True:
            p = run(r.choice([alnum, alnum, alnum + "!#$%&*+-.@?^_~"]), r.randint(8, 20))
            if sum(any(map(t, p)) for t in (str.islower, str.isupper, str.isdigit, lambda x: not x.isalnum())) >= 3 and p[0] not in "=:" and p[-1] not in ".":
                return p

    def worded() -> str:
        """A word with digits, signs and letters after it."""
        return r.choice([str, str.capitalize])(word()) + run("0123456789", r.randint(1, 4)) + r.choice(["!", "#", "$", "%", "&", "*", "@", "_", ""]) + run(string.ascii_letters, r.randint(2, 5)) + r.choice(["", "!", "9"])

    def whole() -> tuple[str, str, str]:
        """One of WHOLE, with what stands around it."""
        url = alnum.replace("+", "") + "_-"
        kind = r.randrange(5)
        if kind == 0:
            return noise() + r.choice(["", "token: ", "Bearer ", "jwt=", '"']), "eyJ" + run(url, r.randint(15, 40)) + ".eyJ" + run(url, r.randint(20, 90)) + "." + run(url, r.randint(20, 60)), r.choice(["", '"', " ", "\n"]) + noise()
        if kind == 1:
            return noise() + r.choice(["", "key: ", "API_KEY=", '"']), "SG." + run(url, 22) + "." + run(url, 43), r.choice(["", '"', " "]) + noise()
        if kind == 2:
            name = r.choice(["RSA ", "EC ", "", "OPENSSH "])
            return noise(), f"-----BEGIN {name}PRIVATE KEY-----\n" + "\n".join(run(b64, 64) for _ in range(r.randint(1, 12))) + f"\n-----END {name}PRIVATE KEY-----", "\n" + noise()
        p = r.choice([password, worded, lambda: run(alnum, r.randint(6, 20))])().replace("@", "x").replace(":", "y")
        return noise() + r.choice(["postgres", "mysql", "https", "amqp", "redis", "ftp"]) + "://" + r.choice([word(), word() + run("0123456789", 2)]) + ":", p, "@" + r.choice(["localhost", "10.0.0.2", word() + ".example.com"]) + r.choice([":5432/", "/", ""]) + word() + " " + noise()

    def long_name() -> str:
        name = "_".join([*r.choices(WORDS, k=r.randint(1, 2)), r.choice("secret_token access_key secret_access_key api_key auth_token private_key client_secret database_password".split())])
        return r.choice([str, str.upper])(name.rjust(16, "x"))

    syllables = "th he in er an re on at en nd ti es or st to nt ou tion ing ble ed ha ly wh ment heit lich ung el le eau ado que".split()
    out = []
    for i in range(n):
        if i % 2:
            c = r.choice([lambda: run(hexes, r.choice([32, 40, 40, 48, 64])), lambda: run(hexes.upper(), r.choice([32, 40, 64])), lambda: run(b64, r.randint(20, 86)) + r.choice(["", "=", "=="]), lambda: run(alnum, r.randint(20, 64)), lambda: "AKIA" + run(string.ascii_uppercase + string.digits, 16), lambda: "ghp_" + run(alnum, 36), lambda: "sk_live_" + run(alnum, 24), lambda: "eyJ" + run(b64.replace("+/", "-_"), r.randint(30, 120)), lambda: run(alnum + "_-", r.randint(24, 44))])()
            name = r.choice(["token", "api_key", "apikey", "secret", "password", "passwd", "auth_token", "access_key", "private key", "client_secret", "API-KEY", "Secret", "credential", "TOKEN", "access_token"])
            left = noise() + name + r.choice([' = "', '="', ": ", "=", ' : "', " = '", '": "', " is ", " "])
            if r.random() < 0.25:  # names that are candidates themselves
                left = noise() + long_name() + r.choice(["=", "=", '="', " = ", ": "])
            elif r.random() < 0.15:
                left = noise() + r.choice(["Authorization: Bearer ", "login ", "auth "])
            if r.random() < 0.15:
                left, c, right = whole()
                out.append((left[-NEAR:], c, right[:NEAR], 1))
                continue
            if r.random() < 0.1:  # keys with several slashes
                c = "/".join(run(alnum, r.randint(4, 18)) for _ in range(r.randint(3, 4)))
            if r.random() < 0.3:  # short values, after an assignment
                c = r.choice([password, password, worded])()
                left = noise() + r.choice([name, long_name()]) + r.choice([' = "', '="', ": ", "=", ' : "', " = '", '": "'])
                right = '"' + noise() if left.endswith('"') else r.choice([" ", "\n", "'"]) + noise()
                out.append((left[-NEAR:], c, right[:NEAR], 1))
                continue
            if c.startswith(("AKIA", "ghp_", "sk_live_")) and r.random() < 0.5:
                left = noise()
            right = r.choice(['"', '"', "'", "", " ", "\n"]) + noise()
            if left.endswith('"'):
                right = '"' + noise()
            out.append((left[-NEAR:], c, right[:NEAR], 1))
            continue
        kind = r.randrange(14)
        left, right = noise(), r.choice(["", " ", ".", ",", "\n"]) + noise()
        if kind in (0, 1):  # long words, plain or in capitals
            c = "".join(r.choices(syllables, k=12))[: r.randint(16, 30)]
            c = r.choice([c, c, c.capitalize(), c.upper()])
        elif kind == 2:
            c = "".join(w.capitalize() for w in r.choices(WORDS, k=r.randint(3, 5))) + r.choice(["", "2", "Impl"])
            c = c.ljust(16, "X")
        elif kind == 3:
            c = r.choice("_-").join(r.choices(WORDS, k=r.randint(3, 6))).ljust(16, "_")
            left += r.choice(["", "api_", "token ", "def ", "key: ", "secret_"]) if r.random() < 0.4 else ""
        elif kind == 4:
            c = "/".join(r.choices(WORDS, k=r.randint(3, 6))).ljust(16, "/")
            left, right = left + r.choice(["/", "https://" + word() + ".example.com/", "./", "C:\\"]), r.choice([".py", ".html", "/", " "]) + noise()
        elif kind == 5:
            c = run(hexes, r.choice([32, 40, 64]))
            left += r.choice(["commit ", "sha256:", "sha1 ", "md5 = ", "checksum: ", "integrity sha256-", "hash: ", "rev "])
        elif kind == 6:
            c = "-".join(run(hexes, k) for k in (8, 4, 4, 4, 12))
            left += r.choice(["uuid: ", "id=", "request ", 'id": "', ""])
        elif kind == 7:
            c = run("0123456789", r.randint(16, 22))
            left += r.choice(["", "number ", "id ", "tel "])
        elif kind == 8:
            c = r.choice(["x" * r.randint(16, 40), "your_api_key_here", "your-access-token-here", "0" * r.randint(16, 40), "example_secret_key", "=" * 4 + "-" * r.randint(16, 60), "_" * r.randint(16, 50), "placeholder_token_value", "XXXXXXXX-XXXX-XXXX"])
            left += r.choice(["token = ", 'api_key = "', "password: ", ""])
            c = c.lstrip("=").ljust(16, "x")
        elif kind == 13:  # names and ports in the places of passwords in URLs, and cut tokens
            left, c, right = r.choice([
                lambda: (left + "https://" + word() + ":", r.choice(["password", "passwd", "secret", "<" + "password" + ">", "${PASSWORD}", "xxxxxx", "******", "your_password"]), "@" + word() + ".example.com/ " + noise()),
                lambda: (left, ".".join(r.choices(WORDS, k=3)).ljust(16, "s"), right),
                lambda: (left, "-----BEGIN PUBLIC KEY-----"[5:21].replace(" ", "_").ljust(16, "-"), right),
            ])()
        elif kind >= 11:  # plain values, after the words and assignments of secrets
            c = r.choice([lambda: word().rjust(6, "a"), lambda: word().capitalize().ljust(6, "s") + r.choice(["", ","]), lambda: "".join(r.choices(syllables, k=8))[: r.randint(6, 15)], lambda: run("0123456789", r.randint(6, 10)), lambda: "-".join(r.choices(WORDS, k=2)).ljust(6, "s"), lambda: "_".join(r.choices(WORDS, k=2)).ljust(6, "s"),
                          lambda: word() + "." + word() + r.choice(["", "()", "(" + word() + ")"]) + "s", lambda: "${" + word().upper() + "_" + word().upper() + "}s", lambda: "<" + word() + "-" + word(), lambda: run("*", r.randint(6, 12)), lambda: "https://" + word() + ".example.com/" + word(), lambda: "/" + word() + "/" + word() + "s", lambda: "changeme", lambda: "your_" + word() + "_here", lambda: r.choice(["required", "optional", "string", "undefined", "password", "disabled", "example"])])()
            left += r.choice(["token", "api_key", "key", "secret", "password", "passwd", "auth", "login", "access", "private", "signature"]) + r.choice([' = "', '="', ": ", "=", " = '", '": "', " = "])
        elif kind == 9:  # such names, before what they name
            c = long_name() + r.choice(["=", "=", ""])
            right = r.choice([run(hexes, 40), run(alnum, 32), run(b64, 44), '"' + run(alnum, 24) + '"']) if c.endswith("=") else r.choice([": ", ' = "', "\n"]) + run(alnum, 24)
        else:
            c = run(b64, r.randint(40, 120))
            left += r.choice(["data:image/png;base64,", "base64,", "image: ", "trace "])
        out.append((left[-NEAR:], c, right[:NEAR], 0))
    return out


@dataclass
class Forest:
    """Trees in flat arrays: the feature, cut and children of a node; a leaf's
    children are itself."""

    feature: list[int]
    cut: list[float]
    left: list[int]
    right: list[int]
    value: list[float]
    roots: list[int]
    depth: int

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray, trees: int = 40, depth: int = 8, least: int = 3, seed: int = 3) -> Forest:
        rng, f = np.random.default_rng(seed), cls([], [], [], [], [], [], depth)
        for _ in range(trees):
            rows = rng.integers(0, len(y), len(y))
            f.roots.append(f._grow(x[rows], y[rows], depth, least, rng))
        return f

    def _grow(self, x: np.ndarray, y: np.ndarray, depth: int, least: int, rng: np.random.Generator) -> int:
        me = len(self.value)
        for a, v in ((self.feature, 0), (self.cut, 0.0), (self.left, me), (self.right, me), (self.value, float(y.mean()))):
            a.append(v)
        n, best = len(y), (1e-12, -1, 0.0)
        if depth and n >= 2 * least and 0 < y.sum() < n:
            base = n * y.mean() * (1 - y.mean())
            for j in rng.choice(x.shape[1], max(1, int(np.sqrt(x.shape[1])) + 1), replace=False):
                order = np.argsort(x[:, j], kind="stable")
                v, c = x[order, j], y[order].cumsum()
                k = np.arange(1, n)
                ok = (v[1:] > v[:-1]) & (k >= least) & (n - k >= least)
                if not ok.any():
                    continue
                a, b = c[:-1], c[-1] - c[:-1]
                gain = np.where(ok, base - a * (1 - a / k) - b * (1 - b / (n - k)), 0)
                i = int(gain.argmax())
                if gain[i] > best[0]:
                    best = (float(gain[i]), int(j), float((v[i] + v[i + 1]) / 2))
        if best[1] >= 0:
            self.feature[me], self.cut[me] = best[1], best[2]
            low = x[:, best[1]] <= best[2]
            self.left[me] = self._grow(x[low], y[low], depth - 1, least, rng)
            self.right[me] = self._grow(x[~low], y[~low], depth - 1, least, rng)
        return me

    def predict(self, x: np.ndarray) -> np.ndarray:
        feature, cut, left, right, value = (np.array(a) for a in (self.feature, self.cut, self.left, self.right, self.value))
        total, rows = np.zeros(len(x)), np.arange(len(x))
        for root in self.roots:
            node = np.full(len(x), root)
            for _ in range(self.depth):
                node = np.where(x[rows, feature[node]] <= cut[node], left[node], right[node])
            total += value[node]
        return total / len(self.roots)

    def sql(self, x: str) -> str:
        """The mean of the trees' leaves for the array of features x."""
        array = lambda a, kind: f"cast(split('{','.join(map(repr, a))}', ',') as array<{kind}>)"
        step = f"if({x}[{array(self.feature, 'int')}[node]] <= {array(self.cut, 'double')}[node], {array(self.left, 'int')}[node], {array(self.right, 'int')}[node])"
        leaf = f"aggregate(sequence(1, {self.depth}), root, (node, level) -> {step})"
        return f"aggregate({array(self.roots, 'int')}, cast(0 as double), (s, root) -> s + {array(self.value, 'double')}[{leaf}]) / {len(self.roots)}"


def fit(spark: SparkSession, findings: DataFrame | list[tuple[str, str, str, int]] | None = None, most: int = MOST_FINDINGS) -> Forest:
    """A forest fitted on labelled findings (left, candidate, right, label): a
    table, or rows. Of more than `most` of them those with the least hashes are
    taken. A null left or right is empty; findings without candidate or label are
    left out; without any findings, or with one label alone, the forest gives the
    share of label 1. Without a table, findings are made by rule."""
    if not isinstance(findings, DataFrame):
        findings = spark.createDataFrame(default_findings() if findings is None else findings, "left string, candidate string, right string, label int")
    rows = findings.select(F.coalesce("left", F.lit("")).alias("l"), F.col("candidate").alias("c"), F.coalesce("right", F.lit("")).alias("r"), F.col("label").cast("int").alias("y")).filter("length(c) > 0 AND y IS NOT NULL")
    rows = rows.orderBy(F.xxhash64("l", "c", "r", "y"), "l", "c", "r", "y").limit(most).select("y", F.expr(feature_sql("c", "l", "r")).alias("x")).collect()
    if not rows:
        return Forest.fit(np.zeros((1, len(FEATURES))), np.zeros(1), trees=1)
    return Forest.fit(np.array([r["x"] for r in rows]), np.array([r["y"] for r in rows], dtype=float))


def _scanned(docs: DataFrame, forest: Forest, threshold: float, text_col: str) -> DataFrame:
    """docs with __parts, __cands, __starts, __scores: the text between candidates,
    these, where they start, and their scores. What is near a candidate is the
    text around it, other candidates included."""
    text = f"`{text_col}`"
    out = docs.withColumn("__cands", F.expr(f"regexp_extract_all({text}, r'{CANDIDATE}', 0)"))
    out = out.withColumn("__parts", F.expr(f"if(size(__cands) > 0, split({text}, r'{CANDIDATE}', -1), array({text}))"))
    starts = "aggregate(__cands, named_struct('i', 0, 'at', 0, 'all', cast(array() as array<int>)), (a, c) -> named_struct('i', a.i + 1, 'at', a.at + length(__parts[a.i]) + length(c), 'all', array_append(a.all, a.at + length(__parts[a.i]))), a -> a.all)"
    out = out.withColumn("__starts", F.expr(starts))
    left = f"substring({text}, greatest(__starts[i] - {NEAR}, 0) + 1, least(__starts[i], {NEAR}))"
    places = f"transform(__cands, (c, i) -> named_struct('c', c, 'l', {left}, 'r', substring({text}, __starts[i] + length(c) + 1, {NEAR})))"
    xs = f"transform({places}, p -> {feature_sql('p.c', 'p.l', 'p.r')})"
    return out.withColumn("__scores", F.expr(f"transform({xs}, x -> {forest.sql('x')})"))


def scan(docs: DataFrame, forest: Forest, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, n_candidates, n_secrets, and secrets, an
    array of (start in code points from 0, length, score) of those that score
    threshold or more.

    Null and empty texts have none; equal texts have equal results; an empty
    table gives no rows; further columns are ignored.
    """
    base = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    out = _scanned(base, forest, threshold, "text")
    all_ = F.expr("transform(arrays_zip(__cands, __scores, __starts), z -> named_struct('start', cast(z.__starts as bigint), 'length', cast(length(z.__cands) as bigint), 'score', z.__scores))")
    secrets = F.filter(all_, lambda s: s["score"] >= threshold)
    return out.select("doc_id", F.size("__cands").cast("long").alias("n_candidates"), secrets.alias("secrets")).select("doc_id", "n_candidates", F.size("secrets").cast("long").alias("n_secrets"), "secrets")


def redact(docs: DataFrame, forest: Forest, threshold: float = THRESHOLD, text_col: str = "text", replacement: str = REPLACEMENT) -> DataFrame:
    """docs, with all columns and rows, each secret in text_col replaced; a null text stays null."""
    out = _scanned(docs, forest, threshold, text_col)
    clean = F.expr(f"array_join(transform(__parts, (p, i) -> concat(p, if(i < size(__cands), if(__scores[i] >= {threshold}, '{replacement}', __cands[i]), ''))), '')")
    new = F.when(F.exists("__scores", lambda s: s >= threshold), clean).otherwise(F.col(text_col))
    return out.withColumn(text_col, new).drop("__cands", "__parts", "__starts", "__scores")
