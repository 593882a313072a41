"""Secret scans with DataFrame functions only: candidates by one pattern, judged by a random forest.

A candidate is a value of at least 6 characters that a key word (password, secret, token and the like) is set to, whatever its
characters, or a run of at least 16 characters of the base64 and identifier alphabets with a digit anywhere in it, or
with a key of 'AKIA' and 16 letters at its start or behind an assignment. What is neither named by a key word nor
such a run (a bare password in prose) is no candidate. Its
features are its length, character transitions, alphabet, how much of it dictionary words cover, the words beside it
and the path it was found under. A forest trained on labelled findings (bounded by ``MAX_LABELLED``) gives
the probability that it is a secret; it is applied as one expression inside the row, so no row is exploded or
shuffled.

The default labelled findings are made by rule with a fixed seed: keys of the published shapes in assignments,
against card numbers, commit ids, UUIDs, host names, paths, versions and placeholders. ``scan`` takes others.

Defined results: a null or empty text has no finding; a candidate that occurs twice is found twice; the context is the
48 characters before and the 16 behind; repeated rows and equal ids are scanned row by row; an empty table gives
no rows; a null path is an empty path; other columns are not read.
"""

from __future__ import annotations

import random
import re
import string
import uuid

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from . import forest

MAX_LABELLED = 20_000
MARK = "[SECRET]"

#: A key word and an assignment before a value, looked at only where a value can start; at most 12 characters of the name may follow the key word.
KEYED = r"(?<=[\s=:\"'`])(?<=[=:]|[=:]\s{1,3}|[=:]\s{0,3}[\"'`])(?<=(?i:passw(?:or)?d|passphrase|pwd|secret|token|api[_-]?key|access[_-]?key|private[_-]?key|auth|credentials?)[A-Za-z0-9_-]{0,12}[\"'`]?\s{0,3}[=:]\s{0,3}[\"'`]?)(?=[^\s\"'`,;<>(){}\[\]=:])"
#: The value: up to white space, a quote or a bracket.
VALUE = r"[^\s\"'`,;<>(){}\[\]]{6,}+"
#: One alphabet run with a digit, however far in, or with a whole 'AKIA' key; possessive, so a long run is passed over once.
RUN = r"(?<![A-Za-z0-9+/_=.\-])(?=[A-Za-z+/_=.\-]*+[0-9]|(?:[A-Za-z+/_.\-]*=)?AKIA[A-Z]{16}(?![A-Za-z0-9]))[A-Za-z0-9+/_=.\-]{16,}+"
CANDIDATE = f"(?:{KEYED}{VALUE}|{RUN})"

# Words that speak for and against a secret beside a candidate, and in a path.
FOR = "token|secret|passw|pwd|api_?-?key|apikey|access_?key|auth|bearer|credential|private"
AGAINST = "commit|sha1|sha256|md5|checksum|digest|revision|uuid|guid|card|order|invoice|version|example|placeholder|sample|dummy|http|www|href|phone|isbn"
PATHS = "test|example|sample|mock|fixture|docs"
#: What stands where a value should be.
HOLDERS = "^(true|false|none|null|nil|undefined|required|optional|string|str|bytes|int|any|unset|empty|hidden|redacted|masked|removed|secret|password|passwd|token|value|changeme|default|string\\\\|null)[.!]?$|^[*x.#_-]+$|^\\$|%|your|here|example|placeholder|env|config|input|get|self|this"
#: A short dictionary for coverage.
WORDS = (
    "about account address admin after all and any api app application are auth back base be before book build by call change check class client code com commit config "
    "connect content count data date day default delete demo dev document down edit email end error event example file find first for form from get go group have here home "
    "host html http id image in index info into is it item its key last like line link list load local log login mail main make man map message mode model more name net "
    "new no node not now number object of off on one open option or order org other out page part pass path people place post print private product program project public "
    "query read release request result root run same save search section see select send server service set show site size source start state stop store string system table "
    "test text that the then there this time title to token top type up update upload url use user value version view was way web what when which will window with word work world www year you your"
)


def dictionary() -> str:
    """An alternation of the words of three letters or more, longest first."""
    return "|".join(sorted({w for w in WORDS.split() if len(w) >= 3}, key=lambda w: (-len(w), w)))


FEATURES = ("length", "digits", "transitions", "vowel_pairs", "covered", "distinct", "hexadecimal", "dots", "slashes", "for", "against", "assigned", "quoted", "path", "only_digits", "dashes", "signs", "placeholder", "capitals")


def features(cand: Column, before: Column, after: Column, path: Column) -> list[Column]:
    n = F.length(cand).cast("double")
    low = F.lower(cand)
    without = lambda x: (F.length(cand) - F.length(F.translate(cand, x, ""))) / n
    left = F.lower(before)
    flag = lambda c: F.when(c, 1.0).otherwise(0.0)
    return [
        n,
        without(string.digits),
        F.regexp_count(cand, F.lit("[a-z](?=[^a-z])|[A-Z](?=[^A-Z])|[0-9](?=[^0-9])")) / n,
        F.regexp_count(low, F.lit("[aeiou](?=[bcdfghjklmnpqrstvwxyz])")) / n,
        1.0 - F.length(F.regexp_replace(low, dictionary(), "")) / n,
        F.size(F.array_distinct(F.split(cand, ""))) / n,
        flag(low.rlike("^[0-9a-f]+$")),
        without("."),
        without("/"),
        flag(left.rlike(FOR)),
        flag(left.rlike(AGAINST)),
        flag(left.rlike("[=:]\\s*[\"'`]?$")),
        flag(left.rlike("[\"'`]$") & after.rlike("^[\"'`]")),
        flag(F.lower(path).rlike(PATHS)),
        flag(cand.rlike("^[0-9.\\-]+$")),
        without("-_"),
        without("!?@#$%^&*~|\\"),
        flag(low.rlike(HOLDERS)),
        without(string.ascii_uppercase),
    ]


def plain_features(cand: str, before: str, after: str, path: str) -> list[float]:
    """The same features in Python, for the labelled sample on the driver."""
    n, low, left = float(len(cand)), cand.lower(), before.lower()
    without = lambda x: sum(c in x for c in cand) / n
    flag = lambda p, s: 1.0 if re.search(p, s) else 0.0
    return [
        n,
        without(string.digits),
        len(re.findall("[a-z](?=[^a-z])|[A-Z](?=[^A-Z])|[0-9](?=[^0-9])", cand)) / n,
        len(re.findall("[aeiou](?=[bcdfghjklmnpqrstvwxyz])", low)) / n,
        1.0 - len(re.sub(dictionary(), "", low)) / n,
        len(set(cand)) / n,
        flag("^[0-9a-f]+$", low),
        without("."),
        without("/"),
        flag(FOR, left),
        flag(AGAINST, left),
        flag("[=:]\\s*[\"'`]?$", left),
        1.0 if re.search("[\"'`]$", left) and re.search("^[\"'`]", after) else 0.0,
        flag(PATHS, path.lower()),
        flag("^[0-9.\\-]+$", cand),
        without("-_"),
        without("!?@#$%^&*~|\\"),
        flag(HOLDERS, low),
        without(string.ascii_uppercase),
    ]


def labelled_findings(n: int = 3000, seed: int = 5) -> list[tuple[str, str, str, str, int]]:
    """(candidate, before, after, path, is a secret) made by rule."""
    rng = random.Random(seed)
    pick = lambda alphabet, k: "".join(rng.choice(alphabet) for _ in range(k))
    letters, alnum, hexa = string.ascii_letters, string.ascii_letters + string.digits, "0123456789abcdef"
    word = lambda: pick("aeiou" + string.ascii_lowercase, rng.randint(2, 9))
    prose = lambda: " ".join(word() for _ in range(rng.randint(1, 5))) + " "
    paths = lambda: rng.choice(["", "src1", "app/main.py", "conf/prod.env", "tests/data.txt", "docs/example.md", f"src{rng.randrange(20)}"])
    out = []
    for i in range(n):
        after, before = " " + prose(), prose()
        if i % 4 == 3 and rng.random() < 0.5:  # a value that a key word names: a password, or what stands in for one
            name = rng.choice(["password", "passwd", "pwd", "secret", "token", "db_password", "PASSWORD", "auth_token", "api_key", "passphrase"])
            quote, shape, label = rng.choice(['"', "'", "", ""]), 10, rng.randrange(2)
            common = rng.choice(WORDS.split())
            if label:
                lower = lambda: pick(string.ascii_lowercase, rng.randint(3, 8))
                kind = rng.randrange(5)
                cand = (lower() + pick(string.digits, rng.randint(1, 4)) + pick("!?@#$%&*", rng.randint(0, 2)), pick(alnum + "!?@#$%&*", rng.randint(8, 20)), lower() + lower() + lower() + lower(), pick(letters, rng.randint(16, 32)), lower().capitalize() + pick("!@#$_-.", 1) + lower() + pick(string.digits, 2))[kind]
            else:
                stands = ["required", "optional", "string", "none", "null", "true", "false", "undefined", "changeme", "password", "secret", "redacted", "${" + "PASS}", "$PASSWORD", "%env%", "********", "xxxxxxxx", "your-password", "your_token_here", "example", "config.password", "os.environ", "self.token", "getpass", "input", "value."]
                cand = rng.choice([rng.choice(stands), rng.choice(stands), common + "ing", common + common[:2] + "s", word()])
                cand += "." if len(cand) < 6 else ""
                cand = cand.replace("{", "").replace("}", "")
                cand += "s" * max(0, 6 - len(cand))
            before += name + rng.choice([" = ", "=", ": ", ":"]) + quote
            after = (quote or " ") + prose()
        elif i % 2:
            shape = rng.randrange(6)
            cand = (pick(hexa, rng.choice([32, 40, 64])), pick(alnum, rng.randint(20, 48)), pick(alnum + "+/", rng.randint(30, 60)) + "=" * rng.randrange(3), "AKIA" + pick(string.ascii_uppercase + "234567", 16), "ghp_" + pick(alnum, 36), pick(alnum + "-_", rng.randint(24, 44)))[shape]
            name = rng.choice(["token", "secret", "password", "api_key", "auth", "credential", "private_key", "access_key", "Bearer", "key", "pwd"])
            quote = rng.choice(['"', '"', "'", ""])
            if rng.random() < 0.9:
                before += name + rng.choice([" = ", "=", ": ", ":", ' "' if not quote else " = "]) + quote
                after = quote + rng.choice(["###", " ", "\n", ",", "$$$"]) + prose()
            label = 1 if rng.random() < 0.99 else 0
        else:
            shape = rng.randrange(9)
            cand = (
                pick(string.digits, rng.randint(16, 19)),
                pick(hexa, 40),
                str(uuid.UUID(int=rng.getrandbits(128))),
                f"mail{rng.randrange(100)}.{word()}example.com",
                "/".join(["", word(), word(), f"v{rng.randrange(10)}", word() + ".html"]),
                f"{rng.randrange(1990, 2030)}-{rng.randrange(10, 13)}-{rng.randrange(10, 29)}T{rng.randrange(10, 24)}.{rng.randrange(10, 60)}.{rng.randrange(10, 60)}",
                word() + word() + word() + str(rng.randrange(1000)),
                "your_api_key_" + rng.choice(["here_1", "goes_here_0", "example_123"]),
                "-" * rng.randint(10, 30) + str(rng.randrange(10**7)).rjust(7, "0"),
            )[shape]
            before += rng.choice(["", "", {1: "commit ", 2: "uuid ", 0: "card ", 4: "http://", 3: "at "}.get(shape, ""), "order ", "version "] if shape != 1 else ["commit ", "sha1 ", "revision ", "checksum: ", "md5="])
            if shape in (0, 3, 7) and rng.random() < 0.2:
                before += 'key = "'
                after = '" ' + prose()
            label = 0
        if len(cand) < 16 and shape < 10:
            cand += pick(string.digits, 16 - len(cand)) if shape != 6 or i % 2 else word() + "1" * 16
        out.append((cand, before[-48:], after[:16], paths(), label))
    return out


_TRAINED: dict[int, list[forest.Node]] = {}


def trained(findings: list[tuple[str, str, str, str, int]] | None = None) -> list[forest.Node]:
    """The forest of these labelled findings, or the default ones (trained once)."""
    if findings is None:
        if 0 not in _TRAINED:
            _TRAINED[0] = trained(labelled_findings())
        return _TRAINED[0]
    if len(findings) > MAX_LABELLED:
        raise ValueError(f"more than {MAX_LABELLED} labelled findings")
    return forest.train(np.array([plain_features(*f[:4]) for f in findings]), np.array([f[4] for f in findings]))


def labelled_from(df: DataFrame) -> list[tuple[str, str, str, str, int]]:
    """Labelled findings of a table (candidate, before, after, path, label), at most MAX_LABELLED rows."""
    rows = df.select("candidate", "before", "after", "path", "label").limit(MAX_LABELLED + 1).collect()
    return [(r[0], r[1] or "", r[2] or "", r[3] or "", int(r[4])) for r in rows]


#: Other candidates and gaps that the 48 characters before, or the 16 behind, can reach over: a candidate has 6 characters or more.
BACK, AHEAD = 16, 6
#: Candidates whose lengths are summed as one.
BLOCK = 128


def once(value: Column) -> Column:
    """``value``, but worked out once for each row: as it does not look deterministic, it is not copied into the lambdas that read it."""
    return F.when(F.monotonically_increasing_id() >= 0, value)


def with_findings(docs: DataFrame, text: str, path: str, trees: list[forest.Node], threshold: float) -> DataFrame:
    """docs with ``findings``, an array of (cand, start, score, secret), and ``gaps``, the pieces of text between them. Text is cut once at its
    candidates, and places follow from the lengths of the pieces, so the work is in proportion to the text."""
    t, p = F.coalesce(F.col(text).cast("string"), F.lit("")), F.coalesce(F.col(path).cast("string"), F.lit(""))
    step1 = docs.withColumn("_cands", once(F.regexp_extract_all(t, F.lit(CANDIDATE), F.lit(0))))
    step2 = step1.withColumn("gaps", once(F.when(F.size("_cands") > 0, F.split(t, CANDIDATE, -1)).otherwise(F.array(t))))
    # gap, candidate, gap, ..., gap; and how many characters stand between the ends of two candidates
    pieces = F.flatten(F.zip_with("gaps", "_cands", lambda g, c: F.filter(F.array(g, c), lambda x: x.isNotNull())))
    steps = F.zip_with(F.slice("gaps", 1, F.size("_cands")), "_cands", lambda g, c: F.length(g) + F.length(c))
    step3 = step2.withColumns({"_pieces": once(pieces), "_steps": once(steps)})
    total = lambda x: F.aggregate(x, F.lit(0), lambda a, n: a + n)
    step3 = step3.withColumn("_sums", once(F.transform(F.sequence(F.lit(0), F.floor(F.size("_steps") / BLOCK).cast("int")), lambda k: total(F.slice("_steps", k * BLOCK + 1, F.lit(BLOCK))))))

    def end_of(i: Column) -> Column:
        """The end of candidate i: by sums of whole blocks of steps, and the steps of the last one."""
        k = F.floor(i / BLOCK).cast("int")
        return total(F.slice("_sums", F.lit(1), k)) + total(F.slice("_steps", k * BLOCK + 1, i % BLOCK + 1))

    def described(cand: Column, i: Column) -> Column:
        own = 2 * i + 2  # the candidate's place among the pieces, from 1
        low = F.greatest(F.lit(1), own - BACK)
        before = F.right(F.array_join(F.slice("_pieces", low, own - low), ""), F.lit(48))
        after = F.left(F.array_join(F.slice("_pieces", own + 1, F.lit(AHEAD)), ""), F.lit(16))
        names = [c.alias(f"f{k}") for k, c in enumerate(features(cand, before, after, p))]
        return F.struct(cand.alias("cand"), (end_of(i) - F.length(cand) + 1).alias("start"), *names)

    step4 = step3.withColumn("_x", F.transform("_cands", described)).drop("_cands", "_pieces", "_steps", "_sums")
    votes = forest.expression(trees, lambda i: f"f.f{i}")
    scored = F.expr(f"transform(_x, f -> named_struct('cand', f.cand, 'start', f.start, 'score', {votes}))")
    step5 = step4.withColumn("_y", scored).drop("_x")
    return step5.withColumn("findings", F.transform("_y", lambda f: F.struct(f["cand"].alias("cand"), f["start"].alias("start"), f["score"].alias("score"), (f["score"] >= threshold).alias("secret")))).drop("_y")


def scan(docs: DataFrame, threshold: float = 0.5, path: str = "source", findings: list | None = None) -> DataFrame:
    """A row for each candidate: doc_id, start (from 1, in characters), length, candidate, score, is_secret."""
    rows = with_findings(docs.select("doc_id", "text", path), "text", path, trained(findings), threshold)
    return rows.select("doc_id", F.explode("findings").alias("f")).select("doc_id", F.col("f.start").cast("long").alias("start"), F.length("f.cand").cast("long").alias("length"), F.col("f.cand").alias("candidate"), F.col("f.score").alias("score"), F.col("f.secret").alias("is_secret"))


def redact(docs: DataFrame, threshold: float = 0.5, path: str = "source", findings: list | None = None) -> DataFrame:
    """docs with every secret replaced by a mark; all columns and all rows stay, a whole-number n_chars follows the text."""
    names = docs.columns
    rows = with_findings(docs.withColumnsRenamed({c: f"c_{c}" for c in names}), "c_text", f"c_{path}", trained(findings), threshold)
    kept = F.transform("findings", lambda f: F.when(f["secret"], F.lit(MARK)).otherwise(f["cand"]))
    joined = F.array_join(F.zip_with("gaps", kept, lambda g, c: F.concat(g, F.coalesce(c, F.lit("")))), "")
    clean = F.when(F.size("findings") > 0, joined).otherwise(F.col("c_text").cast("string"))
    out = rows.withColumn("_clean", clean)
    pick = {"text": F.col("_clean")}
    if "n_chars" in names and isinstance(docs.schema["n_chars"].dataType, IntegralType):
        pick["n_chars"] = F.when(F.size("findings") > 0, F.length("_clean")).otherwise(F.col("c_n_chars")).cast(docs.schema["n_chars"].dataType)
    return out.select(*((pick[c] if c in pick else F.col(f"c_{c}")).alias(c) for c in names))
