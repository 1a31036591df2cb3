"""Secret scan: rules propose candidates, a random forest removes false positives.

Candidates are values assigned to a name of the secret family (also as KEY=value, in JSON, YAML and the query of a URL), passwords inside URLs, strings of known key formats, private-key headers, and
long runs of key characters with digits and letters. The forest reads candidate length, character transitions (class changes, surprise of character pairs, entropy), dictionary
coverage, the path and the neighbouring words. The dictionary is the words that most documents have, ``WORDS`` at most, counted over all of them, and a few words of placeholders. The forest is trained from labelled
findings (candidate, before, after, path, label), of which at most ``FINDINGS``, drawn by a hash, are read, each as the scan would cut it out of its surroundings; without a table of their own callers get
``made_findings``: a fixed number of findings written by rule from a seed, no matter how large the corpus.

Defined results: a null or empty text has no finding; a null path counts as empty; repeated rows are scanned each for itself; a null doc_id is kept; an
empty table gives no rows; other columns are not read. Findings without a candidate or label are left out, their other nulls count as empty; if those that remain lack one of the labels, every candidate scores
the share of true ones (0.5 without any). Whole texts are read, and every kept finding is returned.
"""

from __future__ import annotations

import bisect
import math
import random
import re
import string
import uuid
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, SparkSession, functions as F

from kindred.llm.arrow import column, slices, texts
from kindred.llm.counts import frequent_from
from kindred.plans.scratch import Scratch

#: Formats of well-known keys, names that secrets are assigned to, words that speak against a secret, words of placeholders.
FORMATS = {
    "aws_key_id": r"(?:AKIA|ASIA)[0-9A-Z]{16}", "github": r"gh[pousr]_[A-Za-z0-9]{36}", "slack": r"xox[baprs]-[A-Za-z0-9-]{10,}", "stripe": r"[sr]k_(?:live|test)_[A-Za-z0-9]{16,}",
    "google": r"AIza[0-9A-Za-z_\-]{35}", "jwt": r"eyJ[A-Za-z0-9_\-]{8,}\.[A-Za-z0-9_\-]{8,}\.[A-Za-z0-9_\-]{8,}",
}
NAMES = "token secret password passwd pwd pass apikey key auth authorization credential credentials bearer private".split()
ENDINGS = ("password", "passwd", "secret", "token", "apikey")
AGAINST = "commit sha sha1 sha256 md5 hash checksum digest uuid guid id revision etag integrity image png font svg version build isbn iban account order serial fingerprint blob tree".split()
DICTIONARY = "your example test sample dummy placeholder change changeme here insert replace foo bar baz secret password token key api access user admin name value string default none null true false config env prod dev local host data file path the and for with from this that".split()
TESTS = "test tests spec mock fixture fixtures example examples sample doc docs demo".split()
#: Characters before and after a candidate that are read; findings that are made to learn from; trees and their depth.
NEAR, MADE, TREES, DEPTH, SEED = 48, 4_000, 40, 7, 5
#: Findings that are read of a caller's table, words of the dictionary, and their lengths.
FINDINGS, WORDS, LENGTHS = 20_000, 20_000, range(4, 16)
_RUN = re.compile(r"[A-Za-z0-9+/_\-.]{14,}(?:={1,2}(?![A-Za-z0-9+/=_\-.]))?")  # '=' is padding at the end, else it parts name and value
_ASSIGNED = re.compile(r"[:=](?=\s*(?:[\"']\s*)?(?:(?:[Bb]earer|[Bb]asic|[Tt]oken)\s+)?((?:[^\s\"'<>,;&]|&(?!\w+=)){6,}))")
_URL = re.compile(r"[a-z]://[^\s/:@]*:([^\s/@]{6,})@")
_CAMEL = re.compile(r"(?<=[a-z0-9])(?=[A-Z])")
_HEADER = re.compile(r"-----BEGIN [A-Z ]*PRIVATE KEY-----")
_KNOWN = {k: re.compile(v) for k, v in FORMATS.items()}
_INSIDE = {k: re.compile(rf"(?<![A-Za-z0-9])(?:{v})(?![A-Za-z0-9])") for k, v in FORMATS.items()}
_WORDS = re.compile(r"[a-z0-9]+")


def _said(text: str) -> list[str]:
    """Words of a context; camelCase and snake_case are parted."""
    return _WORDS.findall(_CAMEL.sub(" ", text).lower().replace("_", " "))


def _names(words: list[str]) -> bool:
    return any(w in NAMES or w.endswith(ENDINGS) for w in words)


def candidates(text: str) -> list[tuple[int, int, str]]:
    """(start, length, kind) of each candidate, none inside another."""
    found = {}
    for m in _HEADER.finditer(text):
        found[m.start()] = (m.end(), "private_key")
    if "=" in text or ":" in text:
        for m in _ASSIGNED.finditer(text):
            if _names(_said(text[max(m.start() - 24, 0) : m.start()])):
                found.setdefault(m.start(1), (m.end(1), "assigned"))
    if "://" in text:
        for m in _URL.finditer(text):
            found[m.start(1)] = (m.end(1), "url")
    for kind, p in _INSIDE.items():
        for m in p.finditer(text):
            found.setdefault(m.start(), (m.end(), kind))
    starts = sorted(found)
    for m in _RUN.finditer(text):
        at, pieces = m.start(), []  # what assigned values and known formats leave of the run
        for start in starts[max(bisect.bisect_right(starts, at) - 1, 0) : bisect.bisect_left(starts, m.end())]:
            if found[start][0] > at:
                pieces.append((at, start))
                at = found[start][0]
        for at, end in [*pieces, (at, m.end())]:
            piece = text[at:end]
            run = piece.strip(".-=") if piece[-1:] != "=" else piece.lstrip(".-=")
            start = at + piece.index(run) if run else at
            if len(run) < 16 or not any(c.isdigit() for c in run) or not any(c.isalpha() for c in run) or "@" in text[max(start - 1, 0) : start + len(run) + 1]:
                continue
            found.setdefault(start, (start + len(run), "run"))
    out, upto = [], -1
    for start, (end, kind) in sorted(found.items()):
        if start >= upto:
            out.append((start, end - start, kind))
            upto = end
    return out


class Transitions:
    """Log probabilities of character pairs in the candidates that are no secrets."""

    def __init__(self, ordinary: list[str]):
        pairs = Counter((a, b) for s in ordinary for a, b in zip(s.lower(), s.lower()[1:]))
        first = Counter(a for a, _ in pairs.elements())
        self.known = {p: math.log((n + 0.1) / (first[p[0]] + 4)) for p, n in pairs.items()}

    def surprise(self, s: str) -> float:
        s = s.lower()
        return -sum(self.known.get(p, -6.0) for p in zip(s, s[1:])) / max(len(s) - 1, 1)


def _kind(c: str) -> int:
    return 0 if c.islower() else 1 if c.isupper() else 2 if c.isdigit() else 3


def coverage(low: str, words: frozenset[str]) -> int:
    """Characters that some word of the dictionary covers."""
    covered = bytearray(len(low))
    for i in range(len(low)):
        for n in LENGTHS:
            if low[i : i + n] in words and i + n <= len(low):
                covered[i : i + n] = b"\x01" * n
    return sum(covered)


def measures(candidate: str, before: str, after: str, path: str, transitions: Transitions, words: frozenset[str] = frozenset()) -> list[float]:
    n, counts, low = max(len(candidate), 1), Counter(candidate), candidate.lower()
    left, right, at = _said(before), _said(after), set(_WORDS.findall(path.lower()))
    tail = before.rstrip("\"' ")
    return [
        float(n), -sum(k / n * math.log2(k / n) for k in counts.values()), sum(_kind(a) != _kind(b) for a, b in zip(candidate, candidate[1:])) / n, transitions.surprise(candidate),
        coverage(low, words) / n, len(counts) / n, sum(c.isdigit() for c in candidate) / n, sum(c.isupper() for c in candidate) / n, float(set(low) <= set("0123456789abcdef-")),
        float(candidate.count("-") == 4 and n == 36), float(_names(left[-4:])), float(any(w in AGAINST for w in left[-4:])), float(any(w in AGAINST for w in right[:3])),
        float(tail.endswith(("=", ":"))), float(before[-1:] in "\"'" and bool(before)), float(bool(at & set(TESTS))), float(any(p.fullmatch(candidate) for p in _KNOWN.values())),
        float("private key" in low), float(after[:1] == "@" and "://" in before),
    ]


def made_findings(spark: SparkSession, rows: int = MADE, seed: int = SEED) -> DataFrame:
    """Labelled findings by rule: keys in assignments against hashes, ids, placeholders, words, paths and numbers in their usual surroundings."""
    draw = random.Random(seed)
    take = lambda alphabet, n: "".join(draw.choices(alphabet, k=n))
    hexa, key = "0123456789abcdef", string.ascii_letters + string.digits
    word = lambda: "".join(draw.choice(("er", "tion", "an", "the", "ing", "re", "on", "st", "in", "ent", "ver", "mo", "da")) for _ in range(draw.randint(2, 4)))
    prose = lambda n: " ".join(word() for _ in range(n))

    def case(s: str) -> str:
        return s.upper() if draw.random() < 0.15 else s

    def secret() -> tuple[str, str, str]:
        name = draw.choice([n for n in NAMES if n not in ("bearer", "auth")])
        value = draw.choice([
            lambda: take(hexa, draw.choice((32, 40, 64))), lambda: take(key, draw.randint(20, 48)), lambda: take(key + "+/", 40) + draw.choice(("", "=")), lambda: "AKIA" + take(string.ascii_uppercase + string.digits, 16),
            lambda: "ghp_" + take(key, 36), lambda: "sk_live_" + take(key, 24), lambda: take(key + "!#%&*", draw.randint(8, 16)), lambda: "-----BEGIN RSA PRIVATE KEY-----",
            lambda: "eyJ" + take(key, 20) + "." + take(key, 30) + "." + take(key, 30), lambda: take(hexa, 40), lambda: take(hexa, 40),
        ])()
        if draw.random() < 0.06:
            return value, draw.choice(("postgres", "https", "redis", "amqp")) + f"://{word()}:", f"@{word()}.example:{draw.randint(80, 9999)}/{word()}"
        if draw.random() < 0.06:
            return value, prose(2) + draw.choice((" Authorization: Bearer ", ' "Authorization": "Bearer ', " authorization: Basic ")), draw.choice(('"', "\n", " ")) + prose(1)
        quote = draw.choice(('"', '"', "'", ""))
        return case(value) if set(value) <= set(hexa) else value, prose(3) + " " + case(draw.choice((name, "api_" + name, "access_" + name)) + draw.choice((" = ", "=", ": "))) + quote, quote + draw.choice((" ", "\n", ". ")) + prose(2)

    def ordinary() -> tuple[str, str, str]:
        against = draw.choice(AGAINST)
        return draw.choice([
            lambda: (take(hexa, draw.choice((32, 40, 64))), f"{prose(2)} {against}{draw.choice((' ', ': ', '='))}", " " + prose(3)),
            lambda: (str(uuid.UUID(int=draw.getrandbits(128))), f"{prose(2)} {draw.choice(('id', 'uuid', 'guid'))}{draw.choice((' = ', ': ', ' '))}", " " + prose(2)),
            lambda: (draw.choice(("your_api_key_here_", "changeme", "example_token_", "placeholder-secret-", "test_password", "xxxxxxxxxxxxxxxxxxxx")) + str(draw.randint(1, 99)), f"{prose(2)} {draw.choice(NAMES)} = \"", '" ' + prose(2)),
            lambda: (draw.choice(("os.environ", "getenv", "config.get", "${API_KEY}", "settings.SECRET")) + take(string.ascii_lowercase, 8), f"{draw.choice(NAMES)} = ", "\n"),
            lambda: ("/".join(word() for _ in range(4)) + str(draw.randint(1, 99)), prose(3) + " ", " " + prose(2)),
            lambda: (word() + word() + word() + word() + str(draw.randint(1, 2030)), prose(3) + " ", " " + prose(2)),
            lambda: ("-".join(word() for _ in range(3)) + f"-{draw.randint(1, 9)}.{draw.randint(0, 9)}.{draw.randint(0, 9)}", prose(2) + " version ", " " + prose(2)),
            lambda: (take(string.digits, draw.randint(12, 20)) + take(string.ascii_uppercase, 2) + take(string.digits, 6), f"{prose(2)} {draw.choice(('iban', 'account', 'order', 'serial', word()))} ", " " + prose(2)),
            lambda: (take(string.ascii_uppercase, 2) + take(string.digits + string.ascii_uppercase, 22), prose(3) + " ", " " + prose(2)),
            lambda: (word() + str(draw.randint(1, 9)) + word(), f"{draw.choice(NAMES)}: ", " " + prose(3)),
        ])()

    out = []
    for k in range(rows):
        label = k % 2
        value, before, after = secret() if label else ordinary()
        path = "/".join((word(), draw.choice(TESTS) if draw.random() < (0.08 if label else 0.3) else word(), word() + draw.choice((".py", ".env", ".md", ".txt", ""))))
        out.append((value, before[-NEAR:], after[:NEAR], path if draw.random() < 0.5 else "src" + str(draw.randint(0, 30)), label))
    return spark.createDataFrame(out, "candidate string, before string, after string, path string, label int")


def dictionary(docs: DataFrame, scratch: Scratch, size: int = WORDS) -> frozenset[str]:
    """At most ``size`` words that most documents have, counted over all of them, and those of placeholders."""
    words = F.filter(F.array_distinct(F.split(F.lower(F.coalesce("text", F.lit(""))), "[^a-z0-9]+")), lambda w: w.rlike(f"^[a-z]{{{LENGTHS[0]},{LENGTHS[-1]}}}$"))
    counts = scratch.cut(docs.select(F.explode(words).alias("w")).groupBy("w").agg(F.count(F.lit(1)).alias("n")).where("n > 1"))
    often = counts.where(F.col("n") >= frequent_from(counts, size)).select("w").collect()
    return frozenset(r["w"] for r in often) | frozenset(w for w in DICTIONARY if len(w) >= LENGTHS[0])


def as_scanned(candidate: str, before: str, after: str) -> tuple[str, str, str]:
    """The finding as ``candidates`` cuts it out of its surroundings: the piece that overlaps it most, or as it is where the rules propose none."""
    text, start = before + candidate + after, len(before)
    shared = lambda c: min(c[0] + c[1], start + len(candidate)) - max(c[0], start)
    best = max(candidates(text), key=shared, default=None)
    if best is None or shared(best) <= 0:
        return candidate, before, after
    at, n, _ = best
    return text[at : at + n], text[max(at - NEAR, 0) : at], text[at + n : at + n + NEAR]


def train(findings: DataFrame, words: frozenset[str] = frozenset(), limit: int = FINDINGS) -> tuple[RandomForestClassificationModel | None, Transitions, float]:
    """The forest (None without findings of both labels), the pair model, and the share of true findings (0.5 without any)."""
    texts_ = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("before", "after", "path")]
    rows = findings.where(F.col("candidate").isNotNull() & F.col("label").isNotNull()).select("candidate", *texts_, (F.col("label") > 0).alias("label"))
    rows = rows.orderBy(F.xxhash64("candidate", "before", "after", "path", F.lit(SEED)), "candidate", "before", "after", "path", "label").limit(limit).collect()
    cut = [(*as_scanned(r["candidate"], r["before"], r["after"]), r["path"], r["label"]) for r in rows]
    transitions = Transitions([c for c, *_, label in cut if not label])
    share = sum(label for *_, label in cut) / len(cut) if cut else 0.5
    if share in (0.0, 1.0) or not cut:
        return None, transitions, share
    told = findings.sparkSession.createDataFrame([(float(label), measures(c, before, after, path, transitions, words)) for c, before, after, path, label in cut], "label double, f array<double>")
    forest = RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, minInstancesPerNode=3, seed=SEED).fit(told.select("label", array_to_vector("f").alias("features")))
    return forest, transitions, share


def scan_secrets(docs: DataFrame, findings: DataFrame, scratch: Scratch, path_col: str = "source", threshold: float = 0.5) -> DataFrame:
    """doc_id, kind, start (code points), length, secret (the string), score: the findings that the forest keeps."""
    words = dictionary(docs, scratch)
    forest, transitions, share = train(findings, words)
    known = docs.sparkSession.sparkContext.broadcast((transitions, words))  # WORDS words and the pairs of characters of at most FINDINGS candidates

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        transitions, words = known.value
        for batch in slices(batches, "text"):
            rows = []
            for doc, path, text in zip(column(batch, "doc_id").to_pylist(), texts(batch, "path"), texts(batch, "text")):
                for start, n, kind in candidates(text):
                    found = text[start : start + n]
                    rows.append((doc, kind, start, n, found, measures(found, text[max(start - NEAR, 0) : start], text[start + n : start + n + NEAR], path, transitions, words)))
            if rows:
                kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], ["doc_id", "kind", "start", "length", "secret", "f"])

    source = docs.select(F.col("doc_id").cast("long"), F.col(path_col).cast("string").alias("path"), "text")
    found = source.mapInArrow(run, "doc_id long, kind string, start long, length long, secret string, f array<double>")
    if forest is None:
        scored = found.withColumn("score", F.lit(float(share)))
    else:
        scored = forest.transform(found.withColumn("features", array_to_vector("f"))).withColumn("score", vector_to_array("probability")[1])
    return scored.where(F.col("score") >= threshold).select("doc_id", "kind", "start", "length", "secret", "score")


def op1_secret_forest(spark, sf_dir: str) -> DataFrame:
    return scan_secrets(spark.read.parquet(f"{sf_dir}/documents.parquet"), made_findings(spark), Scratch(spark, "secrets"))
