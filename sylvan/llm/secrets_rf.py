"""Secret scans with a random forest that removes false positives.

One pass over the texts finds candidates (runs of 16 or more characters that
keys are written in, with a digit, mixed case or a cue before them; values
of 6 or more after a cue, an assignment or in a URL's credentials, signs
included) and counts the corpus's short words. The words give a dictionary and a model
of character transitions. A forest over length, character classes and
transitions, dictionary coverage, path and neighbouring words, trained from
labelled findings, then judges every candidate.
"""

from __future__ import annotations

import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import Shared, lean, ready_python, stage

SHORTEST = 16
SHARE = 100_000  # a dictionary word is at least one in so many counted words, so there are no more than these
LABELLED = 20_000  # distinct documents, at most, that give labelled findings
FINDINGS = 200_000  # labelled findings, at most, that the forest is fitted on

_RUN = re.compile(rb"[A-Za-z0-9+/_=.~-]{%d,}" % SHORTEST)
_CUE = re.compile(rb"(?i)(token|secret|passw(?:or)?d|pwd|api[_-]?key|access[_-]?key|auth|credential|bearer|private)\W{0,12}$")
_ASSIGN = re.compile(rb"[=:]\s*[\"']?$")
_LED = (  # what leads to shorter values
    re.compile(rb"://[^\s/:@\"'<>]*:([^\s/\"'<>]{6,})@"),
    re.compile(rb"(?i)(?:token|secret|passw(?:or)?d|pwd|api[_-]?key|access[_-]?key|auth|credential|bearer|private)\W{1,12}([^\s\"'`<>]{6,})"),
    re.compile(rb"[=:]\s*[\"']?([^\s\"'`<>=:][^\s\"'`<>]{5,})"),
)
_SIGNED = re.compile(rb"[0-9!@#$%^&*?]|[a-z][A-Z]")
_HEAD = re.compile(rb"^[A-Za-z_][A-Za-z_-]{1,24}[=]+(?=.{8})")
_DUMMY = re.compile(rb"(?i)example|sample|dummy|changeme|placeholder|your[_-]|xxxx|0000000|1234567|abcdefg")
_TEST_PATH = re.compile(r"(?i)(^|[/_.-])(tests?|examples?|docs?|fixtures?|mocks?|samples?)([/_.-]|$)")
#: Formats whose issuers fix them: findings by these are labelled as secrets.
FORMATS = (
    re.compile(rb"AKIA[0-9A-Z]{16}"),
    re.compile(rb"gh[pousr]_[A-Za-z0-9]{36}"),
    re.compile(rb"xox[baprs]-[A-Za-z0-9-]{10,}"),
    re.compile(rb"AIza[0-9A-Za-z_-]{35}"),
    re.compile(rb"sk-[A-Za-z0-9]{20,}"),
)
FEATURES = ("length", "digits", "uppers", "lowers", "signs", "changes", "transitions", "entropy", "distinct", "coverage", "test_path", "cue", "assigned", "dummy", "wordy_before", "wordy_after")
ROWS = "doc_id long, path string, key long, start long, value binary, before binary, after binary, word string, n long"
FOUND = "doc_id long, path string, start long, value binary, before binary, after binary, features array<double>"


def candidates(text: bytes):
    """(start, value, before, after) of each candidate; bytes throughout."""
    seen = []
    for x in _runs(text):
        seen.append((x[0], x[0] + len(x[1])))
        yield x
    for led in _LED:
        spans, at, add = sorted(seen), 0, []
        for m in led.finditer(text):
            start, value = m.start(1), m[1] if led is _LED[0] else m[1].rstrip(b".,;:)]}")
            end = start + len(value)
            while at < len(spans) and spans[at][1] <= start:
                at += 1
            if len(value) < 6 or not _SIGNED.search(value) or value.startswith(b"//") or (at < len(spans) and spans[at][0] < end):
                continue
            add.append((start, end))
            yield start, value, text[max(0, start - 48) : start], text[end : end + 48]
        seen += add


def _runs(text: bytes):
    """Candidates by their own length."""
    at = 0
    for w in text.split():
        if len(w) < SHORTEST:
            continue
        at = text.find(w, at)
        for m in _RUN.finditer(w):
            value, start = m[0].rstrip(b"."), at + m.start()
            head = _HEAD.match(value)
            if head:
                value, start = value[head.end() :], start + head.end()
            before = text[max(0, start - 48) : start]
            if len(value) < 8 or (len(value) < SHORTEST and not head):
                continue
            if any(c in b"0123456789" for c in value) or re.search(rb"[a-z][A-Z]", value) or _CUE.search(before):
                yield start, value, before, text[start + len(value) : start + len(value) + 48]
        at += len(w)


def scan(spark: SparkSession, df: DataFrame, id_col: str, text_col: str, path_col: str) -> DataFrame:
    """Staged rows of two kinds: candidates, and counts of words of 3 to 8
    letters by task (word not null)."""
    ready_python(spark)

    def run(batches):
        words: Counter[bytes] = Counter()
        for batch in batches:
            rows = []
            for i, p, k, t in zip(*(batch[c].to_pylist() for c in ("doc_id", "path", "key")), batch["text"].cast(pa.binary())):
                text = t.as_py() or b""
                words.update(text.lower().split())
                rows += [(i, p, k, *c) for c in candidates(text)]
            if len(words) > 400_000:
                yield counts(words)
                words.clear()
            yield batch_of([(*r, None, None) for r in rows])
        yield counts(words)

    def counts(words):
        return batch_of([(None, None, None, None, None, None, None, w.decode(), n) for w, n in words.items() if 3 <= len(w) <= 8 and w.isalpha()])

    def batch_of(rows):
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.string(), pa.int64()]
        names = ["doc_id", "path", "key", "start", "value", "before", "after", "word", "n"]
        return pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], k) for j, k in enumerate(kinds)], names)

    return stage(spark, _named(df, id_col, text_col, path_col).mapInArrow(lean(run), ROWS), "candidates")


def _named(df: DataFrame, id_col: str, text_col: str, path_col: str) -> DataFrame:
    """doc_id, path, text, and a hash of id and text: equal documents share it."""
    docs = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(path_col).cast("string").alias("path"), F.col(text_col).cast("string").alias("text"))
    return docs.withColumn("key", F.xxhash64("doc_id", "text"))


def _kind(c: int) -> int:
    return c - 97 if 97 <= c <= 122 else c - 65 if 65 <= c <= 90 else 26 if 48 <= c <= 57 else 27


class Language:
    """A dictionary and character transitions from counted words."""

    def __init__(self, counted: list[tuple[str, int]]):
        self.words = {w.encode() for w, _ in counted}
        table = np.ones((28, 28))
        for w, n in counted:
            b = w.encode()
            for x, y in zip(b, b[1:]):
                table[_kind(x), _kind(y)] += n
        self.log = np.log(table / table.sum(axis=1, keepdims=True))

    def coverage(self, value: bytes) -> float:
        """Share of characters that dictionary words cover, longest first."""
        low, at, hit = value.lower(), 0, 0
        while at < len(low):
            for size in range(8, 2, -1):
                if low[at : at + size] in self.words:
                    hit, at = hit + size, at + size
                    break
            else:
                at += 1
        return hit / len(value)

    def features(self, path: str | None, value: bytes, before: bytes, after: bytes) -> list[float]:
        n = len(value)
        kinds = [0 if 48 <= c <= 57 else 1 if 65 <= c <= 90 else 2 if 97 <= c <= 122 else 3 for c in value]
        share = [kinds.count(k) / n for k in range(4)]
        codes = [_kind(c) for c in value]
        wordy = lambda text, side: float(any(w.strip(b".,;").lower() in self.words for w in side(text.split())))
        return [
            float(n), *share,
            sum(a != b for a, b in zip(kinds, kinds[1:])) / max(1, n - 1),
            float(np.mean([self.log[a, b] for a, b in zip(codes, codes[1:])])) if n > 1 else 0.0,
            -sum(k / n * math.log2(k / n) for k in Counter(value).values()),
            len(set(value)) / n,
            self.coverage(value),
            float(bool(_TEST_PATH.search(path or ""))),
            float(bool(_CUE.search(before))),
            float(bool(_ASSIGN.search(before))),
            float(bool(_DUMMY.search(value))),
            wordy(before, lambda x: x[-2:]),
            wordy(after, lambda x: x[:2]),
        ]


def label(value: bytes, before: bytes) -> float | None:
    """1 for formats fixed by their issuers and for random strings assigned
    to a cue word; 0 for numbers, dummies and dotted names; else unknown."""
    if _DUMMY.search(value):
        return 0.0
    if any(f.fullmatch(value) for f in FORMATS):
        return 1.0
    if value.isdigit() or re.fullmatch(rb"[A-Za-z]+([._/-][A-Za-z]+)*", value):
        return 0.0
    if _CUE.search(before) and _ASSIGN.search(before) and len(set(value)) >= 8:
        return 1.0
    return None


def made_up(seed: int, words: list[bytes]) -> list[tuple[bytes, bytes, bytes, float]]:
    """Labelled findings (value, before, after, label) made for a document:
    random keys, and identifiers joined from its own words."""
    rng = random.Random(seed)
    near = lambda: b" ".join(rng.choices(words or [b"the"], k=3))
    alphabet = rng.choice([b"0123456789abcdef", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/"])
    key = bytes(rng.choices(alphabet, k=rng.choice([18, 20, 24, 32, 40, 64])))
    cue = rng.choice([b' token = "', b" password=", b" api_key: ", b" ", b" ", b" secret = "])
    plain = [w for w in (words or [b"thing"]) if w.isalpha()] or [b"thing"]
    name = rng.choice([b"_", b"-", b".", b"/"]).join(rng.choices(plain, k=rng.randint(3, 6))) + str(rng.randint(1, 2030)).encode()
    number = bytes(rng.choices(b"0123456789", k=rng.choice([16, 18, 20])))
    found = [(key, near() + cue, b" " + near(), 1.0), (name, near() + rng.choice([b" ", b" ", b" token = "]), b" " + near(), 0.0), (number, near() + b" ", b" " + near(), 0.0)]
    letters = b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789" + rng.choice([b"", b"!#$%&*?@^-_"])
    short = bytes(rng.choices(letters, k=rng.randint(8, 16)))
    led = rng.choice([b' password = "', b" password: ", b" pwd=", b" secret: ", b" postgres://" + rng.choice(plain) + b":", b" https://" + rng.choice(plain) + b":"])
    word = rng.choice(plain) + rng.choice([b"1", b"2019", b"!", b"?", b"@" + rng.choice(plain) + b".org", b"&" + rng.choice(plain)])
    brief = bytes(rng.choices(b"0123456789", k=rng.randint(6, 12)))
    lead = lambda: rng.choice([b" ", b": ", b" = ", b"=", b" token ", b" password: "])
    return [*found, (short, near() + led, b" " + near(), 1.0), (word, near() + lead(), b" " + near(), 0.0), (brief, near() + lead(), b" " + near(), 0.0)]


def find_secrets(spark: SparkSession, df: DataFrame, id_col: str = "doc_id", text_col: str = "text", path_col: str = "source", labelled: DataFrame | None = None, threshold: float = 0.5, trees: int = 40, depth: int = 8) -> DataFrame:
    """doc_id, start (byte offset), length, preview (first four characters)
    and probability of every candidate that the forest takes for a secret.

    ``labelled`` (path, value, before, after, label) are labelled findings;
    without it they come from ``label`` and ``made_up`` over the LABELLED
    distinct documents (by id and text) of least hash. The forest is fitted
    on the FINDINGS of least hash. A null text has no candidates; null ids
    and paths are kept; repeated rows report each. An empty table gives no
    rows. Only the three named columns are read.
    """
    rows = scan(spark, df, id_col, text_col, path_col)
    words = rows.where("word IS NOT NULL").groupBy("word").agg(F.sum("n").alias("n"))
    total = rows.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    counted = words.where(F.col("n") * SHARE >= F.lit(total)).orderBy("word").collect()
    language = Shared(spark, Language([(r.word, r.n) for r in counted]))
    found = rows.where("value IS NOT NULL")

    def featured(batches):
        for batch in batches:
            x = [language.value.features(p, v, b, a) for p, v, b, a in zip(*(batch[c].to_pylist() for c in ("path", "value", "before", "after")))]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(x, pa.list_(pa.float64()))], [*batch.schema.names, "features"])

    base = ["doc_id", "path", "start", "value", "before", "after"]
    scored = found.select(*base).mapInArrow(lean(featured), FOUND)
    if labelled is None:
        labelled = _labelled(spark, df, found, id_col, text_col, path_col)
    some = labelled.select(F.lit(0).cast("long").alias("doc_id"), F.col("path").cast("string").alias("path"), F.col("label").cast("long").alias("start"), "value", "before", "after")
    some = some.withColumn("place", F.xxhash64("path", "start", "value", "before", "after")).orderBy("place", "value", "before", "after").limit(FINDINGS).drop("place")
    train = stage(spark, some.mapInArrow(lean(featured), FOUND).select(F.col("start").cast("double").alias("label"), "features").coalesce(1), "labelled")
    if train.select("label").distinct().count() < 2:  # nothing to tell apart
        return scored.where("false").select("doc_id", "start", F.lit(0).cast("long").alias("length"), F.lit("").alias("preview"), F.lit(0.0).alias("probability"))
    model = _fit(train, trees, depth)
    judged = model.transform(scored.withColumn("features", array_to_vector("features")))
    return (
        judged.withColumn("probability", F.round(vector_to_array("probability")[1], 6))
        .where(F.col("probability") >= threshold)
        .select("doc_id", "start", F.length("value").cast("long").alias("length"), F.concat(F.substring(F.decode("value", "utf-8"), 1, 4), F.lit("...")).alias("preview"), "probability")
    )


def _fit(train: DataFrame, trees: int, depth: int) -> RandomForestClassificationModel:
    return RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=7).fit(train.withColumn("features", array_to_vector("features")))


def _labelled(spark: SparkSession, df: DataFrame, found: DataFrame, id_col: str, text_col: str, path_col: str) -> DataFrame:
    """Labelled findings of the LABELLED distinct documents of least hash."""
    docs = _named(df, id_col, text_col, path_col)
    n = docs.agg(F.approx_count_distinct("key")).first()[0]
    # most of the keys are left out by their share, the rest are counted
    bound = min((1 << 63) - 1, -(1 << 63) + (1 << 64) * 2 * LABELLED // max(n, 1))
    least = docs.where(F.col("key") <= F.lit(bound)).select("key").distinct().orderBy("key").limit(LABELLED)
    last = least.agg(F.max("key")).first()[0]
    chosen = F.col("key") <= F.lit(last if last is not None else -(1 << 63))
    sample = docs.where(chosen).dropDuplicates(["key"])
    schema = "path string, value binary, before binary, after binary, label double"
    kinds = [pa.string(), pa.binary(), pa.binary(), pa.binary(), pa.float64()]
    names = ["path", "value", "before", "after", "label"]
    batch_of = lambda rows: pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], k) for j, k in enumerate(kinds)], names)

    def imagined(batches):
        for batch in batches:
            rows = []
            for i, p, t in zip(*(batch[c].to_pylist() for c in ("doc_id", "path", "text"))):
                rows += [(p, *x) for x in made_up(i or 0, (t or "").encode().split())]
            yield batch_of(rows)

    def known(batches):
        for batch in batches:
            rows = []
            for p, v, b, a in zip(*(batch[c].to_pylist() for c in ("path", "value", "before", "after"))):
                y = label(v, b)
                if y is not None:
                    rows.append((p, v, b, a, y))
            yield batch_of(rows)

    picked = found.where(chosen).select("key", "start", "path", "value", "before", "after").dropDuplicates(["key", "start", "value"])
    return sample.select("doc_id", "path", "text").mapInArrow(imagined, schema).union(picked.select("path", "value", "before", "after").mapInArrow(known, schema))
