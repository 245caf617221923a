"""Op 10 — secret scans: fixed patterns, and Markov models for the rest.

Two character Markov models, one of random strings and one of ordinary
identifiers, are trained from labelled strings.  A run of credential
characters is cut where fixed patterns cover it, and each uncovered stretch
of 16 or more is reported as ``markov`` when its log-likelihood ratio (random
over ordinary) passes ``LOG_ODDS``.

Labelled strings: random are the values that the fixed patterns find in
``SAMPLE_DOCS`` sampled documents, and strings drawn from credential
alphabets; ordinary are other runs in those documents that are made of words
(see :func:`is_wordy`); what is neither has no label.  At most
``SAMPLE_RUNS`` runs reach the driver.  Scanning itself is one narrow pass
over whole texts; only spans leave the function.

Edge cases: null text counts as empty (no spans); ids may be null or repeat,
each row is scanned on its own; an empty table gives an empty result and is
scanned by models of drawn strings alone; other columns are ignored.
Positions are code points, ends exclusive.
"""

from __future__ import annotations

import random
import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Fixed patterns and least lengths, in the order in which kinds are listed.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
                    re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")  # runs are maximal, so this is [0-9a-f]+ with 24 characters or more
KINDS = ("assign", "access", "hex", "markov")

RUN = re.compile(r"[A-Za-z0-9+/_=-]{16,}")
SHORT_RUN = re.compile(r"[A-Za-z0-9+/_=-]{4,64}")
SEGMENT = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")
LEAST_DISTINCT = 8
#: One random string is expected in a million runs.
LOG_ODDS = float(np.log(1e6))
SAMPLE_DOCS = 2000
SAMPLE_RUNS = 40_000
SYMBOLS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
#: Alphabets of drawn random strings: letters and digits, base64, hex, upper case and digits, URL-safe.
DRAWN = (SYMBOLS[:62], SYMBOLS[:64], SYMBOLS[52:62] + "abcdef", SYMBOLS[:26] + SYMBOLS[52:62], SYMBOLS[:62] + "_-")

_CODE = np.full(256, len(SYMBOLS), np.int64)
_CODE[[ord(c) for c in SYMBOLS]] = range(len(SYMBOLS))

SPANS = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()),
                                  T.StructField("end", T.LongType())]))


def base_spans(text: str) -> list[tuple[int, int, int, int]]:
    """``(start, kind index, end, start of the value)`` of the fixed patterns."""
    out = []
    if ":" in text or "=" in text:
        out += [(m.start(), 0, m.end(), m.start(2)) for m in ASSIGN.finditer(text) if m.end() - m.start(2) >= 6]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end(), m.start()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [(m.start(), 2, m.end(), m.start()) for m in HEX.finditer(text)]
    return out


def is_wordy(run: str) -> bool:
    """Whether a run falls into words, capitals and numbers of three
    characters on average, as identifiers do and random strings do not."""
    segments = SEGMENT.findall(run)
    return sum(map(len, segments)) >= 3 * max(1, len(segments))


def codes(run: str) -> np.ndarray:
    return _CODE[np.frombuffer(run.encode("ascii"), np.uint8)]


class RandomnessModel:
    """Log-likelihood ratio of two first-order character chains, with additive
    smoothing; ``ratio[a, b]`` is that of ``b`` after ``a``, the last row that
    of a first character."""

    def __init__(self, ratio: np.ndarray):
        self.ratio = ratio

    @classmethod
    def train(cls, strings: list[str], is_random: list[bool], smoothing: float = 0.5) -> RandomnessModel:
        n = len(SYMBOLS)
        counts = np.full((2, n + 1, n + 1), smoothing)
        for s, r in zip(strings, is_random):
            c = codes(s)
            np.add.at(counts[int(r)], (np.concatenate(([n], c[:-1])), c), 1)
        log_p = np.log(counts[:, :, :n]) - np.log(counts[:, :, :n].sum(axis=2, keepdims=True))
        return cls(log_p[1] - log_p[0])

    def score(self, run: str) -> float:
        c = codes(run)
        return float(self.ratio[-1, c[0]] + self.ratio[c[:-1], c[1:]].sum())


def drawn_strings(n: int = 4000, seed: int = 5) -> list[str]:
    rng = random.Random(seed)
    return ["".join(rng.choices(DRAWN[k % len(DRAWN)], k=rng.randint(16, 64))) for k in range(n)]


def labelled_runs(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``run, is_random``: at most ``SAMPLE_RUNS`` labelled runs of the
    documents whose ids are first in hash order."""
    ids = df.select(F.col(id_col).alias("id")).distinct().orderBy(F.xxhash64("id"), "id").limit(SAMPLE_DOCS)
    docs = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).dropna()
    sampled = docs.join(F.broadcast(ids), "id", "left_semi").select("text")  # SAMPLE_DOCS ids

    def runs(frames):
        for frame in frames:
            found = set()
            for text in frame["text"]:
                spans = base_spans(text)
                found |= {(v[-64:], True) for _, k, e, at in spans if SHORT_RUN.fullmatch(v := text[at:e][:64])}
                covered = [(s, e) for s, _, e, _ in spans]
                found |= {(m[0], False) for m in SHORT_RUN.finditer(text)
                          if is_wordy(m[0]) and not any(s < m.end() and m.start() < e for s, e in covered)}
            yield pd.DataFrame(sorted(found), columns=["run", "is_random"])

    return (sampled.mapInPandas(runs, "run string, is_random boolean").distinct()
            .orderBy(F.desc("is_random"), F.xxhash64("run"), "run").limit(SAMPLE_RUNS))


def fit(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> RandomnessModel:
    """The models from labelled runs of ``df`` and drawn random strings."""
    found = labelled_runs(df, id_col, text_col).collect()
    drawn = drawn_strings()
    return RandomnessModel.train([*drawn, *(r.run for r in found)], [*[True] * len(drawn), *(r.is_random for r in found)])


def all_spans(text: str, model: RandomnessModel) -> list[tuple[int, int, int]]:
    """``(start, kind index, end)`` by start, then kind."""
    base = sorted(x[:3] for x in base_spans(text))
    more, at = [], 0
    for start, _, end in [*base, (len(text), 0, 0)]:
        if start > at:  # what lies between the spans
            more += [(m.start(), 3, m.end()) for m in RUN.finditer(text, at, start)
                     if len(set(m[0])) >= LEAST_DISTINCT and model.score(m[0]) > LOG_ODDS]
        at = max(at, end)
    return sorted(base + more)


def scan(df: DataFrame, model: RandomnessModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, spans`` of every row."""
    rows = df.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    @F.pandas_udf(SPANS)
    def spans(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: [{"kind": KINDS[k], "start": s, "end": e} for s, k, e in all_spans(t, model)])

    return rows.select(F.col("id").alias(id_col), spans("text").alias("spans"))


def redact(df: DataFrame, model: RandomnessModel, text_col: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """``df`` with every span of its texts replaced by ``mark``; other rows,
    null texts included, stay as they are."""
    @F.pandas_udf(T.StringType())
    def cleaned(texts: pd.Series) -> pd.Series:
        def one(text):
            if text is None:
                return None
            out, at = [], 0
            for start, _, end in all_spans(text, model):
                if start >= at:
                    out += [text[at:start], mark]
                at = max(at, end)
            return "".join(out) + text[at:]

        return texts.map(one)

    return df.withColumn(text_col, cleaned(F.col(f"`{text_col}`")))


def digests(scanned: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Counts per kind, and the spans as text: all, and those of the fixed patterns hashed."""
    def listed(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    def of(kind):
        return F.filter("spans", lambda s: s["kind"] == kind)

    return scanned.select(
        id_col, *[F.size(of(k)).cast("long").alias(f"n_{k}") for k in KINDS[:3]],
        F.sha2(listed(F.filter("spans", lambda s: s["kind"] != "markov")), 256).alias("base_sha256"),
        listed(F.col("spans")).alias("spans"))
