"""Secret scans: a battery of randomness tests with false-discovery control.

Candidates are runs of 16 or more characters of the alphabets that keys are
written in; "=" ends one, as between a name and its value, and belongs to it only
as padding at the end.  Each is decoded by its inferred encoding to symbols, and
tested for a uniform alphabet (chi-squared; an alphabet is in the order of how
frequent its letters are, so that natural text crowds into few bins), for runs
above and below the median, and for serial correlation; Fisher's method joins the
three to one score of randomness.

How random natural text looks by the same battery depends on length and
encoding.  It is simulated: letters from the letter pairs of the whole corpus,
put together as identifiers are, from words with capitals, digits at their ends,
and, by encoding, slashes, dashes or underscores between them, at rates that
differ from string to string.  A candidate's p-value is the share of such strings
that look at least as random.  Below the lowest hundredth of them a power of
Fisher's statistic, fitted to it, carries the share on, so that it can be as
small as a corpus needs.  The same is fitted to the corpus's own candidates that
don't look random, and the larger share of the two counts.  Benjamini-Hochberg
within each stratum of encoding and length controls the share of false
discoveries.  Short candidates of natural shape can't reach it.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from meridian.llm.text import type_of
from meridian.plans.materialize import materialize

SHORTEST = 16
LENGTHS = (16, 20, 24, 28, 32, 36, 40, 44, 48, 56, 64, 80, 96, 128)
FALSE_DISCOVERIES = 0.01
#: Simulated natural strings for each encoding and length, and how many are held at once.
SIMULATED, HELD = 20_000, 5_000
#: Shares of the simulated strings and of the corpus's that the tail is fitted to, and the steepest power that is carried on.
TAIL, LEARNT, STEEPEST = 0.01, 0.05, 30.0
#: Of Fisher's statistic of random strings (chi-squared, 6 degrees): the median, below which nothing is more of a secret, and what one in a thousand exceeds.
MEDIAN, RARE = 5.3481, 22.4577
#: Width of the corpus's histogram of the statistic, and levels of p-values for each factor of ten.
WIDTH, LEVELS = 0.25, 200
_RUN = re.compile(rb"[A-Za-z0-9+/_\-]{%d,}(?:=++(?![A-Za-z0-9+/_\-]))?" % SHORTEST)
_DIGITS, _LETTERS = b"0123456789", b"etaoinshrdlcumwfgypbvkjxqz"
_ALNUM = _LETTERS + _DIGITS + _LETTERS.upper()
ALPHABETS = {"decimal": _DIGITS, "hex": _DIGITS + b"abcdef", "base32": _LETTERS.upper() + b"234567", "lower": _LETTERS, "lower36": _LETTERS + _DIGITS, "alnum": _ALNUM, "base64": _ALNUM + b"+/", "base64url": _ALNUM + b"-_"}
#: Of the words in natural strings of an encoding, at most the share that has digits at its end, that has a capital or is all capitals; what stands between words.
SHAPES = {"hex": (0, 0, 0, b""), "base32": (0.5, 0, 0, b""), "lower": (0, 0, 0, b""), "lower36": (0.6, 0, 0, b""), "alnum": (0.4, 1, 0.3, b""), "base64": (0.4, 1, 0.3, b"/////////+"), "base64url": (0.4, 1, 0.3, b"-_")}
ENCODINGS = tuple(ALPHABETS)
_PLACE = {name: np.array([a.find(bytes([c])) for c in range(256)], np.int16) for name, a in ALPHABETS.items()}


def infer(run: bytes) -> tuple[str, bytes] | None:
    """The smallest alphabet that holds the run, and the run in it; padding goes, and dashes of grouped digits."""
    body = run.rstrip(b"=").strip(b"-_/+")
    plain = body.replace(b"-", b"").replace(b"_", b"")
    if len(plain) >= SHORTEST:
        for name in ("decimal", "hex"):
            low = plain.lower() if plain.upper() == plain or plain.lower() == plain else plain
            if (_PLACE[name][np.frombuffer(low, np.uint8)] >= 0).all():
                return name, low
    if len(body) < SHORTEST or b"=" in body:
        return None
    codes = np.frombuffer(body, np.uint8)
    return next(((name, body) for name in ENCODINGS[2:] if (_PLACE[name][codes] >= 0).all()), None)


def _normal_tail(z: np.ndarray) -> np.ndarray:
    """Two-sided tail of the standard normal, by Abramowitz and Stegun 7.1.26."""
    x = np.abs(z) / np.sqrt(2)
    t = 1 / (1 + 0.3275911 * x)
    return np.clip(t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429)))) * np.exp(-x * x), 1e-16, 1)


def _chi_tail(x: np.ndarray, df: float) -> np.ndarray:
    """Upper tail of chi-squared, by Wilson and Hilferty."""
    z = ((np.maximum(x, 1e-12) / df) ** (1 / 3) - (1 - 2 / (9 * df))) / np.sqrt(2 / (9 * df))
    half = _normal_tail(z) / 2
    return np.clip(np.where(z > 0, half, 1 - half), 1e-16, 1)


def battery(symbols: np.ndarray, alphabet: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """p-values of uniformity, runs and serial correlation, and of the three jointly, for rows of equal length."""
    m, n = symbols.shape
    bins = max(2, min(alphabet, n // 4))
    binned = symbols.astype(np.int64) * bins // alphabet
    counts = np.bincount((binned + np.arange(m)[:, None] * bins).ravel(), minlength=m * bins).reshape(m, bins)
    sizes = np.bincount(np.arange(alphabet) * bins // alphabet, minlength=bins) / alphabet * n
    uniform = _chi_tail(((counts - sizes) ** 2 / sizes).sum(axis=1), bins - 1)
    high = symbols >= alphabet / 2
    above = high.sum(axis=1)
    below = n - above
    runs = 1 + (high[:, 1:] != high[:, :-1]).sum(axis=1)
    mean = 1 + 2 * above * below / n
    spread = np.sqrt(np.maximum((mean - 1) * (mean - 2) / (n - 1), 1e-9))
    steady = (above == 0) | (below == 0)
    run = np.where(steady, 2.0 ** (1 - n), _normal_tail((runs - mean) / spread))
    x = symbols - symbols.mean(axis=1, keepdims=True)
    power = (x * x).sum(axis=1)
    serial = np.where(power > 0, _normal_tail(((x[:, 1:] * x[:, :-1]).sum(axis=1) / np.maximum(power, 1e-9) + 1 / n) * np.sqrt(n)), 1e-16)
    joint = _chi_tail(-2 * (np.log(np.maximum(uniform, 1e-16)) + np.log(np.maximum(run, 1e-16)) + np.log(np.maximum(serial, 1e-16))), 6)
    return uniform, run, serial, joint


def stratum(length: int) -> int:
    """The longest of LENGTHS that isn't longer."""
    return max((x for x in LENGTHS if x <= length), default=LENGTHS[0])


def _letters(pairs: np.ndarray, allowed: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Strings of the allowed letters by the chain of letter pairs: HELD rows of the greatest length."""
    counts = pairs[np.ix_(allowed, allowed)] + 0.01
    start, step = np.cumsum(counts.sum(axis=1) / counts.sum()), np.cumsum(counts / counts.sum(axis=1, keepdims=True), axis=1)
    last, letters = allowed.size - 1, np.empty((HELD, LENGTHS[-1]), np.int64)
    letters[:, 0] = np.minimum(np.searchsorted(start, rng.random(HELD)), last)
    for k in range(1, LENGTHS[-1]):
        letters[:, k] = np.minimum((step[letters[:, k - 1]] < rng.random(HELD)[:, None]).sum(axis=1), last)
    return allowed[letters]


def natural_strings(pairs: np.ndarray, name: str, rng: np.random.Generator) -> np.ndarray:
    """Bytes (HELD x the greatest length) of strings as people write them in an encoding's alphabet."""
    upper = name == "base32"
    allowed = np.array([k for k in range(26) if bytes([(65 if upper else 97) + k]) in ALPHABETS[name]], np.int64)
    out = _letters(pairs, allowed, rng) + (65 if upper else 97)
    digits, capitals, shouted, marks = SHAPES[name]
    n = LENGTHS[-1]
    ends = np.cumsum(rng.integers(3, 11, (HELD, n // 3 + 1)), axis=1)  # words of 3 to 10 letters
    rows = np.arange(HELD)[:, None]
    starts = np.zeros((HELD, n + 16), np.int64)
    np.put_along_axis(starts, np.minimum(ends, n + 15), 1, axis=1)
    word = np.cumsum(starts, axis=1)[:, :n]
    at = np.arange(n) - np.maximum.accumulate(np.where(starts[:, :n] == 1, np.arange(n), 0), axis=1)
    chance = lambda most: rng.random((HELD, n + 1))[rows, word] < most * rng.random((HELD, 1))
    left = np.concatenate([np.zeros((HELD, 1), np.int64), ends], axis=1)
    left = left[rows, np.minimum(word + 1, left.shape[1] - 1)] - np.arange(n)  # to the word's end
    if marks:
        sign = rng.choice(np.frombuffer(marks, np.uint8), (HELD, 1)) if name == "base64url" else rng.choice(np.frombuffer(marks, np.uint8), (HELD, n))
        marked = (at == 0) & (word > 0) & (rng.random((HELD, n + 1))[rows, word] < 0.2 + 0.8 * rng.random((HELD, 1)))
    if capitals:
        # a word's first letter stands behind the mark, if there is one
        first = at == (np.maximum.accumulate(np.where(marked, np.arange(n), -1), axis=1) == np.arange(n) - at) if marks else at == 0
        out = np.where((first & chance(capitals)) | chance(shouted), out - 32, out)
    if digits:
        low, many = (50, 6) if upper else (48, 10)
        out = np.where(chance(digits) & (left <= rng.integers(1, 5, (HELD, n + 1))[rows, word]), rng.integers(low, low + many, (HELD, n)), out)
    return np.where(marked, sign, out) if marks else out


def fisher(uniform: np.ndarray, run: np.ndarray, serial: np.ndarray) -> np.ndarray:
    """Fisher's statistic of the three p-values; the smaller, the more random."""
    return -2 * sum(np.log(np.maximum(p, 1e-16)) for p in (uniform, run, serial))


def _power(u: float, c: float, logs: np.ndarray, weights: np.ndarray) -> float:
    """The power a of a share (x / u) ** a, from the logarithms of u / x of what lies between c and u."""
    mean, span = float((logs * weights).sum() / weights.sum()), np.log(u / c) if c else np.inf
    low, high = 1e-3, STEEPEST
    for _ in range(60):
        a = (low + high) / 2
        low, high = (a, high) if 1 / a - (span / np.expm1(min(a * span, 700)) if c else 0) > mean else (low, a)
    return (low + high) / 2


class Shares:
    """The share of natural strings that look at least as random as a statistic x: of simulated ones, or of the corpus's if that is larger."""

    def __init__(self, simulated: np.ndarray):
        self.own = np.sort(simulated)
        k = int(TAIL * self.own.size)
        low = np.maximum(self.own[:k], 1e-9)
        self.below = [(float(low[-1]), k / (1 + self.own.size), _power(low[-1], 0, np.log(low[-1] / low), np.ones(k)))]

    def learn(self, counts: np.ndarray) -> None:
        """From the corpus's counts by WIDTH; the candidates that look random are taken out by their known distribution."""
        edges = np.arange(counts.size + 1) * WIDTH
        above = np.exp(-edges / 2) * (1 + edges / 2 + edges**2 / 8)
        random = 2 * counts[: int(MEDIAN / WIDTH)].sum()
        rest = np.where(edges[:-1] > RARE, np.maximum(counts - 1.5 * random * (above[:-1] - above[1:]), 0), 0)
        total = rest.sum()
        last = int(np.searchsorted(np.cumsum(rest), max(20, LEARNT * total)))
        if total < 100 or last >= counts.size:
            return
        c, u, some = float(edges[int(RARE / WIDTH) + 1]), float(edges[last + 1]), rest[: last + 1]
        if u - c < 2 * WIDTH:
            u, some = c + 2 * WIDTH, rest[: int(RARE / WIDTH) + 3]
        if not some.sum():
            return
        a = _power(u, c, np.log(u / np.maximum(edges[: some.size] + WIDTH / 2, WIDTH / 2)), some)
        self.below.append((u, float(min(1, some.sum() / total / -np.expm1(-a * np.log(u / c)))), a))

    def __call__(self, x: float) -> float:
        x = max(x, MEDIAN)
        (u, share, a), *corpus = self.below
        p = share * (x / u) ** a if x < u else float(np.searchsorted(self.own, x, "right") + 1) / (1 + self.own.size)
        p = max([p, *(share * min(1, x / u) ** a for u, share, a in corpus)])
        return float(min(1, 10 ** (np.ceil(LEVELS * np.log10(max(p, 1e-30))) / LEVELS)))


def simulate(pairs: np.ndarray, seed: int = 1) -> dict[str, dict[int, np.ndarray]]:
    """Fisher's statistics of natural strings by encoding and length, from counts (26 x 26) of letter pairs."""
    rng, out = np.random.default_rng(seed), {"decimal": {n: np.zeros(SIMULATED) for n in LENGTHS}}
    for name in ENCODINGS[1:]:
        parts = []
        for _ in range(SIMULATED // HELD):
            symbols = _PLACE[name][natural_strings(pairs, name, rng)]
            parts.append({n: fisher(*battery(symbols[:, :n], len(ALPHABETS[name]))[:3]) for n in LENGTHS})
        out[name] = {n: np.concatenate([p[n] for p in parts]) for n in LENGTHS}
    return out


def _continues(char: str) -> bool:
    """Whether a character beyond ASCII, beside a run, belongs to the same word: a Latin letter, a digit, or a mark on the run's letter."""
    kind = unicodedata.category(char)
    name = unicodedata.name(char, "")
    return (kind[0] == "L" and "LATIN" in name) or kind == "Nd" or (kind == "Mn" and "VARIATION SELECTOR" not in name)


def _in_word(raw: bytes, low: int, high: int) -> bool:
    """Whether the run is part of a longer word; marks, quotes, ideographs and other scripts don't continue it."""
    if high < len(raw) and raw[high] >= 128 and _continues(raw[high : high + 4].decode("utf-8", "ignore")[0]):
        return True
    if not low or raw[low - 1] < 128:
        return False
    before = raw[max(0, low - 32) : low].decode("utf-8", "ignore")
    base = before.rstrip("".join(c for c in set(before) if unicodedata.category(c) == "Mn"))  # a mark belongs to the letter before it
    return base[-1:].isascii() and base[-1:].isalnum() or (base[-1:] > "\x7f" and _continues(base[-1]))


def candidates(text: str | None) -> Iterator[tuple[int, bytes, str, bytes]]:
    """(byte offset, run, encoding, body) of the candidates in a text; parts of words in other letters are none."""
    raw = (text or "").encode("utf-8", "replace")
    for match in _RUN.finditer(raw):
        low, high = match.span()
        if _in_word(raw, low, high):
            continue
        found = infer(match[0])
        if found:
            yield low, match[0], *found


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", false_discoveries: float = FALSE_DISCOVERIES, seed: int = 1) -> DataFrame:
    """Every candidate: (doc_id, start, length, encoding, digest, uniform, runs, serial, joint, natural, secret).

    start is the byte offset, digest the first 16 hex digits of SHA-256 (the
    secret itself is not repeated).  uniform, runs, serial and joint are
    p-values under randomness, natural the p-value under natural text; secret
    tells whether it is rejected.  Runs of decimal digits are never secrets:
    numbers can't be told from random ones.  UUIDs and hex digests are random, so
    they are called secrets; nothing tells them from keys.  Runs longer than the
    longest simulated strings are compared with these, which look more random.

    Ids can be of any type.  Nulls: a null or empty text has no candidates; a
    null id is kept.  Very long texts, and runs, are tested whole.  Equal
    p-values are decided alike.
    Repeated rows are reported each.  An empty table gives no rows.  Other
    columns are not read.
    """
    empty, id_kind = pa.nulls, to_arrow_type(docs.schema[id_col].dataType)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        letters = np.full(256, 26, np.int64)
        letters[np.frombuffer(b"abcdefghijklmnopqrstuvwxyz", np.uint8)] = np.arange(26)
        letters[np.frombuffer(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", np.uint8)] = np.arange(26)
        pairs = np.zeros(27 * 27, np.int64)
        names = ["doc_id", "start", "length", "encoding", "digest", "uniform", "runs", "serial", "joint", "stratum", "pair", "n"]
        kinds = [id_kind, pa.int64(), pa.int32(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.float64(), pa.float64(), pa.int32(), pa.int32(), pa.int64()]
        for batch in batches:
            rows = []
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                codes = letters[np.frombuffer((text or "").encode("utf-8", "replace"), np.uint8)]
                pairs += np.bincount(codes[:-1] * 27 + codes[1:], minlength=27 * 27)
                for start, run, name, body in candidates(text):
                    p = battery(_PLACE[name][np.frombuffer(body, np.uint8)][None, :], len(ALPHABETS[name]))
                    rows.append((i, start, len(run), name, hashlib.sha256(run).hexdigest()[:16], *(float(x[0]) for x in p), stratum(len(body)), None, None))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names)
        some = np.flatnonzero(pairs)
        yield pa.RecordBatch.from_arrays([*(empty(some.size, kind) for kind in kinds[:10]), pa.array(some, pa.int32()), pa.array(pairs[some])], names)

    shape = f"doc_id {type_of(docs, id_col)}, start long, length int, encoding string, digest string, uniform double, runs double, serial double, joint double, stratum int, pair int, n long"
    named = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    both = materialize(named.mapInArrow(find, shape), "candidates")
    pairs = np.zeros(27 * 27, np.int64)
    for r in both.where("pair is not null").groupBy("pair").agg(F.sum("n").alias("n")).collect():
        pairs[r["pair"]] = r["n"]
    shares = {name: {n: Shares(x) for n, x in by.items()} for name, by in simulate(pairs.reshape(27, 27)[:26, :26], seed).items()}
    statistic = sum((F.log(F.greatest(F.col(c), F.lit(1e-16))) * -2 for c in ("uniform", "runs", "serial")), F.lit(0.0))
    bins = int(-6 * np.log(1e-16) / WIDTH) + 1
    seen: dict[tuple[str, int], np.ndarray] = {}
    # at most bins rows for each encoding and length
    for r in both.where("pair is null").groupBy("encoding", "stratum", F.least(F.floor(statistic / WIDTH), F.lit(bins - 1)).alias("bin")).agg(F.count("*").alias("n")).collect():
        seen.setdefault((r["encoding"], r["stratum"]), np.zeros(bins, np.int64))[r["bin"]] = r["n"]
    for (name, n), counts in seen.items():
        shares[name][n].learn(counts)
    null = docs.sparkSession.sparkContext.broadcast(shares)  # of fixed size

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = fisher(*(batch.column(c).to_numpy() for c in ("uniform", "runs", "serial")))
            natural = np.array([null.value[name][n](v) for name, n, v in zip(batch.column("encoding").to_pylist(), batch.column("stratum").to_pylist(), x)])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(natural, pa.float64())], [*batch.schema.names, "natural"])

    kept = both.where("pair is null").drop("pair", "n")
    compared = kept.mapInArrow(compare, shape.removesuffix(", pair int, n long") + ", natural double")
    levels = compared.groupBy("encoding", "stratum", "natural").agg(F.count("*").alias("n"))
    order = Window.partitionBy("encoding", "stratum").orderBy("natural")
    ranked = levels.withColumn("rank", F.sum("n").over(order)).withColumn("m", F.sum("n").over(Window.partitionBy("encoding", "stratum")))
    limits = ranked.where(F.col("natural") <= F.lit(false_discoveries) * F.col("rank") / F.col("m")).where("encoding <> 'decimal'").groupBy("encoding", "stratum").agg(F.max("natural").alias("limit"))
    # at most one limit for each encoding and length
    judged = compared.join(F.broadcast(limits), ["encoding", "stratum"], "left")
    return judged.select("doc_id", "start", "length", "encoding", "digest", "uniform", "runs", "serial", "joint", "natural", (F.col("natural") <= F.coalesce("limit", F.lit(-1.0))).alias("secret"))
