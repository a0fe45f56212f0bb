"""Toxicity scores by weak supervision.

Voters: fixed lexicons and patterns, and word stems that the labelled training
rows single out.  A generative label model (two latent classes, EM) estimates
how often each voter fires in either class; correlations between voters given
the class weaken the votes of those that say the same.  Its posterior
probabilities are the labels of a logistic regression over hashed words and
word beginnings, which then scores every whole text.  A feature's value is its
share of the text in percent, so that one chance word in a long text weighs
little; how often one token can count is bounded.

The models are fitted on a bounded sample, at most ``SAMPLE`` labelled rows of
each class (the smallest by a hash of the id, weighted up to their class), of
rows whose crc32(id as text) mod 4 is not ``HELD_OUT``.  The weights sent to
the tasks are those of at most ``MAX_FEATURES`` features.  Language, source and id are no
input of a score.

Defined cases: a null or empty text gets the score of a text without words;
every row gives one row, repeated rows equal ones; rows with a null id are not
held out; labels that are null don't count, of several for one id the highest
does; without labels the fixed lexicons decide alone.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkweave.llm.common import table

HELD_OUT = 2
THRESHOLD = 0.3
SAMPLE = 2_500
MAX_FEATURES = 20_000
#: Word beginnings of these lengths are features besides the whole word.
STEMS = (3, 4, 5, 6)
#: Words whose scores a worker remembers.
KNOWN = 500_000
MINED = 64
#: Shares in percent above which a mined voter may fire, and its least precision.
BOUNDS = (0.0, 0.2, 0.4, 0.6, 0.8, 1.2)
PRECISE = 0.85
#: Log of how much more often a feature has to occur in class 1.
LEAN = 2.0


# Lexicons and patterns, each a voter.
LEXICONS = {
    "intellect": ("idiot", "idiots", "moron", "morons", "stupid", "dumb", "imbecile", "fool", "retard"),
    "worth": ("loser", "losers", "worthless", "useless", "pathetic", "failure"),
    "disgust": ("disgusting", "scum", "trash", "filth", "vermin", "garbage", "pig", "rat"),
    "mockery": ("clown", "joke", "coward", "freak", "creep", "liar"),
    "obscene": ("fuck", "fucking", "shit", "bitch", "bastard", "asshole", "cunt", "dick"),
    "german": ("idiot", "trottel", "dummkopf", "arschloch", "scheisse", "scheiße", "abschaum", "versager", "hurensohn"),
    "french": ("idiot", "imbécile", "connard", "salaud", "merde", "crétin", "ordure", "débile"),
    "spanish": ("idiota", "imbécil", "estúpido", "cabrón", "mierda", "basura", "pendejo", "escoria"),
}
PATTERNS = {
    "address": r"\byou(?: are|'re)? (?:an? |all )?(?:idiot|moron|loser|clown|scum|trash|pathetic|stupid|disgusting|worthless)",
    "threat": r"\b(?:kill yourself|i will (?:kill|hurt|find) you|go die|shut up)\b",
    "hate": r"\b(?:i|we) hate (?:you|them|those)\b",
}
WORDS = re.compile(r"[^\W\d_]+")


def features_of(token: str) -> list[int]:
    """Feature numbers of a token between white space: its words and their beginnings."""
    out = []
    for w in WORDS.findall(token.lower()):
        out.append(zlib.crc32(b"w" + w.encode()))
        out += [zlib.crc32(b"%d" % n + w[:n].encode()) for n in STEMS if len(w) > n]
    return out


def shares_of(tokens: list[str]) -> dict[str, float]:
    """Each token's part of a text in percent; repeats count up to a bound that grows with the text."""
    most, part = 2 + len(tokens) // 200, 100 / (len(tokens) + 30)
    return {t: min(n, most) * part for t, n in Counter(tokens).items()}


def _fires(text: str, tokens: set[str]) -> list[int]:
    words = {w for t in tokens for w in WORDS.findall(t.lower())}
    low = text.lower()
    return [int(not words.isdisjoint(x)) for x in LEXICONS.values()] + [int(bool(re.search(x, low))) for x in PATTERNS.values()]


def _sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Label, features (packed, once for each token) and fixed votes of sampled rows."""
    for batch in batches:
        feats, values, votes = [], [], []
        for text in batch.column(0).to_pylist():
            shares = shares_of(text.split())
            each = [(f, v) for t, v in sorted(shares.items()) for f in features_of(t)]
            feats.append(np.array([f for f, _ in each], dtype=np.uint32).tobytes())
            values.append(np.array([v for _, v in each], dtype=np.float32).tobytes())
            votes.append(bytes(_fires(text, set(shares))))
        arrays = [batch.column(1), *(pa.array(x, pa.binary()) for x in (feats, values, votes))]
        yield pa.RecordBatch.from_arrays(arrays, names=["toxic", "features", "shares", "votes"])


def label_model(fires: np.ndarray, given: np.ndarray, weight: np.ndarray, rounds: int = 50) -> np.ndarray:
    """Posterior of class 1 for each row of a 0/1 matrix of voters (rows, voters).

    A voter votes for class 1 or abstains; the given label (0/1) is a voter that
    always votes, and that none of the others votes is a vote as well.  EM
    estimates each one's rates in both classes.  After each step correlations
    of the votes given the class are estimated, and a vote counts by one over
    one plus its positive correlations with others.
    """
    silent = ~fires.any(axis=1)
    post = np.where(silent, np.where(given > 0, 0.6, 0.02), 0.9)
    total = weight.sum()

    def rate(vote: np.ndarray, mass: np.ndarray, low: float = 1e-3) -> np.ndarray:
        return np.clip((mass @ vote + 0.05) / (mass.sum() + 0.1), low, 1 - low)

    for _ in range(rounds):
        p1, p0 = weight * post, weight * (1 - post)
        rate1, rate0 = rate(fires, p1, 1e-5), rate(fires, p0, 1e-5)
        centred = fires - post[:, None] * rate1 - (1 - post)[:, None] * rate0
        cov = (centred * weight[:, None]).T @ centred / total
        sd = np.sqrt(np.maximum(np.diag(cov), 1e-12))
        corr = np.clip(cov / np.outer(sd, sd), 0, 1)
        np.fill_diagonal(corr, 0)
        trust = 1 / (1 + corr.sum(axis=1))
        pi = np.clip(p1.sum() / total, 1e-3, 0.5)
        logit = np.log(pi / (1 - pi)) + fires @ (trust * np.log(rate1 / rate0))
        for vote in (silent.astype(float), given):
            r1, r0 = rate(vote, p1, 0.01), rate(vote, p0, 0.01)
            logit += vote * np.log(r1 / r0) + (1 - vote) * np.log((1 - r1) / (1 - r0))
        new = 1 / (1 + np.exp(-np.clip(logit, -30, 30)))
        if np.abs(new - post).max() < 1e-6:
            break
        post = new
    return post


def _mined(rows: np.ndarray, cols: np.ndarray, share: np.ndarray, y: np.ndarray, weight: np.ndarray) -> list[tuple[int, float]]:
    """(feature, least share) that mark class 1 in the labelled rows.

    For each feature the lowest bound that is precise enough counts; features
    are taken while they cover rows that those before leave.
    """
    n = int(cols.max()) + 1
    bound, reach = np.full(n, np.inf), np.zeros(n)
    scale = weight[y == 1].mean()
    for least in BOUNDS:
        on = share > least
        pos = np.bincount(cols[on], weights=y[rows[on]], minlength=n)
        neg = np.bincount(cols[on], weights=((1 - y) * weight)[rows[on]], minlength=n)
        fits = np.isinf(bound) & (pos >= max(3, 0.004 * y.sum())) & (pos * scale / (pos * scale + neg + 0.5) >= PRECISE)
        bound[fits], reach[fits] = least, pos[fits]
    ok = np.flatnonzero(reach)
    order = ok[np.lexsort((ok, -reach[ok]))][: 16 * MINED]
    left, out, rest = y.astype(bool).copy(), [], []
    for f in order:
        hit = rows[(cols == f) & (share > bound[f])]
        if left[hit].sum() >= 2 and len(out) < MINED:
            out.append((int(f), float(bound[f])))
            left[hit] = False
        else:
            rest.append((int(f), float(bound[f])))
    # The runners-up vote too; that many say the same is what the correlations are for.
    return (out + rest)[:MINED]


def fit(y: np.ndarray, features: list[np.ndarray], shares: list[np.ndarray], votes: np.ndarray, weight: np.ndarray) -> tuple[dict[int, float], float]:
    """(weights by feature, bias) from the sampled rows."""
    if not y.any() or y.all():
        return {zlib.crc32(b"w" + x.encode()): 3.0 for xs in LEXICONS.values() for x in xs}, -3.0
    rows = np.repeat(np.arange(len(y)), [len(f) for f in features])
    names, cols = np.unique(np.concatenate(features), return_inverse=True)
    pairs, at = np.unique(rows * len(names) + cols, return_inverse=True)
    share = np.bincount(at, weights=np.concatenate(shares).astype(float))
    rows, cols = pairs // len(names), pairs % len(names)
    mined = _mined(rows, cols, share, y, weight)
    fires = np.zeros((len(y), votes.shape[1] + len(mined)))
    fires[:, : votes.shape[1]] = votes
    for j, (f, least) in enumerate(mined):
        fires[rows[(cols == f) & (share > least)], votes.shape[1] + j] = 1
    fires = fires[:, fires.any(axis=0)]
    prior = float((y * weight).sum() / weight.sum())
    post = label_model(fires, y, weight)
    # Only features that lean clearly to class 1 of the posterior labels are used.
    lean = np.full(len(names), -np.inf)
    for least in BOUNDS:
        on = share > least
        p1 = np.bincount(cols[on], weights=(post * weight)[rows[on]], minlength=len(names))
        p0 = np.bincount(cols[on], weights=((1 - post) * weight)[rows[on]], minlength=len(names))
        many = np.bincount(cols[on], weights=post[rows[on]], minlength=len(names)) >= max(4, 0.005 * post.sum())
        here = np.log((p1 + 0.5) / (post @ weight)) - np.log((p0 + 0.5) / ((1 - post) @ weight))
        lean = np.maximum(lean, np.where(many, here, -np.inf))
    used = np.flatnonzero(lean >= LEAN)
    used = used[np.argsort(-lean[used], kind="stable")[:MAX_FEATURES]]
    place = np.full(len(names), -1)
    place[used] = np.arange(len(used))
    keep = place[cols] >= 0
    r, c, v = rows[keep], place[cols[keep]], share[keep]
    theta, b = np.zeros(len(used)), np.log(prior / (1 - prior)) - 1
    speed, speed_b = np.full(len(used), 1e-8), 1e-8
    mass = weight.sum()
    for _ in range(300):  # AdaGrad on the whole sample
        z = b + np.bincount(r, weights=theta[c] * v, minlength=len(y))
        error = weight * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - post) / mass
        g = np.bincount(c, weights=error[r] * v, minlength=len(used)) + 5e-4 * theta
        speed += g * g
        theta -= 0.3 * g / np.sqrt(speed)
        speed_b += error.sum() ** 2
        b -= 0.3 * error.sum() / np.sqrt(speed_b)
    return {int(names[f]): float(t) for f, t in zip(used, theta, strict=True) if t > 0.01}, float(b)


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> tuple[dict[int, float], float]:
    """Fit on the bounded sample of labelled rows that aren't held out."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).dropna()
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).filter(f"pmod(crc32(cast(doc_id AS string)), 4) <> {HELD_OUT}")
    sizes = {r["toxic"]: r["n"] for r in known.groupBy((F.col("toxic") > 0).cast("int").alias("toxic")).agg(F.count("*").alias("n")).collect()}
    order = F.xxhash64("doc_id", F.lit("sample"))
    chosen = known.filter("toxic > 0").orderBy(order, "doc_id").limit(sample).unionByName(known.filter("toxic <= 0").orderBy(order, "doc_id").limit(sample))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.join(F.broadcast(chosen), "doc_id").select("text", (F.col("toxic") > 0).cast("int").alias("toxic"))
    got = rows.mapInArrow(_sampled, "toxic int, features binary, shares binary, votes binary").toArrow()
    y = got["toxic"].to_numpy().astype(float)
    if not len(y):
        return fit(y, [], [], np.zeros((0, 1)), y)
    features = [np.frombuffer(x, dtype=np.uint32) for x in got["features"].to_pylist()]
    shares = [np.frombuffer(x, dtype=np.float32) for x in got["shares"].to_pylist()]
    votes = np.array([np.frombuffer(x, dtype=np.uint8) for x in got["votes"].to_pylist()], dtype=float)
    weight = np.where(y > 0, sizes.get(1, 0) / max(1, y.sum()), sizes.get(0, 0) / max(1, (1 - y).sum()))
    return fit(y, features, shares, votes, weight)


def score(docs: DataFrame, weights: dict[int, float], bias: float) -> DataFrame:
    """(doc_id, score) of every row."""
    given = docs.sparkSession.sparkContext.broadcast((weights, bias))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, b = given.value
        known: dict[str, float] = {}
        for batch in batches:
            z = []
            for text in batch.column(1):
                shares = shares_of((text.as_py() or "").split())
                if len(known) > KNOWN:
                    known = {}
                for t in shares:
                    if t not in known:
                        known[t] = sum(w.get(f, 0.0) for f in features_of(t))
                z.append(b + sum(v * known[t] for t, v in shares.items()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(1 / (1 + np.exp(-np.clip(np.array(z, dtype=float), -30, 30))))], names=["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, score double")


def op2_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = score(docs, *train(docs, table(spark, sf_dir, "labels")))
    held = F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(4)) == HELD_OUT
    return out.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
