"""Language-model scores by a log-bilinear model trained with noise-contrastive estimation.

Tokens are lower-case (A-Z) words and one end per text. The model's symbols
are the TOP most frequent tokens and BUCKETS classes of all others, told apart
by the last two bytes of the word. The context vector of the two symbols
before is ``R[b] C1 + R[a] C2``; the logit of symbol w is its product with
``Q[w]`` plus a bias. Probabilities are normalised: the sums over all symbols
for all pairs of contexts are one product of two matrices. A word of a class
has the class's probability times its own smoothed share of it.

Training passes over all training texts: every task runs noise-contrastive
estimation over the trigrams of its own texts (all tokens, with their counts),
starting from the same parameters; the parameters are then averaged by the
number of tokens. Only sums of parameters and the TABLE most frequent words
(both of fixed size) come to the driver; of words of like counts that don't all
fit, a hash range of them does. Counts of all other words stay in a table that
the scored texts' rare words are joined to.

Edge cases: a null text is empty and has one token, the end; without any
training text all scores follow from N = V = 0; rows that repeat are scored
each, and count twice in training; an empty table gives an empty result; extra
columns of the input are ignored.
"""

from __future__ import annotations

import math
import uuid
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import BLOCK, blocks_of, vector_sum, written

TOP, BUCKETS, DIM = 768, 256, 32
SYMBOLS = TOP + BUCKETS
TABLE = 1 << 18
#: Hash ranges that split the words of the count grade which no longer fits in whole.
PLACES = 4096
NOISE = 64
BATCH = 8192
LEARN_AT = 2_000_000
RATE = 0.1
MEMO = 400_000
END = "\n"  # no word


def tokens(text: str | None) -> list[bytes]:
    out = (text or "").encode("utf-8", "replace").lower().split()
    out.append(b"\n")
    return out


def bucket(word: bytes) -> int:
    return zlib.crc32(word[-2:]) % BUCKETS


def _parts(batches: Iterator[pa.RecordBatch], rows: int = 400) -> Iterator[pa.RecordBatch]:
    """Batches of few rows, so that few texts are held as tokens at a time."""
    for b in batches:
        for k in range(0, b.num_rows, rows):
            yield b.slice(k, rows)


def split(docs: DataFrame) -> DataFrame:
    """row, doc_id, text, held_out."""
    held = F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(10)) == 0
    return docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "text", held.alias("held_out"))


def token_counts(training: DataFrame) -> DataFrame:
    """word, bucket, c over all training texts, written to the shared folder."""

    def batch(c: Counter) -> pa.RecordBatch:
        words = list(c)
        return pa.RecordBatch.from_arrays([pa.array([w.decode() for w in words], pa.string()), pa.array([bucket(w) for w in words], pa.int32()), pa.array(list(c.values()), pa.int64())], ["word", "bucket", "c"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c: Counter = Counter()
        for b in _parts(batches):
            for text in b.column("text").to_pylist():
                c.update(tokens(text))
            if len(c) > MEMO:
                yield batch(c)
                c = Counter()
        yield batch(c)

    rows = training.select("text").mapInArrow(run, "word string, bucket int, c long")
    return written(rows.groupBy("word", "bucket").agg(F.sum("c").alias("c")))


@dataclass
class Vocabulary:
    """The most frequent words with their counts (the first TOP are symbols of their own) and the sums of the classes of all words beyond TOP."""

    words: list[bytes]
    counts: np.ndarray
    n: int
    v: int
    bucket_n: np.ndarray
    bucket_v: np.ndarray
    unigram: np.ndarray  # of symbols

    @property
    def index(self) -> dict[bytes, int]:
        return {w: i for i, w in enumerate(self.words)}


def vocabulary(counts: DataFrame) -> Vocabulary:
    total = counts.agg(F.sum("c").alias("n"), F.count("*").alias("v")).first()
    # the most frequent: whole grades of counts while they fit, found by a histogram of fixed size;
    # of the next grade as many of PLACES hash ranges as fit, so that words of one count don't all stay out
    grade, place = F.floor(F.log2("c") * 8), F.pmod(F.xxhash64("word"), F.lit(PLACES))
    steps = sorted(((r["g"], r["k"]) for r in counts.groupBy(grade.alias("g")).agg(F.count("*").alias("k")).collect()), reverse=True)
    room, chosen = TABLE - 1, F.lit(False)
    for g, k in steps:
        if k > room:
            ranges = sorted((r["p"], r["k"]) for r in counts.where(grade == g).groupBy(place.alias("p")).agg(F.count("*").alias("k")).collect())
            fits = [p for (p, _), sum_ in zip(ranges, np.cumsum([n for _, n in ranges]).tolist(), strict=True) if sum_ <= room]
            chosen = chosen | ((grade == g) & (place <= fits[-1])) if fits else chosen
            break
        room -= k
        chosen = grade >= g
    top = counts.where((F.col("word") == END) | chosen).toArrow()
    ordered = sorted((w != END, -k, w) for w, k in zip(top.column("word").to_pylist(), top.column("c").to_pylist(), strict=True))
    words = [w.encode() for _, _, w in ordered]
    c = np.array([-k for _, k, _ in ordered], np.int64)
    all_ = {r["bucket"]: (r["n"], r["v"]) for r in counts.groupBy("bucket").agg(F.sum("c").alias("n"), F.count("*").alias("v")).collect()}
    bn, bv = (np.array([all_.get(i, (0, 0))[k] for i in range(BUCKETS)], np.int64) for k in (0, 1))
    for w, k in zip(words[:TOP], c[:TOP].tolist(), strict=True):
        bn[bucket(w)] -= k
        bv[bucket(w)] -= 1
    seen = np.zeros(SYMBOLS)
    seen[: len(c[:TOP])] = c[:TOP]
    seen[TOP:] = bn
    return Vocabulary(words, c, int(total["n"] or 0), int(total["v"]), bn, bv, (seen + 0.5) / (seen + 0.5).sum())


class Ids(dict):
    """Number of a word among the known ones, or TABLE plus its class."""

    def __init__(self, known: dict[bytes, int]) -> None:
        super().__init__(known)
        self.known = known

    def __missing__(self, word: bytes) -> int:
        if len(self) > len(self.known) + MEMO:
            self.clear()
            self.update(self.known)
        self[word] = i = TABLE + bucket(word)
        return i


def symbol_table(v: Vocabulary) -> np.ndarray:
    """Symbol of every number that Ids gives."""
    out = np.zeros(TABLE + BUCKETS, np.int64)
    out[: len(v.words)] = [i if i < TOP else TOP + bucket(w) for i, w in enumerate(v.words)]
    out[TABLE:] = TOP + np.arange(BUCKETS)
    return out


def contexts(symbols: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The symbols two and one before each token; the end symbol (0) before a text."""
    starts = np.cumsum(sizes) - sizes
    one = np.concatenate([[0], symbols[:-1]])
    one[starts] = 0
    two = np.concatenate([[0], one[:-1]])
    two[starts] = 0
    return two, one


def initial(v: Vocabulary, seed: int = 7) -> list[np.ndarray]:
    """R, Q, C1, C2, bias."""
    rng = np.random.default_rng(seed)
    r, q = (rng.normal(0, 0.1, (SYMBOLS, DIM)).astype(np.float32) for _ in range(2))
    eye = np.eye(DIM, dtype=np.float32)
    return [r, q, eye.copy(), 0.5 * eye, np.log(v.unigram).astype(np.float32)]


def _scatter(at: np.ndarray, rows: np.ndarray, size: int) -> np.ndarray:
    by = np.argsort(at, kind="stable")
    s = at[by]
    first = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]]))
    out = np.zeros((size, rows.shape[1]), np.float32)
    out[s[first]] = np.add.reduceat(rows[by], first, axis=0)
    return out


def train(params: list[np.ndarray], squares: list[np.ndarray], unigram: np.ndarray, code: np.ndarray, n: np.ndarray, rng: np.random.Generator) -> None:
    """One pass of noise-contrastive estimation over trigrams (code, as often as n says) by Adagrad, in place."""
    r, q, c1, c2, bias = params
    shift = np.log(NOISE * unigram).astype(np.float32)
    cdf = np.cumsum(unigram)
    order = rng.permutation(len(code))
    sig = lambda x: 1 / (1 + np.exp(-np.clip(x, -30, 30)))
    for k in range(0, len(code), BATCH):
        pick = order[k : k + BATCH]
        x, weight = code[pick], n[pick].astype(np.float32)
        a, b, w = x // (SYMBOLS * SYMBOLS), x // SYMBOLS % SYMBOLS, x % SYMBOLS
        noise = np.minimum(np.searchsorted(cdf, rng.random(NOISE)), SYMBOLS - 1)
        ra, rb, qw, qn = r[a], r[b], q[w], q[noise]
        ctx = rb @ c1 + ra @ c2
        good = (1 - sig((ctx * qw).sum(1) + bias[w] - shift[w])) * weight
        bad = -sig(ctx @ qn.T + (bias[noise] - shift[noise])) * weight[:, None]
        scale = 1 / weight.sum()
        good, bad = good * scale, bad * scale
        dctx = good[:, None] * qw + bad @ qn
        dq = _scatter(w, good[:, None] * ctx, SYMBOLS)
        np.add.at(dq, noise, bad.T @ ctx)
        dbias = np.bincount(w, weights=good, minlength=SYMBOLS) + np.bincount(noise, weights=bad.sum(0), minlength=SYMBOLS)
        dr = _scatter(b, dctx @ c1.T, SYMBOLS) + _scatter(a, dctx @ c2.T, SYMBOLS)
        for p, s, g in zip(params, squares, (dr, dq, rb.T @ dctx, ra.T @ dctx, dbias.astype(np.float32)), strict=True):
            s += g * g
            p += RATE * g / (np.sqrt(s) + 1e-6)


def fit(training: DataFrame, v: Vocabulary, seed: int = 7) -> list[np.ndarray]:
    """Parameters after one pass over all training texts."""
    spark = training.sparkSession
    shared = spark.sparkContext.broadcast((v.index, symbol_table(v), v.unigram))
    start = initial(v, seed)
    if not v.n:
        return start

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, table, unigram = shared.value
        ids = Ids(index)
        params = [p.copy() for p in start]
        squares = [np.full_like(p, 1e-4) for p in params]
        rng = np.random.default_rng(seed)
        held: list[np.ndarray] = []
        seen = waiting = 0

        def learn() -> None:
            nonlocal seen, waiting
            if held:
                code, n = np.unique(np.concatenate(held), return_counts=True)
                train(params, squares, unigram, code, n, rng)
                seen += waiting
                held.clear()
                waiting = 0

        for b in _parts(batches):
            lists = [tokens(t) for t in b.column("text").to_pylist()]
            n = np.array([len(x) for x in lists], np.int64)
            symbols = table[np.fromiter((i for x in lists for i in map(ids.__getitem__, x)), np.int64, int(n.sum()))]
            two, one = contexts(symbols, n)
            held.append((two * SYMBOLS + one) * SYMBOLS + symbols)
            waiting += len(symbols)
            if waiting >= LEARN_AT:
                learn()
        learn()
        yield blocks_of(np.append(np.concatenate([p.reshape(-1) for p in params]).astype("<f8") * seen, seen))

    total = vector_sum(training.select("text").mapInArrow(run, BLOCK))
    flat = (total[:-1] / max(total[-1], 1)).astype(np.float32)
    cuts = np.cumsum([p.size for p in start])[:-1]
    return [x.reshape(p.shape) for x, p in zip(np.split(flat, cuts), start, strict=True)]


def log_tables(params: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Logits by the symbol before (bias in them) and by the one before that, and the logarithm of the sum for each pair (before, one before that)."""
    r, q, c1, c2, bias = (p.astype(np.float64) for p in params)
    one, two = (r @ c1) @ q.T + bias, (r @ c2) @ q.T
    m1, m2 = one.max(1, keepdims=True), two.max(1, keepdims=True)
    z = np.log(np.exp(one - m1) @ np.exp(two - m2).T) + m1 + m2.T
    return one.astype(np.float32), two.astype(np.float32), z.astype(np.float32)


_tables: dict[str, tuple] = {}

SCORED = "row long, key string, n long, bucket int, doc_id long, held_out boolean, n_tokens long, n_known long, base double, score double"


def score(rows: DataFrame, counts: DataFrame, v: Vocabulary, params: list[np.ndarray]) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score; rows as from split()."""
    model = rows.sparkSession.sparkContext.broadcast((v, params))
    denominator = v.n + 0.1 * (v.v + 1)
    class_sums = v.bucket_n + 0.1 * (v.bucket_v + 1)

    name = uuid.uuid4().hex

    def tables() -> tuple:
        """Made once in a Python process."""
        if name not in _tables:
            _tables.clear()
            voc, p = model.value
            base = np.log10((voc.counts + 0.1) / denominator)
            inside = np.zeros(len(voc.words))
            classes = np.array([bucket(w) for w in voc.words[TOP:]], np.int64)
            inside[TOP:] = np.log10((voc.counts[TOP:] + 0.1) / class_sums[classes])
            _tables[name] = (Ids(voc.index), symbol_table(voc), *log_tables(p), base, inside)
        return _tables[name]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, table, one_, two_, z, base, inside = tables()
        for b in _parts(batches):
            row, doc, held = (b.column(c).to_pylist() for c in ("row", "doc_id", "held_out"))
            lists = [tokens(t) for t in b.column("text").to_pylist()]
            n = np.array([len(x) for x in lists], np.int64)
            if not len(n):
                continue
            at = np.fromiter((i for x in lists for i in map(ids.__getitem__, x)), np.int64, int(n.sum()))
            starts = np.cumsum(n) - n
            s = table[at]
            two, one = contexts(s, n)
            known = at < TABLE
            safe = np.where(known, at, 0)
            own = (one_[one, s].astype(np.float64) + two_[two, s] - z[one, two]) / math.log(10) + (np.where(known, inside[safe], 0.0) if len(inside) else 0.0)
            ground = np.where(known, base[safe], 0.0) if len(base) else np.zeros(len(at))
            sums = [np.add.reduceat(x, starts) for x in (own, ground, known.astype(np.int64))]
            rare: list[tuple] = []
            for i in np.flatnonzero(sums[2] < n).tolist():
                a = starts[i]
                words = lists[i]
                rare += [(row[i], w.decode(), k, bucket(w)) for w, k in Counter([words[j] for j in np.flatnonzero(~known[a : a + n[i]]).tolist()]).items()]
            none = [None] * len(rare)
            zeros = [0.0] * len(rare)
            columns = [
                row + [x[0] for x in rare],
                [f" {x}" for x in row] + [x[1] for x in rare],  # no word holds a space: matches none, and is dealt evenly
                [0] * len(row) + [x[2] for x in rare],
                [0] * len(row) + [x[3] for x in rare],
                doc + none,
                held + none,
                n.tolist() + none,
                sums[2].tolist() + [0] * len(rare),
                sums[1].tolist() + zeros,
                sums[0].tolist() + zeros,
            ]
            types = [pa.int64(), pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], [f.split()[0] for f in SCORED.split(", ")])

    parts = rows.mapInArrow(run, SCORED).join(counts.select(F.col("word").alias("key"), "c"), "key", "left")
    c = F.coalesce("c", F.lit(0).cast("long"))
    sums = F.array(*[F.lit(float(x)) for x in class_sums])
    parts = parts.select(
        "row", "doc_id", "held_out", "n_tokens",
        (F.col("n_known") + F.when(c > 0, F.col("n")).otherwise(0)).alias("n_known"),
        (F.col("base") + F.col("n") * F.log10((c + 0.1) / F.lit(denominator))).alias("base"),
        (F.col("score") + F.col("n") * F.log10((c + 0.1) / F.get(sums, F.col("bucket")))).alias("score"),
    )
    out = parts.groupBy("row").agg(F.max("doc_id").alias("doc_id"), F.max("held_out").alias("held_out"), F.max("n_tokens").alias("n_tokens"), F.sum("n_known").alias("n_known"), F.sum("base").alias("base_score"), F.sum("score").alias("score"))
    return out.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(v.n).cast("long").alias("train_tokens"), "base_score", "score")


def lm_scores(docs: DataFrame, seed: int = 7) -> DataFrame:
    rows = split(docs)
    training = rows.where("NOT held_out")
    counts = token_counts(training)
    v = vocabulary(counts)
    return score(rows, counts, v, fit(training, v, seed))
