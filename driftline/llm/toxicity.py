"""Toxicity by weak supervision: voters, a generative label model, a linear classifier on its posteriors."""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import held_out, table

#: Labelled documents that lexicons are induced from and the classifier is fitted on, at most (chosen by a hash of the id).
SAMPLE = 10_000
#: Voters that induced words, and as many that induced word beginnings, are dealt to; lengths of those beginnings.
VOTERS, STEMS = 6, (4, 5, 6, 7, 8)
THRESHOLD = 0.7
#: Least share of toxic rows among those that have an induced feature.
PRECISION = 0.9
CACHE = 400_000
WORD = re.compile(r"[^\W\d_]+")
#: Insults that need no labels.
INSULTS = tuple(
    "idiot moron imbecile stupid dumb fool loser pathetic worthless disgusting scum trash garbage vermin clown pig coward liar creep freak jerk "
    "dummkopf idiotin abschaum trottel arschloch versager crétin imbécile connard ordure minable estúpido imbécil basura escoria inútil".split()
)
#: Signs that stand for letters in disguised words.
DISGUISE = str.maketrans("013457@$!", "oieastasi")
DISGUISED = re.compile(r"[a-z]*[013457@$!][a-z013457@$!]*[a-z]")
AIMED = re.compile(rf"\byou(?:'re| are)?\s+(?:\w+\s+){{0,2}}(?:{'|'.join(INSULTS)})")
THREAT = re.compile(r"\b(?:kill|hurt|beat|destroy|hate)\s+(?:you|him|her|them)\b")
SURFACE = ("insult", "disguised", "aimed", "threat", "repeated", "dense", "exclaiming", "shouting")
ROUNDS = 200


def features_of(word: str) -> tuple[str, ...]:
    """The lexicon entry and the patterns of a lower-case word."""
    return (f"w {word}", *(f"s {word[:n]}" for n in STEMS if len(word) > n))


def sampled(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(doc_id, text, toxic) of at most about `sample` labelled documents, which alone are sent to all executors.

    A document labelled more than once is toxic if one of its labels says so; labels other than 0 and 1 say nothing.
    """
    rows = labels.filter(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull()).filter(~held_out(F.col("doc_id")))
    rows = rows.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    share = min(1.0, sample / max(1, rows.count()))
    rows = rows.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < F.lit(int(share * (1 << 20))))
    return docs.select("doc_id", "text").join(F.broadcast(rows), "doc_id")


def select_features(train: DataFrame):
    """Words and word beginnings that mark toxic texts, strongest first, and the share of toxic rows; None if a class is missing.

    A feature's likelihood ratio against the base rate must exceed the logarithm of the number of features tried and a
    margin, so that rare words which fell into toxic texts by chance don't pass, at any size of the sample.
    """

    def seen(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            counts: dict[tuple[str, int], int] = {}
            for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for f in {f for w in set(WORD.findall((text or "").lower())) for f in features_of(w)}:
                    counts[f, toxic] = counts.get((f, toxic), 0) + 1
            names, marks = zip(*counts, strict=True) if counts else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(marks, pa.int32()), pa.array(counts.values(), pa.int64())], names=["f", "toxic", "n"])

    base = {r["toxic"]: r["count"] for r in train.groupBy("toxic").count().collect()}
    rate = (base.get(1, 0) + 0.5) / (sum(base.values()) + 1)
    if not base.get(1) or not base.get(0):
        return None, rate
    counts = train.select("text", "toxic").repartition(8).mapInArrow(seen, "f string, toxic int, n long").groupBy("f").agg(F.sum(F.col("n") * F.col("toxic")).alias("p"), F.sum(F.col("n") * (1 - F.col("toxic"))).alias("q"))
    here = F.col("p") / (F.col("p") + F.col("q"))
    gain = F.col("p") * F.log(here / rate) + F.when(F.col("q") > 0, F.col("q") * F.log((1 - here) / (1 - rate))).otherwise(0.0)
    scored = counts.filter("p > 0").withColumn("gain", gain).filter(here >= PRECISION)
    tried = counts.count()
    rows = scored.filter(F.col("gain") > F.log(F.lit(float(tried + 1))) + 3).orderBy(F.desc("gain"), "f").collect()
    return [r["f"] for r in rows], rate


class Reader(dict):
    """Selected features of a word, looked up on first sight."""

    def __init__(self, features: list[str]):
        self.index = {f: i for i, f in enumerate(features)}

    def __missing__(self, word: str) -> tuple[int, ...]:
        if len(self) >= CACHE:
            self.clear()
        self[word] = out = tuple(self.index[f] for f in features_of(word) if f in self.index)
        return out

    def hits(self, text: str) -> tuple[dict[int, int], int]:
        """How often each selected feature occurs, and the number of words."""
        words = WORD.findall(text.lower())
        counts: dict[int, int] = {}
        for got in filter(None, map(self.__getitem__, words)):
            for i in got:
                counts[i] = counts.get(i, 0) + 1
        return counts, len(words)


def ballots(hits: list, texts: list[str], features: list[str]):
    """Votes of each text as bits: induced words and beginnings, dealt to VOTERS each, then SURFACE."""
    known = {f"w {w}" for w in INSULTS}
    bit = [VOTERS * 2 if f in known else i % VOTERS + VOTERS * f.startswith("s") for i, f in enumerate(features)]
    out = []
    for (counts, words), text in zip(hits, texts, strict=True):
        votes, lower, total = 0, text.lower(), sum(counts.values())
        for i in counts:
            votes |= 1 << bit[i]
        disguised = any(w.translate(DISGUISE) in INSULTS for w in set(DISGUISED.findall(lower)))
        surface = (False, disguised, AIMED.search(lower), THREAT.search(lower), total >= 2, total >= 1 and total * 200 >= words, text.count("!") * 20 > words + 1, text.upper() == text and lower != text)
        for k, vote in enumerate(surface):
            votes |= bool(vote) << (2 * VOTERS + k)
        out.append(votes)
    return out


def label_model(votes, counts, rate: float, known=None):
    """Posterior of each pattern of votes: class prior, each voter's accuracies, and their correlations, from the votes alone.

    votes: patterns x voters of 0 and 1; counts: documents with each pattern, labelled or not; known: those of them that
    are labelled, clean and toxic, which stay in their class. Expectation-maximisation starts at whether any voter but the
    last two (loud punctuation says little) has voted, and ends when no posterior moves. Voters that agree beyond what
    the classes explain say the same thing: each vote counts by one over the sum of its squared correlations within the
    classes.
    """
    import numpy as np

    votes, counts = np.asarray(votes, dtype=float), np.asarray(counts, dtype=float)
    known = np.zeros((len(counts), 2)) if known is None else np.asarray(known, dtype=float)
    free = np.maximum(counts - known.sum(axis=1), 0)
    post = votes[:, :-2].any(axis=1).astype(float)
    for _ in range(ROUNDS):
        a, b = free * post + known[:, 1], free * (1 - post) + known[:, 0]
        hit, false = (a @ votes + 0.5) / (a.sum() + 1), (b @ votes + 0.05) / (b.sum() + 1)
        left, right = votes - a @ votes / max(a.sum(), 1e-9), votes - b @ votes / max(b.sum(), 1e-9)
        both = (left.T * a) @ left + (right.T * b) @ right
        spread = np.diag(both) + 1e-6
        weight = 1 / np.maximum(1.0, (both**2 / np.outer(spread, spread)).sum(axis=1))
        ratio = votes * (weight * np.log(hit / false)) + (1 - votes) * (weight * np.log((1 - hit) / (1 - false)))
        prior = (a.sum() + rate) / (a.sum() + b.sum() + 1)
        new = 1 / (1 + np.exp(-np.clip(np.log(prior / (1 - prior)) + ratio.sum(axis=1), -30, 30)))
        moved, post = np.abs(new - post).max(), new
        if moved < 1e-6:
            break
    return post


class Sparse:
    """A matrix by its entries: products with a vector from either side, in time and memory in proportion to them."""

    def __init__(self, rows, columns, values, shape):
        self.rows, self.columns, self.values, self.shape = rows, columns, values, shape

    @classmethod
    def of(cls, dense):
        import numpy as np

        rows, columns = np.nonzero(dense)
        return cls(rows, columns, np.asarray(dense, dtype=float)[rows, columns], dense.shape)

    def left(self, v):
        """The matrix times a vector of its columns."""
        import numpy as np

        return np.bincount(self.rows, self.values * v[self.columns], minlength=self.shape[0])

    def right(self, v):
        """The transposed matrix times a vector of its rows."""
        import numpy as np

        return np.bincount(self.columns, self.values * v[self.rows], minlength=self.shape[1])


def vectors(hits: list, size: int) -> Sparse:
    """A row a text: the logarithm of each feature's count, all hits, hits by length, and a constant."""
    import numpy as np

    rows, columns, values = [], [], []
    for row, (counts, words) in enumerate(hits):
        if counts:
            total = sum(counts.values())
            columns += [*counts, size, size + 1]
            values += [*np.log1p(list(counts.values())).tolist(), np.log1p(total), min(1.0, 20 * total / max(1, words))]
        columns.append(size + 2)
        values.append(1.0)
        rows += [row] * (len(columns) - len(rows))
    return Sparse(np.array(rows, dtype=np.int64), np.array(columns, dtype=np.int64), np.array(values, dtype=float), (len(hits), size + 3))


def solved(times, b, steps: int = 300):
    """x with times(x) = b for a positive definite product, by conjugate gradients."""
    import numpy as np

    x, r = np.zeros_like(b), b.copy()
    d, size = r.copy(), r @ r
    end = size * 1e-16
    for _ in range(steps):
        if size <= end:
            break
        along = times(d)
        a = size / (d @ along)
        x, r = x + a * d, r - a * along
        size, before = r @ r, size
        d = r + size / before * d
    return x


def train_linear(x, target, weight, decay: float = 2e-4, settled: float = 1e-9):
    """Logistic regression of soft labels on weighted rows, by Newton's steps until the gradient is settled.

    The curvature is never formed: a step is solved for by its products with vectors, so that features may be many.
    """
    import numpy as np

    x, total = x if isinstance(x, Sparse) else Sparse.of(x), weight.sum()
    w = np.zeros(x.shape[1])
    ridge = np.append(np.full(x.shape[1] - 1, decay), 1e-9)
    loss = lambda w: (weight @ (np.logaddexp(0, x.left(w)) - target * x.left(w))) / total + ridge @ (w * w) / 2
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x.left(w), -30, 30)))
        grad = x.right(weight * (p - target)) / total + ridge * w
        if np.abs(grad).max() < settled:
            break
        curve = weight * p * (1 - p)
        step = solved(lambda v, curve=curve: x.right(curve * x.left(v)) / total + (ridge + 1e-12) * v, grad)
        size = 1.0
        while size > 1e-6 and loss(w - size * step) > loss(w):
            size /= 2
        w = w - size * step
    return w


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE):
    """Features and the weights of the linear classifier; without labels of both classes no features, and one weight for all.

    INSULTS are features whether or not any word was induced, and the other voters need no features, so the label model and
    the classifier run at every size.
    Lexicons are induced from the labelled sample. The votes of all documents that aren't held out, labelled or not, are
    counted by pattern (2 to the number of voters at most, in fact a few hundred) for the label model, in which the
    sample's labels anchor the classes. The classifier learns the posteriors of the sample's votes; the labels are no
    targets.
    """
    import json

    import numpy as np

    train = sampled(docs, labels, sample)
    induced, rate = select_features(train)
    if induced is None:
        return [], np.array([np.log(rate / (1 - rate))])
    features = [*induced, *sorted({f"w {w}" for w in INSULTS} - set(induced))]

    def vote(batches: Iterator) -> Iterator:
        import pyarrow as pa

        reader = Reader(features)
        for batch in batches:
            texts = [t or "" for t in batch.column(0).to_pylist()]
            hits = [reader.hits(t) for t in texts]
            rows = [json.dumps([sorted(c.items()), n if c else 0]) for c, n in hits]
            yield pa.RecordBatch.from_arrays([pa.array(rows), pa.array(ballots(hits, texts, features), pa.int64()), batch.column(1)], names=["hits", "votes", "toxic"])

    schema = "hits string, votes long, toxic int"
    allowed = docs.filter(~held_out(F.col("doc_id"))).select("text", F.lit(0).alias("toxic"))
    patterns = {r["votes"]: r["count"] for r in allowed.mapInArrow(vote, schema).groupBy("votes").count().collect()}
    rows = train.select("text", F.col("toxic").cast("int")).mapInArrow(vote, schema).groupBy("hits", "votes", "toxic").count().orderBy("hits", "votes", "toxic").collect()
    known = {v: [sum(r["count"] for r in rows if (r["votes"], r["toxic"]) == (v, t)) for t in (0, 1)] for v in {r["votes"] for r in rows}}
    order, bits = sorted(patterns), np.arange(2 * VOTERS + len(SURFACE))
    post = label_model([v >> bits & 1 for v in order], [patterns[v] for v in order], rate, [known.get(v, [0, 0]) for v in order])
    post = dict(zip(order, post.tolist(), strict=True))
    hits = [(dict(c), n) for c, n in (json.loads(r["hits"]) for r in rows)]
    target, weight = np.array([post[r["votes"]] for r in rows]), np.array([float(r["count"]) for r in rows])
    return features, train_linear(vectors(hits, len(features)), target, weight)


def predict(docs: DataFrame, features: list[str], weights) -> DataFrame:
    """(doc_id, score): of every whole text. Null and empty texts are scored like any text without a hit.

    Words count whole, however long. Repeated rows and rows without an id are scored each; other columns are not read;
    an empty table gives an empty result, and without labels of both classes every score is the share of toxic labels.
    """
    model = docs.sparkSession.sparkContext.broadcast((features, weights))

    def score(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        features, weights = model.value
        reader, size = Reader(features), len(features)
        for batch in batches:
            z = np.full(batch.num_rows, weights[-1])
            if features:
                for row, text in enumerate(batch.column(1)):
                    counts, words = reader.hits(text.as_py() or "")
                    if counts:
                        total = sum(counts.values())
                        z[row] += sum(weights[i] * np.log1p(n) for i, n in counts.items()) + weights[size] * np.log1p(total) + weights[size + 1] * min(1.0, 20 * total / max(1, words))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(1 / (1 + np.exp(-np.clip(z, -30, 30))))], names=["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(score, "doc_id long, score double")


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's score by a model of the labels of the others; one score for all without labels of both classes."""
    docs = table(spark, sf_dir, "documents")
    features, weights = fit(docs, table(spark, sf_dir, "labels"))
    rows = predict(docs, features, weights)
    return rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
