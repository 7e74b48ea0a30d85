"""Language identification: each text is a mixture of languages, inferred from n-gram likelihoods."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import held_out, table

#: Bytes to an n-gram, hashed n-grams, bytes to a segment (the unit that has one language).
GRAM, BUCKETS, SEGMENT = 4, 1 << 16, 48
#: Documents of each language that the n-gram tables are fitted on, at most (chosen by a hash of the id).
SAMPLE = 2000
#: Overlapping n-grams tell the same thing over again: their joint log-likelihood counts by so much.
TEMPER = 1 / GRAM
#: EM ends when no proportion changes by more than SETTLED, or after so many steps.
SETTLED, STEPS = 1e-4, 200
UNKNOWN = "und"
#: Segments whose likelihoods are worked out at once.
CHUNK = 20_000


def has_letter(text: str) -> bool:
    """Whether any character is of one of Unicode's letter categories; numerals and marks are none."""
    return any(map(str.isalpha, text))


def prepared(texts: list[str]):
    """The bytes of all texts, plain letters only, each with blanks around it, and where each one's n-grams begin and end."""
    import numpy as np

    raw = [f"   {t.lower()} ".encode() for t in texts]
    ends = np.cumsum([len(x) for x in raw])
    plain = np.full(256, 32, dtype=np.uint8)
    plain[97:123], plain[128:] = np.arange(97, 123), np.arange(128, 256)
    return plain[np.frombuffer(b"".join(raw), dtype=np.uint8)], ends - np.array([len(x) for x in raw]), ends - (GRAM - 1)


def grams(data):
    """Hashed n-grams of bytes, one for each of the first len(data) - GRAM + 1."""
    import numpy as np

    size = len(data) - GRAM + 1
    code = data[:size].astype(np.uint32)
    for k in range(1, GRAM):
        code |= data[k : size + k].astype(np.uint32) << np.uint32(8 * k)
    code *= np.uint32(2654435761)
    return (code >> np.uint32(16)).astype(np.int32)


def fit(docs: DataFrame, sample: int = SAMPLE):
    """Languages and the log-probabilities of their n-grams, (languages x BUCKETS), from rows with text and lang."""
    import numpy as np

    known = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull())
    counts = {r["lang"]: r["count"] for r in known.groupBy("lang").count().collect()}
    names = sorted(counts)
    if not names:
        return [], np.zeros((0, BUCKETS), dtype=np.float32)
    share = F.lit(0.0)
    for name in names:
        share = F.when(F.col("lang") == name, F.lit(min(1.0, sample / counts[name]))).otherwise(share)
    chosen = known.filter((F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) / F.lit(1 << 20)) < share).select("text", "lang")

    def count(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        total = {}
        for batch in batches:
            texts, langs = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for name in set(langs):
                for t in (t for t, x in zip(texts, langs, strict=True) if x == name):
                    total[name] = total.get(name, 0) + np.bincount(grams(prepared([t])[0]), minlength=BUCKETS)
        for name, n in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([n.astype("<i8").tobytes()])], names=["lang", "n"])

    table_ = np.zeros((len(names), BUCKETS))
    for row in chosen.repartition(4).mapInArrow(count, "lang string, n binary").toLocalIterator():
        table_[names.index(row["lang"])] += np.frombuffer(row["n"], dtype="<i8")
    smooth = table_ + 0.1 + 5.0 * table_.sum(axis=0) / max(1.0, table_.sum())
    return names, np.log(smooth / smooth.sum(axis=1, keepdims=True)).astype(np.float32)


def mixtures(texts: list[str], logs):
    """Proportions (texts x languages) of each text's languages, zero outside its set.

    A text is cut into segments, each of one language. Expectation-maximisation finds the proportions that make its
    segments likeliest, each text on its own; starting from all languages, the rarest one goes as long as the likelihood loses less than the
    penalty of one language, half the logarithm of the number of segments and a constant.
    """
    import numpy as np

    data, starts, ends = prepared(texts)
    cuts = [np.arange(a, max(b, a + 1), SEGMENT) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
    n = np.array([len(c) for c in cuts])
    first = np.concatenate([[0], np.cumsum(n)[:-1]])
    edges = np.concatenate(cuts)
    stops = np.append(edges[1:], 0)
    stops[np.append(first[1:], len(edges)) - 1] = ends
    like = np.empty((len(edges), len(logs)))
    for a in range(0, len(edges), CHUNK):
        begin, end = edges[a : a + CHUNK], stops[a : a + CHUNK]
        codes = grams(data[begin[0] : end[-1] + GRAM - 1])
        # sums from each segment's beginning to its end; those from one end to the next beginning are left out
        marks = np.column_stack([begin, end]).ravel() - begin[0]
        for j, row in enumerate(logs):
            like[a : a + CHUNK, j] = np.add.reduceat(np.append(row[codes].astype(np.float64), 0.0), marks)[::2] * TEMPER
    top = like.max(axis=1, keepdims=True)
    like = np.exp(like - top)
    whose = np.repeat(np.arange(len(texts)), n)
    base = np.add.reduceat(top[:, 0], first)

    def settle(allowed):
        share = allowed / allowed.sum(axis=1, keepdims=True)
        open_ = np.arange(len(texts))  # a text's steps end when it has settled, whatever the others do
        mine, where, begin = like, whose, first
        for _ in range(STEPS):
            part = mine * share[where]
            part /= part.sum(axis=1, keepdims=True) + 1e-300
            new = np.add.reduceat(part, begin, axis=0) / n[open_, None]
            moving = np.abs(new - share[open_]).max(axis=1) >= SETTLED
            share[open_] = new
            if not moving.any():
                break
            if not moving.all():
                rows = np.repeat(moving, n[open_])
                open_, mine, where = open_[moving], mine[rows], where[rows]
                begin = np.concatenate([[0], np.cumsum(n[open_])[:-1]])
        fit_ = np.add.reduceat(np.log((like * share[whose]).sum(axis=1) + 1e-300), first) + base
        return share, fit_

    allowed = np.ones((len(texts), len(logs)))
    share, best = settle(allowed)
    penalty = 0.5 * np.log(n) + 2.0
    for _ in range(len(logs) - 1):
        fewer = allowed.copy()
        rare = np.where(allowed > 0, share, 2.0).argmin(axis=1)
        can = allowed.sum(axis=1) > 1
        fewer[np.arange(len(texts))[can], rare[can]] = 0
        other, fit_ = settle(fewer)
        better = can & (fit_ + penalty >= best)
        if not better.any():
            break
        allowed[better], share[better], best[better] = fewer[better], other[better], fit_[better]
    return share


def predict(docs: DataFrame, names: list[str], logs, carry: tuple = ()) -> DataFrame:
    """(doc_id, lang_pred, score): the likeliest language of the mixture and its proportion; then the columns to carry.

    UNKNOWN with score 0 if the text is null or has no letter, or if no language was learned. Ties go to the first
    name. Repeated rows are answered each. Carried columns come back as _c_ and their number, so no name can clash.
    """
    model = docs.sparkSession.sparkContext.broadcast((names, logs))
    kept = [f"_c_{i}" for i in range(len(carry))]
    texts_at = 1 + carry.index("text") if "text" in carry else -1

    def score(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        names, logs = model.value
        for batch in batches:
            texts = batch.column(texts_at if texts_at > 0 else batch.num_columns - 1).to_pylist()
            langs, scores = [UNKNOWN] * len(texts), np.zeros(len(texts))
            rows = [i for i, t in enumerate(texts) if names and t and has_letter(t)]
            part, size = [], 0
            for i in [*rows, None]:
                if part and (i is None or size > 1_000_000):
                    share = mixtures([texts[j] for j in part], logs)
                    for j, k, s in zip(part, share.argmax(axis=1).tolist(), share.max(axis=1).tolist(), strict=True):
                        langs[j], scores[j] = names[k], min(1.0, s)
                    part, size = [], 0
                if i is not None:
                    part.append(i)
                    size += len(texts[i])
            arrays = [batch.column(0), pa.array(langs, pa.string()), pa.array(scores), *[batch.column(1 + k) for k in range(len(kept))]]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "lang_pred", "score", *kept])

    types = [docs.schema[c].dataType.simpleString() for c in ("doc_id", *carry)]
    schema = f"doc_id {types[0]}, lang_pred string, score double" + "".join(f", {k} {t}" for k, t in zip(kept, types[1:], strict=True))
    sent = [F.col(f"`{c}`").alias(k) for c, k in zip(carry, kept, strict=True)] + ([] if texts_at > 0 else [F.col("text")])
    return docs.select("doc_id", *sent).mapInArrow(score, schema)


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    names, logs = fit(docs.filter(~held_out(F.col("doc_id"))))
    rows = predict(docs.select("doc_id", "text"), names, logs)
    return rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


#: A document whose likeliest language has less than this proportion is rejected.
LEAST = 0.3


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents without a letter (null and empty texts too), and those in no language for the most part, go.

    The model is fitted on the stage's own input, without the held-out third. Repeated rows and rows without an id are
    judged each; columns of any name come back unchanged; an empty table gives an empty one.
    """
    names, logs = fit(docs.select("doc_id", "text", "lang").filter(~held_out(F.col("doc_id"))))
    rows = predict(docs, names, logs, tuple(docs.columns)).filter((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= LEAST))
    return rows.select(*[F.col(f"_c_{i}").alias(c) for i, c in enumerate(docs.columns)])
