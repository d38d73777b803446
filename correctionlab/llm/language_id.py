"""Language identification with error-correcting output codes (operator 5).

Each language has a codeword of signs. For each bit of the codewords one binary classifier (logistic regression over hashed
byte n-grams) says on which side a text is. Decoding adds up the logistic losses of each codeword, a bit weighing as much as
its classifier is better than chance; the codeword with the least loss is the language. The score is that codeword's share
when losses are turned into probabilities, and an answer with less than half of it is ambiguous.

The classifiers learn from at most `SAMPLE_ROWS` rows in all, equally many of each language, picked by a hash of their
ids; whole texts, as in prediction.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from correctionlab.llm.common import uniform
from correctionlab.plans.sizing import cut_lineage

SAMPLE_ROWS = 2_400
BITS = 12                 # 2^BITS hashed n-grams
CHARS_AT_ONCE = 1 << 20
STEPS, RATE, DECAY = 150, 4.0, 1e-4
AMBIGUOUS = 0.5
UNKNOWN = "und"
LETTER_OR_NUMBER = re.compile(r"[^\W\d_]")


def has_letter(text: str | None) -> bool:
    """Whether some character is a letter; signs such as fractions and Roman or raised numbers are none."""
    return bool(text) and any(m.group().isalpha() for m in LETTER_OR_NUMBER.finditer(text))


def ngram_counts(text: str):
    """Counts of hashed 1-, 2- and 3-byte grams of a lowered text; what isn't a letter in ASCII counts as one space."""
    import numpy as np

    letters = bytes(c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
    counts = np.zeros(1 << BITS, np.float32)
    for at in range(0, max(len(text), 1), CHARS_AT_ONCE):
        raw = b" " + text[at:at + CHARS_AT_ONCE].lower().encode("utf-8", "replace").translate(letters) + b" "
        b = np.frombuffer(raw, np.uint8)
        b = b[(b != 32) | np.concatenate([[True], b[:-1] != 32])].astype(np.uint32)
        for n, seed in ((1, 1), (2, 3), (3, 5)):
            code = b[: len(b) - n + 1].copy()
            for k in range(1, n):
                code = code * np.uint32(256) + b[k: len(b) - n + 1 + k]
            code = (code + np.uint32(seed << 24)) * np.uint32(0x9E3779B1)
            counts += np.bincount(code >> np.uint32(32 - BITS), minlength=1 << BITS)
    return counts


def features(text: str):
    """Square roots of the counts at length one, so that texts of any length compare."""
    import numpy as np

    root = np.sqrt(ngram_counts(text))
    return (root / max(float(np.sqrt((root * root).sum())), 1e-9)).astype(np.float32)


def codewords(n: int):
    """A codeword of signs for each of n languages. All splits of up to 7 languages in two, which is the best code; beyond
    that, the best of 50 random codes of 64 bits by its least distance between codewords."""
    import numpy as np

    if n < 2:
        return np.zeros((n, 0), np.float32)
    if n <= 7:
        splits = range(1, 1 << (n - 1))  # the first language is always on the same side
        return np.array([[1.0] + [-1.0 if s >> (k - 1) & 1 else 1.0 for k in range(1, n)] for s in splits], np.float32).T
    rng, best, found = np.random.default_rng(5), -1, None
    for _ in range(50):
        code = rng.choice(np.array([-1.0, 1.0], np.float32), (n, 64))
        code = code[:, np.abs(code.sum(0)) < n]
        apart = (code.shape[1] - code @ code.T) / 2 + np.eye(n) * 1e9
        if apart.min() > best:
            best, found = apart.min(), code
    return found


def fit(labels: list[str], rows) -> dict:
    """Classifiers for the bits of the codewords of the languages in `labels`, from one row of features a label."""
    import numpy as np

    languages = sorted(set(labels))
    code = codewords(len(languages))
    sides = code[[languages.index(x) for x in labels]]
    weights, bias = np.zeros((rows.shape[1], code.shape[1]), np.float32), np.zeros(code.shape[1], np.float32)
    push = np.zeros_like(weights)
    for _ in range(STEPS if code.shape[1] else 0):
        pull = sides / (1 + np.exp(np.clip(sides * (rows @ weights + bias), -30, 30))) / len(labels)
        push = 0.9 * push + rows.T @ pull - DECAY * weights
        weights += RATE * push
        bias += RATE * pull.sum(0)
    right = ((rows @ weights + bias) * sides > 0).mean(0) if len(labels) else np.zeros(0)
    return {"languages": languages, "code": code, "weights": weights, "bias": bias, "trust": np.maximum(2 * right - 1, 1e-3).astype(np.float32)}


def decode(model: dict, rows):
    """For each row of features the best language's position and its score."""
    import numpy as np

    if not model["languages"]:
        return np.full(len(rows), -1), np.zeros(len(rows))
    margins = np.clip(rows @ model["weights"] + model["bias"], -30, 30)
    losses = np.stack([(np.log1p(np.exp(-margins * word)) * model["trust"]).sum(1) for word in model["code"]], axis=1)
    shares = np.exp(losses.min(1, keepdims=True) - losses)
    return losses.argmin(1), (1 / shares.sum(1)).astype(np.float64)


def train(docs: DataFrame, rows: int = SAMPLE_ROWS) -> dict:
    """A model from `docs` (doc_id, text, lang, ...): rows without a language or a letter are passed over.

    The counts of languages are few rows; with them, a fraction of each language's ids is taken that gives about twice
    its share of the bound, and the first by hash of those are kept. No labelled row gives a model that answers nothing.
    """
    import numpy as np

    known = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).select(F.col("doc_id").cast("string").alias("id"), "text", "lang")
    counts = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return fit([], np.zeros((0, 1 << BITS), np.float32))
    each = max(1, rows // len(counts))
    fraction = F.element_at(F.create_map(*[F.lit(x) for lang, n in counts.items() for x in (lang, min(1.0, 2 * each / n + 20 / n))]), F.col("lang"))

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            kept = [(i, lang, features(t).astype(np.float16).tobytes()) for i, lang, t in zip(*(batch.column(c).to_pylist() for c in ("place", "lang", "text"))) if has_letter(t)]
            for at in range(0, len(kept), 64):
                cols = list(zip(*kept[at:at + 64]))
                yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.float64()), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.binary())], names=["place", "lang", "features"])

    sample = known.withColumn("place", uniform(F.lit("language"), F.col("id"))).where(F.col("place") < fraction).select("place", "lang", "text")
    # one job over all partitions writes at most about 2 * rows + 20 a language; the first of each language come to the driver
    drawn = cut_lineage(sample.mapInArrow(run, "place double, lang string, features binary"), "training")
    first = Window.partitionBy("lang").orderBy("place", "features")
    chosen = drawn.withColumn("k", F.row_number().over(first)).where(F.col("k") <= each).orderBy("lang", "k").select("lang", "features").collect()
    table = np.zeros((len(chosen), 1 << BITS), np.float32)
    for k, r in enumerate(chosen):
        table[k] = np.frombuffer(r["features"], np.float16)
    return fit([r["lang"] for r in chosen], table)


def predict(model: dict) -> object:
    """A column function: text to struct(lang_pred, score). Null text and text without a letter are `und` with score 0."""
    import pyarrow as pa

    def run(texts):
        import numpy as np

        names, scores = [UNKNOWN] * len(texts), np.zeros(len(texts))
        for at in range(0, len(texts), 256):
            some = {at + k: t for k, t in enumerate(texts.slice(at, 256).to_pylist()) if has_letter(t)}
            if not some:
                continue
            best, score = decode(model, np.stack([features(t) for t in some.values()]))
            for k, b, s in zip(some, best, score):
                if b >= 0:
                    names[k], scores[k] = model["languages"][b], s
        return pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(scores)], names=["lang_pred", "score"])

    run.__annotations__ = {"texts": pa.Array, "return": pa.Array}
    return F.arrow_udf(run, "lang_pred string, score double")


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def identify(docs: DataFrame) -> DataFrame:
    """One row for each row of `docs` (doc_id, text, lang, ...): doc_id, held_out, lang_pred, score, ambiguous.

    Rows whose crc32 of the doc_id is 2 modulo 4 are held out of training. Only text decides a prediction. Other columns are ignored.
    """
    model = train(docs.where(~held_out(F.col("doc_id"))))
    told = docs.select(F.col("doc_id"), held_out(F.col("doc_id")).alias("held_out"), predict(model)(F.col("text")).alias("p"))
    return told.select("doc_id", "held_out", "p.lang_pred", "p.score", (F.col("p.score") < AMBIGUOUS).alias("ambiguous"))


def known_language(docs: DataFrame) -> DataFrame:
    """`docs` without those whose language can't be told: null or empty text, no letter, or an ambiguous answer.

    Rows are judged one by one, so repeated ones stay or go together; an empty table stays one, other columns stay as they are. A table
    without labels teaches nothing, and all its rows stay.
    """
    model = train(docs.where(~held_out(F.col("doc_id"))))
    if not model["languages"]:
        return docs
    answer = predict(model)(F.col("text"))
    return docs.where(answer["score"] >= AMBIGUOUS)
