"""Secret scans with a random forest that removes false positives (operator 3).

Candidates are long runs of the characters that keys and tokens are made of, and whatever is assigned to a name of a secret. Each is described by its length, by how its
characters change (between letters, digits and cases; how surprising a letter is after the one before it in words), by how much
of it a dictionary covers, by whether it stands in a path or an address, and by the words beside it. A random forest that
learned from labelled findings gives the probability that it is a secret.

Labelled findings are rows (before, candidate, after, label). `corpus_findings` takes them from documents: a value assigned to
a name of a secret is one, other candidates are none. `drawn_findings` adds kinds of findings that are rare in a
corpus, such as digests, UUIDs and paths on one side and keys of known services on the other. Both are bounded.
"""

from __future__ import annotations

import math
import random
import re
import string
from collections import Counter

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from correctionlab.llm.common import uniform
from correctionlab.plans.sizing import cut_lineage

SHORTEST = 16
# `=` only ends a candidate, as padding, and where a candidate may begin after NAME=
RUN = re.compile(rf"(?<![A-Za-z0-9+/_.-])[A-Za-z0-9+/_.-]{{{SHORTEST},}}(?:={{1,2}}(?![A-Za-z0-9+/_.=-]))?")
CONTEXT = 48                 # characters on each side of a candidate
SAMPLE_DOCS = 4_000          # documents from which labelled findings are taken, by a hash of their ids
SAMPLE_FINDINGS = 3_000      # findings of each label that the forest learns from
WORD_SHARE = 250_000         # a dictionary word is at least one of so many words of the whole corpus: no more than that many words
PAIR_SHARE = 1_000_000       # the same for letter pairs
LONGEST_WORD = 12            # letters of a word that coverage looks for
RARE = 10.0                  # bits that a rarer letter pair costs
DRAWN_EACH = 40
TREES, DEPTH, SEED = 24, 6, 3
SECRET_BAR = 0.5

# Names that secrets are assigned to, and words that stand beside other long strings.
SECRET_WORDS = ("secret", "token", "password", "passwd", "pwd", "apikey", "api", "key", "auth", "bearer", "credential", "private", "access")
OTHER_WORDS = ("sha", "sha1", "sha256", "md5", "digest", "checksum", "commit", "hash", "uuid", "guid", "id", "example", "sample", "integrity", "etag", "revision", "ref")
NAME = r"(?<![A-Za-z0-9])(?:secret|token|password|passwd|pwd|api[_-]?key|auth|access[_-]?key|private[_-]?key|secret[_-]?key|credential)s?"
ASSIGNED = re.compile(rf"(?i){NAME}[\"']?\s*(?:=>|:=|=|:)\s*[\"']?$")
# a value in quotes under a name of a secret, or one without quotes up to white space; of any length and characters
VALUE = re.compile(rf"(?i){NAME}[\"']?[^\S\n]*(?:=>|:=|=|:)[^\S\n]*(?:\"((?:[^\"\\\n]|\\.)+)\"|'((?:[^'\\\n]|\\.)+)'|([^\s\"',;]+))")

FEATURES = (
    "length", "entropy", "digit_share", "upper_share", "hex_share", "class_changes", "case_changes", "repeats", "surprise",
    "coverage", "slashes", "dots", "in_address", "extension", "assigned", "quoted", "secret_words", "other_words", "letters_beside",
)


def _class(c: str) -> int:
    return 0 if c.islower() else 1 if c.isupper() else 2 if c.isdigit() else 3


class Lexicon:
    """Words of a corpus and how often a letter follows another in them."""

    def __init__(self, words: dict[str, int], pairs: dict[str, int] | None = None, firsts: dict[str, int] | None = None):
        """`pairs` and `firsts` count letter pairs and their first letters; without them they are counted in `words`."""
        self.words = frozenset(w for w in words if len(w) >= 3)
        if pairs is None:
            pairs, firsts = Counter(), Counter()
            for word, n in words.items():
                for a, b in zip(word, word[1:]):
                    pairs[a + b] += n
                    firsts[a] += n
        self.cost = {p: -math.log2((n + 0.5) / (firsts[p[0]] + 18.0)) for p, n in pairs.items()}

    def surprise(self, text: str) -> float:
        low = text.lower()
        return sum(self.cost.get(low[k:k + 2], RARE) for k in range(len(low) - 1)) / max(1, len(low) - 1)

    def coverage(self, text: str) -> float:
        """Share of the characters that words of the dictionary cover, the longest first from the left."""
        low, at, covered = text.lower(), 0, 0
        while at < len(low):
            n = next((n for n in range(min(LONGEST_WORD, len(low) - at), 2, -1) if low[at:at + n] in self.words), 0)
            covered, at = covered + n, at + max(n, 1)
        return covered / max(1, len(low))


def describe(before: str, candidate: str, after: str, lexicon: Lexicon) -> list[float]:
    """The features of one candidate, in the order of `FEATURES`."""
    n = len(candidate)
    counts = Counter(candidate)
    kinds = [_class(c) for c in candidate]
    beside = Counter(w for side in (before, after) for w in re.findall(r"[a-z0-9]+", re.sub(r"([a-z])([A-Z])", r"\1 \2", side).lower()))
    return [
        float(n),
        -sum(k / n * math.log2(k / n) for k in counts.values()),
        kinds.count(2) / n,
        kinds.count(1) / n,
        sum(c in string.hexdigits for c in candidate) / n,
        sum(a != b for a, b in zip(kinds, kinds[1:])) / n,
        sum({a, b} == {0, 1} for a, b in zip(kinds, kinds[1:])) / n,
        sum(a == b for a, b in zip(candidate, candidate[1:])) / n,
        lexicon.surprise(candidate),
        lexicon.coverage(candidate),
        float(candidate.count("/")),
        float(candidate.count(".")),
        float(bool(re.search(r"(?:://|www\.|[/\\])$|://\S*$", before))),
        float(bool(re.search(r"\.[A-Za-z]{1,5}$", candidate) or re.match(r"\.[a-z]{1,5}\b", after))),
        float(bool(re.search(r"[=:]\s*[\"']?$", before))),
        float(before[-1:] in "\"'`" and after[:1] in "\"'`" and bool(before) and bool(after)),
        float(sum(beside[w] for w in SECRET_WORDS)),
        float(sum(beside[w] for w in OTHER_WORDS)),
        sum(c.isalpha() for c in before + after) / max(1, len(before) + len(after)),
    ]


def candidates(text: str | None):
    """(start, end, before, candidate, after) for each candidate of a text, in order: values under a name of a secret, and long runs beside them."""
    text = text or ""
    values = [m.span(m.lastindex) for m in VALUE.finditer(text)]
    k, spans = 0, list(values)
    for m in RUN.finditer(text):
        while k < len(values) and values[k][1] <= m.start():
            k += 1
        if k == len(values) or values[k][0] >= m.end():
            spans.append(m.span())
    for start, end in sorted(spans):
        yield start, end, text[max(0, start - CONTEXT):start], text[start:end], text[end:end + CONTEXT]


def drawn_findings(each: int = DRAWN_EACH, seed: int = SEED) -> list[tuple]:
    """Labelled findings drawn by rule: (before, candidate, after, label)."""
    r = random.Random(seed)
    some = lambda alphabet, n: "".join(r.choice(alphabet) for _ in range(n))
    hexa, mixed = "0123456789abcdef", string.ascii_letters + string.digits
    words = ("src", "main", "build", "assets", "images", "report", "module", "service", "handler", "release", "stable", "config")
    out = []
    for _ in range(each):
        uuid = "-".join(some(hexa, n) for n in (8, 4, 4, 4, 12))
        out += [
            ('api_key = "', some(mixed, 32), '"', 1), ("password: '", some(mixed + "+/_-", 24), "'", 1), ("Authorization: Bearer ", some(mixed, 40), "\n", 1),
            ('aws_access_key_id = "', "AKIA" + some(string.ascii_uppercase + string.digits, 16), '"', 1), ("export GITHUB_TOKEN=", "ghp_" + some(mixed, 36), "\n", 1),
            ('"client_secret": "', some(hexa, 40), '",', 1), ("the commit ", some(hexa, 40), " fixed it", 0), ("sha256: ", some(hexa, 64), "\n", 0),
            ("md5 checksum ", some(hexa, 32), " of the file", 0), ('id="', uuid, '"', 0), ("see https://example.com/", "/".join(r.choice(words) for _ in range(4)) + ".html", " for more", 0),
            ("in ", "/".join(r.choice(words) for _ in range(5)) + ".py", " the", 0), ("class ", "".join(r.choice(words).title() for _ in range(4)), " is", 0),
            ("", "-" * r.randint(16, 60), "\n", 0), ("card ", some(string.digits, 16), " paid", 0), ("call ", "_".join(r.choice(words) for _ in range(4)), "(x)", 0),
            ('api_key = "', "your-api-key-goes-here", '"', 0), ("password: '", "x" * r.randint(16, 24), "'", 0),
        ]
    return out


def sample_of(docs: DataFrame, rows: int = SAMPLE_DOCS) -> DataFrame:
    """About `rows` documents (doc_id, text), by a hash of their ids; the same ones in each run."""
    share = min(1.0, rows / max(1, docs.count()))
    return docs.where(uniform(F.lit("secrets"), F.col("doc_id").cast("string")) < share).select("doc_id", "text")


def corpus_lexicon(docs: DataFrame) -> Lexicon:
    """The lexicon of all of `docs`: words of 2 to 24 letters and their letter pairs, counted on the executors.

    What comes to the driver are the words and pairs with the shares above, whatever the size of the corpus.
    """
    words = cut_lineage(
        docs.select(F.explode(F.split(F.lower("text"), r"[^\p{L}]+")).alias("word")).where(F.length("word").between(2, 24))
        .groupBy("word").agg(F.count("*").alias("n")), "words")
    ats = F.sequence(F.lit(1), F.length("word") - 1)
    pairs = cut_lineage(
        words.select("n", F.explode(F.transform(ats, lambda k: F.col("word").substr(k, F.lit(2)))).alias("pair"))
        .groupBy("pair").agg(F.sum("n").alias("n")), "pairs")
    in_words, in_pairs = (t.agg(F.sum("n")).first()[0] or 0 for t in (words, pairs))
    firsts = pairs.groupBy(F.substring("pair", 1, 1).alias("first")).agg(F.sum("n").alias("of"))
    kept_pairs = pairs.where(F.col("n") * PAIR_SHARE >= in_pairs).withColumn("first", F.substring("pair", 1, 1)).join(firsts, "first").collect()
    kept_words = words.where((F.col("n") * WORD_SHARE >= in_words) & F.length("word").between(3, LONGEST_WORD)).select("word", "n").collect()
    return Lexicon({r["word"]: r["n"] for r in kept_words}, {r["pair"]: r["n"] for r in kept_pairs}, {r["first"]: r["of"] for r in kept_pairs})


def corpus_findings(docs: DataFrame, each: int = SAMPLE_FINDINGS) -> list[tuple]:
    """Labelled findings of a bounded sample of `docs`, at most `each` of a label.

    Findings are reduced on the executors; what comes to the driver is bounded by the parameters.
    """
    sample = sample_of(docs)

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            rows = [(b, c, a, int(bool(ASSIGNED.search(b)))) for text in batch.column("text").to_pylist() for _, _, b, c, a in candidates(text)]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.string(), pa.string(), pa.string(), pa.int32()))], names=["before", "candidate", "after", "label"])

    found = sample.select("text").mapInArrow(run, "before string, candidate string, after string, label int").withColumn("place", F.xxhash64("before", "candidate", "after"))
    return [tuple(r)[:4] for label in (0, 1) for r in found.where(F.col("label") == label).distinct().orderBy("place", "before", "candidate", "after").limit(each).collect()]


def train(spark, findings: list[tuple], lexicon: Lexicon):
    """A random forest from labelled findings (before, candidate, after, label). Both labels are needed."""
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.feature import VectorAssembler

    rows = [(*describe(b, c, a, lexicon), float(label)) for b, c, a, label in sorted(findings)]
    table = spark.createDataFrame(rows, ", ".join(f"{f} double" for f in (*FEATURES, "label"))).coalesce(1)
    table = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(table)
    return RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, seed=SEED, cacheNodeIds=False).fit(table)


def found_candidates(docs: DataFrame, lexicon: Lexicon) -> DataFrame:
    """One row for each candidate: doc_id, start, end (code points), and its features."""
    shared = docs.sparkSession.sparkContext.broadcast(lexicon)

    def run(batches):
        import pyarrow as pa

        names = ["doc_id", "start", "end", *FEATURES]
        types = [pa.int64()] * 3 + [pa.float64()] * len(FEATURES)
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
                for start, end, b, c, a in candidates(text.as_py()):
                    rows.append((doc_id, start, end, *describe(b, c, a, shared.value)))
                    if len(rows) == 5_000:
                        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), types)], names=names)
                        rows = []
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), types)], names=names)

    schema = "doc_id long, start long, end long, " + ", ".join(f"{f} double" for f in FEATURES)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)


def scan_secrets(docs: DataFrame, findings: list[tuple] | None = None) -> DataFrame:
    """One row for each candidate of `docs` (doc_id, text, ...): doc_id, start, end, score, secret.

    `findings` are labelled findings to learn from; without them they come from a sample of `docs` itself. Null and empty texts
    have no candidate. Texts are read whole. Repeated rows give repeated candidates. Other columns are ignored.
    """
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array

    lexicon = corpus_lexicon(docs)
    model = train(docs.sparkSession, (corpus_findings(docs) if findings is None else findings) + drawn_findings(), lexicon)
    rows = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(found_candidates(docs, lexicon))
    scored = model.transform(rows).withColumn("score", F.round(vector_to_array("probability")[1], 9))
    return scored.select("doc_id", "start", "end", "score", (F.col("score") >= SECRET_BAR).alias("secret"))
