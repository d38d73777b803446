"""Benchmark decontamination by retrieval (operator 6): BM25 over test items with block-max WAND, then a check of overlap.

Test items are cut into segments of at most `SEGMENT` words; the index holds, for each term, the segments that have it with their
BM25 weights, divided by the weight a segment has against itself. So a passage that holds a segment whole scores 1.
Segments stand in blocks of `BLOCK`; each term has its largest weight in each block.

Documents are read in passages of two steps of `STEP` words, each word being in two of them, so that a segment that a document
holds is whole in one passage. Each passage is a query. Its terms' largest weights are added up block by block, for all
passages of a batch at once; where a block's sum reaches the threshold, WAND walks the posting lists of that block: it stops
only at segments that the terms seen so far can still bring over the threshold. Everything over it is retrieved, there is no
top k. A retrieved item counts where enough of its question and of its answer stands in the document.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WORD = re.compile(r"[^\W_]+")
SEGMENT = STEP = 32
BLOCK = 8
THRESHOLD = 0.6
OVERLAP = 0.8
GRAM = 5
K1, B = 1.2, 0.75
# An index goes to every task: beyond these characters of test items there are several indexes, and a pass over the documents each.
INDEX_CHARS = 8_000_000
WORDS_AT_ONCE = 1 << 17


def words_of(text: str | None) -> list[str]:
    return WORD.findall((text or "").lower())


def question_and_answer(text: str | None) -> tuple[list[str], list[str]]:
    """The words of an item's question and of its answer: its last sentence, or where there is but one the last third of its words."""
    sentences = [w for s in re.split(r"[.!?]+(?:\s+|$)|\n+", text or "") if (w := words_of(s))]
    if len(sentences) > 1:
        return [w for s in sentences[:-1] for w in s], sentences[-1]
    every = sentences[0] if sentences else []
    cut = len(every) - len(every) // 3
    return every[:cut], every[cut:]


def grams(words: list[str], n: int = GRAM) -> set[tuple]:
    return {tuple(words[k:k + n]) for k in range(len(words) - n + 1)}


def overlap(part: list[str], document: dict[int, set]) -> float:
    """Share of a part's word `GRAM`-grams that stand in the document; a shorter part is one gram of its length, no word is all there."""
    n = min(GRAM, len(part))
    if not n:
        return 1.0
    mine = grams(part, n)
    return len(mine & document[n]) / len(mine)


class Index:
    """Segments of test items, their posting lists and the largest weights of each term in each block."""

    def __init__(self, items: list[tuple]):
        import numpy as np

        self.parts = {item: question_and_answer(text) for item, text in items}
        self.owners, segments = [], []
        for item, text in items:
            every = words_of(text)
            pieces = -(-len(every) // SEGMENT)
            for k in range(pieces):
                self.owners.append(item)
                segments.append(every[len(every) * k // pieces: len(every) * (k + 1) // pieces])
        found = Counter(t for s in segments for t in set(s))
        mean = sum(map(len, segments)) / max(1, len(segments))
        rare = {t: math.log(1 + (len(segments) - n + 0.5) / (n + 0.5)) for t, n in found.items()}
        self.terms = {t: k for k, t in enumerate(sorted(found))}
        self.postings: list[list] = [[] for _ in self.terms]
        for k, segment in enumerate(segments):
            weights = {t: rare[t] * n * (K1 + 1) / (n + K1 * (1 - B + B * len(segment) / mean)) for t, n in Counter(segment).items()}
            own = sum(weights.values())
            for t, w in weights.items():
                self.postings[self.terms[t]].append((k, w / own))
        # the last row stands for words that no item has
        self.most = np.zeros((len(self.terms) + 1, -(-len(segments) // BLOCK)), np.float32)
        self.by_block: list[dict] = [defaultdict(list) for _ in self.terms]
        for t, posting in enumerate(self.postings):
            for k, w in posting:
                self.most[t, k // BLOCK] = max(self.most[t, k // BLOCK], w)
                self.by_block[t][k // BLOCK].append((k, w))

    def wand(self, terms: list[int], block: int, threshold: float = THRESHOLD) -> list[tuple]:
        """All segments of a block that score at least `threshold` for the terms, with their scores."""
        lists = [(self.by_block[t][block], float(self.most[t, block])) for t in terms if block in self.by_block[t]]
        at = [0] * len(lists)
        out = []
        while True:
            live = sorted((lists[k][0][at[k]][0], k) for k in range(len(lists)) if at[k] < len(lists[k][0]))
            bound, pivot = 0.0, None
            for segment, k in live:
                bound += lists[k][1]
                if bound >= threshold - 1e-6:
                    pivot = segment
                    break
            if pivot is None:
                return out
            if live[0][0] == pivot:
                score = 0.0
                for segment, k in live:
                    if segment == pivot:
                        score += lists[k][0][at[k]][1]
                        at[k] += 1
                if score >= threshold - 1e-9:
                    out.append((pivot, score))
            else:
                for segment, k in live:
                    if segment < pivot:
                        while at[k] < len(lists[k][0]) and lists[k][0][at[k]][0] < pivot:
                            at[k] += 1

    def retrieve(self, documents: list[list[str]]) -> list[dict]:
        """For each document (its words) the items over the threshold, with the best score of their segments."""
        import numpy as np

        none, get = len(self.terms), self.terms.get
        found: list[dict] = [{} for _ in documents]
        if not self.owners:
            return found
        lengths = [-(-len(d) // STEP) for d in documents]
        first = np.concatenate([[0], np.cumsum(lengths)])
        step_of = np.concatenate([np.repeat(np.arange(first[k], first[k + 1]), STEP)[:len(d)] for k, d in enumerate(documents)] or [np.zeros(0, np.int64)])
        ids = np.array([get(w, none) for d in documents for w in d], np.int64)
        known = ids < none
        pairs = np.unique(step_of[known] * (none + 1) + ids[known])  # a term counts once in a step
        step, term = pairs // (none + 1), pairs % (none + 1)
        sums = np.zeros((int(first[-1]) + 1, self.most.shape[1]), np.float32)
        if len(pairs):
            begins = np.flatnonzero(np.concatenate([[True], step[1:] != step[:-1]]))
            sums[step[begins]] = np.add.reduceat(self.most[term], begins, axis=0)
        # a passage is a step and the next one of the same document; over a document's end the sum is only larger
        hot, block = np.nonzero(sums[:-1] + sums[1:] >= THRESHOLD - 1e-4)
        owner = np.searchsorted(first, hot, side="right") - 1
        for s, b, d in zip(hot.tolist(), block.tolist(), owner.tolist()):
            end = min(s + 2, int(first[d + 1]))
            lo, hi = np.searchsorted(step, [s, end])
            for segment, score in self.wand(sorted(set(term[lo:hi].tolist())), b):
                item = self.owners[segment]
                found[d][item] = max(found[d].get(item, 0.0), score)
        return found

    def leaks(self, documents: list[list[str]]) -> list[list[tuple]]:
        """For each document the items it holds: (item, score, overlap of the question, of the answer)."""
        out = []
        for d, items in zip(documents, self.retrieve(documents)):
            mine = []
            if items:
                document = {n: grams(d, n) for n in range(1, GRAM + 1)}
                for item, score in sorted(items.items()):
                    question, answer = self.parts[item]
                    if (q := overlap(question, document)) >= OVERLAP and (a := overlap(answer, document)) >= OVERLAP:
                        mine.append((item, score, q, a))
            out.append(mine)
        return out


def item_groups(benchmark: DataFrame, most: int = INDEX_CHARS) -> Iterator[list[tuple]]:
    """The test items (item_id, text) in groups of at most `most` characters, or one item; null texts and repeated rows are left out.

    One group at a time is on the driver.
    """
    rows = benchmark.where(F.col("text").isNotNull()).select(F.col("item_id").cast("long").alias("item_id"), "text").distinct().orderBy("item_id", "text")
    group, size = [], 0
    for r in rows.toLocalIterator():
        if group and size + len(r["text"]) > most:
            yield _unique(group)
            group, size = [], 0
        group.append((r["item_id"], r["text"]))
        size += len(r["text"])
    yield _unique(group)


def _unique(items: list[tuple]) -> list[tuple]:
    """Different texts under one item_id are one item after another; a null item_id is -1."""
    joined: dict = {}
    for item, text in items:
        item = -1 if item is None else item
        joined[item] = f"{joined[item]}\n{text}" if item in joined else text
    return list(joined.items())


def find_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Pairs (doc_id, item_id, score, question_overlap, answer_overlap): test items that documents hold.

    Null and empty texts hold nothing. Documents are read whole, in batches of bounded size; repeated rows give repeated pairs. Items without a
    word are held by none. Other columns are ignored. An empty benchmark finds nothing.
    """
    schema = "doc_id long, item_id long, score double, question_overlap double, answer_overlap double"
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    found = None
    for items in item_groups(benchmark):
        shared = docs.sparkSession.sparkContext.broadcast(items)
        part = docs.mapInArrow(_finder(shared), schema)
        found = part if found is None else found.unionByName(part)
    return found


def _finder(shared):
    def run(batches):
        import pyarrow as pa

        index = Index(shared.value)
        for batch in batches:
            held, size = [], 0
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
                held.append((doc_id, words_of(text.as_py())))
                size += len(held[-1][1])
                if size >= WORDS_AT_ONCE:
                    yield _pairs(pa, index, held)
                    held, size = [], 0
            if held:
                yield _pairs(pa, index, held)

    return run


def _pairs(pa, index, held):
    rows = [(doc_id, *leak) for (doc_id, _), leaks in zip(held, index.leaks([w for _, w in held])) for leak in leaks]
    types = (pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64())
    names = ["doc_id", "item_id", "score", "question_overlap", "answer_overlap"]
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], names=names)


def decontaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """`docs` without those that hold a test item."""
    groups = [docs.sparkSession.sparkContext.broadcast(g) for g in item_groups(benchmark)]
    for shared in groups:
        docs = docs.where(~_holds(shared)(F.col("text")))
    return docs


def _holds(shared):
    import pyarrow as pa

    def run(parts):
        index = Index(shared.value)
        for texts in parts:
            out, held, size = [], [], 0
            for text in texts:
                held.append(words_of(text.as_py()))
                size += len(held[-1])
                if size >= WORDS_AT_ONCE:
                    out += map(bool, index.leaks(held))
                    held, size = [], 0
            out += map(bool, index.leaks(held)) if held else []
            yield pa.array(out, pa.bool_())

    run.__annotations__ = {"parts": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(run, "boolean")
