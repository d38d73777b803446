"""Cross-tokenizer alignment (operator 12): interval coalescing of two tokenizers' tokens over the bytes of a text.

All tokens of A and B are sorted by start (lexsort); where a token's start reaches the running maximum of the ends before it, no
token crosses, and a new group begins. Within a group, the B tokens that overlap an A token are a range, found by two binary
searches and expanded.

Both tokenizers start anew at a lone space between two characters that aren't white space, so a text is the sequence of its
segments between such spaces, each with the space before it. A worker aligns the segments of a batch that it hasn't met, all in
one pass over one line of them, and keeps what it learned of short ones; a text is then a look-up of its segments. That the
tokenizers do start anew is checked when they are loaded.

How often an id pair is linked in the whole corpus is a table of pairs. A document's pairs are looked up in it by a join:
pairs that are in more than a 100,000th of all document-pair rows are at most 100,000, and meet the documents by a broadcast; for
the others, none of which is frequent, both sides are shuffled.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from correctionlab.plans.sizing import cut_lineage

FREQUENT_PAIRS = 100_000
CACHED_SEGMENTS = 200_000
CACHED_CHARS = 64
ALIGNED = ("row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, "
           "pairs array<long>, times array<int>")


def byte_alphabet() -> dict[str, int]:
    """The public byte-level alphabet: printable bytes stand for themselves, the others for the characters from 256 on, in order."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {**{chr(b): b for b in shown}, **{chr(256 + k): b for k, b in enumerate(hidden)}}


class ByteLevel:
    """Byte-level BPE from a tokenizers file. Merges are done by tiktoken, from the ranks and the pattern of that file.

    Characters are probed when they are first met: where the two libraries disagree on one, texts that hold it
    are encoded by the tokenizers library.
    """

    PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

    def __init__(self, path: str):
        import json

        import tiktoken
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        self.whole = Tokenizer.from_file(path)
        self.whole.encode_special_tokens = True
        letters = byte_alphabet()
        special = {t.content for t in self.whole.get_added_tokens_decoder().values()}
        vocabulary = self.whole.get_vocab(with_added_tokens=True)
        self.bytes = [b""] * (max(vocabulary.values()) + 1)
        for token, i in vocabulary.items():
            if token not in special:
                self.bytes[i] = bytes(letters[c] for c in token)
        merged = ["".join(m) if isinstance(m, list) else m.replace(" ", "") for m in model["merges"]]
        ids = [model["vocab"][token] for token in merged]
        ranks = {self.bytes[i]: i for token, i in model["vocab"].items() if token not in special}
        self.fast = None
        # ranks stand for merges only if ids count up in their order, behind those of the bytes
        if ids == sorted(ids) and all(len(self.bytes[i]) == 1 for i in ranks.values() if not ids or i < ids[0]):
            self.fast = tiktoken.Encoding("own", pat_str=self.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.known, self.odd = set(), set()

    def _probe(self, characters: set[str]) -> None:
        for c in characters:
            probe = f" a{c} {c}{c}1{c}!{c}\n{c}'s{c} {c} \t{c}"
            (self.known if self.fast.encode_ordinary(probe) == self._slow(probe) else self.odd).add(c)

    def _slow(self, text: str) -> list[int]:
        return self.whole.encode_batch_fast([text], add_special_tokens=False)[0].ids

    def encode(self, text: str) -> list[int]:
        if self.fast is None:
            return self._slow(text)
        met = set(text)
        self._probe(met - self.known - self.odd)
        return self._slow(text) if met & self.odd else self.fast.encode_ordinary(text)


class Pieces:
    """A sentencepiece model with byte fallback; it adds the space before a text itself."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        names = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        self.bytes = [bytes([int(p[3:5], 16)]) if self.model.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(names)]
        self.starts_anew = all("▁" not in p.lstrip("▁") for p in names)

    def encode(self, text: str) -> list[int]:
        return self.model.encode(text, num_threads=1)


def coalesce(starts, ends, n_a: int):
    """For tokens of A, then of B, each in order: the group of each token, and the linked tokens (places in A, places in B)."""
    import numpy as np

    side = np.arange(len(starts)) >= n_a
    order = np.lexsort((side, starts))
    reached = np.maximum.accumulate(ends[order])
    breaks = np.append(False, starts[order][1:] >= reached[:-1])[:len(order)]
    group = np.empty(len(starts), np.int64)
    group[order] = np.cumsum(breaks)
    first = np.searchsorted(ends[n_a:], starts[:n_a], "right")
    count = np.searchsorted(starts[n_a:], ends[:n_a], "left") - first
    a = np.repeat(np.arange(n_a), count)
    b = np.arange(len(a)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(first, count)
    return group, a, b


class Aligner:
    """Aligns texts by two tokenizers; what it learned of short segments serves later texts."""

    APART = re.compile(r"(?<=\S) (?=\S)")

    def __init__(self, path_a: str, path_b: str, cached: int = CACHED_SEGMENTS):
        import numpy as np

        self.a, self.b, self.cached = ByteLevel(path_a), Pieces(path_b), cached
        self.size_a, self.size_b = (np.array([len(x) for x in t.bytes], np.int64) for t in (self.a, self.b))
        # ids as text behind what separates them from the id before: a comma, the sides' bar, the groups' semicolon
        self.shown = [sep + str(i) for sep in ",|;" for i in range(max(len(self.size_a), len(self.size_b)))]
        self.met: dict[str, tuple | None] = {}

    def segments(self, text: str) -> list[str]:
        if not self.b.starts_anew or "▁" in text:
            return [text]
        apart = text.split(" ")
        return apart if " ".join(text.split()) == text else self.APART.split(text)

    def _line(self, segments: list[str]) -> list[tuple] | None:
        """What there is to know of each segment: (tokens of A, of B, groups, links, groups as text, linked pairs), or None if bytes differ."""
        import numpy as np

        line = " " + " ".join(segments)
        raw = line.encode()
        ids_a, ids_b = self.a.encode(line), self.b.encode(line[1:])
        if any(b"".join(map(t.bytes.__getitem__, ids)) != raw for t, ids in ((self.a, ids_a), (self.b, ids_b))):
            return None
        ids_a, ids_b = np.array(ids_a, np.int64), np.array(ids_b, np.int64)
        ends_a, ends_b = np.cumsum(self.size_a[ids_a]), np.cumsum(self.size_b[ids_b])
        starts_a, starts_b = ends_a - self.size_a[ids_a], ends_b - self.size_b[ids_b]
        group, la, lb = coalesce(np.concatenate([starts_a, starts_b]), np.concatenate([ends_a, ends_b]), len(ids_a))
        ids = np.concatenate([ids_a, ids_b])
        side = np.arange(len(ids)) >= len(ids_a)
        order = np.lexsort((np.arange(len(ids)), side, group))
        g, s = group[order], side[order]
        sep = np.zeros(len(ids), np.int64)
        sep[1:] = np.where(g[1:] != g[:-1], 2, np.where(s[1:] != s[:-1], 1, 0))
        sep[:1] = 2
        told = list(map(self.shown.__getitem__, (sep * (len(self.shown) // 3) + ids[order]).tolist()))
        pairs = ids_a[la] << 32 | ids_b[lb]
        ends = np.cumsum([len(x.encode()) + 1 for x in segments])
        cuts_a, cuts_b = np.searchsorted(ends_a, ends) + 1, np.searchsorted(ends_b, ends) + 1
        if (ends_a[cuts_a - 1] != ends).any() or (ends_b[cuts_b - 1] != ends).any():
            raise ValueError("a tokenizer doesn't start anew at a space")
        cuts_t = cuts_a + cuts_b
        cuts_g = group[cuts_a - 1] + 1
        cuts_l = np.searchsorted(la, cuts_a)
        out, last = [], (0, 0, 0, 0, 0)
        for now in zip(cuts_a.tolist(), cuts_b.tolist(), cuts_g.tolist(), cuts_l.tolist(), cuts_t.tolist()):
            out.append((now[0] - last[0], now[1] - last[1], now[2] - last[2], now[3] - last[3], "".join(told[last[4]:now[4]])[1:], pairs[last[3]:now[3]]))
            last = now
        return out

    def _learn(self, new: list[str]) -> None:
        # white space at an end would run together with the next segment's space
        apart = [x for x in new if x[:1].isspace() or x[-1:].isspace() or "▁" in x]
        alone = set(apart)
        joined = [x for x in new if x not in alone]
        for lo in range(0, len(joined), 4_000):
            some = joined[lo:lo + 4_000]
            told = self._line(some)
            if told is None:  # some bytes differ
                apart += some
            else:
                self.met.update(zip(some, told))
        for x in apart:
            self.met[x] = (self._line([x]) or [None])[0]

    def align(self, texts: list[str | None]) -> list[tuple]:
        """For each text (n_a, n_b, n_groups, n_links, groups as text, pairs, how often each is linked)."""
        import numpy as np

        cut = [self.segments(t) if t else [] for t in texts]
        if len(self.met) > self.cached:
            self.met = {}
        self._learn(list(dict.fromkeys(x for segments in cut for x in segments if x not in self.met)))
        out, none = [], (0, 0, 0, 0, "", np.zeros(0, np.int64), np.zeros(0, np.int32))
        for segments in cut:
            found = list(map(self.met.__getitem__, segments))
            if not found or None in found:
                out.append(none)
                continue
            n_a, n_b, n_groups, n_links, told, pairs = zip(*found)
            pairs, times = np.unique(np.concatenate(pairs), return_counts=True)
            out.append((sum(n_a), sum(n_b), sum(n_groups), sum(n_links), ";".join(told), pairs, times.astype(np.int32)))
        for segments in cut:
            for x in segments:
                if len(x) > CACHED_CHARS:
                    self.met.pop(x, None)
        return out


def worker_aligner(path_a: str, path_b: str) -> Aligner:
    """One aligner a Python worker: what it learned serves all tasks that the worker runs."""
    import tokenizers

    kept = tokenizers.__dict__.setdefault("_aligners_of_this_worker", {})
    if (path_a, path_b) not in kept:
        kept[path_a, path_b] = Aligner(path_a, path_b)
    return kept[path_a, path_b]


def aligned(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """One row for each row of `docs`: a row number, doc_id, the sizes, groups_sha256, and its distinct linked pairs (A id * 2^32 + B id) with
    how often each is linked."""

    def run(batches):
        import hashlib

        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext

        aligner, row = worker_aligner(path_a, path_b), TaskContext.get().partitionId() << 40
        for batch in batches:
            ids = batch.column("doc_id")
            for lo in range(0, len(ids), 256):
                done = aligner.align(batch.column("text").slice(lo, 256).to_pylist())
                sizes = np.array([x[:4] for x in done], np.int64).reshape(-1, 4)
                digests = [hashlib.sha256(x[4].encode()).hexdigest() if x[0] else "" for x in done]
                ends = pa.array(np.concatenate([[0], np.cumsum([len(x[5]) for x in done])]).astype(np.int32))
                pairs, times = (pa.ListArray.from_arrays(ends, pa.array(np.concatenate([x[k] for x in done]))) for k in (5, 6))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.arange(row, row + len(done))), ids.slice(lo, 256), *(pa.array(sizes[:, k]) for k in range(4)), pa.array(digests, pa.string()), pairs, times],
                    names=["row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "times"])
                row += len(done)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, ALIGNED)


def pair_counts(rows: DataFrame) -> DataFrame:
    """(pair, n, docs, best) over all rows of `aligned`: links, documents, and whether no A id is linked to the pair's B id more often."""
    counts = cut_lineage(_pairs(rows).groupBy("pair").agg(F.sum("times").alias("n"), F.count("*").alias("docs")), "pairs")
    b = F.col("pair").bitwiseAND(F.lit((1 << 32) - 1).cast("long")).alias("b")
    highest = counts.groupBy(b).agg(F.max("n").alias("highest"))  # a row for each id of B's vocabulary
    return cut_lineage(counts.withColumn("b", b).join(highest, "b").select("pair", "n", "docs", (F.col("n") == F.col("highest")).alias("best")), "pairs")


def _pairs(rows: DataFrame) -> DataFrame:
    return rows.select("row", F.explode(F.arrays_zip("pairs", "times")).alias("p")).select("row", F.col("p.pairs").alias("pair"), F.col("p.times").cast("long").alias("times"))


def align_tokenizers(docs: DataFrame, path_a: str, path_b: str, frequent: int = FREQUENT_PAIRS) -> DataFrame:
    """One row for each row of `docs` (doc_id, text, ...): doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    A is a byte-level BPE file of the tokenizers library and encodes space+text, B a sentencepiece model and encodes the text. Null and
    empty texts, and those whose bytes a tokenizer doesn't give back, have zeros and an empty digest. Rows that repeat a doc_id have rows of
    their own and count each; null ids stay null. An empty table gives none. Other columns are ignored.
    """
    rows = cut_lineage(aligned(docs, path_a, path_b), "aligned")
    counts = pair_counts(rows)
    total = counts.agg(F.sum("docs")).first()[0] or 0
    often = F.col("docs") * frequent >= total  # true of at most `frequent` pairs, as their `docs` add up to `total`
    held = _pairs(rows)
    hot = F.broadcast(counts.where(often).select("pair", "n", "best"))
    sums = [F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("times") * F.col("n")).alias("count_sum")]
    near = held.join(hot, "pair").groupBy("row").agg(*sums)  # whole on the map side, where a row's pairs stand together
    rare = held.join(hot.select("pair"), "pair", "left_anti").join(counts.where(~often).select("pair", "n", "best"), "pair").groupBy("row").agg(*sums)
    told = near.unionByName(rare).groupBy("row").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    return rows.drop("pairs", "times").join(told, "row", "left").select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", F.coalesce("n_best", F.lit(0)).alias("n_best"), F.coalesce("count_sum", F.lit(0)).alias("count_sum"), "groups_sha256")
