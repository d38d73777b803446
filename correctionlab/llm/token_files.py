"""Token ids in files of independent zstandard frames (operator 7).

Documents are sorted by id into ranges; each range becomes one file:

    frame, frame, ...          ids as little-endian unsigned 32-bit integers; a document begins a frame of its own and has
                               further ones past FRAME_IDS ids
    skippable frame 0x184D2A50 what is in the file: for each document its id (signed 64 bit, with a byte that is 0 for null), the
                               number of its frames and of its ids
    skippable frame 0x184D2A5E seek table: for each frame its compressed size, its size and the low 32 bits of the XXH64 of its
                               content; then the number of frames, the descriptor byte (0x80: with checksums) and 0x8F92EAB1

The seek table is the one of the public zstandard seekable format, so other readers can use the files; any zstandard decoder
reads them from the start, passing over what is skippable. To read a document, a reader needs the end of the file and
that document's frames.

A task writes under a name of its own and renames the file when it is complete, so a task that runs again, or twice at once,
leaves one whole file. What is written is checked against the tasks' reports before it is read.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from correctionlab.plans.sizing import cut_lineage, scratch_path

END_ID = 1
FRAME_IDS = 1 << 20
LEVEL = 3
CACHED_WORDS = 400_000
SEPARATORS = "\x1c\x1d\x1e\x1f"  # white space to Python's split, but not to tokenizers
INDEX_MAGIC, SEEK_MAGIC, SEEK_END = 0x184D2A50, 0x184D2A5E, 0x8F92EAB1
INDEX_ROW, INDEX_ROW_BYTES = "<Bqqq", 25
TAIL, TAIL_BYTES = "<IBI", 9
MADE = "file string, part int, documents long, ids long, frames long"
READ = "doc_id long, part int, start_in_part long, n_tokens long, ids_crc32 long"


class WordEncoder:
    """Encodes texts with a tokenizer that drops white space and ends each word with a token of its own, word by word.

    Such a tokenizer gives a text's ids as those of its words in turn. Ids are kept as bytes in the form they have in files, so a
    text is a lookup of its words and one join. The new words of a batch go to the library together: those of letters
    only as one text, which its word ends divide again, the others one by one. Words are looked up in lower case, and a
    final comma or stop is encoded apart. Texts for which that may differ from the whole (special tokens, separators, text that isn't
    in normal form C, capital sigma or dotted capital I, whose lower case depends on more than the letter) are encoded whole.
    """

    def __init__(self, path: str, cached_words: int = CACHED_WORDS):
        import numpy as np
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.cached_words = cached_words
        self.words: dict[str, bytes] = {}
        self.stops = {s: self._whole(s) for s in ",."}
        self.ends = np.zeros(max(self.tokenizer.get_vocab().values()) + 1, bool)
        for token, i in self.tokenizer.get_vocab().items():
            self.ends[i] = token.endswith("</w>")

    def _whole(self, text: str) -> bytes:
        import numpy as np

        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _learn(self, new: set[str]) -> None:
        import numpy as np

        stopped = {w: w[:-1] for w in new if w[-1] in ",." and w[-2:-1].isalpha()}
        bases = [w for w in (new - stopped.keys()) | set(stopped.values()) if w not in self.words]
        letters = [w for w in bases if w.isalpha()]
        for at in range(0, len(letters), 2_000):
            some = letters[at:at + 2_000]
            ids = np.array(self.tokenizer.encode_batch_fast([" ".join(some)], add_special_tokens=False)[0].ids, "<u4")
            ends = ((np.flatnonzero(self.ends[ids]) + 1) * 4).tolist()
            if len(ends) == len(some):
                raw, begin = ids.tobytes(), 0
                for w, end in zip(some, ends):
                    self.words[w] = raw[begin:end]
                    begin = end
        for w in bases:
            if w not in self.words:
                self.words[w] = self._whole(w)
        for w, base in stopped.items():
            self.words[w] = self.words[base] + self.stops[w[-1]]

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        """For each text its ids, little-endian and 32 bits each."""
        import unicodedata

        split: list = []
        for text in texts:
            whole = any(c in text for c in ("<|", *SEPARATORS)) or not text.isascii() and ("Σ" in text or "İ" in text or not unicodedata.is_normalized("NFC", text))
            split.append(self._whole(text) if whole else text.lower().split())
        lists = [x for x in split if isinstance(x, list)]
        if len(self.words) > self.cached_words:  # short words come most often
            self.words = {w: b for w, b in self.words.items() if len(w) <= 8}
            if len(self.words) > self.cached_words // 2:
                self.words = {}
        self._learn(set().union(*lists).difference(self.words))
        get = self.words.__getitem__
        return [x if isinstance(x, bytes) else b"".join(map(get, x)) for x in split]


def worker_encoder(path: str) -> WordEncoder:
    """One encoder a Python worker: its words serve all tasks that the worker runs."""
    import tokenizers

    kept = tokenizers.__dict__.setdefault("_encoders_of_this_worker", {})
    if path not in kept:
        kept[path] = WordEncoder(path)
    return kept[path]


def file_system(uri: str):
    """The file system of a path and the path in it; Spark's file: paths may have one slash."""
    from pyarrow import fs

    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return (fs.LocalFileSystem(), uri) if uri.startswith("/") else fs.FileSystem.from_uri(uri)


class FrameWriter:
    """Writes documents to one open stream, frame by frame, then index and seek table."""

    def __init__(self, stream, level: int = LEVEL, frame_ids: int = FRAME_IDS):
        import zstandard

        self.stream, self.frame_ids = stream, frame_ids
        self.pack = zstandard.ZstdCompressor(level=level)
        self.frames, self.index = bytearray(), bytearray()
        self.n_frames = self.n_documents = self.n_ids = 0

    def add(self, doc_id: int | None, data: bytes) -> None:
        """A document and its ids, little-endian and 32 bits each."""
        import xxhash

        step, mine = self.frame_ids * 4, 0
        for at in range(0, max(len(data), 1), step):
            raw = data[at:at + step]
            packed = self.pack.compress(raw)
            self.stream.write(packed)
            self.frames += struct.pack("<III", len(packed), len(raw), xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF)
            mine += 1
        self.index += struct.pack(INDEX_ROW, doc_id is None, doc_id or 0, mine, len(data) // 4)
        self.n_frames, self.n_documents, self.n_ids = self.n_frames + mine, self.n_documents + 1, self.n_ids + len(data) // 4

    def close(self) -> None:
        import xxhash

        index = bytes(self.index) + struct.pack("<QI", self.n_documents, xxhash.xxh64_intdigest(bytes(self.index)) & 0xFFFFFFFF)
        self.stream.write(struct.pack("<II", INDEX_MAGIC, len(index)) + index)
        tail = bytes(self.frames) + struct.pack(TAIL, self.n_frames, 0x80, SEEK_END)
        self.stream.write(struct.pack("<II", SEEK_MAGIC, len(tail)) + tail)


class FrameReader:
    """Reads documents of one file by their place in it; only the end of the file and their frames are read."""

    def __init__(self, source):
        import numpy as np
        import xxhash
        import zstandard

        self.source, self.unpack = source, zstandard.ZstdDecompressor()
        size = source.size()
        n_frames, descriptor, magic = struct.unpack(TAIL, self._read(size - TAIL_BYTES, TAIL_BYTES))
        if magic != SEEK_END or descriptor != 0x80:
            raise ValueError("no seek table with checksums at the end")
        table_at = size - TAIL_BYTES - 12 * n_frames
        self.frames = np.frombuffer(self._read(table_at, 12 * n_frames), "<u4").reshape(-1, 3)
        index_end = table_at - 8
        n_documents, check = struct.unpack("<QI", self._read(index_end - 12, 12))
        rows = self._read(index_end - 12 - INDEX_ROW_BYTES * n_documents, INDEX_ROW_BYTES * n_documents)
        if xxhash.xxh64_intdigest(rows) & 0xFFFFFFFF != check:
            raise ValueError("the index is damaged")
        self.documents = [(None if null else i, frames, ids) for null, i, frames, ids in struct.iter_unpack(INDEX_ROW, rows)]
        self.offsets = np.concatenate([[0], np.cumsum(self.frames[:, 0], dtype=np.int64)])
        self.first = np.concatenate([[0], np.cumsum([d[1] for d in self.documents], dtype=np.int64)]).astype(np.int64)

    def _read(self, at: int, n: int) -> bytes:
        self.source.seek(at)
        return self.source.read(n)

    def raw_frames(self, place: int) -> Iterator[bytes]:
        """The decoded frames of the document at `place`, each checked."""
        import xxhash

        for f in range(int(self.first[place]), int(self.first[place + 1])):
            packed = self._read(int(self.offsets[f]), int(self.frames[f, 0]))
            raw = self.unpack.decompress(packed, max_output_size=int(self.frames[f, 1])) if self.frames[f, 1] else b""
            if len(raw) != self.frames[f, 1] or xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF != self.frames[f, 2]:
                raise ValueError(f"frame {f} is damaged")
            yield raw

    def ids(self, place: int):
        import numpy as np

        return np.frombuffer(b"".join(self.raw_frames(place)), "<u4")


def write_token_files(docs: DataFrame, folder: str, tokenizer: str, end_id: int = END_ID) -> DataFrame:
    """Encode `docs` (doc_id, text, ...) to files in `folder`; one row a file: file, part, documents, ids, frames.

    Files are numbered in ascending doc_id order (null first; rows that repeat a doc_id in the order of a hash of their
    texts, then the texts). Null text is empty: it has the end id only. An empty table makes no file. Other columns are ignored.
    """

    def write(batches):
        import os

        import pyarrow as pa
        from pyspark import TaskContext

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        encoder, fs, path, out = worker_encoder(tokenizer), None, None, None
        end = struct.pack("<I", end_id)
        part = TaskContext.get().partitionId()
        for batch in batches:
            ids, texts = batch.column("doc_id").to_pylist(), batch.column("text")
            for lo in range(0, len(ids), 256):
                encoded = encoder.encode_batch(texts.slice(lo, 256).to_pylist())
                for doc_id, tokens in zip(ids[lo:lo + 256], encoded):
                    if out is None:
                        fs, base = file_system(folder)
                        fs.create_dir(base, recursive=True)
                        path = f"{base}/part-{part:08d}.zst"
                        mine = f"{path}.{uuid.uuid4().hex}"
                        out = FrameWriter(fs.open_output_stream(mine, compression=None))
                    out.add(doc_id, tokens + end)
        if out is not None:
            out.close()
            out.stream.close()
            fs.move(mine, path)
            yield pa.RecordBatch.from_pydict({"file": [f"{folder}/part-{part:08d}.zst"], "part": pa.array([part], pa.int32()), "documents": [out.n_documents], "ids": [out.n_ids], "frames": [out.n_frames]})

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).withColumn("h", F.xxhash64("text"))
    ordered = rows.repartitionByRange("doc_id", "h").sortWithinPartitions("doc_id", "h", "text").select("doc_id", "text")
    return cut_lineage(ordered.mapInArrow(write, MADE), "token-files")


def read_token_files(made: DataFrame) -> DataFrame:
    """Read back the files of `made`: one row a document, from what the files hold: doc_id, part, start_in_part, n_tokens, ids_crc32.

    A file that is missing or doesn't hold what its task reported fails the job.
    """

    def read(batches):
        import pyarrow as pa

        for batch in batches:
            for row in batch.to_pylist():
                fs, path = file_system(row["file"])
                with fs.open_input_file(path) as source:
                    reader = FrameReader(source)
                    if (len(reader.documents), sum(d[2] for d in reader.documents)) != (row["documents"], row["ids"]):
                        raise ValueError(f"{path} doesn't hold what was written")
                    start, out = 0, []
                    for place, (doc_id, _, _) in enumerate(reader.documents):
                        crc = n = 0
                        for raw in reader.raw_frames(place):
                            crc, n = zlib.crc32(raw, crc), n + len(raw) // 4
                        out.append((doc_id, row["part"], start, n, crc))
                        start += n
                        if len(out) == 10_000:
                            yield _batch(pa, out)
                            out = []
                    if out:
                        yield _batch(pa, out)

    return made.repartition(max(1, made.count()), "file").mapInArrow(read, READ)


def _batch(pa, rows):
    names = ("doc_id", "part", "start_in_part", "n_tokens", "ids_crc32")
    types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], names=list(names))


def token_table(docs: DataFrame, tokenizer: str, folder: str | None = None) -> DataFrame:
    """Write `docs` to token files and read them back: doc_id, start, n_tokens, ids_crc32.

    `start` counts the ids of all documents before: those of earlier files (one row a file, numbered in one window) and those
    before it in its own file.
    """
    from pyspark.sql import Window

    spark: SparkSession = docs.sparkSession
    made = write_token_files(docs, folder or scratch_path(spark, "tokens"), tokenizer)
    before = made.select("part", (F.sum("ids").over(Window.orderBy("part")) - F.col("ids")).alias("before"))
    return read_token_files(made).join(F.broadcast(before), "part").select("doc_id", (F.col("before") + F.col("start_in_part")).alias("start"), "n_tokens", "ids_crc32")
