"""Many documents in a few files (O3, O4): containers of text and an index to them.

    {path}/index    Parquet: the keys, file, offset, length and lines of each piece
    {path}/files    text files, or files of compressed frames; a document lies in one stretch of text, or in one of each file or frame it spans

A range sort deals lines to tasks, and each task writes one file, so a document as long as a task's share is cut between files and none
needs to fit in memory. Documents that are one line each need no sort: the task that holds them writes them. Files are named by their task and
by their attempt; what a failed attempt left is in no index. A document is read by its stretches alone.

Compressed, a file is a row of zstandard frames of about FRAME_BYTES of text each, and the stretch of a piece is one of its frame's text. A frame ends
with a document, but for one much longer than a frame.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# frame: where it starts, its bytes in the file and of text; null in plain files. joined: the document may have other pieces
PIECE = "file string, offset long, length long, lines long, frame struct<start: long, packed: long, text: long>, joined boolean"
FRAME_BYTES = 1 << 18


def file_system(path: str):
    """The file system of a path, and the path in it."""
    from pyarrow import fs

    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path[5:].lstrip("/")
    return (fs.LocalFileSystem(), path) if path.startswith("/") else fs.FileSystem.from_uri(path)


def write_containers(
    lines: DataFrame, path: str, keys: list[str], order: list[str], whole: DataFrame | None = None, compressed: bool = False,
    tasks: int | None = None,
) -> DataFrame:
    """Write the lines of documents, named by `keys`, in `order`; gives the index. A null line is empty.

    `whole` holds more documents, each of one row and in that alone: the keys and its line. They are neither shuffled nor sorted.
    `tasks` is the number of ranges, the session's for None.
    """
    folder = f"{path}/files"
    kinds = dict(lines.dtypes)
    schema = ", ".join(f"`{k}` {kinds[k]}" for k in keys) + ", " + PIECE

    def write(batches):
        import functools

        import pyarrow as pa
        import pyarrow.compute as pc
        from pyspark import TaskContext

        out, name, at = None, None, 0  # `at` counts the text of the file, or of the frame
        open_key, begun, count, goes_on = None, 0, 0, True  # the first document of a file may have begun in another
        held: list[bytes] = []
        ended: list[tuple] = []  # pieces of this frame
        done: list[tuple] = []
        codec, start, size = pa.Codec("zstd") if compressed else None, 0, 0

        def rows():
            columns = list(zip(*done))
            frame = pa.struct([("start", pa.int64()), ("packed", pa.int64()), ("text", pa.int64())])
            types = [*(pa.array([], batch.schema.field(k).type).type for k in keys),
                     pa.string(), pa.int64(), pa.int64(), pa.int64(), frame, pa.bool_()]
            return pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, types)], names=[*keys, "file", "offset", "length", "lines", "frame", "joined"])

        def end_piece(cut):
            nonlocal begun, count, goes_on
            ended.append((*open_key, name, begun, at - begun, count, goes_on or cut))
            begun, count, goes_on = at, 0, cut

        def end_frame():
            nonlocal at, begun, start, size
            if not (held or ended):
                return
            text, size = b"".join(held), 0
            held.clear()
            if codec is None:
                out.write(text)
                done.extend((*p[:-1], None, p[-1]) for p in ended)
            else:
                packed = codec.compress(text, asbytes=True)
                out.write(packed)
                frame = {"start": start, "packed": len(packed), "text": len(text)}
                done.extend((*p[:-1], frame, p[-1]) for p in ended)
                start, at, begun = start + len(packed), 0, 0
            ended.clear()

        for batch in batches:
            if not len(batch):
                continue
            if out is None:
                files, base = file_system(folder)
                files.create_dir(base, recursive=True)
                name = f"part-{TaskContext.get().partitionId():08d}-{uuid.uuid4().hex}.{'zst' if compressed else 'txt'}"
                out = files.open_output_stream(f"{base}/{name}", compression=None)
            changes = [pc.fill_null(pc.not_equal(batch[k][1:], batch[k][:-1]), True) for k in keys]
            starts = [0, *(i + 1 for i in pc.indices_nonzero(functools.reduce(pc.or_, changes)).to_pylist()), len(batch)]
            texts, names = batch["line"].to_pylist(), list(zip(*(batch[k].take(starts[:-1]).to_pylist() for k in keys)))
            for key, lo, hi in zip(names, starts, starts[1:]):
                if key != open_key:
                    if count:
                        end_piece(False)
                    elif open_key is not None:  # a cut came at its end
                        goes_on = False
                    if size >= FRAME_BYTES:
                        end_frame()
                    open_key = key
                text = "".join(f"{x or ''}\n" for x in texts[lo:hi]).encode()
                held.append(text)
                at, count, size = at + len(text), count + hi - lo, size + len(text)
                if size >= 4 * FRAME_BYTES:
                    if compressed:
                        end_piece(True)
                    end_frame()
            if len(done) > 10_000:
                yield rows()
                done.clear()
        if out is not None:
            if count:
                end_piece(True)
            end_frame()
            out.close()
            yield rows()

    ranges = [*keys, *order] if tasks is None else [tasks, *keys, *order]
    dealt = lines.select(*keys, *order, "line").repartitionByRange(*ranges).sortWithinPartitions(*keys, *order)
    index = dealt.select(*keys, "line").mapInArrow(write, schema)
    if whole is not None:
        index = index.unionByName(whole.select(*keys, "line").mapInArrow(write, schema))
    index.write.parquet(f"{path}/index")
    return read_index(lines.sparkSession, path)


def read_index(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/index")


PLACE = ("file", "frame", "offset")  # pieces of a document follow one another so


def read_pieces(index: DataFrame, path: str) -> DataFrame:
    """The rows of an index, or of some of it, with `content`, the text of their stretch. Pieces of a document follow one another by PLACE."""
    folder = f"{path}/files"

    def read(batches):
        import pyarrow as pa

        name, source, start, text, codec = None, None, None, None, pa.Codec("zstd")
        for batch in batches:
            for lo in range(0, len(batch), 64):
                part, texts = batch.slice(lo, 64), []
                for file, frame, at, n in zip(*(part[c].to_pylist() for c in (*PLACE, "length"))):
                    if file != name:
                        if source is not None:
                            source.close()
                        files, base = file_system(folder)
                        name, source, start = file, files.open_input_file(f"{base}/{file}"), None
                    if frame is None:
                        source.seek(at)
                        texts.append(source.read(n))
                        continue
                    if frame["start"] != start:
                        source.seek(frame["start"])
                        text, start = codec.decompress(source.read(frame["packed"]), frame["text"], asbytes=True), frame["start"]
                    texts.append(text[at:at + n])
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.binary()).cast(pa.string())], names=[*part.schema.names, "content"])

    return index.sortWithinPartitions(*PLACE).mapInArrow(read, index.select("*", F.lit("").alias("content")).schema)


def read_document(spark: SparkSession, path: str, **key: object) -> str | None:
    """One document by its key; None where there is none."""
    mine = read_index(spark, path)
    for name, value in key.items():
        mine = mine.where(F.col(name).eqNullSafe(F.lit(value)))
    pieces = read_pieces(mine, path).orderBy(*PLACE).select("content").collect()
    return "".join(r["content"] for r in pieces) if pieces else None
