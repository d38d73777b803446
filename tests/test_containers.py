import random
import time

import pytest
from pyspark.sql import functions as F

from correctionlab.sources import containers as C


def test_documents_come_back_from_a_few_files(spark, tmp_path):
    r = random.Random(5)
    texts = {f"s{k:03d}": [f"line {j} é漢" if j % 5 else None for j in range(r.choice([1, 2, 9, 40]))] for k in range(150)}
    texts["long"] = [f"row {j} " + "x" * 50 for j in range(20_000)]
    rows = [(s, "p" if k % 2 else None, 0, j, line) for k, (s, lines) in enumerate(texts.items()) for j, line in enumerate(lines)]
    r.shuffle(rows)
    lines = spark.createDataFrame(rows, "score_id string, part string, section int, seq int, line string")
    path = str(tmp_path / "out")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # small as it is, it shall span files
    index = C.write_containers(lines, path, ["score_id", "part"], ["section", "seq"])
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    files = list((tmp_path / "out" / "files").iterdir())
    assert len(files) <= 8 and index.select("score_id").distinct().count() == 151
    assert index.agg(F.sum("length")).first()[0] == sum(f.stat().st_size for f in files if f.suffix == ".txt")
    assert index.where("score_id = 'long'").count() > 1  # it spans files
    for k, (s, want) in enumerate(texts.items()):
        if k % 40 == 0 or s == "long":
            assert C.read_document(spark, path, score_id=s, part="p" if k % 2 else None) == "".join(f"{x or ''}\n" for x in want)
    assert C.read_document(spark, path, score_id="none") is None
    got = {row.score_id: row.n for row in C.read_pieces(index, path).groupBy("score_id").agg(F.sum(F.length("content")).alias("n")).collect()}
    assert got == {s: sum(len(x or "") + 1 for x in want) for s, want in texts.items()}


def test_what_failed_attempts_left_is_not_read(spark, tmp_path):
    lines = spark.createDataFrame([("a", 0, 0, "x")], "score_id string, section int, seq int, line string")
    path = str(tmp_path / "out")
    C.write_containers(lines, path, ["score_id"], ["section", "seq"])
    (tmp_path / "out" / "files" / "part-00000000-other.txt").write_text("half a")
    assert C.read_document(spark, path, score_id="a") == "x\n"


def test_no_documents(spark, tmp_path):
    lines = spark.createDataFrame([], "score_id string, section int, seq int, line string")
    index = C.write_containers(lines, str(tmp_path / "out"), ["score_id"], ["section", "seq"])
    assert index.count() == 0 and C.read_pieces(index, str(tmp_path / "out")).count() == 0


def test_export_in_containers_equals_folders(spark, sf, tmp_path):
    from correctionlab.plans.export import export_scores
    from correctionlab.sources import fixtures as fx

    documents = fx.documents(spark, sf).where("score_id in ('1', '2', '3', '5', '7')")
    diffs = fx.diffs(spark, sf).where("score_id in ('1', '2', '3', '5', '7')")
    export_scores(documents, diffs, str(tmp_path / "a"), with_parts=True)
    export_scores(documents, diffs, str(tmp_path / "b"), with_parts=True, in_containers=True)
    folders = sorted((tmp_path / "a" / "scores").glob("score_id=*"))
    assert folders
    for folder in folders:
        text = "".join(f.read_text() for f in sorted(folder.glob("*.txt")))
        assert C.read_document(spark, str(tmp_path / "b" / "scores"), score_id=folder.name.split("=")[1]) == text
    parts = list((tmp_path / "a" / "parts").glob("score_id=*/file_name=*"))
    assert C.read_index(spark, str(tmp_path / "b" / "parts")).select("score_id", "file_name").distinct().count() == len(parts)


def test_compressed_files_hold_the_same_documents_in_less_space(spark, tmp_path):
    r = random.Random(7)
    texts = {f"s{k:04d}": [f"<measure number=\"{j}\"/> é {r.random()}" if j % 5 else None for j in range(r.choice([1, 2, 9, 40]))] for k in range(3000)}
    texts["s0500a"] = [f"row {j} " + "x" * 90 for j in range(60_000)]  # longer than frames, in the midst of its file
    single = {f"w{k:04d}": "<score>" + "<note/>" * 150 + f"{k}</score>" for k in range(2000)} | {"wide": "y" * 3_000_000, "null": None}
    rows = [(s, 0, j, line) for s, lines in texts.items() for j, line in enumerate(lines)]
    r.shuffle(rows)
    lines = spark.createDataFrame(rows, "score_id string, section int, seq int, line string").repartition(3)
    whole = spark.createDataFrame(list(single.items()), "score_id string, line string").repartition(3)
    path = str(tmp_path / "out")
    index = C.write_containers(lines, path, ["score_id"], ["section", "seq"], whole, compressed=True)
    want = {s: "".join(f"{x or ''}\n" for x in lines) for s, lines in texts.items()} | {s: f"{x or ''}\n" for s, x in single.items()}
    found = C.read_pieces(index, path).orderBy("score_id", *C.PLACE).collect()
    got, pieces, joined = {}, {}, set()
    for row in found:
        got[row.score_id] = got.get(row.score_id, "") + row.content
        pieces[row.score_id] = pieces.get(row.score_id, 0) + 1
        assert row.length == len(row.content.encode()) and row.lines == row.content.count("\n")
        if row.joined:
            joined.add(row.score_id)
    assert got == want
    assert pieces["s0500a"] > 2 and pieces["wide"] == 1
    assert {s for s, n in pieces.items() if n > 1} <= joined and len(joined) < 40  # what is not joined is alone, and nearly all is
    files = [f for f in (tmp_path / "out" / "files").iterdir() if f.suffix == ".zst"]
    assert sum(f.stat().st_size for f in files) < sum(len(x.encode()) for x in want.values()) / 5
    assert C.read_document(spark, path, score_id="s0500a") == want["s0500a"]


def test_a_cut_at_the_end_of_a_document_leaves_no_empty_piece(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(C, "FRAME_BYTES", 1)  # each document fills a frame
    lines = spark.createDataFrame([(s, 0, 0, "abc" * 4) for s in "abcdef"], "score_id string, section int, seq int, line string")
    for compressed in (False, True):
        path = str(tmp_path / str(compressed))
        index = C.write_containers(lines.coalesce(1), path, ["score_id"], ["section", "seq"], compressed=compressed)
        assert sorted((r.score_id, r.content) for r in C.read_pieces(index, path).collect()) == [(s, "abc" * 4 + "\n") for s in "abcdef"]


def shuffle_files(spark):
    return spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString("\n").count("/shuffle_")


def test_shuffles_go_when_a_step_is_written(spark):
    from correctionlab.plans import sizing

    before, set_to = shuffle_files(spark), spark.conf.get(sizing.SHUFFLE_CLEANUP)
    with pytest.raises(ValueError), sizing.shuffles_cleared(spark):
        written = sizing.cut_lineage(spark.range(10_000).repartition(4, "id").groupBy((F.col("id") % 700).alias("k")).count())
        raise ValueError
    assert spark.conf.get(sizing.SHUFFLE_CLEANUP) == set_to
    until = time.time() + 20
    while shuffle_files(spark) > before and time.time() < until:
        time.sleep(0.2)
    assert shuffle_files(spark) <= before and written.count() == 700


def test_ranges_are_as_many_as_asked_for(spark, tmp_path):
    lines = spark.range(4000).select(F.col("id").cast("string").alias("score_id"), F.lit(0).alias("section"), F.lit(0).alias("seq"), F.lit("x").alias("line"))
    index = C.write_containers(lines, str(tmp_path / "out"), ["score_id"], ["section", "seq"], tasks=11)
    assert index.count() == 4000 and len([f for f in (tmp_path / "out" / "files").iterdir() if f.suffix == ".txt"]) == 11


def test_export_needs_little_disk(spark, sf):
    """Texts of documents are neither sorted nor shuffled by ids, container files are compressed, and reading them back shuffles no documents."""
    from pathlib import Path

    from correctionlab.plans import sizing
    from correctionlab.plans.queries import QUERIES
    from correctionlab.sources import fixtures as fx

    before, shuffles = set(Path(sizing.shared_dir(spark)).glob("containers-*")), shuffle_files(spark)
    frame = QUERIES["document_containers"](spark, sf)
    (folder,) = set(Path(sizing.shared_dir(spark)).glob("containers-*")) - before
    until = time.time() + 20
    while shuffle_files(spark) > shuffles and time.time() < until:
        time.sleep(0.2)
    assert shuffle_files(spark) <= shuffles
    held = sum(f.stat().st_size for f in (folder / "files").iterdir())
    assert held < frame.agg(F.sum("bytes")).first()[0] / 5
    assert frame.where("bytes is null or content_md5 is null").count() == 0
    plan = frame._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "(joined" in plan  # of the few pieces that belong together

    documents = fx.documents(spark, sf)
    ids = sizing.hashed(sizing.cut_lineage(documents.select("score_id").where("score_id like '%3'")), 0)
    for how in ("left_semi", "left_anti"):
        plan = documents.join(ids, "score_id", how)._jdf.queryExecution().executedPlan().toString()
        assert "ShuffledHashJoin" in plan and "Sort " not in plan
        assert "ENSURE_REQUIREMENTS" not in plan.split("REPARTITION_BY_NUM")[0]  # the side of the texts is dealt once, before they are made
    assert sizing.hashed(sizing.cut_lineage(documents.select("score_id")))._jdf.queryExecution().analyzed().toString().find("broadcast") > 0
