import io
import os
import zipfile

import pytest
from pyspark.sql import functions as F

from topicweir.operators import dataset, extraction
from topicweir.plans.batch_job import batch_classify, classify_decks
from topicweir.plans import deck_rows
from topicweir.plans.deck_rows import PNG_MAGIC, pack_deck
from topicweir.sources import decks, sinks
from topicweir.sources.dictionary import KeywordDictionary
from topicweir.streaming.incremental import classify_stream

WORDS = KeywordDictionary.of({"数学": ["函数", "方程"], "物理": ["电场", "磁场"]})


def archive(members: dict[str, str | bytes]) -> bytes:
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as z:
        for name, body in members.items():
            z.writestr(name, body)
    return buffer.getvalue()


def write(folder, name, body):
    path = os.path.join(folder, name)
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "wb") as f:
        f.write(body)


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    root = str(tmp_path_factory.mktemp("decks"))
    write(root, "数学/a.pptx", pack_deck(["函数 <x>", "", "方程 & more"]))
    write(root, "数学/b.PPTX", pack_deck(["函数"]))
    write(root, "物理/c.pptm", pack_deck(["电场"]))
    write(root, "物理/old.ppt", b"binary")
    write(root, "物理/notes.txt", b"text")
    write(root, "other/d.pptx", pack_deck(["磁场"]))
    write(root, "物理/deep/e.pptx", b"broken")
    return root


def names(df):
    return sorted(r.path.rsplit("/", 1)[1] for r in df.select("path").collect())


def test_scan(spark, folder):
    assert names(decks.scan_decks(spark, folder)) == ["a.pptx", "b.PPTX", "d.pptx", "e.pptx", "old.ppt"]
    assert names(decks.scan_decks(spark, f"{folder}/数学", recursive=False)) == ["a.pptx", "b.PPTX"]
    assert decks.scan_decks(spark, folder).columns == ["path", "modificationTime", "length"]


def test_load_labelled(spark, folder):
    found = decks.load_labelled(spark, folder, ["数学", "物理", "化学"])
    assert names(found) == ["a.pptx", "b.PPTX", "c.pptm", "old.ppt"]
    assert {r.label for r in found.collect()} == {"数学", "物理"}
    assert [r.label for r in decks.missing_subjects(found, ["数学", "物理", "化学"]).collect()] == ["化学"]
    assert {r.label: r.n for r in dataset.class_distribution(found).collect()} == {"数学": 2, "物理": 2}


def rows(spark, items):
    return spark.createDataFrame([(p, bytearray(b)) for p, b in items], "path string, content binary")


def test_slides_in_number_order_and_capped(spark):
    body = archive({f"ppt/slides/slide{i}.xml": f"<a:t>s{i}</a:t>" for i in (10, 2, 1, 11)} | {"ppt/slides/slideX.xml": "<a:t>no</a:t>"})
    slides = decks.slide_text(decks.extract_slides(rows(spark, [("a.pptx", body)]), 3))
    assert [(r.slide_idx, r.text) for r in slides.orderBy("slide_idx").collect()] == [(1, "s1"), (2, "s2"), (10, "s10")]
    assert decks.deck_texts(rows(spark, [("a.pptx", body)])).first().text == "s1 s2 s10 s11"


def test_unreadable_decks_keep_a_row(spark):
    empty = archive({"docProps/app.xml": "<x/>"})
    found = decks.extract_slides(rows(spark, [("bad.pptx", b"no zip"), ("old.ppt", b"x"), ("none.pptx", empty)]))
    got = {r.path: (r.slide_idx, r.error) for r in found.collect()}
    assert got["none.pptx"] == (None, None)
    assert got["bad.pptx"][0] is None and "BadZipFile" in got["bad.pptx"][1]
    assert "unsupported" in got["old.ppt"][1]


def test_many_decks_cross_batches(spark, monkeypatch):
    monkeypatch.setattr(decks, "BATCH_BYTES", 100)
    items = [(f"{i}.pptx", pack_deck([f"line {i}"])) for i in range(50)]
    found = decks.deck_texts(rows(spark, items)).collect()
    assert sorted(r.text for r in found) == sorted(f"line {i}" for i in range(50))


def test_images(spark):
    body = pack_deck([f"l{i}" for i in range(12)])
    found = decks.extract_images(rows(spark, [("a.pptx", body), ("b.ppt", b"x"), ("c.pptx", b"bad")])).orderBy("img_no").collect()
    assert [r.name for r in found] == [f"slide_{i}_img_{i}.png" for i in range(10)]
    assert bytes(found[3].content) == PNG_MAGIC + b"l3"
    assert found[0].path == "a.pptx"


def test_image_types():
    assert decks._image_ext(b"\xff\xd8\xff\xe0", "x.png") == ".jpg"
    assert decks._image_ext(b"??", "x.EMF") == ".emf"
    assert decks._image_ext(b"??", "x") == ".png"


def test_deck_text_cap_and_gaps(spark):
    slides = spark.createDataFrame(
        [("d", 3, "c"), ("d", 1, "a"), ("d", 2, ""), ("d", 4, "x"), ("e", 1, None)], "path string, slide_idx int, text string"
    )
    got = {r.path: r.text for r in extraction.deck_text(slides, 3).collect()}
    assert got == {"d": "a c", "e": ""}
    ids = spark.createDataFrame([("d",), ("f",)], "path string")
    assert {r.path: r.slides for r in extraction.slide_count(ids, slides).collect()} == {"d": 4, "f": 0}
    saved = spark.createDataFrame([("e", "from before")], "path string, text string")
    more = ids.unionByName(saved.select("path"))
    rows = extraction.extract_corpus(more, slides, saved).orderBy("path").collect()
    assert [(r.path, r.text, r.reused) for r in rows] == [("d", "a c x", False), ("e", "from before", True), ("f", "", False)]


def test_classify_decks(spark):
    items = [("a.pptx", pack_deck(["函数", "方程"])), ("bad.pptx", b"no"), ("e.pptx", pack_deck([""]))]
    got = {r.path: r for r in classify_decks(rows(spark, items), WORDS, error_as_failed=True).collect()}
    assert (got["a.pptx"].subject, got["a.pptx"].confidence) == ("数学", 10.0) and got["a.pptx"].seconds > 0
    assert (got["bad.pptx"].subject, got["bad.pptx"].confidence, got["bad.pptx"].seconds) == ("错误", 0.0, 0.0)
    assert got["e.pptx"].subject == "未知"
    plain = {r.path: r.subject for r in classify_decks(rows(spark, items), WORDS).collect()}
    assert plain["bad.pptx"] == "未知"


def test_batch_job_writes_csv(spark, folder, tmp_path):
    out = str(tmp_path / "result")
    got = {r.path.rsplit("/", 1)[1]: r.subject for r in batch_classify(spark, folder, WORDS, out).collect()}
    assert got == {"a.pptx": "数学", "b.PPTX": "数学", "d.pptx": "物理", "e.pptx": "错误", "old.ppt": "错误"}
    header = spark.read.text(out).filter(F.col("value").startswith("文件路径")).first()[0]
    assert header == "文件路径,学科,置信度,处理时间(秒)"
    sinks.write_results(sinks.read_results(spark, out), str(tmp_path / "en"), "en")
    assert spark.read.option("header", True).csv(str(tmp_path / "en")).columns == ["file", "subject", "confidence", "time"]


def test_stream_scores_each_file_once(spark, folder, tmp_path):
    source, out, mark = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "mark")
    write(source, "a.pptx", pack_deck(["函数"]))
    classify_stream(spark, source, out, mark, WORDS).awaitTermination()
    write(source, "b.pptx", pack_deck(["磁场"]))
    write(source, "skip.txt", b"x")
    classify_stream(spark, source, out, mark, WORDS).awaitTermination()
    got = [(r.path.rsplit("/", 1)[1], r.subject, r.batch) for r in spark.read.parquet(out).collect()]
    assert sorted(got) == [("a.pptx", "数学", 0), ("b.pptx", "物理", 1)]


def test_decks_leave_the_task_in_small_batches(monkeypatch):
    monkeypatch.setattr(deck_rows, "BATCH_BYTES", 20_000)
    texts = ["\n".join(f"line {i}.{k}" for k in range(20)) for i in range(12)]
    columns = [[f"{i}.pptx" for i in range(12)], texts, [i == 7 for i in range(12)]]
    batch = deck_rows.pa.RecordBatch.from_arrays([deck_rows.pa.array(c) for c in columns], names=["path", "text", "broken"])
    batches = list(deck_rows._packed([batch]))
    most = max(len(pack_deck(t.split("\n"))) for t in texts)
    assert len(batches) > 2 and all(b.nbytes < 20_000 + most + 1_000 for b in batches)
    got = {r["path"]: r["content"] for b in batches for r in b.to_pylist()}
    assert len(got) == 12 and got["7.pptx"] == b"not an archive"
    assert len(decks._read_slides("3.pptx", got["3.pptx"], 50)[1]) == 20
