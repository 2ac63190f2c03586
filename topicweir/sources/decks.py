"""Deck files: listing, labelling by folder, slide markup and pictures.

A `.pptx`/`.pptm` deck is a zip of XML parts; Spark has no reader for it, so the archive of
each deck is opened inside a task with `mapInArrow`. Everything after that (text runs,
slide order, caps, joins) is done with DataFrame operations.
"""

import io
import re
import time
import zipfile
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from topicweir.functions.fixed_values import BATCH_SUFFIXES, DECK_SUFFIXES, IMAGES_PER_DECK, SLIDES_DEFAULT
from topicweir.functions.text import text_runs
from topicweir.operators.dataset import subject_table

# --- fixed values: part names and markup of the deck format ----------------------------
SLIDE_PART = re.compile(r"ppt/slides/slide(\d+)\.xml")
PICTURE = re.compile(r"<p:pic\b.*?</p:pic>", re.DOTALL)
PICTURE_ID = re.compile(r'r:embed="([^"]+)"')
RELATION = re.compile(r"<Relationship\b[^>]*>")
IMAGE_MAGIC = [
    (b"\x89PNG", ".png"),
    (b"\xff\xd8\xff", ".jpg"),
    (b"GIF8", ".gif"),
    (b"BM", ".bmp"),
    (b"II*\x00", ".tiff"),
    (b"MM\x00*", ".tiff"),
    (b"\xd7\xcd\xc6\x9a", ".wmf"),
]

DECK_SCHEMA = "path string, slides array<struct<slide_idx:int,xml:string>>, error string, seconds double"
IMAGE_SCHEMA = "path string, slide_idx int, img_no int, name string, ext string, content binary"
DECK_ARROW = pa.schema(
    [
        ("path", pa.string()),
        ("slides", pa.list_(pa.struct([("slide_idx", pa.int32()), ("xml", pa.string())]))),
        ("error", pa.string()),
        ("seconds", pa.float64()),
    ]
)
IMAGE_ARROW = pa.schema(
    [
        ("path", pa.string()),
        ("slide_idx", pa.int32()),
        ("img_no", pa.int32()),
        ("name", pa.string()),
        ("ext", pa.string()),
        ("content", pa.binary()),
    ]
)
BATCH_BYTES = 8 * 1024 * 1024


def is_deck(path: Column, suffixes: Sequence[str] = tuple(BATCH_SUFFIXES)) -> Column:
    """Case-blind suffix test."""
    low = F.lower(path)
    test = F.lit(False)
    for suffix in suffixes:
        test = test | F.endswith(low, F.lit(suffix))
    return test


def scan_decks(
    spark: SparkSession,
    folder: str,
    recursive: bool = True,
    suffixes: Sequence[str] = tuple(BATCH_SUFFIXES),
    content: bool = False,
    ordered: bool = False,
) -> DataFrame:
    """Deck files of a folder; without `content` the file bodies are not read.

    `ordered` sorts by path, which only a listing needs.
    """
    files = (
        spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(folder)
    )
    columns = ["path", "modificationTime", "length"] + (["content"] if content else [])
    found = files.filter(is_deck(F.col("path"), suffixes)).select(*columns)
    return found.orderBy("path") if ordered else found


def folder_label(path: Column) -> Column:
    """Name of the folder a file lies in."""
    return F.get(F.reverse(F.split(path, "/")), F.lit(1))


def label_by_folder(
    files: DataFrame,
    subjects: Sequence[str],
    suffixes: Sequence[str] | None = tuple(DECK_SUFFIXES),
    path: str = "path",
) -> DataFrame:
    """Keep decks lying in a folder named after a subject and add that name as `label`."""
    labelled = files if suffixes is None else files.filter(is_deck(F.col(path), suffixes))
    return labelled.withColumn("label", folder_label(F.col(path))).filter(F.col("label").isin(list(subjects)))


def load_labelled(
    spark: SparkSession, folder: str, subjects: Sequence[str], content: bool = False
) -> DataFrame:
    """Decks directly under `folder/<subject>/`, labelled with the subject."""
    files = scan_decks(spark, f"{folder.rstrip('/')}/*", False, DECK_SUFFIXES, content)
    return label_by_folder(files, subjects, None)


def missing_subjects(labelled: DataFrame, subjects: Sequence[str]) -> DataFrame:
    """Subjects without any deck."""
    wanted = subject_table(labelled.sparkSession, subjects)
    return wanted.join(labelled.select("label").distinct(), "label", "left_anti").select("label")


def _slide_parts(archive: zipfile.ZipFile) -> list[tuple[int, str]]:
    matches = (SLIDE_PART.fullmatch(name) for name in archive.namelist())
    return sorted((int(m.group(1)), m.group(0)) for m in matches if m)


def _read_slides(path: str, content: bytes, max_slides: int) -> tuple:
    start = time.perf_counter()
    slides, error = [], None
    try:
        if not path.lower().endswith((".pptx", ".pptm")):
            raise ValueError("unsupported format")
        with zipfile.ZipFile(io.BytesIO(content)) as archive:
            for number, name in _slide_parts(archive)[:max_slides]:
                try:
                    xml = archive.read(name).decode("utf-8", errors="ignore")
                except Exception:  # a damaged slide does not cost the deck
                    continue
                slides.append({"slide_idx": number, "xml": xml})
    except Exception as err:
        slides, error = [], f"{type(err).__name__}: {err}"
    return path, slides, error, time.perf_counter() - start


def _bytes_in(value) -> int:
    """Bytes of the texts and blobs anywhere in a row; unpacked parts can be far larger than their deck."""
    if isinstance(value, (str, bytes)):
        return len(value)
    if isinstance(value, dict):
        value = value.values()
    return sum(map(_bytes_in, value)) if isinstance(value, (list, tuple, type({}.values()))) else 8


def _in_batches(
    decks: Iterator[pa.RecordBatch], read: Callable[[str, bytes], list[tuple]], schema: pa.Schema
) -> Iterator[pa.RecordBatch]:
    """Rows read from each deck, handed on whenever a few megabytes of rows have been read."""
    rows: list[tuple] = []
    held = 0

    def flush() -> pa.RecordBatch:
        columns = list(zip(*rows)) if rows else [()] * len(schema)
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

    for batch in decks:
        for path, content in zip(batch.column("path"), batch.column("content")):
            body = content.as_py()
            found = read(path.as_py(), body)
            rows.extend(found)
            held += sum(map(_bytes_in, found))
            if held > BATCH_BYTES:
                yield flush()
                rows, held = [], 0
    yield flush()


def read_decks(decks: DataFrame, max_slides: int = SLIDES_DEFAULT) -> DataFrame:
    """One row per deck: slide XML in numeric slide order, capped; an error where unreadable.

    The slides of a deck stay in its row, so its text can be put together without a shuffle.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _in_batches(batches, lambda p, c: [_read_slides(p, c, max_slides)], DECK_ARROW)

    return decks.select("path", "content").mapInArrow(read, DECK_SCHEMA)


def extract_slides(decks: DataFrame, max_slides: int = SLIDES_DEFAULT) -> DataFrame:
    """One row per slide; a deck without readable slides keeps one row without a slide."""
    rows = read_decks(decks, max_slides).select("path", "error", "seconds", F.explode_outer("slides").alias("s"))
    return rows.select("path", F.col("s.slide_idx").alias("slide_idx"), F.col("s.xml").alias("xml"), "error", "seconds")


def slide_text(slides: DataFrame, tag: str = "a:t", unescape: bool = False) -> DataFrame:
    """Replace slide XML by its text runs."""
    return slides.withColumn("text", text_runs(F.coalesce("xml", F.lit("")), tag, unescape)).drop("xml")


def deck_texts(decks: DataFrame, max_slides: int = SLIDES_DEFAULT, tag: str = "a:t", unescape: bool = False) -> DataFrame:
    """(path, text, error, seconds) per deck: slide texts in order, empty ones dropped; narrow."""
    texts = F.transform("slides", lambda s: text_runs(s["xml"], tag, unescape))
    joined = F.array_join(F.filter(texts, lambda t: t != ""), " ")
    return read_decks(decks, max_slides).select("path", joined.alias("text"), "error", "seconds")


def _image_ext(body: bytes, name: str) -> str:
    for magic, ext in IMAGE_MAGIC:
        if body.startswith(magic):
            return ext
    suffix = name.rpartition(".")[2].lower()
    return f".{suffix}" if "." in name and suffix else ".png"


def _attribute(element: str, name: str) -> str:
    found = re.search(rf'\b{name}="([^"]*)"', element)
    return found.group(1) if found else ""


def _slide_media(archive: zipfile.ZipFile, part: str) -> Iterator[str]:
    """Archive members shown by the pictures of one slide, in markup order."""
    rels_name = part.replace("slides/", "slides/_rels/") + ".rels"
    rels = archive.read(rels_name).decode("utf-8", errors="ignore")
    targets = {
        _attribute(element, "Id"): _attribute(element, "Target")
        for element in RELATION.findall(rels)
        if _attribute(element, "Type").endswith("/image")
    }
    for picture in PICTURE.findall(archive.read(part).decode("utf-8", errors="ignore")):
        found = PICTURE_ID.search(picture)
        target = targets.get(found.group(1)) if found else None
        if target:
            yield target.lstrip("/") if target.startswith("/") else "ppt/" + target.removeprefix("../")


def _read_images(path: str, content: bytes, max_images: int) -> list[tuple]:
    rows: list[tuple] = []
    if not path.lower().endswith((".pptx", ".pptm")):
        return rows
    try:
        with zipfile.ZipFile(io.BytesIO(content)) as archive:
            for position, (_, part) in enumerate(_slide_parts(archive)):
                if len(rows) >= max_images:
                    break
                try:
                    members = list(_slide_media(archive, part))
                except Exception:
                    continue
                for member in members[: max_images - len(rows)]:
                    try:
                        body = archive.read(member)
                    except Exception:
                        continue
                    ext, k = _image_ext(body, member), len(rows)
                    rows.append((path, position, k, f"slide_{position}_img_{k}{ext}", ext, body))
    except Exception:  # an unreadable deck has no pictures
        return []
    return rows


def extract_images(decks: DataFrame, max_images: int = IMAGES_PER_DECK) -> DataFrame:
    """Embedded pictures in slide order, at most `max_images` per deck."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _in_batches(batches, lambda p, c: _read_images(p, c, max_images), IMAGE_ARROW)

    return decks.select("path", "content").mapInArrow(read, IMAGE_SCHEMA)
