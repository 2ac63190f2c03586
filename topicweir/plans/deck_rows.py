"""Deck archives built from document rows, so deck operators can run on plain text tables."""

import io
import zipfile
from collections.abc import Iterator
from xml.sax.saxutils import escape

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from topicweir.sources.decks import BATCH_BYTES

# --- fixed values: smallest slide markup the deck readers need -------------------------
SLIDE_XML = (
    "<p:sld><p:txBody><a:p><a:r><a:t>{text}</a:t></a:r></a:p></p:txBody>"
    '<p:pic><p:blipFill><a:blip r:embed="rId1"/></p:blipFill></p:pic></p:sld>'
)
RELS_XML = (
    '<Relationships><Relationship Id="rId1" '
    'Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/image" '
    'Target="../media/image{number}.png"/></Relationships>'
)
PNG_MAGIC = b"\x89PNG\r\n\x1a\n"


def pack_deck(lines: list[str]) -> bytes:
    """A deck with one slide per line; each slide shows a picture holding the line's bytes."""
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as archive:
        for number, line in enumerate(lines, start=1):
            archive.writestr(f"ppt/slides/slide{number}.xml", SLIDE_XML.format(text=escape(line)))
            archive.writestr(f"ppt/slides/_rels/slide{number}.xml.rels", RELS_XML.format(number=number))
            archive.writestr(f"ppt/media/image{number}.png", PNG_MAGIC + line.encode())
    return buffer.getvalue()


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Decks of texts, handed on whenever a few megabytes are packed; decks are far larger than their texts."""

    def flush() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(packed, pa.binary())], names=["path", "content"])

    paths, packed, held = [], [], 0
    for batch in batches:
        for path, text, bad in zip(*batch.columns):
            paths.append(path.as_py())
            packed.append(b"not an archive" if bad.as_py() else pack_deck(text.as_py().split("\n")))
            held += len(packed[-1])
            if held > BATCH_BYTES:
                yield flush()
                paths, packed, held = [], [], 0
    yield flush()


def document_decks(docs: DataFrame, id_col: str = "doc_id", text: str = "text", broken: str = "broken") -> DataFrame:
    """(path, content) with one deck per document, a slide per line; `broken` ones are no archive."""
    path = F.concat(F.lit("decks/"), F.col(id_col).cast("string"), F.lit(".pptx"))
    rows = docs.select(path.alias("path"), F.col(text).alias("text"), F.col(broken).alias("broken"))
    return rows.mapInArrow(_packed, "path string, content binary")
