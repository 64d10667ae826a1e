"""Page images of generated corpora, drawn on the executors, and the bundles made of them.

A page is a grey array in numpy: block boxes, table grids, diagrams and text, then the traces of its scan quality. Text is drawn
from an outside font file with Pillow, where that is installed (it shapes Arabic if it was built with Raqm, else the
packages arabic_reshaper and bidi do); without a font each letter is a dark box of its width, which keeps the layout and needs nothing.
The same corpus, font and seed give the same bytes.
"""

from __future__ import annotations

import functools
import hashlib
import json
import struct
import textwrap
import zlib
from collections.abc import Iterable, Iterator
from pathlib import Path
from typing import Any, Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.report import write_json
from ..session import discard, ship_package, written
from . import generate
from . import schemas as S

LARGEST, LARGE_TYPES, SMALLEST = 28, {"title": 38, "equation": 38}, 8
INK, LINE, PAPER = 25, 90, 255


class Glyphs(Protocol):
    def mask(self, text: str, size: int) -> np.ndarray:
        """One line of text: how dark each pixel is (0 to 1)."""


class Boxes:
    """A box for each letter: layout without a font."""

    def mask(self, text: str, size: int) -> np.ndarray:
        step = max(2, size // 2)
        out = np.zeros((size, step * len(text)), np.float32)
        for i, letter in enumerate(text):
            if not letter.isspace():
                out[size // 5 : size - size // 5, i * step : i * step + step - 1] = 1
        return out


class Font:
    """Letters of a font file, by Pillow."""

    def __init__(self, path: str):
        try:
            from PIL import ImageFont, features
        except ImportError as e:
            raise RuntimeError("drawing letters needs Pillow; without a font they are drawn as boxes") from e
        if not Path(path).is_file():
            raise FileNotFoundError(f"no font at {path}")
        self.at = functools.lru_cache(maxsize=64)(lambda size: ImageFont.truetype(path, size))
        self.shapes = features.check("raqm")

    def _shown(self, text: str) -> str:
        if self.shapes or not has_arabic(text):
            return text
        try:
            from arabic_reshaper import reshape
            from bidi.algorithm import get_display
        except ImportError as e:
            raise RuntimeError("Arabic needs a Pillow with Raqm, or arabic_reshaper and bidi") from e
        return get_display(reshape(text))

    def mask(self, text: str, size: int) -> np.ndarray:
        drawn = self.at(size).getmask(self._shown(text), mode="L")
        return np.asarray(drawn, np.float32).reshape(drawn.size[1], drawn.size[0]) / 255


@functools.lru_cache(maxsize=4)
def glyphs(font: str | None) -> Glyphs:
    return Font(font) if font else Boxes()


def has_arabic(text: str) -> bool:
    return any("؀" <= c <= "ۿ" for c in text)


def block_text(block: dict) -> str:
    """What an image shows of a block: its equation, or the raw text of its lines."""
    return block["equation_text"] or "\n".join(line["raw_text"] for line in block["lines"] or ())


def wrapped(text: str, letters: int) -> list[str]:
    return [x for line in text.splitlines() or [""] for x in textwrap.wrap(line, max(1, letters)) or [""]]


def fitted(text: str, width: int, height: int, largest: int, font: Glyphs) -> list[np.ndarray]:
    """The lines' masks at the largest size at which the wrapped text fits (at SMALLEST it is cut off by the box)."""
    for size in range(largest, SMALLEST - 1, -2):
        own = font.mask("n" * 10, size).shape[1] / 10
        masks = [font.mask(line, size) if line else np.zeros((size, 0), np.float32) for line in wrapped(text, int(width / max(own, 1)))]
        if sum(m.shape[0] + size // 4 for m in masks) <= height and all(m.shape[1] <= width for m in masks):
            break
    return masks


def _stamp(page: np.ndarray, mask: np.ndarray, x: int, y: int, right: int, bottom: int) -> None:
    """Ink a mask within a box and the page."""
    h, w = max(0, min(mask.shape[0], bottom - y, page.shape[0] - y)), max(0, min(mask.shape[1], right - x, page.shape[1] - x))
    part = page[y : y + h, x : x + w]
    np.minimum(part, PAPER - (PAPER - INK) * mask[:h, :w], out=part)


def _frame(page: np.ndarray, x: int, y: int, w: int, h: int) -> None:
    for rows, columns in ((slice(y, y + 2), slice(x, x + w)), (slice(y + h - 2, y + h), slice(x, x + w)), (slice(y, y + h), slice(x, x + 2)), (slice(y, y + h), slice(x + w - 2, x + w))):
        page[rows, columns] = LINE


def _text(page: np.ndarray, text: str, box: tuple[int, int, int, int], largest: int, rtl: bool, font: Glyphs) -> None:
    x, y, w, h = box
    pad = min(8, w // 4, h // 4)
    at = y + pad
    for mask in fitted(text, w - 2 * pad, h - 2 * pad, largest, font):
        left = max(x + pad, x + w - pad - mask.shape[1]) if rtl else x + pad
        _stamp(page, mask, left, at, x + w - pad, y + h - pad)
        at += mask.shape[0] + mask.shape[0] // 4


def _box(b: dict) -> tuple[int, int, int, int]:
    return round(b["x"]), round(b["y"]), max(4, round(b["width"])), max(4, round(b["height"]))


def drawn(page: dict, font: Glyphs) -> np.ndarray:
    """The clean page."""
    out = np.full((page["height"], page["width"]), PAPER, np.float32)
    for block in sorted(page["blocks"], key=lambda b: b["reading_order_index"]):
        x, y, w, h = box = _box(block["bbox"])
        lines = block["lines"] or [{"direction": "ltr"}]
        rtl = lines[0]["direction"] == "rtl"
        kind = block["block_type"]
        if kind == "table" and block["table"]:
            for cell in block["table"]["cells"]:
                own = _box(cell["bbox"])
                _frame(out, *own)
                _text(out, cell["raw_text"], own, 20, rtl, font)
            continue
        if kind in ("diagram", "figure"):  # axes and a curve
            _frame(out, *box)
            xs = np.arange(x + 8, x + w - 8)
            ys = (y + h / 2 + (h / 3) * np.sin((xs - x) / max(w, 1) * 9)).astype(int)
            inside = (ys >= 0) & (ys < out.shape[0]) & (xs < out.shape[1])
            out[ys[inside], xs[inside]] = INK
        _text(out, block_text(block), box, LARGE_TYPES.get(kind, LARGEST), rtl, font)
        if kind == "equation":
            out[y + h - 6 : y + h - 4, x + 8 : x + w - 8] = LINE
    return out


def _smooth(x: np.ndarray, share: float) -> np.ndarray:
    """Each pixel mixed with its four neighbours."""
    edge = np.pad(x, 1, mode="edge")
    around = (edge[:-2, 1:-1] + edge[2:, 1:-1] + edge[1:-1, :-2] + edge[1:-1, 2:]) / 4
    return (1 - share) * x + share * around


def degraded(page: np.ndarray, quality: str, seed: int) -> np.ndarray:
    """The traces of a scan quality: clean, compressed, photographed or skewed."""
    h, w = page.shape
    if quality == "compressed":  # half the resolution, and less contrast
        half = page[: h - h % 2, : w - w % 2].reshape(h // 2, 2, w // 2, 2).mean(axis=(1, 3))
        out = page.copy()
        out[: h - h % 2, : w - w % 2] = half.repeat(2, axis=0).repeat(2, axis=1)
        return 0.9 * _smooth(out, 0.35) + 0.1 * out.mean()
    if quality == "photographed":  # grey paper, uneven light, noise
        light = 1 - 0.06 * np.linspace(0, 1, w, dtype=np.float32)[None, :]
        noise = np.random.default_rng(seed).integers(-6, 7, page.shape).astype(np.float32)
        return _smooth((0.92 * page + 0.08 * 238) * light, 0.25) + noise
    if quality == "skewed":  # sheared, white beyond the edges
        shift = np.rint(0.035 * (np.arange(h) - h / 2)).astype(int)
        from_ = np.arange(w)[None, :] + shift[:, None]
        return np.where((from_ >= 0) & (from_ < w), np.take_along_axis(page, np.clip(from_, 0, w - 1), axis=1), PAPER)
    if quality == "clean":
        return page
    raise ValueError(f"no such scan quality: {quality}")


def png(page: np.ndarray) -> bytes:
    """An 8-bit grey PNG."""
    grey = np.clip(np.rint(page), 0, 255).astype(np.uint8)
    h, w = grey.shape

    def chunk(kind: bytes, data: bytes) -> bytes:
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    rows = np.concatenate([np.zeros((h, 1), np.uint8), grey], axis=1).tobytes()
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows, 9)) + chunk(b"IEND", b"")


def _render(batches: Iterable[pa.RecordBatch], font: str | None, seed: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for document, page_id, page, quality in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            own = int.from_bytes(hashlib.sha256(f"{seed}:{page_id}".encode()).digest()[:8], "big")
            content = png(degraded(drawn(page, glyphs(font)), quality, own))
            yield pa.RecordBatch.from_pydict({"document_id": [document], "page_id": [page_id], "content": [content], "width": pa.array([page["width"]], pa.int32()), "height": pa.array([page["height"]], pa.int32())})


def quality_of(tags: Column) -> Column:
    """The scan quality in a page's tags; clean without one."""
    return F.coalesce(F.get(F.transform(F.filter(tags, lambda t: t.startswith("quality:")), lambda t: F.substring_index(t, ":", -1)), 0), F.lit("clean"))


def images(corpus: generate.Corpus, font: str | None = None, seed: int = 17) -> DataFrame:
    """document_id, page_id, content (PNG), width, height of each page, one image in memory at a time.

    font: a path that every executor can open, or None for boxes.
    """
    ship_package(corpus.manifest.sparkSession)
    place = "struct<x: double, y: double, width: double, height: double>"
    lean = f"struct<width: int, height: int, blocks: array<struct<block_type: string, reading_order_index: int, bbox: {place}, equation_text: string, lines: array<struct<raw_text: string, direction: string>>, table: struct<cells: array<struct<bbox: {place}, raw_text: string>>>>>>"
    b = F.transform("truth.blocks", lambda b: F.struct(
        b.block_type.alias("block_type"), b.reading_order_index.alias("reading_order_index"), b.bbox.alias("bbox"), b.equation_text.alias("equation_text"),
        F.transform(b.lines, lambda x: F.struct(x.raw_text.alias("raw_text"), x.direction.alias("direction"))).alias("lines"),
        F.when(b.table.isNotNull(), F.struct(F.transform(b.table.cells, lambda c: F.struct(c.bbox.alias("bbox"), c.raw_text.alias("raw_text"))).alias("cells"))).alias("table"),
    ))
    # the records' look-up: a page's quality stands with its manifest row
    qualities = corpus.manifest.select("document_id", "page_id", quality_of(F.col("tags")).alias("quality"))
    pages = corpus.truth.join(qualities, ["document_id", "page_id"]).select("document_id", "page_id", F.struct(F.col("truth.width").alias("width"), F.col("truth.height").alias("height"), b.alias("blocks")).cast(lean).alias("page"), "quality")
    return pages.mapInArrow(functools.partial(_render, font=font, seed=seed), "document_id string, page_id string, content binary, width int, height int")


def assets_of(pictures: DataFrame) -> DataFrame:
    """The asset index of images: S.ASSET's columns."""
    sums = F.struct(F.lit("sha256").alias("algorithm"), F.sha2("content", 256).alias("value"), F.octet_length("content").cast("bigint").alias("size_bytes"))
    return pictures.select("document_id", "page_id", F.lit("image/png").alias("media_type"), F.concat(F.lit("images/"), "page_id", F.lit(".png")).alias("relative_path"), sums.alias("checksum"), "width", "height")


def write_bundle(corpus: generate.Corpus, folder: str | Path, dataset_id: str, revision: str, font: str | None = None, seed: int = 17) -> dict[str, Path]:
    """A bundle on the driver's disk: images, manifest, ground truth, records and assets. Images pass one at a time.

    Corpora beyond one machine keep ``images`` as a table.
    """
    spark, folder = corpus.manifest.sparkSession, Path(folder)
    (folder / "images").mkdir(parents=True, exist_ok=True)
    pictures, path = written(images(corpus, font, seed), "images")  # drawn once
    for row in pictures.select("page_id", "content").toLocalIterator():
        (folder / "images" / f"{row.page_id}.png").write_bytes(row.content)
    index = assets_of(pictures)
    assets = sorted(generate._objects(index), key=lambda a: (a["document_id"], a["page_id"]))
    manifest, truth = generate.artifacts(generate.with_assets(corpus, index, "raster-png"), dataset_id, revision)
    discard(spark, path)
    where = {a["page_id"]: a for a in assets}
    quality = {r.page_id: r.quality for r in corpus.manifest.select("page_id", quality_of(F.col("tags")).alias("quality")).toLocalIterator()}
    for d in truth["documents"]:
        for p in d["pages"]:
            p["provenance"]["details"] |= {"asset_format": "png", "image_path": where[p["page_id"]]["relative_path"]}
    records = [
        {"document_id": d["document_id"], "page_id": p["page_id"], "category": d["category"], "scan_quality": quality[p["page_id"]], "asset_format": "png", "image_path": where[p["page_id"]]["relative_path"], "image_sha256": p["checksum"]["value"], "image_size_bytes": p["checksum"]["size_bytes"], "width": p["width"], "height": p["height"], "font_filename": Path(font).name if font else None, "font_is_bundled": False}
        for d in manifest["documents"] for p in d["pages"]
    ]
    head = {"schema_version": S.SCHEMA_VERSION, "dataset_revision": manifest["dataset_revision"]}
    made = {"manifest": manifest, "ground-truth": truth, "records": records, "assets": head | {"assets": assets}}
    return {name: write_json(json.loads(json.dumps(value)), folder / f"{name}.json") for name, value in made.items()} | {"images": folder / "images"}
