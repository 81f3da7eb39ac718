"""Text recognition in front of the engine: PDF pages to images to text, by the programs ``pdftoppm`` and ``tesseract``.

Both must be installed on every executor; a document that fails has no text and an error. Work files lie in a folder of
the task, which goes with it.
"""

from __future__ import annotations

import re
import shutil
import subprocess
import tempfile
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

PAGE_END = "\n===SEITENENDE===\n"
#: Resolution, page layout and engine modes, language.
DPI, LAYOUT_MODE, ENGINE_MODE, LANGUAGE = 300, 6, 1, "deu"
#: Share clipped at either end of the grey scale in percent, threshold of black and white.
CLIP, THRESHOLD = 1, 150


def missing_programs() -> list[str]:
    return [p for p in ("pdftoppm", "tesseract") if shutil.which(p) is None]


def has_language(language: str = LANGUAGE) -> bool:
    """Whether the installed recogniser knows the language."""
    if shutil.which("tesseract") is None:
        return False
    listed = subprocess.run(["tesseract", "--list-langs"], capture_output=True, text=True, check=False)
    return language in (listed.stdout + listed.stderr).split()


def page_number(name: str) -> int:
    """The number at the end of a page image's name, for their order."""
    m = re.search(r"(\d+)\D*$", name)
    return int(m[1]) if m else 0


def prepared(grey: np.ndarray) -> np.ndarray:
    """A page as black on white: contrast stretched between its first and last hundredth, a 3 x 3 median, a threshold."""
    low, high = np.percentile(grey, [CLIP, 100 - CLIP])
    flat = grey.astype(float) if high <= low else np.clip((grey - low) * (255.0 / (high - low)), 0, 255)
    edge = np.pad(flat, 1, mode="edge")
    around = np.stack([edge[i : i + grey.shape[0], j : j + grey.shape[1]] for i in range(3) for j in range(3)])
    return np.where(np.median(around, axis=0) > THRESHOLD, 255, 0).astype(np.uint8)


def prepare_file(path: Path) -> None:
    """Prepare a binary grey map in place; a page that can't be read stays as it is."""
    data = path.read_bytes()
    m = re.match(rb"P5\s+(\d+)\s+(\d+)\s+255\s", data)
    if m and len(data) - m.end() == int(m[1]) * int(m[2]):
        grey = np.frombuffer(data, np.uint8, offset=m.end()).reshape(int(m[2]), int(m[1]))
        path.write_bytes(m[0] + prepared(grey).tobytes())


def recognise(pdf: bytes, language: str = LANGUAGE, timeout: int = 600) -> str:
    """All pages of one PDF as text."""
    with tempfile.TemporaryDirectory() as d:
        source = Path(d, "in.pdf")
        source.write_bytes(pdf)
        subprocess.run(["pdftoppm", "-r", str(DPI), "-gray", str(source), str(Path(d, "page"))], check=True, capture_output=True, timeout=timeout)
        images = sorted(Path(d).glob("page*.pgm"), key=lambda p: page_number(p.name))
        if not images:
            raise RuntimeError("no page was rendered")
        for image in images:
            prepare_file(image)
        command = ["stdout", "-l", language, "--psm", str(LAYOUT_MODE), "--oem", str(ENGINE_MODE)]
        return PAGE_END.join(subprocess.run(["tesseract", str(p), *command], check=True, capture_output=True, text=True, timeout=timeout).stdout for p in images)


def recognised_texts(spark: SparkSession, path: str, language: str = LANGUAGE) -> DataFrame:
    """``quelle_pdf, ocr_text, fehler`` of the PDF files of a folder. A driver that has the programs checks the language first."""
    if not missing_programs() and not has_language(language):
        raise ValueError(f"the recogniser has no language {language}")

    def run(frames):
        for pdf in frames:
            rows = []
            for file, content in zip(pdf["path"], pdf["content"], strict=True):
                name = file.rpartition("/")[2]
                try:
                    rows.append((name, recognise(content, language), None))
                except Exception as e:  # noqa: BLE001 - one bad document must not stop the others
                    rows.append((name, None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(rows, columns=["quelle_pdf", "ocr_text", "fehler"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.{pdf,PDF}").load(path).select("path", "content")
    return files.mapInPandas(run, "quelle_pdf string, ocr_text string, fehler string")
