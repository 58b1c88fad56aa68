"""Page texts and layouts of archived files. The engine reads tables; a tool outside makes them from PDF files.

page texts: (document, page, variant, text), variants: reading order and raw. layout: (document, page, text).
positions: (document, page, width, height, line_no, x0, y0, x1, y1, text).
"""

from __future__ import annotations

import shutil
import subprocess
import tempfile

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from specloom.operators.extract import split_pages

TOOL = "pdftotext"
TIMEOUT = 120
VARIANTS = {"reading": (), "raw": ("-raw",)}


def tool_available() -> bool:
    return shutil.which(TOOL) is not None


def _converted(files: DataFrame, *options: str) -> DataFrame:
    """(document, text, error): the tool's output for each file (document, content); a failed file is a row with its error."""

    def run(batches):
        for pdf in batches:
            texts, errors = [], []
            for content in pdf["content"]:
                try:
                    with tempfile.NamedTemporaryFile(suffix=".pdf") as f:
                        f.write(content)
                        f.flush()
                        done = subprocess.run([TOOL, *options, "-enc", "UTF-8", f.name, "-"], capture_output=True, timeout=TIMEOUT)
                    texts.append(done.stdout.decode("utf-8", "replace") if done.returncode == 0 else None)
                    errors.append(None if done.returncode == 0 else done.stderr.decode("utf-8", "replace")[:500])
                except (OSError, subprocess.SubprocessError) as e:
                    texts.append(None)
                    errors.append(str(e)[:500])
            yield pd.DataFrame({"document": pdf["document"], "text": texts, "error": errors})

    return files.select("document", "content").mapInPandas(run, "document string, text string, error string")


def page_texts(files: DataFrame) -> DataFrame:
    """(document, page, variant, text) of files (document, content)."""
    out = None
    for i, options in enumerate(VARIANTS.values()):
        pages = split_pages(_converted(files, *options).where("text IS NOT NULL")).withColumn("variant", F.lit(i))
        out = pages if out is None else out.unionByName(pages)
    return out.select("document", "page", "variant", "text")


def layout_pages(files: DataFrame) -> DataFrame:
    """(document, page, text) with table columns kept in place."""
    return split_pages(_converted(files, "-layout").where("text IS NOT NULL"))


def markup_pages(files: DataFrame) -> DataFrame:
    """(document, page, text) of files (document, content): the tool's markup of each page, with the boxes of its lines."""
    got = _converted(files, "-bbox-layout").where("text IS NOT NULL")
    each = got.select("document", F.posexplode(F.regexp_extract_all("text", F.lit(r"(?s)<page .*?</page>"), F.lit(0))).alias("p", "text"))
    return each.select("document", (F.col("p") + 1).alias("page"), "text")


_NUM = r"([\d.]+)"


def positioned_lines(markup: DataFrame) -> DataFrame:
    """Lines with their boxes from the tool's page markup (document, page, text)."""
    size = rf'<page width="{_NUM}" height="{_NUM}"'
    line = rf'(?s)<line xMin="{_NUM}" yMin="{_NUM}" xMax="{_NUM}" yMax="{_NUM}">(.*?)</line>'
    part = lambda i: F.regexp_extract_all("text", F.lit(line), F.lit(i))
    zipped = F.arrays_zip(*[part(i).alias(c) for i, c in enumerate(("x0", "y0", "x1", "y1", "body"), 1)])
    rows = markup.select("document", "page", F.regexp_extract("text", size, 1).try_cast("double").alias("width"), F.regexp_extract("text", size, 2).try_cast("double").alias("height"), F.posexplode(zipped).alias("line_no", "l"))
    words = F.array_join(F.regexp_extract_all("l.body", F.lit(r"(?s)<word[^>]*>(.*?)</word>"), F.lit(1)), " ")
    for name, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&amp;", "&")):
        words = F.replace(words, F.lit(name), F.lit(char))
    return rows.select("document", "page", "width", "height", "line_no", *[F.col(f"l.{c}").cast("double").alias(c) for c in ("x0", "y0", "x1", "y1")], words.alias("text"))
