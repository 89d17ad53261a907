"""Binary files: upload checks and an optional PDF reader."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MAX_BYTES = 52_428_800
MAX_PAGES = 500


def uploads(spark: SparkSession, path: str) -> DataFrame:
    """(path, sha256, size_bytes, reject_reason) of the files under ``path``; the reason is null for an acceptable PDF.

    The scan leaves out empty files.
    """
    files = spark.read.format("binaryFile").load(path)
    reason = F.when(F.col("length") > MAX_BYTES, "too_large").when(F.substring("content", 1, 5) != F.lit(b"%PDF-"), "not_pdf")
    return files.select("path", F.sha2("content", 256).alias("sha256"), F.col("length").alias("size_bytes"), reason.alias("reject_reason"))


def pdf_blocks(spark: SparkSession, path: str) -> DataFrame:
    """(document_id, block_idx, page, bbox, text) of PDF files; needs a PDF library on the executors."""

    def read(batches):
        import fitz  # gated: absent where PDFs arrive as parsed tables
        import pandas as pd

        for b in batches:
            rows = []
            for name, content in zip(b["path"], b["content"], strict=True):
                with fitz.open(stream=content, filetype="pdf") as doc:
                    k = 0
                    for page_no, page in enumerate(doc, 1):
                        for x0, y0, x1, y1, text, *_ in page.get_text("blocks"):
                            if flat := " ".join(text.split()):
                                rows.append((name, k, page_no, [round(v, 2) for v in (x0, y0, x1, y1)], flat))
                                k += 1
            yield pd.DataFrame(rows, columns=["document_id", "block_idx", "page", "bbox", "text"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(read, "document_id string, block_idx int, page int, bbox array<double>, text string")
