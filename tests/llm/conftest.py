from __future__ import annotations

import pytest
from pyspark.sql import functions as F


@pytest.fixture(scope="session")
def small():
    return "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def folder(spark, tmp_path_factory):
    """Writes tables into a folder that a query can read: folder(documents=[rows], ...)."""
    schemas = {
        "documents": "doc_id long, text string, lang string, source string, n_chars long",
        "pages": "page_id long, url string, html string",
        "benchmark": "item_id long, text string",
        "labels": "doc_id long, quality int, toxic int",
        "embeddings": "vec_id long, embedding array<float>, label int",
        "conversations": "conv_id long, turn long, role string, text string",
    }

    def write(extra: bool = False, **tables) -> str:
        at = tmp_path_factory.mktemp("tables")
        for name, schema in schemas.items():
            rows = [tuple(r) + (None,) * (len(schema.split(",")) - len(r)) for r in tables.get(name, [])]
            df = spark.createDataFrame(rows, schema)
            if extra:
                # Names that operators use inside.
                for c in ("words", "h", "hash", "host", "row", "n", "count", "spans", "fail_bits", "component", "_place", "ids", "length", "kept", "term"):
                    if c not in df.columns:
                        df = df.withColumn(c, F.lit("x"))
            df.write.parquet(f"{at}/{name}.parquet")
        return str(at)

    return write
