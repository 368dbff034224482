"""Reading of small results."""

from __future__ import annotations


def rows(df, key="doc_id"):
    return {r[key]: r for r in df.collect()}
