"""The corpus job: parsed sources to one labelled, deduplicated, split table."""

from __future__ import annotations

from pyspark.sql import DataFrame

from postwarden.operators.dataset import dedupe_mail, min_length, split_mail, union_corpora

COLUMNS = ["mail_id", "from_email", "subject", "body", "label", "source"]


def build_corpus(*sources: DataFrame, min_chars: int = 20, dedupe_chars: int = 30) -> DataFrame:
    """Union of the sources, deduplicated within each class, with a split.

    Duplicates are looked for per class, so a text that occurs under two labels
    stays once under each.
    """
    parts = [s.select(*COLUMNS) for s in sources]
    rows = min_length(union_corpora(*parts), min_chars)
    return split_mail(dedupe_mail(rows, ["label", "subject", "body"], min_len=dedupe_chars))
