"""Removal of word passages that occur more than once, by counted Rabin-Karp window hashes."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from wardpanel.llm.common import documents, id_back
from wardpanel.llm.shared_runs import SPAN_SCHEMA, count_windows, covered, removal, repeated_runs, with_text, word_units


def remove_repeated_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 35, gram: int = 6) -> DataFrame:
    """Remove every word covered by a window of `window` words that also starts anywhere else.

    Words are `[^\\x20\\x09-\\x0D]+`, unchanged.  Windows lie in one document and are judged on the input.  Each
    window gets a Rabin-Karp hash.  Windows are counted in Spark: in runs that share their smallest k-gram
    where a whole run settles the question, one by one (two 64-bit hashes) where it does not.  Repeated
    windows merge into maximal intervals per document.

    Returns one row per input row: `id_col`, `kept` (binary, kept words joined by one space), `spans` (removed
    intervals in words), `n_units` (words), `n_removed`.  Null text: no words.  Rows that repeat are copies of
    each other.  Texts shorter than a window are kept.  Empty table: no rows.  Other columns are not read.
    """
    if not 0 < gram <= window:
        raise ValueError("gram must lie in 1..window")
    source = documents(docs, id_col, text_col)
    repeated = repeated_runs(source, word_units, window, gram, lambda runs: count_windows(with_text(source, runs.drop("at", "anchor")), word_units, window))

    def keep(text: bytes, runs: np.ndarray) -> tuple:
        words = text.split()
        if not len(runs):
            return b" ".join(words), [], len(words), 0
        gone, spans = removal(len(words), runs, window)
        return b" ".join([w for w, g in zip(words, gone.tolist()) if not g]), spans, len(words), int(gone.sum())

    out = covered(source, repeated, keep, SPAN_SCHEMA)
    return out.select(id_back(out.id).alias(id_col), "kept", "spans", "n_units", "n_removed")
