from __future__ import annotations

import pytest

LONG = "una frase larga, con palabras; " * 4000
DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that results and inner steps use, as columns of the input.
CLASHING = "score double, kept boolean, spans string, ids string, fingerprint string, component_id long, bin string, label string, row string, n_words string, base_failed string, lang_pred string, shard string, cluster string, node string, held_out string, dropped_id long, shared_id long, row_print long, missing boolean"


@pytest.fixture
def documents(spark):
    """Frame of documents from (doc_id, text) or longer rows; with columns of clashing names on request."""

    def make(*rows, clashing=False):
        full = [(*r, *("en", "s", None)[len(r) - 2 :]) for r in rows]
        if not clashing:
            return spark.createDataFrame(full, DOCUMENTS)
        extra = len(CLASHING.split(", "))
        return spark.createDataFrame([(*r, *[None] * extra) for r in full], f"{DOCUMENTS}, {CLASHING}")

    return make


@pytest.fixture
def odd(documents):
    """Nulls in every column, empty and very long texts, ties, repeated rows, clashing names."""
    return documents(
        (1, None), (2, ""), (3, " \n\t "), (None, "no id here, but some words to read and keep"), (4, LONG, "es", "t"),
        (5, "the same words twice over", None, None), (5, "the same words twice over", None, None), (6, "x", "en", None),
        (7, "the same words twice over", "en", "s"), (None, None, None, None, None), clashing=True,
    )


@pytest.fixture
def none(documents):
    return documents()
