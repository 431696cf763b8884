"""Distinct documents of a line: whole texts, however much they share."""

import random

from scanlake.llm import quality

DOCS = "doc_id long, text string, source string"


def test_documents_that_share_most_words_count_each(spark):
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    rows = []
    for host in range(10):
        shared = [" ".join(word() for _ in range(20)) for _ in range(3)]
        rows += [(100 * host + i, "\n".join([*shared, " ".join(word() for _ in range(15))]), f"h{host}") for i in range(40)]
        copy = "\n".join(" ".join(word() for _ in range(20)) for _ in range(4))
        rows += [(100 * host + 50 + i, copy, f"h{host}") for i in range(40)]  # one document, forty times
    got = {r.doc_id: r for r in quality.quality_rules(spark.createDataFrame(rows, DOCS)).collect()}
    for i, r in got.items():
        assert (r.removed_words, r.kept) == ((60, False) if i % 100 < 50 else (0, True))
