"""Awkward documents that every operator gets."""

from __future__ import annotations

from tidemark.llm import queries

SMALL = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, ratio string, fp string, row string"
WORDS = "the quick brown fox jumps over a lazy dog while nine other animals look on from the far bank".split()
LINE = "a line that several documents share"
TEXTS = [
    None, "", " \n\t", "\n\n", LINE, f"  {LINE.upper()} \r\nown line of five\n{LINE}", f"{LINE}\n{LINE}\nshort", "short",
    "ünïcödé 日本語 line ten", " ünïcödé 日本語 line ten\x0b", "x" * 50_000, " ".join(WORDS * 300), " ".join(WORDS * 300),
    " ".join(WORDS) + " end", "NINE nine Nine chars\nnine nine nine chars", "a b", "A  B", "same same same same same",
    "\n".join(f"line number {k} of a long text" for k in range(3000)),
]


def documents(spark):
    rows = [(k, t, "en", "src", len(t or ""), "r", "f", "x") for k, t in enumerate(TEXTS)]
    rows += [rows[4], (4, "another text under a known id", None, None, None, None, None, None)]
    rows += [(None, LINE, "en", "src", 1, "r", "f", "x"), (None, None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA).repartition(4)


def known(spark):
    """The given documents of the smallest size with the awkward ones among them."""
    given = queries.documents(spark, SMALL)
    own = documents(spark).select("doc_id", "text", "lang", "source", "n_chars")
    return given.unionByName(own.withColumn("doc_id", own["doc_id"] + 1_000_000))
