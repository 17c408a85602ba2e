"""A bounded sample of labelled documents, for the classifiers that are fitted on the driver."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .frames import cut

#: Expected bounds of the sample: labelled rows, and bytes of their texts.
SAMPLE_ROWS = 8_000
SAMPLE_BYTES = 24_000_000
#: Values of the coins: far more than labels, so that a sample of billions isn't empty.
COIN = 1 << 40


def fold(doc_id: str | Column, parts: int) -> Column:
    """crc32 of the id as text, modulo parts; null ids get null."""
    return F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(parts)) if isinstance(doc_id, str) else F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(parts))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, usable: Column, rows: int = SAMPLE_ROWS, size: int = SAMPLE_BYTES) -> pa.Table:
    """text, lang (null where docs have none) and label of labelled rows whose doc_id is `usable`.

    Rows are chosen by a hash of the doc_id, with the probabilities that meet both bounds in
    expectation.  The chosen labels are broadcast: at most about `rows` of them.  Rows
    without id, text or label are left out; an id labelled twice counts as its larger label,
    an id of several rows is taken once, with its smallest text.
    """
    known = labels.select(F.col("doc_id").alias("_id"), F.col(label).cast("int").alias("_label")).filter(F.col("_id").isNotNull() & F.col("_label").isNotNull())
    known = known.groupBy("_id").agg(F.max("_label").alias("_label")).filter(usable)
    n = known.count()
    coin = F.pmod(F.xxhash64(F.col("_id"), F.lit(17)), F.lit(COIN))
    chosen = known.filter(coin < int(COIN * min(1.0, rows / max(n, 1))))
    lang = F.col("lang") if "lang" in docs.columns else F.lit(None).cast("string")
    found = docs.select("doc_id", "text", lang.alias("_lang")).filter("text is not null").join(F.broadcast(chosen), F.col("doc_id") == F.col("_id"))
    # one row an id, however many there are, kept so that the documents are scanned once
    found = cut(found.groupBy("_id", "_label").agg(F.min(F.struct("text", "_lang")).alias("_one")).select("_id", "_label", "_one.*"))
    total = found.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    again = F.pmod(F.xxhash64(F.col("_id"), F.lit(18)), F.lit(COIN))
    found = found.filter(again < int(COIN * min(1.0, size / max(total, 1))))
    picked = found.select(F.col("text").alias("text"), F.col("_lang").alias("lang"), F.col("_label").alias("label"), F.col("_id").alias("id")).toArrow()
    return picked.sort_by([("id", "ascending")]) if len(picked) else picked
