"""Token counts by batch encoding in Arrow functions that return lengths only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.tokens import byte_batches, count_led, shared_encoder, tokenizer_path
from quire.plans.limits import tidy


def token_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, limit: int = 512) -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit) for every row of ``docs``.

    ``tokenizer`` is the file of a byte-level tokenizer of the tokenizers
    library; counts are those of its encoding without added special tokens,
    truncation or padding. Null and empty texts have 0 tokens. Rows are counted
    one by one, so repeated rows and null ids stay, in no order. Only the two
    named columns are read.
    """
    path = tokenizer or tokenizer_path("byte_bpe_50k.json")

    def lengths(batches):
        import pyarrow as pa

        encoder = shared_encoder(path, lengths_only=True)
        for batch in batches:
            for some in byte_batches(batch, 1):
                counts = count_led(some.column(1), encoder)
                yield pa.RecordBatch.from_arrays([some.column(0), some.column(2), pa.array(counts)], ["id", "n_bytes", "n_tokens"])

    source = docs.select(
        F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long").alias("n_bytes")
    )
    id_type = source.schema["id"].dataType.simpleString()
    counted = source.mapInArrow(tidy(lengths), f"id {id_type}, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
