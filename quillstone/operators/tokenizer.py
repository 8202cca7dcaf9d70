"""GPT-2 encoding of documents, an end token after each."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstone.plans.store import small_batches


def gpt2_ranks() -> str:
    """Path of the public rank file."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def encode_with_ends(docs: DataFrame, ranks: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids): token ids of each text and the end token, which is the first id beyond the ranks.

    Special tokens in a text are encoded like any other characters.  Null
    texts are empty and have the end token alone.
    """
    small_batches(docs.sparkSession)
    path = ranks or gpt2_ranks()
    with open(path, "rb") as lines:
        raw = lines.read()
    shared = docs.sparkSession.sparkContext.broadcast(raw)  # the rank file, some 1 MB

    def kernel(batches):
        import base64

        import public_tokenizers
        import tiktoken

        table = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in shared.value.splitlines() if line)}
        own = tiktoken.Encoding("gpt2-ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={"<|endoftext|>": len(table)})
        for batch in batches:
            ids = [[*own.encode_ordinary(t or ""), len(table)] for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32()))], names=["id", "ids"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string")).mapInArrow(kernel, f"id {kind}, ids array<int>").withColumnRenamed("id", id_col)
