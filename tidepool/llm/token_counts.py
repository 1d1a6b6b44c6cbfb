"""Token counts of whole texts by the whole-token shortcut.

One narrow pass over (id, text), no exchange. A worker proves once which vocabulary strings encode
alone as one token; a pre-token among them counts as one, only the rest is merged, and merged words
are remembered in a bounded table. Whole-token proof and table are per worker process, so a lost
executor costs a rerun of its partitions and nothing else.

Null text counts as empty: zero bytes, zero tokens. A null id is kept as null, repeated rows give
repeated results, an empty table gives an empty result, and other columns are left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepool.llm.common import pick

SCHEMA = "doc_id long, n_bytes long, n_tokens long"


def token_counts(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes (UTF-8) and n_tokens of every row."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from tidepool.llm.vocab import byte_bpe

        bpe = byte_bpe(tokenizer_path)
        for batch in batches:
            n = pa.array([bpe.count(t.as_py()) for t in batch.column(2)], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), n], ["doc_id", "n_bytes", "n_tokens"])

    rows = pick(docs, doc_id=(id_col, "long"), text=(text_col, "string")).fillna("", ["text"])
    return rows.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), "text").mapInArrow(count, SCHEMA)
