"""Two shuffles that let blocks of documents ask about the whole corpus.

`split` runs in the scan: it cuts its partition into blocks and writes rows (bucket, block, body),
where a bucket is a range of keys (words, shingles) and every block sends at most one entry for a
key. `merge` sees one bucket of all blocks and answers each block; `finish` sees the answers of one
block. A key that a third of all documents hold is therefore one entry for each block, not for each
document. Rows for the block itself go through the merge as they are (`OWN`). The number of buckets
follows the bytes of the texts, so a very large group of copies or one hot key makes no bucket larger than
its blocks do: each block sends a key once.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.textblocks import give_back, tidy

MESSAGE = "bucket int, block long, kind int, body binary"
ARROW_MESSAGE = pa.schema([("bucket", pa.int32()), ("block", pa.int64()), ("kind", pa.int32()), ("body", pa.binary())])
#: Kinds of rows: what a block keeps for itself, and what it asks a bucket.
OWN, ASKED = 0, 1
#: A bucket holds the keys of about so many bytes of text, so what one merge sees does not grow with the input.
BUCKET_BYTES = 12 << 20


def buckets(docs: DataFrame, column: str = "text") -> int:
    """Buckets for the texts of `docs`: by their bytes, and one for each shuffle partition at least."""
    size = docs.agg(F.sum(F.octet_length(F.col(column).cast("string")))).first()[0] or 0
    return max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-int(size) // BUCKET_BYTES))


def messages(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [(), (), (), ()]
    return pa.RecordBatch.from_arrays(
        [pa.array(c, type=f.type) for c, f in zip(columns, ARROW_MESSAGE, strict=True)], schema=ARROW_MESSAGE
    )


def exchange(
    docs: DataFrame,
    split: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]],
    merge: Callable[[list[tuple]], list[tuple]],
    finish: Callable[[list[tuple]], pa.Table],
    schema: str,
) -> DataFrame:
    """docs -> split -> merge by bucket -> finish by block; `merge` and `finish` get (block or bucket, body) pairs.

    Bodies are buffers that point into the batch, not copies.
    """

    def bodies(table: pa.Table) -> list[pa.Buffer]:
        return [body.as_buffer() for body in table.column("body")]

    def merged(table: pa.Table) -> pa.Table:
        asked = table.filter(pc.equal(table.column("kind"), ASKED))
        own = table.filter(pc.equal(table.column("kind"), OWN))
        bucket = table.column("bucket")[0].as_py()
        answers = merge(list(zip(asked.column("block").to_pylist(), bodies(asked), strict=True)))
        replies = pa.Table.from_batches([messages([(bucket, block, ASKED, body) for block, body in answers])])
        give_back()
        return pa.concat_tables([own.cast(ARROW_MESSAGE), replies])

    def finished(table: pa.Table) -> pa.Table:
        rows = zip(*(table.column(n).to_pylist() for n in ("kind", "bucket")), bodies(table), strict=True)
        done = finish(sorted(rows, key=lambda r: r[:2]))
        give_back()
        return done

    sent = docs.mapInArrow(tidy(split), MESSAGE)
    answered = sent.groupBy("bucket").applyInArrow(merged, MESSAGE)
    return answered.groupBy(F.col("block")).applyInArrow(finished, schema)
