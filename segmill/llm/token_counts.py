"""Token counts of whole texts by a compiled finite-state tokenizer.

Every text runs through the transducer of ``transducer``. A text of more than
``CHUNK`` characters is cut anywhere, and its chunks run in parallel. What a
chunk does is a map from the state before it to the state after it and the
change of the count; maps of neighbouring chunks compose to the map of both, so
a prefix scan over a text's chunks gives the count up to every one of them, in
as many steps as the number of chunks has binary digits.

A chunk's map is evaluated where it is needed. A first guess of the state
before it comes from running the ``BACK`` characters before it from the start.
Then the states that a chunk's map reaches and the next one's does not hold yet
are evaluated in rounds. States that differ soon become equal, so one round
mostly does. A text whose chunks still hand on new states after ``ROUNDS``
rounds (one endless word) is read in order by one task, chunk by chunk.

Defined results: a null text is empty and has no tokens. One row comes out per
row that goes in, repeated rows and null ids included. An empty table gives an
empty result. Columns other than the key and the text are ignored, whatever
their names.
"""

from __future__ import annotations

import ast
from collections.abc import Iterable, Iterator

import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from segmill.llm.transducer import START, transducer
from segmill.session import checkpointed

#: Characters of a chunk, and of what is read before it to guess the state.
CHUNK, BACK = 1 << 16, 256
ROUNDS = 6
_MAP = "key string, chunk long, entry string, exit string, n long"
_START = repr(START)


def _counted(raw: Broadcast, chunk: int, arrow_kind: pa.DataType):
    """Rows of documents (with a count, or the key of a long text) and of long texts' chunks."""

    def each(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = transducer(raw.value)
        for batch in batches:
            counts, keys = [], []
            for text in batch.column(1):
                text = text.as_py() or ""
                if len(text) <= chunk:
                    counts.append(machine.count(text)), keys.append(None)
                    continue
                keys.append(xxhash.xxh128_hexdigest(text.encode())), counts.append(None)
                starts = range(0, len(text), chunk)
                for k, at in enumerate(starts):
                    yield _rows(
                        [None], [None], keys[-1:], [k], [at + chunk >= len(text)], [text[max(0, at - BACK) : at]], [text[at : at + chunk]], arrow_kind
                    )
            none = [None] * len(keys)
            yield _rows(batch.column(0), counts, keys, none, none, none, none, arrow_kind)

    return each


def _rows(doc, n, key, chunk, last, back, text, arrow_kind) -> pa.RecordBatch:
    columns = [doc if isinstance(doc, pa.Array) else pa.array(doc, arrow_kind), pa.array(n, pa.int64()), pa.array(key, pa.string())]
    columns += [pa.array(chunk, pa.int64()), pa.array(last, pa.bool_()), pa.array(back, pa.string()), pa.array(text, pa.string())]
    return pa.RecordBatch.from_arrays(columns, ["doc", "n_tokens", "key", "chunk", "last", "back", "text"])


def _mapped(raw: Broadcast):
    """Evaluate chunks: from ``entry``, or where that is null from a guess by what is before."""

    def each(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = transducer(raw.value)
        for batch in batches:
            for row in batch.to_pylist():
                entry = ast.literal_eval(row["entry"]) if row["entry"] else machine.run(START, row["back"])[0]
                after, n = machine.run(entry, row["text"])
                if row["last"]:
                    n, after = n + machine.finish(after), None
                columns = [pa.array([row["key"]]), pa.array([row["chunk"]]), pa.array([repr(entry)])]
                columns += [pa.array([after and repr(after)], pa.string()), pa.array([n])]
                yield pa.RecordBatch.from_arrays(columns, ["key", "chunk", "entry", "exit", "n"])

    return each


def _in_order(raw: Broadcast):
    """The counts of texts whose chunks come in order."""

    def each(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine, state, total = transducer(raw.value), START, 0
        for batch in batches:
            for row in batch.to_pylist():
                state, n = machine.run(START if row["chunk"] == 0 else state, row["text"])
                total = n if row["chunk"] == 0 else total + n
                if row["last"]:
                    yield pa.RecordBatch.from_pydict({"key": [row["key"]], "n": [total + machine.finish(state)]})

    return each


def chunk_maps(chunks: DataFrame, vocabulary: Broadcast) -> tuple[DataFrame, DataFrame]:
    """``key, chunk, entry, exit, n`` as far as needed, and the ``key`` of texts whose states do not become equal.

    ``chunks`` holds ``key, chunk, last, back, text``.
    """
    first = chunks.withColumn("entry", F.lit(None).cast("string"))
    maps = checkpointed(first.mapInArrow(_mapped(vocabulary), _MAP))
    for turn in range(ROUNDS + 1):
        reached = maps.where("exit IS NOT NULL").select("key", (F.col("chunk") + 1).alias("chunk"), F.col("exit").alias("entry")).distinct()
        wanted = checkpointed(reached.join(maps, ["key", "chunk", "entry"], "left_anti"))
        if turn == ROUNDS or wanted.isEmpty():
            return maps, wanted.select("key").distinct()
        found = chunks.join(wanted, ["key", "chunk"]).mapInArrow(_mapped(vocabulary), _MAP)
        maps = maps.unionByName(checkpointed(found))


def scanned(maps: DataFrame) -> DataFrame:
    """``key, chunk, exit, n``: the state after each chunk and the count up to it, by a prefix scan of composed maps.

    In the step of width ``w`` a chunk's map takes the composed map that ends
    ``w`` chunks earlier before itself; then it begins twice as far back.
    """
    width, longest = 1, maps.agg(F.max("chunk")).first()[0] or 0
    spans = maps
    while width <= longest:
        earlier = spans.select("key", (F.col("chunk") + width).alias("chunk"), F.col("entry").alias("begin"), F.col("exit").alias("entry"), F.col("n").alias("before"))
        joined = spans.where(F.col("chunk") >= width).join(earlier, ["key", "chunk", "entry"])
        composed = joined.select("key", "chunk", F.col("begin").alias("entry"), "exit", (F.col("before") + F.col("n")).alias("n"))
        spans = checkpointed(spans.where(F.col("chunk") < width).unionByName(composed))
        width *= 2
    return spans.where(F.col("entry") == _START).select("key", "chunk", "exit", "n")


def token_counts(docs: DataFrame, vocabulary: Broadcast, doc_id: str = "doc_id", text: str = "text", chunk: int = CHUNK) -> DataFrame:
    """``doc_id, n_bytes`` (UTF-8) and ``n_tokens`` of every row's whole text."""
    body = F.col(text).cast("string")
    row = F.struct(F.col(doc_id).alias("doc_id"), F.coalesce(F.octet_length(body), F.lit(0)).cast("long").alias("n_bytes"))
    source = docs.select(row.alias("doc"), body.alias("text"))
    kind, arrow_kind = source.schema["doc"].dataType.simpleString(), source.select("doc").limit(0).toArrow().schema.field(0).type
    schema = f"doc {kind}, n_tokens long, key string, chunk long, last boolean, back string, text string"
    rows = checkpointed(source.mapInArrow(_counted(vocabulary, chunk, arrow_kind), schema))
    chunks = rows.where("chunk IS NOT NULL").groupBy("key", "chunk").agg(F.first("last").alias("last"), F.first("back").alias("back"), F.first("text").alias("text"))
    chunks = checkpointed(chunks)  # equal texts once, spread over the tasks
    maps, endless = chunk_maps(chunks, vocabulary)
    totals = scanned(maps).where("exit IS NULL").select("key", "n").join(endless, "key", "left_anti")
    ordered = chunks.join(endless, "key").repartition("key").sortWithinPartitions("key", "chunk")
    totals = checkpointed(totals.unionByName(ordered.mapInArrow(_in_order(vocabulary), "key string, n long")))
    counted = rows.where("chunk IS NULL")
    short = counted.where("key IS NULL").select("doc.*", "n_tokens")
    long = counted.where("key IS NOT NULL").select("doc.*", "key")
    long = long.join(totals, "key").select("doc_id", "n_bytes", F.col("n").alias("n_tokens"))
    return short.unionByName(long)
