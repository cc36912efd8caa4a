"""Token ids in binary files: one zstandard frame a document, a shared dictionary, an offset index.

A file holds, in ascending document order:

    magic, sha256 of the dictionary, bytes of an id
    one frame per document: its ids and the end id, compressed alone with the dictionary
    the index as an Arrow stream (doc_id, offset, n_bytes, n_tokens), its length, magic

so a reader fetches one document by its offset, or all in order. Files are named after the task
attempt that wrote them and count only once the catalog lists them: a lost or repeated task
leaves a file nobody reads. They are written and read by ``pyarrow.fs``, which knows the usual
shared stores.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard as zstd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.llm.frames import arrow_schema, batches, narrowed, pairs, staged, store, type_of
from tidemark.llm.tokens import ID, encoder

MAGIC = b"TIDETOK1"
HEAD, HEAD_BYTES = "<8s32sB", 41
TAIL, TAIL_BYTES = "<Q8s", 16
#: The dictionary is trained on so many documents at most, drawn by hash from all, and of each on so many
#: characters at most, from a place in the text that is drawn by hash as well.
SAMPLE_DOCS, SAMPLE_CHARS, DICTIONARY_BYTES = 512, 4000, 65_536
LEVEL = 3


def narrow(ids: bytes, width: int) -> bytes:
    return np.frombuffer(ids, ID).astype(f"<u{width}").tobytes()


def train(samples: list[bytes]) -> bytes:
    """Dictionary for the samples; few or tiny ones serve as the dictionary themselves."""
    try:
        return zstd.train_dictionary(DICTIONARY_BYTES, samples, k=512, d=8).as_bytes()
    except zstd.ZstdError:
        return b"".join(samples)[:DICTIONARY_BYTES]


def _dictionary(raw: bytes) -> zstd.ZstdCompressionDict | None:
    return zstd.ZstdCompressionDict(raw) if raw else None


class TokenFile:
    """Reads documents out of one file by its index."""

    def __init__(self, path: str, dictionary: bytes) -> None:
        self._store, name = store(path)
        self._file = self._store.open_input_file(name)
        size = self._file.size()
        magic, digest, self.width = struct.unpack(HEAD, self._file.read_at(HEAD_BYTES, 0))
        length, last = struct.unpack(TAIL, self._file.read_at(TAIL_BYTES, size - TAIL_BYTES))
        if magic != MAGIC or last != MAGIC:
            raise ValueError(f"{path} is no token file")
        if digest != hashlib.sha256(dictionary).digest():
            raise ValueError(f"{path} was written with another dictionary")
        self.index = pa.ipc.open_stream(self._file.read_at(length, size - TAIL_BYTES - length)).read_all()
        self._frames = zstd.ZstdDecompressor(dict_data=_dictionary(dictionary))

    def __enter__(self) -> TokenFile:
        return self

    def __exit__(self, *_: object) -> None:
        self._file.close()

    def ids(self, place: int) -> bytes:
        """Ids of the document at this place of the index, as little-endian 32-bit integers."""
        offset, size = (self.index.column(c)[place].as_py() for c in (1, 2))
        raw = self._frames.decompress(self._file.read_at(size, offset))
        return raw if self.width == ID.itemsize else np.frombuffer(raw, f"<u{self.width}").astype(ID).tobytes()


def _write_part(folder: str, tokenizer: str, end_id: int, dictionary: bytes, width: int, kind: pa.DataType, schema: pa.Schema):
    def write(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = encoder(tokenizer).ids, np.array([end_id], ID).tobytes()
        frames = zstd.ZstdCompressor(level=LEVEL, dict_data=_dictionary(dictionary))
        number = TaskContext.get().partitionId()
        name = f"{number:06d}-{uuid.uuid4().hex}.tok"
        target, root = store(f"{folder}/files")
        places: list[tuple] = []
        out, at = None, HEAD_BYTES
        for doc_id, text in pairs(source):
            if out is None:
                target.create_dir(root, recursive=True)
                out = target.open_output_stream(f"{root}/{name}")
                out.write(struct.pack(HEAD, MAGIC, hashlib.sha256(dictionary).digest(), width))
            ids = encode(text) + end
            frame = frames.compress(narrow(ids, width))
            out.write(frame)
            places.append((doc_id, at, len(frame), len(ids) // ID.itemsize))
            at += len(frame)
        if out is None:
            return
        columns = pa.schema([("doc_id", kind), ("offset", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64())])
        index = pa.table([pa.array(c, f.type) for c, f in zip(zip(*places), columns)], schema=columns)
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, columns, options=pa.ipc.IpcWriteOptions(compression="zstd")) as stream:
            stream.write_table(index)
        raw = sink.getvalue()
        out.write(raw)
        out.write(struct.pack(TAIL, raw.size, MAGIC))
        out.close()
        yield from batches([(number, name, len(places), sum(p[3] for p in places))], schema)

    return write


def write_token_files(
    docs: DataFrame, tokenizer: str, folder: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 0
) -> None:
    """Writes all documents, in ascending order of id, as token files below ``folder``.

    A missing text is an empty one and holds the end id alone. Rows that repeat an id stay, next
    to each other, ordered by text; a missing id sorts first. Other columns are ignored. The texts
    are dealt out by ranges of ids once; a task encodes and compresses its range as it streams. The shared
    dictionary is trained on 4000 characters at most, from anywhere in the text, of 512 documents at most.
    """
    spark, rows = docs.sparkSession, narrowed(docs, id_col, text_col)
    width = 2 if max(encoder(tokenizer).tokenizer.get_vocab_size(), end_id + 1) <= 1 << 16 else ID.itemsize
    # A share of the rows that holds enough of them, by a hash, so that few travel from however many tasks.
    share = min(1.0, 4 * SAMPLE_DOCS / max(1, rows.count()))
    drawn = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30))
    place = F.pmod(F.xxhash64("text", "doc_id"), F.greatest(F.char_length("text") - SAMPLE_CHARS + 1, F.lit(1)))
    sample = (
        rows.filter((F.length("text") > 0) & (drawn <= int(share * (1 << 30))))
        .select(drawn.alias("drawn"), F.substring(F.col("text"), (place + 1).cast("int"), F.lit(SAMPLE_CHARS)).alias("text"))
        .orderBy("drawn", "text")
        .limit(SAMPLE_DOCS)
        .select("text")
    )
    dictionary = train([narrow(encoder(tokenizer).ids(r[0]), width) for r in sample.collect()])
    spark.createDataFrame([(dictionary,)], "dictionary binary").write.mode("overwrite").parquet(f"{folder}/dictionary")
    catalog = "number int, name string, n_docs long, n_tokens long"
    schema = arrow_schema(catalog)
    kind = arrow_schema(f"doc_id {type_of(rows, 'doc_id')}").field(0).type
    staged(
        rows.repartitionByRange("doc_id")
        .sortWithinPartitions("doc_id", "text")
        .mapInArrow(_write_part(folder, tokenizer, end_id, dictionary, width, kind, schema), catalog),
        f"{folder}/catalog",
    )


def read_token_files(spark: SparkSession, folder: str) -> DataFrame:
    """Documents of the files: ``doc_id``, ``start`` (ids before it), ``n_tokens``, ``ids`` (binary)."""
    dictionary = spark.read.parquet(f"{folder}/dictionary").first()[0]
    catalog = spark.read.parquet(f"{folder}/catalog")
    files = catalog.count()
    before = Window.orderBy("number").rowsBetween(Window.unboundedPreceding, -1)
    listed = catalog.select("name", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)).alias("start"))
    first = catalog.select("name").first()
    kind = "bigint"
    if first:
        with TokenFile(f"{folder}/files/{first[0]}", dictionary) as opened:
            kind = {"string": "string", "int32": "int"}.get(str(opened.index.schema.field(0).type), "bigint")
    result = f"doc_id {kind}, start long, n_tokens long, ids binary"
    schema = arrow_schema(result)

    def read(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for name, start in pairs(source):
                with TokenFile(f"{folder}/files/{name}", dictionary) as opened:
                    ids, counts = opened.index.column(0).to_pylist(), opened.index.column(3).to_pylist()
                    for place, (doc_id, count) in enumerate(zip(ids, counts)):
                        yield doc_id, start, count, opened.ids(place)
                        start += count

        yield from batches(rows(), schema)

    return listed.repartition(max(1, files)).mapInArrow(read, result)
