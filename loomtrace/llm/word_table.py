"""Encoding and decoding through a table of distinct words (operator 13).

1. A task cuts its texts into words, chunk by chunk (some megabytes of texts, or one longer text).
   A chunk's distinct words are numbered; its texts, as numbers, go to a file in the shared folder.
   The words themselves are dealt to buckets by their hash, a block for each chunk and bucket.
2. Blocks meet by bucket. There each distinct word is encoded once, whatever the chunks that have
   it, and every block gets back the ids of its words, in its order.
3. Blocks meet again by chunk: the word's place in the chunk's table joins its ids to all places of
   the text that hold its number. Ids are joined with the vocabulary's pieces once per word of the
   table, and a text is decoded from its words.

Words and ids are shuffled once per chunk and distinct word, occurrences never. A common word costs a
few bytes a chunk, and no group holds more than a chunk (3) or a bucket's distinct words (2; these
are dropped bucket by bucket). Files count only if the stored block table names them, so lost and
repeated tasks leave no trace.

The tokenizer must drop white space and cut at it, and decode by joining pieces with blanks, as files
with word-end marks and without a decoder do; others are refused.

Cases: null texts count as empty: no ids, an empty text. Words without ids (white space beyond ASCII
alone) leave no trace. Special tokens inside texts are encoded and decoded as such. Repeated rows and
ids, null ids too, each give a row. A text longer than a chunk is one chunk. An empty table gives no
rows.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql.types import StructType

from .storage import materialise, new_folder, read_bytes, write_bytes
from .texts import as_bytes, caches, id_first, numbered, pieces, working
from .token_output import Encoder

#: Texts of a chunk, in bytes.
CHUNK_BYTES = 16 << 20
BUCKETS = 1024

#: words: separated by blanks, compressed.
BLOCKS = "path string, bucket int, start long, words binary"
CODED = "path string, start long, lengths binary, ids binary"


# ---- a chunk's file: documents, the bucket of each distinct word, the words of all texts ------


def packed(numbers: np.ndarray) -> bytes:
    """Non-negative numbers as planes of their bytes, each compressed: high bytes are mostly alike."""
    planes = range((int(numbers.max(initial=0)).bit_length() + 7) // 8)
    parts = [zstandard.compress((numbers >> (8 * k)).astype(np.uint8).tobytes()) for k in planes]
    return struct.pack("<QB", len(numbers), len(parts)) + b"".join(struct.pack("<Q", len(x)) + x for x in parts)


def unpacked(data: bytes, at: int = 0) -> tuple[np.ndarray, int]:
    """The reverse of ``packed``, and where it ends."""
    n, count = struct.unpack_from("<QB", data, at)
    at, out = at + 9, np.zeros(n, np.int64)
    for k in range(count):
        (size,) = struct.unpack_from("<Q", data, at)
        plane = zstandard.decompress(data[at + 8 : at + 8 + size])
        out |= np.frombuffer(plane, np.uint8).astype(np.int64) << (8 * k)
        at += 8 + size
    return out, at


def pack_chunk(ids: pa.Array, counts: np.ndarray, bucket: np.ndarray, numbers: np.ndarray) -> bytes:
    """Document ids with the number of their words, each distinct word's bucket, each word's number."""
    batch = pa.RecordBatch.from_arrays([ids], names=["id"])
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema) as out:
        out.write_batch(batch)
    return packed(counts) + packed(bucket) + packed(numbers) + sink.getvalue().to_pybytes()


def unpack_chunk(data: bytes) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    counts, at = unpacked(data)
    bucket, at = unpacked(data, at)
    numbers, at = unpacked(data, at)
    with pa.ipc.open_stream(pa.py_buffer(data[at:])) as source:
        return source.read_all().column(0).combine_chunks(), counts, bucket, numbers


def by_bucket(bucket: np.ndarray) -> np.ndarray:
    """The order in which blocks hold the words of a chunk's table."""
    return np.argsort(bucket, kind="stable")


def chunks(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[tuple[pa.Array, list[bytes]]]:
    """Ids and texts of about ``most`` bytes, across batches; a longer text is alone."""
    ids: list[pa.Array] = []
    texts: list[bytes] = []
    size = 0
    for batch in batches:
        for piece in pieces(batch, "text", most):
            own = as_bytes(piece.column("text"))
            if texts and size + sum(map(len, own)) > most:
                yield pa.concat_arrays(ids), texts
                ids, texts, size = [], [], 0
            ids.append(piece.column("id"))
            texts += own
            size += sum(map(len, own))
    if texts:
        yield pa.concat_arrays(ids), texts


# ---- the steps ----------------------------------------------------------------------------


def word_blocks(docs: DataFrame, folder: str, id_col: str, text_col: str, chunk_bytes: int = CHUNK_BYTES, buckets: int = BUCKETS) -> DataFrame:
    """Step 1: writes the chunk files; path, bucket, place of the first word in the chunk's table,
    and the block's words. A chunk without words has one empty block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in chunks(batches, chunk_bytes):
            words, index, counts = numbered(texts)
            bucket = np.array([zlib.crc32(w) % buckets for w in words.tolist()], np.int64)
            order = by_bucket(bucket)
            path = f"{folder}/{uuid.uuid4().hex}.words"
            write_bytes(path, pack_chunk(ids, counts, bucket, index))
            own, starts = np.unique(bucket[order], return_index=True)
            own, starts = (own, starts) if len(own) else (np.zeros(1, np.int64), np.zeros(1, np.int64))
            ordered = words[order].tolist()
            blocks = [zstandard.compress(b" ".join(ordered[a:b])) for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(ordered)])]
            yield pa.RecordBatch.from_arrays([pa.array([path] * len(own)), pa.array(own, pa.int32()), pa.array(starts, pa.int64()), pa.array(blocks, pa.binary())], names=["path", "bucket", "start", "words"])

    return docs.select(docs[id_col].alias("id"), docs[text_col].alias("text")).mapInArrow(working("words", run), BLOCKS)


_ENCODERS: dict[str, Encoder] = {}
caches("words", _ENCODERS.clear)


def _encoder(path: str) -> Encoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path, word_local=True)
        _ENCODERS[path].tokenizer.no_truncation()
        _ENCODERS[path].tokenizer.no_padding()
    return _ENCODERS[path]


def coded(tokenizer: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """What turns blocks that come bucket by bucket into the ids of their words. A bucket's words are
    held while it lasts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, at, known = _encoder(tokenizer), None, {}
        for batch in batches:
            buckets = batch.column("bucket").to_numpy()
            texts = [zstandard.decompress(x) for x in batch.column("words").to_pylist()]
            lists = [x.split(b" ") if x else [] for x in texts]
            lengths, ids = [], []
            for begin in [0, *(np.flatnonzero(np.diff(buckets)) + 1).tolist()]:
                end = begin + int(np.searchsorted(buckets[begin:], buckets[begin], side="right"))
                if buckets[begin] != at:
                    at, known = buckets[begin], {}
                new = [w for w in dict.fromkeys(w for x in lists[begin:end] for w in x) if w not in known]
                known.update(zip(new, encoder.words(new)))
                for words in lists[begin:end]:
                    spelled = [known[w] for w in words]
                    lengths.append(packed(np.array([len(x) // 4 for x in spelled], np.int64)))
                    ids.append(packed(np.frombuffer(b"".join(spelled), "<u4")))
            encoder.tails = {"": b""}  # what the encoder keeps of punctuation would grow with the words
            yield pa.RecordBatch.from_arrays([batch.column("path"), batch.column("start"), pa.array(lengths, pa.binary()), pa.array(ids, pa.binary())], names=["path", "start", "lengths", "ids"])

    return run


def coded_blocks(blocks: DataFrame, tokenizer: str) -> DataFrame:
    """Step 2: the ids of each block's words."""
    return blocks.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(working("words", coded(tokenizer)), CODED)


def vocabulary(tokenizer: str) -> pa.Array:
    """The piece of each id: the vocabulary's own size bounds it. Refuses files that this operator
    does not fit."""
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(tokenizer)
    own.no_truncation()
    own.no_padding()
    probe = "one  Two,\tone's\né́ (3)"
    apart = [i for w in probe.split() for i in own.encode(w, add_special_tokens=False).ids]
    if own.decoder is not None or own.encode(probe, add_special_tokens=False).ids != apart:
        raise ValueError("this tokenizer does not encode words on their own, or has a decoder")
    pieces_by_id = {i: x for x, i in own.get_vocab(with_added_tokens=True).items()}
    return pa.array([pieces_by_id.get(i) for i in range(max(pieces_by_id, default=-1) + 1)], pa.large_string())


def gathered(flat: np.ndarray, sizes: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Runs of ``flat`` (the i-th has sizes[i] entries), those at ``at`` end to end."""
    starts = (np.cumsum(sizes) - sizes)[at]
    n = sizes[at]
    return flat[np.arange(int(n.sum())) + np.repeat(starts - (np.cumsum(n) - n), n)]


def joined(values: pa.Array, sizes: np.ndarray) -> pa.Array:
    """Runs of strings joined with blanks."""
    offsets = pa.array(np.append(0, np.cumsum(sizes)), pa.int64())
    return pc.binary_join(pa.LargeListArray.from_arrays(offsets, values), pa.scalar(" ", pa.large_string()))


def documents(blocks: DataFrame, pieces_by_id: pa.Array, schema: StructType) -> DataFrame:
    """Step 3: a row per document of each chunk, with its ids and its decoded text as digests."""
    shared = blocks.sparkSession.sparkContext.broadcast(pieces_by_id)

    def run(table: pa.Table) -> pa.Table:
        rows = table.sort_by("start")
        ids, sizes = (np.concatenate([unpacked(x)[0] for x in rows.column(c).to_pylist()]) for c in ("ids", "lengths"))
        doc_ids, counts, bucket, numbers = unpack_chunk(read_bytes(rows.column("path")[0].as_py()))
        place = np.empty(len(bucket), np.int64)
        place[by_bucket(bucket)] = np.arange(len(bucket))
        words = joined(shared.value.take(pa.array(ids)), sizes)  # id to piece, once a word
        ends = np.cumsum(counts)
        n_tokens, ids_digest, text_digest = [], [], []
        for begin, end in zip((ends - counts).tolist(), ends.tolist()):
            own = place[numbers[begin:end]]
            own = own[sizes[own] > 0]
            found = gathered(ids, sizes, own).astype("<u4")
            text = joined(words.take(pa.array(own)), np.array([len(own)]))[0].as_buffer() if len(own) else b""
            n_tokens.append(len(found))
            ids_digest.append(hashlib.sha256(found.tobytes()).hexdigest())
            text_digest.append(hashlib.sha256(text).hexdigest())
        return pa.table([doc_ids, pa.array(n_tokens, pa.int64()), pa.array(ids_digest, pa.string()), pa.array(text_digest, pa.string())], names=schema.names)

    return blocks.groupBy("path").applyInArrow(run, schema)


def encode_decode(docs: DataFrame, tokenizer: str, *, id_col: str = "doc_id", text_col: str = "text", chunk_bytes: int = CHUNK_BYTES, buckets: int = BUCKETS) -> DataFrame:
    """Each document's number of ids, and digests of its ids and of what they decode to."""
    pieces_by_id = vocabulary(tokenizer)
    folder = new_folder(docs.sparkSession, "word-chunks")
    blocks = materialise(word_blocks(docs, folder, id_col, text_col, chunk_bytes, buckets), "word-blocks")
    return documents(coded_blocks(blocks, tokenizer), pieces_by_id, id_first(docs, id_col, id_col, "n_tokens long, ids_sha256 string, decoded_sha256 string"))
