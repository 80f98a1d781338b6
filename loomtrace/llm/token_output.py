"""Token ids in compact binary files (operator 10).

Ids are cut into blocks of 1,024. A block stores its minimum once and the differences from it,
packed at the width that a percentile of them needs; wider ones go to the block's exception list
(patched frame of reference). A file ends with the byte offset of each block and an index of its
documents, so any document can be read without decoding what is before it.

Documents are dealt by ranges of their id, sorted within a range and written by the task that
encodes them; a task starts a new file when one is full, so memory does not follow the input.
Files get names of their own and count only once the manifest lists them: a retried task leaves
no trace in the result.

A tokenizer that drops white space encodes each white-space separated word on its own, so one
encoding per distinct word and worker is enough (``word_local``; each task checks the first texts
of its first piece against encoding them whole). Words are lower-cased before where that changes
nothing. The words that a worker holds are bounded in number and bytes.

Cases: null texts count as empty (the end id alone); documents without id come first; equal ids
are all kept, next to each other. An empty table gives no files and no rows. Ids are 64-bit integers:
the files hold them as such, integers in text form are cast, and any other text stops the job.
"""

from __future__ import annotations

import re
import struct
import uuid
import zlib
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import filesystem, materialise, new_folder, write_bytes
from .texts import as_bytes, caches, numbered, pieces, working

BLOCK = 1024
MAGIC = b"PFORIDS1"
#: Share of a block's differences that must fit into the packed width.
PERCENTILE = 0.9
#: Ids of a file, about; a piece of texts (1 MB, or one text) stays together.
FILE_IDS = 1 << 20


# ---- file format -------------------------------------------------------------------------


def _bits(x: np.ndarray) -> np.ndarray:
    return np.ceil(np.log2(x.astype(np.float64) + 1)).astype(np.int64)


def _pack(values: np.ndarray, width: int) -> np.ndarray:
    """(n, 1024) numbers below 2^width to (n, 16 * width) 64-bit words."""
    lanes = values.reshape(len(values), -1, 64).transpose(2, 0, 1)
    out = np.zeros((width, *lanes.shape[1:]), np.uint64)
    for k in range(64):
        word, shift = divmod(k * width, 64)
        out[word] |= lanes[k] << np.uint64(shift)
        if shift + width > 64:
            out[word + 1] |= lanes[k] >> np.uint64(64 - shift)
    return np.ascontiguousarray(out.transpose(1, 2, 0)).reshape(len(values), -1)


def _unpack(words: np.ndarray, width: int) -> np.ndarray:
    """The reverse of ``_pack``."""
    lanes = np.ascontiguousarray(words.reshape(len(words), -1, width).transpose(2, 0, 1))
    out = np.zeros((64, *lanes.shape[1:]), np.uint64)
    mask = np.uint64((1 << width) - 1)
    for k in range(64):
        word, shift = divmod(k * width, 64)
        out[k] = lanes[word] >> np.uint64(shift)
        if shift + width > 64:
            out[k] |= lanes[word + 1] << np.uint64(64 - shift)
    out &= mask
    return np.ascontiguousarray(out.transpose(1, 2, 0)).reshape(len(words), -1)


def encode_file(ids: np.ndarray, doc_ids: list[int | None], lengths: np.ndarray) -> bytes:
    """A file's bytes: blocks, then block starts, document index and the numbers of all three."""
    n_blocks = -(-len(ids) // BLOCK)
    padded = np.zeros(n_blocks * BLOCK, np.uint64)
    padded[: len(ids)] = ids
    if len(ids):
        padded[len(ids) :] = ids[-1]
    blocks = padded.reshape(n_blocks, BLOCK)
    low = blocks.min(axis=1) if n_blocks else np.zeros(0, np.uint64)
    delta = blocks - low[:, None]
    at = int(PERCENTILE * (BLOCK - 1))
    width = _bits(np.partition(delta, at, axis=1)[:, at]) if n_blocks else np.zeros(0, np.int64)
    body: list[bytes] = [b""] * n_blocks
    for w in np.unique(width).tolist():
        own = np.flatnonzero(width == w)
        packed = _pack(delta[own] & np.uint64((1 << w) - 1), w) if w else np.zeros((len(own), 0), np.uint64)
        over_block, over_at = np.nonzero(delta[own] >> np.uint64(w))
        bounds = np.searchsorted(over_block, np.arange(len(own) + 1))
        high = (delta[own] >> np.uint64(w))[over_block, over_at].astype("<u4")
        places = over_at.astype("<u2")
        for i, b in enumerate(own.tolist()):
            lo, hi = bounds[i], bounds[i + 1]
            body[b] = struct.pack("<IBH", int(low[b]), w, hi - lo) + packed[i].astype("<u8").tobytes() + places[lo:hi].tobytes() + high[lo:hi].tobytes()
    starts = np.cumsum([len(MAGIC)] + [len(x) for x in body]).astype("<u8")
    known = np.array([x is not None for x in doc_ids], np.uint8)
    numbers = np.array([x or 0 for x in doc_ids], "<i8")
    index = starts.tobytes() + numbers.tobytes() + known.tobytes() + lengths.astype("<u8").tobytes()
    return b"".join([MAGIC, *body, index, struct.pack("<QQQ", len(ids), n_blocks, len(doc_ids)), MAGIC])


def _tail(data: bytes) -> tuple[int, np.ndarray, list[int | None], np.ndarray]:
    if data[:8] != MAGIC or data[-8:] != MAGIC:
        raise ValueError("not a token-id file, or cut short")
    n_ids, n_blocks, n_docs = struct.unpack("<QQQ", data[-32:-8])
    at = len(data) - 32 - 8 * (n_blocks + 1) - 17 * n_docs
    starts = np.frombuffer(data, "<u8", n_blocks + 1, at)
    numbers = np.frombuffer(data, "<i8", n_docs, at := at + 8 * (n_blocks + 1))
    known = np.frombuffer(data, "u1", n_docs, at := at + 8 * n_docs)
    lengths = np.frombuffer(data, "<u8", n_docs, at + n_docs)
    return n_ids, starts, [x if k else None for x, k in zip(numbers.tolist(), known.tolist())], lengths


def decode_blocks(data: bytes, starts: np.ndarray, first: int, last: int) -> np.ndarray:
    """Ids of the blocks first to last - 1, padding included."""
    heads = [struct.unpack_from("<IBH", data, int(s)) for s in starts[first:last]]
    out = np.zeros((last - first, BLOCK), np.uint64)
    width = np.array([w for _, w, _ in heads], np.int64)
    for w in np.unique(width).tolist():
        own = np.flatnonzero(width == w)
        if w:
            size = BLOCK * w // 8
            raw = b"".join(data[(s := int(starts[first + i]) + 7) : s + size] for i in own.tolist())
            out[own] = _unpack(np.frombuffer(raw, "<u8").reshape(len(own), -1), w)
        for i in own.tolist():
            if n := heads[i][2]:
                at = int(starts[first + i]) + 7 + BLOCK * w // 8
                places = np.frombuffer(data, "<u2", n, at)
                out[i, places] |= np.frombuffer(data, "<u4", n, at + 2 * n).astype(np.uint64) << np.uint64(w)
    out += np.array([low for low, _, _ in heads], np.uint64)[:, None]
    return out.reshape(-1).astype("<u4")


def decode_file(data: bytes) -> tuple[np.ndarray, list[int | None], np.ndarray]:
    """All ids, the document ids and how many ids each has."""
    n_ids, starts, doc_ids, lengths = _tail(data)
    return decode_blocks(data, starts, 0, len(starts) - 1)[:n_ids], doc_ids, lengths


def decode_document(data: bytes, at: int) -> np.ndarray:
    """The ids of the document with this place in the file, from its own blocks alone."""
    _, starts, _, lengths = _tail(data)
    begin = int(lengths[:at].sum())
    end = begin + int(lengths[at])
    first, last = begin // BLOCK, -(-end // BLOCK)
    return decode_blocks(data, starts, first, last)[begin - first * BLOCK : end - first * BLOCK]


# ---- encoding ----------------------------------------------------------------------------


#: Lower-case Latin letters, then ASCII punctuation: one piece of each to the tokenizer.
_PLAIN = re.compile(r"([a-zß-öø-ÿ]+)([!-/:-@\[-`{-~]*)")


def _byte_letters() -> dict[int, str]:
    """The character that a byte-level vocabulary writes for each byte. Printable
    Latin-1 characters stand for themselves, all others follow from U+0100 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [x for x in range(256) if x not in own]
    return {x: chr(x) for x in own} | {x: chr(256 + i) for i, x in enumerate(rest) if x != 0x20}


class WordIds:
    """Texts to ids, word by word: each distinct word is spelled once and numbered; a text is then the
    numbers of its words, and its ids are gathered from one array by these numbers.

    At most ``most_words`` words of ``most_bytes`` in all stay from one call to the next; beyond
    that, those that came but once go first."""

    def __init__(self, most_words: int = 300_000, most_bytes: int = 8 << 20):
        self.most_words, self.most_bytes = most_words, most_bytes
        self.forget()

    def folded(self, text: bytes) -> bytes:
        return text

    def words(self, words: list[bytes]) -> list[bytes]:
        """The ids of each word, as little-endian 32-bit bytes."""
        raise NotImplementedError

    def forget(self) -> None:
        self.number: dict[bytes, int] = {}
        self.ids, self.ends_at, self.seen, self.held_bytes = np.zeros(0, "<u4"), np.zeros(1, np.int64), np.zeros(0, np.int64), 0

    def encode(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts end to end, and how many each has."""
        names, index, counts = numbered([self.folded(x) for x in texts])
        return self.gather(self.places(names), index, counts)

    def places(self, names: np.ndarray) -> np.ndarray:
        """The numbers of distinct words, which stay until the next call; new ones are spelled."""
        if len(self.number) > self.most_words or self.held_bytes > self.most_bytes:
            self._shrink()
        number, listed = self.number, names.tolist()
        place = np.fromiter(map(number.get, listed, repeat(-1)), np.int64, len(listed))
        fresh = np.flatnonzero(place < 0)
        new = [listed[i] for i in fresh.tolist()]
        place[fresh] = np.arange(len(number), len(number) + len(new))
        number.update(zip(new, place[fresh].tolist()))
        self.held_bytes += sum(map(len, new))
        spelled = self.words(new)
        self.ids = np.concatenate([self.ids, np.frombuffer(b"".join(spelled), "<u4")])
        self.ends_at = np.concatenate([self.ends_at, self.ends_at[-1] + np.cumsum([len(x) // 4 for x in spelled], dtype=np.int64)])
        self.seen = np.concatenate([self.seen, np.zeros(len(new), np.int64)])
        return place

    def gather(self, place: np.ndarray, index: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The same as ``encode`` for words that are numbered already: each word is one of ``place``."""
        self.seen[place] += np.bincount(index, minlength=len(place))
        words = place[index]
        starts, sizes = self.ends_at[words], np.diff(self.ends_at)[words]
        before = np.cumsum(sizes) - sizes
        out = self.ids[np.arange(int(sizes.sum())) + np.repeat(starts - before, sizes)]
        total = np.append(0, np.cumsum(sizes))
        ends = np.cumsum(counts)
        return out, total[ends] - total[ends - counts]

    def _shrink(self) -> None:
        """Keep words that came more than once, the most frequent up to half of what may stay."""
        names = np.array(list(self.number), object)
        order = np.argsort(-self.seen, kind="stable")[: self.most_words // 2]
        kept = order[self.seen[order] > 1]
        size = np.cumsum([len(x) for x in names[kept]])
        kept = np.sort(kept[size <= self.most_bytes // 2]) if len(kept) else kept
        sizes = np.diff(self.ends_at)[kept]
        before = np.cumsum(sizes) - sizes
        self.ids = self.ids[np.arange(int(sizes.sum())) + np.repeat(self.ends_at[kept] - before, sizes)]
        self.ends_at, self.seen = np.append(0, np.cumsum(sizes)), self.seen[kept] // 2
        self.number = dict(zip(names[kept].tolist(), range(len(kept))))
        self.held_bytes = sum(map(len, self.number))


class Encoder(WordIds):
    """Texts to ids by a file of the tokenizers library, whole or (``word_local``) word by word."""

    def __init__(self, path: str, word_local: bool, most_words: int = 300_000, most_bytes: int = 8 << 20):
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.word_local = word_local
        own = [(i, x) for i, x in self.tokenizer.get_added_tokens_decoder().items() if x.special and not (x.normalized or x.lstrip or x.rstrip or x.single_word)]
        self.mark = min(own, key=lambda x: x[0], default=None) and (min(own, key=lambda x: x[0])[0], min(own, key=lambda x: x[0])[1].content)

        suffix = getattr(self.tokenizer.model, "end_of_word_suffix", None)
        vocabulary = self.tokenizer.get_vocab()
        self.ends = None
        if suffix:
            self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
            self.ends[[i for x, i in vocabulary.items() if x.endswith(suffix)]] = True
            # The vocabulary and its merges alone, for words that need no normalising.
            self.bare = Tokenizer(self.tokenizer.model)
            self.bare.pre_tokenizer = pre_tokenizers.Split(" ", "removed")
            self.letters = _byte_letters()
        super().__init__(most_words, most_bytes)

    def forget(self) -> None:
        super().forget()
        self.tails: dict[str, bytes] = {"": b""}

    def whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(x.ids, "<u4").tobytes() for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def words(self, words: list[bytes]) -> list[bytes]:
        """Words of lower-case Latin letters are one piece each to a tokenizer that marks word ends,
        so many go into one call and are told apart by these marks; ASCII punctuation behind them
        is a piece of its own. All other words are told apart by a special token."""
        if not self.word_local or self.ends is None:
            return self.marked(words)
        texts = [x.decode() for x in words]
        shapes = [_PLAIN.fullmatch(x) for x in texts]
        cores = list({m[1] for m in shapes if m})
        known: dict[str, bytes] = {}
        for i in range(0, len(cores), 4000):
            part = cores[i : i + 4000]
            spelled = " ".join(part)
            spelled = spelled if spelled.isascii() else spelled.encode().decode("latin-1").translate(self.letters)
            ids = np.array(self.bare.encode_batch_fast([spelled], add_special_tokens=False)[0].ids, "<u4")
            stops = (4 * np.flatnonzero(self.ends[ids]) + 4).tolist()
            if len(stops) == len(part) and stops[-1] == 4 * len(ids):
                raw = ids.tobytes()
                known.update((w, raw[a:b]) for w, a, b in zip(part, [0, *stops], stops))
        odd = list({m[2] for m in shapes if m and m[2] not in self.tails})
        self.tails.update(zip(odd, self.marked([x.encode() for x in odd])))
        rest = [w for w, m in zip(words, shapes) if not m or m[1] not in known]
        other = dict(zip(rest, self.marked(rest)))
        return [known[m[1]] + self.tails[m[2]] if m and m[1] in known else other[w] for w, m in zip(words, shapes)]

    def marked(self, words: list[bytes]) -> list[bytes]:
        """Many words in one call, told apart by a special token none of them holds."""
        if self.mark is None:
            return self.whole([x.decode() for x in words])
        number, mark = self.mark
        out: list[bytes] = []
        for i in range(0, len(words), 4000):
            part = [x.decode() for x in words[i : i + 4000]]
            if not any(mark in x for x in part):
                ids = np.array(self.tokenizer.encode_batch_fast([mark.join(part)], add_special_tokens=False)[0].ids, "<u4")
                cuts = np.flatnonzero(ids == number)
                if len(cuts) == len(part) - 1:
                    raw, starts, ends = ids.tobytes(), np.append(0, 4 * cuts + 4).tolist(), np.append(4 * cuts, 4 * len(ids)).tolist()
                    out += [raw[a:b] for a, b in zip(starts, ends)]
                    continue
            out += self.whole(part)
        return out

    def folded(self, text: bytes) -> bytes:
        """Lower-cased where that is what the tokenizer does first, so that fewer words are
        distinct. Beyond Latin-1 a capital before a combining mark isn't the tokenizer's lower case
        of it, so there only ASCII words are."""
        if b"<|" in text:
            return text
        if text.isascii():
            return text.lower()
        if not self.beyond(text):
            return text.decode().lower().encode()
        return b" ".join([w.lower() if w.isascii() else w for w in text.split()])

    #: First bytes of characters beyond U+00FF.
    beyond = staticmethod(re.compile(rb"[\xC4-\xFF]").search)

    def encode(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        if self.word_local:
            return super().encode(texts)
        own = self.whole([x.decode() for x in texts])
        return np.frombuffer(b"".join(own), "<u4"), np.array([len(x) // 4 for x in own], np.int64)

    def probe(self, texts: list[bytes]) -> None:
        """Are these texts encoded word by word as they are as a whole?"""
        ids, lengths = self.encode(texts)
        for x, part in zip(texts, np.split(ids, np.cumsum(lengths)[:-1])):
            if part.tobytes() != self.whole([x.decode()])[0]:
                raise ValueError("this tokenizer does not encode words on their own; set word_local=False")


_ENCODERS: dict[tuple[str, bool], Encoder] = {}


def encoder(path: str, word_local: bool) -> Encoder:
    """One per Python worker, with its words; other operators' tasks drop it."""
    if (path, word_local) not in _ENCODERS:
        _ENCODERS[path, word_local] = Encoder(path, word_local)
    return _ENCODERS[path, word_local]


caches("tokens", _ENCODERS.clear)

# ---- writing and reading -----------------------------------------------------------------

MANIFEST = "part long, seq long, path string, before long, n_docs long, n_tokens long"


def write_token_files(docs: DataFrame, tokenizer: str, *, id_col: str = "doc_id", text_col: str = "text", end_id: int = 1, word_local: bool = False, file_ids: int = FILE_IDS, folder: str | None = None) -> DataFrame:
    """Write all documents in ascending order of their ids; return the manifest, one row per file."""
    from pyspark import TaskContext

    spark = docs.sparkSession
    folder = folder or new_folder(spark, "token-ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq, before = TaskContext.get().partitionId(), 0, 0
        ids: list[np.ndarray] = []
        lengths: list[np.ndarray] = []
        names: list[int | None] = []
        size, probed = 0, not word_local

        def flush() -> pa.RecordBatch:
            nonlocal seq, before, size
            path = f"{folder}/part-{part:06d}-{seq:06d}-{uuid.uuid4().hex}.ids"
            write_bytes(path, encode_file(np.concatenate(ids), names, np.concatenate(lengths)))
            row = pa.RecordBatch.from_pydict({"part": [part], "seq": [seq], "path": [path], "before": [before], "n_docs": [len(names)], "n_tokens": [size]})
            seq, before, size = seq + 1, before + size, 0
            for held in (ids, lengths, names):
                held.clear()
            return row

        for batch in batches:
            for piece in pieces(batch, "text", 1 << 20):
                own, texts = encoder(tokenizer, word_local), as_bytes(piece.column("text"))
                if not probed:
                    own.probe([x for x in texts if x][:3])
                    probed = True
                found, n = own.encode(texts)
                every = np.full(len(found) + len(n), end_id, "<u4")
                every[np.arange(len(found)) + np.repeat(np.arange(len(n)), n)] = found
                ids.append(every)
                lengths.append(n + 1)
                names += piece.column("id").to_pylist()
                size += len(every)
                if size >= file_ids:
                    yield flush()
        if names:
            yield flush()

    source = docs.select(docs[id_col].cast("long").alias("id"), docs[text_col].alias("text"))
    # The hash deals equal ids to several ranges, in an order that no rerun changes.
    dealt = source.repartitionByRange(F.col("id").asc_nulls_first(), F.xxhash64("text")).sortWithinPartitions(F.col("id").asc_nulls_first(), F.xxhash64("text"))
    return materialise(dealt.mapInArrow(working("tokens", run), MANIFEST), "token-manifest")


def with_starts(manifest: DataFrame) -> DataFrame:
    """The manifest and the number of ids in all files before each one. The driver holds one
    number per written partition."""
    totals = {r[0]: r[1] for r in manifest.groupBy("part").agg(F.sum("n_tokens")).collect()}
    rows, base = [], 0
    for part in sorted(totals):
        rows.append((part, base))
        base += totals[part]
    bases = manifest.sparkSession.createDataFrame(rows, "part long, base long")
    return manifest.join(F.broadcast(bases), "part").select("path", (F.col("base") + F.col("before")).alias("start"), "n_docs", "n_tokens")


def read_token_files(manifest: DataFrame, *, id_col: str = "doc_id") -> DataFrame:
    """Decode the files: one row per document with its place, number of ids and their CRC-32."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, start in zip(batch.column("path").to_pylist(), batch.column("start").to_pylist()):
                system, name = filesystem(path)
                with system.open_input_stream(name) as source:
                    ids, doc_ids, lengths = decode_file(source.read())
                ends = np.cumsum(lengths.astype(np.int64))
                raw = memoryview(ids.tobytes())
                crc = [zlib.crc32(raw[4 * (e - n) : 4 * e]) for e, n in zip(ends.tolist(), lengths.tolist())]
                yield pa.RecordBatch.from_arrays([pa.array(doc_ids, pa.int64()), pa.array(start + ends - lengths.astype(np.int64)), pa.array(lengths.astype(np.int64)), pa.array(crc, pa.int64())], names=[id_col, "start", "n_tokens", "ids_crc32"])

    files = with_starts(manifest)
    spread = files.repartition(max(1, min(manifest.count(), 10_000)))
    return spread.mapInArrow(working("tokens", run), f"`{id_col}` long, start long, n_tokens long, ids_crc32 long")
