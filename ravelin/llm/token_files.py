"""Token ids in binary files: ids ranked by frequency, in byte-aligned variable-length coding with separate control bytes.

Every document is encoded once, by the tokenizers library; an end id follows it. The ids of all documents are counted,
and an id is written as its rank, so that the most frequent 256 ids take one byte. A block has, for its documents in
order, the ids' control bytes (two bits for each id: bytes less one, four ids in a byte, a new byte for each document)
and apart from them the data bytes. Readers look up the control bytes in a table and gather the data bytes with numpy.
Documents are coded before they are dealt out, so that the shuffle moves what the files will hold.

Files are in ascending order of doc_id: documents are dealt out by ranges of doc_id and sorted, a file holds documents
of one range, and ``part`` and ``seq`` of the manifest order the files. Tasks write under names that are never used
again; only the files in the rows that a task has returned count.

A null or empty text has the end id alone. Documents with equal doc_id follow each other, in the order of their
lengths and bytes; a null doc_id comes first. An empty table gives no files and no rows.

The counts are one row for each id of the vocabulary, whose size is fixed by the tokenizer's file; the ranks are
broadcast.
"""

from __future__ import annotations

import json
import os
import re
import struct
import uuid
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ravelin.llm import vectext as V
from ravelin.llm.shared import drop_path, new_path, open_fs, stored, table

MAGIC = b"RVLN\x01\0\0\0"
#: Words, and bytes of words, whose ids a worker keeps, twice over; what is not among them is encoded again. A word is kept when it
#: comes in a second piece of text, by the bits of a table of ``SEEN`` bytes.
MEMO, MEMO_BYTES, SEEN = 500_000, 24 << 20, 1 << 21
#: Bytes of text whose words are told apart at a time.
PIECE = 4 << 20
#: What a byte is to the GPT-2 pattern: letter, digit, other, white space; UNSURE are the bytes of characters that are not looked up here.
UNSURE, LETTER, DIGIT, OTHER, BLANK = range(5)
KIND = np.full(256, OTHER, np.uint8)
KIND[[*range(65, 91), *range(97, 123)]], KIND[48:58], KIND[[9, 10, 13, 32]], KIND[128:] = LETTER, DIGIT, BLANK, UNSURE
#: Texts with other characters that may be white space are encoded by the library alone, parted at ``_CUT``.
_ODD = r"[\x0b\x0c\x1c-\x1f\x{85}\x{a0}\x{1680}\x{180e}\x{2000}-\x{200f}\x{2028}-\x{202f}\x{205f}-\x{2060}\x{3000}\x{feff}]"
#: Two texts on either side of such a place are encoded as they are alone: a blank or a single line feed between characters that are no white space.
_CUT = re.compile(r"(?= \S)|(?<=\S)(?=\n\S)|(?<=\S\n)(?=\S)")
#: A word of letters is one unit of the pattern, and so is a word of ASCII without an apostrophe, as words are cut here.
_LETTERS = re.compile(" ?[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u017f]+")
#: The characters that stand for bytes in a byte-level vocabulary.
_SHOWN = [*range(33, 127), *range(161, 173), *range(174, 256)]
BYTES = {b: chr(b) for b in _SHOWN} | {b: chr(256 + i) for i, b in enumerate(x for x in range(256) if x not in _SHOWN)}
#: For each control byte, the bytes of its four ids.
LENGTHS = (np.arange(256, dtype=np.uint8)[:, None] >> np.array([0, 2, 4, 6], np.uint8) & 3).astype(np.int64) + 1


def encode(values: np.ndarray) -> tuple[bytes, bytes]:
    """(control bytes, data bytes) of unsigned 32-bit values."""
    v = values.astype("<u4")
    size = 1 + (v > 0xFF).astype(np.uint8) + (v > 0xFFFF) + (v > 0xFFFFFF)
    codes = np.zeros(-(-len(v) // 4) * 4, np.uint8)
    codes[: len(v)] = size - 1
    c = codes.reshape(-1, 4)
    control = c[:, 0] | c[:, 1] << 2 | c[:, 2] << 4 | c[:, 3] << 6
    data = v.view(np.uint8).reshape(-1, 4)[np.arange(4) < size[:, None]]
    return control.astype(np.uint8).tobytes(), data.tobytes()


def decode(control: np.ndarray, data: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The values of documents of ``sizes`` values, whose control bytes and data bytes follow each other."""
    places = 4 * -(-sizes // 4)
    size = LENGTHS[control].reshape(-1)
    size = size[np.arange(len(size)) - np.repeat(np.cumsum(places) - places, places) < np.repeat(sizes, places)]
    at = np.cumsum(size) - size
    padded = np.concatenate([data, np.zeros(4, np.uint8)])
    out = padded[at].astype(np.uint32)
    for i in range(1, 4):
        more = np.flatnonzero(size > i)
        out[more] |= padded[at[more] + i].astype(np.uint32) << np.uint32(8 * i)
    return out


def words_of(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """The places where the GPT-2 pattern surely begins a new unit in texts without odd white space: the starts of words, and the end.

    These are the beginnings of texts; where letters, digits and others change, except after an apostrophe; and, in white space, its first
    character, its last one before another character, and what follows it, to which a single blank belongs.
    """
    kind = KIND[data]
    two = np.flatnonzero((data[:-1] >= 0xC3) & (data[:-1] <= 0xC5))  # U+00C0 to U+017F
    two = two[(data[two] != 0xC3) | (data[two + 1] & 0xDF != 0x97)]  # letters all but the signs of multiplication and division
    kind[two] = kind[two + 1] = LETTER
    first = np.zeros(len(data) + 1, bool)
    first[off] = True
    before, after = kind[:-1], kind[1:]
    new = (before != after) & (before != UNSURE) & (after != UNSURE) | (after == BLANK) & (before == UNSURE)
    new &= ~((data[:-1] == 0x27) & (after == LETTER))
    space = np.flatnonzero(before == BLANK)
    last = space[(after[space] != BLANK) & ~first[space + 1]]  # the last white space before another character
    new[last] = data[last] != 0x20
    again = last[last > 0] - 1
    new[again[kind[again] == BLANK]] = True
    first[1:-1] |= new
    return np.flatnonzero(first)


class Encoder:
    """Ids of texts. Words that come again are not encoded again; that changes no id, as words are encoded apart from each other."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # their strings in a text are text
        self.kind = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self.code = "H" if self.kind.itemsize == 2 else "I"
        told = json.loads(self.tokenizer.to_str())
        pre, model = told["pre_tokenizer"] or {}, told["model"]
        #: A byte-level vocabulary and the GPT-2 pattern; else texts go to the library whole.
        self.by_words = (
            (pre.get("type"), pre.get("use_regex"), pre.get("add_prefix_space"), model["type"]) == ("ByteLevel", True, False, "BPE")
            and not any((told["normalizer"], told["truncation"], told["padding"], model.get("dropout"), model.get("continuing_subword_prefix"), model.get("end_of_word_suffix")))
            and all(x["special"] for x in told["added_tokens"])
        )
        self.model = self.tokenizer.model
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.held = 0  # bytes of the words in young
        self.seen = bytearray(SEEN)

    def alone(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, self.kind).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def unit(self, word: str) -> bytes | None:
        """Ids of a word that is one unit of the pattern, None if it may have several."""
        if word.isascii():
            if "'" in word:
                return None
            word = word.replace(" ", "\u0120") if word.isprintable() else word.translate(BYTES)
        elif _LETTERS.fullmatch(word):
            word = word.encode().decode("latin-1").translate(BYTES)
        else:
            return None
        return array(self.code, [t.id for t in self.model.tokenize(word)]).tobytes()

    def learned(self, words: list[str]) -> list[bytes]:
        """Ids of different words, each as they are where a unit of the pattern begins."""
        if len(self.young) > MEMO or self.held > MEMO_BYTES:
            self.young, self.old, self.held, self.seen = {}, self.young, 0, bytearray(SEEN)
        out = list(map(self.young.get, words))
        rest = []
        for i in [i for i, ids in enumerate(out) if ids is None]:
            w = words[i]
            ids = self.old.get(w)
            keep = ids is not None
            if not keep:
                ids = self.unit(w)
                at = hash(w) % (8 * SEEN)
                keep = self.seen[at >> 3] >> (at & 7) & 1
                self.seen[at >> 3] |= 1 << (at & 7)
            if ids is None:
                rest.append((i, keep))
                continue
            out[i] = ids
            if keep:
                self.young[w] = ids
                self.held += len(w)
        for (i, keep), ids in zip(rest, self.alone([words[i] for i, _ in rest]), strict=True):
            out[i] = ids
            if keep:
                self.young[words[i]] = ids
                self.held += len(words[i])
        return out

    def __call__(self, texts: list[str], end: bytes) -> list[bytes]:
        return self.ids(pa.array(texts, pa.string()), end).to_pylist()

    def ids(self, texts: pa.Array, end: bytes) -> pa.Array:
        """The ids of each text, with ``end`` behind them."""
        odd = np.flatnonzero(pc.fill_null(pc.match_substring_regex(texts, _ODD), False)) if self.by_words else np.arange(len(texts))
        whole = [x or "" for x in texts.take(pa.array(odd)).to_pylist()]
        if len(odd):
            even = np.ones(len(texts), bool)
            even[odd] = False
            texts = pc.if_else(pa.array(even), texts, "")
        data, off = V.buffers(texts)
        starts = words_of(data, off) if len(data) else np.zeros(1, np.int64)
        words = pa.StringArray.from_buffers(len(starts) - 1, pa.py_buffer(starts.astype(np.int32)), pa.py_buffer(data)).dictionary_encode()
        known = self.learned(words.dictionary.to_numpy(zero_copy_only=False).tolist())
        parts = [_CUT.split(x) if self.by_words else [x] for x in whole]
        ids = iter(self.alone([p for x in parts for p in x]))
        known += [b"".join(next(ids) for _ in x) for x in parts]
        # what stands for each text: its words or, if it is odd, all of its ids at once, and the end
        first = np.searchsorted(starts, off)
        at = np.insert(words.indices.to_numpy(), first[odd], len(known) - len(odd) + np.arange(len(odd)))
        extra = np.zeros(len(off), np.int64)
        extra[odd + 1] = 1
        edges = first + np.cumsum(extra)
        at = np.insert(at, edges[1:], len(known))
        out = pa.array([*known, end], pa.binary()).take(pa.array(at))
        ends = np.frombuffer(out.buffers()[1], np.int32)[edges + np.arange(len(edges))]
        return pa.Array.from_buffers(pa.binary(), len(off) - 1, [None, pa.py_buffer(ends), out.buffers()[2]])


@lru_cache(maxsize=1)
def encoder(path: str) -> Encoder:
    """One for all tasks of a worker."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
    return Encoder(path)


def tokenized(docs: DataFrame, *, tokenizer: str, end_id: int) -> DataFrame:
    """doc_id and ids (the end id included; little-endian unsigned integers of 16 bits, or 32 for a vocabulary above 65,536) of each row of ``docs`` (doc_id, text)."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode_all = encoder(tokenizer)
        end = np.array([end_id], encode_all.kind).tobytes()
        for b in batches:
            for i, j, _, _ in V.pieces(b.column("text"), PIECE):
                part = b.slice(i, j - i)
                yield pa.record_batch([part.column("doc_id"), encode_all.ids(part.column("text"), end)], ["doc_id", "ids"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(of, "doc_id long, ids binary")


def counted(tokens: DataFrame, kind: np.dtype) -> np.ndarray:
    """How often each id comes in all documents."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for b in batches:
            n = np.bincount(np.frombuffer(V.buffers(b.column("ids"))[0], kind), minlength=len(total))
            n[: len(total)] += total
            total = n
        some = np.flatnonzero(total)
        yield pa.record_batch([pa.array(some), pa.array(total[some])], ["id", "n"])

    got = tokens.select("ids").mapInArrow(of, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(int(got["id"].max()) + 1 if len(got) else 0, np.int64)
    out[got["id"].to_numpy()] = got["n"].to_numpy()
    return out


def coded(tokens: DataFrame, kind: np.dtype, sent, last: np.ndarray) -> DataFrame:
    """part, doc_id, n, control, data: the ids of each document as coded ranks. ``sent``: the broadcast ranks; ``last``: the last doc_id of each part, a null one is in the first."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rank = sent.value
        for b in batches:
            both = [encode(rank[np.frombuffer(x.as_buffer(), kind)]) for x in b.column("ids")]
            sizes = pa.array([x.as_buffer().size // kind.itemsize for x in b.column("ids")], pa.int64())
            ids = b.column("doc_id")
            part = np.where(ids.is_valid(), np.searchsorted(last, ids.fill_null(0)), 0).astype(np.int32)
            yield pa.record_batch([pa.array(part), ids, sizes, *(pa.array([x[i] for x in both], pa.binary()) for i in (0, 1))], ["part", "doc_id", "n", "control", "data"])

    return tokens.mapInArrow(of, "part int, doc_id long, n long, control binary, data binary")


class Files:
    """Writes documents in blocks of about ``block`` ids to files of about ``roll`` bytes."""

    def __init__(self, folder: str, rank: np.ndarray, block: int, roll: int):
        self.folder, self.rank, self.block, self.roll = folder, rank, block, roll
        self.out, self.done, self.docs = None, [], []
        self.waiting = 0

    def add(self, doc_id: int | None, n: int, control: bytes, data: bytes) -> None:
        self.docs.append((doc_id, n, control, data))
        self.waiting += n
        if self.waiting >= self.block:
            self.flush()

    def flush(self) -> None:
        if not self.docs:
            return
        if self.out is None:
            fs, path = open_fs(self.folder)
            fs.create_dir(path, recursive=True)
            self.name, self.n_docs, self.n_ids, self.size = f"{self.folder}/{uuid.uuid4().hex}.ids", 0, 0, 0
            self.out = fs.open_output_stream(open_fs(self.name)[1])
            # the file can be read alone: the ids in the order of their ranks stand at its beginning
            order = zlib.compress(np.argsort(self.rank).astype("<u4").tobytes())
            self._put(MAGIC + struct.pack("<I", len(order)) + order)
        ids, sizes, controls, data = zip(*self.docs, strict=True)
        control, data = b"".join(controls), b"".join(data)
        docs = np.array([x or 0 for x in ids], "<i8").tobytes() + np.array([x is None for x in ids], np.uint8).tobytes()
        self._put(struct.pack("<IQQ", len(ids), len(control), len(data)) + docs + np.array(sizes, "<u4").tobytes() + control + data)
        self.n_docs += len(ids)
        self.n_ids += self.waiting
        self.docs, self.waiting = [], 0
        if self.size >= self.roll:
            self.close()

    def _put(self, data: bytes) -> None:
        self.out.write(data)
        self.size += len(data)

    def close(self) -> None:
        self.flush()
        if self.out is not None:
            self.out.close()
            self.done.append((self.name, len(self.done), self.n_docs, self.n_ids, self.size))
            self.out = None


def read_blocks(stream) -> Iterator[tuple[list[int | None], np.ndarray, np.ndarray]]:
    """(doc_ids, ids in each document, ids) of each block of a file."""
    if stream.read(8) != MAGIC:
        raise ValueError("not a file of token ids")
    order = np.frombuffer(zlib.decompress(stream.read(struct.unpack("<I", stream.read(4))[0])), "<u4")
    while head := stream.read(20):
        n, controls, size = struct.unpack("<IQQ", head)
        docs, null = np.frombuffer(stream.read(8 * n), "<i8"), np.frombuffer(stream.read(n), np.uint8)
        sizes = np.frombuffer(stream.read(4 * n), "<u4").astype(np.int64)
        control = np.frombuffer(stream.read(controls), np.uint8)
        values = decode(control, np.frombuffer(stream.read(size), np.uint8), sizes)
        yield [None if z else d for d, z in zip(docs.tolist(), null, strict=True)], sizes, order[values]


def write_files(docs: DataFrame, *, tokenizer: str, end_id: int = 2, block: int = 1 << 18, roll: int = 1 << 27) -> DataFrame:
    """Writes the token ids of ``docs`` (doc_id, text) and returns the files: part, file, seq, docs, ids, bytes, start (ids in the files before)."""
    spark = docs.sparkSession
    path = new_path(spark, "tokens")
    tokenized(docs, tokenizer=tokenizer, end_id=end_id).write.option("compression", "zstd").parquet(path)
    tokens = spark.read.schema("doc_id long, ids binary").parquet(path)
    kind = encoder(tokenizer).kind
    n = counted(tokens, kind)
    rank = np.empty(len(n), np.uint32)
    rank[np.argsort(-n, kind="stable")] = np.arange(len(n), dtype=np.uint32)
    sent = spark.sparkContext.broadcast(rank)
    folder = new_path(spark, "ids")

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files = Files(folder, sent.value, block, roll)
        part = 0
        for b in batches:
            for d, size, control, data in zip(*(b.column(c).to_pylist() for c in ("doc_id", "n", "control", "data")), strict=True):
                files.add(d, size, control, data)
            part = b.column("part")[0].as_py() if b.num_rows else part
        files.close()
        columns = zip(*files.done, strict=True) if files.done else [[]] * 5
        types = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64())
        yield pa.record_batch([pa.array([part] * len(files.done), pa.int32()), *(pa.array(c, t) for c, t in zip(columns, types, strict=True))], ["part", "file", "seq", "docs", "ids", "bytes"])

    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    first = F.col("doc_id").asc_nulls_first()
    # the ranges come from doc_id alone, so that documents are coded once
    ranges = tokens.select("doc_id").repartitionByRange(parts, first).groupBy(F.spark_partition_id().alias("part")).agg(F.max("doc_id").alias("last"))
    last = [r["last"] for r in ranges.where("last IS NOT NULL").orderBy("part").collect()]  # a row for each range
    ranged = coded(tokens, kind, sent, np.array(last, np.int64)).repartitionById(parts, "part").sortWithinPartitions(first, "n", "data")
    files = stored(ranged.mapInArrow(of, "part int, file string, seq long, docs long, ids long, bytes long"), "files")
    drop_path(spark, path)
    before = Window.orderBy("part", "seq").rowsBetween(Window.unboundedPreceding, -1)  # a row for each file
    return files.withColumn("start", F.coalesce(F.sum("ids").over(before), F.lit(0)))


def read_files(files: DataFrame, *, with_ids: bool = True) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 and, if wanted, the ids of each document of ``files`` (file, start)."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, start in zip(b.column("file").to_pylist(), b.column("start").to_pylist(), strict=True):
                fs, path = open_fs(name)
                with fs.open_input_stream(path) as stream:
                    for docs, sizes, ids in read_blocks(stream):
                        edges = np.concatenate([[0], np.cumsum(sizes)])
                        raw = memoryview(np.ascontiguousarray(ids).view(np.uint8))
                        spans = [raw[4 * i : 4 * j] for i, j in zip(edges[:-1], edges[1:], strict=True)]
                        columns = [pa.array(docs, pa.int64()), pa.array(start + edges[:-1]), pa.array(sizes), pa.array([zlib.crc32(x) for x in spans], pa.int64())]
                        lists = [pa.ListArray.from_arrays(pa.array(edges.astype(np.int32)), pa.array(ids.astype(np.int64)))] if with_ids else []
                        yield pa.record_batch([*columns, *lists], ["doc_id", "start", "n_tokens", "ids_crc32", "ids"][: 4 + with_ids])
                        start += int(edges[-1])

    spread = files.select("file", "start").repartition(max(int(files.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1), "file")
    return spread.mapInArrow(of, "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids)


def public_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The token ids of every document, written to files and read back."""
    return read_files(write_files(table(spark, sf_dir, "documents"), tokenizer=public_tokenizer()), with_ids=False)
