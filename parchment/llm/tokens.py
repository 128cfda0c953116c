"""Token-ID files: independent zstandard frames, a trailing seek table and per-frame checksums.

Layout of a shard, which follows the public zstd seekable format: data frames, each of at most FRAME_IDS
little-endian unsigned 32-bit ids; a skippable frame with the document index; a skippable frame with the seek table.
A reader takes the footer, then the index, and decompresses only the frames that hold a wanted document.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parchment.llm.common import at_work, known_id, pieces, prepare, remembers, scratch_path, shuffle_width, with_known_id

#: Ids in a frame, text bytes that a shard is dealt (more shards where the cluster has more tasks), ids that a reading task takes.
FRAME_IDS, SHARD_BYTES, READ_IDS = 1 << 16, 512 << 20, 1 << 24
INDEX_MAGIC, SEEK_MAGIC, FOOT_MAGIC = 0x184D2A50, 0x184D2A5E, 0x8F92EAB1
END_ID = 0


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class ChunkEncoder:
    """Byte-level BPE of whole texts through the tokenizers library, remembering the ids of words.

    The tokenizer's split pattern never joins characters across a single space or line end between non-space
    characters: the space opens the next piece, the line end is a piece. Nor does it join a letter or digit to
    punctuation after it, which opens a piece too. So a text is cut there, and each cut is asked of the library once
    while it is remembered; words and the marks behind them are remembered apart.
    Where white space touches white space, or an added token such as <|endoftext|> stands, the library gets the whole
    text. Memory is bounded by capacity.
    """

    odd = re.compile("[\x01\t\r\x0b\x0c\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
    #: Marks behind a letter or digit: a piece of their own begins there, which \x01 stands before.
    marks = re.compile(r"([^\W_])([.,;:!?*#$%&|])")

    def __init__(self, path: str, capacity: int = 600_000, longest: int = 64):
        from tokenizers import Tokenizer

        self.lib = Tokenizer.from_file(path)
        self.added = [t.content for t in self.lib.get_added_tokens_decoder().values()]
        vocabulary = self.lib.get_vocab(with_added_tokens=True)
        self.opens = np.zeros(max(vocabulary.values()) + 1, bool)
        self.opens[[i for x, i in vocabulary.items() if x.startswith("\u0120")]] = True  # how these vocabularies write a space
        self.capacity, self.longest = capacity, longest
        self.known: dict[str, bytes] = {}

    def _ask(self, texts: list[str]) -> list[bytes]:
        return [np.asarray(e.ids, dtype="<u4").tobytes() for e in self.lib.encode_batch_fast(texts, add_special_tokens=False)]

    def _ask_words(self, words: list[str]) -> list[bytes]:
        """The ids of words of letters alone, each after a space: many in one text, cut where a token opens with a space."""
        out: list[bytes] = []
        for at in range(0, len(words), 2000):
            some = words[at : at + 2000]
            raw = self._ask([" " + " ".join(some)])[0]
            cut = (4 * np.flatnonzero(self.opens[np.frombuffer(raw, "<u4")])).tolist() + [len(raw)]
            out += [raw[x:y] for x, y in zip(cut, cut[1:])] if len(cut) == len(some) + 1 else self._ask([f" {x}" for x in some])
        return out

    def _learn(self, chunks: list[str]) -> None:
        known = self.known
        plain = [x for x in chunks if x.isalpha()]
        known.update(zip(plain, self._ask_words(plain)))
        other = [x for x in chunks if not x.isalpha()]
        for at in range(0, len(other), 20_000):
            some = other[at : at + 20_000]
            known.update(zip(some, self._ask([x if x[:1] == "\n" else x[1:] if x[:1] == "\x01" else " " + x for x in some])))

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, as little-endian unsigned 32-bit integers."""
        if len(self.known) > self.capacity:
            self.known = {}
        known, parts, new = self.known, [], set()
        for text in texts:
            led = "\n" + text
            if "  " in led or " \n" in led or "\n " in led or "\n\n" in led or led[-1] == " " or self.odd.search(led) or any(t in led for t in self.added):
                parts.append(None)
                continue
            chunks = self.marks.sub("\\1 \x01\\2", led.replace("\n", " \n")).split(" ")
            del chunks[0]
            parts.append(chunks)
            new.update(chunks)
        fresh = list(new.difference(known))
        self._learn(fresh)
        whole = iter(self._ask([t for t, p in zip(texts, parts) if p is None]))
        get = known.__getitem__
        out = [next(whole) if p is None else b"".join(map(get, p))[4:] for p in parts]
        for x in fresh:
            if len(x) > self.longest:
                del known[x]
        return out


_encoders: dict[str, ChunkEncoder] = {}


def encoder(path: str) -> ChunkEncoder:
    """One encoder for each Python worker and vocabulary file, as long as no other operator is at work in it."""
    at_work("tokens")
    remembers("tokens", _encoders.clear)
    if path not in _encoders:
        _encoders[path] = ChunkEncoder(path)
    return _encoders[path]


class ShardWriter:
    """Collects documents and closes a frame whenever FRAME_IDS ids are there; long documents go over several frames."""

    def __init__(self, sink, level: int = 1):
        import zstandard

        self.sink, self.zip = sink, zstandard.ZstdCompressor(level=level, write_content_size=True)
        self.open, self.frames, self.docs, self.size, self.ids = bytearray(), [], [], 0, 0

    def add(self, doc_id: int | None, ids: bytes) -> None:
        self.docs.append((doc_id, len(ids) // 4))
        self.ids += len(ids) // 4
        self.open += ids
        while len(self.open) >= 4 * FRAME_IDS:
            self._frame(bytes(self.open[: 4 * FRAME_IDS]))
            del self.open[: 4 * FRAME_IDS]

    def _put(self, data: bytes) -> None:
        self.sink.write(data)
        self.size += len(data)

    def _frame(self, raw: bytes) -> None:
        import xxhash

        packed = self.zip.compress(raw)
        self.frames.append((len(packed), len(raw), xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF))
        self._put(packed)

    def close(self) -> None:
        import xxhash

        if self.open:
            self._frame(bytes(self.open))
            self.open.clear()
        known = np.array([d is not None for d, _ in self.docs], dtype=np.uint8)
        body = struct.pack("<Q", len(self.docs)) + known.tobytes() + np.array([d or 0 for d, _ in self.docs], dtype="<i8").tobytes() + np.array([n for _, n in self.docs], dtype="<u8").tobytes()
        body = self.zip.compress(body)
        self._put(struct.pack("<II", INDEX_MAGIC, len(body)) + body)
        self.frames.append((8 + len(body), 0, xxhash.xxh64_intdigest(body) & 0xFFFFFFFF))
        table = b"".join(struct.pack("<III", *x) for x in self.frames)
        foot = struct.pack("<IBI", len(self.frames), 0x80, FOOT_MAGIC)
        self._put(struct.pack("<II", SEEK_MAGIC, len(table) + len(foot)) + table + foot)


class ShardReader:
    """Reads a shard through any seekable file; every frame that is decompressed is checked against its checksum."""

    def __init__(self, source):
        import xxhash

        self.source = source
        size = source.seek(0, 2)
        count, flags, magic = struct.unpack("<IBI", self._at(size - 9, 9))
        if magic != FOOT_MAGIC or not flags & 0x80:
            raise ValueError("no seek table with checksums at the end")
        table = np.frombuffer(self._at(size - 9 - 12 * count, 12 * count), dtype="<u4").reshape(count, 3).astype(np.int64)
        self.frames = table[:-1]
        self.at = np.concatenate([[0], np.cumsum(table[:, 0])])
        self.raw = np.concatenate([[0], np.cumsum(self.frames[:, 1])])
        body = self._at(int(self.at[count - 1]) + 8, int(table[-1, 0]) - 8)
        if xxhash.xxh64_intdigest(body) & 0xFFFFFFFF != table[-1, 2]:
            raise ValueError("the document index is damaged")
        body = self._unzip(body)
        n = struct.unpack_from("<Q", body)[0]
        self.known = np.frombuffer(body, np.uint8, n, 8).astype(bool)
        self.doc_ids = np.frombuffer(body, "<i8", n, 8 + n)
        self.lengths = np.frombuffer(body, "<u8", n, 8 + 9 * n).astype(np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.lengths)])
        self.last: tuple[int, bytes] = (-1, b"")

    def _at(self, offset: int, length: int) -> bytes:
        self.source.seek(offset)
        return self.source.read(length)

    def _unzip(self, data: bytes) -> bytes:
        import zstandard

        return zstandard.ZstdDecompressor().decompress(data)

    def frame(self, k: int) -> bytes:
        import xxhash

        if self.last[0] != k:
            raw = self._unzip(self._at(int(self.at[k]), int(self.frames[k, 0])))
            if xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF != self.frames[k, 2]:
                raise ValueError(f"frame {k} is damaged")
            self.last = (k, raw)
        return self.last[1]

    def parts(self, i: int) -> Iterator[bytes]:
        """The ids of document number i, frame by frame."""
        start, end = 4 * int(self.starts[i]), 4 * int(self.starts[i + 1])
        k = int(np.searchsorted(self.raw, start, side="right")) - 1
        while start < end:
            stop = min(end, int(self.raw[k + 1]))
            yield self.frame(k)[start - int(self.raw[k]) : stop - int(self.raw[k])]
            start, k = stop, k + 1

    def ids(self, i: int) -> np.ndarray:
        return np.frombuffer(b"".join(self.parts(i)), dtype="<u4")


def _store(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri or not uri.startswith("/") else "file://" + uri)


def write_token_files(docs: DataFrame, out: str, tokenizer: str | None = None, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Write documents (doc_id, text) as shards in ascending doc_id order; returns (part, path, docs, ids, bytes).

    Rows are dealt by range of doc_id and a hash of the text, about shard_bytes of text a shard, so shards follow each
    other in order and the different texts of one doc_id may go over several. Null doc_id comes first; rows of one
    doc_id follow each other by that hash; null text is an empty document (only the end id). An empty table writes
    nothing. Other columns are ignored. Each file appears by a rename, so a task that runs again leaves the same file.
    """
    spark = docs.sparkSession
    prepare(spark)
    path = tokenizer or default_tokenizer()

    def write(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        task = TaskContext.get()
        part, writer, name, sink = task.partitionId(), None, "", None
        store, base = _store(out)
        coder = encoder(path)
        for batch in pieces(batches, rows=100):
            if writer is None:
                store.create_dir(base, recursive=True)
                name = f"{base}/shard-{part:06d}.zst"
                sink = store.open_output_stream(f"{name}.{task.taskAttemptId()}")
                writer = ShardWriter(sink)
            for doc_id, known, ids in zip(batch["doc_id"].tolist(), batch["known"], coder.encode([x or "" for x in batch["text"]])):
                writer.add(doc_id if known else None, ids + b"\0\0\0\0")
        if writer is not None:
            writer.close()
            sink.close()
            store.move(f"{name}.{task.taskAttemptId()}", name)
            yield pd.DataFrame([(part, f"{out}/shard-{part:06d}.zst", len(writer.docs), writer.ids, writer.size)], columns=["part", "path", "docs", "ids", "bytes"])

    text = F.col("text").cast("string")
    size = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("fp"))
    dealt = rows.repartitionByRange(max(2, shuffle_width(spark), -(-size // shard_bytes)), "doc_id", "fp").sortWithinPartitions("doc_id", "fp")
    return with_known_id(dealt, F.col("text")).mapInPandas(write, "part long, path string, docs long, ids long, bytes long")


def read_token_files(spark: SparkSession, manifest: list, with_ids: bool = False, read_ids: int = READ_IDS) -> DataFrame:
    """Documents of the shards in manifest (rows of write_token_files): doc_id, start, n_tokens, ids_crc32[, ids].

    start counts the ids of all documents before, over all shards. A task takes the documents of about read_ids ids: it
    reads a shard's index, and of its frames only those that hold them, one at a time.
    """
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids binary" * with_ids
    if not manifest:
        return spark.createDataFrame([], schema)
    prepare(spark)
    order = sorted(manifest, key=lambda r: r["part"])
    before = np.concatenate([[0], np.cumsum([r["ids"] for r in order])]).tolist()
    runs = [(r["path"], b, r["ids"] * k // n, r["ids"] * (k + 1) // n) for r, b in zip(order, before) for n in [-(-r["ids"] // read_ids)] for k in range(n)]
    names = ["known", *(x.split()[0] for x in schema.split(", "))]

    def read(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for uri, base, low, high in zip(batch["path"], batch["base"], batch["low"], batch["high"]):
                store, name = _store(uri)
                with store.open_input_file(name) as source:
                    shard, rows, held = ShardReader(source), [], 0
                    first, last = np.searchsorted(shard.starts[:-1], [low, high]).tolist()
                    for i in range(first, last):
                        crc, kept = 0, []
                        for part in shard.parts(i):
                            crc = zlib.crc32(part, crc)
                            if with_ids:
                                kept.append(part)
                        row = (bool(shard.known[i]), int(shard.doc_ids[i]), int(base) + int(shard.starts[i]), int(shard.lengths[i]), crc)
                        rows.append((*row, b"".join(kept)) if with_ids else row)
                        held += 1 + 4 * with_ids * int(shard.lengths[i])
                        if held >= 4_000_000 or len(rows) >= 20_000:
                            yield pd.DataFrame(rows, columns=names)
                            rows, held = [], 0
                    if rows:
                        yield pd.DataFrame(rows, columns=names)

    listed = spark.createDataFrame(runs, "path string, base long, low long, high long").repartition(len(runs))
    found = listed.mapInPandas(read, f"known boolean, {schema}")
    return found.withColumn("doc_id", known_id()).drop("known")


def token_files(docs: DataFrame, tokenizer: str | None = None, out: str | None = None) -> DataFrame:
    """Write all documents as shards and give back what a reader finds in them: doc_id, start, n_tokens, ids_crc32."""
    spark = docs.sparkSession
    out = out or scratch_path(spark, "tokens")
    return read_token_files(spark, write_token_files(docs, out, tokenizer).collect())
