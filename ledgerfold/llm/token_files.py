"""Token ids of files, written frequency-ranked in byte-aligned variable-length code."""

from __future__ import annotations

import os
import re
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerfold.llm import words as W
from ledgerfold.session import cut, shared_folder, ship

END = 0
BLOCK_TOKENS = 1 << 19  # ids in a block, its last file's rest aside
ENCODED_CHARS = 1 << 17  # characters of text that are held as pieces at once
MARK = "\x01"
_STOP = re.compile(f"([.,])(?={MARK})(?<=[^\\W_][.,])")
_WORD = re.compile(r" \S+").fullmatch  # a blank and a word, without white space of any kind
_SAFE_SPLIT = re.compile(r"(?<=\S)(?= \S)")
#: Length of each of the four values that a control byte speaks for.
LENGTHS = np.array([[(byte >> (2 * k) & 3) + 1 for k in range(4)] for byte in range(256)], np.uint8)
_TABLES: dict[str, W.WordTable] = {}


# --- the code: two control bits per value, its length in bytes less one ----------
def pack(values: np.ndarray) -> tuple[bytes, bytes]:
    """Control bytes and data bytes of unsigned 32-bit values."""
    v = values.astype("<u4")
    extra = (v > 0xFF).astype(np.uint8) + (v > 0xFFFF) + (v > 0xFFFFFF)
    padded = np.zeros(-(-len(v) // 4) * 4, np.uint8)
    padded[: len(v)] = extra
    quads = padded.reshape(-1, 4)
    control = quads[:, 0] | quads[:, 1] << 2 | quads[:, 2] << 4 | quads[:, 3] << 6
    used = np.arange(4) <= extra[:, None]
    return control.astype(np.uint8).tobytes(), v.view(np.uint8).reshape(-1, 4)[used].tobytes()


def unpack(control: bytes, data: bytes, n: int) -> np.ndarray:
    """The ``n`` values of ``pack``; lengths come from a table by control byte."""
    lengths = LENGTHS[np.frombuffer(control, np.uint8)].ravel()[:n].astype(np.int64)
    ends = np.cumsum(lengths)
    if n and ends[-1] != len(data):
        raise ValueError(f"{len(data)} data bytes where the control bytes say {ends[-1]}")
    raw = np.concatenate([np.frombuffer(data, np.uint8), np.zeros(3, np.uint8)])
    starts = ends - lengths
    out = raw[starts].astype(np.uint32)
    for k in (1, 2, 3):
        long = np.flatnonzero(lengths > k)
        out[long] |= raw[starts[long] + k].astype(np.uint32) << np.uint32(8 * k)
    return out


# --- encoding --------------------------------------------------------------------
def pieces_of(text: str) -> list[str]:
    """A text in pieces that a byte-level tokenizer encodes apart from each other.

    A blank or a line feed between two characters that are no white space always
    begins a new word of such a tokenizer, and so does a stop or comma between a
    letter or digit and white space.  So most pieces are plain words, and few of
    them are new.
    """
    odd = "  " in text or " \n" in text or "\n " in text or "\n\n" in text or MARK in text
    if odd or text[:1].isspace() or text[-1:].isspace() or any(c.isspace() and c not in " \n" for c in set(text)):
        return _SAFE_SPLIT.split(text)
    marked = text.replace(" ", f"{MARK} ").replace("\n", f"{MARK}\n{MARK}") + MARK
    return _STOP.sub(f"{MARK}\\1", marked).split(MARK)[:-1]


def _table_of(path: str) -> W.WordTable:
    """Ids of pieces, kept by a worker from task to task."""
    if path not in _TABLES:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        known = Tokenizer.from_file(path)
        known.encode_special_tokens = True  # their strings in a text are ordinary text
        blank = np.zeros(known.get_vocab_size() + 1, bool)
        for token, id_ in known.get_vocab().items():
            blank[id_] = token[:1] == "\u0120"  # how byte-level tokens spell a blank

        def apart(pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
            found = [e.ids for e in known.encode_batch_fast(pieces, add_special_tokens=False)]
            return np.fromiter((i for ids in found for i in ids), np.uint32), np.fromiter(map(len, found), np.int64, len(found))

        def together(pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
            """Pieces that begin with their only blank: encoded in a row, parted at the blanks."""
            parts = [pieces[k : k + 100] for k in range(0, len(pieces), 100)]
            rows = known.encode_batch_fast(["".join(p) for p in parts], add_special_tokens=False)
            flat, lengths = [np.empty(0, np.uint32)], [np.empty(0, np.int64)]
            for part, row in zip(parts, rows):
                ids = np.array(row.ids, np.uint32)
                cuts = np.flatnonzero(blank[ids])
                fits = len(cuts) == len(part) and cuts[0] == 0
                more = (ids, np.diff(np.append(cuts, len(ids)))) if fits else apart(part)
                flat.append(more[0])
                lengths.append(more[1])
            return np.concatenate(flat), np.concatenate(lengths)

        def work_out(new: list[str]) -> tuple[np.ndarray, ...]:
            plain = np.array([_WORD(p) is not None for p in new], bool)
            lengths = np.empty(len(new), np.int64)
            starts = np.empty(len(new), np.int64)
            ids, lengths[plain] = together([new[k] for k in np.flatnonzero(plain).tolist()])
            more, lengths[~plain] = apart([new[k] for k in np.flatnonzero(~plain).tolist()])
            starts[plain] = np.cumsum(lengths[plain]) - lengths[plain]
            starts[~plain] = len(ids) + np.cumsum(lengths[~plain]) - lengths[~plain]
            table, flat = _TABLES[path], np.concatenate([ids, more])
            row = len(table.at) - len(new)
            start = int((table.columns[0][:row] + table.columns[1][:row]).max()) if row else 0
            used = start + len(flat)
            if used > len(table.flat):
                grown = np.empty(max(used, 2 * len(table.flat)), np.uint32)
                grown[:start] = table.flat[:start]
                table.flat = grown
            table.flat[start:used] = flat
            return start + starts, lengths

        _TABLES[path] = W.WordTable(work_out, limit=400_000)
        _TABLES[path].flat = np.empty(0, np.uint32)
    return _TABLES[path]


def _forget_pieces() -> None:
    """Give back the room of encoded pieces: a worker that packs or reads needs none."""
    _TABLES.clear()


def encode(texts: list[str | None], path: str) -> Iterator[np.ndarray]:
    """Ids of each text, the end id last; a null text has the end id alone."""
    table = _table_of(path)
    for start, end in W.slices(texts, ENCODED_CHARS):
        lists = [pieces_of(t) if t else [] for t in texts[start:end]]
        counts = np.fromiter(map(len, lists), np.int64, len(lists))
        rows = table.rows([p for pieces in lists for p in pieces])
        if not len(rows):
            yield from (np.array([END], np.uint32) for _ in lists)
            continue
        starts, lengths = table.columns[0][rows], table.columns[1][rows]
        ends = np.cumsum(lengths)
        ids = table.flat[np.repeat(starts - ends + lengths, lengths) + np.arange(ends[-1])]
        per_text = np.cumsum(W.row_sums(lengths, counts))
        for a, b in zip([0, *per_text[:-1]], per_text):
            yield np.append(ids[a:b], np.uint32(END))


def _encoded(path: str, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of files in their order: shard, block, files, lengths and ids."""
    block, shard, held, files, size = 0, None, [], [], 0

    def out(kind: pa.DataType) -> pa.RecordBatch:
        lengths = [len(x) for x in held]
        ids = np.concatenate(held)
        narrow = ids.astype("<u2") if ids.max() < 1 << 16 else ids.astype("<u4")
        return pa.RecordBatch.from_arrays(
            [
                pa.array([shard], pa.int32()), pa.array([block], pa.int64()), pa.array([files], pa.list_(kind)), pa.array([lengths], pa.list_(pa.int64())),
                pa.array([narrow.itemsize], pa.int32()), pa.array([narrow.tobytes()], pa.binary()),
            ],
            names=["shard", "block", "files", "lengths", "width", "ids"],
        )

    kind = pa.int64()
    for batch in batches:
        kind = batch.column("file").type
        shard = batch.column("shard")[0].as_py() if batch.num_rows else shard
        for file, ids in zip(batch.column("file").to_pylist(), encode(batch.column("text").to_pylist(), path)):
            held.append(ids)
            files.append(file)
            size += len(ids)
            if size >= BLOCK_TOKENS:
                yield out(kind)
                block, size = block + 1, 0
                held.clear()
                files.clear()
    if held:
        yield out(kind)


def _ids(width: int, ids: bytes) -> np.ndarray:
    return np.frombuffer(ids, "<u2" if width == 2 else "<u4")


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(0, np.int64)
    for batch in batches:
        for width, ids in zip(batch.column("width").to_pylist(), batch.column("ids").to_pylist()):
            counts = np.bincount(_ids(width, ids), minlength=len(total))
            counts[: len(total)] += total
            total = counts
    found = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(found, pa.int64()), pa.array(total[found], pa.int64())], names=["id", "n"])


def write_token_files(files: DataFrame, tokenizer: str, folder: str | None = None) -> str:
    """Write the token ids of ``files`` ``(file, text)``; returns the folder.

    Files stand in ascending order of ``file`` (null first; repeated files by the
    hash of their text), each ended by id 0.  The folder holds two tables:
    ``blocks`` ``(shard, block, start, files, lengths, control, data)``, a row per
    block of about half a million ids, and ``ranks`` ``(rank, id)``.  Ids are
    replaced by their rank by frequency over all files (ties by id) and packed in
    as few bytes as they need, lengths apart in control bytes.  ``ranks`` has no
    more rows than the tokenizer has ids, so it may go to every worker.  Blocks
    are written by Spark's own writers: to any store, and whole if a task is lost.

    ``tokenizer`` is the path of a tokenizers file, there on every worker.  A null
    text counts as empty; an empty table writes empty tables; further columns of
    ``files`` are left out.
    """
    spark = files.sparkSession
    ship(spark)
    folder = folder or f"{shared_folder(spark)}/ledgerfold/tokens-{uuid.uuid4().hex}"
    kind = files.schema["file"].dataType.simpleString()
    keyed = files.select("file", "text", F.xxhash64("text").alias("tie"))
    ordered = keyed.repartitionByRange("file", "tie").withColumn("shard", F.spark_partition_id()).sortWithinPartitions("file", "tie")
    shape = f"shard int, block bigint, files array<{kind}>, lengths array<bigint>, width int, ids binary"
    encoded = cut(ordered.select("file", "text", "shard").mapInArrow(lambda b: _encoded(tokenizer, b), shape))
    counts = encoded.select("width", "ids").mapInArrow(_frequencies, "id bigint, n bigint").groupBy("id").agg(F.sum("n").alias("n"))
    by_rank = np.array([r["id"] for r in counts.orderBy(F.desc("n"), "id").collect()], np.int64)  # as many as the tokenizer has ids
    rank_of = np.zeros(int(by_rank.max(initial=0)) + 1, np.uint32)
    rank_of[by_rank] = np.arange(len(by_rank))
    known = spark.sparkContext.broadcast(rank_of)

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _forget_pieces()
        for batch in batches:
            both = [pack(known.value[_ids(w, i)]) for w, i in zip(batch.column("width").to_pylist(), batch.column("ids").to_pylist())]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-2], pa.array([c for c, _ in both], pa.binary()), pa.array([d for _, d in both], pa.binary())],
                names=[*batch.schema.names[:-2], "control", "data"],
            )

    sized = encoded.select("shard", "block", F.aggregate("lengths", F.lit(0).cast("bigint"), lambda a, x: a + x).alias("n"))
    inside = Window.partitionBy("shard").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # a row per shard
    shards = sized.groupBy("shard").agg(F.sum("n").alias("n")).select("shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    starts = sized.withColumn("within", F.coalesce(F.sum("n").over(inside), F.lit(0))).join(shards, "shard")
    starts = cut(starts.select("shard", "block", (F.col("base") + F.col("within")).alias("start")))
    coded = encoded.mapInArrow(packed, f"shard int, block bigint, files array<{kind}>, lengths array<bigint>, control binary, data binary")
    coded.join(F.broadcast(starts) if _small(starts) else starts, ["shard", "block"]).write.parquet(f"{folder}/blocks")
    spark.createDataFrame([(k, int(i)) for k, i in enumerate(by_rank)], "rank int, id bigint").write.parquet(f"{folder}/ranks")
    return folder


def _small(frame: DataFrame, most: int = 200_000) -> bool:
    """Whether a written table has few rows; told by its own count."""
    return frame.count() <= most


def read_token_files(spark: SparkSession, folder: str) -> DataFrame:
    """``(file, start, n_tokens, ids_crc32)`` of what ``write_token_files`` wrote.

    A row per file: ids of all files before it, its own ids with the end id, and
    their checksum as little-endian unsigned 32-bit integers, all from the bytes
    in the folder.
    """
    ship(spark)
    ranks = spark.read.parquet(f"{folder}/ranks").orderBy("rank").collect()
    known = spark.sparkContext.broadcast(np.array([r["id"] for r in ranks], "<u4"))
    blocks = spark.read.parquet(f"{folder}/blocks")
    kind = blocks.schema["files"].dataType.elementType.simpleString()

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _forget_pieces()
        for batch in batches:
            for files, lengths, control, data, start in zip(*(batch.column(c).to_pylist() for c in ("files", "lengths", "control", "data", "start"))):
                ends = np.cumsum(lengths)
                ids = known.value[unpack(control, data, int(ends[-1]))]
                starts = ends - lengths
                crc = [zlib.crc32(ids[a:b].tobytes()) for a, b in zip(starts, ends)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(files, batch.column("files").type.value_type), pa.array(starts + start, pa.int64()), pa.array(lengths, pa.int64()), pa.array(crc, pa.int64())],
                    names=["file", "start", "n_tokens", "ids_crc32"],
                )

    return blocks.select("files", "lengths", "control", "data", "start").mapInArrow(read, f"file {kind}, start bigint, n_tokens bigint, ids_crc32 bigint")
