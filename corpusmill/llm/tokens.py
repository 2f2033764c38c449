"""Token ids of documents and their Parquet store.

The store is a folder of Parquet files in ascending document order and a small manifest. Each row holds a document's id,
its file number, its offset in that file's ids, its count, and the ids as a list column. Ids are dictionary encoded
(few distinct values, packed at the width of the dictionary's index); ids of documents and offsets, which grow, are
delta encoded. Row groups and pages are small, and pages carry an index, so that a read of some documents, or of the
metadata alone, touches only their pages.

Defined cases: a null text is empty (its ids are the end id alone); the vocabulary's added tokens inside a text are
ordinary text to ``write_tokens`` unless ``added``, and are found as ``Tokenizer.encode`` finds them in the digest and in
``token_counts``; rows with one id follow one another in text order;
null ids come first; an empty table gives a store without documents.
"""

from __future__ import annotations

import json
import re
import zlib
from array import array
from collections.abc import Sequence
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusmill.llm.common import arrow_map, in_slices, list_array, shared_path, worker_memory

#: The byte-level vocabulary's pre-tokenizer pattern.
PIECES = (
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+"
    r"|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
)


#: Rows whose ids a task holds at once.
ROWS = 1000

#: Pieces that a Python worker remembers from task to task.
LASTING = 800_000


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def piece_encoder(path: str | None = None, keep: int = 400_000, keep_pieces: int = 400_000, whole: int = 100, added: bool = False, lasting: bool = False):
    """A function from texts to arrays of token ids, for use inside a task.

    Merges never cross a piece of the pre-tokenizer, and pieces never cross a space before a word. So a text is cut at
    its spaces; each distinct word is encoded once, and after that its ids are looked up as bytes and joined. About
    ``keep`` words and ``keep_pieces`` pieces are remembered (then the words, or the older half of the pieces, are
    forgotten), none longer than ``whole`` characters. Control strings in a text are ordinary text; with ``added`` a text is cut at the vocabulary's added tokens
    first, and these get their own ids. With ``lasting`` the vocabulary and the pieces stay in the Python worker for its
    next tasks: most of a task's new words are new to that task alone.
    """
    import regex

    tokenizer, pieces = _pieces(path or tokenizer_path(), whole, lasting)
    own = {t.content: i for i, t in tokenizer.get_added_tokens_decoder().items()} if added else {}
    if added and any(t.lstrip or t.rstrip or t.single_word for t in tokenizer.get_added_tokens_decoder().values()):
        raise ValueError("added tokens that take in white space or stand as words alone are not supported")
    cut_added = re.compile("(" + "|".join(map(re.escape, sorted(own, key=len, reverse=True))) + ")").split if own else None
    split = regex.compile(PIECES).findall
    inner = re.compile(r" \s").search

    class Words(dict):
        """Ids of a space and the word behind it, as bytes."""

        def __missing__(self, word: str) -> bytes:
            if word.isalpha():  # a space and letters are one piece
                got = piece_ids(" " + word)
            elif word[-1:] in (".", ",") and word[:-1].isalpha():
                got = piece_ids(" " + word[:-1]) + piece_ids(word[-1])
            else:
                got = b"".join(map(piece_ids, split(" " + word)))
            if len(word) < whole:
                self[word] = got
            return got

    words = Words()
    piece_ids, word_ids = pieces.__getitem__, words.__getitem__

    def plain(text: str) -> bytes:
        """White space is never cut within a run."""
        if inner(text):
            return b"".join(map(piece_ids, split(text)))
        first, *rest = text.split(" ")
        return b"".join(map(piece_ids, split(first))) + b"".join(map(word_ids, rest))

    def whole_text(text: str) -> bytes:
        if cut_added and any(t in text for t in own):
            return b"".join(array("H", [own[p]]).tobytes() if i % 2 else plain(p) for i, p in enumerate(cut_added(text)) if p)
        return plain(text)

    def encode(texts: Sequence[str]) -> list[np.ndarray]:
        if len(pieces) > keep_pieces:
            for piece in list(islice(pieces, keep_pieces // 2)):  # the oldest
                del pieces[piece]
        if len(words) > keep:
            words.clear()
        return [np.frombuffer(whole_text(t), dtype=np.uint16) for t in texts]

    return encode


class Pieces(dict):
    """Ids of pieces of the pre-tokenizer, as bytes; what is not there yet is encoded, and kept if it is short."""

    def __init__(self, tokenizer, whole: int) -> None:
        super().__init__()
        self.tokenize, self.signs, self.whole = tokenizer.model.tokenize, byte_signs(), whole

    def __missing__(self, piece: str) -> bytes:
        got = array("H", [t.id for t in self.tokenize(piece.encode().decode("latin-1").translate(self.signs))]).tobytes()
        if len(piece) <= self.whole:
            self[piece] = got
        return got


def _pieces(path: str, whole: int, lasting: bool) -> tuple:
    """A tokenizer and its pieces: none so far, or those that this worker knows."""
    from tokenizers import Tokenizer

    kept = worker_memory() if lasting else {}
    name = f"pieces {path} {whole}"
    if name not in kept:
        tokenizer = Tokenizer.from_file(path)
        if not byte_level(tokenizer):
            raise ValueError("only vocabularies of at most 65536 ids whose texts are cut by the byte-level pattern alone are supported")
        kept[name] = tokenizer, Pieces(tokenizer, whole)
    return kept[name]


def byte_level(tokenizer) -> bool:
    """Whether ``PIECES`` is how the tokenizer cuts texts, with nothing before or after that changes ids."""
    cut = json.loads(tokenizer.pre_tokenizer.__getstate__()) if tokenizer.pre_tokenizer else {}
    plain = cut.get("type") == "ByteLevel" and not cut.get("add_prefix_space") and cut.get("use_regex", True)
    return plain and tokenizer.normalizer is None and tokenizer.get_vocab_size() <= 1 << 16


def byte_signs() -> dict[int, str]:
    """The printable sign that stands for each byte in a byte-level vocabulary: printable ones stand for themselves, the
    others follow one another from U+0100 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


def token_counts(docs: DataFrame, key: str = "doc_id", text: str = "text", end: int = 1, keep: int = 400_000) -> DataFrame:
    """``doc_id`` and ``n_tokens`` (with ``end`` ids at the end) of every whole text; about ``keep`` words and pieces are
    remembered in a task."""

    def make():
        encode = piece_encoder(keep=keep, keep_pieces=keep, added=True)

        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            counts = [len(ids) + end for part in in_slices(texts) for ids in encode(part)]
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64())], ["doc_id", "n_tokens"])

        return each

    return arrow_map(docs.select(F.col(key).cast("bigint").alias("doc_id"), F.col(text).alias("text")), make, "doc_id long, n_tokens long", ROWS)


def write_tokens(
    docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", end_id: int = 2, parts: int | None = None,
    row_group_bytes: int = 16 << 20, page_bytes: int = 64 << 10, page_rows: int = 2000,
    added: bool = False,
) -> None:
    """Encode every whole text, append ``end_id``, and write the store to ``path``: one exchange, by range of id."""
    spark = docs.sparkSession
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = (
        docs.select(F.col(key).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
        .repartitionByRange(parts, "doc_id")
        .sortWithinPartitions("doc_id", "text")
        .withColumn("part", F.spark_partition_id())
    )

    def make():
        encode = piece_encoder(added=added, keep_pieces=LASTING, lasting=True)
        tail = np.array([end_id], dtype=np.uint32)
        so_far = 0

        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            nonlocal so_far
            texts = [t or "" for t in batch.column("text").to_pylist()]
            ids = [np.concatenate([x, tail]) for some in in_slices(texts) for x in encode(some)]
            counts = np.fromiter(map(len, ids), dtype=np.int64, count=len(ids))
            offsets = so_far + np.cumsum(counts) - counts
            so_far += int(counts.sum())
            return pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("part"), pa.array(offsets), pa.array(counts), list_array(ids, pa.int32())],
                ["doc_id", "part", "part_offset", "n_tokens", "ids"],
            )

        return each

    rows = arrow_map(ordered, make, "doc_id long, part int, part_offset long, n_tokens long, ids array<int>", ROWS)
    (
        rows.write.option("parquet.writer.version", "PARQUET_2_0")
        .option("compression", "zstd")
        .option("parquet.enable.dictionary", "false")
        .option("parquet.enable.dictionary#ids.list.element", "true")
        .option("parquet.block.size", str(row_group_bytes))
        .option("parquet.page.size", str(page_bytes))
        .option("parquet.page.row.count.limit", str(page_rows))
        .parquet(f"{path}/ids")
    )
    # One row per file: a window over all of them stays small.
    files = (
        spark.read.parquet(f"{path}/ids").groupBy("part")
        .agg(F.min("doc_id").alias("first_doc"), F.count("*").alias("n_docs"), F.sum("n_tokens").alias("tokens"))
    )
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    files.withColumn("base", F.coalesce(F.sum("tokens").over(before), F.lit(0))).coalesce(1).write.parquet(f"{path}/manifest")


def read_tokens(spark: SparkSession, path: str, doc_ids: Sequence[int] | None = None, metadata_only: bool = False) -> DataFrame:
    """``doc_id``, ``start`` (ids of all documents before it), ``n_tokens`` and, unless ``metadata_only``, ``ids``.

    ``doc_ids`` is pushed down to row groups and pages.
    """
    rows = spark.read.parquet(f"{path}/ids")
    if doc_ids is not None:
        rows = rows.where(F.col("doc_id").isin(*doc_ids))
    manifest = spark.read.parquet(f"{path}/manifest").select("part", "base")
    out = rows.join(manifest, "part").withColumn("start", F.col("base") + F.col("part_offset"))
    return out.select("doc_id", "start", "n_tokens", *([] if metadata_only else ["ids"]))


def with_crc(rows: DataFrame) -> DataFrame:
    """Adds ``ids_crc32``: unsigned crc32 of the ids as little-endian unsigned 32-bit integers; drops the ids."""

    def make():
        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            ids = batch.column("ids")
            ends = ids.offsets.to_numpy()
            flat = ids.values.to_numpy(zero_copy_only=False).astype("<u4")
            sums = [zlib.crc32(flat[a:b].tobytes()) for a, b in zip(ends[:-1], ends[1:])]
            names = ["doc_id", "start", "n_tokens"]
            return pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(sums, pa.int64())], [*names, "ids_crc32"])

        return each

    return arrow_map(rows, make, "doc_id long, start long, n_tokens long, ids_crc32 long")


def stored_digest(docs: DataFrame) -> DataFrame:
    """Write ``docs`` as a token store in the shared folder, read it back, and describe each document from its ids."""
    path = shared_path(docs.sparkSession, "tokens")
    write_tokens(docs, path, added=True)
    return with_crc(read_tokens(docs.sparkSession, path))
