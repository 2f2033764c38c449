"""Chat formatting as a prefix tree.

Conversations that begin with the same turns share them: a node of the tree is a turn after all turns before it. Its
path is the row of its turns' hashes, so that paths in byte order are the tree depth first, and a sort by range lays the
tree out over as many tasks as there are, a hot first turn too. Each node's tokens are written once, in that order. A
node also gets its place in the stream, its first position (the tokens of its ancestors), and the intervals of the
stream that its tokens may attend to besides themselves: its ancestors, where neighbours in the stream are one interval.

The template is ``<|im_start|>role\\ntext<|im_end|>\\n``. In texts and roles a backslash goes between ``<`` and ``|`` (and
one more where some stand there already), so that no text holds a control string and each can be read back. Each part is
encoded by itself, so the loss mask, the text of an assistant turn, begins and ends at a token's border.

Defined cases: null texts and roles are empty; turns of one number follow one another by role and text, null numbers
first; equal conversations share all nodes; a null conversation id is a conversation; an empty table gives empty tables;
columns other than the four named ones are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusmill.llm.common import arrow_map, in_slices, list_array, shared_path
from corpusmill.llm.tokens import byte_signs, piece_encoder, tokenizer_path

OPEN, CLOSE, SPOKEN = "<|im_start|>", "<|im_end|>\n", "assistant"
STEP = 8
_TURN = re.compile(r"<\|im_start\|>([^\n]*)\n(.*?)<\|im_end\|>\n", re.S)


def escaped(text: str) -> str:
    return re.sub(r"<(\\*)\|", r"<\1\\|", text)


def unescaped(text: str) -> str:
    return re.sub(r"<(\\*)\\\|", r"<\1|", text)


def escaped_role(role: str) -> str:
    return escaped(role.replace("\\", "\\\\").replace("\n", "\\n"))


def unescaped_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescaped(role))


def node_of(path: bytes) -> bytes:
    return hashlib.blake2b(path, digest_size=16).digest()


def turns_of(conversations: DataFrame) -> DataFrame:
    """``conv_id``, ``depth``, ``node``, ``path``, ``role``, ``text``: each turn with its node in the tree."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    rows = conversations.select(F.col("conv_id").cast("bigint").alias("conv_id"), F.struct(F.col("turn").cast("bigint").alias("turn"), text("role"), text("text")).alias("t"))
    whole = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))

    def make():
        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            out: list[tuple] = []
            for conv, turns in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                path = b""
                for depth, t in enumerate(turns):
                    path += hashlib.blake2b(f"{len(t['role'])}:{t['role']}{t['text']}".encode(), digest_size=STEP).digest()
                    out.append((conv, depth, node_of(path), path, t["role"], t["text"]))
            kinds = (pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.string(), pa.string())
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], ["conv_id", "depth", "node", "path", "role", "text"])

        return each

    return arrow_map(whole, make, "conv_id long, depth int, node binary, path binary, role string, text string")


def write_tree(conversations: DataFrame, path: str, parts: int | None = None) -> None:
    """Write the tree to ``path``: ``members`` (conversation, depth, node), ``tokens`` (each node once, depth first) and
    ``layout`` (each node's place, first position and attention intervals)."""
    spark = conversations.sparkSession
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    turns_of(conversations).write.parquet(f"{path}/turns")
    turns = spark.read.parquet(f"{path}/turns")
    turns.select("conv_id", "depth", "node").write.parquet(f"{path}/members")
    nodes = turns.groupBy("node").agg(*(F.min(c).alias(c) for c in ("depth", "path", "role", "text")))
    ordered = nodes.repartitionByRange(parts, "path").sortWithinPartitions("path").withColumn("part", F.spark_partition_id())

    def make():
        encode = piece_encoder()
        so_far = 0

        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            nonlocal so_far
            roles, texts = batch.column("role").to_pylist(), batch.column("text").to_pylist()
            strings = [s for r, t in zip(roles, texts) for s in (f"{OPEN}{escaped_role(r)}\n", escaped(t), CLOSE)]
            ids = [x for some in in_slices(strings) for x in encode(some)]
            sizes = np.array([len(x) for x in ids], dtype=np.int64).reshape(-1, 3)
            counts = sizes.sum(axis=1)
            offsets = so_far + np.cumsum(counts) - counts
            so_far += int(counts.sum())
            whole = [np.concatenate(ids[k : k + 3]) for k in range(0, len(ids), 3)]
            loss = [r == SPOKEN for r in roles]
            return pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("node", "path", "depth", "part")), pa.array(offsets), pa.array(counts),
                 pa.array(np.where(loss, sizes[:, 0], 0)), pa.array(np.where(loss, sizes[:, 0] + sizes[:, 1], 0)), list_array(whole, pa.int32())],
                names,
            )

        return each

    schema = "node binary, path binary, depth int, part int, part_offset long, n_tokens long, loss_from long, loss_to long, ids array<int>"
    names = [c.split()[0] for c in schema.split(", ")]
    arrow_map(ordered, make, schema).write.parquet(f"{path}/tokens")
    _write_layout(spark, path)


def _write_layout(spark: SparkSession, path: str) -> None:
    rows = spark.read.parquet(f"{path}/tokens").select("node", "path", "depth", "part", "part_offset", "n_tokens")
    files = rows.groupBy("part").agg(F.sum("n_tokens").alias("tokens"), F.min("path").alias("head"))  # one row per file
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    files = files.withColumn("base", F.coalesce(F.sum("tokens").over(before), F.lit(0)))
    files.coalesce(1).write.parquet(f"{path}/manifest")
    files = spark.read.parquet(f"{path}/manifest")
    rows = rows.join(files.select("part", "base"), "part").withColumn("start", F.col("base") + F.col("part_offset")).drop("base")
    # The ancestors of each file's first node lie in files before it: a few rows per file.
    heads = files.select("part", F.explode(F.sequence(F.lit(1), (F.length("head") / STEP).cast("int"))).alias("k"), "head")
    heads = heads.select("part", F.substring("head", F.lit(1), F.col("k") * STEP).alias("path"))
    opened: dict[int, list[tuple[bytes, int, int]]] = {}
    for r in heads.join(rows.select("path", "start", "n_tokens"), "path").select("part", "path", "start", "n_tokens").collect():
        opened.setdefault(r.part, []).append((bytes(r.path), r.start, r.n_tokens))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, stack = None, []  # the open path: each node's path, place and size

        for batch in batches:
            out: list[tuple] = []
            for part, name, node_path, start, n in zip(*(batch.column(c).to_pylist() for c in ("part", "node", "path", "start", "n_tokens"))):
                if part != now:
                    now, stack = part, sorted((x for x in opened.get(part, []) if len(x[0]) < len(node_path)), key=lambda x: len(x[0]))
                while stack and not (len(stack[-1][0]) < len(node_path) and node_path.startswith(stack[-1][0])):
                    stack.pop()
                spans: list[list[int]] = []
                for _, a, size in stack:
                    if spans and spans[-1][1] == a:
                        spans[-1][1] = a + size
                    else:
                        spans.append([a, a + size])
                out.append((name, start, sum(x[2] for x in stack), n, spans))
                stack.append((node_path, start, n))
            if out:
                kinds = (pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.list_(pa.int64())))
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], ["node", "start", "first_position", "n_tokens", "attends"])

    width = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = rows.select("part", "node", "path", "start", "n_tokens").repartition(width, "part").sortWithinPartitions("part", "start")
    ordered.mapInArrow(run, "node binary, start long, first_position long, n_tokens long, attends array<array<long>>").write.parquet(f"{path}/layout")


def id_bytes() -> list[bytes]:
    """The bytes that each token id stands for."""
    from tokenizers import Tokenizer

    back = {s: b for b, s in byte_signs().items()}
    vocabulary = Tokenizer.from_file(tokenizer_path()).get_vocab()
    out = [b""] * (max(vocabulary.values()) + 1)
    for token, i in vocabulary.items():
        out[i] = bytes(back[c] for c in token) if all(c in back for c in token) else token.encode()
    return out


def read_conversations(spark: SparkSession, path: str) -> DataFrame:
    """From the written tree, per conversation: ``conv_id``, ``n_turns``, ``turns_sha256``, ``loss_chars``,
    ``loss_sha256`` and ``formatted_chars``."""
    members = spark.read.parquet(f"{path}/members")
    tokens = spark.read.parquet(f"{path}/tokens").select("node", "loss_from", "loss_to", "ids")
    rows = members.join(tokens, "node").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("depth", "loss_from", "loss_to", "ids"))).alias("nodes"))

    def make():
        raw = id_bytes()

        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            out: list[tuple] = []
            for conv, nodes in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                text, spoken = b"", []
                for n in nodes:
                    text += b"".join(raw[i] for i in n["ids"])
                    spoken.append(unescaped(b"".join(raw[i] for i in n["ids"][n["loss_from"] : n["loss_to"]]).decode()))
                formatted = text.decode()
                turns = [(unescaped_role(r), unescaped(t)) for r, t in _TURN.findall(formatted)]
                heard = "".join(spoken)
                digest = hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
                out.append((conv, len(turns), digest, len(heard), hashlib.sha256(heard.encode()).hexdigest(), len(formatted)))
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names)

        return each

    schema = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    names = [c.split()[0] for c in schema.split(", ")]
    return arrow_map(rows, make, schema)


def formatted(conversations: DataFrame) -> DataFrame:
    """Write the tree of ``conversations`` to the shared folder and read each conversation back from it."""
    path = shared_path(conversations.sparkSession, "chat")
    write_tree(conversations, path)
    return read_conversations(conversations.sparkSession, path)
