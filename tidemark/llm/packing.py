"""Best-fit packing into bins of several permitted lengths.

Documents are cut into pieces of at most the greatest permitted length (in tokens) and the pieces packed
into bins, longest first, each into the fullest open bin that still takes it.  The permitted lengths are
weighed jointly: where no open bin takes a piece, the bin size is opened that costs least for each token it
is expected to hold, given what is still unplaced.  In the end each bin is cut down to the least permitted
length that holds its contents.

Work is spread over shards of about ``shard_tokens`` tokens: pieces are dealt out by a hash, so a hot
source or a very long document is spread evenly, and each shard is packed by one task from lengths alone.
The number of shards grows with the input; a shard leaves at most a bin of each size partly filled, which is
a bounded loss per shard.

Defined results: NULL and empty texts (no tokens) take no place; a piece longer than every bin cannot
occur; ties go to the piece with the lower id, then the lower start; repeated rows are packed one by one;
an empty table gives no rows; other columns are ignored whatever their names.
"""

from __future__ import annotations

import base64
from bisect import bisect_left, insort
from collections.abc import Callable, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import staged

LENGTHS = (512, 1024, 2048, 4096)
#: tokens that a bin costs besides its length (its own pass through the model)
OVERHEAD = 8
#: share of a shared bin that is expected to be filled
FILL = 0.98
SHARD_TOKENS = 4_000_000
VOCABULARY = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
#: fixed value: the pre-tokenizer of that vocabulary
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def load_encoding(content: bytes, pattern: str = PATTERN):
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in content.splitlines() if line)}
    return tiktoken.Encoding("packing", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def _count_tokens(vocabulary, with_tokens: bool):
    """(id, tokens) of each text; the vocabulary is sent by Spark (its file need not be on the executors)."""

    def run(batches):
        encode = load_encoding(vocabulary.value).encode_ordinary
        for batch in batches:
            tokens = [encode(t) if t else [] for t in batch.column(1).to_pylist()]
            cols = [batch.column(0), pa.array([len(t) for t in tokens], pa.int64())]
            yield pa.RecordBatch.from_arrays(cols + ([pa.array(tokens, pa.list_(pa.int32()))] if with_tokens else []), names=["id", "n_tokens"] + ["tokens"] * with_tokens)

    return run


def cheapest_length(n: int, unplaced: int, lengths: Sequence[int], overhead: float = OVERHEAD, fill: float = FILL) -> int:
    """The permitted length to open for a piece of ``n`` tokens when ``unplaced`` tokens (others) are left."""

    def per_token(size: int) -> float:
        return (size + overhead) / (n + min((size - n) * fill, unplaced))

    return min((x for x in lengths if x >= n), key=lambda x: (per_token(x), x))


def pack_pieces(pieces: Sequence[tuple[int, int]], lengths: Sequence[int], overhead: float = OVERHEAD, fill: float = FILL) -> tuple[list[int], list[int], list[int]]:
    """Packs (length, number) pieces, longest first: (bin of each piece, offset of each, length of each bin)."""
    lengths = sorted(lengths)
    bin_of, offset_of = [0] * len(pieces), [0] * len(pieces)
    used: list[int] = []
    room: list[tuple[int, int]] = []  # (free tokens, bin), ascending
    unplaced = sum(n for n, _ in pieces)
    for n, i in pieces:
        unplaced -= n
        at = bisect_left(room, (n, -1))
        if at < len(room):
            free, b = room.pop(at)
        else:
            b, free = len(used), cheapest_length(n, unplaced, lengths, overhead, fill)
            used.append(0)
        bin_of[i], offset_of[i] = b, used[b]
        used[b] += n
        if free > n:
            insort(room, (free - n, b))
    return bin_of, offset_of, [lengths[bisect_left(lengths, u)] for u in used]


_PLACED = "shard long, bin long, id long, start long, n_tokens long, offset long, bin_length long"


def _pack_shard(lengths: tuple[int, ...], overhead: float, fill: float, with_tokens: bool):
    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("n_tokens", "descending"), ("id", "ascending"), ("start", "ascending"), ("row", "ascending")])
        n = table.column("n_tokens").to_pylist()
        b, offset, size = pack_pieces(list(zip(n, range(len(n)))), lengths, overhead, fill)
        cols = {
            "shard": table.column("shard"), "bin": pa.array(b, pa.int64()), "id": table.column("id"), "start": table.column("start"), "n_tokens": table.column("n_tokens"),
            "offset": pa.array(offset, pa.int64()), "bin_length": pa.array([size[x] for x in b], pa.int64()),
        }
        if with_tokens:
            cols["tokens"] = table.column("tokens")
        return pa.table(cols)

    return run


def pack(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lengths: Sequence[int] = LENGTHS, vocabulary: str = VOCABULARY, shard_tokens: int = SHARD_TOKENS,
    overhead: float = OVERHEAD, fill: float = FILL, with_tokens: bool = False, read: Callable[[str], bytes] | None = None,
) -> DataFrame:
    """One row per piece: ``bin_id`` (shard and number), id, ``start`` (first token of the piece in its document),
    ``n_tokens``, ``offset`` (its place in the bin) and ``bin_length``; the piece's ``tokens`` on request.

    ``id_col`` is an integer column.  ``vocabulary``: a tiktoken rank file that the driver can read (or ``read``
    returns its bytes)."""
    if not lengths or min(lengths) < 1:
        raise ValueError("needs permitted lengths of at least 1")
    spark = docs.sparkSession
    if read is None:
        with open(vocabulary, "rb") as f:
            content = f.read()
    else:
        content = read(vocabulary)
    sent = spark.sparkContext.broadcast(content)
    tokens = ", tokens array<int>" if with_tokens else ""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    counted = rows.mapInArrow(_count_tokens(sent, with_tokens), f"id long, n_tokens long{tokens}").where("n_tokens > 0")
    counted = staged(counted.withColumn("row", F.monotonically_increasing_id()), "tokens")
    total, n_rows = counted.agg(F.sum("n_tokens"), F.count(F.lit(1))).first()
    shards = max(1, -(-int(total or 0) // shard_tokens))
    most = max(lengths)
    start = F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_tokens") - 1, F.lit(most).cast("long"))).alias("start")
    cut = [F.slice("tokens", (F.col("start") + 1).cast("int"), F.lit(most)).alias("tokens")] if with_tokens else []
    pieces = counted.select("id", "row", F.col("n_tokens").alias("all"), start, *(["tokens"] if with_tokens else []))
    pieces = pieces.select("id", "row", "start", F.least(F.lit(most).cast("long"), F.col("all") - F.col("start")).alias("n_tokens"), *cut)
    pieces = pieces.withColumn("shard", F.pmod(F.xxhash64("row", "start"), F.lit(shards)).cast("long"))
    placed = pieces.groupBy("shard").applyInArrow(_pack_shard(tuple(sorted(lengths)), overhead, fill, with_tokens), _PLACED + tokens)
    bin_id = F.concat_ws("-", F.col("shard").cast("string"), F.col("bin").cast("string"))
    return placed.select(bin_id.alias("bin_id"), F.col("id").alias(id_col), "start", "n_tokens", "offset", "bin_length", *(["tokens"] if with_tokens else []))


def sequences(packed: DataFrame) -> DataFrame:
    """(bin_id, bin_length, tokens): the token sequence of each bin of ``pack(..., with_tokens=True)``."""
    parts = F.sort_array(F.collect_list(F.struct("offset", "tokens")))
    return packed.groupBy("bin_id", "bin_length").agg(F.flatten(F.transform(parts, lambda p: p["tokens"])).alias("tokens"))
