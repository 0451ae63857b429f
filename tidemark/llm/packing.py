"""Best-fit packing of token sequences: local best fit, then a tree of merges of underfull bins."""

from __future__ import annotations

import array
import os
import re
import zlib
from collections.abc import Callable, Iterator, Mapping

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import cut

PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"
ASSIGNED = "item bigint, fill bigint, bin bigint, at bigint, bin_fill bigint"
#: Bits of a bin's number: round, then partition, then place within the partition.
ROUND_AT, PART_AT = 56, 28


class WordIds:
    """ids, as little-endian uint32 bytes, of the parts of a text between spaces and line ends.

    The tokenizer never joins characters across white space, so a text's ids are those of its parts in
    order. Parts made of plain Latin characters take a short way to the model; all others go through the whole
    tokenizer. At most `most` parts are kept.
    """

    # letters and signs to U+024F without controls, spaces, < (special tokens start so) and what normalization changes
    PLAIN = re.compile("[!-;=-~¡-ɏ]*")
    #: Marks that are a token piece of their own after a word.
    MARKS = frozenset(".,;:!?")

    def __init__(self, path: str, most: int = 1_000_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.held: dict[str, bytes] = {}
        import regex
        from tokenizers import Tokenizer

        self.whole, self.most = Tokenizer.from_file(path), most
        self.tokens = self.whole.model.tokenize
        self.parts = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+").findall
        keep = [*range(33, 127), *range(161, 173), *range(174, 256)]
        self.bytes = {b: chr(b) for b in keep} | {b: chr(256 + i) for i, b in enumerate(x for x in range(256) if x not in set(keep))}

    def ids_of(self, part: str) -> bytes:
        if (out := self.held.get(part)) is not None:
            return out
        if len(self.held) >= self.most:
            self.held.clear()
        if part.isascii() and part.isalpha():
            ids = array.array("I", [t.id for t in self.tokens(part.lower())])
        elif self.PLAIN.fullmatch(part):
            ids = array.array("I")
            head = part[:-1]
            for p in (head.lower(), part[-1]) if part[-1:] in self.MARKS and head.isascii() and head.isalpha() else self.parts(part.lower()):
                ids.extend([t.id for t in self.tokens(p if p.isascii() else p.encode().decode("latin1").translate(self.bytes))])
        else:
            ids = array.array("I", self.whole.encode(part, add_special_tokens=False).ids)
        out = ids.tobytes()
        if len(part) <= 40:
            self.held[part] = out
        return out

    def __call__(self, text: str) -> bytes:
        parts = text.replace("\n", " ").split(" ")
        out = list(map(self.held.get, parts))  # a plain look-up for all, then the few that are not held
        if None in out:
            out = [self.ids_of(p) if ids is None else ids for p, ids in zip(parts, out, strict=True)]
        return b"".join(out)


_WORDS: dict[str, WordIds] = {}


def tokenize_into(path: str, limit: int, end_id: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    end = end_id.to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if path not in _WORDS:  # a worker serves many tasks
            _WORDS[path] = WordIds(path)
        words = _WORDS[path]
        for batch in batches:
            out: list[list] = [[] for _ in range(5)]
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                ids = words(text.as_py() or "") + end
                n = len(ids) // 4
                for k, start in enumerate(range(0, n, limit)):
                    part = memoryview(ids)[4 * start : 4 * (start + limit)]
                    for column, v in zip(out, (doc_id, k, start, len(part) // 4, zlib.crc32(part)), strict=True):
                        column.append(v)
            types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types, strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return run


def pieces(docs: DataFrame, tokenizer: str, limit: int = 4096, end_id: int = 1) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of docs (doc_id, text): ids of the text, then end_id, cut every `limit` ids.

    `tokenizer` is the path of a tokenizer file that every executor has. Null text counts as empty: one
    piece that holds end_id. Texts are read once and only these numbers leave the task.
    """
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(tokenize_into(tokenizer, limit, end_id), PIECES)


def best_fit(lengths: list[int], limit: int, fills: list[int] | None = None) -> tuple[list[int], list[int], list[int]]:
    """Best fit of lengths in the given order: for each its bin and place, and the fill of each bin.

    Bins are stacked by room left; an integer with a bit for each room that occurs finds the smallest that suffices.
    """
    stacks: list[list[int]] = [[] for _ in range(limit + 1)]
    rooms, bins, at, filled = 0, [], [], []
    for n in lengths:
        fit = rooms >> n
        if fit:
            room = n + (fit & -fit).bit_length() - 1
            b = stacks[room].pop()
            if not stacks[room]:
                rooms &= ~(1 << room)
        else:
            b, room = len(filled), limit
            filled.append(0)
        bins.append(b)
        at.append(filled[b])
        filled[b] += n
        if room > n:
            stacks[room - n].append(b)
            rooms |= 1 << (room - n)
    return bins, at, filled


def _pack(round_no: int, limit: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple[int, int]] = []
        for b in batches:
            rows += zip(b.column("fill").to_pylist(), b.column("item").to_pylist(), strict=True)
        rows.sort(key=lambda r: (-r[0], r[1]))  # decreasing, whatever order the rows came in
        bins, at, fills = best_fit([r[0] for r in rows], limit)
        base = (round_no << ROUND_AT) | (TaskContext.get().partitionId() << PART_AT)
        step = 50_000
        for s in range(0, len(rows), step):
            part = range(s, min(s + step, len(rows)))
            columns = ([rows[i][1] for i in part], [rows[i][0] for i in part], [base | bins[i] for i in part], [at[i] for i in part], [fills[bins[i]] for i in part])
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["item", "fill", "bin", "at", "bin_fill"])

    return run


def still_open(fills: Mapping[int, int], limit: int, slack: int) -> tuple[int, int]:
    """(largest fill of a bin that goes on, number of these) of bins counted by fill.

    Bins with room for no more than slack are nearly full and done. So is a bin that can't take the emptiest one of all
    partitions, as items only grow: nothing that could still be merged is closed.
    """
    under = [f for f in fills if f < limit - slack]
    top = min(limit - slack - 1, limit - min(under, default=limit))
    n = sum(fills[f] for f in under if f <= top)
    return (top, n) if n > 1 else (0, 0)


def pack(items: DataFrame, *, limit: int = 4096, per_task: int = 100_000, slack: int = 8) -> DataFrame:
    """Packs items (item: a unique number, fill: 1 to limit) into bins of at most `limit`: (item, sequence_id, offset).

    Hierarchical: items fall by a hash of their number into partitions of about per_task, each packed best
    fit in order of decreasing length. Nearly full bins are done (see still_open()); the others become items of the next
    round, again about per_task to a partition, so partitions get fewer as bins do and no task's input grows with the corpus. It ends
    when one partition holds all that is open, or when a round has merged less than one bin a partition: after best fit no two bins of
    a partition fit together, so at most one of each is up to half full, and every further merge would need
    such a one. What is lost against packing in one place is thus at most about one bin in per_task items. Every round is written to the shared
    folder, so that a lost executor can't number bins anew. The same items give the same packing.
    """
    n = items.count()
    parts = max(1, -(-n // per_task))
    steps: list[DataFrame] = []
    current = items.select("item", "fill")
    while True:
        dealt = current.repartition(parts, F.xxhash64("item", F.lit(len(steps)))) if parts > 1 else current.coalesce(1)
        done = cut(dealt.mapInArrow(_pack(len(steps) + 1, limit), ASSIGNED))
        steps.append(done.select("item", "bin", "at"))
        if parts == 1:
            break
        bins = done.where("at = 0").select(F.col("bin").alias("item"), F.col("bin_fill").alias("fill"))
        # at most `limit` numbers
        fills = {r["fill"]: r["count"] for r in bins.groupBy("fill").count().collect()}
        top, n_open = still_open(fills, limit, slack)
        if n_open == 0 or len(steps) > 1 and n - sum(fills.values()) < parts:
            break
        current, n, parts = bins.where(F.col("fill") <= top), n_open, -(-n_open // per_task)
    # where bins ended up, from the last round back: only the first step has a row for each item
    placed = steps.pop()
    while steps:
        up = placed.select(F.col("item").alias("up_item"), F.col("bin").alias("up_bin"), F.col("at").alias("up_at"))
        below = steps.pop().join(up, F.col("bin") == F.col("up_item"), "left")
        placed = below.select("item", F.coalesce("up_bin", "bin").alias("bin"), (F.col("at") + F.coalesce("up_at", F.lit(0))).alias("at"))
    return placed.select("item", F.col("bin").alias("sequence_id"), F.col("at").alias("offset"))


def pack_documents(docs: DataFrame, tokenizer: str, *, limit: int = 4096, end_id: int = 1, **how: int) -> DataFrame:
    """pieces() of docs with sequence_id and offset: gapless in every sequence, from 0.

    Whole pieces of `limit` fill a sequence alone and skip the packing. Null and empty texts are pieces of one
    id, null doc_ids and repeated rows are pieces like any other, an empty table gives an empty table.
    """
    numbered = cut(pieces(docs, tokenizer, limit, end_id).withColumn("item", F.monotonically_increasing_id()))
    short = numbered.where(F.col("length") < limit).select("item", F.col("length").alias("fill"))
    out = numbered.join(pack(short, limit=limit, **how), "item", "left")
    return out.select("doc_id", "piece", "start", "length", "ids_crc32", F.coalesce("sequence_id", "item").alias("sequence_id"), F.coalesce("offset", F.lit(0)).cast("long").alias("offset"))


