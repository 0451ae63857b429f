"""Similarity self-join of word n-gram sets by Jaccard: rare-first prefix filtering, then one exact check a pair."""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

from tidemark.llm.common import connected_components, cut, delete_folder, new_folder

UPPER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
#: Numbers of cells of the suffix filter's profile, and bits of the frequency sketch's index.
CELLS, SKETCH_BITS = 64, 22
#: The sketch travels in blocks of so many counters.
SKETCH_BLOCK = 1 << 16
PROFILED = "doc_id bigint, n bigint, sig binary, profile array<int>, block int, counts binary"
PREFIXES = "token bigint, doc_id bigint, n int, pos int"
#: A token's key is its frequency class, by logarithm, above CLASS_AT bits of its hash; the last class is for tokens that are known to be heavy.
CLASS_AT, LAST_CLASS, CLASS_STEPS = 51, 4095, 100


def words_of(text: str | None) -> list[bytes]:
    """Words of a text with A-Z lowered; bytes.split() splits at just the six characters that separate words."""
    return (text or "").encode("utf-8", "surrogatepass").translate(UPPER).split()


def shingles_of(text: str | None, width: int) -> set[tuple[bytes, ...]]:
    """Distinct runs of `width` words; all words as one if there are fewer; empty without words."""
    w = words_of(text)
    if len(w) < width:
        return {tuple(w)} if w else set()
    return set(zip(*(w[i:] for i in range(width)), strict=False))


def shingle_hashes(text: str | None, width: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of shingles_of(text)."""
    w = words_of(text)
    h = np.fromiter(map(xxh3_64_intdigest, w), np.uint64, len(w))  # as fast as looking them up
    n = len(h)
    if n == 0:
        return h
    if n >= width:
        x = h[: n - width + 1].copy()
        for i in range(1, width):
            x = x * np.uint64(0x9E3779B97F4A7C15) + h[i : n - width + 1 + i]
    else:
        x = np.array([0xA0761D6478BD642F + n], np.uint64)
        for v in h:
            x = x * np.uint64(0x9E3779B97F4A7C15) + v
    for shift, by in ((33, 0xFF51AFD7ED558CCD), (33, 0xC4CEB9FE1A85EC53)):
        x ^= x >> np.uint64(shift)
        x *= np.uint64(by)
    x ^= x >> np.uint64(33)
    return np.unique(x)


def least_overlap(n: int | np.ndarray, percent: int):
    """Fewest shingles that a set of n shares with any partner."""
    return -(-percent * n // 100)


def _profile(width: int):
    """Per row its set's size, digest and profile; at the end of the task its share of the frequency sketch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        sketch = np.zeros(1 << SKETCH_BITS, np.uint32)
        names = ["doc_id", "n", "sig", "profile", "block", "counts"]
        types = [pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int32()), pa.int32(), pa.binary()]

        def out(*cols: object) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=names)

        for batch in batches:
            ids = batch.column("doc_id").to_pylist()
            ns, sigs, profiles, index = [], [], [], []
            for text in batch.column("text"):
                x = shingle_hashes(text.as_py(), width)
                ns.append(len(x))
                sigs.append(xxhash.xxh3_128_digest(x.tobytes()) if len(x) else None)
                profiles.append(np.bincount((x & np.uint64(CELLS - 1)).astype(np.int64), minlength=CELLS) if len(x) else None)
                index.append((x >> np.uint64(64 - SKETCH_BITS)).astype(np.int32))
                if sum(map(len, index[-64:])) > 1 << 20 or len(index) >= 4096:
                    sketch += np.bincount(np.concatenate(index), minlength=len(sketch)).astype(np.uint32)
                    index = []
            if index:
                sketch += np.bincount(np.concatenate(index), minlength=len(sketch)).astype(np.uint32)
            yield out(ids, ns, sigs, profiles, [None] * len(ids), [None] * len(ids))
        for b in range(0, len(sketch), SKETCH_BLOCK):
            part = sketch[b : b + SKETCH_BLOCK]
            if part.any():
                yield out([None], [None], [None], [None], [b // SKETCH_BLOCK], [zlib.compress(part.tobytes(), 1)])

    return run


def _sum_blocks(key: tuple, parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(SKETCH_BLOCK, np.uint64)
    for batch in parts:
        for raw in batch.column("counts").to_pylist():
            total += np.frombuffer(zlib.decompress(raw), np.uint32)
    packed = np.minimum(np.log2(total + 1.0) * CLASS_STEPS, LAST_CLASS - 1).astype(np.uint16)
    yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([packed.tobytes()], pa.binary())], names=["block", "classes"])


def frequency_classes(profiled: DataFrame) -> np.ndarray:
    """Frequency class of every counter of the sketch, by logarithm: always 2 ** SKETCH_BITS numbers of 2 bytes."""
    rows = profiled.where("block is not null").select("block", "counts").groupBy("block").applyInArrow(_sum_blocks, "block int, classes binary").collect()
    out = np.zeros(1 << SKETCH_BITS, np.uint16)
    for r in rows:
        out[r["block"] * SKETCH_BLOCK : (r["block"] + 1) * SKETCH_BLOCK] = np.frombuffer(r["classes"], np.uint16)
    return out


def _prefix(width: int, percent: int, classes, heavy: np.ndarray) -> object:
    last = np.uint64(LAST_CLASS << CLASS_AT)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh3_128_intdigest

        order = classes.value
        seen: set[int] = set()
        for batch in batches:
            tokens, ids, ns, places = [], [], [], []

            def out() -> pa.RecordBatch:
                return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x) if x else np.zeros(0, t), k) for x, t, k in ((tokens, np.int64, pa.int64()), (ids, np.int64, pa.int64()), (ns, np.int32, pa.int32()), (places, np.int32, pa.int32()))], names=["token", "doc_id", "n", "pos"])

            held = 0
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                x = shingle_hashes(text.as_py(), width)
                n = len(x)
                if n == 0 or doc_id is None:
                    continue
                whole = xxh3_128_intdigest(x.tobytes())
                if whole in seen:
                    continue  # an equal set of this task stands for it; their digests link them
                if len(seen) < 100_000:
                    seen.add(whole)
                p = n - least_overlap(n, percent) + 1
                # the global order: rare first by the sketch, then by hash; a token's key is its place in it
                key = (order[(x >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)].astype(np.uint64) << np.uint64(CLASS_AT)) | (x & np.uint64((1 << CLASS_AT) - 1))
                if len(heavy):
                    key = np.where(heavy[np.minimum(np.searchsorted(heavy, key), len(heavy) - 1)] == key, key | last, key)
                key = np.sort(np.partition(key, p - 1)[:p] if p < n else key)
                tokens.append(key.astype(np.int64))
                ids.append(np.full(p, doc_id, np.int64))
                ns.append(np.full(p, n, np.int32))
                places.append(np.arange(p, dtype=np.int32))
                held += p
                if held > 200_000:
                    yield out()
                    tokens, ids, ns, places, held = [], [], [], [], 0
            if held:
                yield out()

    return run


def _verify(width: int, percent: int):
    """Whether the shingle sets, of whole words, link. Rows come sorted by (a, chunk, b), those of a itself (b null) first: its sets are built once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, mine = None, []
        for batch in batches:
            out: list[tuple[int, int, bool]] = []
            for a, chunk, b, text in zip(*(batch.column(c).to_pylist() for c in ("a", "chunk", "b")), batch.column("text"), strict=True):
                if (a, chunk) != now:
                    now, mine = (a, chunk), []
                other = shingles_of(text.as_py(), width)
                if b is None:
                    mine.append(other)
                    continue
                linked = False
                for x in mine:
                    both = len(x & other)
                    linked |= both > 0 and 100 * both >= percent * (len(x) + len(other) - both)
                out.append((a, b, linked))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.bool_()))], names=["a", "b", "linked"])

    return run


def _fits(n1: Column, p1: Column, n2: Column, p2: Column, percent: int) -> Column:
    """Length and positional filter: could sets of n1 and n2 with their first common token at p1 and p2 link?"""
    small, large = F.least(n1, n2), F.greatest(n1, n2)
    most = 1 + F.least(n1 - p1, n2 - p2) - 1
    return (small * 100 >= large * percent) & (most * (100 + percent) >= (n1 + n2) * percent)


def _pair(x: str, y: str) -> tuple[Column, Column]:
    """(a, b) of two documents given as structs: a is the smaller set, as first rows of posting lists are, so that a document in very many pairs tends to be a."""
    one, two = (F.struct(F.col(f"{s}.n"), F.col(f"{s}.doc_id")) for s in (x, y))
    return F.least(one, two)["doc_id"].alias("a"), F.greatest(one, two)["doc_id"].alias("b")


class NgramJoin:
    """The join over one table of documents; see link_documents()."""

    def __init__(self, docs: DataFrame, width: int, percent: int, *, broadcast_ids: int, list_rows: int, block_rows: int, chunk_pairs: int):
        self.width, self.percent, self.broadcast_ids = width, percent, broadcast_ids
        self.list_rows, self.block_rows, self.chunk_pairs = list_rows, block_rows, chunk_pairs
        self.docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
        spark = docs.sparkSession
        self.profiled = cut(self.docs.mapInArrow(_profile(width), PROFILED))
        self.classes = spark.sparkContext.broadcast(frequency_classes(self.profiled))
        self.sets = self.profiled.where("block is null").select("doc_id", "n", "sig", "profile")
        self.heavy = np.zeros(0, np.uint64)

    def prefixes(self) -> DataFrame:
        """(token, doc_id, n, pos) of all tokens in prefixes."""
        return self.docs.mapInArrow(_prefix(self.width, self.percent, self.classes, self.heavy), PREFIXES)

    def same_sets(self) -> DataFrame:
        """Edges from every document to the first with just its set."""
        s = self.sets.where("n > 0 and doc_id is not null").select("sig", "doc_id").distinct()
        first = s.groupBy("sig").agg(F.min("doc_id").alias("a"), F.count(F.lit(1)).alias("c")).where("c > 1")
        return s.join(first.drop("c"), "sig").where("a <> doc_id").select("a", F.col("doc_id").alias("b"))

    def suffix_filtered(self, pairs: DataFrame) -> DataFrame:
        """Pairs (a, b) that the suffix filter leaves.

        Both sets are cut into CELLS parts at the same places of the hash order; the sum of the parts' differences in
        number bounds the sets' symmetric difference from below, and linked sets differ in few. The bound is taken over
        whole sets, prefixes included, so one short profile a document serves all its pairs.
        """
        s = self.sets.where("n > 0 and doc_id is not null").groupBy("doc_id").agg(F.first("n").alias("n"), F.first("profile").alias("profile"), F.count(F.lit(1)).alias("rows"))
        a = s.select(F.col("doc_id").alias("a"), F.col("n").alias("na"), F.col("profile").alias("pa"), F.col("rows").alias("ra"))
        b = s.select(F.col("doc_id").alias("b"), F.col("n").alias("nb"), F.col("profile").alias("pb"), F.col("rows").alias("rb"))
        differ = F.aggregate(F.zip_with("pa", "pb", lambda x, y: F.abs(x - y)), F.lit(0), lambda acc, x: acc + x)
        # 100 i >= percent (na + nb - i) leaves na + nb - 2 i <= (na + nb) (100 - percent) / (100 + percent)
        passes = (F.col("ra") > 1) | (F.col("rb") > 1) | (differ * (100 + self.percent) <= (F.col("na") + F.col("nb")) * (100 - self.percent))
        return pairs.join(a, "a").join(b, "b").where(passes).select("a", "b")

    def verified(self, pairs: DataFrame) -> DataFrame:
        """(a, b, linked) of distinct pairs, from the texts of the documents that occur in them.

        The pairs of one a are cut into chunks of about chunk_pairs; a's text goes to each chunk once.
        """
        pairs = cut(pairs)
        salts = math.isqrt(pairs.count()) + 1
        salted = pairs.withColumn("s", F.pmod(F.xxhash64("b"), F.lit(salts)))
        degrees = salted.groupBy("a", "s").count().select("a", "s", F.sum("count").over(W.partitionBy("a")).alias("degree"))
        pairs = cut(salted.join(degrees, ["a", "s"]).select("a", "b", F.pmod(F.xxhash64("b", F.lit(1)), F.ceil(F.col("degree") / self.chunk_pairs)).alias("chunk")))
        ids = cut(pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct())
        few = ids.count() <= self.broadcast_ids
        texts = self.docs.join(F.broadcast(ids) if few else ids, "doc_id", "left_semi")
        own = pairs.select(F.col("a").alias("doc_id"), "chunk").distinct().join(texts, "doc_id").select(F.col("doc_id").alias("a"), "chunk", F.lit(None).cast("long").alias("b"), "text")
        others = pairs.join(texts.withColumnRenamed("doc_id", "b"), "b").select("a", "chunk", "b", "text")
        met = own.union(others).repartition("a", "chunk").sortWithinPartitions("a", "chunk", F.col("b").asc_nulls_first())
        out = met.mapInArrow(_verify(self.width, self.percent), "a bigint, b bigint, linked boolean")
        return cut(out.groupBy("a", "b").agg(F.max("linked").alias("linked")))

    def posting_lists(self, folder: str) -> DataFrame:
        """Rows of the tokens that stand in two prefixes at least: token, me, chain (the row before) and hub (the first row), by place in the prefix.

        Lists that the sketch takes for longer than list_rows are cut into sublists by a salt; these have chains and hubs of their
        own, and their first rows make a list that links them. The sketch never takes a list for shorter than it is.
        """
        spark = self.docs.sparkSession
        me = F.struct("doc_id", "n", "pos")
        estimate = F.pow(F.lit(2.0), F.shiftright("token", CLASS_AT) / float(CLASS_STEPS))
        rows = self.prefixes().select("token", me.alias("me"), F.least(F.ceil(estimate / self.list_rows), F.lit(10_000)).cast("int").alias("parts"))
        rows = rows.withColumn("salt", F.when(F.col("parts") > 1, F.pmod(F.xxhash64("me.doc_id"), F.col("parts"))).otherwise(0).cast("int"))
        order = [F.col("me.pos"), F.col("me.n"), F.col("me.doc_id")]

        def linked(df: DataFrame, *by: str) -> DataFrame:
            lists = W.partitionBy(*by).orderBy(*order)
            return df.select("token", "parts", "me", F.lag("me").over(lists).alias("chain"), F.lead("me").over(lists).isNotNull().alias("after"), F.first("me").over(lists.rowsBetween(W.unboundedPreceding, 0)).alias("hub"))

        # most tokens are in one prefix only: the texts are gone through once for the others
        linked(rows, "token", "salt").where("chain is not null or after or parts > 1").write.parquet(f"{folder}/lists")
        held = spark.read.parquet(f"{folder}/lists")
        heads = held.where("parts > 1 and chain is null")
        linked(heads.select("token", "parts", F.struct("me.*", "after").alias("me")), "token").where("chain is not null or after or me.after").write.parquet(f"{folder}/heads")
        heads = spark.read.parquet(f"{folder}/heads")
        bare = lambda c: F.when(F.col(c).isNotNull(), F.struct(f"{c}.doc_id", f"{c}.n", f"{c}.pos")).alias(c)
        return held.where("parts = 1 or chain is not null").select("token", "me", "chain", "hub").unionByName(heads.select("token", bare("me"), bare("chain"), bare("hub")))

    def open_pairs(self, own: DataFrame, reached: DataFrame) -> tuple[DataFrame, DataFrame]:
        """(lists, rows) of the posting lists that hold several components: token with the number of pairs, and their rows with component c."""
        rows = own.select("token", "me.*")
        labelled = rows.join(reached.withColumnRenamed("node", "doc_id"), "doc_id", "left").withColumn("c", F.coalesce("component", "doc_id")).drop("component")
        kinds = labelled.groupBy("token", "c").agg(F.count(F.lit(1)).alias("k"))
        lists = kinds.groupBy("token").agg(F.count(F.lit(1)).alias("kinds"), F.sum("k").alias("rows"), F.sum(F.col("k").cast("double") * F.col("k")).alias("squares")).where("kinds > 1")
        lists = cut(lists.select("token", "rows", ((F.col("rows").cast("double") * F.col("rows") - F.col("squares")) / 2).alias("pairs")))
        return lists, labelled

    def pairs_of_lists(self, lists: DataFrame, labelled: DataFrame) -> DataFrame:
        """Pairs of one list and different components, in blocks: a list of m blocks is m (m + 1) / 2 keys of the join."""
        rest = labelled.join(lists.select("token", F.ceil(F.col("rows") / self.block_rows).cast("int").alias("m")), "token")
        rest = rest.withColumn("block", F.pmod(F.xxhash64("doc_id"), F.col("m")).cast("int"))
        others = F.transform(F.sequence(F.lit(0), F.col("m") - 1), lambda o: F.struct(F.least("block", o).alias("i"), F.greatest("block", o).alias("j")))
        rest = cut(rest.select("token", F.struct("doc_id", "n", "pos", "c").alias("me"), "block", F.explode(others).alias("o")).select("token", "me", "block", "o.i", "o.j"))
        x, y = rest.where("block = i").alias("x"), rest.where("block = j").select("token", "i", "j", F.col("me").alias("o")).alias("y")
        both = x.join(y, ["token", "i", "j"]).where("me.c <> o.c and (i < j or me.doc_id < o.doc_id)")
        return both.where(_fits(F.col("me.n"), F.col("me.pos"), F.col("o.n"), F.col("o.pos"), self.percent)).select(*_pair("me", "o")).distinct()

    def components(self, heavy_pairs: float, most_heavy: int, rounds: int = 3) -> DataFrame:
        """(node, component) of all documents that are linked to another one."""
        spark = self.docs.sparkSession
        edges, tried = cut(self.same_sets()), None
        for k in range(rounds):
            folder = new_folder(spark, "postings")
            own = self.posting_lists(folder)
            first = own.where("chain is not null").select("me", F.explode(F.array_distinct(F.array("chain", "hub"))).alias("o"))
            first = first.where((F.col("me.doc_id") != F.col("o.doc_id")) & _fits(F.col("me.n"), F.col("me.pos"), F.col("o.n"), F.col("o.pos"), self.percent)).select(*_pair("me", "o")).distinct()
            checked = self.verified(self.suffix_filtered(first if tried is None else first.join(tried, ["a", "b"], "left_anti")))
            tried = checked.select("a", "b") if tried is None else tried.union(checked.select("a", "b"))
            edges = edges.union(checked.where("linked").select("a", "b"))
            reached = cut(connected_components(edges))
            # what is left: pairs of one posting list that nothing has joined yet, each looked at once
            lists, labelled = self.open_pairs(own, reached)
            # tokens of many unlinked documents, a passage that they share, go to the end of the order and so out of most prefixes
            worst = [] if k == rounds - 1 else lists.where(F.col("pairs") > heavy_pairs).orderBy(F.desc("pairs"), "token").limit(most_heavy).collect()
            if not worst:
                break
            found = np.array([r["token"] for r in worst], np.uint64)
            found = found[(found >> np.uint64(CLASS_AT)) < LAST_CLASS]
            if not len(found):
                break
            self.heavy = np.unique(np.concatenate([self.heavy, found]))
            delete_folder(spark, folder)
        second = self.pairs_of_lists(lists, labelled).join(tried, ["a", "b"], "left_anti")
        more = self.verified(self.suffix_filtered(second)).where("linked").select("a", "b")
        out = cut(connected_components(reached.select(F.col("component").alias("a"), F.col("node").alias("b")).union(more)))
        delete_folder(spark, folder)
        return out


def link_documents(
    docs: DataFrame, *, width: int = 5, percent: int = 80, broadcast_ids: int = 500_000, list_rows: int = 100_000, block_rows: int = 1000, chunk_pairs: int = 256, heavy_pairs: float = 1e7, most_heavy: int = 500_000
) -> DataFrame:
    """Classes of near-duplicate documents: (doc_id, n_shingles, component_id), a row for each row of docs (doc_id, text).

    Two documents link when 100 * common shingles >= percent * shingles of both; component_id is the smallest
    doc_id that links reach. No link between components is lost, and pairs within one are left out as far as
    possible: equal sets meet by digest, and each posting list of a prefix token first links its neighbours
    and its first document (a chain and a star, linear in its length; long lists in sublists of about list_rows); only pairs of a list that are still in
    different components are then listed, in blocks of block_rows. A pair is verified once, on the words of both texts.

    The order of tokens is rare first by a count sketch of fixed size over all documents. Tokens whose list is left with more than
    heavy_pairs such pairs (at most most_heavy of them, some MB) are then put last, by their exact number, and prefixes are taken
    anew. Any order gives right results, so the sizes of the sketch and of that list bear on speed only. The
    texts of documents in candidate pairs are found by a broadcast of their ids if there are at most
    broadcast_ids, else by a join.

    Documents without words or text have an empty set, n_shingles 0 and their own id as component. Texts of any length are taken whole. Rows
    that share a doc_id are one node with the links of all. Rows with a null doc_id keep their n_shingles, and
    link with nothing: component_id null. Other columns are left out. An empty table gives an empty table.
    """
    join = NgramJoin(docs, width, percent, broadcast_ids=broadcast_ids, list_rows=list_rows, block_rows=block_rows, chunk_pairs=chunk_pairs)
    c = join.components(heavy_pairs, most_heavy)
    out = join.sets.join(c.withColumnRenamed("node", "doc_id"), "doc_id", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"))


def one_of_each(docs: DataFrame, *, width: int = 5, percent: int = 80) -> DataFrame:
    """The rows of docs that stay when one document of each class does: that with the smallest doc_id, once.

    Rows that share a doc_id are one document: of them the first by text stays. Rows with a null doc_id stay.
    """
    linked = link_documents(docs.select("doc_id", "text"), width=width, percent=percent)
    gone = linked.where("component_id < doc_id").select("doc_id").distinct()
    held = docs.join(gone, "doc_id", "left_anti").select(docs.columns)
    once = W.partitionBy("doc_id").orderBy("text")
    return held.withColumn("__n", F.row_number().over(once)).where("__n = 1 or doc_id is null").drop("__n")
