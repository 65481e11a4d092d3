"""N-gram Jaccard join: components of documents whose shingle sets are similar, without making all pairs of a group.

1. Each text, once, becomes its set of shingle hashes; equal sets become one node. Only nodes go on.
2. A node emits numbers (shingles.Classes) of which any two similar sets share several; numbers of one node alone drop out,
   and of the others the commonest of each node, as many as similar sets can spare, and with them nearly all documents.
3. Each node that is left goes, with its set, to the block of a head: of the least nodes of its numbers, the one that it shares
   most numbers with. Within a block a T-occurrence search (shingles.Search) links similar sets. A large block is dealt over
   shards, bounded in nodes and in hashes, that all hold its head.
4. A number is settled when its nodes have one component or were searched in one place. The others join nodes to clusters, a
   kind of numbers at a time, and each cluster is searched: the nodes outside its largest component as queries against all
   its nodes, in tiles of bounded size. A cluster of up to TILE nodes is one tile, which holds each set once.
5. Links become components; a document's component is the least doc_id of its nodes'.

Every link is found: similar sets share a number, and in the end each number's nodes are in one component, or were
searched against one another.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import Scratch, give_back, runs, text_buffers
from .shingles import Classes, Search, set_digest, shingle_sets

#: Nodes of a shard or of one side of a tile, and hashes in their sets.
TILE, TILE_HASHES = 4_096, 2_000_000
#: Bit maps have 32 bits a key, up to so many bits; beyond, they let more rows through to the exact joins behind them.
FILTER_BITS = 1 << 27
#: Numbers that meet in one task.
BUCKET = 1_000_000
#: Bits of a spot that are sent; the others tell its bucket.
SPOT_BITS = 32
#: Bytes of numbers that are handled at once.
NUMBER_BYTES = 8_000_000
#: A number's low bits tell its kind, so the others deal it out.
KIND_BITS = Classes.NEED_BITS + Classes.CLASS_BITS
LINKS = "a long, b long"


def fingerprints(texts: DataFrame, words: int, num: int, den: int, without: BitMap | None = None) -> DataFrame:
    """key, n_shingles, node (equal for equal sets, null for an empty one) and numbers (see _packed) of rows (key, text)
    whose keys are not in the bit map."""

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classes = Classes(num, den)
        for batch in without.filter("key", False)(batches) if without else batches:
            for run in runs(batch, "text"):
                sets = shingle_sets(run.column("text"), words)
                nodes, numbers = [set_digest(x) if len(x) else None for x in sets], [_packed(classes.numbers(x)) for x in sets]
                columns = [run.column("key"), pa.array([len(x) for x in sets], pa.int64()), pa.array(nodes, pa.int64()), pa.array(numbers, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["key", "n_shingles", "node", "numbers"])
        give_back()

    return texts.select("key", "text").mapInArrow(take, "key long, n_shingles long, node long, numbers binary")


def _links(words: int, num: int, den: int):
    def search(block: pa.Table) -> pa.Table:
        """What the links in one block join, as stars around the least node; nodes of one label count as linked already.

        A row whose text has another node drops out: of texts with one key, the one that was read again need not be the node's.
        """
        size, own = block.nbytes, {}
        for batch in block.to_batches():
            for run in runs(batch, "text"):
                for node, label, x in zip(run.column("node").to_pylist(), run.column("label").to_pylist(), shingle_sets(run.column("text"), words), strict=True):
                    if node not in own and len(x) and set_digest(x) == node:
                        own[node] = label, x
        del block
        nodes = sorted(own)
        found = Search([own[n][1] for n in nodes], num, den).forest([own[n][0] for n in nodes]) if len(nodes) > 1 else []
        root = {x: x for link in found for x in link}

        def top(i: int) -> int:
            while root[i] != i:
                root[i] = i = root[root[i]]
            return i

        for i, j in found:
            i, j = top(i), top(j)
            root[max(i, j)] = min(i, j)
        ends = [(i, top(i)) for i in root if top(i) != i]
        if size > 1 << 20:
            own.clear()
            give_back()
        return pa.table({"a": pa.array([nodes[i] for i, _ in ends], pa.int64()), "b": pa.array([nodes[j] for _, j in ends], pa.int64())})

    return search


def components(links: DataFrame, scratch: Scratch) -> DataFrame:
    """node and label (the least node joined with it) of every node in links (a, b): alternating large and small stars.

    Each round joins the links with a minimum for each node, and is cut; the rounds are about the logarithm of the longest
    chain, and links that are stars already take none. Nothing of it comes to the driver but a yes or no.
    """
    stars = scratch.cut(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    while True:
        ends = stars.select(F.col("u").alias("x"), F.lit(1).alias("up")).unionByName(stars.select(F.col("v").alias("x"), F.lit(0).alias("up")))
        if ends.groupBy("x").agg(F.sum("up").alias("n"), F.min("up").alias("low")).where("n > 1 or n > 0 and low = 0").isEmpty():
            return stars.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(stars.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())
        old = stars
        both = stars.unionByName(stars.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("x"), F.least("u", "m").alias("m"))
        large = both.join(least, both["u"] == least["x"]).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("x"), "m")
        small = large.join(least, large["u"] == least["x"]).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        stars = scratch.cut(small.unionByName(least.select(F.col("x").alias("u"), F.col("m").alias("v"))).where("u <> v").distinct())
        scratch.drop(old)


def text_key() -> F.Column:
    """A hash of the text: what a text is found by again. Ids may be null or repeated."""
    return F.xxhash64(F.col("text").cast("string"))


def text_prints(docs: DataFrame, ids: DataFrame, words: int, num: int, den: int) -> DataFrame:
    """fingerprints of the texts of docs (key, text), once for each key. Only texts that a bit map shows to be repeated are sent
    anywhere, once for each task."""
    repeated = BitMap(ids.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key"))
    several = docs.select("key", "text").mapInArrow(repeated.filter("key"), "key long, text string").groupBy("key").agg(F.first("text").alias("text"))
    return fingerprints(docs, words, num, den, repeated).unionByName(fingerprints(several, words, num, den))


def near_nodes(docs: DataFrame, words: int, num: int, den: int, scratch: Scratch) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(doc_id and key of each row of docs; key, n_shingles and node of each text; node and label of every node that is linked)."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), text_key().alias("key"))
    ids = scratch.cut(docs.select("doc_id", "key"))
    prints = scratch.cut(text_prints(docs, ids, words, num, den))
    rows = repeated_rows(prints, scratch)
    slim = scratch.cut(prints.drop("numbers"))
    scratch.drop(prints)
    return ids, slim, component_labels(docs, slim, shared_numbers(rows, scratch), words, num, den, scratch)


def near_groups(docs: DataFrame, words: int = 5, num: int = 4, den: int = 5) -> DataFrame:
    """doc_id, n_shingles and component_id of every row of docs (doc_id, text).

    Two documents link if den x intersection >= num x union of their sets of distinct runs of ``words`` words (ASCII blanks
    separate words, A-Z count as a-z; the whole sequence if it has fewer words). Null text and text without words have no
    shingles and link with nothing: their component is their own doc_id. A null doc_id takes part, and gets the least doc_id
    of its component if there is one. Rows that repeat a doc_id are documents of their own. An empty table gives an empty
    result. Other columns are ignored.
    """
    ids, prints, labels = near_nodes(docs, words, num, den, Scratch(docs.sparkSession))
    least = ids.groupBy("key").agg(F.min("doc_id").alias("first"))
    texts = prints.join(least, "key").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    named = texts.where("label is not null").groupBy("label").agg(F.min("first").alias("component_id"))
    texts = texts.join(named, "label", "left").select("key", "n_shingles", "component_id")
    return ids.join(texts, "key").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


class BitMap:
    """A broadcast bit map in which the places of all keys (one column of long numbers, mixed above so many bits) are set.

    Its size follows their number up to FILTER_BITS, so it is bounded whatever the input.
    """

    def __init__(self, keys: DataFrame, above: int = KIND_BITS):
        wanted, bits = 32 * keys.count(), 1 << 16
        while bits < min(wanted, FILTER_BITS):
            bits *= 2
        spots = keys.select(F.expr(f"pmod(shiftright({keys.columns[0]}, {above}), {bits}L)").alias("at"))

        def fill(part: pa.Table) -> pa.Table:
            at = part["at"].to_numpy()
            own = np.zeros(1 << 16, bool)
            own[at & 0xFFFF] = True
            return pa.table({"part": pa.array([int(at[0]) >> 16], pa.int64()), "bits": pa.array([np.packbits(own, bitorder="little").tobytes()], pa.binary())})

        parts = spots.groupBy(F.expr("shiftright(at, 16)")).applyInArrow(lambda part: fill(part), "part long, bits binary").toArrow()
        filled = np.zeros(bits // 8, np.uint8)
        for k, own in zip(parts["part"].to_pylist(), parts["bits"].to_pylist(), strict=True):
            filled[k << 13 : (k + 1) << 13] = np.frombuffer(own, np.uint8)
        self.above, self.bits, self.shared = above, bits, keys.sparkSession.sparkContext.broadcast(filled)

    def __getstate__(self):
        return self.above, self.bits, self.shared

    def __setstate__(self, state):
        self.above, self.bits, self.shared = state

    def filter(self, column: str, inside: bool = True):
        """For mapInArrow: the rows whose key may be in it, or those whose key isn't."""

        def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield batch.filter(pa.array(self.among(batch.column(column).to_numpy()) == inside))
            give_back()

        return keep

    def among(self, keys: np.ndarray) -> np.ndarray:
        """Which of these keys may be in it; no key of it is ever missed."""
        at = keys >> self.above & (self.bits - 1)
        return self.shared.value[at >> 3] >> (at & 7).astype(np.uint8) & 1 == 1


def _packed(numbers: np.ndarray) -> bytes:
    """The first bytes of all numbers, then the second ones, and so on, so that those which hardly differ compress."""
    return numbers.view(np.uint8).reshape(-1, 8).T.tobytes()


def _flat(run: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """All numbers of a batch's rows, and the row of each."""
    raw, places = text_buffers(run.column("numbers"))
    out = np.empty((len(raw) // 8, 8), np.uint8)
    for a, b in zip(places[:-1].tolist(), places[1:].tolist(), strict=True):
        out[a // 8 : b // 8] = raw[a:b].reshape(8, -1).T
    return out.view(np.int64).reshape(-1), np.repeat(np.arange(run.num_rows), np.diff(places) // 8)


def repeated_spots(prints: DataFrame) -> tuple[DataFrame, int]:
    """spot, the SPOT_BITS and more low bits above a number's kind, of every number that more than one node may emit, and how
    many bits it has: all that occur in two runs of rows, or for two nodes of a run.

    Spots travel in blocks, a block for each run and bucket and each spot at most twice in it, so one that very many nodes
    emit is as light as any other, and there is no row for each number. The bucket holds a spot's low bits, so four bytes of
    it are sent; so many buckets that of numbers that differ few share a spot, and those only go on to the next step.
    """
    rows = prints.where("node is not null and length(numbers) > 0").select("node", "numbers")
    total = (rows.agg(F.sum(F.length("numbers"))).first()[0] or 0) // 8
    low = max(3, (total // BUCKET).bit_length())

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for run in runs(batch, "numbers", NUMBER_BYTES):
                first = list({node: i for i, node in enumerate(run.column("node").to_pylist())}.values())
                spots, counts = np.unique(_spots(_flat(run.take(pa.array(first)))[0], low + SPOT_BITS), return_counts=True)
                spots = np.repeat(spots, np.minimum(counts, 2))
                bucket = spots & (1 << low) - 1
                order = np.argsort(bucket, kind="stable")
                spots, bucket = (spots[order] >> low).astype(np.uint32), bucket[order]
                starts = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1]))
                blocks = [x.tobytes() for x in np.split(spots, starts[1:])]
                yield pa.RecordBatch.from_arrays([pa.array(bucket[starts]), pa.array(blocks, pa.binary())], ["bucket", "block"])
        give_back()

    def again(group: pa.Table) -> pa.Table:
        bucket = group["bucket"][0].as_py()
        spots = np.sort(np.concatenate([np.frombuffer(x.as_buffer(), np.uint32) for x in group["block"]]))
        spots = np.unique(spots[1:][spots[1:] == spots[:-1]])
        give_back()
        return pa.table({"spot": pa.array(spots.astype(np.int64) << low | bucket, pa.int64())})

    return rows.mapInArrow(deal, "bucket long, block binary").groupBy("bucket").applyInArrow(again, "spot long"), low + SPOT_BITS


def _spots(numbers: np.ndarray, bits: int) -> np.ndarray:
    return numbers >> KIND_BITS & (1 << bits) - 1


def _kind() -> F.Column:
    """The class that a number is for, and its need."""
    return F.col("number").bitwiseAND(F.lit((1 << KIND_BITS) - 1)).alias("kind")


def _need() -> F.Column:
    """How many numbers of a kind similar sets share at least."""
    return (F.col("number").bitwiseAND(F.lit((1 << Classes.NEED_BITS) - 1)) * 2 - 1).alias("need")


def repeated_rows(prints: DataFrame, scratch: Scratch) -> DataFrame:
    """(number, node) of the numbers that more than one node may emit."""
    found, bits = repeated_spots(prints)
    repeated = scratch.cut(found)
    likely = BitMap(repeated, 0)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for run in runs(batch, "numbers", NUMBER_BYTES):
                numbers, row = _flat(run)
                spots = _spots(numbers, bits)
                found = likely.among(spots)
                yield pa.RecordBatch.from_arrays([pa.array(spots[found]), pa.array(numbers[found]), run.column("node").take(pa.array(row[found]))], ["spot", "number", "node"])
        give_back()

    rows = prints.where("node is not null and length(numbers) > 0").select("node", "numbers").mapInArrow(keep, "spot long, number long, node long")
    rows = scratch.cut(rows.join(repeated, "spot").select("number", "node"))
    scratch.drop(repeated)
    return rows


def shared_numbers(rows: DataFrame, scratch: Scratch) -> DataFrame:
    """The rows (number, node), once each, of numbers that two nodes emit, without those that a node can do without.

    Similar sets share ``need`` numbers of a kind. The rarest of these comes before the others in both, so each node gives up
    the need - 1 commonest of its numbers of a kind, and similar sets still share one. What many sets hold goes that way.
    """
    several = rows.groupBy("number").agg(F.min("node").alias("l"), F.max("node").alias("m"), F.count("*").alias("holders")).where("l <> m").select("number", "holders")
    common = F.dense_rank().over(Window.partitionBy("node", "kind").orderBy(F.desc("holders"), "number"))
    left = scratch.cut(rows.join(several, "number").withColumn("kind", _kind()).withColumn("rank", common).where(F.col("rank") >= _need()).select("number", "node").distinct())
    scratch.drop(rows)
    several = left.groupBy("number").agg(F.min("node").alias("l"), F.max("node").alias("m")).where("l <> m").select("number")
    kept = scratch.cut(left.join(several, "number"))
    scratch.drop(left)
    return kept


def member_texts(docs: DataFrame, prints: DataFrame, members: DataFrame, scratch: Scratch) -> DataFrame:
    """node, n (hashes in its set) and text of each member: one text for each, read again by its key.

    A bit map keeps most other texts out of the join; where it is too small it lets more through. A text takes less room than
    its set, which is made again where it is searched.
    """
    reps = prints.where("node is not null").groupBy("node").agg(F.min("key").alias("rep"), F.first("n_shingles").alias("n"))
    wanted = scratch.cut(reps.join(members, "node"))
    # Aggregated before it is sent, a text that very many rows hold is as light as any other.
    rows = docs.where("text is not null").select("key", "text")
    texts = rows.mapInArrow(BitMap(wanted.select("rep")).filter("key"), rows.schema).groupBy("key").agg(F.first("text").alias("text"))
    found = scratch.cut(texts.join(wanted, texts["key"] == wanted["rep"]).select("node", "n", "text"))
    scratch.drop(wanted)
    return found


def _shards(n: str, hashes: str) -> F.Column:
    """Shards of so many nodes with so many hashes in all."""
    return F.greatest(F.lit(1), F.ceil(F.col(n) / TILE), F.ceil(F.col(hashes) / TILE_HASHES)).cast("long")


def component_labels(docs: DataFrame, prints: DataFrame, shared: DataFrame, words: int, num: int, den: int, scratch: Scratch) -> DataFrame:
    """node and label of every node that is linked with another."""
    sets = member_texts(docs, prints, shared.select("node").distinct(), scratch)
    sizes = sets.select("node", "n")
    # First, each node with the head that it shares most numbers with.
    least = shared.groupBy("number").agg(F.min("node").alias("least"))
    headed = scratch.cut(shared.join(least, "number"))
    scratch.drop(shared)
    plausible = headed.where("node <> least").groupBy("node", "least", _kind(), _need()).agg(F.count("*").alias("c")).where("2 * c >= need")
    chosen = plausible.groupBy("node").agg(F.max_by("least", F.struct("c", "least")).alias("block"))
    member = sizes.join(chosen, "node", "left").withColumn("block", F.coalesce("block", "node"))
    size = scratch.cut(member.groupBy("block").agg(F.count("*").alias("k"), F.sum("n").alias("h"), F.min("node").alias("one")).select("block", _shards("k", "h").alias("shards"), (F.expr("k > 1 or one <> block")).alias("several")))
    dealt = scratch.cut(member.join(size, "block").select("block", F.expr(f"pmod(xxhash64(node, {TILE}), shards)").alias("shard"), "node", "several"))
    heads = size.where("several").select("block", F.explode(F.expr("sequence(0L, shards - 1)")).alias("shard"), F.col("block").alias("node"))
    blocks = dealt.where("several").drop("several").unionByName(heads).distinct().join(sets.drop("n"), "node").withColumn("label", F.col("node"))
    found = scratch.cut(blocks.groupBy("block", "shard").applyInArrow(_links(words, num, den), LINKS))
    labels = scratch.cut(components(found, scratch))
    open_ = scratch.cut(unsettled(headed, dealt.drop("several"), labels))
    scratch.drop(headed, dealt, size)
    if open_.isEmpty():
        return labels
    # Then what may still be linked, by clusters of nodes that numbers of one kind join.
    ends = open_.select("number", "node", F.xxhash64("node", _kind()).alias("vertex"))
    least = ends.groupBy("number").agg(F.min("vertex").alias("b"))
    clusters = components(ends.join(least, "number").select(F.col("vertex").alias("a"), "b"), scratch).select(F.col("node").alias("vertex"), F.col("label").alias("cluster"))
    clusters = clusters.join(ends.select("vertex", "node").distinct(), "vertex")
    weight = scratch.cut(clusters.join(labels, "node", "left").select("cluster", "node", F.coalesce("label", "node").alias("label")).join(sizes, "node"))
    count = weight.groupBy("cluster", "label").agg(F.count("*").alias("k"), F.sum("n").alias("h"))
    largest = count.groupBy("cluster").agg(
        F.max_by("label", F.struct("k", "label")).alias("largest"), F.sum("k").alias("n"), F.sum("h").alias("h"), F.max("k").alias("top"), F.max_by("h", F.struct("k", "label")).alias("top_h"),
    ).where("n > top")
    tiles = largest.select("cluster", "largest", _shards("n", "h").alias("shards"), F.expr("n - top").alias("m"), F.expr("h - top_h").alias("g")).select("cluster", "largest", "shards", _shards("m", "g").alias("chunks"))
    group = weight.drop("n").join(tiles, "cluster")
    every = group.select("cluster", F.expr(f"pmod(xxhash64(node, {TILE}), shards)").alias("shard"), F.explode(F.expr("sequence(0L, chunks - 1)")).alias("chunk"), "node", "label")
    asking = group.where("label <> largest").select("cluster", F.explode(F.expr("sequence(0L, shards - 1)")).alias("shard"), F.expr(f"pmod(xxhash64(node, {TILE + 1}), chunks)").alias("chunk"), "node", "label")
    more = scratch.cut(every.unionByName(asking).distinct().join(sets.drop("n"), "node").groupBy("cluster", "shard", "chunk").applyInArrow(_links(words, num, den), LINKS))
    if not more.isEmpty():
        labels = scratch.cut(components(labels.select(F.col("node").alias("a"), F.col("label").alias("b")).unionByName(more), scratch))
    scratch.drop(sets, weight, open_)
    return labels


def unsettled(open_: DataFrame, dealt: DataFrame, labels: DataFrame) -> DataFrame:
    """(number, node) of the numbers whose nodes neither have one label nor were searched in one place.

    The least node of a number is in its own block's every shard, beside the place it was dealt to.
    """
    rows = open_.join(dealt, "node").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    place = F.struct("block", "shard")
    seen = rows.groupBy("number").agg(
        F.min("label").alias("l"), F.max("label").alias("m"),
        F.min(F.when(F.col("node") != F.col("least"), place)).alias("p"), F.max(F.when(F.col("node") != F.col("least"), place)).alias("q"),
        F.max(F.when(F.col("node") == F.col("least"), place)).alias("own"), F.first("least").alias("head"),
    )
    still = seen.where((F.col("l") != F.col("m")) & ~((F.col("p") == F.col("q")) & ((F.col("p.block") == F.col("head")) | (F.col("p") == F.col("own"))))).select("number")
    # Many numbers have the same nodes: one of them is enough.
    alike = open_.join(still, "number").groupBy("number").agg(F.count("*").alias("n"), *[F.sum(F.xxhash64("node", F.lit(k)).cast("decimal(38,0)")).alias(f"s{k}") for k in (0, 1)])
    return open_.join(alike.groupBy("n", "s0", "s1").agg(F.min("number").alias("number")).select("number"), "number").select("number", "node")


def one_of_each(docs: DataFrame, words: int = 5, num: int = 4, den: int = 5) -> DataFrame:
    """docs' rows, one of each component: one with the least doc_id, null ids last. Rows without words all stay.

    Texts decide, not ids: rows that repeat a doc_id, or have none, stay if their texts are in components of their own. Of rows
    that are alike in id and text, any one stays, the same in each run. Other columns, whatever their names, go along; an empty
    table gives an empty result. Rows that a bit map shows to be alone in their component, or first in it, pass at once; only
    the others are joined with the decision, one row for each text.
    """
    scratch, columns = Scratch(docs.sparkSession), docs.columns
    ids, prints, labels = near_nodes(docs, words, num, den, scratch)
    rows = ids.groupBy("key").agg(F.count("*").alias("n"), F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key")).alias("least"))
    texts = prints.where("node is not null").select("key", "node").join(rows, "key")
    named = texts.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    best = named.groupBy("label").agg(F.min("least").alias("best"))
    verdicts = named.join(best, "label").select("key", "n", (F.col("key") == F.col("best.key")).alias("wins"))
    open_ = scratch.cut(verdicts.where("n > 1 or not wins").select("key", "wins"))
    decided = BitMap(open_.select("key"))

    def part(wanted: bool) -> DataFrame:
        def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield batch.filter(pa.array((decided.among(batch.column("key").to_numpy()) & batch.column("worded").to_numpy(zero_copy_only=False)) == wanted))
            give_back()

        worded = F.coalesce(F.col("text").cast("string").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
        rows = docs.select(F.struct(*columns).alias("row"), text_key().alias("key"), worded.alias("worded"))
        return rows.mapInArrow(keep, rows.schema)

    # Aggregated before it is sent, a text that very many rows hold is as light as any other.
    order = F.struct(F.col("row.doc_id").isNull(), "row.doc_id", F.xxhash64("row"))
    some = part(True).groupBy("key").agg(F.min_by("row", order).alias("row")).join(open_, "key", "left").where("wins is null or wins")
    return part(False).select("row.*").unionByName(some.select("row.*"))


#: The rows of near_groups(documents, 3, 90, 100), by joining shingles; for tables whose doc_id is unique.
SQL = r"""
with recursive worded as (
  select doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') as t from documents),
cut as (
  select doc_id, case when len(t) >= 3 then list_distinct([t[i] || ' ' || t[i + 1] || ' ' || t[i + 2] for i in range(1, len(t) - 1)]) when len(t) > 0 then [array_to_string(t, ' ')] else [] end as g from worded),
shingle as (select doc_id, len(g) as n, unnest(g) as h from cut),
links as (
  select a.doc_id as x, b.doc_id as y from shingle a join shingle b on a.h = b.h and a.doc_id <> b.doc_id and 100 * a.n >= 90 * b.n and 100 * b.n >= 90 * a.n
  group by a.doc_id, b.doc_id, a.n, b.n having 100 * count(*) >= 90 * (a.n + b.n - count(*))),
reach as (select doc_id as x, doc_id as y from cut union select r.x, l.y from reach r join links l on l.x = r.y)
select c.doc_id, len(c.g) as n_shingles, min(r.y) as component_id from cut c join reach r on r.x = c.doc_id group by c.doc_id, c.g
"""
