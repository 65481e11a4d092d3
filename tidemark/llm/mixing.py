"""Mixing sources to target weights by balanced sampling (the cube method).

Each source gets a target; a document of a source is to be taken target / source size times, so its count is that
number rounded down or up. The fractional parts are inclusion probabilities. The flight phase moves them along directions
in the null space of the balancing constraints (tokens and documents), until each is 0 or 1 or as few as there are
constraints are left: the expected totals of both never change on the way. It runs within blocks of a source; what a
block leaves open goes to larger blocks, round by round, until a source has one block and at most a few
documents, whose landing tries every rounding and takes the one nearest the totals.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import cut

WEIGHTS = (3, 1, 2)
#: Documents of a block, on average.
BLOCK = 4_096
#: Documents that the landing settles by trying all their roundings, beside the two that a flight leaves.
LAND = 11
OPEN = "doc_id long, row_key long, size long, source_size long, target double, source_no int, p double, copies long, last boolean"
NAMES = [x.split()[0] for x in OPEN.split(", ")]


def targets(sizes: dict[str | None, int], weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, most: float = 2.0) -> dict[str | None, float]:
    """Targets by source: weights in code point order, null last, share all sizes times ``share``.

    A target stops at ``most`` times its source's size; the excess is shared again by weight among the others, until none
    is above. Where all stop, the rest stays unshared. A source of size 0 has target 0.
    """
    names = sorted((x for x in sizes if x is not None)) + [None] * (None in sizes)
    weight = {x: weights[i % len(weights)] for i, x in enumerate(names)}
    found: dict[str | None, float] = {}
    left = share * sum(sizes.values())
    while open_ := [x for x in names if x not in found]:
        unit = left / sum(weight[x] for x in open_)
        over = [x for x in open_ if unit * weight[x] >= most * sizes[x]]
        for x in over or open_:
            found[x] = most * sizes[x] if over else unit * weight[x]
        left -= sum(most * sizes[x] for x in over)
        if not over:
            break
    return found


def flight(p: np.ndarray, sizes: np.ndarray, rng: np.random.Generator, leave: int = 0) -> np.ndarray:
    """Moves probabilities until at most two, and ``leave`` that aren't touched, are strictly between 0 and 1.

    sum(p) and sum(p * sizes) stay as they are. Those left are near a half, a quarter and so on of the largest size, so that
    the landing can make up for nearly any rest.

    The fast form: three open documents at a time have a direction that both constraints send to 0; one of the two ends of
    the segment it spans is drawn so that expectations hold, which closes at least one document.
    """
    p, eps = p.astype(float).copy(), 1e-9
    scale = float(sizes.max()) or 1.0 if len(sizes) else 1.0
    z = sizes / scale
    between = np.flatnonzero((p > eps) & (p < 1 - eps))
    kept = set(between[[int(np.abs(sizes[between] - scale / 2**x).argmin()) for x in range(1, leave + 1)]]) if len(between) else ()
    waiting = iter([n for n in between if n not in kept])
    hand = list(itertools.islice(waiting, 3))
    draws = iter(rng.random(len(p) + 3))
    while len(hand) == 3:
        i, j, k = hand
        u = (z[j] - z[k], z[k] - z[i], z[i] - z[j])  # cross product of (1, 1, 1) and the sizes
        if abs(u[0]) + abs(u[1]) + abs(u[2]) < 1e-12:
            u = (1.0, -1.0, 0.0)
        up = down = np.inf
        for x, n in zip(u, hand, strict=True):
            if x > 0:
                up, down = min(up, (1 - p[n]) / x), min(down, p[n] / x)
            elif x < 0:
                up, down = min(up, -p[n] / x), min(down, -(1 - p[n]) / x)
        move = up if next(draws) * (up + down) < down else -down
        for x, n in zip(u, hand, strict=True):
            p[n] = min(1.0, max(0.0, p[n] + move * x))
        still = [n for n in hand if eps < p[n] < 1 - eps]
        for n in hand:
            if n not in still:
                p[n] = round(p[n])
        if len(still) == 3:  # rounding noise: close the nearest
            n = min(still, key=lambda n: min(p[n], 1 - p[n]))
            p[n] = round(p[n])
            still.remove(n)
        hand = still + list(itertools.islice(waiting, 3 - len(still)))
    return p


def landing(p: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Tries every rounding of the few probabilities that are left; the totals of tokens and documents stay nearest."""
    left = np.flatnonzero((p > 0) & (p < 1))
    if not len(left):
        return p
    tries = np.arange(1 << len(left))[:, None] >> np.arange(len(left)) & 1
    tokens, documents = np.abs((tries - p[left]) @ sizes[left]), np.abs((tries - p[left]).sum(1))
    p = p.copy()
    p[left] = tries[np.argmin(tokens + sizes[left].mean() * np.maximum(0, documents - 1))]
    return p


def settle(block: pa.Table) -> pa.Table:
    """One block of one source: the flight, and the landing where it is the source's only block."""
    block = block.select(NAMES).combine_chunks().sort_by([("size", "descending"), ("doc_id", "ascending"), ("row_key", "ascending")])
    sizes, p = block["size"].to_numpy().astype(float), block["p"].to_numpy()
    rng = np.random.default_rng([len(p), block["source_no"][0].as_py(), int(sizes.sum()) & 0xFFFFFFFF, pc.min(block["row_key"]).as_py() & 0xFFFFFFFF])
    last = block["last"][0].as_py()
    p = flight(p, sizes, rng, LAND if last else 0)
    p = landing(p, sizes) if last else p
    return block.set_column(NAMES.index("p"), "p", pa.array(p))


def sized(docs: DataFrame) -> DataFrame:
    """doc_id, source, row_key and size: runs of characters other than ASCII blanks; 0 for null."""
    text, source = F.col("text").cast("string"), F.col("source").cast("string")
    size = F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), source.alias("source"), row_key().alias("row_key"), size.alias("size"))


def row_key() -> F.Column:
    """A hash of what a row of documents is, beside its doc_id."""
    return F.xxhash64(F.col("text").cast("string"), F.col("source").cast("string"), F.col("doc_id").isNull())


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """doc_id, size, source_size, target, taken, copies and row_key of every row of docs (doc_id, text, source).

    taken = copies x size, and copies is target / source_size rounded down or up, so at most ``most`` rounded up. Null text
    has size 0. Null is a source, the last. Repeated rows are documents of their own. A source without words takes nothing.
    Reruns agree: blocks, order within them and draws depend on the rows alone. An empty table gives an empty result.

    Texts are read once and not shuffled. One row for each source comes to the driver: the list of sources is what the
    weights are given for.
    """
    rows = cut(sized(docs))
    totals = {r["source"]: (r["size"], r["n"]) for r in rows.groupBy("source").agg(F.sum("size").alias("size"), F.count("*").alias("n")).collect()}
    target = targets({k: v[0] for k, v in totals.items()}, weights, share, most)
    order = sorted(totals, key=lambda x: (x is None, x or ""))
    known = docs.sparkSession.createDataFrame([(k, i, totals[k][0], float(target[k])) for i, k in enumerate(order)], "name string, source_no int, source_size long, target double")
    wanted = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    rows = rows.join(F.broadcast(known), F.col("source").eqNullSafe(F.col("name"))).withColumn("copies", F.floor(wanted + 1e-9))
    rows = rows.withColumn("p", F.when(wanted - F.col("copies") < 1e-9, F.lit(0.0)).otherwise(wanted - F.col("copies"))).withColumn("last", F.lit(False)).select(NAMES)
    whole = (F.col("p") == 0) | (F.col("p") == 1)
    done, open_ = [rows.where(whole)], {i: totals[k][1] for i, k in enumerate(order)}
    rows = rows.where(~whole)
    while open_:
        blocks = {i: -(-n // BLOCK) for i, n in open_.items()}
        number = docs.sparkSession.createDataFrame(sorted(blocks.items()), "source_no int, number long")
        rows = rows.join(F.broadcast(number), "source_no").withColumn("last", F.col("number") == 1)
        rows = rows.groupBy("source_no", F.pmod(F.xxhash64("doc_id", "row_key", F.lit(len(done))), F.col("number")).alias("block")).applyInArrow(settle, OPEN)
        open_ = {i: 2 * n for i, n in blocks.items() if n > 1}  # a block leaves two open at most
        if open_:
            rows = cut(rows)
        done.append(rows.where(whole) if open_ else rows)
        rows = rows.where(~whole)
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    copies = F.col("copies") + F.round("p").cast("long")
    return out.select("doc_id", "size", "source_size", "target", (copies * F.col("size")).alias("taken"), copies.alias("copies"), "row_key")


def repeated(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """The mix itself: docs' rows, with docs' columns, each as often as it is taken.

    Rows with one doc_id, text and source are put together first, so that the join has one row of either side for a key.
    """
    copies = mix(docs, weights, share, most).groupBy(F.coalesce("doc_id", F.lit(0)).alias("_id"), F.col("row_key").alias("_key")).agg(F.sum("copies").alias("_n"))
    rows = docs.select(F.struct(*docs.columns).alias("_row"), F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("_id"), row_key().alias("_key"))
    rows = rows.groupBy("_id", "_key").agg(F.first("_row").alias("_row")).join(copies.where("_n > 0"), ["_id", "_key"])
    return rows.select("_row", F.explode(F.sequence(F.lit(1), F.col("_n").cast("int")))).select("_row.*")
