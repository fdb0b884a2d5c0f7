"""Near-duplicate embeddings by NN-descent (operator 1).

Only vectors with the same label (not null) and width are compared, by cosine in
double precision; vectors that are null, zero, or hold null or non-finite
components, link with nothing.

1.  *Balls.*  In a few rounds of random-hyperplane cells, vectors close enough to
    a smaller id of their cell join its ball.  The bound is half the angle of the
    threshold, so all members of a ball are linked with each other without being
    compared: a large group of near copies costs one row a member, not a row a
    pair.  Only the balls' centres take part in the graph.
2.  *Graph.*  Two balls may hold a link only if the angle of their centres, less
    both radii, is within the threshold's.  That reach orders each centre's list
    of nearest known centres, which starts from cell neighbours.  In each
    NN-descent round a centre sees its list and some that list it; the pairs among
    them are scored, and those that beat either side's worst entry are offered to
    both lists.  A list in which every entry is in reach is saturated: it is
    enlarged at once.  Rounds end when hardly an edge in reach is new.
3.  *Audit.*  A bounded sample of centres is compared with all centres of its
    label.  While the lists miss more than ``1 - RECALL`` of the sample's edges,
    lists are enlarged and seeded from other cells, and rounds go on.  After
    ``AUDITS`` audits, labels that have not been shown to be whole are compared
    exactly, in blocks; so are, within their component, the balls whose lists are
    saturated at ``MAX_K``.
4.  *Links.*  Pairs of balls that the angles and radii confirm as a whole count
    by ball sizes; the others in reach are compared member by member in blocks,
    which give back counts and a spanning set of links, no row a pair.

Every table gets back one row per vector.  Of rows that repeat an id one counts
(the least label and vector).  Rows without an id are left out.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, working_tables, written
from .components import apart, components

THRESHOLD = 0.93
#: List length at the start, and the longest before a ball is compared exactly.
K, MAX_K = 10, 160
#: Vectors that share a cell, ball rounds at most, cells that seed the lists.
CELL = 1024
BALL_ROUNDS, SEED_TABLES = 6, 3
#: NN-descent rounds before an audit, audits, sampled centres of an audit, edges it must find.
ROUNDS, AUDITS, AUDIT_SAMPLE, RECALL = 8, 3, 400, 0.97
#: Centres seen at once in a neighbourhood, and those that list a centre among them.
PIECE, LISTING = 64, 48
#: Vectors in a block of member-by-member comparison.
BLOCK = 1024
#: Hyperplanes of a table of cells, and tables in all.
BITS, TABLES = 24, BALL_ROUNDS + SEED_TABLES * AUDITS
SLACK = 1e-9


def unit(column: pa.Array) -> np.ndarray:
    """Unit vectors, in double precision, of lists of one width."""
    flat = column.flatten() if not isinstance(column, pa.ChunkedArray) else pa.concat_arrays([c.flatten() for c in column.chunks])
    x = flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def turn(sim: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(sim, -1.0, 1.0))


def planes(width: int) -> np.ndarray:
    return np.random.default_rng(width).normal(size=(width, BITS * TABLES))


def signed(points: DataFrame) -> DataFrame:
    """Adds ``sigs``: for each table the signs against its hyperplanes, as a number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for part in batches:
            widths = part.column("width").to_numpy()
            sigs = np.zeros((part.num_rows, TABLES), np.int32)
            for width in np.unique(widths).tolist():
                if width not in held:
                    held[width] = planes(width)
                rows = np.flatnonzero(widths == width)
                sign = unit(part.column("x").take(pa.array(rows))) @ held[width] > 0
                sigs[rows] = sign.reshape(len(rows), TABLES, BITS) @ (1 << np.arange(BITS, dtype=np.int32))
            lists = pa.ListArray.from_arrays(np.arange(0, sigs.size + 1, TABLES, dtype=np.int32), pa.array(sigs.ravel()))
            yield pa.RecordBatch.from_arrays([*part.columns, lists], names=[*part.schema.names, "sigs"])

    schema = ", ".join(f"{n} {t}" for n, t in points.dtypes)
    return points.mapInArrow(run, f"{schema}, sigs array<int>")


def usable(vectors: DataFrame) -> DataFrame:
    """``vec_id, label, width, x, sigs`` and the label's size ``n``, of the rows that can link."""
    kind = dict(vectors.dtypes)["embedding"]
    x = F.col("embedding") if kind in ("array<float>", "array<double>") else F.col("embedding").cast("array<double>")
    own = vectors.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull()).select(
        F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), x.alias("x")
    )
    finite = F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    own = own.where(finite & F.exists("x", lambda v: v != 0))
    own = own.groupBy("vec_id").agg(F.min(F.struct("label", "x")).alias("v")).select("vec_id", "v.label", F.size("v.x").alias("width"), "v.x")
    own = written(signed(own), "signed")
    sizes = own.groupBy("label", "width").agg(F.count("*").alias("n")).select(apart("label"), "width", "n")
    return written(own.join(sizes, ["label", "width"]), "vectors")


def celled(points: DataFrame, table: int) -> DataFrame:
    """Adds ``bucket, piece``: cells of about ``CELL`` vectors of a label; a crowded bucket is dealt to pieces."""
    bits = F.greatest(F.lit(0), F.least(F.lit(BITS), F.ceil(F.log2(F.col("n") / (CELL // 2))))).cast("int")
    keyed = points.withColumn("bucket", F.element_at("sigs", table + 1).bitwiseAND((F.pow(F.lit(2.0), bits) - 1).cast("int")))
    count = keyed.groupBy("label", "width", "bucket").agg(F.ceil(F.count("*") / F.lit(CELL)).alias("pieces")).select(apart("label"), "width", "bucket", "pieces")
    return keyed.join(count, ["label", "width", "bucket"]).withColumn("piece", F.pmod(F.xxhash64("vec_id", F.lit(table)), F.col("pieces"))).drop("pieces")


# balls -----------------------------------------------------------------------


def leaders(x: np.ndarray, near: float) -> tuple[np.ndarray, np.ndarray]:
    """For each row the earlier row whose ball it joins (itself: none), and their cosine."""
    sim = x @ x.T
    close = np.triu(sim >= near, 1)
    lead = np.arange(len(x))
    for i in np.flatnonzero(close.any(axis=1)):
        if lead[i] == i:
            free = np.flatnonzero(close[i] & (lead == np.arange(len(x))))
            lead[free] = i
    return lead, sim[np.arange(len(x)), lead]


def balls(points: DataFrame, threshold: float) -> DataFrame:
    """``points`` with ``centre``, the id of the ball's centre (their own for centres), and the angle to it."""
    near = math.cos(math.acos(threshold) / 2) + SLACK
    kind = dict(points.dtypes)["x"]
    joined_schema = f"c long, leader long, lx {kind}"

    def join_balls(rows: pa.Table) -> pa.Table:
        order = np.argsort(rows.column("vec_id").to_numpy())
        ids, xs = rows.column("vec_id").take(order).combine_chunks(), rows.column("x").take(order).combine_chunks()
        lead, _ = leaders(unit(xs), near)
        moved = np.flatnonzero(lead != np.arange(len(lead)))
        return pa.table({"c": ids.take(pa.array(moved)), "leader": ids.take(pa.array(lead[moved])), "lx": xs.take(pa.array(lead[moved]))})

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            ids, widths, to = (part.column(n).to_numpy(zero_copy_only=False).copy() for n in ("vec_id", "width", "leader"))
            angle = np.zeros(len(ids))
            for width in np.unique(widths):
                rows = pa.array(np.flatnonzero(widths == width))
                sim = (unit(part.column("x").take(rows)) * unit(part.column("lx").take(rows))).sum(axis=1)
                angle[rows.to_numpy()] = np.where(sim >= near, turn(sim), -1.0)
            to[angle < 0] = ids[angle < 0]  # too far from the new centre: free again
            keep = [part.column(n) for n in names]
            yield pa.RecordBatch.from_arrays([*keep, pa.array(to), pa.array(np.maximum(angle, 0.0))], names=[*names, "centre", "angle"])

    names = points.columns
    state = points.withColumns({"centre": F.col("vec_id"), "angle": F.lit(0.0)})
    schema = ", ".join(f"{n} {t}" for n, t in state.dtypes)
    old = None
    for table in range(BALL_ROUNDS):
        centres = state.where("vec_id = centre").select("vec_id", "label", "width", "n", "x", "sigs")
        moves = written(celled(centres, table).groupBy("label", "width", "bucket", "piece").applyInArrow(join_balls, joined_schema), "moves")
        moved = moves.count()
        if not moved:
            break
        both = state.join(moves, F.col("centre") == F.col("c"), "left")
        stay = both.where(F.col("c").isNull()).select(*names, "centre", "angle")
        gone = both.where(F.col("c").isNotNull()).select(*names, "leader", "lx").mapInArrow(measured, schema)
        state = written(stay.unionByName(gone), "balls")
        discard(moves, old)
        old = state
    return state


# the graph -------------------------------------------------------------------

OFFERS = "blk long, u long, vblk long, v long, s double"
OFFERS_ARROW = pa.schema([("blk", pa.int64()), ("u", pa.int64()), ("vblk", pa.int64()), ("v", pa.int64()), ("s", pa.float64())])
EDGES = "a long, b long, s double"


def lists_schema(kind: str) -> str:
    return f"id long, label long, width int, n long, x {kind}, sigs array<int>, r double, others long, blk long, k int, worst double, hot boolean, nb array<long>, nblk array<long>, s array<double>, fresh array<boolean>"


def firsts(keys: np.ndarray) -> np.ndarray:
    """Flags the first of each run of equal keys."""
    new = np.ones(len(keys), bool)
    new[1:] = keys[1:] != keys[:-1]
    return new


def top_offers(u: np.ndarray, s: np.ndarray, k: int, floor: float) -> np.ndarray:
    """Which offers to send on: each u's k best, and all that are in reach."""
    order = np.lexsort((-s, u))
    new = firsts(u[order])
    at = np.arange(len(order))
    rank = at - np.maximum.accumulate(np.where(new, at, 0))
    return order[(rank < k) | (s[order] >= floor)]


def offers_table(ids, blks, u, v, s, floor: float) -> pa.Table:
    keep = top_offers(u, s, 2 * K, floor)
    u, v, s = u[keep], v[keep], s[keep]
    return pa.table([blks[u], ids[u], blks[v], ids[v], s], schema=OFFERS_ARROW)


def seeds(lists: DataFrame, table: int, floor: float) -> DataFrame:
    """Offers of each centre's nearest in its cell."""

    def run(rows: pa.Table) -> pa.Table:
        n = rows.num_rows
        if n < 2:
            return OFFERS_ARROW.empty_table()
        x, r, k = unit(rows.column("x")), rows.column("r").to_numpy(), min(K, n - 1)
        reach = r[:, None] + r[None, :] - turn(x @ x.T)
        np.fill_diagonal(reach, -np.inf)
        top = np.argpartition(-reach, k - 1, axis=1)[:, :k]
        more = reach >= floor
        np.put_along_axis(more, top, True, axis=1)
        np.fill_diagonal(more, False)
        u, v = np.nonzero(more)
        return offers_table(rows.column("vec_id").to_numpy(), rows.column("blk").to_numpy(), u, v, reach[u, v], floor)

    own = lists.select(F.col("id").alias("vec_id"), "label", "width", "n", "x", "sigs", "r", "blk")
    return celled(own, table).groupBy("label", "width", "bucket", "piece").applyInArrow(run, OFFERS)


def nested(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(row, value) of a column of lists, end to end."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = pa.compute.list_value_length(column).to_numpy(zero_copy_only=False).astype(np.int64)
    return np.repeat(np.arange(len(column)), sizes), column.flatten().to_numpy(zero_copy_only=False)


def merged(lists: DataFrame, offers: DataFrame, floor: float, max_k: int) -> DataFrame:
    """The lists after the offers: best entries first, enlarged where saturated."""
    schema = lists_schema(dict(lists.dtypes)["x"])

    def run(own: pa.Table, mail: pa.Table) -> pa.Table:
        ids = own.column("id").to_numpy()
        by_id = np.argsort(ids)
        row, nb = nested(own.column("nb"))
        nblk, s = nested(own.column("nblk"))[1], nested(own.column("s"))[1]
        to = by_id[np.searchsorted(ids[by_id], mail.column("u").to_numpy())] if mail.num_rows else np.zeros(0, np.int64)
        row, nb = np.concatenate([row, to]), np.concatenate([nb.astype(np.int64), mail.column("v").to_numpy()])
        nblk, s = np.concatenate([nblk.astype(np.int64), mail.column("vblk").to_numpy()]), np.concatenate([s.astype(np.float64), mail.column("s").to_numpy()])
        fresh = np.arange(len(row)) >= len(row) - mail.num_rows
        order = np.lexsort((fresh, nb, row))
        new = firsts(row[order]) | firsts(nb[order])
        order = order[new]
        order = order[np.lexsort((nb[order], -s[order], row[order]))]
        row, nb, nblk, s, fresh = row[order], nb[order], nblk[order], s[order], fresh[order]
        held = np.bincount(row, minlength=len(ids))
        near = np.bincount(row[s >= floor], minlength=len(ids))
        k = own.column("k").to_numpy().copy()
        while ((near >= k) & (k < max_k)).any():
            k = np.where((near >= k) & (k < max_k), 2 * k, k)
        rank = np.arange(len(row)) - np.repeat(np.cumsum(held) - held, held)
        keep = rank < k[row]
        row, nb, nblk, s, fresh = row[keep], nb[keep], nblk[keep], s[keep], fresh[keep]
        held = np.bincount(row, minlength=len(ids))
        ends = np.cumsum(held)
        worst = np.full(len(ids), -np.inf)
        full = held >= k
        worst[full] = s[ends[full] - 1]
        offsets = pa.array(np.concatenate([[0], ends]).astype(np.int32))
        as_lists = [pa.ListArray.from_arrays(offsets, pa.array(v)) for v in (nb, nblk, s, fresh)]
        keep = [own.column(n) for n in ("id", "label", "width", "n", "x", "sigs", "r", "others", "blk")]
        hot = full & (worst >= floor)
        return pa.table([*keep, pa.array(k.astype(np.int32)), pa.array(worst), pa.array(hot), *as_lists], names=[c.split()[0] for c in schema.split(", ")])

    return lists.groupBy("blk").cogroup(offers.groupBy("blk")).applyInArrow(run, schema)


def local_join(lists: DataFrame, turn_no: int, floor: float) -> DataFrame:
    """Offers from the pairs in each centre's neighbourhood: its list and some that list it."""

    def run(edges: pa.Table, near: pa.Table) -> pa.Table:
        order = np.argsort(near.column("id").to_numpy())
        ids = near.column("id").to_numpy()[order]
        x, r = unit(near.column("x"))[order], near.column("r").to_numpy()[order]
        worst, blks = near.column("worst").to_numpy()[order], near.column("vblk").to_numpy()[order]
        a, b = (np.searchsorted(ids, edges.column(c).to_numpy()) for c in "ab")
        fresh = edges.column("fresh").to_numpy(zero_copy_only=False)
        centre = np.unique(a)
        a, b = np.concatenate([a, centre]), np.concatenate([b, centre])
        fresh = np.concatenate([fresh, np.zeros(len(centre), bool)])
        order = np.lexsort((~fresh, b, a))
        order = order[firsts(a[order]) | firsts(b[order])]
        a, b, fresh = a[order], b[order], fresh[order]
        # a large neighbourhood is seen in pieces, dealt anew in each round
        deal = ((b.astype(np.uint64) + np.uint64(turn_no)) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)
        order = np.lexsort((deal, a))
        a, b, fresh = a[order], b[order], fresh[order]
        at = np.arange(len(a))
        rank = at - np.maximum.accumulate(np.where(firsts(a), at, 0))
        start = np.flatnonzero(rank % PIECE == 0)
        size = np.diff(np.append(start, len(a)))
        us, vs, ss = [], [], []
        for low, wide in ((1, 8), (8, 16), (16, 24), (24, 32), (32, PIECE)):
            rows = np.flatnonzero((size > low) & (size <= wide))
            step = max(1, (4 << 20) // (wide * (wide + x.shape[1])))
            for i in range(0, len(rows), step):
                p = rows[i : i + step]
                index = start[p][:, None] + np.arange(wide)
                real = np.arange(wide) < size[p][:, None]
                index = np.minimum(index, len(b) - 1)
                v, new = b[index], fresh[index] & real
                g = x[v]
                s = r[v][:, :, None] + r[v][:, None, :] - turn(np.matmul(g, g.transpose(0, 2, 1)))
                ok = real[:, :, None] & real[:, None, :] & (new[:, :, None] | new[:, None, :]) & (v[:, :, None] != v[:, None, :]) & (s > worst[v][:, :, None])
                c, p, q = np.nonzero(ok)
                us.append(v[c, p])
                vs.append(v[c, q])
                ss.append(s[c, p, q])
        if not us:
            return OFFERS_ARROW.empty_table()
        u, v, s = np.concatenate(us), np.concatenate(vs), np.concatenate(ss)
        order = np.lexsort((v, u))
        order = order[firsts(u[order]) | firsts(v[order])]
        return offers_table(ids, blks, u[order], v[order], s[order], floor)

    entries = lists.select("blk", F.col("id").alias("a"), F.explode(F.arrays_zip("nb", "nblk", "fresh")).alias("e")).select("blk", "a", F.col("e.nb").alias("b"), F.col("e.nblk").alias("bblk"), F.col("e.fresh").alias("fresh"))
    nth = F.row_number().over(Window.partitionBy("b").orderBy(F.desc("fresh"), F.xxhash64("a", F.lit(turn_no))))
    listing = entries.withColumn("nth", nth).where(F.col("nth") <= LISTING).select(F.col("bblk").alias("blk"), F.col("b").alias("a"), F.col("a").alias("b"), "fresh")
    edges = entries.select("blk", "a", "b", "fresh").unionByName(listing)
    need = edges.select("blk", F.col("b").alias("id")).unionByName(edges.select("blk", F.col("a").alias("id"))).distinct()
    near = need.select(F.col("blk").alias("at"), "id").join(lists.select("id", "x", "r", "worst", F.col("blk").alias("vblk")), "id")
    return edges.groupBy("blk").cogroup(near.groupBy("at")).applyInArrow(run, OFFERS)


def descend(lists: DataFrame, offers: DataFrame, floor: float, rounds: int, max_k: int) -> tuple[DataFrame, int]:
    """NN-descent from the first offers on; also how many lists are saturated at their longest."""
    in_reach = F.size(F.filter("s", lambda v: v >= floor))
    newly = F.size(F.filter(F.arrays_zip("s", "fresh"), lambda e: e["fresh"] & (e["s"] >= floor)))
    old = None
    for done in range(rounds + 1):
        lists = written(merged(lists, offers, floor, max_k), "lists")
        discard(old)
        old = lists
        total, new, hot = lists.agg(F.sum(in_reach), F.sum(newly), F.count_if("hot")).first()
        if done == rounds or (done >= 1 and (new or 0) <= 0.001 * (total or 0)):
            break
        offers = local_join(lists, done, floor)
    return lists, hot


def brute(rows: list, lists: DataFrame, floor: float) -> DataFrame:
    """Edges in reach of a bounded sample (collected rows), by comparing it with all centres of its labels."""
    by_space: dict[tuple[int, int], tuple] = {}
    for space in {(r["label"], r["width"]) for r in rows}:
        own = [r for r in rows if (r["label"], r["width"]) == space]
        by_space[space] = (np.array([r["id"] for r in own]), np.array([r["r"] for r in own]), unit(pa.array([r["x"] for r in own])))
    held = lists.sparkSession.sparkContext.broadcast(by_space)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            ids, radius, label, width = (part.column(n).to_numpy() for n in ("id", "r", "label", "width"))
            for (of_label, of_width), (q_ids, q_r, q) in held.value.items():
                rows = np.flatnonzero((label == of_label) & (width == of_width))
                if not len(rows):
                    continue
                reach = q_r[:, None] + radius[rows][None, :] - turn(q @ unit(part.column("x").take(pa.array(rows))).T)
                i, j = np.nonzero((reach >= floor) & (q_ids[:, None] != ids[rows][None, :]))
                yield pa.RecordBatch.from_arrays([pa.array(q_ids[i]), pa.array(ids[rows][j]), pa.array(reach[i, j]), pa.array(label[rows][j])], names=["a", "b", "s", "label"])

    return lists.select("id", "r", "label", "width", "x").mapInArrow(run, f"{EDGES}, label long")


def whole(wanted: int, missed: int) -> bool:
    return missed <= (1 - RECALL) * wanted


def neighbours(centres: DataFrame, floor: float, report: dict) -> tuple[DataFrame, DataFrame | None]:
    """Edges ``a, b, s`` in reach with a < b, and ``id, part`` of the balls to compare exactly, part by part."""
    lists, table = centres, BALL_ROUNDS
    of_hash = F.xxhash64("id")
    k_floor = K
    for audit in range(AUDITS):
        offers = seeds(lists, table, floor)
        for _ in range(SEED_TABLES - 1):
            table += 1
            offers = offers.unionByName(seeds(lists, table, floor))
        table += 1
        lists, saturated = descend(lists, offers, floor, ROUNDS, MAX_K)
        entries = lists.select(F.col("id").alias("a"), F.explode(F.arrays_zip("nb", "s")).alias("e")).select("a", F.col("e.nb").alias("b"), F.col("e.s").alias("s")).where(F.col("s") >= floor)
        edges = written(entries.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "s").groupBy("a", "b").agg(F.max("s").alias("s")), "edges")
        # saturated balls, in the components that their edges to each other make
        parts = None
        if saturated:
            hot = lists.where("hot").select("id")
            pairs = edges.join(hot.select(F.col("id").alias("a")), "a", "left_semi").join(hot.select(F.col("id").alias("b")), "b", "left_semi")
            parts = written(components(pairs.select("a", "b")).select(F.col("member").alias("id"), F.col("component").alias("part")), "parts")
        # half of the sample is drawn from all centres, half from those with an edge
        some, fields = F.exists("s", lambda v: v >= floor), ("id", "label", "width", "x", "r")
        drawn = lists.select(*fields, "s").orderBy(of_hash, "id").limit(AUDIT_SAMPLE // 2).unionByName(lists.select(*fields, "s").where(some).orderBy(of_hash, "id").limit(AUDIT_SAMPLE // 2))
        sample = list({r["id"]: r for r in drawn.select(*fields).collect()}.values())
        truth = written(brute(sample, lists, floor), "audit")
        found = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).withColumn("found", F.lit(True))
        seen = truth.join(found, ["a", "b"], "left").withColumn("found", F.coalesce("found", F.lit(False)))
        if parts is not None:
            seen = seen.join(parts.select(F.col("id").alias("a"), F.col("part").alias("pa")), "a", "left").join(parts.select(F.col("id").alias("b"), F.col("part").alias("pb")), "b", "left")
            seen = seen.withColumn("found", F.col("found") | F.coalesce(F.col("pa") == F.col("pb"), F.lit(False)))
        counts = {r["label"]: r for r in seen.groupBy("label").agg(F.count("*").alias("wanted"), F.count_if(~F.col("found")).alias("missed")).collect()}
        wanted, missed = sum(r["wanted"] for r in counts.values()), sum(r["missed"] for r in counts.values())
        report.update(audits=audit + 1, sampled_edges=wanted, recall=1 - missed / wanted if wanted else 1.0, exact_labels=False)
        edges = edges.unionByName(truth.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "s")).groupBy("a", "b").agg(F.max("s").alias("s"))
        if whole(wanted, missed):
            break
        k_floor *= 2
        lists = lists.withColumn("k", F.greatest("k", F.lit(k_floor)))
    else:
        # no label is taken for whole but those whose own sample shows it
        shown = [label for label, r in counts.items() if whole(r["wanted"], r["missed"])]  # at most AUDIT_SAMPLE labels
        doubtful = lists.where(~F.col("label").isin(shown)) if shown else lists
        by_label = doubtful.select("id", F.xxhash64("label", "width").alias("part"))
        parts = by_label if parts is None else by_label.unionByName(parts.join(by_label, "id", "left_anti"))
        report.update(exact_labels=True)
    return edges, None if parts is None else written(parts, "exact")


# links -----------------------------------------------------------------------

PACKED = "host long, piece int, ids binary, centres binary, x binary"
PACKED_ARROW = pa.schema([("host", pa.int64()), ("piece", pa.int32()), ("ids", pa.binary()), ("centres", pa.binary()), ("x", pa.binary())])


def packed(points: DataFrame) -> DataFrame:
    """``host, vec_id, centre, x`` in rows of about ``BLOCK`` vectors of one host."""

    def run(rows: pa.Table) -> pa.Table:
        ids, centres = (rows.column(c).to_numpy().astype("<i8").tobytes() for c in ("vec_id", "centre"))
        return pa.table([[rows.column("host")[0].as_py()], [rows.column("piece")[0].as_py()], [ids], [centres], [unit(rows.column("x")).astype("<f8").tobytes()]], schema=PACKED_ARROW)

    count = points.groupBy("host").agg(F.ceil(F.count("*") / F.lit(BLOCK)).cast("int").alias("pieces")).select(apart("host"), "pieces")
    own = points.join(count, "host").withColumn("piece", F.pmod(F.xxhash64("vec_id"), F.col("pieces")).cast("int")).select("host", "piece", "vec_id", "centre", "x")
    return own.groupBy("host", "piece").applyInArrow(run, PACKED)


def forest(linked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Some of the links (row, column) of a table of rows by columns that connect what all of them do."""
    free_row, free_col = linked.any(axis=1), np.ones(linked.shape[1], bool)
    rows, cols = [], []
    for start in range(len(linked)):
        if not free_row[start]:
            continue
        free_row[start] = False
        todo = [start]
        while todo:
            i = todo.pop()
            for j in np.flatnonzero(linked[i] & free_col):
                free_col[j] = False
                more = np.flatnonzero(linked[:, j] & free_row)
                free_row[more] = False
                rows += [i, *more.tolist()]
                cols += [j] * (1 + len(more))
                todo += more.tolist()
    return np.array(rows, np.int64), np.array(cols, np.int64)


def compared(left: DataFrame, right: DataFrame, threshold: float, once: bool) -> DataFrame:
    """Links between the blocks of each host, of vectors of different balls.

    Rows ``p, n``: links of ``p`` in a pair of blocks; rows ``p, q``: links that
    connect what all of them do.  With ``once`` both sides are the same blocks.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            for r in part.to_pylist():
                a, b = (np.frombuffer(r[f"ids_{s}"], "<i8") for s in "ab")
                ca, cb = (np.frombuffer(r[f"centres_{s}"], "<i8") for s in "ab")
                x, y = (np.frombuffer(r[f"x_{s}"], "<f8").reshape(len(i), -1) for s, i in zip("ab", (a, b), strict=True))
                linked = (x @ y.T >= threshold) & (ca[:, None] != cb[None, :])
                i, j = forest(linked)
                sides = [(a, linked.sum(axis=1))] if once and r["piece_a"] == r["piece_b"] else [(a, linked.sum(axis=1)), (b, linked.sum(axis=0))]
                for ids, n in sides:
                    some = n > 0
                    yield pa.RecordBatch.from_arrays([pa.array(ids[some]), pa.nulls(int(some.sum()), pa.int64()), pa.array(n[some].astype(np.int64))], names=["p", "q", "n"])
                yield pa.RecordBatch.from_arrays([pa.array(a[i]), pa.array(b[j]), pa.nulls(len(i), pa.int64())], names=["p", "q", "n"])

    named = lambda side, s: side.select("host", *(F.col(c).alias(f"{c}_{s}") for c in ("piece", "ids", "centres", "x")))
    both = named(left, "a").join(named(right, "b"), "host")
    both = both.where("piece_a <= piece_b") if once else both
    spread = both.sparkSession.sparkContext.defaultParallelism * 2
    return both.repartition(spread, F.xxhash64("host", "piece_a", "piece_b")).mapInArrow(run, "p long, q long, n long")


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD, report: dict | None = None) -> DataFrame:
    """Per vector: links, component (its least id) and whether it is kept.

    ``report`` receives the last audit's figures: its recall and how many edges it was over.
    """
    with working_tables(vectors.sparkSession) as keep:
        return keep(written(linked(vectors, threshold, {} if report is None else report), "result"))


def linked(vectors: DataFrame, threshold: float, report: dict) -> DataFrame:
    points = usable(vectors)
    state = balls(points, threshold)
    angle = math.acos(threshold)
    size = state.groupBy("centre").agg((F.count("*") - 1).alias("others"), F.max("angle").alias("r"))
    own = state.where("vec_id = centre").select(F.col("vec_id").alias("id"), "label", "width", "n", "x", "sigs")
    own = celled(own.withColumn("vec_id", F.col("id")), BALL_ROUNDS).join(size.select(F.col("centre").alias("id"), "others", "r"), "id")
    empty = {c: F.array().cast(t) for c, t in (("nb", "array<long>"), ("nblk", "array<long>"), ("s", "array<double>"), ("fresh", "array<boolean>"))}
    centres = written(
        own.select("id", "label", "width", "n", "x", "sigs", "r", "others", F.xxhash64("label", "width", "bucket", "piece").alias("blk"), F.lit(K).alias("k"),
                   F.lit(float("-inf")).alias("worst"), F.lit(False).alias("hot"), *(v.alias(c) for c, v in empty.items())), "centres",
    )
    edges, exact = neighbours(centres, -angle - SLACK, report)
    info = centres.select("id", "others", "r")
    pairs = edges.join(info.select(F.col("id").alias("a"), F.col("others").alias("oa"), F.col("r").alias("ra")), "a").join(info.select(F.col("id").alias("b"), F.col("others").alias("ob"), F.col("r").alias("rb")), "b")
    # pairs inside one exact part are compared there
    if exact is not None:
        pairs = pairs.join(exact.select(F.col("id").alias("a"), F.col("part").alias("pa")), "a", "left").join(exact.select(F.col("id").alias("b"), F.col("part").alias("pb")), "b", "left")
        pairs = pairs.where(~F.coalesce(F.col("pa") == F.col("pb"), F.lit(False)))
    # s is both radii less the angle of the centres: two vectors alone are linked if they are in reach
    sure = F.when(F.col("oa") + F.col("ob") == 0, F.lit(True)).otherwise(F.col("s") - 2 * (F.col("ra") + F.col("rb")) >= -angle + SLACK)
    pairs = written(pairs.select("a", "b", "oa", "ob", "s", sure.alias("sure")), "pairs")
    n_alone, n_doubt = pairs.agg(F.count_if(F.col("sure") & (F.col("oa") + F.col("ob") == 0)), F.count_if(~F.col("sure"))).first()
    alone = pairs.where("sure AND oa + ob = 0").select("a", "b")
    by_ball = pairs.where("sure AND oa + ob > 0")
    tied = by_ball.select("a", "b")
    counted = by_ball.select(F.col("a").alias("centre"), (F.col("ob") + 1).alias("n")).unionByName(by_ball.select(F.col("b").alias("centre"), (F.col("oa") + 1).alias("n"))).groupBy("centre").agg(F.sum("n").alias("by_ball"))
    members = state.select("vec_id", "centre", "x")
    doubt = pairs.where(~F.col("sure"))
    alone_blocks = None
    if n_alone:
        # at the threshold itself the cosine decides, not its angle
        x = members.select(F.col("vec_id").alias("id"), "x")
        alone_blocks = alone.join(x.select(F.col("id").alias("a"), F.col("x").alias("xa")), "a").join(x.select(F.col("id").alias("b"), F.col("x").alias("xb")), "b").mapInArrow(at_least(threshold), "p long, q long")
    found = []
    if n_doubt:
        # the larger ball is the host of those it is compared with
        swap = F.col("ob") > F.col("oa")
        asked = doubt.select(F.when(swap, F.col("b")).otherwise(F.col("a")).alias("host"), F.when(swap, F.col("a")).otherwise(F.col("b")).alias("centre"))
        hosts = members.join(asked.select(F.col("host").alias("centre")).distinct(), "centre", "left_semi").withColumn("host", F.col("centre"))
        guests = members.join(asked, "centre")
        found.append(compared(packed(hosts), packed(guests), threshold, once=False))
    if exact is not None:
        blocks = written(packed(members.join(exact.select(F.col("id").alias("centre"), F.col("part").alias("host")), "centre")), "blocks")
        found.append(compared(blocks, blocks, threshold, once=True))
    if alone_blocks is not None:
        one = alone_blocks.select("p", "q", F.lit(None).cast("long").alias("n"))
        both = alone_blocks.select("p").unionByName(alone_blocks.select(F.col("q").alias("p"))).select("p", F.lit(None).cast("long").alias("q"), F.lit(1).cast("long").alias("n"))
        found.append(one.unionByName(both))
    ties = state.where("vec_id <> centre").select(F.col("vec_id").alias("a"), F.col("centre").alias("b")).unionByName(tied)
    counts = state.select("vec_id", "centre").join(info.select(F.col("id").alias("centre"), "others"), "centre").join(counted, "centre", "left")
    links = F.col("others") + F.coalesce("by_ball", F.lit(0))
    if found:
        rows = found[0]
        for more in found[1:]:
            rows = rows.unionByName(more)
        rows = written(rows, "found")
        ties = ties.unionByName(rows.where("q IS NOT NULL").select(F.col("p").alias("a"), F.col("q").alias("b")))
        counts = counts.join(rows.where("n IS NOT NULL").groupBy(F.col("p").alias("vec_id")).agg(F.sum("n").alias("one_by_one")), "vec_id", "left")
        links = links + F.coalesce("one_by_one", F.lit(0))
    found_parts = components(ties)
    every = vectors.where(F.col("vec_id").isNotNull()).select(F.col("vec_id").cast("long").alias("vec_id")).distinct()
    out = every.join(counts.select("vec_id", links.alias("links")), "vec_id", "left").join(found_parts, F.col("vec_id") == F.col("member"), "left")
    component = F.coalesce("component", "vec_id")
    return out.select("vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), (F.col("vec_id") == component).alias("kept"))


def at_least(threshold: float):
    """Pairs whose vectors' cosine is not below the threshold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            widths = pa.compute.list_value_length(part.column("xa")).to_numpy()
            for width in np.unique(widths).tolist():
                rows = pa.array(np.flatnonzero(widths == width))
                sim = (unit(part.column("xa").take(rows)) * unit(part.column("xb").take(rows))).sum(axis=1)
                keep = rows.filter(pa.array(sim >= threshold))
                yield pa.RecordBatch.from_arrays([part.column("a").take(keep), part.column("b").take(keep)], names=["p", "q"])

    return run
