"""Near-duplicate vectors: spherical k-means cells, blocked cosine products, one vector kept per group.

Equal vectors are one class from the start. Every class lives in the cell of
its nearest centre and visits those lower-numbered cells that could hold a
partner; so a pair of two cells is looked at once, in the lower one. A visit is
left out only where no partner can be: the border of the two cells is further
away than any partner, or the partner's cell does not reach so far from its
centre. ``z`` shortens the reach to the border to so many standard deviations
of a partner at the threshold in a random direction, and may miss links.

Cells lie in a few regions, near ones together. A vector moves once for each region
that it visits, whatever the number of cells, with a bit for each of the region's
cells. In a region, residents are dealt to blocks and visitors (the residents too)
to chunks, both of bounded size. A group is one block and one chunk; it
multiplies cell by cell and piece by piece, in single precision first, and returns
a row per linked vector: how many it met, and the smallest vector that its links
inside the group reach. Pairs are never written out, so a cell of a third of all
rows is many groups of equal size and not one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomdex.llm.graph import components
from loomdex.session import materialize

COSINE = 0.9
#: Vectors a cell is meant to hold, and the most centres: they go to every task (256 bytes each at width 64).
CELL, MAX_CELLS = 512, 4096
#: Vectors per centre in the sample that trains the centres, and the rounds of training.
SAMPLE, ROUNDS = 32, 8
#: Regions of cells; the least and the most rows of a block of residents and of a chunk of visitors.
REGIONS = 16
BLOCK, CHUNK = 65_536, 131_072
LEAST_CHUNK = 4096
#: Residents and visitors that are multiplied at one time.
PIECE = 1024, 4096


def matrix(column: pa.Array) -> list[np.ndarray | None]:
    """Vectors in double precision; None where null, empty, zero, or with null or non-finite components."""
    found = []
    for item in column:
        if not item.is_valid or item.values.null_count or not len(item.values):
            found.append(None)
            continue
        v = item.values.to_numpy().astype(np.float64)
        found.append(v if np.isfinite(v).all() and v.any() else None)
    return found


def unit(v: np.ndarray) -> np.ndarray:
    v = v / np.abs(v).max()  # very large or small components must not overflow
    return v / np.sqrt(v @ v)


def units(m: np.ndarray) -> np.ndarray:
    """Rows of unit length in double precision."""
    m = m.astype(np.float64)
    m /= np.abs(m).max(1, keepdims=True)
    return m / np.sqrt((m * m).sum(1, keepdims=True))


def train(sample: np.ndarray, k: int, rounds: int) -> np.ndarray:
    """Spherical k-means from evenly spread rows of the sample; empty cells keep their centre."""
    centres = sample[np.linspace(0, len(sample) - 1, k).astype(np.int64)].copy()
    for _ in range(rounds):
        cell = np.concatenate([(part @ centres.T).argmax(1) for part in np.array_split(sample, max(1, len(sample) // 4096))])
        sums = np.zeros_like(centres)
        np.add.at(sums, cell, sample)
        norms = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(norms > 0, sums / np.where(norms > 0, norms, 1), centres)
    return centres


def homes(centres: dict[int, np.ndarray]):
    """Vectors to (width, home, near, far): a row for each cell met in a batch, the largest and smallest cosine to its centre."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            vectors = matrix(batch.column(0))
            for width in sorted({len(v) for v in vectors if v is not None}):
                block = np.array([unit(v) for v in vectors if v is not None and len(v) == width])
                dots = block @ centres[width].astype(np.float64).T
                home = dots.argmax(1)
                best = dots[np.arange(len(home)), home]
                rows += [(width, int(h), best[home == h].max(), best[home == h].min()) for h in np.unique(home)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(column, kind) for column, kind in zip(zip(*rows) if rows else [[]] * 4, (pa.int32(), pa.int32(), pa.float64(), pa.float64()))],
                ["width", "home", "near", "far"])

    return run


def in_regions(centres: np.ndarray, regions: int, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """Centres in an order that keeps regions together, and the first cell of each region, ending with their number."""
    around = train(centres, regions, rounds)
    region = (centres @ around.T).argmax(1)
    order = np.argsort(region, kind="stable")
    return centres[order], np.concatenate(([0], np.flatnonzero(np.diff(region[order])) + 1, [len(centres)]))


def cells(centres: dict[int, np.ndarray], regions: dict[int, np.ndarray], rings: dict[int, tuple[np.ndarray, np.ndarray]],
          cosine: float, z: float | None, kind: type):
    """(class id, vector) to (class id, vector bytes, home, region, visits); cells of one width share a number range.

    A visit is a region and a bit for each of its cells, from its first one on; a vector's own cell is among them.
    ``rings`` has for each width the least and the greatest angle of a cell's vectors to its centre.
    """
    visit = pa.struct([("region", pa.string()), ("bits", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, raw, homes, places, visits = [], [], [], [], []
            vectors = matrix(batch.column(1))
            for width in sorted({len(v) for v in vectors if v is not None}):
                rows = [i for i, v in enumerate(vectors) if v is not None and len(v) == width]
                block = np.array([unit(vectors[i]) for i in rows])
                own = centres[width].astype(np.float64)
                dots = block @ own.T
                home = dots.argmax(1)
                apart = np.sqrt(np.maximum(0, 2 - 2 * own @ own.T))
                chord = np.sqrt(2 - 2 * cosine)
                if z is not None and width > 2:
                    # y = cosine x + sqrt(1 - cosine^2) u: the border lies that far away if u is a random direction
                    chord = min(chord, z * np.sqrt(1 - cosine**2) / np.sqrt(width - 1) / cosine)
                lead = dots[np.arange(len(rows)), home][:, None] - dots
                may = (lead <= chord * apart[home] + 1e-9) & (np.arange(len(own)) < home[:, None])
                # the angle between vectors is a distance: a partner's own angle to its centre differs by theirs at most
                angle, reach = np.arccos(np.clip(dots, -1, 1)), np.arccos(min(1.0, cosine)) + 1e-6
                inner, outer = rings[width]
                may &= (angle <= outer + reach) & (angle >= inner - reach)
                may[np.arange(len(rows)), home] = True
                ids += batch.column(0).take(pa.array(rows)).to_pylist()
                raw += [vectors[i].astype(kind).tobytes() for i in rows]
                homes += home.tolist()
                first = regions[width]
                places += [f"{width}:{g}" for g in np.searchsorted(first, home, "right") - 1]
                found = [[] for _ in rows]
                for g, (low, high) in enumerate(zip(first[:-1], first[1:])):
                    part = may[:, low:high]
                    for i in np.flatnonzero(part.any(1)):
                        found[i].append({"region": f"{width}:{g}", "bits": np.packbits(part[i]).tobytes()})
                visits += found
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(raw, pa.binary()), pa.array(homes, pa.int32()), pa.array(places, pa.string()),
                 pa.array(visits, pa.list_(visit))],
                ["node", "vector", "home", "region", "visits"])

    return run


def reached(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """The smallest number that edges connect each of ``n`` numbers with."""
    least = np.arange(n)
    while True:
        before = least
        low = np.minimum(least[a], least[b])
        least = least.copy()
        np.minimum.at(least, a, low)
        np.minimum.at(least, b, low)
        least = least[least]
        if (least == before).all():
            return least


def linked(regions: dict[int, np.ndarray], cosine: float, kind: type):
    """A block and a chunk of one region to (node, met, least): links met here, smallest node they reach here."""

    def run(key: tuple[pa.Scalar, ...], group: pa.Table) -> pa.Table:
        width, region = map(int, key[0].as_py().split(":"))
        bits = group.column("bits").combine_chunks()
        guest = bits.is_valid().to_numpy(zero_copy_only=False)  # a visitor has bits, a resident none
        nodes, weight, home = (group.column(c).to_numpy() for c in ("node", "copies", "home"))
        x = np.frombuffer(b"".join(group.column("vector").to_pylist()), kind).reshape(len(nodes), -1)
        at_home, visiting = np.flatnonzero(~guest), np.flatnonzero(guest)
        at_home = at_home[np.argsort(home[at_home], kind="stable")]
        ids, place = np.unique(nodes, return_inverse=True)
        met, ends = np.zeros(len(ids), np.int64), [(np.zeros(0, np.int64),) * 2]
        if len(at_home) and len(visiting):
            low = regions[width][region]
            wanted = np.frombuffer(b"".join(bits.drop_null().to_pylist()), np.uint8).reshape(len(visiting), -1)
            near = np.float32(cosine - (width + 8) * 2.0**-23)
            cuts = np.flatnonzero(np.diff(home[at_home], prepend=-1, append=-1))
            for i, j in zip(cuts[:-1], cuts[1:]):
                cell = home[at_home[i]]
                mine, come = at_home[i:j], visiting[wanted[:, (cell - low) // 8] >> (7 - (cell - low) % 8) & 1 == 1]
                for u in range(0, len(come), PIECE[1]):
                    v = come[u : u + PIECE[1]]
                    theirs = units(x[v])
                    for t in range(0, len(mine), PIECE[0]):
                        r = mine[t : t + PIECE[0]]
                        ours = units(x[r])
                        maybe = ours.astype(np.float32) @ theirs.astype(np.float32).T >= near
                        a, b = np.flatnonzero(maybe.any(1)), np.flatnonzero(maybe.any(0))
                        if not len(a):
                            continue
                        link = ours[a] @ theirs[b].T >= cosine
                        link &= nodes[r[a]][:, None] != nodes[v[b]][None, :]
                        a, b = r[a], v[b]
                        np.add.at(met, place[a], link @ weight[b])
                        np.add.at(met, place[b], np.where(home[b] == cell, 0, weight[a] @ link))
                        ends += joined(link, place[a], place[b])
        a, b = (np.concatenate(side) for side in zip(*ends))
        least = reached(a, b, len(ids))
        out = np.unique(np.concatenate((a, b)))
        return pa.table({"node": ids[out], "met": met[out], "least": ids[least[out]]})

    return run


def joined(link: np.ndarray, a: np.ndarray, b: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Edges between the rows ``a`` and columns ``b`` of a piece that connect what its links connect, few for each."""
    rows, columns = np.flatnonzero(link.any(1)), np.flatnonzero(link.any(0))
    link, found = link[rows][:, columns], []
    left, right = np.arange(len(rows)), np.arange(len(columns)) + len(rows)
    while len(rows):
        before = left.sum() + right.sum()
        left = np.minimum(left, np.where(link, right[None, :], len(left) + len(right)).min(1))
        right = np.minimum(right, np.where(link, left[:, None], len(left) + len(right)).min(0))
        if before == left.sum() + right.sum():
            break
    if len(rows):  # every label is the place of a row
        found = [(a[rows], a[rows[left]]), (b[columns], a[rows[right]])]
    return found


def similar_vectors(vectors: DataFrame, cosine: float = COSINE, cell: int = CELL, max_cells: int = MAX_CELLS,
                    sample: int = SAMPLE, rounds: int = ROUNDS, z: float | None = None,
                    block: int = BLOCK, chunk: int = CHUNK) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row of ``vectors`` (vec_id, embedding).

    Two rows link when the cosine of their vectors, in double precision, is at
    least ``cosine``. ``component_id`` is the smallest vec_id reachable by links;
    the row that carries it is kept. Vectors that are null, empty, zero or have
    null or non-finite components link with nothing and stand for themselves, and
    so do vectors of different widths among each other. Rows with equal vectors,
    equal rows too, link with each other. A null vec_id never names a component
    that has another one. An empty table gives no rows; other columns are ignored.

    Centres are trained on at most ``sample`` vectors per centre; every vector is
    assigned. No link is missed unless ``z`` is given (see above).
    """
    as_double = F.transform("embedding", lambda x: x.cast("double"))
    good = F.coalesce(
        F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) != float("inf")))
        & F.exists("embedding", lambda x: x != 0), F.lit(False))
    rows = vectors.select("vec_id", F.when(good, F.transform(as_double, lambda x: x + F.lit(0.0))).alias("vector"))
    node = F.when(F.col("vector").isNotNull(), F.xxhash64("vector"))
    rows = rows.withColumn("node", node)
    keyed = rows.where("node is not null")
    classes = keyed.groupBy("node").agg(F.count("*").alias("copies"), F.min("vec_id").alias("least_id"))
    one = materialize(keyed.select("node", "vector").dropDuplicates(["node"]), "distinct")
    classes = materialize(classes, "classes")

    kind = np.float32 if vectors.schema["embedding"].dataType.elementType.simpleString() == "float" else np.float64
    widths = {r.width: r.n for r in one.groupBy(F.size("vector").alias("width")).agg(F.count("*").alias("n")).collect()}
    centres, regions = {}, {}
    for width, n in widths.items():
        k = max(1, min(max_cells, n // cell))
        drawn = one.where(F.size("vector") == width).orderBy(F.xxhash64("node"), "node").limit(sample * k)
        found = np.array([unit(np.array(r.vector)) for r in drawn.select("vector").toLocalIterator()])
        trained = train(found, k, rounds).astype(np.float32)
        centres[width], regions[width] = in_regions(trained, max(1, min(REGIONS, k // 4)), rounds)
    # one row a cell at most reaches the driver
    met = one.select("vector").mapInArrow(homes(centres), "width int, home int, near double, far double")
    rings = {}
    for width in widths:  # a cell that holds nothing is never visited
        rings[width] = np.full(len(centres[width]), np.inf), np.full(len(centres[width]), -np.inf)
    for r in met.groupBy("width", "home").agg(F.max("near").alias("near"), F.min("far").alias("far")).collect():
        inner, outer = rings[r.width]
        inner[r.home], outer[r.home] = np.arccos(np.clip((r.near, r.far), -1, 1))
    placed = one.mapInArrow(
        cells(centres, regions, rings, cosine, z, kind),
        "node long, vector binary, home int, region string, visits array<struct<region:string,bits:binary>>")
    placed = materialize(placed.join(classes.select("node", "copies"), "node"), "placed")

    # sizes of regions: a row for each, so bounded by their number and the number of widths
    chunk = min(chunk, max(LEAST_CHUNK, sum(widths.values()) // 4))
    sizes = placed.groupBy("region").agg(F.ceil(F.count("*") / block).cast("int").alias("n_blocks"))
    calls = placed.select(F.explode("visits.region").alias("region")).groupBy("region").agg(
        F.ceil(F.count("*") / chunk).cast("int").alias("n_chunks"))
    dealt = F.broadcast(materialize(sizes.join(calls, "region"), "regions"))

    def spread(n: str):
        return F.explode(F.sequence(F.lit(0), F.col(n) - 1))

    def seat(seed: str, n: str):
        return F.pmod(F.xxhash64("node", F.lit(seed)), F.col(n)).cast("int")

    own = ("node", "vector", "copies", "home")
    residents = placed.join(dealt, "region").select(
        "region", *own, F.lit(None).cast("binary").alias("bits"), seat("block", "n_blocks").alias("i"), spread("n_chunks").alias("j"))
    visiting = placed.select(*own, F.explode("visits").alias("visit")).select(*own, "visit.*").join(dealt, "region").select(
        "region", *own, "bits", spread("n_blocks").alias("i"), seat("chunk", "n_chunks").alias("j"))
    members = residents.unionByName(visiting)
    found = materialize(
        members.groupBy("region", "i", "j").applyInArrow(linked(regions, cosine, kind), "node long, met long, least long"), "links")

    parts = components(found.select(F.col("node").alias("a"), F.col("least").alias("b")))
    met = found.groupBy("node").agg(F.sum("met").alias("met"))
    whole = classes.join(parts, "node", "left").join(met, "node", "left")
    whole = materialize(whole.withColumn("component", F.coalesce("component", "node")), "whole")
    least = materialize(whole.groupBy("component").agg(F.min("least_id").alias("component_id")), "least")
    ids = materialize(whole.join(least, "component").select(
        "node", "component_id", (F.col("copies") - 1 + F.coalesce("met", F.lit(0))).alias("n")), "ids")
    component = F.coalesce("component_id", "vec_id")
    return rows.select("vec_id", "node").join(ids, "node", "left").select(
        "vec_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"),
        F.col("vec_id").eqNullSafe(component).alias("kept"))
