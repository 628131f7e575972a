"""Resampling intervals and permutation tests.

Draws and permutations are seeded by what they belong to, so tests run in
parallel as rows of a table, each in one Arrow batch row; only summaries come
out.  The statistics of draws are plain aggregations of a join.
"""

from __future__ import annotations

import hashlib
import json
import math
import random
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallygrid.functions import metrics as m

from .lineage import fixed, spread

LEVELS = (0.025, 0.975)
#: People of a leaf of the splitting tree.
PEOPLE_A_BLOCK = 1024
#: Replicates of a message of sums.
REPLICATES = 512
#: Up to so many cells, blocks are added up before they are sent.
SHARED_CELLS = 4096


def indices(sizes: tuple[int, ...], repeats: int, seed: int) -> Iterator[np.ndarray]:
    """For each replicate the places drawn: from every stratum as many as it has, with replacement, strata lying one after the other.

    All come from one stream of Python's generator, in this order.
    """
    pick, ends = random.Random(seed).randrange, np.cumsum(sizes, dtype=np.int64)
    for _ in range(repeats):
        parts = [end - n + np.fromiter((pick(n) for _ in range(n)), np.int64, n) for n, end in zip(sizes, ends.tolist(), strict=True)]
        yield np.concatenate(parts) if parts else np.zeros(0, np.int64)


def draws(spark: SparkSession, sizes: tuple[int, ...], repeats: int, seed: int) -> DataFrame:
    """(rep, index, times) of :func:`indices`.  One stream has one order, so one task makes it, replicate by replicate; it grows with repeats x clusters of the design, not with data."""

    def make(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for _ in range(len(batch)):
                for rep, places in enumerate(indices(sizes, repeats, seed)):
                    index, times = np.unique(places, return_counts=True)
                    yield pd.DataFrame({"rep": np.full(len(index), rep, np.int32), "index": index, "times": times})

    return spark.range(1, numPartitions=1).mapInPandas(make, "rep int, index long, times long")


def numbered_clusters(values: DataFrame) -> tuple[DataFrame, tuple[int, ...]]:
    """(stratum, cluster, index) in the order of both, nulls first, and the strata's sizes.  The strata, a design's few, are listed on the driver."""
    clusters = values.select("stratum", "cluster").distinct()
    strata = clusters.groupBy("stratum").agg(F.count("*").alias("n")).orderBy("stratum").collect()
    before = np.cumsum([0, *(r["n"] for r in strata)]).tolist()
    offset = F.lit(0).cast("long")
    for r, first in zip(strata, before, strict=False):
        offset = F.when(F.col("stratum").eqNullSafe(F.lit(r["stratum"])), F.lit(first)).otherwise(offset)
    place = F.row_number().over(Window.partitionBy("stratum").orderBy("cluster")) - 1
    return clusters.select("stratum", "cluster", (offset + place).cast("long").alias("index")), tuple(r["n"] for r in strata)


def _placed(values: DataFrame, numbered: DataFrame) -> DataFrame:
    """Adds the clusters' index; null equals null."""
    other = numbered.select(F.col("stratum").alias("_s"), F.col("cluster").alias("_c"), "index")
    return values.join(other, F.col("stratum").eqNullSafe(F.col("_s")) & F.col("cluster").eqNullSafe(F.col("_c"))).drop("_s", "_c")


def summarised(values: DataFrame, numbered: DataFrame, drawn: DataFrame, keys: list[str], equal_strata: bool) -> DataFrame:
    """Mean of ``value`` and its percentile interval over the draws (rep, index, times) of numbered clusters; nothing is lost to null strata or clusters."""
    by = _placed(values, numbered).groupBy(*keys, "stratum", "index").agg(F.sum("value").alias("s"), F.count("value").alias("n"))
    picked = by.join(drawn, "index")
    total = lambda c: F.sum(F.col(c) * F.col("times"))
    if equal_strata:
        means = picked.groupBy(*keys, "rep", "stratum").agg(F.try_divide(total("s"), total("n")).alias("m")).groupBy(*keys, "rep").agg(F.avg("m").alias("m"))
        point = values.groupBy(*keys, "stratum").agg(F.avg("value").alias("m")).groupBy(*keys).agg(F.avg("m").alias("mean"))
    else:
        means = picked.groupBy(*keys, "rep").agg(F.try_divide(total("s"), total("n")).alias("m"))
        point = values.groupBy(*keys).agg(F.avg("value").alias("mean"))
    limits = means.groupBy(*keys).agg(F.percentile("m", list(LEVELS)).alias("q"), F.count("*").alias("replicates"))
    return point.join(limits, keys).select(*keys, "mean", F.col("q")[0].alias("low"), F.col("q")[1].alias("high"), "replicates")


def bootstrap(values: DataFrame, repeats: int, seed: int, keys: list[str], equal_strata: bool) -> DataFrame:
    """Mean and percentile interval of ``value`` over clusters drawn whole within strata.

    ``values`` has keys, stratum, cluster, value.  A replicate's mean is over all drawn
    rows, or (``equal_strata``) the mean of its strata's means.  The same draws
    serve every key.
    """
    numbered, sizes = numbered_clusters(values)
    return summarised(values, numbered, draws(values.sparkSession, sizes, repeats, seed), keys, equal_strata)


def recentred_summary(values: DataFrame, drawn: DataFrame, numbered: DataFrame) -> DataFrame:
    """Per source and stratum: mean of the value less the source's mean, with its interval; the source's mean is taken anew in every draw.

    ``values`` has source, stratum, cluster, value.
    """
    picked = _placed(values, numbered).join(drawn, "index")
    w = F.col("value") * F.col("times")
    cells = picked.groupBy("rep", "source", "stratum").agg(F.sum(w).alias("s"), F.sum("times").alias("n"))
    whole = Window.partitionBy("rep", "source")
    means = cells.select("source", "stratum", (F.col("s") / F.col("n") - F.sum("s").over(whole) / F.sum("n").over(whole)).alias("m"))
    limits = means.groupBy("source", "stratum").agg(F.percentile("m", list(LEVELS)).alias("q"))
    point = recentred(values).groupBy("source", "stratum").agg(F.avg("centred").alias("mean"))
    return point.join(limits, ["source", "stratum"]).select("source", "stratum", "mean", F.col("q")[0].alias("low"), F.col("q")[1].alias("high"))


def generator(*parts: str) -> np.random.Generator:
    """PCG64 seeded by the first eight bytes of the parts' SHA-256."""
    return np.random.Generator(np.random.PCG64(int.from_bytes(hashlib.sha256("|".join(parts).encode()).digest()[:8], "little")))


def margin_tables(rows: np.ndarray, columns: np.ndarray, repeats: int, rng: np.random.Generator) -> np.ndarray:
    """(repeats, rows, columns) contingency tables with these margins, as answers paired at random have them.

    A table is filled cell by cell: of what its row still needs, a cell takes a hypergeometric share of what is
    left in its column against the columns after it.  The cost follows the cells, not the answers.
    """
    # A cell's values lie together.
    out = np.zeros((len(rows), len(columns), repeats), np.int64)
    left = np.repeat(np.asarray(columns, np.int64)[:, None], repeats, 1)
    for i, size in enumerate(rows[:-1]):
        need = np.full(repeats, size, np.int64)
        after = left.sum(0)
        for j in range(len(columns) - 1):
            after -= left[j]
            out[i, j] = rng.hypergeometric(left[j], after, need)
            need -= out[i, j]
        out[i, -1] = need
        left -= out[i]
    if len(rows):
        out[-1] = left
    return out.transpose(2, 0, 1)


def null_values(table: np.ndarray, statistic: Callable[[np.ndarray], np.ndarray], repeats: int, rng: np.random.Generator, room: int = 1 << 20) -> np.ndarray:
    """The statistic (or statistics, one below the other) of so many random tables with the margins of this one, made some at a time."""
    step = max(1, room // max(1, table.size))
    made = [statistic(margin_tables(table.sum(1), table.sum(0), min(step, repeats - k), rng)) for k in range(0, repeats, step)]
    return np.concatenate(made or [statistic(table[None])[..., :0]], axis=-1)


def tail(seen: float, null: np.ndarray, slack: float) -> float:
    """Share of what is as large as seen, which is counted in."""
    return float((1 + np.count_nonzero(null >= seen - slack)) / (1 + len(null)))


def row_distance(tables: np.ndarray) -> np.ndarray:
    """Total variation between the two rows of each table."""
    shares = tables / tables.sum(2, keepdims=True)
    return np.abs(shares[:, 1] - shares[:, 0]).sum(1) / 2


def independence_distance(tables: np.ndarray) -> np.ndarray:
    """Total variation of each table from the product of its margins."""
    p = tables / tables.sum((1, 2), keepdims=True)
    return np.abs(p - p.sum(2, keepdims=True) * p.sum(1, keepdims=True)).sum((1, 2)) / 2


def information(tables: np.ndarray) -> np.ndarray:
    """Mutual information of each table in bits."""
    p = tables / tables.sum((1, 2), keepdims=True)
    q = p.sum(2, keepdims=True) * p.sum(1, keepdims=True)
    return np.where(p > 0, p * np.log2(np.where(p > 0, p, 1) / np.where(q > 0, q, 1)), 0.0).sum((1, 2))


def dependence_terms(n: np.ndarray, row: int, column: int, total: int) -> tuple[np.ndarray, np.ndarray]:
    """What a cell adds to :func:`information` and to :func:`independence_distance` if it holds ``n`` and its margins are these."""
    p, q = n / total, row / total * (column / total)
    return np.where(n > 0, p * np.log2(np.where(n > 0, p, 1) / (q or 1)), 0.0), np.abs(p - q) / 2


def dependence(tables: np.ndarray) -> np.ndarray:
    """Both statistics, one below the other, of tables that have the same margins: a cell's terms are looked up where it takes fewer values than there are tables."""
    out = np.zeros((2, len(tables)))
    if not len(tables):
        return out
    rows, columns = tables[0].sum(1), tables[0].sum(0)
    total = int(rows.sum())
    for i, row in enumerate(rows.tolist()):
        for j, column in enumerate(columns.tolist()):
            n, most = tables[:, i, j], min(row, column)
            if most < len(n):
                for k, terms in enumerate(dependence_terms(np.arange(most + 1), row, column, total)):
                    out[k] += terms[n]
            else:
                out += dependence_terms(n, row, column, total)
    return out


def canonical_pairs(cells: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, place, a, b): the cells (a, b, n) of each key as single pairs, numbered in the order of a and b."""
    first = F.coalesce(F.sum("n").over(Window.partitionBy(*keys).orderBy("a", "b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = cells.filter("n > 0").withColumn("first", first)
    return rows.select(*keys, "a", "b", F.explode(F.sequence(F.col("first") + 1, F.col("first") + F.col("n"))).alias("place"))


def seed_of(*parts: Column) -> Column:
    """The seed of :func:`generator` as a decimal number: the first eight bytes of the SHA-256, the lowest first."""
    digest = F.sha2(F.concat_ws("|", *parts), 256)
    return F.conv(F.concat(*[F.substring(digest, 2 * k + 1, 2) for k in range(7, -1, -1)]), 16, 10).cast("decimal(20,0)")


def canonical_seed(namespace: str, base: int, **parts: str) -> int:
    """The whole SHA-256 of a canonical JSON text, as a seed."""
    text = json.dumps({"namespace": namespace, "base_seed": base, **parts}, sort_keys=True, separators=(",", ":"))
    return int(hashlib.sha256(text.encode()).hexdigest(), 16)


def tv_tests(counts: DataFrame, keys: list[str], repeats: int) -> DataFrame:
    """p of each comparison's total variation when the arms' labels are exchangeable.

    ``counts`` has keys, klass, before, after; one row a comparison goes to Python, as a table of two rows.
    """
    cells = F.sort_array(F.collect_list(F.struct(F.col("klass").cast("string").alias("k"), F.col("before").cast("long").alias("b"), F.col("after").cast("long").alias("a"))))
    rows = spread(counts, *keys).groupBy(*keys).agg(cells.alias("cells"))

    def test(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            ps = []
            for key, cells in zip(batch[keys].itertuples(index=False), batch["cells"], strict=True):
                table = np.array([[c[arm] for c in cells] for arm in ("b", "a")], np.int64)
                null = null_values(table, row_distance, repeats, generator(*map(str, key))) if table.sum(1).all() else None
                ps.append(None if null is None else tail(row_distance(table[None])[0], null, 1e-12))
            yield batch[keys].assign(p=pd.Series(ps, index=batch.index, dtype=float))

    return rows.mapInPandas(test, _schema(rows, keys, "p double"))


def joint_tests(joint: DataFrame, keys: list[str], repeats: int) -> DataFrame:
    """Both tests of dependence, mutual information and total variation from independence, over the same random tables.

    ``joint`` has keys, a, b, n; one row a key goes to Python, with its cells.
    """
    cells = F.sort_array(F.collect_list(F.struct(F.col("a").cast("string").alias("a"), F.col("b").cast("string").alias("b"), F.col("n").cast("long").alias("n"))))
    rows = spread(joint.filter("n > 0"), *keys).groupBy(*keys).agg(cells.alias("cells"))

    def test(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = []
            for key, cells in zip(batch[keys].itertuples(index=False), batch["cells"], strict=True):
                (ka, a), (kb, b) = (np.unique([str(c[k]) for c in cells], return_inverse=True) for k in ("a", "b"))
                table = np.zeros((len(ka), len(kb)), np.int64)
                np.add.at(table, (a, b), [c["n"] for c in cells])
                rng = np.random.Generator(np.random.PCG64(canonical_seed("tallygrid.dependence", 0, key="|".join(map(str, key)))))
                bits, apart = null_values(table, dependence, repeats, rng)
                seen, off = dependence(table[None])[:, 0].tolist()
                found.append((seen, float(bits.mean()) if repeats else 0.0, tail(seen, bits, 1e-15), tail(off, apart, 1e-12)))
            extra = pd.DataFrame(found, columns=["information", "information_null", "p_information", "p_tv"], index=batch.index)
            yield pd.concat([batch[keys], extra], axis=1)

    return rows.mapInPandas(test, _schema(rows, keys, "information double, information_null double, p_information double, p_tv double"))


def _schema(rows: DataFrame, keys: list[str], more: str) -> str:
    kinds = dict(rows.dtypes)
    return ", ".join([*(f"{k} {kinds[k]}" for k in keys), more])


def response_bootstrap(answers: DataFrame, repeats: int, seed: int, crossed: str | None = None, item_draws: DataFrame | None = None) -> DataFrame:
    """Intervals of mean TV, JS and Hellinger of pairs of sources when *answers* are drawn anew.

    ``answers`` has source, person, item, klass and n; a null ``klass`` counts answers without a
    class: they are drawn with the others but leave no mass.  The people of the source
    ``crossed`` answer many items, so a replicate draws as many people as there are, with
    replacement, once for all items (:func:`drawn_people`); of other
    sources each item's answers are drawn on their own.  A replicate in which a
    source has no classed answer left on an item is drawn again, whole; items on which a
    source has none to begin with are left out.
    With ``item_draws`` (rep, item, times) replicates weigh their items by how often they were drawn: the joint
    bootstrap of answers and items.
    """
    # Answers are read once for all cells, and once for the people drawn.
    cells = fixed(answers.groupBy("source", "item", "klass").agg(F.sum("n").alias("n"), F.max("n").alias("most")))
    there = cells.filter("klass is not null and most > 0").select("source", "item").distinct()
    own = F.col("source").eqNullSafe(F.lit(crossed)) if crossed is not None else F.lit(False)
    others = cells.filter(~own).join(there, ["source", "item"], "left_semi").filter("n > 0").drop("most")
    people = fixed(answers.filter(own).join(there, ["source", "item"], "left_semi").select("person", "item", "klass", "n")) if crossed is not None else None
    tries, accepted, left = 0, None, list(range(repeats))
    while left:
        if tries == 100:
            raise ValueError("a source has hardly any classed answers on an item")
        drawn = fixed(_world(others, people, left, seed, tries, crossed))
        empty = _emptied(drawn, there, left)
        drawn = drawn.join(empty, "rep", "left_anti")
        accepted = drawn if accepted is None else accepted.unionAll(drawn)
        left = sorted(r["rep"] for r in empty.collect())  # replicates, at most
        tries += 1
    return replicate_intervals(accepted, there, repeats, item_draws)


def replicate_intervals(cells: DataFrame, there: DataFrame, repeats: int, item_draws: DataFrame | None = None) -> DataFrame:
    """(left, right, tv_low, ...) of drawn cells (rep, source, item, klass, w) whose sources answer the items that ``there`` (source, item) says."""
    world = F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))).alias("rep")
    classed = cells.filter("klass is not null and w > 0")
    mass = classed.groupBy("rep", "source", "item").agg(F.sum("w").alias("total"))
    shares = classed.join(mass, ["rep", "source", "item"]).withColumn("p", F.col("w") / F.col("total"))
    one, other = (shares.select("rep", "item", "klass", F.col("source").alias(s), F.col("p").alias(v)) for s, v in (("left", "p"), ("right", "q")))
    shared = one.join(other, ["rep", "item", "klass"]).filter(F.col("left") < F.col("right"))
    found = shared.groupBy("left", "right", "rep", "item").agg(m.tv_shared(F.col("p"), F.col("q")).alias("tv"), m.js_shared(F.col("p"), F.col("q")).alias("js"), m.hellinger_shared(F.col("p"), F.col("q")).alias("hellinger"))
    # Pairs that share no class on an item in a replicate are at distance 1.
    pairs = there.withColumnRenamed("source", "left").join(there.withColumnRenamed("source", "right"), "item").filter(F.col("left") < F.col("right"))
    names = ("tv", "js", "hellinger")
    all_of = pairs.select("*", world).join(found, ["left", "right", "rep", "item"], "left").fillna(1.0, list(names))
    if item_draws is not None:
        all_of = all_of.join(item_draws, ["rep", "item"])
    times = F.lit(1) if item_draws is None else F.col("times")
    means = all_of.groupBy("left", "right", "rep").agg(*[(F.sum(F.col(x) * times) / F.sum(times)).alias(x) for x in names])
    return means.groupBy("left", "right").agg(*[F.percentile(x, list(LEVELS)).alias(x) for x in names]).select("left", "right", *[F.col(x)[k].alias(f"{x}_{side}") for x in names for k, side in enumerate(("low", "high"))])


def _emptied(cells: DataFrame, there: DataFrame, reps: list[int]) -> DataFrame:
    """(rep) of the replicates in which a source lost all classed answers on an item that it had some on."""
    wanted = there.count()
    full = cells.filter("klass is not null and w > 0").select("rep", "source", "item").distinct().groupBy("rep").agg(F.count("*").alias("n")).filter(F.col("n") == wanted)
    return cells.sparkSession.createDataFrame([(r,) for r in reps], "rep int").join(full, "rep", "left_anti")


def people_blocks(people: DataFrame, depth: int, keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys, block, path): the leaves of a splitting tree over people, a tree for each value of ``keys``, and the sizes along their way down from the root.

    ``people`` has keys, one row a person and a column ``h``, a hash of the person, whose first ``depth`` bits say which
    way the person goes.  ``path`` lists each node on the way, whether the way goes on to the right, how many people go left
    there and how many pass it.
    """
    sizes = people.groupBy(*keys, block_of("h", depth).alias("block")).agg(F.count("*").alias("n"))
    on_way = sizes.select(*keys, "block", "n", F.explode(F.sequence(F.lit(0), F.lit(depth))).alias("level")).withColumn("node", F.expr(f"shiftright(block, {depth} - level)"))
    nodes = on_way.groupBy(*keys, "level", "node").agg(F.sum("n").alias("size"))
    left = nodes.filter("level > 0 and node % 2 = 0").select(*keys, (F.col("level") - 1).alias("level"), F.shiftright("node", 1).alias("node"), F.col("size").alias("left"))
    nodes = nodes.join(left, [*keys, "level", "node"], "left").fillna(0, ["left"])
    step = F.struct("level", "node", F.expr(f"shiftright(block, greatest({depth} - level - 1, 0)) % 2 = 1").alias("right"), "left", "size")
    return on_way.select(*keys, "block", "level", "node").join(nodes, [*keys, "level", "node"]).groupBy(*keys, "block").agg(F.sort_array(F.collect_list(step)).alias("path"))


def block_of(h: str, depth: int) -> Column:
    """The first bits of a 64-bit hash."""
    return F.shiftrightunsigned(h, 64 - depth).cast("long") if depth else F.lit(0).cast("long")


def block_counts(path: list[dict], reps: int, seed: int, tries: int, known: dict | None = None) -> np.ndarray:
    """How many of the people that each replicate draws fall to a block.

    At each node on its way the count is split by a binomial seeded by the node, so all blocks see the same
    splits and together get exactly as many as there are people: a multinomial of any number of people, drawn in parallel.
    Blocks of one tree may share ``known``, the splits that were made before.
    """
    known = {} if known is None else known
    count = np.full(reps, path[0]["size"], np.int64)
    for step in path[:-1]:
        node = step["level"], step["node"]
        if node not in known:
            known[node] = generator(str(seed), str(tries), "node", *map(str, node)).binomial(count, step["left"] / step["size"])
        count = count - known[node] if step["right"] else known[node]
    return count


def drawn_people(answers: DataFrame, reps: list[int], seed: int, tries: int, block: int = PEOPLE_A_BLOCK) -> DataFrame:
    """(rep, item, klass, w) of people drawn with replacement, as many as there are, each with all answers (person, item, klass, n).

    Blocks hold about ``block`` people whatever their number.  A task adds up the blocks of a shelf and sends a cell's
    sums for many replicates as one message, so what is sent doesn't grow with replicates x blocks.
    People's order within a block is that of their hashes, so the draw doesn't depend on how rows came.
    """
    rows = answers.groupBy(F.col("person").cast("string").alias("person"), "item", F.col("klass").cast("string").alias("klass")).agg(F.sum("n").cast("long").alias("n"))
    rows = fixed(rows.withColumn("h", F.xxhash64(F.lit(seed), "person")))
    people = fixed(rows.select("person", "h").distinct())
    depth = max(0, math.ceil(math.log2(max(people.count(), 1) / block)))
    shelf = F.shiftright("block", shelf_depth(depth, rows.select("item", "klass").distinct().count())).alias("shelf")
    item = dict(answers.dtypes)["item"]

    def draw(key: tuple, own: pd.DataFrame, ways: pd.DataFrame) -> pd.DataFrame:
        own = own.sort_values(["block", "h", "person"])
        cells = own.groupby(["item", "klass"], dropna=False)
        own["cell"], names = cells.ngroup(), cells.size().reset_index()[["item", "klass"]]
        paths, known, blocks = dict(zip(ways["block"], ways["path"], strict=True)), {}, []
        for number, rows in own.groupby("block"):
            person = rows.groupby(["h", "person"], dropna=False, sort=False).ngroup().to_numpy()
            order = np.argsort(rows["cell"].to_numpy(), kind="stable")
            found, first = np.unique(rows["cell"].to_numpy()[order], return_index=True)
            counts = block_counts(list(paths[number]), len(reps), seed, tries, known)
            rng = generator(str(seed), str(tries), "block", str(number))
            blocks.append((rng, counts, int(person.max()) + 1, list(zip(found, np.split(person[order], first[1:]), np.split(rows["n"].to_numpy()[order], first[1:]), strict=True))))
        out = []
        for chunk, k in enumerate(range(0, len(reps), REPLICATES)):
            sums = np.zeros((len(names), len(reps[k : k + REPLICATES])), np.int64)
            for rng, counts, people, parts in blocks:
                times = np.ascontiguousarray(drawn_times(counts[k : k + REPLICATES], people, rng).T)
                for cell, person, n in parts:
                    sums[cell] += n @ times[person]
            out.append(names.assign(chunk=chunk, sums=[s.tobytes() for s in sums]))
        out = pd.concat(out)
        return out.assign(klass=out["klass"].astype(object).where(out["klass"].notna(), None))

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        sums = sum(np.frombuffer(b, np.int64) for b in pdf["sums"])
        at = np.flatnonzero(sums)
        rep = np.array(reps, np.int32)[pdf["chunk"].iloc[0] * REPLICATES + at]
        return pd.DataFrame({"rep": rep, "w": sums[at]}).assign(item=pdf["item"].iloc[0], klass=pdf["klass"].iloc[0])[["rep", "item", "klass", "w"]]

    mine = spread(rows.withColumn("block", block_of("h", depth)).withColumn("shelf", shelf), "shelf").groupBy("shelf")
    found = mine.cogroup(spread(people_blocks(people, depth).withColumn("shelf", shelf), "shelf").groupBy("shelf")).applyInPandas(draw, f"item {item}, klass string, chunk int, sums binary")
    return spread(found, "item", "klass", "chunk").groupBy("item", "klass", "chunk").applyInPandas(add, f"rep int, item {item}, klass string, w long")


def shelf_depth(depth: int, cells: int) -> int:
    """How many of the last splits of a tree stay within a shelf: there are 64 shelves before one has two blocks, and 32 blocks to a shelf at most; one where cells are so many that blocks share few."""
    return min(5, max(0, depth - 6)) if cells <= SHARED_CELLS else 0


def _world(cells: DataFrame, people: DataFrame | None, reps: list[int], seed: int, tries: int, crossed: str | None) -> DataFrame:
    """(rep, source, item, klass, w): how much of each cell (source, item, klass, n), and of the people of ``crossed``, the replicates have drawn."""
    cell = F.struct(F.col("klass").isNull().alias("void"), F.col("klass").cast("string").alias("k"), F.col("n").cast("long").alias("n"))
    rows = spread(cells, "source", "item").groupBy("source", "item").agg(F.sort_array(F.collect_list(cell)).alias("cells"))  # an item's classes

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for source, item, found in zip(batch["source"], batch["item"], batch["cells"], strict=True):
                n = np.array([c["n"] for c in found], float)
                drawn = generator(str(seed), str(tries), str(source), str(item)).multinomial(int(n.sum()), n / n.sum(), size=len(reps))
                rep, place = np.nonzero(drawn)
                names = np.array([c["k"] for c in found], object)
                yield pd.DataFrame({"rep": np.array(reps, np.int32)[rep], "source": source, "item": item, "klass": names[place], "w": drawn[rep, place]})

    kinds = dict(cells.dtypes)
    out = rows.mapInPandas(draw, f"rep int, source {kinds['source']}, item {kinds['item']}, klass string, w long")
    if crossed is not None:
        drawn = drawn_people(people, reps, seed, tries)
        out = out.unionAll(drawn.select("rep", F.lit(crossed).cast(kinds["source"]).alias("source"), "item", "klass", "w"))
    return out


def drawn_times(counts: np.ndarray, n: int, rng: np.random.Generator, step: int = 64) -> np.ndarray:
    """(replicates, n): how often each of a block's ``n`` members is drawn, of as many as ``counts`` says; a few replicates at a time, which is one stream."""
    out = np.empty((len(counts), n), np.int64)
    for k in range(0, len(counts), step):
        own = counts[k : k + step]
        places = rng.integers(0, n, int(own.sum()))
        places += np.repeat(np.arange(len(own)) * n, own)
        out[k : k + step] = np.bincount(places, minlength=len(own) * n).reshape(len(own), n)
    return out


def dealt(counts: np.ndarray, n: int, rng: np.random.Generator) -> np.ndarray:
    """(1 + replicates, n): once each, then :func:`drawn_times`."""
    return np.vstack((np.ones((1, n)), drawn_times(counts, n, rng)))


def paired_correlations(values: DataFrame, repeats: int, seed: int, block: int = PEOPLE_A_BLOCK) -> DataFrame:
    """Correlation of each pair of sources over items, with an interval from item draws within strata shared by all pairs.

    ``values`` has source, stratum, item, value; rows without source or value are left out, and an item's several values
    are averaged.  ``mean_r`` is the mean of the strata's correlations, null where a stratum has no spread; such draws don't
    count for the interval.  Items sit in blocks that know their share of each replicate from a splitting tree, and a
    block answers with a replicate's count, sums, squares and products: nothing sees a stratum whole.
    """
    kind = dict(values.dtypes)["source"]
    rows = values.filter("source is not null and value is not null").groupBy(F.to_json(F.struct("stratum")).alias("_s"), "source", F.to_json(F.struct("item")).alias("item")).agg(F.avg("value").alias("value"))
    rows = rows.withColumn("value", F.col("value") - F.avg("value").over(Window.partitionBy("source"))).withColumn("h", F.xxhash64(F.lit(seed), "item"))
    rows = fixed(rows)
    items = rows.select("_s", "item", "h").distinct()
    most = items.groupBy("_s").count().agg(F.max("count")).first()[0] or 1
    depth = max(0, math.ceil(math.log2(most / block)))

    def sums(key: tuple, own: pd.DataFrame, way: pd.DataFrame) -> pd.DataFrame:
        wide = own.pivot(index=["h", "item"], columns="source", values="value").sort_index()
        times = dealt(block_counts(list(way["path"].iloc[0]), repeats, seed, 0), len(wide), generator(str(seed), *map(str, key)))
        v, names, out = wide.to_numpy(), list(wide.columns), []
        for i, left in enumerate(names):
            for j in range(i + 1, len(names)):
                both = ~np.isnan(v[:, i]) & ~np.isnan(v[:, j])
                x, y = v[both, i], v[both, j]
                found = times[:, both] @ np.column_stack((np.ones(len(x)), x, y, x * x, y * y, x * y))
                out += [(key[0], left, names[j], c, found[c * REPLICATES : (c + 1) * REPLICATES].tobytes()) for c in range(-(-len(found) // REPLICATES))]
        return pd.DataFrame(out, columns=["_s", "left", "right", "chunk", "sums"])

    def correlate(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        strata = [sum(np.frombuffer(b, float).reshape(-1, 6) for b in g) for _, g in pdf.groupby("_s")["sums"]]
        rep = key[2] * REPLICATES - 1 + np.arange(len(strata[0]))
        return pd.DataFrame({"left": key[0], "right": key[1], "rep": rep, "r": np.mean([_r(s) for s in strata], axis=0), "pooled": _r(sum(strata))})

    mine = spread(rows.withColumn("block", block_of("h", depth)), "_s", "block").groupBy("_s", "block")
    ways = people_blocks(items, depth, ("_s",)).select(F.col("_s").alias("_of"), F.col("block").alias("_number"), "path")
    found = mine.cogroup(spread(ways, "_of", "_number").groupBy("_of", "_number")).applyInPandas(sums, f"_s string, left {kind}, right {kind}, chunk int, sums binary")
    found = found.groupBy("left", "right", "chunk").applyInPandas(correlate, f"left {kind}, right {kind}, rep int, r double, pooled double")
    point = lambda c: F.max(F.when(F.col("rep") < 0, F.col(c)))
    limits = F.percentile(F.when(F.col("rep") >= 0, F.col("r")), list(LEVELS))
    out = found.groupBy("left", "right").agg(point("r").alias("mean_r"), point("pooled").alias("pooled_r"), limits.alias("q"))
    return out.select("left", "right", "mean_r", "pooled_r", F.col("q")[0].alias("low"), F.col("q")[1].alias("high"))


def _r(sums: np.ndarray) -> np.ndarray:
    """Correlations from rows of count, sums, squares and product; NaN where one side has no spread."""
    n, x, y, xx, yy, xy = np.maximum(sums, [1, -np.inf, -np.inf, 0, 0, -np.inf]).T
    vx, vy = xx - x * x / n, yy - y * y / n
    sound = (vx > 1e-12 * xx) & (vy > 1e-12 * yy)
    return np.where(sound, (xy - x * y / n) / np.sqrt(np.where(sound, vx * vy, 1)), np.nan)


def recentred(values: DataFrame) -> DataFrame:
    """Adds centred: the value less its source's mean."""
    return values.withColumn("centred", F.col("value") - F.avg("value").over(Window.partitionBy("source")))
