"""Near-duplicates by 64-bit SimHash, linked through BK-trees.

Distinct fingerprints are dealt into shards by two of five bit bands: three differing bits touch at most three
bands, so every pair within the radius meets in the shard of some untouched pair of bands. A shard has a BK-tree
(children keyed by the integer Hamming distance to their parent) that is shipped to the task of its own queries,
never to all tasks: trees of the whole corpus have no size bound, so they are not broadcast. A shard of more than
`SHARD` fingerprints is cut into parts, and each pair of parts becomes a task of its own; nothing is skipped.
Inside a task links are folded by union-find, so a group of m copies leaves m-1 links instead of all pairs.

Defined results: null and wordless texts have fingerprint zero and link to each other; rows without doc_id take
part, and a component with no doc_id at all has a null component_id. Repeated rows share fingerprint and component.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barwright.llm import jaccard
from barwright.llm.jaccard import sketches  # by name: tasks get functions, not whole modules
from barwright.llm.shared import own_columns, stored, text_slices

RADIUS = 3
BANDS = (13, 13, 13, 13, 12)
SHARD = 4096
SLICE = 65_536


def fingerprint(text: str | None, shingle: int = 3, seed: int = 42) -> int:
    """Unsigned 64-bit SimHash of the word shingles of a text, repeats included."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: only A-Z change, only ASCII space splits
    if not words:
        return 0
    total, hashed = np.zeros(64, np.int64), xxhash.xxh64_intdigest
    count = max(1, len(words) - shingle + 1)
    for at in range(0, count, SLICE):
        part = words[at : at + SLICE + shingle - 1]
        grams = map(b" ".join, zip(*(part[i:] for i in range(shingle)))) if len(words) >= shingle else [b" ".join(words)]
        values = np.fromiter((hashed(g, seed) for g in grams), np.uint64)
        total += np.unpackbits(values.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * total > count, bitorder="little").view("<u8")[0])


def prints_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For mapInArrow: (doc_id, text) to (doc_id, fp)."""
    for batch in batches:
        for part, texts in text_slices(batch, "text"):
            found = np.array([fingerprint(t) for t in texts], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(found)], names=["doc_id", "fp"])


class BKTree:
    """Children are keyed by their distance to the parent; a search follows only edges within the radius."""

    def __init__(self):
        self.items: list[int] = []
        self.children: list[dict[int, int]] = []

    def add(self, item: int) -> None:
        self.items.append(item)
        self.children.append({})
        new, at = len(self.items) - 1, 0
        while new:
            d = (item ^ self.items[at]).bit_count()
            step = self.children[at].setdefault(d, new)
            if step == new:
                return
            at = step

    def within(self, item: int, radius: int) -> list[int]:
        found, open_ = [], [0] if self.items else []
        while open_:
            at = open_.pop()
            d = (item ^ self.items[at]).bit_count()
            if d <= radius:
                found.append(at)
            kids = self.children[at]
            if kids:
                open_ += [kids[k] for k in kids if d - radius <= k <= d + radius]
        return found


def links_of(tree_side: list[int], query_side: list[int] | None, radius: int = RADIUS) -> list[tuple[int, int]]:
    """Links that join all fingerprints within the radius: inside one list, or from one list to another."""
    tree, items = BKTree(), tree_side + (query_side or [])
    root = list(range(len(items)))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    links = []
    for i, x in enumerate(items):
        if query_side is None or i >= len(tree_side):
            for j in tree.within(x, radius):
                a, b = find(i), find(j)
                if a != b:
                    root[max(a, b)] = min(a, b)
                    links.append((items[j], x))
        if i < len(tree_side):
            tree.add(x)
    return links


def band_masks(radius: int = RADIUS, bands: tuple[int, ...] = BANDS) -> list[int]:
    """Signed masks of all band choices of which one is untouched by any `radius` differing bits."""
    edges = np.cumsum((0, *bands))
    one = [((1 << bands[i]) - 1) << int(edges[i]) for i in range(len(bands))]
    masks = [sum(pick) for pick in combinations(one, len(bands) - radius)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def near_links(prints: DataFrame, radius: int = RADIUS, shard: int = SHARD) -> DataFrame:
    """Links (a, b) among distinct fingerprints `fp` whose connected groups are those of all pairs within the radius."""
    masks = band_masks(radius)
    picks = F.array(*[F.struct(F.lit(i).alias("pick"), F.col("fp").bitwiseAND(F.lit(m)).alias("band")) for i, m in enumerate(masks)])
    dealt = prints.select("fp", F.explode(picks).alias("k")).select("fp", "k.pick", "k.band")
    sizes = dealt.groupBy("pick", "band").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    parts = F.ceil(F.col("n") / shard).cast("int")
    mine = F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda j: F.struct(F.least("mine", j).alias("lo"), F.greatest("mine", j).alias("hi")))
    placed = (
        dealt.join(sizes, ["pick", "band"])
        .withColumn("parts", parts)
        .withColumn("mine", mine)
        .select("pick", "band", "fp", "mine", F.explode(pairs).alias("p"))
        .select("pick", "band", "p.lo", "p.hi", "mine", "fp")
    )

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def linked(g: pd.DataFrame) -> list[tuple[int, int]]:
            fps, mine = (g["fp"].to_numpy(np.int64).view(np.uint64)), g["mine"].to_numpy()
            lo, hi = g["lo"].iat[0], g["hi"].iat[0]
            left = [int(x) for x in fps[mine == lo]]
            return links_of(left, None if lo == hi else [int(x) for x in fps[mine == hi]], radius)

        rest = None
        names = ["pick", "band", "lo", "hi"]
        for batch in batches:
            batch = batch if rest is None else pd.concat([rest, batch], ignore_index=True)
            cut = (batch[names].diff().ne(0).any(axis=1)).to_numpy()
            starts = np.flatnonzero(cut)
            rest = batch.iloc[starts[-1] :]
            yield frame([e for s, t in zip(starts[:-1], starts[1:]) if t - s > 1 for e in linked(batch.iloc[s:t])])
        if rest is not None and len(rest) > 1:
            yield frame(linked(rest))

    def frame(edges: list[tuple[int, int]]) -> pd.DataFrame:
        return pd.DataFrame(np.array(edges, np.uint64).reshape(-1, 2).view(np.int64), columns=["a", "b"])

    ordered = placed.repartition("pick", "band", "lo", "hi").sortWithinPartitions("pick", "band", "lo", "hi", "fp")
    return ordered.mapInPandas(search, "a long, b long").distinct()


def components(links: DataFrame) -> DataFrame:
    """Node and its group's smallest node, for all nodes of `links`: minimum label over neighbours, then a
    pointer jump, until nothing changes. Only one number a round reaches the driver."""
    both = stored(links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))), "links")
    labels = stored(both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("label")).withColumnRenamed("a", "node"), "labels")
    while True:
        near = both.join(labels, both["b"] == labels["node"]).groupBy("a").agg(F.min("label").alias("near"))
        seen = labels.join(near, labels["node"] == near["a"]).select("node", "label", F.least("label", "near").alias("step"))
        seen = stored(seen, "step")
        up = seen.select(F.col("node").alias("to"), F.col("step").alias("up"))
        jumped = stored(seen.join(up, seen["step"] == up["to"], "left").select("node", "label", F.coalesce(F.least("step", "up"), "step").alias("next")), "labels")
        labels = jumped.select("node", F.col("next").alias("label"))
        if jumped.filter("label <> next").isEmpty():
            return labels


def groups(prints: DataFrame, radius: int = RADIUS, links: DataFrame | None = None) -> DataFrame:
    """(fp, component_id) for every fingerprint of `prints` (doc_id, fp): the smallest doc_id reachable by links,
    which are those within the radius unless given."""
    reps = stored(prints.groupBy("fp").agg(F.min("doc_id").alias("rep")), "prints")
    labels = components(near_links(reps.select("fp"), radius) if links is None else links)
    found = reps.join(labels, reps["fp"] == labels["node"], "left").select("fp", "rep", F.coalesce("label", "fp").alias("root"))
    least = found.groupBy("root").agg(F.min("rep").alias("component_id"))
    return stored(found.join(least, "root").select("fp", "component_id"), "groups")


def with_groups(prints: DataFrame, found: DataFrame, ways: int = 8) -> DataFrame:
    """prints with their component; the rows of one fingerprint are spread over `ways` tasks."""
    rows = prints.withColumn("_way", F.pmod(F.xxhash64("doc_id"), F.lit(ways)))
    spread = found.withColumn("_way", F.explode(F.sequence(F.lit(0), F.lit(ways - 1)).cast("array<long>")))
    return rows.join(spread, ["fp", "_way"]).select("doc_id", "fp", "component_id")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fp (signed 64 bit), component_id for every row of docs (doc_id, text)."""
    prints = stored(docs.select("doc_id", "text").mapInArrow(prints_of, "doc_id long, fp long"), "simhash")
    return with_groups(prints, groups(prints))


def op6_simhash_near_dedup(spark, folder: str) -> DataFrame:
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    return near_duplicates(docs).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def proposals(near: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(fp, value): which set names `fp` of near (fp, simhash) share a group of SimHash fingerprints within the radius."""
    pairs = near.select("fp", "simhash").distinct()
    labels = components(near_links(pairs.select(F.col("simhash").alias("fp")).distinct(), radius))
    found = pairs.join(labels, pairs["simhash"] == labels["node"], "left")
    return found.select("fp", F.coalesce("label", "simhash").alias("value"))


def near_sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For mapInArrow: (doc_id, text) to (doc_id, fp, bands, simhash): a text's shingle set and its SimHash."""
    for batch in batches:
        prints = pa.chunked_array([p.column("fp") for p in prints_of(iter([batch]))], pa.int64()).combine_chunks()
        at = 0
        for part in sketches(iter([batch])):
            yield pa.RecordBatch.from_arrays([*part.columns, prints.slice(at, part.num_rows)], names=[*part.schema.names, "simhash"])
            at += part.num_rows


@own_columns
def stage(spark, docs: DataFrame, folder: str) -> DataFrame:
    """Pipeline stage: of each component the document with the smallest doc_id stays. Documents are linked where
    their sets of five-word shingles have a Jaccard similarity of 0.8 or more; `fp` names such a set. Groups of SimHash
    fingerprints within the radius (`near_links`) and MinHash bands (`jaccard`) propose them, the full sets decide.

    Rows that repeat a doc_id inside a component are cut to one. Rows without doc_id stay one by fingerprint where
    their component has no doc_id."""
    names = docs.columns
    prints = stored(docs.select("doc_id", "text").mapInArrow(near_sketches, "doc_id long, fp long, bands array<long>, simhash long"), "near-sketches")
    found = groups(prints, links=jaccard.links(docs, prints, more=proposals(prints)))
    near = stored(with_groups(prints, found), "near")
    leads = F.max(F.col("doc_id").eqNullSafe(F.col("component_id"))).alias("_leads")
    keep = near.groupBy("doc_id").agg(F.count(F.lit(1)).alias("_rows"), leads).filter("_leads").drop("_leads")
    kept = docs.join(keep.withColumnRenamed("doc_id", "_keep"), F.col("doc_id").eqNullSafe(F.col("_keep")))
    single = kept.filter("_rows = 1").select(*names)
    # a doc_id that several rows carry: one row of each of its sets' components
    again = kept.filter("_rows > 1").withColumn("fp", jaccard.text_key("text"))
    match = near.filter(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("fp").alias("_fp"), F.col("component_id").alias("_of")).distinct()
    many = again.join(match, (F.col("fp") == F.col("_fp")) & F.col("doc_id").eqNullSafe(F.col("_of")))
    one = F.when(F.col("doc_id").isNull(), F.col("fp"))
    return single.unionByName(many.withColumn("_one", one).dropDuplicates(["doc_id", "_one"]).select(*names))
