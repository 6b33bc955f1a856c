"""Near-duplicate documents by a chosen-path join over the sets of their word shingles.

A document's set is hashed to minwise tokens, one for each of 128 coordinates: two sets agree on a coordinate with the
probability of their Jaccard similarity. Independent trees branch on them: the root and every large node choose one or
two coordinates, and documents go on together to a child where they have the same minwise token there. Similar sets
share many nodes over the trees, and the number of trees follows from the recall that is wished.

Nodes are compared in rounds, each confirmed on full sets. First, every member is compared with its node's leader,
and the best leaders of each document give its links, so a group of m near copies costs about m links and not m squared.
Then the members of a node that these links have not joined are compared with all others: in a small node at once; in
a large one, if most are joined, its few others with all, in blocks; else it branches again. What is still large at the
last level is compared in blocks too. Of what may be similar, the best is confirmed first: each document's best few in a
node of few documents, and in others a tree that spans the node's groups, so never more pairs than documents. Whatever
may be similar beyond that, and still is in different groups, goes there with its full set and meets the others' in
blocks of bounded size: nothing is cut off, and no row is made for a pair that isn't a link.

Equal sets are one class from the start, known by a 64-bit hash of the set: among a billion different sets two share
one with a chance of 3 %.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import components, discard, map_batches, sized, stash, table

WIDTH, SIZE = 5, 128
PERCENT = 75
#: Tokens in common of 128: a pair at the threshold has fewer once in 50,000.
MAYBE = 76
SMALL = 512
LEADERS = 2
#: Pairs of a document that are confirmed first, in a node of at most CROWD documents.
NEAREST = 3
CROWD = 32
LEVELS = 3
BLOCK = 4096
BLOCK_SHINGLES = 1 << 20
MIX = np.uint64(0x9E3779B97F4A7C15)


def trees(recall: float, similarity: float) -> int:
    """Trees until a pair at the threshold is missed with 1 - recall: it comes through a level with p = 1 - (1 - s)(1 - s / 3); three levels count."""
    p = 1.0
    for _ in range(3):  # both choices may go on
        p = 1 - (1 - similarity * p) * (1 - similarity * p / 3)
    return math.ceil(math.log(1 - recall) / math.log(1 - p))


TREES = trees(0.9999, PERCENT / 100)


def word_hashes(text: str | None) -> np.ndarray:
    """Hashes of the words between ASCII white space, A-Z lower-cased (as bytes, so nothing else is)."""
    digest = xxhash.xxh3_64_intdigest
    return np.array([digest(w) for w in (text or "").encode("utf-8", "replace").lower().split()], np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


def shingles(text: str | None) -> np.ndarray:
    """The sorted distinct hashes of a text's shingles."""
    h = word_hashes(text)
    if not len(h):
        return h
    width = min(WIDTH, len(h))
    with np.errstate(over="ignore"):
        out = np.full(len(h) - width + 1, width, np.uint64)
        for k in range(width):
            out = mix(out * MIX + h[k : len(h) - width + 1 + k])
    return np.unique(out)


def set_hash(s: np.ndarray) -> int:
    with np.errstate(over="ignore"):
        return int(np.add.reduce(mix(s)).astype(np.int64))


_odd = np.random.default_rng(20).integers(0, 2**63, (2, SIZE), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def minwise(s: np.ndarray) -> np.ndarray:
    """The least hash of a non-empty set under each of SIZE functions."""
    low = np.full(SIZE, np.uint64(2**64 - 1))
    for at in range(0, len(s), 256):
        low = np.minimum(low, (s[at : at + 256, None] * _odd[0] + _odd[1]).min(axis=0))
    return low


#: The coordinates of the trees' roots: one each, and a second one for every third tree.
ROOTS = [(t, t) for t in range(TREES)] + [(t, TREES + t) for t in range(0, TREES, 3)]


def signatures(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, k1 (equal for equal sets), sig (8 bits of each minwise token), roots (the children of the trees' roots)."""

    def run(batch):
        n, k1, sigs, roots = [], [], [], []
        for text in batch.column("text").to_pylist():
            s = shingles(text)
            n.append(len(s))
            if not len(s):
                k1.append(None), sigs.append(None), roots.append(None)
                continue
            with np.errstate(over="ignore"):
                k1.append(set_hash(s))
                low = minwise(s)
                sigs.append((mix(low) >> np.uint64(56)).astype("u1").tobytes())
                roots.append([int(np.int64(x)) for x in mix(low[[c for _, c in ROOTS]] * MIX + np.array([t * SIZE + c for t, c in ROOTS], np.uint64)).view(np.int64)])
        return {"doc_id": batch.column("doc_id"), "n_shingles": n, "k1": k1, "sig": sigs, "roots": roots}

    return map_batches(docs.select("doc_id", "text"), run, "doc_id long, n_shingles long, k1 long, sig binary, roots array<long>")


def unpack(column) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "u1").reshape(-1, SIZE)


def by_node(batches: Iterator[pa.RecordBatch], compare) -> Iterator[pa.RecordBatch]:
    """``compare`` over batches whose nodes stand side by side, cut between nodes."""
    rest = None
    for batch in batches:
        t = pa.Table.from_batches([batch])
        t = pa.concat_tables([rest, t]) if rest is not None else t
        nodes = t.column("node").to_numpy()
        if not len(nodes):
            continue
        last = int(np.searchsorted(nodes, nodes[-1]))  # its rows may go on in the next batch
        if last:
            yield compare(t.slice(0, last))
        rest = t.slice(last)
    if rest is not None and rest.num_rows:
        yield compare(rest)


def sorted_nodes(df: DataFrame) -> DataFrame:
    return df.repartition("node").sortWithinPartitions("node", "rep")


def starts_of(nodes: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.r_[True, nodes[1:] != nodes[:-1]])


def leaders(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, rep, sig) of small nodes -> rep, leader (the least rep of its node), same; where they may be similar."""

    def one(t: pa.Table) -> pa.RecordBatch:
        nodes, ids, sigs = t.column("node").to_numpy(), t.column("rep").to_numpy(), unpack(t.column("sig"))
        starts = starts_of(nodes)
        lead = np.repeat(starts, np.diff(np.r_[starts, len(nodes)]))
        same = (sigs == sigs[lead]).sum(axis=1)
        keep = np.flatnonzero((same >= MAYBE) & (ids != ids[lead]))
        return pa.RecordBatch.from_arrays([pa.array(ids[keep]), pa.array(ids[lead[keep]]), pa.array(same[keep].astype("int32"))], names=["rep", "leader", "same"])

    yield from by_node(batches, one)


def best(ids: np.ndarray, same: np.ndarray, most: int | None) -> tuple[np.ndarray, bool]:
    """The ``most`` ids with the most tokens in common (ties to the smaller id) and whether any were left out."""
    if most is None or len(ids) <= most:
        return ids, False
    return ids[np.lexsort((ids, -same))[:most]], True


class Found:
    """What the comparison of nodes gives out: pairs to confirm, or members to compare in blocks."""

    def __init__(self, most: int | None):
        self.most = most  # None: members
        self.pairs: dict[tuple[int, int], int] = {}  # 1: a has more in this node; 2: b has
        self.active: dict[tuple[int, int], bool] = {}
        self.edges: list[tuple[int, int, int, int, int]] = []

    def add(self, node: int, crowded: bool, i: int, group: int, probe: bool, ids: np.ndarray, groups: np.ndarray, probes: np.ndarray, same: np.ndarray) -> None:
        """``ids``: members of other groups; ``same``: tokens that they have in common with i; ``probes``: of a crowded node, whether they look for i themselves."""
        hit = same >= MAYBE
        ids, groups, same, probes = ids[hit], groups[hit], same[hit], probes[hit]
        if self.most is None:
            for j, other in zip(ids.tolist(), probes.tolist(), strict=True):
                if crowded and not other:
                    self.active[node, i] = True
                    self.active.setdefault((node, j), False)
                elif not crowded and (probe or other):
                    self.active[node, i], self.active[node, j] = probe, other
        elif crowded:
            by = np.lexsort((ids, -same))
            _, first = np.unique(groups[by], return_index=True)  # the best of each group
            for k in by[np.sort(first)[:8]].tolist():
                self.edges.append((-int(same[k]), i, int(ids[k]), group, int(groups[k])))
        else:
            near, cut = best(ids, same, self.most)
            for j in near.tolist():
                self.pair(i, j, cut)

    def pair(self, i: int, j: int, cut: bool) -> None:
        pair = (min(i, j), max(i, j))
        self.pairs[pair] = self.pairs.get(pair, 0) | cut * (1 if i < j else 2)

    def close(self) -> None:
        """Of a crowded node's pairs, those that span its groups, the best first."""
        forest = Forest()
        for _, i, j, a, b in sorted(self.edges):
            if forest.join(a, b):
                self.pair(i, j, False)
        self.edges = []

    def columns(self) -> dict[str, list]:
        if self.most is None:
            return {"node": [k[0] for k in self.active], "rep": [k[1] for k in self.active], "probe": list(self.active.values())}
        cut = list(self.pairs.values())
        return {"a": [p[0] for p in self.pairs], "b": [p[1] for p in self.pairs], "cut_a": [c & 1 > 0 for c in cut], "cut_b": [c & 2 > 0 for c in cut]}

    @staticmethod
    def schema(most: int | None) -> list[tuple[str, str]]:
        return [("node", "long"), ("rep", "long"), ("probe", "boolean")] if most is None else [("a", "long"), ("b", "long"), ("cut_a", "boolean"), ("cut_b", "boolean")]


KINDS = {"long": (pa.int64(), "int64"), "boolean": (pa.bool_(), "bool")}


class Forest:
    """Groups that links have joined."""

    def __init__(self):
        self.above: dict[int, int] = {}

    def top(self, g: int) -> int:
        while (up := self.above.get(g, g)) != g:
            g = up
        return g

    def join(self, a: int, b: int) -> bool:
        a, b = self.top(a), self.top(b)
        self.above[max(a, b)] = min(a, b)
        return a != b


def exhaustive(most: int | None):
    """(node, rep, group, probe, sig) of small nodes -> what of different groups may be similar."""

    def one(t: pa.Table) -> pa.RecordBatch:
        nodes, ids, groups, probes, sigs = (*(t.column(c).to_numpy() for c in ("node", "rep", "group", "probe")), unpack(t.column("sig")))
        starts, found = starts_of(nodes), Found(most)
        for start, end in zip(starts, [*starts[1:], len(nodes)], strict=True):
            crowded = end - start > CROWD
            own = groups[start:end]
            if crowded:  # of two groups, the smaller one's members look for the other's
                _, of, count = np.unique(own, return_inverse=True, return_counts=True)
                size = count[of]
            for i in range(start, end) if most is not None or crowded else start + np.flatnonzero(probes[start:end]):
                others = np.flatnonzero(own != groups[i])
                looks = probes[start + others]
                if crowded and most is None:
                    mine = (size[i - start], groups[i])
                    looks = (size[others] < mine[0]) | (size[others] == mine[0]) & (own[others] < mine[1])
                found.add(int(nodes[i]), crowded, int(ids[i]), int(groups[i]), bool(probes[i]), ids[start + others], own[others], looks, (sigs[start + others] == sigs[i]).sum(axis=1))
            found.close()
        return pa.RecordBatch.from_pydict(found.columns(), schema=pa.schema([(n, KINDS[k][0]) for n, k in Found.schema(most)]))

    return lambda batches: by_node(batches, one)


def large_leaders(large: DataFrame, block: int) -> DataFrame:
    """``leaders`` for large nodes: members are dealt by node and a salt, so that no node is one task's work."""
    salts = F.floor(F.col("size") / block).cast("int")
    heads = large.groupBy("node", "size").agg(F.min_by(F.struct("rep", "sig"), F.xxhash64("node", "rep")).alias("p"))  # another one in each node
    heads = heads.select("node", F.col("p.rep").alias("leader"), F.col("p.sig").alias("leader_sig"), F.explode(F.sequence(F.lit(0), salts)).alias("salt"))
    met = large.withColumn("salt", F.pmod(F.xxhash64("rep"), salts + 1).cast("int")).join(heads, ["node", "salt"]).select("rep", "sig", "leader", "leader_sig")

    def run(batch):
        same = (unpack(batch.column("sig")) == unpack(batch.column("leader_sig"))).sum(axis=1)
        return {"rep": batch.column("rep"), "leader": batch.column("leader"), "same": same}

    return map_batches(met, run, "rep long, leader long, same int").where(f"same >= {MAYBE} and rep <> leader")


def few_with_all(most: int | None):
    """Within a block of a large node: its few that are outside its largest group against all members of the block."""

    def run(members, few):
        import pandas as pd

        rows = lambda x: np.frombuffer(b"".join(x), "u1").reshape(-1, SIZE)
        found = Found(most)
        if len(members) and len(few):
            node, ids, groups, sigs = int(members["node"].iloc[0]), members["rep"].to_numpy(), members["group"].to_numpy(), rows(members["sig"])
            for i, group, sig in zip(few["few_rep"].tolist(), few["few_group"].tolist(), rows(few["few_sig"]), strict=True):
                others = np.flatnonzero(groups != group)
                found.add(node, True, i, group, True, ids[others], groups[others], np.zeros(len(others), bool), (sigs[others] == sig).sum(axis=1))
            found.close()
        return pd.DataFrame({c: pd.array(v, KINDS[k][1]) for (c, k), v in zip(Found.schema(most), found.columns().values(), strict=True)})

    return run


def branch(batch: pa.RecordBatch) -> dict:
    """The children of large nodes: a node's own hash says which one or two coordinates it chooses."""
    nodes, sigs = batch.column("node").to_numpy().view(np.uint64), unpack(batch.column("sig"))
    with np.errstate(over="ignore"):
        draw = mix(nodes * MIX)
        first = (draw % np.uint64(SIZE)).astype(int)
        second = (first + 1 + (draw >> np.uint64(20)) % np.uint64(SIZE - 1)).astype(int) % SIZE
        rows = np.arange(len(nodes))
        both = np.flatnonzero((draw >> np.uint64(40)) % np.uint64(3) == 0)
        at, c = np.r_[rows, both], np.r_[first, second[both]]
        child = mix(mix(nodes[at] + np.uint64(1)) * MIX + c.astype(np.uint64) * np.uint64(256) + sigs[at, c].astype(np.uint64))
    take = lambda name: batch.column(name).take(pa.array(at))
    return {"node": child.view(np.int64), **{c: take(c) for c in ("rep", "group", "probe", "sig")}}


def first_pairs(nodes: DataFrame, small_node: int = SMALL, block: int = BLOCK) -> DataFrame:
    """Each document with the LEADERS nearest of its leaders. ``nodes`` has node, size, rep, sig."""
    small = sorted_nodes(nodes.where(F.col("size") <= small_node).select("node", "rep", "sig")).mapInArrow(leaders, "rep long, leader long, same int")
    met = small.unionByName(large_leaders(nodes.where(F.col("size") > small_node), block)).groupBy("rep", "leader").agg(F.max("same").alias("same"))
    near = met.withColumn("n", F.row_number().over(Window.partitionBy("rep").orderBy(F.desc("same"), "leader"))).where(F.col("n") <= LEADERS)  # a document has few leaders: one for each of its nodes
    return near.select(F.least("leader", "rep").alias("a"), F.greatest("leader", "rep").alias("b")).distinct()


def further(nodes: DataFrame, groups: DataFrame, most: int | None, probes: DataFrame | None = None, small_node: int = SMALL, block: int = BLOCK, levels: int = LEVELS) -> DataFrame:
    """What may be similar among a node's members that no link has joined yet; ``groups`` has rep, group.

    With ``most``, pairs (a, b) of each document with its best ones in a node, and whether a or b has more there; or
    those that span the groups of a crowded node. Without, the members (node, rep, probe) that meet one of ``probes``
    (rep), or are one that meets another; in crowded nodes, all that meet any.
    """
    names = Found.schema(most)
    shape = ", ".join(f"{n} {k}" for n, k in names)
    own = ["node", "rep", "group", "probe", "sig"]
    frontier = nodes.join(sized(groups), "rep", "left").withColumn("group", F.coalesce("group", "rep"))
    frontier = frontier.withColumn("probe", F.lit(False)) if probes is None else frontier.join(sized(probes.withColumn("probe", F.lit(True))), "rep", "left").withColumn("probe", F.coalesce("probe", F.lit(False)))
    frontier = frontier.select(own)
    found = []
    for level in range(1, levels + 1):
        counts = frontier.groupBy("node", "group").agg(F.count("*").alias("n"), F.max("probe").alias("probe"))
        mixed = counts.groupBy("node").agg(F.sum("n").alias("size"), F.max(F.struct("n", "group")).alias("most"), F.max("probe").alias("any")).where("size > most.n" if most is not None else f"size > most.n and (any or size > {CROWD})")
        mixed = stash(mixed.select("node", "size", F.col("most.group").alias("main"), (F.col("size") - F.col("most.n")).alias("far")))
        frontier = stash(frontier.join(sized(mixed), "node"))
        found.append(sorted_nodes(frontier.where(F.col("size") <= small_node).select(own)).mapInArrow(exhaustive(most), shape))
        large = frontier.where(F.col("size") > small_node)
        if not large.limit(1).count():
            break
        done = F.col("far") <= (block if level < levels else 2**62)
        ends, parts = large.where(done), F.floor(F.col("far") / block).cast("int")
        salts = F.floor(F.col("size") / block).cast("int")
        few = ends.where(F.col("group") != F.col("main")).select(*(F.col(c).alias(f"few_{c}") for c in own), F.explode(F.sequence(F.lit(0), salts)).alias("few_salt"), F.pmod(F.xxhash64("rep"), parts + 1).cast("int").alias("few_part"))
        members = ends.select(*own, F.pmod(F.xxhash64("rep"), salts + 1).cast("int").alias("salt"), F.explode(F.sequence(F.lit(0), parts)).alias("part"))
        found.append(members.groupBy("node", "salt", "part").cogroup(few.groupBy("few_node", "few_salt", "few_part")).applyInPandas(few_with_all(most), shape))
        frontier = stash(map_batches(large.where(~done).select(own), branch, "node long, rep long, group long, probe boolean, sig binary"))
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    keys = [n for n, k in names if k == "long"]
    return out.groupBy(keys).agg(*(F.max(n).alias(n) for n, k in names if k == "boolean"))


def full_sets(docs: DataFrame) -> DataFrame:
    """rep (the hash of the set), s."""

    def run(batch):
        sets = [shingles(t) for t in batch.column("text").to_pylist()]
        return {"rep": [set_hash(s) if len(s) else None for s in sets], "s": [s.view(np.int64) for s in sets]}

    return map_batches(docs.select("text"), run, "rep long, s array<long>")


def among(docs: DataFrame, ids: DataFrame, how: str = "left_semi") -> DataFrame:
    """Rows of ``docs`` whose doc_id is (or isn't) among ``ids``; while these are few, without moving the texts."""
    return docs.join(sized(ids), "doc_id", how)


def sets_of(docs: DataFrame, classes: DataFrame, reps: DataFrame) -> DataFrame:
    """The full sets (rep, s) of ``reps`` (rep); one document of each class is read again."""
    wanted = stash(reps.distinct().join(classes.select("rep", "doc_id"), "rep"))
    found = full_sets(among(docs, wanted.select("doc_id").distinct()))
    return stash(found.join(sized(wanted.select("rep")), "rep", "left_semi").dropDuplicates(["rep"]))


def confirmed(docs: DataFrame, classes: DataFrame, pairs: DataFrame) -> DataFrame:
    """The pairs (a, b) whose full sets meet the threshold. A frequent a is dealt by a salt."""
    pairs = stash(pairs)
    sets = sets_of(docs, classes, pairs.select(F.explode(F.array("a", "b")).alias("rep")))
    often = stash(pairs.groupBy("a").agg(F.floor(F.count("*") / 500).cast("int").alias("salts")))
    left = sets.join(sized(often), sets["rep"] == often["a"]).select("a", F.col("s").alias("sa"), F.explode(F.sequence(F.lit(0), "salts")).alias("salt"))
    right = pairs.join(sized(often), "a").select("a", "b", F.pmod(F.xxhash64("b"), F.col("salts") + 1).cast("int").alias("salt")).join(sets.select(F.col("rep").alias("b"), F.col("s").alias("sb")), "b")
    common = F.size(F.array_intersect("sa", "sb"))
    both = right.join(left, ["a", "salt"]).select("a", "b", common.alias("common"), (F.size("sa") + F.size("sb")).alias("total"))
    links = stash(both.where(100 * F.col("common") >= PERCENT * (F.col("total") - F.col("common"))).select("a", "b"))
    discard(pairs, sets, often)
    return links


def meet(members, probes):
    """Full sets of a block's members against those of its probes -> links (a, b) between groups, those that join something new."""
    import pandas as pd

    links, forest = [], Forest()
    if len(members) and len(probes):
        sizes = np.array([len(s) for s in members["s"]])
        values, owner = np.concatenate(members["s"].to_list()), np.repeat(np.arange(len(members)), sizes)
        by = np.argsort(values, kind="stable")
        values, owner = values[by], owner[by]
        ids, groups = members["rep"].to_numpy(), members["group"].to_numpy()
        for i, group, s in zip(probes["p_rep"].tolist(), probes["p_group"].tolist(), probes["p_s"], strict=True):
            low, high = np.searchsorted(values, s), np.searchsorted(values, s, side="right")
            n = high - low
            at = np.repeat(low - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum())  # the places of all that s has in common with members
            common = np.bincount(owner[at], minlength=len(sizes))
            for k in np.flatnonzero((100 * common >= PERCENT * (len(s) + sizes - common)) & (groups != group)).tolist():
                if forest.join(group, int(groups[k])):
                    links.append((i, int(ids[k])))
    return pd.DataFrame({"a": pd.array([x[0] for x in links], "int64"), "b": pd.array([x[1] for x in links], "int64")})


def met_in_blocks(docs: DataFrame, classes: DataFrame, groups: DataFrame, active: DataFrame, block: int = BLOCK_SHINGLES) -> DataFrame:
    """Links between the probes of a node and its active members; a node is dealt in blocks of about ``block`` shingles on both sides."""
    active = stash(active)
    sets = sets_of(docs, classes, active.select("rep"))
    rows = active.join(sized(groups), "rep", "left").withColumn("group", F.coalesce("group", "rep")).join(classes.select("rep", "n_shingles"), "rep")
    sizes = stash(rows.groupBy("node").agg(F.floor(F.sum("n_shingles") / block).cast("int").alias("salts"), F.floor(F.sum(F.when(F.col("probe"), F.col("n_shingles"))) / block).cast("int").alias("parts")))
    rows = rows.join(sized(sizes), "node")
    salt, part = (F.pmod(F.xxhash64("rep"), F.col(c) + 1).cast("int") for c in ("salts", "parts"))
    members = rows.select("node", salt.alias("salt"), F.explode(F.sequence(F.lit(0), "parts")).alias("part"), "rep", "group").join(sets, "rep")
    probes = rows.where("probe").select(F.col("node").alias("p_node"), F.explode(F.sequence(F.lit(0), "salts")).alias("p_salt"), part.alias("p_part"), F.col("rep").alias("p_rep"), F.col("group").alias("p_group"))
    probes = probes.join(sets.select(F.col("rep").alias("p_rep"), F.col("s").alias("p_s")), "p_rep")
    members, probes = members.groupBy("node", "salt", "part"), probes.groupBy("p_node", "p_salt", "p_part")
    links = stash(members.cogroup(probes).applyInPandas(meet, "a long, b long"))
    discard(active, sets, sizes)
    return links


def joined(docs: DataFrame, classes: DataFrame, known: DataFrame | None = None, small_node: int = SMALL, block: int = BLOCK, levels: int = LEVELS, most: int = NEAREST) -> DataFrame:
    """``classes`` (rep, doc_id, n_shingles, sig, roots) -> id, component_id for all reps that links, or the ``known`` ones (a, b), join."""
    frontier = classes.select("rep", F.explode("roots").alias("node"))
    sizes = frontier.groupBy("node").agg(F.count("*").alias("size")).where("size > 1")
    nodes = stash(frontier.join(sizes, "node").join(classes.select("rep", "sig"), "rep").select("node", "size", "rep", "sig"))
    links = confirmed(docs, classes, first_pairs(nodes, small_node, block))
    if known is not None:
        links = links.unionByName(known)
    group = lambda found: found.select(F.col("id").alias("rep"), F.col("component_id").alias("group"))
    groups = components(links)
    more = stash(further(nodes, group(groups), most, None, small_node, block, levels))
    if not more.limit(1).count():
        return groups
    links = links.unionByName(confirmed(docs, classes, more.select("a", "b")))
    groups = components(links)
    cut = stash(more.where("cut_a").select(F.col("a").alias("rep")).unionByName(more.where("cut_b").select(F.col("b").alias("rep"))).distinct())
    rest = stash(further(nodes, group(groups), None, cut, small_node, block, levels))
    if not rest.limit(1).count():
        return groups
    return components(links.unionByName(met_in_blocks(docs, classes, group(groups), rest)))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest doc_id reachable by links, itself included), kept (doc_id = component_id).

    A null or empty text, or one of white space, has no shingles and is linked with nothing. A row without doc_id is
    in no group: its component is null and kept is true. Rows that share a doc_id are one document: what is linked
    with one of their texts is in the component of all; n_shingles is each row's own, and a row without shingles stays by
    itself. Only doc_id and text are read. An empty table gives an empty result.
    """
    signed = stash(signatures(docs))
    full = signed.where("n_shingles > 0 and doc_id is not null")
    classes = stash(full.groupBy(F.col("k1").alias("rep")).agg(F.min("doc_id").alias("doc_id"), F.min_by(F.struct("n_shingles", "sig", "roots"), "doc_id").alias("first")).select("rep", "doc_id", "first.*"))
    twice = full.groupBy("doc_id").agg(F.min("k1").alias("a"), F.max("k1").alias("b")).where("a <> b").select("doc_id", "a")
    groups = joined(docs, classes, full.join(sized(stash(twice)), "doc_id").select("a", F.col("k1").alias("b")))
    named = classes.select("rep", "doc_id").join(sized(groups.select(F.col("id").alias("rep"), F.col("component_id").alias("group"))), "rep")
    least = stash(named.groupBy("group").agg(F.min("doc_id").alias("component_id")))
    named = stash(named.join(sized(least), "group").select("rep", "component_id"))
    of_class = classes.select("rep", "doc_id").join(sized(named), "rep", "left").select(F.col("rep").alias("k1"), F.coalesce("component_id", "doc_id").alias("component_id"))
    out = signed.select("doc_id", "n_shingles", "k1").join(of_class, "k1", "left").withColumn("component_id", F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")))
    return out.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def without_copies(docs: DataFrame) -> DataFrame:
    """The same rows and columns, one document of each group: the one with the smallest doc_id.

    Documents without words and rows without doc_id stay; rows that share a doc_id stay or go together.
    """
    dropped = stash(near_duplicates(docs).where("not kept").select("doc_id").distinct())
    return among(docs, dropped, "left_anti")


def op4_chosen_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
