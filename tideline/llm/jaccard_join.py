"""Exact n-gram Jaccard join with signature trees; answers components of linked documents.

Documents are sets of hashes of word shingles; two link when 100 * |A and B| >= PERCENT * |A or B|.

1. Equal sets are collapsed to one class, so groups of exact copies cost one row each from here on.
2. Slots: sizes fall into ranges such that linked sets lie in one range or in two that are next to each other. A set takes
   part in its own range and, as the smaller of a pair, in the next.
3. Routes (prefix filter): in one order of all hashes, the first hash that two linked sets share lies so far to the front
   of each that what follows can still make up the overlap. A set is routed under those places, once a slot. Hashes that a
   sample of documents finds frequent come last in the order, which keeps routes short; the order decides speed only.
   A route that cannot hold a pair is dropped.
4. Groups: the routes of a slot whose least class is the same hold much the same classes, so they make one group, and a set
   is sent once to a group instead of once a route.
5. Signature trees: over each group stands a tree whose nodes hold OR-combined bitmaps of whole sets (4 bits a hash or
   more) and size ranges. Sets under two nodes share at most popcount(OR of one and OR of other) hashes and those beyond one
   a bit; a dual traversal drops pairs of nodes whose bound or sizes exclude a link, and pairs within one component.
   A first traversal, on bitmaps alone, finds the members that have a possible partner at all. A second, on the whole sets
   of those, compares the pairs of sets that it arrives at and gives links that span each component: no pair that is merely
   possible leaves a task, and a group's output is shorter than the group.
   A group of more than BLOCK_HASHES is dealt into blocks by a hash of its classes; its least class goes to every block, so
   that blocks of near copies join through it. Afterwards, classes outside the group's largest component are compared with
   all other blocks; classes of the largest component are not compared with each other again.
6. Components by pointer jumping over the links, iterations written to the shared folder.

Every two sets that link and are not in one component already are compared, so the components are exact. Nothing is capped.

Defined cases: a text with fewer words than a shingle is one shingle of all its words; null texts and texts without words
have 0 shingles and are a component each, of their own id; rows with equal ids and different texts are separate
documents, and a component's id is the least id in it that is not null; an empty table gives an empty result. Of docs only
doc_id, text and the row column are read, so other columns may have any names.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideline.llm.common import Scratch, mix64, run_starts, slices, stage
from tideline.llm.fingerprints import shingle_hashes, word_hashes

SIZE, PERCENT = 4, 85
#: One document in so many is looked at for frequent hashes; a hash is frequent from MIN_SEEN of them on. At most
#: MAX_FREQUENT (the most frequent) are broadcast: 8 MB.
SAMPLE, MIN_SEEN, MAX_FREQUENT = 8, 2, 1_000_000
#: Bits of the broadcast filter of documents whose sets are fetched, 4 MB whatever the input.
FILTER_BITS = 25
#: Groups with more hashes (8 bytes each) are dealt into blocks of about so many; a task holds two blocks at most.
BLOCK_HASHES = 1 << 20
LEAF, FANOUT = 16, 8
#: Pairs of tree nodes that a traversal expands at once.
CHUNK = 4096
#: Roles of a class in a route: its own slot's member, and one that can be the smaller of a pair.
OWN, SMALL = 1, 2


def shingle_set(text: str | None, size: int = SIZE) -> np.ndarray:
    return np.unique(shingle_hashes(word_hashes((text or "").encode()), size))


def set_id(hashes: np.ndarray) -> int:
    """63 bits that name a set."""
    return xxhash.xxh3_64_intdigest(hashes.tobytes()) >> 1


def least_share(n: int, percent: int) -> int:
    return (percent * n + 99) // 100


def linked(n_a, n_b, shared, percent: int):
    return 100 * shared >= percent * (n_a + n_b - shared)


def slot_edges(percent: int) -> np.ndarray:
    """The least size of each slot; a set links with none that lies two slots or more from its own."""
    edges = [1]
    while edges[-1] < 1 << 40:
        edges.append(100 * edges[-1] // percent + 1)
    return np.array(edges, dtype=np.int64)


def prefix(hashes: np.ndarray, frequent: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """The hashes of a sorted set that route it, in the common order: those that are not frequent by value, then the others."""
    count = len(hashes) - least_share(len(hashes), percent) + 1
    if not len(frequent):
        return hashes[:count]
    look = 2 * count
    while True:
        part = hashes[:look]
        late = frequent[np.minimum(np.searchsorted(frequent, part), len(frequent) - 1)] == part
        few = part[~late][:count]
        if len(few) == count:
            return few
        if look >= len(hashes):
            return np.concatenate((few, part[late][: count - len(few)]))
        look *= 4


def routes(order: np.ndarray, n: int, percent: int, edges: np.ndarray) -> tuple[int, np.ndarray]:
    """(slot, routes with the role in the last two bits) of a set of n hashes with this prefix."""
    slot = int(np.searchsorted(edges, n, side="right")) - 1
    most = (n - np.arange(len(order))) * (100 + percent) // percent - n  # the largest set that links if this is the first shared hash
    key = lambda hashes, s: mix64(hashes + np.uint64(s * 0xA24BAED4963EE407 % (1 << 64))) & ~np.uint64(3)
    own = key(order, slot) | np.where(most >= n, OWN | SMALL, OWN).astype(np.uint64)
    above = key(order[most >= edges[slot + 1]], slot + 1) | np.uint64(SMALL)
    return slot, np.concatenate((own, above)).view(np.int64)


def bitmap(hashes: np.ndarray) -> np.ndarray:
    """64-bit words in which every hash has its bit set; their number is a power of two, for 4 to 8 bits a hash."""
    width = max(64, 1 << (4 * len(hashes) - 1).bit_length())
    bits = np.zeros(width, dtype=np.uint8)
    bits[(hashes >> np.uint64(8)) & np.uint64(width - 1)] = 1
    return np.packbits(bits, bitorder="little").view("<u8")


def folded(maps: list[np.ndarray]) -> np.ndarray:
    """Bitmaps at the width of the narrowest: wider ones are cut in halves that are laid over each other."""
    words = min(map(len, maps))
    return np.stack([m if len(m) == words else np.bitwise_or.reduce(m.reshape(-1, words)) for m in maps])


class Tree:
    """A signature tree over the members of a group, and the dual traversal of the tree with itself.

    n: sizes; comp: components, pairs within one are left out; side: where not all are 0, only pairs of different sides count.
    Members are ordered by side, component and the ends of their bitmaps, so that similar sets come to lie together.
    """

    def __init__(self, n: np.ndarray, comp: np.ndarray, side: np.ndarray, maps: np.ndarray, percent: int):
        self.percent = percent
        order = np.lexsort((n, *self._ends(maps[:, ::-1]), *self._ends(maps), comp, side))
        self.order = order
        self.across = bool(side.any())
        n, comp, side, maps = n[order], comp[order], side[order], maps[order]
        extra = n - np.bitwise_count(maps).sum(axis=1)
        level = {"lo": n, "hi": n, "or": maps, "extra": extra, "comp_lo": comp, "comp_hi": comp, "side_lo": side, "side_hi": side}
        self.levels, self.widths = [level], [1]
        while len(level["lo"]) > 1:
            fan = LEAF if len(self.levels) == 1 else FANOUT
            at = np.arange(0, len(level["lo"]), fan)
            least, most = (lambda c: np.minimum.reduceat(level[c], at)), (lambda c: np.maximum.reduceat(level[c], at))  # noqa: B023
            level = {
                "lo": least("lo"),
                "hi": most("hi"),
                "or": np.bitwise_or.reduceat(level["or"], at, axis=0),
                "extra": most("extra"),
                "comp_lo": least("comp_lo"),
                "comp_hi": most("comp_hi"),
                "side_lo": least("side_lo"),
                "side_hi": most("side_hi"),
            }
            self.levels.append(level)
            self.widths.append(self.widths[-1] * fan)

    @staticmethod
    def _ends(maps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sort keys (the later one first): the first word of a bitmap that is not 0, and its lowest bit."""
        word = (maps != 0).argmax(axis=1)
        value = maps[np.arange(len(maps)), word]
        return value & (~value + np.uint64(1)), word

    def possible(self, depth: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Which pairs of nodes of a level may hold a link that counts."""
        x, percent = self.levels[depth], self.percent
        keep = 100 * np.minimum(x["hi"][a], x["hi"][b]) >= percent * np.maximum(x["lo"][a], x["lo"][b])
        keep &= ~((x["comp_lo"][a] == x["comp_hi"][b]) & (x["comp_hi"][a] == x["comp_lo"][b]))
        if self.across:
            keep &= ~((x["side_lo"][a] == x["side_hi"][b]) & (x["side_hi"][a] == x["side_lo"][b]))
        keep = np.flatnonzero(keep)
        a, b = a[keep], b[keep]
        most = np.bitwise_count(x["or"][a] & x["or"][b]).sum(axis=1).astype(np.int64) + np.minimum(x["extra"][a], x["extra"][b])
        return keep[(100 + percent) * most >= percent * (x["lo"][a] + x["lo"][b])]

    def pairs(self, done: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs of members (as indexes of what the tree was made from) that the bounds do not exclude, part by part. done: an
        array over the members that the caller may set meanwhile; pairs of nodes with nothing but done members are left out."""
        top = len(self.levels) - 1
        if not top:
            return
        todo = [(top, np.zeros(1, dtype=np.int64), np.zeros(1, dtype=np.int64))]
        while todo:
            depth, a, b = todo.pop()
            if done is not None:
                left = np.concatenate(([0], np.cumsum(~done[self.order])))
                width, end = self.widths[depth], len(left) - 1
                open_ = left[np.minimum((np.arange(len(self.levels[depth]["lo"])) + 1) * width, end)] - left[np.arange(len(self.levels[depth]["lo"])) * width]
                keep = open_[a] + open_[b] > 0
                a, b = a[keep], b[keep]
            keep = self.possible(depth, a, b)
            a, b = a[keep], b[keep]
            if not len(a):
                continue
            if not depth:
                yield self.order[a], self.order[b]
                continue
            fan, width = self.widths[depth] // self.widths[depth - 1], len(self.levels[depth - 1]["lo"])
            step = np.arange(fan)
            x = np.repeat(a[:, None] * fan + step, fan, axis=1).ravel()
            y = np.tile(b[:, None] * fan + step, (1, fan)).ravel()
            inside = (x < width) & (y < width) & (x <= y if depth > 1 else x < y)
            x, y = x[inside], y[inside]
            todo += [(depth - 1, x[at : at + CHUNK], y[at : at + CHUNK]) for at in range(0, len(x), CHUNK)]


def with_partner(n: np.ndarray, comp: np.ndarray, side: np.ndarray, maps: list[np.ndarray], percent: int) -> np.ndarray:
    """Which members have a possible partner, from bitmaps alone."""
    found = np.zeros(len(n), dtype=bool)
    for a, b in Tree(n, comp, side, folded(maps), percent).pairs(found):
        found[a] = found[b] = True
    return found


class Overlaps:
    """Sizes of intersections of one set with many, over hashes numbered within the group."""

    def __init__(self, sets: list[np.ndarray]):
        self.ends = np.cumsum([len(s) for s in sets])
        values, self.ids = np.unique(np.concatenate(sets), return_inverse=True)
        self.mark = np.zeros(len(values), dtype=bool)

    def shared(self, one: int, many: np.ndarray) -> np.ndarray:
        starts = np.where(many > 0, self.ends[many - 1], 0)
        sizes = self.ends[many] - starts
        upto = np.cumsum(sizes)
        at = np.repeat(starts - (upto - sizes), sizes) + np.arange(upto[-1])
        own = self.ids[self.ends[one - 1] if one else 0 : self.ends[one]]
        self.mark[own] = True
        counts = np.add.reduceat(self.mark[self.ids[at]].astype(np.int64), upto - sizes)
        self.mark[own] = False
        return counts


def spanning_links(n: np.ndarray, comp: np.ndarray, side: np.ndarray, sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Links (indexes of members) that join all components which the members' links join, one fewer than the components of each."""
    label = np.unique(comp, return_inverse=True)[1]
    overlaps = Overlaps(sets)
    found: list[tuple[int, int]] = []

    def compare(one: int, many: np.ndarray) -> None:
        many = many[label[many] != label[one]]
        if not len(many):
            return
        hit = many[linked(n[one], n[many], overlaps.shared(one, many), percent)]
        for other in hit[np.unique(label[hit], return_index=True)[1]].tolist():
            found.append((one, other))
            label[label == label[other]] = label[one]

    # the first member joins most of a group of near copies, so that the tree holds whole branches of one component
    compare(0, np.flatnonzero(side != side[0]) if side.any() else np.arange(1, len(n)))
    for a, b in Tree(n, label.copy(), side, folded([bitmap(s) for s in sets]), percent).pairs():
        keep = label[a] != label[b]
        a, b = a[keep], b[keep]
        order = np.argsort(a, kind="stable")
        a, b = a[order], b[order]
        for few in np.split(np.arange(len(a)), run_starts(a)[1:]) if len(a) else []:
            compare(int(a[few[0]]), b[few])
    return found


def frequent_hashes(docs: DataFrame, size: int) -> np.ndarray:
    """Sorted hashes that occur in many documents of the sample."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                sets = [np.zeros(0, np.uint64), *(shingle_set(t, size) for t in part.column("text").to_pylist())]
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(sets).view(np.int64))], ["hash"])

    sample = docs.where(F.pmod(F.xxhash64("doc_id", F.length("text")), F.lit(SAMPLE)) == 0).select("text")
    seen = sample.mapInArrow(run, "hash long").groupBy("hash").count().where(F.col("count") >= MIN_SEEN)
    most = seen.orderBy(F.col("count").desc(), "hash").limit(MAX_FREQUENT).select("hash").toArrow()
    return np.sort(most.column("hash").to_numpy().astype(np.int64).view(np.uint64))


def signatures(docs: DataFrame, size: int, percent: int, row: Column) -> DataFrame:
    """row, doc_id, node (the set's name; null for an empty set), n, slot, routes, map of every document; routes and map are
    there once a task for each set, so a large group of copies weighs as many sets as it has tasks."""
    frequent = docs.sparkSession.sparkContext.broadcast(frequent_hashes(docs, size))
    edges = slot_edges(percent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            for part in slices(batch):
                rows = []
                for text in part.column("text").to_pylist():
                    own = shingle_set(text, size)
                    node = set_id(own) if len(own) else None
                    if node is None or node in seen:
                        rows.append((node, len(own), None, None, None))
                        continue
                    seen.add(node)
                    slot, ways = routes(prefix(own, frequent.value, percent), len(own), percent, edges)
                    rows.append((node, len(own), slot, ways, bitmap(own).tobytes()))
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.binary())
                columns = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([part.column("row"), part.column("doc_id"), *columns], ["row", "doc_id", "node", "n", "slot", "routes", "map"])

    rows = docs.select(row.alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(run, "row long, doc_id long, node long, n long, slot long, routes array<long>, map binary")


def groups(signed: DataFrame, classes: DataFrame) -> DataFrame:
    """grp, hub, node, n: the classes that meet in the routes of one slot whose least class is hub."""
    ways = signed.select("node", F.explode("routes").alias("way"))
    ways = ways.select("node", F.shiftright("way", 2).alias("route"), F.col("way").bitwiseAND(F.lit(OWN | SMALL)).cast("byte").alias("role"))
    live = ways.groupBy("route").agg(F.min("node").alias("hub"), F.max("node").alias("last"), F.bit_or("role").alias("roles"))
    live = live.where((F.col("hub") < F.col("last")) & (F.col("roles") == OWN | SMALL)).select("route", "hub")
    met = ways.join(live, "route").select("hub", "node", F.col("role").bitwiseAND(F.lit(OWN)).alias("own")).distinct()
    place = F.col("slot") + 1 - F.col("own")  # the slot of the route: its own members' one
    return met.join(classes, "node").select(F.xxhash64("hub", place).alias("grp"), "hub", "node", "n")


def fetch_sets(docs: DataFrame, wanted: DataFrame, size: int) -> DataFrame:
    """node, hashes (8 bytes each) of the wanted classes (node, doc_id). A broadcast filter of fixed size keeps most other
    documents from being hashed; the join after it is exact."""
    spark = docs.sparkSession
    doc_id = F.col("doc_id").cast("long")
    slot = F.shiftrightunsigned(F.xxhash64(doc_id), 64 - FILTER_BITS)
    masks = wanted.where("doc_id is not null").select(slot.alias("slot")).groupBy(F.shiftright("slot", 6).alias("word"))
    bits = np.zeros(1 << (FILTER_BITS - 6), dtype=np.int64)
    found = masks.agg(F.bit_or(F.expr("shiftleft(1L, int(slot & 63))")).alias("mask")).toArrow()
    bits[found.column("word").to_numpy()] = found.column("mask").to_numpy()
    table = spark.sparkContext.broadcast(bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            slots = batch.column("slot").to_numpy(zero_copy_only=False)
            hit = (table.value[slots >> 6] >> (slots & 63)) & 1 == 1
            hit |= batch.column("no_id").to_numpy(zero_copy_only=False)
            for part in slices(batch.select(["text"]).filter(pa.array(hit))):
                sets = {}
                for text in part.column("text").to_pylist():
                    own = shingle_set(text, size)
                    if len(own):
                        sets[set_id(own)] = own.tobytes()
                yield pa.RecordBatch.from_arrays([pa.array(list(sets), pa.int64()), pa.array(list(sets.values()), pa.binary())], ["node", "hashes"])

    found = docs.select(slot.alias("slot"), doc_id.isNull().alias("no_id"), "text").mapInArrow(run, "node long, hashes binary")
    return found.join(wanted.select("node").distinct(), "node", "left_semi").groupBy("node").agg(F.first("hashes").alias("hashes"))


def by_unit(rows: DataFrame, column: str, answer, kinds: str) -> DataFrame:
    """rows: unit, side, comp, node, n and a binary column of 64-bit words. answer gets each unit's rows (node, n, comp, side, the
    words) whole and returns the columns of its result; a unit is as much as a task holds."""
    names = [x.split()[0] for x in kinds.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []  # rows of the unit that may go on

        def joined(parts: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            part = pa.Table.from_batches(parts).combine_chunks()
            node, n, comp, side = (part.column(c).to_numpy() for c in ("node", "n", "comp", "side"))
            if len(node) > 1 and (comp != comp[0]).any():
                words = [np.frombuffer(x.as_buffer(), "<u8") for x in part.column(column)]
                found = answer(part.column("unit")[0].as_py(), node, n, comp, side, words)
                if len(found[0]):
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in found], names)

        for batch in batches:
            if not batch.num_rows:
                continue
            unit = batch.column("unit").to_numpy(zero_copy_only=False)
            starts = run_starts(unit).tolist()
            if held and unit[0] != held[-1].column("unit")[0].as_py():
                yield from joined(held)
                held = []
            for a, b in zip(starts, starts[1:], strict=False):
                yield from joined([*held, batch.slice(a, b - a)])
                held = []
            held.append(batch.slice(starts[-1]))
        if held:
            yield from joined(held)

    dealt = rows.select("unit", "side", "comp", "node", "n", column).repartition("unit").sortWithinPartitions("unit", "side", "n", "node")
    return dealt.mapInArrow(run, kinds)


def tree_links(units: DataFrame, maps: DataFrame, classes: DataFrame, docs: DataFrame, size: int, percent: int, stage: Callable[..., DataFrame]) -> DataFrame:
    """a, b: links that span the components of every unit. units: unit, side, comp, node, n; maps: node, map."""

    def possible(unit, node, n, comp, side, words):
        keep = np.flatnonzero(with_partner(n, comp, side, words, percent))
        return [np.full(len(keep), unit), node[keep]]

    def link(unit, node, n, comp, side, words):
        found = np.array(spanning_links(n, comp, side, words, percent), dtype=np.int64).reshape(-1, 2)
        return [node[found[:, 0]], node[found[:, 1]]]

    open_ = stage(by_unit(units.join(maps, "node"), "map", possible, "unit long, node long"), "join-open")
    wanted = stage(classes.join(open_.select("node").distinct(), "node", "left_semi").select("node", "doc_id"), "join-wanted")
    rows = units.join(open_, ["unit", "node"]).join(fetch_sets(docs, wanted, size), "node")
    return stage(by_unit(rows, "hashes", link, "a long, b long"), "join-links")


def join_components(labels: DataFrame, links: DataFrame, stage: Callable[..., DataFrame] = stage) -> DataFrame:
    """labels (node, comp) after links (a, b): components that a link joins get their least name. Every step takes the least
    component over a link and then jumps to the component's own; it ends when nothing changes."""
    edges = links.join(labels.select(F.col("node").alias("a"), F.col("comp").alias("x")), "a").join(labels.select(F.col("node").alias("b"), F.col("comp").alias("y")), "b")
    edges = edges.where("x <> y").select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).distinct()
    edges = stage(edges.select("x", "y").unionByName(edges.select(F.col("y").alias("x"), F.col("x").alias("y"))), "join-edges")
    best = edges.groupBy("x").agg(F.least(F.col("x"), F.min("y")).alias("to"))
    best = stage(best, "join-step")
    while True:
        near = edges.join(best.select(F.col("x").alias("y"), F.col("to").alias("near")), "y").groupBy("x").agg(F.min("near").alias("near"))
        step = best.join(near, "x").select("x", F.least("to", "near").alias("new"), "to")
        step = step.join(best.select(F.col("x").alias("new"), F.col("to").alias("jump")), "new", "left")
        step = stage(step.select("x", F.least("new", "jump").alias("to"), (F.least("new", "jump") != F.col("to")).alias("moved")), "join-step")
        best = step.select("x", "to")
        if not step.where("moved").limit(1).count():
            break
    joined = labels.join(best.select(F.col("x").alias("comp"), "to"), "comp", "left")
    return stage(joined.select("node", F.coalesce("to", "comp").alias("comp")), "join-labels")


def block(blocks: Column) -> Column:
    """The block of a class, of so many."""
    return F.pmod(F.xxhash64("node", F.lit("block")), blocks)


def block_count(hashes: Column) -> Column:
    return F.ceil(hashes / BLOCK_HASHES)


def first_units(members: DataFrame) -> DataFrame:
    """unit, side, comp, node, n: members by block of their group; the hub is in every block."""
    own = F.when(F.col("node") == F.col("hub"), F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).otherwise(F.array(block(F.col("blocks"))))
    rows = members.select("grp", "node", "n", F.explode(own).alias("block"))
    return rows.select(F.xxhash64("grp", "block").alias("unit"), F.lit(0).cast("long").alias("side"), F.col("node").alias("comp"), "node", "n")


def second_units(members: DataFrame, labels: DataFrame) -> DataFrame:
    """unit, side, comp, node, n: for groups of several blocks, the classes outside the group's largest component (the few), in
    blocks, beside each other and beside every block of the rest."""
    long_ = members.where("blocks > 1").join(labels, "node")
    largest = long_.groupBy("grp", "comp").agg(F.count(F.lit(1)).alias("classes"), F.sum("n").alias("hashes"))
    largest = largest.groupBy("grp").agg(F.max(F.struct("classes", "comp")).alias("top"), F.sum("hashes").alias("every"), F.max_by("hashes", F.struct("classes", "comp")).alias("in_top"))
    sized = largest.select("grp", F.col("top.comp").alias("top"), block_count(F.col("every") - F.col("in_top")).alias("few"), F.greatest(block_count(F.col("in_top")), F.lit(1)).alias("many"))
    rows = long_.join(sized.where("few > 0"), "grp")
    upto = lambda c: F.sequence(F.lit(0).cast("long"), F.col(c) - 1)
    few = rows.where("comp <> top").withColumn("block", block(F.col("few")))
    among = few.withColumn("other", F.explode(upto("few"))).select(
        F.xxhash64("grp", F.lit("few"), F.least("block", "other"), F.greatest("block", "other")).alias("unit"), F.when(F.col("block") == F.col("other"), F.lit(0)).otherwise(F.col("block") + 1).cast("long").alias("side"), "comp", "node", "n"
    )
    beside = few.withColumn("other", F.explode(upto("many"))).select(F.xxhash64("grp", F.lit("many"), "block", "other").alias("unit"), F.lit(1).cast("long").alias("side"), "comp", "node", "n")
    many = rows.where("comp = top").withColumns({"block": block(F.col("many")), "other": F.explode(upto("few"))}).select(F.xxhash64("grp", F.lit("many"), "other", "block").alias("unit"), F.lit(2).cast("long").alias("side"), "comp", "node", "n")
    return among.unionByName(beside).unionByName(many)


def jaccard_components(docs: DataFrame, size: int = SIZE, percent: int = PERCENT, row: Column | None = None) -> DataFrame:
    """doc_id, n_shingles, component_id, row of every document; percent is from 1 to 99. row is a column of docs, a different
    long in each document; without one it is the document's number in this one scan, which says nothing about any other scan
    of docs. The answer is a written table; what was written on the way to it is removed."""
    with Scratch(docs.sparkSession) as scratch:
        signed = scratch.stage(signatures(docs, size, percent, F.monotonically_increasing_id() if row is None else row), "join-signatures")
        return stage(components_of(signed, docs, size, percent, scratch.stage), "join-components")


def components_of(signed: DataFrame, docs: DataFrame, size: int, percent: int, stage: Callable[..., DataFrame]) -> DataFrame:
    full = signed.where("node is not null")
    classes = stage(full.groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.max("n").alias("n"), F.max("slot").alias("slot")), "join-classes")
    members = stage(groups(full, classes), "join-groups")
    weights = members.groupBy("grp").agg(block_count(F.sum("n")).alias("blocks"))
    members = stage(members.join(weights, "grp"), "join-members")
    met = members.select("node").distinct()
    maps = full.where("map is not null").join(met, "node", "left_semi").groupBy("node").agg(F.first("map").alias("map"))
    labels = met.withColumn("comp", F.col("node"))
    labels = join_components(labels, tree_links(first_units(members), maps, classes, docs, size, percent, stage), stage)
    if members.where("blocks > 1").limit(1).count():
        units = stage(second_units(members, labels), "join-units")
        labels = join_components(labels, tree_links(units, maps, classes, docs, size, percent, stage), stage)
    named = classes.select("node", "doc_id").join(labels, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    least = named.groupBy("comp").agg(F.min("doc_id").alias("component_id"))
    named = named.select("node", "comp").join(least, "comp").select("node", "component_id")
    rows = signed.select("doc_id", F.col("n").alias("n_shingles"), "node", "row").join(named, "node", "left")
    return rows.select("doc_id", "n_shingles", F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"), "row")
