"""Jaccard self-join of shingle sets, heavy-light by size, and the components of its links.

Two sets of sizes a <= b link when 100 * |intersection| >= 80 * |union|, that is from ceil(4(a + b) / 9) common members
on. Light pairs (b up to a boundary chosen by cost) are found by enumerating the subsets of just that size: a common
subset is a link. For heavy pairs the hash space is cut into more parts than a linked pair can differ in; some part is
then equal and not empty, and the parts' contents are the keys of inverted lists.

Lists can be long. Each is first read once against its least member only, which is linear; what is verified joins a
component, and only lists that still hold several components go on. Of these, sets are set aside that share fewer lists
with others than any link needs, or too few shingles: a link's common members are shingles that both sets share with
somebody. What is left is read against the most central member of each list, the one whose shingles are the commonest
there, until that links nothing new; near copies of one text meet in it. Pairs across components that may still link by
sizes, shared shingles and shared lists are then compared. So every link between components is verified.
"""

from __future__ import annotations

from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veneer.llm.common import scratch_path, table
from veneer.llm.id_filter import IdFilter, likely
from veneer.llm.shingles import mixed, shingle_set, shingle_sets

#: Sizes up to here may become light, if enumeration is cheaper there.
LIGHT_LIMIT = 24
#: So many ids are sent to all tasks as they are; more are sent as a filter, behind which a join must follow.
FEW_IDS = 200_000
#: Entries of inverted lists that a task holds at a time; it then sorts them, which takes some 150 bytes for each.
_FLUSH = 120_000
#: Each class of heavy sizes reaches so many times as far as the one before.
STEP = 1.6
def needed(a: int, b: int) -> int:
    """Common members from which on sets of these sizes link."""
    return -(-4 * (a + b) // 9)


def _stored(df: DataFrame) -> DataFrame:
    """A table below the shared folder instead of `df`: its size is known, so what it is joined with need not be guessed."""
    path = scratch_path(df.sparkSession, "jaccard")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def linked(x: np.ndarray, y: np.ndarray) -> bool:
    if not len(x) or not len(y):
        return False
    common = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * common >= 80 * (len(x) + len(y) - common)


def size_classes(largest: int) -> list[tuple[int, int]]:
    """(least, largest) sizes of the greater set of a pair, as far as `largest`."""
    classes, low = [], 1
    while low <= largest:
        high = max(low, int(low * STEP))
        classes.append((low, high))
        low = high + 1
    return classes


def parts_of(high: int) -> tuple[int, int]:
    """(differences a linked pair can have, parts). A few parts more than differences outweigh empty parts."""
    most = 2 * high // 9
    return most, most + 3 + most // 16


def light_partners(n: int, light: int) -> list[tuple[int, int]]:
    """Sizes (a, b) of light pairs in which a set of size n takes part; equal sets are one class already."""
    return [(min(n, m), max(n, m)) for m in range(-(-4 * n // 5), min(light, 5 * n // 4) + 1)
            if not (m == n and needed(n, n) == n)]


def n_keys(n: int, light: int) -> int:
    """Keys a set of size n has when sizes up to `light` are light."""
    keys = sum(comb(n, needed(a, b)) for a, b in light_partners(n, light)) if n <= light else 0
    reach = 5 * n // 4
    return keys + sum(parts_of(high)[1] for _, high in size_classes(reach) if high >= n and high > light)


def choose_boundary(counts: dict[int, int]) -> int:
    """The light boundary with the fewest keys in all, given how many sets have each size up to LIGHT_LIMIT."""
    cost = lambda s: sum(c * n_keys(n, s) for n, c in counts.items())
    return min(range(LIGHT_LIMIT + 1), key=lambda s: (cost(s), s))


def _parts(spread: np.ndarray, parts: int) -> np.ndarray:
    return ((spread >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)


def empty_parts(s: np.ndarray) -> int:
    """Empty parts of a set in the class of its size."""
    parts = parts_of(size_classes(len(s))[-1][1])[1] if len(s) else 0
    return parts - len(np.unique(_parts(mixed(s), parts)))


def list_keys(s: np.ndarray, light: int) -> np.ndarray:
    """Keys of the inverted lists that hold the set `s` (sorted, distinct)."""
    n, out = len(s), []
    if n <= light:
        for a, b in light_partners(n, light):
            c = needed(a, b)
            salt = np.uint64((a << 32) + (b << 16) + 1)
            chosen = np.array([s[list(i)].sum(dtype=np.uint64) for i in combinations(range(n), c)], np.uint64)
            out.append(mixed(mixed(chosen) + salt))
    reach = 5 * n // 4
    spread = mixed(s)
    for low, high in size_classes(reach):
        if high < n or high <= light:
            continue
        most, parts = parts_of(high)
        part = _parts(spread, parts)
        content = np.zeros(parts, np.uint64)
        np.add.at(content, part, spread)
        filled = np.zeros(parts, bool)
        filled[part] = True
        salt = np.uint64(low << 32) + np.arange(parts, dtype=np.uint64)
        keys = mixed(mixed(content) + salt)
        # equal parts number parts - differences at least; only if all of them may be empty do empty parts count as keys
        if parts - np.count_nonzero(filled) >= parts - min(most, n // 4):
            out.append(keys)
        else:
            out.append(keys[filled])
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def _class_of(n: np.ndarray, reach: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Least and largest sizes of the classes as far as `reach`, and the class of each size."""
    low, high = np.array(size_classes(max(1, reach)), np.int64).T
    return low, high, np.searchsorted(high, n)


def _filled(spread: np.ndarray, at: np.ndarray, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of sets end to end, each dealt into a number of parts of its own: where each set's parts begin, the parts of its
    members and which are filled."""
    base = np.append(0, np.cumsum(parts))
    sizes = np.diff(at)
    part = ((spread >> np.uint64(32)) * np.repeat(parts, sizes).astype(np.uint64) >> np.uint64(32)).astype(np.int64) + np.repeat(base[:-1], sizes)
    filled = np.zeros(base[-1], bool)
    filled[part] = True
    return base, part, filled


def _empty_parts_of(sets: np.ndarray, at: np.ndarray) -> np.ndarray:
    """`empty_parts` of sets that lie end to end, set i from at[i] to at[i + 1]."""
    n = np.diff(at)
    _, high, own = _class_of(n, int(n.max(initial=0)))
    parts = np.where(n > 0, np.array([parts_of(h)[1] for h in high.tolist()])[own], 0)
    base, _, filled = _filled(mixed(sets), at, parts)
    return np.diff(base) - np.diff(np.append(0, np.cumsum(filled))[base])


def list_keys_of(sets: np.ndarray, at: np.ndarray, light: int) -> tuple[np.ndarray, np.ndarray]:
    """`list_keys` of sets that lie end to end, set i from at[i] to at[i + 1]: the number of the set, and a key."""
    n = np.diff(at)
    of, keys = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
    for i in np.flatnonzero((n > 0) & (n <= light)).tolist():
        keys.append(list_keys(sets[at[i]:at[i + 1]], light))
        of.append(np.full(len(keys[-1]), i))
    low, high, own = _class_of(n, 5 * int(n.max(initial=0)) // 4)
    most, parts_in = np.array([parts_of(h) for h in high.tolist()], np.int64).T
    last = np.searchsorted(high, 5 * n // 4)
    spread, heavy, step = mixed(sets), n > light, 0
    while len(which := np.flatnonzero(heavy & (own + step <= last))):
        inside = np.zeros(len(n), bool)
        inside[which] = True
        klass, size = own[which] + step, n[which]
        parts, mine = parts_in[klass], spread[np.repeat(inside, n)]
        base, part, filled = _filled(mine, np.append(0, np.cumsum(size)), parts)
        content = np.zeros(base[-1], np.uint64)
        np.add.at(content, part, mine)
        place = np.arange(base[-1]) - np.repeat(base[:-1], parts)
        key = mixed(mixed(content) + np.repeat(low[klass].astype(np.uint64) << np.uint64(32), parts) + place.astype(np.uint64))
        # equal parts number parts - differences at least; only if all of them may be empty do empty parts count as keys
        listed = filled | np.repeat(np.diff(np.append(0, np.cumsum(filled))[base]) <= np.minimum(most[klass], size // 4), parts)
        of.append(np.repeat(which, parts)[listed])
        keys.append(key[listed])
        step += 1
    which, key = np.concatenate(of), np.concatenate(keys)
    order = np.argsort(which, kind="stable")
    return which[order], key[order]


def _marks(sets: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes of each set."""
    one = np.append(np.uint64(0), np.cumsum(mixed(sets + np.uint64(7)), dtype=np.uint64))
    two = np.append(np.uint64(0), np.cumsum(mixed(sets ^ np.uint64(0x5851F42D4C957F2D)), dtype=np.uint64))
    return np.diff(one[at]).view(np.int64), np.diff(two[at]).view(np.int64)


def _profile(docs: DataFrame, size: int) -> DataFrame:
    """rid, size of the set, its empty parts and two hashes of it."""
    def run(batches):
        for batch in batches:
            for first, sets, at in shingle_sets(batch.column("text"), size):
                a, b = _marks(sets, at)
                yield pa.RecordBatch.from_arrays([batch.column("rid").slice(first, len(a)), pa.array(np.diff(at).astype(np.int32)),
                                                  pa.array(_empty_parts_of(sets, at).astype(np.int32)), pa.array(a), pa.array(b)],
                                                 ["rid", "n", "empty", "h1", "h2"])

    return docs.mapInArrow(run, "rid long, n int, empty int, h1 long, h2 long")


def _least_shared(light: int, a, b, empty, largest: int):
    """Lists that linked sets of sizes a <= b share at least (columns); `empty` counts the greater set's empty parts, no
    set has more than `largest` members."""
    parts = F.lit(0)
    for low, high in size_classes(largest):
        parts = F.when(b >= low, parts_of(high)[1]).otherwise(parts)
    return F.when(b <= light, 1).otherwise(F.greatest(F.lit(1), parts - F.floor((a + b) / 9) - empty))


_LISTS = "key long, spread long, rid long, leader long"


def _members(docs: DataFrame, light: int, size: int) -> DataFrame:
    """The inverted lists, read against a leader within each batch already.

    A row with spread 0 is a list's first member of a batch; the batch's other members have that one as leader and a
    spread of their own, so a list that holds a third of all documents comes together with one row per batch only.
    """
    def run(batches):
        for batch in batches:
            rid = batch.column("rid").to_numpy()
            keys, ids, held = [], [], 0
            for first, sets, at in shingle_sets(batch.column("text"), size):
                which, own = list_keys_of(sets, at, light)
                keys.append(own)
                ids.append(rid[first + which])
                held += len(own)
                if held > _FLUSH:
                    yield _local_lists(np.concatenate(keys), np.concatenate(ids))
                    keys, ids, held = [], [], 0
            if held:
                yield _local_lists(np.concatenate(keys), np.concatenate(ids))

    return docs.mapInArrow(run, _LISTS)


def _local_lists(keys: np.ndarray, ids: np.ndarray) -> pa.RecordBatch:
    lists, first, which, count = np.unique(keys.view(np.int64), return_index=True, return_inverse=True, return_counts=True)
    zero = np.zeros(len(lists), np.int64)
    several = count[which] > 1  # the leader itself is among them
    rid, leader = ids[several], ids[first][which][several]
    spread = (mixed(rid.view(np.uint64)) | np.uint64(1)).view(np.int64)
    columns = (lists, keys.view(np.int64)[several]), (zero, spread), (ids[first], rid), (zero, leader)
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in columns], ["key", "spread", "rid", "leader"])


def _leaders(members: DataFrame) -> DataFrame:
    """key, rid, leader of lists with several members; the leader is the least of the batches' first members.

    Lists stream by in order of key, so their length needs no memory.
    """
    ordered = members.repartition("key", "spread").sortWithinPartitions("key", "spread", "rid")

    def run(batches):
        last_key = last_leader = None
        last_listed = False
        for batch in batches:
            key, spread, rid, leader = (batch.column(c).to_numpy() for c in ("key", "spread", "rid", "leader"))
            local = spread != 0
            done = key[local], rid[local], leader[local]
            key, rid = key[~local], rid[~local]
            if not len(key):
                yield _pairs(*[[x] for x in done])
                continue
            new = np.concatenate(([key[0] != last_key], key[1:] != key[:-1]))
            start = np.flatnonzero(new)
            run_of = np.cumsum(new) - 1  # -1: the list that goes on from the batch before
            leaders = np.concatenate(([0 if new[0] else last_leader], rid[start]))[run_of + 1]
            follows = rid != leaders
            # a leader is listed with its list, once, as soon as the list has a second member
            runs = np.unique(run_of[follows])
            mine = runs[runs >= 0]
            own = [(key[start[mine]], rid[start[mine]])]
            if len(runs) and runs[0] == -1 and not last_listed:
                own.append((np.array([last_key]), np.array([last_leader])))
                last_listed = True
            if run_of[-1] >= 0:
                last_listed = bool(len(mine)) and mine[-1] == run_of[-1]
            last_key, last_leader = key[-1], leaders[-1]
            yield _pairs([done[0], key[follows], *[o[0] for o in own]], [done[1], rid[follows], *[o[1] for o in own]],
                         [done[2], leaders[follows], *[o[1] for o in own]])

    return ordered.mapInArrow(run, "key long, rid long, leader long")


def _pairs(*columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c), pa.int64()) for c in columns], ["key", "rid", "leader"])


def _among(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows of `docs` whose rid is among `ids`; of more than FEW_IDS ids also a few others."""
    ids = _stored(ids.distinct())
    if ids.count() <= FEW_IDS:
        return docs.join(F.broadcast(ids), "rid", "left_semi")  # FEW_IDS numbers at most
    return likely(docs, ids)


def _verified(pairs: DataFrame, docs: DataFrame, size: int) -> DataFrame:
    """Those pairs (rid, leader) whose sets link. Only texts of named documents move; the leader's comes last."""
    named = _among(docs, pairs.select("rid").union(pairs.select(F.col("leader").alias("rid"))))
    one = pairs.join(named, "rid").withColumnRenamed("text", "left_text")
    both = one.join(named.select(F.col("rid").alias("leader"), F.col("text").alias("right_text")), "leader")

    def run(batches):
        known: dict[int, np.ndarray] = {}  # sets of ids met before, as far as some megabytes go
        held = 0
        for batch in batches:
            keep = []
            for names, texts in zip(zip(batch.column("leader").to_pylist(), batch.column("rid").to_pylist()),
                                    zip(batch.column("right_text").cast(pa.binary()), batch.column("left_text").cast(pa.binary()))):
                both_sets = []
                for name, text in zip(names, texts):
                    own = known.get(name)
                    if own is None:
                        own = shingle_set(text.as_buffer(), size)
                        if held > 4_000_000:
                            known, held = {}, 0
                        known[name] = own
                        held += len(own)
                    both_sets.append(own)
                keep.append(linked(*both_sets))
            yield batch.select(["rid", "leader"]).filter(pa.array(keep, pa.bool_()))

    return both.select("rid", "leader", "left_text", "right_text").mapInArrow(run, "rid long, leader long")


def components(links: DataFrame) -> DataFrame:
    """rid, component (least rid reachable) of all linked ids, by min-label steps with pointer jumps.

    Labels only fall; the loop ends when a step changes none. `links` has rid, leader.
    """
    both = _stored(links.select("rid", "leader").union(links.select("leader", "rid")).filter("rid <> leader").distinct())
    labels = _stored(both.groupBy("rid").agg(F.least(F.min("leader"), F.first("rid")).alias("component")))
    while True:
        own = labels.select("rid", "component", F.col("component").alias("was"))
        near = both.join(labels.select(F.col("rid").alias("leader"), "component"), "leader").select("rid", "component", F.lit(None).cast("long").alias("was"))
        stepped = near.union(own).groupBy("rid").agg(F.min("component").alias("low"), F.max("was").alias("was"))
        jump = labels.select(F.col("rid").alias("low"), F.col("component").alias("far"))
        low = F.coalesce(F.least("low", "far"), "low")
        new = _stored(stepped.join(jump, "low", "left").select("rid", low.alias("component"), (low != F.col("was")).alias("moved")))
        if new.filter("moved").isEmpty():
            return new.select("rid", "component")
        labels = new.select("rid", "component")


def _joined(found: DataFrame, links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """`found` (rid, component of all ids) once `links` (rid, leader) between them are added, and (old, component) of the
    components that are now part of another."""
    ends = links.join(found.withColumnRenamed("component", "a"), "rid").select("leader", "a")
    ends = ends.join(found.select(F.col("rid").alias("leader"), F.col("component").alias("b")), "leader")
    into = components(ends.select(F.col("a").alias("rid"), F.col("b").alias("leader"))).filter("rid <> component").withColumnRenamed("rid", "old")
    moved = found.join(into.select(F.col("old").alias("component"), F.col("component").alias("into")), "component", "left")
    return _stored(moved.select("rid", F.coalesce("into", "component").alias("component"))), into


def _shingle_rows(docs: DataFrame, ids: DataFrame, size: int) -> DataFrame:
    """rid, s: the shingles of some documents."""
    def run(batches):
        for batch in batches:
            rid = batch.column("rid").to_numpy()
            for first, sets, at in shingle_sets(batch.column("text"), size):
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(rid[first:first + len(at) - 1], np.diff(at))), pa.array(sets.view(np.int64))], ["rid", "s"])

    return _among(docs, ids).join(ids, "rid").select("rid", "text").mapInArrow(run, "rid long, s long")


def _several(rows: DataFrame) -> DataFrame:
    """Those of `rows` (key, rid, mine: the component of rid) whose list holds several components."""
    keys = rows.groupBy("key").agg(F.min("mine").alias("low"), F.max("mine").alias("high")).filter("low < high").select("key")
    return _stored(rows.join(keys, "key").distinct())


class _Lists:
    """What is known of the sets (rid, n, empty) that the lists hold."""

    def __init__(self, sized: DataFrame, light: int):
        self.sized, self.light = sized, light
        self.largest = sized.agg(F.max("n")).first()[0] or 1

    def least_lists(self) -> DataFrame:
        """n, t: lists that a set of this size shares with any set it links with, at least."""
        most_empty = {r["n"]: r["empty"] for r in self.sized.groupBy("n").agg(F.max("empty").alias("empty")).collect()}  # a row per size
        surely = {b: parts_of(size_classes(b)[-1][1])[1] - e for b, e in most_empty.items()}
        sizes = sorted(surely)
        ends = np.searchsorted(sizes, [5 * n // 4 for n in sizes], "right")
        rows = [(n, 1 if n <= self.light else max(1, min(surely[b] - (n + b) // 9 for b in sizes[k:end]))) for k, (n, end) in enumerate(zip(sizes, ends))]
        return self.sized.sparkSession.createDataFrame(rows or [(0, 1)], "n int, t int")

    def enough(self, counted: DataFrame, share: float) -> DataFrame:
        """(rid, leader, shared) pairs that share `share` of the lists that linked sets share at least, or more."""
        both = (counted.join(self.sized, "rid").withColumnsRenamed({"n": "an", "empty": "ae"})
                .join(self.sized.withColumnRenamed("rid", "leader"), "leader"))
        return both.filter((5 * F.least("an", "n") >= 4 * F.greatest("an", "n"))
                           & (F.col("shared") >= share * self.needed(("an", "ae"), ("n", "empty")))).select("rid", "leader")

    def needed(self, x: tuple[str, str], y: tuple[str, str]):
        """Lists that sets of (size, empty parts) x and y share at least if they link."""
        (an, ae), (bn, be) = x, y
        empty = F.when(F.col(an) == F.col(bn), F.greatest(ae, be)).when(F.col(an) > F.col(bn), F.col(ae)).otherwise(F.col(be))
        return _least_shared(self.light, F.least(an, bn), F.greatest(an, bn), empty, self.largest)


def _met(rows: DataFrame, weights: DataFrame) -> DataFrame:
    """(rid, leader, shared): members of other components with the most central member of each list."""
    led = rows.join(weights, "rid")
    central = led.groupBy("key").agg(F.max(F.struct("centre", "rid", "mine")).alias("first"))
    pairs = led.join(central, "key").filter("mine <> first.mine")
    return pairs.groupBy(F.greatest("rid", "first.rid").alias("rid"), F.least("rid", "first.rid").alias("leader")).agg(F.count(F.lit(1)).alias("shared"))


def _links_across(listed: DataFrame, found: DataFrame, tried: DataFrame, docs: DataFrame, lists: _Lists, size: int) -> DataFrame:
    """rid, component once the links between the components of `found` (rid, component of all sets) are added."""
    rows = _several(listed.select("key", "rid").join(found.withColumnRenamed("component", "mine"), "rid"))
    least = F.broadcast(lists.least_lists())  # a row per set size
    # sets that share too few lists with others
    alive = rows.groupBy("rid").agg(F.count(F.lit(1)).alias("k")).join(lists.sized, "rid").join(least, "n").filter("k >= t").select("rid")
    rows = _several(rows.join(alive, "rid"))
    if rows.isEmpty():
        return found
    weighed = _stored(rows.select("rid").distinct())
    shingles = _stored(_shingle_rows(docs, weighed, size))
    # sets most of whose shingles nobody else has
    common = shingles.groupBy("s").agg(F.count(F.lit(1)).alias("df")).filter("df > 1")
    weights = shingles.join(common, "s").groupBy("rid").agg(F.count(F.lit(1)).cast("int").alias("m"), F.sum("df").alias("sum"))
    weights = _stored(weights.join(lists.sized, "rid").filter("10 * m >= 8 * n").select("rid", "n", "m", "empty", (F.col("sum") / F.col("n")).alias("centre")))
    rows = _several(rows.join(weights.select("rid"), "rid"))
    while True:
        # sharing half of the lists that links surely share is enough to be tried: a member is central in some of them only
        new = _stored(lists.enough(_met(rows, weights.select("rid", "centre")), 0.5).join(tried, ["leader", "rid"], "left_anti"))
        fresh = _stored(_verified(new, docs, size))
        tried = tried.unionByName(new)
        if fresh.isEmpty():
            break
        found, into = _joined(found, fresh)
        renamed = rows.join(into.select(F.col("old").alias("mine"), F.col("component").alias("into")), "mine", "left")
        rows = _several(renamed.select("key", "rid", F.coalesce("into", "mine").alias("mine")))
    main = rows.groupBy("key", "mine").count().groupBy("key").agg(F.max_by("mine", F.struct("count", "mine")).alias("main"))  # a list's largest component
    held = rows.groupBy("rid").agg(F.first("mine").alias("mine"), F.array_sort(F.collect_set("key")).alias("keys"))  # a set's own lists
    family = _stored(rows.join(main, "key").select("rid", "main").distinct().join(held, "rid").join(weights.select("rid", "n", "m", "empty"), "rid"))
    one, other = family.filter("mine <> main").alias("a"), family.alias("b")
    # each pair across components comes from its one outsider, or from the greater of two
    may = F.expr("a.main = b.main AND a.mine <> b.mine AND (b.mine = b.main OR a.rid > b.rid) AND 5 * least(a.n, b.n) >= 4 * greatest(a.n, b.n)"
                 " AND 9 * least(a.m, b.m) >= 4 * (a.n + b.n)")
    share = F.size(F.array_intersect("a.keys", "b.keys")) >= lists.needed(("a.n", "a.empty"), ("b.n", "b.empty"))
    across = one.join(other, may & share).select(F.greatest("a.rid", "b.rid").alias("rid"), F.least("a.rid", "b.rid").alias("leader")).distinct()
    more = _stored(_verified(_stored(across.join(tried, ["leader", "rid"], "left_anti")), docs, size))
    return found if more.isEmpty() else _joined(found, more)[0]


def _first_of_classes(docs: DataFrame, same: DataFrame) -> DataFrame:
    """`docs` without those of equal sets but the class's leader. Only texts of the others move, and a few more."""
    gone = _stored(same.filter("rid <> leader").select("rid"))
    n = gone.count()
    if n <= FEW_IDS:
        return docs.join(F.broadcast(gone), "rid", "left_anti") if n else docs  # FEW_IDS numbers at most
    among = docs.sparkSession.sparkContext.broadcast(IdFilter.of(gone))

    def run(batches):
        for batch in batches:
            yield batch.filter(pa.array(~among.value.passing(batch.column("rid").to_numpy())))

    return docs.mapInArrow(run, docs.schema).unionByName(likely(docs, gone).join(gone, "rid", "left_anti"))


def jaccard_nodes(df: DataFrame, size: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, th (hash of the text), n_shingles, component_id, keep; one row per row.

    A node is an id with a text: rows that repeat both are one node, an id with two texts is two. Null, empty and
    wordless texts have empty sets and link with nothing. component_id is the least id reachable by links (a null id is
    none; null if there is no other). One node of each component has `keep`: that of the least id, of these the least
    text hash; null ids come last. Ids are 64-bit integers. Extra columns are ignored; an empty table gives no rows.
    """
    docs = df.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumn("th", F.xxhash64("text"))
    again = docs.groupBy("doc_id").agg((F.min("th") < F.max("th")).alias("several"), (F.count(F.lit(1)) > 1).alias("again"))
    again = _stored(again.filter("again"))
    several = again.filter("several AND doc_id IS NOT NULL").select("doc_id", "several")
    own = F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("no id")), "text")
    if several.isEmpty():
        docs = docs.withColumn("rid", F.coalesce("doc_id", own))
    else:
        docs = docs.join(several, "doc_id", "left").withColumn("rid", F.when(F.col("several") | F.col("doc_id").isNull(), own).otherwise(F.col("doc_id")))
    narrow = docs.select("rid", "text")
    if not again.isEmpty():  # every node's text once, written as all passes read it
        path = scratch_path(df.sparkSession, "nodes")
        narrow.dropDuplicates(["rid"]).write.parquet(path)
        narrow = df.sparkSession.read.parquet(path)
    ids = docs.select("doc_id", "th", "rid")
    profile = _stored(_profile(narrow, size))
    sets = profile.filter("n > 0")
    counts = {r["n"]: r["count"] for r in sets.filter(F.col("n") <= LIGHT_LIMIT).groupBy("n").count().collect()}
    light = choose_boundary(counts)

    # equal sets are one class, named by the least id, which is listed for all of them
    classes = sets.groupBy("n", "h1", "h2").agg(F.min("rid").alias("leader"), F.max("rid").alias("last")).filter("leader < last").drop("last")
    same = _stored(sets.join(classes, ["n", "h1", "h2"]).select("rid", "leader"))
    listed = _stored(_leaders(_members(_first_of_classes(narrow, same), light, size)))
    lists = _Lists(sets.select("rid", "n", "empty"), light)

    # this first reading only joins what is easily found; it may pass over pairs, as what follows does not
    pairs = _stored(lists.enough(listed.filter("rid <> leader").groupBy("rid", "leader").agg(F.count(F.lit(1)).alias("shared")), 1.0))
    links = _stored(_verified(pairs, narrow, size))
    tried = pairs.select(F.least("rid", "leader").alias("leader"), F.greatest("rid", "leader").alias("rid"))
    found = _stored(sets.select("rid").join(components(links), "rid", "left").select("rid", F.coalesce("component", "rid").alias("component")))
    found = _links_across(listed, found, tried, narrow, lists, size)
    # the others of a class are where its leader is
    class_of = same.select("rid", F.col("leader").alias("of")).join(found.select(F.col("rid").alias("of"), "component"), "of")
    final = found.join(same.select("rid"), "rid", "left_anti").unionByName(class_of.select("rid", "component"))

    nodes = _stored(ids.distinct())
    grouped = nodes.join(final, "rid", "left").withColumn("component", F.coalesce("component", "rid"))
    first = grouped.groupBy("component").agg(F.min("doc_id").alias("component_id"),
                                             F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "th", "rid")).alias("first"))
    chosen = grouped.join(first, "component").select("rid", "component_id", (F.col("first.rid") == F.col("rid")).alias("keep"))
    return (ids.join(profile.select("rid", "n"), "rid").join(chosen, "rid")
            .select("doc_id", "th", F.col("n").cast("long").alias("n_shingles"), "component_id", "keep"))


def jaccard_join(df: DataFrame, size: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id (least id reachable by links, itself included); see `jaccard_nodes`."""
    return jaccard_nodes(df, size, id_col, text_col).select("doc_id", "n_shingles", "component_id")


def query(spark: SparkSession, sf: str) -> DataFrame:
    return jaccard_join(table(spark, sf, "documents"))


QUERIES = {"op8_jaccard_join": query}
ORACLES: dict[str, str] = {}
