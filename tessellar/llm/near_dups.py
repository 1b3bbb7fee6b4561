"""Near-duplicate texts by SuperMinHash, banding, exact verification and union-find (operator 10)."""

from __future__ import annotations

import hashlib
from collections import OrderedDict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, stage_table, text_or_empty
from .graph import components
from .hashing import WORDS, mix, signed

_GOLD = 0x9E3779B97F4A7C15


def shingles(data: bytes, size: int) -> np.ndarray:
    """Distinct 64-bit hashes of a text's shingles of `size` words; ASCII capitals are lowered. A text of fewer words
    is one shingle; one without words has none."""
    words = data.lower().split()  # both touch ASCII only
    if not words:
        return np.zeros(0, np.uint64)
    h = WORDS.of(words)
    size = min(size, len(h))
    total = np.zeros(len(h) - size + 1, np.uint64)
    for k in range(size):
        total = mix(total + h[k : len(h) - size + 1 + k] + np.uint64(k + 1 + size * 64))
    return np.unique(total)


def shingle_set(data: bytes, size: int) -> frozenset:
    """The shingles themselves, for exact verification."""
    words = data.lower().split()
    return frozenset(zip(*(words[k:] for k in range(size)))) if len(words) >= size else frozenset([tuple(words)] if words else [])


def super_minhash(elements: np.ndarray, m: int) -> np.ndarray:
    """The signature of Ertl's SuperMinHash: each element gives each position r + its rank in the element's own random
    permutation, and the least value stays. All elements take a step at a time; once every position holds less than the
    next step could give, no later step can change anything and the rest is left out."""
    values = np.full(m, np.inf)
    rows, order, low, half = np.arange(len(elements)), None, np.uint64(0xFFFFFFFF), np.uint64(32)
    for j in range(m):
        z = mix(elements + np.uint64((2 * j + 1) * _GOLD & 0xFFFFFFFFFFFFFFFF))
        at = j + ((z & low) * np.uint64(m - j) >> half).astype(np.intp)
        r = (z >> half) * 2.0**-32
        if j == 0:
            first = place = at
        else:
            if order is None:
                order = np.empty((len(elements), m), np.uint16)
                order[:] = np.arange(m, dtype=np.uint16)
                order[rows, first] = 0
                order[:, 0] = first
            place = order[rows, at].astype(np.intp)
            order[rows, at] = order[:, j]
        np.minimum.at(values, place, r + j)
        if values.max() < j + 1:
            break
    return values


def band_keys(signature: np.ndarray, bands: int) -> np.ndarray:
    rows = signature.view(np.uint64).reshape(bands, -1)
    key = mix(np.arange(bands, dtype=np.uint64) + np.uint64(_GOLD))
    for k in range(rows.shape[1]):
        key = mix(key ^ rows[:, k])
    return key


def signatures(docs: DataFrame, size: int, bands: int, rows: int) -> DataFrame:
    """id, n_shingles, two longs that name the set, and a key for each band."""

    def step(batch: pa.RecordBatch) -> dict:
        out: dict[str, list] = {"id": batch.column(0), "n": [], "a": [], "b": [], "bands": []}
        for data in batch.column(1).to_pylist():
            found = shingles(data, size)
            name = hashlib.blake2b(found.tobytes(), digest_size=16).digest()
            out["n"].append(len(found))
            out["a"].append(int.from_bytes(name[:8], "little", signed=True))
            out["b"].append(int.from_bytes(name[8:], "little", signed=True))
            out["bands"].append(signed(band_keys(super_minhash(found, bands * rows), bands)) if len(found) else None)
        return out

    return map_arrow(docs, "id long, n long, a long, b long, bands array<long>", step)


def verify(pairs: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """The pairs u, v whose full shingle sets are alike: 100 * intersection >= percent * union."""
    left = texts.select(F.col("id").alias("u"), F.col("text").alias("x"))
    right = texts.select(F.col("id").alias("v"), F.col("text").alias("y"))

    def step(batch: pa.RecordBatch) -> dict:
        out: dict[str, list] = {"u": [], "v": []}
        cache: OrderedDict[bytes, frozenset] = OrderedDict()

        def of(data: bytes) -> frozenset:
            if data not in cache:
                cache[data] = shingle_set(data, size)
                if len(cache) > 64:
                    cache.popitem(last=False)
            return cache[data]

        for u, v, x, y in zip(*(batch.column(batch.schema.get_field_index(n)).to_pylist() for n in ("u", "v", "x", "y"))):
            a, b = of(x), of(y)
            if 100 * min(len(a), len(b)) >= percent * max(len(a), len(b)):
                common = len(a & b)
                if 100 * common >= percent * (len(a) + len(b) - common):
                    out["u"].append(u)
                    out["v"].append(v)
        return out

    return map_arrow(pairs.join(left, "u").join(right, "v").select("u", "v", "x", "y"), "u long, v long", step)


def _across(members: pa.Table, loose: pa.Table, size: int, percent: int) -> tuple[list[int], list[int]]:
    """Links between the loose texts and members of other components: for each loose text and component, one."""
    ids, comps = members.column("id").to_pylist(), np.asarray(members.column("component"))
    texts = members.column("text").to_pylist()
    found = [shingles(t, size) for t in texts]
    sizes = np.array([len(x) for x in found])
    every, owner = np.concatenate(found), np.repeat(np.arange(len(found)), sizes)
    by = np.argsort(every, kind="stable")
    every, owner = every[by], owner[by]
    us: list[int] = []
    vs: list[int] = []
    for u, comp, text in zip(loose.column("id").to_pylist(), loose.column("component").to_pylist(), loose.column("text").to_pylist()):
        own = shingles(text, size)
        lo, hi = np.searchsorted(every, own, "left"), np.searchsorted(every, own, "right")
        n = hi - lo
        hits = np.repeat(lo - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
        common = np.bincount(owner[hits], minlength=len(ids))
        near = np.flatnonzero((100 * common >= percent * (len(own) + sizes - common)) & (comps != comp))
        exact, linked = None, set()
        for k in near.tolist():
            if comps[k] in linked:
                continue
            exact = exact or shingle_set(text, size)
            other = shingle_set(texts[k], size)
            both = len(exact & other)
            if 100 * both >= percent * (len(exact) + len(other) - both):
                linked.add(comps[k])
                us.append(u)
                vs.append(ids[k])
    return us, vs


def across_components(group: DataFrame, found: DataFrame, texts: DataFrame, size: int, percent: int, block: int = 1000) -> DataFrame:
    """Links that the pivots have not shown, within groups of texts (id, group) that share large buckets.

    In each group the largest component is left as it is; every text outside it is compared with all texts of the group,
    block by block: a task has some hundred loose texts and `block` others, and counts common shingles by one index.
    """
    at = stage_table(group.join(found, "id", "left").select("id", "group", F.coalesce("component", "id").alias("component")), "grouped")
    parts = at.groupBy("group", "component").agg(F.count("*").alias("n"))
    main = parts.groupBy("group").agg(F.max_by("component", F.struct("n", -F.col("component"))).alias("main"), F.count("*").alias("parts"), F.sum("n").alias("all"), F.max("n").alias("most")).filter("parts > 1")
    main = main.select("group", "main", F.ceil(F.col("all") / block).cast("int").alias("mb"), F.ceil((F.col("all") - F.col("most")) / (block // 4)).cast("int").alias("lb"))
    open_ = at.join(main, "group").join(texts, "id")
    pick = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    spread = lambda df, mine, other: df.withColumn(mine, pick(mine)).withColumn(other, F.explode(F.sequence(F.lit(0), F.col(other) - 1)))
    keys = ["group", "mb", "lb"]

    def compare(members: pa.Table, loose: pa.Table) -> pa.Table:
        us, vs = _across(members, loose, size, percent) if members.num_rows and loose.num_rows else ([], [])
        return pa.table([pa.array(us, pa.int64()), pa.array(vs, pa.int64())], names=["u", "v"])

    members, loose = spread(open_, "mb", "lb"), spread(open_.filter(F.col("component") != F.col("main")), "lb", "mb")
    loose = loose.select(*[F.col(c).alias(c) for c in loose.columns])  # columns of its own, for the cogroup
    return members.groupBy(*keys).cogroup(loose.groupBy(*keys)).applyInArrow(compare, "u long, v long")


def near_duplicates(docs: DataFrame, *, size: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text", bands: int = 32, rows: int = 5, small: int = 16) -> DataFrame:
    """Groups of texts linked by 100 * intersection >= percent * union of their shingle sets.

    Returns a row for each row of docs: the id, n_shingles, component_id (the smallest id reachable by links, itself
    included), kept (id = component_id). Texts without words have no shingles and link to nothing. Rows that share an
    id are one node. A row with a null id stands alone: component_id null, kept true. Other columns are left out.

    Equal sets are one class, of which only the smallest id goes on. Classes that share a band are candidates; with 32
    bands of 5 a pair at 80 % escapes once in 300,000. Buckets of up to `small` classes are verified pair by pair. In
    larger ones all are verified against a pivot, the class that stands in most of them and so is likely the original;
    what that leaves apart is compared with the whole group in blocks (across_components). No link between components
    is missed, and a group of alike texts needs as many checks as it has members, not pairs.
    """
    rows_in = docs.select(F.col(id_col).cast("long").alias("id"), text_or_empty(text_col).cast("binary").alias("text"))
    known = rows_in.filter("id is not null")
    signed_ = stage_table(signatures(rows_in, size, bands, rows), "signatures")
    sets = signed_.filter("id is not null and n > 0")
    classes = stage_table(sets.groupBy("a", "b").agg(F.min("id").alias("rep"), F.count("*").alias("n")), "classes")
    # Every copy looks up its class. Classes of more than a millionth of all rows are fewer than a million: they are
    # broadcast, so that the copies of a large one stay where they are; the others are joined.
    hot = F.col("n") > max(100, (classes.agg(F.sum("n")).first()[0] or 0) // 1_000_000)
    looked = sets.select("id", "a", "b").join(F.broadcast(classes.filter(hot).select("a", "b", "rep")), ["a", "b"], "left")
    rest = looked.filter("rep is null").select("id", "a", "b").join(classes.filter(~hot).select("a", "b", "rep"), ["a", "b"])
    member = stage_table(looked.filter("rep is not null").select("id", "rep").unionAll(rest.select("id", "rep")).distinct(), "members")
    same = member.groupBy("id").agg(F.collect_set("rep").alias("reps")).filter(F.size("reps") > 1).select(F.explode("reps").alias("u"), F.array_min("reps").alias("v")).filter("u != v")

    keyed = sets.join(member.filter("id = rep").select("id").distinct(), "id", "left_semi").select("id", F.explode("bands").alias("key")).distinct()
    buckets = keyed.groupBy("key").agg(F.count("*").alias("n"), F.min("id").alias("lo"), F.max("id").alias("hi"), F.sum(F.xxhash64("id").cast("decimal(38,0)")).alias("sig")).filter("n > 1")
    buckets = buckets.groupBy("n", "lo", "hi", "sig").agg(F.min("key").alias("key"))  # the same classes in several bands count once
    inside = stage_table(keyed.join(buckets.select("key", "n"), "key"), "buckets")
    few, many = inside.filter(F.col("n") <= small), inside.filter(F.col("n") > small)
    pairs = few.alias("p").join(few.alias("q"), (F.col("p.key") == F.col("q.key")) & (F.col("p.id") < F.col("q.id"))).select(F.col("p.id").alias("u"), F.col("q.id").alias("v"))
    weight = many.groupBy("id").agg(F.sum("n").alias("weight"))
    # Written before it is joined: then both sides have plain exchanges, and a very large bucket can be split over tasks.
    pivot = stage_table(many.join(weight, "id").groupBy("key").agg(F.max_by("id", F.struct("weight", -F.col("id"))).alias("pivot")), "pivots")
    star = stage_table(many.join(pivot, "key").filter("id != pivot").select("id", "pivot").distinct(), "stars-of-buckets")
    pairs = stage_table(pairs.unionAll(star.select(F.least("id", "pivot").alias("u"), F.greatest("id", "pivot").alias("v"))).distinct(), "pairs")
    wanted = inside.select("id").distinct()
    if wanted.count() <= 1_000_000:  # broadcast only below this many ids, of eight bytes
        wanted = F.broadcast(wanted)
    texts = stage_table(known.join(wanted, "id", "left_semi"), "candidate-texts")
    links = stage_table(verify(pairs, texts, size, percent).unionAll(same), "verified")
    found = components(links)
    if not star.isEmpty():
        tied = components(star.select(F.col("id").alias("u"), F.col("pivot").alias("v")))
        group = many.select("id").distinct().join(tied, "id", "left").select("id", F.coalesce("component", "id").alias("group"))
        more = stage_table(across_components(group, found, texts, size, percent), "verified-across")
        if not more.isEmpty():
            found = components(found.select(F.col("id").alias("u"), F.col("component").alias("v")).unionAll(more))
    grouped = member.groupBy("id").agg(F.min("rep").alias("rep")).join(found.withColumnRenamed("id", "rep"), "rep", "left").select("id", F.coalesce("component", "rep").alias("component"))
    out = signed_.select("id", "n").join(grouped, "id", "left")
    component = F.coalesce("component", "id")
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"))


def keep_first(docs: DataFrame, *, id_col: str = "doc_id", **options) -> DataFrame:
    """docs without the rows that near_duplicates() would not keep: of each group the smallest id stays. Columns stay."""
    dropped = stage_table(near_duplicates(docs, id_col=id_col, **options).filter("not kept").select(id_col).distinct(), "dropped")
    return docs.join(dropped, id_col, "left_anti").select(*docs.columns)
