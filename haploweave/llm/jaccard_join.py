"""N-gram Jaccard join by grouped prefixes, down to components of linked documents.

A document is the set of its distinct k-word shingles (64-bit hashes). Equal sets
are one class; classes of equal size and equal prefix are one group. Shingles are
ordered by how common they are (counts of hash buckets over all documents, a table
of fixed size) and then by hash, and a set's prefix is its first
n - ceil(t n) + 1 shingles: sets with Jaccard likeness t or more share a shingle of
both prefixes. Groups are joined on prefix shingles under the size filter and the
positional filter: sets whose overlap must be o at least share not one only but l of the
first n - o + l shingles of each, as all but o - l of the set that ends first are among these.

Only components are wanted, so candidates are verified in two passes. First every
group is held against one partner at most, of the groups that have a shared shingle earliest the one with
the most of them, if these are enough for the count filter,
and every class against its group's first class: one candidate each. Then, where
sets that share a prefix shingle still are in different components, all remaining
pairs across components are expanded and verified; pairs inside a component can't
change it. No pair is capped, sampled or dropped. Verification recomputes exact
sets from whole texts, in blocks of one text and partners of about ``FAN`` and ``WEIGHT`` shingles.

Defined cases: null or wordless texts have size 0, link with nothing and are their
own component; fewer words than k make one shingle; rows of the same id count as
one document and share a component, whatever their texts; rows with a null id are returned with what
their equal copies have, else null; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import components
from .store import bound_batches, drop, release, written
from .textblock import blocks, mix, shingles, trim, words

#: Hash buckets of the shingle counts, slices in which they are summed, and how many summands meet.
BUCKETS, SLICES, MEET = 1 << 20, 64, 64
#: Shingles of a set for each further shared one that the count filter asks for.
EXTRA = 64
#: Partners, and shingles of partners, that are verified together against one text.
FAN, WEIGHT = 64, 1 << 19


def _sets(column: pa.Array, k: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingles of each row."""
    for lo, hi, data, offs in blocks(column):
        h, to = shingles(*words(data, offs), hi - lo, k)
        for r in range(hi - lo):
            yield np.unique(h[to[r] : to[r + 1]])


def _digest(s: np.ndarray) -> tuple[int, int]:
    with np.errstate(over="ignore"):
        return int(mix(s).sum(dtype=np.uint64).astype(np.int64)), int(mix(s ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64).astype(np.int64))


def bucket_counts(docs: DataFrame, k: int) -> np.ndarray:
    """How often shingles of each hash bucket occur, over all documents: BUCKETS numbers, whatever the corpus. Summed in a tree, so that no task meets more than MEET others' counts."""
    size = BUCKETS // SLICES

    def packed(total: np.ndarray, salt: int, only: int | None = None) -> Iterator[pa.RecordBatch]:
        out = []
        for i in range(SLICES) if only is None else [only]:
            part = total[i * size : (i + 1) * size] if only is None else total
            at = np.flatnonzero(part)
            if len(at):
                out.append((i, salt, at.astype("<u2").tobytes(), part[at].astype("<u4" if part.max() < 1 << 32 else "<u8").tobytes()))
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in out], pa.int32()), pa.array([r[1] for r in out], pa.int32()), pa.array([r[2] for r in out], pa.binary()), pa.array([r[3] for r in out], pa.binary())], ["slice", "salt", "at", "n"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for lo, hi, data, offs in blocks(batch.column(0)):
                h, _ = shingles(*words(data, offs), hi - lo, k)
                total += np.bincount((h >> np.uint64(44)).astype(np.int64), minlength=BUCKETS)
        yield from packed(total, TaskContext.get().partitionId() // MEET)
        trim()

    def add(table: pa.Table) -> pa.Table:
        total = np.zeros(size, np.int64)
        for at, n in zip(table.column("at").to_pylist(), table.column("n").to_pylist()):
            at = np.frombuffer(at, "<u2")
            total[at] += np.frombuffer(n, "<u4" if len(n) == 4 * len(at) else "<u8").astype(np.int64)
        return pa.Table.from_batches(list(packed(total, table.column("salt")[0].as_py() // MEET, table.column("slice")[0].as_py())))

    schema = "slice int, salt int, at binary, n binary"
    text = docs.select("text")
    parts, left = text.mapInArrow(count, schema), text.rdd.getNumPartitions()
    while left > 1:
        parts, left = parts.groupBy("slice", "salt").applyInArrow(add, schema), -(-left // MEET)
    total = np.zeros(BUCKETS, np.int64)
    for r in parts.collect():
        at = np.frombuffer(r["at"], "<u2").astype(np.int64)
        total[r["slice"] * size + at] += np.frombuffer(r["n"], "<u4" if len(r["n"]) == 4 * len(at) else "<u8")
    return total


def features(docs: DataFrame, *, k: int = 5, percent: int = 75) -> DataFrame:
    """Per row: doc_id, n (set size), s1 and s2 (digest of the set), ph (digest of the prefix), prefix (shingles, rarest first)."""
    kind = docs.schema["doc_id"].dataType
    order = docs.sparkSession.sparkContext.broadcast(bucket_counts(docs, k))

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rank = order.value
        for batch in batches:
            n, s1, s2, ph, prefix = [], [], [], [], []
            for s in _sets(batch.column(1), k):
                p = len(s) - -(-percent * len(s) // 100) + 1 if len(s) else 0
                head = s[np.lexsort((s, rank[(s >> np.uint64(44)).astype(np.int64)]))[:p]].astype(np.int64)
                a, b = _digest(s)
                n.append(len(s)), s1.append(a), s2.append(b), ph.append(_digest(head.astype(np.uint64))[0]), prefix.append(head)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(s1, pa.int64()), pa.array(s2, pa.int64()), pa.array(ph, pa.int64()), pa.array(prefix, pa.list_(pa.int64()))], ["doc_id", "n", "s1", "s2", "ph", "prefix"])
        trim()

    return docs.select("doc_id", "text").mapInArrow(build, f"doc_id {kind.simpleString()}, n long, s1 long, s2 long, ph long, prefix array<long>")


def verify(docs: DataFrame, pairs: DataFrame, *, k: int = 5, percent: int = 75) -> DataFrame:
    """The pairs (a, b) of ids whose sets link: (u, v). ``pairs`` has a, b and w, the size of b's set.

    Each text is sent once for every block of pairs that share it as their first document; equal rows of an id are compared once."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    pairs = written(pairs, "pairs")
    fans = written(pairs.groupBy("a").agg(F.ceil(F.greatest(F.count("*") / FAN, F.sum("w") / WEIGHT)).alias("fans")), "fans")
    chunked = written(pairs.join(fans, "a").select("a", "b", F.pmod(F.xxhash64("b"), "fans").alias("chunk")), "pairs")
    drop(pairs, fans)
    needs = chunked.select(F.col("a").alias("id"), "a", "chunk").distinct().unionByName(chunked.select(F.col("b").alias("id"), "a", "chunk"))
    # Texts that no pair needs are left out of the shuffle: a table of at most 2^19 hash values tells most of them.
    slot = lambda c: F.pmod(F.xxhash64(c), F.lit(1 << 19)).cast("int")
    wanted = needs.select(slot("id").alias("slot")).distinct()
    texts = docs.select(F.col("doc_id").alias("id"), "text").withColumn("slot", slot("id")).join(F.broadcast(wanted), "slot", "left_semi").drop("slot")

    def check(table: pa.Table) -> pa.Table:
        ids, hub = table.column("id").to_pylist(), table.column("a")[0].as_py()
        sets = {(i, _digest(x)): x for i, x in zip(ids, _sets(table.column("text"), k)) if len(x)}
        first = [x for (i, _), x in sets.items() if i == hub]
        found = set()
        for (i, _), y in sets.items():
            for x in first:
                if i != hub and i not in found:
                    both = len(np.intersect1d(x, y, assume_unique=True))
                    if 100 * both >= percent * (len(x) + len(y) - both):
                        found.add(i)
        kind_of = table.schema.field("id").type
        trim()
        return pa.table({"u": pa.array([hub] * len(found), kind_of), "v": pa.array(sorted(found), kind_of)})

    links = written(needs.join(texts, "id").groupBy("a", "chunk").applyInArrow(check, f"u {kind}, v {kind}"), "links")
    drop(chunked)
    return links


def join(docs: DataFrame, *, k: int = 5, percent: int = 75) -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id (smallest doc_id reachable by links), n_class (rows of an equal set)."""
    spark = docs.sparkSession
    bound_batches(spark)
    wide = written(features(docs, k=k, percent=percent).withColumn("row", F.monotonically_increasing_id()), "features")
    rows = written(wide.drop("prefix"), "sets")
    some = rows.where("n > 0")
    named = F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "row"))
    classes = written(some.groupBy("n", "s1", "s2").agg(F.min(named).alias("m"), F.count("*").alias("n_class"), F.first("ph").alias("ph")).select("n", "s1", "s2", "ph", "n_class", F.col("m.doc_id").alias("rep"), "m.row"), "classes")
    heads = written(classes.where("rep IS NOT NULL").groupBy("n", "ph").agg(F.min(F.struct("rep", "row")).alias("h"), F.count("*").alias("members")).select("n", "ph", F.col("h.rep").alias("gid"), "h.row", "members"), "groups")
    members = written(classes.where("rep IS NOT NULL").join(heads.where("members > 1").drop("row"), ["n", "ph"]).select("gid", "rep", "n"), "members")
    # An id with rows of different sets ties their classes together.
    torn = rows.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min(F.struct("n", "s1", "s2")).alias("x"), F.max(F.struct("n", "s1", "s2")).alias("y")).where("x <> y").select("doc_id")
    ties = written(some.join(torn, "doc_id").select("doc_id", "n", "s1", "s2").distinct().join(classes.select("n", "s1", "s2", "rep"), ["n", "s1", "s2"]).select(F.col("doc_id").alias("u"), F.col("rep").alias("v")), "ties")
    release(spark)
    # One row per prefix shingle of a group, from the row that is the group's first; at is the size and the place in one number.
    first = wide.where("n > 0").select("row", "n", "prefix").join(heads.select("row", "gid"), "row")
    posts = first.select("gid", "n", F.posexplode("prefix").alias("pos", "token")).select("token", "gid", F.shiftleft("n", 32).bitwiseOR(F.col("pos").cast("long")).alias("at")).repartition("token")
    size, place = (lambda c: F.shiftright(c, 32)), (lambda c: F.col(c).bitwiseAND(F.lit((1 << 32) - 1)))
    earliest = F.min(F.struct(place("at").alias("pos"), "gid", "at")).alias("p")
    blocks_of = posts.groupBy("token").agg(earliest, F.min(F.struct("gid", "at")).alias("q"), F.count("*").alias("c")).where("c > 1").select("token", F.struct("p.gid", "p.at").alias("p"), "q")
    shared = written(posts.join(blocks_of, "token"), "postings")
    drop(wide)
    release(spark)

    def least(n1: Column, n2: Column) -> Column:
        """The smallest overlap of sets that link."""
        return F.ceil(F.lit(percent) * (n1 + n2) / F.lit(100 + percent))

    def shares(n1: Column, n2: Column) -> Column:
        """How many of their first n - least + shares shingles sets that link have in common: one, and more for larger sets, as far as prefixes of n - ceil(t n) + 1 show."""
        return F.least(1 + F.floor(F.least(n1, n2) / F.lit(EXTRA)), least(n1, n2) - F.ceil(F.lit(percent) * F.greatest(n1, n2) / F.lit(100)) + 1)

    def fits(at1: str, at2: str) -> Column:
        n1, n2 = size(at1), size(at2)
        return F.least(n1 - place(at1), n2 - place(at2)) >= least(n1, n2) - shares(n1, n2) + 1

    def alike(n1: Column, n2: Column) -> Column:
        return 100 * F.least(n1, n2) >= percent * F.greatest(n1, n2)

    def enough(n1: Column, n2: Column) -> Column:
        """The least number of shared prefix shingles of sets that link."""
        return least(n1, n2) - F.ceil(F.lit(percent) * F.greatest(n1, n2) / F.lit(100)) + 1

    # Partners at a shingle: the group that has it earliest, and the first group.
    star = shared.select("gid", size("at").alias("n"), F.explode(F.array("p", "q")).alias("p")).select("gid", "n", F.col("p.gid").alias("a"), size("p.at").alias("m"))
    star = star.where((F.col("gid") != F.col("a")) & alike(F.col("n"), F.col("m"))).groupBy("gid", "a", "n", "m").agg(F.count("*").alias("c"))
    # Shingles whose partners are other groups don't count here, so half of what is needed will do; what is passed over is met below.
    star = star.where(2 * F.col("c") >= enough(F.col("n"), F.col("m"))).groupBy("gid", "n").agg(F.max_by("a", F.struct("c", -F.col("a"))).alias("a"))
    pairs = star.select("a", F.col("gid").alias("b"), F.col("n").alias("w")).unionByName(members.where("rep <> gid").select(F.col("gid").alias("a"), F.col("rep").alias("b"), F.col("n").alias("w")))
    links = verify(docs, pairs, k=k, percent=percent)
    release(spark)
    comps = components(links.unionByName(ties))
    drop(links)

    # What is left: pairs of one block that are in different components.
    member_comp = members.join(comps.withColumnRenamed("node", "rep"), "rep", "left").withColumn("comp", F.coalesce("comp", "rep"))
    spread = written(member_comp.groupBy("gid").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")), "spread")
    located = shared.select("token", "gid", "at").join(comps.withColumnRenamed("node", "gid"), "gid", "left").join(spread, "gid", "left")
    located = located.withColumn("lo", F.coalesce("lo", "comp", "gid")).withColumn("hi", F.coalesce("hi", "comp", "gid")).drop("comp")
    mixed = located.groupBy("token").agg(F.min("lo").alias("l"), F.max("hi").alias("h")).where("l <> h").select("token")
    located = written(located.join(mixed, "token"), "located")
    drop(shared)
    x, y = located.alias("x"), located.alias("y")
    across = (F.col("x.lo") != F.col("y.lo")) | (F.col("x.hi") != F.col("y.hi")) | (F.col("x.lo") != F.col("x.hi"))
    groups = x.join(y, (F.col("x.token") == F.col("y.token")) & (F.col("x.gid") < F.col("y.gid")) & across & alike(size("x.at"), size("y.at")) & fits("x.at", "y.at"))
    groups = groups.groupBy(F.col("x.gid").alias("ga"), F.col("y.gid").alias("gb")).agg(F.count("*").alias("c"), F.first(size("x.at")).alias("n"), F.first(size("y.at")).alias("m"))
    groups = groups.where(F.col("c") >= shares(F.col("n"), F.col("m"))).select("ga", "gb", F.col("m").alias("w"))
    groups = groups.unionByName(spread.where("lo <> hi").select(F.col("gid").alias("ga"), F.col("gid").alias("gb")).join(members.select(F.col("gid").alias("ga"), F.col("n").alias("w")).distinct(), "ga").select("ga", "gb", "w"))
    side = lambda g, r: members.select(F.col("gid").alias(g), F.col("rep").alias(r))
    pairs = groups.join(side("ga", "ra"), "ga", "left").join(side("gb", "rb"), "gb", "left").select("ga", "gb", F.coalesce("ra", "ga").alias("a"), F.coalesce("rb", "gb").alias("b"), "w")
    pairs = pairs.where((F.col("ga") != F.col("gb")) | (F.col("a") < F.col("b")))
    for end in ("a", "b"):
        pairs = pairs.join(comps.select(F.col("node").alias(end), F.col("comp").alias(f"c{end}")), end, "left")
    rest = pairs.where(F.coalesce("ca", "a") != F.coalesce("cb", "b")).groupBy("a", "b").agg(F.max("w").alias("w"))
    more = verify(docs, rest, k=k, percent=percent)
    drop(located)
    release(spark)
    final = components(comps.select(F.col("node").alias("u"), F.col("comp").alias("v")).unionByName(more)) if more.head(1) else comps
    known = classes.join(final.withColumnRenamed("node", "rep"), "rep", "left").select("n", "s1", "s2", F.coalesce("comp", "rep").alias("c"), "n_class")
    empty = rows.where("n = 0").join(final.withColumnRenamed("node", "doc_id"), "doc_id", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("comp", "doc_id").alias("component_id"), F.lit(1).cast("long").alias("n_class"))
    return some.select("doc_id", "n", "s1", "s2").join(known, ["n", "s1", "s2"]).select("doc_id", F.col("n").alias("n_shingles"), F.col("c").alias("component_id"), "n_class").unionByName(empty)
