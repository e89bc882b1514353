"""N-gram Jaccard join: all links at a threshold, exact, with token-combination prefixes.

Tokens are a document's distinct word shingles, as 64-bit hashes, ordered by
hash. Equal token sets are one class (64-bit hash of the set, with its size).

Signatures. A link at threshold c needs an overlap of t = ceil(c n) for either
side of n tokens, so at most d = n - t of them are missing on the other side.
Tokens come in two classes: frequent (in ``FREQUENT`` prefixes or more) and
rare. A prefix with r rare and f frequent tokens gives a signature for each
rare token by itself, and for each pair of frequent tokens of like hash modulo g. To
leave no signature shared, all r and all but g of the f must be missing (more
than g tokens put two in one of g cells), so the prefix is extended until
r + max(0, f - g) > d. The side whose prefix ends first has all its survivors in
the other's prefix: no link is lost. g grows with d, and a size next to a step
of g is signed for both steps, so pairs number O(d), and lists of frequent tokens are never
scanned for a token alone. Tokens met in one prefix only are dropped at once.

Verification in rounds. Equal posting lists are one list. In the first rounds each
list names a pivot and its members of other components are verified against it on
their full sets; links join components, and lists of one component are done: a
group of thousands of near copies costs a few comparisons a member, not all pairs.
Members of lists that are still longer than ``LONG`` get new signatures (:func:`refined`):
prefixes in the order of a token's count (by hashed buckets) among these members, so a passage that many share, which made the lists, comes last and no longer brings them together.
After rounds with one and with more pivots a list a last one takes the pairs between
components that are left in any list, so components are exact. A pair is emitted only if the sizes and the parity bitmaps of the two sets (computed
inside the join) still allow a link. Tables are deleted as rounds end.

Defined results: null or empty texts have no tokens and link with nothing;
texts shorter than a shingle are one token; a null id counts as larger than any
number (a component of null ids only has a null id); repeated rows are reported
one by one; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections import OrderedDict
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import free, free_since, give_back, if_small, mark, materialize, numbered, sweep, table, tree_sum

FREQUENT = 64
LONG = 64  # members of a list that is compared pair by pair
ROUNDS = ("pivot", "pivot", "refine", "pivot", 8, 64, "pairs")  # a number: so many pivots a list
LONGS = 8  # of a set's parity bitmap
WIDE_FROM = 384
HEAT, HEAT_BLOCK = 22, 1 << 14  # log2 of the buckets that tokens of long lists are counted in; buckets sent as one row
MAPS = [f"m{i}" for i in range(LONGS)]
SLICE = 512  # documents in a batch of what Python returns
_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


class WordHashes(OrderedDict):
    """word -> 64-bit hash; emptied when it grows large."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 60_000:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def shingle_set(text: bytes, n: int, known: dict) -> np.ndarray:
    """Sorted distinct hashes (uint64) of the n-word shingles of an UTF-8 text."""
    words = text.lower().split()  # of bytes: A-Z only, ASCII white space only
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter((known[w] for w in words), np.uint64, len(words))
    k = min(n, len(h))
    out = np.full(len(h) - k + 1, k, np.uint64)
    for i in range(k):
        out = (out ^ h[i : len(h) - k + 1 + i]) * _M1
        out ^= out >> np.uint64(32)
    out *= _M2
    out ^= out >> np.uint64(29)
    return np.unique(out)


def misses(n, percent: int):
    """Most tokens of a set of n that a partner can lack."""
    return n - (n * percent + 99) // 100


def cells(n: int, percent: int) -> int:
    """g: a power of two near half the misses, 1 at least."""
    return 1 << max(0, int(max(1, misses(n, percent) // 2)).bit_length() - 1)


def prefix_length(n: int, percent: int) -> int:
    return min(n, misses(n, percent) + 1 + cells(n, percent))


def parity(s: np.ndarray) -> np.ndarray:
    """Parity bitmap of a set: bit h(token) is flipped by each token. Two sets' bitmaps differ in no more bits than the sets in tokens."""
    bits = np.bincount(((s * _M2) >> np.uint64(32)).astype(np.int64) % (64 * LONGS), minlength=64 * LONGS).astype(np.uint8) & 1
    return np.packbits(bits).view(np.int64)


def wide_parity(s: np.ndarray) -> bytes | None:
    """For sets too large for LONGS: a parity bitmap of 4 to 8 bits a token."""
    if len(s) <= WIDE_FROM:
        return None
    size = 1 << int(4 * len(s) - 1).bit_length()
    bits = np.bincount(((s * _M2) >> np.uint64(24)).astype(np.int64) % size, minlength=size).astype(np.uint8) & 1
    return np.packbits(bits, bitorder="little").tobytes()


def wide_differ(a: bytes, b: bytes) -> int:
    """Bits in which two wide bitmaps differ, the longer folded to the shorter."""
    x, y = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
    if len(x) < len(y):
        x, y = y, x
    while len(x) > len(y):
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    return int(np.bitwise_count(x ^ y).sum())


def may_link(a: str, b: str, percent: int):
    """Condition on columns n, comp and m0..m7 of two sides: necessary for a link between components, no link is lost."""
    n = F.col(f"{a}.n") + F.col(f"{b}.n")
    # both = (n - differ) / 2 and 100 both >= percent (n - both)
    differ = sum((F.bit_count(F.col(f"{a}.m{i}").bitwiseXOR(F.col(f"{b}.m{i}"))).cast("long") for i in range(LONGS)), F.lit(0))
    near = 100 * F.least(f"{a}.n", f"{b}.n") >= percent * F.greatest(f"{a}.n", f"{b}.n")
    return (F.col(f"{a}.comp") != F.col(f"{b}.comp")) & near & ((100 + percent) * (n - differ) >= 2 * percent * n)


def prepare(docs: DataFrame, id_col: str, text_col: str, shingle: int, percent: int) -> DataFrame:
    """Per row: doc_id, n, cls (class of equal sets; null without tokens), prefix (its first tokens in hash order), th (hash of the text)."""

    def run(batches):
        known = WordHashes()
        for batch in (b.slice(i, SLICE) for b in batches for i in range(0, b.num_rows, SLICE)):
            n, cls, prefix, maps, wide = [], [], [], [], []
            for t in batch.column(1):
                s = shingle_set(t.as_buffer().to_pybytes() if t.is_valid else b"", shingle, known)
                n.append(len(s))
                maps.append(parity(s))
                wide.append(wide_parity(s))
                if len(s):
                    cls.append(int(np.int64(np.uint64(xxhash.xxh3_64_intdigest(s.tobytes(), seed=len(s))).view(np.int64))))
                    prefix.append(s[: prefix_length(len(s), percent)].view(np.int64))
                else:
                    cls.append(None)
                    prefix.append(np.empty(0, np.int64))
            offsets = np.concatenate(([0], np.cumsum([len(p) for p in prefix]))).astype(np.int32)
            values = pa.array(np.concatenate(prefix))
            m = np.array(maps, np.int64).reshape(-1, LONGS)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(n, pa.int64()), pa.array(cls, pa.int64()), pa.ListArray.from_arrays(pa.array(offsets), values), pa.array(wide, pa.binary()), *[pa.array(m[:, i]) for i in range(LONGS)]], ["doc_id", "th", "n", "cls", "prefix", "wide", *MAPS])
        known.clear()
        give_back()

    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("t"), F.xxhash64(F.col(text_col)).alias("th"))
    return source.mapInArrow(run, "doc_id long, th long, n long, cls long, prefix array<long>, wide binary, " + ", ".join(f"{m} long" for m in MAPS))


def sets_of(docs: DataFrame, wanted: DataFrame, id_col: str, text_col: str, shingle: int) -> DataFrame:
    """(cls, tokens) of the representatives ``wanted`` (cls, doc_id, th), read from the texts again."""

    def run(batches):
        known = WordHashes()
        for batch in (b.slice(i, SLICE) for b in batches for i in range(0, b.num_rows, SLICE)):
            s = [shingle_set(t.as_buffer().to_pybytes() if t.is_valid else b"", shingle, known) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x.tobytes() for x in s], pa.binary())], ["cls", "tokens"])
        known.clear()
        give_back()

    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("t"), F.xxhash64(F.col(text_col)).alias("th"))
    w = if_small(wanted.select(F.col("doc_id").alias("wid"), F.col("th").alias("wth"), "cls"), 64)
    joined = d.join(w, (F.col("th") == F.col("wth")) & F.col("doc_id").eqNullSafe(F.col("wid")))
    out = materialize(joined.select("cls", "t").mapInArrow(run, "cls long, tokens binary"), "sets")
    repeated = out.groupBy("cls").agg(F.count("*").alias("c")).filter("c > 1")  # equal rows with one id
    return out if repeated.isEmpty() else out.dropDuplicates(["cls"])


def signatures(classes: DataFrame, percent: int) -> DataFrame:
    """(sig, cls) for classes (cls, n, prefix): only signatures that two classes share."""
    place = (F.shiftleft(F.col("n"), 32) + F.col("pos")).alias("place")
    rows = classes.select("cls", "n", F.posexplode("prefix").alias("pos", "token")).select("cls", place, "token")
    shared = materialize(rows.groupBy("token").agg(F.count("*").alias("df")).filter("df > 1"), "shared-tokens")
    sweep(classes.sparkSession)
    hits = rows.join(shared, "token").select("cls", F.struct("place", "token", (F.col("df") >= FREQUENT).alias("frequent")).alias("hit"))
    per = hits.groupBy("cls").agg(F.array_sort(F.collect_list("hit")).alias("hits"))  # within one document's prefix

    def run(batches):
        for batch in (b.slice(i, SLICE) for b in batches for i in range(0, b.num_rows, SLICE)):
            sig, cls = [], []
            for c, h in zip(batch.column(0).to_pylist(), batch.column(1)):
                place, token, freq = (h.values.field(i).to_numpy(zero_copy_only=False) for i in range(3))
                n, pos = int(place[0]) >> 32, place & 0xFFFFFFFF
                d, g = misses(n, percent), cells(n, percent)
                p = prefix_length(n, percent)
                flags = np.zeros(p, bool)
                flags[pos] = freq
                tolerance = np.cumsum(~flags) + np.maximum(0, np.cumsum(flags) - g)
                end = int(np.searchsorted(tolerance, d + 1)) + 1  # the prefix that is needed
                keep = pos < end
                rare = token[keep & ~freq]
                common = token[keep & freq].view(np.uint64)
                own = [rare]
                steps = {g, cells((n * percent + 99) // 100, percent)}
                for step in sorted(steps):
                    if len(common) <= step:
                        continue
                    cell = (common % np.uint64(step)).astype(np.int64)
                    order = np.argsort(cell, kind="stable")
                    t, k = common[order], cell[order]
                    salt = np.uint64(step * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
                    for a, b in zip(*(lambda e: (e[:-1], e[1:]))(np.concatenate((np.flatnonzero(np.r_[True, k[1:] != k[:-1]]), [len(k)])))):
                        if b - a > 1:
                            i, j = np.triu_indices(b - a, 1)
                            x = (t[a:b][i] * _M1) ^ (t[a:b][j] * _M2) ^ salt
                            own.append((x ^ (x >> np.uint64(31))).view(np.int64))
                s = np.concatenate(own)
                sig.append(s)
                cls.append(np.full(len(s), c, np.int64))
            if sig:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (sig, cls)], ["sig", "cls"])

    return per.mapInArrow(run, "sig long, cls long")


def distinct_lists(sigs: DataFrame) -> DataFrame:
    """Posting lists of two or more, one for each distinct set of members: (list, cls)."""
    marks = sigs.groupBy("sig").agg(F.count("*").alias("m"), F.bit_xor(F.xxhash64("cls")).alias("x"), F.bit_xor(F.xxhash64("cls", F.lit(7))).alias("y")).filter("m > 1")
    first = marks.groupBy("m", "x", "y").agg(F.min("sig").alias("sig")).select("sig")
    return sigs.join(first, "sig", "left_semi").select(F.col("sig").alias("list"), "cls")


def narrow(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """The pairs that the wide bitmaps of large sets still allow."""

    @F.arrow_udf("boolean")
    def allowed(x: pa.Array, y: pa.Array, m: pa.Array, n: pa.Array) -> pa.Array:
        ok = [p is None or q is None or (100 + percent) * (a + b - wide_differ(p, q)) >= 2 * percent * (a + b) for p, q, a, b in zip(*(v.to_pylist() for v in (x, y, m, n)))]
        return pa.array(ok, pa.bool_())

    c = classes.select("cls", "n", "wide").join(pairs.select(F.col("a").alias("cls")).union(pairs.select("b")).distinct(), "cls", "left_semi")
    j = pairs.join(c.toDF("a", "na", "wa"), "a").join(c.toDF("b", "nb", "wb"), "b")
    return j.filter(allowed("wa", "wb", "na", "nb")).select("a", "b")


def verify(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that link, on their full sets."""

    @F.arrow_udf("boolean")
    def links(x: pa.Array, y: pa.Array) -> pa.Array:
        out = []
        for p, q in zip(x, y):
            a, b = np.frombuffer(p.as_buffer(), np.uint64), np.frombuffer(q.as_buffer(), np.uint64)
            both = len(np.intersect1d(a, b, assume_unique=True))
            out.append(100 * both >= percent * (len(a) + len(b) - both))
        return pa.array(out, pa.bool_())

    j = pairs.join(sets.select(F.col("cls").alias("a"), F.col("tokens").alias("ta")), "a").join(sets.select(F.col("cls").alias("b"), F.col("tokens").alias("tb")), "b")
    return j.filter(links("ta", "tb")).select("a", "b")


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(node, comp), a written table, for nodes of ``edges`` (a, b): comp is the least node of the component.

    Alternating large-star and small-star rounds; each is an aggregate and a
    join, so neither a long chain nor a large component is one task.
    """
    e = materialize(edges.filter("a <> b").select(F.greatest("a", "b").alias("node"), F.least("a", "b").alias("comp")).distinct(), name)
    digest = lambda x: x.agg(F.count("*"), F.sum(F.xxhash64("node", "comp").cast("decimal(38,0)"))).first()
    state = digest(e)
    while True:
        pairs = e.toDF("u", "v")
        both = pairs.union(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("node"), F.col("m").alias("comp")).filter("node <> comp").distinct()
        nxt = materialize(small, name)
        free(e)
        e, before, state = nxt, state, digest(nxt)
        if before == state:
            return e


def meetings(members: DataFrame) -> np.ndarray:
    """How often tokens of the members' sets fall into each of ``1 << HEAT`` buckets, a table of one size."""

    def run(batches):
        heat = np.zeros(1 << HEAT, np.int32)
        for batch in batches:
            for t in batch.column(0):
                np.add.at(heat, bucket_of(np.frombuffer(t.as_buffer(), np.uint64)), np.int32(1))
        rows = [(i, heat[i * HEAT_BLOCK : (i + 1) * HEAT_BLOCK]) for i in range(len(heat) // HEAT_BLOCK)]
        rows = [(i, x.tobytes()) for i, x in rows if x.any()]
        yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in rows], pa.int32()), pa.array([x for _, x in rows], pa.binary())], ["block", "data"])

    def add(_, parts):
        return sum(np.frombuffer(p, np.int32) for p in parts).tobytes()

    states = members.select("tokens").mapInArrow(run, "block int, data binary")
    out = np.zeros(1 << HEAT, np.int32)
    for r in tree_sum(states, members.rdd.getNumPartitions(), add).toLocalIterator():
        out[r["block"] * HEAT_BLOCK : (r["block"] + 1) * HEAT_BLOCK] = np.frombuffer(bytes(r["data"]), np.int32)
    return np.minimum(out, 65535).astype(np.uint16)  # above that hashes alone decide the order


def bucket_of(tokens: np.ndarray) -> np.ndarray:
    return ((tokens * _M1) >> np.uint64(64 - HEAT)).astype(np.int64)


def refined(members: DataFrame, percent: int) -> DataFrame:
    """(sig, cls): signatures of the classes ``members`` (cls, tokens) that meet in long lists, in place of those lists.

    Tokens are now ordered by the count of their bucket among the members, then by hash: one order for all. Two that link have
    their first common token in it among the first misses + 1 of either side, so no link is lost. Tokens alone in their bucket
    are in no other set and need no signature.
    """
    heat = members.sparkSession.sparkContext.broadcast(meetings(members))

    def run(batches):
        for batch in batches:
            sig, cls = [], []
            for c, t in zip(batch.column(0).to_pylist(), batch.column(1)):
                s = np.frombuffer(t.as_buffer(), np.uint64)
                h = heat.value[bucket_of(s)]
                first = np.lexsort((s, h))[: misses(len(s), percent) + 1]
                first = first[h[first] > 1]
                sig.append(s[first].view(np.int64))
                cls.append(np.full(len(first), c, np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x) if x else np.empty(0, np.int64)) for x in (sig, cls)], ["sig", "cls"])

    return members.select("cls", "tokens").mapInArrow(run, "sig long, cls long")


def link_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, percent: int = 85) -> DataFrame:
    """Per row of ``docs``: doc_id, n_shingles, component_id; and ``cls`` (class of equal sets), ``comp`` (class of the component), ``th`` (hash of the text)."""
    spark, start = docs.sparkSession, mark()
    wide = materialize(prepare(docs, id_col, text_col, shingle, percent), "shingles")
    rows = materialize(wide.select("doc_id", "th", "n", "cls"), "rows")
    classes = wide.filter("cls IS NOT NULL").groupBy("cls", "n", *MAPS).agg(F.min_by(F.struct("doc_id", "th"), F.struct(F.coalesce("doc_id", F.lit(2**63 - 1)), "th")).alias("rep"), F.first("prefix").alias("prefix"), F.first("wide").alias("wide"))
    classes = materialize(classes, "classes")
    free(wide)
    sweep(spark)
    sigs = materialize(signatures(classes, percent), "signatures")
    sweep(spark)
    facts = classes.select("cls", "n", *MAPS)
    lists = materialize(distinct_lists(sigs).join(facts, "cls").withColumn("comp", F.col("cls")), "lists")
    free(sigs)
    columns = lists.columns
    tested: list[DataFrame] = []
    links: list[DataFrame] = []
    sets: list[DataFrame] = []
    union = lambda parts: reduce(DataFrame.unionByName, parts)

    def load(wanted: DataFrame) -> DataFrame:
        """Full sets of the classes ``wanted``, each read from its text once."""
        new = wanted.join(union([s.select("cls") for s in sets]), "cls", "left_anti") if sets else wanted
        reps = materialize(classes.join(new, "cls", "left_semi").select("cls", "rep.doc_id", "rep.th"), "reps")
        if not reps.isEmpty():
            sets.append(sets_of(docs, reps, id_col, text_col, shingle))
        free(reps)
        return union(sets) if sets else classes.select("cls", F.lit(None).cast("binary").alias("tokens")).filter("false")

    for step in ROUNDS:
        # lists that still hold two components
        member = F.struct("cls", "n", "comp", *MAPS)
        first = [F.min_by(member, "cls").alias("h")] if step == "pivot" else []
        open_ = lists.groupBy("list").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count("*").alias("members"), *first).filter("lo <> hi").drop("lo", "hi")
        if step == "refine":
            before, lists = lists, materialize(lists.join(open_, "list"), "open-lists")
            free(before)
            long = lists.filter(F.col("members") > LONG)
            if long.isEmpty():
                lists = lists.drop("members")
                continue
            members = materialize(long.select(*[c for c in columns if c != "list"]).distinct(), "members")
            full = materialize(load(members.select("cls")).join(members.select("cls"), "cls", "left_semi"), "members-sets")
            new = materialize(refined(full, percent), "refined-signatures")
            new = distinct_lists(new).join(members, "cls")
            new = materialize(new.select(*columns), "refined-lists")
            lists = lists.filter(F.col("members") <= LONG).select(*columns).unionByName(new)
            continue
        if step == "pivot":
            # one pivot a list, which is then done with its list: lists of two end here
            beside = lists.alias("x").join(open_.alias("y"), F.col("x.list") == F.col("y.list"))
            beside = materialize(beside.select("x.*", F.col("h.cls").alias("p"), may_link("x", "h", percent).alias("cand")), "open-lists")
            free(lists)
            pairs = beside.filter("cand").select(F.least("cls", "p").alias("a"), F.greatest("cls", "p").alias("b")).distinct()
            lists = beside.filter("cls <> p").select(*columns)
        else:
            before, lists = lists, materialize(lists.join(open_, "list", "left_semi"), "open-lists")
            free(before)
            heads, once = lists, F.col("x.cls") < F.col("y.cls")  # what is left: each pair once
            if step != "pairs":
                slot = F.pmod(F.xxhash64("cls", F.lit(step)), F.lit(step))
                heads, once = lists.groupBy("list", slot.alias("slot")).agg(F.min_by(member, "cls").alias("h")).select("list", "h.*"), F.lit(True)
            pairs = lists.alias("x").join(heads.alias("y"), (F.col("x.list") == F.col("y.list")) & once & may_link("x", "y", percent))
            pairs = pairs.select(F.least("x.cls", "y.cls").alias("a"), F.greatest("x.cls", "y.cls").alias("b")).distinct()
        if tested:
            pairs = pairs.join(union(tested), ["a", "b"], "left_anti")
        bare = materialize(pairs, "bare-pairs")
        pairs = materialize(narrow(bare, classes, percent), "pairs")
        free(bare)
        tested.append(pairs)
        named = pairs.select(F.col("a").alias("cls")).union(pairs.select("b")).distinct()
        found = materialize(verify(pairs, load(named), percent), "links")
        links.append(found)
        if step != "pairs" and not found.isEmpty():
            comp = components(union(links))
            before, lists = lists, materialize(lists.drop("comp").join(comp.withColumnRenamed("node", "cls"), "cls", "left").withColumn("comp", F.coalesce("comp", "cls")).select(*columns), "lists")
            free(comp)
            if step == "pivot":
                free(beside)
        sweep(spark)
    comp = components(union(links))
    whole = classes.select("cls", F.col("rep.doc_id").alias("first")).join(comp.withColumnRenamed("node", "cls"), "cls", "left").withColumn("comp", F.coalesce("comp", "cls"))
    least = whole.groupBy("comp").agg(F.min("first").alias("component"))
    whole = materialize(whole.join(least, "comp").select("cls", "comp", "component"), "class-components")
    free_since(start, rows, whole)
    sweep(spark)
    # only classes of more than one row or document need the join; a third of all rows may be one class, which Spark splits
    out = rows.join(whole, "cls", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("cls").isNull(), F.col("doc_id")).otherwise(F.col("component")).alias("component_id"), "cls", "comp", "th")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_components(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "n_shingles", "component_id")


SQL = r"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents
), s AS (
  SELECT DISTINCT doc_id, array_to_string(ws[i : i + 3], ' ') AS s FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 3, 1) + 1)) AS i FROM w WHERE len(ws) > 0)
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), o AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS both FROM s a JOIN s b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id
), l AS (
  SELECT o.a, o.b FROM o JOIN n x ON x.doc_id = o.a JOIN n y ON y.doc_id = o.b WHERE 100 * o.both >= 85 * (x.n + y.n - o.both)
), r AS (
  WITH RECURSIVE r(a, b) AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a) SELECT a, min(b) AS m FROM r GROUP BY a
)
SELECT w.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, least(w.doc_id, coalesce(r.m, w.doc_id)) AS component_id
FROM w LEFT JOIN n ON n.doc_id = w.doc_id LEFT JOIN r ON r.a = w.doc_id
"""


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` that stay: of each component the row with the smallest id (a null id counts as largest); rows without tokens stay.

    Where the smallest id stands on several rows of a component, the row with the smallest text hash stays, and equal rows leave one.
    All columns are carried, whatever their names.
    """
    names = docs.columns
    d = numbered(docs)
    key, text = (f"c{names.index(c)}" for c in (id_col, text_col))
    own_id, own_hash = F.col(key).cast("long"), F.xxhash64(F.col(text))
    linked = link_components(d, key, text, shingle, percent).filter("cls IS NOT NULL")
    low = F.struct(F.coalesce("doc_id", F.lit(2**63 - 1)).alias("i"), F.col("th").alias("h"))
    groups = linked.groupBy("comp").agg(F.min(low).alias("k"), F.count("*").alias("rows")).filter("rows > 1").select("comp", "k.*")
    lost = linked.join(groups, "comp").filter(low != F.struct("i", "h")).select(F.col("doc_id").alias("lid"), F.col("th").alias("lth")).distinct()
    lost = if_small(materialize(lost, "near-lost"), 64)
    out = d.join(lost, (own_hash == F.col("lth")) & own_id.eqNullSafe(F.col("lid")), "left_anti")
    # an id that repeats with an equal text
    twice = materialize(linked.groupBy("doc_id", "th").agg(F.count("*").alias("c")).filter("c > 1").select(F.col("doc_id").alias("lid"), F.col("th").alias("lth")), "near-twice")
    if not twice.isEmpty():
        match = (own_hash == F.col("lth")) & own_id.eqNullSafe(F.col("lid"))
        once = out.join(twice, match, "left_semi").withColumn("h", own_hash).dropDuplicates([key, "h"]).drop("h")
        out = out.join(if_small(twice, 64), match, "left_anti").unionByName(once)
    return out.toDF(*names)
