"""MinHash near-dedup: one-permutation hashing with optimal densification.

One hash of each shingle fills ``bins`` bins; an empty bin borrows from the
first non-empty bin of its own random sequence (Shrivastava 2017). Bands of
bins are bucket keys. A bucket proposes only a star, each member against one
centre, so proposals grow with members, not with pairs. Links are confirmed on
full shingle sets. What stays in buckets with several components goes on: rounds
take combinations of bands as keys, another one each, which parts what only
looks alike, and propose stars with random centres between members of different
components. They end when no untested pair is left to propose, or when many
rounds in a row have confirmed nothing. Before them whatever shares a rare
shingle is tested, by a prefix filter, so the rounds are only for sets that can
have a link through frequent shingles alone. Of those, families that share such
shingles are tested pair by pair in blocks; larger ones take the rounds first, which
join what they can at little cost.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..operators.components import connected_components, merged_components
from ..scratch import Scratch
from .words import U64, Words, lists, mix, one_per_id, seeds, signed, slices, with_repeats

BAND_ROWS, BANDS = 5, 40
#: Centres of a bucket in each later round, and the rounds in a row without a link that end the rounds.
CENTRES, QUIET = 3, 10
#: A shingle of so many sets at most proposes every pair of them before the rounds begin.
HOLDERS = 64
#: Sets that share more frequent shingles are tested pair by pair in blocks of ``BLOCK``, at once if no more than ``FAMILY`` hang together, else after the rounds.
FAMILY, BLOCK = 1 << 14, 512
#: A block has about as many shingles at most, and a set meets the blocks up to so many on from its own at a time, so that a large family needs little memory and disk.
WEIGHT, AHEAD = 1 << 20, 16
#: Shingles of two blocks that are compared at a time.
COLUMNS = 1 << 12


class OnePermutation:
    """Signatures of shingle sets given as sorted distinct hashes."""

    def __init__(self, rows: int, bands: int):
        self.rows, self.bands, self.bins = rows, bands, rows * bands
        tries = 64 * self.bins
        self.order = (seeds(tries, 5) % U64(self.bins)).astype(np.int64).reshape(self.bins, 64)
        self.factor = (seeds(rows, 6) | U64(1))[None, :]
        self.salt = seeds(bands, 7)

    def signature(self, s: np.ndarray) -> np.ndarray:
        bins = (((s >> U64(32)) * U64(self.bins)) >> U64(32)).astype(np.int64)
        first = np.flatnonzero(np.diff(bins, prepend=-1))
        values, full = np.zeros(self.bins, dtype=U64), np.zeros(self.bins, dtype=bool)
        values[bins[first]] = s[first]
        full[bins[first]] = True
        empty, turn = np.flatnonzero(~full), 0
        while len(empty):
            # beyond the table's 64 tries the sequence goes on with a shifted start
            look = (self.order[empty] + turn * 7919) % self.bins
            hit = full[look]
            found = hit.any(axis=1)
            at = look[np.arange(len(empty)), hit.argmax(axis=1)]
            values[empty[found]] = values[at[found]]
            empty, turn = empty[~found], turn + 1
        return values

    def keys(self, s: np.ndarray) -> np.ndarray:
        """One 64-bit bucket key for each band."""
        sig = self.signature(s).reshape(self.bands, self.rows)
        with np.errstate(over="ignore"):
            return mix((mix(sig) * self.factor).sum(axis=1, dtype=U64) + self.salt)


def fingerprint(s: np.ndarray) -> tuple[int, int]:
    """128 bits of a set of hashes, whatever their order."""
    with np.errstate(over="ignore"):
        a, b = mix(s ^ U64(0x243F6A8885A308D3)).sum(dtype=U64), mix(s + U64(0x13198A2E03707344)).sum(dtype=U64)
    return a.astype(np.int64).item(), b.astype(np.int64).item()


def _signatures(width: int, rows: int, bands: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        oph = OnePermutation(rows, bands)
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            for start, part in slices(texts):
                words = Words(part)
                n, hi, lo, keys = [], [], [], []
                for i in range(len(part)):
                    s = np.unique(words.shingles(i, width))
                    a, b = fingerprint(s) if len(s) else (None, None)
                    n.append(len(s))
                    hi.append(a)
                    lo.append(b)
                    keys.append(oph.keys(s) if len(s) else s)
                yield pa.RecordBatch.from_arrays([ids.slice(start, len(part)), pa.array(n, pa.int64()), pa.array(hi, pa.int64()), pa.array(lo, pa.int64()), lists(keys)], ["doc_id", "n_shingles", "hi", "lo", "keys"])

    return run


def _sets(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, part in slices(batch.column(1)):
                words = Words(part)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(start, len(part)), lists([np.unique(words.shingles(i, width)) for i in range(len(part))])], ["id", "shingles"])

    return run


def near_duplicates(docs: DataFrame, *, width: int = 5, percent: int = 80, rows: int = BAND_ROWS, bands: int = BANDS, quiet: int = QUIET) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept), one row per input row.

    Links documents whose sets of distinct ``width``-word shingles (A-Z
    lower-cased) have ``100 * intersection >= percent * union``. Null, empty and
    blank texts have an empty set and link with nothing. Texts with fewer words
    are one shingle. Rows of equal sets form one class whatever their number;
    only its smallest id takes part. Rows that share a doc_id count as one
    document, that of the least text; a row with a null doc_id gets its class's
    component and is never kept unless it has no component. doc_id may be of any
    type that orders; other columns are ignored. A link of exactly ``percent``
    shares no bucket with probability ``(1 - (percent/100)**rows)**bands``, 1e-7 by
    default; one that does is tested, or its ends are connected through others.
    """
    scratch = Scratch(docs.sparkSession, "neardup")
    kind = docs.schema["doc_id"].dataType.simpleString()
    docs = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    single = one_per_id(docs, scratch)
    sigs = scratch.save(single.mapInArrow(_signatures(width, rows, bands), f"doc_id {kind}, n_shingles long, hi long, lo long, keys array<long>"), "signatures")
    # one row per distinct set; min and any_value aggregate before the shuffle
    classes = sigs.where("hi IS NOT NULL").groupBy("hi", "lo").agg(F.min("doc_id").alias("node"), F.any_value("keys").alias("keys"))
    members = scratch.save(classes.where("node IS NOT NULL").select("node", F.posexplode("keys").alias("band", "key")), "members")
    stars = members.groupBy("key").agg(F.min("node").alias("centre"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    # written, so that the join is of two shuffled tables and AQE can split the bucket of a large group
    stars = scratch.save(stars, "stars")
    shared = scratch.save(members.join(stars, "key"), "shared")  # members of buckets of two or more
    scratch.drop("members", "stars")
    tested = scratch.save(shared.where("node <> centre").select(F.col("centre").alias("a"), F.col("node").alias("b")).distinct(), "pairs-0")
    ends = tested.select(F.col("a").alias("doc_id")).union(tested.select("b")).distinct()
    # shuffled at every size, so that small inputs tell what large ones need
    sets = scratch.save(single.join(ends.hint("merge"), "doc_id", "left_semi").select("doc_id", "text").mapInArrow(_sets(width), f"id {kind}, shingles array<long>"), "sets")
    components = connected_components(scratch.save(_confirmed(tested, sets, percent), "links-0"), scratch, "components-0")
    # from here on only buckets with several components count
    named = shared.select("node", "band", "key").join(components.toDF("node", "component"), "node", "left").withColumn("component", F.coalesce("component", "node"))
    mixed = named.groupBy("key").agg(F.min("component").alias("a"), F.max("component").alias("b")).where("a < b").select("key")
    own = shared.select("node", "band", "key").join(scratch.save(mixed, "mixed"), "key", "left_semi").groupBy("node").agg(F.map_from_entries(F.collect_set(F.struct("band", "key"))).alias("keys"))
    own = scratch.save(own, "own")
    scratch.drop("shared", "mixed")
    open_sets = scratch.save(sets.join(own.select(F.col("node").alias("id")), "id", "left_semi"), "open")
    scratch.drop("sets")
    step, still, large = 0, quiet, False
    if own.limit(1).count():
        prefix = _prefixes(open_sets, percent, scratch)
        proposed = scratch.save(_by_rare_shingles(prefix, components, tested, percent), "pairs-rare")
        links = scratch.save(_confirmed(proposed, open_sets, percent), "links-rare")
        tested = tested.union(proposed)
        if links.limit(1).count():
            components = merged_components(components, links, scratch, "components-rare")
        # a set without a frequent shingle in its prefix has no link left; of the others those in large families go on
        families = _families(prefix, components, scratch, "families")
        components = _by_blocks(families.where(F.col("size") <= FAMILY), open_sets, components, percent, scratch, "blocks")
        own = scratch.save(own.join(families.where(F.col("size") > FAMILY).select("node"), "node", "left_semi"), "own-frequent")
        large = own.limit(1).count() > 0
        still = 0 if large else quiet
    while still < quiet:
        step += 1
        proposed = scratch.save(_fresh(own, components, tested, bands, step, scratch), f"pairs-{step}")
        still += 1
        if not proposed.limit(1).count():
            continue
        links = scratch.save(_confirmed(proposed, open_sets, percent), f"links-{step}")
        tested = tested.union(proposed)
        if links.limit(1).count():
            components, still = merged_components(components, links, scratch, f"components-{step}"), 0
    if large:
        # rounds that confirm nothing do not tell that nothing is left
        families = _families(prefix.join(own.select("node"), "node", "left_semi"), components, scratch, "families-left")
        components = _by_blocks(families, open_sets, components, percent, scratch, "blocks-left")
    node = classes.drop("keys")
    labelled = node.join(components.toDF("node", "component"), "node", "left").select("hi", "lo", F.coalesce("component", "node").alias("component"))
    labelled = scratch.save(labelled, "labelled")
    scratch.keep_only("signatures", "labelled", "torn", "chosen")
    joined = sigs.select("doc_id", "n_shingles", "hi", "lo").join(labelled, ["hi", "lo"], "left")
    joined = joined.select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))
    joined = joined.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.col("component_id").isNull()))
    return with_repeats(joined, scratch)


def combination(step: int, bands: int) -> tuple[int, ...]:
    """How far on from its first band the bands of a key lie in round ``step``: all pairs of bands first, then triples, and so on."""
    half, apart = bands // 2, []
    step -= 1
    while True:
        apart.append(1 + step % half)
        step = step // half - 1
        if step < 0:
            return tuple(sum(apart[: i + 1]) for i in range(len(apart)))


def _fresh(own: DataFrame, components: DataFrame, tested: DataFrame, bands: int, step: int, scratch: Scratch) -> DataFrame:
    """Untested pairs (a, b) of different components: stars in the buckets of this round's combinations of bands."""
    named = own.join(components.toDF("node", "component"), "node", "left").withColumn("component", F.coalesce("component", "node"))
    keyed = named.select("node", "component", "keys", F.explode(F.map_keys("keys")).alias("band"))
    parts = [F.try_element_at("keys", F.pmod(F.col("band") + far, F.lit(bands))) for far in (0, *combination(step, bands))]
    keyed = keyed.select("node", "component", F.when(F.greatest(*(p.isNull().cast("int") for p in parts)) == 0, F.xxhash64(*parts, F.lit(step))).alias("key")).where("key IS NOT NULL")
    # both columns of a centre come from the row with the least order, which is one row's alone
    order = [F.xxhash64("node", "key", F.lit(i)) for i in range(CENTRES)]
    picks = [F.min_by(c, o).alias(f"{c}{i}") for i, o in enumerate(order) for c in ("node", "component")]
    centre = keyed.groupBy("key").agg(*picks, F.min("component").alias("a"), F.max("component").alias("b")).where("a < b")
    centre = scratch.save(centre.select("key", F.array(*(F.struct(F.col(f"node{i}").alias("centre"), F.col(f"component{i}").alias("other")) for i in range(CENTRES))).alias("centres")), f"centres-{step}")
    pairs = keyed.join(centre, "key").select("node", F.explode(F.filter("centres", lambda c: c["other"] != F.col("component"))).alias("c"))
    return pairs.select(F.least("c.centre", "node").alias("a"), F.greatest("c.centre", "node").alias("b")).distinct().join(tested, ["a", "b"], "left_anti")


def _prefixes(sets: DataFrame, percent: int, scratch: Scratch) -> DataFrame:
    """(node, n, at, x, held): the first n - ceil(n * percent / 100) + 1 shingles of each set, by the number of sets that hold them, and their places from 1 on; without those that one set holds alone.

    Sets that are similar enough have one of these in common, whatever the order.
    """
    named = sets.select(F.col("id").alias("node"), F.size("shingles").alias("n"), F.explode("shingles").alias("x"))
    held = scratch.save(named.groupBy("x").agg(F.count(F.lit(1)).alias("held")).where("held > 1"), "held")
    # shingles of one set only come first and meet nobody, so it is enough to know how many a set has
    common = named.join(held, "x").groupBy("node", "n").agg(F.array_sort(F.collect_list(F.struct("held", "x"))).alias("common"))  # no more than one set
    alone = F.col("n") - F.size("common")
    first = F.col("n") - F.ceil(F.col("n") * percent / 100).cast("int") + 1 - alone
    rows = common.where(first > 0).select("node", "n", alone.alias("alone"), F.posexplode(F.slice("common", F.lit(1), first)).alias("i", "c"))
    return scratch.save(rows.select("node", "n", (F.col("alone") + F.col("i") + 1).alias("at"), F.col("c.x").alias("x"), F.col("c.held").alias("held")), "prefix")


def _by_rare_shingles(prefix: DataFrame, components: DataFrame, tested: DataFrame, percent: int) -> DataFrame:
    """Untested pairs (a, b) of different components that share a shingle of their prefixes, if no more than ``HOLDERS`` sets have it.

    A similar pair's first common shingle has enough shingles behind it in both sets, so pairs are left out that have none such.
    """
    rare = prefix.where(F.col("held") <= HOLDERS).join(components.toDF("node", "component"), "node", "left").withColumn("component", F.coalesce("component", "node"))
    group = rare.groupBy("x").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.collect_list(F.struct("node", "component", "n", "at")).alias("g")).where("lo < hi")  # HOLDERS at most

    def may(q):
        behind = 1 + F.least(F.col("p.n") - F.col("p.at"), q["n"] - q["at"])
        return (F.col("p.node") < q["node"]) & (F.col("p.component") != q["component"]) & (behind * (100 + percent) >= (F.col("p.n") + q["n"]) * percent)

    pairs = group.select(F.explode("g").alias("p"), "g").select("p", F.explode(F.filter("g", may)).alias("q"))
    return pairs.select(F.col("p.node").alias("a"), F.col("q.node").alias("b")).distinct().join(tested, ["a", "b"], "left_anti")


def _families(prefix: DataFrame, components: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """(node, family, size, weight): the sets that share frequent shingles of their prefixes with sets of other components, by what hangs together through these, with a family's sets and shingles."""
    often = prefix.where(F.col("held") > HOLDERS).join(components.toDF("node", "component"), "node", "left").select("x", "node", "n", F.coalesce("component", "node").alias("component"))
    often = scratch.save(often, f"{name}-often")
    mixed = often.groupBy("x").agg(F.min("node").alias("first"), F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi").select("x", "first")
    families = connected_components(often.join(mixed, "x").select(F.col("first").alias("a"), F.col("node").alias("b")).distinct(), scratch, name).toDF("node", "family")
    sizes = families.join(often.select("node", "n").distinct(), "node").groupBy("family").agg(F.count(F.lit(1)).alias("size"), F.sum("n").alias("weight"))
    return scratch.save(families.join(sizes, "family").select("node", "family", "size", "weight"), f"{name}-sized")


def _by_blocks(families: DataFrame, sets: DataFrame, components: DataFrame, percent: int, scratch: Scratch, name: str) -> DataFrame:
    """``components`` joined by all links between different ones of a family: each pair of its blocks is compared in one task.

    Blocks lie on a ring. In one turn each meets those up to ``AHEAD`` on from it on both sides, in the next one as many further ones, so what
    is shuffled at a time grows with the families, not with their pairs; sets that a turn joined are not compared again.
    """
    blocks = F.greatest(F.ceil(F.col("size") / BLOCK), F.ceil(F.col("weight") / WEIGHT)).cast("int")
    dealt = families.select("node", "family", blocks.alias("blocks")).withColumn("block", F.pmod(F.xxhash64("node"), "blocks").cast("int"))
    kind = families.schema["node"].dataType.simpleString()
    most = families.agg(F.max(blocks)).first()[0] or 0
    for turn, near in enumerate(range(0, most // 2 + 1 if most else 0, AHEAD + 1)):
        met = dealt.where(F.floor(F.col("blocks") / 2) >= near).join(components.toDF("node", "component"), "node", "left").withColumn("component", F.coalesce("component", "node"))
        apart = F.sequence(F.lit(near), F.least(F.lit(near + AHEAD), F.floor(F.col("blocks") / 2).cast("int")))
        others = F.array_distinct(F.concat(F.transform(apart, lambda d: F.pmod(F.col("block") + d, F.col("blocks"))), F.transform(apart, lambda d: F.pmod(F.col("block") - d, F.col("blocks")))))
        rows = met.join(sets.withColumnRenamed("id", "node"), "node").withColumn("other", F.explode(others))
        rows = rows.select("family", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "node", "component", "shingles")
        # one link of two components is enough
        links = scratch.save(rows.groupBy("family", "i", "j").applyInArrow(_linked(percent), f"a {kind}, b {kind}").distinct(), f"links-{name}-{turn}")
        if links.limit(1).count():
            components = merged_components(components, links, scratch, f"components-{name}-{turn}")
    return components


def _linked(percent: int):
    def run(table: pa.Table) -> pa.Table:
        block, node = table.column("block").to_numpy(), table.column("node").combine_chunks()
        component = table.column("component").combine_chunks().dictionary_encode().indices.to_numpy()
        if len(np.unique(component)) == 1:
            return pa.table({"a": node.slice(0, 0), "b": node.slice(0, 0)})
        shingles = table.column("shingles").combine_chunks()
        n = shingles.value_lengths().to_numpy().astype(np.int64)
        left, right = np.flatnonzero(block == block.min()), np.flatnonzero(block == block.max())
        names, column, held = np.unique(shingles.flatten().to_numpy(), return_inverse=True, return_counts=True)
        row = np.repeat(np.arange(len(n)), n)
        order = np.argsort(column, kind="stable")
        order = order[held[column[order]] > 1]
        row, column = row[order], column[order]
        both = np.zeros((len(left), len(right)), dtype=np.float32)
        for at in range(0, len(names), COLUMNS):
            part = slice(*np.searchsorted(column, [at, at + COLUMNS]))
            if part.start < part.stop:
                has = np.zeros((len(n), min(COLUMNS, len(names) - at)), dtype=np.float32)
                has[row[part], column[part] - at] = 1
                both += has[left] @ has[right].T
        near = 100 * both.astype(np.int64) >= percent * (n[left][:, None] + n[right][None, :] - both.astype(np.int64))
        a, b = np.nonzero(near & (component[left][:, None] != component[right][None, :]))
        a, b = left[a], right[b]
        low, high = np.minimum(component[a], component[b]).astype(np.int64), np.maximum(component[a], component[b])
        _, one = np.unique(low * len(n) + high, return_index=True)
        return pa.table({"a": node.take(pa.array(a[one])), "b": node.take(pa.array(b[one]))})

    return run


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs whose full sets are similar enough. The member's set travels to the centre, never the centre's."""
    of = pairs.join(sets.select(F.col("id").alias("b"), F.col("shingles").alias("sb")), "b")
    of = of.join(sets.select(F.col("id").alias("a"), F.col("shingles").alias("sa")), "a")
    of = of.select("a", "b", F.size("sa").alias("na"), F.size("sb").alias("nb"), F.size(F.array_intersect("sa", "sb")).alias("both"))
    return of.where(F.col("both") * 100 >= percent * (F.col("na") + F.col("nb") - F.col("both"))).select("a", "b")
