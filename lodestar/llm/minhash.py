"""MinHash near-dedup: fast similarity sketches, banding, and links confirmed on full shingle sets."""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpoint_dir, connected_components, durable, give_back, local_roots, partitions, slices, table, utf8
from .words import Words, mix

FREE = np.uint64(2**64 - 1)
#: Coordinates of a sketch: BANDS bands of ROWS. Two sets of similarity s share no band with probability (1 - s**ROWS)**BANDS, 7e-9 at 0.85.
BANDS, ROWS = 32, 5
FOUND = "doc_id long, n_shingles long, h1 long, h2 long, keys array<long>"
LINKS = "src long, dst long"


def shingle_sets(texts: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, edges by text) of every text's distinct shingles of `width` words, sorted; of a text with fewer words its whole sequence is one."""
    words = Words(texts)
    counts = np.diff(words.word_edge)
    h, _, edges = words.shingles(width)
    owner = np.repeat(np.arange(len(texts)), np.diff(edges))
    short = np.flatnonzero((counts > 0) & (counts < width))
    if len(short):
        whole = np.zeros(len(short), np.uint64)
        for k in range(width - 1):  # the k-th word of each, where there is one
            has = counts[short] > k
            whole[has] = mix(whole[has] * np.uint64(5) + words.hash[words.word_edge[short[has]] + k] + np.uint64(k + 1))
        h, owner = np.r_[h, whole], np.r_[owner, short]
    order = np.lexsort((h, owner))
    h, owner = h[order], owner[order]
    new = np.r_[True, (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])] if len(h) else np.zeros(0, bool)
    return h[new], np.searchsorted(owner[new], np.arange(len(texts) + 1))


def sketches(h: np.ndarray, edges: np.ndarray, t: int = BANDS * ROWS) -> np.ndarray:
    """One row of `t` coordinates per set; equal coordinates of two rows have the sets' Jaccard similarity as probability.

    Round i puts every element of a set into a hashed bin with value i + fraction, and a bin keeps its least value. After the
    first round that leaves no bin of a set empty its sketch is final, as later values are greater; a set of n elements takes about
    t ln t / n rounds. Rounds t to 2t - 1 put all elements into bin i - t, so every coordinate is filled for certain, and the values, drawn
    nearly without replacement, are as concentrated as those of t independent permutations or more so.
    """
    sizes = np.diff(edges)
    out = np.full((len(sizes), t), FREE)
    live = np.flatnonzero(sizes)
    owner = np.repeat(np.arange(len(sizes)), sizes)
    for i in range(2 * t):
        if not len(live):
            break
        r = mix(h + np.uint64((i + 1) * 0x9E3779B97F4A7C15 % 2**64))
        bins = ((r >> np.uint64(40)) * np.uint64(t) >> np.uint64(24)).astype(np.int64) if i < t else i - t
        np.minimum.at(out.reshape(-1), owner * t + bins, np.uint64(i << 32) | r & np.uint64(0xFFFFFFFF))
        full = (out[live] != FREE).all(axis=1)
        if full.any():
            live = live[~full]
            stay = np.zeros(len(sizes), bool)
            stay[live] = True
            stay = stay[owner]
            h, owner = h[stay], owner[stay]
    return out


def band_keys(sketch: np.ndarray, rows: int) -> np.ndarray:
    """A hash per band of `rows` coordinates, different for equal coordinates of other bands."""
    bands = sketch.shape[1] // rows
    grid = sketch[:, : bands * rows].reshape(-1, bands, rows)
    key = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64), grid.shape[:2]).copy()
    for k in range(rows):
        key = mix(key * np.uint64(0x94D049BB133111EB) + grid[:, :, k])
    return key


def with_sketches(docs: DataFrame, width: int, bands: int, rows: int) -> DataFrame:
    """FOUND for every row of `docs`: size of the shingle set, 128 bits that name the set, and its band keys."""
    def run(batches):
        for batch in slices(batches):
            h, edges = shingle_sets([utf8(t) for t in batch.column(1).to_pylist()], width)
            sizes = np.diff(edges)
            total = [np.r_[np.uint64(0), np.cumsum(mix(h ^ np.uint64(salt)))] for salt in (0x5DEECE66D, 0xB5026F5AA96619E9)]
            h1, h2 = (t[edges[1:]] - t[edges[:-1]] for t in total)
            keys = band_keys(sketches(h, edges, bands * rows), rows)[sizes > 0]
            at = np.r_[0, np.cumsum(np.where(sizes > 0, bands, 0))].astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes.astype(np.int64)), pa.array(h1.view(np.int64)), pa.array(h2.view(np.int64)), pa.ListArray.from_arrays(pa.array(at), pa.array(keys.ravel().view(np.int64)))],
                names=["doc_id", "n_shingles", "h1", "h2", "keys"])
        give_back()

    return docs.mapInArrow(run, FOUND)


def sets_of(docs: DataFrame, wanted: DataFrame, width: int, bits: int = 1 << 24) -> DataFrame:
    """(rep, shingles as sorted 64-bit hashes) of the documents whose doc_id is in `wanted` (rep), a table in the shared folder that is dealt by rep.

    Texts do not move: a bitmap of `bits` hashed ids, whatever the number of documents, leaves out most others where they are read, and
    an equi join the rest.
    """
    spark = docs.sparkSession
    place = lambda col: F.pmod(F.xxhash64(col), F.lit(bits).cast("long"))
    spot = wanted.select(place("rep").alias("p"))
    words = spot.groupBy(F.shiftright("p", 5).cast("int").alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(p & 31 AS INT))")).alias("b")).collect()
    bitmap = np.zeros(bits // 32, np.uint32)
    bitmap[[r.w for r in words]] = [r.b for r in words]
    sent = spark.sparkContext.broadcast(bitmap.tobytes())

    def run(batches):
        known = np.unpackbits(np.frombuffer(sent.value, np.uint8), bitorder="little")
        for batch in slices(batches):
            batch = batch.filter(pa.array(known[batch.column(2).to_numpy()].astype(bool)))
            if batch.num_rows:
                h, edges = shingle_sets([utf8(t) for t in batch.column(1).to_pylist()], width)
                data = h.tobytes()
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([data[8 * a : 8 * b] for a, b in zip(edges[:-1].tolist(), edges[1:].tolist())], pa.binary())], names=["rep", "shingles"])
        give_back()

    found = docs.where("doc_id IS NOT NULL").select("doc_id", "text", place("doc_id").alias("place")).mapInArrow(run, "rep long, shingles binary")
    name = f"minhash_{uuid.uuid4().hex}"
    exact = found.join(wanted, "rep", "left_semi").dropDuplicates(["rep", "shingles"])
    exact.write.bucketBy(partitions(spark), "rep").option("path", f"{checkpoint_dir(spark)}/{name}").saveAsTable(name)
    return spark.table(name)


def similar(both, n_a, n_b, percent: int):
    return 100 * both >= percent * (n_a + n_b - both)


def common_counts(a: list[np.ndarray], b: list[np.ndarray], most: int = 8192) -> np.ndarray:
    """Sizes of the intersections of every set of `a` with every set of `b`: tiles of incidence matrices, `most` shingles wide."""
    ha, hb = np.concatenate(a), np.concatenate(b)
    shared = np.intersect1d(ha, hb)
    out = np.zeros((len(a), len(b)), np.float64)
    if not len(shared):
        return out
    sides = []
    for h, sets in ((ha, a), (hb, b)):
        row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        at = np.minimum(np.searchsorted(shared, h), len(shared) - 1)
        hit = shared[at] == h
        order = np.argsort(at[hit], kind="stable")
        sides.append((row[hit][order], at[hit][order], len(sets)))
    for low in range(0, len(shared), most):
        tiles = []
        for row, at, n in sides:
            x, y = np.searchsorted(at, [low, low + most])
            tile = np.zeros((n, min(most, len(shared) - low)), np.float32)
            tile[row[x:y], at[x:y] - low] = 1
            tiles.append(tile)
        out += tiles[0] @ tiles[1].T
    return out


def _compare(percent: int):
    """Groups of homes and askers, sorted by group, to stars of the links between them; a row may be both."""
    def links(rows: list[dict]):
        sides = [[r for r in rows if r[kind]] for kind in ("asks", "hosts")]
        if not all(sides):
            return None
        label, rep = (tuple(np.array([r[c] for r in side])[:, None] for side in sides) for c in ("label", "rep"))
        # of two that both ask each other one comparison will do
        apart = (label[0] != label[1].T) & ~(np.array([r["outside"] for r in sides[1]])[None, :] & (rep[0] < rep[1].T))
        if not apart.any():
            return None
        a, b = ([np.frombuffer(r["shingles"], np.uint64) for r in side] for side in sides)
        na, nb = (np.array([len(s) for s in side])[:, None] for side in (a, b))
        x, y = np.nonzero(apart & similar(common_counts(a, b), na, nb.T, percent))
        return (rep[0][x, 0], rep[1][y, 0]) if len(x) else None

    def run(batches):
        group, rows = None, []

        def flush():
            found = links(rows)
            if found:
                pairs = [(x, y) for x, y in local_roots(*found).items() if x != y]
                yield pa.RecordBatch.from_pydict({"src": pa.array([p[0] for p in pairs], pa.int64()), "dst": pa.array([p[1] for p in pairs], pa.int64())})

        for batch in batches:
            for r in batch.to_pylist():
                now = r["key"], r["home"], r["asker"]
                if now != group:
                    yield from flush()
                    group, rows = now, []
                rows.append(r)
        yield from flush()
        give_back()

    return run


def _compared(groups: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links within groups (key, home, asker) of rows (rep, label, outside, asks, hosts)."""
    dealt = groups.join(sets, "rep").repartition(partitions(groups.sparkSession), "key", "home", "asker").sortWithinPartitions("key", "home", "asker")
    return dealt.select("key", "home", "asker", "rep", "label", "outside", "asks", "hosts", "shingles").mapInArrow(_compare(percent), LINKS)


def first_links(mixed: DataFrame, sets: DataFrame, percent: int, turn: int, block: int) -> DataFrame:
    """Links found where every member (key, rep, n, label) goes to one block of about `block` members of its largest bucket, with all pairs of a block compared."""
    sized = mixed.groupBy("key").agg(F.count("*").alias("m"))
    choice = mixed.join(sized, "key").groupBy("rep").agg(F.max(F.struct("m", "key")).alias("to"), F.min("label").alias("label"))
    put = choice.select(F.col("to.key").alias("key"), F.pmod(F.xxhash64("rep", F.lit(turn)), F.ceil(F.col("to.m") / block)).cast("int").alias("home"), "rep", "label")
    several = put.groupBy("key", "home").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo <> hi").select("key", "home")
    yes = F.lit(True)
    return _compared(put.join(several, ["key", "home"]).select("key", "home", F.lit(0).alias("asker"), "rep", "label", yes.alias("outside"), yes.alias("asks"), yes.alias("hosts")), sets, percent)


def remaining_links(mixed: DataFrame, sets: DataFrame, percent: int, block: int, most: int = 1 << 21) -> DataFrame:
    """Links between members (key, rep, n, label) of one bucket that carry different labels: all such pairs are compared, in blocks.

    The most frequent label of a bucket is its hub; members outside it are the ones that ask. Homes and askers of a bucket are cut into blocks of about
    `block` members and `most` shingles, and each block of askers meets each block of homes in one group. Buckets of the same members are compared once.
    """
    per_label = mixed.groupBy("key", "label").agg(F.count("*").alias("m"), F.sum("n").alias("w"), F.sum(F.xxhash64("rep").cast("decimal(38,0)")).alias("sign"))
    hub = per_label.groupBy("key").agg(F.sum("m").alias("m"), F.sum("w").alias("w"), F.sum("sign").alias("sign"), F.max(F.struct("m", "w", "label")).alias("hub"), F.count("*").alias("labels"))
    hub = hub.where("labels > 1").dropDuplicates(["m", "w", "sign"])
    cuts = lambda m, w: F.ceil(F.greatest(m / block, w / most)).cast("int")
    sized = hub.select("key", F.col("hub.label").alias("hub"), cuts(F.col("m"), F.col("w")).alias("homes"), cuts(F.col("m") - F.col("hub.m"), F.col("w") - F.col("hub.w")).alias("askers"))
    each = mixed.join(sized, "key").withColumn("outside", F.col("label") != F.col("hub")).withColumn("h", F.pmod(F.xxhash64("rep"), "homes").cast("int")).withColumn("a", F.pmod(F.xxhash64("rep", F.lit(1)), "askers").cast("int"))
    # a group of one block of each takes a row once, as both
    spot = lambda home, asker, asks, hosts: F.struct(home.cast("int").alias("home"), asker.cast("int").alias("asker"), asks.alias("asks"), hosts.alias("hosts"))
    no, yes, h, a = F.lit(False), F.lit(True), F.col("h"), F.col("a")
    hosting = F.transform(F.sequence(F.lit(0), F.col("askers") - 1), lambda k: spot(h, k, F.col("outside") & (k == a), yes))
    asking = F.transform(F.sequence(F.lit(0), F.col("homes") - 1), lambda k: spot(k, a, yes, no))
    spots = F.when(F.col("outside"), F.concat(hosting, F.filter(asking, lambda g: g["home"] != h))).otherwise(hosting)
    return _compared(each.withColumn("g", F.explode(spots)).select("key", "g.home", "g.asker", "rep", "label", "outside", "g.asks", "g.hosts"), sets, percent)


def minhash_components(docs: DataFrame, percent: int = 80, width: int = 5, bands: int = BANDS, rows: int = ROWS, rounds: int = 3, block: int = 1024) -> DataFrame:
    """One row per row of `docs` (doc_id, text): doc_id, n_shingles, component_id, kept.

    Documents are linked if their sets of `width`-word shingles have a Jaccard similarity of `percent` hundredths or more; component_id is the smallest
    doc_id reachable, itself included, and kept says whether it is the row's own. Equal sets are one node, so copies cost nothing. Nodes that share a band are
    candidates. In a round every node of a bucket of several components goes to one block of its largest bucket, where all pairs are compared, so a
    tight group of any size becomes one component while each member moves once a round; the first round takes all buckets, later ones those of more
    than a block's size. Then all pairs of different components that share a bucket are compared in blocks of about `block` members, so that no candidate is left out. A pair at the threshold
    0.85 shares no bucket with a probability of 7e-9, at 0.8 of 2e-6.

    A text with fewer words is one shingle; without words (null, empty, white space) it has an empty set and is linked with nothing. A row with null
    doc_id joins the component of the rows with its set; if there are none, component_id is null and the row is kept. Repeated rows repeat in the result; an
    empty table gives an empty result; other columns are ignored. A text of any length is held by one task, at some 40 bytes a word.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = durable(with_sketches(docs, width, bands, rows))
    some = found.where("n_shingles > 0")
    nodes = some.where("doc_id IS NOT NULL").groupBy("h1", "h2").agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n"), F.first("keys").alias("keys"))
    each = nodes.select("rep", F.explode("keys").alias("key"))
    shared = each.groupBy("key").count().where("count > 1").select("key")
    sizes = some.groupBy(F.col("doc_id").alias("rep")).agg(F.max("n_shingles").alias("n"))
    mixed = each.join(shared, "key")
    mixed = durable(mixed.join(sizes, "rep").withColumn("label", F.col("rep")))
    spark = docs.sparkSession
    sets = sets_of(docs, mixed.select("rep").distinct(), width)
    links, large = None, mixed
    for turn in range(rounds):
        if large.isEmpty():
            break
        more = durable(first_links(large, sets, percent, turn, block))
        links = more if links is None else links.unionByName(more)
        named = connected_components(links).select(F.col("node").alias("rep"), F.col("component").alias("label"))
        now = mixed.drop("label").join(named, "rep", "left").withColumn("label", F.coalesce("label", "rep"))
        several = now.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.count("*").alias("m")).where("lo <> hi").select("key", "m")
        mixed = durable(now.join(several, "key"))
        large = mixed.where(F.col("m") > block).drop("m")
        mixed = mixed.drop("m")
    if not mixed.isEmpty():
        more = durable(remaining_links(mixed, sets, percent, block))
        links = more if links is None else links.unionByName(more)
    named = connected_components(spark.createDataFrame([], LINKS) if links is None else links)
    reps = some.where("doc_id IS NOT NULL").groupBy("h1", "h2").agg(F.min("doc_id").alias("rep"))
    labelled = reps.join(named.withColumnRenamed("node", "rep"), "rep", "left").select("h1", "h2", F.coalesce("component", "rep").alias("component_id"))
    full = some.join(labelled, ["h1", "h2"], "left").select("doc_id", "n_shingles", "component_id")
    none = found.where("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return full.unionByName(none).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.col("component_id").isNull()))


def op11_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_components(table(spark, sf_dir, "documents"), percent=85)
