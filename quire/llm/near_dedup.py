"""Near-duplicates by bottom-k sketches from one hash function.

1. Each text becomes its set of distinct word shingles, hashed once; the set is written to the shared folder and its RETAINED
   smallest values are its sketch. Equal sets collapse to one class.
2. Inverted lists of retained values give candidates. Values in more than HOT sketches rank after all others: a set is listed
   under its KEYS smallest other values. Two sets of similarity 0.8 share each with chance 0.8 or more, so they miss each other
   with chance under 0.2 ** KEYS where few values are hot; where just under HOT_SHARE of them are and all edits lie among the
   others, about half of the others are shared and the chance is up to 0.5 ** KEYS (2e-4).
   Sets whose sketch is mostly hot (texts around a common passage, families of copies) are listed by prefix filtering over their
   DEEP smallest values: in the order of how many such sets hold a value, rarest first, two sets of similarity t share one of the
   first n - ceil(t n) + 1. For sets of DEEP values or fewer this is exact; for larger ones SLACK more are taken (four deviations).
   A set is heavy in a list whose value stands so late in its order that what follows can't make it similar to one of its size or
   larger (the first n / 9 + 1 are early enough); two heavy sets aren't compared. Texts that share a passage and differ beyond the
   bound thus aren't compared with one another, however many they are.
3. Within a list, the sketches' overlap estimates the similarity of the union and filters; the full sets decide. Only the links
   that join two components of a list are passed on, so a group of copies gives a tree, not all pairs. Lists of over BLOCK
   members are dealt to blocks, each with the list's smallest set as its hub. Members that the hub doesn't reach are dealt to
   blocks again, and each two of those blocks, and each of them with each other block, meet in one group of their own: none holds
   more than about two blocks, two members are compared once, and blocks of heavy members don't meet each other.
4. Components of the links, classes included, give each document the smallest doc_id that it reaches.

Defined results: null, empty and blank texts have no shingles and are alone; rows that repeat a doc_id count as one document
in links; a row without a doc_id belongs to its class's component and isn't kept where a row of the class has a doc_id, and classes
of such rows alone are their own, without links, and kept (`kept_rows` keeps one row of each text among those); an empty table gives
an empty result; further columns are ignored (`components_of`) or passed on (`kept_rows`).
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .components import components
from .store import drop, filesystem, fresh, materialize, release, tasks, unused

RETAINED, KEYS = 32, 12
HOT = BLOCK = 1000
HOT_SHARE = 0.6
DEEP, SLACK = 256, 26
#: Overlap of two full sketches under which sets aren't compared; similarity 0.8 has 25.6 of 32 on average, deviation 2.3.
OVERLAP = 8
#: Values of a list's sets that are numbered at once, so that intersections are counted by number; beyond, they are searched for.
CODED = 1 << 22
SETS = "doc_id long, text_key long, n long, h1 long, h2 long, keys array<long>, file string, at long"


def sketch(docs: DataFrame, width: int, folder: str) -> DataFrame:
    """One row per row of docs; its set lies in folder/file from byte `at`, sorted, 8 bytes a value."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        from .shingles import mix, shingle_sets

        fs, base = filesystem(folder)
        name, out, at = uuid.uuid4().hex, None, 0
        try:
            for batch in batches:
                rows = [[] for _ in range(8)]
                for doc_id, key, own in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), shingle_sets(batch.column(1), width), strict=True):
                    h = mix(own + np.uint64(width))
                    row = (doc_id, key, len(own), h.sum(dtype=np.uint64).view(np.int64), np.bitwise_xor.reduce(mix(h + np.uint64(1)), initial=np.uint64(0)).view(np.int64), own[:RETAINED].view(np.int64), name, at)
                    for column, x in zip(rows, row, strict=True):
                        column.append(x)
                    if len(own):
                        out = out or fs.open_output_stream(f"{base}/{name}")
                        out.write(own.astype("<u8").tobytes())
                        at += 8 * len(own)
                types = [pa.int64()] * 5 + [pa.list_(pa.int64()), pa.string(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(rows, types, strict=True)], ["doc_id", "text_key", "n", "h1", "h2", "keys", "file", "at"])
        finally:
            if out:
                out.close()

    return docs.select(F.col("doc_id").cast("long"), "text", text_key().alias("text_key")).mapInArrow(run, SETS)


def text_key():
    """What names a row's text where its doc_id does not."""
    return F.xxhash64(F.coalesce("text", F.lit("")))


class Sets:
    """Reads sets by file and offset; keeps a few files open."""

    def __init__(self, folder: str):
        self.fs, self.base = filesystem(folder)
        self.open = {}

    def __call__(self, file: str, at: int, n: int):
        import numpy as np

        if file not in self.open:
            if len(self.open) > 64:
                for f in self.open.values():
                    f.close()
                self.open = {}
            self.open[file] = self.fs.open_input_file(f"{self.base}/{file}")
        return np.frombuffer(self.open[file].read_at(8 * n, at), "<u8")


def overlaps(a, sets: list, most: int = 1 << 20):
    """The sizes of the intersections of a with each of sets, which aren't empty; about `most` values at a time."""
    import numpy as np

    out, ends = [], np.cumsum([len(s) for s in sets])
    k = 0
    while k < len(sets):
        upto = max(k + 1, int(np.searchsorted(ends, (ends[k - 1] if k else 0) + most, "right")))
        own = np.concatenate(sets[k:upto])
        i = np.searchsorted(a, own)
        i[i == len(a)] = 0
        out.append(np.add.reduceat((a[i] == own).astype(np.int64), ends[k:upto] - [len(s) for s in sets[k:upto]] - (ends[k - 1] if k else 0)))
        k = upto
    return np.concatenate(out) if out else np.zeros(0, np.int64)


def link_group(ids: list[int], sets: list, percent: int, heavy: list[bool], asks: list[bool] | None = None) -> list[tuple[int, int]]:
    """Links that join the components of one list, each confirmed on full sets. Two heavy members aren't held against each other,
    and with asks two that don't ask neither. All that ask meet the first; those that it doesn't reach then meet all before them, and those
    that it does only what lies outside its component. What a member meets by its sketch is counted at once, by the places of values."""
    import numpy as np

    n = len(ids)
    asking = np.ones(n, bool) if asks is None else np.array(asks)
    burdened, size, links = np.array(heavy), np.array([len(s) for s in sets]), []
    component = np.arange(n)

    def alike(i: int, js, both):
        """One of js of each component that holds any like i."""
        js = js[100 * both >= percent * (size[i] + size[js] - both)]
        return js[np.unique(component[js], return_index=True)[1]].tolist()

    def link(i: int, j: int):
        if component[i] != component[j]:
            component[component == component[i]] = component[j]
            links.append((ids[i], ids[j]))

    hub = int(np.argmin(asking))
    meet = asking & ~(burdened & burdened[hub]) & (100 * np.minimum(size, size[hub]) >= percent * np.maximum(size, size[hub]))
    meet[hub] = False
    meet = np.flatnonzero(meet)
    for i in alike(hub, meet, overlaps(sets[hub], [sets[i] for i in meet])):
        link(i, hub)
    # those that don't ask, then those whom the hub reached, then the others
    order = np.lexsort((np.arange(n), component != component[hub], asking))
    if (component == component[hub]).all():
        return links
    sketches = [sets[i][:RETAINED] for i in order]
    lengths = np.array([len(s) for s in sketches])
    code = np.unique(np.concatenate(sketches), return_inverse=True)[1]
    by = np.argsort(code, kind="stable")
    holders, place, ends = np.repeat(order, lengths)[by], np.empty(len(by), np.int64), np.cumsum(lengths)
    place[by] = np.arange(len(by))
    start = np.searchsorted(code[by], code)  # where the holders of each value begin
    full, met_in = size >= RETAINED, None
    if size.sum() <= CODED:
        codes = np.unique(np.concatenate(sets), return_inverse=True)[1]
        codes, met_in = np.split(codes, np.cumsum(size)[:-1]), np.zeros(int(codes.max()) + 1, np.int64)
    for k, i in enumerate(order.tolist()):
        if not k or not asking[i] or (component[order[:k]] == component[i]).all():
            continue
        met = [holders[start[e] : place[e]] for e in range(ends[k] - lengths[k], ends[k]) if start[e] < place[e]]
        if not met:
            continue
        count = np.bincount(np.concatenate(met), minlength=n)
        near = (count >= np.where(full & full[i], OVERLAP, 1)) & (component != component[i]) & (100 * np.minimum(size, size[i]) >= percent * np.maximum(size, size[i]))
        near[hub] = False
        if burdened[i]:
            near &= ~burdened
        if not len(js := np.flatnonzero(near)):
            continue
        if met_in is None:
            both = overlaps(sets[i], [sets[j] for j in js])
        else:
            met_in[codes[i]] = 1
            both = np.add.reduceat(met_in[np.concatenate([codes[j] for j in js])], np.cumsum(size[js]) - size[js])
            met_in[codes[i]] = 0
        for j in alike(i, js, both):
            link(i, j)
    return links


def _link(lists: DataFrame, folder: str, percent: int, asks: bool = False) -> DataFrame:
    """(a, b, value) for rows (value, block, doc_id, n, file, at, heavy[, asks]) of lists and their blocks."""

    def run(batches):
        import pyarrow as pa

        read, key, rows, out = Sets(folder), None, [], []

        def flush():
            if len(rows) > 1:
                found = link_group([r[2] for r in rows], [read(r[4], r[5], r[3]) for r in rows], percent, [r[6] for r in rows], [r[7] for r in rows] if asks else None)
                out.extend((a, b, key[0]) for a, b in found)

        names = ["value", "block", "doc_id", "n", "file", "at", "heavy", *(["asks"] if asks else [])]
        for batch in batches:
            for r in zip(*(batch.column(c).to_pylist() for c in names), strict=True):
                if r[:2] != key:
                    flush()
                    key, rows = r[:2], []
                rows.append(r)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out, strict=True)], ["a", "b", "value"])
                out = []
        flush()
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out, strict=True)], ["a", "b", "value"])

    n = tasks(lists.sparkSession, 1)
    # a list's smallest set comes first
    return lists.repartition(n, "value", "block").sortWithinPartitions("value", "block", "n", "doc_id").mapInArrow(run, "a long, b long, value long")


def deep_keys(hot: DataFrame, folder: str, percent: int) -> DataFrame:
    """value, doc_id, heavy: the lists of mostly hot sets (doc_id, n, file, at), by prefix filtering over their DEEP smallest values."""
    spark = hot.sparkSession

    def run(batches):
        import pyarrow as pa

        read = Sets(folder)
        for batch in batches:
            rows = [read(f, at, min(n, DEEP)).view("<i8") for f, at, n in zip(*(batch.column(c).to_pylist() for c in ("file", "at", "n")), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n"), pa.array(rows, pa.list_(pa.int64()))], ["doc_id", "n", "deep"])

    deep = hot.select("doc_id", "n", "file", "at").mapInArrow(run, "doc_id long, n long, deep array<long>")
    posted = materialize(spark, deep.select("doc_id", "n", F.explode("deep").alias("value")), "deep")
    df = posted.groupBy("value").agg(F.count(F.lit(1)).alias("df"))
    order = F.row_number().over(Window.partitionBy("doc_id").orderBy("df", "value"))
    k, slack = F.least(F.col("n"), F.lit(DEEP)), F.when(F.col("n") > DEEP, SLACK).otherwise(0)
    first = k - F.ceil(k * percent / 100) + 1 + slack
    early = k - F.ceil(k * 2 * percent / (100 + percent)) + 1 + slack
    return posted.join(df, "value").withColumn("rank", order).filter((F.col("rank") <= first) & (F.col("df") > 1)).select("value", "doc_id", (F.col("rank") > early).alias("heavy"))


def links_of(classes: DataFrame, folder: str, percent: int) -> DataFrame:
    """Confirmed links (a, b) between class representatives (doc_id, n, keys, file, at), enough to join each component."""
    spark = classes.sparkSession
    posted = classes.select("doc_id", F.size("keys").alias("kept"), F.posexplode("keys").alias("pos", "value"))
    shared = posted.groupBy("value").agg(F.count(F.lit(1)).alias("df")).filter("df > 1").withColumn("hot", F.col("df") > HOT)
    own = Window.partitionBy("doc_id")
    ranked = (
        posted.join(shared, "value")
        .withColumn("hot_before", F.sum(F.col("hot").cast("int")).over(own.orderBy("pos")))
        .withColumn("most_hot", F.sum(F.col("hot").cast("int")).over(own) >= HOT_SHARE * F.col("kept"))
    )
    few = ~F.col("hot") & (F.col("pos") - F.col("hot_before") < KEYS)
    chosen = materialize(spark, ranked.filter(few | (F.col("hot") & F.col("most_hot"))).select("value", "doc_id", "hot"), "chosen")
    most_hot = classes.join(chosen.filter("hot").select("doc_id").distinct(), "doc_id", "left_semi")
    chosen = chosen.filter("NOT hot").select("value", "doc_id", F.lit(False).alias("heavy"))
    if most_hot.head(1):
        chosen = chosen.unionByName(deep_keys(most_hot, folder, percent)).groupBy("value", "doc_id").agg(F.min("heavy").alias("heavy"))
    members = materialize(spark, chosen.join(classes.select("doc_id", "n", "file", "at"), "doc_id"), "members")
    # lists with the same members are one
    alike = members.groupBy("value").agg(
        F.count(F.lit(1)).alias("m"), F.bit_xor(F.xxhash64("doc_id", "heavy")).alias("x"), F.min(F.struct("n", "doc_id")).alias("hub"), F.max("doc_id").alias("top")
    ).filter("m > 1")
    one = alike.groupBy("m", "x", "hub", "top").agg(F.min("value").alias("value")).select("value", F.col("hub.doc_id").alias("hub"), F.ceil(F.col("m") / BLOCK).alias("blocks"))
    rows = members.join(one, "value")
    block = F.when(F.col("doc_id") == F.col("hub"), F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).otherwise(F.array(F.pmod(F.xxhash64("doc_id"), F.col("blocks"))))
    rows = materialize(spark, rows.withColumn("block", F.explode(block)), "lists")
    links = materialize(spark, _link(rows, folder, percent), "first")
    many = rows.filter("blocks > 1")
    if not many.head(1):
        return links.select("a", "b")
    return links.unionByName(_link(_meetings(many, links), folder, percent, asks=True)).select("a", "b")


def _meetings(many: DataFrame, links: DataFrame) -> DataFrame:
    """The rows of long lists once for each meeting that they attend. Members whom the hub doesn't reach ask. A list's members are
    dealt to cells of about BLOCK: those that ask (light, heavy), then those that don't (light, heavy). Cell i meets cell j >= i if i asks,
    and one of them is light."""
    spark = many.sparkSession
    reach = materialize(spark, components(links.unionByName(many.select(F.col("doc_id").alias("a"), F.col("doc_id").alias("b"), "value"))), "reach")
    rest = (
        many.filter("doc_id <> hub").join(reach.select(F.col("node").alias("doc_id"), F.col("component").alias("own")), "doc_id", "left")
        .join(reach.select(F.col("node").alias("hub"), F.col("component").alias("hub_own")), "hub", "left")
        .withColumn("asks", ~F.coalesce(F.col("own"), F.col("doc_id")).eqNullSafe(F.coalesce(F.col("hub_own"), F.col("hub"))))
        .withColumn("kind", F.when(F.col("asks"), 0).otherwise(2) + F.col("heavy").cast("int"))
    )
    cells = [F.ceil(F.count_if(F.col("kind") == i) / BLOCK).alias(f"c{i}") for i in range(4)]
    rest = materialize(spark, rest.join(rest.groupBy("value").agg(*cells).filter("c0 + c1 > 0"), "value"), "rest")
    c = [F.col(f"c{i}") for i in range(4)]
    start = [F.lit(0).cast("long"), c[0], c[0] + c[1], c[0] + c[1] + c[2]]
    kind, every = F.col("kind"), c[0] + c[1] + c[2] + c[3]
    pick = lambda xs: F.when(kind == 0, xs[0]).when(kind == 1, xs[1]).when(kind == 2, xs[2]).otherwise(xs[3])
    rest = rest.withColumn("cell", pick(start) + F.pmod(F.xxhash64("doc_id", F.lit(1)), pick(c)))
    upto = lambda a, b: F.when(a < b, F.sequence(a, b - 1)).otherwise(F.array().cast("array<bigint>"))  # noqa: E731  from a to before b
    met_by = F.transform(upto(start[0], pick([F.col("cell"), c[0], c[0] + c[1], c[0]])), lambda i: i * every + F.col("cell"))
    meets = F.transform(pick([upto(F.col("cell"), every), upto(start[2], start[3]), upto(every, every), upto(every, every)]), lambda j: F.col("cell") * every + j)
    rows = rest.withColumn("block", F.explode(F.concat(met_by, meets)))
    # of two cells that ask the first does; in a meeting of a cell with itself all do
    return rows.select("value", "block", "doc_id", "n", "file", "at", "heavy", (F.floor(F.col("block") / every) == F.col("cell")).alias("asks"))


def classes_of(docs: DataFrame, width: int = 4, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, rep (its class's smallest doc_id), component_id for each row of docs."""
    spark = docs.sparkSession
    folder = fresh(spark, "sets")
    filesystem_ready(spark, folder)
    made = materialize(spark, sketch(docs, width, folder), "sketches")
    some = made.filter("n > 0")
    first = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "file", "at")  # null would sort before all doc_ids
    classes = some.groupBy("h1", "h2", "n").agg(F.min(first).alias("r"), F.min_by("keys", first).alias("keys"))
    classes = materialize(spark, classes.select("h1", "h2", "n", F.col("r.doc_id").alias("doc_id"), F.col("r.file").alias("file"), F.col("r.at").alias("at"), "keys"), "classes")
    links = materialize(spark, links_of(classes.filter("doc_id IS NOT NULL"), folder, percent), "confirmed")
    # rows that repeat a doc_id with other words tie their classes together
    found = components(links)
    release(spark)
    named = classes.select("h1", "h2", "n", F.col("doc_id").alias("rep")).join(found.select(F.col("node").alias("rep"), "component"), "rep", "left")
    named = named.select("h1", "h2", "n", "rep", F.coalesce("component", "rep").alias("component_id"))
    out = materialize(
        spark,
        made.join(named, ["h1", "h2", "n"], "left").select("doc_id", "text_key", F.col("n").alias("n_shingles"), F.coalesce("rep", "doc_id").alias("rep"), F.coalesce("component_id", "doc_id").alias("component_id")),
        "components",
    )
    drop(spark, folder)
    return out


def filesystem_ready(spark, folder: str) -> None:
    """Makes the folder, through Spark's own file system."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).mkdirs(where)


def components_of(docs: DataFrame, width: int = 4, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for each row of docs."""
    found = classes_of(docs, width, percent)
    return found.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def kept_rows(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """The rows of docs with the smallest doc_id of each component, with all their columns."""
    found = classes_of(docs, width, percent)
    gone = found.filter(~F.col("doc_id").eqNullSafe(F.col("component_id")))
    named = gone.filter("doc_id IS NOT NULL").select(F.col("doc_id").alias("gone__id")).distinct()
    id_ = docs.doc_id.cast("long")
    kept = docs.filter(id_.isNotNull()).join(named, id_ == named.gone__id, "left_anti")
    # rows without a doc_id go with their class, and among themselves one of each text stays
    key = unused(docs, "key")
    texts = gone.filter("doc_id IS NULL").select(F.col("text_key").alias(key)).distinct()
    nameless = docs.filter(id_.isNull()).withColumn(key, text_key()).join(texts, key, "left_anti").dropDuplicates([key])
    return kept.unionByName(nameless.select(*docs.columns))
