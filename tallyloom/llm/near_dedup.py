"""MinHash near-dedup with tensored banding.

A document's set is its distinct ``shingle``-word shingles (all words as one if there are fewer).  Documents whose sets have
a Jaccard similarity of at least ``percent`` / 100 are linked; groups are what links connect.

* Texts with the same set (a 128-bit hash of it) fall into one class first, so copies cost one row each and no pair.  Classes are
  numbered in the table that they are written to; the numbers decide nothing but the order of work.
* Each class gets two collections of ``bands`` bands of ``rows`` minimum hashes.  A table key is a pair of a band of the
  first collection and one of the second: ``bands**2`` tables of ``2 * rows`` hashes from ``2 * bands * rows`` hashes.
  At similarity s a pair meets in some table with probability ``(1 - (1 - s**rows)**bands)**2``: 0.99998 at 0.8 with
  the defaults.  Bands that no second class holds are dropped before keys are formed.
* Candidates are verified on full sets.  A class is first compared with one leader of its tables.  Where classes that share
  a band of the first collection are still in several components, each is compared with the one of them that has most company,
  its centre.  What is left are pairs across components that share a table key, which is a band of both collections.
  Sizes, intersections with the common centre and bitmaps of the shingles beyond it and of those of its shingles that they lack bound
  their similarity from above; pairs whose bound falls short are passed over, all others are compared.
  Pairs within one component need no comparison, as the result is the components.
* Components come from alternating star contractions; nothing is gathered on the driver.

Edge cases: texts without words (null, empty) have an empty set, are linked with nothing and stay.  Rows with one id are one
document: in ``group`` it has the links of all its texts and one component.  ``dedup`` goes by texts and loses none: a row goes only if
a row with a smaller id, or another row of its id, stays for the group of its text.  Rows without an id are never
linked on their own (they show the component of the same text) and stay.  An empty table gives an empty result; extra
columns pass through in ``dedup``, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textscan as ts
from .frames import discard, documents, free_name, map_arrow, materialise, quoted

ROWS = 3
BANDS = 16
BROADCAST_IDS = 1 << 18
BITMAP = 8
#: What a comparison with a centre tells about a class.
BOUNDS = ("common", "hidden", "bits", "hidden_lacks", "lacks")


def _sets(chunk: ts.Chunk, shingle: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each document."""
    spans = ts.words(chunk)
    hashes = ts.span_hashes(chunk.data, spans.starts, spans.ends)
    grams = ts.window_hashes(hashes, shingle)
    out = []
    for a, b in zip(spans.bounds[:-1].tolist(), spans.bounds[1:].tolist(), strict=True):
        if b - a >= shingle:
            out.append(np.unique(grams[a : b - shingle + 1]))
        else:
            out.append(ts.window_hashes(hashes[a:b], b - a) if b > a else np.zeros(0, np.uint64))
    return out


def _signature(sets: list[np.ndarray], rows: int, bands: int) -> np.ndarray:
    """Band hashes of each set: ``2 * bands`` columns; zeros for an empty set."""
    sizes = np.array([len(s) for s in sets])
    out = np.zeros((len(sets), 2 * bands), np.uint64)
    full = np.flatnonzero(sizes)
    if not len(full):
        return out
    values = np.concatenate([sets[i] for i in full])
    at = np.concatenate([[0], np.cumsum(sizes[full])[:-1]])
    draw = np.random.default_rng(2024).integers(1, 1 << 63, (2 * bands * rows, 2)).astype(np.uint64)
    for band in range(2 * bands):
        h = np.full(len(full), band + 1, np.uint64)
        for xor, times in draw[band * rows : (band + 1) * rows]:
            h = ts.mix(h ^ np.minimum.reduceat((values ^ xor) * (times | np.uint64(1)), at))
        out[full, band] = h
    return out


def signatures(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", shingle: int = 5, rows: int = ROWS, bands: int = BANDS) -> DataFrame:
    """(id, size, set_a, set_b, bands): set size, a 128-bit hash of the set, and its band hashes."""
    schema = T.StructType([T.StructField("id", docs.schema[doc_id].dataType), T.StructField("size", T.LongType()), T.StructField("set_a", T.LongType()), T.StructField("set_b", T.LongType()), T.StructField("bands", T.ArrayType(T.LongType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in ts.chunks(batch.column(1)):
                sets = _sets(chunk, shingle)
                sign = _signature(sets, rows, bands).astype(np.int64)
                a, b = _names(sets)
                flat = pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1, dtype=np.int32) * 2 * bands), pa.array(sign.ravel()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(chunk.first, len(chunk)), pa.array([len(s) for s in sets], pa.int64()), pa.array(a), pa.array(b), flat], names=schema.names)

    return map_arrow(docs.select(doc_id, text), run, schema)


def shared_bands(classes: DataFrame, bands: int = BANDS) -> DataFrame:
    """(node, size, first, second): of each collection the bands that a second class has, in order."""
    each = classes.select("node", "size", F.posexplode("bands").alias("place", "band"))
    shared = each.groupBy("band").agg(F.min("node").alias("least"), F.max("node").alias("most")).where("least < most").select("band")
    met = each.join(shared, "band")
    own = met.groupBy("node", "size").agg(
        F.array_sort(F.collect_list(F.when(F.col("place") < bands, F.col("band")))).alias("first"),
        F.array_sort(F.collect_list(F.when(F.col("place") >= bands, F.col("band")))).alias("second"),
    )
    return own.where((F.size("first") > 0) & (F.size("second") > 0))


def table_keys(shared: DataFrame) -> DataFrame:
    """(key, node, size) of the buckets that can hold two classes: each pair of a band of both collections."""
    pairs = shared.select("node", "size", F.explode("first").alias("a"), "second").select("node", "size", "a", F.explode("second").alias("b"))
    return pairs.select(F.xxhash64("a", "b").alias("key"), "node", "size")


def _stars(edges: DataFrame) -> DataFrame:
    """One large-star and one small-star step over (u, v), u > v."""
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v").distinct()
    least = large.groupBy("u").agg(F.min("v").alias("m"))
    down = large.join(least, "u")
    return down.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v"))).where("u > v").distinct()


def _mark(df: DataFrame) -> tuple:
    return tuple(df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(links: DataFrame) -> DataFrame:
    """(node, component) of every node in (u, v) links but the smallest of each component, which is its name."""
    edges = materialise(links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u > v").distinct(), "edges")
    mark = _mark(edges)
    while mark[0]:
        nearer = materialise(_stars(edges), "edges")
        discard(edges)
        edges, before, mark = nearer, mark, _mark(nearer)
        if mark == before:
            break
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component"))


def _grams(docs: DataFrame, wanted: DataFrame, doc_id: str, text: str, shingle: int) -> DataFrame:
    """(node, grams): the full sets of some classes, from the texts of their least ids."""
    few = wanted.count() <= BROADCAST_IDS
    ids = wanted.select(F.col("id").alias("wanted_id"))
    rows = docs.select(F.col(quoted(doc_id)).alias("id"), F.col(quoted(text)).alias("text")).where(F.col("text").isNotNull())
    rows = rows.join(F.broadcast(ids) if few else ids, F.col("id") == F.col("wanted_id"), "left_semi")
    schema = T.StructType([rows.schema["id"], *(T.StructField(c, T.LongType()) for c in ("set_a", "set_b")), T.StructField("grams", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in ts.chunks(batch.column(1)):
                sets = _sets(chunk, shingle)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(chunk.first, len(chunk)), *map(pa.array, _names(sets)), pa.array([s.tobytes() for s in sets], pa.binary())], names=schema.names)

    # repeated rows of an id have one set; other texts of the id are other classes, which have a row of their own here or aren't asked for
    each = map_arrow(rows, run, schema).groupBy("id", "set_a", "set_b").agg(F.any_value("grams").alias("grams"))
    return each.join(wanted, ["id", "set_a", "set_b"]).select("node", "grams")


def _compared(pairs: DataFrame, grams: DataFrame) -> DataFrame:
    """(u, v) pairs compared on full sets: their common shingles, and as bitmaps what u has beyond v and what of v it lacks.

    ``bits`` has a bit for the hash of each shingle of u that v lacks, ``hidden`` says how many of those share a bit; ``lacks`` and
    ``hidden_lacks`` say the same of the shingles of v that u lacks.
    """
    both = pairs.join(grams.select(F.col("node").alias("u"), F.col("grams").alias("gu")), "u").join(grams.select(F.col("node").alias("v"), F.col("grams").alias("gv")), "v").select("u", "v", "gu", "gv")
    long = T.LongType()
    schema = T.StructType([*(T.StructField(c, long) for c in ("u", "v", "size_u", "size_v", "common", "hidden", "hidden_lacks")), T.StructField("bits", T.ArrayType(long)), T.StructField("lacks", T.ArrayType(long))])

    def mark(bits: np.ndarray, some: np.ndarray) -> int:
        """Set the bits of some shingles; how many of them share one."""
        bits[(some % np.uint64(64 * BITMAP)).astype(np.int64)] = True
        return len(some) - int(bits.sum())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            numbers = np.zeros((len(batch), 5), np.int64)
            bits, lacks = np.zeros((2, len(batch), 64 * BITMAP), bool)
            for i, (a, b) in enumerate(zip(batch.column(2), batch.column(3), strict=True)):
                a, b = (np.frombuffer(x.as_buffer(), np.uint64) for x in (a, b))
                mine = np.isin(a, b, assume_unique=True)
                theirs = np.isin(b, a, assume_unique=True)
                numbers[i] = len(a), len(b), mine.sum(), mark(bits[i], a[~mine]), mark(lacks[i], b[~theirs])
            offsets = pa.array(np.arange(len(batch) + 1, dtype=np.int32) * BITMAP)
            flat = [pa.ListArray.from_arrays(offsets, pa.array(np.packbits(x, axis=1).view(np.int64).ravel())) for x in (bits, lacks)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], *(pa.array(c) for c in numbers.T.copy()), *flat], names=schema.names)

    return map_arrow(both, run, schema)


def _linked(compared: DataFrame, percent: int) -> DataFrame:
    return compared.where((F.col("common") > 0) & (F.col("common") * 100 >= (F.col("size_u") + F.col("size_v") - F.col("common")) * percent)).select("u", "v")


def _alike(percent: int) -> Column:
    """Sizes that allow the similarity."""
    return F.least("size", "other") * 100 >= F.greatest("size", "other") * percent


def _possible(percent: int) -> Column:
    """False only where two sets can't be similar enough, as their intersections with one centre show.

    Outside the centre they can share no more shingles than bits of both bitmaps and shingles hidden behind a bit.  Inside it they
    share what neither lacks: their intersections with it less its size, and what both lack, which is bounded likewise.
    """

    def shared(hidden: str, bits: str) -> Column:
        out = F.least(hidden, f"other_{hidden}")
        for k in range(BITMAP):
            out = out + F.bit_count(F.get(bits, F.lit(k)).bitwiseAND(F.get(f"other_{bits}", F.lit(k))))
        return out

    beyond = F.least(F.col("size") - F.col("common"), F.col("other") - F.col("other_common"), shared("hidden", "bits"))
    inside = F.least("common", "other_common", F.col("common") + F.col("other_common") - F.col("size_centre") + shared("hidden_lacks", "lacks"))
    most = inside + beyond
    return (F.col("centre") != F.col("other_centre")) | (most * (100 + percent) >= (F.col("size") + F.col("other")) * percent)


def _texts_grouped(docs: DataFrame, doc_id: str, text: str, shingle: int, percent: int, rows: int, bands: int, by_id: bool) -> tuple[DataFrame, DataFrame]:
    """(id, size, set_a, set_b, node) of each row, and (node, component) of the classes that are linked: both written.

    ``by_id``: texts of one id are linked, and rows without words belong to the other texts of their id.
    """
    made: list[DataFrame] = []

    def keep(df: DataFrame, name: str) -> DataFrame:
        made.append(materialise(df, name))
        return made[-1]

    signed = keep(signatures(docs, doc_id=doc_id, text=text, shingle=shingle, rows=rows, bands=bands), "signatures")
    named = signed.where(F.col("id").isNotNull() & (F.col("size") > 0))
    each = named.groupBy("set_a", "set_b", "size").agg(F.any_value("bands").alias("bands"), F.min("id").alias("id"))
    classes = keep(each.withColumn("node", F.monotonically_increasing_id()), "classes")
    shared = keep(shared_bands(classes.select("node", "size", "bands"), bands), "shared-bands")
    keys = keep(table_keys(shared), "table-keys")
    members = materialise(signed.drop("bands").join(classes.select("set_a", "set_b", "size", "node"), ["set_a", "set_b", "size"], "left").select("id", "size", "set_a", "set_b", "node"), "members")

    def settle(comps: DataFrame, links: DataFrame) -> DataFrame:
        """Components after some more links."""
        for side in ("u", "v"):
            of = comps.select(F.col("node").alias(side), F.col("component").alias("c"))
            links = links.join(of, side, "left").withColumn(side, F.coalesce("c", side)).drop("c")
        merged = keep(components(links), "components")
        if merged.isEmpty():
            return comps
        moved = comps.join(merged.select(F.col("node").alias("component"), F.col("component").alias("new")), "component", "left").select("node", F.coalesce("new", "component").alias("component"))
        return keep(moved.unionByName(merged.join(comps.select("node"), "node", "left_anti")), "components")

    grams = keep(_grams(docs, keep(classes.join(shared.select("node"), "node", "left_semi").select("id", "set_a", "set_b", "node"), "wanted"), doc_id, text, shingle), "grams")

    # a leader for each class: the least of its tables
    leaders = keys.groupBy("key").agg(F.min(F.struct("node", "size")).alias("lead"))
    led = keys.join(leaders, "key").select("node", "size", F.col("lead.node").alias("v"), F.col("lead.size").alias("other")).where(F.col("node") != F.col("v"))
    first = led.where(_alike(percent)).groupBy("node").agg(F.min("v").alias("v")).select(F.col("node").alias("u"), "v")
    comps = keep(components(_linked(_compared(first, grams), percent)), "components")

    buckets = shared.select(F.explode("first").alias("band"), "node", "size")

    def unsettled(comps: DataFrame) -> DataFrame:
        """Rows of the bands that still hold several components."""
        known = buckets.join(comps, "node", "left").withColumn("component", F.coalesce("component", "node"))
        sizes = known.groupBy("band", "component").agg(F.count(F.lit(1)).alias("n"))
        spans = sizes.groupBy("band").agg(F.count(F.lit(1)).alias("many"), F.max(F.struct("n", "component")).alias("most")).where("many > 1").select("band", F.col("most.component").alias("main"))
        return known.join(spans, "band").select("band", "node", "size", "component", "main")

    # a centre for each class: of those that it shares a band with the one with most company
    rest = keep(unsettled(comps), "unsettled")
    company = rest.join(rest.groupBy("band").agg(F.count(F.lit(1)).alias("n")), "band").groupBy("node").agg(F.sum("n").alias("company"))
    best = rest.join(company, "node").groupBy("band").agg(F.max(F.struct("company", "node")).alias("best"))
    centres = rest.select("band", "node").join(best, "band").groupBy("node").agg(F.max("best").alias("best")).select(F.col("node").alias("u"), F.col("best.node").alias("v"))
    near = keep(_compared(centres, grams), "centres")
    comps = settle(comps, _linked(near.where("u <> v"), percent))

    # what is left: classes outside their band's main component with all that their shingles beyond the centre allow
    place = near.select(F.col("u").alias("node"), F.col("v").alias("centre"), F.col("size_v").alias("size_centre"), *BOUNDS)
    rest = keep(unsettled(comps).join(place, "node").join(shared.select("node", "first", "second"), "node"), "unsettled")
    mine = rest.where(F.col("component") != F.col("main"))
    other = rest.select("band", *(F.col(c).alias(f"other_{c}" if c != "size" else "other") for c in ("node", "size", "component", "centre", *BOUNDS, "first", "second")))
    # a pair meets in many bands; the least that it shares stands for all
    once = F.col("band") == F.array_min(F.array_intersect("first", "other_first"))
    across = mine.join(other, "band").where((F.col("component") != F.col("other_component")) & _alike(percent) & F.arrays_overlap("second", "other_second") & _possible(percent) & once)
    pairs = across.select(F.greatest("node", "other_node").alias("u"), F.least("node", "other_node").alias("v")).distinct()
    comps = settle(comps, _linked(_compared(pairs, grams), percent))

    if by_id:
        several = keep(
            members.where(F.col("id").isNotNull()).groupBy("id").agg(F.min("node").alias("least"), F.max("node").alias("most"), F.count_if(F.col("node").isNull()).alias("blank"))
            .where("least < most or (least is not null and blank > 0)").select("id", "least"), "several-texts",
        )
        if not several.isEmpty():
            comps = settle(comps, members.where("node is not null").join(several, "id").where("node <> least").select(F.col("node").alias("u"), F.col("least").alias("v")).distinct())
            made.append(members)
            members = materialise(members.join(several, "id", "left").withColumn("node", F.coalesce("node", "least")).drop("least"), "members")
    comps = materialise(classes.select("node", "id", "set_a", "set_b").join(comps, "node", "left").withColumn("component", F.coalesce("component", "node")), "components")
    for df in made:
        discard(df)
    return members, comps


def group(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", shingle: int = 5, percent: int = 80, rows: int = ROWS, bands: int = BANDS) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept): one row for each row of ``docs``."""
    members, comps = _texts_grouped(docs, doc_id, text, shingle, percent, rows, bands, True)
    least = comps.groupBy("component").agg(F.min("id").alias("least"))
    named = members.join(comps.join(least, "component").select("node", "least"), "node", "left")
    component = F.coalesce("least", "id")
    return named.select(F.col("id").alias(doc_id), F.col("size").alias("n_shingles"), component.alias("component_id"), F.coalesce(component == F.col("id"), F.lit(True)).alias("kept"))


def _names(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """A 128-bit hash of each set, in two parts."""
    a = np.array([s.sum(dtype=np.uint64) for s in sets], np.uint64).astype(np.int64)
    b = np.array([ts.mix(s).sum(dtype=np.uint64) for s in sets], np.uint64).astype(np.int64)
    return a, b


def _with_names(docs: DataFrame, text: str, shingle: int, names: tuple[str, str]) -> DataFrame:
    """``docs`` with the hashes of their sets."""
    place = docs.columns.index(text)
    schema = T.StructType([*docs.schema.fields, *(T.StructField(c, T.LongType()) for c in names)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            both = [_names(_sets(chunk, shingle)) for chunk in ts.chunks(batch.column(place))] or [(np.zeros(0, np.int64),) * 2]
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(np.concatenate(x)) for x in zip(*both, strict=True))], names=schema.names)

    return map_arrow(docs, run, schema)


def dedup(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", shingle: int = 5, percent: int = 80, rows: int = ROWS, bands: int = BANDS) -> DataFrame:
    """``docs`` with one row of each group of texts: one with the smallest id."""
    members, comps = _texts_grouped(docs, doc_id, text, shingle, percent, rows, bands, False)
    chosen = comps.groupBy("component").agg(F.min(F.struct("id", "set_a", "set_b")).alias("chosen"))
    stays = comps.join(chosen, "component").where(F.struct("id", "set_a", "set_b") == F.col("chosen")).select("node", F.col("id").alias("stays"))
    decided = members.where(F.col("id").isNotNull()).join(stays, "node", "left").select("id", "set_a", "set_b", (F.col("node").isNull() | F.coalesce(F.col("id") == F.col("stays"), F.lit(False))).alias("kept"))
    # ids that don't just stay with their only row
    odd = materialise(decided.groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.count_if("kept").alias("n_kept")).where("n > 1 or n_kept = 0").select("id", "n_kept"), "odd-ids")
    key, (a, b) = F.col(quoted(doc_id)), (free_name(docs, c) for c in ("set_a", "set_b"))
    of = free_name(docs, "odd_id")
    kept = docs.join(odd.select(F.col("id").alias(of)), key == F.col(of), "left_anti")
    repeated = odd.where("n_kept > 0")
    if not repeated.isEmpty():
        sets = materialise(decided.where("kept").join(repeated.select("id"), "id", "left_semi").select("id", "set_a", "set_b").distinct(), "kept-sets")
        some = _with_names(docs.join(repeated.select(F.col("id").alias(of)), key == F.col(of), "left_semi"), text, shingle, (a, b))
        own = sets.select(F.col("id").alias(of), F.col("set_a").alias(f"{of}_a"), F.col("set_b").alias(f"{of}_b"))
        some = some.join(own, (key == F.col(of)) & (F.col(a) == F.col(f"{of}_a")) & (F.col(b) == F.col(f"{of}_b")), "left_semi")
        kept = kept.unionByName(some.dropDuplicates([doc_id, a, b]).drop(a, b))
    discard(members)
    discard(comps)
    return kept


def op2(spark, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir, "doc_id", "text")
    return group(docs, shingle=2, percent=80).select("doc_id", "n_shingles", "component_id", "kept")


#: For tables in which ids don't repeat.
OP2_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents
), s AS (
  SELECT doc_id, list_distinct(CASE WHEN len(ws) >= 2 THEN list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1]) ELSE ws END) AS grams FROM d
), n AS (
  SELECT doc_id, len(grams)::BIGINT AS n_shingles FROM s
), g AS (
  SELECT doc_id, unnest(grams) AS gram FROM s
), c AS (
  SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS common FROM g a JOIN g b ON a.gram = b.gram AND a.doc_id < b.doc_id GROUP BY ALL
), l AS (
  SELECT u, v FROM c JOIN n a ON a.doc_id = u JOIN n b ON b.doc_id = v WHERE 100 * common >= 80 * (a.n_shingles + b.n_shingles - common)
), e AS (
  SELECT u, v FROM l UNION ALL SELECT v, u FROM l
), r(id, root) AS (
  SELECT doc_id, doc_id FROM n UNION SELECT e.v, r.root FROM r JOIN e ON e.u = r.id WHERE r.root < e.v
), m AS (
  SELECT id, min(root) AS component_id FROM r GROUP BY id
)
SELECT doc_id, n_shingles, component_id, component_id = doc_id AS kept FROM n JOIN m ON id = doc_id
"""
