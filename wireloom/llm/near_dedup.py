"""Near-duplicate documents: SuperMinHash signatures, banding, exact verification.

A document is the set of its 5-word shingles. Equal sets are one class before
anything else happens. SuperMinHash ranks an element's components by one random
permutation per element, which makes components correlate negatively and
estimates vary less than with independent hashes; an element stops as soon as
it can't lower any component. Classes that share a band of the signature are
candidates. Candidates reach one another through families: components of the
graph that joins each class of a bucket to the bucket's least. All links inside
a family are decided on the full sets, blocks of a bounded number of classes at
a time, and only a spanning forest of each block's links leaves its task. The
classes of a large family get a longer signature first, which parts those that
are merely somewhat alike.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _buckets, _filter
from . import _bytes as B
from ._blocks import family_components
from ._graph import components
from ._shared import few_files, fresh, hinted, join_hot, keep, released, struct_of, without

SHINGLE = 5
#: Chance that a pair right at the threshold shares no band; more alike, far less.
MISS = 3e-5
#: Components of a signature at most, so that a permutation takes a byte for each.
COMPONENTS = 256
#: Items whose permutations a worker holds at once, at a byte per component.
SIGN_AT_ONCE = 50_000
#: Components of the longer signature of sets in large families at most, and sets that get one at once.
FINER, FINER_AT_ONCE = 2048, 256
SIGNED = struct_of(n="long", h1="long", h2="long", keys="[long]")
SETS = struct_of(h1="long", h2="long", n="long", items="binary")


def banding(percent: int, most: int = COMPONENTS) -> tuple[int, int]:
    """Bands and rows of a band: the longest bands (fewest false candidates) that keep to MISS.

    85 % takes 27 bands of 7, and 114 of 15 in a longer signature; 80 % takes 35 of 6, and 146 of 12.
    """
    for rows in range(16, 0, -1):
        bands = math.ceil(math.log(MISS) / math.log1p(-((min(percent, 99) / 100) ** rows)))
        if bands * rows <= most:
            return bands, rows
    raise ValueError("the threshold is too low for a signature of this size")


def shingles(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Of runs of rows: first and end row, sorted distinct shingle hashes, bounds of each row's."""
    for lo, hi, data, offsets in B.chunks(column):
        lower = B.LOWER[data]
        starts, ends = B.runs(B.NOT_SPACE[lower], offsets)
        _, first = B.rows_of(starts, offsets)
        words = B.span_hash(B.prefix_hash(lower), starts, ends)
        grams = B.grams(words, SHINGLE)
        found, bounds = [], [0]
        for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
            if b - a >= SHINGLE:
                s = np.sort(grams[a : b - SHINGLE + 1])
                s = s[np.concatenate([[True], s[1:] != s[:-1]])]
            else:  # fewer words: the whole sequence is the only element
                s = B.grams(words[a:b], b - a) if b > a else words[:0]
            found.append(s)
            bounds.append(bounds[-1] + len(s))
        yield lo, hi, np.concatenate(found), np.array(bounds)


def superminhash(items: np.ndarray, row: np.ndarray, n_rows: int, size: int) -> np.ndarray:
    """Signatures (n_rows, size) of sets given as distinct items and their rows.

    Component p of a set is the least, over its items, of the rank that the
    item's permutation gives to p plus a random fraction, as rank * 2**32 + fraction.
    """
    top = B.U(2**64 - 1)
    signature = np.full((n_rows, size), top, B.U)
    for lo in range(0, len(items), SIGN_AT_ONCE):
        _lower(signature, items[lo : lo + SIGN_AT_ONCE], row[lo : lo + SIGN_AT_ONCE])
    return signature


def _lower(signature: np.ndarray, items: np.ndarray, row: np.ndarray) -> None:
    """Lets items lower their sets' components."""
    n_rows, size = signature.shape
    flat = signature.reshape(-1)
    order = np.broadcast_to(np.arange(size, dtype=np.uint8), (len(items), size)).copy()
    for j in range(size):
        if not len(items):
            break
        draw = B.mix(items + B.U((j + 1) * B.BASE & (2**64 - 1)))
        k = j + ((draw & B.U(0xFFFFFFFF)) * B.U(size - j) >> B.U(32)).astype(np.int64)
        at = np.arange(len(items))
        place = order[at, k]
        order[at, k] = order[:, j]
        np.minimum.at(flat, row * size + place, (draw >> B.U(32)) | B.U(j << 32))
        # Later ranks are above j: an item goes on while some component of its set is too.
        rows = np.unique(row)
        open_ = np.zeros(n_rows, bool)
        open_[rows] = (signature[rows].max(axis=1) >> B.U(32)) > j
        more = open_[row]
        if not more.all():
            items, row, order = items[more], row[more], order[more]


def _band_hashes(signature: np.ndarray, bands: int, rows: int) -> np.ndarray:
    cells = signature.reshape(len(signature), bands, rows)
    out = np.broadcast_to(np.arange(bands, dtype=B.U), cells.shape[:2])
    for i in range(rows):
        out = B.combine(out, cells[:, :, i])
    return out


def _set_hashes(items: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits of each set, which don't depend on order."""
    out = []
    for salt in (0x2545F4914F6CDD1D, 0x9FB21C651E98DF25):
        total = np.zeros(len(items) + 1, B.U)
        np.cumsum(B.mix(items ^ B.U(salt)), out=total[1:])
        out.append(B.combine(total[bounds[1:]] - total[bounds[:-1]], np.diff(bounds)))
    return out[0], out[1]


def _signatures(items: np.ndarray, bounds: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """Band hashes of sets, a row a set; over COMPONENTS, several signatures of salted items stand side by side."""
    row, n = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds)), len(bounds) - 1
    parts = []
    for lo in range(0, bands * rows, COMPONENTS):
        salted = items if lo == 0 else B.mix(items ^ B.U(lo * B.BASE & (2**64 - 1)))
        parts.append(superminhash(salted, row, n, min(COMPONENTS, bands * rows - lo)))
    return _band_hashes(np.concatenate(parts, axis=1), bands, rows)


def prefixes(items: np.ndarray, bounds: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """The least items of each set (sorted), so many that sets at the threshold share one: places of them, and their bounds.

    Two sets at percent have an intersection of percent of the larger one at
    least, so the least common item lies among the first n - need + 1 of both.
    """
    n = np.diff(bounds)
    size = np.where(n > 0, n - -(-n * percent // 100) + 1, 0)
    ends = np.concatenate([[0], np.cumsum(size)])
    return np.arange(ends[-1]) + np.repeat(bounds[:-1] - ends[:-1], size), ends


def _sign(percent: int, exact: bool):
    count, rows = banding(percent)

    def sign(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in texts:
            parts = []
            for lo, hi, items, bounds in shingles(column):
                h1, h2 = _set_hashes(items, bounds)
                if exact:
                    places, ends = prefixes(items, bounds, percent)
                    keys = items[places]
                else:
                    keys, ends = _signatures(items, bounds, count, rows).ravel(), np.arange(hi - lo + 1) * count
                lists = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(keys.view(np.int64)))
                parts.append(pa.StructArray.from_arrays([pa.array(np.diff(bounds)), pa.array(h1.view(np.int64)), pa.array(h2.view(np.int64)), lists], names=SIGNED.names))
            yield pa.concat_arrays(parts) if parts else pa.array([], pa.struct([("n", pa.int64()), ("h1", pa.int64()), ("h2", pa.int64()), ("keys", pa.list_(pa.int64()))]))

    sign.__annotations__ = {"texts": Iterator[pa.Array], "return": Iterator[pa.Array]}
    sign = released(sign)
    return F.arrow_udf(sign, SIGNED).asNondeterministic()


def _listed(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Keys and nodes of rows (node, keys)."""
    node, lists = batch.column("node").to_numpy().view(B.U), batch.column("keys")
    yield lists.flatten().to_numpy().view(B.U), np.repeat(node, lists.value_lengths().to_numpy())


def _finer(percent: int):
    """Edges between sets that share a band of a longer signature, for families that the first one left large."""
    count, rows = banding(percent, FINER)

    def keyed(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        node = batch.column("node").to_numpy().view(B.U)
        sets = [np.frombuffer(x.as_py(), B.U) for x in batch.column("items")]
        for lo in range(0, len(sets), FINER_AT_ONCE):
            part = sets[lo : lo + FINER_AT_ONCE]
            bounds = np.concatenate([[0], np.cumsum([len(x) for x in part])])
            yield _signatures(np.concatenate(part), bounds, count, rows).ravel(), np.repeat(node[lo : lo + FINER_AT_ONCE], count)

    return lambda large: _buckets.edges(large.select("node", "items"), keyed, large.count() * count)


def _full_sets(wanted: bytes):
    """Texts to the sets whose h1 is wanted, each once for a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, seen = np.frombuffer(wanted, np.uint8), set()
        for batch in batches:
            for _, _, items, bounds in shingles(batch.column(0)):
                h1, h2 = _set_hashes(items, bounds)
                n = np.diff(bounds)
                full = [r for r in np.flatnonzero((n > 0) & _filter.passes(bits, h1)).tolist() if (key := (int(h1[r]), int(h2[r]))) not in seen and not seen.add(key)]
                sets = pa.array([items[bounds[r] : bounds[r + 1]].tobytes() for r in full], pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(h1[full].view(np.int64)), pa.array(h2[full].view(np.int64)), pa.array(n[full]), sets], names=SETS.names)

    return run


def linked_pairs(sets: list[np.ndarray], percent: int) -> tuple[np.ndarray, np.ndarray]:
    """All pairs with 100 * intersection >= percent * union, from exact counts."""
    n = len(sets)
    size = np.array([len(s) for s in sets])
    if n == 2:
        both = np.array([[0, len(np.intersect1d(sets[0], sets[1], assume_unique=True))], [0, 0]])
    else:
        items, owner = np.concatenate(sets), np.repeat(np.arange(n), size)
        order = np.argsort(items)
        items, owner = items[order], owner[order]
        new = np.concatenate([[True], items[1:] != items[:-1]])
        column = np.cumsum(new) - 1
        common = np.bincount(column)[column] > 1
        owner, column = owner[common], np.unique(column[common], return_inverse=True)[1]
        both = np.zeros((n, n))
        step = max(1, 4_000_000 // n)
        for lo in range(0, int(column.max(initial=-1)) + 1, step):
            here = (column >= lo) & (column < lo + step)
            m = np.zeros((n, step), np.float32)  # counts stay far below 2**24
            m[owner[here], column[here] - lo] = 1
            both += m @ m.T
    union = size[:, None] + size[None, :] - both
    return np.nonzero(np.triu(100 * both >= percent * union, 1))


def _components(signed: DataFrame, texts: DataFrame, percent: int, exact: bool) -> DataFrame:
    """h1, h2, component_id of the shingle sets that several rows have or that link with others.

    signed is a table of id, n, h1, h2, keys; texts has one column, those that signed was made of.
    Sets are told apart by 128 bits; a node is a hash of these that no two sets share.
    """
    full = signed.filter("n > 0")
    classes = keep(full.groupBy("h1", "h2").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("rows")), "classes")
    for seed in itertools.count():
        node = F.xxhash64("h1", "h2", F.lit(seed)).alias("node")
        if classes.groupBy(node).count().filter("count > 1").isEmpty():
            break
    n_keys = full.agg(F.sum(F.size("keys"))).first()[0] or 0
    joined = components(_buckets.edges(full.select(node, "keys"), _listed, n_keys))
    families = joined.union(joined.select(F.col("root").alias("node"), "root").distinct())
    families = keep(classes.select("h1", "h2", node).join(families, "node"), "candidates")

    sets = texts.mapInArrow(released(_full_sets(_filter.make(families, "h1"))), SETS)
    # Sets that link differ in size by a factor of 100 / percent at most: by one level.
    level = F.floor(F.log(F.col("n").cast("double")) / float(np.log(100 / percent) * 1.000001)).cast("int")
    ready = keep(sets.join(hinted(families), ["h1", "h2"]).select("node", "root", level.alias("level"), "items"), "sets")
    linked = family_components(ready, lambda groups: [linked_pairs([np.frombuffer(x, B.U) for x in items], percent) for items in groups], None if exact else _finer(percent))
    roots = linked.union(linked.select(F.col("root").alias("node"), "root").distinct())
    grouped = classes.select("h1", "h2", "least", node).join(roots, "node")
    by_root = grouped.groupBy("root").agg(F.min("least").alias("component_id"))
    of_linked = join_hot(grouped, by_root, ["root"]).select("h1", "h2", "component_id", F.lit(True).alias("linked"))
    of_class = classes.join(of_linked, ["h1", "h2"], "left").filter("linked or rows > 1")
    return of_class.select("h1", "h2", F.when(F.col("linked"), F.col("component_id")).otherwise(F.col("least")).alias("component_id"), F.lit(True).alias("shared"))


def near_duplicates(docs: DataFrame, percent: int = 85, id_col: str = "doc_id", text_col: str = "text", exact: bool = False) -> DataFrame:
    """One row per row of docs: the id, n_shingles, component_id and kept.

    Two documents link where 100 * intersection >= percent * union of their
    shingle sets; component_id is the least id that links reach, kept whether
    it is the row's own. Null, empty and wordless texts link with nothing. Rows
    with one id are judged by their own texts; equal rows get equal answers.
    A null id counts after all others, so it is a component_id only where no
    member has an id. Other columns are not read.

    Candidates come from bands of signatures, which miss a link right at the
    threshold with a chance of MISS. exact takes the least items of each set
    as keys in place of bands, so that no link is missed; candidates are more.
    """
    mine = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    signed = keep(mine.select("id", _sign(percent, exact)("text").alias("s")).select("id", "s.*"), "signed")
    of_class = _components(signed, mine.select("text"), percent, exact)
    own = signed.select("id", "n", "h1", "h2")
    got = join_hot(own.filter("n > 0"), of_class, ["h1", "h2"], "left").select("id", "n", F.when(F.col("shared"), F.col("component_id")).otherwise(F.col("id")).alias("component_id"))
    out = got.union(own.filter("n = 0").select("id", "n", "id"))
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))


def one_of_each(docs: DataFrame, percent: int = 85, id_col: str = "doc_id", text_col: str = "text", exact: bool = False) -> DataFrame:
    """The rows of docs, all columns, one of each component (as in near_duplicates): that of the least id (nulls last), then the first.

    Of repeated rows one stays. Null, empty and wordless texts all stay, each is
    a component of its own. docs is written with a number for each row, so it
    need not give the same rows again.
    """
    row, sign = fresh(docs, "_row"), fresh(docs, "_sign")
    numbered = docs.select("*", F.monotonically_increasing_id().alias(row), _sign(percent, exact)(F.coalesce(F.col(text_col), F.lit(""))).alias(sign))
    table = keep(numbered, "numbered")
    place = F.struct(F.col(id_col).isNull().alias("late"), F.col(id_col).alias("by"), F.col(row).alias("at"))
    signed = table.select(place.alias("id"), f"{sign}.*")
    of_class = _components(signed, table.select(F.coalesce(F.col(text_col), F.lit("")).alias("text")), percent, exact)
    own = signed.filter("n > 0").select("id", "h1", "h2")
    gone = join_hot(own, of_class, ["h1", "h2"]).filter(F.col("id.at") != F.col("component_id.at")).select(F.col("id.at").alias(row))
    return few_files(without(table, keep(gone, "gone"), row).select(*docs.columns), docs)
