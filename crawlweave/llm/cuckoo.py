"""Has this key been seen before? (problem 4): partitioned cuckoo tables of short fingerprints.

Keys are hashed in the JVM; a row carries two 64-bit hashes and its id, never the key. Before the shuffle each
Arrow batch settles its own repeats, so a key that holds a third of all rows sends one row a batch. One shuffle
brings the rows of a table together in arrival order; a table keeps one fingerprint a key in one of two candidate
buckets, doubles when it saturates, and can be written, loaded and relieved of keys as a state table.
A key that came earlier is always reported (no false negatives); `error_rate` measures the false positives.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crawlweave.functions.common import partitions, written

SLOTS = 4
KICKS = 500
LOAD = 0.93
BUCKETS = 1 << 12
#: Buckets in one row of a state table (16 MB).
PIECE = 1 << 20
ROWS = "part int, rec_id long, h1 long, h2 long, seen boolean, payload binary"


def url_key(url: Column) -> Column:
    """The address as a key: fragment dropped, scheme and host lower-cased, query arguments sorted as strings."""
    bare = F.substring_index(url, "#", 1)
    head = F.regexp_extract(bare, r"^[A-Za-z][A-Za-z0-9+.-]*:(//[^/?]*)?", 0)
    rest = F.substr(bare, F.length(head) + 1)
    path = F.substring_index(rest, "?", 1)
    query = F.substr(rest, F.length(path) + 2)
    args = F.array_join(F.array_sort(F.split(query, "&", -1)), "&")
    return F.concat(F.lower(head), path, F.when(F.contains(rest, F.lit("?")), F.concat(F.lit("?"), args)).otherwise(""))


class Table:
    """One cuckoo table: `buckets` x 4 fingerprints (0: free), that grows by doubling.

    The low bits of a bucket come from the key's hash, and the second bucket differs from the first in these alone. Each
    doubling takes one more bit of the bucket from the fingerprint itself, so stored fingerprints tell where they move and
    a key has one pair of buckets, whenever it came. Deletion can then only meet fingerprints that equal the key's in full.
    """

    def __init__(self, base: int, slots: np.ndarray | None = None) -> None:
        self.base = base
        self.slots = np.zeros((base, SLOTS), np.uint32) if slots is None else slots
        self.used = int((self.slots != 0).sum())
        self.rng = np.random.default_rng(base)

    @property
    def grown(self) -> int:
        return len(self.slots) // self.base

    def pair(self, h: np.ndarray, fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        f = fp.astype(np.int64)
        i1 = (h & np.int64(self.base - 1)) + (f & np.int64(self.grown - 1)) * self.base
        return i1, self.other(i1, f)

    def other(self, i, f):
        return i ^ ((f * 0x5BD1E995 >> 7) & (self.base - 1))

    def contains(self, h: np.ndarray, fp: np.ndarray) -> np.ndarray:
        i1, i2 = self.pair(h, fp)
        want = fp[:, None]
        return (self.slots[i1] == want).any(1) | (self.slots[i2] == want).any(1)

    def grow(self) -> None:
        """Twice the buckets: every fingerprint stays or moves to the same place of the new half."""
        moves = (self.slots & np.uint32(self.grown)) != 0
        self.slots = np.concatenate([np.where(moves, 0, self.slots), np.where(moves, self.slots, 0)]).astype(np.uint32)

    def insert(self, h: np.ndarray, fp: np.ndarray) -> np.ndarray:
        """Insert all; returns the positions of those that found no place."""
        left = np.arange(len(h))
        pair = self.pair(h, fp)
        for side in pair:
            if not len(left):
                break
            order = left[np.argsort(side[left], kind="stable")]
            b = side[order]
            first = np.flatnonzero(np.r_[True, b[1:] != b[:-1]])
            nth = np.arange(len(b)) - np.repeat(first, np.diff(np.r_[first, len(b)]))
            free = (self.slots[b] == 0).cumsum(1)
            fits = free[:, -1] > nth
            at = (free == (nth + 1)[:, None]).argmax(1)
            self.slots[b[fits], at[fits]] = fp[order[fits]]
            self.used += int(fits.sum())
            left = order[~fits]
        return np.array([k for k in np.sort(left) if not self._kick(int(pair[0][k]), fp[k])], np.int64)

    def _kick(self, i: int, fp: np.uint32) -> bool:
        path = []
        for _ in range(KICKS):
            for b in (i, int(self.other(i, int(fp)))):
                free = np.flatnonzero(self.slots[b] == 0)
                if len(free):
                    self.slots[b, free[0]] = fp
                    self.used += 1
                    return True
            s = int(self.rng.integers(SLOTS))
            path.append((i, s))
            fp, self.slots[i, s] = self.slots[i, s], fp
            i = int(self.other(i, int(fp)))
        for b, s in reversed(path):  # put every moved fingerprint back
            fp, self.slots[b, s] = self.slots[b, s], fp
        return False


class Filter:
    """A table that doubles when it saturates."""

    def __init__(self, bits: int = 32, buckets: int = BUCKETS, table: Table | None = None) -> None:
        assert 1 <= bits <= 32 and buckets & (buckets - 1) == 0
        self.bits = bits
        self.table = table or Table(buckets)

    def prints(self, h2: np.ndarray) -> np.ndarray:
        return ((h2 & np.int64(0x7FFFFFFFFFFFFFFF)) % np.int64((1 << self.bits) - 1) + 1).astype(np.uint32)

    def contains(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        return self.table.contains(h1, self.prints(h2))

    def insert(self, h1: np.ndarray, h2: np.ndarray) -> None:
        """Insert keys; a key inserted twice takes two places and must be deleted twice."""
        fp = self.prints(h2)
        t = self.table
        while len(fp):
            room = max(0, int(LOAD * t.slots.size) - t.used)
            left = t.insert(h1[:room], fp[:room]) if room else np.empty(0, np.int64)
            h1, fp = np.r_[h1[:room][left], h1[room:]], np.r_[fp[:room][left], fp[room:]]
            if len(fp):
                if t.grown >= 1 << (self.bits - 1):
                    raise ValueError("more equal fingerprints than two buckets hold: use more bits or tables")
                t.grow()

    def delete(self, h1: np.ndarray, h2: np.ndarray) -> int:
        """Forget keys that were inserted, one place each; returns how many were there. Keys that differ in bucket pair or
        fingerprint are never touched."""
        fp, t, n = self.prints(h2), self.table, 0
        for b1, b2, f in zip(*(x.tolist() for x in t.pair(h1, fp)), fp.tolist()):
            for b in (b1, b2):
                at = np.flatnonzero(t.slots[b] == f)
                if len(at):
                    t.slots[b, at[0]] = 0
                    t.used -= 1
                    n += 1
                    break
        return n

    def step(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        """Answers for keys in arrival order. Keys of earlier calls are known by fingerprint, those of this call whole."""
        seen = self.contains(h1, h2)
        new = np.flatnonzero(~seen)
        if len(new):
            _, first = np.unique(np.stack([h1[new], h2[new]]), axis=1, return_index=True)
            fresh = np.sort(first)
            repeat = np.ones(len(new), bool)
            repeat[fresh] = False
            seen[new[repeat]] = True
            self.insert(h1[new[fresh]], h2[new[fresh]])
        return seen

    def dump(self) -> list[bytes]:
        """The table in pieces of bounded size."""
        return [self.table.slots[k : k + PIECE].tobytes() for k in range(0, len(self.table.slots), PIECE)]

    @classmethod
    def load(cls, pieces: list[bytes], bits: int, buckets: int) -> Filter:
        slots = np.frombuffer(b"".join(pieces), np.uint32).reshape(-1, SLOTS).copy()
        return cls(bits, buckets, Table(buckets, slots))


def _settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Mark the rows of a batch whose key has a row of smaller id in the same batch."""
    for batch in batches:
        i, a, b = (batch.column(n).to_numpy() for n in ("rec_id", "h1", "h2"))
        order = np.lexsort((i, b, a))
        head = np.ones(len(i), bool)
        head[1:] = (a[order][1:] != a[order][:-1]) | (b[order][1:] != b[order][:-1])
        least = i[order][np.flatnonzero(head)][np.cumsum(head) - 1] if len(i) else i
        seen = np.empty(len(i), bool)
        seen[order] = i[order] > least
        yield pa.RecordBatch.from_arrays([batch.column("rec_id"), batch.column("h1"), batch.column("h2"), pa.array(seen)], ["rec_id", "h1", "h2", "seen"])


def _answer(bits: int, buckets: int, keep: bool, all_rows: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, flt, last = None, None, (None, None, None, False)
        pieces: list[bytes] = []

        def state():
            for k, piece in enumerate(flt.dump() if keep and flt is not None else ()):
                yield pa.RecordBatch.from_pylist([{"part": part, "rec_id": None, "h1": k, "h2": None, "seen": None, "payload": piece}], schema=_arrow())

        for batch in batches:
            parts = batch.column("part").to_numpy()
            cuts = np.flatnonzero(np.r_[True, parts[1:] != parts[:-1]]) if len(parts) else []
            for k, begin in enumerate(cuts):
                piece = batch.slice(begin, (cuts[k + 1] if k + 1 < len(cuts) else len(parts)) - begin)
                if part is None or parts[begin] != part:
                    yield from state()
                    part, flt, last, pieces = int(parts[begin]), Filter(bits, buckets), (None, None, None, False), []
                loads = [x for x in piece.column("payload").to_pylist() if x is not None]
                if loads:  # they come first, in order
                    pieces += loads
                    piece = piece.filter(pa.compute.is_null(piece.column("payload")))
                    flt = Filter.load(pieces, bits, buckets)
                if not piece.num_rows:
                    continue
                gone = piece.column("drop").to_numpy(zero_copy_only=False)
                if gone.any():  # keys to forget come before the records
                    flt.delete(*(piece.column(n).to_numpy(zero_copy_only=False)[gone] for n in ("h1", "h2")))
                    piece = piece.filter(pa.array(~gone))
                    if not piece.num_rows:
                        continue
                i, a, b = (piece.column(n).to_numpy() for n in ("rec_id", "h1", "h2"))
                seen = piece.column("seen").to_numpy(zero_copy_only=False).copy()
                todo = np.flatnonzero(~seen)
                if len(todo):
                    ti, ta, tb = i[todo], a[todo], b[todo]
                    # A row that comes twice with one id gets its first answer again.
                    twin = np.zeros(len(todo), bool)
                    twin[1:] = (ti[1:] == ti[:-1]) & (ta[1:] == ta[:-1]) & (tb[1:] == tb[:-1])
                    twin[0] = (ti[0], ta[0], tb[0]) == last[:3]
                    one = np.flatnonzero(~twin)
                    got = np.zeros(len(todo), bool)
                    got[one] = flt.step(ta[one], tb[one])
                    run_no = np.cumsum(~twin) - 1
                    got = np.where(run_no < 0, last[3], got[one][np.maximum(run_no, 0)] if len(one) else last[3])
                    seen[todo] = got
                    last = (ti[-1], ta[-1], tb[-1], bool(got[-1]))
                pick = np.arange(len(i)) if all_rows else np.flatnonzero(seen)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(pick), part, np.int32)), pa.array(i[pick]), pa.array(a[pick]), pa.array(b[pick]), pa.array(seen[pick]), pa.nulls(len(pick), pa.binary())], schema=_arrow()
                )
        yield from state()

    return run


def _arrow() -> pa.Schema:
    return pa.schema([("part", pa.int32()), ("rec_id", pa.int64()), ("h1", pa.int64()), ("h2", pa.int64()), ("seen", pa.bool_()), ("payload", pa.binary())])


def _hashes(k: Column) -> list[Column]:
    """Two independent hashes of a key: the second starts from another seed."""
    return [F.xxhash64(k).alias("h1"), F.xxhash64(F.lit("fp"), k).alias("h2")]


def _flow(df: DataFrame, key: Column, id_col: str, bits: int, tables: int | None, state: DataFrame | None, keep: bool, all_rows: bool, forget: DataFrame | None = None) -> DataFrame:
    spark = df.sparkSession
    count = tables or partitions(spark)
    k = key.alias("k")
    src = df.select(F.col(id_col).cast("long").alias("rec_id"), k).where("rec_id is not null and k is not null")
    src = src.select("rec_id", *_hashes(F.col("k")))
    rows = src.mapInArrow(_settle, "rec_id long, h1 long, h2 long, seen boolean")
    # The table number takes the high bits, the bucket the low ones. Settled rows only pass through: spread evenly.
    table = lambda h: F.pmod(F.shiftrightunsigned(h, 40), F.lit(count)).cast("int")
    rows = rows.select(F.when(F.col("seen"), table(F.xxhash64("rec_id"))).otherwise(table(F.col("h1"))).alias("part"), "rec_id", "h1", "h2", "seen", F.lit(None).cast("binary").alias("payload"))
    rows = rows.withColumn("drop", F.lit(False))
    none = lambda kind: F.lit(None).cast(kind)
    if state is not None:
        rows = state.select("part", none("long").alias("rec_id"), F.col("piece").alias("h1"), none("long").alias("h2"), F.lit(False).alias("seen"), "payload", F.lit(False).alias("drop")).unionByName(rows)
    if forget is not None:
        gone = forget.select(*_hashes(F.col("k"))).select(table(F.col("h1")).alias("part"), none("long").alias("rec_id"), "h1", "h2", F.lit(False).alias("seen"), none("binary").alias("payload"), F.lit(True).alias("drop"))
        rows = gone.unionByName(rows)
    # Pieces of the state come first, then keys to forget, then records by arrival.
    rows = rows.repartition(count, "part").sortWithinPartitions("part", F.asc_nulls_first("rec_id"), "drop", "h1", "h2")
    return rows.mapInArrow(_answer(bits, BUCKETS, keep, all_rows), ROWS)


def seen_before(df: DataFrame, key: Column, id_col: str, bits: int = 32, tables: int | None = None, state: DataFrame | None = None) -> DataFrame:
    """(rec_id) of the rows whose key came in a row of smaller id, or is in `state`.

    Null keys and null ids are no cases. Rows that come twice under one id get one answer. Every true repeat is
    reported; a new key is wrongly reported with probability about 8 / 2**bits, twice that for every doubling of a table.
    `tables`: number of independent tables (default: shuffle partitions); memory a task is its keys x about 4.3 to 8.6 bytes.
    """
    return _flow(df, key, id_col, bits, tables, state, False, False).where("seen").select("rec_id")


def remember(df: DataFrame, key: Column, id_col: str, bits: int = 32, tables: int | None = None, state: DataFrame | None = None, forget: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """As `seen_before` for every row: (rec_id, seen), and the state table (part, piece, payload) for the next input.

    `tables` and `bits` must be those with which `state` was made. `forget`: a column k of keys that leave the state before
    the first row is answered; each must have been reported new once, and is unknown afterwards. No other key is forgotten,
    except one that was itself wrongly reported as seen because it shares buckets and fingerprint with the deleted key.
    Null keys to forget, and keys that aren't in the state, change nothing.
    """
    gone = forget.select(F.col("k").cast("string").alias("k")).where("k is not null").distinct() if forget is not None else None
    out = written(_flow(df, key, id_col, bits, tables, state, True, True, gone), "cuckoo")
    return out.where("payload is null").select("rec_id", "seen"), out.where("payload is not null").select("part", F.col("h1").alias("piece"), "payload")


def error_rate(df: DataFrame, key: Column, id_col: str, bits: int = 32, tables: int | None = None) -> DataFrame:
    """(rows, new_keys, reported, wrong, wrong_rate): the answers over all rows against exact ones.

    Exact first ids come from the keys themselves, with map-side minima. wrong_rate: wrong answers per new key.
    """
    got = _flow(df, key, id_col, bits, tables, None, False, True)
    first = df.select(F.col(id_col).cast("long").alias("id"), key.alias("k")).where("id is not null and k is not null")
    new = first.groupBy("k").agg(F.min("id").alias("rec_id")).select(*_hashes(F.col("k")), "rec_id", F.lit(True).alias("new"))
    both = got.join(new, ["h1", "h2", "rec_id"], "left")
    s = lambda c: F.coalesce(F.sum(F.when(c, 1).otherwise(0)), F.lit(0)).cast("long")
    isnew = F.col("new").isNotNull()
    out = both.agg(F.count("*").alias("rows"), s(isnew).alias("new_keys"), s(F.col("seen")).alias("reported"), s((isnew & F.col("seen")) | (~isnew & ~F.col("seen"))).alias("wrong"))
    return out.withColumn("wrong_rate", F.coalesce(F.col("wrong") / F.nullif(F.col("new_keys"), F.lit(0)), F.lit(0.0)).cast("double"))
