"""Long exact spans shared between records (problem 10).

Method: Rabin-Karp hashes of every window of ``width`` code points, counted in Spark; the repeated windows
are merged into maximal intervals. Counting 8 bytes for every character of the corpus would shuffle more
than the corpus itself, so windows are counted in two exact steps:

1. Every window is named by its anchor, the least hash of the ``inner``-character windows inside it (a
   window's anchor is a function of its text, so equal windows have equal anchors). Consecutive windows with
   one anchor form a run, about 2/(width-inner) of the characters; a run also gets the hash of its whole
   text. Runs with an anchor of one document only are dropped. A run whose whole text occurs in another
   document is shared as a whole, which settles copies and quoted passages, however often they occur, by
   partial aggregates over (min, max) document.
2. Only anchors with several different runs are left. One run of each kind is cut into blocks of windows at
   fixed distances from its anchor, and blocks are counted in the same way, by the text that all windows of
   a block have in common and by the block's whole text; in what then is left, single windows are counted.

Texts are moved for the second step only, deflated, and only those of documents with an open run or block (a filter of bounded
size drops the others before the shuffle). The last joins bring the intervals back to all documents holding the run. No group is collected: groups by
hash keep two documents, groups by document are bounded by the document's own length.

Defined results: null texts and texts shorter than the window give no rows; repetition inside one document
only is no case; positions are code points; rows with equal ids count as one document, a null id is
ignored; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracequarry.llm.keyfilter import KeyFilter
from tracequarry.session import staged

WIDTH = 200
INNER = 80
#: Windows examined together in the second step.
BLOCK = 8
#: Characters hashed at once (about 60 bytes each while at work); a longer text is hashed in pieces that overlap by a window.
CHUNK = 1 << 18
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Powers:
    """Powers of the hash base and of its inverse modulo 2**64, grown on demand."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def grow(self, n: int) -> None:
        if self.up.size < n:
            n = max(n, 2 * self.up.size)
            with np.errstate(over="ignore"):
                self.up = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n - 1, _BASE)]), dtype=np.uint64)
                self.down = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n - 1, _INVERSE)]), dtype=np.uint64)


class RollingHash:
    """Prefix sums from which the hash of any window is one subtraction and one product."""

    def __init__(self, text: str, powers: Powers):
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        self.n = codes.size
        powers.grow(self.n + 1)
        self.powers = powers
        with np.errstate(over="ignore"):
            self.prefix = np.zeros(self.n + 1, np.uint64)
            np.cumsum(mix(codes.astype(np.uint64) + np.uint64(0x1F123BB5)) * powers.up[: self.n], dtype=np.uint64, out=self.prefix[1:])

    def all(self, width: int) -> np.ndarray:
        """Hash of the window at every place."""
        with np.errstate(over="ignore"):
            return mix((self.prefix[width:] - self.prefix[:-width]) * self.powers.down[: self.n - width + 1])

    def at(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hash of each [start, end)."""
        with np.errstate(over="ignore"):
            return mix((self.prefix[end] - self.prefix[start]) * self.powers.down[start] + (end - start).astype(np.uint64))


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Least value of every stretch of ``width`` values, in three passes (block prefix and suffix minima)."""
    n = x.size
    blocks = -(-n // width)
    padded = np.full(blocks * width, np.uint64(0xFFFFFFFFFFFFFFFF))
    padded[:n] = x
    grid = padded.reshape(blocks, width)
    head = np.minimum.accumulate(grid, axis=1).ravel()
    tail = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(tail[: n - width + 1], head[width - 1 : n])


def chunks(ids: list, texts: list, width: int, chunk: int = CHUNK) -> Iterator[tuple[list, str, np.ndarray, int]]:
    """(ids, joined text, starts, offset in a long text) of up to about ``chunk`` characters."""
    own_ids, own, starts, size = [], [], [0], 0
    for key, text in zip(ids, texts):
        if key is None or text is None or len(text) < width:
            continue
        if size and size + len(text) > chunk:
            yield own_ids, "".join(own), np.asarray(starts), 0
            own_ids, own, starts, size = [], [], [0], 0
        if len(text) > chunk + width - 1:
            for at in range(0, len(text) - width + 1, chunk):
                piece = text[at : at + chunk + width - 1]
                yield [key], piece, np.asarray([0, len(piece)]), at
            continue
        own_ids.append(key)
        own.append(text)
        size += len(text)
        starts.append(size)
    if own:
        yield own_ids, "".join(own), np.asarray(starts), 0


def pieces(text: str, first: np.ndarray, n: np.ndarray, width: int, powers: Powers, chunk: int = CHUNK) -> Iterator[tuple[np.ndarray, int, RollingHash]]:
    """(numbers of runs, offset, hashes of the text from there on that these runs need): one piece but for long texts."""
    most = int(n.max(initial=0)) + 2 * width
    for at in range(0, max(1, len(text)), chunk):
        own = np.flatnonzero((first >= at) & (first < at + chunk)) if len(text) > chunk else np.arange(first.size)
        if own.size:
            low = max(0, at - width) if len(text) > chunk else 0  # blocks begin up to a window before their run
            yield own, low, RollingHash(text[low : at + chunk + most] if len(text) > chunk else text, powers)
        if len(text) <= chunk:
            return


def anchor_runs(text: str, starts: np.ndarray, width: int, inner: int, powers: Powers):
    """(document number, anchor, run hash, first window, end of windows) of each run, places within the document."""
    h = RollingHash(text, powers)
    least = sliding_min(h.all(inner), width - inner + 1)  # one for each window of the joined text
    doc = np.searchsorted(starts, np.arange(least.size), side="right") - 1
    inside = np.arange(least.size) + width <= starts[doc + 1]
    fresh = np.ones(least.size, bool)
    fresh[1:] = (least[1:] != least[:-1]) | (doc[1:] != doc[:-1]) | (inside[1:] != inside[:-1])
    first = np.flatnonzero(fresh)
    end = np.append(first[1:], least.size)
    keep = inside[first]
    first, end = first[keep], end[keep]
    number = doc[first]
    return number, least[first], h.at(first, end + width - 1), first - starts[number], end - starts[number]


def split_blocks(h: RollingHash, inner_hash: np.ndarray, first: np.ndarray, n: np.ndarray, width: int, inner: int):
    """Blocks of up to BLOCK windows of each run, cut at fixed distances from the run's anchor:
    (run number, first window, windows, hash of the text all windows of a full block share, hash of the block's text)."""
    reach = width - inner + 1
    out = []
    run, first, end = np.arange(first.size), first.astype(np.int64), (first + n).astype(np.int64)
    while run.size:
        anchor = first + np.argmin(inner_hash[first[:, None] + np.arange(reach)], axis=1)
        stop = np.minimum(end, anchor + 1)  # where the anchor leaves the window, an equal one takes over
        block0, block1 = (first - anchor) // BLOCK, (stop - 1 - anchor) // BLOCK
        count = block1 - block0 + 1
        of = np.repeat(np.arange(run.size), count)
        block = block0[of] + np.arange(of.size) - np.repeat(np.cumsum(count) - count, count)
        base = anchor[of] + block * BLOCK
        s, e = np.maximum(base, first[of]), np.minimum(base + BLOCK, stop[of])
        out.append((run[of], s, e - s, h.at(base + BLOCK - 1, base + width), h.at(s, e - 1 + width)))
        more = stop < end
        run, first, end = run[more], stop[more], end[more]
    return [np.concatenate(x) for x in zip(*out)]


def shared_spans(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, inner: int = INNER, chunk: int = CHUNK) -> DataFrame:
    """(id_col, span_start, span_end): maximal runs of characters lying in a stretch of ``width`` characters
    that occurs verbatim in another document."""
    if width - inner < BLOCK:
        raise ValueError("the window must exceed the anchor by a block at least")
    src = df.select(df[id_col].cast("bigint").alias("d"), df[text_col].alias("t")).where(F.length("t") >= width)

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = Powers()
        for batch in (b.slice(at, 500) for b in batches for at in range(0, b.num_rows, 500)):
            for own, text, starts, offset in chunks(batch.column(0).to_pylist(), batch.column(1).to_pylist(), width, chunk):
                number, anchor, whole, first, end = anchor_runs(text, starts, width, inner, powers)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.asarray(own, dtype=np.int64)[number]), pa.array(anchor.view(np.int64)), pa.array(whole.view(np.int64)), pa.array((first + offset).astype(np.int32)), pa.array((end - first).astype(np.int32))],
                    names=["d", "anchor", "whole", "first", "n"],
                )

    def packed(of: DataFrame) -> DataFrame:
        """(d, z): the deflated texts of the documents of a table; others are dropped before the shuffle (all but a few)."""
        wanted = df.sparkSession.sparkContext.broadcast(KeyFilter.of(of.select(F.xxhash64("d").alias("v"))))  # of bounded size

        def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in (b.slice(at, 500) for b in batches for at in range(0, b.num_rows, 500)):
                batch = batch.filter(pa.array(wanted.value.holds(batch.column(2).to_numpy().view(np.uint64))))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([zlib.compress(t.encode("utf-8"), 1) for t in batch.column(1).to_pylist()], type=pa.binary())], names=["d", "z"])

        return src.where("d is not null").select("d", "t", F.xxhash64("d").alias("v")).mapInArrow(pack, "d bigint, z binary")

    run = staged(src.mapInArrow(runs, "d bigint, anchor bigint, whole bigint, first int, n int"))
    anchors = run.select("anchor", "d").groupBy("anchor").agg(F.min("d").alias("x"), F.max("d").alias("y")).where("x < y").select("anchor")
    kept = staged(run.join(anchors, "anchor", "left_semi"))
    # at: a place of the run in its least document; b: its greatest document
    kinds = kept.groupBy("anchor", "whole").agg(F.min(F.struct("d", "first", "n")).alias("at"), F.max("d").alias("b"))
    mixed = staged(at_documents(several(kinds, "anchor", "whole"), "whole"))

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = Powers()
        for batch in batches:
            for row in range(batch.num_rows):
                found = batch.column(1)[row].values
                first, n = found.field("first").to_numpy(), found.field("n").to_numpy()
                text = zlib.decompress(batch.column(2)[row].as_py()).decode("utf-8")
                found_in = []
                for own, low, h in pieces(text, first, n, width, powers, chunk):
                    of, s, m, core, union = split_blocks(h, h.all(inner), first[own] - low, n[own], width, inner)
                    found_in.append((own[of], s + low, m, core, union))
                of, s, m, core, union = (np.concatenate(x) for x in zip(*found_in))
                d = np.full(of.size, batch.column(0)[row].as_py(), dtype=np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(core.view(np.int64)), pa.array(union.view(np.int64)), pa.array(d), pa.array(s.astype(np.int32)), pa.array(m.astype(np.int32)), pa.array((s - first[of]).astype(np.int32)), pa.array(found.field("key").to_numpy()[of]), pa.array(found.field("b").to_numpy()[of])],
                    names=["core", "part", "d", "first", "n", "o", "whole", "b"],
                )

    block = staged(mixed.join(packed(mixed), "d").mapInArrow(blocks, "core bigint, part bigint, d bigint, first int, n int, o int, whole bigint, b bigint"))
    parts = block.groupBy("core", "part").agg(F.min(F.struct("d", "first", "n")).alias("at"), F.max("b").alias("b"))

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = Powers()
        for batch in batches:
            for row in range(batch.num_rows):
                found = batch.column(1)[row].values
                first, n = found.field("first").to_numpy(), found.field("n").to_numpy()
                text = zlib.decompress(batch.column(2)[row].as_py()).decode("utf-8")
                of = np.repeat(np.arange(n.size), n)
                o = np.arange(of.size) - np.repeat(np.cumsum(n) - n, n)
                start, hashed = first[of] + o, np.zeros(of.size, np.uint64)
                for own, low, h in pieces(text, first, n, width, powers, chunk):
                    at = np.flatnonzero(np.isin(of, own)) if own.size < n.size else np.arange(of.size)
                    hashed[at] = h.at(start[at] - low, start[at] - low + width)
                d = np.full(of.size, batch.column(0)[row].as_py(), dtype=np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(hashed.view(np.int64)), pa.array(found.field("key").to_numpy()[of]), pa.array(o.astype(np.int32)), pa.array(d), pa.array(found.field("b").to_numpy()[of])], names=["h", "part", "o", "a", "b"]
                )

    open_parts = staged(at_documents(several(parts, "core", "part"), "part"))
    window = open_parts.join(packed(open_parts), "d").mapInArrow(windows, "h bigint, part bigint, o int, a bigint, b bigint")
    twice = window.groupBy("h").agg(F.min("a").alias("x"), F.max("b").alias("y")).where("x < y").select("h")
    one = F.struct(F.col("o").alias("s"), (F.col("o") + 1).alias("e"))
    shared_part = (
        parts.where("at.d < b").select("part", F.array(F.struct(F.lit(0).alias("s"), F.col("at.n").alias("e"))).alias("of"))
    ).unionByName(window.where("a = b").join(twice, "h", "left_semi").groupBy("part").agg(F.array_sort(F.collect_set(one)).alias("of")))
    shift = lambda by: F.transform("of", lambda x: F.struct((x["s"] + F.col(by)).alias("s"), (x["e"] + F.col(by)).alias("e")))
    partly = block.where("d = b").select("part", "whole", "o").join(shared_part, "part").select("whole", F.explode(shift("o")).alias("x")).groupBy("whole").agg(join_intervals("x").alias("of"))
    shared_run = kinds.where("at.d < b").select("whole", F.array(F.struct(F.lit(0).alias("s"), F.col("at.n").alias("e"))).alias("of")).unionByName(partly)
    marked = kept.select("d", "whole", "first").join(shared_run, "whole").select("d", F.explode(shift("first")).alias("x"))
    spans = marked.select("d", F.struct("x.s", (F.col("x.e") + width - 1).alias("e")).alias("x")).groupBy("d").agg(join_intervals("x").alias("of"))
    return spans.select("d", F.explode("of").alias("x")).select(F.col("d").alias(id_col), F.col("x.s").alias("span_start"), F.col("x.e").alias("span_end"))


def several(kinds: DataFrame, key: str, whole: str) -> DataFrame:
    """The kinds whose key has other kinds as well."""
    two = kinds.groupBy(key).agg(F.min(whole).alias("u"), F.max(whole).alias("v")).where("u <> v").select(key)
    return kinds.join(two, key, "left_semi")


def at_documents(kinds: DataFrame, key: str) -> DataFrame:
    """One place of each kind, gathered by the document it is in (bounded by that document's length)."""
    return kinds.groupBy(F.col("at.d").alias("d")).agg(F.collect_list(F.struct(F.col(key).alias("key"), "at.first", "at.n", "b")).alias("of"))


def join_intervals(col: str):
    """Aggregate: the intervals of a group, those that touch or overlap merged."""
    last = lambda acc: F.try_element_at(acc, F.lit(-1))
    return F.aggregate(
        F.array_sort(F.collect_set(col)),
        F.array().cast("array<struct<s:int,e:int>>"),
        lambda acc, x: F.when(
            (F.size(acc) > 0) & (last(acc)["e"] >= x["s"]),
            F.concat(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))), F.array(F.struct(last(acc)["s"].alias("s"), F.greatest(last(acc)["e"], x["e"]).alias("e")))),
        ).otherwise(F.concat(acc, F.array(x))),
    )


def shared_share(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH) -> DataFrame:
    """(id_col, n_chars, shared_chars, shared_share) of every document with a text."""
    spans = shared_spans(df, id_col, text_col, width).groupBy(id_col).agg(F.sum(F.col("span_end") - F.col("span_start")).alias("shared_chars"))
    docs = df.select(F.col(id_col), F.length(text_col).cast("bigint").alias("n_chars")).where("n_chars is not null")
    return docs.join(spans, id_col, "left").select(
        id_col, "n_chars", F.coalesce("shared_chars", F.lit(0)).alias("shared_chars"), F.round(F.coalesce(F.try_divide("shared_chars", "n_chars"), F.lit(0.0)), 6).alias("shared_share")
    )
