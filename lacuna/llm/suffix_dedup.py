"""Removal of long strings that occur earlier, by sorted suffixes.

Sorting every suffix of the corpus would move a hundred bytes for each byte of text. Two exact reductions
come first; both depend on nothing but the bytes of a window (``WINDOW`` bytes), so equal windows are always
treated alike wherever they stand:

* Only suffixes at anchors are dealt out. The anchor of a window is the leftmost of its ``GRAM``-byte grams
  with the least hash; neighbouring windows mostly share it. Equal windows have equal anchors at equal
  distances, so all equal windows meet at the suffixes that begin with their anchor's gram.
* Anchor suffixes whose whole context (all windows of the anchor) is equal need no sorting: all but the
  earliest are repeats.

Anchor suffixes are range-partitioned by their leading bytes with splitters from a sample. A range holds all
suffixes that begin with a gram, so no group of equal windows crosses a boundary. The earliest of each
distinct context that shares its gram with another context fetches its bytes; its windows are sorted by
three-way multikey quicksort, eight bytes at a time, dropping windows as soon as they stand alone.

Grams and contexts are identified by 64 bits each (128 together); windows are compared byte for byte.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import materialise, partitions, release, table

WINDOW, GRAM = 100, 32
SPREAD = WINDOW - GRAM + 1  # grams of a window
CHUNK = 1 << 20
_U = np.uint64
_C = [_U(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD, 0xA0761D6478BD642F)]
_LOW = _U(CHUNK - 1)
_STEP = 0x5851F42D4C957F2D
_POWERS: list[np.ndarray] = []


def _powers() -> tuple[np.ndarray, np.ndarray]:
    if not _POWERS:
        for base in (_STEP, pow(_STEP, -1, 1 << 64)):
            steps = np.full(CHUNK, base, _U)
            steps[0] = 1
            _POWERS.append(np.multiply.accumulate(steps))
    return _POWERS[0], _POWERS[1]


def _words(data: np.ndarray, n: int) -> np.ndarray:
    """The 8 bytes from every place; data has at least n + 7 bytes."""
    return np.ndarray((n,), "<u8", buffer=data, strides=(1,)).copy()


def _anchors_of(data: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> dict[str, np.ndarray]:
    """Anchor groups of pieces [begin, end) of one buffer of at most CHUNK bytes: gram and context hashes,
    first and last window start, place of the anchor, leading bytes."""
    n = len(data)
    w = _words(np.concatenate([data, np.zeros(GRAM + 8, np.uint8)]), n + GRAM)
    mixed = w * _C[0]
    mixed ^= mixed >> _U(32)
    gram = mixed[:n] + mixed[8 : n + 8] * _C[1] + mixed[16 : n + 16] * _C[2] + mixed[24 : n + 24] * _C[3]
    gram ^= gram >> _U(29)
    gram *= _C[4]
    gram ^= gram >> _U(32)
    least = gram & ~_LOW | np.arange(n, dtype=_U)
    width = 1
    while width < SPREAD:
        s = min(width, SPREAD - width)
        least = np.minimum(least[:-s], least[s:])
        width += s
    starts = np.concatenate([np.arange(a, b - WINDOW + 1) for a, b in zip(begins, ends)])
    place = (least[starts] & _LOW).astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
    lo, hi, at = starts[first], starts[np.concatenate([first[1:] - 1, [len(starts) - 1]])], place[first]
    up, down = _powers()
    sums = np.zeros(n + 1, _U)
    np.cumsum(mixed[:n] * up[:n], out=sums[1:])
    context = (sums[hi + WINDOW - 7] - sums[lo]) * down[lo] + (hi - lo).astype(_U) * _C[1] + (at - lo).astype(_U) * _C[2]
    context ^= context >> _U(31)
    context *= _C[5]
    return {"gram": gram[at], "context": context, "lo": lo, "hi": hi, "at": at, "lead": w[at].byteswap()}


def anchors(ids: np.ndarray, reps: np.ndarray, texts: list[bytes]) -> Iterator[dict[str, np.ndarray]]:
    """Columns (gram, context, id, rep, lo, hi, at, lead) of the texts' anchor groups, places within the text.
    Longer texts are taken in pieces that overlap by a window less one byte."""
    half = CHUNK // 2
    pieces = [(i, a, t[a : a + half + WINDOW - 1]) for i, t in enumerate(texts) for a in range(0, max(1, len(t) - WINDOW + 1), half) if len(t) - a >= WINDOW]
    at = 0
    while at < len(pieces):
        size, end = 0, at
        while end < len(pieces) and size + len(pieces[end][2]) <= CHUNK:
            size += len(pieces[end][2])
            end += 1
        some = pieces[at:end]
        at = end
        ends = np.cumsum([len(p) for _, _, p in some])
        begins = ends - [len(p) for _, _, p in some]
        g = _anchors_of(np.frombuffer(b"".join([p for _, _, p in some]), np.uint8), begins, ends)
        piece = np.searchsorted(ends, g["lo"], side="right")
        shift = np.array([a for _, a, _ in some])[piece] - begins[piece]
        doc = np.array([i for i, _, _ in some])[piece]
        yield {
            "gram": g["gram"].view(np.int64), "context": g["context"].view(np.int64), "id": ids[doc], "rep": reps[doc],
            "lo": g["lo"] + shift, "hi": g["hi"] + shift, "at": g["at"] + shift, "lead": g["lead"],
        }


def multikey_order(group: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Stable multikey quicksort of the rows of groups (ascending numbers) by columns keys[depth, row].

    Each group is split three ways at the key of its middle row; the smaller and the larger rows stay at their
    column, the equal ones go on to the next. All groups take a step together; a row that stands alone is done.
    Returns the rows that are equal to another in all columns, and their groups."""
    done: list[tuple[np.ndarray, np.ndarray]] = []
    rows, named = np.arange(len(group)), 0
    bounds = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]])) if len(group) else np.zeros(0, np.int64)
    sizes = np.diff(np.append(bounds, len(rows)))
    depth = np.zeros(len(sizes), np.int64)
    while True:
        # groups of one are done; those past the last column are equal throughout
        equal, go = (sizes > 1) & (depth == len(keys)), (sizes > 1) & (depth < len(keys))
        if equal.any():
            done.append((rows[np.repeat(equal, sizes)], np.repeat(np.arange(named, named + equal.sum()), sizes[equal])))
            named += int(equal.sum())
        rows = rows[np.repeat(go, sizes)]
        sizes, depth = sizes[go], depth[go]
        if not len(rows):
            break
        begin = np.cumsum(sizes) - sizes
        of = np.repeat(np.arange(len(sizes)), sizes)
        key = keys[depth[of], rows]
        pivot = key[begin + sizes // 2][of]
        side = (key >= pivot).astype(np.int64) + (key > pivot)
        third = of * 3 + side
        sizes = np.bincount(third, minlength=3 * len(depth))
        offset = np.cumsum(sizes) - sizes
        place = np.empty(len(rows), np.int64)
        for s in range(3):
            its = np.flatnonzero(side == s)
            # rows of one side keep their order, so their places run on from the offset of their third
            t = third[its]
            rank = np.arange(len(its)) - np.searchsorted(t, t)
            place[its] = offset[t] + rank
        moved = np.empty_like(rows)
        moved[place] = rows
        rows = moved
        depth = (depth[:, None] + np.array([0, 1, 0])).ravel()
    if not done:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate([r for r, _ in done]), np.concatenate([g for _, g in done])


def repeated_windows(gram: np.ndarray, lo: np.ndarray, hi: np.ndarray, at: np.ndarray, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of window starts that occur earlier: (row, first, last). Rows are ordered by gram, document and place,
    each with the bytes [lo, hi + WINDOW)."""
    counts = hi - lo + 1
    row = np.repeat(np.arange(len(lo)), counts)
    step = np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts)
    sizes = np.array([len(t) for t in texts])
    data = np.frombuffer(b"".join(texts) + bytes(8), np.uint8)
    begin = (np.cumsum(sizes) - sizes)[row] + step
    words = _words(data, len(data) - 8)
    keys = np.empty((len(range(0, WINDOW - 8, 8)) + 2, len(row)), _U)
    keys[0] = (at - lo)[row] - step
    for i, j in enumerate((*range(0, WINDOW - 8, 8), WINDOW - 8)):
        keys[i + 1] = words[begin + j].byteswap()
    rows, label = multikey_order(gram[row], keys)
    later = rows[np.concatenate([[False], label[1:] == label[:-1]])] if len(rows) else rows
    later = np.sort(later)
    if not len(later):
        none = np.zeros(0, np.int64)
        return none, none, none
    start = lo[row[later]] + step[later]
    new = np.concatenate([[True], (row[later][1:] != row[later][:-1]) | (start[1:] != start[:-1] + 1)])
    first = np.flatnonzero(new)
    last = np.concatenate([first[1:] - 1, [len(later) - 1]])
    return row[later][first], start[first], start[last]


def _by_group(batches: Iterator[pd.DataFrame], key: str, weight: str, most: int) -> Iterator[pd.DataFrame]:
    """Frames of whole groups of rows that are sorted by key, of about ``most`` weight or one group."""
    held: list[pd.DataFrame] = []
    for b in batches:
        if b.empty:
            continue
        held.append(b)
        if sum(h[weight].sum() for h in held) >= most:
            whole = pd.concat(held, ignore_index=True)
            k = whole[key].to_numpy()
            cut = int(np.flatnonzero(k != k[-1])[-1]) + 1 if (k != k[-1]).any() else 0
            if cut:
                yield whole.iloc[:cut]
            held = [whole.iloc[cut:]]
    if held:
        yield pd.concat(held, ignore_index=True)


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = 1000, windows: int = 200_000) -> DataFrame:
    """One row per input row: doc_id, n_bytes, n_removed, n_spans, kept (binary).

    A byte is removed if a 100-byte string over it also starts earlier: in a smaller doc_id (null is smallest;
    rows that repeat an id follow each other by text) or earlier in the same text. Null text counts as empty.
    Matches never cross documents. Other columns are ignored; an empty table gives no rows.
    ``sample`` documents give the splitters, which affect the balance of partitions alone.
    """
    spark = docs.sparkSession
    n = partitions(spark)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.select(F.coalesce("doc_id", F.lit(-(1 << 63))).alias("id"), "doc_id", "text")
    if rows.groupBy("id").agg(F.count("*").alias("n")).where("n > 1").limit(1).count():
        rows = rows.withColumn("rep", F.row_number().over(W.partitionBy("id").orderBy("text")))
    else:
        rows = rows.withColumn("rep", F.lit(1))

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                yield from anchors(b["id"].to_numpy(), b["rep"].to_numpy(), [t.encode() for t in b["text"]])

    def leads(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for a in scan(batches):
            yield pd.DataFrame({"lead": a["lead"][::16].view(np.int64)})

    share = min(1.0, sample / max(1, rows.count()))
    few = rows.where(F.pmod(F.xxhash64("id"), F.lit(1 << 40)) <= F.lit(int(share * (1 << 40)))).select("id", "rep", F.substring("text", 1, 20_000).alias("text"))
    seen = np.sort(few.mapInPandas(leads, "lead long").toPandas()["lead"].to_numpy(np.int64).view(_U))
    parts = 8 * n
    splitters = spark.sparkContext.broadcast(np.unique(seen[(np.arange(1, parts) * len(seen)) // parts]) if len(seen) else seen)

    def dealt(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for a in scan(batches):
            part = np.searchsorted(splitters.value, a["lead"], side="right").astype(np.int32)
            span = a["lo"] << 14 | (a["hi"] - a["lo"]) << 7 | (a["at"] - a["lo"])
            yield pd.DataFrame({"part": part, "gram": a["gram"], "context": a["context"], "id": a["id"], "rep": a["rep"].astype(np.int32), "span": span})

    suffixes = (
        rows.select("id", "rep", "text")
        .mapInPandas(dealt, "part int, gram long, context long, id long, rep int, span long")
        .repartition(n, "part")
        .sortWithinPartitions("part", "gram", "context", "id", "rep", "span")
    )

    def sift(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Repeats of a whole context, and the earliest of contexts that share a gram with another."""
        gram = context = None  # of the row before
        held = None  # the last earliest row: not known yet whether another context follows
        for b in batches:
            if b.empty:
                continue
            g, c = b["gram"].to_numpy(), b["context"].to_numpy()
            same = np.concatenate([[gram == g[0] and context == c[0]], (g[1:] == g[:-1]) & (c[1:] == c[:-1])])
            gram, context = g[-1], c[-1]
            if same.any():
                yield b.loc[same, ["id", "rep", "span"]].assign(gram=0, edge=False)
            firsts = b[~same]
            if held is not None:
                firsts = pd.concat([held, firsts])
            k = firsts["gram"].to_numpy()
            if not len(k):
                continue
            after = np.concatenate([k[1:] == k[:-1], [False]])
            before = np.concatenate([[False], after[:-1]])
            if held is not None and "known" in held:
                before[0] = bool(held["known"].iloc[0])
            edge = before | after
            edge[-1] = False
            if edge.any():
                yield firsts.loc[edge, ["id", "rep", "span", "gram"]].assign(edge=True)
            held = firsts.iloc[-1:].assign(known=before[-1])
        if held is not None and bool(held["known"].iloc[0]):
            yield held[["id", "rep", "span", "gram"]].assign(edge=True)

    sifted = materialise(suffixes.mapInPandas(sift, "id long, rep int, span long, gram long, edge boolean"), "suffixes")
    release(spark)

    wanted = sifted.where("edge").groupBy("id", "rep").agg(F.collect_list(F.struct("gram", "span")).alias("spans"))

    def fetch(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for i, r, text, spans in zip(b["id"], b["rep"], b["text"], b["spans"]):
                data = text.encode()
                for s in spans:
                    lo, wide = s["span"] >> 14, s["span"] >> 7 & 127
                    out.append((s["gram"], i, r, s["span"], data[lo : lo + wide + WINDOW]))
                if len(out) > 20_000:
                    yield pd.DataFrame(out, columns=["gram", "id", "rep", "span", "bytes"])
                    out = []
            if out:
                yield pd.DataFrame(out, columns=["gram", "id", "rep", "span", "bytes"])

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in _by_group((b.assign(w=(b["span"].to_numpy() >> 7 & 127) + 1) for b in batches), "gram", "w", windows):
            span = b["span"].to_numpy()
            lo, wide, off = span >> 14, span >> 7 & 127, span & 127
            ids, reps, gram, data = b["id"].to_numpy(), b["rep"].to_numpy(), b["gram"].to_numpy(), b["bytes"].tolist()
            # a very large group goes distance by distance: windows at other distances differ from each other
            for d in [None] if b["w"].sum() <= 3 * windows else range(SPREAD):
                if d is None:
                    r, first, last = repeated_windows(gram, lo, lo + wide, lo + off, data)
                else:
                    has = np.flatnonzero((off >= d) & (off - d <= wide))
                    if not len(has):
                        continue
                    at = lo + off - d
                    r, first, last = repeated_windows(gram[has], at[has], at[has], (lo + off)[has], [data[i][off[i] - d : off[i] - d + WINDOW] for i in has])
                    r = has[r]
                if len(r):
                    yield pd.DataFrame({"id": ids[r], "rep": reps[r], "removed": first << 32 | last})

    edges = materialise(
        rows.join(wanted, ["id", "rep"])
        .mapInPandas(fetch, "gram long, id long, rep int, span long, bytes binary")
        .repartition(n, "gram")
        .sortWithinPartitions("gram", "id", "rep", "span")
        .mapInPandas(compare, "id long, rep int, removed long"),
        "windows",
    )
    release(spark)

    whole = sifted.where("not edge").select("id", "rep", F.expr("shiftleft(shiftright(span, 14), 32) | (shiftright(span, 14) + (shiftright(span, 7) & 127))").alias("removed"))
    removed = whole.unionByName(edges).groupBy("id", "rep").agg(F.collect_list("removed").alias("removed"))

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for doc, text, spans in zip(b["doc_id"], b["text"], b["removed"]):
                data, gone, runs, kept, at = text.encode(), 0, 0, [], 0
                if spans is not None and len(spans):
                    s = np.sort(spans)
                    first, end = s >> 32, (s & 0xFFFFFFFF) + WINDOW
                    end = np.maximum.accumulate(end)
                    new = np.flatnonzero(np.concatenate([[True], first[1:] > end[:-1]]))
                    for a, z in zip(first[new].tolist(), end[np.concatenate([new[1:] - 1, [len(s) - 1]])].tolist()):
                        kept.append(data[at:a])
                        gone, runs, at = gone + z - a, runs + 1, z
                kept.append(data[at:])
                out.append((doc, len(data), gone, runs, b"".join(kept)))
            if out:
                yield pd.DataFrame(out, columns=["doc_id", "n_bytes", "n_removed", "n_spans", "kept"]).astype({"doc_id": "Int64"})

    return rows.join(removed, ["id", "rep"], "left").select("doc_id", "text", "removed").mapInPandas(cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = remove_repeats(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
