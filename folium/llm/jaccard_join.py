"""N-gram Jaccard join by index lists with skipping, and answers derived from a similar set's answers.

Sets are the distinct 4-word shingles of a document, as 64-bit hashes; equal sets are one class, and a class's nodes in what
follows is one of its rows, by a 64-bit hash of id and text. Two classes link if 100 |A & B| >= 85 |A | B|. No link is lost:

1. Order. Frequent shingles come last, the more frequent the later; the others come first, by hash. Any order gives the
   same links; which shingles count as frequent is decided by counts over all sets, and the bar is raised until their
   table fits a fixed size. Only the shingles of least hash can come early, so only those are kept and counted; the few
   texts of which too many are frequent are read again. Linked sets of n and m >= n shingles share at least k = 1 + n // 40 of the first
   n - ceil(0.85 n) + k and m - ceil(0.85 m) + k.
2. Index lists of those prefix shingles, with skips. A list is sorted by set size and cut where neighbours are too different
   to link; each piece is sorted by the shingle's position in its sets and cut where neighbours are so far apart that
   what stands before it in the one set and behind it in the other can't be enough; then by size again. Sets in a block need
   no look at other blocks. Pairs of small blocks are skipped one by one by the same bounds; the others are counted, and a
   pair is a candidate if it meets in k lists; pairs that share a large block or a frequent shingle always are. Lists of
   frequent shingles are joined by bands of size.
3. Answers from a similar set. In each large block one set leads: the one with the fewest shingles before the listed
   one; of sets that met in small blocks, the least partner that they have in common.
   Every other set is compared with its leader only, which gives its link and its difference D from it.
   For two sets with the same leader, |A ^ B| = |Da ^ Db|, so their link follows from two small differences without
   the sets themselves. Those linked to the leader are connected already and are not compared with each other.
4. Members of a large group that don't link to their leader elect further leaders, in rounds: each member is compared with
   the new one by differences, and those that link to it leave the open ones. Members of earlier leaders that aren't connected
   with the new one are compared with its own only if they are near enough to it by the triangle inequality of Jaccard
   distances. Those still open when rounds don't help any more, and those of small groups, are compared with all members in
   cells of bounded size, by counting common entries of the differences; a cell returns a spanning forest of its links.
5. Components of the links, by repeated stars, in tables.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from folium.llm.shared import BROADCAST_ROWS, broadcast, kept, lean, rows_of, small, written
from folium.llm.wordbytes import SPACE, Words, chunks, mix

SHINGLE, PERCENT = 4, 85
#: Shingles with this count are frequent; doubled until at most FREQUENT_ROWS are.
FREQUENT, FREQUENT_ROWS = 8, 2_000_000
#: Pairs within pieces of at most so many sets are taken one by one.
SMALL = 8
#: Rows of lists that a Python worker takes at once, up to the end of a list.
ROWS = 400_000
#: Members of a group that are compared with each other in one cell: unlinked ones, by any. Groups with more cells than
#: CELLS elect further leaders, as long as a round closes a tenth of what is open.
CELL, CELLS = (128, 256), 8
#: Classes of more rows are joined to their rows by broadcast.
LARGE = 1_000


def sets_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text in a row, and where each text's begin."""
    words = Words(texts, SPACE)
    h, n = words.hashes(), np.diff(words.first)
    doc = words.doc()
    within = np.arange(len(h)) - words.first[:-1][doc]
    mixed = np.zeros(len(h), np.uint64)
    for k in range(SHINGLE):  # words beyond the end count as 0: only texts shorter than a shingle have such a shingle
        shifted = np.zeros(len(h), np.uint64)
        shifted[: max(0, len(h) - k)] = np.where(within[k:] >= k, h[k:], np.uint64(0)) if k else h
        mixed = mix(mixed * np.uint64(0xD1342543DE82EF95) + shifted)
    keep = within <= np.maximum(0, n[doc] - SHINGLE)
    doc, mixed = doc[keep], mixed[keep].view(np.int64)
    order = np.lexsort((mixed, doc))
    doc, mixed = doc[order], mixed[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (mixed[1:] != mixed[:-1])
    return mixed[new], np.searchsorted(doc[new], np.arange(len(texts) + 1))


def longs(values: np.ndarray, starts: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(starts, pa.int32()), pa.array(values, pa.int64()))


def need(n: np.ndarray | int) -> np.ndarray | int:
    """Least number of common shingles with a set of any size that links."""
    return (PERCENT * n + 99) // 100


def common(n: np.ndarray | int) -> np.ndarray | int:
    """Shingles that two sets which link share among the first reach(n) of each, where n is the smaller size."""
    return 1 + n // 40


def reach(n: np.ndarray | int) -> np.ndarray | int:
    return np.minimum(n, n - need(n) + common(n))


def heads(values: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Which of the values are among the first sizes[k] of set k."""
    n = np.diff(starts)
    return np.arange(len(values)) - np.repeat(starts[:-1], n) < np.repeat(sizes, n)


def _profile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of documents (count null): size, signature, and the shingles of least hash, some more than reach(n). And rows
    (token, count) of shingles that several different sets of a piece have."""
    for batch in batches:
        for at, texts in chunks(batch.column(1)):
            values, starts = sets_of(texts)
            n = np.diff(starts)
            total = np.zeros((2, len(values) + 1), np.uint64)
            np.cumsum(mix(values.view(np.uint64)), out=total[0, 1:])
            np.cumsum(mix(values.view(np.uint64) ^ np.uint64(0xA5A5A5A55A5A5A5A)), out=total[1, 1:])
            sig = (total[:, starts[1:]] - total[:, starts[:-1]]).view(np.int64)
            m = len(texts)
            kept = np.minimum(n, reach(n) + n // 16 + 4)
            low = longs(values[heads(values, starts, kept)], np.concatenate([[0], np.cumsum(kept)]))
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0).slice(at, m), "id": batch.column(2).slice(at, m), "n": n, "sig1": sig[0], "sig2": sig[1], "low": low, "count": pa.nulls(m, pa.int64())})
            _, once = np.unique(sig[0], return_index=True)
            different = np.zeros(m, bool)
            different[once] = True
            tokens, counts = np.unique(values[np.repeat(different, n)], return_counts=True)
            tokens, counts = tokens[counts > 1], counts[counts > 1]
            z = np.zeros(len(tokens), np.int64)
            yield pa.RecordBatch.from_pydict({"doc_id": tokens, "id": z, "n": z, "sig1": z, "sig2": z, "low": pa.nulls(len(z), pa.list_(pa.int64())), "count": counts})


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The values of a list column, and where each row's begin."""
    starts = column.offsets.to_numpy().astype(np.int64)
    return column.flatten().to_numpy(), starts - starts[0]


def _tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        tokens, counts = np.unique(_flat(batch.column(0))[0], return_counts=True)
        yield pa.RecordBatch.from_pydict({"token": tokens, "count": counts})


def _total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Frequent tokens of a partition that has all rows of its tokens."""
    got = list(batches)
    if got:
        rows = pa.Table.from_batches(got)
        tokens, at = np.unique(rows.column(0).to_numpy(), return_inverse=True)
        counts = np.bincount(at, rows.column(1).to_numpy()).astype(np.int64)
        yield pa.RecordBatch.from_pydict({"token": tokens[counts >= FREQUENT], "count": counts[counts >= FREQUENT]})


def frequent_shingles(local: DataFrame, low: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The frequent shingles in order of their hash, and each one's place by frequency, from 1.

    Counts are of those of least hash in all sets (low), from which the prefixes come; and of all shingles, as far as
    they are repeated within a piece (local).
    """
    schema = "token long, count long"
    exact = low.select("low").mapInArrow(lean(_tally), schema).repartition("token").mapInArrow(lean(_total), schema)
    local = local.groupBy(F.col("doc_id").alias("token")).agg(F.sum("count").alias("count")).filter(F.col("count") >= FREQUENT)
    sums = written(exact.unionByName(local).groupBy("token").agg(F.max("count").alias("count")), "jaccard-frequent")
    bar = FREQUENT
    while sums.filter(F.col("count") >= bar).count() > FREQUENT_ROWS:
        bar *= 2
    rows = sums.filter(F.col("count") >= bar).toArrow()
    tokens, count = rows.column(0).to_numpy(), rows.column(1).to_numpy()
    order = np.lexsort((tokens, count))
    place = np.empty(len(tokens), np.int32)
    place[order] = np.arange(1, len(tokens) + 1)
    by_hash = np.argsort(tokens)
    return tokens[by_hash], place[by_hash]


def first_shingles(values: np.ndarray, starts: np.ndarray, n: np.ndarray, frequent: tuple[np.ndarray, np.ndarray]) -> tuple[pa.Array, np.ndarray]:
    """The first reach(n) of each set in order, and how many of them aren't frequent. The values are those of least hash, or
    all; null where they don't reach."""
    tokens, place = frequent
    size = np.diff(starts)
    doc = np.repeat(np.arange(len(n)), size)
    rank = np.zeros(len(values), np.int32)
    if len(tokens):
        i = np.minimum(np.searchsorted(tokens, values), len(tokens) - 1)
        rank = np.where(tokens[i] == values, place[i], 0)
    rare = np.bincount(doc, rank == 0, len(n)).astype(np.int64)
    take = reach(n)
    short = (rare < take) & (size < n)
    order = np.lexsort((values, rank, doc))
    keep = heads(values, starts, np.where(short, 0, take))
    lists = longs(values[order][keep], np.concatenate([[0], np.cumsum(np.where(short, 0, take))]))
    if short.any():
        lists = pa.ListArray.from_arrays(lists.offsets, lists.values, mask=pa.array(short))
    return lists, np.minimum(rare, take)


PREFIXES = "doc_id long, n long, rare long, prefix array<long>"


def prefixes(docs: DataFrame, low: DataFrame, frequent) -> DataFrame:
    """(doc_id, n, rare, prefix): the first shingles of each set, of which `rare` aren't frequent."""

    def from_low(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.column(1).to_numpy()
            lists, rare = first_shingles(*_flat(batch.column(2)), n, frequent.value)
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0), "n": n, "rare": rare, "prefix": lists})

    def from_text(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, texts in chunks(batch.column(1)):
                values, starts = sets_of(texts)
                n = np.diff(starts)
                lists, rare = first_shingles(values, starts, n, frequent.value)
                yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0).slice(at, len(texts)), "n": n, "rare": rare, "prefix": lists})

    found = kept(low.select("doc_id", "n", "low").mapInArrow(lean(from_low), PREFIXES))
    short = small(found.filter("prefix IS NULL").select("doc_id"))
    return found.filter("prefix IS NOT NULL").unionByName(docs.join(short, "doc_id", "left_semi").mapInArrow(lean(from_text), PREFIXES))


def _lists(batches: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
    """Sorted rows as columns, at least ROWS at a time, and lists whole. A list of rare shingles is shorter than the bar for
    frequent ones, but for repeated rows."""
    held: list[list[np.ndarray]] = []
    size = 0
    for batch in batches:
        if batch.num_rows:
            held.append([c.to_numpy() for c in batch.columns])
            size += batch.num_rows
        if size >= ROWS:
            rows = [np.concatenate(c) for c in zip(*held, strict=True)]
            end = int(np.searchsorted(rows[0], rows[0][-1]))
            if end:
                yield [c[:end] for c in rows]
            held, size = [[c[end:] for c in rows]], len(rows[0]) - end
    if size:
        yield [np.concatenate(c) for c in zip(*held, strict=True)]


def required(n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Least number of common shingles of sets of n and m that link."""
    return -(-PERCENT * (n + m) // (100 + PERCENT))


def may_link(n: np.ndarray, i: np.ndarray, m: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Whether sets of n and m shingles can link that have a common one at places i and j: what they share besides stands
    before it in both, or behind it in both."""
    return np.minimum(i, j) + 1 + np.minimum(n - i, m - j) - 1 >= required(n, m)


def blocks_of(token: np.ndarray, n: np.ndarray, pos: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order of the rows, which come by token and n, and the number of each one's block in that order."""
    cut = np.ones(len(token), bool)
    cut[1:] = (token[1:] != token[:-1]) | (100 * n[:-1] < PERCENT * n[1:])
    order, piece = np.arange(len(token)), np.cumsum(cut) - 1
    # by position: of sizes from a to b, sets at distance d share at most b - d, and need as many as two of sizes a and b do
    first = np.flatnonzero(cut)
    last = np.append(first[1:], len(token)) - 1
    reach_ = (n[last] - required(n[first], n[last]))[piece]
    order = np.lexsort((pos, piece))
    cut = np.ones(len(token), bool)
    cut[1:] = (piece[order][1:] != piece[order][:-1]) | (pos[order][1:] - pos[order][:-1] > reach_[order][1:])
    piece_of = np.empty(len(token), np.int64)
    piece_of[order] = np.cumsum(cut) - 1
    order = np.lexsort((n, piece_of))
    piece = piece_of[order]
    cut = np.ones(len(token), bool)
    cut[1:] = (piece[1:] != piece[:-1]) | (100 * n[order][:-1] < PERCENT * n[order][1:])
    return order, np.cumsum(cut) - 1


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Over all lists of a partition, from (token, doc_id, n, pos) by token and n: rows (doc_id, leader, shared, least).

    Pairs of a small block with the number of lists where they meet, and how many they need; or with null, members of a
    large block and its leader.
    """
    for token, doc, n, pos in _lists(batches):
        order, piece = blocks_of(token, n, pos)
        doc, n, pos = doc[order], n[order], pos[order]
        size = np.bincount(piece)[piece]
        order = np.lexsort((doc, pos, piece))
        first = order[np.flatnonzero(np.diff(piece[order], prepend=-1))][piece]
        star = (size > SMALL) & (doc != doc[first])
        pairs = [np.empty((0, 3), np.int64)]
        at = np.flatnonzero((size > 1) & (size <= SMALL))
        for k in range(1, SMALL):
            at = at[at + k < len(piece)]
            at = at[piece[at] == piece[at + k]]
            x, y = at, at + k
            keep = (100 * n[x] >= PERCENT * n[y]) & (doc[x] != doc[y]) & may_link(n[x], pos[x], n[y], pos[y])
            x, y = x[keep], y[keep]
            pairs.append(np.stack([np.maximum(doc[x], doc[y]), np.minimum(doc[x], doc[y]), common(n[x])], 1))
        found, shared = np.unique(np.concatenate(pairs), axis=0, return_counts=True)
        yield pa.RecordBatch.from_pydict({"doc_id": found[:, 0], "leader": found[:, 1], "shared": shared, "least": found[:, 2]})
        led = np.unique(np.stack([doc[star], doc[first[star]]], 1), axis=0)
        none = pa.nulls(len(led), pa.int64())
        yield pa.RecordBatch.from_pydict({"doc_id": led[:, 0], "leader": led[:, 1], "shared": none, "least": none})


def pairs_to_compare(postings: DataFrame) -> DataFrame:
    """(doc_id, leader), each once, from rows (token, doc_id, n, pos, rare).

    Of pairs that met in small pieces, one is left out if both have the same least partner: both are in its group then.
    """
    plain = postings.filter("rare").select("token", "doc_id", "n", "pos").repartition("token").sortWithinPartitions("token", "n").mapInArrow(lean(_meet), "doc_id long, leader long, shared long, least long")
    plain = kept(plain)
    pairs = plain.filter("shared IS NOT NULL").groupBy("doc_id", "leader").agg(F.sum("shared").alias("shared"), F.max("least").alias("least"))
    pairs = written(pairs.filter("shared >= least").select("doc_id", "leader"), "jaccard-met")
    least = small(written(pairs.groupBy("doc_id").agg(F.min("leader").alias("m")), "jaccard-least"))
    pairs = pairs.join(least, "doc_id").join(least.select(F.col("doc_id").alias("leader"), F.col("m").alias("of_leader")), "leader", "left")
    pairs = pairs.filter("leader = m OR of_leader IS NULL OR of_leader <> m").select("doc_id", "leader")
    band = F.floor(F.log(F.col("n").cast("double")) / -np.log(PERCENT / 100 - 0.001)).cast("int")
    hot = postings.filter("NOT rare").select("token", F.explode(F.array(band, band + 1)).alias("band"), "doc_id", "n", "pos")
    leaders = hot.groupBy("token", "band").agg(F.min(F.struct("pos", "doc_id")).alias("lead"), F.count("*").alias("size")).filter("size > 1")
    leaders = small(written(leaders.select("token", "band", F.col("lead.doc_id").alias("leader")), "jaccard-leaders"))
    hot = hot.join(leaders, ["token", "band"]).filter("doc_id <> leader")
    return pairs.unionByName(plain.filter("shared IS NULL").select("doc_id", "leader")).unionByName(hot.select("doc_id", "leader")).distinct()


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at, texts in chunks(batch.column(1)):
            values, starts = sets_of(texts)
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0).slice(at, len(texts)), "set": longs(values, starts)})


def links(apart: np.ndarray, n: np.ndarray) -> np.ndarray:
    """From the size of the symmetric difference and the sum of sizes."""
    return 100 * (n - apart) >= PERCENT * (n + apart)


def _differences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From (doc_id, leader, set, lead_set): (leader, doc_id, n, linked, diff)."""
    for batch in batches:
        a, b = batch.column(2), batch.column(3)
        diffs, n, m = [], [], []
        for k in range(batch.num_rows):
            x, y = a[k].values.to_numpy(), b[k].values.to_numpy()
            diffs.append(np.setxor1d(x, y, assume_unique=True))
            n.append(len(x))
            m.append(len(y))
        sizes = np.array([len(d) for d in diffs])
        yield pa.RecordBatch.from_pydict({
            "leader": batch.column(1), "doc_id": batch.column(0), "n": pa.array(n, pa.int64()), "linked": links(sizes, np.array(n) + np.array(m)),
            "diff": longs(np.concatenate([*diffs, np.empty(0, np.int64)]), np.concatenate([[0], np.cumsum(sizes)])),
        })


def _cell(group: pa.Table) -> pa.Table:
    """The links of members to be compared (mine) with members of their cell (other) as a spanning forest. Members with the
    same label are connected already."""
    ids, n, label, mine, other = (group.column(c).to_numpy() for c in ("doc_id", "n", "label", "mine", "other"))
    diff = group.column("diff").combine_chunks()
    diff = diff.chunk(0) if isinstance(diff, pa.ChunkedArray) else diff
    starts = diff.offsets.to_numpy() - diff.offsets[0].as_py()
    values, sizes = diff.flatten().to_numpy(), np.diff(starts)
    _, token = np.unique(values, return_inverse=True)
    rows = np.repeat(np.arange(len(ids)), sizes)
    order = np.argsort(token, kind="stable")
    where = np.searchsorted(token[order], np.arange(token.max() + 2 if len(token) else 1))
    lists = rows[order]
    labels, of = np.unique(label, return_inverse=True)
    parent = np.arange(len(ids) + len(labels))  # the last stand for the labels

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = i = parent[parent[i]]
        return i

    parent[: len(ids)] = len(ids) + of
    found = []
    for u in np.flatnonzero(mine):
        common = np.bincount(np.concatenate([lists[where[t] : where[t + 1]] for t in token[starts[u] : starts[u + 1]]] or [np.empty(0, np.int64)]), minlength=len(ids))
        for v in np.flatnonzero(links(sizes[u] + sizes - 2 * common, n[u] + n) & other & (ids != ids[u])):
            if (x := root(u)) != (y := root(v)):
                parent[min(x, y)] = max(x, y)
                found.append((ids[u], ids[v]))
    a, b = zip(*found, strict=True) if found else ((), ())
    return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})


def _nearness(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From (grp, doc_id, n, diff, label, p, p_n, p_diff, row): whether each links to the new leader p, and whether one that links to p
    may link to it: Jaccard distances are a metric, so not if it is farther than twice the bound."""
    for batch in batches:
        a, b = batch.column(3), batch.column(7)
        apart = np.array([len(np.setxor1d(a[k].values.to_numpy(), b[k].values.to_numpy(), assume_unique=True)) for k in range(batch.num_rows)], np.int64)
        both = batch.column(2).to_numpy() + batch.column(6).to_numpy()
        near = 200 * apart <= 2 * (100 - PERCENT) * (both + apart)  # apart over the union, (both + apart) / 2
        yield pa.RecordBatch.from_pydict({"grp": batch.column(0), "doc_id": batch.column(1), "n": batch.column(2), "diff": batch.column(3), "label": batch.column(4), "p": batch.column(5), "is_p": links(apart, both), "near": near, "row": batch.column(8)})


MEMBERS = "grp long, doc_id long, n long, diff array<long>, label long"


def in_cells(members: DataFrame) -> DataFrame:
    """Links between members that are to be compared (row) and any others of their group (col)."""
    far, all_ = CELL
    counts = members.groupBy("grp").agg(F.count_if("col").alias("cols"), F.count_if("row").alias("rows")).filter("rows > 0 AND cols > 0")
    counts = written(counts.select("grp", F.ceil(F.col("rows") / far).cast("int").alias("rows"), F.ceil(F.col("cols") / all_).cast("int").alias("cols")), "jaccard-cells")
    df = members.withColumnsRenamed({"row": "is_row", "col": "is_col"}).join(small(counts), "grp")
    df = df.withColumn("own_row", F.expr("IF(is_row, CAST(pmod(xxhash64(doc_id), rows) AS int), NULL)")).withColumn("own_col", F.expr("IF(is_col, CAST(pmod(xxhash64(doc_id, 1), cols) AS int), NULL)"))
    as_row = df.filter("is_row").withColumn("row", F.col("own_row")).withColumn("col", F.explode(F.expr("sequence(0, cols - 1)")))
    as_row = as_row.withColumn("mine", F.lit(True)).withColumn("other", F.expr("coalesce(own_col = col, false)"))
    as_col = df.filter("is_col").withColumn("col", F.col("own_col")).withColumn("row", F.explode(F.expr("sequence(0, rows - 1)")))
    as_col = as_col.filter("own_row IS NULL OR own_row <> row").withColumn("mine", F.lit(False)).withColumn("other", F.lit(True))
    cells = as_row.unionByName(as_col).select("grp", "row", "col", "doc_id", "n", "label", "diff", "mine", "other")
    return cells.groupBy("grp", "row", "col").applyInArrow(_cell, "a long, b long")


def links_within(differences: DataFrame) -> DataFrame:
    """Links (a, b) between members of one leader's group, of which at least one doesn't link to the leader."""
    far, all_ = CELL
    counts = differences.groupBy("leader").agg(F.count("*").alias("members"), F.count_if(~F.col("linked")).alias("far"))
    counts = written(counts.filter("far > 0 AND members > 1").withColumn("many", F.expr(f"ceil(far / {far}) * ceil(members / {all_}) > {CELLS}")), "jaccard-groups")
    df = differences.join(small(counts.select("leader", "many"), of=counts), "leader")
    df = df.select(F.col("leader").alias("grp"), "doc_id", "n", "diff", F.expr("IF(linked, leader, doc_id)").alias("label"), F.expr("NOT linked").alias("row"), F.lit(True).alias("col"), "many")
    if rows_of(counts) == 0 or counts.filter("many").isEmpty():
        return in_cells(df.drop("many"))
    members, edges, cross, before, k = written(df.filter("many").drop("many", "col"), "jaccard-members"), [], [], None, 0
    while True:  # row: open
        open_ = members.filter("row").groupBy("grp").agg(F.min_by(F.struct("doc_id", "n", "diff"), F.xxhash64("doc_id", F.lit(k))).alias("p"))
        pivots = written(open_.selectExpr("grp", "p.doc_id AS p", "p.n AS p_n", "p.diff AS p_diff"), "jaccard-pivots")
        left = members.agg(F.count_if("row")).first()[0]
        if not left or before is not None and 10 * left > 9 * before:
            break
        before, k = left, k + 1
        near = members.join(small(pivots, CELLS * far), "grp").select("grp", "doc_id", "n", "diff", "label", "p", "p_n", "p_diff", "row")
        near = written(near.mapInArrow(lean(_nearness), MEMBERS + ", p long, is_p boolean, near boolean, row boolean"), "jaccard-near")
        edges.append(near.filter("is_p AND doc_id <> p").select(F.col("doc_id").alias("a"), F.col("p").alias("b")))
        # balls of earlier leaders with a member that links to the new one are connected with it; the others' near members are compared
        touched = small(written(near.filter("is_p AND NOT row").select("grp", F.col("label").alias("t")).distinct(), "jaccard-touched"))
        apart = near.filter("near AND NOT row AND NOT is_p").join(touched, (near["grp"] == touched["grp"]) & (F.col("label") == F.col("t")), "left_anti")
        both = apart.select("p", "doc_id", "n", "diff", "label", F.lit(False).alias("row"), F.lit(True).alias("col")).unionByName(near.filter("is_p AND row").select("p", "doc_id", "n", "diff", F.col("p").alias("label"), F.lit(True).alias("row"), F.lit(False).alias("col")))
        cross.append(both.withColumnRenamed("p", "grp"))
        stay = members.join(small(pivots.select("grp"), of=pivots), "grp", "left_anti").unionByName(near.select("grp", "doc_id", "n", "diff", F.expr("IF(is_p AND row, p, label)").alias("label"), F.expr("row AND NOT is_p").alias("row")))
        members = written(stay, "jaccard-members")
    cross = written(reduce(DataFrame.unionByName, cross), "jaccard-cross")
    rest = members.withColumn("col", F.lit(True)).unionByName(df.filter("NOT many").drop("many"))
    return reduce(DataFrame.unionByName, [in_cells(rest), in_cells(cross), *edges])


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges (a, b) of a batch as stars: each id with the least that it reaches by the batch's edges."""
    for batch in batches:
        a, b = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        ids, at = np.unique(np.concatenate([a, b]), return_inverse=True)
        x, y, least = at[: len(a)], at[len(a) :], np.arange(len(ids))
        while True:
            both = np.minimum(least[x], least[y])
            new = least.copy()
            np.minimum.at(new, x, both)
            np.minimum.at(new, y, both)
            new = np.minimum(new, new[new])
            if (new == least).all():
                break
            least = new
        far = least != np.arange(len(ids))
        yield pa.RecordBatch.from_pydict({"a": ids[far], "b": ids[least[far]]})


def components(edges: DataFrame) -> DataFrame:
    """(id, component): the least id that each id of edges (a, b) reaches. Large and small stars in turn until stable; what a
    batch of edges tells alone is solved first."""
    edges = edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).mapInArrow(lean(_stars), "a long, b long").distinct()
    edges, seen = written(edges, "components"), None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small_ = large.join(least, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.withColumnRenamed("m", "b")).distinct()
        told = Observation()
        edges = written(small_.observe(told, F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("sum")), "components")
        if (state := told.get) == seen:
            return edges.select(F.col("a").alias("id"), F.col("b").alias("component")).unionByName(edges.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct())
        seen = state


def grouped(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of docs (doc_id, text): a row (node, doc_id, n, sig1, sig2) for each of theirs; and for classes (sig1, sig2) of several rows,
    or which link to others, their component's first: a struct (no_id, doc_id, node), the least of its rows."""
    spark: SparkSession = docs.sparkSession
    docs = docs.select(F.xxhash64("doc_id", "text").alias("doc_id"), "text", F.col("doc_id").alias("id"))
    profile = kept(docs.mapInArrow(lean(_profile), "doc_id long, id long, n long, sig1 long, sig2 long, low array<long>, count long"))
    sizes = profile.filter("count IS NULL").select(F.col("doc_id").alias("node"), F.col("id").alias("doc_id"), "n", "sig1", "sig2")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "node")).alias("first")
    classes = written(sizes.filter("n > 0").groupBy("sig1", "sig2").agg(F.min("node").alias("rep"), first, F.count("*").alias("rows")), "jaccard-classes")
    copies = written(with_classes(sizes, written(classes.filter("rows > 1").select("sig1", "sig2", "rep", "rows"), "jaccard-several")).filter("node <> rep").select("node"), "jaccard-copies")
    low = profile.filter("count IS NULL AND n > 0").join(small(copies), F.col("doc_id") == F.col("node"), "left_anti").select("doc_id", "n", "low")
    frequent = broadcast(spark, frequent_shingles(profile.filter("count IS NOT NULL").select("doc_id", "count"), low))
    docs = docs.select("doc_id", "text")
    postings = prefixes(docs, low, frequent)
    postings = postings.select("doc_id", "n", F.col("rare").alias("m"), F.posexplode("prefix").alias("pos", "token")).withColumn("rare", F.col("pos") < F.col("m"))
    pairs = written(pairs_to_compare(postings.withColumn("pos", F.col("pos").cast("long"))), "jaccard-pairs")
    ids = written(pairs.select("doc_id").unionByName(pairs.select(F.col("leader").alias("doc_id"))).distinct(), "jaccard-ids")
    sets = kept(docs.join(small(ids), "doc_id", "left_semi").mapInArrow(lean(_sets), "doc_id long, set array<long>"))
    both = pairs.join(sets, "doc_id").join(sets.select(F.col("doc_id").alias("leader"), F.col("set").alias("lead_set")), "leader")
    differences = both.select("doc_id", "leader", "set", "lead_set").mapInArrow(lean(_differences), "leader long, doc_id long, n long, linked boolean, diff array<long>")
    differences = kept(differences)
    edges = differences.filter("linked").select(F.col("doc_id").alias("a"), F.col("leader").alias("b")).unionByName(links_within(differences))
    found = classes.join(components(edges), F.col("rep") == F.col("id"), "left").filter("rows > 1 OR id IS NOT NULL").withColumn("component", F.coalesce("component", "rep"))
    found = written(found, "jaccard-found")
    of = found.groupBy("component").agg(F.min("first").alias("first"))
    return sizes, written(found.drop("first").join(of, "component").select("sig1", "sig2", "first", "rows"), "jaccard-firsts")


def with_classes(sizes: DataFrame, classes: DataFrame) -> DataFrame:
    """sizes joined to classes by signature; those of classes with more than LARGE rows, of which there are few, by broadcast."""
    key, many = ["sig1", "sig2"], classes.filter(F.col("rows") > LARGE).drop("rows")
    n = rows_of(classes)
    if (classes.limit(BROADCAST_ROWS + 1).count() if n is None else n) <= BROADCAST_ROWS:
        return sizes.join(F.broadcast(classes.drop("rows")), key)
    rest = sizes.join(small(many.select(*key)), key, "left_anti").join(classes.filter(F.col("rows") <= LARGE).drop("rows"), key)
    return sizes.join(small(many), key).unionByName(rest)


def _prepared(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def join(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, n_shingles, component_id.

    Null texts and texts without words have no shingles and are components of their own; a text of fewer than 4 words has
    one shingle, all of its words. Every row is a document: rows of equal doc_id and other texts aren't linked by that,
    identical repeated rows are returned as often and change nothing, and rows without doc_id are linked as others are; the
    component_id is the least doc_id in reach, null if no document in reach has one. Ties of size or position are
    in one block or list. Texts of any length are taken whole. An empty table gives an empty result. Columns other than
    doc_id and text aren't read.
    """
    sizes, firsts = grouped(_prepared(docs))
    key = ["sig1", "sig2"]
    plain = sizes.join(small(firsts.select(*key), of=firsts), key, "left_anti").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return plain.unionByName(with_classes(sizes, firsts).select("doc_id", F.col("n").alias("n_shingles"), F.col("first.doc_id").alias("component_id")))


def one_of_each(docs: DataFrame) -> DataFrame:
    """The rows of docs, with all their columns, but for all but the first of each component: that of least doc_id, rows without
    one last. Of identical repeated rows one stays. Otherwise as join()."""
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.xxhash64(F.col("doc_id").cast("long"), F.col("text").cast("string")).alias("node"))
    sizes, firsts = grouped(_prepared(docs))
    gone = with_classes(sizes, firsts).filter("node <> first.node").select("node")
    once = with_classes(sizes, firsts).filter("node = first.node").groupBy("node").count().filter("count > 1").select("node")
    gone, once = small(written(gone, "jaccard-gone")), small(written(once, "jaccard-repeated"))
    stay = rows.join(gone, "node", "left_anti")
    repeated = stay.join(once, "node", "left_semi").groupBy("node").agg(F.first("row").alias("row"))
    return stay.join(once, "node", "left_anti").select("row.*").unionByName(repeated.select("row.*"))
