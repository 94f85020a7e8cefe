"""Exact Jaccard self-join of shingle sets by a token-group matrix."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tablewright.llm.components import components
from tablewright.llm.shared import chunks, materialise, mix, release, released, shingles, small, whole_texts

THRESHOLD = 75
CHUNK = 1 << 20
BUCKET_TEXT = 8 << 20
"""Bytes of text whose shingles meet in one bucket of the counting stage, on average."""
BUCKET_DOCS = 100_000
"""Documents whose counts from all buckets are summed by one task, on average."""
CELL_TOKENS = 200_000
"""Tokens of the sets held in one cell: a group or a part of it that one task compares."""
CELL_QUERIES = 1_000


def need(n: np.ndarray | int, threshold: int) -> np.ndarray | int:
    """Tokens that a set of n tokens must share with any set that it links to."""
    return -(-threshold * n // 100)


def _sets(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, shingle) sorted, each shingle once per row."""
    row, hashes = shingles(data, offsets)
    order = np.lexsort((hashes.view(np.int64), row))
    row, hashes = row[order], hashes[order].view(np.int64)
    first = np.ones(len(row), bool)
    first[1:] = (row[1:] != row[:-1]) | (hashes[1:] != hashes[:-1])
    return row[first], hashes[first]


def shared_counts(rows: DataFrame, bucket_text: int = BUCKET_TEXT) -> DataFrame:
    """``_id``, ``n`` (distinct shingles) and ``c``, an upper bound of those that another document has too.

    Shingles go to buckets by hash; a chunk of documents sends each of its distinct shingles once, with
    its document or, if several have it, as common, so a shingle of all documents costs a bucket one
    entry per chunk. Entries are 32 bits beside the bucket's, so ``c`` may count too many, never too few.
    A bucket sends its documents' counts packed, by a hash of the identifier, and they are summed there.
    """
    total, number = rows.agg(F.coalesce(F.sum(F.octet_length("_text")), F.lit(0)), F.count("*")).first()
    buckets, places = max(16, -(-total // bucket_text)), max(1, -(-number // BUCKET_DOCS))

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["bucket", "kind", "a", "b", "c"]
        for ids, data, offsets in chunks(batches, CHUNK):
            ids = ids.to_numpy(zero_copy_only=False).astype(np.int64)
            row, hashes = _sets(data, offsets)
            order = np.argsort(hashes, kind="stable")
            ordered = hashes[order]
            edge = np.ones(len(ordered), bool)
            edge[1:] = ordered[1:] != ordered[:-1]
            size = np.diff(np.append(np.flatnonzero(edge), len(ordered)))
            common = np.zeros(len(row), bool)
            common[order] = np.repeat(size > 1, size)
            n = np.bincount(row, minlength=len(ids)).astype(np.int64)
            local = np.bincount(row[common], minlength=len(ids)).astype(np.int64)
            yield pa.record_batch([pa.array([int(ids[0]) % buckets]), pa.array([0]), pa.array([ids.tobytes()]), pa.array([n.tobytes()]), pa.array([local.tobytes()])], names=names)
            # each distinct shingle once: of one document, or common
            single, shared = np.flatnonzero(~common), ordered[edge][size > 1]
            out: dict[str, list] = {k: [] for k in names}
            bucket, low = _places(hashes[single], buckets)
            order = np.lexsort((row[single], bucket))
            bucket, low, owner = bucket[order], low[order], ids[row[single][order]]
            cut = np.searchsorted(bucket, np.arange(buckets + 1))
            more_bucket, more_low = _places(shared, buckets)
            order = np.argsort(more_bucket, kind="stable")
            more_low = more_low[order]
            more = np.searchsorted(more_bucket[order], np.arange(buckets + 1))
            for b in range(buckets):
                own = owner[cut[b] : cut[b + 1]]
                starts = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]])) if len(own) else np.zeros(0, np.int64)
                runs = np.column_stack([np.diff(own[starts], prepend=0), np.diff(np.append(starts, len(own)))]) if len(own) else np.zeros((0, 2), np.int64)
                if len(own) or more[b + 1] > more[b]:
                    for name, value in zip(names, (b, 1, low[cut[b] : cut[b + 1]].tobytes(), runs.astype(np.int64).T.tobytes(), more_low[more[b] : more[b + 1]].tobytes()), strict=True):
                        out[name].append(value)
            yield pa.record_batch([pa.array(out["bucket"], pa.int64()), pa.array(out["kind"], pa.int64()), *(pa.array(out[k], pa.binary()) for k in "abc")], names=names)

    def meet(table: pa.Table) -> pa.Table:
        ids, n, c = [], [], []
        lows, owners, commons = [np.zeros(0, np.uint32)], [np.zeros(0, np.int64)], [np.zeros(0, np.uint32)]
        for kind, x, y, z in zip(*(table.column(k).to_pylist() for k in ("kind", "a", "b", "c")), strict=True):
            if kind == 0:
                ids.append(np.frombuffer(x, np.int64))
                n.append(np.frombuffer(y, np.int64))
                c.append(np.frombuffer(z, np.int64))
            else:
                runs = np.frombuffer(y, np.int64).reshape(2, -1)
                lows.append(np.frombuffer(x, np.uint32))
                owners.append(np.repeat(np.cumsum(runs[0]), runs[1]))
                commons.append(np.frombuffer(z, np.uint32))
        low, owner, common = np.concatenate(lows), np.concatenate(owners), np.unique(np.concatenate(commons))
        order = np.argsort(low, kind="stable")
        low, owner = low[order], owner[order]
        same = low[1:] == low[:-1]
        twice = np.zeros(len(low), bool)
        twice[1:] |= same
        twice[:-1] |= same
        if len(common):
            spot = np.minimum(np.searchsorted(common, low), len(common) - 1)
            twice |= common[spot] == low
        who, count = np.unique(owner[twice], return_counts=True)
        ids.append(who)
        n.append(np.zeros(len(who), np.int64))
        c.append(count.astype(np.int64))
        ids, n, c = np.concatenate(ids), np.concatenate(n), np.concatenate(c)
        place = (mix(ids.view(np.uint64)) % np.uint64(places)).astype(np.int64)
        order = np.argsort(place, kind="stable")
        cut = np.searchsorted(place[order], np.arange(places + 1))
        parts = [order[x:y] for x, y in zip(cut, cut[1:], strict=False)]
        filled = [k for k, at in enumerate(parts) if len(at)]
        pack = lambda values: pa.array([values[parts[k]].tobytes() for k in filled], pa.binary())
        packed = pa.table({"place": pa.array(filled, pa.int64()), "ids": pack(ids), "n": pack(n), "c": pack(c)})
        del table, low, owner, common, lows, owners, commons, order, same, twice
        release()
        return packed

    def total_of(table: pa.Table) -> pa.Table:
        ids, n, c = (np.concatenate([np.frombuffer(x, np.int64) for x in table.column(k).to_pylist()]) for k in ("ids", "n", "c"))
        known, at = np.unique(ids, return_inverse=True)
        most = np.zeros(len(known), np.int64)
        np.maximum.at(most, at, n)
        return pa.table({"_id": known, "n": most, "c": np.bincount(at, weights=c, minlength=len(known)).astype(np.int64)})

    sent = rows.mapInArrow(released(emit), "bucket long, kind long, a binary, b binary, c binary")
    met = sent.groupBy("bucket").applyInArrow(meet, "place long, ids binary, n binary, c binary")
    return met.groupBy("place").applyInArrow(total_of, "_id long, n long, c long")


def _places(hashes: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    own = hashes.view(np.uint64)
    return ((own >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64), own.astype(np.uint32)


def shingle_sets(rows: DataFrame, tokens: bool) -> DataFrame:
    """``_id``, ``rid`` (64 bits of the set's digest) and, if wanted, ``toks`` (sorted shingles)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, data, offsets in chunks(batches):
            row, hashes = _sets(data, offsets)
            cut = np.searchsorted(row, np.arange(len(ids) + 1)).astype(np.int32)
            rid = [int.from_bytes(hashlib.md5(hashes[a:b].tobytes()).digest()[:8], "little", signed=True) for a, b in zip(cut, cut[1:], strict=False)]
            columns = [ids, pa.array(rid, pa.int64())]
            if tokens:
                columns.append(pa.ListArray.from_arrays(pa.array(cut), pa.array(hashes)))
            yield pa.record_batch(columns, names=["_id", "rid", "toks"][: len(columns)])

    return rows.mapInArrow(released(work), "_id long, rid long" + ", toks array<long>" * tokens)


def need_above(n: np.ndarray | int, threshold: int) -> np.ndarray | int:
    """Tokens that a set of n tokens must share with a set of as many or more that it links to."""
    return -(-2 * threshold * n // (100 + threshold))


class Cell:
    """The sets of one cell with their token union."""

    def __init__(self, tokens: np.ndarray, offsets: np.ndarray):
        self.union, self.place = np.unique(tokens, return_inverse=True)
        self.offsets = offsets
        self.sizes = np.diff(offsets)
        self.mark = np.zeros(len(self.union), bool)

    def linked(self, query: np.ndarray, threshold: int, among: np.ndarray, above: bool = False) -> np.ndarray:
        """Which of the members ``among`` (``above``: of those not smaller) link to ``query``; the cell opens only if its union holds enough of it."""
        if not len(self.union) or not len(among):
            return among[:0]
        spot = np.minimum(np.searchsorted(self.union, query), len(self.union) - 1)
        spot = spot[self.union[spot] == query]
        if len(spot) < (need_above if above else need)(len(query), threshold):
            return among[:0]
        if above:
            among = among[self.sizes[among] >= len(query)]
        sizes = self.sizes[among]
        among = among[(100 * sizes >= threshold * len(query)) & (100 * len(query) >= threshold * sizes)]
        if not len(among):
            return among
        self.mark[spot] = True
        if 4 * len(among) > len(self.sizes):
            both = np.add.reduceat(self.mark[self.place], self.offsets[:-1])[among]
        else:
            both = np.array([int(self.mark[self.place[self.offsets[m] : self.offsets[m + 1]]].sum()) for m in among])
        self.mark[spot] = False
        return among[100 * both >= threshold * (len(query) + self.sizes[among] - both)]

    def own_components(self, threshold: int) -> np.ndarray:
        """The first member of each member's component; a member met is never compared again."""
        label = np.full(len(self.sizes), -1)
        while (left := np.flatnonzero(label < 0)).size:
            root = left[0]
            label[root] = root
            todo = [root]
            while todo:
                m = todo.pop()
                found = self.linked(self.union[self.place[self.offsets[m] : self.offsets[m + 1]]], threshold, np.flatnonzero(label < 0))
                label[found] = root
                todo.extend(found.tolist())
        return label


def _lists(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    whole = column.combine_chunks()
    if isinstance(whole, pa.ChunkedArray):
        whole = whole.chunk(0) if whole.num_chunks else pa.array([], whole.type)
    sizes = np.diff(whole.offsets.to_numpy())
    return whole.flatten().to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(sizes)])


def group(sets: DataFrame, threshold: int, cell_tokens: int) -> DataFrame:
    """Distinct sets with ``block``, the smallest ``rid`` of the group of linked sets found within their cell.

    Sets of the same smallest shingle, mostly near copies, meet in a cell; where they are too many for
    one, they are dealt to several by hash.
    """
    keyed = sets.withColumn("_key", F.col("toks")[0])
    hot = small(keyed.groupBy("_key").agg(F.ceil(F.sum("n") / cell_tokens).alias("_fan")).filter("_fan > 1"), "fans")
    celled = keyed.join(hot, "_key", "left").withColumn("_part", F.pmod(F.hash("rid"), F.coalesce("_fan", F.lit(1))))

    def work(table: pa.Table) -> pa.Table:
        tokens, offsets = _lists(table.column("toks"))
        rid = table.column("rid").to_numpy()
        label = Cell(tokens, offsets).own_components(threshold)
        least = np.full(len(rid), np.iinfo(np.int64).max)
        np.minimum.at(least, label, rid)
        return table.select(["rid", "_id", "n", "toks"]).append_column("block", pa.array(least[label]))

    return celled.select("_key", "_part", "rid", "_id", "n", "toks").groupBy("_key", "_part").applyInArrow(work, "rid long, _id long, n long, toks array<long>, block long")


def prefixes(sets: DataFrame, threshold: int) -> DataFrame:
    """The rarest shared tokens of each set: ``rid``, ``n``, ``t``, ``c`` (its tokens that lie in several blocks) and ``r`` (place of ``t`` among these).

    Tokens are ordered by the blocks they lie in, once and for all rounds; one that lies in a single block can't be common to sets of
    two. Of two linked sets, the rarest common token is among the c - need + 1 first of each, with ``need`` the least overlap
    that the set's size allows. So tokens past that place, like those of a passage of many documents, are never looked up; sets
    with less than ``need`` such tokens link to no other block and have no rows.
    """
    tokens = sets.select("rid", "block", "n", F.explode("toks").alias("t"))
    wide = tokens.groupBy("t", "block").agg(F.lit(1).alias("_one")).groupBy("t").agg(F.count("*").alias("k")).filter("k > 1")
    own = Window.partitionBy("rid")
    placed = tokens.join(wide, "t").withColumn("c", F.count("*").over(own)).withColumn("r", F.row_number().over(own.orderBy("k", "t")))
    return placed.filter(F.col("r") <= F.col("c") - F.ceil(F.col("n") * threshold / 100) + 1).select("rid", "n", "t", "r", "c")


def link_round(sets: DataFrame, labels: DataFrame, prefix: DataFrame, pivots: bool, threshold: int, cell_tokens: int, cell_queries: int, largest: bool = False) -> DataFrame:
    """Links (``a``, ``b``) between blocks, at least one for each pair of blocks that a query set and a member link.

    ``sets`` have the tokens, ``labels`` the present blocks; the queries are the sets whose ``pivot`` is ``pivots``. With
    ``largest``, each token looked up leads to its largest block alone: not all links are found, but near copies in
    great number, that begin as many blocks, become one with a few lookups each, before all pairs of blocks are asked for.

    The token-group matrix has a row (token, block) for each token of the union of a block's prefixes. The smaller set of a link asks
    for the other, by the tokens of its own, shorter prefix (``need_above``). A row counts for a query if its block has sets
    of a size that can link, and if the query and a member have enough tokens from there on. A block found that way
    opens, cell by cell, if the union of the cell holds ``need_above`` tokens of the query.
    """
    here = prefix.join(labels.select("rid", "block", "pivot"), "rid")
    overlap = lambda other: F.ceil((F.col("n") + other) * threshold / (100 + threshold))
    asked = here.filter(F.col("pivot") == pivots)
    if not largest:
        asked = asked.filter(F.col("r") <= F.col("c") - overlap(F.col("n")) + 1)
    down = F.ceil(F.col("n") * threshold / 100) if largest else F.col("n")
    asked = asked.select("t", "rid", "n", F.col("block").alias("a"), down.alias("down"), F.floor(F.col("n") * 100 / threshold).alias("up"), (F.col("c") - F.col("r") + 1).alias("rest"))
    met = here.groupBy("t", F.col("block").alias("b")).agg(F.min("n").alias("lo"), F.max("n").alias("hi"), F.max(F.col("c") - F.col("r") + 1).alias("held"))
    if largest:
        sizes = labels.groupBy(F.col("block").alias("b")).agg(F.count("*").alias("_m"))
        met = met.join(sizes, "b").groupBy("t").agg(F.max_by("b", F.struct("_m", "b")).alias("b"), F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.max("held").alias("held"))
    enough = F.least("rest", "held") >= overlap(F.greatest("lo", "down"))
    pairs = materialise(asked.join(met, "t").filter("a <> b AND hi >= down AND lo <= up").filter(enough).select("rid", "b").distinct(), "pairs")

    wanted = pairs.groupBy("b").agg(F.ceil(F.count("*") / cell_queries).alias("_ways"))
    fans = labels.groupBy("block").agg(F.ceil(F.sum("n") / cell_tokens).alias("_fan"))
    plan = small(wanted.join(fans, wanted["b"] == fans["block"]).select("b", "_ways", "_fan"), "cells")
    spread = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    members = labels.select("rid", F.col("block").alias("b")).join(plan, "b").select("rid", "b", F.pmod(F.hash("rid"), "_fan").alias("_cell"), spread("_ways").alias("_way"))
    members = members.join(sets.select("rid", F.col("toks").alias("held")), "rid").drop("rid")
    asking = pairs.join(plan, "b").select("rid", "b", F.pmod(F.hash("rid"), "_ways").alias("_way"), spread("_fan").alias("_cell"))
    asking = asking.join(labels.select("rid", F.col("block").alias("a")), "rid").join(sets.select("rid", F.col("toks").alias("asked")), "rid")
    asking = asking.select("a", F.col("b").alias("_b"), F.col("_cell").alias("_c"), F.col("_way").alias("_w"), "asked")

    def work(left: pa.Table, right: pa.Table) -> pa.Table:
        found: set[int] = set()
        b = left.column("_b")[0].as_py() if left.num_rows else 0
        if left.num_rows and right.num_rows:
            cell = Cell(*_lists(right.column("held")))
            tokens, offsets = _lists(left.column("asked"))
            everyone = np.arange(right.num_rows)
            for k, a in enumerate(left.column("a").to_pylist()):
                if a not in found and len(cell.linked(tokens[offsets[k] : offsets[k + 1]], threshold, everyone, not largest)):
                    found.add(a)
        return pa.table({"a": pa.array(list(found), pa.int64()), "b": pa.array([b] * len(found), pa.int64())})

    return asking.groupBy("_b", "_c", "_w").cogroup(members.groupBy("b", "_cell", "_way")).applyInArrow(work, "a long, b long")


def link_weights(sets: DataFrame, threshold: int, cell_tokens: int, cell_rows: int) -> DataFrame:
    """``rid`` and ``k``: the documents (``weight`` of each set) of the other sets that link to the set, for sets that any does.

    Linked sets have one final ``block``, so all pairs of sets of a block are all that need be compared. Blocks of more than
    ``cell_tokens`` or ``cell_rows`` are dealt to parts by hash, and each pair of parts meets in a cell; other blocks share cells.
    """
    blocks = sets.groupBy("block").agg(F.count("*").alias("_m"), F.sum("n").alias("_t")).filter("_m > 1")
    plan = small(blocks.select("block", F.greatest(F.ceil(F.col("_t") / cell_tokens), F.ceil(F.col("_m") / cell_rows)).alias("_fan"), "_t"), "parts")
    homes = int(plan.agg(F.ceil(F.sum("_t") / cell_tokens)).first()[0] or 1)
    dealt = sets.join(plan, "block").withColumn("_part", F.pmod(F.hash("rid"), "_fan")).withColumn("_other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_fan") - 1)))
    low, high = F.least("_part", "_other"), F.greatest("_part", "_other")
    celled = dealt.select(F.when(F.col("_fan") > 1, F.col("block")).otherwise(F.pmod(F.xxhash64("block"), F.lit(homes))).alias("_home"), (F.col("_fan") > 1).alias("_large"), low.alias("_low"), high.alias("_high"), "block", (F.col("_part") == low).alias("_first"), "rid", "weight", "toks")

    def work(table: pa.Table) -> pa.Table:
        apart = table.column("_low")[0].as_py() != table.column("_high")[0].as_py()
        order = np.argsort(table.column("block").to_numpy(), kind="stable")
        table = table.take(pa.array(order))
        block, rid, weight, first = (table.column(c).to_numpy(zero_copy_only=False) for c in ("block", "rid", "weight", "_first"))
        tokens, offsets = _lists(table.column("toks"))
        total = np.zeros(len(rid), np.int64)
        edges = np.flatnonzero(np.concatenate([[True], block[1:] != block[:-1], [True]]))
        for start, end in zip(edges, edges[1:], strict=False):
            held = np.arange(start, end)
            asking, held = (held[first[held]], held[~first[held]]) if apart else (held, held)
            if not len(asking) or not len(held):
                continue
            toks = [tokens[offsets[k] : offsets[k + 1]] for k in held]
            cell = Cell(np.concatenate(toks), np.concatenate([[0], np.cumsum([len(x) for x in toks])]))
            for k, a in enumerate(asking):
                found = held[cell.linked(tokens[offsets[a] : offsets[a + 1]], threshold, np.arange(0 if apart else k + 1, len(held)))]
                total[a] += weight[found].sum()
                total[found] += weight[a]
        some = total > 0
        return pa.table({"rid": rid[some], "k": total[some]})

    return celled.groupBy("_home", "_large", "_low", "_high").applyInArrow(work, "rid long, k long").groupBy("rid").agg(F.sum("k").alias("k"))


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: int = THRESHOLD, bucket_text: int = BUCKET_TEXT, cell_tokens: int = CELL_TOKENS, cell_queries: int = CELL_QUERIES, links: bool = False) -> DataFrame:
    """Components of the graph whose links are pairs of shingle sets with a Jaccard similarity of ``threshold`` per cent.

    Words are runs other than white space, A-Z in lower case; a document's set holds its distinct 5-word
    shingles, or its whole sequence if it has fewer words. Returns one row per document: ``doc_id``,
    ``n_shingles``, ``component_id`` (smallest doc_id reachable). The join is exact: every link between
    different sets lies within a component, but as components are all that is asked for, sets already
    known to be connected are not compared again; copies of a set are one member.

    1. Documents of which too few shingles occur elsewhere can't link and leave (``shared_counts``).
    2. Equal sets become one; similar sets meet in cells and form groups (``group``).
    3. One set of each group asks the matrix (``prefixes``, ``link_round``), at first for the largest group of each token alone; linked
       groups become one. Then all other sets ask the matrix of the larger groups, where most have no other left to ask for.

    With ``links``, a column ``n_links`` follows: the other documents that link to the document, copies of its set and of
    others each counted. For that every pair of distinct sets of a component is compared (``link_weights``). If rows
    that repeat an identifier have different sets, the links of each set count, also those between them.

    Documents without words link to nothing; so do rows without identifier, which give rows with null
    ``component_id``. Rows that repeat an identifier are one document, with the larger of their sizes and
    the links of all. Texts are read whole; an empty table gives an empty result; other columns stay out.
    """
    every = whole_texts(docs, id_col, text_col)
    rows = every.filter("_id IS NOT NULL")
    counts = materialise(shared_counts(rows, bucket_text), "counts")
    alive = small(counts.filter((F.col("n") > 0) & (100 * F.col("c") >= threshold * F.col("n"))).select("_id"), "alive")
    living = rows.join(alive, "_id", "left_semi")
    distinct = shingle_sets(living, True).groupBy("rid").agg(F.min("_id").alias("_id"), F.first("toks").alias("toks")).withColumn("n", F.size("toks").cast("long"))
    sets = materialise(group(distinct, threshold, cell_tokens), "sets")

    labels = materialise(sets.select("rid", "_id", "n", "block", (F.col("rid") == F.col("block")).alias("pivot")), "labels")
    prefix = materialise(prefixes(sets, threshold), "prefixes")
    sets = sets.select("rid", "toks")
    for pivots, largest in ((True, True), (True, False), (False, False)):
        merged = components(link_round(sets, labels, prefix, pivots, threshold, cell_tokens, cell_queries, largest))
        labels = labels.join(merged.withColumnRenamed("node", "block"), "block", "left").withColumn("block", F.coalesce("label", "block")).drop("label")
        labels = materialise(labels, "labels")
    final = labels.select("rid", "_id", "block")

    least = final.groupBy("block").agg(F.min("_id").alias("component_id"))
    of_set = final.join(least, "block").select("rid", "component_id")
    members, number, schema = shingle_sets(living, False), [], ""
    if links:
        members, number, schema = materialise(members.distinct(), "members"), [F.sum("_links").alias("n_links")], ", n_links long"
        copies = small(members.groupBy("rid").agg(F.count("*").alias("weight")).filter("weight > 1"), "copies")
        weighed = lambda df: df.join(copies, "rid", "left").withColumn("weight", F.coalesce("weight", F.lit(1)))
        others = link_weights(weighed(labels.select("rid", "block", "n").join(sets, "rid")), threshold, cell_tokens, cell_queries)
        of_set = weighed(of_set).join(others, "rid", "left").select("rid", "component_id", (F.col("weight") - 1 + F.coalesce("k", F.lit(0))).alias("_links"))
    found = members.join(of_set, "rid").groupBy("_id").agg(F.min("component_id").alias("component_id"), *number)
    number = [F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links")] if links else []
    known = counts.join(found, "_id", "left").select(F.col("_id").alias("doc_id"), F.col("n").alias("n_shingles"), F.coalesce("component_id", "_id").alias("component_id"), *number)

    def sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, data, offsets in chunks(batches):
            row, _ = _sets(data, offsets)
            none = pa.array(np.zeros(len(ids), np.int64))
            columns = [ids, pa.array(np.bincount(row, minlength=len(ids)).astype(np.int64)), ids, none]
            yield pa.record_batch(columns[: 3 + links], names=["doc_id", "n_shingles", "component_id", "n_links"][: 3 + links])

    return known.unionByName(every.filter("_id IS NULL").mapInArrow(released(sizes), "doc_id long, n_shingles long, component_id long" + schema))


def op8_ngram_jaccard_join(spark, sf_dir: str) -> DataFrame:
    """The contract's query over all documents, with the number of links of each."""
    return jaccard_components(spark.read.parquet(f"{sf_dir}/documents.parquet"), links=True)
