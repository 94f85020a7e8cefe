"""The prefix trie of conversations: chains of owned depths, found by binary search against the minima of prefix digests."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewright.llm.shared import materialise
from tablewright.operators.scan import State, block_of, scan

FAMILY = 5
MOST_SHARED = 9
BLOCK_TURNS = 4096
BLOCK_IDS = 4096
"""Width of the ranges of identifiers that are joined to one string."""

NODE = ["depth", "x1", "x2"]


def long_of(digest: str, start: int) -> F.Column:
    """Sixteen hex digits of a digest as a signed long."""
    return F.conv(F.substring(digest, start, 16), 16, -10).cast("long")


def ordered_turns(turns: DataFrame) -> DataFrame:
    """``c``, ``k`` (turn's place in its conversation, from 1), ``turn_digest``, ``bytes`` (of the text)."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    rows = turns.filter("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("c"),
        F.col("turn").isNotNull().alias("there"),
        F.col("turn").cast("long").alias("turn"),
        F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256).alias("turn_digest"),
        F.octet_length(text).cast("long").alias("bytes"),
    )
    by = ["there", "turn", "turn_digest"]
    placed = materialise(rows.repartitionByRange("c", *by).withColumn("block", F.spark_partition_id().cast("long")), "turns")
    return scan(placed, ["c"], by, [State("k", "sum", F.lit(1).cast("long"))], F.col("block")).select("c", "k", "turn_digest", "bytes")


def rebuilt(ranked: DataFrame, family: int = FAMILY, most_shared: int = MOST_SHARED) -> tuple[DataFrame, DataFrame]:
    """The conversations (``c``) and their turns (``c``, ``depth``, ``turn_digest``, ``bytes``) after the shared head is put before them.

    The head of ``c`` is the first crc32(c) mod ``most_shared`` turns of conversation c - c mod ``family``, in place of as many of its own.
    """
    base = F.col("c") - F.col("c") % family
    lengths = materialise(ranked.groupBy("c").agg(F.max("k").alias("n")), "lengths")
    h = F.crc32(F.col("c").cast("string").cast("binary")) % most_shared
    heads = lengths.select("c", base.alias("base"), h.alias("h"))
    convs = heads.join(lengths.select(F.col("c").alias("base"), F.col("n").alias("base_n")), "base", "left")
    convs = materialise(convs.select("c", "base", "h", F.least("h", F.coalesce("base_n", F.lit(0))).alias("taken")), "heads")
    own = ranked.join(convs.select("c", "h", "taken"), "c").filter("k > h").select("c", (F.col("taken") + F.col("k") - F.col("h")).alias("depth"), "turn_digest", "bytes")
    first = ranked.filter(F.col("k") < most_shared).select(F.col("c").alias("base"), F.col("k").alias("depth"), "turn_digest", "bytes")
    shared = convs.select("c", "base", "taken").join(first, "base").filter("depth <= taken").select("c", "depth", "turn_digest", "bytes")
    return convs.select("c"), own.unionByName(shared)


def prefixes(turns: DataFrame) -> DataFrame:
    """``turns`` with the digest of the first ``depth`` turns: 128 bits (``x1``, ``x2``), the xor of the turns' digests keyed by their depth."""
    keyed = turns.withColumn("digest", F.sha2(F.concat_ws(":", "depth", "turn_digest").cast("binary"), 256))
    states = [State("x1", "xor", long_of("digest", 1)), State("x2", "xor", long_of("digest", 17))]
    return scan(keyed.select("c", "depth", "bytes", "digest"), ["c"], ["depth"], states, block_of(F.col("depth"), BLOCK_TURNS)).drop("digest")


def first_owned(prefix: DataFrame, minima: DataFrame) -> DataFrame:
    """``c``, ``first`` (the smallest depth at which c is the smallest member, one past its end if none), ``last`` (its length).

    A conversation that is the smallest member of a prefix is so of every longer prefix of its own, so the first such depth is found
    by bisection. Each round asks one depth of every conversation that is still open, in two joins.
    """
    state = prefix.groupBy("c").agg(F.max("depth").alias("last")).select("c", F.lit(1).cast("long").alias("lo"), (F.col("last") + 1).alias("hi"), "last")
    state = materialise(state, "search")
    longest = state.agg(F.max("last")).first()[0] or 0
    for _ in range(longest.bit_length()):
        asked = state.filter("lo < hi").select("c", F.floor((F.col("lo") + F.col("hi")) / 2).alias("depth"))
        owner = asked.join(prefix.select("c", *NODE), ["c", "depth"]).join(minima.select(*NODE, "owner"), NODE).select("c", "depth", (F.col("owner") == F.col("c")).alias("own"))
        told = state.join(owner, "c", "left")
        lo = F.when(F.col("own") == F.lit(False), F.col("depth") + 1).otherwise(F.col("lo"))
        hi = F.when(F.col("own"), F.col("depth")).otherwise(F.col("hi"))
        state = materialise(told.select("c", lo.alias("lo"), hi.alias("hi"), "last"), "search")
    return state.select("c", F.col("lo").alias("first"), "last")


def summed_chains(chains: DataFrame, height_name: str = "chains") -> DataFrame:
    """``c`` with ``leaves`` and ``saved`` of its chain and of all chains below it.

    ``chains`` has ``c``, ``parent`` (of the chain it hangs on, null at the root), ``leaves``, ``saved``. In round r a chain holds the sum of
    all chains less than 2^r below it and adds those of the chains 2^r below, so the rounds grow with the logarithm of the height. The
    sums of a parent's children are aggregated before they are joined, so a parent may have any number of them.
    """
    state = materialise(chains.select("c", F.col("parent").alias("up"), "leaves", "saved"), height_name)
    while not state.filter("up IS NOT NULL").isEmpty():
        hanging = state.filter("up IS NOT NULL")
        sums = hanging.groupBy("up").agg(F.sum("leaves").alias("l"), F.sum("saved").alias("s")).withColumnRenamed("up", "c")
        further = state.select(F.col("c").alias("up"), F.col("up").alias("up2"))
        state = state.join(sums, "c", "left").join(further, "up", "left")
        plus = lambda a, b: (F.col(a) + F.coalesce(b, F.lit(0))).alias(a)
        state = materialise(state.select("c", F.col("up2").alias("up"), plus("leaves", "l"), plus("saved", "s")), height_name)
    return state.select("c", "leaves", "saved")


def id_hashes(ends: DataFrame) -> DataFrame:
    """SHA-256 of the comma-joined identifiers (``c``, ascending) of each node (``owner``, ``depth``).

    Identifiers are joined to strings by ranges first. A node's strings then pass one task in order, which keeps the state of the hash
    alone, so its memory is bounded whatever the number of identifiers.
    """
    ranges = ends.groupBy("owner", "depth", F.floor(F.col("c") / BLOCK_IDS).alias("range"))
    strings = ranges.agg(F.array_join(F.transform(F.array_sort(F.collect_list("c")), lambda c: c.cast("string")), ",").alias("ids"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state, out = None, None, []
        for batch in batches:
            for owner, depth, ids in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                if (owner, depth) != now:
                    if now:
                        out.append((*now, state.hexdigest()))
                    now, state = (owner, depth), hashlib.sha256(ids.encode())
                else:
                    state.update(b"," + ids.encode())
            if len(out) >= 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out, strict=True)], ["owner", "depth", "ends_sha256"])
                out = []
        if now:
            out.append((*now, state.hexdigest()))
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out, strict=True)], ["owner", "depth", "ends_sha256"])

    placed = strings.repartition("owner", "depth").sortWithinPartitions("owner", "depth", "range")
    return placed.select("owner", "depth", "ids").mapInArrow(work, "owner long, depth long, ends_sha256 string")


def prefix_trie(turns: DataFrame, family: int = FAMILY, most_shared: int = MOST_SHARED) -> DataFrame:
    """The nodes of the trie of rebuilt conversations.

    ``turns`` has conv_id, turn, role, text; turns are ordered by turn (null first), turns of one number by the digest of role and text;
    a null role or text counts as empty. Rows without conv_id belong to no conversation and are left out; repeated rows are turns of their own.
    A node is a sequence of turns that a rebuilt conversation begins with, the root the empty one; it is owned by the smallest
    conversation that begins with it. Returns per node ``conv_id`` (the owner), ``depth``, ``parent_conv_id`` (root: null), ``n_convs``,
    ``n_children``, ``n_leaves`` (childless nodes of its subtree), ``saved_tokens`` (over its subtree, members but one times the bytes of the
    last text), ``ends_sha256`` (of the conversations that end here, ascending). Other columns are not read; an empty table has no node.
    """
    convs, turns = rebuilt(materialise(ordered_turns(turns), "ranked"), family, most_shared)
    prefix = materialise(prefixes(turns), "prefixes")
    minima = prefix.groupBy(*NODE).agg(F.min("c").alias("owner"), F.count("*").alias("n_convs"), F.max("bytes").alias("bytes"))
    minima = materialise(minima, "minima")
    total = convs.agg(F.count("*").alias("n_convs"), F.min("c").alias("owner")).first()
    spark = prefix.sparkSession
    root = spark.createDataFrame([(total.owner, 0, total.n_convs, 0)] if total.n_convs else [], "owner long, depth long, n_convs long, bytes long")
    nodes = minima.select("owner", "depth", "n_convs", "bytes").unionByName(root)

    searched = first_owned(prefix, minima)
    top = F.col("c") == F.lit(total.owner)
    chains = convs.join(searched, "c", "left").select("c", F.when(top, F.lit(0)).otherwise(F.col("first")).cast("long").alias("first"), F.coalesce("last", F.lit(0)).cast("long").alias("last"))
    chains = materialise(chains.filter("first <= last"), "owned")
    above = chains.filter("first > 1").select("c", (F.col("first") - 1).alias("depth"))
    above = above.join(prefix.select("c", *NODE), ["c", "depth"]).join(minima.select(*NODE, "owner"), NODE).select("c", F.col("owner").alias("parent"))
    hung = chains.join(above, "c", "left")
    hung = materialise(hung.select("c", "first", "last", F.when(F.col("first") == 1, F.lit(total.owner)).otherwise(F.col("parent")).alias("parent")), "hung")

    at = hung.filter("parent IS NOT NULL").select("c", F.col("parent").alias("owner"), (F.col("first") - 1).alias("depth"))
    busy = at.groupBy("owner", "depth").agg(F.count("*").alias("n_hung"))
    own_saved = nodes.groupBy(F.col("owner").alias("c")).agg(F.sum((F.col("n_convs") - 1) * F.col("bytes")).alias("saved"))
    ended = hung.join(busy.select(F.col("owner").alias("c"), F.col("depth").alias("last"), "n_hung"), ["c", "last"], "left")
    ended = ended.select("c", "parent", F.when(F.col("n_hung").isNull(), 1).otherwise(0).cast("long").alias("leaves"))
    sums = summed_chains(ended.join(own_saved, "c"))
    below = at.join(sums, "c").groupBy("owner", "depth").agg(F.count("*").alias("n_hung"), F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))

    full = convs.join(prefix.select("c", *NODE), "c").join(searched.select("c", F.col("last").alias("depth")), ["c", "depth"], "left_semi")
    ends = full.join(minima.select(*NODE, "owner"), NODE).select("owner", "depth", "c")
    turnless = convs.join(searched, "c", "left_anti").select(F.lit(total.owner).cast("long").alias("owner"), F.lit(0).cast("long").alias("depth"), "c")
    hashes = id_hashes(ends.unionByName(turnless))

    whole = nodes.join(hung.withColumnRenamed("c", "owner"), "owner").join(below, ["owner", "depth"], "left").join(hashes, ["owner", "depth"], "left")
    zero = lambda c: F.coalesce(c, F.lit(0))
    childless = (F.col("depth") == F.col("last")) & F.col("n_hung").isNull()
    whole = whole.select(
        "owner", "depth", "n_convs", "last",
        F.when(F.col("depth") == F.col("first"), F.col("parent")).otherwise(F.col("owner")).alias("parent_conv_id"),
        (zero("n_hung") + (F.col("depth") < F.col("last")).cast("long")).alias("n_children"),
        (zero("leaves") + childless.cast("long")).alias("leaves"),
        (zero("saved") + (F.col("n_convs") - 1) * F.col("bytes")).alias("saved"),
        F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"),
        (F.col("last") - F.col("depth")).alias("_up"),
    )
    states = [State("n_leaves", "sum", F.col("leaves")), State("saved_tokens", "sum", F.col("saved"))]
    found = scan(whole, ["owner"], ["_up"], states, block_of(F.col("_up"), BLOCK_TURNS))
    return found.select(F.col("owner").alias("conv_id"), "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def op13_prefix_trie(spark, sf_dir: str) -> DataFrame:
    """The contract's query over all conversations."""
    return prefix_trie(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


SQL = """
WITH turns AS (
  SELECT conv_id AS c, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL
), own AS (
  SELECT c, list(struct_pack(role := role, text := text)
                 ORDER BY turn NULLS FIRST, sha256(concat(strlen(role), ':', role, text))) AS ts
  FROM turns GROUP BY c
), nibbles AS (
  SELECT c, ts, flatten(list_transform(string_split(CAST(c AS VARCHAR), ''), lambda x: [ascii(x) & 15, ascii(x) >> 4])) AS ns FROM own
), hashed AS (
  SELECT c, ts, xor(list_reduce(list_transform(ns, lambda x: CAST(x AS BIGINT)), lambda a, b: xor(a >> 4, [
    0, 498536548, 997073096, 651767980, 1994146192, 1802195444, 1303535960, 1342533948,
    3988292384, 4027552580, 3604390888, 3412177804, 2607071920, 2262029012, 2685067896, 3183342108][(xor(a, b) & 15) + 1]),
    4294967295), 4294967295) % 9 AS h
  FROM nibbles
), rebuilt AS (
  SELECT a.c, list_concat(coalesce(b.ts, [])[1:a.h], a.ts[a.h + 1:]) AS ts FROM hashed a LEFT JOIN own b ON b.c = a.c - a.c % 5
), members AS (
  SELECT c, d, ts[1:d] AS s, len(ts) = d AS ends FROM (SELECT c, ts, unnest(range(0, len(ts) + 1)) AS d FROM rebuilt)
), nodes AS (
  SELECT s, d, min(c) AS conv_id, count(*) AS n_convs, count(*) - 1 AS more,
         CASE WHEN d = 0 THEN 0 ELSE strlen(s[d].text) END AS bytes,
         sha256(coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (ends), '')) AS ends_sha256
  FROM members GROUP BY s, d
), children AS (
  SELECT s[1:d - 1] AS s, d - 1 AS d, count(*) AS n_children FROM nodes WHERE d > 0 GROUP BY ALL
), own_part AS (
  SELECT n.*, coalesce(n_children, 0) AS n_children, CASE WHEN n_children IS NULL THEN 1 ELSE 0 END AS leaf, more * bytes AS saved
  FROM nodes n LEFT JOIN children ch ON ch.s = n.s AND ch.d = n.d
), above AS (
  SELECT s[1:k] AS s, k AS d, sum(leaf) AS n_leaves, sum(saved) AS saved_tokens
  FROM (SELECT s, leaf, saved, unnest(range(0, d + 1)) AS k FROM own_part) GROUP BY ALL
)
SELECT n.conv_id, n.d AS depth, p.conv_id AS parent_conv_id, n.n_convs, n.n_children, CAST(a.n_leaves AS BIGINT) AS n_leaves,
       CAST(a.saved_tokens AS BIGINT) AS saved_tokens, n.ends_sha256
FROM own_part n JOIN above a ON a.s = n.s AND a.d = n.d LEFT JOIN nodes p ON p.d = n.d - 1 AND p.s = n.s[1:n.d - 1]
"""
