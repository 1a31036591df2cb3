"""Exact dedup by deterministic block naming, with DataFrame functions only.

A text is cut into fixed-size blocks of bytes. Blocks are sorted, and each run of equal blocks gets one integer name. Then adjacent names are
paired, the pairs are sorted and named the same way, and so on until a document has a single name: its identity, free of collisions, as content
is compared and never a hash. Documents that end on the same level are named apart from inner nodes, so the last name tells the group.

Hot runs: a count of block hashes finds the runs with more than ``limit`` members; their members are dealt over as many salts as they need, each
salted run is named for itself and the names of a run's salts are merged after that. ``limit`` is at least a 4096th of the documents and at
least 64, but at most 16,384, so there are at most max(4096, blocks / 16,384) hot runs and as many salts again: the bound of what is broadcast
(two longs a row, a few MB for each TB of text). A hash only deals rows out; equal hashes of unequal blocks do no harm.

Defined results: a null text counts as empty; a null doc_id is a row like any other and stays only in a group without a known doc_id; of rows that
repeat a doc_id with equal texts one stays; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from kindred.plans.scratch import Scratch

#: Bytes of a block.
BLOCK = 4096
_SPACES = r"[\x20\x09-\x0D]{2,}|[\x09-\x0D]"


def normalised(text: Column) -> Column:
    """Each run of ASCII white space becomes one space (single spaces need no match)."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), _SPACES, " ")


def _name(scratch: Scratch, nodes: DataFrame, keys: list[str], limit: int) -> DataFrame:
    """Name each run of equal keys: ``name`` is the occurrence number of the run's first member by (doc_id, occ); ``keep_id`` its doc_id, ``n`` the run's length."""
    hot = (
        nodes.groupBy(F.xxhash64(*keys).alias("_h")).agg(F.count(F.lit(1)).alias("_n"))
        .where(F.col("_n") > limit).select("_h", F.ceil(F.col("_n") / limit).alias("_salts"))
    )
    dealt = nodes.join(F.broadcast(hot), F.xxhash64(*keys) == F.col("_h"), "left").withColumn(
        "_salt", F.when(F.col("_salts").isNotNull(), F.pmod(F.xxhash64("occ"), "_salts")).otherwise(0)
    )
    run = Window.partitionBy(*keys, "_salt")
    first = F.struct(F.col("doc_id").isNull().alias("no"), F.col("doc_id").alias("id"), F.col("occ").alias("occ"))
    told = dealt.withColumn("_first", F.min(first).over(run)).withColumn("_n", F.count(F.lit(1)).over(run))
    speaks = F.col("_salts").isNotNull() & (F.col("_first.occ") == F.col("occ"))
    table = scratch.cut(
        told.select(*[c for c in nodes.columns if c not in keys], *[F.when(speaks, F.col(k)).alias(k) for k in keys], "_first", "_n", speaks.alias("_speaks"))
    )
    whole = Window.partitionBy(*keys)
    merged = table.where("_speaks").select(
        F.col("occ").alias("_of"), F.min("_first").over(whole).alias("_all"), F.sum("_n").over(whole).alias("_sum")
    )
    best = F.coalesce("_all", "_first")
    return table.join(F.broadcast(merged), F.col("_first.occ") == F.col("_of"), "left").select(
        *[c for c in nodes.columns if c not in keys], best["occ"].alias("name"), best["id"].alias("keep_id"), F.coalesce("_sum", "_n").alias("n")
    )


def exact_groups(docs: DataFrame, scratch: Scratch, block: int = BLOCK) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256 (of the normalised text)."""
    limit = max(64, min(docs.count() // 4096, 16_384))
    texts = docs.select("doc_id", normalised(F.col("text")).alias("_t")).select(
        "doc_id", F.sha2("_t", 256).alias("sha"), F.col("_t").cast("binary").alias("_b"), F.monotonically_increasing_id().alias("uid")
    )
    cuts = texts.select("*", F.greatest(F.lit(1), F.ceil(F.octet_length("_b") / block)).cast("int").alias("size")).select(
        "doc_id", "uid", "size", "sha", "_b", F.posexplode(F.sequence(F.lit(0), F.col("size") - 1)).alias("pos", "_p")
    )
    nodes = cuts.select(
        "doc_id", "uid", "size", "pos", F.when(F.col("pos") == 0, F.col("sha")).alias("sha"), (F.col("size") == 1).alias("root"),
        F.substring("_b", F.col("pos") * block + 1, F.lit(block)).alias("left"), F.lit(0).cast("long").alias("right"),
        F.monotonically_increasing_id().alias("occ"),
    )
    done = []
    while True:
        named = scratch.cut(_name(scratch, nodes, ["left", "right", "root"], limit).withColumn("root", F.col("size") == 1))
        done.append(named.where("root"))
        rest = named.where("not root")
        if rest.isEmpty():
            break
        # A node's children are neighbours of one document; -1 stands for the missing right child of an odd end.
        pairs = rest.groupBy("uid", F.floor(F.col("pos") / 2).cast("int").alias("pos")).agg(
            F.max("doc_id").alias("doc_id"), F.ceil(F.max("size") / 2).cast("int").alias("size"), F.max("sha").alias("sha"), F.min("occ").alias("occ"),
            F.max(F.when(F.col("pos") % 2 == 0, F.col("name"))).alias("left"), F.coalesce(F.max(F.when(F.col("pos") % 2 == 1, F.col("name"))), F.lit(-1).cast("long")).alias("right"),
        )
        nodes = pairs.withColumn("root", F.col("size") == 1).select("doc_id", "uid", "size", "pos", "sha", "root", "left", "right", "occ")
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out.select("doc_id", "keep_id", F.col("n").alias("group_size"), (F.col("occ") == F.col("name")).alias("kept"), F.col("sha").alias("text_sha256"))


def drop_copies(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """The rows of ``docs`` that stay, with their columns. A row is known by its doc_id and its text's digest; of rows alike in both one stays.

    A doc_id of which every row goes tells its rows by itself, so whole texts are neither hashed nor exchanged for them; only rows of a doc_id of which some
    stay and some go are told by their digests."""
    def key(sha: Column) -> Column:
        return F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), sha)

    groups = exact_groups(docs, scratch)
    counts = groups.groupBy("doc_id").agg(F.count_if("kept").alias("_kept"), F.count(F.lit(1)).alias("_rows"))
    ids = scratch.cut(counts.where("_kept < _rows").select(F.col("doc_id").alias("_exact_id"), (F.col("_kept") == 0).alias("_all")))
    same = F.col("doc_id").eqNullSafe(F.col("_exact_id"))
    stay = docs.join(ids.where("_all").select("_exact_id"), same, "left_anti")
    some = ids.where("NOT _all").select("_exact_id")
    if some.isEmpty():
        return stay
    kept = groups.where("kept").join(some, same, "left_semi").select(key(F.col("text_sha256")).alias("_exact_key")).distinct()
    marked = stay.join(some, same, "left_semi").withColumn("_exact_key", key(F.sha2(normalised(F.col("text")), 256)))
    one = F.row_number().over(Window.partitionBy("_exact_key").orderBy(F.lit(0)))
    first = marked.join(kept, "_exact_key", "left_semi").withColumn("_exact_nth", one).where("_exact_nth = 1").drop("_exact_nth", "_exact_key")
    return stay.join(some, same, "left_anti").unionByName(first)


def op4_exact_block_naming(spark, sf_dir: str) -> DataFrame:
    return exact_groups(spark.read.parquet(f"{sf_dir}/documents.parquet"), Scratch(spark, "exact"))


OP4_SQL = r"""
WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
SELECT doc_id, min(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
  doc_id = min(doc_id) OVER g AS kept, sha256(t) AS text_sha256
FROM t WINDOW g AS (PARTITION BY t)
"""
