"""Length bucketing, sortish / token-budget batches, sharding, chunking,
padding accounting and greedy packing (W8-W13 A15 F8 P15-P17 T8 C18).

Order-dependent numbering uses the range-partitioned global index.  The two
greedy operators (token-budget batches, packing) know for each row where a
batch or pack that starts there ends; the starts are the chain from the first
row, followed shard by shard (``chain_starts``), exact for any shard size.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import text as tx
from tessera.operators.ordering import global_index, rank_within, running_sums
from tessera.operators.splits import seeded_hash
from tessera.session import cut_lineage


def pair_length(source: Column, target: Column | None = None) -> Column:
    """The length that batches a pair: its source's, or the longer side's."""
    return source if target is None else F.greatest(source, target)


def length_table(pairs: DataFrame, source: str = "source", target: str | None = "target", length=tx.word_count, cap: int | None = None,
                 name: str = "length") -> DataFrame:
    """``pairs`` with the length that batches them, by a length expression (a
    tokenizer's hook, or words), of the source or of the longer side, at most
    ``cap``; nulls count 0."""
    n = pair_length(*[F.coalesce(length(F.col(c)), F.lit(0)) for c in (source, target) if c])
    return pairs.withColumn(name, (n if cap is None else F.least(n, F.lit(cap))).cast("long"))


def with_lengths(rows: DataFrame, table: DataFrame, key: str, text: str, name: str = "length") -> DataFrame:
    """``rows`` with the lengths of a table of (key, name); rows that it lacks
    get the characters of their line, its newline included."""
    known = table.select(key, F.col(name).alias("_known"))
    return rows.join(known, key, "left").withColumn(name, F.coalesce("_known", tx.char_len_with_newline(text))).drop("_known")


def length_batches(df: DataFrame, id_col: str, length: str, bs: int) -> DataFrame:
    """Sort by length descending (id breaks ties), cut every ``bs`` rows."""
    idx = global_index(df, [F.col(length).desc(), F.col(id_col)], "_i")
    return idx.withColumn("batch_id", F.floor(F.col("_i") / bs).cast("long")).drop("_i")


def sortish_batches(df: DataFrame, id_col: str, length: str, bs: int, seed: int = 42,
                    chunk_factor: int = 50) -> DataFrame:
    """Seeded shuffle, chunks of ``chunk_factor * bs``, longest-first inside a
    chunk, cut every ``bs``; the batch holding the longest leading item goes
    first, the rest in seeded random order (``batch_pos``)."""
    chunk = chunk_factor * bs
    shuffled = global_index(df.withColumn("_h", seeded_hash(id_col, seed)), ["_h", id_col], "_p")
    shuffled = shuffled.withColumn("_chunk", F.floor(F.col("_p") / chunk).cast("long"))
    ranked = rank_within(shuffled, ["_chunk"], [F.col(length).desc(), F.col(id_col)], "_rn")
    rows = ranked.withColumn("batch_id", F.floor((F.col("_chunk") * chunk + F.col("_rn")) / bs).cast("long")) \
                 .drop("_h", "_p", "_chunk", "_rn")
    batches = rows.groupBy("batch_id").agg(F.max(length).alias("_mx"))
    first = batches.agg(F.max_by("batch_id", F.struct(F.col("_mx"), -F.col("batch_id"))).alias("_lead"))
    marked = batches.crossJoin(F.broadcast(first)).select(  # one row
        "batch_id", F.when(F.col("batch_id") == F.col("_lead"), F.lit(-1)).otherwise(seeded_hash("batch_id", seed + 1)).alias("_bh"))
    order = global_index(marked, ["_bh", "batch_id"], "batch_pos").drop("_bh")
    return rows.join(order, "batch_id")


def padding_waste(batched: DataFrame, batch: str, length: str) -> DataFrame:
    """Pad tokens when each batch is padded to its longest row."""
    per = batched.groupBy(batch).agg((F.max(length) * F.count(F.lit(1)) - F.sum(length)).alias("_w"))
    return per.agg(F.count(F.lit(1)).alias("n_batches"), F.sum("_w").cast("long").alias("pad_tokens"))


def round_robin_shards(df: DataFrame, id_col: str, replicas: int, pad: bool = True) -> DataFrame:
    """Row i goes to shard i mod R; with ``pad`` the first rows are repeated
    so every shard has ceil(n/R) rows (``is_padding`` marks the repeats)."""
    idx = global_index(df, [id_col], "_o")
    n = idx.count()  # scalar
    base = idx.select("*", (F.col("_o") % replicas).cast("long").alias("shard"),
                      F.lit(0).cast("long").alias("is_padding"))
    if not pad:
        return base.drop("_o")
    total = -(-n // replicas) * replicas
    extra = idx.where(F.col("_o") < total - n).select(
        "*", ((F.col("_o") + n) % replicas).cast("long").alias("shard"), F.lit(1).cast("long").alias("is_padding"))
    return base.unionByName(extra).drop("_o")


def chunks(df: DataFrame, order, size: int, name: str = "chunk_id") -> DataFrame:
    idx = global_index(df, order, "_o")
    return idx.withColumn(name, F.floor(F.col("_o") / size).cast("long")).drop("_o")


def truncate(tokens: Column, n: int) -> Column:
    return F.slice(tokens, 1, n)


def pad_to(tokens: Column, n: int, pad: str) -> Column:
    return F.concat(tokens, F.array_repeat(F.lit(pad), F.greatest(F.lit(n) - F.size(tokens), F.lit(0))))


def shift_right(tokens: Column, start: str) -> Column:
    return F.concat(F.array(F.lit(start)), F.slice(tokens, 1, F.greatest(F.size(tokens) - 1, F.lit(0))))


def trim_batch(batched: DataFrame, batch: str, tokens: str, pad: str) -> DataFrame:
    """Rows without the columns in which every row of their batch has ``pad``
    (interior ones too): ``tokens`` is cut, ``width`` is what is left.  A
    batch's kept columns are at most its token width."""
    used = F.filter(F.transform(tokens, lambda t, i: F.when(t != F.lit(pad), i)), lambda i: i.isNotNull())
    kept = batched.select(batch, F.explode(used).alias("_c")).groupBy(batch).agg(F.sort_array(F.collect_set("_c")).alias("_kept"))
    rows = batched.join(kept, batch, "left").withColumn("_kept", F.coalesce("_kept", F.array().cast("array<int>")))
    cut = F.transform("_kept", lambda i: F.coalesce(F.get(F.col(tokens), i), F.lit(pad)))
    return rows.withColumn(tokens, cut).withColumn("width", F.size("_kept").cast("long")).drop("_kept")


# ------------------------------- greedy cuts --------------------------------

def chain_starts(rows: DataFrame, n: int, shard_rows: int = 65536, fan: int = 256) -> DataFrame:
    """Positions reached from 0 by following ``_next`` (> ``_o``), as ``_o``.

    ``rows`` has ``_o`` and ``_next``, for every position below ``n`` that a
    ``_next`` names.  Each shard of consecutive positions works out, for every
    position, where a chain that passes it leaves the shard.  Chains that enter
    a shard at different positions soon meet, so the positions at which a shard
    is entered are few; these and their exits are the rows of the next level,
    of shards ``fan`` times as wide, up to one shard, whose chain begins at 0.
    Then each level's shards replay their parts from their true entries.
    Everything stays in Spark; the result doesn't depend on the shards.
    """
    shard = F.floor(F.col("_o") / shard_rows).cast("long").alias("_shard")
    sharded = rows.select("_o", "_next", shard)

    def leaving(pdf: pd.DataFrame) -> pd.DataFrame:
        end, out = (int(pdf["_shard"].iloc[0]) + 1) * shard_rows, {}
        pdf = pdf.sort_values("_o", ascending=False)
        for o, e in zip(pdf["_o"].tolist(), pdf["_next"].tolist()):
            out[o] = out.get(e, e) if e < end else e
        return pd.DataFrame({"_o": list(out), "_next": list(out.values())}, dtype="int64")

    def replay(pdf: pd.DataFrame) -> pd.DataFrame:
        step, out, at = dict(zip(pdf["_o"].tolist(), pdf["_next"].tolist())), [], int(pdf["_entry"].iloc[0])
        while at in step:
            out.append(at)
            at = step[at]
        return pd.DataFrame({"_o": out}, dtype="int64")

    if n <= shard_rows:
        entries = rows.sparkSession.createDataFrame([(0,)], "_o long")
    else:
        exits = cut_lineage(sharded.groupBy("_shard").applyInPandas(leaving, "_o long, _next long"))
        entered = exits.select(F.col("_next").alias("_o")).distinct()
        met = exits.join(entered, "_o", "left_semi").unionByName(exits.where(F.col("_o") == 0))
        entries = chain_starts(cut_lineage(met), n, shard_rows * fan, fan)
    entries = entries.select(shard, F.col("_o").alias("_entry"))
    return sharded.join(entries, "_shard").groupBy("_shard").applyInPandas(replay, "_o long")


def _numbered(rows: DataFrame, starts: DataFrame, name: str) -> DataFrame:
    """Rows with the number of the start at or before their position."""
    ids = global_index(starts, ["_o"], name)
    spans = rows.join(ids, "_o").select(name, F.explode(F.sequence(F.col("_o"), F.col("_next") - 1)).alias("_o"))
    return rows.join(spans, "_o")


def token_budget_batches(df: DataFrame, id_col: str, length: str, max_tokens: int = 1024,
                         multiple: int = 64, shard_rows: int = 65536, seed: int = 42) -> DataFrame:
    """(id, length, batch_id, batch_pos): rows longest first; a batch takes as
    many rows as fit the budget at the length of its first one (at least one),
    cut down to a multiple of ``multiple`` rows where there are that many; the
    costliest batch (longest x rows) goes first, the rest in seeded order."""
    rows = cut_lineage(global_index(df.select(id_col, F.col(length).cast("long").alias(length)), [F.col(length).desc(), F.col(id_col)], "_o"))
    n = rows.count()
    fits = F.greatest(F.floor(F.lit(max_tokens) / F.greatest(F.col(length), F.lit(1))), F.lit(1))
    whole = F.greatest(F.floor(fits / multiple) * multiple, fits % multiple)
    rows = rows.withColumn("_next", F.when(F.col("_o") + fits >= n, F.lit(n)).otherwise(F.col("_o") + whole).cast("long"))
    rows = _numbered(rows, chain_starts(rows, n, shard_rows), "batch_id").select(id_col, length, "batch_id")
    rows = cut_lineage(rows)
    cost = rows.groupBy("batch_id").agg((F.max(length) * F.count(F.lit(1))).alias("_cost"))
    first = cost.agg(F.max_by("batch_id", F.struct(F.col("_cost"), -F.col("batch_id"))).alias("_lead"))
    marked = cost.crossJoin(F.broadcast(first)).select(  # one row
        "batch_id", F.when(F.col("batch_id") == F.col("_lead"), F.lit(-1)).otherwise(seeded_hash("batch_id", seed)).alias("_bh"))
    order = global_index(marked, ["_bh", "batch_id"], "batch_pos").drop("_bh")
    return rows.join(order, "batch_id")


def pack_rows(pairs: DataFrame, order, src_len: str, tgt_len: str, max_tokens: int = 1024,
              shard_rows: int = 65536, max_rows: int = 65536) -> DataFrame:
    """``pairs`` with pack_id and pack_pos: consecutive pairs share a pack
    while the source lengths and the target lengths each add up to the budget
    at most; a pair beyond the budget is alone.  A pack holds ``max_rows``
    pairs at most, since pairs without a token never fill one.

    Where the pack that starts at a row ends is a rank among prefix sums: the
    number of rows whose sum is at most the row's own start plus the budget.
    """
    rows = global_index(pairs.withColumn("_sl", F.col(src_len).cast("long")).withColumn("_tl", F.col(tgt_len).cast("long")), order, "_o")
    rows = cut_lineage(rows)
    n = rows.count()
    ends = rows.select("_o")
    for c in ("_sl", "_tl"):
        sums = cut_lineage(running_sums(rows.select("_o", c), ["_o"], [c]).select("_o", F.col(c + "_cum").cast("long").alias("_to"), (F.col(c + "_cum") - F.col(c)).cast("long").alias("_from")))
        # rows' sums and packs' limits in one order; a limit lies after the sums equal to it
        both = sums.select(F.col("_to").alias("_v"), F.lit(0).alias("_limit"), F.col("_o").alias("_r"), F.lit(1).cast("long").alias("_row")).unionByName(
            sums.select((F.col("_from") + max_tokens).alias("_v"), F.lit(1).alias("_limit"), F.col("_o").alias("_r"), F.lit(0).cast("long").alias("_row")))
        ranked = running_sums(both, ["_v", "_limit", "_r"], ["_row"])
        ends = ends.join(ranked.where(F.col("_limit") == 1).select(F.col("_r").alias("_o"), F.col("_row_cum").cast("long").alias(f"_end{c}")), "_o")
    nxt = cut_lineage(ends.select("_o", F.greatest(F.col("_o") + 1, F.least("_end_sl", "_end_tl", F.col("_o") + max_rows)).cast("long").alias("_next")))
    packs = global_index(chain_starts(nxt, n, shard_rows), ["_o"], "pack_id")
    spans = nxt.join(packs, "_o").select("pack_id", F.posexplode(F.sequence(F.col("_o"), F.col("_next") - 1)).alias("pack_pos", "_o"))
    return rows.join(spans, "_o").drop("_sl", "_tl")


def pack_pairs(pairs: DataFrame, order, src_len: str, tgt_len: str, max_tokens: int = 1024,
               shard_rows: int = 65536) -> DataFrame:
    """One row per pack: pack_id, first_ord, n_pairs, src_tokens, tgt_tokens."""
    return pack_rows(pairs, order, src_len, tgt_len, max_tokens, shard_rows).groupBy("pack_id").agg(
        F.min("_o").alias("first_ord"), F.count(F.lit(1)).alias("n_pairs"),
        F.sum(src_len).cast("long").alias("src_tokens"), F.sum(tgt_len).cast("long").alias("tgt_tokens"))


def packed_texts(pairs: DataFrame, order, src_len: str, tgt_len: str, max_tokens: int = 1024, source: str = "source",
                 target: str = "target", shard_rows: int = 65536) -> DataFrame:
    """One row per pack: pack_id, n_pairs and the sources and targets of its
    pairs, each joined by a blank (bounded by the budget, or one pair)."""
    rows = pack_rows(pairs, order, src_len, tgt_len, max_tokens, shard_rows)
    members = F.sort_array(F.collect_list(F.struct("pack_pos", F.col(source).alias("s"), F.col(target).alias("t"))))
    rows = rows.groupBy("pack_id").agg(members.alias("_m"))
    return rows.select("pack_id", F.size("_m").cast("long").alias("n_pairs"),
                       F.array_join(F.transform("_m", lambda m: m["s"]), " ").alias(source),
                       F.array_join(F.transform("_m", lambda m: m["t"]), " ").alias(target))
