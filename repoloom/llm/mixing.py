"""Mix sources to target shares of the tokens (problem 8).

Every document is counted in tokens of a public tokenizer. A mix is as large as its scarcest source allows, or as large
as ``total_tokens`` says. It is cut into blocks of equal, whole numbers of tokens; Sainte-Laguë apportionment (highest
quotients ``share / (2 k + 1)``) gives every source its number of blocks, never beyond ``max_repeats`` times what the
source has, and hands the source's blocks to its groups of hash shards and from them to the shards in the same way. The
blocks of a shard are consecutive stretches of its documents in seeded order: whole passes first, then its first blocks;
documents that the rest of the quota cannot hold are passed over for later ones that it can.

A shard holds a bounded number of documents (``SHARD_DOCS``) and a group a bounded number of shards, so that a source
that holds a third of all rows is spread like any other; the driver holds at most ``GROUPS`` rows per source.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from repoloom.llm.bpe import count_tokens
from repoloom.session import materialise

#: Blocks that a mix is cut into: one block is this fraction of the mix.
BLOCKS = 100_000
#: Documents that one shard of a source holds at most, about, and groups of shards that a source has at most.
SHARD_DOCS, GROUPS = 20_000, 1_024
SEED = 42


def sainte_lague(weights: np.ndarray, seats: int, caps: np.ndarray | None = None) -> np.ndarray:
    """Seats by highest quotients ``weight / (2 k + 1)``, at most ``caps`` each; ties go to the lower index.

    Finds the divisor by bisection, then hands out or takes back the few seats that are left in order of their
    quotients, so that it takes no step per seat. Weights of zero or less get none. If the caps leave too few seats,
    all caps are filled.
    """
    weights = np.where(np.asarray(weights, float) > 0, weights, 0.0)
    caps = np.full(len(weights), seats, np.int64) if caps is None else np.minimum(np.asarray(caps, np.int64), seats)
    caps = np.where(weights > 0, caps, 0)
    seats = int(min(seats, caps.sum()))
    given = np.zeros(len(weights), np.int64)
    if seats <= 0:
        return given
    low, high = 0.0, 2.0 * weights.max() + 1e-300
    for _ in range(200):
        divisor = (low + high) / 2
        got = np.minimum(np.floor(weights / divisor + 0.5), caps).astype(np.int64)
        if got.sum() > seats:
            low = divisor
        else:
            high, given = divisor, got
    queue = [(-w / (2 * g + 1), i) for i, (w, g, c) in enumerate(zip(weights, given, caps, strict=True)) if g < c]
    heapq.heapify(queue)
    for _ in range(seats - int(given.sum())):
        _, i = heapq.heappop(queue)
        given[i] += 1
        if given[i] < caps[i]:
            heapq.heappush(queue, (-weights[i] / (2 * given[i] + 1), i))
    return given


def _group_quotas(stats: pd.DataFrame, targets: pd.DataFrame, total_tokens: int | None, blocks: int) -> pd.DataFrame:
    """Blocks that each group of shards gives to each mix. ``stats``: source, group, n_tokens."""
    stats = stats.sort_values(["source", "group"])
    have = stats.groupby("source").n_tokens.sum()
    out = []
    for mix_id, mix in targets.sort_values(["mix_id", "source"]).groupby("mix_id"):
        mix = mix.assign(available=mix.source.map(have).fillna(0).astype("int64"))
        live = mix[(mix.available > 0) & (mix.target_share > 0) & (mix.max_repeats > 0)]
        if live.empty:
            continue
        share = (live.target_share / live.target_share.sum()).to_numpy()
        most = (live.available * live.max_repeats).to_numpy("int64")
        total = int((most / share).min()) if total_tokens is None else int(total_tokens)
        block = max(1, total // blocks)
        given = sainte_lague(share, total // block, most // block)
        for source, repeats, seats in zip(live.source, live.max_repeats, given, strict=True):
            groups = stats[stats.source == source]
            tokens = groups.n_tokens.to_numpy("int64")
            per_group = sainte_lague(tokens, int(seats), -(-tokens * int(repeats) // block))
            out.append(pd.DataFrame({"mix_id": mix_id, "source": source, "group": groups.group.to_numpy(), "seats": per_group, "block": block, "max_repeats": int(repeats)}))
    columns = ["mix_id", "source", "group", "seats", "block", "max_repeats"]
    return pd.concat(out, ignore_index=True) if out else pd.DataFrame(columns=columns)


def _shard_quotas(shards: pd.DataFrame) -> pd.DataFrame:
    """The blocks of one group for one mix, handed to its shards: their quotas in tokens."""
    shards = shards.sort_values("shard")
    tokens, block, repeats = shards.n_tokens.to_numpy("int64"), int(shards.block.iloc[0]), int(shards.max_repeats.iloc[0])
    seats = sainte_lague(tokens, int(shards.seats.iloc[0]), -(-tokens * repeats // block))
    return shards.assign(quota=np.minimum(seats * block, tokens * repeats))[["mix_id", "source", "group", "shard", "quota", "max_repeats"]]


def take(sizes: np.ndarray, quota: int) -> np.ndarray:
    """Which of the sizes, in order, are taken so that their sum stays within ``quota``: each one that still fits."""
    taken = np.cumsum(sizes) <= quota
    left = quota - int(sizes[taken].sum())
    smallest = int(sizes.min()) if len(sizes) else 0
    for k in np.flatnonzero(~taken).tolist():
        if left < smallest:
            break
        if sizes[k] <= left:
            taken[k] = True
            left -= int(sizes[k])
    return taken


def _chosen(documents: pd.DataFrame, quotas: pd.DataFrame) -> pd.DataFrame:
    """What one shard gives to the mixes."""
    documents = documents.sort_values(["h", "doc_id"])
    sizes = documents.n_tokens.to_numpy("int64")
    total = int(sizes.sum())
    out = []
    for mix_id, quota, most in zip(quotas.mix_id, quotas.quota, quotas.max_repeats, strict=True):
        passes, rest = divmod(int(quota), total) if total else (0, 0)
        repeats = np.minimum(passes + take(sizes, rest), most)
        out.append(documents.assign(mix_id=mix_id, repeats=repeats)[repeats > 0])
    columns = ["mix_id", "source", "doc_id", "n_tokens", "repeats"]
    return pd.concat(out, ignore_index=True)[columns] if out else pd.DataFrame(columns=columns)


def mix(documents: DataFrame, targets: DataFrame, vocabulary: str | None = None, total_tokens: int | None = None, blocks: int = BLOCKS, shard_docs: int = SHARD_DOCS, seed: int = SEED) -> DataFrame:
    """``mix_id, source, doc_id, n_tokens, repeats`` for every document in a mix, ``repeats`` from 1 to ``max_repeats``.

    Sources without documents, and documents of a null source or of a source in no mix, take no part; documents with a
    null or empty text have no tokens and are never chosen. Repeated rows of ``documents`` are separate documents with
    equal places. No source exceeds its share by more than a block, and a shard falls short of its quota by less than the
    smallest document that it leaves out.
    """
    spark = documents.sparkSession
    goals = targets.select("mix_id", "source", "target_share", "max_repeats").where("source is not null and target_share is not null and max_repeats is not null")
    definition = goals.toPandas()  # a few rows that the user wrote
    wanted = F.col("source").isin(*sorted(set(definition.source))) if len(definition) else F.lit(False)
    placed = documents.where(wanted).select("doc_id", "source", F.xxhash64(F.lit(seed), "doc_id", "text").alias("h"), "text")
    counted = materialise(count_tokens(placed, ["doc_id", "source", "h"], vocabulary).where("n_tokens > 0"), "p8-tokens")
    shards = F.greatest(F.lit(1), F.ceil(F.col("n_docs") / shard_docs))
    sizes = counted.groupBy("source").agg(F.count("*").alias("n_docs")).select("source", F.least(F.lit(GROUPS), F.ceil(F.sqrt(shards))).cast("int").alias("groups"), shards.alias("shards"))
    spread_over = sizes.select("source", "groups", F.ceil(F.col("shards") / F.col("groups")).cast("int").alias("each"))  # one row per source of the mixes
    bits = lambda low: F.shiftrightunsigned("h", low).bitwiseAND(F.lit((1 << 31) - 1))
    place = counted.join(F.broadcast(spread_over), "source").withColumns({"group": F.pmod(bits(0), "groups").cast("int"), "shard": F.pmod(bits(31), "each").cast("int")}).drop("groups", "each")
    stats = place.groupBy("source", "group", "shard").agg(F.sum("n_tokens").alias("n_tokens"))
    stats = materialise(stats, "p8-shards")
    by_group = _group_quotas(stats.groupBy("source", "group").agg(F.sum("n_tokens").alias("n_tokens")).toPandas(), definition, total_tokens, blocks)
    seats = spark.createDataFrame(by_group, "mix_id string, source string, group int, seats bigint, block bigint, max_repeats int")
    quotas = stats.join(seats, ["source", "group"]).groupBy("mix_id", "source", "group").applyInPandas(_shard_quotas, "mix_id string, source string, group int, shard int, quota bigint, max_repeats int").where("quota > 0")
    key = ["source", "group", "shard"]
    return place.groupBy(*key).cogroup(quotas.groupBy(*key)).applyInPandas(_chosen, "mix_id string, source string, doc_id bigint, n_tokens bigint, repeats int")


def shares(mixed: DataFrame, targets: DataFrame) -> DataFrame:
    """Per mix and source of ``targets``: target share, documents, tokens with repeats, most repeats and share reached.

    A source that gave nothing has 0 documents, 0 tokens and share 0; a mix without any tokens has null shares.
    """
    got = mixed.groupBy("mix_id", "source").agg(F.count("*").alias("n_docs"), F.sum(F.col("n_tokens") * F.col("repeats")).alias("n_tokens"), F.max("repeats").alias("most_repeats"))
    whole = Window.partitionBy("mix_id")
    both = targets.select("mix_id", "source", "target_share", "max_repeats").join(got, ["mix_id", "source"], "left").fillna(0, ["n_docs", "n_tokens", "most_repeats"])
    return both.withColumn("actual_share", F.try_divide(F.col("n_tokens"), F.sum("n_tokens").over(whole)))


def checked(shares_: DataFrame, tolerance: float = 0.01) -> DataFrame:
    """Per mix and source whether it gave documents, its share is that of the target among them, and no repeat is too many."""
    given = F.col("n_docs") > 0
    live = F.when(given, F.col("target_share")).otherwise(0.0)
    goal = F.try_divide(live, F.sum(live).over(Window.partitionBy("mix_id")))
    near = F.coalesce(F.abs(F.col("actual_share") - goal) <= tolerance, ~given)
    return shares_.select("mix_id", "source", given.alias("gave"), near.alias("near_target"), (F.col("most_repeats") <= F.col("max_repeats")).alias("within_repeats"))
