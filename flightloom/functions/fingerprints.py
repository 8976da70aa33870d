"""64-bit token-vote fingerprints, near duplicates among them by class, and greedy dedup of a ranking."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Two lanes of 32 bits in a long: the votes for bits b and b + 32 are summed together.
LANES = (1 << 32) + 1
LOW = (1 << 32) - 1


def token_hash(token: Column) -> Column:
    """The first 64 bits of a token's md5, as a signed number."""
    return F.conv(F.substring(F.md5(token), 1, 16), 16, -10).cast("long")


def fingerprint_rows(rows: DataFrame, key: str, text: str) -> DataFrame:
    """(key, fingerprint): a bit is set where more of a text's tokens (lower case, cut at white space) have it in their hash than not; 0 without tokens.

    Votes are summed as 32 numbers a text, by the task that reads it, so the one shuffle carries a row a text. Keys are unique.
    """
    tokens = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"\s+"), lambda t: t != "")
    each = rows.select(key, F.explode_outer(tokens).alias("token")).select(key, token_hash(F.col("token")).alias("h"))
    votes = each.groupBy(key).agg(F.count("h").alias("n"), *(F.sum(F.shiftright("h", b).bitwiseAND(LANES)).alias(f"v{b}") for b in range(32)))
    bits = F.lit(0).cast("long")
    for b in range(32):
        held = F.coalesce(F.col(f"v{b}"), F.lit(0).cast("long"))
        for count, at in ((held.bitwiseAND(LOW), b), (F.shiftrightunsigned(held, 32), b + 32)):
            bits = bits.bitwiseOR(F.shiftleft((count * 2 > F.col("n")).cast("long"), at))
    return votes.select(key, bits.alias("fingerprint"))


def distance(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def simhash_pairs(prints: DataFrame, bits: int = 3) -> DataFrame:
    """(a, b, distance) of distinct fingerprints within ``bits`` <= 3, each pair once, of (id, fingerprint).

    Equal fingerprints are one entry, named by the smallest id. Of six parts two fingerprints within three bits share
    three, so pairs are met by each choice of three parts (32 bits or more, which few fingerprints share by chance) and
    kept from the first choice that they share.
    """
    own = prints.groupBy("fingerprint").agg(F.min("id").alias("id"))
    wide = [11, 11, 11, 11, 10, 10]
    starts = [sum(wide[:i]) for i in range(6)]
    masks = [((1 << w) - 1) << s for w, s in zip(wide, starts)]
    chosen = [masks[i] | masks[j] | masks[k] for i in range(6) for j in range(i + 1, 6) for k in range(j + 1, 6)]
    signed = [m - (1 << 64) if m >= 1 << 63 else m for m in chosen]
    spread = own.select("id", "fingerprint", F.posexplode(F.array(*(F.col("fingerprint").bitwiseAND(F.lit(m)) for m in signed))).alias("k", "part"))
    left, right = spread.alias("l"), spread.alias("r")
    both = left.join(right, (F.col("l.k") == F.col("r.k")) & (F.col("l.part") == F.col("r.part")) & (F.col("l.id") < F.col("r.id")))
    other = F.col("l.fingerprint").bitwiseXOR(F.col("r.fingerprint"))
    first = F.least(*(F.when(other.bitwiseAND(F.lit(m)) == 0, i).otherwise(len(signed)) for i, m in enumerate(signed)))
    gap = F.bit_count(other)
    return both.where((gap <= bits) & (first == F.col("l.k"))).select(F.col("l.id").alias("a"), F.col("r.id").alias("b"), gap.alias("distance"))


def dedupe_near_duplicates(cands: DataFrame, bits: int = 3) -> DataFrame:
    """Per query, in the order of rank (ties by chunk_id), the rows that no earlier kept one's fingerprint is within ``bits`` of: for pools of a few hundred rows a query."""
    pool = cands.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "chunk_id", "fingerprint"))).alias("pool"))
    none = F.array().cast(pool.schema["pool"].dataType)
    kept = F.aggregate("pool", none, lambda held, x: F.when(F.exists(held, lambda y: distance(x["fingerprint"], y["fingerprint"]) <= bits), held).otherwise(F.concat(held, F.array(x))))
    chosen = pool.select("query_id", F.explode(kept).alias("x")).select("query_id", F.col("x.chunk_id").alias("chunk_id"))
    return cands.join(chosen, ["query_id", "chunk_id"], "left_semi")
