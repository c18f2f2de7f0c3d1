"""A mix of sources by target shares of tokens.

Tokens are summed per source; a source's rate is how often its records have to be used for its share; each record is emitted
floor(rate) times, and once more with the probability of the fraction, drawn from a seeded hash of its id. The draw needs no shuffle and gives the
same mix however the data are split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.llm.tokens import VOCABULARY, count_tokens
from brindle.session import materialize, narrow


def source_rates(sized: DataFrame, targets: DataFrame, total_tokens: float | None = None) -> DataFrame:
    """source, target_share, max_repeats, n_docs, n_tokens, rate: one row for each row of targets.

    sized: source, n_tokens per record. rate = target_share * total / tokens of the source, at most max_repeats. total_tokens: the size of the mix;
    by default the largest at which no source with records exceeds max_repeats, so that their shares come out in the wanted proportion.
    A source of targets without records (or without tokens) has rate 0. Shares, null or negative, and repeats, null or under 1, count as 0.
    """
    have = sized.groupBy("source").agg(F.count(F.lit(1)).alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
    want = targets.groupBy("source").agg(F.sum(F.greatest(F.coalesce("target_share", F.lit(0.0)), F.lit(0.0))).alias("target_share"), F.max(F.greatest(F.coalesce("max_repeats", F.lit(0)), F.lit(0))).alias("max_repeats"))
    j = want.where(F.col("source").isNotNull()).join(have, "source", "left").select(
        "source", "target_share", "max_repeats", F.coalesce("n_docs", F.lit(0)).alias("n_docs"), F.coalesce("n_tokens", F.lit(0)).alias("n_tokens")
    )
    usable = (F.col("n_tokens") > 0) & (F.col("target_share") > 0) & (F.col("max_repeats") > 0)
    most = F.when(usable, F.col("max_repeats") * F.col("n_tokens") / F.when(usable, F.col("target_share")))
    if total_tokens is None:
        bound = j.agg(F.min(most).alias("total"))  # one row
        j = j.crossJoin(F.broadcast(bound))
    else:
        j = j.withColumn("total", F.lit(float(total_tokens)))
    rate = F.least(F.col("target_share") * F.col("total") / F.when(usable, F.col("n_tokens")), F.col("max_repeats").cast("double"))
    return j.select("source", "target_share", "max_repeats", "n_docs", "n_tokens", F.coalesce(F.round(rate, 12), F.lit(0.0)).alias("rate"))


def mix_sources(
    docs: DataFrame, targets: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 7, total_tokens: float | None = None, path: str = VOCABULARY
) -> tuple[DataFrame, DataFrame]:
    """(mix, shares). mix: doc_id, source, n_tokens, copy (1..): one row for each use of a record. shares: a row for each target source with what it reaches.

    Sizes are tokens of a public tokenizer. Records of null or untargeted sources are in no mix; null and empty texts have no tokens and take part
    with their source's rate. Rows repeated with one id are drawn alike. No record is used more than max_repeats times; rows are
    never cut or sampled beyond what the rates say. An empty table gives no mix and shares of 0.
    """
    # Only texts of sources with a target are encoded. Three narrow columns; written, as encoding is the costly part and both results read it.
    wanted = narrow(targets, source="source").where("source is not null").distinct()
    own = narrow(docs, doc_id=id_col, text=text_col, source=source_col)
    own = own.join(F.broadcast(wanted) if wanted.count() <= 10_000 else wanted, "source", "left_semi")
    sized = materialize(count_tokens(own, "text", {"doc_id": "doc_id", "source": "source"}, path))
    # One row for each target; materialized before it is broadcast, so that the size is that of the targets table.
    rates = materialize(source_rates(sized, targets, total_tokens))
    small = rates.count() <= 10_000
    joined = sized.join(F.broadcast(rates.select("source", "rate", "max_repeats")) if small else rates.select("source", "rate", "max_repeats"), "source")
    drawn = F.pmod(F.xxhash64(F.lit(seed), F.col("doc_id").cast("string")), F.lit(1 << 53)) / F.lit(float(1 << 53))
    whole = F.floor("rate")
    copies = F.least(whole + F.when(drawn < F.col("rate") - whole, 1).otherwise(0), F.col("max_repeats")).cast("int")
    used = joined.withColumn("copies", copies).where("copies > 0")
    mix = used.select("doc_id", "source", "n_tokens", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy"))
    reached = used.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("copies")).alias("mix_tokens"), F.sum("copies").alias("mix_docs"))
    total = reached.agg(F.sum("mix_tokens").alias("all_tokens"))  # one row
    shares = rates.join(reached, "source", "left").crossJoin(F.broadcast(total)).select(
        "source", "target_share", "max_repeats", "n_docs", "n_tokens", "rate",
        F.coalesce("mix_docs", F.lit(0)).alias("mix_docs"), F.coalesce("mix_tokens", F.lit(0)).alias("mix_tokens"),
        F.coalesce(F.col("mix_tokens") / F.when(F.col("all_tokens") > 0, F.col("all_tokens")), F.lit(0.0)).alias("actual_share"),
    )
    return mix, shares
