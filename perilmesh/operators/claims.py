"""Claims pre-brief: the list of severest claims, and the adjusters it takes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import fixed as X
from ..functions.scalars import money_sum, severity_tier


def claims_list(book: DataFrame, artifact: DataFrame, *, zones=("AE", "VE"), by_value: int = 500, most: int = 200, exact: bool = False) -> DataFrame:
    """The ``most`` policies in ``zones`` with the highest expected loss, nulls last.

    As in the source system the ``by_value`` policies of highest insured value are taken
    first, so that a policy of high loss and low value may be missing; ``exact`` ranks all.
    Ties go to the smaller id.  Both limits are top-k, not sorts of all rows.
    """
    rows = book.where(F.col("flood_zone").isin(*zones))
    if not exact:
        rows = rows.orderBy(F.desc("tiv"), "id").limit(by_value)
    joined = rows.join(artifact.select("cohort_id", "total_tiv", "loss_p50"), "cohort_id", "left")
    out = joined.select("id", "zip3", "cohort_id", "tiv", severity_tier().alias("severity"), F.round(F.col("loss_p50") * F.col("tiv") / F.col("total_tiv"), 4).alias("expected_loss"))
    return out.orderBy(F.desc_nulls_last("expected_loss"), "id").limit(most)


def adjuster_load(claims: DataFrame) -> DataFrame:
    """Adjusters needed per ZIP3 for the expected losses, and their number beyond the baseline."""
    out = claims.where("expected_loss IS NOT NULL").groupBy("zip3").agg(F.count("*").alias("policy_count"), money_sum("expected_loss").alias("total_expected_loss"))
    needed = F.ceil(F.col("total_expected_loss") / X.ADJUSTER_DOLLARS)
    return out.select("zip3", "policy_count", "total_expected_loss", needed.alias("needed"), (needed - X.ADJUSTER_BASELINE).alias("delta")).orderBy(F.desc("delta"), F.desc("policy_count"), "zip3")
