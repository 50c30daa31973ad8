"""The four tables of the star schema, passed around as one value."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame


@dataclass(frozen=True)
class Tables:
    """Fact and dimension DataFrames.

    Key columns may be strings (as declared) or integers (as in the test mapping);
    every operator joins on names only.
    """

    fact: DataFrame
    stores: DataFrame
    campaigns: DataFrame
    products: DataFrame
    # Optional: the view's sums at its own grain, written once and shared by reports
    # (see liftwise.operators.star.materialize_summary).
    summary: DataFrame | None = None
    # True once liftwise.sources.checks.verify_keys found unique dimension keys and no
    # orphan fact: an inner join with a dimension whose columns a query does not use
    # is then the identity and is left out.  Re-verify after the data changes.
    keys_verified: bool = False
    # Dimensions past the broadcast bound, joined with a shuffle (set by
    # broadcast_small_dims): the fact is grouped by the joined keys before such a join.
    shuffled_dims: frozenset = frozenset()

    def with_fact(self, fact: DataFrame) -> "Tables":
        """Another fact: what was verified or summed over the old one no longer holds."""
        return replace(self, fact=fact, keys_verified=False, summary=None)

    def with_campaigns(self, campaigns: DataFrame) -> "Tables":
        """Other campaigns: verified keys and written sums no longer hold."""
        return replace(
            self,
            campaigns=campaigns,
            keys_verified=False,
            summary=None,
            shuffled_dims=self.shuffled_dims - {"campaigns"},
        )

    def with_summary(self, summary: DataFrame | None) -> "Tables":
        return replace(self, summary=summary)
