"""SQL over the registered views equals the DataFrame reports."""

from __future__ import annotations

from decimal import Decimal

from liftwise.plans.views import register_views


def test_sql_over_registered_views(spark, hand):
    names = register_views(spark, hand, prefix="hand_")
    assert names[-1] == "hand_sales_summary"
    rows = spark.sql(
        """
        SELECT campaign_name, SUM(IR) AS gain, 100 * SUM(IR) DIV SUM(revenue_before_promo) AS points
        FROM hand_sales_summary GROUP BY campaign_name HAVING COUNT(*) > 1 ORDER BY gain DESC
        """
    ).collect()
    assert [tuple(r) for r in rows] == [("Alpha", Decimal("5750.00"), 33), ("Beta", Decimal("-2245.00"), -15)]
    both = spark.sql(
        "SELECT SUM(`quantity_sold(before_promo)`) AS a, SUM(quantity_sold_before_promo) AS b FROM hand_fact_events"
    ).first()
    assert both.a == both.b == 46
    stores = spark.sql(
        "SELECT s.city, COUNT(f.event_id) AS n FROM hand_fact_events f JOIN hand_dim_stores s ON f.store_id = s.store_id "
        "GROUP BY s.city ORDER BY s.city"
    ).collect()
    assert [tuple(r) for r in stores] == [("North", 4), ("South", 4)]
