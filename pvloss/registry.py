"""All queries over the driver's tables, with the SQL that checks them."""

from .plans import cause_queries, daily_queries, event_queries, interval_queries, layout_queries, output_queries, range_queries, solar_queries, source_queries

MODULES = (daily_queries, event_queries, interval_queries, layout_queries, cause_queries, output_queries, range_queries, solar_queries, source_queries)


def queries():
    return {name: f for m in MODULES for name, f in m.QUERIES.items()}


def oracle_sql():
    return {name: text for m in MODULES for name, text in m.SQL.items()}


def flagship(spark, sf_dir):
    """Lost energy of every system."""
    return daily_queries.loss(spark, sf_dir)
