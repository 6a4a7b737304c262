"""Named queries over the given tables, and the SQL they are checked against."""


def load():
    """All registered queries and their SQL."""
    from tallyboard.plans import (  # noqa: F401
        catalog,
        cube_plans,
        facts,
        report_plans,
        sequence_plans,
        stats_plans,
        store_plans,
    )

    return catalog.QUERIES, catalog.ORACLES
