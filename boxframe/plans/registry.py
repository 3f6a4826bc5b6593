"""The queries by name, each with the SQL that should give the same rows."""

QUERIES = {}
ORACLES = {}


def query(sql=None):
    """Register a function of (spark, sf_dir) under its name."""

    def add(function):
        name = function.__name__
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = function
        if sql is not None:
            ORACLES[name] = sql
        return function

    return add
