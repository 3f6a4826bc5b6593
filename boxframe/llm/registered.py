"""The registered queries of this subpackage, by name, and the SQL of some."""

from . import (
    counts,
    langid,
    licences,
    mixing,
    near,
    pii,
    quality,
    repeats,
    resample,
    templates,
    vectors,
    warc,
    whitening,
)

MODULES = (
    counts,
    langid,
    licences,
    mixing,
    near,
    pii,
    quality,
    repeats,
    resample,
    templates,
    vectors,
    warc,
    whitening,
)
QUERIES = {name: make for m in MODULES for name, make in m.QUERIES.items()}
ORACLES = {name: sql for m in MODULES for name, sql in getattr(m, "ORACLES", {}).items()}
