"""Rows of a result, for comparisons, and where the small tables lie."""

SF_DIR = "/root/testdata/sf0.001"


def rows(df, *order):
    found = [r.asDict() for r in df.collect()]
    return sorted(found, key=lambda r: [str(r[c]) for c in order]) if order else found


def by(df, key):
    return {r[key]: r for r in df.collect()}
