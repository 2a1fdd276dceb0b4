"""One check per operator: a Spark query over the given tables, and SQL with the same result."""

from checks import advisories, catalog, charts, cleaning, describe, inference, quality, sources, wrangle

MODULES = [sources, quality, wrangle, describe, inference, charts, catalog, cleaning, advisories]


def all_checks():
    found = {}
    for module in MODULES:
        for check in module.CHECKS:
            if check.name in found:
                raise ValueError(f"two checks are named {check.name!r}")
            found[check.name] = check
    return found
