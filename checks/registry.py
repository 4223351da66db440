"""All registered queries and the SQL they are checked against."""

from checks import analysis_checks, data_checks, io_checks, text_checks

MODULES = [text_checks, analysis_checks, data_checks, io_checks]


def queries():
    return {name: f for module in MODULES for name, f in module.QUERIES.items()}


def oracles():
    return {name: sql for module in MODULES for name, sql in module.ORACLES.items()}
