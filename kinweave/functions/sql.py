"""The library's columns under SQL names, as SQL functions: their bodies are expressions, so that Catalyst inlines them and no Python runs."""

from __future__ import annotations

import re

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from ..operators.mentions import split_participants
from . import dates, names, phonetic, stats

_c = F.col
#: Scalar functions by name: parameters, and the column made of them.
SCALARS = {
    "koelner": ("name STRING", lambda: phonetic.koelner(_c("name"))),
    "given_canon": ("given STRING", lambda: names.given_canon(_c("given"))),
    "given_points": ("a STRING, b STRING", lambda: names.given_points(_c("a"), _c("b"))),
    "names_similar": ("a STRING, b STRING", lambda: names.names_similar(_c("a"), _c("b"))),
    "parse_person": ("cell STRING", lambda: names.parse_person(_c("cell"))),
    "parse_age_days": ("age STRING", lambda: dates.age_days(_c("age"))),
    "parse_partial_date": ("text STRING", lambda: dates.partial_date(_c("text"))),
    "pair_count": ("n BIGINT", lambda: stats.pair_count(_c("n"))),
    "wilson_low": ("hits BIGINT, n BIGINT", lambda: stats.wilson(_c("hits"), _c("n"))[0]),
    "wilson_high": ("hits BIGINT, n BIGINT", lambda: stats.wilson(_c("hits"), _c("n"))[1]),
}
#: Table functions by name: parameters, the table they give, and the array of structs whose rows it has.
TABLES = {"split_participants": ("cell STRING", "pos INT, participant STRING", lambda: split_participants(_c("cell")))}

# In a column's text operators stand before their operands, like functions, and a double has no suffix.
_TOKEN = re.compile(r"""(?P<text>'(?:[^'\\]|\\.)*')|(?<![\w`.])(?P<double>\d+\.\d+(?:E-?\d+)?)(?![\w.])|(?<![\w`])(?P<op><=>|<=|>=|==|=|<|>|\+|-|\*|/|%|!|and|or|in)\(""")


def expression(column: Column) -> str:
    """A column as the text of a SQL expression."""

    def put(m: re.Match) -> str:
        return f"`{m['op']}`(" if m["op"] else f"{m['double']}D" if m["double"] else m[0]

    return _TOKEN.sub(put, column._jc.node().sql())


def register(spark: SparkSession) -> None:
    """Make all functions known to the session's SQL, as temporary functions; calling it again does no harm.

    Nulls count as the columns have it: an empty key, no points, a struct without a name. ``split_participants`` is for a lateral join and gives no row for null.
    """
    for name, (takes, made) in SCALARS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({takes}) RETURN {expression(made())}")
    for name, (takes, gives, made) in TABLES.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({takes}) RETURNS TABLE({gives}) RETURN SELECT * FROM posexplode({expression(made())})")
