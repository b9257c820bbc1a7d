import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from barloom.session import session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    return session("local[4]", 4, **{"spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false",
                                     "spark.driver.memory": "6g"})


@pytest.fixture(scope="session")
def frame(spark):
    """Build a DataFrame from rows with ISO dates in the columns named date (or ending in _date)."""
    import datetime as dt

    def build(schema, rows):
        names = [c.split()[0] for c in schema.split(",")]
        dated = [i for i, n in enumerate(names) if n == "date" or n.endswith("_date")]
        out = []
        for row in rows:
            row = list(row)
            for i in dated:
                row[i] = None if row[i] is None else dt.date.fromisoformat(row[i])
            out.append(tuple(row))
        return spark.createDataFrame(out, schema)

    return build


def days(n, start="2020-01-01"):
    import datetime as dt

    first = dt.date.fromisoformat(start)
    return [str(first + dt.timedelta(days=i)) for i in range(n)]
