import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from marquee.session import get_session

    s = get_session("local[4]", 4, app_name="marquee-tests", driver_memory="4g")
    yield s


EVAL_ROWS = [
    ("tt001", "Neon Heist", "Neon Heist", "Ava Lin", "['Action', 'Crime']", "8.7", "['Mara Vale', 'Jon Pike']"),
    ("tt002", "Midnight Crew", "Midnight Crew", "Ben Ortiz", "['Action', 'Crime']", "8.2", "['Mara Vale', 'Luis Chen']"),
    ("tt003", "Silent Orchard", "Silent Orchard", "Cora Shah", "['Drama']", "9.0", "['Iris Moon']"),
    ("tt004", "Space Garden", "Space Garden", "Dina Park", "['Sci-Fi', 'Adventure']", "8.5", "['Noah Reed']"),
    ("tt005", "Galaxy Chase", "Galaxy Chase", "Eli Stone", "['Sci-Fi', 'Adventure']", "8.3", "['Noah Reed', 'Uma Fox']"),
    ("tt006", "Romantic Kitchen", "Romantic Kitchen", "Faye Moore", "['Romance', 'Comedy']", "7.9", "['Lena Hart']"),
    ("tt007", "Deep Space Laughs", "Deep Space Laughs", "Gabe Yu", "['Comedy', 'Sci-Fi']", "7.2", "['Omar Bell']"),
    ("tt008", "Crime Alley", "Crime Alley", "Hana West", "['Crime', 'Thriller']", "7.5", "['Luis Chen']"),
]
EVAL_SCHEMA = "tconst string, title string, primary_title string, director string, genres string, score string, actors string"


@pytest.fixture(scope="session")
def eval_catalog(spark):
    return spark.createDataFrame(EVAL_ROWS, EVAL_SCHEMA)


def recs_by_query(df):
    out = {}
    for r in df.orderBy("query", "rank").collect():
        if r["rank"] is not None:
            out.setdefault(r["query"], []).append(r["title"])
        else:
            out.setdefault(r["query"], [])
    return out


def errors_by_query(df):
    return {r["query"]: r["error"] for r in df.where("error is not null").collect()}
