import pytest
from pyspark.sql import SparkSession


@pytest.fixture(scope="session")
def spark():
    s = (
        SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s


DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def documents(spark):
    """Two hundred documents with every awkward case: nulls, empty and long texts, ties, repeats, clashing extra columns."""
    import random

    r = random.Random(4)
    words = ["".join(r.choice("abdeghilmnorstu") for _ in range(r.randint(1, 9))) for _ in range(300)]
    rows = []
    for i in range(180):
        text = " ".join(r.choice(words) for _ in range(r.choice([3, 40, 60, 120, 300])))
        if i % 9 == 4:
            text = rows[-1][1]
        elif i % 9 == 7 and rows[-1][1]:
            w = rows[-1][1].split()
            w[len(w) // 2] = "changed"
            text = " ".join(w)
        elif i % 17 == 3:
            text = "\n".join(["the same line again and again"] * 30) + " tail"
        rows.append((i, text, r.choice(["en", "fr", None]), r.choice(["a", "a", "b", "c", None]), len(text)))
    rows += [(200, None, None, None, None), (201, "", "en", "a", 0), (202, " \n\t ", "en", "b", 4), (203, "x" * 50_000, "fr", "b", 50_000), (204, "word " * 20_000, "en", "c", 100_000)]
    rows += [(None, "a text without an id that is long enough to have shingles", "en", "a", 5)] * 2 + [rows[5]] * 3
    df = spark.createDataFrame(rows, DOCS)
    return df.selectExpr("*", "'x' as size", "1 as k", "'y' as _id", "2 as shard", "true as kept")


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], DOCS)
