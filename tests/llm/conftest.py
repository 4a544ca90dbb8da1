import pytest
from pyspark.sql import Row

SMALL, MIDDLE = "/root/testdata/sf0.001", "/root/testdata/sf0.01"
LONG = " ".join(f"word{i % 97} and the{i}" for i in range(20000))
CLASHING = {"score": 1.0, "label": "x", "start": 5, "fp": "f", "node": 3, "stay_id": 4, "hash_1": 1, "grp": 2, "data": "d", "chunk": 9, "row": 0, "h": "h"}


@pytest.fixture(scope="session")
def corner(spark):
    """Rows that are hard on operators: nulls, empty and very long texts, repeats, and columns with clashing names."""
    texts = [(1, "The quick brown fox jumps over the lazy dog."), (1, "The quick brown fox jumps over the lazy dog."), (2, None), (3, ""), (4, LONG),
             (None, "No id here, but of words and the rest."), (5, " \n\t "), (6, "é"), (7, "!!!"), (8, "The quick brown fox jumps over the lazy dog.")]
    rows = [Row(doc_id=i, text=t, lang=None, source=None, n_chars=None, **CLASHING) for i, t in texts]
    kinds = "doc_id long, text string, lang string, source string, n_chars long, score double, label string, start int, fp string, node int, " \
            "stay_id int, hash_1 int, grp int, data string, chunk int, row int, h string"
    return spark.createDataFrame([tuple(r) for r in rows], kinds)


@pytest.fixture(scope="session")
def nothing(corner):
    return corner.limit(0)


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet")


@pytest.fixture(scope="session")
def write_tables(spark, tmp_path_factory):
    """Rows by table name -> a folder of Parquet tables, to run registered queries on."""
    def write(**tables):
        folder = tmp_path_factory.mktemp("tables")
        for name, (columns, rows) in tables.items():
            spark.createDataFrame(rows, columns).coalesce(2).write.parquet(f"{folder}/{name}.parquet")
        return str(folder)
    return write
