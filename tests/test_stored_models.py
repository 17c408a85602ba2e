import pytest

from sparksentry.operators import stored_models

ROWS = [
    *((i, f"q=apple+{i}&page={i}", "benign") for i in range(12)),
    *((100 + i, f"id={i}' or 1=1 union select name from users", "sqli") for i in range(12)),
    *((200 + i, f"<script>alert({i})</script>", "xss") for i in range(12)),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, "id long, text string, label string").cache()


@pytest.mark.parametrize("name", stored_models.NAMES)
def test_a_model_comes_back_as_it_was(spark, docs, tmp_path, name):
    odd = spark.createDataFrame([(900, ""), (901, None), (902, "zzz unseen")], "id long, text string")
    asked = docs.select("id", "text").union(odd)
    model = stored_models.fit(name, docs)
    model.save(str(tmp_path))
    model.save(str(tmp_path))  # over the first one
    before = {r["id"]: r["predicted"] for r in model.predict(asked).collect()}
    again = stored_models.load(spark, name, str(tmp_path))
    assert {r["id"]: r["predicted"] for r in again.predict(asked).collect()} == before
    assert len(before) == len(ROWS) + 3 and set(before.values()) <= {"benign", "sqli", "xss"}
    assert all(before[i] == label for i, _, label in ROWS)


def test_unknown_and_missing_models(spark, docs, tmp_path):
    with pytest.raises(ValueError):
        stored_models.fit("forest", docs)
    with pytest.raises(FileNotFoundError):
        stored_models.load(spark, "svm", str(tmp_path))
