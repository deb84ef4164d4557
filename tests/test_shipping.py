import zipfile

from groundq.shipping import ship


def test_package_is_shipped_once(spark, monkeypatch):
    added = []
    context = spark.sparkContext
    monkeypatch.setattr(context, "_groundq_shipped", False, raising=False)
    monkeypatch.setattr(context, "addPyFile", added.append)
    ship(spark)
    ship(spark)
    assert len(added) == 1
    names = zipfile.ZipFile(added[0]).namelist()
    assert "groundq/__init__.py" in names and "groundq/operators/retrieve.py" in names and all(n.endswith(".py") for n in names)
