"""The registered update hands the whole table to the operator, which removes the replaced documents itself."""

from conftest import rows
from lattiq.operators import maintain
from lattiq.plans import catalogue


def test_update_removes_old_rows(spark, monkeypatch):
    d = "/root/testdata/sf0.001"
    right = rows(catalogue.QUERIES["update_replace"](spark, d))
    monkeypatch.setattr(maintain, "replaced", lambda postings, new: postings.unionByName(new))
    assert rows(catalogue.QUERIES["update_replace"](spark, d)) != right
